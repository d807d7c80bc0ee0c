"""Queries for text-similarity (I) and ranking metrics (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rankmetrics, textmetrics
from . import views as v
from .registry import Registry

R = Registry()

SPLIT_SQL = (
    (r"([\{-\~\[-\`\ -\&\(-\+\:-\@\/])", r" \1 "),
    (r"([^0-9])([\.,])", r"\1 \2 "),
    (r"([\.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
)


def t13a(x: str, lower: bool = False) -> str:
    x = f"replace(replace(replace({x},'<skipped>',''),'-'||chr(10),''),chr(10),' ')"
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x},'{a}','{b}')"
    x = f"' '||{'lower(' + x + ')' if lower else x}||' '"
    for a, b in SPLIT_SQL:
        x = f"regexp_replace({x},'{a}','{b}','g')"
    return f"regexp_extract_all({x},'[^\\s]+')"


def rouge_toks(x: str) -> str:
    return f"regexp_extract_all(regexp_replace(lower({x}),'[^a-z0-9]+',' ','g'),'[^\\s]+')"


def gram_counts(tokens: str, n: int, chars: bool = False) -> str:
    """id, n, clipped matches, prediction and reference n-grams from ``toks(id, p, t)``."""
    gram = "substring({c},i,n)" if chars else "array_to_string({c}[i:i+n-1], chr(1))"
    side = lambda c, is_p: (
        f"select id, n, {is_p} as is_p, unnest(list_transform(range(1, len({c})-n+2), lambda i:"
        f" {gram.format(c=c)})) as g from {tokens}, (select unnest(range(1,{n}+1)) as n)"
    )
    return (
        "select id, n, sum(least(cp,ct))::bigint as m, sum(cp)::bigint as p, sum(ct)::bigint as t from"
        " (select id, n, g, sum(is_p) as cp, sum(1-is_p) as ct from"
        f" ({side('p', 1)} union all {side('t', 0)}) group by 1,2,3) group by 1,2"
    )


def toks_of(split, model: str, extra: str = "") -> str:
    return f"select id{extra}, {split(model)} as p, {split('target')} as t from predictions"


LENGTHS = "select sum(len(p))::double as pl, sum(len(t))::double as tl from toks"


def corpus_bleu_sql(n: int, smooth: bool = False) -> str:
    num, den = ("m+if(n>1,1,0)", "p+if(n>1,1,0)") if smooth else ("m", "p")
    return (
        f"select round(case when min(m)=0 then 0 else exp(avg(ln(({num})::double/({den})))) * any_value(case when"
        " pl>tl then 1 else exp(1-tl/pl) end) end, 9) as bleu from (select n, sum(m) as m, sum(p) as p from"
        " grams group by 1), lens"
    )


def pairs(spark, sf, model="model_b"):
    return v.predictions(spark, sf).withColumnRenamed(model, "prediction")


def rounded(df, digits=9):
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes]
    )


@R.add(
    "i1_tokenize_13a",
    f"select doc_id, array_to_string({t13a('text')}, ' ') as tokens from documents",
)
def i1(spark, sf):
    out = textmetrics.tokenize_13a(v.table(spark, sf, "documents"), "text")
    return out.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


for _n in (1, 4):

    @R.add(
        f"i2_corpus_bleu{_n}",
        v.with_sql(
            corpus_bleu_sql(_n),
            "predictions",
            toks=toks_of(t13a, "model_b"),
            grams=gram_counts("toks", _n),
            lens=LENGTHS,
        ),
    )
    def i2(spark, sf, n=_n):
        return rounded(textmetrics.corpus_bleu(pairs(spark, sf), n=n))


@R.add(
    "i2_corpus_bleu_smooth",
    v.with_sql(
        corpus_bleu_sql(4, smooth=True),
        "predictions",
        toks=toks_of(t13a, "model_a"),
        grams=gram_counts("toks", 4),
        lens=LENGTHS,
    ),
)
def i2_smooth(spark, sf):
    return rounded(textmetrics.corpus_bleu(pairs(spark, sf, "model_a"), smooth=True))


LOWER_13A = lambda x: t13a(x, True)

_ROW_BLEU = (
    "select id, case when sum(m)=0 or count(*) filter (p>0)<4 then 0 else"
    " 100*case when any_value(pl)>=any_value(tl) then 1 else exp(1-any_value(tl)::double/any_value(pl)) end*exp(avg(case when m=0 then"
    " -ln(pow(2.0,z)*p) else ln(m::double/p) end)) end as bleu from (select g.*, sum((m=0)::int) over"
    " (partition by id order by n) as z, len(toks.p) as pl, len(toks.t) as tl from grams g join toks using (id)) group by 1"
)


@R.add(
    "i3_sacre_bleu_row",
    v.with_sql(
        "select id, round(coalesce(bleu,0),7) as bleu from predictions left join r using (id)",
        "predictions",
        toks=toks_of(LOWER_13A, "model_b"),
        grams=gram_counts("toks", 4),
        r=_ROW_BLEU,
    ),
)
def i3_row(spark, sf):
    return rounded(textmetrics.sacre_bleu(pairs(spark, sf), level="row").select("id", "bleu"), 7)


@R.add(
    "i3_sacre_bleu_corpus",
    v.with_sql(
        "select round(100*exp(avg(ln(m::double/p)))*any_value(case when pl>=tl then 1 else exp(1-tl/pl) end), 7)"
        " as bleu from (select n, sum(m) as m, sum(p) as p from grams group by 1), lens",
        "predictions",
        toks=toks_of(LOWER_13A, "model_b"),
        grams=gram_counts("toks", 4),
        lens=LENGTHS,
    ),
)
def i3_corpus(spark, sf):
    return rounded(textmetrics.sacre_bleu(pairs(spark, sf)), 7)


for _n in (1, 2):

    @R.add(
        f"i4_rouge{_n}",
        v.with_sql(
            "select round(avg(coalesce(pr,0)),9) as precision, round(avg(coalesce(rc,0)),9) as recall,"
            " round(avg(coalesce(case when pr+rc>0 then 2*pr*rc/(pr+rc) end,0)),9) as fmeasure from predictions left join"
            f" (select id, m::double/nullif(p,0) as pr, m::double/nullif(t,0) as rc from grams where n={_n}) using (id)",
            "predictions",
            toks=toks_of(rouge_toks, "model_b"),
            grams=gram_counts("toks", _n),
        ),
    )
    def i4(spark, sf, n=_n):
        return rounded(textmetrics.rouge_n(pairs(spark, sf), n))


def chars_of(x: str) -> str:
    return f"regexp_replace({x},'\\s+','','g')"


CHRF_RAW = (
    "select {key} coalesce(100*5*pr*rc/nullif(4*pr+rc,0),0) as chrf from (select {key}"
    " avg(m::double/p) filter (p>0 and t>0) as pr, avg(m::double/t) filter (p>0 and t>0) as rc from {src} {grp})"
)
CHRF_SQL = CHRF_RAW.replace("coalesce(100*5*pr*rc/nullif(4*pr+rc,0),0)", "round(coalesce(100*5*pr*rc/nullif(4*pr+rc,0),0),7)")


@R.add(
    "i8_chrf_row",
    v.with_sql(
        "select id, coalesce(chrf,0) as chrf from predictions left join r using (id)",
        "predictions",
        toks=toks_of(chars_of, "model_b"),
        grams=gram_counts("toks", 6, chars=True),
        r=CHRF_SQL.format(key="id,", src="grams", grp="group by id"),
    ),
)
def i8_row(spark, sf):
    return rounded(textmetrics.chrf(pairs(spark, sf), level="row").select("id", "chrf"), 7)


@R.add(
    "i8_chrf_corpus",
    v.with_sql(
        CHRF_SQL.format(
            key="",
            src="(select n, sum(m) as m, sum(case when t>0 then p else 0 end) as p, sum(t) as t from grams group by 1)",
            grp="",
        ),
        "predictions",
        toks=toks_of(chars_of, "model_b"),
        grams=gram_counts("toks", 6, chars=True),
    ),
)
def i8_corpus(spark, sf):
    return rounded(textmetrics.chrf(pairs(spark, sf)), 7)


# Longest common subsequences by the furthest reach on each diagonal after d skipped words: a third way,
# beside the operator's bit rows and the usual table.
REACH = (
    "{x}+coalesce(nullif(list_position(list_transform(range(1, least(len(p)-({x}),len(t)-({x})+({k}))+1),"
    " lambda i: p[({x})+i]<>t[({x})-({k})+i]), true),0)-1, least(len(p)-({x}),len(t)-({x})+({k})))"
)
ENDED = "bool_or(x>=len(p) and x-k>=len(t)) over (partition by id)"


def lcs_ctes(tokens: str) -> dict[str, str]:
    """``lcs``: id, hits and both lengths of ``tokens(id, p, t)``; common table expressions by name."""
    start = f"select id, 0 as d, 0::bigint as k, {REACH.format(x=0, k=0)} as x, len(p) as n, len(t) as m from {tokens}"
    step = (
        f"select id, d, k, {REACH.format(x='x', k='k')} as x, p, t from (select w.id, w.d+1 as d, w.k+g as k,"
        " max(w.x+(g=1)::int) as x from reach w, (select unnest([1,-1]) as g) where not w.ended"
        f" and w.x+(g=1)::int<=w.n and w.x+(g=1)::int-w.k-g<=w.m group by 1,2,3) join {tokens} using (id)"
    )
    return {
        "reach": f"select id, d, k, x, n, m, (x>=n and x>=m) as ended from ({start}) union all"
        f" select id, d, k, x, len(p), len(t), {ENDED} from ({step})",
        "lcs": "select id, (any_value(n)+any_value(m)-max(d))//2 as hits, any_value(n) as n, any_value(m) as m"
        " from reach group by 1",
    }


ROUGE_L = (
    "select id, coalesce(hits::double/nullif(n,0),0) as pr, coalesce(hits::double/nullif(m,0),0) as rc,"
    " coalesce(2.0*hits/nullif(n+m,0),0) as f from lcs"
)


@R.add(
    "i5_rouge_l",
    v.with_sql(
        "select round(avg(pr),9) as precision, round(avg(rc),9) as recall, round(avg(f),9) as fmeasure"
        f" from ({ROUGE_L})",
        "predictions",
        recursive=True,
        toks=toks_of(rouge_toks, "model_b"),
        **lcs_ctes("toks"),
    ),
)
def i5(spark, sf):
    return rounded(textmetrics.rouge_l(pairs(spark, sf)))


def documents_as_pairs(spark, sf):
    """Whole documents against themselves without their first line: several sentences per side."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    return (
        v.table(spark, sf, "documents")
        .select("doc_id", "text", lines.alias("l"))
        .select(
            F.col("doc_id").alias("id"),
            F.col("text").alias("target"),
            F.array_join(F.slice("l", F.lit(2), F.size("l") + 1), "\n").alias("prediction"),
        )
    )


@R.add("i6_rouge_lsum")
def i6(spark, sf):
    return rounded(textmetrics.rouge_lsum(documents_as_pairs(spark, sf)))


@R.add("i7_rouge1_stemmed")
def i7(spark, sf):
    return rounded(textmetrics.rouge_n(pairs(spark, sf), 1, stem=True))


@R.add("i7_rouge_l_stemmed")
def i7_l(spark, sf):
    return rounded(textmetrics.rouge_l(pairs(spark, sf), stem=True))


@R.add("i9_ter")
def i9(spark, sf):
    return rounded(textmetrics.ter(pairs(spark, sf), by=["split"]))


@R.add("i10_meteor")
def i10(spark, sf):
    return rounded(textmetrics.meteor(pairs(spark, sf), by=["split"]))


def token_vectors(spark, sf):
    """Ten vectors per example: even positions predict, odd ones are the reference."""
    pick = lambda odd: F.transform(
        F.array_sort(
            F.collect_list(F.when(F.col("vec_id") % 2 == odd, F.struct("vec_id", "embedding")))
        ),
        lambda x: x["embedding"],
    )
    return (
        v.table(spark, sf, "embeddings")
        .groupBy(F.expr("vec_id div 10").alias("id"))
        .agg(pick(0).alias("pred_vecs"), pick(1).alias("ref_vecs"))
    )


_COS = (
    "select p.vec_id//10 as id, p.vec_id as a, r.vec_id as b, list_cosine_similarity(p.embedding::double[],"
    " r.embedding::double[]) as s from embeddings p join embeddings r on p.vec_id//10=r.vec_id//10"
    " where p.vec_id%2=0 and r.vec_id%2=1"
)


@R.add(
    "i11_embedding_score",
    "select p.id, round(bp,6) as bert_precision, round(br,6) as bert_recall, round(2*bp*br/(bp+br),6) as bert_f1 from"
    f" (select id, avg(s) as bp from (select id, a, max(s) as s from ({_COS}) group by 1,2) group by 1) p join"
    f" (select id, avg(s) as br from (select id, b, max(s) as s from ({_COS}) group by 1,2) group by 1) r on p.id=r.id",
)
def i11(spark, sf):
    out = textmetrics.greedy_embedding_score(token_vectors(spark, sf), level="row")
    return rounded(out.drop("pred_vecs", "ref_vecs"), 6)


@R.add("i12_evaluate_total")
def i12(spark, sf):
    return rounded(textmetrics.evaluate_total(pairs(spark, sf, "model_a")))


@R.add("i12_evaluate_each")
def i12_each(spark, sf):
    return rounded(textmetrics.evaluate_each(pairs(spark, sf, "model_a"), keep=["id"]))


def row_grams_sql(model: str) -> dict[str, str]:
    """``rows``: id, BLEU and CHRF of every prediction of a model."""
    return {
        f"{model}_words": toks_of(LOWER_13A, model),
        f"{model}_chars": toks_of(chars_of, model),
        f"{model}_g": gram_counts(f"{model}_words", 4),
        f"{model}_c": gram_counts(f"{model}_chars", 6, chars=True),
        f"{model}_rows": "select id, target, "
        f"{model} as predicts, coalesce(bleu,0) as bleu, coalesce(chrf,0) as chrf from predictions left join ("
        + _ROW_BLEU.replace("grams g join toks", f"{model}_g g join {model}_words toks")
        + ") using (id) left join ("
        + CHRF_RAW.format(key="id,", src=f"{model}_c", grp="group by id")
        + ") using (id)",
    }


@R.add(
    "i12_ngram_totals",
    v.with_sql(
        'select (select round(bleu,7) from (select 100*exp(avg(ln(m::double/p)))*any_value(case when pl>=tl then 1 else'
        ' exp(1-tl/pl) end) as bleu from (select n, sum(m) as m, sum(p) as p from words_g group by 1), lens)) as "BLEU",'
        ' (select round(chrf,7) from (' + CHRF_RAW.format(
            key="", src="(select n, sum(m) as m, sum(case when t>0 then p else 0 end) as p, sum(t) as t from chars_g group by 1)", grp=""
        ) + ')) as "CHRF"',
        "predictions",
        toks=toks_of(LOWER_13A, "model_a"),
        words_g=gram_counts("toks", 4),
        lens=LENGTHS,
        chars=toks_of(chars_of, "model_a"),
        chars_g=gram_counts("chars", 6, chars=True),
    ),
)
def i12_ngrams(spark, sf):
    return rounded(textmetrics.evaluate_total(pairs(spark, sf, "model_a")).select("BLEU", "CHRF"), 7)


@R.add(
    "i12_ngram_each",
    v.with_sql(
        'select id, target as reference, predicts, round(bleu,7) as "BLEU", round(chrf,7) as "CHRF" from model_a_rows',
        "predictions",
        **row_grams_sql("model_a"),
    ),
)
def i12_ngram_each(spark, sf):
    each = textmetrics.evaluate_each(pairs(spark, sf, "model_a"), keep=["id"])
    return rounded(each.select("id", "reference", "predicts", "BLEU", "CHRF"), 7)


def split_bleu_sql(n: int) -> str:
    return (
        f"select split, round(case when min(m)=0 then 0 else exp(avg(ln(m::double/p)))*any_value(case when pl>tl then 1"
        f" else exp(1-tl/pl) end) end,9) as bleu{n} from (select split, n, sum(m) as m, sum(p) as p from words_g join"
        f" (select id, split from toks) using (id) where n<={n} group by 1,2) a join (select split, sum(len(p))::double as pl,"
        " sum(len(t))::double as tl from toks group by 1) b using (split) group by 1"
    )


# Every pair is one line, so the summary-level score is that of its longest common subsequence.
@R.add(
    "i13_text_metrics",
    v.with_sql(
        "select split, bleu1 as sacre_bleu1, bleu4 as sacre_bleu4, rouge1, rouge2, l as \"rougeL\", l as \"rougeLsum\""
        f" from ({split_bleu_sql(1)}) join ({split_bleu_sql(4)}) using (split) join (select split,"
        " round(avg(coalesce(f1,0)),9) as rouge1, round(avg(coalesce(f2,0)),9) as rouge2, round(avg(f),9) as l from"
        " predictions left join (select id, max(case when n=1 then 2.0*m/(p+t) end) as f1, max(case when n=2 then"
        f" 2.0*m/(p+t) end) as f2 from rouge_g group by 1) using (id) join ({ROUGE_L}) using (id) group by 1) using (split)",
        "predictions",
        recursive=True,
        toks=toks_of(t13a, "model_b", ", split"),
        words_g=gram_counts("toks", 4),
        rouge=toks_of(rouge_toks, "model_b"),
        rouge_g=gram_counts("rouge", 2),
        **lcs_ctes("rouge"),
    ),
)
def i13(spark, sf):
    return rounded(textmetrics.text_metrics(pairs(spark, sf)))


@R.add(
    "i14_ngram_models",
    v.with_sql(
        "select metric, round(a,7) as model_a, round(b,7) as model_b from (select 'BLEU' as metric,"
        " (select avg(bleu) from model_a_rows) as a, (select avg(bleu) from model_b_rows) as b union all select 'CHRF',"
        " (select avg(chrf) from model_a_rows), (select avg(chrf) from model_b_rows))",
        "predictions",
        **row_grams_sql("model_a"),
        **row_grams_sql("model_b"),
    ),
)
def i14_ngrams(spark, sf):
    models = textmetrics.compare_models(v.predictions(spark, sf), ["model_a", "model_b"], metrics=["BLEU", "CHRF"])
    return rounded(models, 7)


@R.add("i14_compare_models")
def i14(spark, sf):
    out = textmetrics.compare_models(
        v.predictions(spark, sf), ["model_a", "model_b"], metrics=["BLEU", "CHRF", "METEOR"]
    )
    return rounded(out)


# ---------------------------------------------------------------- J

TOP_SQL = (
    "select example_id, pos, label, list_transform(list_sort(list_transform(scores, lambda x, i:"
    " {'s':-x,'i':i-1}))[1:5], lambda z: z.i) as top from ranked"
)
SHIFTED = (
    "select example_id, top, lead(label) over (partition by example_id order by pos) as label from tops"
)


def _rank_sql(gain: str, name: str, source: str) -> str:
    return (
        f"select round(avg(v),9) as {name} from (select example_id, sum(case when label<>-100 then"
        f" {gain} else 0 end)/nullif(count(*) filter (label<>-100),0) as v from {source} where label is not null"
        " group by 1)"
    )


def ranked_top(spark, sf):
    return rankmetrics.with_top_k(v.ranked(spark, sf), 5).drop("scores")


for _k in (1, 5):

    @R.add(
        f"j1_accuracy_at_{_k}",
        v.with_sql(
            _rank_sql(f"list_contains(top[1:{_k}],label)::int::double", f"accuracy_{_k}", "shifted"),
            "ranked",
            tops=TOP_SQL,
            shifted=SHIFTED,
        ),
    )
    def j1(spark, sf, k=_k):
        checked = ranked_top(spark, sf)
        return rounded(rankmetrics.accuracy_at_k(checked, k, shift=True))


@R.add(
    "j2_mrr_at_5",
    v.with_sql(
        _rank_sql(
            "coalesce(1.0::double/nullif(list_position(top,label),0),0)", "mrr_5", "tops"
        ),
        "ranked",
        tops=TOP_SQL,
    ),
)
def j2(spark, sf):
    return rounded(rankmetrics.mrr_at_k(ranked_top(spark, sf), 5))


@R.add(
    "j2_mrr_at_5_shifted",
    v.with_sql(
        _rank_sql(
            "coalesce(1.0::double/nullif(list_position(top,label),0),0)", "mrr_5", "shifted"
        ),
        "ranked",
        tops=TOP_SQL,
        shifted=SHIFTED,
    ),
)
def j2_shifted(spark, sf):
    return rounded(rankmetrics.mrr_at_k(ranked_top(spark, sf), 5, shift=True))


@R.add(
    "j3_top_k_ids",
    v.with_sql(
        "select example_id, pos, array_to_string(top, ',') as top_ids from tops", "ranked", tops=TOP_SQL
    ),
)
def j3(spark, sf):
    return ranked_top(spark, sf).select(
        "example_id", "pos", F.array_join(F.col("top_ids").cast("array<string>"), ",").alias("top_ids")
    )


@R.add(
    "j4_check_ranked",
    v.with_sql("select count(*) as positions from ranked", "ranked"),
)
def j4(spark, sf):
    checked = rankmetrics.check_ranked(ranked_top(spark, sf), 5)
    return checked.agg(F.count("*").alias("positions"))
