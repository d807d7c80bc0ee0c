"""Queries for corpus and result statistics (G3, G4, E4, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes, filters, merge, rows, stats
from . import views as v
from .registry import Registry

R = Registry()

STOPWORDS = ("the", "of", "and", "to", "in", "is", "it", "der", "die", "und", "la", "le", "de", "el")
STOP_SQL = ", ".join(f"'{w}'" for w in STOPWORDS)

FIRST_WORDS = (
    "select id, split, case when t in ('fixing','fixup') then 'fix' else t end as t,"
    " case when a in ('fixing','fixup') then 'fix' else a end as a,"
    " case when b in ('fixing','fixup') then 'fix' else b end as b from (select id, split,"
    " nullif(lower(regexp_extract(target,'^[\\p{L}\\p{N}_]+')),'') as t,"
    " nullif(lower(regexp_extract(model_a,'^[\\p{L}\\p{N}_]+')),'') as a,"
    " nullif(lower(regexp_extract(model_b,'^[\\p{L}\\p{N}_]+')),'') as b from predictions)"
)


def words_sql(source: str, col: str = "message", key: str = "doc_id") -> str:
    """word, n, first (key, pos) of the plain words of a text column."""
    return (
        f"select word, count(*) as n, min({key}*16777216+pos-1) as first_seen from (select {key},"
        f" unnest(w) as word, generate_subscripts(w,1) as pos from (select {key},"
        " regexp_extract_all(lower(regexp_replace(" + col + ", '[[:punct:]]', '', 'g')), '[^\\s]+')"
        f" as w from {source})) group by 1"
    )


def numbered(counts):
    """``first_seen`` as the whole number that the twin computes."""
    row, pos = stats.seen_at(F.col("first_seen"))
    return counts.withColumn("first_seen", row * (1 << 24) + pos)


@R.add(
    "h1_first_word",
    v.with_sql("select id, t as first_word from fw", "predictions", fw=FIRST_WORDS),
)
def h1(spark, sf):
    from ..functions.text import first_word

    return v.predictions(spark, sf).select("id", first_word(F.col("target")).alias("first_word"))


@R.add(
    "h2_first_word_accuracy",
    v.with_sql(
        "select t as first_word, round(avg(case when t is not distinct from b then 1 else 0 end),9)"
        " as accuracy from fw group by 1",
        "predictions",
        fw=FIRST_WORDS,
    ),
)
def h2(spark, sf):
    out = stats.first_word_accuracy(v.predictions(spark, sf), "model_b")
    return out.withColumn("accuracy", F.round("accuracy", 9))


@R.add(
    "h3_first_word_confusion",
    v.with_sql(
        "select t as first_word, b as predicted, count(*) as n, min(id) as first_seen from fw group by 1,2",
        "predictions",
        fw=FIRST_WORDS,
    ),
)
def h3(spark, sf):
    return stats.first_word_confusion(v.predictions(spark, sf), "model_b", "id")


@R.add(
    "e4_combine_by_group",
    v.with_sql(
        "select t as first_word, round(avg(case when t is not distinct from a then 1 else 0 end),9) as model_a,"
        " round(avg(case when t is not distinct from b then 1 else 0 end),9) as model_b from fw group by 1",
        "predictions",
        fw=FIRST_WORDS,
    ),
)
def e4(spark, sf):
    p = v.predictions(spark, sf)
    parts = {m: stats.first_word_accuracy(p, m) for m in ("model_a", "model_b")}
    out = merge.combine_by_group(parts, "first_word", "accuracy")
    return out.withColumns({m: F.round(m, 9) for m in parts})


@R.add(
    "h4_change_types",
    v.with_sql(
        "select m.change_type as change_type, count(*) as n from (select unnest(mods) as m from commits) group by 1",
        "commits",
    ),
)
def h4(spark, sf):
    return stats.change_type_counts(v.commits(spark, sf))


@R.add("h5_word_counts", v.with_sql("select * from x", "commits", x=words_sql("commits")))
def h5(spark, sf):
    return numbered(stats.word_counts(v.commits(spark, sf), "message", "doc_id"))


@R.add(
    "h5_word_counts_text",
    v.with_sql("select word, n from x", x=words_sql("documents", "text")),
)
def h5_text(spark, sf):
    d = v.table(spark, sf, "documents")
    return stats.word_counts(d, "text", "doc_id").select("word", "n")


@R.add(
    "h6_word_counts_stop",
    v.with_sql(f"select * from x where word not in ({STOP_SQL})", "rendered", x=words_sql("rendered", "diff")),
)
def h6(spark, sf):
    whole = changes.render_diff(v.commits(spark, sf))
    return numbered(stats.word_counts(whole, "diff", "doc_id", STOPWORDS))


def _top_sql(source: str, label: str, k: int = 20) -> str:
    return (
        f"select word, n, '{label}' as dataset from (select * from ({words_sql(source, 'diff')})"
        f" where word not in ({STOP_SQL}) order by n desc, first_seen limit {k})"
    )


ADD_ONLY = "select * from rendered where len(list_filter(mods, lambda m: m.change_type<>'ADD'))=0"
MODIFY_ONLY = "select * from rendered where len(list_filter(mods, lambda m: m.change_type<>'MODIFY'))=0"


@R.add(
    "h7_top_words",
    v.with_sql(
        " union all ".join(
            [_top_sql("rendered", "all"), _top_sql("adds", "add"), _top_sql("modifies", "modify")]
        ),
        "rendered",
        adds=ADD_ONLY,
        modifies=MODIFY_ONLY,
    ),
)
def h7(spark, sf):
    c = changes.render_diff(v.commits(spark, sf))
    subsets = {
        "all": c,
        "add": filters.only_change_type(c, "ADD"),
        "modify": filters.only_change_type(c, "MODIFY"),
    }
    return stats.compare_top_words(subsets, 20, "diff", "doc_id", STOPWORDS)


@R.add(
    "g3_top_per_group",
    v.with_sql(
        "select first_word, predicted, n, first_seen, rank from (select *, cast(row_number() over (partition by first_word"
        " order by n desc, first_seen) as integer) as rank from (select t as first_word, b as predicted,"
        " count(*) as n, min(id) as first_seen from fw group by 1,2)) where rank<=10",
        "predictions",
        fw=FIRST_WORDS,
    ),
)
def g3(spark, sf):
    counts = stats.first_word_confusion(v.predictions(spark, sf), "model_b", "id")
    return rows.top_k(counts, 10, by=["first_word"])


@R.add(
    "g4_sorted",
    v.with_sql(
        "select t as first_word, count(*) as n from fw group by 1 order by 1 nulls first",
        "predictions",
        fw=FIRST_WORDS,
    ),
)
def g4(spark, sf):
    from ..functions.text import first_word

    p = v.predictions(spark, sf).select(first_word(F.col("target")).alias("first_word"))
    return rows.sort_by(p.groupBy("first_word").agg(F.count("*").alias("n")), "first_word")


@R.add(
    "h8_kl_divergence",
    v.with_sql(
        "select round(sum(p*ln(p/q)),6) as kl_ab, round(sum(q*ln(q/p)),6) as kl_ba from"
        " (select x/sum(x) over () as p, y/sum(y) over () as q from (select coalesce(a.n,0)+1e-10::double as x,"
        " coalesce(b.n,0)+1e-10::double as y from (select * from a) a full join (select * from b) b using (word)))",
        "rendered",
        adds=ADD_ONLY,
        a=words_sql("rendered", "diff"),
        b=words_sql("adds", "diff"),
    ),
)
def h8(spark, sf):
    c = changes.render_diff(v.commits(spark, sf))
    every = stats.word_counts(c, "diff", "doc_id")
    adds = stats.word_counts(filters.only_change_type(c, "ADD"), "diff", "doc_id")
    out = stats.kl_divergence(every, adds)
    return out.select(*[F.round(x, 6).alias(x) for x in ("kl_ab", "kl_ba")])


@R.add(
    "h9_length_stats",
    v.with_sql(
        "select field, round_even(avg(n),2) as mean, cast(min(n) as integer) as min, cast(max(n) as integer)"
        " as max, round_even(quantile_cont(n,0.5),2) as median from (select 'message' as field,"
        " length(message) as n from rendered union all select 'diff', length(diff) from rendered) group by 1",
        "rendered",
    ),
)
def h9(spark, sf):
    return stats.length_stats(changes.render_diff(v.commits(spark, sf)))


SCORES = ("tiny_score", "baseline_score")


@R.add(
    "h11_mean_scores",
    v.with_sql(
        "select cast(sum(tiny_score) as bigint) as tiny_score_sum, cast(sum(baseline_score) as bigint) as baseline_score_sum,"
        " round(avg(tiny_score),9) as tiny_score_mean, round(avg(baseline_score),9) as baseline_score_mean from judge_results",
        "judge_results",
    ),
)
def h11(spark, sf):
    out = stats.mean_scores(v.judge_results(spark, sf), SCORES)
    return out.withColumns({f"{c}_mean": F.round(f"{c}_mean", 9) for c in SCORES})


@R.add(
    "h12_judge_averages",
    v.with_sql(
        "select round(avg(tiny_score),9) as tiny_average, round(avg(baseline_score),9) as baseline_average,"
        " count(*) as sample_count from judge_results where doc_id%17<>0",
        "judge_results",
    ),
)
def h12(spark, sf):
    from ..operators.completion import parse_scores
    from .prompt_queries import stored_answers

    parsed = parse_scores(stored_answers(spark, sf), "tiny_score int, baseline_score int")
    out = stats.judge_averages(parsed)
    return out.withColumns({c: F.round(c, 9) for c in ("tiny_average", "baseline_average")})


def scored(spark, sf):
    return stats.score_difference(v.judge_results(spark, sf))


DIFFED = "select *, tiny_score-baseline_score as score_difference, length(input) as diff_length from judge_results"
LONG = " union all ".join(
    f"select '{c}' as field, {c}::double as x from diffed" for c in (*SCORES, "score_difference")
)


@R.add(
    "h13_describe",
    v.with_sql(
        "select field, count(x) as count, round(avg(x),9) as mean, round(stddev_samp(x),9) as std, min(x) as min,"
        " quantile_cont(x,0.25) as q25, quantile_cont(x,0.5) as q50, quantile_cont(x,0.75) as q75, max(x) as max"
        f" from ({LONG}) group by 1",
        "judge_results",
        diffed=DIFFED,
    ),
)
def h13(spark, sf):
    out = stats.describe(scored(spark, sf), [*SCORES, "score_difference"])
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "std")})


EDGES = ", ".join(f"quantile_cont(diff_length,{i / 5}) as e{i}" for i in range(1, 5))
CASE = (
    "case when diff_length<=e1 then 'Very Short' when diff_length<=e2 then 'Short' when diff_length<=e3"
    " then 'Medium' when diff_length<=e4 then 'Long' else 'Very Long' end"
)


@R.add(
    "h14_binned_stats",
    v.with_sql(
        f"select {CASE} as bin, "
        + ", ".join(
            f"round_even(avg({c}),3) as {c}_mean, round_even(stddev_samp({c}),3) as {c}_std, count({c}) as {c}_count"
            for c in SCORES
        )
        + ", round_even(avg(score_difference),3) as score_difference_mean from diffed, edges group by 1",
        "judge_results",
        diffed=DIFFED,
        edges=f"select {EDGES} from diffed",
    ),
)
def h14(spark, sf):
    df = changes.with_length(scored(spark, sf), "input", "diff_length")
    return stats.binned_stats(
        stats.quantile_bins(df, "diff_length"), "bin", SCORES, ["score_difference"]
    )


@R.add(
    "h15_correlations",
    v.with_sql(
        "select round(corr(diff_length,tiny_score),9) as tiny_score, round(corr(diff_length,baseline_score),9)"
        " as baseline_score from diffed",
        "judge_results",
        diffed=DIFFED,
    ),
)
def h15(spark, sf):
    df = changes.with_length(scored(spark, sf), "input", "diff_length")
    out = stats.correlations(df, "diff_length", SCORES)
    return out.select(*[F.round(c, 9).alias(c) for c in SCORES])


@R.add(
    "h16_win_rates",
    v.with_sql(
        "select "
        + ", ".join(
            f"round(avg(case when score_difference{op}0 then 1 else 0 end)*100,9) as {n}"
            for op, n in ((">", "tiny_wins"), ("<", "baseline_wins"), ("=", "ties"))
        )
        + " from diffed",
        "judge_results",
        diffed=DIFFED,
    ),
)
def h16(spark, sf):
    out = stats.win_rates(scored(spark, sf))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@R.add(
    "h17_melt",
    v.with_sql(
        "select 'tiny_score' as model, tiny_score as score from judge_results union all"
        " select 'baseline_score', baseline_score from judge_results",
        "judge_results",
    ),
)
def h17(spark, sf):
    return stats.melt_scores(v.judge_results(spark, sf), SCORES)


@R.add(
    "h18_histogram",
    v.with_sql(
        "select cast(b.bin as integer) as bin, lo+b.bin*w as lower, lo+(b.bin+1)*w as upper, count(x.bin) as n from"
        " (select unnest(range(10)) as bin) b cross join r left join (select least(floor((score_difference-lo)/w),9)"
        " as bin from diffed, r) x on x.bin=b.bin group by b.bin, lo, w",
        "judge_results",
        diffed=DIFFED,
        r="select min(score_difference)::double as lo, (max(score_difference)-min(score_difference))/10::double as w from diffed",
    ),
)
def h18(spark, sf):
    return stats.histogram(scored(spark, sf), "score_difference", 10)


@R.add(
    "h18_box",
    v.with_sql(
        "select field as model, min(x) as min, quantile_cont(x,0.25) as q25, quantile_cont(x,0.5) as q50,"
        f" quantile_cont(x,0.75) as q75, max(x) as max from ({LONG}) where field<>'score_difference' group by 1",
        "judge_results",
        diffed=DIFFED,
    ),
)
def h18_box(spark, sf):
    return stats.box_summary(v.judge_results(spark, sf), SCORES)


@R.add(
    "h19_score_difference",
    v.with_sql("select doc_id, score_difference from diffed", "judge_results", diffed=DIFFED),
)
def h19(spark, sf):
    return scored(spark, sf).select("doc_id", "score_difference")
