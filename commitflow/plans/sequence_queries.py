"""Queries for tokenization and training sequences (K), unknown tokens (H10) and ingest (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import bpe, packing, sequences, spans, stats
from ..operators.changes import render_diff
from ..session import scratch_path
from ..streaming.ingest import ingest_responses_stream
from . import views as v
from .commit_queries import stored_responses
from .prompt_queries import toks
from .registry import Registry

R = Registry()

WORDS = "regexp_extract_all({}, '[^\\s]+')"
VOCAB_SIZE = 2000


def joined(df, *cols):
    """Arrays as comma-joined text, for a comparison that does not depend on array types."""
    for c in cols:
        df = df.withColumn(c, F.array_join(F.col(c).cast("array<string>"), ","))
    return df


def code(w):
    return (F.lit(5) + (F.length(w) * 131 + F.ascii(w)) % 2000).cast("int")


def coded(spark, sf):
    """Diff and message of every commit as word codes."""
    c = render_diff(v.commits(spark, sf))
    return c.select(
        "doc_id",
        F.floor(F.col("doc_id") / 16).alias("batch_id"),
        "message",
        F.transform(tx.words(F.col("diff")), code).alias("diff_ids"),
        F.transform(tx.words(F.col("message")), code).alias("msg_ids"),
    )


def _codes(x: str) -> str:
    return (
        f"list_transform({WORDS.format(x)}, lambda w: cast(5+(length(w)*131+ascii(w))%2000 as integer))"
    )


CODED = (
    f"select doc_id, doc_id//16 as batch_id, message, {_codes('diff')} as diff_ids, {_codes('message')} as msg_ids from rendered"
)


def sql(body: str, **extra: str) -> str:
    return v.with_sql(body, "rendered", coded=CODED, **extra)


def text(x: str) -> str:
    return f"array_to_string({x}, ',')"


def fill(value: int, n: str) -> str:
    return f"list_transform(range(0, {n}), lambda z: {value})"


@R.add(
    "k1_tokenize",
    f"select doc_id, cast(len({toks('text')}) as integer) as n_tokens, array_to_string({toks('text')}[:256],'|') as source from documents",
)
def k1(spark, sf):
    d = v.table(spark, sf, "documents")
    cut = sequences.tokenize(d, "text", max_tokens=256, name="source")
    return cut.select(
        "doc_id", tx.token_count(F.col("text")).alias("n_tokens"), F.array_join("source", "|").alias("source")
    )


@R.add(
    "k1_tokenize_padded",
    f"select doc_id, array_to_string(list_resize({toks('text')}[:256], 256, '<pad>'),'|') as source from documents",
)
def k1_padded(spark, sf):
    d = v.table(spark, sf, "documents")
    fixed = sequences.tokenize(d, "text", max_tokens=256, name="source", pad="<pad>")
    return fixed.select("doc_id", F.array_join("source", "|").alias("source"))


VOCAB = (
    "select word, cast(4+row_number() over (order by n desc, word) as integer) as id from (select word, count(*) as n from"
    f" (select unnest({WORDS.format('text')}) as word from documents) group by 1)"
)


def vocab(spark, sf, max_words=VOCAB_SIZE):
    d = v.table(spark, sf, "documents").select(tx.words(F.col("text")).alias("w"))
    return sequences.build_vocab(d, "w", max_words)


@R.add("k2_vocabulary", f"select * from ({VOCAB})")
def k2_vocab(spark, sf):
    return vocab(spark, sf, None)


ENCODED = (
    f"select doc_id, list(coalesce(id, 4) order by pos) as ids from (select doc_id, unnest(w) as word,"
    f" generate_subscripts(w,1) as pos from (select doc_id, {WORDS.format('text')} as w from documents))"
    f" left join (select * from ({VOCAB}) where id<{VOCAB_SIZE + 5}) using (word) group by 1"
)


@R.add("k2_encode", f"select doc_id, {text('ids')} as input_ids from ({ENCODED})")
def k2(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id", tx.words(F.col("text")).alias("w"))
    out = sequences.encode(d, "w", vocab(spark, sf))
    return joined(out.select("doc_id", "input_ids"), "input_ids")


@R.add(
    "e7_encode_joined",
    f"select doc_id, {text('ids')} as input_ids from ({ENCODED})",
)
def e7(spark, sf):
    """The way for vocabularies too large to send to every task."""
    d = v.table(spark, sf, "documents").select("doc_id", tx.words(F.col("text")).alias("w"))
    out = sequences.encode_joined(d, "w", vocab(spark, sf))
    return joined(out.select("doc_id", "input_ids"), "input_ids")


@R.add(
    "k3_decode",
    "select doc_id, string_agg(word, ' ' order by pos) as text from (select doc_id, unnest(w) as word,"
    f" generate_subscripts(w,1) as pos from (select doc_id, {WORDS.format('text')} as w from documents))"
    f" join (select * from ({VOCAB}) where id<{VOCAB_SIZE + 5}) using (word) group by 1",
)
def k3(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id", tx.words(F.col("text")).alias("w"))
    table = vocab(spark, sf)
    ids = sequences.encode(d, "w", table)
    labels = ids.withColumn("labels", F.concat("input_ids", F.array(F.lit(-100), F.lit(2))))
    out = sequences.decode(labels.select("doc_id", "labels"), "labels", table)
    # A text of unknown words only decodes to nothing.
    return out.filter("text <> ''").select("doc_id", "text")


@R.add(
    "k4_special_tokens",
    f"select task, role, case when role='bos' then 1 when role='eos' then 2 when role='unk' then 4 when task='clm' and role='pad' then 2"
    f" else n end as id from (select cast(5+count(*) as integer) as n from ({VOCAB})), (select unnest(['clm','mlm']) as task),"
    " (select unnest(['pad','bos','eos','sep','unk']) as role) where task='clm' or role<>'sep'",
)
def k4(spark, sf):
    last = vocab(spark, sf, None).agg(F.max("id")).first()[0]
    known = {"bos": 1, "eos": 2, "unk": 4}
    found = [(task, role, i) for task in ("clm", "mlm") for role, i in sequences.special_tokens(known, last + 1, task).items()]
    return spark.createDataFrame(found, "task string, role string, id int")


@R.add("k5_byte_pairs")
def k5(spark, sf):
    d = render_diff(v.commits(spark, sf)).select("doc_id", "diff", "message")
    table, merges = bpe.train_bpe(d, ["diff", "message"], vocab_size=3000)
    out = bpe.encode_fixed(d, "diff", table, merges, 100)
    out = bpe.encode_fixed(out, "message", table, merges, 100, name="target_ids")
    return joined(out.select("doc_id", "input_ids", "target_ids"), "input_ids", "target_ids")


@R.add(
    "k6_pad_inputs",
    sql(
        f"select doc_id, {text('list_concat(x, ' + fill(0, 'w-len(x)') + ')')} as input_ids,"
        f" {text('list_concat(' + fill(1, 'len(x)') + ', ' + fill(0, 'w-len(x)') + ')')} as attention_mask from"
        " (select *, max(len(x)) over (partition by batch_id) as w from (select doc_id, batch_id,"
        " list_concat([1], diff_ids[:510], [2]) as x from coded))"
    ),
)
def k6(spark, sf):
    c = coded(spark, sf).withColumnRenamed("diff_ids", "input_ids")
    out = sequences.pad_inputs(c, 512).select("doc_id", "input_ids", "attention_mask")
    return joined(out, "input_ids", "attention_mask")


@R.add(
    "g6_batch_width",
    sql("select batch_id, cast(max(len(diff_ids)) as integer) as width from coded group by 1"),
)
def g6(spark, sf):
    c = coded(spark, sf).withColumn("width", sequences.batch_width("diff_ids", "batch_id"))
    return c.select("batch_id", "width").distinct()


@R.add(
    "k7_completion_inputs",
    sql(
        f"select doc_id, {text('list_concat(diff_ids, [3], msg_ids[:n])')} as input_ids, {text('msg_ids[n+1:]')} as target_ids"
        " from (select *, cast(floor(len(msg_ids)*0.25) as integer) as n from coded)"
    ),
)
def k7(spark, sf):
    out = sequences.completion_inputs(coded(spark, sf), 0.25)
    return joined(out.select("doc_id", "input_ids", "target_ids"), "input_ids", "target_ids")


@R.add(
    "k8_decoder_labels",
    sql(
        f"select doc_id, {text('list_concat(s, ' + fill(0, 'w-len(s)') + ')')} as decoder_ids,"
        f" {text('list_concat(x, ' + fill(-100, 'w-len(x)') + ')')} as labels from (select *,"
        " max(len(x)) over (partition by batch_id) as w from (select doc_id, batch_id, list_concat([0,1], msg_ids[:62]) as s,"
        " list_concat([1], msg_ids[:62], [2]) as x from coded))"
    ),
)
def k8(spark, sf):
    out = sequences.decoder_labels(coded(spark, sf), 64, shift=True, start_id=0)
    return joined(out.select("doc_id", "decoder_ids", "labels"), "decoder_ids", "labels")


@R.add(
    "k9_completion_context",
    sql(
        "select doc_id, case when closed then c else array_to_string(ws[:len(ws)-1],' ') end as context,"
        " substring(t,n+1) as target, case when closed then '' when len(ws)>1 then ' '||ws[len(ws)]"
        " else coalesce(ws[1],'') end as prefix from (select *, regexp_matches(c,'\\s$') as closed,"
        " regexp_extract_all(c,'[^\\s]+') as ws from (select doc_id, t, n, substring(t,1,n) as c from (select doc_id, t,"
        " cast(floor(length(t)*0.5) as integer) as n from (select doc_id,"
        f" array_to_string({toks('message')}[:63],'') as t from coded))))"
    ),
)
def k9(spark, sf):
    out = sequences.completion_context(v.commits(spark, sf), 0.5, 64)
    return out.select("doc_id", "context", "target", "prefix")


@R.add(
    "k9_generation_inputs",
    sql(
        f"select doc_id, {text('list_concat(' + fill(0, 'w-len(x)') + ', x)')} as context_ids from (select *,"
        " max(len(x)) over (partition by batch_id) as w from (select doc_id, batch_id, list_concat([1], msg_ids[:63]) as x from coded))"
    ),
)
def k9_ids(spark, sf):
    c = coded(spark, sf).withColumn("context_ids", F.slice("msg_ids", 1, 63))
    return joined(sequences.generation_inputs(c).select("doc_id", "context_ids"), "context_ids")


@R.add(
    "k10_concat_diff_msg",
    sql(
        f"select doc_id, {text('list_concat(diff_ids[:511-len(m)], [3], m)')} as input_ids from (select *, msg_ids[:255] as m from coded)"
    ),
)
def k10(spark, sf):
    out = sequences.concat_diff_msg(coded(spark, sf), 512)
    return joined(out.select("doc_id", "input_ids"), "input_ids")


def _packed(order: str, tail: str) -> str:
    return (
        "select \"group\", block, array_to_string(list(t order by pos), ',') as input_ids from (select \"group\", t, pos, pos//512 as block"
        f" from (select \"group\", t, row_number() over (partition by \"group\" order by doc_id, k)-1 as pos from {order}))"
        f" group by 1,2 {tail}"
    )


@R.add(
    "k11_pack_clm",
    sql(
        _packed(
            "(select * from ent where not (k=0 and first))",
            "",
        ),
        ent='select doc_id, "group", first, unnest(x) as t, generate_subscripts(x,1)-1 as k from (select doc_id, (rn-1)//100 as "group",'
        " (rn-1)%100=0 as first, list_concat([2], diff_ids, [3], msg_ids) as x from (select *, row_number() over (order by doc_id) as rn from coded))",
    ),
)
def k11(spark, sf):
    c = coded(spark, sf).select(
        "doc_id", F.concat("diff_ids", F.array(F.lit(3)), "msg_ids").alias("input_ids")
    )
    groups = packing.map_groups(c, 100, "doc_id")
    out = packing.pack_sequences(groups, 512, "doc_id", group="group", eos=2)
    return joined(out, "input_ids")


@R.add(
    "k12_pack_mlm",
    sql(
        _packed("ent", "having count(*)=512"),
        ent='select doc_id, 0 as "group", unnest(diff_ids) as t, generate_subscripts(diff_ids,1) as k from coded',
    ),
)
def k12(spark, sf):
    out = packing.pack_sequences(coded(spark, sf), 512, "doc_id", ids="diff_ids", keep_tail=False)
    return joined(out, "input_ids")


@R.add(
    "k13_span_lengths",
    sql(
        "select doc_id, cast(len(diff_ids)//raw as integer) as blocks, cast(raw as integer) as raw, cast(round(raw*0.15)"
        "+round(round(raw*0.15)/3)+1 as integer) as target from coded, (select max(r) as raw from range(512, 2000) t(r)"
        " where r-round(r*0.15)+round(round(r*0.15)/3)+1<=512)"
    ),
)
def k13(spark, sf):
    raw, target = spans.span_lengths(512, 0.15, 3.0)
    blocks = F.floor(F.size("diff_ids") / raw).cast("int")
    return coded(spark, sf).select("doc_id", blocks.alias("blocks"), F.lit(raw).alias("raw"), F.lit(target).alias("target"))


@R.add(
    "k14_span_mask",
    sql(
        "select doc_id, cast(len(diff_ids) as integer) as n, cast(case when len(diff_ids)<2 then 0 else"
        " least(greatest(round_even(len(diff_ids)*cast(0.15 as double), 0), 1), len(diff_ids)-1) end as integer) as noise from coded"
    ),
)
def k14(spark, sf):
    c = coded(spark, sf).select("doc_id", F.col("diff_ids").alias("input_ids"))
    out = spans.span_mask(c, 0.15, 3.0, seed=5, id_cols=["doc_id"])
    ones = F.size(F.filter("mask", lambda m: m))
    return out.select("doc_id", F.size("mask").alias("n"), ones.alias("noise"))


@R.add(
    "k15_corrupt_spans",
    sql(
        f"select doc_id, {text('inp')} as input_ids, {text('lab')} as labels from (select doc_id,"
        + ", ".join(
            f"list_append(list_filter(list_transform(diff_ids, lambda x, i: case when {keep} then x when {start} then"
            f" 32100-({rank}) end), lambda y: y is not null), 2) as {name}"
            for name, keep, start, rank in (
                ("inp", "(i-1)%9<7", "(i-1)%9=7", "(i-8)//9+1"),
                ("lab", "(i-1)%9>=7", "(i-1)%9=0", "(i-1)//9+1"),
            )
        )
        + " from coded)"
    ),
)
def k15(spark, sf):
    c = coded(spark, sf).select("doc_id", F.col("diff_ids").alias("input_ids"))
    masked = c.withColumn("mask", F.transform("input_ids", lambda x, i: i % 9 >= 7))
    out = spans.corrupt_spans(masked, 32100, 2)
    return joined(out.select("doc_id", "input_ids", "labels"), "input_ids", "labels")


@R.add("k14_k15_span_corruption")
def k14_k15(spark, sf):
    """Packed blocks, masked and corrupted to fixed lengths."""
    raw, target = spans.span_lengths(512, 0.15, 3.0)
    blocks = packing.pack_sequences(
        coded(spark, sf), raw, "doc_id", ids="diff_ids", keep_tail=False
    )
    masked = spans.span_mask(blocks, 0.15, 3.0, seed=5, id_cols=["group", "block"])
    out = spans.corrupt_spans(masked, 32100, 2, input_len=512, target_len=target)
    return joined(out.drop("mask"), "input_ids", "labels")


@R.add(
    "k16_collate_clm",
    sql(
        f"select doc_id, {text('list_concat(x, ' + fill(2, 'w-len(x)') + ')')} as input_ids,"
        f" {text('list_concat(list_transform(x, lambda z: case when z=2 then -100 else z end), ' + fill(-100, 'w-len(x)') + ')')} as labels"
        " from (select *, max(len(x)) over (partition by batch_id) as w from (select doc_id, batch_id, list_concat(msg_ids, [2]) as x from coded))"
    ),
)
def k16(spark, sf):
    c = coded(spark, sf).withColumn("input_ids", F.concat("msg_ids", F.array(F.lit(2))))
    out = sequences.collate_clm(c).select("doc_id", "input_ids", "labels")
    return joined(out, "input_ids", "labels")


@R.add(
    "k17_collate_seq2seq",
    sql(
        f"select doc_id, {text('list_concat(diff_ids, ' + fill(0, 'w-len(diff_ids)') + ')')} as input_ids,"
        f" {text('list_concat(msg_ids, ' + fill(-100, 'wl-len(msg_ids)') + ')')} as labels from (select *,"
        " cast(ceil(max(len(diff_ids)) over (partition by batch_id)/8.0)*8 as bigint) as w,"
        " cast(ceil(max(len(msg_ids)) over (partition by batch_id)/8.0)*8 as bigint) as wl from coded)"
    ),
)
def k17(spark, sf):
    c = coded(spark, sf).withColumnsRenamed({"diff_ids": "input_ids", "msg_ids": "labels"})
    out = sequences.collate_seq2seq(c, multiple=8).select("doc_id", "input_ids", "labels")
    return joined(out, "input_ids", "labels")


@R.add("k18_crop_context", sql(f"select doc_id, {text('msg_ids')} as prediction_ids from coded"))
def k18(spark, sf):
    c = coded(spark, sf).withColumnRenamed("diff_ids", "input_ids")
    generated = c.withColumn("prediction_ids", F.concat("input_ids", "msg_ids"))
    out = sequences.crop_context(generated).select("doc_id", "prediction_ids")
    return joined(out, "prediction_ids")


@R.add(
    "k19_processed_tokens",
    sql("select cast(sum(least(len(diff_ids),510)+2) as bigint) as num_tokens from coded"),
)
def k19(spark, sf):
    c = coded(spark, sf).withColumnRenamed("diff_ids", "input_ids")
    return sequences.processed_tokens(sequences.pad_inputs(c, 512))


UNK_PART = (
    "select '{f}' as field, least(count(*),510) as n, count(*) filter (id is null and pos<=510) as u from (select doc_id,"
    " unnest(w) as word, generate_subscripts(w,1) as pos from (select doc_id, " + WORDS.format("{f}") + " as w from rendered))"
    " left join top using (word) group by doc_id"
)


@R.add(
    "h10_unknown_tokens",
    v.with_sql(
        "select field, cast(sum(n) as bigint) as total_tokens, cast(sum(u) as bigint) as unknown_tokens,"
        " round_even(sum(u)::double/sum(n)*100,2) as unk_percentage from ("
        + UNK_PART.format(f="message")
        + " union all "
        + UNK_PART.format(f="diff")
        + ") group by 1",
        "rendered",
        top=f"select * from ({VOCAB}) where id<{VOCAB_SIZE + 5}",
    ),
)
def h10(spark, sf):
    c = render_diff(v.commits(spark, sf)).select(
        "doc_id", tx.words(F.col("message")).alias("m"), tx.words(F.col("diff")).alias("d")
    )
    table = vocab(spark, sf)
    for words_col, name in (("m", "message"), ("d", "diff")):
        c = sequences.encode(c, words_col, table, name=name)
    return stats.unk_stats(c, ["message", "diff"], sequences.UNK, 512)


@R.add("l1_ingest", v.with_sql("select custom_id, content from responses", "responses"))
def l1(spark, sf):
    source = stored_responses(spark, sf)
    target, mark = scratch_path(spark, "ingested"), scratch_path(spark, "ingest-checkpoint")
    ingest_responses_stream(spark, source, target, mark)
    # Running it again finds nothing new.
    return ingest_responses_stream(spark, source, target, mark).select("custom_id", "content")
