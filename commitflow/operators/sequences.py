"""Training sequences: vocabulary, encoding, padding, labels and cropping (section K)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..functions import text as tx
from ..session import shared_dir
from .rows import take_first, with_row_index

# Fixed value: label positions that are not scored.
IGNORED = -100
# Reserved ids of a word vocabulary.
SPECIALS = {"<pad>": 0, "<s>": 1, "</s>": 2, "<sep>": 3, "<unk>": 4}
PAD, BOS, EOS, SEP, UNK = range(5)
# A vocabulary above this many entries or bytes is joined instead of sent to every task.
MAX_BROADCAST_WORDS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20
# Counters of the heavy-hitter sketch for every shuffle partition, and their number's bounds.
COUNTERS = 8
LEAST_COUNTERS, MOST_COUNTERS = 10_000, 1_000_000


def tokenize(
    df: DataFrame,
    col: str,
    scheme: str = "pieces",
    max_tokens: int | None = None,
    name: str = "tokens",
    pad: str | None = None,
) -> DataFrame:
    """K1: tokens of a column, cut to ``max_tokens`` and, where ``pad`` is given, filled up to it."""
    toks = tx.tokens(F.col(col), scheme)
    if max_tokens is not None:
        toks = tx.take(toks, max_tokens)
        if pad is not None:
            toks = F.concat(toks, F.array_repeat(F.lit(pad), F.lit(max_tokens) - F.size(toks)))
    elif pad is not None:
        raise ValueError("padding needs max_tokens")
    return df.withColumn(name, toks)


def build_vocab(df: DataFrame, tokens_col: str, max_words: int | None = None) -> DataFrame:
    """``word, id`` by falling frequency; ids below ``len(SPECIALS)`` stay reserved."""
    counts = (
        df.select(F.explode(tokens_col).alias("word"))
        .groupBy("word")
        .agg((-F.count("*")).alias("__rank"))
    )
    # The counts are read several times below; the corpus is read once.
    shared_dir(df.sparkSession)
    counts = counts.checkpoint()
    if max_words is not None:
        counts = take_first(counts, max_words, ["__rank", "word"])
    indexed = with_row_index(counts, ["__rank", "word"], "__i")
    # Ranked once, however often it is looked up.
    return indexed.select("word", (F.col("__i") + len(SPECIALS)).cast("int").alias("id")).checkpoint()


def special_tokens(specials: dict[str, int | None], next_id: int, task: str) -> dict[str, int | None]:
    """K4: ``specials`` maps roles (pad, bos, eos, sep, unk) to ids; missing roles are added.

    For ``clm`` padding is the end token, and a separator equal to it is replaced.
    """
    out = dict(specials)
    if task == "clm":
        out["pad"] = out.get("eos")
        if out.get("sep") is None or out["sep"] == out["eos"]:
            out["sep"] = next_id
    elif out.get("pad") is None:
        out["pad"] = next_id
    return out


# Entries that a worker looks up at a time.
ENTRIES = 1 << 20
# Entries whose distinct values are joined together.
BLOCK = 1 << 18
# A worker's dictionaries by name: built once, then used for every batch.
_tables: dict[str, dict] = {}


def _lookup_shared(
    df: DataFrame, array_col: str, table: DataFrame, key: str, value: str, default, kind: str
) -> Column:
    pairs = table.select(key, value).toArrow().combine_chunks()
    shared = df.sparkSession.sparkContext.broadcast(tuple(pairs.column(c).combine_chunks() for c in (key, value)))
    name = uuid.uuid4().hex
    value_type = pairs.schema.field(value).type

    @F.arrow_udf(f"array<{kind}>")
    def look(arrays: pa.Array) -> pa.Array:
        if name not in _tables:
            _tables.clear()
            _tables[name] = dict(zip(*(c.to_pylist() for c in shared.value)))
        known = _tables[name]
        starts = arrays.offsets.to_numpy() - arrays.offsets[0].as_py()
        entries, parts = arrays.flatten(), []
        # Numbers of the entries are held of a part only.
        for at in range(0, max(len(entries), 1), ENTRIES):
            coded = entries.slice(at, ENTRIES).dictionary_encode()
            found = pa.array([known.get(k, default) for k in coded.dictionary.to_pylist()], value_type)
            parts.append(pc.fill_null(pc.take(found, coded.indices), default))
        out = pa.concat_arrays(parts)
        del entries, parts, coded, found
        # Workers are used again by later batches and stages: they give back what this one took.
        pa.default_memory_pool().release_unused()
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), out)

    looked = look(F.coalesce(F.col(array_col), F.array()))
    return F.when(F.col(array_col).isNotNull(), looked)


def heavy_entries(entries: DataFrame, key: str, parts: int) -> DataFrame:
    """``key, __parts`` of the values that hold more than one in ``parts`` of all entries.

    One pass of a frequent-items sketch finds them: there are fewer than ``parts``, and ``__parts``
    is how many shares of that size a value's entries fill, so all of them add up to twice ``parts``.
    """
    tracked = min(MOST_COUNTERS, max(LEAST_COUNTERS, COUNTERS * parts))
    seen = entries.agg(
        F.count(key).alias("n"), F.expr(f"approx_top_k({key}, {min(parts, tracked)}, {tracked})").alias("top")
    )
    share = F.ceil(F.col("t.count") * parts / F.col("n")).cast("int")
    heavy = seen.select("n", F.explode("top").alias("t")).select(F.col("t.item").alias(key), share.alias("__parts"))
    return heavy.where(f"{key} is not null and __parts > 1").checkpoint()


def lookup_joined(
    df: DataFrame,
    array_col: str,
    table: DataFrame,
    key: str,
    value: str,
    default,
    kind: str,
    name: str,
) -> DataFrame:
    """Replace array entries by a join. Rows are put into blocks of bounded size, and only the distinct entries of a
    block are exploded with their position and joined; a block's answers are put together again beside its rows.
    The entries of frequent values are dealt into as many parts as their share asks for, and only those
    rows of the table are copied.

    Blocks are numbered and written first, so repeated and null ids of any column play no part.
    """
    shared_dir(df.sparkSession)
    blocks = _blocks(df, array_col).withColumn("__block", F.monotonically_increasing_id()).checkpoint()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = blocks.select("__block", F.posexplode("__keys").alias("__pos", "__k"))
    heavy = F.broadcast(heavy_entries(entries, "__k", parts))
    salt = F.pmod(F.xxhash64("__block", "__pos"), F.coalesce("__parts", F.lit(1)))
    entries = entries.join(heavy, "__k", "left").select("__block", "__pos", "__k", salt.alias("__salt"))
    copies = F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1).cast("array<bigint>")
    known = table.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    salted = known.join(heavy, "__k", "left").select("__k", "__v", F.explode(copies).alias("__salt"))
    entry = F.struct("__pos", F.coalesce("__v", F.lit(default)).alias("v"))
    found = (
        entries.join(salted, ["__k", "__salt"], "left")
        .groupBy("__block")
        .agg(F.array_sort(F.collect_list(entry)).alias("__a"))
    )
    answered = blocks.join(found, "__block", "left").withColumn("__v", F.transform("__a", lambda z: z["v"]))

    def filled(codes: Column) -> Column:
        one = F.transform(codes, lambda c: F.coalesce(F.get("__v", c), F.lit(default)))
        # A key that the table repeats gives all its values; null entries match nothing.
        of = lambda c: F.transform(F.filter("__a", lambda z: z["__pos"] == c), lambda z: z["v"])
        every = F.flatten(F.transform(codes, lambda c: F.when(c < 0, F.array(F.lit(default))).otherwise(of(c))))
        return F.when(F.size("__a") != F.size("__keys"), every).otherwise(one).cast(f"array<{kind}>")

    def row(r: Column) -> Column:
        fields = {c: r[f"c{i}"] for i, c in enumerate(df.columns) if c != array_col}
        fields[array_col] = F.transform(r["codes"], lambda c: F.get("__keys", c))
        fields[name] = filled(r["codes"])
        order = [*df.columns, *([] if name in df.columns else [name])]
        return F.struct(*[fields[c].alias(c) for c in order])

    return answered.select(F.inline(F.transform("__rows", row)))


def _blocks(df: DataFrame, array_col: str) -> DataFrame:
    """``__keys``: the distinct entries of about ``BLOCK`` entries of an array column; ``__rows``: the rows that hold
    them, with fields ``c0, c1...`` for the other columns and ``codes``, each entry's place in ``__keys`` (-1 for null)."""
    at = df.columns.index(array_col)
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema) if i != at]
    schema = T.StructType(
        [
            T.StructField("__keys", T.ArrayType(df.schema[array_col].dataType.elementType)),
            T.StructField("__rows", T.ArrayType(T.StructType([*fields, T.StructField("codes", T.ArrayType(T.IntegerType()))]))),
        ]
    )
    names = [*(f.name for f in fields), "codes"]

    def block(rows: pa.RecordBatch) -> pa.RecordBatch:
        lists = rows.column(at)
        coded = lists.flatten().dictionary_encode()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        starts = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        codes = pc.fill_null(coded.indices.cast(pa.int32()), -1)
        nested = pa.StructArray.from_arrays(
            [
                *(c for i, c in enumerate(rows.columns) if i != at),
                pa.ListArray.from_arrays(starts, codes, mask=lists.is_null()),
            ],
            names=names,
        )
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays([one(coded.dictionary), one(nested)], ["__keys", "__rows"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // BLOCK)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)]):
                if b > a:
                    yield block(batch.slice(a, b - a))
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(cut, schema)


def _lookup(
    df: DataFrame,
    array_col: str,
    table: DataFrame,
    key: str,
    value: str,
    default,
    kind: str,
    name: str,
) -> DataFrame:
    """A table of checked size goes to every task as a dictionary, a larger one is joined; both
    give the same rows."""
    size = table.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col(key).cast("string"))), F.lit(0)).alias("bytes")
    ).first()
    if size["n"] > MAX_BROADCAST_WORDS or size["bytes"] > MAX_BROADCAST_BYTES:
        return lookup_joined(df, array_col, table, key, value, default, kind, name)
    return df.withColumn(name, _lookup_shared(df, array_col, table, key, value, default, kind))


def encode(
    df: DataFrame,
    tokens_col: str,
    vocab: DataFrame,
    max_len: int | None = None,
    name: str = "input_ids",
    unk: int = UNK,
) -> DataFrame:
    """K2: token ids, unknown words as ``unk``, cut to ``max_len``."""
    if max_len is not None:
        df = df.withColumn(tokens_col, tx.take(F.col(tokens_col), max_len))
    return _lookup(df, tokens_col, vocab, "word", "id", unk, "int", name)


def encode_joined(
    df: DataFrame,
    tokens_col: str,
    vocab: DataFrame,
    name: str = "input_ids",
    unk: int = UNK,
) -> DataFrame:
    """K2 by a join, for vocabularies of any size."""
    return lookup_joined(df, tokens_col, vocab, "word", "id", unk, "int", name)


def decode(
    df: DataFrame,
    ids_col: str,
    vocab: DataFrame,
    name: str = "text",
    glue: str = " ",
    specials: Sequence[int] = tuple(SPECIALS.values()),
    pad: int = PAD,
) -> DataFrame:
    """K3: text of the ids without special ones; a label of -100 counts as padding."""
    known = F.transform(ids_col, lambda i: F.when(i == IGNORED, F.lit(pad)).otherwise(i))
    plain = df.withColumn("__ids", F.filter(known, lambda i: ~i.isin(*specials)))
    out = _lookup(plain, "__ids", vocab, "id", "word", "", "string", "__words")
    return out.withColumn(name, F.array_join("__words", glue)).drop("__ids", "__words")


# ---------------------------------------------------------------- padding and labels


def batch_width(ids: str, batch_col: str) -> Column:
    """The longest array in the batch; a batch is a bounded number of rows."""
    return F.max(F.size(ids)).over(W.partitionBy(batch_col))


def _padded(ids: str, width: Column, value: int, left: bool = False) -> Column:
    fill = F.array_repeat(F.lit(value), width - F.size(ids))
    return F.concat(fill, F.col(ids)) if left else F.concat(F.col(ids), fill)


def _wrapped(ids: Column, max_len: int, bos: int, eos: int) -> Column:
    return F.concat(F.array(F.lit(bos)), tx.take(ids, max_len - 2), F.array(F.lit(eos)))


def pad_inputs(
    df: DataFrame,
    max_len: int,
    batch_col: str = "batch_id",
    ids: str = "input_ids",
    bos: int = BOS,
    eos: int = EOS,
    pad: int = PAD,
) -> DataFrame:
    """K6: ``[bos] ids [eos]`` padded on the right to the batch width, with ``attention_mask``."""
    wrapped = df.withColumn(ids, _wrapped(F.col(ids), max_len, bos, eos))
    width = batch_width(ids, batch_col)
    mask = F.concat(
        F.array_repeat(F.lit(1), F.size(ids)),
        F.array_repeat(F.lit(0), F.col("__w") - F.size(ids)),
    )
    return (
        wrapped.withColumn("__w", width)
        .withColumn("attention_mask", mask)
        .withColumn(ids, _padded(ids, F.col("__w"), pad))
        .drop("__w")
    )


def completion_inputs(
    df: DataFrame, ratio: float, diff: str = "diff_ids", msg: str = "msg_ids", sep: int = SEP
) -> DataFrame:
    """K7: diff, separator and the first share of the message; the rest is the target."""
    cut = F.floor(F.size(msg) * F.lit(ratio)).cast("int")
    return df.withColumn("__cut", cut).select(
        *[c for c in df.columns if c != "input_ids"],
        F.concat(F.col(diff), F.array(F.lit(sep)), tx.take(F.col(msg), F.col("__cut"))).alias(
            "input_ids"
        ),
        F.slice(msg, F.col("__cut") + 1, F.size(msg) + 1).alias("target_ids"),
    )


def decoder_labels(
    df: DataFrame,
    max_len: int,
    shift: bool = False,
    start_id: int | None = None,
    batch_col: str = "batch_id",
    msg: str = "msg_ids",
    bos: int = BOS,
    eos: int = EOS,
    pad: int = PAD,
) -> DataFrame:
    """K8: ``decoder_ids, decoder_mask, labels``.

    With ``shift`` the ids are ``[start or bos] [bos] m`` (the end token falls off), as models that
    shift labels themselves expect; the labels stay the same.
    """
    body = tx.take(F.col(msg), max_len - 2)
    plain = _wrapped(F.col(msg), max_len, bos, eos)
    first = bos if start_id is None else start_id
    ids = F.concat(F.array(F.lit(first), F.lit(bos)), body) if shift else plain
    staged = df.withColumn("decoder_ids", ids).withColumn("labels", plain)
    staged = staged.withColumn("__w", batch_width("decoder_ids", batch_col))
    mask = F.concat(
        F.array_repeat(F.lit(1), F.size("decoder_ids")),
        F.array_repeat(F.lit(0), F.col("__w") - F.size("decoder_ids")),
    )
    return (
        staged.withColumn("decoder_mask", mask)
        .withColumn("decoder_ids", _padded("decoder_ids", F.col("__w"), pad))
        .withColumn("labels", _padded("labels", F.col("__w"), IGNORED))
        .drop("__w")
    )


def completion_context(
    df: DataFrame,
    ratio: float | None,
    max_len: int,
    msg: str = "message",
    context_len: int | None = None,
    scheme: str = "pieces",
) -> DataFrame:
    """K9: ``context``, ``target`` and ``prefix`` of a message cut to ``max_len - 1`` tokens.

    A word that the cut leaves open (or that ends right at it) becomes the prefix of the answer.
    """
    text = tx.detokenize(tx.take(tx.tokens(F.col(msg), scheme), max_len - 1), scheme)
    staged = df.withColumn("__t", text)
    empty = F.lit("")
    if ratio == 0.0 and context_len is None:
        parts = (empty, F.col("__t"), empty)
    elif ratio == 1.0 and context_len is None:
        parts = (F.col("__t"), empty, empty)
    else:
        size = F.lit(context_len) if context_len else F.floor(F.length("__t") * F.lit(ratio))
        staged = (
            staged.withColumn("__n", size.cast("int"))
            .withColumn("__in", F.substring("__t", F.lit(1), F.col("__n")))
            .withColumn("__ws", tx.words(F.col("__in")))
        )
        closed = F.col("__in").rlike(tx.BLANK_END)
        head = F.array_join(
            F.slice("__ws", F.lit(1), F.greatest(F.size("__ws") - 1, F.lit(0))), " "
        )
        last = F.coalesce(F.get("__ws", F.size("__ws") - 1), empty)
        context = F.when(closed, F.col("__in")).otherwise(head)
        prefix = F.when(closed, empty).otherwise(
            F.when(head != "", F.concat(F.lit(" "), last)).otherwise(last)
        )
        parts = (context, F.substring("__t", F.col("__n") + 1, F.length("__t")), prefix)
    out = staged.withColumns(dict(zip(("context", "target", "prefix"), parts)))
    return out.drop("__t", "__n", "__in", "__ws")


def generation_inputs(
    df: DataFrame,
    ids: str = "context_ids",
    batch_col: str = "batch_id",
    start_id: int = BOS,
    pad: int = PAD,
) -> DataFrame:
    """K9: start token in front, padded on the **left** to the batch width."""
    staged = df.withColumn(ids, F.concat(F.array(F.lit(start_id)), F.col(ids)))
    staged = staged.withColumn("__w", batch_width(ids, batch_col))
    mask = F.concat(
        F.array_repeat(F.lit(0), F.col("__w") - F.size(ids)),
        F.array_repeat(F.lit(1), F.size(ids)),
    )
    return (
        staged.withColumn("decoder_mask", mask)
        .withColumn(ids, _padded(ids, F.col("__w"), pad, left=True))
        .drop("__w")
    )


def concat_diff_msg(
    df: DataFrame,
    max_len: int,
    sep: int = SEP,
    with_msg: bool = True,
    diff: str = "diff_ids",
    msg: str = "msg_ids",
) -> DataFrame:
    """The message takes at most half of the row, the diff what is left."""
    empty = F.array().cast("array<int>")
    m = tx.take(F.col(msg), (max_len - 1) // 2) if with_msg else empty
    staged = df.withColumn("__m", m)
    cut = tx.take(F.col(diff), F.lit(max_len - 1) - F.size("__m"))
    return staged.withColumn(
        "input_ids", F.concat(cut, F.array(F.lit(sep)), F.col("__m"))
    ).drop("__m")


def collate_clm(
    df: DataFrame, batch_col: str = "batch_id", ids: str = "input_ids", pad: int = EOS
) -> DataFrame:
    """Padded ids, and labels that ignore every pad id (real end tokens too when pad = eos)."""
    staged = df.withColumn("__w", batch_width(ids, batch_col))
    mask = F.concat(
        F.array_repeat(F.lit(1), F.size(ids)),
        F.array_repeat(F.lit(0), F.col("__w") - F.size(ids)),
    )
    return (
        staged.withColumn("attention_mask", mask)
        .withColumn(ids, _padded(ids, F.col("__w"), pad))
        .withColumn(
            "labels",
            F.transform(ids, lambda i: F.when(i == pad, F.lit(IGNORED)).otherwise(i)),
        )
        .drop("__w")
    )


def collate_seq2seq(
    df: DataFrame,
    batch_col: str = "batch_id",
    ids: str = "input_ids",
    labels: str = "labels",
    multiple: int | None = None,
    pad: int = PAD,
) -> DataFrame:
    """Inputs padded with ``pad``, labels (when present) with -100."""

    def width(col: str) -> Column:
        longest = batch_width(col, batch_col)
        if not multiple:
            return longest
        return (F.ceil(longest / multiple) * multiple).cast("int")

    staged = df.withColumn("__w", width(ids))
    if labels in df.columns:
        staged = staged.withColumn("__wl", width(labels))
        staged = staged.withColumn(labels, _padded(labels, F.col("__wl"), IGNORED))
    mask = F.concat(
        F.array_repeat(F.lit(1), F.size(ids)),
        F.array_repeat(F.lit(0), F.col("__w") - F.size(ids)),
    )
    return (
        staged.withColumn("attention_mask", mask)
        .withColumn(ids, _padded(ids, F.col("__w"), pad))
        .drop("__w", "__wl")
    )


def crop_context(df: DataFrame, pred: str = "prediction_ids", ids: str = "input_ids") -> DataFrame:
    """Generated ids without the prompt they start with."""
    return df.withColumn(pred, F.slice(pred, F.size(ids) + 1, F.size(pred) + 1))


def processed_tokens(df: DataFrame, by: Sequence[str] = (), mask: str = "attention_mask") -> DataFrame:
    """Tokens that count, i.e. the sum of the masks."""
    ones = F.aggregate(mask, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return df.groupBy(*by).agg(F.sum(ones).alias("num_tokens"))
