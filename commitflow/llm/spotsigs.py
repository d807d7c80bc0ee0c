"""SpotSigs fingerprints with DataFrame functions alone: no Python runs on the executors.

A signature is a common word and the chain of content words that follows it; common words inside the
chain are passed over. Punctuation and case do not count. As some texts hold no common words, the start
of a text and every content word whose hash is divisible by ``SPARSE`` begin a chain too. A text's
fingerprint is its set of signatures, shown as its size and a digest; likeness is the Jaccard similarity
of two sets, which is skipped where their lengths alone keep it below the asked threshold.

Nulls: a null text counts as empty. A text without words has one signature, its own hash, so it is like
equal texts only. A null id sorts first; repeated ids are ordered by text. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .shared import partitions

#: Common words of four languages.
ANCHORS = tuple(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we"
    " were which will with you au avec ce dans de des du elle en est et il la le les ne nous ou par pas pour qui que sur un une vous"
    " das dem den der die du ein eine er es für ich ist mit nicht sich sie und von wir zu auf als auch im"
    " como con del el los las lo más no para pero por se su sus una y".split()
)
#: Content words of a chain, and one in how many content words begins a chain by itself.
CHAIN, SPARSE = 2, 8


def _marked(text: Column, anchors: tuple[str, ...], sparse: int) -> Column:
    """Content words in order; "#" and the anchor stand before those that begin a chain."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def mark(w: Column) -> Column:
        starts = F.pmod(F.xxhash64(w), F.lit(sparse)) == 0
        return F.when(w.isin(*anchors), F.concat(F.lit("#"), w, F.lit("_"))).when(starts, F.concat(F.lit("#_"), w, F.lit(" "))).otherwise(F.concat(w, F.lit(" ")))

    # An anchor sticks to the content word behind it; the space parts content words.
    return F.split(F.rtrim(F.concat(F.lit("#^_"), F.array_join(F.transform(words, mark), ""))), " ")


def with_signatures(df: DataFrame, text_col: str, out: str, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN, sparse: int = SPARSE) -> DataFrame:
    """``out``: the sorted signatures (64-bit hashes) of each text."""
    marked = df.withColumn("__marked", _marked(F.coalesce(text_col, F.lit("")), anchors, sparse))
    words = F.col("__marked")

    def signature(w: Column, i: Column) -> Column:
        # The last anchor before the content word counts; the chain goes on over the content words behind it.
        following = [F.substring_index(F.get(words, i + k), "_", -1) for k in range(1, chain)]
        return F.when(w.startswith("#"), F.xxhash64(F.substring_index(w, "#", -1), *following))

    found = F.array_sort(F.array_distinct(F.array_compact(F.transform(words, signature))))
    # Only the mark of the start stands there where a text has no content word.
    alone = (F.size(words) == 1) & words[0].endswith("_")
    return marked.withColumn(out, F.when(alone, F.array(F.xxhash64(F.coalesce(text_col, F.lit(""))))).otherwise(found)).drop("__marked")


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 where it is below ``at_least``.

    Sets whose lengths lie further apart than ``at_least`` allows are never intersected.
    """
    lengths = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    jaccard = common / (F.size(a) + F.size(b) - common)
    return F.when(lengths < at_least, F.lit(0.0)).otherwise(F.when(jaccard >= at_least, jaccard).otherwise(0.0)).cast("double")


def shown(signatures: Column) -> Column:
    """The fingerprint as text: how many signatures, and a digest of the set."""
    digest = F.lpad(F.lower(F.hex(F.xxhash64(signatures))), 16, "0")
    return F.concat_ws("-", F.size(signatures).cast("string"), digest)


def _bucket(key: Column, bounds: list[int]) -> Column:
    """Number of the last bound that is not above ``key``, by halving."""

    def between(low: int, high: int) -> Column:
        if high - low == 1:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < bounds[middle], between(low, middle)).otherwise(between(middle, high))

    return between(0, len(bounds))


def _in_ranges(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, WindowSpec]:
    """Rows dealt into id ranges, whose bounds are ids of rows, and the window that orders a range.

    The first row of a range is also sent, as a guest, to the range before it (that of the first range
    to the last), so every row finds its successor in its own range and no window spans the table.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumn("key", F.coalesce("id", F.lit(-(1 << 63))))
    n = partitions(df.sparkSession)
    found = keyed.agg(F.min("key").alias("first"), F.percentile_approx("key", [k / n for k in range(1, n)] or [0.5]).alias("bounds")).first()
    bounds = sorted({found["first"] or 0, *(found["bounds"] or [])})
    own = F.struct(_bucket(F.col("key"), bounds).alias("bucket"), F.lit(False).alias("guest"))
    before = F.pmod(own["bucket"] - 1, F.lit(len(bounds)))
    guest = F.struct(before.alias("bucket"), F.lit(True).alias("guest"))
    places = F.when(F.col("key").isin(*bounds), F.array(own, guest)).otherwise(F.array(own))
    # Plain columns: both windows then share one exchange and one sort.
    placed = keyed.select("id", "text", "key", F.xxhash64("text").alias("tie"), F.inline(places))
    order = Window.partitionBy("bucket").orderBy("guest", "key", "tie", "text")
    return placed, order


def edited_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4) -> DataFrame:
    """Each text against itself with its last ``1/share`` replaced by the beginning of the next one by id
    (behind the last comes the first), and against that next text."""
    rows, order = _in_ranges(df, id_col, text_col)
    signed = with_signatures(rows.withColumn("next_text", F.lead("text").over(order)), "text", "signatures")
    # The same ranges and order as above: no further exchange.
    signed = signed.withColumn("next_signatures", F.lead("signatures").over(order))
    return _compared(signed.where("not guest"), id_col, share)


def _compared(rows: DataFrame, id_col: str, share: int) -> DataFrame:
    n = F.length("text")
    cut = F.floor(n / share).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    both = with_signatures(rows.withColumn("edited", edited).withColumn("n_chars", n.cast("long")), "edited", "edited_signatures")
    return both.select(
        F.col("id").alias(id_col), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown(F.col("signatures")).alias("fingerprint"), shown(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )
