"""Secret scans with DataFrame functions alone: strong spans, and weak parts linked to their complements.

Strong spans are found by pattern: assignments to a secret's name, access identifiers, long hexadecimal runs.
Weak parts say little alone: account names and short access identifiers (``identifier``), mixed runs of letters
and digits (``secret``), addresses of services (``endpoint``). They are candidates only, and one is reported where
a complementary part, strong or weak, lies within ``reach`` code points of it in the same scope: an identifier or an
endpoint needs a secret, a secret needs an identifier or an endpoint. A scope ends at a blank line.

The link is an interval join: every part's interval, widened by ``reach``, must meet an interval of the other role.
As only the existence of a partner counts, the nearest ones on either side decide, and running extremes over
parts in order of their place give them; no pairs are built. Parts are a few numbers each and cross one
exchange, keyed by the row; texts stay where they were read. A row's parts end in one cell of the result (``spans``),
so they meet in one task anyway; the running aggregates there stream and spill.

A weak part that overlaps a stronger one is the same string and counts once: strong spans come first, then endpoints
(always kept), identifiers, secrets.

Nulls: a null text counts as empty; such rows, and rows without a span, have zero counts and empty lists. Every input
row, repeated ones too, gives one row. Spans at one place are told apart by kind and end. An empty table
gives no rows; no other column of the input is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The strong kinds, in the order in which spans at one place are listed. Fixed values.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Code points that the value of an assignment must have. Matches with a shorter one are consumed, then dropped.
ASSIGN_VALUE = 6

#: The weak kinds.
IDENTIFIER = (
    r"AKIA[A-Z0-9]{4,}|(?i:user|user_?name|login|account|client_?id|access_?key_?id|key_?id)"
    r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]+"""
)
SECRET = r"[A-Za-z0-9+/_=-]{16,}"
ENDPOINT = r"""(?i:https?|wss?|ftp|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\x00-\x20"'<>]+"""
#: Where a scope ends.
BREAK = r"\n[\x20\t\r]*\n"

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
STRONG = 3
_SCOPE = len(KINDS)
#: Kinds by what they say: who, with which secret, where.
WHO, WHAT, WHERE = (1, 3), (0, 2, 4), (5,)


def _holds(text: Column, *marks: str) -> Column:
    """Whether one of the texts that every match contains occurs at all: far cheaper than the pattern."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(m)) for m in marks))


def _matches(text: Column, kind: int, pattern: str, may: Column, keep=None) -> Column:
    """The matches of ``pattern`` in order: (kind, number, code points since the last one, its own, keep).

    ``keep`` decides by a match, or the value of its second group where the pattern has one. Only texts that
    ``may`` have a match are searched, and only those with one are split.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == 0 else hits
    zipped = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value"))

    def one(z: Column, i: Column) -> Column:
        kept = F.lit(True) if keep is None else keep(z["value"])
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(z["gap"]).alias("gap"), F.length(z["hit"]).alias("size"), kept.alias("keep"))

    # Behind the last match stands a gap alone.
    found = F.transform(F.filter(zipped, lambda z: z["hit"].isNotNull()), one)
    return F.when(may & text.rlike(pattern), found).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,keep:boolean>>"))


def _mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def parts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, kind, start, stop, scope) of every strong span and weak candidate; kind -1 stands for the row itself.

    Candidates of a row without complements are left out at once. ``row`` numbers the rows of this scan.
    """
    text = F.col("text")
    rows = df.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    found = rows.select(
        "id", "row", "text",
        _matches(text, 0, ASSIGN, _holds(text, ":", "="), lambda value: F.length(value) >= ASSIGN_VALUE).alias("k0"),
        _matches(text, 1, ACCESS, _holds(text, "AKIA")).alias("k1"),
        _matches(text, 2, HEX, F.lit(True)).alias("k2"),
        _matches(text, 3, IDENTIFIER, _holds(text, ":", "=", "AKIA")).alias("k3"),
        _matches(text, 5, ENDPOINT, _holds(text, "://")).alias("k5"),
    )
    # A weak secret needs one of the others.
    found = found.withColumn("k4", _matches(text, 4, SECRET, F.size(F.concat("k1", "k3", "k5")) > 0, _mixed))

    def any_of(kinds: tuple[int, ...]) -> Column:
        return F.exists(F.concat(*(F.col(f"k{k}") for k in kinds)), lambda z: z["keep"])

    linked = any_of(WHAT) & any_of(WHO + WHERE)
    none = F.array().cast(found.schema["k3"].dataType)
    itself = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit(0).alias("size"), F.lit(True).alias("keep")))
    candidates = F.when(linked, F.concat("k3", "k4", "k5", _matches(text, _SCOPE, BREAK, F.lit(True)))).otherwise(none)
    spread = found.select("id", "row", F.inline(F.concat(itself, "k0", "k1", "k2", candidates)))
    # Keyed by row alone: all windows below and the last aggregate share this exchange.
    dealt = spread.repartition("row")
    so_far = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("i"))
    placed = dealt.withColumn("stop", so_far).where("keep").withColumn("start", F.col("stop") - F.col("size"))
    breaks = F.sum((F.col("kind") == _SCOPE).cast("int")).over(_before("row"))
    return placed.withColumn("scope", F.coalesce(breaks, F.lit(0))).where(F.col("kind") < _SCOPE).select("id", "row", "kind", "start", "stop", "scope")


def _before(*keys: str):
    return Window.partitionBy(*keys).orderBy("start", "kind", "stop").rowsBetween(Window.unboundedPreceding, -1)


def _after(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.desc("start"), F.desc("kind"), F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)


def _nearest(kinds: tuple[int, ...], *keys: str) -> tuple[Column, Column]:
    """The furthest stop among earlier parts of ``kinds``, and the first start among later ones."""
    ours = F.col("kind").isin(*kinds)
    return F.max(F.when(ours, F.col("stop"))).over(_before(*keys)), F.min(F.when(ours, F.col("start"))).over(_after(*keys))


def linked(found: DataFrame, reach: int = 200) -> DataFrame:
    """``parts`` without the weak ones that overlap a stronger part or have no complement within ``reach``."""
    groups = {"strong": tuple(range(STRONG)), "where": WHERE, "named": (3,)}
    apart = found
    for name, kinds in groups.items():
        before, after = _nearest(kinds, "row")
        apart = apart.withColumn(f"{name}_b", before).withColumn(f"{name}_a", after)

    def over(name: str) -> Column:
        return F.coalesce(F.col(f"{name}_b") > F.col("start"), F.lit(False)) | F.coalesce(F.col(f"{name}_a") < F.col("stop"), F.lit(False))

    hidden = ((F.col("kind") == 3) & (over("strong") | over("where"))) | ((F.col("kind") == 4) & (over("strong") | over("where") | over("named")))
    seen = apart.where(~hidden).select(*found.columns)
    for name, kinds in {"what": WHAT, "who": WHO + WHERE}.items():
        before, after = _nearest(kinds, "row", "scope")
        near = F.least(F.col("start") - before, after - F.col("stop")) <= reach
        seen = seen.withColumn(name, F.coalesce(near, F.lit(False)))
    kept = (F.col("kind") < STRONG) | (F.col("kind").isin(3, 5) & F.col("what")) | ((F.col("kind") == 4) & F.col("who"))
    return seen.where(kept).select(*found.columns)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """One row an input row: its id, how many spans of each strong kind, a digest of these, and all spans as text.

    A span reads ``kind:start:end`` in code points, end exclusive; spans are listed by start, then kind.
    """
    spans = F.array_sort(F.collect_list(F.when(F.col("kind") >= 0, F.struct("start", "kind", "stop"))))
    listed = linked(parts(df, id_col, text_col), reach).groupBy("row").agg(F.max("id").alias("id"), spans.alias("spans"))
    names = F.array(*(F.lit(k) for k in KINDS))

    def text(which: Column) -> Column:
        return F.array_join(F.transform(which, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")

    strong = F.filter("spans", lambda s: s["kind"] < STRONG)

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(STRONG)]
    return listed.select(F.col("id").alias(id_col), *counts, F.sha2(text(strong).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def scan_sql(reach: int = 200) -> str:
    """The scan of ``documents`` in SQL."""

    def lit(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def kind(k: int, pattern: str, keep: str = "true") -> str:
        return (
            f"select r, {k} as kind, i, length(gaps[i]) as gap, length(hits[i]) as size, {keep} as keep from (select r, string_split_regex(t, {lit(pattern)}) as gaps,"
            f" regexp_extract_all(t, {lit(pattern)}, 0) as hits, regexp_extract_all(t, {lit(pattern)}, {2 if k == 0 else 0}) as vals from d), unnest(range(1, len(hits) + 1)) as u(i)"
        )

    kinds = [
        kind(0, ASSIGN, f"length(vals[i]) >= {ASSIGN_VALUE}"), kind(1, ACCESS), kind(2, HEX), kind(3, IDENTIFIER),
        kind(4, SECRET, "regexp_matches(vals[i], '[0-9]') and regexp_matches(vals[i], '[A-Za-z]')"), kind(5, ENDPOINT), kind(_SCOPE, BREAK),
    ]

    def near(kinds: tuple[int, ...]) -> str:
        return f"exists (select 1 from seen q where q.r = p.r and q.scope = p.scope and q.kind in ({', '.join(map(str, kinds))}) and q.start - p.stop <= {reach} and p.start - q.stop <= {reach})"

    names = ", ".join(f"'{k}'" for k in KINDS)
    return (
        "with d as (select doc_id, row_number() over () as r, coalesce(text, '') as t from documents),"
        f" raw as ({' union all '.join(kinds)}),"
        " placed as (select r, kind, keep, sum(gap + size) over (partition by r, kind order by i) as stop, size from raw),"
        " scoped as (select r, kind, cast(stop - size as bigint) as start, cast(stop as bigint) as stop,"
        f" coalesce(sum(case when kind = {_SCOPE} then 1 end) over (partition by r order by stop - size, kind, stop rows between unbounded preceding and 1 preceding), 0) as scope from placed where keep),"
        " seen as (select * from scoped p where kind < 6 and not (kind in (3, 4) and exists (select 1 from scoped q where q.r = p.r and q.start < p.stop and p.start < q.stop"
        " and (q.kind < 3 or q.kind = 5 or (q.kind = 3 and p.kind = 4))))),"
        f" kept as (select * from seen p where kind < 3 or (kind in (3, 5) and {near(WHAT)}) or (kind = 4 and {near(WHO + WHERE)})),"
        f" said as (select r, kind, concat_ws(':', [{names}][kind + 1], start, stop) as s, start, stop from kept)"
        " select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,"
        " sha256(coalesce(string_agg(s, ',' order by start, kind, stop) filter (kind < 3), '')) as base_sha256,"
        " coalesce(string_agg(s, ',' order by start, kind, stop), '') as spans from d left join said using (r) group by r, doc_id"
    )
