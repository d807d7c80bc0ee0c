"""Change records: rendering, cleaning and parsing (section C)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

# Name-status letters and the change types they stand for.
STATUS_LETTERS = {"A": "ADD", "M": "MODIFY", "D": "DELETE", "R": "RENAME", "C": "COPY"}

# Texts of a synthetic commit.
SYNTH_DIFF = 'def %s():\n    print("%s")\n'
SYNTH_MESSAGE = 'Added function to print "%s"'


def _file_header(m: Column, line_sep: str, strict: bool) -> Column:
    kind = m["change_type"]
    old = F.coalesce(m["old_path"], F.lit("None"))
    new = F.coalesce(m["new_path"], F.lit("None"))
    two_lines = lambda verb: F.concat(
        F.lit(f"{verb} from "), old, F.lit(f"{line_sep}{verb} to "), new
    )
    other = (
        F.when(kind == "MODIFY", new).otherwise(
            F.raise_error(F.concat(F.lit("unexpected change type: "), kind)).cast("string")
        )
        if strict
        else new
    )
    return (
        F.when(kind == "ADD", F.concat(F.lit("new file "), new))
        .when(kind == "DELETE", F.concat(F.lit("deleted file "), old))
        .when(kind == "RENAME", two_lines("rename"))
        .when(kind == "COPY", two_lines("copy"))
        .otherwise(other)
    )


def diff_text(mods: Column, line_sep: str = "\n", strict: bool = False) -> Column:
    """C1 as an expression: UNKNOWN changes are skipped, a null path prints as ``None``."""
    known = F.filter(mods, lambda m: m["change_type"] != "UNKNOWN")
    parts = F.transform(
        known,
        lambda m: F.concat(
            _file_header(m, line_sep, strict), F.lit(line_sep), F.coalesce(m["diff"], F.lit(""))
        ),
    )
    return F.array_join(parts, "")


def render_diff(df: DataFrame, line_sep: str = "\n", strict: bool = False) -> DataFrame:
    """C1."""
    return df.withColumn("diff", diff_text(F.col("mods"), line_sep, strict))


def to_processed(df: DataFrame, line_sep: str = "\n") -> DataFrame:
    """The ``diff, msg, repo`` projection."""
    return df.select(
        diff_text(F.col("mods"), line_sep).alias("diff"), F.col("message").alias("msg"), "repo"
    )


def clean_diff(c: Column, line_sep: str = "\n") -> Column:
    """Stripped non-blank lines after the last bare hunk header, blanks squeezed."""
    lines = F.filter(F.transform(F.split(c, "\n"), tx.strip), lambda x: x != "")
    marker = F.transform(
        lines,
        lambda x, i: F.when(x.startswith("@@") & x.endswith("@@"), i + 1).otherwise(F.lit(0)),
    )
    kept = F.slice(lines, F.coalesce(F.array_max(marker), F.lit(0)) + 1, F.size(lines) + 1)
    joined = F.array_join(F.transform(kept, lambda x: F.concat(x, F.lit(line_sep))), "")
    return F.regexp_replace(joined, tx.BLANKS_IN_LINE, " ")


def parse_name_status(df: DataFrame, text_col: str, mode: str = "strict") -> DataFrame:
    """C4: one row per status line with ``change_type``, ``old_path`` and ``new_path``."""
    lines = df.select(
        *[c for c in df.columns if c != text_col],
        F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"),
    ).filter(F.col("line") != "")
    parts = F.split("line", "\t")
    letter = F.get(parts, 0)
    fallback = (
        F.lit("UNKNOWN")
        if mode == "permissive"
        else F.raise_error(F.concat(F.lit("unknown change type "), letter)).cast("string")
    )
    kind = F.when(letter.startswith("R"), F.lit("RENAME"))
    for key, value in STATUS_LETTERS.items():
        kind = kind.when(letter == key, F.lit(value))
    return (
        lines.withColumn("change_type", kind.otherwise(fallback))
        .withColumn("old_path", F.get(parts, 1))
        .withColumn("new_path", F.when(F.size(parts) > 1, F.element_at(parts, -1)))
        .drop("line")
    )


def stringify(df: DataFrame, *cols: str) -> DataFrame:
    """Cast columns to text; nested values become JSON."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    for c in cols:
        kind = df.schema[c].dataType
        if isinstance(kind, T.StringType):
            continue
        as_text = F.to_json(c) if isinstance(kind, nested) else F.col(c).cast("string")
        df = df.withColumn(c, as_text)
    return df


def project(
    df: DataFrame,
    keep: Sequence[str] | None = None,
    drop: Sequence[str] = (),
    rename: dict[str, str] | None = None,
) -> DataFrame:
    """Drop, select in order, rename."""
    df = df.drop(*drop)
    if keep is not None:
        df = df.select(*keep)
    return df.withColumnsRenamed(rename or {})


def with_length(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Length in code points."""
    return df.withColumn(name or f"{col}_length", F.length(col))


def synth_commits(
    files: DataFrame,
    functions: Sequence[str],
    messages: Sequence[str],
    file_col: str = "file_name",
) -> DataFrame:
    """Every file with every function and message, numbered by a per-file version.

    Functions and messages are short parameter lists, so the product is an in-row expansion of the
    file table, and the version follows from the two positions: no join, window or shuffle.
    """
    per_file = len(messages)
    return (
        files.select(file_col, F.posexplode(_texts(functions)).alias("f", "function"))
        .select(file_col, "f", "function", F.posexplode(_texts(messages)).alias("m", "text"))
        .select(
            file_col,
            (F.col("f") * per_file + F.col("m") + 1).cast("bigint").alias("version"),
            F.format_string(SYNTH_DIFF, "function", "text").alias("commit_diff"),
            F.format_string(SYNTH_MESSAGE, "text").alias("commit_message"),
        )
    )


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])
