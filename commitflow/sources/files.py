"""File sources and sinks (section A)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators.rows import take_first
from . import schemas



def read_commits(
    spark: SparkSession, path: str, split: str | None = None, schema: str = schemas.COMMIT
) -> DataFrame:
    """A1: the nested commit table; ``split`` prunes partitions of a split-partitioned table."""
    reader = spark.read
    if split is None:
        return reader.schema(schema).parquet(path)
    return reader.schema(f"{schema}, split string").parquet(path).filter(F.col("split") == split)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A2."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """A3: one record per line; null fields are written, not dropped."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
    return path


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """A4: all splits as one table partitioned by ``split``."""
    df.write.mode(mode).partitionBy("split").parquet(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A5: header row, quoted multi-line values; a byte-order mark before the header is fine."""
    # Columns are matched by position. The null marker never occurs in a file: an unquoted empty
    # cell is null, a quoted one is the empty text.
    return (
        spark.read.schema(schema)
        .options(header=True, multiLine=True, quote='"', escape='"', nullValue="\x00")
        .csv(path)
    )


def write_csv(df: DataFrame, path: str, bom: bool = False, mode: str = "errorifexists") -> str:
    """A5: with ``bom`` the header starts with a UTF-8 byte-order mark, as spreadsheets expect."""
    if bom:
        first = df.columns[0]
        df = df.withColumnRenamed(first, "\ufeff" + first)
    df.write.mode(mode).options(
        header=True,
        quote='"',
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)
    return path


def read_table_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """``{"columns": [...], "data": [[...], ...]}`` to a table; columns are found by name."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    doc = F.from_json("value", "columns array<string>, data array<array<string>>")
    rows = (
        spark.read.option("wholetext", True)
        .text(path)
        .select(doc.alias("d"))
        .select(F.col("d.columns").alias("cols"), F.explode("d.data").alias("r"))
    )

    def cell(field: T.StructField) -> Column:
        at = F.array_position("cols", field.name).cast("int") - 1
        return F.get("r", at).cast(field.dataType).alias(field.name)

    return rows.select(*[cell(f) for f in schema.fields])


def read_model_outputs(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of prediction records, both texts stripped."""
    raw = spark.read.option("multiLine", True).schema(schemas.MODEL_OUTPUT).json(path)
    return raw.select(
        tx.strip(F.col("generated_commit")).alias("generated_commit"),
        tx.strip(F.col("reference_commit")).alias("reference_commit"),
    )


def completion_text(shape: str = "body") -> Column:
    """Answer text of a response row, stripped; null when there is no choice."""
    path = "response.body.choices" if shape == "body" else "choices"
    return tx.strip(F.get(path, F.lit(0))["message"]["content"])


def read_responses(spark: SparkSession, glob: str, shape: str = "body") -> DataFrame:
    """Every response shard with the file and position needed to order repeated ids."""
    schema = schemas.RESPONSE_BODY if shape == "body" else schemas.RESPONSE_FLAT
    return (
        spark.read.schema(schema)
        .json(glob)
        .select(
            "custom_id",
            completion_text(shape).alias("content"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        )
    )


def write_request_shards(
    df: DataFrame, path: str, shard_col: str = "shard", mode: str = "errorifexists"
) -> str:
    """One file per shard in a folder named by the shard; rows keep ``row_idx`` order."""
    order = [c for c in ("row_idx",) if c in df.columns]
    (
        df.repartition(shard_col)
        .sortWithinPartitions(shard_col, *order)
        .drop(*order)
        .write.mode(mode)
        .partitionBy(shard_col)
        .option("ignoreNullFields", "false")
        .json(path)
    )
    return path


def append_text_log(
    df: DataFrame,
    path: str,
    step: int,
    order_cols: list[str],
    num_results: int | None = None,
    step_col: str = "step",
    max_rows: int | None = None,
) -> str:
    """Append evaluation rows with their step.

    ``num_results`` keeps the first rows of a step, and ``max_rows`` bounds the whole log table; both
    are features of a display table, and without them every row is kept.
    """
    spark = df.sparkSession
    if max_rows is None:
        rows = df if num_results is None else take_first(df, num_results, order_cols)
        rows.withColumn(step_col, F.lit(step)).write.mode("append").parquet(path)
        return path
    first = max_rows if num_results is None else min(num_results, max_rows)
    try:
        have = spark.read.parquet(path).count()
    except Exception as error:  # the log does not exist yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        have = 0
    room = min(first, max_rows - have)
    if room > 0:
        rows = take_first(df, room, order_cols)
        rows.withColumn(step_col, F.lit(step)).write.mode("append").parquet(path)
    return path


def write_metrics(total: DataFrame, each: DataFrame, path: str, bom: bool = True) -> str:
    """Overall and per-row metric tables side by side."""
    write_csv(total, f"{path}_total", bom=bom)
    write_csv(each, f"{path}_each", bom=bom)
    return path
