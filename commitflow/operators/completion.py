"""Running user functions over rows, and reading their answers."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..sources.files import completion_text
from .prompts import chat_tokens

RESPONSE = "struct<content:string,prompt_token_count:int,response_token_count:int>"


class Completer(Protocol):
    """What a user brings. Counting, costs and shards are column operators."""

    def complete_chat(self, messages: list[dict[str, str]]) -> dict[str, Any]:
        """Answer with ``content``, ``prompt_token_count`` and ``response_token_count``."""
        ...


def with_retries(
    call: Callable[[], Any],
    retries: int = 6,
    low: float = 1.0,
    high: float = 60.0,
    sleep: Callable[[float], None] = time.sleep,
) -> Any:
    """Call up to ``retries`` times with a random, exponentially growing pause."""
    for attempt in range(1, retries + 1):
        try:
            return call()
        except Exception:
            if attempt == retries:
                raise
            sleep(random.uniform(min(low, high), min(high, low * 2**attempt)))


def apply_completer(
    df: DataFrame,
    factory: Callable[[], Completer],
    retries: int = 6,
    sleep: Callable[[float], None] = time.sleep,
    name: str = "response",
) -> DataFrame:
    """One answer per row; ``message`` is the stripped text.

    ``factory`` runs once per partition. Write the result to a table at once and skip finished rows
    by id (E6): a recomputed or speculative task would call the service again.
    """
    schema = T.StructType(
        [*df.schema.fields, T.StructField(name, T._parse_datatype_string(RESPONSE))]
    )
    has_system = "system_content" in df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in batches:
            answers = []
            systems = pdf["system_content"] if has_system else [None] * len(pdf)
            for system, user in zip(systems, pdf["user_content"]):
                chat = [{"role": "user", "content": user}]
                if has_system:
                    chat.insert(0, {"role": "system", "content": system})
                answers.append(with_retries(lambda: client.complete_chat(chat), retries, sleep=sleep))
            yield pdf.assign(**{name: answers})

    out = df.mapInPandas(run, schema)
    return out.withColumn("message", tx.strip(F.col(f"{name}.content")))


def apply_predictor(
    df: DataFrame, factory: Callable[[], Callable[[Sequence[str]], Sequence[str]]], batch: int = 64
) -> DataFrame:
    """``prediction`` from a user's generate function, called with lists of inputs."""
    schema = T.StructType([*df.schema.fields, T.StructField("prediction", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = factory()
        for pdf in batches:
            texts = pdf["input"].tolist()
            out: list[str] = []
            for i in range(0, len(texts), batch):
                out.extend(generate(texts[i : i + batch]))
            yield pdf.assign(prediction=out)

    return df.mapInPandas(run, schema)


def extract_completion(df: DataFrame, shape: str = "body", name: str = "content") -> DataFrame:
    """D13."""
    return df.withColumn(name, completion_text(shape))


def parse_scores(
    df: DataFrame, schema: str = "score int", col: str = "content", strict: bool = False
) -> DataFrame:
    """Fields of the JSON in the answer; a bad document goes to ``bad_json`` (or raises)."""
    kind = T._parse_datatype_string(schema)
    fields = kind.fieldNames()
    bad = F.col("__p").isNull() | reduce(
        lambda a, b: a & b, [F.col(f"__p.{f}").isNull() for f in fields]
    )
    out = df.withColumn("__p", F.from_json(F.col(col), schema))
    if strict:
        fail = F.raise_error(F.concat(F.lit("not a score document: "), F.col(col)))
        out = out.withColumn(
            "__p", F.when(bad, fail.cast(kind)).otherwise(F.col("__p"))
        )
    values = [F.col(f"__p.{f}") for f in fields]
    if not strict:
        values.append(F.when(bad, F.col(col)).alias("bad_json"))
    return out.select(*df.columns, *values)


def judge_or_count(
    df: DataFrame,
    enabled: bool,
    factory: Callable[[], Completer] | None = None,
    name: str = "score",
) -> DataFrame:
    """Ask for a score, or use the token count of the prompt in its place."""
    if not enabled:
        message = F.struct(F.lit("user").alias("role"), F.col("user_content").alias("content"))
        return df.withColumn(name, chat_tokens(F.array(message)))
    answered = apply_completer(df, factory)
    scored = parse_scores(answered, f"{name} int", col="message", strict=True)
    return scored.drop("response", "message")
