"""Prompts, token budgets and requests (section D)."""

from __future__ import annotations

import string
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .filters import require_placeholders

# Price in USD per million prompt tokens.
PRICES = {
    "gpt-4o-mini-2024-07-18": 0.075,
    "deepseek-chat": 0.014,
    "deepseek-reasoner": 0.14,
}
# Chat overhead in tokens.
PER_MESSAGE, PER_NAME, REPLY_PRIMING = 3, 1, 3
ENDPOINT = "/v1/chat/completions"


def fill_template(template: str, mapping: Mapping[str, Column]) -> Column:
    """D1 as an expression. Values are put in once and never scanned for placeholders again."""
    parts: list[Column] = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(F.coalesce(mapping[field].cast("string"), F.lit("None")))
    return F.concat(*parts) if parts else F.lit("")


def render_prompt(
    df: DataFrame, template: str, mapping: Mapping[str, str], name: str = "prompt"
) -> DataFrame:
    """``mapping`` gives the column behind each placeholder; ``{{`` and ``}}`` are literals."""
    require_placeholders(template, list(mapping))
    return df.withColumn(name, fill_template(template, {k: F.col(c) for k, c in mapping.items()}))


def chat_tokens(messages: Column, mode: str = "chat", scheme: str = "pieces") -> Column:
    """D5 as an expression over ``array<struct<role,content>>``.

    ``chat`` counts every message on its own with the chat overhead; ``joined`` joins all values by
    blanks and counts once.
    """
    if mode == "joined":
        flat = F.array_join(
            F.transform(messages, lambda m: F.concat_ws(" ", m["role"], m["content"])), " "
        )
        return tx.token_count(flat, scheme)
    return F.aggregate(
        messages,
        F.lit(REPLY_PRIMING),
        lambda at, m: at
        + PER_MESSAGE
        + tx.token_count(m["role"], scheme)
        + tx.token_count(m["content"], scheme),
    )


def count_chat_tokens(
    df: DataFrame, messages_col: str, mode: str = "chat", scheme: str = "pieces"
) -> DataFrame:
    """D5. A ``name`` field adds its own tokens and one more."""
    total = chat_tokens(F.col(messages_col), mode, scheme)
    if mode == "chat" and "name" in df.schema[messages_col].dataType.elementType.names:
        named = F.filter(messages_col, lambda m: m["name"].isNotNull())
        total = total + F.aggregate(
            named, F.lit(0), lambda at, m: at + PER_NAME + tx.token_count(m["name"], scheme)
        )
    return df.withColumn("num_tokens", total)


def _overhead(system: str, user: str, scheme: str) -> Column:
    """Tokens of the prompt without row values; a constant, folded once per plan."""
    counts = [tx.token_count(F.lit(t), scheme) for t in ("system", system, "user", user)]
    return reduce(lambda a, b: a + b, counts) + F.lit(2 * PER_MESSAGE + REPLY_PRIMING)


def _checked(budget: Column) -> Column:
    return F.when(budget > 0, budget).otherwise(
        F.raise_error(F.lit("no token budget is left for the diff")).cast("int")
    )


def truncate_to_budget(
    df: DataFrame,
    template: str,
    max_prompt: int,
    max_msg: int,
    system: str = "",
    scheme: str = "pieces",
    stats: bool = False,
) -> DataFrame:
    """D2 (and D4 with ``stats``): message first, the diff gets what is left of the budget."""
    require_placeholders(template, ["diff", "message"])
    other = _overhead(system, template.format(diff="", message=""), scheme)
    cut = (
        df.withColumn("__m", tx.tokens(F.col("message"), scheme))
        .withColumn("__d", tx.tokens(F.col("diff"), scheme))
        .withColumn("__nm", F.least(F.size("__m"), F.lit(max_msg)))
        .withColumn("__nd", _checked(F.lit(max_prompt) - other - F.col("__nm")))
    )
    message = tx.detokenize(tx.take(F.col("__m"), F.col("__nm")), scheme)
    diff = tx.detokenize(tx.take(F.col("__d"), F.col("__nd")), scheme)
    out = cut.withColumn("system_content", F.lit(system)).withColumn(
        "user_content", fill_template(template, {"diff": diff, "message": message})
    )
    if stats:
        kept = F.least(F.size("__d"), F.col("__nd"))
        out = out.withColumn(
            "token_stats",
            F.struct(
                _stats(F.size("__d"), F.size("__m"), other).alias("original"),
                _stats(kept, F.col("__nm"), other).alias("truncated"),
            ),
        )
    return out.drop("__m", "__d", "__nm", "__nd")


def _stats(diff: Column, message: Column, other: Column) -> Column:
    return F.struct(
        diff.alias("num_diff_tokens"),
        message.alias("num_msg_tokens"),
        other.alias("non_diff_msg_tokens"),
        (diff + message + other).alias("num_total_tokens"),
    )


def truncate_diff_to_budget(
    df: DataFrame,
    template: str,
    max_prompt: int,
    system: str = "",
    scheme: str = "pieces",
    stats: bool = False,
) -> DataFrame:
    """D3 (and D4): only the diff is in the prompt; the cut diff replaces the column."""
    require_placeholders(template, ["diff"])
    other = _overhead(system, template.format(diff=""), scheme)
    cut = df.withColumn("__d", tx.tokens(F.col("diff"), scheme)).withColumn(
        "__nd", _checked(F.lit(max_prompt) - other)
    )
    diff = tx.detokenize(tx.take(F.col("__d"), F.col("__nd")), scheme)
    out = (
        cut.withColumn("diff", diff)
        .withColumn("system_content", F.lit(system))
        .withColumn("user_content", fill_template(template, {"diff": F.col("diff")}))
    )
    if stats:
        side = lambda n: F.struct(
            n.alias("num_diff_tokens"),
            other.alias("num_non_diff_tokens"),
            (n + other).alias("num_total_tokens"),
        )
        kept = F.least(F.size("__d"), F.col("__nd"))
        out = out.withColumn(
            "token_stats",
            F.struct(side(F.size("__d")).alias("original"), side(kept).alias("truncated")),
        )
    return out.drop("__d", "__nd")


def token_totals(df: DataFrame) -> DataFrame:
    """Tokens of the truncated prompts, in total and per sample."""
    n = F.col("token_stats.truncated.num_total_tokens")
    return df.agg(F.sum(n).alias("total_tokens"), F.avg(n).alias("tokens_per_sample"))


def estimate_cost(
    df: DataFrame,
    model: str,
    max_prompt: int,
    tokens_per_day: int,
    prices: Mapping[str, float] = PRICES,
) -> DataFrame:
    """Upper bound of the cost when every prompt uses its whole budget."""
    price = prices[model]
    tokens = F.count(F.lit(1)) * max_prompt
    return df.agg(tokens.alias("max_tokens")).select(
        "max_tokens",
        (F.lit(price) * F.col("max_tokens") / 1_000_000).alias("cost"),
        (F.lit(price) * F.col("max_tokens") / 1_000_000 / 2).alias("batch_cost"),
        F.ceil(F.col("max_tokens") / tokens_per_day).cast("bigint").alias("days"),
    )


def cost_text(cost: float) -> str:
    return f"${cost:.3f}"


def with_request_id(df: DataFrame, keys: Sequence[str], name: str = "custom_id") -> DataFrame:
    """An id that is the same on every run and retry."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return df.withColumn(name, F.sha2(F.concat_ws("\x1f", *parts), 256))


def build_requests(
    df: DataFrame,
    model: str,
    max_tokens: int | None = None,
    temperature: float = 0.0,
    response_format: str | None = None,
) -> DataFrame:
    """``custom_id, method, url, body`` from ``custom_id``, ``user_content`` and, when present,
    ``system_content``."""
    turn = lambda role, c: F.struct(
        F.lit(role).alias("role"), F.col(c).alias("content")
    )
    turns = [turn("user", "user_content")]
    if "system_content" in df.columns:
        turns.insert(0, turn("system", "system_content"))
    body = [F.lit(model).alias("model"), F.array(*turns).alias("messages")]
    if max_tokens is not None:
        body.append(F.lit(max_tokens).alias("max_tokens"))
    body.append(F.lit(float(temperature)).alias("temperature"))
    if response_format is not None:
        body.append(F.struct(F.lit(response_format).alias("type")).alias("response_format"))
    carried = [c for c in ("row_idx", "shard") if c in df.columns]
    return df.select(
        *carried,
        "custom_id",
        F.lit("POST").alias("method"),
        F.lit(ENDPOINT).alias("url"),
        F.struct(*body).alias("body"),
    )


def token_accounting(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Estimated against reported prompt tokens."""
    return df.groupBy(*by).agg(
        F.sum("token_stats.truncated.num_total_tokens").alias("estimated_prompt_token_count"),
        F.sum("response.prompt_token_count").alias("actual_prompt_token_count"),
    )


# ------------------------------------------------------------------ D18: instruction prompts

# The demonstration schemes one of which is drawn per row, as
# (definition, positive examples, negative examples, explanations).
SCHEMES = (
    (True, 0, 0, False),
    (False, 2, 0, False),
    (True, 2, 0, False),
    (True, 2, 2, False),
    (True, 2, 0, True),
)


# The wording of the instruction prompt.
ASK, DEFINITION = "Now complete the following example -\n", "Definition: "
INPUT, OUTPUT, EXPLANATION = "Input: ", "Output: ", "Explanation: "
POSITIVE, NEGATIVE = "Positive", "Negative"


def _closed(c: Column) -> Column:
    """Text that ends in punctuation."""
    return F.when(tx.ascii_punct_end(c), c).otherwise(F.concat(c, F.lit(".")))


def _demonstrations(examples: Column, kind: str, explain: Column) -> Column:
    def text(e: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        why = F.concat(
            _closed(F.concat(F.lit(f" {EXPLANATION}"), tx.strip(e["explanation"]))), F.lit("\n")
        )
        return F.concat(
            F.lit(f" {kind} Example "),
            number,
            F.lit(" -\n"),
            _closed(F.concat(F.lit(INPUT), tx.strip(e["input"]))),
            F.lit("\n"),
            _closed(F.concat(F.lit(f" {OUTPUT}"), tx.strip(e["output"]))),
            F.lit("\n"),
            F.coalesce(F.when(explain, why), F.lit("")),
            F.lit("\n"),
        )

    none = F.array().cast("array<struct<input:string,output:string,explanation:string>>")
    return F.transform(F.coalesce(examples, none), text)


def _fitting(examples: Column, head: Column, tail: Column, max_src: int, scheme: str) -> Column:
    """The leading examples that fit the budget together; the first misfit ends the list."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("open"))

    def step(state: Column, e: Column) -> Column:
        whole = F.concat(head, F.array_join(state["kept"], " "), e, tail)
        fits = state["open"] & (tx.token_count(whole, scheme) <= max_src)
        return F.struct(
            F.when(fits, F.concat(state["kept"], F.array(e)))
            .otherwise(state["kept"])
            .alias("kept"),
            fits.alias("open"),
        )

    return F.aggregate(examples, start, step, lambda s: s["kept"])


def instruction_prompt(
    df: DataFrame,
    max_src: int,
    n_pos: int = 0,
    n_neg: int = 0,
    add_name: bool = False,
    add_definition: bool = True,
    add_explanation: bool = False,
    random_scheme: bool = False,
    id_cols: Sequence[str] = ("id",),
    seed: int = 0,
    scheme: str = "pieces",
) -> DataFrame:
    """``source`` (and ``label``) from ``task, definition, input, outputs, positive, negative``.

    The two example columns are ``array<struct<input,output,explanation>>``. Random choices are
    hashes of the row id and ``seed``.
    """
    draw = lambda n, salt: F.pmod(
        F.xxhash64(*[F.col(c) for c in id_cols], F.lit(seed), F.lit(salt)), n
    ).cast("int")
    if random_scheme:
        at = draw(F.lit(len(SCHEMES)), "scheme")
        use_def, pos_n, neg_n, explain = (
            F.get(F.array(*[F.lit(s[k]) for s in SCHEMES]), at) for k in range(4)
        )
        use_name = F.lit(False)
    else:
        use_def, pos_n, neg_n, explain, use_name = map(
            F.lit, (add_definition, n_pos, n_neg, add_explanation, add_name)
        )
    ask = F.concat(
        F.lit(ASK),
        _closed(F.concat(F.lit(INPUT), tx.strip(F.col("input")))),
        F.lit(f"\n{OUTPUT}"),
    )
    definition = F.concat(
        _closed(F.concat(F.lit(DEFINITION), tx.strip(F.col("definition")))), F.lit("\n\n")
    )
    staged = (
        df.withColumn("__ask", ask)
        .withColumn("__def", F.when(use_def, definition).otherwise(F.lit("")))
        .withColumn("__explain", explain)
        .withColumn("__name", F.when(use_name, F.concat("task", F.lit(". "))).otherwise(F.lit("")))
        .withColumn(
            "__pos",
            _fitting(
                _demonstrations(
                    F.slice("positive", F.lit(1), pos_n), POSITIVE, F.col("__explain")
                ),
                F.col("__def"),
                F.col("__ask"),
                max_src,
                scheme,
            ),
        )
        .withColumn(
            "__neg",
            _fitting(
                _demonstrations(
                    F.slice("negative", F.lit(1), neg_n), NEGATIVE, F.col("__explain")
                ),
                F.concat(F.col("__def"), F.array_join("__pos", " ")),
                F.col("__ask"),
                max_src,
                scheme,
            ),
        )
    )
    source = F.concat(
        "__name", "__def", F.array_join("__pos", ""), F.array_join("__neg", ""), "__ask"
    )
    cut = tx.detokenize(tx.take(tx.tokens(source, scheme), max_src), scheme)
    out = staged.withColumn("source", cut)
    if "outputs" in df.columns:
        n = F.size("outputs")
        out = out.withColumn("label", F.get("outputs", draw(F.greatest(n, F.lit(1)), "label")))
    return out.drop("__ask", "__def", "__explain", "__name", "__pos", "__neg")
