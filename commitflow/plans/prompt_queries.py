"""Queries for prompts, budgets, requests and answers (D) and batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes, completion, prompts, rows
from . import views as v
from .registry import Registry

R = Registry()

SYSTEM = "You simplify commit messages."
TEMPLATE = 'Diff: {diff}\nMessage: {message}\nAnswer as {{"message": "..."}}'
DIFF_TEMPLATE = "Write a message for\n{diff}\n"
MAX_PROMPT, MAX_MSG = 1000, 16

# The word-piece pattern and token count as SQL.
PIECE_SQL = r"'\s*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])|\s+'"


def toks(x: str) -> str:
    return f"regexp_extract_all({x}, {PIECE_SQL})"


def ntok(x: str) -> str:
    return f"len({toks(x)})"


def lit(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"


def overhead(user: str) -> str:
    return (
        f"(9+{ntok(lit('system'))}+{ntok(lit(SYSTEM))}+{ntok(lit('user'))}+{ntok(lit(user))})"
    )


def rendered(spark, sf):
    return changes.render_diff(v.commits(spark, sf))


@R.add(
    "d1_render_prompt",
    v.with_sql(
        "select doc_id, 'Diff: '||diff||chr(10)||'Message: '||message||chr(10)||"
        "'Answer as {\"message\": \"...\"}' as prompt from rendered",
        "rendered",
    ),
)
def d1(spark, sf):
    out = prompts.render_prompt(
        rendered(spark, sf), TEMPLATE, {"diff": "diff", "message": "message"}
    )
    return out.select("doc_id", "prompt")


_D2 = (
    "select doc_id, m, d, least(len(m), 16) as nm, ov, "
    "1000-ov-least(len(m),16) as nd from (select doc_id, "
    f"{toks('message')} as m, {toks('diff')} as d, {overhead(TEMPLATE.format(diff='', message=''))} as ov from rendered)"
)


@R.add(
    "d2_truncate_to_budget",
    v.with_sql(
        "select doc_id, 'Diff: '||array_to_string(d[:nd],'')||chr(10)||'Message: '||"
        "array_to_string(m[:nm],'')||chr(10)||'Answer as {\"message\": \"...\"}' as user_content from cut",
        "rendered",
        cut=_D2,
    ),
)
def d2(spark, sf):
    out = prompts.truncate_to_budget(rendered(spark, sf), TEMPLATE, MAX_PROMPT, MAX_MSG, SYSTEM)
    return out.select("doc_id", "user_content")


@R.add(
    "d3_truncate_diff",
    v.with_sql(
        "select doc_id, array_to_string(d[:1000-ov],'') as diff, 'Write a message for'||chr(10)||"
        "array_to_string(d[:1000-ov],'')||chr(10) as user_content from cut",
        "rendered",
        cut=f"select doc_id, {toks('diff')} as d, {overhead(DIFF_TEMPLATE.format(diff=''))} as ov from rendered",
    ),
)
def d3(spark, sf):
    out = prompts.truncate_diff_to_budget(rendered(spark, sf), DIFF_TEMPLATE, MAX_PROMPT, SYSTEM)
    return out.select("doc_id", "diff", "user_content")


def with_stats(spark, sf):
    return prompts.truncate_to_budget(
        rendered(spark, sf), TEMPLATE, MAX_PROMPT, MAX_MSG, SYSTEM, stats=True
    )


@R.add(
    "d4_token_stats",
    v.with_sql(
        "select doc_id, cast(len(d) as integer) as diff_before, cast(len(m) as integer) as msg_before,"
        " cast(len(d)+len(m)+ov as integer) as total_before, cast(least(len(d),nd) as integer) as diff_after,"
        " cast(nm as integer) as msg_after, cast(least(len(d),nd)+nm+ov as integer) as total_after from cut",
        "rendered",
        cut=_D2,
    ),
)
def d4(spark, sf):
    s = lambda side, f: F.col(f"token_stats.{side}.num_{f}_tokens")
    return with_stats(spark, sf).select(
        "doc_id",
        *[s("original", f).alias(f"{f}_before") for f in ("diff", "msg", "total")],
        *[s("truncated", f).alias(f"{f}_after") for f in ("diff", "msg", "total")],
    )


def conversations(spark, sf):
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    # A conversation is one prompt; its turns are bounded by the chat format.
    return (
        v.table(spark, sf, "conversations")
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(turn)).alias("t"))
        .select(
            "conv_id",
            F.transform(
                "t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))
            ).alias("messages"),
        )
    )


@R.add(
    "d5_chat_tokens",
    "select conv_id, cast(sum(3+" + ntok("role") + "+" + ntok("text") + ")+3 as integer) as num_tokens"
    " from conversations group by 1",
)
def d5(spark, sf):
    out = prompts.count_chat_tokens(conversations(spark, sf), "messages")
    return out.select("conv_id", "num_tokens")


@R.add(
    "d5_chat_tokens_joined",
    "select conv_id, cast(" + ntok("string_agg(role||' '||text, ' ' order by turn)") + " as integer)"
    " as num_tokens from conversations group by 1",
)
def d5_joined(spark, sf):
    out = prompts.count_chat_tokens(conversations(spark, sf), "messages", mode="joined")
    return out.select("conv_id", "num_tokens")


@R.add(
    "d6_token_totals",
    v.with_sql(
        "select cast(sum(least(len(d),nd)+nm+ov) as bigint) as total_tokens,"
        " round(avg(least(len(d),nd)+nm+ov),6) as tokens_per_sample from cut",
        "rendered",
        cut=_D2,
    ),
)
def d6(spark, sf):
    return prompts.token_totals(with_stats(spark, sf)).withColumn(
        "tokens_per_sample", F.round("tokens_per_sample", 6)
    )


@R.add(
    "d7_estimate_cost",
    "select count(*)*1000 as max_tokens, round(0.075::double*count(*)*1000/1000000,9) as cost,"
    " round(0.075::double*count(*)*1000/1000000/2,9) as batch_cost,"
    " cast(ceil(count(*)*1000/2000000) as bigint) as days from documents",
)
def d7(spark, sf):
    out = prompts.estimate_cost(
        v.commits(spark, sf), "gpt-4o-mini-2024-07-18", MAX_PROMPT, 2_000_000
    )
    return out.withColumns({c: F.round(c, 9) for c in ("cost", "batch_cost")})


REQUEST_SQL = (
    "select sha256(doc_id||chr(31)||message) as custom_id, 'POST' as method,"
    " '/v1/chat/completions' as url, cast(to_json({'model':'m1','messages':[{'role':'system','content':"
    + lit(SYSTEM)
    + "},{'role':'user','content':'Diff: '||array_to_string(d[:nd],'')||chr(10)||'Message: '||"
    "array_to_string(m[:nm],'')||chr(10)||'Answer as {\"message\": \"...\"}'}],'max_tokens':300,"
    "'temperature':0.7::double}) as varchar) as body from cut join commits using (doc_id)"
)


@R.add("d8_build_requests", v.with_sql(REQUEST_SQL, "rendered", cut=_D2))
def d8(spark, sf):
    cut = prompts.truncate_to_budget(rendered(spark, sf), TEMPLATE, MAX_PROMPT, MAX_MSG, SYSTEM)
    asked = prompts.build_requests(
        prompts.with_request_id(cut, ["doc_id", "message"]), "m1", 300, 0.7
    )
    return asked.withColumn("body", F.to_json("body"))


@R.add(
    "d9_request_id",
    v.with_sql("select doc_id, sha256(doc_id||chr(31)||message) as custom_id from commits", "commits"),
)
def d9(spark, sf):
    return prompts.with_request_id(v.commits(spark, sf), ["doc_id", "message"]).select(
        "doc_id", "custom_id"
    )


@R.add(
    "d10_shards",
    v.with_sql(
        "select doc_id, row_number() over (order by doc_id)-1 as row_idx,"
        " lpad(cast((row_number() over (order by doc_id)-1)//200*200 as varchar),6,'0') as shard from commits",
        "commits",
    ),
)
def d10(spark, sf):
    size = rows.shard_size(200_000, MAX_PROMPT)
    return rows.shard_fixed(v.commits(spark, sf).select("doc_id"), size, ["doc_id"])


@R.add(
    "d11_token_batches",
    v.with_sql(
        "select doc_id, batch as batch_id from walk join numbered using (i)",
        recursive=True,
        numbered="select doc_id, row_number() over (order by doc_id) as i,"
        " len(regexp_extract_all(text, '[^\\s]+')) as n from documents",
        walk="select 1::bigint as i, 0::bigint as batch, 1::bigint as entries, n::bigint as tokens"
        " from numbered where i=1 union all select w.i+1,"
        " case when w.tokens+x.n>5000 or w.entries>=50 then batch+1 else batch end,"
        " case when w.tokens+x.n>5000 or w.entries>=50 then 1 else entries+1 end,"
        " case when w.tokens+x.n>5000 or w.entries>=50 then x.n else w.tokens+x.n end"
        " from walk w join numbered x on x.i=w.i+1",
    ),
)
def d11(spark, sf):
    from ..functions.text import words

    d = v.table(spark, sf, "documents").select("doc_id", F.size(words(F.col("text"))).alias("n"))
    out = rows.batch_by_tokens(d, ["doc_id"], "n", max_tokens=5000, max_entries=50)
    return out.select("doc_id", "batch_id")


@R.add(
    "d12_bisect",
    v.with_sql(
        "select doc_id, case when b in ('batch_0','batch_3') and n>1 then b||case when rn<=n//2"
        " then '_split_0' else '_split_1' end else b end as batch_id from (select doc_id, b,"
        " count(*) over (partition by b) as n, row_number() over (partition by b order by doc_id) as rn"
        " from numbered)",
        "commits",
        numbered="select doc_id, 'batch_'||((row_number() over (order by doc_id)-1)//75) as b from commits",
    ),
)
def d12(spark, sf):
    numbered = rows.assign_batches(v.commits(spark, sf).select("doc_id"), 75, ["doc_id"])
    batches = numbered.withColumn(
        "batch_id", F.concat(F.lit("batch_"), F.col("batch_id").cast("string"))
    )
    failed = batches.filter(F.col("batch_id").isin("batch_0", "batch_3")).select("batch_id")
    return rows.bisect_batches(batches, failed, "doc_id")


def stored_answers(spark, sf):
    """Judge answers as JSON text, some of them broken."""
    scores = F.format_string(
        '{"tiny_score": %d, "baseline_score": %d}', "tiny_score", "baseline_score"
    )
    return v.judge_results(spark, sf).select(
        "doc_id",
        F.when(F.col("doc_id") % 17 == 0, F.lit("sorry, no score")).otherwise(scores).alias("content"),
    )


@R.add(
    "d13_extract_completion",
    v.with_sql("select custom_id, content from responses", "responses"),
)
def d13(spark, sf):
    message = F.struct(
        F.lit("assistant").alias("role"), F.concat(F.lit("\n "), "content", F.lit(" ")).alias("content")
    )
    body = F.struct(F.array(F.struct(message.alias("message"))).alias("choices"))
    nested = v.responses(spark, sf).select("custom_id", F.struct(body.alias("body")).alias("response"))
    return completion.extract_completion(nested).select("custom_id", "content")


@R.add(
    "d14_parse_scores",
    v.with_sql(
        "select doc_id, case when doc_id%17=0 then null else tiny_score end as tiny_score,"
        " case when doc_id%17=0 then null else baseline_score end as baseline_score,"
        " case when doc_id%17=0 then 'sorry, no score' end as bad_json from judge_results",
        "judge_results",
    ),
)
def d14(spark, sf):
    out = completion.parse_scores(stored_answers(spark, sf), "tiny_score int, baseline_score int")
    return out.drop("content")


class FirstWordsCompleter:
    """Offline stand-in for a service: answers with the last words of the prompt."""

    def complete_chat(self, messages):
        words = messages[-1]["content"].split()
        return {
            "content": " " + " ".join(words[-8:]) + "\n",
            "prompt_token_count": sum(len(m["content"].split()) for m in messages),
            "response_token_count": min(8, len(words)),
        }


@R.add(
    "d15_completer",
    v.with_sql(
        "select doc_id, array_to_string(w[greatest(len(w)-7,1):],' ') as message,"
        " cast(len(w)+4 as integer) as prompt_token_count from"
        " (select doc_id, regexp_extract_all(diff||' '||message, '[^\\s]+') as w from rendered)",
        "rendered",
    ),
)
def d15(spark, sf):
    asked = rendered(spark, sf).select(
        "doc_id",
        F.lit(SYSTEM).alias("system_content"),
        F.concat("diff", F.lit(" "), "message").alias("user_content"),
    )
    out = completion.apply_completer(asked, FirstWordsCompleter)
    return out.select("doc_id", "message", F.col("response.prompt_token_count").alias("prompt_token_count"))


@R.add(
    "d16_count_mode",
    v.with_sql(
        "select id, cast(6+" + ntok("'user'") + "+" + ntok("'Rate '||model_a||' against '||target") + " as integer) as score from predictions",
        "predictions",
    ),
)
def d16(spark, sf):
    p = v.predictions(spark, sf)
    asked = prompts.render_prompt(
        p, "Rate {model} against {target}", {"model": "model_a", "target": "target"}, "user_content"
    )
    return completion.judge_or_count(asked, enabled=False).select("id", "score")


@R.add(
    "d17_token_accounting",
    v.with_sql(
        "select repo, cast(sum(least(len(d),nd)+nm+ov) as bigint) as estimated_prompt_token_count,"
        " cast(sum(least(len(d),nd)+nm+ov+doc_id%5) as bigint) as actual_prompt_token_count"
        " from cut join commits using (doc_id) group by 1",
        "rendered",
        cut=_D2,
    ),
)
def d17(spark, sf):
    reported = F.col("token_stats.truncated.num_total_tokens") + (F.col("doc_id") % 5)
    answered = with_stats(spark, sf).withColumn(
        "response", F.struct(reported.cast("int").alias("prompt_token_count"))
    )
    return prompts.token_accounting(answered, ["repo"])


@R.add("d18_instruction_prompt")
def d18(spark, sf):
    example = lambda m: F.struct(
        m["diff"].alias("input"), m["new_path"].alias("output"), m["change_type"].alias("explanation")
    )
    tasks = v.commits(spark, sf).select(
        "doc_id",
        F.col("repo").alias("task"),
        F.lit("Name the file that a change belongs to").alias("definition"),
        F.col("message").alias("input"),
        F.transform("mods", lambda m: m["new_path"]).alias("outputs"),
        F.transform("mods", example).alias("positive"),
        F.transform(F.reverse("mods"), example).alias("negative"),
    )
    out = prompts.instruction_prompt(
        tasks, max_src=512, random_scheme=True, id_cols=["doc_id"], seed=11
    )
    return out.select("doc_id", "source", "label")
