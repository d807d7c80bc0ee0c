"""Queries for sources (A), filters (B), change text (C), joins (E), sampling (F) and order (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes, filters, merge, rows, sampling
from ..session import scratch_path
from ..sources import files
from ..sources.materialize import materialize
from . import views as v
from .registry import Registry

R = Registry()

SCALARS = "doc_id, language, repo, message, cast(len(mods) as integer) as n_mods"


def scalars(df):
    return df.select("doc_id", "language", "repo", "message", F.size("mods").alias("n_mods"))


# ---------------------------------------------------------------- A: sources and sinks

VIEW_SCHEMA = (
    "doc_id bigint, language string, repo string, message string, mods array<struct<"
    "change_type:string,old_path:string,new_path:string,diff:string>>"
)


def _split(c="doc_id"):
    return (
        F.when(F.col(c) % 10 == 0, F.lit("test"))
        .when(F.col(c) % 10 == 1, F.lit("validation"))
        .otherwise(F.lit("train"))
    )


SPLIT_SQL = (
    "case when doc_id%10=0 then 'test' when doc_id%10=1 then 'validation' else 'train' end"
)


@R.add("a1_read_commits", v.with_sql(f"select {SCALARS} from commits where doc_id%10=1", "commits"))
def a1(spark, sf):
    path = files.write_splits(
        v.commits(spark, sf).withColumn("split", _split()), scratch_path(spark, "a1")
    )
    return scalars(files.read_commits(spark, path, "validation", VIEW_SCHEMA))


@R.add(
    "a2_a3_jsonl",
    v.with_sql(
        "select doc_id, message, mods[1].change_type as first_type, mods[1].diff as first_diff,"
        " cast(len(mods) as integer) as n_mods from commits",
        "commits",
    ),
)
def a2(spark, sf):
    path = files.write_jsonl(v.commits(spark, sf), scratch_path(spark, "jsonl"))
    back = files.read_jsonl(spark, path, VIEW_SCHEMA)
    first = F.get("mods", F.lit(0))
    return back.select(
        "doc_id",
        "message",
        first["change_type"].alias("first_type"),
        first["diff"].alias("first_diff"),
        F.size("mods").alias("n_mods"),
    )


@R.add(
    "a4_splits",
    v.with_sql(
        f"select {SPLIT_SQL} as split, count(*) as n, cast(sum(length(message)) as bigint)"
        " as chars from commits group by 1",
        "commits",
    ),
)
def a4(spark, sf):
    path = files.write_splits(
        v.commits(spark, sf).withColumn("split", _split()), scratch_path(spark, "splits")
    )
    return (
        spark.read.parquet(path)
        .groupBy(F.col("split").cast("string").alias("split"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("message")).alias("chars"))
    )


@R.add("a5_csv", v.with_sql("select doc_id, message, diff from rendered", "rendered"))
def a5(spark, sf):
    df = changes.render_diff(v.commits(spark, sf)).select("doc_id", "message", "diff")
    path = files.write_csv(df, scratch_path(spark, "csv"), bom=True)
    return files.read_csv(spark, path, df.schema)


@R.add("a6_table_json", v.with_sql("select id, target, model_a from predictions", "predictions"))
def a6(spark, sf):
    p = v.predictions(spark, sf)
    # One header-plus-rows document per stored file, about a thousand rows each.
    doc = F.struct(
        F.array(F.lit("target"), F.lit("id"), F.lit("model_a")).alias("columns"),
        F.collect_list(F.array("target", F.col("id").cast("string"), "model_a")).alias("data"),
    )
    path = scratch_path(spark, "tablejson")
    (
        p.groupBy(F.floor(F.col("id") / 50_000_000).alias("file"))
        .agg(F.to_json(doc).alias("value"))
        .repartition("file")
        .write.partitionBy("file")
        .text(path)
    )
    return files.read_table_json(spark, path, "id bigint, target string, model_a string")


@R.add(
    "a7_model_outputs",
    v.with_sql(
        "select model_a as generated_commit, target as reference_commit from predictions",
        "predictions",
    ),
)
def a7(spark, sf):
    p = v.predictions(spark, sf)
    rec = F.struct(
        F.concat(F.lit("  "), "model_a", F.lit("\n")).alias("generated_commit"),
        F.concat("target", F.lit(" ")).alias("reference_commit"),
    )
    path = scratch_path(spark, "outputs")
    (
        p.groupBy(F.floor(F.col("id") / 50_000_000).alias("file"))
        .agg(F.to_json(F.collect_list(rec)).alias("value"))
        .repartition("file")
        .write.partitionBy("file")
        .text(path)
    )
    return files.read_model_outputs(spark, path)


def stored_responses(spark, sf):
    message = F.struct(F.lit("assistant").alias("role"), F.col("content"))
    body = F.struct(F.array(F.struct(message.alias("message"))).alias("choices"))
    rows_ = v.responses(spark, sf).select(
        "file_no", "line_no", "custom_id", F.struct(body.alias("body")).alias("response")
    )
    path = scratch_path(spark, "responses")
    (
        rows_.repartition("file_no")
        .sortWithinPartitions("file_no", "line_no")
        .drop("line_no")
        .write.partitionBy("file_no")
        .json(path)
    )
    return path


@R.add("a8_responses", v.with_sql("select custom_id, content from responses", "responses"))
def a8(spark, sf):
    path = stored_responses(spark, sf)
    return files.read_responses(spark, f"{path}/*").select("custom_id", "content")


@R.add(
    "a9_request_shards",
    v.with_sql(
        "select lpad(cast((row_number() over (order by doc_id)-1)//64*64 as varchar),6,'0')"
        " as shard, doc_id, message from commits",
        "commits",
    ),
)
def a9(spark, sf):
    sharded = rows.shard_fixed(v.commits(spark, sf).select("doc_id", "message"), 64, ["doc_id"])
    path = files.write_request_shards(sharded, scratch_path(spark, "shards"))
    return files.read_jsonl(spark, path, "doc_id bigint, message string, shard string")


@R.add("a10_materialize", v.with_sql("select doc_id, length(diff) as n from rendered", "rendered"))
def a10(spark, sf):
    def build():
        return changes.render_diff(v.commits(spark, sf)).select(
            "doc_id", F.length("diff").cast("bigint").alias("n")
        )

    root = scratch_path(spark, "materialized")
    config = {"languages": ["en"], "diff_line_sep": "\n"}
    materialize(spark, build, root, config)
    # The second call finds the finished table and does not build.
    return materialize(spark, lambda: spark.range(0).toDF("never"), root, config)


@R.add(
    "a11_text_log",
    v.with_sql(
        "select s.step, p.id, p.target from (select * from predictions order by id limit 100) p,"
        " (select unnest([1,2]) as step) s",
        "predictions",
    ),
)
def a11(spark, sf):
    path = scratch_path(spark, "log")
    logged = v.predictions(spark, sf).select("id", "target")
    for step in (1, 2):
        files.append_text_log(logged, path, step, ["id"], num_results=100)
    return spark.read.parquet(path)


@R.add(
    "a12_write_metrics",
    "select 'each' as kind, cast(doc_id as varchar) as name, length(text) as value from documents union all"
    " select 'total', lang, cast(sum(length(text)) as bigint) from documents group by lang",
)
def a12(spark, sf):
    path = scratch_path(spark, "metrics")
    d = v.table(spark, sf, "documents").select("doc_id", "lang", F.length("text").cast("bigint").alias("value"))
    total = d.groupBy("lang").agg(F.sum("value").alias("value"))
    files.write_metrics(total, d.select("doc_id", "value"), path)

    def stored(kind):
        # The byte-order mark stands before the first column's name.
        return spark.read.schema("name string, value bigint").csv(f"{path}_{kind}", header=True).select(F.lit(kind).alias("kind"), "name", "value")

    return stored("each").unionByName(stored("total"))


# ---------------------------------------------------------------- B: filters


@R.add("b10_guards", v.with_sql(f"select {SCALARS} from commits", "commits"))
def b10(spark, sf):
    c = filters.require_non_empty(v.commits(spark, sf))
    filters.require_placeholders("{language}: {message}", ["language", "message"])
    return scalars(filters.require_columns(c, ["language", "message", "mods"]))


@R.add("b1_languages", v.with_sql(f"select {SCALARS} from commits where language in ('en','de')", "commits"))
def b1(spark, sf):
    return scalars(filters.filter_languages(v.commits(spark, sf), ["en", "de"]))


def _all_sql(types: str) -> str:
    return f"len(list_filter(mods, lambda m: m.change_type not in ({types})))=0"


@R.add("b2_change_types", v.with_sql(f"select {SCALARS} from commits where " + _all_sql("'ADD','MODIFY'"), "commits"))
def b2(spark, sf):
    return scalars(filters.filter_change_types(v.commits(spark, sf), ["ADD", "MODIFY"]))


@R.add(
    "b3_commits",
    v.with_sql(
        f"select {SCALARS} from commits where language='en' and " + _all_sql("'ADD','MODIFY','RENAME'"),
        "commits",
    ),
)
def b3(spark, sf):
    return scalars(filters.filter_commits(v.commits(spark, sf), ["en"], ["ADD", "MODIFY", "RENAME"]))


@R.add("b4_only_add", v.with_sql(f"select {SCALARS} from commits where " + _all_sql("'ADD'"), "commits"))
def b4(spark, sf):
    return scalars(filters.only_change_type(v.commits(spark, sf), "ADD"))


@R.add(
    "b5_cap_modify_only",
    v.with_sql(
        f"select {SCALARS}, 0 as part from commits where len(list_filter(mods, lambda m: m.change_type='MODIFY'))=0"
        f" union all select {SCALARS}, 1 from (select *, row_number() over (order by doc_id) as rn,"
        " count(*) over () as n from commits where " + _all_sql("'MODIFY'") + ") where rn<=ceil(n*0.1)",
        "commits",
    ),
)
def b5(spark, sf):
    out = filters.cap_modify_only(v.commits(spark, sf), 0.1, ["doc_id"])
    return out.select(
        "doc_id", "language", "repo", "message", F.size("mods").alias("n_mods"), "part"
    )


@R.add(
    "b6_exact_length",
    "select doc_id, len(string_split(text, chr(10))) as n from documents"
    " where len(string_split(text, chr(10)))=5",
)
def b6(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    kept = filters.filter_exact_length(d, "lines", 5)
    return kept.select("doc_id", F.size("lines").cast("bigint").alias("n"))


@R.add(
    "b7_drop_null",
    "select d.doc_id, quality from documents d left join labels l using (doc_id)"
    " where quality is not null",
)
def b7(spark, sf):
    joined = v.table(spark, sf, "documents").select("doc_id").join(
        v.table(spark, sf, "labels"), "doc_id", "left"
    )
    return filters.drop_null(joined, "quality").select("doc_id", "quality")


@R.add(
    "b8_skip_completed",
    "select * from (select doc_id, (row_number() over (order by doc_id)-1)//8 as batch_id"
    " from documents) where batch_id>=20",
)
def b8(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id")
    return filters.skip_completed(rows.assign_batches(d, 8, ["doc_id"]), 20)


def _with_bad_scores():
    return (
        "select example_id, pos, list_transform(scores, lambda x, i: case"
        " when i=1 and pos=3 and example_id%2=0 then 'NaN'::double"
        " when i=2 and pos=4 and example_id%3=0 then '-Infinity'::double else x end) as scores from ranked"
    )


@R.add(
    "b9_valid_scores",
    v.with_sql(
        "select example_id, pos from bad where len(list_filter(scores, lambda x:"
        " isnan(x) or isinf(x)))=0",
        "ranked",
        bad=_with_bad_scores(),
    ),
)
def b9(spark, sf):
    hit = lambda p, k: (F.col("pos") == p) & (F.col("example_id") % k == 0)
    bad = v.ranked(spark, sf).withColumn(
        "scores",
        F.transform(
            "scores",
            lambda x, i: F.when((i == 0) & hit(3, 2), F.lit(float("nan")))
            .when((i == 1) & hit(4, 3), F.lit(float("-inf")))
            .otherwise(x),
        ),
    )
    return filters.drop_invalid_scores(bad, "scores").select("example_id", "pos")


# ---------------------------------------------------------------- C: change text


@R.add("c1_render_diff", v.with_sql("select doc_id, diff from rendered", "rendered"))
def c1(spark, sf):
    return changes.render_diff(v.commits(spark, sf), strict=True).select("doc_id", "diff")


@R.add("c2_processed", v.with_sql("select diff, message as msg, repo from rendered", "rendered"))
def c2(spark, sf):
    return changes.to_processed(v.commits(spark, sf))


@R.add(
    "c3_clean_diff",
    v.with_sql(
        "select doc_id, regexp_replace(array_to_string(list_transform(lines[coalesce(list_max("
        "list_transform(lines, lambda x, i: case when starts_with(x,'@@') and ends_with(x,'@@')"
        " then i else 0 end)),0)+1:], lambda x: x||chr(10)),''), '[^\\S\\n]+', ' ', 'g') as cleaned"
        " from (select doc_id, list_filter(list_transform(string_split(raw,chr(10)), lambda x:"
        " trim(x, ' '||chr(9)||chr(13))), lambda x: x<>'') as lines from raw_diffs)",
        "raw_diffs",
    ),
)
def c3(spark, sf):
    return v.raw_diffs(spark, sf).select("doc_id", changes.clean_diff(F.col("raw")).alias("cleaned"))


@R.add(
    "c4_name_status",
    v.with_sql(
        "select doc_id, cast(i-1 as integer) as line_no, case substr(p[1],1,1) when 'A' then 'ADD' when 'M' then"
        " 'MODIFY' when 'D' then 'DELETE' when 'R' then 'RENAME' end as change_type,"
        " p[2] as old_path, p[-1] as new_path from (select doc_id,"
        " unnest(list_transform(string_split(ns,chr(10)), lambda x: string_split(x,chr(9)))) as p,"
        " generate_subscripts(string_split(ns,chr(10)),1) as i from name_status)",
        "name_status",
    ),
)
def c4(spark, sf):
    return changes.parse_name_status(v.name_status(spark, sf), "ns")


@R.add("c5_stringify", v.with_sql("select cast(doc_id as varchar) as doc_id, cast(to_json(mods) as varchar) as mods from commits", "commits"))
def c5(spark, sf):
    return changes.stringify(v.commits(spark, sf).select("doc_id", "mods"), "doc_id", "mods")


@R.add("c6_project", "select source as repo, doc_id, lang as language from documents")
def c6(spark, sf):
    return changes.project(
        v.table(spark, sf, "documents"),
        keep=["source", "doc_id", "lang"],
        drop=["text"],
        rename={"source": "repo", "lang": "language"},
    )


@R.add("c7_lengths", "select doc_id, cast(length(text) as integer) as text_length from documents")
def c7(spark, sf):
    return changes.with_length(v.table(spark, sf, "documents"), "text").select(
        "doc_id", "text_length"
    )


NAMES_SQL = "select lower(replace(r_name, ' ', '_')) as fn, r_name as msg, r_regionkey as k from region"


@R.add(
    "c8_synthetic_commits",
    "with f as (select p_name || '_' || p_partkey || '.py' as file_name from part)"
    " select file_name, row_number() over (partition by file_name order by fn.k, msg.k) as version,"
    " 'def '||fn.fn||'():'||chr(10)||'    print(\"'||msg.msg||'\")'||chr(10) as commit_diff,"
    f" 'Added function to print \"'||msg.msg||'\"' as commit_message from f, ({NAMES_SQL}) fn, ({NAMES_SQL}) msg",
)
def c8(spark, sf):
    parts = v.table(spark, sf, "part")
    name = F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".py"))
    # The operator's two lists are short parameters: the names of the regions.
    regions = [r["r_name"] for r in v.table(spark, sf, "region").orderBy("r_regionkey").collect()]
    functions = [r.lower().replace(" ", "_") for r in regions]
    return changes.synth_commits(parts.select(name.alias("file_name")), functions, regions)


# ---------------------------------------------------------------- E: joins

LATEST_SQL = (
    "select custom_id, content from (select *, row_number() over (partition by custom_id"
    " order by file_no desc, line_no desc) as rn from responses) where rn=1"
)


@R.add(
    "e1_merge_responses",
    v.with_sql(
        "select doc_id, content as message from commits join latest on 'r'||doc_id=custom_id",
        "commits",
        "responses",
        latest=LATEST_SQL,
    ),
)
def e1(spark, sf):
    asked = v.commits(spark, sf).select(
        "doc_id", "message", F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("custom_id")
    )
    answers = files.read_responses(spark, f"{stored_responses(spark, sf)}/*")
    return merge.merge_responses(asked, answers).select("doc_id", "message")


@R.add(
    "e2_merge_by_position",
    v.with_sql(
        "select c.row_idx, c.language, c.repo, d.doc_id, d.message from (select language, repo,"
        " row_number() over (order by doc_id)-1 as row_idx from commits) c join (select doc_id,"
        " 'answer '||n_chars as message, row_number() over (order by n_chars, doc_id)-1 as row_idx"
        " from documents) d using (row_idx)",
        "commits",
    ),
)
def e2(spark, sf):
    left = v.commits(spark, sf).select(F.col("doc_id").alias("k"), "language", "repo", "message")
    right = v.table(spark, sf, "documents").select(
        "doc_id",
        "n_chars",
        F.concat(F.lit("answer "), F.col("n_chars").cast("string")).alias("message"),
    )
    merged = merge.merge_by_position(
        left, right, ["doc_id", "message"], ["k"], ["n_chars", "doc_id"], drop=["message"]
    )
    return merged.drop("k")


def _experiment(p, col):
    return p.select(
        F.col("id").alias("row_idx"),
        F.col("split").alias("input"),
        F.col(col).alias("prediction"),
        "target",
    )


@R.add(
    "e3_combine_predictions",
    v.with_sql("select id as row_idx, split as input, model_a, model_b, target from predictions", "predictions"),
)
def e3(spark, sf):
    p = v.predictions(spark, sf)
    return merge.combine_predictions({m: _experiment(p, m) for m in ("model_a", "model_b")})


@R.add(
    "e5_align_vocab",
    "with w as (select lang, unnest(list_filter(string_split(text,' '), lambda x: x<>'')) as word from documents)"
    " select word, sum(case when lang='en' then 1 else 0 end)::bigint as n_a,"
    " sum(case when lang='de' then 1 else 0 end)::bigint as n_b from w where lang in ('en','de') group by 1",
)
def e5(spark, sf):
    w = v.table(spark, sf, "documents").select("lang", F.explode(F.split("text", " ")).alias("word"))
    w = w.filter("word <> ''")
    count = lambda lang: w.filter(F.col("lang") == lang).groupBy("word").agg(F.count("*").alias("n"))
    return merge.align_vocab(count("en"), count("de"))


@R.add(
    "e6_pending",
    v.with_sql(
        "select 'r'||doc_id as batch_id, doc_id from commits where 'r'||doc_id not in"
        " (select custom_id from responses where content<>'')",
        "commits",
        "responses",
    ),
)
def e6(spark, sf):
    asked = v.commits(spark, sf).select(
        F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("batch_id"), "doc_id"
    )
    done = v.responses(spark, sf).withColumnRenamed("custom_id", "batch_id")
    return merge.pending(asked, done)


# ---------------------------------------------------------------- F: sampling and unions


@R.add(
    "f1_concat",
    "select doc_id as id, text, 0 as part from documents union all"
    " select item_id, text, 1 from benchmark",
)
def f1(spark, sf):
    d = v.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    b = v.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return merge.concat([d, b])


def drawn(seed: int, n: str) -> str:
    """The first ``n`` commits in the order of the seeded hash."""
    return f"select {SCALARS} from commits order by md5(doc_id||'|{seed}'), doc_id limit {n}"


@R.add("f2_sample_n", v.with_sql(drawn(42, "300"), "commits"))
def f2(spark, sf):
    return scalars(sampling.sample_n(v.commits(spark, sf), 300, ["doc_id"], seed=42))


@R.add(
    "f3_sample_like",
    v.with_sql(
        drawn(7, "(select count(*) from commits where len(list_filter(mods, lambda m: m.change_type<>'ADD'))=0)"), "commits"
    ),
)
def f3(spark, sf):
    c = v.commits(spark, sf)
    return scalars(sampling.sample_like(c, filters.only_change_type(c, "ADD"), ["doc_id"], seed=7))


@R.add(
    "f4_pick_row",
    v.with_sql(f"select {SCALARS} from commits order by doc_id limit 1 offset 17", "commits"),
)
def f4(spark, sf):
    return scalars(sampling.pick_row(v.commits(spark, sf), 17, ["doc_id"]))


@R.add("f5_head", v.with_sql(f"select {SCALARS} from commits order by doc_id limit 100", "commits"))
def f5(spark, sf):
    return scalars(sampling.head_n(v.commits(spark, sf), 100, ["doc_id"]))


@R.add(
    "f6_split_random",
    v.with_sql(
        "select doc_id, case when row_number() over (order by md5(doc_id||'|3'), doc_id) <= floor(0.2*count(*) over ())"
        " then 'test' else 'train' end as split from commits",
        "commits",
    ),
)
def f6(spark, sf):
    return sampling.split_random(v.commits(spark, sf), 0.2, ["doc_id"], seed=3).select("doc_id", "split")


# ---------------------------------------------------------------- G: order


@R.add(
    "g1_row_index",
    "select l_orderkey, l_linenumber, row_number() over (order by l_orderkey, l_linenumber)-1"
    " as row_idx from lineitem",
)
def g1(spark, sf):
    li = v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return rows.with_row_index(li, ["l_orderkey", "l_linenumber"])


@R.add("g2_batches", v.with_sql("select doc_id, (row_number() over (order by doc_id)-1)//32 as batch_id from commits", "commits"))
def g2(spark, sf):
    return rows.assign_batches(v.commits(spark, sf).select("doc_id"), 32, ["doc_id"])


@R.add(
    "g5_running_tokens",
    v.with_sql(
        "select *, cast(sum(tokens) over (partition by run, split, epoch order by step) as bigint)"
        " as tokens_so_far from steps",
        "steps",
    ),
)
def g5(spark, sf):
    return rows.running_tokens(v.steps(spark, sf))


@R.add(
    "g7_extremes",
    v.with_sql(
        "select 'shortest' as kind, doc_id, message, n from x where (n, doc_id) = (select (n, doc_id) from x order by n, doc_id limit 1)"
        " union all select 'longest', doc_id, message, n from x where doc_id=(select doc_id from x order by n desc, doc_id limit 1)",
        "commits",
        x="select doc_id, message, cast(length(message) as integer) as n from commits",
    ),
)
def g7(spark, sf):
    c = v.commits(spark, sf).select("doc_id", "message", F.length("message").alias("n"))
    out = rows.extremes(c, "n", "doc_id", ["message"])
    return out.select("kind", "doc_id", "message", "n")
