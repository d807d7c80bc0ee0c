import pytest
from pyspark.sql import functions as F

from commitflow.operators import changes, filters, prompts
from commitflow.sources.schemas import MOD

M = ("MODIFY", "src/a.py", "src/a.py", "-x[NL]+y[NL]")
A = ("ADD", None, "src/b.py", "+new[NL]")
D = ("DELETE", "src/c.py", None, "-old[NL]")
R = ("RENAME", "src/d.py", "src/e.py", "")
C = ("COPY", "src/f.py", "src/g.py", "+c[NL]")
U = ("UNKNOWN", "x", "y", "zzz")

CASES = [
    ([M], "src/a.py[NL]-x[NL]+y[NL]"),
    ([A], "new file src/b.py[NL]+new[NL]"),
    ([D], "deleted file src/c.py[NL]-old[NL]"),
    ([R], "rename from src/d.py[NL]rename to src/e.py[NL]"),
    ([C], "copy from src/f.py[NL]copy to src/g.py[NL]+c[NL]"),
    ([U], ""),
    ([], ""),
    ([M, U, A], "src/a.py[NL]-x[NL]+y[NL]new file src/b.py[NL]+new[NL]"),
    ([("ADD", None, None, "d")], "new file None[NL]d"),
    ([("ODD", "a", "b", "d")], "b[NL]d"),
]


def mods_frame(spark, cases):
    return spark.createDataFrame(list(enumerate(cases)), f"id int, mods array<{MOD}>")


def test_render_diff(spark):
    df = changes.render_diff(mods_frame(spark, [c for c, _ in CASES]), "[NL]")
    assert [r["diff"] for r in df.orderBy("id").collect()] == [w for _, w in CASES]


def test_render_diff_strict(spark):
    df = changes.render_diff(mods_frame(spark, [[("ODD", "a", "b", "d")]]), strict=True)
    with pytest.raises(Exception, match="unexpected change type"):
        df.collect()


def test_clean_diff(spark):
    texts = [
        "diff --git a b\n@@ -1 +1 @@\n  a\t b \n\n+c",
        "no marker\n  x   y",
        "@@ -1 @@ def f():\nbody",
        "a\n@@ 1 @@\n@@ 2 @@",
        "",
    ]
    want = ["a b\n+c\n", "no marker\nx y\n", "@@ -1 @@ def f():\nbody\n", "", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = df.select("id", changes.clean_diff(F.col("t")).alias("o")).orderBy("id").collect()
    assert [r["o"] for r in got] == want


def test_name_status(spark):
    df = spark.createDataFrame([(1, "A\tx\nR100\ta\tb\nM\tm")], "id int, ns string")
    got = changes.parse_name_status(df, "ns").orderBy("line_no").collect()
    assert [(r["change_type"], r["old_path"], r["new_path"]) for r in got] == [
        ("ADD", "x", "x"), ("RENAME", "a", "b"), ("MODIFY", "m", "m"),
    ]
    odd = spark.createDataFrame([(1, "C100\ta\tb")], "id int, ns string")
    with pytest.raises(Exception, match="unknown change type"):
        changes.parse_name_status(odd, "ns").collect()
    assert changes.parse_name_status(odd, "ns", "permissive").first()["change_type"] == "UNKNOWN"


def test_synthetic_commits_cover_the_product(spark):
    files = spark.createDataFrame([("a.py",), ("b.py",)], "file_name string")
    got = changes.synth_commits(files, ["f", "g"], ["one", "two", "three"])
    assert got.count() == 12
    first = got.filter("file_name = 'b.py' and version = 5").first()
    assert first["commit_diff"] == 'def g():\n    print("two")\n'
    assert first["commit_message"] == 'Added function to print "two"'


def test_filters(spark):
    rows = [("en", [M]), ("en", [A]), ("de", [M, A]), ("en", []), ("fr", [M]), ("en", [M])]
    df = spark.createDataFrame(
        [(i, lang, m) for i, (lang, m) in enumerate(rows)], f"id int, language string, mods array<{MOD}>"
    )
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(filters.filter_languages(df, None)) == [0, 1, 2, 3, 4, 5]
    assert ids(filters.filter_languages(df, [], empty_passes=False)) == []
    assert ids(filters.filter_change_types(df, ["ADD"])) == [1, 3]
    assert ids(filters.filter_commits(df, ["en"], ["MODIFY"])) == [0, 3, 5]
    assert ids(filters.only_change_type(df, "MODIFY")) == [0, 3, 4, 5]
    # MODIFY-only: 0, 3 (no changes), 4, 5; half of them are 0 and 3.
    assert ids(filters.cap_modify_only(df, 0.5, ["id"])) == [0, 1, 3]
    assert ids(filters.cap_modify_only(df, 0.5, ["id"], dedupe_empty=False)) == [0, 1, 3, 3]
    assert ids(filters.cap_modify_only(df, 0.5, ["id"], types=["ADD"])) == [0, 1, 2, 3, 4, 5]


def test_guards(spark):
    with pytest.raises(ValueError):
        filters.require_non_empty(spark.range(0))
    with pytest.raises(ValueError):
        filters.require_placeholders("{diff}", ["diff", "message"])
    with pytest.raises(ValueError):
        filters.require_columns(spark.range(1), ["system_content"])


def test_prompt_values_are_not_scanned_again(spark):
    df = spark.createDataFrame([("has {message} and {{", "m")], "diff string, message string")
    out = prompts.render_prompt(
        df, "A {diff} B {message} {{x}}", {"diff": "diff", "message": "message"}
    )
    assert out.first()["prompt"] == "A has {message} and {{ B m {x}"


def test_budget(spark):
    df = spark.createDataFrame([("a b c d e f", "one two three")], "diff string, message string")
    out = prompts.truncate_to_budget(df, "{diff}|{message}", 20, 2, "s", stats=True).first()
    # Overhead: 2 * 3 + 3, the words system, s, user and the bar.
    assert out["user_content"] == "a b c d e|one two"
    stats = out["token_stats"]
    assert stats["original"]["num_total_tokens"] == 6 + 3 + 13
    assert stats["truncated"]["num_total_tokens"] == 20
    with pytest.raises(Exception, match="no token budget"):
        prompts.truncate_to_budget(df, "{diff}|{message}", 10, 2, "s").collect()


def test_chat_tokens(spark):
    df = spark.sql(
        "select array(named_struct('role','system','content','a b','name',cast(null as string)),"
        "named_struct('role','user','content','c, d','name','bob')) as m"
    )
    got = prompts.count_chat_tokens(df, "m").first()["num_tokens"]
    assert got == 3 + (3 + 1 + 2) + (3 + 1 + 3) + (1 + 1)


def test_costs(spark):
    out = prompts.estimate_cost(spark.range(3000), "deepseek-chat", 1000, 2_000_000).first()
    assert (round(out["cost"], 6), round(out["batch_cost"], 6), out["days"]) == (0.042, 0.021, 2)
    assert prompts.cost_text(0.0421) == "$0.042"
