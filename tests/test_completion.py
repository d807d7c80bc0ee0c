import json
import os
import random
import sys
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from commitflow.functions.text import PIECE
from commitflow.operators import completion, merge, prompts
from commitflow.sources import files
from commitflow.sources.materialize import config_digest, materialize
from commitflow.streaming.ingest import ingest_responses_stream

# Workers cannot import this module; send its classes along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Flaky:
    """Fails twice, then answers."""

    def __init__(self):
        self.calls = 0

    def complete_chat(self, messages):
        self.calls += 1
        if self.calls % 3:
            raise RuntimeError("busy")
        return {
            "content": f" {messages[-1]['content'].upper()}\n",
            "prompt_token_count": len(messages),
            "response_token_count": 1,
        }


def test_completer_retries_and_strips(spark):
    df = spark.createDataFrame([("s", "fix it"), ("s", "add")], "system_content string, user_content string")
    out = completion.apply_completer(df, Flaky, sleep=lambda s: None)
    assert sorted(r["message"] for r in out.collect()) == ["ADD", "FIX IT"]
    assert {r["response"]["prompt_token_count"] for r in out.collect()} == {2}


def test_retries_give_up():
    waits = []

    def fail():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        completion.with_retries(fail, 6, sleep=waits.append)
    assert len(waits) == 5 and all(1 <= w <= 60 for w in waits)


def test_predictor(spark):
    df = spark.createDataFrame([("a b",), ("c",)], "input string")
    out = completion.apply_predictor(df, lambda: lambda xs: [x[::-1] for x in xs], batch=1)
    assert {r["prediction"] for r in out.collect()} == {"b a", "c"}


def test_strict_scores(spark):
    df = spark.createDataFrame([('{"score": 7}',), ("oops",)], "content string")
    out = completion.parse_scores(df).collect()
    assert [(r["score"], r["bad_json"]) for r in out] == [(7, None), (None, "oops")]
    with pytest.raises(Exception, match="not a score document"):
        completion.parse_scores(df, strict=True).collect()


class Judge:
    def complete_chat(self, messages):
        return {"content": json.dumps({"score": len(messages[-1]["content"])}),
                "prompt_token_count": 1, "response_token_count": 1}


def test_judge_mode(spark):
    df = spark.createDataFrame([("abc",)], "user_content string")
    assert completion.judge_or_count(df, True, Judge).first()["score"] == 3


def plain_instruction(row, max_src, n_pos, n_neg, explain):
    import regex

    size = lambda t: len(regex.findall(PIECE, t))
    close = lambda t: t if t[-1] in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else t + "."
    ask = "Now complete the following example -\n" + close(f"Input: {row['input'].strip()}") + "\nOutput: "
    head = close("Definition: " + row["definition"].strip()) + "\n\n"

    def shown(kind, i, e):
        out = f" {kind} Example {i} -\n" + close(f"Input: {e[0].strip()}") + "\n"
        out += close(f" Output: {e[1].strip()}") + "\n"
        if explain:
            out += close(f" Explanation: {e[2].strip()}") + "\n"
        return out + "\n"

    kept = {"Positive": [], "Negative": []}
    for kind, source, n in (("Positive", row["positive"], n_pos), ("Negative", row["negative"], n_neg)):
        for i, e in enumerate(source[:n], 1):
            text = shown(kind, i, e)
            before = " ".join(kept["Positive"])
            if kind == "Negative":
                before += " ".join(kept["Negative"])
            if size(head + before + text + ask) > max_src:
                break
            kept[kind].append(text)
    whole = head + "".join(kept["Positive"]) + "".join(kept["Negative"]) + ask
    return "".join(regex.findall(PIECE, whole)[:max_src])


@pytest.mark.parametrize("max_src, explain", [(20, False), (60, False), (90, True), (400, True)])
def test_instruction_prompt(spark, max_src, explain):
    rng = random.Random(max_src)
    text = lambda: " ".join(rng.choice(["alpha", "beta.", "gamma!", "d"]) for _ in range(rng.randint(1, 9)))
    rows = [
        {
            "id": i, "task": "t", "definition": text(), "input": text(), "outputs": ["x", "y"],
            "positive": [(text(), text(), text()) for _ in range(3)],
            "negative": [(text(), text(), text()) for _ in range(2)],
        }
        for i in range(25)
    ]
    ex = "array<struct<input:string,output:string,explanation:string>>"
    df = spark.createDataFrame(
        rows, f"id int, task string, definition string, input string, outputs array<string>, positive {ex}, negative {ex}"
    )
    out = prompts.instruction_prompt(df, max_src, 2, 2, add_explanation=explain).collect()
    for r in out:
        assert r["source"] == plain_instruction(rows[r["id"]], max_src, 2, 2, explain)
        assert r["label"] in ("x", "y")


def test_combine_by_null_group(spark):
    a = spark.createDataFrame([(None, 1.0), ("x", 2.0)], "k string, v double")
    b = spark.createDataFrame([(None, 3.0), ("y", 4.0)], "k string, v double")
    got = {r["k"]: (r["a"], r["b"]) for r in merge.combine_by_group({"a": a, "b": b}, "k", "v").collect()}
    assert got == {None: (1.0, 3.0), "x": (2.0, None), "y": (None, 4.0)}


def test_materialize_builds_once(spark, tmp):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    config = {"b": 1, "a": [2]}
    for _ in range(2):
        assert materialize(spark, build, tmp, config).count() == 3
    assert len(built) == 1 and os.path.isdir(f"{tmp}/{config_digest(config)}/data")
    assert config_digest({"a": [2], "b": 1}) == config_digest(config)


def test_concurrent_builders_read_one_table(spark, tmp):
    both = threading.Barrier(2, timeout=60)

    def builder(value):
        def build():
            both.wait()
            return spark.range(value, value + 2)

        return lambda: sorted(r["id"] for r in materialize(spark, build, tmp, {"a": 1}).collect())

    with ThreadPoolExecutor(2) as pool:
        first, second = [f.result() for f in [pool.submit(builder(v)) for v in (10, 20)]]
    assert first == second and first in ([10, 11], [20, 21])
    assert materialize(spark, lambda: None, tmp, {"a": 1}).count() == 2
    assert os.path.isdir(f"{tmp}/{config_digest({'a': 1})}/config.json")


def test_a_build_that_breaks_off_leaves_no_table(spark, tmp, monkeypatch):
    module = sys.modules[materialize.__module__]

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(module, "_publish", broken)
        with pytest.raises(OSError):
            materialize(spark, lambda: spark.range(1), tmp, {"a": 1})
    assert not os.path.exists(f"{tmp}/{config_digest({'a': 1})}")
    assert materialize(spark, lambda: spark.range(3), tmp, {"a": 1}).count() == 3


def test_csv_keeps_nulls_blanks_and_lines(spark, tmp):
    rows = [(1, "", None), (2, " a \n", 'x"y,\nz'), (3, None, "é")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    path = files.write_csv(df, f"{tmp}/t", bom=True)
    assert sorted(map(tuple, files.read_csv(spark, path, df.schema).collect())) == rows


def test_text_log_limits(spark, tmp):
    df = spark.range(30).select(F.col("id"), F.col("id").cast("string").alias("prediction"))
    for step in (1, 2, 3):
        files.append_text_log(df, f"{tmp}/log", step, ["id"], num_results=20, max_rows=50)
    got = spark.read.parquet(f"{tmp}/log").groupBy("step").count().collect()
    assert {r["step"]: r["count"] for r in got} == {1: 20, 2: 20, 3: 10}


def response(cid, content):
    return json.dumps(
        {"custom_id": cid, "response": {"body": {"choices": [{"message": {"role": "a", "content": content}}]}}}
    )


def test_ingest_is_resumable(spark, tmp):
    source, target, mark = (f"{tmp}/{d}" for d in ("in", "out", "mark"))
    os.mkdir(source)

    def put(name, *lines):
        with open(f"{source}/{name}", "w") as f:
            f.write("\n".join(response(*x) for x in lines) + "\n")

    put("batch_0.jsonl", ("a", " one "), ("b", "two"))
    run = lambda: ingest_responses_stream(spark, source, target, mark)
    assert run().count() == 2
    assert run().count() == 2
    put("batch_1.jsonl", ("a", "newer"))
    out = run()
    assert out.count() == 3
    asked = spark.createDataFrame([("a", "m"), ("b", "m"), ("c", "m")], "custom_id string, message string")
    merged = merge.merge_responses(asked, out)
    assert {r["custom_id"]: r["message"] for r in merged.collect()} == {"a": "newer", "b": "two"}


def test_flat_responses(spark, tmp):
    with open(f"{tmp}/r.jsonl", "w") as f:
        f.write(json.dumps({"custom_id": "x", "choices": [{"message": {"content": " hi "}}]}) + "\n")
        f.write(json.dumps({"custom_id": "y", "choices": []}) + "\n")
    got = {r["custom_id"]: r["content"] for r in files.read_responses(spark, tmp, "flat").collect()}
    assert got == {"x": "hi", "y": None}
