"""Nested records, gates before publication, the manifest of many splits and the most similar pair."""

import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from varipair.functions import records
from varipair.operators import overlap
from varipair.session import scratch
from varipair.sources import gates


def variants(spark, *values):
    df = spark.createDataFrame([(k, v if v is None or isinstance(v, str) else json.dumps(v)) for k, v in enumerate(values)], "k int, raw string")
    return df.withColumn("record", records.parsed(F.col("raw"))).orderBy("k")


def test_tags_of_cells(spark):
    df = variants(spark, None, "plain text", {"a": 1}, [1], "3", "2.5", "true", '"x"', "null", "")
    got = [r[0]["format"] for r in df.select(records.tagged(F.col("raw"))).collect()]
    assert got == ["null", "raw-string (not valid JSON)", "json (dict)", "json (list)", "json (int)", "json (float)", "json (bool)", "json (str)", "json (NoneType)", "raw-string (not valid JSON)"]
    assert df.select(records.tagged(F.col("raw"))["value"]).collect()[1][0] == "plain text"


def test_raw_records(spark):
    usage = lambda **x: {"candidates": [{"finish_reason": "STOP"}], "usage_metadata": x}
    df = variants(spark, usage(thoughts_token_count=7), usage(prompt_token_count=3, candidates_token_count=4, total_token_count=7), usage(prompt_token_count=3, candidates_token_count=4, total_token_count=9), {"candidates": []}, "[]", None, {"usage_metadata": {"thoughts_token_count": "many"}})
    got = [(r["f"], r["t"]["tokens"], r["t"]["source"]) for r in df.select(records.finish_reason(F.col("record")).alias("f"), records.thinking_tokens(F.col("record")).alias("t")).collect()]
    assert got == [("STOP", 7, "reported"), ("STOP", 0, "derived"), ("STOP", None, "unknown"), (None, None, "unknown"), (None, None, "unknown"), (None, None, "unknown"), (None, None, "unknown")]


def test_examples(spark):
    whole = {"question_id": "a::1", "source_dataset": "a", "source_id": "1", "condition": "incorrect", "question": "?", "option_labels": ["A", "B"], "gold_label": ["B"], "gold_indices": [1], "options_displayed": False}
    bare = {k: whole[k] for k in records.REQUIRED} | {"gold_label": "A"}
    rows = [r["e"] for r in variants(spark, whole, bare).select(records.example(F.col("record")).alias("e")).collect()]
    assert (rows[0]["option_labels"], rows[0]["gold_labels"], rows[0]["gold_indices"], rows[0]["options_displayed"]) == (["A", "B"], ["B"], [1], False)
    assert (rows[1]["option_labels"], rows[1]["gold_labels"], rows[1]["gold_indices"], rows[1]["options_displayed"], rows[1]["missing"]) == ([], ["A"], None, True, [])
    with pytest.raises(Exception, match="example without source_id"):
        variants(spark, {k: v for k, v in bare.items() if k != "source_id"}).select(records.example(F.col("record"))).collect()


def responses(spark, n, failed=0, truncated=0, unparsed=0):
    return spark.range(n).select((F.col("id") < failed).alias("api_error"), (F.col("id") < truncated).alias("truncated"), (F.col("id") >= unparsed).alias("parsed"))


def test_gates(spark):
    local = lambda p: p.removeprefix("file://")
    path = scratch(spark, "gated")
    with pytest.raises(gates.Stop, match="1 provider failures; 2 truncations in stage 2; parse failures in stage 2: 3"):
        gates.publish(responses(spark, 50, 1, 2, 3), path, gates.response_metrics(), gates.stop_conditions(2))
    assert not [f for f in os.listdir(os.path.dirname(local(path))) if os.path.basename(path) in f]
    seen = gates.publish(responses(spark, 100, 0, 2, 3), path, gates.response_metrics(), gates.stop_conditions(3))
    assert seen == {"n": 100, "n_failed": 0, "n_truncated": 2, "n_unparsed": 3} and spark.read.parquet(path).count() == 100
    with pytest.raises(FileExistsError):
        gates.publish(responses(spark, 1), path, gates.response_metrics(), [])
    with pytest.raises(gates.Stop, match="truncation rate 3.0% > 2%"):
        gates.publish(responses(spark, 100, 0, 3), scratch(spark, "gated"), gates.response_metrics(), gates.stop_conditions(3))
    with pytest.raises(gates.Stop, match="QC"):
        gates.publish(responses(spark, 1), scratch(spark, "gated"), gates.response_metrics(), gates.stop_conditions(1, qc_errors=4))
    assert gates.publish(responses(spark, 0), scratch(spark, "gated"), gates.response_metrics(), gates.stop_conditions(3))["n"] == 0
    metrics, stops = gates.contradictions()
    with pytest.raises(gates.Stop, match="found 1 contradictions"):
        gates.publish(spark.createDataFrame([("",), ("order",)], "problems string"), scratch(spark, "audit"), metrics, stops)


def test_a_gate_costs_no_second_scan(spark):
    path = scratch(spark, "in")
    responses(spark, 300).write.parquet(path)
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    df = spark.read.parquet(path)
    gates.publish(df.mapInArrow(seen, df.schema), scratch(spark, "gated"), gates.response_metrics(), gates.stop_conditions(1))
    assert reads.value == 300


def test_manifest(spark):
    rows = [("x", 1, "a", ("o", None)), ("x", 1, " ", ("o", "p")), ("y", 2, None, None), (None, 2, "a", ("", "q"))]
    df = spark.createDataFrame(rows, "split string, id int, text string, options struct<A: string, B: string>")
    m = overlap.manifest(df, "split", ["id", "text"], {"options": ["A", "B"]})
    got = {(r["split"], r["column"]): tuple(r)[2:] for r in m.collect()}
    assert got[(None, "id")] == (4, 0, 0, 2, 2) and got[("x", "id")] == (2, 0, 0, 1, 1) and got[("", "text")] == (1, 0, 0, 1, 0)
    assert got[(None, "text")] == (4, 1, 1, 2, 1) and got[("y", "options.A")] == (1, 1, 0, 0, 0) and got[(None, "options.B")] == (4, 2, 0, 2, 0)
    assert len(got) == 16
    path = scratch(spark, "m")
    df.write.parquet(path)
    plan = overlap.manifest(spark.read.parquet(path), "split", ["id", "text"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


@pytest.mark.parametrize("block", [512, 4])
def test_cross_similarity(spark, block):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 9))) for _ in range(30)] + [None, "", "a b c", "A, b; C"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    sets = [set((t or "").lower().replace(",", " ").replace(";", " ").split()) for t in texts]
    sim = [(len(x & y) / len(x | y) if x | y else 1.0, i, j) for (i, x), (j, y) in itertools.combinations(enumerate(sets), 2)]
    top, i, j = max(sim, key=lambda s: (s[0], -s[1], -s[2]))
    r = overlap.cross_similarity(df, block=block).first()
    assert (r["n_pairs"], r["max_j"], r["first_id"], r["second_id"], r["passes"]) == (len(sim), top, str(i), str(j), top <= 0.9)
    assert abs(r["mean_j"] - sum(s[0] for s in sim) / len(sim)) < 1e-12


def test_cross_similarity_of_few(spark):
    for n in (0, 1):
        r = overlap.cross_similarity(spark.createDataFrame([(0, "a")][:n], "id int, text string")).first()
        assert tuple(r) == (0, 0.0, 0.0, None, None, True)
