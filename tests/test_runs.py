"""The response cache and the runner: what is visible after failures, and a stream that gives what a batch gives."""

import json
import os

import pytest
from pyspark.sql import functions as F

from varipair.operators import items, metrics
from varipair.session import scratch
from varipair.sources import cache
from varipair.streaming import runner

RECORD = "question_id string, condition string, prompt_version string, prompt string, response string"


def records(spark, n, answer="r"):
    return spark.createDataFrame([(f"set::a/{i}", "mcq", "v1", f"p{i}", f"{answer}{i}") for i in range(n)], RECORD).repartition(4)


def files_of(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path.removeprefix("file://")) for f in names if f.endswith(".parquet"))


def test_cache_round_trip_replaces_and_prunes(spark):
    path = scratch(spark, "cache")
    assert cache.cached(spark, path, "abc").count() == 0
    cache.put(records(spark, 200), path, "abc", buckets=8)
    cache.put(records(spark, 5, "new"), path, "abc")
    got = {r["question_id"]: r["response"] for r in cache.cached(spark, path, "abc").collect()}
    assert len(got) == 200 and got["set::a/3"] == "new3" and got["set::a/9"] == "r9"
    few = cache.cached(spark, path, "abc").where("question_id IN ('set::a/3', 'set::a/4')")
    wanted = {cache.bucket_of(q, 8) for q in ("set::a/3", "set::a/4")}
    assert few.count() == 2 and few.rdd.getNumPartitions() == len(wanted)
    asked = spark.createDataFrame([("set::a/3", "mcq", "p3"), ("set::a/3", "open", "p3"), (None, "mcq", "p"), ("other", None, "p")], "question_id string, condition string, prompt string")
    for limit in (cache.FEW_KEYS, 0):  # by keys, and by a join with the whole cache
        cache.FEW_KEYS, before = limit, cache.FEW_KEYS
        assert [r["response"] for r in cache.lookup(asked, path, "abc").orderBy(F.desc_nulls_last("question_id"), "condition").collect()] == ["new3", None, None, None]
        cache.FEW_KEYS = before


def test_cache_refuses_secrets_and_leaves_nothing(spark):
    path = scratch(spark, "cache")
    cache.put(records(spark, 10), path, "abc")
    before = files_of(path)
    leak = records(spark, 50).withColumn("response", F.when(F.col("question_id") == "set::a/33", F.lit("key sk-12345 inside")).otherwise(F.col("response")))
    with pytest.raises(Exception, match="SecretFound"):
        cache.put(leak, path, "abc", ["", "sk-12345"])
    assert cache.cached(spark, path, "abc").count() == 10
    # A task that is killed may leave a file that no commit names; none has the secret, and none stays.
    assert not any(b"sk-12345" in open(f, "rb").read() for f in files_of(path))
    cache.vacuum(path, "abc", -1)
    assert files_of(path) == before


def test_failed_task_publishes_nothing(spark):
    path = scratch(spark, "cache")

    @F.udf("string")
    def breaks(x):
        if x == "r37":
            raise RuntimeError("a task dies")
        return x

    with pytest.raises(Exception, match="a task dies"):
        cache.put(records(spark, 40).withColumn("response", breaks("response")), path, "abc")
    assert cache.cached(spark, path, "abc").count() == 0
    # What a lost executor leaves is no part of the cache either, and goes.
    stray = f"{path.removeprefix('file://')}/abc/data/bucket=00000/lost.parquet"
    os.makedirs(os.path.dirname(stray), exist_ok=True)
    open(stray, "wb").close()
    assert cache.cached(spark, path, "abc").count() == 0 and cache.vacuum(path, "abc") == 0
    assert cache.vacuum(path, "abc", -1) >= 1
    left = [f for f in files_of(path) if f == stray]
    assert left == []


@pytest.mark.parametrize("change, why", [({"config_hash": None}, "different configuration"), ({"cache_schema": "v0"}, "different configuration"), ({"prompt_sha256": None}, "prompt changed"), ({"prompt_sha256": "0"}, "prompt changed")])
def test_incompatible_records_fail(spark, change, why):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = scratch(spark, "cache")
    cache.put(records(spark, 1).coalesce(1), path, "abc", buckets=1)
    (file,) = files_of(path)
    row = pq.read_table(file).to_pylist()[0] | change
    pq.write_table(pa.Table.from_pylist([row], schema=pa.schema([f.with_nullable(True) for f in pq.read_schema(file)])), file)
    with pytest.raises(Exception, match=why):
        cache.lookup(records(spark, 1).drop("response"), path, "abc").collect()


def test_put_refuses_other_configurations_and_folders(spark):
    with pytest.raises(Exception, match="names a folder"):
        cache.put(records(spark, 1), scratch(spark, "cache"), "../up")
    other = records(spark, 1).select("*", F.lit("x").alias("cache_schema"), F.lit("y").alias("config_hash"), F.lit("z").alias("prompt_sha256")).select(*cache.FIELDS)
    with pytest.raises(Exception, match="another configuration"):
        other.write.format("response_cache").options(path=scratch(spark, "cache"), config_hash="abc").mode("append").save()


def flaky():
    def generate(request, attempt):
        k = request["seq"]
        if k % 11 == 5 or (k % 4 == 1 and attempt == 1):
            raise TimeoutError("busy")
        return f"a{k}", 0.5

    return generate


REQUEST = "run_id string, seq long, question_id string, condition string, prompt string, cached string"


def requests():
    rows = [(f"run{i % 3}", i, f"q{i % 29}" if i % 3 else f"q{i}", "mcq", "p", "c" if i % 10 == 9 else None) for i in range(120)]
    return rows + [(None, 1, None, None, None, None), (None, 2, None, None, None, None)]


def expected(rows, ceiling, retries=1):
    out, spent, seen = [], {}, set()
    for run, seq, q, c, _, cached in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        total, attempts, cost = spent.get(run, 0.0), 0, None
        if (run, q, c) in seen:
            status = "duplicate"
        elif cached:
            status = "cached"
        elif total >= ceiling:
            status = "stopped"
        else:
            status = "failed" if seq % 11 == 5 else "called"
            attempts = 1 + retries if status == "failed" else 1 + (seq % 4 == 1)
            cost = 0.5 if status == "called" else None
        seen.add((run, q, c))
        spent[run] = total + (cost or 0)
        out.append((run, seq, status, attempts, cost, spent[run]))
    return sorted(out, key=str)


def test_runner_batch_and_stream_agree(spark):
    rows, fields = requests(), ("run_id", "seq", "status", "attempts", "cost_usd", "spent_usd")
    got = runner.run(spark.createDataFrame(rows, REQUEST).repartition(5), flaky(), 6.0)
    want = expected(rows, 6.0)
    assert sorted((tuple(r[f] for f in fields) for r in got.collect()), key=str) == want
    folder = scratch(spark, "requests")
    for k in range(0, 120, 40):  # three files, one to a micro-batch, in order
        spark.createDataFrame([r for r in rows if k <= (r[1] if r[0] else 0) < k + 40], REQUEST).coalesce(1).write.mode("append").parquet(f"{folder}/{k:03d}")
    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    q = runner.run(stream, flaky(), 6.0).writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(180) and q.exception() is None
    assert sorted((tuple(r[f] for f in fields) for r in spark.table("runs").collect()), key=str) == want


def test_a_batch_is_one_shuffle_and_keeps_no_store(spark):
    rows = [("a", 1, "q", "mcq", "p", None), ("a", 1, "q", "mcq", "p", None), ("a", 2, None, "mcq", "p", None), ("a", 2, "", "mcq", "p", None), (None, 2, "q", "mcq", "p", None), ("a", None, "q", "mcq", "p", None)]
    got = runner.run(spark.createDataFrame(rows, REQUEST).repartition(3), lambda request, attempt: ("r", 1.0), 9.0)
    plan = got._jdf.queryExecution().sparkPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
    assert "TransformWithState" not in plan and plan.count("hashpartitioning") == plan.count("hashpartitioning(run_id")
    want = [("a", None, "called", 1.0), ("a", 1, "duplicate", 1.0), ("a", 1, "duplicate", 1.0), ("a", 2, "called", 2.0), ("a", 2, "duplicate", 2.0), (None, 2, "called", 1.0)]
    assert sorted(((r["run_id"], r["seq"], r["status"], r["spent_usd"]) for r in got.collect()), key=str) == sorted(want, key=str)
    tied = runner.run(spark.createDataFrame(rows[:2], REQUEST), lambda request, attempt: ("r", 1.0), 9.0)
    assert sorted((r["status"], r["spent_usd"]) for r in tied.collect()) == [("called", 1.0), ("duplicate", 1.0)]


def test_runner_fails_where_asked(spark):
    one = lambda rows: runner.checked(runner.run(spark.createDataFrame(rows, REQUEST), flaky(), 1.0))
    assert one([("a", 0, "q0", "mcq", "p", None)]).first()["status"] == "called"
    with pytest.raises(Exception, match="DuplicateRequest"):
        one([("a", 0, "q0", "mcq", "p", None), ("a", 2, "q0", "mcq", "p", None)]).collect()
    with pytest.raises(Exception, match="CostCeilingExceeded"):
        one([("a", k, f"q{k}", "mcq", "p", None) for k in (0, 2, 4)]).collect()
    assert runner.run(spark.createDataFrame([], REQUEST), flaky(), 1.0).count() == 0


def answers(spark, rows):
    """(question_id, condition, raw_response) scored, gold 1 everywhere (3 in fixed_pos)."""
    df = spark.createDataFrame([(0, q, "s", c, 3 if c == "fixed_pos" else 1, json.dumps({"answer": a}) if a else "no idea") for q, c, a in rows], "model int, question_id long, source_dataset string, condition string, gold int, raw_response string")
    return items.score(df)


def test_nothing_is_labelled_without_an_evaluable_baseline(spark):
    s = answers(spark, [(1, "mcq", None), (1, "none_of_the_provided", "B"), (1, "incorrect", ["A", "C", "D"]), (2, "mcq", "A"), (2, "none_of_the_provided", "A"), (2, "incorrect", ["A", "B"]), (3, "incorrect", ["A", "C", "D"])])
    got = {(r["question_id"], r["condition"]): r["adaptation"] for r in items.pair(s).collect()}
    assert got == {(1, "none_of_the_provided"): None, (1, "incorrect"): None, (2, "none_of_the_provided"): "failure_to_adapt_kept_same_distractor", (2, "incorrect"): "failure_to_adapt_wrong_set_size"}
    table = metrics.main_table(items.compared(s)).first()
    assert table["adaptation_failure_rate"] == 0.5


def test_missing_text_is_a_text_in_joint_recon(spark):
    same = [(1, "mcq", "A"), (1, "roman_numeral", "I"), (1, "fixed_pos", "A"), (1, "no_symbols", "zzz")]
    whole = [(2, "mcq", "A"), (2, "roman_numeral", "I"), (2, "fixed_pos", "A"), (2, "no_symbols", "alpha")]
    r = metrics.group_consistency(answers(spark, same + whole)).first()
    assert (r["n_questions"], r["joint_recon"], r["joint_reacc"]) == (2, 0.5, 0.0)


def test_bounds_and_joint_rates_by_condition(spark):
    s = answers(spark, [(1, "mcq", "B"), (1, "open", "bravo"), (1, "roman_numeral", "II"), (2, "mcq", "A"), (2, "open", "zz"), (2, "roman_numeral", "I")])
    got = {r["condition"]: r for r in metrics.by_condition(items.compared(s.withColumn("cost_usd", F.lit(0.25)))).collect()}
    assert (got["open"]["lower_bound"], got["open"]["upper_bound"], got["open"]["n_ambiguous"]) == (0.5, 1.0, 1)
    assert got["mcq"]["lower_bound"] is None and got["roman_numeral"]["upper_bound"] is None and got["mcq"]["n_pairs"] is None
    assert (got["roman_numeral"]["reacc"], got["roman_numeral"]["recon"], got["open"]["recon"], got["open"]["cost_usd"]) == (0.5, 1.0, None, 0.5)


def test_outcome_categories(spark):
    from varipair.operators import phases

    rows = [(1, "B", "II"), (2, "B", "I"), (3, "A", "II"), (4, "A", "I"), (5, "A", "III"), (6, None, "II")]
    s = answers(spark, [(q, c, x) for q, a, b in rows for c, x in (("mcq", a), ("roman_numeral", b))])
    got = {r["category"]: r["n"] for r in phases.outcome_categories(s).collect()}
    assert got == dict.fromkeys(["stable_correct", "correct_to_incorrect", "incorrect_to_correct", "stable_incorrect", "incorrect_to_different_incorrect", "unparseable"], 1)
