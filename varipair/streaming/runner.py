"""Runs of model calls with a spending ceiling, retries, a duplicate guard and cached answers, as a stateful operator.

Requests of a run come in the order of `seq`. The state of a run is small: what it has spent, whether it has stopped, and
the keys it has seen (a map in the state store, not in memory). For each request, in this order: a key that the run has seen is
`duplicate`; one with a cached response is `cached` and free; one that comes when the spend has reached the ceiling is not
called, and neither is any later one of the run (`stopped`), so the ceiling is passed by the last call's cost at most; else
the adapter is called, again up to `max_retries` times if it fails, and the outcome is `called`, with its cost added to the
spend, or `failed`, which costs nothing.

The same steps run over a batch and over a stream, with the same rows as the result, as the order within a run is kept:
a batch has a run's rows sorted by seq, and needs no store: a window marks repeated keys, and the spend goes from row to row;
a stream must bring its rows in that order, batch by batch. A run's rows stream through one task, so a run of any length
takes the memory of one Arrow batch.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Workers get the processor by value and need not import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RESULT = "run_id string, seq long, question_id string, condition string, status string, attempts int, response string, cost_usd double, error string, spent_usd double"

#: A model adapter: (request as a Row, attempt from 1) to (response, cost in USD). It raises when the provider fails.
Adapter = Callable[[Row, int], tuple[str, float]]


class CostCeilingExceeded(RuntimeError):
    pass


class DuplicateRequest(RuntimeError):
    pass


def step(r: Row, repeated: bool, spent: float, stopped: bool, adapter: Adapter, ceiling: float, max_retries: int) -> tuple[Row, float, bool]:
    """What becomes of one request after `spent`, and the run's spend and whether it has stopped after it."""
    attempts, response, cost, error = 0, None, None, None
    if repeated:
        status = "duplicate"
    elif r["cached"] is not None:
        status, response = "cached", r["cached"]
    elif stopped or spent >= ceiling:
        status, stopped = "stopped", True
    else:
        status = "failed"
        while status == "failed" and attempts <= max_retries:
            attempts += 1
            try:
                response, cost = adapter(r, attempts)
                status, error = "called", None
            except Exception as e:  # the provider's fault: recorded, not cached
                error = f"{type(e).__name__}: {e}"
        spent += cost or 0.0
    row = Row(run_id=r["run_id"], seq=r["seq"], question_id=r["question_id"], condition=r["condition"], status=status, attempts=attempts, response=response, cost_usd=cost, error=error, spent_usd=spent)
    return row, spent, stopped


class Runner(StatefulProcessor):
    def __init__(self, adapter: Adapter, ceiling: float, max_retries: int = 1):
        self.adapter, self.ceiling, self.max_retries = adapter, ceiling, max_retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "spent double, stopped boolean")
        self.seen = handle.getMapState("seen", "question_id string, condition string", "seq long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        spent, stopped = self.total.get() if self.total.exists() else (0.0, False)
        for r in rows:
            name = (r["question_id"] or "", r["condition"] or "")
            repeated = self.seen.containsKey(name)
            if not repeated:
                self.seen.updateValue(name, (r["seq"],))
            out, spent, stopped = step(r, repeated, spent, stopped, self.adapter, self.ceiling, self.max_retries)
            yield out
        self.total.update((spent, stopped))

    def close(self) -> None:
        pass


def _over_sorted(adapter: Adapter, ceiling: float, max_retries: int):
    """mapInArrow over whole runs, sorted; `_nth` is a row's place among those of its key, the same for equal rows."""
    names = ("run_id", "seq", "question_id", "condition", "status", "attempts", "response", "cost_usd", "error", "spent_usd")
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.float64())
    schema = pa.schema(list(zip(names, types, strict=True)))

    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        request = Row("run_id", "seq", "question_id", "condition", "prompt", "cached")
        last, spent, stopped = None, 0.0, False
        for batch in batches:
            rows = []
            for *fields, nth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is None or last[0] != fields[0]:
                    spent, stopped = 0.0, False
                row, spent, stopped = step(request(*fields), nth > 1 or last == fields[:4], spent, stopped, adapter, ceiling, max_retries)
                rows.append(row)
                last = fields[:4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], schema=schema)

    return process


def run(requests: DataFrame, adapter: Adapter, ceiling: float, max_retries: int = 1) -> DataFrame:
    """One row per request (run_id, seq, question_id, condition, prompt, cached; batch or stream) with its status,
    attempts, response, cost, error and the run's spend after it. A stream needs the RocksDB state store (`state_store`)."""
    r = requests.select(F.col("run_id").cast("string"), F.col("seq").cast("long"), F.col("question_id").cast("string"), F.col("condition").cast("string"), F.col("prompt").cast("string"), F.col("cached").cast("string"))
    if r.isStreaming:
        state_store(requests.sparkSession)
        return r.groupBy("run_id").transformWithState(Runner(adapter, ceiling, max_retries), RESULT, "append", "none")
    # One shuffle by run: the window and the order below both keep to it.
    key = Window.partitionBy("run_id", F.coalesce("question_id", F.lit("")), F.coalesce("condition", F.lit("")))
    r = r.repartition("run_id").withColumn("_nth", F.rank().over(key.orderBy("seq", "question_id", "condition")))
    return r.sortWithinPartitions("run_id", "seq", "question_id", "condition").mapInArrow(_over_sorted(adapter, ceiling, max_retries), RESULT)


def state_store(spark) -> None:
    """RocksDB holds the state. Asking for the streams starts the session's coordinator of state."""
    assert spark.streams is not None
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def checked(results: DataFrame) -> DataFrame:
    """The results; the job fails at a duplicate request or at the first request that the ceiling stopped."""
    fail = lambda kind, why: F.raise_error(F.concat(F.lit(f"{kind}: {why} "), "run_id", F.lit(" "), F.coalesce("question_id", F.lit("")), F.lit("/"), F.coalesce("condition", F.lit("")))).cast("string")
    status = F.when(F.col("status") == "duplicate", fail("DuplicateRequest", "evaluation requested twice")).when(F.col("status") == "stopped", fail("CostCeilingExceeded", "new spend reached the ceiling before")).otherwise(F.col("status"))
    return results.withColumn("status", status)


def totals(results: DataFrame) -> DataFrame:
    """Per run: expected, new calls, cached, failed, retries, stopped, duplicates and what the new calls cost."""
    n = lambda status: F.count_if(F.col("status") == status).alias(f"n_{status}")
    return results.groupBy("run_id").agg(F.count("*").alias("n_expected"), *map(n, ("called", "cached", "failed", "stopped", "duplicate")), F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("n_retries"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("new_cost_usd"))


def to_cache(results: DataFrame, requests: DataFrame, path: str, config_hash: str, prompt_version: str, secrets: list[str] = ()) -> None:
    """New answers of a run into the response cache; failures are not cached."""
    from ..sources import cache

    new = results.where("status = 'called'").select("run_id", "seq", "question_id", "condition", "response")
    rows = new.join(requests.select(F.col("run_id").cast("string"), F.col("seq").cast("long"), "prompt"), ["run_id", "seq"])
    cache.put(rows.withColumn("prompt_version", F.lit(prompt_version)), path, config_hash, secrets)
