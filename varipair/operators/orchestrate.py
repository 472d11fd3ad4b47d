"""A whole evaluation of a model: cohort, cached run, responses behind gates, metrics. Each step's table is written, so a lost
executor repeats no model call that a written table holds, and a stopped evaluation resumes from the cache."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written
from ..sources import cache, gates
from ..streaming import runner
from . import evaluate, items, metrics
from .preparation import SPLITS

#: How many diagnostic questions the first stages take.
STAGE_SIZES = {"1": 1, "stage_1": 1, "2": 5, "stage_2": 5}


def load_cohort(manifest: DataFrame, stage: str) -> DataFrame:
    """The question ids of a stage, from a manifest (question_id, split): a split's, or the first few diagnostic ones."""
    if stage in SPLITS:
        return manifest.where(F.col("split") == stage).select("question_id")
    if stage not in STAGE_SIZES:
        raise ValueError(f"unknown stage: {stage}")
    return manifest.where("split = 'diagnostic'").select("question_id").orderBy("question_id").limit(STAGE_SIZES[stage])


def config_hash(provider: str, model: str, inference: dict, prompt_version: str) -> str:
    """Names the configuration of a model's answers: sha256 of its JSON with sorted keys."""
    import hashlib
    import json

    payload = {"provider": provider, "model": model, "inference": inference, "prompt_version": prompt_version, "cache_schema": cache.CACHE_SCHEMA}
    return hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()


def as_scored(responses: DataFrame) -> DataFrame:
    """Evaluated responses in the columns of the scored tables; the run is the model."""
    right_size = F.col("set_size") == F.size("example.option_texts") - 1
    return responses.select(
        F.col("run_id").alias("model"), "example.question_id", "example.source_dataset", "example.condition", F.col("example.gold_index").alias("gold"), F.col("parse_success").alias("parsed"), "evaluable", "correct",
        F.coalesce("implied_option_index", "selected_option_index").alias("answer"), F.col("selected_option_text").alias("answer_text"), F.when(right_size, 3).otherwise(F.when(F.col("set_size").isNotNull(), 0)).alias("set_size"), "match_method",
        F.col("api_error").alias("api_error"), "truncated", "cost_usd",
    )


class Evaluation(NamedTuple):
    """The published responses, the metrics by condition, the runs' totals, and what the gates saw."""

    responses: DataFrame
    by_condition: DataFrame
    totals: DataFrame
    seen: dict


def evaluate_policy(examples: DataFrame, adapter: runner.Adapter, cache_path: str, config: str, ceiling: float, out: str, stage: int = 3, prompt_version: str = "v1", secrets: tuple[str, ...] = ()) -> Evaluation:
    """examples (run_id, seq, question_id, condition, prompt, example_json) through the cache and the adapter. New answers
    are cached before anything can stop the evaluation; a duplicate, a reached ceiling or a failed gate then does, and
    nothing is published below `out`."""
    requests = cache.lookup(examples, cache_path, config).withColumnRenamed("response", "cached")
    results = written(runner.run(requests, adapter, ceiling), "runs")
    runner.to_cache(results, examples, cache_path, config, prompt_version, list(secrets))
    called = runner.checked(results).select("run_id", "seq", F.col("response").alias("completion"), "status", "attempts", "cost_usd", F.col("error").isNotNull().alias("api_error"), (F.col("status") == "cached").alias("from_cache"))
    rows = examples.select(F.col("run_id").cast("string"), F.col("seq").cast("long"), "prompt", "example_json").join(called, ["run_id", "seq"])
    responses = evaluate.evaluated(evaluate.with_examples(rows.withColumn("truncated", F.lit(False)), "example_json", "completion")).withColumn("prompt_sha256", T.sha256(F.col("prompt"))).withColumnRenamed("parse_success", "parsed")
    seen = gates.publish(responses, out, gates.response_metrics(), gates.stop_conditions(stage))
    kept = examples.sparkSession.read.parquet(out).withColumnRenamed("parsed", "parse_success")
    return Evaluation(kept, metrics.by_condition(items.compared(as_scored(kept))), runner.totals(results), seen)

