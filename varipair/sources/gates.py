"""Writes that are published only if what they hold passes the gates. Metrics are observed while the rows are written, so a
gate costs no second pass; a failed one raises before the folder gets its name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Fixed value: the share of truncated answers that the last stage bears.
MAX_TRUNCATION_RATE = 0.02

Gate = Callable[[dict], str | None]


class Stop(RuntimeError):
    pass


def response_metrics() -> dict[str, Column]:
    """What the stop conditions look at, of responses with api_error, truncated and parsed."""
    return {"n": F.count("*"), "n_failed": F.count_if("api_error"), "n_truncated": F.count_if("truncated"), "n_unparsed": F.count_if(~F.coalesce("parsed", F.lit(False)))}


def stop_conditions(stage: int, qc_errors: int = 0) -> list[tuple[str, Gate]]:
    """The published stop conditions: early stages bear no truncation and no parse failure, stage 3 a few truncations."""
    early = stage < 3
    rate = lambda m: m["n_truncated"] / m["n"] if m["n"] else 0.0
    return [
        ("qc", lambda m: f"QC/independent recompute errors: {qc_errors}" if qc_errors else None),
        ("provider", lambda m: f"{m['n_failed']} provider failures" if m["n_failed"] else None),
        ("truncation", lambda m: f"{m['n_truncated']} truncations in stage {stage}" if early and m["n_truncated"] else f"truncation rate {rate(m):.1%} > {MAX_TRUNCATION_RATE:.0%}" if stage == 3 and rate(m) > MAX_TRUNCATION_RATE else None),
        ("parse", lambda m: f"parse failures in stage {stage}: {m['n_unparsed']}" if early and m["n_unparsed"] else None),
    ]


def contradictions() -> tuple[dict[str, Column], list[tuple[str, Gate]]]:
    """Metrics and gate of a semantic audit with a column `problems`."""
    metrics = {"n": F.count("*"), "n_contradictions": F.count_if(F.col("problems") != "")}
    return metrics, [("semantic audit", lambda m: f"semantic audit found {m['n_contradictions']} contradictions" if m["n_contradictions"] else None)]


def failures(metrics: dict, gates: list[tuple[str, Gate]]) -> list[tuple[str, str]]:
    return [(name, message) for name, gate in gates if (message := gate(metrics))]


def publish(df: DataFrame, path: str, metrics: dict[str, Column], gates: list[tuple[str, Gate]], fmt: str = "parquet") -> dict:
    """Write df below `path` and return the metrics; if a gate fails, delete what was written and raise Stop. One job."""
    spark, staged = df.sparkSession, f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, *[c.alias(name) for name, c in metrics.items()]).write.format(fmt).save(staged)
    values = seen.get
    stops = failures(values, gates)
    jvm = spark._jvm.org.apache.hadoop.fs
    source, target = jvm.Path(staged), jvm.Path(path)
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if stops:
        fs.delete(source, True)
        raise Stop("; ".join(message for _, message in stops))
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
        raise FileExistsError(path)
    return values
