"""Readers and writers with the options that evaluation data needs, and small provenance helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header, embedded line feeds and doubled quotes, by an explicit schema."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_by(df: DataFrame, path: str, column: str, fmt: str = "parquet") -> None:
    """One folder for each value of column."""
    df.write.mode("overwrite").partitionBy(column).format(fmt).save(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Parquet splits as one frame with a `split` column."""
    frames = [spark.read.parquet(p).withColumn("split", F.lit(name)) for name, p in paths.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with their cached response, if any; a record of another configuration or prompt fails the job."""
    c = cache.select("question_id", "condition", F.col("config_hash").alias("_c"), F.col("prompt_sha256").alias("_p"), "response")
    j = requests.join(c, ["question_id", "condition"], "left")
    stale = F.col("_c").isNotNull() & ((F.col("_c") != F.col("config_hash")) | (F.col("_p") != F.col("prompt_sha256")))
    return j.withColumn("response", F.when(stale, F.raise_error(F.lit("cached record of another configuration or prompt"))).otherwise(F.col("response"))).drop("_c", "_p")


def guard_secrets(df: DataFrame, column: str, secrets: list[str]) -> DataFrame:
    """Fails when a text holds one of the secrets."""
    hit = F.exists(F.array(*map(F.lit, secrets)), lambda s: F.contains(F.col(column), s)) if secrets else F.lit(False)
    return df.withColumn(column, F.when(hit, F.raise_error(F.lit("a secret is in the record"))).otherwise(F.col(column)))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def markdown(df: DataFrame, digits: int = 4) -> str:
    """A small result as a Markdown table."""
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in df.collect()])


def latex(df: DataFrame) -> str:
    """A small result as a LaTeX tabular."""
    cell = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v).replace("_", r"\_")
    rows = [" & ".join(map(cell, r)) + r" \\" for r in df.collect()]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", " & ".join(c.replace("_", r"\_") for c in df.columns) + r" \\", *rows, r"\end{tabular}"])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_optional_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """As read_csv; a file that is not there has no rows."""
    return read_csv(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_settings(spark: SparkSession, path: str, defaults: dict) -> dict:
    """A small JSON object over defaults; a file that is not there changes nothing."""
    import json

    if not exists(spark, path):
        return dict(defaults)
    return defaults | json.loads(spark.read.text(path, wholetext=True).first()[0])


def epsilon(spark: SparkSession, path: str) -> float:
    """The width of the tie band: twice the greatest score difference of a padding report; 0.125 without a report."""
    found = read_settings(spark, path, {})
    return 2.0 * found.get("max_abs_score_diff", 0.0625) if found or exists(spark, path) else 0.125


def from_list(spark: SparkSession, rows: list, schema: StructType | str, seed: int, key: str) -> DataFrame:
    """Rows of a driver's list in an order that the seed and `key` fix."""
    return shuffled(spark.createDataFrame(rows, schema), seed, key)


def shuffled(df: DataFrame, seed: int, key: str) -> DataFrame:
    """The rows in a pseudo-random order that only the seed and the key decide."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key).cast("string")), key)


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A small nested report as one JSON document."""
    import json

    spark.createDataFrame([(json.dumps(report, indent=2, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_splits(df: DataFrame, path: str, column: str) -> dict:
    """JSON lines of each split, of all rows, and metadata: counts by split. Rows are computed once, for the combined lines,
    from which the others are made."""
    spark = df.sparkSession
    df.write.mode("overwrite").json(f"{path}/all")
    rows = spark.read.schema(df.schema).json(f"{path}/all")
    rows.withColumn("_split", F.col(column)).write.mode("overwrite").partitionBy("_split").json(f"{path}/by_split")
    counts = {str(r[column]): r["count"] for r in rows.groupBy(column).count().collect()}
    report = {"total_items": sum(counts.values()), "items": counts}
    write_report(spark, report, f"{path}/metadata")
    return report
