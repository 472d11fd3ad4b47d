"""Counterfactual vignettes: tie-band metrics of their scores, polarity conflicts, and text baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..session import scratch, written

def tieband_accuracy(scores: DataFrame, epsilon: float) -> DataFrame:
    k = S.tie_band(F.col("margin"), epsilon)
    return scores.groupBy("item_type").agg(F.count("*").alias("n"), *[F.count_if(k == x).alias(f"n_{x}") for x in ("correct", "incorrect", "tie")], F.avg("margin").alias("mean_margin"))


def cfr(wide: DataFrame, epsilon: float) -> DataFrame:
    """Flip outcomes of (base, edited) margins for the default: a tie first, then flip, default or alternative
    dominant, both wrong."""
    b, e = S.tie_band(F.col("base"), epsilon), S.tie_band(F.col("edited"), epsilon)
    outcome = F.when((b == "tie") | (e == "tie"), "tie").when((b == "correct") & (e == "incorrect"), "flip").when((b == "correct") & (e == "correct"), "default_dominant").when((b == "incorrect") & (e == "incorrect"), "alternative_dominant").otherwise("both_incorrect")
    return wide.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.avg("base").alias("mean_base"), F.avg("edited").alias("mean_edited"))


def dfr(wide: DataFrame, epsilon: float) -> DataFrame:
    """Independent counters over (base, edited, near_miss) margins for the alternative."""
    up = lambda c: F.col(c) > epsilon
    down = lambda c: F.col(c) < -epsilon
    n = F.count("*")
    return wide.agg(n.alias("n"), (F.count_if(down("base") & up("edited") & down("near_miss")) / n).alias("dfr"), (F.count_if(up("edited") & up("near_miss")) / n).alias("over_flip"), (F.count_if(down("base") & up("edited")) / n).alias("cfr"), F.count_if(F.greatest(*[(F.abs(c) <= epsilon).cast("int") for c in map(F.col, ("base", "edited", "near_miss"))]) == 1).alias("any_tie"))


def polarity_conflicts(items: DataFrame) -> DataFrame:
    """Drugs that are to be avoided in train and right in held-out splits, or the other way round."""
    held = F.col("split") != "train"
    has = lambda polarity, where: F.bool_or((F.col("polarity") == polarity) & where)
    g = items.groupBy("drug").agg(has("avoid", ~held).alias("avoid_train"), has("correct", ~held).alias("correct_train"), has("avoid", held).alias("avoid_held"), has("correct", held).alias("correct_held"))
    return g.where("(avoid_train AND correct_held) OR (correct_train AND avoid_held)").select("drug")


def vocabulary(tokens: DataFrame, column: str, size: int = 5000) -> list[str]:
    """The `size` most frequent terms of two rows or more; of equally frequent ones those first by name. tokens: _id, and column, a list of terms."""
    terms = tokens.select("_id", F.explode(column).alias("term"))
    known = terms.groupBy("term").agg(F.count("*").alias("n"), F.min("_id").alias("first"), F.max("_id").alias("last")).where("first <> last")
    return [r["term"] for r in known.orderBy(F.desc("n"), "term").limit(size).select("term").collect()]


def bag_of_words_accuracy(train: DataFrame, test: DataFrame) -> DataFrame:
    """TF-IDF over words and word pairs with logistic regression: accuracy by test group. Vocabulary: 5,000 terms of
    two texts or more. train and test: text, label; test also grp. Texts are split once and counted once: both tables are stored,
    as each step of the fit would do it again."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizerModel, NGram, Normalizer, RegexTokenizer, VectorAssembler

    stages = [RegexTokenizer(inputCol="text", outputCol="w", pattern=r"\w\w+", gaps=False), NGram(n=2, inputCol="w", outputCol="w2")]
    pairs = stages[1]
    tokens = written(stages[0].transform(train).select(F.monotonically_increasing_id().alias("_id"), "w", "label"), "bag-of-words-tokens")
    counters = [CountVectorizerModel.from_vocabulary(vocabulary(pairs.transform(tokens), c) or [""], inputCol=c, outputCol=f"{c}_tf") for c in ("w", "w2")]
    counted = written(PipelineModel([pairs, *counters]).transform(tokens).select("w_tf", "w2_tf", "label"), "bag-of-words-counts")
    stages += [*counters, *[IDF(inputCol=f"{c}_tf", outputCol=f"{c}_x").fit(counted) for c in ("w", "w2")]]
    stages += [VectorAssembler(inputCols=["w_x", "w2_x"], outputCol="raw"), Normalizer(inputCol="raw", outputCol="features")]
    stages.append(LogisticRegression(maxIter=20, regParam=0.01).fit(PipelineModel(stages[4:]).transform(counted)))
    # Stored and read again: a model just fitted holds its training summary, and with it the session, which cannot go to
    # executors once a query of the session has used an Observation.
    path = scratch(train.sparkSession, "bag-of-words")
    PipelineModel(stages).write().save(path)
    out = PipelineModel.load(path).transform(test)
    return out.groupBy("grp").agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


def response_only(items: DataFrame) -> DataFrame:
    """What the responses alone give away: a template's base and edited item bring the chosen (1) and the rejected (0)
    action each, so a text stands for both labels as often and the accuracy of a sound set is one half."""
    paired = items.where(F.col("item_type").isin("base", "edited"))
    whole = paired.groupBy("template_id").agg(F.count_distinct("item_type").alias("n")).where("n = 2").select("template_id")
    sides = F.array(F.struct(F.col("chosen").alias("text"), F.lit(1.0).alias("label")), F.struct(F.col("rejected").alias("text"), F.lit(0.0).alias("label")))
    texts = paired.join(whole, "template_id").select(F.explode(sides).alias("s")).select("s.*", F.lit("balanced").alias("grp"))
    return bag_of_words_accuracy(texts, texts)
