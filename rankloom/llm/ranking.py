"""Document quality by pairwise ranking: a Bradley-Terry model on feature differences."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.text import features, stored

#: Shares of the training rows at whose feature values a step of the score may lie.
KNOTS = (0.01, 0.03, 0.06, 0.1, 0.15, 0.25, 0.5, 0.75, 0.85, 0.9, 0.94, 0.97, 0.99)


@dataclass(frozen=True)
class Model:
    """score = logistic((sum of the steps that lie below the feature - threshold) / scale)."""

    steps: dict[str, list[tuple[float, float]]]
    threshold: float
    scale: float

    def raw(self, values: dict[str, Column]) -> Column:
        total = F.lit(0.0)
        for name, steps in self.steps.items():
            for at, weight in steps:
                total = total + F.when(values[name] > F.lit(at), F.lit(weight)).otherwise(F.lit(0.0))
        return total

    def score(self, values: dict[str, Column]) -> Column:
        return 1.0 / (1.0 + F.exp(-(self.raw(values) - F.lit(self.threshold)) / F.lit(self.scale)))


def held_out(doc_id: Column) -> Column:
    """Whether no label of this row may be learned; false for a null id, which is never learned either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_ranking(
    stats: DataFrame, labels: DataFrame, max_rows: int = 40_000, partners: int = 4, ridge: float = 1e-3
) -> Model:
    """Fit on preference pairs: a row of label 1 is preferred to a row of label 0.

    stats is the result of text_stats, labels has doc_id and quality. At most about max_rows labelled ids are fitted,
    chosen by a hash of the id, neither label pushed out by the other; the bound is for fitting only. Steps, threshold,
    scale and shares are counted over all labelled rows. Each row of label 1 meets `partners` rows of label 0, drawn by
    hash from all that are fitted, and the pair's feature difference is an example of logistic loss without intercept, every other one
    turned round. Thresholding: the raw score above which the share of training rows equals the share of label 1.

    Held-out rows, null ids, labels that are neither 0 nor 1 take no part. Without rows of both labels the model has no
    steps, and every text scores 0.5.
    """
    values = features()
    labelled = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    train = stored(
        stats.join(labelled, "doc_id").select("doc_id", "quality", *[c.alias(n) for n, c in values.items()])
    )
    seen = train.agg(
        F.count_if(F.col("quality") == 1).alias("n1"),
        F.count_if(F.col("quality") == 0).alias("n0"),
        *[F.percentile_approx(n, list(KNOTS), 10000).alias(n) for n in values],
    ).first()
    if not seen["n1"] or not seen["n0"]:
        return Model({}, 0.0, 1.0)
    knots = {n: sorted(set(seen[n])) for n in values}
    steps = F.array(*[(F.col(n) > F.lit(t)).cast("double") for n in values for t in knots[n]])
    # Only the fit is bounded: each label may fill half of max_rows, and what the other leaves free.
    ids = {r["quality"]: r["ids"] for r in train.groupBy("quality").agg(F.count_distinct("doc_id").alias("ids")).collect()}
    share = {q: min(1.0, max(max_rows / 2, max_rows - ids[1 - q]) / ids[q]) for q in (0, 1)}
    bucket = F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = train.filter(bucket < F.when(F.col("quality") == 0, share[0]).otherwise(share[1]))
    rows = stored(sample.select("doc_id", "quality", steps.alias("x")))
    # Rows of label 0 are numbered within 64 groups, then over the groups, and a row of label 1 draws a number.
    group = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(64)).cast("int")
    zeros = rows.filter("quality = 0").withColumn("group", group)
    sizes = {r["group"]: r["count"] for r in zeros.groupBy("group").count().collect()}
    heads = list(accumulate([sizes.get(g, 0) for g in range(64)], initial=0))
    own = F.row_number().over(Window.partitionBy("group").orderBy("doc_id", "x")) - 1
    worse = zeros.select(
        (F.get(F.array(*[F.lit(h) for h in heads]), F.col("group")) + own).cast("long").alias("number"),
        F.col("x").alias("low"),
    )
    draw = F.xxhash64(F.lit(12), F.col("doc_id"), F.col("turn"))
    pairs = (
        rows.filter("quality = 1")
        .withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(partners))))
        .withColumn("number", F.pmod(draw, F.lit(heads[-1]).cast("long")))
        .join(worse, "number")
        .withColumn("side", F.when(F.col("turn") % 2 == 0, 1.0).otherwise(-1.0))
        .select(
            F.when(F.col("side") > 0, 1.0).otherwise(0.0).alias("label"),
            array_to_vector(F.zip_with("x", "low", lambda a, b: (a - b) * F.col("side"))).alias("features"),
        )
    )
    fitted = LogisticRegression(fitIntercept=False, standardization=False, regParam=ridge, maxIter=60).fit(pairs)
    weights, out = list(fitted.coefficients), {}
    for n in values:
        out[n] = [(t, float(weights.pop(0))) for t in knots[n]]
    model = Model(out, 0.0, 1.0)
    raw = train.select(model.raw({n: F.col(n) for n in values}).alias("raw"))
    share0 = seen["n0"] / (seen["n0"] + seen["n1"])
    low, at, high = raw.agg(
        F.percentile_approx("raw", [0.5 * share0, share0, (1 + share0) / 2], 10000)
    ).first()[0]
    # Between the quantile and the next score, so that the rows above it are just the share of label 1.
    above = raw.filter(F.col("raw") > at).agg(F.min("raw")).first()[0]
    return Model(out, at if above is None else (at + above) / 2, max(1e-6, (high - low) / 8))


def ranked(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted, for every row of stats."""
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(features()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
