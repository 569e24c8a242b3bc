"""Quality rules learned from labels: an ordered list of threshold conjunctions that reject texts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.text import features, stored

#: Shares of rows at whose feature values thresholds are tried, for either label.
SHARES = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98)
LEAST_WORDS = 50


@dataclass(frozen=True)
class Condition:
    """feature >= threshold if above, else feature < threshold."""

    feature: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, Column]) -> Column:
        value = values[self.feature]
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _all(rule: Sequence[Condition], values: dict[str, Column]) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.holds(values)
    return out


def verdict(rules: Sequence[Rule], values: dict[str, Column]) -> Column:
    """The list as one conditional expression: the first rule that holds rejects; kept if none does."""
    out = None
    for rule in rules:
        holds = _all(rule, values)
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _thresholds(rows: DataFrame, names: Sequence[str]) -> dict[str, list[float]]:
    found: dict[str, set[float]] = {n: set() for n in names}
    for row in rows.groupBy("bad").agg(*[F.percentile_approx(n, list(SHARES), 10000).alias(n) for n in names]).collect():
        for n in names:
            found[n].update(row[n] or ())
    return {n: sorted(v) for n, v in found.items()}


def learn_rules(
    stats: DataFrame,
    labels: DataFrame,
    max_conditions: int = 3,
    least_precision: float = 0.9,
    least_support: int = 5,
) -> list[Rule]:
    """Sequential covering over all labelled rows: rules for label 0, each grown on two thirds and pruned on the rest.

    stats is the result of text_stats, labels has doc_id and quality (0 or 1). Growing adds the threshold that gains most
    (FOIL's gain) until no row of label 1 is left; pruning cuts the rule to the prefix that is best on the other third,
    where (p - n) / (p + n) is largest. Rows that a rule covers leave, and the next rule is grown. Learning ends when a
    rule isn't precise enough on the rows it was pruned on, or covers too few; as each rule covers new rows, it does end.

    All counts are grouped aggregates: a step sends two counts for each feature and bin to the driver, whatever the number
    of rows. Rows without label or id take no part. Without labels of both kinds there are no rules.
    """
    names = list(features())
    part = F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(3)) < 2
    labelled = (
        labels.select(F.col("doc_id"), F.col("quality"))
        .filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    rows = stored(
        stats.join(labelled, "doc_id").select(
            (F.col("quality") == 0).alias("bad"), part.alias("grow"), *[c.alias(n) for n, c in features().items()]
        )
    )
    tried = _thresholds(rows, names)
    values = {n: F.col(n) for n in names}
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("f"),
                sum([(values[n] >= t).cast("int") for t in tried[n]], F.lit(0)).alias("bin"),
            )
            for f, n in enumerate(names)
        ]
    )
    binned = stored(rows.withColumn("cells", cells))

    def counts(where: Column) -> tuple[dict[tuple[int, int], tuple[int, int]], int, int]:
        got = (
            binned.filter(where)
            .select("bad", F.explode("cells").alias("c"))
            .groupBy("c.f", "c.bin")
            .agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
            .collect()
        )
        p, n = (sum(r[k] for r in got if r["f"] == 0) for k in ("p", "n"))
        return {(r["f"], r["bin"]): (r["p"], r["n"]) for r in got}, p, n

    def best(where: Column) -> tuple[Condition, int, int] | None:
        cell, p0, n0 = counts(where)
        if not p0:
            return None
        before, found = math.log2(p0 / (p0 + n0)), None
        for f, name in enumerate(names):
            below = [0, 0]
            for b, threshold in enumerate(tried[name]):
                p, n = cell.get((f, b), (0, 0))
                below = [below[0] + p, below[1] + n]
                for above, (q, m) in ((False, below), (True, [p0 - below[0], n0 - below[1]])):
                    if q >= least_support:
                        gain = q * (math.log2(q / (q + m)) - before)
                        key = (round(gain, 9), -f, -b, above)
                        if gain > 0 and (found is None or key > found[0]):
                            found = (key, Condition(name, above, threshold), q, m)
        return found and found[1:]

    rules: list[Rule] = []
    left = F.lit(True)
    while True:
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            step = best(left & F.col("grow") & _all(rule, values))
            if step is None:
                break
            rule.append(step[0])
            if step[2] == 0:
                break
        if not rule:
            break
        held = [_all(rule[: k + 1], values) for k in range(len(rule))]
        seen = binned.filter(left & ~F.col("grow")).agg(
            *[F.count_if(h & F.col("bad")).alias(f"p{k}") for k, h in enumerate(held)],
            *[F.count_if(h & ~F.col("bad")).alias(f"n{k}") for k, h in enumerate(held)],
        ).first()
        scored = [(seen[f"p{k}"], seen[f"n{k}"], k) for k in range(len(rule))]
        p, n, k = max(scored, key=lambda s: ((s[0] - s[1]) / max(1, s[0] + s[1]), s[0], -s[2]))
        if p + n == 0 or p < least_precision * (p + n) or p < max(1, least_support // 2):
            break
        rules.append(tuple(rule[: k + 1]))
        left = left & ~_all(rules[-1], values)
    return rules


def judged(stats: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """stats with base_failed and kept: false where the base rules fail, else what the learned list says."""
    return stats.withColumns(
        {"base_failed": base_failed(), "kept": ~base_failed() & verdict(rules, features())}
    )
