"""What several models that tag the same records agree on, and what to believe of them.

labels: (model, key, tags), a row for each record that a model answered, with the
array of its tags. Models are few; records may be many.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedback_engine.functions.numbers import percent

YES, NO, SILENT = "1", "0", "-"
#: Models of one consensus; a record's votes on a tag are one of 3 ** models patterns.
MOST_MODELS = 10


def pairwise(labels: DataFrame, key: str = "key") -> DataFrame:
    """For each pair of models: records both answered, those with equal tags (also in percent), and the mean share of tags in common (1 where neither has any)."""
    each = labels.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("model", F.array_distinct("tags").alias("tags")))).alias("m"))  # a row for each model at most
    pairs = F.flatten(F.transform("m", lambda a, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda b: F.struct(a["model"].alias("model_a"), b["model"].alias("model_b"), a["tags"].alias("a"), b["tags"].alias("b")))))
    rows = each.select(F.explode(pairs).alias("p")).select("p.*")
    both, either = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    out = rows.groupBy("model_a", "model_b").agg(F.count("*").alias("n"), F.sum((both == either).cast("long")).alias("same"), F.round(F.avg(F.when(either == 0, 1.0).otherwise(both / either)), 4).alias("overlap"))
    return out.withColumn("same_pct", percent(F.col("same"), F.col("n")))


def votes(labels: DataFrame, models: Sequence[str], key: str = "key") -> DataFrame:
    """key, tag, pattern of each tag that some model gave a record: of each model in order, yes, no, or silent if it did not answer the record."""
    if not 0 < len(models) <= MOST_MODELS:
        raise ValueError(f"1 to {MOST_MODELS} models")
    each = labels.groupBy(key).agg(*[F.max(F.when(F.col("model") == m, F.col("tags"))).alias(f"_m{i}") for i, m in enumerate(models)])
    given = F.array_distinct(F.flatten(F.array(*[F.coalesce(f"_m{i}", F.array().cast("array<string>")) for i in range(len(models))])))
    rows = each.select("*", F.explode(given).alias("tag"))
    vote = [F.when(F.col(f"_m{i}").isNull(), SILENT).when(F.array_contains(f"_m{i}", F.col("tag")), YES).otherwise(NO) for i in range(len(models))]
    return rows.select(key, "tag", F.concat(*vote).alias("pattern"))


def fitted(patterns: dict[str, int], n_models: int, rounds: int = 100) -> tuple[float, list[tuple[float, float]], dict[str, float]]:
    """From how often each pattern occurs alone: the share of tags that hold, of each model how often it gives one that holds and one that doesn't, and each pattern's probability.

    Expectation and maximisation with a small prior; a model is taken to be better
    than chance at the start, which tells the two classes apart.
    """
    share, rates = 0.5, [(0.8, 0.2)] * n_models
    believed: dict[str, float] = {}
    for _ in range(rounds):
        for p in patterns:
            yes, no = math.log(share), math.log(1 - share)
            for vote, (hit, false) in zip(p, rates, strict=True):
                if vote != SILENT:
                    yes += math.log(hit if vote == YES else 1 - hit)
                    no += math.log(false if vote == YES else 1 - false)
            believed[p] = 1 / (1 + math.exp(min(no - yes, 700)))
        total = sum(patterns.values())
        share = (sum(n * believed[p] for p, n in patterns.items()) + 1) / (total + 2)
        rates = []
        for i in range(n_models):
            known = [(p[i] == YES, n, believed[p]) for p, n in patterns.items() if p[i] != SILENT]
            rate = lambda weight: (sum(n * weight(b) for given, n, b in known if given) + 1) / (sum(n * weight(b) for _, n, b in known) + 2)  # noqa: B023, E731
            rates.append((rate(lambda b: b), rate(lambda b: 1 - b)))
    return share, rates, believed


def consensus(labels: DataFrame, models: Sequence[str], allowed: Sequence[str], key: str = "key", least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(key, tags, confidence) of every record that a model answered, and (model, hit_rate, false_rate).

    A tag stays if it is probable by the votes of all, weighted by how good each
    model is; how good it is comes from the votes alone. Tags that no model gave a
    record count as voted down by those that answered. Confidence is the mean
    probability of what stays, null without any. Counts of patterns, 3 ** models of
    them, are all that reaches the driver.
    """
    ok = labels.select("model", key, F.array_intersect(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, allowed))).alias("tags")).filter(F.col("model").isin(*models))
    rows = votes(ok, models, key)
    patterns = {r["pattern"]: r["n"] for r in rows.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    given = ok.groupBy(key).agg(*[F.max(F.when(F.col("model") == m, 1)).alias(f"_m{i}") for i, m in enumerate(models)])
    silent = F.concat(*[F.when(F.col(f"_m{i}").isNull(), SILENT).otherwise(NO) for i in range(len(models))])
    for r in given.groupBy(silent.alias("pattern")).agg(F.count("*").alias("n")).collect():
        asked = sum(n for p, n in patterns.items() if p.replace(YES, NO) == r["pattern"] and YES in p)
        patterns[r["pattern"]] = len(allowed) * r["n"] - asked
    _, rates, believed = fitted({p: n for p, n in patterns.items() if n > 0}, len(models)) if patterns else (0.5, [(0.5, 0.5)] * len(models), {})
    kept = [p for p, b in believed.items() if b >= least and YES in p]
    spark = labels.sparkSession
    table = spark.createDataFrame([(p, believed[p]) for p in kept], "pattern string, probability double")
    found = rows.join(F.broadcast(table), "pattern").groupBy(key).agg(F.array_sort(F.collect_set("tag")).alias("tags"), F.round(F.avg("probability"), 4).alias("confidence"))  # 3 ** models rows at most
    out = ok.select(key).distinct().join(found, key, "left").select(key, F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "confidence")
    return out, spark.createDataFrame([(m, round(h, 4), round(f, 4)) for m, (h, f) in zip(models, rates, strict=True)], "model string, hit_rate double, false_rate double")
