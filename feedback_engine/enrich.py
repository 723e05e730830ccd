"""Batch enrichment by a pluggable model, with resume, defaults and accounting.

The model is any function of a list of texts; it runs in `mapInPandas` on
bounded batches. Offline, the rule tagger stands in for it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedback_engine.functions.text import prepared, tags
from feedback_engine.operators.shape import ISSUE, merged_results, pending, sanitised

#: Dollars for a million tokens in and out.
PRICE_IN, PRICE_OUT = 0.07, 0.28
Model = Callable[[list[str]], list[list[str]]]


def load_rules(path: str) -> list[tuple[str, list[str]]]:
    """Rules of the tagger from a JSON object {name: [patterns]}; a table of any size is a parameter."""
    with open(path, encoding="utf-8") as f:
        return list(json.load(f).items())


def by_rules(records: DataFrame, rules: Sequence[tuple[str, Sequence[str]]], text: str = "text") -> DataFrame:
    """records with their tags and a confidence: high with one tag or more, else none."""
    own = F.coalesce(F.col(text), F.lit(""))
    out, bare, known = prepared(records.withColumn("_own", own), [p for _, ps in rules for p in ps], "_own", deal=False)
    out = out.withColumn("tags", tags(F.col("_own"), rules, bare, known)).drop("_own", "_bare", "_held")
    return out.withColumn("confidence", F.when(F.size("tags") > 0, "high").otherwise("none"))


def by_model(records: DataFrame, model: Model, key: str, allowed: Sequence[str], batch: int = 200, retries: int = 3, wait: float = 0.0) -> DataFrame:
    """key, tags, violations, error for records (key, text): batches of `batch` texts, tried `retries` times, and an error instead of tags after that."""
    names = set(allowed)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                found, error = None, None
                for attempt in range(retries):
                    try:
                        found, error = model(part["text"].tolist()), None
                        break
                    except Exception as e:  # noqa: BLE001  a model may fail in any way; its error is data
                        error = str(e)
                        time.sleep(wait * (attempt + 1))
                found = found if found is not None else [[] for _ in range(len(part))]
                kept = [[t for t in x if t in names] for x in found]
                yield pd.DataFrame({key: part[key].to_numpy(), "tags": kept, "violations": [len(a) - len(b) for a, b in zip(found, kept, strict=True)], "error": [error] * len(part)})

    return records.select(key, "text").mapInPandas(run, f"{key} {dict(records.dtypes)[key]}, tags array<string>, violations long, error string")


def extracted(records: DataFrame, model: Callable[[list[str]], list[list[dict]]], key: str, batch: int = 80, retries: int = 3, wait: float = 0.0, least: int = 0) -> DataFrame:
    """key, issues, error for records (key, text): nested issues that a model finds, sanitised. Texts shorter than `least` are not sent and have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                texts = part["text"].fillna("").tolist()
                sent = [i for i, t in enumerate(texts) if len(t) >= least]
                found: list[list[dict]] = [[] for _ in texts]
                error = None
                for attempt in range(retries if sent else 0):
                    try:
                        for i, issues in zip(sent, model([texts[i] for i in sent]), strict=True):
                            found[i] = issues
                        error = None
                        break
                    except Exception as e:  # noqa: BLE001  a model may fail in any way; its error is data
                        error = str(e)
                        time.sleep(wait * (attempt + 1))
                yield pd.DataFrame({key: part[key].to_numpy(), "raw": [json.dumps(x) for x in found], "error": [error] * len(part)})

    replies = records.select(key, "text").mapInPandas(run, f"{key} {dict(records.dtypes)[key]}, raw string, error string")
    return replies.select(key, sanitised(F.from_json("raw", f"array<{ISSUE}>")).alias("issues"), "error")


def resumed(records: DataFrame, done: DataFrame, key: str, enrich: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of the records that have none yet."""
    return enrich(pending(records, done, key))


def with_results(records: DataFrame, results: DataFrame, key: str, version: str) -> DataFrame:
    """records with their latest tags and confidence, or no tags and none."""
    return merged_results(records, results, key, version, {"tags": F.array().cast("array<string>"), "confidence": F.lit("none")})


def last_errors(results: DataFrame, order: Sequence[str], n: int = 20) -> DataFrame:
    """The last n results with an error, newest first."""
    return results.filter("error is not null").orderBy(*[F.desc(c) for c in order]).limit(n)


def costs(log: DataFrame) -> DataFrame:
    """Tokens and dollars of a run log (tokens_in, tokens_out, violations)."""
    dollars = F.sum("tokens_in") / 1e6 * PRICE_IN + F.sum("tokens_out") / 1e6 * PRICE_OUT
    return log.agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(dollars, 4).alias("dollars"), F.sum("violations").alias("violations"))
