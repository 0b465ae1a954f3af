"""Quality classifier by hierarchical empirical Bayes.

A logistic regression over features of the whole text gives each document's evidence. Grouped sums of the
evidence give each site (host) and each of its sections (path) a Beta posterior: the prior of a host is the
global rate, that of a section its host's posterior, and how strongly each level shrinks is estimated from the
spread between groups (method of moments). A document's score adds the log odds of its section, against the global
ones, to its own; documents below the threshold are rejected.

The regression learns from at most SAMPLE labelled documents, the first by a hash of the id; only their features
reach the driver. An id with several labels counts with the least, one with several texts with the text of the least hash. Evidence is computed once for the sums and once for the scores instead of being stored; texts are not shuffled
unless there are more sections than may be broadcast, in which case AQE splits a hot host.

Edge cases: a null or empty text, or one of white space, has evidence 0 and is rejected, and counts for no site; a null host or path is a
group of its own; without labels of both kinds, all other documents are kept; a score of just the threshold is kept; repeated
rows each count and get equal scores; an empty table gives an empty result; columns named like results are replaced, others stay.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import Scratch, give_back, join_sized, without

#: Labelled documents that the regression may learn from; score below which a document is rejected.
SAMPLE, THRESHOLD = 6000, 0.5
PUNCTUATION = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
NAMES = 12 + len(PUNCTUATION)


def features(text: str | None) -> np.ndarray:
    """Shares of kinds of bytes, and of words and lines that repeat."""
    out = np.zeros(NAMES, np.float32)
    raw = text.encode("utf-8", "replace") if text else b""
    found = raw.split()
    if not found:
        return out
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    words = Counter(found)
    lines = raw.split(b"\n")
    out[:12] = (
        math.log1p(n),
        math.sqrt(counts[65:91].sum()),
        math.sqrt(counts[97:123].sum()),
        math.sqrt(counts[48:58].sum()),
        math.sqrt(counts[32]),
        math.sqrt(counts[10]),
        math.sqrt(counts[128:].sum()),
        math.log1p(len(found)),
        math.log1p(n / len(found)),
        len(words) / len(found),
        len(set(lines)) / len(lines),
        max(words.values()) / len(found),
    )
    out[12:] = np.sqrt(counts[PUNCTUATION])
    return out


class Model:
    """Standardised logistic regression; with one kind of label, all are good."""

    def __init__(self, x: np.ndarray, y: np.ndarray, strength: float = 1.0, steps: int = 30):
        self.mean, self.scale = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(NAMES), np.ones(NAMES))
        self.weights = np.zeros(NAMES + 1)
        self.trained = len(set(y.tolist())) == 2
        if not self.trained:
            return
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        ridge = np.diag([1e-6] + [strength] * NAMES)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ self.weights)
            self.weights += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Chance of good quality; 0 of texts without words."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        p = 1 / (1 + np.exp(-np.clip(z @ self.weights[1:] + self.weights[0], -30, 30))) if self.trained else np.ones(len(x))
        return np.where(x[:, 0] > 0, p, 0.0)


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Trains on at most ``sample`` labelled documents."""

    @F.pandas_udf("array<float>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([features(t) for t in batch], dtype=object)
        give_back()

    usable = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).select(F.col(id).alias("_l"), F.col(label).cast("int").alias("_y"))
    # The hash bound leaves a little more than the sample, which is then cut to size: so many rows are broadcast and collected at most.
    share = min(1.0, 1.2 * sample / max(1, usable.agg(F.approx_count_distinct("_l", 0.02)).first()[0]))
    place = F.pmod(F.xxhash64("_l", F.lit(1)), F.lit(1 << 20))
    drawn = usable.where(place < F.lit(int(share * (1 << 20)))).groupBy("_l").agg(F.min("_y").alias("_y"))
    drawn = drawn.orderBy(place, "_l").limit(sample)
    found = docs.select(F.col(id).alias("_i"), F.col(text).alias("_t")).join(F.broadcast(drawn), F.col("_i") == F.col("_l"))
    rows = found.select("_l", F.struct(F.xxhash64("_t"), measured("_t").alias("f"), "_y").alias("_r")).groupBy("_l").agg(F.min("_r").alias("_r")).collect()
    rows = [r["_r"] for r in sorted(rows, key=lambda r: r["_l"])]
    return Model(np.array([r["f"] for r in rows], np.float64).reshape(-1, NAMES), np.array([r["_y"] for r in rows], np.float64))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _shrinkage(groups: DataFrame, rate: float) -> float:
    """Prior observations that a group's prior is worth, from (n, s) of each group: rate (1 - rate) over the variance between groups, less 1."""
    r = groups.where("n > 0").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - rate, 2)).alias("d"), F.sum("v").alias("v")).first()
    if not r["n"] or r["k"] < 2:
        return 1e6
    within = max(r["v"] / r["n"], 1e-9)
    between = (r["d"] - (r["k"] - 1) * within) / max(r["n"] - r["nn"] / r["n"], 1e-9)
    return min(1e6, max(1.0, rate * (1 - rate) / between - 1)) if between > 0 else 1e6


def score(docs: DataFrame, model: Model, host: str | Column = "source", path: str | Column = "lang", text: str = "text", threshold: float = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """docs with evidence, site_rate (posterior of the section), score and keep; columns so named are replaced."""
    scratch = scratch or Scratch(docs.sparkSession)
    as_column = lambda c: F.col(c) if isinstance(c, str) else c

    @F.pandas_udf("double")
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.evidence(np.array([features(t) for t in batch], np.float64).reshape(-1, NAMES)))
        give_back()

    out = without(docs, "evidence", "site_rate", "score", "keep", "_host", "_path")
    seen = out.select("*", as_column(host).cast("string").alias("_host"), as_column(path).cast("string").alias("_path"), evidence(F.col(text)).alias("evidence"))
    good = F.col("evidence") > 0
    paths = seen.where(good).groupBy("_host", "_path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("evidence").alias("s"), F.sum(F.col("evidence") * (1 - F.col("evidence"))).alias("v0"), F.sum(F.col("evidence") * F.col("evidence")).alias("q"))
    paths = scratch.table(paths.withColumn("v", F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))).drop("v0", "q"), "sections")
    hosts = scratch.table(paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("v").alias("v")), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = min(1 - 1e-6, max(1e-6, (total["s"] or 0.0) / max(1.0, total["n"] or 0.0)))
    of_host, of_path = _shrinkage(hosts, rate), _shrinkage(paths, rate)
    hosts = hosts.select(F.col("_host").alias("_h"), ((F.col("s") + of_host * rate) / (F.col("n") + of_host)).alias("host_rate"))
    sections = join_sized(paths, hosts, F.col("_host").eqNullSafe(F.col("_h")))
    sections = sections.select(F.col("_host").alias("_h"), F.col("_path").alias("_p"), ((F.col("s") + of_path * F.col("host_rate")) / (F.col("n") + of_path)).alias("site_rate"))
    sections = scratch.table(sections, "rates")
    both = join_sized(seen, sections, F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_p")), "left")
    odds = _logit(F.col("evidence")) + _logit(F.col("site_rate")) - _logit(F.lit(rate))
    final = F.when(good, 1 / (1 + F.exp(-odds))).otherwise(0.0)
    names = [F.col(c) for c in out.columns]
    return both.select(*names, "evidence", F.coalesce("site_rate", F.lit(rate)).alias("site_rate"), final.alias("score"), (good & ((final >= threshold) | F.lit(not model.trained))).alias("keep"))
