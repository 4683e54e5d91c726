"""Source mixing by subset-sum budget fitting.

Documents are counted by exact word length in each source. A target is met by whole epochs, a
proportional share of every length, and a bounded-knapsack dynamic programme over the remaining
counts for the rest; the documents of each chosen length are the first by a seeded hash. Null
text has size 0, a null source is a source of its own (last), equal hashes are ordered by
doc_id, an empty table gives an empty result. A source's histogram holds one row per distinct
length; the driver holds one row per source of the data, some 100 bytes each, to share the budget
among them. Up to EXACT words of a budget are fitted exactly; of a larger one all but EXACT words are
a proportional share of every length, which keeps the mix of lengths, and the programme fits the rest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANK, read, stored, text_of

PATTERN, SHARE, MOST, SEED, BUCKET, EXACT = (5.0, 2.0, 1.0), 1.5, 2.0, 42, 256, 20_000


def targets(totals: list[tuple[str | None, int]], share: float = SHARE, most: float = MOST) -> dict:
    """Shares by weight; sources reach their cap in the order of cap over weight, and what they leave is shared anew."""
    order = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: PATTERN[i % len(PATTERN)] for i, (s, _) in enumerate(order)}
    cap, left, total, out = {s: most * n for s, n in order}, share * sum(n for _, n in order), sum(weight.values()), {}
    for s in sorted(cap, key=lambda s: cap[s] / weight[s]):
        out[s] = min(cap[s], left * weight[s] / total) if total > 1e-9 else cap[s]
        left, total = left - out[s], total - weight[s]
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, for the sum nearest the budget (the lower of two).

    All but the last EXACT words of a large budget are a proportional share and long documents; the
    programme then chooses among all remaining counts."""
    take = np.zeros_like(counts)
    if budget > EXACT:
        take = np.floor(counts * ((budget - EXACT) / int((lengths * counts).sum()))).astype(np.int64)
        take[lengths == 0] = 0
    left = int(budget - (lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left > 2 * EXACT and lengths[i]:
            k = min(counts[i] - take[i], (left - EXACT) // lengths[i])
            take[i] += k
            left -= int(k * lengths[i])
    free = [i for i in np.argsort(lengths, kind="stable") if 0 < lengths[i] < 2 * left and counts[i] > take[i]]
    if not free or left <= 0:
        return take
    goal, left = left, 2 * left
    who, many = np.full(left + 1, -1, np.int64), np.zeros(left + 1, np.int64)  # the chunk that first reached a sum
    reach = np.zeros(left + 1, bool)
    reach[0] = True
    for i in free:
        n, copies = int(counts[i] - take[i]), 1
        while n > 0 and not reach[goal]:
            copies = min(copies, n)
            step = int(lengths[i]) * copies
            if step > left:
                break
            new = np.zeros_like(reach)
            new[step:] = reach[:-step] & ~reach[step:]
            who[new], many[new] = i, copies
            reach |= new
            n, copies = n - copies, copies * 2
        if reach[goal]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - goal))])
    extra = np.zeros_like(take)
    while at > 0:
        extra[who[at]] += many[at]
        at -= int(lengths[who[at]] * many[at])
    return np.minimum(take + extra, counts)


def plan_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size", kind="stable").reset_index(drop=True)
    lengths, counts, target = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), float(pdf["target"][0])
    total = int((lengths * counts).sum())
    epochs = min(int(MOST), int(target // total)) if total else 0
    rest = round(target - epochs * total)
    pdf["epochs"], pdf["k"] = epochs, fit(lengths, counts, rest) if rest > 0 and epochs < MOST else 0
    return pdf[["source", "size", "epochs", "k"]].astype({"epochs": "int64", "k": "int64"})


def mix(docs: DataFrame, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    spark = docs.sparkSession
    words = F.size(F.filter(F.split(text_of(docs), BLANK), lambda x: x != "")).cast("long")
    rows = stored(docs.select("doc_id", docs["source"].cast("string").alias("source"), words.alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("h")), "mix-rows")
    hist = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    totals = [(r[0], int(r[1])) for r in hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n"))).collect()]
    goals = targets(totals)
    goal = spark.createDataFrame([(s, n, float(goals[s])) for s, n in totals], "source string, source_size long, target double")
    same = lambda a, b, *keys: [a[k].eqNullSafe(b[k]) for k in keys]
    hist = hist.alias("a").join(goal.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "size", "n", "source_size", "target")
    plan = hist.groupBy("source").applyInPandas(plan_source, "source string, size long, epochs long, k long")
    plan = stored(hist.alias("a").join(plan.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size"))).select("a.*", "epochs", "k"), "mix-plan")
    # a length that many rows share is cut into buckets by hash, so no task ranks a hot group
    rows = rows.alias("a").join(plan.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size"))).select("a.*", "n", "source_size", "target", "epochs", "k", F.pmod(F.xxhash64(F.lit(7), "h"), F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET))).alias("b"))
    counts = rows.groupBy("source", "size", "b").count()
    first = counts.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("b").alias("c"), (F.sum("count").over(Window.partitionBy("source", "size").orderBy("b")) - F.col("count")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "b").orderBy("h", "doc_id"))
    rows = rows.withColumn("rank", rank).join(first, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("b") == F.col("c")))
    times = F.col("epochs") + (F.col("first") + F.col("rank") <= F.col("k")).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))
