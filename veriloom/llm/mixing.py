"""Mixing sources to target shares by cube-method balanced sampling.

The largest total that all sources can serve under their repetition caps is
found first; each text then has an expected number of uses, whose whole part
is certain and whose fraction is an inclusion probability.  The flight phase
moves these probabilities through the null space of the balancing constraints
(documents and tokens of the source) block by block; what stays fractional in each
block flies again with that of other blocks until a landing problem of a few
texts remains, which is rounded within the remaining tolerance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.session import materialize

#: Texts of one block of the flight phase.
BLOCK = 5_000
EPS = 1e-9


def null_vector(b: np.ndarray) -> np.ndarray:
    """A vector u of norm 1 with b @ u = 0, for a matrix of one column more than it has rows."""
    if b.shape == (2, 3):  # the usual case, documents and tokens: the cross product of both rows
        (a0, a1, a2), (b0, b1, b2) = b.tolist()
        u = np.array((a1 * b2 - a2 * b1, a2 * b0 - a0 * b2, a0 * b1 - a1 * b0))
        size = float(np.abs(u).max())
        if size > 1e-12:
            return u / size
    return np.linalg.svd(b)[2][-1]


def flight(p: np.ndarray, x: np.ndarray, seed: int) -> np.ndarray:
    """Move ``p`` within [0, 1] along the null space of the constraints x.T @ p until at most x.shape[1] stay fractional."""
    draw = np.random.default_rng(seed)
    p = p.copy()
    a = x.T.astype(float)
    m = a.shape[0]
    open_ = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    hand, rest = open_[: m + 1], open_[m + 1 :]
    rest.reverse()
    while len(hand) > m:
        u = null_vector(a[:, hand]).tolist()
        q = p[hand].tolist()
        up = down = float("inf")
        for v, w in zip(u, q):
            if v > 1e-14:
                up, down = min(up, (1 - w) / v), min(down, w / v)
            elif v < -1e-14:
                up, down = min(up, -w / v), min(down, (w - 1) / v)
        if up == float("inf"):
            break
        step = up if draw.random() < down / (up + down) else -down
        for i, v, w in zip(hand, u, q):
            w = w + step * v if abs(v) > 1e-14 else w
            p[i] = 0.0 if w < EPS else 1.0 if w > 1 - EPS else w
        hand = [i for i in hand if EPS < p[i] < 1 - EPS]
        while len(hand) <= m and rest:
            hand.append(rest.pop())
    return p


def land(p: np.ndarray, start: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Round the last few fractions, then exchange single texts and pairs of texts while the token total of ``start`` comes closer."""
    goal = float((start * tokens).sum())
    out = (p >= 0.5).astype(float)
    for _ in range(12):
        off = goal - float((out * tokens).sum())
        step = np.where(out > 0.5, -tokens, tokens)
        i = int(np.argmin(np.abs(off - step)))
        change, best = [i], abs(off - step[i])
        order = np.argsort(step, kind="stable")
        ranked = step[order]
        for shift in (-1, 0):  # the two partners nearest to what a text leaves open
            k = np.clip(np.searchsorted(ranked, off - ranked) + shift, 0, len(ranked) - 1)
            gap = np.where(k == np.arange(len(ranked)), np.inf, np.abs(off - ranked - ranked[k]))
            j = int(np.argmin(gap))
            if gap[j] < best - EPS:
                change, best = [int(order[j]), int(order[k[j]])], float(gap[j])
        if best >= abs(off) - EPS:
            break
        out[change] = 1.0 - out[change]
    return out


def _fly(final: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # Long texts are settled first, so that short ones are left for the landing.
        pdf = pdf.sort_values(["tokens", "item"], ascending=[False, True], kind="stable")
        scale = max(float(pdf["tokens"].mean()), 1.0)
        x = np.column_stack([np.ones(len(pdf)), pdf["tokens"] / scale])
        p = flight(pdf["p"].to_numpy(), x, seed=len(pdf) + int(key[1]))
        pdf["p"] = land(p, pdf["p"].to_numpy(), pdf["tokens"].to_numpy(float)) if final else p
        return pdf[["source", "item", "tokens", "whole", "p"]]

    return run


def mix(docs: DataFrame, item: str, source: str, tokens: str, targets: DataFrame) -> DataFrame:
    """(source, item, tokens, uses): how often each text is used (texts of no use are left out).

    targets: source, target_share, max_repeats.  Sources that are not listed
    give nothing; texts of no tokens and null items are left out; a repeated item counts
    once per row.  A listed source without texts makes its share unreachable, so
    the total is set by the others and the reached shares show it.  An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    base = docs.filter(F.col(item).isNotNull() & F.col(source).isNotNull() & (F.col(tokens) > 0)).select(
        F.col(source).alias("source"), F.col(item).cast("long").alias("item"), F.col(tokens).cast("long").alias("tokens")
    )
    wanted = targets.filter("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(
        F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")
    )
    base = materialize(base.join(F.broadcast(wanted), "source"), "mix_items")  # targets: one row per source
    have = base.groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("n"))
    stock = have.join(wanted, "source")
    total = stock.agg(F.min(F.col("have") * F.col("cap") / F.col("share"))).first()[0]
    schema = "source string, item long, tokens long, whole int, p double"
    if total is None:
        return spark.createDataFrame([], "source string, item long, tokens long, uses int")
    rate = stock.select("source", (F.lit(float(total)) * F.col("share") / F.col("have")).alias("rate"))
    rows = base.join(F.broadcast(rate), "source").withColumn("r", F.least(F.col("rate"), F.col("cap").cast("double")))
    rows = rows.select("source", "item", "tokens", F.floor(F.col("r") + F.lit(EPS)).cast("int").alias("whole"), F.greatest(F.lit(0.0), F.col("r") - F.floor(F.col("r") + F.lit(EPS))).alias("p"))
    fixed = rows.filter(F.col("p") <= EPS)
    loose = materialize(rows.filter(F.col("p") > EPS), "mix_open")
    settled = [fixed.select("source", "item", "tokens", F.col("whole").alias("uses"))]
    n = loose.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    level = 0
    while n:
        blocks = max(1, -(-n // BLOCK))
        placed = loose.withColumn("block", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(blocks)).cast("int"))
        # A named number of tasks, or small tables would fly in one.
        placed = placed.repartition(min(tasks, 8 * blocks), "source", "block")
        flown = materialize(placed.groupBy("source", "block").applyInPandas(_fly(blocks == 1), schema), "mix_flight")
        closed = (F.col("p") <= EPS) | (F.col("p") >= 1 - EPS)
        settled.append(flown.filter(closed).select("source", "item", "tokens", (F.col("whole") + F.round("p").cast("int")).alias("uses")))
        if blocks == 1:
            break
        loose = flown.filter(~closed)
        n = loose.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        level += 1
    out = settled[0]
    for s in settled[1:]:
        out = out.union(s)
    return out.filter("uses > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, most_used, tokens, share): what was reached, one row per listed source."""
    per = mixed.groupBy("source").agg(
        F.count("*").alias("documents"), F.max("uses").alias("most_used"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens")
    )
    wanted = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    used = F.coalesce("tokens", F.lit(0))
    every = Window.partitionBy()  # one row per listed source
    return wanted.join(per, "source", "left").withColumn("total", F.sum(used).over(every)).select(
        "source", "target_share", "max_repeats",
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_used", F.lit(0)).alias("most_used"), used.alias("tokens"),
        F.round(F.try_divide(used.cast("double"), F.col("total").cast("double")), 6).alias("share"),
    )
