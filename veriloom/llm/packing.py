"""Filling fixed-capacity containers by vector bin packing.

Every item has a vector of demands (tokens, one segment, loss-bearing tokens) and every
container the same vector of limits.  Containers are filled one after the other: of all
items that still fit, the one whose demand has the largest dot product with the
remaining room goes in, until none fits.  Items of equal demand are one type with
a count, so a step compares types, not items.  Blocks are packed in parallel; the badly filled
containers of all blocks are emptied and packed again together, until what is left is one block or
packing again saves next to nothing.  Every kind of container is packed again on its own account.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.session import materialize

#: Items of one block: a bound on what a task packs at once.
BLOCK = 20_000
#: Packing again goes on for a kind while a round saves this share of the containers it emptied.
GAIN = 0.01


def pack_types(demand: np.ndarray, count: np.ndarray, limit: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Fill containers with ``count[i]`` items of each distinct ``demand[i]`` (whole numbers, each within ``limit``).

    Returns lists of (container, type, how many), containers numbered from 0 in the order they were filled.
    """
    order = np.lexsort((*demand.T[1:], demand[:, 0]))
    need, left = demand[order], count[order].copy()
    share = need / limit
    # With every demand a fixed multiple of the first one the best type stays the best while it fits.
    straight = len(need) == 0 or all(len(np.unique(need[:, d] * 1.0)) == 1 or np.array_equal(need[:, d], need[:, 0]) for d in range(1, need.shape[1]))
    where: list[int] = []
    what: list[int] = []
    many: list[int] = []
    made = 0
    while len(left):
        room = limit.astype(np.int64).copy()
        while True:
            hi = int(np.searchsorted(need[:, 0], room[0], "right"))
            fits = (left[:hi] > 0) & (need[:hi, 1:] <= room[1:]).all(1)
            if not fits.any():
                break
            if straight:
                j = hi - 1 - int(np.argmax(fits[::-1]))
                n = int(min(left[j], (room // np.maximum(need[j], 1))[need[j] > 0].min()))
            else:
                score = np.where(fits, share[:hi] @ (room / limit), -1.0)
                j, n = int(np.argmax(score)), 1
            left[j] -= n
            room -= n * need[j]
            where.append(made)
            what.append(int(order[j]))
            many.append(n)
        made += 1
        dead = left == 0
        if dead.sum() * 4 >= len(left) or dead.all():
            order, need, share, left = order[~dead], need[~dead], share[~dead], left[~dead]
    return where, what, many


def pack_block(demand: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Container number of each row of ``demand`` (all rows fit an empty container); equal rows are used in the order given."""
    if not len(demand):
        return np.empty(0, np.int64)
    types, of = np.unique(demand.astype(np.int64), axis=0, return_inverse=True)
    of = of.ravel()
    count = np.bincount(of, minlength=len(types))
    where, what, many = pack_types(types, count, limit)
    # The rows of a type in order, cut by the runs in which the type was used.
    rows = np.argsort(of, kind="stable")
    run = np.argsort(np.array(what), kind="stable")
    out = np.empty(len(demand), np.int64)
    out[rows] = np.repeat(np.array(where)[run], np.array(many)[run])
    return out


def _packer(limits: dict[str, tuple[int, int, int]]):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind, block = key
        pdf = pdf.sort_values(["item", "part"], kind="stable")
        demand = np.column_stack([pdf["tokens"], np.ones(len(pdf), np.int64), pdf["loss"]])
        local = pack_block(demand, np.array(limits[kind]))
        pdf["local"] = local
        pdf["filled"] = np.bincount(local, weights=pdf["tokens"]).astype(np.int64)[local]
        return pdf[["kind", "item", "part", "tokens", "loss", "block", "local", "filled"]]

    return run


def pack(
    items: DataFrame, item: str, tokens: str, loss: Column | None, kinds: list[tuple[str, int]], tokens_per_segment: int = 16, loss_share: float = 1.0, well_filled: float = 0.97
) -> DataFrame:
    """(kind, item, part, tokens, loss, container): every item in one container of every kind.

    kinds: (name, capacity in tokens).  A container holds at most one segment per ``tokens_per_segment``
    tokens of its capacity.  ``loss``: loss-bearing tokens of an item (default: all its tokens), limited to
    ``loss_share`` of the capacity.  An item above the capacity is divided into
    full parts and a rest, no other is ever divided (an item whose loss-bearing tokens exceed their limit is
    divided for that).  Items of no tokens (null,
    empty texts) and null items are left out; repeated items are packed once per row.  An empty
    table gives an empty result.
    """
    spark = items.sparkSession
    schema = "kind string, item long, part int, tokens long, loss long, block int, local long, filled long"
    limits = {k: (c, max(1, c // tokens_per_segment), max(1, int(c * loss_share))) for k, c in kinds}
    base = items.filter(F.col(item).isNotNull() & (F.col(tokens) > 0)).select(
        F.col(item).cast("long").alias("item"), F.col(tokens).cast("long").alias("n"), (F.col(tokens) if loss is None else loss).cast("long").alias("l")
    )
    every = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(c).cast("long").alias("cap"), F.lit(limits[k][2]).cast("long").alias("lcap")) for k, c in kinds))
    cut = base.select("item", "n", F.least("l", "n").alias("l"), F.explode(every).alias("k")).select("item", "n", "l", "k.*")
    # A part may hold at most the capacity in tokens and the limit in loss-bearing ones.
    step = F.when(F.col("l") > 0, F.least(F.col("cap"), F.floor(F.col("lcap") * F.col("n") / F.col("l")))).otherwise(F.col("cap"))
    cut = cut.withColumn("step", F.greatest(F.lit(1), step).cast("long")).select("*", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / F.col("step")).cast("int"))).alias("part"))
    size = F.least(F.col("step"), F.col("n") - F.col("part") * F.col("step"))
    rows = cut.select(
        "kind", "item", "part", size.alias("tokens"), F.least(F.ceil(F.col("l") * size / F.col("n")), F.col("lcap")).cast("long").alias("loss")
    )
    left = materialize(rows, "pack_items")
    n = {r["kind"]: r["count"] for r in left.groupBy("kind").count().collect()}
    cap = F.create_map(*(x for k, c in kinds for x in (F.lit(k), F.lit(c))))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    done: list[DataFrame] = []
    emptied: dict[str, int] = {}
    level = 0
    while n:
        blocks = {k: max(1, -(-c // BLOCK)) for k, c in n.items()}
        of_kind = F.create_map(*(F.lit(x) for pair in blocks.items() for x in pair))
        placed = left.withColumn("block", F.pmod(F.xxhash64("item", "part", F.lit(level)), of_kind[F.col("kind")]).cast("int"))
        # A named number of tasks, or small tables would be packed in one.
        placed = placed.repartition(min(tasks, 2 * sum(blocks.values())), "kind", "block")
        placed = materialize(placed.groupBy("kind", "block").applyInPandas(_packer(limits), schema), "pack_level")
        bad = F.col("filled") < F.lit(well_filled) * cap[F.col("kind")]
        per = placed.groupBy("kind", "block").agg(F.count_distinct("local").alias("all"), F.count_distinct(F.when(bad, F.col("local"))).alias("bad"), F.sum(bad.cast("long")).alias("rest"))
        found = {r["kind"]: r for r in per.groupBy("kind").agg(F.sum("all").alias("all"), F.sum("bad").alias("bad"), F.sum("rest").alias("rest")).collect()}
        again = [k for k in n if blocks[k] > 1 and found[k]["bad"] > 1 and (level == 0 or found[k]["all"] <= (1 - GAIN) * emptied[k])]
        label = F.concat_ws("-", "kind", F.lit(str(level)), "block", "local")
        keep = ~(F.col("kind").isin(again) & bad)
        done.append(placed.filter(keep).select("kind", "item", "part", "tokens", "loss", label.alias("container")))
        left = placed.filter(~keep).select("kind", "item", "part", "tokens", "loss")
        n, emptied = {k: found[k]["rest"] for k in again}, {k: found[k]["bad"] for k in again}
        level += 1
    if not done:
        return spark.createDataFrame([], "kind string, item long, part int, tokens long, loss long, container string")
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out
