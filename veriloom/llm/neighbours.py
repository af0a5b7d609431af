"""The k most similar vectors of every vector, by learned partitions.

A bounded sample is joined exactly into a neighbour graph, the graph is cut
into balanced parts, and a softmax classifier learns to tell the part from the
vector.  Where parts would still be large, every part is cut once more in the same way, from a bounded
sample of its own, so that a part stays small however large the table is and a row meets a constant number of others.
Every row is then indexed under its most probable part and searched in its
several most probable parts; candidates are reranked with exact cosines.  The
search runs in blocks of bounded size, so a part that holds a third of all
rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.session import materialize


@dataclass(frozen=True)
class Plan:
    """sample: rows the partition is learned on, and again within each part that is cut once more (a bound, whatever the
    size of the table).  part_rows: rows a part should hold.  sample_per_part: rows of the sample per part, so one cut makes
    at most sample / sample_per_part parts and both at most the square of that (160,000, whose classifiers take 62 MB).
    probes: parts searched per row.  block, queries: rows of one task on the side that is found and on the one that searches."""

    sample: int = 16_000
    part_rows: int = 1500
    sample_per_part: int = 40
    probes: int = 5
    graph_k: int = 10
    block: int = 4096
    queries: int = 16_384
    epochs: int = 30
    seed: int = 7


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest rows of each row (cosine), block by block."""
    n = len(x)
    k = min(k, n - 1)
    out = np.empty((n, k), np.int32)
    for a in range(0, n, 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        out[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int, slack: float = 1.1, passes: int = 8) -> np.ndarray:
    """Part of each row: grown from spread seeds, then moved along graph edges while no part exceeds its capacity."""
    rng = np.random.default_rng(seed)
    n, cap = len(x), int(np.ceil(slack * len(x) / parts))
    centre = x[rng.choice(n, parts, replace=False)].copy()
    part = np.zeros(n, np.int64)
    for _ in range(6):
        part = np.argmax(x @ centre.T, axis=1)
        for p in range(parts):
            mine = x[part == p]
            centre[p] = mine.sum(0) if len(mine) else x[rng.integers(n)]
        centre = _unit(centre)
    # Capacity: rows ask for parts in the order of their preference, the most decided rows first.
    sim = x @ centre.T
    choice = np.argsort(-sim, axis=1)[:, : min(parts, 32)]
    lead = np.take_along_axis(sim, choice, 1)
    gap = lead[:, 0] - lead[:, 1] if parts > 1 else lead[:, 0]
    size = np.zeros(parts, np.int64)
    for i in np.argsort(-gap):
        free = next((p for p in choice[i] if size[p] < cap), None)
        part[i] = int(np.argmin(size)) if free is None else free
        size[part[i]] += 1
    # Edges run both ways.
    src = np.repeat(np.arange(n), graph.shape[1])
    dst = graph.ravel().astype(np.int64)
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    order = np.argsort(a, kind="stable")
    b, start = b[order], np.searchsorted(a[order], np.arange(n + 1))
    for _ in range(passes):
        moved = 0
        for i in rng.permutation(n):
            near = part[b[start[i] : start[i + 1]]]
            if not len(near):
                continue
            count = np.bincount(near, minlength=parts)
            best = int(np.argmax(count * (size < cap)))
            if best != part[i] and count[best] > count[part[i]] and size[best] < cap:
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if moved < n // 200:
            break
    return part


def train_router(x: np.ndarray, part: np.ndarray, parts: int, epochs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression from the vector to its part (Adam, mini batches)."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    w, bias = np.zeros((d, parts), np.float32), np.zeros(parts, np.float32)
    if parts == 1:
        return w, bias
    for p in range(parts):
        mine = x[part == p]
        if len(mine):
            w[:, p] = 10 * mine.mean(0)
    m, v = np.zeros_like(w), np.zeros_like(w)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, 512):
            step += 1
            i = order[a : a + 512]
            z = x[i] @ w + bias
            z -= z.max(1, keepdims=True)
            e = np.exp(z)
            e /= e.sum(1, keepdims=True)
            e[np.arange(len(i)), part[i]] -= 1
            g = x[i].T @ e / len(i) + 1e-4 * w
            m = 0.9 * m + 0.1 * g
            v = 0.99 * v + 0.01 * g * g
            w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            bias -= 0.05 * e.mean(0)
    return w, bias


def learn(sample: np.ndarray, rows: int, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    x = _unit(sample.astype(np.float32))
    parts = int(max(1, min(round(rows / plan.part_rows), len(x) // plan.sample_per_part)))
    if parts == 1:
        return np.zeros((x.shape[1], 1), np.float32), np.zeros(1, np.float32)
    graph = neighbour_graph(x, plan.graph_k)
    part = balanced_parts(x, graph, parts, plan.seed)
    return train_router(x, part, parts, plan.epochs, plan.seed)


@dataclass(frozen=True)
class Router:
    """A first classifier and, per part of it, a second one (w, b) or nothing; parts are numbered through."""

    w: np.ndarray
    b: np.ndarray
    fine: dict[int, tuple[np.ndarray, np.ndarray]]

    def first(self) -> np.ndarray:
        """Number of the first part under each part of the first classifier."""
        sizes = [self.fine[p][0].shape[1] if p in self.fine else 1 for p in range(self.w.shape[1])]
        return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def most_probable(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The most probable parts of unit vectors, best first; rows with fewer parts repeat their last one."""
        coarse = _log_softmax(x @ self.w + self.b)
        m = min(probes, coarse.shape[1])
        top = np.argpartition(-coarse, m - 1, axis=1)[:, :m]
        start = self.first()
        if not self.fine:
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(coarse, top, 1), axis=1, kind="stable"), 1)
            return start[top]
        # Joint probabilities of the parts under the likeliest parts of the first classifier.
        score = np.full((len(x), m * probes), -np.inf)
        part = np.zeros((len(x), m * probes), np.int64)
        for p in np.unique(top):
            rows, slot = np.nonzero(top == p)
            base = coarse[rows, p][:, None]
            if p in self.fine:
                w, b = self.fine[p]
                z = _log_softmax(x[rows] @ w + b)
                k = min(probes, z.shape[1])
                best = np.argpartition(-z, k - 1, axis=1)[:, :k]
                z = np.take_along_axis(z, best, 1) + base
            else:
                k, best, z = 1, np.zeros((len(rows), 1), np.int64), base
            at = slot[:, None] * probes + np.arange(k)
            score[rows[:, None], at] = z
            part[rows[:, None], at] = start[p] + best
        order = np.argsort(-score, axis=1, kind="stable")[:, :probes]
        found = np.take_along_axis(part, order, 1)
        known = np.isfinite(np.take_along_axis(score, order, 1))
        return np.where(known, found, found[:, :1])


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def _matrix(v: pa.Array, rows: int) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(rows, -1)


def _route(shared, probes: int):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("v"), b.num_rows)
            parts = [list(dict.fromkeys(row)) for row in router.most_probable(_unit(x), probes).tolist()]
            raw, width = x.tobytes(), 4 * x.shape[1]
            vecs = [raw[i : i + width] for i in range(0, len(raw), width)]
            yield pa.RecordBatch.from_arrays(
                [b.column("rep"), pa.array(vecs, pa.binary()), pa.array(parts, pa.list_(pa.int32()))], names=["rep", "vec", "parts"]
            )

    return route


def _cut_again(plan: Plan):
    """Learn the cut of one part from its sample: part, and w and b as bytes."""

    def run(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float32).reshape(table.num_rows, -1)
        w, b = learn(x, int(table.column("rows")[0].as_py()), plan)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "w": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "b": pa.array([b.astype(np.float32).tobytes()], pa.binary())})

    return run


def _train(reps: DataFrame, n: int, plan: Plan) -> Router:
    """reps: same, v of every vector; n: how many different ones."""
    drawn = reps.select("same", "v").orderBy(F.xxhash64("same"), "same").limit(plan.sample).toPandas().drop_duplicates("same")["v"]
    w, b = learn(np.stack([np.asarray(v, np.float32) for v in drawn]), n, plan)
    if n <= 2 * plan.part_rows * w.shape[1] or w.shape[1] == 1:
        return Router(w, b, {})
    shared = reps.sparkSession.sparkContext.broadcast(Router(w, b, {}))
    home = reps.select(F.col("same").alias("rep"), "v").mapInArrow(_route(shared, 1), "rep string, vec binary, parts array<int>")
    home = materialize(home.select("rep", "vec", F.col("parts")[0].alias("part")), "knn_home")
    rows = home.groupBy("part").agg(F.count("*").alias("rows")).filter(F.col("rows") > 2 * plan.part_rows)
    # One row per part of the first cut: bounded by the sample.
    large = home.join(F.broadcast(rows), "part").filter(F.pmod(F.xxhash64("rep", F.lit(5)), F.col("rows")) < plan.sample)
    learned = large.groupBy("part").applyInArrow(_cut_again(plan), "part int, w binary, b binary").collect()
    d = w.shape[0]
    fine = {r.part: (np.frombuffer(r.w, np.float32).reshape(d, -1), np.frombuffer(r.b, np.float32)) for r in learned}
    return Router(w, b, {p: m for p, m in fine.items() if m[0].shape[1] > 1})


def _search(k: int, min_cos: float):
    def best(row: np.ndarray, other: np.ndarray, cos: np.ndarray, rank: np.ndarray) -> np.ndarray:
        order = np.lexsort((rank[other], -cos, row))
        r = row[order]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.empty(0, np.int64)
        pos = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
        return order[pos < k]

    def run(table: pa.Table) -> pa.Table:
        """role: 0 is found, 1 searches, 2 does both."""
        ids = np.array(table.column("rep").to_pylist(), dtype=object)
        raw = table.column("vec").to_pylist()
        x = _unit(np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1).astype(np.float64)) if raw else np.empty((0, 1))
        role = table.column("role").to_numpy()
        every, i = np.flatnonzero(role != 0), np.flatnonzero(role != 1)
        rank = np.empty(len(ids), np.int64)
        rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        lefts, rights, scores = [], [], []
        for at in range(0, len(every), 2048):
            q = every[at : at + 2048]
            cos = np.round(x[q] @ x[i].T, 9)
            bar = min_cos
            if cos.shape[1] > k + 1 and min_cos <= -1:  # without a threshold only the best of each row go on
                bar = np.partition(cos, cos.shape[1] - k - 1, axis=1)[:, [cos.shape[1] - k - 1]]
            a, b = np.nonzero(cos >= bar)
            c = cos[a, b]
            a, b = q[a], i[b]
            keep = a != b
            lefts.append(a[keep]), rights.append(b[keep]), scores.append(c[keep])
        if not lefts:
            return pa.table({"rep": pa.array([], pa.string()), "cand": pa.array([], pa.string()), "cos": pa.array([], pa.float64())})
        a, b, c = np.concatenate(lefts), np.concatenate(rights), np.concatenate(scores)
        one, two = best(a, b, c, rank), best(b, a, c, rank)
        left, right, score = np.r_[a[one], b[two]], np.r_[b[one], a[two]], np.r_[c[one], c[two]]
        return pa.table({"rep": pa.array(ids[left], pa.string()), "cand": pa.array(ids[right], pa.string()), "cos": pa.array(score, pa.float64())})

    return run


def usable(vector: str, dims: int):
    """Vectors of the right length without null, NaN or infinite numbers that are not all zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) == dims) & ~bad & F.exists(v, lambda x: x != 0)


def similar_vectors(
    df: DataFrame, key: str, vector: str, dims: int, k: int = 5, min_cos: float = -1.0, plan: Plan = Plan()
) -> DataFrame:
    """(id, other, cos): for every row its ``k`` most similar other rows with cosine of at least ``min_cos``.

    Cosines are rounded to nine decimals, equal ones ranked by the smaller id.
    Rows without a usable vector or with a null id neither search nor are found; a repeated id counts once
    (its largest vector).  Equal vectors are searched once and answered for every member, so a vector stored
    a million times costs one search.  An empty table gives an empty result.
    """
    spark = df.sparkSession
    raw = df.filter(F.col(key).isNotNull() & usable(vector, dims)).select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    raw = raw.withColumn("same", F.concat_ws(":", F.hex(F.xxhash64("v")), F.hex(F.hash("v"))))
    # Only ids and digests are shuffled to settle repeated ids; vectors are compared where one id has several.
    once = raw.groupBy("id").agg(F.min("same").alias("lo"), F.max("same").alias("same"))
    several = once.filter("lo <> same").select("id")
    rows = once.filter("lo = same").select("id", "same").union(raw.join(several, "id").groupBy("id").agg(F.max_by("same", "v").alias("same")))
    rows = materialize(rows, "knn_rows")
    reps = materialize(rows.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "knn_reps")
    n = reps.count()
    out = "id string, other string, cos double"
    if n == 0:
        return spark.createDataFrame([], out)
    vectors = raw.groupBy("same").agg(F.max("v").alias("v")).join(reps.select("same", "rep"), "same")
    shared = spark.sparkContext.broadcast(_train(raw, n, plan))
    routed = materialize(vectors.select("rep", "v").mapInArrow(_route(shared, plan.probes), "rep string, vec binary, parts array<int>"), "knn_routed")
    # Blocks: both sides of a part are cut by a hash so that no task exceeds the block sizes.
    load = (
        routed.select(F.posexplode("parts").alias("pos", "part"))
        .groupBy("part")
        .agg(
            F.greatest(F.lit(1), F.ceil(F.count(F.when(F.col("pos") == 0, 1)) / plan.block)).cast("int").alias("ni"),
            F.greatest(F.lit(1), F.ceil(F.count("*") / plan.queries)).cast("int").alias("nq"),
        )
    )  # one row per part: bounded by the square of the parts of one sample, hence broadcast
    spread = lambda m, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    placed = routed.select("rep", "vec", F.posexplode("parts").alias("pos", "part")).join(F.broadcast(load), "part")
    placed = placed.withColumn("ib0", spread("ni", 1)).withColumn("qb0", spread("nq", 2))
    # A row meets itself in its own block, so there it is sent once for both purposes.
    index = placed.filter("pos = 0").select("part", F.col("ib0").alias("ib"), every("nq").alias("qb"), "qb0", "rep", "vec")
    index = index.select("part", "ib", "qb", F.when(F.col("qb") == F.col("qb0"), 2).otherwise(0).cast("tinyint").alias("role"), "rep", "vec")
    query = placed.select("pos", "part", every("ni").alias("ib"), F.col("qb0").alias("qb"), "ib0", "rep", "vec").filter("pos > 0 or ib <> ib0")
    query = query.select("part", "ib", "qb", F.lit(1).cast("tinyint").alias("role"), "rep", "vec")
    found = index.union(query).groupBy("part", "ib", "qb").applyInArrow(_search(k, min_cos), "rep string, cand string, cos double")
    # A class of equal vectors offers its k + 1 smallest ids; more can never be among anybody's k best.
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("same").orderBy("id"))).filter(F.col("n") <= k + 1)
    first = first.groupBy("same").agg(F.collect_list("id").alias("ids"))
    offer = reps.join(first, "same").select(F.col("rep").alias("cand"), "ids")
    own = reps.filter("copies > 1").select("rep", F.col("rep").alias("cand"), F.lit(1.0).alias("cos"))
    w_rep = Window.partitionBy("rep").orderBy(F.col("cos").desc(), "cand")
    top = found.dropDuplicates(["rep", "cand"]).withColumn("n", F.row_number().over(w_rep)).filter(F.col("n") <= k).select("rep", "cand", "cos")
    ids = top.union(own).join(offer, "cand").select("rep", "cos", F.explode("ids").alias("other"))
    w_id = Window.partitionBy("rep").orderBy(F.col("cos").desc(), "other")
    ids = ids.withColumn("n", F.row_number().over(w_id)).filter(F.col("n") <= k + 1)
    lists = ids.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "other", "cos"))).alias("best"))
    members = rows.select("id", "same").join(reps.select("same", "rep"), "same").select("id", "rep")
    answered = members.join(lists, "rep").select("id", F.explode(F.slice(F.filter("best", lambda b: b["other"] != F.col("id")), 1, k)).alias("b"))
    return answered.select("id", F.col("b.other").alias("other"), F.col("b.cos").alias("cos")).filter(F.col("cos") >= min_cos)
