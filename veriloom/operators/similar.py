"""Similar names without looking at every pair in Python.

Pairs reach the similarity itself on one of two lossless ways.  Names that share
most of their words meet on their rarest words (``word_candidates``).  All
others must share most of their letters: the names of a block are compared by
their counts of letters in one matrix product, what is left by the longest
common subsequence with one bit per letter, many pairs at a time (``Tile``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions import text as X

# Names of one block that meet at a time, pairs below which plain Python is faster, pairs per round of the bit rows.
TILE, FEW, ROUND = 2048, 40, 1 << 15
# Single counts of a letter; what is above them is bounded by a product of roots.
LEVELS = 4
BITS = 64
SLACK = 1e-3


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per letter of ``a``."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """2 * longest common subsequence / total length."""
    if not a and not b:
        return 1.0
    return 2.0 * lcs(a, b) / (len(a) + len(b))


def similarity(a: str, b: str) -> float:
    """The larger of the plain ratio and the token-set ratio, 0 to 1."""
    sa, sb = set(a.split()), set(b.split())
    common, left, right = " ".join(sorted(sa & sb)), " ".join(sorted(sa - sb)), " ".join(sorted(sb - sa))
    if common and (not left or not right):
        return 1.0
    best = indel_ratio(a, b)
    one, two = (common + " " + left).strip(), (common + " " + right).strip()
    best = max(best, indel_ratio(one, two))
    if common:
        best = max(best, indel_ratio(common, one), indel_ratio(common, two))
    return best


def word_candidates(g: DataFrame, threshold: float) -> DataFrame:
    """Pairs of names that can reach the threshold by their common words alone, with the columns of ``g`` twice (``_a``, ``_b``).

    The common words then make up a share of the smaller name that its words after the rarest ones do not reach, so
    it probes with those rarest words only and a frequent word never meets itself.
    """
    t = min(threshold, 1.0)
    share = t / (2.0 - t)
    split = F.array_distinct(F.filter(F.split("normalized_name", X.WS + "+"), lambda w: w != ""))
    words = g.select(*g.columns, F.explode(split).alias("w"))
    df = words.groupBy("w").agg(F.count("*").alias("df"))
    weight = F.length("w") + 1
    name = Window.partitionBy("id", "normalized_name")
    rest = name.orderBy("df", "w").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    probe = words.join(df.filter("df > 1"), "w", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    probe = probe.withColumn("_all", F.sum(weight).over(name)).withColumn("_rest", F.sum(weight).over(rest))
    probe = probe.filter((F.col("df") > 1) & (F.col("_rest") >= share * (F.col("_all") - 1) + 1 - SLACK))
    a = probe.select("w", *(F.col(c).alias(f"{c}_a") for c in g.columns))
    b = words.select("w", *(F.col(c).alias(f"{c}_b") for c in g.columns))
    return a.join(b, "w").filter("id_a <> id_b").drop("w")


def tiles(g: DataFrame, token: str = "t") -> DataFrame:
    """Names of every block of ``token`` (an exploded column) in tiles of two parts of it: token, x, y, part and the columns of ``g``; blocks of one name are left out."""
    size = g.groupBy(token).agg(F.count("*").alias("_n")).filter("_n > 1")
    parts = F.ceil(F.col("_n") / TILE).cast("int")
    rows = g.join(size, token).withColumn("_c", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("_c")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    return rows.select(*g.columns, F.least("part", "_o").alias("x"), F.greatest("part", "_o").alias("y"), "part")


class Side:
    """The names of one side of a tile."""

    def __init__(self, ids: list[str], names: list[str], types: list[str | None], token: str, kinds: dict[str, int], wild: str):
        self.ids, self.names, self.words = ids, names, [frozenset(n.split()) for n in names]
        self.types = np.array([-1 if k is None else kinds.setdefault(k, len(kinds)) for k in types])
        self.wild = np.array([k == wild for k in types])
        self.length = np.array([len(n) for n in names])
        self.unique = [" ".join(sorted(w)) for w in self.words]
        self.odd = any(len(u) != len(n) for u, n in zip(self.unique, names))
        # A bit for each other word: names without a bit in common have no other word in common.
        self.others = np.array([sum({1 << hash(w) % BITS for w in ws if w != token}) if token in ws else 2**BITS - 1 for ws in self.words], dtype=np.uint64)
        self.rest = [" ".join(sorted(ws - {token})) for ws in self.words]
        # 1, 2: the block's word first or last and the others in order, so that ordering the words changes nothing.
        self.kind = np.array([1 if n == f"{token} {r}" else 2 if n == f"{r} {token}" else 0 for n, r in zip(names, self.rest)])


def letter_counts(texts: list[str], letters: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(texts), len(letters)), dtype=np.float32)
    for i, t in enumerate(texts):
        for ch in t:
            out[i, letters[ch]] += 1
    return out


def common_letters(one: list[str], two: list[str]) -> np.ndarray:
    """An upper bound of the number of letters each text of ``one`` has in common with each of ``two``, in any order."""
    letters = {ch: i for i, ch in enumerate(sorted(set("".join(one)) & set("".join(two))))}
    spare = {ch: len(letters) for ch in set("".join(one)) ^ set("".join(two))}
    a, b = (letter_counts(x, letters | spare | {"": len(letters)})[:, : len(letters)] for x in (one, two))
    steps = lambda c: [(c >= n).astype(np.float32) for n in range(1, LEVELS + 1)] + [np.sqrt(np.maximum(c - LEVELS, 0))]
    x, y = np.concatenate(steps(a), 1), np.concatenate(steps(b), 1)
    used = (x.any(0)) & (y.any(0))
    return x[:, used] @ y[:, used].T


class Bits:
    """Longest common subsequences of many pairs of texts of up to 64 letters."""

    def __init__(self, one: list[str], two: list[str]):
        letters = {ch: i for i, ch in enumerate(sorted(set("".join(one))))}
        self.n = len(letters) + 1  # the last one stands for no letter of ``one``
        self.masks = np.zeros((len(one), self.n), dtype=np.uint64)
        for i, t in enumerate(one):
            for k, ch in enumerate(t[:BITS]):
                self.masks[i, letters[ch]] |= np.uint64(1 << k)
        self.masks = self.masks.ravel()
        self.size = np.array([len(t) for t in two])
        self.codes = np.full((min(BITS, max(self.size, default=0)), len(two)), self.n - 1, dtype=np.int64)
        for j, t in enumerate(two):
            for k, ch in enumerate(t[:BITS]):
                self.codes[k, j] = letters.get(ch, self.n - 1)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), dtype=np.int64)
        for at in range(0, len(i), ROUND):
            ii, jj = i[at : at + ROUND] * self.n, j[at : at + ROUND]
            v = np.full(len(ii), 2**BITS - 1, dtype=np.uint64)
            for k in range(min(len(self.codes), int(self.size[jj].max(initial=0)))):
                u = v & self.masks[ii + self.codes[k][jj]]
                v = (v + u) | (v - u)
            out[at : at + ROUND] = BITS - np.bitwise_count(v).astype(np.int64)
        return out


class Tile:
    """Pairs of two parts of a block (or within one part) that may reach the threshold; pairs that reach it by common words alone need not be among them."""

    def __init__(self, one: Side, two: Side, token: str, threshold: float, within: bool):
        self.a, self.b, self.token, self.t, self.within = one, two, token, threshold, within

    def by_letters(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.a, self.b
        fit = 2 * common_letters(a.names, b.names) + SLACK >= self.t * (a.length[:, None] + b.length[None, :])
        if a.odd or b.odd:
            la, lb = (np.array([len(u) for u in s.unique]) for s in (a, b))
            fit |= 2 * common_letters(a.unique, b.unique) + SLACK >= self.t * (la[:, None] + lb[None, :])
        fit &= ((a.types[:, None] == b.types[None, :]) & (a.types >= 0)[:, None]) | a.wild[:, None] | b.wild[None, :]
        if self.within:
            fit &= np.tri(len(a.names), len(b.names), -1, dtype=bool)
        return np.nonzero(fit)

    def pairs(self) -> Iterator[tuple[int, int]]:
        a, b = self.a, self.b
        i, j = self.by_letters()
        short = (a.length[i] <= BITS) & (b.length[j] <= BITS)
        yield from zip(i[~short].tolist(), j[~short].tolist())
        i, j = i[short], j[short]
        found = 2 * Bits(a.names, b.names)(i, j) + SLACK >= self.t * (a.length[i] + b.length[j])
        yield from zip(i[found].tolist(), j[found].tolist())
        # With the words in order: common ones first, then the others of each name.
        i, j = i[~found], j[~found]
        more = (a.others[i] & b.others[j]) != 0
        same = ~more & (a.kind[i] == b.kind[j]) & (a.kind[i] > 0)
        yield from self.ordered(i[~more & ~same], j[~more & ~same], frozenset([self.token]))
        groups: dict[frozenset, list[tuple[int, int]]] = {}
        for x, y in zip(i[more].tolist(), j[more].tolist()):
            groups.setdefault(a.words[x] & b.words[y], []).append((x, y))
        for common, ps in groups.items():
            if len(ps) < FEW:
                yield from ps
            else:
                yield from self.ordered(*np.array(ps).T, common)

    def ordered(self, i: np.ndarray, j: np.ndarray, common: frozenset) -> Iterator[tuple[int, int]]:
        if not len(i):
            return
        # A common start belongs to the longest common subsequence.
        rows, i = np.unique(i, return_inverse=True)
        cols, j = np.unique(j, return_inverse=True)
        left, right = ([" ".join(sorted(s.words[k] - common)) for k in ks.tolist()] for s, ks in ((self.a, rows), (self.b, cols)))
        head = len(" ".join(common)) + bool(common)
        total = 2 * head + np.array([len(x) for x in left])[i] + np.array([len(x) for x in right])[j]
        found = 2 * (head + Bits(left, right)(i, j)) + SLACK >= self.t * total
        yield from zip(rows[i[found]].tolist(), cols[j[found]].tolist())


SCHEMA = "id_a string, id_b string, similarity double"


def batch(rows: list[tuple[str, str, float]]) -> pa.RecordBatch:
    kinds = {"id_a": pa.string(), "id_b": pa.string(), "similarity": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))


def within_tiles(threshold: float, wild: str = "NOUN_PHRASE") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows t, x, y, part, id, normalized_name, entity_type sorted by (t, x, y): the pairs of every tile at or above the threshold."""

    def tile(key: tuple, rows: list[tuple]) -> list[tuple[str, str, float]]:
        token, x, y = key
        if len(rows) * len(rows) < 2 * FEW:
            fit = lambda k, m: k == m is not None or wild in (k, m)
            near = ((p[1:3], q[1:3]) for n, p in enumerate(rows) for q in rows[:n] if (x == y or p[0] != q[0]) and fit(p[3], q[3]))
        else:
            kinds: dict[str, int] = {}
            sides = [Side(*([r[k] for r in rows if r[0] == part] for k in (1, 2, 3)), token, kinds, wild) for part in dict.fromkeys((x, y))]
            if not all(s.ids for s in sides):
                return []
            one, two = sides[0], sides[-1]
            near = (((one.ids[i], one.names[i]), (two.ids[j], two.names[j])) for i, j in Tile(one, two, token, threshold, x == y).pairs())
        out = []
        for p, q in near:
            if p[0] != q[0]:
                (i, n), (j, m) = sorted((p, q))
                if (s := similarity(n, m)) >= threshold:
                    out.append((i, j, s))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for b in batches:
            found: list[tuple[str, str, float]] = []
            for t, x, y, *row in zip(*(b.column(c).to_pylist() for c in ("t", "x", "y", "part", "id", "normalized_name", "entity_type"))):
                if (t, x, y) != key:
                    found += tile(key, rows) if key else []
                    key, rows = (t, x, y), []
                rows.append(row)
            yield batch(found)
        if key:
            yield batch(tile(key, rows))

    return run


def verified(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows id_a, normalized_name_a, id_b, normalized_name_b: those at or above the threshold, smaller id first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("id_a", "normalized_name_a", "id_b", "normalized_name_b")]
            pairs = (sorted(((r[0], r[1]), (r[2], r[3]))) for r in zip(*cols))
            yield batch([(p[0], q[0], s) for p, q in pairs if (s := similarity(p[1], q[1])) >= threshold])

    return run


def compared(g: DataFrame, threshold: float, compatible: Callable[[Column, Column], Column]) -> DataFrame:
    """id_a, id_b (smaller first), similarity of compatible names of ``g`` (id, normalized_name, entity_type, tokens) with a token in common."""
    tasks = max(4 * g.sparkSession.sparkContext.defaultParallelism, int(g.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = tiles(g.select("id", "normalized_name", "entity_type", F.explode("tokens").alias("t")))
    near = blocks.repartition(tasks, "t", "x", "y").sortWithinPartitions("t", "x", "y").mapInArrow(within_tiles(threshold), SCHEMA)
    words = word_candidates(g, threshold).filter(F.arrays_overlap("tokens_a", "tokens_b") & compatible(F.col("entity_type_a"), F.col("entity_type_b")))
    words = words.select("id_a", "normalized_name_a", "id_b", "normalized_name_b").mapInArrow(verified(threshold), SCHEMA)
    return near.union(words).distinct()
