"""Top N items within every group by statistics-guided skipping.

The rows are laid out once, clustered by group and descending score, as a
parquet table in the shared folder.  Its row-group statistics then decide what
is read: a row group that holds one group only and whose maximum lies strictly
below that group's N-th score is never opened.  A range layout on (group,
score) splits a hot group over many files, so no task ever holds one whole.

A row group of several groups holds the best row of every group but its first one, so
its maximum is never strictly below the N-th score of all groups in it: in this layout such row groups
are needed, and each group has at most two of them.  A layout is a table: it serves any N, as often as asked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.session import fresh_path, list_files, materialize

_STATS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("rg", T.IntegerType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("pure", T.BooleanType()),
        T.StructField("g_min", T.StringType()),
        T.StructField("s_min", T.DoubleType()),
        T.StructField("s_max", T.DoubleType()),
    ]
)


def readable(path: str) -> str | None:
    """The path as the parquet reader names it, or null if it has no reader for that file system."""
    from pyarrow import fs

    if path.startswith("file:"):
        return "file://" + "/" + path[5:].lstrip("/")
    scheme, sep, rest = path.partition("://")
    path = ("s3" if scheme in ("s3a", "s3n") else scheme) + sep + rest
    if path.startswith(("s3://", "hdfs://")):
        return path
    try:
        fs.FileSystem.from_uri(path)
    except Exception:  # noqa: BLE001 - any failure means it can't be read this way
        return None
    return path


def _open(path: str) -> pq.ParquetFile:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(readable(path))
    return pq.ParquetFile(system.open_input_file(inner))


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[dict] = []
        for path in batch.column("path").to_pylist():
            meta = _open(path).metadata
            index = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
            for rg in range(meta.num_row_groups):
                part = meta.row_group(rg)
                g, s = (part.column(index[c]).statistics for c in ("__g", "__d"))
                known = g is not None and g.has_min_max and s is not None and s.has_min_max
                rows.append(
                    {
                        "path": path,
                        "rg": rg,
                        "n_rows": part.num_rows,
                        "pure": bool(known and g.min == g.max),
                        "g_min": g.min if known else None,
                        "s_min": float(s.min) if known else None,
                        "s_max": float(s.max) if known else None,
                    }
                )
        cols = {f: [r[f] for r in rows] for f in _STATS.names}
        types = [pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[n], t) for n, t in zip(_STATS.names, types)], names=_STATS.names)


def _reader(n: int, ties: list[str]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, parts in zip(batch.column("path").to_pylist(), batch.column("parts").to_pylist()):
                file = _open(path)
                floor: dict[str, float] = {}
                for part in parts:  # descending maximum score
                    if part["pure"] and part["s_max"] < floor.get(part["g_min"], float("-inf")):
                        continue
                    t = file.read_row_group(part["rg"])
                    t = t.sort_by([("__g", "ascending"), ("__s", "descending"), *((c, "ascending") for c in ties)]).combine_chunks()
                    g = t.column("__g")
                    size = len(t)
                    if not size:
                        continue
                    first = pa.chunked_array([pa.array([True])]) if size == 1 else pa.chunked_array(
                        [pa.array([True]), *pc.not_equal(g.slice(1), g.slice(0, size - 1)).chunks]
                    )
                    starts = np.flatnonzero(first.to_numpy())
                    rank = np.arange(size) - np.repeat(starts, np.diff(np.append(starts, size)))
                    keep = t.filter(pa.array(rank < n))
                    nth = t.filter(pa.array(rank == n - 1))
                    for k, s in zip(nth.column("__g").to_pylist(), nth.column("__d").to_pylist()):
                        if s > floor.get(k, float("-inf")):
                            floor[k] = s
                    yield from keep.combine_chunks().to_batches()

    return read


@dataclass(frozen=True)
class Layout:
    """Rows clustered by group and descending score: a parquet table at ``path``, __g, __s, __d (the score as a double, for statistics only) and the ties beside ``carry``."""

    rows: DataFrame
    path: str
    carry: list[str]
    ties: list[str]


def layout(df: DataFrame, group: Column, score: Column, ties: list[Column], carry: list[str], row_group_bytes: int = 1 << 20) -> Layout:
    """Write the layout of ``df`` that ``top_n`` reads.  Rows whose group or score is null, or whose score is NaN, are left out."""
    spark = df.sparkSession
    tie_names = [f"__t{i}" for i in range(len(ties))]
    laid = df.select(
        *carry, group.cast("string").alias("__g"), score.alias("__s"), score.cast("double").alias("__d"), *(c.alias(t) for c, t in zip(ties, tie_names))
    ).filter(F.col("__g").isNotNull() & F.col("__d").isNotNull() & ~F.isnan("__d"))
    order = [F.col("__g"), F.col("__s").desc(), *(F.col(t) for t in tie_names)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, "topn_layout")
    (
        laid.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .write.option("parquet.block.size", str(row_group_bytes))
        .parquet(path)
    )
    return Layout(spark.read.schema(laid.schema).parquet(path), path, carry, tie_names)


def top_n(laid: Layout, n: int) -> DataFrame:
    """The ``n`` rows of highest score in every group of a layout.

    Where the file system has no reader for single row groups the layout is read whole; the result is the same.
    """
    rows, spark = laid.rows, laid.rows.sparkSession
    names = list_files(spark, laid.path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    best = rows
    if names and readable(names[0]):
        files = spark.createDataFrame([(p,) for p in names], "path string").repartition(min(len(names), parts))
        stats = materialize(files.mapInArrow(_footers, _STATS), "topn_stats")
        # A group's N-th score is at least the minimum of any row group that holds n rows of it and nothing else.
        known = stats.filter(F.col("pure") & (F.col("n_rows") >= n)).groupBy("g_min").agg(F.max("s_min").alias("floor"))
        needed = stats.join(known, "g_min", "left").filter(~(F.col("pure") & F.col("floor").isNotNull() & (F.col("s_max") < F.col("floor"))))
        plan = needed.groupBy("path").agg(
            F.sort_array(F.collect_list(F.struct("s_max", "rg", "pure", "g_min")), asc=False).alias("parts")
        )
        # As many tasks as files: AQE would judge the plan by the size of these names.
        plan = plan.repartition(min(len(names), parts), "path")
        best = plan.mapInArrow(_reader(n, laid.ties), rows.schema)
    w = Window.partitionBy("__g").orderBy(F.col("__s").desc(), *(F.col(t) for t in laid.ties))
    return best.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= n).select(*laid.carry)


def top_n_per_group(df: DataFrame, group: Column, score: Column, ties: list[Column], n: int, carry: list[str], row_group_bytes: int = 1 << 20) -> DataFrame:
    """The ``n`` rows of highest ``score`` in every ``group``; returns ``carry``.

    Order: higher score, then the ``ties`` columns ascending (nulls first).
    Rows whose group or score is null, or whose score is NaN, never count.  Repeated rows
    are separate rows (deduplicate before if they are not).  An empty table
    gives an empty result; clashing names do no harm because the operator's own
    columns are added under a private prefix and only ``carry`` comes out.
    """
    return top_n(layout(df, group, score, ties, carry, row_group_bytes), n)


def latest_delivery(df: DataFrame, key: str, time: str, then: list[str]) -> DataFrame:
    """One row per ``key``: the one with the latest ``time`` (null is oldest), ties by ``then`` descending.

    ``row_number() = 1`` lets the planner cut every key to one row before the
    shuffle, so a key delivered a million times moves as one row per task.
    """
    w = Window.partitionBy(key).orderBy(F.col(time).desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in then))
    return df.withColumn("__d", F.row_number().over(w)).filter("__d = 1").drop("__d")
