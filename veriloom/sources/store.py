"""Stored state: versions of the graph, the manifest of seen files, the vector table, and evaluation results.

A version is a folder of its own that is never changed once written; what is current is the highest complete one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions import text as X
from veriloom.operators import graph as G
from veriloom.operators import retrieval as T

TABLES = ("entities", "edges", "events", "participates", "contains", "documents")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


# ---- graph -------------------------------------------------------------------------------------------------------------

def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions, oldest first."""
    if not exists(spark, root):
        return []
    fs, p = _fs(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and exists(spark, f"{root}/{n}/{TABLES[-1]}/_SUCCESS"))


def write_graph(g: G.Graph, root: str) -> dict[str, int]:
    """The next version; returns the rows of every table.  The documents are written last and complete the version."""
    spark = g.entities.sparkSession
    at = f"{root}/v{max(versions(spark, root), default=-1) + 1}"
    for name in TABLES:
        getattr(g, name).write.mode("overwrite").parquet(f"{at}/{name}")
    return {name: spark.read.parquet(f"{at}/{name}").count() for name in TABLES}


def read_graph(spark: SparkSession, root: str) -> G.Graph | None:
    """The newest complete version, or nothing."""
    known = versions(spark, root)
    return G.Graph(*(spark.read.parquet(f"{root}/v{known[-1]}/{name}") for name in TABLES)) if known else None


def store_graph(new: G.Graph, root: str) -> dict[str, int]:
    """Upsert a graph onto the stored one, or store it as the first."""
    old = read_graph(new.entities.sparkSession, root)
    return write_graph(new if old is None else G.upsert_graph(old, new), root)


def clear_graph(spark: SparkSession, root: str) -> None:
    """A new version without rows."""
    old = read_graph(spark, root)
    if old is not None:
        write_graph(G.clear(old), root)


# ---- manifest ----------------------------------------------------------------------------------------------------------

MANIFEST = "path string, sha1 string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, sha1 of the files ingested so far; a missing or damaged manifest is an empty one."""
    if not exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("mode", "DROPMALFORMED").json(path).filter("path is not null and sha1 is not null")


def write_manifest(files: DataFrame, path: str) -> None:
    """Replace the manifest.  The rows may come from the old one, so they are written beside it first."""
    from veriloom.session import materialize

    materialize(files.select("path", "sha1").distinct(), "manifest").write.mode("overwrite").json(path)


def fingerprint(content: Column, settings: str) -> Column:
    """sha1 of a file's content together with the settings it is read under: other settings make every file new."""
    return F.sha1(F.concat(content, F.encode(F.lit(settings), "UTF-8")))


def fresh_files(now: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Files whose content the manifest does not know; one whose fingerprint could not be taken (null) is fresh."""
    return now if force else now.join(manifest.select("path", "sha1").distinct(), ["path", "sha1"], "left_anti")


# ---- vectors -----------------------------------------------------------------------------------------------------------

def hashed_vector(text: Column, dims: int = 256) -> Column:
    """A vector of unit length that counts the words of a text by their hash: the embedding that needs no model."""
    words = X.words(text)
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(counts, lambda x: (x / norm).cast("float")))


def embed(texts: DataFrame, text: str, make_embedder: Callable[[], Callable[[list[str]], list[list[float] | None]]] | None = None, dims: int = 256, batch: int = 32) -> DataFrame:
    """``texts`` with vector: of the given embedder, called with lists of at most ``batch`` texts, else ``hashed_vector``.

    An embedder that fails on a text gives null; such texts stay without a point.
    """
    if make_embedder is None:
        return texts.withColumn("vector", hashed_vector(F.col(text), dims))
    from pyspark.sql import types as ST

    schema = ST.StructType([*texts.schema.fields, ST.StructField("vector", ST.ArrayType(ST.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_embedder()
        for b in batches:
            t = [x or "" for x in b.column(text).to_pylist()]
            made = [v for a in range(0, len(t), batch) for v in model(t[a : a + batch])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.float32()))], names=[*b.schema.names, "vector"])

    return texts.mapInArrow(run, schema)


def points(relations: DataFrame, make_embedder=None, dims: int = 256) -> DataFrame:
    """id, vector, payload of relations with evidence; of several with one id the last one (by ord) stays."""
    r = relations.filter((X.strip(F.coalesce("sentence", F.lit(""))) != "") & F.col("document").isNotNull() & F.col("predicate").isNotNull())
    blank = lambda c: F.coalesce(c, F.lit(""))
    text = F.substring(F.concat(blank("subject_text"), F.lit(" "), blank("predicate"), F.lit(" "), blank("object_text"), F.lit(". "), "sentence"), 1, 2000)
    payload = F.struct(
        F.col("subject_text").alias("subject"), "predicate", F.col("object_text").alias("object"), F.col("sentence").alias("evidence"), "document",
        F.col("page_number").alias("page"), "confidence", "subject_id", "object_id",
    )
    rows = r.select(X.point_id(F.col("document"), F.col("sentence"), F.col("predicate")).alias("id"), "ord", text.alias("text"), payload.alias("payload"))
    last = rows.groupBy("id").agg(F.max_by(F.struct("text", "payload"), "ord").alias("r")).select("id", "r.*")
    return embed(last, "text", make_embedder, dims).filter("vector is not null").select("id", "vector", "payload")


def dims_of(stored: DataFrame) -> int | None:
    row = stored.select(F.size("vector").alias("n")).filter("n > 0").first()
    return row.n if row else None


def store_points(new: DataFrame, root: str, dims: int) -> int:
    """Upsert points onto the stored ones and return how many there are.  Stored points of another length are given up: they can't be compared."""
    spark = new.sparkSession
    fit = new.filter(F.size("vector") == dims)
    known = [int(n) for n in _numbers(spark, root)]
    if known:
        old = spark.read.parquet(f"{root}/v{known[-1]}")
        if dims_of(old) == dims:
            fit = fit.unionByName(old.join(fit.select("id"), "id", "left_anti"))
    target = f"{root}/v{(known[-1] + 1) if known else 0}"
    fit.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target).count()


def _numbers(spark: SparkSession, root: str) -> list[int]:
    if not exists(spark, root):
        return []
    fs, p = _fs(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and exists(spark, f"{root}/{n}/_SUCCESS"))


def read_points(spark: SparkSession, root: str) -> DataFrame | None:
    known = _numbers(spark, root)
    return spark.read.parquet(f"{root}/v{known[-1]}") if known else None


def without_document(stored: DataFrame, document: str) -> DataFrame:
    """Points that do not come from a document (points of no document stay)."""
    return stored.filter(~F.col("payload.document").eqNullSafe(F.lit(document)))


def delete_everywhere(spark: SparkSession, document: str, graph_root: str, vector_root: str | None = None, file: str | None = None) -> dict[str, int]:
    """Take a document out of the stored graph, the stored vectors and, where a file is named, the disk; returns the counts."""
    counts: dict[str, int] = {}
    g = read_graph(spark, graph_root)
    if g is not None:
        left, report = G.delete_document(g, document)
        counts = {r.what: r.n for r in report.collect()}
        write_graph(left, graph_root)
    stored = read_points(spark, vector_root) if vector_root else None
    if stored is not None:
        left = without_document(stored, document)
        counts["points_deleted"] = stored.count() - left.count()
        known = _numbers(spark, vector_root)
        left.write.mode("overwrite").parquet(f"{vector_root}/v{known[-1] + 1}")
    if file is not None:
        fs, p = _fs(spark, file)
        counts["files_deleted"] = int(fs.exists(p) and fs.delete(p, False))
    return counts


# ---- evaluation --------------------------------------------------------------------------------------------------------

def write_results(rows: DataFrame, path: str) -> None:
    """One row of results as a JSON folder."""
    rows.write.mode("overwrite").json(path)


def question_battery(relations: DataFrame, questions: list[tuple[int, str, str]], generate: Callable[[str, str], str] | None = None, k: int = 8) -> list[dict]:
    """Per question (id, question, expected): the answer, whether it holds the expected text, and how many facts it stands on.  A fixed, short list of questions."""
    facts = T.facts(relations)
    out = []
    for number, question, expected in questions:
        top = T.ranked(T.keyword_topk(facts, question, k), F.col("score").desc(), F.col("confidence").desc(), "ord").withColumn("place", F.col("rank"))
        row = top.agg(F.count("*").alias("n")).first()
        context = T.context_lines(top).first().context
        said = T.answer(question, context, generate)
        out.append({"id": number, "question": question, "expected": expected, "answer": said, "hit": expected.lower() in said.lower(), "facts": row.n})
    return out


def write_battery(rows: list[dict], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, indent=2, ensure_ascii=False)
