"""Readers of the project's tables and of exported files."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriloom.functions import text as X

RELATION_COLUMNS = (
    "ord subject_text predicate object_text relation_type sentence document page_number extraction_method review_status negated confidence "
    "event_date subject_id object_id"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ``ord``: its latest delivery.  ``ord`` is the input order of all order-dependent operators."""
    w = Window.partitionBy("ord").orderBy(F.col("ingested_at").desc_nulls_last(), F.col("confidence").desc_nulls_last(), F.col("document").desc_nulls_last())
    rel = table(spark, sf_dir, "relations").filter("ord is not null")
    return rel.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*RELATION_COLUMNS)


def current_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "mentions").filter("ord is not null").dropDuplicates(["ord"])


def current_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "segments").filter("seg_id is not null").dropDuplicates(["seg_id"])


def current_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entities").filter("rec_id is not null and id is not null").dropDuplicates(["rec_id"])


def list_documents_on_disk(spark: SparkSession, folder: str, pattern: str = "*.{pdf,PDF}", single: str | None = None) -> DataFrame:
    """path, length, modified of one named file (an error if it is missing), or of the files of one folder (not recursive); each once, by path, without reading contents."""
    if single is not None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(single)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            raise FileNotFoundError(single)
        files = spark.read.format("binaryFile").load(single)
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified")).dropDuplicates(["path"]).orderBy("path")


def file_fingerprints(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, sha1 of the content: what the incremental manifest remembers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.sha1("content").alias("sha1"))


def read_exported(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An exported JSON file or folder; a missing one gives an empty table of the schema."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", "true").json(path)


_ENV = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}")


def expand_env(value, env: dict[str, str] | None = None):
    """``${NAME:-default}`` in every text of a configuration tree."""
    env = dict(os.environ) if env is None else env
    if isinstance(value, dict):
        return {k: expand_env(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expand_env(v, env) for v in value]
    if isinstance(value, str):
        return _ENV.sub(lambda m: env.get(m[1], m[2] or ""), value)
    return value


def read_config(path: str, env: dict[str, str] | None = None) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return expand_env(yaml.safe_load(f) or {}, env)


def pdf_pages(spark: SparkSession, folder: str, ocr_threshold: int = 50) -> DataFrame:
    """path, document, page_number, text, error of every page; a file that cannot be read gives one row with its error.

    Needs a PDF reader on the workers; without one every file carries the error.
    """

    def read(batches):
        import io

        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                name = path.rsplit("/", 1)[-1]
                try:
                    from pypdf import PdfReader

                    for i, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
                        try:
                            rows.append((path, name, i, page.extract_text() or "", None))
                        except Exception as e:  # a damaged page stays as an empty row
                            rows.append((path, name, i, "", str(e)))
                except Exception as e:
                    rows.append((path, name, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "document", "page_number", "text", "error"]).astype({"page_number": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").load(folder).select("path", "content")
    return files.mapInPandas(read, "path string, document string, page_number int, text string, error string")


def with_page_columns(pages: DataFrame) -> DataFrame:
    """char_count and is_empty of a page text (white space of any kind does not count)."""
    n = F.length(X.strip(F.coalesce("text", F.lit(""))))
    return pages.withColumn("char_count", n.cast("int")).withColumn("is_empty", n == 0)
