"""Page level operators: profiles, repeated lines, recognition flags, ingest summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import text as X


def line_norm(line: Column) -> Column:
    return F.lower(X.clean_display(line))


def lines(segments: DataFrame) -> DataFrame:
    return segments.select("seg_id", "document", "page_number", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r\n|\n|\r")).alias("line_no", "line"))


def repeated_lines(segments: DataFrame, min_repeat: int = 3, min_chars: int = 20) -> DataFrame:
    """line, n: normalised lines of at least ``min_chars`` that occur ``min_repeat`` times over all pages."""
    norm = lines(segments).select(line_norm(F.col("line")).alias("line")).filter(F.length("line") >= min_chars)
    return norm.groupBy("line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_repeat)


def strip_boilerplate(segments: DataFrame, min_repeat: int = 3, min_chars: int = 20) -> DataFrame:
    """seg_id, kept, char_count, is_empty, text without the repeated lines."""
    rows = lines(segments).withColumn("norm", line_norm(F.col("line")))
    kept = rows.join(repeated_lines(segments, min_repeat, min_chars).select(F.col("line").alias("norm")), "norm", "left_anti")
    joined = kept.groupBy("seg_id").agg(F.count("*").alias("kept"), F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    out = segments.select("seg_id").join(joined, "seg_id", "left").select("seg_id", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce(text, F.lit("")).alias("text"))
    n = F.length(X.strip(F.col("text")))
    return out.withColumn("char_count", n.cast("long")).withColumn("is_empty", n == 0)


def needs_ocr(segments: DataFrame, threshold: int = 50) -> DataFrame:
    """document, pages, chars, needs_ocr: files with pages but hardly any text."""
    n = F.length(X.strip(F.coalesce("text", F.lit(""))))
    per = segments.groupBy("document").agg(F.count("*").alias("pages"), F.sum(n).alias("chars"))
    return per.withColumn("needs_ocr", (F.col("pages") > 0) & (F.col("chars") < threshold))
