"""Dated n-ary events from linked relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.functions import text as X


def confidence_or_half(c: str = "confidence"):
    """Null, NaN and zero count as 0.5."""
    v = F.when(F.isnan(c) | (F.col(c) == 0), F.lit(None)).otherwise(F.col(c))
    return F.coalesce(v, F.lit(0.5))


def build_events(relations: DataFrame, min_confidence: float = 0.6, max_events: int | None = None) -> DataFrame:
    """id, name, event_type, event_date, documents, sentences, participants, source_relation, ord of every dated, linked relation.

    The same event told by several relations gives several rows, as the sink merges them by id.
    """
    rows = relations.filter(
        (F.coalesce("event_date", F.lit("")) != "") & F.col("subject_id").isNotNull() & F.col("object_id").isNotNull() & (confidence_or_half() >= min_confidence)
    )
    kind = F.coalesce(F.nullif(F.lower(F.regexp_extract(X.strip(F.coalesce("predicate", F.lit(""))), "^[^ ]+", 0)), F.lit("")), F.lit("event"))
    rows = rows.withColumn("event_type", kind)
    out = rows.select(
        X.event_id(F.col("event_type"), F.col("event_date"), F.coalesce("subject_text", F.lit("")), F.coalesce("object_text", F.lit(""))).alias("id"),
        F.concat("event_type", F.lit(" on "), "event_date").alias("name"), "event_type", "event_date",
        F.array("document").alias("documents"), F.array("sentence").alias("sentences"),
        F.array(
            F.struct(F.col("subject_id").alias("entity_id"), F.lit("subject").alias("role")), F.struct(F.col("object_id").alias("entity_id"), F.lit("object").alias("role"))
        ).alias("participants"),
        F.col("relation_type").alias("source_relation"), "ord",
    )
    return out if max_events is None else out.orderBy("ord").limit(max_events)


def merge_events(events: DataFrame) -> DataFrame:
    """One row per event id: the first by ``ord`` creates it, documents and sentences are appended if absent."""
    first = events.groupBy("id").agg(F.min_by(F.struct("name", "event_type", "event_date"), "ord").alias("f"), F.count("*").alias("told"))
    out = first.select("id", "f.*", "told")
    for col, name in (("documents", "documents"), ("sentences", "evidence")):
        one = events.select("id", "ord", F.explode(col).alias("v")).filter("v is not null").groupBy("id", "v").agg(F.min("ord").alias("o"))
        out = out.join(one.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]).alias(name)), "id", "left")
    return out


def participants(events: DataFrame) -> DataFrame:
    """entity_id, event_id, role: each link once."""
    return events.select(F.col("id").alias("event_id"), F.explode("participants").alias("p")).select("p.entity_id", "event_id", "p.role").distinct()
