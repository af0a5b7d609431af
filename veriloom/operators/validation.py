"""Relation cleaning: dates, evidence filter, duplicates, contradictions, report.

Statuses that follow approval words or review tiers are workflow rules and are
not part of the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import text as X
from veriloom.session import side_by_side


def _part(a: str, b: str | None = None) -> Column:
    c = F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b), F.lit("")) if b else F.coalesce(F.col(a), F.lit(""))
    return F.lower(X.strip(c))


def keyed(relations: DataFrame) -> DataFrame:
    """Adds k_s, k_p, k_o (id when there is one, else text) and neg."""
    return relations.withColumns(
        {"k_s": _part("subject_id", "subject_text"), "k_p": _part("predicate"), "k_o": _part("object_id", "object_text"), "neg": F.coalesce("negated", F.lit(False))}
    )


def attach_dates(relations: DataFrame, dated_sentences: DataFrame | None = None) -> DataFrame:
    """event_date filled from a date mention of the same sentence (sentence, date), else from the sentence itself."""
    found = X.first_date(F.col("sentence"))
    if dated_sentences is not None:
        d = dated_sentences.groupBy("sentence").agg(F.min_by("date", "ord").alias("_date"))
        relations = relations.join(d, "sentence", "left")
        found = F.coalesce("_date", found)
    return relations.withColumn("event_date", F.coalesce(F.nullif("event_date", F.lit("")), found)).drop("_date")


def with_evidence(relations: DataFrame) -> DataFrame:
    return relations.filter(X.strip(F.coalesce("sentence", F.lit(""))) != "")


def deduplicate(relations: DataFrame) -> DataFrame:
    """One row per (subject, predicate, object, negated): the first by ``ord``, with the highest confidence of all.

    A NaN or null confidence never raises the maximum.
    """
    score = F.when(F.isnan("confidence"), F.lit(None)).otherwise(F.col("confidence"))
    k = keyed(relations)
    rest = [c for c in relations.columns if c != "confidence"]
    first = k.groupBy("k_s", "k_p", "k_o", "neg").agg(F.min_by(F.struct(*rest), "ord").alias("r"), F.max(score).alias("confidence"), F.count("*").alias("copies"))
    return first.select("k_s", "k_p", "k_o", "neg", "r.*", "confidence", "copies")


def contradictions(deduped: DataFrame) -> DataFrame:
    """Adds contradicted: the same triple is affirmed and negated."""
    both = deduped.groupBy("k_s", "k_p", "k_o").agg((F.max("neg") & ~F.min("neg")).alias("contradicted"))
    return deduped.join(both, ["k_s", "k_p", "k_o"])


def report(relations: DataFrame) -> DataFrame:
    """One row: relations, dropped_no_evidence, duplicates_merged, contradicted, kept."""
    total = relations.agg(
        F.count("*").alias("relations"),
        F.sum(F.when(X.strip(F.coalesce("sentence", F.lit(""))) == "", 1).otherwise(0)).alias("dropped_no_evidence"),
    )
    kept = contradictions(deduplicate(with_evidence(relations))).agg(
        F.count("*").alias("kept"), F.sum(F.col("copies") - 1).alias("duplicates_merged"), F.sum(F.col("contradicted").cast("long")).alias("contradicted")
    )
    return side_by_side(total, kept)
