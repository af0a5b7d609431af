"""Counts and rates about entities and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import vocab as V
from veriloom.functions import text as X
from veriloom.session import side_by_side


def good(c: str = "confidence") -> Column:
    """Confidence with NaN as null."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c))


def graph_stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    e = entities.agg(F.count("*").alias("num_entities"), F.round(F.avg(F.when(F.col("entity_type") == "NOUN_PHRASE", 1.0).otherwise(0.0)), 3).alias("noun_phrase_ratio"))
    linked = F.col("subject_id").isNotNull() & F.col("object_id").isNotNull()
    r = relations.agg(F.count("*").alias("num_relations"), F.sum(linked.cast("long")).alias("linked_relations"), F.sum((~linked).cast("long")).alias("unlinked_relations"))
    return side_by_side(e, r)


def type_histogram(entities: DataFrame) -> DataFrame:
    return entities.groupBy(F.coalesce("entity_type", F.lit("?")).alias("entity_type")).agg(F.count("*").alias("n"))


def eval_metrics(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """entities, relations, dup_relation_rate, provenance_coverage, avg_confidence, with_event_date."""
    e = entities.agg(F.count("*").alias("entities"))
    triple = F.concat_ws("\x01", F.coalesce("subject_id", "subject_text", F.lit("")), F.coalesce("predicate", F.lit("")), F.coalesce("object_id", "object_text", F.lit("")))
    r = relations.agg(
        F.count("*").alias("relations"),
        F.round(1 - F.count_distinct(triple) / F.greatest(F.count("*"), F.lit(1)), 4).alias("dup_relation_rate"),
        F.round(F.sum(F.when(F.coalesce("sentence", F.lit("")) != "", 1).otherwise(0)) / F.greatest(F.count("*"), F.lit(1)), 4).alias("provenance_coverage"),
        F.round(F.avg(F.coalesce(good(), F.lit(0.5)).cast("decimal(18,6)")).cast("double"), 3).alias("avg_confidence"),
        F.sum(F.when(F.coalesce("event_date", F.lit("")) != "", 1).otherwise(0)).alias("with_event_date"),
    )
    return side_by_side(e, r)


def quality_gates(entities: DataFrame, relations: DataFrame, max_noun_phrase_ratio: float = 0.85) -> DataFrame:
    """One row of gate counts and whether all pass; over-long names only warn."""
    name = X.strip(F.coalesce("name", F.lit("")))
    e = entities.agg(
        F.avg(F.when(F.col("entity_type") == "NOUN_PHRASE", 1.0).otherwise(0.0)).alias("ratio"),
        F.sum(F.when(F.regexp_replace(name, "[ ,.]", "").rlike("^[0-9]+$"), 1).otherwise(0)).alias("numeric_entities"),
        F.sum(F.when(F.length(F.coalesce("name", F.lit(""))) > 80, 1).otherwise(0)).alias("overlong_entities"),
    )
    verb = F.lower(F.coalesce("predicate", F.lit("")))
    kept = (verb == "be") & X.amount_like(F.col("object_text"))
    r = relations.agg(F.sum(F.when(verb.isin(V.DROPPED_PREDICATES) & ~kept, 1).otherwise(0)).alias("banned_predicates"))
    both = side_by_side(e, r)
    return both.select(
        F.round("ratio", 3).alias("noun_phrase_ratio"), "numeric_entities", "overlong_entities", "banned_predicates",
        ((F.col("ratio") <= max_noun_phrase_ratio) & (F.col("numeric_entities") == 0) & (F.col("banned_predicates") == 0)).alias("passed"),
    )


def service_metrics(entities: DataFrame | None, relations: DataFrame | None) -> DataFrame | None:
    """One row: entities, relations, avg_confidence (three decimals, 0 without relations); -1 where nothing was exported yet, then without an average."""
    if entities is None or relations is None:
        known = entities if entities is not None else relations
        if known is None:
            return None
        return known.agg(F.lit(-1).cast("long").alias("entities"), F.lit(-1).cast("long").alias("relations"), F.lit(None).cast("double").alias("avg_confidence"))
    e = entities.agg(F.count("*").alias("entities"))
    r = relations.agg(F.count("*").alias("relations"), F.coalesce(F.round(F.avg(F.coalesce(good(), F.lit(0.5)).cast("decimal(18,6)")).cast("double"), 3), F.lit(0.0)).alias("avg_confidence"))
    return side_by_side(e, r)


def status_counts(relations: DataFrame) -> DataFrame:
    """status, n; a missing status is '?'."""
    return relations.groupBy(F.coalesce("review_status", F.lit("?")).alias("status")).agg(F.count("*").alias("n"))


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, before, after, delta of two one-row results with the same numeric columns."""
    long = lambda df, name: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(name)) for c in df.columns))).alias("m")).select("m.*")
    both = long(before, "before").join(long(after, "after"), "metric")
    return both.withColumn("delta", F.round(F.col("after") - F.col("before"), 6))


def badge(c: Column) -> Column:
    return F.when(c < 0.6, "low").when(c < 0.8, "medium").otherwise("high")
