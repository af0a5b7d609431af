"""Sinks: JSON and CSV exports and the incremental manifest.  Every sink overwrites its own folder only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _list(c: str):
    return F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), "|")


def entity_rows(entities: DataFrame) -> DataFrame:
    return entities.select("id", "name", "normalized_name", "entity_type", _list("mentions").alias("mentions"), _list("documents").alias("documents"))


def relation_rows(relations: DataFrame, *keys: str) -> DataFrame:
    return relations.select(
        *keys,
        "subject_id", F.col("subject_text").alias("subject"), "predicate", F.col("object_text").alias("object"), "object_id", "relation_type",
        F.col("sentence").alias("evidence"), "document", F.col("page_number").alias("page"), F.col("extraction_method").alias("method"),
        F.col("review_status").alias("status"), 
        F.coalesce(F.when(F.isnan("confidence"), F.lit(None)).otherwise(F.col("confidence")), F.lit(0.5)).alias("confidence"), "event_date", "negated",
    )


def event_rows(events: DataFrame) -> DataFrame:
    who = F.array_join(F.transform("participants", lambda p: F.concat_ws(":", p["entity_id"], p["role"])), "|")
    return events.select("id", "name", "event_type", "event_date", _list("documents").alias("documents"), who.alias("participants"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; an empty table gives files without rows."""
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def export_all(entities: DataFrame, relations: DataFrame, out: str, events: DataFrame | None = None) -> list[str]:
    written = []
    for name, rows in (("entities", entity_rows(entities)), ("relationships", relation_rows(relations))):
        write_json(rows, f"{out}/{name}.json")
        write_csv(rows, f"{out}/{name}.csv")
        written += [f"{out}/{name}.json", f"{out}/{name}.csv"]
    if events is not None:
        write_json(event_rows(events), f"{out}/events.json")
        written.append(f"{out}/events.json")
    return written


def changed_files(now: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Files (path, sha1) that the manifest does not know in this content."""
    return now if force else now.join(manifest.select("path", "sha1"), ["path", "sha1"], "left_anti")
