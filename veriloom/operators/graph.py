"""The property graph as tables, its merges and deletes, and the read queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import text as X
from veriloom.operators.events import build_events, merge_events, participants


def _appended(rows: DataFrame, key: list[str], value: str, order: str, name: str) -> DataFrame:
    """Append-if-absent: distinct values in order of first arrival."""
    one = rows.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.min(order).alias("o"))
    return one.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias(name))


def _moved_to_end(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(old minus new) ++ new, over arrivals in ``order``: every value stands where its last arrival put it."""
    one = rows.select(key, order, F.posexplode(F.array_distinct(F.coalesce(value, F.array().cast(rows.schema[value].dataType)))).alias("p", "v")).filter("v is not null")
    last = one.groupBy(key, "v").agg(F.max(F.struct(order, "p")).alias("o"))
    return last.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]).alias(value))


def merge_entities(records: DataFrame) -> DataFrame:
    """Entity nodes by ``id``: the first record (smallest rec_id) creates name, type and pages; later ones move their list values to the end."""
    out = records.groupBy("id").agg(F.min_by(F.struct("name", "normalized_name", "entity_type", "pages"), "rec_id").alias("f"), F.count("*").alias("records"))
    out = out.select("id", "f.*", "records")
    for c in ("mentions", "alternative_names", "documents"):
        out = out.join(_moved_to_end(records, "id", c, "rec_id"), "id", "left")
    return out


def merge_relations(relations: DataFrame) -> DataFrame:
    """Edges by (subject_id, type, object_id, predicate, negated): the first relation (by ``ord``) creates the scalars,
    evidence, documents and pages are appended if absent, confidence is the maximum.  Relations with an unlinked end make no edge."""
    rel = relations.filter("subject_id is not null and object_id is not null").select(
        F.col("subject_id").alias("sid"), X.sanitize_rel_type(F.col("relation_type")).alias("type"), F.col("object_id").alias("oid"),
        F.coalesce("predicate", F.lit("")).alias("predicate"), F.coalesce("negated", F.lit(False)).alias("negated"),
        "sentence", "document", "page_number", "extraction_method", "event_date", "ord", F.when(F.isnan("confidence"), F.lit(None)).otherwise(F.col("confidence")).alias("confidence"),
    )
    key = ["sid", "type", "oid", "predicate", "negated"]
    out = rel.groupBy(*key).agg(
        F.min_by(F.struct(F.col("document").alias("source_document"), "page_number", "extraction_method", "event_date"), "ord").alias("f"),
        F.max("confidence").alias("confidence"), F.min("ord").alias("edge_id"), F.count("*").alias("told"),
    ).select(*key, "f.*", "confidence", "edge_id", "told")
    for value, name in (("sentence", "evidence"), ("document", "source_documents"), ("page_number", "pages")):
        out = out.join(_appended(rel, key, value, "ord", name), key, "left")
    return out


@dataclass
class Graph:
    """entities, edges, events, participates (entity_id, event_id, role), contains (document, entity_id), documents (name, pages)."""

    entities: DataFrame
    edges: DataFrame
    events: DataFrame
    participates: DataFrame
    contains: DataFrame
    documents: DataFrame


def build_graph(records: DataFrame, relations: DataFrame) -> Graph:
    entities = merge_entities(records)
    edges = merge_relations(relations)
    told = build_events(relations)
    contains = records.select(F.explode("documents").alias("document"), F.col("id").alias("entity_id")).filter("document is not null").distinct()
    pages = records.select(F.explode("documents").alias("name"), "pages")
    pages = pages.filter("name is not null").select("name", F.explode_outer("pages").alias("page")).groupBy("name").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    return Graph(entities, edges, merge_events(told), participants(told), contains, pages)


# ---- upserts onto a stored graph ---------------------------------------------------------------------------------------

def _both(old: DataFrame, new: DataFrame, key: list[str], how: dict[str, object]) -> DataFrame:
    """Full outer merge by ``key``: a column without a rule stays as the older row has it."""
    o, n = old.alias("o"), new.alias("n")
    known = F.col(f"o.{key[0]}").isNotNull()
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full_outer")
    return joined.select(*(
        how[c](F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) if c in how else F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in old.columns
    ))


def _moved(o: Column, n: Column) -> Column:
    """(old minus new) ++ new; one side alone stays as it is."""
    return F.when(o.isNull(), n).when(n.isNull(), o).otherwise(F.concat(F.array_except(o, n), n))


def _absent(o: Column, n: Column) -> Column:
    """old ++ what is absent from it."""
    return F.when(o.isNull(), n).when(n.isNull(), o).otherwise(F.concat(o, F.array_except(n, o)))


def _added(o: Column, n: Column) -> Column:
    return F.coalesce(o, F.lit(0)) + F.coalesce(n, F.lit(0))


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """On a known id name, type and pages stay, list values move to the end."""
    return _both(old, new, ["id"], {"mentions": _moved, "alternative_names": _moved, "documents": _moved, "records": _added})


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    return _both(old, new, ["name"], {"pages": _moved})


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Lists append what is absent, confidence takes the maximum, other scalars stay with the older edge."""
    most = lambda o, n: F.greatest(o, n)
    return _both(old, new, ["sid", "type", "oid", "predicate", "negated"], {"evidence": _absent, "source_documents": _absent, "pages": _absent, "confidence": most, "told": _added})


def upsert_events(old: DataFrame, new: DataFrame) -> DataFrame:
    return _both(old, new, ["id"], {"documents": _absent, "evidence": _absent, "told": _added})


def upsert_graph(old: Graph, new: Graph) -> Graph:
    """All six tables; links are added if absent."""
    return Graph(
        upsert_entities(old.entities, new.entities), merge_edges(old.edges, new.edges), upsert_events(old.events, new.events),
        old.participates.unionByName(new.participates).distinct(), old.contains.unionByName(new.contains).distinct(), upsert_documents(old.documents, new.documents),
    )


def clear(g: Graph) -> Graph:
    """The same tables without rows."""
    return Graph(*(df.limit(0) for df in (g.entities, g.edges, g.events, g.participates, g.contains, g.documents)))


def document_exists(g: Graph, name: str) -> DataFrame:
    """n: 1 if the graph holds a document of this name, else 0."""
    return g.documents.filter(F.col("name") == name).agg(F.count("*").alias("n"))


# ---- reads -------------------------------------------------------------------------------------------------------------

def named_edges(g: Graph) -> DataFrame:
    """Edges with the names of both ends; an edge whose end is no entity is not shown."""
    a = g.entities.select(F.col("id").alias("sid"), F.col("name").alias("subject"))
    b = g.entities.select(F.col("id").alias("oid"), F.col("name").alias("object"))
    return g.edges.join(a, "sid").join(b, "oid").withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))


def all_entities(g: Graph, limit: int = 1000) -> DataFrame:
    return g.entities.orderBy("id").limit(limit).select("id", "name", "entity_type")


def all_relationships(g: Graph, limit: int = 1000) -> DataFrame:
    return named_edges(g).orderBy("edge_id").limit(limit)


def weakest_relationships(g: Graph, limit: int = 50) -> DataFrame:
    return named_edges(g).orderBy("confidence", "edge_id").limit(limit)


def search_entities(g: Graph, name: str, limit: int = 25) -> DataFrame:
    return g.entities.filter(F.contains(F.lower("name"), F.lit(name.lower()))).orderBy("id").limit(limit).select("id", "name", "entity_type")


def incident_edges(g: Graph, entity_id: str) -> DataFrame:
    """Edges at an entity from either end; a loop is matched once."""
    e = named_edges(g)
    out = e.filter(F.col("sid") == entity_id).select("edge_id", "type", "predicate", F.col("subject").alias("entity"), F.col("object").alias("other"))
    into = e.filter((F.col("oid") == entity_id) & (F.col("sid") != entity_id)).select("edge_id", "type", "predicate", F.col("object").alias("entity"), F.col("subject").alias("other"))
    return out.union(into)


def every_edge(g: Graph) -> DataFrame:
    """kind, a, b, predicate of all edges, also from documents and events."""
    r = g.edges.select(F.concat_ws(":", F.lit("r"), "edge_id").alias("eid"), F.col("sid").alias("a"), F.col("oid").alias("b"), "predicate")
    c = g.contains.select(F.concat_ws(":", F.lit("c"), "document", "entity_id").alias("eid"), F.concat(F.lit("doc:"), "document").alias("a"), F.col("entity_id").alias("b"), F.lit(None).cast("string").alias("predicate"))
    p = g.participates.select(F.concat_ws(":", F.lit("p"), "entity_id", "event_id", "role").alias("eid"), F.col("entity_id").alias("a"), F.concat(F.lit("ev:"), "event_id").alias("b"), F.lit(None).cast("string").alias("predicate"))
    return r.union(c).union(p)


def neighborhood(g: Graph, entity_id: str, limit: int = 100) -> DataFrame:
    """path (edge ids), target: undirected trails of one or two edges from an entity to entities, middle nodes of any kind, ordered."""
    e = every_edge(g)
    both = e.select("eid", F.col("a").alias("x"), F.col("b").alias("y")).union(e.filter("a <> b").select("eid", F.col("b").alias("x"), F.col("a").alias("y")))
    one = both.filter(F.col("x") == entity_id).select(F.col("eid").alias("e1"), F.col("y").alias("m"))
    two = one.join(both.withColumnRenamed("x", "m"), "m").filter("e1 <> eid").select(F.concat_ws(" ", "e1", "eid").alias("path"), F.col("y").alias("target"))
    paths = one.select(F.col("e1").alias("path"), F.col("m").alias("target")).union(two)
    names = g.entities.select(F.col("id").alias("target"), F.col("name").alias("target_name"))
    return paths.join(names, "target").orderBy("path", "target").limit(limit)


def document_subgraph(g: Graph, document: str) -> DataFrame:
    mine = (F.col("source_document") == document) | F.array_contains(F.coalesce("source_documents", F.array().cast("array<string>")), document)
    return named_edges(g).filter(mine)


def list_documents(g: Graph) -> DataFrame:
    """name, n_pages, entities, relations of every document."""
    per = g.contains.groupBy(F.col("document").alias("name")).agg(F.count("*").alias("entities"))
    rel = g.edges.select("edge_id", F.explode(F.array_distinct("source_documents")).alias("name")).groupBy("name").agg(F.count("*").alias("relations"))
    out = g.documents.join(per, "name", "left").join(rel, "name", "left")
    return out.select("name", F.size("pages").cast("long").alias("n_pages"), F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("relations", F.lit(0)).alias("relations"))


def evidence_for(g: Graph, sid: str, oid: str, predicate: str) -> DataFrame:
    return g.edges.filter((F.col("sid") == sid) & (F.col("oid") == oid) & (F.col("predicate") == predicate))


def events_for(g: Graph, entity_id: str, limit: int = 25) -> DataFrame:
    """Events an entity takes part in, by date text descending as stored (see ``event_day`` for calendar order)."""
    p = g.participates.filter(F.col("entity_id") == entity_id)
    return p.join(g.events.withColumnRenamed("id", "event_id"), "event_id").orderBy(F.col("event_date").desc(), "event_id", "role").limit(limit)


def event_day(c: Column) -> Column:
    """The calendar day of a date text, null if it is none."""
    return F.to_date(F.try_to_timestamp(F.initcap(c), F.lit("d MMMM yyyy")))


def totals(g: Graph) -> DataFrame:
    parts = [("entities", g.entities), ("edges", g.edges), ("events", g.events), ("participates", g.participates), ("contains", g.contains), ("documents", g.documents)]
    out = None
    for name, df in parts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.union(one)
    return out


def duplicated_ids(df: DataFrame, key: str) -> DataFrame:
    """Keys that break uniqueness."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


# ---- delete --------------------------------------------------------------------------------------------------------------

def delete_document(g: Graph, doc: str) -> tuple[Graph, DataFrame]:
    """The graph without one document and what came from it only, and one row of counts.

    Edges of this document alone go; shared edges, entities and events lose its name; entities left without
    documents and edges go (edges to events still count, as events are cleaned last); events without documents go.
    """
    empty = F.array().cast("array<string>")
    docs = F.when(F.col("source_documents").isNotNull(), F.col("source_documents")).otherwise(F.array("source_document"))
    mine = F.array_contains(F.array_compact(docs), doc)
    left = F.filter(docs, lambda d: d.isNotNull() & (d != doc))
    marked = g.edges.withColumns({"_mine": F.coalesce(mine, F.lit(False)), "_left": left})
    gone = marked.filter(F.col("_mine") & (F.size("_left") == 0))
    kept = marked.filter(~(F.col("_mine") & (F.size("_left") == 0)))
    shared = kept.filter("_mine")
    moved = F.when(F.col("_mine") & (F.col("source_document") == doc), F.col("_left")[0]).otherwise(F.col("source_document"))
    edges = kept.withColumns({"source_document": moved, "source_documents": F.when(F.col("_mine"), F.col("_left")).otherwise(F.col("source_documents"))}).drop("_mine", "_left")
    contains = g.contains.filter(F.col("document") != doc)
    documents = g.documents.filter(F.col("name") != doc)
    has = F.array_contains(F.coalesce("documents", empty), doc)
    ents = g.entities.withColumns({"_has": has, "documents": F.array_remove(F.coalesce("documents", empty), doc)})
    ends = edges.select(F.col("sid").alias("id")).union(edges.select("oid")).union(contains.select("entity_id")).union(g.participates.select("entity_id")).distinct()
    orphans = ents.filter(F.size("documents") == 0).join(ends, "id", "left_anti")
    entities = ents.join(orphans.select("id"), "id", "left_anti").drop("_has")
    ev = g.events.withColumns({"_has": has, "documents": F.array_remove(F.coalesce("documents", empty), doc)})
    ev_gone = ev.filter(F.size("documents") == 0)
    events = ev.filter(F.size("documents") > 0).drop("_has")
    part = g.participates.join(ev_gone.select(F.col("id").alias("event_id")), "event_id", "left_anti")
    counts = None
    for name, df in (
        ("relations_deleted", gone), ("relations_scrubbed", shared), ("documents_deleted", g.documents.filter(F.col("name") == doc)),
        ("entities_scrubbed", ents.filter("_has")), ("orphan_entities_deleted", orphans), ("events_scrubbed", ev.filter("_has")), ("orphan_events_deleted", ev_gone),
    ):
        # Two properties are set on every shared edge.
        n = F.count("*") * 2 if name == "relations_scrubbed" else F.count("*")
        one = df.agg(n.alias("n")).select(F.lit(name).alias("what"), "n")
        counts = one if counts is None else counts.union(one)
    return Graph(entities, edges, events, part, contains, documents), counts
