"""The ingest and the answer turn, composed of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from veriloom.functions import text as X
from veriloom.operators import graph as G
from veriloom.operators import metrics as M
from veriloom.operators import resolution as R
from veriloom.operators import retrieval as T
from veriloom.operators import validation as VA
from veriloom.session import materialize


def resolve(mentions: DataFrame, fuzzy: bool = True, threshold: float = 0.85) -> DataFrame:
    """Entity records of mention groups after alias and fuzzy merging: rec_id is the first use, id the leader's."""
    groups = materialize(R.canonical_groups(mentions), "resolve_groups")
    pairs = R.alias_pairs(groups).select("id_a", "id_b")
    if fuzzy:
        pairs = pairs.union(R.fuzzy_pairs(groups, threshold).select("id_a", "id_b")).distinct()
    leader = R.greedy_clusters(groups.select("id", "entity_type", "normalized_name", "first_ord"), pairs)
    members = groups.withColumn("alternative_names", F.array_except("mentions", F.array("name"))).join(leader, "id").drop("id")
    members = members.withColumn("_len", -F.length("normalized_name"))
    merged = R.merge_clusters(members, "leader", ["_len", "first_ord"])
    first = members.groupBy("leader").agg(F.min("first_ord").alias("rec_id"))
    return merged.join(first, "leader").select("rec_id", "id", "name", "normalized_name", "entity_type", "mentions", "alternative_names", "documents", "pages", "sentences")


def ingest(mentions: DataFrame, relations: DataFrame, fuzzy: bool = True) -> tuple[G.Graph, DataFrame]:
    """Mentions and extracted relations to the graph, and one row of statistics.

    Endpoints are linked to the resolved entities, unknown ones become untyped
    nodes, dates are read from the evidence, duplicates merged.
    """
    records = materialize(resolve(mentions, fuzzy), "ingest_records")
    known = records.select("id", "normalized_name", "alternative_names", "mentions", F.col("rec_id").alias("pos"))
    linked = materialize(R.link_relations(relations, R.mention_index(known)), "ingest_linked")
    new = R.placeholders(linked, known)
    none = F.array().cast("array<string>")
    last = records.agg(F.max("rec_id").alias("n")).first().n or 0
    nodes = records.unionByName(
        new.select(
            (F.lit(last + 1) + F.abs(F.xxhash64("id")) % 1_000_000_000).alias("rec_id"), "id", "name", "normalized_name", F.lit("NOUN_PHRASE").alias("entity_type"),
            F.array("name").alias("mentions"), none.alias("alternative_names"), none.alias("documents"), F.array().cast("array<int>").alias("pages"), none.alias("sentences"),
        )
    )
    nodes = with_places(nodes, R.endpoint_places(linked, nodes.select("id", "normalized_name", F.col("rec_id").alias("pos"))))
    all_known = nodes.select("id", "normalized_name", "alternative_names", "mentions", F.col("rec_id").alias("pos"))
    relinked = R.link_relations(linked, R.mention_index(all_known))
    clean = VA.deduplicate(VA.with_evidence(VA.attach_dates(relinked))).select(*relinked.columns)
    clean = materialize(clean, "ingest_relations")
    return G.build_graph(nodes, clean), M.graph_stats(G.merge_entities(nodes), clean)


def with_places(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """``nodes`` with documents and pages of ``places`` (id, document, page) appended if absent."""
    seen = places.groupBy("id").agg(F.array_sort(F.collect_set("document")).alias("_d"), F.array_sort(F.collect_set("page")).alias("_p"))
    out = nodes.join(seen, "id", "left")
    add = lambda c, n: F.when(F.col(n).isNull(), F.col(c)).otherwise(F.concat(F.coalesce(c, F.slice(n, 1, 0)), F.array_except(n, F.coalesce(c, F.slice(n, 1, 0)))))
    return out.withColumns({"documents": add("documents", "_d"), "pages": add("pages", "_p")}).drop("_d", "_p").select(*nodes.columns)


def ingest_pages(
    pages: DataFrame, make_parser, make_spans, events: bool = True, fuzzy: bool = True, export: str | None = None, store: str | None = None
) -> tuple[G.Graph, DataFrame]:
    """Pages (document, page_number, text) to the graph in one call: parse, mentions, triples, resolution, linking; optionally exported and stored.

    make_parser: see ``triples.parse``.  make_spans: token table -> (entity spans, noun chunks).  A page's sentences are
    the evidence.  Without ``events`` no event is made of dated relations.
    """
    from veriloom.operators import triples as N
    from veriloom.sources import exports, store as ST

    keyed = pages.filter(F.col("document").isNotNull()).select(F.concat_ws("\x01", "document", F.col("page_number").cast("string")).alias("doc"), "text")
    tokens = materialize(N.parse(keyed, "doc", "text", make_parser), "ingest_tokens")
    ents, chunks = make_spans(tokens)
    spans = materialize(N.kept_spans(ents, chunks), "ingest_spans")
    place = lambda df: df.withColumns({"document": F.substring_index("doc", "\x01", 1), "page_number": F.substring_index("doc", "\x01", -1).cast("int")})
    words = tokens.groupBy("doc", "sent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), " ").alias("sentence"), F.min("i").alias("first_i"))
    number = lambda df, order: df.withColumn("ord", F.row_number().over(W.Window.partitionBy("doc").orderBy(*order)) + F.abs(F.xxhash64("doc")) % F.lit(2**40) * 2**20)
    said = place(number(spans.join(words.select("doc", "sent", "sentence"), ["doc", "sent"]), ["first", "last"]))
    mentions = said.select(
        "ord", X.clean_display(F.col("text")).alias("text"), X.normalize_name(F.col("text")).alias("normalized_name"), F.col("label").alias("entity_type"), "document", "page_number", "sentence"
    )
    found = place(number(N.triples(tokens).join(words, ["doc", "sent"]), ["sent", "subject", "predicate", "object"]))
    relations = found.select(
        "ord", F.col("subject").alias("subject_text"), "predicate", F.col("object").alias("object_text"), X.normalize_relation(F.col("predicate")).alias("relation_type"), "sentence",
        "document", "page_number", F.col("pattern").alias("extraction_method"), F.lit("candidate").alias("review_status"), "negated", (F.col("hundredths") / 100).alias("confidence"),
        F.lit(None).cast("string").alias("event_date"), F.lit(None).cast("string").alias("subject_id"), F.lit(None).cast("string").alias("object_id"),
    )
    g, stats = ingest(materialize(mentions, "ingest_mentions"), materialize(relations, "ingest_found"), fuzzy)
    if not events:
        g = G.Graph(g.entities, g.edges, g.events.limit(0), g.participates.limit(0), g.contains, g.documents)
    if export:
        exports.write_json(exports.entity_rows(g.entities), f"{export}/entities.json")
        exports.write_json(G.named_edges(g), f"{export}/relationships.json")
    if store:
        ST.store_graph(g, store)
    return g, stats


def answer(question: str, relations: DataFrame, k: int = 8, generate: Callable[[str, str], str] | None = None) -> dict:
    """The answer turn: keyword facts, their neighbours, the cited context, and the answer of the given generator."""
    facts = T.facts(relations)
    seeds = T.ranked(T.keyword_topk(facts, question, k), F.col("score").desc(), F.col("confidence").desc(), "ord").withColumn("inferred", F.lit(False))
    hops = T.ranked(T.hop_expand(seeds, facts), "ord").withColumn("inferred", F.lit(True))
    found = T.merged([seeds, hops])
    context = T.context_lines(found).first().context
    return {"answer": T.answer(question, context, generate), "facts": found, "context": context}
