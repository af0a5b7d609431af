"""Keyword, vector and multi-hop retrieval over relations, and the cited context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions import text as X


def facts(relations: DataFrame) -> DataFrame:
    """ord, subject, predicate, object, evidence, document, page, confidence (null and NaN count as 0.5)."""
    conf = F.coalesce(F.when(F.isnan("confidence"), F.lit(None)).otherwise(F.col("confidence")), F.lit(0.5))
    return relations.select(
        "ord", F.col("subject_text").alias("subject"), "predicate", F.col("object_text").alias("object"), F.col("sentence").alias("evidence"),
        "document", F.col("page_number").alias("page"), conf.alias("confidence"),
    )


def keyword_topk(all_facts: DataFrame, question: str, k: int = 8) -> DataFrame:
    """The k facts that share most words with the question, then the most confident, then the first.  A question without content words finds nothing."""
    tokens = X.question_tokens(F.lit(question))
    hay = F.array_distinct(X.words(F.concat_ws(" ", "subject", "predicate", "object", "evidence")))
    scored = all_facts.withColumn("score", X.overlap_score(tokens, hay)).filter("score > 0")
    return scored.orderBy(F.col("score").desc(), F.col("confidence").desc(), "ord").limit(k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def vector_topk(points: DataFrame, key: str, vector: str, query: list[float], k: int = 8) -> DataFrame:
    """key, score: the k points of largest cosine (four decimals), equal ones by key.  Points of another length or of no length are no hits."""
    q = F.array(*(F.lit(float(x)) for x in query))
    ok = points.filter(F.col(vector).isNotNull() & (F.size(vector) == len(query)))
    scored = ok.select(F.col(key), F.round(cosine(F.col(vector), q), 4).alias("score")).filter(F.col("score").isNotNull() & ~F.isnan("score"))
    return scored.orderBy(F.col("score").desc(), key).limit(k)


def _key() -> Column:
    return F.concat_ws("||", *(F.lower(F.coalesce(c, F.lit(""))) for c in ("subject", "predicate", "object")))


def merged(lists: list[DataFrame]) -> DataFrame:
    """Facts of several ranked lists (columns rank and the fact), each triple once, earlier lists first; adds place."""
    out = None
    for i, df in enumerate(lists):
        one = df.withColumn("_list", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    first = Window.partitionBy(_key()).orderBy("_list", "rank")
    kept = out.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return kept.withColumn("place", F.row_number().over(Window.orderBy("_list", "rank"))).drop("_list")


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """Adds rank to a list that has been cut to a few rows."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hop_expand(seeds: DataFrame, all_facts: DataFrame, max_extra: int = 6) -> DataFrame:
    """Facts that touch an end of a seed fact and are no seed triple, in input order."""
    names = seeds.select(F.explode(F.array(F.lower("subject"), F.lower("object"))).alias("name")).filter("name is not null").distinct()
    keys = seeds.select(_key().alias("k")).distinct()
    touch = all_facts
    for side in ("subject", "object"):
        touch = touch.join(F.broadcast(names.select(F.col("name").alias(f"_{side}"))), F.lower(side) == F.col(f"_{side}"), "left")  # seeds: a few rows
    touch = touch.filter("_subject is not null or _object is not null").drop("_subject", "_object")
    return touch.withColumn("k", _key()).join(F.broadcast(keys), "k", "left_anti").drop("k").orderBy("ord").limit(max_extra)


def hop_expand_graph(seeds: DataFrame, edges: DataFrame, per_end: int = 6, enough: int = 6) -> DataFrame:
    """Edges at the ends of the first four seeds (rank), at most ``per_end`` each; no new end is probed once ``enough`` are collected."""
    ends = seeds.filter("rank <= 4").select("rank", F.posexplode(F.array("subject", "object")).alias("side", "name")).filter("coalesce(name, '') <> ''")
    sym = edges.select("edge_id", F.col("subject").alias("x"), "predicate", F.col("object").alias("y"), "confidence").union(
        edges.filter("sid <> oid").select("edge_id", F.col("object").alias("x"), "predicate", F.col("subject").alias("y"), "confidence")
    )
    hit = sym.join(F.broadcast(ends), F.lower("x") == F.lower("name"))  # at most eight ends
    nth = Window.partitionBy("rank", "side").orderBy("edge_id", "y")
    hit = hit.withColumn("n", F.row_number().over(nth)).filter(F.col("n") <= per_end)
    per = hit.groupBy("rank", "side").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("rank", "side").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ends = per.withColumn("before", before).filter(F.col("before") < enough).select("rank", "side")
    return hit.join(open_ends, ["rank", "side"]).select("rank", "side", "n", F.col("x").alias("subject"), "predicate", F.col("y").alias("object"), "confidence")


def graph_facts(named: DataFrame, limit: int = 2000) -> DataFrame:
    """Facts of the edges of a graph, the first ``limit`` by edge_id: the keyword path over the graph (the first evidence counts)."""
    top = named.orderBy("edge_id").limit(limit)
    return top.select(
        F.col("edge_id").alias("ord"), "subject", "predicate", "object", F.get("evidence", F.lit(0)).alias("evidence"), F.col("source_document").alias("document"),
        F.col("page_number").alias("page"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
    )


def vector_facts(points: DataFrame, query: list[float], k: int = 8) -> DataFrame:
    """The facts of the k points most similar to a vector, with score and id."""
    near = vector_topk(points, "id", "vector", query, k).join(points.select("id", "payload").dropDuplicates(["id"]), "id")
    return near.select(
        "id", "score", F.lit(None).cast("long").alias("ord"), "payload.subject", "payload.predicate", "payload.object", "payload.evidence", "payload.document", "payload.page",
        F.coalesce(F.when(F.isnan("payload.confidence"), F.lit(None)).otherwise(F.col("payload.confidence")), F.lit(0.5)).alias("confidence"),
    )


def hybrid(keyword: DataFrame, vector: DataFrame | None, all_facts: DataFrame, k: int = 8, max_extra: int = 6) -> DataFrame:
    """place, the facts and inferred: keyword and vector hits as one list cut to k, then the facts one step from it.

    keyword: ranked keyword facts; vector: ``vector_facts`` or nothing.  A triple is listed once, where it stands first.
    """
    lists = [keyword.withColumn("inferred", F.lit(False))]
    if vector is not None:
        lists.append(ranked(vector, F.col("score").desc(), "id").withColumn("inferred", F.lit(False)))
    cols = ["ord", "subject", "predicate", "object", "evidence", "document", "page", "confidence", "inferred"]
    seeds = merged([x.select("rank", *cols) for x in lists]).filter(F.col("place") <= k).select(F.col("place").alias("rank"), *cols)
    hops = ranked(hop_expand(seeds, all_facts, max_extra), "ord").withColumn("inferred", F.lit(True)).select("rank", *cols)
    return merged([seeds, hops])


def strategy(question: str, keyword_hits: int, vector_hits: int) -> str:
    """Which lists an answer stands on, and which of them the question leans to."""
    import re

    named = bool(re.search(r"(?<![A-Za-z0-9_])[A-Z]{2,}[-/]?[0-9]", question or "") or re.search('"[^"]+"', question or ""))
    if keyword_hits and vector_hits:
        return "hybrid" + ("+entity-first" if named else "+semantic-first")
    return "vector" if vector_hits else "graph"


def context_lines(ranked_facts: DataFrame, max_chars: int = 4000) -> DataFrame:
    """One row: the numbered, cited lines of a ranked list, cut to ``max_chars``."""
    tag = F.when(F.coalesce(F.col("inferred"), F.lit(False)), "INFERRED (2-hop neighbor, weaker)").otherwise("EXPLICIT") if "inferred" in ranked_facts.columns else F.lit("EXPLICIT")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    line = F.concat(
        F.lit("["), "place", F.lit(":"), tag, F.lit("] Subject: "), shown("subject"), F.lit(" | Relation: "), shown("predicate"), F.lit(" | Object: "), shown("object"),
        F.lit(" | Source: "), shown("document"), F.lit(", page "), shown("page"), F.lit(", confidence "), F.format_string("%.2f", "confidence"), F.lit(" | Evidence: "), shown("evidence"),
    )
    rows = ranked_facts.select("place", line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("l"))
    return rows.select(F.substring(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), 1, max_chars).alias("context"))


def answer(question: str, context: str, generate: Callable[[str, str], str] | None = None) -> str:
    """The generated answer; without facts or without a generator nothing is made up."""
    if not context:
        return "I don't know based on the available evidence."
    return generate(question, context) if generate else context
