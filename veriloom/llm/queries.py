"""Queries of the training-data operators over the project's tables, with SQL to check them where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions import text as X
from veriloom.llm import components, golden, lookalike, mixing, neighbours, packing, scans, sentences, tokens, topn, variants
from veriloom.session import materialize, spread

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- 1: top N within every group -------------------------------------------------------------------------------

def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = table(spark, sf_dir, "relations").select("ord", "document", "confidence", "ingested_at").filter(F.col("ord").isNotNull())
    now = topn.latest_delivery(rel, "ord", "ingested_at", ["confidence", "document"])
    return topn.top_n_per_group(now, F.col("document"), F.col("confidence"), [F.col("ord")], 5, ["document", "ord"])


# ---- 2: best representative --------------------------------------------------------------------------------------

def usable_name(name, normalized):
    """Present, no stand-in and not cut off: its canonical form is the one the id stands for."""
    shown = X.without_invisible(F.coalesce(name, F.lit("")))
    return (X.normalize_name(shown) == normalized) & (F.length(normalized) > 0)


def deduplicated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entities").filter(F.col("id").isNotNull() & F.col("rec_id").isNotNull())
    e = e.select("rec_id", "id", "name", "normalized_name", "entity_type", "mentions", "extraction_method", "resolved_at").dropDuplicates(["rec_id"])
    method = table(spark, sf_dir, "method_trust").groupBy("extraction_method").agg(F.min("trust_rank").alias("trust_rank"))
    return e.join(method, "extraction_method", "left")


def shared_ids(records: DataFrame) -> DataFrame:
    return records.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")


def distinct_mentions(mentions):
    trimmed = F.transform(F.coalesce(mentions, F.array().cast("array<string>")), lambda m: X.strip(m))
    return F.array_distinct(F.filter(trimmed, lambda m: m.isNotNull() & (m != "")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names: records vote for their normalised name with trust times decay, the best record of the winning name delivers it.  Mentions: every
    different mention of a record is a vote for its list, and the winning list is that of one record by definition."""
    rec = deduplicated_records(spark, sf_dir)
    rank, when = F.coalesce(-F.col("trust_rank"), F.lit(-(2**31))), F.unix_micros(F.col("resolved_at").cast("timestamp"))
    shown = X.normalize_name(X.without_invisible(F.coalesce("name", F.lit(""))))
    vote = golden.trust(F.col("trust_rank")) * golden.decay(F.col("resolved_at"))
    names = golden.Field(
        "name_rec", F.col("rec_id"), shown, F.when(usable_name(F.col("name"), F.col("normalized_name")), vote), F.struct(rank.cast("long").alias("a"), when.alias("b"))
    )
    by_name = golden.best_record(rec, "id", "rec_id", [names])
    # One row per mention: the votes of a list add up over its mentions.  A list of none keeps a vote of 0.
    lists = rec.select("id", "rec_id", when.alias("at"), F.explode_outer(distinct_mentions(F.col("mentions"))).alias("mention"))
    full = golden.Field("mentions_rec", F.col("rec_id"), F.col("rec_id"), F.col("mention").isNotNull().cast("int"), F.struct(F.lit(0).cast("long").alias("a"), F.col("at").alias("b")))
    by_list = golden.best_record(lists.withColumn("latest", rank_of_time(F.col("at"), F.col("rec_id"))), "id", "latest", [full])
    return by_name.join(by_list, "id").join(shared_ids(rec), "id", "left_semi").select("id", "name_rec", "mentions_rec")


def rank_of_time(at, rec_id):
    """A tie that is smallest for the latest time (null is oldest), then for the smallest record: one sortable whole number."""
    return F.coalesce(-at, F.lit(2**62)).cast("decimal(20,0)") * F.lit(10**18).cast("decimal(19,0)") + rec_id.cast("decimal(19,0)")


def p2_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general form: records that agree on a normalised value add up their votes."""
    rec = deduplicated_records(spark, sf_dir)
    vote = golden.trust(F.col("trust_rank")) * golden.decay(F.col("resolved_at"))
    shown = X.clean_display(X.without_invisible(F.col("name")))
    fields = [
        golden.Field("name", shown, F.lower(shown), F.when(usable_name(F.col("name"), F.col("normalized_name")), vote)),
        golden.Field("entity_type", F.col("entity_type"), F.upper(F.col("entity_type")), vote),
    ]
    best = golden.best_record(rec, "id", "rec_id", fields)
    return best.join(shared_ids(rec), "id", "left_semi").select("id", "name", "entity_type")


# ---- 3: variant spellings ------------------------------------------------------------------------------------------

def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_pairs(variants.shown_names(table(spark, sf_dir, "entities"), table(spark, sf_dir, "mentions")))


# ---- 4: consolidating pairs ----------------------------------------------------------------------------------------

def matched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "match_pairs").filter("is_match").select("id_a", "id_b", "normalized_a", "normalized_b")
    known = table(spark, sf_dir, "entities").filter("id is not null and normalized_name is not null")
    known = known.groupBy("normalized_name").agg(F.min("id").alias("known"))
    for side in ("a", "b"):
        k = known.select(F.col("normalized_name").alias(f"normalized_{side}"), F.col("known").alias(f"known_{side}"))
        pairs = pairs.join(k, f"normalized_{side}", "left")
    return pairs.select(
        F.coalesce("id_a", "known_a").alias("a"), F.coalesce("id_b", "known_b").alias("b")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = matched_pairs(spark, sf_dir)
    # A side that cannot be resolved leaves its partner as a group of its own.
    pairs = pairs.select(F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b"))
    return components.connected_components(pairs, "a", "b")


# ---- 5: sentence boundaries ----------------------------------------------------------------------------------------

def pages(spark: SparkSession, sf_dir: str, scanned: bool) -> DataFrame:
    """Pages of files marked needs_ocr or of all others (a file that is not listed is not marked); redelivered pages repeat."""
    marked = table(spark, sf_dir, "pdf_results").filter("needs_ocr and document is not null").select("document").distinct()
    seg = table(spark, sf_dir, "segments").select("seg_id", "document", "page_number", "text", "lang").filter("seg_id is not null")
    return seg.join(marked, "document", "left_semi" if scanned else "left_anti")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A redelivered page gives the same units again: comparing units moves no text.
    return sentences.sentence_units(spread(pages(spark, sf_dir, scanned=False)), "seg_id", "text").distinct()


# ---- 6: scanned pages ----------------------------------------------------------------------------------------------

def scan(spark: SparkSession, sf_dir: str) -> scans.Scan:
    seg = table(spark, sf_dir, "segments").select("seg_id", "text")
    shown = table(spark, sf_dir, "mentions").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}0-9]+"), F.lit(0))).alias("word"))
    names = shown.filter(F.col("word").rlike(r"^\p{Lu}")).select(F.lower("word").alias("w")).distinct()
    return scans.Scan(pages(spark, sf_dir, scanned=True), seg, names)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir).findings()


def p6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir).paragraphs()


# ---- 7: most similar vectors ---------------------------------------------------------------------------------------

def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.similar_vectors(table(spark, sf_dir, "kg_evidence"), "id", "vector", dims=96, k=5, min_cos=0.8)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


# ---- 8 and 9: containers and mixtures ---------------------------------------------------------------------------------

def counted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return materialize(tokens.token_counts(spread(docs), "text"), "doc_tokens")


def container_kinds(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    """The kinds of container: a fixed table of a few rows."""
    rows = table(spark, sf_dir, "container_kinds").filter("container is not null and capacity_tokens > 0")
    return sorted((r.container, int(r.capacity_tokens)) for r in rows.groupBy("container").agg(F.max("capacity_tokens").alias("capacity_tokens")).collect())


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = counted_documents(spark, sf_dir)
    return packing.pack(docs, "doc_id", "n_tokens", None, container_kinds(spark, sf_dir))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: containers, tokens, parts and the share of the capacity that stays unused."""
    kinds = container_kinds(spark, sf_dir)
    cap = F.create_map(*(x for k, c in kinds for x in (F.lit(k), F.lit(c))))
    per = p8_containers(spark, sf_dir).groupBy("kind", "container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("parts"))
    per = per.groupBy("kind").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum("parts").alias("parts"), F.max("tokens").alias("fullest"))
    return per.withColumn("unused", F.round(1 - F.col("tokens") / (F.col("containers") * cap[F.col("kind")]), 6))


def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed under three limits that all bind: per kind the containers, how often each limit was the one that filled a container, and what was broken.

    A document is read as an instruction (its first sentence or line, which bears no loss) and an answer; a
    container takes at most nine tenths of its capacity in loss-bearing tokens and one segment per 128 tokens.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = docs.select("doc_id", "text", F.substring_index(F.substring_index("text", "\n", 1), ". ", 1).alias("head"))
    counted = materialize(tokens.token_counts(tokens.token_counts(spread(both), "head", "n_head"), "text", "n_tokens"), "doc_parts")
    kinds = container_kinds(spark, sf_dir)
    packed = packing.pack(counted, "doc_id", "n_tokens", F.greatest(F.col("n_tokens") - F.col("n_head"), F.lit(0)), kinds, tokens_per_segment=128, loss_share=0.9)
    cap = F.create_map(*(x for k, c in kinds for x in (F.lit(k), F.lit(c))))[F.col("kind")]
    per = packed.groupBy("kind", "container").agg(F.sum("tokens").alias("t"), F.count("*").alias("s"), F.sum("loss").alias("l"))
    return per.groupBy("kind").agg(
        F.count("*").alias("containers"), F.sum("t").alias("tokens"),
        F.sum((F.col("t") >= 0.97 * cap).cast("long")).alias("by_tokens"),
        F.sum((F.col("s") == F.greatest(F.lit(1), F.floor(cap / 128))).cast("long")).alias("by_segments"),
        F.sum((F.col("l") >= 0.97 * 0.9 * cap).cast("long")).alias("by_loss"),
        F.sum(((F.col("t") > cap) | (F.col("s") > F.greatest(F.lit(1), F.floor(cap / 128))) | (F.col("l") > F.floor(0.9 * cap))).cast("long")).alias("broken"),
    )


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: documents packed, over-full containers, documents with lost or invented tokens, documents divided without need, and whether over a fiftieth of the capacity stays unused."""
    docs = counted_documents(spark, sf_dir)
    kinds = container_kinds(spark, sf_dir)
    packed = materialize(packing.pack(docs, "doc_id", "n_tokens", None, kinds), "pack_checked")
    cap = F.create_map(*(x for k, c in kinds for x in (F.lit(k), F.lit(c))))[F.col("kind")]
    full = packed.groupBy("kind", "container").agg(F.sum("tokens").alias("t"), F.count("*").alias("s"))
    full = full.groupBy("kind").agg(
        F.sum(((F.col("t") > cap) | (F.col("s") > F.greatest(F.lit(1), F.floor(cap / 16)))).cast("long")).alias("over_full"),
        ((F.count("*") - 1) * F.first(cap) > 1.02 * F.sum("t")).alias("wasteful"),
    )
    per = packed.groupBy("kind", F.col("item").alias("doc_id")).agg(F.sum("tokens").alias("t"), F.count("*").alias("parts"))
    per = per.join(docs.select("doc_id", "n_tokens"), "doc_id")
    per = per.groupBy("kind").agg(
        F.count("*").alias("documents"), F.sum((F.col("t") != F.col("n_tokens")).cast("long")).alias("changed"),
        F.sum((F.col("parts") != F.ceil(F.col("n_tokens") / cap)).cast("long")).alias("divided"),
    )
    return per.join(full, "kind").select("kind", "documents", "over_full", "changed", "divided", "wasteful")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(counted_documents(spark, sf_dir), "doc_id", "source", "n_tokens", table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p9_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per listed source: whether a document is used too often or comes from elsewhere, and whether the share misses its target.

    A share is missed if it is off by over a thousandth of all tokens and by more than the longest text of its source: texts are
    used whole, so a source of a few texts cannot come closer than one of them.  A source without texts misses its share.
    """
    docs = counted_documents(spark, sf_dir)
    mixed = materialize(mixing.mix(docs, "doc_id", "source", "n_tokens", table(spark, sf_dir, "mix_targets")), "mix_checked")
    longest = docs.filter("n_tokens > 0").groupBy("source").agg(F.max("n_tokens").alias("longest"))
    got = mixing.shares(mixed, table(spark, sf_dir, "mix_targets"))
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("source").alias("own"))
    strange = mixed.join(own, "item", "left").groupBy("source").agg(F.sum((~F.col("own").eqNullSafe(F.col("source"))).cast("long")).alias("strange"))
    total = mixed.agg(F.sum(F.col("tokens") * F.col("uses")).alias("total")).first().total or 0
    off = F.abs(F.col("share") - F.col("target_share")) * total
    return got.join(strange, "source", "left").join(longest, "source", "left").select(
        "source", (F.col("most_used") > F.col("max_repeats")).alias("over_used"), F.coalesce("strange", F.lit(0)).alias("strange"),
        (off > F.greatest(F.lit(0.001 * total), F.coalesce("longest", F.lit(0)).cast("double"))).alias("off_target"),
    )


# ---- 10: visually identical text ----------------------------------------------------------------------------------

def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_look_pairs(table(spark, sf_dir, "documents"), "doc_id", "text", "doc_a", "doc_b")


def p10_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The common form of every text: its digest, its length and whether it differs from the stored text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    formed = lookalike.common_form(docs, "text", "form")
    return formed.select(
        "doc_id", F.md5("form").alias("form_md5"), F.length("form").alias("form_chars"), (~F.col("form").eqNullSafe(F.col("text"))).alias("changed")
    )


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_consensus": p2_consensus,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_paragraphs": p6_paragraphs,
    "p7_found": p7_found,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p8_limits": p8_limits,
    "p8_checks": p8_checks,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p9_checks": p9_checks,
    "p10_found": p10_found,
    "p10_forms": p10_forms,
}
