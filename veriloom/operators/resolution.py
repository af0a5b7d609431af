"""Entity resolution: canonical groups, alias and fuzzy candidates, greedy clusters, mention index, linking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions import text as X
from veriloom.functions import vocab as V
from veriloom.operators.similar import compared, similarity  # noqa: F401
from veriloom.session import materialize


def _grouped(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions with their canonical form, and the mention groups without their lists."""
    m = mentions.select(
        "ord", "text", "document", "page_number", "sentence", F.coalesce("entity_type", F.lit("NOUN_PHRASE")).alias("entity_type"),
        X.canon(F.col("text"), F.col("normalized_name")).alias("normalized_name"),
    )
    base = m.groupBy("normalized_name", "entity_type").agg(
        F.max_by("text", F.struct(F.length("text"), (-F.col("ord")).alias("o"))).alias("name"), F.min("ord").alias("first_ord"), F.count("*").alias("n_mentions")
    )
    return m, base


def canonical_names(mentions: DataFrame) -> DataFrame:
    """Mention groups as ``canonical_groups`` has them, without the lists: normalized_name, entity_type, name, first_ord, n_mentions, id."""
    return _grouped(mentions)[1].withColumn("id", X.entity_id(F.col("entity_type"), F.col("normalized_name")))


def canonical_groups(mentions: DataFrame) -> DataFrame:
    """id, normalized_name, entity_type, name, mentions, documents, pages, sentences, first_ord of mention groups.

    Lists hold distinct values in order of first use; the display name is the longest text, the first of equals.
    Each list is de-duplicated by its own aggregation before it is collected.
    """
    m, base = _grouped(mentions)
    key = ["normalized_name", "entity_type"]
    # One long table of all list values, aggregated once.
    names = {"text": "mentions", "document": "documents", "page_number": "pages", "sentence": "sentences"}
    values = F.array(*(F.struct(F.lit(name).alias("f"), F.col(c).cast("string").alias("v")) for c, name in names.items()))
    long = m.select(*key, "ord", F.explode(values).alias("l")).select(*key, "ord", "l.*").filter(F.col("v").isNotNull() & (F.col("v") != ""))
    once = long.groupBy(*key, "f", "v").agg(F.min("ord").alias("o"))
    in_order = lambda f: F.transform(F.array_sort(F.collect_list(F.when(F.col("f") == f, F.struct("o", "v")))), lambda x: x["v"])
    lists = once.groupBy(*key).agg(*(in_order(f).alias(f) for f in names.values())).withColumn("pages", F.col("pages").cast("array<int>"))
    return base.join(lists, key, "left").withColumn("id", X.entity_id(F.col("entity_type"), F.col("normalized_name")))


def _tokens_of(groups: DataFrame) -> DataFrame:
    return groups.select("id", "normalized_name", "entity_type", "first_ord", X.content_tokens(F.col("normalized_name")).alias("tokens"))


def alias_pairs(groups: DataFrame) -> DataFrame:
    """id_a, id_b (id_a < id_b), why: token subset or acronym of a compatible type.

    Lossless blocking: a name contained in another shares its own rarest token
    with it, so each name probes with that token only and a common token never
    meets itself.  Acronyms meet on the prefixes of initials.
    """
    words = F.size(F.split("normalized_name", " "))
    g = _tokens_of(groups).filter((F.length("normalized_name") <= 60) & (words <= 6) & (F.size("tokens") > 0))
    g = materialize(g, "alias_groups")
    tok = g.select("id", F.explode("tokens").alias("t"))
    df = tok.groupBy("t").agg(F.count("*").alias("df"))
    rarest = tok.join(df, "t").groupBy("id").agg(F.min_by("t", F.struct("df", "t")).alias("t"))
    cand = rarest.withColumnRenamed("id", "short").join(tok.withColumnRenamed("id", "long"), "t").filter("short <> long").select("short", "long").distinct()
    cols = ["id", "normalized_name", "entity_type", "tokens"]
    a = g.select(*(F.col(c).alias(f"{c}_s") for c in cols))
    b = g.select(*(F.col(c).alias(f"{c}_l") for c in cols))
    pairs = cand.join(a, F.col("short") == F.col("id_s")).join(b, F.col("long") == F.col("id_l"))
    generic = (F.size("tokens_s") == 1) & F.col("tokens_s")[0].isin(V.GENERIC_SINGLETONS)
    subset = pairs.filter((F.size(F.array_except("tokens_s", "tokens_l")) == 0) & ~generic & X.compatible_types(F.col("entity_type_s"), F.col("entity_type_l")))
    # Acronyms: the squeezed short name starts the initials of the long one.
    squeezed = g.select("id", "entity_type", F.regexp_replace("normalized_name", "[^a-z0-9]", "").alias("sq")).filter(F.length("sq").between(2, 6))
    initials = F.array_join(F.transform(X.content_words(F.col("normalized_name")), lambda t: F.substring(t, 1, 1)), "")
    heads = g.filter(F.size(X.content_words(F.col("normalized_name"))) >= 2).select("id", "entity_type", initials.alias("ini"))
    heads = heads.filter(F.length("ini") >= 2).select("id", "entity_type", F.explode(F.transform(F.sequence(F.lit(2), F.least(F.lit(6), F.length("ini"))), lambda n: F.substr("ini", F.lit(1), n))).alias("sq"))
    s, h = squeezed.alias("s"), heads.alias("h")
    acr = s.join(h, F.col("s.sq") == F.col("h.sq")).filter((F.col("s.id") != F.col("h.id")) & X.compatible_types(F.col("s.entity_type"), F.col("h.entity_type")))
    both = subset.select(F.col("id_s").alias("x"), F.col("id_l").alias("y"), F.lit("subset").alias("why")).union(
        acr.select(F.col("s.id").alias("x"), F.col("h.id").alias("y"), F.lit("acronym").alias("why"))
    )
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "why").groupBy("id_a", "id_b").agg(F.max("why").alias("why"))


def fuzzy_pairs(groups: DataFrame, threshold: float = 0.85) -> DataFrame:
    """id_a, id_b, similarity of compatible names with a common content token (the blocking key) at or above ``threshold``."""
    g = _tokens_of(groups).filter(F.size("tokens") > 0).select("id", "normalized_name", "entity_type", "tokens")
    return compared(materialize(g, "fuzzy_groups"), threshold, X.compatible_types)


def _label_components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, component: smallest id reachable; every round halves the paths by also looking up the label of the label."""
    edges = materialize(pairs.select("id_a", "id_b").union(pairs.select("id_b", "id_a")).distinct(), "leader_edges").toDF("a", "b")
    labels = materialize(nodes.select("id", F.col("id").alias("c")), "leader_labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("c").alias("m"))
        step = labels.join(near, labels.id == near.a, "left").select("id", "c", F.least("c", F.coalesce("m", "c")).alias("n"))
        jump = step.select(F.col("id").alias("n"), F.col("n").alias("nn"))
        new = step.join(jump, "n", "left").select("id", "c", F.least("n", F.coalesce("nn", "n")).alias("n"))
        new = materialize(new, "leader_labels")
        if new.filter("c <> n").isEmpty():
            return new.select("id", F.col("n").alias("component"))
        labels = new.select("id", F.col("n").alias("c"))


def greedy_clusters(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, leader: names in the order of length (longest first) and first use each join the first leader they match.

    A leader without a type takes the type of the first typed member, which can
    close it to later ones; a merge only runs along a candidate pair, so the
    replay of each connected component is exact.
    """
    comp = _label_components(groups.select("id"), pairs)
    near = pairs.select(F.col("id_a").alias("id"), F.col("id_b").alias("n")).union(pairs.select("id_b", "id_a"))
    near = near.groupBy("id").agg(F.collect_set("n").alias("near"))
    rows = groups.select("id", "entity_type", "first_ord", F.length("normalized_name").alias("len")).join(comp, "id").join(near, "id")
    alone = groups.select("id").join(near.select("id"), "id", "left_anti").select("id", F.col("id").alias("leader"))

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["len", "first_ord"], ascending=[False, True], kind="stable")
        leaders: list[list] = []
        out = []
        for r in pdf.itertuples():
            mine = set(r.near)
            hit = next((x for x in leaders if x[0] in mine and (x[1] == r.entity_type or "NOUN_PHRASE" in (x[1], r.entity_type))), None)
            if hit is None:
                leaders.append([r.id, r.entity_type])
                out.append((r.id, r.id))
            else:
                if hit[1] == "NOUN_PHRASE":
                    hit[1] = r.entity_type
                out.append((r.id, hit[0]))
        return pd.DataFrame(out, columns=["id", "leader"])

    return rows.groupBy("component").applyInPandas(replay, "id string, leader string").union(alone)


def merge_clusters(members: DataFrame, cluster: str, order: list[str]) -> DataFrame:
    """One record per cluster of records, taken in ``order`` (the first is the target the others are merged into).

    members: name, normalized_name, entity_type, mentions, alternative_names, documents, pages, sentences.  The longest name wins, the
    first of equals; an untyped target takes the first type that is not NOUN_PHRASE; lists are united in order; names that
    did not win become alternatives (as does the winner, if it came later than the target), and the id follows normal form and type of the target.
    """
    place = F.struct(*order)
    m = members.withColumn("_o", place).withColumn("_name", F.coalesce("name", F.lit("")))
    typed = F.when(F.col("entity_type") != "NOUN_PHRASE", F.col("entity_type"))
    out = m.groupBy(cluster).agg(
        F.min_by("normalized_name", "_o").alias("normalized_name"), F.min_by("_name", "_o").alias("_first"), F.max(F.length("_name")).alias("_len"),
        F.min_by("entity_type", "_o").alias("_type"), F.min_by(typed, F.when(typed.isNotNull(), F.col("_o"))).alias("_typed"), F.count("*").alias("records"),
    )
    longest = m.select(cluster, "_name", "_o", F.length("_name").alias("_len")).join(out.select(cluster, "_len"), [cluster, "_len"])
    out = out.join(longest.groupBy(cluster).agg(F.min_by("_name", "_o").alias("name")), cluster)
    out = out.withColumn("entity_type", F.when(F.col("_type") == "NOUN_PHRASE", F.coalesce("_typed", "_type")).otherwise(F.col("_type")))
    # One long table of all list values, aggregated once: (cluster, field, value) with its first place.
    empty = F.array().cast("array<string>")
    text = lambda c: F.coalesce(F.col(c).cast("array<string>"), empty)
    lists = F.array(*(
        F.struct(F.lit(f).alias("f"), c.alias("v")) for f, c in
        (("mentions", text("mentions")), ("documents", text("documents")), ("pages", text("pages")), ("sentences", text("sentences")),
         ("alternative_names", F.concat(F.array("_name"), text("alternative_names"))))
    ))
    long = m.select(cluster, "_o", F.explode(lists).alias("l")).select(cluster, "_o", "l.f", F.posexplode("l.v").alias("_p", "v"))
    long = long.filter(F.col("v").isNotNull() & ~((F.col("f") == "sentences") & (F.col("v") == ""))).groupBy(cluster, "f", "v").agg(F.min(F.struct("_o", "_p")).alias("_at"))
    ends = out.select(cluster, "_first", "name")
    long = long.join(ends, cluster).filter((F.col("f") != "alternative_names") | (F.col("v") != F.col("_first")) | (F.col("name") != F.col("_first")))
    in_order = lambda f: F.transform(F.array_sort(F.collect_list(F.when(F.col("f") == f, F.struct("_at", "v")))), lambda x: x["v"])
    names = ("mentions", "alternative_names", "documents", "pages", "sentences")
    united = long.groupBy(cluster).agg(*(in_order(f).alias(f) for f in names)).withColumn("pages", F.col("pages").cast("array<int>"))
    out = out.drop("_first", "_len", "_type", "_typed").join(united, cluster, "left")
    return out.withColumn("id", X.entity_id(F.col("entity_type"), F.col("normalized_name")))


def mention_index(entities: DataFrame) -> DataFrame:
    """key, id: what an endpoint text may be looked up by.

    entities: id, normalized_name, alternative_names, mentions, pos (list position).  A normal form wins over an alias and
    the last entity of it wins; of aliases and identifier codes the first entity wins.
    """
    empty = F.array().cast("array<string>")
    alt = entities.select("id", "pos", F.explode(F.concat(F.coalesce("alternative_names", empty), F.coalesce("mentions", empty))).alias("alt")).filter(F.col("alt").isNotNull() & (F.col("alt") != ""))
    keys = F.array_distinct(F.concat(F.array(X.normalize_name(F.col("alt")), F.lower(X.strip(F.col("alt")))), F.transform(X.id_codes(F.col("alt")), lambda c: F.lower(c))))
    rows = entities.select(F.col("normalized_name").alias("key"), "id", F.lit(1).alias("own"), F.col("pos").alias("rank")).union(
        alt.select(F.explode(keys).alias("key"), "id", F.lit(0).alias("own"), (-F.col("pos")).alias("rank"))
    )
    return rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.max_by("id", F.struct("own", "rank", "id")).alias("id"))


def link_relations(relations: DataFrame, index: DataFrame) -> DataFrame:
    """Relations with subject_id and object_id looked up by the normal form of their endpoint texts (null when unknown)."""
    out = relations.drop("subject_id", "object_id")
    for side in ("subject", "object"):
        idx = index.select(F.col("key").alias(f"_{side}"), F.col("id").alias(f"{side}_id"))
        out = out.withColumn(f"_{side}", X.normalize_name(F.col(f"{side}_text"))).join(idx, f"_{side}", "left").drop(f"_{side}")
    return out


def endpoint_places(linked: DataFrame, entities: DataFrame) -> DataFrame:
    """id, document, page of entities that an unlinked endpoint matches by normal form: the first entity of it gets the place of the relation.

    entities: id, normalized_name, pos (list position).
    """
    first = entities.groupBy("normalized_name").agg(F.min_by("id", "pos").alias("id"))
    ends = linked.filter("subject_id is null").select("subject_text", "document", "page_number").union(linked.filter("object_id is null").select("object_text", "document", "page_number"))
    ends = ends.toDF("text", "document", "page").withColumn("normalized_name", X.normalize_name(F.col("text"))).filter("normalized_name <> ''")
    return ends.join(first, "normalized_name").select("id", "document", "page").distinct()


def placeholders(linked: DataFrame, entities: DataFrame, max_chars: int = 80) -> DataFrame:
    """normalized_name, id, name: new untyped nodes for unlinked endpoints, the first text in relation order giving the name."""
    ends = linked.filter("subject_id is null").select("ord", F.lit(0).alias("side"), F.col("subject_text").alias("text")).union(
        linked.filter("object_id is null").select("ord", F.lit(1).alias("side"), F.col("object_text").alias("text"))
    )
    ends = ends.withColumn("normalized_name", X.normalize_name(F.col("text")))
    usable = (F.col("normalized_name") != "") & (F.length(X.strip(F.col("text"))) <= max_chars) & ~F.regexp_replace("normalized_name", " ", "").rlike("^[0-9]+$")
    new = ends.filter(usable).join(entities.select("normalized_name").distinct(), "normalized_name", "left_anti")
    first = new.groupBy("normalized_name").agg(F.min_by("text", F.struct("ord", "side")).alias("name"))
    return first.select("normalized_name", X.entity_id(F.lit("NOUN_PHRASE"), F.col("normalized_name")).alias("id"), "name")
