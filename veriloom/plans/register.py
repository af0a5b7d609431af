"""The core queries over the project's tables, each with the statement it is checked against.

Importing this module registers them.  All run over whole tables; a limit is
kept only where it is the feature (top-k lists and capped reads), always after
a total order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions import text as X
from veriloom.functions import vocab as V
from veriloom.operators import events as EV
from veriloom.operators import graph as G
from veriloom.operators import metrics as M
from veriloom.operators import pages as P
from veriloom.operators import resolution as R
from veriloom.operators import retrieval as T
from veriloom.operators import triples as TR
from veriloom.operators import validation as VA
from veriloom.plans import duck as D
from veriloom.plans.catalog import query
from veriloom.session import side_by_side
from veriloom.sources import store as ST
from veriloom.sources import tables as S
from veriloom.sources.exports import relation_rows

QUESTION = "Who leased warehouses from Samuel Chalgerimark for spare parts?"
HUB_NAME = "samuel chalgerimark"
DOC = "consolidated_register.pdf"

# ---- SQL prelude ---------------------------------------------------------------------------------------------------------

REL = """rel AS (
  SELECT ord, subject_text, predicate, object_text, relation_type, sentence, document, page_number, extraction_method, review_status, negated, confidence,
    event_date, subject_id, object_id FROM relations WHERE ord IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY ord ORDER BY ingested_at DESC NULLS LAST, confidence DESC NULLS LAST, document DESC NULLS LAST) = 1)"""
MEN = "men AS (SELECT DISTINCT ON (ord) * FROM mentions WHERE ord IS NOT NULL)"
SEG = "seg AS (SELECT DISTINCT ON (seg_id) * FROM segments WHERE seg_id IS NOT NULL)"
ENT = "ent AS (SELECT DISTINCT ON (rec_id) * FROM entities WHERE rec_id IS NOT NULL AND id IS NOT NULL)"
STRIP = D.strip("coalesce({}, '')").format
GOODCONF = "CASE WHEN isnan(confidence) THEN NULL ELSE confidence END"
HALF = "coalesce(CASE WHEN isnan(confidence) OR confidence = 0 THEN NULL ELSE confidence END, 0.5)"
GROUPS = f"""{MEN},
grp AS (
  SELECT {D.canon('text', 'normalized_name')} AS normalized_name, coalesce(entity_type, 'NOUN_PHRASE') AS entity_type, min(ord) AS first_ord, count(*) AS n_mentions,
    first(text ORDER BY length(text) DESC NULLS LAST, ord) AS name FROM men GROUP BY 1, 2),
grpid AS (SELECT *, 'entity_' || substr(sha256(entity_type || '||' || normalized_name), 1, 12) AS id FROM grp)"""
SANITIZE = (
    "CASE WHEN {0} = '' THEN 'RELATED_TO' WHEN regexp_matches({0}, '^[A-Z]') THEN {0} ELSE 'REL_' || {0} END"
).format("trim(regexp_replace(upper(coalesce(relation_type, '')), '[^A-Za-z0-9_]+', '_', 'g'), '_')")
EDGES = f"""{REL},
lr AS (SELECT subject_id AS sid, {SANITIZE} AS type, object_id AS oid, coalesce(predicate, '') AS predicate, coalesce(negated, false) AS negated, sentence, document,
    page_number, extraction_method, event_date, ord, {GOODCONF} AS confidence FROM rel WHERE subject_id IS NOT NULL AND object_id IS NOT NULL),
edge AS (
  SELECT sid, type, oid, predicate, negated, arg_min(coalesce(document, chr(0)), ord) AS doc0, max(confidence) AS confidence, min(ord) AS edge_id, count(*) AS told,
    list_distinct(list(document) FILTER (document IS NOT NULL)) AS docs, count(DISTINCT sentence) AS n_evidence, count(DISTINCT page_number) AS n_pages,
    list(DISTINCT sentence) FILTER (sentence IS NOT NULL) AS evidence FROM lr GROUP BY 1, 2, 3, 4, 5),
edges AS (SELECT * EXCLUDE (doc0), nullif(doc0, chr(0)) AS source_document FROM edge)"""
NODES = f"{ENT}, nodes AS (SELECT id, arg_min(coalesce(name, chr(0)), rec_id) AS name0, arg_min(coalesce(entity_type, chr(0)), rec_id) AS type0 FROM ent GROUP BY id), node AS (SELECT id, nullif(name0, chr(0)) AS name, nullif(type0, chr(0)) AS entity_type FROM nodes)"
NAMED = f"""{EDGES}, {NODES},
named AS (SELECT e.* EXCLUDE (confidence), coalesce(e.confidence, 0.5) AS confidence, a.name AS subject, b.name AS object FROM edges e JOIN node a ON a.id = e.sid JOIN node b ON b.id = e.oid)"""
HUB = f"hub AS (SELECT min(id) AS hub FROM entities WHERE normalized_name = '{HUB_NAME}')"
CONTAINS = "con AS (SELECT DISTINCT unnest(documents) AS document, id AS entity_id FROM ent), contains AS (SELECT * FROM con WHERE document IS NOT NULL)"


def evs(rel: str) -> str:
    kind = f"coalesce(nullif(lower(regexp_extract({STRIP('predicate')}, '^[^ ]+')), ''), 'event')"
    return f"""ev AS (SELECT *, {kind} AS event_type FROM {rel} WHERE coalesce(event_date, '') <> '' AND subject_id IS NOT NULL AND object_id IS NOT NULL AND {HALF} >= 0.6),
  evid AS (SELECT *, 'event_' || substr(sha1(event_type || '||' || event_date || '||' || coalesce(subject_text, '') || '||' || coalesce(object_text, '')), 1, 12) AS eid FROM ev)"""


def rel(spark: SparkSession, d: str) -> DataFrame:
    return S.current_relations(spark, d)


def ent(spark: SparkSession, d: str) -> DataFrame:
    return S.current_entities(spark, d)


def graph(spark: SparkSession, d: str) -> G.Graph:
    return G.build_graph(ent(spark, d), rel(spark, d))


def hub(spark: SparkSession, d: str) -> str:
    """The entity the single-entity reads are asked about."""
    row = S.table(spark, d, "entities").filter(F.col("normalized_name") == HUB_NAME).agg(F.min("id")).first()
    return row[0] or ""


def joined(c, sort: bool = True):
    a = F.coalesce(c, F.array().cast("array<string>"))
    return F.array_join(F.array_sort(a) if sort else a, "|")


# ---- pages -----------------------------------------------------------------------------------------------------------------

@query("segments_profile", f"WITH {SEG} SELECT seg_id, length({STRIP('text')}) AS n_chars, length({STRIP('text')}) = 0 AS blank FROM seg")
def segments_profile(spark: SparkSession, d: str) -> DataFrame:
    p = S.with_page_columns(S.current_segments(spark, d).select("seg_id", "text"))
    return p.select("seg_id", F.col("char_count").cast("long").alias("n_chars"), F.col("is_empty").alias("blank"))


LINES = f"""{SEG}, ln AS (SELECT seg_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\n|\\r')) AS line, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\n|\\r'), 1) AS no FROM seg),
lnn AS (SELECT *, lower({D.clean_display('line')}) AS norm FROM ln), rep AS (SELECT norm AS line, count(*) AS n FROM lnn WHERE length(norm) >= 20 GROUP BY 1 HAVING count(*) >= 3)"""


@query("boilerplate_lines", f"WITH {LINES} SELECT line, n FROM rep")
def boilerplate_lines(spark: SparkSession, d: str) -> DataFrame:
    return P.repeated_lines(S.current_segments(spark, d))


@query(
    "boilerplate_strip",
    f"""WITH {LINES}, k AS (SELECT seg_id, count(*) AS kept, string_agg(line, chr(10) ORDER BY no) AS text FROM lnn WHERE norm NOT IN (SELECT line FROM rep) GROUP BY seg_id)
SELECT seg.seg_id, coalesce(kept, 0) AS kept, length({STRIP('k.text')}) AS char_count, md5(coalesce(k.text, '')) AS text_md5 FROM seg LEFT JOIN k USING (seg_id)""",
)
def boilerplate_strip(spark: SparkSession, d: str) -> DataFrame:
    return P.strip_boilerplate(S.current_segments(spark, d)).select("seg_id", "kept", "char_count", F.md5("text").alias("text_md5"))


@query("ocr_flag", f"WITH {SEG} SELECT document, count(*) AS pages, sum(length({STRIP('text')}))::BIGINT AS chars, sum(length({STRIP('text')})) < 50 AS needs_ocr FROM seg GROUP BY document")
def ocr_flag(spark: SparkSession, d: str) -> DataFrame:
    return P.needs_ocr(S.current_segments(spark, d)).select("document", "pages", F.col("chars").cast("long").alias("chars"), "needs_ocr")


@query("corpus_unreadable", "SELECT document, num_pages, error FROM (SELECT DISTINCT ON (document) * FROM pdf_results) WHERE error IS NOT NULL")
def corpus_unreadable(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "pdf_results").dropDuplicates(["document"]).filter("error is not null").select("document", "num_pages", "error")


# ---- scalar functions ------------------------------------------------------------------------------------------------------

@query("normalize_names", f"WITH {MEN} SELECT ord, {D.name('text')} AS norm, {D.canon('text', 'normalized_name')} AS canon FROM men")
def normalize_names(spark: SparkSession, d: str) -> DataFrame:
    m = S.current_mentions(spark, d)
    return m.select("ord", X.normalize_name(F.col("text")).alias("norm"), X.canon(F.col("text"), F.col("normalized_name")).alias("canon"))


@query(
    "relation_type_norm",
    f"WITH {REL} SELECT ord, coalesce(nullif(upper(trim(regexp_replace(lower(coalesce(predicate, '')), '[^a-z0-9]+', '_', 'g'), '_')), ''), 'RELATED_TO') AS relation FROM rel",
)
def relation_type_norm(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d).select("ord", X.normalize_relation(F.col("predicate")).alias("relation"))


@query("rel_type_sanitize", f"WITH {REL} SELECT DISTINCT predicate AS relation_type_in, {SANITIZE.replace('relation_type', 'predicate')} AS rel_type FROM rel")
def rel_type_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d).select(F.col("predicate").alias("relation_type_in"), X.sanitize_rel_type(F.col("predicate")).alias("rel_type")).distinct()


def _end_score(c: str) -> str:
    t = STRIP(c)
    return (
        f"(CASE WHEN substr({t}, 1, 1) <> lower(substr({t}, 1, 1)) AND length({t}) >= 3 THEN 5 ELSE 0 END"
        f" - CASE WHEN len(regexp_split_to_array({t}, '[' || {D.SPACES} || ']+')) > 6 THEN 10 ELSE 0 END)"
    )


@query(
    "relation_score",
    f"WITH {REL} SELECT ord, greatest(0, least(100, CASE WHEN regexp_matches(coalesce(predicate, ''), ' by$') THEN 80 WHEN contains(coalesce(predicate, ''), ' ') THEN 70 ELSE 75 END + {_end_score('subject_text')} + {_end_score('object_text')}))::BIGINT AS hundredths FROM rel",
)
def relation_score(spark: SparkSession, d: str) -> DataFrame:
    p = F.coalesce("predicate", F.lit(""))
    s = X.score_hundredths(F.col("subject_text"), F.col("object_text"), F.contains(p, F.lit(" ")), p.rlike(" by$"))
    return rel(spark, d).select("ord", s.cast("long").alias("hundredths"))


_RSTOP = "[" + ", ".join(D.lit(w) for w in V.RESOLVER_STOPWORDS) + "]"
_QSTOP = "[" + ", ".join(D.lit(w) for w in V.QUESTION_STOPWORDS) + "]"


@query("content_tokens", f"WITH {MEN} SELECT ord, array_to_string(list_sort(list_distinct(list_filter({D.words('text')}, lambda t: NOT list_contains({_RSTOP}, t)))), '|') AS tokens FROM men")
def content_tokens(spark: SparkSession, d: str) -> DataFrame:
    return S.current_mentions(spark, d).select("ord", joined(X.content_tokens(F.col("text"))).alias("tokens"))


@query(
    "question_tokens",
    f"WITH {REL} SELECT ord, array_to_string(list_sort(list_distinct(list_filter({D.words('sentence')}, lambda t: NOT list_contains({_QSTOP}, t) AND length(t) > 1))), '|') AS tokens FROM rel",
)
def question_tokens(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d).select("ord", joined(X.question_tokens(F.col("sentence"))).alias("tokens"))


@query("generic_phrase_filter", f"WITH {MEN} SELECT ord, text FROM men WHERE " + " AND ".join(f"NOT contains(lower(coalesce(text, '')), {D.lit(g)})" for g in V.GENERIC_PHRASES))
def generic_phrase_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.current_mentions(spark, d).filter(~X.is_generic(F.col("text"))).select("ord", "text")


@query(
    "mention_filter",
    f"WITH {MEN} SELECT ord, {D.clean_display('text')} AS shown FROM men WHERE coalesce(entity_type, 'NOUN_PHRASE') NOT IN ({', '.join(map(D.lit, V.DROPPED_TYPES))}) AND length({D.clean_display('text')}) BETWEEN 2 AND 80",
)
def mention_filter(spark: SparkSession, d: str) -> DataFrame:
    m = S.current_mentions(spark, d).select("ord", "entity_type", X.clean_display(F.col("text")).alias("shown"))
    return m.filter(~F.coalesce("entity_type", F.lit("NOUN_PHRASE")).isin(V.DROPPED_TYPES) & F.length("shown").between(2, 80)).select("ord", "shown")


_ESTOP = "[" + ", ".join(D.lit(w) for w in V.ENDPOINT_STOPWORDS) + "]"


def _endpoint_sql(c: str) -> str:
    t = STRIP(c)
    alpha = f"regexp_extract_all(lower({t}), '[a-z]+')"
    return (
        f"(length({t}) BETWEEN 2 AND 80 AND NOT regexp_matches(regexp_replace({t}, '[ ,.;]', '', 'g'), '^[0-9]+$')"
        f" AND NOT (len({alpha}) > 0 AND len(list_filter({alpha}, lambda w: NOT list_contains({_ESTOP}, w))) = 0))"
    )


@query("endpoint_valid", f"WITH {REL} SELECT ord, {_endpoint_sql('subject_text')} AS subject_ok, {_endpoint_sql('object_text')} AS object_ok FROM rel")
def endpoint_valid(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d).select("ord", X.valid_endpoint(F.col("subject_text")).alias("subject_ok"), X.valid_endpoint(F.col("object_text")).alias("object_ok"))


def _amount_sql(c: str) -> str:
    t = STRIP(c)
    dense = f"regexp_replace({t}, '[' || {D.SPACES} || ']', '', 'g')"
    return (
        f"(regexp_matches({t}, '[0-9]') AND (regexp_matches({t}, '(?i)INR|USD|EUR|GBP|Rs([^A-Za-z0-9_]|$)|[₹$€£]') OR "
        f"length(regexp_replace({dense}, '[^0-9,.%/-]', '', 'g')) >= 0.4::DOUBLE * length({dense})))"
    )


@query("amount_like", f"WITH {REL} SELECT ord, {_amount_sql('sentence')} AS in_sentence, {_amount_sql('event_date')} AS in_date FROM rel")
def amount_like(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d).select("ord", X.amount_like(F.col("sentence")).alias("in_sentence"), X.amount_like(F.col("event_date")).alias("in_date"))


@query(
    "copula_filter",
    f"WITH {REL} SELECT ord FROM rel WHERE lower(coalesce(predicate, '')) NOT IN ({', '.join(map(D.lit, V.DROPPED_PREDICATES))}) OR (lower(predicate) = 'be' AND {_amount_sql('object_text')})",
)
def copula_filter(spark: SparkSession, d: str) -> DataFrame:
    verb = F.lower(F.coalesce("predicate", F.lit("")))
    return rel(spark, d).filter(~verb.isin(V.DROPPED_PREDICATES) | ((verb == "be") & X.amount_like(F.col("object_text")))).select("ord")


@query(
    "id_codes",
    f"""WITH {REL} SELECT ord, coalesce(array_to_string(list_transform(regexp_extract_all(coalesce(sentence, ''), '(?:^|[^A-Za-z0-9_])([A-Z]{{2,}}[-/]?[0-9][A-Za-z0-9_-]*)', 1), lambda c: regexp_replace(c, '-+$', '')), '|'), '') AS codes FROM rel""",
)
def id_codes(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d).select("ord", F.array_join(X.id_codes(F.col("sentence")), "|").alias("codes"))


_DATE_SQL = "nullif(regexp_extract(coalesce(sentence, ''), '(?i)(^|[^A-Za-z0-9_])([0-9]{1,2}[ \\t\\n]+(?:" + "|".join(V.MONTHS) + ")[ \\t\\n]+[0-9]{4})([^A-Za-z0-9_]|$)', 2), '')"


@query("evidence_date", f"WITH {REL} SELECT ord, coalesce(nullif(event_date, ''), {_DATE_SQL}) AS event_date FROM rel")
def evidence_date(spark: SparkSession, d: str) -> DataFrame:
    return VA.attach_dates(rel(spark, d)).select("ord", "event_date")


_DATED = "dm AS (SELECT sentence, ord, nullif(regexp_extract(coalesce(text, ''), '(?i)(^|[^A-Za-z0-9_])([0-9]{1,2}[ \\t\\n]+(?:" + "|".join(V.MONTHS) + ")[ \\t\\n]+[0-9]{4})([^A-Za-z0-9_]|$)', 2), '') AS date FROM men WHERE sentence IS NOT NULL), dd1 AS (SELECT sentence, arg_min(date, ord) AS date FROM dm WHERE date IS NOT NULL GROUP BY 1)"


@query("evidence_date_of_mentions", f"WITH {REL}, {MEN.replace('SELECT DISTINCT ON (ord) *', 'SELECT DISTINCT ON (ord) ord, sentence, sentence AS text')}, {_DATED} SELECT rel.ord, coalesce(nullif(event_date, ''), dd1.date, {_DATE_SQL.replace('sentence', 'rel.sentence')}) AS event_date FROM rel LEFT JOIN dd1 ON dd1.sentence = rel.sentence")
def evidence_date_of_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Dates that mentions of the same sentence carry (here: found in their sentence) come before the pattern."""
    m = S.current_mentions(spark, d).filter("sentence is not null").select("sentence", "ord", X.first_date(F.col("sentence")).alias("date")).filter("date is not null")
    return VA.attach_dates(rel(spark, d), m).select("ord", "event_date")


@query(
    "subject_with_code",
    f"""WITH {REL}, c AS (SELECT ord, subject_text AS s, nullif(regexp_replace(list_extract(regexp_extract_all(coalesce(sentence, ''), '(?:^|[^A-Za-z0-9_])([A-Z]{{2,}}[-/]?[0-9][A-Za-z0-9_-]*)', 1), -1), '-+$', ''), '') AS code FROM rel)
SELECT ord, CASE WHEN code IS NOT NULL AND NOT contains(s, '(') AND NOT contains(lower(s), lower(code)) THEN s || ' (' || code || ')' ELSE s END AS subject FROM c""",
)
def subject_with_code(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d).select("ord", TR.with_code(F.col("subject_text"), F.lit("be"), F.array("sentence")).alias("subject"))


@query("entity_like", f"WITH {REL} SELECT ord, (regexp_matches(coalesce(sentence, ''), '(^|[^A-Za-z0-9_])[A-Z]{{2,}}[-/]?[0-9]') OR regexp_matches(coalesce(sentence, ''), '[\"''][^\"'']+[\"'']')) AS named FROM rel")
def entity_like(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d).select("ord", X.entity_like(F.col("sentence")).alias("named"))


@query("either_name", f"WITH {REL} SELECT ord, coalesce(nullif(subject_id, ''), nullif(subject_text, '')) AS subject, coalesce(nullif(object_id, ''), nullif(object_text, '')) AS object FROM rel")
def either_name(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d).select("ord", X.either("subject_id", "subject_text").alias("subject"), X.either("object_id", "object_text").alias("object"))


@query("entity_ids", f"WITH {GROUPS} SELECT id, entity_type, normalized_name FROM grpid")
def entity_ids(spark: SparkSession, d: str) -> DataFrame:
    return R.canonical_groups(S.current_mentions(spark, d)).select("id", "entity_type", "normalized_name")


@query("event_ids", f"WITH {REL}, {evs('rel')} SELECT ord, eid FROM evid")
def event_ids(spark: SparkSession, d: str) -> DataFrame:
    return EV.build_events(rel(spark, d)).select("ord", F.col("id").alias("eid"))


@query(
    "point_ids",
    f"""WITH {REL}, h AS (SELECT ord, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(document || '||' || sentence || '||' || predicate)) AS h FROM rel
  WHERE document IS NOT NULL AND predicate IS NOT NULL AND {STRIP('sentence')} <> '')
SELECT ord, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4)::INT + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""",
)
def point_ids(spark: SparkSession, d: str) -> DataFrame:
    r = rel(spark, d).filter(F.col("document").isNotNull() & F.col("predicate").isNotNull() & (X.strip(F.coalesce("sentence", F.lit(""))) != ""))
    return r.select("ord", X.point_id(F.col("document"), F.col("sentence"), F.col("predicate")).alias("point_id"))


# ---- resolution and linking ---------------------------------------------------------------------------------------------------

@query(
    "canonical_groups",
    f"""WITH {GROUPS}, l AS (SELECT {D.canon('text', 'normalized_name')} AS nn, coalesce(entity_type, 'NOUN_PHRASE') AS et, text, document, page_number, sentence, ord FROM men),
lt AS (SELECT nn, et, string_agg(text, '|' ORDER BY o) AS texts FROM (SELECT nn, et, text, min(ord) AS o FROM l WHERE text <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2),
ld AS (SELECT nn, et, string_agg(document, '|' ORDER BY o) AS documents FROM (SELECT nn, et, document, min(ord) AS o FROM l WHERE document <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2),
n AS (SELECT nn, et, count(DISTINCT nullif(text, '')) AS n_texts, count(DISTINCT nullif(document, '')) AS n_documents, count(DISTINCT page_number) AS n_pages, count(DISTINCT nullif(sentence, '')) AS n_sentences FROM l GROUP BY 1, 2)
SELECT id, name, n_mentions, first_ord, n_texts, n_documents, n_pages, n_sentences, coalesce(texts, '') AS texts, md5(coalesce(documents, '')) AS documents
FROM grpid JOIN n ON nn = normalized_name AND et = entity_type LEFT JOIN lt USING (nn, et) LEFT JOIN ld USING (nn, et)""",
)
def canonical_groups(spark: SparkSession, d: str) -> DataFrame:
    g = R.canonical_groups(S.current_mentions(spark, d))
    size = lambda c: F.coalesce(F.size(c).cast("long"), F.lit(0))
    n = {"n_texts": "mentions", "n_documents": "documents", "n_pages": "pages", "n_sentences": "sentences"}
    return g.select(
        "id", "name", "n_mentions", "first_ord", *(F.greatest(F.lit(0), size(c)).alias(a) for a, c in n.items()),
        joined("mentions", False).alias("texts"), F.md5(joined("documents", False)).alias("documents"))


_CT = f"list_distinct(list_filter({D.words('normalized_name')}, lambda t: NOT list_contains({_RSTOP}, t)))"
_CW = f"list_filter({D.words('normalized_name')}, lambda t: NOT list_contains({_RSTOP}, t))"
_GEN = "[" + ", ".join(D.lit(w) for w in V.GENERIC_SINGLETONS) + "]"
ALIAS = f"""{GROUPS}, g AS (
  SELECT id, entity_type AS et, normalized_name AS nn, {_CT} AS t, {_CW} AS w, regexp_replace(normalized_name, '[^a-z0-9]', '', 'g') AS sq FROM grpid
  WHERE length(normalized_name) <= 60 AND len(string_split(normalized_name, ' ')) <= 6 AND len({_CT}) > 0),
gi AS (SELECT *, array_to_string(list_transform(w, lambda x: substr(x, 1, 1)), '') AS ini FROM g)"""


@query(
    "alias_pairs",
    f"""WITH {ALIAS}, p AS (
  SELECT s.id AS x, l.id AS y, 'subset' AS why FROM gi s JOIN gi l ON s.id <> l.id AND list_has_all(l.t, s.t) AND (s.et = l.et OR s.et = 'NOUN_PHRASE' OR l.et = 'NOUN_PHRASE') AND NOT (len(s.t) = 1 AND list_contains({_GEN}, s.t[1]))
  UNION ALL
  SELECT s.id, l.id, 'acronym' FROM gi s JOIN gi l ON s.id <> l.id AND length(s.sq) BETWEEN 2 AND 6 AND len(l.w) >= 2 AND starts_with(l.ini, s.sq) AND (s.et = l.et OR s.et = 'NOUN_PHRASE' OR l.et = 'NOUN_PHRASE'))
SELECT least(x, y) AS id_a, greatest(x, y) AS id_b, max(why) AS why FROM p GROUP BY 1, 2""",
)
def alias_pairs(spark: SparkSession, d: str) -> DataFrame:
    return R.alias_pairs(R.canonical_groups(S.current_mentions(spark, d)))


@query("fuzzy_pairs")
def fuzzy_pairs(spark: SparkSession, d: str) -> DataFrame:
    return R.fuzzy_pairs(R.canonical_names(S.current_mentions(spark, d)))


@query("resolved_clusters")
def resolved_clusters(spark: SparkSession, d: str) -> DataFrame:
    g = R.canonical_groups(S.current_mentions(spark, d)).select("id", "entity_type", "normalized_name", "first_ord")
    return R.greedy_clusters(g, R.alias_pairs(g))


_POS = f"{ENT}, e1 AS (SELECT id, arg_min(normalized_name, rec_id) AS normalized_name, min(rec_id) AS pos FROM ent GROUP BY id)"
_ALTS = f"""al AS (SELECT id, unnest(list_concat(coalesce(alternative_names, []), coalesce(mentions, []))) AS alt FROM ent), alt AS (SELECT DISTINCT al.id, pos, alt FROM al JOIN e1 USING (id) WHERE alt IS NOT NULL AND alt <> '')"""
INDEX = f"""{_POS}, {_ALTS}, k AS (
  SELECT normalized_name AS key, id, 1 AS own, pos AS rank FROM e1
  UNION ALL SELECT {D.name('alt')}, id, 0, -pos FROM alt
  UNION ALL SELECT lower({D.strip('alt')}), id, 0, -pos FROM alt
  UNION ALL SELECT lower(regexp_replace(c, '-+$', '')), id, 0, -pos FROM (SELECT id, pos, unnest(regexp_extract_all(alt, '(?:^|[^A-Za-z0-9_])([A-Z]{{2,}}[-/]?[0-9][A-Za-z0-9_-]*)', 1)) AS c FROM alt)),
idx AS (SELECT key, arg_max(id, (own, rank, id)) AS id FROM k WHERE key IS NOT NULL GROUP BY key)"""


def indexed_entities(spark: SparkSession, d: str, only=None) -> DataFrame:
    e = ent(spark, d) if only is None else ent(spark, d).filter(only)
    one = e.groupBy("id").agg(F.min_by("normalized_name", "rec_id").alias("normalized_name"), F.min("rec_id").alias("pos"))
    names = e.groupBy("id").agg(F.flatten(F.collect_list("alternative_names")).alias("alternative_names"), F.flatten(F.collect_list("mentions")).alias("mentions"))
    return one.join(names, "id")


@query("mention_index", f"WITH {INDEX} SELECT key, id FROM idx")
def mention_index(spark: SparkSession, d: str) -> DataFrame:
    return R.mention_index(indexed_entities(spark, d))


LINK = f"{REL}, {INDEX}, lnk AS (SELECT rel.* EXCLUDE (subject_id, object_id), a.id AS subject_id, b.id AS object_id FROM rel LEFT JOIN idx a ON a.key = {D.name('subject_text')} LEFT JOIN idx b ON b.key = {D.name('object_text')})"


def linked(spark: SparkSession, d: str) -> DataFrame:
    return R.link_relations(rel(spark, d), R.mention_index(indexed_entities(spark, d)))


@query("link_relations", f"WITH {LINK} SELECT ord, subject_id, object_id FROM lnk")
def link_relations(spark: SparkSession, d: str) -> DataFrame:
    return linked(spark, d).select("ord", "subject_id", "object_id")


PERSONS = LINK.replace("id IS NOT NULL)", "id IS NOT NULL AND entity_type = 'PERSON')", 1)


@query(
    "placeholders",
    f"""WITH {PERSONS}, u AS (SELECT ord, 0 AS side, subject_text AS text FROM lnk WHERE subject_id IS NULL UNION ALL SELECT ord, 1, object_text FROM lnk WHERE object_id IS NULL),
un AS (SELECT *, {D.name('text')} AS nn FROM u)
SELECT nn AS normalized_name, 'entity_' || substr(sha256('NOUN_PHRASE||' || nn), 1, 12) AS id, arg_min(text, (ord, side)) AS name FROM un
WHERE nn <> '' AND length({STRIP('text')}) <= 80 AND NOT regexp_matches(replace(nn, ' ', ''), '^[0-9]+$') AND nn NOT IN (SELECT normalized_name FROM e1 WHERE normalized_name IS NOT NULL) GROUP BY nn""",
)
def placeholders(spark: SparkSession, d: str) -> DataFrame:
    """Linked against the persons only, so that the other endpoints are unknown."""
    known = indexed_entities(spark, d, F.col("entity_type") == "PERSON")
    return R.placeholders(R.link_relations(rel(spark, d), R.mention_index(known)), known)


# ---- history frames -------------------------------------------------------------------------------------------------------------

HIST = f"""{REL}, hs AS (SELECT DISTINCT ON (document, page_number, sentence) document, page_number, sentence, ord FROM rel WHERE document IS NOT NULL AND {STRIP('sentence')} <> '' ORDER BY document, page_number, sentence, ord)"""


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    r = VA.with_evidence(rel(spark, d)).filter("document is not null")
    return r.groupBy("document", "page_number", "sentence").agg(F.min("ord").alias("ord"))


@query(
    "history_frame",
    f"WITH {HIST} SELECT ord, array_to_string(list(md5(sentence)) OVER (PARTITION BY document, page_number ORDER BY ord ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), '|') AS frame FROM hs",
)
def history_frame(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("document", "page_number").orderBy("ord").rowsBetween(-2, 0)
    return _sentences(spark, d).select("ord", F.array_join(F.collect_list(F.md5("sentence")).over(w), "|").alias("frame"))


_LASTCODE = "nullif(regexp_replace(list_extract(regexp_extract_all(sentence, '(?:^|[^A-Za-z0-9_])([A-Z]{2,}[-/]?[0-9][A-Za-z0-9_-]*)', 1), -1), '-+$', ''), '')"


@query(
    "nearest_code",
    f"WITH {HIST}, c AS (SELECT *, {_LASTCODE} AS code FROM hs) SELECT ord, last_value(code IGNORE NULLS) OVER (PARTITION BY document, page_number ORDER BY ord ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS code FROM c",
)
def nearest_code(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("document", "page_number").orderBy("ord").rowsBetween(-2, 0)
    code = F.try_element_at(X.id_codes(F.col("sentence")), F.lit(-1))
    return _sentences(spark, d).withColumn("c", code).select("ord", F.last("c", ignorenulls=True).over(w).alias("code"))


# ---- validation and events --------------------------------------------------------------------------------------------------------

_KEYS = f"""lower({D.strip("coalesce(nullif(subject_id, ''), subject_text, '')")}) AS k_s, lower({STRIP('predicate')}) AS k_p, lower({D.strip("coalesce(nullif(object_id, ''), object_text, '')")}) AS k_o, coalesce(negated, false) AS neg"""
DEDUP = f"""{REL}, kd AS (SELECT *, {_KEYS} FROM rel WHERE {STRIP('sentence')} <> ''),
dd AS (SELECT k_s, k_p, k_o, neg, min(ord) AS ord, max({GOODCONF}) AS confidence, count(*) AS copies FROM kd GROUP BY 1, 2, 3, 4),
ct AS (SELECT *, bool_or(neg) OVER w AND NOT bool_and(neg) OVER w AS contradicted FROM dd WINDOW w AS (PARTITION BY k_s, k_p, k_o))"""


@query("dedup_relations", f"WITH {DEDUP} SELECT ord, confidence, copies FROM dd")
def dedup_relations(spark: SparkSession, d: str) -> DataFrame:
    return VA.deduplicate(VA.with_evidence(rel(spark, d))).select("ord", "confidence", "copies")


DENIED = DEDUP.replace(f"FROM rel WHERE {STRIP('sentence')} <> '')", f"FROM (SELECT * FROM rel UNION ALL SELECT * REPLACE (-ord - 1 AS ord, NOT coalesce(negated, false) AS negated) FROM rel WHERE extraction_method IS NULL OR predicate LIKE '% %') WHERE {STRIP('sentence')} <> '')")


@query("contradictions", f"WITH {DENIED} SELECT ord, neg FROM ct WHERE contradicted")
def contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Every relation whose predicate has several words is also told the other way round, so that there is something to contradict."""
    r = rel(spark, d)
    denied = r.filter("extraction_method is null or predicate like '% %'").withColumns({"ord": -F.col("ord") - 1, "negated": ~F.coalesce("negated", F.lit(False))})
    return VA.contradictions(VA.deduplicate(VA.with_evidence(r.unionByName(denied)))).filter("contradicted").select("ord", "neg")


@query(
    "validation_report",
    f"WITH {DEDUP} SELECT (SELECT count(*) FROM rel) AS relations, (SELECT count(*) FROM rel WHERE {STRIP('sentence')} = '') AS dropped_no_evidence, count(*) AS kept, sum(copies - 1)::BIGINT AS duplicates_merged, sum(contradicted::INT)::BIGINT AS contradicted FROM ct",
)
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    return VA.report(rel(spark, d))


@query(
    "build_events",
    f"WITH {REL}, {evs('rel')} SELECT eid AS id, arg_min(event_type || ' on ' || event_date, ord) AS name, count(*) AS told, count(DISTINCT document) AS n_documents, count(DISTINCT sentence) AS n_evidence FROM evid GROUP BY 1",
)
def build_events(spark: SparkSession, d: str) -> DataFrame:
    e = EV.merge_events(EV.build_events(rel(spark, d)))
    n = lambda c: F.coalesce(F.size(F.coalesce(c, F.array().cast("array<string>"))).cast("long"), F.lit(0))
    return e.select("id", "name", "told", n("documents").alias("n_documents"), n("evidence").alias("n_evidence"))


PART = f"{evs('rel')}, part AS (SELECT DISTINCT subject_id AS entity_id, eid AS event_id, 'subject' AS role FROM evid UNION SELECT DISTINCT object_id, eid, 'object' FROM evid)"


@query(
    "events_for_entity",
    f"WITH {REL}, {PART}, {HUB}, en AS (SELECT eid, arg_min(event_type || ' on ' || event_date, ord) AS event, arg_min(event_date, ord) AS date FROM evid GROUP BY 1) SELECT event, date, role FROM part JOIN en ON en.eid = event_id, hub WHERE entity_id = hub ORDER BY date DESC, event_id, role LIMIT 25",
)
def events_for_entity(spark: SparkSession, d: str) -> DataFrame:
    return G.events_for(graph(spark, d), hub(spark, d)).select(F.col("name").alias("event"), F.col("event_date").alias("date"), "role")


# ---- graph reads --------------------------------------------------------------------------------------------------------------------

@query("all_entities", f"WITH {NODES} SELECT id, name, entity_type FROM node ORDER BY id LIMIT 1000")
def all_entities(spark: SparkSession, d: str) -> DataFrame:
    return G.all_entities(graph(spark, d))


@query("all_relationships", f"WITH {NAMED} SELECT subject, type, predicate, object, confidence, edge_id FROM named ORDER BY edge_id LIMIT 1000")
def all_relationships(spark: SparkSession, d: str) -> DataFrame:
    return G.all_relationships(graph(spark, d)).select("subject", "type", "predicate", "object", "confidence", "edge_id")


@query("weakest_relationships", f"WITH {NAMED} SELECT subject, predicate, object, confidence, edge_id FROM named ORDER BY confidence, edge_id LIMIT 50")
def weakest_relationships(spark: SparkSession, d: str) -> DataFrame:
    return G.weakest_relationships(graph(spark, d)).select("subject", "predicate", "object", "confidence", "edge_id")


@query("entity_search", f"WITH {NODES} SELECT id, name, entity_type FROM node WHERE contains(lower(name), 'hospital') ORDER BY id LIMIT 25")
def entity_search(spark: SparkSession, d: str) -> DataFrame:
    return G.search_entities(graph(spark, d), "Hospital")


@query(
    "entity_relationships",
    f"WITH {NAMED}, {HUB} SELECT edge_id, predicate, CASE WHEN sid = hub THEN subject ELSE object END AS entity, CASE WHEN sid = hub THEN object ELSE subject END AS other FROM named, hub WHERE sid = hub OR oid = hub",
)
def entity_relationships(spark: SparkSession, d: str) -> DataFrame:
    return G.incident_edges(graph(spark, d), hub(spark, d)).select("edge_id", "predicate", "entity", "other")


NEIGH = f"""{NAMED}, {HUB}, {CONTAINS}, {PART},
al AS (SELECT 'r:' || edge_id AS eid, sid AS a, oid AS b FROM edges UNION ALL SELECT 'c:' || document || ':' || entity_id, 'doc:' || document, entity_id FROM contains
  UNION ALL SELECT 'p:' || entity_id || ':' || event_id || ':' || role, entity_id, 'ev:' || event_id FROM part),
sym AS (SELECT eid, a AS x, b AS y FROM al UNION ALL SELECT eid, b, a FROM al WHERE a <> b),
pth AS (SELECT eid AS path, y AS target FROM sym, hub WHERE x = hub UNION ALL SELECT s.eid || ' ' || t.eid, t.y FROM sym s JOIN sym t ON t.x = s.y AND t.eid <> s.eid, hub WHERE s.x = hub)"""


@query("neighborhood_2hop", f"WITH {NEIGH} SELECT path, target, name AS target_name FROM pth JOIN node ON node.id = target ORDER BY path, target LIMIT 100")
def neighborhood_2hop(spark: SparkSession, d: str) -> DataFrame:
    return G.neighborhood(graph(spark, d), hub(spark, d)).select("path", "target", "target_name")


@query("document_subgraph", f"WITH {NAMED} SELECT edge_id, subject, predicate, object, confidence, n_evidence FROM named WHERE source_document = '{DOC}' OR list_contains(docs, '{DOC}')")
def document_subgraph(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.coalesce("evidence", F.array().cast("array<string>"))).cast("long")
    return G.document_subgraph(graph(spark, d), DOC).select("edge_id", "subject", "predicate", "object", "confidence", n.alias("n_evidence"))


@query(
    "list_documents",
    f"""WITH {EDGES}, {ENT}, {CONTAINS}, dp AS (SELECT document AS name, unnest(coalesce(pages, [NULL])) AS page FROM (SELECT unnest(documents) AS document, pages FROM ent) WHERE document IS NOT NULL),
dn AS (SELECT name, count(DISTINCT page) AS n_pages FROM dp GROUP BY 1), c AS (SELECT document AS name, count(*) AS entities FROM contains GROUP BY 1),
r AS (SELECT name, count(*) AS relations FROM (SELECT edge_id, unnest(docs) AS name FROM edges) GROUP BY 1),
names AS (SELECT DISTINCT document AS name FROM contains)
SELECT name, coalesce(n_pages, 0) AS n_pages, coalesce(entities, 0) AS entities, coalesce(relations, 0) AS relations FROM names LEFT JOIN dn USING (name) LEFT JOIN c USING (name) LEFT JOIN r USING (name)""",
)
def list_documents(spark: SparkSession, d: str) -> DataFrame:
    return G.list_documents(graph(spark, d))


FIRST_EDGE = "(SELECT * FROM named ORDER BY edge_id LIMIT 1)"


@query("evidence_lookup", f"WITH {NAMED}, f AS {FIRST_EDGE} SELECT e.edge_id, e.n_evidence, array_to_string(list_sort(e.docs), '|') AS documents FROM edges e, f WHERE e.sid = f.sid AND e.oid = f.oid AND e.predicate = f.predicate")
def evidence_lookup(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    f = G.named_edges(g).orderBy("edge_id").select("sid", "oid", "predicate").first()
    return G.evidence_for(g, f.sid, f.oid, f.predicate).select("edge_id", F.size("evidence").cast("long").alias("n_evidence"), joined("source_documents").alias("documents"))


@query(
    "documents_vs_disk",
    f"WITH {ENT}, {CONTAINS}, g AS (SELECT DISTINCT document AS name FROM contains), f AS (SELECT DISTINCT document AS name FROM pdf_results WHERE document IS NOT NULL) SELECT coalesce(g.name, f.name) AS name, g.name IS NOT NULL AS in_graph, f.name IS NOT NULL AS on_disk FROM g FULL JOIN f ON g.name = f.name",
)
def documents_vs_disk(spark: SparkSession, d: str) -> DataFrame:
    g = ent(spark, d).select(F.explode("documents").alias("name")).filter("name is not null").distinct().withColumn("g", F.lit(True))
    f = S.table(spark, d, "pdf_results").filter("document is not null").select(F.col("document").alias("name")).distinct().withColumn("f", F.lit(True))
    return g.join(f, "name", "full").select("name", F.col("g").isNotNull().alias("in_graph"), F.col("f").isNotNull().alias("on_disk"))


@query(
    "explore_badges",
    f"WITH {NAMED}, n AS (SELECT * FROM named ORDER BY edge_id LIMIT 500) SELECT edge_id, confidence, CASE WHEN confidence < 0.6 THEN 'low' WHEN confidence < 0.8 THEN 'medium' ELSE 'high' END AS badge FROM n",
)
def explore_badges(spark: SparkSession, d: str) -> DataFrame:
    top = G.all_relationships(graph(spark, d), 500)
    return top.select("edge_id", "confidence", M.badge(F.col("confidence")).alias("badge"))


_DOCS = "coalesce(docs, [])"


@query(
    "graph_totals",
    f"""WITH {NAMED}, {CONTAINS}, {PART} SELECT 'entities' AS what, count(*) AS n FROM node UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'events', count(DISTINCT eid) FROM evid
UNION ALL SELECT 'participates', count(*) FROM part UNION ALL SELECT 'contains', count(*) FROM contains UNION ALL SELECT 'documents', count(DISTINCT document) FROM contains""",
)
def graph_totals(spark: SparkSession, d: str) -> DataFrame:
    return G.totals(graph(spark, d))


# ---- merges and deletes ---------------------------------------------------------------------------------------------------------------

def _moved(col: str) -> str:
    return f"""(SELECT id, string_agg(v, '|' ORDER BY r, p) AS {col} FROM (
  SELECT id, v, max(r) AS r, arg_max(p, r) AS p FROM (SELECT id, rec_id AS r, v, min(p) AS p FROM (SELECT id, rec_id, unnest({col}) AS v, generate_subscripts({col}, 1) AS p FROM ent) WHERE v IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1)"""


@query(
    "merge_entities",
    f"WITH {NODES} SELECT node.id, name, entity_type, coalesce(mentions, '') AS mentions, coalesce(documents, '') AS documents FROM node LEFT JOIN {_moved('mentions')} m ON m.id = node.id LEFT JOIN {_moved('documents')} d ON d.id = node.id",
)
def merge_entities(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_entities(ent(spark, d)).select("id", "name", "entity_type", joined("mentions", False).alias("mentions"), joined("documents", False).alias("documents"))


@query("merge_documents", f"WITH {ENT}, {CONTAINS}, dp AS (SELECT document AS name, unnest(coalesce(pages, [NULL])) AS page FROM (SELECT unnest(documents) AS document, pages FROM ent) WHERE document IS NOT NULL) SELECT names.name, coalesce(string_agg(DISTINCT page::VARCHAR, '|' ORDER BY page::VARCHAR), '') AS pages FROM (SELECT DISTINCT document AS name FROM contains) names LEFT JOIN dp USING (name) GROUP BY names.name")
def merge_documents(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return g.documents.select("name", joined(F.col("pages").cast("array<string>")).alias("pages"))


@query("merge_relations", f"WITH {EDGES} SELECT edge_id, type, confidence, told, n_evidence, n_pages, len({_DOCS}) AS n_documents, source_document FROM edges")
def merge_relations(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c, t: F.size(F.coalesce(c, F.array().cast(f"array<{t}>"))).cast("long")
    return G.merge_relations(rel(spark, d)).select(
        "edge_id", "type", "confidence", "told", n("evidence", "string").alias("n_evidence"), n("pages", "int").alias("n_pages"), n("source_documents", "string").alias("n_documents"), "source_document"
    )


def halves(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """All rows in two parts by the middle of the key: what was stored first and what comes on top."""
    middle = df.agg(((F.min(key) + F.max(key)) / 2).cast("long").alias("m")).first().m or 0
    return df.filter(F.col(key) <= middle), df.filter(F.col(key) > middle)


@query(
    "upsert_entities",
    f"WITH {NODES} SELECT node.id, name, entity_type, coalesce(mentions, '') AS mentions, coalesce(documents, '') AS documents FROM node LEFT JOIN {_moved('mentions')} m ON m.id = node.id LEFT JOIN {_moved('documents')} d ON d.id = node.id",
)
def upsert_entities(spark: SparkSession, d: str) -> DataFrame:
    old, new = halves(ent(spark, d), "rec_id")
    out = G.upsert_entities(G.merge_entities(old), G.merge_entities(new))
    return out.select("id", "name", "entity_type", joined("mentions", False).alias("mentions"), joined("documents", False).alias("documents"))


@query("upsert_relations", f"WITH {EDGES} SELECT edge_id, type, confidence, told, n_evidence, n_pages, len({_DOCS}) AS n_documents, source_document FROM edges")
def upsert_relations(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c, t: F.size(F.coalesce(c, F.array().cast(f"array<{t}>"))).cast("long")
    old, new = halves(rel(spark, d), "ord")
    out = G.merge_edges(G.merge_relations(old), G.merge_relations(new))
    return out.select("edge_id", "type", "confidence", "told", n("evidence", "string").alias("n_evidence"), n("pages", "int").alias("n_pages"), n("source_documents", "string").alias("n_documents"), "source_document")


@query(
    "upsert_events",
    f"WITH {REL}, {evs('rel')} SELECT eid AS id, arg_min(event_type || ' on ' || event_date, ord) AS name, count(*) AS told, count(DISTINCT document) AS n_documents, count(DISTINCT sentence) AS n_evidence FROM evid GROUP BY 1",
)
def upsert_events(spark: SparkSession, d: str) -> DataFrame:
    old, new = (EV.merge_events(EV.build_events(x)) for x in halves(rel(spark, d), "ord"))
    n = lambda c: F.coalesce(F.size(F.coalesce(c, F.array().cast("array<string>"))).cast("long"), F.lit(0))
    return G.upsert_events(old, new).select("id", "name", "told", n("documents").alias("n_documents"), n("evidence").alias("n_evidence"))


@query(
    "merged_records",
    f"""WITH {ENT}, n AS (SELECT id, first(coalesce(name, '') ORDER BY length(coalesce(name, '')) DESC, rec_id) AS name, arg_min(coalesce(entity_type, chr(0)), rec_id) AS t0,
  arg_min(entity_type, rec_id) FILTER (WHERE entity_type <> 'NOUN_PHRASE') AS t1, count(*) AS records FROM ent GROUP BY id),
l AS (SELECT id, rec_id, 'm' AS f, unnest(mentions) AS v, generate_subscripts(mentions, 1) AS p FROM ent UNION ALL SELECT id, rec_id, 'd', unnest(documents), generate_subscripts(documents, 1) FROM ent),
u AS (SELECT id, f, v, min((rec_id, p)) AS place FROM l WHERE v IS NOT NULL GROUP BY 1, 2, 3),
j AS (SELECT id, string_agg(v, '|' ORDER BY place) FILTER (WHERE f = 'm') AS mentions, string_agg(v, '|' ORDER BY place) FILTER (WHERE f = 'd') AS documents FROM u GROUP BY 1)
SELECT n.id, name, CASE WHEN t0 = 'NOUN_PHRASE' THEN coalesce(t1, t0) ELSE nullif(t0, chr(0)) END AS entity_type, records, coalesce(mentions, '') AS mentions, coalesce(documents, '') AS documents FROM n LEFT JOIN j ON j.id = n.id""",
)
def merged_records(spark: SparkSession, d: str) -> DataFrame:
    """The records of an id merged as a cluster: longest name, first real type, lists united in order."""
    e = ent(spark, d).withColumnRenamed("id", "cluster")
    out = R.merge_clusters(e, "cluster", ["rec_id"])
    return out.select(F.col("cluster").alias("id"), "name", "entity_type", "records", joined("mentions", False).alias("mentions"), joined("documents", False).alias("documents"))


@query("document_exists", f"WITH {ENT}, {CONTAINS} SELECT count(DISTINCT document) AS n FROM contains WHERE document = '{DOC}'")
def document_exists(spark: SparkSession, d: str) -> DataFrame:
    return G.document_exists(graph(spark, d), DOC)


@query("points_after_delete", f"SELECT id FROM (SELECT DISTINCT ON (id) id, payload FROM kg_evidence WHERE id IS NOT NULL) WHERE payload.document IS DISTINCT FROM '{DOC}'")
def points_after_delete(spark: SparkSession, d: str) -> DataFrame:
    stored = S.table(spark, d, "kg_evidence").filter("id is not null").dropDuplicates(["id"])
    return ST.without_document(stored, DOC).select("id")


@query("contains_links", f"WITH {ENT}, {CONTAINS} SELECT document, entity_id FROM contains")
def contains_links(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).contains


@query("participation_links", f"WITH {REL}, {PART} SELECT entity_id, event_id, role FROM part")
def participation_links(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).participates.select("entity_id", "event_id", "role")


DEL = f"""{NAMED}, {CONTAINS}, {PART},
m AS (SELECT *, list_contains({_DOCS}, '{DOC}') AS mine, list_filter({_DOCS}, lambda x: x <> '{DOC}') AS rest FROM edges),
kept AS (SELECT * FROM m WHERE NOT (mine AND len(rest) = 0)),
edoc AS (SELECT id, list_filter(list_distinct(flatten(list(coalesce(documents, [])))), lambda x: x IS NOT NULL) AS docs FROM ent GROUP BY id),
ends AS (SELECT sid AS id FROM kept UNION SELECT oid FROM kept UNION SELECT entity_id FROM contains WHERE document <> '{DOC}' UNION SELECT entity_id FROM part),
orph AS (SELECT id FROM edoc WHERE len(list_filter(docs, lambda x: x <> '{DOC}')) = 0 AND id NOT IN (SELECT id FROM ends)),
evd AS (SELECT eid, list_filter(list_distinct(list(document)), lambda x: x IS NOT NULL) AS docs FROM evid GROUP BY eid)"""


@query(
    "delete_document",
    f"""WITH {DEL} SELECT 'relations_deleted' AS what, count(*) AS n FROM m WHERE mine AND len(rest) = 0 UNION ALL SELECT 'relations_scrubbed', 2 * count(*) FROM kept WHERE mine
UNION ALL SELECT 'documents_deleted', count(DISTINCT document) FROM contains WHERE document = '{DOC}' UNION ALL SELECT 'entities_scrubbed', count(*) FROM edoc WHERE list_contains(docs, '{DOC}')
UNION ALL SELECT 'orphan_entities_deleted', count(*) FROM orph UNION ALL SELECT 'events_scrubbed', count(*) FROM evd WHERE list_contains(docs, '{DOC}')
UNION ALL SELECT 'orphan_events_deleted', count(*) FROM evd WHERE len(list_filter(docs, lambda x: x <> '{DOC}')) = 0""",
)
def delete_document(spark: SparkSession, d: str) -> DataFrame:
    return G.delete_document(graph(spark, d), DOC)[1]


@query("edges_after_delete", f"WITH {DEL} SELECT edge_id, len(rest) AS n_documents FROM kept")
def edges_after_delete(spark: SparkSession, d: str) -> DataFrame:
    left = G.delete_document(graph(spark, d), DOC)[0].edges
    return left.select("edge_id", F.size(F.coalesce("source_documents", F.array().cast("array<string>"))).cast("long").alias("n_documents"))


@query("unique_ids", f"WITH {ENT} SELECT id, count(*) AS n FROM ent GROUP BY id HAVING count(*) > 1")
def unique_ids(spark: SparkSession, d: str) -> DataFrame:
    return G.duplicated_ids(ent(spark, d), "id")


# ---- retrieval ---------------------------------------------------------------------------------------------------------------------------

_QT = f"list_distinct(list_filter({D.words(D.lit(QUESTION))}, lambda t: NOT list_contains({_QSTOP}, t) AND length(t) > 1))"
FACT = f"""{REL}, fact AS (SELECT ord, subject_text AS subject, predicate, object_text AS object, sentence AS evidence, document, page_number AS page, coalesce({GOODCONF}, 0.5) AS confidence FROM rel),
hay AS (SELECT *, list_distinct(regexp_extract_all(lower(concat_ws(' ', subject, predicate, object, evidence)), '[a-z0-9]+')) AS h FROM fact),
scored AS (SELECT *, len(list_filter({_QT}, lambda t: list_contains(h, t) OR (length(t) >= 6 AND len(list_filter(h, lambda x: length(x) >= 6 AND substr(x, 1, 6) = substr(t, 1, 6))) > 0))) AS score FROM hay),
top AS (SELECT *, row_number() OVER (ORDER BY score DESC, confidence DESC, ord) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 8)"""


def fact(spark: SparkSession, d: str) -> DataFrame:
    return T.facts(rel(spark, d))


def top(spark: SparkSession, d: str) -> DataFrame:
    return T.ranked(T.keyword_topk(fact(spark, d), QUESTION), F.col("score").desc(), F.col("confidence").desc(), "ord")


@query("overlap_score", f"WITH {FACT} SELECT ord, score FROM scored WHERE score > 0")
def overlap_score(spark: SparkSession, d: str) -> DataFrame:
    hay = F.array_distinct(X.words(F.concat_ws(" ", "subject", "predicate", "object", "evidence")))
    s = fact(spark, d).select("ord", X.overlap_score(X.question_tokens(F.lit(QUESTION)), hay).cast("long").alias("score"))
    return s.filter("score > 0")


@query("keyword_topk", f"WITH {FACT} SELECT rank, ord, score, subject, predicate, object, document, page, confidence FROM top")
def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    return top(spark, d).select(F.col("rank").cast("long").alias("rank"), "ord", F.col("score").cast("long").alias("score"), "subject", "predicate", "object", "document", "page", "confidence")


VEC = """qv AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1), vt AS (
  SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q::DOUBLE[], q::DOUBLE[])), 4) AS score FROM embeddings, qv WHERE len(embedding) = len(q))"""


@query("vector_topk", f"WITH {VEC} SELECT vec_id, score FROM vt WHERE score IS NOT NULL AND NOT isnan(score) ORDER BY score DESC, vec_id LIMIT 8")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "embeddings")
    q = e.orderBy("vec_id").select("embedding").first()[0]
    return T.vector_topk(e, "vec_id", "embedding", q)


_K3 = "concat_ws('||', lower(coalesce({0}subject, '')), lower(coalesce({0}predicate, '')), lower(coalesce({0}object, '')))"
HOP = f"""{FACT}, nm AS (SELECT DISTINCT unnest([lower(subject), lower(object)]) AS name FROM top), hop AS (
  SELECT * FROM fact WHERE (lower(subject) IN (SELECT name FROM nm WHERE name IS NOT NULL) OR lower(object) IN (SELECT name FROM nm WHERE name IS NOT NULL)) AND {_K3.format('')} NOT IN (SELECT {_K3.format('')} FROM top) ORDER BY ord LIMIT 6)"""


@query("hop_expand", f"WITH {HOP} SELECT ord, subject, predicate, object FROM hop")
def hop_expand(spark: SparkSession, d: str) -> DataFrame:
    return T.hop_expand(top(spark, d), fact(spark, d)).select("ord", "subject", "predicate", "object")


@query(
    "hop_expand_graph",
    f"""WITH {FACT}, {NAMED.replace(REL + ',', '')}, en AS (SELECT rank, side, CASE side WHEN 0 THEN subject ELSE object END AS name FROM top, (VALUES (0), (1)) s(side) WHERE rank <= 4),
sym AS (SELECT edge_id, subject AS x, predicate, object AS y FROM named UNION ALL SELECT edge_id, object, predicate, subject FROM named WHERE sid <> oid),
h AS (SELECT rank, side, edge_id, x, predicate, y FROM en JOIN sym ON lower(x) = lower(name) WHERE coalesce(name, '') <> '' QUALIFY row_number() OVER (PARTITION BY rank, side ORDER BY edge_id, y) <= 6),
c AS (SELECT rank, side, coalesce(sum(count(*)) OVER (ORDER BY rank, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h GROUP BY rank, side)
SELECT h.rank, h.side, x AS subject, predicate, y AS object FROM h JOIN c ON c.rank = h.rank AND c.side = h.side WHERE before < 6""",
)
def hop_expand_graph(spark: SparkSession, d: str) -> DataFrame:
    out = T.hop_expand_graph(top(spark, d), G.named_edges(graph(spark, d)))
    return out.select(F.col("rank").cast("long").alias("rank"), "side", "subject", "predicate", "object")


POINTS = """pt AS (SELECT id, max(vector)::DOUBLE[] AS v, any_value(payload) AS payload FROM kg_evidence WHERE id IS NOT NULL AND len(vector) = 96
    AND len(list_filter(vector, lambda e: e IS NULL OR isnan(e))) = 0 AND len(list_filter(vector, lambda e: e <> 0)) > 0 GROUP BY id),
pq AS (SELECT v AS q FROM pt ORDER BY id LIMIT 1),
near AS (SELECT id, round(list_dot_product(v, q) / sqrt(list_dot_product(v, v) * list_dot_product(q, q)), 4) AS score, payload FROM pt, pq ORDER BY score DESC, id LIMIT 8)"""
HYBRID = f"""{FACT}, {POINTS},
two AS (SELECT 0 AS l, rank AS r, ord, subject, predicate, object, evidence, document, page, confidence FROM top
  UNION ALL SELECT 1, row_number() OVER (ORDER BY score DESC, id), NULL, payload.subject, payload.predicate, payload.object, payload.evidence, payload.document, payload.page,
    coalesce(CASE WHEN isnan(payload.confidence) THEN NULL ELSE payload.confidence END, 0.5) FROM near),
once AS (SELECT * FROM two QUALIFY row_number() OVER (PARTITION BY {_K3.format('')} ORDER BY l, r) = 1),
seed AS (SELECT *, row_number() OVER (ORDER BY l, r) AS place FROM once QUALIFY place <= 8),
nm AS (SELECT DISTINCT unnest([lower(subject), lower(object)]) AS name FROM seed), hop AS (
  SELECT * FROM fact WHERE (lower(subject) IN (SELECT name FROM nm WHERE name IS NOT NULL) OR lower(object) IN (SELECT name FROM nm WHERE name IS NOT NULL)) AND {_K3.format('')} NOT IN (SELECT {_K3.format('')} FROM seed) ORDER BY ord LIMIT 6),
al AS (SELECT 0 AS l, place AS r, ord, subject, predicate, object, evidence, document, page, confidence, false AS inferred FROM seed
  UNION ALL SELECT 1, row_number() OVER (ORDER BY ord), ord, subject, predicate, object, evidence, document, page, confidence, true FROM hop),
ded AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY {_K3.format('')} ORDER BY l, r) = 1),
pl AS (SELECT *, row_number() OVER (ORDER BY l, r) AS place FROM ded)"""


def evidence_points(spark: SparkSession, d: str) -> DataFrame:
    """Usable points of the stored vectors, one per id."""
    e = S.table(spark, d, "kg_evidence")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x))
    ok = F.col("id").isNotNull() & (F.size("vector") == 96) & ~bad & F.exists("vector", lambda x: x != 0)
    return e.filter(ok).groupBy("id").agg(F.max("vector").alias("vector"), F.any_value("payload").alias("payload"))


def hybrid(spark: SparkSession, d: str) -> DataFrame:
    """The question's vector is that of the first point; its text is QUESTION."""
    p = evidence_points(spark, d)
    near = T.vector_facts(p, p.orderBy("id").select("vector").first()[0])
    return T.hybrid(top(spark, d), near, fact(spark, d))


@query("hybrid_retrieve", f"WITH {HYBRID} SELECT place, ord, subject, predicate, object, inferred FROM pl")
def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    return hybrid(spark, d).select(F.col("place").cast("long").alias("place"), "ord", "subject", "predicate", "object", "inferred")


@query(
    "graph_keyword_topk",
    f"""WITH {NAMED}, gf AS (SELECT edge_id, subject, predicate, object, confidence, coalesce(n.ev, '') AS evidence FROM named LEFT JOIN (
    SELECT sid, type, oid, predicate, negated, arg_min(sentence, ord) AS ev FROM lr WHERE sentence IS NOT NULL GROUP BY 1, 2, 3, 4, 5) n USING (sid, type, oid, predicate, negated) ORDER BY edge_id LIMIT 2000),
gh AS (SELECT *, list_distinct(regexp_extract_all(lower(concat_ws(' ', subject, predicate, object, evidence)), '[a-z0-9]+')) AS h FROM gf),
gs AS (SELECT edge_id, len(list_filter({_QT}, lambda t: list_contains(h, t) OR (length(t) >= 6 AND len(list_filter(h, lambda x: length(x) >= 6 AND substr(x, 1, 6) = substr(t, 1, 6))) > 0))) AS score, confidence FROM gh)
SELECT edge_id, score, confidence FROM gs WHERE score > 0 ORDER BY score DESC, confidence DESC, edge_id LIMIT 8""",
)
def graph_keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    """Keyword retrieval over the edges of the graph instead of the exported relations."""
    facts = T.graph_facts(G.named_edges(graph(spark, d)))
    return T.keyword_topk(facts, QUESTION).select(F.col("ord").alias("edge_id"), F.col("score").cast("long").alias("score"), "confidence")


@query(
    "context_lines",
    f"""WITH {HYBRID} SELECT substr(string_agg('[' || place || ':' || CASE WHEN inferred THEN 'INFERRED (2-hop neighbor, weaker)' ELSE 'EXPLICIT' END || '] Subject: ' || coalesce(subject, 'None') || ' | Relation: ' || coalesce(predicate, 'None') || ' | Object: ' || coalesce(object, 'None') || ' | Source: ' || coalesce(document, 'None') || ', page ' || coalesce(page::VARCHAR, 'None') || ', confidence ' || format('{{:.2f}}', confidence) || ' | Evidence: ' || coalesce(evidence, 'None'), chr(10) ORDER BY place), 1, 4000) AS context FROM pl""",
)
def context_lines(spark: SparkSession, d: str) -> DataFrame:
    return T.context_lines(hybrid(spark, d))


# ---- metrics and exports -----------------------------------------------------------------------------------------------------------------

@query("graph_stats", f"WITH {NODES}, {REL} SELECT num_entities, noun_phrase_ratio, count(*) AS num_relations, sum((subject_id IS NOT NULL AND object_id IS NOT NULL)::INT)::BIGINT AS linked_relations, sum((subject_id IS NULL OR object_id IS NULL)::INT)::BIGINT AS unlinked_relations FROM rel, (SELECT count(*) AS num_entities, round(avg((coalesce(entity_type, '') = 'NOUN_PHRASE')::INT), 3) AS noun_phrase_ratio FROM node) GROUP BY 1, 2")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return M.graph_stats(G.merge_entities(ent(spark, d)), rel(spark, d))


@query("entity_types", f"WITH {NODES} SELECT coalesce(entity_type, '?') AS entity_type, count(*) AS n FROM node GROUP BY 1")
def entity_types(spark: SparkSession, d: str) -> DataFrame:
    return M.type_histogram(G.merge_entities(ent(spark, d)))


@query(
    "ingest_metrics",
    f"WITH {SEG}, {MEN}, {REL}, p AS (SELECT DISTINCT ON (document) * FROM pdf_results WHERE document IS NOT NULL) SELECT (SELECT count(*) FROM p) AS num_pdfs, (SELECT count(*) FROM p WHERE needs_ocr) AS needs_ocr, (SELECT count(*) FROM seg) AS num_pages, (SELECT count(*) FROM seg WHERE {STRIP('text')} = '') AS empty_pages, (SELECT count(*) FROM men) AS num_mentions, (SELECT count(*) FROM rel) AS num_relations, (SELECT round(avg(coalesce({GOODCONF}, 0.5)::DECIMAL(18,6))::DOUBLE, 3) FROM rel) AS avg_confidence, (SELECT md5(coalesce(string_agg(document, '|' ORDER BY document), '')) FROM p WHERE needs_ocr) AS ocr_files",
)
def ingest_metrics(spark: SparkSession, d: str) -> DataFrame:
    pdf = S.table(spark, d, "pdf_results").filter("document is not null").dropDuplicates(["document"])
    a = pdf.agg(F.count("*").alias("num_pdfs"), F.sum(F.coalesce("needs_ocr", F.lit(False)).cast("long")).alias("needs_ocr"))
    named = pdf.filter("needs_ocr").agg(F.md5(F.array_join(F.array_sort(F.collect_list("document")), "|")).alias("ocr_files"))  # the list of files is part of the summary
    blank = (X.strip(F.coalesce("text", F.lit(""))) == "").cast("long")
    b = S.current_segments(spark, d).agg(F.count("*").alias("num_pages"), F.sum(blank).alias("empty_pages"))
    m = S.current_mentions(spark, d).agg(F.count("*").alias("num_mentions"))
    r = rel(spark, d).agg(F.count("*").alias("num_relations"), F.round(F.avg(F.coalesce(M.good(), F.lit(0.5)).cast("decimal(18,6)")).cast("double"), 3).alias("avg_confidence"))
    return side_by_side(a, b, m, r, named)


@query(
    "eval_metrics",
    f"""WITH {NODES}, {REL} SELECT (SELECT count(*) FROM node) AS entities, count(*) AS relations,
round(1 - count(DISTINCT concat_ws(chr(1), coalesce(subject_id, subject_text, ''), coalesce(predicate, ''), coalesce(object_id, object_text, '')))::DOUBLE / count(*), 4) AS dup_relation_rate,
round(sum((coalesce(sentence, '') <> '')::INT)::DOUBLE / count(*), 4) AS provenance_coverage, round(avg(coalesce({GOODCONF}, 0.5)::DECIMAL(18,6))::DOUBLE, 3) AS avg_confidence,
sum((coalesce(event_date, '') <> '')::INT)::BIGINT AS with_event_date FROM rel""",
)
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.eval_metrics(G.merge_entities(ent(spark, d)), rel(spark, d))


_EVAL = """round(1 - count(DISTINCT concat_ws(chr(1), coalesce(subject_id, subject_text, ''), coalesce(predicate, ''), coalesce(object_id, object_text, '')))::DOUBLE / count(*), 4) AS dup_relation_rate,
round(sum((coalesce(sentence, '') <> '')::INT)::DOUBLE / count(*), 4) AS provenance_coverage, round(avg(coalesce(CASE WHEN isnan(confidence) THEN NULL ELSE confidence END, 0.5)::DECIMAL(18,6))::DOUBLE, 3) AS avg_confidence,
sum((coalesce(event_date, '') <> '')::INT)::DOUBLE AS with_event_date, count(*)::DOUBLE AS relations"""


@query(
    "eval_delta",
    f"""WITH {NODES}, {REL}, n AS (SELECT count(*)::DOUBLE AS entities FROM node), one AS (SELECT {_EVAL} FROM relations), two AS (SELECT {_EVAL} FROM rel),
b AS (UNPIVOT (SELECT one.*, entities FROM one, n) ON COLUMNS(*) INTO NAME metric VALUE before), a AS (UNPIVOT (SELECT two.*, entities FROM two, n) ON COLUMNS(*) INTO NAME metric VALUE after)
SELECT metric, before, after, round(after - before, 6) AS delta FROM b JOIN a USING (metric)""",
)
def eval_delta(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the relations as delivered and of the latest deliveries."""
    e = G.merge_entities(ent(spark, d))
    return M.delta(M.eval_metrics(e, S.table(spark, d, "relations")), M.eval_metrics(e, rel(spark, d)))


@query("eval_status", f"WITH {REL} SELECT coalesce(review_status, '?') AS status, count(*) AS n FROM rel GROUP BY 1")
def eval_status(spark: SparkSession, d: str) -> DataFrame:
    return M.status_counts(rel(spark, d))


@query("service_metrics", f"WITH {NODES}, {REL} SELECT (SELECT count(*) FROM node) AS entities, count(*) AS relations, round(avg(coalesce({GOODCONF}, 0.5)::DECIMAL(18,6))::DOUBLE, 3) AS avg_confidence FROM rel")
def service_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.service_metrics(G.merge_entities(ent(spark, d)), rel(spark, d))


@query(
    "quality_gates",
    f"""WITH {NODES}, {REL}, e AS (SELECT avg((coalesce(entity_type, '') = 'NOUN_PHRASE')::INT) AS ratio, sum(regexp_matches(regexp_replace({STRIP('name')}, '[ ,.]', '', 'g'), '^[0-9]+$')::INT)::BIGINT AS numeric_entities, sum((length(coalesce(name, '')) > 80)::INT)::BIGINT AS overlong_entities FROM node),
r AS (SELECT sum((lower(coalesce(predicate, '')) IN ({', '.join(map(D.lit, V.DROPPED_PREDICATES))}) AND NOT (lower(coalesce(predicate, '')) = 'be' AND {_amount_sql('object_text')}))::INT)::BIGINT AS banned_predicates FROM rel)
SELECT round(ratio, 3) AS noun_phrase_ratio, numeric_entities, overlong_entities, banned_predicates, ratio <= 0.85 AND numeric_entities = 0 AND banned_predicates = 0 AS passed FROM e, r""",
)
def quality_gates(spark: SparkSession, d: str) -> DataFrame:
    return M.quality_gates(G.merge_entities(ent(spark, d)), rel(spark, d))


@query(
    "export_relations",
    f"WITH {REL} SELECT ord, subject_id, subject_text AS subject, predicate, object_text AS object, object_id, relation_type, sentence AS evidence, document, page_number AS page, extraction_method AS method, review_status AS status, coalesce({GOODCONF}, 0.5) AS confidence, event_date, negated FROM rel",
)
def export_relations(spark: SparkSession, d: str) -> DataFrame:
    """All exported columns of every relation (a confidence that is null or no number is exported as 0.5), and ord."""
    r = rel(spark, d)
    return relation_rows(r, "ord")


@query(
    "vector_points",
    f"""WITH {REL}, t AS (SELECT ord, document, sentence, predicate, substr(coalesce(subject_text, '') || ' ' || coalesce(predicate, '') || ' ' || coalesce(object_text, '') || '. ' || sentence, 1, 2000) AS text FROM rel WHERE {STRIP('sentence')} <> '' AND document IS NOT NULL AND predicate IS NOT NULL)
SELECT max(ord) AS ord, md5(arg_max(text, ord)) AS text_md5, count(*) AS writes FROM t GROUP BY document, sentence, predicate""",
)
def vector_points(spark: SparkSession, d: str) -> DataFrame:
    """One point per id; of several relations with the same id the last one stays."""
    r = VA.with_evidence(rel(spark, d)).filter("document is not null and predicate is not null")
    blank = lambda c: F.coalesce(c, F.lit(""))
    text = F.substring(F.concat(blank("subject_text"), F.lit(" "), blank("predicate"), F.lit(" "), blank("object_text"), F.lit(". "), "sentence"), 1, 2000)
    p = r.select("ord", X.point_id(F.col("document"), F.col("sentence"), F.col("predicate")).alias("id"), text.alias("text"))
    return p.groupBy("id").agg(F.max("ord").alias("ord"), F.md5(F.max_by("text", "ord")).alias("text_md5"), F.count("*").alias("writes")).drop("id")


@query(
    "manifest_changes",
    "WITH f AS (SELECT DISTINCT path, sha1(document || coalesce(num_pages, 0)) AS sha1, document FROM pdf_results WHERE path IS NOT NULL AND document IS NOT NULL) SELECT path, sha1 FROM f WHERE contains(document, 'lab_report')",
)
def manifest_changes(spark: SparkSession, d: str) -> DataFrame:
    """Files a manifest of everything but the lab reports does not know."""
    from veriloom.sources.exports import changed_files

    f = S.table(spark, d, "pdf_results").filter("path is not null and document is not null")
    now = f.select("path", "document", F.sha1(F.concat("document", F.coalesce("num_pages", F.lit(0)).cast("string"))).alias("sha1")).distinct()
    return changed_files(now.select("path", "sha1"), now.filter(~F.contains("document", F.lit("lab_report"))))
