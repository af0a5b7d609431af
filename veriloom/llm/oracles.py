"""DuckDB statements for the training-data queries that SQL can express."""

from __future__ import annotations

from veriloom.functions import vocab as V
from veriloom.plans import duck as D

_TRUST = "(SELECT extraction_method, min(trust_rank) AS trust_rank FROM method_trust GROUP BY 1)"

P1 = """
WITH now AS (
  SELECT ord, document, confidence FROM relations WHERE ord IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY ord ORDER BY ingested_at DESC NULLS LAST, confidence DESC NULLS LAST, document DESC NULLS LAST) = 1)
SELECT document, ord FROM now
WHERE document IS NOT NULL AND confidence IS NOT NULL AND NOT isnan(confidence)
QUALIFY row_number() OVER (PARTITION BY document ORDER BY confidence DESC, ord) <= 5
"""

P2 = f"""
WITH rec AS (
  SELECT DISTINCT ON (rec_id) rec_id, id, name, normalized_name, mentions, extraction_method, resolved_at
  FROM entities WHERE id IS NOT NULL AND rec_id IS NOT NULL),
r AS (
  SELECT rec.*, coalesce(t.trust_rank, 1000) AS tr,
    len(list_distinct(list_filter(list_transform(coalesce(mentions, []), lambda m: {D.strip('m')}), lambda m: m IS NOT NULL AND m <> ''))) AS n_m,
    {D.name(D.no_invisible('name'))} = normalized_name AND normalized_name <> '' AS ok
  FROM rec LEFT JOIN {_TRUST} t USING (extraction_method)),
n AS (SELECT id, rec_id AS name_rec FROM r WHERE ok QUALIFY row_number() OVER (PARTITION BY id ORDER BY tr, resolved_at DESC NULLS LAST, rec_id) = 1),
m AS (SELECT id, rec_id AS mentions_rec FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY n_m DESC, resolved_at DESC NULLS LAST, rec_id) = 1)
SELECT g.id, name_rec, mentions_rec
FROM (SELECT id FROM r GROUP BY id HAVING count(*) > 1) g LEFT JOIN n USING (id) LEFT JOIN m USING (id)
"""

# Votes as in the operator's definition: trust halves per rank, recency per year, summed per normalised value.
P2C = f"""
WITH rec AS (
  SELECT DISTINCT ON (rec_id) rec_id, id, name, normalized_name, entity_type, extraction_method, resolved_at
  FROM entities WHERE id IS NOT NULL AND rec_id IS NOT NULL),
r AS (
  SELECT rec.*, (2 ** (30 - least(30, greatest(1, coalesce(t.trust_rank, 30)))))::BIGINT::HUGEINT
      * floor(coalesce(2.0::DOUBLE ** least(56.0, greatest(0.0, 10.0 + (epoch_us(resolved_at) - 946684800000000)::DOUBLE / 31556952000000.0::DOUBLE)), 1.0))::HUGEINT AS vote,
    {D.clean_display(D.no_invisible('name'))} AS shown,
    {D.name(D.no_invisible('name'))} = normalized_name AND normalized_name <> '' AS ok
  FROM rec LEFT JOIN {_TRUST} t USING (extraction_method)),
nv AS (SELECT id, lower(shown) AS k, sum(vote) AS votes, min(rec_id) AS f, first(shown ORDER BY vote DESC, rec_id) AS name FROM r WHERE ok GROUP BY 1, 2),
n AS (SELECT id, name FROM nv QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, f) = 1),
tv AS (SELECT id, upper(entity_type) AS k, sum(vote) AS votes, min(rec_id) AS f, first(entity_type ORDER BY vote DESC, rec_id) AS entity_type FROM r WHERE entity_type IS NOT NULL GROUP BY 1, 2),
t AS (SELECT id, entity_type FROM tv QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, f) = 1)
SELECT g.id, name, entity_type FROM (SELECT id FROM r GROUP BY id HAVING count(*) > 1) g LEFT JOIN n USING (id) LEFT JOIN t USING (id)
"""

P4 = """
WITH RECURSIVE known AS (SELECT normalized_name, min(id) AS known FROM entities WHERE id IS NOT NULL AND normalized_name IS NOT NULL GROUP BY 1),
raw AS (
  SELECT coalesce(id_a, ka.known) AS a0, coalesce(id_b, kb.known) AS b0
  FROM match_pairs LEFT JOIN known ka ON ka.normalized_name = normalized_a LEFT JOIN known kb ON kb.normalized_name = normalized_b
  WHERE is_match),
e AS (SELECT coalesce(a0, b0) AS a, coalesce(b0, a0) AS b FROM raw WHERE a0 IS NOT NULL OR b0 IS NOT NULL),
sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS id, a AS other FROM sym UNION SELECT reach.id, sym.b FROM reach JOIN sym ON sym.a = reach.other)
SELECT id, min(other) AS group_id FROM reach GROUP BY id
"""

P7 = """
WITH v AS (
  SELECT id, max(vector)::DOUBLE[] AS x FROM kg_evidence
  WHERE id IS NOT NULL AND len(vector) = 96
    AND len(list_filter(vector, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(vector, lambda e: e <> 0)) > 0
  GROUP BY id),
u AS (SELECT id, list_transform(x, lambda e: e / sqrt(list_sum(list_transform(x, lambda f: f * f)))) AS x FROM v),
s AS (SELECT a.id, b.id AS other, round(list_dot_product(a.x, b.x), 9) AS cos FROM u a JOIN u b ON a.id <> b.id),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY cos DESC, other) <= 5)
SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM t WHERE cos >= 0.8
"""

def _look(x: str) -> str:
    """The look of a text, stated without the operator: width, spacing, hyphens and invisible characters by rule, Cyrillic and Greek letters as the Latin ones drawn alike, then composition."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    blanks = "".join(c for c in V.SPACE_CHARS if ord(c) > 0x7F and c not in "\u1680\u2028\u2029\x85")
    t = f"translate({x}, {D.chars(V.INVISIBLE_CHARS)}, '')"
    t = f"translate({t}, {D.chars(wide)}, {D.lit(narrow)})"
    t = f"translate({t}, {D.chars(blanks)}, '{' ' * len(blanks)}')"
    t = f"translate({t}, {D.chars(chr(0x2010) + chr(0x2011) + chr(0x2212) + chr(0x37E))}, '---;')"
    for mark, plain in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("…", "...")):
        t = f"replace({t}, '{mark}', '{plain}')"
    cyrillic = ("аеорсухіѕјһԁԛԝѵАВЕКМНОРСТХІЅЈҮГЛПФЁёЇї", "aeopcyxisjhdqwvABEKMHOPCTXISJYГЛПФËëÏï")
    greek = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧΓΛΠΦονϲϳ", "ABEZHIKMNOPTYXГЛПФovcj")
    for seen, meant in (cyrillic, greek):
        t = f"translate({t}, '{seen}', '{meant}')"
    return f"nfc_normalize({t})"


P10 = f"""
WITH f AS (SELECT doc_id, text, {_look('text')} AS form FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM f a JOIN f b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id
WHERE NOT regexp_full_match(a.form, '\\s*')
"""

P8_CHECKS = """
SELECT container AS kind, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL AND text <> '') AS documents, 0::BIGINT AS over_full, 0::BIGINT AS changed, 0::BIGINT AS divided, false AS wasteful
FROM container_kinds WHERE container IS NOT NULL AND capacity_tokens > 0 GROUP BY container
"""

P9_CHECKS = """
SELECT DISTINCT source, false AS over_used, 0::BIGINT AS strange, source NOT IN (SELECT source FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL AND text <> '') AS off_target
FROM mix_targets WHERE source IS NOT NULL
"""

ORACLE_SQL: dict[str, str] = {"p1_found": P1, "p2_found": P2, "p2_consensus": P2C, "p4_found": P4, "p7_found": P7, "p8_checks": P8_CHECKS, "p9_checks": P9_CHECKS, "p10_found": P10}
