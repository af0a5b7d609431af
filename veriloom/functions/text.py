"""Scalar text functions as Column expressions (no Python in the data path)."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from veriloom.functions import vocab as V

WS = "[" + V.SPACE_CHARS + "]"


def strip(c: Column) -> Column:
    """Without outer white space of any kind; null stays null."""
    return F.btrim(c, F.lit(V.SPACE_CHARS))


def clean_display(c: Column) -> Column:
    """Every run of white space becomes one blank; null becomes the empty text."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), WS + "+", " "))


def without_invisible(c: Column) -> Column:
    return F.translate(c, V.INVISIBLE_CHARS, "")


def normalize_name(c: Column) -> Column:
    """Canonical form for matching: lower case ASCII words without articles, titles, possessives and company forms.

    Null, blank and non-ASCII-only names give the empty text.
    """
    t = F.lower(strip(F.coalesce(c, F.lit(""))))
    t = F.translate(t, "’‘“”", "''\"\"")
    t = F.btrim(t, F.lit(V.EDGE_CHARS))
    t = F.regexp_replace(t, r"'s(?![\p{L}\p{N}_])", "")
    t = F.btrim(F.regexp_replace(t, "[^a-z0-9]+", " "))
    t = F.regexp_replace(t, "^(?:(?:" + "|".join(V.ARTICLES + V.HONORIFICS) + ")(?: |$))+", "")
    t = F.regexp_replace(t, "(?:(?:^| )(?:" + "|".join(V.CORP_SUFFIXES) + "))+$", "")
    return F.btrim(t)


def canon(text: Column, normalized: Column) -> Column:
    """First usable key: of the text, else of the stored normal form, else that form in lower case."""
    return F.coalesce(
        F.nullif(normalize_name(text), F.lit("")),
        F.nullif(normalize_name(normalized), F.lit("")),
        F.lower(strip(F.coalesce(normalized, F.lit("")))),
    )


def normalize_relation(c: Column) -> Column:
    t = F.upper(F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_")))
    return F.when(t == "", F.lit("RELATED_TO")).otherwise(t)


def sanitize_rel_type(c: Column) -> Column:
    t = F.btrim(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Za-z0-9_]+", "_"), F.lit("_"))
    return F.when(t == "", F.lit("RELATED_TO")).when(~t.rlike("^[A-Z]"), F.concat(F.lit("REL_"), t)).otherwise(t)


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def content_tokens(c: Column) -> Column:
    """Distinct words in order of first use, without the resolver's stop words."""
    return F.array_except(words(c), F.array(*map(F.lit, V.RESOLVER_STOPWORDS)))


def question_tokens(c: Column) -> Column:
    return F.filter(F.array_except(words(c), F.array(*map(F.lit, V.QUESTION_STOPWORDS))), lambda t: F.length(t) > 1)


def overlap_score(tokens: Column, hay: Column) -> Column:
    """1 for each token found exactly, or by a common start of six letters when both are that long."""
    hit = lambda t: F.array_contains(hay, t) | (
        (F.length(t) >= 6) & F.exists(hay, lambda h: (F.length(h) >= 6) & (F.substring(h, 1, 6) == F.substring(t, 1, 6)))
    )
    return F.size(F.filter(tokens, hit))


def is_generic(c: Column) -> Column:
    t = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for g in V.GENERIC_PHRASES:
        out = out | t.contains(g)
    return out


def valid_endpoint(c: Column) -> Column:
    """2 to 80 characters, not a bare number, not made of stop words only."""
    t = strip(F.coalesce(c, F.lit("")))
    bare = F.regexp_replace(t, "[ ,.;]", "")
    alpha = F.regexp_extract_all(F.lower(t), F.lit("[a-z]+"), F.lit(0))
    stop = F.array(*map(F.lit, V.ENDPOINT_STOPWORDS))
    only_stop = (F.size(alpha) > 0) & F.forall(alpha, lambda w: F.array_contains(stop, w))
    return F.length(t).between(2, 80) & ~bare.rlike("^[0-9]+$") & ~only_stop


def amount_like(c: Column) -> Column:
    """A digit and either a currency marker or two fifths of the characters numeric."""
    t = strip(F.coalesce(c, F.lit("")))
    dense = F.regexp_replace(t, WS, "")
    numeric = F.length(F.regexp_replace(dense, "[^0-9,.%/-]", ""))
    return t.rlike("[0-9]") & (t.rlike("(?i)INR|USD|EUR|GBP|Rs(?![A-Za-z0-9_])|[₹$€£]") | (numeric >= F.lit(0.4) * F.length(dense)))


def id_codes(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?<![A-Za-z0-9_])[A-Z]{2,}[-/]?[0-9][A-Za-z0-9_-]*(?![A-Za-z0-9_])"), F.lit(0))


DATE_PATTERN = "(?i)(^|[^A-Za-z0-9_])([0-9]{1,2}[ \\t\\n]+(?:" + "|".join(V.MONTHS) + ")[ \\t\\n]+[0-9]{4})([^A-Za-z0-9_]|$)"


def first_date(c: Column) -> Column:
    """First '<day> <month name> <year>' of a text, null if there is none."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), DATE_PATTERN, 2), F.lit(""))


def score_hundredths(subject: Column, obj: Column, via_prep: Column, via_agent: Column) -> Column:
    """Confidence of an extracted relation in hundredths: base by pattern, then a bonus or a malus per endpoint."""
    s = F.when(via_agent, 80).when(via_prep, 70).otherwise(75)
    for e in (subject, obj):
        t = strip(F.coalesce(e, F.lit("")))
        upper = F.substring(t, 1, 1) != F.lower(F.substring(t, 1, 1))
        s = s + F.when(upper & (F.length(t) >= 3), 5).otherwise(0) - F.when(F.size(F.split(t, WS + "+")) > 6, 10).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), s))


def is_acronym(short: Column, long: Column) -> Column:
    """The squeezed short name (2 to 6 letters) starts the initials of a name of two or more content words."""
    squeezed = F.regexp_replace(F.lower(F.coalesce(short, F.lit(""))), "[^a-z0-9]", "")
    tokens = content_words(long)
    initials = F.array_join(F.transform(tokens, lambda t: F.substring(t, 1, 1)), "")
    return F.length(squeezed).between(2, 6) & (F.size(tokens) >= 2) & initials.startswith(squeezed)


def content_words(c: Column) -> Column:
    """Words without stop words, repeats kept."""
    stop = F.array(*map(F.lit, V.RESOLVER_STOPWORDS))
    return F.filter(words(c), lambda t: ~F.array_contains(stop, t))


def compatible_types(a: Column, b: Column) -> Column:
    return (a == b) | (a == "NOUN_PHRASE") | (b == "NOUN_PHRASE")


def entity_id(entity_type: Column, normalized: Column) -> Column:
    return F.concat(F.lit("entity_"), F.substring(F.sha2(F.concat_ws("||", entity_type, normalized), 256), 1, 12))


def event_id(event_type: Column, date: Column, subject: Column, obj: Column) -> Column:
    return F.concat(F.lit("event_"), F.substring(F.sha1(F.concat_ws("||", event_type, date, subject, obj)), 1, 12))


def point_id(document: Column, sentence: Column, predicate: Column) -> Column:
    """Name-based UUID (version 5, URL namespace) of a stored vector point."""
    raw = F.concat_ws("||", document, sentence, predicate)
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(raw, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F)).bitwiseOR(0x80)))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12),
    )


def switched_on(value, default: bool = True) -> bool:
    """A setting that may be a flag or a word: off are false, 0 and no in any case; a missing one takes the default."""
    return default if value is None else str(value).lower() not in V.OFF_WORDS


def either(*names: str) -> Column:
    """The first of several columns that is neither null nor empty (exports and stores name the same thing differently)."""
    return F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in names))


def entity_like(c: Column) -> Column:
    """A question that names something: an identifier code or a quoted text."""
    return (F.size(id_codes(c)) > 0) | F.coalesce(c, F.lit("")).rlike("[\"'][^\"']+[\"']")


def register_sql_functions(spark: SparkSession) -> None:
    """Make the central functions callable from SQL as temporary SQL functions (inlined by the optimizer)."""
    edge = V.EDGE_CHARS.replace("'", "\\'")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION veriloom_name(x STRING) RETURNS STRING RETURN "
        "btrim(regexp_replace(regexp_replace(btrim(regexp_replace(regexp_replace(btrim(lower(btrim(coalesce(x, ''))), "
        f"'{edge}'), '\\'s(?![\\\\p{{L}}\\\\p{{N}}_])', ''), '[^a-z0-9]+', ' ')), "
        f"'^(?:(?:{'|'.join(V.ARTICLES + V.HONORIFICS)})(?: |$))+', ''), '(?:(?:^| )(?:{'|'.join(V.CORP_SUFFIXES)}))+$', ''))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION veriloom_relation(x STRING) RETURNS STRING RETURN "
        "coalesce(nullif(upper(btrim(regexp_replace(lower(coalesce(x, '')), '[^a-z0-9]+', '_'), '_')), ''), 'RELATED_TO')"
    )
