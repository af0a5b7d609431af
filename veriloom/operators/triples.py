"""Mention and triple extraction over a parsed token table.

The parser is a plug-in: anything that fills the token table will do.  Tokens:
doc, sent, i, text, lemma, pos, dep, head (i of the head token, itself for a
root), start_char, end_char.  Spans (entities, noun chunks): doc, sent, first,
last (exclusive), label, text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions import text as X
from veriloom.functions import vocab as V

# Dependency labels.
SUBJECT = ["nsubj", "nsubjpass", "csubj", "csubjpass"]
OBJECT = ["dobj", "obj", "attr", "oprd", "dative"]
PREP_OBJECT = ["pobj", "obl"]
NOMINAL = ["NOUN", "PROPN", "PRON", "NUM"]

TOKEN_SCHEMA = "doc string, sent int, i int, text string, lemma string, pos string, dep string, head int, start_char int, end_char int"


#: Parsers of this worker process by the name of their maker: building one is far dearer than a batch.
_PARSERS: dict[str, Callable[[str], list[tuple]]] = {}


def parse(pages: DataFrame, key: str, text: str, make_parser: Callable[[], Callable[[str], list[tuple]]]) -> DataFrame:
    """Token table of the non-blank texts; ``make_parser`` runs once per worker process and returns a function
    text -> rows of (sent, i, text, lemma, pos, dep, head, start_char, end_char)."""

    name = f"{make_parser.__module__}.{make_parser.__qualname__}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = _PARSERS.get(name) or _PARSERS.setdefault(name, make_parser())
        names = "sent i text lemma pos dep head start_char end_char".split()
        for pdf in batches:
            out = []
            for k, t in zip(pdf["k"], pdf["t"]):
                rows = pd.DataFrame(parser(t), columns=names)
                rows.insert(0, "doc", k)
                out.append(rows)
            if out:
                yield pd.concat(out)

    solid = pages.filter(X.strip(F.coalesce(F.col(text), F.lit(""))) != "").select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    return solid.mapInPandas(run, TOKEN_SCHEMA)


def empty_chunks(chunks: DataFrame, tokens: DataFrame) -> DataFrame:
    """The chunks (doc, sent, first, last) all of whose words are pronouns or stop words (tokens: doc, sent, i, pos, is_stop)."""
    inside = chunks.select("doc", "sent", "first", "last").join(tokens.filter("pos <> 'PUNCT'").select("doc", "sent", "i", "pos", "is_stop"), ["doc", "sent"])
    inside = inside.filter((F.col("i") >= F.col("first")) & (F.col("i") < F.col("last")))
    idle = F.coalesce("is_stop", F.lit(False)) | (F.col("pos") == "PRON")
    return inside.groupBy("doc", "sent", "first", "last").agg(F.min(idle).alias("idle")).filter("idle").drop("idle")


def first_free(chunks: DataFrame) -> DataFrame:
    """Per doc, in the order of their start, the chunks that overlap no chunk kept before them (a chunk that was dropped is in nobody's way).

    The spans of one page are folded in one row: a page is the unit the parser reads whole.
    """
    order = F.array_sort(F.collect_list(F.struct("first", "last", "sent", "label", "text")))
    rows = chunks.groupBy("doc").agg(order.alias("c"))
    start = F.slice("c", 1, 1)
    fold = F.aggregate(F.slice("c", F.lit(2), F.size("c")), start, lambda kept, x: F.when(x["first"] >= F.element_at(kept, -1)["last"], F.concat(kept, F.array(x))).otherwise(kept))
    return rows.select("doc", F.explode(fold).alias("x")).select("doc", "x.*")


def kept_spans(entities: DataFrame, chunks: DataFrame, drop: list[str] | None = None, max_chars: int = 80, tokens: DataFrame | None = None) -> DataFrame:
    """Entity spans of kept labels, and noun chunks that overlap none of them nor an earlier kept chunk.

    With ``tokens`` (doc, sent, i, pos, is_stop) chunks of pronouns and stop words alone are left out.
    """
    shown = X.clean_display(F.col("text"))
    ok = (F.length(shown).between(2, max_chars)) & ~X.is_generic(shown)
    ents = entities.filter(~F.col("label").isin(V.DROPPED_TYPES if drop is None else drop) & (F.length(shown) <= max_chars) & ~X.is_generic(shown))
    cols = ["doc", "sent", "first", "last", "label", "text"]
    cand = chunks.filter(ok & (F.col("last") - F.col("first")).between(1, 4)).withColumn("label", F.lit("NOUN_PHRASE")).select(cols)
    if tokens is not None:
        cand = cand.join(empty_chunks(cand, tokens), ["doc", "sent", "first", "last"], "left_anti")
    e = ents.select(F.col("doc").alias("d"), F.col("first").alias("f"), F.col("last").alias("l"))
    free = cand.join(e, (F.col("doc") == F.col("d")) & (F.col("first") < F.col("l")) & (F.col("last") > F.col("f")), "left_anti")
    return ents.select(cols).union(first_free(free).select(cols))


def phrases(tokens: DataFrame, max_span: int = 6) -> DataFrame:
    """doc, sent, i, phrase: the words under each token (verbs and auxiliaries below it left out) as one span of at most
    ``max_span`` tokens; a wider span gives the modifiers standing next to the token only."""
    up = tokens.select("doc", "sent", F.col("i").alias("anc"), F.col("i").alias("d"))
    child = tokens.filter("i <> head").select("doc", "sent", F.col("head").alias("d"), F.col("i").alias("c"), F.col("pos").alias("cp"))
    reach = up
    for _ in range(max_span):
        step = reach.join(child, ["doc", "sent", "d"]).filter(~F.col("cp").isin("VERB", "AUX")).select("doc", "sent", "anc", F.col("c").alias("d"))
        reach = reach.union(step).distinct()
    span = reach.groupBy("doc", "sent", F.col("anc").alias("i")).agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    near = tokens.filter(F.col("dep").isin("compound", "amod", "poss", "det", "nummod")).select("doc", "sent", F.col("head").alias("i"), F.col("i").alias("m"))
    near = near.groupBy("doc", "sent", "i").agg(F.min("m").alias("mlo"))
    words = tokens.groupBy("doc", "sent").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("w"))
    wide = F.col("hi") - F.col("lo") + 1 > max_span
    lo, hi = F.when(wide, F.least("i", F.coalesce("mlo", "i"))).otherwise(F.col("lo")), F.when(wide, F.col("i")).otherwise(F.col("hi"))
    out = span.join(near, ["doc", "sent", "i"], "left").withColumns({"lo": lo, "hi": hi}).join(words, ["doc", "sent"])
    inside = F.filter("w", lambda x: (x["i"] >= F.col("lo")) & (x["i"] <= F.col("hi")))
    return out.select("doc", "sent", "i", F.btrim(F.array_join(F.transform(inside, lambda x: x["text"]), " "), F.lit(V.EDGE_CHARS + " ")).alias("phrase"))


def _side(t: DataFrame, name: str) -> DataFrame:
    return t.select("doc", "sent", F.col("i").alias(f"{name}_i"), F.col("head").alias(f"{name}_head"), F.col("dep").alias(f"{name}_dep"), F.col("pos").alias(f"{name}_pos"), F.col("lemma").alias(f"{name}_lemma"), F.col("text").alias(f"{name}_text"))


def triples(tokens: DataFrame) -> DataFrame:
    """doc, sent, subject, predicate, object, negated, hundredths, pattern of every verb.

    Patterns: subject and object of one verb (a conjoined verb borrows its
    head's subject), object of a preposition, passive agent.  Sentences of
    fewer than three words, unusable ends, equal ends and light verbs give nothing.
    """
    k = ["doc", "sent"]
    long = tokens.filter(F.col("pos") != "PUNCT").groupBy(*k).agg(F.count("*").alias("n")).filter("n >= 3").select(*k)
    t = tokens.join(long, k, "left_semi")
    verbs = _side(t.filter(F.col("pos").isin("VERB", "AUX")), "v")
    c = _side(t, "c")
    child = verbs.join(c, k).filter((F.col("c_head") == F.col("v_i")) & (F.col("c_i") != F.col("v_i")))
    neg = child.filter(F.col("c_dep") == "neg").select(*k, "v_i").distinct().withColumn("negated", F.lit(True))
    own = child.filter(F.col("c_dep").isin(SUBJECT)).select(*k, "v_i", F.col("c_i").alias("s_i"), F.col("c_dep").alias("s_dep"))
    lent = verbs.filter(F.col("v_dep") == "conj").join(own.select(*k, F.col("v_i").alias("v_head"), "s_i", "s_dep"), [*k, "v_head"])
    lent = lent.join(own.select(*k, "v_i"), [*k, "v_i"], "left_anti").select(*k, "v_i", "s_i", "s_dep")
    subj = own.union(lent)
    direct = child.filter(F.col("c_dep").isin(OBJECT)).select(*k, "v_i", "v_lemma", F.col("c_i").alias("o_i"), F.col("v_lemma").alias("predicate"), F.lit("svo").alias("pattern"))
    preps = child.filter(F.col("c_dep").isin("prep", "agent")).select(*k, "v_i", "v_lemma", F.col("c_i").alias("p_i"), F.col("c_dep").alias("p_dep"), F.col("c_text").alias("p_text"))
    under = preps.join(_side(t, "o"), k).filter((F.col("o_head") == F.col("p_i")) & (F.col("o_dep").isin(PREP_OBJECT) | F.col("o_pos").isin(NOMINAL)))
    by_prep = under.filter("p_dep = 'prep'").select(*k, "v_i", "v_lemma", "o_i", F.concat_ws(" ", "v_lemma", F.lower("p_text")).alias("predicate"), F.lit("prep").alias("pattern"))
    cases = t.filter("dep = 'case'").select(*k, F.col("head").alias("o_i"), F.lower("text").alias("case"))
    by_case = child.filter(F.col("c_dep").isin("obl", "obj")).select(*k, "v_i", "v_lemma", F.col("c_i").alias("o_i")).join(cases, [*k, "o_i"])
    by_case = by_case.select(*k, "v_i", "v_lemma", "o_i", F.concat_ws(" ", "v_lemma", "case").alias("predicate"), F.lit("prep").alias("pattern"))
    active = subj.join(direct.union(by_prep).union(by_case), [*k, "v_i"]).select(*k, "v_i", "v_lemma", F.col("s_i").alias("a"), F.col("o_i").alias("b"), "predicate", "pattern")
    agents = under.filter("p_dep = 'agent'").select(*k, "v_i", "v_lemma", F.col("o_i").alias("a"))
    passive = agents.join(subj.filter(F.col("s_dep").isin("nsubjpass", "csubjpass")), [*k, "v_i"]).select(*k, "v_i", "v_lemma", "a", F.col("s_i").alias("b"), F.col("v_lemma").alias("predicate"), F.lit("agent").alias("pattern"))
    ph = phrases(t)
    a = ph.select(*k, F.col("i").alias("a"), F.col("phrase").alias("subject"))
    b = ph.select(*k, F.col("i").alias("b"), F.col("phrase").alias("object"))
    out = active.union(passive).join(a, [*k, "a"]).join(b, [*k, "b"]).join(neg, [*k, "v_i"], "left")
    light = F.lower("v_lemma").isin(V.DROPPED_PREDICATES) & ~((F.lower("v_lemma") == "be") & X.amount_like(F.col("object")))
    ok = (X.valid_endpoint(F.col("subject")) | (F.col("pattern") == "agent")) & X.valid_endpoint(F.col("object")) & (F.lower("subject") != F.lower("object")) & ~light
    score = X.score_hundredths(F.col("subject"), F.col("object"), F.col("pattern") == "prep", F.col("pattern") == "agent")
    return out.filter(ok).select(*k, "subject", "predicate", "object", F.coalesce("negated", F.lit(False)).alias("negated"), score.alias("hundredths"), "pattern").distinct()


def resolve_demonstrative(endpoint: Column, history: Column) -> Column:
    """'this loan' becomes the first code of the noun's family in the nearest sentence of ``history`` (nearest first) that is not already in it."""
    noun = F.lower(F.regexp_extract(X.strip(F.coalesce(endpoint, F.lit(""))), r"(?i)^(?:this|that|these|those)\s+([a-z]+)", 1))
    out = endpoint
    for word, family in V.CODE_FAMILIES.items():
        pattern = F.lit(rf"(?<![A-Za-z0-9_]){family}(?![A-Za-z0-9_])")
        hits = _hits(history, pattern)
        fresh = F.filter(hits, lambda h: ~F.contains(F.lower(endpoint), F.lower(h)))
        out = F.when(noun == word, F.coalesce(F.get(fresh, F.lit(0)), endpoint)).otherwise(out)
    return out


def with_code(subject: Column, lemma: Column, history: Column) -> Column:
    """The subject of an amount ("The sanctioned amount was ...") with the nearest code behind it in brackets.

    ``history``: sentences, nearest first.  Only under the verb be, where the subject holds neither brackets nor that code.
    """
    code = F.try_element_at(F.filter(F.transform(history, lambda s: F.try_element_at(X.id_codes(s), F.lit(-1))), lambda c: c.isNotNull()), F.lit(1))
    fits = (F.lower(lemma) == "be") & ~F.contains(subject, F.lit("(")) & ~F.contains(F.lower(subject), F.lower(code))
    return F.when(fits, F.concat(subject, F.lit(" ("), code, F.lit(")"))).otherwise(subject)


def title_relations(found: DataFrame) -> DataFrame:
    """subject_text, predicate, object_text, confidence, extraction_method of ``titles``: a person bears a title."""
    return found.select("doc", "sent", F.col("person").alias("subject_text"), F.lit("title").alias("predicate"), F.col("title").alias("object_text"),
        F.lit(0.85).alias("confidence"), F.lit("title_pattern").alias("extraction_method"))


def _hits(history: Column, pattern: Column) -> Column:
    return F.flatten(F.transform(history, lambda s: F.regexp_extract_all(s, pattern, F.lit(0))))


def titles(tokens: DataFrame, people: DataFrame) -> DataFrame:
    """doc, sent, title, person: a job title of at most five words right before a person ('Service Lead P. Nair')."""
    stop = tokens.filter(F.col("pos").isin("PUNCT", "VERB", "AUX", "ADP")).select("doc", "sent", F.col("i").alias("s"))
    near = people.filter(F.col("label") == "PERSON").select("doc", "sent", "first", F.col("text").alias("person"))
    left = near.join(stop, ["doc", "sent"], "left").withColumn("s", F.when(F.col("s") < F.col("first"), F.col("s")))
    left = left.groupBy("doc", "sent", "first", "person").agg(F.greatest(F.coalesce(F.max("s"), F.lit(-1)) + 1, F.col("first") - 5).alias("lo"))
    w = left.join(tokens.select("doc", "sent", "i", "text"), ["doc", "sent"]).filter((F.col("i") >= F.col("lo")) & (F.col("i") < F.col("first")))
    w = w.groupBy("doc", "sent", "first", "person").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]).alias("words"))
    first, last = F.col("words")[0], F.lower(F.element_at("words", -1))
    ok = last.isin(V.TITLE_NOUNS) & (F.substring(first, 1, 1) != F.lower(F.substring(first, 1, 1)))
    return w.filter(ok).select("doc", "sent", F.array_join("words", " ").alias("title"), "person")
