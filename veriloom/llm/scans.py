"""Repair of text from scanned pages.

Digits and codes are masked to find lines that repeat over the pages of a file
(headers, footers, scanner marks); words are grouped by a skeleton of glyphs
that recognition confuses, and the frequent form of a group corrects the rare
ones; splits and joins of words are settled by comparing word and word-pair
counts over the whole corpus; windows over the lines reflow the paragraphs.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions import vocab as V
from veriloom.session import materialize, spread

#: Hyphens of compounds written inside a line.
INNER_HYPHENS = "-" + chr(0x2010) + chr(0x2011)
HYPHENS = "-" + chr(0x2010) + chr(0x2011) + chr(0xAD) + chr(0xAC)
#: A form corrects another one when it is this many times as frequent and occurs at least FREQUENT times.
DOMINANCE, FREQUENT = 8, 4
#: Lines from the top and the bottom of a page where a page number needs no support of its neighbours or its file.
EDGE = 3
_WORD = r"[\p{L}\p{M}0-9@|]+"
_INNER = "\\" + INNER_HYPHENS
_BLANK = "[" + V.SPACE_CHARS + "]"
_BLANKS = " \t\x0b\f\r"
_LABEL = r"(?:page|seite|página|pagina|pág\.?|pag\.?|p\.?|s\.?)"
_PAGE_NUMBER = (
    r"(?iu)^(?=.*[0-9])[\[(—–\-]?\s*" + _LABEL + r"?\s*([0-9lOoIS]{1,4})(?:\s*(?:of|de|sur|von|/)\s*[0-9lOoIS]{1,4})?\s*[\])—–\-]?$"
)
_NUMERAL = r"(?iu)^[ivxl]{1,6}$"
_ROMAN = {"x" * (n // 10) + ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"][n % 10]: n for n in range(1, 40)}


def skeleton(word: Column) -> Column:
    """Words that recognition may confuse share one skeleton (the word is in lower case)."""
    t = F.translate(word, "01|!i@5968q", "ollllasghhg")
    for seen, meant in (("rn", "m"), ("rl", "n"), ("cl", "d"), ("vv", "w"), ("ll", "u")):
        t = F.replace(t, F.lit(seen), F.lit(meant))
    return F.translate(t, "cfb2", "ethz")


def lines_of(pages: DataFrame) -> DataFrame:
    """One row per line of every page: seg_id, document, page_number, line_no, line."""
    return pages.filter(F.col("text").isNotNull()).select(
        "seg_id", "document", "page_number", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )


def solid_lines(pages: DataFrame) -> DataFrame:
    """The lines that are not blank, as ``lines_of`` gives them, with their place from both ends of the page and the line_no of their neighbours; no shuffle."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
    kept = pages.filter(F.col("text").isNotNull()).select("seg_id", "document", "page_number", F.filter(numbered, lambda x: x["line"].rlike(r"\S")).alias("l"))
    no = kept.withColumn("no", F.transform("l", lambda x: x["line_no"])).withColumn("n", F.size("l"))
    rows = no.select("seg_id", "document", "page_number", "no", "n", F.posexplode("l").alias("i", "x"))
    return rows.select(
        "seg_id", "document", "page_number", "x.line_no", "x.line", (F.col("i") + 1).alias("from_top"), (F.col("n") - F.col("i")).alias("from_bottom"),
        F.get("no", F.col("i") - 1).alias("before"), F.get("no", F.col("i") + 1).alias("after"),
    )


def _brief(line: Column) -> Column:
    """Whether a line can be a page number by its length: the longest has 20 characters that are not blank."""
    return F.length(F.translate(line, _BLANKS, "")) <= 20


def with_key(lines: DataFrame) -> DataFrame:
    """Adds key: what stays the same of a running line.  Codes, numbers, case, glyph noise and the order of its columns are masked.

    Step by step in columns of their own, so that each step is evaluated once and costly patterns only where they can match.
    """
    t = F.col("_t")
    out = lines.withColumn("_t", F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", r"\p{Lu}{2,}-?[0-9][0-9./-]*", "§")).otherwise(F.col("line")))
    number = lambda p: _brief(p) & (p.rlike(_PAGE_NUMBER) | p.rlike(r"(?iu)^[ivxlc]{1,6}$"))
    columns = F.transform(F.split(F.trim(t), r"\s{3,}"), lambda p: F.when(number(p), F.lit("#")).otherwise(p))
    out = out.withColumn("_t", F.when(t.rlike(r"\s{3}") | _brief(t), F.array_join(F.array_sort(columns), " ")).otherwise(F.trim(t)))
    out = out.withColumn("_t", skeleton(F.lower(F.when(t.rlike("[0-9]"), F.regexp_replace(t, "[0-9]+", "#")).otherwise(t))))
    out = out.withColumn("_t", F.translate(t, V.SPACE_CHARS, " " * len(V.SPACE_CHARS)))
    return out.withColumn("key", F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t)).drop("_t")


def _but_one(key: Column) -> Column:
    """Every way to leave one word of a key of two or more words open (as rows)."""
    w = F.split(key, " ")
    open_at = F.transform(w, lambda x, i: F.array_join(F.transform(w, lambda y, j: F.when(i == j, F.lit("*")).otherwise(y)), " "))
    return F.explode(F.when(F.size(w) >= 2, open_at).otherwise(F.array().cast("array<string>")))


def number_of(line: Column) -> Column:
    """The number a page-number line shows, in digits or Roman (an i may have been read as l), else null."""
    digits = F.translate(F.regexp_extract(line, _PAGE_NUMBER, 1), "lLiIoOsS", "11110055")
    roman = F.create_map(*(F.lit(x) for pair in _ROMAN.items() for x in pair))
    return F.coalesce(F.when(line.rlike(_PAGE_NUMBER), digits.cast("int")), F.when(line.rlike(_NUMERAL), roman[F.translate(F.lower(line), "l", "i")]))


def inner_numbers(solid: DataFrame, found: DataFrame) -> DataFrame:
    """Page numbers away from the edges of a page (seg_id, line_no), as they stand below a running header inside it.

    A number fits where it is the page's own or continues the numbers that stand at the edges of
    its file.  Beside a line that is ``found`` to be furniture it must fit or be labelled; elsewhere it must fit, and the page have
    no other number that does.
    """
    numbers = solid.filter("numeral").withColumn("shift", number_of(F.trim("line")) - F.col("page_number"))
    shifts = numbers.filter(F.col("edge") & F.col("shift").isNotNull()).groupBy("document", "shift").agg(F.count_distinct("seg_id").alias("on"))
    shifts = shifts.groupBy("document").agg(F.max_by("shift", "on").alias("usual"), F.max("on").alias("on")).filter("on >= 2").select("document", "usual")
    fits = F.coalesce((F.col("shift") == 0) | (F.col("shift") == F.col("usual")), F.lit(False))
    numbers = numbers.join(shifts, "document", "left").withColumn("fits", fits)
    numbered = numbers.filter(F.col("edge") & F.col("fits")).select("seg_id").distinct().withColumn("numbered", F.lit(True))
    inner = numbers.filter(~F.col("edge")).withColumn("at", F.explode(F.array("before", "after")))
    beside = inner.join(found.select("seg_id", F.col("line_no").alias("at")), ["seg_id", "at"], "left_semi").select("seg_id", "line_no").distinct().withColumn("beside", F.lit(True))
    inner = numbers.filter(~F.col("edge")).join(beside, ["seg_id", "line_no"], "left").join(numbered, "seg_id", "left")
    labelled = ~F.trim("line").rlike(r"^[\p{L}0-9]{1,6}$")
    return inner.filter(F.col("beside").isNotNull() & (F.col("fits") | labelled) | F.col("fits") & F.col("numbered").isNull()).select("seg_id", "line_no")


def furniture(solid: DataFrame, pages: DataFrame) -> DataFrame:
    """The lines (seg_id, line_no) that belong to the page: repeated headers and footers, page numbers, scanner marks.

    solid: the rows of ``keyed_lines``; pages: seg_id, document of every page.
    """
    of_file = pages.groupBy("document").agg(F.count("*").alias("pages"))
    repeats = (
        solid.filter(F.col("edge") & F.col("key").rlike(r"\p{L}{2,}"))
        .groupBy("document", "key")
        .agg(F.count_distinct("seg_id").alias("on"))
        .join(of_file, "document")
    )
    repeats = materialize(repeats, "scan_repeats")
    sentence = F.col("key").rlike(r"[.!?,;:”»]$")
    repeated = repeats.filter((F.col("on") >= 2) & (F.col("on") * 5 >= F.col("pages")) & ~sentence)
    # A key shared by many files is a scanner mark where it repeats on nearly every page, and a heading of the text where it doesn't.
    spread_of = (
        repeats.groupBy("key")
        .agg(
            F.count("*").alias("files"),
            F.sum(F.when((F.col("on") >= 2) & (F.col("on") * 5 >= F.col("pages") * 4), 1).otherwise(0)).alias("steady"),
            F.sum(F.when(F.col("pages") >= 2, 1).otherwise(0)).alias("several"),
        )
        .withColumn("mark", (F.col("files") >= 3) & (F.col("steady") * 2 >= F.col("several")) & (F.col("steady") >= 2))
        .withColumn("heading", (F.col("files") >= 3) & ~F.col("mark") & ~F.contains("key", F.lit("§")))
    )
    spread_of = materialize(spread_of.filter("mark or heading").select("key", "mark"), "scan_spread")
    marks = spread_of.filter("mark").select("key")
    own = repeated.join(spread_of.filter("not mark").select("key"), "key", "left_anti").select("document", "key")
    # A running title seen once in its file: it fits a title of other files but for one word, the file's own.
    titles = own.join(marks, "key", "left_anti").select("document", "key").distinct()
    ends = lambda c: F.array(F.concat(F.split(c, " ")[0], F.lit(" ")), F.concat(F.lit(" "), F.element_at(F.split(c, " "), -1)))
    fitting = titles.select("document", _but_one(F.col("key")).alias("fit")).groupBy("fit").agg(F.count_distinct("document").alias("files"))
    fitting = fitting.filter((F.col("files") >= 3) & (F.length(F.regexp_replace("fit", r"[^\p{L}]", "")) >= 8)).select("fit")
    fitting = materialize(fitting, "scan_titles")
    # Two keys that differ in one word share their first or their last one.
    known = fitting.select(F.explode(ends(F.col("fit"))).alias("end")).filter("trim(end) <> '*'").distinct()
    single = solid.filter(F.col("edge") & ~F.col("numeral") & ~sentence).select("seg_id", "line_no", "key", F.explode(ends(F.col("key"))).alias("end"))
    single = single.join(known, "end", "left_semi").select("seg_id", "line_no", "key").distinct()
    single = single.select("seg_id", "line_no", _but_one(F.col("key")).alias("fit")).join(fitting, "fit", "left_semi")
    cols = ["seg_id", "line_no"]
    by_file = solid.join(own, ["document", "key"], "left_semi")
    marked = solid.join(marks, "key", "left_semi")
    plain = solid.filter(F.col("edge") & F.col("numeral") | F.col("speck"))
    found = by_file.select(cols).union(single.select(cols)).union(marked.select(cols)).union(plain.select(cols)).distinct()
    found = materialize(found, "scan_found")
    return found.union(inner_numbers(solid, found)).distinct()


def keyed_lines(pages: DataFrame) -> DataFrame:
    """``solid_lines`` with key, edge (near an end of the page), numeral (a page number or may be one) and speck (no letter or digit)."""
    edge = (F.col("from_top") <= EDGE) | (F.col("from_bottom") <= EDGE)
    line = F.trim("line")
    return with_key(solid_lines(pages)).select(
        "seg_id", "document", "page_number", "line_no", "line", "key", edge.alias("edge"), "before", "after",
        (_brief(F.col("line")) & (line.rlike(_PAGE_NUMBER) | line.rlike(_NUMERAL))).alias("numeral"), (~F.col("line").rlike(r"[\p{L}\p{N}]")).alias("speck"),
    )


def token_counts(texts: DataFrame, text: str) -> DataFrame:
    """word (as written), next (lower-case word that only a blank or a hyphen separates from it, else null), hyphen (whether it is a hyphen), n: one pass over the corpus.

    The pieces are counted as they stand, what they mean is settled once per distinct pair.
    """
    tokens = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}0-9@|]+(?:[ " + _INNER + r"](?=[\p{L}0-9]))?"), F.lit(0))
    rows = texts.select(tokens.alias("t")).filter(F.size("t") > 0)
    rows = rows.select(F.explode(F.arrays_zip(F.col("t").alias("a"), F.slice("t", F.lit(2), F.size("t")).alias("b"))).alias("p"))
    raw = rows.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))
    ends = lambda c: reduce(Column.__or__, (F.endswith(c, F.lit(h)) for h in INNER_HYPHENS))
    bare = lambda c: F.rtrim(F.col(c), F.lit(INNER_HYPHENS + " "))
    ahead = F.when(F.endswith("a", F.lit(" ")) | ends("a"), F.lower(bare("b")))
    return raw.groupBy(bare("a").alias("word"), ahead.alias("next"), ends("a").alias("hyphen")).agg(F.sum("n").alias("n"))


def word_counts(counted: DataFrame) -> DataFrame:
    """w, n, n_low: lower-case words of the whole corpus, how often, and how often written in lower case."""
    return counted.groupBy(F.lower("word").alias("w")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("word") == F.lower("word"), F.col("n")).otherwise(0)).alias("n_low")
    )


def pair_counts(counted: DataFrame) -> DataFrame:
    """a, b, n, n_low: neighbouring lower-case words that only a blank separates, how often, and how often the first is written in lower case."""
    return counted.filter("next is not null and not hyphen").groupBy(F.lower("word").alias("a"), F.col("next").alias("b")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("word") == F.lower("word"), F.col("n")).otherwise(0)).alias("n_low")
    )


def named(words: DataFrame, names: DataFrame) -> DataFrame:
    """``words`` and name: whether a word of ``names`` (w), the words of proper names, is mostly written with a capital."""
    tagged = words.join(names.select("w", F.lit(True).alias("named")), "w", "left")
    return tagged.withColumn("name", F.coalesce("named", F.lit(False)) & (F.col("n_low") * 2 < F.col("n"))).drop("named")


def corrections(words: DataFrame, names: DataFrame) -> DataFrame:
    """w, right, n_right, rare: forms that recognition may have made of a frequent, ordinary one; several rows where several forms come into question.

    ``rare``: the form itself is next to nothing beside the other, which is then right unless the
    words around speak against it; any other form (a usual word, one of two letters) must have them speak for the
    other.  ``names`` (w): words of proper names, left alone.
    """
    tagged = named(words, names).select("w", "n", "n_low", "name", skeleton(F.col("w")).alias("sk"))
    forms = tagged.groupBy("sk").agg(F.count("*").alias("forms"), F.max("n").alias("most")).filter((F.col("forms") > 1) & (F.col("most") >= FREQUENT)).select("sk")
    tagged = materialize(tagged.join(forms, "sk"), "scan_forms")
    usable = F.col("w").rlike(r"^[\p{L}\p{M}]+$") & (F.col("n") >= FREQUENT)
    best = tagged.filter(usable).select("sk", F.col("w").alias("right"), F.col("n").alias("n_right"), F.col("name").alias("name_right"))
    # A form in lower case is no name, even if its correction also occurs in names.
    ordinary = ~F.col("name") & (~F.col("name_right") | (F.col("n_low") * 2 >= F.col("n")))
    both = tagged.filter(F.col("w").rlike(r"\p{L}")).join(best, "sk").filter((F.col("w") != F.col("right")) & ordinary)
    mixed = F.col("w").rlike("[0-9@|]")
    rare = (F.col("n_right") >= DOMINANCE * F.col("n")) & ((F.length("w") >= 3) | mixed)
    return both.select("w", "right", "n_right", rare.alias("rare"))


def joined_words(words: DataFrame, pairs: DataFrame, names: DataFrame) -> DataFrame:
    """w, right, n_right, rare: rare words that are two words run together, the pair being frequent on its own; see ``corrections``."""
    ordinary = pairs.filter(F.col("n") >= FREQUENT).select(F.concat("a", "b").alias("w"), F.concat_ws(" ", "a", "b").alias("right"), F.col("n").alias("n_right"))
    run = named(words, names).filter(~F.col("name")).join(ordinary, "w").filter(F.col("n_right") >= DOMINANCE * F.col("n"))
    return run.select("w", "right", "n_right", (F.length("w") >= 4).alias("rare"))


def split_words(words: DataFrame, pairs: DataFrame, names: DataFrame) -> DataFrame:
    """a, b, second, right, n_right, rare, low: neighbours that are one frequent ordinary word wrongly split, and whether b is the rarer of the two; see ``corrections``.

    Of a word that is mostly a name only the writings in lower case count, and only they are mended (``low``).
    """
    whole = named(words.filter(F.col("n") >= FREQUENT), names)
    whole = whole.select("w", F.col("name").alias("low"), F.when(F.col("name"), F.col("n_low")).otherwise(F.col("n")).alias("n_right")).filter(F.col("n_right") >= FREQUENT)
    part = words.select(F.col("w").alias("b"), F.col("n").alias("n_b"))
    other = words.select(F.col("w").alias("a"), F.col("n").alias("n_a"))
    n_pair = F.when(F.col("low"), F.col("n_low")).otherwise(F.col("n"))
    found = pairs.withColumn("w", F.concat("a", "b")).join(whole, "w").filter(F.col("n_right") >= DOMINANCE * n_pair)
    found = found.join(part, "b").join(other, "a")
    # One of the parts is hardly a word of its own, or the pair itself is very rare.
    hardly = F.least("n_a", "n_b") * 2 <= F.col("n_right")
    return found.filter(hardly).select("a", "b", (F.col("n_b") < F.col("n_a")).alias("second"), F.col("w").alias("right"), "n_right", (F.length("w") >= 4).alias("rare"), "low")


def doubted_pairs(usual: DataFrame, pairs: DataFrame) -> DataFrame:
    """w, b, right, n_right, at: neighbours w and b of which the first (at 0) or the second (at 1) is a usual word, where the neighbour
    stands DOMINANCE times as often beside ``right``, a form that recognition confuses with it.  Found by the counts of distinct pairs, so occurrences of usual words need not be looked at."""
    sides = pairs.select("n", F.explode(F.array(
        F.struct(F.lit(0).alias("at"), F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.lit(1).alias("at"), F.col("b").alias("word"), F.col("a").alias("near"))
    )).alias("s")).select("n", "s.*")
    heads = usual.withColumn("at", F.explode(F.array(F.lit(0), F.lit(1))))
    # The neighbour stands behind the last word of a form of two, and before its first.
    heads = heads.withColumn("other", F.when(F.col("at") == 0, F.substring_index("right", " ", -1)).otherwise(F.substring_index("right", " ", 1)))
    seen = sides.join(heads, (sides.word == heads.w) & (sides["at"] == heads["at"])).select("w", "near", heads["at"], "n", "right", "n_right", "other")
    better = sides.join(heads.select(F.col("other").alias("word"), "at").distinct(), ["word", "at"], "left_semi").select(
        F.col("word").alias("other"), "near", "at", F.col("n").alias("n_other")
    )
    hit = seen.join(better, ["other", "near", "at"]).filter(F.col("n_other") >= DOMINANCE * F.col("n"))
    first = F.col("at") == 0
    return hit.select(F.when(first, F.col("w")).otherwise(F.col("near")).alias("w"), F.when(first, F.col("near")).otherwise(F.col("w")).alias("b"), "right", "n_right", "at")


class Scan:
    """All findings about the scanned pages of one collection."""

    def __init__(self, scanned: DataFrame, corpus: DataFrame, names: DataFrame):
        """scanned: seg_id, document, page_number, text of scanned pages.  corpus: text of all pages
        (the statistics cover every one of them).  names: w, words of proper names in lower case."""
        self.pages = spread(scanned.dropDuplicates(["seg_id"]))
        solid = materialize(keyed_lines(self.pages), "scan_lines")
        numbered = scanned.filter(F.col("text").isNotNull()).select("seg_id", "document").distinct()
        self.furniture = materialize(furniture(solid, numbered), "scan_furniture")
        corpus = spread(corpus.filter(F.col("text").isNotNull()).select("text"))
        self.counted = materialize(token_counts(corpus, "text"), "scan_counts")
        self.words = materialize(word_counts(self.counted), "scan_words")
        self.pairs = materialize(pair_counts(self.counted), "scan_pairs")
        self.names = materialize(names.select("w").distinct(), "scan_names")
        in_page = Window.partitionBy("seg_id").orderBy("line_no")
        token = _WORD + r"(?: (?=[\p{L}\p{M}0-9@|]))?"
        end = f"([\\p{{L}}\\p{{M}}]+)[{HYPHENS}]{_BLANK}*$"
        divided = F.rtrim(F.col("line"), F.lit(V.SPACE_CHARS)).rlike(f"[{HYPHENS}]$")
        body = solid.join(self.furniture, ["seg_id", "line_no"], "left_anti").select(
            "seg_id", "document", "page_number", "line_no",
            F.when(divided, F.regexp_extract("line", end, 1)).otherwise(F.lit("")).alias("tail"),
            F.regexp_extract("line", f"^{_BLANK}*([\\p{{L}}\\p{{M}}]+)", 1).alias("head"),
            F.regexp_extract_all("line", F.lit(token), F.lit(0)).alias("t"),
        )
        body = body.withColumn("next", F.lead("head").over(in_page)).withColumn("next_no", F.lead("line_no").over(in_page))
        #: Every line of the text that is not furniture: its words t (a trailing blank tells that only it separates the next), tail (the
        #: first part of a word its end divides, or nothing), head (the word it begins with), and what follows on the page.
        self.body = materialize(body.withColumn("first", F.row_number().over(in_page) == 1), "scan_body")

    @cached_property
    def divided(self) -> DataFrame:
        return materialize(self.hyphens(), "scan_hyphens")

    @cached_property
    def fixes(self) -> DataFrame:
        return materialize(self.repairs(), "scan_repairs")

    def hyphens(self) -> DataFrame:
        """seg_id, line_no, next_no, a, b: lines that end in the first part of a word divided for the line break only."""
        first = self.body.filter("first").groupBy("document", "page_number").agg(F.min_by("head", "line_no").alias("ahead"))
        first = first.withColumn("page_number", F.col("page_number") - 1)
        rows = self.body.filter("tail <> ''").select("seg_id", "document", "page_number", "line_no", "next_no", "next", F.col("tail").alias("a"))
        rows = rows.join(first, ["document", "page_number"], "left").withColumn("b", F.coalesce("next", "ahead", F.lit("")))
        rows = rows.filter((F.col("b") != "") & ((F.col("b") == F.lower("b")) | (F.upper("a") == F.col("a"))))
        rows = rows.select("seg_id", "line_no", "next_no", "a", "b", F.lower(F.concat("a", "b")).alias("w"))
        whole = self.words.select("w", F.col("n").alias("n_whole"))
        kept = rows.join(whole, "w", "left").join(self.compounds(), [F.lower("a") == F.col("ca"), F.lower("b") == F.col("cb")], "left")
        n_whole, n_comp = F.coalesce("n_whole", F.lit(0)), F.coalesce("n_compound", F.lit(0))
        return kept.filter((n_whole > n_comp) | (n_comp == 0)).select("seg_id", "line_no", "next_no", "a", "b")

    def compounds(self) -> DataFrame:
        """ca, cb, n_compound: words written with a hyphen inside a line, over all pages, as the words they are weighed against."""
        letters = r"^[\p{L}\p{M}]+$"
        parts = self.counted.filter("hyphen and next is not null").filter(F.col("word").rlike(letters) & F.col("next").rlike(letters))
        return parts.groupBy(F.lower("word").alias("ca"), F.col("next").alias("cb")).agg(F.sum("n").alias("n_compound"))

    def verdicts(self) -> DataFrame:
        """w, off, a, b, at, right, n_right, rare, low: what may be wrong with a word w (b null), with neighbours a and b as one word (at null) or with one of them (at 0 or 1).

        w, the word by which a line is found, is the rarer or the doubted one of two; off is its place among them.
        """
        single = materialize(corrections(self.words, self.names).union(joined_words(self.words, self.pairs, self.names)), "scan_forms_in_question")
        none = F.lit(None)
        rare = single.filter("rare").select("w", F.lit(0).alias("off"), none.cast("string").alias("a"), none.cast("string").alias("b"), F.lit(0).alias("at"), "right", "n_right", "rare", F.lit(False).alias("low"))
        doubted = doubted_pairs(single.filter("not rare").select("w", "right", "n_right"), self.pairs)
        doubted = doubted.select(F.when(F.col("at") == 0, F.col("w")).otherwise(F.col("b")), "at", "w", "b", "at", "right", "n_right", F.lit(False).alias("rare"), F.lit(False).alias("low"))
        split = split_words(self.words, self.pairs, self.names).select(
            F.when(F.col("second"), F.col("b")).otherwise(F.col("a")), F.col("second").cast("int"), "a", "b", none.cast("int").alias("at"), "right", "n_right", "rare", "low"
        )
        return materialize(rare.union(doubted).union(split), "scan_verdicts")

    def candidates(self) -> DataFrame:
        """seg_id, line_no, i (place of the first word), wrong, right, n_right, rare, one, two (first and last word as written), before, behind (their neighbours)."""
        # The parts of divided words are settled per line, before the words are taken apart.
        cut = self.divided.select("seg_id", "line_no", F.lit(1).alias("ends"), F.lit(0).alias("starts"))
        after = self.divided.filter("next_no is not null").select("seg_id", F.col("next_no").alias("line_no"), F.lit(0).alias("ends"), F.lit(1).alias("starts"))
        edges = cut.union(after).groupBy("seg_id", "line_no").agg(F.max("ends").alias("ends"), F.max("starts").alias("starts"))
        words = self.body.select("seg_id", "line_no", F.posexplode("t").alias("k", "o")).select("seg_id", "line_no", "k", F.lower(F.rtrim("o")).alias("w"))
        hits = materialize(words.join(self.verdicts(), "w"), "scan_hits")
        # Only where a word is in question the line is looked at again.
        rows = self.body.select("seg_id", "line_no", "t").join(hits, ["seg_id", "line_no"]).join(edges, ["seg_id", "line_no"], "left")
        at = lambda c: F.get("t", c)
        lo, hi = F.coalesce("starts", F.lit(0)), F.size("t") - F.coalesce("ends", F.lit(0))
        inside = lambda c: (c >= lo) & (c < hi)
        blank = lambda c: F.endswith(at(c), F.lit(" ")) & inside(c)
        ahead = lambda c: F.when(blank(c) & inside(c + 1), F.lower(F.rtrim(at(c + 1))))
        k = F.col("k")
        rows = rows.withColumn("k", k - F.col("off")).filter(inside(k))
        rows = rows.filter(F.col("b").isNull() | (F.lower(F.rtrim(at(k))) == F.col("a")) & (ahead(k) == F.col("b")))
        # Places of the first and the last word that is wrong.
        rows = rows.withColumn("i", k + F.coalesce("at", F.lit(0))).withColumn("j", F.when(F.col("at").isNull(), k + 1).otherwise(F.col("i")))
        i, j = F.col("i"), F.col("j")
        wrong = F.when(i == j, F.rtrim(at(i))).otherwise(F.concat_ws(" ", F.rtrim(at(i)), F.rtrim(at(j))))
        rows = rows.withColumn("wrong", wrong).filter(~F.col("low") | (F.col("wrong") == F.lower("wrong")))
        return rows.select(
            "seg_id", "line_no", "i", "wrong", "right", "n_right", "rare", F.lower(F.rtrim(at(i))).alias("one"), F.lower(F.rtrim(at(j))).alias("two"),
            F.when(blank(i - 1), F.lower(F.rtrim(at(i - 1)))).alias("before"), ahead(j).alias("behind"),
        )

    def repairs(self) -> DataFrame:
        """seg_id, line_no, wrong, right: misrecognised, wrongly split and run-together ordinary words.

        Of the forms that come into question the one is right that the neighbouring words support most: how often it
        stands beside them over the whole corpus, against how often the written form does.
        """
        rows = materialize(self.candidates(), "scan_candidates")
        ask = lambda a, b, own: F.struct(a.alias("a"), b.alias("b"), F.lit(own).alias("own"))
        head, tail = F.substring_index("right", " ", 1), F.substring_index("right", " ", -1)
        asked = F.array(
            ask(F.col("before"), F.col("one"), True), ask(F.col("two"), F.col("behind"), True),
            ask(F.col("before"), head, False), ask(tail, F.col("behind"), False),
        )
        key = ["seg_id", "line_no", "i", "wrong", "right"]
        said = rows.select(*key, F.explode(asked).alias("q")).select(*key, "q.*").filter("a is not null and b is not null").distinct()
        said = said.join(self.pairs.select("a", "b", "n"), ["a", "b"])
        said = said.groupBy(*key).agg(
            F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("for_own"), F.sum(F.when(~F.col("own"), F.col("n")).otherwise(0)).alias("for_right"),
            F.sum(F.when(F.col("own") & (F.col("n") >= FREQUENT), 1).otherwise(0)).alias("sides"),
        )
        judged = rows.join(said, key, "left").select(*key, "n_right", "rare", F.coalesce("for_own", F.lit(0)).alias("own"), F.coalesce("for_right", F.lit(0)).alias("other"), F.coalesce("sides", F.lit(0)).alias("sides"))
        # A rare form stands as written where it is at home on both sides and the other form on none.
        against = (F.col("sides") == 2) & (F.col("other") == 0)
        backed = (F.col("other") >= FREQUENT) & (F.col("other") >= DOMINANCE * F.col("own"))
        judged = judged.filter(F.when(F.col("rare"), ~against).otherwise(backed))
        return judged.groupBy("seg_id", "line_no", "i", "wrong").agg(F.max_by("right", F.struct("other", "n_right", "right")).alias("right")).select("seg_id", "line_no", "wrong", "right")

    def findings(self) -> DataFrame:
        """seg_id, line_no, kind ('furniture', 'hyphen' or 'misread')."""
        f = self.furniture.select("seg_id", "line_no", F.lit("furniture").alias("kind"))
        h = self.divided.select("seg_id", "line_no", F.lit("hyphen").alias("kind"))
        m = self.fixes.select("seg_id", "line_no", F.lit("misread").alias("kind"))
        return f.union(h).union(m.distinct()).select("seg_id", F.col("line_no").cast("int").alias("line_no"), "kind").distinct()

    def paragraphs(self) -> DataFrame:
        """seg_id, para_no, text: the repaired running text of every page, one row per paragraph.

        A paragraph ends at a blank line, or where the page ends.  Pages without text give no rows.
        """
        fixes = self.fixes.distinct().groupBy("seg_id", "line_no").agg(F.sort_array(F.collect_list(F.struct("wrong", "right"))).alias("fixes"))
        gone = self.furniture.withColumn("page_only", F.lit(True))
        cut = self.divided.select("seg_id", "line_no", F.lit(True).alias("divided"))
        rows = lines_of(self.pages).join(gone, ["seg_id", "line_no"], "left").filter("page_only is null").join(fixes, ["seg_id", "line_no"], "left").join(cut, ["seg_id", "line_no"], "left")
        mended = F.aggregate(F.coalesce("fixes", F.array().cast("array<struct<wrong:string,right:string>>")), F.col("line"), lambda t, x: F.replace(t, x["wrong"], x["right"]))
        body = F.trim(F.regexp_replace(mended, _BLANK + "+", " "))
        body = F.when(F.col("divided"), F.regexp_replace(body, f"[{HYPHENS}]$", "")).otherwise(F.concat(body, F.lit(" ")))
        run = Window.partitionBy("seg_id").orderBy("line_no")
        rows = rows.withColumn("blank", ~F.col("line").rlike(r"\S")).withColumn("para_no", F.sum(F.col("blank").cast("int")).over(run)).filter("not blank")
        texts = rows.groupBy("seg_id", "para_no").agg(F.sort_array(F.collect_list(F.struct("line_no", body.alias("t")))).alias("parts"))
        rank = Window.partitionBy("seg_id").orderBy("para_no")
        return texts.select(
            "seg_id", F.row_number().over(rank).alias("para_no"), F.trim(F.array_join(F.transform("parts", lambda p: p["t"]), "")).alias("text")
        )
