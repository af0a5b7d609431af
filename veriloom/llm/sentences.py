"""Sentence boundaries across languages and scripts, all in SQL expressions.

Periods that end nothing (decimals, URLs, initials, abbreviations, list
numbers, ordinals, ellipses) and terminators inside a running quotation are
masked with private-use characters of the same length; script-specific
terminator patterns then set break marks, and the pieces between the marks are
the sentences.  Because no mask changes a length, positions in the masked text
are positions in the stored text, and restoring is a substring.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions import vocab as V
from veriloom.llm.variants import GIVEN_NAMES

DOT, BREAK, HOLD = chr(0xE000), chr(0xE001), chr(0xE002)  # private use

# Abbreviations that are followed by what they announce and never end a sentence.
TITLES = "Dr Mr Mrs Ms Prof St Sr Sra Srta Hr Rev Hon Capt Sgt Ing डॉ श्री प्रो".split()
LEADING = "vs cf vgl bzw ca approx aprox avda ref incl inkl evtl см ул тыс кв resp".split()
# Abbreviations that announce a number.
NUMBERED = "nr nos n p pp vol art sec fig figs abb bl рис стр pág ch h par ziff".split()
COMPANY = "Ltd Inc Corp Co Bros".split()
# German words before an ordinal and month names after one.
BEFORE_ORDINAL = "am Am vom Vom zum Zum im Im bis Bis ab Ab den dem der des".split()
MONTHS_DE = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()
# Function words that open a sentence, so a full stop before them is one.
STARTERS = (
    "The An Nobody No He She It They We You This That These Those There But And However Further In On At After Before When Who Did Was "
    "Were Is See According Neither Die Der Das Ein Eine Es Er Sie Wir Wer Le La Les Un Une Il Elle Qui El Los Las Una Quién"
).split()

# Given names cut to three letters.
CUT_GIVEN = sorted({e.partition(":")[0][:3].title() for e in GIVEN_NAMES})

_WS = "[" + V.SPACE_CHARS + "]"
_NOT_IN_WORD = r"(?<![\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{M}\p{N}])"


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def _step(t: Column, sign: Callable[[Column], Column] | list[str], pattern: str, to: str) -> Column:
    """Replace a pattern in texts that show a sign of it: one of some texts, or what a function of the text tells.

    Looking for a sign costs a fraction of a pattern.  The one-element transform names the text once; a plain CASE would repeat the whole chain.
    """
    shows = (lambda x: reduce(Column.__or__, (F.contains(x, F.lit(w)) for w in sign))) if isinstance(sign, list) else sign
    return F.transform(F.array(t), lambda x: F.when(shows(x), F.regexp_replace(x, pattern, to)).otherwise(x))[0]


def _mask_quoted(t: Column, opening: str, closing: str, others: str) -> Column:
    """Mask the terminators of quotations of any length, unless nothing but the closing mark follows: what an opening mark and the next mark, a closing one, enclose."""
    def inside(piece: Column) -> Column:
        q = F.regexp_extract(piece, f"^[^{others}]++(?={closing})", 0)
        masked = F.regexp_replace(q, r"[.!?。！？।؟](?=[^\p{L}]*+\p{L})", DOT)
        return F.concat(masked, F.substr(piece, F.length(q) + 1))

    def paired(x: Column) -> Column:
        return F.array_join(F.transform(F.split(x, opening), lambda p, i: F.when((i > 0) & p.rlike(r"[.!?。！？।؟]"), inside(p)).otherwise(p)), opening)

    both = lambda x: F.contains(x, F.lit(opening)) & F.contains(x, F.lit(closing))
    return F.transform(F.array(t), lambda x: F.when(both(x), paired(x)).otherwise(x))[0]


def mask(text: Column) -> Column:
    """The text with every mark that ends no sentence replaced by a placeholder of the same length."""
    sub = F.regexp_replace
    t = _step(text, [".."], r"\.(?=\.)|(?<=\.)\.(?=" + _WS + r"+\p{Ll})", DOT)  # dots of an ellipsis but the last
    # Two full stops are an abbreviation and an end; three are an ellipsis, which ends nothing before more text.
    t = _step(t, [DOT + DOT], f"(?<={DOT}{DOT})\\.(?={_WS}*\\S)", DOT)
    t = sub(t, r"(?<=[0-9])[.](?=[0-9])", DOT)
    t = _step(t, ["www", "//"], r"((?:www|//|\G(?!^))[^\s.!?]*+)[.!?](?=[^\s])", "$1" + DOT)
    # Single letters: initials, "e.g.", "z. B."
    t = sub(t, r"\.(?=" + _WS + r"?\p{L}[." + DOT + "])(?<=" + _NOT_IN_WORD + r"\p{L}\.)", DOT)
    t = _step(t, [DOT], f"\\.(?<={_NOT_IN_WORD}\\p{{L}}{DOT}{_WS}?\\p{{L}}\\.)", DOT)
    # Abbreviations that never end a sentence, and capital letters.
    t = sub(t, f"\\.(?<={_NOT_IN_WORD}(?:\\p{{Lu}}|{'|'.join(TITLES + LEADING)})\\.)", DOT)
    t = sub(t, f"(?iu)\\.(?={_WS}*[0-9])(?<={_NOT_IN_WORD}{_any(NUMBERED)}\\.)", DOT)
    # "no." is also an answer: before the number of the next list item it ends a sentence.
    t = _step(t, ["no.", "No.", "NO."], f"(?i)\\.(?={_WS}*[0-9]+(?![0-9]|\\.{_WS}+\\p{{Lu}}))(?<={_NOT_IN_WORD}no\\.)", DOT)
    t = _step(t, [w + "." for w in COMPANY], f"\\.(?={_WS}+(?!\\p{{Ll}}-?\\p{{Lu}})[\\p{{Ll}}\\p{{Lo}}])(?<={_any(COMPANY)}\\.)", DOT)
    # Letters that follow a surname and a comma may end a sentence.
    t = _step(
        t, [DOT],
        f"(\\p{{L}},{_WS}(?:\\p{{Lu}}{DOT}{_WS}?)*\\p{{Lu}}){DOT}(?={_WS}+[“\"«„(]?(?:\\p{{Lu}}(?![.{DOT}])|[0-9]{{1,3}}[.)]))",
        "$1.",
    )
    starters = f"(?:{_any(STARTERS)}(?![\\p{{L}}.{DOT}]))"
    t = _step(t, [DOT], f"{DOT}(?={_WS}+{starters})(?<=(?:[ap]{DOT}{_WS}?m|{_NOT_IN_WORD}\\p{{Lu}}){DOT})", ".")
    # A given name cut to three letters, unless a capitalised word (a name it would close) stands before it.
    name = f"{_any(CUT_GIVEN)}"
    follows = f"\\.(?={_WS}(?!{starters})\\p{{Lu}}\\p{{Ll}})"

    def names(x: Column) -> Column:
        held = F.regexp_replace(x, f"((?<![\\p{{IsLatin}}’'-])(?!{_any(STARTERS)}{_WS})[A-ZÀ-Þ][\\p{{IsLatin}}\\p{{M}}’'-]*+{_WS}{name}|[0-9]{_WS}{name})\\.", "$1" + HOLD)
        done = F.regexp_replace(held, f"(?<!\\p{{IsLatin}})({name}){follows}", "$1" + DOT)
        return F.translate(done, HOLD, ".")

    t = F.transform(F.array(t), lambda x: F.when(x.rlike(f"{follows}(?<=(?<!\\p{{IsLatin}}){name}\\.)"), names(x)).otherwise(x))[0]
    # Numbers that open a line or a sentence, and ordinals.
    t = sub(t, r"(?m)^([ \t]*(?:[0-9]{1,3}|[IVXLC]{1,5}))\.(?=" + _WS + ")", "$1" + DOT)
    item = r"\.(?=" + _WS + r"+[\p{L}“\"«„])"
    t = _step(t, lambda x: x.rlike(r"(?<=[0-9])" + item), r"([.!?…。！？।”“»\")\]]" + _WS + r"+[0-9]{1,3})" + item, "$1" + DOT)
    ordinal = f"\\.(?={_WS})(?<=[0-9]\\.)(?:(?<={_NOT_IN_WORD}{_any(BEFORE_ORDINAL)}{_WS}[0-9]{{1,2}}\\.)|(?={_WS}+{_any(MONTHS_DE)}(?!\\p{{L}}))(?<={_NOT_IN_WORD}[0-9]{{1,2}}\\.))"
    t = sub(t, ordinal, DOT)
    # Terminators inside a quotation.
    for opening, closing, others in (("“", "”", "“”„"), ("«", "»", "«»"), ("「", "」", "「」"), ("『", "』", "『』"), ("„", "“", "„“”")):
        t = _mask_quoted(t, opening, closing, others)
    return t


def mark_breaks(masked: Column) -> Column:
    """A break mark after every piece that ends a sentence, and around blank lines."""
    sub = F.regexp_replace
    closers = f"(?:[\"”“’'»)\\]]|{_WS}?»)*"
    opening = f"(?:[\"“„«(\\[‘'¿¡—–*•-]{_WS}?)*"
    caseless = r"\p{IsDevanagari}\p{IsArabic}\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
    starts = f"(?:\\p{{Lu}}|\\p{{Lt}}|\\p{{N}}|\\p{{Ll}}-?\\p{{Lu}}|[{caseless}])"
    t = sub(masked, f"([.!?؟۔]+{closers})(?={_WS}+{opening}{starts})", "$1" + BREAK)
    # The blank after the full stop is missing.
    t = sub(t, r"((?<=[\p{Ll}\p{N})])[.!?]+)(?=[¿¡«“„(]{0,2}\p{Lu}\p{Ll})", "$1" + BREAK)
    t = _step(t, ["؟", "۔"], f"([؟۔]+)(?=[^{V.SPACE_CHARS}\"”»)])", "$1" + BREAK)
    t = _step(t, ["।", "॥"], f"([।॥]+{closers})(?!{BREAK})", "$1" + BREAK)
    # Scripts without blanks: quotation and bracket ends go on unless white space follows.
    t = _step(t, ["。", "！", "？"], r"([。！？]+)(?![。！？」』）”’》\])])", "$1" + BREAK)
    t = _step(t, ["。", "！", "？"], r"([。！？]+[」』）”’》\])]+)(?=\s)", "$1" + BREAK)
    t = _step(t, lambda x: x.rlike("[\u0e00-\u0e7f]"), r"(?<=[฀-๿])(?=\s+[฀-๿])", BREAK)
    return _step(t, ["\n"], r"(\n[ \t\r\x{A0}]*\n)", BREAK + "$1")


def sentence_units(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_char, end_char): one row per sentence of every text.

    Offsets count code points from 0; start is the first and end the position after the last
    non-blank character.  Null, empty and blank texts give no rows, repeated
    keys give their sentences once per row, texts are processed whole.  Other columns do
    not matter and are not carried.
    """
    whole = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("__k"), F.col(text).alias("__t"), F.monotonically_increasing_id().alias("__r"))
    whole = whole.withColumn("__t", F.translate("__t", DOT + BREAK + HOLD, "���"))
    pieces = whole.select("__k", "__r", F.posexplode(F.split(mark_breaks(mask(F.col("__t"))), BREAK)).alias("__i", "__p"))
    head = F.length("__p") - F.length(F.ltrim("__p", F.lit(V.SPACE_CHARS)))
    body = F.length(F.btrim("__p", F.lit(V.SPACE_CHARS)))
    sized = pieces.select("__k", "__r", "__i", F.length("__p").alias("__n"), head.alias("__h"), body.alias("__b"))
    before = Window.partitionBy("__k", "__r").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("__n").over(before), F.lit(0)) + F.col("__h")
    return (
        sized.withColumn("__s", start)
        .filter("__b > 0")
        .select(F.col("__k").alias(key), F.col("__s").cast("int").alias("start_char"), (F.col("__s") + F.col("__b")).cast("int").alias("end_char"))
    )
