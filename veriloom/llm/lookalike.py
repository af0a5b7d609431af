"""One common form for texts that look the same.

Steps: compatibility forms of width, ligature and spacing are normalised,
ignorable characters deleted, accents taken off their letters, and every word becomes a lattice whose positions
hold all letters that share the glyph.  A Viterbi search takes the best path
under character bigram scores in which both letters belong to one script.  For most glyphs
the lattice holds one class of letters, so two words that look the same always get the same path; a
stroke that may be one of several letters (a small palochka is drawn as l or as I) is
read by the search as the letter that fits its neighbours.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.functions import vocab as V
from veriloom.session import materialize

# Letters of several scripts drawn with the same glyph, without accents; one class per entry.
GLYPH_CLASSES = (
    "AΑАᎪᗅꓮ BΒВᏴꓐ CϹСᏟꓚ DᎠꓓ EΕЕᎬꓰ FꓝϜ GᏀꓖ HΗНᎻꓧ IΙІӀꓲ JЈᎫꓙ KΚКᏦꓗ LᏞꓡ MΜМᎷꓟ NΝꓠ OΟОՕꓳ PΡРᏢꓑ QԚ RᎡꓣ SЅՏᏚꓢ TΤТᎢꓔ UՍꓴ VᏙꓦ WԜᎳꓪ XΧХꓫ YΥҮꓬ ZΖᏃꓜ "
    "ΓГ ΛЛ ΠП ΦФ aаɑ cϲсᴄⲥ dԁ eе gɡց hһհ iі jϳј oοоօᴏⲟ pрⲣ qԛ sѕꜱ uս vѵνᴠ wԝᴡ xх yу zᴢ"
).split()
# Strokes that stand for one of several letters, and those letters.
SEVERAL = {"ӏ": "ӏlIІ", "ǀ": "ǀlIІ"}
# Strokes drawn alike.
SAME_STROKE = {"‐": "-", "‑": "-", "−": "-", "﹣": "-", "－": "-"}
# Compatibility classes that change what a reader sees (raised, lowered, circled, stacked forms).
_VISIBLE_TAGS = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>")


def _class_table() -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for entry in GLYPH_CLASSES:
        members = sorted(set(entry))
        known = [out[m] for m in members if m in out]
        merged = tuple(sorted({*members, *(x for k in known for x in k)}))
        for m in merged:
            out[m] = merged
    return {k: v for k, v in out.items() if len(v) > 1}


def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(c): None for c in V.INVISIBLE_CHARS}
    for cp in range(0x80, 0x30000):
        ch = chr(cp)
        if cp in table or 0xD800 <= cp < 0xE000:
            continue
        parts = unicodedata.decomposition(ch)
        if not parts:
            continue
        if parts.startswith("<"):
            if not parts.startswith(_VISIBLE_TAGS):
                table[cp] = unicodedata.normalize("NFKD", ch)
        elif len(parts.split()) == 1:
            table[cp] = unicodedata.normalize("NFC", ch)
    for a, b in SAME_STROKE.items():
        table[ord(a)] = b
    for c in V.SPACE_CHARS:
        if ord(c) > 0x7F and c not in "  \x85":
            table[ord(c)] = " "
    return table


CLASSES = _class_table()


def _lattice() -> dict[str, tuple[str, ...]]:
    """What a letter may be read as: its own class, or all classes of a stroke that may be several letters."""
    out = dict(CLASSES)
    for stroke, letters in SEVERAL.items():
        out[stroke] = tuple(sorted({x for c in letters for x in CLASSES.get(c, (c,))}))
    return out


LATTICE = _lattice()
_SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "LISU", "COPTIC")


@lru_cache(maxsize=1)
def _folds() -> dict[int, str | None]:
    return _fold_table()


@lru_cache(maxsize=4096)
def script(ch: str) -> str:
    name = unicodedata.name(ch, "")
    for s in _SCRIPTS:
        if name.startswith(s):
            return s
    return ""


def fold(text: str) -> str:
    """Width, ligatures, spacing, invisible characters and composition only."""
    return unicodedata.normalize("NFC", text.translate(_folds()))


class Reader:
    """Best path through the look-alike lattice of a word."""

    CROSS = -40.0  # a pair of letters of two scripts
    UNSEEN = -12.0
    ROOM = 300_000  # pieces and words remembered

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.pieces: dict[str, str] = {}
        self.words: dict[str, str] = {}
        self.pairs: dict[tuple[str, str], float] = {}
        # Of a class the letters that the corpus uses come into question, or all if it uses none.
        seen = {c for pair in scores for c in pair}
        self.lattice = {k: tuple(c for c in v if c in seen) or v for k, v in LATTICE.items()}

    def _pair(self, a: str, b: str) -> float:
        s = self.pairs.get((a, b))
        if s is None:
            sa, sb = script(a), script(b)
            s = self.pairs[a, b] = self.CROSS if sa and sb and sa != sb else self.scores.get(a + b, self.UNSEEN)
        return s

    def word(self, w: str) -> str:
        """The best spelling of a folded word, accents on the letters they stand on."""
        done = self.words.get(w)
        if done is not None:
            return done
        letters: list[str] = []
        marks: list[str] = []
        for ch in w if w.isascii() else unicodedata.normalize("NFD", w):
            if ch > "\x7f" and unicodedata.combining(ch) and letters:
                marks[-1] += ch
            else:
                letters.append(ch)
                marks.append("")
        pair, lattice = self._pair, self.lattice
        best = [("^", 0.0, "")]
        for ch in letters:
            step = []
            for c in lattice.get(ch, (ch,)):
                # Equal scores are settled by the spelling itself, so the choice is reproducible.
                s, path = max([(s + pair(p, c), path) for p, s, path in best]) if len(best) > 1 else (best[0][1] + pair(best[0][0], c), best[0][2])
                step.append((c, s, path + c))
            best = step
        out = max([(s + pair(p, "$"), path) for p, s, path in best])[1]
        done = unicodedata.normalize("NFC", "".join(map("".join, zip(out, marks)))) if any(marks) or not w.isascii() else out
        if len(self.words) < self.ROOM:
            self.words[w] = done
        return done

    # Words of the scripts that have look-alikes; other letters have one reading.
    _letters = re.compile("[A-Za-z\u00c0-\u024f\u0250-\u02af\u0370-\u058f\u13a0-\u13ff\u1d00-\u1d7f\u1e00-\u1fff\u2c80-\u2cff\ua4d0-\ua4ff\ua640-\ua69f\ua720-\ua7ff][A-Za-z\u00c0-\u02af\u0300-\u058f\u13a0-\u13ff\u1d00-\u1d7f\u1e00-\u1fff\u2c80-\u2cff\ua4d0-\ua4ff\ua640-\ua69f\ua720-\ua7ff]*")

    def piece(self, t: str) -> str:
        """What stands between two blanks; the work is done once per distinct piece while the cache has room."""
        done = self.pieces.get(t)
        if done is None:
            done = self._letters.sub(lambda m: self.word(m[0]), t if t.isascii() else fold(t))
            if len(self.pieces) < self.ROOM:
                self.pieces[t] = done
        return done

    def text(self, t: str) -> str:
        # No character composes with a blank, so pieces can be folded on their own.
        return " ".join(map(self.piece, t.split(" ")))


_WORD = r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]+"
_PURE = r"^(?:\p{IsLatin}+|\p{IsCyrillic}+|\p{IsGreek}+)$"


def _bare_letters() -> tuple[str, str]:
    """Accented letters of the three scripts and the letters under their accents."""
    pairs = [(chr(cp), unicodedata.normalize("NFD", chr(cp))[0]) for cp in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)) if unicodedata.decomposition(chr(cp))]
    pairs = [(a, b) for a, b in pairs if b.isalpha() and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def bigram_scores(df: DataFrame, text: Column) -> dict[str, float]:
    """Log probabilities of pairs of bare letters over all words that are written in one script.

    Counted in the cluster over every text, what stands between blanks first and words of that, so a pair table is all
    that reaches the driver.  Its size is bounded by the squared number of letters of the
    three scripts (a few thousand pairs in practice), not by the data.
    """
    pieces = df.select(F.explode(F.split(F.coalesce(text, F.lit("")), " ")).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    words = pieces.select("n", F.explode(F.regexp_extract_all("c", F.lit(_WORD), F.lit(0))).alias("w"))
    words = words.filter(F.col("w").rlike(_PURE)).select("n", F.translate("w", *_bare_letters()).alias("w")).groupBy("w").agg(F.sum("n").alias("n"))
    marked = F.concat(F.lit("^"), "w", F.lit("$"))
    pairs = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") + 1), lambda i: F.substr(marked, i, F.lit(2)))).alias("p"))
    rows = pairs.groupBy("p").agg(F.sum("n").alias("n")).collect()
    ahead: dict[str, int] = {}
    for r in rows:
        ahead[r.p[0]] = ahead.get(r.p[0], 0) + r.n
    starts: dict[str, int] = {}
    for r in rows:  # a word start is scored within its script, so a rare script isn't punished for being rare
        if r.p[0] == "^":
            starts[script(r.p[1])] = starts.get(script(r.p[1]), 0) + r.n
    return {r.p: math.log(r.n / (starts[script(r.p[1])] if r.p[0] == "^" else ahead[r.p[0]])) for r in rows}


def common_form(df: DataFrame, text: str, out: str = "form", scores: dict[str, float] | None = None) -> DataFrame:
    """``df`` with ``out``: the common form of column ``text``.

    Null stays null, empty and blank texts are kept as they fold.  Other columns
    pass through untouched; an existing column named ``out`` is replaced.  Texts
    are processed whole, whatever their length.
    """
    scores = bigram_scores(df, F.col(text)) if scores is None else scores
    df = df.drop(out)
    shared = df.sparkSession.sparkContext.broadcast(scores)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for b in batches:
            made = [None if t is None else reader.text(t) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


def same_look_pairs(df: DataFrame, key: str, text: str, id_a: str, id_b: str) -> DataFrame:
    """Pairs of keys, smaller first, of texts that look the same and differ as stored.

    Null, empty and blank texts are no cases.  Only digests are shuffled.  Forms
    with one stored version leave before the join, so groups of plain copies cost
    nothing however large they are; the remaining pairs are the required result.
    """
    texts = df.select(F.col(key).alias("__k"), F.col(text).alias("__text")).filter(F.col("__k").isNotNull() & F.col("__text").isNotNull())
    formed = common_form(texts, "__text", "__form").filter(~F.col("__form").rlike(r"^\s*$"))
    keyed = formed.select("__k", F.md5("__form").alias("f"), F.md5("__text").alias("t"))
    keyed = materialize(keyed, "lookalike_keys")
    several = keyed.groupBy("f").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo <> hi").select("f")
    kept = keyed.join(several, "f", "left_semi")
    other = kept.select("f", F.col("t").alias("t2"), F.col("__k").alias("k2"))
    pairs = kept.join(other, "f").filter((F.col("t") != F.col("t2")) & (F.col("__k") < F.col("k2")))
    return pairs.select(F.col("__k").alias(id_a), F.col("k2").alias(id_b)).distinct()
