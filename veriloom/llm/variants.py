"""Variant spellings of persons and organisations by a pigeonhole segment join.

A name is parsed into the parts people vary (given name or initials, surname;
stem, kind and number of an organisation).  The part that carries identity is
cut into k + 1 segments; two spellings within k edits share at least one
segment, shifted by a bounded number of places, so an equi-join of segments
with position-shifted substrings finds every pair.  Candidates are verified
with a banded edit distance and the other parts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import text as X
from veriloom.functions import vocab as V
from veriloom.session import materialize

# Given names with their short forms (public knowledge).
GIVEN_NAMES = """
alexander:alex,sandy,xander,lex augustus:gus,august alice anna:annie,ann andrew:andy,drew anthony:tony benjamin:ben,benny catherine:cathy
charles:charlie,chuck charlotte:lottie,lotte,charlie,lotty christopher:chris,kit,topher christina:tina daniel:dan,danny david:dave,davy
deborah:debbie,deb dorothea:dora,thea,dot,dolly edward:ed,eddie,ted,ned elizabeth:liz,beth,eliza,lizzie,betty,bess,libby,elsie eleanor:nell,nora,ellie emily
frederick:fred,freddie,freddy,fritz francis:frank george gabriel:gabe,gabi gregory:greg henrietta:etta,hattie,hetty,henny henry:harry,hank isabella:bella,izzy,isa,belle
jacob:jake james:jim,jimmy jennifer:jen,jenny john:jack,johnny jonathan:jon josephine:jo,josie,josy,fina joseph:joe,joey katherine:kate,kathy,katie,kay,kit,kitty,kat
laurence:larry leopold:leo,poldi lawrence:larry louise:lou margaret:maggie,meg,peggy,greta,marge,madge maria:mary matthew:matt michael:mike,mick nathaniel:nat,nate,nathan nicholas:nick
oliver:ollie,noll patricia:pat,patty penelope:penny,pen,nell peter:pete philippa:pip,pippa,philly philip:phil quentin:quin,quint,quen rebecca:becky richard:rick,dick,rich,richie,ricky
robert:rob,bob,bobby,robbie,bert samuel:sam,sammy samantha sarah:sally,sadie stephen:steve susan:sue theodore:theo,ted,teddy,dory thomas:tom,tommy tobias:toby,tobe ursula:ulla,ursel,uschi,sula
victoria:vicky,vic,tori,vickie vincent:vince walter:walt,wally wilhelmina:mina,minna,willa,billie,wilma,minnie william:will,bill,billy,willie,liam xavier yolanda:yola,yoli,landa zacharias:zach,zack,zac,zak
""".split()
# Kinds of organisations with their usual short forms.
ORG_KINDS = """
academy agency association:assoc,assn bank:bk branch:br clinic college:coll construction:constr,const,cons depot:dep department:dept engineering:eng,engrg,engr engg
foundation:found,fdn,fnd freight:frt,frght hospital:hosp,hsp insurance:ins,insur institute:inst international:intl,int,intern laboratories:labs,lab,laboratory logistics:log
manufacturing:mfg,manuf,manufg museum office pharmaceuticals:pharma,pharm,pharmaceutical plant:plt savings:sav,svgs school:sch shipping:shpg,ship,shpng society:soc
telecommunications:telecom,telecoms,tel,telecomm university:univ,uni ward:wd works
""".split()


def _table(entries: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for e in entries:
        full, _, short = e.partition(":")
        out[full] = full
        for s in filter(None, short.split(",")):
            out.setdefault(s, full)
    return out


GIVEN, KINDS = _table(GIVEN_NAMES), _table(ORG_KINDS)
LONG_KINDS = sorted((k for k in set(KINDS.values()) if len(k) >= 5), key=len, reverse=True)
# Before a number a kind may be cut to its first letters.
NUMBERED = ("ward", "depot", "plant", "branch")
CUT_KINDS = {k[:n]: k for k in NUMBERED for n in (2, 3)}
# Longer given names are known by a third of their letters even when the first letter is wrong.
LONG_GIVEN = [(g, (g[: len(g) // 3], g[len(g) // 3 : -(len(g) // 3)], g[-(len(g) // 3) :])) for g in sorted(set(GIVEN.values())) if len(g) >= 8]
K = 2
# An article with a full stop is a given name cut short; titles may stand before it.
_TITLES = f"(?:(?:{'|'.join(V.HONORIFICS)})(?:[.] *| +))*"
INITIAL = re.compile(f" *(?:{'|'.join(V.ARTICLES)})[.]")


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with neighbouring swaps counted once, banded: ``most + 1`` when it is larger than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            row[j] = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], two[j - 2] + 1)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


@lru_cache(maxsize=200_000)
def given_of(token: str) -> str | None:
    """The formal given name a token stands for, allowing for typing errors in longer ones."""
    if token in GIVEN:
        return GIVEN[token]
    if len(token) < 5:
        return None
    near = [(edits(token, g, 2 if len(g) >= 8 else 1), g) for g in sorted(set(GIVEN.values())) if len(g) >= 5 and g[0] == token[0]]
    d, g = min(near, default=(9, ""))
    if d <= (2 if len(g) >= 8 else 1):
        return g
    d, g = min(((edits(token, g, 2), g) for g, parts in LONG_GIVEN if g[0] != token[0] and any(x in token for x in parts)), default=(9, ""))
    return g if d <= 2 else None


@lru_cache(maxsize=200_000)
def kind_of(token: str) -> str | None:
    if token in KINDS:
        return KINDS[token]
    if len(token) < 5:
        return next((k for k in ("ward",) if edits(token, k, 1) <= 1), None) if len(token) >= 4 else None
    near = [(edits(token, k, 3 if len(k) >= 12 else 2 if len(k) >= 8 else 1), k) for k in sorted(set(KINDS.values())) if len(k) >= 4]
    d, k = min(near, default=(9, ""))
    return k if d <= (3 if len(k) >= 12 else 2 if len(k) >= 8 else 1) else None


def plain(name: str) -> list[str]:
    """Lower-case words without accents."""
    t = unicodedata.normalize("NFKD", name.replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("đ", "d"))
    return re.findall(r"[a-z]+|[0-9]+", "".join(c for c in t if not unicodedata.combining(c)).lower())


def kind_cut(word: str, kind: str) -> int | None:
    """Where a kind begins that is run together with what is before it, by the best fit of its letters."""
    most = 1 if len(kind) >= 8 else 0
    fits = ((edits(word[at:], kind, most), abs(len(word) - len(kind) - at), at) for at in range(len(word) - len(kind) - 1, len(word) - len(kind) + 2) if at >= 4)
    d, _, at = min(fits, default=(9, 0, 0))
    return at if d <= most else None


def joined(words: list[str]) -> list[str]:
    """Numbers and kinds that a blank divides put together again."""
    out: list[str] = []
    for w in words:
        if out and (w.isdigit() and out[-1].isdigit() or len(out[-1] + w) >= 5 and KINDS.get(out[-1] + w) == out[-1] + w):
            out[-1] += w
        else:
            out.append(w)
    return out


def parse(name: str) -> list[tuple[str, str, str, str, str]]:
    """Readings of a name: (sort, block, core, given, middle); sort O or P, segments are cut from ``core``.

    An organisation: block = kinds and number, core = stem.  A person: block =
    first initial, core = surname, given = formal given name or initial.
    An article with a full stop is a given name cut short ("A. Smith", "The. Smith").
    """
    words = joined(plain(name))
    cut = 1 if words and INITIAL.match(name) else 0
    words = ["a" if w == "an" else w for w in words[:cut]] + [w for w in words[cut:] if w not in ("of", "the", "and", "de", "von")]
    numbers = [w for w in words if w.isdigit()]
    letters = [w for w in words if not w.isdigit()]
    if not letters:
        return []
    kinds = [(i, k) for i, w in enumerate(letters) if len(letters) > 1 and (k := kind_of(w) or numbers and CUT_KINDS.get(w)) and not (i == 0 and w in GIVEN)]
    if not kinds and numbers and len(letters) > 1:  # before a number a short kind may be misspelt
        kinds = [(i, k) for i, w in enumerate(letters) if len(w) >= 3 for k in NUMBERED if edits(w, k, 1) <= 1]
    if not kinds and len(letters) <= 2:
        for i, w in enumerate(letters):  # the kind is run together with the stem
            for k in sorted(set(KINDS.values()), key=len, reverse=True):
                if len(k) >= 5 and (at := kind_cut(w, k)):
                    rest = letters[:i] + [w[:at]] + letters[i + 1 :]
                    return [("O", " ".join([k, *numbers]), "".join(rest), "", "")]
                if len(k) >= 4 and numbers and w.endswith(k) and len(w) - len(k) >= 4:
                    return [("O", " ".join([k, *numbers]), "".join(letters[:i] + [w[: -len(k)]] + letters[i + 1 :]), "", "")]
    short = []
    if kinds and (len(letters) > len(kinds)):
        stem = "".join(w for i, w in enumerate(letters) if i not in {i for i, _ in kinds})
        for k in LONG_KINDS:  # one of several kinds is run together with the stem
            if stem.endswith(k) and len(stem) - len(k) >= 4:
                stem, kinds = stem[: -len(k)], [*kinds, (-1, k)]
                break
        if len(stem) >= 4:
            return [("O", " ".join([*sorted(k for _, k in kinds), *numbers]), stem, "", "")]
        if len(stem) >= 2 and stem in letters and stem not in GIVEN:  # may be a person all the same ("Lee Ward")
            short = [("O", " ".join([*sorted(k for _, k in kinds), *numbers]), stem, "", "")]
    if numbers:  # of no known kind
        return short or [("O", " ".join(numbers), "".join(letters), "", "")]
    initials = [w for w in letters if len(w) == 1]
    long = [w for w in letters if len(w) > 1]
    if len(long) == 1:
        w = long[0]
        if initials:
            return [("P", initials[0], w, initials[0], "".join(initials[1:2]))]
        for g in sorted(GIVEN, key=len, reverse=True):  # given name and surname run together
            if len(g) >= 3 and w.startswith(g) and len(w) - len(g) >= 5:
                return [("P", GIVEN[g][0], w[len(g) :], GIVEN[g], "")]
        return []
    if not long:
        return []
    first, last = given_of(long[0]), given_of(long[-1])
    forward = ("P", (first or long[0])[0], "".join(long[1:]), first or long[0], "".join(initials[:1]))
    back = ("P", (last or long[-1])[0], "".join(long[:-1]), last or long[-1], "".join(initials[:1]))
    if first and not last:
        return [*short, forward]
    if last and not first:
        return [*short, back]
    return [*short, forward, back]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "sort", "block", "core", "given", "middle"]
    for b in batches:
        rows = [(i, *r) for i, n in zip(b.column("id").to_pylist(), b.column("name").to_pylist()) for r in parse(n or "")]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.string()) for j in range(6)], names=names)


def given_fit(a: str, b: str, loose: int = 0) -> bool:
    """Given names or initials that can be one person's."""
    if not a or not b or a == b:
        return True
    if len(a) == 1 or len(b) == 1:
        return a[0] == b[0]
    if len(a) > len(b):
        a, b = b, a
    if len(a) >= 3 and b.startswith(a) or a in GIVEN and GIVEN[a] == b:
        return True
    most = (2 if len(b) >= 7 else 1 if len(b) >= 4 else 0) + loose
    # Two different well-known names are two persons however close they are.
    if a in GIVEN.values() and b in GIVEN.values():
        return False
    return edits(a, b, most) <= most


def same(a: tuple, b: tuple, loose: bool) -> bool:
    """a, b: (sort, block, core, given, middle)."""
    if a[0] != b[0]:
        return False
    size = min(len(a[2]), len(b[2]))
    most = 0 if size < 5 else 1 if size < 7 else 2
    most += (2 if size >= 8 else 1) if loose and most else 0
    if edits(a[2], b[2], most) > most:
        return False
    if a[0] == "O":
        return a[1] == b[1]
    return given_fit(a[3], b[3], int(loose)) and (not a[4] or not b[4] or a[4] == b[4])


def _verify(loose: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in b.schema.names]
            keep = [
                (r[0], r[1])
                for r in zip(*cols)
                if same((r[2], r[3], r[4], r[5], r[6]), (r[2], r[7], r[8], r[9], r[10]), loose)
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in keep], pa.string()) for j in (0, 1)], names=["id_a", "id_b"])

    return run


def segments(core: Column, k: int = K) -> Column:
    """The k + 1 even segments of a text: array of (len, i, seg)."""
    n = F.length(core)
    base = F.floor(n / (k + 1)).cast("int")
    longer = n % (k + 1)
    parts = []
    for i in range(k + 1):
        # The last `longer` segments have one character more.
        extra = F.greatest(F.lit(0), F.lit(i) - (F.lit(k + 1) - longer))
        start = F.lit(i) * base + extra
        size = base + (F.lit(i) >= (F.lit(k + 1) - longer)).cast("int")
        parts.append(F.struct(n.alias("len"), F.lit(i).alias("i"), F.substr(core, start + 1, size).alias("seg")))
    return F.array(*parts)


def shifted(core: Column, k: int = K) -> Column:
    """Substrings of a text that may equal a segment of a text up to k shorter: array of (len, i, seg).

    A swap of neighbours across the end of a segment is one edit but touches two segments, so
    with one more edit elsewhere none may be left.  Every segment but the last is therefore also tried with
    its last character taken from behind it, as the swap left it.
    """
    n = F.length(core)
    parts = []
    for delta in range(k + 1):
        m = n - delta
        base = F.floor(m / (k + 1)).cast("int")
        longer = m % (k + 1)
        for i in range(k + 1):
            extra = F.greatest(F.lit(0), F.lit(i) - (F.lit(k + 1) - longer))
            start = F.lit(i) * base + extra
            size = base + (F.lit(i) >= (F.lit(k + 1) - longer)).cast("int")
            for move in range(-((k - delta) // 2), (k + delta) // 2 + 1):
                at = start + move
                ok = (at >= 0) & (at + size <= n) & (size > 0)
                parts.append(F.when(ok, F.struct(m.alias("len"), F.lit(i).alias("i"), F.substr(core, at + 1, size).alias("seg"))))
            if i < k and delta < k:
                extra = F.greatest(F.lit(0), F.lit(i) - (F.lit(k + 1) - longer))
                start = F.lit(i) * base + extra
                size = base + (F.lit(i) >= (F.lit(k + 1) - longer)).cast("int")
                for move in range(-((k - 1 - delta) // 2), (k - 1 + delta) // 2 + 1):
                    at = start + move
                    ok = (at >= 0) & (at + size < n) & (size > 0)
                    seg = F.concat(F.substr(core, at + 1, size - 1), F.substr(core, at + size + 1, F.lit(1)))
                    parts.append(F.when(ok, F.struct(m.alias("len"), F.lit(i).alias("i"), seg.alias("seg"))))
    return F.array_compact(F.array(*parts))


def readings(names: DataFrame) -> DataFrame:
    """names: id, name (one spelling per id).  Every reading of every name."""
    return materialize(names.mapInArrow(_parsed, "id string, sort string, block string, core string, given string, middle string"), "variant_readings")


def near_readings(read: DataFrame) -> DataFrame:
    """Pairs of ids whose cores are within K edits in one block and whose other parts fit.

    The segment join compares each pair of equal segments once per block and
    length, never all spellings of a block.
    """
    probe = read.select(*read.columns, F.explode(shifted(F.col("core"))).alias("k")).select(*read.columns, "k.*")
    index = read.select(*(F.col(c).alias(f"{c}_2") for c in read.columns), F.explode(segments(F.col("core"))).alias("k")).select(
        *(f"{c}_2" for c in read.columns), F.col("k.len").alias("len"), F.col("k.i").alias("i"), F.col("k.seg").alias("seg")
    )
    hits = probe.join(index, [probe["sort"] == index["sort_2"], probe.block == index.block_2, probe.len == index.len, probe.i == index.i, probe.seg == index.seg])
    hits = hits.filter("id <> id_2 and abs(length(core) - length(core_2)) <= 2").select(
        "id", "id_2", "sort", "block", "core", "given", "middle", "block_2", "core_2", "given_2", "middle_2"
    )
    # Banded distance in the engine first; it counts a swap as two, so it is given room for that.
    hits = hits.filter(F.levenshtein("core", "core_2", K + 2) >= 0).distinct()
    found = hits.mapInArrow(_verify(False), "id_a string, id_b string")
    return found.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def variant_pairs(names: DataFrame) -> DataFrame:
    """(id_a, id_b): spellings of one person or organisation, smaller id first.

    names: id and one spelling of it.  Names that are empty, null or read as
    neither a person nor an organisation are linked to nothing.  Two spellings that
    differ by more than K edits are linked when a third stands between them and
    their parts still fit.
    """
    read = readings(names)
    near = materialize(near_readings(read), "variant_near")
    both = near.select("id_a", "id_b").union(near.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    hop = both.select(F.col("id_a").alias("x"), F.col("id_b").alias("id_a")).join(both.select(F.col("id_a").alias("x"), "id_b"), "x")
    hop = hop.filter("id_a < id_b").select("id_a", "id_b").distinct().join(near, ["id_a", "id_b"], "left_anti")
    one = read.select(F.col("id").alias("id_a"), "sort", "block", "core", "given", "middle")
    two = read.select(F.col("id").alias("id_b"), F.col("sort").alias("sort_2"), *(F.col(c).alias(f"{c}_2") for c in ("block", "core", "given", "middle")))
    wide = hop.join(one, "id_a").join(two, "id_b").filter("sort = sort_2")
    wide = wide.select("id_a", "id_b", "sort", "block", "core", "given", "middle", "block_2", "core_2", "given_2", "middle_2")
    return near.union(wide.mapInArrow(_verify(True), "id_a string, id_b string")).distinct()


def shown_names(entities: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """id, name: the spelling each id stands for.

    The stored normal form loses accented letters and a first initial that looks like an article; among
    the names and mentions that normalise to it, the most frequent one brings them back.
    """
    e = entities.filter("id is not null and normalized_name is not null").select("id", "normalized_name", "name", "mentions", "alternative_names")
    empty = F.array().cast("array<string>")
    every = F.concat(F.array("name"), F.coalesce("mentions", empty), F.coalesce("alternative_names", empty))
    shown = e.select("id", "normalized_name", F.explode(every).alias("name"))
    if mentions is not None:
        m = mentions.select(F.col("normalized_name"), F.col("text").alias("name")).filter("normalized_name is not null").groupBy("normalized_name", "name").count()
        shown = shown.union(e.select("id", "normalized_name").distinct().join(m.drop("count"), "normalized_name").select("id", "normalized_name", "name"))
    clean = F.lower(X.clean_display(X.without_invisible(F.col("name"))))
    fits = shown.filter(F.col("name").isNotNull()).withColumn("clean", clean).filter(X.normalize_name(F.col("clean")) == F.col("normalized_name"))
    accents = F.length(F.regexp_replace("clean", "[\\x{0}-\\x{7F}]", ""))
    initial = F.nullif(F.regexp_extract("clean", f"^{_TITLES}({'|'.join(V.ARTICLES)})[.]", 1), F.lit(""))
    best = fits.groupBy("id", "clean").agg(F.count("*").alias("n")).withColumn("initial", initial).groupBy("id").agg(
        F.max_by("clean", F.struct(accents.alias("a"), F.col("n"), F.col("clean"))).alias("clean"),
        F.max_by("initial", F.when(F.col("initial").isNotNull(), F.struct("n", "initial"))).alias("initial"),
        (F.sum(F.when(F.col("initial").isNotNull(), 2 * F.col("n")).otherwise(0)) >= F.sum("n")).alias("mostly"),
    )
    ids = e.groupBy("id").agg(F.min("normalized_name").alias("normalized_name"))
    name = F.when(F.col("clean").rlike("[^\\x{0}-\\x{7F}]"), bare_words(F.col("clean"))).otherwise(F.col("normalized_name"))
    return ids.join(best, "id", "left").select("id", F.when(F.col("mostly"), F.concat("initial", F.lit(". "), name)).otherwise(name).alias("name"))


def bare_words(c: Column) -> Column:
    """Titles and company forms off, accents kept."""
    t = F.btrim(F.regexp_replace(F.regexp_replace(c, r"'s(?![\p{L}\p{N}_])", ""), r"[^\p{L}\p{M}\p{N}]+", " "))
    t = F.regexp_replace(t, "^(?:(?:" + "|".join(V.ARTICLES + V.HONORIFICS) + ")(?: |$))+", "")
    return F.btrim(F.regexp_replace(t, "(?:(?:^| )(?:" + "|".join(V.CORP_SUFFIXES) + "))+$", ""))
