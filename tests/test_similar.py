import random

from veriloom.operators import resolution as R
from veriloom.operators import similar


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diag = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = diag + 1 if x == y else max(row[j], row[j - 1])
            diag = keep
    return row[-1]


def test_lcs():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randrange(90))) for _ in range(2))
        assert similar.lcs(a, b) == plain_lcs(a, b)


def odd_names(rng):
    """Names around a few hot words: variants, repeated words, other orders, long ones, words within words, other scripts."""
    stems = ["".join(rng.choice(["ka", "lo", "ri", "sten", "mu", "vel", "dorf"]) for _ in range(rng.randint(2, 4))) for _ in range(25)]
    out = ["bank", "savings bank", "savings", "bank bank", "of bank", "r bank", "bank-東京 kalo", "東京 bank"]
    for s in stems:
        k = rng.randrange(1, len(s))
        out += [f"{s} bank", f"{s[:k]}x{s[k:]} bank", f"bank of {s}", f"{s[:k] + s[k + 1:]} savings bank", f"{s} savings bank", f"{s[:k]} {s[k:]} bank", f"bank {s} {s}", f"r {s} bank"]
        out += [f"{s} {s[::-1]} bank " + "international trust and general deposits corporation of the north " + s[k:]]
    return out


def test_fuzzy_pairs_equal_all_pairs(spark, monkeypatch):
    """Blocks are cut into several tiles; every pair of names with a word in common is compared by hand."""
    monkeypatch.setattr(similar, "TILE", 50)
    rng = random.Random(7)
    names = odd_names(rng)
    rows = [(f"e{rng.randrange(10**9):09d}", n, rng.choice(["ORG", "ORG", "ORG", "PERSON", "NOUN_PHRASE", None]), i) for i, n in enumerate(names)]
    g = spark.createDataFrame(rows, "id string, normalized_name string, entity_type string, first_ord long")
    tokens = {r.id: set(r.tokens) for r in R._tokens_of(g).collect()}
    fit = lambda a, b: a == b is not None or "NOUN_PHRASE" in (a, b)
    all_pairs = [(*sorted((p, q))[0][:2], *sorted((p, q))[1][:2]) for n, p in enumerate(rows) for q in rows[:n] if tokens[p[0]] & tokens[q[0]] and fit(p[2], q[2])]
    for threshold in (0.85, 0.6, 1.0):
        want = {(a, b, s) for a, n, b, m in all_pairs if (s := R.similarity(n, m)) >= threshold}
        got = [tuple(r) for r in R.fuzzy_pairs(g, threshold).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_hot_word_meets_few_names(spark, monkeypatch):
    """2000 names of one block have two million pairs: Python sees only those that are near."""
    rng = random.Random(3)
    stems = sorted({"".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(5)) for _ in range(2000)})
    rows = [("bank", 0, 0, 0, f"e{i:05d}", f"{s} bank", "ORG") for i, s in enumerate(stems)]
    calls = []
    real = similar.similarity
    monkeypatch.setattr(similar, "similarity", lambda a, b: calls.append(1) or real(a, b))
    names = ["t", "x", "y", "part", "id", "normalized_name", "entity_type"]
    batches = spark.createDataFrame(rows, "t string, x int, y int, part int, id string, normalized_name string, entity_type string").select(*names).toArrow().to_batches()
    found = sum(b.num_rows for b in similar.within_tiles(0.85)(iter(batches)))
    assert 0 < found <= len(calls) < 20_000
