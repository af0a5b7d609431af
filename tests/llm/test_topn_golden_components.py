import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veriloom.llm import components, golden, topn


def top(spark, rows, n=2, **kw):
    df = spark.createDataFrame(rows, "g string, s double, t long, __g string")
    return sorted(tuple(r) for r in topn.top_n_per_group(df, F.col("g"), F.col("s"), [F.col("t")], n, ["g", "t"], **kw).collect())


def brute(rows, n):
    out, by = [], {}
    for g, s, t, _ in rows:
        if g is not None and s is not None and s == s:
            by.setdefault(g, []).append((-s, t))
    for g, v in by.items():
        out += [(g, t) for _, t in sorted(v)[:n]]
    return sorted(out)


def test_topn_edges(spark):
    rows = [("a", 1.0, 1, "x"), ("a", 1.0, 2, "x"), ("a", float("nan"), 3, None), ("a", None, 4, None), (None, 9.0, 5, None), ("a", 2.0, 6, "x"), ("b", -1.0, 7, "x"), ("a", 2.0, 6, "x")]
    assert top(spark, rows) == [("a", 6), ("a", 6), ("b", 7)]
    assert top(spark, []) == []


def test_topn_hot_group_skips(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randrange(300)}", float(rng.randrange(40)), i, "x") for i in range(20_000)]
    assert top(spark, rows, 5, row_group_bytes=4096) == brute(rows, 5)


def test_topn_layout_is_reused_and_scores_keep_their_type(spark):
    big = 2**60
    rows = [("g", i, big + i) for i in range(50)] + [("h", 1, None), (None, 2, 5)]
    df = spark.createDataFrame(rows, "g string, o long, s long")
    laid = topn.layout(df, F.col("g"), F.col("s"), [F.col("o")], ["g", "o"], row_group_bytes=512)
    # Neighbouring long scores are one double: their own type must decide.
    assert sorted(r.o for r in topn.top_n(laid, 3).collect()) == [47, 48, 49]
    assert sorted(r.o for r in topn.top_n(laid, 1).collect()) == [49]
    assert topn.readable("s3a://bucket/x") == "s3://bucket/x" and topn.readable("file:/a/b") == "file:///a/b"
    assert topn.readable("unknown-scheme://x/y") is None


def test_latest_delivery(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, None, "c"), (2, None, "d")], "k long, t long, v string")
    assert sorted((r.k, r.v) for r in topn.latest_delivery(df, "k", "t", ["v"]).collect()) == [(1, "b"), (2, "d")]


def record(spark, rows):
    df = spark.createDataFrame(rows, "rec_id long, id string, name string, rank int, at timestamp, m array<string>")
    vote = golden.trust(F.col("rank")) * golden.decay(F.col("at"))
    own, order = F.col("rec_id"), F.struct(-F.coalesce("rank", F.lit(99)), F.col("at"))
    fields = [
        golden.Field("name", own, F.lower("name"), F.when(F.col("name").isNotNull(), vote), order),
        golden.Field("full", own, own, F.greatest(F.lit(0), F.size(F.coalesce("m", F.array().cast("array<string>")))), order),
    ]
    return {r.id: (r.name, r.full) for r in golden.best_record(df, "id", "rec_id", fields).collect()}


def test_golden_order(spark):
    import datetime as dt

    day = lambda n: dt.datetime(2025, 1, n, 0, 0, 0, n)
    rows = [
        (1, "x", "C", 2, day(9), ["p"]), (2, "x", "c", 1, None, ["p"]), (3, "x", "c", 1, day(1), ["p", "q"]), (4, "x", None, 1, day(9), None),
        (5, "y", None, None, None, None), (6, "z", "u", None, day(1), []), (7, "z", "v", None, day(1), []), (8, None, "w", 1, day(1), None),
    ]
    assert record(spark, rows) == {"x": (3, 3), "y": (None, 5), "z": (6, 6)}
    assert record(spark, []) == {}


def test_golden_votes_add_up(spark):
    """Two fresh records of rank 2 outvote an old one of rank 1, and the better of them delivers the value."""
    import datetime as dt

    rows = [(1, "x", "Acme", 1, dt.datetime(2020, 1, 1)), (2, "x", "Beta", 2, dt.datetime(2024, 1, 1)), (3, "x", "BETA", 2, dt.datetime(2024, 6, 1))]
    df = spark.createDataFrame(rows, "rec_id long, id string, name string, rank int, at timestamp")
    f = golden.Field("name", F.col("name"), F.lower("name"), golden.trust(F.col("rank")) * golden.decay(F.col("at")))
    assert golden.best_record(df, "id", "rec_id", [f]).first().name == "BETA"
    ages = spark.sql("select timestamp'2024-01-01' a, timestamp'2025-01-01' b, cast(null as timestamp) c")
    a, b, c = ages.select(*(golden.decay(F.col(x)) for x in "abc")).first()
    assert 1.9 < b / a < 2.1 and c == 1


def test_golden_consensus(spark):
    df = spark.createDataFrame([(1, "x", "Acme"), (2, "x", "ACME"), (3, "x", "Beta")], "rec_id long, id string, name string")
    f = golden.Field("name", F.col("name"), F.lower("name"), F.when(F.col("rec_id") == 3, 3).otherwise(2))
    assert golden.best_record(df, "id", "rec_id", [f]).first().name == "Acme"


def union_find(pairs):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        p[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in p}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=40))
def test_components_random(spark, pairs):
    pairs = [(f"v{a:03d}", f"v{b:03d}") for a, b in pairs]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert dict(map(tuple, components.connected_components(df, "a", "b").collect())) == union_find(pairs)


def test_components_chain_star_and_nulls(spark):
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(60)]
    star = [("hub", f"s{i}") for i in range(300)]
    pairs = chain + star + [("self", "self")] + chain[:3]
    df = spark.createDataFrame(pairs + [(None, "q")], "a string, b string")
    assert dict(map(tuple, components.connected_components(df, "a", "b").collect())) == union_find(pairs)
