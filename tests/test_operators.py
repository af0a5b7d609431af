import datetime as dt

from pyspark.sql import functions as F

from veriloom.functions import text as X
from veriloom.operators import events as EV
from veriloom.operators import graph as G
from veriloom.operators import pages as P
from veriloom.operators import resolution as R
from veriloom.operators import retrieval as T
from veriloom.operators import triples as N
from veriloom.operators import validation as VA
from veriloom.sources import exports, tables

REL = "ord long, subject_text string, predicate string, object_text string, relation_type string, sentence string, document string, page_number int, extraction_method string, review_status string, negated boolean, confidence double, event_date string, subject_id string, object_id string"


def rel(spark, *rows):
    base = dict(ord=0, subject_text="A", predicate="own", object_text="B", relation_type="OWN", sentence="A owns B.", document="d1", page_number=1, extraction_method="x",
                review_status=None, negated=False, confidence=0.9, event_date=None, subject_id="e1", object_id="e2")
    return spark.createDataFrame([tuple({**base, "ord": i, **r}.values()) for i, r in enumerate(rows)], REL)


def mentions(spark, *rows):
    return spark.createDataFrame([(i, t, None, k, "d", 1, "s") for i, (t, k) in enumerate(rows)], "ord long, text string, normalized_name string, entity_type string, document string, page_number int, sentence string")


def clusters(spark, *rows, fuzzy=False):
    g = R.canonical_groups(mentions(spark, *rows)).select("id", "entity_type", "normalized_name", "first_ord")
    pairs = R.alias_pairs(g).select("id_a", "id_b")
    if fuzzy:
        pairs = pairs.union(R.fuzzy_pairs(g).select("id_a", "id_b")).distinct()
    return R.greedy_clusters(g, pairs).select("leader").distinct().count()


def test_canonical_groups(spark):
    g = R.canonical_groups(mentions(spark, ("Acme Corporation", "ORG"), ("acme corporation ", "ORG"), ("Beta Inc", "ORG"))).collect()
    assert sorted((r.normalized_name, len(r.mentions)) for r in g) == [("acme", 2), ("beta", 1)]


def test_alias_clusters(spark):
    assert clusters(spark, ("apple", "ORG"), ("apple", "PRODUCT")) == 2
    assert clusters(spark, ("Priya", "PERSON"), ("Priya Singh", "PERSON"), ("ABC Bank", "ORG"), ("ABC Bank", "NOUN_PHRASE")) == 2
    assert clusters(spark, ("NSF", "ORG"), ("National Science Foundation", "ORG")) == 1
    assert clusters(spark, ("bank", "ORG"), ("ABC Bank", "ORG")) == 2
    assert clusters(spark, ("bank", "ORG"), ("ABC Bank", "ORG"), fuzzy=True) == 1


def test_similarity():
    assert R.similarity("abc bank", "bank abc") == 1.0
    assert R.similarity("", "") == 1.0
    assert R.similarity("kitten", "sitting") == 2 * 4 / 13


def test_duplicates_and_contradictions(spark):
    r = rel(spark, {}, {"confidence": 0.95}, {"confidence": float("nan")}, {"negated": True}, {"sentence": "  "}, {"object_id": "e9"})
    d = VA.contradictions(VA.deduplicate(VA.with_evidence(r)))
    got = {x.ord: (x.confidence, x.copies, x.contradicted) for x in d.collect()}
    assert got == {0: (0.95, 3, True), 3: (0.9, 1, True), 5: (0.9, 1, False)}
    assert VA.report(r).first().asDict() == {"relations": 6, "dropped_no_evidence": 1, "kept": 3, "duplicates_merged": 2, "contradicted": 2}


def test_events(spark):
    r = VA.attach_dates(rel(spark, {"sentence": "On 5 February 2025 A owned B."}, {"event_date": "1 May 2024", "confidence": 0.0}, {"event_date": "1 May 2024", "subject_id": None}))
    e = EV.build_events(r)
    assert sorted(x.name for x in e.collect()) == ["own on 5 February 2025"]
    assert EV.participants(e).count() == 2
    assert r.select(G.event_day(F.col("event_date"))).first()[0] == dt.date(2025, 2, 5)


def entities(spark, *rows):
    return spark.createDataFrame(list(rows), "rec_id long, id string, name string, normalized_name string, entity_type string, mentions array<string>, alternative_names array<string>, documents array<string>, pages array<int>")


def test_graph_merge_and_delete(spark):
    ent = entities(spark, (1, "e1", "A", "a", "ORG", ["A", "Aa"], None, ["d1", "d2"], [1]), (2, "e1", "Z", "a", "GPE", ["A"], None, None, [9]), (3, "e2", "B", "b", "ORG", None, None, ["d1"], [1]))
    r = rel(spark, {}, {"document": "d2", "sentence": "again", "confidence": 0.95}, {"predicate": "sue", "document": "d1"}, {"subject_id": None})
    g = G.build_graph(ent, r)
    a = g.entities.filter("id = 'e1'").first()
    assert (a.name, a.entity_type, a.mentions) == ("A", "ORG", ["Aa", "A"])
    edges = {e.predicate: e for e in g.edges.collect()}
    assert edges["own"].evidence == ["A owns B.", "again"] and edges["own"].confidence == 0.95 and edges["own"].source_documents == ["d1", "d2"]
    left, counts = G.delete_document(g, "d1")
    n = dict(counts.collect())
    assert n["relations_deleted"] == 1 and n["relations_scrubbed"] == 2 and n["documents_deleted"] == 1 and n["entities_scrubbed"] == 2
    assert left.edges.select("source_document").collect()[0][0] == "d2"
    assert {x.id for x in left.entities.collect()} == {"e1", "e2"}


def test_empty_graph(spark):
    g = G.build_graph(entities(spark), rel(spark))
    assert G.named_edges(g).count() == 0 and dict(G.totals(g).collect())["edges"] == 0
    assert G.neighborhood(g, "e1").count() == 0 and G.list_documents(g).count() == 0


def test_retrieval(spark):
    f = T.facts(rel(spark, {"sentence": "Acme approved the loan"}, {"sentence": "approval of loan", "confidence": None}, {"subject_text": "Q", "object_text": "b"}))
    top = T.ranked(T.keyword_topk(f, "Who approved the loan?"), F.col("score").desc(), F.col("confidence").desc(), "ord")
    assert [r.ord for r in top.orderBy("rank").collect()] == [0, 1]
    assert [r.ord for r in T.hop_expand(top, f).collect()] == [2]
    assert T.keyword_topk(f, "who is the").count() == 0
    context = T.context_lines(T.merged([top])).first()[0]
    assert context.startswith("[1:EXPLICIT] Subject: A | Relation: own | Object: B | Source: d1, page 1, confidence 0.90")
    assert T.answer("q", "") .startswith("I don't know")


def test_vector_topk(spark):
    p = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 0.0]), ("d", [1.0]), ("e", None)], "id string, v array<float>")
    assert [tuple(r) for r in T.vector_topk(p, "id", "v", [2.0, 0.0], 5).collect()] == [("a", 1.0), ("b", 1.0)]


def test_boilerplate(spark):
    line = "Confidential report of the board"
    s = spark.createDataFrame([(i, "d", i, f"{line}\nbody {i}") for i in range(4)] + [(9, "d", 9, None)], "seg_id long, document string, page_number int, text string")
    out = {r.seg_id: r.text for r in P.strip_boilerplate(s).collect()}
    assert out[2] == "body 2" and out[9] == ""
    assert P.needs_ocr(s).first().needs_ocr is False


def test_mention_index(spark):
    e = spark.createDataFrame(
        [("e1", "acme", ["Acme CA20001"], None, 0), ("e2", "acme", None, ["beta"], 1), ("e3", "beta", None, None, 2)],
        "id string, normalized_name string, alternative_names array<string>, mentions array<string>, pos int",
    )
    idx = dict((r.key, r.id) for r in R.mention_index(e).collect())
    assert idx["acme"] == "e2" and idx["beta"] == "e3" and idx["ca20001"] == "e1"


def test_placeholders(spark):
    e = spark.createDataFrame([("e1", "acme", None, None, 0)], "id string, normalized_name string, alternative_names array<string>, mentions array<string>, pos int")
    linked = R.link_relations(rel(spark, {"subject_text": "Acme Ltd", "object_text": "The new Bank"}, {"subject_text": "12 000", "object_text": "new bank"}), R.mention_index(e))
    p = R.placeholders(linked, e).collect()
    assert [(r.normalized_name, r.name) for r in p] == [("new bank", "The new Bank")]


TOKENS = [  # Priya approved the loan for Acme. / The claim was not rejected by Beta.
    ("d", 0, 0, "Priya", "Priya", "PROPN", "nsubj", 1), ("d", 0, 1, "approved", "approve", "VERB", "ROOT", 1), ("d", 0, 2, "the", "the", "DET", "det", 3),
    ("d", 0, 3, "loan", "loan", "NOUN", "dobj", 1), ("d", 0, 4, "for", "for", "ADP", "prep", 1), ("d", 0, 5, "Acme", "Acme", "PROPN", "pobj", 4), ("d", 0, 6, ".", ".", "PUNCT", "punct", 1),
    ("d", 1, 0, "The", "the", "DET", "det", 1), ("d", 1, 1, "claim", "claim", "NOUN", "nsubjpass", 4), ("d", 1, 2, "was", "be", "AUX", "auxpass", 4), ("d", 1, 3, "not", "not", "PART", "neg", 4),
    ("d", 1, 4, "rejected", "reject", "VERB", "ROOT", 4), ("d", 1, 5, "by", "by", "ADP", "agent", 4), ("d", 1, 6, "Beta", "Beta", "PROPN", "pobj", 5),
]


def test_triples(spark):
    t = spark.createDataFrame([(*r, 0, 0) for r in TOKENS], N.TOKEN_SCHEMA)
    got = {(r.subject, r.predicate, r.object, r.negated, r.hundredths) for r in N.triples(t).collect()}
    assert got == {("Priya", "approve", "the loan", False, 80), ("Priya", "approve for", "Acme", False, 80), ("Beta", "reject", "The claim", True, 90)}


def test_spans_and_titles(spark):
    schema = "doc string, sent int, first int, last int, label string, text string"
    ents = spark.createDataFrame([("d", 0, 0, 2, "PERSON", "Ann Lee"), ("d", 0, 5, 6, "DATE", "Monday")], schema)
    chunks = spark.createDataFrame([("d", 0, 1, 3, "", "Lee x"), ("d", 0, 4, 6, "", "last Monday"), ("d", 0, 5, 7, "", "Monday y")], schema)
    assert sorted(r.text for r in N.kept_spans(ents, chunks).collect()) == ["Ann Lee", "last Monday"]
    words = "Yesterday , Service Lead Ann Lee spoke".split()
    tok = spark.createDataFrame([("d", 0, i, w, w, "PUNCT" if w == "," else "NOUN", "", i, 0, 0) for i, w in enumerate(words)], N.TOKEN_SCHEMA)
    people = spark.createDataFrame([("d", 0, 4, 6, "PERSON", "Ann Lee")], schema)
    assert [(r.title, r.person) for r in N.titles(tok, people).collect()] == [("Service Lead", "Ann Lee")]


def test_demonstratives(spark):
    df = spark.createDataFrame([("this loan", ["paid LN1", "LN30002 and CA7"]), ("that thing", ["LN1"]), (None, ["LN1"])], "e string, h array<string>")
    assert [r[0] for r in df.select(N.resolve_demonstrative(F.col("e"), F.col("h"))).collect()] == ["LN1", "that thing", None]


def test_exports_and_manifest(spark, tmp_path):
    e = entities(spark, (1, "e1", "A", "a", "ORG", ["A"], None, ["d1"], [1]))
    exports.export_all(e, rel(spark, {}), f"file://{tmp_path}")
    back = tables.read_exported(spark, f"file://{tmp_path}/relationships.json", "subject string, page int")
    assert tuple(back.first()) == ("A", 1)
    assert tables.read_exported(spark, f"file://{tmp_path}/none.json", "a string").count() == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.pdf").write_bytes(b"1")
    now = tables.file_fingerprints(spark, f"file://{tmp_path}/in")
    assert exports.changed_files(now, now.limit(0)).count() == 1 and exports.changed_files(now, now).count() == 0
    assert tables.list_documents_on_disk(spark, f"file://{tmp_path}/in").count() == 1
    assert tables.pdf_pages(spark, f"file://{tmp_path}/in").first().error is not None


def test_config():
    assert tables.expand_env({"a": ["${X:-y}", "${Z}", 3]}, {"Z": "z"}) == {"a": ["y", "z", 3]}


def test_streaming_ingest(spark, sf, tmp_path):
    from veriloom.operators.graph import merge_relations
    from veriloom.streaming import ingest

    raw = spark.read.parquet(f"{sf}/relations.parquet").filter("ord is not null")
    raw.filter("ord % 2 = 0").write.parquet(f"{tmp_path}/in")
    run = lambda: ingest.run_ingest(spark, f"{tmp_path}/in", raw.schema, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    run()
    raw.filter("ord % 2 = 1").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    last = max(p.name for p in (tmp_path / "out").iterdir())
    got = spark.read.parquet(f"{tmp_path}/out/{last}/edges")
    assert got.count() == merge_relations(raw).count()


def test_merge_clusters(spark):
    rows = [
        ("c", 1, "Priya", "priya", "NOUN_PHRASE", ["Priya"], [], ["a.pdf"], [1], ["s1", ""]), ("c", 2, "Priya Singh", "priya singh", "PERSON", ["Priya", "P."], ["PS"], ["b.pdf", "a.pdf"], [2, 1], ["s2"]),
        ("c", 3, "Priya", "priya", "ORG", None, None, None, None, None), ("d", 4, None, "x", None, ["x"], None, [], None, None),
    ]
    df = spark.createDataFrame(rows, "k string, o long, name string, normalized_name string, entity_type string, mentions array<string>, alternative_names array<string>, documents array<string>, pages array<int>, sentences array<string>")
    got = {r.k: r for r in R.merge_clusters(df, "k", ["o"]).collect()}
    c = got["c"]
    assert (c.name, c.entity_type, c.normalized_name, c.records) == ("Priya Singh", "PERSON", "priya", 3)
    assert c.mentions == ["Priya", "P."] and c.documents == ["a.pdf", "b.pdf"] and c.pages == [1, 2] and c.sentences == ["s1", "s2"] and set(c.alternative_names) == {"Priya", "Priya Singh", "PS"}
    assert got["d"].name == "" and got["d"].mentions == ["x"]
    assert R.merge_clusters(df.limit(0), "k", ["o"]).count() == 0


def test_chains_of_overlaps_and_idle_chunks(spark):
    schema = "doc string, sent int, first int, last int, label string, text string"
    none = spark.createDataFrame([], schema)
    chunks = spark.createDataFrame([("d", 0, 0, 3, "", "one long chunk"), ("d", 0, 2, 5, "", "chunk in between"), ("d", 0, 4, 6, "", "third chunk"), ("d", 0, 7, 8, "", "they")], schema)
    tokens = spark.createDataFrame([("d", 0, 7, "PRON", False), ("d", 0, 0, "NOUN", False)], "doc string, sent int, i int, pos string, is_stop boolean")
    assert sorted(r.text for r in N.kept_spans(none, chunks, tokens=tokens).collect()) == ["one long chunk", "third chunk"]
    assert N.kept_spans(none, none).count() == 0


def test_subject_with_code_and_flags(spark):
    df = spark.createDataFrame([("The amount", ["no code", "Loan LN30002 and CA7"]), ("The amount (x)", ["LN1"]), ("LN1 amount", ["LN1"]), ("The amount", [])], "s string, h array<string>")
    assert [r[0] for r in df.select(N.with_code(F.col("s"), F.lit("be"), F.col("h"))).collect()] == ["The amount (CA7)", "The amount (x)", "LN1 amount", "The amount"]
    assert not X.switched_on("No") and not X.switched_on(False) and X.switched_on("yes") and X.switched_on(None) and not X.switched_on(None, False)


def test_store(spark, tmp_path):
    from veriloom.operators import graph as G
    from veriloom.sources import store as ST

    base = {"document": "a.pdf", "page_number": 1, "subject_id": "e1", "object_id": "e2", "sentence": "s", "confidence": 0.9, "event_date": "5 May 2024"}
    records = spark.createDataFrame([(1, "e1", "A", "a", "ORG", ["A"], [], ["a.pdf"], [1]), (2, "e2", "B", "b", "ORG", ["B"], [], ["a.pdf", "b.pdf"], [2])],
        "rec_id long, id string, name string, normalized_name string, entity_type string, mentions array<string>, alternative_names array<string>, documents array<string>, pages array<int>")
    one, two = rel(spark, base), rel(spark, {**base, "document": "b.pdf", "sentence": "t"})
    root, vectors = f"{tmp_path}/g", f"{tmp_path}/v"
    assert ST.read_graph(spark, root) is None and ST.read_points(spark, vectors) is None
    assert ST.store_graph(G.build_graph(records, one), root)["edges"] == 1
    assert ST.store_graph(G.build_graph(records, two), root)["edges"] == 1
    edge = ST.read_graph(spark, root).edges.first()
    assert edge.told == 2 and edge.source_documents == ["a.pdf", "b.pdf"] and edge.evidence == ["s", "t"] and ST.versions(spark, root) == [0, 1]
    assert ST.store_points(ST.points(one, dims=8), vectors, 8) == 1 and ST.store_points(ST.points(two, dims=8), vectors, 8) == 2
    assert ST.store_points(ST.points(two, dims=16), vectors, 16) == 1  # points of another length can't stay
    counts = ST.delete_everywhere(spark, "b.pdf", root, vectors)
    assert counts["points_deleted"] == 1 and counts["relations_scrubbed"] == 2 and ST.read_graph(spark, root).edges.first().source_documents == ["a.pdf"]
    ST.clear_graph(spark, root)
    assert ST.read_graph(spark, root).edges.count() == 0
    files = spark.createDataFrame([("x", "1"), ("y", None)], ST.MANIFEST)
    assert ST.read_manifest(spark, f"{tmp_path}/m").count() == 0
    ST.write_manifest(files, f"{tmp_path}/m")
    now = spark.createDataFrame([("x", "1"), ("x2", "1"), ("y", None)], ST.MANIFEST)
    assert sorted(r.path for r in ST.fresh_files(now, ST.read_manifest(spark, f"{tmp_path}/m")).collect()) == ["x2", "y"] and ST.fresh_files(now, files, force=True).count() == 3
    answers = ST.question_battery(one, [(1, "subject s?", "zzz")])
    assert answers[0]["hit"] is False and set(answers[0]) == {"id", "question", "expected", "answer", "hit", "facts"}


def test_ingest_pages(spark, tmp_path):
    from veriloom.plans import pipeline
    from veriloom.sources import store as ST

    def parser():
        words = [("Acme", "PROPN", "nsubj", 1), ("leased", "VERB", "ROOT", 1), ("Pump", "PROPN", "dobj", 1), (".", "PUNCT", "punct", 1)]
        return lambda t: [(0, i, w, "lease" if p == "VERB" else w, p, d, h, 0, 0) for i, (w, p, d, h) in enumerate(words)]

    def spans(tokens):
        ents = tokens.filter("pos = 'PROPN'").select("doc", "sent", F.col("i").alias("first"), (F.col("i") + 1).alias("last"), F.lit("ORG").alias("label"), "text")
        return ents, ents.limit(0)

    pages = spark.createDataFrame([("a.pdf", 1, "Acme leased Pump."), ("b.pdf", 2, " "), (None, 3, "x")], "document string, page_number int, text string")
    g, stats = pipeline.ingest_pages(pages, parser, spans, events=False, store=f"{tmp_path}/g", export=f"{tmp_path}/out")
    assert stats.first().linked_relations == 1 and g.edges.first().predicate == "lease" and g.edges.first().source_documents == ["a.pdf"] and g.events.count() == 0
    assert ST.read_graph(spark, f"{tmp_path}/g").entities.count() == 2


def test_pipeline(spark):
    from veriloom.plans import pipeline

    m = mentions(spark, ("Acme Corporation", "ORG"), ("Acme", "ORG"), ("Priya Singh", "PERSON"), ("Priya", "NOUN_PHRASE"))
    r = rel(spark, {"subject_text": "Priya", "object_text": "Acme Corp", "sentence": "Priya joined Acme Corp on 5 May 2024."}, {"subject_text": "Acme", "object_text": "New Bank"}, {"sentence": " "})
    g, stats = pipeline.ingest(m, r)
    # Also the dropped relation leaves its endpoint "B" as a node.
    assert stats.first().num_entities == 4 and stats.first().linked_relations == 2
    assert g.edges.count() == 2 and g.events.count() == 1
    turn = pipeline.answer("Who joined Acme?", r, generate=lambda q, c: f"{q} {len(c) > 0}")
    assert turn["answer"] == "Who joined Acme? True" and turn["facts"].count() >= 1


def test_cli(capsys):
    from veriloom import cli

    assert cli.main(["--list"]) == 0 and "keyword_topk" in capsys.readouterr().out
    assert cli.main(["nothing", "x"]) == 2
