import pytest
from pyspark.sql import functions as F

from veriloom.llm import lookalike, scans, sentences


def units(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").withColumn("start_char", F.lit("clash"))
    out = {i: [] for i in range(len(texts))}
    for r in sentences.sentence_units(df, "k", "t").collect():
        out[r.k].append((r.start_char, r.end_char))
    return [[texts[i][a:b] for a, b in sorted(out[i])] for i in range(len(texts))]


CASES = {
    "Dr. Lee vs. Mr. Fox was adjourned until 3 May 2024. The log says no.": ["Dr. Lee vs. Mr. Fox was adjourned until 3 May 2024.", "The log says no."],
    "They sold the tools, etc. The rest was scrapped.": ["They sold the tools, etc.", "The rest was scrapped."],
    "Pumps, filters, etc. from Acme Ltd. arrived at 9.30 a.m. on 2 May.": ["Pumps, filters, etc. from Acme Ltd. arrived at 9.30 a.m. on 2 May."],
    "“Nobody warned us! We found it ourselves,” Ann told Bob. Really?! Yes.": ["“Nobody warned us! We found it ourselves,” Ann told Bob.", "Really?!", "Yes."],
    "The witness hesitated … then signed. (It is illegible.) A copy was made.": ["The witness hesitated … then signed.", "(It is illegible.)", "A copy was made."],
    "3. Parties\n\nThe log says\nno. 2. They meet again.": ["3. Parties", "The log says\nno.", "2. They meet again."],
    "Am 3. Verhandlungstag kam er, d. h. spät. „Das reicht nicht.“ So war es.": ["Am 3. Verhandlungstag kam er, d. h. spät.", "„Das reicht nicht.“", "So war es."],
    "« Personne ne nous a prévenus ! », a dit Luc. Qui vient ? Luc.": ["« Personne ne nous a prévenus ! », a dit Luc.", "Qui vient ?", "Luc."],
    "¡Qué retraso! Se quejó.La medición sigue.": ["¡Qué retraso!", "Se quejó.", "La medición sigue."],
    "本当か？「困った！知らない。」とXは述べた。温度は4.5度。": ["本当か？", "「困った！知らない。」とXは述べた。", "温度は4.5度。"],
    "माल कब पहुँचेगा? कोई आपत्ति नहीं थी। डॉ. वर्ग आए।": ["माल कब पहुँचेगा?", "कोई आपत्ति नहीं थी।", "डॉ. वर्ग आए।"],
    "เอกสารอื่นยังไม่ครบ บริษัท X ลงนาม": ["เอกสารอื่นยังไม่ครบ", "บริษัท X ลงนาม"],
    "هل وافقت على الدفع؟ لم تدفع المبلغ. نعم": ["هل وافقت على الدفع؟", "لم تدفع المبلغ.", "نعم"],
    "He met Lee, T. A. The board left. e-Carta notices came.": ["He met Lee, T. A.", "The board left.", "e-Carta notices came."],
    "  One 😀 here.  Two. ": ["One 😀 here.", "Two."],
    "": [],
    " \n\t ": [],
}


def test_sentences(spark):
    assert units(spark, *CASES) == list(CASES.values())


def test_sentences_null_and_long(spark):
    assert sentences.sentence_units(spark.createDataFrame([(1, None)], "k long, t string"), "k", "t").count() == 0
    long = "This is a sentence. " * 3000
    assert len(units(spark, long)[0]) == 3000


def test_common_form():
    fold = lookalike.fold
    assert fold("Ｍａｎｕ​⁠ ﬁne x é K 1‑2") == "Manu fine x é K 1-2"
    assert fold("m²") == "m²" and fold("á") != fold("a")


def test_lookalike_words():
    r = lookalike.Reader({"^t": -1.0, "th": -1.0, "he": -1.0, "e$": -1.0})
    assert r.word("thе") == r.word("the") == r.word("tһe") == "the"
    assert r.word("the") != r.word("tha")
    russian = lookalike.Reader({"^с": -1.0, "со": -1.0, "ор": -1.0, "р$": -1.0})
    assert russian.word("cop") == "сор"
    # Accents stay on their letters, whatever script the letter was taken from.
    assert r.word("thе" + chr(0x301)) == r.word("thé") == "thé"
    # A stroke that may be l or I is read as what its neighbours ask for; l and I themselves differ.
    plan = lookalike.Reader({"^p": -1.0, "pl": -1.0, "la": -1.0, "an": -1.0, "n$": -1.0, "^I": -1.0, "IN": -1.0, "N$": -1.0})
    stroke = chr(0x4CF)
    assert plan.word("p" + stroke + "an") == plan.word("plan") == "plan" != plan.word("pIan")
    assert plan.word(stroke + "N") == plan.word("IN") == "IN" != plan.word("lN")


def test_words_in_question(spark):
    words = spark.createDataFrame([("see", 500, 500), ("sec", 100, 100), ("5ec", 2, 2), ("is", 900, 900), ("ls", 1, 1)], "w string, n long, n_low long")
    names = spark.createDataFrame([], "w string")
    found = {(r.w, r.right, r.rare) for r in scans.corrections(words, names).collect()}
    assert ("5ec", "see", True) in found and ("see", "sec", False) in found and ("sec", "see", False) in found and ("ls", "is", False) in found
    pairs = spark.createDataFrame([("please", "see", 90, 0), ("please", "sec", 1, 0), ("ten", "sec", 30, 0), ("it", "is", 80, 0), ("it", "ls", 1, 0)], "a string, b string, n long, n_low long")
    usual = scans.corrections(words, names).filter("not rare").select("w", "right", "n_right")
    got = {(r.w, r.b, r.right, r["at"]) for r in scans.doubted_pairs(usual, pairs).collect()}
    assert got == {("please", "sec", "see", 1), ("it", "ls", "is", 1)}


def test_same_look_pairs(spark):
    rows = [(1, "Thе log"), (2, "The log"), (3, "The log"), (4, "The 1og"), (5, None), (6, ""), (7, " "), (8, "​"), (9, "The lo‍g"), (None, "Thе log")]
    df = spark.createDataFrame(rows, "k long, t string").withColumn("__form", F.lit("clash"))
    got = sorted(tuple(r) for r in lookalike.same_look_pairs(df, "k", "t", "a", "b").collect())
    assert got == [(1, 2), (1, 3), (1, 9), (2, 9), (3, 9)]
    assert lookalike.same_look_pairs(df.limit(0), "k", "t", "a", "b").count() == 0


WORDS = ["", "today", "finally", "perhaps", "again"]


@pytest.fixture(scope="module")
def scan(spark):
    clean = spark.createDataFrame([("the board approved the measurement without changes and said so on paper",)] * 40, "text string")
    pages = []
    for p in range(1, 5):
        t = f"Kelmo Inspection File    Page {p} of 4\n" + ("FINDINGS\n\n" if p == 2 else "") + f"{WORDS[p]} the b0ard appro-\nved themeasurement with out changes {WORDS[p]}\n\nsaid so {WORDS[p]}\n. '\nScanned at depot 5"
        pages.append((p, "a.pdf", p, t))
    pages += [(9, "b.pdf", 1, None), (10, "b.pdf", 2, ""), (1, "a.pdf", 1, pages[0][3])]
    scanned = spark.createDataFrame(pages, "seg_id long, document string, page_number int, text string")
    corpus = clean.union(scanned.select("text"))
    return scans.Scan(scanned, corpus, spark.createDataFrame([("kelmo",)], "w string"))


def test_scan_findings(scan):
    got = {}
    for r in scan.findings().collect():
        got.setdefault((r.seg_id, r.line_no), set()).add(r.kind)
    assert got[(1, 0)] == {"furniture"} and got[(1, 5)] == {"furniture"} and got[(1, 6)] == {"furniture"}
    assert got[(1, 1)] == {"hyphen", "misread"} and got[(1, 2)] == {"misread"} and (1, 4) not in got and (2, 1) not in got


def test_scan_paragraphs(scan):
    text = {(r.seg_id, r.para_no): r.text for r in scan.paragraphs().collect()}
    assert text[(1, 1)] == "today the board approved the measurement without changes today" and text[(1, 2)] == "said so today" and text[(2, 1)] == "FINDINGS"
    assert not any(k[0] in (9, 10) for k in text)


def test_split_words_of_names(spark):
    words = [("valve", 40, 40), ("warehouse", 80, 39), ("kelmo", 40, 0), ("va", 2, 2), ("lve", 2, 2), ("ware", 3, 2), ("house", 3, 2), ("kel", 1, 0), ("mo", 1, 1)]
    pairs = [("va", "lve", 2, 2), ("ware", "house", 3, 2), ("kel", "mo", 1, 0)]
    words, pairs = spark.createDataFrame(words, "w string, n long, n_low long"), spark.createDataFrame(pairs, "a string, b string, n long, n_low long")
    names = spark.createDataFrame([("valve",), ("warehouse",), ("kelmo",)], "w string")
    assert {tuple(r) for r in scans.split_words(words, pairs, names).select("a", "b", "right", "low").collect()} == {("va", "lve", "valve", False), ("ware", "house", "warehouse", True)}


def test_joined_words_of_names(spark):
    words = spark.createDataFrame([("themeter", 1, 1), ("kelmopark", 1, 0)], "w string, n long, n_low long")
    pairs = spark.createDataFrame([("the", "meter", 40, 40), ("kelmo", "park", 40, 0)], "a string, b string, n long, n_low long")
    names = spark.createDataFrame([("themeter",), ("kelmopark",)], "w string")
    assert [tuple(r) for r in scans.joined_words(words, pairs, names).collect()] == [("themeter", "the meter", 40, True)]


def test_page_numbers_inside_a_page(spark):
    body = [f"line {w} of the text goes on" for w in "one two three four five six seven eight nine ten".split()]
    at = {1: (5, "- 1 -"), 2: (0, "2"), 3: (0, "3"), 4: (5, "4"), 5: (5, "17"), 6: (0, "6")}
    pages = [(p, "a.pdf", p, "\n".join(body[:i] + [n] + body[i:])) for p, (i, n) in at.items()]
    pages[5] = (6, "a.pdf", 6, pages[5][3].replace(body[4], "6"))  # a second number that happens to fit
    head = "Kelmo Inspection File"
    pages += [(10 + p, "b.pdf", p, "\n".join(body[:5] + [head] + [n] + body[5:])) for p, n in ((1, "i"), (2, "Page 7 of 9"), (3, "2024"))]
    pages += [(10 + p, "b.pdf", p, "\n".join([head, *body])) for p in (4, 5)]
    scanned = spark.createDataFrame(pages, "seg_id long, document string, page_number int, text string")
    got = {tuple(r) for r in scans.furniture(scans.keyed_lines(scanned), scanned.select("seg_id", "document")).select("seg_id", "line_no").collect()}
    assert {(1, 5), (4, 5), (2, 0), (3, 0), (6, 0), (11, 6), (12, 6)} <= got
    assert not {(5, 5), (6, 5), (13, 6)} & got


def test_number_of(spark):
    shown = {"Page l of 4": 1, "S. 12": 12, "— 3 —": 3, "xiv": 14, "lll": 3, "1O": 10, "vx": None, "2024-05": None}
    df = spark.createDataFrame([(k,) for k in shown], "t string").select("t", scans.number_of(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == shown


def test_compounds_of_other_pages(spark):
    scanned = spark.createDataFrame([(1, "a.pdf", 1, "it was a cross-\nborder case\nand mea-\nsured twice")], "seg_id long, document string, page_number int, text string")
    clean = spark.createDataFrame([("a cross-border case, measured in a crossborder way",), ("a cross-border case",)], "text string")
    scan = scans.Scan(scanned, scanned.select("text").union(clean), spark.createDataFrame([], "w string"))
    assert [(r.line_no, r.a, r.b) for r in scan.divided.collect()] == [(2, "mea", "sured")]


def test_long_quotations(spark):
    told = "We found it. " * 60
    texts = [f"“{told}It was late,” Ann told Bob. Yes.", f"„{told}Es war spät“, sagte er. Ja.", f"“Open. {told}Nobody closed it."]
    got = units(spark, *texts)
    assert got[0] == [texts[0][:-5], "Yes."] and got[1] == [texts[1][:-4], "Ja."] and len(got[2]) == 62
