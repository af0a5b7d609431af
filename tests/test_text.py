from pyspark.sql import functions as F

from veriloom.functions import text as X


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()[0]


def test_names(spark):
    cases = {
        "The ABC Bank Ltd.": "abc bank", "Dr. Smith's": "smith", "The Company": "", "ACME pvt. ltd": "acme", "«Ünïcode»": "n code",
        None: "", "   ": "", "Acme Holdings Group": "acme",
    }
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, t string").select("i", X.normalize_name(F.col("t")).alias("n"))
    got = dict(df.collect())
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_relation_types(spark):
    assert one(spark, X.sanitize_rel_type(F.col("a")), a="2022") == "REL_2022"
    assert one(spark, X.sanitize_rel_type(F.col("a")), a=" work at! ") == "WORK_AT"
    assert one(spark, X.sanitize_rel_type(F.col("a")), a=None) == "RELATED_TO"
    assert one(spark, X.normalize_relation(F.col("a")), a="is-based in") == "IS_BASED_IN"


def test_ids_match_their_public_definitions(spark):
    import hashlib
    import uuid

    assert one(spark, X.entity_id(F.col("a"), F.col("b")), a="ORG", b="acme") == "entity_" + hashlib.sha256(b"ORG||acme").hexdigest()[:12]
    assert one(spark, X.point_id(F.col("a"), F.col("b"), F.col("c")), a="d", b="säntence", c="p") == str(uuid.uuid5(uuid.NAMESPACE_URL, "d||säntence||p"))


def test_endpoints_amounts_codes_dates(spark):
    assert [one(spark, X.valid_endpoint(F.col("a")), a=v) for v in ("it", "x", "12,000.5", "The bank", None, "y" * 81)] == [False, False, False, True, False, False]
    assert one(spark, X.amount_like(F.col("a")), a="INR 1,200")
    assert not one(spark, X.amount_like(F.col("a")), a="three loans of the 2nd bank")
    assert one(spark, X.id_codes(F.col("a")), a="see LN30002, PO-26418/7 and xAB12") == ["LN30002", "PO-26418"]
    assert one(spark, X.first_date(F.col("a")), a="on 5 february 2025, then") == "5 february 2025"
    assert one(spark, X.first_date(F.col("a")), a="no date") is None


def test_scores_and_acronyms(spark):
    assert one(spark, X.score_hundredths(F.col("a"), F.col("b"), F.lit(False), F.lit(False)), a="Acme", b="beta") == 80
    assert one(spark, X.score_hundredths(F.col("a"), F.col("b"), F.lit(True), F.lit(False)), a="Acme", b="a b c d e f g") == 65
    assert one(spark, X.is_acronym(F.col("a"), F.col("b")), a="NSF", b="National Science Foundation")
    assert not one(spark, X.is_acronym(F.col("a"), F.col("b")), a="N", b="National Science Foundation")
    assert one(spark, X.entity_like(F.col("a")), a='what is "x y"?')


def test_sql_functions(spark):
    X.register_sql_functions(spark)
    assert spark.sql("select veriloom_name('The Acme Ltd.'), veriloom_relation('Based in')").first()[:] == ("acme", "BASED_IN")
