from pyspark.sql import functions as F

from veriloom.llm import variants


def linked(spark, *names):
    df = spark.createDataFrame([(f"n{i}", n) for i, n in enumerate(names)], "id string, name string")
    return {tuple(r) for r in variants.variant_pairs(df).collect()}


def test_misread_kinds_numbers_and_initials(spark):
    groups = [
        ["nellirvofeld plant 22", "nellirvofeld plnt 22"], ["melvuvubach depot 42", "melvuvubach dpot 42"], ["bavanteiham plant 33", "bavanteiham plan t33"],
        ["klardidudal depot 59", "klardidudal depot5 9"], ["felvirlos hospital", "felvirlos hos pital"], ["christopher kelnovabury", "kristopher kelnovabury"],
        ["alexander r drenkasex", "a. r drenkasex", "a. drenkasex"], ["theodore selgimabach", "the. selgimabach"], ["klardidudal depot 9"], ["drenkasex"],
        ["felvirlos foundation"], ["samuel r drenkasex"],
    ]
    names = [(g, n) for g, ns in enumerate(groups) for n in ns]
    want = {(f"n{i}", f"n{j}") for i, (g, _) in enumerate(names) for j, (h, _) in enumerate(names) if i != j and g == h and f"n{i}" < f"n{j}"}
    assert linked(spark, *(n for _, n in names)) == want


def test_kind_run_together_leaves_the_whole_stem():
    assert variants.parse("norbesedaltelecommunications") == [("O", "telecommunications", "norbesedal", "", "")]
    assert variants.parse("norbesedaltelecomunications")[0][2] == "norbesedal"


def test_initial_that_looks_like_an_article(spark):
    """The normal form drops "A." as an article; spellings with a full stop bring it back, those of a place do not get one."""
    rows = [("1", "r drenkasex", "A.R. Drenkasex", ["A.R. DRENKASEX", None]), ("2", "selgimabach", "Dr. The. Selgimabach", []), ("3", "trolukes", "The Trolukes", ["A. Trolukes", "Trolukes"]),
            ("4", "b rsakick", "A. Bársakick", []), ("5", "kelrond bank", "A Kelrond Bank", [])]
    e = spark.createDataFrame([(*r, []) for r in rows], "id string, normalized_name string, name string, mentions array<string>, alternative_names array<string>")
    got = {r.id: r.name for r in variants.shown_names(e).select("id", F.col("name")).collect()}
    assert got == {"1": "a. r drenkasex", "2": "the. selgimabach", "3": "trolukes", "4": "a. bársakick", "5": "kelrond bank"}


def test_short_stems_and_numbers_of_no_known_kind(spark):
    names = ["abc foundation", "abc fdn", "abd foundation", "abc hospital", "kelrondavik unit 5", "kelrondavk unit 5", "kelrondavik unit 6"]
    assert linked(spark, *names) == {("n0", "n1"), ("n4", "n5")}
