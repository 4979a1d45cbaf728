import pytest
from pyspark.sql import functions as F

from tagweave.functions import text, vocabulary


def labels(spark, values, name="label"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def apply(spark, values, expr):
    rows = labels(spark, values).select("label", expr.alias("out")).collect()
    return {r["label"]: r["out"] for r in rows}


def test_split_and_explode(spark):
    df = spark.createDataFrame([(1, "x; y;z"), (2, None), (3, "a, , b")], "id long, key_words string")
    rows = [tuple(r) for r in text.explode_keywords(df).select("id", "label").collect()]
    assert rows == [(1, "x"), (1, "y,z"), (3, "a"), (3, ""), (3, "b")]


def test_flatten_any_depth(spark):
    df = spark.createDataFrame(
        [([[["a"], ["b", None]], [["c"]]],), ([[None, ["d"]]],), (None,)],
        "k array<array<array<string>>>",
    )
    assert [r[0] for r in text.flatten_keywords(df, "k").collect()] == ["a", "b", "c", "d"]


def test_markup(spark):
    out = apply(
        spark,
        ["a (b) c (d) e", "land use", "New Zealand", "cost & time: both", "a \t b "],
        text.strip_markup(F.col("label")),
    )
    assert out["a (b) c (d) e"] == "a e"
    assert out["land use"] == "l use"
    assert out["New Zealand"] == "New Zeal"
    assert out["cost & time: both"] == "cost time both"
    assert out["a \t b "] == "a b "
    whole = apply(
        spark, ["land and sea", "sand"], text.strip_markup(F.col("label"), whole_word=True)
    )
    assert whole == {"land and sea": "land sea", "sand": "sand"}


def test_synonyms_acronyms_decapitalize(spark):
    assert apply(
        spark,
        ["greenhouse gas emissions", "annual average daily traffic"],
        text.apply_synonyms(F.col("label")),
    ) == {
        "greenhouse gas emissions": "greenhouse gass",
        "annual average daily traffic": "AADT",
    }
    values = ["AADT", "A1", "123", "", "Road"]
    acronym = apply(spark, values, text.is_acronym(F.col("label")))
    assert [acronym[v] for v in values] == [v.isupper() for v in values]
    assert apply(spark, ["AADT", "Road Safety", ""], text.decapitalize(F.col("label"))) == {
        "AADT": "AADT", "Road Safety": "road Safety", "": ""
    }


def test_clean_labels(spark):
    df = labels(
        spark,
        ["annual average daily traffic", "Heavy Vehicles (trucks)", "greenhouse gas emissions", None],
    )
    out = {r["label"]: r["new_label"] for r in text.clean_labels(df).collect()}
    assert out == {
        "annual average daily traffic": "aadt",
        "Heavy Vehicles (trucks)": "heavy vehicles ",
        "greenhouse gas emissions": "greenhouse gass",
        None: None,
    }


@pytest.mark.parametrize(
    "plural, singular",
    [("roads", "road"), ("road safety policies", "road safety policy"), ("bus", "bus"),
     ("gas", "gas"), ("children", "child"), ("crashes", "crash"), ("ties", "tie"),
     ("analyses", "analysis"), ("crossing", "crossing"), ("STATS", "STATS")],
)
def test_singular(spark, plural, singular):
    rows = text.singularize_labels(labels(spark, [plural]), "label", "s").collect()
    assert rows[0]["s"] == singular


def test_singular_exceptions(spark):
    rows = text.singularize_labels(
        labels(spark, ["chassis"]), "label", "s", exceptions={"chassis": "frame"}
    ).collect()
    assert rows[0]["s"] == "frame"


def test_tokens_numbers_punctuation_stop_words(spark):
    assert apply(
        spark, ["Land use, x", "Safety", "a, b", " x", None], text.first_token(F.col("label"))
    ) == {"Land use, x": "Land", "Safety": "Safety", "a, b": "a", " x": "", None: None}
    assert apply(
        spark, ["RR 045a", "none", "12 and 7"], text.paper_number(F.col("label"))
    ) == {"RR 045a": 45.0, "none": None, "12 and 7": 12.0}
    assert apply(spark, ["end-of-life, é!"], text.strip_punctuation(F.col("label"))) == {
        "end-of-life, é!": "endoflife é"
    }
    assert apply(
        spark, [" state of  the art"], text.drop_stop_words(F.col("label"), ["of", "the"])
    ) == {" state of  the art": "state art"}


def test_lemmas(spark):
    lemmas = spark.createDataFrame(
        [("mice", "mouse"), ("mice", "mouse"), ("emissions greenhouse", "emission greenhouse")],
        "surface string, lemma string",
    )
    df = labels(spark, ["mice", "road", "emissions greenhouse", None], "new_label")
    out = [r[0] for r in vocabulary.lemmatize_labels(df, lemmas).collect()]
    assert set(out) == {"mouse", "road", "greenhouse gas", None}
    assert len(out) == 4


# published examples of the suffix rules
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat",
    "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled",
    "motoring": "motor", "sing": "sing", "conflated": "conflat", "sized": "size",
    "hopping": "hop", "falling": "fall", "hissing": "hiss", "fizzed": "fizz",
    "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "rational": "ration",
    "digitizer": "digit", "radicalli": "radic", "vietnamization": "vietnam",
    "operator": "oper", "feudalism": "feudal", "decisiveness": "decis",
    "hopefulness": "hope", "formaliti": "formal", "sensibiliti": "sensibl",
    "triplicate": "triplic", "formative": "form", "electrical": "electr",
    "goodness": "good", "revival": "reviv", "allowance": "allow",
    "airliner": "airlin", "adjustable": "adjust", "replacement": "replac",
    "adoption": "adopt", "communism": "commun", "effective": "effect",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control",
    "roll": "roll", "dying": "die", "yes": "ye", "an": "an", "died": "die",
    "spied": "spi", "geology": "geolog", "road safety": "road safeti",
}


def test_stems(spark):
    out = {
        r["label"]: r["stemmed_version"]
        for r in vocabulary.stem_labels(labels(spark, STEMS)).collect()
    }
    assert out == STEMS


def test_stem_families(spark):
    df = labels(spark, ["road", "roads", "roads", "tyre"])
    assert {tuple(r) for r in vocabulary.stem_families(df).collect()} == {
        ("road", "roads", 2, 3), ("tyre", "tyre", 1, 1)
    }
