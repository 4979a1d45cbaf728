"""Vocabulary preparation, quotient graphs and medians."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tagweave.operators import quotient, ranking
from tagweave.plans import preparation


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = [
        ("RR 1", "Safety, roads", "Bridges (old); land use, annual average daily traffic"),
        ("RR 2", "Land use", "Bridges (old), Traffic Counts"),
        ("RR 3", None, None),
        ("RR 4", " x", ""),
    ]
    return spark.createDataFrame(rows, "report_note_number string, theme string, key_words string")


def test_each_label_is_formed_once(spark, catalogue):
    lemmas = spark.createDataFrame([("traffic count", "count of traffic"), ("nowhere", "x")], "surface string, lemma string")
    done = preparation.prepare_report_keywords(catalogue, lemmas)
    vocabulary = {r["label"]: r for r in done.vocabulary.collect()}
    assert {k: (r["n_reports"], r["new_label"]) for k, r in vocabulary.items()} == {
        "": (1, ""),
        "Bridges (old)": (2, "bridges "),
        "land use": (1, "l use"),
        "Traffic Counts": (1, "count of traffic"),
        "annual average daily traffic": (1, "aadt"),
    }
    rows = {(r["report_note_number"], r["label"]): r for r in done.stems.collect()}
    assert {r for r, _ in rows} == {"RR 1", "RR 2", "RR 4"}
    assert rows["RR 1", "annual average daily traffic"]["new_theme"] == "Safety"
    assert rows["RR 4", ""]["new_theme"] == ""
    assert rows["RR 2", "Traffic Counts"]["new_label"] == "count of traffic"
    assert [r["id"] for r in done.nodes.orderBy("nodes").collect()] == list(range(len(vocabulary)))


def test_forms_equal_those_of_every_row(spark):
    """The dictionary gives what transforming each row gives."""
    from tagweave.functions.text import clean_labels, explode_keywords
    from tagweave.functions.vocabulary import stem_labels

    rng = random.Random(4)
    words = ["Roads", "AADT", "land use", "Studies & tests", "a (b) c", "running: wheels", "greenhouse gas emissions", ""]
    rows = [(i, ", ".join(rng.choice(words) for _ in range(5))) for i in range(200)]
    df = spark.createDataFrame(rows, "report_note_number long, key_words string")
    done = preparation.prepare_report_keywords(df).stems.select("report_note_number", "label", "new_label", "stemmed_version")
    plain = stem_labels(clean_labels(explode_keywords(df)), "new_label").select(done.columns)
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, plain.collect()))
    assert preparation.prepare_report_keywords(df).vocabulary.count() == len(words)


def test_stages_are_written(spark, catalogue, tmp_path):
    preparation.write_prepared(preparation.prepare_report_keywords(catalogue), f"{tmp_path}/out")
    lemmas, stems = (spark.read.parquet(f"{tmp_path}/out/{x}") for x in ("lemmas", "stems"))
    assert set(stems.columns) - set(lemmas.columns) == {"stemmed_version"}
    assert lemmas.count() == stems.count() == 6
    assert spark.read.parquet(f"{tmp_path}/out/nodes").columns == ["id", "nodes", "n_reports", "label"]


def test_quotient(spark):
    elements = [(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, None), (6, None), (7, "d"), (7, "d")]
    links = [(2, 3, "Same"), (1, 4, "Part"), (3, 4, "Part"), (4, 2, "Part"), (1, 2, "Part"), (5, 6, None), (99, 1, "Part"), (4, 99, "Same"), (6, 6, "Part")]
    e = spark.createDataFrame(elements, "id long, label string")
    c = spark.createDataFrame(links, "from long, to long, connection_type string")
    merged, counted = quotient.contract(e, c)
    assert {tuple(r) for r in merged.collect()} == {(1, "a", 3), (4, "c", 1), (5, None, 1), (6, None, 1), (7, "d", 1)}
    assert {tuple(r) for r in counted.collect()} == {(1, 4, "Part", 2), (4, 1, "Part", 1), (5, 6, None, 1), (99, 1, "Part", 1)}


def test_hot_label_contracts(spark):
    e = spark.range(3000).select("id", F.when(F.col("id") < 2500, "one").otherwise(F.col("id").cast("string")).alias("label"))
    c = spark.range(2999).select(F.col("id").alias("from"), (F.col("id") + 1).alias("to"), F.lit("Next").alias("connection_type"))
    merged, counted = quotient.contract(e, c)
    assert merged.count() == 501 and merged.where("id = 0").first()["n_elements"] == 2500
    assert counted.count() == 500


def test_medians(spark):
    rng = random.Random(8)
    groups = {k: [rng.choice([None, rng.randrange(9) / 2, -1.5]) for _ in range(rng.randrange(1, 40))] for k in [None, *"abcdefgh"]}
    groups["hot"] = [i % 700 for i in range(5000)]
    groups["none"] = [None, None]
    rows = [(k, v if v is None else float(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    want = {k: statistics.median([v for v in vs if v is not None]) if any(v is not None for v in vs) else None for k, vs in groups.items()}
    assert {r["k"]: r["median"] for r in ranking.medians(df, "k", "v").collect()} == want
    assert ranking.medians(df.where("false"), "k", "v").isEmpty()


def test_stems_are_numbered_and_the_catalogue_read_once(spark, catalogue, tmp_path):
    catalogue.write.parquet(f"{tmp_path}/raw")
    done = preparation.prepare_report_keywords(spark.read.parquet(f"{tmp_path}/raw"))
    assert f"{tmp_path}/raw" not in done.stems._jdf.queryExecution().executedPlan().toString()
    numbered = done.stem_ids("report_note_number").collect()
    spelled = done.stems.select("report_note_number", "stemmed_version").collect()
    groups = []
    for rows in (numbered, spelled):
        held = {}
        for report, stem in rows:
            held.setdefault(stem, []).append(report)
        groups.append(sorted(map(sorted, held.values())))
    assert groups[0] == groups[1]
