"""The stages in a row, against the same steps on plain lists."""

from collections import Counter

from corpus_pipeline import COLUMNS, STAGES

WORDS = [f"alpha{i} beta{i * 7 % 90} gamma{i % 40}" for i in range(400)]


def text(i):
    return "\n".join(" ".join(WORDS[(i * 31 + 13 * k + j) % 400] for j in range(9)) for k in range(4))


def test_stages(spark, tmp_path):
    rows = [(i, text(i), "en", f"s{i % 4}", len(text(i))) for i in range(60)]
    rows += [(100, text(3), "en", "s1", 9), (101, "too short", "en", "s1", 9), (102, None, None, None, None), (100, text(3), "en", "s1", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = {}
    for name, stage in STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == COLUMNS
    quality = [r.doc_id for r in seen["quality"]]
    assert not {101, 102} & set(quality) and set(range(40)) <= set(quality)
    assert len(seen["line_dedup"]) == len(quality)
    assert {r.text for r in seen["line_dedup"] if r.doc_id == 100} == {""}
    once = Counter(r.doc_id for r in seen["simhash"])
    assert max(once.values()) == 1
    mixed = Counter(r.doc_id for r in seen["mixing"])
    assert set(mixed) <= set(once) and max(mixed.values()) <= 2
    pieces = Counter(r.doc_id for r in seen["packing"] if r.piece == 0)
    assert pieces == mixed
