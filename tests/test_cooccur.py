import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tagweave.operators import cooccur
from tagweave.operators.incidence import blocked_pairs, combinations as key_combinations, encode


def brute_force(rows, min_shared):
    keys = {}
    for item, key in rows:
        if item is not None:
            keys.setdefault(item, set()).add(key)
    found = {}
    for a, b in combinations(sorted(keys), 2):
        n = len(keys[a] & keys[b])
        if n >= min_shared:
            found[a, b] = n
    return found


def as_dict(df):
    return {(r[0], r[1]): r[2] for r in df.collect()}


@pytest.fixture(scope="module")
def skewed():
    """A third of all rows carry one key, a null key is common, one item is huge."""
    rng = random.Random(7)
    rows = []
    for item in range(60):
        rows.append((item, "hot"))
        rows += [(item, None)] * (rng.random() < 0.5)
        rows += [(item, f"warm{rng.randrange(4)}") for _ in range(2)]
        rows += [(item, f"k{rng.randrange(80)}") for _ in range(rng.randrange(4))]
    rows += [(99, f"k{i}") for i in range(80)]
    rows += [(None, "hot"), (None, "k1")]
    return rows + rows[:50]


@pytest.mark.parametrize("min_shared", [2, 3, 4])
@pytest.mark.parametrize("route", ["combination", "key", "ordinary", None])
def test_shared_pairs_match_brute_force(spark, skewed, min_shared, route):
    df = spark.createDataFrame(skewed, "item long, key string")
    if route == "combination" and min_shared > 2:
        # an item with many keys has too many combinations for a test
        df = df.where("item <> 99")
        expected = brute_force([r for r in skewed if r[0] != 99], min_shared)
    else:
        expected = brute_force(skewed, min_shared)
    found = cooccur.shared_pairs(df, "item", "key", min_shared, hot_at=12, route=route)
    assert as_dict(found) == expected


@pytest.mark.parametrize("route", ["combination", "key", "ordinary"])
def test_many_common_keys_are_counted(spark, route):
    rows = spark.range(1010).selectExpr("explode(array(1L, 2L)) AS item", "id AS key")
    found = cooccur.shared_pairs(rows, "item", "key", 2, route=route)
    assert as_dict(found) == {(1, 2): 1010}


def test_threshold_one_is_refused(spark):
    df = spark.createDataFrame([(1, "a")], "item long, key string")
    with pytest.raises(ValueError):
        cooccur.shared_pairs(df, "item", "key", 1)


def test_pairs_list_the_shared_keys(spark, skewed):
    df = spark.createDataFrame(skewed, "item long, key string")
    rows = cooccur.cooccurrence_pairs(df, "item", "key", 2, hot_at=12)
    counts = Counter((r["item_1"], r["item_2"]) for r in rows.collect())
    assert counts == brute_force(skewed, 2)
    again = cooccur.shared_keyword_counts(rows, ["item_1", "item_2"], "key")
    assert as_dict(again) == brute_force(skewed, 2)


def test_pair_weights_include_single_keys(spark, skewed):
    df = spark.createDataFrame(skewed, "item long, key string")
    found = {r["weight"]: r["n_pairs"] for r in cooccur.pair_weights(df, "item", "key", 12).collect()}
    assert found == Counter(brute_force(skewed, 1).values())


def test_route_follows_group_sizes(spark):
    hot = [(i, k) for i in range(400) for k in ("a", f"k{i}")]
    rows = spark.createDataFrame(hot, "item long, key string")
    assert cooccur._route(encode(rows, "item", "key"), 2, 1000) == "combination"
    few = spark.createDataFrame([(i // 3, f"k{i % 50}") for i in range(100)], "item long, key string")
    assert cooccur._route(encode(few, "item", "key"), 2, 1000) == "ordinary"
    assert cooccur._route(encode(few, "item", "key"), 2, 1) == "key"


def test_two_papers_sharing_only_a_missing_label(spark):
    df = spark.createDataFrame(
        [("a", None), ("b", None), ("a", "x"), ("b", "x")], "item string, key string"
    )
    for route in ("combination", "key"):
        found = cooccur.shared_pairs(df, "item", "key", 2, hot_at=1, route=route)
        assert as_dict(found) == {("a", "b"): 2}


def test_stop_keywords_keep_nulls(spark):
    df = spark.createDataFrame([(None,), ("road",), ("tyre",)], "new_label string")
    stop = spark.createDataFrame([("road",)], "word string")
    for words in (["road", "transport"], stop):
        kept = cooccur.drop_stop_keywords(df, words).collect()
        assert {r[0] for r in kept} == {None, "tyre"}


def test_themes_multiply_edges_and_match_either_side(spark):
    edges = spark.createDataFrame([("a", "b", 2), ("b", "c", 3)],
                                  "paper_1 string, paper_2 string, shared_keywords long")
    themes = spark.createDataFrame(
        [("a", "Safety"), ("a", "Risk"), ("a", "Risk"), ("b", "Land")],
        "report_note_number string, new_theme string",
    )
    themed = cooccur.with_endpoint_attrs(edges, themes, "report_note_number", "new_theme")
    assert {tuple(r) for r in themed.collect()} == {
        ("a", "b", 2, "Safety", "Land"),
        ("a", "b", 2, "Risk", "Land"),
        ("b", "c", 3, "Land", None),
    }
    assert cooccur.touching(themed, "Safety").count() == 1
    assert cooccur.min_weight(themed, 3).count() == 1


def test_reversed_duplicates_keep_the_first(spark):
    df = spark.createDataFrame(
        [(2, 1, "x"), (1, 2, "y"), (3, 1, "z")], "a long, b long, v string"
    )
    kept = cooccur.dedupe_reversed(df, "a", "b", ["a", "b"])
    assert {tuple(r) for r in kept.collect()} == {(1, 2, "y"), (3, 1, "z")}
    both = cooccur.symmetric_edges(kept, "a", "b")
    assert {tuple(r) for r in both.collect()} == {
        (1, 2, "y"), (2, 1, "y"), (3, 1, "z"), (1, 3, "z")
    }


def test_keyword_counts_are_case_sensitive(spark):
    df = spark.createDataFrame([("Bridges",), ("bridges",), ("bridges",), (None,)], "label string")
    assert {tuple(r) for r in cooccur.keyword_counts(df).collect()} == {("Bridges", 1), ("bridges", 2)}


@pytest.mark.parametrize("block", [1, 3, 10, 1000])
def test_blocked_pairs(spark, block):
    rng = random.Random(block)
    groups = {g: rng.sample(range(-50, 50), rng.randrange(1, 30)) for g in range(12)}
    rows = [(g, m, len(ms)) for g, ms in groups.items() for m in ms]
    df = spark.createDataFrame(rows, "g int, m long, n long")
    got = Counter(map(tuple, blocked_pairs(df, ["g"], "m", "n", block).collect()))
    assert got == Counter((g, a, b) for g, ms in groups.items() for a, b in combinations(sorted(ms), 2))


def test_no_task_holds_a_hot_group(spark):
    """2,000 rows of one key in blocks of 100 meet under 210 join keys of at most 10,000 pairs."""
    rows = spark.range(2000).selectExpr("1 AS g", "id AS m", "2000L AS n")
    joined = blocked_pairs(rows, ["g"], "m", "n", 100)
    assert joined.count() == 2000 * 1999 // 2
    plan = joined._jdf.queryExecution().analyzed().toString()
    assert "_i" in plan and "_j" in plan
    block = "pmod(xxhash64(m), 20)"
    sizes = [r.n for r in rows.groupBy(F.expr(block)).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 20 and max(sizes) < 150


def test_combinations_of_keys(spark):
    keys = {1: [1, 4, 6, 9], 2: [1, 2], 3: [5], 4: [1, 2, 3]}
    rows = spark.createDataFrame([(i, k, len(ks)) for i, ks in keys.items() for k in ks], "item int, key long, m long")
    got = {(r.item, *r.combo) for r in key_combinations(rows, 3, 2).collect()}
    assert got == {(i, *c) for i, ks in keys.items() for c in combinations(ks, 3)}


@pytest.mark.parametrize("route", ["combination", "key", "ordinary"])
def test_text_items_are_encoded(spark, skewed, route):
    rows = [(None if i is None else f"i{i}", k) for i, k in skewed]
    df = spark.createDataFrame(rows, "item string, key string")
    found = cooccur.shared_pairs(df, "item", "key", 2, hot_at=12, route=route)
    assert as_dict(found) == brute_force(rows, 2)


def test_encoded_once_used_often(spark, skewed):
    table = encode(spark.createDataFrame(skewed, "item long, key string"), "item", "key")
    distinct = {(i, k) for i, k in skewed if i is not None}
    spelled = table.rows.join(table.keys.select("key", "value"), "key")
    assert {(r["item"], r["value"]) for r in spelled.collect()} == distinct
    per_key, per_item = Counter(k for _, k in distinct), Counter(i for i, _ in distinct)
    assert all(r["n"] == per_key[r["value"]] and r["m"] == per_item[r["item"]] for r in spelled.collect())
    assert as_dict(cooccur.shared_pairs(table, min_shared=3, hot_at=12)) == brute_force(skewed, 3)
    weights = {r["weight"]: r["n_pairs"] for r in cooccur.pair_weights(table, hot_at=12).collect()}
    assert weights == Counter(brute_force(skewed, 1).values())


def test_input_is_read_once(spark, skewed, tmp_path):
    spark.createDataFrame(skewed, "item long, key string").write.parquet(f"{tmp_path}/in")
    found = cooccur.shared_pairs(spark.read.parquet(f"{tmp_path}/in"), "item", "key")
    assert f"{tmp_path}/in" not in found._jdf.queryExecution().executedPlan().toString()


def test_tasks_follow_the_rows(spark, monkeypatch):
    """Pairs are dealt over more tasks than the session's four where they are many."""
    from tagweave.operators import lineage

    monkeypatch.setattr(lineage, "ROWS_PER_TASK", 100, raising=False)
    settings = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(s) for s in settings]
    rows = [(i, i * 7 % 60 + j) for i in range(400) for j in range(3)]
    df = spark.createDataFrame(rows, "item long, key long")
    table = encode(df, "item", "key")
    for route in ("combination", "ordinary"):
        found = cooccur.shared_pairs(table, hot_at=25, route=route)
        assert len(found.inputFiles()) > 4
        assert as_dict(found) == brute_force(rows, 2)
    assert as_dict(cooccur.shared_pairs(df, "item", "key", n_rows=1000)) == brute_force(rows, 2)
    assert [spark.conf.get(s) for s in settings] == before


def test_joins_of_small_parts_are_hashed(spark):
    """Within ``shuffles_of`` no side is sorted for a join of which one has small parts; afterwards all is as before."""
    from tagweave.operators.lineage import shuffles_of

    names = ("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(s) for s in (*names, "spark.sql.shuffle.partitions")]
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(3000).selectExpr("id AS item", "if(id % 9 = 0, null, concat('k', id % 50)) AS key")
        sizes = rows.groupBy(F.col("key").alias("value")).agg(F.count("*").alias("n"))
        with shuffles_of(spark, 3000):
            joined = rows.join(sizes, F.col("key").eqNullSafe(F.col("value")))
            assert {(r.key, r.n) for r in joined.collect()} == {(r.value, r.n) for r in sizes.collect()}
            plan = joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert [spark.conf.get(s) for s in (*names, "spark.sql.shuffle.partitions")] == before


def test_settled_pairs_are_not_written_again(spark, monkeypatch):
    rows = [(i, i * 7 % 60 + j) for i in range(100) for j in range(3)]
    pairs = cooccur.shared_pairs(spark.createDataFrame(rows, "item long, key long"), names=("paper_1", "paper_2", "n"))
    written = []
    monkeypatch.setattr(cooccur, "settle", lambda df: written.append(df.columns) or df)
    themes = spark.createDataFrame([(i, i % 2) for i in range(100)], "id long, theme long")
    cooccur.with_endpoint_attrs(pairs, themes, "id", "theme")
    assert written == [["_id", "theme"]]
