"""Which items share how many keys, without listing every pair in a group.

A key that ``d`` items carry would give ``d * (d - 1) / 2`` pairs, and one hot
key would swamp the job. But a graph only keeps pairs that share at least
``min_shared >= 2`` keys, which allows two exact ways around it. The group sizes of
the encoded table (``incidence``) tell which one is cheaper.

*By combination*: items with few keys are grouped by each combination of
``min_shared`` of their keys. Every pair found is a result, however hot a key.

*By key*, for items with very many keys: ordinary keys have at most ``hot_at``
rows, so joining on them makes at most ``hot_at / 2`` pairs per row. Hot keys
never act as a join key alone, but only in combinations of ``min_shared``. Both
kinds of pairs then have their hot keys counted by equi-joins.

Whatever the way, groups are paired in blocks, so a hot group is dealt over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.operators.incidence import (
    Incidence,
    blocked_pairs,
    common_keys,
    encode,
    pairs_by_combination,
)
from tagweave.operators.lineage import settle, shuffles_of

HOT_AT = 1000
# a row of a combination is wider than a plain pair
COMBINATION_COST = 2


def drop_stop_keywords(
    df: DataFrame, stop: Sequence[str] | DataFrame, col: str = "new_label"
) -> DataFrame:
    """Remove stop-listed keywords; a null keyword is not on the list and stays.

    A long list can be a DataFrame whose first column holds the keywords.
    """
    if isinstance(stop, DataFrame):
        listed = stop.select(F.col(stop.columns[0]).alias("_stop")).distinct()
        return df.join(listed, df[col] == listed["_stop"], "left_anti")
    return df.where(~F.coalesce(F.col(col).isin(*stop), F.lit(False)))


def _ways(n: str, choose: int):
    """C(n, choose) as a double."""
    ways = F.lit(1.0)
    for i in range(choose):
        ways = ways * F.greatest(F.col(n).cast("double") - i, F.lit(0.0)) / (i + 1)
    return ways


def _sizes(table: Incidence, min_shared: int, hot_at: int) -> dict[str, float]:
    """Sizes of the groups: the largest of a key, rows, and pairs by key, ordinary key and combination."""
    zero = F.lit(0.0)
    ways = _ways("n", 2)
    by_key = table.keys.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("largest"),
        F.coalesce(F.sum(ways), zero).alias("key"),
        F.coalesce(F.sum(F.when(F.col("n") <= hot_at, ways)), zero).alias("ordinary"),
    ).first()
    # an item has as many rows as keys, so each row stands for its part of the combinations
    by_item = table.rows.agg(
        F.coalesce(F.sum(_ways("m", min_shared) / F.col("m")), zero).alias("combination"),
        F.count("*").alias("rows"),
    ).first()
    return by_key.asDict() | by_item.asDict()


def _cheaper(sizes: dict[str, float], hot_at: int) -> str:
    if sizes["combination"] * COMBINATION_COST <= sizes["key"]:
        return "combination"
    return "ordinary" if sizes["largest"] <= hot_at else "key"


def _route(table: Incidence, min_shared: int, hot_at: int) -> str:
    """The cheaper way to the pairs, by the sizes of the groups."""
    return _cheaper(_sizes(table, min_shared, hot_at), hot_at)


def _paired(rows: DataFrame, min_shared: int) -> DataFrame:
    """Rows that can take part in a pair."""
    return rows.where((F.col("n") > 1) & (F.col("m") >= min_shared))


def _pairs_by_combination(rows: DataFrame, size: int, block: int) -> DataFrame:
    """``(a, b, n)`` from items grouped by every combination of their keys.

    A pair with ``n`` keys in common meets in ``C(n, size)`` groups. For two, ``n`` is
    solved from that; for more, the common keys of the pairs found are counted.
    """
    meetings = pairs_by_combination(rows, size, block)
    if size == 2:
        # the rounded root is right up to n around 10^8, far beyond what an item can combine
        n = F.round((1 + F.sqrt(1 + 8 * F.col("meetings").cast("double"))) / 2).cast("long")
        return meetings.select("a", "b", n.alias("n"))
    found = settle(meetings.select("a", "b"))
    return common_keys(found, rows).groupBy("a", "b").agg(F.count("*").alias("n"))


def _pairs_by_ordinary_key(rows: DataFrame, block: int) -> DataFrame:
    counted = blocked_pairs(rows, ["key"], "item", "n", block).groupBy("a", "b")
    return counted.agg(F.count("*").alias("n"))


def _pairs_by_key(rows: DataFrame, min_shared: int, hot_at: int) -> DataFrame:
    """``(a, b, n)`` from joins on ordinary keys and on hot combinations."""
    light = rows.where(F.col("n") <= hot_at)
    heavy = rows.where(F.col("n") > hot_at)
    n_heavy = heavy.groupBy("item").agg(F.count("*").alias("n_heavy"))
    heavy = settle(heavy.join(n_heavy, "item").select("item", "key", F.col("n_heavy").alias("m")))
    n_heavy = heavy.select("item", F.col("m").alias("n_heavy")).distinct()

    by_light = _pairs_by_ordinary_key(light, hot_at).withColumnRenamed("n", "n_light")
    # a pair short of ordinary keys can only make it up with hot ones
    reachable = F.col("n_light") + F.least(
        F.coalesce("h1.n_heavy", F.lit(0)), F.coalesce("h2.n_heavy", F.lit(0))
    )
    by_light = (
        by_light.join(n_heavy.alias("h1"), F.col("a") == F.col("h1.item"), "left")
        .join(n_heavy.alias("h2"), F.col("b") == F.col("h2.item"), "left")
        .where(reachable >= min_shared)
        .select("a", "b", "n_light")
    )
    by_heavy = pairs_by_combination(heavy, min_shared, hot_at).select("a", "b")
    candidates = settle(
        by_light.unionByName(by_heavy.withColumn("n_light", F.lit(0).cast("long")))
        .groupBy("a", "b")
        .agg(F.sum("n_light").alias("n_light"))
    )
    common = common_keys(candidates.select("a", "b"), heavy).groupBy("a", "b")
    common_hot = common.agg(F.count("*").alias("n_hot"))
    return candidates.join(common_hot, ["a", "b"], "left").select(
        "a", "b", (F.col("n_light") + F.coalesce("n_hot", F.lit(0))).alias("n")
    )


def _encoded(df: DataFrame | Incidence, item: str, key: str, n_rows: int | None = None) -> Incidence:
    return df if isinstance(df, Incidence) else encode(df, item, key, n_rows)


def _strong(
    table: Incidence,
    min_shared: int,
    hot_at: int,
    route: str | None,
    finish: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
) -> DataFrame:
    """``(a, b, n)`` with encoded items, as ``finish`` leaves them, settled."""
    if min_shared < 2:
        raise ValueError("min_shared must be at least 2; see pair_weights")
    sizes = _sizes(table, min_shared, hot_at)
    route = route or _cheaper(sizes, hot_at)
    # hot keys are no join keys; a row goes to one block at least
    listed = sizes["combination" if route == "combination" else "ordinary"]
    rows = _paired(table.rows, min_shared)
    with shuffles_of(rows.sparkSession, max(listed, sizes["rows"])):
        if route == "combination":
            pairs = _pairs_by_combination(rows, min_shared, hot_at)
        elif route == "ordinary":
            pairs = _pairs_by_ordinary_key(rows, hot_at)
        else:
            pairs = _pairs_by_key(rows, min_shared, hot_at)
        return settle(finish(pairs.where(F.col("n") >= min_shared)))


def _spelled(pairs: DataFrame, table: Incidence) -> DataFrame:
    """``pairs`` with items instead of their ids, the smaller one first."""
    if table.items is None:
        return pairs
    for end in ("a", "b"):
        names = table.items.select(F.col("item").alias(end), F.col("value").alias(f"_{end}"))
        pairs = pairs.join(names, end).drop(end)
    both = pairs.withColumns({"a": F.least("_a", "_b"), "b": F.greatest("_a", "_b")})
    return both.select("a", "b", *(c for c in pairs.columns if c not in ("_a", "_b")))


def shared_pairs(
    df: DataFrame | Incidence,
    item: str = "item",
    key: str = "key",
    min_shared: int = 2,
    hot_at: int = HOT_AT,
    names: tuple[str, str, str] = ("item_1", "item_2", "shared"),
    route: str | None = None,
    n_rows: int | None = None,
) -> DataFrame:
    """Pairs of items with at least ``min_shared`` distinct keys in common.

    Each unordered pair comes once, smaller item first. Null items never pair;
    a null key counts as one key. A threshold of one would ask for every pair
    in every group; :func:`pair_weights` counts those without listing them.
    ``df`` may be a table that :func:`incidence.encode` made, to be used again.
    ``route`` ("combination", "ordinary" or "key") overrides the choice by group sizes.
    ``n_rows``: about how many rows ``df`` has, if that is known; see :func:`incidence.encode`.
    """
    if min_shared < 2:
        raise ValueError("min_shared must be at least 2; see pair_weights")
    table = _encoded(df, item, key, n_rows)
    pairs = _strong(table, min_shared, hot_at, route)
    found = _spelled(pairs, table).toDF(*names)
    if table.items is None:
        found.settled_path = pairs.settled_path
    return found


def cooccurrence_pairs(
    df: DataFrame | Incidence,
    item: str = "item",
    key: str = "key",
    min_shared: int = 2,
    hot_at: int = HOT_AT,
    names: tuple[str, str, str] = ("item_1", "item_2", "key"),
) -> DataFrame:
    """The keys behind each pair of :func:`shared_pairs`, one row per key."""
    table = _encoded(df, item, key)
    pairs = _strong(table, min_shared, hot_at, None, lambda found: found.select("a", "b"))
    shared = common_keys(pairs, _paired(table.rows, min_shared))
    named = shared.join(table.keys.select("key", "value"), "key").select("a", "b", "value")
    return _spelled(named, table).toDF(*names)


def shared_keyword_counts(
    pairs: DataFrame, by: Sequence[str], key: str, name: str = "shared_keywords"
) -> DataFrame:
    """Distinct keys per pair of rows from outside; null counts as one key."""
    return pairs.groupBy(*by).agg(
        (F.count_distinct(key) + F.max(F.col(key).isNull().cast("int"))).alias(name)
    )


def pair_weights(
    df: DataFrame | Incidence, item: str = "item", key: str = "key", hot_at: int = HOT_AT
) -> DataFrame:
    """How many pairs share exactly 1, 2, 3, … keys, as ``(weight, n_pairs)``.

    Pairs with one key in common are not enumerated: the group sizes give the
    total over all pairs of their weights, and the heavier pairs are known.
    """
    table = _encoded(df, item, key)
    strong = _strong(
        table, 2, hot_at, None,
        lambda found: found.groupBy(F.col("n").alias("weight")).agg(F.count("*").alias("n")),
    )
    d = F.col("n").cast("decimal(38,0)")
    total = table.keys.agg(F.sum((d * (d - 1)).cast("decimal(38,0)")).alias("n")).select(
        F.lit(1).cast("long").alias("weight"), F.expr("n div 2").alias("n")
    )
    taken = strong.select(
        F.lit(1).cast("long").alias("weight"), (-F.col("weight") * F.col("n")).alias("n")
    )
    return (
        strong.unionByName(total)
        .unionByName(taken)
        .groupBy("weight")
        .agg(F.sum("n").cast("long").alias("n_pairs"))
        .where(F.col("n_pairs") != 0)
    )


def min_weight(edges: DataFrame, n: int, col: str = "shared_keywords") -> DataFrame:
    return edges.where(F.col(col) >= n)


def touching(
    edges: DataFrame, value: str, cols: tuple[str, str] = ("new_theme1", "new_theme2")
) -> DataFrame:
    """Edges with the value on either side."""
    return edges.where((F.col(cols[0]) == value) | (F.col(cols[1]) == value))


def with_endpoint_attrs(
    edges: DataFrame,
    attrs: DataFrame,
    id_col: str,
    col: str,
    ends: tuple[str, str] = ("paper_1", "paper_2"),
) -> DataFrame:
    """``col`` of both endpoints as ``col1`` and ``col2``.

    An endpoint with several values multiplies its edges, one without gets null.
    """
    edges = edges if hasattr(edges, "settled_path") else settle(edges)
    # only the endpoints' attributes are sorted out, not those of the whole table
    needed = edges.select(F.explode(F.array(*ends)).alias("_id"))
    lookup = settle(
        attrs.select(F.col(id_col).alias("_id"), col).join(needed, "_id", "left_semi").distinct()
    )
    for i, end in enumerate(ends, start=1):
        side = lookup.toDF(f"_id{i}", f"{col}{i}")
        edges = edges.join(side, F.col(end) == F.col(f"_id{i}"), "left").drop(f"_id{i}")
    return edges


def dedupe_reversed(
    edges: DataFrame, a: str, b: str, order: Sequence[str]
) -> DataFrame:
    """Keep one row per unordered pair: the first by ``order``.

    ``min_by`` combines before the shuffle, so many copies of one pair are fine.
    """
    first = F.min_by(F.struct(*edges.columns), F.struct(*order))
    return (
        edges.groupBy(F.least(a, b).alias("_lo"), F.greatest(a, b).alias("_hi"))
        .agg(first.alias("_row"))
        .select("_row.*")
    )


def symmetric_edges(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Every edge in both directions, attributes copied."""
    swap = {src: dst, dst: src}
    back = edges.select(*[F.col(c).alias(swap.get(c, c)) for c in edges.columns])
    return edges.unionByName(back)


def keyword_counts(df: DataFrame, col: str = "label", out: str = "n_reports") -> DataFrame:
    """Occurrences per raw, case-sensitive keyword; nulls are left out."""
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(F.col(col).alias("nodes"))
        .agg(F.count("*").alias(out))
    )
