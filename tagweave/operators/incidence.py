"""Who has which key, encoded once, and pairs within groups of any size.

``encode`` reads its input once and shuffles in as many tasks as its rows ask for. What it settles holds 64-bit ids in place of keys (and of items,
unless they are integers), each row once, with the size of its key's group carried along, so
nothing that follows touches a raw phrase, counts groups again or asks for a broadcast.

``blocked_pairs`` lists the pairs within groups. A group of ``n`` rows is cut into
blocks of about ``block`` rows, and pairs of blocks are the join keys: a row is sent to as many
tasks as its group has blocks, and no task ever sees more than two blocks of a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.operators.lineage import discard, settle, shuffles_of

BLOCK = 1000
_INTEGERS = ("tinyint", "smallint", "int", "bigint")


@dataclass(frozen=True)
class Incidence:
    """``rows``: (item, key, n, m), distinct, with the sizes of the key's and of the item's group.

    ``keys``: (key, value, n) and ``items``: (item, value) spell the ids out; ``items`` is
    None where items stand for themselves.
    """

    rows: DataFrame
    keys: DataFrame
    items: DataFrame | None


def _numbered(rows: DataFrame, col: str, size: str) -> DataFrame:
    counted = rows.groupBy(F.col(col).alias("value")).agg(F.count("*").alias(size))
    return settle(counted.withColumn("id", F.monotonically_increasing_id()))


def encode(df: DataFrame, item: str, key: str, n_rows: int | None = None) -> Incidence:
    """Null items are left out, a null key is a key like others.

    ``n_rows`` is about how many rows ``df`` has. Unless the caller knows, ``df`` is written once
    as it comes, for the number of tasks that follows.
    """
    given = df.select(F.col(item).alias("item"), F.col(key).alias("key")).where(F.col("item").isNotNull())
    if n_rows is None:
        given = settle(given)
        n_rows = given.count()
    with shuffles_of(df.sparkSession, n_rows):
        # dealt before rows are told apart: a file's part may be more than a task should hold
        raw = settle(given.repartition("item", "key").distinct())
        discard(given)
        keys = _numbered(raw, "key", "n")
        # few distinct keys are broadcast by the planner, many are joined by shuffle
        rows = raw.join(keys, F.col("key").eqNullSafe(F.col("value"))).select(
            "item", F.col("id").alias("key"), "n"
        )
        plain = dict(raw.dtypes)["item"] in _INTEGERS
        if plain:
            sizes = raw.groupBy("item").agg(F.count("*").alias("m"))
            rows = rows.join(sizes, "item")
            items = None
        else:
            items = _numbered(raw, "item", "m")
            rows = rows.join(items, F.col("item") == F.col("value")).select(
                F.col("id").alias("item"), "key", "n", "m"
            )
            items = items.select(F.col("id").alias("item"), "value")
        rows = settle(rows.select("item", "key", "n", "m"))
        discard(raw)
    return Incidence(rows, keys.select(F.col("id").alias("key"), "value", "n"), items)


def blocked_pairs(
    groups: DataFrame, by: Sequence[str], member: str, size: Column | str, block: int = BLOCK
) -> DataFrame:
    """``(*by, a, b)`` with ``a < b``: all pairs of distinct members of each group.

    ``size`` is the number of rows of a row's group. Members must be distinct within a group.
    """
    blocks = F.ceil((F.col(size) if isinstance(size, str) else size) / block).cast("int")
    placed = groups.select(*by, F.col(member).alias("_m"), blocks.alias("_n")).withColumn(
        "_own", F.pmod(F.xxhash64("_m"), F.col("_n")).cast("int")
    )
    low = placed.select(
        *by, F.col("_m").alias("_x"), F.col("_own").alias("_i"),
        F.explode(F.sequence(F.col("_own"), F.col("_n") - 1)).alias("_j"),
    )
    high = placed.select(
        *by, F.col("_m").alias("_y"), F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_i"),
        F.col("_own").alias("_j"),
    )
    once = (F.col("_i") < F.col("_j")) | (F.col("_x") < F.col("_y"))
    return low.join(high, [*by, "_i", "_j"]).where(once).select(
        *by, F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")
    )


def bounded_pairs(
    groups: DataFrame, by: Sequence[str], member: str, size: str, block: int = BLOCK
) -> DataFrame:
    """``blocked_pairs`` in one shuffle where nearly all groups are small.

    Groups of up to ``block`` rows are gathered in a row each, larger ones are paired in blocks.
    """
    small = (
        groups.where(F.col(size) <= block)
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(member)).alias("_all"))
        .select(*by, "_all", F.posexplode("_all").alias("_at", "a"))
        .select(*by, "a", F.explode(F.slice("_all", F.col("_at") + 2, F.size("_all"))).alias("b"))
    )
    large = groups.where(F.col(size) > block)
    return small.unionByName(blocked_pairs(large, by, member, size, block))


def combinations(rows: DataFrame, size: int, block: int = BLOCK) -> DataFrame:
    """``(item, combo, last)``: the ascending combinations of ``size`` keys of each item.

    ``rows`` is ``(item, key, m)``. Pairs of keys come from ``bounded_pairs``; each further key is
    joined on the item.
    """
    found = bounded_pairs(rows, ["item"], "key", "m", block).select(
        "item", F.array("a", "b").alias("combo"), F.col("b").alias("last")
    )
    for _ in range(size - 2):
        step = rows.select("item", F.col("key").alias("_next"))
        found = found.join(step, "item").where(F.col("last") < F.col("_next")).select(
            "item", F.concat("combo", F.array("_next")).alias("combo"), F.col("_next").alias("last")
        )
    return found


def pairs_by_combination(rows: DataFrame, size: int, block: int = BLOCK) -> DataFrame:
    """``(a, b, meetings)``: in how many groups of ``size`` common keys two items meet.

    Most combinations have up to three items. Their count, ends and checksum already are the answer;
    only members of larger groups are listed and paired in blocks. Nearly all combinations occur once, so
    plain rows are dealt, which are half as wide as those sums.
    """
    if size == 2:
        by = ["k1", "k2"]
        combos = bounded_pairs(rows, ["item"], "key", "m", block).toDF("item", *by)
    else:
        by = ["combo"]
        combos = combinations(rows, size, block).select("item", "combo")
    sizes = combos.repartition(*by).groupBy(*by).agg(
        F.count("*").alias("d"),
        F.min("item").alias("a"),
        F.max("item").alias("b"),
        F.bit_xor("item").alias("x"),
    )
    sizes = settle(sizes.where(F.col("d") > 1))
    # of three the one in the middle is what the ends leave of the checksum
    between = F.col("x").bitwiseXOR(F.col("a")).bitwiseXOR(F.col("b"))
    ends = F.struct("a", "b")
    pairs = F.when(F.col("d") == 2, F.array(ends)).otherwise(
        F.array(ends, F.struct(F.col("a"), between.alias("b")), F.struct(between.alias("a"), F.col("b")))
    )
    met = sizes.where(F.col("d") <= 3).select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    more = sizes.where(F.col("d") > 3).select(*by, "d")
    if not more.isEmpty():
        members = settle(combos.join(more, by))
        met = met.unionByName(blocked_pairs(members, by, "item", "d", block).select("a", "b"))
    return met.groupBy("a", "b").agg(F.count("*").alias("meetings"))


def common_keys(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``(a, b, key)``: the keys that both items of each pair have."""
    one = rows.select(F.col("item").alias("a"), "key")
    other = rows.select(F.col("item").alias("b"), "key")
    return pairs.join(one, "a").join(other, ["b", "key"]).select("a", "b", "key")
