"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern (the
set of their sources). Token capacity flows from patterns to source quotas; a pattern's
first pass over its documents is free, its second costs 1 a token, a third 2 and so
on, up to ``max_repeats`` (convex costs, so cheaper passes fill first). The flow is solved on the
aggregated patterns by successive shortest paths; only those reach the driver, at most
``MAX_PATTERNS`` of them (more are an error, not a cut).

A pattern's documents are then selected by a seeded order: whole passes over all of them, and one
more pass over the first ones in order of md5(seed:doc_id), id and hash of the text, up to the
token count that is nearest to the flow. The order is never sorted as a whole: sizes
are summed by the first digits of the hash, and only the documents in the digit group
where the flow ends are ranked one by one. So each pattern has one place in the order up to
which documents are taken once more, and documents are decided without a shuffle.

Null sources are a source of their own, last. Null texts have size 0; their documents,
like all of size 0, are taken 0 times. Rows with one id and one text are taken together; rows
without id are ordered by their text instead. Empty tables give empty results. Other columns pass through.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.common import SPACE_CLASS, SPACES
from tagweave.operators.lineage import settle

MAX_PATTERNS = 100_000
MAX_REPEATS = 2
SEED = "mix-1"
DIGITS = 3
FIRST = -(1 << 63)
SHARE = 1.5
WEIGHTS = (3.0, 1.0, 2.0)


def word_count(text: str = "text") -> Column:
    bare = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACES))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACE_CLASS + "+"))).cast("long")


def source_targets(
    sizes: dict[str | None, int],
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MAX_REPEATS,
) -> dict[str | None, float]:
    """Tokens for each source: ``share`` of all sizes by weight, at most ``most`` times a
    source's size; what is cut off goes to the others by weight until none is above.

    Weights repeat over the sources in code point order, null last.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest = share * sum(sizes.values())
    open_sources, target = list(order), dict.fromkeys(order, 0.0)
    while open_sources:
        total = sum(weight[s] for s in open_sources)
        over = [s for s in open_sources if rest * weight[s] / total > most * sizes[s]]
        if not over:
            for s in open_sources:
                target[s] = rest * weight[s] / total
            break
        for s in over:
            target[s] = float(most * sizes[s])
            rest -= target[s]
        open_sources = [s for s in open_sources if s not in set(over)]
    return target


def route(
    patterns: dict[tuple, int], quotas: dict, max_repeats: int = MAX_REPEATS
) -> dict[tuple, dict]:
    """Tokens from each pattern to each of its sources, at the least total repetition cost.

    Nodes are the start, patterns, sources and the end. An arc from the start to a
    pattern stands for one pass: capacity its size, cost the number of earlier passes.
    """
    graph: dict = defaultdict(list)  # node -> arcs; arc: [to, capacity, cost, reverse arc]

    def arc(a, b, capacity: int, cost: int) -> list:
        there, back = [b, capacity, cost, None], [a, 0, -cost, None]
        there[3], back[3] = back, there
        graph[a].append(there)
        graph[b].append(back)
        return there

    carried = {}
    for p, size in patterns.items():
        for again in range(max_repeats):
            arc("start", ("p", p), size, again)
        for s in p:
            carried[p, s] = arc(("p", p), ("s", s), max_repeats * size, 0)
    for s, quota in quotas.items():
        arc(("s", s), "end", quota, 0)
    potential: dict = defaultdict(int)
    while True:
        best, via = {"start": 0}, {}
        heap, done, tick = [(0, 0, "start")], set(), 1
        while heap:
            d, _, a = heapq.heappop(heap)
            if a in done:
                continue
            done.add(a)
            for e in graph[a]:
                if e[1] > 0 and e[0] not in done:
                    nd = d + e[2] + potential[a] - potential[e[0]]
                    if nd < best.get(e[0], 1 << 60):
                        best[e[0]], via[e[0]] = nd, e
                        heapq.heappush(heap, (nd, tick, e[0]))
                        tick += 1
        if "end" not in best:
            break
        for a, d in best.items():
            potential[a] += d
        path, a = [], "end"
        while a != "start":
            path.append(via[a])
            a = via[a][3][0]
        push = min(e[1] for e in path)
        for e in path:
            e[1] -= push
            e[3][1] += push
    flow: dict = defaultdict(dict)
    for (p, s), e in carried.items():
        flow[p][s] = e[3][1]
    return flow


def _order_key(seed: str) -> Column:
    by_text = F.concat(F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), by_text)))


def _place(key: Column, text_hash: Column) -> Column:
    """A row's place in the order; only rows with equal ids and texts share one."""
    return F.struct(
        key.alias("_key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("id"),
        text_hash.alias("text"),
    )


def last_taken(docs: DataFrame, quota: DataFrame) -> DataFrame:
    """``quota`` with ``_passes`` and ``_last``, where the additional pass ends.

    ``docs (doc_id, _key, _text, _pattern, _size)``; ``quota (_pattern, _quota, _all)`` has one row per
    pattern: the tokens it gives and those it has.
    """
    keyed = docs.withColumn("_digits", F.substring("_key", 1, DIGITS))
    quota = quota.withColumn(
        "_passes", F.when(F.col("_all") > 0, F.floor(F.col("_quota") / F.col("_all"))).otherwise(0)
    ).withColumn("_left", F.col("_quota") - F.col("_passes") * F.col("_all"))
    up_to = Window.partitionBy("_pattern").orderBy("_digits")
    # the digit group of each pattern in which its tokens run out
    edge = (
        keyed.groupBy("_pattern", "_digits")
        .agg(F.sum("_size").alias("_tokens"))
        .withColumn("_before", F.sum("_tokens").over(up_to) - F.col("_tokens"))
        .join(F.broadcast(quota.select("_pattern", "_left")), "_pattern")
        .where((F.col("_left") > F.col("_before")) & (F.col("_left") <= F.col("_before") + F.col("_tokens")))
        .select("_pattern", "_digits", (F.col("_left") - F.col("_before")).alias("_left"))
    )
    within = Window.partitionBy("_pattern").orderBy("_key", "doc_id", "_text", "_size")
    running = F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, 0))
    place = _place(F.col("_key"), F.col("_text"))
    first = F.struct(F.col("_digits").alias("_key"), F.lit(FIRST).alias("id"), F.lit(FIRST).alias("text"))
    ends = (
        keyed.join(F.broadcast(edge), ["_pattern", "_digits"])
        .withColumn("_nearer", 2 * running - F.col("_size") <= 2 * F.col("_left"))
        .groupBy("_pattern")
        .agg(
            F.max(F.when(F.col("_nearer"), place)).alias("_in"),
            F.first("_digits").alias("_digits"),
        )
        # even the first document of the group may be too much
        .select(
            "_pattern",
            F.coalesce("_in", first).alias("_last"),
        )
    )
    return quota.join(ends, "_pattern", "left")


def mix(
    docs: DataFrame,
    sources: str = "sources",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    max_repeats: int = MAX_REPEATS,
    seed: str = SEED,
) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``size`` and ``taken``, and the flow ``(pattern, source, tokens,
    source_size, target)``.

    ``sources`` is an array column; a source's size is that of its documents.
    """
    spark = docs.sparkSession
    docs = docs.drop("size", "taken", "_pattern", "_size").withColumns(
        {"_size": word_count(), "_pattern": F.array_sort(F.array_distinct(sources))}
    )
    text_hash = F.xxhash64("text")
    thin = settle(
        docs.select(
            "doc_id", _order_key(seed).alias("_key"), text_hash.alias("_text"), "_pattern", "_size"
        )
    )
    rows = (
        thin.groupBy("_pattern").agg(F.sum("_size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    )
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r[0] or ()): r[1] for r in rows}
    sizes: dict = defaultdict(int)
    for p, n in patterns.items():
        for s in p:
            sizes[s] += n
    targets = source_targets(dict(sizes), weights, share, max_repeats)
    flow = route(patterns, {s: round(t) for s, t in targets.items()}, max_repeats)
    quota = spark.createDataFrame(
        [(list(p), sum(flow[p].values()), n) for p, n in patterns.items()],
        "_pattern array<string>, _quota long, _all long",
    )
    routed = spark.createDataFrame(
        [
            (list(p), s, n, sizes[s], targets[s])
            for p in patterns
            for s, n in flow[p].items()
        ],
        "pattern array<string>, source string, tokens long, source_size long, target double",
    )
    # one row per pattern, of which there are MAX_PATTERNS at most
    ends = F.broadcast(settle(last_taken(thin, quota).select("_pattern", "_passes", "_last")))
    more = F.coalesce((_place(_order_key(seed), text_hash) <= F.col("_last")).cast("int"), F.lit(0))
    taken = docs.join(ends, "_pattern", "left").withColumn(
        "taken", (F.col("_size") * (F.coalesce("_passes", F.lit(0)) + more)).cast("long")
    )
    return taken.drop("_passes", "_last").withColumnRenamed("_size", "size"), routed


def mix_single(docs: DataFrame, **options) -> DataFrame:
    """``docs`` of one source each, with ``size``, ``source_size``, ``target``, ``taken``."""
    docs = docs.drop("source_size", "target", "_sources")
    taken, flow = mix(docs.withColumn("_sources", F.array("source")), "_sources", **options)
    per_source = flow.select(F.col("pattern").alias("_pattern"), "source_size", "target")
    return taken.join(F.broadcast(per_source), "_pattern", "left").drop("_pattern", "_sources")


def repeat_taken(docs: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it whole."""
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    return docs.withColumn(
        "_again", F.explode(F.array_repeat(F.lit(1), times))
    ).drop("_again")
