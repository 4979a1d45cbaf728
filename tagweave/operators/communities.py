"""Modularity, and communities that raise it (after Clauset, Newman & Moore 2004).

The sequential algorithm merges one pair at a time. Here every round merges many
pairs at once, chosen so that their gains add up, so that modularity rises in
each round. Merging in parallel settles some nodes too early; a few rounds of
single-node moves at the end make up for that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.operators.components import connected_components
from tagweave.operators.lineage import discard, settle
from tagweave.operators.ranking import dense_id

SLICES = 16
_EXACT = "decimal(38,0)"


def mix(lo: Column, hi: Column) -> Column:
    """A fixed scramble of two ids. Ties broken by id alone would line up along
    chains of equal gain and merge one link per round."""
    p = F.lit(2147483647).cast("long")
    lo, hi = F.pmod(lo.cast("long"), p), F.pmod(hi.cast("long"), p)
    return (lo * 715827883 + hi * 433494437) % p


def community_graph(
    edges: DataFrame, src: str = "src", dst: str = "dst"
) -> tuple[DataFrame, DataFrame]:
    """Every node alone: links ``(lo, hi, e)`` and masses ``(c, a)``.

    ``e`` counts edges between two communities, ``a`` is the summed degree. A
    loop adds two to its node's degree and links nothing.
    """
    ends = edges.select(F.explode(F.array(src, dst)).alias("c"))
    masses = ends.groupBy("c").agg(F.count("*").alias("a"))
    links = (
        edges.select(F.least(src, dst).alias("lo"), F.greatest(src, dst).alias("hi"))
        .where(F.col("lo") != F.col("hi"))
        .groupBy("lo", "hi")
        .agg(F.count("*").alias("e"))
    )
    return links, masses


def gains(links: DataFrame, masses: DataFrame, m: int) -> DataFrame:
    """Linked pairs that would gain: ``g = 2 m e - a_lo a_hi > 0``, an integer."""
    g = F.lit(2 * m).cast("decimal(19,0)") * F.col("e").cast("decimal(19,0)") - F.col(
        "a_lo"
    ).cast("decimal(19,0)") * F.col("a_hi").cast("decimal(19,0)")
    return (
        links.join(masses.toDF("lo", "a_lo"), "lo")
        .join(masses.toDF("hi", "a_hi"), "hi")
        .withColumn("g", g.cast(_EXACT))
        .where(F.col("g") > 0)
        .withColumn("tie", mix(F.col("lo"), F.col("hi")))
    )


def preferences(gaining: DataFrame) -> DataFrame:
    """Each community's best pair: highest gain, then the tie value, then ids."""
    ends = gaining.select(
        F.explode(F.array("lo", "hi")).alias("c"), "g", "tie", "lo", "hi", "e"
    )
    best = F.min_by(
        F.struct("g", "lo", "hi", "e"), F.struct((-F.col("g")).alias("loss"), "tie", "lo", "hi")
    )
    return ends.groupBy("c").agg(best.alias("best")).select("c", "best.*")


def mutual_pairs(prefs: DataFrame) -> DataFrame:
    """Pairs that are the first choice of both ends, as ``(lo, hi)``."""
    return (
        prefs.groupBy("lo", "hi").agg(F.count("*").alias("n")).where(F.col("n") == 2)
    ).select("lo", "hi")


def merge_round(prefs: DataFrame, masses: DataFrame, m: int) -> DataFrame:
    """Merges of one round, as ``(c, target)``; ``target`` keeps its name.

    Pairs that choose each other merge. A community whose first choice is a
    member of such a pair may follow it in the same round, if a bound on its
    gain *after* the others' arrival is still positive. The bound ignores links
    among the followers, so modularity cannot fall. Followers are taken by
    rising mass per link, in classes (powers of two, each in some slices) rather
    than one by one: the running mass ahead of a class needs a window over few
    rows per pair, however many followers there are.
    """
    pairs = mutual_pairs(prefs)
    members = pairs.select(
        F.explode(F.array("lo", "hi")).alias("member"), F.col("lo").alias("target")
    )
    follower = (
        prefs.join(
            members.select(F.col("member").alias("c")), "c", "left_anti"
        )
        .withColumn(
            "member", F.when(F.col("lo") == F.col("c"), F.col("hi")).otherwise(F.col("lo"))
        )
        .join(members, "member")
        .join(masses, "c")
        .withColumn("sparsity", F.length(F.bin(F.expr("a div e"))))
        .withColumn("slice", mix(F.col("c"), F.lit(0)) % SLICES)
    )
    pair_mass = (
        members.join(masses, F.col("member") == F.col("c"))
        .groupBy("target")
        .agg(F.sum("a").alias("a_pair"))
    )
    classes = follower.groupBy("target", "sparsity", "slice").agg(
        F.sum("a").alias("a_class")
    )
    so_far = (
        Window.partitionBy("target")
        .orderBy(F.asc("sparsity"), F.desc("slice"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ahead = (
        classes.withColumn("a_ahead", F.sum("a_class").over(so_far))
        .join(pair_mass, "target")
        .drop("a_class")
    )
    bound = F.lit(2 * m).cast("decimal(19,0)") * F.col("e").cast("decimal(19,0)") - F.col(
        "a"
    ).cast("decimal(19,0)") * (F.col("a_pair") + F.col("a_ahead") - F.col("a")).cast(
        "decimal(19,0)"
    )
    accepted = (
        follower.join(ahead, ["target", "sparsity", "slice"])
        .withColumn("bound", bound.cast(_EXACT))
        .where(F.col("bound") > 0)
        .select("c", "target")
    )
    return pairs.select(F.col("hi").alias("c"), F.col("lo").alias("target")).unionByName(
        accepted
    )


def contract(
    links: DataFrame, masses: DataFrame, merges: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The community graph after the merges; links inside a community vanish."""
    for end in ("lo", "hi"):
        links = links.join(merges.toDF(end, f"_{end}"), end, "left").withColumn(
            end, F.coalesce(f"_{end}", end)
        )
    links = (
        links.where(F.col("lo") != F.col("hi"))
        .groupBy(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"))
        .agg(F.sum("e").alias("e"))
    )
    masses = (
        masses.join(merges, "c", "left")
        .groupBy(F.coalesce("target", "c").alias("c"))
        .agg(F.sum("a").alias("a"))
    )
    return links, masses


def resolve_merges(nodes: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """``(node, community)`` from the merges of all rounds.

    A community merges away at most once, so all merges together are a table of
    pointers. Each pass doubles the distance they span; no path is longer than
    the number of rounds.
    """
    if not rounds:
        return nodes.select("node", F.col("node").alias("community"))
    pointers = settle(reduce(DataFrame.unionByName, rounds))
    span = 1
    while span < len(rounds):
        onward = pointers.toDF("_c", "_next")
        pointers = settle(
            pointers.join(onward, F.col("target") == F.col("_c"), "left").select(
                "c", F.coalesce("_next", "target").alias("target")
            )
        )
        span *= 2
    return nodes.join(pointers, F.col("node") == F.col("c"), "left").select(
        "node", F.coalesce("target", "node").alias("community")
    )


def connected_parts(
    edges: DataFrame, assign: DataFrame, src: str = "src", dst: str = "dst"
) -> DataFrame:
    """Communities cut into their connected pieces, each named by its smallest node.

    Pieces without an edge between them are better apart, so this never lowers modularity.
    """
    inside = (
        edges.join(assign.toDF(src, "_cs"), src)
        .join(assign.toDF(dst, "_cd"), dst)
        .where((F.col("_cs") == F.col("_cd")) & (F.col(src) != F.col(dst)))
    )
    pieces = connected_components(inside.select(src, dst), src, dst).toDF("_node", "_piece")
    return assign.join(pieces, F.col("node") == F.col("_node"), "left").select(
        "node", F.coalesce("_piece", "node").alias("community")
    )


def merge_up(links: DataFrame, masses: DataFrame, m: int) -> DataFrame | None:
    """``(node, community)`` of the groups of a community graph once no merge gains; None if none did."""
    groups = masses.select(F.col("c").alias("node"))
    rounds, old = [], []
    while True:
        prefs = settle(preferences(gains(links, masses, m)))
        if prefs.isEmpty():
            discard(prefs)
            break
        merges = settle(merge_round(prefs, masses, m))
        rounds.append(merges)
        # pairs that gain nothing now never will, but their edges still count
        # towards later pairs, so all links are carried on
        links, masses = (settle(t) for t in contract(links, masses, merges))
        discard(prefs, *old)
        old = [links, masses]
    if not rounds:
        return None
    found = settle(resolve_merges(groups, rounds))
    discard(*rounds, *old)
    return found


def greedy_communities(
    edges: DataFrame, src: str = "src", dst: str = "dst"
) -> DataFrame:
    """``(node, community)``, the community being its smallest member.

    Ids must be integers. A level merges communities until none would raise modularity, moves
    single nodes, and cuts what the moves took apart into connected pieces; the next level starts
    from those as its nodes. Modularity rises with each level; the last one finds nothing to
    merge. Every community is connected. A round's tables are deleted once the next is written.
    """
    edges = settle(edges.select(src, dst))
    m = edges.count()
    links, masses = (settle(t) for t in community_graph(edges, src, dst))
    assign = settle(masses.select(F.col("c").alias("node"), F.col("c").alias("community")))
    level_links, level_masses = links, masses
    while True:
        merged = merge_up(level_links, level_masses, m)
        if merged is None:
            return assign
        placed = assign.join(merged.toDF("community", "_to"), "community").select(
            "node", F.col("_to").alias("community")
        )
        moved = refine(edges, settle(placed), m, src, dst)
        before, assign = assign, settle(connected_parts(edges, moved, src, dst))
        discard(before, merged, moved)
        renamed = assign.where(F.col("node") != F.col("community")).toDF("c", "target")
        level_links, level_masses = (settle(t) for t in contract(links, masses, renamed))


def wanted_moves(
    around: DataFrame, degrees: DataFrame, assign: DataFrame, m: int
) -> DataFrame:
    """Nodes that would gain by joining a neighbour's community: ``(node, target)``.

    ``around`` has the edge counts ``(node, neighbour, ways)``. A node's value
    in a community is ``2 m k - d D`` for its ``k`` edges into it and the
    degree ``D`` of the other members.
    """
    exact = "decimal(19,0)"
    totals = (
        degrees.join(assign, "node").groupBy("community").agg(F.sum("d").alias("total"))
    )
    home = degrees.join(assign.withColumnRenamed("community", "own"), "node")
    ties = (
        around.join(assign.toDF("neighbour", "community"), "neighbour")
        .groupBy("node", "community")
        .agg(F.sum("ways").alias("k"))
        # a node without edges into its own community still compares with it
        .unionByName(
            assign.select("node", "community", F.lit(0).cast("long").alias("k"))
        )
        .groupBy("node", "community")
        .agg(F.sum("k").alias("k"))
    )
    is_own = F.col("community") == F.col("own")
    others = F.col("total") - F.when(is_own, F.col("d")).otherwise(0)
    value = (
        F.lit(2 * m).cast(exact) * F.col("k").cast(exact)
        - F.col("d").cast(exact) * others.cast(exact)
    ).cast(_EXACT)
    choice = F.struct(
        (-F.col("value")).alias("loss"),
        mix(F.col("community"), F.col("node")).alias("tie"),
        F.col("community").alias("target"),
    )
    return (
        ties.join(home, "node")
        .join(totals, "community")
        .withColumn("value", value)
        .groupBy("node")
        .agg(
            F.max(F.when(is_own, F.col("value"))).alias("own_value"),
            F.min(F.when(~is_own, choice)).alias("best"),
        )
        .withColumn("gain", -F.col("best.loss") - F.col("own_value"))
        .where(F.col("gain") > 0)
        .select("node", F.col("best.target").alias("target"), "gain")
    )


def independent_moves(moves: DataFrame, assign: DataFrame) -> DataFrame:
    """Moves that are the best of both the community they leave and the one they join.

    No community takes part in two of them, so their gains add up exactly; the best
    move of all is always among them.
    """
    moves = settle(moves.join(assign, "node").withColumnRenamed("community", "own"))
    rank = F.struct((-F.col("gain")).alias("loss"), "node")
    sides = moves.select(F.explode(F.array("own", "target")).alias("c"), "node", rank.alias("r"))
    best = sides.groupBy("c").agg(F.min("r").alias("r")).select("r.node")
    both = best.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") == 2)
    return moves.join(both.select("node"), "node", "left_semi").select("node", "target")


SHARES = (1, 2, 4, 8)
# a turn that raises modularity by less is the last one
LEAST_GAIN = 1e-4


def trial_scores(
    edges: DataFrame, degrees: DataFrame, trials: DataFrame, m: int, src: str = "src", dst: str = "dst"
) -> list[int]:
    """Modularity of several assignments at once, times ``4 m ** 2``: whole numbers, exact.

    ``trials`` is ``(node, choices)``, with a community per assignment.
    """
    n = trials.select(F.size("choices").alias("n")).first()["n"]
    one, other = (trials.toDF(end, f"_{end}") for end in (src, dst))
    same = [F.sum((F.get(f"_{src}", F.lit(i)) == F.get(f"_{dst}", F.lit(i))).cast("long")) for i in range(n)]
    inside = edges.join(one, src).join(other, dst).agg(*(F.coalesce(c, F.lit(0)).alias(f"s{i}") for i, c in enumerate(same)))
    mass = F.col("a").cast("decimal(19,0)")
    squares = (
        degrees.join(trials, "node")
        .select(F.posexplode("choices").alias("trial", "community"), "d")
        .groupBy("trial", "community")
        .agg(F.sum("d").alias("a"))
        .groupBy("trial")
        .agg(F.sum((mass * mass).cast(_EXACT)).alias("squares"))
        .collect()
    )
    inside = inside.first()
    return [4 * m * inside[r["trial"]] - int(r["squares"]) for r in sorted(squares)]


def refine(
    edges: DataFrame,
    assign: DataFrame,
    m: int,
    src: str = "src",
    dst: str = "dst",
    least_gain: float = LEAST_GAIN,
) -> DataFrame:
    """Move single nodes as long as a turn raises modularity by ``least_gain``.

    Moves of one round can spoil each other. So the outcomes of all of them, half, a quarter and an
    eighth are measured in one pass, and the best is taken. Where none of these helps, moves whose
    gains add up are made.
    """
    one_way = edges.select(F.col(src).alias("node"), F.col(dst).alias("neighbour"))
    around = settle(
        one_way.unionByName(
            one_way.select(
                F.col("neighbour").alias("node"), F.col("node").alias("neighbour")
            )
        )
        .where(F.col("node") != F.col("neighbour"))
        .groupBy("node", "neighbour")
        .agg(F.count("*").alias("ways"))
    )
    ends = edges.select(F.explode(F.array(src, dst)).alias("node"))
    degrees = settle(ends.groupBy("node").agg(F.count("*").alias("d")))
    turn = 0
    while True:
        moves = settle(wanted_moves(around, degrees, assign, m))
        if moves.isEmpty():
            discard(moves, around, degrees)
            return assign
        turn += 1
        draw = mix(F.col("node"), F.lit(turn))
        choices = [F.when(draw % share == 0, F.col("target")) for share in SHARES]
        trials = settle(
            assign.join(moves.select("node", "target"), "node", "left").select(
                "node",
                F.array("community", *(F.coalesce(c, "community") for c in choices)).alias("choices"),
            )
        )
        now, *scores = trial_scores(edges, degrees, trials, m, src, dst)
        gain = max(scores) - now
        if gain > 0:
            best = 1 + scores.index(max(scores))
            following = settle(trials.select("node", F.get("choices", F.lit(best)).alias("community")))
        else:
            apart = assign.join(independent_moves(moves, assign), "node", "left")
            following = settle(apart.select("node", F.coalesce("target", "community").alias("community")))
        discard(moves, trials, assign)
        assign = following
        if 0 < gain < least_gain * 4 * m * m:
            discard(around, degrees)
            return assign


def modularity(
    edges: DataFrame, assign: DataFrame, src: str = "src", dst: str = "dst"
) -> DataFrame:
    """Quality of an assignment ``(node, community)``, as one row ``modularity``."""
    inside = (
        edges.join(assign.toDF(src, "_cs"), src)
        .join(assign.toDF(dst, "_cd"), dst)
        .where(F.col("_cs") == F.col("_cd"))
        .groupBy(F.col("_cs").alias("community"))
        .agg(F.count("*").alias("inside"), F.lit(0).cast("long").alias("degree"))
    )
    ends = (
        edges.select(F.explode(F.array(src, dst)).alias("node"))
        .groupBy("node")
        .agg(F.count("*").alias("d"))
        .join(assign, "node")
        .groupBy("community")
        .agg(F.lit(0).cast("long").alias("inside"), F.sum("d").alias("degree"))
    )
    per_community = inside.unionByName(ends).groupBy("community").agg(
        F.sum("inside").alias("inside"), F.sum("degree").alias("degree")
    )
    # the degrees sum to twice the number of edges
    two_m = F.sum("degree")
    squares = F.sum(F.col("degree").cast("double") * F.col("degree"))
    return per_community.agg(
        (2 * F.sum("inside") / two_m - squares / (two_m.cast("double") * two_m)).alias(
            "modularity"
        )
    )


def number_communities(assign: DataFrame) -> DataFrame:
    """Communities as 1, 2, 3, … by falling size, then by smallest node."""
    groups = assign.groupBy("community").agg(
        F.count("*").alias("_size"), F.min("node").alias("_first")
    )
    numbered = dense_id(groups, [F.desc("_size"), F.asc("_first")], name="_number")
    return assign.join(numbered.select("community", "_number"), "community").select(
        "node", F.col("_number").alias("community")
    )
