"""Communities by flow: the two-level map equation (Rosvall & Bergstrom 2008).

A random walk on an undirected graph visits nodes in proportion to their degree.
A partition is good if it shortens the description of the walk, which it does as long
as the walk seldom leaves a community.

With whole counts the code per step, times the summed degree ``2 m``, is
``f(Q) - 2 sum f(cut) - sum f(d) + sum f(cut + a)`` for ``f(x) = x log2 x``: ``cut`` counts
the edges that leave a community, ``a`` is its summed degree, ``Q`` sums all cuts and
``d`` are the nodes' degrees. ``f`` is taken in fixed point, so all sums are sums of whole
numbers and no decision depends on partitioning or on the order of rows. Every step taken
lowers this whole number, so the search ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.operators.communities import (
    SHARES,
    community_graph,
    connected_parts,
    contract,
    independent_moves,
    mix,
    mutual_pairs,
    resolve_merges,
)
from tagweave.operators.lineage import discard, settle

# units of a bit; holds up to some 10**12 edges in 64 bits
UNITS = 1 << 16
_EXACT = "decimal(38,0)"
# a turn of moves that saves less (bits per step) is the last one of its level
LEAST_BITS = 1e-4
# followers per paired community from which on all of them follow at once
PATIENCE = 16
# the exit rates at which a round's merges are priced: this many halvings of the way
PRICES = 8


def _f(x: Column) -> Column:
    """``x log2 x`` of a count, in whole units."""
    return F.when(x > 1, F.rint(x * F.log2(x) * UNITS).cast("long")).otherwise(0)


def walk_codes(links: DataFrame, masses: DataFrame, trials: DataFrame) -> DataFrame:
    """The code of several assignments at once: ``(trial, two_m, code)``, a row for each.

    ``links`` and ``masses`` are those of single nodes, ``trials`` is ``(node, choices)`` with
    a community per assignment. The nodes' own term is left out; no assignment changes it.
    """
    lo, hi = trials.toDF("lo", "_lo"), trials.toDF("hi", "_hi")
    nothing = F.lit(0).cast("long")
    leaving = (
        links.join(lo, "lo")
        .join(hi, "hi")
        .select("e", F.posexplode(F.arrays_zip("_lo", "_hi")).alias("trial", "ends"))
        .where(F.col("ends._lo") != F.col("ends._hi"))
        .select(
            "trial",
            F.explode(F.array("ends._lo", "ends._hi")).alias("community"),
            nothing.alias("a"),
            F.col("e").alias("cut"),
        )
    )
    members = masses.join(trials, F.col("c") == F.col("node")).select(
        F.posexplode("choices").alias("trial", "community"), "a", nothing.alias("cut")
    )
    groups = (
        members.unionByName(leaving)
        .groupBy("trial", "community")
        .agg(F.sum("a").alias("a"), F.sum("cut").alias("cut"))
    )
    return (
        groups.groupBy("trial")
        .agg(
            F.sum("a").alias("two_m"),
            F.sum("cut").alias("q"),
            F.sum((_f(F.col("cut") + F.col("a")) - 2 * _f(F.col("cut"))).cast(_EXACT)).alias("s"),
        )
        .select("trial", "two_m", (_f(F.col("q")) + F.col("s")).cast(_EXACT).alias("code"))
    )


def code_length(edges: DataFrame, assign: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Bits per step of the walk under an assignment ``(node, community)``, as one row ``bits``.

    A graph without edges has no walk; its bits are null.
    """
    links, masses = community_graph(edges, src, dst)
    trials = assign.select("node", F.array("community").alias("choices"))
    visits = masses.select(F.lit(None).cast("long").alias("two_m"), (-_f(F.col("a"))).cast(_EXACT).alias("code"))
    both = walk_codes(links, masses, trials).drop("trial").unionByName(visits)
    bits = F.sum("code").cast("double") / UNITS / F.max("two_m")
    return both.agg(bits.alias("bits"))


def _with_exits(links: DataFrame, masses: DataFrame) -> DataFrame:
    """Communities ``(c, a, cut)``; ``cut`` counts the edges that leave."""
    leaving = links.select(F.explode(F.array("lo", "hi")).alias("c"), "e")
    cuts = leaving.groupBy("c").agg(F.sum("e").alias("cut"))
    return masses.join(cuts, "c", "left").select(
        "c", "a", F.coalesce("cut", F.lit(0).cast("long")).alias("cut")
    )


def _shortening_pairs(links: DataFrame, groups: DataFrame, q: int) -> DataFrame:
    """Linked pairs whose merge alone shortens the code, with the change."""
    lo = groups.toDF("lo", "a_lo", "cut_lo")
    hi = groups.toDF("hi", "a_hi", "cut_hi")
    joined = F.col("cut_lo") + F.col("cut_hi") - 2 * F.col("e")
    total = F.lit(q).cast("long")
    delta = (
        _f(total - 2 * F.col("e"))
        - _f(total)
        - 2 * (_f(joined) - _f(F.col("cut_lo")) - _f(F.col("cut_hi")))
        + _f(joined + F.col("a_lo") + F.col("a_hi"))
        - _f(F.col("cut_lo") + F.col("a_lo"))
        - _f(F.col("cut_hi") + F.col("a_hi"))
    )
    return (
        links.join(lo, "lo")
        .join(hi, "hi")
        .withColumn("delta", delta)
        .where(F.col("delta") < 0)
        .withColumn("tie", mix(F.col("lo"), F.col("hi")))
        .withColumn("lo_only", F.col("cut_lo") == F.col("e"))
        .withColumn("hi_only", F.col("cut_hi") == F.col("e"))
        .select("lo", "hi", "delta", "tie", "lo_only", "hi_only")
    )


def _first_choices(pairs: DataFrame) -> DataFrame:
    """Each community's best pair; ``only``: all its edges out lead to the other one."""
    choice = F.struct("delta", "tie", "lo", "hi")
    ends = [F.struct(F.col(end).alias("c"), F.col(f"{end}_only").alias("only")) for end in ("lo", "hi")]
    return (
        pairs.select(F.explode(F.array(*ends)).alias("end"), choice.alias("choice"))
        .groupBy("end.c", "end.only")
        .agg(F.min("choice").alias("choice"))
        .select("c", "only", "choice.lo", "choice.hi")
    )


def _proposals(choices: DataFrame) -> DataFrame:
    """``(c, target, follows, waits)``: mutual pairs and their followers.

    Followers with edges to others too could wait for a better choice.
    """
    pairs = mutual_pairs(choices)
    members = pairs.select(
        F.explode(F.array("lo", "hi")).alias("c"), F.col("lo").alias("target")
    )
    followers = (
        choices.join(members, "c", "left_anti")
        .withColumn(
            "member", F.when(F.col("lo") == F.col("c"), F.col("hi")).otherwise(F.col("lo"))
        )
        .join(members.withColumnRenamed("c", "member"), "member")
        .select("c", "target", F.lit(True).alias("follows"), (~F.col("only")).alias("waits"))
    )
    stays = F.lit(False)
    return members.select("c", "target", stays.alias("follows"), stays.alias("waits")).unionByName(followers)


def _star_changes(proposals: DataFrame, links: DataFrame, groups: DataFrame) -> DataFrame:
    """Per target: inner edges and change of code, for the pair and for all.

    The change leaves out the term of the summed cuts, which all merges of a round share.
    """
    sums = proposals.join(groups, "c").groupBy("target").agg(
        *[
            F.sum(F.when(in_star, value).otherwise(0)).alias(f"{name}_{star}")
            for star, in_star in (("pair", ~F.col("follows")), ("all", F.lit(True)))
            for name, value in (
                ("cut", F.col("cut")),
                ("a", F.col("a")),
                ("exits", _f(F.col("cut"))),
                ("stays", _f(F.col("cut") + F.col("a"))),
            )
        ]
    )
    ends = proposals.withColumnsRenamed({"c": "lo", "target": "t_lo", "follows": "f_lo"})
    inner = (
        links.join(ends, "lo")
        .join(ends.toDF("hi", "t_hi", "f_hi"), "hi")
        .where(F.col("t_lo") == F.col("t_hi"))
        .groupBy(F.col("t_lo").alias("target"))
        .agg(
            F.sum("e").alias("inner_all"),
            F.sum(F.when(~F.col("f_lo") & ~F.col("f_hi"), F.col("e"))).alias("inner_pair"),
        )
    )
    table = sums.join(inner, "target")
    for star in ("pair", "all"):
        joined = F.col(f"cut_{star}") - 2 * F.col(f"inner_{star}")
        change = (
            -2 * (_f(joined) - F.col(f"exits_{star}"))
            + _f(joined + F.col(f"a_{star}"))
            - F.col(f"stays_{star}")
        )
        table = table.withColumn(f"change_{star}", change)
    return table.select("target", "inner_pair", "inner_all", "change_pair", "change_all")


def _better_form(rate: int) -> Column:
    """The better form of a star if cuts are priced by the slope of ``f`` at ``rate``."""
    slope = 2 * UNITS * (math.log2(rate) + 1 / math.log(2))
    return F.least(
        *(
            F.struct(
                (F.col(f"change_{star}") - F.col(f"inner_{star}") * slope).alias("bound"),
                F.lit(star == "all").alias("everyone"),
                F.col(f"inner_{star}").alias("inner"),
                F.col(f"change_{star}").alias("change"),
            )
            for star in ("pair", "all")
        )
    )


def _merges(links: DataFrame, groups: DataFrame, q: int, pairs: DataFrame) -> DataFrame:
    """The merges of one round; together they shorten the code.

    The term of the summed cuts is convex. Pricing it by its slope at the present sum is
    optimistic, at the lowest sum it is safe. Some sums in between, closer and closer to the
    present one, are tried along with both in one pass, and the choice with the shortest exact
    code wins. Failing all, the best pair merges.
    """
    found = settle(_proposals(_first_choices(pairs)))
    row = found.agg(F.count_if("waits").alias("waiting"), F.count_if(~F.col("follows")).alias("members")).first()
    # early followers cost quality, so they wait unless they would wait for many rounds
    proposals = found if row["waiting"] > PATIENCE * row["members"] else found.where(~F.col("waits"))
    stars = settle(_star_changes(proposals.drop("waits"), links, groups))
    rates = sorted({max(q - (q >> j), 1) for j in range(PRICES)} | {q})
    total = F.lit(q).cast("long")
    sums = []
    for i, rate in enumerate(rates):
        best = _better_form(rate)
        taken = best["bound"] < 0
        inner = F.coalesce(F.sum(F.when(taken, best["inner"])), F.lit(0))
        change = F.sum(F.when(taken, best["change"]))
        sums.append((_f(total - 2 * inner) - _f(total) + change).alias(f"r{i}"))
    row = stars.agg(*sums).first()
    change, rate = min(((row[i], rate) for i, rate in enumerate(rates) if row[i] is not None), default=(0, q))
    if change >= 0:
        one = pairs.agg(F.min(F.struct("delta", "tie", "lo", "hi")).alias("p"))
        merges = settle(one.select(F.col("p.hi").alias("c"), F.col("p.lo").alias("target")))
    else:
        best = stars.select("target", _better_form(rate).alias("b")).where(F.col("b.bound") < 0)
        merges = settle(
            proposals.join(best, "target")
            .where(~F.col("follows") | F.col("b.everyone"))
            .where(F.col("c") != F.col("target"))
            .select("c", "target")
        )
    discard(found, stars)
    return merges


def merge_up(links: DataFrame, masses: DataFrame) -> DataFrame | None:
    """``(node, community)`` of the groups of a community graph once no merge helps; None if none did."""
    nodes = masses.select(F.col("c").alias("node"))
    groups = settle(_with_exits(links, masses))
    rounds, old = [], [groups]
    while True:
        q = groups.agg(F.sum("cut")).first()[0]
        if not q:
            break
        pairs = settle(_shortening_pairs(links, groups, q))
        if pairs.isEmpty():
            discard(pairs)
            break
        merges = _merges(links, groups, q, pairs)
        rounds.append(merges)
        links, masses = contract(links, groups.select("c", "a"), merges)
        links = settle(links)
        groups = settle(_with_exits(links, masses))
        discard(pairs, *old)
        old = [links, groups]
    found = settle(resolve_merges(nodes, rounds)) if rounds else None
    discard(*rounds, *old)
    return found


def wanted_moves(
    around: DataFrame, nodes: DataFrame, groups: DataFrame, assign: DataFrame, q: int
) -> DataFrame:
    """Nodes whose move to a neighbour's community alone shortens the code: ``(node, target, gain)``.

    ``around`` has the edge counts ``(node, neighbour, ways)``, ``nodes`` degrees and edges to
    others ``(node, d, w)``, ``groups`` the communities ``(c, a, cut)``.
    """
    no_ways = F.lit(0).cast("long").alias("k")
    ties = (
        around.join(assign.toDF("neighbour", "community"), "neighbour")
        .select("node", "community", F.col("ways").alias("k"))
        # a node without edges into its own community still compares with it
        .unionByName(assign.select("node", "community", no_ways))
        .groupBy("node", "community")
        .agg(F.sum("k").alias("k"))
    )
    home = (
        ties.withColumnRenamed("k", "k_own")
        .join(assign, ["node", "community"])
        .join(nodes, "node")
        .join(groups.toDF("community", "a_own", "cut_own"), "community")
        .withColumnRenamed("community", "own")
    )
    d, w, k, k_own = (F.col(c) for c in ("d", "w", "k", "k_own"))
    a_own, cut_own, a_to, cut_to = (F.col(c) for c in ("a_own", "cut_own", "a_to", "cut_to"))
    left = cut_own - w + 2 * k_own
    joined = cut_to + w - 2 * k
    total = F.lit(q).cast("long")
    delta = (
        _f(total + 2 * (k_own - k))
        - _f(total)
        - 2 * (_f(left) + _f(joined) - _f(cut_own) - _f(cut_to))
        + _f(left + a_own - d)
        + _f(joined + a_to + d)
        - _f(cut_own + a_own)
        - _f(cut_to + a_to)
    )
    choice = F.struct("delta", mix(F.col("community"), F.col("node")).alias("tie"), "community")
    return (
        ties.join(home, "node")
        .where(F.col("community") != F.col("own"))
        .join(groups.toDF("community", "a_to", "cut_to"), "community")
        .withColumn("delta", delta)
        .where(F.col("delta") < 0)
        .groupBy("node")
        .agg(F.min(choice).alias("best"))
        .select("node", F.col("best.community").alias("target"), (-F.col("best.delta")).alias("gain"))
    )


def _codes(links: DataFrame, masses: DataFrame, trials: DataFrame) -> list[int]:
    return [int(r["code"]) for r in sorted(walk_codes(links, masses, trials).collect())]


def refine(links: DataFrame, masses: DataFrame, assign: DataFrame, least_bits: float = LEAST_BITS) -> DataFrame:
    """Move single nodes as long as a turn saves ``least_bits`` per step.

    Moves of one turn can spoil each other, so the codes after all of them, half, a quarter and an
    eighth are measured in one pass and the best is taken. Where none helps, moves that share no
    community are tried, and the best single move, which always helps.
    """
    ways = [links.toDF("node", "neighbour", "ways"), links.toDF("neighbour", "node", "ways")]
    around = settle(ways[0].unionByName(ways[1]))
    to_others = around.groupBy("node").agg(F.sum("ways").alias("w"))
    nodes = settle(masses.toDF("node", "d").join(to_others, "node"))
    two_m = masses.agg(F.sum("a")).first()[0] or 0
    turn = 0
    while True:
        renamed = assign.where(F.col("node") != F.col("community")).toDF("c", "target")
        between, merged = contract(links, masses, renamed)
        groups = settle(_with_exits(between, merged))
        q = groups.agg(F.sum("cut")).first()[0] or 0
        moves = settle(wanted_moves(around, nodes, groups, assign, q))
        if moves.isEmpty():
            discard(moves, groups, around, nodes)
            return assign
        turn += 1
        draw = mix(F.col("node"), F.lit(turn))
        choices = [F.when(draw % share == 0, F.col("target")) for share in SHARES]
        trials = settle(_trials(assign, moves.select("node", "target"), choices))
        now, *codes = _codes(links, masses, trials)
        if min(codes) >= now:
            discard(trials)
            best = moves.agg(F.min(F.struct((-F.col("gain")).alias("loss"), "node", "target")).alias("m"))
            alone = best.select("m.node", "m.target", F.lit(True).alias("alone"))
            apart = independent_moves(moves, assign).withColumn("alone", F.lit(False))
            either = alone.unionByName(apart).groupBy("node").agg(
                F.min("target").alias("target"),
                F.max("alone").alias("alone"),
                F.min("alone").alias("only_alone"),
            )
            choices = [F.when(~F.col("only_alone"), F.col("target")), F.when(F.col("alone"), F.col("target"))]
            trials = settle(_trials(assign, either, choices))
            now, *codes = _codes(links, masses, trials)
        gain = now - min(codes)
        place = 1 + codes.index(min(codes))
        following = settle(trials.select("node", F.get("choices", F.lit(place)).alias("community")))
        discard(moves, groups, trials, assign)
        assign = following
        if gain < least_bits * two_m * UNITS:
            discard(around, nodes)
            return assign


def _trials(assign: DataFrame, moves: DataFrame, choices: list[Column]) -> DataFrame:
    return assign.join(moves, "node", "left").select(
        "node", F.array("community", *(F.coalesce(c, "community") for c in choices)).alias("choices")
    )


def flow_communities(
    edges: DataFrame, src: str = "src", dst: str = "dst"
) -> DataFrame:
    """``(node, community)`` by the two-level map equation; integer ids.

    A level merges communities until none would shorten the code, moves single nodes, and cuts
    communities into connected pieces if that does not lengthen the code; the next level starts from
    those as its nodes. Results do not depend on partitioning. A round's tables are deleted
    once the next is written.
    """
    edges = settle(edges.select(src, dst))
    links, masses = (settle(t) for t in community_graph(edges, src, dst))
    assign = settle(masses.select(F.col("c").alias("node"), F.col("c").alias("community")))
    level_links, level_masses = links, masses
    while True:
        merged = merge_up(level_links, level_masses)
        if merged is None:
            return assign
        placed = assign.join(merged.toDF("community", "_to"), "community").select(
            "node", F.col("_to").alias("community")
        )
        moved = refine(links, masses, settle(placed))
        pieces = connected_parts(edges, moved, src, dst).withColumnRenamed("community", "_piece")
        trials = settle(
            moved.join(pieces, "node").select("node", F.array("community", "_piece").alias("choices"))
        )
        whole, cut = _codes(links, masses, trials)
        before, assign = assign, settle(
            trials.select("node", F.get("choices", F.lit(int(cut <= whole))).alias("community"))
        )
        discard(before, merged, moved, trials)
        # a community is named by a member, which a move may have taken away
        named = assign.groupBy("community").agg(F.min("node").alias("_name"))
        before, assign = assign, settle(assign.join(named, "community").select("node", F.col("_name").alias("community")))
        discard(before)
        renamed = assign.where(F.col("node") != F.col("community")).toDF("c", "target")
        level_links, level_masses = (settle(t) for t in contract(links, masses, renamed))
