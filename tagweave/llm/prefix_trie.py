"""Prefix trie of conversations, built as a z-fast trie.

A conversation is the list of its turns; the node for a list of turns is known by a 128-bit
chained hash, so every conversation carries the hashes of all its prefixes and the turns'
sizes, never its texts. Only nodes that end a conversation or branch are built, each with the edge
that leads to it. A node is stored under its handle: the hash at the two-fattest depth (the number
divisible by the largest power of two) of its edge.

Conversations are inserted in batches. All that are pending look for their exit node by fat binary
search: of the depths still possible the two-fattest one is probed by a join with the handles, which
halves them, so the number of joins is that of the bits of the greatest length. Where the search
ends at a node that a conversation goes beyond, one join with the first hashes of edges finds the
edge. Edges are cut where conversations leave them, and of all that enter one new branch a
drawn one becomes its leaf; the others wait for the next batch, in which they start below. As a
drawn conversation leads into a large part of its branch, batches grow in number with the logarithm of the
conversations, not with depth.

What a node's subtree holds is summed by pointer jumping over the built nodes (a round doubles the
reach), and only then edges are expanded into all nodes. Identical conversations are one sequence with
a count. Lists of conversations that end at a node are sorted and joined into blocks by many
tasks; only the last hash over the blocks is one stream per node.

Turns are ordered by turn, null first, then by a digest. Null roles and texts are empty. Rows
without a conversation id belong to none and are left out. Repeated rows are turns of their own. An
empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.operators.lineage import discard, settle

GROUP, SHARED = 5, 9
ROOT = bytes(16)
BLOCK = 1 << 16  # bytes of joined ids
EMPTY = hashlib.sha256(b"").hexdigest()


def _turn_lists(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: digests and sizes of the turns, in order."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            digest.alias("digest"),
            F.octet_length(text).cast("long").alias("size"),
        ).alias("t"),
    )
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuild(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: each conversation begins like the first of its group."""
    own = _turn_lists(conversations)
    base = own.select(F.col("conv_id").alias("_base"), F.col("turns").alias("_first"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    start = F.slice("_first", F.lit(1), shared)
    rest = F.slice("turns", shared + 1, F.size("turns"))
    return own.join(base, F.col("conv_id") - F.col("conv_id") % GROUP == F.col("_base"), "left").select(
        "conv_id", F.when(F.col("_base").isNull(), rest).otherwise(F.concat(start, rest)).alias("turns")
    )


def prefix_hashes(lists: DataFrame) -> DataFrame:
    """``(conv_id, key, h, upto)``: hash of the whole list and of each prefix, and running sizes.

    ``upto`` begins with zero, so it has one entry more than ``h``.
    """
    names = ["conv_id", "key", "h", "upto"]
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]

    def chain(digests: list[bytes]) -> list[bytes]:
        out, last = [], ROOT
        for d in digests:
            last = hashlib.blake2b(last + d, digest_size=16).digest()
            out.append(last)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests, sizes = batch.columns
            h = [chain(x) for x in digests.to_pylist()]
            key = [x[-1] if x else ROOT for x in h]
            upto = [[0, *accumulate(x)] for x in sizes.to_pylist()]
            columns = (ids, pa.array(key, kinds[1]), pa.array(h, kinds[2]), pa.array(upto, kinds[3]))
            yield pa.RecordBatch.from_arrays(list(columns), names=names)

    return lists.select("conv_id", "turns.digest", "turns.size").mapInArrow(
        run, "conv_id long, key binary, h array<binary>, upto array<long>"
    )


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that is divisible by the largest power of two."""
    differ = F.length(F.bin(low.cast("long").bitwiseXOR(high.cast("long")))) - 1
    return high.bitwiseAND(F.call_function("shiftleft", F.lit(-1), differ))


def _at(array: str, depth: Column) -> Column:
    return F.get(F.col(array), depth - 1)


def _node(skip: Column, path: str, parent: Column, low: Column, high: Column) -> Column:
    """A built node: its edge is (low, high], its hashes and sizes are cut from behind ``skip``."""
    upto = F.slice("upto", skip + 1, high - low + 1)
    path = F.slice(path, skip + 1, high - low)
    return F.struct(
        F.element_at(path, -1).alias("ext"),
        high.alias("depth"),
        parent.alias("par"),
        low.alias("pdepth"),
        path.alias("path"),
        upto.alias("upto"),
        F.get(path, F.lit(0)).alias("first"),
        F.get(path, two_fattest(low, high) - low - 1).alias("handle"),
    )


NODE = (
    "ext binary, depth int, par binary, pdepth int, path array<binary>, upto array<long>, "
    "first binary, handle binary"
)


def locate(pending: DataFrame, nodes: DataFrame, bits: int) -> DataFrame:
    """``pending`` with the depth ``low`` at which each leaves the trie, and the edge it leaves.

    ``edge`` is the first hash of that edge, null where it leaves at a node.
    """
    length = F.size("h")
    handles = nodes.select("handle", F.col("ext").alias("_ext"), F.col("depth").alias("_depth"), F.col("first").alias("_first"))
    nothing = F.concat("key", F.lit(b"\0"))  # longer than any hash, and not one key for all
    q = pending.withColumns({"high": length, "edge": F.lit(None).cast("binary")})
    for _ in range(bits):
        active = F.col("edge").isNull() & (F.col("low") < F.col("high"))
        f = two_fattest(F.col("low"), F.col("high"))
        q = q.withColumns({"_on": active, "_f": F.when(active, f)})
        q = q.withColumn("_probe", F.when(F.col("_on"), _at("h", F.col("_f"))).otherwise(nothing))
        q = q.join(handles, F.col("_probe") == F.col("handle"), "left")
        found = F.col("handle").isNotNull()
        whole = found & F.coalesce((F.col("_depth") <= length) & (_at("h", F.col("_depth")) == F.col("_ext")), F.lit(False))
        q = q.withColumns({"_found": found, "_whole": whole}).select(
            "key", "h", "upto",
            F.when(F.col("_whole"), F.col("_depth")).otherwise(F.col("low")).alias("low"),
            F.when(F.col("_on") & ~F.col("_found"), F.col("_f") - 1).otherwise(F.col("high")).alias("high"),
            F.when(F.col("_found") & ~F.col("_whole"), F.col("_first")).otherwise(F.col("edge")).alias("edge"),
        )
    edges = nodes.select(F.col("first").alias("_first"), F.col("pdepth").alias("_pdepth"), "path")
    probe = F.coalesce("edge", _at("h", F.col("low") + 1), nothing)
    common = F.size(F.array_intersect("path", "h"))
    return q.withColumn("_probe", probe).join(edges, F.col("_probe") == F.col("_first"), "left").select(
        "key", "h", "upto",
        F.when(F.col("_first").isNull(), F.col("low")).otherwise(F.col("_pdepth") + common).alias("low"),
        F.col("_first").alias("edge"),
    )


def _cut(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes whose edges end where conversations leave them."""
    cuts = (
        found.where(F.col("edge").isNotNull())
        .groupBy(F.col("edge").alias("_edge"))
        .agg(F.sort_array(F.collect_set("low")).alias("_cuts"))  # at most the edge's length
    )
    inner = F.coalesce("_cuts", F.array().cast("array<int>"))
    ends = F.concat(inner, F.array("depth"))
    cut = nodes.join(cuts, F.col("first") == F.col("_edge"), "left").select(
        "*", F.posexplode(ends).alias("_i", "_high")
    ).withColumn("_low", F.when(F.col("_i") == 0, F.col("pdepth")).otherwise(F.get(inner, F.col("_i") - 1)))
    skip = F.col("_low") - F.col("pdepth")
    parent = F.when(F.col("_i") == 0, F.col("par")).otherwise(F.get("path", skip - 1))
    return cut.select(
        _node(skip, "path", parent, F.col("_low"), F.col("_high")).alias("n")
    ).select("n.*")


def _leaves(found: DataFrame) -> DataFrame:
    """One drawn conversation for each new branch."""
    drawn = (
        found.where(F.col("low") < F.size("h"))
        .groupBy(_at("h", F.col("low") + 1).alias("_branch"))
        .agg(F.min_by(F.struct("h", "upto", "low"), F.struct(F.xxhash64("key"), "key")).alias("w"))
        .select("w.*")
    )
    parent = F.when(F.col("low") == 0, F.lit(ROOT)).otherwise(_at("h", F.col("low")))
    return drawn.select(_node(F.col("low"), "h", parent, F.col("low"), F.size("h")).alias("n")).select("n.*")


def build(sequences: DataFrame) -> DataFrame:
    """The built nodes (``NODE``) of distinct sequences ``(key, h, upto)``, without the root."""
    spark = sequences.sparkSession
    nodes = spark.createDataFrame([], NODE)
    bits = (sequences.agg(F.max(F.size("h"))).first()[0] or 0).bit_length()
    pending = sequences.where(F.size("h") > 0).select("key", "h", "upto", F.lit(0).alias("low"))
    old: list[DataFrame] = []
    while True:
        found = settle(locate(pending, nodes, bits))
        new = settle(_cut(nodes, found).unionByName(_leaves(found)))
        below = found.where(F.col("low") < F.size("h"))
        left = below.agg(
            F.count("*").alias("rows"), F.count_distinct(_at("h", F.col("low") + 1)).alias("branches")
        ).first()
        discard(*old)
        nodes, old = new, [found, new]
        if left.rows == left.branches:
            discard(found)
            return nodes
        pending = below.join(nodes.select("ext"), F.col("key") == F.col("ext"), "left_anti").drop("edge")


def over_subtrees(nodes: DataFrame, sums: list[str], least: list[str]) -> DataFrame:
    """``(ext, par, …)`` with the columns summed, or the least taken, over each subtree.

    After a round a node holds what lies less than twice as far below it as before.
    """
    up = F.when(F.col("par") != F.lit(ROOT), F.col("par"))
    now = settle(nodes.select("ext", "par", up.alias("jump"), *sums, *least))
    while not now.where(F.col("jump").isNotNull()).isEmpty():
        below = (
            now.where(F.col("jump").isNotNull())
            .groupBy(F.col("jump").alias("_to"))
            .agg(*(F.sum(c).alias(f"_{c}") for c in sums), *(F.min(c).alias(f"_{c}") for c in least))
        )
        further = now.select(F.col("ext").alias("_over"), F.col("jump").alias("_jump"))
        probe = F.coalesce("jump", F.concat("ext", F.lit(b"\0")))
        raised = (
            now.join(below, F.col("ext") == F.col("_to"), "left")
            .join(further, probe == F.col("_over"), "left")
            .select(
                "ext",
                "par",
                F.col("_jump").alias("jump"),
                *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums),
                *(F.least(c, f"_{c}").alias(c) for c in least),
            )
        )
        before, now = now, settle(raised)
        discard(before)
    return now.drop("jump")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of one key, joined by commas into blocks."""
    key, first, ids, size = None, None, [], 0
    for batch in batches:
        out = []
        for k, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key is not None and (k != key or size > BLOCK):
                out.append((key, first, ",".join(ids).encode()))
                key, ids, size = None, [], 0
            if key is None:
                key, first = k, conv
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        yield _record(out, ["key", "first", "ids"], [pa.binary(), pa.int64(), pa.binary()])
    if key is not None:
        yield _record([(key, first, ",".join(ids).encode())], ["key", "first", "ids"], [pa.binary(), pa.int64(), pa.binary()])


def _hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["key", "ends_sha256"], [pa.binary(), pa.string()]
    key, state = None, None
    for batch in batches:
        out = []
        for k, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids)
            else:
                state.update(b",")
                state.update(ids)
        yield _record(out, names, kinds)
    if key is not None:
        yield _record([(key, state.hexdigest())], names, kinds)


def _record(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def end_hashes(convs: DataFrame) -> DataFrame:
    """``(key, ends_sha256)`` over the ids of the conversations with each key, in order."""
    return (
        convs.select("key", "conv_id")
        .repartitionByRange("key", "conv_id")
        .sortWithinPartitions("key", "conv_id")
        .mapInArrow(_blocks, "key binary, first long, ids binary")
        .repartition("key")
        .sortWithinPartitions("key", "first")
        .mapInArrow(_hash_blocks, "key binary, ends_sha256 string")
    )


SCHEMA = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)


def trie_nodes(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (``SCHEMA``)."""
    return expand(settle(prefix_hashes(rebuild(conversations))))


def expand(convs: DataFrame) -> DataFrame:
    """One row per node, from ``prefix_hashes``."""
    spark = convs.sparkSession
    sequences = settle(
        convs.groupBy("key").agg(
            F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.first("h").alias("h"), F.first("upto").alias("upto")
        )
    )
    total = sequences.agg(F.sum("n").alias("n"), F.min("conv").alias("conv")).first()
    if total.n is None:
        return spark.createDataFrame([], SCHEMA)
    nodes = build(sequences.select("key", "h", "upto"))
    children = nodes.groupBy(F.col("par").alias("_par")).agg(F.count("*").alias("children"))
    ends = sequences.select(F.col("key").alias("_key"), "n", "conv")
    seeds = (
        nodes.join(children, F.col("ext") == F.col("_par"), "left")
        .join(ends, F.col("ext") == F.col("_key"), "left")
        .select(
            "ext",
            "par",
            F.coalesce("children", F.lit(0)).alias("children"),
            F.coalesce("n", F.lit(0)).alias("n"),
            "conv",
            F.col("children").isNull().cast("long").alias("leaves"),
            (F.element_at("upto", -1) - F.get("upto", F.lit(0))).alias("size"),
        )
    )
    held = over_subtrees(seeds, ["n", "leaves"], ["conv"])
    own = seeds.select("ext", "size", "children")
    weighted = settle(held.join(own, "ext").withColumn("saved", (F.col("n") - 1) * F.col("size")))
    saved = over_subtrees(weighted, ["saved"], []).select("ext", "saved")
    sums = settle(weighted.drop("saved", "size").join(saved, "ext"))
    top = (
        sums.where(F.col("par") == F.lit(ROOT))
        .agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        .first()
    )
    hashes = settle(end_hashes(convs))
    above = sums.select(F.col("ext").alias("_ext"), F.col("conv").alias("_conv"))
    edges = nodes.select("ext", "pdepth", "depth", "upto").join(sums, "ext")
    edges = edges.join(above, F.col("par") == F.col("_ext"), "left").join(
        hashes.withColumnRenamed("key", "_key"), F.col("ext") == F.col("_key"), "left"
    )
    at = F.col("pdepth") + 1 + F.col("_i")
    bottom = at == F.col("depth")
    places = F.posexplode(F.slice("upto", F.lit(1), F.size("upto") - 1)).alias("_i", "_upto")
    before = F.col("_upto") - F.get("upto", F.lit(0))
    rows = edges.select("*", places).select(
        F.col("conv").alias("conv_id"),
        at.cast("long").alias("depth"),
        F.when(F.col("_i") > 0, F.col("conv")).otherwise(F.coalesce("_conv", F.lit(total.conv))).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(bottom, F.col("children")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * before).alias("saved_tokens"),
        F.when(bottom, F.coalesce("ends_sha256", F.lit(EMPTY))).otherwise(EMPTY).alias("ends_sha256"),
    )
    root_ends = hashes.where(F.col("key") == F.lit(ROOT)).select("ends_sha256").first()
    root = (
        total.conv, 0, None, total.n, top.children, top.leaves or 1, top.saved or 0,
        root_ends.ends_sha256 if root_ends else EMPTY,
    )
    return rows.unionByName(spark.createDataFrame([root], SCHEMA))
