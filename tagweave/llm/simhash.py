"""SimHash near-dedup with pivot distance tables.

A fingerprint has bit b set if more than half of a text's shingle hashes have it. Equal
fingerprints become one node, with its smallest doc_id. Two nodes link at
``max_bits`` (m) or fewer differing bits.

The pivot table holds every node's Hamming distances to ``N_PIVOTS`` fixed reference
fingerprints. If two nodes are within m bits, no coordinate differs by more than
m (triangle inequality), so pairs with a larger difference are discarded and survivors are
verified by the bits themselves. Coordinates of random fingerprints lie close together, so
a table alone would still be compared with itself; the nodes are therefore dealt out
by band keys: the 64 bits are cut into m + e bands, of which any m changed bits leave
e untouched, so linked nodes meet under at least one choice of e bands.

Buckets of equal keys reach a task sorted, and all buckets of a block of rows are searched at
once: every round takes one node of each bucket, compares it with the bucket's nodes not reached yet
(coordinates first, then bits) and queues those that link with it. What a node reaches
is not compared again, and only the links that join something are returned. The first key length
follows from the number of nodes; nodes of buckets of more than ``max_bucket`` are dealt
out again with longer keys. Buckets of the longest are searched at any size; for 4 bits these
have 40 fixed bits and more, so no bucket can hold over 2 ** 24 fingerprints.

Rows without doc_id get a fingerprint, link with nothing and have a null component.
Texts that are null or without words have fingerprint 0, linked like any other. Repeated
ids are one document: its component is the smallest of those its texts belong to through
the equal id. An empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import by_rows, short_batches, words_of
from tagweave.operators.components import connected_components
from tagweave.operators.lineage import settle

SHINGLE = 4
MAX_BITS = 4
N_PIVOTS = 24
MAX_BUCKET = 4096
MOST_KEYS = 1000
BLOCK = 1 << 16
CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint, unsigned."""
    words = words_of(text)
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(shingle, len(words))
    begin, end = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for i in range(0, len(begin), CHUNK):
        part = b"".join(
            [digest(line[a:b], 42) for a, b in zip(begin[i : i + CHUNK], end[i : i + CHUNK], strict=True)]
        )
        bits = np.unpackbits(np.frombuffer(part, np.uint8)).reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(begin)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` per row, ``fp`` as a signed long of the same bits."""
    short_batches(docs.sparkSession)

    def rows(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
        return {"doc_id": batch.column(0), "fp": fps.view(np.int64)}

    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        by_rows(rows, schema), "doc_id long, fp long"
    )


def pivots(n: int = N_PIVOTS) -> list[int]:
    """Reference fingerprints: digests of the numbers from 0, as signed longs."""
    return np.array([xxhash.xxh64_intdigest(str(i)) for i in range(n)], np.uint64).view(np.int64).tolist()


def pivot_table(fp: np.ndarray, n: int = N_PIVOTS) -> np.ndarray:
    """Distances of unsigned fingerprints to each reference fingerprint, a row per reference."""
    references = np.array(pivots(n), np.int64).view(np.uint64)
    return np.bitwise_count(fp ^ references[:, None]).astype(np.int8)


def band_masks(max_bits: int, extra: int = 2) -> list[int]:
    """Bit masks of every choice of ``extra`` of max_bits + extra bands, signed."""
    edges = np.linspace(0, 64, max_bits + extra + 1).astype(int)
    bands = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edges, edges[1:], strict=False)]
    whole = np.array([sum(x) for x in combinations(bands, extra)], np.uint64)
    return whole.view(np.int64).tolist()


def key_lengths(max_bits: int) -> list[int]:
    """How many bands make a key, from short to long keys."""
    return [2] + [e for e in (4, 6, 8) if comb(max_bits + e, e) <= MOST_KEYS]


def bucket_links(fp: np.ndarray, bucket: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that join the nodes of each bucket into its components.

    ``bucket`` numbers the buckets from 0 in rising order. Nodes not reached yet
    are searched from each reached node once.
    """
    dist = pivot_table(fp)
    taken = np.flatnonzero(np.diff(bucket, prepend=-1))
    waiting = np.flatnonzero(np.diff(bucket, prepend=-1) == 0)
    queue = np.array([], np.int64)
    at = np.zeros(bucket[-1] + 1 if len(bucket) else 0, np.int64)
    left, right = [queue], [queue]
    while len(waiting):
        at[bucket[taken]] = taken
        near = np.arange(len(waiting))
        for d in dist:
            w = waiting[near]
            near = near[np.abs(d[w] - d[at[bucket[w]]]) <= max_bits]
            if not len(near):
                break
        w = waiting[near]
        near = near[np.bitwise_count(fp[w] ^ fp[at[bucket[w]]]) <= max_bits]
        reached = waiting[near]
        left.append(at[bucket[reached]])
        right.append(reached)
        waiting = np.delete(waiting, near)
        # the next of each bucket that still waits: a reached node, else a new start
        own = bucket[waiting]
        open_ = np.zeros(len(at), bool)
        open_[own] = True
        queue = np.concatenate([queue, reached])
        queue = queue[open_[bucket[queue]]]
        start = np.flatnonzero(np.diff(own, prepend=-1))
        at[own[start]] = waiting[start]
        at[bucket[queue]] = queue
        taken = at[own[start]]
        queue = queue[at[bucket[queue]] != queue]
        waiting = waiting[at[own] != waiting]
    return np.concatenate(left), np.concatenate(right)


def _search_sorted(max_bits: int, block: int = BLOCK):
    """Links of rows ``(band, key, fp, rep)`` sorted by band and key, whole buckets at a time."""

    def found(columns: list[np.ndarray]) -> pa.RecordBatch:
        band, key, fp, rep = columns
        change = (np.diff(band) != 0) | (np.diff(key) != 0)
        a, b = bucket_links(fp.view(np.uint64), np.cumsum(np.append(False, change)), max_bits)
        return pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, wanted = [], 0, block
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy() for c in batch.columns])
            n += batch.num_rows
            if n < wanted:
                continue
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            # the last bucket may go on in the next batch
            same = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
            end = n - int(same.sum())
            if end:
                yield found([c[:end] for c in columns])
            held, n = [[c[end:] for c in columns]], n - end
            wanted = max(block, 2 * n)
        if held:
            yield found([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def links(nodes: DataFrame, max_bits: int = MAX_BITS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """``(src, dst)`` of ``rep``: enough links to join every component of ``nodes (fp, rep)``."""
    total = nodes.count()
    lengths = key_lengths(max_bits)
    # keys long enough for some tens of evenly spread nodes a bucket
    while len(lengths) > 1 and total >> (64 * lengths[0] // (max_bits + lengths[0])) > 64:
        lengths.pop(0)
    found = []
    for extra in lengths:
        masks = band_masks(max_bits, extra)
        keys = [
            F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
            for i, m in enumerate(masks)
        ]
        keyed = nodes.select("fp", "rep", F.explode(F.array(*keys)).alias("k")).select(
            "k.band", "k.key", "fp", "rep"
        )
        crowded = None
        if extra != lengths[-1] and total > max_bucket:
            sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("n"))
            hot = settle(sizes.where(F.col("n") > max_bucket).select("band", "key"))
            if not hot.isEmpty():
                crowded = settle(keyed.join(hot, ["band", "key"], "left_semi").select("fp", "rep").distinct())
                keyed = keyed.join(hot, ["band", "key"], "left_anti")
        found.append(
            keyed.repartition("band", "key")
            .sortWithinPartitions("band", "key")
            .select("band", "key", "fp", "rep")
            .mapInArrow(_search_sorted(max_bits), "src long, dst long")
        )
        if crowded is None:
            break
        nodes = crowded
    return reduce(DataFrame.unionByName, found)


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    max_bucket: int = MAX_BUCKET,
) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row of ``docs``."""
    prints = settle(fingerprints(docs, shingle))
    nodes = settle(
        prints.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("rep"))
    )
    edges = links(nodes, max_bits, max_bucket)
    # a repeated id ties its fingerprints together
    several = prints.where(F.col("doc_id").isNotNull()).select("doc_id", "fp").distinct()
    several = several.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    tied = (
        prints.join(several, "doc_id", "left_semi")
        .join(nodes, "fp")
        .select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
        .where(F.col("src") != F.col("dst"))
        .distinct()
    )
    parts = connected_components(edges.unionByName(tied))
    named = nodes.join(parts, F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    joined = prints.join(named, "fp", "left")
    return joined.select(
        "doc_id",
        "fp",
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def hex_fingerprint(fp: str | Column = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without all but the smallest document of each component.

    A repeated id keeps one row, the first by all its columns. Rows without id stay.
    """
    names = docs.columns
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    stay = docs.join(gone, "doc_id", "left_anti").select(names)
    copies = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1")
    if copies.isEmpty():
        return stay
    once = (
        stay.join(copies.select("doc_id"), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.min(F.struct(*[n for n in names if n != "doc_id"])).alias("_row"))
        .select("doc_id", "_row.*")
        .select(names)
    )
    return stay.join(copies.select("doc_id"), "doc_id", "left_anti").select(names).unionByName(once)
