"""Best-fit packing by a grouping genetic algorithm on islands.

A document is its ids and one end id (0). Only documents longer than ``size`` are
cut: into full pieces, of which the first takes what is left over. Full pieces are
sequences of their own; what remains, one piece per document at most, is packed.

Pieces are dealt evenly into shards of about ``SHARD`` by their place in the input, so a
group of copies does not matter. For each shard ``islands`` populations evolve. Pieces of one
length are interchangeable, so a solution is a list of bins of lengths. Crossover takes
well-filled bins of one parent whole, then the bins of the other whose pieces are still there
(those that would use a piece twice fall away) and best-fits the displaced pieces. After an
epoch the best of each island also joins the next island. A shard that has reached
the bound ceil(sum / size) rests. The best solution of a shard is given real pieces.

Null texts are empty and consist of the end id; a special token in a text has its own id. Repeated rows are packed one by one. Null
ids pass through. Empty tables give empty results; other columns do not matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import short_batches, task_number
from tagweave.llm.encoding import Encoder, default_path
from tagweave.operators.lineage import discard, settle

SIZE = 2048
SHARD = 16_384
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 4
POPULATION = 4
WELL_FILLED = 0.995

Bins = list[tuple[int, ...]]


def cut_pieces(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """``(doc_id, row, piece, start, length, ids_crc32)``; ``row`` numbers documents.

    ``row`` depends on how the input is split: settle the result before using it twice.
    """
    path = path or default_path()
    short_batches(docs.sparkSession)
    names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        encoder = Encoder.of(path)
        row = task_number() << 33
        for batch in batches:
            out = [[] for _ in names]
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.append(encoder.encode(text), np.uint32(0)).astype("<u4")
                first = (len(ids) - 1) % size + 1
                edges = [0, *range(first, len(ids) + 1, size)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    crc = zlib.crc32(ids[a:b].tobytes())
                    for column, v in zip(out, (doc, row, k, a, b - a, crc), strict=True):
                        column.append(v)
                row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """``lengths`` put one by one into the fullest bin that has room, or a new one."""
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r is set if some bin has room r
    for i, b in enumerate(bins):
        r = size - sum(b)
        by_room[r].append(i)
        rooms |= 1 << r
    for x in lengths:
        fits = rooms >> x
        if fits:
            r = x + (fits & -fits).bit_length() - 1
            i = by_room[r].pop()
            if not by_room[r]:
                rooms ^= 1 << r
        else:
            r, i = size, len(bins)
            bins.append([])
        bins[i].append(x)
        by_room[r - x].append(i)
        rooms |= 1 << (r - x)
    return bins


def crossover(one: Bins, other: Bins, supply: np.ndarray, size: int, rng) -> Bins:
    """A child of two solutions of the same pieces."""
    left = supply.tolist()
    good = [b for b in other if sum(b) >= WELL_FILLED * size]
    child = [b for b, take in zip(good, rng.random(len(good)) < 0.5, strict=True) if take]
    for b in child:
        for x in b:
            left[x] -= 1
    kept = []
    for k in rng.permutation(len(one)).tolist():
        b = one[k]
        for x in b:
            left[x] -= 1
        if min(left[x] for x in b) >= 0:
            kept.append(b)
        else:
            for x in b:
                left[x] += 1
    full = [b for b in kept if sum(b) == size]
    rest = [list(b) for b in kept if sum(b) < size]
    displaced = np.repeat(np.arange(size, -1, -1), np.array(left)[::-1]).tolist()
    return child + full + [tuple(b) for b in best_fit(rest, displaced, size)]


def fitness(bins: Bins, size: int) -> tuple[int, float]:
    """Smaller is better: bins, then how unevenly they are filled."""
    fill = np.array([sum(b) for b in bins], float) / size
    return len(bins), -float((fill**2).sum())


def pack_bytes(bins: Bins) -> bytes:
    sizes = np.array([len(b) for b in bins], "<u2").tobytes()
    flat = np.array([x for b in bins for x in b], "<u2").tobytes()
    return zlib.compress(len(bins).to_bytes(4, "little") + sizes + flat, 1)


def unpack_bytes(blob: bytes) -> Bins:
    raw = zlib.decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    sizes = np.frombuffer(raw, "<u2", n, 4)
    flat = np.frombuffer(raw, "<u2", -1, 4 + 2 * n).tolist()
    ends = np.cumsum(sizes).tolist()
    return [tuple(flat[e - s : e]) for e, s in zip(ends, sizes.tolist(), strict=True)]


def _found(shard: int, first_island: int, solutions: list[Bins], size: int) -> pd.DataFrame:
    scores = [fitness(s, size) for s in solutions]
    return pd.DataFrame(
        {
            "shard": shard,
            "island": first_island,
            "bins": [s[0] for s in scores],
            "evenness": [s[1] for s in scores],
            "bound": [-(-sum(map(sum, s)) // size) for s in solutions],
            "solution": [pack_bytes(s) for s in solutions],
        }
    )


STATE = "shard int, island int, bins int, evenness double, bound int, solution binary"


def _first_population(size: int):
    """Best fit of the lengths in falling order, and in orders that noise disturbs."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard, island = map(int, key)
        lengths = np.repeat(pdf["length"].to_numpy(), pdf["n"].to_numpy())
        rng = np.random.default_rng([shard, island])
        solutions = []
        for k in range(POPULATION):
            noise = rng.normal(0, 0.02 * size * (k + island), len(lengths))
            order = np.argsort(-(lengths + noise), kind="stable")
            solutions.append([tuple(b) for b in best_fit([], lengths[order].tolist(), size)])
            bins = len(solutions[-1])
            if bins == -(-int(lengths.sum()) // size):
                break
        return _found(shard, island, solutions, size)

    return run


def _evolve(size: int, epoch: int, islands: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard, island = map(int, key)
        pdf = pdf.sort_values(["bins", "evenness", "solution"]).drop_duplicates("solution")
        if pdf["bins"].iloc[0] > pdf["bound"].iloc[0] and len(pdf) > 1:
            population = [unpack_bytes(b) for b in pdf["solution"].iloc[:POPULATION]]
            flat = np.array([x for b in population[0] for x in b])
            supply = np.bincount(flat, minlength=size + 1)
            rng = np.random.default_rng([shard, island, epoch])
            for _ in range(GENERATIONS):
                a, b = rng.choice(len(population), 2, replace=False)
                population.append(crossover(population[a], population[b], supply, size, rng))
                population.sort(key=lambda s: fitness(s, size))
                del population[POPULATION:]
                if len(population[0]) == pdf["bound"].iloc[0]:
                    break
            pdf = _found(shard, island, population, size)
        elite = pdf.iloc[:1].assign(island=(island + 1) % islands)
        return pd.concat([pdf.iloc[:POPULATION], elite])[[c.split()[0] for c in STATE.split(", ")]]

    return run


def _give_pieces(size: int):
    """Real pieces for the lengths of a shard's best solution."""

    def run(key: tuple, pieces: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        pieces = pieces.sort_values(["length", "row", "piece"], ignore_index=True)
        bins = unpack_bytes(best["solution"].iloc[0])
        sizes = [len(b) for b in bins]
        flat = np.array([x for b in bins for x in b], np.int64)
        number = np.repeat(np.arange(len(bins)), sizes)
        ends = np.cumsum(flat)
        first = np.cumsum(sizes) - sizes
        offset = ends - flat - np.repeat((ends - flat)[first], sizes)
        # the k-th place of a length takes the k-th piece of that length
        places = np.argsort(flat, kind="stable")
        sequence = np.empty(len(flat), np.int64)
        at = np.empty(len(flat), np.int64)
        sequence[np.arange(len(flat))] = (shard << 32) + number[places]
        at[np.arange(len(flat))] = offset[places]
        return pieces.assign(sequence_id=sequence, offset=at)[OUT]

    return run


OUT = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def pack(pieces: DataFrame, size: int = SIZE, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """``pieces`` (settled) with ``sequence_id`` and ``offset``."""
    full = pieces.where(F.col("length") == size).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    loose = pieces.where(F.col("length") < size)
    n = loose.count()
    shards = max(1, -(-n // SHARD))
    dealt = loose.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    histogram = dealt.groupBy("shard", "length").agg(F.count("*").alias("n"))
    state = settle(
        histogram.withColumn("island", F.explode(F.array(*map(F.lit, range(islands)))))
        .groupBy("shard", "island")
        .applyInPandas(_first_population(size), STATE)
    )
    for epoch in range(epochs):
        open_shards = state.groupBy("shard").agg(
            F.min(F.col("bins") - F.col("bound")).alias("over")
        ).where(F.col("over") > 0)
        if open_shards.isEmpty():
            break
        before, state = state, settle(
            state.groupBy("shard", "island").applyInPandas(_evolve(size, epoch, islands), STATE)
        )
        discard(before)
    best = state.groupBy("shard").agg(
        F.min_by("solution", F.struct("bins", "evenness", "solution")).alias("solution")
    )
    packed = (
        dealt.groupBy("shard")
        .cogroup(best.groupBy("shard"))
        .applyInPandas(
            _give_pieces(size),
            "doc_id long, piece int, start long, length long, ids_crc32 long, "
            "sequence_id long, offset long",
        )
    )
    return full.unionByName(packed)


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    return pack(settle(cut_pieces(docs, path, size)), size)
