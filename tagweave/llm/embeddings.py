"""Embedding near-dedup by an epsilon grid order join.

Vectors of one label link if their cosine is ``min_cos`` or more. As unit vectors they are then
within eps = sqrt(2 - 2 * min_cos) of each other, and so are their projections. Vectors are
projected on leading principal directions, the cell of each coordinate is floor(x / eps),
and vectors are sorted by label, then cells: the epsilon grid order. The sorted sequence
is cut into blocks of at most ``block`` vectors, blocks form groups, groups form intervals of the
sequence (one per partition). The join runs down that tree: pairs of intervals, then of groups, then
of blocks, and a pair goes on only if the boxes around its projections are within eps. Pairs of
blocks that remain are compared in double precision.

The directions come from the covariance of at most ``SAMPLE`` vectors (smallest hash); they
only decide how much is skipped, as boxes are exact for any directions. Equal vectors of a
label are one class: links are counted with class sizes, copies are not compared with each other.
A block pair returns a sum per class and links that join its components, not all pairs.

Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do
rows without label or id; vectors of different length are not compared. Each is its own component (null
without an id). Repeated ids count as separate vectors. Empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import short_batches, task_number
from tagweave.operators.components import connected_components
from tagweave.operators.lineage import discard, settle

MIN_COS = 0.93
DIRECTIONS = 8
SAMPLE = 10_000
BLOCK = 1024
GROUP = 16
SLACK = 1e-6  # covers rounding of projections


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(h1, h2, rep, n, label, dim, embedding)`` of distinct usable vectors, and
    ``(vec_id, h1, h2)`` of all rows, with null hashes where a row links with nothing."""
    usable = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    usable = F.coalesce(usable, F.lit(False))
    rows = vectors.select("vec_id", "label", "embedding").withColumns(
        {
            "h1": F.when(usable, F.xxhash64("label", "embedding")),
            "h2": F.when(usable, F.xxhash64(F.lit(1), "label", "embedding")),
        }
    )
    found = (
        rows.where(F.col("h1").isNotNull())
        .groupBy("h1", "h2")
        .agg(
            F.min("vec_id").alias("rep"),
            F.count("*").alias("n"),
            F.min("label").alias("label"),
            F.min("embedding").alias("embedding"),
        )
        .withColumn("dim", F.size("embedding"))
    )
    return found, rows.select("vec_id", "h1", "h2")


def _units(rows: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that squares stay finite."""
    x = rows.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def directions(found: DataFrame, n: int = DIRECTIONS, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Leading principal directions for each vector length in the sample."""
    rows = (
        found.select("dim", "embedding").orderBy(F.xxhash64("embedding")).limit(sample).toArrow()
    )
    out = {}
    dims = np.array(rows.column("dim"))
    for d in np.unique(dims):
        of_dim = rows.filter(pa.array(dims == d)).column("embedding").combine_chunks()
        x = _units(of_dim.flatten().to_numpy().reshape(-1, d))
        x = x - x.mean(0)
        _, axes = np.linalg.eigh(x.T @ x)
        out[int(d)] = np.ascontiguousarray(axes[:, ::-1][:, :n])
    return out


BLOCKS = (
    "label long, dim int, interval int, grp int, block long, lo array<double>, hi array<double>, "
    "reps binary, sizes binary, data binary"
)


def _project(axes: dict[int, np.ndarray], eps: float, k: int):
    """Adds coordinates and grid cells to each class."""

    def run(batches):
        for batch in batches:
            coordinates = []
            for d, v in zip(batch.column("dim").to_pylist(), batch.column("embedding"), strict=True):
                u = _units(v.values.to_numpy().reshape(1, -1))[0]
                a = axes.get(d)
                p = u[:k] if a is None else u @ a
                coordinates.append(np.pad(p, (0, k - len(p))))
            x = np.array(coordinates).reshape(-1, k)
            cells = np.floor(x / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label").cast(pa.int64()),
                    batch.column("dim"),
                    *(pa.array(cells[:, i]) for i in range(k)),
                    batch.column("rep"),
                    batch.column("n"),
                    batch.column("embedding").cast(pa.list_(pa.float64())),
                    pa.array(list(x), pa.list_(pa.float64())),
                ],
                names=["label", "dim", *(f"c{i}" for i in range(k)), "rep", "n", "embedding", "x"],
            )

    return run


def _cut_blocks(block: int):
    """Blocks of a sorted partition; a block has one label and one vector length."""

    def run(batches):
        task = task_number()
        count = 0
        open_key, rows = None, []

        def close():
            nonlocal count, rows
            x = np.array([r[4] for r in rows])
            out = [
                open_key[0],
                open_key[1],
                task,
                count // GROUP,
                (task << 32) + count,
                x.min(0).tolist(),
                x.max(0).tolist(),
                np.array([r[2] for r in rows], np.int64).tobytes(),
                np.array([r[3] for r in rows], np.int64).tobytes(),
                np.array([r[5] for r in rows], np.float64).tobytes(),
            ]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
            count, rows = count + 1, []
            names = [c.split()[0] for c in BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(out, kinds, strict=True)], names=names
            )

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("label", "dim", "rep", "n", "x", "embedding"))
            for r in zip(*columns, strict=True):
                if rows and (r[:2] != open_key or len(rows) == block):
                    yield close()
                open_key = r[:2]
                rows.append(r)
        if rows:
            yield close()

    return run


def _near(eps: float, k: int):
    """Condition: the boxes (alo, ahi) and (blo, bhi) are within eps."""
    gap = None
    for i in range(k):
        g = F.greatest(
            F.col("b_lo")[i] - F.col("a_hi")[i], F.col("a_lo")[i] - F.col("b_hi")[i], F.lit(0.0)
        )
        gap = g * g if gap is None else gap + g * g
    return gap <= eps * eps


def _boxes(blocks: DataFrame, by: list[str], k: int) -> DataFrame:
    lo = F.array(*(F.min(F.col("lo")[i]) for i in range(k)))
    hi = F.array(*(F.max(F.col("hi")[i]) for i in range(k)))
    return blocks.groupBy("label", "dim", *by).agg(lo.alias("lo"), hi.alias("hi"))


def _side(boxes: DataFrame, ids: list[str], side: str) -> DataFrame:
    return boxes.select(
        "label", "dim", *(F.col(c).alias(f"{side}_{c}") for c in [*ids, "lo", "hi"])
    )


def block_pairs(blocks: DataFrame, eps: float, k: int) -> DataFrame:
    """``(a_block, b_block)`` with a <= b whose boxes are within eps, found down the tree."""
    boxes = settle(blocks.select("label", "dim", "interval", "grp", "block", "lo", "hi"))
    key = ["label", "dim"]
    tops = _boxes(boxes, ["interval"], k)
    pairs = settle(
        _side(tops, ["interval"], "a")
        .join(_side(tops, ["interval"], "b"), key)
        .where((F.col("a_interval") <= F.col("b_interval")) & _near(eps, k))
        .select(*key, "a_interval", "b_interval")
    )
    level, ids = ["interval"], ["interval", "grp"]
    for deeper in (["interval", "grp"], ["interval", "grp", "block"]):
        ids = deeper
        below = _boxes(boxes, ids, k)
        last = ids[-1]
        ordered = (F.col("a_interval") < F.col("b_interval")) | (F.col(f"a_{last}") <= F.col(f"b_{last}"))
        if last == "block":
            ordered = F.col("a_block") <= F.col("b_block")
        pairs = settle(
            pairs.join(_side(below, ids, "a"), [*key, *(f"a_{c}" for c in level)])
            .join(_side(below, ids, "b"), [*key, *(f"b_{c}" for c in level)])
            .where(ordered & _near(eps, k))
            .select(*key, *(f"{s}_{c}" for s in "ab" for c in ids))
        )
        level = ids
    return pairs.select("a_block", "b_block")


def components_of(linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (row, column) that join what the matrix links; few, not all."""
    rows, columns = np.nonzero(linked)
    if same:
        keep = rows < columns
        rows, columns = rows[keep], columns[keep]
    n = linked.shape[0] + (0 if same else linked.shape[1])
    if len(rows) <= 2 * n:
        return rows, columns
    # a forest by union-find over the pairs
    parent = list(range(n))
    shift = 0 if same else linked.shape[0]
    chosen = []
    for e, (i, j) in enumerate(zip(rows.tolist(), (columns + shift).tolist(), strict=True)):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        while parent[j] != j:
            parent[j] = parent[parent[j]]
            j = parent[j]
        if i != j:
            parent[j] = i
            chosen.append(e)
            if len(chosen) == n - 1:
                break
    return rows[chosen], columns[chosen]


def exact_cos(a: np.ndarray, b: np.ndarray) -> float:
    dot = math.fsum((a * b).tolist())
    return dot / math.sqrt(math.fsum((a * a).tolist()) * math.fsum((b * b).tolist()))


FOUND = "src long, dst long, add long"


def _compare(min_cos: float):
    """Links of block pairs: rows (class, null, linked vectors) and (class, class, null)."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                reps = [np.frombuffer(r[f"{s}_reps"], np.int64) for s in "ab"]
                sizes = [np.frombuffer(r[f"{s}_sizes"], np.int64) for s in "ab"]
                raw = [np.frombuffer(r[f"{s}_data"]).reshape(len(p), -1) for s, p in zip("ab", reps, strict=True)]
                unit = [_units(x) for x in raw]
                same = r["a_block"] == r["b_block"]
                cos = unit[0] @ unit[1].T
                linked = cos >= min_cos
                # decisions within rounding are made with exact sums
                for i, j in zip(*np.nonzero(np.abs(cos - min_cos) < 1e-12), strict=True):
                    linked[i, j] = exact_cos(raw[0][i], raw[1][j]) >= min_cos
                if same:
                    np.fill_diagonal(linked, False)
                add = [linked @ sizes[1], sizes[0] @ linked]
                i, j = components_of(linked, same)
                src = [reps[0][i]]
                dst: list = [reps[1][j].tolist()]
                total: list = [[None] * len(i)]
                for s in range(1 if same else 2):
                    some = np.flatnonzero(add[s])
                    src.append(reps[s][some])
                    dst.append([None] * len(some))
                    total.append(add[s][some].tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(src), pa.int64()),
                        pa.array(sum(dst, []), pa.int64()),
                        pa.array(sum(total, []), pa.int64()),
                    ],
                    names=["src", "dst", "add"],
                )

    return run


def near_vectors(
    vectors: DataFrame,
    min_cos: float = MIN_COS,
    block: int = BLOCK,
    k: int = DIRECTIONS,
    sample: int = SAMPLE,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row."""
    short_batches(vectors.sparkSession)
    eps = math.sqrt(max(0.0, 2 - 2 * min_cos)) + SLACK
    found, rows = classes(vectors)
    # a class has a number of its own: one id may stand on rows of several classes
    found = settle(found.withColumn("cls", F.monotonically_increasing_id()))
    axes = directions(found, k, sample)
    order = ["label", "dim", *(f"c{i}" for i in range(k)), "rep"]
    cells = ", ".join(f"c{i} int" for i in range(k))
    placed = found.select("label", "dim", F.col("cls").alias("rep"), "n", "embedding").mapInArrow(
        _project(axes, eps, k),
        f"label long, dim int, {cells}, rep long, n long, embedding array<double>, x array<double>",
    )
    blocks = settle(
        settle(placed).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cut_blocks(block), BLOCKS)
    )
    pairs = block_pairs(blocks, eps, k)
    data = blocks.select("block", "reps", "sizes", "data")

    def side(s: str) -> DataFrame:
        return data.select(*(F.col(c).alias(f"{s}_{c}") for c in data.columns))

    # pairs of blocks are even work: dealt out one by one
    spread = pairs.repartition(F.col("a_block"), F.col("b_block"))
    compared = settle(
        spread.join(side("a"), "a_block")
        .join(side("b"), "b_block")
        .mapInArrow(_compare(min_cos), FOUND)
    )
    links = compared.where(F.col("dst").isNotNull()).select("src", "dst")
    counts = compared.where(F.col("dst").isNull()).groupBy("src").agg(F.sum("add").alias("linked"))
    parts = settle(connected_components(links))
    names = (
        parts.join(found.select("cls", "rep"), F.col("node") == F.col("cls"))
        .groupBy("component")
        .agg(F.min("rep").alias("name"))
    )
    per_class = (
        found.select("h1", "h2", "cls", "rep", "n")
        .join(parts.join(names, "component"), F.col("cls") == F.col("node"), "left")
        .join(counts, F.col("cls") == F.col("src"), "left")
        .select(
            "h1",
            "h2",
            (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
            F.coalesce("name", "rep").alias("component_id"),
        )
    )
    discard(placed)
    return rows.join(per_class, ["h1", "h2"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
