"""Line dedup by range-partitioned hashes.

Lines are what ``\\n`` splits; a null or empty text is one empty line. A line's key is
the line stripped of ASCII white space and with A-Z in lower case. Keys shorter than
``min_chars`` code points never count. Of a key in two or more documents all lines go,
except those in the smallest doc_id holding it.

Keys become 128-bit hashes. Rows (hash, document, place) are range-partitioned and
sorted by hash, then document, then place, so equal keys are one run, also where a run is
so long that it covers many partitions. Each partition streams its runs and marks rows
whose document is not the first of the run. Only a partition's first run may have begun
earlier; its rows wait for the first document of that hash, the least of what all partitions
tell of their own first and last runs, two rows each. The result is a compressed bitmap of kept lines per document, not text.

Rows with the same doc_id and text are one document and share a bitmap. Null ids count
as one document that comes after all others. An empty table gives an empty result.
Columns other than ``doc_id`` and ``text`` do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.common import LOWER, SPACES, by_rows, short_batches, task_number
from tagweave.operators.lineage import settle

MIN_CHARS = 10
LAST = np.iinfo(np.int64).max  # stands for a null id


def text_mark(text: str = "text") -> Column:
    """Tells apart rows with one doc_id and different texts."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _line_hashes(min_chars: int):
    schema = pa.schema(
        [("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("mark", pa.int64()), ("pos", pa.int32())]
    )
    strip = SPACES.encode()

    def rows(batch: pa.RecordBatch) -> dict:
        digests, docs, marks, places = [], [], [], []
        for doc, text, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            seen = len(places)
            for i, line in enumerate((text or "").encode("utf-8", "replace").split(b"\n")):
                key = line.strip(strip)
                if len(key) < min_chars or (
                    len(key) < 4 * min_chars and len(key.decode()) < min_chars
                ):
                    continue
                digests.append(xxhash.xxh3_128_digest(key.translate(LOWER)))
                places.append(i)
            docs += [LAST if doc is None else doc] * (len(places) - seen)
            marks += [mark] * (len(places) - seen)
        h = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
        return {"h1": h[:, 0], "h2": h[:, 1], "doc": docs, "mark": marks, "pos": places}

    return by_rows(rows, schema)


DROPPED, WAITING, EDGE = 0, 1, 2


def _mark_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows: dropped ones, those of the first run, and how the first and last run began."""
    task = task_number()
    run = None  # (h1, h2, first document)
    in_first = True
    names = ["h1", "h2", "doc", "mark", "pos", "role", "task"]

    def out(h1, h2, doc, mark, pos, role) -> pa.RecordBatch:
        n = len(h1)
        return pa.RecordBatch.from_arrays(
            [
                *(pa.array(x, pa.int64()) for x in (h1, h2, doc, mark)),
                pa.array(pos, pa.int32()),
                pa.array(np.full(n, role, np.int32)),
                pa.array(np.full(n, task, np.int32)),
            ],
            names=names,
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, mark, pos = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if run is None:
            yield out(h1[:1], h2[:1], doc[:1], [0], [0], EDGE)
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if run is not None and (h1[0], h2[0]) == run[:2]:
            new[0] = False
        starts = np.flatnonzero(new)
        number = np.cumsum(new)
        firsts = np.concatenate(([LAST if run is None else run[2]], doc[starts]))
        first = firsts[number]
        if in_first:
            # the first run of the partition ends where a second begins
            seconds = starts[1:] if run is None else starts
            end = int(seconds[0]) if len(seconds) else len(h1)
            in_first = not len(seconds)
        else:
            end = 0
        gone = np.flatnonzero(doc != first)
        gone = gone[gone >= end]
        yield out(*(x[:end] for x in (h1, h2, doc, mark, pos)), WAITING)
        yield out(*(x[gone] for x in (h1, h2, doc, mark, pos)), DROPPED)
        run = (h1[-1], h2[-1], first[-1])
    if run is not None:
        yield out([run[0]], [run[1]], [run[2]], [0], [0], EDGE)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc, mark, pos)`` of every line that goes."""
    short_batches(docs.sparkSession)
    schema = "h1 long, h2 long, doc long, mark long, pos int"
    lines = settle(
        docs.select(F.col("doc_id").cast("long"), "text", text_mark()).mapInArrow(
            _line_hashes(min_chars), schema
        )
    )
    keys = ["h1", "h2", "doc", "pos", "mark"]
    marked = settle(
        lines.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(_mark_repeats, f"{schema}, role int, task int")
    )
    # two rows per partition at most
    begun = (
        marked.where(F.col("role") == EDGE)
        .groupBy("h1", "h2")
        .agg(F.min("doc").alias("first"))
    )
    waiting = (
        marked.where(F.col("role") == WAITING)
        .join(F.broadcast(begun), ["h1", "h2"])
        .where(F.col("doc") != F.col("first"))
    )
    cols = ["doc", "mark", "pos"]
    return marked.where(F.col("role") == DROPPED).select(cols).unionByName(waiting.select(cols))


@F.pandas_udf(T.BinaryType())
def _pack(n_lines: pd.Series, gone: pd.Series) -> pd.Series:
    """zlib-compressed bits, one per line, 1 where the line stays."""

    def one(n: int, places: np.ndarray | None) -> bytes | None:
        if places is None:
            return None
        bits = np.ones(-(-n // 8) * 8, np.uint8)  # spare bits keep, too
        bits[np.asarray(places, np.int64)] = 0
        return zlib.compress(np.packbits(bits).tobytes(), 1)

    return pd.Series([one(n, g) for n, g in zip(n_lines, gone, strict=True)], dtype=object)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc, mark, n_dropped, keep)`` of documents that lose lines.

    ``doc`` is the doc_id (a null one as the largest long), ``mark`` is ``text_mark``.
    Documents that are not listed keep all lines.
    """
    gone = (
        dropped_lines(docs, min_chars)
        .groupBy("doc", "mark")
        .agg(F.collect_set("pos").alias("gone"))  # at most the lines of one document
    )
    most = F.array_max("gone") + 1
    return gone.select(
        "doc", "mark", F.size("gone").cast("long").alias("n_dropped"), _pack(most, "gone").alias("keep")
    )


@F.pandas_udf(T.StringType())
def _apply(text: pd.Series, keep: pd.Series) -> pd.Series:
    """Lines past the end of a bitmap stay."""

    def one(t: str | None, bitmap: bytes | None) -> str:
        t = t or ""
        if bitmap is None:
            return t
        lines = t.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)).tolist()
        return "\n".join(
            [x for x, b in zip(lines, bits, strict=False) if b] + lines[len(bits) :]
        )

    return pd.Series([one(t, k) for t, k in zip(text, keep, strict=True)], dtype=object)


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``."""
    docs = docs.drop("kept_text", "n_lines", "n_dropped", "_doc", "_mark")
    ids = docs.withColumns(
        {"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))), "_mark": text_mark()}
    )
    bitmaps = bitmaps.select(
        F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), "n_dropped", F.col("keep").alias("_keep")
    )
    newlines = F.length(F.coalesce("text", F.lit(""))) - F.length(
        F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))
    )
    return (
        ids.join(bitmaps, ["_doc", "_mark"], "left")
        .withColumns(
            {
                "n_lines": (newlines + 1).cast("long"),
                "n_dropped": F.coalesce("n_dropped", F.lit(0).cast("long")),
                "kept_text": F.when(
                    F.col("_keep").isNotNull(), _apply("text", "_keep")
                ).otherwise(F.coalesce("text", F.lit(""))),
            }
        )
        .drop("_doc", "_mark", "_keep")
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    return drop_lines(docs, settle(keep_bitmaps(docs, min_chars)))
