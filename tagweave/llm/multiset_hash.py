"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs, which are what ``\\n`` splits (a null or empty text is
one empty paragraph). Each paragraph is hashed to a wide vector: ``STRONG`` lanes modulo
2 ** 64 that hold its digest, and ``LANES`` lanes modulo 2 ** 16 of which every sentence of the
paragraph moves one by 1 or -1. A fingerprint is the sum of the vectors. So order does not
matter, equal multisets have equal fingerprints, and paragraphs are inserted or deleted by
adding or subtracting their vectors: the fingerprint of an edited text is made from the old
one and the paragraphs that the edit touches, never from the whole new text.

The strong lanes tell equality. The others are linear too; the squared length of the difference
of two of them estimates how many sentences differ, which gives the likeness
1 - differing / (sentences of both), between 0 and 1. It is 1 only for equal fingerprints.

``edited_texts`` pairs every text with the next one by falling id (after the last the first)
and replaces its last half, ``floor(n / 2)`` code points, by as many of the next one's first. Null
ids come last; rows with one id are ordered by a hash of the text; equal rows follow each other and
are interchangeable. Texts go to blocks of that order in one shuffle, and the row that begins a
block is sent to the block before as well. The cuts between blocks come from a sample of keys; they
affect balance only, and at most ``MAX_BLOCKS`` are made.

A single row is its own next. An empty table gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import short_batches

STRONG = 8
LANES = 256
BLOCK_CHARS = 4 << 20
MAX_BLOCKS = 65_536
SAMPLES = 20  # sampled keys a block
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def paragraphs(text: str | None) -> list[str]:
    return (text or "").split("\n")


def vectors(groups: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the paragraphs' vectors of each group; a group may be empty."""
    digests, rows, lanes, signs = [], [], [], []
    counts = np.zeros(len(groups), np.int64)
    for g, group in enumerate(groups):
        counts[g] = len(group)
        for paragraph in group:
            raw = paragraph.encode("utf-8", "replace")
            digests.append(hashlib.blake2b(raw, digest_size=8 * STRONG).digest())
            for sentence in SENTENCE.split(paragraph.strip()):
                if sentence:
                    h = xxhash.xxh3_64_intdigest(sentence.encode("utf-8", "replace"))
                    rows.append(g)
                    lanes.append(h % LANES)
                    signs.append(1 if h >> 63 else -1)
    each = np.frombuffer(b"".join(digests), "<u8").reshape(-1, STRONG)
    upto = np.concatenate((np.zeros((1, STRONG), np.uint64), np.cumsum(each, axis=0, dtype=np.uint64)))
    ends = np.cumsum(counts)
    strong = upto[ends] - upto[ends - counts]
    sketch = np.zeros((len(groups), LANES), np.int64)
    np.add.at(sketch, (rows, lanes), signs)
    return strong, sketch.astype(np.uint16)


def insert(to: tuple, what: tuple) -> tuple[np.ndarray, np.ndarray]:
    return to[0] + what[0], to[1] + what[1]


def delete(of: tuple, what: tuple) -> tuple[np.ndarray, np.ndarray]:
    return of[0] - what[0], of[1] - what[1]


def to_text(print_: tuple) -> list[str]:
    """Hexadecimal, little-endian: the strong lanes, then the others."""
    strong, sketch = print_
    return [
        a.tobytes().hex() + b.tobytes().hex()
        for a, b in zip(strong.astype("<u8"), sketch.astype("<u2"), strict=True)
    ]


def likeness(one: tuple, other: tuple) -> np.ndarray:
    def squares(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.int16).astype(np.float64)
        return (x * x).sum(axis=1)

    both = squares(one[1]) + squares(other[1])
    apart = squares(one[1] - other[1])
    equal = (one[0] == other[0]).all(axis=1) & (one[1] == other[1]).all(axis=1)
    # paragraphs that differ without moving a lane still count as a difference
    share = np.maximum(apart, 1.0) / np.maximum(both, 1.0)
    return np.where(equal, 1.0, np.clip(1.0 - share, 0.0, 1.0))


def edit(text: str, following: str) -> tuple[str, int]:
    """The edited text and the start of the first paragraph that the edit touches."""
    half = len(text) // 2
    kept = text[: len(text) - half]
    return kept + following[:half], kept.rfind("\n") + 1


_ORDER = ["_null", "_inv", "_hash"]


def _keyed(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        doc_id.isNull().cast("int").alias("_null"),
        F.coalesce(F.bitwise_not(doc_id), F.lit(0).cast("long")).alias("_inv"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"),
    )


def _cuts(keyed: DataFrame, block_chars: int) -> list[tuple[int, int, int]]:
    """First keys of blocks of about ``block_chars``; the smallest key of all is the first."""
    chars = F.length("text") + F.lit(1)
    total = keyed.agg(
        F.count("*").alias("n"),
        F.sum(chars).alias("chars"),
        F.min(F.struct(*_ORDER)).alias("first"),
    ).first()
    if not total.n:
        return []
    blocks = min(MAX_BLOCKS, -(-total.chars // block_chars))
    cuts = [tuple(total.first)]
    if blocks > 1:
        draw = F.pmod(F.xxhash64(*_ORDER, F.lit("cut")), F.lit(1 << 30))
        share = int(min(1.0, SAMPLES * blocks / total.n) * (1 << 30))
        sample = sorted(
            (*(r[c] for c in _ORDER), r.chars)
            for r in keyed.where(draw < share).select(*_ORDER, chars.alias("chars")).collect()
        )
        step = sum(r[-1] for r in sample) / blocks
        seen, due = 0, step
        for *key, size in sample:
            if seen >= due and tuple(key) > cuts[-1]:
                cuts.append(tuple(key))
                due = (seen // step + 1) * step
            seen += size
    return cuts


_OWN, _GUEST = 0, 1
_ROUTED = pa.schema(
    [
        ("block", pa.int32()),
        ("guest", pa.int32()),
        ("_null", pa.int32()),
        ("_inv", pa.int64()),
        ("_hash", pa.int64()),
        ("doc_id", pa.int64()),
        ("text", pa.string()),
    ]
)


def _route(cuts: list[tuple[int, int, int]]):
    """To each row its block; rows that begin a block also go to the one before.

    A row equal to an earlier one of its batch follows that one, so it is its own next. Such
    rows go to blocks below zero, dealt out evenly however many copies there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twins = 0
        for batch in batches:
            out, seen = [], {}
            for doc, text, *key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = tuple(key)
                if seen.get(key) == text:
                    twins += 1
                    out.append((-1 - twins % 4096, _OWN, *key, doc, text))
                    continue
                seen[key] = text
                block = bisect.bisect_right(cuts, key) - 1
                out.append((block, _OWN, *key, doc, text))
                if cuts[block] == key:
                    out.append(((block or len(cuts)) - 1, _GUEST, *key, doc, text))
            columns = zip(*out, strict=True) if out else [[] for _ in _ROUTED]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _ROUTED, strict=True)], schema=_ROUTED
            )

    return run


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def _finish(rows: list[tuple]) -> pa.RecordBatch:
    """The result for rows of (doc_id, text, next text)."""
    texts = [t for _, t, _ in rows]
    place, extra = [], []
    for i, (_, _, following) in enumerate(rows):
        if i + 1 < len(rows) and following is texts[i + 1]:
            place.append(i + 1)
        else:
            place.append(len(rows) + len(extra))
            extra.append(following)
    prints = vectors([paragraphs(t) for t in [*texts, *extra]])
    own = tuple(p[: len(rows)] for p in prints)
    following = tuple(p[place] for p in prints)
    hashes, gone, come = [], [], []
    for _, text, other in rows:
        edited, start = edit(text, other)
        hashes.append(hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest())
        gone.append(paragraphs(text[start:]))
        come.append(paragraphs(edited[start:]))
    changed = insert(delete(own, vectors(gone)), vectors(come))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([d for d, _, _ in rows], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array(hashes, pa.string()),
            pa.array(to_text(own), pa.string()),
            pa.array(to_text(changed), pa.string()),
            pa.array(likeness(own, changed)),
            pa.array(likeness(own, following)),
        ],
        names=[c.split()[0] for c in SCHEMA.split(", ")],
    )


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a block with the text of the row after it; one row is held back."""
    held = None  # (block, doc_id, text)
    for batch in batches:
        ready = []
        columns = (batch.column(k).to_pylist() for k in (0, 1, 5, 6))
        for block, guest, doc, text in zip(*columns, strict=True):
            if block < 0:
                ready.append((doc, text, text))
                continue
            if held is not None and held[0] == block:
                ready.append((*held[1:], text))
            elif held is not None:
                raise ValueError(f"no row begins the block after {held[0]}")
            held = None if guest else (block, doc, text)
        if ready:
            yield _finish(ready)
    if held is not None:
        raise ValueError(f"no row begins the block after {held[0]}")


def edited_texts(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document (``SCHEMA``)."""
    short_batches(docs.sparkSession)
    keyed = _keyed(docs)
    cuts = _cuts(keyed, block_chars)
    if not cuts:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    routed = "block int, guest int, _null int, _inv long, _hash long, doc_id long, text string"
    return (
        keyed.select("doc_id", "text", *_ORDER)
        .mapInArrow(_route(cuts), routed)
        .repartition("block")
        .sortWithinPartitions("block", "guest", *_ORDER)
        .mapInArrow(_pair, SCHEMA)
    )
