"""Fingerprints against sums over whole texts, with hostile rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.llm import multiset_hash as mh

LONG = "\n".join(f"Sentence {i}. Another {i}! Ünd 𝒳{i}" for i in range(30_000))
ROWS = [
    (1, "one line only"),
    (2, "a. b. c.\nd e f\n\nlast"),
    (3, None),
    (4, ""),
    (5, LONG),
    (6, "a. b. c.\nd e f\n\nlast"),
    (7, "\n\n\n"),
    (7, "\n\n\n"),
    (7, "other text of the same id"),
    (None, "no id"),
    (None, "no id"),
    (None, "no id either\nat all"),
    (-3, "falling ids go below zero.\nWell."),
] + [(1000 + i, "\n".join(f"p{j} of {i}. And so on." for j in range(i % 9))) for i in range(60)]


def prints(texts):
    return mh.to_text(mh.vectors([mh.paragraphs(t) for t in texts]))


def want(rows):
    import xxhash

    key = lambda r: (r[0] is None, -(r[0] or 0), np.int64(np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42))))
    ordered = sorted(rows, key=key)
    out = Counter()
    for i, (d, t) in enumerate(ordered):
        t, nxt = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        k = len(t) // 2
        edited = t[: len(t) - k] + nxt[:k]
        a, b = prints([t, edited])
        out[d, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b] += 1
    return out


@pytest.mark.parametrize("block_chars", [40, 1000, 1 << 22])
def test_edited_texts(spark, block_chars):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    docs = docs.withColumns({c: F.lit("x") for c in ("block", "guest", "_hash", "n_chars")})
    got = mh.edited_texts(docs, block_chars).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got) == want(ROWS)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert all((r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint) for r in got)


def test_few_rows(spark):
    assert mh.edited_texts(spark.createDataFrame([], "doc_id long, text string")).isEmpty()
    (only,) = mh.edited_texts(spark.createDataFrame([(1, "ab")], "doc_id long, text string")).collect()
    assert only.edited_sha256 == hashlib.sha256(b"aa").hexdigest() and only.near_next == 1
    copies = spark.createDataFrame([(None, "abcd")] * 3000, "doc_id long, text string")
    got = mh.edited_texts(copies, 100).collect()
    assert len(got) == 3000 and {r.edited_sha256 for r in got} == {hashlib.sha256(b"abab").hexdigest()}


def test_order_insertion_and_deletion():
    rng = random.Random(3)
    for _ in range(50):
        parts = [f"Part {rng.randrange(30)}. Of {rng.randrange(30)}." for _ in range(rng.randrange(1, 40))]
        mixed = rng.sample(parts, len(parts))
        assert prints(["\n".join(parts)]) == prints(["\n".join(mixed)])
        whole, some, rest = mh.vectors([parts, parts[:7], parts[7:]])[0:2], mh.vectors([parts[:7]]), mh.vectors([parts[7:]])
        one = tuple(x[:1] for x in whole)
        assert mh.to_text(mh.delete(one, some)) == mh.to_text(rest)
        assert mh.to_text(mh.insert(rest, some)) == mh.to_text(one)
        if len(parts) > 1 and parts[0] != parts[1]:
            assert prints(["\n".join(parts)]) != prints(["\n".join(parts[1:])])


def test_likeness_follows_shared_sentences():
    for shared in (0, 25, 50, 75, 100):
        one = [f"Common {i}." for i in range(shared)] + [f"Left {i}." for i in range(100 - shared)]
        other = [f"Common {i}." for i in range(shared)] + [f"Right {i}." for i in range(100 - shared)]
        near = mh.likeness(mh.vectors([one]), mh.vectors([other]))[0]
        assert abs(near - shared / 100) < 0.2
    assert near == 1
