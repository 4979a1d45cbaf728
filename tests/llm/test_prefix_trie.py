"""The trie against plain dictionaries, with hostile rows."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tagweave.llm import prefix_trie as pt
from tagweave.llm.oracles import ORACLES

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((t is not None, t or 0), digest, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    members = {}
    ends = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])
        whole = tuple(base[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return Counter(
        (
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def table(seed, convs=90, words=3, most=12):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 400), convs):
        rows += [(c, t, rng.choice(["user", "assistant"]), f"w{rng.randrange(words)} é" * rng.randrange(3)) for t in range(rng.randrange(1, most))]
    return rows


HOSTILE = (
    table(0)
    + [(None, 1, "user", "lost"), (3, None, None, None), (3, None, None, None), (3, 0, "", ""), (3, 0, "x", "same turn")]
    + [(1000 + 5 * i, 0, "user", "hot first turn") for i in range(300)]
    + [(5000 + i, t, "user", f"copy {t}") for i in range(300) for t in range(9)]
    + [(9005, t, "user", "deep") for t in range(700)]
    + [(9010, t, "user", "deep") for t in range(350)]
    + [(9021, 0, "user", "nothing left of it")]
)


@pytest.mark.parametrize("rows", [HOSTILE, table(2, 150, 2, 40), [(9021, 0, "user", "x")]])
def test_nodes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({k: F.lit("x") for k in ("key", "h", "depth", "n")})
    got = pt.trie_nodes(df).collect()
    assert Counter(map(tuple, got)) == plain(rows)


def test_no_rows(spark):
    assert pt.trie_nodes(spark.createDataFrame([], SCHEMA)).isEmpty()
    assert pt.trie_nodes(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).isEmpty()


def test_blocks_of_many_ids(spark, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK", 50)
    convs = spark.range(0, 5000).select(F.lit(b"k").alias("key"), F.col("id").alias("conv_id"))
    (row,) = pt.end_hashes(convs).collect()
    assert row.ends_sha256 == hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest()


def test_two_fattest(spark):
    got = spark.range(40).crossJoin(spark.range(40).toDF("b")).where("id < b").select("id", "b", pt.two_fattest(F.col("id"), F.col("b")).alias("f")).collect()
    for r in got:
        assert r.f == max(range(r.id + 1, r.b + 1), key=lambda x: x & -x)


def test_sql_says_the_same():
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    rows = HOSTILE[:-1051]
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cols = pt.SCHEMA.replace(" long", "").replace(" string", "")
    assert Counter(con.sql(f"SELECT {cols} FROM ({ORACLES['op12_prefix_trie']})").fetchall()) == plain(rows)
