"""Repair of conversations against plain dynamic programming, with hostile rows."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tagweave.llm import turn_repair as tr
from tagweave.llm.oracles import ORACLES

WS = " \t\n\x0b\x0c\r"
GOOD = re.compile(r"(s?(ua)+)?")


def best(kinds):
    """Least (cost, edits) to every last role, row by row, with whole strings."""
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(states):
        for _ in range(2):
            for s, (c, w) in list(states.items()):
                new = (c + 3, w + "I")
                if new < states.get(nxt[s], (1 << 40, "")):
                    states[nxt[s]] = new
        return states

    states = inserted({"": (0, "")})
    for k in kinds:
        new = {}

        def put(s, value):
            if value < new.get(s, (1 << 40, "")):
                new[s] = value

        for s, (c, w) in states.items():
            put(s, (c + 4, w + "D"))
            if k != "x":
                cut = 3 * k.isupper()
                put(nxt[s], (c + 3 + cut, w + "R"))
                if k.lower() in "sua" and (k.lower() == nxt[s] or (k.lower() == "s" and s == "")):
                    put(k.lower(), (c + cut, w + "K"))
        states = inserted(new)
    return min(states[s] for s in ("", "a") if s in states)


def test_solve_against_dynamic_programming():
    for n in range(6):
        for kinds in itertools.product("xsuaUAo", repeat=n) if n < 5 else ():
            assert tr.solve("".join(kinds)) == best("".join(kinds))
    rng = random.Random(1)
    for _ in range(300):
        kinds = "".join(rng.choice("xsuaSUAoO") for _ in range(rng.randrange(5, 120)))
        assert tr.solve(kinds) == best(kinds)


def test_prices_are_distances_and_long_conversations_end():
    kinds = "".join(random.Random(2).choice("xsuaSUAo") for _ in range(20_000))
    cost, audit = tr.solve(kinds)
    price = tr.prices(kinds)
    assert price[0][tr.START] == cost and len(audit) - audit.count("I") == len(kinds)
    for i in range(0, len(kinds), 997):
        for s in range(4):
            assert price[i][s] == min(c + price[j][t] for _, c, j, t in tr._arcs(kinds, i, s))


def plain(rows):
    """The whole contract on lists."""
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        by[c] += [(t, role, text)] * (2 if kind == 3 else 1)
    out = set()
    for c, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, kinds, n = set(), "", {"blank": 0, "dup": 0, "cut": 0}
        for _, role, text in rows:
            bare = text.strip(WS)
            fault = "blank" if not bare else "dup" if (role, text) in seen else "cut" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            k = role[:1] if role[:1] and role[:1] in "sua" else "o"
            kinds += "x" if fault in ("blank", "dup") else k.upper() if fault == "cut" else k
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit = best(kinds)
        kept, todo, last = [], iter(rows), ""
        for letter in audit:
            nxt = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
            if letter == "I":
                kept.append((nxt, ""))
            else:
                _, role, text = next(todo)
                if letter != "D":
                    kept.append((role if letter == "K" else nxt, text))
            last = kept[-1][0][0] if kept else ""
        assert GOOD.fullmatch("".join(r[0] for r, _ in kept))
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out.add((c, gaps, n["blank"], n["dup"], n["cut"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def hostile():
    rng = random.Random(7)
    words = ["Yes.", "no", " \n", "", "Ünd 𝒳?", "a. b. c", "same", "x" * 2000, None, "end!\t\n"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "s"]
    rows = []
    for c in [None, -5, *range(70)]:
        for _ in range(rng.randrange(1, 14)):
            turn = rng.choice([None, *range(-2, 12), 10**12])
            rows.append((c, turn, rng.choice(roles[:3] * 4 + roles), rng.choice(words)))
    return rows + [(500, i, "user", "again") for i in range(400)] + rows[:5]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_repair(spark):
    rows = hostile()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({k: F.lit("x") for k in ("alive", "digest", "audit", "_row")})
    got = tr.repair(tr.damage(df)).collect()
    assert {tuple(r) for r in got} == plain(rows) and len(got) == len({r[0] for r in rows})


def test_dropped_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = tr.repair(tr.damage(spark.createDataFrame([(gone, 0, "user", "a.")], SCHEMA))).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert tr.repair(tr.damage(spark.createDataFrame([], SCHEMA))).isEmpty()


@pytest.mark.parametrize("which", ["hostile", "table"])
def test_sql_says_the_same(spark, which):
    rows = hostile() if which == "hostile" else [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cols = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES['op13_turn_repair']})").fetchall()
    assert set(got) == plain(rows)
