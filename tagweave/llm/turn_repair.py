"""Repair of the turn structure of conversations by an auction shortest-path search.

``damage`` harms rows by a checksum of conversation and turn; ``repair`` finds, for every
conversation, the cheapest edits after which the initials of its roles read
``(s?(ua)+)?``. A row is kept (K, 0), given the role that the place asks for, user or
assistant (R, 3), or deleted (D, 4; the only choice for blank and duplicate rows); rows with
an empty text may be inserted anywhere (I, 3); a truncated row that stays adds 3.

Nodes of the lattice are (rows consumed, what the last role was). Each node has a price, at
first the least that the rows still ahead can cost. A path grows from an origin: it is extended over
an arc that its last node's price pays for exactly, or else that price is raised to what the best
arc needs and the path is contracted by that node. Origins are taken from the last rows to the
first, and a path ends at the goal or at any node that an earlier path went through, so prices are
raised near the origin only. At the end prices are distances to the goal, arcs that they pay for
exactly are tight, and following the least letter over tight arcs spells the least of all
cheapest edits. Conversations whose rows are of the same kinds in the same order share one search.

The search reads one narrow row per turn; texts are sorted by conversation and turn once and
streamed, so a task holds one conversation's kinds, never its texts.

Null roles and texts are one space, null conversation ids are one conversation, null turns come
first. Rows with equal turns are ordered by a digest of role and text. Initials are the role's
first character, or nothing. Repeated rows are duplicates. An empty table gives an empty result;
other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import SPACES, short_batches

REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
LEGAL = {"su", "ua", "au"}

# what the last role was
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
# for each initial the roles it may follow
_AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, alive)``; a dropped row stays with ``alive`` false."""

    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(number("conv_id"), F.lit(":"), number("turn")).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "")
        .when(kind == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text)
        .alias("text"),
        (kind != 0).alias("alive"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def _digest() -> Column:
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


_TURNS = "conv_id long, turn long, alive boolean, digest binary, initial string, blank boolean, cut boolean"


def _turns(rows: DataFrame) -> DataFrame:
    bare = F.btrim("text", F.lit(SPACES))
    return rows.select(
        "conv_id",
        "turn",
        "alive",
        _digest().alias("digest"),
        F.substring("role", 1, 1).alias("initial"),
        (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )


# kinds of rows: "x" must go; else the initial, in upper case if the text is truncated
def _arcs(kinds: str, place: int, last: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, place, last) of the edits possible at a node."""
    arcs = [("I", INSERT, place, _NEXT[last])]
    if place < len(kinds):
        kind = kinds[place]
        arcs.append(("D", DELETE, place + 1, last))
        if kind != "x":
            cut = CUT if kind.isupper() else 0
            arcs.append(("R", REROLE + cut, place + 1, _NEXT[last]))
            kept = _AFTER.get(kind.lower(), {}).get(last)
            if kept is not None:
                arcs.append(("K", cut, place + 1, kept))
    return arcs


def _least(kind: str) -> int:
    """What a row costs at least, wherever it stands."""
    if kind == "x":
        return DELETE
    cut = CUT if kind.isupper() else 0
    return cut if kind.lower() in _AFTER else min(DELETE, REROLE + cut)


def prices(kinds: str) -> list[list[int]]:
    """Distance to the goal from each node, by auction."""
    n = len(kinds)
    price = [[0] * 4 for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        price[i] = [price[i + 1][0] + _least(kinds[i])] * 4
    reached = [[False] * 4 for _ in range(n + 1)]
    reached[n][START] = reached[n][ASSISTANT] = True  # no more edits, the goal
    for i in range(n, -1, -1):
        for s in range(4):
            path = [(i, s)]
            while True:
                at = path[-1]
                if reached[at[0]][at[1]]:
                    break
                cost, place, last = min((c + price[j][t], j, t) for _, c, j, t in _arcs(kinds, *at))
                if price[at[0]][at[1]] < cost:
                    price[at[0]][at[1]] = cost
                    if len(path) > 1:
                        path.pop()
                else:
                    path.append((place, last))
            for j, t in path:
                reached[j][t] = True
    return price


@lru_cache(maxsize=1 << 16)
def _solve_short(kinds: str) -> tuple[int, str]:
    return _solve(kinds)


def _solve(kinds: str) -> tuple[int, str]:
    price = prices(kinds)
    letters, at = [], (0, START)
    while at not in ((len(kinds), START), (len(kinds), ASSISTANT)):
        left = price[at[0]][at[1]]
        letter, place, last = min(
            (a, j, t) for a, c, j, t in _arcs(kinds, *at) if c + price[j][t] == left
        )
        letters.append(letter)
        at = (place, last)
    return price[0][START], "".join(letters)


def solve(kinds: str) -> tuple[int, str]:
    """Cost and the least string of cheapest edits."""
    return _solve_short(kinds) if len(kinds) <= 64 else _solve(kinds)


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_SUMMARY = f"conv_id long, {', '.join(f'{c} long' for c in _COUNTS)}, audit string"


class _Conversation:
    """What is known of the conversation that is being read."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.seen: set[bytes] = set()
        self.kinds: list[str] = []
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial: str | None = None

    def add(self, turn: int | None, digest: bytes, initial: str, blank: bool, cut: bool) -> None:
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
            self.turns += 1
        kind = "x"
        if blank:
            self.blank += 1
        elif digest in self.seen:
            self.duplicate += 1
        else:
            self.truncated += cut
            kind = initial if initial in _AFTER else "o"
            kind = kind.upper() if cut else kind
        self.seen.add(digest)
        self.kinds.append(kind)
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        self.initial = initial

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit = solve("".join(self.kinds))
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit)


def _record(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
    )


_SUMMARY_NAMES = ["conv_id", *_COUNTS, "audit"]
_SUMMARY_KINDS = [pa.int64()] * (1 + len(_COUNTS)) + [pa.string()]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    for batch in batches:
        out = []
        for conv_id, turn, alive, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    out.append(now.row())
                now = _Conversation(conv_id)
            if alive:
                now.add(turn, *rest)
        yield _record(out, _SUMMARY_NAMES, _SUMMARY_KINDS)
    if now is not None:
        yield _record([now.row()], _SUMMARY_NAMES, _SUMMARY_KINDS)


def find_edits(rows: DataFrame) -> DataFrame:
    """One row per conversation with its counts, the cost and the edits (``audit``)."""
    return (
        _turns(rows)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "digest")
        .mapInArrow(_search, _SUMMARY)
    )


class _Repaired:
    """Hash of a repaired conversation, made while its rows go by."""

    def __init__(self, summary: tuple) -> None:
        self.summary = summary
        self.audit = summary[-1]
        self.at, self.last = 0, START
        self.hash = hashlib.sha256()
        self.empty = True

    def _put(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode("utf-8", "replace"))
        self.empty = False

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.last = _NEXT[self.last]
            self._put(_ROLE[self.last], "")

    def row(self, role: str, text: str) -> None:
        self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.last = _AFTER[role[0]][self.last]
            self._put(role, text)
        elif letter == "R":
            self.last = _NEXT[self.last]
            self._put(_ROLE[self.last], text)

    def end(self) -> tuple:
        self._inserts()
        return (*self.summary, self.hash.hexdigest())


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's edits come first, its rows after them."""
    names, kinds = [*_SUMMARY_NAMES, "repaired_sha256"], [*_SUMMARY_KINDS, pa.string()]
    now = None
    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("role", "text", *_SUMMARY_NAMES)]
        for role, text, *summary in zip(*columns, strict=True):
            if summary[-1] is not None:
                if now is not None:
                    out.append(now.end())
                now = _Repaired(tuple(summary))
            else:
                now.row(role, text)
        yield _record(out, names, kinds)
    if now is not None:
        yield _record([now.end()], names, kinds)


def repair(rows: DataFrame) -> DataFrame:
    """``find_edits`` with ``repaired_sha256``; ``rows`` as from ``damage``."""
    short_batches(rows.sparkSession)
    edits = find_edits(rows)
    texts = rows.where("alive").select("conv_id", "turn", _digest().alias("digest"), "role", "text")
    return (
        edits.withColumn("_row", F.lit(0))
        .unionByName(texts.withColumn("_row", F.lit(1)), allowMissingColumns=True)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "_row", F.asc_nulls_first("turn"), "digest")
        .mapInArrow(_apply, f"{_SUMMARY}, repaired_sha256 string")
    )
