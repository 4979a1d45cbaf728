"""Personal data: fixed patterns, and identifiers that bootstrapped contexts reveal.

Base spans come from four patterns (email, ip, card, phone). They are the seeds of a
bootstrap over the whole table. Every identifier-like token (a seed, or a run with three digits or an
at sign) is an *instance*; the words around it form *patterns*: the two words before it, and the
word before with the word after. Patterns and instances form a graph. Seeds score
1 for their kind. In each round a pattern's confidence for a kind is the sum of its
distinct instances' scores over their number plus ``SMOOTH``, and an instance that is no seed scores
1 - product(1 - confidence) over patterns that reach ``CONFIDENT``. After ``ROUNDS`` rounds, instances that
score ``ACCEPT`` or more for a kind and have its form are reported at each occurrence next to a confident pattern. A pattern
needs several distinct seeds to become confident, so contexts met by chance add nothing.

Texts are scanned once; what is kept of them are spans and hashes of contexts. Rounds are
joins and sums over those. Hot patterns and instances are summed before the shuffle.

Spans count code points, end exclusive. Null and empty texts have none. Repeated rows
each get their own result; null ids pass through; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import short_batches, task_number
from tagweave.operators.lineage import settle

KINDS = ("email", "ip", "card", "phone")
SMOOTH = 2.0
CONFIDENT = 0.6
ACCEPT = 0.6
ROUNDS = 3

# the possible starts of a match are told by what stands before, so scans are linear
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE = re.compile(r"(?<![^\s,;<>\"'|])[^\s,;<>\"'|0-9@]*[0-9@][^\s,;<>\"'|]*")
SOME = re.compile(r"[0-9@]")
WORD = re.compile(r"\S+")
NEAR = 80  # characters on either side in which context words are looked for

Span = tuple[int, int, int]  # start, index of kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    spans: list[Span] = []
    if "@" in text:
        done = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in LOCAL_SIGNS:
                start -= 1
            if start < m.start():
                spans.append((start, 0, m.end()))
                done = m.end()
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            spans.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def forms(token: str) -> list[int]:
    """Kinds whose form a token has, less strictly than the base patterns."""
    digits = sum(c in "0123456789" for c in token)
    signs = len(token) - digits
    out = []
    if re.fullmatch(r"[^@]{1,64}(?:@|\(at\)|\[at\])[^@]{2,255}", token):
        out.append(0)
    if re.fullmatch(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}|[0-9]{1,3}(?:[.-][0-9]{1,3}){3}", token):
        out.append(1)
    if 12 <= digits <= 19 and signs <= 4:
        out.append(2)
    if 7 <= digits <= 15 and signs <= 5:
        out.append(3)
    return out


def contexts(text: str, start: int, end: int) -> list[int]:
    """Hashes of the two words before, and of one before with one after."""
    before = WORD.findall(text[max(0, start - NEAR) : start].lower())[-2:]
    after = WORD.findall(text[end : end + NEAR].lower())[:1]
    signs = ".,;:!?()[]\"'#*$%&|<>"
    before = [w.strip(signs) or w for w in before]
    after = [w.strip(signs) or w for w in after]
    out = []
    if len(before) == 2:
        out.append(f"L {before[0]} {before[1]}")
    if before and after:
        out.append(f"M {before[-1]} {after[0]}")
    return [xxhash.xxh64_intdigest(p.encode()) - (1 << 63) for p in out]


def occurrences(text: str, base: list[Span]) -> list[tuple]:
    """(start, end, instance hash, seed kind or -1, forms, contexts) of every instance."""
    found = [(s, e, k, [k]) for s, k, e in base]
    covered = sorted((s, e) for s, _, e in base)
    i = 0
    for m in LOOSE.finditer(text):
        token = m[0].strip(".,:!?()[]*#$%&")
        if not 6 <= len(token) <= 320:
            continue
        if "@" not in token and sum(c in "0123456789" for c in token) < 3:
            continue
        start = m.start() + m[0].index(token)
        end = start + len(token)
        while i < len(covered) and covered[i][1] <= start:
            i += 1
        if any(s < end and start < e for s, e in covered[i : i + 8]):
            continue
        if shapes := forms(token):
            found.append((start, end, -1, shapes))
    return [
        (s, e, xxhash.xxh64_intdigest(text[s:e].lower().encode()) - (1 << 63), k, shapes, contexts(text, s, e))
        for s, e, k, shapes in found
    ]


OCCURRENCE = (
    "array<struct<start:int,end:int,instance:bigint,kind:int,forms:array<int>,contexts:array<bigint>>>"
)
SCANNED = (
    "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
    f"base_sha256 string, base array<struct<start:int,kind:int,end:int>>, found {OCCURRENCE}"
)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and instances of each text (``SCANNED``); settle it before use."""
    short_batches(docs.sparkSession)
    occurrence = pa.struct(
        [
            ("start", pa.int32()),
            ("end", pa.int32()),
            ("instance", pa.int64()),
            ("kind", pa.int32()),
            ("forms", pa.list_(pa.int32())),
            ("contexts", pa.list_(pa.int64())),
        ]
    )
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    names = [c.split()[0] for c in SCANNED.split(", ")[:7]] + ["base", "found"]
    kinds = [pa.int64()] * 6 + [pa.string(), pa.list_(span), pa.list_(occurrence)]
    keys = [f.name for f in occurrence]

    def run(batches):
        row = task_number() << 33
        for batch in batches:
            out = [[] for _ in names]
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                some = SOME.search(text) is not None
                base = base_spans(text) if some else []
                counts = [sum(s[1] == k for s in base) for k in range(4)]
                values = [
                    row,
                    doc,
                    *counts,
                    hashlib.sha256(joined(base).encode()).hexdigest(),
                    [{"start": s, "kind": k, "end": e} for s, k, e in base],
                    [dict(zip(keys, x, strict=True)) for x in (occurrences(text, base) if some else [])],
                ]
                for column, v in zip(out, values, strict=True):
                    column.append(v)
                row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCANNED)


def bootstrap(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Confident patterns ``(pattern, kind, confidence)`` and ``(instance, kind, score)``.

    ``edges (pattern, instance, seed)`` are distinct; ``seed`` is a kind or null.
    """
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = edges.where(F.col("seed").isNotNull()).select("instance", F.col("seed").alias("kind"))
    seeds = settle(seeds.distinct().withColumn("score", F.lit(1.0)))
    plain = settle(edges.where(F.col("seed").isNull()).select("pattern", "instance"))
    scores = seeds
    for _ in range(rounds):
        patterns = settle(
            edges.select("pattern", "instance")
            .join(scores, "instance")
            .groupBy("pattern", "kind")
            .agg(F.sum("score").alias("total"))
            .join(sizes, "pattern")
            .select("pattern", "kind", F.round(F.col("total") / (F.col("n") + SMOOTH), 9).alias("confidence"))
            .where(F.col("confidence") >= CONFIDENT)
        )
        learned = (
            plain.join(patterns, "pattern")
            .groupBy("instance", "kind")
            .agg(F.round(1 - F.exp(F.sum(F.log(1 - F.col("confidence")))), 9).alias("score"))
        )
        scores = settle(seeds.unionByName(learned))
    return patterns, scores


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per document its base counts, ``base_sha256``, ``n_added`` and all ``spans``."""
    scanned = settle(scan(docs))
    found = scanned.select("row", F.explode("found").alias("f")).select(
        "row", "f.start", "f.end", "f.instance", "f.kind", "f.forms", F.explode("f.contexts").alias("pattern")
    )
    found = settle(found)
    seed = F.when(F.col("kind") >= 0, F.col("kind"))
    edges = settle(
        found.groupBy("pattern", "instance").agg(F.max(seed).alias("seed"))
    )
    patterns, scores = bootstrap(edges, rounds)
    added = (
        found.where(F.col("kind") < 0)
        .drop("kind")
        .join(patterns.select("pattern", "kind"), "pattern")
        .where(F.array_contains("forms", F.col("kind")))
        .join(scores.where(F.col("score") >= ACCEPT), ["instance", "kind"])
        .groupBy("row", "start", "end")
        .agg(F.min_by("kind", F.struct(-F.col("score"), "kind")).alias("kind"))
        # the spans of one text at most
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    names = F.array(*map(F.lit, KINDS))
    spans = F.transform(
        F.array_sort(F.concat("base", F.coalesce("added", none))),
        lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
    )
    return scanned.drop("found").join(added, "row", "left").select(
        "doc_id",
        *(f"n_{k}" for k in KINDS),
        "base_sha256",
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"),
        F.array_join(spans, ",").alias("spans"),
    )
