"""Scores of texts under a hierarchical Pitman-Yor model.

The model: a word is drawn in the restaurant of its context, the class of the word before
(``2 ** CONTEXT_BITS`` classes by hash, so what is kept per context is bounded). All context
restaurants share one parent, the unigram restaurant, whose base is even over the V known words
and one unknown: 1 / (V + 1) for each, and for each word that training never saw. Tokens of a text are
its words in lower case (A-Z) and one end.

Seating is sampled by Gibbs. The state of a restaurant is the number of tables t of each word with
c customers. In a sweep every (context, word) is seated anew given the other words' tables and the parent: up
to ``EXACT`` customers from the conditional, proportional to the generalised Stirling number S(c, t) times
the weight of t new tables; above that one customer after the other, where the waiting
time to the next new table is drawn in closed form. Tables are the parent's customers,
and the parent is seated the same way. All restaurants of a level are sampled at once, given the
totals of the sweep before. After ``BURN_IN`` sweeps, ``SAMPLES`` sweeps each give
predictive probabilities, and their average is the model's.

Work is dealt out by word: all contexts of a word are in one part, and the number of parts follows the
bytes of text (``PART_BYTES`` each, less where this gives few parts). Words that would outweigh a part (a
bounded number, found in a pass before) are dealt out by word and context, and their
sums are exchanged. Between sweeps the parts exchange only totals: one number per context class and per such
word. A chunk of documents asks each part for the distinct (word, context) it has, and gets their scores back in
the same order: what is sent follows the chunk's keys, however many parts there are. Draws depend on the word, the context and the sweep, so lost parts are recomputed alike.

Words are 64-bit hashes. Rows are kept apart, not ids: repeated rows are scored each.
Null texts are empty (one end token). Null ids count as the empty text when crc32 decides
on training. Without training tokens all counts are zero and scores follow the base
alone. Empty tables give empty results; other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import short_batches, task_number, words_of
from tagweave.operators.lineage import discard, settle

CONTEXT_BITS = 16
CONTEXTS = 1 << CONTEXT_BITS
DISCOUNTS = (0.8, 0.8)  # unigram, context
STRENGTHS = (1.0, 2.0)
BURN_IN = 1
SAMPLES = 3
EXACT = 64
FOLDS, HELD_OUT = 5, 1
CHUNK_TOKENS = 1 << 19
CHUNK_DOCS = 1 << 16  # a document's place in its chunk has 16 bits
REMEMBERED = 100_000
PART_BYTES = 8 << 20
# of short inputs, so that there are parts for many cores
SMALL_PART_BYTES, SMALL_PARTS = 2 << 20, 32
END = xxhash.xxh64_intdigest(b" ")  # no word has a space


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h
        return h


def is_held_out(doc_id: int | None) -> bool:
    text = b"" if doc_id is None else str(doc_id).encode()
    return zlib.crc32(text) % FOLDS == HELD_OUT


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc ids, tokens per doc, word hashes) of some documents at a time."""
    hashes = _Hashes()
    ids, sizes, tokens, n = [], [], [], 0
    for batch in batches:
        for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = list(map(hashes.__getitem__, words_of(text)))
            words.append(END)
            ids.append(doc)
            sizes.append(len(words))
            tokens.append(np.array(words, np.uint64))
            n += len(words)
            if n >= CHUNK_TOKENS or len(ids) == CHUNK_DOCS:
                yield ids, np.array(sizes), np.concatenate(tokens)
                ids, sizes, tokens, n = [], [], [], 0
    if ids:
        yield ids, np.array(sizes), np.concatenate(tokens)


def heavy_words(docs: DataFrame, parts: int) -> np.ndarray:
    """Hashes of words with more than a quarter of a part's share, at most 4 * parts.

    Such a word has that share in some chunk, so each chunk names few.
    """
    limit = 1 / (4 * parts)

    def run(batches):
        for _, _, tokens in _chunks(batches):
            words, n = np.unique(tokens, return_counts=True)
            some = n > limit * len(tokens)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(words[some], END).view(np.int64)),
                    pa.array(np.append(n[some], 0)),
                    pa.array(np.append(np.zeros(some.sum(), np.int64), len(tokens))),
                ],
                names=["word", "n", "all"],
            )

    sums = settle(
        docs.mapInArrow(run, "word long, n long, all long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    )
    total = sums.agg(F.sum("all")).first()[0] or 0
    rows = sums.where(F.col("n") > limit * total).select("word").collect()
    discard(sums)
    return np.sort(np.array([r.word for r in rows], np.int64).view(np.uint64))


def _part_of(words: np.ndarray, contexts: np.ndarray, heavy: np.ndarray, parts: int) -> np.ndarray:
    mixed = words.copy()
    is_heavy = np.isin(words, heavy)
    mixed[is_heavy] ^= (contexts[is_heavy].astype(np.uint64) + np.uint64(1)) * np.uint64(
        0x9E3779B97F4A7C15
    )
    # the low half; the top bits are the context class
    return ((mixed & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)


# a cell: what a chunk has of a part; with a negative part: the documents of a chunk
COUNTED = (
    "part long, chunk long, words binary, word_keys binary, contexts binary, train binary, "
    "ids binary, sizes binary, held binary, nulls binary, n binary, docs binary"
)
CHUNK_COLUMNS = ["chunk", "word_keys", "ids", "sizes", "held", "nulls", "n", "docs"]


def pack(x: np.ndarray) -> bytes:
    """The length and the first bytes of all numbers, then the second bytes and so on, compressed.

    What is sent are counts and places: mostly small, so that all but the first bytes vanish.
    """
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return np.int64(len(x)).tobytes() + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unpack(blob: bytes, kind: type) -> np.ndarray:
    kind = np.dtype(kind)
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    planes = pa.Codec("zstd").decompress(blob[8:], n * kind.itemsize, asbytes=True)
    values = np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T
    return np.ascontiguousarray(values).view(kind).reshape(n)


def _row(schema: str, **values) -> pa.RecordBatch:
    """One row; arrays are packed, columns not given are null."""
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    blobs = {k: pack(v) if isinstance(v, np.ndarray) else v for k, v in values.items()}
    return pa.RecordBatch.from_arrays(
        [pa.array([blobs.get(name)], kinds[kind]) for name, kind in fields], names=[f[0] for f in fields]
    )


def _count_chunks(heavy: np.ndarray, parts: int):
    """Per chunk and part its distinct (word, context) and their training counts.

    One more row per chunk has its documents: ``n`` tokens of each key, and every token's document.
    Both are in the order of part, word and context, in which the parts answer.
    """

    def run(batches):
        chunk = task_number() << 24
        for ids, sizes, tokens in _chunks(batches):
            held = np.array([is_held_out(d) for d in ids])
            docs = np.repeat(np.arange(len(ids)), sizes)
            before = np.empty_like(tokens)
            before[1:] = tokens[:-1]
            before[np.cumsum(sizes) - sizes] = END
            contexts = (before >> np.uint64(64 - CONTEXT_BITS)).astype(np.int64)
            words, number = np.unique(tokens, return_inverse=True)
            # sorted by word, context, document
            packed = np.sort((number << (CONTEXT_BITS + 17)) | (contexts << 17) | docs)
            docs, keys = packed & 0x1FFFF, packed >> 17
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            n = np.diff(np.append(first, len(keys)))
            train = np.add.reduceat(~held[docs], first, dtype=np.int64)
            keys = keys[first]
            key_words, key_contexts = words[keys >> CONTEXT_BITS], keys & (CONTEXTS - 1)
            part = _part_of(key_words, key_contexts, heavy, parts).astype(np.min_scalar_type(parts))
            token_order = np.argsort(np.repeat(part, n), kind="stable")
            order = np.argsort(part, kind="stable")
            part, key_words, key_contexts, train = part[order], key_words[order], key_contexts[order], train[order]
            is_new = np.append(True, (part[1:] != part[:-1]) | (key_words[1:] != key_words[:-1]))
            starts = np.flatnonzero(is_new)
            word_keys = np.diff(np.append(starts, len(part))).astype(np.uint32)
            bounds = np.searchsorted(part, np.arange(parts + 1))
            word_bounds = np.searchsorted(starts, bounds)
            for p in np.unique(part).tolist():
                k = slice(bounds[p], bounds[p + 1])
                w = slice(word_bounds[p], word_bounds[p + 1])
                yield _row(
                    COUNTED,
                    part=p,
                    chunk=chunk,
                    words=key_words[starts[w]],
                    word_keys=word_keys[w],
                    contexts=key_contexts[k].astype(np.uint16),
                    train=train[k].astype(np.uint32),
                )
            yield _row(
                COUNTED,
                part=-1 - chunk,
                chunk=chunk,
                word_keys=word_keys,
                ids=np.array([0 if d is None else d for d in ids], np.int64),
                sizes=sizes.astype(np.int64),
                held=held,
                nulls=np.array([d is None for d in ids]),
                n=n[order].astype(np.uint32),
                docs=docs[token_order].astype(np.uint16),
            )
            chunk += 1

    return run


MODEL = COUNTED + ", chunks binary, key_index binary"


def _merge_part(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for a part: its keys by word and context, and which of them each chunk has.

    Places of a chunk's keys are ascending and given by their differences. Rows of documents stay.
    """
    names = [c.split()[0] for c in MODEL.split(", ")]
    part = int(pdf["part"].iloc[0])
    if part < 0:
        return pdf.assign(chunks=None, key_index=None)[names]
    pdf = pdf.sort_values("chunk")
    column = lambda c, kind: [unpack(b, kind) for b in pdf[c]]
    words = np.repeat(
        np.concatenate(column("words", np.uint64)), np.concatenate(column("word_keys", np.uint32))
    )
    contexts = column("contexts", np.uint16)
    sizes = np.array([len(x) for x in contexts])
    known, number = np.unique(words, return_inverse=True)
    del words
    keys, index = np.unique((number << CONTEXT_BITS) | np.concatenate(contexts), return_inverse=True)
    del number, contexts
    train = np.bincount(index, np.concatenate(column("train", np.uint32)), len(keys))
    steps = np.diff(index, prepend=0)
    at = np.cumsum(sizes) - sizes
    steps[at] = index[at]
    row = {
        "part": part,
        "chunk": -1,
        "words": pack(known),
        "word_keys": pack(np.bincount(keys >> CONTEXT_BITS, minlength=len(known)).astype(np.uint32)),
        "contexts": pack((keys & (CONTEXTS - 1)).astype(np.uint16)),
        "train": pack(train.astype(np.uint32)),
        "chunks": pack(np.concatenate([pdf["chunk"].to_numpy(), sizes]).astype(np.int64)),
        "key_index": pack(steps.astype(np.uint32)),
    }
    return pd.DataFrame([[row.get(c) for c in names]], columns=names)


def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """log of generalised Stirling numbers S(c, t), -inf where there is none."""
    table = np.full((most + 1, most + 1), -np.inf)
    table[0, 0] = 0
    for c in range(1, most + 1):
        for t in range(1, c + 1):
            stay = table[c - 1, t] + np.log(c - 1 - discount * t) if c - 1 > t * discount else -np.inf
            table[c, t] = np.logaddexp(table[c - 1, t - 1], stay)
    return table


STIRLING = tuple(log_stirling(d) for d in DISCOUNTS)


def sample_tables(
    c: np.ndarray, base: np.ndarray, others: np.ndarray, level: int, rng: np.random.Generator
) -> np.ndarray:
    """Tables for ``c`` customers of one word in one restaurant, each.

    ``base``: the parent's probability of the word; ``others``: tables of other words.
    """
    d, strength = DISCOUNTS[level], STRENGTHS[level]
    t = np.minimum(c, 1).astype(np.int64)
    draw = rng.random(len(c))
    small = np.flatnonzero((c >= 2) & (c <= EXACT))
    small = small[np.argsort(c[small], kind="stable")]
    edges = np.searchsorted(c[small], np.arange(2, EXACT + 2))
    for size in range(2, EXACT + 1):
        k = small[edges[size - 2] : edges[size - 1]]
        block = (1 << 18) // size  # bounds the matrices below
        for i in range(0, len(k), block):
            part = k[i : i + block]
            # weight of t tables: S(c, t) * prod_j (strength + d (others + j)) * base ** t
            j = np.arange(size)
            steps = np.log((strength + d * (others[part][:, None] + j)) * base[part][:, None])
            weight = np.cumsum(steps, 1) + STIRLING[level][size, 1 : size + 1]
            weight = np.exp(weight - weight.max(1, keepdims=True))
            total = np.cumsum(weight, 1)
            t[part] = 1 + (total < draw[part][:, None] * total[:, -1:]).sum(1)
    k = np.flatnonzero(c > EXACT)
    seated = np.ones(len(k))
    while len(k):
        a = (strength + d * (others[k] + t[k])) * base[k]
        with np.errstate(over="ignore"):
            wait = (a + seated - d * t[k]) * (rng.random(len(k)) ** (-1 / a) - 1)
        seated = seated + 1 + np.floor(wait)
        more = seated <= c[k]
        k, seated = k[more], seated[more]
        t[k] += 1
    return t


class Totals:
    """What one sweep leaves for all parts; bounded by contexts and heavy words."""

    def __init__(self, tables, heavy_customers, customers, roots) -> None:
        self.tables = tables  # per context class
        self.heavy_customers = heavy_customers  # of the unigram restaurant
        self.customers = customers
        self.roots = roots  # tables of the unigram restaurant


def _unpacked(row: dict) -> dict:
    """A row of the model for ``Part``."""
    kinds = {"words": np.uint64, "word_keys": np.uint32, "contexts": np.uint16, "train": np.uint32}
    return row | {c: unpack(row[c], kind) for c, kind in kinds.items()}


class Part:
    """The keys of a part and their seating, sweep by sweep."""

    def __init__(self, row: dict, model: dict) -> None:
        self.model = model
        self.number = row["part"]
        self.words = np.frombuffer(row["words"], np.uint64)
        keys = np.frombuffer(row["word_keys"], np.uint32).astype(np.int64)
        self.contexts = np.frombuffer(row["contexts"], np.uint16).astype(np.int64)
        self.c = np.frombuffer(row["train"], np.uint32).astype(np.int64)
        self.word = np.repeat(np.arange(len(self.words)), keys)
        self.starts = np.cumsum(keys) - keys
        heavy = model["heavy"]
        at = np.searchsorted(heavy, self.words)
        self.heavy = np.zeros(len(self.words), bool)
        if len(heavy):
            self.heavy = heavy[np.minimum(at, len(heavy) - 1)] == self.words
        self.heavy_at = at[self.heavy]
        self.count = self.word_sums(self.c)  # of heavy words only this part's
        self.tables = np.minimum(self.c, 1)
        self.customers = self.word_sums(self.tables)
        self.roots = np.minimum(self.customers, 1)

    def word_sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.starts) if len(x) else x

    def unigram(self, totals: Totals, heavy_roots: np.ndarray) -> np.ndarray:
        """The parent's predictive probability of each word of the part."""
        customers, roots = self.customers.copy(), self.roots.copy()
        customers[self.heavy] = totals.heavy_customers[self.heavy_at]
        roots[self.heavy] = heavy_roots[self.heavy_at]
        d, strength = DISCOUNTS[0], STRENGTHS[0]
        own = np.maximum(customers - d * roots, 0)
        return (own + (strength + d * totals.roots) * self.model["base"]) / (strength + totals.customers)

    def sweep(self, number: int, totals: Totals, heavy_roots: np.ndarray) -> None:
        """Seat every key anew given the totals of the sweep before."""
        rng = np.random.default_rng([self.number, number])
        base = self.unigram(totals, heavy_roots)[self.word]
        others = np.maximum(totals.tables[self.contexts] - self.tables, 0)
        self.tables = sample_tables(self.c, base, others, 1, rng)
        self.customers = self.word_sums(self.tables)
        others = np.maximum(totals.roots - self.roots, 0)
        self.roots = sample_tables(
            np.where(self.heavy, 0, self.customers),
            np.full(len(self.words), self.model["base"]),
            others,
            0,
            rng,
        )

    def predict(self, totals: Totals, heavy_roots: np.ndarray) -> np.ndarray:
        """Probability of each key's word in its context."""
        d, strength = DISCOUNTS[1], STRENGTHS[1]
        parent = self.unigram(totals, heavy_roots)[self.word]
        own = np.maximum(self.c - d * self.tables, 0)
        tables = totals.tables[self.contexts]
        customers = self.model["context_customers"][self.contexts]
        return (own + (strength + d * tables) * parent) / (strength + customers)


SUMS = "tables array<long>, counts array<long>, heavy array<long>, heavy_counts array<long>, customers long, roots long, train long, known long"
KEY_COLUMNS = ["part", "words", "word_keys", "contexts", "train"]


def _sum_parts(model: dict, history: list[tuple[Totals, np.ndarray]]):
    """Totals of each task's parts, in one row, after the sweeps that ``history`` starts."""

    def run(batches):
        light = np.zeros(4, np.int64)
        heavy = np.zeros((2, len(model["heavy"])), np.int64)
        contexts = np.zeros((2, CONTEXTS), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                part = Part(_unpacked({c: batch.column(c)[i].as_py() for c in KEY_COLUMNS}), model)
                for number, (totals, heavy_roots) in enumerate(history):
                    part.sweep(number, totals, heavy_roots)
                some = ~part.heavy
                np.add.at(heavy[0], part.heavy_at, part.customers[part.heavy])
                np.add.at(heavy[1], part.heavy_at, part.count[part.heavy])
                contexts[0] += np.bincount(part.contexts, part.tables, CONTEXTS).astype(np.int64)
                if not history:
                    contexts[1] += np.bincount(part.contexts, part.c, CONTEXTS).astype(np.int64)
                light += [
                    part.customers[some].sum(),
                    part.roots[some].sum(),
                    part.c.sum(),
                    (part.count[some] > 0).sum(),
                ]
        values = [contexts[0], [] if history else contexts[1], heavy[0], heavy[1], *light.tolist()]
        kinds = [pa.list_(pa.int64())] * 4 + [pa.int64()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], k) for v, k in zip(values, kinds, strict=True)],
            names=[c.split()[0] for c in SUMS.split(", ")],
        )

    return run


def _array_sums(sums: DataFrame, column: str, n: int) -> np.ndarray:
    """Elementwise sum of an array column of length ``n``, a bounded number of rows."""
    rows = (
        sums.select(F.posexplode(column).alias("i", "v")).where("v != 0").groupBy("i").agg(F.sum("v").alias("v"))
    ).toArrow()
    out = np.zeros(n, np.int64)
    if rows.num_rows:
        out[rows.column("i").to_numpy()] = rows.column("v").to_numpy()
    return out


def train(keys: DataFrame, heavy: np.ndarray) -> tuple[dict, list[tuple[Totals, np.ndarray]]]:
    """The model's constants and the totals before each sweep and after the last."""
    model = {"heavy": heavy, "base": 1.0, "context_customers": np.zeros(CONTEXTS)}
    history: list[tuple[Totals, np.ndarray]] = []
    for number in range(BURN_IN + SAMPLES + 1):
        sums = settle(keys.mapInArrow(_sum_parts(model, history), SUMS))
        light = sums.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("customers", "roots", "train", "known"))).first()
        heavy_customers = _array_sums(sums, "heavy", len(heavy))
        if not number:
            heavy_counts = _array_sums(sums, "heavy_counts", len(heavy))
            known = light.known + int((heavy_counts > 0).sum())
            model |= {
                "base": 1 / (known + 1),
                "context_customers": _array_sums(sums, "counts", CONTEXTS),
                "heavy_counts": heavy_counts,
                "train_tokens": light.train,
                "known": known,
            }
        if number:
            before, roots = history[-1]
            heavy_roots = sample_tables(
                heavy_customers,
                np.full(len(heavy), model["base"]),
                np.maximum(before.roots - roots, 0),
                0,
                np.random.default_rng([1 << 31, number]),
            )
        else:
            heavy_roots = np.minimum(heavy_customers, 1)
        totals = Totals(
            _array_sums(sums, "tables", CONTEXTS),
            heavy_customers,
            light.customers + int(heavy_customers.sum()),
            light.roots + int(heavy_roots.sum()),
        )
        history.append((totals, heavy_roots))
        discard(sums)
    return model, history


SCORES = "part long, chunk long, counts binary, scores binary"


def _score_part(model: dict, history: list[tuple[Totals, np.ndarray]]):
    """For each chunk the counts of its words in a part and the scores of its keys."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                part = Part(_unpacked(r), model)
                mean = np.zeros(len(part.c))
                for number in range(len(history)):
                    totals, heavy_roots = history[number]
                    if number > BURN_IN:
                        mean += part.predict(totals, heavy_roots)
                    if number + 1 < len(history):
                        part.sweep(number, totals, heavy_roots)
                score = np.log10(mean / (len(history) - 1 - BURN_IN))
                count = part.count.copy()
                count[part.heavy] = model["heavy_counts"][part.heavy_at]
                steps = unpack(r["key_index"], np.uint32)
                numbers, sizes = unpack(r["chunks"], np.int64).reshape(2, -1)
                ends = np.cumsum(sizes)
                for chunk, end, size in zip(numbers.tolist(), ends.tolist(), sizes.tolist(), strict=True):
                    k = np.cumsum(steps[end - size : end], dtype=np.int64)
                    word = part.word[k]
                    own = word[np.flatnonzero(np.diff(word, prepend=-1))]
                    yield _row(SCORES, part=part.number, chunk=chunk, counts=count[own], scores=score[k])

    return run


RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double"
)


def _add_up(train_tokens: int, known: int):
    """The rows of a chunk's documents, from the answers of all parts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["ids"].notna()].iloc[0]
        ids, sizes = unpack(head.ids, np.int64), unpack(head.sizes, np.int64)
        docs, n = unpack(head.docs, np.uint16), unpack(head.n, np.uint32)
        word_keys = unpack(head.word_keys, np.uint32)
        # in the order of the chunk's keys, so that sums of doubles agree between runs
        cells = pdf[pdf["part"].notna()].sort_values("part")
        count = np.concatenate([unpack(b, np.int64) for b in cells["counts"]])
        score = np.concatenate([unpack(b, np.float64) for b in cells["scores"]])

        def per_doc(keys: np.ndarray) -> np.ndarray:
            return np.bincount(docs, np.repeat(keys, n), len(ids))

        base = per_doc(np.repeat(np.log10(count + 0.5), word_keys))
        out = pd.DataFrame(
            {
                "doc_id": pd.array(ids, "Int64"),
                "held_out": unpack(head.held, bool),
                "n_tokens": sizes,
                "n_known": per_doc(np.repeat(count > 0, word_keys)).astype(np.int64),
                "train_tokens": train_tokens,
                "base_score": base - sizes * np.log10(train_tokens + 0.5 * (known + 1)),
                "score": per_doc(score),
            }
        )
        out.loc[unpack(head.nulls, bool), "doc_id"] = pd.NA
        return out

    return run


def part_count(size: int) -> int:
    return max(1 + size // PART_BYTES, min(1 + size // SMALL_PART_BYTES, SMALL_PARTS))


def score_texts(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row (``RESULT``) per document; train_tokens is the number of training tokens.

    ``parts``: in how many parts the words are dealt out, by default ``part_count`` of the
    bytes of text; a part should fit in a task.
    """
    spark = docs.sparkSession
    short_batches(spark)
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = part_count(size)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    heavy = heavy_words(docs, parts)
    model_table = settle(
        docs.mapInArrow(_count_chunks(heavy, parts), COUNTED)
        .groupBy("part")
        .applyInPandas(_merge_part, MODEL)
    )
    keys = model_table.where(F.col("part") >= 0)
    model, history = train(keys.select(KEY_COLUMNS), heavy)
    answers = keys.select(*KEY_COLUMNS, "chunks", "key_index").mapInArrow(_score_part(model, history), SCORES)
    chunks = model_table.where(F.col("part") < 0).select(CHUNK_COLUMNS)
    gathered = answers.unionByName(chunks, allowMissingColumns=True)
    return gathered.groupBy("chunk").applyInPandas(_add_up(model["train_tokens"], model["known"]), RESULT)
