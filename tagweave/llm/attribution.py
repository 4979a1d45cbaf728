"""Token counts per section, from one encoding of the whole document.

A text is encoded once. The bytes of its tokens follow one another, so each token has a span;
sections have spans too, and tokens are joined to sections by interval. A token that touches
several sections goes to the one that holds most of its bytes; of equals, to the first.
It counts as crossing there. Bytes outside all sections count for section -1.

Sections are the lines of the text, each with its newline, or what the column named by the
parameter ``sections`` holds: an array of (start, end) in code points. Ends beyond the text
are cut back to it, null sections and null bounds are left out, sections are sorted by start, and
where two overlap the later one begins at the end of the earlier one. A null or empty text has
one empty section with no tokens (none where a given array is null or empty). Repeated rows are
counted one by one, null ids pass through, empty tables give empty results; other columns,
whatever their names, do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import by_rows, short_batches
from tagweave.llm.encoding import Encoder, default_path

SCHEMA = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("section", pa.int32()),
        ("start", pa.int64()),
        ("end", pa.int64()),
        ("n_tokens", pa.int64()),
        ("n_crossing", pa.int64()),
    ]
)


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of lines in code points; each line holds its newline."""
    lengths = np.array([len(x) + 1 for x in text.split("\n")], np.int64)
    lengths[-1] -= 1
    ends = np.cumsum(lengths)
    return ends - lengths, ends


def attribute(
    token_bytes: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (-1: none) and whether it crosses, all in bytes."""
    stop = np.cumsum(token_bytes)
    begin = stop - token_bytes
    low = np.searchsorted(ends, begin, "right")  # first section that ends later
    high = np.searchsorted(starts, stop, "left") - 1  # last section that starts earlier
    section = np.where(high >= low, low, -1)
    crossing = np.zeros(len(stop), bool)
    for t in np.flatnonzero(high > low).tolist():
        k = np.arange(low[t], high[t] + 1)
        share = np.minimum(ends[k], stop[t]) - np.maximum(starts[k], begin[t])
        section[t] = k[int(np.argmax(share))]
        crossing[t] = (share > 0).sum() > 1
    return section, crossing


def given_spans(sections: list | None, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, disjoint starts and ends inside the text."""
    bounds = [tuple(s.values())[:2] for s in sections or [] if s is not None]
    spans = np.array(sorted(b for b in bounds if None not in b), np.int64).reshape(-1, 2)
    ends = np.maximum.accumulate(np.clip(spans[:, 1], 0, length)) if len(spans) else spans[:, 1]
    starts = np.clip(spans[:, 0], 0, length)
    starts = np.maximum(starts, np.append(0, ends[:-1])[: len(starts)])
    return starts, np.maximum(starts, ends)


def token_counts(docs: DataFrame, path: str | None = None, sections: str | None = None) -> DataFrame:
    """One row per section (``SCHEMA``); section -1 only where it has tokens."""
    path = path or default_path()
    short_batches(docs.sparkSession)
    given = sections is not None

    def rows(batch: pa.RecordBatch) -> dict:
        encoder = Encoder.of(path)
        parts = [[] for _ in _ARROW]
        columns = [c.to_pylist() for c in batch.columns]
        for doc, text, *more in zip(*columns, strict=True):
            text = text or ""
            if given:
                starts, ends = given_spans(more[0], len(text))
            else:
                starts, ends = line_spans(text)
            sizes = encoder.lengths[encoder.encode(text)]
            b0, b1 = starts, ends
            if not text.isascii():
                raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
                at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                b0, b1 = at[starts], at[ends]
            section, crossing = attribute(sizes, b0, b1)
            n = np.bincount(section + 1, minlength=len(starts) + 1)
            x = np.bincount(section[crossing] + 1, minlength=len(starts) + 1)
            out = 0 if n[0] else 1
            k = np.arange(-1, len(starts))[out:]
            parts[0] += [doc] * len(k)
            for column, values in zip(
                parts[1:],
                (k, np.append(0, starts)[out:], np.append(len(text), ends)[out:], n[out:], x[out:]),
                strict=True,
            ):
                column += values.tolist()
        return dict(zip(_ARROW.names, parts, strict=True))

    cols = [F.col("doc_id").cast("long"), "text", *([sections] if given else [])]
    return docs.select(*cols).mapInArrow(by_rows(rows, _ARROW), SCHEMA)
