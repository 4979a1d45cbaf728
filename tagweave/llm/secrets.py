"""Secret scan with structural confirmation.

Base spans come from three patterns. In addition, candidates that could hide a secret are
decoded and reported only if their inside has the structure of one:

* ``token``: three dot-joined base64url parts whose first decodes to a JSON object that
  names an algorithm (``alg``) and whose second decodes to a JSON object;
* ``key``: base64 (also in an armoured block over several lines) or hex that decodes to a private key, either
  nested tag-length-value data that fill the value exactly and start with a version number, or the
  length-prefixed fields of the ``openssh-key-v1`` encoding.

Spans count code points, end exclusive. Each text is scanned whole, in one pass and without
a shuffle; cheap tests of the bytes decide which patterns run at all. Null and empty
texts have no spans; repeated rows, null ids and other columns do not matter.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import by_rows, short_batches

KINDS = ("assign", "access", "hex", "token", "key")
Span = tuple[int, int, int]  # start, index of kind, end

ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*)")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){20,}(?![0-9A-Fa-f])")
ARMOUR = re.compile(
    r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----"
)
WORDS = ("passw", "secret", "token", "api")


def _marks(alphabet: bytes) -> bytes:
    return bytes(1 if b in alphabet else 0 for b in range(256))


_HEX_MARKS = _marks(b"0123456789abcdef")
_CODE_MARKS = _marks(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
)


def unbase64(text: str) -> bytes | None:
    """Either alphabet, with or without padding."""
    text = re.sub(r"\s+", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def tlv(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag-length-value items that fill ``data`` exactly, else None."""
    items, i = [], 0
    while i < len(data):
        if i + 2 > len(data):
            return None
        tag, n = data[i], data[i + 1]
        i += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or i + k > len(data):
                return None
            n = int.from_bytes(data[i : i + k], "big")
            i += k
        if i + n > len(data):
            return None
        items.append((tag, data[i : i + n]))
        i += n
    return items


def is_private_key(data: bytes | None) -> bool:
    """Whether nested lengths and field types are those of a private key."""
    if not data or len(data) < 20:
        return False
    magic = b"openssh-key-v1\0"
    if data.startswith(magic):
        i = len(magic)
        for _ in range(3):  # cipher, key derivation, its options
            n = int.from_bytes(data[i : i + 4], "big")
            i += 4 + n
            if i + 4 > len(data):
                return False
        return 1 <= int.from_bytes(data[i : i + 4], "big") <= 16
    outer = tlv(data)
    if outer is None or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = tlv(outer[0][1])
    if not inner or inner[0][0] != 0x02 or inner[0][1] not in (b"\0", b"\1"):
        return False
    tags = [t for t, _ in inner]
    if tags[1:] and all(t == 0x02 for t in tags[1:]):
        return len(tags) >= 6  # version and the numbers of the key
    if len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:
        algorithm = tlv(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return len(tags) >= 2 and tags[1] == 0x04 and tags[2:] in ([], [0xA0], [0xA1], [0xA0, 0xA1])


def is_signed_token(header: str, body: str) -> bool:
    parts = []
    for part in (header, body):
        raw = unbase64(part)
        try:
            parts.append(json.loads(raw) if raw else None)
        except (ValueError, RecursionError):
            return False
    return all(isinstance(p, dict) for p in parts) and isinstance(parts[0].get("alg"), str)


def base_spans(text: str, data: bytes) -> list[Span]:
    spans: list[Span] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if b"\1" * 24 in data.translate(_HEX_MARKS):
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return spans


def confirmed_spans(text: str, data: bytes) -> list[Span]:
    """Spans that decoding confirms."""
    spans: list[Span] = []
    if "." in text and "eyJ" in text or "ewo" in text:
        spans += [
            (m.start(), 3, m.end()) for m in SIGNED.finditer(text) if is_signed_token(m[1], m[2])
        ]
    if "PRIVATE KEY-----" in text:
        spans += [
            (m.start(), 4, m.end()) for m in ARMOUR.finditer(text) if is_private_key(unbase64(m[2]))
        ]
    if b"\1" * 40 in data.translate(_CODE_MARKS):
        for pattern, decode in ((BASE64, unbase64), (ANY_HEX, bytes.fromhex)):
            for m in pattern.finditer(text):
                inside = any(s <= m.start() and m.end() <= e for s, k, e in spans if k >= 3)
                if not inside and is_private_key(decode(m[0])):
                    spans.append((m.start(), 4, m.end()))
    return spans


def joined(spans: list[Span], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
    "n_token long, n_key long, spans string"
)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row (``SCHEMA``) per document; counts are of base spans, and of confirmed ones."""
    short_batches(docs.sparkSession)
    schema = pa.schema(
        [
            (name, pa.string() if kind == "string" else pa.int64())
            for name, kind in (c.split() for c in SCHEMA.split(", "))
        ]
    )

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in schema.names}
        for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            data = text.encode("utf-8", "replace")
            base = base_spans(text, data)
            spans = base + confirmed_spans(text, data)
            out["doc_id"].append(doc)
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(sum(s[1] == k for s in spans))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
        return out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(by_rows(rows, schema), SCHEMA)
