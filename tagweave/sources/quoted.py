"""CSV files whose fields hold line breaks, read by many tasks.

A quoted line break looks like the end of a record, so such a file cannot be cut at any line.
But a byte is inside quotes if and only if an odd number of quotes stands before it (a quote
within a field is doubled, and only quoted fields hold quotes). One job counts the quotes of every byte
range, a running sum tells how each range begins, and a second job lets every range read the records that
start in it, the last one to its end beyond the range.
"""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.csv as pcsv
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 32 << 20
_STEP = 1 << 20
_QUOTE, _NEWLINE = b'"', ord("\n")
_BOM = b"\xef\xbb\xbf"
COUNTS = "file string, start long, stop long, quotes long"


class _Range(InputPartition):
    def __init__(self, file: str, start: int, stop: int, inside: bool = False) -> None:
        super().__init__((file, start))
        self.file, self.start, self.stop, self.inside = file, start, stop, inside


def _open(file: str) -> pa.NativeFile:
    store, path = pfs.FileSystem.from_uri(file)
    return store.open_input_file(path)


def record_ends(data: bytes, inside: bool) -> tuple[np.ndarray, bool]:
    """Places after each line break outside quotes, and whether ``data`` ends inside quotes."""
    if not data:
        return np.array([], np.int64), inside
    octets = np.frombuffer(data, np.uint8)
    odd = np.bitwise_xor.accumulate((octets == ord(_QUOTE)).view(np.uint8)) ^ np.uint8(inside)
    return np.flatnonzero((octets == _NEWLINE) & (odd == 0)) + 1, bool(odd[-1])


def _records(f: pa.NativeFile, part: _Range) -> bytes:
    """The bytes of all records that start in the range."""
    f.seek(part.start)
    data = f.read(part.stop - part.start)
    ends, inside = record_ends(data, part.inside)
    begin = 0
    if part.start:
        f.seek(part.start - 1)
        if part.inside or f.read(1) != b"\n":
            if not len(ends):
                return b""
            begin = int(ends[0])
    if begin == len(data) or (len(ends) and ends[-1] == len(data)):
        return data[begin:]
    pieces = [data[begin:]]
    f.seek(part.stop)
    while more := f.read(_STEP):
        ends, inside = record_ends(more, inside)
        if len(ends):
            pieces.append(more[: ends[0]])
            break
        pieces.append(more)
    return b"".join(pieces)


def _header(f: pa.NativeFile) -> tuple[list[str], int]:
    """The names of a file's first record, and where it ends."""
    f.seek(0)
    head, inside = b"", False
    while more := f.read(_STEP):
        ends, inside = record_ends(more, inside)
        if len(ends):
            head += more[: ends[0]]
            break
        head += more
    if not head.removeprefix(_BOM).strip():
        return [], len(head)
    table = pcsv.read_csv(io.BytesIO(head.removeprefix(_BOM)), parse_options=_parse())
    return table.column_names, len(head)


def _parse() -> pcsv.ParseOptions:
    return pcsv.ParseOptions(newlines_in_values=True, double_quote=True, ignore_empty_lines=True)


class _Reader(DataSourceReader):
    def __init__(self, schema, options) -> None:
        self.names = schema.fieldNames()
        self.counting = options["mode"] == "count"
        self.ranges = [_Range(*r) for r in json.loads(options["ranges"])]

    def partitions(self) -> list[_Range]:
        return self.ranges

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        with _open(partition.file) as f:
            if self.counting:
                yield self._count(f, partition)
                return
            names, end = _header(f)
            data = _records(f, partition)
        if not partition.start:
            data = data[end:]
        if not data.strip(b"\r\n"):
            return
        missing = [n for n in self.names if n not in names]
        if missing:
            raise ValueError(f"{partition.file} has no column {', '.join(missing)}")
        table = pcsv.read_csv(
            io.BytesIO(data),
            read_options=pcsv.ReadOptions(column_names=names, block_size=len(data) + 1),
            parse_options=_parse(),
            convert_options=pcsv.ConvertOptions(
                column_types=dict.fromkeys(names, pa.string()),
                include_columns=self.names,
                null_values=[""],
                strings_can_be_null=True,
                quoted_strings_can_be_null=False,
            ),
        )
        yield from table.to_batches(max_chunksize=10_000)

    def _count(self, f: pa.NativeFile, part: _Range) -> pa.RecordBatch:
        f.seek(part.start)
        left, quotes = part.stop - part.start, 0
        while left > 0 and (data := f.read(min(_STEP, left))):
            quotes += data.count(_QUOTE)
            left -= len(data)
        values = [[part.file], [part.start], [part.stop], [quotes]]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(values, [pa.string()] + [pa.int64()] * 3, strict=True)],
            names=["file", "start", "stop", "quotes"],
        )


class QuotedCsv(DataSource):
    """Byte ranges of CSV files; see :func:`read_quoted_csv`."""

    @classmethod
    def name(cls) -> str:
        return "tagweave_quoted_csv"

    def reader(self, schema) -> _Reader:
        return _Reader(schema, self.options)


def _files(path: str) -> list[tuple[str, int]]:
    """``(file, size)`` of a file, or of those in a folder whose names don't begin with ``_`` or ``.``."""
    if "://" not in path and not path.startswith("file:"):
        path = f"file://{os.path.abspath(path)}"
    store, place = pfs.FileSystem.from_uri(path)
    scheme = path[: len(path) - len(place)]
    info = store.get_file_info(place)
    if info.type == pfs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else store.get_file_info(pfs.FileSelector(place))
    return sorted((scheme + i.path, i.size) for i in found if i.is_file and i.base_name[0] not in "_.")


def quoted_csv_names(path: str) -> list[str]:
    """Column names of the first file that has any."""
    for file, _ in _files(path):
        with _open(file) as f:
            names, _ = _header(f)
        if names:
            return names
    return []


def read_quoted_csv(
    spark: SparkSession, path: str, columns: list[str] | None = None, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """The rows of a CSV file, or of a folder's files, all columns as strings.

    Files have a header each; columns are found by name. Fields may hold line breaks, commas and
    doubled quotes inside quotes. An empty field is null, an empty quoted one an empty text; blank lines
    are skipped; a file without rows gives none. A record with too few or too many fields is an
    error. ``path`` is a local path or a URI that Arrow's file systems know and that all executors
    see. A task holds one range and the rest of its last record.
    """
    spark.dataSource.register(QuotedCsv)
    columns = columns if columns is not None else quoted_csv_names(path)
    cuts = [
        (file, start, min(start + range_bytes, size))
        for file, size in _files(path)
        for start in range(0, size, range_bytes)
    ]

    def load(mode: str, schema: str, ranges: list) -> DataFrame:
        source = spark.read.format(QuotedCsv.name()).schema(schema)
        return source.options(mode=mode, ranges=json.dumps(ranges)).load()

    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    if not cuts:
        return spark.createDataFrame([], schema)
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begun = (
        load("count", COUNTS, cuts)
        .withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
        .select("file", "start", "stop", "inside")
    )
    # one row per range of the files
    return load("read", schema, [list(r) for r in sorted(begun.collect())])
