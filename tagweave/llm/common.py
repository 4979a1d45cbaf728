"""What several operators of this subpackage need."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch holds, so that workers stay small on long texts.

    These are settings of the session and stay set.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8, A-Z in lower case."""
    return text.encode("utf-8", "replace").translate(LOWER).split() if text else []


def task_number() -> int:
    return TaskContext.get().partitionId()


def by_rows(make: Callable[[pa.RecordBatch], dict], schema: pa.Schema) -> Callable:
    """A ``mapInArrow`` function from one that turns a batch into columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = make(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema
            )

    return run
