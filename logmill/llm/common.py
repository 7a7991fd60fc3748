"""Small helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.session import shared_dir

__all__ = ["CHUNK_BYTES", "UPPER", "WORD", "bucket_of", "bytes_of", "chunks", "count_at_most", "lower_ascii", "shared_dir", "stored", "table", "unused", "with_results"]

#: Bytes of text that a task holds as numpy arrays at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word, wherever a contract says so: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, path: str) -> DataFrame:
    """Cut the lineage of df by writing it to path, a place in the shared folder, and reading it again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(name: str, df: DataFrame) -> str:
    """A name like this one that no column of df has."""
    while name in df.columns:
        name += "_"
    return name


def lower_ascii(c: Column | str) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def bucket_of(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets, without a copy; nulls are empty."""
    if pa.types.is_large_string(column.type) or column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows whose texts have at most so many bytes together, or one row each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def with_results(batch: pa.RecordBatch, drop: Iterable[str], add: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch without some columns, and with new ones behind."""
    gone = set(drop)
    keep = [k for k in batch.schema.names if k not in gone]
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *add.values()], names=[*keep, *add])


def count_at_most(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows; it never counts further than one row more."""
    return df.limit(most + 1).count() <= most
