"""Helpers shared by the training-data operators: stored tables, hash folds, vectorised text bytes.

Texts reach Python as Arrow string arrays.  :func:`blocks` lays a slice of documents out as one
``uint8`` array with a newline after every document, so that word boundaries, word hashes and
character n-gram hashes of many documents are a few numpy passes over the bytes.  A block holds
about ``BLOCK_BYTES`` of text (or one longer document), which bounds a task's memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varietas.session import ensure_checkpoint_dir

#: Characters between words in every contract: space and tab to carriage return.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
BLOCK_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file in the installed ``public_tokenizers`` package."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32(doc_id as text) mod n: the fold a document belongs to."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % n


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    The stored table has no lineage to recompute when an executor is lost, and its real size is
    known to the planner, which then decides broadcasts from it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Broadcast hint for a table whose row count is checked to be at most ``rows``; else the table as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def word_count(text: str | Column = "text") -> Column:
    """Number of words of a text (null: 0), without splitting it into an array."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def unit_hash(*parts) -> Column:
    """Uniform in [0, 1) from 12 hex digits of md5 over the parts (columns or literals), joined by ':'."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """splitmix64 finaliser of a uint64 array (a new array)."""
    z = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


_BYTE_CODE = mix(np.arange(256, dtype=np.uint64), 77)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[32, 9, 10, 11, 12, 13]] = True
_powers = {"pow": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["pow"]) < n:
        size = max(n, 2 * BLOCK_BYTES)
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("pow", _BASE), ("inv", inverse)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=np.uint64)
    return _powers["pow"][:n], _powers["inv"][:n]


class Bytes:
    """Bytes of a run of documents (a newline after each) with the offsets where documents start."""

    def __init__(self, data: np.ndarray, doc_start: np.ndarray):
        self.data, self.doc_start, self.n_docs = data, doc_start, len(doc_start)
        self._prefix = None

    def lower_ascii(self) -> "Bytes":
        return Bytes(_LOWER[self.data], self.doc_start)

    def words(self, is_separator: np.ndarray = _IS_WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, document index) of every word."""
        sep = is_separator[self.data]
        edge = np.flatnonzero(np.diff(sep, prepend=True))      # every document ends in a separator
        start, end = edge[0::2], edge[1::2]
        return start, end, np.searchsorted(self.doc_start, start, "right") - 1

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes of each span; depends on the bytes alone, not on their place."""
        if self._prefix is None:
            power, _ = _power_tables(len(self.data))
            p = np.empty(len(self.data) + 1, np.uint64)
            p[0] = 0
            np.cumsum(_BYTE_CODE[self.data] * power, out=p[1:])
            self._prefix = p
        _, inverse = _power_tables(len(self.data))
        h = (self._prefix[end] - self._prefix[start]) * inverse[start]
        return mix(h + (end - start).astype(np.uint64))


def _string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Bytes]]:
    """Cut a string column into runs of documents of about ``size`` bytes: (first row, end row, bytes)."""
    offsets, data = _string_buffers(column)
    row, n = 0, len(column)
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(n, max(row + 1, end))
        lengths = np.diff(offsets[row:end + 1])
        k = end - row
        out = np.full(int(lengths.sum()) + k, 10, np.uint8)
        start = offsets[row:end] - offsets[row] + np.arange(k)
        keep = np.ones(len(out), bool)
        keep[start + lengths] = False
        out[keep] = data[offsets[row]:offsets[end]]
        yield row, end, Bytes(out, start)
        row = end


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` where ``fn(batch) -> dict of arrays`` handles one record batch at a time."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_arrays(
                    [v.cast(f.type) if isinstance(v := out[f.name], pa.Array) else pa.array(v, f.type) for f in arrow], schema=arrow)
    return df.mapInArrow(run, schema)
