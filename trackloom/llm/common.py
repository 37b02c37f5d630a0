"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a maximal run of characters outside this class: space and the ASCII controls tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
BLANKS = "\t\n\x0b\x0c\r "

_MASK = (1 << 64) - 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fields(schema: StructType, ddl: str) -> StructType:
    """A schema with further fields, written as DDL, at its end."""
    return StructType(schema.fields + StructType.fromDDL(ddl).fields)


def words_of(text: Column) -> Column:
    """The words of a text as an array, null counting as an empty text."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(spaced, " "), "")


#: Bytes and rows of an Arrow batch of documents. Texts are long, so that Spark's default of 10,000 rows may be tens of MB,
#: which then lie in the JVM, in its direct memory and in the Python worker at once.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2000


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, for this session from now on; smaller settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = spark.conf.get(key, None)
        if now is None or not str(now).isdigit() or int(now) > most or int(now) <= 0:
            spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir. A temporary one only where that is unset on a single machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")

        folder = tempfile.mkdtemp(prefix="trackloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table once to the shared folder and read it back, so that later jobs neither repeat the work nor depend on any executor."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/trackloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by cut_lineage that no later step reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getName().startswith("trackloom-"):
                folder.getFileSystem(conf).delete(folder, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the public splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64))
_powers = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


class SpanHasher:
    """64-bit hashes of byte spans of one buffer: differences of a running polynomial sum, shifted to the origin and scrambled.

    Equal spans have equal hashes; different ones collide with a chance of about 2^-64 a pair.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(_BYTE_VALUES[data] * _power_table(_BASE, n), out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * _power_table(_BASE_INVERSE, len(self.sums))[starts]
        return mix64(raw + (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of some spans of a buffer, once (see SpanHasher)."""
    return SpanHasher(data)(starts, ends) if len(starts) else np.zeros(0, np.uint64)


def ragged_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices that gather many slices [start, start + length) in turn from one flat array."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - before, lengths)


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null is an empty text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(column) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))


def binary_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow binary column without nulls."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces_by_bytes(offsets: np.ndarray, most: int):
    """Cut rows into runs of at most `most` bytes (a longer row alone), as (first, last) row numbers."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, last
        first = last
