"""Shared pieces of the corpus operators: shared-folder tables and a vectorised word scanner.

The scanner works on the value buffer of an Arrow string column, so a text never becomes a Python
object. Its memory is bounded by ``CHUNK_BYTES`` or the longest single text, whichever is larger.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that the scanner holds at once.
CHUNK_BYTES = 1 << 20
#: A key with more than one row in so many is hot, and is dealt over so many tasks.
HOT_SHARE, SALTS = 1000, 64
#: The white space of the word definitions: space and tab to carriage return.
SPACES = b" \t\n\x0b\x0c\r"

WHITE = np.zeros(256, bool)
WHITE[list(SPACES)] = True

U64 = np.uint64


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``, or a temporary one in local mode where unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomwright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return reread(df.sparkSession, df.schema, path)


def reread(spark: SparkSession, schema: str | StructType, path: str) -> DataFrame:
    return _remembered(spark.read.schema(schema).parquet(path), path)


def _remembered(df: DataFrame, path: str) -> DataFrame:
    df._loomwright_path = path
    return df


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing lazy still reads, and drop their names."""
    for df in tables:
        if df is not None:
            if getattr(df, "_loomwright_table", None):
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._loomwright_table}")
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._loomwright_path)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now. It does so when their plans are collected as garbage,
    which on a driver with little to do may be long after the last read. The plan that ran last is held until another
    one runs, so one without data does."""
    spark.range(1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Like ``written``, in buckets by ``keys``: later joins on the keys don't move these rows again."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table, path = f"{name}_{uuid.uuid4().hex}", new_path(spark, name)
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    found = _remembered(spark.table(table), path)
    found._loomwright_table = table
    return found


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], n_col: str, total: int, how: str = "inner") -> DataFrame:
    """Join rows to ``right`` (one row per key, with ``n_col``, the number of left rows of the key).

    Keys with more than a ``1 / HOT_SHARE`` of all ``total`` left rows are dealt over ``SALTS`` tasks. There are at most
    ``HOT_SHARE`` such keys, whatever the input, so their list can be broadcast.
    """
    hot = right.where(F.col(n_col) * HOT_SHARE > F.lit(total)).select(*[F.col(k).alias(f"__{k}") for k in keys])
    hot = F.broadcast(hot.limit(HOT_SHARE).withColumn("__hot", F.lit(True)))  # no more exist
    marked = lambda df: df.join(hot, [df[k] == hot[f"__{k}"] for k in keys], "left").drop(*[f"__{k}" for k in keys])
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = marked(left).withColumn("__salt", salt).drop("__hot")
    right = marked(right).withColumn("__salt", F.explode(salts)).drop("__hot")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def one_of_each(df: DataFrame, keys: list[Column], order: Column) -> DataFrame:
    """Of rows with equal keys the one that comes first in that order. Rows meet in a partial aggregate, not in a sort."""
    names = df.columns
    first = F.min_by(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]), F.struct(order.isNotNull(), order))  # null first
    best = df.groupBy(*[c.alias(f"__k{k}") for k, c in enumerate(keys)]).agg(first.alias("best"))
    return best.select(*[F.col(f"best.c{k}").alias(c) for k, c in enumerate(names)])


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def byte_values(seed: int) -> np.ndarray:
    """256 seeded 64-bit values."""
    return mix64(np.arange(256, dtype=U64) + U64((seed * 1000 + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


#: Spans longer than this are hashed by BLAKE2 one by one, shorter ones together, eight bytes at a time.
LONG_SPAN = 256
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The first 0 to 8 bytes of an eight-byte lane.
FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)


class Texts:
    """Some consecutive texts of a batch: ``data`` (their bytes) and ``offsets`` (one more than texts)."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.n = len(offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each word ``[^\\x20\\x09-\\x0D]+``, in order."""
        white = WHITE[self.data]
        start, end = np.empty(len(white), bool), np.empty(len(white), bool)
        if len(white):
            start[0], end[-1] = True, True
            start[1:], end[:-1] = white[:-1], white[1:]
            inner = self.offsets[(self.offsets > 0) & (self.offsets < len(white))]
            start[inner], end[inner - 1] = True, True
        start &= ~white
        end &= ~white
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        return s, e, np.searchsorted(self.offsets, s, "right") - 1

    def lanes(self, lower: bool = False) -> np.ndarray:
        """The eight bytes from each place on, as integers; zeros follow the last byte. With ``lower``, A-Z count as a-z."""
        padded = np.zeros(len(self.data) + 16, np.uint8)
        padded[: len(self.data)] = LOWER[self.data] if lower else self.data
        return np.ndarray(len(self.data) + 8, "<u8", padded, strides=(1,))

    def hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int, lower: bool = False) -> np.ndarray:
        """A seeded 64-bit hash of the bytes in each span.

        Lanes of eight bytes are mixed in one after another, so spans of eight bytes or less get hashes of their own
        among spans of their length, and no two texts are equal for every seed.
        """
        length = ends - starts
        lanes = self.lanes(lower)
        salt = U64((seed * 0xD6E8FEB86659FD93 + 0x9E3779B97F4A7C15) % (1 << 64))
        h = mix64(length.astype(U64) + salt)
        rows = np.flatnonzero((length > 0) & (length <= LONG_SPAN))
        k = 0
        while len(rows):
            left = length[rows] - k
            lane = lanes[starts[rows] + k] & FIRST_BYTES[np.minimum(left, 8)]
            h[rows] = mix64((h[rows] ^ lane) * U64(0x9FB21C651E98DF25) + salt)
            k += 8
            rows = rows[left > 8]
        for i in np.flatnonzero(length > LONG_SPAN).tolist():
            own = self.data[starts[i] : ends[i]]
            found = hashlib.blake2b((LOWER[own] if lower else own).tobytes(), digest_size=8, salt=seed.to_bytes(8, "little"))
            h[i] = U64(int.from_bytes(found.digest(), "little"))
        return h

    def same(self, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, lower: bool = False) -> np.ndarray:
        """Which spans have the bytes of the spans of their length that start at ``others``."""
        length = ends - starts
        lanes = self.lanes(lower)
        equal = np.ones(len(starts), bool)
        rows = np.flatnonzero((length > 0) & (starts != others))
        k = 0
        while len(rows):
            left = length[rows] - k
            differ = (lanes[starts[rows] + k] ^ lanes[others[rows] + k]) & FIRST_BYTES[np.minimum(left, 8)]
            equal[rows[differ != 0]] = False
            k += 8
            rows = rows[(left > 8) & (differ == 0)]
        return equal

    def distinct(self, starts: np.ndarray, ends: np.ndarray, seed: int, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct spans: their hashes, one place of each, and for every span which it is. Bytes are compared, so
        that equal hashes don't make different spans one; should that happen, another seed tells them apart."""
        while True:
            found, first, which = np.unique(self.hashes(starts, ends, seed, lower), return_index=True, return_inverse=True)
            other = first[which]
            if ((ends - starts) == (ends - starts)[other]).all() and self.same(starts, ends, starts[other], lower).all():
                return found, first, which
            seed += 1000


def text_chunks(array: pa.Array) -> Iterator[Texts]:
    """Cut a string array (null: empty) into chunks of about ``CHUNK_BYTES``; longer texts come alone."""
    if array.null_count:
        array = array.fill_null("")
    if not len(array):
        return
    width = np.int64 if pa.types.is_large_string(array.type) else np.int32
    _, offsets, values = array.buffers()
    offsets = np.frombuffer(offsets, width)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    k = 0
    while k < len(array):
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + CHUNK_BYTES, "right")) - 1)
        yield Texts(k, data[offsets[k] : offsets[stop]], offsets[k : stop + 1] - offsets[k])
        k = stop
    return_memory()


def return_memory() -> None:
    """Give freed pages back to the system, as a worker lives on between tasks beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, so that extra ones, of whatever name, can't clash with those added."""
    return df.select(*[F.col(f"`{n}`") for n in names])
