"""What several operators share: words, hashes, chunks, shared storage, packed shuffles."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd 64-bit multipliers for combining word hashes (fixed values).
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


#: Rows of an Arrow batch: documents are long, and a batch is held whole on both sides of the pipe.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. Only a local session, whose machine is one, may go without: it gets a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = spark.sparkContext._jvm.System.getProperty("java.io.tmpdir") + "/marginalia-checkpoints"
    return where


def keep(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of df: write it as a table in the shared folder and read that."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def discard(*kept: DataFrame) -> None:
    """Delete tables of `keep` that nothing will read again; others are left alone."""
    for df in kept:
        if path := getattr(df, "_kept_at", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of a table that a join may broadcast. Spark judges a table by its files, and a hash table of a few columns takes several times their bytes.
BROADCAST_ROWS = 20_000


def side(df: DataFrame, rows: int) -> DataFrame:
    """df as a side of a join that is sorted and merged if the tables it comes from have many rows, so that the driver never holds it."""
    return df.hint("merge") if rows > BROADCAST_ROWS else df


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of plans that nothing refers to any more, rather than when the driver next collects garbage.

    Python tells the JVM of dropped plans a moment later, hence two rounds.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; bytes.lower and bytes.split do just that."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Hashes(dict):
    """64-bit hashes of words, remembered up to a limit."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), U64, len(ws))


def text_chunks(batches: Iterator[pa.RecordBatch], cols: list[str], most: int = 2_000_000) -> Iterator[list[list]]:
    """Rows of Arrow batches as one list a column, in chunks of about `most` bytes of the first column, in order."""
    held: list[list] = [[] for _ in cols]
    size = 0
    for batch in batches:
        rows = batch.num_rows
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(cols[0]))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        start, base = 0, 0
        while start < rows:
            stop = min(rows, int(np.searchsorted(ends, base + most - size, "left")) + 1)
            part = batch.slice(start, stop - start)
            for to, c in zip(held, cols):
                to.extend(part.column(part.schema.get_field_index(c)).to_pylist())
            size += int(ends[stop - 1]) - base
            start, base = stop, int(ends[stop - 1])
            if size >= most:
                yield held
                held, size = [[] for _ in cols], 0
    if held[0]:
        yield held
    trim()


def trim() -> None:
    """Give freed memory back to the system: a worker process goes on to other tasks, beside others of its kind."""
    free_memory = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free_memory:
        free_memory(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> U64(31))
    x = x * U64(MIX[0])
    x = x ^ (x >> U64(29))
    x = x * U64(MIX[1])
    return x ^ (x >> U64(32))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, or of the whole when there are fewer; none for no words."""
    n = len(h)
    if n == 0:
        return h
    if n < k:
        return np.array([xxhash.xxh64_intdigest(h.tobytes())], U64)
    out = h[: n - k + 1].copy()
    for i in range(1, k):
        out = mix64(out * U64(MIX[i % 4]) + h[i : n - k + 1 + i])
    return out


# --- packed shuffles -------------------------------------------------------
# Tens of millions of small records (hash keys with a position) go through a
# shuffle as one compressed blob for each map chunk and shard, and are sorted
# there with numpy. A shard is a hash range of the keys, so its size is the
# input's divided by their number, whatever the keys are.

PACKED = "shard int, blob binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays to bytes; bytes of equal significance stand together, which compresses well."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"" for a in arrays)
    return len(head).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(head + body)


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    raw = zstandard.ZstdDecompressor().decompress(blob[4:])
    out, at = [], n
    for kind, count in (x.split(",") for x in raw[:n].decode().split(";")):
        t, c = np.dtype(kind), int(count)
        size = t.itemsize * c
        out.append(np.frombuffer(raw, np.uint8, size, at).reshape(t.itemsize, c).T.copy().view(t).reshape(c) if c else np.zeros(0, t))
        at += size
    return out


def by_shard(shard: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each shard that has any, in their order."""
    order = np.argsort(shard.astype(np.uint16 if n < 65536 else np.uint32), kind="stable")
    dealt = shard[order]
    starts = np.flatnonzero(np.r_[True, dealt[1:] != dealt[:-1]]) if len(dealt) else np.zeros(0, np.int64)
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(dealt)]):
        yield int(dealt[lo]), order[lo:hi]
