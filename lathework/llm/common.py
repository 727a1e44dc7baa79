"""Shared pieces of the corpus operators: shared-folder tables, Arrow views, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

#: Bytes of text that one kernel call looks at; bounds a Python worker's memory.
CHUNK_BYTES = 8 << 20

_own_folders: dict[str, str] = {}


def ready(df: DataFrame) -> SparkSession:
    """The session of ``df``, its executors supplied with this package; every operator begins with it."""
    return ship(df.sparkSession)


def fresh(df: DataFrame, *names: str) -> Callable[[str], str]:
    """Names for inner columns that none of ``df``'s columns has, in any case."""
    taken, prefix = {c.lower() for c in df.columns}, "_"
    while any(f"{prefix}{n}" in taken for n in names):
        prefix += "_"
    return lambda n: f"{prefix}{n}"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset and the master is local, as in tests, a temporary one of this application. On a
    cluster a machine-local folder would lose data, so there the setting is needed.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        name = spark.sparkContext.applicationId
        if name not in _own_folders:
            _own_folders[name] = "file://" + tempfile.mkdtemp(prefix="lathework-")
        folder = _own_folders[name]
    return folder.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lathework/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application's operators have written to the shared folder; their results can't be read afterwards."""
    remove(spark, _own_folder(spark))


def materialize(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives executors.

    The read table has a known size, so Spark's own threshold decides whether a join broadcasts it. The
    table of ``replaces``, a DataFrame that nothing reads any more, is deleted (if it came from here).
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if old := vars(replaces).get("_table_path") if replaces is not None else None:
        remove(df.sparkSession, old)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def dealt(df: DataFrame, column: str, parts: int) -> DataFrame:
    """Rows to ``parts`` partitions by a number in turn, so that near numbers never share one by chance."""
    return df.repartitionById(parts, F.pmod(F.col(column), F.lit(parts)).cast("int"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``new_path`` through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (bytes, offsets), nulls as empty; row i is bytes[offsets[i]:offsets[i+1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(off, off[start] + most, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """As ``chunks``, but small neighbours are joined up to ``most`` bytes first."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in chunks(batches, column, most):
        own = batch.column(columns_index(batch, column)).nbytes
        if held and size + own > most:
            yield joined(held)
            held, size = [], 0
        held.append(batch)
        size += own
    if held:
        yield joined(held)


def columns_index(batch: pa.RecordBatch, name: str) -> int:
    return batch.schema.get_field_index(name)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def docs_of(raw: np.ndarray, off: np.ndarray) -> Iterator[bytes]:
    """The rows of a byte view, one bytes object at a time."""
    view = memoryview(raw)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        yield bytes(view[a:b])


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of equal values in a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return starts, np.append(starts[1:], len(keys))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+length."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(before, lengths) + np.repeat(np.asarray(starts, np.int64), lengths)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals; touching ones become one."""
    if not len(starts):
        return np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    order = np.argsort(starts, kind="stable")
    s, e = np.asarray(starts, np.int64)[order], np.maximum.accumulate(np.asarray(ends, np.int64)[order])
    first = np.concatenate(([True], s[1:] > e[:-1]))
    at = np.flatnonzero(first)
    return s[at], e[np.append(at[1:] - 1, len(s) - 1)]


def mixed(x: np.ndarray, own: bool = False) -> np.ndarray:
    """SplitMix64 finaliser over uint64 arrays, in place if the array is the caller's ``own``."""
    if not own:
        x = np.array(x, np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, root)``; root is the smallest node.

    Alternating large-star and small-star rounds on the cluster. Every round is written to the shared
    folder, so no lineage grows and nothing is gathered on the driver but a count and a checksum.
    Nodes without an edge are not listed. Null or self edges are ignored.
    """
    spark = edges.sparkSession
    now = materialize(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        name,
    )
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(small_low, "a")
        small = linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_low.select("a", F.col("m").alias("b")))
        now = materialize(small.where("a <> b").distinct(), name, replaces=now)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


