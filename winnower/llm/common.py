"""Helpers shared by the training-data operators: shared scratch tables and byte-level word scanning."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.shuffleDependency.fileCleanup.enabled"
REST = "_rest"
SLICE_ROWS = 4000

_local_base: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; where the session names none, a temporary one on a single machine only."""
    global _local_base
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    if _local_base is None:
        _local_base = "file://" + tempfile.mkdtemp(prefix="winnower-")
    return _local_base


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside go as soon as the action is done; the session's own setting comes back."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def new_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/winnower/{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage and survives lost executors.

    The shuffle files of a step go once its table is written.
    """
    spark = df.sparkSession
    path = f"{folder or new_folder(spark)}/{name}"
    with released(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str, *names: str) -> None:
    """Deletes tables that no later step reads."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def carried(docs: DataFrame, *used: str) -> DataFrame:
    """The used columns, and all others as one struct REST, so that no name of theirs meets one of an operator's own."""
    others = [c for c in docs.columns if c.lower() not in used]
    rest = F.struct(*(F.col(quoted(c)) for c in others)) if others else F.lit(None).cast("string")
    return docs.select(*(F.col(c).alias(c) for c in used), rest.alias(REST))


def restored(df: DataFrame, docs: DataFrame, used: Sequence[str], changed: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """The columns of docs in their order and with their types; changed makes new values from old ones, by lower-case name."""
    columns = []
    for f in docs.schema.fields:
        old = F.col(f.name.lower() if f.name.lower() in used else f"{REST}.{quoted(f.name)}")
        new = changed.get(f.name.lower())
        columns.append((old if new is None else new(old).cast(f.dataType)).alias(f.name))
    return df.select(*columns)


def stored_place(docs: DataFrame) -> Column | None:
    """A hash of the file and the row that a row is read from, the same however a reading is split; None if docs isn't read from files."""
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    try:
        docs.select(place)
    except AnalysisException:
        return None
    return place


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32(doc_id as text) mod modulus is remainder; false for a null id."""
    crc = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    return F.coalesce(crc % F.lit(modulus) == F.lit(remainder), F.lit(False))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts on end, and their offsets (one more than texts). Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_runs(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of member bytes within each text: starts, ends and the number of the text."""
    empty = np.zeros(0, np.int64)
    if not data.size:
        return empty, empty, empty
    inside = member[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < data.size]
    before[firsts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    after[lasts] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of bytes."""
    h = np.full(len(starts), np.uint64(0x9E3779B97F4A7C15 ^ seed), np.uint64)
    size = ends - starts
    live, k = np.flatnonzero(size > 0), 0
    while live.size:
        h[live] = (h[live] ^ data[starts[live] + k]) * np.uint64(0x100000001B3)
        h[live] ^= h[live] >> np.uint64(29)
        k += 1
        live = live[size[live] > k]
    return mix(h)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def group_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups that begin at starts; an empty group is 0."""
    bounds = np.append(starts, len(values))
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def byte_slices(batch: pa.RecordBatch, column: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of at most limit bytes of text and SLICE_ROWS rows, or one row; bounds what numpy holds at once."""
    if batch.num_rows <= 1:
        if batch.num_rows:
            yield batch
        return
    give_back()
    size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > first and (total + n > limit or i - first == SLICE_ROWS):
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    yield batch.slice(first)


def give_back() -> None:
    """Returns freed memory to the system, as a worker that stays alive would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)
