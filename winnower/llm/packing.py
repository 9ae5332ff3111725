"""Packing tokenized documents into windows by best-fit decreasing.

A document's ids are cut into full windows and one rest. Best-fit decreasing depends on the lengths alone, so
it runs on their histogram, which has at most a row for each possible length: pieces of one length, longest
first, go to the tightest open window, which a segment tree over remaining capacities finds, and windows with
equal remaining capacity take pieces together. The outcome is a short list of runs (the n-th to m-th piece of a
length goes to these windows at this offset); each piece finds its own by its rank among pieces of its length.

Defined results: null and empty texts are the end id alone; pieces of equal length go by id, place and checksum,
and rows equal in all of those are interchangeable; every row's ids are packed, repeated rows too; an empty
table gives an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnower.llm.common import byte_slices, materialize, text_bytes

CAPACITY = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"
GENERATION = 400_000  # strings of a generation; a worker remembers two

_encoder: dict = {}


class CapacityTree:
    """A segment tree over remaining capacities: finds the smallest one, at least so large, that a window has."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, remaining: int, windows: int) -> None:
        node = remaining + self.leaves
        while node:
            self.open[node] += windows
            node //= 2

    def tightest(self, least: int) -> int | None:
        node = least + self.leaves
        if self.open[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs of (length, first rank, first window, pieces a window, offset) from the number of pieces of each length."""
    tree, groups = CapacityTree(capacity), {}
    runs, windows = [], 0

    def put(first: int, count: int, remaining: int) -> None:
        if count:
            groups.setdefault(remaining, []).append((first, count))
            tree.add(remaining, count)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, count = capacity, windows, -(-left // (capacity // length))
                windows += count
            else:
                first, count = groups[room].pop()
                tree.add(room, -count)
            each = room // length
            runs.append((length, rank, first, each, capacity - room))
            full = min(count, left // each)
            put(first, full, room - each * length)
            rank, left, first, count = rank + full * each, left - full * each, first + full, count - full
            if count and left:  # then fewer than a window takes
                put(first, 1, room - left * length)
                rank, left, first, count = rank + left, 0, first + 1, count - 1
            put(first, count, room)
    return runs


class Remembered:
    """Ids of strings as bytes, in two generations: strings that are used again move to the new one, the old one goes when that is full."""

    def __init__(self, tokenizer, generation: int = GENERATION) -> None:
        self.tokenizer, self.generation = tokenizer, generation
        self.new, self.old = {}, {}

    def ids(self, strings: list[str]) -> list[bytes]:
        if len(self.new) > self.generation:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        unknown = []
        for x in strings:
            if x not in new:
                if x in old:
                    new[x] = old[x]
                else:
                    unknown.append(x)
        for i in range(0, len(unknown), 50_000):
            part = unknown[i : i + 50_000]
            for x, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                new[x] = array("I", got.ids).tobytes()
        return [new[x] for x in strings]


def encoder(vocabulary: str) -> Remembered:
    """The tokenizer of this worker process with what it remembers."""
    if vocabulary not in _encoder:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        _encoder[vocabulary] = Remembered(Tokenizer.from_file(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)))
    return _encoder[vocabulary]


PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
LATIN = np.zeros(256, bool)
LATIN[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = True


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where a text can be cut without changing its ids.

    The tokenizer never joins white space to what is before it, nor a mark to a letter before it. So it is safe to
    cut before a space or line feed that follows a visible character, and before an ASCII mark that follows a
    letter. A byte from 0x80 counts as visible only after 0xC3 (a Latin letter or a sign), as other characters may
    be white space. Where a special token may occur, its marks are no cuts.
    """
    start = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        before, here = data[:-1], data[1:]
        visible = (before > 0x20) & (before < 0x7F)
        visible[1:] |= (before[1:] >= 0x80) & (data[:-2] == 0xC3)
        start[1:-1] = visible & ((here == 0x20) | (here == 0x0A))
        if not ((before == ord("<")) & (here == ord("|"))).any():
            start[1:-1] |= LATIN[before] & PUNCTUATION[here]
    start[offsets] = True
    start[-1] = False
    return np.flatnonzero(start)


def token_ids(texts: pa.Array, vocabulary: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts on end, each with the end id, and where each text's ids begin (one more than texts)."""
    data, offsets = text_bytes(texts)
    starts = word_starts(data, offsets)
    cuts = np.append(starts, len(data)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data)))
    coded = words.dictionary_encode()
    packed = encoder(vocabulary).ids(coded.dictionary.to_pylist())
    flat = np.frombuffer(b"".join(packed), np.uint32)
    size = np.array([len(x) // 4 for x in packed], np.int64)
    begin = np.cumsum(size) - size
    number = coded.indices.to_numpy()
    count = size[number]
    ends = np.cumsum(count)
    ids = flat[np.repeat(begin[number] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
    bounds = np.r_[0, ends][np.searchsorted(starts, offsets)]
    return np.insert(ids, bounds[1:], end_id).astype("<u4"), bounds + np.arange(len(bounds))


def pieces(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row for each full window and rest: doc_id, start, length, ids_crc32, doc_tokens."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole):
                ids, bounds = token_ids(batch["text"], vocabulary)
                total = np.diff(bounds)
                count = -(-total // capacity)
                row = np.repeat(np.arange(batch.num_rows), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * capacity
                length = np.minimum(capacity, total[row] - start)
                first = bounds[row] + start
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[row])],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, schema)


def pack(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """The pieces of every document with sequence_id and offset."""
    spark = documents.sparkSession
    part = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))).alias("_part")
    cut = materialize(pieces(documents, capacity, vocabulary).select("*", part), "pieces")
    counts = cut.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most capacity rows
    runs = np.array(best_fit_decreasing(histogram, capacity), np.int64).reshape(-1, 5)
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    shared = spark.sparkContext.broadcast(runs[order])  # bounded by lengths and capacities, whatever the corpus

    # ranks among pieces of one length, in parts of that length, so that a frequent length isn't one task
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "start", "ids_crc32"))
    ranked = cut.withColumn("_nth", nth).join(offsets, ["length", "_part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_before") + F.col("_nth") - 1).alias("rank"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        keys = runs[:, 0] << 48 | runs[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            run = runs[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            nth = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(run[:, 2] + nth // run[:, 3]), pa.array(run[:, 4] + nth % run[:, 3] * length)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, schema)
