"""Benchmark decontamination by an FM-index of each training shard.

A shard is a slice of a partition of at most 8 MB of text, whole documents. Maximal runs of words that the benchmark
has, at least as long as the shortest window, are indexed (no occurrence can lie outside them), once for a
shard. The benchmark is taken in blocks of bounded size, which pass by the shard's index one after another: every
window is looked up by backward search through wavelet-tree ranks, occurrences are located by sampled suffix
positions, and their word spans are merged.

Words are compared by a 64-bit hash. Defined results: null and empty texts have no words; an item without
words has no window; equal items and repeated item ids count once by id; a null item id counts as the text
"null"; an empty benchmark contaminates nothing; repeated rows are each answered; columns besides the named
ones are not read, and are kept by remove_contamination.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from winnower.llm.common import byte_runs, byte_slices, carried, restored, run_hashes, text_bytes
from winnower.llm.fmindex import FMIndex

WINDOW = 10
BLOCK_BYTES = 8 << 20  # of benchmark text that is searched at once
SEPARATOR = 1

WORD = np.zeros(256, bool)
WORD[ord("0") : ord("9") + 1] = True
WORD[ord("A") : ord("Z") + 1] = True
WORD[ord("a") : ord("z") + 1] = True
WORD[0x80:] = True

STATE = "n_words long, spans array<struct<first:int,last:int,start:int,end:int>>, items array<string>"


def hashed_words(texts: pa.Array) -> tuple:
    data, offsets = text_bytes(pc.ascii_lower(texts))
    starts, ends, text = byte_runs(data, offsets, WORD)
    return data, offsets, starts, ends, text, run_hashes(data, starts, ends)


class Phrases:
    """The windows of a block of items: by length, rows of word numbers, and which items have each."""

    def __init__(self, ids: list[str], texts: pa.Array) -> None:
        _, _, _, _, text, hashes = hashed_words(texts)
        self.vocabulary, number = np.unique(hashes, return_inverse=True)
        count = np.bincount(text, minlength=len(ids))
        begin = np.cumsum(count) - count
        self.ids, self.windows = np.array(ids, object), {}
        for length in sorted({min(WINDOW, int(c)) for c in count if c}):
            items = np.flatnonzero(count >= WINDOW if length == WINDOW else count == length)
            many = count[items] - length + 1
            owner = np.repeat(items, many)
            at = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            rows, which = np.unique(number[at[:, None] + np.arange(length)].astype(np.int32), axis=0, return_inverse=True)
            pair = np.unique(np.stack([which.ravel(), owner], 1), axis=0)
            self.windows[length] = (rows, np.searchsorted(pair[:, 0], np.arange(len(rows) + 1)), pair[:, 1])

    def found_in(self, shard: Shard) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """length, first words and windows of all occurrences in a shard."""
        local = shard.numbers(self.vocabulary)
        for length, (rows, _, _) in self.windows.items():
            there = np.flatnonzero((local[rows] >= 0).all(1))
            first, which = shard.locate(local[rows[there]])
            if len(first):
                yield length, first, there[which]

    def items_of(self, length: int, doc: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Pairs of text and item for pairs of text and window."""
        _, begin, items = self.windows[length]
        pair = np.unique(np.stack([doc, window], 1), axis=0)
        many = begin[pair[:, 1] + 1] - begin[pair[:, 1]]
        at = np.repeat(begin[pair[:, 1]], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        return np.stack([np.repeat(pair[:, 0], many), items[at]], 1)


class Shard:
    """The FM-index of a shard's runs of known words."""

    def __init__(self, text: np.ndarray, hashes: np.ndarray, known: np.ndarray, least: int) -> None:
        breaks = np.r_[True, (known[1:] != known[:-1]) | (text[1:] != text[:-1])] if len(text) else np.zeros(0, bool)
        run = np.flatnonzero(breaks)
        size = np.diff(np.r_[run, len(hashes)])
        good = known[run] & (size >= least)
        run, size = run[good], size[good]
        # each run with one place more, which the separator takes
        self.word = np.repeat(run - np.cumsum(size + 1) + size + 1, size + 1) + np.arange(int((size + 1).sum()))
        closing = np.zeros(len(self.word), bool)
        closing[np.cumsum(size + 1) - 1] = True
        self.vocabulary, number = np.unique(hashes[self.word[~closing]], return_inverse=True)
        symbols = np.full(len(self.word), SEPARATOR)
        symbols[~closing] = number + SEPARATOR + 1
        self.index = FMIndex(symbols) if len(symbols) else None

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """This shard's numbers of words; -1 for those that it lacks."""
        if self.index is None:
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def locate(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of all occurrences of rows of numbers, and the row of each."""
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, end = self.index.search(rows + SEPARATOR + 1)
        many = end - first
        which = np.repeat(np.arange(len(rows)), many)
        found = np.repeat(first, many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        return (self.word[self.index.locate(found)] if len(found) else found), which


def each_value(shared: list[Broadcast]) -> Iterator:
    """The blocks one after another; a worker keeps one at a time."""
    for block in shared:
        yield block.value
        if len(shared) > 1:
            vars(block).pop("_value", None)


def merged_spans(hit: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
    """The runs of hit words of each text, as words of the text and as code points."""
    spans: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    if hit.any():
        edge = hit & np.r_[True, ~hit[:-1] | (text[1:] != text[:-1])]
        close = hit & np.r_[~hit[1:] | (text[1:] != text[:-1]), True]
        base, before = np.searchsorted(text, np.arange(len(offsets))), np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        for a, b in zip(np.flatnonzero(edge).tolist(), np.flatnonzero(close).tolist(), strict=True):
            i = int(text[a])
            zero = before[offsets[i]]
            spans[i].append({"first": a - int(base[i]), "last": b - int(base[i]), "start": int(before[starts[a]] - zero), "end": int(before[ends[b]] - zero)})
    return spans


def find_contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """The columns of docs (text among them), with n_words, spans (words and code points, merged) and items, which must be free names."""
    tests = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // (block_bytes or BLOCK_BYTES) + 1
    shared, vocabularies, least = [], [], WINDOW
    for block in range(blocks):
        got = (tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)).toArrow()
        phrases = Phrases(got["item_id"].to_pylist(), got["text"])
        least = min([least, *phrases.windows])
        shared.append(docs.sparkSession.sparkContext.broadcast(phrases))  # of about block_bytes of text
        vocabularies.append(docs.sparkSession.sparkContext.broadcast(phrases.vocabulary))
    names = docs.columns
    span = pa.list_(pa.struct([(x, pa.int32()) for x in ("first", "last", "start", "end")]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole):
                yield answer(batch)

    def answer(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        data, offsets, starts, ends, text, hashes = hashed_words(batch["text"])
        known = np.zeros(len(hashes), bool)
        for vocabulary in each_value(vocabularies):
            if len(vocabulary):
                known |= vocabulary[np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)] == hashes
        shard = Shard(text, hashes, known, least)
        change = np.zeros(len(starts) + 1, np.int64)
        items: list[set] = [set() for _ in range(n)]
        for phrases in each_value(shared) if shard.index is not None else ():
            for length, first, window in phrases.found_in(shard):
                np.add.at(change, first, 1)
                np.add.at(change, first + length, -1)
                for i, item in phrases.items_of(length, text[first], window).tolist():
                    items[i].add(phrases.ids[item])
        spans = merged_spans(np.cumsum(change)[:-1] > 0, text, starts, ends, data, offsets)
        count = pa.array(np.bincount(text, minlength=n), pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns, count, pa.array(spans, span), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=[*names, "n_words", "spans", "items"])

    return docs.mapInArrow(search, StructType([*docs.schema.fields, *StructType.fromDDL(STATE).fields]))


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the spans as code points."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hits = n_hit(F.col("spans"))
    return find_contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("removal_spans"),
    )


def without_spans(text: Column, spans: Column) -> Column:
    """The text without merged, ordered spans of code points."""

    def gap(i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
        end = F.when(i == F.size(spans), F.length(text)).otherwise(F.get(spans, i)["start"])
        return F.substring(text, begin + 1, end - begin)

    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans)), gap), ""))


def remove_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The pipeline's stage: every row, with the merged spans cut out of its text; n_chars follows the text."""
    cut = find_contamination(carried(docs, "text"), benchmark).withColumn("_cut", without_spans(F.col("text"), F.col("spans")))
    changed = {"text": lambda _: F.col("_cut"), "n_chars": lambda old: F.when(F.size("spans") > 0, F.length("_cut")).otherwise(old)}
    return restored(cut, docs, ("text",), changed)


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH docs AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
tests AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(len(w), 10) AS k FROM (SELECT item_id, {WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM tests, unnest(range(1, len(w) - k + 2)) t(i)),
sizes AS (SELECT DISTINCT k FROM windows),
grams AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM docs, sizes, unnest(range(1, len(w) - k + 2)) t(i)),
found AS MATERIALIZED (SELECT doc_id, i, grams.k, item FROM grams JOIN windows ON grams.k = windows.k AND grams.g = windows.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM docs d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN named i ON d.doc_id = i.doc_id
"""
