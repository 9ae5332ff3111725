"""Ranked lexical search: an index of segments, each searched best-first over intervals of its documents.

A segment holds the documents of up to SEGMENT bytes of one input partition, numbered by ascending id. For each term it
lists documents with the term and how often they hold it. A search builds, over each list that its queries need, a
sparse table that gives the list's largest impact within any range in constant time. An interval of documents is
bounded by the sum, over a query's terms, of the largest impact within it. The intervals with the best bounds come
first: each is split at the document of its largest single impact, that document is scored, and what lies left and
right of it are new intervals. A segment is done when no interval's bound reaches the score of the last place. Impacts
are integers, so bounds are exact.

The index is a table in the shared folder: documents aren't shuffled, only the lists that queries ask for are. Queries
pass by in blocks of BLOCK bytes; one block is gathered and broadcast at a time. Each segment gives at most the
wanted places of an item, and a window ranks these.

Defined results: documents without terms (null, empty) count nowhere; repeated rows, and rows without an id, are
documents of their own, and a missing id comes last among equal scores; an item's repeated rows are one, and different
texts of one item_id are put together; an item without terms, or whose terms no document holds, has no rows; empty
tables give an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnower.llm.common import byte_runs, byte_slices, materialize, new_folder, text_bytes

PLACES = 20
SEGMENT = 24 << 20  # bytes of text
SLICE = 4 << 20
BLOCK = 8 << 20  # bytes of query terms
AT_ONCE = 32  # intervals split together
TERM_BYTES = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
MEMBER = np.ones(256, bool)
MEMBER[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False

POSTINGS = "segment long, term string, docs binary, counts binary, ids array<long>, lengths array<long>"


@dataclass
class Index:
    """lists: segment, term, docs, counts, df of each term of a segment; segments: of, the ids and lengths of its documents; and totals over all."""

    lists: DataFrame
    segments: DataFrame
    documents: int
    terms: int


def term_arrays(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts on end, and the number of the text that each is in."""
    data, offsets = text_bytes(texts)
    low = LOWER[data]
    starts, ends, owner = byte_runs(low, offsets, MEMBER)
    bounds = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(low[MEMBER[low]])), owner


def counted(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of some texts, and for each term and text with it: the term's number, the text's, and how often."""
    words, owner = term_arrays(texts)
    coded = words.dictionary_encode()
    size = len(texts) or 1
    key, count = np.unique(coded.indices.to_numpy().astype(np.int64) * size + owner, return_counts=True)
    return coded.dictionary, key // size, key % size, count


class Segment:
    """Documents of one input partition, put together until there is enough for a segment."""

    def __init__(self) -> None:
        self.terms, self.postings, self.ids, self.rows, self.bytes = [], [], [], 0, 0

    def add(self, batch: pa.RecordBatch) -> None:
        terms, term, doc, count = counted(batch["text"])
        before = sum(len(t) for t in self.terms)
        self.terms.append(terms)
        self.postings.append((term + before, doc + self.rows, count))
        self.ids.append(batch["doc_id"])
        self.rows += batch.num_rows
        self.bytes += batch["text"].nbytes

    def rows_out(self, number: int) -> Iterator[pa.RecordBatch]:
        """A row for each term, and one with the ids and lengths of the documents that hold any; documents by ascending id."""
        coded = pa.chunked_array(self.terms).combine_chunks().dictionary_encode()
        term, doc, count = (np.concatenate(x) for x in zip(*self.postings, strict=True))
        ids = pa.chunked_array(self.ids).combine_chunks()
        self.__init__()
        length = np.bincount(doc, count, len(ids)).astype(np.int64)
        by_id = pa.compute.array_sort_indices(ids, order="ascending", null_placement="at_end").to_numpy()
        by_id = by_id[length[by_id] > 0]
        place = np.zeros(len(ids), np.int64)
        place[by_id] = np.arange(len(by_id))
        key = coded.indices.to_numpy().astype(np.int64)[term] * len(ids) + place[doc]
        order = np.argsort(key, kind="stable")
        term, doc, count = key[order] // len(ids), (key[order] % len(ids)).astype(np.int32), count[order].astype(np.int32)
        first = np.flatnonzero(np.diff(term, prepend=-1))
        gaps = np.diff(doc, prepend=0).astype(np.int32)
        gaps[first] = doc[first]
        bounds = (4 * np.append(first, len(term))).astype(np.int32)
        docs, counts = (pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(x))]) for x in (gaps, count))
        names = ["segment", "term", "docs", "counts", "ids", "lengths"]
        for a in range(0, len(first), 1 << 15):
            part = slice(a, a + (1 << 15))
            n = len(docs[part])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), coded.dictionary[part].cast(pa.string()), docs[part], counts[part], *(pa.nulls(n, pa.list_(pa.int64())) for _ in "il")], names=names)
        if len(by_id):
            listed = [pa.array([x], pa.list_(pa.int64())) for x in (ids.take(pa.array(by_id)).to_pylist(), length[by_id].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), *listed], names=names)


def build_index(documents: DataFrame) -> Index:
    """The index of all documents, as a table in the shared folder."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, number = Segment(), TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in byte_slices(whole, limit=SLICE):
                segment.add(batch)
                if segment.bytes >= SEGMENT:
                    yield from segment.rows_out(number)
                    number += 1
        if segment.rows:
            yield from segment.rows_out(number)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table = materialize(rows.mapInArrow(step, POSTINGS), "postings")
    lists = table.where(F.col("term").isNotNull()).select("segment", "term", "docs", "counts", F.expr("octet_length(docs) div 4").cast("long").alias("df"))
    segments = table.where(F.col("ids").isNotNull()).select(F.col("segment").alias("of"), "ids", "lengths")
    n, total = segments.agg(F.sum(F.size("lengths")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    return Index(lists, segments, int(n or 0), int(total or 0))


def query_terms(queries: DataFrame) -> DataFrame:
    """item_id, term and how often the item holds it."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, limit=SLICE):
                terms, term, item, count = counted(batch["text"])
                yield pa.RecordBatch.from_arrays([batch["item_id"].take(pa.array(item)), terms.take(pa.array(term)).cast(pa.string()), pa.array(count.astype(np.int64))], names=["item_id", "term", "many"])

    rows = queries.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    return rows.mapInArrow(step, "item_id long, term string, many long").groupBy("item_id", "term").agg(F.sum("many").alias("many"))


@dataclass
class Block:
    """Items of one block of queries: their ids, and for each the numbers of its terms (within the block) and their weights."""

    item_ids: list
    terms: list[np.ndarray]
    weights: list[np.ndarray]


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Lists:
    """The lists of a segment that a block of queries needs, on end by term and document, under a sparse table of their largest impacts."""

    def __init__(self, numbers: np.ndarray, docs: np.ndarray, impacts: np.ndarray, size: int) -> None:
        self.keys, self.docs, self.impacts, self.size = numbers * size + docs, docs, impacts, size
        longest = int(np.bincount(numbers).max()) if len(numbers) else 0
        levels = [np.arange(len(docs), dtype=np.int32)]
        while 1 << len(levels) <= longest:
            below, half = levels[-1], 1 << len(levels) - 1
            level = below.copy()
            left, right = below[: len(docs) - half], below[half:]
            level[: len(docs) - half] = np.where(impacts[right] > impacts[left], right, left)
            levels.append(level)
        self.table = np.stack(levels)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, keys)

    def largest(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the largest impact in each range of one list, and whether the range holds any."""
        some = right > left
        left, right = np.where(some, left, 0), np.where(some, right, 1)
        level = np.frexp((right - left).astype(np.float64))[1] - 1
        a, b = self.table[level, left], self.table[level, right - (1 << level)]
        return np.where(self.impacts[b] > self.impacts[a], b, a), some

    def best(self, numbers: np.ndarray, weights: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with the highest scores above 0, highest first, equal ones by document; and their scores."""
        base = numbers * self.size
        last = len(self.keys) - 1

        def bounded(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at, some = self.largest(left, right)
            part = np.where(some, self.impacts[at] * weights, 0)
            return part.sum(1), self.docs[at[np.arange(len(at)), part.argmax(1)]]

        left, right, begin = self.place(base)[None], self.place(base + self.size)[None], np.zeros(1, np.int64)
        bound, split = bounded(left, right)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while True:
            least, last_doc = (scores[-1], docs[-1]) if len(docs) == places else (1, self.size)
            live = np.flatnonzero((bound > least) | ((bound == least) & (begin <= last_doc)))
            if not len(live):
                return docs, scores
            bound, split, left, right, begin = bound[live], split[live], left[live], right[live], begin[live]
            take = np.argpartition(-bound, AT_ONCE)[:AT_ONCE] if len(bound) > AT_ONCE else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[take] = False
            doc = split[take]
            at = self.place(base + doc[:, None])
            here = np.minimum(at, last)
            holds = self.keys[here] == base + doc[:, None]
            found = np.where(holds, self.impacts[here] * weights, 0).sum(1)
            docs, scores = np.append(docs, doc[found > 0]), np.append(scores, found[found > 0])
            order = np.lexsort((docs, -scores))[:places]
            docs, scores = docs[order], scores[order]
            new_left, new_right = np.concatenate([left[take], at + holds]), np.concatenate([at, right[take]])
            new_bound, new_split = bounded(new_left, new_right)
            bound, split, begin = np.append(bound[rest], new_bound), np.append(split[rest], new_split), np.concatenate([begin[rest], begin[take], doc + 1])
            left, right = np.concatenate([left[rest], new_left]), np.concatenate([right[rest], new_right])


def search_segment(lists: pa.Table, segment: pa.Table, block: Block, documents: int, terms: int, places: int) -> pa.Table:
    """The best documents of a segment for each item of a block: item, doc_id, score."""
    out = {"item": [], "doc_id": [], "score": []}
    if lists.num_rows and segment.num_rows:
        lists = lists.sort_by("number").combine_chunks()
        size = np.array([len(x) // 4 for x in lists["docs"].to_pylist()], np.int64)
        numbers = np.repeat(lists["number"].to_numpy(), size)
        gaps = np.frombuffer(b"".join(lists["docs"].to_pylist()), np.int32).astype(np.int64)
        run = np.cumsum(gaps)
        first = np.cumsum(size) - size
        docs = run - np.repeat(run[first] - gaps[first], size)
        count = np.frombuffer(b"".join(lists["counts"].to_pylist()), np.int32).astype(np.int64)
        lengths, ids = segment["lengths"][0].as_py(), segment["ids"][0].as_py()
        norm = np.array([100 - 25 + 25 * n * documents // terms for n in lengths], np.int64)
        found = Lists(numbers, docs, 1_000_000_000 * count // (1000 * count + 12 * norm[docs]), len(lengths))
        for item, (wanted, weights) in enumerate(zip(block.terms, block.weights, strict=True)):
            best, scores = found.best(wanted, weights, places)
            out["item"] += [item] * len(best)
            out["doc_id"] += [ids[d] for d in best.tolist()]
            out["score"] += scores.tolist()
    return pa.table([pa.array(out["item"], pa.int64()), pa.array(out["doc_id"], pa.int64()), pa.array(out["score"], pa.int64())], names=["item", "doc_id", "score"])


def search_block(index: Index, asked: DataFrame, places: int, folder: str, name: str) -> DataFrame:
    """item_id, doc_id and score: each segment's best for the items of one block, as a table."""
    spark = asked.sparkSession
    rows = asked.toArrow().to_pylist()  # a block is bounded in bytes
    words = sorted({r["term"] for r in rows})
    number = {t: i for i, t in enumerate(words)}
    numbered = spark.createDataFrame(pa.table([pa.array(words, pa.string()), pa.array(range(len(words)), pa.int64())], names=["term", "number"]))
    wanted = index.lists.join(F.broadcast(numbered), "term")
    df = dict(wanted.groupBy("number").agg(F.sum("df")).collect())  # at most a row for each term of the block
    held = {}
    for r in rows:
        n = number[r["term"]]
        if n in df:
            held.setdefault(r["item_id"], []).append((n, r["many"] * weight(index.documents, df[n])))
    listed = [np.array(x, np.int64).reshape(-1, 2) for x in held.values()]
    shared = spark.sparkContext.broadcast(Block(list(held), [x[:, 0] for x in listed], [x[:, 1] for x in listed]))
    documents, terms = index.documents, index.terms

    def search(lists: pa.Table, segment: pa.Table) -> pa.Table:
        return search_segment(lists, segment, shared.value, documents, terms, places)

    lists = wanted.select("segment", "number", "docs", "counts").groupBy("segment")
    found = lists.cogroup(index.segments.groupBy("of")).applyInArrow(search, "item long, doc_id long, score long")
    items = spark.createDataFrame(pa.table([pa.array(range(len(held)), pa.int64()), pa.array(list(held), pa.int64())], names=["item", "item_id"]))
    done = materialize(found.join(F.broadcast(items), "item").select("item_id", "doc_id", "score"), name, folder)
    shared.destroy()
    return done


def ranked_search(documents: DataFrame, queries: DataFrame, places: int = PLACES) -> DataFrame:
    """item_id, rank, doc_id and score of each item's highest-scoring documents."""
    return search_index(build_index(documents), queries, places)


def search_index(index: Index, queries: DataFrame, places: int = PLACES) -> DataFrame:
    spark, folder = queries.sparkSession, new_folder(queries.sparkSession)
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    asked = materialize(query_terms(queries), "asked", folder)
    size = asked.agg(F.sum(F.octet_length("term") + 32)).first()[0]
    if size and index.documents:
        blocks = -(-size // BLOCK)
        parts = []
        for b in range(blocks):
            block = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
            parts.append(search_block(index, block, places, folder, f"found{b}"))
        found = spark.read.schema(found.schema).parquet(*(f"{folder}/found{b}" for b in range(blocks)))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= places).select("item_id", "rank", "doc_id", "score")


UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = f"unnest(regexp_extract_all(translate(text, '{UPPER}', '{SMALL}'), '{TERM_BYTES}'))"
ORACLE_SQL = f"""WITH held AS MATERIALIZED (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, {WORDS} AS term FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)) GROUP BY ALL),
  sizes AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM held GROUP BY r), totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes), spread AS (SELECT term, count(*) AS df FROM held GROUP BY term),
  asked AS (SELECT item_id, term, count(*) AS many FROM (SELECT item_id, {WORDS} AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
  scored AS (SELECT q.item_id, h.doc_id, h.r, CAST(sum(many * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)))) AS BIGINT) AS score
    FROM asked q JOIN held h ON q.term = h.term JOIN spread s ON q.term = s.term JOIN sizes z ON h.r = z.r CROSS JOIN totals GROUP BY q.item_id, h.doc_id, h.r)
  SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE score > 0) WHERE place <= {PLACES}"""
