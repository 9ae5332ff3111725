"""Code lengths of texts by context-tree weighting over bytes.

A text is its lower-cased words, each followed by a space, and one line feed that ends it. Each byte is eight
binary decisions; each decision has, in every context of the DEPTH bytes before it, a Krichevsky-Trofimov
estimate from the training texts, and the estimates of all depths are mixed by context-tree weights: at a node,
the weight of its own estimate against its children's is the ratio of the block probabilities on the training
text. A context that the training text never showed isn't entered: there the mixture ends at the deepest
one that was. The weights are fixed after training, so the score is a product of probabilities.

Texts are dealt to blocks by hash. Each block lists its distinct words and (DEPTH + 1)-grams once; they are
counted over all blocks, priced, joined back to the blocks that hold them, and every text of the block is scored
from the block's list, which comes first in the block's rows; texts stream past it. So the vocabulary and the tree may grow with the corpus; only the nodes of depth at most 2
are gathered and broadcast, at most 255 * 65,793 of them.

Defined results: null, empty and blank texts are the end alone; a null id counts as training; repeated rows are
each counted and scored; without training rows each binary decision has probability 1/2; an empty table gives an
empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnower.llm.common import byte_slices, discard, give_back, in_fold, materialize, new_folder, released, stored_place, text_bytes

DEPTH = 5
SHALLOW = 2
BLOCK_BYTES = 14 << 20
PARTITION_GRAMS = 400_000
SLICE = 1 << 20
END = "\n"


def words_of(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The lower-cased words of each text as lists, and all on end."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    return lists, pc.list_flatten(lists)


def grams_of(lists: pa.Array, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text: its context and itself as one integer (nearest byte highest, itself lowest), and the text."""
    joined = pc.binary_join(lists, " ")
    head = END * depth
    tail = pc.if_else(pc.equal(joined, ""), END, " " + END)
    data, offsets = text_bytes(pc.binary_join_element_wise(head, joined, tail, ""))
    gram = np.zeros(max(0, len(data) - depth), np.int64)
    for k in (*range(1, depth + 1), 0):
        gram <<= 8
        gram |= data[depth - k : len(data) - k]
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))[depth:]
    inside = np.ones(len(data), bool)
    for k in range(depth):
        inside[offsets[:-1] + k] = False
    return gram[inside[depth:]], text[inside[depth:]]


def log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - np.log(shift)


def block_probability(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - math.log(math.pi)


@dataclass
class Level:
    """The nodes of one depth: contexts with a position in the byte's binary tree."""

    nodes: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    own: np.ndarray  # log weight ratio of the node's own estimate; infinite at the deepest
    weighted: np.ndarray  # log of the weighted block probability

    @staticmethod
    def build(nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> Level:
        own = block_probability(zeros, ones)
        if below is None:
            return Level(nodes, zeros, ones, np.full(len(nodes), np.inf), own)
        return Level(nodes, zeros, ones, own - below, np.logaddexp(own, below) - math.log(2))

    def above(self, last: bool) -> Level:
        """The level of contexts shorter by their farthest byte."""
        parent = self.nodes & 255 if last else self.nodes >> 16 << 8 | self.nodes & 255
        nodes, which = np.unique(parent, return_inverse=True)
        gather = lambda v: np.bincount(which, v, len(nodes))
        return Level.build(nodes, gather(self.zeros), gather(self.ones), gather(self.weighted))

    def predict(self, node: np.ndarray, bit: np.ndarray, deeper: np.ndarray | None, entered: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Probability of the bit at this depth given that of the deeper ones, and whether the node was ever seen."""
        at = np.minimum(np.searchsorted(self.nodes, node), max(0, len(self.nodes) - 1))
        if not len(self.nodes):
            return np.full(len(node), 0.5), np.zeros(len(node), bool)
        known = self.nodes[at] == node
        zeros, ones = np.where(known, self.zeros[at], 0), np.where(known, self.ones[at], 0)
        mine = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1)
        if deeper is not None:
            share = 1 / (1 + np.exp(-np.clip(np.where(known, self.own[at], 0), -700, 700)))
            mine = np.where(entered, share * mine + (1 - share) * deeper, mine)
        return mine, zeros + ones > 0


def decisions(gram: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the eight decisions of the byte: the position in the binary tree and the bit."""
    byte = gram & 255
    for j in range(8):
        yield 1 << j | byte >> (8 - j), byte >> (7 - j) & 1


def deep_levels(gram: np.ndarray, n: np.ndarray, position: np.ndarray, bit: np.ndarray, depth: int) -> list[Level]:
    """Levels from the deepest up to the one below the shallow ones, for one decision."""
    nodes, which = np.unique(gram >> 8 << 8 | position, return_inverse=True)
    levels = [Level.build(nodes, np.bincount(which, n * (1 - bit), len(nodes)), np.bincount(which, n * bit, len(nodes)), None)]
    while depth - len(levels) >= SHALLOW + 1:
        levels.append(levels[-1].above(last=False))
    return levels


def shallow_levels(nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> list[Level]:
    """The levels of depth SHALLOW to 0."""
    order = np.argsort(nodes)
    levels = [Level.build(nodes[order], zeros[order], ones[order], below[order])]
    for d in range(SHALLOW - 1, -1, -1):
        levels.append(levels[-1].above(last=d == 0))
    return levels


def whole_partition(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(b["gram"].to_numpy(), b["n"].to_numpy()) for b in batches]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(float)


def price_grams(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """gram and n (training count, 0 too) to gram and price (log10 of the probability of its last byte)."""
    spark = counts.sparkSession
    parts = counts.count() // PARTITION_GRAMS + 1  # of a table, without a shuffle
    # all contexts that share their nearest SHALLOW + 1 bytes meet in a partition
    dealt = counts.repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.shiftright("gram", 8 * (depth - SHALLOW)))

    def upward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, n = whole_partition(batches)
        for position, bit in decisions(gram):
            level = deep_levels(gram, n, position, bit, depth)[-1]
            nodes, which = np.unique(level.nodes >> 16 << 8 | level.nodes & 255, return_inverse=True)
            sums = [np.bincount(which, v, len(nodes)) for v in (level.zeros, level.ones, level.weighted)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), *map(pa.array, sums)], names=["node", "zeros", "ones", "below"])

    sums = dealt.mapInArrow(upward, "node long, zeros double, ones double, below double").groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("below"))
    with released(spark):
        got = sums.toArrow()  # nodes of depth SHALLOW: at most 65,536 contexts of 255 positions
    top = shallow_levels(*(got.column(i).to_numpy() for i in range(4)))
    shared = spark.sparkContext.broadcast(top)

    def downward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, n = whole_partition(batches)
        price = np.zeros(len(gram))
        for position, bit in decisions(gram):
            p = seen = None
            levels = [*deep_levels(gram, n, position, bit, depth), *shared.value]
            for d, level in zip(range(depth, -1, -1), levels, strict=True):
                node = (gram >> (8 * (depth - d) + 8) << 8 | position) if d else position
                p, seen = level.predict(node, bit, p, seen)
            price += np.log10(p)
        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(price)], names=["gram", "price"])

    return dealt.mapInArrow(downward, "gram long, price double")


def added(tables: list[pa.Table], key: str) -> pa.Table:
    """The counts n of several tables by key."""
    return pa.concat_tables(tables).group_by(key, use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})


def list_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's distinct words and grams with their training counts, from its texts as they come."""
    block, words, grams = 0, [], []
    for batch in (part for b in batches for part in byte_slices(b, limit=SLICE)):
        block = batch["block"][0].as_py()
        train = ~batch["held_out"].to_numpy(zero_copy_only=False)
        lists, flat = words_of(batch["text"])
        parent = pc.list_parent_indices(lists).to_numpy()
        coded = flat.dictionary_encode()
        n = np.bincount(coded.indices.to_numpy(), train[parent], len(coded.dictionary))
        words.append(pa.table({"word": coded.dictionary, "n": n.astype(np.int64)}))
        gram, text = grams_of(lists)
        learnt = train[text]
        value, count = np.unique(gram[learnt], return_counts=True)
        other = np.unique(gram[~learnt])
        grams.append(pa.table({"gram": np.concatenate([value, other]), "n": np.concatenate([count, np.zeros(len(other), np.int64)])}))
        if len(grams) == 6:
            words, grams = [added(words, "word")], [added(grams, "gram")]
    if not grams:
        return
    word = added(words, "word")
    word = word.filter(pc.not_equal(word["word"], ""))
    gram = added(grams, "gram")
    a, b = word.num_rows, gram.num_rows
    give_back()
    listed = pa.table(
        {
            "block": pa.array(np.full(a + b, block, np.int32)),
            "word": pa.chunked_array([word["word"].combine_chunks().cast(pa.string()), pa.nulls(b, pa.string())]),
            "gram": pa.chunked_array([pa.nulls(a, pa.int64()), gram["gram"].combine_chunks()]),
            "n": pa.chunked_array([word["n"].combine_chunks(), gram["n"].combine_chunks()]),
        }
    )
    yield from listed.combine_chunks().to_batches(max_chunksize=500_000)


WORD, GRAM, TEXT = 0, 1, 2  # kinds of rows of a block, in this order


class BlockScorer:
    """Scores the texts of a block after its words and grams have come."""

    def __init__(self, train_tokens: int, distinct: int, ends: int) -> None:
        self.train_tokens, self.ends, self.floor = train_tokens, ends, train_tokens + distinct + 1
        self.words, self.counts, self.grams, self.prices = [], [], [], []
        self.index = None

    def learn(self, batch: pa.RecordBatch) -> None:
        names, grams = (batch.filter(pc.equal(batch["kind"], kind)) for kind in (WORD, GRAM))
        self.words.append(names["s"])
        self.counts.append(names["v"].to_numpy())
        self.grams.append(grams["n"].to_numpy())
        self.prices.append(grams["v"].to_numpy())

    def ready(self) -> None:
        if self.index is None:
            self.known = pa.concat_arrays(self.words) if self.words else pa.array([], pa.string())
            self.count = np.concatenate([*self.counts, np.zeros(0)])
            grams, prices = np.concatenate([*self.grams, np.zeros(0, np.int64)]), np.concatenate([*self.prices, np.zeros(0)])
            self.words = self.counts = self.grams = self.prices = None
            order = np.argsort(grams)
            self.index, self.price = grams[order], prices[order]
            give_back()

    def code(self, gram: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.index, gram), max(0, len(self.index) - 1))
        if len(gram) and not (len(self.index) and (self.index[at] == gram).all()):
            raise RuntimeError("a text's bytes aren't in its block's list: the documents changed between two readings")
        return self.price[at]

    def score(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        self.ready()
        n = batch.num_rows
        lists, flat = words_of(batch["s"])
        parent = pc.list_parent_indices(lists).to_numpy()
        coded = flat.dictionary_encode()
        at = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.known), -1).to_numpy()
        blank = at < 0  # the empty word of a text without words
        count = np.where(blank, 0, self.count[np.maximum(at, 0)] if len(self.count) else 0)
        price = np.where(blank, 0.0, np.log10((count + 1) / self.floor))
        which = coded.indices.to_numpy()
        real = ~blank[which]
        gram, text = grams_of(lists)
        value, where = np.unique(gram, return_inverse=True)
        score = np.bincount(text, self.code(value)[where], n)
        size = np.bincount(text, minlength=n)
        return pa.RecordBatch.from_arrays(
            [
                batch["n"],
                pc.equal(batch["v"], 1.0),
                pa.array(np.bincount(parent[real], minlength=n) + 1),
                pa.array(np.bincount(parent[real & (count > 0)[which]], minlength=n) + int(self.ends > 0)),
                pa.array(np.full(n, self.train_tokens, np.int64)),
                pa.array(np.bincount(parent, price[which], n) + math.log10((self.ends + 1) / self.floor)),
                pa.array(score),
                pa.array(-score * math.log2(10) / size),
            ],
            names=SCORES,
        )


SCORES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]


def score_texts(documents: DataFrame) -> DataFrame:
    """Learns from rows outside the held-out fold (crc32 of the id mod 7 is 2) and scores every text."""
    spark = documents.sparkSession
    folder = new_folder(spark)
    place = stored_place(documents)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (F.monotonically_increasing_id() if place is None else place).alias("_place"))
    if place is None:
        docs = materialize(docs, "docs", folder)
    docs = docs.withColumn("held_out", in_fold(F.col("doc_id"), 7, 2))
    size, ends = docs.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held_out"))).first()
    blocks = (size or 0) // BLOCK_BYTES + 1
    # Dealt by where rows are stored: both readings, however they are split, put a row into the same block, and rows that
    # are equal in id and text are spread. Rows that aren't read from files are written with a number first.
    dealt = docs.select("doc_id", "text", "held_out", F.pmod(F.xxhash64("_place"), F.lit(blocks)).cast("int").alias("block"))

    listed = dealt.repartitionById(blocks, "block").groupBy("block").applyInArrow(list_block, "block int, word string, gram long, n long")
    listed = materialize(listed, "listed", folder)
    words, grams = listed.where("word is not null").select("block", "word", "n"), listed.where("gram is not null").select("block", "gram", "n")
    totals = materialize(words.groupBy("word").agg(F.sum("n").alias("n")), "words", folder)
    tokens, distinct = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    tokens, distinct = tokens + ends, distinct + int(ends > 0)
    counts = materialize(grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams", folder)
    prices = materialize(price_grams(counts), "prices", folder)
    discard(spark, folder, "grams")

    back = words.select("block", "word").join(totals, "word").select("block", F.lit(WORD).alias("kind"), F.lit(None).cast("long").alias("n"), F.col("word").alias("s"), F.col("n").cast("double").alias("v"))
    back = back.union(grams.select("block", "gram").join(prices, "gram").select("block", F.lit(GRAM), "gram", F.lit(None).cast("string"), "price"))
    back = materialize(back, "back", folder)
    discard(spark, folder, "listed", "words", "prices")
    rows = back.union(dealt.select("block", F.lit(TEXT), "doc_id", "text", F.col("held_out").cast("int").cast("double")))

    def score_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = BlockScorer(tokens, distinct, ends)
        for batch in batches:
            first = int(np.searchsorted(batch["kind"].to_numpy(), TEXT))
            if first:
                scorer.learn(batch.slice(0, first))
            for part in byte_slices(batch.slice(first), "s", SLICE):
                yield scorer.score(part)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    ordered = rows.repartitionById(blocks, "block").sortWithinPartitions("block", "kind")
    return ordered.groupBy("block").applyInArrow(score_block, schema)
