"""Byte-level BPE encoding and decoding by a table of ranks.

A pre-token's merges run over a linked list of its parts. The pairs that can merge wait in buckets, one for each
rank; a hierarchical bitmap over ranks (words of 256 bits under one of a bit for each word) finds the lowest rank that
waits by find-first-set on each level. A bucket gives its leftmost position first. A position whose pair has changed
since is stale, and skipped when it comes up. So a pre-token of n bytes takes time near n whatever
its length.

Texts are cut into pieces at places where no match of the pattern can go across; a worker remembers the ids of
pieces of up to PIECE characters. A slice of texts bounds what a worker holds; one very long pre-token takes about 100
bytes for each of its own.

Defined results: null and empty texts have no ids; repeated rows are encoded each; ids that the vocabulary doesn't have
raise an error when decoded; bytes are decoded as they are, whether or not they are UTF-8; a null list of ids decodes
to nothing; an empty table gives an empty result; columns besides doc_id and text (or ids) are not read.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnower.llm.common import byte_slices, text_bytes
from winnower.llm.packing import word_starts

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SLICE = 4 << 20
PIECE = 64
WORD = 8  # bits of a rank within its word of the bitmap
MASK = (1 << WORD) - 1
GENERATION = 200_000  # pieces of a generation; a worker remembers two

_codecs: dict = {}


class RankQueue:
    """Buckets of positions by rank under a bitmap of two levels: bit r of the words is set if bucket r waits, bit h of the top if word h isn't 0."""

    def __init__(self, ranks: int) -> None:
        self.words = [0] * ((ranks >> WORD) + 1)
        self.buckets: list[list[int] | None] = [None] * (len(self.words) << WORD)


def merged(token: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """The ids of a pre-token: again and again the pair of lowest rank merges, the leftmost of equal ones.

    The queue's buckets and words are empty before and after. All in one function, as calls would take most of the time.
    """
    size, words, buckets, rank_of = len(token), queue.words, queue.buckets, ranks.get
    after, before = array("q", range(1, size + 1)), array("q", range(-1, size - 1))
    waiting = array("q", [rank_of(token[i : i + 2], -1) for i in range(size - 1)])
    waiting.append(-1)
    top, fresh = 0, enumerate(waiting)
    while True:
        for at, rank in fresh:
            if rank < 0:
                continue
            bucket = buckets[rank]
            if bucket is None:
                buckets[rank] = [at]
                word = words[rank >> WORD]
                words[rank >> WORD] = word | 1 << (rank & MASK)
                if not word:
                    top |= 1 << (rank >> WORD)
            else:
                heappush(bucket, at)
        while top:
            high = (top & -top).bit_length() - 1
            word = words[high]
            first = word & -word
            rank = high << WORD | first.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                at = heappop(bucket)
            else:
                at = bucket[0]
                buckets[rank] = None
                words[high] = word ^ first
                if word == first:
                    top ^= 1 << high
            if waiting[at] == rank:
                break
        else:
            break
        gone = after[at]
        end = after[gone]
        after[at], waiting[gone] = end, -1
        fresh = []
        if end < size:
            before[end] = at
            waiting[at] = rank = rank_of(token[at : after[end]], -1)
            fresh.append((at, rank))
        else:
            waiting[at] = -1
        left = before[at]
        if left >= 0:
            waiting[left] = rank = rank_of(token[left:end], -1)
            fresh.append((left, rank))
    ids, at = [], 0
    while at < size:
        ids.append(ranks[token[at : after[at]]])
        at = after[at]
    return ids


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (left id, right id) of all pairs that make a token, and the rank of that token."""
    keys, made = [], []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                keys.append(left << 32 | right)
                made.append(rank)
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max), np.append(np.array(made, np.int64)[order], -1)


def every_other(touches: np.ndarray) -> np.ndarray:
    """Which of some positions merge, leftmost first, where touches tells that one ends where the next begins."""
    place = np.arange(len(touches) + 1)
    begun = np.maximum.accumulate(np.where(np.append(True, ~touches), place, 0))
    return (place - begun) % 2 == 0


class Joint:
    """Many pre-tokens in one linked list and one queue: a bucket's positions in all of them merge at once.

    Pre-tokens don't touch, and one of them meets its ranks in the order that it would alone; only where a merge makes a
    pair of lower rank than its own could the rest of its bucket have had to wait, so such pre-tokens are doubtful.
    """

    def __init__(self, tokens: list[bytes], codec: Codec) -> None:
        data = np.frombuffer(b"".join(tokens), np.uint8)
        size = np.array([len(t) for t in tokens], np.int64)
        self.codec, self.many, self.doubtful = codec, len(tokens), set()
        self.owner = np.append(np.repeat(np.arange(len(tokens)), size), -1)
        self.ids = np.append(codec.byte_ids[data], 0)
        self.after, self.before = np.arange(1, len(data) + 2), np.arange(-1, len(data))
        self.waiting = np.full(len(data) + 1, -1, np.int64)
        self.alive = np.ones(len(data) + 1, bool)
        self.top = 0
        at = np.arange(len(data))
        self.wait(at, at + 1)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of what pairs of ids make; -1 for none."""
        keys, made = self.codec.pairs
        key = left << 32 | right
        place = np.searchsorted(keys, key)
        return np.where(keys[place] == key, made[place], -1)

    def wait(self, left: np.ndarray, right: np.ndarray) -> None:
        """Pairs of neighbouring parts go to the buckets of their ranks, in order."""
        rank = np.where(self.owner[left] == self.owner[right], self.ranks_of(self.ids[left], self.ids[right]), -1)
        self.waiting[left] = rank
        left, rank = left[rank >= 0], rank[rank >= 0]
        if not len(left):
            return
        order = np.argsort(rank, kind="stable")
        left, rank = left[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank, prepend=-1)).tolist()
        words, buckets = self.codec.queue.words, self.codec.queue.buckets
        for r, a, b in zip(rank[cuts].tolist(), cuts, [*cuts[1:], len(rank)], strict=True):
            bucket = buckets[r]
            if bucket is None:
                buckets[r] = [left[a:b]]
                word = words[r >> WORD]
                words[r >> WORD] = word | 1 << (r & MASK)
                if not word:
                    self.top |= 1 << (r >> WORD)
            else:
                bucket.append(left[a:b])

    def lowest(self) -> tuple[int, np.ndarray]:
        """The lowest rank that waits, and its whole bucket."""
        words, buckets = self.codec.queue.words, self.codec.queue.buckets
        high = (self.top & -self.top).bit_length() - 1
        first = words[high] & -words[high]
        rank = high << WORD | first.bit_length() - 1
        words[high] ^= first
        if not words[high]:
            self.top ^= 1 << high
        bucket, buckets[rank] = buckets[rank], None
        return rank, bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens on end, and how many each has."""
        while self.top:
            rank, at = self.lowest()
            at = at[self.waiting[at] == rank]
            if not len(at):
                continue
            gone = self.after[at]
            touches = gone[:-1] == at[1:]
            if touches.any():
                at = at[every_other(touches)]
                gone = self.after[at]
            end = self.after[gone]
            beside = np.flatnonzero(end[:-1] == at[1:])
            if len(beside):  # alone, the left one would have met the right one's first part
                between = self.ranks_of(np.full(len(beside), rank), self.ids[at[beside + 1]])
                self.doubtful.update(self.owner[at[beside[(between >= 0) & (between < rank)]]].tolist())
            self.after[at], self.ids[at] = end, rank
            self.waiting[gone], self.alive[gone] = -1, False
            self.before[end] = np.where(self.owner[end] == self.owner[at], at, self.before[end])
            left = self.before[at]
            left = left[self.owner[left] == self.owner[at]]
            self.wait(np.concatenate([left, at]), np.concatenate([self.after[left], end]))
            lower = at[(self.waiting[at] >= 0) & (self.waiting[at] < rank)], left[(self.waiting[left] >= 0) & (self.waiting[left] < rank)]
            self.doubtful.update(self.owner[lower[0]].tolist(), self.owner[lower[1]].tolist())
        left_over = np.flatnonzero(self.alive[:-1])
        return self.ids[left_over], np.bincount(self.owner[left_over], minlength=self.many)


class Codec:
    """A vocabulary of ranks with the pattern that splits texts, and what this worker remembers of pieces."""

    def __init__(self, vocabulary: str, pattern: str | None = None, generation: int = GENERATION) -> None:
        import public_tokenizers
        import regex

        with open(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary), "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.queue = RankQueue(max(self.tokens, default=0) + 1)
        self.pairs = pair_table(self.ranks)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.generation, self.new, self.old = generation, {}, {}

    def token_ids(self, token: str) -> list[int]:
        raw = token.encode()
        rank = self.ranks.get(raw)
        return [rank] if rank is not None else merged(raw, self.ranks, self.queue)

    def merge(self, tokens: list[bytes]) -> list[bytes]:
        """The ids of each pre-token as unsigned 32-bit integers."""
        if not tokens:
            return []
        joint = Joint(tokens, self)
        ids, count = joint.run()
        flat, ends = ids.astype(np.uint32).tobytes(), (4 * np.cumsum(count)).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for i in joint.doubtful:
            out[i] = array("I", merged(tokens[i], self.ranks, self.queue)).tobytes()
        return out

    def pieces_ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as unsigned 32-bit integers; those not remembered are merged together."""
        if len(self.new) > self.generation:
            self.new, self.old = {}, self.new
        new, old, out, places, tokens, bounds = self.new, self.old, [], [], [], [0]
        for piece in pieces:
            ids = new.get(piece)
            if ids is None:
                ids = old.get(piece)
                if ids is None:
                    places.append(len(out))
                    tokens += self.split(piece)
                    bounds.append(len(tokens))
                elif len(piece) <= PIECE:
                    new[piece] = ids
            out.append(ids)
        known = [self.ranks.get(raw, raw) for raw in map(str.encode, tokens)]
        merged_ids = iter(self.merge([x for x in known if isinstance(x, bytes)]))
        found = [next(merged_ids) if isinstance(x, bytes) else x.to_bytes(4, sys.byteorder) for x in known]
        for place, a, b in zip(places, bounds[:-1], bounds[1:], strict=True):
            out[place] = ids = found[a] if b == a + 1 else b"".join(found[a:b])
            if len(pieces[place]) <= PIECE:
                new[pieces[place]] = ids
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and where each text's begin (one more than texts)."""
        data, offsets = text_bytes(texts)
        starts = word_starts(data, offsets)
        cuts = np.append(starts, len(data)).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        packed = self.pieces_ids(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(packed), np.uint32)
        size = np.array([len(x) // 4 for x in packed], np.int64)
        begin = np.cumsum(size) - size
        piece = coded.indices.to_numpy()
        count = size[piece]
        ends = np.cumsum(count)
        ids = flat[np.repeat(begin[piece] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        return ids.astype(np.int32), np.r_[0, ends][np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def codec(vocabulary: str) -> Codec:
    """The codec of this worker process."""
    if vocabulary not in _codecs:
        _codecs[vocabulary] = Codec(vocabulary)
    return _codecs[vocabulary]


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, decoded: bool = False) -> DataFrame:
    """doc_id and ids of every text; decoded: with the bytes that the ids give back."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for whole in batches:
            for batch in byte_slices(whole, limit=SLICE):
                ids, bounds = own.encode(batch["text"])
                columns = [batch["doc_id"], pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))]
                if decoded:
                    columns.append(pa.array([own.decode(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(step, "doc_id long, ids array<int>" + (", decoded binary" if decoded else ""))


def decode(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and decoded, the bytes of each list of ids."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            decoded = pa.array([own.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in batch["ids"]], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], decoded], names=["doc_id", "decoded"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(step, "doc_id long, decoded binary")


def digests(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text."""
    coded = encode(documents, vocabulary, decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
