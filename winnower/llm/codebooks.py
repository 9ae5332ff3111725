"""Vector codes: each part of a vector becomes the index of its nearest entry in a small integer codebook.

Codebooks are fitted by Lloyd rounds over all rows. A part remembers, from round to round, its entry with an upper
bound, its b closest other entries with ordered lower bounds (each holds for its entry and all after it), and one
outer bound for the entries that it doesn't list. Codebooks that move a little shift the bounds; a part whose upper
bound stays below all of them keeps its entry unseen. Where bounds touch, exact integer distances to the entries in
question decide, ties to the lower index. b follows what a round needed: it shrinks when short lists would have done
and grows when too many parts had to look at every entry.

The remembered state is a table in the shared folder, one for each round; a round also leaves sums for each batch of
rows, so that the driver meets only entries times components. Broadcast with a task: the codebooks (parts x entries x
components), whatever the table holds.

Defined results: rows whose vector is null, or holds null or non-finite components, take no part; nor do vectors whose
length isn't that of the smallest vec_id's or no positive multiple of the number of parts. Repeated rows count each;
rows of one vec_id go by their components, rows without one come last. Fewer rows than entries make smaller
codebooks. Components saturate at 64 bits; an error or a sum of errors beyond 64 bits is null. Negative zero is zero.
An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnower.llm.common import discard, materialize, new_folder

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
START_LISTED = 5  # entries a part remembers after the first round
ROWS = 2048  # rows that numpy works on at once
EXACT = 1 << 27  # components below keep squared distances within 64 bits
NOT_LISTED = 255
SLACK = 1e-6

STATE = "vec_id long, label string, vector binary, code binary, bounds binary, sums array<decimal(38,0)>, needed array<bigint>"
CODED = "vec_id long, label string, code binary, error long"


def integers(embeddings: DataFrame, parts: int = PARTS) -> DataFrame:
    """vec_id, label (as text) and components (longs) of the rows that take part, whatever their length."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = rows.where(finite & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    return whole.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x * F.lit(float(SCALE)))).alias("components"))


def distances(vectors: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances over the last axis, as exact integers."""
    gap = vectors - entries
    return (gap * gap).sum(-1)


def below(distance: np.ndarray) -> np.ndarray:
    """A lower bound in single precision of the root of an exact squared distance."""
    return np.sqrt(distance.astype(np.float64)) * (1 - SLACK)


def above(distance: np.ndarray) -> np.ndarray:
    return np.sqrt(distance.astype(np.float64)) * (1 + SLACK)


class Bounds:
    """What the parts of some rows remember: entries listed by distance, their lower bounds in order, the outer and the upper bound."""

    def __init__(self, upper: np.ndarray, outer: np.ndarray, lower: np.ndarray, listed: np.ndarray) -> None:
        self.upper, self.outer, self.lower, self.listed = upper, outer, lower, listed

    @classmethod
    def unpack(cls, packed: list[bytes], parts: int) -> Bounds:
        raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
        many = (raw.shape[1] - 8 * parts) // (5 * parts)
        single = np.ascontiguousarray(raw[:, : 4 * parts * (many + 2)]).view(np.float32).astype(np.float64)
        return cls(single[:, :parts], single[:, parts : 2 * parts], single[:, 2 * parts :].reshape(-1, parts, many), raw[:, 4 * parts * (many + 2) :].reshape(-1, parts, many).copy())

    def pack(self) -> list[bytes]:
        rows = len(self.upper)
        up = np.nextafter(self.upper.astype(np.float32), np.float32(np.inf))
        down = [np.maximum(np.nextafter(x.reshape(rows, -1).astype(np.float32), np.float32(-np.inf)), 0) for x in (self.outer, self.lower)]
        raw = np.concatenate([np.ascontiguousarray(x).view(np.uint8).reshape(rows, -1) for x in (up, *down)] + [self.listed.reshape(rows, -1)], 1)
        return [r.tobytes() for r in raw]

    def resize(self, many: int) -> None:
        """Lists of another length: what is cut off counts as outer, what is added isn't known."""
        old = self.lower.shape[2]
        if many < old:
            self.outer = np.minimum(self.outer, self.lower[:, :, many])
            self.lower, self.listed = self.lower[:, :, :many], self.listed[:, :, :many]
        elif many > old:
            more = (*self.lower.shape[:2], many - old)
            self.lower = np.concatenate([self.lower, np.broadcast_to(self.outer[:, :, None], more)], 2)
            self.listed = np.concatenate([self.listed, np.full(more, NOT_LISTED, np.uint8)], 2)

    def shift(self, code: np.ndarray, moves: np.ndarray) -> None:
        """Codebooks have moved: bounds give way by as much, and stay in order."""
        parts = np.arange(moves.shape[0])
        self.upper = (self.upper + moves[parts, code]) * (1 + 1e-12)
        largest = moves.max(1)
        own = np.where(self.listed == NOT_LISTED, largest[None, :, None], moves[parts[None, :, None], np.minimum(self.listed, moves.shape[1] - 1)])
        self.outer = np.maximum(self.outer * (1 - 1e-12) - largest, 0)
        self.lower = np.maximum(self.lower * (1 - 1e-12) - own, 0)
        self.order()

    def order(self) -> None:
        self.lower = np.minimum(np.minimum.accumulate(self.lower[:, :, ::-1], 2)[:, :, ::-1], self.outer[:, :, None])


def look_at_all(vectors: np.ndarray, books: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry, bounds and list of vectors (n x components) against their codebooks (n x entries x components, or one for all)."""
    apart = distances(vectors[:, None, :], books)
    order = np.argsort(apart, axis=1, kind="stable")
    ranked = np.take_along_axis(apart, order, 1)
    count = ranked.shape[1]
    lower = np.full((len(vectors), many), np.inf)
    listed = np.full((len(vectors), many), NOT_LISTED, np.uint8)
    there = min(many, count - 1)
    lower[:, :there], listed[:, :there] = below(ranked[:, 1 : there + 1]), order[:, 1 : there + 1]
    outer = below(ranked[:, there + 1]) if count > there + 1 else np.full(len(vectors), np.inf)
    return order[:, 0], above(ranked[:, 0]), outer, lower, listed


def first_look(vectors: np.ndarray, books: np.ndarray, many: int) -> tuple[np.ndarray, Bounds]:
    rows, parts, _ = vectors.shape
    code = np.zeros((rows, parts), np.int64)
    bounds = Bounds(np.zeros((rows, parts)), np.zeros((rows, parts)), np.zeros((rows, parts, many)), np.zeros((rows, parts, many), np.uint8))
    for p in range(parts):
        code[:, p], bounds.upper[:, p], bounds.outer[:, p], bounds.lower[:, p], bounds.listed[:, p] = look_at_all(vectors[:, p], books[p], many)
    return code, bounds


def look_again(vectors: np.ndarray, books: np.ndarray, code: np.ndarray, bounds: Bounds) -> np.ndarray:
    """Nearest entries after a shift; updates code and bounds. Gives how many parts needed 0, 1, ... listed entries, and (last) all."""
    many = bounds.lower.shape[2]
    needed = np.zeros(many + 2, np.int64)
    row, part = np.nonzero(bounds.upper >= np.minimum(bounds.lower[:, :, 0], bounds.outer))
    needed[0] = code.size - len(row)
    own = distances(vectors[row, part], books[part, code[row, part]])
    bounds.upper[row, part] = above(own)
    reach = (bounds.lower[row, part] <= bounds.upper[row, part][:, None]).sum(1)
    known = np.where(bounds.listed[row, part] == NOT_LISTED, np.arange(many), many).min(1)  # entries listed before the first unknown one
    everything = (bounds.outer[row, part] <= bounds.upper[row, part]) | (reach > known)
    needed[0] += int(((reach == 0) & ~everything).sum())
    for k in range(1, many + 1):
        at = np.flatnonzero((reach == k) & ~everything)
        if not len(at):
            continue
        needed[k] = len(at)
        r, p = row[at], part[at]
        entries = np.concatenate([code[r, p][:, None], bounds.listed[r, p, :k]], 1).astype(np.int64)
        apart = np.concatenate([own[at][:, None], distances(vectors[r, p][:, None, :], books[p[:, None], entries[:, 1:]])], 1)
        by_index = np.argsort(entries, axis=1, kind="stable")
        order = np.take_along_axis(by_index, np.argsort(np.take_along_axis(apart, by_index, 1), axis=1, kind="stable"), 1)
        entries, apart = np.take_along_axis(entries, order, 1), np.take_along_axis(apart, order, 1)
        code[r, p], bounds.upper[r, p] = entries[:, 0], above(apart[:, 0])
        bounds.listed[r, p, :k], bounds.lower[r, p, :k] = entries[:, 1:], below(apart[:, 1:])
    at = np.flatnonzero(everything)
    needed[-1] = len(at)
    for p in range(code.shape[1]):
        r = row[at[part[at] == p]]
        if len(r):
            code[r, p], bounds.upper[r, p], bounds.outer[r, p], bounds.lower[r, p], bounds.listed[r, p] = look_at_all(vectors[r, p], books[p], many)
    bounds.order()
    return needed


def entry_sums(vectors: np.ndarray, code: np.ndarray, entries: int) -> pa.Array:
    """For each part and entry the number of its parts and their componentwise sums, as one flat list."""
    out = []
    for p in range(vectors.shape[1]):
        mine = code[:, p][None, :] == np.arange(entries)[:, None]
        out.append(np.concatenate([mine.sum(1)[:, None].astype(vectors.dtype), mine.astype(vectors.dtype) @ vectors[:, p]], 1))
    flat = np.concatenate(out).ravel()
    return pa.array([Decimal(int(x)) for x in flat], pa.decimal128(38, 0)) if flat.dtype == object else pa.array(flat).cast(pa.decimal128(38, 0))


def vectors_of(packed: list[bytes], parts: int, width: int) -> np.ndarray:
    """rows x parts x components; Python integers where 64 bits might not hold a distance."""
    if len({len(x) for x in packed}) == 1:
        flat = np.frombuffer(b"".join(packed), np.int32 if len(packed[0]) == 4 * width else np.int64).astype(np.int64)
    else:
        flat = np.concatenate([np.frombuffer(x, np.int32 if len(x) == 4 * width else np.int64).astype(np.int64) for x in packed])
    large = len(flat) and max(int(flat.max()), -int(flat.min())) >= EXACT
    return (flat.astype(object) if large else flat).reshape(len(packed), parts, -1)


def packed_vectors(batch: pa.RecordBatch, width: int) -> pa.Array:
    flat = batch["components"].flatten().to_numpy().reshape(-1, width)
    small = (flat == flat.astype(np.int32)).all(1)
    return pa.array([(v.astype(np.int32) if s else v).tobytes() for v, s in zip(flat, small.tolist(), strict=True)], pa.binary())


def book_array(books: list[list[list[int]]], vectors: np.ndarray) -> np.ndarray:
    """Parts x entries x components, of Python integers if the vectors are or the codebooks must be."""
    large = max((abs(x) for part in books for entry in part for x in entry), default=0) >= EXACT
    return np.array(books, object if large or vectors.dtype == object else np.int64)


def assign_round(books: list, moves: np.ndarray | None, many: int, width: int) -> Callable:
    """One round over rows: their state after it, and the sums and needs of each batch in its first row."""
    parts, entries = len(books), len(books[0])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                packed = batch["vector"] if moves is not None else packed_vectors(batch, width)
                vectors = vectors_of(packed.to_pylist(), parts, width)
                array = book_array(books, vectors)
                if array.dtype == object:
                    vectors = vectors.astype(object)
                if moves is None:
                    (code, bounds), needed = first_look(vectors, array, many), np.zeros(many + 2, np.int64)
                else:
                    code = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
                    bounds = Bounds.unpack(batch["bounds"].to_pylist(), parts)
                    bounds.resize(many)
                    bounds.shift(code, moves)
                    needed = look_again(vectors, array, code, bounds)
                blank = [None] * (batch.num_rows - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["vec_id"], batch["label"], packed, pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary()), pa.array(bounds.pack(), pa.binary()),
                        pa.array([entry_sums(vectors, code, entries).to_pylist(), *blank], pa.list_(pa.decimal128(38, 0))), pa.array([needed.tolist(), *blank], pa.list_(pa.int64())),
                    ],
                    names=["vec_id", "label", "vector", "code", "bounds", "sums", "needed"],
                )

    return step


def final_codes(books: list, moves: np.ndarray, many: int, width: int) -> Callable:
    """The last look: codes with their errors."""
    parts = len(books)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                vectors = vectors_of(batch["vector"].to_pylist(), parts, width)
                array = book_array(books, vectors)
                if array.dtype == object:
                    vectors = vectors.astype(object)
                code = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
                bounds = Bounds.unpack(batch["bounds"].to_pylist(), parts)
                bounds.resize(many)
                bounds.shift(code, moves)
                look_again(vectors, array, code, bounds)
                error = distances(vectors, array[np.arange(parts)[None, :], code]).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"], batch["label"], pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary()), pa.array([e if e < 1 << 63 else None for e in map(int, error)], pa.int64())],
                    names=["vec_id", "label", "code", "error"],
                )

    return step


def moved(books: list, state: DataFrame) -> tuple[list, np.ndarray]:
    """Codebooks at the floor of their parts' means, and how far each entry went. Gathers one row for each place in the sums."""
    entries, size = len(books[0]), len(books[0][0]) + 1
    totals = dict(state.where(F.col("sums").isNotNull()).select(F.posexplode("sums").alias("place", "value")).groupBy("place").agg(F.sum("value")).collect())
    new = []
    for p, part in enumerate(books):
        new.append([])
        for e, entry in enumerate(part):
            count, *sums = (int(totals.get((p * entries + e) * size + i, 0)) for i in range(size))
            new[-1].append([s // count for s in sums] if count else entry)
    went = np.array([[float(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) ** 0.5 for x, y in zip(old, now, strict=True)] for old, now in zip(books, new, strict=True)])
    return new, went * (1 + 1e-12)


def next_listed(needed: list[int], most: int) -> int:
    """How many entries a part should list next, from how many parts needed 0, 1, ... listed ones and (last) all of them."""
    *short, everything = needed
    total = sum(needed)
    if everything * 20 > total:
        return min(most, 2 * (len(short) - 1))
    seen, enough = 0, len(short) - 1
    for k, n in enumerate(short):
        seen += n
        if seen * 100 >= (total - everything) * 99:
            enough = k
            break
    return max(1, min(enough + 1, len(short) - 1))


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list] | None:
    """vec_id, label, code and error of each row, and the codebooks; None if no row takes part."""
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession)
    seeds = [r["components"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "components").limit(entries).collect()]
    if not seeds:
        return None
    width = len(seeds[0])
    rows = rows.where(F.size("components") == width)
    if any(len(s) != width for s in seeds):
        seeds = [r["components"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "components").limit(entries).collect()]
    size = width // parts
    books = [[s[p * size : (p + 1) * size] for s in seeds] for p in range(parts)]
    most = max(1, len(seeds) - 1)
    state, moves, many = rows, None, min(START_LISTED, most)
    for r in range(rounds):
        state = materialize(state.mapInArrow(assign_round(books, moves, many, width), STATE), f"round{r}", folder)
        if moves is not None:
            discard(spark, folder, f"round{r - 1}")
            needed = dict(state.where(F.col("needed").isNotNull()).select(F.posexplode("needed").alias("place", "n")).groupBy("place").agg(F.sum("n")).collect())
            many = next_listed([needed.get(i, 0) for i in range(many + 2)], most)
        books, moves = moved(books, state)
    coded = materialize(state.mapInArrow(final_codes(books, moves, many, width), CODED), "coded", folder)
    discard(spark, folder, f"round{rounds - 1}")
    return coded, books


def vector_codes(embeddings: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits for each part), error, label_error and codebooks_sha256."""
    fitted = fit(integers(embeddings))
    if fitted is None:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded, books = fitted
    digest = hashlib.sha256(",".join(str(x) for part in books for entry in part for x in entry).encode()).hexdigest()
    summed = coded.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"), F.count_if(F.col("error").isNull()).alias("_lost"))
    by_label = summed.select("_label", F.when(F.col("_lost") == 0, F.col("_sum").try_cast("bigint")).alias("label_error"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same by brute force: all distances in each round."""
    near = "SELECT p.rn, p.part, min(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i]))) * {e} + b.entry) AS best FROM cut p JOIN {b} b ON p.part = b.part GROUP BY p.rn, p.part"
    ctes = [
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rn, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cut AS MATERIALIZED (SELECT rn, t.part, v[t.part * len(v) // {parts} + 1 : (t.part + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) AS t(part))",
        f"books0 AS MATERIALIZED (SELECT part, rn - 1 AS entry, x FROM cut WHERE rn <= {entries})",
    ]
    for r in range(rounds):
        old = f"books{r}"
        ctes.append(f"near{r} AS MATERIALIZED ({near.format(e=entries, b=old)})")
        ctes.append(
            f"means{r} AS MATERIALIZED (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (SELECT part, entry, i, sum(c) AS s, count(*) AS n FROM "
            f"(SELECT c.part, a.best % {entries} AS entry, unnest(c.x) AS c, unnest(range(len(c.x))) AS i FROM near{r} a JOIN cut c ON a.rn = c.rn AND a.part = c.part) GROUP BY part, entry, i) GROUP BY part, entry)"
        )
        ctes.append(f"books{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM {old} b LEFT JOIN means{r} m ON b.part = m.part AND b.entry = m.entry)")
    last = f"books{rounds}"
    ctes += [
        f"near{rounds} AS MATERIALIZED ({near.format(e=entries, b=last)})",
        f"digest AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(x) AS c, unnest(range(len(x))) AS i FROM {last}))",
        f"coded AS (SELECT rn, string_agg(lower(printf('%02x', CAST(best % {entries} AS BIGINT))), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM near{rounds} GROUP BY rn)",
    ]
    return f"WITH {', '.join(ctes)} SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept k JOIN coded c ON k.rn = c.rn CROSS JOIN digest"


ORACLE_SQL = oracle_sql()
