"""N-gram Jaccard self-join with prefix filters under several global token orders.

A document's tokens are the hashes of its distinct word n-grams. Documents with equal sets form a class, and
classes are joined. Under any one order of all tokens, two sets that are similar enough share a token among
the first n - ceil(t n) + 1 of each. Tokens known to be frequent come last in every order, ties are broken
by a hash of the order's own. The first order's prefixes are an inverted index that proposes pairs; a pair
must also share prefix tokens under each further order before its sets are intersected.

A token's list of m classes isn't expanded into all pairs: every class is first paired with the list's head; after
components of those links are known, only pairs from different components remain, and they are taken as each
class outside the list's largest component with the rest of the list. A pair is taken at a token only if what
follows it in both sets could suffice; that holds at the first token that a similar pair shares. So every
similar pair is either verified or already connected, and components are exact, but for hashes: a shingle is 52
bits of one, so that one of 10^4 shingles is miscounted in about one of 10^8 texts, and a set's key has 64.

The very frequent tokens come from a sixteenth of the texts, chosen by hash. They decide the order only, never
the result, as any order gives a complete filter.

Defined results: null, empty and blank texts have no shingle and are linked with nothing; a text of fewer words
has one shingle, the whole sequence; equal sets are always linked; repeated rows are each answered; a null id
is no smallest id (a component of null ids alone has a null id); columns besides the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnower.llm.common import byte_runs, byte_slices, carried, discard, materialize, mix, new_folder, restored, run_hashes, text_bytes
from winnower.llm.components import connected_components

TOKEN_BITS = 52
MOST_FREQUENT = 1 << 20  # of the tokens put last in the orders; bounds what is broadcast
SAMPLED = 16
OFTEN = 3  # texts of the sample

SOLID = np.ones(256, bool)
SOLID[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


@dataclass(frozen=True)
class Rule:
    words: int = 4
    numerator: int = 85
    denominator: int = 100
    orders: int = 3

    def prefix(self, size: np.ndarray) -> np.ndarray:
        return size - -(-self.numerator * size // self.denominator) + 1

    def may_link(self, x: Column, y: Column) -> Column:
        """Whether two sets (n, and place of a token) could be similar if this token is the first that they share.

        Similar sets share at least num / (num + den) of the sum of their sizes, and each must have as much from there on.
        """
        need, whole = self.numerator * (x["n"] + y["n"]), self.numerator + self.denominator
        sizes = self.denominator * F.least(x["n"], y["n"]) >= self.numerator * F.greatest(x["n"], y["n"])
        return sizes & (whole * (x["n"] - x["place"]) >= need) & (whole * (y["n"] - y["place"]) >= need)

    @property
    def shares(self) -> int:
        """Of so many shares of all tokens, one comes first in the first order; it exceeds a prefix by a quarter."""
        return max(1, int(self.denominator / (1.25 * max(1, self.denominator - self.numerator))))


@dataclass
class Sets:
    """The token sets of a batch: tokens of all texts on end, in ascending order, and where each text's begin."""

    tokens: np.ndarray
    begin: np.ndarray
    size: np.ndarray

    def keys(self) -> np.ndarray:
        """A 64-bit key of each set, equal for equal sets."""
        total = np.zeros(len(self.size), np.uint64)
        full = np.flatnonzero(self.size > 0)
        if len(full):
            total[full] = np.add.reduceat(mix(self.tokens + np.uint64(0x5851F42D4C957F2D)), self.begin[full])
        return mix(total + self.size.astype(np.uint64)).view(np.int64)


def token_sets(texts: pa.Array, words: int) -> Sets:
    data, offsets = text_bytes(pc.ascii_lower(texts))
    starts, ends, text = byte_runs(data, offsets, SOLID)
    n = len(offsets) - 1
    h = run_hashes(data, starts, ends)
    count = np.bincount(text, minlength=n)
    first = np.cumsum(count) - count
    at = np.flatnonzero(text[words - 1 :] == text[: len(text) - words + 1]) if len(text) >= words else np.zeros(0, np.int64)
    gram = h[at] if len(at) else np.zeros(0, np.uint64)
    for j in range(1, words):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + h[at + j]
    short = np.flatnonzero((count > 0) & (count < words))
    whole = count[short].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for j in range(words - 1):
        more = np.flatnonzero(count[short] > j)
        whole[more] = mix(whole[more]) * np.uint64(0x9E3779B97F4A7C15) + h[first[short[more]] + j]
    owner = np.concatenate([text[at], short]).astype(np.uint64)
    packed = owner << np.uint64(TOKEN_BITS) | mix(np.concatenate([gram, whole])) >> np.uint64(64 - TOKEN_BITS)
    packed.sort()
    packed = packed[np.r_[True, packed[1:] != packed[:-1]]] if len(packed) else packed
    size = np.bincount((packed >> np.uint64(TOKEN_BITS)).astype(np.int64), minlength=n)
    return Sets(packed & np.uint64((1 << TOKEN_BITS) - 1), np.cumsum(size) - size, size)


def among(tokens: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed) or not len(tokens):
        return np.zeros(len(tokens), bool)
    return listed[np.minimum(np.searchsorted(listed, tokens), len(listed) - 1)] == tokens


def first_of_each(tokens: np.ndarray, owner: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first want tokens of each owner (ascending), and how many those are."""
    have = np.bincount(owner, minlength=len(want))
    many = np.minimum(have, want)
    begin = np.cumsum(have) - have
    return tokens[np.repeat(begin - np.cumsum(many) + many, many) + np.arange(int(many.sum()))], many


def index_tokens(sets: Sets, rule: Rule, frequent: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Under the first order: each set's tokens of the first share, and what it lacks for a prefix, from the others."""
    owner = np.repeat(np.arange(len(sets.size)), sets.size)
    late = among(sets.tokens, frequent)
    early = (sets.tokens % np.uint64(rule.shares) == 0) & ~late
    many = np.bincount(owner[early], minlength=len(sets.size))
    lack = np.where(sets.size > 0, np.maximum(rule.prefix(sets.size) - many, 0), 0)
    rest = np.flatnonzero(~early)
    rest = rest[np.argsort(owner[rest] * 2 + late[rest], kind="stable")]
    return (sets.tokens[early], many), first_of_each(sets.tokens[rest], owner[rest], lack)


def prefixes(sets: Sets, rule: Rule, frequent: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix tokens of all sets under a further order, on end, and how many each set has. frequent: tokens, ascending."""
    owner = np.repeat(np.arange(len(sets.size)), sets.size)
    place = mix(sets.tokens + np.uint64(order << 56))
    ranked = np.lexsort((place, owner * 2 + among(sets.tokens, frequent)))
    return first_of_each(sets.tokens[ranked], owner, np.where(sets.size > 0, rule.prefix(sets.size), 0))


def nested(values: np.ndarray, many: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)], pa.int32()), pa.array(values.astype(np.int64)))


def frequent_tokens(texts: DataFrame, rule: Rule) -> np.ndarray:
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole):
                yield pa.RecordBatch.from_arrays([pa.array(token_sets(batch["text"], rule.words).tokens.astype(np.int64))], names=["token"])

    chosen = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    counted = chosen.select("text").mapInArrow(tokens, "token long").groupBy("token").count().where(F.col("count") >= OFTEN)
    got = counted.orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).select("token").toArrow()
    return np.sort(got["token"].to_numpy().astype(np.uint64))


def similar_components(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return grouped(documents, rule).select("doc_id", "n_shingles", "component_id")


def grouped(documents: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, whole (hash of the text), n_shingles, component_id and component (a class; null without shingles) of every row."""
    spark = documents.sparkSession
    folder = new_folder(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("whole"), text.alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_tokens(texts, rule))  # at most MOST_FREQUENT tokens

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole):
                sets = token_sets(batch["text"], rule.words)
                early, rest = index_tokens(sets, rule, frequent.value)
                prefix = np.where(sets.size > 0, rule.prefix(sets.size), 0)
                columns = [batch["doc_id"], batch["whole"], pa.array(sets.size), pa.array(prefix), pa.array(sets.keys()), nested(*early), nested(*rest)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "whole", "n_shingles", "prefix", "class", "early", "rest"])

    schema = "doc_id long, whole long, n_shingles long, prefix long, class long, early array<long>, rest array<long>"
    rows = materialize(texts.mapInArrow(sized, schema), "sets", folder)
    sizes = (F.min("n_shingles").alias("n"), F.min("prefix").alias("prefix"), F.min(F.size("early")).alias("early"))
    classes = materialize(rows.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"), *sizes), "classes", folder)

    # exact counts of the first share's tokens; one that only one class holds proposes nothing
    early = rows.select("class", F.explode("early").alias("token"))
    shared = early.groupBy("token").agg(F.min("class").alias("head"), F.max("class").alias("tail"), F.count("*").alias("df")).where("head <> tail")
    common = materialize(early.join(materialize(shared.select(F.col("token").alias("of"), "df"), "shared", folder), F.col("token") == F.col("of")).select("class", "token", "df").distinct(), "common", folder)
    held = common.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"))  # at most a set's tokens
    lone = F.col("early") - F.size("held")  # first in the order, as only this class holds them
    room = F.least(F.greatest(F.col("prefix") - lone, F.lit(0)), F.size("held")).cast("int")
    chosen = held.join(classes.select("class", "n", "prefix", "early"), "class").select("class", "n", lone.alias("lone"), F.posexplode(F.slice("held", 1, room)).alias("at", "t"))
    rest = rows.select("class", F.col("n_shingles").alias("n"), F.size("early").alias("before"), F.posexplode("rest").alias("at", "token")).distinct()
    columns = ("class", F.col("n").cast("int").alias("n"))
    index = chosen.select(*columns, F.col("t.token").alias("token"), (F.col("lone") + F.col("at")).alias("place")).union(rest.select(*columns, "token", F.col("before") + F.col("at")))
    index = materialize(index, "index", folder)
    discard(spark, folder, "shared", "common")

    # a list's head is the class that the token comes first in: of copies with changes, the one with the fewest
    one = ("class", "n", "place")
    lists = index.groupBy("token").agg(F.min(F.struct("place", "class", "n")).alias("head"), F.min(F.struct(*one)).alias("low"), F.max(F.struct(*one)).alias("high"), F.count("*").alias("many"))
    lists = materialize(lists.where("low.class <> high.class").select("token", F.struct(*(F.col(f"head.{c}").alias(c) for c in one)).alias("head"), "low", "high", "many"), "lists", folder)
    longer = lists.where("many > 2").select(F.col("token").alias("of"), "head")
    members = materialize(index.join(longer, F.col("token") == F.col("of")).select("token", "head", F.struct(*one).alias("self")), "members", folder)
    twos = lists.where((F.col("many") == 2) & rule.may_link(F.col("low"), F.col("high"))).select(F.col("low.class").alias("a"), F.col("high.class").alias("b"))
    heads = members.where((F.col("head.class") != F.col("self.class")) & rule.may_link(F.col("head"), F.col("self"))).select(F.least("head.class", "self.class"), F.greatest("head.class", "self.class"))
    pairs = twos.union(heads).distinct()
    pairs = materialize(pairs, "pairs", folder)
    discard(spark, folder, "index", "lists")

    # those that stand in a longer list too, as they may be paired with others than its head
    involved = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).union(members.select("self.class")).distinct()
    wanted = classes.join(involved, "class", "left_semi").select("least").distinct().hint("merge")  # grows with the corpus, so it isn't broadcast
    others = range(1, rule.orders)

    def detailed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole):
                sets = token_sets(batch["text"], rule.words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sets.keys()), nested(sets.tokens, sets.size), *(nested(*prefixes(sets, rule, frequent.value, k)) for k in others)], names=["class", "tokens", *(f"p{k}" for k in others)]
                )

    schema = ", ".join(["class long, tokens array<long>", *(f"p{k} array<long>" for k in others)])
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("least")), "left_semi").select("text").mapInArrow(detailed, schema)
    details = materialize(found.dropDuplicates(["class"]), "details", folder)

    def linked(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes allow it, that pass the filter of each further order, and whose sets are similar."""
        left = details.select(F.col("class").alias("a"), F.col("tokens").alias("s"), *(F.col(f"p{k}").alias(f"l{k}") for k in others))
        right = details.select(F.col("class").alias("b"), F.col("tokens").alias("t"), *(F.col(f"p{k}").alias(f"r{k}") for k in others))
        low, high = F.least(F.size("s"), F.size("t")), F.greatest(F.size("s"), F.size("t"))
        both = pairs.join(left, "a").join(right, "b").where(rule.denominator * low >= rule.numerator * high)
        for k in others:
            both = both.where(F.arrays_overlap(f"l{k}", f"r{k}"))
        shared = F.size(F.array_intersect("s", "t"))
        return both.where(rule.denominator * shared >= rule.numerator * (low + high - shared)).select("a", "b")

    first = materialize(linked(pairs), "links", folder)
    known = connected_components(first)
    named = members.join(known, F.col("self.class") == F.col("node"), "left").select("token", "self", F.coalesce("component", "self.class").alias("component"))
    rest = apart(named, rule)
    discard(spark, folder, "members")
    second = linked(rest.join(pairs, ["a", "b"], "left_anti"))
    parts = connected_components(first.union(second))
    discard(spark, folder, "pairs", "details", "links")

    least = classes.join(parts, F.col("class") == F.col("node")).groupBy("component").agg(F.min("least").alias("component_id"))
    joined = parts.join(least, "component").select("node", "component", "component_id")
    named = classes.join(joined, F.col("class") == F.col("node"), "left")
    answer = materialize(named.select(F.col("class").alias("of"), F.coalesce("component", "class").alias("component"), F.coalesce("component_id", "least").alias("component_id")), "answer", folder)
    full = F.col("n_shingles") > 0
    return rows.join(answer, (F.col("class") == F.col("of")) & full, "left").select("doc_id", "whole", "n_shingles", F.when(full, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "component")


def apart(lists: DataFrame, rule: Rule) -> DataFrame:
    """Pairs a, b of classes of different components that stand in one list (token, self, component) and may link.

    They are taken as each class outside the list's largest component with the rest. What a list's components are is
    written down first, so that both sides of the join are read from plain shuffles and a long list can be divided.
    """
    parts = lists.groupBy("token", "component").agg(F.count("*").alias("n")).groupBy("token")
    spread = parts.agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    spark, folder = lists.sparkSession, new_folder(lists.sparkSession)
    spread = materialize(spread.select(F.col("token").alias("of"), "main"), "spread", folder)
    mixed = materialize(lists.join(spread, F.col("token") == F.col("of")).drop("of"), "mixed", folder)
    outside = mixed.where("component <> main").select("token", F.col("self").alias("other"), F.col("component").alias("own"))
    fits = (F.col("own") != F.col("component")) & rule.may_link(F.col("self"), F.col("other"))
    found = outside.join(mixed, "token").where(fits).select(F.least("self.class", "other.class").alias("a"), F.greatest("self.class", "other.class").alias("b"))
    found = materialize(found.distinct(), "apart", folder)
    discard(spark, folder, "spread", "mixed")
    return found


def keep_one(docs: DataFrame, rule: Rule = Rule(words=5, numerator=80)) -> DataFrame:
    """The pipeline's stage: of each component the row with the smallest id (a null one last), then text hash; once if it is repeated.

    Texts without a shingle stay, each once for its id.
    """
    found = grouped(docs, rule)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "whole")
    chosen = found.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(key).alias("key")).select("key.*")
    keep = materialize(chosen.union(found.where(F.col("component").isNull()).select(key.alias("key")).select("key.*").distinct()), "kept")
    rows = carried(docs, "doc_id", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = rows.withColumns({"_no_id": F.col("doc_id").isNull(), "_key": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_whole": F.xxhash64(text)})
    same = (F.col("_no_id") == F.col("no_id")) & (F.col("_key") == F.col("id")) & (F.col("_whole") == F.col("whole"))
    once = keyed.join(keep.hint("merge"), same, "left_semi").dropDuplicates(["_no_id", "_key", "_whole"])
    return restored(once, docs, ("doc_id", "text"), {})


#: Four-word shingles, similarity 0.85: every pair that shares a shingle, then all that is reachable.
ORACLE_SQL = r"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM texts
),
shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, min(x.n) AS na, min(y.n) AS nb, count(*) AS shared FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (na + nb - shared)),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, root) AS (SELECT doc_id, doc_id FROM sets UNION SELECT b, root FROM reached JOIN steps ON doc_id = a WHERE root < b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(root) AS component_id FROM sets s JOIN reached r ON s.doc_id = r.doc_id GROUP BY s.doc_id, len(s.s)
"""
