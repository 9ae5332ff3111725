"""Secrets in text: fixed patterns, and the entropy of sliding windows over candidate strings.

Base spans are the matches of three patterns. The method adds strings of CANDIDATE whose highest Shannon
entropy over windows of WINDOW characters reaches the threshold of their character class. Counts are kept
incrementally: a step adds the entering and takes away the leaving character, and updates the sum of
n log2 n. Strings on the allow-list, and those that a base span touches, add nothing. DataFrame functions only.

A pattern's matches and their places come from the matches themselves and the text between them (split by
the same pattern), in code points.

Defined results: a null text is empty and has no spans; the digest of no spans is that of the empty string;
spans that start together go in the order assign, access, hex, entropy; repeated rows are each answered;
columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 characters or more; a shorter run holds no longer one
HEX = r"[0-9a-f]{24,}"  # runs are maximal, so this equals matching runs and dropping short ones
ASSIGN_LEAST = 6
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
CELLS = 7  # of twelve counts: the characters from + to z are 80
PIECE = 256
THRESHOLDS = {"hex": 3.0, "alphanumeric": 3.7, "base64": 3.9}
ALLOWED = (
    r"^[A-Za-z_/=+-]+$",  # no digit: words, paths, rulers
    r"^[0-9+/_=-]+$",  # numbers, dates
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUIDs name things
    r"(?i)example|placeholder|0123456789|abcdefghij|x{6,}",
)
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
KINDS = ("assign", "access", "hex", "entropy")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression over a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def sums_before(counts: Column) -> Column:
    """For each of an array of integers the sum of those before it. Taken in pieces, as a fold copies what it has gathered."""

    def running(values: Column, zero: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def piece(i: Column) -> Column:
        return F.slice(counts, i * PIECE + 1, F.lit(PIECE))

    pieces = F.sequence(F.lit(0), F.floor((F.size(counts) - 1) / PIECE).cast("int"))
    totals = F.transform(pieces, lambda i: F.aggregate(piece(i), F.lit(0), lambda a, x: a + x))
    heads = let(totals, lambda t: running(t, F.lit(0)))
    return F.when(F.size(counts) == 0, F.array().cast("array<int>")).otherwise(let(heads, lambda h: F.flatten(F.transform(pieces, lambda i: running(piece(i), F.get(h, i))))))


def matches(text: Column, pattern: str, tested: Column) -> Column:
    """All matches as structs of start, end, whole match and tested (an array of a value for each match)."""

    def placed(x: Column) -> Column:
        first = F.length(x["gaps"][0])
        sizes = F.transform(x["found"], lambda m, i: F.length(m) + F.length(F.get(x["gaps"], i + 1)))
        starts = let(sizes, sums_before)

        def one(at: Column) -> Column:
            return F.transform(
                x["found"],
                lambda m, i: F.struct((first + F.get(at, i)).alias("start"), (first + F.get(at, i) + F.length(m)).alias("end"), m.alias("m"), F.get(x["tested"], i).alias("t")),
            )

        return let(starts, one)

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"), tested.alias("tested"))
    none = F.array().cast("array<struct<start:int,end:int,m:string,t:string>>")
    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(none)


def spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def peak_entropy(string: Column, window: int = WINDOW) -> Column:
    """The highest entropy, in bits a character, over all windows of a string of at least window characters from + to z.

    The counts of a window stand in seven integers, five bits each.
    """
    share = F.array(*(F.lit(0.0 if n < 2 else n * math.log2(n)) for n in range(window + 2)))
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), CELLS).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"), F.lit(0).alias("i"))

    def cell(code: Column) -> Column:
        return F.floor(code / 12).cast("int")

    def one(code: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), 5 * (code % 12))

    def peak(codes: Column) -> Column:
        def step(acc: Column, code: Column) -> Column:
            full = acc["i"] >= window
            out = F.when(full, F.get(codes, acc["i"] - window)).otherwise(F.lit(-1))
            count = lambda c: F.call_function("shiftright", F.get(acc["n"], cell(c)), 5 * (c % 12)).bitwiseAND(F.lit(31)).cast("int")
            here = count(code)
            s = acc["s"] + F.get(share, here + 1) - F.get(share, here)
            gone = count(out) + F.when(out == code, 1).otherwise(0)
            s = F.when(full, s - F.get(share, gone) + F.get(share, gone - 1)).otherwise(s)
            n = F.transform(acc["n"], lambda v, k: v + F.when(k == cell(code), one(code)).otherwise(0) - F.when(full & (k == cell(out)), one(out)).otherwise(0))
            best = F.when(acc["i"] >= window - 1, F.greatest(acc["best"], F.lit(math.log2(window)) - s / window)).otherwise(acc["best"])
            return F.struct(n.alias("n"), s.alias("s"), best.alias("best"), (acc["i"] + 1).alias("i"))

        return F.aggregate(codes, zero, step, lambda acc: acc["best"])

    return let(F.transform(F.split(string, ""), lambda c: F.ascii(c) - ord("+")), peak)


def suspicious(string: Column) -> Column:
    """Neither on the allow-list nor below the threshold of its character class."""
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | string.rlike(pattern)
    threshold = F.when(string.rlike("^[0-9a-fA-F]+$"), THRESHOLDS["hex"]).when(string.rlike("^[0-9A-Za-z]+$"), THRESHOLDS["alphanumeric"]).otherwise(THRESHOLDS["base64"])
    return F.when(allowed, F.lit(False)).otherwise(peak_entropy(string) >= threshold)


def listing(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy and the spans as an array."""
    text = F.col("_text")
    none = F.array().cast("array<string>")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    found = rows.select(
        "doc_id",
        F.filter(matches(text, ASSIGN, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))), lambda x: F.length(x["t"]) >= ASSIGN_LEAST).alias("_assign"),
        matches(text, ACCESS, none).alias("_access"),
        matches(text, HEX, none).alias("_hex"),
        matches(text, CANDIDATE, none).alias("_candidates"),
    )
    based = found.withColumn("_base", F.array_sort(F.concat(spans(F.col("_assign"), "assign"), spans(F.col("_access"), "access"), spans(F.col("_hex"), "hex")).cast(SPAN)))
    free = F.filter("_candidates", lambda c: ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])) & suspicious(c["m"]))
    full = based.withColumn("_entropy", free).withColumn("found", F.array_sort(F.concat(F.col("_base"), spans(F.col("_entropy"), "entropy").cast(SPAN))))
    return full.select(
        "doc_id",
        F.size("_assign").cast("long").alias("n_assign"),
        F.size("_access").cast("long").alias("n_access"),
        F.size("_hex").cast("long").alias("n_hex"),
        F.sha2(listing(F.col("_base")), 256).alias("base_sha256"),
        listing(F.col("found")).alias("spans"),
        F.size("_entropy").cast("long").alias("n_entropy"),
        "found",
    )


def literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def located(kind: str, rank: int, pattern: str, group: int) -> str:
    p = literal(pattern)
    return f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, regexp_extract_all(t, {p}) AS ms, regexp_extract_all(t, {p}, {group}) AS xs, string_split_regex(t, {p}) AS gaps FROM docs WHERE regexp_matches(t, {p})"


SPANS_SQL = "coalesce(string_agg(concat(kind, ':', b0, ':', b1), ',' ORDER BY b0, rank), '')"

#: Places are sums over the matches and the gaps before them; each window's entropy is counted on its own.
ORACLE_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
listed AS (
  {located("assign", 0, ASSIGN, 2)}
  UNION ALL {located("access", 1, ACCESS, 0)}
  UNION ALL {located("hex", 2, HEX, 0)}
  UNION ALL {located("entropy", 3, CANDIDATE, 0)}
),
single AS (SELECT doc_id, rank, kind, i, ms[i] AS m, xs[i] AS x, gaps[i] AS gap FROM listed, unnest(range(1, len(ms) + 1)) u(i)),
placed AS (SELECT doc_id, rank, kind, m, x, sum(length(m) + length(gap)) OVER (PARTITION BY doc_id, rank ORDER BY i ROWS UNBOUNDED PRECEDING) AS b1 FROM single),
found AS (SELECT *, b1 - length(m) AS b0 FROM placed),
base AS (SELECT * FROM found WHERE kind <> 'entropy' AND (kind <> 'assign' OR length(x) >= {ASSIGN_LEAST})),
candidates AS (
  SELECT * FROM found c WHERE kind = 'entropy' AND NOT ({" OR ".join(f"regexp_matches(m, {literal(a)})" for a in ALLOWED)})
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.b0 < c.b1 AND c.b0 < b.b1)
),
windows AS (SELECT doc_id, b0, w, unnest(string_split(substr(m, w, {WINDOW}), '')) AS c FROM candidates, unnest(range(1, length(m) - {WINDOW} + 2)) u(w)),
counts AS (SELECT doc_id, b0, w, c, count(*) AS n FROM windows GROUP BY ALL),
entropies AS (SELECT doc_id, b0, w, log2({WINDOW}) - sum(n * log2(n)) / {WINDOW} AS e FROM counts GROUP BY doc_id, b0, w),
peaks AS (SELECT doc_id, b0, max(e) AS e FROM entropies GROUP BY doc_id, b0),
added AS (
  SELECT c.* FROM candidates c JOIN peaks p ON c.doc_id = p.doc_id AND c.b0 = p.b0
  WHERE e >= CASE WHEN regexp_full_match(m, '[0-9a-fA-F]+') THEN {THRESHOLDS["hex"]} WHEN regexp_full_match(m, '[0-9A-Za-z]+') THEN {THRESHOLDS["alphanumeric"]} ELSE {THRESHOLDS["base64"]} END
),
based AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {SPANS_SQL} AS spans FROM base GROUP BY doc_id),
whole AS (SELECT doc_id, {SPANS_SQL} AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(w.spans, '') AS spans
FROM docs d LEFT JOIN based b ON d.doc_id = b.doc_id LEFT JOIN whole w ON d.doc_id = w.doc_id
"""
