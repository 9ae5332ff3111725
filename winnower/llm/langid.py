"""Language identification of code-switched text by a linear-chain conditional random field.

Each word of a text gets the forward-backward marginals of the languages; the text's language is the one
with the largest mean marginal, and the score is that mean.

Defined results: a text that is null, empty or without a letter is ``und`` with score 0; without any labelled
row every text is ``und``; ties go to the language first in alphabetical order; repeated rows are each
answered; columns besides the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnower.llm import crf
from winnower.llm.common import byte_slices, in_fold, text_bytes

UNKNOWN = "und"
ROWS_PER_LANGUAGE = 300  # bound of the sample that the model is fitted on
BYTES_PER_ROW = 16_384  # mean that bounds the bytes of a label's sample; longer texts are sampled too
PIECES = 16


def share_of(rows: DataFrame, label: str, key: Column, want: int) -> DataFrame:
    """About want keys for each label, by a hash of key; counts the keys of labels, which are few, and shuffles no row."""
    counts = {r[label]: max(1, r["n"]) for r in rows.groupBy(label).agg(F.approx_count_distinct(F.xxhash64(key)).alias("n")).collect()}
    limit = F.lit(0)
    for value, n in counts.items():
        limit = F.when(F.col(label) == F.lit(value), F.lit(min(1_000_000, want * 1_000_000 // n + 1))).otherwise(limit)
    return rows.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < limit)


def excerpt(text: Column, limit: int) -> Column:
    """A text of more than limit bytes as pieces from all over it, of at most limit bytes together."""
    size = limit // (4 * PIECES + 1)  # characters of four bytes at most
    pieces = [F.substring(text, (F.length(text) * i / PIECES).cast("int") + 1, F.lit(size)) for i in range(PIECES)]
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat_ws(" ", *pieces))


def sample(labelled: DataFrame, rows: int, label: str) -> DataFrame:
    """At most so many distinct texts for each label, by the order of a hash, and of at most rows * BYTES_PER_ROW bytes.

    Texts of any length count. Where they are long, a label has fewer rows; a text of more than a sixteenth of the bytes
    (or than BYTES_PER_ROW, for few rows) gives pieces from all over it.
    """
    room = rows * BYTES_PER_ROW
    pick = Window.partitionBy(label).orderBy("_h")
    fit = labelled.where(F.col(label).isNotNull() & F.col("text").isNotNull())
    return (
        share_of(fit.select("text", label), label, F.col("text"), 2 * rows)
        .select(excerpt(F.col("text"), max(BYTES_PER_ROW, room // 16)).alias("text"), label, F.xxhash64("text").alias("_h"))
        .dropDuplicates(["_h", label])
        .withColumn("_n", F.row_number().over(pick))
        .withColumn("_bytes", F.sum(F.octet_length("text")).over(pick.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .where((F.col("_n") <= rows) & (F.col("_bytes") <= room))
        .select("text", label)
    )


def lexicon_of(words: crf.Words, gold: np.ndarray, labels: int, least: int = 5, share: float = 0.9) -> tuple:
    """Words seen often and nearly always under one label, with that label."""
    counts = np.stack([np.bincount(words.number[gold == k], minlength=len(words.hashes)) for k in range(labels)], 1)
    total = counts.sum(1)
    sure = (total >= least) & (counts.max(1) >= share * total)
    return words.hashes[sure], counts[sure].argmax(1)


def fit_languages(labelled: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> crf.Chain | None:
    """labelled: text and lang. Fitted on a sample of at most rows rows for each language."""
    got = sample(labelled, rows, "lang").toArrow()
    if not got.num_rows:
        return None
    data, offsets = text_bytes(pc.utf8_lower(got["text"]))
    labels = sorted(set(got["lang"].to_pylist()))
    number = {x: k for k, x in enumerate(labels)}
    words = crf.words_of(data, offsets)
    gold = np.array([number[x] for x in got["lang"].to_pylist()])[words.text]
    return crf.fit(words, gold, labels, lexicon_of(words, gold, len(labels)))


def identify_languages(docs: DataFrame, model: crf.Chain | None) -> DataFrame:
    """doc_id, text and held_out to doc_id, held_out, lang_pred, score and lang_shares (mean marginals by language)."""
    rows = docs.select("doc_id", "held_out", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    schema = "doc_id long, held_out boolean, lang_pred string, score double, lang_shares map<string,double>"
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a few MB: 2^18 weights for each language

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in (part for whole in batches for part in byte_slices(whole, limit=3 << 20)):
            n = batch.num_rows
            lettered = batch["lettered"].to_numpy(zero_copy_only=False)
            names = chain.labels if chain else []
            mean = np.zeros((n, max(1, len(names))))
            if chain:
                words = crf.words_of(*text_bytes(pc.utf8_lower(batch["text"])))
                marginal = chain.marginals(words)
                total = np.stack([np.bincount(words.text, marginal[:, k], n) for k in range(len(names))], 1)
                mean = total / np.maximum(np.bincount(words.text, minlength=n), 1)[:, None]
            best = mean.argmax(1)
            sure = lettered & (mean.max(1) > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["held_out"],
                    pa.array([names[b] if ok else UNKNOWN for b, ok in zip(best, sure, strict=True)], pa.string()),
                    pa.array(np.where(sure, np.clip(mean[np.arange(n), best], 0, 1), 0.0)),
                    pa.array([list(zip(names, m, strict=True)) if ok else [] for m, ok in zip(mean.tolist(), sure, strict=True)], pa.map_(pa.string(), pa.float64())),
                ],
                names=["doc_id", "held_out", "lang_pred", "score", "lang_shares"],
            )

    return rows.mapInArrow(predict, schema)


def language_id(documents: DataFrame) -> DataFrame:
    """Learns from the rows outside the held-out fold (crc32 of the id mod 4 is 2) and answers for all."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    docs = docs.withColumn("held_out", in_fold(F.col("doc_id"), 4, 2))
    model = fit_languages(docs.where(~F.col("held_out")).select("text", "lang"))
    return identify_languages(docs.select("doc_id", "text", "held_out"), model)
