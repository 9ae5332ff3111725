"""Toxic spans and document scores by a linear-chain conditional random field.

Labels are given for documents, so words are labelled from them first: a word of a toxic training document is
labelled toxic if the word, or how it begins, is far more frequent in toxic than in other training documents.
The field learns those labels with affix and n-gram features, so that unseen forms are tagged too; the
forward-backward marginals of the toxic label give the offending spans, and a logistic curve over their
maximum, sum and density, fitted on the same rows, gives the document's score.

Defined results: null and empty texts, and every text where no toxic or no other row is labelled, score the
curve's value for no evidence (0 where there is no model); ties don't occur, each row is scored alone; repeated
rows are each answered; several labels of one document count as toxic if one is; columns besides the named
ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from winnower.llm import crf
from winnower.llm.common import byte_slices, carried, in_fold, restored, text_bytes
from winnower.llm.langid import sample, share_of

ROWS_PER_LABEL = 1200  # bound of the sample that the model is fitted on
SPAN_MARGINAL = 0.5
LIFT = 8.0  # how many times likelier evidence must be in toxic documents
LEAST_DOCS = 3  # and one in a hundred toxic documents


@dataclass
class ToxicityModel:
    chain: crf.Chain
    curve: np.ndarray  # for the columns of summary()

    def score(self, found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(found @ self.curve, -30, 30)))


def evidence(words: crf.Words, text_toxic: np.ndarray) -> np.ndarray:
    """For each word in order: whether it or its beginning is much likelier in toxic documents."""
    positive = max(1, int(text_toxic.sum()))
    other = max(1, int((~text_toxic).sum()))
    least = max(LEAST_DOCS, positive // 100)
    marked = np.zeros(len(words.text), bool)
    size = words.ends - words.starts
    for cut in (None, 6, 5, 4):
        if cut is None:
            unit, rows = words.number.astype(np.int64), np.arange(len(words.text))
        else:
            rows = np.flatnonzero(size >= cut)
            _, unit = np.unique(np.stack([words.data[words.starts[rows] + j] for j in range(cut)], 1) @ (256 ** np.arange(cut, dtype=np.int64)), return_inverse=True)
        if not len(rows):
            continue
        once = np.unique(unit * (len(text_toxic) + 1) + words.text[rows])
        who, doc = once // (len(text_toxic) + 1), once % (len(text_toxic) + 1)
        n = int(unit.max()) + 1
        a = np.bincount(who[text_toxic[doc]], minlength=n)
        b = np.bincount(who[~text_toxic[doc]], minlength=n)
        strong = (a >= least) & (a / positive >= LIFT * (b + 0.5) / other)
        marked[rows] |= strong[unit]
    return marked & text_toxic[words.text]


def summary(words: crf.Words, marginal: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts: 1, the largest marginal, and the sum and the density of the distinct words' largest."""
    peak, total = np.zeros(n), np.zeros(n)
    if len(marginal):
        pair = words.text * len(words.hashes) + words.number
        order = np.lexsort((marginal, pair))
        last = order[np.r_[pair[order][1:] != pair[order][:-1], True]]
        np.maximum.at(peak, words.text[last], marginal[last])
        total = np.bincount(words.text[last], marginal[last], n)
    count = np.bincount(words.text, minlength=n)
    return np.stack([np.ones(n), peak, np.log1p(total), np.log1p(100 * total / np.maximum(count, 1))], 1)


def fit_curve(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (toxic - p) - 0.01 * w
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.01 * np.eye(len(w)), slope)
    return w


def fit_toxicity(labelled: DataFrame, rows: int = ROWS_PER_LABEL) -> ToxicityModel | None:
    """labelled: text and toxic (0/1). Fitted on a sample of at most rows rows for each of the two labels."""
    got = sample(labelled.where(F.col("toxic").isin(0, 1)), rows, "toxic").toArrow()
    toxic = np.array(got["toxic"].to_pylist(), int) == 1
    if not toxic.any() or toxic.all():
        return None
    words = crf.words_of(*text_bytes(pc.ascii_lower(got["text"])))
    gold = evidence(words, toxic).astype(int)
    counts = np.bincount(words.number, gold, len(words.hashes))
    lexicon = words.hashes[counts >= LEAST_DOCS]
    chain = crf.fit(words, gold, [0, 1], (lexicon, np.ones(len(lexicon), int)), rounds=25)
    return ToxicityModel(chain, fit_curve(summary(words, chain.marginals(words)[:, 1], len(toxic)), toxic))


def character_offsets(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Byte positions as code points of their own text."""
    before = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    return before[at] - before[offsets[text]]


def score_toxicity(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """All columns of docs (text among them), with score, predicted and spans (code points, end exclusive, marginal), which must be free names."""
    extra = StructType.fromDDL("score double, predicted int, spans array<struct<start:int,end:int,marginal:double>>")
    schema = StructType([*docs.schema.fields, *extra.fields])
    kept = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in (part for whole in batches for part in byte_slices(whole, limit=3 << 20)):
            n = batch.num_rows
            if model is None:
                score, spans = np.zeros(n), [[] for _ in range(n)]
            else:
                data, offsets = text_bytes(pc.ascii_lower(batch["text"]))
                words = crf.words_of(data, offsets)
                marginal = model.chain.marginals(words)[:, 1]
                score, spans = model.score(summary(words, marginal, n)), [[] for _ in range(n)]
                hit = np.flatnonzero(marginal >= SPAN_MARGINAL)
                first = character_offsets(data, offsets, words.starts[hit], words.text[hit]) if len(hit) else []
                last = character_offsets(data, offsets, words.ends[hit], words.text[hit]) if len(hit) else []
                for i, s, e in zip(hit, first, last, strict=True):
                    spans[words.text[i]].append({"start": int(s), "end": int(e), "marginal": float(marginal[i])})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, span)], names=[*kept, "score", "predicted", "spans"])

    return docs.mapInArrow(tag, schema)


def labelled_texts(documents: DataFrame, labels: DataFrame, rows: int = 2 * ROWS_PER_LABEL) -> DataFrame:
    """Texts outside the held-out fold (crc32 of the id mod 5 is 0) with their label: about rows of each label."""
    ids = F.col("doc_id").cast("long").alias("doc_id")
    marks = labels.select(ids, F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~in_fold(F.col("doc_id"), 5, 0))
    chosen = share_of(marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxic", F.col("doc_id"), rows)
    return documents.select(ids, F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # about 2 * rows ids


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending spans of every document."""
    model = fit_toxicity(labelled_texts(documents, labels))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score_toxicity(docs.withColumn("held_out", in_fold(F.col("doc_id"), 5, 0)), model)
    return scored.select("doc_id", "held_out", "score", "predicted", "spans")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The pipeline's stage: rows that score below the threshold, with all their columns."""
    scored = score_toxicity(carried(docs, "text"), fit_toxicity(labelled_texts(docs, labels)))
    return restored(scored.where(F.col("score") < threshold), docs, ("text",), {})
