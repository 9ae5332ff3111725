"""Detectors of one's own as table functions of SQL.

A detector is a function from a batch of texts to a confidence and a reason for each (None: nothing found). Registered
under a name, it is called over a table with whatever columns the caller wants to keep as one value:

    SELECT k.doc_id, d.* EXCEPT (k) FROM shouting(TABLE(SELECT struct(doc_id) AS k, txt FROM lines)) d

The function's table has the caller's value as it came in (k, of the type named at registration) and the columns of a
detection. Batches go to Python workers as Arrow, so a detector is called once for many rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

#: From texts (None where there is none) to confidence and reason of each; None where nothing is found.
Detector = Callable[[Sequence[str | None]], Sequence[tuple[float, str] | None]]


def register_detector(spark: SparkSession, name: str, detector: Detector, key: str, order: int = 100) -> None:
    """Registers a detector for SQL. key: the type of the caller's value (DDL), kept beside each detection.

    Gives k, ord, content_type (the detector's name), confidence and reason, as the built-in detectors do.
    """

    class Found:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            kept, texts = batch.column(0), batch.column(1).to_pylist()
            found = [(i, *x) for i, x in enumerate(detector(texts)) if x is not None]
            rows, confidence, reason = zip(*found, strict=True) if found else ((), (), ())
            yield pa.table(
                [kept.take(pa.array(rows, pa.int64())), pa.array([order] * len(rows), pa.int32()), pa.array([name] * len(rows), pa.string()), pa.array(confidence, pa.float64()), pa.array(reason, pa.string())],
                names=["k", "ord", "content_type", "confidence", "reason"],
            )

    spark.udtf.register(name, arrow_udtf(Found, returnType=f"k {key}, ord int, content_type string, confidence double, reason string"))
