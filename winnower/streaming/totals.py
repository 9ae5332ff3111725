"""Running totals of what packages hold that isn't content, right also when a package is delivered again.

A delivery is a file <package>@<anything>.docx, or <package>.docx; of several the one that was written last counts (then
the one whose path comes last). The state holds the counts of each package's latest delivery. A new one writes the
differences to them, so totals are sums over all that was written; an older one that comes late changes nothing. State
and output are kept by the checkpoint: a restart goes on where the last run ended.

Defined results: paragraphs' own detections count, as in a batch; a package with a part that isn't well formed has none;
a delivery that can't be read, or has no part to look at, changes nothing.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from winnower.operators import detect
from winnower.rules import DEFAULT, Rules
from winnower.sources import packages as P

CHANGES = "pkg_id string, content_type string, n bigint, docs bigint"
NAME = r"([^/@]*)(?:@[^/]*)?\.docx$"


def found_in(packages: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """pkg_id, delivered, path, types and fault: a row for each paragraph and each part's root, of packages (path, modificationTime, content)."""
    named = packages.select(F.to_json(F.struct(F.unix_micros("modificationTime").alias("at"), "path")).alias("pkg_id"), "content")
    parts = P.unpack(named)
    rows = P.shred(parts.where(P.shallow_part(F.col("part")))).where("name = 'w:p' OR node_id = 0 OR error IS NOT NULL")
    texts = rows.select("pkg_id", F.when(F.col("name") == "w:p", F.col("txt")).alias("txt"), F.when(F.col("name") == "w:p", F.col("style")).alias("pstyle"), F.col("error").isNotNull().alias("fault"))
    delivery = F.from_json("pkg_id", "at bigint, path string")
    found = detect.with_detections(texts, detect.paragraph_element(), rules).withColumn("_d", delivery)
    name = F.url_decode(F.regexp_extract("_d.path", NAME, 1))
    return found.select(name.alias("pkg_id"), F.col("_d.at").alias("delivered"), F.col("_d.path").alias("path"), F.transform("found", lambda d: d["content_type"]).alias("types"), "fault")


def changed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The differences that a package's latest delivery makes; keeps its counts."""
    latest, counts, sound = None, Counter(), True
    for frame in frames:
        for at, path, types, fault in zip(frame["delivered"], frame["path"], frame["types"], frame["fault"], strict=True):
            version = (int(at), path)
            if latest is None or version > latest:
                latest, counts, sound = version, Counter(), True
            if version == latest:
                counts.update(types)
                sound = sound and not fault
    before, old = (None, {}) if not state.exists else json.loads(state.get[0])
    if before is not None and latest <= tuple(before):
        return
    new = dict(counts) if sound else {}
    state.update((json.dumps([latest, new]),))
    kinds = sorted(k for k in {*old, *new} if old.get(k, 0) != new.get(k, 0))
    yield pd.DataFrame({"pkg_id": [key[0]] * len(kinds), "content_type": kinds, "n": [new.get(k, 0) - old.get(k, 0) for k in kinds], "docs": [int(k in new) - int(k in old) for k in kinds]})


def watch_totals(spark: SparkSession, folder: str, out: str, checkpoint: str, rules: Rules = DEFAULT) -> StreamingQuery:
    """Takes the files that have come to a folder, each once, and writes the changes of totals as Parquet."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).load(folder)
    changes = found_in(stream, rules).groupBy("pkg_id").applyInPandasWithState(changed, CHANGES, "counts string", "append", GroupStateTimeout.NoTimeout)
    return changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def totals(spark: SparkSession, out: str) -> DataFrame:
    """content_type, n and docs over the latest deliveries."""
    return spark.read.schema(CHANGES).parquet(out).groupBy("content_type").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where("n > 0")
