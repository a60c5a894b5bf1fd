"""Analysis of a stream of document versions: each batch keeps the latest version of a document and analyses only what changed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.frames import Frames

Analysis = Callable[[Frames], DataFrame]


def latest(versions: DataFrame) -> DataFrame:
    """The last version of each document of (doc_id, ts, text); of equal times the greater text."""
    return versions.groupBy("doc_id").agg(F.max(F.struct("ts", "text")).alias("v")).select("doc_id", "v.ts", "v.text")


def changed(versions: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(doc_id, ts, text): of each batch the last version of a document, if it is newer than all before and of other content.

    Only the last version counts, so a text that returns to an earlier content is analysed again; an older version that comes
    late is passed over. State is a time and a hash a document, dropped once the watermark is `delay` behind nothing new: a
    document that comes after that is analysed whatever its content.
    """
    hashed = versions.select("doc_id", "ts", F.coalesce("text", F.lit("")).alias("text")).withColumn("content", F.xxhash64("text"))

    def newer(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = None  # frames come one by one; only the last version so far is held
        for df in frames:
            top = df.sort_values(["ts", "text"]).iloc[-1]
            if last is None or (top["ts"], top["text"]) > (last["ts"], last["text"]):
                last = top
        if last is None:
            return
        ts, content = int(last["ts"].value), int(last["content"])
        before, was = state.get if state.exists else (None, None)
        late = before is not None and ts < before
        kept = (before, was) if late else (ts, content)
        state.update(kept)
        # each call clears the time at which the state is dropped, so each sets it again
        state.setTimeoutTimestamp(max(kept[0] // 1_000_000, state.getCurrentWatermarkMs()) + 1)
        if not late and content != was:
            yield pd.DataFrame([[key[0], last["ts"], last["text"]]], columns=["doc_id", "ts", "text"])

    return hashed.withWatermark("ts", delay).groupBy("doc_id").applyInPandasWithState(newer, "doc_id long, ts timestamp, text string", "ts long, content long", "append", GroupStateTimeout.EventTimeTimeout)


def reanalyse(versions: DataFrame, analysis: Analysis, path: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Writes analysis rows of each changed document to path/batch=N; a repeated batch overwrites its own folder alone.

    versions is a streaming (doc_id, ts, text). checkpoint must lie in a folder that driver and executors share.
    """

    def one(batch: DataFrame, number: int) -> None:
        found = analysis(Frames.plain(latest(batch).select("doc_id", "text")))
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changed(versions, delay).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
