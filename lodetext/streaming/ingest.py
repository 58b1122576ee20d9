"""Streams: indexing of arriving files, stateless matches, and windowed hit counts with a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodetext.operators import scan_search as S
from lodetext.plans import query as Q
from lodetext.table import SearchTable


def stream_match(stream: DataFrame, query: Q.Query, stats: dict[str, S.ColumnStats] | None = None) -> DataFrame:
    """Matching rows; with statistics that were taken beforehand, their scores."""
    return S.matches(stream, query, stats)


def windowed_hits(stream: DataFrame, query: Q.Query, time: str, window: str, late: str, slide: str | None = None, *keys: str) -> DataFrame:
    hits = S.matches(stream.withWatermark(time, late), query)
    return hits.groupBy(F.window(time, window, slide) if slide else F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("hits"))


def index_arrivals(stream: DataFrame, table: SearchTable, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends each batch as data files of the table and indexes them; every compaction tier fills as with batch runs.

    A batch that runs again (after a failure between its commits) is written to a folder of its own and takes the place of its first attempt in one commit.
    """

    def add(batch: DataFrame, number: int) -> None:
        folder = f"{table.state()['location'].rstrip('/')}/batch-{number}"
        path = f"{folder}/{uuid.uuid4().hex}"
        batch.write.parquet(path)
        files = batch.sparkSession.read.parquet(path).inputFiles()
        files = table.replace_files(folder, files)
        if files:
            for column in table.columns():
                table.index([column], files)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
