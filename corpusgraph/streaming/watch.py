"""Continuous refresh with Structured Streaming: a source that polls a folder's listing."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

FORMAT = "corpusgraph_listing"


class ListingSource(DataSource):
    """The whole listing of a folder as a batch of rows whenever any of it has changed.

    Added, changed and removed files all change the listing's digest, which is the offset.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        from corpusgraph.sources.files import LISTING

        return LISTING

    def simpleStreamReader(self, schema):
        return ListingReader(self.options["path"])


class ListingReader(SimpleDataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {"digest": ""}

    def read(self, start: dict):
        from corpusgraph.sources.files import EXCLUDED, listed_rows

        from fnmatch import fnmatch

        rows = sorted(r for r in listed_rows(self.root) if not any(fnmatch(r[0], p) or fnmatch(f"/{r[0]}", p) for p in EXCLUDED))
        digest = hashlib.sha256(json.dumps(rows).encode()).hexdigest()
        return (iter([]), start) if digest == start["digest"] else (iter(rows), {"digest": digest})

    def readBetweenOffsets(self, start: dict, end: dict):
        # A batch that is run again after a failure meets the folder as it is by then.
        return self.read({"digest": ""})[0]


def watch(spark: SparkSession, folder: str, apply: Callable[[DataFrame, int], None], checkpoint: str, *, every: str | None = "1 second") -> StreamingQuery:
    """Run ``apply(listing, batch)`` whenever files below ``folder`` come, change or go.

    A failing batch is retried from the checkpoint and what was indexed before stays in
    place. ``every=None`` handles the folder as it is and stops.
    """
    spark.dataSource.register(ListingSource)
    writer = spark.readStream.format(FORMAT).load(folder).writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()
