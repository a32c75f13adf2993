"""A streaming source over log files whose offset is a cursor for each topic.

    spark.dataSource.register(LedgerSource)
    spark.readStream.format("ledger").option("path", folder).option("cursors", '{"a": 10}').load()

``path`` is a folder of Parquet files with topic, seq, ts_ms, node, tag, data. A start below the checkpoint's position is
a rewind: give the query a new checkpoint and lower cursors.
"""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "topic string, seq long, ts_ms long, node string, tag string, data string"
COLUMNS = ["topic", "seq", "ts_ms", "node", "tag", "data"]


SLICE = 1 << 20  # sequences that a task reads


def _dataset(path: str):
    """Any folder that Arrow's file systems open: local, hdfs://, s3://, gs://."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return ds.dataset(inner, filesystem=system, format="parquet")


def batch_heads(batch) -> tuple[list[str], list[int]]:
    import pyarrow as pa

    found = pa.Table.from_batches([batch]).group_by("topic").aggregate([("seq", "max")])
    return found["topic"].to_pylist(), found["seq_max"].to_pylist()


class Slice(InputPartition):
    def __init__(self, topic: str, after: int, upto: int):
        self.topic, self.after, self.upto = topic, after, upto


class LedgerReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.seen: set[str] = set()
        self.heads: dict[str, int] = {}
        self.cursors = {k: int(v) for k, v in json.loads(options.get("cursors", "{}")).items()}

    def _heads(self) -> dict[str, int]:
        for part in _dataset(self.path).get_fragments():  # files don't change: each is looked at once
            if part.path not in self.seen:
                for batch in part.to_batches(columns=["topic", "seq"]):
                    for t, top in zip(*batch_heads(batch), strict=True):
                        self.heads[t] = max(self.heads.get(t, 0), top)
                self.seen.add(part.path)
        return self.heads

    def initialOffset(self) -> dict:
        return dict(self.cursors)

    def latestOffset(self) -> dict:
        return {t: h for t, h in self._heads().items() if not self.cursors or t in self.cursors}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return [Slice(t, a, min(a + SLICE, int(e))) for t, e in sorted(end.items()) for a in range(int(start.get(t, 0)), int(e), SLICE)]

    def read(self, partition: Slice):
        import pyarrow.dataset as ds

        wanted = (ds.field("topic") == partition.topic) & (ds.field("seq") > partition.after) & (ds.field("seq") <= partition.upto)
        yield from _dataset(self.path).to_table(columns=COLUMNS, filter=wanted).sort_by("seq").to_batches()

    def commit(self, end: dict) -> None:
        pass


class LedgerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledger"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LedgerReader:
        return LedgerReader(self.options)
