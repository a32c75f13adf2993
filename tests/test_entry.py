from __future__ import annotations

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_source_reads_each_record_once(spark, tmp_path):
    from streamledger.sources.tables import conversation_logs
    from streamledger.streaming.source import LedgerSource

    folder = str(tmp_path / "logs")
    rows = conversation_logs(spark, DATA)
    rows.select("topic", "seq", "ts_ms", "node", "tag", "data").write.parquet(folder)
    spark.dataSource.register(LedgerSource)

    def read():
        q = spark.readStream.format("ledger").option("path", folder).load()
        q = q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        return sorted((r["topic"], r["seq"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    want = sorted((r["topic"], r["seq"]) for r in rows.collect())
    assert read() == want
    assert read() == want  # a restart delivers nothing again
