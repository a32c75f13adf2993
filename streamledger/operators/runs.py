"""Runs of a log that end at a limit and start anew: segments of a writer, frames of a reader."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RUNS = "topic string, run int, first_seq long, last_seq long, records long, bytes long"


def greedy_runs(log: DataFrame, max_records: int, max_bytes: int = 0, max_age_ms: int = 0, gaps: bool = False, fit: bool = False) -> DataFrame:
    """(topic, run from 1, first_seq, last_seq, records, bytes), by topic and seq. A limit of 0 is off.

    A run ends when it has ``max_records`` records; when it has ``max_bytes`` or more, or with ``fit`` before the record that would pass
    them (its first always fits); at a record ``max_age_ms`` after its first; with ``gaps``, where seq skips. Where a run starts depends on the
    one before, so a log is read in order, in the stream of one task, jumping from run to run; what is held is one batch. Null bytes count as 0.
    """
    rows = log.select("topic", "seq", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.col("ts_ms") if "ts_ms" in log.columns else F.lit(0).cast("long").alias("ts_ms"))
    rows = rows.repartition("topic").sortWithinPartitions("topic", "seq")

    def run(batches):
        topic, number, held = None, 0, None  # held: first_seq, last_seq, records, bytes, time of the first
        for t in batches:
            seq, size, ts = (t.column(c).to_numpy() for c in ("seq", "bytes", "ts_ms"))
            total = np.concatenate([[0], np.cumsum(size)])
            codes = t.column("topic").dictionary_encode().indices.fill_null(-2).to_numpy()
            change = np.diff(codes, prepend=-3) != 0
            if gaps:
                change[1:] |= seq[1:] != seq[:-1] + 1
            edges = np.flatnonzero(change)
            out = []
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(seq)], strict=True):
                name = t.column("topic")[a].as_py()
                if number == 0 or name != topic:
                    if held:
                        out.append((topic, number, *held[:4]))
                    topic, number, held = name, 1, None
                elif held and gaps and seq[a] != held[1] + 1:
                    out.append((topic, number, *held[:4]))
                    number, held = number + 1, None
                while a < b:
                    n, have, began = (held[2], held[3], held[4]) if held else (0, 0, int(ts[a]))
                    end = min(b, a + max_records - n) if max_records else b
                    if max_bytes:
                        left = total[a] + max_bytes - have
                        end = min(end, int(np.searchsorted(total, left, "right")) - 1) if fit else min(end, int(np.searchsorted(total, left, "left")))
                    if max_age_ms and end > a:
                        old = np.flatnonzero(ts[a:end] - began >= max_age_ms)
                        end = a + int(old[0]) if len(old) else end
                    end = max(end, a) if held else max(end, a + 1)
                    if end > a:
                        held = (held[0] if held else int(seq[a]), int(seq[end - 1]), n + end - a, have + int(total[end] - total[a]), began)
                    a = end
                    if a < b:
                        out.append((topic, number, *held[:4]))
                        number, held = number + 1, None
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], ["topic", "run", "first_seq", "last_seq", "records", "bytes"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([topic], pa.string()), pa.array([number], pa.int32()), *(pa.array([x], pa.int64()) for x in held[:4])], ["topic", "run", "first_seq", "last_seq", "records", "bytes"])

    return rows.mapInArrow(run, _RUNS)
