"""The append-only store: Parquet parts under one manifest.

A commit writes its parts first and then a manifest version, by a rename that fails if the version exists; what no
manifest names is invisible. The manifest holds every topic's next sequence (it never falls, so no sequence is used
twice), configs, floors that were observable, and the parts with their ranges, so that reads open only files that can
hold what they want. Records, deletes and lease events commit together. State is derived: a snapshot is a shortcut, never the truth.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..errors import LedgerError
from ..functions.exprs import TagFilter, check_name
from ..operators import append as A
from ..operators import catalog as K
from ..operators import delete as D
from ..operators import queue as Q
from ..operators import read as R
from ..operators import retention as T
from ..operators import router as O

RECORDS = "topic string, seq long, ts_ms long, node string, tag string, data string, meta string, bytes long, hops int"
LEASES = "topic string, pos long, seq long, event string, node string, lease_id long, deadline_ms long, ready_at_ms long, ts_ms long, connection string"
EMPTY = {"version": 0, "logs": {}, "routers": {}, "parts": [], "pos": 0, "next_lease": 1}


def _new_log(config: dict) -> dict:
    return {"config": config, "next": 1, "floors": {}}


class LogStore:
    """One writer at a time; any number of readers. ``now_ms`` is always the caller's."""

    def __init__(self, spark: SparkSession, root: str, max_total_bytes: int = 0, max_routers: int = C.MAX_ROUTERS):
        self.spark, self.root = spark, root.rstrip("/")
        self.max_total_bytes, self.max_routers = max_total_bytes, max_routers  # 0: no quota
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
        self._fs = self._path("x").getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifest

    def manifest(self) -> dict:
        if not self._fs.exists(self._path("manifest")):
            return json.loads(json.dumps(EMPTY))
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("manifest")) if s.getPath().getName().startswith("v"))
        if not names:
            return json.loads(json.dumps(EMPTY))
        stream = self._fs.open(self._path(f"manifest/{names[-1]}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, m: dict) -> dict:
        m = m | {"version": m["version"] + 1}
        temporary = self._path(f"manifest/.{uuid.uuid4().hex}")
        self._fs.mkdirs(self._path("manifest"))
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        final = self._path(f"manifest/v{m['version']:012d}")
        if self._fs.exists(final) or not self._fs.rename(temporary, final):
            self._fs.delete(temporary, False)
            raise LedgerError("internal", "another writer has committed")
        return m

    def _part(self, kind: str, df: DataFrame, **facts) -> dict:
        name = f"{kind}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return {"kind": kind, "path": name} | facts

    def _read(self, m: dict, kind: str, schema: str, topic: str | None = None, above: int = 0) -> DataFrame:
        paths = [f"{self.root}/{p['path']}" for p in m["parts"] if p["kind"] == kind and (topic is None or p.get("topic") in (None, topic)) and p.get("last", above + 1) > above]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.where(F.col("topic") == topic) if topic is not None else rows

    def _topic(self, m: dict, name: str) -> dict:
        if name not in m["logs"]:
            raise LedgerError("topic_not_found", name)
        return m["logs"][name]

    # --- catalog

    def put_topic(self, name: str, **config) -> dict:
        m = self.manifest()
        old = m["logs"].get(name)
        full = K.normalize_config(config, old and old["config"])
        m["logs"][check_name(name)] = (old or _new_log(full)) | {"config": full}
        self._publish(m)
        return full

    def delete_topic(self, name: str, if_empty: bool = False) -> list[str]:
        """Names of the routers that went with it."""
        m = self.manifest()
        self._topic(m, name)
        if if_empty:
            K.check_delete(self.live(name).count(), True)
        gone = [r for r, x in m["routers"].items() if name in (x["source"], x["dest"])]
        m["routers"] = {r: x for r, x in m["routers"].items() if r not in gone}
        del m["logs"][name]
        m["parts"] = [p for p in m["parts"] if p.get("topic") != name]
        self._publish(m)
        return gone

    # --- records

    def write(self, name: str, batch: DataFrame, now_ms: int, node: str | None = None, create: bool | None = None, config: dict | None = None, idempotency_key: str | None = None) -> dict:
        """One call of a client: ``append`` within the limits of a batch. Returns first_seq, last_seq, count, deduped.

        A key that was used in the log's window answers with the first write's result, and nothing is appended; key and records are
        committed together. ``config`` (and its auto_create, unless ``create`` says) holds for a log that isn't there.
        """
        if idempotency_key is not None and len(idempotency_key.encode()) > C.MAX_KEY_BYTES:
            raise LedgerError("invalid_request", "idempotency_key too long")
        n = batch.limit(C.MAX_BATCH_RECORDS + 1).count()
        if not n:
            raise LedgerError("invalid_request", "a write has at least one record")
        if n > C.MAX_BATCH_RECORDS:
            raise LedgerError("batch_too_large", f"at most {C.MAX_BATCH_RECORDS} records")
        m = self.manifest()
        if name not in m["logs"]:
            full = K.normalize_config(config or {})
            if not (full["auto_create"] if create is None else create):
                raise LedgerError("topic_not_found", name)
            m["logs"][check_name(name)] = _new_log(full)
        t = m["logs"][name]
        keys = t["keys"] = {k: v for k, v in t.get("keys", {}).items() if now_ms - v[0] <= t["config"]["idempotency_window_ms"]}
        if idempotency_key in keys:
            _, first, last = keys[idempotency_key]
            return {"first_seq": first, "last_seq": last, "count": last - first + 1, "deduped": True}
        first, last = self._stage(m, name, batch, now_ms, node)
        if idempotency_key is not None:
            keys[idempotency_key] = [now_ms, first, last]
        self._publish(m)
        return {"first_seq": first, "last_seq": last, "count": last - first + 1, "deduped": False}

    def append(self, name: str, batch: DataFrame, now_ms: int, node: str | None = None, create: bool = True) -> tuple[int, int]:
        """Append any number of records (pos: their order; data; node, tag, meta optional). Returns the first and last sequence."""
        m = self.manifest()
        if name not in m["logs"]:
            if not create:
                raise LedgerError("topic_not_found", name)
            m["logs"][check_name(name)] = _new_log(K.normalize_config({}))
        first, last = self._stage(m, name, batch, now_ms, node)
        if last >= first:
            self._publish(m)
        return first, last

    def _stage(self, m: dict, name: str, batch: DataFrame, now_ms: int, node: str | None = None) -> tuple[int, int]:
        """Check a batch, write its part and enter it in ``m``, which the caller publishes. Retention comes first: what has expired takes no room."""
        t = m["logs"][name]
        for c in ("node", "tag", "meta"):
            if c not in batch.columns:
                batch = batch.withColumn(c, F.lit(None).cast("string"))
        rows = A.prepared(batch, node)
        wrong = rows.where("problem IS NOT NULL").select("problem").first()
        if wrong:
            raise LedgerError("record_too_large" if wrong[0] == "record" else "invalid_request", wrong[0])
        c = t["config"]
        if c["discard"] == "reject" and (c["cap_records"] or c["cap_bytes"]):
            have = self._retained(m, name, now_ms) if t["next"] > 1 else self.spark.createDataFrame([], RECORDS)
            outcome = A.admission(have, rows, c["cap_records"], c["cap_bytes"]).first()["outcome"]
            if outcome != "admit":
                raise LedgerError(outcome, name)
        if self.max_total_bytes:
            held = sum(self._retained(m, x, now_ms).agg(F.sum("bytes")).first()[0] or 0 for x in m["logs"])
            if held + (rows.agg(F.sum("bytes")).first()[0] or 0) > self.max_total_bytes:
                raise LedgerError("throttled", f"at most {self.max_total_bytes} bytes in all")
        rows = A.assign_seq(rows.withColumn("topic", F.lit(name)), ["topic"], ["pos"])
        rows = rows.select("topic", (F.col("seq") + (t["next"] - 1)).alias("seq"), F.lit(now_ms).cast("long").alias("ts_ms"), "node", "tag", "data", "meta", "bytes", F.lit(0).alias("hops"))
        return self._enter(m, name, rows)

    def _enter(self, m: dict, name: str, rows: DataFrame) -> tuple[int, int]:
        """Write numbered records as a part and enter it in ``m``: (first, last)."""
        t = m["logs"][name]
        part = self._part("records", rows.sortWithinPartitions("seq"), topic=name)
        first, last = self.spark.read.schema(RECORDS).parquet(f"{self.root}/{part['path']}").agg(F.min("seq"), F.max("seq")).first()
        if first is None:
            return t["next"], t["next"] - 1
        m["parts"].append(part | {"first": first, "last": last})
        t["next"] = last + 1
        return first, last

    def records(self, name: str, above: int = 0) -> DataFrame:
        m = self.manifest()
        self._topic(m, name)
        return self._read(m, "records", RECORDS, name, above)

    def live(self, name: str) -> DataFrame:
        """Records that no delete and no ack took away."""
        m = self.manifest()
        self._topic(m, name)
        return self._live(m, name)

    def _live(self, m: dict, name: str) -> DataFrame:
        return D.live_records(self._read(m, "records", RECORDS, name), self._read(m, "control", D.CONTROL, name))

    def _retained(self, m: dict, name: str, now_ms: int) -> DataFrame:
        """Live records above the floors."""
        row = self._state(m, name, now_ms).first()
        gone = max(row[f] for f in T.FLOORS) if row else 0
        return self._live(m, name).where(F.col("seq") > gone)

    def delete(self, name: str, before_seq: int | None = None, match=None, seqs: list[int] | None = None) -> None:
        m = self.manifest()
        t = self._topic(m, name)
        m["pos"] += 1
        row = D.delete_row(m["pos"], name, t["next"] - 1, before_seq, match, seqs)
        m["parts"].append(self._part("control", self.spark.createDataFrame([row], D.CONTROL), topic=name))
        self._publish(m)

    def _delete_rows(self, m: dict, name: str, seqs: DataFrame) -> None:
        """Enter the delete of a table of records in ``m``: control rows with a set of seqs for each block, none of them through the driver."""
        t = self._topic(m, name)
        m["pos"] += 1
        rows = seqs.groupBy(F.expr(f"seq DIV {A.BLOCK}").alias("block")).agg(F.sort_array(F.collect_list("seq")).alias("seqs"))
        none = F.lit(None).cast("string")
        rows = rows.select(F.lit(m["pos"]).cast("long").alias("pos"), F.lit(name).alias("topic"), none.cast("long").alias("before_seq"), none.alias("match_op"), none.alias("match_value"), F.lit(t["next"]).cast("long").alias("bound_head"), "seqs")
        m["parts"].append(self._part("control", rows, topic=name))

    def state(self, name: str, now_ms: int) -> DataFrame:
        """Floors with what was observable before, watermarks, count and bytes."""
        m = self.manifest()
        self._topic(m, name)
        return self._state(m, name, now_ms)

    def _state(self, m: dict, name: str, now_ms: int) -> DataFrame:
        t = m["logs"][name]
        c = t["config"]
        found = T.floors(self._read(m, "records", RECORDS, name), now_ms, c["ttl_ms"], c["cap_records"], c["cap_bytes"])
        history = self.spark.createDataFrame([(name, *(int(t["floors"].get(f, 0)) for f in T.FLOORS))], "topic string, " + ", ".join(f"{f} long" for f in T.FLOORS))
        return T.watermarks(T.hardened(found, history), self._live(m, name))

    def harden(self, name: str, now_ms: int) -> dict:
        """Make the floors observable: later ones never fall below them, whatever the config says then."""
        row = self.state(name, now_ms).first()
        m = self.manifest()
        m["logs"][name]["floors"] = {f: row[f] for f in T.FLOORS} if row else {}
        self._publish(m)
        return m["logs"][name]["floors"]

    def diff(self, name: str, from_seq: int, now_ms: int, limit: int = 0, nodes=(), **options) -> tuple[DataFrame, DataFrame]:
        """(page, loss marker and watermarks). A gap moves the start behind it. What routers have still to bring here is brought first."""
        self.drain(now_ms, name)
        state = self.state(name, now_ms)
        marker = T.tombstones(state, from_seq)
        found = marker.first()
        start = found["resume_from"] if found else from_seq
        c = self._topic(self.manifest(), name)["config"]
        gone = max((state.first() or {f: 0 for f in T.FLOORS})[f] for f in T.FLOORS)
        live = self.live(name).where(F.col("seq") > max(gone, start))
        return R.diff_page(live, start, limit, now_ms=now_ms, ttl_ms=c["ttl_ms"], nodes=nodes if c["dedupe_node"] else (), **options), marker

    # --- queues

    def leases(self, name: str, now_ms: int) -> DataFrame:
        m = self.manifest()
        self._topic(m, name)
        return Q.lease_fold(self._read(m, "leases", LEASES, name), now_ms)

    def claim(self, name: str, node: str, most: int, now_ms: int, lease_ms: int | None = None, connection: str | None = None) -> DataFrame:
        """Lease the lowest ready records; those delivered too often go to the dead-letter topic first."""
        return self._serve(name, [(node, most, lease_ms)], now_ms, connection)

    def claim_gathered(self, name: str, asked: list[tuple]) -> list[DataFrame]:
        """Serve claims (at_ms, node, most, lease_ms or None) in order of arrival: what comes while the first waits ``claim_jitter_ms`` is one pass that divides the records evenly."""
        c = self._topic(self.manifest(), name)["config"]
        out, waiting = [], sorted(asked, key=lambda a: a[0])
        while waiting:
            until = waiting[0][0] + c["claim_jitter_ms"]
            n = max(1, sum(a[0] < until for a in waiting))
            out.append(self._serve(name, [a[1:] for a in waiting[:n]], until))
            waiting = waiting[n:]
        return out

    def push(self, name: str, node: str, connection: str, most: int, now_ms: int, lease_ms: int | None = None) -> DataFrame:
        """What a connection is to be sent now: as many records as it may hold more. An ack, a nack or an expired lease makes room."""
        held = self.leases(name, now_ms).where(F.col("leased") & (F.col("connection") == connection)).count()
        return self.claim(name, node, max(0, most - held), now_ms, lease_ms, connection)

    def disconnect(self, name: str, connection: str, now_ms: int) -> DataFrame:
        """Give back what a connection holds."""
        return self._lease_events(self.manifest(), name, Q.release_connection(self.leases(name, now_ms), connection, now_ms))

    def _serve(self, name: str, claimers: list[tuple], now_ms: int, connection: str | None = None) -> DataFrame:
        m = self.manifest()
        c = self._topic(m, name)["config"]
        if c["type"] != "queue":
            raise LedgerError("not_a_queue", name)
        ready = Q.claimable(self.live(name), self.leases(name, now_ms), now_ms)
        if c["max_deliveries"] and c["dead_letter"]:
            dead = Q.dead_letters(ready, c["max_deliveries"])
            part = self._part("dead", dead, topic=name)  # read twice: what is copied is what is deleted
            dead = self.spark.read.schema(dead.schema).parquet(f"{self.root}/{part['path']}")
            n = dead.count()
            if n:
                if c["dead_letter"] not in m["logs"]:
                    m["logs"][c["dead_letter"]] = _new_log(K.normalize_config({}))
                copies = Q.divert(dead, name, c["dead_letter"], m["logs"][c["dead_letter"]]["next"] - 1, now_ms, c["max_deliveries"])
                self._enter(m, c["dead_letter"], copies.select("topic", "seq", F.col("ts_ms").cast("long").alias("ts_ms"), "node", "tag", "data", "meta", "bytes", F.lit(0).alias("hops")))
                self._delete_rows(m, name, dead.select("seq"))
                m["logs"][name]["dead_lettered"] = m["logs"][name].get("dead_lettered", 0) + n
                ready = ready.join(dead.select("seq"), "seq", "left_anti")
        slots = [(i, node, most, lease_ms or c["lease_ms"]) for i, (node, most, lease_ms) in enumerate(claimers)]
        taken = Q.cohort(ready, self.spark.createDataFrame(slots, "ord int, node string, max int, lease_ms long"), m["next_lease"], now_ms)
        events = taken.select("seq", F.lit("claimed").alias("event"), "node", "lease_id", "deadline_ms", F.lit(None).cast("long").alias("ready_at_ms"), F.lit(now_ms).cast("long").alias("ts_ms"), F.lit(connection).cast("string").alias("connection"))
        return self._lease_events(m, name, events)

    def counters(self, name: str, now_ms: int) -> DataFrame:
        """One row: live, ready, in_flight, delayed, dead_lettered."""
        return Q.counters(self.live(name), self.leases(name, now_ms), now_ms, self.manifest()["logs"][name].get("dead_lettered", 0))

    def _lease_events(self, m: dict, name: str, events: DataFrame, acked: bool = False) -> DataFrame:
        """Write lease events, with ``acked`` the deletes of their records, and publish them with all that is staged in ``m``."""
        m["pos"] += 1
        if "connection" not in events.columns:
            events = events.withColumn("connection", F.lit(None).cast("string"))
        rows = events.select(F.lit(name).alias("topic"), F.lit(m["pos"]).cast("long").alias("pos"), "seq", "event", "node", "lease_id", "deadline_ms", "ready_at_ms", "ts_ms", "connection")
        part = self._part("leases", rows, topic=name)
        done = self.spark.read.schema(LEASES).parquet(f"{self.root}/{part['path']}")
        m["next_lease"] = max(m["next_lease"], (done.agg(F.max("lease_id")).first()[0] or 0) + 1)
        m["parts"].append(part)
        if acked:
            self._delete_rows(m, name, done.select("seq"))
        self._publish(m)
        return done

    def _asked(self, asked: DataFrame) -> DataFrame:
        Q.check_arrays(asked.limit(C.CLAIM_MAX + 1).count())  # before anything is written
        return asked

    def ack(self, name: str, asked: DataFrame, now_ms: int) -> DataFrame:
        """``asked``: seq, node, lease_id (or null), at most 1000. Acked records are gone, in the same commit; others are skipped."""
        return self._lease_events(self.manifest(), name, Q.ack(self.leases(name, now_ms), self._asked(asked), now_ms), acked=True)

    def nack(self, name: str, asked: DataFrame, now_ms: int, delay_ms: int = 0) -> DataFrame:
        return self._lease_events(self.manifest(), name, Q.nack(self.leases(name, now_ms), self._asked(asked), delay_ms, now_ms))

    def extend(self, name: str, asked: DataFrame, lease_ms: int, now_ms: int) -> DataFrame:
        return self._lease_events(self.manifest(), name, Q.extend(self.leases(name, now_ms), self._asked(asked), lease_ms, now_ms))

    # --- routers

    def put_router(self, name: str, source: str, dest: str, match=None, preserve_node: bool = True, preserve_tag: bool = True, create_dest: bool = True, allow_cycle: bool = False) -> dict:
        """Create a router, or change its filter and flags. A new one starts at its source's head: nothing from before is forwarded.

        Refused: the same log at both ends, a cycle (unless allowed), another source for a dest that has one, other ends
        for a router that is there, one more than ``max_routers``.
        """
        check_name(name, router=True)
        if source == dest:
            raise LedgerError("invalid_request", "source and dest differ")
        TagFilter.parse(match) if match is not None else None
        m = self.manifest()
        old = m["routers"].get(name)
        if dest not in m["logs"] and not create_dest:
            raise LedgerError("topic_not_found", dest)
        others = {r: x for r, x in m["routers"].items() if r != name}
        if any(x["dest"] == dest and x["source"] != source for x in others.values()):
            raise LedgerError("topic_exists_incompatible", f"{dest} has another source", reason="router_dest_fan_in")
        if old and (old["source"], old["dest"]) != (source, dest):
            raise LedgerError("topic_exists_incompatible", f"{name} has other ends", reason="router_repoint_forbidden")
        if not old and self.max_routers and len(m["routers"]) >= self.max_routers:
            raise LedgerError("throttled", f"at most {self.max_routers} routers")
        O.check_cycle([(x["source"], x["dest"]) for x in others.values()], source, dest, allow_cycle)
        for end in (source, dest):
            if end not in m["logs"]:
                m["logs"][check_name(end)] = _new_log(K.normalize_config({}))
        cursor = old["cursor"] if old else m["logs"][source]["next"] - 1
        m["routers"][name] = {"source": source, "dest": dest, "match": match, "preserve_node": preserve_node, "preserve_tag": preserve_tag, "allow_cycle": allow_cycle, "cursor": cursor}
        self._publish(m)
        return m["routers"][name]

    def router(self, name: str) -> dict:
        """A router with its lag: how many sequences its source is ahead."""
        m = self.manifest()
        if name not in m["routers"]:
            raise LedgerError("router_not_found", name)
        r = m["routers"][name]
        return r | {"lag": m["logs"][r["source"]]["next"] - 1 - r["cursor"]}

    def routers(self) -> DataFrame:
        """(name, source, dest), for ``catalog.list_routers``."""
        return self.spark.createDataFrame([(n, x["source"], x["dest"]) for n, x in sorted(self.manifest()["routers"].items())], "name string, source string, dest string")

    def delete_router(self, name: str) -> None:
        m = self.manifest()
        if m["routers"].pop(name, None) is None:
            raise LedgerError("router_not_found", name)
        self._publish(m)

    def drain(self, now_ms: int, dest: str | None = None) -> int:
        """Forward what routers have still to forward, until none has anything: all, or those that reach ``dest``. Returns the number of records.

        A pass takes all that is pending. Records and cursor are one commit, so after a crash nothing is forwarded twice or left
        out; the hop cap ends a cycle. Sources go in order of priority. A dest that rejects takes what fits; the cursor stays there.
        """
        total, moved = 0, True
        while moved:
            m = self.manifest()
            wanted = {dest}
            while dest is not None and (more := {x["source"] for x in m["routers"].values() if x["dest"] in wanted} - wanted):
                wanted |= more
            order = sorted((-(m["logs"][x["source"]]["config"]["priority"] or 0), n) for n, x in m["routers"].items() if dest is None or x["dest"] in wanted)
            moved = False
            for _, n in order:
                forwarded, advanced = self._forward(n, now_ms)
                total, moved = total + forwarded, moved or advanced
        return total

    def _forward(self, name: str, now_ms: int) -> tuple[int, bool]:
        """One pass of a router: (records forwarded, did the cursor move)."""
        m = self.manifest()
        r = m["routers"][name]
        head = m["logs"][r["source"]]["next"] - 1
        if r["cursor"] >= head:
            return 0, False
        c = m["logs"][r["dest"]]["config"]
        room_records = room_bytes = None
        if c["discard"] == "reject" and (c["cap_records"] or c["cap_bytes"]):
            n, b = self._retained(m, r["dest"], now_ms).agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
            room_records, room_bytes = (max(0, c["cap_records"] - n) if c["cap_records"] else None), (max(0, c["cap_bytes"] - b) if c["cap_bytes"] else None)
        source = self._read(m, "records", RECORDS, r["source"], r["cursor"])
        source = O.pending(D.live_records(source, self._read(m, "control", D.CONTROL, r["source"])), r["cursor"])
        at = m["logs"][r["dest"]]["next"] - 1
        make = lambda **room: O.forward(source, r["dest"], at, now_ms, r["match"], r["preserve_node"], r["preserve_tag"], **room)
        rows = make(room_records=room_records, room_bytes=room_bytes)
        first, last = self._enter(m, r["dest"], rows.select("topic", "seq", "ts_ms", "node", "tag", "data", "meta", "bytes", "hops"))
        cursor = head
        if room_records is not None or room_bytes is not None:
            waits = make().where(F.col("seq") > last).agg(F.min("source_seq")).first()[0]
            cursor = head if waits is None else waits - 1
        moved = cursor > r["cursor"]
        if moved:
            r["cursor"] = cursor
            self._publish(m)
        return last - first + 1, moved

    # --- upkeep

    def compact(self, name: str, now_ms: int) -> int:
        """Rewrite a log's live records as one sorted part, drop its deletes and the leases of what is gone; what is lost stays in the floors."""
        self.harden(name, now_ms)
        m = self.manifest()
        floors = m["logs"][name]["floors"]
        rows = self.live(name).where(F.col("seq") > max([0, *floors.values()]))
        part = self._part("records", rows.repartitionByRange("seq").sortWithinPartitions("seq"), topic=name)
        kept = self.spark.read.schema(RECORDS).parquet(f"{self.root}/{part['path']}").agg(F.min("seq"), F.max("seq"), F.count("*")).first()
        held = self.spark.read.schema(RECORDS).parquet(f"{self.root}/{part['path']}").select("seq")
        leases = self._part("leases", self._read(m, "leases", LEASES, name).join(held, "seq", "left_semi"), topic=name)  # of what still lives
        m["parts"] = [p for p in m["parts"] if p.get("topic") != name] + [leases]
        if kept[2]:
            m["parts"].append(part | {"first": kept[0], "last": kept[1]})
        self._publish(m)
        return kept[2]
