"""Column expressions of the log algebra. No I/O, no clock: every time is an argument in milliseconds."""

from __future__ import annotations

import base64
import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from ..errors import LedgerError

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._:-]{0,254}")
ROUTER_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._:>-]{0,254}")


@dataclass(frozen=True)
class TagFilter:
    """``Eq`` compares bytes; ``Glob`` is a literal prefix (its one trailing * stripped)."""

    op: str
    value: str

    @classmethod
    def parse(cls, spec) -> TagFilter:
        """A bare string, or ("tag", "Eq" or "Glob", value)."""
        if isinstance(spec, str):
            return cls("Glob", spec[:-1]) if spec.endswith("*") else cls("Eq", spec)
        if not isinstance(spec, (list, tuple)) or len(spec) != 3 or not all(isinstance(x, str) for x in spec):
            raise LedgerError("invalid_request", "a match is a string or [field, op, value]")
        field, op, value = spec
        if field != "tag" or op not in ("Eq", "Glob"):
            raise LedgerError("invalid_request", f"no such field or operator: {field} {op}")
        return cls(op, value[:-1] if op == "Glob" and value.endswith("*") else value)

    def column(self, tag: Column | None = None) -> Column:
        """True or false, never null: a record without tag matches nothing."""
        tag = F.col("tag") if tag is None else tag
        hit = tag == F.lit(self.value) if self.op == "Eq" else tag.startswith(self.value)
        return F.coalesce(hit, F.lit(False))


def node_passes(nodes, node: Column | None = None) -> Column:
    """Loop prevention: records of ``nodes`` (one name or several) are dropped; those without node pass."""
    node = F.col("node") if node is None else node
    names = [nodes] if isinstance(nodes, str) else list(nodes or [])
    return node.isNull() | ~node.isin(names) if names else F.lit(True)


def expired(ttl_ms: int, now_ms: int, ts: Column | None = None) -> Column:
    ts = F.col("ts_ms") if ts is None else ts
    return F.lit(now_ms) - ts > F.lit(ttl_ms) if ttl_ms > 0 else F.lit(False)


def decision(ttl_ms: int, now_ms: int, nodes=(), deleted: Column | None = None) -> Column:
    """What a read does with a record, in this order: expired, deleted, node_filtered, deliver."""
    deleted = F.lit(False) if deleted is None else deleted
    return F.when(expired(ttl_ms, now_ms), "expired").when(deleted, "deleted").when(~node_passes(nodes), "node_filtered").otherwise("deliver")


def record_bytes(data: str = "data", meta: str | None = None) -> Column:
    size = F.coalesce(F.octet_length(F.col(data)), F.lit(0)).cast("long")
    return size if meta is None else size + F.coalesce(F.octet_length(F.col(meta)), F.lit(0)).cast("long")


def allowed(prefixes, name: str = "name") -> Column:
    """Names that any allowed prefix begins; no list allows all."""
    return reduce(lambda a, b: a | b, [F.col(name).startswith(p) for p in prefixes]) if prefixes else F.lit(True)


def loss_reason(gap_from: Column) -> Column:
    """Why a gap is: of evict_floor and expiry_floor those that reach it; else source_trim; else cap."""
    cap, ttl = F.col("evict_floor") >= gap_from, F.col("expiry_floor") >= gap_from
    return F.when(cap & ttl, "mixed").when(cap, "cap").when(ttl, "ttl").when(F.col("source_trim_floor") >= gap_from, "source_trim").otherwise("cap")


def effective_priority(manual: Column, auto: Column, idle_ms: Column, waited_ms: Column) -> Column:
    """A manual priority, clamped, else recency that halves; both age while they wait."""
    fixed = F.greatest(F.lit(C.PRIORITY_MIN), F.least(F.lit(C.PRIORITY_MAX), manual)).cast("double")
    fresh = F.when(auto & (idle_ms <= C.AUTO_FLOOR_MS), F.lit(C.AUTO_MAX) * F.pow(F.lit(2.0), -idle_ms / F.lit(C.HALF_LIFE_MS))).otherwise(F.lit(0.0))
    age = F.lit(C.AGE_RATE_PER_MS) * F.least(waited_ms, F.lit(C.AGE_CAP_MS))
    return F.round(F.coalesce(fixed, fresh) + age).cast("long")


def priority_band(p: Column) -> Column:
    """4 (highest) to 0."""
    return F.when(p >= 750, 4).when(p >= 500, 3).when(p >= 250, 2).when(p >= 0, 1).otherwise(0)


def lease_name(lease_id: Column) -> Column:
    return F.concat(F.lit("lease_"), F.lower(F.hex(lease_id)))


def lease_number(name: Column) -> Column:
    """Null for anything but lease_ and hexadecimal digits."""
    return F.when(name.rlike("^lease_[0-9a-f]{1,16}$"), F.conv(F.substring(name, 7, 16), 16, 10).cast("long"))


def shard_of(topic_id: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(topic_id), F.lit(shards)).cast("int")


def page_token(after: str) -> str:
    return base64.b64encode(json.dumps({"after": after}, separators=(",", ":")).encode()).decode()


def page_after(token: str | None) -> str:
    if not token:
        return ""
    try:
        return json.loads(base64.b64decode(token, validate=True))["after"]
    except (ValueError, KeyError, TypeError) as e:
        raise LedgerError("invalid_request", "not a page cursor") from e


def token_column(after: Column) -> Column:
    return F.base64(F.to_json(F.struct(after.alias("after"))).cast("binary"))


def composite_cursor(cursors: dict[str, int]) -> str:
    """A watch position as base64url JSON, without padding."""
    return base64.urlsafe_b64encode(json.dumps(cursors, sort_keys=True, separators=(",", ":")).encode()).decode().rstrip("=")


def parse_composite(token: str) -> dict[str, int]:
    try:
        found = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
        return {str(k): int(v) for k, v in found.items()}
    except (ValueError, AttributeError, TypeError) as e:
        raise LedgerError("invalid_request", "not a watch position") from e


def check_name(name: str, router: bool = False) -> str:
    if not (ROUTER_NAME if router else NAME).fullmatch(name or ""):
        raise LedgerError("invalid_request", f"not a valid name: {name!r}")
    return name


def row_limit(limit: int) -> int:
    return min(limit or C.DIFF_LIMIT, C.DIFF_LIMIT_MAX)


def byte_limit(n: int) -> int:
    return min(n or C.BATCH_BYTES, C.BATCH_BYTES_MAX)
