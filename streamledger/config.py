"""Limits and defaults that are part of the semantics (fixed values)."""

from __future__ import annotations

MAX_BATCH_RECORDS = 10_000
MAX_RECORD_BYTES = 1 << 20
MAX_META_BYTES, MAX_META_KEYS = 16 << 10, 64
MAX_TAG_BYTES, MAX_NODE_BYTES, MAX_KEY_BYTES = 256, 128, 256
DIFF_LIMIT, DIFF_LIMIT_MAX = 256, 1000
BATCH_BYTES, BATCH_BYTES_MAX = 1 << 20, 8 << 20
PAGE_LIMIT, PAGE_LIMIT_MAX = 100, 1000
MAX_WATCH_LOGS = 256
MAX_HOPS = 8
MAX_ROUTERS = 10_000
ROUTER_BATCH = 1024
CLAIM_MAX = 1000
LEASE_MS_MIN, LEASE_MS_MAX = 100, 86_400_000
JITTER_MS_MAX = 5000
NACK_DELAY_MAX = 86_400_000
PRIORITY_MIN, PRIORITY_MAX = -1000, 1000
AUTO_MAX, HALF_LIFE_MS, AUTO_FLOOR_MS = 500.0, 30_000.0, 300_000
AGE_RATE_PER_MS, AGE_CAP_MS = 0.1, 10_000
FSYNC_BUCKETS_US = (50, 100, 250, 500, 1_000, 5_000, 10_000, 50_000, 100_000)
SESSION_IDLE_MS = 300_000
HEARTBEAT_MS = (1_000, 60_000)
DURABILITY = ("ephemeral", "memory", "disk", "fsync")

TOPIC_DEFAULTS = {
    "type": "log", "ttl_ms": 0, "cap_records": 0, "cap_bytes": 0, "discard": "old", "durable": False, "durability": None, "priority": None,
    "auto_priority": True, "auto_create": True, "idempotency_window_ms": 120_000, "dedupe_node": True, "lease_ms": 30_000,
    "claim_jitter_ms": 0, "max_deliveries": 0, "dead_letter": None, "leases_durable": False,
}
