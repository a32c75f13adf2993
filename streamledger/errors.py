"""One exception class with the API's stable codes."""

from __future__ import annotations

#: Code and HTTP status.
STATUS = {
    "invalid_request": 400,
    "batch_too_large": 400,
    "record_too_large": 400,
    "unauthorized": 401,
    "forbidden": 403,
    "topic_not_found": 404,
    "router_not_found": 404,
    "not_found": 404,
    "router_cycle": 409,
    "topic_exists_incompatible": 409,
    "topic_not_empty": 409,
    "not_a_queue": 409,
    "payload_too_large": 413,
    "topic_full": 422,
    "throttled": 429,
    "internal": 500,
    "not_ready": 503,
}


class LedgerError(Exception):
    def __init__(self, code: str, message: str = "", **detail):
        super().__init__(message or code)
        self.code, self.status, self.detail = code, STATUS[code], detail
