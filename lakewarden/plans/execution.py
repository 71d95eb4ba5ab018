"""Bounded execution: a time limit that cancels the Spark jobs, and an exact byte cap on the rows as JSON, met row by row."""

from __future__ import annotations

import base64
import datetime as dt
import decimal
import json
import math
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Row

from ..errors import GovernanceError
from .gate import FACET_TOO_LARGE, MAX_ROWS, Plan

TIMEOUT_MS, MAX_BYTES = 30_000, 10 * 1024 * 1024


def plain(v):
    """A value as JSON has it: times in ISO form with milliseconds, decimals as numbers in text, bytes in base64."""
    if isinstance(v, Row):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {str(k): plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dt.datetime):
        return f"{v:%Y-%m-%dT%H:%M:%S}.{v.microsecond // 1000:03d}Z"
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, (bytes, bytearray)):
        return base64.b64encode(bytes(v)).decode()
    return None if isinstance(v, float) and not math.isfinite(v) else v


def as_json(v) -> str:
    return json.dumps(plain(v), separators=(",", ":"), ensure_ascii=False)


class ByteCap:
    """Counts the UTF-8 bytes of a JSON array as it grows; raises at the row that crosses the cap."""

    def __init__(self, limit: int):
        self.limit, self.bytes, self.rows = limit, 2, 0

    def add(self, row) -> None:
        self.bytes += len(as_json(row).encode()) + (self.rows > 0)
        self.rows += 1
        if self.bytes > self.limit:
            raise GovernanceError("E_RESULT_TOO_LARGE", f"The result is larger than {self.limit} bytes.", limit=self.limit, actual=self.bytes, hint="Select fewer columns or rows, or aggregate.")


def check_scalar(value, limit: int = MAX_BYTES):
    n = len(as_json(value).encode())
    if n > limit:
        raise GovernanceError("E_RESULT_TOO_LARGE", f"The result is larger than {limit} bytes.", limit=limit, actual=n)
    return value


def execute(plan: Plan, timeout_ms: int = TIMEOUT_MS, max_bytes: int = MAX_BYTES) -> list[dict]:
    """The plan's rows. A run that takes too long is cancelled on the cluster; the session stays of use."""
    if not isinstance(plan, Plan):
        raise TypeError("only plans of the gate are executed")
    if isinstance(timeout_ms, bool) or not isinstance(timeout_ms, int) or timeout_ms <= 0:
        raise ValueError("the time limit is a positive number of milliseconds")
    sc = plan.frame.sparkSession.sparkContext
    group, late = f"lakewarden-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    # A job may start just after a cancellation: ask again until the run has ended.
    over = threading.Event()

    def watch() -> None:
        if not over.wait(timeout_ms / 1000):
            while not over.is_set():
                stop()
                over.wait(0.2)

    watcher = threading.Thread(target=watch, daemon=True)
    sc.setJobGroup(group, "governed query", interruptOnCancel=True)
    watcher.start()
    cap, out = ByteCap(max_bytes), []
    try:
        for row in _rows(plan):
            cap.add(row)
            out.append(row)
            if late.is_set():
                break
    except GovernanceError:
        sc.cancelJobGroup(group)
        raise
    except Exception as e:
        if not late.is_set():
            if FACET_TOO_LARGE in str(e):
                raise GovernanceError("E_RESULT_TOO_LARGE", f"An arm of $facet has more than {MAX_ROWS} rows.", limit=MAX_ROWS, hint="Group, match or limit inside the arm.") from None
            raise
    finally:
        over.set()
        watcher.join(5)
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    if late.is_set():
        raise GovernanceError("E_TIMEOUT", f"The query ran longer than {timeout_ms} ms and was stopped.", timeoutMs=timeout_ms)
    return out


def _rows(plan: Plan) -> Iterator[dict]:
    for row in plan.frame.toLocalIterator(prefetchPartitions=False):
        yield row.asDict(recursive=True)


def row_count(result) -> int:
    return len(result) if isinstance(result, list) else int(result is not None)
