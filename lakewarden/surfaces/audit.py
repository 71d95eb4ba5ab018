"""The audit log: one JSON line for each execution, appended and never rewritten, without secrets."""

from __future__ import annotations

import contextlib
import contextvars
import datetime as dt
import json
import os
import re
import threading
import time
from collections.abc import Iterator, Sequence

from ..errors import GovernanceError

NO_POLICIES = "none applied"
_principal: contextvars.ContextVar[str | None] = contextvars.ContextVar("principal", default=None)


def parse_principal(value) -> str:
    if not isinstance(value, str) or not 1 <= len(value.strip()) <= 256 or re.search(r"[\x00-\x1f\x7f]", value):
        raise ValueError("a principal has 1 to 256 characters and no control characters")
    return value.strip()


@contextlib.contextmanager
def as_principal(value: str) -> Iterator[str]:
    token = _principal.set(parse_principal(value))
    try:
        yield _principal.get()
    finally:
        _principal.reset(token)


def current_principal() -> str:
    """Fails closed."""
    if (p := _principal.get()) is None:
        raise PermissionError("E_PRINCIPAL_REQUIRED")
    return p


def redact(text: str, secrets: Sequence[str] = ()) -> str:
    for s in sorted((s for s in secrets if s), key=len, reverse=True):
        text = text.replace(s, "[REDACTED]")
    text = re.sub(r"([a-z][a-z0-9+.-]*://)[^/\s:@]+:[^/\s@]+@", r"\1[REDACTED]@", text, flags=re.I)
    text = re.sub(r'("password"\s*:\s*")[^"]*(")', r"\1[REDACTED]\2", text, flags=re.I)
    return re.sub(r"(password\s*=\s*)[^\s;&]+", r"\1[REDACTED]", text, flags=re.I)


class AuditLog:
    def __init__(self, path: str, secrets: Sequence[str] = ()):
        self.path, self.secrets, self._lock = path, tuple(secrets), threading.Lock()

    def append(self, record: dict) -> None:
        line = redact(json.dumps(record, ensure_ascii=False, sort_keys=True), self.secrets)
        with self._lock:
            fd = os.open(self.path, os.O_WRONLY | os.O_APPEND | os.O_CREAT, 0o600)
            with os.fdopen(fd, "a", encoding="utf-8") as f:
                f.write(line + "\n")

    @contextlib.contextmanager
    def execution(self, source: str, sql: str, principal: str) -> Iterator[dict]:
        """Exactly one record, whatever happens; the body fills appliedPolicies and rowCount."""
        at, seen = time.monotonic(), {"appliedPolicies": [], "rowCount": 0}
        out, extra = "success", {}
        try:
            yield seen
        except GovernanceError as e:
            out = "timeout" if e.code == "E_TIMEOUT" else "denied" if e.code in ("E_WRITE_FORBIDDEN", "E_POLICY_DENIED") else "failure"
            extra = {"errorCode": e.code} | ({"denialReason": str(e)} if out == "denied" else {})
            raise
        except Exception as e:
            out, extra = "failure", {"errorCode": type(e).__name__}
            raise
        finally:
            self.append(
                {"timestamp": dt.datetime.now(dt.UTC).isoformat(), "principal": principal, "source": source, "sql": sql, "appliedPolicies": list(seen["appliedPolicies"]) or [NO_POLICIES], "rowCount": seen["rowCount"], "durationMs": round((time.monotonic() - at) * 1000), "outcome": out} | extra
            )
