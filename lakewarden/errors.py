"""Structured errors: a code, a message that names nothing hidden, and the extras that the code requires."""

from __future__ import annotations

# The public error codes.
CODES = (
    "E_PARSE", "E_WRITE_FORBIDDEN", "E_UNKNOWN_TABLE", "E_UNKNOWN_COLUMN", "E_TYPE_MISMATCH",
    "E_POLICY_DENIED", "E_TIMEOUT", "E_RESULT_TOO_LARGE", "E_UNVERIFIED_MODEL",
)
REQUIRED = {
    "E_WRITE_FORBIDDEN": ("statementType",), "E_UNKNOWN_TABLE": ("didYouMean",), "E_UNKNOWN_COLUMN": ("didYouMean",), "E_TYPE_MISMATCH": ("expected", "actual"),
    "E_POLICY_DENIED": ("policy",), "E_TIMEOUT": ("timeoutMs",), "E_RESULT_TOO_LARGE": ("limit",), "E_UNVERIFIED_MODEL": ("model",),
}


class GovernanceError(Exception):
    """`detail` is the contract; the text is for people."""

    def __init__(self, code: str, message: str, **extras):
        if code not in CODES:
            raise ValueError(f"unknown error code {code}")
        if missing := [k for k in REQUIRED.get(code, ()) if k not in extras]:
            raise ValueError(f"{code} lacks {', '.join(missing)}")
        super().__init__(message)
        self.code = code
        self.detail = {"code": code, "message": message} | {k: v for k, v in extras.items() if v is not None}


class JoinPathError(Exception):
    """No route between two models, or several of the same length."""

    def __init__(self, code: str, message: str, routes: tuple[str, ...] = ()):
        super().__init__(message)
        self.code, self.routes = code, routes


def syntax_error(message: str, line: int | None = None, column: int | None = None, hint: str | None = None) -> GovernanceError:
    return GovernanceError("E_PARSE", f"Could not parse SQL: {message}", location=None if line is None else {"line": line, "column": column}, hint=hint)


def write_forbidden(kind: str, hint: str | None = None) -> GovernanceError:
    return GovernanceError("E_WRITE_FORBIDDEN", f"{kind.upper()} is not permitted; this connection is read-only.", statementType=kind, hint=hint or "Only SELECT statements and read-only CTEs are allowed.")


def unknown(what: str, name: str, near: list[str]) -> GovernanceError:
    return GovernanceError(f"E_UNKNOWN_{what.upper()}", f"Unknown {what}: {name}", didYouMean=near, hint=f"Did you mean: {', '.join(near)}?" if near else None)


def policy_denied(policy: str, message: str) -> GovernanceError:
    return GovernanceError("E_POLICY_DENIED", message, policy=policy)
