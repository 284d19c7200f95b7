"""Typed errors. Every error has a code; quarantine columns carry the same codes."""

from __future__ import annotations

#: The codes of the API.
CODES = (
    "not-copc", "unsupported-header-layout", "unsupported-point-format", "wkt-not-in-vlrs", "malformed-hierarchy",
    "crs-code-not-found", "crs-not-registered", "crs-definition-unusable",
    "range-unsupported", "range-request-failed", "range-network", "range-timeout", "content-range-unreadable", "content-range-mismatch", "invalid-byte-range", "unknown-tile-request",
    "range-request-rejected", "lease-already-released",
    "zero-point-chunk", "position-count-mismatch", "decode-job-not-admitted", "worker-task-failed",
    "invalid-token-base", "invalid-source-url",
)


class LoomError(Exception):
    """Base of all errors; details are kept as attributes and survive pickling between workers and driver."""

    code = "worker-task-failed"

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.message, self.details = message, details
        self.__dict__.update(details)

    def __reduce__(self):
        return _again, (self.code, self.message, self.details)

    def to_wire(self) -> dict:
        return {"code": self.code, "name": type(self).__name__, "message": self.message, "details": self.details}


def _class(code: str) -> type[LoomError]:
    return type("".join(p.capitalize() for p in code.split("-")) + "Error", (LoomError,), {"code": code, "__module__": __name__})


BY_CODE: dict[str, type[LoomError]] = {c: _class(c) for c in CODES}
globals().update({k.__name__: k for k in BY_CODE.values()})


def error(code: str, message: str, **details) -> LoomError:
    """An error of a code; an unknown code becomes a failed task."""
    return BY_CODE.get(code, BY_CODE["worker-task-failed"])(message, **details)


def _again(code: str, message: str, details: dict) -> LoomError:
    return error(code, message, **details)


def from_wire(wire: dict) -> LoomError:
    return error(wire.get("code", ""), wire.get("message", ""), **wire.get("details", {}))
