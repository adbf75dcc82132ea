"""Errors that a caller can tell apart, with their exit codes and documents."""

from __future__ import annotations

import json


class TrellisError(RuntimeError):
    """Something that ends a command: code names it, exit_code is what a program returns."""

    code, exit_code = "INTERNAL_ERROR", 4

    def __init__(self, message: str, command: str = "unknown", details: dict | None = None):
        super().__init__(message)
        self.message, self.command, self.details = message, command, details or {}

    def document(self) -> str:
        """The error as one JSON document."""
        error = {"code": self.code, "message": self.message, "details": self.details}
        return json.dumps({"schema": "trellis/error@v1", "command": self.command, "ok": False, "error": error})


class UsageError(TrellisError, ValueError):
    """A request that makes no sense."""

    code, exit_code = "USAGE_ERROR", 2


class StaleIndex(TrellisError):
    """The working tree is newer than the snapshot."""

    code, exit_code = "INDEX_STALE", 3


class PartialData(TrellisError):
    """An answer that lacks some of its data, where all of it was asked for."""

    code, exit_code = "PARTIAL_DATA", 5
