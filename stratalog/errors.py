"""Errors of the engine: one class per status code."""

from __future__ import annotations


class EngineError(Exception):
    code = "UNKNOWN"

    def __str__(self) -> str:
        return super().__str__() or self.code


class InvalidArgument(EngineError):
    code = "INVALID_ARGUMENT"


class NotFound(EngineError):
    code = "NOT_FOUND"


class AlreadyExists(EngineError):
    code = "ALREADY_EXISTS"


class FailedPrecondition(EngineError):
    code = "FAILED_PRECONDITION"


class Aborted(EngineError):
    code = "ABORTED"


class Unimplemented(EngineError):
    code = "UNIMPLEMENTED"


class Internal(EngineError):
    code = "INTERNAL"
