"""Errors that operators raise before any job runs."""

from __future__ import annotations


class SonoplanError(ValueError):
    """Base of all errors of this library."""


class InvalidInput(SonoplanError):
    """A parameter or an input is outside what an operator takes."""


class DimensionMismatch(SonoplanError):
    def __init__(self, expected: int, got: int):
        super().__init__(f"expected {expected}, got {got}")
        self.expected, self.got = expected, got


class BackendError(SonoplanError):
    """A transform failed."""


class InternalError(SonoplanError):
    """A state that should not occur."""


def require(condition: bool, message: str) -> None:
    if not condition:
        raise InvalidInput(message)
