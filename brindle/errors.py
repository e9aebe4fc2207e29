"""Errors carry the numeric status of the row API."""

from __future__ import annotations


class EngineError(Exception):
    """Not open, bad arguments, nested BEGIN, a row that is not there."""

    code = -1


class NotFound(EngineError):
    """No such table or column."""

    code = -2


class Duplicate(EngineError):
    """The table exists, or a primary or unique key does."""

    code = -3


class Full(EngineError):
    """Too many tables."""

    code = -4


class ForeignKeyViolation(EngineError):
    """Reserved: foreign keys are kept as metadata and can be audited, but are not enforced."""

    code = -5


class NullViolation(EngineError):
    """NULL in a NOT NULL column."""

    code = -6


class NoTransaction(EngineError):
    """COMMIT or ROLLBACK without BEGIN."""

    code = -7


class SqlSyntaxError(EngineError):
    """A statement that the grammar does not have."""

    def __init__(self, what: str):
        super().__init__(f"Syntax Error: {what}")


class BindError(EngineError):
    """A name or a literal that does not fit the tables."""
