"""Errors of the engine."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors raised by the engine itself."""


class TypeMismatch(EngineError):
    """Operands or values don't have the type that is asked for."""


class InvalidOperandTypes(TypeMismatch):
    """An operator isn't defined on these types."""


class ColumnOutOfBounds(EngineError):
    """No such column, by position or by name."""


class DivisionByZero(EngineError):
    """A constant division by zero."""


class UnexpectedNull(EngineError):
    """NULL where a value is needed."""


class UnknownFunction(EngineError):
    """No such function."""


class FunctionArgumentCount(EngineError):
    """Wrong number of arguments."""


class ConstraintError(EngineError):
    """A row or a statement doesn't fit its table."""


class CatalogError(EngineError):
    """A table or an index is missing or exists already."""


class ConflictError(EngineError):
    """Another transaction has committed a change to the same table."""


class TransactionError(EngineError):
    """A transaction statement in the wrong state."""


class SqlError(EngineError):
    """A statement that can't be read."""
