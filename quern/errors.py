"""What store operations raise, and what failures of Spark become."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException


class PersistenceError(Exception):
    """Any failure of a store operation."""


class EntityNotFound(PersistenceError):
    """A strict lookup found no row."""


class DuplicateEntity(PersistenceError):
    """A row with the same unique key is there already."""


class VersionConflict(PersistenceError):
    """The stored version is not the expected one."""


class TransactionFailed(PersistenceError):
    """A commit was not made; the tables are as they were."""


class CommitConflict(TransactionFailed):
    """Another commit has changed what this one read or writes; nothing was written."""


class QueryFailed(PersistenceError):
    """A query is wrong: names, types, an overflow, several rows instead of one."""


class StorageLimit(PersistenceError):
    """There is no room left."""


_FULL = ("no space left", "disk quota", "quota exceeded")
_WRONG = ("ARITHMETIC_OVERFLOW", "NUMERIC_VALUE_OUT_OF_RANGE", "SCALAR_SUBQUERY_TOO_MANY_ROWS", "CAST_OVERFLOW", "DIVIDE_BY_ZERO")


def translated(error: Exception, what: str) -> PersistenceError:
    """The store's error for one that Spark or the file system raised."""
    if isinstance(error, PersistenceError):
        return error
    text, condition = str(error), (error.getCondition() or "" if isinstance(error, PySparkException) else "")
    if any(w in text.lower() for w in _FULL):
        return StorageLimit(f"{what}: {text.splitlines()[0]}")
    if condition.startswith("PATH_NOT_FOUND") or "FileNotFoundException" in text:
        return EntityNotFound(f"{what}: {text.splitlines()[0]}")
    if isinstance(error, AnalysisException) or any(w in condition or w in text for w in _WRONG):
        return QueryFailed(f"{what}: {text.splitlines()[0]}")
    return PersistenceError(f"{what}: {text.splitlines()[0] if text else type(error).__name__}")


@contextmanager
def translating(what: str, otherwise: type[PersistenceError] | None = None) -> Iterator[None]:
    """Raises the store's errors in place of others; unknown ones become `otherwise`."""
    try:
        yield
    except Exception as e:
        found = translated(e, what)
        raise (otherwise(str(found)) if otherwise and type(found) is PersistenceError and not isinstance(e, PersistenceError) else found) from e


@contextmanager
def spark_errors(what: str) -> Iterator[None]:
    """Raises the store's errors in place of Spark's; others, as those of a caller's own stages, pass."""
    try:
        yield
    except (PySparkException, Py4JError) as e:
        raise translated(e, what) from e
