"""JSON snapshots of normalised calls and the choice of the newest good one."""

from __future__ import annotations

import logging
from collections.abc import Callable

from py4j.java_gateway import is_instance_of
from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException, PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from semcat.schema import CALL_SCHEMA, ORDER_COLUMN
from semcat.sources.paths import exists, subfolders

logger = logging.getLogger(__name__)

# Error conditions that say that a source is missing or broken, not that the code is.
SOURCE_ERRORS = (
    "PATH_NOT_FOUND",
    "FAILED_READ_FILE",
    "CANNOT_READ_FILE_FOOTER",
    "MALFORMED_RECORD_IN_PARSING",
    "UNABLE_TO_INFER_SCHEMA",
)
# Conditions that only say that something below them failed.
_WRAPPERS = ("TASK_WRITE_FAILED", "_LEGACY_ERROR_TEMP", "INTERNAL_ERROR")


def _causes(error: Exception) -> list[tuple[str, str | None, bool]]:
    """Class, error condition and whether it is an IOException, of an error and its causes, the innermost first."""
    java = error.java_exception if isinstance(error, Py4JJavaError) else getattr(error, "_origin", None)
    gateway = SparkContext._gateway
    found = []
    while java is not None and len(found) < 100:
        known = is_instance_of(gateway, java, "org.apache.spark.SparkThrowable")
        reading = is_instance_of(gateway, java, "java.io.IOException")
        found.append((java.getClass().getName(), java.getCondition() if known else None, reading))
        java = java.getCause()
    return found[::-1]


def _is_source_error(error: Exception) -> bool:
    """By the innermost cause that says anything: a missing or unreadable file, against an error of the code on the way."""
    if not isinstance(error, (PySparkException, Py4JJavaError)):
        return True
    if isinstance(error, PythonException):
        return False
    causes = _causes(error)
    if not causes and isinstance(error, PySparkException):
        causes = [(type(error).__name__, error.getCondition(), False)]
    for name, condition, reading in causes:
        if name.endswith("api.python.PythonException"):
            return False
        condition = (condition or "").split(".")[0]
        if condition and not condition.startswith(_WRAPPERS):
            return condition in SOURCE_ERRORS
        if reading:
            return True
    return False


SNAPSHOT_SCHEMA = T.StructType([*CALL_SCHEMA.fields, T.StructField(ORDER_COLUMN, T.LongType())])


def read_calls(spark: SparkSession, path: str, array_document: bool = False) -> DataFrame:
    """Calls from JSON lines, or from files that hold one JSON array each."""
    return spark.read.schema(SNAPSHOT_SCHEMA).json(path, multiLine=array_document)


def write_calls(calls: DataFrame, path: str) -> None:
    calls.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def latest_good_snapshot(spark: SparkSession, root: str) -> str | None:
    """Newest batch folder that was written to the end."""
    for name in reversed(subfolders(spark, root)):
        if exists(spark, f"{root}/{name}/_SUCCESS"):
            return f"{root}/{name}"
    return None


def _new_attempt(spark: SparkSession, root: str, batch: str) -> str:
    """A folder of its own for every attempt: no snapshot is ever overwritten."""
    attempts = [n for n in subfolders(spark, root) if n.rpartition(".")[0] == batch]
    return f"{root}/{batch}.{len(attempts):04d}"


def fresh_or_cached_calls(
    spark: SparkSession,
    fetch: Callable[[], DataFrame],
    cache_root: str,
    batch: str,
    failures: tuple[type[Exception], ...] = (OSError, PySparkException, Py4JJavaError),
) -> DataFrame:
    """Calls of a new batch, cached under its name; if they cannot be had, the
    newest cached ones; if there are none, the error.  Batch names sort by age.

    Only ``failures`` mean that the source cannot be had, and of Spark's own errors
    those whose innermost cause is a file that is missing or cannot be read; a failing
    function or a check that raises is a bug and stays an error.
    """
    target = _new_attempt(spark, cache_root, batch)
    try:
        write_calls(fetch(), target)
    except failures as error:
        if not _is_source_error(error):
            raise
        cached = latest_good_snapshot(spark, cache_root)
        if cached is None:
            raise
        logger.warning("no fresh calls (%s), using %s", error, cached)
        target = cached
    return read_calls(spark, target)
