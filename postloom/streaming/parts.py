"""Parts of a streamed table, folded in levels so that a read never sees all batches.

A batch writes a part of level 0 under its own number. Part n of level k holds
what ``FAN ** k`` batches from ``n * FAN ** k`` on wrote, and is made when the last of
them is there, of ``FAN`` parts of the level below. A read takes the largest parts
that cover the batches: fewer than ``FAN`` a level, so the number of parts read grows
with the logarithm of the batches. A part counts once its ``_SUCCESS`` is written;
parts below a fold stay until the next fold of their level, so a batch that is repeated
after a failure finds the state before it and replaces its own part and folds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Parts of one level that make one of the next.
FAN = 8

Read = Callable[[list[str]], DataFrame]
Write = Callable[[DataFrame, str], None]


def _path(table: str, level: int, number: int) -> str:
    return f"{table}/level={level}/part={number}"


def _files(spark: SparkSession, path: str):
    """The file system of ``path`` and the path, as the session sees them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def complete(spark: SparkSession, table: str) -> set[tuple[int, int]]:
    """(level, number) of every part whose write ended."""
    fs, at = _files(spark, f"{table}/level=*/part=*/_SUCCESS")
    names = [s.getPath().getParent() for s in fs.globStatus(at) or []]
    return {(int(p.getParent().getName().split("=")[1]), int(p.getName().split("=")[1])) for p in names}


def cover(there: set[tuple[int, int]], until: int | None = None) -> list[tuple[int, int]]:
    """The largest parts that hold the batches from 0 on, up to ``until`` without it."""
    chosen, at = [], 0
    levels = sorted({k for k, _ in there}, reverse=True)
    while until is None or at < until:
        fits = (k for k in levels if at % FAN**k == 0 and (k, at // FAN**k) in there and (until is None or at + FAN**k <= until))
        level = next(fits, None)
        if level is None:
            break
        chosen.append((level, at // FAN**level))
        at += FAN**level
    if until is not None and at < until:
        raise ValueError(f"batches {at} to {until - 1} are missing")
    return chosen


def paths(spark: SparkSession, table: str, until: int | None = None) -> list[str]:
    return [_path(table, *part) for part in cover(complete(spark, table), until)]


def add(spark: SparkSession, table: str, batch: int, rows: DataFrame, read: Read, fold: Callable[[DataFrame], DataFrame], write: Write) -> None:
    """Write the part of ``batch`` and the folds that it completes.

    fold makes the rows of several parts into those of one; it must not depend on
    how batches are grouped.
    """
    write(rows, _path(table, 0, batch))
    level = 1
    while (batch + 1) % FAN**level == 0:
        number = (batch + 1) // FAN**level - 1
        below = [_path(table, level - 1, n) for n in range(number * FAN, (number + 1) * FAN)]
        write(fold(read(below)), _path(table, level, number))
        for n in range((number - 1) * FAN, number * FAN) if number else ():
            fs, old = _files(spark, _path(table, level - 1, n))
            fs.delete(old, True)
        level += 1
