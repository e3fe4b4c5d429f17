"""Memory of Python workers, which Spark keeps and uses again for the tasks of later stages.

What a task has freed mostly stays with its process: the C library and Arrow hold it for
later.  An executor counts all of its workers, so it is handed back at the end of a task,
and tables that only tokenizing stages need go when another stage begins.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa

_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform.startswith("linux") else None


def trim() -> None:
    """Memory that is free in this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim:
        _malloc_trim(0)


def drop_encoders() -> None:
    if tokens := sys.modules.get(f"{__package__}.tokens"):
        tokens.close()


def tidy(run: Callable, encodes: bool = False) -> Callable:
    """A function for mapInArrow that leaves its worker small; only one that `encodes` keeps the tokenizers' tables."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes:
            drop_encoders()
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def tidy_group(run: Callable) -> Callable:
    """As tidy, of a function for applyInPandas on one group."""

    def group(rows):
        try:
            return run(rows)
        finally:
            trim()

    return group
