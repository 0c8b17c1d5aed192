"""Tables that Python workers keep between tasks.

Spark uses a worker again for tasks of other operators. A task claims the tables
it will use; all others in its process are emptied and their memory returned, so
a worker never holds more than one operator's tables.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable

import pyarrow as pa

_tables: dict[str, Callable[[], object]] = {}
_claimed: set[str] | None = None


def register(name: str, clear: Callable[[], object]) -> None:
    _tables[name] = clear


def claim(*names: str) -> None:
    global _claimed
    if _claimed == set(names):
        return
    _claimed = set(names)
    for name, clear in _tables.items():
        if name not in names:
            clear()
    trim()


def trim() -> None:
    """Give memory that nothing uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only some C libraries have it
        pass


def worker(*names: str):
    """Marks a function of Arrow batches that runs in workers: it claims these tables, and at its end an idle worker holds no more than them."""

    def marked(function):
        @functools.wraps(function)
        def run(batches):
            claim(*names)
            try:
                yield from function(batches)
            finally:
                trim()

        return run

    return marked
