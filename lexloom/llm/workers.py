"""Memory of Python workers, which live on after a task and share their executor with others."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def release() -> None:
    """Give freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lean(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A generator of batches that gives its memory back at the end of its task."""

    @functools.wraps(run)
    def wrapped(*args, **options):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(*args, **options)
        finally:
            release()

    return wrapped
