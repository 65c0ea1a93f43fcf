"""What Python workers do for their own memory."""

from __future__ import annotations

from collections.abc import Iterator


def trim() -> None:
    """Give the worker's free memory back: workers live on, and what one operator has let go would add to the next one's."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def trimmed(run):
    """A function of Arrow batches that trims the worker's memory when it is through."""

    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return inner
