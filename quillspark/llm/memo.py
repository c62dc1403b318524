"""What worker processes keep between tasks, and how little of it at once."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa


class Memo:
    """Values by key in two generations of at most ``size`` entries each.

    A full young generation becomes the old one, which is then forgotten; what
    is asked for again in time moves back. ``young.get`` is the quick way in,
    and ``miss`` what to do if it gives None.
    """

    def __init__(self, size: int, make: Callable):
        self.size, self.make = size, make
        self.young: dict[Hashable, object] = {}
        self.old: dict[Hashable, object] = {}

    def miss(self, key):
        """The value of a key that is not young, from the old generation or made anew."""
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self.young) >= self.size:
            self.old = self.young.copy()
            self.young.clear()
        self.young[key] = value
        return value

    def __call__(self, key):
        value = self.young.get(key)
        return self.miss(key) if value is None else value


_tool: tuple | None = None


def tool(key: Hashable, make: Callable):
    """The one large tool that this worker process keeps; another key replaces it."""
    global _tool
    if _tool is None or _tool[0] != key:
        release()
        _tool = (key, make())
    return _tool[1]


def release() -> None:
    """Let go of the tool that another operator's tasks have left in this process."""
    global _tool
    if _tool is not None:
        _tool = None
        trim()


def trim() -> None:
    """Collect what is not used any more, and let the C library give it back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches, rows: int = 512) -> Iterator:
    """Record batches cut small, so that few texts are Python objects at a time."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def texts(column) -> list[str]:
    """A string column as Python strings: null is empty, bytes that are no UTF-8 are U+FFFD."""
    return ["" if t is None else t.decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]
