"""One costly object in each Python worker: a vocabulary, a scorer, with the words it remembers.

Workers live on from stage to stage. What an operator left behind goes when another one starts, and freed memory goes
back to the system, so a job of several operators needs no more than its greatest one.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_held: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """The worker's object of this key; any other one is dropped first."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Drops what is kept. Does nothing in a worker that keeps nothing."""
    if _held:
        _held.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Hands unused memory of Arrow and, where it can, of the C library back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library has no such call
        pass
