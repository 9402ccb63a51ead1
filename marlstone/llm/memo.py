"""What Python workers keep between tasks: bounded memos, and one operator's models at a time.

A worker process outlives its tasks and serves whichever stage comes next, so what one operator
leaves in it adds to the next one's memory.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_kept: dict[Hashable, Any] = {}


def hand_back() -> None:
    """Return freed memory to the system; allocators hold on to it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def of_worker(key: Hashable, make: Callable[[], Any] = lambda: None) -> Any:
    """What this worker keeps under a key for later tasks, made where it lacks; what it kept under another key goes."""
    if key not in _kept:
        _kept.clear()
        hand_back()
        _kept[key] = make()
    return _kept[key]


class Memo:
    """A bounded memo in two generations: what is used again outlives the young generation."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, keys: set) -> list:
        """Bring known keys into the young generation and return the unknown ones."""
        if len(self.young) + len(keys) > self.limit:
            self.old, self.young = self.young, {}
        rest = []
        for k in keys.difference(self.young):
            if (v := self.old.get(k)) is None:
                rest.append(k)
            else:
                self.young[k] = v
        return rest
