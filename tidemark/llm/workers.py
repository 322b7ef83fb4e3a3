"""What a Python worker keeps between tasks, and what it gives back.

Spark reuses its Python workers, so whatever one operator leaves in memory adds to the next one's.
Each operator's caches are bounded and go when the worker takes up another operator; after a task the
allocators return what they hold.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

_CACHES: dict[str, dict] = {}
#: Resident bytes below which a worker is small enough as it is.
SMALL = 120 << 20


def cache(owner: str) -> dict:
    """The owner's cache; those of other owners are emptied."""
    if owner not in _CACHES:
        _CACHES.clear()
        _CACHES[owner] = {}
    return _CACHES[owner]


def resident() -> int:
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096
    except OSError:
        return 0


def trim() -> None:
    """Hand free memory back to the system."""
    if resident() < SMALL:
        return
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(owner: str, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run for mapInArrow, with the caches of other operators dropped before and memory trimmed after."""

    def inner(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache(owner)
        try:
            yield from run(batches)
        finally:
            trim()

    return inner


def lean_group(owner: str, run: Callable[[pa.Table], pa.Table]):
    """The same for applyInArrow."""

    def inner(t: pa.Table) -> pa.Table:
        cache(owner)
        try:
            return run(t)
        finally:
            trim()

    return inner


def slices(batches: Iterable[pa.RecordBatch], chars: int) -> Iterator[tuple[list, list[str]]]:
    """(first column, second column's texts, null as empty) of some rows at a time, about `chars` characters or one row."""
    ids, texts, held = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids.append(i)
            texts.append(t.as_py() or "")
            held += len(texts[-1]) + 50
            if held >= chars:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts
