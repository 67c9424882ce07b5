"""What Python workers have in common: slices of bounded size, and what a worker keeps from one task to the next."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a worker turns into Python objects or arrays at once.
SLICE_BYTES = 1 << 20
_HELD: list[tuple[Hashable, Any]] = []


def sliced(batches: Iterator[pa.RecordBatch], column: int, rows: int = 4096, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of at most ``rows`` rows and ``most`` bytes in ``column``; a longer text has one to itself.

    When they end, freed memory goes back to the machine, as the process waits for other tasks.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, side="right"))))
            yield batch.slice(at, end - at)
            at = end
    give_back()


def give_back() -> None:
    """Memory that was freed, but that Arrow and the C library keep for later, goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What was made for ``key`` before; else what was made for another key goes, and it is made now."""
    if not _HELD or _HELD[0][0] != key:
        release()
        _HELD.append((key, make()))
    return _HELD[0][1]


def release() -> None:
    """Operators that keep nothing call this, so that nothing of others stays beside them."""
    if _HELD:
        _HELD.clear()
        give_back()
