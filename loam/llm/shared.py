"""What the operators share: tables that cut lineage, and samples of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

from loam.sources.shared import dropped, new_path, saved, settled, shared_dir

__all__ = ["dropped", "hashed_share", "lean", "new_path", "saved", "settled", "shared_dir"]


def hashed_share(n_rows: int, bound: int) -> int:
    """How many of 1,000,000 hash values to keep so that about ``bound`` of ``n_rows`` rows stay."""
    return 1_000_000 if n_rows <= bound else max(1, bound * 1_000_000 // n_rows)


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over a task's batches, after which its Python worker gives freed memory back to the system.

    Workers stay for a minute after their last task; what they keep would be missing to the executor's next step.
    """

    @wraps(work)
    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return run
