"""Memory of Python workers, which Spark uses again for later stages.

What a stage has freed stays with its worker unless it is given back, and what it remembers (such as the words of a
tokenizer) stays while stages that don't need it run.
"""

from __future__ import annotations

import ctypes

_remembered: list = []


def remembered(cached):
    """Registers a function under functools.lru_cache, whose results go when work of another kind begins."""
    _remembered.append(cached)
    return cached


def release(keep=None) -> None:
    """Forgets what was remembered, but for that of `keep`, and gives freed memory back where the C library can."""
    import pyarrow as pa

    for cached in _remembered:
        if cached is not keep:
            cached.cache_clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(f):
    """f of one group, for applyInPandas; memory is given back before and after."""

    def run(pdf):
        release()
        out = f(pdf)
        release()
        return out

    return run


def lean_pair(f):
    """`lean` for a cogroup's two sides."""

    def run(left, right):
        release()
        out = f(left, right)
        release()
        return out

    return run
