"""Rows of Arrow batches in Python, one at a time. A batch may hold 64 MB or 10,000 rows; as Python values all of it would take
several times that, in each worker of an executor."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa

#: Bytes of results that are Python values until they become Arrow; a single result may pass them.
RESULT_BYTES = 1 << 20


def _size(value) -> int:
    """About the bytes of a result."""
    if isinstance(value, str):
        return 16 + len(value)
    parts = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return 16 + sum(_size(x) for x in parts)


def by_row(f: Callable, columns: Sequence[pa.Array], kind: pa.DataType) -> pa.Array:
    """f of each row's values, as one array of the kind."""
    out, waiting, size = [], [], 0
    for row in zip(*columns, strict=True):
        waiting.append(f(*[x.as_py() for x in row]))
        size += _size(waiting[-1])
        if size >= RESULT_BYTES:
            out.append(pa.array(waiting, kind))
            waiting, size = [], 0
    whole = pa.concat_arrays([*out, pa.array(waiting, kind)])
    # a worker serves later tasks too: what Arrow has freed goes back
    pa.default_memory_pool().release_unused()
    return whole
