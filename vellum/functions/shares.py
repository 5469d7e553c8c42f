"""Arrow columns in shares: what Python makes of one share is given out before the next is read.

An Arrow batch holds up to 10,000 rows, however long their texts are, and what they become as Python objects is many times
as large; so a worker's memory would follow the batch. A share has few rows and bytes; a row that alone has more is a share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

ROWS, BYTES = 256, 1 << 20


def cut(columns: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    """The rows of a batch in order, in slices of at most ROWS rows and, from two rows on, BYTES."""
    n = len(columns[0])
    if n > 1 and (n > ROWS or sum(c.nbytes for c in columns) > BYTES):
        yield from cut(tuple(c.slice(0, n // 2) for c in columns))
        yield from cut(tuple(c.slice(n // 2) for c in columns))
    else:
        yield columns


def served(f: Callable[..., pa.Array], batches: Iterator[pa.Array | tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """f of each share of each batch, for the body of an iterator UDF."""
    for batch in batches:
        yield from (f(*share) for share in cut(batch if isinstance(batch, tuple) else (batch,)))


def gathered(f: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """f of each share of a batch, together as one array: for UDFs that give a batch for a batch, so that Spark runs several of them in one worker."""
    return pa.concat_arrays([f(*share) for share in cut(columns)])
