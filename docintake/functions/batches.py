"""Python over a table's rows in Arrow batches, with memory that depends neither on batches nor on what rows give."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa

_TYPES = {"bigint": pa.int64(), "string": pa.string()}
#: Characters, read or made, that are held as Python's own objects at a time, besides those of one row.
PIECE = 1 << 20


def _pieces(batch: pa.RecordBatch, most: int):
    """Row slices of a batch of about ``most`` bytes; one row is never cut."""
    rows = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for start in range(0, batch.num_rows, rows):
        piece = batch.slice(start, rows)
        if piece.num_rows > 1 and piece.nbytes > 4 * most:
            half = piece.num_rows // 2
            yield from _pieces(piece.slice(0, half), most)
            yield from _pieces(piece.slice(half), most)
        else:
            yield piece


def exploded(rows: Callable[..., Iterable[tuple]], schema: str, most: int = PIECE):
    """A mapInArrow function: for each row the tuples (``schema``: names with bigint or string) that ``rows`` gives for
    its values. Batches are read in pieces, and what was made is handed on as soon as it is as large as a piece."""
    fields = [x.split() for x in schema.split(", ")]
    into = pa.schema([(name, _TYPES[kind]) for name, kind in fields])

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), into.types, strict=True)], schema=into)

    def run(batches):
        out, size = [], 0
        for batch in batches:
            for piece in _pieces(batch, most):
                for values in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    for row in rows(*values):
                        out.append(row)
                        size += 64 + sum(len(x) for x in row if isinstance(x, str))
                        if size > most:
                            yield batch_of(out)
                            out, size = [], 0
            if out:
                yield batch_of(out)
                out, size = [], 0

    return run
