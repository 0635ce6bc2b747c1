"""Cutting texts: one linear pass over each, in Arrow batches that are bounded by bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is stripped from texts and chunks.
BLANKS = " \t\n\x0b\x0c\r"
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> None:
    """Arrow batches of few bytes, as one text may have megabytes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _codes(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _last(cuts: np.ndarray, above: int, upto: int) -> int:
    """The last of the sorted ``cuts`` that is over ``above`` and at most ``upto``; 0 if there is none."""
    k = int(np.searchsorted(cuts, upto, "right"))
    return int(cuts[k - 1]) if k and cuts[k - 1] > above else 0


def ranked_cuts(text: str) -> list[tuple[np.ndarray, int, int]]:
    """Places to cut by rank: before a heading, after a blank line, after a line. With each, how far past the start it must be, and how much of the text behind it the slice must still have room for."""
    line = np.flatnonzero(_codes(text) == 10)
    after = np.append(_codes(text), 0)[line + 1] if len(line) else line
    return [(line[after == 35] + 1, 1, 1), (line[after == 10] + 2, 2, 0), (line + 1, 1, 0)]


def slice_ranges(text: str, most: int) -> Iterator[tuple[int, int]]:
    """Gap-free ranges of at most ``most`` characters, each cut at the last place of the best rank that it holds, or else at its full length."""
    n, start, ranks = len(text), 0, ranked_cuts(text) if len(text) > most else []
    while n - start > most:
        found = (_last(cuts, start + past, start + most - room) for cuts, past, room in ranks)
        stop = next((c for c in found if c), start + most)
        yield start, stop
        start = stop
    yield start, n


def chunk_ranges(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Overlapping ranges: each ends at the last blank beyond the overlap, if there is one, and the next begins ``overlap`` characters before that, or at what follows that is no blank."""
    codes, n, start = _codes(text), len(text), 0
    spaces, words = np.flatnonzero(codes == 32), np.flatnonzero((codes != 32) & ((codes < 9) | (codes > 13)))
    while start < n:
        stop = min(start + size, n)
        if stop < n:
            stop = _last(spaces, start + overlap, stop) or stop
        yield start, stop
        if stop >= n:
            return
        k = np.searchsorted(words, max(stop - overlap, start + 1))
        start = int(words[k]) if k < len(words) else n


def _each(of: Callable[[str], list[tuple]], kind: str, fields: pa.DataType, text: Column) -> Column:
    """Array of what ``of`` gives for each text; a null text gives none."""

    @F.arrow_udf(f"array<struct<{kind}>>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[] if t is None else of(t) for t in texts.to_pylist()], pa.list_(fields))

    return run(text)


def sliced(text: Column, most: int) -> Column:
    """``array<struct<start, end>>``: see ``slice_ranges``; none of an empty text."""
    fields = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return _each(lambda t: [{"start": a, "end": b} for a, b in slice_ranges(t, most)] if t else [], "start: bigint, end: bigint", fields, text)


def chunked(text: Column, size: int, overlap: int) -> Column:
    """``array<struct<start, end, chunk>>`` of the stripped text, chunks stripped too; blank ones aren't there."""
    fields = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chunk", pa.string())])

    def of(t: str) -> list[dict]:
        body = t.strip(BLANKS)
        every = ((a, b, body[a:b].strip(BLANKS)) for a, b in chunk_ranges(body, size, overlap))
        return [{"start": a, "end": b, "chunk": c} for a, b, c in every if c]

    return _each(of, "start: bigint, end: bigint, chunk: string", fields, text)


def halves(text: str, start: int, end: int) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """A range in two, after the first line end from its middle on, or at its middle; None if it has one character or none."""
    if end - start <= 1:
        return None
    middle = (start + end) // 2
    line = text.find("\n", middle, end) + 1
    cut = line if start < line < end else middle
    return (start, cut), (cut, end)
