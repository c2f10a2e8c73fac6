"""Words and shingles of whole texts as numpy arrays, straight from Arrow buffers.

Words are the runs of bytes outside ``\\x20\\x09-\\x0D``. Words, shingles and sets
are known by 64-bit hashes from here on.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; a longer text is taken alone.
SLICE_BYTES = 400_000

_U = np.uint64


def _splitmix(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=_U) + _U(seed)) * _U(0x9E3779B97F4A7C15)
        return mix64(z)


def mix64(z: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


_BYTE = _splitmix(256, 7)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_BACK = pow(_STEP, -1, 2**64)


def release(task: bool = True) -> None:
    """Give freed memory back to the system: workers wait for their next task with it.

    At the end of a ``task`` what its functions leave behind is collected too.
    """
    if task:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def worker_store() -> dict:
    """What a worker process keeps from task to task.

    Row functions travel by value, and every task makes their modules' globals
    anew; this dictionary belongs to the process.
    """
    name = "_scoreframe_worker"
    return vars(sys.modules.setdefault(name, types.ModuleType(name)))


#: Powers of the step and of its inverse up to this number are kept.
_KEPT_POWERS = 2_000_000


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    store = worker_store()
    known = store.get("powers")
    if known is not None and len(known[0]) >= n:
        return known[0][:n], known[1][:n]
    found = []
    with np.errstate(over="ignore"):
        for base in (_STEP, _BACK):
            grown = np.full(n, base, _U)
            grown[0] = 1
            found.append(np.cumprod(grown, out=grown))
    if n <= _KEPT_POWERS:
        store["powers"] = found
    return found[0], found[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about ``limit`` bytes."""
    if len(column) == 0:
        return
    raw, offsets = buffers(column)
    row = 0
    while row < len(offsets) - 1:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = max(stop, row + 1)
        yield row, raw[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def parts(
    column: pa.Array, limit: int = SLICE_BYTES, outside: np.ndarray = _SPACE
) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(first row, bytes, offsets, goes on): ``slices`` that cut longer texts too.

    A text of more than ``limit`` bytes comes alone, bit by bit, each ending after
    a byte that is ``outside`` of words; with ``goes on`` the next slice has more.
    """
    if len(column) == 0:
        return
    raw, offsets = buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        at, end = int(offsets[row]), int(offsets[row + 1])
        if end - at <= limit:
            stop = int(np.searchsorted(offsets, at + limit, "right")) - 1
            yield row, raw[at : offsets[stop]], offsets[row : stop + 1] - at, False
            row = stop
            continue
        while at < end:
            to = at + limit
            while to < end:
                ahead = outside[raw[to - 1 : min(to - 1 + limit, end)]]
                first = int(ahead.argmax())
                if ahead[first]:
                    to += first
                    break
                to += len(ahead)
            to = min(to, end)
            yield row, raw[at:to], np.array([0, to - at]), to < end
            at = to
        row += 1


def find_words(
    data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each text's first word."""
    inside = ~outside[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edge] |= inside[edge]
    ends[edge - 1] |= inside[edge - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes from prefix sums."""
    if len(starts) == 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        n = len(data)
        up, back = _powers(n)
        terms = (_BYTE_LOWER if lower else _BYTE)[data]
        terms *= up
        total = np.zeros(n + 1, _U)
        np.cumsum(terms, out=total[1:])
        value = (total[stops] - total[starts]) * back[starts]
        return mix64(value ^ ((stops - starts).astype(_U) * _U(0x9E3779B97F4A7C15)))


def _fold(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of a sequence of word hashes; its length counts."""
    with np.errstate(over="ignore"):
        h = np.full(len(parts[0]), len(parts), _U)
        for part in parts:
            h = mix64(h * _U(0xD6E8FEB86659FD93) + part)
        return h


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of the ``size``-word shingles) of every text.

    Lower-cases A-Z. A text of fewer words has its whole sequence as its one
    shingle, a text without words has none.
    """
    for first, data, offsets in slices(column):
        starts, stops, at = find_words(data, offsets)
        word = hash_words(data, starts, stops, lower=True)
        n = len(word) - size + 1
        windows = _fold([word[i : i + n] for i in range(size)]) if n > 0 else None
        for k in range(len(offsets) - 1):
            a, b = int(at[k]), int(at[k + 1])
            if b - a >= size:
                yield first + k, np.unique(windows[a : b - size + 1])
            elif b > a:
                yield first + k, _fold([word[i : i + 1] for i in range(a, b)])
            else:
                yield first + k, np.zeros(0, _U)


def digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


_GEAR = _splitmix(256, 11).astype(np.uint32)
GEAR_BYTES = 16


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash ``sum(table[byte j back] << j)`` of the last 16 bytes, everywhere.

    The rolling sum is built by doubling the window four times.
    """
    h = _GEAR[data]
    width = 1
    while width < GEAR_BYTES:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h, width = wider, 2 * width
    return h


def fold_runs(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run ``values[first:last]``, alike wherever the run lies."""
    with np.errstate(over="ignore"):
        n = len(values)
        up, back = _powers(n)
        total = np.zeros(n + 1, _U)
        np.cumsum(values * up, out=total[1:])
        value = (total[last] - total[first]) * back[first]
        return mix64(value + (last - first).astype(_U) * _U(0xD6E8FEB86659FD93))


def one_blank(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with one blank after each, and where each begins in that."""
    begins = np.cumsum(stops - starts + 1) - (stops - starts + 1)
    if not len(starts):
        return data[:0], begins
    source = np.arange(int(begins[-1] + stops[-1] - starts[-1]) + 1)
    source += np.repeat(starts - begins, stops - starts + 1)
    joined = data[np.minimum(source, len(data) - 1)]
    joined[begins[1:] - 1] = 32
    joined[-1] = 32
    return joined, begins


class Chunks:
    """Content-defined chunks of some texts: runs of words, cut where the gear hash
    of the 16 bytes that end a word is a multiple of ``average``, and after
    ``most`` words without such a place. The hash runs over the words with one
    blank between them, so cuts do not depend on the white space of a text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, average: int, most: int = 32):
        starts, stops, at = find_words(data, offsets)
        self.rows = len(offsets) - 1
        word = hash_words(data, starts, stops, lower=False)
        owner = np.repeat(np.arange(self.rows), np.diff(at))
        joined, begins = one_blank(data, starts, stops)
        ends = begins + (stops - starts) - 1
        cut = (gear(joined)[ends] >> np.uint32(GEAR_BYTES - 1)) % np.uint32(average) == 0
        # A window that reaches into the text before is no property of this one.
        cut &= ends - np.append(begins, 0)[at[owner]] >= GEAR_BYTES - 1
        cut[at[1:][np.diff(at) > 0] - 1] = True
        last = np.flatnonzero(cut) + 1
        gap = np.diff(last, prepend=0)
        if len(last) and gap.max() > most:
            more = [np.arange(e - g + most, e, most) for e, g in zip(last[gap > most], gap[gap > most])]
            last = np.union1d(last, np.concatenate(more))
        first = np.concatenate([[0], last[:-1]]).astype(np.int64) if len(last) else last
        self.words = last - first
        self.digest = fold_runs(word, first, last) if len(last) else np.zeros(0, _U)
        self.owner = owner[first] if len(last) else owner
        self.at = np.searchsorted(self.owner, np.arange(self.rows + 1))
        self.begin = starts[first] if len(last) else starts
        # Up to the next word of the text, or to its end.
        follow = np.append(starts, len(data))[last] if len(last) else last
        self.end = np.minimum(follow, offsets[self.owner + 1]) if len(last) else last
