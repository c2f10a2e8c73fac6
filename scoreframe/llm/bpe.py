"""Byte-level BPE by a lazily determinised transducer, and back by a UTF-8 machine.

The merges of a vocabulary are compiled into a finite-state transducer that reads
a piece of text byte by byte. What it needs to know of the bytes read so far is
the last token that is certain and the bytes after it: for each place among them
the one token that would end there if the piece ended there, and the places where
a longer token may still begin. A token follows another only if merging their
bytes alone gives these two again, so exactly one token ends at every place. As
soon as all places that are still open come after the same token, that token is
certain and is emitted; the lookahead is bounded by the vocabulary. States and
transitions are made when a text first asks for them and kept in the worker.

A piece that is a token as a whole is that token, also where merging would not
lead to it. Pieces met before come from a cache as the bytes of their ids; it starts
anew beyond a stated number. Beyond a stated number of states a piece is read to its
end without new ones. Every task slot has a worker with both, so they are kept small.

Decoding joins the bytes of tokens in a state machine for UTF-8: a character may
end in a later token than it began in. Its transitions are by byte, and those of
whole tokens are kept. Bytes that are no UTF-8 become U+FFFD, as
``bytes.decode(errors="replace")`` has it.

Null and empty texts have no tokens. Rows are encoded one by one: repeated rows,
null keys and ties stay as they are, other columns are left out, an empty table
gives no rows. A very long text is read piece by piece; beside it only its ids
are held, four bytes a token.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from . import arrays
from .base import bounded_batches

#: States, pairs of tokens and pieces that a worker keeps; pieces twice as many at most.
MOST_STATES = 40_000
MOST_PAIRS = 300_000
MOST_PIECES = 400_000
#: Longer pieces are not kept, and longer texts are split as they are read.
KEPT_CHARS = 40
SLICE_CHARS = 200_000
#: Bytes after which a piece without new states lets go of what is certain.
SETTLE_BYTES = 64
#: Bytes of a batch that goes back to Spark, about, and ids that are decoded at once.
BATCH_BYTES = 4_000_000
AT_ONCE = 65_536


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file; every single byte is a token."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"{path} has no token for the bytes {missing}")
    return ranks


class _Merges:
    """What the ranks say about short strings: their tokens, and which tokens may meet."""

    def __init__(self, ranks: dict[bytes, int], most: int):
        self.ranks, self.most = ranks, most
        self.bytes = {rank: token for token, rank in ranks.items()}
        # A tree of the tokens: (node, byte) -> node, and the token that a node ends.
        # Tokens that merging does not lead to can only be whole pieces.
        self.child: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for token, rank in ranks.items():
            if self.merge(token) == [rank]:
                node = 0
                for byte in token:
                    node = self.child.setdefault(node << 8 | byte, len(self.ends))
                    if node == len(self.ends):
                        self.ends.append(-1)
                self.ends[node] = rank
        self._meet: dict[int, bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Join the two neighbours of the least rank, the first of them, until none is left."""
        rank, none = self.ranks.get, len(self.ranks) + 256
        parts = [data[i : i + 1] for i in range(len(data))]
        joined = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while joined and (least := min(joined)) < none:
            at = joined.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(joined):
                joined[at] = rank(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def meet(self, left: int, right: int) -> bool:
        """The two tokens may stand side by side; any may stand first (left is -1)."""
        pair = (left + 1 << 32) + right
        known = self._meet.get(pair)
        if known is None:
            if len(self._meet) >= self.most:
                self._meet.clear()
            if left < 0:
                known = True
            else:
                both = self.bytes[left] + self.bytes[right]
                known = both not in self.ranks and self.merge(both) == [left, right]
            self._meet[pair] = known
        return known


class _Reader:
    """The bytes after the last certain token and what is known of their places.

    For a place ``i`` among them ``starts[i]`` and ``tokens[i]`` are the token that
    would end there and ``firsts[i]`` the end of the first token of those that lead
    there; ``tokens[0]`` is the last certain one. ``open`` are the places where a
    longer token may begin, with the node of the token tree that the bytes since
    then lead to.
    """

    __slots__ = ("pending", "starts", "tokens", "firsts", "open")

    def __init__(self, pending=b"", starts=(-1,), tokens=(-1,), firsts=(0,), open_=((0, 0),)):
        self.pending, self.open = pending, open_
        self.starts, self.tokens, self.firsts = list(starts), list(tokens), list(firsts)

    def packed(self) -> tuple:
        """All of it in one tuple, a third of the memory."""
        return (self.pending, *self.starts, *self.tokens, *self.firsts, *chain.from_iterable(self.open))

    @classmethod
    def unpacked(cls, held: tuple) -> _Reader:
        n = len(held[0]) + 1
        places = iter(held[1 + 3 * n :])
        return cls(held[0], held[1 : 1 + n], held[1 + n : 1 + 2 * n], held[1 + 2 * n : 1 + 3 * n],
                   list(zip(places, places)))

    def read(self, merges: _Merges, data: bytes) -> None:
        child, ends, meet, known = merges.child.get, merges.ends, merges.meet, merges._meet.get
        starts, tokens, firsts, places = self.starts, self.tokens, self.firsts, self.open
        self.pending += data
        for byte in data:
            still, start, sure = [], -1, False
            for begin, node in places:
                node = child(node << 8 | byte)
                if node is not None:
                    still.append((begin, node))
                    if not sure and (end := ends[node]) >= 0:
                        # Exactly one of them comes rightly after the tokens before it.
                        if start >= 0:
                            sure = known((tokens[start] + 1 << 32) + token)
                            if sure is None:
                                sure = meet(tokens[start], token)
                        if not sure:
                            start, token = begin, end
            here = len(starts)
            still.append((here, 0))
            places = still
            starts.append(start)
            tokens.append(token)
            firsts.append(firsts[start] or here)
        self.open = places

    def settle(self) -> list[int]:
        """Let go of the tokens that everything still open leads over."""
        certain = []
        while (first := self.firsts[self.open[0][0]]) and all(
            self.firsts[s] == first for s, _ in self.open
        ):
            certain.append(self.tokens[first])
            before = self.firsts[first:]
            self.pending, self.tokens = self.pending[first:], self.tokens[first:]
            self.open = [(s - first, node) for s, node in self.open]
            self.starts = [s - first for s in self.starts[first:]]
            self.firsts = [0]
            for at in range(1, len(self.starts)):
                # Places that the token does not lead to can begin nothing any more.
                leads = before[at] == first and self.starts[at] >= 0
                self.firsts.append((self.firsts[self.starts[at]] or at) if leads else -1)
        return certain

    def rest(self) -> list[int]:
        """The tokens of the pending bytes if nothing follows."""
        found, at = [], len(self.pending)
        while at:
            found.append(self.tokens[at])
            at = self.starts[at]
        return found[::-1]


class _State:
    """A state of the transducer: a settled reader, its rest and its transitions."""

    __slots__ = ("held", "rest", "next")

    def __init__(self, reader: _Reader):
        self.held, self.rest = reader.packed(), tuple(reader.rest())
        self.next: dict[int, tuple[_State, tuple[int, ...]]] = {}


class Transducer:
    """Tokens of pieces of text; states and transitions are made when first needed."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES,
                 most_pieces: int = MOST_PIECES):
        self.merges = _Merges(ranks, MOST_PAIRS)
        self.most_states, self.most_pieces = most_states, most_pieces
        self.start = _State(_Reader())
        self.states = {(-1, b""): self.start}
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.longest_wait = 0

    def _step(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        """Make the transition by one byte: the next state, and what becomes certain."""
        reader = _Reader.unpacked(state.held)
        reader.read(self.merges, bytes((byte,)))
        certain = tuple(reader.settle())
        key = (reader.tokens[0], reader.pending)
        if key not in self.states:
            self.states[key] = _State(reader)
            self.longest_wait = max(self.longest_wait, len(reader.pending))
        state.next[byte] = found = (self.states[key], certain)
        return found

    def run(self, data: bytes) -> list[int]:
        """The tokens of one piece by merging."""
        state, out = self.start, []
        for at, byte in enumerate(data):
            move = state.next.get(byte)
            if move is None:
                if len(self.states) >= self.most_states:
                    return out + self._read_on(state, data[at:])
                move = self._step(state, byte)
            state, certain = move
            if certain:
                out += certain
        out += state.rest
        return out

    def _read_on(self, state: _State, data: bytes) -> list[int]:
        """Read to the end from a state on without making new ones."""
        reader, out = _Reader.unpacked(state.held), []
        for at in range(0, len(data), SETTLE_BYTES):
            reader.read(self.merges, data[at : at + SETTLE_BYTES])
            if at + SETTLE_BYTES < len(data):
                out += reader.settle()
        return out + reader.rest()

    def piece(self, piece: str) -> bytes:
        """The ids of a piece that is not among the recent ones, as bytes of an array."""
        known = self.older.get(piece)
        if known is None:
            data = piece.encode()
            whole = self.merges.ranks.get(data)
            known = array("I", (whole,) if whole is not None else self.run(data)).tobytes()
        if len(piece) <= KEPT_CHARS:
            if len(self.recent) >= self.most_pieces:
                self.older, self.recent = self.recent, {}
            self.recent[piece] = known
        return known

    def encode(self, text: str, split: Split) -> array:
        """The ids of a whole text, whose pieces are the matches of the split."""
        ids = array("I")
        for pieces in split(text):
            recent, make = self.recent, self.piece
            ids.frombytes(b"".join([recent.get(p) or make(p) for p in pieces]))
        return ids


Split = Callable[[str], Iterator[list[str]]]

_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
# The split of byte-level vocabularies, of which ``_by_kind`` gives
# the matches.
KNOWN_SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A place where every text may be cut: pieces end before the blank.
_CUT = regex.compile(r"[\p{L}\p{N}](?= )")


def _kinds() -> np.ndarray:
    """Letter, number, space or other for every code point."""
    kept = arrays.worker_store()
    if "kinds" not in kept:
        kinds = np.full(0x110000, _OTHER, np.uint8)
        for at in range(0, 0x110000, 4096):
            if 0xD800 <= at < 0xE000:  # surrogates are no characters of texts
                continue
            every = "".join(map(chr, range(at, at + 4096)))
            for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
                for run in regex.finditer(pattern, every):
                    kinds[at + run.start() : at + run.end()] = kind
        kept["kinds"] = kinds
    return kept["kinds"]


def _by_kind(text: str) -> list[str]:
    """The matches of ``KNOWN_SPLIT`` in a text: runs of one kind of character."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = _kinds()[points]
    n = len(kind)
    begins = np.ones(n + 3, bool)  # a little beyond the end, so that looking ahead is safe
    begins[1:n] = kind[1:] != kind[:-1]
    begins[n + 1 :] = False
    # The last character of white space goes to the next run, if it is a blank, or
    # is a piece of its own.
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE))
    begins[last] = True
    begins[last[points[last] == 32] + 1] = False
    # The short endings after an apostrophe that begins a piece.
    for at in np.flatnonzero((points == 39) & begins[:n]).tolist():
        end = text[at + 1 : at + 3]
        size = 2 if end[:1] in ("s", "t", "m", "d") else 3 if end in ("re", "ve", "ll") else 0
        if size and end:
            begins[at + 1] = False
            begins[at + size] |= at + size < n and kind[at + size] == _LETTER
    places = np.flatnonzero(begins[: n + 1]).tolist()
    return [text[a:b] for a, b in zip(places, places[1:])]


def splitter(pattern: str) -> Split:
    """Lists of the pieces of a text; a long one is read bit by bit."""
    compiled = regex.compile(pattern)

    def by_kind(text: str) -> Iterator[list[str]]:
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + SLICE_CHARS) if len(text) - at > SLICE_CHARS else None
            end = cut.end() if cut else len(text)
            yield _by_kind(text[at:end])
            at = end

    def by_match(text: str) -> Iterator[list[str]]:
        found = (m.group() for m in compiled.finditer(text))
        while some := list(islice(found, AT_ONCE)):
            yield some

    return by_kind if pattern == KNOWN_SPLIT else by_match


#: Fixed values of UTF-8: (first, last leading byte) -> (first, last second byte, how many follow).
_LEADS = {
    (0xC2, 0xDF): (0x80, 0xBF, 1),
    (0xE0, 0xE0): (0xA0, 0xBF, 2),
    (0xE1, 0xEC): (0x80, 0xBF, 2),
    (0xED, 0xED): (0x80, 0x9F, 2),
    (0xEE, 0xEF): (0x80, 0xBF, 2),
    (0xF0, 0xF0): (0x90, 0xBF, 3),
    (0xF1, 0xF3): (0x80, 0xBF, 3),
    (0xF4, 0xF4): (0x80, 0x8F, 3),
}
_LEAD = {b: rest for (a, z), rest in _LEADS.items() for b in range(a, z + 1)}


def utf8_step(held: bytes, byte: int) -> tuple[bytes, str]:
    """Read a byte after the beginning of a character: what is held now, and the text made."""
    if not held:
        if byte < 0x80:
            return b"", chr(byte)
        return (bytes([byte]), "") if byte in _LEAD else (b"", "�")
    low, high, follow = _LEAD[held[0]]
    if len(held) > 1:
        low, high = 0x80, 0xBF
    if not low <= byte <= high:
        after, text = utf8_step(b"", byte)
        return after, "�" + text
    held += bytes([byte])
    return (b"", held.decode()) if len(held) == follow + 1 else (held, "")


class Decoder:
    """Text of token ids that arrive bit by bit."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.moves: dict[bytes, dict[int, tuple[bytes, str]]] = {}
        self.held = b""
        # Tokens that are whole characters, met between characters.
        between = {t: self._move(b"", t) for t in tokens}
        self.whole = {t: text for t, (held, text) in between.items() if not held}

    def _move(self, held: bytes, token: int) -> tuple[bytes, str]:
        known = self.moves.setdefault(held, {})
        if token not in known:
            after, parts = held, []
            for byte in self.tokens[token]:
                after, text = utf8_step(after, byte)
                parts.append(text)
            known[token] = after, "".join(parts)
        return known[token]

    def feed(self, ids: Iterable[int]) -> str:
        """The text that these ids complete."""
        ids = list(ids)
        parts, held, whole = [], self.held, self.whole
        if not held and all(map(whole.__contains__, ids)):
            return "".join(map(whole.__getitem__, ids))
        for token in ids:
            text = None if held else whole.get(token)
            if text is None:
                held, text = self.moves.get(held, {}).get(token) or self._move(held, token)
            parts.append(text)
        self.held = held
        return "".join(parts)

    def finish(self) -> str:
        """What is left of a character that was never completed."""
        left, self.held = "�" if self.held else "", b""
        return left


def _coder(path: str) -> Transducer:
    """This worker's transducer for a vocabulary."""
    kept = arrays.worker_store().setdefault("bpe", {})
    if path not in kept:
        kept[path] = Transducer(read_ranks(path))
    return kept[path]


def _decoder(path: str) -> Decoder:
    kept = arrays.worker_store().setdefault("bpe-text", {})
    if path not in kept:
        kept[path] = Decoder({rank: token for token, rank in read_ranks(path).items()})
    return kept[path]


def _batches(rows: Iterator[tuple], schema: pa.Schema, sized: int) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size; column ``sized`` holds the long values."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[sized])
        if size >= BATCH_BYTES or len(held) >= 10_000:
            yield pa.record_batch([list(c) for c in zip(*held)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([list(c) for c in zip(*held)], schema=schema)


def _one_by_one(column: pa.Array) -> Iterator:
    """The values of a column, one at a time as Python objects."""
    for value in column:
        yield value.as_py()


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id",
           text: str = "text") -> DataFrame:
    """(key, ids) of every row: ``ids`` are little-endian unsigned 32-bit numbers in a
    binary value. Every match of ``pattern`` is encoded by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, split = _coder(ranks_path), splitter(pattern)

        def rows():
            for batch in batches:
                for name, value in zip(_one_by_one(batch.column(0)), _one_by_one(batch.column(1))):
                    yield name, _little(coder.encode(value or "", split))

        yield from _batches(rows(), pa.schema([(key, pa.int64()), ("ids", pa.binary())]), 1)
        arrays.release(task=False)

    return bounded_batches(docs).select(F.col(key).cast("long").alias(key), text).mapInArrow(
        run, f"`{key}` long, ids binary"
    )


def _little(ids: array) -> bytes:
    return np.frombuffer(ids, np.uint32).astype("<u4").tobytes() if len(ids) else b""


def decode(encoded: DataFrame, ranks_path: str, key: str = "doc_id") -> DataFrame:
    """(key, ids, text) of rows made by ``encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(ranks_path)

        def rows():
            for batch in batches:
                for name, packed in zip(_one_by_one(batch.column(0)), _one_by_one(batch.column(1))):
                    ids = np.frombuffer(packed or b"", "<u4")
                    parts = [decoder.feed(ids[i : i + AT_ONCE].tolist())
                             for i in range(0, len(ids), AT_ONCE)]
                    yield name, packed or b"", "".join([*parts, decoder.finish()])

        schema = pa.schema([(key, pa.int64()), ("ids", pa.binary()), ("text", pa.string())])
        yield from _batches(rows(), schema, 1)
        arrays.release(task=False)

    return bounded_batches(encoded).select(key, "ids").mapInArrow(run, f"`{key}` long, ids binary, text string")
