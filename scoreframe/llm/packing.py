"""Pack tokenised documents into sequences by exact complements, then best fit.

Lengths are at most the size of a sequence, so the number of documents of each
length is a table of bounded size, whatever the number of documents. The plan is
made on it: a sequence starts with the longest length left, and its gap is
filled exactly by one, two or three available lengths, found by their sums. Where
none fits exactly, the longest length that fits is put in and the smaller gap is
tried again, until nothing fits. Each combination is used as often as the counts
allow. The plan names for every length the ranks that each combination takes,
and documents, numbered within their length, look up their place.

Texts are tokenised word by word with a cache of words in each worker, so that
repeated words are tokenised once; white space separates tokens, which makes
the ids those of the whole text. The cache knows words by 64-bit hashes.

Null and empty texts hold the end id alone. Repeated rows are packed one by
one. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import arrays
from .base import bounded_batches, saved

SEQUENCE = 4096
END_ID = 1
#: Words that a worker's cache holds before it starts anew.
CACHE_WORDS = 1_000_000
#: Bytes of text that are tokenised at a time.
SLICE_BYTES = 1_000_000
#: Rows of one length that are numbered together, about.
BUCKET_ROWS = 20_000
_RANKS = 2**48

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# The split of the lower-casing word vocabulary, for which runs of
# plain letters, of marks and single digits are words of their own.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LETTER, _MARK, _DIGIT = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[ord("'")] = 0


def _kinds(data: np.ndarray) -> np.ndarray:
    """Letter, mark or digit for each byte of ASCII and Latin-1 letters, else 0."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # the two signs
    kind[lead] = kind[lead + 1] = _LETTER
    return kind


def _lowered(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data < 91)] += 32
    tail = np.flatnonzero(data[:-1] == 0xC3) + 1
    tail = tail[(data[tail] >= 0x80) & (data[tail] < 0x9F) & (data[tail] != 0x97)]
    out[tail] += 32
    return out


class _Words:
    """Token ids of words, tokenised once: sorted word hashes and one flat id array."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = None
        shape = json.loads(self.tokenizer.to_str())
        steps = (shape["normalizer"] or {}).get("normalizers", [])
        splits = (shape["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        if (
            [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
            and splits[0].get("pattern") == {"Regex": WORD_SPLIT}
            and shape["model"].get("end_of_word_suffix") == "</w>"
        ):
            # The same model, for text that is lower case and split already.
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([
                pre_tokenizers.WhitespaceSplit(),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ])
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys, self.begin = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size, self.flat = np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _encode(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray):
        """First id and number of ids of each word, and all ids.

        Words of ASCII and Latin-1 letters, digits and marks go in one call,
        their parts split here; an id that ends a part tells where it ends. All
        other words are tokenised one by one.
        """
        number = np.zeros(len(starts), np.int64)
        kind = _kinds(data)
        bad = np.concatenate([[0], np.cumsum(kind == 0)])
        odd = bad[stops] > bad[starts]
        open_ = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        odd |= np.searchsorted(open_, starts) < np.searchsorted(open_, stops)
        if self.plain is None:
            odd[:] = True
        easy, hard, parts = np.flatnonzero(~odd), np.flatnonzero(odd), []
        if len(easy):
            size = stops[easy] - starts[easy]
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            take = np.repeat(starts[easy], size) + place
            here = kind[take]
            fresh = (place == 0) | (here == _DIGIT)
            fresh[1:] |= here[1:] != here[:-1]
            text = np.full(len(take) + int(fresh.sum()), 32, np.uint8)
            text[np.arange(len(take)) + np.cumsum(fresh)] = _lowered(data[take])
            found = self.plain.encode_batch_fast(
                [text.tobytes().decode()], add_special_tokens=False
            )
            ids = np.array(found[0].ids, np.uint32)
            # Each part ends with one id of the kind that ends parts.
            stop = np.flatnonzero(self.ends[ids]) + 1
            pieces = np.add.reduceat(fresh, np.cumsum(size) - size, dtype=np.int64)
            number[easy] = np.diff(stop[np.cumsum(pieces) - 1], prepend=0)
            parts.append(ids)
        for k in hard.tolist():
            word = data[starts[k] : stops[k]].tobytes().decode()
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            number[k] = len(ids)
            parts.append(np.array(ids, np.uint32))
        order = np.concatenate([easy, hard])
        begin = np.empty(len(starts), np.int64)
        begin[order] = np.cumsum(number[order]) - number[order]
        return begin, number, np.concatenate(parts)

    def find(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, stops: np.ndarray):
        """Place and number of the ids of each of the sorted ``keys``, and all ids.

        The k-th key is the hash of the word ``data[starts[k]:stops[k]]``.
        """
        if len(self.keys) > CACHE_WORDS:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            begin, size, ids = self._encode(data, starts[new], stops[new])
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.begin = np.insert(self.begin, at[new], begin + len(self.flat))
            self.size = np.insert(self.size, at[new], size)
            self.flat = np.concatenate([self.flat, ids])
            at = np.searchsorted(self.keys, keys)
        return self.begin[at], self.size[at], self.flat


def token_ids(column: pa.Array, path: str, end_id: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of every text, ``end_id`` last."""
    loaded = arrays.worker_store().setdefault("words", {})
    if path not in loaded:
        loaded[path] = _Words(path)
    lookup = loaded[path]
    for first, data, offsets in arrays.slices(column, SLICE_BYTES):
        starts, stops, at = arrays.find_words(data, offsets)
        keys, where, word = np.unique(
            arrays.hash_words(data, starts, stops, lower=False),
            return_index=True, return_inverse=True,
        )
        begin, size, flat = lookup.find(keys, data, starts[where], stops[where])
        each = size[word].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(each)])
        take = np.repeat(begin[word] - upto[:-1], each) + np.arange(int(upto[-1]))
        tokens = flat[take]
        for k in range(len(offsets) - 1):
            mine = tokens[upto[at[k]] : upto[at[k + 1]]]
            yield first + k, np.append(mine, np.uint32(end_id)).astype("<u4")


def tokenise(
    docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of at most ``size`` ids; ``with_ids`` adds them as ``ids``.

    ``tokenizer`` is the path of a ``tokenizers`` file on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, piece, length, crc, kept = [], [], [], [], []
            for row, ids in token_ids(batch.column("text"), tokenizer, end_id):
                for k in range(0, len(ids), size):
                    part = ids[k : k + size]
                    owner.append(row)
                    piece.append(k // size)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        kept.append(part.astype(np.int32))
            out = [
                batch.column("doc_id").take(pa.array(owner, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(np.array(piece, np.int64) * size),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)
        arrays.release()

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


# --- the plan ------------------------------------------------------------------


def _exact(count: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths that add up to ``gap``, longest first."""
    if count[gap] > 0:
        return [gap]
    found = _pair(count, gap)
    if found:
        return found
    for a in np.flatnonzero(count[: max(0, gap - 1)])[::-1].tolist():
        if 3 * a < gap:
            break
        count[a] -= 1
        rest = _pair(count, gap - a)
        count[a] += 1
        if rest and rest[0] <= a:
            return [a, *rest]
    return None


def _pair(count: np.ndarray, gap: int) -> list[int] | None:
    half = np.arange((gap + 1) // 2, gap)
    both = np.flatnonzero((count[half] > 0) & (count[gap - half] > 0))[::-1]
    for k in both[:2].tolist():
        a = int(half[k])
        if 2 * a != gap or count[a] > 1:
            return [a, gap - a]
    return None


def combinations(counts: Sequence[int], size: int) -> list[tuple[list[int], int]]:
    """(lengths, times): sequences for ``counts[length]`` pieces of each length."""
    count = np.zeros(size + 1, np.int64)
    count[: len(counts)] = counts
    plan = []
    while count.any():
        items, gap = [], size
        while gap:
            fill = _exact(count, gap) if items else None
            if fill is None:
                fits = np.flatnonzero(count[: gap + 1])
                if len(fits) == 0:
                    break
                fill = [int(fits[-1])]
            for x in fill:
                count[x] -= 1
                gap -= x
            items += fill
        lengths, each = np.unique(items, return_counts=True)
        more = int((count[lengths] // each).min())
        count[lengths] -= more * each
        plan.append((items, 1 + more))
    return plan


def _places(plan: list[tuple[list[int], int]], size: int) -> np.ndarray:
    """Rows (key of length and first rank, copies, first sequence, offset), in order."""
    used = np.zeros(size + 1, np.int64)
    rows, sequence = [], 0
    for items, times in plan:
        offset = 0
        for length, copies in zip(*(x.tolist() for x in np.unique(items, return_counts=True))):
            rows.append((length * _RANKS + int(used[length]), copies, sequence, offset))
            used[length] += copies * times
            offset += copies * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def ranked(pieces: DataFrame) -> DataFrame:
    """Add ``__rank``: a number within the length, from 0.

    A length may be that of a third of all rows, so rows are numbered inside
    hashed buckets, after the rows of the buckets before.
    """
    rows = pieces.count()
    buckets = max(1, rows // BUCKET_ROWS)
    order = ("doc_id", "start", "ids_crc32")
    placed = pieces.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    earlier = Window.partitionBy("length").orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    base = (
        placed.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
        .select("length", "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    )
    within = Window.partitionBy("length", "__bucket").orderBy(*order)
    return (
        placed.withColumn("__r", F.row_number().over(within) - 1)
        .join(base, ["length", "__bucket"])
        .withColumn("__rank", F.col("__base") + F.col("__r"))
        .select(*pieces.columns, "__rank")
    )


def pack(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``size``.

    The driver gets one row per length, at most ``size``.
    """
    counts = np.zeros(size + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    places = _places(combinations(counts, size), size)
    numbered = ranked(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("__rank").to_numpy()
            row = np.searchsorted(places[:, 0], length * _RANKS + rank, "right") - 1
            key, copies, first, offset = places[row].T
            nth = length * _RANKS + rank - key
            names = [n for n in batch.schema.names if n != "__rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names]
                + [pa.array(first + nth // copies), pa.array(offset + nth % copies * length)],
                [*names, "sequence_id", "offset"],
            )

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return numbered.mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID
) -> DataFrame:
    """Tokenise and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(saved(tokenise(docs, tokenizer, size, end_id), "pack-pieces"), size)
