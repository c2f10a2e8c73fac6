"""Drop passages that other texts hold, by content-defined chunks.

A gear rolling hash over the bytes cuts every text into runs of words. Cuts
depend on the 16 bytes before them only, so a passage is cut alike wherever it
stands, and an insertion moves the cuts next to it and no others. Chunks are
compared by a 64-bit digest of their words; the occurrence with the smallest
(document id, place) is kept and the others are repeats. Repeats that follow
each other make a span, and spans of ``min_words`` words are cut out of the
text. Single chunks that agree by chance make no span.

Every task compares its own chunks first and deals one claim per digest, so a
passage in a third of all documents sends one claim per task's buffer and not
one per document. Buckets of claims scale with the number of words; documents
meet only their own spans. The texts are not shuffled when the spans are few
enough, in bytes, to be broadcast.

Null and empty texts and rows without an id stay as they are. Rows that repeat
id and text are one occurrence and treated alike. Passages that repeat within
one document are repeats as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import arrays
from .base import bounded_batches, saved, word_count

#: Mean words of a chunk.
AVERAGE_WORDS = 4
#: Words of a span that is cut out. Three quarters of as many must lie in chunks of
#: STRONG_WORDS or more, or the span be twice as long: short chunks repeat by chance.
MIN_WORDS = 20
STRONG_WORDS = 4
#: Chunks that a task holds before it deals them, and that a bucket holds, about.
FLUSH_CHUNKS = 500_000
BUCKET_CHUNKS = 500_000
#: Bytes of spans that may be broadcast.
BROADCAST_BYTES = 64_000_000

_U = np.uint64
_ITEM = np.dtype([("doc", "<i8"), ("place", "<i4"), ("words", "<i4"), ("digest", "<u8")])
_DEALT = "bucket long, items binary"


def _later(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First occurrences of each digest, and the others."""
    order = np.lexsort((items["place"], items["doc"], items["digest"]))
    items = items[order]
    first = np.ones(len(items), bool)
    first[1:] = items["digest"][1:] != items["digest"][:-1]
    # A row that repeats id and text holds the same occurrence again.
    head = items[np.maximum.accumulate(np.where(first, np.arange(len(items)), 0))]
    same = (items["doc"] == head["doc"]) & (items["place"] == head["place"])
    return items[first], items[~same]


def _dealt(items: np.ndarray, bucket: np.ndarray) -> list[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    items, bucket = items[order], bucket[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    return [(int(bucket[a]), items[a:b].tobytes()) for a, b in zip(cuts, cuts[1:]) if b > a]


def _rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
        ["bucket", "items"],
    )


def repeats(docs: DataFrame, average: int, buckets: int, parts: int) -> DataFrame:
    """(part, items): the repeated chunks, dealt by document."""

    def split(items: np.ndarray) -> list[tuple[int, bytes]]:
        """Claims go to buckets of digests; repeats of the same buffer to the
        parts of their documents, numbered below zero."""
        claims, known = _later(items)
        return _dealt(claims, (claims["digest"] % _U(buckets)).astype(np.int64)) + _dealt(
            known, -1 - known["doc"] % parts
        )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            ids = batch.column("doc_id").to_numpy()
            for first, data, offsets in arrays.slices(batch.column("text")):
                chunks = arrays.Chunks(data, offsets, average)
                items = np.empty(len(chunks.digest), _ITEM)
                items["doc"] = ids[first + chunks.owner]
                items["place"] = np.arange(len(items)) - chunks.at[chunks.owner]
                items["words"], items["digest"] = chunks.words, chunks.digest
                held.append(items)
                size += len(items)
                if size >= FLUSH_CHUNKS:
                    yield _rows(split(np.concatenate(held)))
                    held, size = [], 0
        if size:
            yield _rows(split(np.concatenate(held)))
        del held
        arrays.release()

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        arrays.release(task=False)
        blocks = [np.frombuffer(x.as_py(), _ITEM) for x in table.column("items")]
        if key[0].as_py() < 0:
            rows = [(-1 - key[0].as_py(), b.tobytes()) for b in blocks]
        else:
            _, late = _later(np.concatenate(blocks))
            rows = _dealt(late, late["doc"] % parts)
        return pa.Table.from_batches([_rows(rows)]).rename_columns(["part", "items"])

    return (
        bounded_batches(docs).select("doc_id", "text").mapInArrow(deal, _DEALT)
        .groupBy("bucket").applyInArrow(meet, "part long, items binary")
    )


def spans(repeated: DataFrame, min_words: int, strong_words: int) -> DataFrame:
    """(doc_id, runs): per document its spans as (first place, chunks, digest sum)."""

    def collect(table: pa.Table) -> pa.Table:
        arrays.release(task=False)
        items = np.concatenate([np.frombuffer(x.as_py(), _ITEM) for x in table.column("items")])
        # The same place may be named twice, also with two digests where rows share an id.
        items = np.unique(items)
        items = items[np.lexsort((items["place"], items["doc"]))]
        fresh = np.ones(len(items), bool)
        fresh[1:] = (items["doc"][1:] != items["doc"][:-1]) | (
            items["place"][1:] != items["place"][:-1] + 1
        )
        first = np.flatnonzero(fresh)
        long = np.where(items["words"] >= strong_words, items["words"], 0)
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(items["digest"], first) if len(first) else np.zeros(0, _U)
        words = np.add.reduceat(items["words"], first) if len(first) else first
        strong = np.add.reduceat(long, first) if len(first) else first
        count = np.diff(np.append(first, len(items)))
        keep = (words >= min_words) & ((4 * strong >= 3 * min_words) | (words >= 2 * min_words))
        runs = np.empty(int(keep.sum()), _RUN)
        runs["place"], runs["chunks"] = items["place"][first][keep], count[keep]
        runs["sum"] = sums[keep]
        docs = items["doc"][first][keep]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(docs)) + 1, [len(docs)]])
        out = [(int(docs[a]), runs[a:b].tobytes()) for a, b in zip(cuts, cuts[1:]) if b > a]
        return pa.table({"doc_id": pa.array([o[0] for o in out], pa.int64()),
                         "runs": pa.array([o[1] for o in out], pa.binary())})

    return repeated.groupBy("part").applyInArrow(collect, "doc_id long, runs binary")


_RUN = np.dtype([("place", "<i4"), ("chunks", "<i4"), ("sum", "<u8")])


def cut_out(docs: DataFrame, found: DataFrame, average: int) -> DataFrame:
    """Remove the spans from ``text``; adds n_spans, removed_words, removed_chars.

    A span applies where the chunks at its place add up to its digest sum, so
    of two texts with one id only the one that holds the span is changed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, texts = batch.column("__runs"), batch.column("text")
            facts = np.zeros((3, batch.num_rows), np.int64)
            marked = np.flatnonzero(pc.and_(runs.is_valid(), texts.is_valid()).to_numpy(False))
            changed = []
            for first, data, offsets in arrays.slices(texts.take(pa.array(marked))):
                chunks = arrays.Chunks(data, offsets, average)
                for j in range(chunks.rows):
                    k = marked[first + j]
                    text, facts[:, k] = _without(
                        data, int(offsets[j]), int(offsets[j + 1]), chunks,
                        slice(int(chunks.at[j]), int(chunks.at[j + 1])),
                        np.frombuffer(runs[k].as_py(), _RUN),
                    )
                    changed.append(text)
            here = np.zeros(batch.num_rows, bool)
            here[marked] = True
            texts = pc.replace_with_mask(texts, pa.array(here), pa.array(changed, pa.string()))
            names = [n for n in batch.schema.names if n != "__runs"]
            arrs = [texts if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                arrs + [pa.array(f) for f in facts],
                names + ["n_spans", "removed_words", "removed_chars"],
            )
        arrays.release()

    keep = [n for n in docs.columns if n not in ("n_spans", "removed_words", "removed_chars")]
    joined = docs.select(*keep).join(found.withColumnRenamed("runs", "__runs"), "doc_id", "left")
    plain = docs.select(*keep).schema
    for name in ("n_spans", "removed_words", "removed_chars"):
        plain = plain.add(name, "long")
    return bounded_batches(joined).select(*keep, "__runs").mapInArrow(run, plain)


def _without(data, begin, end, chunks, mine, runs):
    digest, words = chunks.digest[mine], chunks.words[mine]
    starts, stops = chunks.begin[mine], chunks.end[mine]
    pieces, at, facts = [], begin, [0, 0, 0]
    for run in runs:
        a, b = int(run["place"]), int(run["place"]) + int(run["chunks"])
        with np.errstate(over="ignore"):
            if b > len(digest) or digest[a:b].sum(dtype=_U) != run["sum"]:
                continue
        gone = data[starts[a] : stops[b - 1]]
        pieces.append(data[at : starts[a]].tobytes())
        at = int(stops[b - 1])
        facts[0] += 1
        facts[1] += int(words[a:b].sum())
        facts[2] += len(gone.tobytes().decode())
    pieces.append(data[at:end].tobytes())
    return b"".join(pieces).decode(), facts


def dedupe(
    docs: DataFrame,
    average: int = AVERAGE_WORDS,
    min_words: int = MIN_WORDS,
    strong_words: int = STRONG_WORDS,
    bucket_chunks: int = BUCKET_CHUNKS,
) -> DataFrame:
    """``docs`` without repeated passages; adds n_spans, removed_words, removed_chars.

    Needs ``doc_id`` (long) and ``text``; other columns are carried along, but
    for any of the three names above.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = docs.agg(F.sum(word_count(F.col("text")))).first()[0] or 0
    buckets = max(parts, int(total) // (average * bucket_chunks) + 1)
    found = saved(
        spans(repeats(docs, average, buckets, max(parts, buckets // 4)), min_words, strong_words),
        "substring-spans",
    )
    held = found.agg(F.sum(F.octet_length("runs") + 16)).first()[0] or 0
    if held <= BROADCAST_BYTES:
        found = F.broadcast(found)
    return cut_out(docs, found, average)
