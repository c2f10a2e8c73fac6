"""Exact Jaccard self-join of shingle sets by T-occurrence search.

Two texts link when ``100 * |A and B| >= percent * |A or B|``. The result names
for every document the smallest document id that links reach.

1. Exact copies of a set are one set from the start (its digest).
2. A link needs at least ``T = ceil(percent/100 * n)`` shingles of a set in
   other sets. One pass deals 32-bit marks of all shingles to buckets, counts
   the marks that two sets or more hold, and drops every set with fewer than
   ``T`` of them. A false match of marks only keeps a set longer.
3. For the sets that are left, the length of every inverted list is counted
   exactly. By the lists' lengths, rarest first, a set's first ``n - T + 1``
   shingles must meet those of any set that it links with; sets that meet in
   this way, directly or through others, form a group.
4. In each group the links are found by DivideSkip: of a set's lists the
   longest are set aside and the short ones are merged; what occurs in enough
   of them is probed by binary search in the long ones and kept when it
   reaches the required overlap. Pairs that links already join are not probed
   again, so a group of near copies costs a chain of links and not all pairs.
5. A group beyond ``block_sets`` (or BLOCK_TOKENS shingles) is dealt to blocks. Links inside blocks come
   first, then each block's components are met with the others' smallest
   members, and the sets outside the largest component of the group are
   searched in every other block. A pair that is in no common component after
   that has been compared, so nothing is lost.

Sets and shingles are known by 64-bit hashes; a set's id is its hash, and only
the result names it by a document. Documents with null id take no part (null
component); texts without words link with nothing. Documents that repeat an id
count one by one and share their id's name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import arrays
from ..plans.scale import fits
from .base import bounded_batches, saved
from .components import components

#: Shingles that a bucket holds, about, and that a task holds before it deals them.
BUCKET_TOKENS = 4_000_000
FLUSH_TOKENS = 2_000_000
#: A mark that so many sets of one buffer hold is counted there and dealt once.
HOT_SETS = 64
#: Sets whose counts one task adds up.
PART_SETS = 20_000
#: Sets that one task searches together, and their shingles, about.
BLOCK_SETS = 2000
BLOCK_TOKENS = 4_000_000

_U = np.uint64


def required(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any set that it links with."""
    return -(-n * percent // 100)


def _keys(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), np.int64)


# --- sets ------------------------------------------------------------------


def describe(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, key, digest) for each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests = np.zeros(batch.num_rows, np.int64), [b""] * batch.num_rows
            for row, tokens in arrays.shingle_sets(batch.column("text"), size):
                n[row], digests[row] = len(tokens), arrays.digest(tokens)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(_keys(digests)),
                 pa.array(digests, pa.binary())],
                ["doc_id", "n_shingles", "key", "digest"],
            )
        arrays.release()

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, key long, digest binary"
    )


class _Dealer:
    """Collects (key, tokens) and deals them to buckets as packed blocks.

    With ``parts`` it deals 32-bit marks. What HOT_SETS of the buffer hold is
    shared for certain: such a mark is dealt once, for all of them, and their
    counts go to bucket ``-1 - part``. So a shingle that a third of all sets
    hold takes less than HOT_SETS places of a bucket per buffer, and a text that
    a third of all rows hold takes one.
    """

    def __init__(self, buckets: int, parts: int | None = None):
        self.buckets, self.parts = buckets, parts
        self.keys: dict[int, None] = {}
        self.sets: list[np.ndarray] = []
        self.size = 0

    def add(self, key: int, tokens: np.ndarray) -> bool:
        if key not in self.keys:
            self.keys[key] = None
            self.sets.append(tokens)
            self.size += len(tokens)
        return self.size >= FLUSH_TOKENS

    def flush(self) -> pa.RecordBatch | None:
        if not self.size:
            return None
        keys = np.array(list(self.keys), np.int64)
        owner = np.repeat(np.arange(len(keys), dtype=np.int32), [len(s) for s in self.sets])
        tokens = np.concatenate(self.sets)
        self.keys, self.sets, self.size = {}, [], 0
        bucket = (tokens % _U(self.buckets)).astype(np.uint32)
        rows = []
        if self.parts is not None:
            tokens = (tokens >> _U(32)).astype(np.uint32)
            times, again = _lengths(bucket.astype(_U) << _U(32) | tokens)
            hot = times >= HOT_SETS
            again &= hot
            hits = np.bincount(owner[hot], minlength=len(keys)).astype(np.int32)
            rows = [(-1 - p, k, h, b"") for p, k, h in _by_part(keys, hits, self.parts)]
            bucket, owner, tokens = bucket[~again], owner[~again], tokens[~again]
        order = np.argsort(bucket, kind="stable")
        bucket, owner, tokens = bucket[order], owner[order], tokens[order]
        del order
        edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for a, b in zip(edges, edges[1:]):
            own = owner[a:b]
            first = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
            counts = np.diff(np.append(first, len(own))).astype(np.int32)
            rows.append((int(bucket[a]), keys[own[first]].tobytes(), counts.tobytes(),
                         tokens[a:b].tobytes()))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64())]
            + [pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)],
            ["bucket", "keys", "counts", "tokens"],
        )


_BLOCKS = "bucket long, keys binary, counts binary, tokens binary"


def _dealt(sets: Iterator[tuple[int, np.ndarray]], dealer: _Dealer) -> Iterator[pa.RecordBatch]:
    for key, tokens in sets:
        if dealer.add(key, tokens):
            yield dealer.flush()


def _read(table: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, owner of each token and tokens of a bucket; each key once."""
    keys = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("keys")])
    counts = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in table.column("counts")])
    tokens = np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column("tokens")])
    _, first = np.unique(keys, return_index=True)
    keep = np.zeros(len(keys), bool)
    keep[first] = True
    owner = np.repeat(np.arange(len(keys), dtype=np.int32), counts)
    if keep.all():
        return keys, owner, tokens
    kept = keep[owner]
    return keys, owner[kept], tokens[kept]


def _runs(sorted_: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, first, last) of the runs of equal values."""
    edges = [0, *(np.flatnonzero(np.diff(sorted_)) + 1).tolist(), len(sorted_)]
    return [(int(sorted_[a]), a, b) for a, b in zip(edges, edges[1:]) if b > a]


def _by_part(keys: np.ndarray, hits: np.ndarray, parts: int) -> list[tuple[int, bytes, bytes]]:
    """(part, keys, hits) of the keys that have any."""
    keys, hits = keys[hits > 0], hits[hits > 0]
    order = np.argsort(keys % parts, kind="stable")
    keys, hits = keys[order], hits[order]
    return [(p, keys[a:b].tobytes(), hits[a:b].tobytes()) for p, a, b in _runs(keys % parts)]


def _lengths(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token how often it occurs, and whether it stood before."""
    order = np.argsort(tokens, kind="stable")
    sorted_ = tokens[order]
    first = np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1])
    runs = np.diff(np.append(first, len(tokens)))
    out = np.empty(len(tokens), np.int32)
    out[order] = np.repeat(runs, runs).astype(np.int32)
    again = np.ones(len(tokens), bool)
    again[order[first]] = False
    return out, again


def _marks_shared(table: pa.Table, parts: int) -> list[tuple[int, bytes, bytes]]:
    """(part, keys, hits) of one bucket; a bucket below 0 holds counts already."""
    if (bucket := table.column("bucket")[0].as_py()) < 0:
        held = [table.column(c).to_pylist() for c in ("keys", "counts")]
        return list(zip([-1 - bucket] * table.num_rows, *held))
    keys, owner, marks = _read(table, np.uint32)
    times, _ = _lengths(marks)
    return _by_part(keys, np.bincount(owner[times > 1], minlength=len(keys)).astype(np.int32), parts)


def shared_counts(docs: DataFrame, size: int, buckets: int, parts: int) -> DataFrame:
    """(key, shared): marks of each set that another set holds as well, at least.

    A set whose copies lie in several buffers may count a hot mark more than
    once, never less: the first buffer with a mark of another set deals it for
    a set of which no copy stands in an earlier one.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = _Dealer(buckets, parts)

        def sets(batch):
            for _, tokens in arrays.shingle_sets(batch.column("text"), size):
                if len(tokens):
                    yield int(_keys([arrays.digest(tokens)])[0]), tokens

        for batch in batches:
            yield from _dealt(sets(batch), dealer)
        if (last := dealer.flush()) is not None:
            yield last
        arrays.release()

    def count(table: pa.Table) -> pa.Table:
        arrays.release(task=False)
        rows = _marks_shared(table, parts)
        return pa.table(
            {"part": pa.array([r[0] for r in rows], pa.int64()),
             "keys": pa.array([r[1] for r in rows], pa.binary()),
             "hits": pa.array([r[2] for r in rows], pa.binary())}
        )

    def total(table: pa.Table) -> pa.Table:
        arrays.release(task=False)
        keys = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("keys")])
        hits = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in table.column("hits")])
        each, at = np.unique(keys, return_inverse=True)
        return pa.table({"key": each, "shared": np.bincount(at, hits).astype(np.int64)})

    return (
        bounded_batches(docs).select("text")
        .mapInArrow(deal, _BLOCKS)
        .groupBy("bucket").applyInArrow(count, "part long, keys binary, hits binary")
        .groupBy("part").applyInArrow(total, "key long, shared long")
    )


def load_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(set_id, tokens) of the wanted (doc_id, key), by key: the texts are read again.

    Up to a million wanted rows of two numbers go to the texts, beyond it they meet
    in a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("key").to_numpy()
            out, seen = [], set()
            for row, tokens in arrays.shingle_sets(batch.column("text"), size):
                key = int(_keys([arrays.digest(tokens)])[0])
                if key == want[row] and key not in seen:
                    seen.add(key)
                    out.append((key, tokens.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()),
                 pa.array([o[1] for o in out], pa.binary())],
                ["set_id", "tokens"],
            )

    if fits(wanted):
        wanted = F.broadcast(wanted)
    return bounded_batches(docs).select("doc_id", "text").join(wanted, "doc_id").mapInArrow(
        run, "set_id long, tokens binary"
    )


# --- groups that may link ----------------------------------------------------


def rare_tokens(sets: DataFrame, percent: int, buckets: int, parts: int) -> DataFrame:
    """(set_id, token): the shared ones of each set's first ``n - T + 1`` shingles,
    rarest first, for the sets that can link at all."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = _Dealer(buckets)
        for batch in batches:
            rows = zip(batch.column("set_id").to_pylist(), batch.column("tokens"))
            yield from _dealt(((i, np.frombuffer(t.as_py(), _U)) for i, t in rows), dealer)
        if (last := dealer.flush()) is not None:
            yield last
        arrays.release()

    def count(table: pa.Table) -> pa.Table:
        arrays.release(task=False)
        keys, owner, tokens = _read(table, _U)
        length, _ = _lengths(tokens)
        every = np.bincount(owner, minlength=len(keys)).astype(np.int32)
        more = length > 1
        own, tokens, length = owner[more], tokens[more], length[more]
        hits = np.bincount(own, minlength=len(keys)).astype(np.int32)
        # Sets by part, and their tokens in the order of the sets.
        by_part = np.argsort(keys % parts, kind="stable")
        by_part = by_part[every[by_part] > 0]
        place = np.empty(len(keys), np.int32)
        place[by_part] = np.arange(len(by_part), dtype=np.int32)
        order = np.argsort(place[own], kind="stable")
        tokens, length = tokens[order], length[order]
        keys, every, hits = keys[by_part], every[by_part], hits[by_part]
        ends = np.concatenate([[0], np.cumsum(hits)])
        rows = [
            (p, keys[a:b].tobytes(), every[a:b].tobytes(), hits[a:b].tobytes(),
             tokens[ends[a] : ends[b]].tobytes(), length[ends[a] : ends[b]].tobytes())
            for p, a, b in _runs(keys % parts)
        ]
        return pa.table(
            {"part": pa.array([r[0] for r in rows], pa.int64())}
            | {name: pa.array([r[i] for r in rows], pa.binary())
               for i, name in enumerate(("keys", "every", "hits", "tokens", "lengths"), 1)}
        )

    def choose(table: pa.Table) -> pa.Table:
        arrays.release(task=False)

        def whole(name, kind):
            return np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(name)])

        keys, hits = whole("keys", np.int64), whole("hits", np.int32)
        each, at = np.unique(keys, return_inverse=True)
        n = np.bincount(at, whole("every", np.int32)).astype(np.int64)
        owner = np.repeat(at, hits)
        tokens, lengths = whole("tokens", _U), whole("lengths", np.int32)
        order = np.lexsort((tokens, lengths, owner))
        owner, tokens = owner[order], tokens[order]
        shared = np.bincount(owner, minlength=len(each))
        need = -(-n * percent // 100)
        # Shingles that no other set holds come first and meet nobody.
        room = (n - need + 1) - (n - shared)
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        pick = place < np.where(shared >= need, room, 0)[owner]
        return pa.table(
            {"set_id": each[owner[pick]], "token": tokens[pick].view(np.int64)}
        )

    return (
        bounded_batches(sets).mapInArrow(deal, _BLOCKS)
        .groupBy("bucket").applyInArrow(
            count,
            "part long, keys binary, every binary, hits binary, tokens binary, lengths binary",
        )
        .groupBy("part").applyInArrow(choose, "set_id long, token long")
    )


def groups(rare: DataFrame) -> DataFrame:
    """(set_id, grp): sets that meet in a rare shingle, directly or through others."""
    hubs = rare.groupBy("token").agg(F.min("set_id").alias("hub"), F.count("*").alias("n"))
    links = rare.join(hubs.where("n > 1").drop("n"), "token").where("set_id <> hub")
    return components(
        links.select(F.col("set_id").alias("a"), F.col("hub").alias("b")).distinct()
    ).select(F.col("node").alias("set_id"), F.col("label").alias("grp"))


# --- search in a group --------------------------------------------------------


class _Index:
    """Inverted lists of some sets: (token, set) pairs in order, as one flat array."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.n)
        tokens = np.concatenate(sets)
        self.tokens, rank = np.unique(tokens, return_inverse=True)
        self.width = len(sets)
        self.flat = np.sort(rank.astype(np.int64) * self.width + owner)
        self.starts = np.searchsorted(self.flat, np.arange(len(self.tokens) + 1) * self.width)

    def search(self, query: np.ndarray, percent: int, skip: np.ndarray) -> np.ndarray:
        """Sets that reach the overlap with ``query``; ``skip`` marks sets not to ask."""
        n = len(query)
        need = required(n, percent)
        at = np.searchsorted(self.tokens, query)
        at[at == len(self.tokens)] = 0
        lists = at[self.tokens[at] == query]
        if len(lists) < need:
            return np.zeros(0, np.int64)
        length = self.starts[lists + 1] - self.starts[lists]
        lists = lists[np.argsort(length, kind="stable")]
        # The need-1 longest lists alone cannot reach the overlap.
        long = min(need - 1, self._long(length, need))
        short, far = lists[: len(lists) - long], lists[len(lists) - long :]
        lo, hi = self.starts[short], self.starts[short + 1]
        take = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo)
        merged = self.flat[take + np.arange(len(take))] % self.width
        count = np.bincount(merged, minlength=self.width)
        fits = (100 * self.n >= percent * n) & (percent * self.n <= 100 * n)
        found = np.flatnonzero((count >= need - long) & fits & ~skip)
        if len(found) == 0:
            return found
        overlap = count[found]
        if long:
            probe = far[:, None] * self.width + found[None, :]
            place = np.searchsorted(self.flat, probe)
            place[place == len(self.flat)] = 0
            overlap = overlap + (self.flat[place] == probe).sum(axis=0)
        return found[overlap * (100 + percent) >= percent * (n + self.n[found])]

    @staticmethod
    def _long(length: np.ndarray, need: int) -> int:
        """Lists to set aside: the longer the longest list, the more of them."""
        return int(need * np.log1p(length.max()) / (1 + np.log1p(length.max())))


def _join(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The smallest id that each set's links reach among these sets."""
    label = ids.copy()
    index = _Index(sets)
    for k in np.argsort(ids):
        for other in index.search(sets[k], percent, label == label[k]):
            low, high = sorted((label[k], label[other]))
            if low != high:
                label[label == high] = low
    return label


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole (grp, block) groups of a stream that is sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        group, block = batch.column("grp").to_numpy(), batch.column("block").to_numpy()
        cuts = np.flatnonzero((np.diff(group) != 0) | (np.diff(block) != 0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            here = (group[a], block[a])
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = here
    if held:
        yield pa.Table.from_batches(held)


def _sets_of(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    return (table.column("set_id").to_numpy(),
            [np.frombuffer(t.as_py(), _U) for t in table.column("tokens")])


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block")


def link_blocks(members: DataFrame, percent: int) -> DataFrame:
    """(set_id, label): components by the links inside each (grp, block)."""

    def run(batches):
        for table in _batches(batches):
            ids, sets = _sets_of(table)
            # Rows that repeat id and text give the same set again.
            ids, first = np.unique(ids, return_index=True)
            sets = [sets[k] for k in first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(_join(ids, sets, percent))], ["set_id", "label"]
            )

    return _grouped(members.select("grp", "block", "set_id", "tokens")).mapInArrow(
        run, "set_id long, label long"
    )


def search_blocks(members: DataFrame, asked: DataFrame, percent: int) -> DataFrame:
    """(a, b) links between asked sets and members of a block with another label.

    Both have grp, block, set_id, label and tokens. At most one link is given
    for an asked set and a label.
    """

    def run(batches):
        for table in _batches(batches):
            ids, sets = _sets_of(table)
            label, query = table.column("label").to_numpy(), table.column("asked").to_numpy(False)
            mine = np.flatnonzero(~query)
            if len(mine) == 0 or len(mine) == len(ids):
                continue
            index = _Index([sets[k] for k in mine])
            out = []
            for k in np.flatnonzero(query):
                hits = index.search(sets[k], percent, label[mine] == label[k])
                _, first = np.unique(label[mine][hits], return_index=True)
                out += [(int(ids[k]), int(ids[mine[h]])) for h in hits[first]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()),
                 pa.array([o[1] for o in out], pa.int64())], ["a", "b"]
            )

    columns = ("grp", "block", "set_id", "label", "tokens")
    both = members.select(*columns, F.lit(False).alias("asked")).unionByName(
        asked.select(*columns, F.lit(True).alias("asked"))
    )
    return _grouped(both).mapInArrow(run, "a long, b long")


def _large_groups(members: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """(set_id, label) of groups in several blocks, by links across blocks too."""
    held = saved(members.join(label, "set_id"), "join-blocks")
    inside = held.select(F.col("set_id").alias("a"), F.col("label").alias("b"))

    def elsewhere(rows: DataFrame) -> DataFrame:
        copies = rows.withColumn(
            "__to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        ).where(F.col("__to") != F.col("block"))
        return copies.drop("block").withColumnRenamed("__to", "block")

    heads = held.where("set_id = label")
    across = search_blocks(held, elsewhere(heads), percent)
    links = saved(inside.unionByName(across), "join-links")

    def labelled(links: DataFrame) -> DataFrame:
        known = components(links).withColumnRenamed("node", "set_id")
        return held.drop("label").join(known, "set_id", "left").withColumn(
            "label", F.coalesce("label", "set_id")
        )

    now = saved(labelled(links), "join-blocks")
    sizes = now.groupBy("grp", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("grp").agg(F.max(F.struct("n", "label"))["label"].alias("main"))
    rest = now.join(largest, "grp").where("label <> main").drop("main")
    more = search_blocks(now, elsewhere(rest), percent)
    named = labelled(saved(links.unionByName(more), "join-links"))
    return named.select("set_id", "label").distinct()


# --- the join -----------------------------------------------------------------


def join(
    docs: DataFrame,
    size: int = 4,
    percent: int = 85,
    key: str = "doc_id",
    text: str = "text",
    block_sets: int = BLOCK_SETS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    spark = docs.sparkSession
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = saved(describe(source, size), "join-sets")
    present = rows.where("n_shingles > 0 and doc_id is not null")
    reps = present.groupBy("digest").agg(
        F.min("doc_id").alias("name"), F.first("key").alias("set_id"),
        F.first("n_shingles").alias("n"),
    )
    count, tokens = present.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    cores = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = max(cores, count // PART_SETS + 1)
    buckets = max(cores, tokens // BUCKET_TOKENS + 1)
    known = source.where(F.col("doc_id").isNotNull())
    shared = shared_counts(known, size, buckets, parts)
    alive = saved(
        reps.join(shared.withColumnRenamed("key", "set_id"), "set_id")
        .where(100 * F.col("shared") >= percent * F.col("n"))
        .select(F.col("name").alias("doc_id"), F.col("set_id").alias("key"), "n"),
        "join-alive",
    )
    sets = saved(load_sets(known, alive.select("doc_id", "key"), size), "join-tokens")
    left = int(alive.agg(F.sum("n")).first()[0] or 0)
    rare = saved(rare_tokens(sets, percent, max(cores, left // BUCKET_TOKENS + 1), parts), "join-rare")
    grouped = saved(groups(rare), "join-groups")
    counted = grouped.join(alive.select(F.col("key").alias("set_id"), "n"), "set_id")
    sizes = counted.groupBy("grp").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"))
    blocks = F.ceil(F.greatest(F.col("sets") / block_sets, F.col("tokens") / BLOCK_TOKENS))
    dealt = grouped.join(sizes.select("grp", blocks.alias("blocks")), "grp").withColumn(
        "block", F.pmod(F.xxhash64("set_id"), F.col("blocks"))
    )
    members = sets.join(dealt, "set_id")
    label = saved(link_blocks(members, percent), "join-labels")
    large = dealt.where("blocks > 1")
    if large.limit(1).count():
        big = saved(_large_groups(sets.join(large, "set_id"), label, percent), "join-large")
        label = label.join(big.select("set_id"), "set_id", "left_anti").unionByName(big)
    named_sets = label.join(alive.select(F.col("key").alias("set_id"), F.col("doc_id").alias("name")), "set_id")
    least = named_sets.groupBy("label").agg(F.min("name").alias("component"))
    moved = (
        reps.select("digest", "set_id", "name")
        .join(label.join(least, "label").drop("label"), "set_id", "left")
        .withColumn("component", F.coalesce("component", "name"))
    )
    # Most documents are alone in their component and need no partner here.
    copies = present.groupBy("digest").agg(F.count("*").alias("rows"))
    named = moved.join(copies, "digest").where("rows > 1 or component <> name")
    return rows.join(named.select("digest", "component"), "digest", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0),
               F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component stays, the one with the smallest id.

    Rows that repeat id and text go but for one. Rows that share an id but not
    the text stay together if one of them is the head of its component. Rows
    without an id stay. Only ids that go or repeat are joined to the texts.
    """
    named = join(docs, size, percent)
    marks = (
        named.where("doc_id is not null").groupBy("doc_id")
        .agg(F.count_if(F.col("component_id") == F.col("doc_id")).alias("heads"),
             F.count("*").alias("rows"))
        .where("heads = 0 or rows > 1")
        .select("doc_id", F.when(F.col("heads") == 0, F.lit("go")).otherwise(F.lit("once")).alias("__mark"))
    )
    marks = saved(marks, "join-marks")
    if fits(marks):
        marks = F.broadcast(marks)
    marked = docs.join(marks, "doc_id", "left")
    order = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(1))
    repeated = (
        marked.where("__mark = 'once'").withColumn("__n", F.row_number().over(order))
        .where("__n = 1").select(*docs.columns)
    )
    return marked.where("__mark is null").select(*docs.columns).unionByName(repeated)
