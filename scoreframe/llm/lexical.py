"""Ranked lexical search by term partitioning: item bundles pass the owners of terms.

The index is cut by term among a few owners, rare terms first, and each owner's
lists are cut into blocks of documents. Items travel in bundles: a bundle starts
for every block without anything, and at each owner it meets the lists of the
block (a cogroup) and adds, item by item, what the owner's terms give to the
scores of documents. The scores gathered so far, as sparse pairs of document and
sum, go on to the next owner. After the last one the best of each block are
chosen, and the few of all blocks meet in the end.

All scores are integers that only grow. What the terms of later owners can add at
most is known, so a document goes no further once its sum and that bound stay
below the k-th best sum of the block: it can't be among the k best.

What a driver or a task holds is bounded: terms share ``CELLS`` cells, and one byte
a cell names the owner; blocks hold ``BLOCK_POSTINGS`` list entries and bundles
``BUNDLE_TERMS`` terms, on average over a hash. Terms that no item asks for are left
out of the index (a cell of theirs may let some in); document counts and lengths
are over all documents.

Terms are known by 64-bit hashes of their bytes, A-Z lower-cased: runs of digits,
letters and everything beyond ASCII. Null and empty texts have none; they count
neither as documents with a term nor in any list. Rows are documents of their
own, also with an id that repeats; a null id ranks after others of its score.
Item rows are ranked one by one as well. Equal scores go by document id. Other
columns are left out. Without documents or items there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import arrays
from .base import saved

#: Cells of the tables that say which terms are asked for and who owns them.
CELLS = 2**18
BLOCK_POSTINGS = 1_500_000
BLOCK_DOCUMENTS = 50_000
BUNDLE_TERMS = 10_000
OWNERS = 3
#: The owner of the lists of document ids.
_NAMES = -1
_NO_ID = np.iinfo(np.int64).max

_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_COUNTED = "row long, id long, n long, terms array<long>, tfs array<int>"
_INDEX = ("block int, owner int, terms array<long>, ends array<int>, docs array<int>, "
          "parts array<int>, ids array<long>")
_BUNDLES = ("block int, bundle int, items array<long>, ends array<int>, terms array<long>, "
            "gains array<long>, limits array<long>, owners array<int>, sums_ends array<int>, "
            "docs array<int>, sums array<long>")
_FOUND = "item long, id long, score long"


def _lists(ends: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(),
             "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _sort_count(owner: np.ndarray, term: np.ndarray, n: np.ndarray):
    """Sum ``n`` per (owner, term), in their order."""
    order = np.lexsort((term, owner))
    owner, term = owner[order], term[order]
    new = np.ones(len(term), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return owner[at], term[at], np.add.reduceat(n[order], at) if len(at) else n[:0]


def count_terms(rows: DataFrame, key: str, text: str, cells: np.ndarray | None = None) -> DataFrame:
    """(row, id, n, terms, tfs) of every row: the number of its terms, the distinct ones
    and how often each occurs; with ``cells`` only terms in a marked cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(_COUNTED)
        for batch in batches:
            held: list[tuple] = []  # of a text that goes on
            total = 0
            for first, data, offsets, goes_on in arrays.parts(batch.column(2), outside=_OUTSIDE):
                starts, stops, at = arrays.find_words(data, offsets, _OUTSIDE)
                term = arrays.hash_words(data, starts, stops, lower=True).view(np.int64)
                count = np.diff(at)
                owner = np.repeat(np.arange(len(count)), count)
                if cells is not None:
                    keep = cells[term & (CELLS - 1)]
                    owner, term = owner[keep], term[keep]
                owner, term, tf = _sort_count(owner, term, np.ones(len(term), np.int64))
                if goes_on or held:
                    held.append((term, tf))
                    total += int(count[0])
                    if goes_on:
                        continue
                    term, tf = (np.concatenate(x) for x in zip(*held))
                    owner, term, tf = _sort_count(np.zeros(len(term), np.int64), term, tf)
                    count, held, total = np.array([total]), [], 0
                size = len(count)
                ends = np.searchsorted(owner, np.arange(size), "right")
                yield pa.record_batch([
                    batch.column(0).slice(first, size), batch.column(1).slice(first, size),
                    pa.array(count, pa.int64()), _lists(ends, term, pa.int64()),
                    _lists(ends, tf, pa.int32()),
                ], schema=schema)

    numbered = rows.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), text
    )
    return numbered.mapInArrow(run, _COUNTED)


def _flat(column, kind=np.int64) -> np.ndarray:
    """All values of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)


def _sizes(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.diff(column.offsets.to_numpy()).astype(np.int64)


def _parts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What one occurrence list entry gives for a weight of one."""
    m = 100 - 75 + (75 * n * documents) // length
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _weights(counted: DataFrame, documents: int, length: int) -> DataFrame:
    """(term, df, best, weight): lists, the best entry of each and its weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term = _flat(batch.column("terms"))
            n = np.repeat(batch.column("n").to_numpy(), _sizes(batch.column("terms")))
            part = _parts(_flat(batch.column("tfs")), n, documents, length)
            order = np.argsort(term, kind="stable")
            term, part = term[order], part[order]
            at = np.flatnonzero(np.diff(term, prepend=term[:1] - 1)) if len(term) else order
            if len(at):
                yield pa.record_batch(
                    [pa.array(term[at]), pa.array(np.diff(at, append=len(term))),
                     pa.array(np.maximum.reduceat(part, at))], names=["term", "df", "best"])

    whole = 2 * documents + 2
    return (
        counted.select("n", "terms", "tfs").mapInArrow(run, "term long, df long, best long")
        .groupBy("term").agg(F.sum("df").alias("df"), F.max("best").alias("best"))
        .withColumn("weight", F.floor(
            F.lit(1000.0) * F.log(F.lit(float(whole)) / (2 * F.col("df") + 1).cast("double"))))
    )


def _cells(terms: DataFrame) -> np.ndarray:
    """The cells that hold a term."""
    marked = np.zeros(CELLS, bool)
    found = terms.select(F.col("term").bitwiseAND(F.lit(CELLS - 1)).alias("cell")).distinct().toArrow()
    marked[found.column("cell").to_numpy()] = True
    return marked


def _owners(weights: DataFrame, owners: int) -> np.ndarray:
    """The owner of each cell: rare terms first, about as many list entries each."""
    cells = (
        weights.groupBy(F.col("term").bitwiseAND(F.lit(CELLS - 1)).alias("cell"))
        .agg(F.max("df").alias("df"), F.sum("df").alias("entries")).toArrow()
    )
    cell, df, entries = (cells.column(c).to_numpy() for c in ("cell", "df", "entries"))
    order = np.lexsort((cell, df))
    before = np.cumsum(entries[order]) - entries[order]
    table = np.zeros(CELLS, np.int8)
    table[cell[order]] = np.minimum(before * owners // max(1, int(entries.sum())), owners - 1)
    return table


def _build(counted: DataFrame, blocks: int, owner_of: np.ndarray, documents: int, length: int) -> DataFrame:
    """The index: per block and owner the lists of its terms, and the ids of the block."""

    def block(key: tuple, rows: pa.Table) -> pa.Table:
        number = key[0].as_py()
        names = rows.column("id").combine_chunks().fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        place = np.empty(len(names), np.int64)
        order = np.lexsort((rows.column("row").to_numpy(), names))
        place[order] = np.arange(len(names))
        sizes = _sizes(rows.column("terms"))
        term = _flat(rows.column("terms"))
        part = _parts(_flat(rows.column("tfs")), np.repeat(rows.column("n").to_numpy(), sizes), documents, length)
        doc = np.repeat(place, sizes)
        by_term = np.lexsort((doc, term, owner_of[term & (CELLS - 1)]))
        term, part, doc = term[by_term], part[by_term], doc[by_term]
        new = np.flatnonzero(np.diff(term, prepend=term[:1] - 1)) if len(term) else by_term
        ends, distinct = np.append(new[1:], len(term)), term[new]
        owned = owner_of[distinct & (CELLS - 1)]
        out = [(number, _NAMES, [], [], [], [], names[order])]
        for owner in np.unique(owned).tolist():
            mine = np.flatnonzero(owned == owner)
            a, z = new[mine[0]], ends[mine[-1]]
            out.append((number, owner, distinct[mine], ends[mine] - a, doc[a:z], part[a:z], []))
        return pa.table([list(c) for c in zip(*out)], schema=_schema(_INDEX))

    dealt = counted.where("n > 0").withColumn(
        "block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(block, _INDEX)


def _bundles(asked: DataFrame, bundles: int, blocks: int, owner_of: np.ndarray) -> DataFrame:
    """One row per bundle of items and block, without sums."""

    def bundle(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("item", "ascending"), ("term", "ascending")])
        item, term, gain, best = (rows.column(c).to_numpy() for c in ("item", "term", "gain", "best"))
        items, first = np.unique(item, return_index=True)
        return pa.table(
            [[v] for v in (0, key[0].as_py(), items, np.append(first[1:], len(item)), term, gain,
                           gain * best, owner_of[term & (CELLS - 1)], np.zeros(len(items), np.int64), [], [])],
            schema=_schema(_BUNDLES))

    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    made = (
        asked.withColumn("bundle", F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int"))
        .groupBy("bundle").applyInArrow(bundle, _BUNDLES)
    )
    return made.withColumn("block", every).select(*[f.split()[0] for f in _BUNDLES.split(", ")])


def _scores(carried: pa.Table, lists: pa.Table, owner: int, k: int):
    """Per item of a bundle: the documents still in question and their sums."""
    row = {c: carried.column(c)[0].values.to_numpy(zero_copy_only=False) for c in carried.column_names[2:]}
    mine = {c: v for c, v in _owned(lists, owner).items()}
    size = max(int(row["docs"].max(initial=-1)), int(mine["docs"].max(initial=-1))) + 1
    begin = done = 0
    for item, end, held in zip(row["items"], row["ends"], row["sums_ends"]):
        sums = np.zeros(size, np.int64)
        sums[row["docs"][done:held]] = row["sums"][done:held]
        term, by = row["terms"][begin:end], row["owners"][begin:end]
        now = np.flatnonzero(by == owner)
        at = np.searchsorted(mine["terms"], term[now])
        for j, t in zip(now, at):
            if t < len(mine["terms"]) and mine["terms"][t] == term[j]:
                a, z = mine["ends"][t - 1] if t else 0, mine["ends"][t]
                sums[mine["docs"][a:z]] += row["gains"][begin + j] * mine["parts"][a:z]
        rest = int(row["limits"][begin:end][by > owner].sum())
        docs = np.flatnonzero(sums)
        if len(docs) > k:
            bar = np.partition(sums[docs], -k)[-k]
            docs = docs[sums[docs] + rest >= bar]
        yield int(item), docs, sums[docs]
        begin, done = end, held


def _owned(lists: pa.Table, owner: int) -> dict[str, np.ndarray]:
    """The lists of one owner in a block; no lists if it has none there."""
    found = lists.filter(pa.compute.equal(lists.column("owner"), owner))
    kinds = {"terms": np.int64, "ends": np.int64, "docs": np.int64, "parts": np.int64, "ids": np.int64}
    return {c: _flat(found.column(c), kind) if len(found) else np.zeros(0, kind) for c, kind in kinds.items()}


def _stage(owner: int, last: bool, k: int):
    """What one owner does with a bundle and its lists of a block."""
    schema = _schema(_FOUND if last else _BUNDLES)

    def meet(bundle: pa.Table, lists: pa.Table) -> pa.Table:
        if not len(bundle):
            return schema.empty_table()
        scored = list(_scores(bundle, lists, owner, k))
        if not last:
            ends = np.cumsum([len(d) for _, d, _ in scored])
            flat = [np.concatenate([s[i] for s in scored]) for i in (1, 2)]
            keep = [bundle.column(c) for c in bundle.column_names[:8]]
            return pa.table([*keep, *[[v] for v in (ends, *flat)]], schema=schema)
        names, out = _owned(lists, _NAMES)["ids"], []
        for item, found, sums in scored:
            best = np.lexsort((found, -sums))[:k]
            out.append((np.full(len(best), item), names[found[best]], sums[best]))
        item, name, score = (np.concatenate([o[i] for o in out]) for i in range(3))
        return pa.table([item, pa.array(name, pa.int64(), mask=name == _NO_ID), score], schema=schema)

    return meet


def rank(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    owners: int = OWNERS,
    block_postings: int = BLOCK_POSTINGS,
    bundle_terms: int = BUNDLE_TERMS,
    doc_key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores per item row."""
    spark = docs.sparkSession
    wanted = saved(count_terms(items, item_key, text), "search-items")
    terms = wanted.select("row", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select(
        F.col("row").alias("item"), F.col("t.terms").alias("term"), F.col("t.tfs").alias("times"))
    counted = saved(count_terms(docs, doc_key, text, _cells(terms)), "search-terms")
    facts = counted.agg(
        F.count_if(F.col("n") > 0), F.sum("n"), F.sum(F.size("terms"))).first()
    documents, length, entries = (int(x or 0) for x in facts)
    if not documents:
        return spark.createDataFrame([], f"{item_key} long, rank int, {doc_key} long, score long")
    weights = saved(_weights(counted, documents, length), "search-weights")
    owner_of = _owners(weights, owners)
    blocks = max(-(-entries // block_postings), -(-documents // BLOCK_DOCUMENTS), 1)
    index = saved(_build(counted, blocks, owner_of, documents, length), "search-index")

    asked = terms.join(weights, "term").where("weight > 0").select(
        "item", "term", (F.col("times") * F.col("weight")).alias("gain"), "best")
    bundles = max(1, -(-terms.count() // bundle_terms))
    carried = _bundles(asked, bundles, blocks, owner_of)
    copies = F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle")

    for owner in range(owners):
        last = owner == owners - 1
        lists = index.where(F.col("owner").isin(owner, *([_NAMES] if last else []))).select("*", copies)

        carried = carried.groupBy("block", "bundle").cogroup(lists.groupBy("block", "bundle")).applyInArrow(
            _stage(owner, last, k), _FOUND if last else _BUNDLES)

    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = carried.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(wanted.select(F.col("row").alias("item"), F.col("id").alias(item_key)), "item").select(
        item_key, "rank", F.col("id").alias(doc_key), "score")
