"""Exact top-k search by integer inner product: query terms scatter postings into score arrays, block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Candidates and queries of a block at most on average; a task holds one block of each.
BLOCK = 4096
#: Sums below this are exact in doubles.
EXACT = 2**53
LONG = 2**63 - 1


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; beyond the long range its nearest end."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


class Postings:
    """The inverted lists of one block: per term the rows that hold it and their weights. Rows are in order of id."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> None:
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        place = np.empty(len(ids), np.int64)
        place[self.order] = np.arange(len(ids))
        row, term = terms_of(offsets)
        used = values != 0
        row, term, values = place[row[used]], term[used], values[used]
        by_term = np.lexsort((row, term))
        row, term, values = row[by_term], term[by_term], values[by_term]
        self.most = int(max(abs(int(values.min())), abs(int(values.max())))) if len(values) else 0
        starts = np.searchsorted(term, np.arange((int(term[-1]) if len(term) else -1) + 2))
        self.lists = []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            # A term that every row holds needs no places.
            self.lists.append((None if hi - lo == len(ids) else row[lo:hi], values[lo:hi]))
        self.kinds: dict[type, list] = {}

    def typed(self, kind: type) -> list:
        if kind not in self.kinds:
            self.kinds[kind] = [(where, weights.astype(kind)) for where, weights in self.lists]
        return self.kinds[kind]

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The scores of all rows for one sparse query, term at a time; exact, as doubles or as Python's integers."""
        most = max(map(abs, weights.tolist()), default=0)
        kind = float if most * self.most * len(terms) < EXACT else object
        lists, total = self.typed(kind), np.zeros(len(self.ids), kind)
        for term, weight in zip(terms.tolist(), weights.astype(kind).tolist(), strict=True):
            if term < len(lists):
                where, values = lists[term]
                if where is None:
                    total += values * weight
                else:
                    total[where] += values * weight
        return total if kind is float else np.clip(total, -LONG - 1, LONG)

    def best(self, query_id: int, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The ``k`` highest (id, score) of other ids, ties to the smaller id."""
        total = self.scores(terms, weights)
        lo, hi = np.searchsorted(self.ids, query_id, "left"), np.searchsorted(self.ids, query_id, "right")
        rest = np.concatenate((total[:lo], total[hi:])) if hi > lo else total
        if not len(rest):
            return []
        k = min(k, len(rest))
        bar = np.partition(rest, len(rest) - k)[len(rest) - k] if rest.dtype != object else sorted(rest)[-k]
        above = np.flatnonzero(rest > bar)
        at = np.concatenate((above, np.flatnonzero(rest == bar)[: k - len(above)]))
        return [(int(self.ids[i if i < lo else i + hi - lo]), int(rest[i])) for i in at.tolist()]


def terms_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and position in its row of each value of a list column."""
    lengths = np.diff(offsets)
    return np.repeat(np.arange(len(lengths)), lengths), np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)


def _lists(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = table.column("terms").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    return table.column("id").to_numpy(), offsets - offsets[0], column.flatten().to_numpy()


def search_block(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The best ``k`` rows of one block for each query of one block."""
    found: list[tuple[int, int, int]] = []
    if queries.num_rows and rows.num_rows:
        postings = Postings(*_lists(rows))
        ids, offsets, values = _lists(queries)
        for at, query_id in enumerate(ids.tolist()):
            row = values[offsets[at] : offsets[at + 1]]
            terms = np.flatnonzero(row)
            found += [(query_id, i, s) for i, s in postings.best(query_id, terms, row[terms], k)]
    columns = zip(*found, strict=True) if found else ((), (), ())
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def exact_topk(vectors: DataFrame, k: int = 5, every: int = 50, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of each query, all if there are fewer.

    Components become floor(256 * x) in double precision. Queries are the rows whose id is divisible by
    ``every``, candidates all rows with another id; equal scores go to the smaller id. Every query meets
    every candidate: both are dealt by a hash of the id into blocks of some ``block`` rows, a task takes a
    block of each, builds the block's postings (term: rows and weights) and adds each query's terms one
    by one into a dense array of scores; the block's best ``k`` go on to the merge. A task's memory
    doesn't grow with the table, nor is anything broadcast.
    Rows with a null id, or a vector that is null or holds null or non-finite components, take no part.
    Vectors of different lengths count as padded with zeros, so an empty one scores 0. Sums are exact;
    components and scores beyond the long range are its nearest end. Rows that repeat an id are separate
    candidates; such an id asks once, with its least vector. Other columns are ignored. An empty table
    gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    rows = rows.select("id", quantised(F.col("vec")).alias("terms"))
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("terms").alias("terms"))
    total = vectors.count()
    n_blocks, n_asked = max(1, -(-total // block)), max(1, -(-total // (every * block)))
    dealt = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = asked.select(dealt(n_asked, 1).alias("q"), numbers(n_blocks).alias("b"), "id", "terms")
    right = rows.select(numbers(n_asked).alias("q"), dealt(n_blocks, 2).alias("b"), "id", "terms")

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        return search_block(queries, candidates, k)

    found = left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

