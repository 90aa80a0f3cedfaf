"""Embedding near-duplicates by a pivot-permutation index.

Every distinct vector is described by the ordered list of its nearest reference points. Inverted lists
are kept for the pairs of its very nearest ones, so that two vectors meet in a list when they share two
of those; the first two that they share name the one list that counts them. In a list, the pivots that
two whole descriptions share are counted, pairs with enough of them are candidates, and candidates are
verified by their cosine in double precision, list chunk against list chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from hirelake.llm.common import cut
from hirelake.llm.components import connected_components

#: Nearest pivots that describe a vector, the first of them that its lists are named by, and how many a candidate shares.
NEAREST, LEADING, SHARED = 8, 4, 3
#: Reference points per cube root of the number of distinct vectors; they are broadcast (some MB for 1e9 vectors).
PIVOTS_PER_ROOT = 16
#: Vectors sampled for each pivot, and the cosine below which two of them may both be pivots.
SAMPLE_PER_PIVOT, DISTANT = 4, 0.5
#: Vectors of a list in one chunk, on average.
CHUNK = 1024
#: A vector with more than one of so many parts of all rows is hot.
HOT = 1000
#: Bits of a pivot's number in a list's key.
_BITS = 20


def choose_pivots(classes: DataFrame, count: int) -> dict[int, np.ndarray]:
    """By dimension, mutually distant unit vectors from a bounded sample, those whose hash is least.

    A group of near copies gives one pivot at most: pivots inside a group would order its members by
    their noise. Where the sample has too few distant vectors, random directions fill up.
    """
    wanted = int(max(4 * NEAREST, np.ceil(PIVOTS_PER_ROOT * count ** (1 / 3))))
    rows = classes.select("vec", F.xxhash64("vec").alias("h")).orderBy("h").limit(SAMPLE_PER_PIVOT * wanted).collect()
    by_dim: dict[int, list] = {}
    for r in rows:
        by_dim.setdefault(len(r.vec), []).append(r.vec)
    found = {}
    for dim, vecs in by_dim.items():
        sample = _unit(vecs)
        free, chosen = np.ones(len(sample), bool), []
        for k in range(len(sample)):
            if free[k] and len(chosen) < wanted:
                chosen.append(sample[k])
                free &= sample @ sample[k] < DISTANT
        fill = np.random.default_rng(dim).normal(size=(wanted - len(chosen), dim))
        found[dim] = np.concatenate([np.reshape(chosen, (-1, dim)), fill / np.linalg.norm(fill, axis=1, keepdims=True)])
    return found


def permutations(x: np.ndarray, pivots: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """The numbers of each row's nearest pivots, nearest first; ties by the lower number."""
    order = np.argsort(-np.round(x @ pivots.T, 12), axis=1, kind="stable")
    return order[:, :nearest].astype(np.int32)


def list_keys(perms: np.ndarray, dim: int) -> np.ndarray:
    """One key for each pair of each row's leading pivots; that of the dimension alone where there is one pivot."""
    p = np.sort(perms[:, :LEADING], axis=1).astype(np.int64)
    if p.shape[1] < 2:
        return np.full((len(p), 1), dim << 2 * _BITS, np.int64)
    return np.stack([dim << 2 * _BITS | p[:, i] << _BITS | p[:, j] for i, j in combinations(range(p.shape[1]), 2)], 1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, lest squares leave the range of doubles."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def shared_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many pivots each row of ``a`` shares with each row of ``b``."""
    pivots, where = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
    marks = np.zeros((len(a) + len(b), len(pivots)), np.float32)
    marks[np.repeat(np.arange(len(marks)), a.shape[1]), where] = 1
    return marks[: len(a)] @ marks[len(a) :].T


def verify(key: int, left: dict, right: dict | None, threshold: float) -> list[tuple[int, int, int]]:
    """(class, linked rows, root) of the linked classes in a list chunk, or between two chunks.

    A pair counts only in the list that its first two shared leading pivots name.
    """
    a, b = left, right or left
    near = shared_counts(a["perm"], b["perm"]) >= min(SHARED, a["perm"].shape[1])
    i, j = np.nonzero(near & (a["unit"] @ b["unit"].T >= threshold))
    if right is None:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return []
    pa_, pb = (np.sort(x["perm"][:, :LEADING], axis=1) for x in (a, b))
    size = min(2, pa_.shape[1])
    names = np.array([key >> _BITS & (1 << _BITS) - 1, key & (1 << _BITS) - 1])[-size:]
    links: dict[int, int] = {}
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for lo in range(0, len(i), 65536):
        x, y = i[lo : lo + 65536], j[lo : lo + 65536]
        shared = (pa_[x][:, :, None] == pb[y][:, None, :]).any(2)
        first = np.where(shared & (np.cumsum(shared, axis=1) <= size), pa_[x], -1)
        first.sort(axis=1)
        mine = (first[:, -size:] == names).all(1)
        for u, v in zip(x[mine].tolist(), y[mine].tolist(), strict=True):
            cu, cv = a["cid"][u], b["cid"][v]
            links[cu] = links.get(cu, 0) + b["n"][v]
            links[cv] = links.get(cv, 0) + a["n"][u]
            root[max(find(cu), find(cv))] = min(find(cu), find(cv))
    return [(c, n, find(c)) for c, n in links.items()]


def near_links(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``.

    Two vectors are linked when their cosine in double precision is at least ``threshold``; labels play
    no part. A vector that is null, empty, zero, or holds null or non-finite components links with
    nothing, and so does one with a null id; vectors of different lengths never link. Equal vectors are
    one class, compared once, and count each other as links. Rows that repeat an id are separate rows of
    that id's class. component_id is the least id that links reach, null for a null id; ``kept`` tells
    whether it is the row's own. Candidates share two of the four nearest pivots and three of the eight,
    so a link between very different pivots' neighbourhoods can be missed (recall is measured in the
    tests); none is reported that isn't one. Members of one near-copy group all meet: counting each
    one's links takes as many comparisons as the group has pairs, made by chunks. Other columns are ignored. An empty table gives an empty result.
    """
    narrow = isinstance(vectors.schema[vec_col].dataType.elementType, FloatType)
    kind, real = ("array<float>", np.float32) if narrow else ("array<double>", np.float64)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("vec"))
    top = F.array_max(F.transform("vec", F.abs))
    good = F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v)) & (top > 0) & (top < float("inf"))
    marked = cut(rows.select("id", F.when(F.coalesce(good, F.lit(False)), F.col("vec")).alias("vec")), "vectors")
    classes = cut(marked.where("vec IS NOT NULL").groupBy("vec").agg(F.min("id").alias("cid"), F.count("*").alias("n")), "vector-classes")
    count = classes.count()
    pivots = vectors.sparkSession.sparkContext.broadcast(choose_pivots(classes, count))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_dim: dict[int, list[int]] = {}
            vecs = batch.column(1).to_pylist()
            for k, v in enumerate(vecs):
                by_dim.setdefault(len(v), []).append(k)
            for dim, at in by_dim.items():
                x = _unit([vecs[k] for k in at])
                # A dimension that no pivot has is rare: its vectors share one list.
                perms = permutations(x, pivots.value[dim]) if dim in pivots.value else np.zeros((len(at), 1), np.int32)
                raw = np.array([vecs[k] for k in at], real)
                columns = [batch.column(0).take(pa.array(at)), pa.array([p.tobytes() for p in perms], pa.binary()), pa.array([v.tobytes() for v in raw], pa.binary()), pa.array(list_keys(perms, dim).tolist(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["cid", "perm", "raw", "keys"])

    described = cut(classes.select("cid", "vec").mapInArrow(describe, "cid long, perm binary, raw binary, keys array<long>"), "permutations")
    postings = described.select("cid", F.explode("keys").alias("key"))
    sizes = postings.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    useful = postings.join(sizes, "key")
    chunk = F.pmod(F.xxhash64("cid"), F.ceil(F.col("size") / CHUNK)).alias("chunk")
    members = described.join(classes.select("cid", "n"), "cid").select("cid", F.struct("cid", "n", "perm", "raw").alias("m"))
    full = useful.select("key", "size", "cid", chunk).join(members, "cid")
    chunks = full.groupBy("key", "chunk").agg(F.max("size").alias("size"), F.collect_list("m").alias("ms"))
    whole = chunks.select("key", F.col("ms").alias("a"), F.lit(None).cast(chunks.schema["ms"].dataType).alias("b"))
    hot = chunks.where(F.col("size") > CHUNK)
    across = hot.alias("l").join(hot.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.chunk") < F.col("r.chunk"))).select("l.key", F.col("l.ms").alias("a"), F.col("r.ms").alias("b"))

    def columns(ms: list[dict]) -> dict:
        perm, raw = (np.frombuffer(b"".join([m[k] for m in ms]), kind).reshape(len(ms), -1) for k, kind in (("perm", np.int32), ("raw", real)))
        return {"perm": perm, "unit": _unit(raw)} | {k: [m[k] for m in ms] for k in ("cid", "n")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lo in range(0, batch.num_rows, 64):
                for key, a, b in zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns), strict=True):
                    found += verify(key, columns(a), b and columns(b), threshold)
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], ["cid", "links", "root"])

    checked = cut(whole.unionByName(across).mapInArrow(run, "cid long, links long, root long"), "vector-links")
    stars = connected_components(checked.select("cid", "root"))
    totals = checked.groupBy("cid").agg(F.sum("links").alias("links"))
    known = classes.join(totals, "cid", "left").join(stars.withColumnRenamed("node", "cid"), "cid", "left").select("vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    lone = marked.where("vec IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    # At most HOT vectors have that share of the rows; their rows find their class without a shuffle.
    total = classes.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(cut(known.join(classes.where(F.col("n") * HOT > total).select("vec"), "vec", "left_semi"), "hot-vectors"))
    some = marked.where("vec IS NOT NULL")
    cold = some.join(hot.select("vec"), "vec", "left_anti").join(known, "vec")
    linked = cold.unionByName(some.join(hot, "vec")).select("id", "n_links", "component_id")
    return linked.unionByName(lone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
