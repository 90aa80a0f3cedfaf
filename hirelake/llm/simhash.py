"""SimHash near-duplicates: 64-bit fingerprints linked through BK-trees of pigeonhole shards.

Two fingerprints that differ in at most r bits agree on one of r + 1 segments of the 64 bits, and of
the other bits on one of r + 1 pieces again. Each (segment, piece) value is a shard; the fingerprints
of a shard meet in bounded chunks, each of which becomes a BK-tree. A shard with more than one chunk
sends each chunk's tree to every later chunk of the same shard, so no task holds a whole hot shard.
The set of all trees has no size bound, so trees travel by shard key instead of to every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from hirelake.llm.common import cut
from hirelake.llm.components import connected_components

SEED = 42
#: Fingerprints in one tree at most, on average.
TREE_SIZE = 2048
#: A fingerprint with more than one of so many parts of all rows is hot.
HOT = 1000


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority bits of the XXH64 values of the text's word shingles; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, last = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: last - 1] + 1).tolist()]
    stops = ends[min(width, len(words)) - 1 :].tolist()
    hashes = np.array([xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts, stops, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, last, 65536):
        part = hashes[k : k + 65536, None].view(np.uint8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, width) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def _cuts(width: int, parts: int) -> list[tuple[int, int]]:
    bounds = [width * i // parts for i in range(parts + 1)]
    return list(zip(bounds, bounds[1:], strict=False))


def _bits(value: Column, low: int, high: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def shard_keys(fp: Column, radius: int) -> Column:
    """The array of shard keys of a fingerprint: (segment, piece of the rest) with their values."""
    if not 1 <= radius <= 7:
        raise ValueError("the radius must be from 1 to 7 bits")
    keys, parts = [], radius + 1
    for s, (low, high) in enumerate(_cuts(64, parts)):
        rest = _bits(fp, 0, low) if low else F.lit(0).cast("long")
        if high < 64:
            rest = rest.bitwiseOR(F.shiftleft(_bits(fp, high, 64), low))
        for p, (begin, end) in enumerate(_cuts(64 - high + low, parts)):
            # Values of one (segment, piece) stay apart from those of another by the leading number.
            number = F.shiftleft(F.lit(s * parts + p).cast("long"), high - low).bitwiseOR(_bits(fp, low, high))
            keys.append(F.shiftleft(number, end - begin).bitwiseOR(_bits(rest, begin, end)))
    return F.array(*keys)


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        if self.values:
            at = 0
            while (nearer := self.children[at].get(edge := (value ^ self.values[at]).bit_count())) is not None:
                at = nearer
            self.children[at][edge] = len(self.values)
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the values at most ``radius`` bits away; other edges are not followed."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (value ^ self.values[at]).bit_count()
            if distance <= radius:
                found.append(at)
            kids = self.children[at]
            if len(kids) > 2 * radius:
                todo += (k for e in range(distance - radius, distance + radius + 1) if (k := kids.get(e)) is not None)
            else:
                todo += (k for e, k in kids.items() if -radius <= e - distance <= radius)
        return found


def link_chunk(tree_values: list[int], probes: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Edges that join the values which a chain of links connects: a star for each local component."""
    mask = (1 << 64) - 1
    values = tree_values + (probes or [])
    root = list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    tree = BKTree()
    if probes is None:
        for i, v in enumerate(tree_values):
            for j in tree.within(v & mask, radius):
                root[find(j)] = find(i)
            tree.add(v & mask)
    else:
        for v in tree_values:
            tree.add(v & mask)
        for i, v in enumerate(probes, len(tree_values)):
            for j in tree.within(v & mask, radius):
                root[find(j)] = find(i)
    return [(v, values[find(i)]) for i, v in enumerate(values) if find(i) != i]


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) between the distinct values of column fp whose components are those of all links."""
    keyed = fps.select("fp", F.explode(shard_keys(F.col("fp"), radius)).alias("shard"))
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    chunk = F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / TREE_SIZE)).alias("chunk")
    chunks = keyed.join(sizes, "shard").select("shard", "n", chunk, "fp").groupBy("shard", "chunk").agg(F.max("n").alias("n"), F.collect_list("fp").alias("fps"))
    whole = chunks.select(F.col("fps").alias("tree"), F.lit(None).cast("array<long>").alias("probes"))
    hot = chunks.where(F.col("n") > TREE_SIZE)
    across = hot.alias("t").join(hot.alias("p"), (F.col("t.shard") == F.col("p.shard")) & (F.col("t.chunk") < F.col("p.chunk"))).select(F.col("t.fps").alias("tree"), F.col("p.fps").alias("probes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = [e for tree, probes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for e in link_chunk(tree, probes, radius)]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    return whole.unionByName(across).mapInArrow(run, "a long, b long").distinct()


def simhash_components(docs: DataFrame, radius: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; component_id is the least id
    that links reach. Empty, blank and null texts have the fingerprint zero and are linked like any
    other. Texts are read whole. A row with a null id has a fingerprint and a null component, and links
    nothing. Repeated rows stay repeated. Columns other than the id and the text are ignored. An empty
    table gives an empty result.
    """
    marked = cut(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = cut(marked.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    stars = cut(connected_components(links(distinct, radius)), "fingerprint-components")
    placed = distinct.join(stars, distinct.fp == stars.node).select("fp", "least", "component")
    ids = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    reached = placed.join(ids, "component").select("fp", "component_id")
    known = distinct.join(reached, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    # At most HOT fingerprints have that share of the rows; their rows find their component without a shuffle.
    hot = F.broadcast(cut(known.where(F.col("n") * HOT > total), "hot-fingerprints").drop("n"))
    named = marked.where("id IS NOT NULL")
    cold = named.join(hot.select("fp"), "fp", "left_anti").join(known.where(F.col("n") * HOT <= total).drop("n"), "fp")
    nameless = marked.where("id IS NULL").withColumn("component_id", F.lit(None).cast("long"))
    found = cold.unionByName(named.join(hot, "fp")).unionByName(nameless)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the least doc_id.

    All columns are kept. Rows with a null doc_id belong to no component and stay.
    """
    found = simhash_components(docs, radius, width)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def keep_single(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """One row of each component of ``docs``: ``keep_one`` without the repeats of a kept doc_id.

    Of several rows that carry the least doc_id of their component the least one stays, by all columns in
    their order. All columns are kept. Rows with a null doc_id belong to no component and all stay; this is
    a choice, as nothing names them.
    """
    named = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("gone_id")).agg(F.count("*").alias("n"))
    repeated = cut(named.where("n > 1").select("gone_id"), "repeated-ids")
    if repeated.isEmpty():
        return keep_one(docs, radius, width)
    found = cut(simhash_components(docs, radius, width), "components")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).unionByName(repeated).distinct()
    once = docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    # An id may carry several texts, so its rows are judged by their own fingerprints.
    names, at = docs.columns, docs.columns.index("text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(x, width) for x in batch.column(at).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks.view(np.int64))], [*names, "own_fp"])

    schema = StructType([*docs.schema.fields, StructField("own_fp", LongType())])
    many = docs.join(repeated, docs["doc_id"] == repeated["gone_id"], "left_semi").mapInArrow(mark, schema)
    heads = found.where("doc_id = component_id").select(F.col("doc_id").alias("head_id"), F.col("fingerprint").alias("head_fp")).distinct()
    heirs = many.join(heads, (F.col("doc_id") == F.col("head_id")) & (F.lower(F.lpad(F.hex("own_fp"), 16, "0")) == F.col("head_fp")), "left_semi")
    first = heirs.groupBy(F.col("doc_id").alias("of_id")).agg(F.min(F.struct(*names)).alias("row")).select("row.*")
    return once.unionByName(first)
