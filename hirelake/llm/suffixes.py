"""Exact repeated-substring removal by blockwise sorting of suffixes with a difference cover.

A difference cover D of period v has, for any two positions, an offset below v that moves both into the
sample of positions p with p mod v in D. So two equal strings of L bytes hold equal cover strings of
L - v + 1 bytes at one common offset. The cover strings of the sample are ranked first, bucket by bucket:
all that matters for ties is which of them occur again. A suffix with no recurring cover string within v
bytes can't tie with another for L bytes and is never sorted. The rest are dealt into buckets by the
fingerprint of their first L bytes, and each bucket is sorted on its own. A task holds one bucket, whose
size is bounded by the number of buckets; each batch of texts sends a string that it repeats only once.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import Cut, cut, freed_shuffles, remove, shared_root

LENGTH, PERIOD = 400, 273
#: A perfect difference set of period 273, in which each difference occurs once.
COVER_273 = (0, 1, 3, 7, 15, 31, 63, 90, 116, 127, 136, 181, 194, 204, 233, 238, 255)
#: Bytes of text for each bucket, in one batch of a task, and hashed at once.
BUCKET_BYTES, BATCH_BYTES, HASHED_AT_ONCE = 16 << 20, 32 << 20, 1 << 20
#: Parts that the rows of one text are dealt into where they meet its result.
SALTS = 8
#: Texts in one batch of places.
TEXTS_AT_ONCE = 256
_RNG = np.random.default_rng(20)
_BYTE_VALUES, _OTHER_VALUES = (_RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOB = "bucket int, keys binary, fps binary, extras binary, more binary, rows binary, at binary, known_rows binary, known_at binary"
_FOUND = "part int, keys binary, counts binary, places binary"
_FIELDS, _FOUND_FIELDS = ([f.split()[0] for f in kinds.split(", ")] for kinds in (_BLOB, _FOUND))


def difference_cover(period: int) -> np.ndarray:
    """Residues whose differences are all residues: fixed ones, or steps of one and of the root."""
    if period == 273:
        return np.array(COVER_273)
    root = int(np.ceil(np.sqrt(period)))
    return np.unique([*range(root), *(min(k, period - 1) for k in range(root - 1, period + root, root))])


class Windows:
    """64-bit fingerprints of the strings of one length at every position of a text.

    Other values for the bytes give other fingerprints of the same strings, independent of the first.
    """

    def __init__(self, length: int, values: np.ndarray = _BYTE_VALUES) -> None:
        self.length, self.size, self.values = length, HASHED_AT_ONCE + length, values
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.size, _BASE)]), dtype=np.uint64)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        m, found = self.length, []
        for lo in range(0, len(data) - m + 1, HASHED_AT_ONCE):
            part = data[lo : lo + HASHED_AT_ONCE + m - 1]
            n = len(part)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.values[part] * self.powers[:n], out=sums[1:])
            h = (sums[m:] - sums[: n - m + 1]) * self.powers[self.size : self.size - (n - m + 1) : -1]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            found.append(h ^ (h >> np.uint64(32)))
        return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _planes(values: np.ndarray) -> bytes:
    """Differences of the values, stored byte by byte, as runs of zeros that compression removes."""
    steps = np.diff(values.astype(np.uint32), prepend=np.uint32(0))
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel(), dtype=np.uint32)


def dealt(keys: np.ndarray, rows: np.ndarray, at: np.ndarray, fps: np.ndarray, extras: np.ndarray, buckets: int, short: bool) -> pa.RecordBatch:
    """A row for each bucket with the batch's strings of that bucket, each string once.

    The row tells of each string its fingerprint, whether the batch has it more than once, and where the
    first is. Places of strings that the batch itself repeats are known to recur; they travel by their
    text's number instead of by their string, so that a very common string doesn't fill one bucket.
    """
    order = np.argsort(fps, kind="stable")
    fps, extras, rows, at = fps[order], extras[order], rows[order], at[order]
    new = np.ones(len(fps), bool)
    # Strings that this splits, because others share their 64 bits, meet again in their bucket.
    new[1:] = (fps[1:] != fps[:-1]) | (extras[1:] != extras[:-1])
    first = np.nonzero(new)[0]
    again = np.diff(np.append(first, len(fps))) > 1
    known = np.repeat(again, np.diff(np.append(first, len(fps))))
    bucket = ((fps[first] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    # Within a bucket by place: neighbours' differences are small.
    place = np.lexsort((at[first], rows[first], bucket))
    first, again, bucket = first[place], again[place], bucket[place]
    bounds = np.searchsorted(bucket, np.arange(buckets + 1))
    krows, kat = rows[known], at[known]
    korder = np.lexsort((kat, krows, krows % buckets))
    krows, kat = krows[korder], kat[korder]
    kbounds = np.searchsorted(krows % buckets, np.arange(buckets + 1))
    out: list[list] = [[] for _ in _FIELDS]
    for b in range(buckets):
        mine, k = first[bounds[b] : bounds[b + 1]], slice(kbounds[b], kbounds[b + 1])
        if len(mine) or k.stop > k.start:
            used, where = np.unique(np.concatenate([rows[mine], krows[k]]), return_inverse=True)
            prints = fps[mine]
            # Within a bucket, 32 more bits find recurring cover strings; one found by chance costs a little work.
            values = (b, keys[used], prints.astype(np.uint32) if short else prints, b"" if short else extras[mine], again[bounds[b] : bounds[b + 1]], _planes(where[: len(mine)]), _planes(at[mine]), _planes(where[len(mine) :]), _planes(kat[k]))
            for column, value in zip(out, values, strict=True):
                column.append(value.tobytes() if isinstance(value, np.ndarray) else value)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], _FIELDS)


def gathered(batches: Iterator[pa.RecordBatch], buckets: int, short: bool) -> Iterator[pa.RecordBatch]:
    """Sorts one bucket and gives the places of its recurring strings: a row for each part of the texts."""
    by_bucket: dict[int, list[dict]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            by_bucket.setdefault(row["bucket"], []).append(row)
    for blobs in by_bucket.values():
        get = lambda f, kind: np.concatenate([np.frombuffer(b[f], kind) for b in blobs])  # noqa: B023, E731
        starts = np.cumsum([0, *(len(b["keys"]) // 8 for b in blobs)])
        places = lambda f: np.concatenate([_unplaned(b[f]) for b in blobs])  # noqa: B023, E731
        moved = lambda f: np.concatenate([_unplaned(b[f]) + s for b, s in zip(blobs, starts, strict=False)])  # noqa: B023, E731
        keys, fps, more, at = get("keys", np.int64), get("fps", np.uint32 if short else np.uint64), get("more", bool), places("at")
        rows = moved("rows")
        order = np.argsort(fps, kind="stable")
        same = fps[order][1:] == fps[order][:-1]
        if not short:
            extras = get("extras", np.uint32)
            alike = extras[order][1:] == extras[order][:-1]
            if (same & ~alike).any():
                order = np.lexsort((extras, fps))
                same, alike = fps[order][1:] == fps[order][:-1], extras[order][1:] == extras[order][:-1]
            same &= alike
        recurs = np.zeros(len(fps), bool)
        recurs[1:] |= same
        recurs[:-1] |= same
        hit = order[recurs]
        hit = hit[~more[hit]]
        key = np.concatenate([keys[rows[hit]], keys[moved("known_rows")]])
        place = np.concatenate([at[hit], places("known_at")])
        if not len(key):
            continue
        part = key % buckets
        order = np.lexsort((place, key, part))
        part, key, place = part[order], key[order], place[order]
        first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
        counts = np.diff(np.append(first, len(key))).astype(np.uint32)
        parts, begins = np.unique(part[first], return_index=True)
        ends = np.append(begins[1:], len(first))
        stops = np.append(first, len(key))
        columns = [parts.astype(np.int32)]
        columns.append([key[first[b:e]].tobytes() for b, e in zip(begins, ends, strict=True)])
        columns.append([counts[b:e].tobytes() for b, e in zip(begins, ends, strict=True)])
        columns.append([_planes(place[stops[b] : stops[e]]) for b, e in zip(begins, ends, strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], _FOUND_FIELDS)


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text with all its places, from the blobs that the buckets sent for a part of the texts."""
    by_part: dict[int, list[dict]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            by_part.setdefault(row["part"], []).append(row)
    for blobs in by_part.values():
        keys = np.concatenate([np.frombuffer(b["keys"], np.int64) for b in blobs])
        counts = np.concatenate([np.frombuffer(b["counts"], np.uint32) for b in blobs])
        place = np.concatenate([_unplaned(b["places"]) for b in blobs])
        used, where = np.unique(keys, return_inverse=True)
        owner = np.repeat(where.astype(np.int32), counts)
        order = np.lexsort((place, owner))
        place, stops = place[order], np.cumsum(np.bincount(owner, minlength=len(used)))
        for lo in range(0, len(used), TEXTS_AT_ONCE):
            some = range(lo, min(lo + TEXTS_AT_ONCE, len(used)))
            yield pa.RecordBatch.from_arrays([pa.array(used[some.start : some.stop]), pa.array([_planes(place[stops[k - 1] if k else 0 : stops[k]]) for k in some], pa.binary())], ["key", "places"])


def _recurring(texts: DataFrame, strings: Callable[[dict], tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int, short: bool) -> DataFrame:
    """(key, places) of the strings of ``texts`` (key, text, ...) that occur more than once.

    ``strings`` gives the places and fingerprints of a text's strings, the latter in 64 and in 32 bits.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, at, fps, extras, size = [], [], [], [], [], 0
        packed = lambda: dealt(np.array(keys, np.int64), np.concatenate(rows), np.concatenate(at), np.concatenate(fps), np.concatenate(extras), buckets, short)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                places, prints, more = strings(row)
                rows.append(np.full(len(places), len(keys), np.int64))
                keys.append(row["key"])
                at.append(places.astype(np.uint32))
                fps.append(prints)
                extras.append(more)
                size += len(row["text"]) + 12 * len(places)
                if size >= BATCH_BYTES or len(keys) >= 65_535:
                    yield packed()
                    keys, rows, at, fps, extras, size = [], [], [], [], [], 0
        if keys:
            yield packed()

    return texts.mapInArrow(deal, _BLOB).repartitionById(buckets, F.col("bucket")).mapInArrow(lambda batches: gathered(batches, buckets, short), _FOUND).repartitionById(buckets, F.col("part")).mapInArrow(merged, "key long, places binary")


def _text_key(texts: DataFrame) -> Column:
    """A number for each digest (column sha) of ``texts``: of its hash, and another hash for those that clash.

    Of 1e11 texts some hundred pairs clash; their digests are collected.
    """
    key, clashing = F.xxhash64("sha"), ["sha"]
    for salt in range(1, 9):
        clashing = [r.last for r in texts.select("sha", key.alias("key")).groupBy("key").agg(F.min("sha").alias("least"), F.max("sha").alias("last")).where("least <> last").collect()]
        if not clashing:
            break
        key = F.when(F.col("sha").isin(*clashing), F.xxhash64(F.concat("sha", F.lit(f"+{salt}")))).otherwise(key)
    return key


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def remove_repeats(docs: DataFrame, length: int = LENGTH, period: int = PERIOD, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row of ``docs``.

    A byte is removed when a string of ``length`` bytes that covers it starts anywhere else too, in the
    same document or another; strings never cross documents and are judged on the input. A null text is
    empty and keeps nothing. Equal documents of at least ``length`` bytes are removed wholly, all of
    them. Null ids and repeated rows stay, and repeated rows repeat each other; other columns are
    ignored. Strings are told apart by 96 bits of two independent fingerprints. ``kept`` holds the
    remaining bytes. An empty table gives an empty result. All work is done in the call; what it wrote
    besides the result is deleted.
    """
    if not 1 <= period <= length:
        raise ValueError("the period must be from 1 to the length")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    base = Cut(rows.drop("text"), "suffix-documents")
    total = base.read().agg(F.sum("n_bytes")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-total // BUCKET_BYTES))
    key = _text_key(base.read().where(F.col("n_bytes") >= length))
    name = f"suffix_texts_{uuid.uuid4().hex}"
    path = f"{shared_root(spark)}/{name}"
    # Texts that are equal are kept once; bucketed by their key, the later joins move no text. Texts of
    # less than ``length`` bytes lose nothing and go no further.
    distinct = rows.where(F.col("n_bytes") >= length).withColumn("key", key).groupBy("key").agg(F.first("sha").alias("sha"), F.first("text").alias("text"), F.count("*").alias("copies"))
    with freed_shuffles(spark):
        distinct.write.bucketBy(parts, "key").option("compression", "zstd").option("path", path).saveAsTable(name)
    stored = spark.table(name)

    width, cover = length - period + 1, difference_cover(period)
    short_windows, windows, other_windows = Windows(width), Windows(length), Windows(length, _OTHER_VALUES)

    def cover_strings(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = _bytes(row["text"])
        places = (np.arange(0, len(data), period)[:, None] + cover).ravel()
        places = places[places <= len(data) - width]
        return places, short_windows(data)[places], np.zeros(len(places), np.uint32)

    def tied_suffixes(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = _bytes(row["text"])
        edge = np.zeros(len(data) + 1, np.int32)
        at = _unplaned(row["places"]).astype(np.int64)
        np.add.at(edge, np.maximum(at - period + 1, 0), 1)
        np.add.at(edge, at + 1, -1)
        places = np.nonzero(np.cumsum(edge)[: len(data) - length + 1])[0]
        if not len(places):
            return places, np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        return places, windows(data)[places], (other_windows(data)[places] >> np.uint64(32)).astype(np.uint32)

    ranks = Cut(_recurring(stored.select("key", "text"), cover_strings, buckets, True), "cover-ranks")
    tied = stored.select("key", "text").join(ranks.read(), "key")
    repeats = Cut(_recurring(tied, tied_suffixes, buckets, False), "repeated-suffixes")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                data = _bytes(row["text"])
                edge = np.zeros(len(data) + 1, np.int32)
                at = _unplaned(row["places"]).astype(np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = data[~gone].tobytes()
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                out.append((row["key"], int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)], ["key", "n_removed", "n_spans", "kept_sha256", "kept"])

    single = stored.where("copies = 1").select("key", "text").join(repeats.read(), "key")
    stripped = single.mapInArrow(strip, "key long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    copied = stored.where("copies > 1").select("key", F.octet_length("text").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), F.when(F.lit(with_text), F.lit(b"")).alias("kept"))
    # The rows of a hot text are dealt into parts before the join; stripped texts are too large to repeat.
    salts = 1 if with_text else SALTS
    known = stripped.unionByName(copied).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    long, short = base.read().where(F.col("n_bytes") >= length), base.read().where(F.col("n_bytes") < length)
    long = long.withColumns({"key": key, "salt": F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")}).join(known, ["key", "salt"], "left")
    found = long.unionByName(short, allowMissingColumns=True)
    zero = F.lit(0).cast("long")
    result = found.select("id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept")
    if with_text:
        whole = docs.select(F.col(id_col).cast("long").alias("other"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("whole")).distinct()
        result = result.join(whole, result["id"].eqNullSafe(whole["other"]) & (F.sha2("whole", 256) == result["kept_sha256"]) & (F.col("n_removed") == 0), "left").select(*result.drop("kept").columns, F.coalesce("kept", "whole").alias("kept"))
    else:
        result = result.drop("kept")
    done = cut(result.withColumnRenamed("id", id_col), "stripped-documents")
    spark.sql(f"DROP TABLE {name}")
    for written in (base, ranks, repeats):
        written.drop()
    remove(spark, path)
    return done
