"""Phrase collocations: counts of the longest windows, summed to all shorter prefixes by ROLLUP."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hirelake.llm.common import cut, freed_shuffles

#: Words of the longest phrase.
LONGEST = 4
PIECE_ENDS = r"[.,;:!?\n-\r]"
SPACES = r"[ \t]+"
#: Hashed words, pairs and triples are counted in so many buckets; two bitmaps of 32 MB are all that is broadcast.
BUCKETS = 1 << 28
#: Spark's bitmaps hold so many bits each.
BITS = 1 << 15
#: Texts are taken together up to so many bytes, so that memory follows the longest text and not the batch.
CHUNK_BYTES = 4 << 20
WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of some texts in order: their codes, the piece of each, and the vocabulary."""

    def __init__(self, texts: pa.Array) -> None:
        pieces = pc.split_pattern_regex(pc.ascii_lower(texts), PIECE_ENDS).flatten()
        split = pc.split_pattern_regex(pieces, SPACES)
        words, piece = split.flatten(), pc.list_parent_indices(split)
        there = pc.not_equal(words, "")
        coded = words.filter(there).dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.piece = piece.filter(there).to_numpy(zero_copy_only=False)
        self.vocabulary = coded.dictionary

    def hashes(self, lang: str) -> np.ndarray:
        """A hash of each word of the vocabulary and the language."""
        salt = pd.util.hash_array(np.array([lang], object), categorize=False)[0]
        return (pd.util.hash_array(np.asarray(self.vocabulary.to_pylist(), object), categorize=False) if len(self.vocabulary) else np.zeros(0, np.uint64)) ^ salt

    def pairs(self) -> np.ndarray:
        """Whether each word has a next one in its piece."""
        return np.append(self.piece[1:] == self.piece[:-1], False) if len(self.piece) else np.zeros(0, bool)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _word_bucket(h: np.ndarray) -> np.ndarray:
    return _bucket(h * _ODD)


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first * np.uint64(0xD1B54A32D192ED03) + second


def _pair_bucket(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _bucket(_mixed(first, second))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    """(lang, words) of texts of one language at a time, some ``CHUNK_BYTES`` together."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)) // CHUNK_BYTES
        for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(ends)) + 1) if batch.num_rows else ():
            some = batch.slice(int(part[0]), len(part))
            for lang in pc.unique(some.column(0)).to_pylist():
                texts = some.column(1).filter(pc.equal(some.column(0), lang))
                yield lang, Words(texts)


def _counted(buckets: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(counts.astype(np.int64))], ["bucket", "n"])


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each bucket is met by the words and the pairs of a chunk."""
    for lang, words in chunks(batches):
        hashes, at, size = words.hashes(lang), np.flatnonzero(words.pairs()), max(1, len(words.vocabulary))
        counts = np.bincount(words.codes, minlength=len(words.vocabulary))
        pair, times = np.unique(words.codes[at] * size + words.codes[at + 1], return_counts=True)
        first, second = np.divmod(pair, size)
        yield _counted(np.concatenate((_word_bucket(hashes), _pair_bucket(hashes[first], hashes[second]))), np.concatenate((counts, times)))


class Frequent:
    """Which words, pairs and triples may be frequent: bitmaps of buckets."""

    def __init__(self, pairs: np.ndarray, triples: np.ndarray | None = None) -> None:
        self.maps = (pairs, triples)

    def _has(self, level: int, buckets: np.ndarray) -> np.ndarray:
        return (self.maps[level][buckets >> 3] >> (buckets & 7)) & 1 > 0

    def words(self, hashes: np.ndarray) -> np.ndarray:
        return self._has(0, _word_bucket(hashes))

    def links(self, words: Words, hashes: np.ndarray) -> np.ndarray:
        """Whether each word and the next one are a pair that may be frequent."""
        linked = words.pairs()
        at = np.flatnonzero(linked)
        linked[at] = self._has(0, _pair_bucket(hashes[words.codes[at]], hashes[words.codes[at + 1]]))
        return linked

    def triples(self, words: Words, hashes: np.ndarray, linked: np.ndarray) -> np.ndarray:
        """Whether each word and the next two are a triple that may be frequent."""
        at = _twice(linked)
        found = np.zeros(len(linked), bool)
        found[at] = self._has(1, _triple_bucket(words.codes, hashes, at))
        return found


def _twice(linked: np.ndarray) -> np.ndarray:
    return np.flatnonzero(linked[:-1] & linked[1:])


def _triple_bucket(codes: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _pair_bucket(_mixed(hashes[codes[at]], hashes[codes[at + 1]]), hashes[codes[at + 2]])


def count_triples(batches: Iterator[pa.RecordBatch], frequent: Frequent) -> Iterator[pa.RecordBatch]:
    """How often each bucket is met by the triples of a chunk, both of whose pairs may be frequent."""
    for lang, words in chunks(batches):
        hashes = words.hashes(lang)
        buckets, times = np.unique(_triple_bucket(words.codes, hashes, _twice(frequent.links(words, hashes))), return_counts=True)
        yield _counted(buckets, times)


def windows_of(words: Words, lang: str, frequent: Frequent) -> pa.RecordBatch:
    """The counted windows of a chunk: each word with up to three next ones, as far as all pairs and triples may be frequent.

    A word that can't be frequent is no word of any counted phrase: it counts as a window without words.
    """
    codes, hashes, size = words.codes, words.hashes(lang), len(words.vocabulary)
    linked = frequent.links(words, hashes)
    longer = np.append(frequent.triples(words, hashes, linked), [False] * LONGEST)
    alone = np.bincount(codes[~linked], minlength=size)
    known = frequent.words(hashes)
    # Windows of two words and more: code + 1 of each, 0 for none.
    starts = np.flatnonzero(linked)
    columns, open_ = [codes[starts] + 1, codes[starts + 1] + 1], np.ones(len(starts), bool)
    for k in range(2, LONGEST):
        open_ = open_ & longer[starts + k - 2]
        columns.append(np.where(open_, np.append(codes, [0] * LONGEST)[starts + k] + 1, 0))
    number = columns[0]
    for column in columns[1:]:
        _, number = np.unique(number, return_inverse=True)
        number = number * (size + 1) + column
    _, one, times = np.unique(number, return_index=True, return_counts=True)
    single = np.flatnonzero(known & (alone > 0))
    rest = int(alone[~known].sum())
    made = [np.concatenate((c[one], single + 1 if k == 0 else np.zeros(len(single), np.int64), np.zeros(1, np.int64))) for k, c in enumerate(columns)]
    counts = np.concatenate((times, alone[single], [rest])).astype(np.int64)
    strings = [words.vocabulary.take(pa.array(np.maximum(m - 1, 0), mask=m == 0)) for m in made]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), *strings, pa.array(counts)], ["lang", *WORDS, "n"])


def bitmap(counted: DataFrame, least: int) -> np.ndarray:
    """The buckets that are met ``least`` times or more, as a bitmap of a fixed size; shuffle files are freed at once."""
    found = np.zeros(BUCKETS // 8, np.uint8)
    # The setting counts where a DataFrame is made.
    with freed_shuffles(counted.sparkSession):
        sums = counted.groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        maps = sums.groupBy(F.floor(F.col("bucket") / BITS).alias("part")).agg(F.bitmap_construct_agg(F.col("bucket") % BITS).alias("bits"))
        # At most BUCKETS / BITS rows of 4 KB.
        for row in maps.collect():
            found[row.part * (BITS // 8) : (row.part + 1) * (BITS // 8)] = np.frombuffer(bytes(row.bits), np.uint8)
    return found


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(20,0)")


def phrase_counts(docs: DataFrame, least: int = 30, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, words, f): how often each phrase of one to four words occurs, if ``least`` times or more, and n of each lang.

    The row with no words has the count of all words of its lang. Longest windows are counted once; ROLLUP
    sums them to their prefixes. Words, pairs and triples whose bucket isn't met often enough are certainly
    rare, and end a window: no phrase that counts holds one. Where so many words meet that all buckets
    fill, no window ends early: the counts are the same, and more of them are shuffled.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    context, counts = docs.sparkSession.sparkContext, "bucket long, n long"
    some = context.broadcast(Frequent(bitmap(texts.mapInArrow(count_pairs, counts), least)))
    triples = bitmap(texts.mapInArrow(lambda batches: count_triples(batches, some.value), counts), least)
    all_ = context.broadcast(Frequent(some.value.maps[0], triples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in chunks(batches):
            yield windows_of(words, lang, all_.value)

    schema = ", ".join(["lang string", *(f"{w} string" for w in WORDS), "n long"])
    windows = texts.mapInArrow(run, schema).groupBy("lang", *WORDS).agg(F.sum("n").alias("n"))
    # The count of a longest window is whole now: a rare one is only needed for its prefixes.
    windows = windows.withColumn(WORDS[-1], F.when(F.col("n") >= least, F.col(WORDS[-1])))
    sums = windows.rollup("lang", *WORDS).agg(F.sum("n").alias("f"), F.grouping_id().alias("gid"))
    words = F.array(*WORDS)
    level = sum((F.col("gid").bitwiseAND(1 << k) == 0).cast("int") for k in range(LONGEST))
    kept = sums.where(F.col("gid") < 1 << LONGEST).select("lang", level.alias("level"), F.slice(words, 1, F.greatest(level, F.lit(1))).alias("words"), "f")
    whole = (F.col("level") == 0) | (F.col("words")[F.col("level") - 1].isNotNull() & (F.col("f") >= least))
    return kept.where(whole).select("lang", F.when(F.col("level") == 0, F.array().cast("array<string>")).otherwise(F.col("words")).alias("words"), "f")


def mine_collocations(docs: DataFrame, least: int = 30, places: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``places`` phrases of each language.

    Texts are lower-cased (A-Z), split at ``[.,;:!?`` and line ends, and pieces into words at spaces and
    tabs. Phrases of two to four words that occur ``least`` times or more are scored by the cut with the
    lowest floor(2000000 a / (l + r)), ties to the shortest first part, and dropped if a longer phrase
    that holds their words has 80 % of their count or more. Order: score, count, then UTF-8 bytes.
    A null text is empty, a null lang ``und``, an empty lang its own. Repeated rows count again; other
    columns are ignored; a text without words has none, and an empty table gives an empty result.
    Counts are sums of longs, compared and divided as decimals. Nothing is cut off or sampled: a third of
    all rows may be of one language or hold one phrase, as counts are summed before each shuffle.
    """
    counts = cut(phrase_counts(docs, least, text_col, lang_col), "phrases")
    phrase = lambda c: F.array_join(c, " ")
    size = F.size("words")
    totals = counts.where(size == 0).select("lang", F.col("f").alias("n"))
    parts = counts.where(size.between(1, LONGEST - 1)).select("lang", phrase("words").alias("part"), "f")
    phrases = counts.where(size >= 2).select("lang", "words", F.col("f").alias("a"))

    ways = phrases.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    ways = ways.withColumns({"left": phrase(F.slice("words", F.lit(1), F.col("k"))), "right": phrase(F.slice("words", F.col("k") + 1, size - F.col("k")))})
    ways = ways.join(parts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    ways = ways.withColumn("score", F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    scored = ways.groupBy("lang", phrase("words").alias("phrase")).agg(F.min(F.struct("score", "k", "l", "r")).alias("least"), F.first("a").alias("a"))

    spans = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: phrase(F.slice("words", i, m))))))
    covers = phrases.where(size >= 3).select("lang", spans.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    left = scored.join(covers, ["lang", "phrase"], "left").where(F.col("cover").isNull() | (_exact("cover") * 100 < _exact("a") * 80))
    order = Window.partitionBy("lang").orderBy(F.desc(F.col("least.score")), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= places)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("least.l").alias("l"), F.col("least.r").alias("r"), "n", F.col("least.score").alias("score"))
