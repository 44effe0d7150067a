"""Benchmark decontamination: n-gram seeds join documents to test items, Smith-Waterman scores the copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_words, shingles, slices, take, words_of

#: Words of a seed, and of the shortest item that can be told from chance.
SEED, SHORTEST = 3, 5
#: Distinct seeds that a passage must share with an item before it is aligned.
HITS = 2
#: Alignment score, as a share of an item's perfect score, from which a passage is a copy.
THRESHOLD = 0.5
#: Items whose seeds are held at one time by a task.
ITEM_BLOCK = 20_000
MATCH, MISMATCH, GAP = 2, -1, -1


def plain_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text without case and punctuation: offsets, hashes; a word of marks alone is none."""
    offsets, codes, words = words_of(text)
    bare = pc.replace_substring_regex(pc.utf8_lower(words.cast(pa.string())), r"[^\pL\pN]+", "")
    used = np.asarray(pc.greater(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False), bool)
    keep = used[codes] if len(codes) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(keep)])
    return before[offsets].astype(np.int64), (hash_words(bare)[codes[keep]] if len(codes) else np.zeros(0, np.uint64))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman local alignment of two word sequences: score, first word and words of the passage's part."""
    n = len(passage)
    ramp = np.arange(n + 1) * -GAP
    row, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for w in item:
        diagonal = np.zeros(n + 1, np.int64)
        diagonal[1:] = row[:-1] + np.where(passage == w, MATCH, MISMATCH)
        from_diagonal, from_above = np.concatenate([[0], start[:-1]]), start
        above = row + GAP
        base = np.maximum(np.maximum(diagonal, above), 0)
        first = np.where(base == 0, np.arange(n + 1), np.where(diagonal >= above, from_diagonal, from_above))
        raised = base + ramp
        top = np.maximum.accumulate(raised)
        at = np.maximum.accumulate(np.where(raised == top, np.arange(n + 1), 0))
        row, start = top - ramp, first[at]
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), int(start[j]), j - int(start[j]))
    return best


class Items:
    """Items of a block and the seeds that find them."""

    def __init__(self, ids: list, texts: list) -> None:
        offsets, words = plain_words(pa.array(texts, pa.string()))
        long_enough = np.diff(offsets) >= SHORTEST
        self.ids = [i for i, ok in zip(ids, long_enough, strict=True) if ok]
        self.words = [words[offsets[k] : offsets[k + 1]] for k in np.nonzero(long_enough)[0]]
        flat = np.concatenate([*self.words, np.zeros(0, np.uint64)])
        ends = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(np.int64)
        grams_at, grams = shingles(ends, flat, SEED)
        item = np.repeat(np.arange(len(self.words)), np.diff(grams_at))
        place = np.arange(len(grams)) - grams_at[item]
        order = np.lexsort((place, item, grams))
        self.gram, self.item, self.place = grams[order], item[order], place[order]
        self.seeds = np.unique(self.gram)


def _within(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return sorted_[at] == values


def _hits(batch: pa.RecordBatch, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seeds in each text: offsets, seeds, places; and the words of the texts."""
    offsets, words = plain_words(batch.column("text"))
    at, grams = shingles(offsets, words, SEED)
    hit = _within(grams, seeds)
    before = np.concatenate([[0], np.cumsum(hit)])
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = np.arange(len(grams)) - at[doc]
    return before[at].astype(np.int64), grams[hit], place[hit], offsets, words


def _find(it: Iterator[pa.RecordBatch], sent, threshold: float) -> Iterator[pa.RecordBatch]:
    items: Items = sent.value
    size = np.array([len(w) for w in items.words], np.int64)
    for whole in it:
        for batch in slices(whole):
            at, grams, place, offsets, words = _hits(batch, items.seeds)
            if not len(grams):
                continue
            ids = batch.column("doc_id").to_pylist()
            lo, hi = np.searchsorted(items.gram, grams), np.searchsorted(items.gram, grams, "right")
            many = hi - lo
            src = np.repeat(np.arange(len(grams)), many)
            k = np.arange(len(src)) - np.repeat(np.cumsum(many) - many, many) + lo[src]
            doc = np.searchsorted(at, src, "right") - 1
            item, diagonal, gram = items.item[k], place[src] - items.place[k], grams[src]
            order = np.lexsort((diagonal, item, doc))
            doc, item, diagonal, gram = doc[order], item[order], diagonal[order], gram[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > size[item[1:]])
            starts = np.nonzero(new)[0]
            ends = np.append(starts[1:], len(doc))
            if len(starts):  # groups of two distinct seeds or more
                several = np.minimum.reduceat(gram, starts) != np.maximum.reduceat(gram, starts)
                starts, ends = starts[several], ends[several]
            best: dict[tuple[int, int], tuple] = {}
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                if HITS > 2 and len(np.unique(gram[a:b])) < HITS:
                    continue
                d, i, n = int(doc[a]), int(item[a]), int(size[item[a]])
                first = max(0, int(diagonal[a]) - n // 2)
                last = int(diagonal[b - 1]) + n + n // 2
                passage = words[offsets[d] + first : min(offsets[d] + last, offsets[d + 1])]
                if MATCH * int(np.isin(items.words[i], passage).sum()) / (MATCH * n) < threshold:  # each match is a word of the item that the passage has
                    continue
                score, begin, length = align(items.words[i], passage)
                share = score / (MATCH * n)
                if share >= threshold and share > best.get((d, i), (0.0,))[0]:
                    best[d, i] = (share, first + begin, length)
            rows = [(ids[d], items.ids[i], *x) for (d, i), x in best.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "score", "first_word", "n_words"), r, strict=True)) for r in rows], schema=_FOUND)


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block: int = ITEM_BLOCK) -> DataFrame:
    """Documents (doc_id, text) that hold a copy of an item (item_id, text): one row for each document and item found.

    Returns doc_id, item_id, score (share of a perfect alignment, 0 to 1), first_word, n_words (the aligned part, in
    words that are not marks alone). Items go to the executors in blocks of at most ``block``, each searched in a pass
    of its own, so what a task holds doesn't grow with the benchmark; the documents are never shuffled. An item is sought
    by all of its 3-word seeds, however many documents hold them. Where two seeds lie within an item's length of one
    diagonal, and the words around them have enough of the item's words for the threshold, they are aligned with the
    item, without case and marks.

    A null or empty text holds nothing; items that are null or under five words can't be told from chance and find
    nothing. Equal items each give rows; repeated documents too. A document with several copies of an item gives the
    best one. Empty tables give no rows.
    """
    out = None
    n = benchmark.count()
    parts = max(1, -(-n // block) * 2 if n > block else 1)
    dealt = benchmark.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    for p in range(parts):
        rows = dealt.where(F.col("part") == p).select("item_id", "text").collect()  # a block's items at most
        items = Items([r.item_id for r in rows], [r.text for r in rows])
        sent = spark.sparkContext.broadcast(items)
        found = docs.select("doc_id", "text").mapInArrow(lambda it, s=sent: _find(it, s, threshold), "doc_id long, item_id long, score double, first_word long, n_words long")
        out = found if out is None else out.union(found)
    return out


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark."""
    docs = take(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text")
    return contaminated(spark, docs, take(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), item_id="item_id", text="text"))
