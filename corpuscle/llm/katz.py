"""Language-model scores of whole texts: a Katz back-off bigram model with Good-Turing discounts."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hash_words, mix, slices, take, words_of
from .langid import held_out

#: Counts up to this are discounted by Good-Turing.
DISCOUNTED = 5
#: Bytes of text in a block, and bytes of block data for each owner of n-grams, about.
BLOCK_BYTES, OWNER_BYTES = 8 << 20, 6 << 20
#: The end of a text, which also stands before its first word.
END = np.uint64(0x656E64)

MESSAGE = "owner long, block long, kind int, data binary"
_MESSAGE = pa.schema([("owner", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
TEXTS, WORDS, PAIRS, BACKOFF = range(4)
STATS = -1


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: of each number, all first bytes, then all second ones, and so on, compressed."""
    planes = [(a.dtype.str, np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()) for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(planes, 5))


def _unpack(data: bytes) -> list[np.ndarray]:
    out = []
    for kind, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel())
    return out


def _messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_MESSAGE.types)], schema=_MESSAGE)


class Block:
    """Some whole texts: which tokens each has, and the distinct words and pairs of words among them."""

    def __init__(self, data: bytes) -> None:
        self.ids, self.no_id, held, sizes, self.hashes, self.tokens = _unpack(data)
        self.held = held.astype(bool)
        self.offsets = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
        self.doc = np.repeat(np.arange(len(sizes)), np.diff(self.offsets))
        self.training = ~self.held[self.doc]
        words = len(self.hashes)
        end = self.tokens[-1] if len(self.tokens) else 0
        before = np.concatenate([[end], self.tokens[:-1]]).astype(np.int64)
        before[self.offsets[:-1]] = end  # every text has an end, the last token of each
        self.pairs, self.pair = np.unique(before * words + self.tokens, return_inverse=True)
        self.first, self.second = self.pairs // max(1, words), self.pairs % max(1, words)
        self.pair_hashes = mix(mix(self.hashes[self.first]) * np.uint64(0x9E3779B97F4A7C15) + self.hashes[self.second])
        self.word_counts = np.bincount(self.tokens[self.training], minlength=words)
        self.pair_counts = np.bincount(self.pair[self.training], minlength=len(self.pairs))

    @staticmethod
    def data(batch: pa.RecordBatch) -> bytes:
        offsets, codes, words = words_of(batch.column("text"))
        n = np.diff(offsets)
        at = np.arange(len(codes)) + np.repeat(np.arange(len(n)), n)
        tokens = np.full(len(codes) + len(n), len(words), np.int64)
        tokens[at] = codes
        hashes = np.append(hash_words(words), END)
        order = np.argsort(-np.bincount(tokens, minlength=len(hashes)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ids = batch.column("doc_id")
        known = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False))
        held = np.asarray(batch.column("held_out").to_numpy(zero_copy_only=False), bool)
        return _pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), (~known).astype(np.uint8), held.astype(np.uint8), (n + 1).astype(np.uint32), hashes[order], rank[tokens].astype(np.uint32))


def _by_owner(hashes: np.ndarray, owners: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order of the hashes by owner, then value, and the part of it that each owner has."""
    owner = (hashes % np.uint64(owners)).astype(np.int64)
    order = np.lexsort((hashes, owner))
    sorted_ = owner[order]
    at = np.searchsorted(sorted_, np.arange(owners + 1))
    return order, [(k, slice(int(at[k]), int(at[k + 1]))) for k in range(owners) if at[k + 1] > at[k]]


def _deltas(sorted_: np.ndarray) -> np.ndarray:
    return np.diff(sorted_, prepend=np.uint64(0))


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for whole in it:
        for batch in slices(whole, limit=BLOCK_BYTES):
            yield _messages([(0, (part << 32) | n, TEXTS, Block.data(batch))]).to_batches()[0]
            n += 1


def _requests(it: Iterator[pa.RecordBatch], owners: int, kind: int) -> Iterator[pa.RecordBatch]:
    """What each block asks the owners of its words or pairs, with its own training counts of them."""
    for batch in it:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
            b = Block(data)
            hashes, counts = (b.hashes, b.word_counts) if kind == WORDS else (b.pair_hashes, b.pair_counts)
            order, parts = _by_owner(hashes, owners)
            yield from _messages([(k, block, kind, _pack(_deltas(hashes[order[p]]), counts[order[p]].astype(np.uint32))) for k, p in parts]).to_batches()


def _own_counts(table: pa.Table) -> pa.Table:
    """An owner's answer to each block: twice the count in all training texts, plus one in the first block that asks.

    Also statistics: training tokens, distinct ones, and how many occur once, twice, and so on.
    """
    table = table.sort_by("block")
    blocks, asked = table.column("block").to_pylist(), [_unpack(x) for x in table.column("data").to_pylist()]
    owner, kind = table.column("owner")[0].as_py(), table.column("kind")[0].as_py()
    sizes = [len(x[0]) for x in asked]
    hashes = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in asked])
    distinct, first, code = np.unique(hashes, return_index=True, return_inverse=True)
    total = np.bincount(code, np.concatenate([x[1] for x in asked]), len(distinct)).astype(np.uint64)
    answer = total[code] * np.uint64(2)
    answer[first] += np.uint64(1)
    at = np.concatenate([[0], np.cumsum(sizes)])
    rows = [(owner, b, kind, _pack(answer[at[i] : at[i + 1]])) for i, b in enumerate(blocks)]
    some = np.bincount(np.minimum(total, DISCOUNTED + 2).astype(np.int64), minlength=DISCOUNTED + 3)
    return _messages([*rows, (owner, STATS, kind, _pack(np.array([total.sum(), (total > 0).sum(), *some[1 : DISCOUNTED + 2]], np.int64)))])


def discounts(times: list[int]) -> list[float]:
    """Good-Turing discounts of counts 1 to DISCOUNTED (the first is for 0, unused), from how many n-grams occur 1, 2, ... times.

    Where the counts are too few or too odd for a discount between 0 and 1, half an occurrence is taken off.
    """
    k = DISCOUNTED
    out = [1.0]
    tail = (k + 1) * times[k] / times[0] if times[0] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * times[r] / times[r - 1] / r - tail) / (1 - tail) if times[r - 1] and tail < 1 else -1.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


class Model:
    """What all blocks share: totals and discounts."""

    def __init__(self, words: list[int], pairs: list[int]) -> None:
        self.tokens, self.types = words[0], words[1]
        self.word_d, self.pair_d = np.array(discounts(words[2:])), np.array(discounts(pairs[2:]))
        lost = sum(n * r * (1 - self.word_d[r]) for r, n in enumerate(words[2 : 2 + DISCOUNTED], 1))
        self.over = self.tokens + (0 if lost else 1)  # with nothing discounted, one more token makes room
        self.unknown = max(lost, 1.0) / max(1, self.over) if not lost else lost / self.over

    def word(self, count: np.ndarray) -> np.ndarray:
        """Chance of a word by its training count; what the discounts free goes to one unknown word."""
        c = count.astype(np.float64)
        return np.where(count > 0, self._kept(count, self.word_d) * c / max(1, self.over), self.unknown)

    def _kept(self, count: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.where(count <= DISCOUNTED, d[np.minimum(count, DISCOUNTED)], 1.0)

    def pair(self, count: np.ndarray) -> np.ndarray:
        """Discounted count of a pair."""
        return self._kept(count, self.pair_d) * count


def _answers(table: pa.Table) -> tuple[Block, dict[int, dict[int, bytes]]]:
    texts, answers = None, {WORDS: {}, PAIRS: {}, BACKOFF: {}}
    for owner, kind, data in zip(*(table.column(c).to_pylist() for c in ("owner", "kind", "data")), strict=True):
        if kind == TEXTS:
            texts = Block(data)
        else:
            answers[kind][owner] = data
    return texts, answers


def _aligned(hashes: np.ndarray, owners: int, answers: dict[int, bytes], of: int = 0) -> np.ndarray:
    order, parts = _by_owner(hashes, owners)
    out = None
    for k, p in parts:
        got = _unpack(answers[k])[of]
        out = np.zeros(len(hashes), got.dtype) if out is None else out
        out[order[p]] = got
    return out


def _contexts(table: pa.Table, owners: int, model: Model) -> pa.Table:
    """A block's part in the back-off weights: for each of its words as a context, over pairs that it asked for first,
    the chances of the second words and the counts that the discounts take off."""
    if table.column("block")[0].as_py() == STATS:
        return _messages([])
    b, answers = _answers(table)
    words = _aligned(b.hashes, owners, answers[WORDS]) >> np.uint64(1)
    got = _aligned(b.pair_hashes, owners, answers[PAIRS])
    count = (got >> np.uint64(1)).astype(np.int64)
    mine = ((got & np.uint64(1)) == 1) & (count > 0)
    first, n = b.first[mine], len(b.hashes)
    seen = np.bincount(first, model.word(words[b.second[mine]].astype(np.int64)), n)
    freed = np.bincount(first, count[mine] - model.pair(count[mine]), n)
    order, parts = _by_owner(b.hashes, owners)
    block = table.column("block")[0].as_py()
    return _messages([(k, block, BACKOFF, _pack(_deltas(b.hashes[order[p]]), words[order[p]], seen[order[p]], freed[order[p]])) for k, p in parts])


def _own_backoff(table: pa.Table) -> pa.Table:
    """An owner's answer: for each context, the weight of unseen words, and what its pairs' counts are divided by."""
    blocks, asked = table.column("block").to_pylist(), [_unpack(x) for x in table.column("data").to_pylist()]
    owner = table.column("owner")[0].as_py()
    hashes = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in asked])
    count, seen, freed = (np.concatenate([x[i] for x in asked]).astype(np.float64) for i in (1, 2, 3))
    _, first, code = np.unique(hashes, return_index=True, return_inverse=True)
    seen, freed, count = np.bincount(code, seen, len(first)), np.bincount(code, freed, len(first)), count[first]
    tight = (freed <= 1e-9) & (count > 0)  # all its pairs are frequent: one more occurrence makes room for others
    freed, over = np.where(tight, 1.0, freed), count + tight
    weight = np.where(count > 0, freed / np.maximum(over, 1) / np.maximum(1 - seen, 1e-300), 1.0)
    at = np.concatenate([[0], np.cumsum([len(x[0]) for x in asked])])
    return _messages([(owner, b, BACKOFF, _pack(weight[code[at[i] : at[i + 1]]], over[code[at[i] : at[i + 1]]])) for i, b in enumerate(blocks)])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(table: pa.Table, owners: int, model: Model) -> pa.Table:
    if table.column("block")[0].as_py() == STATS:
        return _SCORES.empty_table()
    b, answers = _answers(table)
    words = (_aligned(b.hashes, owners, answers[WORDS]) >> np.uint64(1)).astype(np.int64)
    count = (_aligned(b.pair_hashes, owners, answers[PAIRS]) >> np.uint64(1)).astype(np.int64)
    weight, over = (_aligned(b.hashes, owners, answers[BACKOFF], i) for i in (0, 1))
    # the recursion, for each distinct pair: the discounted pair if it was seen, else the context's weight times the word
    seen = model.pair(count) / np.maximum(over[b.first], 1)
    chance = np.where(count > 0, seen, weight[b.first] * model.word(words[b.second]))
    n = len(b.ids)
    score = np.bincount(b.doc, np.log10(chance)[b.pair], n)
    base = np.bincount(b.doc, np.log10((words[b.tokens] + 1) / (model.tokens + model.types + 1)), n)
    known = np.bincount(b.doc, words[b.tokens] > 0, n).astype(np.int64)
    return pa.Table.from_arrays([pa.array(b.ids, mask=b.no_id.astype(bool)), pa.array(b.held), pa.array(np.diff(b.offsets)), pa.array(known), pa.array(np.full(n, model.tokens)), pa.array(base), pa.array(score)], schema=_SCORES)


def lm_scores(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Scores of documents (doc_id, held_out, text) by a model of those that are not held out.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then an end, which is also the context of the first
    word. P(w | h) is the Good-Turing discounted count of (h, w) over the count of h if the pair occurs in training,
    else weight(h) P(w); weight(h) shares exactly what the discounts leave among the words not seen after h. P(w) is the
    discounted count of w over all; what is left there is the chance of one unknown word. An unknown h has weight 1.

    The counts cover all training texts and are never on one machine: each word and pair has an owner by its hash, so a
    very frequent word is no more work for its owner than a rare one. Texts are cut into blocks of whole documents,
    written once as word numbers. A block asks each owner once for all of its distinct words or pairs; the answers come
    back aligned with the questions, are kept as tables and are joined to the blocks. Only totals and counts of counts,
    a few numbers for each owner, go to the driver.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (log10, add-one unigrams) and score (log10).
    A null text is empty: its end alone. Repeated rows are counted and scored each. Without training texts every word is
    unknown. An empty table gives no rows.
    """
    scratch = Scratch(spark)
    texts = scratch.write(docs.select("doc_id", "held_out", "text").mapInArrow(_blocks, MESSAGE), "blocks")
    size = texts.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    owners = max(16, math.ceil(size / OWNER_BYTES))

    def counted(kind: int, name: str) -> tuple[DataFrame, list[int]]:
        table = scratch.write(texts.mapInArrow(lambda it: _requests(it, owners, kind), MESSAGE).groupBy("owner").applyInArrow(_own_counts, MESSAGE), name)
        stats = [_unpack(r.data)[0] for r in table.where(F.col("block") == STATS).collect()]
        return table.where(F.col("block") != STATS), (np.sum(stats, 0) if stats else np.zeros(DISCOUNTED + 3, int)).tolist()

    words, word_stats = counted(WORDS, "words")
    pairs, pair_stats = counted(PAIRS, "pairs")
    model = Model(word_stats, pair_stats)
    of_block: Callable[[DataFrame, Callable, str], DataFrame] = lambda rows, f, schema: rows.groupBy("block").applyInArrow(lambda t: f(t, owners, model), schema)
    backoff = scratch.write(of_block(texts.union(words).union(pairs), _contexts, MESSAGE).groupBy("owner").applyInArrow(_own_backoff, MESSAGE), "backoff")
    return of_block(texts.union(words).union(pairs).union(backoff), _score, SCORES)


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; those with crc32(doc_id) mod 7 = 2 are held out."""
    docs = take(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text")
    return lm_scores(spark, docs.withColumn("held_out", held_out(7, 2)))
