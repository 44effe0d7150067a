"""Language identification: piece probabilities of each language, summed over all segmentations of a word."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, slices, take, words_of

#: Bytes of labelled text of a language that the model is fitted on, about; documents are chosen by a hash of their text.
SAMPLE = 1_200_000
#: Rounds of expectation and maximisation.
ROUNDS = 3
#: Characters from which a word is summed by itself.
WORD = 40
#: Words that are summed at one time.
PART = 16_384
#: Bytes of text whose words are scored at one time; a longer text is taken alone.
HELD = 2 << 20
#: Weight that every piece has in every language before it is seen, and the chance of a character that no piece has.
PRIOR, UNKNOWN = 0.05, 1e-7
#: Each character's chance is scaled by this, so that the products of a word stay far from underflow.
SCALE = 10.0

_PRIME = np.uint64(0x100000001B3)


def public_pieces(path: str) -> list[str]:
    """Pieces of the public sentencepiece vocabulary that are text, a word's start as a space.

    Texts are scored in lower case, and so are all pieces; those that differ by case alone are one.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).replace("▁", " ").lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in found if p)


class Pieces:
    """A hash table from pieces to their numbers, for whole arrays of windows at once."""

    def __init__(self, pieces: list[str]) -> None:
        self.pieces = pieces
        self.n = len(pieces)
        self.longest = max(map(len, pieces), default=0)
        h = np.array([self._one(p) for p in pieces], np.uint64)
        self.mask = np.uint64((1 << max(16, (self.n * 8).bit_length())) - 1)
        self.keys, self.ids = np.zeros(int(self.mask) + 1, np.uint64), np.full(int(self.mask) + 1, -1, np.int32)
        slot = self._slot(h)
        todo = np.arange(self.n)
        while len(todo):  # each round, one piece takes each free slot; the rest try the next
            free = self.ids[slot[todo]] < 0
            self.keys[slot[todo[free]]], self.ids[slot[todo[free]]] = h[todo[free]], todo[free]
            lost = self.ids[slot[todo]] != todo
            todo = todo[lost]
            slot[todo] = (slot[todo] + 1) & int(self.mask)
        self.most = 1 + int(((self._place_of(h) - self._slot(h)) & int(self.mask)).max(initial=0))

    def _place_of(self, h: np.ndarray) -> np.ndarray:
        where = np.full(self.n, 0, np.int64)
        used = np.nonzero(self.ids >= 0)[0]
        where[self.ids[used]] = used
        return where

    @staticmethod
    def _one(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_PRIME) + ord(c) + 1) & ((1 << 64) - 1)
        return h

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20) & self.mask).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece of each hash, -1 if there is none."""
        slot, out = self._slot(h), np.full(len(h), -1, np.int32)
        for k in range(self.most):
            at = (slot + k) & int(self.mask)
            hit = (self.keys[at] == h) & (self.ids[at] >= 0)
            out[hit] = self.ids[at[hit]]
        return out


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each word with a space before it, lower-cased: offsets, code points."""
    texts = [" " + w for w in pc.utf8_lower(words.cast(pa.string())).to_pylist()]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _windows(offsets: np.ndarray, points: np.ndarray, pieces: Pieces) -> list[np.ndarray]:
    """For each length, the piece that starts at each place and ends within its word (-1: none)."""
    sizes = np.diff(offsets)
    left = np.repeat(offsets[1:], sizes) - np.arange(len(points))
    h, at, out = np.zeros(len(points), np.uint64), np.arange(len(points)), []
    p = points.astype(np.uint64) + np.uint64(1)
    for k in range(min(pieces.longest, int(sizes.max(initial=0)))):
        inside = left[at] > k
        at, h = at[inside], h[inside]
        h = h * _PRIME + p[at + k]
        found = np.full(len(points), -1, np.int32)
        found[at] = pieces.find(h)
        out.append(found)
    return out


def _forward(offsets: np.ndarray, windows: list[np.ndarray], chance: np.ndarray) -> np.ndarray:
    """Scaled chance of each prefix of each word in each language: (characters + words, languages), by word."""
    sizes, langs = np.diff(offsets), chance.shape[1]
    order = np.argsort(-sizes, kind="stable")
    base = offsets[:-1] + np.arange(len(sizes))  # a place before each word's first character
    alpha = np.zeros((int(offsets[-1]) + len(sizes), langs))
    alpha[base] = 1.0
    floor = np.full((1, langs), UNKNOWN * SCALE)
    live = len(sizes)
    by_size = sizes[order]
    for end in range(1, int(sizes.max(initial=0)) + 1):
        live = int(np.searchsorted(-by_size, -end, "right"))
        w = order[:live]
        total = alpha[base[w] + end - 1] * floor
        for k in range(1, min(len(windows), end) + 1):
            piece = windows[k - 1][offsets[w] + end - k]
            has = np.nonzero(piece >= 0)[0]
            if len(has):
                total[has] += alpha[base[w[has]] + end - k] * chance[piece[has]] * SCALE**k
        alpha[base[w] + end] = total
    return alpha


def _backward(offsets: np.ndarray, windows: list[np.ndarray], chance: np.ndarray) -> np.ndarray:
    sizes, langs = np.diff(offsets), chance.shape[1]
    base = offsets[:-1] + np.arange(len(sizes))
    beta = np.zeros((int(offsets[-1]) + len(sizes), langs))
    beta[base + sizes] = 1.0
    order = np.argsort(-sizes, kind="stable")
    by_size = sizes[order]
    for back in range(1, int(sizes.max(initial=0)) + 1):
        w = order[: int(np.searchsorted(-by_size, -back, "right"))]
        at = sizes[w] - back
        total = beta[base[w] + at + 1] * (UNKNOWN * SCALE)
        for k in range(1, min(len(windows), back) + 1):
            piece = windows[k - 1][offsets[w] + at]
            has = np.nonzero(piece >= 0)[0]
            if len(has):
                total[has] += beta[base[w[has]] + at[has] + k] * chance[piece[has]] * SCALE**k
        beta[base[w] + at] = total
    return beta


def _expected(pieces: Pieces, words: pa.Array, lang: np.ndarray, count: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces in words of known languages, over all segmentations."""
    langs = chance.shape[1]
    long_ = np.asarray(pc.utf8_length(words.cast(pa.string())).to_numpy(zero_copy_only=False)) >= WORD
    got = np.zeros(pieces.n * langs)
    for i in np.nonzero(long_)[0].tolist():
        piece, share = _expected_long(pieces, words.slice(i, 1), chance[:, lang[i]])
        np.add.at(got, piece * langs + int(lang[i]), share * float(count[i]))
    words, lang, count = words.filter(pa.array(~long_)), lang[~long_], count[~long_].astype(float)
    if not len(words):
        return got.reshape(-1, langs)
    offsets, points = _codes(words)
    sizes = np.diff(offsets)
    word = np.repeat(np.arange(len(sizes)), sizes)
    windows = _windows(offsets, points, pieces)
    alpha, beta = _forward(offsets, windows, chance), _backward(offsets, windows, chance)
    whole = alpha[offsets[1:] + np.arange(len(sizes))]
    place, own = np.arange(len(points)) + word, lang[word]  # alpha's row before each character
    for k, w in enumerate(windows):
        at = np.nonzero(w >= 0)[0]
        g = own[at]
        share = alpha[place[at], g] * chance[w[at], g] * SCALE ** (k + 1) * beta[place[at] + k + 1, g] / whole[word[at], g] * count[word[at]]
        got += np.bincount(w[at].astype(np.int64) * langs + g, share, len(got))
    return got.reshape(-1, langs)


def _log_sum(terms: list[float]) -> float:
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms))


def _expected_long(pieces: Pieces, word: pa.Array, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long word of one language, in logarithms: pieces, expected counts."""
    offsets, points = _codes(word)
    windows, n, unknown = _windows(offsets, points, pieces), len(points), math.log(UNKNOWN)
    found = [[(k + 1, int(w[i])) for k, w in enumerate(windows) if w[i] >= 0] for i in range(n)]
    log = {p: math.log(float(chance[p])) for row in found for _, p in row}
    ends: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    for i, row in enumerate(found):
        for k, p in row:
            ends[i + k].append((i, p))
    alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
    for i in range(1, n + 1):
        alpha[i] = _log_sum([alpha[i - 1] + unknown, *(alpha[j] + log[p] for j, p in ends[i])])
    for i in range(n - 1, -1, -1):
        beta[i] = _log_sum([beta[i + 1] + unknown, *(beta[i + k] + log[p] for k, p in found[i])])
    pairs = [(p, math.exp(alpha[i] + log[p] + beta[i + k] - alpha[n])) for i, row in enumerate(found) for k, p in row]
    return np.array([p for p, _ in pairs], np.int64), np.array([x for _, x in pairs])


class Model:
    """Languages and the chance of each piece in each."""

    def __init__(self, langs: list[str], pieces: Pieces, chance: np.ndarray) -> None:
        self.langs, self.pieces, self.chance = langs, pieces, chance

    @classmethod
    def fit(cls, langs: list[str], pieces: Pieces, words: pa.Array, lang: np.ndarray, count: np.ndarray, rounds: int = ROUNDS) -> Model:
        """Expected counts of pieces over all segmentations of the words, again and again."""
        chance = np.full((pieces.n, len(langs)), 1.0 / max(1, pieces.n))
        for _ in range(rounds):
            got = np.full((pieces.n, len(langs)), PRIOR)
            for at in range(0, len(words), PART):  # a bounded number of words at a time
                part = slice(at, at + PART)
                got += _expected(pieces, words[part], lang[part], count[part], chance)
            chance = got / got.sum(0)
        return cls(langs, pieces, chance)

    def log_chance(self, words: pa.Array) -> np.ndarray:
        """Natural logarithm of each word's chance in each language, over all its segmentations."""
        out = np.zeros((len(words), len(self.langs)))
        sizes = np.asarray(pc.utf8_length(words.cast(pa.string())).to_numpy(zero_copy_only=False))
        short = np.nonzero(sizes < WORD)[0]
        short = short[np.argsort(sizes[short], kind="stable")]  # words of about one length together
        for start in range(0, len(short), PART):
            part = short[start : start + PART]
            offsets, points = _codes(words.take(pa.array(part)))
            alpha = _forward(offsets, _windows(offsets, points, self.pieces), self.chance)
            n = np.diff(offsets)
            out[part] = np.log(alpha[offsets[1:] + np.arange(len(part))]) - n[:, None] * np.log(SCALE)
        for i in np.nonzero(sizes >= WORD)[0].tolist():
            out[i] = self._long(words.slice(i, 1))
        return out

    def _long(self, word: pa.Array) -> np.ndarray:
        """A long word: the same sums, a character at a time, with the scale kept apart."""
        offsets, points = _codes(word)
        windows, n, longest = _windows(offsets, points, self.pieces), len(points), self.pieces.longest
        ring, log = [np.ones(len(self.langs))], np.zeros(len(self.langs))
        for end in range(1, n + 1):
            total = ring[-1] * UNKNOWN
            for k in range(1, min(longest, end) + 1):
                if (piece := windows[k - 1][end - k]) >= 0:
                    total = total + ring[-k] * self.chance[piece]
            ring = [*ring[-longest:], total]
            if end % 8 == 0:
                log, ring = log + np.log(total), [r / total for r in ring]
        return log + np.log(ring[-1])


def _word_counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in it:
        for batch in slices(whole):
            offsets, codes, words = words_of(batch.column("text"))
            names = batch.column("lang").dictionary_encode()
            lang = np.repeat(names.indices.to_numpy(zero_copy_only=False), np.diff(offsets)).astype(np.int64)
            key, n = np.unique(lang * max(1, len(words)) + codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(key // max(1, len(words)))), words.take(pa.array(key % max(1, len(words)))), pa.array(n)], ["lang", "word", "n"])


def fit(spark: SparkSession, docs: DataFrame, vocabulary: str, sample: int = SAMPLE) -> Model | None:
    """Fits the model on labelled rows (text, lang), about ``sample`` bytes of each language; None without any.

    The sample is the bound of the fit: rows are taken by a hash of their text, at the rate that gives ``sample`` bytes
    of a language on average, so equal texts are all in or all out. Words are counted by the executors; the driver gets
    the distinct words of the sample. The model has a row for each piece and a column for each language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.sum(F.octet_length("text").cast("long") + 1).alias("n")).collect()}
    if not sizes:
        return None
    rate = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))))
    part = known.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.element_at(rate, F.col("lang")) * (1 << 20))
    counts = part.select("text", "lang").mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(sizes)
    code = {x: i for i, x in enumerate(langs)}
    lang = np.array([code[x] for x in counts["lang"].to_pylist()], np.int64)
    return Model.fit(langs, Pieces(public_pieces(vocabulary)), counts["word"].combine_chunks(), lang, counts["n"].to_numpy())


def _predict(it: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    model: Model | None = sent.value
    for whole in released(it):
        for batch in slices(whole, limit=HELD):
            text = pc.fill_null(batch.column("text"), "")
            letters = np.asarray(pc.match_substring_regex(text, r"\pL").to_numpy(zero_copy_only=False), bool)
            n = len(text)
            if model is None:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(["und"] * n), pa.array(np.zeros(n))], [*batch.schema.names[:-1], "lang_pred", "score"])
                continue
            offsets, codes, words = words_of(text)
            each = model.log_chance(words) if len(words) else np.zeros((0, len(model.langs)))
            doc = np.repeat(np.arange(n), np.diff(offsets))
            total = np.stack([np.bincount(doc, each[codes, k], n) for k in range(len(model.langs))], 1)
            top = total.argmax(1)
            posterior = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            lang = np.where(letters, np.array(model.langs, object)[top], "und")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang.tolist(), pa.string()), pa.array(np.where(letters, posterior, 0.0))], [*batch.schema.names[:-1], "lang_pred", "score"])


def predict(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """Language of each document: all columns but text, then lang_pred and score (the language's posterior).

    ``text`` must be the last column of ``docs``. A null text or one without a letter is ``und`` with score 0, and so
    are all if there is no model. Repeated rows each give a row; an empty table gives none.
    """
    sent = spark.sparkContext.broadcast(model)  # pieces x languages: fixed by the vocabulary
    schema = T.StructType([*docs.schema[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(lambda it: _predict(it, sent), schema)


def held_out(mod: int, rest: int) -> F.Column:
    """crc32(doc_id as text) mod ``mod`` is ``rest``; a null doc_id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def languages(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """Predictions for documents (doc_id, lang, text), learnt from those that are not held out (remainder 1 of 3)."""
    model = fit(spark, docs.where(~held_out(3, 1)).select("text", "lang"), vocabulary)
    return predict(spark, docs.select("doc_id", held_out(3, 1).alias("held_out"), "text"), model)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by the pieces of the public 32,000-piece vocabulary."""
    import public_tokenizers

    docs = take(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", lang="lang", text="text")
    return languages(spark, docs, public_tokenizers.path("piece_bpe_32k.model"))
