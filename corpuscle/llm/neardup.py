"""MinHash near-duplicate documents: universal hash minima, bands, signature check, exact sets, star components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, distinct_sets, hash_words, mix, parity_words, released, shingles, slices, take, words_of
from .components import link_buckets

#: Words of a shingle; link at WIDTH-word Jaccard of PER_CENT / 100 or more.
WIDTH, PER_CENT = 5, 85
#: Hash minima: BANDS bands of ROWS. A pair at 0.85 shares no band with probability (1 - 0.85 ** 8) ** 48 = 2e-7.
BANDS, ROWS = 48, 8
#: Standard errors below the threshold at which the signature already rules a pair out (a false one in 1e9).
SIGMAS = 6.0

#: 64-bit words of a set's parity sketch.
PARITY = 32
#: Bytes of text whose shingles are held at one time; a longer text is taken alone.
HELD = 2 << 20

SKETCH = "doc_id long, copy long, node long, check long, n_shingles long, bands binary, signature binary"


def _coefficients(seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    k = BANDS * ROWS
    return rng.integers(0, 1 << 64, k, np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, k, np.uint64)


def sets_of(text: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted: offsets, hashes."""
    offsets, codes, words = words_of(text)
    made = hash_words(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    return distinct_sets(*shingles(offsets, made, width))


def minima(offsets: np.ndarray, hashes: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
    """Smallest value of each universal hash (a * x + b) mod 2^64, upper half, over each set that is not empty."""
    a, b = _coefficients()
    sizes = np.diff(offsets)
    full = np.nonzero(sizes)[0]
    out = np.empty((len(full), len(a)), np.uint32)
    at = 0
    while at < len(full):  # as many sets at a time as stay in the processor's cache; a larger one alone, by parts
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[full[at]] + chunk, "right")) - 1)
        stop = max(at + 1, int(np.searchsorted(full, stop)))
        x = hashes[offsets[full[at]] : offsets[full[stop - 1] + 1]]
        starts = offsets[full[at:stop]] - offsets[full[at]]
        for k in range(len(a)):
            out[at:stop, k] = np.minimum.reduceat(((x * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), starts)
        at = stop
    return out


def _sketch(it: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for whole in released(it):
        for batch in slices(whole, limit=HELD):
            offsets, hashes = sets_of(batch.column("text"), width)
            sizes = np.diff(offsets)
            n, full = len(sizes), np.nonzero(sizes)[0]
            sig = minima(offsets, hashes)
            bands = np.zeros((len(full), BANDS), np.uint64)
            for k in range(BANDS):
                for j in range(ROWS):
                    bands[:, k] = mix(bands[:, k] * np.uint64(0x9E3779B97F4A7C15) + sig[:, k * ROWS + j] + np.uint64(k + 1))
            sums = np.zeros((2, n), np.uint64)
            if len(full):
                starts = offsets[full]
                for k, salt in enumerate((0, 0x5851F42D4C957F2D)):
                    sums[k, full] = mix(np.add.reduceat(mix(hashes ^ np.uint64(salt)), starts))
            low = (sig[:, ::2] & np.uint32(0xFF)).astype(np.uint8)  # a byte of every other minimum is enough to rule out

            def column(rows: np.ndarray) -> list[bytes | None]:
                out: list[bytes | None] = [None] * n
                for i, r in zip(full.tolist(), rows, strict=True):
                    out[i] = r.tobytes()
                return out

            arrays = [batch.column("doc_id"), batch.column("copy"), *(pa.array(x.view(np.int64)) for x in sums), pa.array(sizes), *(pa.array(column(x), pa.binary()) for x in (bands, low))]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SKETCH.split(", ")])


def _band_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        keys = np.frombuffer(b"".join(b.column("bands").to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(b.column("node").to_numpy(zero_copy_only=False), BANDS))], ["band", "node"])


def _agree(it: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for b in it:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("sa", "sb"))
            keep = (x == y).mean(1) >= least
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])


def _verify(it: Iterator[pa.RecordBatch], width: int, per_cent: int) -> Iterator[pa.RecordBatch]:
    for whole in released(it):
        for half in slices(whole, "ta"):
            for b in slices(half, "tb"):
                (oa, ha), (ob, hb) = (sets_of(b.column(c), width) for c in ("ta", "tb"))
                linked = np.zeros(b.num_rows, bool)
                for i in range(b.num_rows):
                    x, y = ha[oa[i] : oa[i + 1]], hb[ob[i] : ob[i + 1]]
                    if len(x) and len(y):
                        both = int(np.isin(x, y, assume_unique=True).sum())
                        linked[i] = 100 * both >= per_cent * (len(x) + len(y) - both)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(linked)], ["a", "b", "linked"])


def _tokens(it: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for whole in released(it):
        for b in slices(whole):
            offsets, hashes = sets_of(b.column("text"), width)
            sizes = np.diff(offsets)
            node = np.repeat(b.column("node").to_numpy(zero_copy_only=False), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(hashes.view(np.int64)), pa.array(np.repeat(sizes, sizes))], ["node", "token", "n"])


def _parity(it: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for whole in released(it):
        for b in slices(whole, limit=HELD):
            words = parity_words(*sets_of(b.column("text"), width), PARITY)
            yield pa.RecordBatch.from_arrays([b.column("node"), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(PARITY))], ["node", *(f"p{k}" for k in range(PARITY))])


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = WIDTH, per_cent: int = PER_CENT) -> DataFrame:
    """Groups of near-duplicate documents: doc_id, n_shingles, component_id, kept; one row for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set holds its distinct ``width``-word
    shingles, or its whole sequence if it is shorter. Two documents are linked if 100 * intersection >= ``per_cent`` *
    union; component_id is the smallest doc_id reachable over links.

    1. One pass over the texts: 384 universal hash minima, 48 band keys, a 128-bit hash of the set.
    2. Equal sets form a class; one of its texts goes on, so a group of copies costs one row.
    3. In each bucket of a band, one member is paired with each other one, so a bucket costs its size; the members of
       buckets that then still hold several components go to an exact prefix-filter join on their shingles. No two
       documents of different components that share a band and may be linked remain uncompared.
    4. Signatures rule out pairs that are clearly below the threshold; the rest are compared by their full sets.
    5. Components by alternating large-star and small-star.

    A null or empty text, or one of white space, has an empty set and is linked with nothing. A row without doc_id takes
    part like any other; its component_id is the smallest doc_id of its component, null where there is none, and it is
    kept only then. Rows with one doc_id and different texts each take part with their own text. Very long texts are
    taken alone, whole. An empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    scratch = Scratch(spark)
    texts = take(docs, doc_id="doc_id", text="text").withColumn("copy", F.xxhash64("text"))
    sketch = scratch.write(texts.mapInArrow(lambda it: _sketch(it, width), SKETCH), "sketch")
    full = sketch.where("n_shingles > 0")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy"))
    classes = scratch.write(full.groupBy("node", "check", "n_shingles").agg(rep.alias("rep")).select("node", "check", "n_shingles", "rep.doc_id", "rep.copy"), "classes")
    ids = classes.select("node", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "copy")
    own = full.select("node", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "copy", "bands", "signature")
    reps = scratch.write(own.join(ids, ["node", "id", "none", "copy"], "left_semi").dropDuplicates(["node"]).select("node", "bands", "signature"), "reps")
    bands = reps.select("node", "bands").mapInArrow(_band_rows, "band long, node long").repartition("band")  # counted and joined where it lies
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    buckets = scratch.write(bands.join(shared, "band", "left_semi"), "buckets")

    # texts of all candidates, once; how many there are grows with the corpus, so they are not broadcast
    wanted = ids.join(buckets.select("node").distinct(), "node", "left_semi")
    with_ids = texts.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "copy", "text")
    needed = scratch.write(with_ids.hint("merge").join(wanted, ["id", "none", "copy"]).select("node", "text").dropDuplicates(["node"]), "texts")
    threshold = per_cent / 100
    agree = threshold + (1 - threshold) / 256  # different minima share a byte now and then
    bound = agree - SIGMAS * (agree * (1 - agree) / (BANDS * ROWS // 2)) ** 0.5

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        sig = reps.select("node", "signature")
        near = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "sa", "sb").mapInArrow(lambda it: _agree(it, bound), "a long, b long")
        near = scratch.write(near, f"{name}-near")
        with_texts = near.join(needed.toDF("a", "ta"), "a").join(needed.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
        return with_texts.mapInArrow(lambda it: _verify(it, width, per_cent), "a long, b long, linked boolean").where("linked").select("a", "b")

    def sets(nodes: DataFrame) -> DataFrame:
        return needed.join(nodes, "node", "left_semi").mapInArrow(lambda it: _tokens(it, width), "node long, token long, n long")

    sketches = needed.mapInArrow(lambda it: _parity(it, width), f"node long, {', '.join(f'p{k} long' for k in range(PARITY))}")
    roots = link_buckets(buckets, linked, sets, threshold, scratch, sketches=sketches)
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(least, "root").select("node", "check", "n_shingles", "component_id")
    out = sketch.select("doc_id", "n_shingles", "node", "check").join(named, ["node", "check", "n_shingles"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents at 0.85 on five words."""
    return near_duplicates(spark, take(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text"))
