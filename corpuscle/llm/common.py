"""What the operators share: written intermediate tables, column names that cannot clash, batches of text."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds as words at one time (a longer single text is taken alone).
BATCH_BYTES = 4 << 20
#: Spark's setting that removes a plan's shuffle files when the plan has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local (tests) is a temporary folder made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="corpuscle-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Scratch:
    """Tables written to the shared folder to cut lineage; :meth:`drop` deletes one that is not needed any more.

    What is left is deleted when the session's process ends: results of a query are lazy and may still read it.
    """

    def __init__(self, spark: SparkSession, codec: str = "snappy") -> None:
        self.spark = spark
        self.codec = codec
        self.root = f"{shared_dir(spark)}/corpuscle-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self._delete, self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` as Parquet and returns it read again; the shuffle files of this write are removed when it ends."""
        path = f"{self.root}/{self.n:03d}-{name}"
        self.n += 1
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path, compression=self.codec)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._corpuscle_path = path
        return out

    def together(self, tables: list[DataFrame]) -> DataFrame:
        """One table of several written ones with the same columns."""
        return self.spark.read.schema(tables[0].schema).parquet(*(t._corpuscle_path for t in tables))

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._delete(df._corpuscle_path)

    def _delete(self, path: str) -> None:
        with contextlib.suppress(Exception):  # at exit the JVM may be gone; the folder then stays for the next clean-up
            jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def take(df: DataFrame, **columns: str) -> DataFrame:
    """Selects the named columns under the operator's own names; all others are left, so that none can clash."""
    return df.select(*(F.col(f"`{there}`").alias(own) for own, there in columns.items()))


def released(it: Iterator[pa.RecordBatch], forget: Callable[[], None] | None = None) -> Iterator[pa.RecordBatch]:
    """The batches; when they end, or the task does, ``forget`` is called and freed memory goes back to the system.

    Workers serve one task after another, of different queries: what one needed must not stay beside what the next needs.
    """
    try:
        yield from it
    finally:
        if forget:
            forget()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)


def text_bytes(text: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), np.int64)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the texts of each part have about ``limit`` bytes at most; a row is never cut."""
    ends = np.cumsum(text_bytes(batch.column(column)) + 1)
    start, n = 0, batch.num_rows
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def words_of(text: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: offsets (one more than texts), codes, distinct words.

    A null text has no words. With ``lower``, A-Z are lower-cased first.
    """
    text = pc.fill_null(text, "")
    if pa.types.is_large_string(text.type):
        text = text.cast(pa.string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    first = split.offsets.to_numpy()
    values = split.flatten()
    keep = np.asarray(pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False), bool)
    before = np.concatenate([[0], np.cumsum(keep)])
    encoded = values.filter(pa.array(keep)).dictionary_encode()
    offsets = before[first - first[0]].astype(np.int64)
    return offsets, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def hash_words(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w.as_py().encode(), seed) for w in words), np.uint64, len(words)) if len(words) < 64 else np.fromiter((h(w, seed) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers, one for each place in a shingle.
PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(offsets: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words of each text, in order: offsets, hashes.

    A text with fewer words (but one at least) has its whole sequence as one shingle, without words it has none.
    """
    counts = np.diff(offsets)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(made)]).astype(np.int64)
    total = int(out[-1])
    doc = np.repeat(np.arange(len(counts)), made)
    at = np.arange(total) - out[doc] + offsets[:-1][doc]
    size = np.minimum(counts, width)[doc]
    acc = size.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    for k in range(width):
        acc += np.where(size > k, mix(padded[at + k] * PLACE[k % 8] + np.uint64(k)), np.uint64(0))
    return out, mix(acc)


def parity_words(offsets: np.ndarray, hashes: np.ndarray, words: int) -> np.ndarray:
    """Parity sketch of each set: each of 64 * ``words`` cells holds whether an odd number of its hashes falls into it.

    Two sets differ by at least as many elements as their sketches differ by cells.
    """
    sets, cells = len(offsets) - 1, 64 * words
    out = np.zeros((sets, words), np.int64)
    for at in range(0, sets, 4096):  # so many sets at a time
        stop = min(at + 4096, sets)
        odd = np.zeros((stop - at) * cells, np.uint8)
        own = np.repeat(np.arange(stop - at), np.diff(offsets[at : stop + 1]))
        np.bitwise_xor.at(odd, own * cells + (hashes[offsets[at] : offsets[stop]] % np.uint64(cells)).astype(np.int64), np.uint8(1))
        out[at:stop] = np.packbits(odd, bitorder="little").view(np.int64).reshape(-1, words)
    return out


def distinct_keys(offsets: np.ndarray, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct upper ``bits`` of the hashes of each set, sorted, below the number of the set: offsets, keys."""
    sets = len(offsets) - 1
    if sets >> 64 - bits:
        raise ValueError(f"{sets} sets at one time are too many")
    key = np.repeat(np.arange(sets, dtype=np.uint64), np.diff(offsets)) << np.uint64(bits) | hashes >> np.uint64(64 - bits)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    first = np.searchsorted(key, np.arange(sets + 1, dtype=np.uint64) << np.uint64(bits)) if len(key) else np.zeros(sets + 1, np.int64)
    return first, key


def distinct_sets_by(sets: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts hashes by the number of their set (0 to n - 1) and drops repeats: offsets, hashes."""
    order = np.lexsort((hashes, sets))
    h, d = hashes[order], sets[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return np.concatenate([[0], np.cumsum(np.bincount(d[new], minlength=n))]).astype(np.int64), h[new]


def distinct_sets(offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the hashes of each set and drops repeats: offsets, hashes."""
    return distinct_sets_by(np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), hashes, len(offsets) - 1)
