"""Best-fit packing of token sequences: a configuration linear program over the lengths, then rounding."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, released, slices, take

#: Tokens of a sequence.
CAPACITY = 4096
#: Rounds of multiplicative weights of the first linear program and of later ones, and lengths priced in a round.
ROUNDS, LATER_ROUNDS, PRICED = 96, 72, 192
#: Programs in all: the first, and those of what rounding has left over.
PROGRAMS = 6
#: How strongly weights follow the coverage, and the share of the best price from which a configuration is used.
STEEPNESS, ORACLE = 4.0, 0.98
#: Distinct chunks of text that a task remembers the ids of.
REMEMBERED = 100_000


class Tokens:
    """Token ids of whole texts by ``tokenizers``, each distinct chunk between white space encoded once.

    The tokenizer must drop white space and never join what stands on its two sides, as the word BPE does; the ids of
    a text are then those of its chunks, in order. A-Z are lower-cased first (the tokenizer does so itself), except in
    texts that hold ``<|``, where upper case decides whether a special token is meant. A lower-case letter of ASCII or
    Latin-1 before ``.`` or ``,`` always ends a word of this tokenizer, so these are cut off before white space: such a
    letter is its own normal form, whatever stands before it, and the marks compose with nothing. (Not so for other
    letters: the lower case of a dotted capital I ends in a mark, which the tokenizer keeps with the full stop.) Chunks
    of such letters alone go to the BPE model of the tokenizer itself; all others through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.all = Tokenizer.from_file(path)
        self.model, self.known = self.all.model, {}
        letters = [c for c in map(chr, range(256)) if c.isalpha() and c.islower() and c not in "\xaa\xba\xb5"]
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = str.maketrans({c: as_bytes.pre_tokenize_str(c)[0][0] for c in letters})
        self.plain = frozenset(letters)

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each chunk."""
        known, plain, model = self.known, self.plain, self.model
        out: list = [known.get(c) for c in chunks]
        rest = []
        for i, ids in enumerate(out):
            if ids is None:
                c = chunks[i]
                if plain.issuperset(c):
                    out[i] = array("I", [t.id for t in model.tokenize(c.translate(self.table))]).tobytes()
                else:
                    rest.append(i)
        for a in range(0, len(rest), 4096):
            part = rest[a : a + 4096]
            for i, e in zip(part, self.all.encode_batch_fast([chunks[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = array("I", e.ids).tobytes()
        if len(known) + len(chunks) > REMEMBERED:
            known.clear()
        known.update(zip(chunks[:REMEMBERED], out[:REMEMBERED], strict=True))
        return out

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids (little-endian unsigned 32-bit) of each text; a null text has none."""
        text = pc.fill_null(text, "")
        special = pc.match_substring(text, "<|")
        low = pc.replace_substring_regex(pc.ascii_lower(text), r"([a-z\x{df}-\x{f6}\x{f8}-\x{ff}])([.,]+)(\s|$)", r"\1 \2\3")
        split = pc.ascii_split_whitespace(pc.if_else(special, text, low))
        first, values = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        codes = values.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids = self._ids(values.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        starts = np.cumsum(sizes) - sizes
        n = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(starts[codes] - ends[:-1], n) + np.arange(ends[-1])
        return ends[first - first[0]], flat[at]


_MADE: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """One for each worker process and path; what it remembers is dropped at the end of each task."""
    if path not in _MADE:
        _MADE[path] = Tokens(path)
    return _MADE[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def _cut(it: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    tokens = tokens_of(path)
    for whole in released(it, tokens.known.clear):
        for batch in slices(whole):
            offsets, ids = tokens(batch.column("text"))
            n = np.diff(offsets) + 1  # with the end
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = nth * capacity
            length = np.minimum(n[doc] - start, capacity)
            a = offsets[doc] + start
            b = np.minimum(a + length, offsets[doc + 1])
            end = np.array([end_id], "<u4").tobytes()
            crc = [zlib.crc32(end if last else b"", zlib.crc32(ids[x:y])) for x, y, last in zip(a.tolist(), b.tolist(), (y - x < k for x, y, k in zip(a, b, length)), strict=True)]
            order = np.argsort(length, kind="stable")
            sorted_ = length[order]
            among = np.empty(len(order), np.int64)
            among[order] = np.arange(len(order)) - np.searchsorted(sorted_, sorted_) + seen[sorted_]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(nth.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(among)], [f.split()[0] for f in PIECES.split(", ")])


def _prices(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack with repeats: the most worth for each capacity, and the length taken last (0: none, a token is left)."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for w in range(1, capacity + 1):
        n = int(np.searchsorted(lengths, w, "right"))
        best[w] = best[w - 1]
        if n:
            gain = best[w - lengths[:n]] + worth[:n]
            k = int(gain.argmax())
            if gain[k] > best[w]:
                best[w], took[w] = gain[k], lengths[k]
    return best, took


def configuration_lp(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS, seed: int = 1) -> tuple[dict[tuple[int, ...], float], float]:
    """Fractional packing: how often each configuration (lengths that fit a sequence) is used, and a lower bound.

    The covering program "as few configurations as cover every length as often as it occurs" by multiplicative weights.
    A length's weight falls exponentially with the share of its demand that is covered, against the share that the
    round should have reached. In a round, a knapsack dynamic program prices the configurations of PRICED lengths, drawn
    anew each round from those that are still short, under the weights; its table gives the best one around each of
    them, and those within ORACLE of the best of all are used. A round costs capacity * PRICED steps, whatever the
    counts, and there are PRICED * rounds configurations at most. Before the first and in every twelfth round all
    lengths are priced at once: weights over the best price are a solution of the dual, so they bound the optimum from below.
    """
    demand = counts.astype(float)
    covered = np.zeros(len(lengths))
    at = {n: i for i, n in enumerate(lengths.tolist())}
    used: dict[tuple[int, ...], float] = {}
    rng = np.random.default_rng(seed)
    noise = 1 + 0.01 * rng.random(len(lengths))  # equal weights would always favour the same lengths
    duals = [lengths.astype(float), lengths * noise]
    for round_ in range(1, rounds + 1):
        open_ = np.nonzero(demand - covered > 1e-9)[0]
        if not len(open_):
            break
        share = round_ / rounds
        most = min(1.0, 1.2 * share + 0.1)  # of each demand: the last rounds still have all lengths to choose from
        weight = lengths * (1 + 0.01 * rng.random(len(lengths))) * np.exp(STEEPNESS * (share - covered / demand))
        if round_ % 12 == 0:
            duals.append(lengths * np.exp(-STEEPNESS * covered / demand))
        open_ = np.sort(rng.permutation(open_)[:PRICED])
        best, took = _prices(lengths[open_], weight[open_], capacity)
        fills: list[tuple[int, ...]] = [()]
        for room in range(1, capacity + 1):
            t = int(took[room])
            fills.append((t, *fills[room - t]) if t else fills[room - 1])
        for i in open_[::-1].tolist():
            n = int(lengths[i])
            if weight[i] + best[capacity - n] < ORACLE * best[capacity] and round_ < 0.75 * rounds:
                continue
            inside = tuple(sorted((n, *fills[capacity - n]), reverse=True))
            each = [(at[x], inside.count(x)) for x in set(inside)]
            step = min((demand[j] * most - covered[j]) / k for j, k in each)
            if step <= 1e-9:
                continue
            used[inside] = used.get(inside, 0.0) + step
            for j, k in each:
                covered[j] += step * k
    return used, max(float(demand @ y) / float(_prices(lengths, y, capacity)[0][capacity]) for y in duals)


def best_fit(left: dict[int, int], out: dict[tuple[int, ...], int], capacity: int = CAPACITY) -> None:
    """Best-fit decreasing of ``left`` (length: items) into the room of the configurations ``out``, then into new ones.

    All items of a length go at once, into as many sequences of a configuration as they fill, so the time depends on
    how many lengths and configurations there are, not on the items.
    """
    by_room: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for key, times in out.items():
        by_room[capacity - sum(key)][key] = times
    out.clear()

    def put(key: tuple[int, ...], n: int, k: int, times: int) -> None:
        new = tuple(sorted((*key, *[n] * k), reverse=True))
        room = by_room[capacity - sum(new)]
        room[new] = room.get(new, 0) + times

    for n in sorted(left, reverse=True):
        c = left[n]
        room = n
        while c:
            while room <= capacity and not by_room[room]:
                room += 1
            each = min(room, capacity) // n
            key, times = by_room[room].popitem() if room <= capacity else ((), c // each + 1)
            full = min(times, c // each)
            c -= full * each
            if full:
                put(key, n, each, full)
            if full < times and c:  # the last of them, not filled
                put(key, n, c, 1)
                c, full = 0, full + 1
            if full < times and key:
                by_room[room][key] = by_room[room].get(key, 0) + times - full
    for room in by_room:
        out.update(room)


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> tuple[dict[tuple[int, ...], int], dict[str, float]]:
    """Configurations and how often each is used, so that every item is placed once; and figures of the solution.

    The fractional solution is rounded: the configurations used most come first, each rounded up as far as there are
    still items for it. What rounding leaves over is a smaller program of the same kind, PROGRAMS of them at most, as
    long as each places a twentieth of what was left. The last rest goes by best fit into the room there is, then into new
    sequences. What rounding can leave over is bounded by the number of configurations, not by the items, so the
    driver's time depends on how many lengths there are. Figures: items, items placed from the programs, sequences, and
    ``bound``, a lower bound on the sequences from the first program's dual.
    """
    left = {int(n): int(c) for n, c in zip(lengths, counts, strict=True) if c}
    items = sum(left.values())
    out: dict[tuple[int, ...], int] = {}
    bound = float(left.get(capacity, 0))
    if whole := left.pop(capacity, 0):
        out[(capacity,)] = whole
    by_program = whole
    for program in range(PROGRAMS):
        if not left:
            break
        types = np.array(sorted(left))
        used, below = configuration_lp(types, np.array([left[n] for n in types.tolist()]), capacity, LATER_ROUNDS if program else ROUNDS, program)
        bound += 0.0 if program else below
        before = sum(left.values())
        for inside, times in sorted(used.items(), key=lambda x: (-x[1], x[0])):
            each = {n: inside.count(n) for n in inside}
            if k := min([int(np.ceil(times - 1e-9)), *(left.get(n, 0) // m for n, m in each.items())]):
                out[inside] = out.get(inside, 0) + k
                for n, m in each.items():
                    left[n] -= k * m
        left = {n: c for n, c in left.items() if c}
        placed = before - sum(left.values())
        by_program += placed
        if placed < 0.05 * before:
            break
    best_fit(left, out, capacity)
    return out, {"items": items, "by_program": by_program, "sequences": sum(out.values()), "bound": bound}


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how often each is used, so that every item is placed once. See :func:`solve`."""
    return list(solve(lengths, counts, capacity)[0].items())


def places(configurations: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, runs of its items: the first of the run, items of it in a sequence, first sequence, offset."""
    taken: dict[int, int] = {}
    rows: list[tuple[int, int, int, int, int]] = []
    base = 0
    for inside, times in configurations:
        offset = 0
        for n in sorted(set(inside), reverse=True):
            k = inside.count(n)
            rows.append((n, taken.get(n, 0), k, base, offset))
            taken[n] = taken.get(n, 0) + k * times
            offset += n * k
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "base", "offset"), table.T, strict=True))


def _place(it: Iterator[pa.RecordBatch], sent, names: list[str]) -> Iterator[pa.RecordBatch]:
    t = sent.value
    span = int(t["first"].max(initial=0)) + 1
    keys = t["length"].astype(object) * span + t["first"] if span > 1 << 50 else t["length"] * span + t["first"]
    for b in it:
        length, rank = (b.column(x).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
        at = np.searchsorted(keys, length * span + np.minimum(rank, span - 1), "right") - 1
        i = rank - t["first"][at]
        seq, off = t["base"][at] + i // t["each"][at], t["offset"][at] + i % t["each"][at] * length
        yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Packs all documents (doc_id, text) into as few sequences of ``capacity`` tokens as it can.

    A document is its ids and ``end_id``; a longer one is cut into pieces of ``capacity`` tokens. Returns for each piece
    doc_id, piece, start, length, ids_crc32, sequence_id, offset (gapless in each sequence).

    One pass tokenises and writes the pieces without their ids. What goes to the driver is the number of pieces of
    each length (``capacity`` rows at most, whatever the corpus); the plan that goes back has a few rows for each
    configuration, and their number is bounded by rounds and lengths too. A piece's number among those of its length
    is its number in its task plus the pieces of earlier tasks, so a very frequent length is never gathered.
    A null or empty text is the end alone. A very long text is tokenised alone, whole. A null doc_id stays null. Other
    columns of ``docs`` are ignored, whatever they are called. Repeated rows are packed each. An empty table
    gives no rows.
    """
    scratch = Scratch(spark)
    pieces = scratch.write(docs.select("doc_id", "text").mapInArrow(lambda it: _cut(it, tokenizer, end_id, capacity), PIECES), "pieces")
    tasks = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    lengths = {r.length: r.n for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(plan(np.array(sorted(lengths), np.int64), np.array([lengths[n] for n in sorted(lengths)], np.int64), capacity))
    sent = spark.sparkContext.broadcast(table)
    from pyspark.sql import Window

    before = tasks.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    starts = before.select("length", "part", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.mapInArrow(lambda it: _place(it, sent, names), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens of the word BPE."""
    import public_tokenizers

    docs = take(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text")
    return pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))
