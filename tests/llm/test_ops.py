"""The corpus operators against brute force, on the driver's small table and on odd texts."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import decontaminate, katz, langid, licences, linededup, neardup, packing, pii, queries, sharding, topk
from corpuscle.llm.common import Scratch
from corpuscle.llm.components import link_buckets, ranked_pairs, star_components, union_find

from ..conftest import DATA
from .conftest import ODD

WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def both(docs, odd):
    return docs.union(odd.select("doc_id", "text"))


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- 1 packing ----------------------------------------------------------------------------------------------------


def test_packing(spark, docs, odd):
    from tokenizers import Tokenizer

    table = both(docs, odd)
    rows = packing.pack(spark, table, WORD_BPE).collect()
    t, of = Tokenizer.from_file(WORD_BPE), collections.defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
    for doc_id, text in table.collect():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(of[doc_id], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(-(-len(ids) // 4096)))
        for p in pieces:
            part = np.array(ids[4096 * p.piece : 4096 * (p.piece + 1)], "<u4")
            assert (p.start, p.length, p.ids_crc32) == (4096 * p.piece, len(part), zlib.crc32(part.tobytes()))
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_packing_plans_and_empty(spark, docs):
    rng = np.random.default_rng(1)
    for _ in range(5):
        lengths = np.unique(rng.integers(1, 65, 20))
        counts = rng.integers(1, 30, len(lengths))
        made = packing.plan(lengths, counts, 64)
        used = collections.Counter()
        for inside, k in made:
            assert sum(inside) <= 64
            for n in inside:
                used[n] += k
        assert used == dict(zip(lengths.tolist(), counts.tolist(), strict=True))
        plain: dict = {}
        packing.best_fit(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), plain, 64)
        assert sum(k for _, k in made) <= 1.02 * sum(plain.values()) + 1
    assert packing.pack(spark, docs.limit(0), WORD_BPE).count() == 0


def test_packing_comes_from_its_program_and_is_near_its_bound():
    rng = np.random.default_rng(2)
    took = []
    for items in (10_000, 10_000_000):  # the same lengths, a thousand times as often
        drawn = np.minimum(rng.lognormal(5.5, 1.0, 10_000).astype(int) + 1, 4096)
        lengths, counts = np.unique(drawn, return_counts=True)
        start = time.perf_counter()
        out, figures = packing.solve(lengths, counts * (items // 10_000))
        took.append(time.perf_counter() - start)
        assert sum(k * len(c) for c, k in out.items()) == figures["items"] == items
        assert figures["by_program"] >= 0.5 * items
        assert figures["bound"] <= figures["sequences"] <= 1.01 * figures["bound"] + 1
    assert took[1] < 3 * took[0] + 1  # the driver's time depends on the lengths, not on the items


def test_packing_ids_are_those_of_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = np.random.default_rng(4)
    some = list("aZéßÿİıΣςǅµª.,!'-_ \t\u0307\u0301\u00a0\u20ac12") + ["it's", "don't.", "<|endoftext|>", "...", "日本", "e\u0301."]
    texts = ["".join(rng.choice(some, rng.integers(0, 12))) for _ in range(20_000)] + ["İ...", "İ,", ""]
    offsets, ids = packing.Tokens(WORD_BPE)(pa.array(texts))
    expected = Tokenizer.from_file(WORD_BPE).encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, a, b, e in zip(texts, offsets, offsets[1:], expected, strict=False) if ids[a:b].tolist() != e.ids]
    assert not wrong


# --- 2 top-k ------------------------------------------------------------------------------------------------------


def test_topk_against_sql_and_ties(spark, duck):
    rows = queries.QUERIES["op2_topk"](spark, DATA)
    cols = sorted(rows.columns)
    expected = duck.sql(f"SELECT {', '.join(cols)} FROM ({topk.OP2_SQL})").fetchall()
    assert sorted(map(tuple, rows.select(*cols).collect())) == sorted(expected)
    v = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(9)] + [(20, [1.0]), (50, [1e300, 1e300])], "vec_id long, v array<double>")
    got = topk.top_k(spark, v.where("vec_id in (0, 20)"), v.where("vec_id < 50"), 3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    assert topk.top_k(spark, v.where("vec_id = 50"), v, 1, block=1).first().vec_id == 0
    assert topk.top_k(spark, v.limit(0), v, 3).count() == 0


def test_topk_leaves_unusable_vectors_out(spark):
    rows = [(0, [0.5]), (1, None), (2, [None]), (3, [float("nan")]), (4, [float("inf")]), (5, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [r.vec_id for r in df.where(topk.usable()).collect()] == [0]


# --- 3 lines ------------------------------------------------------------------------------------------------------


def brute_lines(rows, similarity=0.8):
    places = collections.defaultdict(list)
    for doc_id, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            if n := re.sub(r"[ \t\n\x0b\f\r]+", " ", line.lower()).strip(" "):
                places[n].append((doc_id, k))
    sets = {n: {n[i : i + 5] for i in range(max(1, len(n) - 4))} for n in places}
    names = sorted(sets, key=lambda n: min(places[n]))
    links = []
    for i, a in enumerate(names):
        for b in names[:i]:
            if min(len(sets[a]), len(sets[b])) >= similarity * max(len(sets[a]), len(sets[b])):
                c = len(sets[a] & sets[b])
                if c >= similarity * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
                    links.append((names.index(b), i))
    root = components(range(len(names)), links)
    of = collections.defaultdict(list)
    for i, n in enumerate(names):
        of[root[i]] += places[n]
    return {p for group in of.values() for p in sorted(group)[1:]}


def test_line_dedup(spark, docs, odd):
    table = docs.where("doc_id < 60").union(odd.select("doc_id", "text"))
    rows = [tuple(r) for r in table.collect()]
    gone = brute_lines(rows)
    got = {r.doc_id: r for r in linededup.duplicate_lines(spark, table).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        kept = [x for k, x in enumerate((text or "").split("\n")) if (doc_id, k) not in gone]
        assert got[doc_id].n_removed == sum(d == doc_id for d, _ in gone)
        assert got[doc_id].text == (None if text is None else "\n".join(kept))


def test_line_dedup_repeats_and_empty(spark, docs):
    twice = spark.createDataFrame([(1, "a line of some length here\nother"), (1, "a line of some length here\nother"), (2, "a line of some length hers"), (None, "x")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in linededup.duplicate_lines(spark, twice).collect()), key=str)
    assert got == [(1, "a line of some length here\nother"), (1, "a line of some length here\nother"), (2, ""), (None, "x")]
    assert linededup.duplicate_lines(spark, docs.limit(0)).count() == 0


def sharing_bands(spark, pairs):
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    return {r.i for r in table.where(F.arrays_overlap(linededup.band_keys("a"), linededup.band_keys("b"))).select("i").collect()}


def test_lines_recall_by_number_of_words(spark):
    """Lines with random letters changed, words added, and heads changed, whose coefficient is 0.8 or more."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzäöüß0123456789-"), rng.integers(2, 11)))
    for least, most in ((1, 2), (3, 4), (5, 8), (9, 20), (21, 60)):
        pairs = []
        for _ in range(4000):
            w = [word() for _ in range(rng.integers(least, most + 1))]
            a, kind = " ".join(w), rng.integers(0, 3)
            if kind == 0:
                b = list(a)
                for _ in range(rng.integers(1, 1 + max(1, len(a) // 40))):
                    b[rng.integers(0, len(b))] = "z"
                b = "".join(b)
            elif kind == 1:
                b = " ".join([*w, word()])
            else:
                b = " ".join(["*", *w]) if rng.random() < 0.5 else "q" + a[1:]
            x, y = ({t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in (a, b))
            if a != b and len(x & y) >= 0.8 * len(x | y):
                pairs.append((a, b))
        found = len(sharing_bands(spark, pairs))
        assert len(pairs) >= 20 and found >= 0.97 * len(pairs), (least, most, found, len(pairs))


def test_large_buckets_lose_no_link(spark):
    """Hundreds of lines that share bands, most pairs of which are just below the threshold."""
    rng = np.random.default_rng(6)
    base = " ".join("".join(rng.choice(list("abcdefghijkl"), 6)) for _ in range(20))
    lines = []
    for _ in range(300):
        x = list(base)
        for _ in range(rng.integers(1, 7)):
            x[rng.integers(0, len(x))] = "xyz"[rng.integers(0, 3)]
        lines.append("".join(x))
    rows = [(i, t) for i, t in enumerate(lines)]
    gone = {d for d, _ in brute_lines(rows)}
    got = linededup.duplicate_lines(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert {r.doc_id for r in got.where("n_removed > 0").collect()} == gone


def test_roots_are_looked_up_once_for_each_node_of_large_buckets(spark):
    """Sixty nodes in twelve buckets each, of two components that stay apart."""
    nodes, bands = 60, 12
    buckets = spark.range(nodes * bands).selectExpr(f"id % {bands} as band", f"id div {bands} as node").cache()
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    linked = lambda pairs, name: pairs.where("a % 2 = b % 2")
    sets = lambda of: of.selectExpr("node", "node as token", "1L as n")
    roots = link_buckets(buckets, linked, sets, 0.8, Scratch(spark))
    assert {(r.node, r.root) for r in roots.collect()} == {(i, i % 2) for i in range(nodes)}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    made, runs = [], store.executionsList(before, 1000)
    for k in range(runs.size()):
        values, graph = store.executionMetrics(runs.apply(k).executionId()), store.planGraph(runs.apply(k).executionId()).allNodes()
        for node in (graph.apply(i) for i in range(graph.size())):
            if re.search(r"Join \[node#\d+L?\], \[node#\d+L?\], LeftOuter", node.desc()):
                rows = [m.accumulatorId() for m in (node.metrics().apply(i) for i in range(node.metrics().size())) if m.name() == "number of output rows"]
                made += [int(values.apply(m).replace(",", "")) for m in rows if values.contains(m)]
    assert made and max(made) <= nodes, made


def test_a_node_meets_a_centre_once_however_many_buckets_they_share(spark, monkeypatch):
    """Sixty nodes in twelve buckets each: no join by bucket, and of two components that stay apart no more rows than pairs."""
    nodes, bands = 60, 12
    buckets = spark.range(nodes * bands).selectExpr(f"id % {bands} as band", f"id div {bands} as node", f"{nodes}L as n").cache()
    plans, given, write = [], [], Scratch.write

    def noted(self, df, name):
        if name == "pairs":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(self, df, name)

    def linked(pairs, name):
        given.append(sorted(map(tuple, pairs.collect())))
        return pairs.where("a % 2 = b % 2")

    monkeypatch.setattr(Scratch, "write", noted)
    sets = lambda of: of.selectExpr("node", "node as token", "1L as n")
    roots = link_buckets(buckets, linked, sets, 0.8, Scratch(spark))
    assert {(r.node, r.root) for r in roots.collect()} == {(i, i % 2) for i in range(nodes)}
    assert given[0] == [(i, nodes - 1) for i in range(nodes - 1)]  # all with the most central one
    assert given[1] and all(a < b and not a % 2 * b % 2 for a, b in given[1]) and len(given[1]) == len(set(given[1]))  # odd ones are linked
    of_rounds = [x for p in plans[:-1] for x in re.findall(r"Join Inner, .*", p) if x.count("band#") > 1 and "a#" not in x]
    assert not of_rounds, of_rounds


def test_short_lines_that_are_near_duplicates_share_a_band(spark):
    rng = np.random.default_rng(3)
    pairs = [("1. introduction", "2. introduction")]
    while len(pairs) < 300:
        a = "".join(rng.choice(list("abcdefgh "), rng.integers(4, 28))).strip()
        k = rng.integers(0, len(a) + 1)
        b = (a[:k] + "z" * rng.integers(0, 2) + a[k + rng.integers(0, 2) :]).strip()
        x, y = ({t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in (a, b))
        if "  " not in a + b and a != b and len(x & y) >= 0.8 * len(x | y):
            pairs.append((a, b))
    assert len(sharing_bands(spark, pairs)) == len(pairs)
    two = spark.createDataFrame([(1, "1. introduction\nother"), (2, "2. introduction\nmore")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in linededup.duplicate_lines(spark, two).collect()) == [(1, "1. introduction\nother"), (2, "more")]


# --- 4 decontamination --------------------------------------------------------------------------------------------


def test_decontamination(spark, docs, odd):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text")
    items = {r.item_id: [re.sub(r"[\W_]+", "", w.lower()) for w in words(r.text)] for r in bench.collect()}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark, both(docs, odd), bench).collect()}
    expected = set()
    for doc_id, text in both(docs, odd).collect():
        w = " ".join(x for x in (re.sub(r"[\W_]+", "", y.lower()) for y in words(text)) if x)
        expected |= {(doc_id, i) for i, item in items.items() if f" {' '.join(x for x in item if x)} " in f" {w} "}
    assert expected and expected <= got
    clean = {d for d, _ in got} - {d for d, _ in expected}
    assert not clean


def test_decontamination_finds_edited_copies_and_leaves_others(spark, docs):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").limit(5)
    rng, rows = np.random.default_rng(2), []
    for r in bench.collect():
        w = r.text.split()
        edited = [("other" if rng.random() < 0.15 else x) for x in w]
        rows += [(r.item_id, "before " * 40 + " ".join(edited) + " after" * 40), (100 + r.item_id, " ".join(rng.permutation(w)))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted({r.doc_id for r in decontaminate.contaminated(spark, table, bench).collect()}) == sorted(r.item_id for r in bench.collect())
    assert decontaminate.contaminated(spark, table, bench.limit(0)).count() == 0 and decontaminate.contaminated(spark, docs.limit(0), bench).count() == 0


def test_decontamination_finds_an_edited_copy_beside_an_exact_one(spark):
    words_ = [f"w{k}" for k in range(20)]
    edited = [f"other{k}" if k in (5, 11, 17) else w for k, w in enumerate(words_)]
    bench = spark.createDataFrame([(1, " ".join(words_))], "item_id long, text string")
    table = spark.createDataFrame([(1, "before " * 30 + " ".join(words_) + " after" * 30), (2, "before " * 30 + " ".join(edited) + " after" * 30), (3, "before after " * 30)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in decontaminate.contaminated(spark, table, bench).collect()}
    assert got == {1: 1.0, 2: 31 / 40}


def test_alignment_against_full_table():
    rng = np.random.default_rng(4)
    for _ in range(30):
        a, b = rng.integers(0, 4, 9).astype(np.uint64), rng.integers(0, 4, 14).astype(np.uint64)
        h = np.zeros((10, 15), int)
        for i in range(1, 10):
            for j in range(1, 15):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


# --- 5 language model ---------------------------------------------------------------------------------------------


def test_katz(spark, docs, odd):
    table = both(docs, odd).withColumn("held_out", langid.held_out(7, 2))
    got = {r.doc_id: r for r in katz.lm_scores(spark, table).collect()}
    tokens = {d: [*words(t), "</s>"] for d, t in both(docs, odd).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    uni, bi = collections.Counter(), collections.Counter()
    for d, t in tokens.items():
        if not held[d]:
            uni.update(t)
            bi.update(zip(["</s>", *t[:-1]], t, strict=True))
    n, v = sum(uni.values()), len(uni)
    times = lambda c: [sum(x == k for x in c.values()) for k in range(1, 8)]
    ud, bd = katz.discounts(times(uni)), katz.discounts(times(bi))
    kept = lambda c, d: c * (d[c] if c <= 5 else 1)
    p = {w: kept(c, ud) / n for w, c in uni.items()}
    unknown = 1 - sum(p.values())
    after = collections.defaultdict(list)
    for (h, w), c in bi.items():
        after[h].append((w, c))
    back = {}
    for h, s in after.items():
        freed, over = sum(c - kept(c, bd) for _, c in s), uni[h]
        if freed <= 1e-9:
            freed, over = 1, over + 1
        back[h] = (freed / over / (1 - sum(p[w] for w, _ in s)), over)
        if uni[h] > 2000:  # the weights are exactly normalised; a few contexts are enough here
            total = sum(kept(c, bd) / over for _, c in s) + back[h][0] * (sum(q for w, q in p.items() if (h, w) not in bi) + unknown)
            assert total == pytest.approx(1)
    for d, t in tokens.items():
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t)
        score = sum(math.log10(kept(bi[h, w], bd) / back[h][1] if bi[h, w] else back.get(h, (1.0, 0))[0] * p.get(w, unknown)) for h, w in zip(["</s>", *t[:-1]], t, strict=True))
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(t), sum(uni[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_katz_without_training_or_rows(spark, odd):
    none = odd.select("doc_id", F.lit(True).alias("held_out"), "text")
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in katz.lm_scores(spark, none).collect())
    assert katz.lm_scores(spark, none.limit(0)).count() == 0


# --- 6 language ---------------------------------------------------------------------------------------------------


def test_language(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.languages(spark, docs.select("doc_id", "lang", "text"), PIECES).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    model = langid.fit(spark, docs.select("text", "lang"), PIECES)
    rows = {r.doc_id: r for r in langid.predict(spark, odd.select("doc_id", "text"), model).collect()}
    for i, t in enumerate(ODD):
        assert (rows[1000 + i].lang_pred == "und") == (not re.search(r"[^\W\d_]", t or ""))


def test_language_without_labels(spark, odd):
    assert langid.fit(spark, odd.select("text", F.lit(None).cast("string").alias("lang")), PIECES) is None
    assert {r.lang_pred for r in langid.predict(spark, odd.select("doc_id", "text"), None).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    import pyarrow as pa

    pieces = langid.Pieces(sorted({" ", "a", "b", "ab", "ba", " a"}))
    chance = np.linspace(0.1, 0.3, pieces.n)[:, None]
    model = langid.Model(["x"], pieces, chance)
    p = dict(zip(pieces.pieces, chance[:, 0], strict=True))

    def total(s):
        return 1.0 if not s else langid.UNKNOWN * total(s[1:]) + sum(p[s[:k]] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in p)

    for w in ("abba", "b", "abab" * 20, "azb"):
        assert model.log_chance(pa.array([w]))[0, 0] == pytest.approx(math.log(total_long(w, p)) if len(w) > 20 else math.log(total(" " + w)))


def total_long(w, p):
    s = " " + w
    ways = [1.0]
    for end in range(1, len(s) + 1):
        ways.append(langid.UNKNOWN * ways[-1] + sum(p[s[k:end]] * ways[k] for k in range(max(0, end - 3), end) if s[k:end] in p))
    return ways[-1]


# --- 7 licences ---------------------------------------------------------------------------------------------------


def test_licences(spark, docs, odd):
    def grams(t):
        w = [x for x in (re.sub(r"^[\W_]+|[\W_]+$", "", y.lower()) for y in words(t)) if x]
        return {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()

    templates = [(n, grams(t)) for n, ts in licences.NOTICES.items() for t in ts]
    expected = {}
    for d, t in both(docs, odd).collect():
        lines = (t or "").split("\n")
        for k, unit in [*enumerate(lines), *([(-1, t)] if len(lines) > 1 else [])]:
            g = grams(unit)
            best = max((2 * len(g & s) / (len(g) + len(s)) for _, s in templates), default=0) if g else 0
            if best >= 0.8 - 1e-12:
                expected[d, k] = best
    got = {(r.doc_id, r.line): r.score for r in licences.licences(both(docs, odd)).collect()}
    assert got == pytest.approx(expected)
    edited = spark.createDataFrame([(1, "RELEASED under the MIT licence, yes\n \nLicensed under the Apache License (Version 2.0)")], "doc_id long, text string")
    assert {r.licence for r in licences.licences(edited).collect()} == {"Apache-2.0"}


def test_licences_wrapped_beside_other_words_and_repeated(spark):
    import textwrap

    mit = "\n".join(textwrap.wrap("MIT License Copyright (c) 2024 Foo " + licences.NOTICES["MIT"][-1], 72))
    apache = licences.NOTICES["Apache-2.0"][1]
    texts = [
        "import os\n" + mit + "\nand code",
        "Copyright 2024 Foo. Licensed under the MIT License.",
        "\n".join(f"# {x}" for x in ["file.py, a module of a package", *textwrap.wrap(apache, 40), "more words of other things"]),
        "a text\nof the software that is licensed under the terms of other words",
        "Released under the MIT License. " * 60,
        "Permission is hereby granted to nobody, and this work is licensed under no licence.",
    ]
    got = licences.licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.licence) for r in got} == {(0, "MIT"), (1, "MIT"), (2, "Apache-2.0"), (4, "MIT")}
    assert {(r.doc_id, r.line) for r in got if r.doc_id in (1, 2)} == {(1, 0), (2, 1)}
    assert [r.score for r in got if r.doc_id == 1] == [1.0]


# --- 8 personal data ----------------------------------------------------------------------------------------------

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(n - 9 if n > 9 else n for n in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0


def base(text):
    out = []
    for k, (name, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            bad = (name == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (name == "card" and not (14 <= len(digits) <= 19 and luhn(digits))) or (name == "phone" and not 10 <= len(digits) <= 15)
            if not bad:
                out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(out)]


def test_personal_data(spark, docs, odd):
    more = ["a@b.c_d@e.f", "a@b.c@d.e x@y", "..%+a@b-.c-. é😀 q@w.e.r.t 😀 1.2.3.4.5.6.7.8 01.002.255.256 1.2.3.0004", "4111 1111 1111 1111-", "+1 (234) 567-8901) +12+3456789012 ++1234567890123 +1", "1" * 400 + " " + "a" * 3000 + "@", "a@" + "b." * 5000 + "c", "@" * 50 + "a.b@c.d", "10.0.0.1" * 20]
    table = both(docs, odd).union(spark.createDataFrame([(2000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    got = {r.doc_id: r for r in pii.personal_data(spark, table).collect()}
    for d, t in table.collect():
        spans = base(t)
        assert got[d].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in KINDS] == [sum(s.startswith(k) for s in spans) for k in KINDS]
        assert set(spans) <= set(got[d].spans.split(",")) | {""}


def test_personal_data_accepts_candidates(spark):
    texts = ["mail bob [at] host [dot] com now", "call (949) 555-3739 today", "order 1234-5678-9012 shipped", "version 12.3456.7890 out", "nothing here 2024"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(spark, table).collect()}
    assert got[0].startswith("email:5:") and got[1] == "phone:5:19" and got[2] == got[3] == got[4] == ""


# --- 9 sharding ---------------------------------------------------------------------------------------------------


def test_sharding(spark, docs, odd):
    table = both(docs, odd).union(spark.createDataFrame([(3000 + i, "hot group") for i in range(900)], "doc_id long, text string"))
    rows = sharding.shard_rows(spark, table, shards=5, cell=50).collect()
    text = dict(table.collect())
    assert len(rows) == len(text)
    by, of_text = collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        by[r.shard].append(r.slot)
        of_text[raw].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and all(len(s) == 1 for s in of_text.values())
    assert sharding.shard_rows(spark, table.limit(0)).count() == 0


def test_minimax_against_brute_force():
    import itertools

    rng = np.random.default_rng(6)
    for _ in range(60):
        sizes = rng.integers(0, 12, rng.integers(1, 9)).tolist()
        k = int(rng.integers(1, 5))
        capacity, cuts = sharding.minimax(sizes, k)
        best = min(max(sum(sizes[a:b]) for a, b in itertools.pairwise((0, *c, len(sizes)))) for c in itertools.combinations_with_replacement(range(len(sizes) + 1), k - 1))
        assert capacity == best and len(cuts) == k


# --- 10 near duplicates -------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = frozenset([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])
    ids = sorted(sets)
    links = [(a, b) for i, b in enumerate(ids) for a in ids[:i] if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    return components(ids, links), sets


def test_near_duplicates(spark, docs, odd):
    rng, rows = np.random.default_rng(8), []
    stem = [f"w{i}" for i in range(300)]
    for i in range(60):  # a chain and a cloud of copies with some edits each
        w = list(stem)
        for j in rng.choice(300, rng.integers(0, 8), replace=False):
            w[j] = f"e{i}x{j}"
        rows.append((5000 + i, " ".join(w)))
    table = both(docs, odd).union(spark.createDataFrame(rows, "doc_id long, text string"))
    root, sets = brute_components(table.collect())
    got = neardup.near_duplicates(spark, table).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {d: (len(sets[d]), root[d], root[d] == d) for d in root}
    assert neardup.near_duplicates(spark, table.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 80, (40, 2))] + [(300 + i, 301 + i) for i in range(8)] + [(999, 999)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    expected = components(nodes, [e for e in edges if e[0] != e[1]])
    table = spark.createDataFrame(edges, "u long, v long")
    for f in (star_components, union_find):
        assert {r.node: r.root for r in f(table, Scratch(spark)).collect()} == expected
        assert f(table.limit(0), Scratch(spark)).count() == 0


def _shuffled_in(spark, monkeypatch, f):
    """Names of what ``f`` writes to scratch, and its result."""
    names, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: names.append(name) or write(self, df, name))
    return names, f()


def test_band_keys_and_tokens_are_dealt_in_parts(spark, monkeypatch):
    from corpuscle.llm import components

    rng = np.random.default_rng(8)
    sets = [(i, t) for i in range(30) for t in (rng.permutation(40)[:25] - 20).tolist()]  # negative tokens too
    table = spark.createDataFrame([(i, t, 25) for i, t in sets], "node long, token long, n long")
    pairs = lambda parts: sorted(map(tuple, components.prefix_pairs(table, None, 0.5, Scratch(spark), parts=parts).collect()))
    names, split = _shuffled_in(spark, monkeypatch, lambda: pairs(3))
    assert names == ["tokens"] + ["common"] * 3 + ["prefixes"] * 3
    of = {i: {t for j, t in sets if j == i} for i in range(30)}
    linked = {(i, j) for i in of for j in of if i < j and 2 * len(of[i] & of[j]) >= len(of[i] | of[j])}
    assert split == pairs(1) and linked and linked <= set(split)
    docs = spark.createDataFrame([(i, f"a common line that many of the documents have, number {i % 2}\nline {i}") for i in range(8)], "doc_id long, text string")
    names, rows = _shuffled_in(spark, monkeypatch, lambda: linededup.duplicate_lines(spark, docs).collect())
    assert names.count("buckets") == linededup.PARTS > 1 and sum(r.n_removed for r in rows) >= 6


def test_lines_are_grouped_before_their_keys_are_made(spark, monkeypatch):
    """Equal lines have their keys made once, buckets are counted without a join, and no text is split again to be compared."""
    line = "a line which is the same in each of the documents but for its number, "
    docs = spark.createDataFrame([(i, "\n".join(line + str(k % 3) for k in range(5)) + f"\n{i} other") for i in range(20)], "doc_id long, text string")
    plans, rows, write = {}, {}, Scratch.write

    def noted(self, df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().sparkPlan().toString())
        out = write(self, df, name)
        rows.setdefault(name, []).append(out.collect())
        return out

    monkeypatch.setattr(Scratch, "write", noted)
    got = linededup.duplicate_lines(spark, docs).collect()
    assert all("Join" not in p for p in plans["buckets"]) and all("split(" not in p for p in plans["texts"])
    sizes = collections.Counter(r.band for t in rows["buckets"] for r in t)
    assert sizes and all(r.n == sizes[r.band] > 1 for t in rows["buckets"] for r in t)
    assert len(rows["keyed"][0]) == 23 and {r.norm for t in rows["texts"] for r in t} >= {line + str(k) for k in range(3)}
    gone = brute_lines([tuple(r) for r in docs.collect()])
    assert {r.doc_id: r.n_removed for r in got} == {d: sum(d == x for x, _ in gone) for d in range(20)}


def test_only_first_tokens_of_lines_become_rows(spark, monkeypatch):
    from corpuscle.llm import components

    rng = np.random.default_rng(10)
    tokens, of = rng.integers(-(1 << 62), 1 << 62, 300).tolist(), {}
    for i in range(0, 160, 4):
        base = rng.choice(tokens, rng.integers(3, 40), replace=False).tolist()
        for j in range(4):
            of[i + j] = set(base[rng.integers(0, 3) :]) | set(rng.choice(tokens, rng.integers(0, 4)).tolist())
    root = {i: i - i % 4 if i % 8 < 2 else i for i in of}
    near = {(i, j) for i in of for j in of if i < j and root[i] != root[j] and 5 * len(of[i] & of[j]) >= 4 * len(of[i] | of[j])}
    table = spark.createDataFrame([(i, sorted(x)) for i, x in of.items()], "node long, x array<long>")
    roots = spark.createDataFrame([(i, r) for i, r in root.items() if i % 8 < 2], "node long, root long")
    sketches = linededup.sketches_of(table.toDF("h", "x")).drop("n").withColumnRenamed("h", "node")
    kept, write = {}, Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: kept.setdefault(name, []).append(write(self, df, name)) or kept[name][-1])
    monkeypatch.setattr(Scratch, "drop", lambda self, *tables: None)
    monkeypatch.setattr(components, "PART_ROWS", 200)
    for size in (1 << 15, 20):  # also with an order from a few sets
        monkeypatch.setattr(components, "ORDER_SETS", size)
        kept.clear()
        assert near and near <= {tuple(r) for r in components.ranked_pairs(table, roots, 0.8, Scratch(spark), sketches).collect()}
        rows = {r.node: len(r["first"]) for r in kept["prefixes"][0].collect()}
        assert rows == {i: len(x) - math.ceil(0.8 * len(x) - 1e-6) + 1 for i, x in of.items()}
        assert len(kept["met"]) == math.ceil(sum(rows.values()) / 200) > 3
    alike = spark.createDataFrame([(i, list(range(350)) + [1000 * i + 1000 + k for k in range(45)]) for i in range(12)], "node long, x array<long>").select("node", F.transform("x", lambda t: F.xxhash64(t)).alias("x"))
    sketches = linededup.sketches_of(alike.toDF("h", "x")).drop("n").withColumnRenamed("h", "node")
    kept.clear()
    components.ranked_pairs(alike, None, 0.79, Scratch(spark), sketches).count()
    rows = [r.c for t in kept["met"] for r in t.collect()]
    assert len(rows) > 30 and sum(rows) < 3 * len(rows)  # pairs below the threshold meet at one of their 35 common first tokens
    head = "many different lines begin with these very words, of which each of them then goes its own way: "
    docs = spark.createDataFrame([(i, head + f"{rng.integers(1 << 60):015x}") for i in range(120)], "doc_id long, text string")  # buckets of more than 16
    kept.clear()
    assert linededup.duplicate_lines(spark, docs).agg(F.sum("n_removed")).first()[0] == 0
    assert "met" in kept and "tokens" not in kept


def test_long_pairs_meet_at_one_token(spark, monkeypatch):
    """Pairs with more shingles than a sketch has cells meet once too, and the sample is made once for each set."""
    kept, write = {}, Scratch.write

    def noted(self, df, name):
        kept.setdefault(name, []).append(write(self, df, name))
        return kept[name][-1]

    monkeypatch.setattr(Scratch, "write", noted)
    sets = [(i, list(range(610)) + [1000 * i + 1000 + k for k in range(82)]) for i in range(10)] + [(i, list(range(90000, 90700)) + [1000 * i + k for k in range(9)]) for i in (20, 21)]
    table = spark.createDataFrame(sets, "node long, x array<long>").select("node", F.transform("x", lambda t: F.xxhash64(t)).alias("x"))
    sketches = linededup.sketches_of(table.toDF("h", "x")).drop("n").withColumnRenamed("h", "node")
    found = {tuple(r) for r in ranked_pairs(table, None, 0.79, Scratch(spark), sketches).collect()}
    rows = [r.c for t in kept["met"] for r in t.collect()]
    assert (20, 21) in found and len(rows) > 20 and sum(rows) < 3 * len(rows)  # one of 64 common first tokens
    assert {"sample", "end"} <= set(kept["prefixes"][0].columns)


def test_open_buckets_are_kept_without_a_join(spark, monkeypatch):
    """Buckets of one component close, those of several stay whole; later rounds join only the new links."""
    plans, kept, write = [], {}, Scratch.write

    def noted(self, df, name):
        if name == "open":
            plans.append(df._jdf.queryExecution().sparkPlan().toString())
        kept.setdefault(name, []).append((out := write(self, df, name)).collect())
        return out

    monkeypatch.setattr(Scratch, "write", noted)
    buckets = spark.createDataFrame([(1, i) for i in range(40)] + [(2, i) for i in range(100, 140)], "band long, node long")
    # band 2: two halves, of which its centre links one
    linked = lambda pairs, name: pairs.where("b < 40 or (b >= 100 and floor(a / 20) = floor(b / 20))")
    sets = lambda nodes: nodes.select("node", F.lit(1).cast("long").alias("token"), F.lit(1).cast("long").alias("n"))
    given = []

    def counted(edges, scratch):
        given.append(edges.count())
        return union_find(edges, scratch)

    roots = link_buckets(buckets, linked, sets, 0.8, Scratch(spark), counted)
    assert {(r.node, r.root) for r in roots.collect()} == {(i, 0) for i in range(40)} | {(i, 100 + 20 * (i >= 120)) for i in range(100, 140)}
    assert sorted((r.band, r.node) for r in kept["open"][1]) == [(2, i) for i in range(100, 140)]
    assert len(plans) > 1 and all("Join" not in p.split("Window")[0] and "LeftSemi" not in p for p in plans[1:])
    assert len(given) > 1 and given == [n for n in map(len, kept["links"]) if n]


def test_runs_are_hashed_from_their_elements(spark):
    """The keys are those of the hashed slices of the circle, without a copy of it for each."""
    lines = spark.createDataFrame([(" ".join(f"{i * k % 97}word" for k in range(1, n)),) for i, n in enumerate((2, 3, 4, 6, 9, 15, 40, 90), 3)] + [("a",), ("abcdef",), ("aaaaaaaaaaa",)], "norm string")
    for hashes in (linededup._shingles("norm"), f"slice({linededup._shingles('norm')}, 1, 7)"):
        now = linededup._runs(hashes)
        sliced = now
        for rows in (linededup.ROWS, linededup.FEW_ROWS):
            sliced = sliced.replace(f"xxhash64({rows}, {', '.join(f'get(w, p + {k})' for k in range(rows))})", f"xxhash64({rows}, slice(w, cast(p as int) + 1, {rows}))")
        assert sliced != now and "slice(w" not in now
        assert all(r.a and r.a == r.b for r in lines.select(F.expr(now).alias("a"), F.expr(sliced).alias("b")).collect())
