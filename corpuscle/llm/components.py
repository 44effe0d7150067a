"""Connected components of an edge table, by DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is either the centre of edges (v) or the end of a single one (u)."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def star_components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node, by alternating large-star and small-star.

    ``edges``: u, v (long), in any direction, repeats and loops allowed. Returns node, root for every node that has
    an edge to another. Each step is an aggregation (a minimum for each node, combined before the shuffle) and one
    equi-join, which Spark splits where a node has very many edges. Rounds go on until the edges are stars around the
    smallest nodes, which neither step changes; there are O(log^2 n) of them.
    """
    now = scratch.write(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        if _are_stars(now):
            break
        # large-star: link the larger neighbours of each node to the smallest of its closed neighbourhood
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small-star: link the smaller neighbours of each node, and itself, to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.write(small, "stars")
        scratch.drop(now)
        now = new
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def union_find(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node, by a distributed union-find.

    Every node points at a parent. A round hooks the root of each tree to the smallest root that an edge joins it to,
    halves the paths by pointer jumping until all trees are flat, and renames the edges by their roots; edges inside
    a tree go. Trees only grow, so rounds are O(log n). Arguments and result: see :func:`star_components`.
    """
    left = scratch.write(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    tree = scratch.write(left.select("u").union(left.select("v")).distinct().select(F.col("u").alias("node"), F.col("u").alias("root")), "tree")
    for _ in range(rounds):
        if left.isEmpty():
            return tree
        hooks = scratch.write(left.groupBy(F.col("u").alias("r")).agg(F.min("v").alias("p")), "hooks")
        while True:  # pointer jumping among the roots that were hooked
            up = hooks.select(F.col("r").alias("p"), F.col("p").alias("q"))
            jumped = scratch.write(hooks.join(up, "p", "left").select("r", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "hooks")
            scratch.drop(hooks)
            hooks = jumped
            if hooks.where("moved").isEmpty():
                break
        flat = hooks.select("r", "p")
        new_tree = scratch.write(tree.join(flat, tree.root == flat.r, "left").select("node", F.coalesce("p", "root").alias("root")), "tree")
        a = left.join(flat.select(F.col("r").alias("u"), F.col("p").alias("pu")), "u", "left").select(F.coalesce("pu", "u").alias("u"), "v")
        b = a.join(flat.select(F.col("r").alias("v"), F.col("p").alias("pv")), "v", "left").select("u", F.coalesce("pv", "v").alias("v"))
        new_left = scratch.write(b.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        scratch.drop(hooks, tree, left)
        tree, left = new_tree, new_left
    raise RuntimeError(f"components have not settled in {rounds} rounds")


#: Smallest ones of its first tokens that a set carries through the prefix join.
SAMPLE = 8


def prefix_pairs(sets: DataFrame, roots: DataFrame | None, similarity: float, scratch: Scratch, sketches: DataFrame | None = None, parts: int = 1) -> DataFrame:
    """All pairs (a, b), a < b, of sets in different components that can reach a Jaccard coefficient of ``similarity``.

    ``sets``: node, token, n (long; n: the size of the node's whole set, tokens without repeats); ``roots``: node, root.
    An exact prefix-filter join. Tokens are ordered by how many of the sets hold them, rarest first. Two sets of m and
    n >= m tokens at the coefficient t share t / (1 + t) * (m + n) of them at least, so t * n <= m, and one of the first
    n - t * n + 1 tokens of both is common. What they share is at most those of their first tokens that are common, and
    all later tokens of the set whose first tokens end earlier; pairs that can't reach the bound so are left out. Tokens
    of one component alone are counted, not joined, so what a set has for itself rules it out first. Of the sets that
    hold a token, those of its main component are joined with the others only, not with one another.

    ``sketches`` (node, and words p0, p1, ... of parity sketches) adds the bitmap filter of exact similarity joins: sets
    differ by at least as many tokens as their sketches by bits, so the join meets no pair whose sketches differ by more
    than sets that share enough can. Where the sketches have a cell for each token of two sets, they tell the pair well
    enough without a count of common tokens: two sets that have one in common among the SAMPLE smallest (by value, a hash)
    of their first tokens meet at the smallest such token alone, so that the pair makes one row however much it shares.
    Other pairs meet at each common token.

    With ``parts`` above 1, tokens are counted and sets are ranked in so many parts, one after another, so that the
    shuffle files of one part are there at a time; every token and every set is in one part, so the pairs are the same.
    """
    least = F.lit(similarity)
    if roots is not None:
        rooted = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    else:
        rooted = sets.withColumn("root", F.col("node"))
    if parts > 1:
        rooted = scratch.write(rooted, "tokens")

    def in_parts(of: DataFrame, key: str, f: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
        return scratch.together([scratch.write(f(of.where(F.pmod(key, F.lit(parts)) == k)), name) for k in range(parts)])

    def held_by_two(rows: DataFrame) -> DataFrame:
        # only what sets of two components hold counts; of two components, one at least is not the token's main one
        by_root = rows.groupBy("token", "root").agg(F.count("*").alias("sets"))
        tokens = by_root.groupBy("token").agg(F.sum("sets").alias("held"), F.max_by("root", F.struct("sets", "root")).alias("most"), F.count("*").alias("roots"))
        return rows.join(tokens.where("roots > 1").select("token", "held", "most"), "token")

    words = [c for c in sketches.columns if c != "node"] if sketches is not None else []

    def first_tokens(common: DataFrame) -> DataFrame:
        # what a set shares with all sets of other components is a bound on what it shares with one
        own = common.groupBy("node", "n").agg(F.count("*").alias("shared")).where(F.col("shared") >= F.ceil(least * F.col("n") - 1e-6))
        able = common.join(own.select("node", "shared"), "node")
        place = F.row_number().over(Window.partitionBy("node").orderBy("held", "token")) - 1 + F.col("n") - F.col("shared")
        last = F.col("n") - F.ceil(least * F.col("n") - 1e-6)
        ranked = able.withColumn("place", place).where(F.col("place") <= last)
        ends = ranked.groupBy("node").agg(F.max(F.struct("held", "token")).alias("end"), F.slice(F.sort_array(F.collect_list("token")), 1, SAMPLE).alias("sample"))
        firsts = ranked.select("token", "node", "n", "shared", "root", "most").join(ends, "node")
        if words:
            firsts = firsts.join(sketches, "node")
        return firsts.select("token", "node", "n", "shared", "end", "sample", "root", "most", *words)

    if parts > 1:
        common = in_parts(rooted, "token", held_by_two, "common")
        scratch.drop(rooted)
        firsts = in_parts(common, "node", first_tokens, "prefixes")
    else:
        firsts = scratch.write(first_tokens(held_by_two(rooted)), "prefixes")
    x, y = firsts.where("root <> most").alias("x"), firsts.alias("y")
    needed = F.ceil(least / (1 + least) * (F.col("x.n") + F.col("y.n")) - 1e-6)
    sizes = (F.least("x.n", "y.n") >= least * F.greatest("x.n", "y.n") - 1e-6) & (F.least("x.shared", "y.shared") >= needed)
    if words:
        apart = sum((F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in words), F.lit(0))
        sizes = sizes & (apart <= F.col("x.n") + F.col("y.n") - 2 * needed)
    both = F.array_intersect("x.sample", "y.sample")
    once = (F.size(both) > 0) & (F.col("x.n") + F.col("y.n") <= 64 * len(words))
    sizes = sizes & (~once | (F.get(both, F.lit(0)) == F.col("x.token")))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & ((F.col("x.node") < F.col("y.node")) | (F.col("y.root") == F.col("y.most"))) & sizes)
    shorter = F.when(F.col("x.end") <= F.col("y.end"), F.col("x.n")).otherwise(F.col("y.n"))
    later = F.ceil(least * shorter - 1e-6) - 1
    met = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), F.when(once, 1).otherwise(needed - later).alias("least"))
    return met.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("least").alias("least")).where("c >= least").select("a", "b")


#: Elements of two sets, for each cell of a sketch, up to which the sketches tell the pair well enough: at so many, those let by at 0.8 reach 0.69.
TOLD = 3
#: Sets by whose tokens the order of :func:`ranked_pairs` is made, cells that count them, rows of first tokens in a part.
ORDER_SETS, CELLS, PART_ROWS = 1 << 15, 1 << 16, 1 << 23


def ranked_pairs(sets: DataFrame, roots: DataFrame | None, similarity: float, scratch: Scratch, sketches: DataFrame, parts: int = 1) -> DataFrame:
    """The pairs of :func:`prefix_pairs`, and maybe more that share enough first tokens, of ``sets`` as arrays: node, x.

    A prefix-filter join is exact under any one order of the tokens, so an estimate of how often they occur orders them:
    tokens of ORDER_SETS sets at most are counted in CELLS cells by hash, and a token's place is its cell's rank, then its
    hash. So each set finds its first tokens by itself, and only these, of n tokens n - t * n + 1, are ever rows: neither
    all tokens of all sets nor their counts are shuffled. All sets take part in the join. The bounds, the main component
    of a token and the sampled meeting token are those of :func:`prefix_pairs`, but for the bound by shared tokens; pairs
    of up to TOLD elements a cell of the sketches meet at the sampled token alone. What it needs is with the set, made once.

    First tokens are joined in ``parts`` parts at least, and in more where they are many, one after another; what a pair
    shares in each is added up.
    """
    least = F.lit(similarity)
    share = min(1.0, ORDER_SETS / max(1, sets.select("node").count()))
    some = sets.where(F.pmod(F.xxhash64("node", F.lit(CELLS)), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20))))
    rank = bytearray(CELLS)
    for cell, n in some.select(F.explode("x").alias("token")).groupBy(F.col("token").bitwiseAND(CELLS - 1).alias("cell")).count().collect():
        rank[cell] = min(127, int(4 * math.log2(1 + n)))  # an ASCII character
    table = F.lit(bytes(rank))
    of = lambda t: F.ascii(F.substring(table, t.bitwiseAND(CELLS - 1).cast("int") + 1, 1)).cast("long")
    key = F.transform("x", lambda t: F.shiftleft(of(t), 56).bitwiseOR(F.shiftrightunsigned(t, 8)))
    n = F.size("x").cast("long")
    first = F.slice(F.sort_array(key), 1, (n - F.ceil(least * n - 1e-6) + 1).cast("int"))
    own = sets.where(F.size("x") > 0).select("node", n.alias("n"), first.alias("first")).join(sketches, "node")
    if roots is not None:
        own = own.join(roots, "node", "left")
    sample = F.slice(F.sort_array(F.transform("first", lambda t: F.xxhash64(t))), 1, SAMPLE)  # another order than that of first tokens
    own = own.withColumns({"sample": sample, "end": F.element_at("first", -1), "lo": F.ceil(least * F.col("n") - 1e-6)})
    prefixes = scratch.write(own.withColumn("root", F.coalesce("root", "node") if roots is not None else F.col("node")), "prefixes")
    words = [c for c in sketches.columns if c != "node"]
    parts = max(parts, math.ceil((prefixes.agg(F.sum(F.size("first"))).first()[0] or 0) / PART_ROWS))
    mets = []
    for k in range(parts):
        token = F.explode(F.expr(f"filter(first, t -> pmod(t, {parts}) = {k})")).alias("token")
        by_root = prefixes.select("root", token).groupBy("token", "root").agg(F.count("*").alias("sets"))
        tokens = by_root.groupBy("token").agg(F.max_by("root", F.struct("sets", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1").select("token", "most")
        firsts = prefixes.select(token, "node", "n", "lo", "root", "end", "sample", *words).join(tokens, "token")
        x, y = firsts.where("root <> most").alias("x"), firsts.alias("y")
        # rows that meet are many, so the condition is kept short: the JVM compiles no very long method
        total = F.col("x.n") + F.col("y.n")
        apart = sum((F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in words), F.lit(0))
        sizes = (F.col("x.lo") <= F.col("y.n")) & (F.col("y.lo") <= F.col("x.n")) & (apart <= total * F.lit((1 - similarity) / (1 + similarity)) + 1e-6)
        told, meets = total <= TOLD * 64 * len(words), F.get(F.array_intersect("x.sample", "y.sample"), F.lit(0))
        sizes = sizes & (~told | F.coalesce(meets == F.xxhash64("x.token"), F.lit(True)))
        met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & ((F.col("x.node") < F.col("y.node")) | (F.col("y.root") == F.col("y.most"))) & sizes)
        needed = F.ceil(least / (1 + least) * total - 1e-6)
        shorter = F.when(F.col("x.end") <= F.col("y.end"), F.col("x.n")).otherwise(F.col("y.n"))
        later = F.ceil(least * shorter - 1e-6) - 1
        met = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), F.when(told & meets.isNotNull(), 1).otherwise(needed - later).alias("least"))
        mets.append(scratch.write(met.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("least").alias("least")), "met"))
    scratch.drop(prefixes)
    return scratch.together(mets).groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("least").alias("least")).where("c >= least").select("a", "b")


def joined(roots: DataFrame, edges: DataFrame, components: Callable[[DataFrame, Scratch], DataFrame], scratch: Scratch) -> DataFrame:
    """``roots`` (node, root) after more ``edges``: only these, between the roots of their ends, go to ``components``."""
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
    ends = edges.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    new = components(ends, scratch)
    moved = roots.join(new.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return scratch.write(moved.union(new.join(roots, "node", "left_anti").select("node", "root")), "roots")


def link_buckets(
    buckets: DataFrame, linked: Callable[[DataFrame, str], DataFrame], sets: Callable[[DataFrame], DataFrame], similarity: float, scratch: Scratch,
    components: Callable[[DataFrame, Scratch], DataFrame] = star_components, rounds: int = 3, few: int = 16, centres: int = 8,
    sketches: DataFrame | None = None, parts: int = 1,
) -> DataFrame:
    """Components of the links inside buckets (band, node; n, a bucket's members, where it is known), without all pairs of a large bucket: node, root.

    ``linked`` verifies pairs (a, b), a < b, and returns those that are linked; ``sets`` gives node, token, n of a table
    of nodes, for :func:`prefix_pairs`, or node, x, for :func:`ranked_pairs`; ``sketches`` their parity sketches, which
    the latter needs; ``parts`` is that of both. A bucket of ``few`` members at most pairs them all, so at most (few - 1) / 2 pairs for each. A larger one
    pairs its most central member, the one that shares most buckets with most others, with the rest; then each round the
    most central one of each of ``centres`` random parts with those of other components, until a round finds no link or
    ``rounds`` are over. The members of larger buckets that still hold several
    components then go to one of these joins, which gives all of their pairs that can be linked. So any two members of
    a bucket are in one component, or have been compared, or can't reach ``similarity``; no pair is dropped for cost.
    A node's root is looked up once for all of its larger buckets, which lie beside it in an array. Centres are found by a
    window, and a node's pairs with them are rows once, not once for each bucket that both are in.
    """
    sized = buckets if "n" in buckets.columns else buckets.join(buckets.groupBy("band").agg(F.count("*").alias("n")), "band")
    small = sized.where(F.col("n") <= few)
    large = sized.where(F.col("n") > few)
    live = large.groupBy("node").agg(F.sum("n").alias("weight"), F.collect_list("band").alias("bands"))
    x, y = small.select("band", F.col("node").alias("a")), small.select("band", F.col("node").alias("b"))
    inside = x.join(y, "band").where("a < b").select("a", "b")
    tried = roots = written = None
    idle = False
    for n in range(rounds + 1):
        rooted = live.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")) if roots is not None else live.withColumn("root", F.col("node"))
        live = rooted.select(F.explode("bands").alias("band"), "node", "weight", "root")
        last = n == rounds or idle
        bucket = Window.partitionBy("band")
        over = {"p": F.min("root").over(bucket), "q": F.max("root").over(bucket)} if roots is not None else {}  # a bucket of one component stays one
        if not last:
            slot = F.pmod(F.xxhash64("node", F.lit(n)), F.lit(centres if n else 1))
            central = [F.max_by(F.struct("node", "root"), F.when(slot == k, F.struct("weight", "node"))).over(bucket) for k in range(centres if n else 1)]
            over["heads"] = F.array(*central)
        live = live.withColumns(over)
        if roots is not None:
            live = live.where("p <> q").drop("p", "q")
        if not last:
            live = live.withColumn("heads", F.expr("transform(filter(heads, c -> c.root <> root), c -> c.node)"))
        live, before = scratch.write(live, "open"), written
        if before is not None:
            scratch.drop(before)
        written = live
        if n and live.isEmpty():
            break
        if last:
            of = sets(live.select("node").distinct())
            pairs = (ranked_pairs if "x" in of.columns else prefix_pairs)(of, roots, similarity, scratch, sketches, parts)
        else:
            # a node meets a centre once, however many buckets they share
            of = live.where(F.size("heads") > 0).groupBy("node").agg(F.array_distinct(F.flatten(F.collect_set("heads"))).alias("heads"))
            pairs = of.select("node", F.explode("heads").alias("c")).select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b"))
            pairs = (pairs.union(inside) if n == 0 else pairs).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch.write(pairs, "pairs")
        found = scratch.write(linked(pairs, f"round{n}"), "links")
        tried = pairs if tried is None else tried.union(pairs)
        idle = found.isEmpty()
        if not idle:
            edges = found.select(F.col("a").alias("u"), F.col("b").alias("v"))
            roots = components(edges, scratch) if roots is None else joined(roots, edges, components, scratch)
        if last:
            break
        live = live.groupBy("node", "weight").agg(F.collect_list("band").alias("bands"))
    if roots is None:
        roots = buckets.select("node", F.col("node").alias("root")).limit(0)
    return roots
