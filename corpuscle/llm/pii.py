"""Personal data: exact patterns, and wider candidates that boosted trees accept. DataFrame and SQL functions only."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import take

KINDS = ("email", "ip", "card", "phone")

# The kinds' patterns, for Java. Possessive repeats match the same as plain ones here, as what follows a repeat can't be
# part of it, and are walked without recursion; the look-behinds only skip starts inside a run that has failed as a whole.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "contains(text, '@')", "ip": "text rlike '[0-9]'", "card": "text rlike '[0-9]'", "phone": "contains(text, '+')"}

# Generators of candidates: high recall, overlapping with the patterns and with one another.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\[dot\]|\(dot\)|\{dot\})\x20?[A-Za-z0-9-]{2,63}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.])[0-9]{4}(?:[._/\x20-]{1,2}[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[0-9]{1,3}[\x20.-])?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20./-][0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])",
}
GENERATOR_NEEDS = {"email": "text rlike '@|[\\\\[({]at[\\\\])}]'", "ip": "contains(text, ':')", "card": "text rlike '[0-9]'", "phone": "text rlike '[0-9]'"}

FEATURES = ("kind", "digits", "size", "luhn", "paren", "key", "other", "before", "after", "marks", "zeros", "groups")
KEYS = r"tel|phone|call|fax|mobile|cell|mail|contact|card|visa|master|amex|pay|credit|host|addr|ipv6|server|write to|reach"
OTHERS = r"order|invoice|version|isbn|build|serial|ref|part|sku|ticket|hash|token|score|total|date|time|page|lot|batch"


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _spans(pattern: str, needs: str) -> str:
    """Matches with their places: array of (start, end, m), in code points, end exclusive.

    Places follow from the lengths of the matches and of the pieces between them.
    """
    empty = "cast(array() as array<struct<start: bigint, end: bigint, m: string>>)"
    add = "named_struct('at', acc.at + length(get(parts, i)) + length(get(found, i)), 'out', array_append(acc.out, named_struct('start', acc.at + length(get(parts, i)), 'end', acc.at + length(get(parts, i)) + length(get(found, i)), 'm', get(found, i))))"
    walk = f"aggregate(sequence(0, size(found) - 1), named_struct('at', 0L, 'out', {empty}), (acc, i) -> {add}, acc -> acc.out)"
    split = _let(f"split(text, {_quote(pattern)}, -1)", "parts", walk)
    return f"if({needs}, {_let(f'regexp_extract_all(text, {_quote(pattern)}, 0)', 'found', f'if(size(found) = 0, {empty}, {split})')}, {empty})"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(m: str) -> str:
    """Whether the digits of ``m`` pass the Luhn check."""
    two = "if(n > 9, n - 9, n)"
    term = _let("cast(substring(d, length(d) - i, 1) as int) * (1 + i % 2)", "n", two)
    return _let(_digits(m), "d", f"aggregate(sequence(0, length(d) - 1), 0, (t, i) -> t + {term}) % 10 = 0")


VALID = {
    "email": "true",
    "ip": "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', right(p, 3)) as int) <= 255)",
    "card": f"if(length({_digits('x.m')}) between 14 and 19, {_luhn('x.m')}, false)",
    "phone": f"length({_digits('x.m')}) between 10 and 15",
}


def base_spans() -> F.Column:
    """Valid matches of the patterns: array of (start, kind, end), by start, then kind."""
    each = [f"transform(filter({_spans(PATTERNS[k], NEEDS[k])}, x -> {VALID[k]}), x -> named_struct('start', x.start, 'kind', {i}, 'end', x.end))" for i, k in enumerate(KINDS)]
    return F.expr(f"array_sort(concat({', '.join(each)}))")


def candidates() -> F.Column:
    """Proposed spans with their features: array of (start, kind, end, features...)."""
    each = []
    for i, k in enumerate(KINDS):
        before, after = "lower(substring(text, cast(greatest(1, x.start - 23) as int), cast(least(24, x.start) as int)))", "substring(text, cast(x.end + 1 as int), 1)"
        of = {
            "kind": f"{i}", "digits": f"length({_digits('x.m')})", "size": "length(x.m)", "luhn": f"if(length({_digits('x.m')}) >= 12 and {_luhn('x.m')}, 1, 0)", "paren": "if(x.m rlike '[(\\\\[{]', 1, 0)",
            "key": f"if({before} rlike {_quote(KEYS)}, 1, 0)", "other": f"if({before} rlike {_quote(OTHERS)}, 1, 0)", "before": f"if({before} rlike '[a-z0-9_/.=-]$', 1, 0)", "after": f"if({after} rlike '[A-Za-z0-9_/=-]', 1, 0)",
            "marks": "length(regexp_replace(x.m, '[A-Za-z0-9\\\\x20]', ''))", "zeros": f"length(regexp_replace({_digits('x.m')}, '[^0]', ''))", "groups": "size(split(x.m, '[^A-Za-z0-9]+'))",
        }
        made = ", ".join(f"'{n}', {of[n]}" for n in FEATURES if n != "kind")
        each.append(f"transform({_spans(GENERATORS[k], GENERATOR_NEEDS[k])}, x -> named_struct('start', x.start, 'kind', {i}, 'end', x.end, {made}))")
    return F.expr(f"concat({', '.join(each)})")


class Trees:
    """Boosted regression trees of depth two on the logistic loss, over small whole-number features."""

    def __init__(self, rounds: int = 40, rate: float = 0.3, penalty: float = 1.0) -> None:
        self.rounds, self.rate, self.penalty = rounds, rate, penalty
        self.bias, self.trees, self.thresholds = 0.0, [], {}

    def _split(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
        best = (1e-9, -1, 0)
        whole = g.sum() ** 2 / (h.sum() + self.penalty)
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1].tolist():
                left = x[:, f] <= cut
                a, b = g[left].sum(), h[left].sum()
                gain = a**2 / (b + self.penalty) + (g.sum() - a) ** 2 / (h.sum() - b + self.penalty) - whole
                if gain > best[0] + 1e-12:
                    best = (float(gain), f, int(cut))
        return best

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.bias = float(np.log(y.mean() / (1 - y.mean())))
        z = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            _, f, cut = self._split(x, g, h)
            if f < 0:
                break
            sides = []
            for side in (x[:, f] <= cut, x[:, f] > cut):
                _, f2, cut2 = self._split(x[side], g[side], h[side])
                parts = [side] if f2 < 0 else [side & (x[:, f2] <= cut2), side & (x[:, f2] > cut2)]
                values = [round(float(self.rate * g[q].sum() / (h[q].sum() + self.penalty)), 6) for q in parts]
                for q, v in zip(parts, values, strict=True):
                    z[q] += v
                sides.append((f2, cut2, values))
            self.trees.append((f, cut, *sides))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for f, cut, left, right in self.trees:
            for side, (f2, cut2, v) in ((x[:, f] <= cut, left), (x[:, f] > cut, right)):
                z[side] += v[0] if f2 < 0 else np.where(x[side, f2] <= cut2, v[0], v[1])
        return z

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float = 0.98) -> Trees:
        """For each kind, the lowest score from which ``precision`` of the held-out candidates are personal data.

        A kind that never gets there is not accepted at all.
        """
        z = self.score(x)
        for kind in range(len(KINDS)):
            own = x[:, 0] == kind
            order = np.argsort(-z[own])
            s, good = z[own][order], np.cumsum(y[own][order])
            fine = np.nonzero((good / np.arange(1, len(s) + 1) >= precision) & np.append(s[1:] < s[:-1], True))[0] if len(s) else []
            self.thresholds[kind] = round(float(s[fine[-1]]), 6) - 1e-6 if len(fine) else float("inf")
        return self

    def sql(self, of: str) -> str:
        """The score of a struct of features, as SQL."""
        def leaf(side: tuple) -> str:
            f2, cut2, v = side
            return f"{v[0]}D" if f2 < 0 else f"if({of}.{FEATURES[f2]} <= {cut2}, {v[0]}D, {v[1]}D)"

        return " + ".join([f"{self.bias:.6f}D", *(f"if({of}.{FEATURES[f]} <= {cut}, {leaf(left)}, {leaf(right)})" for f, cut, left, right in self.trees)])

    def accepted(self, of: str) -> str:
        least = " ".join(f"when {k} then {t}D" for k, t in self.thresholds.items() if t != float("inf"))
        return f"coalesce({self.sql(of)} >= case {of}.kind {least} end, false)" if least else "false"


def made_examples(n: int = 3000, seed: int = 8) -> list[tuple[str, int]]:
    """Texts that hold one candidate each, and whether it is personal data: invented, from a fixed seed."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    w = lambda: "".join(rng.choice(("an", "er", "lo", "mi", "ta", "ro", "sen", "dü", "ca")) for _ in range(rng.randint(1, 4)))

    def card(sep: str) -> str:
        digits = rng.choice("3456") + d(14)
        total = sum(n - 9 if n > 9 else n for n in (int(c) * (2 - i % 2) for i, c in enumerate(digits)))
        digits += str(-total % 10)
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4))

    out = []
    for _ in range(n):
        kind, real = rng.randrange(4), rng.random() < 0.5
        if kind == 0:
            at, dot = rng.choice((" @ ", "[at]", " (at) ", "{at}")), rng.choice((".", "[dot]", " (dot) "))
            span = f"{w()}{rng.choice('._')}{w()}{at}{w()}{dot}{rng.choice(('com', 'org', 'net', 'example'))}" if real else f"{w()} @ {w()}. {w()}"
            lead = rng.choice(("mail ", "contact ", "write to ", w() + " ")) if real else rng.choice((w() + " ", "price ", "score "))
        elif kind == 1:
            span = ":".join("".join(rng.choice("0123456789abcdef") for _ in range(4 if real else 2)) for _ in range(8))
            lead = rng.choice(("host ", "server ", "addr ", w() + " ")) if real else rng.choice(("hash ", "token ", "serial ", "build "))
        elif kind == 2:
            sep = rng.choice("._/ -")
            span = card(sep) if real else sep.join(d(4) for _ in range(4))
            lead = rng.choice(("card ", "visa ", "pay with ", w() + " ")) if real else rng.choice(("order ", "serial ", "ref ", "lot ", w() + "-"))
        else:
            style = rng.randrange(3)
            span = (f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"00{d(2)} {d(3)} {d(3)} {d(4)}")[style] if real else (f"{d(2)}.{d(4)}.{d(4)}", f"{d(4)}-{d(4)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}")[style]
            lead = rng.choice(("tel ", "call ", "phone: ", w() + " ")) if real else rng.choice(("order ", "isbn ", "version ", "part ", "total ", w() + "/"))
        out.append((f"{w()} {w()} {lead}{span}{rng.choice((' ', '. ', ', '))}{w()}", int(real)))
    return out


def fitted(spark: SparkSession) -> Trees:
    """Trees fitted on two thirds of the made examples, thresholds calibrated on the rest; a fixed number of rows."""
    rows = spark.createDataFrame(made_examples(), "text string, y int").select("y", F.explode(candidates()).alias("c")).select("y", "c.*").collect()
    x, y = np.array([[r[f] for f in FEATURES] for r in rows]), np.array([r.y for r in rows], float)
    third = np.arange(len(y)) % 3 == 2
    return Trees().fit(x[~third], y[~third]).calibrate(x[third], y[third])


def personal_data(spark: SparkSession, docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """Spans of personal data in documents (doc_id, text).

    Returns doc_id, n_email, n_ip, n_card, n_phone and base_sha256 (of the patterns' own valid matches), and spans:
    those, and the candidates that the trees accept and that touch no base span, as kind:start:end by
    start, then kind, then end. Places are code points, end exclusive.

    One pass, no shuffle. A null or empty text has no spans; repeated rows each give a row; an empty table gives none.
    """
    trees = trees or fitted(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    word = "element_at(array('email', 'ip', 'card', 'phone'), s.kind + 1)"
    as_text = lambda spans: f"array_join(transform({spans}, s -> concat({word}, ':', s.start, ':', s.end)), ',')"
    plain = "transform({}, c -> named_struct('start', c.start, 'kind', c.kind, 'end', c.end))"
    fresh = f"filter(proposed, c -> not exists(base, b -> b.start < c.end and c.start < b.end) and {trees.accepted('c')})"
    found = rows.select("doc_id", base_spans().alias("base"), candidates().alias("proposed"))
    counts = [F.expr(f"size(filter(base, b -> b.kind = {i}))").cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.expr(as_text("base")), 256).alias("base_sha256"), F.expr(as_text(f"array_sort(concat(base, {plain.format(fresh)}))")).alias("spans"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return personal_data(spark, take(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text"))
