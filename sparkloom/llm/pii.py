"""Personal data: base formats plus gradient-boosted candidate selection, in Spark expressions only.

High-recall generators propose overlapping spans (secrets, account numbers, national ids, obfuscated addresses); boosted
trees score each from its format and the text before it; spans over a calibrated threshold are kept, the best of those
that overlap. The base formats (email, ip, card, phone) are always kept.

The trees are fitted when first used, on TRAIN_ROWS generated and labelled examples (a documented bound; no corpus row is used), whose features come
from the same expressions as those of the corpus; half of the examples fit the trees, half calibrate scores and thresholds.
Everything that touches the corpus is one projection: no shuffle, no Python.
"""

from __future__ import annotations

import json
import math
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Generated examples, of which half fit the trees and half calibrate them.
TRAIN_ROWS = 3000
TREES, DEPTH, RATE = 30, 3, 0.3
#: Share of right ones among the calibration examples that a kind's threshold keeps.
PRECISION = 0.99
CONTEXT = 24
#: Beyond so many characters a random secret has all its alphabet's characters, so their share is taken of these.
LONG = 200.0
BLOCK = 256

_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: In the order of the output. Possessive forms and guards keep matching linear; they match as the plain forms do.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What stands before a secret that is named.
_NAMED = r"\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[\x20\x22']{0,3}[:=]"
#: kind -> generators; kinds stand after the base ones where spans start together.
GENERATORS = {
    "secret": (
        rf"(?i){_NAMED}[\x20\x22']{{0,3}}[^\s\x22',;]{{6,}}+",
        r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{16,}+",
    ),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",),
    "national_id": (r"(?<![0-9.-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9.-])",),
    "email_spelled": (r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]{1,63}){1,8}",),
}
KINDS = [*BASE, *GENERATORS]
GATE = rf"(?i)[0-9@]|[(\[]at[)\]]|{_NAMED}"
_KEYWORDS = r"(?i)pass|pwd|token|secret|key|auth|credential"
_ACCOUNT = r"(?i)ssn|social|security|iban|account|konto|compte|cuenta|bank|mail|contact|write"
_NEUTRAL = r"(?i)commit|sha|version|order|isbn|serial|model|file|img|part|build|date|item|hash"
FEATURES = ["chars", "digits", "upper", "hex", "turns", "distinct", "signs", "keyword", "account", "neutral", "prefix", "assigns", "kind"]


def _pieces(text: Column, pattern: str) -> Column:
    """array<struct<v, pre, n, len>>: each match, the end of the gap before it, the gap's length and the match's."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(found, gaps, lambda v, g: F.struct(v.alias("v"), F.right(g, F.lit(CONTEXT)).alias("pre"), F.length(g).cast("long").alias("gap"), F.length(v).cast("long").alias("len")))
    return F.filter(both, lambda x: x.v.isNotNull())


def _total(part: Column) -> Column:
    return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x.gap + x.len)


def _spans(pieces: Column, sums: Column) -> Column:
    """array<struct<v, pre, b, e>>; sums: the lengths of blocks of BLOCK pieces, so long lists stay far from quadratic."""

    def span(x: Column, i: Column) -> Column:
        whole = F.floor(i / BLOCK).cast("int")
        before = F.aggregate(F.slice(sums, F.lit(1), whole), F.lit(0).cast("long"), lambda a, y: a + y)
        end = before + _total(F.slice(pieces, whole * BLOCK + 1, i - whole * BLOCK + 1))
        return F.struct(x.v.alias("v"), x.pre.alias("pre"), (end - x.len).alias("b"), end.alias("e"))

    return F.transform(pieces, span)


def located(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Replaces `text` by a column of spans for each pattern; rows without a character that any needs are not matched."""
    names = list(patterns)
    kept = [F.col(c) for c in rows.columns if c != "text"]
    none = F.expr("cast(array() as array<struct<v:string,pre:string,gap:bigint,len:bigint>>)")
    rows = rows.select(*kept, F.when(F.col("text").rlike(GATE), F.col("text")).alias("text"))
    rows = rows.select(*kept, *(F.when(F.col("text").isNotNull(), _pieces(F.col("text"), patterns[n])).otherwise(none).alias(n) for n in names))

    def sums(n: str) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(n) - 1) / BLOCK).cast("int"))
        return F.when(F.size(n) > 0, F.transform(blocks, lambda b: _total(F.slice(F.col(n), b * BLOCK + 1, BLOCK)))).otherwise(F.expr("cast(array() as array<bigint>)"))

    rows = rows.select("*", *(sums(n).alias(f"{n}_sums") for n in names))
    return rows.select(*kept, *(_spans(F.col(n), F.col(f"{n}_sums")).alias(n) for n in names))


def _luhn(digits: Column) -> Column:
    size = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, size - i + 1, 1).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add) % 10 == 0


def _base_ok(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        return v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _features(kind: str, x: Column) -> Column:
    """array<double> in the order of FEATURES."""
    v, around = x.v, F.concat(x.pre, F.lit(" "), x.v)
    n = F.length(v).cast("double")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    flag = lambda c: c.cast("int").cast("double")
    return F.array(
        n, share("[0-9]"), share("[A-Z]"), share("[0-9a-fA-F]"), share("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"), F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(LONG)), share("[^A-Za-z0-9]"),
        flag(around.rlike(_KEYWORDS)), flag(around.rlike(_ACCOUNT)), flag(around.rlike(_NEUTRAL)), flag(v.rlike("^(?:AKIA|ASIA|ghp_|sk-|xox|eyJ|AIza)")), flag(v.rlike("[:=]")), F.lit(float(list(GENERATORS).index(kind))),
    )


def _featurer(generator: str):
    kind = generator.rpartition("_")[0]
    return lambda x: _features(kind, x)


def _generators() -> dict[str, str]:
    return {f"{kind}_{i}": p for kind, patterns in GENERATORS.items() for i, p in enumerate(patterns)}


# ---- the model -----------------------------------------------------------------------------------------------------


def examples(rows: int = TRAIN_ROWS, seed: int = 11) -> list[tuple[str, int]]:
    """(text, label): one candidate with a few words before it, private (1) or not (0)."""
    r = random.Random(seed)
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    low, up, num, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    word = lambda: pick(low, r.randint(2, 9))
    mix = low + up + num
    private = [
        lambda: f"password={pick(hexa, r.randint(10, 32))}", lambda: f'token = "{pick(hexa, r.choice((32, 40, 64)))}"', lambda: f"api_key: {pick(mix, r.randint(20, 40))}", lambda: f"secret={pick(mix, r.randint(12, 40))}",
        lambda: "AKIA" + pick(up + num, 16), lambda: "ghp_" + pick(mix, 36), lambda: "sk-" + pick(mix, 32), lambda: f"access key {pick(mix, 40)}",
        lambda: f"IBAN {pick(up, 2)}{pick(num, 20)}", lambda: f"account {pick(up, 2)}{pick(num, 2)} {pick(num, 4)} {pick(num, 4)} {pick(num, 4)} {pick(num, 2)}",
        lambda: f"SSN {pick(num, 3)}-{pick(num, 2)}-{pick(num, 4)}", lambda: f"social security {pick(num, 3)}-{pick(num, 2)}-{pick(num, 4)}",
        lambda: f"{word()}.{word()} (at) {word()} (dot) com", lambda: f"mail {word()} [at] {word()}.org",
    ]
    public = [
        lambda: f"commit {pick(hexa, 40)}", lambda: f"sha {pick(hexa, 64)}", lambda: f"IMG_{pick(num, 8)}_{pick(num, 6)}", lambda: f"{word()}-{word()}-{word()}-{r.randint(1, 2030)}", lambda: f"{word()}/{word()}/{word()}/{word()}{r.randint(0, 99)}",
        lambda: pick(num, r.randint(16, 30)), lambda: f"order {pick(num, 18)}", lambda: f"serial {pick(up, 2)}{pick(num, 16)}", lambda: f"model {pick(up, 2)}{pick(num, 2)} {pick(up + num, 6)} {pick(up + num, 8)}", lambda: f"part {pick(num, 3)}-{pick(num, 2)}-{pick(num, 4)}",
        lambda: f"{pick(num, 3)} {pick(num, 2)} {pick(num, 4)}", lambda: f"version_{word()}_{pick(num, 8)}", lambda: f"token: {word()}{word()}", lambda: f"password = {word()}ed",
        lambda: f"{word()}+{word()}+{word()}+{pick(num, 2)}", lambda: "-" * r.randint(3, 12) + pick(num, 4) + "-" * r.randint(12, 20), lambda: f"{word()} (at) {word()}. {word()}",
    ]
    out = []
    for i in range(rows):
        made = r.choice(private if i % 2 else public)()
        out.append((" ".join(word() for _ in range(r.randint(0, 4))) + " " + made + " " + word(), i % 2))
    return out


def _fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> tuple[float, list]:
    """Logistic boosting with second-order splits; a tree is (feature, threshold, left, right) or a leaf's value."""
    start = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    score = np.full(len(y), start)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 24))) for f in range(x.shape[1])]

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int):
        leaf = float(-rate * g[rows].sum() / (h[rows].sum() + 1))
        best = (1e-3, None)
        if level and len(rows) > 20:
            whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
            for f, at in enumerate(cuts):
                for t in at:
                    left = x[rows, f] <= t
                    if left.all() or not left.any():
                        continue
                    gl, hl = g[rows[left]].sum(), h[rows[left]].sum()
                    gain = gl**2 / (hl + 1) + (g[rows].sum() - gl) ** 2 / (h[rows].sum() - hl + 1) - whole
                    if gain > best[0]:
                        best = (gain, (f, float(t)))
        if best[1] is None:
            return leaf
        f, t = best[1]
        left = x[rows, f] <= t
        return (f, t, grow(rows[left], g, h, level - 1), grow(rows[~left], g, h, level - 1))

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(y)), p - y, p * (1 - p), depth)
        grown.append(tree)
        score += np.array([value(tree, row) for row in x])
    return start, grown


def predict(model: tuple[float, list], x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model[0])
    for i, row in enumerate(x):
        for tree in model[1]:
            while isinstance(tree, tuple):
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            out[i] += tree
    return out


def labelled_features(spark: SparkSession, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of the generated examples, through the same plan as the corpus."""
    made = json.dumps([{"text": t, "y": y} for t, y in examples(rows)])
    table = spark.range(1).select(F.inline(F.from_json(F.lit(made), "array<struct<text:string,y:int>>")))
    spans = located(table, _generators())
    cands = F.concat(*(F.transform(n, _featurer(n)) for n in _generators()))
    got = spans.select("y", F.explode(cands).alias("f")).collect()
    x = np.array([r.f for r in got], dtype=float)
    return x, np.array([r.y for r in got], dtype=float), x[:, -1].astype(int)


@lru_cache(maxsize=1)
def _trained(rows: int) -> tuple[tuple[float, list], dict[str, float]]:
    """The trees and each kind's threshold: the lowest score at which PRECISION of the calibration examples are right."""
    x, y, kind = labelled_features(SparkSession.active(), rows)
    half = np.arange(len(y)) % 2 == 0
    model = _fit(x[half], y[half])
    score = predict(model, x[~half])
    limits = {}
    for k, name in enumerate(GENERATORS):
        mine = kind[~half] == k
        order = np.argsort(-score[mine], kind="stable")
        s, right = score[mine][order], np.cumsum(y[~half][mine][order]) / (np.arange(mine.sum()) + 1)
        ok = [i for i in np.flatnonzero(right >= PRECISION) if i + 1 == len(s) or s[i + 1] < s[i]]
        # half-way to the next lower score; nothing passes if no threshold is precise enough
        limits[name] = math.inf if not ok else float((s[ok[-1]] + s[min(ok[-1] + 1, len(s) - 1)]) / 2)
    return model, limits


def _score(model: tuple[float, list], f: Column) -> Column:
    def expr(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(f[tree[0]] <= F.lit(tree[1]), expr(tree[2])).otherwise(expr(tree[3]))

    total = F.lit(float(model[0]))
    for tree in model[1]:
        total = total + expr(tree)
    return total


# ---- the operator --------------------------------------------------------------------------------------------------


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, base, added) for every row: arrays of struct<kind, b, e>, code points, end exclusive, by start then kind.

    base: all valid base spans, also where they overlap each other. added: spans that the trees select and that overlap
    no base span. Null text: empty, no spans. Repeated rows each give a row, a null id stays null, an empty table gives
    none; texts are matched whole; other columns are not read.
    """
    spark = docs.sparkSession
    model, limits = _trained(train_rows)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    spans = located(rows, BASE | _generators())
    order = {k: i for i, k in enumerate(KINDS)}

    def base(kind: str) -> Column:
        good = F.filter(kind, lambda x: _base_ok(kind, x.v))
        return F.transform(good, lambda x: F.struct(x.b.alias("b"), F.lit(order[kind]).alias("k"), x.e.alias("e")))

    def featured(name: str) -> Column:
        kind = name.rpartition("_")[0]
        return F.transform(name, lambda x: F.struct(x.b.alias("b"), F.lit(order[kind]).alias("k"), x.e.alias("e"), _features(kind, x).alias("f")))

    spans = spans.select("doc_id", F.array_sort(F.concat(*(base(k) for k in BASE))).alias("base"), F.concat(*(featured(n) for n in _generators())).alias("cands"))
    overlaps = lambda x, y: (x.b < y.e) & (y.b < x.e)

    def scored(x: Column) -> Column:
        return F.struct(x.b.alias("b"), x.k.alias("k"), x.e.alias("e"), _score(model, x.f).alias("s"))

    def over(x: Column) -> Column:
        at = F.lit(math.inf)
        for kind, low in limits.items():
            at = F.when(x.k == order[kind], F.lit(low)).otherwise(at)
        return x.s > at

    free = F.filter("cands", lambda x: ~F.exists("base", lambda y: overlaps(x, y)))
    spans = spans.select("doc_id", "base", F.when(F.size("cands") > 0, F.filter(F.transform(free, scored), over)).otherwise(F.expr("cast(array() as array<struct<b:bigint,k:int,e:bigint,s:double>>)")).alias("good"))

    def beaten(x: Column) -> Column:
        stronger = lambda y: (y.s > x.s) | ((y.s == x.s) & ((y.b < x.b) | ((y.b == x.b) & ((y.e > x.e) | ((y.e == x.e) & (y.k < x.k))))))
        return F.exists("good", lambda y: overlaps(x, y) & stronger(y))

    best = F.array_sort(F.transform(F.filter("good", lambda x: ~beaten(x)), lambda x: F.struct(x.b.alias("b"), x.k.alias("k"), x.e.alias("e"))))
    named = lambda c: F.transform(c, lambda x: F.struct(F.element_at(F.array(*(F.lit(k) for k in KINDS)), x.k + 1).alias("kind"), x.b.alias("b"), x.e.alias("e")))
    return spans.select("doc_id", named(F.col("base")).alias("base"), named(F.array_distinct(best)).alias("added"))


def span_digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256 and spans from personal_data()'s arrays."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.b.cast("string"), x.e.cast("string"))), ",")
    rank = lambda x: F.array_position(F.array(*(F.lit(k) for k in KINDS)), x.kind)
    every = F.transform(F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x.b.alias("b"), rank(x).alias("k"), x.e.alias("e"), x.kind.alias("kind")))), lambda x: F.struct(x.kind.alias("kind"), x.b.alias("b"), x.e.alias("e")))
    count = lambda kind: F.size(F.filter("base", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.size("added").cast("long").alias("n_added"))
