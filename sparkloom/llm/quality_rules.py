"""Quality rules as a short-circuit cascade.

A text runs through a list of rules until one rejects it; a count is made when the first rule asks for it. The order of
the rules is estimated, not fixed: on a bounded sample (`sample_rows`, spread over all documents by a hash of the id)
each rule's cost and rejection rate are measured, and rules run by descending rejection per cost. The verdict is a
conjunction, so the order changes only the time it takes, never a result.

One rule is fitted: toxic_lexicon() finds the beginnings of words that labelled toxic documents hold far more densely than
others, from at most LABELLED_ROWS labels, and texts dense in words that begin so are rejected.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.shared import small_batches, written

#: Words that only insult; a text in which they are at least one word in INSULT_SHARE is rejected.
INSULTS = frozenset(b"loser idiot pathetic scum worthless moron trash clown disgusting stupid".split())
INSULT_SHARE = 500
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_EDGE = b".,;:!?\"'()[]"
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


#: The lexicon is fitted on so many labels at most, spread by a hash of the id.
LABELLED_ROWS = 20_000
#: Beginnings of words by their length in code points.
BEGINNINGS = (3, 4, 5, 6, 7)
#: A beginning is toxic if LEAST_DOCUMENTS toxic documents hold it, a toxic document LIFT times as densely as another on average, and
#: MORE_DOCUMENTS times as many of them. A document counts as no denser than MOST_DENSE millionths, so that none decides alone.
LEAST_DOCUMENTS, LIFT, MORE_DOCUMENTS, MOST_DENSE = 5, 25, 2, 20_000
#: A text with LEAST_HITS words that begin so, one word in TOXIC_SHARE at least, is rejected.
LEAST_HITS, TOXIC_SHARE = 2, 120


class Text:
    """One text with its counts, each made when it is first read."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""
        self.raw = self.text.encode("utf-8", "surrogatepass")
        self.words = self.raw.split()
        self.n_words = len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, _SPACE)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _SYMBOLS))

    @cached_property
    def lines(self) -> tuple[int, int]:
        lines = [x for x in self.raw.split(b"\n") if x and not x.isspace()]
        return len(lines), len(lines) - len(set(lines))

    @property
    def n_lines(self) -> int:
        return self.lines[0]

    @property
    def n_dup_lines(self) -> int:
        return self.lines[1]

    @cached_property
    def n_repeat_words(self) -> int:
        words = self.words
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        often = Counter(windows)
        marks = bytearray(self.n_words)
        for i, w in enumerate(windows):
            if often[w] > 1:
                marks[i : i + 3] = b"\1\1\1"
        return sum(marks)

    @cached_property
    def low_words(self) -> list[bytes]:
        """Words with A-Z lowered, without signs at their ends."""
        return [w.strip(_EDGE) for w in self.raw.lower().split()]

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


def many_symbols(t: Text) -> bool:
    return 10 * t.n_symbols > t.word_chars


def long_or_short_words(t: Text) -> bool:
    return t.word_chars < 2 * t.n_words or t.word_chars > 20 * t.n_words


def repeated_lines(t: Text) -> bool:
    return 10 * t.n_dup_lines > 5 * t.n_lines


def repeated_windows(t: Text) -> bool:
    return 100 * t.n_repeat_words > 45 * t.n_words


def shouting(t: Text) -> bool:
    return 10 * sum(w.endswith(b"!!") for w in t.words) > t.n_words


def few_letters(t: Text) -> bool:
    """Under a half of the words hold an ASCII letter or a byte beyond ASCII."""
    plain = bytes(range(65)) + bytes(range(91, 97)) + bytes(range(123, 128))
    return 2 * sum(bool(w.translate(None, plain)) for w in t.words) < t.n_words


def insulting(t: Text) -> bool:
    low = t.raw.lower()
    if not any(w in low for w in INSULTS):
        return False
    return INSULT_SHARE * sum(w in INSULTS for w in t.low_words) >= t.n_words


def toxic_words(lexicon: Iterable[str]) -> Callable[[Text], bool]:
    """The rule that rejects texts dense in words that begin with one of `lexicon`."""
    starts = tuple(x.encode("utf-8", "surrogatepass") for x in lexicon)
    heads = frozenset(x[:3] for x in starts)  # beginnings have three code points, so three bytes, at least

    def toxic_words(t: Text) -> bool:
        hits = sum(w[:3] in heads and w.startswith(starts) for w in t.low_words)
        return hits >= LEAST_HITS and TOXIC_SHARE * hits >= t.n_words

    return toxic_words


RULES: dict[str, Callable[[Text], bool]] = {f.__name__: f for f in (many_symbols, long_or_short_words, repeated_lines, repeated_windows, shouting, few_letters, insulting)}


def toxic_lexicon(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic", labelled_rows: int = LABELLED_ROWS) -> list[str]:
    """The beginnings of words that mark toxic documents, shortest only, sorted.

    Fitted on at most `labelled_rows` labels (doc_id, toxic 0/1), those with the smallest hashes of the id. A null id or label
    does not count, of several labels for an id the largest holds; texts without words do not count either. No labels, no documents or
    no toxic ones among them: an empty list, with which the rule rejects nothing.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(doc_id).cast("long").alias("i"), F.col(toxic).cast("int").alias("toxic")).dropna().groupBy("i").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("i"), "i").limit(labelled_rows)
    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).join(F.broadcast(known), "i").select("t", "toxic")
    names = ["p", "held1", "held0", "dense1", "dense0"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for x, bad in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = Text(x)
                if not t.n_words:
                    continue
                words = [w.decode("utf-8", "surrogatepass") for w in t.low_words]
                held = Counter(w[:k] for w in words for k in BEGINNINGS if len(w) >= k)
                held[""] = 0  # counts the documents
                for p, n in held.items():
                    row = counts.setdefault(p, [0, 0, 0, 0])
                    row[not bad] += 1
                    row[3 - bool(bad)] += min(MOST_DENSE, n * 1_000_000 // t.n_words)
            columns = zip(*([p, *row] for p, row in counts.items()), strict=True) if counts else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i else pa.string()) for i, c in enumerate(columns)], names=names)

    counts = rows.mapInArrow(count, "p string, held1 long, held0 long, dense1 long, dense0 long").groupBy("p").agg(*(F.sum(c).alias(c) for c in names[1:]))
    counts = written(counts, "word-beginnings")
    total = counts.where("p = ''").first()
    if total is None:
        return []
    n1, n0 = total.held1, total.held0
    found = counts.where((F.col("p") != "") & (F.col("held1") >= LEAST_DOCUMENTS) & (F.col("dense1") * n0 >= F.col("dense0") * n1 * LIFT) & (F.col("held1") * n0 >= F.col("held0") * n1 * MORE_DOCUMENTS))
    chosen = {r.p for r in found.select("p").collect()}  # bounded by the words of `labelled_rows` documents
    return sorted(p for p in chosen if not any(p[:k] in chosen for k in BEGINNINGS if k < len(p)))


def _rules(lexicon: Iterable[str]) -> dict[str, Callable[[Text], bool]]:
    starts = list(lexicon)
    return RULES | {"toxic_words": toxic_words(starts)} if starts else RULES


def rule_order(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_rows: int = 2000, rules: dict = RULES) -> list[str]:
    """Rule names by descending rejection per cost, from about `sample_rows` documents spread by a hash of the id."""
    small_batches(docs.sparkSession)
    names = list(rules)
    one_in = max(1, docs.count() // sample_rows)
    some = docs.where(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(one_in)) == 0).select(F.col(text).cast("string").alias("t"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hits = [0.0] * len(names), [0] * len(names)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                if Text(x).base_failed:
                    continue
                for i, name in enumerate(names):
                    t = Text(x)  # anew, so that each rule pays for the counts that it reads
                    t.base_failed  # noqa: B018 (which are known by then)
                    began = time.perf_counter()
                    hits[i] += rules[name](t)
                    spent[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": names, "spent": spent, "hits": hits}, schema=pa.schema([("rule", pa.string()), ("spent", pa.float64()), ("hits", pa.int64())]))

    rows = some.mapInArrow(measure, "rule string, spent double, hits long").groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("hits").alias("hits")).collect()
    worth = {r["rule"]: (r["hits"] or 0) / max(r["spent"] or 0.0, 1e-9) for r in rows}
    return sorted(names, key=lambda x: (-worth.get(x, 0.0), names.index(x)))


def quality_rules(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", order: list[str] | None = None, sample_rows: int = 2000, lexicon: Iterable[str] = ()) -> DataFrame:
    """(doc_id, base counts, base_failed, kept) for every row of `docs`; other columns are not read.

    Null or empty text: no words, so base_failed and not kept. Repeated rows each give a row; an empty table gives
    none; a null id stays null. Texts are measured whole. `lexicon` (of toxic_lexicon()) adds the rule on toxic words.
    """
    rules = _rules(lexicon)
    order = rule_order(docs, text, doc_id, sample_rows, rules) if order is None else order
    small_batches(docs.sparkSession)
    chain = [rules[name] for name in order]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for x in batch.column(1).to_pylist():
                t = Text(x)
                failed = t.base_failed
                row = (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, not failed and not any(rule(t) for rule in chain))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(apply, f"doc_id long, {COLUMNS}")


def keep_good(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", order: list[str] | None = None, sample_rows: int = 2000, lexicon: Iterable[str] = ()) -> DataFrame:
    """The rows of `docs` that quality_rules() keeps, with all their columns, in one pass and without a join.

    A column of texts that is no string is read by its Python form.
    """
    rules = _rules(lexicon)
    order = rule_order(docs, text, doc_id, sample_rows, rules) if order is None else order
    small_batches(docs.sparkSession)
    chain = [rules[name] for name in order]
    at = docs.columns.index(text)
    plain = docs.schema[text].dataType.simpleString() == "string"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x in batch.column(at).to_pylist():
                t = Text(x if plain or x is None else str(x))
                good.append(not t.base_failed and not any(rule(t) for rule in chain))
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(apply, docs.schema)
