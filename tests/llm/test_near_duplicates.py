"""SimHash groups, fuzzy lines and decontamination against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm.decontamination import best_match, contaminated, decontaminated, words_of
from sparkloom.llm.line_dedup import dedup_lines, line_prints, removed_lines
from sparkloom.llm.shared import connected_components
from sparkloom.llm.simhash_dedup import _forest, fingerprint, links, one_of_each_group, pivots, signed, simhash_components


def groups_of(nodes, linked):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def plain_fingerprint(text, k):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split(" ")
    words = [w for chunk in words for w in chunk.replace("\t", "\n").replace("\x0b", "\n").replace("\x0c", "\n").replace("\r", "\n").split("\n") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def some_texts(seed, n):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 5)))
    texts = [None, "", " \n", "A b", "a B", "one two three four", "ONE two\tthree  four"]
    while len(texts) < n:
        if draw.random() < 0.6:
            words = draw.choice([t for t in texts if t and t.strip()]).split()
            for _ in range(draw.randint(0, 2)):
                words[draw.randrange(len(words))] = word()
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(word() for _ in range(draw.randint(1, 80))))
    return texts


def test_hash_is_sparks(spark):
    for s in ("a b c d", "é", ""):
        assert spark.range(1).select(F.xxhash64(F.lit(s))).first()[0] == signed(xxhash.xxh64_intdigest(s.encode(), 42))


@pytest.mark.parametrize("bits,k", [(4, 4), (7, 5), (3, 4)])
def test_simhash_components_equal_brute_force(spark, bits, k):
    texts = some_texts(bits, 160)
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(0, "again"), (None, texts[30])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("component_id", F.lit(1))
    got = simhash_components(docs, shingle_words=k, max_bits=bits).collect()
    assert len(got) == len(rows)
    prints = [plain_fingerprint(t, k) for _, t in rows]
    assert sorted(r.fingerprint for r in got) == sorted(f"{p:016x}" for p in prints)
    of_print = groups_of(set(prints), [(a, b) for a in set(prints) for b in set(prints) if a < b and (a ^ b).bit_count() <= bits])
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[of_print[p]] = min(i, least.get(of_print[p], i))
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(((i, least[of_print[p]]) for (i, _), p in zip(rows, prints, strict=True)), key=str)
    kept = {r.doc_id for r in one_of_each_group(docs, shingle_words=k, max_bits=bits).collect()}
    assert kept == set(least.values())
    assert simhash_components(docs.limit(0)).collect() == []


def test_links_of_one_dense_group_stay_few_and_whole(spark):
    draw = random.Random(2)
    base = draw.getrandbits(64)
    prints = {base}
    while len(prints) < 900:
        x = base
        for _ in range(draw.randint(1, 6)):
            x ^= 1 << draw.randrange(0, 64)
        prints.add(x)
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    edges = [(r.src, r.dst) for r in links(df, 4, tile=64).collect()]
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= 4 for a, b in edges)
    want = groups_of(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4])
    got = groups_of({signed(x) for x in prints}, edges)
    assert len({want[x] for x in prints}) == len(set(got.values()))


def test_pivot_filter_drops_no_link():
    import numpy as np

    draw = random.Random(9)
    fps = [draw.getrandbits(64) for _ in range(40)]
    fps += [f ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for f in fps]
    table = np.array([[((f ^ (p & ((1 << 64) - 1))).bit_count()) for p in pivots()] for f in fps], dtype=np.int16)
    edges = _forest(np.array(fps, dtype=np.uint64), table, np.zeros(len(fps)), 3)
    assert len(edges) >= 40


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(-5, 7), (3, 3)]
    df = spark.createDataFrame([*edges, (None, 4)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    linked = [(a, b) for a, b in edges if a != b]
    assert got == groups_of({x for e in linked for x in e}, linked)
    assert connected_components(df.limit(0)).collect() == []


# ---- lines ---------------------------------------------------------------------------------------------------------


def normal(line):
    out = "".join(c if c >= "\xc0" or c.isascii() and c.isalnum() else " " for c in line.lower())
    return " ".join(w for w in out.split(" ") if w)


def plain_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_line_print(norm, spark_hash):
    words = norm.split()
    return sum(1 << b for b in range(64) if 2 * sum(spark_hash[w] >> b & 1 for w in words) > len(words))


def test_lines_equal_brute_force(spark):
    draw = random.Random(3)
    vocab = ["".join(draw.choice("abcdefg") for _ in range(draw.randint(2, 6))) for _ in range(60)]
    lines = [" ".join(draw.choice(vocab) for _ in range(draw.choice([5, 20, 40, 126, 127, 128, 300]))) for _ in range(40)]
    made = list(lines)
    for _ in range(120):
        words = draw.choice(lines).split()
        for _ in range(draw.randint(0, 2)):
            words[draw.randrange(len(words))] = draw.choice(vocab)
        made.append(draw.choice(["", " ", "--"]) + "  ".join(words).upper() if draw.random() < 0.3 else " ".join(words) + draw.choice(["", ".", "!"]))
    docs = [(i, "\n".join([draw.choice([*made, "short one", "", "..."]) for _ in range(draw.randint(1, 6))])) for i in range(70)]
    docs += [(500, None), (501, ""), (None, "\n".join(made[:2])), (3, docs[3][1])]
    df = spark.createDataFrame([(*d, len(d[1] or ""), 1) for d in docs], "doc_id long, text string, n_chars long, removed int")
    spots = {}
    for i, t in docs:
        for n, line in enumerate((t or "").split("\n")):
            norm = normal(line)
            if len(norm.split()) >= 5:
                spots[(i if i is not None else 1 << 62, n)] = norm
    norms = sorted(set(spots.values()))
    hashes = {w: xxhash.xxh64_intdigest(w.encode(), 42) for x in norms for w in x.split()}
    prints = {x: plain_line_print(x, hashes) for x in norms}
    got_prints = {(r.doc_id, r.line_no): r.simhash for r in line_prints(df.select("doc_id", "text")).collect()}
    assert all(got_prints[(None if i == 1 << 62 else i, n)] == signed(prints[x]) for (i, n), x in spots.items())
    linked = []
    for i, a in enumerate(norms):
        for b in norms[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3 and plain_edit(a.split(), b.split()) <= int(0.2 * max(len(a.split()), len(b.split())) + 1e-9):
                linked.append((a, b))
    assert linked
    group = groups_of(norms, linked)
    keeper = {}
    for spot in sorted(spots):
        keeper.setdefault(group[spots[spot]], spot)
    want = {}
    for spot, x in spots.items():
        if keeper[group[x]] != spot:
            want.setdefault(None if spot[0] == 1 << 62 else spot[0], []).append(spot[1])
    got = {r.doc_id: r.removed for r in removed_lines(df).collect()}
    assert got == {k: sorted(v) for k, v in want.items()}
    out = dedup_lines(df).collect()
    assert len(out) == len(docs)
    for r in out:
        text = next(t for i, t in docs if i == r.doc_id)
        kept = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in want.get(r.doc_id, []))
        assert r.text == kept and r.removed == 1
        assert r.n_chars == len(r.text or "")
    assert removed_lines(df.limit(0)).collect() == [] and dedup_lines(df.limit(0)).collect() == []


# ---- benchmark -----------------------------------------------------------------------------------------------------


def plain_best(item, doc):
    """Least word edits of item to any part of doc."""
    row = [0] * (len(doc) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(doc, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_best_match():
    draw = random.Random(8)
    for _ in range(200):
        item = [draw.randint(1, 6) for _ in range(draw.randint(1, 12))]
        doc = [draw.randint(0, 6) for _ in range(draw.randint(0, 20))]
        marked = [x if x else -1 for x in doc]
        assert best_match(item, doc)[0] == min(plain_best(item, marked), len(item))


def test_contamination_equals_brute_force(spark):
    draw = random.Random(6)
    vocab = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 5))) for _ in range(300)]
    items = [(i, " ".join(draw.choice(vocab) for _ in range(draw.choice([3, 8, 15, 30, 55])))) for i in range(20)] + [(90, None), (91, "  "), (92, "Élan vital ! of the")]
    docs = []
    for i in range(150):
        words = [draw.choice(vocab) for _ in range(draw.randint(0, 120))]
        if draw.random() < 0.7:
            part = draw.choice(items[:20])[1].split()
            for _ in range(draw.randint(0, max(1, len(part) // 4))):
                kind, at = draw.randrange(3), draw.randrange(len(part))
                if kind == 0:
                    part[at] = draw.choice(vocab)
                elif kind == 1 and len(part) > 2:
                    del part[at]
                else:
                    part.insert(at, draw.choice(vocab))
            at = draw.randint(0, len(words))
            words[at:at] = [w.upper() + "," if draw.random() < 0.2 else w for w in part]
        docs.append((i, " ".join(words)))
    docs += [(900, None), (901, ""), (None, items[3][1]), (902, "so Élan vital, of THE end")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in docs:
        for k, x in items:
            item = words_of(x)
            if item:
                edits = plain_best(item, words_of(t))
                if edits <= int(0.2 * len(item) + 1e-9):
                    want[i, k] = edits
    got = {(r.doc_id, r.item_id): r.edits for r in contaminated(df, bench, block_items=7).collect()}
    assert set(got) <= set(want) and all(got[p] == want[p] for p in got)
    assert len(got) >= 0.98 * len(want) and all(p in got for p, e in want.items() if e == 0)
    left = {r.doc_id for r in decontaminated(df, bench).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in got}
    assert contaminated(df.limit(0), bench).collect() == [] and contaminated(df, bench.limit(0)).collect() == []
