"""LM scores, quality rules, licences and the pipeline against plain versions."""

import math
import random
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import oracles
from sparkloom.llm.license_scan import TEMPLATES, Scorer, document_frequencies, scan_licenses, terms, translated
from sparkloom.llm.lm_scoring import DIRICHLET, cross_entropy_difference
from sparkloom.llm.quality_rules import RULES, keep_good, quality_rules, rule_order, toxic_lexicon
from sparkloom.llm.simhash_dedup import fingerprint

SF = "/root/testdata/sf0.001"


def test_scores_equal_plain_counts(spark):
    texts = {1: "the cat sat on the mat", 2: "the cat ran", 3: "a dog sat on the mat the mat", 4: "", 5: "zebra 12,5 !!"}
    rows = [*texts.items(), (None, "the cat"), (2, "the cat ran")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("target", F.lit(1)).withColumn("ids", F.lit(1)).repartition(3)
    good = spark.createDataFrame([(1,), (1,), (3,), (None,)], "doc_id long")
    got = cross_entropy_difference(docs, good).collect()
    assert len(got) == len(rows)
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = bpe.get_vocab_size()
    seqs = [(i, bpe.encode(t, add_special_tokens=False).ids) for i, t in rows]

    def counts(seqs):
        bi, ctx, uni = Counter(), Counter(), Counter()
        for ids in seqs:
            for a, b in zip([-1, *ids], ids, strict=False):
                bi[a, b] += 1
                ctx[a] += 1
                uni[b] += 1
        return bi, ctx, uni, sum(uni.values())

    def loss(ids, rest):
        bi, ctx, uni, n = counts(rest)
        return sum(-math.log((bi[a, b] + DIRICHLET * (uni[b] + 1) / (n + size)) / (ctx[a] + DIRICHLET)) for a, b in zip([-1, *ids], ids, strict=False)) / len(ids)

    want = []
    for k, (i, ids) in enumerate(seqs):
        others = [s for j, (_, s) in enumerate(seqs) if j != k]
        targets = [s for j, (d, s) in enumerate(seqs) if j != k and d in (1, 3)]
        want.append((i, len(ids), *((loss(ids, targets), loss(ids, others)) if ids else (None, None))))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for a, b in zip(sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in got), key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2]
        assert a[2] is None if b[2] is None else a[2:] == pytest.approx(b[2:], abs=1e-9)
    assert all(r.difference == r.target_loss - r.background_loss for r in got if r.n_tokens)
    assert cross_entropy_difference(docs.limit(0), good).collect() == []
    assert len(cross_entropy_difference(docs, good.limit(0)).collect()) == len(rows)


def test_good_labels_score_lower(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scores = cross_entropy_difference(docs, labels.where("quality = 1 and toxic = 0 and doc_id % 2 = 0").select("doc_id"))  # half of the labels, held against the other half
    means = {r.quality: r.m for r in scores.join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("quality").agg(F.avg("difference").alias("m")).collect()}
    assert means[1] < means[0]


QUALITY_CASES = [None, "", "  \n\t", "word", "w " * 49 + "w", "x y z " * 20, "\x0bone\x0ctwo\rthree", "same line here\nsame line here\n \n\nsame line here ", "é€𝔘 ### *** " * 30, "BIG!! WORDS!! " * 40, "you idiot. " + " ".join(f"w{i}" for i in range(80)), " ".join(f"word{i}" for i in range(90)), " ".join(str(i) for i in range(90)), "a b c a b c d e f g", " nbsp is no space"]


def test_quality_counts_equal_sql(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(QUALITY_CASES)] + [(3, "word"), (None, "x")], "doc_id long, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet' where doc_id is not null")
    con.execute("create view labels as select 0 as doc_id, 0 as toxic where false")
    got = quality_rules(df.withColumn("n_words", F.lit(1)).withColumn("kept", F.lit(1)))
    names = got.columns
    rel = con.execute(oracles.QUALITY)
    order = [c[0] for c in rel.description]
    want = {tuple(r[order.index(c)] for c in names) for r in rel.fetchall()}
    rows = got.collect()
    assert len(rows) == df.count() and {tuple(r) for r in rows if r.doc_id is not None} == want
    assert quality_rules(df.limit(0)).collect() == [] and keep_good(df.limit(0)).collect() == []


def test_rule_order_changes_no_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    order = rule_order(docs, sample_rows=50)
    assert sorted(order) == sorted(RULES)
    a = {tuple(r) for r in quality_rules(docs, order=order).collect()}
    assert a == {tuple(r) for r in quality_rules(docs, order=order[::-1]).collect()}
    assert {r.doc_id for r in keep_good(docs).collect()} == {r[0] for r in a if r[-1]}
    assert keep_good(docs).columns == docs.columns


def plain_scan(files, threshold):
    known = {t for _, n in TEMPLATES for t in terms(translated(n))}
    frequency = Counter(t for _, text, _ in files for t in known & set(terms(translated(text))))
    n = len(files)
    idf = lambda t: math.log((1 + n) / (1 + frequency[t])) + 1 if t in known else math.log(1 + n) + 1

    def best(words):
        v = {t: c * idf(t) for t, c in Counter(words).items()}
        out = []
        for name, notice in TEMPLATES:
            u = {t: c * idf(t) for t, c in Counter(terms(translated(notice))).items()}
            dot = sum(x * u[t] for t, x in v.items() if t in u)
            out.append(dot / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in u.values())))
        top = max(out)
        return top, next(i for i, s in enumerate(out) if s >= top - 1e-12)

    own = []
    for i, text, path in files:
        whole = terms(translated(text))
        found = None
        if whole and best(whole)[0] >= threshold:
            found = (*best(whole), "file")
        else:
            lines = [best(w) for w in (terms(x) for x in translated(text).split(b"\n")) if w]
            if lines:
                top = max(lines, key=lambda s: (round(s[0], 9), -s[1]))
                if top[0] >= threshold:
                    found = (*top, "header")
        own.append((i, path or "", found))
    held = {}
    for i, path, found in own:
        if found and found[2] == "file":
            d = path.rpartition("/")[0]
            key = (-round(found[0], 6), i)
            if d not in held or key < held[d][0]:
                held[d] = (key, TEMPLATES[found[1]][0])
    out = {}
    for i, path, found in own:
        if found:
            out[i] = (TEMPLATES[found[1]][0], found[2], None)
            continue
        d = path.rpartition("/")[0]
        chain = [d]
        while chain[-1]:
            chain.append(chain[-1].rpartition("/")[0])
        up = next((x for x in chain if x in held), None)
        out[i] = (held[up][1], "inherited", up) if up is not None else (None, None, None)
    return out


def test_licenses_equal_the_plain_scan(spark):
    prose = "some words about nothing in particular here and there"
    files = [
        (1, TEMPLATES[4][1], "a/LICENSE"), (2, prose, "a/x.py"), (3, "# Released under the MIT License.\n" + prose, "b/y.py"), (4, prose, "b/z.py"), (5, prose, "a/b/c/deep.py"), (6, TEMPLATES[0][1], "a/b/COPYING"), (7, "Licensed under CC BY-NC 4.0.\n" + prose, "q"),
        (8, None, "a/b/n"), (9, "", "r/n"), (10, prose, None), (11, "the license of the the of", "a/w"), (12, TEMPLATES[5][1], "ab/LICENSE"), (13, prose, "abc/f"), (14, prose + "\n" + prose + "\nThis work is licensed under the GNU General Public License, version 3.", "t/u"), (15, TEMPLATES[1][1] + "\n" + TEMPLATES[4][1], "s/two"), (16, TEMPLATES[0][1].upper(), "a/b/COPYING2"),
    ]
    df = spark.createDataFrame(files, "doc_id long, text string, path string").withColumn("license", F.lit(1)).withColumn("directory", F.lit(1))
    got = {r.file_id: (r.license, r.evidence, r.directory) for r in scan_licenses(df).collect()}
    assert got == plain_scan(files, 0.7)
    assert got[5] == ("Apache-2.0", "inherited", "a/b") and got[2][1] == "inherited" and got[13] == (None, None, None)
    twice = scan_licenses(df.union(df.where("doc_id = 3"))).where("file_id = 3").collect()
    assert len(twice) == 2 and scan_licenses(df.limit(0)).collect() == []


def test_lines_without_a_heavy_term_cannot_reach_the_threshold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    total, frequency = document_frequencies(docs.select("text"))
    scorer = Scorer(total, frequency, 0.7)
    draw = random.Random(1)
    light = [t for t in scorer.idf if t not in scorer.needed]
    assert light and len(scorer.needed) < len(scorer.idf)
    for _ in range(2000):
        assert scorer.best([draw.choice(light) for _ in range(draw.randint(1, 8))])[0] < 0.7


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]
    now, seen = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF).cache()
        assert out.columns == docs.columns
        seen.append({r.doc_id: r for r in out.collect()})
        now = out
    first, lines, near, clean = seen
    lexicon = toxic_lexicon(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    verdict = {r.doc_id: r.kept for r in quality_rules(docs, lexicon=lexicon).collect()}
    assert set(first) == {d for d, kept in verdict.items() if kept}
    assert set(lines) == set(first) and all(len(lines[d].text) <= len(first[d].text) and lines[d].n_chars == len(lines[d].text) for d in lines)
    often = Counter(x for r in lines.values() for x in set(r.text.lower().split("\n")) if len(x.split()) >= 8)
    assert max(often.values()) == 1
    assert set(near) <= set(lines)
    prints = {d: fingerprint(r.text) for d, r in near.items()}
    ids = sorted(prints)
    assert not [1 for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 7]
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [1 for r in clean.values() for b in bench if b in r.text]
    assert all(any(b[:30] in near[d].text for b in bench) for d in set(near) - set(clean)) or not set(near) - set(clean)
    total = defaultdict(int)
    size = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        total[r.doc_id] += r.length
        size[r.doc_id] = r.doc_tokens
    assert set(total) == set(clean) and total == size
