"""Near-duplicate documents by Jaccard similarity of five-word shingles, against brute force over all pairs."""

import random

from test_near_duplicates import groups_of, plain_fingerprint

from sparkloom.llm.simhash_dedup import one_of_each_group


def test_one_of_each_group_at_a_similarity_equals_brute_force(spark):
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 5)))
    texts = [" ".join(word() for _ in range(draw.choice([4, 30, 100, 250]))) for _ in range(25)]
    for _ in range(110):
        words = draw.choice(texts).split()
        for _ in range(draw.randint(0, 1 + len(words) // 40)):
            words[draw.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += ["", None]
    sets = []
    for t in texts:
        words = (t or "").split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))})
    prints = [plain_fingerprint(t, 5) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))]
    by_bits = [(i, j) for i, j in pairs if (prints[i] ^ prints[j]).bit_count() <= 7]
    alike = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 and sets[i]]
    assert set(alike) - set(by_bits)
    want = set(groups_of(range(len(texts)), by_bits + alike).values())
    assert want != set(groups_of(range(len(texts)), by_bits).values())
    df = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, texts[5]), (None, "one more without an id"), (None, "a text of its own")], "doc_id long, text string")
    got = one_of_each_group(df, jaccard=0.8).collect()
    assert {r.doc_id for r in got if r.doc_id is not None} == want
    assert one_of_each_group(df.limit(0), jaccard=0.8).collect() == []
