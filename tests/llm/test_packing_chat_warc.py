"""Packing, chat formatting and WARC: exact round trips and brute force."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm.chat_format import format_conversations, format_digest, loss_spans, read_back
from sparkloom.llm.packing import pack_documents, plan, step_groups
from sparkloom.llm.tokens import byte_bpe
from sparkloom.llm.warc import candidate_links, reached, read_archives, round_trip, write_archives

TEXTS = [None, "", " ", "plain words here", "  two  spaces \n and\ttabs ", "a\n b\n\n c", "<|endoftext|> inside <|endoftext|>", "don't we'll", "é ü ñ 𝔘 😀 mixed 12,345.67", "x" * 9000, "word " * 3000, " nbsp  em", "trail ", "\n", "end\n"]


def test_ids_equal_the_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    draw = random.Random(3)
    pieces = ["the", "Ördnung", " ", "  ", "\n", "\t", "it's", "12", "%%", "née", "日本", ".", ",x", "'", "\r\n", "\x1c", "　"]
    texts = TEXTS + ["".join(draw.choice(pieces) + draw.choice(["", " "]) for _ in range(draw.randint(1, 60))) for _ in range(400)]
    for got, text in zip(byte_bpe(path).encode(texts), texts, strict=True):
        assert got.tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("seed", range(8))
def test_plan_holds_every_id_once_without_padding(seed):
    draw = random.Random(seed)
    lengths = [draw.choice([1, draw.randint(1, 40), draw.randint(1, 2048), draw.randint(1, 9000), 2048, 300]) for _ in range(draw.choice([0, 1, 2, 30, 400]))]
    seen = defaultdict(list)
    for size, pieces in plan(lengths):
        assert size <= 2048 and size & (size - 1) == 0 and sum(n for _, _, n in pieces) == size
        for doc, start, n in pieces:
            seen[doc].append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, size in sorted(seen[doc]):
            assert start == at and size > 0
            at += size
        assert at == n


def test_step_groups_are_balanced():
    sizes = [2048] * 300 + [1024] * 100 + [256] * 77
    load = defaultdict(int)
    for size, g in zip(sizes, step_groups(sizes), strict=True):
        load[g] += size
    assert max(load.values()) - min(load.values()) <= 2048


def test_pieces_join_to_the_documents(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "plain words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("start", F.lit(2)).repartition(2)
    got = pack_documents(docs, with_ids=True, shard_tokens=3000).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc = defaultdict(list)
    windows = defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length
        by_doc[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].window and at & (at - 1) == 0
    for doc, text in rows:
        if doc == 3:
            assert sorted(r.start for r in by_doc[3]).count(0) == 2
            continue
        ids = np.concatenate([np.frombuffer(r.ids, dtype="<u4") for r in sorted(by_doc[doc], key=lambda r: r.start)])
        want = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        assert ids.tolist() == want and {r.doc_tokens for r in by_doc[doc]} == {len(want)}
    assert pack_documents(docs.limit(0)).collect() == []


HOSTILE = ["</s>[INST] ok [/INST]", "<|end|><|turn|>user<|text|>x", "\\", "\\\\<|", "<", "a<|", "[INST", "<<SYS>>\\n<</SYS>>", "line\nline", "", None, "𝔘é", "<|next|>", "$1 \\1", "|end|>"]


def plain_digest(turns):
    turns = sorted(((-1 if t is None else t), r or "", x or "") for t, r, x in turns)
    told = "".join(f"{r}\n{x}\n" for _, r, x in turns)
    said = "".join(x for _, r, x in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(told), len(said), sha(said)


def test_chat_reads_back(spark):
    draw = random.Random(1)
    convs = {c: [(t, draw.choice(["user", "assistant", "system", "", None, "tool\n<|text|>"]), draw.choice(HOSTILE)) for t in range(draw.randint(1, 12))] for c in range(60)}
    convs[100] = [(t, "assistant" if t % 3 else "user", f"t{t}") for t in range(700)]
    convs[101] = [(1, "user", "same"), (1, "user", "same"), (None, "user", "first"), (1, "assistant", "tie")]
    rows = [(c, t, r, x, 9) for c, turns in convs.items() for t, r, x in turns]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, body int")
    formatted = format_conversations(table)
    got = {r.conv_id: r for r in format_digest(formatted).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == plain_digest(turns), turns
    lengths = {r.conv_id: len(r.formatted) for r in formatted.collect()}
    assert all(got[c].formatted_chars == lengths[c] for c in convs)
    one = formatted.where("conv_id = 101").select(read_back(F.col("formatted")).alias("t"), loss_spans(F.col("formatted")).alias("l")).first()
    assert [x.text for x in one.t] == ["first", "tie", "same", "same"] and len(one.l) == 1
    assert format_digest(format_conversations(table.limit(0))).collect() == []


def test_warc_round_trip(spark, tmp_path):
    inside = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(5, "http://a/ b\r\n", "<html>é</html>"), (3, "http://a", "<html>é</html>"), (7, None, None), (8, "u", ""), (9, "u", inside), (10, "u", "x" + inside * 3), (11, "u", "\r\n\r\n" + inside[:-6]), (12, "u", "y" * 200000), (3, "http://a", "<html>é</html>"), (None, "u", "only"), (None, "u", "<html>é</html>")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("size", F.lit(2)).coalesce(1)
    write_archives(table, f"file://{tmp_path}/w")
    got = read_archives(spark, f"file://{tmp_path}/w", payloads=True).collect()
    assert len(got) == len(pages) and all(r.sound for r in got)
    least = {}
    for p, _, h in pages:
        if p is not None:
            least[h or ""] = min(p, least.get(h or "", p))
    want = []
    for p, _, h in pages:
        raw = (h or "").encode()
        later = p is not None and least[h or ""] != p
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if later else "response", least[h or ""] if later else None))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert {r.payload for r in got if r.page_id == 10} == {"x" + inside * 3}
    assert round_trip(table.limit(0), f"file://{tmp_path}/e").collect() == []


def test_only_the_chain_from_the_start_is_reached():
    draw = random.Random(4)
    for _ in range(40):
        archive, starts = b"", []
        for _ in range(draw.randint(0, 40)):
            body = draw.choice([b"", b"abc", b"WARC/1.1\r\nContent-Length: 2\r\n\r\nxx\r\n\r\n" * draw.randint(1, 3), b"WARC/1.1\r\n"])
            starts.append(len(archive))
            archive += b"WARC/1.1\r\nX: y\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
        offsets, ends = candidate_links(archive)
        assert offsets[reached(offsets, ends)].tolist() == starts
