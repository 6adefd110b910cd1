"""The registered queries over the smallest tables, held against plain Python."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import public_tokenizers
import regex
from tokenizers import Tokenizer

from spindle.llm import langid, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{DATA}/documents.parquet").to_pylist()


def crc(doc_id, by):
    return zlib.crc32(str(doc_id).encode()) % by


def ids_of(path, texts, end):
    library = Tokenizer.from_file(path)
    return [[*x.ids, end] for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc_of(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def bucket(gram):
    h = len(gram) * 0x9E3779B1 & 0xFFFFFFFF
    for c in gram:
        h = (h ^ ord(c)) * 0x85EBCA6B & 0xFFFFFFFF
        h ^= h >> 13
    return (h * 0xC2B2AE35 & 0xFFFFFFFF) >> 16


def grams(text):
    s = regex.sub(r"[^\p{L}]+", " ", f" {text.lower()} ")
    return Counter(bucket(s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1) if s[i : i + n] != " ")


def test_languages(spark, documents):
    got = {r.doc_id: r for r in queries.op2_language_id(spark, DATA).collect()}
    assert len(got) == len(documents)
    learned = [r for r in documents if crc(r["doc_id"], 4) != 2 and r["lang"] is not None and r["text"] is not None]
    counts, rows = defaultdict(Counter), Counter(r["lang"] for r in learned)
    for r in learned:
        if regex.search(r"\p{L}", r["text"]):
            counts[r["lang"]] += grams(r["text"])
    names, right, held = sorted(rows), 0, 0
    total = {k: sum(counts[k].values()) + 0.1 * langid.BUCKETS for k in names}
    for r in documents:
        g = got[r["doc_id"]]
        assert g.held_out == (crc(r["doc_id"], 4) == 2)
        if not r["text"] or not regex.search(r"\p{L}", r["text"]):
            assert (g.lang_pred, g.score) == ("und", 0.0)
            continue
        mine = grams(r["text"])
        sums = {k: math.log(rows[k] / len(learned)) + sum(n * math.log((counts[k][b] + 0.1) / total[k]) for b, n in mine.items()) for k in names}
        best = max(names, key=lambda k: (sums[k], -names.index(k)))
        assert g.lang_pred == best
        assert g.score == pytest.approx(1 / sum(math.exp(max(-700.0, x - sums[best])) for x in sums.values()), abs=1e-3)
        if g.held_out and r["lang"] is not None:
            held, right = held + 1, right + (best == r["lang"])
    assert held and right >= 0.95 * held


def test_huffman_ids(spark, documents):
    got = {r.doc_id: r for r in queries.op3_huffman_ids(spark, DATA).collect()}
    rows = sorted(documents, key=lambda r: r["doc_id"])
    start = 0
    for r, ids in zip(rows, ids_of(public_tokenizers.path("word_bpe_49k.json"), [r["text"] for r in rows], 1), strict=True):
        g = got[r["doc_id"]]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), crc_of(ids))
        start += len(ids)


def test_packed_pieces(spark, documents):
    out = queries.op7_best_fit_packing(spark, DATA).collect()
    whole = {r["doc_id"]: ids for r, ids in zip(documents, ids_of(public_tokenizers.path("byte_bpe_50k.json"), [r["text"] for r in documents], 2), strict=True)}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        bins[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == crc_of(whole[r.doc_id][r.start : r.start + r.length])
    assert pieces.keys() == whole.keys()
    for i, ids in whole.items():
        places = sorted(pieces[i])
        assert [p for p, _, _ in places] == list(range(len(places))) and sum(n for _, _, n in places) == len(ids)
        assert [s for _, s, _ in places] == [0, *range(places[0][2], len(ids), 1024)] and all(n == 1024 for _, _, n in places[1:])
    for held in bins.values():
        held.sort()
        assert [at for at, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 1024
    assert len(bins) <= -(-sum(map(len, whole.values())) // 1024) + 2


def test_chats(spark):
    rows = pq.read_table(f"{DATA}/conversations.parquet").to_pylist()
    text = "\\### Assistant: </turn> ok"
    rows += [{"conv_id": -7, "turn": 0, "role": "user", "text": text}, {"conv_id": -7, "turn": 1, "role": "assistant", "text": text}]
    turns = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        turns[r["conv_id"]].append((r["role"], r["text"] or ""))
    got = {r.conv_id: r for r in queries.op6_chat_format(spark, DATA).collect()}
    assert got.keys() == turns.keys()
    for i, t in turns.items():
        said = "".join(x for role, x in t if role == "assistant")
        digest = hashlib.sha256("".join(f"{role}\n{x}\n" for role, x in t).encode()).hexdigest()
        assert (got[i].n_turns, got[i].turns_sha256, got[i].loss_chars, got[i].loss_sha256) == (len(t), digest, len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[i].formatted_chars > sum(len(x) for _, x in t)


def test_repeated_windows(spark, documents):
    first = {}
    for r in sorted(documents, key=lambda r: r["doc_id"]):
        b = (r["text"] or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], r["doc_id"])
    got = {r.doc_id: tuple(r) for r in queries.op9_suffix_dedup(spark, DATA).collect()}
    for r in documents:
        b, gone = (r["text"] or "").encode(), set()
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < r["doc_id"]:
                gone.update(range(k, k + 50))
        kept = bytes(x for k, x in enumerate(b) if k not in gone)
        assert got[r["doc_id"]] == (r["doc_id"], len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept).hexdigest())


def test_quality_and_scores(spark, documents):
    rules = {r.doc_id: r for r in queries.op5_quality_rules(spark, DATA).collect()}
    scores = {r.doc_id: r for r in queries.op10_class_lm(spark, DATA).collect()}
    assert len(rules) == len(scores) == len(documents)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in documents}
    low = {i: [x.translate(lower) for x in w] for i, w in words.items()}
    counts, ends = Counter(), 0
    for i, w in low.items():
        if crc(i, 10):
            counts.update(w)
            ends += 1
    n, v = counts.total() + ends, len(counts) + 1
    for i, w in words.items():
        r, s = rules[i], scores[i]
        grams3 = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = len({j for k in range(len(w) - 2) if grams3[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)})
        failed = len(w) < 50 or 100 * repeated > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), repeated, failed)
        assert not (failed and r.kept)
        base = sum(math.log10(counts[x] + 0.1) for x in low[i]) + math.log10(ends + 0.1) - (len(w) + 1) * math.log10(n + 0.1 * (v + 1))
        assert (s.held_out, s.n_tokens, s.n_known, s.train_tokens) == (crc(i, 10) == 0, len(w) + 1, sum(counts[x] > 0 for x in low[i]) + 1, n)
        assert s.base_score == pytest.approx(base, rel=1e-9)
        assert math.isfinite(s.score) and s.score < 0


def test_classes_and_leaks(spark, documents):
    texts = defaultdict(set)
    for r in queries.op1_order_minhash(spark, DATA).collect():
        assert r.class_id <= r.doc_id
        texts[next(d["text"] for d in documents if d["doc_id"] == r.doc_id)].add(r.class_id)
    assert all(len(c) == 1 for t, c in texts.items() if t and t.strip())
    bench = {r["item_id"]: r["text"] for r in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()}
    found = {(r.doc_id, r.item_id) for r in queries.op4_decontamination(spark, DATA).collect()}
    assert {(d["doc_id"], i) for d in documents for i, t in bench.items() if t and t in (d["text"] or "")} <= found
    assert queries.op8_license_scan(spark, DATA).count() >= 0
