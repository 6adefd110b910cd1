"""Each operator against a brute-force version, on odd rows and on no rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spindle.llm import chat, class_lm, decontaminate, huffman, langid, licenses, near_dedup, packing, quality, suffix_dedup
from spindle.llm.subword import Encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_near_duplicates(odd, odd_rows):
    got = {(r.doc_id, r.class_id) for r in near_dedup.near_duplicates(odd).collect()}
    ids = sorted({i for i, _ in odd_rows if i is not None})
    items = {i: x for i, x in zip(ids, near_dedup._text_items(pa.array([dict(odd_rows)[i] for i in ids])), strict=True)}
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and len(items[a]) and len(items[b]) and find(a) != find(b):
                x, y = items[a].tolist(), items[b].tolist()
                if 1.8 * len(set(x) & set(y)) >= 0.8 * (len(x) + len(y)) - 1e-6 and lcs(x, y) * 1.8 >= 0.8 * (len(x) + len(y)) - 1e-6:
                    parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {(i, find(i)) for i in ids} | {(None, None)}
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_hot_buckets_and_tiles(odd, monkeypatch):
    """Buckets and components of a few texts already are split: the classes stay the same."""
    want = {(r.doc_id, r.class_id) for r in near_dedup.near_duplicates(odd).collect()}
    monkeypatch.setattr(near_dedup, "HOT", 2)
    monkeypatch.setattr(near_dedup, "TILE", 4)
    assert {(r.doc_id, r.class_id) for r in near_dedup.near_duplicates(odd).collect()} == want


def test_near_duplicates_of_other_ids(odd):
    with pytest.raises(TypeError):
        near_dedup.near_duplicates(odd.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_recall_of_near_duplicates(spark):
    """Documents of the smallest table: all classes of an exact all-pairs run are found."""
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = {i: x for (i, _), x in zip(rows, near_dedup._text_items(pa.array([t for _, t in rows], pa.string())), strict=True)}
    links = set()
    for a in items:
        for b in items:
            x, y = items[a], items[b]
            if a < b and len(x) and len(y) and 1.8 * len(np.intersect1d(x, y)) >= 0.8 * (len(x) + len(y)) - 1e-6 and near_dedup.linked(x, y, len(np.intersect1d(x, y))):
                links.add((a, b))
    classes = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert links and all(classes[a] == classes[b] for a, b in links)


def test_banded_alignment():
    rng = random.Random(3)
    for _ in range(200):
        a, b = rng.sample(range(60), rng.randint(1, 40)), rng.sample(range(60), rng.randint(1, 40))
        best = lcs(a, b)
        for least in (1, max(1, best), best + 1):
            got = near_dedup.aligned(np.array(a), np.array(b), least)
            assert got <= best and (got >= least) == (best >= least)


def test_language_id(spark, odd):
    rng = random.Random(1)
    kinds = {"xx": ["foo", "bar", "baz"], "yy": ["ünd", "schön", "über"]}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(12)), k) for i in range(80) for k in [rng.choice(["xx", "yy"])]]
    rows += [(900, None, "xx"), (901, "", "xx"), (902, "12 !", "yy"), (903, "foo bar", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where(langid.remainder() != 2))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:80])
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "xx"]
    assert got[900].score == 0.0 and 0 <= got[903].score <= 1
    assert langid.predict(odd, model).count() == odd.count()
    empty = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}


@pytest.mark.parametrize(("path", "kind"), [(WORD, "words"), (BYTE, "spaced")])
def test_encoder_equals_library(path, kind):
    rng = random.Random(1)
    parts = [*"ab Z\n\t  é\x1f'.,!9́ßÀµªİΣ", "<|endoftext|>", "<|ENDOFTEXT|>", " the", "\n\n", "'s", " Word."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    library = Tokenizer.from_file(path)
    want = [np.array(x.ids, "<u2").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
    encoder = Encoder(path, kind)
    for _ in range(2):
        assert [x.tobytes() for x in encoder.encode(texts)] == want


@pytest.mark.parametrize(("path", "kind"), [(WORD, "words"), (BYTE, "spaced")])
def test_encoder_forgets_and_relearns(path, kind, monkeypatch):
    monkeypatch.setattr("spindle.llm.subword.MEMO_PIECES", 20)
    texts = [f"some words {i % 7} and others{i % 11}, it's 'quoted' é{'x' * (i % 60)}" for i in range(200)]
    library, encoder = Tokenizer.from_file(path), Encoder(path, kind)
    for i in range(0, 200, 10):
        want = [np.array(x.ids, "<u2").tobytes() for x in library.encode_batch(texts[i : i + 10], add_special_tokens=False)]
        assert [x.tobytes() for x in encoder.encode(texts[i : i + 10])] == want


def test_huffman_file(spark, odd, odd_rows):
    docs = odd.where("doc_id is not null")
    path = huffman.write(spark, docs, WORD, "words", 1)
    library, at = Tokenizer.from_file(WORD), 0
    got = sorted((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in huffman.read(spark, path).collect())
    sums = sorted((r.start, r.ids_crc32) for r in huffman.read_checksums(spark, path).collect())
    for (start, _, n, ids), (i, text), (begin, crc) in zip(got, sorted((i, t or "") for i, t in odd_rows if i is not None), sums, strict=True):
        want = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert (start, n, ids, crc, begin) == (at, len(want), want.tobytes(), zlib.crc32(want.tobytes()), at)
        at += len(want)
    assert huffman.read(spark, huffman.write(spark, docs.limit(0), WORD, "words", 1)).count() == 0


def test_code_lengths():
    rng = np.random.default_rng(0)
    for n in (2, 3, 100, 5000):
        counts = rng.zipf(1.2, n) * (rng.random(n) < 0.9)
        counts[:2] = 1
        lengths = huffman.code_lengths(counts)
        used = lengths[counts > 0].astype(float)
        assert used.max() <= huffman.MAX_BITS and abs((2.0**-used).sum() - 1) < 1e-9
    fib = np.array([1, 1] + [0] * 28)
    for i in range(2, 30):
        fib[i] = fib[i - 1] + fib[i - 2]
    assert huffman.code_lengths(fib).max() == huffman.MAX_BITS


def test_decontamination(spark, odd):
    rng = random.Random(5)
    items = [(k, "".join(rng.choice("abcdefgh ") for _ in range(n))) for k, n in enumerate([20, 40, 63, 64, 65, 100, 150])]
    rows = [(0, None), (1, "")]
    for d in range(2, 80):
        t = list(rng.choice(items)[1][rng.randint(0, 20) :])
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
        rows.append((d, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 30))) + "".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (50, None)], "item_id long, text string")
    want = set()
    for d, t in rows:
        for k, x in items:
            w, e, _ = decontaminate.budget(len(x))
            if len(x) >= decontaminate.SHORTEST and t and any(decontaminate.distance(x[s : s + w].encode(), t.encode())[0] <= e for s in range(len(x) - w + 1)):
                want.add((d, k))
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()} == want and want
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert decontaminate.clean(odd, bench.limit(0)).count() == odd.count()


def first_place(items, texts):
    index = decontaminate.Index([(k, t.encode()) for k, t in enumerate(items)])
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    return decontaminate.find(index, np.frombuffer(b"".join(raw), np.uint8), offs)


def test_places_of_matches():
    rng = random.Random(1)
    item = "".join(rng.choice("abcdefgh ") for _ in range(90))
    other = "".join(rng.choice("stuvwxyz ") for _ in range(300))
    got = first_place([item], [other + item + other, item + other + item, other, item[:70]])
    assert got == [(0, 0, 300, 390), (1, 0, 0, 90), (3, 0, 0, 70)]


@pytest.mark.parametrize("unit", [" ", "-=", "ab "])
def test_periodic_texts_are_searched_in_bounded_work(unit, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE", 5000)
    rng = random.Random(2)
    item = "".join(rng.choice("abcdefgh ") for _ in range(90))
    text = unit * (200_000 // len(unit))
    got = first_place([(unit * 120)[:120], item], [text + item, "q" * 50_000, text[:40]])
    assert [(r, i) for r, i, _, _ in got] == [(0, 0), (0, 1)]
    assert abs(got[1][2] - len(text)) <= 5 and abs(got[1][3] - len(text) - 90) <= 5


def test_slices_find_the_same(monkeypatch):
    rng = random.Random(4)
    items = ["".join(rng.choice("ab ") for _ in range(80)) for _ in range(6)]
    texts = ["".join(rng.choice("ab ") for _ in range(60)) + rng.choice(items) + "".join(rng.choice("ab ") for _ in range(300)) for _ in range(20)]
    want = {(r, i) for r, i, _, _ in first_place(items, texts)}
    monkeypatch.setattr(decontaminate, "SLICE", 200)
    assert {(r, i) for r, i, _, _ in first_place(items, texts)} == want and len(want) >= 20


def test_matches_hang_on_text_and_item_alone(monkeypatch):
    """The same places alone, in one chunk with others, beside other items, and in any slices."""
    rng = random.Random(8)
    items = ["ab" * 40, "-" * 200, "".join(rng.choice("ab ") for _ in range(90)), "abcabcab" * 9, " " * 40, "".join(rng.choice("abcdefgh ") for _ in range(33))]
    texts = ["ab" * 50] * 30 + ["-" * 70, "x " + "ab" * 600 + " and an end", items[2] * 3]
    for _ in range(60):
        parts = [rng.choice([rng.choice(items), rng.choice(["ab", "-", "abc", "a b "]) * rng.randint(1, 400), "".join(rng.choice("ab ") for _ in range(rng.randint(0, 99)))]) for _ in range(rng.randint(1, 4))]
        texts.append("".join(parts)[rng.randint(0, 9) :])
    texts += ["".join(f"w{rng.random()} " for _ in range(20_000)), "", "ab"]
    alone = [(r, i, a, b) for r, t in enumerate(texts) for i, x in enumerate(items) for _, _, a, b in first_place([x], [t])]
    assert first_place(items, texts) == alone
    assert [(r, a, b) for r, i, a, b in alone if i == 0 and r < 30] == [(r, 0, 100) for r in range(30)]
    assert [(a, b) for r, i, a, b in alone if (r, i) == (31, 0)] == [(2, 1202)]
    for size in (100, 3000):
        monkeypatch.setattr(decontaminate, "SLICE", size)
        assert first_place(items, texts) == alone


def test_several_blocks_and_repeated_items(spark, monkeypatch):
    rng = random.Random(6)
    items = [(k // 2, "".join(rng.choice("abcdefgh ") for _ in range(80))) for k in range(12)]
    docs = spark.createDataFrame([(d, f"{rng.random()} {items[d % 12][1]} {items[d % 12][1]} end") for d in range(24)] + [(99, "clean text"), (5, items[5][1])], "doc_id long, text string")
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    want = Counter((d, d % 12 // 2) for d in range(24)) + Counter([(5, 2)])
    for size in (8 << 20, 200):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        assert Counter((r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()) == want
        assert [r.doc_id for r in decontaminate.clean(docs, bench).collect()] == [99]


def stats(text):
    w = words_of(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_texts_with_more_words_than_packed_places(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(quality, "_PLACES", 15)
    got = Counter((r.doc_id, r.n_repeat_words) for r in quality.base_stats(odd.where("length(text) < 20000")).collect())
    assert got == Counter((i, stats(t)[4]) for i, t in odd_rows if t is not None and len(t) < 20_000)


def test_quality(spark, odd, odd_rows):
    docs = odd.unionByName(spark.createDataFrame([(500, "a\x0bb\x0cf ff # a b f\n x\nx \n\nx\n x")], "doc_id long, text string"), allowMissingColumns=True)
    got = quality.base_stats(docs).collect()
    want = Counter((i, *stats(t)) for i, t in [*odd_rows, (500, "a\x0bb\x0cf ff # a b f\n x\nx \n\nx\n x")])
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert quality.fit(odd, spark.createDataFrame([], "doc_id long, quality int")) == []
    rng = random.Random(2)
    rows = [({f: rng.random() for f in quality.FEATURES}, 0) for _ in range(600)]
    rows = [(x, int(x["symbol_share"] > 0.8 or (x["upper_share"] > 0.7 and x["mark_share"] <= 0.3))) for x, _ in rows]
    rules = quality.learn(rows)
    said = [any(r.holds(x) for r in rules) for x, _ in rows]
    assert sum(a == bool(y) for a, (_, y) in zip(said, rows, strict=True)) > 0.95 * len(rows)
    assert {r.kept for r in quality.assess(odd, rules).where("base_failed").collect()} == {False}


def test_chat(spark):
    rng = random.Random(1)
    parts = ["\\", "#", "###", "</turn>", "<next/>", "\n", "a", ": ", "h", "\\h", "", "é😀", "</turn>\n", "'"]
    rows = [(rng.randint(0, 20), rng.randint(0, 3), rng.choice(["user", "assistant", "a: b###\\"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))) for _ in range(300)]
    rows += [(50, None, None, None), (None, 1, "assistant", "x"), rows[0]]
    turns = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id int, turn int, role string, text string, formatted int, t string")
    grouped = defaultdict(list)
    for c, t, r, x in rows:
        grouped[c].append(((t is not None, t or 0), r or "", x or ""))
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert set(out) == set(grouped)
    for c, v in grouped.items():
        v.sort()
        assert [(t.role, t.text) for t in out[c].turns] == [(r, x) for _, r, x in v]
        assert out[c].losses == [x for _, r, x in v if r == "assistant"]
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_packing(spark, odd, odd_rows):
    out = packing.pack(spark, odd, BYTE, "spaced", 2).collect()
    library, want = Tokenizer.from_file(BYTE), Counter()
    for i, t in odd_rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        want.update((i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in out)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for v in bins.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 1024
    counts = Counter(r.length for r in out)
    assert len(bins) <= sum(k for _, k in packing.best_fit_decreasing(dict(counts), 1024))
    assert packing.pack(spark, odd.limit(0), BYTE, "spaced", 2).count() == 0


def fewest_bins(items, size):
    """By trying every place for every piece."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[i] <= size}.values():
            bins[k] += items[i]
            go(i + 1, bins)
            bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_bins_are_as_few_as_can_be():
    rng = random.Random(3)
    for _ in range(400):
        size = rng.choice([10, 20, 50, 100])
        items = [rng.randint(1, rng.choice([size, size // 2, size // 3])) for _ in range(rng.randint(1, 13))]
        assert sum(k for _, k in packing.solve(dict(Counter(items)), size)) == fewest_bins(items, size)


def test_bins_of_many_short_pieces():
    assert sum(k for _, k in packing.solve({28: 50, 8: 450}, 100)) == 50


def test_fillings_are_undominated():
    assert list(packing.fillings({8: 450}, 72)) == [(8,) * 9]
    assert list(packing.fillings({28: 49, 8: 450}, 72)) == [(28, 28, 8, 8), (8,) * 9]
    assert list(packing.fillings({30: 1, 20: 2, 10: 2}, 40)) == [(30, 10), (20, 20)]
    assert list(packing.fillings({}, 5)) == [()] and list(packing.fillings({3: 1}, 0)) == [()]


def test_bins_hold_all():
    rng = random.Random(4)
    for n, top in ((0, 5), (30, 20), (200, 20), (8, 20)):
        counts = Counter(rng.randint(1, top) for _ in range(n))
        bins = packing.solve(dict(counts), 20)
        used = Counter()
        for items, k in bins:
            assert sum(items) <= 20
            for x in items:
                used[x] += k
        assert used == counts
        best = sum(k for _, k in packing.best_fit_decreasing(dict(counts), 20)) if n else 0
        assert -(-sum(a * b for a, b in counts.items()) // 20) <= sum(k for _, k in bins) <= best


def test_licenses(spark, odd):
    texts = list(licenses.TEMPLATES.values())
    rng = random.Random(6)
    rows = [(None, texts[0]), (0, None), (1, ""), (2, "Licensed")]
    for i in range(3, 60):
        t = texts[i % len(texts)].split()
        if i % 3 == 0:
            t[rng.randrange(len(t))] = "other"
        rows.append((i, " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(0, 30))) + "\n" + " ".join(t).upper() + " and so on"))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, template int")
    got = {(r.doc_id, r.template): round(r.containment, 9) for r in licenses.scan(docs).collect()}

    def grams(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = {}
    for i, t in rows:
        w = licenses.plain_words(t)
        for name, text in licenses.TEMPLATES.items():
            x = licenses.plain_words(text)
            wide, step, all_ = -(-3 * len(x) // 2), max(1, len(x) // 2), grams(x)
            share = max((len(grams(w[s : s + wide]) & all_) / len(all_) for s in range(0, max(1, len(w) - 4), step)), default=0)
            if share >= 0.8:
                want[i, name] = round(share, 9)
    assert got == want and len(want) > 20
    assert licenses.scan(odd).count() == 0 and licenses.scan(docs.limit(0)).count() == 0


def repeats(rows, depth=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - depth + 1) if i is not None else ():
            first[b[k : k + depth]] = min(i, first.get(b[k : k + depth], i))
    out = []
    for i, t in rows:
        b, gone = (t or "").encode(), set()
        for k in range(len(b) - depth + 1) if i is not None else ():
            if first[b[k : k + depth]] < i:
                gone.update(range(k, k + depth))
        kept = bytes(x for k, x in enumerate(b) if k not in gone)
        out.append((i, len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_suffix_dedup(spark, odd, odd_rows):
    short = [(i, t if not t or len(t) < 20_000 else t[:5000]) for i, t in odd_rows]
    docs = odd.withColumn("text", F.when(F.length("text") >= 20_000, F.substring("text", 1, 5000)).otherwise(F.col("text")))
    out = suffix_dedup.dedup(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out) == repeats(short)
    assert all(r.row.n_words == r.doc_id for r in out)
    assert suffix_dedup.dedup(odd.limit(0)).count() == 0


def test_class_scores(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(class_lm, "FREQUENT", 40)
    rest = langid.remainder(by=10)
    got = class_lm.score(odd, rest != 0, rest == 0).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, ends = Counter(), 0
    for i, t in odd_rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            counts.update(words_of((t or "").translate(lower)))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    want = []
    for i, t in odd_rows:
        w = words_of((t or "").translate(lower))
        base = sum(math.log10(counts[x] + 0.1) for x in w) + math.log10(ends + 0.1) - (len(w) + 1) * math.log10(n + 0.1 * (v + 1))
        want.append((i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n, f"{base:.6f}", str(i)))
    assert Counter((r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.6f}", str(r.doc_id)) for r in got) == Counter(want)
    assert all(r.score < 0 for r in got)
    assert class_lm.score(odd.limit(0), rest != 0, rest == 0).count() == 0
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_classes_of_words_beyond_the_first(spark, monkeypatch):
    """Words of one last byte that always alternate are told apart, though only four words are clustered first."""
    monkeypatch.setattr(class_lm, "CLUSTERED", 4)
    monkeypatch.setattr(class_lm, "CLASSES", 4)
    rng = random.Random(5)
    a, b = [f"a{i}x" for i in range(40)], [f"b{i}x" for i in range(40)]
    rows = [(i, " ".join(f"{rng.choice(a)} {rng.choice(b)}" for _ in range(50))) for i in range(100)]
    rows += [(100, " ".join(f"{x} {y}" for x, y in zip(a, b, strict=True))), (101, " ".join(a + b))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in class_lm.score(docs, F.col("doc_id") < 100, F.col("doc_id") >= 100).collect()}
    assert got[100] > got[101] + 20


def test_classes_of_words_beyond_the_table(spark, monkeypatch):
    """The same, for words that the table does not hold: no word that training holds is left in the class of its last byte."""
    monkeypatch.setattr(class_lm, "FREQUENT", 8)
    monkeypatch.setattr(class_lm, "CLASSES", 4)
    rng = random.Random(6)
    a, b = [f"a{i}x" for i in range(40)], [f"b{i}x" for i in range(40)]
    often = [0] * 400 + [1] * 400 + [2] * 400 + [3] * 400 + list(range(4, 40)) * 4
    rows = [(i, " ".join(f"{a[rng.choice(often)]} {b[rng.choice(often)]}" for _ in range(50))) for i in range(100)]
    rare = [f"{x} {b[k % 4]} {a[k % 4]} {y}" for k, (x, y) in enumerate(zip(a[4:], b[4:], strict=True))]
    rows += [(i, t) for i, t in enumerate(rare, 200)]
    rows += [(100, " ".join(f"{x} {y}" for x, y in zip(a[4:], b[4:], strict=True))), (101, " ".join(a[4:] + b[4:])), (102, None), (103, "new words only")]
    docs = spark.createDataFrame(rows + rows[-4:], "doc_id long, text string")
    learn = ~F.col("doc_id").between(100, 199)
    got = class_lm.score(docs, learn, ~learn).collect()
    assert len(got) == len(rows) + 4
    got = {r.doc_id: r.score for r in got}
    assert got[100] > got[101] + 20


def test_a_word_beyond_the_table_goes_to_its_best_class():
    rng = np.random.default_rng(1)
    for case in range(100):
        classes, total = 4, 9
        seq, word = rng.integers(0, total, 80), rng.random(80) < 0.12
        seq = np.where(np.arange(80) % 3 == 0, seq % 2, seq) if case % 2 else seq
        word[[0, 1, -1]] = False, True, False
        own = int(rng.integers(classes, total))

        def joint(of):
            out = np.zeros((total, total))
            units = np.where(word, of, seq)
            np.add.at(out, (units[:-1], units[1:]), 1)
            return out, units

        counted, units = joint(own)
        at = np.flatnonzero(word)
        got = class_lm.move_rest(counted, np.array([own]), np.zeros(len(at), np.int64), units[at - 1], units[at + 1], word[at + 1].astype(np.uint8), classes, 1)[0]
        reached = {k: class_lm.likelihood(joint(k)[0]) for k in (*range(classes), own)}
        assert reached[int(got)] > max(reached.values()) - 1e-6


def test_hashes_that_collide_change_nothing(spark, odd_rows, monkeypatch):
    """All strings have one hash: the bytes alone tell what is equal."""
    whole = suffix_dedup.stretches

    def alike(data, offs, depth):
        row, start, end, place, h = whole(data, offs, depth)
        return row, start, end, place, h & np.uint64(0)

    monkeypatch.setattr(suffix_dedup, "stretches", alike)
    short = [(i, t if not t or len(t) < 20_000 else t[:3000]) for i, t in odd_rows]
    out = suffix_dedup.dedup(spark.createDataFrame(short, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out) == repeats(short)


def test_radix_passes_order_windows():
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(60, 80))) for _ in range(60)]
    texts += [t[:55] + "x" + t[55:] for t in texts[:20]]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    start = np.concatenate([np.arange(a, b - 50 + 1) for a, b in zip(at[:-1], at[1:])])
    owner = np.searchsorted(at, start, side="right") - 1
    which, least = suffix_dedup.equal_windows(suffix_dedup._digits(data), start, owner, np.zeros(len(start), np.int64), 50)
    by = defaultdict(set)
    for s, o in zip(start, owner):
        by[data[s : s + 50].tobytes()].add(int(o))
    want = {int(k): min(by[data[start[k] : start[k] + 50].tobytes()]) for k in range(len(start)) if len(by[data[start[k] : start[k] + 50].tobytes()]) > 1}
    assert dict(zip(which.tolist(), least.tolist())) == want and want


def test_repeats_of_other_ids(odd):
    with pytest.raises(TypeError):
        suffix_dedup.dedup(odd.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_pipeline_keeps_one_row_of_a_class(spark):
    import corpus_pipeline

    t, u, v = ("one text of more than five words", "this other text is like no other", "a third one without any doc id")
    docs = spark.createDataFrame([(1, t), (1, t), (2, t), (3, t), (3, u), (None, t), (None, v), (4, ""), (4, "")], "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, t), (3, u), (None, v), (4, "")])


def test_pipeline_stages(spark, tmp_path):
    import os

    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    first, kept = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == first.columns and docs.count()
            kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert kept[0] >= kept[1] == kept[2] >= kept[3]
    bench = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert not any(b in r.text for r in spark.read.parquet(f"{tmp_path}/3").collect() for b in bench)
    assert {r.doc_id for r in docs.collect()} == kept[3]
