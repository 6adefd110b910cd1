"""Brown class-based bigram scores.

Tokens are words (ASCII lower case) and one end per document.  Exchange
clustering moves one word at a time to the class that raises the likelihood of
the class bigrams most.  It puts the ``CLUSTERED`` most frequent training words
into ``CLASSES`` classes on one machine, from the bigrams of the words, until no
word moves (``FIRST_ROUNDS`` rounds at most).  Then
all ``FREQUENT`` words are moved among these classes, the others out of the
class of their last byte, in ``ROUNDS`` rounds of distributed exchange: a turn
counts one of ``PARTS`` parts of the words before and after each class,
summed by blocks of words, and a block moves its words one after another (all
words at once would overshoot); the classes of the turn with the highest
likelihood are used.

All other words that training holds, however rare, are moved once, in buckets
by hash: a bucket has the classes before and after each occurrence of its words
and moves these in blocks, most frequent first, out of the class of their last
byte where the likelihood gains.  Each text then gets the classes of its words
back, and the class bigrams are counted anew.  Words that training does not hold
are in the class of their last byte.  A text's score is the sum over its tokens of

    log10 P(class | class of the token before) + log10 P(token | class),

both smoothed; the document end is a class of its own and stands before the
first token.  Counts are exact over all training documents:

* ``FREQUENT`` words (a bounded table, broadcast) are counted and scored where
  the text is read;
* all other words go to buckets by hash, a bucket counts its words, moves them and
  returns per occurrence its word's count and class; only these are moved, and they
  grow with the corpus.

Words are known by 64-bit hashes of their bytes.

Defined results: a null or empty text is its end alone.  Rows with one doc_id
are scored each, rows repeated in full alike; all of them count in training.
A row without doc_id is scored, but is neither held out nor learned from.
Without training rows every count is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm.store import Workspace, even_labels, release, shuffle_partitions
from spindle.llm.packed import folder_of, open_, put, rows as packed_rows
from spindle.llm.textnum import LOWER, chunks, span_hashes, splitmix, text_buffers, word_spans

FREQUENT = 1 << 16
CLUSTERED = 512
CLASSES = 48
#: Rounds over the CLUSTERED words, at most: each raises the likelihood, the first without a move ends them.
FIRST_ROUNDS = 30
ROUNDS = 2
PARTS = 3
_FLUSH = 400_000
_BLOCK = 512  # words beyond the table that are moved at a time
_SEEN = 4  # a frequent word occurs so often in some stretch of _STRETCH words
_STRETCH = 400_000
_RARE = 255  # stands in a text's classes for a word outside the table

#: Class of a word by its last byte.
SHAPE = np.full(256, 2, np.uint8)
SHAPE[ord(".")], SHAPE[ord(",")] = 0, 1
SHAPE[ord("0") : ord("9") + 1] = 3
SHAPE[128:] = 4
SHAPE[ord("a") : ord("z") + 1] = 5 + np.arange(26)
SHAPES = 31


def _words(column: pa.Array):
    """Per chunk: (first row, row after the last, first word of each text, word hashes, shapes, text hashes)."""
    for i, j, data, offs in chunks(column):
        data = LOWER[data]
        start, end, first = word_spans(data, offs)
        yield i, j, first, span_hashes(data, start, end), SHAPE[data[end - 1]] if len(end) else np.zeros(0, np.uint8), span_hashes(data, offs[:-1], offs[1:]) if len(data) else np.zeros(j - i, np.uint64)


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, words: int, classes: int, rounds: int = FIRST_ROUNDS) -> np.ndarray:
    """Classes 0..classes-1 of the first ``words`` units of the bigram counts;
    every other unit is and stays a class of its own."""
    units = len(bigrams)
    of = np.concatenate([np.arange(words) % classes, classes + np.arange(units - words)])
    total = classes + units - words
    member = np.zeros((units, total))
    member[np.arange(units), of] = 1
    out, into = bigrams @ member, bigrams.T @ member
    joint = member.T @ out

    for _ in range(rounds):
        moved = 0
        for w in range(words):
            c, self_ = of[w], bigrams[w, w]
            o, i = out[w].copy(), into[w].copy()
            o[c] -= self_
            i[c] -= self_
            joint[c] -= o
            joint[:, c] -= i
            joint[c, c] -= self_
            # likelihood gained by putting w into each class
            row, col = joint[:classes], joint[:, :classes].T
            gain = (_h(row + o) - _h(row)).sum(axis=1) + (_h(col + i) - _h(col)).sum(axis=1)
            k = np.arange(classes)
            gain += _h(joint[k, k] + o[k] + i[k] + self_) - _h(joint[k, k] + o[k]) - _h(joint[k, k] + i[k]) + _h(joint[k, k])
            r, s = joint.sum(axis=1)[:classes], joint.sum(axis=0)[:classes]
            gain -= _h(r + o.sum() + self_) - _h(r) + _h(s + i.sum() + self_) - _h(s)
            best = int(np.argmax(gain))
            best = c if gain[best] <= gain[c] + 1e-9 else best
            joint[best] += o
            joint[:, best] += i
            joint[best, best] += self_
            if best != c:
                moved += 1
                of[w] = best
                for x, y in ((out, bigrams[:, w]), (into, bigrams[w])):
                    x[:, c] -= y
                    x[:, best] += y
        if not moved:
            break
    return of


def likelihood(joint: np.ndarray) -> float:
    """Log-likelihood of class bigrams, but for the part that no class changes."""
    return float(_h(joint).sum() - _h(joint.sum(axis=1)).sum() - _h(joint.sum(axis=0)).sum())


def move(joint: np.ndarray, of: np.ndarray, out: np.ndarray, into: np.ndarray, own: np.ndarray, classes: int) -> np.ndarray:
    """New classes, of the first ``classes``, of words with classes ``of``, given
    their counts before (``out``) and after (``into``) each class and beside
    themselves (``own``); words without counts stay."""
    of, joint = of.copy(), joint.copy()
    k = np.arange(classes)
    n = out.sum(axis=1)
    for w in np.argsort(-n, kind="stable")[: np.count_nonzero(n)]:
        c, self_, o, i = of[w], own[w], out[w].copy(), into[w].copy()
        o[c] -= self_
        i[c] -= self_
        joint[c] -= o
        joint[:, c] -= i
        joint[c, c] -= self_
        # likelihood gained by putting w into each class; only cells beside its neighbours change
        after, before, diagonal = np.flatnonzero(o), np.flatnonzero(i), joint[k, k]
        row, col = joint[:classes, after], joint[before, :classes].T
        gain = (_h(row + o[after]) - _h(row)).sum(axis=1) + (_h(col + i[before]) - _h(col)).sum(axis=1)
        gain += _h(diagonal + o[k] + i[k] + self_) - _h(diagonal + o[k]) - _h(diagonal + i[k]) + _h(diagonal)
        r, s = joint.sum(axis=1)[:classes], joint.sum(axis=0)[:classes]
        gain -= _h(r + o.sum() + self_) - _h(r) + _h(s + i.sum() + self_) - _h(s)
        best = int(np.argmax(gain))
        best = c if c < classes and gain[best] <= gain[c] + 1e-9 else best
        joint[best] += o
        joint[:, best] += i
        joint[best, best] += self_
        of[w] = best
    return of


def move_rest(joint: np.ndarray, own: np.ndarray, word: np.ndarray, before: np.ndarray, after: np.ndarray, same: np.ndarray, classes: int, share: int) -> np.ndarray:
    """New classes of words with classes ``own``, beyond the first ``classes``, given
    for each occurrence its word, the classes of its neighbours and whether the
    next word is the same.  A word moves to the one of the first ``classes`` that
    raises the likelihood most, if any does.  These words are one part in ``share``
    of all that move at a time, so the bigrams ``joint`` follow ``share``-fold."""
    joint, new, total = joint.astype(float), own.copy(), len(joint)
    n = np.bincount(word, minlength=len(own))
    by = np.argsort(-n, kind="stable")
    rank = np.empty(len(own), np.int64)
    rank[by] = np.arange(len(own))
    rank = rank[word]
    order = np.argsort(rank, kind="stable")
    rank, before, after, same = rank[order], before[order].astype(np.int64), after[order].astype(np.int64), same[order]
    upto = np.append(0, np.cumsum(n[by]))
    k = np.arange(classes)
    a, size = 0, 1
    while a < len(own):
        b = min(len(own), a + size)
        size = min(2 * size, _BLOCK)
        m, part = b - a, slice(upto[a], upto[b])
        w, c, times = rank[part] - a, own[by[a:b]], n[by[a:b]]
        each = np.arange(m)
        out = np.bincount(w * total + after[part], minlength=m * total).reshape(m, total).astype(float)
        into = np.bincount(w * total + before[part], minlength=m * total).reshape(m, total).astype(float)
        self_ = np.bincount(w, same[part], minlength=m)
        out[each, c] -= self_
        into[each, c] -= self_
        r, s = joint.sum(axis=1), joint.sum(axis=0)
        # likelihood gained, from the state without the word, by putting it into each class, and by leaving it
        d = joint[k, k]
        gain = _h(d + out[:, :classes] + into[:, :classes] + self_[:, None]) - _h(d)
        gain -= _h(r[k] + times[:, None]) - _h(r[k]) + _h(s[k] + times[:, None]) - _h(s[k])
        d = joint[c, c]
        stay = _h(d) - _h(d - out[each, c] - into[each, c] - self_)
        stay -= _h(r[c]) - _h(r[c] - times) + _h(s[c]) - _h(s[c] - times)
        for cells, one, other in ((joint, out, into), (joint.T, into, out)):
            x, y = np.nonzero(one)
            add, mine = one[x, y], y == c[x]
            base = cells[:classes, y].T - mine[:, None] * other[x, :classes]
            more = _h(base + add[:, None]) - _h(base)
            diagonal = np.flatnonzero(y < classes)
            more[diagonal, y[diagonal]] = 0
            base = cells[c[x], y]
            less = np.where(mine, 0, _h(base) - _h(base - add))
            first = np.searchsorted(x, each)  # every word has a neighbour that is not itself
            gain += np.add.reduceat(more, first)
            stay += np.add.reduceat(less, first)
        best = np.argmax(gain, axis=1)
        moved = np.flatnonzero(gain[each, best] > stay + 1e-9)
        old, best = c[moved], best[moved]
        new[by[a + moved]] = best
        for cells, one in ((joint, out), (joint.T, into)):
            np.subtract.at(cells, old, share * one[moved])
            np.add.at(cells, best, share * one[moved])
        np.subtract.at(joint, (old, old), share * self_[moved])
        np.add.at(joint, (best, best), share * self_[moved])
        np.maximum(joint, 0, out=joint)
        a = b
    return new


def _spread(work: Workspace, texts: DataFrame, shared, of: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all frequent words, begun from ``of``, and the class bigrams under them."""
    spark = work.spark
    labels = even_labels(spark, shuffle_partitions(spark))
    size = -(-len(of) // len(labels))  # words of a block
    place = {label: k for k, label in enumerate(labels)}
    width = 2 * total + 1  # a word's counts before each class, after each class, beside itself
    kind = np.int32 if len(labels) * size * width < 1 << 31 else np.int64
    shapes = total - 1 - SHAPES
    best = None

    def encode(batches):
        known = shared.value
        place = np.append(np.arange(len(known)), -1)
        for b in batches:
            for _, _, first, h, shape, _ in _words(b.column(0)):
                token, _ = _units(first, _lookup(known, h), place, shape, len(known))
                yield pa.RecordBatch.from_arrays([pa.array([token.astype("<u4").tobytes()], pa.binary())], ["tokens"])

    # places in the table, then rare words by shape, then the end: read in every turn instead of the texts
    tokens = work.write(texts.mapInArrow(encode, "tokens binary"), "tokens")

    for turn in range(ROUNDS * PARTS + 1):
        classes = spark.sparkContext.broadcast(of)
        last = turn == ROUNDS * PARTS

        def count(batches):
            of = np.concatenate([classes.value, np.arange(shapes, total)])
            joint = np.zeros(total * total, np.int64)
            held, n = [], 0

            def out():
                key = np.sort(np.concatenate(held))
                new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                times, key = np.diff(np.append(new, len(key))).astype("<u4"), key[new]
                block = key // (size * width)
                cut = np.searchsorted(block, np.arange(len(labels) + 1))
                rows = [(labels[k], 0, (key[a:b] - k * size * width).astype("<u4").tobytes(), times[a:b].tobytes()) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]
                return packed_rows(rows, ["block", "base", "keys", "n"])

            for b in batches:
                for raw in b.column(0):
                    token = np.append(np.frombuffer(raw.as_buffer(), "<u4"), np.uint32(len(of) - 1))
                    seq = of[token]
                    joint += np.bincount(seq[:-1] * total + seq[1:], minlength=total * total)
                    if last:
                        continue
                    p = np.flatnonzero((token < len(of) - 1 - SHAPES) & (token % PARTS == turn % PARTS))
                    w = token[p].astype(kind) * kind(width)
                    same = token[p] == token[p + 1]
                    held += [w + seq[p + 1].astype(kind), w + (total + seq[p - 1]).astype(kind), w[same] + kind(2 * total)]
                    n += 2 * len(p)
                    if n >= 10 * _FLUSH:
                        yield out()
                        held, n = [], 0
            if n:
                yield out()
            yield packed_rows([(-1 - c, 0, b"", row.tobytes()) for c, row in enumerate(joint.reshape(total, total))], ["block", "base", "keys", "n"])

        def add(table):
            n = np.sum([np.frombuffer(x.as_py(), np.int64) for x in table.column("n")], axis=0)
            return pa.table({"row": pa.array([-1 - table.column("block")[0].as_py()], pa.int32()), "n": [n.tobytes()]})

        counted = work.write(tokens.mapInArrow(count, "block int, base bigint, keys binary, n binary"), "neighbours")
        joint = np.zeros((total, total))
        # a row per class
        for r in counted.where("block < 0").select("block", "n").groupBy("block").applyInArrow(add, "row int, n binary").collect():
            joint[r["row"]] = np.frombuffer(r["n"], np.int64)
        # from PARTS on every word has been moved out of the class of its last byte
        if turn >= PARTS and (best is None or likelihood(joint) > likelihood(best[1])):
            best = of, joint
        if last:
            break
        frame = spark.sparkContext.broadcast(joint)

        def choose(table):
            k = place[table.column("block")[0].as_py()]
            of = classes.value[k * size : (k + 1) * size]
            counts = np.zeros(len(of) * width)
            for key, n in zip(table.column("keys"), table.column("n"), strict=True):
                counts[np.frombuffer(key.as_py(), "<u4")] += np.frombuffer(n.as_py(), "<u4")
            counts = counts.reshape(len(of), width)
            new = move(frame.value, of, counts[:, :total], counts[:, total:-1], counts[:, -1], shapes)
            at = np.flatnonzero(new != of)
            return pa.table({"word": pa.array(at + k * size, pa.int32()), "class": pa.array(new[at], pa.int32())})

        # a row per moved word
        moved = counted.where("block >= 0").groupBy("block").applyInArrow(choose, "word int, class int").toArrow()
        work.drop(counted)
        release(spark)
        of = of.copy()
        of[moved.column(0).to_numpy()] = moved.column(1).to_numpy()
    work.drop(tokens)
    return best


def _frequent(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of frequent training words, and their shapes."""

    def count(batches):
        held, shapes, size = [], [], 0

        def out():
            h, at, n = np.unique(np.concatenate(held), return_index=True, return_counts=True)
            keep = n >= _SEEN
            return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(np.concatenate(shapes)[at[keep]].astype(np.int32)), pa.array(n[keep])], ["word", "shape", "n"])

        for b in batches:
            for _, _, _, h, shape, _ in _words(b.column(0)):
                held.append(h)
                shapes.append(shape)
                size += len(h)
                if size >= _STRETCH:
                    yield out()
                    held, shapes, size = [], [], 0
        if size:
            yield out()

    seen = train.select("_text").mapInArrow(count, "word bigint, shape int, n bigint").groupBy("word").agg(F.max("shape").alias("shape"), F.sum("n").alias("n"))
    top = seen.orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    h = top.column(0).to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], top.column(1).to_numpy()[order].astype(np.int64)


def _lookup(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in ``known``, len(known) where missing."""
    if not len(known):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, len(known))


def _units(first: np.ndarray, at: np.ndarray, unit_of: np.ndarray, shape: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The units of all tokens of a chunk, each text led by an end, and the places of these."""
    unit = unit_of[at]
    unit = np.where(unit < 0, words + shape.astype(np.int64), unit)
    return _led(unit, first, words + SHAPES)


def _led(units: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The units of all tokens of some texts, each led by an end, and the places of these."""
    n = len(first) - 1
    out = np.full(len(units) + n, end)
    lead = first[:-1] + np.arange(n)
    inner = np.ones(len(out), bool)
    inner[lead] = False
    out[inner] = units
    return out, lead


def score(docs: DataFrame, train: Column, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    work = Workspace(spark, "classes")
    source = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("_held"), F.coalesce(train, F.lit(False)).alias("_train"), F.col("text").alias("_text"))
    learned = source.where("_train")
    known, known_shape = _frequent(learned)
    words = min(CLUSTERED, len(known))
    shared = spark.sparkContext.broadcast(known)

    def count(batches):
        known = shared.value
        total, ends = np.zeros(len(known) + 1, np.int64), 0
        for b in batches:
            ends += b.num_rows
            for _, _, _, h, _, _ in _words(b.column(0)):
                total += np.bincount(_lookup(known, h), minlength=len(known) + 1)
        total[-1] = ends
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    counts = np.zeros(len(known) + 1, np.int64)
    for r in learned.select("_text").mapInArrow(count, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] = r["n"]
    train_docs, counts = int(counts[-1]), counts[:-1]
    unit_of = np.full(len(known) + 1, -1)
    unit_of[np.argsort(-counts, kind="stable")[:words]] = np.arange(words)
    units = words + SHAPES + 1
    unit_shared = spark.sparkContext.broadcast(unit_of)

    def pairs(batches):
        known, unit_of = shared.value, unit_shared.value
        total = np.zeros(units * units, np.int64)
        for b in batches:
            for _, _, first, h, shape, _ in _words(b.column(0)):
                u, _ = _units(first, _lookup(known, h), unit_of, shape, words)
                total += np.bincount(u * units + np.append(u[1:], words + SHAPES), minlength=units * units)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    bigrams = np.zeros(units * units)
    table = learned.select("_text").mapInArrow(pairs, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    if table.num_rows:
        bigrams[table.column(0).to_numpy()] = table.column(1).to_numpy()
    bigrams = bigrams.reshape(units, units)
    classes = min(CLASSES, max(1, words))
    class_of = exchange(bigrams, words, classes)
    total = classes + SHAPES + 1
    member = np.zeros((units, total))
    member[np.arange(units), class_of] = 1
    joint = member.T @ bigrams @ member
    # the class of each frequent word, and of all others by their last byte
    word_class = np.where(unit_of[:-1] < 0, classes + known_shape, class_of[np.maximum(unit_of[:-1], 0)]) if len(known) else np.zeros(0, np.int64)
    if len(known) > words:
        word_class, joint = _spread(work, learned.select("_text"), shared, word_class, total)
    word_class = word_class.astype(np.int64)

    labels = np.array(even_labels(spark, shuffle_partitions(spark)))
    n = len(labels)
    model = spark.sparkContext.broadcast((known, np.append(word_class, -1), joint))

    def file_rare(batches):
        known, class_of, _ = model.value
        held, size = [], 0

        def out():
            h, key, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
            return packed_rows(put(labels, h % np.uint64(n), key, h, *rest), ["bucket", "base", "keys", "word", "place", "shape", "flags", "before", "after"])

        for b in batches:
            ids = _ids(b.column(0))
            learn = b.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
            for i, j, first, h, shape, whole in _words(b.column(2)):
                at = _lookup(known, h)
                rare = np.flatnonzero(at == len(known))
                row = np.searchsorted(first, rare, side="right") - 1
                c, _ = _units(first, at, class_of, shape, classes)
                c = np.append(c, total - 1).astype(np.uint8)
                place = np.arange(len(rare)) - np.searchsorted(rare, first[:-1])[row]
                same = (rare + 1 < first[row + 1]) & (np.append(h, np.uint64(0))[rare + 1] == h[rare])
                flags = learn[i:j][row] + 2 * same.astype(np.uint8)
                held.append((h[rare], _key(ids[i:j], whole)[row], place.astype("<u4"), shape[rare], flags, c[rare + row], c[rare + row + 2]))
                size += len(rare)
                if size >= _FLUSH:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def bucket_classes(table):
        key, h, place, shape, flags, before, after = open_(table, "<u8", "<u4", "u1", "u1", "u1", "u1")
        order = np.lexsort((place, key, h))
        key, h, place, flags = key[order], h[order], place[order], flags[order]
        stats, rows = np.zeros((2, total), np.int64), []
        if len(h):
            step = np.concatenate([[True], h[1:] != h[:-1]])
            word, new = np.cumsum(step) - 1, np.flatnonzero(step)
            learn = (flags & 1).astype(np.int64)
            c = np.add.reduceat(learn, new)
            of = classes + shape[order[new]].astype(np.int64)
            if c.any():
                at = np.flatnonzero(learn)
                of[c > 0] = move_rest(model.value[2], of[c > 0], (np.cumsum(c > 0) - 1)[word[at]], before[order[at]], after[order[at]], flags[at] >> 1, classes, n)
            stats[0] = np.bincount(of, c, total)
            stats[1] = np.bincount(of, c > 0, total)
            # rows repeated in full: one answer for all
            once = np.flatnonzero(step | np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] != place[:-1])]))
            rows = put(labels, folder_of(key[once], n), key[once], place[once], of[word[once]].astype(np.uint8), c[word[once]].astype("<u4"))
        return pa.Table.from_batches([packed_rows([*rows, (-1, 0, b"", stats.tobytes(), b"", b"")], ["folder", "base", "keys", "place", "class", "n"])])

    filed = source.select("doc_id", "_train", "_text").mapInArrow(file_rare, "bucket int, base bigint, keys binary, word binary, place binary, shape binary, flags binary, before binary, after binary")
    answers = work.write(filed.groupBy("bucket").applyInArrow(bucket_classes, "folder int, base bigint, keys binary, place binary, class binary, n binary"), "rare", "lz4")
    release(spark)
    # one row per bucket
    stats = np.sum([np.frombuffer(r["place"], np.int64) for r in answers.where("folder = -1").select("place").collect()] or [np.zeros(2 * total, np.int64)], axis=0)

    def by_text(table):
        key, place, of, c = open_(table, "<u4", "u1", "<u4")
        order = np.lexsort((place, key))
        key, of, c = key[order], of[order], c[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        value, hit = (np.add.reduceat(x, first) if len(key) else x for x in (np.log10(c + 0.1), (c > 0).astype(np.int64)))
        return pa.table({"_key": key[first], "_value": value, "_hit": hit, "_classes": _bytes(of, np.append(first, len(key)))})

    rare = answers.where("folder >= 0").groupBy("folder").applyInArrow(by_text, "_key bigint, _value double, _hit bigint, _classes binary")
    logs = np.append(np.log10(counts + 0.1), 0.0)  # rare words: their buckets have it
    log_shared = spark.sparkContext.broadcast(logs)

    def encode(batches):
        known, class_of, _ = model.value
        logs = log_shared.value
        class_of = np.where(class_of < 0, _RARE, class_of).astype(np.uint8)
        for b in batches:
            ids = _ids(b.column(0))
            cols = [np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)]
            seq = [np.zeros(0, np.uint8)]
            for i, j, first, h, _, whole in _words(b.column(3)):
                at = _lookup(known, h)
                size = np.diff(first)
                cols[0][i:j] = _key(ids[i:j], whole)
                cols[1][i:j] = size + 1
                cols[2][i:j] = np.add.reduceat(np.append(at < len(known), False).astype(np.int64), first[:-1]) * (size > 0)
                cols[3][i:j] = np.add.reduceat(np.append(logs[at], 0.0), first[:-1]) * (size > 0)
                seq.append(class_of[at])
            ends = np.append(0, np.cumsum(cols[1] - 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *map(pa.array, cols), _bytes(np.concatenate(seq), ends)], ["doc_id", "held_out", "_train", "_key", "n_tokens", "_known", "_logs", "_seq"])

    def fill(batches):
        for b in batches:
            seq, offs = text_buffers(b.column(6))
            of, _ = text_buffers(b.column(7))
            seq = seq.copy()
            seq[seq == _RARE] = of
            yield pa.RecordBatch.from_arrays([*b.columns[:6], _bytes(seq, offs)], [*b.schema.names[:6], "_seq"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    head = f"doc_id {id_type}, held_out boolean, _train boolean"
    encoded = source.select("doc_id", "_held", "_train", "_text").mapInArrow(encode, f"{head}, _key bigint, n_tokens bigint, _known bigint, _logs double, _seq binary")
    value, hit = F.coalesce("_value", F.lit(0.0)), F.coalesce("_hit", F.lit(0))
    joined = encoded.join(rare, "_key", "left").select("doc_id", "held_out", "_train", "n_tokens", (F.col("_known") + hit).alias("_known"), (F.col("_logs") + value).alias("_logs"), "_seq", "_classes")
    texts = work.write(joined.mapInArrow(fill, f"{head}, n_tokens bigint, _known bigint, _logs double, _seq binary"), "texts")
    work.drop(answers)
    release(spark)

    def bigrams_of(batches):
        counted = np.zeros(total * total, np.int64)
        for b in batches:
            for _, _, seq, offs in chunks(b.column(0)):
                c, _ = _led(seq, offs, total - 1)
                counted += np.bincount(c * total + np.append(c[1:], total - 1), minlength=total * total)
        at = np.flatnonzero(counted)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counted[at])], ["at", "n"])

    joint = np.zeros(total * total)
    table = texts.where("_train").select("_seq").mapInArrow(bigrams_of, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    if table.num_rows:
        joint[table.column(0).to_numpy()] = table.column(1).to_numpy()
    joint = joint.reshape(total, total)
    transition = np.log10((joint + 0.5) / (joint.sum(axis=1, keepdims=True) + 0.5 * total))

    big_v = int((counts > 0).sum() + stats[total:].sum() + (train_docs > 0))
    big_n = int(counts.sum() + stats[:total].sum() + train_docs)
    class_n, class_v = stats[:total].astype(float), stats[total:].astype(float)
    np.add.at(class_n, word_class, counts)
    np.add.at(class_v, word_class, counts > 0)
    norm = np.log10(class_n + 0.1 * (class_v + 1))
    norm[-1] = 0.0
    base_norm = float(np.log10(big_n + 0.1 * (big_v + 1)))
    end_log = float(np.log10(train_docs + 0.1))
    last_shared = spark.sparkContext.broadcast((transition, norm))

    def apply(batches):
        transition, norm = last_shared.value
        for b in batches:
            steps = np.zeros(b.num_rows)
            for i, j, seq, offs in chunks(b.column(5)):
                c, lead = _led(seq, offs, total - 1)
                following = np.append(c[1:], total - 1)  # the class of the next token; the end after the last word
                steps[i:j] = np.add.reduceat(transition[c, following] - norm[following], lead)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(steps)], [*b.schema.names[:5], "_steps"])

    scored = texts.select("doc_id", "held_out", "n_tokens", "_known", "_logs", "_seq").mapInArrow(apply, f"doc_id {id_type}, held_out boolean, n_tokens bigint, _known bigint, _logs double, _steps double")
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("_known") + F.lit(int(train_docs > 0))).cast("bigint").alias("n_known"),
        F.lit(big_n).cast("bigint").alias("train_tokens"),
        (F.col("_logs") + F.lit(end_log) - F.col("n_tokens") * F.lit(base_norm)).alias("base_score"),
        (F.col("_steps") + F.col("_logs")).alias("score"),
    )


def _bytes(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype("<i8")), pa.py_buffer(data.astype(np.uint8))]).cast(pa.binary())


def _ids(column: pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type):
        return column.fill_null(-(1 << 62)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    raise TypeError("doc_id is an integer")


def _key(ids: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Key of a row: equal for rows with the same doc_id and text."""
    return splitmix(splitmix(ids) ^ whole).view(np.int64) >> 1
