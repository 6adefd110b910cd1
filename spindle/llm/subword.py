"""Public subword tokenizers with a bounded memo of pieces.

Both vocabularies cut a text into pieces (a run of letters, of digits, of
marks) before merging, so the ids of a text are the ids of its pieces in order.
Arrow cuts a batch of texts with the vocabulary's own pattern and numbers the
distinct pieces; ids are kept per piece in a memo of at most ``MEMO_PIECES``
entries per Python worker, new pieces go through the tokenizers library, and
numpy gathers the ids of the texts.  Texts for which the cut is not certain
(characters beyond Latin-1, runs of white space, special tokens) are encoded
whole by the library.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from spindle.llm.textnum import ranges

MEMO_PIECES = 400_000
_LONG = 48
#: Bytes as byte-level vocabularies write them: visible ones as themselves, the rest from U+0100 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _VISIBLE)}
#: The vocabularies' pattern over Latin-1; a piece ends with the mark.
_MARK = "\x01"
_LETTER, _DIGIT = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc\u00bd\u00be"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_CUT = {
    "words": f"\\s*(?:{_SHORT}|[{_LETTER}]+|[{_DIGIT}]|[^\\s{_LETTER}{_DIGIT}]+)|\\s+",
    "spaced": f"{_SHORT}| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^\\s{_LETTER}{_DIGIT}]+|\\s",
}
#: Texts that the pattern does not cut for certain.
_WHOLE = {"words": "[^\t\n\r -~\u00a1-\u00ff]|<\\|", "spaced": "[^\n -~\u00a1-\u00ff]|<\\||\\s\\s"}
_encoders: dict[tuple[str, str], "Encoder"] = {}


def encoder(path: str, kind: str) -> "Encoder":
    """The worker's encoder of a tokenizer file.  kind: ``words`` if white
    space is dropped, ``spaced`` if a word owns the space before it."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]


class Encoder:
    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        if kind not in _CUT:
            raise ValueError(f"unknown kind of tokenizer: {kind}")
        self.kind, self.tokenizer = kind, Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.memo: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}
        # the merges of the same file without its normaliser and pattern
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        edge = (lambda t: t.endswith("</w>")) if kind == "words" else (lambda t: t.startswith("\u0120"))
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.edge[[i for t, i in vocab.items() if edge(t)]] = True

    def _alone(self, tokenizer, texts: list[str]) -> list[bytes]:
        """Each text by itself."""
        return [array(self.dtype.char, x.ids).tobytes() for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merge(self, pieces: list[str]) -> list[bytes]:
        """Pieces by the merges alone; those whose first or last token shows their edge share a text."""
        joint = [p for p in pieces if self.kind == "words" or p[0] == " "]
        space = "\u0120" if self.kind == "spaced" else ""
        bare = [p[1:] for p in joint] if space else joint
        coded = [space + (p if p.isascii() else p.encode().decode("latin-1").translate(_BYTE_CHARS)) for p in bare]
        wide, known = self.dtype.itemsize, {}
        runs = [slice(i, i + 512) for i in range(0, len(joint), 512)]
        for i in range(0, len(runs), 16):
            found = self.merges.encode_batch_fast([" ".join(coded[r]) for r in runs[i : i + 16]], add_special_tokens=False)
            for r, x in zip(runs[i : i + 16], found, strict=True):
                raw = array(self.dtype.char, x.ids).tobytes()
                edge = np.flatnonzero(self.edge[np.frombuffer(raw, self.dtype)])
                cuts = [0, *((edge + 1) * wide).tolist()] if self.kind == "words" else [*(edge * wide).tolist(), len(raw)]
                mine = joint[r]
                if len(cuts) != len(mine) + 1:
                    raise ValueError("the ids of joined pieces do not fall apart")
                known.update(zip(mine, [raw[a:b] for a, b in zip(cuts, cuts[1:])], strict=True))
        if len(joint) == len(pieces):
            return list(map(known.__getitem__, pieces))
        rest = [p for p in pieces if p not in known]
        known.update(zip(rest, self._alone(self.tokenizer, rest), strict=True))
        return list(map(known.__getitem__, pieces))

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, from the memo as far as they are there."""
        out = list(map(self.memo.get, pieces))
        if missing := [k for k, x in enumerate(out) if x is None]:
            names = [pieces[k] for k in missing]
            older = list(map(self.before.get, names))
            new = list(dict.fromkeys(p for p, x in zip(names, older, strict=True) if x is None))
            fresh = dict(zip(new, self._merge(new), strict=True))
            found = [fresh[p] if x is None else x for p, x in zip(names, older, strict=True)]
            for k, x in zip(missing, found, strict=True):
                out[k] = x
            if len(self.memo) + len(missing) > MEMO_PIECES // 2:
                self.before, self.memo = self.memo, {"": b""}  # pieces that recur are taken over, the rest is forgotten
            self.memo.update((p, x) for p, x in zip(names, found, strict=True) if len(p) <= _LONG)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as ``self.dtype``."""
        column = pa.array(texts, pa.large_string())
        hard = pc.match_substring_regex(column, _WHOLE[self.kind]).to_numpy(zero_copy_only=False)
        easy = column.filter(pa.array(~hard)) if hard.any() else column
        if self.kind == "words":
            easy = pc.utf8_lower(easy)  # as the tokenizer does
        parts = pc.split_pattern(pc.replace_substring_regex(easy, _CUT[self.kind], "\\0" + _MARK), _MARK)
        coded = parts.flatten().dictionary_encode()
        distinct = coded.dictionary if self.kind == "spaced" else pc.ascii_ltrim_whitespace(coded.dictionary)
        ids = self._pieces(distinct.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        buffer, at = np.frombuffer(b"".join(ids), self.dtype), coded.indices.to_numpy()
        start = np.cumsum(size) - size
        n_of = size[at]
        gathered = buffer[ranges(start[at], n_of)]
        ends = np.concatenate([[0], np.cumsum(n_of)])[np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])]
        out = [gathered[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        if hard.any():
            whole = iter(self._alone(self.tokenizer, [t for t, h in zip(texts, hard, strict=True) if h]))
            rest = iter(out)
            out = [np.frombuffer(next(whole), self.dtype) if h else next(rest) for h in hard]
        return out


def text_batches(texts: list[str | None], most: int = 1 << 20):
    """Yield (first index, texts) with about ``most`` characters each; null is empty."""
    i, size, held = 0, 0, []
    for j, t in enumerate(texts):
        held.append(t or "")
        size += len(held[-1])
        if size >= most:
            yield i, held
            i, size, held = j + 1, 0, []
    if held:
        yield i, held
