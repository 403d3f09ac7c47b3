"""Exact encoding with the public BPE tokenizers, equal to the tokenizers library id by id.

A byte-level vocabulary is its merges' ranks: they are read from the tokenizer
file and merged by tiktoken, which holds no cache, so a worker's memory does
not grow with the words it meets.  The word vocabulary has a normaliser of its
own; there BPE never merges across a pre-token, and a space before a non-space
character always begins a new one, so a text is cut there, each piece encoded
once and the ids looked up again for every later use.  A new piece is put
together from its pre-tokens, which recur more.  Ids are little-endian 32-bit
bytes (the byte order of every machine that Spark runs on here), so that a whole document is one ``bytes.join``.

Special tokens that stand in a text are encoded as the library does by default
(one id each) if ``special`` is set, as in the queries; else they are ordinary
text.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Pre-token patterns of the two vocabularies (fixed values).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

_SPACE_BEFORE_WORD = re.compile(r" (?=\S)")
_ODD_SPACE = re.compile(r" (?:\s|$)")


def _byte_chars() -> dict[int, str]:
    """Byte-level vocabularies write a byte as a printable character: itself if it is one, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_CHARS = _byte_chars()


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Generations:
    """A bounded cache: when it is full, what was not used since the last time it was full goes."""

    def __init__(self, limit: int):
        self.limit = limit
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, keys: set[str]) -> list[str]:
        """Those of the keys that are not held; the others are in ``new`` from now on."""
        absent = keys.difference(self.new)
        if len(self.new) + len(absent) > self.limit:
            self.old, self.new = self.new, {}
            absent = keys
        old = self.old
        back = absent & old.keys()
        self.new.update(zip(back, map(old.__getitem__, back), strict=True))
        return list(absent - back)


def merge_ranks(tokenizer) -> dict[bytes, int] | None:
    """Ranks of a byte-level vocabulary whose ids stand in the order of its merges; None for any other."""
    state = json.loads(tokenizer.to_str())
    model, split = state["model"], state.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    if state.get("normalizer") or not plain or model.get("unk_token") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        return None
    own = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    if any(model["vocab"].get(m.replace(" ", "")) != 256 + i for i, m in enumerate(own)):
        return None
    back = {c: b for b, c in _BYTE_CHARS.items()}
    return {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(own)}


class PieceEncoder:
    """Encodes texts to id bytes.

    ``spaced``: the vocabulary keeps white space.  ``pieces`` and ``tokens``
    bound the entries of each generation of the word vocabulary's two caches.
    """

    def __init__(self, file: str, spaced: bool, pieces: int = 400_000, tokens: int = 500_000, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = not special
        own = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = re.compile("|".join(map(re.escape, own))).search if special and own else None
        self.merged = None
        if spaced and (ranks := merge_ranks(self.tokenizer)):
            import tiktoken

            self.merged = tiktoken.Encoding("own", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.spaced = spaced
        self.cut = regex.compile(WORD_PATTERN).findall
        self.pieces, self.tokens = Generations(pieces), Generations(tokens)
        self.tokenize = self.tokenizer.model.tokenize

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in found]

    def _many(self, tokens: list[str]) -> list[bytes]:
        """Ids of pre-tokens, merged by the vocabulary's model from their bytes."""
        tokenize, table = self.tokenize, _BYTE_CHARS
        spelt = [t if t.isascii() and t.isalnum() else t.encode().decode("latin-1").translate(table) for t in tokens]
        return [array("I", [x.id for x in tokenize(t)]).tobytes() for t in spelt]

    def _learn(self, missing: list[str]) -> None:
        latin = [w for w in missing if w.isascii() or max(w) <= "\xff"]
        cut = self.cut
        # a word of letters alone is one pre-token
        plain, mixed = [w for w in latin if w.isalpha()], [w for w in latin if not w.isalpha()]
        lower = [w.lower() for w in plain]
        parts = [cut(w.lower()) for w in mixed]
        new = self.tokens.missing(set(lower).union(chain.from_iterable(parts)))
        held = self.tokens.new
        held.update(zip(new, self._many(new), strict=True))
        get = held.__getitem__
        self.pieces.new.update(zip(plain, map(get, lower), strict=True))
        self.pieces.new.update(zip(mixed, [b"".join(map(get, p)) for p in parts], strict=True))
        rest = [w for w in missing if w not in self.pieces.new]
        if rest:
            self.pieces.new.update(zip(rest, self._whole(rest), strict=True))

    def encode(self, texts: list[str], group: int = 1_500_000) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        marked = [i for i, x in enumerate(texts) if self.marks(x)] if self.marks else []
        if marked:  # rare: the library itself cuts at special tokens
            whole = dict(zip(marked, self._whole([texts[i] for i in marked]), strict=True))
            rest = iter(self.encode([x for i, x in enumerate(texts) if i not in whole], group))
            return [whole[i] if i in whole else next(rest) for i in range(len(texts))]
        if self.merged:
            return [array("I", self.merged(x)).tobytes() for x in texts]
        if self.spaced:
            return self._whole(texts)
        out: list[bytes] = []
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= group or i == len(texts) - 1:
                out += self._encode(texts[start : i + 1])
                start, size = i + 1, 0
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Words are cut and numbered by Arrow: each distinct one is looked up once, and ids are gathered by their numbers."""
        plain = [not _ODD_SPACE.search(x) for x in texts]
        if not all(plain):
            odd = iter(self._by_words([x for x, p in zip(texts, plain, strict=True) if not p]))
            rest = iter(self._encode([x for x, p in zip(texts, plain, strict=True) if p]))
            return [next(rest) if p else next(odd) for p in plain]
        try:
            cut = pc.split_pattern(pa.array(texts, pa.string()), " ")
        except UnicodeEncodeError:  # lone surrogates
            return self._by_words(texts)
        numbered = cut.values.dictionary_encode()
        words, at = numbered.dictionary.to_pylist(), np.array(numbered.indices)
        if missing := self.pieces.missing(set(words)):
            self._learn(missing)
        held = self.pieces.new
        found = [held[w] for w in words]
        pool = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        n = sizes[at]
        ends = np.cumsum(n)
        place = np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - n), n)
        place += np.arange(len(place))
        data = pool[place].tobytes()
        edges = (4 * np.concatenate([[0], ends])[np.array(cut.offsets)]).tolist()
        return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        split = [_SPACE_BEFORE_WORD.split(x) if _ODD_SPACE.search(x) else x.split(" ") for x in texts]
        get = self.pieces.new.get
        found = [list(map(get, words)) for words in split]
        holes = [(words, own, [i for i, x in enumerate(own) if x is None]) for words, own in zip(split, found, strict=True) if None in own]
        if holes:
            missing = self.pieces.missing({words[i] for words, _, at in holes for i in at})
            if missing:
                self._learn(missing)
            held = self.pieces.new
            for words, own, at in holes:
                for i in at:
                    own[i] = held[words[i]]
        return list(map(b"".join, found))


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(file: str, spaced: bool) -> PieceEncoder:
    """One encoder for each file in a Python worker; special tokens in a text are those of the vocabulary."""
    if (file, spaced) not in _ENCODERS:
        _ENCODERS[file, spaced] = PieceEncoder(file, spaced, special=True)
    return _ENCODERS[file, spaced]
