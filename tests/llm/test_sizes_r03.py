"""Line deduplication in bounded rounds (op6_fuzzy_lines, line_dedup of the pipeline)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from bourseline.llm import lines


def _hashes(n: int, seed: int = 3) -> pa.RecordBatch:
    rng = np.random.default_rng(seed)
    columns = [pa.array(rng.integers(-(1 << 63), 1 << 63, n), pa.int64()) for _ in "szgh"]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(rng.integers(20, 120, n), pa.int32()), *columns], names=["a", "length", "s", "z", "g", "h"])


def test_rounds_send_a_share_of_the_entries_and_together_all_of_them():
    batch, chosen = _hashes(200), lines.masks()

    def sent(first, last):
        out = next(lines._spread(chosen[first:last], 8, first)(iter([batch])))
        return [x for share, *parts in zip(*(out.column(c).to_pylist() for c in ("share", "key", "a")), strict=True) for x in zip([share] * (len(parts[1]) // 8), np.frombuffer(parts[0], "<u4").tolist(), np.frombuffer(parts[1], "<i8").tolist(), strict=True)]

    whole = sent(0, len(chosen))
    rounds = [sent(i, min(len(chosen), i + lines.ROUND)) for i in range(0, len(chosen), lines.ROUND)]
    assert max(map(len, rounds)) == 2 * 200 * lines.ROUND < len(whole) / 4
    assert sorted(x for r in rounds for x in r) == sorted(whole)


def test_pairs_of_a_group_are_those_near_in_bits_and_length():
    rng = np.random.default_rng(4)
    for n in (120, 400):  # compared side by side, and row by row
        base = rng.integers(0, 1 << 63, n // 4).astype(np.uint64)
        sim = (np.repeat(base, 4) & ~np.uint64(255)) ^ (np.uint64(1) << rng.integers(8, 64, n).astype(np.uint64)) | rng.integers(60, 80, n).astype(np.uint64)
        more, line = np.zeros(n, np.uint32), np.arange(n)
        key = np.repeat(np.uint32(7), n)
        found = lines._met(pa.table({"share": [1], **{c: [x.tobytes()] for c, x in (("key", key), ("sim", sim), ("more", more), ("a", line.astype("<i8")))}}), 0.85)
        near = lambda i, j: bool(lines._candidates(sim[i], sim[j])) and bool(lines._sure(sim, more, i, np.array([j]), 0.85)[0])
        wanted = {(i, j) for i in range(n) for j in range(i + 1, n) if near(i, j)}
        assert wanted and set(zip(found["x"].to_pylist(), found["y"].to_pylist(), strict=True)) == wanted



def test_words_are_looked_up_once_for_each_distinct_one():
    from bourseline.llm.tokens import PieceEncoder, public_path

    enc = PieceEncoder(public_path("word_bpe_49k.json"), False, pieces=50, tokens=60)
    texts = ["the cat, the dog and the cat " * 200, "", "odd  spaces here \t and\nthere ", "Ünïcode ŵords naïve x\x01y 3a4b ÷   z", " lead", "ª µ ß ÿ"] * 3 + [f"w{i} v{i * i}, q{i}." for i in range(300)]
    whole = enc.tokenizer.encode_batch(texts, add_special_tokens=False)
    expected = [np.array(x.ids, "<u4").tobytes() for x in whole]
    assert enc.encode(texts) == expected and enc.encode(texts, group=40) == expected

    class Counted(dict):
        asked = 0

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

        def get(self, key, default=None):
            Counted.asked += 1
            return super().get(key, default)

    enc = PieceEncoder(public_path("word_bpe_49k.json"), False)
    enc.pieces.new = Counted()
    enc.encode([" ".join(["a bird and a tree"] * 5000)])
    assert Counted.asked <= 5
