import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestar.llm import packing
from tokenizers import Tokenizer

PATH = packing.public_tokenizer()


def best_fit(sizes, capacity):
    """One at a time: large ones in greedy pairs, then the others to the smallest gap that takes them."""
    large, gaps = sorted((s for s in sizes if 3 * s > capacity), reverse=True), []
    while large:
        s = large.pop(0)
        fits = [k for k, o in enumerate(large) if o <= capacity - s]
        gaps.append(capacity - s - (large.pop(fits[0]) if fits else 0))
    for s in sorted((s for s in sizes if 3 * s <= capacity), reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - s)
    return sorted(gaps)


def laid(rows, sizes):
    """Sequences as lists of (offset, length), by the plan."""
    out = {}
    for s in set(sizes):
        own = sorted(r for r in rows.tolist() if r[0] == s)
        for turn in range(sizes.count(s)):
            _, first, sequence, each, offset = max(r for r in own if r[1] <= turn)
            out.setdefault(sequence + (turn - first) // each, []).append((offset + (turn - first) % each * s, s))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60), st.integers(30, 50))
def test_plan_is_best_fit(sizes, capacity):
    count = {s: sizes.count(s) for s in set(sizes)}
    got = laid(packing.plan(count, capacity), sizes)
    assert sorted(capacity - sum(s for _, s in own) for own in got.values()) == best_fit(sizes, capacity)
    for own in got.values():
        end = 0
        for offset, s in sorted(own):
            assert offset == end  # no gap
            end += s
        assert end <= capacity and sum(3 * s > capacity for _, s in own) <= 2


def test_plan_of_many_pieces_is_short():
    rnd = np.random.default_rng(1)
    count = {int(s): int(n) for s, n in zip(range(1, 2049), rnd.integers(0, 10**9, 2048), strict=True)}
    rows = packing.plan(count, 2048)
    used = max(int(sequence) + 1 for _, _, sequence, _, _ in rows)
    assert len(rows) < 50_000 and used >= -(-sum(s * n for s, n in count.items()) // 2048)


TEXTS = ["", "Plain words, it's plain; don't split 1234!", "Été 中文字 \U0001f600\U0001f600 naïve", "a\x1cb c d\u0085e", "é ́x 가 ᄀ ᅡ", "x" * 300 + " y", "<|endoftext|> and <|startoftext|>mid", "\n\n\t tab\x0bvt\x0cff\r\n", "ΣΑΣ İstanbul ﬁ", "we're I'll 's 'S he'd''s"]


@pytest.mark.parametrize("text", TEXTS)
def test_words_apart_give_the_ids_of_the_whole(text):
    own = Tokenizer.from_file(PATH)
    encoder = packing.Encoder(zlib.compress(open(PATH, "rb").read()))
    for t in (text, text * 3, " ".join(TEXTS) + text):
        assert encoder.ids(t).tolist() == own.encode(t, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZé́'sStT1 \n\t.,-Σ中 ‍ᅡᄀ<|>"), max_size=60))
def test_any_text(text):
    own, encoder = OWN
    assert encoder.ids(text).tolist() == own.encode(text, add_special_tokens=False).ids


OWN = Tokenizer.from_file(PATH), packing.Encoder(zlib.compress(open(PATH, "rb").read()))


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 3)
    own, encoder = Tokenizer.from_file(PATH), packing.Encoder(zlib.compress(open(PATH, "rb").read()))
    for t in TEXTS + TEXTS:
        assert encoder.ids(t).tolist() == own.encode(t, add_special_tokens=False).ids


def test_pack(spark):
    capacity, rnd = 64, np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(i, " ".join(rnd.choice(words, n))) for i, n in enumerate(rnd.integers(0, 200, 150))]
    rows += [(3, None), (None, None), (None, "one two"), (4, rows[4][1]), (4, rows[4][1])] + [(1000 + k, "alpha beta") for k in range(300)]
    df = spark.createDataFrame([(*r, "theirs") for r in rows], "doc_id long, text string, start string").repartition(9)
    pieces = packing.cut(df, PATH, capacity=capacity)
    placed = packing.place(pieces, capacity)
    got = placed.collect()
    own = Tokenizer.from_file(PATH)
    want = []
    for i, text in rows:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(i, k // capacity, k, len(ids[k : k + capacity]), ids[k : k + capacity]) for k in range(0, len(ids), capacity)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=repr) == sorted(want, key=repr)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length, r.ids))
    for parts in held.values():
        ends = np.cumsum([0] + [n for _, n, _ in sorted(parts)])
        assert [o for o, _, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= capacity
    assert sorted(capacity - sum(n for _, n, _ in parts) for parts in held.values()) == best_fit([w[3] for w in want], capacity)
    for s in packing.sequences(placed).collect():
        parts = sorted(held[s.sequence_id])
        assert np.array(s.input_ids, "<u4").tobytes() == b"".join(x for _, _, x in parts) and s.n_tokens == len(s.input_ids)
        assert s.document == [k for k, (_, n, _) in enumerate(parts) for _ in range(n)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.place(packing.cut(df, PATH)).count() == 0


def test_words_of_letters_are_learned_without_patterns(monkeypatch):
    own, encoder = Tokenizer.from_file(PATH), packing.Encoder(zlib.compress(open(PATH, "rb").read()))
    monkeypatch.setattr(packing, "PLAIN", None)
    monkeypatch.setattr(packing, "PART", None)
    for text in ("Of many words of LETTERS of", "of new and many ZZYZX words", ""):
        assert encoder.ids(text).tolist() == own.encode(text, add_special_tokens=False).ids
