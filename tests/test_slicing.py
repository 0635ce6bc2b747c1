"""Cuts of texts against the rule read literally, and their time on texts of megabytes."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestar.operators import documents as D
from lodestar.operators import slicing


def literal(text, most):
    out, start = [], 0
    while len(text) - start > most:
        window = text[start : start + most]
        stop = most
        for mark, kept in (("\n#", 1), ("\n\n", 2), ("\n", 1)):
            if (at := window.rfind(mark)) > 0:
                stop = at + kept
                break
        out.append((start, start + stop))
        start += stop
    return [*out, (start, len(text))]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("a \n#\né\U0001f600"), max_size=80), st.integers(1, 12))
def test_slices_are_cut_by_rank(text, most):
    got = list(slicing.slice_ranges(text, most))
    assert got == literal(text, most)
    assert "".join(text[a:b] for a, b in got) == text


def test_each_rank_is_taken():
    assert list(slicing.slice_ranges("intro\n\nmore\n# Head\nbody", 16)) == [(0, 12), (12, 23)]
    assert list(slicing.slice_ranges("first\n\nsecond line\nx", 16)) == [(0, 7), (7, 20)]
    assert list(slicing.slice_ranges("one line\nanother line", 16)) == [(0, 9), (9, 21)]
    assert list(slicing.slice_ranges("x" * 20, 16)) == [(0, 16), (16, 20)]


def test_slices_of_a_table(spark):
    texts = ["", None, "short", "# a\n" + "word " * 900 + "\n# b\n" + "y" * 3000]
    got = [tuple(r) for r in D.slices(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2000).orderBy("doc_id", "seq").collect()]
    assert got == [(i, k, a, b) for i, t in enumerate(texts) if t for k, (a, b) in enumerate(literal(t, 2000))]


@pytest.mark.parametrize("text", ["x" * 10_000_000, ("word " * 40 + "\n") * 50_000, " a" + "b" * 5_000_000])
def test_megabytes_take_seconds(text):
    began = time.process_time()
    chunks, slices = list(slicing.chunk_ranges(text, 2000, 200)), list(slicing.slice_ranges(text, 2000))
    assert time.process_time() - began < 20 and slices[-1][1] == len(text) and chunks[-1][1] == len(text)


def test_a_range_in_two():
    rnd = random.Random(1)
    for _ in range(200):
        text = "".join(rnd.choice("ab\n") for _ in range(rnd.randrange(1, 12)))
        start = rnd.randrange(len(text))
        got = slicing.halves(text, start, len(text))
        if len(text) - start <= 1:
            assert got is None
        else:
            (a, b), (c, d) = got
            assert (a, d) == (start, len(text)) and a < b == c < d
    assert slicing.halves("aaaa\nbbbb\ncc", 0, 12) == ((0, 10), (10, 12)) and slicing.halves("aaaa", 0, 4) == ((0, 2), (2, 4))
