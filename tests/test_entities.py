"""Entity resolution and the embedder against plain versions."""

import math
import random
import re

import numpy as np
import pytest
from lodestar.operators import entity as E
from lodestar.operators import memory as M
from lodestar.operators import vectors
from pyspark.sql import functions as F

NODE = "id string, label string, file_type string, source_file string, community long"


def merged(spark, rows):
    got = {r.old: r.new for r in E.resolve(spark.createDataFrame(rows, NODE)).collect()}
    return {frozenset((a, b)) for a, b in got.items()}


def test_pairs_that_merge_and_that_do_not(spark):
    yes = [
        ("quarterly overview of the graph extraction pipeline for the whole engineering department", "quarterly overview of the graph extraction pipeline for the whole engineering departmnet", "doc", "a.md", "a.md"),
        ("The Graph-Extraction Pipeline", "the graph extraction pipeline", "concept", "a.md", "b.md"),
        ("export one read only view of the customer data warehouse for partners and the auditors", "export one read only view of the customer data warehouse for partners and its auditors", "doc", "a.md", "a.md"),
    ]
    no = [
        ("ADR 0011 decision record", "ADR 0013 decision record", "doc", "a.md", "a.md"),
        ("getActiveSession handler", "getActiveSession handlers", "concept", "a.md", "a.md"),
        ("Asset Contribution Flow", "Asset Consumption Flow", "doc", "a.md", "a.md"),
        ("Django app config for apps users", "Django app config for apps userz", "document", "a.md", "b.md"),
        ("cranel", "cranelr", "concept", "a.md", "a.md"),
        ("same label of code", "same label of code", "code", "a.py", "a.py"),
        ("same words elsewhere", "same words elsewhere", "doc", "a.md", "b.md"),
    ]
    rows, want = [], set()
    for k, (a, b, kind, fa, fb) in enumerate(yes + no):
        rows += [(f"x{k}", a, kind, f"{k}{fa}", None), (f"y{k}", b, kind, f"{k}{fb}", None)]
        if k < len(yes):
            want.add(frozenset((f"x{k}", f"y{k}")))
    assert merged(spark, rows) == want


def test_survivor_and_edges(spark):
    nodes = spark.createDataFrame([("long_id_c2", "One Label Here", "doc", "f.md", 1), ("id", "one label here", "doc", "f.md", 1), ("z", "other thing entirely", "doc", "f.md", 1)], NODE)
    edges = spark.createDataFrame([("long_id_c2", "id", "x"), ("z", "long_id_c2", "x")], "src string, dst string, relation string")
    left, moved = E.deduplicate(nodes, edges)
    assert {r.id for r in left.collect()} == {"id", "z"} and [(r.src, r.dst) for r in moved.collect()] == [("z", "id")]
    with pytest.raises(ValueError, match="one repo"):
        E.deduplicate(nodes.selectExpr("*", "id as repo"), edges)


def test_tie_break_is_asked(spark):
    rows = [("a", "quarterly revenue summary", "doc", "f.md", None), ("b", "quarterly revenues summari", "doc", "f.md", None)]
    plain = E.resolve(spark.createDataFrame(rows, NODE)).count()
    asked = E.resolve(spark.createDataFrame(rows, NODE), tie=lambda pairs: pairs).count()
    assert plain <= asked


def test_bands_of_similar_labels(spark):
    b, r = E.banding()
    assert b * r <= 128 and (1 - (1 - 0.9**r) ** b) > 0.95 and (1 - (1 - 0.4**r) ** b) < 0.2
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdefghij ") for _ in range(60)) for _ in range(40)]
    labels = [(f"o{k}", x) for k, x in enumerate(base)] + [(f"p{k}", x[:30] + "Z" + x[31:]) for k, x in enumerate(base)]
    got = {(x.a, x.b) for x in E.candidates(spark.createDataFrame(labels, "id string, norm string")).collect()}
    assert sum((f"o{k}", f"p{k}") in got for k in range(40)) >= 38 and len(got) < 80


def plain_embedding(text):
    def stem(w):
        for e in ("ing", "edly", "ed", "es", "s"):
            if w.endswith(e) and len(w.encode()) - len(e) >= 3:
                w = w[: -len(e)]
                break
        return w[:-1] if w.endswith("e") and len(w.encode()) > 3 else w

    toks = [stem(w) for w in re.findall(r"[^\W_]+", text.lower()) if len(w.encode()) >= 2 and w not in vectors.STOP]
    sums = {}
    for f, w in [(t, 1.0) for t in toks] + [(f"{a} {b}", 1.0) for a, b in zip(toks, toks[1:], strict=False)] + [("#" + t[i : i + 3], 0.25) for t in toks if len(t.encode()) >= 4 for i in range(len(t) - 2)]:
        h = 2166136261
        for c in f.encode():
            h = (h ^ c) * 16777619 % 2**32
        sums[h % 512] = sums.get(h % 512, 0) + w
    norm = math.sqrt(sum((1 + math.log(x)) ** 2 for x in sums.values()))
    return {k: (1 + math.log(x)) / norm for k, x in sums.items()}


def test_embedder(spark):
    texts = ["The quick foxes jumped and running makes noise", "é ée éée cafés naïve strings boxes", "the a of", "", "aaaa aaaa aaaa b2b", "unitedly edly es ses"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {}
    for r in vectors.weights(docs, "k").collect():
        got.setdefault(r.k, {})[r.bucket] = r.weight
    for k, t in enumerate(texts):
        assert got.get(k, {}) == pytest.approx(plain_embedding(t)), t
    dense = {r.k: r.embedding for r in vectors.embed(docs, "k").collect()}
    assert all(len(v) == 512 for v in dense.values()) and not any(dense[3]) and sum(x * x for x in dense[0]) == pytest.approx(1)
    assert vectors.fnv1a([b"a", b"", b"foobar"]).tolist() == [0xE40C292C, 0x811C9DC5, 0xBF9CF968]
    assert vectors.fnv1a([b"bar", b""], vectors.fnv1a([b"foo", b"foobar"])).tolist() == [0xBF9CF968] * 2


def test_memory(spark):
    rows = spark.sql("select * from values ('note', 'Cache design', 'the frontier cache is rebuilt on write', 's', timestamp'2024-01-01'), ('note', 'Other', 'bananas and apples', 's', timestamp'2024-01-02') t(kind, title, text, source, created_at)")
    m = M.add(None, rows)
    again = M.add(m, rows)
    assert again.count() == 2 and [r.title for r in M.search(again, "frontier caches").collect()][0] == "Cache design"
    assert M.search(again, "  ").count() == 0 and M.search(again, "cache", kind="chat").count() == 0
    first = M.listed(again).first()
    assert first.title == "Other" and M.get(again, first.id).count() == 1 and M.remove(again, first.id).count() == 1
    assert first.id.startswith("note-other-17")


def test_misspelt_and_odd_words(spark):
    pairs = [("managr", "manger", False), ("abcd", "abdc", True), ("abcd", "abce", True), ("abcd", "badc", False), ("a", "b", True), ("", "", True), ("abc", "abcd", False), ("pane", "plane", False)]
    df = spark.createDataFrame(pairs, "x string, y string, want boolean")
    assert all(r.m == r.want for r in df.withColumn("m", E.misspelt(F.col("x"), F.col("y"))).collect())
    df = spark.createDataFrame([("export a read only list", "export the read only lost"), ("income flow handler", "budget flow handler"), ("one two", "one two three")], "a string, b string")
    got = [[tuple(p) for p in r.o] for r in df.withColumn("o", E.odd_words(F.col("a"), F.col("b"))).collect()]
    assert got == [[], [("income", "budget")], []]
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcde", k=rnd.randint(1, 9))) for _ in range(80)]
    both = spark.createDataFrame([(a, b, E.winkler(a, b)) for a in words[:40] for b in words[40:]], "a string, b string, score double")
    assert both.where(E.reach(F.col("a"), F.col("b")) < F.col("score") - 1e-9).count() == 0


def test_scores_of_many_pairs_are_those_of_one(monkeypatch):
    """All pairs at once against pair by pair: equal wherever they can reach the least score, for long labels and many signs too."""
    rnd = random.Random(3)
    base = ["the thanedble anea eriner", "in of the", "ab", "a", "", "x" * 63 + "yz", "é" * 5 + "abc", "the thanedble anea " * 4]
    words = sorted({"".join(c if rnd.random() > 0.15 else rnd.choice("abt hen") for c in rnd.choice(base))[: rnd.randrange(1, 90)] for _ in range(120)} | set(base))
    a, b = (np.array(x) for x in zip(*[(i, j) for i in range(len(words)) for j in range(len(words)) if i != j], strict=True))
    for signs in (256, 2):
        monkeypatch.setattr(E, "SIGNS", signs)
        got = E._winklers(words, a, b, 0.8).tolist()
        want = [E.winkler(words[i], words[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert sum(w >= 0.8 for w in want) > 50
        assert all(g == w if w >= 0.8 else g <= w for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_fuzzy_pairs_of_a_block_in_chunks(spark, monkeypatch, kind):
    monkeypatch.setattr(E, "GROUP", 4)
    rnd = random.Random(5)
    rows = sorted({(k if kind == "long" else f"k{k}", "common " + "".join(rnd.choice("abc") for _ in range(6)) + rnd.choice(["", " 7", " 007"])) for k in range(40)}) + [(None, "common aaaaaa"), (99 if kind == "long" else "k99", None)]
    df = spark.createDataFrame(rows, f"id {kind}, norm string")

    def numbers(x):
        return sorted(str(int(w)) for w in x.split() if w.isdigit())

    full = [r for r in rows if None not in r]
    want = {(a, b, round(E.winkler(x, y), 6)) for a, x in full for b, y in full if a < b and x != y and numbers(x) == numbers(y) and E.winkler(x, y) >= 0.9}
    got = E.fuzzy_pairs(df, F.left("norm", F.lit(6)), 0.9).collect()
    assert len(got) == len(want) > 5 and {tuple(r) for r in got} == want
