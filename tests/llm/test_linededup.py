import random

import pytest
from lodestar.llm import linededup as L
from pyspark.sql import functions as F


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def brute(docs, edits, least):
    """docs: (doc_id, text) in order of id."""
    seen, out = [], {}
    for i, t in docs:
        kept = []
        for line in (t.split("\n") if t is not None else []):
            if len(line) < least:
                kept.append(line)
                continue
            if not any(abs(len(s) - len(line)) <= edits and edit(s, line) <= edits for s in seen):
                kept.append(line)
            seen.append(line)
        out[i] = None if t is None else "\n".join(kept)
    return out


def corpus(seed, n):
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice("abcdeé 𝄞") for _ in range(rnd.randint(8, 30))) for _ in range(25)]
    docs = []
    for i in range(n):
        lines = []
        for _ in range(rnd.randint(0, 6)):
            s = list(rnd.choice(pool))
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                k = rnd.randrange(len(s))
                if rnd.random() < 0.4:
                    s.insert(k, rnd.choice("abcxyz"))
                elif rnd.random() < 0.5:
                    s[k] = rnd.choice("abcxyz")
                elif len(s) > 1:
                    s.pop(k)
            lines.append("".join(s))
        docs.append((i, "\n".join(lines)))
    return docs


@pytest.mark.parametrize("edits,seed", [(2, 1), (1, 2)])
def test_matches_brute_force(spark, edits, seed):
    docs = corpus(seed, 60) + [(1000, None), (1001, ""), (1002, "\n\n")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, mask string")
    got = {r.doc_id: r.text for r in L.dedup_lines(frame, edits, 9).collect()}
    assert got == brute(docs, edits, 9)


def test_band_against_builtin(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(400):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randint(3, 12)))
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randrange(len(b) + 1)
            if rnd.random() < 0.5:
                b.insert(k, rnd.choice("abc"))
            elif len(b) > 3:
                b.pop(k - 1)
        a, b = sorted([a, "".join(b)], key=len, reverse=True)
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a string, b string")
    df = df.withColumns({c: F.transform(F.split(c[0], ""), lambda x: F.ascii(x)) for c in ("aa", "bb")})
    got = df.select("a", "b", L.within(F.col("aa"), F.col("bb"), 2).alias("w")).collect()
    assert all(r.w == (edit(r.a, r.b) <= 2) for r in got)


def test_empty_table_and_repeats(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert L.dedup_lines(none, 2, 9).count() == 0
    line = "a line that is long enough to count"
    rows = spark.createDataFrame([(1, line), (1, line), (1, line + "\nshort"), (None, line), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.text or "", r.n_dropped) for r in L.dedup_lines(rows, 2, 9).collect())
    # one of the two texts of id 1 comes first; its repeated row keeps the line as well
    assert [g for g in got if g[0] == -1] == [(-1, "", 1)]
    assert [g for g in got if g[0] == 2] == [(2, "", 0)]
    assert sum(line in g[1] for g in got) in (1, 2)


def test_common_keys_are_refined(spark, monkeypatch):
    """With every key of a few lines taken as common, results are those of the plain version."""
    monkeypatch.setattr(L, "PAIRS", 4)
    docs = corpus(21, 40)
    rnd = random.Random(8)
    logs = [f"user {rnd.randrange(10**6):06d} logged in from host-{rnd.randrange(3)}" for _ in range(60)]
    logs += [x[:7] + x[8:] for x in logs[:10]] + [x[:9] + "Z" + x[9:] for x in logs[10:20]]
    docs += [(5000 + k, x) for k, x in enumerate(logs)]
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), 2, 8).collect()}
    assert got == brute(docs, 2, 8)


@pytest.mark.parametrize("at_once", [10, 10_000])
def test_lines_of_one_make(spark, at_once):
    """Lines that share all but a number, in many documents or in a single one: keys of thousands of lines, few of them near one another."""
    rnd = random.Random(9)
    numbers = [f"{rnd.randrange(10**14):014d}" for _ in range(8000)]
    near = [(k, n[:5] + ("7" if n[5] != "7" else "3") + n[6:]) for k, n in enumerate(numbers[:50])]
    lines = [f"2024-01-01 worker finished request {n} for the usual customer without an error" for n in numbers + [x for _, x in near]]
    docs = [(k, "\n".join(lines[i : i + at_once])) for k, i in enumerate(range(0, len(lines), at_once))]
    got = L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert sum(r.n_dropped for r in got) == 50 and sum(r.n_dropped for r in got if r.doc_id >= 8000 // at_once) == 50
