"""The pipeline against a plain version on a small corpus."""

import random

import corpus_pipeline
import numpy as np
from lodestar.llm import decontaminate, langid
from test_short_lines import plain as brute_lines
from test_brute import groups, plain_fingerprint


def corpus():
    rnd = random.Random(11)
    alphabets = {"en": ["the", "of", "and", "tion", "ing", "her"], "fr": ["le", "eau", "ère", "ç", "oui", "ment"]}

    def sentence(lang, n):
        return " ".join("".join(rnd.choice(alphabets[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))

    items = [(i, sentence("en", 20)) for i in range(5)]
    shared = [sentence("en", 14) for _ in range(4)]
    rows = []
    for d in range(90):
        lang = rnd.choice(["en", "fr"])
        lines = [sentence(lang, rnd.randint(3, 25)) for _ in range(rnd.randint(1, 5))]
        if d % 6 == 0:
            lines.append(rnd.choice(shared) + rnd.choice(["", "x", "yz", "!!"]))
        if d % 11 == 0:
            lines.append(sentence(lang, 2) + " " + items[rnd.randrange(5)][1].upper())
        if d % 9 == 0 and rows:
            lines = rows[rnd.randrange(len(rows))][1].split("\n")[:1] + lines[:1]
        text = "\n".join(lines)
        rows.append((d, text, lang, f"s{d % 3}", len(text)))
    rows += [(200, None, "en", "s1", None), (201, "12345 !!", None, None, 8), (202, "", "en", "s2", 0), (203, "Of.", "en", None, 3)]
    return rows, items


def test_against_plain(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # language: whatever has a letter stays, as all of it is in a learnt language
    want = [(r[0], r[1]) for r in rows if any(c.isalpha() for c in r[1] or "")]
    texts = brute_lines(want, 2, 40)
    fp = {i: plain_fingerprint(t) for i, t in texts.items()}
    group = groups(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    kept = {i: texts[i] for i in fp if group[i] == i}

    def words(t):
        w = decontaminate.folded([t])
        return w.hash.tolist()

    clean = {i: t for i, t in kept.items() if not any(decontaminate.myers(words(x), words(t)) <= 4 for _, x in items)}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for _, step in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.stage(step(spark, docs, str(tmp_path)), "t")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id: r.text for r in docs.collect()})
    assert seen[0] == dict(want)
    assert seen[1] == texts
    assert seen[2] == kept
    assert seen[3] == clean and len(clean) < len(kept) < len(rows)
    out = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= set(clean) and all(1 <= r.copies <= 2 and r.taken == r.copies * r.size and r.text == clean[r.doc_id] for r in out)
    for s in {r.source for r in out}:
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.1 * own[0].source_size + 20


def test_rejects_noise(spark, monkeypatch):
    v = np.eye(2, langid.DIM, dtype=np.float32)
    pred, score = langid.predict_batch(["zzz", "1 2"], ["a", "b"], v, langid.Vectors())
    assert pred[1] == "und" and score[1] == 0.0 and pred[0] in "ab"
