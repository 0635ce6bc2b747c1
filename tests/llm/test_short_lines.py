import hashlib

from lodestar.llm import linededup as L
from lodestar.llm.queries import op3_linededup
from test_linededup import brute, corpus


def plain(docs, edits, least):
    """As brute(), but shorter lines go as well if they repeat exactly; empty lines stay."""
    seen, short = set(), []
    for i, t in docs:
        kept = []
        for line in t.split("\n"):
            if not 0 < len(line) < least or line not in seen:
                kept.append(line)
            seen.add(line)
        short.append((i, "\n".join(kept)))
    return brute(short, edits, least)


def test_short_repeats_go(spark, tmp_path):
    docs = corpus(6, 60) + [(2000, "ab\n\nab\n\nx"), (2001, "x\nab\nxy")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.dedup_lines(frame, 2, 25, exact=1).collect()}
    want = plain(docs, 2, 25)
    assert got == want and want[2001] == "xy"
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    want = plain(docs, 2, 40)
    assert {r.doc_id: r.text_sha256 for r in op3_linededup(spark, str(tmp_path)).collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
