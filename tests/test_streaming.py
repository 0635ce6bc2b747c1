"""Sessions kept batch by batch against the table's, with events out of order, late ones, batches taken twice and a restart."""

import datetime
import random

import pytest
from lodestar.functions import versions
from lodestar.streaming import debounce as S

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
GAP, LATE = 60, 300


def plain(events):
    """Sessions and open ends, read literally."""
    out = {}
    for user, t in sorted(events, key=lambda e: (e[0], e[1])):
        own = out.setdefault(user, [])
        if own and t - own[-1][1] < GAP:
            own[-1][1], own[-1][2] = t, own[-1][2] + 1
        else:
            own.append([t, t, 1])
    return {(u, *s) for u, own in out.items() for s in map(tuple, own)}


@pytest.fixture
def batches():
    rnd = random.Random(2)
    times = sorted(rnd.randrange(0, 4000) for _ in range(300))
    events = [(rnd.randrange(4), t) for t in times]
    moved = sorted(events, key=lambda e: e[1] + rnd.choice([0, 0, 0, 200, 900]))  # out of order, some far too late
    return [moved[k : k + 50] for k in range(0, 300, 50)]


def split(batches):
    seen, good, late = None, [], []
    for batch in batches:
        for u, t in batch:
            (late if seen is not None and t < seen - LATE else good).append((u, t))
        seen = max([t for _, t in batch] + ([seen] if seen is not None else []))
    return good, late


def frame(spark, batch):
    return spark.createDataFrame([(u, START + datetime.timedelta(seconds=t)) for u, t in batch], "user_id long, ts timestamp")


def held(spark, root):
    sessions, late = S.kept_sessions(spark, root)
    second = lambda x: int((x - START.replace(tzinfo=None)).total_seconds())
    rows = sessions.collect()
    return {(r.user_id, second(r.first_ts), second(r.last_ts), r.n) for r in rows}, len(rows), sorted((r.user_id, second(r.ts)) for r in late.collect())


def test_batches_give_the_sessions_of_the_table(spark, tmp_path, batches):
    root = f"file://{tmp_path}/sessions"
    assert S.kept_sessions(spark, root) is None
    for k, batch in enumerate(batches):
        S.keep_sessions(frame(spark, batch), k, root, GAP, LATE)
        if k == 2:
            before = versions.current(spark, root)
            S.keep_sessions(frame(spark, batches[0]), 1, root, GAP, LATE)  # taken before
            assert versions.current(spark, root) == before
    good, late = split(batches)
    got, n, told = held(spark, root)
    assert late and got == plain(good) and n == len(got) and told == sorted(late)


def test_stream(spark, tmp_path, batches):
    root, source, at = f"file://{tmp_path}/sessions", tmp_path / "in", f"{tmp_path}/checkpoint"
    for k, batch in enumerate(batches):
        frame(spark, batch).coalesce(1).write.mode("append").parquet(str(source))
        if k in (1, 5):  # what has come so far, then a restart with the rest
            events = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(source))
            query = S.debounce(events, root, GAP, LATE, at)
            query.awaitTermination()
    got, n, told = held(spark, root)
    good, late = split(batches)
    assert n == len(got) and got == plain(good) and told == sorted(late)
