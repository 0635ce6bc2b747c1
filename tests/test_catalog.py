"""Every registered query against its SQL; those that SQL can't express against what must hold for their rows."""

import collections
import os

import numpy as np
import plain
import pytest
from lodestar.plans import catalog
from oracle import compare, connect

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def shingles(x):
    x = x.replace(" ", "")
    return {x[k : k + 3] for k in range(max(1, len(x) - 2))}


def labels(con):
    return dict(con.execute("SELECT min(doc_id), norm FROM (SELECT doc_id, trim(regexp_replace(lower(substr(text, 1, 60)), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents) WHERE length(norm) >= 12 GROUP BY norm").fetchall())


def minhash_candidates(rows, con):
    own = labels(con)
    got = {(r.a, r.b) for r in rows}
    assert len(got) == len(rows) and all(a < b and a in own and b in own for a, b in got)
    ids = sorted(own)
    sets = {i: shingles(own[i]) for i in ids}
    alike = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.95 * len(sets[a] | sets[b])]
    assert sum(p in got for p in alike) >= 0.9 * len(alike)


def _next(con, where):
    graph = catalog.GRAPH
    out = {}
    for a, b in con.execute(f"WITH {graph} SELECT DISTINCT src, dst FROM edges WHERE {where} AND src <> dst").fetchall():
        out.setdefault(a, []).append(b)
    return out


def dfs_nodes(rows, con):
    after = _next(con, "relation <> 'contains'")
    stack, seen = [("o:7", 0), ("c:3", 0)], {}
    while stack:
        x, d = stack.pop()
        if x not in seen and d <= 3:
            seen[x] = d
            stack += [(y, d + 1) for y in sorted(after.get(x, ()), reverse=True) if y not in seen]
    assert [(r.id, r.depth) for r in sorted(rows, key=lambda r: r.place)] == list(seen.items())


def louvain(rows, con):
    """All nodes, numbered by size, connected, and as modular as moving one node at a time allows, less what splitting large and loose parts costs."""
    of = {r.id: r.community for r in rows}
    assert len(of) == len(rows) == con.execute(f"WITH {catalog.GRAPH} SELECT count(*) FROM nodes").fetchone()[0]
    sizes = collections.Counter(of.values())
    assert [sizes[k] for k in range(len(sizes))] == sorted(sizes.values(), reverse=True)
    e = con.execute(f"WITH {catalog.GRAPH} SELECT least(src, dst), greatest(src, dst), sum(weight) FROM edges WHERE src <> dst GROUP BY ALL").fetchall()
    root = {x: x for x in of}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b, _ in e:
        if of[a] == of[b]:
            root[find(a)] = find(b)
    assert len({find(x) for x in of}) == len(sizes)

    def modularity(of):
        m, k, inside = sum(w for *_, w in e), collections.Counter(), 0
        for a, b, w in e:
            inside += w * (of[a] == of[b])
            k[of[a]] += w
            k[of[b]] += w
        return inside / m - sum((x / (2 * m)) ** 2 for x in k.values())

    at = {x: k for k, x in enumerate(sorted({x for a, b, _ in e for x in (a, b)}))}
    one = plain.louvain(np.array([at[a] for a, _, _ in e]), np.array([at[b] for _, b, _ in e]), np.array([w for *_, w in e]), len(at))
    assert modularity(of) >= 0.75 * modularity({x: one[k] for x, k in at.items()}), (modularity(of), modularity({x: one[k] for x, k in at.items()}))


def resolve_entities(rows, con):
    to = {r.old: r.new for r in rows}
    assert len(to) == len(rows) and not set(to) & set(to.values())
    same = con.execute("SELECT list(CAST(doc_id AS VARCHAR)) FROM (SELECT doc_id, source, trim(regexp_replace(lower(substr(text, 1, 60)), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS norm FROM documents) WHERE norm <> '' GROUP BY norm, source HAVING count(*) > 1").fetchall()
    assert same and all(len({to.get(i, i) for i in group}) == 1 for (group,) in same)


def query_graph(rows, con):
    lines = [r.line for r in sorted(rows, key=lambda r: r.place)]
    assert [r.place for r in sorted(rows, key=lambda r: r.place)] == list(range(1, len(rows) + 1))
    nodes = [x for x in lines if x.startswith("NODE ")]
    assert "NODE Customer#000000011 [" in "\n".join(nodes[:4]) and lines[: len(nodes)] == nodes and all(x.startswith("EDGE ") for x in lines[len(nodes) :])


def question_seeds(rows, con):
    assert "Supplier#000000003" in {r.label for r in rows} and "cold widget" in {r.label for r in rows} and len({r.label for r in rows}) == len(rows)


def pack_documents(rows, con):
    tokens = dict(con.execute("SELECT source || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0'), greatest(1, length(text) // 4) FROM documents").fetchall())
    want, at, held, last = {}, 0, 0, None
    for path in sorted(tokens):  # file by file, a new pack where the next one doesn't fit
        directory = path.rsplit("/", 1)[0]
        if directory != last:
            at, held, last, first = 0, 0, directory, True
        if not first and held + tokens[path] > 20_000:
            at, held = at + 1, 0
        held, first = held + tokens[path], False
        want[path] = (directory, at)
    assert {r.path: (r.directory, r.pack) for r in rows} == want and len(rows) == len(want)


def label_propagation(rows, con):
    near = {}
    for a, b in con.execute(f"WITH {catalog.GRAPH} SELECT DISTINCT src, dst FROM edges WHERE src <> dst").fetchall():
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    of = {x: x for x in near}
    for _ in range(5):  # all at once, the commonest label, the smallest of equals; its own counts
        counts = {x: collections.Counter([of[x], *(of[y] for y in near[x])]) for x in near}
        of = {x: min(c, key=lambda k: (-c[k], k)) for x, c in counts.items()}
    assert {r.id: r.community for r in rows} == of


CHECKS = {f.__name__: f for f in (minhash_candidates, dfs_nodes, louvain, resolve_entities, query_graph, question_seeds, pack_documents, label_propagation)}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE:
        assert compare(df, con, catalog.ORACLE[name])  # no rows would prove nothing
    else:
        CHECKS[name](df.collect(), con)
