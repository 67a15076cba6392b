"""Searches and building replayed by plain lists, independent of the operators' own loops."""

from __future__ import annotations

import numpy as np
import pytest

from nearfield.operators import graph, search
from nearfield.operators.visited import KINDS
from nearfield.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.round(np.random.default_rng(8).normal(size=(300, 6)) * 5)  # whole numbers: distances are exact and often tie
    x[50:60] = x[40:50]  # ties
    return x, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").cache()


def far(a, b):
    return float(((a - b) ** 2).sum())


def plain_search(x, near, q, o):
    """Candidates and results as lists that are sorted anew at each step."""
    seen = KINDS[o.visited](o.pq)
    todo, best, stops, expanded = [(far(q, x[0]), 0)], [], 0, 0
    seen.add(0)
    while todo:
        opened = []
        while todo and len(opened) < o.probes:
            todo.sort()
            d, v = todo.pop(0)
            if o.forget:
                seen.discard(v)
            worst = best[-1][0] if len(best) == o.pq else None
            if worst is not None and (worst <= d if o.bounded else worst < d):
                stops += 1
                if not o.bounded or stops == o.finish:
                    todo = []
                    break
                continue
            best = sorted([*best, (d, v)])
            if o.forget:
                seen.add(v)
            for _, w in best[o.pq :]:
                if o.forget:
                    seen.discard(w)
            best = best[: o.pq]
            expanded += 1
            opened.append(v)
        met = []
        for v in opened:
            for y in near[v]:
                if not seen.test(y) and y not in met:
                    met.append(y)
                    if not o.on_insert:
                        seen.add(y)
        for y in met:
            d = far(q, x[y])
            if o.bounded and len(todo) >= o.pq and max(todo)[0] < d:
                continue
            todo.append((d, y))
            if o.on_insert:
                seen.add(y)
            if o.bounded and len(todo) > o.pq:
                todo.remove(gone := max(todo))
                if o.forget:
                    seen.discard(gone[1])
    return best, expanded


def plain_graph(x, degree, budget):
    """Neighbour lists after inserting one row after the other."""
    lists = []
    for v in range(len(x)):
        found = []
        if v:
            todo, done, seen = [(far(x[v], x[0]), 0)], [], {0}
            while todo:
                todo.sort()
                d, u = todo.pop(0)
                if len(done) == budget and done[-1][0] < d:
                    break
                done = sorted([*done, (d, u)])[:budget]
                for _, w in lists[u]:
                    if w not in seen:
                        seen.add(w)
                        todo.append((far(x[v], x[w]), w))
            found = done[:degree]
        lists.append(list(found))
        for d, u in found:
            if len(lists[u]) < 2 * degree + 1:
                lists[u].append((d, v))
                if len(lists[u]) == 2 * degree + 1:
                    lists[u].sort(key=lambda e: e[0])
            elif d < lists[u][-1][0]:
                lists[u] = sorted([*lists[u][:-1], (d, v)], key=lambda e: e[0])
    return [sorted(own) for own in lists]


@pytest.mark.parametrize(("degree", "budget"), [(15, 150), (3, 8)])
def test_sequential_graph_is_the_plain_one(cloud, degree, budget):
    x, v = cloud
    got = [[] for _ in x]
    for r in graph.build_sequential(v, degree=degree, budget=budget).orderBy("src", "rank").collect():
        got[r["src"]].append((r["dist"], r["dst"]))
    for mine, plain in zip(got, plain_graph(x, degree, budget), strict=True):
        assert [u for _, u in mine] == [u for _, u in plain]
        assert [d for d, _ in mine] == pytest.approx([d for d, _ in plain], abs=1e-9)


@pytest.mark.parametrize("pq", [6, 50])
@pytest.mark.parametrize("name", sorted(registry.SMALL))
def test_searches_are_the_plain_ones(cloud, name, pq):
    x, v = cloud
    o = registry.SMALL[name]
    o = search.Options(**{**o.__dict__, "pq": pq})
    edges = graph.build_sequential(v, degree=5, budget=20).cache()
    near = [[] for _ in x]
    for r in edges.orderBy("src", "rank").collect():
        near[r["src"]].append(r["dst"])
    asked = v.where("vec_id % 5 = 2")
    got = {}
    for r in search.search(asked, v, edges, o).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((round(r["dist"], 9), r["vec_id"]))
    count = {r["query_id"]: r["n_expanded"] for r in search.explored(asked, v, edges, o).collect()}
    for q in range(2, 300, 5):
        best, expanded = plain_search(x, near, x[q], o)
        assert got[q] == [(round(d, 9), u) for d, u in best] and count[q] == expanded
    edges.unpersist()
