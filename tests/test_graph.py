"""The toy graphs of the survey's fixtures: structure, measures, relations, flow and closure."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcwise.graph import KnowledgeGraph
from arcwise.operators.closure import closure
from arcwise.operators import closure as closures
from arcwise.operators.dictionary import dense_ids, encode_triples
from arcwise.operators.flow import edge_flows, stream
from arcwise.operators import meeting, wide
from arcwise.operators.measures import katz, path_entropy, simrank
from arcwise.operators.neighborhood import adamic_adar, degree_product, dense, jaccard
from arcwise.operators.relations import cooccurrence, relational_similarity, top_similar
from arcwise.operators.walks import first_features, path_features, path_totals, summed_products, walk_counts, walks
from arcwise.plans.learn import mutual_information, path_probabilities
from arcwise.plans.methods import normalize

# The toy graphs of the survey's fixtures, rows (s, o, p[, value]), and below the results that go with them.
A = [(0, 1, 0), (0, 2, 1), (1, 2, 0), (1, 2, 1), (1, 3, 1), (2, 3, 0), (2, 1, 1), (2, 3, 1)]
B = [(0, 1, 0), (1, 2, 0), (2, 3, 0), (0, 2, 1), (1, 2, 1), (1, 3, 1), (2, 1, 1), (2, 3, 1), (0, 1, 2), (1, 2, 2), (1, 3, 2)]
C = [(3, 5, 0), (4, 5, 0), (5, 3, 0), (5, 4, 0), (6, 7, 0), (7, 6, 0), (3, 0, 1), (3, 1, 1), (3, 2, 1), (4, 0, 1), (4, 1, 1), (5, 0, 1), (5, 1, 1), (5, 2, 1), (6, 0, 1), (7, 0, 1), (3, 2, 2), (3, 6, 3), (3, 7, 3), (4, 6, 3), (4, 7, 3), (1, 0, 4), (2, 0, 4), (0, 3, 5), (0, 4, 5), (0, 5, 5), (0, 6, 5), (0, 7, 5), (1, 3, 5), (1, 4, 5), (1, 5, 5), (2, 3, 5), (2, 4, 5), (2, 5, 5), (2, 6, 5), (2, 7, 5)]
D = [(0, 2, 0, 10.0), (1, 2, 0, 30.0), (0, 1, 1, 20.0), (1, 3, 1, 10.0), (2, 3, 1, 20.0)]
E = [(0, 1, 0, 16.0), (2, 4, 0, 14.0), (4, 5, 0, 4.0), (0, 2, 1, 13.0), (2, 1, 1, 4.0), (3, 5, 1, 20.0), (1, 3, 2, 12.0), (3, 2, 2, 9.0), (4, 3, 2, 7.0)]


def graph(spark, edges, symmetric=True, keep=True):
    rows = [(s, p, o, *w) for s, o, p, *w in edges]
    schema = "s long, p int, o long" + ", w double" * (bool(rows) and len(rows[0]) == 4)
    return KnowledgeGraph.from_edges(spark.createDataFrame(rows, schema), symmetric=symmetric, keep=keep)


def facts(spark, rows):
    return spark.createDataFrame(rows, "sid long, pid int, oid long")


@pytest.fixture(scope="module")
def gc(spark):
    return graph(spark, C)


def test_structure(spark, gc):
    a = graph(spark, A)
    assert a.edges.count() == 14 and gc.edges.count() == 66
    assert [r.d for r in a.degrees().orderBy("node").collect()] == [2, 3, 3, 2]
    assert [r.d for r in gc.degrees().orderBy("node").collect()] == [7, 4, 6, 6, 6, 5, 5, 5]
    assert {(r.p, r.o) for r in a.neighbors(0).collect()} == {(0, 1), (1, 2)}
    assert a.value(0, 1, 0).count() == 1 and a.value(0, 3, 0).count() == 0
    assert a.n_relations == 2
    gone = a.without(spark.createDataFrame([(0, 0, 1)], "s long, p int, o long"))
    assert gone.value(0, 1, 0).count() == 0 and gone.value(1, 0, 0).count() == 1
    assert a.updated(spark.createDataFrame([(0, 0, 1, 0.5)], "s long, p int, o long, w double")).value(0, 1, 0).first().w == 0.5
    with pytest.raises(ValueError):
        a.weighted_degrees("none")


def test_conflicting_values_and_nulls(spark):
    g = KnowledgeGraph.from_edges(spark.createDataFrame([(0, 0, 1, 1.0), (0, 0, 1, 3.0), (None, 0, 1, 1.0)], "s long, p int, o long, w double"), symmetric=False)
    assert [tuple(r) for r in g.edges.collect()] == [(0, 0, 1, 3.0)]


@pytest.mark.parametrize(
    ("edges", "symmetric", "want"),
    [
        (B, True, [[10, 13, 10], [13, 18, 12], [10, 12, 12]]),
        (B, False, [[2, 4, 2], [3, 6, 2], [2, 4, 2]]),
        (C, True, [[8, 13, 1, 8, 0, 16], [13, 62, 5, 14, 15, 72], [1, 5, 2, 2, 1, 8], [8, 14, 2, 16, 0, 20], [0, 15, 1, 0, 6, 18], [16, 72, 8, 20, 18, 94]]),
        (C, False, [[8, 13, 1, 4, 0, 0], [0, 0, 0, 0, 5, 44], [0, 0, 0, 0, 1, 5], [4, 4, 0, 0, 0, 0], [0, 0, 0, 0, 0, 10], [16, 28, 3, 12, 0, 0]]),
    ],
)
def test_cooccurrence(spark, edges, symmetric, want):
    got = {(r.r1, r.r2): r.c for r in cooccurrence(graph(spark, edges, symmetric, keep=False)).collect()}
    assert [[got.get((i, j), 0) for j in range(len(want))] for i in range(len(want))] == want


def test_relational_similarity(spark, gc):
    cooc = cooccurrence(gc)
    sim = {(r.r1, r.r2): r.sim for r in relational_similarity(cooc, 6, "log-tf").collect()}
    assert [round(sim[0, j], 6) for j in range(6)] == [1.0, 0.522735, 0.628506, 0.992103, 0.0, 0.535783]
    sim = {(r.r1, r.r2): r.sim for r in relational_similarity(cooc, 6, "max-tf").collect()}
    assert [round(sim[0, j], 6) for j in range(6)] == [1.0, 0.500536, 0.651506, 0.9436, 0.0, 0.533324]
    b = cooccurrence(graph(spark, B))
    assert relational_similarity(b, 3).count() == 0
    assert all(math.isnan(r.sim) for r in relational_similarity(b, 3, nan_as_coded=True).collect())
    assert [r.r2 for r in top_similar(relational_similarity(cooc, 6), 0, 2).collect()] == [0, 3, 2]


def test_measures(spark, gc):
    c = facts(spark, [(0, 0, 3), (3, 0, 4), (1, 0, 6), (6, 0, 7)])
    want = {
        jaccard: [0.625, 1, 0.5, 0.666666667],
        adamic_adar: [3.143462951, 3.657361293, 1.630119595, 2.188230222],
        degree_product: [42, 36, 20, 25],
        katz: [0.044750, 0.043250, 0.021375, 0.022875],
        path_entropy: [113.305116323, 68.325182830, 53.992672648, 41.109189412],
    }
    for f, scores in want.items():
        got = {(r.sid, r.oid): r.score for r in f(gc, c).collect()}
        assert [got[0, 3], got[3, 4], got[1, 6], got[6, 7]] == pytest.approx(scores, abs=1e-8), f.__name__
    got = {(r.sid, r.oid): (r.w2, r.w3) for r in walk_counts(gc, c).collect()}
    assert got == {(0, 3): (11, 138), (3, 4): (14, 66), (1, 6): (6, 51), (6, 7): (7, 43)}
    got = {(r.sid, r.oid): r.score for r in simrank(gc, facts(spark, [(0, 0, 3), (6, 0, 7)]), steps=20).collect()}
    assert 0 <= 0.102011706 - got[0, 3] < 0.003 and 0 <= 0.107830232 - got[6, 7] < 0.003  # the rest of the series


def test_walk_cap_keeps_the_descending_first(spark, gc):
    c = facts(spark, [(0, 0, 3)])
    every = sorted((tuple(r.rels), tuple(r.nodes)) for r in walks(gc, c, 3).collect())
    key = lambda w: tuple(x for r, n in zip(w[0][1:], w[1][1:], strict=True) for x in (r, n))
    assert len(every) == 138
    some = sorted((tuple(r.rels), tuple(r.nodes)) for r in walks(gc, c, 3, cap=20).collect())
    assert some == sorted(sorted(every, key=key, reverse=True)[:20])


def join_rows(plan):
    """The most rows that a join of a plan that was run gave."""
    inner = [getattr(plan, f)() for name, f in (("AdaptiveSparkPlan", "executedPlan"), ("QueryStage", "plan")) if name in plan.nodeName() or name in plan.getClass().getSimpleName()]
    below = inner or [plan.children().apply(k) for k in range(plan.children().size())]
    own = plan.metrics().get("numOutputRows").get().value() if "Join" in plan.nodeName() else 0
    return max([own, *map(join_rows, below)])


@pytest.mark.parametrize("removal", ["as_coded", "effective"])
def test_listings_make_no_row_for_steps_that_lead_elsewhere(spark, removal):
    """40 subjects with 100 neighbours each, one of which leads to the 10 objects."""
    edges = [(s, 1000 + 100 * s + k, 0) for s in range(40) for k in range(100)] + [(s, 900, 1) for s in range(40)] + [(900, 100 + o, 2) for o in range(10)]
    g = graph(spark, edges)
    df = walks(g, facts(spark, [(s, 0, 100 + o) for s in range(40) for o in range(10)]), 2, removal=removal)
    assert sorted((tuple(r.nodes), tuple(r.rels)) for r in df.collect()) == sorted(((s, 900, 100 + o), (-1, 1, 2)) for s in range(40) for o in range(10))
    assert 400 <= join_rows(df._jdf.queryExecution().executedPlan()) <= 4040


@pytest.mark.parametrize("symmetric", [True, False])
@pytest.mark.parametrize("whole", [True, False])
def test_dense_path_features(spark, symmetric, whole, monkeypatch):
    rnd = random.Random(6)
    g = graph(spark, sorted({(rnd.randrange(12), rnd.randrange(12), rnd.randrange(3)) for _ in range(60)}), symmetric)
    rows = [(s, p, o) for s in (0, 3, 4, 7, 99) for p in (1, 2) for o in (2, 3, 5)]
    c = facts(spark, rows if whole else [r for r in rows if r != (0, 1, 5)])
    want = {}
    for n in (2, 3):
        for r in walks(g, c, n).collect():
            want[r.sid, r.pid, r.oid, tuple(r.rels)] = want.get((r.sid, r.pid, r.oid, tuple(r.rels)), 0) + 1
    monkeypatch.setattr("arcwise.operators.walks._stepped", None)  # which has a row for each step of each fact
    assert {(r.sid, r.pid, r.oid, tuple(r.rels)): r.n for r in path_features(g, c, None).collect()} == want


@pytest.mark.parametrize("symmetric", [True, False])
@pytest.mark.parametrize("block, first, cap", [(32, 16, 20), (2, 3, 7), (2, 1, 40)])
def test_dense_capped_features(spark, symmetric, block, first, cap, monkeypatch):
    rnd = random.Random(7)
    g = graph(spark, sorted({(rnd.randrange(12), rnd.randrange(12), rnd.randrange(3)) for _ in range(80)}), symmetric)
    rows = [(s, p, o) for s in (0, 3, 4, 7, 99) for p in (1, 2) for o in (2, 3, 5)]
    c = facts(spark, rows if block == 2 else [r for r in rows if r != (0, 1, 5)])
    want = {}
    for n in (2, 3):
        for r in walks(g, c, n, cap).collect():
            want[r.sid, r.pid, r.oid, tuple(r.rels)] = want.get((r.sid, r.pid, r.oid, tuple(r.rels)), 0) + 1
    monkeypatch.setattr("arcwise.operators.walks._stepped", None)  # which has a row for each step of each fact
    monkeypatch.setattr("arcwise.operators.walks._BLOCK", block)
    monkeypatch.setattr("arcwise.operators.walks._FIRST", first)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = [((r.sid, r.pid, r.oid, tuple(r.rels)), r.n) for r in path_features(g, c, cap).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and dict(got) == want


def test_mutual_information_of_dense_facts(spark, monkeypatch):
    rnd = random.Random(8)
    g = graph(spark, sorted({(rnd.randrange(12), rnd.randrange(12), rnd.randrange(3)) for _ in range(80)}))
    c = facts(spark, [(s, 1, o) for s in (0, 3, 4, 7, 99) for o in (2, 3, 5)])
    labels = c.withColumn("class", ((F.col("sid") + F.col("oid")) % 2).cast("int"))
    counts = {}
    for n in (2, 3):
        for r in walks(g, c, n, 9).collect():
            one = counts.setdefault(tuple(r.rels), {})
            one[r.sid, r.oid] = one.get((r.sid, r.oid), 0) + 1
    rows = [(r.sid, r.oid, r["class"]) for r in labels.collect()]
    want = {}
    for rels, one in counts.items():
        cells, x, y = {}, {}, {}
        for s, o, k in rows:
            n = one.get((s, o), 0)
            cells[n, k], x[n], y[k] = cells.get((n, k), 0) + 1, x.get(n, 0) + 1, y.get(k, 0) + 1
        want[rels] = sum(v / len(rows) * math.log(v * len(rows) / (x[n] * y[k])) for (n, k), v in cells.items())
    monkeypatch.setattr("arcwise.operators.walks._stepped", None)  # which has a row for each step of each fact
    assert {tuple(r.rels): r.mi for r in mutual_information(path_features(g, c, 9), labels).collect()} == pytest.approx(want, abs=1e-9)


def test_summed_products_of_large_numbers(spark):
    steps = spark.createDataFrame([(1, 0, 5, 10**9), (1, 0, 6, 3), (2, 1, 5, 1)], "sid long, r int, a long, m long")
    ends = spark.createDataFrame([(5, 0, 7, 10**8 + 1), (6, 0, 7, 32768), (5, 0, 8, 32767), (5, 4, 7, 1)], "a long, k int, oid long, t long")
    got = {tuple(r) for r in summed_products(steps, ends, ends.select("oid"), 3).select("sid", "r", "k", "oid", "n").collect()}
    assert got == {(1, 0, 0, 7, 10**17 + 10**9 + 98304), (1, 0, 0, 8, 32767 * 10**9), (1, 0, 4, 7, 10**9), (2, 1, 0, 7, 10**8 + 1), (2, 1, 0, 8, 32767), (2, 1, 4, 7, 1)}


@pytest.mark.parametrize("symmetric", [True, False])
@pytest.mark.parametrize("whole", [True, False])
def test_path_totals_and_first_features(spark, symmetric, whole, monkeypatch):
    rnd = random.Random(5)
    edges = sorted({(rnd.randrange(12), rnd.randrange(12), rnd.randrange(3)) for _ in range(60)})
    g = graph(spark, edges, symmetric)
    rows = [(s, p, o) for s in (0, 3, 4, 7, 99) for p in (1, 2) for o in (2, 3, 5)]
    c = facts(spark, rows if whole else [r for r in rows if r != (0, 1, 5)])
    features = path_features(g, c, None).collect()
    want, first = {}, {}
    for r in sorted(features, key=lambda r: (r.sid, r.pid, r.oid)):
        want[tuple(r.rels)] = want.get(tuple(r.rels), 0) + r.n
        first.setdefault(tuple(r.rels), (r.sid, r.pid, r.oid))
    if whole:  # no row for a fact is made
        monkeypatch.setattr("arcwise.operators.walks.path_features", None)
    assert {tuple(r.rels): r.n for r in path_totals(g, c).collect()} == want
    assert {tuple(r.rels): (r.sid, r.pid, r.oid) for r in first_features(g, c).collect()} == first
    monkeypatch.undo()
    assert path_totals(g, c.limit(0)).count() == first_features(g, c.limit(0)).count() == 0


@pytest.mark.parametrize("symmetric", [True, False])
@pytest.mark.parametrize("block, group", [(32, 2_000_000), (2, 3)])
def test_path_probabilities_of_dense_facts(spark, symmetric, block, group, monkeypatch):
    rnd = random.Random(9)
    edges = sorted({(rnd.randrange(12), rnd.randrange(12), rnd.randrange(3)) for _ in range(80)})
    out = {}
    for s, o, p in {*edges, *((o, s, p) for s, o, p in edges if symmetric)}:
        out.setdefault((s, p), []).append(o)
    rows = [(s, p, o) for s in (0, 3, 4, 7, 99) for p in (1, 2) for o in (2, 3, 5)]
    rows = rows if block == 2 else [r for r in rows if r != (0, 1, 5)]
    every, want = [(0,), (1, 2), (2, 2), (0, 1, 2), (2, 0, 1), (1, 2, 2)], {}
    for path in every:
        for s, p, o in rows:
            now = {s: 1.0}
            for r in path:
                then = {}
                for n, pr in now.items():
                    for x in out.get((n, r), []):
                        then[x] = then.get(x, 0) + pr / len(out[n, r])
                now = then
            if o in now:
                want[s, p, o, (-1, *path)] = now[o]
    monkeypatch.setattr("arcwise.operators.walks._BLOCK", block)
    monkeypatch.setattr("arcwise.operators.walks._GROUP", group)
    paths = spark.createDataFrame([([-1, *p],) for p in every], "rels array<int>")
    g, made = graph(spark, edges, symmetric), []
    for by_group in (True, False):
        if not by_group:  # a row for each step of each fact
            monkeypatch.setattr("arcwise.plans.learn.dense", lambda _: False)
        df = path_probabilities(g, facts(spark, rows), paths)
        got = [((r.sid, r.pid, r.oid, tuple(r.rels)), r.value) for r in df.collect()]
        assert len(got) == len(want) and dict(got) == pytest.approx(want)
        made.append(join_rows(df._jdf.queryExecution().executedPlan()))
    assert made[0] <= 2 * len(want) < made[1]


def test_path_probabilities(spark, gc):
    paths = spark.createDataFrame([([-1, 1, 0],), ([-1, 5, 3, 5],), ([-1, 1, 1],), ([-1, 2],), ([-1, 4, 2],)], "rels array<int>")
    c = facts(spark, [(0, 0, 3), (3, 0, 4), (0, 0, 0), (1, 0, 0)])
    exact = {(r.sid, r.oid, tuple(r.rels)): r.value for r in path_probabilities(gc, c, paths).collect()}
    assert exact[0, 3, (-1, 1, 0)] == pytest.approx(0.1) and exact[3, 4, (-1, 1, 1)] == pytest.approx(0.177778, abs=1e-6)
    assert (0, 3, (-1, 5, 3, 5)) not in exact and (0, 0, (-1, 2)) not in exact
    coded = {(r.sid, r.oid, tuple(r.rels)): r.value for r in path_probabilities(gc, c, paths, count_dead_ends=True).collect()}
    assert coded[0, 0, (-1, 2)] == 1.0 and coded[1, 0, (-1, 4, 2)] == 1.0


@pytest.mark.parametrize(("edges", "fact", "flow", "paths"), [(D, (0, 1, 3), 6.42857142857, {(0, 1, 3), (0, 2, 3), (0, 1, 2, 3)}), (E, (0, 2, 5), 2.88888888889, {(0, 1, 3, 5), (0, 2, 4, 5), (0, 2, 3, 5)})])
def test_flow(spark, edges, fact, flow, paths):
    g = graph(spark, edges)
    d = g.degrees()
    table = g.edges.join(d, F.col("o") == F.col("node")).select("s", "p", "o", F.col("w").alias("cap"), F.col("d").cast("long").alias("cost"), F.col("d").cast("double").alias("price"))
    out = stream(g, facts(spark, [fact]), None, npaths=None, edges=table)
    row = out.first()
    assert row.score == pytest.approx(flow, abs=1e-9)
    assert {tuple(p) for p in row.paths} == paths
    assert sum(r.flow for r in edge_flows(out).where(F.col("u") == 0).collect()) == pytest.approx(sum(row.bottlenecks))


def brute_flow(arcs, s, o, npaths):
    """Residual search over a whole graph: least (cost, hops, nodes, relations) by relaxing every arc until nothing changes."""
    cap = {(u, r, v): c for u, r, v, c, *_ in arcs}
    cost = {(u, r, v): k for u, r, v, _, k, *_ in arcs}
    price = {v: x for _, _, v, _, _, x in arcs}
    out = []
    while len(out) < npaths:
        best, changed = {s: (0, 0, (s,), (-1,))}, True
        while changed:
            changed = False
            for (u, r, v), c in cap.items():
                if c > 0 and u in best and v not in best[u][2]:
                    d, h, path, rels = best[u]
                    new = (d + cost[u, r, v], h + 1, (*path, v), (*rels, r))
                    if v not in best or new < best[v]:
                        best[v], changed = new, True
        if o not in best:
            break
        _, _, path, rels = best[o]
        steps = list(zip(path, rels[1:], path[1:], strict=False))
        least = min(cap[x] for x in steps)
        out.append((list(path), list(rels), least, sum(price[v] for v in path[1:-1])))
        for u, r, v in steps:
            cap[u, r, v] -= least
            cap[v, r, u], cost[v, r, u] = least, -cost[u, r, v]
    return out


@pytest.mark.parametrize("widths", [(2, 6), (0, 1), ()])
def test_flow_against_brute_force(spark, widths):
    rnd = random.Random(21)
    edges, asked = [], []
    for k in range(50):  # graphs side by side
        n = rnd.randint(4, 9)
        edges += [(10 * k + rnd.randrange(n), 10 * k + rnd.randrange(n), rnd.randrange(3)) for _ in range(rnd.randint(n, 3 * n))]
        asked += [(10 * k, 0, 10 * k + j) for j in range(1, n, 3)]
    g = graph(spark, edges)
    d = {r.node: r.d for r in g.degrees().collect()}
    rows = {(r.s, r.p, r.o) for r in g.edges.collect()}
    got = {(r.sid, r.oid): r for r in stream(g, facts(spark, [*asked, asked[0], (None, 0, 1), (3, 0, 3), (0, 0, 9999)]), None, edges=None, widths=widths).collect()}
    assert got[None, 1].score is None and got[3, 3].paths == [] and got[0, 9999].score == 0
    for s, p, o in asked:
        arcs = [(u, r, v, 1 / (1 + math.log(d[v])), round(math.log(d[v])), math.log(d[v])) for u, r, v in rows if (u, r, v) != (s, p, o)]
        want = brute_flow(arcs, s, o, 5)
        r = got[s, o]
        assert r.paths == [w[0] for w in want] and r.relpaths == [w[1] for w in want]
        assert r.bottlenecks == pytest.approx([w[2] for w in want]) and r.score == pytest.approx(sum(w[2] / (1 + w[3]) for w in want))
        assert r.maxflow == pytest.approx(sum(a[3] for a in arcs if a[0] == s))


def test_flow_of_facts_over_several_batches(spark):
    edges = [(0, k, 0) for k in range(2, 22)] + [(k, 1, 0) for k in range(2, 22)] + [(30, 31, 0), (31, 32, 0)]
    g, asked = graph(spark, edges), facts(spark, [(0, 0, 1), (30, 0, 32), (0, 0, 32)])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, rows = spark.conf.get(key), lambda: sorted(map(tuple, stream(g, asked, None).collect()))
    want = rows()
    assert [len(r[5]) for r in want] == [5, 0, 1]
    try:
        for n in ("1", "3"):
            spark.conf.set(key, n)
            assert rows() == want
    finally:
        spark.conf.set(key, before)


def shuffled(df):
    """What a plan moves: the exchanges in it, as text."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_stored_graph_lies_by_node(spark):
    edges = [(k, k % 7, k % 3) for k in range(1, 40)] + [(7, 7, 0), (1, 0, 1), (0, 1, 1)]
    for symmetric in (True, False):
        g, plain = (graph(spark, edges, symmetric, keep) for keep in (True, False))
        assert sorted(g.edges.collect()) == sorted(plain.edges.collect())
        assert sorted(g.degrees().collect()) == sorted(plain.degrees().collect())
        assert not shuffled(g.adjacency()) and not shuffled(g.out_degrees())
    assert not shuffled(graph(spark, edges).degrees())


@pytest.mark.parametrize("removal", ["as_coded", "effective"])
def test_common_neighbours_by_either_plan(spark, gc, removal):
    rows = [(r.s, r.p, r.o) for r in gc.edges.collect()]
    every = [(s, p, o) for s in range(9) for p in (0, 1) for o in range(8)]  # 8 is unknown
    few = [(k, 1, 7 - k) for k in range(8)]
    assert dense(facts(spark, every)) and not dense(facts(spark, few))
    for asked in (every, few):
        got = {(r.sid, r.pid, r.oid): r.score for r in jaccard(gc, facts(spark, asked), removal).collect()}
        for f in asked:
            a = {o for s, p, o in rows if s == f[0] and not (removal == "effective" and (s, p, o) == f)}
            b = {o for s, _, o in rows if s == f[2]}
            assert got[f] == pytest.approx(len(a & b) / len(a | b))


def test_stored_tables_leave_no_shuffle_files(spark):
    from arcwise.storage import stored

    files = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    before = files()
    assert stored(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "t").count() == 7
    assert files() <= before + 3  # the count's own


@pytest.mark.parametrize("group", [2_000_000, 2])
def test_walk_counts_of_all_pairs(spark, gc, monkeypatch, group):
    monkeypatch.setattr("arcwise.operators.walks._GROUP", group)
    far = [(100 + k, 0, 0) for k in range(40)]  # more objects than a block has
    g = graph(spark, [*C, (0, 0, 0), *far])
    m = {}
    for r in g.edges.collect():
        m[r.s, r.o] = m.get((r.s, r.o), 0) + 1
    nodes = sorted({u for u, _ in m})
    asked = facts(spark, [(s, 0, o) for s in nodes for o in [*nodes, 999]])
    assert dense(asked)
    two = {(a, c): sum(m.get((a, b), 0) * m.get((b, c), 0) for b in nodes) for a in nodes for c in nodes}
    three = {(a, c): sum(m.get((a, b), 0) * two[b, c] for b in nodes) for a in nodes for c in nodes}
    got = {(r.sid, r.oid): (r.w2, r.w3) for r in walk_counts(g, asked).collect()}
    assert got == {(s, o): (two.get((s, o), 0), three.get((s, o), 0)) for s in nodes for o in [*nodes, 999]}


@pytest.mark.parametrize("measure", [jaccard, adamic_adar, degree_product, katz, path_entropy, simrank, closure])
def test_odd_candidates(spark, measure):
    g = graph(spark, [(0, 0, 0), (0, 1, 0), (0, 2, 0), (1, 2, 1)])
    c = facts(spark, [(0, 0, 1), (0, 0, 1), (None, 0, 1), (0, None, 1), (77, 0, 1), (0, 0, 77), (77, 0, 78), (1, 1, 2), (0, 0, 0)]).withColumn("score", F.lit("mine")).withColumn("s", F.lit("kept"))
    options = {"steps": 3} if measure is simrank else {}
    rows = measure(g, c, **options).collect()
    assert len(rows) == 9 and all(r.s == "kept" for r in rows)
    got = {}
    for r in rows:
        assert got.setdefault((r.sid, r.pid, r.oid), r.score) == r.score
    assert got[None, 0, 1] is None and got[0, None, 1] is None and got[77, 0, 1] == 0 and got[77, 0, 78] in (0, None) and got[0, 0, 1] is not None
    assert measure(g, c.limit(0), **options).count() == 0
    assert all(r.score in (0, None) or r.sid == r.oid for r in measure(graph(spark, []), c, **options).collect())


@pytest.mark.parametrize(("symmetric", "block", "edges"), [(True, 32, 12), (False, 2, 12), (True, 2, 1000)])
def test_simrank_over_parts_and_blocks(spark, symmetric, block, edges, monkeypatch):
    """Against matrices; the steps' values are files of NumPy columns, of which few lie on disk at a time."""
    monkeypatch.setattr(wide, "_EDGES", edges)
    monkeypatch.setattr(meeting, "_EDGES", 3)
    monkeypatch.setattr(meeting, "_ROWS", 2)
    live, most, kept, dropped = set(), [], meeting.kept, meeting.dropped
    monkeypatch.setattr(meeting, "kept", lambda df, path, *by: (live.add(path), most.append(len([x for x in live if "values-" in x])), kept(df, path, *by)))
    monkeypatch.setattr(meeting, "dropped", lambda s, path: (live.discard(path), dropped(s, path)))
    g, c, steps = graph(spark, [*C, (8, 0, 0), (7, 9, 1)], symmetric), 0.8, 21
    step = np.zeros((10, 10))
    for r in g.edges.collect():
        step[r.s, r.o] = 1.0
    step /= np.maximum(1.0, step.sum(axis=1, keepdims=True))
    walk, want = np.eye(10), np.zeros((10, 10))
    for t in range(steps):
        want += c**t * (1 - c) * walk @ walk.T
        walk = walk @ step
    rows = simrank(g, facts(spark, [(s, 0, o) for s in [*range(10), 77] for o in (0, 3, 7, 8, 9)]), c, steps, block).collect()
    assert len(rows) == 55
    for r in rows:
        assert r.score == pytest.approx(want[r.sid, r.oid] if r.sid < 10 else 0.0, abs=1e-12)
    assert max(most) <= 9 and not live


@pytest.mark.parametrize("kind", ["metric", "ultrametric"])
def test_dense_closures_over_parts(spark, gc, kind, monkeypatch):
    """Costs alone come from NumPy columns, costs with paths from the search by rows."""
    monkeypatch.setattr(wide, "_EDGES", 40)
    asked = facts(spark, [(s, 0, o) for s in [*range(8), 77] for o in (3, 7)])
    some, every = (closure(gc, asked, kind=kind, paths=paths) for paths in (False, True))
    assert {(r.sid, r.oid): r.score for r in some.collect()} == {(r.sid, r.oid): r.score for r in every.collect()}


def test_merged_labels_mark_what_changed():
    """Later rounds read marked labels only: those of which the first or the second got better."""
    far, none = wide.FAR, wide._NONE
    state = [np.array([5, 5, 5, far]), np.array([1, 1, 1, none]), np.array([9, 9, 9, far]), np.array([2, 2, 2, none])]
    fresh = np.zeros(4, bool)
    wide.merged(state, np.array([0, 1, 2, 3]), np.array([5, 7, 4, 8]), np.array([1, 3, 1, 3]), fresh)
    assert fresh.tolist() == [False, True, True, True]
    assert [x.tolist() for x in state] == [[5, 5, 4, 8], [1, 1, 1, 3], [9, 7, 9, far], [2, 3, 2, none]]
    one, fresh = [np.array([5, 5])], np.zeros(2, bool)
    wide.merged(one, np.array([0, 1]), np.array([4, 6]), None, fresh)
    assert one[0].tolist() == [4, 5] and fresh.tolist() == [True, False]


@pytest.mark.parametrize("symmetric", [True, False])
def test_closure_paths_by_columns(spark, symmetric, monkeypatch):
    """Paths of dense facts are followed in columns, with the rows that the search by rows has, ties and own edges too."""
    monkeypatch.setattr(wide, "_EDGES", 40)
    monkeypatch.setattr(wide, "_FACTS", 3)
    rng = random.Random(5)
    rows = sorted({(rng.randrange(12), rng.randrange(12), rng.randrange(3)) for _ in range(60)})
    g = graph(spark, rows, symmetric)
    asked = facts(spark, [(s, p, o) for s in range(13) for p in (0, 2) for o in range(8)])
    sims = spark.createDataFrame([(a, b, 1.0 if a == b else 0.5) for a in (0, 2) for b in range(3) if (a, b) != (2, 1)], "r1 int, r2 int, sim double")
    columns = ["sid", "pid", "oid", "score", "path", "rpath", "weights"]
    calls = []
    monkeypatch.setattr(closures, "least_costs", lambda *a: calls.append(1) or wide.least_costs(*a))
    for options in ({"weight": "degree"}, {"relsim": sims, "free_last_hop": False})[: 1 + symmetric]:
        dense_rows = sorted(map(tuple, closure(g, asked, **options).select(columns).collect()))
        assert calls.pop() and not calls
        with monkeypatch.context() as m:
            m.setattr(closures, "groups_of", lambda f: None)
            assert dense_rows == sorted(map(tuple, closure(g, asked, **options).select(columns).collect()))


@pytest.mark.parametrize("fact", [(0, 1, 3), (0, 5, 3), (3, 0, 5), (5, 1, 2), (0, 4, 1), (0, 0, 0)])
def test_walks_without_the_own_edge(spark, gc, fact):
    loops = graph(spark, [*C, (0, 0, 0), (0, 0, 1)])
    for g in (gc, loops):
        rows = [(r.s, r.p, r.o) for r in g.edges.collect() if (r.s, r.p, r.o) != fact]
        s, _, o = fact
        w2 = sum(1 for a in rows if a[0] == s for b in rows if a[2] == b[0] and b[2] == o)
        w3 = sum(1 for a in rows if a[0] == s for b in rows if a[2] == b[0] for c in rows if b[2] == c[0] and c[2] == o)
        row = walk_counts(g, facts(spark, [fact]), "effective").first()
        assert (row.w2, row.w3) == (w2, w3)


def best_paths(edges, fact, degree):
    """Brute force over simple paths: the closure's score and the best paths."""
    s, p, o = fact
    both = {(a, r, b) for a, b, r, *_ in edges} | {(b, r, a) for a, b, r, *_ in edges}
    found = []

    def go(path, rels, cost):
        if path[-1] == o and len(path) > 1:
            found.append((cost, path, rels))
            return
        for a, r, b in both:
            if a == path[-1] and b not in path and (a, r, b) != (s, p, o):
                go([*path, b], [*rels, r], cost + (0 if b == o else degree[b]))

    go([s], [-1], 0)
    least = min(c for c, _, _ in found)
    return 1 / (1 + least), [(q, r) for c, q, r in found if c == least]


@pytest.mark.parametrize(("edges", "relations"), [(D, 2), (E, 3)])
def test_closure(spark, edges, relations):
    g = graph(spark, edges)
    degree = {r.node: r.d for r in g.degrees().collect()}
    every = [(s, p, o) for s in degree for p in range(relations) for o in degree if s != o]
    got = closure(g, facts(spark, every), None, weight="degree", free_last_hop=True).collect()
    assert len(got) == len(every)
    for r in got:
        score, paths = best_paths(edges, (r.sid, r.pid, r.oid), degree)
        assert r.score == pytest.approx(score)
        assert (r.path, r.rpath) in paths
    if edges is E:  # unique optimum of the fixtures
        row = next(r for r in got if (r.sid, r.pid, r.oid) == (2, 1, 1))
        assert row.path == [2, 0, 1] and row.score == pytest.approx(1 / 3)


def test_closure_edges_of_the_definition(spark):
    g = graph(spark, [(0, 1, 0), (2, 3, 0)])
    got = {(r.sid, r.oid): r for r in closure(g, facts(spark, [(0, 0, 0), (0, 0, 3), (0, 0, 1)])).collect()}
    assert got[0, 0].score == 1.0 and got[0, 0].path == [0]
    assert got[0, 3].score == 0.0 and got[0, 3].path == [3] and got[0, 3].rpath == [-1]
    assert got[0, 1].score == 0.0  # its only edge is its own


def test_softmax(spark):
    df = spark.createDataFrame([(2, 0.5), (2, 0.25), (1, 1000.0), (1, 1.0)], "sid long, score double")
    got = sorted((r.sid, round(r.softmaxscore, 9)) for r in normalize(df).collect())
    assert got == [(1, 0.0), (1, 1.0), (2, 0.437823499), (2, 0.562176501)]
    assert any(math.isnan(r.softmaxscore) for r in normalize(df, shifted=False).collect())


def test_dictionary(spark):
    rnd = random.Random(3)
    names = sorted({f"n{rnd.randrange(500)}" for _ in range(300)})
    got = dense_ids(spark.createDataFrame([(n,) for n in names * 2] + [(None,)], "name string"), "name", "id").orderBy("id").collect()
    assert [(r.id, r.name) for r in got] == list(enumerate(names))
    nodes, relations, edges = encode_triples(spark.createDataFrame([("b", "r", "a"), ("a", "q", "c"), ("a", None, "c")], "sub string, pred string, obj string"))
    assert sorted(tuple(r) for r in edges.collect()) == [(0, 0, 2), (1, 1, 0)]
    assert nodes.count() == 3 and relations.count() == 2
