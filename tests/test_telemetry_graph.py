import itertools
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsgauge.operators import graph as G
from newsgauge.operators import scoring
from newsgauge.operators import telemetry as L

T0 = datetime(2024, 1, 1)


def test_sliding_counts_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else f"c{i % 4}", "e", T0 + timedelta(seconds=rng.randint(0, 400), microseconds=rng.choice([0, 1, 999999]))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, client string, endpoint string, ts timestamp_ntz")
    got = {r.id: (r.request_count, r.limited, r.remaining) for r in L.rate_limits(df, limit=5, period_seconds=60).collect()}
    for i, client, _, ts in rows:
        n = sum(1 for _, c, _, t in rows if c == client and timedelta(0) <= ts - t < timedelta(seconds=60))
        assert got[i] == (n, n >= 5, max(0, 5 - n))


def test_one_busy_client_in_one_period(spark):
    """Slices share the work of a cell; a client without name counts as one."""
    rows = [(i, None if i % 5 == 0 else "hot", "e", T0 + timedelta(milliseconds=i * 40)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, client string, endpoint string, ts timestamp_ntz")
    for slices in (1, 7, 64):
        got = {r.id: r.request_count for r in L.rate_limits(df, 5, 3600, slices).collect()}
        assert got == {i: i // 5 + 1 if i % 5 == 0 else i - i // 5 for i, *_ in rows}


@pytest.mark.parametrize("weight", [0.7, 0.05, 1.0])
def test_moving_average_equals_the_recursion(spark, weight):
    rng = random.Random(2)
    rows = [("a", i, rng.uniform(0, 100)) for i in range(3000)] + [("b", 0, 5.0)]
    got = {r.k: r.ewma for r in L.ewma(spark.createDataFrame(rows, "k string, t long, v double"), "k", "v", ["t"], weight).collect()}
    average = None
    for _, _, v in rows[:3000]:
        average = v if average is None else average * (1 - weight) + v * weight
    assert got["a"] == pytest.approx(average, rel=1e-12) and got["b"] == 5.0


def test_alert_bins(spark):
    rows = [(i, T0 + timedelta(minutes=m), q, float(d), s, "x") for i, (m, q, d, s) in enumerate([(0, "a", 100, 3), (14, "a", 50, 3), (15, "a", 10, 3), (16, "b", 500, 1)])]
    log = spark.createDataFrame(rows, "op_id long, ts timestamp_ntz, query_type string, duration_ms double, severity int, backend string")
    assert [(r.query_type, r.bin, r.avg_duration) for r in L.slow_alerts(log, 70.0).orderBy("bin").collect()] == [("a", T0, 75.0), ("b", T0 + timedelta(minutes=15), 500.0)]
    assert [(r.bin, r.error_count) for r in L.error_alerts(log, 1).collect()] == [(T0, 2)]


def test_retry(spark):
    d = spark.createDataFrame([(float(i),) for i in range(7)], "a double").coalesce(1)
    assert [r[0] for r in d.select(L.retry_delay(F.col("a"))).collect()] == [5000, 10000, 20000, 40000, 80000, 120000, 120000]
    queue = spark.createDataFrame([(i, s, a) for i, s, a in [(1, 1, 0), (2, 1, 3), (3, 1, 0), (4, 2, 0), (5, 1, 0), (6, 1, 1)]], "delivery_id long, subscriber_id long, attempts int")
    subs = spark.createDataFrame([(1, True), (2, False)], "subscriber_id long, active boolean")
    log = spark.createDataFrame([(1, 200), (2, 500), (3, 404), (4, 200), (6, 429)], "delivery_id long, status_code int")
    step = L.retry_step(queue, subs, log)
    got = {r.delivery_id: (r.outcome, r.requeued, r.delay_ms) for r in step.collect()}
    assert got == {1: ("delivered", False, None), 2: ("retry", False, 40000.0), 3: ("failed", True, None), 6: ("retry", True, 10000.0)}
    assert tuple(L.retry_totals(queue, step).first()) == (1, 2, 6)


def test_fanout_delivers_once(spark):
    events = spark.createDataFrame([(1, "a"), (2, "b")], "event_id long, event_type string")
    subs = spark.createDataFrame([(1, ["a", "*"], True), (2, ["b"], True), (3, ["*"], False), (4, ["c"], True)], "subscriber_id long, events array<string>, active boolean")
    assert sorted((r.event_id, r.subscriber_id) for r in L.event_fanout(events, subs).collect()) == [(1, 1), (2, 1), (2, 2)]


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(11)
    pairs = {(rng.randint(0, 11), rng.randint(0, 11)) for _ in range(45)}
    pairs |= {(0, t) for t in range(1, 12)}  # a hub
    rows = [(s, t, "cites" if (s + t) % 2 else "causes", "weak", rng.randint(0, 100), T0 + timedelta(minutes=s * 20 + t)) for s, t in sorted(pairs) if s != t]
    return rows, spark.createDataFrame(rows, "source_id long, target_id long, rel_type string, strength string, impact_score int, updated_at timestamp_ntz")


def simple_paths(rows, depth):
    out = {}
    for s, t, _, _, w, _ in rows:
        out.setdefault(s, []).append((t, w))

    def walk(path, product):
        if len(path) > 1:
            yield path, product
        if len(path) <= depth:
            for t, w in out.get(path[-1], []):
                if t not in path:
                    yield from walk(path + [t], product * w)

    for s in out:
        yield from ((s, p, x) for p, x in walk([s], 1))


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_propagation_equals_brute_force(spark, edges, depth):
    rows, df = edges
    seeds = df.select(F.col("source_id").alias("id")).distinct()
    want = {}
    for s, p, x in simple_paths(rows, depth):
        n = len(p) - 1
        want[tuple(p)] = x / 100 ** n * 100 * math.prod(0.7 ** i for i in range(n))
    if depth <= 3:
        got = {tuple(r.path): r.impact for r in G.propagation_paths(df, seeds, depth).collect()}
        assert got == pytest.approx(want)
        high = {tuple(r.path) for r in G.propagation_paths(df, seeds, depth, min_impact=5.0).collect()}
        assert high == {p for p, x in want.items() if x >= 5.0}
    for r in G.propagation_total(df, seeds, depth).collect():
        mine = {p: x for p, x in want.items() if p[0] == r.source_id}
        assert r.paths == len(mine) and r.total_impact == pytest.approx(sum(mine.values()))
        assert r.nodes_affected == len({p[-1] for p in mine})


def ego(rows, center, depth):
    """Nodes by distance and undirected edges that leave a node within ``depth``."""
    out = {}
    for s, t, *_ in rows:
        out.setdefault(s, set()).add(t)
    distance, frontier = {center: 0}, [center]
    for d in range(1, depth + 1):
        frontier = [t for s in frontier for t in out.get(s, ()) if distance.setdefault(t, d) == d]
    return distance, {frozenset((s, t)) for s in distance for t in out.get(s, ())}


def betweenness(links):
    near = {}
    for a, b in map(tuple, links):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def search(s):
        level, count, frontier = {s: 0}, {s: 1}, [s]
        while frontier:
            following = []
            for u in frontier:
                for v in near[u]:
                    if v not in level:
                        level[v], count[v] = level[u] + 1, 0
                        following.append(v)
                    if level[v] == level[u] + 1:
                        count[v] += count[u]
            frontier = following
        return level, count

    found = {s: search(s) for s in near}
    score = dict.fromkeys(near, 0.0)
    for s, t in itertools.combinations(near, 2):
        ls, cs = found[s]
        lt, ct = found[t]
        if t in ls:
            for v in near:
                if v not in (s, t) and v in ls and v in lt and ls[v] + lt[v] == ls[t]:
                    score[v] += cs[v] * ct[v] / cs[t]
    return score


@pytest.mark.parametrize("depth", [1, 2])
def test_ego_networks(spark, edges, depth):
    rows, df = edges
    seeds = df.select(F.col("source_id").alias("id")).distinct()
    reached = {}
    for r in G.reach(df, seeds, depth).collect():
        reached.setdefault(r.center, {})[r.node] = r.depth
    links = G.ego_edges(df, seeds, depth)
    found = {}
    for r in links.collect():
        found.setdefault(r.center, set()).add(frozenset((r.a, r.b)))
    stats = {r.center: r for r in G.network_stats(links).collect()}
    scores = {}
    for r in G.betweenness(links, depth).collect():
        scores.setdefault(r.center, {})[r.node] = r.betweenness
    for center in reached:
        distance, want = ego(rows, center, depth)
        assert reached[center] == distance and found[center] == want
        nodes = set().union(*want)
        degree = {n: sum(n in e for e in want) for n in nodes}
        s = stats[center]
        assert (s.num_nodes, s.num_edges, s.max_degree) == (len(nodes), len(want), max(degree.values()))
        assert s.node_with_max_degree == min(n for n in nodes if degree[n] == s.max_degree)
        assert scores[center] == pytest.approx(betweenness(want))


def test_last_write_wins(spark):
    log = spark.createDataFrame([(1, 2, 10, T0), (1, 2, 20, T0 + timedelta(days=1)), (2, 1, 30, T0)], "source_id long, target_id long, impact_score int, updated_at timestamp_ntz")
    assert sorted((r.source_id, r.target_id, r.impact_score) for r in G.latest_edges(log).collect()) == [(1, 2, 20), (2, 1, 30)]


def test_bars_are_scaled_to_the_largest(spark, edges):
    bars = {r.rel_type: (r.n, r.bar) for r in G.relation_distribution(edges[1]).collect()}
    top = max(n for n, _ in bars.values())
    assert all(bar == int(n / top * 40) for n, bar in bars.values())


def test_lexicon_and_model_agree_and_cut_nothing(spark):
    long_text = "gain " * 400 + "loss " * 1000  # the verdict is beyond the first 1024 characters
    texts = ["profit growth", "weak loss gain", "nothing", "", None, long_text]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    want = {0: ("positive", 1.0), 1: ("negative", -1 / 3), 2: ("neutral", 0.0), 3: ("neutral", 0.0), 4: ("neutral", 0.0), 5: ("negative", -600 / 1400)}
    native = {r.id: (r.sentiment_label, r.sentiment_score) for r in scoring.lexicon_score(df, "text").collect()}
    assert {k: v[0] for k, v in native.items()} == {k: v[0] for k, v in want.items()}
    assert {k: v[1] for k, v in native.items()} == pytest.approx({k: v[1] for k, v in want.items()})

    def load():
        def score(batch):
            if any("boom" in t for t in batch):
                raise RuntimeError("model failed")
            return [("positive", 1.0) if t.count("gain") > t.count("loss") else ("negative", 0.5) for t in batch]
        return score

    more = df.union(spark.createDataFrame([(6, "boom")], df.schema))
    scored = scoring.model_score(more, "text", load, max_chars=1000, batch=3).collect()
    assert [r.id for r in scored if r.scoring_failed] == [6]
    got = {r.id: (r.sentiment_label, r.sentiment_score, r.confidence) for r in scored}
    assert got[6] == got[3] == got[4] == ("neutral", 0.0, 0.0)
    assert got[0] == ("negative", -0.5, 0.5)
    assert got[5][0] == "negative" or got[5][1] == pytest.approx((2000 * 1.0 - 5000 * 0.5) / 7000)


def test_betweenness_of_whole_networks_and_by_joins(spark):
    """The same from tasks that hold a network and from joins, also with several blocks of starts."""
    rng = random.Random(7)
    edges = [(f"n{rng.randint(0, 25)}", f"n{rng.randint(0, 25)}", "relates_to", "weak", 50, T0) for _ in range(90)]
    df = spark.createDataFrame([e for e in edges if e[0] != e[1]], "source_id string, target_id string, rel_type string, strength string, impact_score int, updated_at timestamp")
    ego = G.ego_edges(df, spark.createDataFrame([("n1",), ("n2",), ("gone",)], "id string"), 2)
    round_ = lambda d: {(r.center, r.node): round(r.betweenness, 9) for r in d.collect()}
    whole = round_(G.betweenness(ego, 2))
    assert whole and whole == round_(G.betweenness(ego, 2, starts=3)) == round_(G.betweenness(ego, 2, most_edges=0))
    assert G.betweenness(ego.limit(0), 2).count() == 0
