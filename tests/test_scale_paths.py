"""The block-wise and level-wise algorithms against brute force, with one key holding most rows."""

from __future__ import annotations

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from repolumen.operators import documents, graph, requestlog
from repolumen.operators.ordering import in_blocks, ordinal, running


def log(n=3000, seed=5):
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += rng.choice([0, 1, 5, 20, 61, 400]) * 1_000_000 + rng.randrange(1000)
        key = 1 if rng.random() < 0.6 else rng.randrange(2, 9)
        bad = rng.random() < 0.35
        rows.append((i, key, at, rng.randrange(100), not bad, rng.choice([429, 503, 400]) if bad else None))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, key long, at long, tokens long, ok boolean, error_code int")
    return df.withColumn("ts", F.timestamp_micros("at")).drop("at").repartition(4)


def by_key(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    return groups


def test_running_and_ordinal(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i, i % 11) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    blocked = in_blocks(df, ["g"], ["i"], "test")
    assert blocked.select("_block").distinct().count() > 1
    got = {(r.g, r.i): (r.s, r.m) for r in running(running(blocked, ["g"], ["i"], "s", F.col("v")),
                                                   ["g"], ["i"], "m", F.col("v"), "max").collect()}
    places = {(r.g, r.i): r.n for r in ordinal(df, ["g"], ["i"], "n", "test").collect()}
    seen = defaultdict(lambda: [0, -1, -1])
    for g, i, v in rows:
        state = seen[g]
        state[0] += v
        state[1] = max(state[1], v)
        state[2] += 1
        assert got[g, i] == (state[0], state[1]) and places[g, i] == state[2]


def test_health_fold_cooldowns_and_conflicts(spark):
    rows = log()
    df = frame(spark, rows)
    health, marks, hits, streaks = {}, {}, {}, {}
    for key, items in by_key(rows).items():
        score, fails, until, streak = 100, 0, -1, 0
        for i, _, at, _, ok, code in items:
            if at < until:
                hits[i] = until - at
            streak = 0 if ok else streak + 1
            streaks[i] = streak
            if ok:
                score, fails = min(100, score + 5), max(0, fails - 1)
                continue
            if code == 429 or code == 503:
                fails += 1
                until = at + (30 if code == 429 else 10) * min(fails, 5) * 1_000_000
                marks[i] = (fails, until)
                score = max(0, score - 15)
            if code != 503:
                fails, score = fails + 1, max(0, score - 10)
        health[key] = (score, fails)
    assert {r.key: (r.health, r.failures) for r in requestlog.key_health(df).collect()} == health
    intervals = requestlog.cooldown_intervals(df)
    assert {r.event_id: (r.failures, r.until_micros) for r in intervals.collect()} == marks
    got = {r.event_id: r.remaining_micros for r in requestlog.cooldown_conflicts(df, intervals).collect()}
    assert got == hits and len(hits) > 50
    assert {r.event_id: r.streak for r in requestlog.consecutive_errors(df).collect()} == streaks


def test_fold_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr("repolumen.operators.ordering.CHUNK_ROWS", 7)
    test_health_fold_cooldowns_and_conflicts(spark)


def test_rolling_usage_and_gaps(spark):
    rows = log(1500, 9)
    df = frame(spark, rows)
    used, gaps = {}, set()
    for items in by_key(rows).values():
        for n, r in enumerate(items):
            used[r[0]] = sum(o[3] for o in items if r[2] - 60_000_000 < o[2] <= r[2])
            if n and r[2] - items[n - 1][2] < 1_000_000:
                gaps.add(r[0])
    assert {r.event_id: r.used for r in requestlog.rolling_usage(df).collect()} == used
    assert {r.event_id for r in requestlog.min_interval_violations(df).collect()} == gaps and gaps


def brandes(nodes, links):
    out = defaultdict(set)
    for s, t in links:
        out[s].add(t)
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        order, before, paths, dist = [], defaultdict(list), defaultdict(float), {s: 0}
        paths[s] = 1.0
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                score[w] += share[w]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in score.items()}


@pytest.mark.parametrize("blocks", [1, 3])
def test_betweenness_equals_brandes(spark, blocks):
    rng = random.Random(3)
    graphs = {}
    for repo, (n, m) in {"dense": (14, 40), "sparse": (25, 26), "chain": (20, 0), "hub": (0, 0), "ring": (12, 0)}.items():
        links = {(f"n{a}", f"n{b}") for a, b in (rng.sample(range(n), 2) for _ in range(m))}
        if repo == "chain":
            links = {(f"n{i}", f"n{i + 1}") for i in range(n - 1)} | {(f"n{i}", f"leaf{i}") for i in range(n)} | {("n5", "n2")}
        if repo == "hub":  # many in, many out, all through one node or its twin
            links = {(f"a{i}", h) for i in range(30) for h in ("hub", "twin")} | {("hub", f"b{i}") for i in range(30)} \
                | {("twin", f"b{i}") for i in range(0, 30, 2)} | {("b3", "hub")}
        if repo == "ring":
            links = {(f"n{i}", f"n{(i + 1) % n}") for i in range(n)} | {("n0", "n6")}
        graphs[repo] = ({x for e in links for x in e} | {"alone"}, links)
    nodes = spark.createDataFrame([(r, v) for r, (vs, _) in graphs.items() for v in vs], "repo string, id string")
    edges = spark.createDataFrame([(r, *e) for r, (_, es) in graphs.items() for e in es] + [("dense", "n1", "n1")],
                                  "repo string, source string, target string")
    got = {(r.repo, r.id): r.betweenness_centrality for r in graph.betweenness_centrality(nodes, edges, blocks).collect()}
    for repo, (vs, links) in graphs.items():
        for v, want in brandes(sorted(vs), links).items():
            assert abs(got.get((repo, v), 0.0) - want) < 1e-12
    assert all(x > 0 for x in got.values())
    none = edges.where("source = 'none'")
    assert graph.betweenness_centrality(nodes, none, blocks).count() == 0


def test_degree_counts_dangling_targets(spark):
    nodes = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "c")], "repo string, id string")
    links = spark.createDataFrame([("r", "a", "b"), ("r", "a", "gone")], "repo string, source string, target string")
    got = {r.id: r.degree_centrality for r in graph.degree_centrality(nodes, links).collect()}
    assert got == {"a": 2 / 3, "b": 1 / 3, "gone": 1 / 3, "c": 0.0}


def test_large_documents_stay_whole_in_parts(spark):
    rows = [("r", "d", s, f"k{k:02d}", f"[{s}-{k}]") for s in range(2) for k in range(10)] + [("q", "d", 0, "", "tiny")]
    sections = spark.createDataFrame(rows, "repo string, doc_name string, sec int, key string, text string")
    parts = documents.assemble(sections).orderBy("repo", "sec", "part").collect()
    whole = {}
    for p in parts:
        whole[p.repo] = whole.get(p.repo, "") + p.content
    assert whole == {"r": "".join(r[4] for r in rows if r[0] == "r"), "q": "tiny"}
    assert len(parts) == 21 and max(len(p.content) for p in parts) == 5


def test_betweenness_steps_follow_reached_nodes_only(spark):
    """A package that many files of other folders use: steps back from it must not meet the files a start cannot reach."""
    folders, files, package = 30, 20, 9999
    links = [(d, 100 + files * d + k, 0) for d in range(folders) for k in range(files)] \
        + [(100 + files * d + k, package, 0) for d in range(folders) for k in range(files)]
    steps = spark.createDataFrame(links, "v long, w long, leaves long")
    levels = graph._levels(steps, steps)
    assert [level.count() for level in levels] == [len(links), folders]
    shares = graph._passed(levels, steps)[-1]
    rows = shares.collect()
    assert len(rows) == len(links) + folders * files  # the edges, and one step per folder and file
    assert sum(r.share for r in rows) == pytest.approx(folders)  # each package is one target per folder
    assert "string" not in {f.dataType.simpleString() for f in levels[1].schema}
