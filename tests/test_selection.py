"""Density clusters, spread selection, multi-index matching, nearest places and album choices against plain versions."""

import json
import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyline.operators import choices, density, evaluate, layout, places, series, submodular
from storyline.plans import selection_queries as q

DATA = "/root/testdata/sf0.01"


# ---- density clusters


def plain_density(vectors, least, core, reach):
    """Labels from all pairs: components at every distance, from near to far, with stabilities."""
    ids = sorted(i for i, v in vectors.items() if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v))
    if not ids:
        return {i: None for i in vectors}
    u = np.array([vectors[i] for i in ids], np.float64)
    u /= np.sqrt((u * u).sum(1))[:, None]
    d = np.round(np.maximum(2 - 2 * u @ u.T, 0), 9)
    np.fill_diagonal(d, np.inf)
    limit = round(reach * reach, 9)
    n = len(ids)
    cores = np.sort(d, 1)[:, core - 1] if n > core else np.full(n, np.inf)
    w = np.maximum(np.maximum(d, cores[:, None]), cores[None, :])
    links = sorted((w[a, b], a, b) for a in range(n) for b in range(a + 1, n) if w[a, b] <= limit)
    comp = [{i} for i in range(n)]
    of = list(range(n))
    cluster = [None] * n  # of a component
    tree, home, k = {}, {}, 0
    while k < len(links):
        level, touched = links[k][0], defaultdict(set)
        near = 1 / max(math.sqrt(level), density.NEAREST)
        before = {c: (len(comp[c]), cluster[c]) for c in set(of)}
        parts = {c: [c] for c in before}
        while k < len(links) and links[k][0] == level:
            a, b = of[links[k][1]], of[links[k][2]]
            if a != b:
                comp[a] |= comp[b]
                parts[a] += parts.pop(b)
                for i in comp[b]:
                    of[i] = a
                touched[a] = True
            k += 1
        for c in [c for c in touched if of[next(iter(comp[c]))] == c]:
            if len(parts[c]) == 1:
                continue
            big = [p for p in parts[c] if before[p][1] is not None]
            size = sum(before[p][0] for p in parts[c])
            if len(big) == 1:
                name = before[big[0]][1]
                tree[name]["sums"] += (size - before[big[0]][0]) * near
                tree[name]["rows"] |= comp[c]
            elif big or size >= least:
                name = len(tree)
                tree[name] = {"sums": size * near, "rows": set(comp[c]), "children": [before[p][1] for p in big], "born": None}
                for p in big:
                    tree[before[p][1]]["born"] = near
            else:
                name = None
            cluster[c] = name
    end = 1 / max(math.sqrt(limit), density.NEAREST)
    for t in tree.values():
        t["stability"] = t["sums"] - len(t["rows"]) * (t["born"] or end)
    value = {}
    for name in sorted(tree):
        t = tree[name]
        t["below"] = sum(value[c] for c in t["children"])
        value[name] = max(t["stability"], t["below"])
    label = {i: None for i in vectors}
    taken = set()
    for name in sorted(tree, reverse=True):
        t = tree[name]
        if t["stability"] >= t["below"] and not taken & t["rows"]:
            taken |= t["rows"]
            for i in t["rows"]:
                label[ids[i]] = min(ids[j] for j in t["rows"])
    return label


def clustered(seed, n):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((6, 12))
    out = {i: (centres[i % 6] + r.uniform(0.1, 0.7) * r.standard_normal(12)).tolist() for i in range(n)}
    out |= {n + i: r.standard_normal(12).tolist() for i in range(n // 5)}
    out |= {2000 + i: list(out[0]) for i in range(12)}  # copies
    return out | {3001: None, 3002: [0.0] * 12, 3003: [float("nan")] * 12, 3004: [None] * 12}


@pytest.mark.parametrize(("n", "block", "keep", "at_once"), [(80, 20, 3, 40), (90, 2048, 16, 50_000)])
def test_density_clusters_equal_plain_ones(spark, monkeypatch, n, block, keep, at_once):
    monkeypatch.setattr(density, "BLOCK", block)
    monkeypatch.setattr(density.spanning_forest, "__defaults__", (keep,))
    monkeypatch.setattr(density.condensed_tree, "__defaults__", (at_once,))
    vectors = clustered(n, n)
    df = spark.createDataFrame(list(vectors.items()), "id long, v array<double>")
    rows = density.density_clusters(df, "id", "v", 5, 3, 0.9).collect()
    got = {r.id: r.label for r in rows}
    assert got == plain_density(vectors, 5, 3, 0.9)
    assert len(set(got.values())) > 3 and got[3001] is None
    sizes = Counter(x for x in got.values() if x is not None)
    assert all(r.size == sizes[r.label] for r in rows if r.label is not None)


def test_density_groups_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = {r.id: r.label for r in q.density_groups(spark, DATA).collect()}
    assert got == plain_density({r.vec_id: r.embedding for r in rows}, 5, 3, 1.4**0.5)
    assert q.density.density_clusters(spark.createDataFrame([], "id long, v array<double>"), "id", "v").count() == 0


# ---- spread selection


def plain_value(rows, chosen):
    """F(A) by its formula. rows: id to dict."""
    held = [rows[i] for i in chosen]
    root = lambda key: sum(math.sqrt(n) for n in Counter(r[key] for r in held).values())
    total = sum(r["score"] or 0.0 for r in held) + submodular.MONTH * root("month") + submodular.KIND * root("kind")
    importance = {r["event"]: r["importance"] or 0.0 for r in held}
    total += submodular.EVENT * sum(importance[e] * math.sqrt(n) for e, n in Counter(r["event"] for r in held).items())
    shown, weight = Counter(), {}
    for r in held:
        for p in r["persons"] or []:
            shown[p["person"]] += 1
            weight[p["person"]] = p["weight"]
    total += submodular.PERSON * sum(weight[p] * math.sqrt(n) for p, n in shown.items())
    u = [None if r["embedding"] is None else np.array(r["embedding"]) / np.linalg.norm(r["embedding"]) for r in held]
    return total - submodular.ALIKE * sum(max(0.0, float(a @ b) - submodular.FREE) for a, b in combinations(u, 2) if a is not None and b is not None)


def plain_greedy(pool, k):
    chosen = submodular.Chosen(pool)
    for _ in range(min(k, pool.n)):
        g = chosen.gains()
        g[chosen.members] = -np.inf
        chosen.put(int(np.argmax(g)))
    return chosen


def photo_rows(seed, n):
    r = random.Random(seed)
    vectors = [[r.gauss(0, 1) for _ in range(6)] for _ in range(25)]
    return {
        i: {
            "id": i, "score": r.choice([None, r.random()]), "month": r.choice([None, "a", "b", "c"]), "event": r.choice(["x", "y", "z", None]), "importance": None, "kind": r.choice("kl"),
            "persons": r.choice([None, [], [{"person": 1, "weight": 0.9}], [{"person": 1, "weight": 0.9}, {"person": 2, "weight": 0.4}]]),
            "embedding": r.choice([None, [x + r.gauss(0, 0.1) for x in r.choice(vectors)]]),
        }
        for i in range(n)
    }


SCHEMA = "id long, score double, month string, event string, importance double, kind string, persons array<struct<person:long,weight:double>>, embedding array<double>"


def test_spread_selection_equals_plain_greedy_and_swaps_gain(spark):
    rows = photo_rows(4, 300)
    for r in rows.values():
        r["importance"] = {"x": 0.2, "y": 0.9, "z": None, None: 0.5}[r["event"]]
    df = spark.createDataFrame(list(rows.values()), SCHEMA)
    one = submodular.select_spread(df, 20, swaps=False).orderBy("place").collect()
    import pandas as pd

    pool = submodular.Pool(pd.DataFrame(list(rows.values())))
    want = plain_greedy(pool, 20)
    assert [r.id for r in one] == [int(pool.id[i]) for i in want.members]
    assert abs(one[0].value - plain_value(rows, [r.id for r in one])) < 1e-6
    more = submodular.select_spread(df, 20).collect()
    ids = [r.id for r in more]
    assert len(set(ids)) == 20 and abs(more[0].value - plain_value(rows, ids)) < 1e-6 and more[0].value >= one[0].value - 1e-9
    # No swap is left that gains.
    assert all(plain_value(rows, [j for j in ids if j != i] + [k]) <= more[0].value + 1e-5 for i in ids for k in list(rows)[::7] if k not in ids)
    parts = submodular.select_spread(df, 20, at_once=80, swaps=False).collect()
    assert len({r.id for r in parts}) == 20 and abs(parts[0].value - plain_value(rows, [r.id for r in parts])) < 1e-6
    assert parts[0].value >= 0.95 * one[0].value
    assert submodular.select_spread(df.limit(7), 20).count() == 7 and submodular.select_spread(df.limit(0), 20).count() == 0


def test_two_rounds_keep_the_bound_on_the_whole_table(spark):
    """Without the penalty the value never falls, so the bound (1 - 1/e) / 2 holds in expectation; measured against plain greedy."""
    events = q._shown(spark, DATA)
    k = F.col("event_id")
    photos = events.select(k.alias("id"), (F.col("value") / 100).alias("score"), (F.col("t") / 172_800).cast("long").alias("month"), F.col("user_id").alias("event"), F.lit(0.5).alias("importance"), F.lit(None).cast("array<struct<person:long,weight:double>>").alias("persons"), F.col("event_type").alias("kind"), F.col("unit").alias("embedding"))
    whole = submodular.select_spread(photos, 40, at_once=1_000_000, swaps=False).first().value
    parts = submodular.select_spread(photos, 40, at_once=1000, swaps=False).first().value
    assert parts >= (1 - 1 / math.e) / 2 * whole
    assert parts >= 0.98 * whole


# ---- matching


def test_two_nearest_equal_plain_distances_and_meet_few(spark):
    r = random.Random(11)
    lib = [(i, r.choice([0, 0, 0, 1]), r.getrandbits(64) - (1 << 63)) for i in range(4000)] + [(5000 + i, 0, 77) for i in range(300)] + [(1, 0, 12345), (9, None, 5), (10, 3, 5)]
    flip = lambda h, n: ((h ^ sum(1 << k for k in r.sample(range(64), n))) + (1 << 63)) % (1 << 64) - (1 << 63)
    album = [(i, s, flip(h & (2**64 - 1), r.randint(0, 9))) for i, (_, s, h) in enumerate(r.sample(lib[:4000], 300))] + [(900, 0, 77), (901, 0, None), (902, 2, 5), (903, 3, 6), (0, 0, 12345)]
    a = spark.createDataFrame(album, "id long, shape int, h long")
    b = spark.createDataFrame(lib, "id long, shape int, h long")
    looked: list[int] = []
    evaluate.two_nearest(a, b, looked=looked)
    got = {x.id: x for x in evaluate.album_match(a, b).collect()}
    for i in {x[0] for x in album}:
        d: dict[int, int] = {}
        for _, s, h in [x for x in album if x[0] == i and x[2] is not None]:
            for j, s2, h2 in lib:
                if s == s2:
                    d[j] = min(d.get(j, 99), ((h ^ h2) & (2**64 - 1)).bit_count())
        two = sorted((n, j) for j, n in d.items())[:2] + [(None, None)] * 2
        assert (got[i].distance, got[i].best, got[i].runner_up_distance, got[i].runner_up) == (*two[0], *two[1])
    # The second nearest of random hashes is far, so the radius grows until the class itself is met; with a near second it is not.
    pairs = spark.createDataFrame([(2 * i + k, 0, flip(h & (2**64 - 1), k)) for i, (_, _, h) in enumerate(lib[:3000]) for k in (0, 1)], "id long, shape int, h long")
    looked.clear()
    evaluate.two_nearest(spark.createDataFrame([(i, 0, h) for i, (_, _, h) in enumerate(lib[:1000])], "id long, shape int, h long"), pairs, looked=looked)
    assert sum(looked) < 0.01 * 1000 * 6000


# ---- nearest places


def plain_km(a, b, c, d):
    half = lambda x, y: math.sin((math.radians(y) - math.radians(x)) / 2) ** 2
    return 12742 * math.asin(math.sqrt(min(1.0, half(a, c) + math.cos(math.radians(a)) * math.cos(math.radians(c)) * half(b, d))))


@pytest.mark.parametrize("most", [64, 2])
def test_nearest_place_equals_a_plain_scan(spark, most):
    r = random.Random(most)
    towns = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(60)] + [(100 + i, 59.9 + r.random() * 1e-3, 10.7 + r.random() * 1e-3) for i in range(200)]
    towns += [(900, 10.0, 179.99), (901, 10.0, -179.98), (902, 89.9, 20.0), (903, -90.0, 0.0), (904, 10.0, 179.99), (905, None, 3.0), (906, 95.0, 3.0)]
    seen = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(150)] + [(200 + i, 59.9 + r.random() * 1e-3, 10.7 + r.random() * 1e-3) for i in range(60)]
    seen += [(300, 10.0, 180.0), (301, 10.0, -180.0), (302, 89.95, -160.0), (303, 90.0, 0.0), (304, -89.0, 120.0), (305, None, 1.0), (306, 1.0, float("nan"))]
    looked: list[int] = []
    got = {x.id: x for x in places.nearest_place(spark.createDataFrame(seen, "id long, lat double, lon double"), "id", spark.createDataFrame(towns, "id long, lat double, lon double"), most, looked).collect()}
    assert len(got) == len(seen)
    for i, lat, lon in seen:
        if lat is None or lon != lon:
            assert got[i].place is None
            continue
        want = min((round(plain_km(lat, lon, a, b), 6), j) for j, a, b in towns if a is not None and abs(a) <= 90)
        assert got[i].place == want[1] and abs(got[i].km - want[0]) < 1e-5, (i, lat, lon)
    none = places.nearest_place(spark.createDataFrame(seen, "id long, lat double, lon double"), "id", spark.createDataFrame([], "id long, lat double, lon double"))
    assert none.filter("place is null").count() == len(seen)


# ---- series


def test_series_of_lone_photos_and_ties(spark):
    rows = [(1, "a", 0, [1.0, 0.0], 5.0), (2, "a", 60, [1.0, 0.0], 9.0), (3, "a", 120, [0.8, 0.6], 1.0), (4, "a", 300, [1.0, 0.0], 1.0), (5, "b", 60, [1.0, 0.0], 1.0), (6, "a", None, [1.0, 0.0], 1.0), (7, "a", 60, None, 1.0), (8, "a", 120, [0.6, 0.8], 1.0)]
    df = spark.createDataFrame(rows, "id long, l string, t long, u array<double>, s double")
    out = series.like_series(df, ["l"], "id", "t", "u", 60, 0.8)
    assert {r.id: r.series for r in out.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 1}
    picks = {(r.series, r.pick): r.id for r in series.spread_picks(out, ["series"], "id", "s", "u", 3).collect()}
    assert picks == {(1, 0): 2, (1, 1): 8, (1, 2): 3, (4, 0): 4, (5, 0): 5, (6, 0): 6, (7, 0): 7}


def test_series_of_full_cells_write_chains_and_not_pairs(spark, monkeypatch):
    """Parts of three photos that all meet, keys that are text, and a moment in which all are alike: what is written grows with the photos."""
    monkeypatch.setattr(series, "SIDE", 3)
    rng = np.random.default_rng(5)
    rows = [(f"k{i}", "ab"[i % 2], int(rng.integers(0, 400)), (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(90, 3)))]
    rows += [(f"m{i}", "c", 7, [1.0, 0.0, 0.0]) for i in range(60)] + [("n", None, 7, [1.0, 0.0, 0.0]), ("o", "c", 7, [1.0, None, 0.0]), ("p", "c", 7, [1.0])]
    made = []
    monkeypatch.setattr(series, "materialize", lambda df, name: made.append(kept := df.cache()) or kept)
    got = {r.k: r.series for r in series.like_series(spark.createDataFrame(rows, "k string, l string, t long, u array<double>"), ["l"], "k", "t", "u", 20, 0.8).collect()}
    want = {k: k for k, *_ in rows}
    links = [(a[0], b[0]) for a in rows for b in rows if a[1] is not None and a[1] == b[1] and abs(a[2] - b[2]) <= 20 and len(a[3]) == len(b[3]) and None not in a[3] + b[3] and round(float(np.dot(a[3], b[3])), 6) >= 0.8]
    for _ in rows:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want
    assert made[0].filter("k like 'm%'").count() <= 60 * 60 / 3 * 2


def test_picks_write_photos_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(series, "materialize", lambda df, name: made.append(kept := df.cache()) or kept)
    nan = float("nan")
    rows = [(1, i, s, [math.cos(i), math.sin(i)]) for i, s in enumerate([None, 3.0, 3.0, nan, nan, 1.0])] + [(2, 10, None, None), (2, 11, None, [1.0, 0.0]), (None, 20, 1.0, [1.0, 0.0])]
    got = {(r.s, r.pick): r.k for r in series.spread_picks(spark.createDataFrame(rows, "s long, k long, v double, u array<double>"), ["s"], "k", "v", "u").collect()}
    assert got == {(1, 0): 3, (1, 1): 0, (1, 2): 5, (2, 0): 10, (None, 0): 20}
    assert sum(df.count() for df in made) <= len(rows) + len(got)


# ---- album choices


def log_of(rows):
    """(type, values) in order."""
    out = []
    for k, (kind, v) in enumerate(rows):
        c = dict.fromkeys(choices.FIELDS) | {"type": kind} | v
        out.append(("L", k // 2, k, *(c[f] for f in choices.FIELDS)))
    return out


def test_choices(spark):
    rows = [
        ("pleased", {"photos": [1, 2, 3], "on": True, "n": 3}), ("pleased", {"photos": [3, 4], "on": True, "n": 2}),  # the first page goes
        ("gather", {"photos": list(range(20, 34))}), ("gather", {"photos": []}), ("size", {"photo": 33, "n": 9}), ("size", {"photo": 20, "n": 2}),
        ("front", {"photo": 1}), ("back", {"photo": 1}), ("back", {"photo": None}), ("front", {"photo": 5}), ("rotate", {"photo": 2}), *[("rotate", {"photo": 6})] * 4,
        ("crop", {"photo": 7, "x": 150, "y": 30, "n": 900, "whole": False}), ("crop", {"photo": 8, "n": 100}), ("crop", {"photo": 9, "n": 300, "whole": True}),
        ("trip", {"photo": 1, "on": True}), ("trip", {"photo": 1, "on": False}), ("merge", {"photos": [50, 51]}), ("merge", {"photos": [52, 53, 54]}), ("merge", {"photos": [55, 56]}), ("split", {"photo": 55}),
        ("own_story", {"photos": [52, 60, 3]}), ("own_story", {"photos": [60, 51]}), ("own_story", {"photos": [70]}), ("put_back", {"photo": 70}), ("put_back", {"photo": 71}),
        ("pages", {"photo": 1, "n": 0}), ("pages", {"photo": 2, "n": 4}), ("pages", {"photo": 2, "n": None}), ("unheard_of", {}),
    ]
    df = spark.createDataFrame(log_of(rows), f"l string, t long, id long, {choices.COMMAND}")
    got = {tuple(r)[1:] for r in choices.fold_choices(df, ["l"]).collect()}
    want = {("page", 0, i, p, 4, None) for i, p in enumerate(range(20, 32))}  # own size of 33 frees its page; [3, 4] went to a story
    want |= {("front", None, None, 5, None, None), ("rotation", None, None, 2, 90, None), ("focus", None, None, 7, 100, 30), ("zoom", None, None, 7, 400, None), ("whole", None, None, 9, 1, None)}
    want |= {("family_trip", None, None, 1, None, None), ("merged", 0, 0, 53, None, None), ("merged", 0, 1, 54, None, None), ("size", None, None, 33, 4, None), ("size", None, None, 20, 2, None)}
    want |= {("story", 0, 0, 52, None, None), ("story", 0, 1, 3, None, None), ("story", 1, 0, 60, None, None), ("story", 1, 1, 51, None, None), ("pages", None, None, 1, 1, None)}
    assert got == want
    album = choices.Album()
    for c in choices._commands(df.toPandas().sort_values("id")):
        album = choices.Album(album.saved())
        album.apply(c)
    assert {tuple(r) for r in album.rows()} == want
    assert json.loads(album.saved())["covers"] == {"front": 5}


def test_stream_of_choices_equals_the_batch_in_any_order(spark):
    log = q._log(spark, "/root/testdata/sf0.001")
    log = log.unionByName(log.filter("id % 50 = 0"))  # repeated commands
    want = sorted((tuple(r) for r in choices.fold_choices(log, ["library"]).collect()), key=repr)
    got = sorted((tuple(r) for r in q.streamed_choices(spark, log, files=3).collect()), key=repr)
    assert got == want and len({r[1] for r in want}) >= 12


def test_page_policy_of_decisions(spark):
    """A highlighted photo gets its own page, a toned-down one never, and wanting more of a kind says nothing of pages."""
    rows = [("fremhev", None, False, False), ("demp", None, True, True), ("opp", None, True, False), ("opp", None, False, False), ("opp", None, False, True), ("fremhev", 1, True, True), ("demp", 4, True, True), (None, None, None, None)]
    df = spark.createDataFrame(rows, "d string, size int, mood boolean, people boolean")
    got = [r[0] for r in df.select(layout.page_policy(F.col("size"), F.col("d"), F.col("mood"), F.lit(True), F.col("people"))).collect()]
    assert got == ["must", "never", "free", "never", "free", "never", "must", "free"]


def test_choices_of_many_libraries_are_one_stream(spark):
    """Libraries over several batches, one of them null; each row's album is told once. A library is no call of its own."""
    rows = [(None if i % 50 == 7 else i % 50, i, i, "pages", i % 3, None, None, i % 4, None, None, None) for i in range(400)]
    df = spark.createDataFrame(rows, f"l long, t long, id long, {choices.COMMAND}")
    folded = choices.fold_choices(df, ["l"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sorted((-1 if r.l is None else r.l, r.photo, r.value) for r in folded.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(-1 if r[0] is None else r[0], r[4]): max(r[7], 1) for r in rows}
    assert got == sorted((*k, v) for k, v in want.items())
    assert "FlatMapGroupsInPandas" not in folded._jdf.queryExecution().toString()
