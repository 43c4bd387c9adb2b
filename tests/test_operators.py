import random
from datetime import datetime

from pyspark.sql import functions as F

from storyline.functions import scalar as f
from storyline.operators import dedup, draft, evaluate, graph, groups, layout, learn, people, select, timeline
from storyline.sources import files

PHOTO = "library_id string, id long, width int, height int, date_source string, camera_make string, gps_lat double, phash long, exif_t long"


def test_file_names(spark):
    good = {
        "IMG_20110714_123456.jpg": "2011-07-14 12:34:56", "PXL_20230714_123456789.jpg": "2023-07-14 12:34:56", "20110714_123456.jpg": "2011-07-14 12:34:56",
        "Screenshot_20110714-123456.png": "2011-07-14 12:34:56", "2011-07-14 12.34.56.jpg": "2011-07-14 12:34:56", "WhatsApp Image 2011-07-14 at 12.34.56.jpeg": "2011-07-14 12:34:56",
        "signal-2011-07-14-12-34-56-123.jpg": "2011-07-14 12:34:56", "IMG-20110714-WA0001.jpg": "2011-07-14 00:00:00",
    }
    bad = ["IMG_0001.JPG", "DSC01234.JPG", "P1010123.JPG", "bursdag.jpg", "IMG_20111345_123456.jpg", "IMG_20110230_000000.jpg"]
    df = spark.createDataFrame([(n,) for n in [*good, *bad]], "n string").select("n", f.filename_time("n").alias("t"))
    got = {r.n: r.t for r in df.collect()}
    assert {n: str(got[n]) for n in good} == good and all(got[n] is None for n in bad)


def test_scalars(spark):
    row = spark.range(1).select(
        f.hamming(F.lit(-1), F.lit(0)).alias("all"), f.utc_offset(F.lit("-01:30")).alias("off"), f.utc_offset(F.lit("+15:00")).alias("far"),
        f.natural_pages(F.lit(300), F.lit(False), F.lit(False), F.lit(None).cast("int")).alias("big"), f.natural_pages(F.lit(300), F.lit(False), F.lit(True), F.lit(None).cast("int")).alias("trip"),
        f.price(F.lit(51)).alias("price"), f.name_line(F.array(F.lit("A"), F.lit("B"), F.lit("C"))).alias("names"), f.percent_encoded(F.lit("a b\n*~")).alias("enc"),
        f.valid_gps(F.lit(0.0), F.lit(0.0)).alias("gps"), f.format_of(F.lit("x.HEIC")).alias("fmt"),
    ).first()
    assert row.all == 64 and row.off == -90 and row.far is None and row.big == 10 and row.trip == 5
    assert row.price == 700 and row.names == "A, B and C" and row.enc == "a%20b%0D%0A%2A~" and row.gps is None and row.fmt == "heic"


def test_events(spark):
    h = 3600
    rows = [("L", 1, 10 * h), ("L", 2, 12 * h), ("L", 3, 20 * h), ("L", 4, 33 * h), ("L", 5, None), ("L", 6, 15 * h)]
    df = spark.createDataFrame(rows, "l string, id long, t long")
    assert [r.event for r in timeline.assign_events(df, ["l"], "t", "id").orderBy("id").collect()] == [0, 0, 1, 2, None, 0]


def test_duplicates(spark):
    rows = [("L", 1, 4032, 3024, "exif", "C", None, 0b0, 100), ("L", 2, 1600, 1200, "exif", None, None, 0b11, 101), ("L", 3, 1280, 960, None, None, None, 0b100, None), ("L", 4, 900, 900, "exif", None, None, 2**40 - 1, 100), ("L", 5, 4032, 3024, "exif", None, None, 0b1, 106)]
    df = spark.createDataFrame(rows, PHOTO)
    pairs = {(r.a, r.b) for r in dedup.photo_duplicates(df).collect()}
    assert pairs == {(1, 2), (1, 3), (2, 3), (3, 5)}
    marked = dedup.mark_duplicates(df.filter("id <> 5").withColumn("duplicate_of", F.lit(None).cast("long")))
    assert {r.id: r.duplicate_of for r in marked.collect()} == {1: None, 2: 1, 3: 1, 4: None}


def test_banded_join_is_exact(spark):
    r = random.Random(1)
    base = [r.getrandbits(60) for _ in range(30)]
    rows = []
    for i in range(300):
        v = r.choice(base)
        for _ in range(r.randint(0, 8)):
            v ^= 1 << r.randrange(60)
        rows.append((i, v))
    got = {(x.a, x.b) for x in dedup.hamming_pairs(spark.createDataFrame(dict(rows).items(), "k long, h long"), "k", "h", 6, 60).filter("d > 0").collect()}
    assert got == {(a, b) for a, x in rows for b, y in rows if a < b and 0 < (x ^ y).bit_count() <= 6}


def test_components(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200 + i) for i in range(30)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)]
    up = {}
    for a, b in edges:
        for x in (a, b):
            up.setdefault(x, x)
    find = lambda x: x if up[x] == x else find(up[x])
    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        up[hi] = lo
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[x] == find(x) for x in got) and set(got) == {x for a, b in edges if a != b for x in (a, b)}


def test_month_quotas(spark):
    df = spark.createDataFrame([("a", 1, 100), ("a", 2, 25), ("b", 1, 2), ("b", 2, 100)], "l string, m int, n long")
    q = lambda l, k: [r.quota for r in select.month_quotas(df.filter(F.col("l") == l), ["l"], k).orderBy("m").collect()]
    assert q("a", 15) == [10, 5] and q("b", 10) == [2, 9]


def test_baseline_takes_exactly_k(spark):
    rows = [("L", i, i * 86_400 * 365 // 200, f"{i * 12 // 200:02}", (i % 10) / 10, True) for i in range(200)]
    df = spark.createDataFrame(rows, "l string, id long, t long, month string, score double, best boolean")
    for k in (10, 50, 200, 250):
        assert select.baseline(df, ["l"], "t", "month", "score", "id", "best", k).count() == min(k, 200)


def test_learning(spark):
    log = lambda reason, n, action="ta_med": [("L", i, action, reason, None, None) for i in range(n)]
    schema = "l string, id long, action string, reason string, added_sharp double, removed_sharp double"
    w = lambda rows: learn.learn(spark.createDataFrame(rows, schema), ["l"])
    assert w(log("for_mange_herfra", 500)).first().event_density == 0.6
    assert learn.lessons(w(log("uskarpt", 3)), ["l"]).first().lessons == ["sharpness_counts_more", "quality_before_moment"]
    assert abs(w([("L", 1, "bytt", None, 0.9, 0.5)]).first().w_sharp - 0.51) < 1e-9
    assert w(log("privat", 9)).first().w_sharp == 0.5


def test_faces_of_one_photo_are_different_persons(spark):
    unit = lambda k: [1.0 if i == k else 0.05 for i in range(8)]
    rows = [("L", 1, 1, 0.9, None, unit(0)), ("L", 2, 1, 0.8, None, unit(0)), ("L", 3, 2, 0.7, None, unit(0)), ("L", 4, 3, 0.6, 7, unit(1)), ("L", 5, 4, 0.5, None, unit(1))]
    got = {r.id: r.grp for r in people.group_faces(spark.createDataFrame(rows, "library_id string, id long, photo long, quality double, fixed long, embedding array<double>"), ["library_id"]).collect()}
    assert got[1] != got[2] and got[3] in (got[1], got[2]) and got[4] == got[5] == 7


def test_face_grouping_equals_a_plain_scan(spark):
    r = random.Random(11)
    heads = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(70):
        v = [x + r.gauss(0, 0.5) for x in heads[i % 5]]
        n = sum(x * x for x in v) ** 0.5
        rows.append((i, r.randint(0, 30), r.random(), 500 + i % 5 if i in (3, 16, 33) else None, [x / n for x in v]))
    df = spark.createDataFrame([("L", *x) for x in rows], "l string, id long, photo long, quality double, fixed long, embedding array<double>")
    got = {x.id: x.grp for x in people.group_faces(df, ["l"], 0.8).collect()}
    want: dict[int, list] = {}  # faces by group, in order of founding

    def centre(members):
        v = [sum(m[4][d] for m in members) for d in range(6)]
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v]

    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    photos = lambda g: {m[1] for m in want[g]}
    first = sorted((x for x in rows if x[3] is not None), key=lambda x: (-x[2], x[0]))
    for x in first:
        want.setdefault(x[3], []).append(x)
    firm, fresh = set(want), people.FIRST_NEW
    for x in sorted((x for x in rows if x[3] is None), key=lambda x: (-x[2], x[0])):
        near = [(cosine(centre(want[g]), x[4]), g) for g in want if x[1] not in photos(g)]
        best = max((s for s, _ in near), default=-2)
        if best >= 0.8:
            want[next(g for s, g in near if s == best)].append(x)
        else:
            want[fresh] = [x]
            fresh += 1
    while True:
        names = list(want)
        close = [(-cosine(centre(want[a]), centre(want[b])), i, j) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and not {a, b} <= firm and not photos(a) & photos(b)]
        used = set()
        for far, i, j in sorted(c for c in close if -c[0] >= 0.8):
            if not used & {i, j}:
                used |= {i, j}
                keep, drop = (names[j], names[i]) if names[j] in firm else (names[i], names[j])
                want[keep] += want.pop(drop)
        if not used:
            break
    assert got == {m[0]: g for g, members in want.items() for m in members}
    assert len(want) < 30


def test_centroids_in_many_slices(spark):
    r = random.Random(5)
    vector = lambda: [r.gauss(0, 1) for _ in range(4)]
    centres = spark.createDataFrame([(i, vector()) for i in range(40)], "label long, v array<double>").select("label", f.normalised("v").alias("centroid"))
    rows = spark.createDataFrame([(i // 2, vector()) for i in range(60)], "id long, v array<double>")
    found = lambda n: sorted(tuple(x) for x in people.nearest_centroid(rows, "id", "v", centres, "label", n).collect())
    assert len(found(2)) == 60 and found(2) == found(4096)
    assert [x.label for x in people.nearest_centroid(rows.limit(1), "id", "v", centres.filter("false"), "label").collect()] == [None]


def test_coverage_repair_equals_a_plain_scan(spark):
    r = random.Random(8)
    rows = [("L", i, r.randint(0, 40), i % 9, r.randint(0, 4) / 4, r.random() < 0.8, r.random() < 0.1, [(p, r.randint(0, 3) / 3) for p in range(4) if r.random() < 0.25]) for i in range(90)]
    kind = "l string, id long, t long, grp long, quality double, usable boolean, included boolean, persons array<struct<person:long,score:double>>"
    wants = [("L", p, 3 + p) for p in range(5)]
    got = {x.id for x in groups.coverage_repair(spark.createDataFrame(rows, kind), spark.createDataFrame(wants, "l string, person long, want int"), ["l"], "id").collect()}
    inside, added = {x[1] for x in rows if x[6]}, set()
    for _, person, want in wants:
        shows = [(x, dict(x[7])[person]) for x in rows if person in dict(x[7])]
        while sum(x[1] in inside for x, _ in shows) < want:
            seen = {x[3] for x, _ in shows if x[1] in inside}
            free = sorted((x[3] in seen, -score, -x[4], x[2], x[1]) for x, score in shows if x[5] and x[1] not in inside)
            if not free:
                break
            inside.add(free[0][-1])
            added.add(free[0][-1])
    assert got == added and len(added) > 3


def test_boxes(spark):
    box = "struct<x:double,y:double,w:double,h:double>"
    rows = [("p", 1, 0.9, (0.0, 0.0, 1.0, 1.0)), ("p", 2, 0.8, (0.1, 0.1, 1.0, 1.0)), ("p", 3, 0.7, (5.0, 5.0, 1.0, 1.0))]
    df = spark.createDataFrame(rows, f"photo string, id long, score double, box {box}")
    assert sorted(r.id for r in people.suppress(df, ["photo"]).collect()) == [1, 3]
    got = {(r.new_id, r.old_id) for r in people.carry_over(df.filter("id <> 2"), df.filter("id = 2"), ["photo"]).collect()}
    assert got == {(2, 1)}


def paged(spark, qualities, pages, single=None):
    rows = [("e", i, i, q, (single or {}).get(i, "free"), pages) for i, q in enumerate(qualities)]
    df = spark.createDataFrame(rows, "e string, id long, t long, quality double, single string, pages int")
    return layout.paginate(df, ["e"], "t", "id").orderBy("page", "place").collect()


def test_layout(spark):
    got = paged(spark, [0.3 + 0.01 * i for i in range(46)], 10)
    assert sorted(r.id for r in got) == list(range(46)) and len({r.page for r in got}) == 10 and got[0].kind == "full_bleed"
    assert all(r.kind != "full_bleed" for r in paged(spark, [0.1, 0.2, 0.3], 3))
    never = paged(spark, [0.9] * 6, 3, {0: "never"})
    assert next(r for r in never if r.id == 0).kind == "grid"
    assert [r.kind for r in paged(spark, [0.9], 1)] == ["air"]


def test_evaluation(spark):
    schema = "id long, t long, h long"
    gold = spark.createDataFrame([(1, 0, 0), (2, 1000, 2**40), (3, None, None)], schema)
    same = evaluate.selection_metrics(gold, gold).first()
    assert (same.precision, same.recall, same.f1) == (1.0, 1.0, 1.0)
    near = spark.createDataFrame([(9, 15, 2**50 - 1), (8, 90_000, 1), (7, 50_000, 2**30 - 1)], schema)
    got = evaluate.selection_metrics(gold, near).first()
    assert abs(got.precision - 2 / 3) < 1e-9 and abs(got.recall - 2 / 3) < 1e-9


def make(spark, rows):
    cols = "library_id string, content_hash long, t long, format string, camera_make string, q_sharp double, q_exposure double, q_color double, q_skin double, q_motion double, q_noise double, phash long, faces_done boolean"
    photos = spark.createDataFrame([("L", i, t, "jpeg", "C", s, e, c, k, None, None, (i * 0x9E3779B97F4A7C15) % 2**63, False) for i, t, s, e, c, k in rows], cols)
    faces = spark.createDataFrame([], "library_id string, content_hash long, id long, h double, sharpness double, person_id long, grp long, ignored boolean")
    decisions = spark.createDataFrame([], "library_id string, content_hash long, decision string")
    prefs = spark.createDataFrame([("L", *(s for s, _, _ in learn.WEIGHTS.values()))], "library_id string, " + ", ".join(f"{n} double" for n in learn.WEIGHTS))
    return {r.content_hash: r for r in draft.make_draft(photos, faces, decisions, prefs).collect()}


def test_draft(spark):
    day = [(i, 36_000 + 300 * i, 0.4 + 0.01 * i, 0.8, 0.5, 0.1) for i in range(20)]
    got = make(spark, day)
    assert len(got) == 20 and all(r.reason for r in got.values()) and any(r.included for r in got.values())
    series = make(spark, day + [(100 + i, 80_000 + 3 * i, 0.5 + 0.1 * i, 0.8, 0.5, 0.1) for i in range(3)])
    best = [r for r in series.values() if r.content_hash >= 100 and r.included]
    assert len(best) == 1 and all(series[i].reason in ("same_series", "only_one", "weak_but_only", "best_in_series") for i in (100, 101, 102))
    weak = make(spark, day + [(200 + i, 40 * 86_400 + 100 * i, 0.05, 0.8, 0.5, 0.1) for i in range(3)])
    kept = [r for r in weak.values() if r.content_hash >= 200 and r.included]
    assert len(kept) == 1 and kept[0].reason == "weak_but_only"


def test_draft_does_not_depend_on_input_order(spark):
    rows = [(i, 1000 * i % 90_000, (i * 7 % 10) / 10, (i * 3 % 10) / 10, 0.5, 0.1) for i in range(60)]
    plain = lambda got: {k: (r.included, r.reason, r.related) for k, r in got.items()}
    assert plain(make(spark, rows)) == plain(make(spark, rows[::-1]))


def test_names_of_files(spark):
    rows = [("a/.hidden/x.jpg",), ("a/b.JPG",), ("lib.photoslibrary/x.jpg",), ("node_modules/x.png",), ("x.txt",), ("c.heic",)]
    df = spark.createDataFrame(rows, "p string").filter(~files.passed_over(F.col("p")) & files.is_image(F.col("p")))
    assert sorted(r.p for r in df.collect()) == ["a/b.JPG", "c.heic"]


def test_scan(spark, tmp_path):
    for name in ("a/x.jpg", "b/z.txt", "c.png", "a/b/.y.HEIC.icloud", "a/.z.txt.icloud", ".hidden/.w.jpg.icloud", ".v.jpg.icloud"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(b"1234")
    got = {r.rel_path: (r.size, r.status) for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"a/x.jpg": (4, "local"), "c.png": (4, "local"), "a/b/y.HEIC": (0, "cloud_only"), "v.jpg": (0, "cloud_only")}
    listed = spark.createDataFrame([("file:/r/a/.y.jpg.icloud", 9, datetime(2020, 1, 1)), ("file:/r/.z/y.jpg", 9, datetime(2020, 1, 1))], "path string, length long, modificationTime timestamp")
    assert [(r.rel_path, r.size, r.status) for r in files.scanned(listed, "/r").collect()] == [("a/y.jpg", 0, "cloud_only")]


def test_nearest_covers_both_sides(spark):
    a = spark.createDataFrame([("u", 1, 100), ("u", 2, 500), ("v", 3, 5)], "u string, id long, t long")
    b = spark.createDataFrame([("u", 10, 90), ("u", 11, 110), ("u", 12, 900)], "u string, id long, t long")
    got = {r.id: (r.near_key, r.near_seconds) for r in timeline.nearest_in_time(a, b, ["u"], "t", "id").collect()}
    assert got == {1: (10, 10), 2: (11, 390), 3: (None, None)}


def test_stream_equals_batch(spark, tmp_path):
    from storyline.streaming import events as stream

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_id", "ts", "value")
    source.repartitionByRange(3, "ts").write.parquet(f"{tmp_path}/in")
    far = source.limit(1).withColumn("ts", F.lit(datetime(2199, 1, 1)).cast("timestamp_ntz")).withColumn("user_id", F.lit(-1).cast("long"))
    far.write.mode("append").parquet(f"{tmp_path}/in")
    out = stream.sessions(stream.event_stream(spark, f"{tmp_path}/in", "user_id long, event_id long, ts timestamp_ntz, value double", 1000))
    stream.run_to_end(out, f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted((r.user_id, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.user_id >= 0)
    rows = timeline.assign_events(source.withColumn("t", f.micros("ts") / 1e6), ["user_id"], "t", "event_id")
    assert got == sorted((r.user_id, r.n) for r in rows.groupBy("user_id", "event").agg(F.count("*").alias("n")).collect())


def plain_pick(rows, quota, mood_max, imp, limit):
    """The greedy pick of one event, each value computed anew. rows: dicts in order of time."""
    apart = lambda a, b: (a["phash"] ^ b["phash"]).bit_count()
    chosen = [r for r in rows if r["decision"] == "opp"]
    step = max(max(rows[-1]["t"] - rows[0]["t"], 1) / (quota + 1), 60.0)
    while len(chosen) < quota:
        moods = sum(r["mood"] for r in chosen)
        able = [
            r for r in rows
            if r["decision"] is None and r not in chosen and (not r["mood"] or moods < mood_max)
            and not any(r["burst"] == c["burst"] or (abs(r["t"] - c["t"]) <= 600 and apart(r, c) <= limit) for c in chosen)
            and not any(r["mood"] and c["mood"] and apart(r, c) <= 20 for c in chosen)
        ]
        if not able:
            break

        def value(r):
            spread = min((abs(r["t"] - c["t"]) / step for c in chosen), default=1.0)
            gain = max((0.3 / (1 + sum(k in c["children"] for c in chosen)) for k in r["children"]), default=0.0)
            return imp * r["quality"] + (1 - imp) * min(spread, 1.0) + gain

        chosen.append(max(able, key=lambda r: (value(r), -r["t"], -r["content_hash"])))
    return {r["content_hash"] for r in chosen}


def test_pick_equals_a_plain_fold(spark):
    r = random.Random(3)
    for trial in range(6):
        rows = []
        for i in range(40):
            rows.append({
                "library_id": f"L{trial}", "content_hash": i, "t": 100 * i + r.randint(0, 90), "quality": r.random(), "phash": r.getrandbits(62), "burst": i // 2, "mood": r.random() < 0.3,
                "decision": "opp" if r.random() < 0.05 else None, "noise": None, "grp": 0, "quality_importance": 0.75, "similar_hamming": 10.0, "children": [k for k in (1, 2) if r.random() < 0.3],
            })
        kind = "library_id string, content_hash long, t long, quality double, phash long, burst long, mood boolean, decision string, noise string, grp long, quality_importance double, similar_hamming double, children array<long>"
        items = spark.createDataFrame(rows, kind)
        budgets = spark.createDataFrame([(f"L{trial}", 0, 9, 2)], "library_id string, grp long, quota long, mood_max int")
        got = {x.content_hash for x in draft.pick(items, budgets).filter("included").collect()}
        assert got == plain_pick(rows, 9, 2, 0.75, 10)


def test_children_share_an_event(spark):
    """Two children of equal photos each get their share, though one has the better photos."""
    rows = [(i, 5000 * i, 0.9 if i % 2 else 0.86, i, [1] if i % 2 else [2]) for i in range(12)]
    kind = "content_hash long, t long, quality double, burst long, children array<long>"
    items = spark.createDataFrame(rows, kind).selectExpr("'L' library_id", "*", "content_hash * 1234567890123 % 4611686018427387904 phash", "false mood", "cast(null as string) decision", "cast(null as string) noise", "0L grp", "1.0D quality_importance", "0.0D similar_hamming")
    budgets = spark.createDataFrame([("L", 0, 4, 1)], "library_id string, grp long, quota long, mood_max int")
    share = lambda df: sum(x.content_hash % 2 for x in draft.pick(df, budgets).filter("included").collect())
    assert share(items.drop("children")) == 4 and share(items) == 2


def test_baseline_equals_a_plain_scan(spark):
    r = random.Random(4)
    rows = [(i, r.randint(0, 60_000), r.randint(0, 30), r.random() < 0.7) for i in range(120)]
    df = spark.createDataFrame([("L", "m", *x) for x in rows], "l string, m string, id long, t long, s long, best boolean")
    got = {x.id for x in select.baseline(df, ["l"], "t", "m", "s", "id", "best", 20).collect()}
    ranked = sorted((x for x in rows if x[3]), key=lambda x: (-x[2], x[0]))
    taken = []
    for x in ranked:
        if len(taken) < 20 and all(abs(x[1] - y[1]) > select.SPACING for y in taken):
            taken.append(x)
    taken += [x for x in ranked if x not in taken][: 20 - len(taken)]
    assert got == {x[0] for x in taken}


def test_put_faces_keeps_what_the_user_decided(spark):
    box = "struct<x:double,y:double,w:double,h:double>"
    b = lambda x: (x, 0.0, 0.2, 0.2)
    old = spark.createDataFrame([("p", 1, b(0.0), 7, 7, True, False), ("p", 2, b(0.5), 999_999, None, False, True), ("p", 3, b(0.8), 1_000_001, None, False, False), ("q", 4, b(0.0), 8, 8, True, False)], f"photo string, id long, box {box}, grp long, person_id long, confirmed boolean, ignored boolean")
    new = spark.createDataFrame([("p", 11, b(0.02)), ("p", 12, b(0.52)), ("p", 13, b(0.8))], f"photo string, id long, box {box}")
    got = {x.id: (x.grp, x.person_id, x.confirmed, x.ignored) for x in people.put_faces(old, new, ["photo"]).collect()}
    assert got == {4: (8, 8, True, False), 11: (7, 7, True, False), 12: (999_999, None, False, True), 13: (None, None, False, False)}


def test_portraits_show_each_person_once(spark):
    rows = [("e", 1, 10, 0.9, True), ("e", 2, 10, 0.8, True), ("e", 1, 11, 0.9, False), ("e", 2, 12, 0.5, True), ("e", 3, 10, 1.0, True)]
    df = spark.createDataFrame(rows, "e string, photo long, person long, score double, alone boolean")
    assert {(x.person, x.photo) for x in people.portraits(df, ["e"]).collect()} == {(10, 3), (12, 2), (11, 1)}


def test_shared_folder():
    from types import SimpleNamespace

    import pytest

    from storyline import shared

    session = lambda master, conf, set_: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: conf or d), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: set_))
    assert shared.shared_dir(session("yarn", "hdfs://x/y/", "hdfs://z")) == "hdfs://x/y"
    assert shared.shared_dir(session("yarn", None, "hdfs://z/")) == "hdfs://z"
    assert shared.shared_dir(session("local[2]", None, None)).startswith("file:///")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(session("yarn", None, None))
