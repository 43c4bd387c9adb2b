"""That work which grew with the square of a table, or with the rows of a task, has a bound, and gives what a plain version gives."""

import random
import re
import time
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pandas as pd

from storyline.operators import choices, density, people, typeset
from storyline.plans import album_queries, people_queries


def test_blocks_of_a_density_search_are_few_and_all_rows_meet(spark, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", 4)
    monkeypatch.setattr(density, "BLOCKS", 5)
    r = np.random.default_rng(1)
    vectors = {i: r.standard_normal(8).tolist() for i in range(150)} | {150 + i: [1.0] + [0.0] * 7 for i in range(20)}
    space = density._Space(spark.createDataFrame(list(vectors.items()), "id long, v array<double>"), "id", "v")
    assert space.size == 170 and space.blocks == 5 and space.side == 34
    u = np.array(list(vectors.values()))
    u /= np.sqrt((u * u).sum(1))[:, None]
    d = np.round(np.maximum(2 - 2 * u @ u.T, 0), 9)
    want = {(i, j, n) for i in range(170) for n, j in enumerate([j for j in np.lexsort((np.arange(170), d[i])) if j != i and d[i, j] <= 1.4][:6], 1)}
    got = density._neighbours(space, 6, 1.4).collect()
    assert {(x.id, x.other, x.n) for x in got} == want and len(got) == len(want)
    assert all(x.d == d[x.id, x.other] for x in got)


def test_faces_of_a_large_library_are_grouped_in_time(spark):
    r = np.random.default_rng(3)
    v = r.standard_normal((4000, 64))
    v /= np.sqrt((v * v).sum(1))[:, None]
    rows = [("l", i, i % 97, float(i * 31 % 101), i if i % 50 == 0 else None, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "l string, id long, photo long, quality double, fixed long, v array<double>").withColumnRenamed("v", "embedding")
    began = time.time()
    got = {x.id: x.grp for x in people.group_faces(df, ["l"]).collect()}
    assert time.time() - began < 40  # a face looked at each group by itself before: 65 s for ten libraries of 1,000
    assert len(got) == 4000 and all(got[i] == i for i in range(0, 4000, 50))
    assert max(Counter((g, i % 97) for i, g in got.items()).values()) == 1


def test_tasks_of_pages_hold_a_bounded_number_of_lines(spark, monkeypatch):
    whole = people_queries.justified_pages(spark, "/root/testdata/sf0.001").collect()
    monkeypatch.setattr(album_queries, "LINES_A_PART", 500)
    dealt = people_queries.justified_pages(spark, "/root/testdata/sf0.001")
    sizes = dealt.rdd.glom().map(len).collect()
    assert len(sizes) == 12 and max(sizes) < 1000
    assert sorted(dealt.collect()) == sorted(whole)


def plain_lines(text, most):
    """Words put down one by one."""
    width = lambda s: sum(next((w for w, x in typeset.WIDTHS.items() if c in x), typeset.WIDE) for c in s)
    out = []
    for k, p in enumerate((text or "").split("\n")):
        lines, open_ = [[]], 0
        for w in re.findall("[^\t\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", p):
            if lines[-1] and open_ + 278 + width(w) > most:
                lines.append([])
            open_ = open_ + 278 + width(w) if lines[-1] else width(w)
            lines[-1].append(w)
        out += [(k, n, " ".join(x)) for n, x in enumerate(lines)]
    return out


def test_lines_of_odd_and_of_long_texts(spark):
    r = random.Random(2)
    odd = [None, "", "\n", "\n\n a", " a  b\tc ", "x" * 300 + " y", "a\u2003b\u3000c\xa0d", "\U0001f600 \U0001f600\u0301 é\n\n", "\u200bz\x00 q\r\nw", "\x1ca\x1db"]
    words = ["a", "Wort", "i" * 40, "mmmmmm", "\U0001f600", "longer,", "é" * 9]
    texts = odd + ["".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\n", "\u2009"]) for _ in range(r.randrange(200))) for _ in range(60)]
    long = " ".join(r.choice(words) for _ in range(400_000))
    df = spark.createDataFrame(list(enumerate([*texts, long])), "id long, text string")
    began = time.time()
    got = defaultdict(list)
    for x in typeset.wrapped(df, "id", "text", 4000).collect():
        got[x.id].append((x.paragraph, x.line, x.said))
    assert time.time() - began < 30  # where lines begin was an array copied for each line before
    assert all(sorted(got[i]) == plain_lines(t, 4000) for i, t in enumerate([*texts, long]))


class Kept:
    """State and timers in memory, which counts the values put into lists."""

    def __init__(self):
        self.lists, self.values, self.timers, self.put_in = {}, {}, [], 0

    def state(self, held, name):
        def put(x):
            held[name] = x

        def append(x):
            self.put_in += 1
            held.setdefault(name, []).append(x)

        many = lambda xs: [append(x) for x in xs]
        return SimpleNamespace(get=lambda: held[name], exists=lambda: name in held, update=put, put=lambda xs: (held.pop(name, None), many(xs)), appendValue=append, appendList=many, clear=lambda: held.pop(name, None))

    def handle(self):
        return SimpleNamespace(getValueState=lambda n, s: self.state(self.values, n), getListState=lambda n, s: self.state(self.lists, n), registerTimer=self.timers.append)


def test_waiting_commands_are_few_values_of_the_state():
    kept, keeper = Kept(), choices._Keeper()
    keeper.init(kept.handle())
    rows = pd.DataFrame({"ms": range(3000), "id": range(3000), "type": "rotate", "photo": [i % 7 for i in range(3000)], "photos": None, "on": None, "n": None, "x": None, "y": None, "whole": None})
    for part in (rows[1000:], rows[:1000]):
        list(keeper.handleInputRows((5,), iter([part]), None))
    assert kept.put_in == 2 and kept.timers == [1001, 1]  # 3,000 values before
    told = []
    for now in (1500, 1500, 9000):
        told += list(keeper.handleExpiredTimer((5,), SimpleNamespace(getCurrentWatermarkInMs=lambda now=now: now), None))
    assert [t["version"][0] for t in told] == [1500, 3000] and set(kept.timers[2:]) == {1501} and "waiting" not in kept.lists
    want = choices.Album()
    for c in choices._commands(rows):
        want.apply(c)
    assert [tuple(x) for x in told[-1].itertuples(index=False)] == [(5, 3000, *r) for r in want.rows()] and want.rows()
