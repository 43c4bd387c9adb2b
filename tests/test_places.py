"""Places of photos that are far from all of them."""

import math
import random

from storyline.operators import places


def test_far_photos_meet_few_places_of_a_town(spark):
    """Far photos met all places of the coarse cells around them."""
    r = random.Random(5)
    towns = [(i, 59 + r.random(), 10 + r.random()) for i in range(400)]
    seen = [(i, r.uniform(-40, 20), r.uniform(40, 120)) for i in range(40)]
    looked: list[int] = []
    got = places.nearest_place(spark.createDataFrame(seen, "id long, lat double, lon double"), "id", spark.createDataFrame(towns, "id long, lat double, lon double"), looked=looked)
    assert got.filter("place is not null").count() == 40
    assert sum(looked) < 0.5 * 40 * 400


def test_photos_are_sent_to_few_blocks(spark, monkeypatch):
    """Over blocks and shares of them: equal to a plain scan, and what is written is about two rows for each photo and place (over four before)."""
    for name, n in (("BLOCK", 100), ("KNOWN", 200), ("PACK", 40)):
        monkeypatch.setattr(places, name, n, raising=False)
    plain, made = places.materialize, []
    monkeypatch.setattr(places, "materialize", lambda df, name: made.append((kept := plain(df, name)).count()) or kept)
    r = random.Random(4)
    towns = [(i, r.uniform(-60, 60), r.uniform(-180, 180)) for i in range(590)] + [(700 + i, 0.0, float(i)) for i in range(10)]
    seen = [(i, r.uniform(-70, 70), r.uniform(-180, 180)) for i in range(1990)] + [(3000 + i, 0.0, i + 0.5) for i in range(9)] + [(3010, 90.0, 0.0)]
    got = {x.id: x for x in places.nearest_place(spark.createDataFrame(seen, "id long, lat double, lon double"), "id", spark.createDataFrame(towns, "id long, lat double, lon double")).collect()}
    assert len(got) == 2000
    for i, lat, lon in seen:
        km, place = min((round(12742 * math.asin(math.sqrt(math.sin(math.radians(a - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(a)) * math.sin(math.radians(b - lon) / 2) ** 2)), 6), j) for j, a, b in towns)
        assert got[i].place == place and abs(got[i].km - km) < 2e-6
    assert sum(made) < 2.5 * (len(seen) + len(towns))
