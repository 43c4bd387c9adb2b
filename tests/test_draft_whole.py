"""The draft's pick on the whole of a table, against a plain one that works everything out anew."""

from collections import defaultdict

from storyline.operators import draft
from storyline.plans import queries as library

DATA = "/root/testdata/sf0.01"


def plain_library(rows):
    """Included, first of its event, and jumped, of one library's photos."""
    rows = sorted(rows, key=lambda r: (r["t"], r["content_hash"]))
    apart = lambda a, b: 65 if a["phash"] is None or b["phash"] is None else ((a["phash"] ^ b["phash"]) & (2**64 - 1)).bit_count()
    close = lambda a, b: a["burst"] == b["burst"] or (abs(a["t"] - b["t"]) <= 600 and apart(a, b) <= a["similar_hamming"])
    twin = lambda a, b: a["mood"] and b["mood"] and apart(a, b) <= 20
    events, moods, out = defaultdict(list), [], {}
    for r in rows:
        events[r["grp"]].append(r)
    for g in sorted(events):
        held = events[g]
        want = held[0]["quota"]
        chosen = [r for r in held if r["decision"] not in (None, "ikke_med")]
        free = [r for r in held if r["decision"] is None and r["noise"] is None]
        if not chosen and not free:
            want, free = 1, [r for r in held if r["decision"] is None and r["noise"] != "screenshot"]
        step = max(max(held[-1]["t"] - held[0]["t"], 1) / (want + 1), 60.0)
        first = jumped = None
        leaps = set()
        while len(chosen) < want:
            able = [r for r in free if r not in chosen and not any(close(r, c) for c in chosen) and not any(twin(r, c) for c in chosen + moods)]
            able = [r for r in able if not r["mood"] or sum(bool(c["mood"]) for c in chosen) < held[0]["mood_max"]]
            if not able:
                break
            imp = held[0]["quality_importance"]
            far = lambda r: min([abs(r["t"] - c["t"]) / step for c in chosen] + [1.0])  # noqa: B023, E731
            best = max(able, key=lambda r: imp * r["quality"] + (1 - imp) * far(r))  # noqa: B023
            if best["quality"] + 1e-6 < max(r["quality"] for r in able):
                leaps.add(best["content_hash"])
            first = first if first is not None else best["content_hash"]
            chosen.append(best)
        moods += [r for r in chosen if r["mood"]]
        names = {r["content_hash"] for r in chosen}
        for r in held:
            h = r["content_hash"]
            out[h] = (h in names, h == first, h in leaps)
    return out


def test_pick_of_the_whole_table_equals_a_plain_one(spark, monkeypatch):
    budgets = []
    pick = draft.pick
    monkeypatch.setattr(draft, "pick", lambda items, budget: (budgets.append(budget), pick(items, budget))[1])
    monkeypatch.setattr(draft, "with_reasons", lambda items, picked: items.join(picked, ["library_id", "content_hash"]))
    both = library.QUERIES["album_draft"](spark, DATA).join(budgets[0].select("library_id", "grp", "quota", "mood_max"), ["library_id", "grp"]).collect()
    libraries = defaultdict(list)
    for r in both:
        libraries[r.library_id].append(r.asDict())
    assert len(both) == 10_000 and len(libraries) > 100
    for rows in libraries.values():
        want = plain_library(rows)
        assert {r["content_hash"]: (r["included"], r["first"], r["jumped"]) for r in rows} == want
