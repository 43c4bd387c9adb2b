"""What a user has chosen for an album: thirteen commands, folded in order, in batch or as a stream.

Each command rests on those before it: a page the user is pleased with goes when one of its photos is used elsewhere, a photo is in
one own story at most, and the two covers never show the same photo. So the log of one library is one fold, and its state is
as large as what was chosen. A command is a row of type and
  photo    trip, split, pages, front, back, rotate, size, crop, put_back
  photos   pleased, merge, gather, own_story
  on       trip, pleased
  n        pages (null: as suggested), size (-1 to 4; null: as suggested), crop (zoom in percent), pleased (columns of a grid)
  x, y     crop (focus in percent)
  whole    crop (shown whole)
Types that are not known change nothing. The log is folded by ``t``, then ``id``; repeated rows are repeated commands.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GATHER_MOST, MOST_ZOOM, LEAST_ZOOM, OWN_PAGE = 12, 400, 100, 3
#: Commands of a value of the stream's state.
AT_ONCE = 5000
FIELDS = ("type", "photo", "photos", "on", "n", "x", "y", "whole")
COMMAND = "type string, photo long, photos array<long>, on boolean, n long, x long, y long, whole boolean"
ROWS = "what string, number long, place long, photo long, value long, value2 long"


def _grid(n: int) -> int:
    return 1 if n == 1 else 2 if n in (2, 4) else 3 if n <= 9 else 4


class Album:
    """The state: pages (columns, photos), trips (photo: without children), merged days and own stories (photos), page counts and looks by
    photo, and covers."""

    def __init__(self, saved: str | None = None):
        held = json.loads(saved) if saved else {}
        by_photo = lambda name: {int(k): v for k, v in held.get(name, [])}
        self.pages: list[list] = held.get("pages", [])
        self.merged: list[list[int]] = held.get("merged", [])
        self.stories: list[list[int]] = held.get("stories", [])
        self.trips, self.counts, self.looks = by_photo("trips"), by_photo("counts"), by_photo("looks")
        self.covers: dict[str, int] = held.get("covers", {})

    def saved(self) -> str:
        lists = {k: list(getattr(self, k).items()) for k in ("trips", "counts", "looks")}
        return json.dumps(lists | {k: getattr(self, k) for k in ("pages", "merged", "stories", "covers")})

    def _free(self, photos: list[int]) -> None:
        """Pages with one of the photos are made anew."""
        used = set(photos)
        self.pages = [p for p in self.pages if used.isdisjoint(p[1])]

    def _look(self, photo: int, name: str, value: object) -> None:
        look = self.looks.setdefault(photo, {})
        look.pop(name, None)
        if value is not None:
            look[name] = value
        if not look:
            del self.looks[photo]

    def apply(self, c: dict) -> None:
        if (do := getattr(self, f"do_{c['type']}", None)) is not None:
            do(c)

    def do_pleased(self, c: dict) -> None:
        self._free(c["photos"])
        if c["on"]:
            self.pages.append([c["n"], c["photos"]])

    def do_gather(self, c: dict) -> None:
        photos = c["photos"]
        self._free(photos)
        parts = [photos[k : k + GATHER_MOST] for k in range(0, len(photos), GATHER_MOST)]
        self.pages += [[_grid(len(p)), p] for p in parts]

    def do_trip(self, c: dict) -> None:
        self.trips.pop(c["photo"], None)
        self.trips[c["photo"]] = bool(c["on"])

    def do_merge(self, c: dict) -> None:
        used = set(c["photos"])
        self.merged = [m for m in self.merged if used.isdisjoint(m)] + [c["photos"]]

    def do_split(self, c: dict) -> None:
        self.merged = [m for m in self.merged if c["photo"] not in m]

    def do_pages(self, c: dict) -> None:
        self.counts.pop(c["photo"], None)
        if c["n"] is not None:
            self.counts[c["photo"]] = max(c["n"], 1)

    def _cover(self, side: str, other: str, photo: int | None) -> None:
        if photo is not None and self.covers.get(other) == photo:
            del self.covers[other]
        self.covers.pop(side, None)
        if photo is not None:
            self.covers[side] = photo

    def do_front(self, c: dict) -> None:
        self._cover("front", "back", c["photo"])

    def do_back(self, c: dict) -> None:
        self._cover("back", "front", c["photo"])

    def do_rotate(self, c: dict) -> None:
        turned = (self.looks.get(c["photo"], {}).get("rotation", 0) + 90) % 360
        self._look(c["photo"], "rotation", turned or None)

    def do_size(self, c: dict) -> None:
        now = None if c["n"] is None else min(max(c["n"], -1), 4)
        alone = [x is not None and x >= OWN_PAGE for x in (self.looks.get(c["photo"], {}).get("size"), now)]
        if alone[0] != alone[1]:
            self._free([c["photo"]])
        self._look(c["photo"], "size", now)

    def do_crop(self, c: dict) -> None:
        zoom = None if c["n"] is None or c["whole"] else min(c["n"], MOST_ZOOM)
        self._look(c["photo"], "zoom", zoom if zoom is not None and zoom > LEAST_ZOOM else None)
        self._look(c["photo"], "focus", None if c["x"] is None or c["y"] is None else [min(c["x"], 100), min(c["y"], 100)])
        self._look(c["photo"], "whole", 1 if c["whole"] else None)

    def do_own_story(self, c: dict) -> None:
        used = set(c["photos"])
        if not used:
            return
        without = lambda lists, least: [left for x in lists if len(left := [p for p in x if p not in used]) >= least]
        self.stories = [*without(self.stories, 1), c["photos"]]
        self.merged = without(self.merged, 2)
        self._free(c["photos"])

    def do_put_back(self, c: dict) -> None:
        for k, story in enumerate(self.stories):
            if c["photo"] in story:
                del self.stories[k]
                self._free(story)
                break

    def rows(self) -> list[tuple]:
        """what, number, place, photo, value, value2"""
        out: list[tuple] = [("page", k, i, p, n, None) for k, (n, photos) in enumerate(self.pages) for i, p in enumerate(photos)]
        out += [(what, k, i, p, None, None) for what, lists in (("merged", self.merged), ("story", self.stories)) for k, x in enumerate(lists) for i, p in enumerate(x)]
        out += [("adult_trip" if on else "family_trip", None, None, p, None, None) for p, on in self.trips.items()]
        out += [("pages", None, None, p, n, None) for p, n in self.counts.items()]
        out += [(side, None, None, p, None, None) for side, p in sorted(self.covers.items())]
        for p, look in sorted(self.looks.items()):
            out += [(what, None, None, p, *(v if what == "focus" else (v, None))) for what, v in sorted(look.items())]
        return out


def _command(values: tuple) -> dict:
    """A command of plain values, of a row of pandas columns in the order of FIELDS."""
    c = dict(zip(FIELDS, values, strict=True))
    # NaN is not equal to itself: a test for null that costs no call for each value of the log.
    c["photos"] = [] if c["photos"] is None else list(map(int, c["photos"]))
    for k in ("photo", "n", "x", "y"):
        c[k] = None if (v := c[k]) is None or v != v else int(v)
    for k in ("on", "whole"):
        c[k] = (v := c[k]) is not None and v == v and bool(v)
    return c


def _commands(held: pd.DataFrame) -> Iterator[dict]:
    return map(_command, zip(*(held[k].tolist() for k in FIELDS), strict=True))


def _table(rows: list[tuple], library: int, version: int) -> pd.DataFrame:
    """Plain values with None for null: a column of its own kind for each library and version would cost more than its rows."""
    return pd.DataFrame([(library, version, *r) for r in rows], columns=["library", "version", *(c.split()[0] for c in ROWS.split(", "))], dtype=object)


def fold_choices(log: DataFrame, by: list[str]) -> DataFrame:
    """M9: the rows of each library's album after its whole log. log: by, t, id and the columns of a command. The libraries of a part are
    one sorted stream: a library costs no call of its own, and its log is as long as it likes, for a task holds one batch and one album."""
    names = [c.split()[0] for c in ROWS.split(", ")]
    rows = log.select(*by, "t", "id", *FIELDS).repartition(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    rows = rows.sortWithinPartitions(*by, F.asc_nulls_last("t"), F.asc_nulls_last("id")).select(*by, *FIELDS)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.select(*by).schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*by, *names])

        now, album, kinds = None, None, []
        for batch in batches:
            kinds = [*(batch.schema.field(c).type for c in by), pa.string(), *[pa.int64()] * (len(names) - 1)]
            done: list[tuple] = []
            keys = zip(*(batch.column(c).to_pylist() for c in by), strict=True)
            for key, values in zip(keys, zip(*(batch.column(c).to_pylist() for c in FIELDS), strict=True), strict=True):
                if album is None or key != now:
                    done += [] if album is None else [(*now, *r) for r in album.rows()]
                    now, album = key, Album()
                album.apply(_command(values))
            yield told(done)
        if album is not None:
            yield told([(*now, *r) for r in album.rows()])

    return rows.mapInArrow(fold, f"{schema}, {ROWS}")


class _Keeper(StatefulProcessor):
    """A library's album, and the commands that wait until the watermark has passed them: only then is it certain that none before
    them is still to come. A timer just after the first of them then applies all that are due, in order, and tells the album.
    Commands wait in lists of up to ``AT_ONCE``: a value of the state costs far more than a command."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.album = handle.getValueState("album", "saved string, version long")
        self.waiting = handle.getListState("waiting", "commands string")

    def _wait(self, commands: list[list]) -> None:
        """Keeps commands (t, id and the values of FIELDS), and wakes just after the first of them."""
        for k in range(0, len(commands), AT_ONCE):
            self.waiting.appendValue((json.dumps(commands[k : k + AT_ONCE]),))
        if commands:
            self.handle.registerTimer(min(x[0] for x in commands) + 1)

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        for part in rows:
            self._wait([[int(t), int(i), *c.values()] for t, i, c in zip(part["ms"].tolist(), part["id"].tolist(), _commands(part), strict=True)])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        # Rows still to come are later than the watermark.
        now = timerValues.getCurrentWatermarkInMs()
        held = [x for (commands,) in self.waiting.get() for x in json.loads(commands)] if self.waiting.exists() else []
        due, rest = [x for x in held if x[0] < now], [x for x in held if x[0] >= now]
        if due:
            self.waiting.clear()
            self._wait(rest)
        elif rest:
            self.handle.registerTimer(min(x[0] for x in rest) + 1)
        if not due:
            return
        saved, version = self.album.get() if self.album.exists() else (None, 0)
        album = Album(saved)
        for x in sorted(due, key=lambda x: (x[0], x[1], str(x[2:]))):
            album.apply(dict(zip(FIELDS, x[2:], strict=True)))
        self.album.update((album.saved(), version + len(due)))
        yield _table(album.rows() or [("empty", None, None, None, None, None)], key[0], version + len(due))

    def close(self) -> None:
        pass


def choice_stream(changes: DataFrame, library: str, late: str = "1 day") -> DataFrame:
    """M9 on a stream: changes with ts (timestamp), id, a long column named by library, and the columns of a command. Commands
    may come in any order within the watermark. Each time a library's album changes all its rows are told, with the number
    of commands applied; latest_choices() keeps the last. State needs the RocksDB store, which is set for the session here."""
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = changes.select(F.col(library).cast("long").alias("library"), F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "id", *FIELDS).withWatermark("ts", late)
    return rows.groupBy("library").transformWithStateInPandas(_Keeper(), f"library long, version long, {ROWS}", "append", "eventTime")


def latest_choices(told: DataFrame) -> DataFrame:
    """The rows of each library's last version."""
    last = told.groupBy("library").agg(F.max("version").alias("version"))
    return told.join(last, ["library", "version"], "left_semi").filter("what <> 'empty'").drop("version")
