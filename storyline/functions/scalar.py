"""Scalar functions as Column expressions. They stay in the JVM and fold into generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def micros(t: str) -> Column:
    """Microseconds of a civil time since 1970, whatever the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {t})")


def local_seconds(t: str) -> Column:
    """Whole seconds of a civil time since 1970, floored."""
    return F.floor(micros(t) / 1_000_000).cast("long")


def civil(seconds: Column | str) -> Column:
    """civil time of whole seconds since 1970."""
    return F.timestamp_seconds(_c(seconds)).cast("timestamp").cast("timestamp_ntz")


def utc_seconds(t: str, offset: Column | str) -> Column:
    """local seconds less the offset in minutes; no offset counts as 0."""
    return local_seconds(t) - F.coalesce(_c(offset), F.lit(0)).cast("long") * 60


def exif_time(t: str, offset: Column | str, source: Column | str) -> Column:
    """F2 for times from EXIF, else null."""
    return F.when(_c(source) == "exif", utc_seconds(t, offset))


def hamming(a: Column | str, b: Column | str) -> Column:
    """differing bits of two 64-bit numbers."""
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def pixels(width: Column | str, height: Column | str) -> Column:
    """number of pixels; an unknown side counts as 0."""
    zero = lambda c: F.coalesce(_c(c), F.lit(0)).cast("long")
    return zero(width) * zero(height)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """great-circle distance; 12742 km is twice the earth's radius."""
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 12742.0 * F.asin(F.sqrt(h))


def away_from_home(km: Column, limit: float = 30.0) -> Column:
    """true when unknown."""
    return F.coalesce(km > limit, F.lit(True))


def dms_degrees(degrees: Column, minutes: Column, seconds: Column, hemisphere: Column) -> Column:
    """decimal degrees, negative for S and W."""
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(F.upper(hemisphere).isin("S", "W"), -value).otherwise(value)


def valid_gps(lat: Column, lon: Column) -> Column:
    """Both coordinates as a struct; null where one is missing or out of range, and at (0, 0)."""
    ok = (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))
    return F.when(ok, F.struct(lat.alias("lat"), lon.alias("lon")))


def utc_offset(text: Column | str) -> Column:
    """F8: minutes of ±HH:MM with at most 14 hours and under 60 minutes, else null."""
    t = _c(text)
    part = lambda i: F.regexp_extract(t, r"^([+-])([0-9]{2}):([0-9]{2})$", i)
    h, m = part(2).try_cast("int"), part(3).try_cast("int")
    return F.when((h <= 14) & (m < 60), (h * 60 + m) * F.when(part(1) == "-", -1).otherwise(1)).cast("smallint")


def _date_parts(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    n = lambda c: c.try_cast("int")
    ok = n(year).between(1900, 2200) & (n(second) <= 60)
    made = F.try_make_timestamp_ntz(n(year), n(month), n(day), n(hour), n(minute), n(second))
    return F.when(ok, made)


#: By falling precision. Compact date and time, separated date and time, date alone.
_DATE_TIME = r"(?<![0-9])((?:19|20)[0-9]{2})([0-9]{2})([0-9]{2})[_\-T ]?([0-9]{2})([0-9]{2})([0-9]{2})"
_SEPARATED = r"(?<![0-9])((?:19|20)[0-9]{2})-([0-9]{2})-([0-9]{2})(?:[ _\-T]| at | kl\.? )([0-9]{2})[.:\-]([0-9]{2})[.:\-]([0-9]{2})"
_DATE = r"(?<![0-9])((?:19|20)[0-9]{2})-?([0-9]{2})-?([0-9]{2})(?![0-9])"


def filename_time(name: Column | str) -> Column:
    """civil time from a file name: the first valid match of the most precise pattern; a date alone is midnight."""

    def first(pattern: str, clock: bool) -> Column:
        whole = F.regexp_extract_all(_c(name), F.lit(pattern), F.lit(0))
        part = lambda m, i: F.regexp_extract(m, pattern, i) if i < 4 or clock else F.lit("0")
        times = F.transform(whole, lambda m: _date_parts(*(part(m, i) for i in range(1, 7))))
        return F.get(F.filter(times, lambda t: t.isNotNull()), 0)

    return F.coalesce(first(_DATE_TIME, True), first(_SEPARATED, True), first(_DATE, False))


def resolve_date(exif: Column, name: Column, modified: Column) -> Column:
    """struct of civil time and its source: EXIF, then file name, then modification time if positive, else null."""
    by_name = filename_time(name)
    source = F.when(exif.isNotNull(), "exif").when(by_name.isNotNull(), "filename").when(modified > 0, "mtime")
    time = F.coalesce(exif, by_name, F.when(modified > 0, civil(modified)))
    return F.when(source.isNotNull(), F.struct(time.alias("taken_at"), source.alias("date_source")))


#: Canonical format of each file suffix.
FORMATS = {"jpg": "jpeg", "jpeg": "jpeg", "jpe": "jpeg", "heic": "heic", "heif": "heic", "hif": "heic", "png": "png", "webp": "webp"}


def format_of(name: Column | str) -> Column:
    """canonical format by suffix, else null."""
    suffix = F.lower(F.regexp_extract(_c(name), r"\.([^./]+)$", 1))
    return F.get(F.map_values(F.map_filter(F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv)), lambda k, _: k == suffix)), 0)


def prototype_score(sharp: Column, exposure: Column, color: Column) -> Column:
    """0 to 100."""
    return (sharp * 0.5 + exposure * 0.3 + color * 0.2) * 100


def technical_quality(sharp: Column, exposure: Column, motion: Column, noise: Column, cast: Column) -> Column:
    """share of sharpness, exposure and the absence of three faults."""
    return 0.40 * sharp + 0.25 * exposure + 0.15 * (1 - motion) + 0.10 * (1 - noise) + 0.10 * (1 - cast)


def learned_quality(w_sharp: Column, w_exposure: Column, w_color: Column, sharp: Column, exposure: Column, color: Column) -> Column:
    """weights made to sum to 1."""
    return (w_sharp * sharp + w_exposure * exposure + w_color * color) / (w_sharp + w_exposure + w_color)


def aesthetic(color: Column, exposure: Column, rank: Column) -> Column:
    """0 if unmeasured."""
    return F.coalesce(0.4 * color + 0.3 * exposure + 0.3 * rank, F.lit(0.0))


def natural_pages(n: Column, everyday: Column, adult_trip: Column, target: Column) -> Column:
    """pages of an event before any page cap."""
    free = F.greatest(F.lit(1.0), F.least(F.lit(16.0), F.round(0.6 * F.sqrt(n))))
    extra = F.floor(F.greatest(n - 200, F.lit(0)) / 100)
    trip = F.greatest(F.lit(2.0), F.least(F.lit(4.0) + extra, free))
    daily = F.ceil(1.5 * F.sqrt(n) / 4.0)
    return F.when(target.isNotNull(), F.greatest(target, F.lit(1))).when(everyday, daily).when(adult_trip, trip).otherwise(free).cast("double")


def target_pages(natural: Column, scale: Column) -> Column:
    """rounded when growing, floored when shrinking, at least 1."""
    n = natural * scale
    return F.greatest(F.when(scale > 1, F.round(n)).otherwise(F.floor(n)), F.lit(1)).cast("long")


def quota(n: Column, pages: Column, scale: Column, density: Column) -> Column:
    """how many of n photos an event gets."""
    share = F.least(0.5 * F.greatest(scale, F.lit(1.0)), F.lit(0.9))
    most = F.greatest(F.ceil(n * share), F.lit(1))
    return F.greatest(F.round(F.least(pages * 4.0 * density, most)), F.lit(1)).cast("long")


def mood_cap(nature: Column, adult_trip: Column) -> Column:
    """so many photos without people an event may have."""
    return F.when(nature, 4).when(adult_trip, 3).otherwise(1)


def dot(a: Column | str, b: Column | str) -> Column:
    """dot product of two arrays, in double."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column | str) -> Column:
    """of length 1; a zero vector stays. The length is bound as an array of one, so that it is taken once and not for each component."""
    scaled = lambda n: F.transform(_c(v), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return F.get(F.transform(F.array(F.sqrt(dot(v, v))), scaled), 0)


def iou(a: Column, b: Column) -> Column:
    """intersection over union of two boxes with x, y, w and h; 0 without any area."""
    side = lambda p, s: F.greatest(F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]), F.lit(0.0))
    both = side("x", "w") * side("y", "h")
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def grid_columns(n: Column) -> Column:
    """columns of a grid of n photos."""
    return F.when(n <= 2, 2).when(n == 3, 3).when(n == 4, 2).when(n <= 9, 3).otherwise(4).cast("int")


def price_tier(pages: Column) -> Column:
    """F32: pages rounded up to a multiple of 50, at least 50."""
    return F.greatest(F.lit(50), F.ceil(pages / 50) * 50).cast("long")


def price(pages: Column) -> Column:
    """F32: a base of 300 and 4 for each page of the tier."""
    return (300 + price_tier(pages) * 4).cast("long")


def aspect_key(width: Column, height: Column) -> Column:
    """shape class, 20 times the ratio of the sides."""
    return F.round(20.0 * width / height).cast("int")


def aspect_ratio(width: Column, height: Column, rotation: Column) -> Column:
    """ratio after rotation by quarter turns."""
    turned = F.pmod(rotation, F.lit(2)) == 1
    return F.when(turned, height / width).otherwise(width / height)


def ppi(pixels_long: Column, mm_long: Column) -> Column:
    """pixels for each inch of the drawn long side."""
    return pixels_long / (mm_long / 25.4)


def low_resolution(ppi_: Column) -> Column:
    return ppi_ < 150


def ask_why(actions: Column, skipped: Column) -> Column:
    """after the first three actions, then after each third, and no more after three skips in a row."""
    return (skipped < 3) & ((actions <= 3) | (actions % 3 == 0))


def percent_encoded(text: Column | str) -> Column:
    """line ends made CRLF, all but unreserved characters encoded."""
    crlf = F.regexp_replace(_c(text), r"\r\n|\r|\n", "\r\n")
    return F.replace(F.replace(F.replace(F.url_encode(crlf), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def fixed_label(ignored: Column, confirmed: Column, person: Column, group: Column) -> Column:
    """the label a face keeps when groups are made anew; null for the others."""
    return F.when(ignored, F.lit(999_999)).when(confirmed, F.coalesce(person, group))


def next_size(size: Column, single: Column, step: Column) -> Column:
    """size -1 to 4 after one step; from a single page the steps start at 3, else at 0."""
    now = F.coalesce(size, F.when(single, F.lit(3)).otherwise(F.lit(0)))
    return F.greatest(F.lit(-1), F.least(F.lit(4), now + step)).cast("int")


def name_line(names: Column) -> Column:
    """'A, B and C'."""
    n = F.size(names)
    return F.when(n <= 1, F.array_join(names, "")).otherwise(F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.get(names, n - 1)))


def date_span(first: Column, last: Column) -> Column:
    """one day, or first and last day."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return F.when(F.to_date(first) == F.to_date(last), day(first)).otherwise(F.concat_ws(" - ", day(first), day(last)))
