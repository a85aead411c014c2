"""Column functions: dates and labels, sizes and durations, paths, targets, estimates, boxes, vectors."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# German names.
MONTHS = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")
SHORT_MONTHS = ("Jan.", "Feb.", "März", "Apr.", "Mai", "Juni", "Juli", "Aug.", "Sept.", "Okt.", "Nov.", "Dez.")
DAYS = ("Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag", "Sonntag")
SHORT_DAYS = ("Mo.", "Di.", "Mi.", "Do.", "Fr.", "Sa.", "So.")
# Types by file extension.
MIME = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif",
    "heic": "image/heif", "heif": "image/heif", "avif": "image/avif", "mp4": "video/mp4", "mov": "video/quicktime",
    "3gp": "video/3gpp", "mkv": "video/x-matroska", "webm": "video/webm",
}


def pick(names: tuple[str, ...], i: Column) -> Column:
    """The i-th name, from 1."""
    return F.element_at(F.array(*(F.lit(n) for n in names)), i.cast("int"))


def local_date(ms: Column) -> Column:
    """The session zone's date of epoch milliseconds."""
    return F.to_date(F.timestamp_millis(ms))


def day_header(date: Column, today: dt.date) -> Column:
    """Heute, Gestern, the weekday for two to six days ago, else the date, with the year if it is another."""
    ago = F.datediff(F.lit(today), date)
    base = F.concat(pick(SHORT_DAYS, F.weekday(date) + 1), F.lit(", "), F.dayofmonth(date), F.lit(". "), pick(MONTHS, F.month(date)))
    year = F.year(date)
    return (
        F.when(ago == 0, "Heute").when(ago == 1, "Gestern").when(ago.between(2, 6), pick(DAYS, F.weekday(date) + 1))
        .when(year == today.year, base).otherwise(F.concat(base, F.lit(" "), year))
    )


def month_header(date: Column) -> Column:
    """Month and year, as in "März 2024"."""
    return F.concat(pick(MONTHS, F.month(date)), F.lit(" "), F.year(date))


def short_date(date: Column) -> Column:
    """Day, short month and year."""
    return F.concat(F.dayofmonth(date), F.lit(". "), pick(SHORT_MONTHS, F.month(date)), F.lit(" "), F.year(date))


def full_date(ts: Column) -> Column:
    """Weekday, date and time of day."""
    return F.concat(
        pick(DAYS, F.weekday(ts) + 1), F.lit(", "), F.dayofmonth(ts), F.lit(". "), pick(MONTHS, F.month(ts)), F.lit(" "), F.year(ts),
        F.lit(" · "), F.date_format(ts, "HH:mm"),
    )


def fmt_bytes(n: Column) -> Column:
    """Decimal units, rounded half to even, one decimal for GB with a comma."""
    size = F.abs(n.cast("double"))
    whole = lambda unit: F.bround(n / unit, 0).cast("long").cast("string")
    tenths = F.bround(n / 1e8, 0).cast("long")
    sign = F.when(tenths < 0, "-").otherwise("")
    gb = F.concat(sign, F.floor(F.abs(tenths) / 10).cast("string"), F.lit(","), (F.abs(tenths) % 10).cast("string"))
    return (
        F.when(size >= 1e9, F.concat(gb, F.lit(" GB"))).when(size >= 1e6, F.concat(whole(1e6), F.lit(" MB")))
        .when(size >= 1e3, F.concat(whole(1e3), F.lit(" KB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def div(a: Column, b: int) -> Column:
    """Integer division of values that are not negative."""
    return F.floor(a / b).cast("long")


def fmt_duration(ms: Column) -> Column:
    """h:mm:ss, or m:ss below an hour."""
    total = div(ms, 1000)
    h, m, s = div(total, 3600), div(total % 3600, 60), total % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(s))).otherwise(F.concat_ws(":", m.cast("string"), two(s)))


def fmt_eta(seconds: Column) -> Column:
    """Time left in minutes, hours or days."""
    s = lambda c: c.cast("string")
    return (
        F.when(seconds < 60, "< 1 Min.").when(seconds < 3600, F.concat(s(div(seconds, 60)), F.lit(" Min.")))
        .when(seconds < 86400, F.concat(s(div(seconds, 3600)), F.lit(" Std. "), s(div(seconds % 3600, 60)), F.lit(" Min.")))
        .otherwise(F.concat(s(div(seconds, 86400)), F.lit(" Tg. "), s(div(seconds % 86400, 3600)), F.lit(" Std.")))
    )


def fmt_worker(seconds: Column) -> Column:
    """Seconds, minutes, or hours and minutes."""
    s = lambda c: c.cast("string")
    hours = F.concat(s(div(seconds, 3600)), F.lit(" h "), s(div(seconds % 3600, 60)), F.lit(" min"))
    return F.when(seconds < 60, F.concat(s(seconds), F.lit(" s"))).when(seconds < 3600, F.concat(s(div(seconds, 60)), F.lit(" min"))).otherwise(hours)


def fmt_count(n: Column) -> Column:
    """Thousands with points."""
    return F.translate(F.format_number(n, 0), ",", ".")


def fmt_percent(f: Column) -> Column:
    """Whole percent, cut off."""
    return F.concat((f * 100).cast("int").cast("string"), F.lit(" %"))


def extension(name: Column) -> Column:
    """Lower-cased text after the last point; empty without a point."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def mime_of(name: Column) -> Column:
    """Image or video type of a file name, else null."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv)), extension(name))


def restore_path(path: Column, video: Column) -> Column:
    """Where a file of a backup goes back to."""
    low = F.lower(path)
    keeps = low.startswith("dcim") | low.startswith("pictures") | (video & low.startswith("movies"))
    other = F.concat(F.lit("Pictures/Wiederhergestellt/"), F.when(F.trim(path) == "", "Backup").otherwise(path))
    return F.concat(F.when(keeps, path).otherwise(other), F.lit("/"))


def round_half_up(x: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(x + 0.5).cast("int")


def image_target(w: Column, h: Column, long_edge: int, short_edge: int) -> Column:
    """struct<w, h> that an image shrinks to; null if it fits or has no size."""
    scale = F.least(F.lit(float(long_edge)) / F.greatest(w, h), F.lit(float(short_edge)) / F.least(w, h))
    one = lambda x: F.greatest(round_half_up(x * scale), F.lit(1))
    return F.when((w > 0) & (h > 0) & (scale < 1), F.struct(one(w).alias("w"), one(h).alias("h")))


def heuristic_ratio(w: Column, h: Column, target: Column, quality: int) -> Column:
    """Guess of new by old bytes: pixels, times a factor of the JPEG quality, from 0.03 to 1."""
    pixels = F.coalesce(target["w"].cast("double") * target["h"] / (w.cast("double") * h), F.lit(1.0))
    q = quality / 100
    return F.least(F.greatest(pixels * ((0.25 + 0.75 * q**3) * 1.4), F.lit(0.03)), F.lit(1.0))


def video_target(w: Column, h: Column, short_edge: int) -> Column:
    """struct<w, h> that a video shrinks to, even numbers; its own size if that fits."""
    scale = F.lit(float(short_edge)) / F.least(w, h)
    even = lambda x: F.floor(round_half_up(x * scale) / 2).cast("int") * 2
    shrinks = (w > 0) & (h > 0) & (F.least(w, h) > short_edge)
    return F.struct(F.when(shrinks, even(w)).otherwise(w).alias("w"), F.when(shrinks, even(h)).otherwise(h).alias("h"))


def video_estimate(w: Column, h: Column, ms: Column, short_edge: int, quality: int, hevc: bool, fps: float = 30.0) -> Column:
    """Bytes of a re-encoded video: pixels, frames and bits per pixel, with the sound."""
    t, q = video_target(w, h, short_edge), quality / 100
    per_pixel = (0.015 + 0.11 * q * q) * (0.6 if hevc else 1.0) * min(max(fps, 15.0), 120.0)
    bits = F.least(F.greatest((t["w"].cast("long") * t["h"] * F.lit(per_pixel)).cast("long"), F.lit(400_000)), F.lit(80_000_000))
    return div((bits + 192_000) * ms, 8000)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in the order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """The vector by its length; a zero vector stays as it is."""
    by = lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return F.transform(F.array(F.sqrt(dot(v, v))), by)[0]  # the length is a lambda's argument, so it is computed once


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Overlap of two boxes (left, top, right, bottom) by their union."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def parse_location(text: Column) -> Column:
    """struct<lat, lon> of an ISO 6709 text; null outside the ranges and at (0, 0)."""
    pattern = r"([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)"
    lat, lon = (F.regexp_extract(text, pattern, i).try_cast("double") for i in (1, 2))
    fine = lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    return F.when(fine, F.struct(lat.alias("lat"), lon.alias("lon")))


def parse_capture_time(text: Column) -> Column:
    """Epoch milliseconds of a compact UTC time in one of three forms; null if none gives more than zero."""
    zoned = [F.unix_millis(F.try_to_timestamp(text, F.lit(p))) for p in ("yyyyMMdd'T'HHmmss.SSS'Z'", "yyyyMMdd'T'HHmmss'Z'", "yyyyMMdd'T'HHmmss")]
    return F.coalesce(*(F.when(z > 0, z) for z in zoned))


def exif_display(exif: Column) -> dict[str, Column]:
    """Camera, aperture, exposure, sensitivity and focal length of an EXIF map<string,string> as text; null where absent."""
    get = lambda k: F.element_at(exif, k)
    number = lambda k: get(k).try_cast("double")
    comma = lambda c: F.translate(c, ".", ",")
    seconds = number("ExposureTime")
    short = F.concat(F.lit("1/"), round_half_up(1 / seconds).cast("string"), F.lit(" s"))
    camera = F.trim(F.concat_ws(" ", get("Make"), get("Model")))
    return {
        "camera": F.when(camera != "", camera),
        "aperture": F.concat(F.lit("f/"), comma(F.format_number(number("FNumber"), 1))),
        "exposure": F.when((seconds > 0) & (seconds < 1), short).when(seconds >= 1, F.concat(comma(F.format_number(seconds, 1)), F.lit(" s"))),
        "iso": F.concat(F.lit("ISO "), get("PhotographicSensitivity")),
        "focal": F.concat(comma(F.format_number(number("FocalLength"), 1)), F.lit(" mm")),
    }


def face_crop(box: tuple[Column, ...], w: Column, h: Column, margin: float = 1.7) -> Column:
    """struct<x, y, side> in pixels of the square around a face's box (shares of the image), inside the image."""
    side = F.least(F.greatest((box[2] - box[0]) * w, (box[3] - box[1]) * h) * margin, w.cast("double"), h.cast("double"))
    inside = lambda middle, room: F.least(F.greatest(middle - side / 2, F.lit(0.0)), room - side)
    x, y = inside((box[0] + box[2]) / 2 * w, w), inside((box[1] + box[3]) / 2 * h, h)
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("int").alias("side"))
