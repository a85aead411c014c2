"""Queries over events, faces' boxes and landmarks, colours and ids."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeria.functions import kernels as K
from galeria.functions import scalars as S
from galeria.plans.catalog_queries import query
from galeria.sources import tables as T
from galeria.sources.tables import load
from galeria.streaming import streams as ST


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with timestamps that sessions accept."""
    return load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("WITH e AS (SELECT user_id, event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ts AS gap FROM events) SELECT user_id, event_id FROM e WHERE gap IS NULL OR gap >= INTERVAL 6 HOURS", "")
def debounce_last(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each burst of a user."""
    return ST.debounced(events(spark, d), "user_id", "6 hours").select("user_id", "event_id")


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS latest_view, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS latest_purchase
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", "")  # fmt: skip
def combine_latest(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the latest values of two inputs."""
    return ST.latest_values(events(spark, d), "user_id", ["view", "purchase"])


@query("SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type", "")
def distinct_until_changed(spark: SparkSession, d: str) -> DataFrame:
    """Events of another type than the user's one before."""
    return ST.changes(events(spark, d), "user_id", "event_type").select("event_id", "event_type")


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1", "")
def drop_first(spark: SparkSession, d: str) -> DataFrame:
    """All but each user's first event."""
    return ST.after_first(events(spark, d), "user_id").select("event_id")


@query("SELECT event_id, user_id FROM events WHERE user_id = (SELECT user_id FROM events WHERE event_type = 'click' ORDER BY ts DESC LIMIT 1)", "")
def switch_latest(spark: SparkSession, d: str) -> DataFrame:
    """Events of the user who clicked last."""
    e = events(spark, d)
    keys = e.where("event_type = 'click'").select("ts", F.col("user_id").alias("key"))
    return ST.switch_latest(keys, e.withColumn("key", F.col("user_id"))).select("event_id", "user_id")


@query("""WITH e AS (SELECT *, last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS now FROM events)
 SELECT event_id, user_id FROM e WHERE event_id % 3 <> 0 AND event_type = now""", "")  # fmt: skip
def switch_scoped(spark: SparkSession, d: str) -> DataFrame:
    """Events of the type that their user has selected last; every third event selects its own."""
    return ST.switched(events(spark, d), "user_id", "event_type", F.col("event_id") % 3 == 0).select("event_id", "user_id")


_SIDE = "least(greatest((r - l) * 1000, (l + 0.3 - l / 2) * 600) * 1.7, 1000, 600)"


@query(f"""WITH b AS (SELECT id, l, r, {_SIDE} AS side FROM faces) SELECT id, CAST(trunc(least(greatest((l + r) / 2 * 1000 - side / 2, 0), 1000 - side)) AS INT) AS x,
 CAST(trunc(least(greatest((l / 2 + (l + 0.3)) / 2 * 600 - side / 2, 0), 600 - side)) AS INT) AS y, CAST(trunc(side) AS INT) AS side FROM b""", "faces")  # fmt: skip
def face_crop(spark: SparkSession, d: str) -> DataFrame:
    """The square around every face, in pixels of its photo."""
    left = F.col("l")
    box = (left, left / 2, F.col("r"), left + 0.3)
    return T.faces(spark, d).select("id", S.face_crop(box, F.lit(1000), F.lit(600)).alias("s")).select("id", "s.*")


@query("""SELECT doc_id AS id, 'Make' || doc_id % 3 || CASE WHEN doc_id % 4 > 0 THEN ' Model' || doc_id % 4 ELSE '' END AS camera, 'f/' || CASE doc_id % 3 WHEN 0 THEN '1,8' WHEN 1 THEN '2,0' ELSE '11,0' END AS aperture,
 CASE doc_id % 5 WHEN 0 THEN '1/250 s' WHEN 1 THEN '1/2 s' WHEN 2 THEN '2,5 s' END AS exposure, 'ISO ' || (doc_id % 7 + 1) * 100 AS iso FROM documents""", "")  # fmt: skip
def exif_display(spark: SparkSession, d: str) -> DataFrame:
    """Capture data of every item as text."""
    i = F.col("doc_id")
    pick = lambda n, *v: F.element_at(F.array(*(F.lit(x) for x in v)), (i % n).cast("int") + 1)
    model = F.when(i % 4 > 0, F.concat(F.lit("Model"), (i % 4).cast("string")))
    exif = F.map_from_arrays(
        F.array(*(F.lit(k) for k in ("Make", "Model", "FNumber", "ExposureTime", "PhotographicSensitivity"))),
        F.array(F.concat(F.lit("Make"), (i % 3).cast("string")), model, pick(3, "1.8", "2", "11.0"), pick(5, "0.004", "0.5", "2.5", None, "x"), ((i % 7 + 1) * 100).cast("string")),
    )
    shown = load(spark, d, "documents").select("doc_id", exif.alias("e"))
    text = S.exif_display(F.col("e"))
    return shown.select(i.alias("id"), *(text[c].alias(c) for c in ("camera", "aperture", "exposure", "iso")))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1", "")
def live_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts and sums by type."""
    return ST.live_counts(events(spark, d))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, json_extract_string(props, '$.missing') AS missing FROM events", "")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a JSON column."""
    parsed = F.from_json("props", "k int, missing string")
    return load(spark, d, "events").select("event_id", parsed.alias("p")).select("event_id", "p.k", "p.missing")


_LAT, _LON = "(event_id * 7919 % 18001) / 100.0::DOUBLE - 90", "(event_id * 104729 % 36001) / 100.0::DOUBLE - 180"
_GEO_SQL = f"""CASE event_id % 11 WHEN 3 THEN 'nowhere' WHEN 5 THEN '+00.0000+000.0000/' WHEN 7 THEN concat('x+1.5-', CAST(event_id % 400 AS VARCHAR), '.25') WHEN 9 THEN printf('%+08.4f%+09.4f/', {_LAT} + 20, {_LON})
 ELSE printf('%+08.4f%+09.4f/', {_LAT}, {_LON}) END"""


@query(f"""WITH t AS (SELECT event_id, {_GEO_SQL} AS text FROM events), m AS (SELECT event_id, TRY_CAST(regexp_extract(text, '([+-]\\d+(?:\\.\\d+)?)([+-]\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) AS lat, TRY_CAST(regexp_extract(text, '([+-]\\d+(?:\\.\\d+)?)([+-]\\d+(?:\\.\\d+)?)', 2) AS DOUBLE) AS lon FROM t),
 f AS (SELECT *, lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0) AS ok FROM m) SELECT event_id, CASE WHEN ok THEN lat END AS lat, CASE WHEN ok THEN lon END AS lon FROM f""", "")  # fmt: skip
def parse_geo(spark: SparkSession, d: str) -> DataFrame:
    """Places of the ISO 6709 texts that events are written down with."""
    i = F.col("event_id")
    lat, lon = (i * 7919 % 18001) / F.lit(100.0) - 90, (i * 104729 % 36001) / F.lit(100.0) - 180
    text = (
        F.when(i % 11 == 3, "nowhere").when(i % 11 == 5, "+00.0000+000.0000/").when(i % 11 == 7, F.concat(F.lit("x+1.5-"), (i % 400).cast("string"), F.lit(".25")))
        .otherwise(F.format_string("%+08.4f%+09.4f/", F.when(i % 11 == 9, lat + 20).otherwise(lat), lon))
    )
    return load(spark, d, "events").select("event_id", S.parse_location(text).alias("g")).select("event_id", "g.lat", "g.lon")


@query("""WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y%m%dT%H%M%S.%gZ') WHEN 1 THEN strftime(ts, '%Y%m%dT%H%M%SZ') WHEN 2 THEN strftime(ts, '%Y%m%dT%H%M%S') WHEN 3 THEN event_type ELSE '19700101T000000Z' END AS text FROM events),
 p AS (SELECT event_id, coalesce(epoch_ms(try_strptime(text, '%Y%m%dT%H%M%S.%gZ')), epoch_ms(try_strptime(text, '%Y%m%dT%H%M%SZ')), epoch_ms(try_strptime(text, '%Y%m%dT%H%M%S'))) AS ms FROM t)
 SELECT event_id, CASE WHEN ms > 0 THEN ms END AS ms FROM p""", "")  # fmt: skip
def parse_ts(spark: SparkSession, d: str) -> DataFrame:
    """Capture times in the three forms that events are written down with, and in none."""
    kind, base = F.col("event_id") % 5, F.date_format("ts", "yyyyMMdd'T'HHmmss")
    text = (
        F.when(kind == 0, F.date_format("ts", "yyyyMMdd'T'HHmmss.SSS'Z'")).when(kind == 1, F.concat(base, F.lit("Z"))).when(kind == 2, base)
        .when(kind == 3, F.col("event_type")).otherwise("19700101T000000Z")
    )
    return events(spark, d).select("event_id", S.parse_capture_time(text).alias("ms"))


_BOX = "SELECT id, score, l, (id % 5) / 10.0::DOUBLE AS t, r, (id % 5) / 10.0::DOUBLE + 0.3 AS b FROM faces"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """The faces' boxes: ``id, score, l, t, r, b``."""
    top = (F.col("id") % 5) / F.lit(10.0)
    return T.faces(spark, d).select("id", "score", "l", top.alias("t"), "r", (top + 0.3).alias("b"))


@query(f"""WITH box AS ({_BOX}), p AS (SELECT a.id AS a, b.id AS b, greatest(least(a.r, b.r) - greatest(a.l, b.l), 0) * greatest(least(a.b, b.b) - greatest(a.t, b.t), 0) AS i,
 (a.r - a.l) * (a.b - a.t) + (b.r - b.l) * (b.b - b.t) AS s FROM box a JOIN box b ON a.id // 8 = b.id // 8 AND a.id < b.id) SELECT a, b, round(CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0 END, 9) AS iou FROM p""", "faces")  # fmt: skip
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps of the faces of one picture, eight each."""
    x, y = (boxes(spark, d).select(F.floor(F.col("id") / 8).alias("image"), *(F.col(c).alias(f"{c}{k}") for c in ("id", "l", "t", "r", "b"))) for k in (1, 2))
    met = x.join(y, "image").where("id1 < id2")
    side = lambda k: tuple(F.col(f"{c}{k}") for c in ("l", "t", "r", "b"))
    return met.select(F.col("id1").alias("a"), F.col("id2").alias("b"), F.round(S.iou(side(1), side(2)), 9).alias("iou"))


@query("SELECT id, least(greatest((l * 1000 - 100) / 150.0::DOUBLE, 0), 1) AS l, least(greatest((r * 1000 + 40) / 640.0::DOUBLE, 0), 1) AS r FROM faces", "faces")
def clamp_box(spark: SparkSession, d: str) -> DataFrame:
    """Edges of boxes found beside and beyond the image, as shares of it, 0 to 1."""
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return T.faces(spark, d).select("id", clamp((F.col("l") * 1000 - 100) / F.lit(150.0)).alias("l"), clamp((F.col("r") * 1000 + 40) / F.lit(640.0)).alias("r"))


_KEPT = "{{'l': {0}.l, 't': {0}.t, 'r': {0}.r, 'b': {0}.b}}"
_OVER = "greatest(least(x.r, o.r) - greatest(x.l, o.l), 0) * greatest(least(x.b, o.b) - greatest(x.t, o.t), 0)"
_FREE = f"len(list_filter(s.kept, lambda x: {_OVER} > 0.4 * ((x.r - x.l) * (x.b - x.t) + (o.r - o.l) * (o.b - o.t) - {_OVER}))) = 0"


@query(f"""WITH RECURSIVE faces AS ({T.SQL["faces"]}), box AS ({_BOX}), o AS (SELECT id // 10 AS image, id, score, l, t, r, b, row_number() OVER (PARTITION BY id // 10 ORDER BY score DESC, id) AS k FROM box),
 s AS (SELECT image, k, id, score, true AS ok, [{_KEPT.format("o")}] AS kept FROM o WHERE k = 1 UNION ALL
  SELECT o.image, o.k, o.id, o.score, {_FREE}, CASE WHEN {_FREE} THEN list_append(s.kept, {_KEPT.format("o")}) ELSE s.kept END FROM s JOIN o ON o.image = s.image AND o.k = s.k + 1)
 SELECT image, id, score FROM s WHERE ok""", "")  # fmt: skip
def nms(spark: SparkSession, d: str) -> DataFrame:
    """Faces of each picture of ten that no better one overlaps too much."""
    rows = boxes(spark, d).select(F.floor(F.col("id") / 10).alias("image"), "id", "score", "l", "t", "r", "b")
    return rows.groupBy("image").applyInPandas(lambda pdf: K.suppress(pdf), "image long, id long, score double")


# Where five landmarks of a face go.
TEMPLATE = (38.2946, 51.6963, 73.5318, 51.5014, 56.0252, 71.7366, 41.5493, 92.3655, 70.7299, 92.2041)


def _landmarks() -> str:
    return ", ".join(f"({i}, {TEMPLATE[2 * i]}::DOUBLE, {TEMPLATE[2 * i + 1]}::DOUBLE)" for i in range(5))


@query(f"""WITH tpl(i, qx, qy) AS (VALUES {_landmarks()}), p AS (SELECT id, i, qx, qy, 1000 * l + qx * (r - l) * 10 - qy * (id % 3) * 0.25::DOUBLE AS px, 1000 * score + qy * (r - l) * 10 + qx * (id % 3) * 0.25::DOUBLE AS py FROM faces, tpl),
 m AS (SELECT id, avg(px) AS sx, avg(py) AS sy, avg(qx) AS dx, avg(qy) AS dy FROM p GROUP BY id),
 n AS (SELECT p.id, sum((px - sx) * (qx - dx) + (py - sy) * (qy - dy)) / sum((px - sx) ** 2 + (py - sy) ** 2) AS a, sum((px - sx) * (qy - dy) - (py - sy) * (qx - dx)) / sum((px - sx) ** 2 + (py - sy) ** 2) AS b FROM p JOIN m ON m.id = p.id GROUP BY p.id)
 SELECT n.id, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(dx - (a * sx - b * sy), 6) + 0.0 AS tx, round(dy - (b * sx + a * sy), 6) + 0.0 AS ty FROM n JOIN m ON m.id = n.id""", "faces")  # fmt: skip
def ls_transform(spark: SparkSession, d: str) -> DataFrame:
    """Least-squares rotation, scale and shift of every face's landmarks onto the template."""
    i, left, wide, top = F.col("id"), F.col("l"), F.col("r") - F.col("l"), F.col("score")
    tpl = F.array(*(F.struct(F.lit(TEMPLATE[2 * k]).alias("qx"), F.lit(TEMPLATE[2 * k + 1]).alias("qy")) for k in range(5)))
    p = T.faces(spark, d).select("id", (1000 * left).alias("x0"), (1000 * top).alias("y0"), (wide * 10).alias("by"), F.explode(tpl).alias("q")).select("*", "q.*")
    p = p.withColumn("px", F.col("x0") + F.col("qx") * F.col("by") - F.col("qy") * (i % 3) * 0.25).withColumn("py", F.col("y0") + F.col("qy") * F.col("by") + F.col("qx") * (i % 3) * 0.25)
    means = p.groupBy("id").agg(*(F.avg(c).alias(n) for c, n in (("px", "sx"), ("py", "sy"), ("qx", "dx"), ("qy", "dy"))))
    c = p.join(means, "id").select("id", "sx", "sy", "dx", "dy", *((F.col(f"{q}{k}") - F.col(m)).alias(f"{q}{k}") for q, k, m in (("p", "x", "sx"), ("p", "y", "sy"), ("q", "x", "dx"), ("q", "y", "dy"))))
    same, turn = F.col("px") * F.col("qx") + F.col("py") * F.col("qy"), F.col("px") * F.col("qy") - F.col("py") * F.col("qx")
    s = c.groupBy("id", "sx", "sy", "dx", "dy").agg(F.sum(same).alias("same"), F.sum(turn).alias("turn"), F.sum(F.col("px") ** 2 + F.col("py") ** 2).alias("len"))
    s = s.withColumn("a", F.col("same") / F.col("len")).withColumn("b", F.col("turn") / F.col("len"))
    a, b = F.col("a"), F.col("b")
    s = s.withColumn("tx", F.col("dx") - (a * F.col("sx") - b * F.col("sy"))).withColumn("ty", F.col("dy") - (b * F.col("sx") + a * F.col("sy")))
    return s.select("id", *((F.round(x, 6) + 0.0).alias(x) for x in ("a", "b", "tx", "ty")))


# Luminance weights of saturation.
LUMA = (0.213, 0.715, 0.072)


def saturation(s: float) -> list[float]:
    """A 4 by 5 colour matrix that changes saturation."""
    m = [[(1 - s) * LUMA[c] + (s if r == c else 0) for c in range(3)] + [0, 0] for r in range(3)]
    return [x for row in m for x in row] + [0, 0, 0, 1, 0]


def shifted(scale: tuple[float, float, float], shift: tuple[float, float, float]) -> list[float]:
    """A colour matrix that scales and shifts each channel."""
    return [x for r in range(3) for x in (*(scale[r] if c == r else 0.0 for c in range(4)), shift[r])] + [0, 0, 0, 1, 0]


def concat_matrix(after: Column, before: Column) -> Column:
    """The matrix that applies ``before``, then ``after``; rows have four factors and a shift."""

    def cell(k: Column) -> Column:
        r, c = F.floor(k / 5).cast("int"), (k % 5).cast("int")
        terms = [after[(r * 5 + j).cast("int")] * before[(F.lit(5 * j) + c).cast("int")] for j in range(4)]
        return sum(terms[1:], terms[0]) + F.when(c == 4, after[(r * 5 + 4).cast("int")]).otherwise(0.0)

    return F.transform(F.sequence(F.lit(0), F.lit(19)), cell)


def adjusted(base: Column, brightness: float, contrast: float, sat: float, warmth: float, tint: float) -> Column:
    """A filter's matrix with the adjustments after it: saturation, contrast around mid grey, warmth and tint."""
    c = 1 + contrast
    t = 128 * (1 - c) + brightness * 100
    steps = (saturation(1 + sat), shifted((c, c, c), (t, t, t)), shifted((1.0, 1.0, 1.0), (warmth * 30, tint * 25, -warmth * 30)))
    for step in steps:  # the matrix so far is a lambda's argument, so it is computed once
        after = F.array(*(F.lit(float(x)) for x in step))
        base = F.transform(F.array(base), partial(concat_matrix, after))[0]
    return base


# The filters by name, each one or two matrices, the second after the first.
SAME = [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
FILTERS = {
    "Original": (SAME, SAME),
    "Lebendig": (saturation(1.35), SAME),
    "Warm": (shifted((1.08, 1.0, 0.9), (12.0, 4.0, -8.0)), SAME),
    "Kühl": (shifted((0.92, 1.0, 1.1), (-6.0, 2.0, 14.0)), SAME),
    "S/W": (saturation(0.0), SAME),
    "Noir": (saturation(0.0), shifted((1.35, 1.35, 1.35), (-40.0, -40.0, -40.0))),
    "Sepia": ([0.393, 0.769, 0.189, 0.0, 0.0, 0.349, 0.686, 0.168, 0.0, 0.0, 0.272, 0.534, 0.131, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0], SAME),
    "Vintage": (saturation(0.7), shifted((0.95, 0.92, 0.8), (20.0, 14.0, 10.0))),
}


def _colour_sql(b: float, c: float, s: float, w: float, t: float) -> str:
    """The filters and adjustments as products of 5 by 5 matrices; saturation is written out from the luminance weights."""
    grey = lambda x: f"SELECT r, c, CASE WHEN r < 3 AND c < 3 THEN (1 - ({x})) * [{', '.join(map(str, LUMA))}][c + 1] + CASE WHEN r = c THEN {x} ELSE 0 END WHEN r = c THEN 1 ELSE 0 END AS x FROM cells"
    lin = lambda m, h: f"SELECT r, c, CASE WHEN r < 3 AND r = c THEN [{m}][r + 1] WHEN r < 3 AND c = 4 THEN [{h}][r + 1] WHEN r = c THEN 1.0 ELSE 0.0 END AS x FROM cells"
    same, sepia = lin("1.0, 1.0, 1.0", "0.0, 0.0, 0.0"), "0.393, 0.769, 0.189, 0, 0, 0.349, 0.686, 0.168, 0, 0, 0.272, 0.534, 0.131, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1"
    pairs = {
        "Original": (same, same), "Lebendig": (grey(1.35), same), "Warm": (lin("1.08, 1.0, 0.9", "12, 4, -8"), same), "Kühl": (lin("0.92, 1.0, 1.1", "-6, 2, 14"), same),
        "S/W": (grey(0), same), "Noir": (grey(0), lin("1.35, 1.35, 1.35", "-40, -40, -40")), "Sepia": (f"SELECT r, c, [{sepia}][r * 5 + c + 1] AS x FROM cells", same),
        "Vintage": (grey(0.7), lin("0.95, 0.92, 0.8", "20, 14, 10")),
    }
    first, second = (" UNION ALL ".join(f"SELECT '{n}' AS f, r, c, CAST(x AS DOUBLE) AS x FROM ({p[k]})" for n, p in pairs.items()) for k in (0, 1))
    contrast, level = 1 + c, 128 * (1 - (1 + c)) + b * 100
    steps = (grey(1 + s), lin(", ".join([str(contrast)] * 3), ", ".join([str(level)] * 3)), lin("1.0, 1.0, 1.0", f"{w * 30}, {t * 25}, {-w * 30}"))
    ctes = [f"m0 AS ({first})", f"two AS ({second})", "m1 AS (SELECT a.f, a.r, b.c, sum(a.x * b.x) AS x FROM two a JOIN m0 b ON b.f = a.f AND a.c = b.r GROUP BY ALL)"]
    for k, step in enumerate(steps, 2):
        ctes.append(f"m{k} AS (SELECT b.f, a.r, b.c, sum(CAST(a.x AS DOUBLE) * b.x) AS x FROM ({step}) a JOIN m{k - 1} b ON a.c = b.r GROUP BY ALL)")
    cells = "cells AS (SELECT r, c FROM range(5) i(r), range(5) j(c))"
    names = "[" + ", ".join(f"'{n}'" for n in pairs) + "]"
    colours = f"d AS (SELECT doc_id, {names}[1 + doc_id % 8] AS f, [doc_id * 37 % 256, n_chars % 256, (doc_id * 11 + n_chars) % 256, 255, 1] AS v FROM documents)"
    out = "SELECT doc_id, d.f AS filter, CAST(r AS INT) AS channel, round(least(greatest(sum(x * v[c + 1]), 0), 255), 6) + 0.0 AS x FROM d JOIN m4 ON m4.f = d.f WHERE r < 3 GROUP BY ALL"
    return f"WITH {cells}, {', '.join(ctes)}, {colours} {out}"


ADJUSTMENTS = (0.1, 0.2, -0.3, 0.5, -0.25)


@query(_colour_sql(*ADJUSTMENTS), "")
def color_matrix(spark: SparkSession, d: str) -> DataFrame:
    """A colour of every document through one of the filters with adjustments, a matrix each; channels stay within 0 to 255."""
    names = spark.createDataFrame([(i, n, *([float(x) for x in m] for m in pair)) for i, (n, pair) in enumerate(FILTERS.items())], "k long, filter string, first array<double>, second array<double>")
    names = names.select("k", "filter", adjusted(concat_matrix(F.col("second"), F.col("first")), *ADJUSTMENTS).alias("m"))
    i, n = F.col("doc_id"), F.col("n_chars")
    rows = load(spark, d, "documents").select("doc_id", (i % 8).alias("k"), F.array(*(c.cast("double") for c in (i * 37 % 256, n % 256, (i * 11 + n) % 256, F.lit(255)))).alias("v"))
    channel = lambda r: sum((F.col("m")[5 * r + c] * F.col("v")[c] for c in range(4)), F.col("m")[5 * r + 4])
    out = rows.join(F.broadcast(names), "k").select("doc_id", "filter", F.posexplode(F.array(*(channel(r) for r in range(3)))).alias("channel", "x"))  # eight filters
    return out.select("doc_id", "filter", "channel", (F.round(F.least(F.greatest("x", F.lit(0.0)), F.lit(255.0)), 6) + 0.0).alias("x"))


@query("""WITH t AS (SELECT doc_id, list_transform(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> ''), lambda w: CAST(length(w) + 100 AS INT)) AS ids FROM documents)
 SELECT doc_id, array_to_string(list_concat(list_concat([1], ids[1:8], [2]), list_transform(range(greatest(0, 8 - len(ids))), lambda x: 0)), ',') AS clip,
 array_to_string(list_concat(list_concat(ids[1:9], [2]), list_transform(range(greatest(0, 9 - len(ids))), lambda x: 0)), ',') AS pieces FROM t""", "")  # fmt: skip
def pad_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Every document's ids, one by each word's length, between their marks, cut and padded to ten."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), " "), "")
    ids = F.transform(words, lambda w: (F.length(w) + 100).cast("int"))

    def framed(head: list[int], x: Column) -> Column:
        room = 10 - len(head) - 1
        body = F.concat(F.array(*(F.lit(h) for h in head)).cast("array<int>"), F.slice(x, 1, room), F.array(F.lit(2)))
        return F.array_join(F.concat(body, F.array_repeat(F.lit(0), F.lit(10) - F.size(body))), ",")

    rows = load(spark, d, "documents").select("doc_id", ids.alias("ids"))
    return rows.select("doc_id", framed([1], F.col("ids")).alias("clip"), framed([], F.col("ids")).alias("pieces"))


#: Small vocabularies for the encoders' queries.
MERGES = [("t", "h"), ("th", "e</w>"), ("a", "n"), ("i", "n"), ("in", "g</w>"), ("e", "r"), ("an", "d</w>")]
PIECE_MERGES = [("▁", "t"), ("▁t", "h"), ("▁th", "e"), ("a", "n")]
LETTERS = K.byte_letters()
CLIP = ["<unk>", *LETTERS, *(x + "</w>" for x in LETTERS), *(a + b for a, b in MERGES)]
PIECE = ["<unk>", "▁", *"abcdefghijklmnopqrstuvwxyz", *(a + b for a, b in PIECE_MERGES), *(f"<0x{b:02X}>" for b in range(256))]


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _merged_sql(symbols: str, merges: list[tuple[str, str]], vocabulary: list[str]) -> str:
    """Ids of symbols that stand between marks (character 1): merged by rank, as no merge here makes a pair of a lower one."""
    for a, b in merges:
        symbols = f"replace({symbols}, chr(1) || {_quoted(a)} || chr(1) || chr(1) || {_quoted(b)} || chr(1), chr(1) || {_quoted(a + b)} || chr(1))"
    known = "[" + ", ".join(map(_quoted, vocabulary)) + "]"
    return f"list_transform(list_filter(string_split({symbols}, chr(1)), lambda x: x <> ''), lambda x: coalesce(list_position({known}, x), 1) - 1)"


_PIECES = K.PIECES.pattern.replace("'", "''")
_BYTES = "list_transform(range(1, len(hex(encode({0}))), 2), lambda i: CAST('0x' || hex(encode({0}))[i:i + 1] AS INT))"
_LETTER = "[" + ", ".join(map(_quoted, LETTERS)) + "][b + 1]"
_DIGESTED = "SELECT {0}, CAST(len(ids) AS INT) AS n, md5(array_to_string(ids, ',')) AS digest"


@query(f"""WITH p AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')), '{_PIECES}') AS ps FROM documents WHERE text IS NOT NULL),
 w AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM p), u AS (SELECT DISTINCT p FROM w),
 l AS (SELECT p, array_to_string(list_transform({_BYTES.format("p")}, lambda b: chr(1) || {_LETTER}), chr(1)) || '</w>' || chr(1) AS s FROM u),
 e AS (SELECT p, {_merged_sql("s", MERGES, CLIP)} AS ids FROM l),
 d AS (SELECT doc_id, flatten(list(ids ORDER BY pos)) AS ids FROM w JOIN e USING (p) GROUP BY doc_id),
 a AS (SELECT documents.doc_id, CASE WHEN text IS NOT NULL THEN coalesce(ids, []) END AS ids FROM documents LEFT JOIN d ON d.doc_id = documents.doc_id) {_DIGESTED.format("doc_id")} FROM a""", "")  # fmt: skip
def bpe_clip(spark: SparkSession, d: str) -> DataFrame:
    """Ids of all documents by words and merges."""
    encode = K.tokenizer("clip", {s: i for i, s in enumerate(CLIP)}, MERGES)
    return digested(load(spark, d, "documents").select("doc_id", encode("text").alias("ids")))


@query(f"""WITH t AS (SELECT item_id, string_split(replace(lower(text), ' ', '▁'), '') AS cs FROM benchmark WHERE text IS NOT NULL),
 s AS (SELECT item_id, array_to_string(list_transform(cs, lambda c: CASE WHEN regexp_full_match(c, '[a-z▁]') THEN chr(1) || c || chr(1) ELSE regexp_replace(hex(encode(c)), '(..)', chr(1) || '<0x\\1>' || chr(1), 'g') END), '') AS s FROM t),
 a AS (SELECT benchmark.item_id, {_merged_sql("s", PIECE_MERGES, PIECE)} AS ids FROM benchmark LEFT JOIN s ON s.item_id = benchmark.item_id) {_DIGESTED.format("item_id")} FROM a""", "")  # fmt: skip
def bpe_sp(spark: SparkSession, d: str) -> DataFrame:
    """Ids of short texts as one word, with bytes for unknown characters."""
    encode = K.tokenizer("pieces", {s: i for i, s in enumerate(PIECE)}, PIECE_MERGES)
    texts = load(spark, d, "benchmark").select("item_id", F.lower("text").alias("text"))
    return digested(texts.select("item_id", encode("text").alias("ids")))


def digested(encoded: DataFrame) -> DataFrame:
    """The first column, the number of ids, and a digest of them; null without a text."""
    n, ids = F.when(F.col("ids").isNotNull(), F.size("ids")), F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(encoded.columns[0], n.alias("n"), F.md5(ids).alias("digest"))
