"""Queries over the media table, stored keys, backups, orders and documents."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galeria.functions import scalars as S
from galeria.operators import catalog as C
from galeria.operators import maintain as M
from galeria.plans.numbering import numbered
from galeria.sources import tables as T
from galeria.sources.tables import media, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a query function and its DuckDB SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql, *(views or ("media",))) if views != ("",) else sql
        return f

    return add


DAY = "CAST(epoch_ms(CAST(ts_ms AS BIGINT)) AS DATE)"
TODAY = dt.date(2024, 1, 31)


@query("SELECT id, name, mime_type, ts_ms, size FROM media WHERE (mime_type LIKE 'image/%' OR mime_type LIKE 'video/%') AND NOT is_trashed")
def scan_media(spark: SparkSession, d: str) -> DataFrame:
    """Images and videos outside the trash."""
    return C.scan(media(spark, d)).select("id", "name", "mime_type", "ts_ms", "size")


@query("""SELECT id, CASE WHEN id % 11 = 0 THEN '' ELSE name END AS name,
 CASE WHEN id % 13 <> 0 THEN mime_type WHEN mime_type LIKE 'video/%' THEN 'video/*' ELSE 'image/*' END AS mime_type,
 CASE WHEN id % 17 = 0 THEN date_modified * 1000 ELSE ts_ms END AS "timestamp" FROM media""")
def normalize_media(spark: SparkSession, d: str) -> DataFrame:
    """Rows with some names, types and times taken away, and filled again."""
    i = F.col("id")
    raw = media(spark, d).select(
        "id", F.when(i % 11 != 0, F.col("name")).alias("name"), F.when(i % 13 != 0, F.col("mime_type")).alias("mime_type"),
        F.when(i % 17 != 0, F.col("ts_ms")).otherwise(0).alias("taken_ms"), "date_modified", C.is_video().alias("video"),
    )
    return C.normalized(raw).select("id", "name", "mime_type", "timestamp")


@query("SELECT id, name, size FROM media WHERE id = 42")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One row by its key."""
    return media(spark, d).where("id = 42").select("id", "name", "size")


@query("""SELECT id, CASE WHEN id % 5 = 0 THEN 24.0 + id % 3 WHEN id % 3 <> 0 THEN (CASE WHEN duration_ms > 0 THEN id * 1000.0 / duration_ms ELSE 30.0 END) ELSE 30.0 END AS fps,
 CASE WHEN id % 4 = 0 THEN 1000 * id ELSE size * 8000 // greatest(1, duration_ms) END AS bitrate FROM media WHERE mime_type LIKE 'video/%'""")
def coalesce_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """Frame and bit rates of videos with their fallbacks."""
    i, ms = F.col("id"), F.col("duration_ms")
    capture, frames = F.when(i % 5 == 0, 24.0 + i % 3), F.when(i % 3 != 0, i)
    return media(spark, d).where(C.is_video()).select(
        "id",
        F.coalesce(capture, F.when(ms > 0, frames * F.lit(1000.0) / ms), F.lit(30.0)).alias("fps"),
        F.coalesce(F.when(i % 4 == 0, 1000 * i), F.expr("size * 8000 div greatest(1, duration_ms)")).alias("bitrate"),
    )


@query("SELECT id FROM media WHERE starts_with(mime_type, 'video/')")
def filter_type(spark: SparkSession, d: str) -> DataFrame:
    """Videos."""
    return media(spark, d).where(C.is_video()).select("id")


@query("SELECT id FROM media WHERE path ILIKE '%screenshot%' OR name ILIKE 'screenshot%'")
def filter_icase(spark: SparkSession, d: str) -> DataFrame:
    """Screenshots."""
    return media(spark, d).where(C.is_screenshot()).select("id")


@query("SELECT id, is_favorite FROM media WHERE bucket = 'src2'")
def filter_album(spark: SparkSession, d: str) -> DataFrame:
    """The items of one album."""
    return media(spark, d).where(F.col("bucket") == "src2").select("id", "is_favorite")


@query("SELECT bucket AS name, count(*) AS n FROM media WHERE lower(bucket) LIKE '%rc1%' GROUP BY bucket ORDER BY max(ts_ms) DESC, bucket LIMIT 3")
def album_name_search(spark: SparkSession, d: str) -> DataFrame:
    """The three newest albums whose name holds a text, in any case."""
    found = C.albums(media(spark, d)).where(F.lower("name").contains("RC1".lower()))
    return found.orderBy(F.desc("latest"), "name").limit(3).select("name", "n")


SETTINGS = {"long_edge": 1920, "short_edge": 1080, "quality": 80, "least_saving": 10}
_FITS = "least(1920.0 / greatest(width, height), 1080.0 / least(width, height)) >= 1"


@query(f"""SELECT id FROM media WHERE mime_type LIKE 'image/%' AND id % 6 <> 1 AND NOT is_favorite
 AND mime_type IN ('image/jpeg', 'image/png', 'image/webp', 'image/heic', 'image/heif', 'image/avif') AND NOT ({_FITS})""")
def optimize_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Images worth shrinking: not done, no favourites, a supported type, larger than the target."""
    m = media(spark, d)
    done = m.where("id % 6 = 1").select("id")
    kinds = ["image/jpeg", "image/png", "image/webp", "image/heic", "image/heif", "image/avif"]
    target = S.image_target(F.col("width"), F.col("height"), SETTINGS["long_edge"], SETTINGS["short_edge"])
    chosen = m.where(C.is_image() & ~F.col("is_favorite") & F.col("mime_type").isin(kinds) & target.isNotNull())
    return chosen.join(done, "id", "left_anti").select("id")


_VT = "CASE WHEN least(width, height) > 720 THEN CAST(floor(floor({x} * (720.0 / least(width, height)) + 0.5) / 2) AS INT) * 2 ELSE {x} END"
_EST = f"""(least(greatest(CAST(trunc(({_VT.format(x='width')})::BIGINT * ({_VT.format(x='height')}) * ((0.015::DOUBLE + 0.11::DOUBLE * 0.6::DOUBLE * 0.6::DOUBLE) * 0.6::DOUBLE * 30.0::DOUBLE)) AS BIGINT), 400000), 80000000) + 192000) * duration_ms // 8000"""


@query(f"SELECT id FROM media WHERE mime_type = 'video/mp4' AND duration_ms >= 1000 AND NOT is_favorite AND {_EST} < size * 90 // 100")
def video_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Videos of a second or more whose estimate saves a tenth."""
    kinds = ["video/mp4", "video/quicktime", "video/3gpp", "video/x-matroska", "video/webm"]
    estimate = S.video_estimate(F.col("width"), F.col("height"), F.col("duration_ms"), 720, 60, True)
    fine = F.col("mime_type").isin(kinds) & (F.col("duration_ms") >= 1000) & ~F.col("is_favorite")
    return media(spark, d).where(fine & (estimate < F.expr("size * 90 div 100"))).select("id")


@query("SELECT id, name FROM media WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_selection(spark: SparkSession, d: str) -> DataFrame:
    """Items of a selection of ids."""
    chosen = T.load(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return media(spark, d).join(chosen, "id", "left_semi").select("id", "name")


@query("""SELECT bucket, CASE WHEN trim(coalesce(bucket, '')) = '' THEN 'Unbenannt' ELSE bucket END AS name, first(path ORDER BY ts_ms DESC, id) AS path,
 first(id ORDER BY ts_ms DESC, id) AS cover_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS total_size, max(ts_ms) AS latest,
 CASE WHEN first(path ORDER BY ts_ms DESC, id) ILIKE '%camera%' THEN 3 WHEN first(path ORDER BY ts_ms DESC, id) ILIKE '%screenshots%' THEN 2 ELSE 0 END AS priority
 FROM media GROUP BY bucket""")
def albums(spark: SparkSession, d: str) -> DataFrame:
    """Albums, the camera's first, then the newest."""
    return C.albums(media(spark, d)).orderBy(F.desc("priority"), F.desc("latest"), "bucket")


@query("""SELECT count(*) FILTER (is_favorite) AS favourites, count(*) FILTER (mime_type LIKE 'video/%') AS videos,
 count(*) FILTER (path ILIKE '%screenshot%') AS screenshots FROM media""")
def count_if(spark: SparkSession, d: str) -> DataFrame:
    """Counts under conditions."""
    return media(spark, d).agg(
        F.count_if("is_favorite").alias("favourites"), F.count_if(C.is_video()).alias("videos"), F.count_if(C.is_screenshot()).alias("screenshots")
    )


@query("SELECT CAST(sum(size) FILTER (mime_type LIKE 'image/%') AS BIGINT) AS photo_bytes, CAST(sum(size) AS BIGINT) AS total_bytes FROM media")
def bytes_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of photos and of all."""
    return media(spark, d).agg(F.sum(F.when(C.is_image(), F.col("size"))).alias("photo_bytes"), F.sum("size").alias("total_bytes"))


_SCALE = "least(1920.0::DOUBLE / greatest(width, height), 1080.0::DOUBLE / least(width, height))"
_PIX = f"CASE WHEN {_SCALE} < 1 THEN greatest(floor(width * {_SCALE} + 0.5), 1) * greatest(floor(height * {_SCALE} + 0.5), 1) / (width::DOUBLE * height) ELSE 1.0 END"
_RATIO = f"least(greatest(({_PIX}) * ((0.25::DOUBLE + 0.75::DOUBLE * (0.8::DOUBLE * 0.8::DOUBLE * 0.8::DOUBLE)) * 1.4::DOUBLE), 0.03), 1.0)"


@query(f"""SELECT CAST(sum(CASE WHEN mime_type LIKE 'image/%' THEN CAST(round(size * (1 - {_RATIO})) AS BIGINT) END) AS BIGINT) AS photo_savings,
 CAST(sum(CASE WHEN mime_type LIKE 'video/%' THEN greatest(0, size - {_EST}) END) AS BIGINT) AS video_savings FROM media""")
def savings_potential(spark: SparkSession, d: str) -> DataFrame:
    """What shrinking all photos and videos would save."""
    w, h = F.col("width"), F.col("height")
    ratio = S.heuristic_ratio(w, h, S.image_target(w, h, 1920, 1080), 80)
    photo = F.when(C.is_image(), F.round(F.col("size") * (1 - ratio), 0).cast("long"))
    video = F.when(C.is_video(), F.greatest(F.lit(0), F.col("size") - S.video_estimate(w, h, F.col("duration_ms"), 720, 60, True)))
    return media(spark, d).agg(F.sum(photo).alias("photo_savings"), F.sum(video).alias("video_savings"))


@query("SELECT count(*) FILTER (mime_type LIKE 'image/%') * 220 // 1000 AS seconds FROM media")
def index_eta(spark: SparkSession, d: str) -> DataFrame:
    """Seconds to index all photos at 220 ms each."""
    return media(spark, d).agg((F.count_if(C.is_image()) * 220).alias("ms")).select(S.div(F.col("ms"), 1000).alias("seconds"))


@query(f"SELECT {DAY} AS key, count(*) AS n, first(id ORDER BY ts_ms DESC, id) AS first_id FROM media GROUP BY 1")
def timeline_day(spark: SparkSession, d: str) -> DataFrame:
    """The timeline's day headers."""
    return C.timeline(media(spark, d), "day")


@query(f"SELECT CAST(date_trunc('month', {DAY}) AS DATE) AS key, count(*) AS n, first(id ORDER BY ts_ms DESC, id) AS first_id FROM media GROUP BY 1")
def timeline_month(spark: SparkSession, d: str) -> DataFrame:
    """The timeline's month headers."""
    return C.timeline(media(spark, d), "month")


@query("SELECT id, row_number() OVER (ORDER BY ts_ms DESC, id) - 1 AS pos FROM media")
def list_position(spark: SparkSession, d: str) -> DataFrame:
    """Every item's place in the newest-first list."""
    return C.positions(media(spark, d).select("id", "ts_ms")).select("id", "pos")


@query("WITH l AS (SELECT id, row_number() OVER (ORDER BY ts_ms DESC, id) - 1 AS pos FROM media) SELECT id FROM l WHERE pos BETWEEN 20 AND 75")
def range_select(spark: SparkSession, d: str) -> DataFrame:
    """Items between two places of the list, either first."""
    a, b = 75, 20
    return C.positions(media(spark, d).select("id", "ts_ms")).where(F.col("pos").between(min(a, b), max(a, b))).select("id")


_GERMAN_MONTH = "list_extract(['" + "','".join(S.MONTHS) + "'], CAST(month({x}) AS INT)) || ' ' || year({x})"


@query(f"""WITH m AS (SELECT id, ts_ms, CAST(date_trunc('month', {DAY}) AS DATE) AS key FROM media),
 e AS (SELECT key, id, ts_ms FROM m UNION ALL SELECT DISTINCT key, NULL, NULL FROM m),
 n AS (SELECT *, row_number() OVER (ORDER BY key DESC, id IS NOT NULL, ts_ms DESC, id) - 1 AS entry FROM e),
 f AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS f), t AS (SELECT f, CAST(floor((SELECT count(*) - 1 FROM n) * f + 0.5) AS BIGINT) AS target FROM f),
 h AS (SELECT f, target, (SELECT min(entry) FROM n WHERE entry >= target AND id IS NOT NULL) AS entry FROM t)
 SELECT CAST(f AS DOUBLE) AS f, target, {_GERMAN_MONTH.format(x='n.key')} AS label FROM h JOIN n USING (entry)""")
def scroll_label(spark: SparkSession, d: str) -> DataFrame:
    """The fast scroller's month at five fractions of the list with its headers."""
    rows = C.with_headers(media(spark, d))
    last = rows.agg(F.max("entry")).first()[0]
    targets = [(f, int(last * f + 0.5)) for f in (0.0, 0.25, 0.5, 0.75, 1.0)]
    wanted = spark.createDataFrame(targets, "f double, target long")
    # a header's next entry is an item
    near = rows.where("id IS NOT NULL").select("entry", "key").join(F.broadcast(wanted), F.col("entry").isin(F.col("target"), F.col("target") + 1))
    found = near.groupBy("f", "target").agg(F.min_by("key", "entry").alias("key"))
    return found.select("f", "target", S.month_header(F.col("key")).alias("label"))


@query("SELECT id, ts_ms FROM media")
def sort_newest(spark: SparkSession, d: str) -> DataFrame:
    """All items, newest first."""
    return media(spark, d).orderBy(F.desc("ts_ms"), "id").select("id", "ts_ms")


@query("SELECT id, size FROM media ORDER BY size DESC, id LIMIT 300")
def top_large(spark: SparkSession, d: str) -> DataFrame:
    """The 300 largest items."""
    return media(spark, d).orderBy(F.desc("size"), "id").limit(300).select("id", "size")


@query("WITH h AS (SELECT id, size FROM media ORDER BY ts_ms DESC, id LIMIT 200) SELECT id, size FROM h ORDER BY size DESC, id LIMIT 1")
def head_then_max(spark: SparkSession, d: str) -> DataFrame:
    """The largest of the 200 newest items."""
    head = media(spark, d).orderBy(F.desc("ts_ms"), "id").limit(200)
    return head.orderBy(F.desc("size"), "id").limit(1).select("id", "size")


@query("SELECT bucket, id, rk FROM (SELECT bucket, id, CAST(row_number() OVER (PARTITION BY bucket ORDER BY size DESC, id) AS INT) AS rk FROM media) WHERE rk <= 4")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    """Each album's four largest items."""
    rk = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("size"), "id"))
    return media(spark, d).withColumn("rk", rk).where("rk <= 4").select("bucket", "id", "rk")


@query("SELECT id FROM media ORDER BY id LIMIT 50 OFFSET 100")
def page_offset(spark: SparkSession, d: str) -> DataFrame:
    """The third page of fifty."""
    return media(spark, d).orderBy("id").offset(100).limit(50).select("id")


@query("SELECT id, (row_number() OVER (ORDER BY id) - 1) // 500 AS chunk FROM media")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids in chunks of 500."""
    return numbered(media(spark, d).select("id"), F.col("id")).select("id", S.div(F.col("pos"), 500).alias("chunk"))


@query(f"SELECT id, {DAY} AS day, year({DAY}) AS y, month({DAY}) AS m, day({DAY}) AS dom, isodow({DAY}) AS dow FROM media")
def date_parts(spark: SparkSession, d: str) -> DataFrame:
    """Dates and their parts."""
    day = S.local_date(F.col("ts_ms"))
    parts = {"y": F.year(day), "m": F.month(day), "dom": F.dayofmonth(day), "dow": F.weekday(day) + 1}
    return media(spark, d).select("id", day.alias("day"), *(c.cast("long").alias(n) for n, c in parts.items()))


def _duck_list(names: tuple[str, ...]) -> str:
    return "['" + "','".join(names) + "']"


@query(f"""WITH t AS (SELECT id, {DAY} AS x FROM media),
 u AS (SELECT id, x, date_diff('day', x, DATE '2024-01-31') AS ago, list_extract({_duck_list(S.SHORT_DAYS)}, CAST(isodow(x) AS INT)) || ', ' || day(x) || '. ' || list_extract({_duck_list(S.MONTHS)}, CAST(month(x) AS INT)) AS base FROM t)
 SELECT id, CASE WHEN ago = 0 THEN 'Heute' WHEN ago = 1 THEN 'Gestern' WHEN ago BETWEEN 2 AND 6 THEN list_extract({_duck_list(S.DAYS)}, CAST(isodow(x) AS INT))
 WHEN year(x) = 2024 THEN base ELSE base || ' ' || year(x) END AS label FROM u""")
def day_header(spark: SparkSession, d: str) -> DataFrame:
    """Day labels as seen on 31 January 2024."""
    return media(spark, d).select("id", S.day_header(S.local_date(F.col("ts_ms")), TODAY).alias("label"))


@query(f"""WITH t AS (SELECT id, {DAY} AS x FROM media)
 SELECT id, {_GERMAN_MONTH.format(x='x')} AS label, day(x) || '. ' || list_extract({_duck_list(S.SHORT_MONTHS)}, CAST(month(x) AS INT)) || ' ' || year(x) AS short FROM t""")
def month_header(spark: SparkSession, d: str) -> DataFrame:
    """Month labels and short dates."""
    day = S.local_date(F.col("ts_ms"))
    return media(spark, d).select("id", S.month_header(day).alias("label"), S.short_date(day).alias("short"))


@query("""WITH t AS (SELECT id, size * CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 7 ELSE 0 END + id % 900 AS n FROM media),
 u AS (SELECT *, CAST(round_even(n / 100000000.0::DOUBLE, 0) AS BIGINT) AS tenths FROM t)
 SELECT id, n, CASE WHEN n >= 1000000000 THEN (tenths // 10) || ',' || (tenths % 10) || ' GB' WHEN n >= 1000000 THEN CAST(round_even(n / 1000000.0::DOUBLE, 0) AS BIGINT) || ' MB'
 WHEN n >= 1000 THEN CAST(round_even(n / 1000.0::DOUBLE, 0) AS BIGINT) || ' KB' ELSE n || ' B' END AS label FROM u""")
def fmt_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes as text."""
    i = F.col("id")
    n = F.col("size") * F.when(i % 4 == 0, 1).when(i % 4 == 1, 1000).when(i % 4 == 2, 7).otherwise(0) + i % 900
    return media(spark, d).select("id", n.alias("n")).select("id", "n", S.fmt_bytes(F.col("n")).alias("label"))


@query("""WITH t AS (SELECT id, duration_ms * 137 + id * 911 AS ms FROM media), u AS (SELECT id, ms, ms // 1000 AS s FROM t)
 SELECT id, ms, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST((s % 3600) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0')
 ELSE ((s % 3600) // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS duration,
 CASE WHEN s < 60 THEN '< 1 Min.' WHEN s < 3600 THEN (s // 60) || ' Min.' WHEN s < 86400 THEN (s // 3600) || ' Std. ' || ((s % 3600) // 60) || ' Min.' ELSE (s // 86400) || ' Tg. ' || ((s % 86400) // 3600) || ' Std.' END AS eta,
 CASE WHEN s < 60 THEN s || ' s' WHEN s < 3600 THEN (s // 60) || ' min' ELSE (s // 3600) || ' h ' || ((s % 3600) // 60) || ' min' END AS worker,
 replace(format('{:,}', ms), ',', '.') AS grouped, CAST(trunc((id % 100) / 128.0::DOUBLE * 100) AS INT) || ' %' AS share FROM u""")
def fmt_duration(spark: SparkSession, d: str) -> DataFrame:
    """Durations, times left, counts and shares as text."""
    t = media(spark, d).select("id", (F.col("duration_ms") * 137 + F.col("id") * 911).alias("ms")).withColumn("s", S.div(F.col("ms"), 1000))
    return t.select(
        "id", "ms", S.fmt_duration(F.col("ms")).alias("duration"), S.fmt_eta(F.col("s")).alias("eta"), S.fmt_worker(F.col("s")).alias("worker"),
        S.fmt_count(F.col("ms")).alias("grouped"), S.fmt_percent((F.col("id") % 100) / F.lit(128.0)).alias("share"),
    )


@query("""SELECT id, trim(path, '/') AS trimmed, split_part(path, '/', 1) AS head, split_part(trim(path, '/'), '/', -1) AS leaf, lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS ext FROM media""")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of paths and names."""
    trimmed = F.regexp_replace("path", "^/+|/+$", "")
    return media(spark, d).select(
        "id", trimmed.alias("trimmed"), F.substring_index("path", "/", 1).alias("head"), F.substring_index(trimmed, "/", -1).alias("leaf"), S.extension(F.col("name")).alias("ext")
    )


_EXT = ("'.jpg'", "'.HEIC'", "'.mov'", "'.txt'", "''", "'.avif'")
_CASE = "CASE id % 6 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(_EXT)) + " END"


@query(f"""WITH t AS (SELECT id, 'IMG_' || id || {_CASE} AS name FROM media)
 SELECT id, name, CASE lower(regexp_extract(name, '\\.([^.]*)$', 1)) WHEN 'jpg' THEN 'image/jpeg' WHEN 'heic' THEN 'image/heif' WHEN 'mov' THEN 'video/quicktime' WHEN 'avif' THEN 'image/avif' END AS mime FROM t""")
def mime_map(spark: SparkSession, d: str) -> DataFrame:
    """Types by extension."""
    name = F.concat(F.lit("IMG_"), F.col("id").cast("string"), F.expr(_CASE))
    return media(spark, d).select("id", name.alias("name")).select("id", "name", S.mime_of(F.col("name")).alias("mime"))


@query("""WITH t AS (SELECT id, CASE id % 5 WHEN 0 THEN 'dcim/Camera' WHEN 1 THEN 'Movies/Trip' WHEN 2 THEN 'Download' WHEN 3 THEN '' ELSE 'Pictures/A' END AS p, id % 2 = 0 AS video FROM media)
 SELECT id, CASE WHEN p ILIKE 'dcim%' OR p ILIKE 'pictures%' OR (video AND p ILIKE 'movies%') THEN p ELSE 'Pictures/Wiederhergestellt/' || CASE WHEN p = '' THEN 'Backup' ELSE p END END || '/' AS target FROM t""")
def restore_path(spark: SparkSession, d: str) -> DataFrame:
    """Where files of a backup go back to."""
    i = F.col("id") % 5
    p = F.when(i == 0, "dcim/Camera").when(i == 1, "Movies/Trip").when(i == 2, "Download").when(i == 3, "").otherwise("Pictures/A")
    return media(spark, d).select("id", S.restore_path(p, F.col("id") % 2 == 0).alias("target"))


@query("""WITH t AS (SELECT id, CASE WHEN orientation IN (90, 270) THEN height ELSE width END AS w, CASE WHEN orientation IN (90, 270) THEN width ELSE height END AS h FROM media)
 SELECT id, w, h, round(w / h::DOUBLE, 6) AS aspect, round(w::BIGINT * h / 1000000.0::DOUBLE, 6) AS megapixels FROM t""")
def display_dims(spark: SparkSession, d: str) -> DataFrame:
    """Sizes as displayed."""
    turned = F.col("orientation").isin(90, 270)
    t = media(spark, d).select("id", F.when(turned, F.col("height")).otherwise(F.col("width")).alias("w"), F.when(turned, F.col("width")).otherwise(F.col("height")).alias("h"))
    return t.select("id", "w", "h", F.round(F.col("w") / F.col("h"), 6).alias("aspect"), F.round(F.col("w").cast("long") * F.col("h") / 1e6, 6).alias("megapixels"))


@query(f"""SELECT id, CASE WHEN {_SCALE} < 1 THEN CAST(greatest(floor(width * {_SCALE} + 0.5), 1) AS INT) END AS w, CASE WHEN {_SCALE} < 1 THEN CAST(greatest(floor(height * {_SCALE} + 0.5), 1) AS INT) END AS h FROM media""")
def target_size(spark: SparkSession, d: str) -> DataFrame:
    """Sizes that images shrink to."""
    t = S.image_target(F.col("width"), F.col("height"), 1920, 1080)
    return media(spark, d).select("id", t.alias("t")).select("id", "t.w", "t.h")


@query(f"SELECT id, {_VT.format(x='width')} AS w, {_VT.format(x='height')} AS h FROM media")
def video_target(spark: SparkSession, d: str) -> DataFrame:
    """Sizes that videos shrink to."""
    return media(spark, d).select("id", S.video_target(F.col("width"), F.col("height"), 720).alias("t")).select("id", "t.w", "t.h")


@query(f"SELECT id, {_EST} AS estimate FROM media WHERE mime_type LIKE 'video/%'")
def video_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Bytes that videos shrink to."""
    return media(spark, d).where(C.is_video()).select("id", S.video_estimate(F.col("width"), F.col("height"), F.col("duration_ms"), 720, 60, True).alias("estimate"))


@query(f"""WITH c AS (SELECT id, size, {_RATIO} AS ratio, row_number() OVER (ORDER BY ts_ms DESC, id) - 1 AS pos, count(*) OVER () AS n FROM media WHERE mime_type LIKE 'image/%'),
 p AS (SELECT * FROM c WHERE n <= 8 OR pos IN (SELECT (i * n) // 8 + (n // 8) // 2 FROM range(8) r(i)))
 SELECT (SELECT count(*) FROM p) AS samples, CAST((SELECT sum(size) FROM c) AS BIGINT) AS total,
 round(sum(least(round(size * ratio), size))::DOUBLE / sum(size), 6) AS ratio FROM p""")
def sample_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Savings extrapolated from eight evenly spread photos; the guess stands in for the encoder."""
    w, h = F.col("width"), F.col("height")
    photos = media(spark, d).where(C.is_image()).withColumn("ratio", S.heuristic_ratio(w, h, S.image_target(w, h, 1920, 1080), 80)).select("id", "ts_ms", "size", "ratio")
    picks = C.systematic_sample(photos, 8)
    total = photos.agg(F.sum("size")).first()[0]
    new = F.least(F.round(F.col("size") * F.col("ratio"), 0), F.col("size").cast("double"))
    return picks.agg(F.count("*").alias("samples"), F.lit(total).cast("long").alias("total"), F.round(F.sum(new) / F.sum("size"), 6).alias("ratio"))


@query("WITH l AS (SELECT unnest([42, 7, 999999, 3, 42, 11]) AS id, generate_subscripts([42, 7, 999999, 3, 42, 11], 1) - 1 AS pos) SELECT CAST(pos AS INT) AS pos, id, name FROM l JOIN media USING (id)")
def join_ordered_list(spark: SparkSession, d: str) -> DataFrame:
    """A list of ids with their rows, in the list's order; misses drop out."""
    ids = spark.createDataFrame([([42, 7, 999999, 3, 42, 11],)], "ids array<bigint>").select(F.posexplode("ids").alias("pos", "id"))
    return media(spark, d).join(F.broadcast(ids), "id").select("pos", "id", "name").orderBy("pos")


@query("SELECT id FROM media WHERE is_favorite OR mime_type LIKE 'video/%' EXCEPT SELECT id FROM media WHERE id % 10 = 0")
def set_minus(spark: SparkSession, d: str) -> DataFrame:
    """A selection widened and narrowed again."""
    m = media(spark, d)
    both = m.where("is_favorite").select("id").union(m.where(C.is_video()).select("id")).distinct()
    return both.subtract(m.where("id % 10 = 0").select("id"))


_DIFF = """SELECT coalesce(m.id, k.media_id) AS key, CASE WHEN m.id IS NULL THEN 'gone' WHEN k.media_id IS NULL THEN 'new' WHEN k.date_modified = -1 THEN 'accept'
 WHEN k.date_modified <> m.date_modified THEN 'changed' ELSE 'same' END AS status, coalesce(m.date_modified, k.date_modified) AS date_modified
 FROM media m FULL JOIN known_keys k ON k.media_id = m.id"""


@query(_DIFF, "media", "known_keys")
def index_diff(spark: SparkSession, d: str) -> DataFrame:
    """What an index has to do for each key."""
    return M.index_diff(media(spark, d), T.known_keys(spark, d))


@query(_DIFF.replace("FROM media m", "FROM (SELECT * FROM media WHERE mime_type LIKE 'image/%') m"), "media", "known_keys")
def index_settings(spark: SparkSession, d: str) -> DataFrame:
    """What an index has to do once videos are switched off: their keys are gone, too."""
    return M.index_diff(media(spark, d).where(C.is_image()), T.known_keys(spark, d))


@query(f"WITH x AS ({_DIFF}) SELECT key AS media_id, date_modified, 0 AS vector_bytes FROM x WHERE status IN ('new', 'changed') AND key % 4 = 1", "media", "known_keys")
def tombstones(spark: SparkSession, d: str) -> DataFrame:
    """Empty vectors for files that fail, so that they are not tried again."""
    todo = M.index_diff(media(spark, d), T.known_keys(spark, d)).where("status IN ('new', 'changed') AND key % 4 = 1")
    return todo.select(F.col("key").alias("media_id"), "date_modified", F.length(F.lit(bytearray(b""))).alias("vector_bytes"))


@query("SELECT media_id, date_modified FROM known_keys WHERE media_id IN (SELECT id FROM media)", "media", "known_keys")
def delete_by_keys(spark: SparkSession, d: str) -> DataFrame:
    """Stored keys without those of files that are gone."""
    known = T.known_keys(spark, d)
    gone = known.join(media(spark, d).select(F.col("id").alias("media_id")), "media_id", "left_anti")
    return M.delete_keys(known, gone, ["media_id"])


@query("SELECT media_id, date_modified FROM known_keys WHERE date_modified <> -1", "media", "known_keys")
def delete_by_pred(spark: SparkSession, d: str) -> DataFrame:
    """Stored keys without the replaced ones."""
    return T.known_keys(spark, d).where(~(F.col("date_modified") == -1))


@query("""SELECT media_id, date_modified FROM known_keys WHERE media_id NOT IN (SELECT id FROM media WHERE id % 3 = 0)
 UNION ALL SELECT id, date_modified + 5 FROM media WHERE id % 3 = 0""", "media", "known_keys")  # fmt: skip
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Stored keys with a batch of new ones merged in."""
    new = media(spark, d).where("id % 3 = 0").select(F.col("id").alias("media_id"), (F.col("date_modified") + 5).alias("date_modified"))
    return M.upsert(T.known_keys(spark, d), new, ["media_id"])


@query("""SELECT id, CASE WHEN b.size IS NULL THEN 'missing' ELSE 'changed' END AS status FROM media m LEFT JOIN backup_files b ON trim(m.path, '/') = b.path AND m.name = b.name
 WHERE b.size IS NULL OR b.size <> m.size""", "media", "backup_files")  # fmt: skip
def backup_diff(spark: SparkSession, d: str) -> DataFrame:
    """Files to copy into a backup."""
    return M.backup_diff(media(spark, d), T.backup_files(spark, d))


@query("SELECT path, name, size FROM backup_files b WHERE NOT EXISTS (SELECT 1 FROM media m WHERE lower(trim(m.path, '/')) = lower(b.path) AND m.name = b.name AND m.size = b.size)", "media", "backup_files")
def restore_missing(spark: SparkSession, d: str) -> DataFrame:
    """Files to copy back from a backup."""
    return M.restore_missing(T.backup_files(spark, d), media(spark, d))


@query("""WITH i AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d FROM orders), s AS (SELECT id, d, 1998 - year(d) AS ago FROM i WHERE year(d) < 1998)
 SELECT id, CAST(ago AS INT) AS years_ago FROM s WHERE abs(date_diff('day', CAST(d + to_years(CAST(ago AS INT)) AS DATE), DATE '1998-06-15')) <= 3""", "")  # fmt: skip
def memories(spark: SparkSession, d: str) -> DataFrame:
    """Orders of earlier years around 15 June."""
    items = T.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"))
    return C.memories(items, dt.date(1998, 6, 15))


@query("SELECT o_custkey AS custkey, bool_and(o_orderstatus = 'F') AS every_f, bool_or(o_orderstatus = 'F') AS any_f, NOT bool_or(o_totalprice > 400000) AS none_large FROM orders GROUP BY 1", "")
def every_group(spark: SparkSession, d: str) -> DataFrame:
    """All, any and none over groups."""
    f = F.col("o_orderstatus") == "F"
    return T.load(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.every(f).alias("every_f"), F.some(f).alias("any_f"), (~F.some(F.col("o_totalprice") > 400000)).alias("none_large"))


_OLD = "CAST(round(o_totalprice) AS BIGINT)"
_NEW = f"{_OLD} * (60 + o_orderkey % 50) // 100"


@query(f"SELECT o_orderkey AS id, CASE WHEN {_NEW} >= {_OLD} * 90 // 100 THEN 'skipped' ELSE 'done' END AS outcome FROM orders", "")
def outcome_class(spark: SparkSession, d: str) -> DataFrame:
    """Whether a compression saved enough."""
    old = F.round("o_totalprice", 0).cast("long")
    t = T.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), old.alias("old")).withColumn("new", S.div(F.col("old") * (60 + F.col("id") % 50), 100))
    return t.select("id", F.when(F.col("new") >= S.div(F.col("old") * 90, 100), "skipped").otherwise("done").alias("outcome"))


@query(f"SELECT count(*) AS n, CAST(sum({_OLD} - CASE WHEN {_NEW} >= {_OLD} * 90 // 100 THEN {_OLD} ELSE {_NEW} END) AS BIGINT) AS saved FROM orders", "")
def optimized_totals(spark: SparkSession, d: str) -> DataFrame:
    """Count and bytes saved; skipped rows count and save nothing."""
    old = F.round("o_totalprice", 0).cast("long")
    t = T.load(spark, d, "orders").select("o_orderkey", old.alias("old")).withColumn("new", S.div(F.col("old") * (60 + F.col("o_orderkey") % 50), 100))
    new = F.when(F.col("new") >= S.div(F.col("old") * 90, 100), F.col("old")).otherwise(F.col("new"))
    return t.agg(F.count("*").alias("n"), F.sum(F.col("old") - new).alias("saved"))


@query("""WITH g AS (SELECT n_chars AS size, sha256(substr(text, 1, 4194304)) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1, 2)
 SELECT size, hash, n, first_id, size * (n - 1) AS reclaimable FROM g WHERE n > 1""", "")  # fmt: skip
def exact_dups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of equal documents, by size, then by hash."""
    files = T.load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"), F.col("text").alias("content"))
    return C.exact_duplicates(files).select("size", "hash", "n", "first_id", "reclaimable")


@query("SELECT pos, bucket AS key FROM (SELECT row_number() OVER (ORDER BY size DESC, id) - 1 AS pos, bucket, lag(bucket) OVER (ORDER BY size DESC, id) AS before FROM media) WHERE pos = 0 OR bucket IS DISTINCT FROM before")
def headers_unsorted(spark: SparkSession, d: str) -> DataFrame:
    """Headers by album of the list by size, where an album's header repeats."""
    return C.headers(media(spark, d), F.col("bucket"), F.desc("size"), F.col("id"))


@query("SELECT id FROM media WHERE NOT (contains(lower(path), 'screenshot') OR starts_with(lower(name), 'screenshot'))")
def timeline_setting(spark: SparkSession, d: str) -> DataFrame:
    """The timeline's items without screenshots."""
    return C.timeline_items(media(spark, d), screenshots=False).select("id")


@query("SELECT path, sum(size)::BIGINT AS bytes, count(*) AS files FROM media GROUP BY 1")
def bytes_by_folder(spark: SparkSession, d: str) -> DataFrame:
    """What each folder takes on disk."""
    return media(spark, d).groupBy("path").agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))


@query("SELECT DISTINCT lower(trim('  ' || name || ' ')) AS key FROM media")
def query_keys(spark: SparkSession, d: str) -> DataFrame:
    """Cache keys of what was typed."""
    typed = media(spark, d).select(F.concat(F.lit("  "), "name", F.lit(" ")).alias("typed"))
    return typed.select(F.lower(F.trim("typed")).alias("key")).distinct()


@query("""SELECT id, size FROM media WHERE id % 5 <> 0 AND id % 7 <> 0 UNION ALL SELECT id, size + 1 FROM media WHERE id % 5 = 0 AND id % 35 <> 0 AND id % 4 <> 0
 UNION ALL SELECT id, size FROM media WHERE id % 7 = 0 AND id % 5 <> 0 UNION ALL SELECT id, size + 2 FROM media WHERE id % 35 = 0 AND id % 4 <> 0""")
def index_put_remove(spark: SparkSession, d: str) -> DataFrame:
    """An index after puts and removals, some of the same keys."""
    m, i = media(spark, d).select("id", "size"), F.col("id")
    first = m.where(i % 5 == 0).select("id", (F.col("size") + 1).alias("size"), F.lit(1).alias("seq"), F.lit("put").alias("op"))
    again = m.where(i % 35 == 0).select("id", (F.col("size") + 2).alias("size"), F.lit(2).alias("seq"), F.lit("put").alias("op"))
    gone = m.where(i % 20 == 0).select("id", "size", F.lit(3).alias("seq"), F.lit("remove").alias("op"))
    return M.apply_changes(m, first.unionByName(again).unionByName(gone))


@query("SELECT id, is_trashed OR id % 6 = 1 AS is_trashed, is_favorite AND id % 6 <> 1 AS is_favorite FROM media")
def trash_items(spark: SparkSession, d: str) -> DataFrame:
    """The table after a request to trash every sixth item."""
    m = media(spark, d).select("id", "is_trashed", "is_favorite")
    asked = m.where(F.col("id") % 6 == 1).select("id")
    return M.set_for_keys(m, asked, "id", is_trashed=F.lit(True), is_favorite=F.lit(False)).select("id", "is_trashed", "is_favorite")


@query("SELECT id, name FROM media m WHERE EXISTS (SELECT 1 FROM backup_files b WHERE lower(b.name) = lower(m.name) AND b.name NOT LIKE 'OLD%')", "media", "backup_files")
def import_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Items that a picked file of the same name brings, whatever the case."""
    picked = T.backup_files(spark, d).where(~F.col("name").startswith("OLD")).select(F.lower("name").alias("low"))
    return media(spark, d).withColumn("low", F.lower("name")).join(picked, "low", "left_semi").select("id", "name")


@query("""WITH l AS (SELECT user_id, event_id, ts, CAST(round(value * 100) AS BIGINT) AS ms, CASE WHEN event_type IN ('view', 'purchase') THEN 'done' WHEN event_type = 'click' THEN 'failed' ELSE 'skipped' END AS outcome FROM events)
 SELECT event_id, count(*) FILTER (outcome = 'done') OVER w AS done, count(*) FILTER (outcome = 'failed') OVER w AS failed, count(*) FILTER (outcome = 'skipped') OVER w AS skipped,
 CAST(floor(avg(ms) OVER w) AS BIGINT) AS ms_mean, CAST(floor(avg(ms) OVER w * (count(*) OVER (PARTITION BY user_id) - count(*) OVER w)) AS BIGINT) AS ms_left
 FROM l WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", "")  # fmt: skip
def job_progress(spark: SparkSession, d: str) -> DataFrame:
    """Running progress of every user's job."""
    kind = F.col("event_type")
    log = T.load(spark, d, "events").withColumn("outcome", F.when(kind.isin("view", "purchase"), "done").when(kind == "click", "failed").otherwise("skipped"))
    log = log.withColumn("ms", F.round(F.col("value") * 100).cast("long"))
    out = M.progress(log, "user_id", ["ts", "event_id"], "outcome", "ms")
    return out.select("event_id", "done", "failed", "skipped", F.floor("ms_mean").alias("ms_mean"), F.floor("ms_left").alias("ms_left"))
