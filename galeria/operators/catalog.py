"""Catalogue operators: scans, albums, timelines, memories, lists, duplicates of files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeria.functions.scalars import local_date
from galeria.operators.running import Running, prefix_scan
from galeria.plans.numbering import numbered

NEWEST = ("ts_ms", "id")


def is_video() -> Column:
    """Whether the type is a video's."""
    return F.col("mime_type").startswith("video/")


def is_image() -> Column:
    """Whether the type is an image's."""
    return F.col("mime_type").startswith("image/")


def is_screenshot() -> Column:
    """Whether path or name say screenshot, in any case."""
    return F.lower("path").contains("screenshot") | F.lower("name").startswith("screenshot")


def scan(media: DataFrame, trashed: bool = False) -> DataFrame:
    """Images and videos, outside the trash or only in it."""
    kept = F.col("is_trashed") if trashed else ~F.col("is_trashed")
    return media.where((is_image() | is_video()) & kept)


def normalized(raw: DataFrame) -> DataFrame:
    """Names, types and timestamps without nulls: ``name``, ``mime_type``, ``taken_ms``, ``date_modified``, ``video``."""
    return raw.withColumns({
        "name": F.coalesce("name", F.lit("")),
        "mime_type": F.coalesce("mime_type", F.when(F.col("video"), "video/*").otherwise("image/*")),
        "timestamp": F.when(F.col("taken_ms") > 0, F.col("taken_ms")).otherwise(F.col("date_modified") * 1000),
    })


def albums(media: DataFrame) -> DataFrame:
    """One row per bucket with its newest item as cover, count, bytes and priority."""
    newest = F.max_by(F.struct("id", "name", "path", "ts_ms"), F.struct(F.col("ts_ms"), -F.col("id")))
    out = media.groupBy("bucket").agg(newest.alias("cover"), F.count("*").alias("n"), F.sum("size").alias("total_size"))
    name = F.when(F.coalesce(F.trim("bucket"), F.lit("")) == "", "Unbenannt").otherwise(F.col("bucket"))
    path = F.lower("cover.path")
    priority = F.when(path.contains("camera"), 3).when(path.contains("screenshots"), 2).otherwise(0)
    return out.select(
        "bucket", name.alias("name"), F.col("cover.path").alias("path"), F.col("cover.id").alias("cover_id"), "n", "total_size",
        F.col("cover.ts_ms").alias("latest"), priority.cast("int").alias("priority"),
    )


def timeline(media: DataFrame, unit: str) -> DataFrame:
    """Headers of the newest-first list by day or month: runs of one key are one group, as the list is sorted."""
    key = F.trunc(local_date(F.col("ts_ms")), "month") if unit == "month" else local_date(F.col("ts_ms"))
    return media.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.max_by("id", F.struct(F.col("ts_ms"), -F.col("id"))).alias("first_id"))


def memories(items: DataFrame, today: dt.date, days: int = 3) -> DataFrame:
    """Items (``id``, ``date``) of earlier years within ``days`` of today's day of the year; 29 February counts as 28."""
    years = F.lit(today.year) - F.year("date")
    same = F.add_months("date", 12 * years)
    near = items.withColumn("years_ago", years).where((years > 0) & (F.abs(F.datediff(same, F.lit(today))) <= days))
    return near.select("id", "years_ago")


def positions(media: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """The list's positions from 0, newest first unless another order is given."""
    return numbered(media, *(order or (F.desc("ts_ms"), F.col("id"))), name=name)


def systematic_sample(items: DataFrame, samples: int, *order: Column) -> DataFrame:
    """``samples`` evenly spread rows of the ordered list, with their position; all if there are no more."""
    n = items.count()
    if n <= samples:
        return positions(items, *order)
    picks = [(i * n) // samples + (n // samples) // 2 for i in range(samples)]
    return positions(items, *order).where(F.col("pos").isin(picks))


def best_first(items: DataFrame, group: str) -> DataFrame:
    """Rank in the group: favourites, then pixels, bytes and age; all but the first are preselected for deletion.

    Ranks are a prefix scan over range partitions, so a large group is spread over them; it
    writes all columns of ``items`` once.
    """
    order = (F.desc("is_favorite"), F.desc(F.col("width").cast("long") * F.col("height")), F.desc("size"), F.asc("ts_ms"), F.asc("id"))
    ranked = prefix_scan(items, [group], list(order), Running(number="rank")).withColumn("rank", F.col("rank").cast("int"))
    return ranked.withColumn("preselected", F.col("rank") > 1)


def exact_duplicates(files: DataFrame, content: str = "content", size: str = "size", prefix: int = 4 << 20) -> DataFrame:
    """Groups of equal files, with what deleting copies frees; ``hash``: SHA-256 of the first ``prefix`` bytes.

    Sizes are counted first, without contents: only files that share their size are hashed,
    those longer than ``prefix`` also as a whole.
    """
    shared = files.groupBy(size).agg(F.count("*").alias("c")).where("c > 1").select(size)
    data = F.col(content).cast("binary")
    hashed = files.join(shared, size, "left_semi").withColumn("hash", F.sha2(F.substring(data, 1, prefix), 256))
    hashed = hashed.withColumn("whole", F.when(F.octet_length(data) > prefix, F.sha2(data, 256)))
    groups = hashed.groupBy(size, "hash", "whole").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).drop("whole")
    return groups.where("n > 1").withColumn("reclaimable", F.col(size) * (F.col("n") - 1))


def with_headers(media: DataFrame) -> DataFrame:
    """The list with a header row before each month: ``entry`` from 0, ``id`` null for headers, ``key`` the month."""
    rows = media.select("id", "ts_ms", F.trunc(local_date(F.col("ts_ms")), "month").alias("key"))
    heads = rows.select("key").distinct().select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("ts_ms"), "key")
    return numbered(rows.unionByName(heads), F.desc("key"), F.col("id").isNotNull(), F.desc("ts_ms"), F.col("id"), name="entry")


def interleave(a: DataFrame, b: DataFrame, a_order: list[Column], b_order: list[Column], first: int | None = None) -> DataFrame:
    """a1, b1, a2, b2 ... of two ordered frames with the same columns: sort by ``turn`` (from 1), ``own`` first.

    With ``first``, only so many of each are taken, and ranked without sorting the others.
    """

    def ranked(df: DataFrame, order: list[Column], own: bool) -> DataFrame:
        if first is None:
            out = numbered(df, *order, name="turn").withColumn("turn", F.col("turn") + 1)
        else:  # a window over ``first`` rows
            out = df.orderBy(*order).limit(first).withColumn("turn", F.row_number().over(Window.orderBy(*order)).cast("long"))
        return out.withColumn("own", F.lit(own))

    return ranked(a, a_order, True).unionByName(ranked(b, b_order, False))


def headers(items: DataFrame, key: Column, *order: Column) -> DataFrame:
    """``pos, key`` of the headers that a list in any order needs: wherever the key is not that of the row before.

    The list is one key of a ``prefix_scan``: no row meets the whole list again.
    """
    rows = prefix_scan(items.withColumn("key", key), [], list(order), Running(before={"before": F.col("key")}, number="pos"))
    new = (F.col("pos") == 1) | ~F.col("key").eqNullSafe(F.col("before"))
    return rows.where(new).select((F.col("pos") - 1).alias("pos"), "key")


def timeline_items(media: DataFrame, screenshots: bool) -> DataFrame:
    """The timeline's items, screenshots among them only if the setting says so."""
    return media if screenshots else media.where(~is_screenshot())
