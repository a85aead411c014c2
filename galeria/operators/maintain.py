"""Keeping an index and a backup in step: snapshot differences, upserts, deletes, updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeria.operators.running import Running, prefix_scan
from galeria.plans.shared import fresh


def index_diff(present: DataFrame, known: DataFrame, key: str = "id", known_key: str = "media_id", stamp: str = "date_modified") -> DataFrame:
    """``key, status, date_modified``: gone, new, accept (replaced in place), changed or same."""
    p = present.select(F.col(key).alias("key"), F.col(stamp).alias("now"), F.lit(True).alias("here"))
    k = known.select(F.col(known_key).alias("key"), F.col(stamp).alias("then"), F.lit(True).alias("known"))
    status = (
        F.when(F.col("here").isNull(), "gone").when(F.col("known").isNull(), "new").when(F.col("then") == -1, "accept")
        .when(F.col("then") != F.col("now"), "changed").otherwise("same")
    )
    return p.join(k, "key", "full_outer").select("key", status.alias("status"), F.coalesce("now", "then").alias("date_modified"))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with the rows of ``new`` in place of those with their keys."""
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new)


def delete_keys(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` without the given keys."""
    return stored.join(gone.select(*keys), keys, "left_anti")


def update_where(stored: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """``stored`` with new values where the condition holds; null conditions change nothing."""
    return stored.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def backup_diff(media: DataFrame, backup: DataFrame) -> DataFrame:
    """Media missing in the backup or of another size there, by trimmed path and name."""
    b = backup.select(F.col("path").alias("p"), F.col("name").alias("nm"), F.col("size").alias("backup_size"))
    m = media.withColumn("p", F.regexp_replace("path", "^/+|/+$", "")).withColumnRenamed("name", "nm")
    status = F.when(F.col("backup_size").isNull(), "missing").when(F.col("backup_size") != F.col("size"), "changed")
    return m.join(b, ["p", "nm"], "left").withColumn("status", status).where("status IS NOT NULL").select("id", "status")


def restore_missing(backup: DataFrame, media: DataFrame) -> DataFrame:
    """Files of the backup that neither gallery nor trash hold, by lower-cased path, name and size."""
    have = media.select(F.lower(F.regexp_replace("path", "^/+|/+$", "")).alias("low"), "name", "size")
    return backup.withColumn("low", F.lower("path")).join(have, ["low", "name", "size"], "left_anti").select("path", "name", "size")


def apply_changes(stored: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``stored`` after a log of changes: columns of ``stored``, and ``seq`` and ``op`` (put or remove); a key's last change counts."""
    columns = [c for c in stored.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct("op", *columns), "seq").alias("c")).select(key, "c.*")
    return stored.join(last.select(key), key, "left_anti").unionByName(last.where("op = 'put'").drop("op"))


def set_for_keys(stored: DataFrame, keys: DataFrame, key: str, **values: Column) -> DataFrame:
    """``stored`` with new values in the rows of the given keys."""
    hit = keys.select(F.col(key)).distinct().withColumn("_hit", F.lit(True))
    return update_where(stored.join(hit, key, "left"), F.col("_hit"), **values).drop("_hit")


def progress(log: DataFrame, job: str, order: list[str], outcome: str, ms: str) -> DataFrame:
    """A job's log with running counts by outcome (done, failed, skipped), the mean time so far and what is left at that pace.

    One job may be the whole log: see ``prefix_scan``. Null times are in no mean, which is
    null until the first time; null jobs are one job.
    """
    counts = {c: F.when(F.col(outcome) == c, 1).otherwise(0).cast("long") for c in ("done", "failed", "skipped")}
    total, times, seen, all_ = (fresh(log, c) for c in ("ms_sum", "ms_count", "seen", "rows"))
    timed = {total: F.col(ms), times: F.col(ms).isNotNull().cast("long")}
    out = prefix_scan(log, [job], list(order), Running(sums=counts | timed, number=seen, totals={all_: F.lit(1).cast("long")}))
    mean = F.when(F.col(times) > 0, F.col(total).cast("double") / F.col(times))
    return out.withColumns({"ms_mean": mean, "ms_left": mean * (F.col(all_) - F.col(seen))}).drop(total, times, seen, all_)
