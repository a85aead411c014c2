"""Parquet tables, the views that give them the shape of a media library, and file listings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media table: documents with the event of the same number."""
    d, e = load(spark, sf_dir, "documents"), load(spark, sf_dir, "events")
    ms, i = F.unix_millis(F.col("ts").cast("timestamp")), F.col("doc_id")
    joined = d.select("doc_id", "n_chars", "source").join(e.select("event_id", "ts", "event_type"), F.col("event_id") == i)
    kind = F.col("event_type")
    return joined.select(
        i.alias("id"),
        F.concat(F.lit("IMG_"), i.cast("string"), F.lit(".jpg")).alias("name"),
        F.when(kind == "view", "video/mp4").when(kind == "click", "image/png").otherwise("image/jpeg").alias("mime_type"),
        ms.alias("ts_ms"),
        F.floor(ms / 1000).cast("long").alias("date_modified"),
        F.col("ts"),
        (F.col("n_chars") * 1000).alias("size"),
        (400 + (i * 37) % 4600).cast("int").alias("width"),
        (300 + (i * 53) % 3700).cast("int").alias("height"),
        ((i % 4) * 90).cast("int").alias("orientation"),
        F.col("source").alias("bucket"),
        F.when(F.col("source").isin("src0", "src1"), "DCIM/Camera/")
        .when(F.col("source") == "src2", "Pictures/Screenshots/")
        .otherwise(F.concat(F.lit("Pictures/"), F.col("source"), F.lit("/")))
        .alias("path"),
        F.when(kind == "view", (i % 90) * 1000).otherwise(0).cast("long").alias("duration_ms"),
        (kind == "purchase").alias("is_favorite"),
        (i % 23 == 0).alias("is_trashed"),
    )


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces: vectors with the photo, person, confirmation, score and box."""
    i = F.col("vec_id")
    left = (i % 4).cast("double") / 10
    return load(spark, sf_dir, "embeddings").select(
        i.alias("id"),
        (i % 100).alias("media_id"),
        "embedding",
        F.when(i % 7 != 0, F.col("label")).alias("person_id"),
        ((i % 5 == 0) & (i % 7 != 0)).alias("confirmed"),
        (0.5 + (i % 50).cast("double") / 100).alias("score"),
        left.alias("l"),
        (left + 0.1 + (i % 3).cast("double") / 10).alias("r"),
    )


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons: labels, six of them named, one hidden."""
    label = F.col("label")
    named = F.when(label < 6, F.concat(F.lit("Person "), label.cast("string")))
    return load(spark, sf_dir, "embeddings").select(label.alias("id"), named.alias("name"), (label == 9).alias("hidden")).distinct()


def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(face, person) pairs that were rejected: those with face * 7 + person divisible by 11, met by remainder."""
    f = faces(spark, sf_dir).select(F.col("id").alias("face_id"), F.pmod(F.col("id") * -7, F.lit(11)).alias("k"))
    p = persons(spark, sf_dir).select(F.col("id").alias("person_id"), F.pmod(F.col("id").cast("long"), F.lit(11)).alias("k"))
    return f.join(p, "k").select("face_id", "person_id")


def known_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored keys of an index: unchanged, replaced (-1), changed and gone ones."""
    m, i, t = media(spark, sf_dir), F.col("id"), F.col("date_modified")
    changed = F.when(i % 10 == 3, -1).when(i % 10 == 7, t - 1).otherwise(t)
    kept = m.where(i % 6 != 0).select(i.alias("media_id"), changed.alias("date_modified"))
    return kept.union(m.where(i % 15 == 0).select(i + 1000000, t))


def backup_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a backup: most of the media, some of another size, some of their own."""
    m, i = media(spark, sf_dir), F.col("id")
    size = F.col("size") + F.when(i % 13 == 0, 1).otherwise(0)
    kept = m.where(i % 9 != 0).select(F.regexp_replace("path", "/$", "").alias("path"), "name", size.alias("size"))
    old = m.where(i % 40 == 0).select(F.lit("DCIM/Old"), F.concat(F.lit("OLD_"), i.cast("string"), F.lit(".jpg")), "size")
    return kept.union(old)


def list_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Path, length and modification time of the files under ``path``; contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job files {"ids": [...], "settings": {...}} as one row per id, in the order of the list."""
    jobs = spark.read.schema("ids array<bigint>, settings map<string,string>").option("multiLine", True).json(path)
    return jobs.select("settings", F.posexplode("ids").alias("position", "id"))


def read_tokenizer(spark: SparkSession, path: str) -> dict:
    """What ``kernels.tokenizer`` takes, from a tokenizer's JSON file.

    Added tokens stand in the vocabulary unless their text does already; merges are "a b" or
    [a, b]; a suffix that marks the end of words makes the kind "clip", else it is "pieces".
    """
    data = json.loads(spark.read.text(path, wholetext=True).first()[0])
    model = data["model"]
    vocab = dict(model["vocab"])
    for token in data.get("added_tokens", ()):
        vocab.setdefault(token["content"], token["id"])
    pairs = ((m[: m.find(" ", 1)], m[m.find(" ", 1) + 1 :]) if isinstance(m, str) else tuple(m[:2]) for m in model["merges"] if not isinstance(m, str) or " " in m[1:])
    first = lambda names, other: next((vocab[n] for n in names if n in vocab), other)
    return {
        "kind": "clip" if model.get("end_of_word_suffix") else "pieces", "vocab": vocab, "merges": list(pairs),
        "unknown": vocab.get(model.get("unk_token") or "", 0), "begin": first(("<|startoftext|>", "<bos>", "<s>"), 0), "end": first(("<|endoftext|>", "<eos>", "</s>"), 1),
    }


# The same views for DuckDB.
_MS = "(epoch_us(e.ts) // 1000)"
SQL = {
    "media": f"""SELECT d.doc_id AS id, concat('IMG_', CAST(d.doc_id AS VARCHAR), '.jpg') AS name,
 CASE e.event_type WHEN 'view' THEN 'video/mp4' WHEN 'click' THEN 'image/png' ELSE 'image/jpeg' END AS mime_type,
 {_MS} AS ts_ms, CAST(floor({_MS} / 1000) AS BIGINT) AS date_modified, e.ts AS ts, d.n_chars * 1000 AS size,
 CAST(400 + (d.doc_id * 37) % 4600 AS INT) AS width, CAST(300 + (d.doc_id * 53) % 3700 AS INT) AS height,
 CAST((d.doc_id % 4) * 90 AS INT) AS orientation, d.source AS bucket,
 CASE WHEN d.source IN ('src0','src1') THEN 'DCIM/Camera/' WHEN d.source = 'src2' THEN 'Pictures/Screenshots/' ELSE concat('Pictures/', d.source, '/') END AS path,
 CASE WHEN e.event_type = 'view' THEN (d.doc_id % 90) * 1000 ELSE 0 END AS duration_ms,
 e.event_type = 'purchase' AS is_favorite, d.doc_id % 23 = 0 AS is_trashed
FROM documents d JOIN events e ON e.event_id = d.doc_id""",
    "faces": """SELECT vec_id AS id, vec_id % 100 AS media_id, embedding, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE label END AS person_id,
 (vec_id % 5 = 0 AND vec_id % 7 <> 0) AS confirmed, 0.5 + CAST(vec_id % 50 AS DOUBLE) / 100 AS score,
 CAST(vec_id % 4 AS DOUBLE) / 10 AS l, CAST(vec_id % 4 AS DOUBLE) / 10 + 0.1 + CAST(vec_id % 3 AS DOUBLE) / 10 AS r FROM embeddings""",
    "persons": """SELECT DISTINCT label AS id, CASE WHEN label < 6 THEN concat('Person ', CAST(label AS VARCHAR)) END AS name, label = 9 AS hidden FROM embeddings""",
    "rejections": "SELECT f.id AS face_id, p.id AS person_id FROM faces f CROSS JOIN persons p WHERE (f.id * 7 + p.id) % 11 = 0",
    "known_keys": """SELECT id AS media_id, CASE WHEN id % 10 = 3 THEN -1 WHEN id % 10 = 7 THEN date_modified - 1 ELSE date_modified END AS date_modified
 FROM media WHERE id % 6 <> 0 UNION ALL SELECT id + 1000000, date_modified FROM media WHERE id % 15 = 0""",
    "backup_files": """SELECT regexp_replace(path, '/$', '') AS path, name, size + CASE WHEN id % 13 = 0 THEN 1 ELSE 0 END AS size FROM media WHERE id % 9 <> 0
 UNION ALL SELECT 'DCIM/Old', concat('OLD_', CAST(id AS VARCHAR), '.jpg'), size FROM media WHERE id % 40 = 0""",
}
NEEDS = {"rejections": ("faces", "persons"), "known_keys": ("media",), "backup_files": ("media",)}


def with_views(sql: str, *views: str) -> str:
    """DuckDB SQL with the named views in front."""
    names = list(dict.fromkeys(n for v in views for n in (*NEEDS.get(v, ()), v)))
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    sql = sql.strip()
    return f"WITH {head}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {head} {sql}"
