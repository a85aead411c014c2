"""Queries over vectors and people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeria.functions import kernels as K
from galeria.functions import scalars as S
from galeria.operators import catalog as C
from galeria.operators import maintain as M
from galeria.operators import merges as G
from galeria.operators import persons as P
from galeria.operators import search as V
from galeria.plans.catalog_queries import query
from galeria.sources import tables as T
from galeria.sources.tables import load, media


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """``id, vector`` of all embeddings."""
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def photos(spark: SparkSession, d: str) -> DataFrame:
    """Images with their vectors: ``id, ts_ms, vector`` and what ranks them."""
    m = media(spark, d).where(C.is_image()).select("id", "ts_ms", "is_favorite", "width", "height", "size")
    return m.join(vectors(spark, d), "id")


_DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_SCORED = f"s AS (SELECT a.vec_id AS id, {_DOT} AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b)"


def _search_sql(k: float, least: int, most: int, exclude: str = "") -> str:
    return f"""{_SCORED}, t AS (SELECT avg(score) AS m, greatest(stddev_pop(score), 1e-6) AS sd FROM s),
 r AS (SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rank FROM s {exclude}),
 found AS (SELECT id, score, rank FROM r, t WHERE rank <= {most} AND (rank <= {least} OR score >= m + {k} * sd))"""


@query("SELECT vec_id AS id, CAST(len(embedding) AS INT) AS dim FROM embeddings WHERE len(embedding) > 0", "")
def vector_scan(spark: SparkSession, d: str) -> DataFrame:
    """All vectors that are not empty."""
    return vectors(spark, d).where(F.size("vector") > 0).select("id", F.size("vector").alias("dim"))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 9 <> 4", "")
def vector_dim_guard(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as long as the first one."""
    v = vectors(spark, d).withColumn("vector", F.when(F.col("id") % 9 == 4, F.slice("vector", 1, 32)).otherwise(F.col("vector")))
    dim = v.agg(F.min_by(F.size("vector"), "id")).first()[0]
    return v.where(F.size("vector") == dim).select("id")


@query(f"WITH {_SCORED} SELECT id, round(score, 9) AS score FROM s", "")
def vector_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all vectors against one."""
    v = vectors(spark, d)
    return V.scores(v, V.vector_of(v, 0)).select("id", F.round("score", 9).alias("score"))


@query(f"WITH {_SCORED} SELECT count(*) AS n, round(avg(score), 6) AS mean, round(greatest(stddev_pop(score), 1e-6), 6) AS std FROM s", "")
def score_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of the scores."""
    v = vectors(spark, d)
    return V.score_stats(V.scores(v, V.vector_of(v, 0))).select("n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {_search_sql(1.6, 12, 800)} SELECT id, round(score, 9) AS score, rank FROM found", "")
def vector_search(spark: SparkSession, d: str) -> DataFrame:
    """Adaptive search at strictness 1.6, where the deviation decides."""
    v = vectors(spark, d)
    return V.search(v, V.vector_of(v, 0), 1.6).select("id", F.round("score", 9).alias("score"), "rank")


@query(f"WITH {_search_sql(2.2, 12, 800)} SELECT id, round(score, 9) AS score, rank FROM found", "")
def vector_search_default(spark: SparkSession, d: str) -> DataFrame:
    """Adaptive search at the default strictness, where the least number decides."""
    v = vectors(spark, d)
    return V.search(v, V.vector_of(v, 0)).select("id", F.round("score", 9).alias("score"), "rank")


@query(f"WITH {_search_sql(1.6, 12, 300, 'WHERE id <> 0')} SELECT id, round(score, 9) AS score, rank FROM found", "")
def similar_items(spark: SparkSession, d: str) -> DataFrame:
    """Items like vector 0, without itself."""
    return V.similar(vectors(spark, d), 0, 1.0).select("id", F.round("score", 9).alias("score"), "rank")


@query(f"WITH {_SCORED} SELECT m.id, CAST(CASE WHEN s.id IS NULL THEN 1 ELSE 0 END AS INT) AS section, round(score, 9) AS score, ts_ms FROM media m LEFT JOIN s ON s.id = m.id WHERE m.id % 3 = 0")
def search_within(spark: SparkSession, d: str) -> DataFrame:
    """Search within every third item; items without a vector come after."""
    v, allowed = vectors(spark, d), media(spark, d).where("id % 3 = 0").select("id", "ts_ms")
    out = V.search_within(v, V.vector_of(v, 0), allowed)
    return out.orderBy("section", F.desc("score"), F.desc("ts_ms"), "id").select("id", "section", F.round("score", 9).alias("score"), "ts_ms")


@query(f"WITH {_search_sql(1.6, 12, 800)} SELECT m.id, m.name, rank FROM found JOIN media m ON m.id = found.id")
def join_scored_media(spark: SparkSession, d: str) -> DataFrame:
    """A search's hits with their media, in the hits' order."""
    v = vectors(spark, d)
    hits = V.search(v, V.vector_of(v, 0), 1.6)
    return media(spark, d).join(F.broadcast(hits), "id").orderBy("rank").select("id", "name", "rank")


@query(f"""WITH s AS (SELECT CAST(b.vec_id AS INT) AS concept, a.vec_id AS id, {_DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id >= 16 AND b.vec_id < 16),
 t AS (SELECT concept, first(id ORDER BY score DESC, id) AS id, max(score) AS score FROM s GROUP BY concept)
 SELECT min(concept) AS concept, id, round(first(score ORDER BY concept), 9) AS score FROM t GROUP BY id""", "")  # fmt: skip
def explore_concepts(spark: SparkSession, d: str) -> DataFrame:
    """The best item of each of sixteen prompts; an item goes to its first prompt."""
    v = vectors(spark, d)
    prompts = sorted((r["id"], list(r["vector"])) for r in v.where("id < 16").collect())
    return V.best_per_concept(v.where("id >= 16"), prompts).select("concept", "id", F.round("score", 9).alias("score"))


_PHOTOS = "p AS (SELECT m.*, e.embedding FROM media m JOIN embeddings e ON e.vec_id = m.id WHERE m.mime_type LIKE 'image/%')"
_PAIRS = f"""{_PHOTOS}, pairs AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON (b.ts_ms > a.ts_ms OR (b.ts_ms = a.ts_ms AND b.id > a.id)) AND b.ts_ms - a.ts_ms <= 1200000 WHERE {_DOT} >= 0.25)"""
_GROUPS = f"""RECURSIVE {{views}} {_PAIRS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
 g AS (SELECT a AS id, least(a, min(b)) AS grp FROM reach GROUP BY a)"""


def _recursive(tail: str) -> str:
    return f"WITH {_GROUPS.format(views='media AS (' + T.SQL['media'] + '),')} {tail}"


@query(f"WITH {_PAIRS} SELECT a, b FROM pairs")
def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Photos of twenty minutes that look alike."""
    return V.near_pairs(photos(spark, d), 0.25)


@query(_recursive("SELECT id, grp FROM g"), "")
def near_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of photos that look alike."""
    return V.near_groups(photos(spark, d), 0.25)


@query(_recursive("""SELECT g.id, grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY is_favorite DESC, width::BIGINT * height DESC, size DESC, ts_ms, g.id) AS INT) AS rank,
 row_number() OVER (PARTITION BY grp ORDER BY is_favorite DESC, width::BIGINT * height DESC, size DESC, ts_ms, g.id) > 1 AS preselected FROM g JOIN media m ON m.id = g.id"""), "")  # fmt: skip
def dup_keep_best(spark: SparkSession, d: str) -> DataFrame:
    """The best photo of each group, and the others preselected."""
    p = photos(spark, d)
    return C.best_first(p.drop("vector").join(V.near_groups(p, 0.25), "id"), "grp").select("id", "grp", "rank", "preselected")


@query("""WITH t AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN vec_id % 20 = 0 THEN 0.0::DOUBLE ELSE x::DOUBLE * 3 END) AS v FROM embeddings), n AS (SELECT id, v, sqrt(list_inner_product(v, v)) AS n FROM t)
 SELECT id, round(CASE WHEN n > 0 THEN v[1] / n ELSE v[1] END, 9) AS first, CAST(CASE WHEN n > 0 THEN 1 ELSE 0 END AS DOUBLE) AS length FROM n""", "")  # fmt: skip
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Vectors at unit length; zero vectors stay."""
    v = vectors(spark, d).select("id", F.transform("vector", lambda x: F.when(F.col("id") % 20 == 0, 0.0).otherwise(x.cast("double") * 3)).alias("v"))
    v = v.select("id", S.l2_normalize(F.col("v")).alias("v"))
    return v.select("id", F.round(F.col("v")[0], 9).alias("first"), F.round(F.sqrt(S.dot(F.col("v"), F.col("v"))), 6).alias("length"))


@query("""WITH x AS (SELECT vec_id AS id, len(embedding) AS n, unnest(embedding)::DOUBLE AS v FROM embeddings),
 q AS (SELECT id, n, v, CASE WHEN v <> 0 THEN pow(2, greatest(floor(log2(abs(v))), -14) - 10) END AS step FROM x)
 SELECT id, CAST(2 * max(n) AS INT) AS bytes, CAST(max(abs(v - coalesce(round_even(v / step, 0) * step, 0))) AS FLOAT) AS error FROM q GROUP BY id""", "")  # fmt: skip
def fp16_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Vectors through half floats and back: bytes and the largest error."""
    v = vectors(spark, d).withColumn("half", K.to_half("vector"))
    back = v.withColumn("back", K.from_half("half"))
    error = F.array_max(F.zip_with("vector", "back", lambda a, b: F.abs(a - b)))
    return back.select("id", F.length("half").alias("bytes"), error.alias("error"))


@query("""WITH l AS (SELECT DISTINCT person_id, media_id FROM faces WHERE person_id IS NOT NULL AND media_id IN (SELECT id FROM media)), c AS (SELECT person_id, count(*) AS n FROM l GROUP BY 1)
 SELECT p.id, p.name, p.hidden, coalesce(c.n, 0) AS n FROM persons p LEFT JOIN c ON c.person_id = p.id WHERE coalesce(c.n, 0) >= 3 OR p.name IS NOT NULL""", "media", "faces", "persons")  # fmt: skip
def persons_view(spark: SparkSession, d: str) -> DataFrame:
    """Persons with a name or three photos, the named and the frequent first."""
    out = P.persons_view(T.persons(spark, d), T.faces(spark, d), media(spark, d))
    return out.orderBy(F.col("name").isNull(), F.desc("n"), "id")


@query("SELECT media_id FROM faces WHERE person_id = 0 INTERSECT SELECT media_id FROM faces WHERE person_id = 1", "faces")
def people_intersect(spark: SparkSession, d: str) -> DataFrame:
    """Photos with both of two people."""
    return P.photos_with_all(T.faces(spark, d), [0, 1])


@query("SELECT f.media_id, p.id AS person_id, p.name, min(f.id) AS face_id FROM faces f JOIN persons p ON p.id = f.person_id GROUP BY ALL", "faces", "persons")
def people_in_photo(spark: SparkSession, d: str) -> DataFrame:
    """The people on every photo, each with their first face there."""
    f = T.faces(spark, d).select("media_id", F.col("person_id").alias("pid"), F.col("id").alias("fid"))
    met = f.join(T.persons(spark, d), F.col("pid") == F.col("id"))
    return met.groupBy("media_id", F.col("id").alias("person_id"), "name").agg(F.min("fid").alias("face_id"))


@query("SELECT p.id, q.id AS twin FROM persons p JOIN (SELECT (id + 1) % 6 AS id, upper(name) AS name FROM persons WHERE id < 6) q ON lower(p.name) = lower(q.name) AND p.id <> q.id", "persons")
def twin_names(spark: SparkSession, d: str) -> DataFrame:
    """People that a new name, in any case, belongs to already."""
    p = T.persons(spark, d)
    asked = p.where("id < 6").select(((F.col("id") + 1) % 6).alias("twin"), F.lower(F.upper("name")).alias("low"))
    return p.withColumn("low", F.lower("name")).join(asked, "low").where("id <> twin").select("id", F.col("twin").cast("int").alias("twin"))


_CENTROIDS = """f AS (SELECT person_id, CASE WHEN confirmed THEN 2.0 ELSE 1.0 END AS w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM faces WHERE person_id IS NOT NULL),
 s AS (SELECT person_id, i, sum(w * x) AS s FROM f GROUP BY ALL), n AS (SELECT person_id, sqrt(sum(s * s)) AS n FROM s GROUP BY 1), cen AS (SELECT person_id, i, s / n AS x FROM s JOIN n USING (person_id)),
 vec AS (SELECT person_id, list(x ORDER BY i) AS c FROM cen GROUP BY 1)"""


@query(f"WITH {_CENTROIDS} SELECT person_id, CAST(i - 1 AS INT) AS i, round(x, 6) AS x FROM cen", "faces")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    """People's centers."""
    return P.centroids(T.faces(spark, d)).select("person_id", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("SELECT person_id, first(id ORDER BY confirmed::INT::DOUBLE + score + (r - l) DESC, id) AS cover_face_id, count(*) AS n FROM faces WHERE person_id IS NOT NULL GROUP BY 1", "faces")
def cover_face(spark: SparkSession, d: str) -> DataFrame:
    """People's best faces."""
    return P.cover_faces(T.faces(spark, d))


@query(f"""WITH {_CENTROIDS}, s AS (SELECT a.id AS face_id, v.person_id, list_inner_product(a.embedding::DOUBLE[], v.c) AS score FROM faces a, vec v
 WHERE a.person_id IS NULL AND NOT EXISTS (SELECT 1 FROM rejections j WHERE j.face_id = a.id AND j.person_id = v.person_id)),
 b AS (SELECT face_id, first(person_id ORDER BY score DESC, person_id) AS p, max(score) AS score FROM s GROUP BY 1)
 SELECT face_id, CASE WHEN score >= 0.1 THEN p END AS person_id, round(score, 6) AS score FROM b""".replace("s AS (SELECT a.id", "sc AS (SELECT a.id").replace("FROM s GROUP BY 1)\n SELECT face", "FROM sc GROUP BY 1)\n SELECT face"), "rejections")  # fmt: skip
def assign_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Faces without a person, given to the nearest one that was not rejected."""
    f = T.faces(spark, d)
    out = P.assign_nearest(f.where("person_id IS NULL"), P.centroids(f), T.rejections(spark, d), 0.1)
    return out.withColumn("score", F.round("score", 6))


@query(f"""WITH {_CENTROIDS}, seen AS (SELECT a.id, a.media_id, a.person_id, list_inner_product(a.embedding::DOUBLE[], v.c) AS score FROM faces a, vec v WHERE v.person_id = 2 AND NOT a.confirmed),
 own AS (SELECT id, media_id, score, row_number() OVER (ORDER BY score, id) AS turn FROM seen WHERE person_id = 2),
 oth AS (SELECT id, media_id, score, row_number() OVER (ORDER BY score DESC, id) AS turn FROM seen WHERE person_id IS DISTINCT FROM 2 AND score >= 0.06 AND id NOT IN (SELECT face_id FROM rejections WHERE person_id = 2)),
 b AS (SELECT turn, true AS own, * EXCLUDE turn FROM own UNION ALL SELECT turn, false, * EXCLUDE turn FROM oth)
 SELECT CAST(turn AS INT) AS turn, own, id AS face_id, media_id, round(score, 6) AS score FROM b WHERE media_id IN (SELECT id FROM media WHERE id % 10 <> 3) ORDER BY turn, own DESC LIMIT 50""", "media", "rejections")  # fmt: skip
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Faces to review for person 2, some photos missing."""
    f = T.faces(spark, d)
    center = P.centroids(f).where("person_id = 2").first()["centroid"]
    out = P.review_queue(f, 2, V.literal(center), T.rejections(spark, d), media(spark, d).where("id % 10 <> 3"), 0.2)
    return out.withColumn("score", F.round("score", 6))


@query("""WITH p AS (SELECT id, name, CAST(id * 10 AS BIGINT) AS c FROM persons UNION ALL SELECT 50, NULL, 3 UNION ALL SELECT 51, 'Nobody', 3),
 b AS (SELECT person_id, first(id ORDER BY confirmed::INT::DOUBLE + score + (r - l) DESC, id) AS best, count(*) AS n FROM faces WHERE person_id IS NOT NULL GROUP BY 1)
 SELECT CAST(p.id AS INT) AS id, name, coalesce(n, 0) AS n, CASE WHEN n IS NOT NULL THEN CASE WHEN EXISTS (SELECT 1 FROM faces f WHERE f.id = p.c AND f.person_id = p.id) THEN c ELSE best END END AS cover_face_id
 FROM p LEFT JOIN b ON b.person_id = p.id WHERE n IS NOT NULL OR name IS NOT NULL""", "faces", "persons")  # fmt: skip
def refresh_persons(spark: SparkSession, d: str) -> DataFrame:
    """People with fresh counts and covers."""
    p = T.persons(spark, d).select("id", "name", (F.col("id") * 10).cast("long").alias("cover_face_id"))
    more = spark.createDataFrame([(50, None, 3), (51, "Nobody", 3)], "id int, name string, cover_face_id long")
    return P.refreshed(p.union(more), T.faces(spark, d))


def _online(first: str, threshold: float) -> str:
    """Recursive SQL of online clusters: ``first`` are the rows (model, k, id, person, centers, counts, names) before the first vector of ``v``."""
    unit = "list_transform({x}, lambda y: y / sqrt(list_inner_product({x}, {x})))"
    mean = "list_transform(list_zip(coalesce(centers[pos], v.v), v.v), lambda z: (z[1] * coalesce(counts[pos], 0) + z[2]) / (coalesce(counts[pos], 0) + 1))"
    return f"""r AS ({first} UNION ALL
 SELECT model, k, id, CASE WHEN hit THEN CASE WHEN pos <= len(names) THEN names[pos] ELSE len(names) - pos END ELSE len(names) - len(centers) - 1 END AS person,
  CASE WHEN hit THEN list_concat(centers[1:pos - 1], [{unit.format(x="mean")}], centers[pos + 1:]) ELSE list_append(centers, vec) END AS centers,
  CASE WHEN hit THEN list_concat(counts[1:pos - 1], [counts[pos] + 1], counts[pos + 1:]) ELSE list_append(counts, 1) END AS counts, names
 FROM (SELECT *, {mean.replace("v.v", "vec")} AS mean
  FROM (SELECT *, list_position(sims, list_max(sims)) AS pos, len(sims) > 0 AND coalesce(list_max(sims), -2) >= {threshold} AS hit
   FROM (SELECT v.model, v.k, v.id, v.v AS vec, r.centers, r.counts, r.names, list_transform(r.centers, lambda c: list_inner_product(c, v.v)) AS sims
    FROM r JOIN v ON v.model = r.model AND v.k = r.k + 1))))"""


_NONE = "SELECT DISTINCT model, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS person, CAST([] AS DOUBLE[][]) AS centers, CAST([] AS BIGINT[]) AS counts, CAST([] AS BIGINT[]) AS names FROM v"


@query(f"""WITH RECURSIVE v AS (SELECT CAST(vec_id % 4 AS VARCHAR) AS model, vec_id AS id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) AS k FROM embeddings),
 {_online(_NONE, 0.25)} SELECT model, id, CAST(-1 - person AS INT) AS cluster FROM r WHERE id IS NOT NULL""", "")  # fmt: skip
def leader_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Online clusters of all vectors for four models."""
    f = T.faces(spark, d).withColumn("model", F.col("id") % 4)
    return P.leader_clusters(f, 0.25)


_REGROUP = f"""RECURSIVE faces AS ({T.SQL["faces"]}), g AS (SELECT *, CAST(coalesce(person_id, id) % 2 AS VARCHAR) AS model, CASE WHEN confirmed THEN person_id END AS sure FROM faces),
 w AS (SELECT sure, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM g WHERE sure IS NOT NULL), s AS (SELECT sure, i, sum(2.0 * x) AS s FROM w GROUP BY ALL),
 n AS (SELECT sure, sqrt(sum(s * s)) AS n FROM s GROUP BY 1), c AS (SELECT sure, list(s / n ORDER BY i) AS c FROM s JOIN n USING (sure) GROUP BY 1),
 k AS (SELECT sure, min(model) AS model, count(*) AS n FROM g WHERE sure IS NOT NULL GROUP BY 1),
 v AS (SELECT model, id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY model ORDER BY id) AS k FROM g WHERE sure IS NULL),
 {{rows}} SELECT model, id, CAST(sure AS BIGINT) AS person_id FROM g WHERE sure IS NOT NULL UNION ALL SELECT model, id, person FROM r WHERE id IS NOT NULL"""
_SURE = "SELECT model, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS person, list(c ORDER BY sure) AS centers, list(CAST(n AS BIGINT) ORDER BY sure) AS counts, list(CAST(sure AS BIGINT) ORDER BY sure) AS names FROM k JOIN c USING (sure) GROUP BY model"


@query("WITH " + _REGROUP.replace("{rows}", _online(_SURE, 0.3)), "")
def regroup_faces(spark: SparkSession, d: str) -> DataFrame:
    """Faces of two models grouped anew from their confirmed ones; new groups have negative numbers."""
    f = T.faces(spark, d).withColumn("model", (F.coalesce(F.col("person_id").cast("long"), F.col("id")) % 2).cast("string"))
    p = T.persons(spark, d).select("id", "name", F.lit(None).cast("long").alias("cover_face_id"))
    return P.regrouped(p, f, 0.3, "model")[1]


@query("SELECT DISTINCT name FROM persons WHERE contains(lower(name), 'pers') AND id <> 2 ORDER BY name LIMIT 4", "persons")
def rename_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Other people's names for what was typed."""
    return P.rename_suggestions(T.persons(spark, d), " PERS ", 2)


@query("""WITH RECURSIVE faces AS ({faces}), a AS (SELECT id AS seq, CASE WHEN id % 2 = 0 THEN 'confirm' ELSE 'reject' END AS kind, id AS face, CAST(coalesce(person_id, 1) AS BIGINT) AS person, CAST(NULL AS BIGINT) AS other FROM faces WHERE id % 3 = 0
  UNION ALL SELECT 100, 'merge', NULL, 0, 1 UNION ALL SELECT 250, 'merge', NULL, 2, 0), o AS (SELECT *, row_number() OVER (ORDER BY seq) AS k FROM a),
 r AS (SELECT CAST(0 AS BIGINT) AS k, id, CAST(person_id AS BIGINT) AS p, confirmed AS c FROM faces UNION ALL
  SELECT o.k, id, CASE WHEN kind = 'merge' THEN CASE WHEN p = other THEN person ELSE p END WHEN face <> id THEN p WHEN kind = 'confirm' THEN person WHEN p IS NOT DISTINCT FROM person THEN NULL ELSE p END,
   CASE WHEN kind = 'merge' OR face <> id THEN c WHEN kind = 'confirm' THEN true WHEN p IS NOT DISTINCT FROM person THEN false ELSE c END FROM r JOIN o ON o.k = r.k + 1)
 SELECT id, p AS person_id, c AS confirmed FROM r WHERE k = (SELECT max(k) FROM o)""".replace("{faces}", T.SQL["faces"]), "")  # fmt: skip
def replay_actions(spark: SparkSession, d: str) -> DataFrame:
    """Faces after a log of confirmations, rejections and merges."""
    f = T.faces(spark, d)
    i = F.col("id")
    log = f.where("id % 3 = 0").select(
        i.alias("seq"), F.when(i % 2 == 0, "confirm").otherwise("reject").alias("kind"), i.alias("face_id"),
        F.coalesce("person_id", F.lit(1)).cast("long").alias("person_id"), F.lit(None).cast("long").alias("other_id"),
    )
    merges = spark.createDataFrame([(100, "merge", None, 0, 1), (250, "merge", None, 2, 0)], log.schema)
    return G.replay(f, log.unionByName(merges))


_LOG = """l AS (SELECT id AS seq, CASE id % 5 WHEN 0 THEN 'confirm' WHEN 1 THEN 'assign' WHEN 2 THEN 'merge' WHEN 3 THEN 'unreject' ELSE 'reject' END AS kind, CAST(id * 7 % 100 AS BIGINT) AS face,
  CAST(CASE WHEN id % 5 = 4 THEN coalesce(person_id, 1) ELSE id * 3 % 10 END AS BIGINT) AS person, CAST(CASE WHEN id % 5 = 2 THEN id % 10 + id // 7 % 3 END AS BIGINT) AS other FROM faces),
 o AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS nr FROM l), m AS (SELECT * FROM o WHERE kind = 'merge' AND person <> other)"""


def action_log(faces: DataFrame) -> DataFrame:
    """A log that grows with the faces: every face is a confirmation, move, merge, rejection or its undoing."""
    i = F.col("id")
    kind = F.element_at(F.array(*(F.lit(k) for k in ("confirm", "assign", "merge", "unreject", "reject"))), (i % 5 + 1).cast("int"))
    person = F.when(i % 5 == 4, F.coalesce("person_id", F.lit(1))).otherwise(i * 3 % 10)
    other = F.when(i % 5 == 2, i % 10 + F.floor(i / 7) % 3)
    return faces.select(i.alias("seq"), kind.alias("kind"), (i * 7 % 100).alias("face_id"), person.cast("long").alias("person_id"), other.cast("long").alias("other_id"))


_REPLAYED = f"""{_LOG}, r AS (SELECT CAST(-1 AS BIGINT) AS nr, id, CAST(person_id AS BIGINT) AS p, confirmed AS c FROM faces UNION ALL
  SELECT o.nr, id, CASE WHEN kind = 'merge' THEN CASE WHEN p = other THEN person ELSE p END WHEN face <> id OR kind = 'unreject' THEN p WHEN kind IN ('confirm', 'assign') THEN person WHEN p = person THEN NULL ELSE p END,
   CASE WHEN kind IN ('merge', 'unreject') OR face <> id THEN c WHEN kind IN ('confirm', 'assign') THEN kind = 'confirm' WHEN p = person THEN false ELSE c END FROM r JOIN o ON o.nr = r.nr + 1),
 after AS (SELECT id, p AS person_id, c AS confirmed FROM r WHERE nr = (SELECT max(nr) FROM o))"""


@query(f"WITH RECURSIVE faces AS ({T.SQL['faces']}), {_REPLAYED} SELECT * FROM after", "")
def replay_merges(spark: SparkSession, d: str) -> DataFrame:
    """Faces after a log of as many actions as there are faces, a fifth of them merges."""
    f = T.faces(spark, d)
    return G.replay(f, action_log(f))


@query(f"""WITH RECURSIVE faces AS ({T.SQL['faces']}), persons AS ({T.SQL['persons']}), rejections AS ({T.SQL['rejections']}), {_LOG},
 s AS (SELECT face_id, CAST(person_id AS BIGINT) AS person, CAST(-1 AS BIGINT) AS since FROM rejections UNION SELECT face, person, nr FROM o WHERE kind = 'reject'),
 t AS (SELECT DISTINCT person, since FROM s),
 c AS (SELECT person, since, person AS there, since AS came FROM t UNION ALL
  SELECT c.person, c.since, m.person, m.nr FROM c JOIN m ON m.other = c.there AND m.nr > c.came AND NOT EXISTS (SELECT 1 FROM m AS e WHERE e.other = c.there AND e.nr > c.came AND e.nr < m.nr)),
 p AS (SELECT *, lead(came) OVER (PARTITION BY person, since ORDER BY came) AS left_ FROM c),
 gone AS (SELECT DISTINCT s.face_id, s.person, s.since FROM s JOIN o ON o.face = s.face_id AND o.kind = 'unreject' AND o.nr > s.since JOIN p ON p.person = s.person AND p.since = s.since
  WHERE p.there = o.person AND p.came < o.nr AND (p.left_ IS NULL OR p.left_ >= o.nr))
 SELECT DISTINCT s.face_id, p.there AS person_id FROM s JOIN p ON p.person = s.person AND p.since = s.since AND p.left_ IS NULL
 WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.face_id = s.face_id AND g.person = s.person AND g.since = s.since)""", "")  # fmt: skip
def replay_rejections(spark: SparkSession, d: str) -> DataFrame:
    """Rejections after the same log: merges carry them along, a pair that both persons reject stays once."""
    return G.replay_rejections(T.rejections(spark, d), action_log(T.faces(spark, d)))


@query(f"""WITH RECURSIVE faces AS ({T.SQL['faces']}), persons AS ({T.SQL['persons']}), {_REPLAYED},
 n AS (SELECT f.id, a.person_id, a.confirmed, f.score, f.l, f.r FROM faces f JOIN after a ON a.id = f.id),
 b AS (SELECT person_id, first(id ORDER BY confirmed::INT::DOUBLE + score + (r - l) DESC, id) AS best, count(*) AS n FROM n WHERE person_id IS NOT NULL GROUP BY 1)
 SELECT p.id, name, coalesce(b.n, 0) AS n, CASE WHEN b.n IS NOT NULL THEN CASE WHEN EXISTS (SELECT 1 FROM n f WHERE f.id = p.id * 10 AND f.person_id = p.id) THEN CAST(p.id * 10 AS BIGINT) ELSE best END END AS cover_face_id
 FROM persons p LEFT JOIN b ON b.person_id = p.id WHERE b.n IS NOT NULL OR name IS NOT NULL""", "")  # fmt: skip
def replay_refresh(spark: SparkSession, d: str) -> DataFrame:
    """People after the log, with fresh counts and covers; those left without faces and name go."""
    f = T.faces(spark, d)
    moved = f.drop("person_id", "confirmed").join(G.replay(f, action_log(f)), "id")
    p = T.persons(spark, d).select("id", "name", (F.col("id") * 10).cast("long").alias("cover_face_id"))
    return P.refreshed(p, moved)


@query("""WITH RECURSIVE persons AS ({persons}), named AS (SELECT CAST(id AS BIGINT) AS id, CASE WHEN id % 4 = 3 THEN name END AS name FROM persons),
 m AS (SELECT id AS other, id // 2 AS person, row_number() OVER (ORDER BY id DESC) AS k FROM named WHERE id > 1 AND id % 5 <> 4),
 s AS (SELECT CAST(0 AS BIGINT) AS k, list({'id': id, 'name': name} ORDER BY id) AS p FROM named UNION ALL
  SELECT m.k, list_transform(list_filter(p, lambda x: x.id <> m.other), lambda x: {'id': x.id, 'name': CASE WHEN x.id = m.person THEN coalesce(x.name, list_filter(p, lambda y: y.id = m.other)[1].name) ELSE x.name END}) FROM s JOIN m ON m.k = s.k + 1),
 e AS (SELECT unnest(p) AS x FROM s WHERE k = (SELECT count(*) FROM m)) SELECT x.id AS id, x.name AS name FROM e""".replace("{persons}", T.SQL["persons"]), "")  # fmt: skip
def replay_names(spark: SparkSession, d: str) -> DataFrame:
    """People left after merges of each into the one of half its number, the last first; a third of the names is known before."""
    i = F.col("id").cast("long")
    p = T.persons(spark, d).select(i.alias("id"), F.when(i % 4 == 3, F.col("name")).alias("name"))
    none = F.lit(None).cast("long")
    log = p.where("id > 1 AND id % 5 <> 4").select((-i).alias("seq"), F.lit("merge").alias("kind"), none.alias("face_id"), F.floor(i / 2).alias("person_id"), i.alias("other_id"))
    return G.replay_persons(p, log)


@query("SELECT id, name FROM persons p WHERE NOT (name IS NULL AND id NOT IN (SELECT DISTINCT person_id FROM faces WHERE confirmed AND person_id IS NOT NULL))", "faces", "persons")
def anti_unnamed_persons(spark: SparkSession, d: str) -> DataFrame:
    """People without those that have neither a name nor a confirmed face."""
    p = T.persons(spark, d)
    sure = T.faces(spark, d).where("confirmed AND person_id IS NOT NULL").select(F.col("person_id").alias("id"))
    gone = p.where("name IS NULL").join(sure, "id", "left_anti")
    return M.delete_keys(p, gone, ["id"]).select("id", "name")


@query("SELECT DISTINCT person_id, media_id FROM faces WHERE person_id IS NOT NULL", "faces")
def distinct_links(spark: SparkSession, d: str) -> DataFrame:
    """People and the photos they are on."""
    return P.links(T.faces(spark, d))


@query("SELECT id, CASE WHEN confirmed THEN person_id END AS person_id FROM faces", "faces")
def update_by_pred(spark: SparkSession, d: str) -> DataFrame:
    """Faces without their unconfirmed people."""
    return M.update_where(T.faces(spark, d), ~F.col("confirmed"), person_id=F.lit(None).cast("int")).select("id", "person_id")


_ASKED = ("Person 1 und Person 2 am Strand", "person 3, with dog", "personal 4", "Person 5", "mit Hund & Katze")
_NAME = "'(?i)(\\s|^)' || regexp_escape(x.name) || '(\\s|$|[,.!?])'"


@query("""WITH q AS (SELECT unnest([{asked}]) AS query), n AS (SELECT list({{'name': name, 'rest': '', 'found': CAST([] AS VARCHAR[])}} ORDER BY length(name) DESC, name) AS names FROM persons WHERE name IS NOT NULL),
 m AS (SELECT query, list_reduce(list_concat([{{'name': '', 'rest': ' ' || trim(query) || ' ', 'found': CAST([] AS VARCHAR[])}}], names), lambda a, x: {{'name': '',
  'rest': regexp_replace(a.rest, {name}, '\\1 \\2', 'g'), 'found': CASE WHEN regexp_matches(a.rest, {name}) THEN list_append(a.found, x.name) ELSE a.found END}}) AS m FROM q, n)
 SELECT query, array_to_string(m.found, ',') AS names, trim(regexp_replace(regexp_replace(m.rest, '(?i)\\b(und|and|mit|with|&)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS rest FROM m""".format(
    asked=", ".join(f"'{q}'" for q in _ASKED), name=_NAME), "persons")
def match_query(spark: SparkSession, d: str) -> DataFrame:
    """Names found in queries, and what is left of these."""
    asked = spark.createDataFrame([(q,) for q in _ASKED], "query string")
    return P.matched_queries(asked, T.persons(spark, d)).select("query", F.array_join("names", ",").alias("names"), "rest")


@query("SELECT id, CASE WHEN hidden THEN 'hidden' WHEN name IS NOT NULL THEN 'named' ELSE 'unnamed' END AS section FROM persons", "persons")
def people_sections(spark: SparkSession, d: str) -> DataFrame:
    """Where each person stands in the people's list."""
    return T.persons(spark, d).select("id", P.section(F.col("name"), F.col("hidden")).alias("section"))
