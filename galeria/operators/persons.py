"""People: links, centroids, assignment, review, refreshing, online clusters, replaying actions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from galeria.functions.kernels import match_names
from galeria.functions.scalars import dot, l2_normalize
from galeria.operators.catalog import interleave


def links(faces: DataFrame) -> DataFrame:
    """Distinct (person, photo) pairs."""
    return faces.where("person_id IS NOT NULL").select("person_id", "media_id").distinct()


def persons_view(persons: DataFrame, faces: DataFrame, media: DataFrame, least: int = 3) -> DataFrame:
    """``id, name, hidden, n``: persons with a name or ``least`` photos that exist."""
    there = links(faces).join(media.select(F.col("id").alias("media_id")), "media_id", "left_semi")
    counts = there.groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("n"))
    out = persons.join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.where((F.col("n") >= least) | F.col("name").isNotNull()).select("id", "name", "hidden", "n")


def photos_with_all(faces: DataFrame, people: list[int]) -> DataFrame:
    """Photos on which all the people are."""
    some = links(faces).where(F.col("person_id").isin(people))
    return some.groupBy("media_id").agg(F.count("*").alias("c")).where(F.col("c") == len(set(people))).select("media_id")


def centroids(faces: DataFrame) -> DataFrame:
    """``person_id, centroid``: unit vector of the faces' sum, confirmed ones twice.

    Sums are per person and dimension, so they combine before the shuffle; only one
    person's dimensions are gathered.
    """
    weight = F.when(F.col("confirmed"), 2.0).otherwise(1.0)
    parts = faces.where("person_id IS NOT NULL").select("person_id", weight.alias("w"), F.posexplode("embedding").alias("i", "x"))
    sums = parts.groupBy("person_id", "i").agg(F.sum(F.col("w") * F.col("x").cast("double")).alias("s"))
    vectors = sums.groupBy("person_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("v"))
    return vectors.select("person_id", l2_normalize(F.col("v")).alias("centroid"))


def cover_score() -> Column:
    """What makes a good cover: confirmed, a high score, a wide face."""
    return F.col("confirmed").cast("double") + F.col("score") + (F.col("r") - F.col("l"))


def cover_faces(faces: DataFrame) -> DataFrame:
    """``person_id, cover_face_id, n``."""
    best = F.max_by("id", F.struct(cover_score().alias("s"), -F.col("id")))
    return faces.where("person_id IS NOT NULL").groupBy("person_id").agg(best.alias("cover_face_id"), F.count("*").alias("n"))


def assign_nearest(
    faces: DataFrame, centers: DataFrame, rejections: DataFrame, threshold: float, part_bytes: int = 64 << 20, most_parts: int = 2, slice_rows: int = 1 << 16
) -> DataFrame:
    """``face_id, person_id, score``: the nearest center that was not rejected for the face; no person below the threshold.

    Scores are products of matrices, a block of faces by a block of centers, and the best
    ones are added again in one order, so equal centers tie and the smaller person wins.
    Centers go in parts of about ``part_bytes``, by their checked size. Up to ``most_parts``
    are sent to every task, and no face moves; of more, each meets each slice of about
    ``slice_rows`` faces. Vectors of another length than the centers' score nothing, and a
    face that no center may take has no row.
    """
    spark = faces.sparkSession
    size = centers.agg(F.count("*").alias("n"), F.max(F.size("centroid")).alias("d")).first()
    kind, dim = centers.schema["person_id"].dataType.simpleString(), size["d"] or 0
    centers = centers.select("person_id", F.col("centroid").cast("array<double>").alias("c")).where(F.size("c") == dim)
    parts = max(1, -(-size["n"] * dim * 8 // part_bytes))
    no = rejections.groupBy("face_id").agg(F.collect_set(F.col("person_id").cast("long")).alias("no"))
    rows = faces.select(F.col("id").alias("face_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.size("v") == dim)
    rows = rows.join(no, "face_id", "left")
    out = f"face_id {rows.schema['face_id'].dataType.simpleString()}, person_id {kind}, score double"
    if parts <= most_parts:
        held = spark.sparkContext.broadcast(centers.toArrow())
        scored = rows.mapInArrow(_nearest(lambda: held.value, dim), out)
        best = F.col("person_id"), F.col("score")
    else:
        slices = max(1, -(-rows.count() // slice_rows))
        left = rows.withColumn("slice", F.pmod(F.xxhash64("face_id"), F.lit(slices))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        right = centers.withColumn("part", F.pmod(F.xxhash64("person_id"), F.lit(parts)).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
        schema = to_arrow_schema(T._parse_datatype_string(out))
        score = lambda f, c: pa.Table.from_batches(_nearest(lambda: c, dim)(f.to_batches()), schema)
        met = left.groupBy("part", "slice").cogroup(right.groupBy("part", "slice")).applyInArrow(score, out)
        scored = met.groupBy("face_id").agg(F.max_by(F.struct("person_id", "score"), F.struct(F.col("score"), -F.col("person_id"))).alias("b"))
        best = F.col("b.person_id"), F.col("b.score")
    return scored.select("face_id", F.when(best[1] >= threshold, best[0]).alias("person_id"), best[1].alias("score"))


def _nearest(centers, dim: int, rows: int = 1024, columns: int = 4096):
    """Faces (``face_id, v, no``) to their best center of a table (``person_id, c``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = centers()
        people = table["person_id"].to_numpy()
        order = np.argsort(people, kind="stable")
        people, c = people[order], np.ascontiguousarray(_matrix(table["c"], dim)[order])
        for batch in batches:
            ids, v, no = (batch.column(batch.schema.get_field_index(n)) for n in ("face_id", "v", "no"))
            who, best = np.zeros(len(batch), people.dtype), np.full(len(batch), -np.inf)
            for at in range(0, len(batch) if len(people) else 0, rows):
                x = _matrix(v.slice(at, rows), dim)
                refused = [(i, p) for i, ps in enumerate(no.slice(at, rows).to_pylist()) if ps for p in ps]
                f, p = (np.array(a, np.int64) for a in (zip(*refused, strict=True) if refused else ((), ())))
                place = np.searchsorted(people, p)
                fits = (place < len(people)) & (people[np.minimum(place, len(people) - 1)] == p)
                f, place = f[fits], place[fits]
                for k in range(0, len(people), columns):
                    s = x @ c[k : k + columns].T
                    inside = (place >= k) & (place < k + columns)
                    s[f[inside], place[inside] - k] = -np.inf
                    i, j = np.nonzero(s >= np.maximum(s.max(1), best[at : at + rows] - 1e-9)[:, None] - 1e-9)
                    real = s[i, j] > -np.inf
                    i, j = i[real], j[real]
                    exact = (x[i] * c[k + j]).sum(1)  # one order of adding
                    for face, person, value in zip(i.tolist(), j.tolist(), exact.tolist(), strict=True):
                        if value > best[at + face]:
                            best[at + face], who[at + face] = value, people[k + person]
            there = np.flatnonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(there)), pa.array(who[there]), pa.array(best[there])], ["face_id", "person_id", "score"])

    return run


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def review_queue(faces: DataFrame, person: int, centroid: Column, rejections: DataFrame, media: DataFrame, threshold: float, limit: int = 50) -> DataFrame:
    """``turn, own, face_id, media_id, score``: a person's least certain faces and others' most similar ones by turns.

    Only the first faces of both sides are ranked; more of them where too many of their
    photos are gone.
    """
    seen = faces.where(~F.col("confirmed")).withColumn("score", dot(F.col("embedding"), centroid))
    own = seen.where(F.col("person_id") == person)
    no = rejections.where(F.col("person_id") == person).select(F.col("face_id").alias("id"))
    others = seen.where(~F.col("person_id").eqNullSafe(F.lit(person)) & (F.col("score") >= threshold - 0.14)).join(no, "id", "left_anti")
    columns, first = ["id", "media_id", "score"], 2 * limit
    while True:
        turns = interleave(own.select(*columns), others.select(*columns), [F.asc("score"), F.asc("id")], [F.desc("score"), F.asc("id")], first)
        there = turns.join(media.select(F.col("id").alias("media_id")), "media_id", "left_semi")
        out = there.orderBy("turn", F.desc("own")).limit(limit).select("turn", "own", F.col("id").alias("face_id"), "media_id", "score")
        n = out.agg(F.count("*").alias("n"), F.max("turn").alias("turn")).first()
        if n["n"] >= limit or turns.agg(F.max("turn")).first()[0] in (None, *range(first)):
            return out
        first *= 4


def refreshed(persons: DataFrame, faces: DataFrame) -> DataFrame:
    """Persons (``id, name, cover_face_id``) with new counts and covers; those without faces and name go.

    A cover stays while it is one of the person's faces.
    """
    fresh = cover_faces(faces).select(F.col("person_id").alias("id"), F.col("cover_face_id").alias("best"), "n")
    own = faces.select(F.col("id").alias("cover_face_id"), F.col("person_id").alias("id"), F.lit(True).alias("still"))
    out = persons.join(fresh, "id", "left").join(own, ["id", "cover_face_id"], "left")
    out = out.where(F.col("n").isNotNull() | F.col("name").isNotNull())
    cover = F.when(F.col("n").isNotNull(), F.when(F.col("still"), F.col("cover_face_id")).otherwise(F.col("best")))
    return out.select("id", "name", F.coalesce("n", F.lit(0)).alias("n"), cover.alias("cover_face_id"))


class Leaders:
    """Online clusters of unit vectors: the nearest center takes a vector above the threshold, else a new one starts.

    Centers are rows of one matrix, so a vector meets all of them in one product.
    """

    def __init__(self, threshold: float, centers: list | None = None, counts: list | None = None) -> None:
        self.threshold, self.counts, self._held = threshold, [], np.empty((0, 0))
        for c, n in zip(centers or [], counts or [], strict=True):
            self.start(c, n)

    @property
    def centers(self) -> np.ndarray:
        """The centers, a row each."""
        return self._held[: len(self.counts)]

    def start(self, center: np.ndarray, count: int = 1) -> int:
        """A new cluster; returns its number."""
        center, k = np.asarray(center, float), len(self.counts)
        if k == len(self._held):
            self._held = np.concatenate([self._held.reshape(-1, len(center)), np.empty((max(16, k), len(center)))])
        self._held[k] = center
        self.counts.append(int(count))
        return k

    def add(self, v: np.ndarray) -> int:
        """The vector's cluster number; the center becomes the running mean at unit length."""
        v = np.asarray(v, float)
        if self.counts:
            sims = self.centers @ v
            best = int(sims.argmax())
            if sims[best] >= self.threshold:
                n = self.counts[best]
                mean = (self._held[best] * n + v) / (n + 1)
                norm = np.linalg.norm(mean)
                self._held[best], self.counts[best] = mean / norm if norm > 0 else mean, n + 1
                return best
        return self.start(v)


def leader_clusters(faces: DataFrame, threshold: float, model: str = "model") -> DataFrame:
    """``model, id, cluster``: online clustering in the order of ids, each model by itself, as the order decides.

    A model's vectors pass one task batch by batch, sorted by Spark; the task holds a batch
    and the centers.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaders, at = None, None
        for pdf in frames:
            numbers = []
            for name, v in zip(pdf["model"], pdf["embedding"], strict=True):
                name = None if pd.isna(name) else name
                if leaders is None or name != at:
                    leaders, at = Leaders(threshold), name
                numbers.append(leaders.add(v))
            yield pd.DataFrame({"model": pdf["model"], "id": pdf["id"], "cluster": np.array(numbers, np.int32)})

    rows = faces.select(F.col(model).cast("string").alias("model"), "id", "embedding")
    return rows.repartition("model").sortWithinPartitions("model", "id").mapInPandas(run, "model string, id long, cluster int")


def regrouped(persons: DataFrame, faces: DataFrame, threshold: float, model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(persons, faces) after throwing away what was not confirmed and clustering again.

    ``persons``: ``id, name, cover_face_id``, those without a name and a confirmed face go.
    ``faces``: ``id, person_id``; unconfirmed faces join the nearest person or cluster in the
    order of ids, clusters that start anew have negative numbers. Each face moves the centers
    that the next one meets, so a model's faces pass one task in batches, with its centers;
    with ``model``, a column of the faces, models are independent, and ``faces`` has it first.
    """
    cleared = faces.withColumn("person_id", F.when(F.col("confirmed"), F.col("person_id")))
    cleared = cleared.withColumn("of_model", F.lit("") if model is None else F.coalesce(F.col(model).cast("string"), F.lit("")))
    sure = cleared.where("person_id IS NOT NULL").select(F.col("person_id").alias("id")).distinct()
    kept = persons.where("name IS NOT NULL").unionByName(persons.where("name IS NULL").join(sure, "id", "left_semi"))
    counts = cleared.where("person_id IS NOT NULL").groupBy("person_id").agg(F.count("*").alias("n"), F.min("of_model").alias("m"))
    centers = centroids(cleared).join(counts, "person_id").select("m", F.lit(0).alias("k"), F.col("person_id").cast("long").alias("id"), F.col("centroid").alias("v"), "n")
    vector = F.col("embedding").cast("array<double>")
    loose = cleared.where("person_id IS NULL").select(
        F.col("of_model").alias("m"), F.lit(1).alias("k"), F.col("id").cast("long").alias("id"), vector.alias("v"), F.lit(1).cast("long").alias("n")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaders, names, at = Leaders(threshold), [], None
        for pdf in frames:
            models, ids, people = [], [], []
            for m, k, id_, v, n in zip(pdf["m"], pdf["k"], pdf["id"], pdf["v"], pdf["n"], strict=True):
                if m != at:
                    leaders, names, at = Leaders(threshold), [], m
                if k == 0:
                    leaders.start(v, n)
                    names.append(int(id_))
                else:
                    i = leaders.add(v)
                    models.append(m)
                    ids.append(id_)
                    people.append(names[i] if i < len(names) else len(names) - 1 - i)
            yield pd.DataFrame({"m": models, "id": np.array(ids, np.int64), "person_id": np.array(people, np.int64)})

    again = centers.unionByName(loose).repartition("m").sortWithinPartitions("m", "k", "id").mapInPandas(run, "m string, id long, person_id long")
    fixed = cleared.where("person_id IS NOT NULL").select(F.col("of_model").alias("m"), "id", F.col("person_id").cast("long").alias("person_id"))
    out = fixed.unionByName(again)
    return refreshed(kept, cleared.drop("of_model")), out.drop("m") if model is None else out.withColumnRenamed("m", model)


def section(name: Column, hidden: Column) -> Column:
    """Where a person stands: hidden, named or unnamed."""
    return F.when(hidden, "hidden").when(name.isNotNull(), "named").otherwise("unnamed")


def rename_suggestions(persons: DataFrame, typed: str, own: int, most: int = 4) -> DataFrame:
    """Up to ``most`` other people's names that hold the typed text, in any case."""
    fits = F.lower("name").contains(typed.strip().lower()) & (F.col("id") != own)
    return persons.where(fits).select("name").distinct().orderBy("name").limit(most)


@F.pandas_udf(T.StructType([T.StructField("names", T.ArrayType(T.StringType())), T.StructField("rest", T.StringType())]))
def _match(query: pd.Series, names: pd.Series) -> pd.DataFrame:
    found = [match_names(q, list(n)) for q, n in zip(query, names, strict=True)]
    return pd.DataFrame({"names": [n for n, _ in found], "rest": [r for _, r in found]})


def matched_queries(queries: DataFrame, persons: DataFrame, most_words: int = 64) -> DataFrame:
    """``query, names, rest``: people's names that stand in each query, the longest first, and what is left.

    Queries are cut into runs of as many words as names have, and met with the names by
    equality, so neither side is sent to every task and a common first word costs nothing;
    only the names that stand in a query are gathered with it. A name of over ``most_words``
    words raises an error. Null queries are left out, null and empty names match nothing.
    """
    asked = queries.select("query").where("query IS NOT NULL").distinct()
    cut = lambda c: F.array_remove(F.split(F.lower(c), r"(?U)\s+"), "")
    named = persons.where("name IS NOT NULL").select("name").distinct().withColumn("w", cut(F.col("name"))).where(F.size("w") > 0)
    counts = sorted(r[0] for r in named.select(F.size("w")).distinct().limit(most_words + 1).collect())
    if counts and counts[-1] > most_words:
        raise ValueError(f"a name has over {most_words} words")
    words = asked.withColumn("w", cut(F.col("query")))
    # a name ends with its word, or before a mark within it
    ends = lambda x: F.filter(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.when((i == F.length(x)) | F.substring(x, i + 1, F.lit(1)).isin(*",.!?"), F.substring(x, F.lit(1), i))), lambda y: y.isNotNull())
    runs = lambda n: F.when(
        F.size("w") >= n,
        F.flatten(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.transform(ends(F.element_at("w", i + n - 1)), lambda e: F.array_join(F.concat(F.slice("w", i, F.lit(n - 1)), F.array(e)), " ")))),
    )
    keys = F.flatten(F.array_compact(F.array(*(runs(n) for n in counts)))) if counts else F.array().cast("array<string>")
    met = words.select("query", F.explode(F.array_distinct(keys)).alias("key")).join(named.select("name", F.array_join("w", " ").alias("key")), "key")
    names = asked.join(met.select("query", "name"), "query", "left").groupBy("query").agg(F.collect_list("name").alias("names"))
    return names.select("query", _match("query", "names").alias("m")).select("query", "m.names", "m.rest")
