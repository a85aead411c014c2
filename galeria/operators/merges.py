"""Replaying a log of actions on people: merges as a forest in time.

A merge moves the faces of one person to another. Where these faces are moved next is the
first later merge of that other person, so merges form a forest whose edges go forward in
time. Pointers double along it (each round a join of as many rows as there are merges), and
where a person's faces are at any time is found by keyed joins: no row ever holds the log,
and no face meets a merge that does not concern it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeria.operators.running import next_event
from galeria.plans.numbering import numbered
from galeria.plans.shared import checkpoint, path_of, scratch

ACTIONS = ("confirm", "assign", "reject", "unreject", "merge")


def timed(actions: DataFrame) -> DataFrame:
    """The log (``seq, kind, face_id, person_id, other_id``) with ``at``, a number from 0 in the order of seq; equal ones by kind, then by their ids."""
    rows = actions.select("seq", "kind", *(F.col(c).cast("long").alias(c) for c in ("face_id", "person_id", "other_id")))
    return checkpoint(numbered(rows, "seq", "kind", "person_id", "other_id", "face_id", name="at"))


@dataclass
class Forest:
    """Merges and their pointers: ``rounds[j]`` has (``merge``, ``to``), the merge 2**j steps on, or the last there is."""

    merges: DataFrame
    rounds: list[DataFrame]

    @staticmethod
    def of(log: DataFrame) -> Forest:
        """The forest of a timed log. Merges of a person with itself, and of or into nobody, move nothing."""
        m = log.where("kind = 'merge' AND person_id <> other_id")
        m = checkpoint(m.select("at", F.col("other_id").alias("gone"), F.col("person_id").alias("kept")))
        starts = m.select(F.col("at").alias("merge"), F.col("kept").alias("person"), "at")
        events = m.select(F.col("gone").alias("person"), "at", F.col("at").alias("to"))
        pointers = checkpoint(next_event(starts, events, "person", "at", "to").select("merge", F.coalesce("to", "merge").alias("to")))
        rounds = [pointers]
        while True:
            here = rounds[-1]
            further = here.select(F.col("merge").alias("to"), F.col("to").alias("next"))
            new = checkpoint(here.join(further, "to").select("merge", F.col("next").alias("to")), plain=True)
            if new.join(here, ["merge", "to"], "left_anti").isEmpty():
                return Forest(m, rounds)
            rounds.append(new)

    def first(self, starts: DataFrame) -> DataFrame:
        """``starts`` (``person, since``, distinct rows) with ``merge``, the first merge that takes that person away after ``since``."""
        events = self.merges.select(F.col("gone").alias("person"), F.col("at").alias("since"), F.col("at").alias("merge"))
        return next_event(starts, events, "person", "since", "merge")

    def finally_at(self, starts: DataFrame) -> DataFrame:
        """``person, since, final``: where faces that are at ``person`` after ``since`` end up; for distinct non-null starts."""
        end = self.rounds[-1].join(self.merges.select(F.col("at").alias("to"), "kept"), "to").select("merge", "kept")
        met = checkpoint(self.first(starts.select("person", "since").where("person IS NOT NULL").distinct())).join(end, "merge", "left")
        return met.select("person", "since", F.coalesce("kept", "person").alias("final"))

    def at_time(self, starts: DataFrame) -> DataFrame:
        """``person, since, until, there``: where faces that are at ``person`` after ``since`` are just before ``until``."""
        rows = starts.select("person", "since", "until").where("person IS NOT NULL").distinct()
        first = self.first(rows.select("person", "since").distinct())
        rows = checkpoint(rows.join(first, ["person", "since"]).withColumn("merge", F.when(F.col("merge") < F.col("until"), F.col("merge"))))
        for pointers in reversed(self.rounds):
            met = rows.join(pointers, "merge", "left")
            rows = checkpoint(met.select("person", "since", "until", F.when(F.col("to") < F.col("until"), F.col("to")).otherwise(F.col("merge")).alias("merge")), plain=True)
        out = rows.join(self.merges.select(F.col("at").alias("merge"), "kept"), "merge", "left")
        return out.select("person", "since", "until", F.coalesce("kept", "person").alias("there"))


def replay(faces: DataFrame, actions: DataFrame) -> DataFrame:
    """``id, person_id, confirmed`` after a log of actions (``seq, kind, face_id, person_id, other_id``).

    confirm assigns and confirms, assign moves (undoing a swipe is the confirm or assign that
    restores the face), reject takes a face from that person, and merge moves all faces of
    ``other_id`` to ``person_id``, which end where later merges move them. Of a face's own
    actions only its last assignment and the rejections after it count, whatever came before.
    Rejections of nobody and actions of null or unknown faces do nothing; unseen kinds do
    nothing; equal ``seq`` are ordered by kind, then ids. Faces without actions and persons
    may be any number, merges too. An empty log leaves all as it is.
    """
    with scratch(faces.sparkSession) as keep:
        log = timed(actions)
        forest = Forest.of(log)
        set_ = log.where("kind IN ('confirm', 'assign') AND face_id IS NOT NULL").groupBy(F.col("face_id").alias("id"))
        set_ = set_.agg(F.max_by(F.struct(F.col("person_id").alias("p"), (F.col("kind") == "confirm").alias("c"), F.col("at").alias("t")), "at").alias("last"))
        rows = faces.select("id", F.col("person_id").cast("long").alias("p"), F.col("confirmed").alias("c"), F.lit(-1).cast("long").alias("t"))
        rows = rows.join(set_, "id", "left").select("id", *(F.when(F.col("last").isNull(), F.col(x)).otherwise(F.col(f"last.{x}")).alias(x) for x in "pct"))
        rows = checkpoint(rows)

        rejected = log.where("kind = 'reject' AND person_id IS NOT NULL").select(F.col("face_id").alias("id"), F.col("person_id").alias("no"), F.col("at").alias("until"))
        asked = checkpoint(rejected.join(rows, "id").where("until > t").select("id", "no", F.col("p").alias("person"), F.col("t").alias("since"), "until"))
        there = forest.at_time(asked)
        hit = asked.join(there, ["person", "since", "until"]).where("there = no").select("id").distinct()
        rows = rows.join(hit.withColumn("hit", F.lit(True)), "id", "left").select(
            "id", F.when(F.col("hit").isNull(), F.col("p")).alias("person"), F.when(F.col("hit"), False).otherwise(F.col("c")).alias("confirmed"), F.col("t").alias("since")
        )
        rows = checkpoint(rows)
        out = checkpoint(rows.join(forest.finally_at(rows), ["person", "since"], "left").select("id", F.col("final").alias("person_id"), "confirmed"))
        keep.add(path_of(out))
    return out


def replay_rejections(rejections: DataFrame, actions: DataFrame) -> DataFrame:
    """Distinct ``face_id, person_id`` after the log: merges move rejections along, reject adds one and unreject takes one away.

    A face that both persons of a merge reject keeps one rejection. unreject names the
    person that the face's rejection is at by then; a later reject adds it again. Rows with
    a null are dropped.
    """
    with scratch(rejections.sparkSession) as keep:
        log = timed(actions)
        forest = Forest.of(log)
        given = rejections.select(F.col("face_id").cast("long").alias("face_id"), F.col("person_id").cast("long").alias("person"), F.lit(-1).cast("long").alias("since"))
        own = log.where("kind = 'reject'").select("face_id", F.col("person_id").alias("person"), F.col("at").alias("since"))
        rows = checkpoint(given.unionByName(own).where("face_id IS NOT NULL AND person IS NOT NULL"))
        undone = log.where("kind = 'unreject'").select("face_id", F.col("person_id").alias("no"), F.col("at").alias("until"))
        asked = checkpoint(rows.join(undone, "face_id").where("until > since"))
        there = forest.at_time(asked)
        gone = asked.join(there, ["person", "since", "until"]).where("there = no").select("face_id", "person", "since").distinct()
        rows = checkpoint(rows.join(gone, ["face_id", "person", "since"], "left_anti"))
        out = rows.join(forest.finally_at(rows), ["person", "since"]).select("face_id", F.col("final").alias("person_id")).distinct()
        out = checkpoint(out)
        keep.add(path_of(out))
    return out


def replay_persons(persons: DataFrame, actions: DataFrame) -> DataFrame:
    """``id, name`` of the persons that are left after the log's merges.

    A merge deletes ``other_id``; a person without a name takes the name of the one that
    goes, if it has one. So a person's name is its own, or that of the first person merged
    into it that brings one, its own or one it took before. A person goes once, with its
    first merge; merges of a person with itself and of or into nobody do nothing.
    """
    with scratch(persons.sparkSession) as keep:
        log = timed(actions)
        gone = log.where("kind = 'merge' AND person_id <> other_id").groupBy(F.col("other_id").alias("id"))
        gone = gone.agg(F.min(F.struct("at", F.col("person_id").alias("kept"))).alias("m")).select("id", "m.at", "m.kept")
        people = persons.select(F.col("id").cast("long").alias("id"), "name").dropDuplicates(["id"])
        people = checkpoint(people.join(gone, "id", "left").select("id", "name", "at", "kept"))

        # whoever has a named person below: marks go up by 1, 2, 4 ... merges
        up = checkpoint(people.where("kept IS NOT NULL").select("id", F.col("kept").alias("to")))
        marked = checkpoint(people.where("name IS NOT NULL").select("id"))
        while not up.isEmpty():
            marked = checkpoint(marked.union(marked.join(up, "id").select(F.col("to").alias("id"))).distinct(), plain=True)
            up = checkpoint(up.join(up.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")), plain=True)

        # an unnamed person looks at the first below that brings a name, and so on down to a named one
        first = people.where("kept IS NOT NULL").join(marked, "id", "left_semi").groupBy(F.col("kept").alias("id")).agg(F.min_by("id", "at").alias("first"))
        down = people.join(first, "id", "left").select("id", F.when(F.col("name").isNull(), F.col("first")).alias("to"))
        down = checkpoint(down.select("id", F.coalesce("to", "id").alias("to")))
        while True:
            new = checkpoint(down.join(down.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")), plain=True)
            if new.join(down, ["id", "to"], "left_anti").isEmpty():
                break
            down = new
        names = people.select(F.col("id").alias("to"), "name")
        out = checkpoint(people.where("kept IS NULL").select("id").join(down, "id").join(names, "to").select("id", "name"))
        keep.add(path_of(out))
    return out
