"""Personal data: candidate generators, boosted trees and calibrated thresholds, in DataFrame functions.

High-recall generators propose overlapping spans with features of their form and context;
boosted trees, trained on texts made by rule, score each candidate; a threshold per kind,
calibrated on held-out made texts, selects. Spans that meet the base definitions always
stay. Trees become CASE expressions, so the whole scan runs in the JVM, row by row.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeria.llm.common import fresh, running, table

# Kinds in their order; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
LOCAL = "A-Za-z0-9._%+-"
#: kind: (gate, pattern). Possessive repeats give the same matches as greedy ones here, in linear time and flat stacks;
#: a start inside a run of the first class can only match what the run's start matches, or what follows a match (\G).
BASE = {
    "email": ("@", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("[0-9][ -]?[0-9]", "[0-9](?:[ -]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
}
SET = r"(?i:password|passwd|pwd|secret|token|api[_ -]?key|credentials?)"
RUN = "A-Za-z0-9_+/-"
#: (kind, gates, pattern); every match's text passes all of the gates. Secrets: what is set as a password or token, long runs of
#: letters and digits, marks of private keys. Patterns look first for what is rare or at the borders of words.
MORE = (
    ("email", (r"(?i)\bat\b",), r"(?i)\b[a-z0-9._-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[a-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[a-z0-9-]{1,63}){1,4}"),
    ("phone", ("[0-9]{3}[ .-][0-9]{3}",), r"(?<![0-9+.-])(?:00[0-9]{1,3}[ .-])?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])"),
    ("ssn", ("[0-9]-[0-9]{2}-[0-9]",), r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("iban", ("[A-Z]{2}[0-9]{2}",), r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("secret", (rf"[:=](?<={SET}[\"']{{0,1}} {{0,2}}[:=])",), rf"(?<=[:= \"'])(?<={SET}[\"']{{0,1}} {{0,2}}[:=] {{0,2}}[\"']{{0,1}})[^\s\"',;]{{6,128}}"),
    ("secret", ("-----BEGIN ",), "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    ("secret", ("[0-9]", f"(?<![{RUN}])[{RUN}]{{20}}"),
     rf"(?<![=.{RUN}])(?=[A-Za-z_+/-]{{0,40}}[0-9])(?=[0-9_+/-]{{0,40}}[A-Za-z])[{RUN}]{{20,512}}+(?:\.[A-Za-z0-9_-]{{16,2048}}+){{0,2}}={{0,2}}"),
)
FOR = "(?i)(?:tel|phone|call|fax|mobile|contact|mail|write to|reach|ip|address|host|card|visa|payment|ssn|social security|iban|account|token|key|secret|password|bearer)[^a-z0-9]{0,4}(?:is|at|no|number|of)?[^a-z0-9]{0,3}$"
AGAINST = "(?i)(?:version|release|ver|v|build|isbn|order|ticket|invoice|section|figure|table|page|chapter|serial|part|id|commit|checksum|sha|md5|hash|digest|revision|etag)[^a-z0-9]{0,4}(?:is|no|number)?[^a-z0-9]{0,3}$"
FEATURES = (
    "kind", "length", "digits", "letters", "marks", "valid", "for_it", "against", "joined_before", "joined_after", "groups",
    "uppers", "hexadecimal", "set_before",
)


def digits_of(c: Column) -> Column:
    """The digits of a string."""
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(d)

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, n - i, F.lit(1)).cast("int") * (i % 2 + 1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    d = digits_of(m)
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(d).between(10, 15)
    return F.lit(True)


FOUND = "struct<start:int,end:int,kind:int,base:boolean,value:string,f:struct<" + ",".join(f"{x}:double" for x in FEATURES) + ">>"


def _generate(text: Column, kind: str, gates: tuple[str, ...], pattern: str, base: bool) -> Column:
    """All matches of one generator: an array of ``FOUND``."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    # As arguments of lambdas the matches and the pieces between them are made once a text, the pieces only if needed.
    def around(m: Column) -> Column:
        n = F.size(m)
        return F.transform(F.array(pieces), lambda p: F.arrays_zip(m.alias("m"), F.slice(p, F.lit(1), n).alias("before"), F.slice(p, F.lit(2), n).alias("after")))[0]

    zipped = F.transform(F.array(found), lambda m: F.when(F.size(m) > 0, around(m)))[0]

    def one(x: Column, passed: Column) -> Column:
        m, start = x["m"], passed + F.length(x["before"])
        end = start + F.length(m)
        before, after = F.right(x["before"], F.lit(24)), F.substring(x["after"], 1, 1)
        digits = F.length(digits_of(m))
        letters = F.length(F.regexp_replace(m, "[^A-Za-z]", ""))
        valid = _valid(kind, m)
        numbers = {
            "kind": F.lit(KINDS.index(kind)), "length": F.length(m), "digits": digits, "letters": letters,
            "marks": F.length(m) - digits - letters, "valid": valid.cast("int"), "for_it": before.rlike(FOR).cast("int"),
            "against": before.rlike(AGAINST).cast("int"), "joined_before": before.rlike("[A-Za-z0-9./_-]$").cast("int"),
            "joined_after": after.rlike("^[A-Za-z0-9/_-]").cast("int"), "groups": F.size(F.split(m, "[^A-Za-z0-9]+")),
            "uppers": F.length(F.regexp_replace(m, "[^A-Z]", "")), "hexadecimal": m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("int"),
            "set_before": before.rlike("[:=][\"' ]{0,3}$").cast("int"),
        }
        return F.struct(
            start.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), (valid & F.lit(base)).alias("base"),
            m.alias("value"), F.struct(*(v.cast("double").alias(k) for k, v in numbers.items())).alias("f"),
        )

    def placed(z: Column) -> Column:
        lengths = F.transform(z, lambda x: F.length(x["before"]) + F.length(x["m"]))
        return F.transform(F.arrays_zip(z.alias("x"), running(lengths, lambda u, v: u + v).alias("passed")), lambda y: one(y["x"], y["passed"]))

    none = F.from_json(F.lit("[]"), f"array<{FOUND}>")
    all_ = F.transform(F.array(zipped), placed)[0]
    out = F.coalesce(all_, none)
    for gate in reversed(gates):
        out = F.when(text.rlike(gate), out).otherwise(none)
    return out


def candidates(text: Column) -> Column:
    """Every generator's spans with features, in no special order; null texts count as empty."""
    text = F.coalesce(text, F.lit(""))
    own = (_generate(text, kind, (gate,), pattern, True) for kind, (gate, pattern) in BASE.items())
    return F.concat(*own, *(_generate(text, *more, False) for more in MORE))


@dataclass(frozen=True)
class Trees:
    """Boosted regression trees on log odds; a tree is (feature, cut, below, above) or a number."""

    trees: tuple
    bias: float

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3) -> Trees:
        """Newton boosting of the logistic loss with exact splits, for a bounded number of rows."""
        bias = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        z, trees = np.full(len(y), bias), []

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
            gs, hs = g[rows].sum(), h[rows].sum() + 1.0
            best = (1e-6, None, None)
            for f in range(x.shape[1]) if left else ():
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, cg, ch = x[order, f], np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
                gain = cg**2 / (ch + 1.0) + (gs - cg) ** 2 / (hs - ch) - gs**2 / hs
                gain[v[1:] == v[:-1]] = -1
                if len(gain) and gain.max() > best[0]:
                    i = int(gain.argmax())
                    best = (gain[i], f, (v[i] + v[i + 1]) / 2)
            if best[1] is None:
                return float(-rate * gs / hs)
            below = x[rows, best[1]] < best[2]
            return best[1], float(best[2]), grow(rows[below], g, h, left - 1), grow(rows[~below], g, h, left - 1)

        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z))
            trees.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth))
            z = z + np.array([Trees._walk(trees[-1], r) for r in x])
        return Trees(tuple(trees), bias)

    @staticmethod
    def _walk(tree, row: np.ndarray) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
        return tree

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, row by row."""
        return np.array([1 / (1 + np.exp(-self.bias - sum(self._walk(t, r) for t in self.trees))) for r in x])

    def column(self, f: Column) -> Column:
        """The probability as an expression over a struct of features."""

        def case(tree) -> Column:
            return F.when(f[FEATURES[tree[0]]] < tree[1], case(tree[2])).otherwise(case(tree[3])) if isinstance(tree, tuple) else F.lit(tree)

        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + case(tree)
        return 1 / (1 + F.exp(-total))


def _spans(r: random.Random) -> tuple[dict, dict]:
    """Makers of personal data by kind, and of what looks like a kind and is none."""
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    some = lambda k, letters: "".join(r.choice(letters) for _ in range(k))
    word = lambda: some(r.randint(3, 9), "abcdefghilmnoprstu")
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def card() -> str:
        body = d(r.choice((13, 14, 15)))
        total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body)))
        body += str(-total % 10)
        return r.choice((body, " ".join(body[i : i + 4] for i in range(0, len(body), 4))))

    real = {
        "email": lambda: r.choice((f"{word()}.{word()}@{word()}.{r.choice(('com', 'org', 'de'))}", f"{word()} {r.choice(('(at)', '[at]'))} {word()} {r.choice(('(dot)', '[dot]'))} com")),
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: r.choice((f"+{r.randint(1, 99)} {d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}")),
        "ssn": lambda: f"{d(3)}-{d(2)}-{d(4)}",
        "iban": lambda: f"{r.choice(('DE', 'FR', 'ES'))}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}",
        "secret": lambda: r.choice((some(40, "0123456789abcdef"), some(32, "0123456789abcdef"), some(r.randint(24, 64), mixed), "sk_live_" + some(24, mixed), "AKIA" + some(16, mixed[:26] + "0123456789"))),
    }
    false = {
        "version": lambda: ".".join(str(r.randint(0, 900)) for _ in range(4)),
        "number": lambda: d(r.randint(2, 22)),
        "serial": lambda: r.choice((f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"AB{d(2)}CDEF{d(4)}GHIJ")),
        "growth": lambda: f"+{d(r.randint(2, 6))}",
        "place": lambda: f"{word()} at {word()} dot {word()}",
        "date": lambda: f"{d(2)} {d(2)} {d(4)} {d(1)}",
        "digest": lambda: r.choice((some(40, "0123456789abcdef"), some(64, "0123456789abcdef"))),
        "path": lambda: "/".join(word() for _ in range(r.randint(3, 6))) + f"/{d(4)}-{word()}-{word()}",
        "name": lambda: "_".join(word() for _ in range(r.randint(3, 5))) + d(2),
    }
    return real, false


#: Words ahead of a span in the training texts: those of the context features are only some of them.
LEADS = {
    "email": ("mail me at", "write to", "contact:", "and", "ask", "cc", "from our colleague"), "ip": ("host", "from", "the", "ping", "connected to", "client", "and", "at"),
    "card": ("card", "visa", "with", "paid by", "charged to", "on file:", "and"), "phone": ("call", "tel.", "or", "ring", "text me on", "my cell", "dial"),
    "ssn": ("ssn", "social security number", "SSN:", "her ssn"), "iban": ("iban", "IBAN:", "account", "transfer to", "bank details:"),
    "secret": ("token =", "api_key:", "secret:", "password is", "export KEY=", 'auth "', "credentials", "with the key"),
    "version": ("version", "release", "build", "section", "upgraded to", "firmware"), "number": ("order", "ticket", "of", "in", "counted", "about"),
    "serial": ("order", "part", "serial", "isbn", "item", "lot", "ticket id"), "growth": ("rose by", "grew", "score", "gained"), "place": ("we met", "stay", "she stood"),
    "date": ("on", "page", "figure", "table", "since"), "digest": ("commit", "sha", "checksum", "merged", "object", "md5sum:"), "path": ("in", "see", "under", "open"),
    "name": ("call", "the column", "rename", "field"),
}
#: Sentences of the texts that thresholds are calibrated on; none of them stands in the training texts.
SENTENCES = {
    "email": ("Our helpdesk ({}) answers within a day", "signed, {}", "Reply-To: {}"), "ip": ("Request by {} was denied", "gateway {} timed out", "the router answers on {}"),
    "card": ("he dictated {} to the clerk", "expiry 09/27, {}, security code", "Number on the front: {}"), "phone": ("her direct line, {}, rang all day", "For bookings {}", "switchboard {}"),
    "ssn": ("applicant's SSN {} was verified", "social security no. {}"), "iban": ("please wire the rent to {} by Friday", "Beneficiary {}"),
    "secret": ("Authorization: Bearer {}", 'token = "{}"', "aws_secret_access_key = {}", "the api key {} leaked"), "version": ("Since kernel {} this is fixed", "app {} requires an update"),
    "number": ("roughly {} people came", "the sum is {}", "invoice {}"), "serial": ("catalogue item {} is sold out", "parcel {} left the depot", "part number {}"), "growth": ("it went up {} points",),
    "place": ("they lived {} for years",), "date": ("recorded on {} in Rome",), "digest": ("reverted in commit {}", "sha256 {}", "git checkout {}"), "path": ("the file {} is missing", "docs/{}"),
    "name": ("the variable {} is unused",),
}


def made_texts(n: int = 1600, seed: int = 11, held_out: bool = False) -> list[tuple[str, int, int, int]]:
    """Labelled texts by rule: (text, start, end, kind of the personal data there or -1).

    ``held_out``: texts of another kind, sentences around the span instead of words ahead of it.
    """
    r = random.Random(seed)
    real, false = _spans(r)
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 9)))
    out = []
    for i in range(n):
        name = r.choice(list(real if i % 2 else false))
        span = (real if i % 2 else false)[name]()
        if held_out:
            head, tail = r.choice(SENTENCES[name]).split("{}")
            head = r.choice(("", "Note. ", word().capitalize() + " " + word() + ". ")) + head
        else:
            lead = r.choice(LEADS[name])
            head = " ".join(word() for _ in range(r.randint(1, 6))) + " " + lead + ("" if lead.endswith(('"', "=")) and r.random() < 0.5 else " ")
            tail = r.choice((" ", ". ", ", ", '" ')) + word()
        out.append((head + span + tail, len(head), len(head) + len(span), KINDS.index(name) if name in real else -1))
    return out


def examples(spark: SparkSession, made: list[tuple[str, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of every candidate in made texts."""
    made = spark.createDataFrame([(*x, k) for k, x in enumerate(made)], "text string, a int, b int, y int, k int")
    rows = made.select("a", "b", "y", "k", F.explode(candidates(F.col("text"))).alias("c")).orderBy("k", "c.start", "c.kind").collect()
    x = np.array([[r["c"]["f"][f] for f in FEATURES] for r in rows])
    return x, np.array([float(r["y"] == r["c"]["kind"] and r["c"]["start"] < r["b"] and r["c"]["end"] > r["a"]) for r in rows])


@lru_cache(maxsize=4)
def _model(app: str, precision: float) -> tuple[Trees, tuple[float, ...]]:
    spark = SparkSession.getActiveSession()
    trees = Trees.fit(*examples(spark, made_texts()))
    x, y = examples(spark, made_texts(seed=12, held_out=True))
    p, cuts = trees.predict(x), []
    for kind in range(len(KINDS)):
        own = x[:, 0] == kind
        good = [t for t in np.arange(0.3, 0.96, 0.05) if (p[own] >= t).any() and y[own][p[own] >= t].mean() >= precision]
        cuts.append(float(min(good, default=0.95)))
    return trees, tuple(cuts)


def model(spark: SparkSession, precision: float = 0.9) -> tuple[Trees, tuple[float, ...]]:
    """The trees and each kind's threshold: the least one of the asked precision on made texts of another kind than the training's."""
    return _model(spark.sparkContext.applicationId, precision)


SPAN = "array<struct<start:int,end:int,kind:string,base:boolean,score:double>>"


def find(docs: DataFrame, text: str = "text", precision: float = 0.9) -> tuple[DataFrame, str]:
    """``docs`` with ``spans``: array of struct<start, end, kind, base, score>, by start, then kind.

    Offsets are code points, end exclusive. Base spans always stay (score 1); others are
    candidates over their kind's threshold that lie in no span before them. Null and empty
    texts have none; repeated rows each keep their row.
    """
    trees, cuts = model(docs.sparkSession, precision)
    spans, found = fresh(docs, "spans"), fresh(docs, "candidates")
    out = docs.withColumn(found, candidates(F.col(f"`{text}`")))

    def scored(c: Column) -> Column:
        score = F.when(c["base"], F.lit(1.0)).otherwise(trees.column(c["f"]))
        return F.struct(c["start"].alias("start"), (-c["end"]).alias("minus_end"), (~c["base"]).alias("added"), c["kind"].alias("kind"), score.alias("score"))

    def selected(s: Column) -> Column:
        cut = F.lit(2.0)
        for k, v in enumerate(cuts):
            cut = F.when(s["kind"] == k, v).otherwise(cut)
        return ~s["added"] | (s["score"] >= cut)

    def apart(all_: Column) -> Column:
        reach = running(F.transform(all_, lambda s: -s["minus_end"]), lambda u, v: F.greatest(u, v))
        kept = F.filter(F.arrays_zip(all_.alias("s"), reach.alias("to")), lambda z: ~z["s"]["added"] | (-z["s"]["minus_end"] > z["to"]))
        return F.transform(kept, lambda z: F.struct(z["s"]["start"].alias("start"), z["s"]["kind"].alias("n"), (-z["s"]["minus_end"]).alias("end"), (~z["s"]["added"]).alias("base"), z["s"]["score"].alias("score")))

    named = F.array(*(F.lit(k) for k in KINDS))
    kept = F.transform(F.array(F.array_sort(F.filter(F.transform(found, scored), selected))), apart)[0]
    final = F.transform(
        F.array_sort(kept),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(named, s["n"] + 1).alias("kind"), s["base"].alias("base"), s["score"].alias("score")),
    )
    out = out.withColumn(spans, F.when(F.size(found) > 0, final).otherwise(F.from_json(F.lit("[]"), SPAN)))
    return out.drop(found), spans


def redact(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one."""
    out, spans = find(docs, text, **options)
    t = F.col(f"`{text}`")

    def cleaned(all_: Column) -> Column:
        reach = running(F.transform(all_, lambda s: s["end"]), lambda u, v: F.greatest(u, v))

        def piece(s: Column, to: Column) -> Column:
            return F.when(s["start"] >= to, F.concat(F.substring(t, to + 1, s["start"] - to), F.lit("["), s["kind"], F.lit("]"))).otherwise("")

        return F.concat(F.array_join(F.zip_with(all_, reach, piece), ""), F.substring(t, F.array_max(all_["end"]) + 1, F.length(t)))

    clean = F.transform(F.array(F.col(spans)), cleaned)[0]
    return out.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(t)).drop(spans)


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of every document's base spans, and all spans."""
    docs, spans = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter(spans, lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:4]]
    secrets = F.size(F.filter(spans, lambda s: s["kind"] == "secret")).cast("long").alias("n_secret")
    all_ = F.size(spans).cast("long").alias("n_spans")
    return docs.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans"), secrets, all_)
