"""URL filters through Bloom filter cascades: exact membership over a known universe of keys.

The first level of a cascade encodes the listed keys; the second one those other keys of
the corpus that the first lets through by mistake; the third one the listed keys that the
second lets through, and so on until a level makes no mistake. Over all keys of the corpus
the number of levels a key passes then tells membership exactly, without a join: levels
are bit arrays, constants of the plan.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeria.llm.common import checkpoint, fresh, scratch, table

# Fixed values of the query's rules: verdict by host and path.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: Hosts with one of these words in a label are listed for blocking where no rule fits.
WORDS = ("spam", "casino", "adult", "porn", "malware", "phishing", "warez", "torrent", "clickbait", "tracker")
#: What marks a title as junk, and how far a host's share of such pages must exceed that of all pages.
JUNK, EXCESS = r"<title>[^<]*([*][*][*]|###|%%%)", 3
#: Bits of one level that a plan may carry as a constant (2 MiB); see ``Cascade``.
MAX_BITS = 1 << 24
#: Shapes (labels of the host, length of the path) that a table of rules may have, and numbers of labels that listed hosts may.
MAX_SHAPES = 500


class Cascade:
    """Exact membership of a universe's keys in a list.

    ``universe`` has a string column ``key`` without nulls or repeats and a boolean column
    ``listed``. Levels are sized by counts; only their bits come to the driver, at most
    ``max_bits`` each. A list too long for that bound is split by the key's hash into parts
    with a cascade each until every level fits; more than ``max_parts`` raise an error.
    """

    def __init__(self, universe: DataFrame, max_bits: int = MAX_BITS, seed: int = 0, max_parts: int = 64) -> None:
        n = universe.agg(F.count_if("listed").alias("r"), F.count_if(~F.col("listed")).alias("s")).first()
        self.parts = 1
        while self._size(n["r"], n["s"])[0] > max_bits * self.parts:
            self.parts *= 2
        if self.parts > max_parts:
            raise ValueError(f"{n['r']} listed keys need over {max_parts} parts of {max_bits} bits")
        with scratch(universe.sparkSession):
            self.levels = [self._build(universe, part, seed) for part in range(self.parts)]

    @staticmethod
    def _size(inside: int, outside: int) -> tuple[int, int]:
        """Bits and hashes for a mistake rate that balances this level with the next."""
        rate = min(0.5, max(1e-9, math.sqrt(0.5) * inside / max(1, outside)))
        bits = math.ceil(1.45 * max(1, inside) * math.log2(1 / rate) / 64) * 64
        return max(64, bits), max(1, round(math.log2(1 / rate)))

    @staticmethod
    def _places(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
        a, b = F.xxhash64(key, F.lit(seed)), F.xxhash64(key, F.lit(seed + 1)).bitwiseOR(F.lit(1))
        start = [F.pmod(a.bitwiseXOR(F.lit(i * 0x9E3779B97F4A7)), F.lit(bits)) for i in range(hashes)]
        step = F.pmod(F.shiftrightunsigned(b, 17), F.lit(bits))  # both below ``bits``: no sum leaves 64 bits
        return [F.pmod(s + step * F.lit(i), F.lit(bits)) for i, s in enumerate(start)]

    def _part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-7)), F.lit(self.parts))

    def _build(self, universe: DataFrame, part: int, seed: int) -> list[tuple[int, int, int, bytes]]:
        rows = universe.where(self._part(F.col("key")) == part)
        inside, outside = rows.where("listed").select("key"), rows.where("NOT listed").select("key")
        n, rest = inside.count(), outside.count()
        levels: list[tuple[int, int, int, bytes]] = []
        while n:
            bits, hashes = self._size(n, rest)
            at = seed + 1000 * part + 10 * len(levels)
            places = inside.select(F.explode(F.array(*self._places(F.col("key"), bits, hashes, at))).alias("p"))
            words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
            got, held = words.toArrow(), np.zeros(bits // 64, "<i8")
            held[got["w"].to_numpy()] = got["b"].to_numpy()
            levels.append((bits, hashes, at, held.tobytes()))
            passed = checkpoint(outside.where(self._passes(F.col("key"), levels[-1])))
            inside, outside, n, rest = passed, inside, passed.count(), n
        return levels

    def _passes(self, key: Column, level: tuple[int, int, int, bytes]) -> Column:
        bits, hashes, seed, held = level

        def all_set(b: Column) -> Column:
            out = F.lit(True)
            for p in self._places(key, bits, hashes, seed):
                byte = F.ascii(F.decode(F.substring(b, (F.shiftright(p, 3) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
                out = out & (F.call_function("getbit", byte, p.bitwiseAND(F.lit(7)).cast("int")) == 1)
            return out

        return F.transform(F.array(F.lit(held)), all_set)[0]  # the bits stand in the plan once a level

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed; any answer for other keys; false for null."""

        def parity(levels: list) -> Column:
            out = F.lit(len(levels) % 2 == 1)
            for i in reversed(range(len(levels))):
                out = F.when(self._passes(key, levels[i]), out).otherwise(F.lit(i % 2 == 1))
            return out

        out = parity(self.levels[0])
        for part in range(1, self.parts):
            out = F.when(self._part(key) == part, parity(self.levels[part])).otherwise(out)
        return F.coalesce(out & key.isNotNull(), F.lit(False))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path of a URL; both empty for null or without ``://``."""
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, pattern, 2)


def shapes_of(rules: DataFrame) -> list[tuple[int, int]]:
    """The distinct (labels of the host, length of the path) of rules "host/path prefix", longest first.

    Each is an expression of the plan, so over ``MAX_SHAPES`` raise an error.
    """
    host = F.substring_index("rule", "/", 1)
    labels, length = F.size(F.split(host, r"\.")), F.length("rule") - F.length(host)
    found = rules.select(labels, length).distinct().limit(MAX_SHAPES + 1).collect()
    if len(found) > MAX_SHAPES:
        raise ValueError(f"the rules have over {MAX_SHAPES} shapes")
    return sorted({(r[0], r[1]) for r in found}, reverse=True)


def rule_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """All strings host suffix + path prefix of the rules' shapes, longest first, of equally long ones that of the longer host first."""
    if not shapes:
        return F.array().cast("array<string>")
    known = F.from_json(F.lit(json.dumps([{"labels": a, "length": b} for a, b in shapes])), "array<struct<labels:int,length:int>>")
    labels = F.length(host) - F.length(F.replace(host, F.lit("."))) + 1
    fits = F.filter(known, lambda x: (x["labels"] <= labels) & (x["length"] <= F.length(path)))
    keys = F.transform(fits, lambda x: F.concat(_suffix(host, x["labels"]), F.substring(path, F.lit(1), x["length"])))
    own = lambda k: F.length(F.substring_index(k, "/", 1))
    return F.array_sort(keys, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).otherwise(own(b) - own(a)))


def _suffix(host: Column, labels: Column) -> Column:
    """The last labels of a host, or all of it."""
    return F.call_function("substring_index", host, F.lit("."), -labels)


def filter_urls(
    pages: DataFrame, rules: dict[str, str] | DataFrame, blocked: DataFrame | None = None, url: str = "url", max_bits: int = MAX_BITS
) -> tuple[DataFrame, tuple[str, str, str, str]]:
    """``pages`` with host, path, rule and verdict; returns the frame and these names.

    ``rules`` maps "host/path prefix" to allow or block, as a dict or as a table (rule,
    verdict); the longest that fits decides, of equally long ones that of the longer host;
    a rule under both verdicts blocks. ``blocked`` is a table whose first column lists
    hosts, of any number of labels, nulls and repeats allowed; a page that no rule fits is
    blocked if its host or a parent domain is listed. Membership comes from one cascade over
    all keys of the pages, tagged by what they are: tables meet only on distinct keys, never
    with the pages. Null URLs and those without ``://`` have empty host and path and are
    allowed unless the empty host is listed. Repeated rows each keep their row; an empty
    table gives no rows.
    """
    spark = pages.sparkSession
    names = tuple(fresh(pages, c) for c in ("host", "path", "rule", "verdict"))
    if isinstance(rules, dict):
        rules = spark.createDataFrame(list(rules.items()), "rule string, verdict string")
    rules = rules.select("rule", "verdict").where("rule IS NOT NULL").groupBy("rule").agg(F.max("verdict").alias("verdict"))
    shapes = shapes_of(rules)
    h, p = host_and_path(F.col(f"`{url}`"))
    host, path, rule, verdict = (F.col(f"`{c}`") for c in names)
    tagged = lambda tag, key: F.concat(F.lit(tag), key)
    counts: list[int] = []
    with scratch(spark):
        listed = rules.select(tagged(ALLOWED, F.col("rule")).alias("key")).where("verdict = 'allow'").union(rules.where("verdict = 'block'").select(tagged(BLOCKED, F.col("rule"))))
        hosts = pages.select(h.alias("host"), p.alias("path"))
        keys = F.transform(rule_keys(F.col("host"), F.col("path"), shapes), lambda k: F.array(tagged(ALLOWED, k), tagged(BLOCKED, k)))
        keys = F.flatten(keys)
        if blocked is not None:
            own = checkpoint(blocked.select(F.col(f"`{blocked.columns[0]}`").alias("key")).where("key IS NOT NULL").distinct())
            counts = sorted(r[0] for r in own.select(F.size(F.split("key", r"\."))).distinct().limit(MAX_SHAPES + 1).collect())
            if len(counts) > MAX_SHAPES:
                raise ValueError(f"the listed hosts have over {MAX_SHAPES} numbers of labels")
            listed = listed.union(own.select(tagged(HOST, F.col("key"))))
            keys = F.concat(keys, F.transform(_suffixes(F.col("host"), counts), lambda k: tagged(HOST, k)))
        universe = hosts.select(F.explode(F.array_distinct(keys)).alias("key")).distinct()
        universe = universe.join(listed.withColumn("listed", F.lit(True)), "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))
        cascade = Cascade(checkpoint(universe), max_bits)

    keys_name, verdicts = fresh(pages, "rule_keys"), fresh(pages, "rule_hits")
    out = pages.withColumns({names[0]: h, names[1]: p})
    out = out.withColumn(keys_name, rule_keys(host, path, shapes))

    def judged(key: Column) -> Column:
        tag = F.transform(F.array(F.lit(BLOCKED), F.lit(ALLOWED)), lambda t: F.when(cascade.contains(F.concat(t, key)), t))
        return F.struct(key.alias("key"), F.get(F.array_compact(tag), F.lit(0)).alias("tag"))

    hits = F.filter(F.transform(F.col(f"`{keys_name}`"), judged), lambda x: x["tag"].isNotNull())
    out = out.withColumn(verdicts, F.get(hits, F.lit(0)))
    hit = F.col(f"`{verdicts}`")
    rest = F.when(F.exists(F.transform(_suffixes(host, counts), lambda k: F.concat(F.lit(HOST), k)), cascade.contains), "block").otherwise("allow") if counts else F.lit("allow")
    decided = F.when(hit["tag"] == BLOCKED, "block").when(hit["tag"] == ALLOWED, "allow").otherwise(rest)
    out = out.withColumns({names[2]: hit["key"], names[3]: decided})
    return out.drop(keys_name, verdicts), names


#: What a key of the cascade is.
ALLOWED, BLOCKED, HOST = "a ", "b ", "h "


def _suffixes(host: Column, counts: list[int]) -> Column:
    """The host's suffixes of so many labels each, the host itself where it has no more."""
    return F.array_distinct(F.transform(F.from_json(F.lit(json.dumps(counts)), "array<int>"), lambda n: _suffix(host, n)))


def listed_host(host: Column) -> Column:
    """The condition that lists hosts: a listed word stands between dots or hyphens."""
    return host.rlike("(^|[.-])(" + "|".join(WORDS) + ")([.-]|$)")


def block_list(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """A table of hosts to block: those of the pages with a listed word, and those whose pages' titles hold junk.

    A host is listed if the share of its pages with a run of marks in the title is over
    ``EXCESS`` times the share among all pages; null pages have none.
    """
    host, _ = host_and_path(F.col(f"`{url}`"))
    junk = F.coalesce(F.col(f"`{html}`").rlike(JUNK), F.lit(False)).cast("int")
    counts = checkpoint(pages.select(host.alias("host"), junk.alias("junk")).groupBy("host").agg(F.count("*").alias("n"), F.sum("junk").alias("junk")))
    whole = counts.agg(F.sum("n").alias("n"), F.sum("junk").alias("junk")).first()
    over = F.col("junk") * F.lit(whole["n"] or 0) > F.lit(EXCESS * (whole["junk"] or 0)) * F.col("n")
    return counts.where(listed_host(F.col("host")) | over).select("host")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    with scratch(spark):
        pages, (host, path, rule, verdict) = filter_urls(pages, RULES, block_list(pages))
    return pages.select("page_id", *(F.col(c).alias(n) for c, n in ((host, "host"), (path, "path"), (rule, "rule"), (verdict, "verdict"))))


_VALUES = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in RULES.items())
ORACLE_SQL = f"""
WITH split AS (
  SELECT row_number() OVER () AS n, page_id, coalesce(regexp_matches(html, '{JUNK}'), false) AS junk,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
rules(rule, rule_host, rule_path, verdict) AS (VALUES {_VALUES}),
best AS (
  SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY n),
per AS (SELECT host, count(*) AS pages, count(*) FILTER (junk) AS junk FROM split GROUP BY 1),
bad AS (SELECT host FROM per, (SELECT sum(pages) AS p, sum(junk) AS j FROM per) WHERE regexp_matches(host, '(^|[.-])({"|".join(WORDS)})([.-]|$)') OR per.junk * p > {EXCESS} * j * per.pages)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN EXISTS (SELECT 1 FROM bad WHERE split.host = bad.host OR ends_with(split.host, '.' || bad.host)) THEN 'block' ELSE 'allow' END) AS verdict
FROM split LEFT JOIN best USING (n)
"""
