"""Sharding by a Feistel permutation, with cycle walking, over global row numbers.

Rows are numbered 0 to n - 1 in the order of (key, size, CRC-32 of the text); a keyed
permutation of these numbers is the shuffle. Position p lies in shard p mod k at slot
p div k, so a row's place is computed from its number alone, the shards' counts are at most
one apart (the law ``rows``), and slots have no gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeria.llm.common import fresh, table
from galeria.plans.numbering import counted


def _mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(x: np.ndarray, n: np.ndarray | int, key: np.ndarray | int = 0, rounds: int = 6, inverse: bool = False) -> np.ndarray:
    """A keyed bijection of 0 .. n - 1, element by element (``n`` and ``key`` may be arrays), or its inverse.

    A balanced Feistel network permutes the smallest power of four that holds n; values
    outside are permuted again until they fall inside, fewer than four times on average.
    """
    x = np.asarray(x, np.uint64)
    n = np.broadcast_to(np.asarray(n, np.uint64), x.shape)
    key = np.broadcast_to(np.asarray(key, np.uint64), x.shape)
    bits = np.ceil(np.log2(np.maximum(n, 2).astype(float)) / 2 + 1e-9).astype(np.uint64)
    bits = np.maximum(bits, np.uint64(1))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = x.copy(), np.arange(x.size)
    with np.errstate(over="ignore"):
        keys = [_mix(key + np.uint64(0x9E3779B97F4A7C15) * np.uint64(r + 1)) for r in range(rounds)]
        while todo.size:
            b, m, v = bits[todo], mask[todo], out[todo]
            left, right = v >> b, v & m
            for k in reversed(keys) if inverse else keys:
                if inverse:
                    left, right = right ^ (_mix(left + k[todo]) & m), left
                else:
                    left, right = right, left ^ (_mix(right + k[todo]) & m)
            out[todo] = v = (left << b) | right
            todo = todo[v >= n[todo]]
    return out


def shard(df: DataFrame, order: list[str], n_shards: int = 16, seed: int = 0) -> tuple[DataFrame, tuple[str, str, str]]:
    """``df`` with row number, shard and slot; returns the frame and these columns' names.

    The same rows give the same places whatever files or partitions they come in. Null
    order columns come first. An empty table gives no rows.
    """
    names = number, shard_name, slot = tuple(fresh(df, c) for c in ("row_number", "shard", "slot"))
    rows, total = counted(df, order, number)

    @F.pandas_udf(T.LongType())
    def place(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(permute(part.to_numpy(np.uint64), max(1, total), seed).astype(np.int64))

    position = fresh(rows, "position")
    rows = rows.withColumn(position, place(number))
    rows = rows.withColumn(shard_name, (F.col(position) % n_shards).cast("int"))
    return rows.withColumn(slot, F.expr(f"`{position}` div {n_shards}")).drop(position), names


def measured(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with the text's size (UTF-8 bytes plus one; null has none) and CRC-32 (null: that of no bytes)."""
    size, crc = fresh(docs, "size"), fresh(docs, "text_crc32")
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.withColumn(size, F.octet_length(value).cast("long") + 1).withColumn(crc, F.crc32(value)), size, crc


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 16 and slot under the law ``rows``."""
    docs, size, crc = measured(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows, (_, shard_name, slot) = shard(docs.drop("text"), ["doc_id", size, crc])
    return rows.select(
        "doc_id",
        F.col(size).alias("size"),
        F.col(crc).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col(shard_name).alias("shard"),
        F.col(slot).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _mixed(source: str, z: str, keep: str, out: str) -> str:
    """SQL: the rows of ``source`` with ``out``, SplitMix64's finaliser of ``z``; 128-bit numbers hold the products."""
    low, xor = "% 18446744073709551616::UHUGEINT", "xor({0}, {0} // {1}::UHUGEINT)"
    one = f"SELECT {keep}, ({xor.format(z, 1 << 30)} * 13787848793156543929::UHUGEINT) {low} AS z1 FROM {source}"
    two = f"SELECT {keep}, ({xor.format('z1', 1 << 27)} * 10723151780598845931::UHUGEINT) {low} AS z2 FROM ({one})"
    return f"SELECT {keep}, {xor.format('z2', 1 << 31)} AS {out} FROM ({two})"


def _permuted(rounds: int = 6) -> str:
    """SQL: one pass through the Feistel network of the rows ``w(r, v)``, as (r, v)."""
    inner = "SELECT r, v // side AS a, v % side AS b FROM w, dim WHERE v >= n OR step = 0"
    for k in range(rounds):
        inner = f"SELECT r, b AS a, xor(a, f[{k + 1}][CAST(b AS INT) + 1]) AS b FROM ({inner}), fs"
    return f"SELECT r, a * side + b AS v, 1 AS step FROM ({inner}), dim"


ORACLE_SQL = f"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) x(i))),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (
  SELECT doc_id, n + 1 AS size, xor(4294967295, list_reduce(list_concat([4294967295],
    list_transform(range(n), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))), lambda a, b: xor(a // 256, t[CAST(xor(a % 256, b) AS INT) + 1]))) AS text_crc32
  FROM d, tab),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS r FROM c),
dim AS (SELECT count(*) AS n, CAST(pow(2, greatest(1, ceil(log2(greatest(count(*), 2)) / 2 + 1e-9))) AS BIGINT) AS side FROM o),
rk AS ({_mixed("(SELECT k, ((k + 1)::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM range(6) x(k))", "z", "k", "q")}),
fx AS ({_mixed("(SELECT k, b, side, (q + b::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM rk, dim, LATERAL (SELECT unnest(range(side)) AS b))", "z", "k, b, side", "y")}),
fs AS MATERIALIZED (SELECT list(l ORDER BY k) AS f FROM (SELECT k, list(CAST(y % side::UHUGEINT AS BIGINT) ORDER BY b) AS l FROM fx GROUP BY k)),
w AS (SELECT r, r AS v, 0 AS step FROM o UNION ALL {_permuted()}),
p AS (SELECT r, v FROM w, dim WHERE step = 1 AND v < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(v % 16 AS INT) AS shard, v // 16 AS slot, CAST(NULL AS INT) AS grown_shard FROM o JOIN p USING (r)
"""


def sharded_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", n_shards: int = 16, seed: int = 0) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (clashing names get an underscore).

    Null texts count as empty; null keys come first; repeated rows each have a place of
    their own; an empty table gives no rows.
    """
    sized, size, crc = measured(docs, text)
    rows, (number, _, _) = shard(sized, [key, size, crc], n_shards, seed)
    return rows.drop(size, crc, number)
