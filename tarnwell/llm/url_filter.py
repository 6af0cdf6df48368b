"""URL filters (operator 4): a Bloom filter cascade over listed keys.

A key is a host followed by the beginning of a path (`example.com/en/7`).  A
url's candidate keys are its host and every parent domain with as many labels as
some listed key has, each with every prefix of its path as long as some listed
key's.  The first level of the
cascade holds the listed keys, the second those keys of the whole corpus that
pass the first without being listed, the third the listed keys that pass the
second, and so on until a level lets nothing wrong through.  Over the corpus's
keys, membership is then exact, and judging a url needs no join.

The first level's false-positive rate is |listed| / (sqrt 2 * |corpus keys|), so
the false positives are about as many as the listed keys, whatever the corpus:
filters and driver memory are bounded by ``max_listed``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, mix

#: The rules of the query's contract, (host, path, verdict).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
MAX_LISTED = 2_000_000
LATER_RATE = 0.5


class Level(NamedTuple):
    bits: np.ndarray
    hashes: int
    salt: int


def _slots(level_bits: int, hashes: int, salt: int, one: np.ndarray, two: np.ndarray) -> Iterable[np.ndarray]:
    b = mix(two + np.uint64(salt))
    a = mix(one ^ b ^ np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & (1 << 64) - 1))  # either half changes every slot
    b |= np.uint64(1)
    for i in range(hashes):
        yield (a + np.uint64(i) * b) % np.uint64(level_bits)


def _level(one: np.ndarray, two: np.ndarray, rate: float, salt: int) -> Level:
    n_bits = max(64, math.ceil(len(one) * -math.log(rate) / math.log(2) ** 2))
    hashes = max(1, round(-math.log2(rate)))
    bits = np.zeros((n_bits + 7) // 8, np.uint8)
    n_bits = len(bits) * 8
    for slot in _slots(n_bits, hashes, salt, one, two):
        np.bitwise_or.at(bits, (slot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
    return Level(bits, hashes, salt)


def _passes(level: Level, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    found = np.ones(len(one), bool)
    for slot in _slots(len(level.bits) * 8, level.hashes, level.salt, one, two):
        found &= (level.bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return found


def member(levels: list[Level], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether each key is listed: it is if it passes an odd number of levels in
    a row before the first that it fails (or passes all of an odd number)."""
    passed = np.zeros(len(one), np.int64)
    alive = np.arange(len(one))
    for level in levels:
        alive = alive[_passes(level, one[alive], two[alive])]
        passed[alive] += 1
    return passed % 2 == 1


def build(listed: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray], first: Level) -> list[Level]:
    """All levels; ``others`` are the unlisted keys that pass the first."""
    levels, inside, outside = [first], listed, others
    while len(outside[0]):
        levels.append(_level(*outside, LATER_RATE, len(levels)))
        passed = _passes(levels[-1], *inside)
        inside, outside = outside, (inside[0][passed], inside[1][passed])
    return levels


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest_of(key: Column) -> Column:
    """128 bits of the key's SHA-256: what the filters know of a key."""
    return F.unhex(F.substring(F.sha2(key, 256), 1, 32))


def _candidates(pages: DataFrame, labels: list[int], lengths: list[int]) -> DataFrame:
    """Adds ``keys``: candidate keys, longest first (at equal length the longer
    host first), and the digest of each.  Only parent domains whose number
    of labels is in ``labels`` and prefixes of ``lengths`` can be listed, so no
    others are made: a url costs no more for having many labels."""
    there = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit(""))) + 1
    hosts = F.transform(F.filter(F.array(*[F.lit(n) for n in labels]), lambda n: n <= there), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    cut = F.array(*[F.lit(n) for n in lengths])
    keys = F.flatten(
        F.transform(hosts, lambda h: F.transform(F.filter(cut, lambda n: n <= F.length("path")), lambda n: F.struct((-F.length(h) - n).alias("order"), (-F.length(h)).alias("host_order"), F.concat(h, F.substring(F.col("path"), F.lit(1), n)).alias("key"))))
    )
    return pages.withColumn("keys", F.transform(F.array_sort(keys), lambda k: k["key"])).withColumn("digests", F.transform("keys", digest_of))


def _halves(digests: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Digests as two 64-bit words each."""
    words = np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 2)
    return np.ascontiguousarray(words[:, 0]), np.ascontiguousarray(words[:, 1])


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """Offsets of the key lists and all digests, flat."""
    lists = batch.column("digests")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], lists.flatten()


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", max_listed: int = MAX_LISTED) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule and verdict.

    The longest listed key wins; a url that no listed key fits is allowed.  Null
    urls and urls without `://` have an empty host and path and no rule.  Rows
    with null ids and repeated rows are judged like others; an empty table gives
    an empty result; no other column is read.  More than ``max_listed`` keys are
    refused, as the filters are sent to every task.
    """
    spark = pages.sparkSession
    if len(rules) > max_listed:
        raise ValueError(f"{len(rules)} listed keys; at most {max_listed} are allowed")
    listed = {f"{host}{path}": verdict for host, path, verdict in rules}
    lengths = sorted({len(path) for _, path, _ in rules} or {0}, reverse=True)
    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    labels = sorted({host.count(".") + 1 for host, _, _ in rules} or {1})
    keyed = _candidates(base, labels, lengths)

    hashed = spark.createDataFrame(list(listed.items()), "key string, verdict string").select("verdict", digest_of(F.col("key")).alias("digest")).collect()
    own = pa.array([bytes(r.digest) for r in hashed], pa.binary())
    inside = _halves(own)
    universe = keyed.select(F.explode("digests").alias("digest")).agg(F.approx_count_distinct("digest")).first()[0]
    first = _level(*inside, min(0.5, max(len(listed), 1) / (math.sqrt(2) * max(universe, 1))), 0)

    def wrong(batches):
        for batch in batches:
            digests = _lists(batch)[1]
            found = digests.filter(pa.array(_passes(first, *_halves(digests))))
            found = found.filter(pc.invert(pc.is_in(found, value_set=own)))
            yield pa.RecordBatch.from_arrays([found.unique()], ["digest"])

    # some 0.7 for each listed key are to be expected
    most = 1000 + 4 * len(listed)
    others = [bytes(r.digest) for r in map_arrow(keyed.select("digests"), wrong, "digest binary").distinct().limit(most + 1).collect()]
    if len(others) > most:
        raise ValueError(f"more than {most} keys pass the first filter, which was made for {universe}")
    levels = build(inside, _halves(pa.array(sorted(others), pa.binary())), first)
    # among listed keys alone: which of them block
    blocks = np.array([r.verdict == "block" for r in hashed], bool)
    of_block, of_allow = tuple(x[blocks] for x in inside), tuple(x[~blocks] for x in inside)
    one_block = _level(*of_block, LATER_RATE, 1 << 20)
    through = _passes(one_block, *of_allow)
    verdicts = build(of_block, tuple(x[through] for x in of_allow), one_block)
    filters = spark.sparkContext.broadcast((levels, verdicts))

    def verdict_of(batches):
        levels, verdicts = filters.value
        for batch in batches:
            offsets, digests = _lists(batch)
            one, two = _halves(digests)
            hit = np.flatnonzero(member(levels, one, two))
            at = np.searchsorted(hit, offsets[:-1])
            found = at < np.searchsorted(hit, offsets[1:])
            first_hit = np.where(found, hit[np.minimum(at, max(len(hit) - 1, 0))] if len(hit) else 0, 0)
            rows = np.flatnonzero(found)
            blocked = np.zeros(len(found), bool)
            blocked[rows] = member(verdicts, one[first_hit[rows]], two[first_hit[rows]])
            keys = batch.column("keys").flatten()
            rule = keys.take(pa.array(first_hit, mask=~found)) if len(keys) else pa.nulls(len(found), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), rule, pa.array(np.where(blocked, "block", "allow"), pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    id_type = base.schema["page_id"].dataType.simpleString()
    return map_arrow(keyed, verdict_of, f"page_id {id_type}, host string, path string, rule string, verdict string")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP4_SQL = r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(rule_host, rule_path, says) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
)
SELECT page_id, host, path,
  (SELECT rule_host || rule_path FROM rules WHERE (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path) ORDER BY length(rule_host || rule_path) DESC LIMIT 1) AS rule,
  coalesce((SELECT says FROM rules WHERE (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path) ORDER BY length(rule_host || rule_path) DESC LIMIT 1), 'allow') AS verdict
FROM parts
"""
