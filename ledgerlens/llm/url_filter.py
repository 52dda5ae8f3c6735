"""URL filters by a Bloom filter cascade: exact list membership of every key of the corpus, tested without joins.

Level 0 is a Bloom filter of the listed keys.  Level 1 holds those unlisted
keys of the corpus's complete key universe that level 0 lets through, level 2
the listed keys that level 1 lets through, and so on until a level lets no
wrong key through.  A key of the universe is listed exactly if the first level
that does not hold it is an odd one (or, when all hold it, by the parity of the last).

Everything is DataFrame expressions; each level is one array of longs, read as
a scalar subquery.  Filters are broadcast that way only up to ``max_filter_bytes``
in all (documented bound); a longer list is looked up with shuffle joins instead.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

BITS_PER_KEY = 10
HASHES = 4
MAX_FILTER_BYTES = 64 << 20


def _bits(key: Column, level: int, bits: int) -> list[Column]:
    """The key's positions in a level of ``bits`` bits."""
    return [F.pmod(F.xxhash64(F.lit(level * HASHES + i), key), F.lit(bits)) for i in range(HASHES)]


@dataclass
class Level:
    """One Bloom filter: dense words in the shared folder, and its size in bits."""

    spark: SparkSession
    number: int
    path: str
    bits: int

    def lets_through(self, key: Column) -> Column:
        """Whether all of the key's bits are set; the filter is one array, read as a scalar subquery."""
        words = self.spark.read.schema("i bigint, w bigint").parquet(self.path)
        packed = words.agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("all")).select(F.col("all")["w"]).scalar()
        set_ = [F.getbit(F.get(packed, F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in _bits(key, self.number, self.bits)]
        return reduce(and_, set_)


@dataclass
class Cascade:
    levels: list[Level]

    def holds(self, key: Column) -> Column:
        """True if the key (of the universe) is listed; null keys are not."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(~level.lets_through(key), F.lit(level.number % 2 == 1)).otherwise(answer)
        return F.coalesce(key.isNotNull() & answer, F.lit(False))


def _build_level(keys: DataFrame, number: int, n: int, path: str) -> Level:
    """Write the Bloom filter of ``n`` keys as dense words."""
    spark = keys.sparkSession
    words = max(1, -(-n * BITS_PER_KEY // 64))
    at = keys.select(F.explode(F.array(*_bits(F.col("key"), number, words * 64))).alias("p"))
    one = F.expr("shiftleft(1L, cast(pmod(p, 64) as int))")
    got = at.groupBy(F.shiftright("p", 6).alias("i")).agg(F.bit_or(one).alias("w"))
    every = spark.range(words).withColumnRenamed("id", "i")
    every.join(got, "i", "left").select("i", F.coalesce("w", F.lit(0)).alias("w")).write.parquet(path)
    return Level(spark, number, path, words * 64)


def build_cascade(listed: DataFrame, universe: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> Cascade | None:
    """Cascade of the listed keys against the universe; both have one column ``key``.  Null keys are ignored, repeated ones count once.

    None if the filters would be larger than ``max_filter_bytes``.  An empty list gives a cascade that holds nothing.
    """
    spark = listed.sparkSession
    root = scratch_path(spark, "cascade")
    listed.where("key is not null").distinct().write.parquet(f"{root}/hold0")
    hold = spark.read.parquet(f"{root}/hold0")
    other = universe.where("key is not null").distinct().join(hold, "key", "left_anti")
    levels, used, n = [], 0, hold.count()
    while n:
        k = len(levels)
        used += n * BITS_PER_KEY // 8
        if used > max_filter_bytes:
            return None
        levels.append(_build_level(hold, k, n, f"{root}/level{k}"))
        # What this level wrongly lets through is what the next one holds.
        other.where(levels[-1].lets_through(F.col("key"))).write.parquet(f"{root}/hold{k + 1}")
        hold, other = spark.read.parquet(f"{root}/hold{k + 1}"), hold
        n = hold.count()
    return Cascade(levels)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, then up to ``?``, ``#`` or the end.

    A null url, or one without ``://``, has an empty host and path.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """Distinct (labels of the host, length of the path) of the rules: only such keys of a url can be listed.

    Their number follows the depth of hosts and the lengths of rule paths, not the number of rules.
    """
    shape = rules.select(F.size(F.split("host", r"\.", -1)).alias("n"), F.length("path").alias("p")).distinct()
    return sorted((r.n, r.p) for r in shape.collect())


def url_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The url's keys (host suffix + path prefix) of the given shapes, longest first."""
    keys = [
        F.when((host != "") & (F.length(path) >= p), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, p)))
        for n, p in shapes
    ]
    found = F.array_distinct(F.array_compact(F.array(*keys))) if keys else F.array().cast("array<string>")
    return F.reverse(F.array_sort(F.transform(found, lambda k: F.struct(F.length(k).alias("n"), k.alias("key")))))["key"]


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", id_col: str = "page_id", default: str = "allow", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Judge every url by the longest rule that fits it: ``id_col, host, path, rule, verdict``.

    ``rules``: ``host, path, verdict`` (``allow`` or ``block``).  A rule fits its host and all subdomains if the
    path starts with the rule's; of fitting rules of one length the greater by text order counts.  A rule that is listed several
    times blocks if any of its rows does; a verdict other than ``block``, or none, allows.  A url that no rule fits gets ``default``.
    One row per input row, repeated rows included; other columns of ``pages`` are not read.
    Null urls have empty host and path and get ``default``; an empty rule list gives ``default`` everywhere.
    """
    rules = rules.where("host is not null and path is not null and host <> ''")
    shapes = rule_shapes(rules)
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"))
    urls = urls.select("id", host.alias("host"), path.alias("path"))
    keyed = urls.withColumn("keys", url_keys(F.col("host"), F.col("path"), shapes))
    key = F.concat("host", "path").alias("key")
    universe = keyed.select(F.explode("keys").alias("key"))
    # One verdict for each key, before the way of looking it up is chosen.
    block = F.coalesce(F.max(F.col("verdict") == "block"), F.lit(False))
    rules = rules.groupBy(key).agg(F.when(block, "block").otherwise("allow").alias("verdict"))
    listed = build_cascade(rules.select("key"), universe, max_filter_bytes)
    # The second cascade tells block from allow among listed keys, so these are its universe.
    blocked = listed and build_cascade(rules.where("verdict = 'block'").select("key"), rules.select("key"), max_filter_bytes)
    if listed is None or blocked is None:
        return _joined(keyed, rules, id_col, default)
    each = [F.get("keys", F.lit(i)) for i in range(len(shapes))]  # longest first; subqueries may not stand in higher-order functions
    rule = F.coalesce(*[F.when(listed.holds(k), k) for k in each], F.lit(None).cast("string"))
    judged = keyed.withColumn("rule", rule)
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(blocked.holds(F.col("rule")), "block").otherwise("allow")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))


def _joined(keyed: DataFrame, rules: DataFrame, id_col: str, default: str) -> DataFrame:
    """The same answer for lists beyond the filter bound: distinct hosts and paths meet the rules in shuffle joins."""
    each = keyed.select("host", "path", "keys").distinct().select("host", "path", F.explode("keys").alias("key"))
    best = each.join(rules, "key").groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), "key", "verdict")).alias("b"))
    out = keyed.join(best, ["host", "path"], "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("b.key").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
