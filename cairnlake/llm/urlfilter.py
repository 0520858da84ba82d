"""URL filters by a cascade of Bloom filters, in DataFrame operations only.

A rule is a key (host and path prefix, such as `example.org/es/`). The cascade's first filter encodes the
listed keys; the second encodes the keys of the corpus's whole key universe that the first takes for listed
though they are not; the third encodes the listed keys that the second takes; and so on, until a level has
no false positives. A key of the universe is listed exactly if the first level that rejects it is an even
one (or if none rejects it and the number of levels is odd). Judging a url thus needs bit tests only, no join.

Filters are arrays of longs inside the plan. The first level's rate of false positives is taken from the counts, so that no more of
them are to be expected than there are listed keys, however large the universe: the size of all levels follows the list alone
(times the logarithm of the universe). Lists of more than MAX_LISTED keys are dealt by hash into parts, each with cascades of its own and a pass over the urls.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: The rules of the registered query: (action, key).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
FALSE_RATE, LATER_RATE, MAX_LISTED = 2**-10, 0.5, 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: both empty for null urls and those without `://`."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def candidate_keys(host: Column, path: Column, labels: Iterable[int], lengths: Iterable[int]) -> Column:
    """The keys by which a url could be listed: host suffixes of so many labels with path heads of so many characters.

    labels and lengths are those that occur among the rules, so that long hosts and paths have few candidates.
    """
    numbers = lambda x: F.from_json(F.lit(json.dumps(sorted(x, reverse=True))), "array<int>")
    parts = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    suffixes = F.transform(F.filter(numbers(labels), lambda n: n <= parts), lambda n: F.call_function("substring_index", host, F.lit("."), -n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(F.filter(numbers(lengths), lambda m: m <= F.length(path)), lambda m: F.concat(s, F.substring(path, F.lit(1), m)))))


def _positions(key: Column, bits: int, hashes: int, salt: int) -> list[Column]:
    """Bit numbers of a key in a filter: two 64-bit hashes, combined."""
    a, b = F.xxhash64(F.lit(2 * salt), key), F.xxhash64(F.lit(2 * salt + 1), key)
    a, b = F.pmod(a, F.lit(bits)), F.pmod(b, F.lit(bits - 1)) + 1
    return [F.pmod(a + F.lit(i) * b, F.lit(bits)) for i in range(hashes)]


class BloomFilter:
    """One level: built by distributed partial aggregation, held as an array of longs."""

    def __init__(self, keys: DataFrame, count: int, rate: float, salt: int):
        self.bits = 64 * max(1, math.ceil(max(1, count) * math.log2(1 / rate) / math.log(2) / 64))
        self.hashes, self.salt = max(1, round(math.log2(1 / rate))), salt
        places = keys.select(F.explode(F.array(*_positions(F.col("key"), self.bits, self.hashes, salt))).alias("p"))
        words = places.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v")).collect()
        values = dict((r["w"], r["v"]) for r in words)
        self.words = [values.get(i, 0) for i in range(self.bits // 64)]

    def holds(self, key: Column) -> Column:
        words = F.array(*[F.lit(v).cast("long") for v in self.words]) if len(self.words) <= 64 else F.from_json(F.lit(str(self.words)), "array<bigint>")
        hit = F.lit(True)
        for p in _positions(key, self.bits, self.hashes, self.salt):
            word = F.element_at(words, (F.floor(p / 64) + 1).cast("int"))
            hit = hit & (F.call_function("getbit", word, (p % 64).cast("int")) == 1)
        return hit


def _key_table(spark, keys: Iterable[str]) -> DataFrame:
    return spark.range(1).select(F.explode_outer(F.from_json(F.lit(json.dumps(sorted(keys))), "array<string>")).alias("key")).filter("key is not null")


class Cascade:
    """Exact membership of a universe's keys in a list."""

    def __init__(self, listed: Iterable[str], universe: DataFrame, salt: int = 0, first_rate: float = FALSE_RATE, later_rate: float = LATER_RATE, size: int | None = None):
        """universe: a table with the column key, all keys that will be asked for (listed or not), of so many rows."""
        spark, listed = universe.sparkSession, set(listed)
        self.levels: list[BloomFilter] = []
        if not listed:
            return
        count = len(listed)
        size = universe.count() if size is None else size
        inside, outside, rate = _key_table(spark, listed), None, min(first_rate, count / max(1, size))
        work = Workspace(spark, "cascade")
        while count:
            self.levels.append(level := BloomFilter(inside, count, rate, salt * 1000 + len(self.levels)))
            if outside is None:  # the corpus's keys that the first level takes for listed
                wrong = universe.filter(level.holds(F.col("key"))).join(inside, "key", "left_anti").select("key").distinct()
            else:
                wrong = outside.filter(level.holds(F.col("key")))
            wrong = work.write(wrong, f"wrong{len(self.levels)}")
            inside, outside, rate = wrong, inside, later_rate
            count = wrong.count()

    def lists(self, key: Column) -> Column:
        """Whether the key, one of the universe's, is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            answer = F.when(~level.holds(key), F.lit(i % 2 == 1)).otherwise(answer)
        return answer


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, default: str = "allow", first_rate: float = FALSE_RATE, later_rate: float = LATER_RATE, most: int = MAX_LISTED) -> DataFrame:
    """Every page with its host, path, rule and verdict: page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the url's path starts with the rule's; of several the longest
    wins. rule is that rule's key, or null; verdict its action. Without a rule the url is not listed, and the verdict is `default`.
    A key listed with both actions counts as blocked. Null urls and urls without `://` have an empty host and
    path, which no rule fits. Repeated rows are judged each; other columns are not read; no rows give no rows.
    """
    rules = list(rules)
    blocked = {k for a, k in rules if a == "block"}
    allowed = {k for a, k in rules if a == "allow"} - blocked
    split = [k.partition("/") for k in blocked | allowed]
    labels, lengths = {h.count(".") + 1 for h, _, _ in split}, {len(s + p) for _, s, p in split}
    host, path = url_parts(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("best", F.lit(None).cast("struct<n:int,key:string,action:string>"))
    keys = candidate_keys(F.col("host"), F.col("path"), labels, lengths)
    work = Workspace(pages.sparkSession, "urls")
    universe = work.write(judged.select(F.explode_outer(keys).alias("key")).filter("key is not null").distinct(), "universe")
    n, parts = universe.count(), max(1, math.ceil(max(len(blocked), len(allowed)) / most))
    for part in range(parts):
        mine = _is_of(part, parts)
        own = lambda listed: listed if parts == 1 else {r[0] for r in _key_table(pages.sparkSession, listed).filter(mine(F.col("key"))).collect()}
        asked = universe if parts == 1 else universe.filter(mine(F.col("key")))
        block, allow = (Cascade(own(k), asked, 2 * part + i, first_rate, later_rate, n) for i, k in enumerate((blocked, allowed)))
        here = keys if parts == 1 else F.filter(keys, mine)
        found = F.transform(here, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"), F.when(block.lists(k), "block").when(allow.lists(k), "allow").alias("action")))
        best = F.array_max(F.filter(found, lambda x: x["action"].isNotNull()))
        judged = judged.withColumn("best", F.greatest("best", best) if part else best)
        if part < parts - 1:
            judged = work.write(judged, f"judged{part}")
    return judged.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def _is_of(part: int, parts: int) -> Callable[[Column], Column]:
    return lambda key: F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts)) == part
