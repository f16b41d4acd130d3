"""URL rules, then a blocked Bloom filter in front of an exact join."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import ascii_lower, without

#: (verdict, host, path); a rule's name is host followed by path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
LANES = 8  # 32-bit lanes of a 256-bit block; a key sets one bit in each
BROADCAST_BYTES = 64 << 20


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without "://"."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    part = lambda i: F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", i)
    return ascii_lower(part(1)), part(2)


def canonical(host: Column, path: Column) -> Column:
    """Scheme, query and fragment go; so do a leading www. or m. and a trailing slash."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, "/+$", ""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ranked]

    def chain(values):
        return reduce(lambda c, x: c.when(x[0], F.lit(x[1])), zip(fits[1:], values[1:]), F.when(fits[0], F.lit(values[0])))

    return chain([h + p for _, h, p in ranked]), chain([v for v, _, _ in ranked])


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(17), url), F.lit(blocks))


def _mask(url: Column, lane: int) -> Column:
    bit = F.shiftright(F.xxhash64(F.lit(71), url), 5 * lane).bitwiseAND(F.lit(31)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def bloom_blocks(listed: DataFrame, column: str, keys: int, bits_per_key: int = 12) -> tuple[DataFrame, int]:
    """The filter as a table (block, lane0 .. lane7), and its number of blocks."""
    blocks = max(1, math.ceil(keys * bits_per_key / (32 * LANES)))
    url = F.col(column)
    lanes = [F.bit_or(_mask(url, i)).alias(f"lane{i}") for i in range(LANES)]
    return listed.groupBy(_block(url, blocks).alias("block")).agg(*lanes), blocks


def url_verdicts(pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES, bits_per_key: int = 12) -> DataFrame:
    """pages with host, path, rule and verdict (input columns of these names are replaced).

    A rule decides where one fits. Elsewhere a URL is blocked if its canonical
    form is in listed (one column of canonical URLs; repeats and nulls do no
    harm): the Bloom filter passes possible hits to an exact join, which
    removes false positives. The filter is broadcast if its size, which is
    checked, is under BROADCAST_BYTES, and joined by a shuffle beyond. Only
    possible hits go to the exact join, so the pages are read twice, for
    them and for the others, but the others are never shuffled.
    Null URLs and URLs without "://" have empty host and path, no rule, and
    are allowed. An empty list or table is allowed.
    """
    name = listed.columns[0]
    listed = listed.select(F.col(name).alias("_uf_url")).where("_uf_url is not null").distinct()
    keys = listed.count()
    host, path = host_path(F.col(url))
    base = without(pages, "host", "path", "rule", "verdict").withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "verdict": verdict})
    probes = base.withColumn("_uf_url", canonical(F.col("host"), F.col("path")))

    filter_, blocks = bloom_blocks(listed, "_uf_url", keys, bits_per_key)
    filter_ = filter_.select(*[F.col(c).alias(f"_uf_{c}") for c in filter_.columns])
    small = blocks * 8 * (LANES + 1) <= BROADCAST_BYTES
    probed = probes.withColumn("_uf_block", _block(F.col("_uf_url"), blocks)).join(F.broadcast(filter_) if small else filter_, "_uf_block", "left")
    hit = reduce(lambda a, b: a & b, [F.col(f"_uf_lane{i}").bitwiseAND(_mask(F.col("_uf_url"), i)) == _mask(F.col("_uf_url"), i) for i in range(LANES)])
    probed = probed.withColumn("_uf_hit", F.col("rule").isNull() & F.coalesce(hit, F.lit(False))).drop(*filter_.columns)

    possible = probed.where("_uf_hit").join(listed.withColumn("_uf_listed", F.lit(True)), "_uf_url", "left")
    judged = possible.withColumn("verdict", F.when(F.col("_uf_listed"), "block").otherwise("allow"))
    settled = probed.where("not _uf_hit").withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    return settled.select(base.columns).unionByName(judged.select(base.columns))
