"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import WORD, stored, without

OUT = ("size", "source_size", "target", "taken", "copies", "position", "positions")
BUCKET_ROWS = 2048  # of a bucket, were there one source


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes (source, key, source_size) with index, weight and target.

    Sources in code-point order, null last, take the weights in turn. The
    budget times all sizes is shared by weight; what a source can't take
    (over cap times its size) is shared again until none is above. That end
    state is a common level: target = min(cap * size, weight * level).
    """
    n, everything = len(weights), Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    src = sizes.withColumn("index", F.row_number().over(by_name) - 1)
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("index") % n + 1))
    src = src.withColumn("most", cap * F.col("source_size"))
    src = src.withColumn("total", budget * F.sum("source_size").over(everything))
    src = src.withColumn("ratio", F.col("most") / F.col("weight"))
    before = Window.orderBy("ratio", "index").rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    src = src.withColumn("try", (F.col("total") - full) / left)
    level = F.max(F.when(F.col("try") <= F.col("ratio"), F.col("try"))).over(everything)
    target = F.least(F.col("most"), F.coalesce(F.col("weight") * level, F.col("most")))
    return src.withColumn("target", target).select("key", "index", "weight", "source_size", "target")


def invert_ramp(share: Column, slope: Column) -> Column:
    """Time t in 0..1 at which a demand 1 + slope * (2t - 1) has summed to share."""
    b = 1 - slope
    root = (F.sqrt(F.greatest(b * b + 4 * slope * share, F.lit(0.0))) - b) / (2 * slope)
    return F.least(F.greatest(F.when(slope == 0, share).otherwise(root), F.lit(0.0)), F.lit(1.0))


def mix(
    docs: DataFrame,
    size: Column | None = None,
    weights=(3, 1, 2),
    slopes=(0.5, 0.0, -0.5),
    budget: float = 1.5,
    cap: float = 2.0,
    bucket_rows: int = BUCKET_ROWS,
    seed: int = 11,
    text: str = "text",
    source: str = "source",
    id_col: str = "doc_id",
) -> DataFrame:
    """docs with size, source_size, target, taken, copies, position and positions.

    Each source's documents stand in one seeded order, gone through as often
    as its target asks (cap times at most). A running sum of sizes there says
    which words the mix takes; the one document at the target's edge is taken
    in part. A source's demand over training time runs by its slope (rising,
    level, falling); integrating it and inverting the sum at a document's
    place gives its position in 0..1, one a copy in positions. Documents that
    aren't taken have a position over 1, so a range sort spreads them too, and
    no positions.

    The running sum goes over hash buckets of a source, then within a bucket,
    so no task holds a whole source. All rows are counted, and a source has as
    many buckets as leave bucket_rows rows or less in each on average, so a
    bucket doesn't grow with the table. The join with the buckets' offsets and
    the window within a bucket share one exchange, and nothing that grows is
    broadcast. Sources are ranked in one task: some 100 bytes a source. Null texts have size 0; null
    sources are a source, the last; null ids are ids. Equal rows share an
    order value and split what they take in any way. Empty input, empty
    output. Input columns with the output's names are replaced.
    """
    size = word_count(F.col(text)) if size is None else size
    bits = max(0, math.ceil(math.log2(max(1, docs.count()) / bucket_rows)))
    base = docs.withColumns({
        "_mx_size": size,
        "_mx_h": F.xxhash64(F.lit(seed), F.col(id_col), F.col(text)),
        "_mx_key": F.when(F.col(source).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source))),
    }).withColumn("_mx_bucket", (F.shiftrightunsigned("_mx_h", 64 - bits) if bits else F.lit(0)).cast("long"))

    sums = stored(base.groupBy(F.col("_mx_key").alias("key"), F.col("_mx_bucket").alias("bucket")).agg(F.min(source).alias("source"), F.sum("_mx_size").alias("bucket_size")), "mix-sums")
    targets = source_targets(sums.groupBy("key").agg(F.min("source").alias("source"), F.sum("bucket_size").alias("source_size")), weights, budget, cap)
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(before), F.lit(0).cast("long"))).join(targets, "key")
    places = places.select(F.col("key").alias("_mx_key"), F.col("bucket").alias("_mx_bucket"), F.col("offset").alias("_mx_offset"), F.col("index").alias("_mx_index"), F.col("source_size").alias("_mx_source_size"), F.col("target").alias("_mx_target"))

    order = Window.partitionBy("_mx_key", "_mx_bucket").orderBy("_mx_h", F.col(id_col), "_mx_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = base.join(places.hint("shuffle_hash"), ["_mx_key", "_mx_bucket"])
    rows = rows.withColumn("_mx_start", F.col("_mx_offset") + F.coalesce(F.sum("_mx_size").over(order), F.lit(0).cast("long")))
    goal = F.floor("_mx_target").cast("long")
    lap = lambda i: F.greatest(F.least(goal - F.col("_mx_start") - i * F.col("_mx_source_size"), F.col("_mx_size")), F.lit(0).cast("long"))
    laps = range(int(-(-cap // 1)))
    rows = rows.withColumns({f"_mx_lap{i}": lap(i) for i in laps})
    slope = F.element_at(F.array(*[F.lit(float(s)) for s in slopes]), F.col("_mx_index") % len(slopes) + 1)
    share = lambda i: (F.col("_mx_start") + i * F.col("_mx_source_size")) / F.col("_mx_target")
    place = lambda i: F.when(F.col(f"_mx_lap{i}") > 0, invert_ramp(share(i), slope))
    unused = 1 + F.shiftrightunsigned("_mx_h", 11) / float(1 << 53)
    taken, copies = sum((F.col(f"_mx_lap{i}") for i in laps[1:]), F.col("_mx_lap0")), sum(((F.col(f"_mx_lap{i}") > 0).cast("int") for i in laps[1:]), (F.col("_mx_lap0") > 0).cast("int"))
    kept = [F.col(c) for c in without(docs, *OUT).columns]
    return rows.select(
        *kept,
        F.col("_mx_size").alias("size"),
        F.col("_mx_source_size").alias("source_size"),
        F.col("_mx_target").alias("target"),
        taken.alias("taken"),
        copies.alias("copies"),
        F.coalesce(place(0), unused).alias("position"),
        F.array_compact(F.array(*[place(i) for i in laps])).alias("positions"),
    )


def range_sorted(df: DataFrame, column: str = "position") -> DataFrame:
    """df in the order of training; partitions are ranges of positions."""
    return df.orderBy(column)


def training_order(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: a row for each time a document is taken, in the order of positions."""
    own = {c: f"_mx_own_{c}" for c in docs.columns if c.lower() in OUT}
    mixed = mix(docs.withColumnsRenamed(own), **options).where("copies > 0")
    ordered = range_sorted(mixed.withColumn("_mx_at", F.explode("positions")), "_mx_at")
    return ordered.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
