"""Sources mixed to target weights by hash-threshold histograms.

Every source has a target in words. A document's place is a hash of its id and text, so a
threshold on places takes a reproducible share of a source, and a larger budget takes what a
smaller one takes and more. Words are summed by source and bucket of places; the bucket in
which a source's budget ends is counted again in smaller buckets until it holds one row.
Then documents are taken by comparing places with thresholds: nothing is sorted by place,
and only counts meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.components import written

#: Words are runs of anything but these blanks (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in the order of their code points, repeating.
WEIGHTS = (5, 2, 1)
#: How often a document may be taken.
MOST = 3
#: Hexadecimal digits of a place by which buckets get smaller in each round.
DIGITS = 3


def _size(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def _place(key: str, text: str, seed: int) -> Column:
    """80 digits: hashes of seed and id and of the text, and for rows equal in both the row's number."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    number = F.lpad(F.lower(F.hex(F.monotonically_increasing_id())), 16, "0")
    return F.concat(F.md5(named), F.md5(F.coalesce(F.col(text), F.lit(""))), number)


def measured(df: DataFrame, key: str, source: str, text: str, seed: int) -> DataFrame:
    """``key, source, size, place`` of each row, written to the shared folder; texts are read once."""
    rows = df.select(
        F.col(key).alias("key"),
        F.col(source).cast("string").alias("source"),
        _size(text).alias("size"),
        _place(key, text, seed).alias("place"),
    )
    return written(rows, "mix-rows")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 by code point, NULL last; in ranges, so that no task sees
    them all."""
    order = F.col("source").asc_nulls_last()
    ranges = written(
        sources.repartitionByRange(order)
        .sortWithinPartitions(order)
        .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nth")),
        "mix-ranges",
    )
    # One row for each range.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.min("nth").alias("first"))
    offsets = offsets.select("part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    return ranges.join(offsets, "part").select(
        *sources.columns, (F.col("offset") + F.col("nth") - F.col("first")).alias("rank")
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target``: all words shared out by weight; no source gets more than
    ``most`` times its size, and what it cannot take goes to the others by weight.

    Weights are whole numbers. Each round fixes the sources that reach their limit at the
    present share of a unit of weight; the driver sees three sums a round.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    choose = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    shared = written(ranked(sizes).withColumn("weight", choose.cast("long")), "mix-sources")
    limit = F.col("source_size") * most
    total = shared.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    used, weight, limited = 0, None, -1
    while True:
        # Above its limit: weight x (total - used) / (weights of the others) >= limit.
        full = F.lit(False)
        if weight is not None:
            full = F.col("weight") * F.lit(total - used).cast("decimal(20,0)") >= limit * F.lit(weight).cast("decimal(18,0)")
        now = shared.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
            F.count_if(full),
        ).first()
        used, weight, before, limited = int(now[0]), int(now[1]), limited, now[2]
        if limited == before or not weight:
            break
    open_share = F.col("weight") * F.lit((total - used) / weight if weight else 0.0)
    target = F.when(full, limit.cast("double")).otherwise(open_share) if weight else limit.cast("double")
    return shared.select("source", "source_size", target.alias("target"))


def _budgets(shares: DataFrame) -> DataFrame:
    """How often a source's documents are all taken, and the words to take beyond."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return shares.withColumn("times", whole.cast("long")).withColumn(
        "budget", F.col("target") - F.col("times") * F.col("source_size")
    )


def _crossings(counted: DataFrame, budgets: DataFrame) -> DataFrame:
    """The bucket of each source in which its budget ends: the last that starts below it."""
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    running = counted.join(budgets, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "before", F.col("_before") + F.coalesce(F.sum("words").over(earlier), F.lit(0))
    )
    last = F.struct("bucket", "before", "words", "rows", "low", "high", "budget")
    return (
        running.filter(F.col("before") < F.col("budget"))
        .groupBy("source")
        .agg(F.max(last).alias("last"))
        .select("source", "last.*")
    )


def _shared_digits(low: Column, high: Column) -> Column:
    """How many leading digits two places share."""
    same = lambda n: F.substring(low, F.lit(1), n) == F.substring(high, F.lit(1), n)
    return F.size(F.filter(F.sequence(F.lit(1), F.lit(80)), same))


def thresholds(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """``source, below``: the place below which documents are taken once more; for sources with a
    budget beyond whole rounds.

    A round counts only the buckets in which budgets end, by the next digits in which their
    places differ. A bucket of one row ends its source's rounds: the row is taken if that
    comes nearer to the budget.
    """
    budgets = written(
        _budgets(shares)
        .filter("budget > 0")
        .select(F.col("source").alias("_source"), "budget", F.lit(0).cast("long").alias("_before")),
        "mix-budgets",
    )
    sums = (
        F.sum("size").alias("words"),
        F.count(F.lit(1)).alias("rows"),
        F.min("place").alias("low"),
        F.max("place").alias("high"),
    )
    filled = rows.filter("size > 0")
    first = F.substring("place", 1, DIGITS)
    found = written(_crossings(filled.groupBy("source", first.alias("bucket")).agg(*sums), budgets), "mix-cells")
    below = shares.select("source", F.lit("").alias("below")).limit(0)
    while not found.isEmpty():
        taken = 2 * F.col("before") + F.col("words") <= 2 * F.col("budget")
        border = F.when(taken, F.concat("bucket", F.lit("g"))).otherwise(F.col("bucket"))
        below = below.union(found.filter("rows = 1").select("source", border.alias("below")))
        cells = found.filter("rows > 1").select(
            F.col("source").alias("_source"),
            "budget",
            F.col("before").alias("_before"),
            F.substring("low", 1, DIGITS).alias("_first"),
            "low",
            "high",
            (_shared_digits(F.col("low"), F.col("high")) + DIGITS).alias("_digits"),
        )
        here = F.col("source").eqNullSafe(F.col("_source")) & (first == F.col("_first"))
        finer = (
            filled.join(cells, here & F.col("place").between(F.col("low"), F.col("high")))
            .groupBy("source", F.substring(F.col("place"), F.lit(1), F.col("_digits")).alias("bucket"))
            .agg(*sums)
        )
        found = written(_crossings(finer, cells.select("_source", "budget", "_before")), "mix-cells")
    return below


def planned(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``_source, source_size, target, times, below`` for each source, written."""
    shares = written(targets(rows, weights, most), "mix-targets")
    below = thresholds(rows, shares).select(F.col("source").alias("_s"), "below")
    plan = _budgets(shares).join(below, F.col("source").eqNullSafe(F.col("_s")), "left")
    return written(plan.select(F.col("source").alias("_source"), "source_size", "target", "times", "below"), "mix-plan")


def _with_times(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Spark copies the plan to all tasks where it is small, and else splits hot sources."""
    more = F.coalesce(F.col("place") < F.col("below"), F.lit(False)).cast("long")
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    return joined.withColumn("times", F.col("times") + more)


def mix(
    df: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    seed: int = 42,
) -> DataFrame:
    """The rows of the mix, each as often as it is taken, with all columns of ``df``.

    Sizes, weights and places are those of ``mix_digests``. The texts are read twice and
    not moved. Rows equal in id and text are told apart by their place in the partitions, so
    where such rows straddle a threshold, ``df`` must be read in the same order each time, as
    files are.
    """
    plan = planned(measured(df, key, source, text, seed), weights, most)
    rows = df.select(
        F.struct("*").alias("row"),
        F.col(source).cast("string").alias("source"),
        _place(key, text, seed).alias("place"),
    )
    taken = _with_times(rows, plan).filter("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*")


def mix_digests(
    df: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    seed: int = 42,
) -> DataFrame:
    """``key, size, source_size, target, taken`` for each row; ``taken`` is words, repeats counted.

    ``size`` is the text's words (NULL: 0). Sources, in the order of their code points and NULL
    last, weigh ``weights``, repeating; see ``targets``. A document is taken as often as its
    source fits whole into the target, and once more if its place is below the source's
    threshold, so a source misses its target by half a document at most. Rows that repeat
    are taken each by themselves; NULL ids hash as one without digits; other columns are not
    read; an empty table gives none.
    """
    rows = measured(df, key, source, text, seed)
    found = _with_times(rows, planned(rows, weights, most))
    return found.select(
        F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")
    )
