"""Snapshot, window, series and set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_snapshot(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. A maximum by key, combined before the shuffle, in place of a sort of every key."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r")).select(*keys, "r.*")


def first_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def value_ranks(values: DataFrame, value: str, parts: int = 64) -> DataFrame:
    """(v, c, below): each distinct value as a double, how often it occurs and how many values are less; nulls and NaN are left out.

    Values are counted before the shuffle and cut into ranges; prefix sums run within a range and over the few ranges,
    so no task sorts the whole column.
    """
    v = F.col(value).cast("double")
    per = values.filter(v.isNotNull() & ~F.isnan(v)).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    cuts = per.agg(F.percentile_approx("v", [i / parts for i in range(1, parts)]).alias("q")).collect()[0]["q"] or []  # as many numbers as ranges
    edges = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>")
    ranged = per.withColumn("__k", F.size(F.filter(edges, lambda e: e < F.col("v"))))
    before = ranged.groupBy("__k").agg(F.sum("c").alias("__t"))
    before = before.select("__k", (F.sum("__t").over(Window.orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__t")).alias("__t"))  # a row for each range
    within = F.sum("c").over(Window.partitionBy("__k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    return ranged.withColumn("__w", within).join(before, "__k").select("v", "c", (F.col("__w") + F.col("__t")).alias("below"))


def exact_quantiles(df: DataFrame, value: str, at: list[float], name: str = "q") -> DataFrame:
    """One row with the array of linearly interpolated quantiles of the values that are not null; a null array if there are none."""
    ranks = value_ranks(df, value)
    n = ranks.agg(F.sum("c").alias("n"))
    held = ranks.join(F.broadcast(n))  # one row
    of = lambda place: F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("c")), F.col("v")))
    places = [(F.col("n") - 1) * F.lit(float(q)) for q in at]
    ends = held.agg(*[of(F.floor(p)).alias(f"l{i}") for i, p in enumerate(places)], *[of(F.ceil(p)).alias(f"h{i}") for i, p in enumerate(places)], F.max("n").alias("n"))
    value_at = lambda i, p: F.when(F.floor(p) == F.ceil(p), F.col(f"l{i}")).otherwise((F.ceil(p) - p) * F.col(f"l{i}") + (p - F.floor(p)) * F.col(f"h{i}"))
    return ends.select(F.when(F.col("n").isNotNull(), F.array(*[value_at(i, p) for i, p in enumerate(places)])).alias(name))


def as_of_nearest(left: DataFrame, right: DataFrame, at: str, day: str, value: str) -> DataFrame:
    """left with the value of the nearest day in right, ties to the earlier day, then to the smaller value. Every row of
    left comes back once: a null date, and any date if right has no days, gets a null.

    right is a calendar series, so days that can be nearest lie in the same or a neighbouring bucket of its largest
    gap; distinct dates are joined on buckets and the answers joined back.
    """
    days = right.filter(F.col(day).isNotNull()).select(F.col(day).alias("__day"), F.col(value).alias("__v"))
    own = days.select("__day").distinct()
    gaps = own.select("__day", F.datediff(F.lead("__day").over(Window.orderBy("__day")), F.col("__day")).alias("g"))  # days of a calendar
    span = gaps.agg(F.min("__day").alias("lo"), F.max("__day").alias("hi"), F.greatest(F.coalesce(F.max("g"), F.lit(1)), F.lit(1)).alias("g"))
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / F.col("g"))
    dates = left.filter(F.col(at).isNotNull()).select(F.col(at).alias("__at")).distinct()
    l = dates.join(F.broadcast(span)).withColumn("__to", F.least(F.greatest(F.col("__at"), F.col("lo")), F.col("hi"))).withColumn("__b", F.explode(F.array(*[bucket(F.col("__to")) + d for d in (-1, 0, 1)])))  # noqa: E741  one row
    r = days.join(F.broadcast(span.select("g"))).select(bucket(F.col("__day")).alias("__b"), "__day", "__v")
    near = l.join(r, "__b").groupBy("__at").agg(F.min_by("__v", F.struct(F.abs(F.datediff("__to", "__day")), "__day", "__v")).alias("__v"))
    return left.join(near, F.col(at) == F.col("__at"), "left").select(*[F.col(f"`{c}`") for c in left.columns if c != value], F.col("__v").alias(value))


def interpolate(points: DataFrame, anchors: DataFrame, x: str, ax: str, ay: str) -> DataFrame:
    """points with y by piecewise-linear interpolation over the anchors, flat beyond them; a null x, and any x without anchors, gets a null.

    The pieces between anchors are dealt to buckets as wide as the longest of them, so points meet them in an equi-join.
    """
    w = Window.orderBy(ax)
    seg = anchors.select(F.col(ax).cast("double").alias("x0"), F.col(ay).cast("double").alias("y0"), F.lead(ax).over(w).cast("double").alias("x1"), F.lead(ay).over(w).cast("double").alias("y1"))  # the anchors of a curve
    span = seg.agg(F.min("x0").alias("lo"), F.max("x0").alias("hi"), F.coalesce(F.max(F.col("x1") - F.col("x0")), F.lit(1.0)).alias("g"))
    bucket = lambda c: F.floor(c / F.col("g"))
    pieces = seg.join(F.broadcast(span)).withColumn("__b", F.explode(F.sequence(bucket(F.col("x0")), bucket(F.coalesce("x1", "x0"))))).select("__b", "x0", "y0", "x1", "y1")  # one row
    p = points.join(F.broadcast(span)).withColumn("__x", F.least(F.greatest(F.col(x).cast("double"), F.col("lo")), F.col("hi")))
    p = p.withColumn("__x", F.when(F.col(x).isNotNull(), F.col("__x"))).withColumn("__p", bucket(F.col("__x")))
    y = F.when(F.col("x1").isNull() | (F.col("__x") <= F.col("x0")), F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("__x") - F.col("x0")) / (F.col("x1") - F.col("x0")))
    inside = (F.col("__p") == F.col("__b")) & (F.col("__x") >= F.col("x0")) & (F.col("x1").isNull() | (F.col("__x") < F.col("x1")))
    return p.join(pieces, inside, "left").select(*[F.col(f"`{c}`") for c in points.columns], y.alias("y"))


def monotone_anchors(captures: DataFrame, code: str, day: str, width: int = 2000, min_n: int = 10) -> DataFrame:
    """(bin, day): 5th percentile of capture days by bin of codes, made monotone."""
    b = captures.groupBy((F.floor(F.col(code) / width) * width + width / 2).alias("bin")).agg(F.percentile(day, 0.05).alias("d"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_n)
    return b.select("bin", F.max("d").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("day"))


def rebased(series: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Adds index (first value = 100) and change on the period before."""
    w = Window.partitionBy(*group).orderBy(order)
    return series.withColumns({"index": 100 * F.col(value) / F.first(value).over(w), "change": F.col(value) / F.lag(value).over(w) - 1})


def growth(series: DataFrame, day: str, value: str, lag: int) -> DataFrame:
    """One row (cagr, last_change): compound growth over the whole series and change over so many periods at its end; null
    where the value to start from is 0, or the series is of one day."""
    w = Window.orderBy(day)
    l = series.withColumns({"__lag": F.lag(value, lag).over(w)})  # noqa: E741
    a = l.agg(F.min_by(value, day).alias("first"), F.max_by(value, day).alias("last"), F.min(day).alias("d0"), F.max(day).alias("d1"), F.max_by("__lag", day).alias("before"))
    years = F.datediff("d1", "d0") / 365.25
    return a.select((F.pow(F.try_divide("last", "first"), F.try_divide(F.lit(1.0), years)) - 1).alias("cagr"), (F.try_divide("last", "before") - 1).alias("last_change"))


def splice(old: DataFrame, new: DataFrame, month: str, value: str, link: str) -> DataFrame:
    """One series of two bases: the old one scaled by the ratio at the link month, the new one where it exists. Without a
    value of both at the link month, or with an old one of 0, the old months stay and are null."""
    at = lambda df, name: df.agg(F.max(F.when(F.col(month) == link, F.col(value))).alias(name))
    ratio = at(new, "n").join(at(old, "o")).select(F.try_divide("n", "o").alias("ratio"))
    o = old.join(F.broadcast(ratio)).select(month, (F.col(value) * F.col("ratio")).alias("__o"))  # one row
    return o.join(new.select(month, F.col(value).alias("__n")), month, "full").select(month, F.coalesce("__n", "__o").alias(value))


def last_mean(series: DataFrame, day: str, value: str, k: int) -> DataFrame:
    """Mean of the last k values that are not null."""
    return series.filter(F.col(value).isNotNull()).orderBy(F.desc(day)).limit(k).agg(F.avg(value).alias("mean"))


def in_ranges(df: DataFrame, by: list[str]) -> DataFrame:
    """The rows in order, dealt to ranges: adds ``__range`` and ``__place`` (from 0) in it. Written down, so that places don't change when a task is repeated."""
    from .graph import _settled

    placed = _settled(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    return placed.withColumns({"__range": F.shiftright("__at", 33), "__place": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__at")


def range_starts(placed: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(__range, a column for each sum): what the ranges before hold of it; the driver sees a row a range."""
    parts = sorted(placed.groupBy("__range").agg(*[c.alias(n) for n, c in sums.items()]).collect(), key=lambda r: r["__range"])
    kinds = {f.name: f.dataType.simpleString() for f in placed.groupBy("__range").agg(*[c.alias(n) for n, c in sums.items()]).schema.fields}
    before, rows = dict.fromkeys(sums, 0), []
    for r in parts:
        rows.append((r["__range"], *[float(before[n]) if kinds[n] == "double" else before[n] for n in sums]))
        before = {n: before[n] + (r[n] or 0) for n in sums}
    return placed.sparkSession.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in kinds.items()))


def numbered(df: DataFrame, by: list[str], name: str = "number") -> DataFrame:
    """The rows with their place in the order, from 0 and without gaps; no task sees more than a range."""
    placed = in_ranges(df, by)
    starts = range_starts(placed, {"__before": F.count(F.lit(1))})
    return placed.join(F.broadcast(starts), "__range").withColumn(name, F.col("__before") + F.col("__place")).drop("__range", "__place", "__before")  # a row a range


def concentration(areas: DataFrame, weight: str, value: str, order: list[str]) -> DataFrame:
    """Cumulative shares (x, y) of weight and value along the order: running sums by ranges, on top of what the ranges before hold."""
    placed = in_ranges(areas, order)
    double = {n: F.sum(F.col(c).cast("double")) for n, c in (("__w", weight), ("__v", value))}
    starts = range_starts(placed, double)
    total = placed.agg(*[c.alias(f"{n}t") for n, c in double.items()])
    w = Window.partitionBy("__range").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    met = placed.join(F.broadcast(starts), "__range").join(F.broadcast(total))  # a row a range, one row
    share = lambda n, c: F.try_divide(F.col(n) + F.coalesce(F.sum(F.col(c).cast("double")).over(w), F.lit(0.0)), F.col(f"{n}t"))
    return met.select(*areas.columns, share("__w", weight).alias("x"), share("__v", value).alias("y"))


def concentration_index(curve: DataFrame) -> DataFrame:
    """(c, top20, bottom50): 1 - 2 * area under the curve; value shares of the richest fifth and the poorest half of the weight.

    Each point meets the one before it by its number, so no task holds the curve."""
    points = numbered(curve.select("x", "y").filter("x IS NOT NULL AND y IS NOT NULL"), ["x", "y"])
    before = points.select((F.col("number") + 1).alias("number"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    seg = points.join(before, "number", "left").select(F.coalesce("x0", F.lit(0.0)).alias("x0"), F.coalesce("y0", F.lit(0.0)).alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    at = lambda q: F.max(F.when((F.col("x0") < q) & (F.col("x1") >= q), F.col("y0") + (F.col("y1") - F.col("y0")) * (q - F.col("x0")) / (F.col("x1") - F.col("x0"))))
    return seg.agg((1 - 2 * F.sum((F.col("x1") - F.col("x0")) * (F.col("y0") + F.col("y1")) / 2)).alias("c"), (1 - at(0.8)).alias("top20"), at(0.5).alias("bottom50"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (spearman, n): Pearson correlation of average ranks; rows with a null in either column are left out."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("__a"), F.col(b).cast("double").alias("__b"))
    rank = lambda c, name: value_ranks(both, c).select(F.col("v").alias(c), (F.col("below") + (F.col("c") + 1) / 2).alias(name))
    return both.join(rank("__a", "ra"), "__a").join(rank("__b", "rb"), "__b").agg(F.corr("ra", "rb").alias("spearman"), F.count(F.lit(1)).alias("n"))


def quantile_bins(df: DataFrame, value: str, bins: int, name: str = "bin") -> DataFrame:
    """Adds the number (from 1) of the quantile bin, right-closed, equal edges dropped; null for a null."""
    edges = exact_quantiles(df, value, [i / bins for i in range(bins + 1)]).select(F.array_distinct("q").alias("__e"))
    inner = F.slice("__e", 2, F.greatest(F.size("__e") - 2, F.lit(0)))
    return df.join(F.broadcast(edges)).withColumn(name, F.when(F.col(value).isNotNull(), F.size(F.filter(inner, lambda e: e < F.col(value))) + 1)).drop("__e")  # one row


def winsorised(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """The value drawn in to the two quantiles; a null stays null, and a NaN becomes one."""
    edge = exact_quantiles(df, value, [low, high], "__q")
    drawn = F.least(F.greatest(F.col(value), F.col("__q")[0]), F.col("__q")[1])
    return df.join(F.broadcast(edge)).withColumn(value, F.when(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")), drawn)).drop("__q")  # one row
