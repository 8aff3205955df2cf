"""Regression, difference in differences, bootstrap, cross-validation, local regression and tree models.

Rows are reduced to sufficient statistics (cross products, cluster scores) by one aggregation; the driver solves
systems of a few dozen unknowns and never sees rows.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import _settled


def _products(df: DataFrame, names: list[str], group: list[str]) -> DataFrame:
    """Sums of products of all pairs of columns, by group."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs])


def gram(df: DataFrame, y: str, xs: list[str]) -> tuple[np.ndarray, int]:
    """Cross products of (xs, y) as one small matrix, and the number of rows."""
    names = [*xs, y]
    row = _products(df, names, []).collect()[0]
    return _matrix(row, len(names)), int(row["n"])


def _matrix(row, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[f"p{i}_{j}"] or 0.0
    return m


def ols_cluster(df: DataFrame, y: str, xs: list[str], cluster: str, absorbed: int = 0) -> list[dict]:
    """Coefficients with CR1 standard errors; ``absorbed`` effects count as terms of the fit. Clusters are reduced to their cross products, and those to their sum and, in
    a second pass, to the cross products of their scores, so the driver sees two rows for any number of clusters."""
    names = [*xs, y]
    parts = _products(df.dropna(subset=[*names, cluster]), names, [cluster])
    pairs = [c for c in parts.columns if c not in (cluster, "n")]
    row = parts.agg(*[F.sum(c).alias(c) for c in ["n", *pairs]], F.count(F.lit(1)).alias("g")).collect()[0]
    total, k, n, g = _matrix(row, len(names)), len(xs), row["n"], row["g"]
    inv = np.linalg.pinv(total[:k, :k])
    b = inv @ total[:k, k]
    cell = lambda i, j: F.col(f"p{min(i, j)}_{max(i, j)}")
    scores = parts.select(*[(cell(i, k) - sum((cell(i, j) * float(b[j]) for j in range(k)), F.lit(0.0))).alias(f"s{i}") for i in range(k)])
    meat = _matrix(_products(scores, [f"s{i}" for i in range(k)], []).collect()[0], k)
    # One cluster, or no row more than terms, leaves errors undefined.
    se = np.sqrt(np.diag(inv @ meat @ inv * (g / (g - 1)) * ((n - 1) / (n - k - absorbed)))) if g > 1 and n > k + absorbed else np.full(k, np.nan)
    residual = total[k, k] - b @ total[:k, k]
    return [{"term": x, "coef": float(b[i]), "se": float(se[i]) if se[i] == se[i] else None, "t": float(b[i] / se[i]) if se[i] > 0 else None, "n": int(n or 0), "clusters": g, "rss": float(residual)} for i, x in enumerate(xs)]


def _centred_products(df: DataFrame, names: list[str], group: list[str], **more: Column) -> DataFrame:
    """Sums of products of all pairs of columns less their group's means, by one aggregation that is combined before the shuffle: no
    row is joined to its means. Running means keep a constant column's products zero."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[(F.covar_pop(names[i], names[j]) * F.count(F.lit(1))).alias(f"p{i}_{j}") for i, j in pairs], *[c.alias(k) for k, c in more.items()])


def did_2x2(panel: DataFrame) -> DataFrame:
    """(did, n): difference of differences of means of (y, post, treated)."""
    m = lambda p, t: F.avg(F.when((F.col("post") == p) & (F.col("treated") == t), F.col("y")))
    return panel.agg(((m(1, 1) - m(0, 1)) - (m(1, 0) - m(0, 0))).alias("did"), F.count(F.lit(1)).alias("n"))


WEBB = np.array([-np.sqrt(1.5), -1, -np.sqrt(0.5), np.sqrt(0.5), 1, np.sqrt(1.5)])


def did_fit(panel: DataFrame, treatments: list[str], draws: int = 999, seed: int = 42) -> list[dict]:
    """Difference in differences of several treatments at once, with point effects, CR1 t and a wild cluster bootstrap p
    of each (Webb weights, its null imposed).

    Points are both the fixed effects and the clusters; each is reduced to its cross products, from which all draws are
    made where it lies, with numbers fixed by the point and the seed. A draw's coefficients and its variance are sums over
    points, so the driver sees ``draws`` numbers a part, never the points.
    """
    k = len(treatments) + 1
    names = [f"__x{i}" for i in range(k)]
    d = panel.withColumns({names[i]: (F.col("post") * F.col(c)).cast("double") for i, c in enumerate(treatments)} | {names[-1]: F.col("post").cast("double"), "__y": F.col("y").cast("double")}).dropna(subset=[*names, "__y", "point"])
    # A row a point, written once: all sums and draws come from these.
    parts = _settled(_centred_products(d, [*names, "__y"], ["point"], **{f"t{i}": F.max(c) for i, c in enumerate(treatments)}))
    cells = [c for c in parts.columns if c.startswith("p") and c != "point"]
    ever = [F.count_if(F.col(f"t{i}") > 0).alias(f"t{i}") for i in range(k - 1)]
    row = treated = parts.agg(*[F.sum(c).alias(c) for c in ["n", *cells]], F.count(F.lit(1)).alias("g"), *ever).collect()[0]
    total, n, g = _matrix(row, k + 1), row["n"], row["g"]
    inv = np.linalg.pinv(total[:k, :k])
    b = inv @ total[:k, k]
    factor = (g / (g - 1)) * ((n - 1) / (n - k - g)) if g > 1 and n - k > g else float("nan")
    keyed = parts.select(F.xxhash64(F.col("point").cast("string")).alias("key"), *cells)

    def drawn(j: int, betas: np.ndarray | None):
        """Sums over points: without betas each draw's X'y, else the square of its coefficient's score."""
        kept = [i for i in range(k) if i != j]
        null = np.zeros(k)
        null[kept] = np.linalg.pinv(total[np.ix_(kept, kept)]) @ total[kept, k]

        def run(frames):
            sums = np.zeros((draws, k) if betas is None else draws)
            for f in frames:
                for key, *v in f.itertuples(index=False, name=None):
                    m = _matrix(dict(zip(cells, v)), k + 1)
                    fitted = m[:k, :k] @ null
                    xy = fitted + np.outer(np.random.default_rng([seed, j, key % 2**63]).choice(WEBB, draws), m[:k, k] - fitted)
                    sums += xy if betas is None else ((xy - betas @ m[:k, :k]) @ inv[j]) ** 2
            yield pd.DataFrame({"draw": np.arange(draws), "v": list(sums.reshape(draws, -1))})

        met = keyed.mapInPandas(run, "draw int, v array<double>")
        rows = met.groupBy("draw").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(k if betas is None else 1)]).alias("v")).orderBy("draw").collect()  # one row a draw
        return np.array([r["v"] for r in rows])

    own = keyed.select(*[((sum((float(inv[j, i]) * (F.col(f"p{i}_{k}") - sum((F.col(f"p{min(i, q)}_{max(i, q)}") * float(b[q]) for q in range(k)), F.lit(0.0))) for i in range(k)), F.lit(0.0))) ** 2).alias(f"v{j}") for j in range(k - 1)])
    squares = own.agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(k - 1)]).collect()[0]
    out = []
    for j, name in enumerate(treatments):
        se = float(np.sqrt(squares[f"v{j}"] * factor))
        t = float(b[j] / se) if se > 0 else float("nan")
        p = float("nan")
        if draws and se > 0:
            betas = drawn(j, None) @ inv
            ts = betas[:, j] / np.sqrt(drawn(j, betas)[:, 0] * factor)
            p = float((np.abs(ts) >= abs(t)).mean())
        out.append({"treatment": name, "coef": float(b[j]), "se": se, "t": t, "p_boot": p, "n": int(n), "points": int(g), "treated_points": int(treated[f"t{j}"])})
    return out


def did_cluster(panel: DataFrame, draws: int = 999, seed: int = 42) -> dict:
    """Difference in differences of one treatment (did_fit)."""
    found = did_fit(panel, ["treated"], draws, seed)[0]
    return {c: found[c] for c in ("coef", "se", "t", "p_boot", "n", "points")}


def did_checks(panel: DataFrame, minutes: str, limits: tuple[float, ...] = (10, 20, 25), bands: tuple[float, ...] = (0, 15, 30), placebos: tuple[str, ...] = (), near: float = 15, subsets: dict[str, Column] | None = None, trim: tuple[float, float] = (0.05, 0.95), draws: int = 199, seed: int = 42) -> list[dict]:
    """Difference in differences under other choices: nearness limits, bands of travel time together, placebo columns of
    minutes to other places, values between two quantiles of their period, and subsets of rows. One row a check and treatment."""
    m = F.col(minutes)
    panel = _settled(panel)  # each check meets the rows many times: what they were joined from is read, and sent to the driver for a broadcast, once
    d = panel.withColumns({f"near_{v:g}": (m <= v).cast("int") for v in {*limits, near}} | {f"band_{a:g}_{b:g}": ((m > a if a else m >= a) & (m <= b)).cast("int") for a, b in zip(bands, bands[1:])} | {f"placebo_{c}": (F.col(c) <= near).cast("int") for c in placebos})
    q = F.broadcast(group_quantiles(panel, "post", "y", {"__lo": trim[0], "__hi": trim[1]}))  # a row a period
    runs = [(f"limit {v:g}", d, [f"near_{v:g}"]) for v in limits] + [("dose", d, [f"band_{a:g}_{b:g}" for a, b in zip(bands, bands[1:])])] + [(f"placebo {c}", d, [f"placebo_{c}"]) for c in placebos]
    runs += [("trimmed", d.join(q, "post").filter(F.col("y").between(F.col("__lo"), F.col("__hi"))), [f"near_{near:g}"])] + [(k, d.filter(c), [f"near_{near:g}"]) for k, c in (subsets or {}).items()]
    return [{"check": label} | r for label, rows, treatments in runs for r in did_fit(rows, treatments, draws, seed)]


def within(df: DataFrame, columns: list[str], effects: list[str], tolerance: float = 1e-10, most_rounds: int = 500) -> tuple[DataFrame, int]:
    """The columns less all their effects (group means, worked out together), and how many effects that takes away.

    The means of one effect are taken off after the other, again and again, until none is left. That needs only the sums of the
    cells in which all effects are equal, so the rounds run over the table of cells and the rows are met once, at the end.
    Rows with an unknown column or effect are left out.
    """
    from .graph import _settled

    rows = df.dropna(subset=[*columns, *effects])
    own, of = [f"__m{i}" for i in range(len(columns))], [f"__o{i}" for i in range(len(columns))]
    cells = _settled(rows.groupBy(*effects).agg(F.count(F.lit(1)).alias("__n"), *[F.avg(F.col(c).cast("double")).alias(o) for c, o in zip(columns, of)]).withColumns({m: F.col(o) for m, o in zip(own, of)}))
    size = cells.agg(*[F.max(F.abs(m)).alias(m) for m in own]).collect()[0]
    scale = max([1e-300, *[v for v in size if v is not None]])
    for _ in range(most_rounds):
        shift = []
        for e in effects:
            w = Window.partitionBy(e)
            cells = cells.withColumns({f"__d{m}": F.sum(F.col("__n") * F.col(m)).over(w) / F.sum("__n").over(w) for m in own}).withColumns({m: F.col(m) - F.col(f"__d{m}") for m in own})
            cells = cells.withColumn(f"__s{len(shift)}", F.greatest(*[F.abs(f"__d{m}") for m in own], F.lit(0.0))).drop(*[f"__d{m}" for m in own])
            shift.append(f"__s{len(shift)}")
        cells = _settled(cells)
        most = cells.agg(*[F.max(x).alias(x) for x in shift]).collect()[0]
        cells = cells.drop(*shift)
        if max([0.0, *[v for v in most if v is not None]]) <= tolerance * scale or len(effects) == 1:
            break
    else:
        raise RuntimeError(f"effects still change after {most_rounds} rounds")
    levels = cells.agg(*[F.count_distinct(e).alias(e) for e in effects]).collect()[0]
    met = rows.join(cells.select(*effects, *[(F.col(m) - F.col(o)).alias(m) for m, o in zip(own, of)]), effects)
    return met.withColumns({c: F.col(c) + F.col(m) for c, m in zip(columns, own)}).drop(*own), sum(levels) - len(effects) + 1


def specifications(df: DataFrame, y: str, specs: dict[str, list[str]], controls: list[str], cluster: str, further: tuple[str, ...] = (), effects: dict[str, list[str]] | None = None) -> list[dict]:
    """Coefficients of the terms of each specification beside the controls, without and with the further terms; clustered errors.

    ``effects`` names the columns whose levels a specification takes out (sectors, bands of time); it then needs no constant.
    """
    d, rows = df.withColumn("__one", F.lit(1.0)), []
    for name, terms in specs.items():
        for more in [[], list(further)] if further else [[]]:
            xs, taken = [*terms, *more, *controls], (effects or {}).get(name)
            if taken:
                data, absorbed = within(df, [y, *xs], taken)
                fit = ols_cluster(data, y, xs, cluster, absorbed)
            else:
                fit = ols_cluster(d, y, ["__one", *xs], cluster)
            rows += [{"spec": name, "further": bool(more)} | r for r in fit if r["term"] in (*terms, *more)]
    return rows


def placebo_lines(df: DataFrame, y: str, line: str, others: list[str], controls: list[str], cluster: str) -> list[dict]:
    """For each other line, the line's and its coefficient with normal p side by side, in one fit beside the controls: what a line
    without a new road seems to do."""
    import math

    d, rows = df.withColumn("__one", F.lit(1.0)), []
    p = lambda r: math.erfc(abs(r["t"]) / 2**0.5) if r["t"] is not None else None
    for other in others:
        fit = {r["term"]: r for r in ols_cluster(d, y, ["__one", line, other, *controls], cluster)}
        rows.append({"line": other, "coef_other": fit[other]["coef"], "p_other": p(fit[other]), "coef_line": fit[line]["coef"], "p_line": p(fit[line]), "n": fit[line]["n"]})
    return rows


def premium(coefs: list[dict], term: str) -> dict:
    c = next(r for r in coefs if r["term"] == term)
    pct = lambda v: 100 * (np.exp(v) - 1)
    return {"term": term, "premium": float(pct(c["coef"])), "low": float(pct(c["coef"] - 1.96 * c["se"])), "high": float(pct(c["coef"] + 1.96 * c["se"]))}


def _by_rank(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, v, c, below, n): how often each value is in its group, how many of the group are below it, and the group's size.

    Values are counted first and put in order by ranges, so neither a large group nor a frequent value is a task of its own.
    """
    from .relational import in_ranges, range_starts

    known = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    placed = in_ranges(known.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c")), ["g", "v"])
    starts = range_starts(placed, {"__start": F.sum("c")})
    w = Window.partitionBy("__range").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    ordered = placed.join(F.broadcast(starts), "__range").select("g", "v", "c", (F.col("__start") + F.sum("c").over(w) - F.col("c")).alias("below"))  # a row a range
    sizes = ordered.groupBy("g").agg(F.min("below").alias("first"), F.sum("c").alias("n"))
    return ordered.join(sizes, "g").select("g", "v", "c", (F.col("below") - F.col("first")).alias("below"), "n")


def group_quantiles(df: DataFrame, group: str, value: str, at: dict[str, float]) -> DataFrame:
    """(group, a column for each of ``at``): linearly interpolated quantiles of a group's values; nulls and NaN are no values. The values
    are counted in order by ranges, so no task holds those of a group."""
    below, c, n, v = (F.col(x) for x in ("below", "c", "n", "v"))
    of = lambda rank: F.max(F.when((below <= rank) & (rank < below + c), v))
    low, high = (lambda q: F.floor((n - 1) * F.lit(float(q)))), (lambda q: F.ceil((n - 1) * F.lit(float(q))))
    ends = _by_rank(df, group, value).groupBy("g").agg(F.max("n").alias("n"), *[of(f(q)).alias(f"{e}{i}") for i, q in enumerate(at.values()) for e, f in (("l", low), ("h", high))])
    place = lambda q: (n - 1) * F.lit(float(q))
    value_at = lambda i, q: F.when(low(q) == high(q), F.col(f"l{i}")).otherwise((high(q) - place(q)) * F.col(f"l{i}") + (place(q) - low(q)) * F.col(f"h{i}"))
    return ends.select(F.col("g").alias(group), *[value_at(i, q).alias(k) for i, (k, q) in enumerate(at.items())])


def values_at(ranks: DataFrame, asked: DataFrame, parts: int = 1024) -> DataFrame:
    """The asked rows (g, rank from 0, ...) with the value ``v`` of that rank. ranks as of _by_rank.

    Ranks of a group fall into at most ``parts`` buckets of equal width; a value is in the buckets its ranks touch.
    """
    width = F.greatest(F.lit(1), F.ceil(F.col("n") / parts)).cast("bigint")
    held = ranks.withColumn("b", F.explode(F.sequence(F.floor(F.col("below") / width), F.floor((F.col("below") + F.col("c") - 1) / width)))).select("g", "b", "v", "c", "below")
    sized = asked.join(ranks.select("g", "n").distinct(), "g").withColumn("b", F.floor(F.col("rank") / width)).drop("n")
    return sized.join(held, ["g", "b"]).filter((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("c"))).drop("b", "c", "below")


def _asked(ranks: DataFrame, rows, schema: str) -> DataFrame:
    """Rows (g, ...) that rows(n, key) makes of each group's size, a group at a time; key tells groups apart for their random draws."""
    kind = dict(ranks.dtypes)["g"]
    sizes = ranks.groupBy("g").agg(F.max("n").alias("n")).withColumn("key", F.crc32(F.col("g").cast("string").cast("binary")))
    names = ["g", *[c.split()[0] for c in schema.split(", ")]]

    def made(frames):
        for f in frames:
            for g, n, key in zip(f["g"], f["n"], f["key"]):
                got = rows(int(n), int(key))
                if got is not None and len(got[0]):
                    yield pd.DataFrame(dict(zip(names, [[g] * len(got[0]), *got])))

    return sizes.repartition("g").mapInPandas(made, f"g {kind}, {schema}")


def bootstrap_median(df: DataFrame, group: str, value: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(group, median, low, high): percentile interval of resampled medians; nulls and NaN are no values, a group without any has nulls.

    The median of a resample is the value at a random place: with n values the middle of n uniform numbers has a beta
    distribution (of an even n the two middle ones have a joint one), and the place is that number times n. So only places
    are drawn, and their values looked up among counted values; no group is gathered and nothing is resampled.
    """
    ranks = _by_rank(df, group, value)

    def places(n: int, key: int):
        rng = np.random.default_rng([seed, key])
        m = (n + 1) // 2
        u = rng.beta(m, n + 1 - m, draws)
        pick = lambda u: np.minimum((u * n).astype(np.int64), n - 1)
        second = pick(u + (1 - u) * rng.beta(1, n - m, draws)) if n % 2 == 0 else pick(u)
        at = np.arange(draws)
        return np.r_[-1, -1, at, at], np.r_[(n - 1) // 2, n // 2, pick(u), second]

    medians = values_at(ranks, _asked(ranks, places, "draw int, rank bigint")).groupBy("g", "draw").agg(F.avg("v").alias("m"))
    drawn = F.when(F.col("draw") >= 0, F.col("m"))
    found = medians.groupBy("g").agg(F.max(F.when(F.col("draw") < 0, F.col("m"))).alias("median"), F.percentile(drawn, F.array(F.lit(0.025), F.lit(0.975))).alias("e"))  # a number a draw
    return df.select(F.col(group).alias("g")).distinct().join(found, "g", "left").select(F.col("g").alias(group), "median", F.col("e")[0].alias("low"), F.col("e")[1].alias("high"))


def precision_curve(df: DataFrame, group: str, value: str, sizes: tuple[int, ...] = (10, 20, 40, 80), draws: int = 30, seed: int = 42) -> DataFrame:
    """(group, size, half_width): mean relative half-width of the median's interval at sample sizes, for groups of at least that many values.

    Samples are drawn as places in the group and looked up, so a group gives only its samples to a task, whatever its size.
    """
    ranks = _by_rank(df, group, value)

    def places(n: int, key: int):
        rng = np.random.default_rng([seed, key])
        rows = [(s, d, r) for s in sizes if n >= s for d in range(draws) for r in rng.choice(n, s, replace=False, shuffle=False).tolist()]
        return tuple(map(list, zip(*rows))) if rows else None

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        rows = []
        for s, part in pdf.groupby("size"):
            halves = []
            for _, x in part.sort_values("v").groupby("draw")["v"]:
                m = np.median(rng.choice(x.to_numpy(), (200, int(s))), axis=1)
                middle = np.median(x)
                halves.append((np.percentile(m, 97.5) - np.percentile(m, 2.5)) / 2 / middle if middle else np.nan)
            rows.append((pdf["g"].iloc[0], int(s), float(np.mean(halves))))
        return pd.DataFrame(rows, columns=[group, "size", "half_width"])

    asked = values_at(ranks, _asked(ranks, places, "size int, draw int, rank bigint"))
    return asked.groupBy("g").applyInPandas(one, f"{group} {dict(df.dtypes)[group]}, size int, half_width double")


def cv_metrics(df: DataFrame, group: list[str], y: str, yhat: str) -> DataFrame:
    """(n, rmse, mae, r2, mape) by group; r2 of a constant target is null."""
    e = F.col(y) - F.col(yhat)
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e * e), F.count(F.lit(1)) * F.var_pop(y))).alias("r2"), F.avg(F.abs(F.exp(e) - 1)).alias("mape"))


def block_folds(df: DataFrame, block: str, folds: int) -> DataFrame:
    """Adds fold: whole blocks dealt by size to the emptiest fold. The table of blocks (thousands) is dealt on the driver and sent to
    the rows: blocks are few and large, so rows brought together by block would be one task each."""
    sizes = df.groupBy(block).count().orderBy(F.desc("count"), block).collect()
    load = [0] * folds
    rows = []
    for r in sizes:
        k = load.index(min(load))
        load[k] += r["count"]
        rows.append((r[block], k))
    kind = dict(df.dtypes)[block]
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, f"{block} {kind}, fold int")), block)


def learner(features: list[str], y: str, trees: int, seed: int, boosted: bool):
    """A forest, or boosted trees, over the column __x made by ``filled``."""
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    return GBTRegressor(featuresCol="__x", labelCol=y, maxIter=trees, seed=seed) if boosted else RandomForestRegressor(featuresCol="__x", labelCol=y, numTrees=trees, maxDepth=6, seed=seed)


def middles(train: DataFrame, features: list[str]) -> dict[str, float]:
    row = train.agg(*[F.percentile_approx(f, 0.5, 10_000).alias(f) for f in features]).collect()[0]  # one row
    return {f: float(row[f] or 0.0) for f in features}


def filled(df: DataFrame, features: list[str], middle: dict[str, float]) -> DataFrame:
    """Adds __in_<feature>, the value or else the median, and their vector __x."""
    from pyspark.ml.feature import VectorAssembler

    known = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    return VectorAssembler(inputCols=[f"__in_{f}" for f in features], outputCol="__x").transform(df.withColumns({f"__in_{f}": F.coalesce(known(f), F.lit(middle[f])) for f in features}))


#: Training rows of a task of a learner, about.
FIT_ROWS = 100_000


def dealt(df: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """The columns of about ``rows`` rows, in tasks of equal numbers of them. Which rows a task has, and their order, follow from the
    rows' values alone: a learner samples task by task to find its splits, so it would else depend on files and cores."""
    h = F.xxhash64(*df.columns)
    return df.select(*columns, h.alias("__h")).repartition(max(1, -(-rows // FIT_ROWS)), "__h").sortWithinPartitions("__h", *columns).drop("__h")


def forest_cv(df: DataFrame, features: list[str], y: str, fold: str, trees: int = 20, seed: int = 42, boosted: bool = False) -> DataFrame:
    """Predictions of every row by a forest (or boosted trees) fitted on the other folds' rows that have a target; missing features take the training median."""
    out = None
    sizes = {r[fold]: r["count"] for r in df.groupBy(fold).count().collect()}
    for r in sorted(sizes):
        train, test = df.filter((F.col(fold) != r) & F.col(y).isNotNull()), df.filter(F.col(fold) == r)
        middle = middles(train, features)
        part = learner(features, y, trees, seed, boosted).fit(filled(dealt(train, [*features, y], sum(sizes.values()) - sizes[r]), features, middle)).transform(filled(test, features, middle)).drop("__x", *[f"__in_{f}" for f in features])
        out = part if out is None else out.unionByName(part)
    return out


def random_folds(df: DataFrame, rid: str, folds: int, seed: int = 42) -> DataFrame:
    """Adds fold from a hash of the id, so a rerun deals the same folds."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(rid), F.lit(seed)), F.lit(folds)).cast("int"))


def cv_schemes(df: DataFrame, features: list[str], y: str, rid: str, block: str, folds: int = 5, trees: int = 20, neighbours: int = 50) -> DataFrame:
    """(scheme, model, n, rmse, mae, r2, mape) over all rows: folds of whole blocks against random folds; a forest, a linear
    baseline and a local regression (needs x, y coordinates in columns "x" and "y") predict each fold from the others."""
    out = None
    for scheme, d in (("block", block_folds(df, block, folds)), ("random", random_folds(df, rid, folds))):
        found = {"forest": forest_cv(d, features, y, "fold", trees)}
        for r in sorted(x[0] for x in d.select("fold").distinct().collect()):
            train, test = d.filter(F.col("fold") != r), d.filter(F.col("fold") == r)
            for name, part in (("linear", linear_baseline(train, test, features, y)), ("local", test.join(gwr(df.sparkSession, train.withColumnRenamed(rid, "rid"), y, features, neighbours, at=test.withColumnRenamed(rid, "rid")).select(F.col("rid").alias(rid), F.col("fitted").alias("prediction")), rid))):
                found[name] = found[name].unionByName(part) if name in found else part
        for name, part in found.items():
            rows = cv_metrics(part.withColumns({"scheme": F.lit(scheme), "model": F.lit(name)}), ["scheme", "model"], y, "prediction")
            out = rows if out is None else out.unionByName(rows)
    return out


def gwr(spark: SparkSession, df: DataFrame, y: str, xs: list[str], neighbours: int = 100, at: DataFrame | None = None) -> DataFrame:
    """(rid, fitted, b0 .. bk, residual, leverage, c0 .. ck): adaptive bisquare local regression at every point with a target
    and features, or at every point of ``at`` with features, whose residual and leverage are null.

    leverage is the weight of a point's own target in its fitted value; c are the sums of squared weights of all targets in
    a coefficient, so a coefficient's variance is c times that of the errors.

    A fit weighs only the points nearer than its neighbours-th nearest. A block of points meets the leaves of the packed tree that
    hold those of any of its points; in its task few neighbouring points at a time are fitted together, by products of matrices
    over the rows that any of them may weigh.
    """
    from . import tree
    from .spatial import _away, _numbers

    names, squares = [f"b{i}" for i in range(len(xs) + 1)], [f"c{i}" for i in range(len(xs) + 1)]
    features = [f"__f{i}" for i in range(len(xs))]
    place = ["rid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *[F.col(c).cast("double").alias(f) for c, f in zip(xs, features)]]
    data = df.select(*place, F.col(y).cast("double").alias("__y")).dropna()
    goal = data if at is None else at.select(*place).dropna().withColumn("__y", F.lit(None).cast("double"))
    at_place = tuple(F.col(c) for c in "xyxy")
    if at is None:  # the rows are sorted and written once
        asking = tree.build(data, at_place, capacity=lambda rows: tree.block_of(rows, rows))
        held = asking.cut(tree.HELD)
    else:
        held = tree.build(data.drop("rid"), at_place, capacity=tree.HELD)
        asking = tree.build(goal, at_place, capacity=lambda rows: tree.block_of(rows, held.n))
    held, n = replace(held, items=held.items.drop("rid")), held.n
    skipped = int(at is None)  # a point is no neighbour of itself
    columns = ["fitted", *names, "residual", "leverage", *squares]
    kind = f"rid {dict(data.dtypes)['rid']}, {', '.join(f'{c} double' for c in columns)}"
    k, terms = min(neighbours, n - skipped), len(xs) + 1

    def fit(own: pa.Table, around: pa.Table) -> pa.Table:
        xy, mine, real = _numbers(own, "x", "y"), np.c_[np.ones(own.num_rows), *[_numbers(own, f) for f in features]], _numbers(own, "__y")[:, 0]
        at, design, target = _numbers(around, "x", "y"), np.c_[np.ones(around.num_rows), *[_numbers(around, f) for f in features]], _numbers(around, "__y")[:, 0]
        both = (design[:, :, None] * design[:, None, :]).reshape(len(at), -1)
        out = np.full((own.num_rows, len(columns)), np.nan)

        def answer(part, rows):
            d = _away(at[rows], xy[part, :1], xy[part, 1:])
            h = np.partition(d, k - 1 + skipped, axis=1)[:, k - 1 + skipped, None] + 1e-9
            w = np.where(d < h, (1 - (d / h) ** 2) ** 2, 0.0)
            inv = np.linalg.pinv((w @ both[rows]).reshape(-1, terms, terms))
            b = (inv @ (w @ (design[rows] * target[rows, None]))[:, :, None])[:, :, 0]
            me = mine[part]
            value, own_weight = (me * b).sum(1), np.einsum("pi,pij,pj->p", me, inv, me)
            spread = np.einsum("pij,pjk,pik->pi", inv, (w * w @ both[rows]).reshape(-1, terms, terms), inv)
            out[part] = np.c_[value, b, real[part] - value, np.where(np.isnan(real[part]), np.nan, own_weight), spread]

        tree.narrowed(xy, np.arange(len(at)), lambda part, middle, way, rows: rows[tree.within_reach(_away(at[rows], *middle), k + skipped, way)], answer)
        unknown = {c: np.isnan(real) for c in ("residual", "leverage")}
        return pa.table({"rid": own["rid"], **{c: pa.array(out[:, i], mask=unknown.get(c)) for i, c in enumerate(columns)}})

    if not n:
        return spark.createDataFrame([], kind)
    return tree.nearest_leaves(asking, held, k + skipped, wider=tree.WIDER).each(fit, kind)


def gwr_score(fits: DataFrame) -> dict:
    """n, rss, trace (effective parameters), sigma2 and the corrected Akaike criterion of a local regression, from one aggregation."""
    r = fits.agg(F.count("residual").alias("n"), F.sum(F.col("residual") * F.col("residual")).alias("rss"), F.sum("leverage").alias("trace")).collect()[0]
    n, rss, trace = r["n"], r["rss"] or 0.0, r["trace"] or 0.0
    aicc = n * np.log(2 * np.pi * rss / n) + n + 2 * n * (trace + 1) / (n - trace - 2) if rss > 0 and n - trace > 2 else float("inf")
    return {"n": int(n), "rss": float(rss), "trace": float(trace), "sigma2": float(rss / (n - trace)) if n > trace else float("nan"), "aicc": float(aicc)}


def gwr_bandwidth(spark: SparkSession, df: DataFrame, y: str, xs: list[str], least: int, most: int) -> list[dict]:
    """(neighbours, n, rss, trace, sigma2, aicc) of the numbers of neighbours tried, best first: golden sections of [least, most]."""
    tried: dict[int, dict] = {}

    def cost(k: int) -> float:
        if k not in tried:
            tried[k] = {"neighbours": k} | gwr_score(gwr(spark, df, y, xs, k))
        return tried[k]["aicc"]

    low, high, share = least, most, (5**0.5 - 1) / 2
    while high - low > 2:
        a, b = round(high - share * (high - low)), round(low + share * (high - low))
        if a >= b:
            break
        low, high = (low, b) if cost(a) <= cost(b) else (a, high)
    for k in range(low, high + 1):
        cost(k)
    return sorted(tried.values(), key=lambda r: (r["aicc"], r["neighbours"]))


def gwr_tests(fits: DataFrame, terms: int, alpha: float = 0.05) -> DataFrame:
    """Adds t0 .. and sig0 ..: a coefficient's t, and whether it passes alpha divided by the effective number of parameters
    per term, for the many dependent tests."""
    from statistics import NormalDist

    s = gwr_score(fits)
    z = NormalDist().inv_cdf(1 - min(alpha, alpha * terms / max(s["trace"], 1e-9)) / 2)
    free = max(s["n"] - 1, 1)
    cut = z + (z**3 + z) / (4 * free) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * free**2)  # Student's quantile by its series in 1 / free
    t = {f"t{i}": F.col(f"b{i}") / F.sqrt(F.nullif(F.col(f"c{i}") * s["sigma2"], F.lit(0.0))) for i in range(terms)}
    return fits.withColumns(t).withColumns({f"sig{i}": F.abs(f"t{i}") > float(cut) for i in range(terms)})


def shuffled(numbers: np.ndarray, n: int, draw: int, seed: int) -> np.ndarray:
    """Where a draw's permutation of 0 .. n - 1 sends the numbers: a keyed Feistel network of eight rounds over the next power of
    four, gone through again until the number is below n. No table of the permutation is held anywhere."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([seed, draw]).integers(0, 1 << 62, 8, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return (left << np.uint64(half)) | right

    x = once(numbers.astype(np.uint64))
    while (over := x >= np.uint64(n)).any():
        x[over] = once(x[over])
    return x.astype(np.int64)


def moran_permutation(values: DataFrame, weights: DataFrame, permutations: int = 999, seed: int = 42, lot: int = 100) -> dict:
    """Pseudo p of Moran's I of values (id, v) under weights (i, j, w): (moran, p, z); nulls and NaN take no part, undefined is None.

    Each unit works out where every draw sends its value (a keyed permutation of unit numbers), so a draw's values are met by
    joins and its I is a sum over weights; draws go ``lot`` at a time. The driver sees a number a draw and no unit.
    """
    from .graph import _settled
    from .relational import numbered
    from .spatial import _held

    held = numbered(_held(values).select("id", F.col("v").cast("double").alias("v")), ["id"], "at")
    m = held.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.count(F.lit(1)).alias("n")).collect()[0]
    n = m["n"]
    nothing = {"moran": None, "p": None, "z": None}
    if not n or not m["s"]:
        return nothing
    z = _settled(held.select("id", "at", ((F.col("v") - m["m"]) / m["s"]).alias("z")))
    place = z.select("id", "at")
    ways = weights.join(place.withColumnsRenamed({"id": "i", "at": "a"}), "i").join(place.withColumnsRenamed({"id": "j", "at": "b"}), "j").select("a", "b", "w")
    ways = _settled(ways)
    total = ways.agg(F.sum("w").alias("w")).collect()[0]["w"]
    if not total:
        return nothing

    def drawn(first: int, last: int) -> DataFrame:
        """(at, z of each draw): what the draws put at a unit; draw 0 is the values as they are."""

        def send(frames):
            for f in frames:
                at = f["at"].to_numpy(np.int64)
                for d in range(first, last):
                    yield pd.DataFrame({"draw": d, "at": at if d == 0 else shuffled(at, n, d, seed), "z": f["z"].to_numpy()})

        sent = z.select("at", "z").mapInPandas(send, "draw int, at bigint, z double")
        return sent.groupBy("at").agg(F.transform(F.sort_array(F.collect_list(F.struct("draw", "z"))), lambda x: x["z"]).alias("z"))  # a number a draw

    sums: list[float] = []
    for first in range(0, permutations + 1, lot):
        last = min(first + lot, permutations + 1)
        zs = drawn(first, last)
        met = ways.join(zs.select(F.col("at").alias("a"), F.col("z").alias("za")), "a").join(zs.select(F.col("at").alias("b"), F.col("z").alias("zb")), "b")

        def add(frames, width=last - first):
            acc = np.zeros(width)
            for f in frames:
                if len(f):
                    acc += (f["w"].to_numpy()[:, None] * np.stack(f["za"]) * np.stack(f["zb"])).sum(axis=0)
            yield pd.DataFrame({"k": range(width), "s": acc})

        part = {r["k"]: r["s"] for r in met.select("w", "za", "zb").mapInPandas(add, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()}  # a row a draw
        sums += [part[k] / total for k in range(last - first)]
    observed, sims = sums[0], np.array(sums[1:])
    far = np.abs(sims - sims.mean()) >= abs(observed - sims.mean())
    return {"moran": float(observed), "p": float((far.sum() + 1) / (permutations + 1)), "z": float((observed - sims.mean()) / sims.std()) if sims.std() > 0 else None}


def covered(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, int]]:
    """Share of rows with a value and number of different values (at most a few matter; approximate beyond), in one pass."""
    there = [c for c in columns if c in df.columns]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(there)], *[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(there)]).collect()[0]  # one row
    return {c: (row[f"c{i}"] / row["n"] if row["n"] else 0.0, row[f"d{i}"]) for i, c in enumerate(there)}


def feature_matrix(df: DataFrame, numeric: list[str], categorical: list[str], flags: str = "f_", least: float = 0.3, xy: tuple[str, str] | None = ("x", "y")) -> tuple[DataFrame, list[str]]:
    """Adds the model's columns and names them: numbers present in more than ``least`` of the rows, all flags, one 0/1
    column for each level of a category that has several (null is the level "missing"), coordinates in kilometres."""
    share = covered(df, [*numeric, *categorical])
    names = [c for c in numeric if share.get(c, (0.0, 0))[0] > least] + [c for c in df.columns if c.startswith(flags)]
    out = df.withColumns({c: F.col(c).cast("double") for c in names}) if names else df
    for c in categorical:
        level = F.coalesce(F.col(c).cast("string"), F.lit("missing"))
        levels = levels_of(df.select(level.alias(c)), c) if share.get(c, (0.0, 0))[1] > 1 else []
        out = out.withColumns({f"{c}__{v}": (level == v).cast("double") for v in levels}) if levels else out
        names += [f"{c}__{v}" for v in levels]
    if xy:
        out = out.withColumns({"x_km": F.col(xy[0]) / 1000, "y_km": F.col(xy[1]) / 1000})
        names += ["x_km", "y_km"]
    return out, names


#: Terms of the price model: name, columns it needs, expression, least share of rows with a value, market or None for both.
PRICE_TERMS = (
    ("bedrooms", lambda: F.col("bedrooms"), "bedrooms", 0.0, None),
    ("bedrooms_squared", lambda: F.col("bedrooms") * F.col("bedrooms"), "bedrooms", 0.0, None),
    ("bathrooms", lambda: F.col("bathrooms"), "bathrooms", 0.8, None),
    ("log_plot", lambda: F.when(F.col("plot_decimals") > 0, F.ln("plot_decimals")), "plot_decimals", 0.5, "sale"),
    ("log_night_light", lambda: F.log1p("ntl_500m"), "ntl_500m", 0.8, None),
    ("wealth_index", lambda: F.col("wealth_index"), "wealth_index", 0.8, None),
)


def price_design(df: DataFrame, market: str, amenities: list[str], distances: list[str], effects: dict[str, str | None]) -> tuple[DataFrame, list[str]]:
    """Adds the columns of a log-price regression to the rows of a market and names them, by what the rows hold.

    Terms of PRICE_TERMS and the given amenities (as they are) and distances (log of one more) enter if enough rows have
    them and they vary; ``effects`` are categories with their reference level, or None for the first. Rows without a
    needed value are left out.
    """
    d = df.filter(F.col("listing_type") == market).withColumn("__one", F.lit(1.0))
    share = covered(d, [*{t[2] for t in PRICE_TERMS}, *amenities, *distances, *effects])
    there = lambda c, least: c in share and share[c][0] > least and share[c][1] > 1
    made = {f"t_{n}": e().cast("double") for n, e, c, least, only in PRICE_TERMS if only in (None, market) and there(c, least)}
    made |= {f"t_{c}": F.col(c).cast("double") for c in amenities if there(c, 0.8)} | {f"t_log_{c}": F.log1p(F.col(c).cast("double")) for c in distances if there(c, 0.8)}
    d = d.withColumns(made) if made else d
    names = ["__one", *made]
    for c, reference in effects.items():
        if share.get(c, (0.0, 0))[1] > 1:
            levels = levels_of(d, c)
            levels = [v for v in levels if v == reference] + [v for v in levels if v != reference]
            d, more = dummies(d, c, levels, f"t_{c}__")
            names += more
    return d.dropna(subset=names), names


def wealth_index(df: DataFrame, columns: list[str], reversed_columns: tuple[str, ...] = ()) -> tuple[DataFrame, float]:
    """Adds wealth: the first principal component of standardised shares, sign-fixed and standardised; and its explained share."""
    stats = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)]).collect()[0]
    z = {f"z{i}": F.coalesce((F.col(c) - stats[f"m{i}"]) / stats[f"s{i}"], F.lit(0.0)) * (-1 if c in reversed_columns else 1) for i, c in enumerate(columns)}
    d = df.withColumns(z)
    m, n = gram(d.withColumn("__one", F.lit(1.0)), "__one", list(z))
    k = len(columns)
    cov = (m[:k, :k] - np.outer(m[:k, k], m[:k, k]) / n) / (n - 1)
    vals, vecs = np.linalg.eigh(cov)
    pc = vecs[:, -1] * (np.sign(vecs[:, -1].sum()) or 1.0)
    sd = float(np.sqrt(pc @ cov @ pc))
    mean = float(pc @ m[:k, k] / n)
    score = sum((F.col(f"z{i}") * float(pc[i]) for i in range(k)), F.lit(0.0))
    return d.withColumn("wealth", (score - mean) / sd).drop(*z), float(vals[-1] / vals.sum())


def income_model(parishes: DataFrame) -> DataFrame:
    """Adds modelled income: regional median shifted by the calibrated slope times the parish's wealth above its region's mean."""
    h = F.col("households")
    sr = parishes.groupBy("region").agg((F.sum(h * F.col("wealth")) / F.sum(h)).alias("wealth_mean"), F.max("median").alias("median"))
    fit = sr.agg(F.regr_slope(F.ln("median"), F.col("wealth_mean")).alias("b"))
    return parishes.drop("median").join(sr, "region").join(F.broadcast(fit)).withColumn("modelled", F.col("median") * F.exp(F.col("b") * (F.col("wealth") - F.col("wealth_mean"))))  # one row


def shap_importance(shap: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, importance): mean absolute values, one-hot levels (name__level) added to their parent."""
    long = shap.select(*[F.abs(c).alias(c) for c in columns]).unpivot([], columns, "column", "v")
    per = long.groupBy("column").agg(F.avg("v").alias("v"))
    return per.groupBy(F.regexp_replace("column", "__.*$", "").alias("feature")).agg(F.sum("v").alias("importance"))


def shap_by_unit(shap: DataFrame, unit: str, columns: list[str]) -> DataFrame:
    """(unit, dominant, share): feature of largest mean absolute value in each unit, and its share of all."""
    long = shap.select(unit, *[F.abs(c).alias(c) for c in columns]).unpivot([unit], columns, "column", "v")
    per = long.groupBy(unit, "column").agg(F.avg("v").alias("v"))
    return per.groupBy(unit).agg(F.max_by("column", F.struct("v", "column")).alias("dominant"), (F.max("v") / F.sum("v")).alias("share"))


def dummies(df: DataFrame, column: str, levels: list, prefix: str) -> tuple[DataFrame, list[str]]:
    """0/1 columns for every level but the first, which is the reference."""
    names = {f"{prefix}{i}": (F.col(column) == v).cast("double") for i, v in enumerate(levels) if i}
    return df.withColumns(names), list(names)


def levels_of(df: DataFrame, column: str, least: int = 1) -> list:
    """Sorted levels with enough rows; levels of a categorical term number dozens."""
    return [r[0] for r in df.filter(F.col(column).isNotNull()).groupBy(column).count().filter(F.col("count") >= least).orderBy(column).collect()]


def ols_hc1(df: DataFrame, y: str, xs: list[str]) -> list[dict]:
    """Coefficients with HC1 standard errors: a second pass sums squared residuals times cross products."""
    d = df.dropna(subset=[*xs, y])
    m, n = gram(d, y, xs)
    k = len(xs)
    inv = np.linalg.pinv(m[:k, :k])
    b = inv @ m[:k, k]
    u = F.col(y) - sum((F.col(x) * float(b[i]) for i, x in enumerate(xs)), F.lit(0.0))
    weighted = d.withColumns({f"__s{i}": F.col(x) * u for i, x in enumerate(xs)})
    meat, _ = gram(weighted.withColumn("__y", F.lit(0.0)), "__y", [f"__s{i}" for i in range(k)])
    v = inv @ meat[:k, :k] @ inv * n / (n - k)
    se = np.sqrt(np.diag(v))
    return [{"term": x, "coef": float(b[i]), "se": float(se[i]), "n": int(n)} for i, x in enumerate(xs)]


def variants(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Each row once for every variant of the sample whose rule it meets (a null rule is not met), with its name in ``variant``; one scan for all."""
    named = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return df.withColumn("variant", F.explode(named))


def time_dummy_index(df: DataFrame, y: str, period: str, controls: list[str], least: int = 15) -> list[dict]:
    """Hedonic index by period (first = 100) from period dummies, HC1; periods with too few rows after all filters are left out."""
    d = df.dropna(subset=[y, period, *controls])
    periods = levels_of(d, period, least)
    d = d.filter(F.col(period).isin(periods)).withColumn("__one", F.lit(1.0))
    d, names = dummies(d, period, periods, "__p")
    fit = {r["term"]: r for r in ols_hc1(d, y, ["__one", *names, *controls])}
    return [{"period": str(p), "index": 100.0 * float(np.exp(fit[f"__p{i}"]["coef"])) if i else 100.0, "se": fit[f"__p{i}"]["se"] if i else 0.0} for i, p in enumerate(periods)]


def premium_table(df: DataFrame, y: str, category: str, controls: list[str], cluster: str, least: int = 15) -> list[dict]:
    """Percent premium of each category over the first, with its interval, from one clustered regression."""
    levels = levels_of(df.dropna(subset=[y, *controls]), category, least)
    d, names = dummies(df.filter(F.col(category).isin(levels)).withColumn("__one", F.lit(1.0)), category, levels, "__c")
    fit = ols_cluster(d, y, ["__one", *names, *controls], cluster)
    return [premium(fit, n) | {"term": str(levels[int(n[3:])])} for n in names]


def matched_yield(df: DataFrame, y: str, is_rent: str, area: str, controls: list[str], standard: dict[str, float]) -> list[dict]:
    """Gross yield of a standard dwelling by area: a log-value model of rents and prices with area effects in each market."""
    areas = levels_of(df.dropna(subset=[y, *controls]), area)
    d, names = dummies(df.withColumn("__one", F.lit(1.0)), area, areas, "__a")
    xs = ["__one", *names, *controls]
    fits = []
    for market in (1, 0):
        m, _ = gram(d.filter(F.col(is_rent) == market).dropna(subset=[y, *controls]), y, xs)
        fits.append(np.linalg.pinv(m[:-1, :-1]) @ m[:-1, -1])
    gap = fits[0] - fits[1]
    base = gap[0] + sum(gap[xs.index(c)] * v for c, v in standard.items())
    return [{"area": str(a), "gross_yield": float(12 * np.exp(base + (gap[i] if i else 0.0)))} for i, a in enumerate(areas)]


def linear_baseline(train: DataFrame, test: DataFrame, features: list[str], y: str) -> DataFrame:
    """test with prediction: medians for missing values, features clipped to the 1st and 99th percentile of train, least squares."""
    q = F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99))
    cut = train.agg(*[F.percentile(f, q).alias(f) for f in features]).collect()[0]
    ready = lambda df: df.withColumns({f"__{f}": F.least(F.greatest(F.coalesce(F.col(f), F.lit(cut[f][1])), F.lit(cut[f][0])), F.lit(cut[f][2])) for f in features}).withColumn("__one", F.lit(1.0))
    xs = ["__one", *[f"__{f}" for f in features]]
    m, _ = gram(ready(train).dropna(subset=[y]), y, xs)
    b = np.linalg.pinv(m[:-1, :-1]) @ m[:-1, -1]
    return ready(test).withColumn("prediction", sum((F.col(x) * float(b[i]) for i, x in enumerate(xs)), F.lit(0.0))).drop(*xs)
