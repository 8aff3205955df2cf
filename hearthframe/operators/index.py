"""Affordability indices: medians by area, income mixtures, rental and ownership indices, gradients and scenarios.

Rows of listings and parishes are reduced to areas by one aggregation each; scenarios then multiply only the table of
areas, so no scenario reads the listings again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthframe.functions import finance as fin

LEVELS = ("total", "district", "subcounty")


def tagged(df: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Each row once a level, with (level, area); the level "parish" needs a column of that name."""
    area = {"total": F.lit("TOTAL"), "district": F.col("district"), "subcounty": F.concat_ws("/", "district", "subcounty"), "parish": F.concat_ws("/", F.col("district"), F.col("parish").cast("string")) if "parish" in levels else None}
    return df.withColumn("__l", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), area[k].alias("area")) for k in levels]))).select("*", "__l.level", "__l.area").drop("__l")


def parish_incomes(parishes: DataFrame, cpi: float = 1.0) -> DataFrame:
    """Adds sigma, uprated income and the non-housing minimum; rows without income or gini are left out."""
    kept = parishes.filter("income > 0 AND gini IS NOT NULL")
    typical = kept.agg(F.percentile("hh_size", 0.5).alias("__hh"))
    minimum = fin.POVERTY_LINE * cpi * fin.ADULTS_PER_PERSON * F.coalesce("hh_size", "__hh") * (1 - fin.HOUSING_SHARE)
    return kept.join(F.broadcast(typical)).withColumns({"sigma": fin.sigma_from_gini(F.col("gini")), "income": F.col("income") * cpi, "nonhousing_min": minimum}).drop("__hh")  # one row


def area_incomes(incomes: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(level, area, households, median_income): household-weighted geometric means."""
    h = F.col("households")
    return tagged(incomes, levels).groupBy("level", "area").agg(F.sum(h).alias("households"), F.exp(F.sum(h * F.ln("income")) / F.sum(h)).alias("median_income"), F.exp(F.sum(h * F.ln("nonhousing_min")) / F.sum(h)).alias("typical_min"))


def area_medians(listings: DataFrame, levels: tuple[str, ...] = LEVELS, bedrooms: tuple[float, float] = (0.5, 2.0), min_n: int = 20) -> DataFrame:
    """(level, area, n_rent, n_sale, median_rent, median_price), medians only from min_n listings on."""
    rent = F.when((F.col("listing_type") == "rent") & F.col("bedrooms").between(*bedrooms), F.col("rent_month"))
    price = F.when((F.col("listing_type") == "sale") & F.col("ptype").isin("house", "apartment"), F.col("price"))
    g = tagged(listings.select("district", "subcounty", *(["parish"] if "parish" in levels else []), rent.alias("r"), price.alias("p")), levels).groupBy("level", "area")
    m = g.agg(F.count("r").alias("n_rent"), F.count("p").alias("n_sale"), F.percentile("r", 0.5).alias("__r"), F.percentile("p", 0.5).alias("__p"))
    return m.withColumns({"median_rent": F.when(F.col("n_rent") >= min_n, F.col("__r")), "median_price": F.when(F.col("n_sale") >= min_n, F.col("__p"))}).drop("__r", "__p")


def below(q: Column) -> Column:
    """Household-weighted share of a mixture below q, as an aggregate over parish rows."""
    h = F.col("households")
    z = (F.ln(q) - F.ln("income")) / F.col("sigma")
    return F.sum(h * fin.phi(z)) / F.sum(F.when(q.isNotNull(), h))


def mixture_shares(thresholds: DataFrame, incomes: DataFrame, keys: list[str], shares: dict[str, Column], levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Shares of households below thresholds: joins the few area rows to their parishes, and aggregates by keys."""
    return thresholds.join(tagged(incomes, levels).select("level", "area", "households", "income", "sigma", "nonhousing_min"), ["level", "area"]).groupBy(*keys).agg(*[below(q).alias(name) for name, q in shares.items()])


def area_index(listings: DataFrame, parishes: DataFrame, levels: tuple[str, ...] = LEVELS, terms: dict = fin.BASE_TERMS, threshold: float = 0.30, min_n: int = 20) -> DataFrame:
    """Rental and ownership indices, priced-out shares and residual-income shares for each area."""
    incomes = parish_incomes(parishes)
    base = area_incomes(incomes, levels).join(area_medians(listings, levels, min_n=min_n), ["level", "area"], "left")
    pmt = fin.monthly_payment(F.col("median_price") * (1 - terms["deposit"]), terms["rate"], terms["term"])
    base = base.withColumns({"rent_income_needed": F.col("median_rent") / threshold, "monthly_payment": pmt}).withColumn("own_income_needed", F.col("monthly_payment") / terms["cap"])
    shares = mixture_shares(
        base.select("level", "area", "median_rent", "monthly_payment", "rent_income_needed", "own_income_needed"), incomes, ["level", "area"],
        {"agi_rent": F.col("rent_income_needed"), "agi_own": F.col("own_income_needed"), "ri_rent": F.col("median_rent") + F.col("nonhousing_min"), "ri_own": F.col("monthly_payment") + F.col("nonhousing_min"), "below_nonhousing_min": F.col("nonhousing_min")}, levels,
    )
    out = base.join(shares, ["level", "area"])
    return out.withColumns(
        {
            "rai": 100 * F.col("median_income") / F.col("rent_income_needed"),
            "oai": 100 * F.col("median_income") / F.col("own_income_needed"),
            "ri_rent_housing_induced": F.col("ri_rent") - F.col("below_nonhousing_min"),
            "ri_own_housing_induced": F.col("ri_own") - F.col("below_nonhousing_min"),
            "ri_rent_median_residual": F.col("median_income") - F.col("median_rent") - F.col("typical_min"),
        }
    )


def burden_gradient(listings: DataFrame, parishes: DataFrame, levels: tuple[str, ...] = ("total", "district"), terms: dict = fin.BASE_TERMS, min_n: int = 20) -> DataFrame:
    """Priced-out shares as the tolerable burden runs from 10 to 80 % in fifteen steps."""
    incomes = parish_incomes(parishes)
    base = area_incomes(incomes, levels).join(area_medians(listings, levels, min_n=min_n), ["level", "area"])
    pmt = fin.monthly_payment(F.col("median_price") * (1 - terms["deposit"]), terms["rate"], terms["term"])
    grid = base.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(14)))).withColumn("burden", (F.col("step") * 5 + 10) / 100).withColumn("monthly_payment", pmt)
    keys = ["level", "area", "burden"]
    shares = mixture_shares(grid.select(*keys, "median_rent", "monthly_payment"), incomes, keys, {"agi_rent": F.col("median_rent") / F.col("burden"), "agi_own": F.col("monthly_payment") / F.col("burden")}, levels)
    return grid.join(shares, keys).withColumns({"median_hh_rent_burden": F.col("median_rent") / F.col("median_income"), "median_hh_own_burden": F.col("monthly_payment") / F.col("median_income")})


def scenario_table(df: DataFrame, scenarios: list[dict]) -> DataFrame:
    """Each row once a scenario, with the scenario's values as columns."""
    rows = [F.struct(*[F.lit(float(v) if isinstance(v, (int, float)) else v).alias(k) for k, v in s.items()]) for s in scenarios]
    return df.withColumn("__s", F.explode(F.array(*rows))).select("*", "__s.*").drop("__s")


def mixture_quantile(incomes: DataFrame, share: float, levels: tuple[str, ...] = LEVELS, rounds: int = 8, cuts: int = 32) -> DataFrame:
    """(level, area, quantile): income below which a share of the area's mixture of parishes lies; null where nothing is known.

    All areas are narrowed down at once: each round cuts an area's interval into ``cuts`` parts and finds, by one aggregation
    combined before the shuffle, the part that holds the quantile. No area is gathered; eight rounds of 32 leave 1e-12 of the interval.
    """
    from .graph import _settled

    parts = _settled(tagged(incomes, levels).select("level", "area", F.col("households").alias("h"), F.ln("income").alias("l"), "sigma"))
    ends = parts.groupBy("level", "area").agg(F.sum("h").alias("hh"), (F.min("l") - 7.0).alias("a"), (F.max("l") + 7.0).alias("b"))
    for _ in range(rounds):
        met = parts.join(ends, ["level", "area"]).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(cuts - 1))))
        at = F.col("a") + (F.col("b") - F.col("a")) * F.col("k") / cuts
        below = met.groupBy("level", "area", "k").agg(F.sum(F.col("h") * fin.phi((at - F.col("l")) / F.col("sigma"))).alias("n"))
        low = below.join(ends, ["level", "area"]).filter(F.col("n") < share * F.col("hh")).groupBy("level", "area").agg(F.count(F.lit(1)).alias("low"))
        width = (F.col("b") - F.col("a")) / cuts
        left = F.col("a") + width * F.coalesce("low", F.lit(0))
        ends = _settled(ends.join(low, ["level", "area"], "left").select("level", "area", "hh", left.alias("a"), (left + width).alias("b")))
    return ends.select("level", "area", F.exp((F.col("a") + F.col("b")) / 2).alias("quantile"))


def z_distance(thresholds: DataFrame, incomes: DataFrame, q: str, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(level, area, z_distance): distance of q above the median household in standard deviations of log income."""
    h, l = F.col("households"), F.ln("income")  # noqa: E741
    m = tagged(incomes, levels).groupBy("level", "area").agg(F.sum(h).alias("w"), F.sum(h * l).alias("wl"), F.sum(h * (F.col("sigma") * F.col("sigma") + l * l)).alias("w2"))
    mu = F.col("wl") / F.col("w")
    return thresholds.join(m, ["level", "area"]).select("level", "area", ((F.ln(q) - mu) / F.sqrt(F.col("w2") / F.col("w") - mu * mu)).alias("z_distance"))


def affordability_by_unit(listings: DataFrame, parishes: DataFrame, unit: str = "subcounty", threshold: float = 0.30, min_n: int = 5) -> DataFrame:
    """Unit medians joined to income: ratios, shares able and not, income needed and gap, households priced out."""
    keyed = F.concat_ws("/", "district", "subcounty") if unit == "subcounty" else F.col(unit)
    is_rent, is_sale = F.col("listing_type") == "rent", (F.col("listing_type") == "sale") & (F.col("ptype") != "land")
    g = listings.withColumn("unit", keyed).groupBy("unit").agg(
        F.percentile(F.when(is_rent, F.col("rent_month")), 0.5).alias("median_rent"), F.count_if(is_rent).alias("n_rent"), F.percentile(F.when(is_sale, F.col("price")), 0.5).alias("median_price"), F.count_if(is_sale).alias("n_sale"), F.mode("district", True).alias("income_unit")
    )
    h = F.col("households")
    inc = parish_incomes(parishes).withColumn("unit", keyed).groupBy("unit").agg(F.exp(F.sum(h * F.ln("income")) / F.sum(h)).alias("median_income"), F.max("sigma").alias("sigma"), F.sum(h).alias("households"))
    out = inc.join(g, "unit", "left")
    gate = lambda n, v: F.when(F.coalesce(F.col(n), F.lit(0)) >= min_n, v)
    out = out.withColumns({"rent_to_income": gate("n_rent", F.col("median_rent") / F.col("median_income")), "price_to_income": gate("n_sale", F.col("median_price") / (12 * F.col("median_income"))), "share_can_afford": gate("n_rent", fin.share_affording(F.col("median_rent"), F.col("median_income"), F.col("sigma"), threshold))})
    out = out.withColumns({"share_cannot_afford": 1 - F.col("share_can_afford"), "income_needed": F.col("median_rent") / threshold})
    return out.withColumns({"affordability_gap": F.col("income_needed") - F.col("median_income"), "households_cannot_afford": F.col("households") * F.col("share_cannot_afford")})


def district_summary(by_unit: DataFrame) -> DataFrame:
    """Household-weighted shares and incomes by district over units with a share; listing counts weigh where households are null."""
    w = F.coalesce("households", F.col("n_rent").cast("double"))
    return by_unit.filter("share_cannot_afford IS NOT NULL").groupBy("income_unit").agg(
        F.count(F.lit(1)).alias("units"), F.sum("n_rent").alias("rent_listings"), (F.sum(F.col("share_cannot_afford") * w) / F.sum(w)).alias("share_cannot_afford"), F.exp(F.sum(F.ln("median_income") * w) / F.sum(w)).alias("median_income_units"), F.sum("households_cannot_afford").alias("households_cannot_afford")
    )


def what_if(listings: DataFrame, parishes: DataFrame, mode: str = "rent", test: str = "ratio", burden: float = 0.30, rate: float = 0.18293, deposit: float = 0.30, term: float = 20, price_percent: float = 100.0, levels: tuple[str, ...] = ("total", "district")) -> DataFrame:
    """Share of households that a rent or a mortgage prices out, under a ratio or a residual-income test, for changed terms."""
    incomes = parish_incomes(parishes)
    base = area_incomes(incomes, levels).join(area_medians(listings, levels), ["level", "area"])
    cost = F.col("median_rent") * (price_percent / 100) if mode == "rent" else fin.monthly_payment(F.col("median_price") * (price_percent / 100) * (1 - deposit), rate, term)
    base = base.withColumn("cost", cost)
    needed = F.col("cost") / burden if test == "ratio" else F.col("cost") + F.col("nonhousing_min")
    return mixture_shares(base.select("level", "area", "cost"), incomes, ["level", "area", "cost"], {"share_out": needed}, levels)
