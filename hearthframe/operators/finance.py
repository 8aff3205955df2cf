"""Land values, yields, saving routes, transport burdens and value capture over tables of areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthframe.functions import finance as fin
from hearthframe.operators import index as X

COMMUTE = {"circuity": 1.3, "days": 22, "trips": 2, "hours": 176}
PLOTS = {"standard": 5000 / 435.6, "small": 2500 / 435.6}


def cost_class(shell: Column, kind: Column, storeyed: Column, high_spec: list[Column]) -> Column:
    return F.when(shell == 1, "shell").when(kind == "apartment", "apartment").when(storeyed == 1, "storeyed").when(sum(high_spec, F.lit(0)) >= 2, "bungalow_high").otherwise("bungalow_standard")


def implied_land_value(sales: DataFrame, rates: dict[str, float], metres_per_bedroom: tuple[float, ...] = (25.0, 32.0, 40.0), depreciation: float = 0.15) -> DataFrame:
    """Each sale once a floor-area scenario, with replacement cost, implied land value, its share and the negative flag."""
    rate = F.lit(None).cast("double")
    for k, v in rates.items():
        rate = F.when(F.col("cost_class") == k, F.lit(v)).otherwise(rate)
    d = sales.withColumn("metres", F.explode(F.array(*[F.lit(m) for m in metres_per_bedroom])))
    d = d.withColumn("floor_est", F.coalesce("floor_m2", F.greatest(F.col("bedrooms").cast("double"), F.lit(1.0)) * F.col("metres")))
    d = d.withColumn("replacement_cost", F.col("floor_est") * rate * (1 - depreciation)).withColumn("land_value", F.col("price") - F.col("replacement_cost"))
    return d.withColumns({"land_share": F.col("land_value") / F.col("price"), "land_per_decimal": F.try_divide("land_value", "plot"), "negative": F.col("land_value") <= 0})


def land_value_by_unit(implied: DataFrame, unit: str, min_n: int = 5) -> DataFrame:
    ok = lambda c: F.percentile(F.when(~F.col("negative"), F.col(c)), 0.5)
    g = implied.groupBy(unit).agg(ok("land_share").alias("s"), ok("land_per_decimal").alias("p"), F.count_if(~F.col("negative")).alias("n_houses"), F.avg(F.col("negative").cast("double")).alias("share_negative"))
    gate = lambda c: F.when(F.col("n_houses") >= min_n, F.col(c))
    return g.select(unit, gate("s").alias("median_land_share"), gate("p").alias("median_land_per_decimal"), "n_houses", "share_negative")


def yields(areas: DataFrame, min_n: int = 20) -> DataFrame:
    """Gross yield and price-to-annual-rent of areas (rent_per_bed, price_per_bed, n_rent, n_sale)."""
    y = 12 * F.col("rent_per_bed") / F.col("price_per_bed")
    return areas.filter((F.col("n_rent") >= min_n) & (F.col("n_sale") >= min_n)).withColumns({"gross_yield": y, "price_to_annual_rent": 1 / y})


def plot_and_build(areas: DataFrame, shell: float, finish: float, self_build: float, deposit: float = 0.30, saving: tuple[float, ...] = (0.10, 0.20, 0.30)) -> DataFrame:
    """Years of saving for a plot, a shell, its finish, a self-built home and a deposit; areas (area, income, land_per_decimal, price)."""
    d = areas.withColumn("saving_rate", F.explode(F.array(*[F.lit(s) for s in saving])))
    yearly = 12 * F.col("saving_rate") * F.col("income")
    cols = {"years_shell": shell / yearly, "years_finish": finish / yearly, "years_self_build": self_build / yearly, "years_deposit": deposit * F.col("price") / yearly}
    cols |= {f"years_plot_{k}": F.col("land_per_decimal") * dec / yearly for k, dec in PLOTS.items()}
    return d.withColumns(cols)


def fare_model(quotes: DataFrame) -> DataFrame:
    """One row (a, b) of fare = a * km ** b by least squares on logs."""
    y, x = F.ln("fare"), F.ln("km")
    return quotes.agg(F.exp(F.regr_intercept(y, x)).alias("a"), F.regr_slope(y, x).alias("b"))


def housing_transport(areas: DataFrame, model: DataFrame, income: float, commuters: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Housing, transport and joint burdens; areas (area, rent, km, minutes)."""
    d = areas.join(F.broadcast(model)).withColumn("commuters", F.explode(F.array(*[F.lit(c) for c in commuters])))  # one row
    trips = COMMUTE["trips"] * COMMUTE["days"] * F.col("commuters")
    fares = trips * F.col("a") * F.pow("km", F.col("b"))
    time = trips * F.col("minutes") / 60 * (0.5 * income / COMMUTE["hours"])
    return d.withColumns({"fares": fares, "h_burden": F.col("rent") / income, "t_burden": fares / income, "ht_burden": (F.col("rent") + fares) / income, "ht_generalised": (F.col("rent") + fares + time) / income})


def value_capture(values: DataFrame, households: float, betas: tuple[float, ...] = (0.19, 0.212, 0.259), shares: tuple[float, ...] = (0.10, 0.25, 0.50), toll_year: float = 48e9) -> DataFrame:
    """Uplift per home and in total, in years of toll revenue; values (basis, value)."""
    d = values.withColumn("beta", F.explode(F.array(*[F.lit(b) for b in betas]))).withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    d = d.withColumn("uplift", F.col("value") * (1 - F.exp(-F.col("beta")))).withColumn("total", F.lit(households) * F.col("share") * F.col("uplift"))
    return d.withColumn("toll_years", F.col("total") / toll_year)


def affordability_premium(values: DataFrame, betas: tuple[float, ...] = (0.19, 0.212, 0.259), terms: dict = fin.BASE_TERMS) -> DataFrame:
    """Premium of access and the incomes needed with and without it."""
    d = values.withColumn("beta", F.explode(F.array(*[F.lit(b) for b in betas]))).withColumn("premium", F.col("value") * (1 - F.exp(-F.col("beta"))))
    q = lambda p: fin.qualifying_income(p, terms["rate"], terms["deposit"], terms["term"], terms["cap"])
    return d.withColumns({"needed_with": q(F.col("value")), "needed_without": q(F.col("value") - F.col("premium"))})


def able_shares(premiums: DataFrame, parishes: DataFrame, keys: list[str]) -> DataFrame:
    """Adds to rows of ``affordability_premium`` the share of the catchment's households able to pay with and without the
    premium, and the premium in years of its median income. Premiums are a short table; each meets all parishes."""
    incomes = X.parish_incomes(parishes)
    d = premiums.withColumns({"level": F.lit("total"), "area": F.lit("TOTAL")})
    out = X.mixture_shares(d.select("level", "area", *keys, "needed_with", "needed_without"), incomes, keys, {"w": F.col("needed_with"), "o": F.col("needed_without")}, ("total",))
    typical = X.area_incomes(incomes, ("total",)).select("median_income")
    return premiums.join(out, keys).join(F.broadcast(typical)).withColumns({"able_with": 1 - F.col("w"), "able_without": 1 - F.col("o"), "premium_years": F.col("premium") / (12 * F.col("median_income"))}).drop("w", "o")  # one row


def yield_benchmarks(areas: DataFrame, growth: DataFrame, min_n: int = 20) -> DataFrame:
    """One row: growth's (cagr, last_change), the median yield of areas with enough listings, the yield of their pooled medians, and total return."""
    y = yields(areas, min_n).agg(F.percentile("gross_yield", 0.5).alias("median_yield"), (12 * F.percentile("rent_per_bed", 0.5) / F.percentile("price_per_bed", 0.5)).alias("pooled_yield"))
    return growth.join(F.broadcast(y)).withColumn("total_return", F.col("pooled_yield") + F.col("cagr"))  # one row


def visibility(listings: DataFrame, parishes: DataFrame, tenure: DataFrame, area: str) -> DataFrame:
    """Listings and rentals for each thousand households of an area, and its renting households: all, in one room, and for
    each rental on offer. tenure (area, share_rented, share_one_room); an area without listings has none."""
    n = listings.groupBy(area).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("listing_type") == "rent").alias("r"))
    d = parishes.groupBy(area).agg(F.sum("households").alias("households")).join(n, area, "left").join(tenure, area, "left").withColumns({"listings": F.coalesce("n", F.lit(0)), "rentals": F.coalesce("r", F.lit(0))}).drop("n", "r")
    d = d.withColumns({"per_1000_hh": F.try_divide(1000 * F.col("listings"), F.col("households")), "rent_per_1000_hh": F.try_divide(1000 * F.col("rentals"), F.col("households")), "renting_households": F.col("households") * F.col("share_rented")})
    return d.withColumns({"single_room_renters": F.col("renting_households") * F.col("share_one_room"), "renters_per_listing": F.try_divide("renting_households", "rentals")})


def supply_by_group(rentals: DataFrame, area: str, minutes: str, budget: float, local: DataFrame, limits: tuple[int, ...] = (20, 30, 45, 60), min_n: int = 20) -> DataFrame:
    """(kind, name, n, within_budget, within_local, single_rooms) by area, by band of travel time and over all, from min_n rentals on.

    local (area, local_budget) is the budget of an area's own households; where there is none, and in the other groups, the
    common one counts. Rows of no area or no time are in the groups they have. One aggregation over grouping sets.
    """
    m = F.col(minutes)
    band = F.lit(f"{limits[-1]}+")
    for lo, hi in reversed(list(zip((None, *limits), limits))):
        band = F.when(m <= hi, f"<{hi}" if lo is None else f"{lo}-{hi}").otherwise(band)
    d = rentals.join(local, area, "left").select(F.col(area).alias("area"), F.when(m > 0, band).alias("band"), F.col("rent_month").alias("rent"), "bedrooms", F.coalesce("local_budget", F.lit(float(budget))).alias("own"))
    share = lambda c: F.avg(c.cast("double"))
    g = d.groupingSets([[F.col("area")], [F.col("band")], []], F.col("area"), F.col("band")).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), share(F.col("rent") <= budget).alias("within_budget"), share(F.col("rent") <= F.col("own")).alias("l"), share(F.col("bedrooms") <= 1).alias("single_rooms"))
    kind = F.when(F.col("g") == 1, "area").when(F.col("g") == 2, "time").otherwise("all")
    named = g.select(kind.alias("kind"), F.coalesce("area", "band").alias("name"), "n", "within_budget", F.when(F.col("g") == 1, F.col("l")).otherwise(F.col("within_budget")).alias("within_local"), "single_rooms")
    return named.filter((F.col("n") >= min_n) & ((F.col("kind") == "all") | F.col("name").isNotNull()))


def worker_ratios(workers: DataFrame, bars: DataFrame) -> DataFrame:
    """Household income of one and two earners against each threshold; workers (occupation, earnings), bars (bar, needed): both short lists."""
    d = workers.withColumn("earners", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("__k", F.lit(1)).join(bars.withColumn("__k", F.lit(1)), "__k").drop("__k")
    return d.withColumn("ratio", F.col("earnings") * F.col("earners") / F.col("needed"))
