"""The cleaning layer: raw listings to priced, measured, classified records. Projections only, but for the FX lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthframe.functions import text as T


def blob(*columns: str, sep: str = " ") -> Column:
    out = F.coalesce(F.col(columns[0]), F.lit(""))
    for c in columns[1:]:
        out = F.concat(out, F.lit(sep), F.coalesce(F.col(c), F.lit("")))
    return out


def normalise_prices(listings: DataFrame, fx: DataFrame, fallback: float = T.FX_FALLBACK) -> DataFrame:
    """Adds amount, currency, amounts in local money, monthly rent, sale price and the price flags.

    fx: (month, rate), one row a month; the months number a few hundred, so the lookup side stays small and Spark
    broadcasts it by its own size check.
    """
    is_rent, is_sale = F.coalesce(F.col("listing_type") == "rent", F.lit(False)), F.coalesce(F.col("listing_type") == "sale", F.lit(False))
    field = T.empty_as_null(F.regexp_extract(F.upper(F.col("currency_raw")), "(USD|UGX)", 1))
    stated = T.stated_currency(F.col("price_raw"))
    df = listings.withColumn("amount", T.amount(F.col("price_raw"))).withColumn("currency", F.when(stated == "USD", "USD").otherwise(F.coalesce(field, stated, F.lit("UGX"))))
    tiny = F.coalesce((F.col("currency") == "UGX") & (F.col("amount") < T.TINY_RENT) & is_rent, F.lit(False))
    df = df.withColumn("flag_currency_inferred", tiny).withColumn("currency", F.when(F.col("flag_currency_inferred"), "USD").otherwise(F.col("currency")))
    df = df.withColumn("fx_month", F.date_format(F.coalesce("listing_date", "scraped_at"), "yyyy-MM")).join(fx.select(F.col("month").alias("fx_month"), "rate"), "fx_month", "left")
    local = F.when(F.col("currency") == "USD", F.col("amount") * F.coalesce("rate", F.lit(fallback))).otherwise(F.col("amount"))
    factor = F.when(is_rent, T.rent_factor(F.col("price_period"), F.col("price_raw"), F.col("title"), F.col("description")))
    df = df.withColumns({"amount_ugx": local, "rent_period_factor": factor})
    text = F.lower(blob("title", "description"))
    df = df.withColumns(
        {
            "flag_short_stay": is_rent & F.col("rent_period_factor").isNull(),
            "rent_month_ugx": F.when(is_rent, F.col("amount_ugx") * F.col("rent_period_factor")),
            "price_ugx": F.when(is_sale, F.col("amount_ugx")),
            "flag_negotiable": T.says(text, T.NEGOTIABLE),
            "flag_price_missing": F.col("amount").isNull() | text.rlike("price on request|call for price"),
        }
    )
    outside = lambda c, b: ~F.coalesce(F.col(c).between(*b), F.lit(False))
    outlier = ((is_rent & outside("rent_month_ugx", T.RENT_BOUNDS)) | (is_sale & outside("price_ugx", T.SALE_BOUNDS))) & ~F.col("flag_price_missing")
    return df.withColumn("flag_price_outlier", outlier).drop("fx_month", "rate")


def normalise_sizes(listings: DataFrame, square_metre_source: str = "alpha") -> DataFrame:
    """Adds plot_decimals, plot_method, floor_m2, portal_size_sqm and flag_plot_implausible; fields beat text."""
    field = F.concat(F.coalesce(F.col("size_raw"), F.lit("")), F.lit(" "), F.coalesce(F.col("size_unit_raw"), F.lit("")))
    text = blob("title", "description")
    size = F.get(F.filter(F.array(T.plot_decimals(field), T.plot_decimals(text)), lambda x: x["value"].isNotNull()), F.lit(0))
    df = listings.withColumn("__s", size)
    value = F.col("__s")["value"]
    low, high = 0.5, 5000.0
    kept = F.coalesce(value >= low, F.lit(False))
    portal = F.when((F.col("source") == square_metre_source) & (F.col("size_unit_raw") == "sqm"), F.col("size_raw").try_cast("double"))
    return df.withColumns(
        {
            "floor_m2": T.floor_m2(text),
            "portal_size_sqm": portal,
            "flag_plot_implausible": F.coalesce(~value.between(low, high), F.lit(False)),
            "plot_decimals": F.when(kept, value),
            "plot_method": F.when(kept, F.col("__s")["method"]),
        }
    ).drop("__s")


def apply_price_units(listings: DataFrame) -> DataFrame:
    """Adds price_unit; a price per plot, acre or decimal makes that one unit the priced area."""
    words = blob("price_period", "price_raw", "title")
    df = listings.withColumn("price_unit", T.price_unit(words, F.coalesce(F.col("listing_type") == "sale", F.lit(False))))
    text = blob("title", "description")
    plot = F.coalesce(F.when(T.says(text, T.DIMENSIONS), T.plot_decimals(text)["value"]), F.lit(T.PLOT_SQFT * T.SQFT_M2 / T.DECIMAL_M2))
    by_unit = lambda plot_v, acre_v, dec_v, other: F.when(F.col("price_unit") == "per_plot", plot_v).when(F.col("price_unit") == "per_acre", acre_v).when(F.col("price_unit") == "per_decimal", dec_v).otherwise(other)
    return df.withColumns(
        {
            "plot_decimals": by_unit(plot, F.lit(T.ACRE_DECIMALS), F.lit(1.0), F.col("plot_decimals")),
            "plot_method": by_unit(F.lit("per_plot_price"), F.lit("per_acre_price"), F.lit("per_decimal_price"), F.col("plot_method")),
        }
    )


def extract_features(listings: DataFrame) -> DataFrame:
    """Adds twenty f_ flags, tenure, title status, their lineage, bedrooms, bathrooms."""
    text = F.lower(blob("title", "description", sep=" . "))
    flags = {f"f_{name}": T.says(text, pattern).cast("int") for name, pattern in T.FEATURES.items()}
    fur = F.lower(F.coalesce("furnishing_raw", F.lit("")))
    flags["f_furnished"] = F.when(fur.startswith("unfurn"), 0).when(fur.startswith("furn"), 1).otherwise(flags["f_furnished"])
    df = listings.withColumns(flags)
    all_text = T.tenure(F.col("title"), F.col("description"), F.col("tenure_raw"))
    has_field = F.coalesce(F.trim("tenure_raw") != "", F.lit(False))
    by_field = F.when(has_field, T.tenure(F.col("tenure_raw"))["tenure"]).otherwise("unknown")
    df = df.withColumns({"__t": all_text, "__f": by_field})
    df = df.withColumns({"tenure_class": F.when(F.col("__f") != "unknown", F.col("__f")).otherwise(F.col("__t")["tenure"]), "title_status": F.col("__t")["status"]})
    df = df.withColumn("tenure_source", F.when(has_field, "portal_field").when(F.col("tenure_class") != "unknown", "text").otherwise("none"))
    field_beds, text_beds = T.word_number(F.col("bedrooms_raw")), T.word_number(T.group(text, T.BEDS))
    field_baths, text_baths = F.trim("bathrooms_raw").try_cast("double"), T.word_number(T.group(text, T.BATHS))
    df = df.withColumns({"__b": F.coalesce(field_beds, text_beds), "__h": F.coalesce(field_baths, text_baths), "bedrooms_source": F.when(field_beds.isNotNull(), "portal_field").when(text_beds.isNotNull(), "text").otherwise("none")})
    beds = F.coalesce(F.col("__b"), F.when(F.col("f_muzigo") == 1, F.lit(0.5)))
    return df.withColumns(
        {"flag_bedrooms_implausible": F.coalesce(beds > 15, F.lit(False)), "bedrooms": F.when(beds <= 15, beds), "bathrooms": F.when(F.col("__h") <= 15, F.col("__h"))}
    ).drop("__t", "__f", "__b", "__h")


def payment_terms(listings: DataFrame) -> DataFrame:
    """Adds advance_months, deposit_months, terms_stated and upfront_months of rentals."""
    text = blob("title", "description")
    df = listings.withColumns({"advance_months": T.advance_months(text), "deposit_months": T.deposit_months(text)})
    stated = F.col("advance_months").isNotNull() | F.col("deposit_months").isNotNull()
    total = F.coalesce("advance_months", F.lit(0)) + F.coalesce("deposit_months", F.lit(0))
    return df.withColumns({"terms_stated": stated.cast("int"), "upfront_months": F.when(stated, total)})


def derive_measures(listings: DataFrame) -> DataFrame:
    """Adds per-bedroom and per-decimal values, logs, month and quarter; what can't be divided is null."""
    day = F.coalesce("listing_date", "scraped_at")
    log = lambda c: F.when(F.col(c) > 0, F.ln(F.col(c)))
    return listings.withColumns(
        {
            "rent_per_bedroom": F.try_divide("rent_month_ugx", "bedrooms"),
            "price_per_bedroom": F.try_divide("price_ugx", "bedrooms"),
            "price_per_decimal": F.try_divide("price_ugx", "plot_decimals"),
            "log_rent": log("rent_month_ugx"),
            "log_price": log("price_ugx"),
            "month": F.date_format(day, "yyyy-MM"),
            "quarter": F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string")),
        }
    )


def full_clean(listings: DataFrame, fx: DataFrame) -> DataFrame:
    """Prices, sizes, price units, features, type, terms and measures, in that order; units overwrite sizes."""
    df = extract_features(apply_price_units(normalise_sizes(normalise_prices(listings, fx))))
    return derive_measures(payment_terms(df.withColumn("ptype", T.property_type(F.col("property_type"), F.col("title")))))


def cleaning_log(cleaned: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """(step, label, n): rows left after each filter of a chain, in one pass rather than a count for each."""
    keep = F.lit(True)
    counts = [F.count(F.lit(1)).alias("n0")]
    for i, (_, condition) in enumerate(steps, 1):
        keep = keep & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(keep).alias(f"n{i}"))
    rows = [F.struct(F.lit(i).alias("step"), F.lit(label).alias("label"), F.col(f"n{i}").alias("n")) for i, label in enumerate(["raw", *[s for s, _ in steps]])]
    return cleaned.agg(*counts).select(F.inline(F.array(*rows)))
