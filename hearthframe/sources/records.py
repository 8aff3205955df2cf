"""Raw layer and parsers: JSON adverts, titles, page text, summary blocks, linked data, sitemaps, url paths, extracts, hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthframe.functions import text as X

RAW_COLUMNS = (
    "source", "source_id", "url", "scraped_at", "listing_date", "listing_date_source", "listing_type", "property_type", "title", "description", "price_raw", "currency_raw", "price_period",
    "location_raw", "district_raw", "region_raw", "bedrooms_raw", "bathrooms_raw", "size_raw", "size_unit_raw", "tenure_raw", "furnishing_raw", "listed_by", "agent_key", "lat", "lon",
)
RAW = T.StructType([T.StructField(c, T.DoubleType() if c in ("lat", "lon") else T.StringType()) for c in RAW_COLUMNS])
PERMISSIONS = ("terms_permit", "written_consent", "researcher_authorised")
#: Columns of a portal extract and the raw columns they fill.
EXTRACT_COLUMNS = {
    "HouseCode": "source_id", "Title": "title", "Description": "description", "Price": "price_raw", "Currency": "currency_raw", "Location": "location_raw", "District": "district_raw",
    "Category": "property_type", "Bedrooms": "bedrooms_raw", "Bathrooms": "bathrooms_raw", "Size": "size_raw", "Tenure": "tenure_raw", "Status": "listing_type", "DateUploaded": "listing_date",
    "Latitude": "lat", "Longitude": "lon",
}


# ---- Fixed values: the grammar of titles and summary blocks that results depend on. ----
TITLE = r"(?i)^(.*?)\s+in\s+(.+?)(?:,\s*([^,]+?))?\s+for\s+(rent|sale)\s*$"
SUBTYPE = r"(?i)^(?:standalone|stand alone|self[- ]contained|block of flats|estate|gated)\s+"
SUMMARY_KEYS = ("Code", "Location", "District", "Price", "Category", "BedRooms", "Bathrooms", "Size", "Tenure", "Status", "Agent")
SUMMARY_FIELDS = {
    "location": r"Location:\s*(.*?)\s+District:",
    "district": r"District:\s*(.*?)\s+Price:",
    "price": r"Price:\s*(.*?)\s+Category:",
    "bedrooms": r"BedRooms:\s*(\w+)",
    "size": r"Size\s+(.*?)\s+Tenure",
    "tenure": r"Tenure\s+(.*?)\s+Status",
    "status": r"Status\s+(For\s+\w+)",
}
ARCHIVED_FIELDS = {
    "category": r"Category:\s*(.*?)\s+(?:BedRooms:|Bathrooms:|Size\b|Tenure\b|Status\b)",
    "bathrooms": r"Bathrooms:\s*(\w+)",
}
SUMMARY_PAGE = r"QUICK SUMMARY(.*?)DESCRIPTION(.*?)(Send this property|Tell a friend|Email this|Related|$)"
SPECIFICATION_PAGE = r"PROPERTY SPECIFICATIONS(.*?)(PROPERTY DETAILS|$)"
DETAILS_PAGE = r"PROPERTY DETAILS(.*?)(Send this property|Tell a friend|Email this|Related Properties|$)"
TITLE_WORDS, TITLE_BEDROOMS = r"(?i)^(furnished|unfurnished|\d+\s*bdrm)\s*", r"(?i)\d+\s*bdrm\s*"
SUMMARY_BLOCK = r"(?i)QUICK SUMMARY(.*?)DESCRIPTION"
CODE_LINE, CODE_MARK, LEADING_MARKS = r"code:\s*\d+", ", code:", r"^[^\p{L}\p{N}]+"
MONTHLY, IN_DOLLARS = r"(?i)month|/m\b|pm\b", r"(?i)\$|usd"
HEADLINE = r"(\d+\s*bedroom[^.>]{0,80}?(?:for rent|for sale)[^,>]{0,60})"
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve".split()
DESCRIPTION_STOPS = ("●", "REVIEWS")
DESCRIPTION_LENGTH, DESCRIPTION_LINES, HEADING_LINES = 3000, 80, 400
# ---- End of fixed values. ----


class PermissionMissing(RuntimeError):
    """A source whose configuration records no basis for reading it."""


def check_permission(sources: dict, name: str) -> dict:
    """The source's configuration, if it names an allowed basis and, where one is due, its reference."""
    entry = sources.get(name, {})
    if entry.get("permission") not in PERMISSIONS:
        raise PermissionMissing(f"{name}: no permission recorded")
    if entry["permission"] != "terms_permit" and not entry.get("consent_reference"):
        raise PermissionMissing(f"{name}: {entry['permission']} needs a consent_reference")
    return entry


def to_raw(df: DataFrame) -> DataFrame:
    """Raw columns in order: missing ones null, all as strings but the coordinates, free text redacted."""
    have = {c.lower(): c for c in df.columns}
    cols = []
    for f in RAW.fields:
        c = F.col(f"`{have[f.name]}`") if f.name in have else F.lit(None)
        c = c.try_cast(f.dataType)
        cols.append((X.redact(c) if f.name in ("title", "description") else c).alias(f.name))
    return df.select(*cols)


BAD = "_bad"


def _headers(spark: SparkSession, paths: tuple[str, ...]) -> dict[tuple[str, ...], list[str]]:
    """The CSV files below the paths by their columns; of each file its first line is read, and of folders the files in them."""
    import csv

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        for status in fs.globStatus(at) or []:
            files = [status] if status.isFile() else [f for f in fs.listStatus(status.getPath()) if f.isFile()]
            for f in files:
                name = f.getPath().getName()
                if name.startswith(("_", ".")) or not f.getLen():
                    continue
                reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(f.getPath()), "UTF-8"))
                line = (reader.readLine() or "").removeprefix(chr(0xFEFF))
                reader.close()
                found.setdefault(tuple(next(csv.reader([line]), [])), []).append(f.getPath().toString())
    return found


def scan_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of CSV files as text, columns by name whatever their order in a file, missing ones null; ``_file``, ``_at`` (the order of
    the rows of a file: rising, with gaps) and ``_bad``, the whole line of a row with too few or too many fields, else null.

    Quoted newlines and doubled quotes belong to their field. Files of one header are one scan; files with only a header, or
    nothing, give no rows. A column that comes twice in a header counts the first time.
    """
    out = None
    for header, files in sorted(_headers(spark, paths).items()):
        names = [f"c{i}" for i in range(len(header))]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, BAD]])
        rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("columnPruning", False).csv(files)
        first = {h.strip().lower(): n for n, h in reversed(list(zip(names, header))) if h.strip()}
        # Spark reads no bad row by itself: the first column is asked for with it, all columns are parsed to tell bad rows.
        whole = F.concat(F.col(BAD), F.substring(F.coalesce(names[0], F.lit("")), 1, 0))
        part = rows.select(*[F.col(n).alias(h) for h, n in first.items()], F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"), whole.alias(BAD))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return spark.createDataFrame([], f"_file string, _at bigint, {BAD} string") if out is None else out


def read_raw(spark: SparkSession, *paths: str) -> DataFrame:
    """Raw CSV snapshots of any portals, every column as text; rows that are no whole rows are left out (``bad_rows`` has them)."""
    return to_raw(scan_csv(spark, *paths).filter(f"{BAD} IS NULL"))


def bad_rows(spark: SparkSession, *paths: str) -> DataFrame:
    """(_file, _at, _bad) of the rows that read_raw leaves out."""
    return scan_csv(spark, *paths).filter(f"{BAD} IS NOT NULL").select("_file", "_at", BAD)


def read_extract_files(spark: SparkSession, source: str, *paths: str, row_tag: str = "row") -> DataFrame:
    """A portal's extract from XML files (a ``row_tag`` a listing) or CSV files, as read_extract; other columns of the files are dropped."""
    if all(p.lower().endswith(".xml") for p in paths):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in EXTRACT_COLUMNS])
        return read_extract(spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(list(paths)), source)
    rows = scan_csv(spark, *paths).filter(f"{BAD} IS NULL")
    return read_extract(rows.select(*[F.col(k.lower()).alias(k) for k in EXTRACT_COLUMNS if k.lower() in rows.columns]), source)


def read_extract(df: DataFrame, source: str) -> DataFrame:
    """A portal's extract with its columns renamed and its deal type found."""
    names = {k: v for k, v in EXTRACT_COLUMNS.items() if k in df.columns}
    out = df.withColumnsRenamed(names).withColumn("source", F.lit(source))
    if "listing_type" in out.columns:
        out = out.withColumn("listing_type", X.empty_as_null(F.regexp_extract(F.lower("listing_type"), "(rent|sale)", 1)))
    return to_raw(out)


def title_parts(title: Column) -> Column:
    """struct(ptype, place, admin, deal) of a title of the form '... in place, area for rent'; fields null if it isn't."""
    part = lambda n: X.empty_as_null(F.regexp_extract(title, TITLE, n))
    kind = F.regexp_replace(F.regexp_replace(part(1), TITLE_WORDS, ""), TITLE_BEDROOMS, "")
    return F.struct(X.empty_as_null(F.trim(kind)).alias("ptype"), F.regexp_replace(F.trim(part(2)), SUBTYPE, "").alias("place"), part(3).alias("admin"), F.lower(part(4)).alias("deal"))


ADVERT = "id bigint, title string, details string, url string, price_obj struct<value:double,view:string,period:string>, attrs array<struct<name:string,value:string,unit:string>>, region_name string, region_parent_name string, user_id bigint"


def plain_number(value: Column) -> Column:
    """A number as text without an exponent, to six decimals where it is large: 9.5, 10000000.0."""
    digits = F.regexp_replace(value.cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when((F.abs(value) >= 1e7) & (F.abs(value) < 1e30), digits).otherwise(value.cast("string"))


def adverts(records: DataFrame, source: str, category: str, column: str = "json") -> DataFrame:
    """JSON adverts as raw rows; a record that can't be read gives nulls."""
    ad = F.from_json(column, ADVERT)
    df = records.withColumn("ad", ad).withColumn("t", title_parts(F.col("ad.title")))
    attr = lambda name, field="value": F.get(F.filter("ad.attrs", lambda a: F.lower(a["name"]) == name.lower()), F.lit(0))[field]
    deal = F.coalesce("t.deal", F.lit("rent" if "rent" in category else "sale"))
    view = F.coalesce("ad.price_obj.view", F.lit("USh"))
    return df.select(
        F.lit(source).alias("source"), F.col("ad.id").cast("string").alias("source_id"), F.get(F.split("ad.url", r"\?"), F.lit(0)).alias("url"), deal.alias("listing_type"), F.coalesce("t.ptype", F.lit(category)).alias("property_type"),
        F.col("ad.title").alias("title"), F.col("ad.details").alias("description"), plain_number(F.col("ad.price_obj.value")).alias("price_raw"), F.when(view.contains("USh"), "UGX").otherwise(view).alias("currency_raw"), F.col("ad.price_obj.period").alias("price_period"),
        F.col("t.place").alias("location_raw"), F.col("ad.region_parent_name").alias("district_raw"), F.col("ad.region_name").alias("region_raw"), attr("Bedrooms").alias("bedrooms_raw"), attr("Bathrooms").alias("bathrooms_raw"),
        attr("Property size").alias("size_raw"), attr("Property size", "unit").alias("size_unit_raw"), attr("Furnishing").alias("furnishing_raw"), X.agent_key(F.lit(source), F.col("ad.user_id").cast("string")).alias("agent_key"),
    )


ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def unescape(text: Column) -> Column:
    for entity, ch in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(ch))
    return text


def page_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles and tags out, entities read, white space single."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " "), r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(unescape(bare), r"\s+", " "))


def page_title(html: Column) -> Column:
    return X.empty_as_null(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def url_parts(url: Column) -> Column:
    """struct(deal, ptype, region, district, area, id) of a listing url's path."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size(parts)
    geo = F.filter(F.slice(parts, 2, F.greatest(n - 2, F.lit(0))), lambda x: x != "showtype")
    r = F.array_position(F.transform(geo, lambda x: x.endswith("-region")), True).cast("int")
    at = lambda k: F.when(r > 0, F.get(geo, r - 1 + k))
    head = F.get(parts, F.lit(0))
    return F.struct(
        F.when(head == "for-rent", "rent").when(head == "for-sale", "sale").alias("deal"), F.when(r > 0, F.array_join(F.slice(geo, 1, F.greatest(r - 1, F.lit(0))), "/")).alias("ptype"), at(0).alias("region"), at(1).alias("district"), at(2).alias("area"),
        X.empty_as_null(F.regexp_extract(F.get(parts, F.greatest(n - 1, F.lit(0))), r"^(\d+)-", 1)).alias("id"),
    )


def _once(value: Column, used) -> Column:
    """used(value), where the value is worked out once a row and not in each place that names it."""
    return F.get(F.transform(F.array(value), used), F.lit(0))


def summary_fields(lines: Column, keys: tuple[str, ...] = SUMMARY_KEYS, start: str = "QUICK SUMMARY", span: int = 60) -> Column:
    """map of key to the line after it, within a page's summary block; null without one."""
    at = F.array_position(lines, start).cast("int")
    found = lambda b: F.struct(b.alias("block"), F.transform(b, lambda x: F.trim(F.rtrim(x, F.lit(":")))).alias("bare"))
    value = lambda f, k: F.get(f["block"], F.nullif(F.array_position(f["bare"], k).cast("int"), F.lit(0)))
    listed = lambda f: F.create_map(*[x for k in keys for x in (F.lit(k), value(f, k))])
    return F.when(at > 0, _once(_once(F.slice(lines, at, span), found), listed))


def summary_grammar(text: Column) -> Column:
    """struct of the fields of a one-line summary: 'Location: .. District: .. Price: .. Category: ..'."""
    block = F.regexp_extract(text, SUMMARY_BLOCK, 1)
    found = {k: X.empty_as_null(F.regexp_extract(block, "(?i)" + p, 1)) for k, p in SUMMARY_FIELDS.items()}
    is_sale = F.coalesce(F.lower(found["status"]).contains("sale"), F.lit(False))
    return F.struct(*[v.alias(k) for k, v in found.items()], is_sale.alias("is_sale"))


def specification_fields(text: Column, keys: tuple[str, ...]) -> Column:
    """map of 'Key: value' runs where a value ends at the next key."""
    alternation = "|".join(keys)
    found = lambda g: F.regexp_extract_all(text, F.lit(rf"({alternation})\s*:\s*(.*?)(?=\s(?:{alternation})\s*:|$)"), F.lit(g))
    return F.map_from_entries(F.arrays_zip(found(1), F.transform(found(2), lambda v: F.trim(v))))


def number_word(text: Column) -> Column:
    """Digits of a number word up to twelve; other text as it is, in lower case; null for none."""
    t = X.empty_as_null(F.lower(F.trim(text)))
    words = F.create_map(*[x for i, w in enumerate(NUMBER_WORDS) for x in (F.lit(w), F.lit(str(i)))])
    return F.coalesce(F.try_element_at(words, t), t)


def archived_page(text: Column, keys: tuple[str, ...]) -> Column:
    """struct of an archived page's plain text in either layout: the summary's fields, or the specification list as a map.

    The description ends at the first stop phrase and holds no contact data; price and rent follow the status. Text in
    neither layout gives a struct of nulls but for what its headline tells; null text gives null.
    """
    none = lambda c: X.empty_as_null(F.trim(c))
    parts = F.struct(text.rlike("(?i)" + SUMMARY_PAGE).alias("summary"), *[F.regexp_extract(text, "(?i)" + SUMMARY_PAGE, i).alias(n) for i, n in ((1, "block"), (2, "told"))], none(F.regexp_extract(text, "(?i)" + SPECIFICATION_PAGE, 1)).alias("spec"))
    taken = lambda p: F.struct(p.alias("parts"), *[F.when(p["summary"], none(F.regexp_extract(p["block"], "(?i)" + e, 1))).alias(k) for k, e in (SUMMARY_FIELDS | ARCHIVED_FIELDS).items()])
    return _once(_once(parts, taken), lambda found: _archived(text, found, keys))


def _archived(text: Column, found: Column, keys: tuple[str, ...]) -> Column:
    none = lambda c: X.empty_as_null(F.trim(c))
    summary, told, spec = (found["parts"][c] for c in ("summary", "told", "spec"))
    sale = F.coalesce(F.lower(found["status"]).contains("sale"), F.lit(False))
    listed = F.when(~summary & spec.isNotNull(), specification_fields(spec, keys))
    details = F.when(summary, told).otherwise(F.regexp_extract(text, "(?i)" + DETAILS_PAGE, 1))
    return F.when(
        text.isNotNull(),
        F.struct(
            F.when(summary, "summary").when(spec.isNotNull(), "specifications").alias("layout"), found["location"].alias("location"), found["district"].alias("district"),
            F.when(summary, F.concat(F.coalesce(found["category"], F.lit("")), F.when(sale, " Sale").otherwise(""))).alias("type"), number_word(found["bedrooms"]).alias("bedrooms"), number_word(found["bathrooms"]).alias("bathrooms"),
            found["size"].alias("size"), found["tenure"].alias("tenure"), found["status"].alias("status"), F.when(sale, found["price"]).alias("price"), F.when(~sale, found["price"]).alias("rent"),
            none(X.redact(F.substring(F.trim(details), 1, DESCRIPTION_LENGTH))).alias("description"), none(F.regexp_extract(text, "(?i)" + HEADLINE, 1)).alias("headline"), listed.alias("fields"),
        ),
    )


def detail_page(lines: Column) -> Column:
    """struct of a live page's lines: the summary block's fields, the description up to a stop mark, the heading before its
    code, the deal and number words; null without a summary block."""
    return _once(summary_fields(lines), lambda fields: _detail(lines, fields))


def _detail(lines: Column, fields: Column) -> Column:
    at = F.array_position(lines, "DESCRIPTION").cast("int")
    after = F.slice(lines, at + 1, DESCRIPTION_LINES - 1)
    stops = F.transform(after, lambda x: x.startswith(DESCRIPTION_STOPS[0]) | F.upper(x).startswith(DESCRIPTION_STOPS[1]))
    end = F.array_position(stops, True).cast("int")
    told = F.when(at > 0, F.array_join(F.when(end > 0, F.slice(after, 1, F.greatest(end - 1, F.lit(0)))).otherwise(after), " "))
    head = F.get(F.filter(F.slice(lines, 1, HEADING_LINES), lambda x: x.rlike(CODE_LINE)), F.lit(0))
    title = F.trim(F.regexp_replace(F.get(F.split(head, CODE_MARK), F.lit(0)), LEADING_MARKS, ""))
    status, price = F.lower(F.coalesce(fields["Status"], F.lit(""))), F.coalesce(fields["Price"], F.lit(""))
    deal = F.when(status.contains("rent"), "rent").when(status.contains("sale"), "sale")
    monthly = price.rlike(MONTHLY) | status.contains("rent")
    return F.when(
        fields.isNotNull(),
        F.struct(
            fields["Code"].alias("source_id"), deal.alias("listing_type"), fields["Category"].alias("property_type"), title.alias("title"), F.coalesce(told, F.lit("")).alias("description"), fields["Price"].alias("price_raw"),
            F.when(price.rlike(IN_DOLLARS), "USD").otherwise("UGX").alias("currency_raw"), F.when(monthly, "per month").alias("price_period"), fields["Location"].alias("location_raw"), fields["District"].alias("district_raw"),
            number_word(fields["BedRooms"]).alias("bedrooms_raw"), number_word(fields["Bathrooms"]).alias("bathrooms_raw"), fields["Size"].alias("size_raw"), fields["Tenure"].alias("tenure_raw"),
        ),
    )


def wide_quarters(sheet: DataFrame, order: str, fy: str, quarter: str, areas: list[str]) -> DataFrame:
    """(fy, quarter, period_start, area, value) of a sheet with one column an area, its fiscal year named on the first row
    of each year ('2015/16') and quarters 'Q1' (July) to 'Q4'. Rows without a quarter are left out; values that are no
    numbers are null. The window runs over one sheet, which holds four rows a year."""
    d = sheet.withColumn("__fy", F.last(fy, True).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).filter(F.col(quarter).isNotNull())
    q, year = F.substring(F.trim(quarter), 2, 1).try_cast("int"), F.substring("__fy", 1, 4).try_cast("int")
    start = F.make_date(year + (q >= 3).cast("int"), F.pmod((q - 1) * 3 + 6, F.lit(12)) + 1, F.lit(1))
    long = d.select(F.col("__fy").alias("fy"), F.col(quarter).alias("quarter"), start.alias("period_start"), *[F.col(a).cast("string").alias(a) for a in areas]).unpivot(["fy", "quarter", "period_start"], areas, "area", "value")
    return long.withColumn("value", F.round(F.col("value").try_cast("double"), 3))


LINKED = "`@type` string, name string, description string, datePosted string, offers struct<price:string,priceCurrency:string>"


def linked_listing(html: Column) -> Column:
    """The page's last linked-data block of type RealEstateListing, as a struct; null without one."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    found = F.filter(F.transform(blocks, lambda b: F.from_json(b, LINKED)), lambda x: x["@type"] == "RealEstateListing")
    return F.get(found, F.size(found) - 1)


def sitemap_frame(xml: DataFrame, column: str = "xml") -> DataFrame:
    """(code, url, title, place) of a sitemap's listing urls, one row a code, the highest first."""
    urls = xml.select(F.explode(F.regexp_extract_all(column, F.lit(r"<loc>(.*?)</loc>"), F.lit(1))).alias("u")).select(F.get(F.split(F.replace("u", F.lit("&amp;"), F.lit("&")), "#"), F.lit(0)).alias("url")).filter(F.col("url").contains("HouseCode="))
    rows = urls.select(F.regexp_extract("url", r"HouseCode=(\d+)", 1).try_cast("bigint").alias("code"), "url", F.url_decode(F.regexp_extract("url", r"Title=([^&#]*)", 1)).alias("title")).filter("code IS NOT NULL")
    rows = rows.withColumn("place", X.empty_as_null(F.trim(F.regexp_extract("title", r"(?i)\b(?:sale|rent)\s+in\s+(.+)$", 1))))
    return rows.groupBy("code").agg(F.min_by(F.struct("url", "title", "place"), "url").alias("r")).select("code", "r.*")


def hierarchy_paths(rows: DataFrame, levels: int = 3, parts: int = 64) -> DataFrame:
    """Indented rows (ordinal, indent, text) as paths (l1 .. ln) for rows of the deepest level.

    The ordinals are cut into ranges; the last row of each level in the ranges before is carried into a range, so no
    task reads the whole report.
    """
    cuts = rows.agg(F.percentile_approx("ordinal", [i / parts for i in range(1, parts)]).alias("q")).collect()[0]["q"] or []
    edges = F.array(*[F.lit(v) for v in sorted(set(cuts))]).cast(f"array<{dict(rows.dtypes)['ordinal']}>")
    df = rows.withColumn("__r", F.size(F.filter(edges, lambda e: e < F.col("ordinal"))))
    at = {f"o{k}": F.when(F.col("indent") == k - 1, F.col("ordinal")) for k in range(1, levels + 1)}
    said = {f"t{k}": F.when((F.col("indent") == k - 1) & F.col("text").isNotNull(), F.struct("ordinal", "text")) for k in range(1, levels + 1)}
    names = [*at, *said]
    ends = df.groupBy("__r").agg(*[F.max(v).alias(n) for n, v in (at | said).items()])
    before = ends.select("__r", *[F.max(n).over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)).alias(f"b_{n}") for n in names])  # a row for each range
    w = Window.partitionBy("__r").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    df = df.select("*", *[F.max(v).over(w).alias(n) for n, v in (at | said).items()]).join(before, "__r")
    df = df.withColumns({n: F.coalesce(n, f"b_{n}") for n in names})
    valid = lambda k: F.when((F.lit(k == 1)) | (F.col(f"o{k}") > F.col(f"o{max(1, k - 1)}")), F.col(f"t{k}.text"))
    return df.filter(F.col("indent") == levels - 1).select("ordinal", *[valid(k).alias(f"l{k}") for k in range(1, levels + 1)])


def footprint_cells(rows: DataFrame, ring: str, cell: float) -> DataFrame:
    """Building rings (array of (x, y)) as (row, col, area, n): shoelace area and vertex mean, binned to a grid."""
    r = F.col(ring)
    ahead = F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    area = F.abs(F.aggregate(F.zip_with(r, ahead, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)) / 2
    mean = lambda c: F.aggregate(r, F.lit(0.0), lambda s, p: s + p[c]) / F.size(r)
    binned = rows.select(F.floor(mean("y") / cell).alias("row"), F.floor(mean("x") / cell).alias("col"), area.alias("a"))
    return binned.groupBy("row", "col").agg(F.sum("a").alias("area"), F.count(F.lit(1)).alias("n"))


def macro_rates(monthly: DataFrame, first: str, second: str) -> DataFrame:
    """(month, rate): the first published rate, else the second."""
    return monthly.select("month", F.coalesce(first, second).alias("rate")).filter("rate IS NOT NULL")


def split_total(parts: DataFrame, totals: DataFrame, key: str, weight: str, total: str) -> DataFrame:
    """Totals by key dealt to parts in proportion to a weight; a key of no weight deals nothing."""
    w = parts.groupBy(key).agg(F.sum(weight).alias("__w"))
    return parts.join(w, key).join(totals.select(key, F.col(total).alias("__t")), key).withColumn("allotted", F.when(F.col("__w") > 0, F.col("__t") * F.col(weight) / F.col("__w"))).drop("__w", "__t")
