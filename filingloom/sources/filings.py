"""Where filings come from and what names them.

A filing archive is a folder tree of documents, read by Spark's ``binaryFile`` source; listing it prunes the content
column. Everything else here (dates and forms from paths, choosing one filing, tokens, cache layout, archive URLs,
history files) is expressions, so it works on any DataFrame with the columns named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingloom.functions.text import has_any

#: Suffixes in order of preference.
SUFFIXES = ("html", "htm", "txt")
#: Filings before this date exist as one complete submission only.
SUBMISSIONS_UNTIL = "2000-05-01"
ARCHIVE = "https://www.sec.gov/Archives/edgar/data"
ACCESSION = r"(\d{10}-\d{2}-\d{6})"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Documents below <root>/<ticker>/<form>/<date>_<form>.<suffix>, with their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{html,htm,txt}").option("recursiveFileLookup", "true").load(root)
    return parse_paths(files.withColumnRenamed("length", "bytes"))


def parse_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds ticker, form, filing_date, suffix and locator from the path; files whose names hold no real date go."""
    p = F.col(path)
    parts = r"([^/]+)/([^/]+)/(\d{4}-\d{2}-\d{2})_[^/]*\.(html|htm|txt)$"
    out = files.withColumns(
        {
            "ticker": F.upper(F.regexp_extract(p, parts, 1)),
            "form": F.replace(F.regexp_extract(p, parts, 2), F.lit("_"), F.lit(" ")),
            "filing_date": F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(p, parts, 3), F.lit("")), F.lit("yyyy-MM-dd"))),
            "suffix": F.regexp_extract(p, parts, 4),
            "locator": p,
        }
    )
    return out.where(F.col("filing_date").isNotNull())


def encode_form(form: Column) -> Column:
    return F.replace(form, F.lit(" "), F.lit("_"))


def suffix_rank(suffix: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SUFFIXES)), suffix)


def pick_filing(filings: DataFrame, keys: list[str], prefer: str = "latest", suffix: str | None = "suffix") -> DataFrame:
    """One filing for each key: the latest or the earliest. On one date the last suffix wins for the latest, the first for the earliest.

    One partial maximum for each key; no sort.
    """
    order = F.struct("filing_date", *([suffix_rank(F.col(suffix)).alias("rank")] if suffix else []), "locator")
    best = {"latest": F.max_by, "earliest": F.min_by}[prefer]
    rest = [c for c in filings.columns if c not in keys]
    return filings.groupBy(*keys).agg(best(F.struct(*rest), order).alias("best")).select(*keys, "best.*")


def token(accession: Column, locator: Column) -> Column:
    """What tells two filings of one day apart: the accession number, else one in the locator, else the locator's digest."""
    found = F.coalesce(F.nullif(F.trim(accession), F.lit("")), F.nullif(F.regexp_extract(locator, ACCESSION, 1), F.lit("")), F.left(F.sha2(locator.cast("binary"), 256), F.lit(12)))
    return F.regexp_replace(found, r"[^A-Za-z0-9._-]", "-")


def filing_id(locator: Column) -> Column:
    return F.left(F.sha2(locator.cast("binary"), 256), F.lit(16))


def cache_path(ticker: Column, form: Column, filed: Column, tok: Column, suffix: Column) -> Column:
    """A path in the cache, itself a path that ``scan`` reads."""
    f = encode_form(form)
    return F.concat(F.upper(ticker), F.lit("/"), f, F.lit("/"), F.date_format(filed, "yyyy-MM-dd"), F.lit("_"), f, F.lit("_"), tok, F.lit("."), suffix)


def split_cached(wanted: DataFrame, cached: DataFrame, key: str = "token", size: str = "bytes") -> DataFrame:
    """``wanted`` with is_cached: whether a file of any size above 0 is there for its token."""
    there = cached.where(F.col(size) > 0).select(F.col(key).alias("_there")).distinct()
    return wanted.join(there, F.col(key) == F.col("_there"), "left").withColumn("is_cached", F.col("_there").isNotNull()).drop("_there")


def cache_stats(files: DataFrame) -> DataFrame:
    done = files.where(~F.col("path").endswith(".part"))
    return done.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_distinct("ticker").alias("tickers"))


def human_bytes(n: Column) -> Column:
    def unit(i: int, name: str) -> Column:
        return F.format_string(f"%.{0 if i == 0 else 1}f {name}", n / float(1024**i))

    return F.when(n < 1024, unit(0, "B")).when(n < 1024**2, unit(1, "KB")).when(n < 1024**3, unit(2, "MB")).otherwise(unit(3, "GB"))


def archive_url(cik: Column, accession: Column, document: Column, filed: Column) -> Column:
    """Where the archive keeps a filing's main document, or its whole submission where there is none."""
    base = F.concat(F.lit(f"{ARCHIVE}/"), cik.cast("bigint").cast("string"), F.lit("/"))
    whole = F.concat(base, accession, F.lit(".txt"))
    one = F.concat(base, F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), document)
    return F.when((filed < F.lit(SUBMISSIONS_UNTIL).cast("date")) | (F.coalesce(document, F.lit("")) == ""), whole).otherwise(one)


def records(columns: dict[str, Column]) -> Column:
    """Parallel arrays as an array of structs, cut to the shortest."""
    n = F.least(*(F.size(c) for c in columns.values())) if len(columns) > 1 else F.size(next(iter(columns.values())))
    return F.arrays_zip(*(F.slice(c, F.lit(1), n).alias(name) for name, c in columns.items()))


HISTORY = "struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>,primaryDocument:array<string>>"


def filing_history(pages: DataFrame, column: str = "json") -> DataFrame:
    """Filings of history pages (JSON of parallel arrays, bare or as filings.recent); a page that is no JSON gives none."""
    both = F.from_json(F.col(column), f"struct<filings:struct<recent:{HISTORY}>,{HISTORY[7:]}")
    page = F.coalesce(both["filings"]["recent"], F.struct(*(both[c].alias(c) for c in ("form", "filingDate", "accessionNumber", "primaryDocument"))))
    rows = records({"form": page["form"], "filing_date": page["filingDate"], "accession": page["accessionNumber"], "document": page["primaryDocument"]})
    rest = [c for c in pages.columns if c != column]
    out = pages.select(*rest, F.explode(rows).alias("r")).select(*rest, "r.*")
    return out.withColumn("filing_date", F.to_date(F.try_to_timestamp("filing_date", F.lit("yyyy-MM-dd")))).where(F.col("filing_date").isNotNull() & (F.coalesce("accession", F.lit("")) != ""))


def history_pages(pages: DataFrame, column: str = "json", key: str = "cik") -> DataFrame:
    """The names of further history files that a main file (filings.files) lists: key, name. Files that are no JSON list none."""
    files = F.from_json(F.col(column), "struct<filings:struct<files:array<struct<name:string>>>>")["filings"]["files"]
    return pages.select(key, F.explode(files).alias("f")).select(key, "f.name").where(F.coalesce("name", F.lit("")) != "")


def full_history(main: DataFrame, files: DataFrame, column: str = "json", key: str = "cik", name: str = "name") -> DataFrame:
    """Filings of main files (key, json) and of all further files (name, json) that they list; what is missing or broken is passed over."""
    further = history_pages(main, column, key).distinct().join(files.select(F.col(name).alias("name"), column), "name").select(key, column)
    return filing_history(main.select(key, column).unionByName(further), column)


def ticker_map(rows: DataFrame, order: str, ticker: str = "ticker", cik: str = "cik") -> DataFrame:
    """(ticker, cik): one row for each ticker in upper case; of several the last in order counts."""
    return rows.groupBy(F.upper(F.trim(ticker)).alias("ticker")).agg(F.max_by(cik, order).alias("cik"))


def resolve_tickers(rows: DataFrame, known: DataFrame, ticker: str = "ticker") -> DataFrame:
    """``rows`` with cik and is_known, whatever the ticker's case. No hint: Spark broadcasts ``known`` where its size allows."""
    ids = known.select(F.col("ticker").alias("_ticker"), F.col("cik"))
    return rows.drop("cik").join(ids, F.upper(F.trim(ticker)) == F.col("_ticker"), "left").withColumn("is_known", F.col("_ticker").isNotNull()).drop("_ticker")


def unresolved(rows: DataFrame, known: DataFrame, ticker: str = "ticker") -> DataFrame:
    """The distinct tickers that are not known, with how many rows ask for each and what to do."""
    asked = rows.groupBy(F.upper(F.trim(ticker)).alias("ticker")).agg(F.count(F.lit(1)).alias("n"))
    hint = F.concat(F.lit("no id is known for "), F.coalesce("ticker", F.lit("(null)")), F.lit("; the map holds current tickers only, so give its id"))
    return asked.join(known, "ticker", "left_anti").withColumn("hint", hint)


def list_filings(filings: DataFrame, tickers: list[str] | None = None, forms: list[str] | None = None, years: list[int] | None = None) -> DataFrame:
    """Filings of some tickers, forms (in either spelling, whatever their case) and years."""
    out = filings
    if tickers:
        out = out.where(F.upper("ticker").isin(*(t.upper() for t in tickers)))
    if forms:
        out = out.where(F.lower(F.replace("form", F.lit("_"), F.lit(" "))).isin(*(f.replace("_", " ").lower() for f in forms)))
    if years:
        out = out.where(F.year("filing_date").isin(*years))
    return out


def in_order(filings: DataFrame, before: str = "seq") -> DataFrame:
    """Each filing's place among those of its ticker by date; of one date in the order that they came in."""
    return filings.withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy("filing_date", before)))


def valid_user_agent(agent: Column) -> Column:
    """A name and a mail address to reach it by, as the archive asks for."""
    mail = r"[^@\s]+@[^@\s]+\.[^@\s]+"
    return F.coalesce(agent.rlike(mail) & ~F.trim(agent).rlike(f"^<?{mail}>?$"), F.lit(False))


def client_key(forwarded: Column, peer: Column, trusted: Column) -> Column:
    """Whose limit a request counts against: the first forwarded address, where its sender is trusted."""
    first = F.trim(F.split(F.coalesce(forwarded, F.lit("")), ",")[0])
    return F.when(trusted & (first != ""), first).otherwise(peer)


def stratified_sample(filings: DataFrame, stratum: str, key: str, limit: int, n_strata: int, seed: int = 7) -> DataFrame:
    """The same number from each stratum, by the order of a seeded digest."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string")).cast("binary")), key)
    return filings.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit // n_strata).drop("_n")


def csv_field(value: Column) -> Column:
    """A field as CSV needs it: quoted where it holds a comma, quote or line end."""
    v = F.coalesce(value, F.lit(""))
    return F.when(v.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_document(roles: Column, rows: Column) -> Column:
    """A table as one CSV text; short rows are filled, long ones cut."""
    n = F.size(roles)
    line = lambda cells: F.array_join(F.transform(F.slice(F.concat(cells, F.array_repeat(F.lit(""), n)), F.lit(1), n), csv_field), ",")
    return F.concat(line(roles), F.lit("\n"), F.array_join(F.transform(rows, lambda r: F.concat(line(r), F.lit("\n"))), ""))


# --- documents as a viewer, a cache and a client see them

#: Wordings of the header that each table must have.
EVIDENCE = {
    "summary_compensation": ("principal position", "name and principal", "name of executive"),
    "director_compensation": ("fees earned", "paid in cash", "annual retainer"),
    "beneficial_ownership": ("beneficial owner", "percent of class", "beneficially owned"),
}


def contains_evidence(text: Column, profile: str) -> Column:
    """Whether a document speaks of the table's mandated header at all; true for a table without known wordings."""
    phrases = EVIDENCE.get(profile)
    return has_any(F.lower(text), phrases) if phrases else F.lit(True)


def looks_like_html(text: Column) -> Column:
    """Whether to show a document as HTML: old table blocks without rows or cells are not."""
    return F.substring(F.lower(text), 1, 8192).rlike(r"<html|<!doctype html|<body|<div|<font|<span|<p[\s>]|<t[dr][\s>]")


def content_hash(content: Column) -> Column:
    return F.left(F.sha2(content.cast("binary"), 256), F.lit(16))


def retry_wait(status: Column, attempt: Column, retry_after: Column, most: int = 4) -> Column:
    """Seconds to wait before a request is tried again, without jitter; null where it is not: done, missing or given up."""
    throttled = status.isin(403, 429) | (status >= 500)
    asked = retry_after.try_cast("double")
    stated = F.when(asked.isNotNull(), F.greatest(asked, F.lit(0.0)))
    return F.when(throttled & (attempt < most), F.coalesce(stated, F.pow(F.lit(2.0), attempt)))


def valid_request(email: Column, ticker: Column, year: Column, form: Column) -> Column:
    """The first field of a request that cannot be used, or null."""
    number = F.trim(year).try_cast("int")
    return (
        F.when(~F.coalesce(F.trim(email).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]{2,}$") & (F.length(F.trim(email)) <= 254), F.lit(False)), "email")
        .when(~F.coalesce(F.upper(F.trim(ticker)).rlike(r"^[A-Z][A-Z0-9.\-]{0,9}$"), F.lit(False)), "ticker")
        .when(~F.coalesce(number.between(1993, 2100), F.lit(False)), "year")
        .when(~F.coalesce(F.upper(F.trim(form)), F.lit("DEF 14A")).isin("DEF 14A", "DEFM14A", "DEFA14A", "PRE 14A", ""), "form")
    )


def fetchable(url: Column) -> Column:
    """Whether a URL is within the archive."""
    host, path = F.try_parse_url(url, F.lit("HOST")), F.try_parse_url(url, F.lit("PATH"))
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & host.isin("www.sec.gov", "data.sec.gov") & (path.startswith("/Archives/") | path.startswith("/submissions/") | path.startswith("/files/")), F.lit(False))
