"""The engine's registered queries with their SQL twins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.functions import roles as R
from filingloom.functions import text as T
from filingloom.operators import limits, quality
from filingloom.operators.select import rank_rows
from filingloom.plans import render
from filingloom.plans.extract import candidates, extract, facts, partition_flags, wide
from filingloom.profiles import DIRECTOR, OWNERSHIP, SUMMARY, dimensions
from filingloom.sources import archive as A
from filingloom.sources import filings as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scratch(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one in local mode, where one machine runs all."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set")
    return tempfile.mkdtemp(prefix="filingloom-")


def typed_holders(found: DataFrame) -> DataFrame:
    w = wide(found, OWNERSHIP, roles=["holder_name", "holder_address", "section", "is_group", "shares", "percent"])
    return w.select("filing_id", "holder_name", "holder_address", (F.col("is_group") == "1").alias("is_group"), F.expr("try_cast(shares AS BIGINT)").alias("shares"), F.expr("try_cast(percent AS DOUBLE)").alias("percent"))


HOLDERS = """
SELECT filing_id, s_name AS holder, rn AS pos, shares, (shares * 10000) // total AS pct FROM (
  SELECT *, sum(shares) OVER (PARTITION BY filing_id)::BIGINT AS total, count(*) OVER (PARTITION BY filing_id) AS n FROM (
    SELECT *, 'N' || lpad(g::VARCHAR, 2, '0') || '-' || lpad(least(rn // 100, greatest(c - 2, 0) // 100)::VARCHAR, 4, '0') AS filing_id FROM (
      SELECT *, row_number() OVER (PARTITION BY g ORDER BY s_suppkey) - 1 AS rn, count(*) OVER (PARTITION BY g) AS c, round(abs(s_acctbal) * 100)::BIGINT + 1 AS shares FROM (
        SELECT *, CASE WHEN count(*) OVER (PARTITION BY s_nationkey) = 1 THEN 99 ELSE s_nationkey END AS g FROM supplier)))) WHERE n >= 2
"""
PAY = """
SELECT p_brand AS filing_id, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS person,
       year(l_shipdate) AS year, sum(floor(l_extendedprice)::BIGINT)::BIGINT AS salary, sum(l_quantity)::BIGINT AS bonus
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3
"""
_HOLDERS_OUT = f"SELECT filing_id, holder AS holder_name, '' AS holder_address, false AS is_group, shares, pct / 100.0::DOUBLE AS percent FROM ({HOLDERS})"


@query(_HOLDERS_OUT)
def holders_ascii(spark, sf_dir):
    """Ownership tables out of space-aligned text (the flagship)."""
    return typed_holders(extract(render.ascii_holders(render.holders(table(spark, sf_dir, "supplier"))), "ownership"))


@query(_HOLDERS_OUT)
def holders_html(spark, sf_dir):
    """The same out of HTML with header spans and sign columns."""
    return typed_holders(extract(render.html_holders(render.holders(table(spark, sf_dir, "supplier"))), "ownership"))


@query(_HOLDERS_OUT)
def holders_sgml(spark, sf_dir):
    """The same out of tagged blocks with footnotes inside."""
    return typed_holders(extract(render.sgml_holders(render.holders(table(spark, sf_dir, "supplier"))), "ownership"))


_EVERY_HOLDER = _HOLDERS_OUT.replace(" WHERE n >= 2", "")


@query(_EVERY_HOLDER)
def every_holder_html(spark, sf_dir):
    """HTML tables of any size, of one row too."""
    return typed_holders(extract(render.html_holders(render.holders(table(spark, sf_dir, "supplier"), least=1)), "ownership"))


@query(_EVERY_HOLDER)
def every_holder_sgml(spark, sf_dir):
    """Tagged blocks of any size, of one row too."""
    return typed_holders(extract(render.sgml_holders(render.holders(table(spark, sf_dir, "supplier"), least=1)), "ownership"))


@query(f"SELECT filing_id, holder AS holder_name, (pos + 10) || ' Wall Street New York, NY 10005' AS holder_address, false AS is_group, shares, pct / 100.0::DOUBLE AS percent FROM ({HOLDERS})")
def holders_continuation(spark, sf_dir):
    """Address lines below a holder's row belong to it. A filing's holders stand in as many documents as their lines need."""
    rows = render.parted(render.holders(table(spark, sf_dir, "supplier")), render.TALL_ROWS)
    return typed_holders(extract(render.ascii_holders(rows, F.concat((F.col("pos") + 10).cast("string"), F.lit(" Wall Street\n New York, NY 10005"))), "ownership"))


@query(f"""
SELECT filing_id, holder AS holder_name, '' AS holder_address, false AS is_group, shares, pct / 100.0::DOUBLE AS percent FROM ({HOLDERS})
UNION ALL SELECT filing_id, 'All directors as a group', '', true, sum(shares)::BIGINT, 100.0 FROM ({HOLDERS}) GROUP BY 1""")
def holders_group_rows(spark, sf_dir):
    """Subtotals are told from holders."""
    rows = render.holders(table(spark, sf_dir, "supplier"))
    sums = rows.groupBy("filing_id").agg(F.sum("shares").alias("shares")).select("filing_id", F.lit(1 << 40).alias("pos"), F.lit("All directors as a group").alias("holder"), "shares", F.lit(10000).cast("bigint").alias("pct"))
    return typed_holders(extract(render.ascii_holders(rows.unionByName(sums)), "ownership"))


def typed_pay(found):
    w = wide(found, SUMMARY, roles=["name", "position", "year", "salary", "bonus"])
    return w.select("filing_id", F.col("name").alias("person"), "position", *(F.expr(f"try_cast({c} AS BIGINT)").alias(c) for c in ("year", "salary", "bonus")))


_PAY_OUT = f"SELECT filing_id, person, 'Vice President' AS position, year, salary, bonus FROM ({PAY})"


@query(_PAY_OUT)
def person_years_html(spark, sf_dir):
    """People with a row for each year and their title in the name's cell."""
    return typed_pay(extract(render.html_pay(render.pay(table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"))), "sct"))


@query(_PAY_OUT)
def stacked_years_html(spark, sf_dir):
    """The years stacked in the cells of one row."""
    return typed_pay(extract(render.stacked_pay(render.pay(table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"))), "sct"))


@query(f"SELECT filing_id, person, sum(bonus)::BIGINT AS fees, sum(salary % 100000)::BIGINT AS awards, sum(bonus + salary % 100000)::BIGINT AS total, true AS adds_up FROM ({PAY}) GROUP BY 1, 2")
def directors_html(spark, sf_dir):
    """Directors' pay, whose parts make up the total."""
    found = extract(render.director_fees(render.pay(table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"))), "director")
    w = wide(quality.problems(found, "director").where(F.size("problems") == 0), DIRECTOR, roles=["name", "fees_earned", "stock_awards", "total"])
    fees, awards, total = (F.expr(f"try_cast({c} AS BIGINT)") for c in ("fees_earned", "stock_awards", "total"))
    return w.select("filing_id", F.col("name").alias("person"), fees.alias("fees"), awards.alias("awards"), total.alias("total"), (fees + awards == total).alias("adds_up"))


@query(f"SELECT filing_id, 'dom' AS backend, 'pre2006' AS era, '' AS flags, count(*) AS n_rows, 2 AS n_candidates, 4 AS margin FROM ({PAY}) GROUP BY 1")
def extraction_flags(spark, sf_dir):
    """How extractions came about: backend, era, flags, rivals. The tree and its identity row both find the table."""
    found = extract(render.html_pay(render.pay(table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"))), "sct")
    return found.select("filing_id", "backend", "era", F.array_join("flags", ",").alias("flags"), F.size("rows").cast("bigint").alias("n_rows"), "n_candidates", "margin")


@query(f"""
SELECT filing_id, d.filed, CASE WHEN d.filed = '2010-04-01' THEN 'pre2006' ELSE d.era END AS era, d.flags FROM (SELECT DISTINCT filing_id FROM ({PAY})) CROSS JOIN
  (VALUES ('2002-04-01', 'pre2006', ''), ('2007-04-01', 'pre2006', ''), ('2010-04-01', 'post2006', 'era_mismatch'), ('none', 'pre2006', 'no_filing_date')) d(filed, era, flags)""")
def era_from_columns(spark, sf_dir):
    """Columns tell the era where the date leaves it open, and raise a flag where they contradict it."""
    rows = render.pay(table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"))
    docs = render.html_pay(rows).withColumn("text", F.replace("text", F.lit("<th>Bonus ($)</th>"), F.lit("<th>LTIP Payouts ($)</th>")))
    dates = F.array(*(F.lit(d) for d in ("2002-04-01", "2007-04-01", "2010-04-01", "none")))
    docs = docs.withColumn("filed", F.explode(dates)).withColumn("filing_date", F.to_date(F.try_to_timestamp("filed", F.lit("yyyy-MM-dd"))))
    return extract(docs, "sct").select("filing_id", "filed", "era", F.array_join("flags", ",").alias("flags"))


@query(f"SELECT DISTINCT filing_id, 'dom' AS backend, 'ambiguous_selection' AS flags, 0 AS margin FROM ({HOLDERS})")
def ambiguous_ties(spark, sf_dir):
    """Two different tables of one score are told."""
    docs = render.html_holders(render.holders(table(spark, sf_dir, "supplier")))
    rival = "<table><tr><th>Name and Address of Beneficial Owner</th><th>Amount and Nature of Beneficial Ownership</th><th>Percent of Class</th></tr><tr><td>Other</td><td>100</td><td>1</td></tr><tr><td>More</td><td>200</td><td>2</td></tr></table>"
    docs = docs.withColumn("text", F.replace("text", F.lit("</body>"), F.lit(f"<p>{render.TITLE}</p>{rival}</body>")))
    return extract(docs, "ownership").select("filing_id", "backend", F.array_join("flags", ",").alias("flags"), "margin")


@query(f"SELECT DISTINCT filing_id, 1 AS n_candidates, 'ascii_source' AS flags FROM ({HOLDERS})")
def duplicate_collapse(spark, sf_dir):
    """One table found from several header lines is one candidate."""
    docs = render.ascii_holders(render.holders(table(spark, sf_dir, "supplier")))
    return extract(docs, "ownership").select("filing_id", "n_candidates", F.array_join("flags", ",").alias("flags"))


@query(f"SELECT filing_id, count(*) AS n_rows, max(salary)::VARCHAR AS top_salary FROM ({PAY}) GROUP BY 1")
def decoy_rejection(spark, sf_dir):
    """A table of grants before the right one is not taken."""
    docs = render.html_pay(render.pay(table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")))
    decoy = "<table><tr><th>Name</th><th>Grant Date</th><th>Exercise Price ($)</th><th>Expiration Date</th></tr><tr><td>Red Widget</td><td>2001</td><td>10</td><td>2011</td></tr></table>"
    docs = docs.withColumn("text", F.replace("text", F.lit("<body>"), F.lit(f"<body>{decoy}")))
    cells = facts(extract(docs, "sct")).where(F.col("role") == "salary").groupBy("filing_id")
    return cells.agg(F.count(F.lit(1)).alias("n_rows"), F.max("value_num").cast("bigint").cast("string").alias("top_salary"))


@query("""
SELECT 'd' || doc_id AS filing_id, false AS ok, 'no_filing_date,no_table_found' AS flags FROM documents
UNION ALL SELECT 'p' || page_id, false, 'no_filing_date,no_table_found' FROM pages""")
def no_table(spark, sf_dir):
    """Prose and pages without tables give a flag, not an error."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("filing_id"), "text")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("filing_id"), F.col("html").alias("text"))
    found = extract(docs.unionByName(pages).withColumn("filing_date", F.lit(None).cast("date")), "sct")
    return found.select("filing_id", "ok", F.array_join("flags", ",").alias("flags"))


@query(f"SELECT filing_id, 1 AS rank, 'ascii' AS backend, 3 AS kind, 12 AS score FROM (SELECT DISTINCT filing_id FROM ({HOLDERS}))")
def candidate_rows(spark, sf_dir):
    """The ranked candidates of each document."""
    docs = render.ascii_holders(render.holders(table(spark, sf_dir, "supplier")))
    return candidates(docs, "ownership").select("filing_id", "rank", "backend", "kind", "score")


@query(f"SELECT filing_id, pos AS row_ix, c.role, CASE c.role WHEN 'shares' THEN shares ELSE pct / 100.0::DOUBLE END AS value FROM (SELECT * EXCLUDE pos, row_number() OVER (PARTITION BY filing_id ORDER BY pos) - 1 AS pos FROM ({HOLDERS})) CROSS JOIN (VALUES ('shares'), ('percent')) c(role)")
def fact_rows(spark, sf_dir):
    """Cells in long form with their numbers."""
    cells = facts(extract(render.ascii_holders(render.holders(table(spark, sf_dir, "supplier"))), "ownership"))
    return cells.where(F.col("role").isin("shares", "percent")).select("filing_id", F.col("row_ix").cast("bigint").alias("row_ix"), "role", F.col("value_num").cast("double").alias("value"))


# --- documents and lines


@query("""
SELECT 'd' || doc_id AS id, NOT (lower(left(text, 4000)) LIKE '%<html%' OR lower(left(text, 4000)) LIKE '%<body%') AS is_text FROM documents
UNION ALL SELECT 'p' || page_id, NOT (lower(left(html, 4000)) LIKE '%<html%' OR lower(left(html, 4000)) LIKE '%<body%') FROM pages""")
def classify_encoding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text"))
    return docs.unionByName(pages).select("id", T.is_text_filing(F.col("text")).alias("is_text"))


@query(r"SELECT doc_id, text, CASE WHEN NOT regexp_matches(text, '[^\x{00}-\x{FF}]') THEN text END AS latin FROM documents")
def decode_bytes(spark, sf_dir):
    """All documents from their UTF-8 and, where Latin-1 has all their characters, from their Latin-1 form."""
    latin = F.when(~F.col("text").rlike(r"[^\x00-\xFF]"), F.encode("text", "ISO-8859-1"))
    return table(spark, sf_dir, "documents").select("doc_id", T.decode(F.encode("text", "UTF-8")).alias("text"), T.decode(latin).alias("latin"))


@query("""
SELECT doc_id, n_lines, lines[1] AS first_line, lines[n_lines] AS last_line FROM (
  SELECT doc_id, lines, len(lines) AS n_lines FROM (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS lines FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))""")
def line_explode(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", T.lines(F.col("text")).alias("l"))
    return lines.select("doc_id", F.size("l").cast("bigint").alias("n_lines"), F.try_element_at("l", F.lit(1)).alias("first_line"), F.try_element_at("l", F.size("l")).alias("last_line"))


@query(r"""
SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)
WHERE length(trim(l)) >= 6 AND len(regexp_extract_all(l, '\pL')) > 0 AND len(regexp_extract_all(l, '\p{Lu}')) > 0.7 * len(regexp_extract_all(l, '\pL')) GROUP BY 1""")
def heading_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return lines.where(T.is_heading(F.col("l"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(r"""
SELECT o_orderkey, true AS row_like FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, false FROM orders WHERE o_orderkey % 3 = 0""")
def row_like_lines(spark, sf_dir):
    line = F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 3 > 0, "   ").otherwise(" "), F.col("o_totalprice").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.is_row_like(line).alias("row_like"))


@query("SELECT page_id, length(html) AS n_chars, length(replace(regexp_replace(html, '<[^>]+>', '', 'gs'), ' ', '')) AS n_said FROM pages")
def blank_tags(spark, sf_dir):
    blank = T.blank_tags(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(blank).alias("n_chars"), F.length(F.replace(blank, F.lit(" "), F.lit(""))).alias("n_said"))


@query("SELECT doc_id, " + " + ".join(f"(contains(lower(text), '{t}'))::INT" for t in ("the", "and", "der", "que", "trash")) + " AS n, contains(lower(text), 'trash') AS decoy FROM documents")
def token_score(spark, sf_dir):
    low = F.lower("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.count_tokens(low, ("the", "and", "der", "que", "trash")).alias("n"), T.has_any(low, ("trash",)).alias("decoy"))


@query("""
SELECT o_custkey, o_orderkey, rank, CASE WHEN rank = 1 THEN score - nxt END AS margin FROM (
  SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS nxt FROM (SELECT o_custkey, o_orderkey, floor(o_totalprice / 50000)::BIGINT AS score, ascii(o_orderstatus) AS weight FROM orders)
  WINDOW w AS (PARTITION BY o_custkey ORDER BY score DESC, weight DESC, o_orderkey))""")
def rank_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 50000).alias("score"), F.ascii("o_orderstatus").alias("weight"))
    ranked = rank_rows(rows.withColumn("seq", F.col("o_orderkey")), ["o_custkey"], "score", "weight", "o_orderkey", "seq")
    return ranked.select("o_custkey", "o_orderkey", F.col("rank").cast("bigint").alias("rank"), "margin")


# --- headers, roles, numbers

def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") v({names})"


@query("SELECT p_partkey, lower(p_name) AS cleaned FROM part")
def clean_headers(spark, sf_dir):
    """Headers out of their dressing: units, footnote marks, lines, rules, words parted at a line's end."""
    k, name = F.col("p_partkey"), F.col("p_name")
    raw = (
        F.when(k % 6 == 0, F.concat(name, F.lit(" ($)"))).when(k % 6 == 1, F.concat(name, F.lit(" ("), (k % 90).cast("string"), F.lit(") (a)"))).when(k % 6 == 2, F.replace(name, F.lit(" "), F.lit("\n")))
        .when(k % 6 == 3, F.concat(F.lit("| "), F.upper(name), F.lit(" /"))).when(k % 6 == 4, F.concat(F.substring(name, 1, 2), F.lit("- "), F.substring(name, 3, 100))).otherwise(F.concat(F.lit(" ("), F.replace(name, F.lit(" "), F.lit("   ")), F.lit(" ( )")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", T.clean_header(raw).alias("cleaned"))


#: Words that headers are put together of, two at a time.
HEADER_WORDS = (
    "Name", "and principal", "Position", "Year", "Salary", "Bonus", "Total", "Stock Awards", "Option Awards", "All Other", "LTIP", "Securities Underlying", "Fiscal Year", "Non-Equity Incentive", "Change in Pension",
    "Restricted Stock", "Other Annual", "Title", "Payouts", "Favourite Colour",
)


def _role_sql(cleaned: str, era: str) -> str:
    """The role of a cleaned header under an era, from the profile's rules."""

    def first(rules) -> str:
        return "CASE " + " ".join(f"WHEN regexp_matches({cleaned}, '{'|'.join(patterns)}') THEN '{role}'" for role, patterns in rules) + " END"

    fits = {*SUMMARY.schema.roles(era), "name", "position"}
    return f"coalesce({first([r for r in SUMMARY.rules if r[0] in fits])}, {first(SUMMARY.rules)}, regexp_replace({cleaned}, '[^a-z0-9]+', '_', 'g'))"


_WORD = "[" + ", ".join(f"'{w}'" for w in HEADER_WORDS) + "]"


@query(f"""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN {_role_sql('h', 'pre2006')} WHEN 1 THEN {_role_sql('h', 'post2006')} ELSE {_role_sql('h', 'transition')} END AS role FROM (
  SELECT o_orderkey, lower({_WORD}[o_orderkey % 20 + 1] || ' ' || {_WORD}[(o_orderkey // 20) % 20 + 1]) AS h FROM orders)""")
def infer_roles(spark, sf_dir):
    """Roles of headers of two phrases each under all three eras."""
    k, word = F.col("o_orderkey"), F.array(*map(F.lit, HEADER_WORDS))
    at = lambda i: F.element_at(word, (i % 20 + 1).cast("int"))
    era = F.when(k % 3 == 0, "pre2006").when(k % 3 == 1, "post2006").otherwise("transition")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(at(k), F.lit(" "), at(F.floor(k / 20))).alias("h"), era.alias("era"))
    return rows.select("o_orderkey", R.infer_role(F.col("h"), SUMMARY, F.col("era")).alias("role"))


@query("""
SELECT o_orderkey, 'name_and_position,' || array_to_string(list_transform(range(1, o_orderkey % 5 + 2), lambda i: CASE WHEN i = 1 THEN 'salary' ELSE 'salary_' || i END), ',') || repeat(',unknown', (o_orderkey % 3)::INT) || ',bonus' AS roles FROM orders""")
def role_suffixes(spark, sf_dir):
    """Repeated columns are numbered, those without a name are not."""
    k = F.col("o_orderkey")
    heads = F.concat(F.array(F.lit("Name and Principal Position")), F.array_repeat(F.lit("Salary ($)"), (k % 5 + 1).cast("int")), F.array_repeat(F.lit("$"), (k % 3).cast("int")), F.array(F.lit("Bonus")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", heads.alias("heads"))
    return rows.select("o_orderkey", F.array_join(R.infer_roles(F.col("heads"), SUMMARY, F.lit("pre2006")), ",").alias("roles"))


OWNED = [
    ("Name and Address of Beneficial Owner", "holder_name"), ("Shares Beneficially Owned Right to Acquire", "shares_right_to_acquire"), ("Percent of Voting Power", "percent_voting_power"), ("Title of Class", "share_class"),
    ("Percent of Shares of Common Stock", "percent_shares"), ("Amount and Nature of Beneficial Ownership (1)", "shares"), ("Position Held with the Company", "ignore"), ("Total", "total"), ("% of Outstanding", "percent"), ("Series", "share_class"),
]


@query(_values(OWNED, "header, role"))
def header_map_lookup(spark, sf_dir):
    return spark.createDataFrame([(h,) for h, _ in OWNED], "header string").select("header", R.infer_role(F.col("header"), OWNERSHIP, F.lit("single")).alias("role"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN '' ELSE CASE WHEN o_orderkey % 6 = 2 THEN '-' ELSE '' END || (floor(o_totalprice)::BIGINT)::VARCHAR END AS number FROM orders""")
def normalize_numbers(spark, sf_dir):
    """Numbers out of dressed cells: the inverse of dressing them."""
    whole = F.format_number(F.floor("o_totalprice"), 0)
    kind = F.col("o_orderkey") % 6
    cell = (
        F.when(kind == 0, "N/A").when(kind == 1, " -- ").when(kind == 2, F.concat(F.lit("("), whole, F.lit(")"))).when(kind == 3, F.concat(F.lit("$ "), whole)).when(kind == 4, F.concat(whole, F.lit(" (3)"))).otherwise(F.concat(F.lit("  "), whole, F.lit("%")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", T.normalize_number(cell).alias("number"))


@query("""
SELECT o_orderkey, CASE k WHEN 0 THEN d WHEN 1 THEN m WHEN 2 THEN '-' || n || '.' || d WHEN 3 THEN '-' || n WHEN 4 THEN n ELSE '' END AS as_read,
  CASE k WHEN 0 THEN '0.' || d WHEN 1 THEN n WHEN 2 THEN '-' || n || '.' || d WHEN 3 THEN '-' || n WHEN 4 THEN n ELSE '' END AS corrected
FROM (SELECT o_orderkey, o_orderkey % 6 AS k, (o_orderkey % 9 + 1)::VARCHAR AS d, (o_orderkey % 20 + 1)::VARCHAR AS m, (o_custkey * 997)::VARCHAR AS n FROM orders)""")
def number_readings(spark, sf_dir):
    """The plain reading and the corrected one beside it, which reads a leading point and steps over a footnote mark."""
    k, digit, mark = F.col("o_orderkey") % 6, (F.col("o_orderkey") % 9 + 1).cast("string"), (F.col("o_orderkey") % 20 + 1).cast("string")
    whole = F.format_number(F.col("o_custkey") * 997, 0)
    cell = (
        F.when(k == 0, F.concat(F.lit("."), digit, F.lit("%"))).when(k == 1, F.concat(F.lit("("), mark, F.lit(") "), whole)).when(k == 2, F.concat(F.lit("("), whole, F.lit("."), digit, F.lit(")"))).when(k == 3, F.concat(F.lit("$-"), whole))
        .when(k == 4, whole).otherwise(F.element_at(F.array(*map(F.lit, ("", "*", "not applicable", "N/A", " -- "))), (F.col("o_orderkey") % 5 + 1).cast("int")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", T.normalize_number(cell).alias("as_read"), T.corrected_number(cell).alias("corrected"))


@query("""
SELECT p_partkey, k IN (0, 1, 6) AS person, k = 2 AS title, k = 3 AS is_group, k IN (4, 7) AS address, k = 5 AS prose FROM (SELECT p_partkey, p_partkey % 8 AS k FROM part)""")
def who_is_it(spark, sf_dir):
    """People, titles, groups, addresses and prose, all of them around a part's name; house numbers have six digits at most, as addresses ask."""
    k, name = F.col("p_partkey"), F.initcap("p_name")
    made = (
        name, F.concat(F.lit("J. "), name, F.lit(", Jr. (a)")), F.concat(F.lit("Vice President, "), name), F.concat(F.lit("All directors with "), F.lower(name)), F.concat((k % 1000000).cast("string"), F.lit(" Elm Street, "), name),
        F.concat(name, F.lit(" held pursuant to a plan")), F.concat(name, F.lit(", Ph.D")), F.concat(F.lit("P.O. Box "), k.cast("string")),
    )
    c = F.col("cell")
    df = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*made), (k % 8 + 1).cast("int")).alias("cell"))
    return df.select("p_partkey", T.looks_like_person(c).alias("person"), T.looks_like_title(c).alias("title"), T.looks_like_group(c).alias("is_group"), T.looks_like_address(c).alias("address"), T.looks_like_prose(c).alias("prose"))


# --- schemas


@query(_values([(p.name, e, len(p.schema.roles(e)), len(p.schema.required(e))) for p in (SUMMARY, DIRECTOR, OWNERSHIP) for e in p.schema.eras()], "profile, era, n, n_required"))
def schema_fields(spark, sf_dir):
    return dimensions(spark)["schema_fields"].groupBy("profile", "era").agg(F.count(F.lit(1)).alias("n"), F.count_if("required").alias("n_required"))


@query(_values([("pre2006", "ltip_payouts,options_sars,other_annual_comp,restricted_stock_awards"), ("post2006", "non_equity_incentive,option_awards,pension_and_nqdc,stock_awards")], "era, roles"))
def schema_exclusive(spark, sf_dir):
    """Roles that one version has alone, as a set difference."""
    fields = dimensions(spark)["schema_fields"].where((F.col("profile") == "summary_compensation") & (F.col("era") != "transition"))
    other = fields.select(F.col("role").alias("r2"), F.col("era").alias("e2"))
    alone = fields.join(other, (F.col("role") == F.col("r2")) & (F.col("era") != F.col("e2")), "left_anti")
    return alone.groupBy("era").agg(F.array_join(F.array_sort(F.collect_list("role")), ",").alias("roles"))


@query("""
SELECT o_orderkey, d::VARCHAR AS filed, CASE WHEN d < DATE '2006-12-15' THEN 'pre2006' WHEN d <= DATE '2007-12-31' THEN 'transition' ELSE 'post2006' END AS era, d >= DATE '2006-12-15' AS mandated
FROM (SELECT o_orderkey, (o_orderdate::DATE + 3200)::DATE AS d FROM orders)""")
def filing_eras(spark, sf_dir):
    d = F.date_add(F.to_date("o_orderdate"), 3200)
    return table(spark, sf_dir, "orders").select("o_orderkey", d.cast("string").alias("filed"), SUMMARY.schema.era_column(d).alias("era"), DIRECTOR.schema.applies(d).alias("mandated"))


# --- sources


def _as_filings(orders: DataFrame) -> DataFrame:
    suffix = F.element_at(F.array(F.lit("html"), F.lit("txt"), F.lit("htm")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return orders.select(
        F.concat(F.lit("C"), "o_custkey").alias("ticker"), F.lit("DEF 14A").alias("form"), F.to_date("o_orderdate").alias("filing_date"), suffix.alias("suffix"), F.format_string("%010d-%02d-%06d", "o_custkey", F.year("o_orderdate") % 100, F.col("o_orderkey") % 1000000).alias("accession"),
        F.concat(F.lit("doc-"), "o_orderkey").alias("locator"), "o_orderkey",
    )


_PICK = "SELECT 'C' || o_custkey AS ticker, year(o_orderdate) AS year, {f}(o_orderkey, {order}) AS o_orderkey FROM orders GROUP BY 1, 2"
_ORDER = "lpad(((o_orderdate::DATE - DATE '1970-01-01') * 10 + CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 3 END)::VARCHAR, 9, '0') || 'doc-' || o_orderkey"


@query(_PICK.format(f="max_by", order=_ORDER))
def latest_filing(spark, sf_dir):
    rows = _as_filings(table(spark, sf_dir, "orders")).withColumn("year", F.year("filing_date"))
    return S.pick_filing(rows, ["ticker", "year"]).select("ticker", "year", "o_orderkey")


@query(_PICK.format(f="min_by", order=_ORDER))
def earliest_filing(spark, sf_dir):
    rows = _as_filings(table(spark, sf_dir, "orders")).withColumn("year", F.year("filing_date"))
    return S.pick_filing(rows, ["ticker", "year"], prefer="earliest").select("ticker", "year", "o_orderkey")


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN acc WHEN 1 THEN acc ELSE left(sha256('doc-' || o_orderkey), 12) END AS token, left(sha256('doc-' || o_orderkey), 16) AS filing_id FROM (
  SELECT *, lpad(o_custkey::VARCHAR, 10, '0') || '-' || lpad((year(o_orderdate) % 100)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') AS acc FROM orders)""")
def filing_tokens(spark, sf_dir):
    rows = _as_filings(table(spark, sf_dir, "orders"))
    kind = F.col("o_orderkey") % 3
    accession = F.when(kind == 0, F.col("accession")).otherwise("")
    locator = F.when(kind == 1, F.concat(F.lit("a/b/"), "accession", F.lit(".txt"))).otherwise(F.col("locator"))
    return rows.select("o_orderkey", S.token(accession, locator).alias("token"), S.filing_id(F.col("locator")).alias("filing_id"))


@query("""
SELECT o_orderkey, 'C' || o_custkey AS ticker, 'DEF 14A' AS form, o_orderdate::DATE::VARCHAR AS filed, 'htm' AS suffix FROM orders WHERE o_orderkey % 5 > 0""")
def path_parse(spark, sf_dir):
    """Identity from paths; impossible dates are passed over."""
    day = F.when(F.col("o_orderkey") % 5 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("2001-02-30")
    path = F.concat(F.lit("file:/corpus/c"), "o_custkey", F.lit("/DEF_14A/"), day, F.lit("_DEF_14A.htm"))
    rows = S.parse_paths(table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path")))
    return rows.select("o_orderkey", "ticker", "form", F.col("filing_date").cast("string").alias("filed"), "suffix")


@query("SELECT o_orderkey, o_orderkey % 3 > 0 AND o_orderkey % 2 = 0 AS is_cached FROM orders")
def cache_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    wanted = orders.select("o_orderkey", F.concat(F.lit("t"), "o_orderkey").alias("token"))
    cached = orders.where(F.col("o_orderkey") % 3 > 0).select(F.concat(F.lit("t"), "o_orderkey").alias("token"), F.when(F.col("o_orderkey") % 2 == 0, 10).otherwise(0).alias("bytes"))
    return S.split_cached(wanted, cached).select("o_orderkey", "is_cached")


@query("SELECT count(*) AS files, sum(o_orderkey % 1000)::BIGINT AS bytes, count(DISTINCT o_custkey) AS tickers FROM orders WHERE o_orderkey % 7 > 0")
def cache_stats(spark, sf_dir):
    ext = F.when(F.col("o_orderkey") % 7 > 0, ".html").otherwise(".part")
    return S.cache_stats(table(spark, sf_dir, "orders").select(F.concat("o_orderkey", ext).alias("path"), (F.col("o_orderkey") % 1000).alias("bytes"), F.col("o_custkey").alias("ticker")))


@query("SELECT left(sha256(string_agg('doc-' || o_orderkey, '|' ORDER BY 'doc-' || o_orderkey)), 16) AS fingerprint, count(*) AS files FROM orders")
def corpus_fingerprint(spark, sf_dir):
    return quality.fingerprint(_as_filings(table(spark, sf_dir, "orders")), "locator")


@query("""
SELECT o_custkey, o_orderkey, 'DEF 14A' AS form, 'a' || o_orderkey AS accession FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE rn <= n - (o_custkey % 2)""")
def columnar_records(spark, sf_dir):
    """Parallel arrays, some ragged, to rows."""
    w = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    short = F.slice(F.transform("keys", lambda k: F.concat(F.lit("a"), k.cast("string"))), F.lit(1), F.size("keys") - (F.col("o_custkey") % 2).cast("int"))
    rows = S.records({"key": F.col("keys"), "form": F.transform("keys", lambda k: F.lit("DEF 14A")), "accession": short})
    return w.select("o_custkey", F.explode(rows).alias("r")).select("o_custkey", F.col("r.key").alias("o_orderkey"), "r.form", "r.accession")


@query("""
SELECT o_custkey, o_orderdate::DATE::VARCHAR AS filed, 'a' || o_orderkey AS accession FROM orders WHERE o_custkey % 10 > 0 AND o_orderkey % 4 > 0""")
def filing_history(spark, sf_dir):
    """History files: bare or nested pages, broken ones passed over, filings without an accession left out."""
    cols = {"form": F.lit("DEF 14A"), "filingDate": F.date_format("o_orderdate", "yyyy-MM-dd"), "accessionNumber": F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("a"), "o_orderkey")).otherwise(""), "primaryDocument": F.lit("d.htm")}
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(*(c.alias(n) for n, c in cols.items()))).alias("rs"))
    page = F.struct(*(F.col("rs")[n].alias(n) for n in cols))
    json = F.when(F.col("o_custkey") % 10 == 0, "{broken").when(F.col("o_custkey") % 2 == 0, F.to_json(page)).otherwise(F.to_json(F.struct(F.struct(page.alias("recent")).alias("filings"))))
    return S.filing_history(rows.select("o_custkey", json.alias("json"))).select("o_custkey", F.col("filing_date").cast("string").alias("filed"), "accession")


@query("""
SELECT o_orderkey, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || CASE WHEN o_orderdate < DATE '2000-05-01' OR o_orderkey % 5 = 0 THEN '0001-02-' || o_orderkey || '.txt' ELSE '000102' || o_orderkey || '/proxy.htm' END AS url FROM orders""")
def archive_urls(spark, sf_dir):
    document = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("proxy.htm")
    url = S.archive_url(F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.concat(F.lit("0001-02-"), "o_orderkey"), document, F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", url.alias("url"))


def _known_tickers(spark, sf_dir):
    """Two of three customers, in mixed case and twice; the later entry counts."""
    customers = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 3 != 0)
    entries = customers.select(F.explode(F.array(F.struct(F.concat(F.lit("t"), "c_custkey").alias("ticker"), F.lit(-1).cast("bigint").alias("cik"), F.lit(1).alias("ord")), F.struct(F.concat(F.lit(" T"), "c_custkey").alias("ticker"), F.col("c_custkey").cast("bigint").alias("cik"), F.lit(2).alias("ord")))).alias("e"))
    return S.ticker_map(entries.select("e.*"), "ord")


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL OR c_custkey % 3 = 0 THEN NULL ELSE c_custkey END AS cik, coalesce(c_custkey % 3 > 0, false) AS is_known FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def ticker_lookup(spark, sf_dir):
    """Tickers to ids, whatever their case; what is not known stays null."""
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("t"), "o_custkey").alias("ticker"))
    return S.resolve_tickers(asked, _known_tickers(spark, sf_dir)).select("o_orderkey", "cik", "is_known")


@query("SELECT 'T' || o_custkey AS ticker, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 <> 0 WHERE c_custkey IS NULL GROUP BY 1")
def unresolved_tickers(spark, sf_dir):
    """Tickers that no id is known for."""
    return S.unresolved(table(spark, sf_dir, "orders").select(F.concat(F.lit("t"), "o_custkey").alias("ticker")), _known_tickers(spark, sf_dir)).select("ticker", "n")


@query("SELECT o_custkey, o_orderdate::DATE::VARCHAR AS filed, 'a' || o_orderkey AS accession FROM orders WHERE o_orderkey % 3 = 0 OR o_custkey % 7 > 1")
def paged_history(spark, sf_dir):
    """History over a main file and the further files that it lists; some of those are broken or missing."""
    cols = {"form": F.lit("DEF 14A"), "filingDate": F.date_format("o_orderdate", "yyyy-MM-dd"), "accessionNumber": F.concat(F.lit("a"), "o_orderkey"), "primaryDocument": F.lit("d.htm")}
    rows = table(spark, sf_dir, "orders").withColumn("recent", F.col("o_orderkey") % 3 == 0).groupBy("o_custkey").agg(
        *(F.collect_list(F.when(F.col("recent") == of, F.struct(*(c.alias(n) for n, c in cols.items())))).alias(name) for name, of in (("recent", True), ("older", False)))
    )
    page = lambda rs: F.struct(*(F.col(rs)[n].alias(n) for n in cols))
    file = F.concat(F.lit("older-"), "o_custkey")
    main = rows.select("o_custkey", F.to_json(F.struct(F.struct(page("recent").alias("recent"), F.array(F.struct(file.alias("name"))).alias("files")).alias("filings"))).alias("json"))
    further = rows.where(F.col("o_custkey") % 7 > 0).select(file.alias("name"), F.when(F.col("o_custkey") % 7 == 1, "{broken").otherwise(F.to_json(page("older"))).alias("json"))
    return S.full_history(main, further, key="o_custkey").select("o_custkey", F.col("filing_date").cast("string").alias("filed"), "accession")


@query("""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) AS place FROM orders WHERE year(o_orderdate) IN (1995, 1997) AND o_orderkey % 3 > 0""")
def listed_filings(spark, sf_dir):
    """Filings of two years and one form, in either spelling, by date."""
    form = F.element_at(F.array(F.lit("10-K"), F.lit("def_14a"), F.lit("DEF 14A")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = _as_filings(table(spark, sf_dir, "orders")).withColumn("form", form)
    return S.in_order(S.list_filings(rows, forms=["DEF 14A"], years=[1995, 1997]), "o_orderkey").select("o_orderkey", F.col("place").cast("bigint").alias("place"))


@query("SELECT 'P' || page_id AS ticker, 'DEF 14A' AS form, strlen(html) AS bytes, left(sha256(html), 16) AS hash, page_id % 2 = 0 AS from_cache FROM pages WHERE length(html) > 0")
def cache_round_trip(spark, sf_dir):
    """Documents written as an archive, listed, and half of them read through it as a cache."""
    folder = f"{_scratch(spark)}/archive-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), "page_id").alias("ticker"), F.lit("DEF 14A").alias("form"), F.to_date(F.lit("2003-04-01")).alias("filing_date"), F.lit("htm").alias("suffix"), F.concat(F.lit("t"), "page_id").alias("token"),
        F.encode("html", "UTF-8").alias("content"), "page_id",
    )
    A.write_archive(docs, f"{folder}/source").agg(F.sum("bytes")).collect()
    A.write_archive(docs.where(F.col("page_id") % 2 == 0), f"{folder}/cache").agg(F.sum("bytes")).collect()
    source, cache = A.ArchiveSource(spark, f"{folder}/source"), A.ArchiveSource(spark, f"{folder}/cache")
    wanted = source.list(forms=["def_14a"], years=[2003]).withColumn("token", F.regexp_extract("locator", r"_(t\d+)\.htm$", 1))
    got = A.through_cache(wanted, cache, source)
    return got.select("ticker", "form", F.octet_length("content").cast("bigint").alias("bytes"), S.content_hash(F.col("content")).alias("hash"), "from_cache")


@query(r"""
SELECT c_custkey, agent, CASE c_custkey % 5 WHEN 0 THEN true WHEN 3 THEN true ELSE false END AS valid FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name || ' c' || c_custkey || '@example.com' WHEN 1 THEN 'c' || c_custkey || '@example.com'
  WHEN 2 THEN c_name WHEN 3 THEN 'Lab <c' || c_custkey || '@uni.edu>' ELSE ' <c' || c_custkey || '@uni.edu> ' END AS agent FROM customer)""")
def user_agents(spark, sf_dir):
    """Names with an address, addresses alone, names alone."""
    mail = lambda host: F.concat(F.lit("c"), "c_custkey", F.lit(f"@{host}"))
    kind = F.col("c_custkey") % 5
    agent = F.when(kind == 0, F.concat("c_name", F.lit(" "), mail("example.com"))).when(kind == 1, mail("example.com")).when(kind == 2, F.col("c_name")).when(kind == 3, F.concat(F.lit("Lab <"), mail("uni.edu"), F.lit(">"))).otherwise(F.concat(F.lit(" <"), mail("uni.edu"), F.lit("> ")))
    return table(spark, sf_dir, "customer").select("c_custkey", agent.alias("agent")).select("c_custkey", "agent", S.valid_user_agent(F.col("agent")).alias("valid"))


@query("""
SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size
FROM (SELECT o_orderkey, (o_orderkey % 997 + 1) * (1024 ** (o_orderkey % 4))::BIGINT AS n FROM orders)""")
def human_sizes(spark, sf_dir):
    n = (F.col("o_orderkey") % 997 + 1) * F.pow(F.lit(1024), F.col("o_orderkey") % 4).cast("bigint")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.human_bytes(n).alias("size"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || user_id ELSE 'peer' || user_id END AS client FROM events")
def client_keys(spark, sf_dir):
    forwarded = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" 10.0.0."), "user_id", F.lit(", 1.1.1.1"))).otherwise(F.concat(F.lit("10.0.0."), "user_id"))
    return table(spark, sf_dir, "events").select("event_id", S.client_key(forwarded, F.concat(F.lit("peer"), "user_id"), F.col("event_id") % 3 == 0).alias("client"))


@query("""
SELECT o_orderkey, bucket FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('7:' || o_orderkey), o_orderkey) AS rn FROM (
  SELECT o_orderkey, CASE WHEN year(o_orderdate) <= 2000 THEN '1994-2000' ELSE '2001-2005' END AS bucket FROM orders)) WHERE rn <= 50""")
def stratified_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", quality.era_bucket(F.year("o_orderdate")).alias("bucket"))
    return S.stratified_sample(rows, "bucket", "o_orderkey", 200, 4)


@query(r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '[,"\r\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field FROM documents""")
def csv_quote(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.csv_field(F.col("text")).alias("field"))


@query(f"""
SELECT filing_id, 'holder_name,holder_address,section,is_group,shares,percent' || chr(10) || string_agg(holder || ',,,0,' || shares || ',' || (pct // 100) || '.' || lpad((pct % 100)::VARCHAR, 2, '0') || chr(10), '' ORDER BY pos) AS csv FROM ({HOLDERS}) GROUP BY 1""")
def csv_tables(spark, sf_dir):
    found = extract(render.ascii_holders(render.holders(table(spark, sf_dir, "supplier"))), "ownership")
    return found.select("filing_id", S.csv_document(F.col("roles"), F.col("rows")).alias("csv"))


# --- plausibility and reports


@query("SELECT l_orderkey, l_linenumber, l_extendedprice <> 0 AND (l_extendedprice < 1000 OR l_extendedprice > 50000) AS bad FROM lineitem")
def bounds_check(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", quality.out_of_bounds(F.col("l_extendedprice"), 1000, 50000).alias("bad"))


@query("""
SELECT o_orderkey, o_totalprice > 0 AND abs(coalesce(s, 0) - o_totalprice) > greatest(0.02 * o_totalprice, 1) AS bad FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def sum_check(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"))
    joined = table(spark, sf_dir, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", quality.sum_mismatch(F.col("o_totalprice"), [F.col("s")]).alias("bad"))


@query("SELECT o_orderkey, NOT (year(o_orderdate) BETWEEN 1997 - 1 AND 1997 + 12) AS bad FROM orders")
def year_range(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", quality.year_out_of_range(F.lit(1997) * 1, F.year("o_orderdate")).alias("bad"))


_OUTCOME = "CASE WHEN o_orderkey % 11 < 3 THEN CASE o_orderkey % 11 WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'table_absent' ELSE 'missed' END WHEN o_orderkey % 11 < 5 THEN 'implausible' WHEN o_orderkey % 11 < 7 THEN 'clean' ELSE 'strict' END"


def _outcomes(spark, sf_dir):
    k = F.col("o_orderkey") % 11
    result = quality.outcome(k >= 3, k >= 2, k >= 1, F.when(k < 5, 1).otherwise(0), F.when(k < 7, 1).otherwise(0))
    return table(spark, sf_dir, "orders").select("o_orderkey", quality.era_bucket(F.year("o_orderdate")).alias("bucket"), result.alias("outcome"))


@query(f"SELECT o_orderkey, {_OUTCOME} AS outcome FROM orders")
def outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir).select("o_orderkey", "outcome")


@query(f"""
SELECT coalesce(bucket, 'ALL') AS bucket, count(*) AS n, count(*) FILTER (o = 'table_absent') AS table_absent, count(*) FILTER (o = 'missed') AS missed, count(*) FILTER (o IN ('strict', 'clean', 'implausible')) AS found,
  count(*) FILTER (o IN ('strict', 'clean', 'implausible', 'missed')) AS available, count(*) FILTER (o IN ('strict', 'clean', 'implausible')) / count(*) FILTER (o IN ('strict', 'clean', 'implausible', 'missed')) AS yield_rate,
  count(*) FILTER (o IN ('strict', 'clean')) / count(*) FILTER (o IN ('strict', 'clean', 'implausible')) AS clean_rate, count(*) FILTER (o = 'strict') / count(*) FILTER (o IN ('strict', 'clean', 'implausible')) AS strict_rate
FROM (SELECT CASE WHEN year(o_orderdate) <= 2000 THEN '1994-2000' ELSE '2001-2005' END AS bucket, {_OUTCOME} AS o FROM orders) GROUP BY ROLLUP (bucket)""")
def outcome_by_era(spark, sf_dir):
    return quality.report(_outcomes(spark, sf_dir))


@query("""
SELECT page_id, CASE WHEN page_id % 9 > 0 THEN left(sha256(html), 16) END AS sha256, CASE WHEN page_id % 9 > 0 THEN strlen(html) END AS bytes, '2001-2005' AS bucket, 'pre2006' AS schema_era, false AS extracted,
  CASE WHEN page_id % 9 = 0 THEN 'unreadable' WHEN regexp_matches(lower(html), 'principal position|name and principal|name of executive') THEN 'missed' ELSE 'table_absent' END AS outcome,
  CASE WHEN page_id % 9 > 0 THEN 'no_table_found' ELSE '' END AS flags, 0::BIGINT AS rows FROM pages""")
def manifest_pages(spark, sf_dir):
    """What became of each page, some of them unreadable."""
    content = F.when(F.col("page_id") % 9 > 0, F.encode("html", "UTF-8"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.to_date(F.lit("2002-04-01")).alias("filing_date"), content.alias("content"))
    filed = quality.manifest(pages, "sct").withColumn("flags", F.array_join("flags", ","))
    return filed.select("page_id", "sha256", "bytes", "bucket", "schema_era", "extracted", "outcome", "flags", "rows")


@query(f"""
WITH m AS (
  SELECT '1994-2000' AS bucket, 'strict' AS outcome, 'dom' AS backend, NULL AS flag, count(*) AS rows FROM ({HOLDERS}) GROUP BY filing_id
  UNION ALL SELECT '2011+', CASE WHEN page_id % 4 = 0 THEN 'unreadable' WHEN page_id % 4 = 1 THEN 'missed' ELSE 'table_absent' END, NULL, CASE WHEN page_id % 4 > 0 THEN 'no_table_found' END, 0 FROM pages
    WHERE NOT regexp_matches(lower(html), 'beneficial owner|percent of class|beneficially owned|<table')
), c AS (
  SELECT bucket, 'filings' AS kind, 'filings' AS name, 1 AS n FROM m UNION ALL SELECT bucket, 'outcome', outcome, 1 FROM m UNION ALL SELECT bucket, 'rows', 'rows', rows FROM m
  UNION ALL SELECT bucket, 'backend', backend, 1 FROM m WHERE backend IS NOT NULL UNION ALL SELECT bucket, 'flag', flag, 1 FROM m WHERE flag IS NOT NULL
)
SELECT b AS bucket, kind, name, sum(n)::BIGINT AS n FROM (SELECT unnest([bucket, 'ALL']) AS b, kind, name, n FROM c) GROUP BY ALL""")
def manifest_counters(spark, sf_dir):
    """Counts of a measurement by era: filings, outcomes, backends, flags and rows. Pages with a table of their own, which
    only extraction could judge, are not part of it."""
    holders = render.html_holders(render.holders(table(spark, sf_dir, "supplier"))).select(F.col("filing_id").alias("path"), F.to_date(F.lit("1996-05-01")).alias("filing_date"), F.encode("text", "UTF-8").alias("content"))
    html = F.when(F.col("page_id") % 4 == 1, F.concat("html", F.lit("\n\n\n<p>Percent of Class</p>"))).when(F.col("page_id") % 4 > 1, F.col("html"))
    plain = table(spark, sf_dir, "pages").where(~F.lower("html").rlike("beneficial owner|percent of class|beneficially owned|<table"))
    pages = plain.select(F.col("page_id").cast("string").alias("path"), F.to_date(F.lit("2012-04-01")).alias("filing_date"), F.encode(html, "UTF-8").alias("content"))
    return quality.counters(quality.manifest(holders.unionByName(pages), "ownership"))


@query("""
SELECT bucket, flag, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, flag) AS rank FROM (SELECT user_id % 7 AS bucket, event_type AS flag, count(*) AS n FROM events GROUP BY 1, 2)) WHERE rank <= 3""")
def top_flags(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("bucket"), F.col("event_type").alias("flag"))
    return quality.top_flags(rows, "bucket", "flag", 3).withColumn("rank", F.col("rank").cast("bigint"))


@query("""
SELECT event_id, CASE event_type WHEN 'error' THEN 'era_mismatch' ELSE '' END AS review, CASE event_type WHEN 'view' THEN 'sgml_source' ELSE '' END AS provenance, CASE WHEN event_type IN ('error', 'view') THEN '' ELSE 'no_table_found' END AS other, event_type = 'error' AS needs_review FROM events""")
def flag_partition(spark, sf_dir):
    flag = F.when(F.col("event_type") == "error", "era_mismatch").when(F.col("event_type") == "view", "sgml_source").otherwise("no_table_found")
    rows = table(spark, sf_dir, "events").select("event_id", *partition_flags(F.array(flag)))
    return rows.select("event_id", *(F.array_join(f"{c}_flags", ",").alias(c) for c in ("review", "provenance", "other")), "needs_review")


@query(f"SELECT filing_id, count(DISTINCT person) AS people FROM ({PAY}) GROUP BY 1")
def distinct_identities(spark, sf_dir):
    cells = facts(extract(render.html_pay(render.pay(table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"))), "sct"))
    return cells.where(F.col("role") == "name").groupBy("filing_id").agg(F.count_distinct(F.nullif("value", F.lit(""))).alias("people"))


# --- limits and caches over time

_ORDERED = "SELECT *, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events"


@query(f"""
WITH RECURSIVE e AS ({_ORDERED}), s AS (
  SELECT user_id, event_id, rn, true AS allowed, [t] AS hits FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.rn, len(list_filter(s.hits, lambda h: h > e.t - 200000000000)) < 2,
         CASE WHEN len(list_filter(s.hits, lambda h: h > e.t - 200000000000)) < 2 THEN list_append(list_filter(s.hits, lambda h: h > e.t - 200000000000), e.t) ELSE list_filter(s.hits, lambda h: h > e.t - 200000000000) END
  FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)
SELECT event_id, allowed, CASE WHEN allowed THEN 2 - len(hits) ELSE 0 END AS remaining FROM s""")
def sliding_limit(spark, sf_dir):
    return limits.sliding_limit(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", limit=2, window_s=200_000).select("event_id", "allowed", F.col("remaining").cast("bigint").alias("remaining"))


@query(f"""
WITH RECURSIVE e AS ({_ORDERED}), s AS (
  SELECT user_id, event_id, rn, t, t AS sent FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.event_id, e.rn, e.t, greatest(e.t, s.sent + 100000000000) FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)
SELECT event_id, sent AS sent_us, sent - t AS waited_us FROM s""")
def token_bucket(spark, sf_dir):
    return limits.token_bucket(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", rate=1e-5)


@query(f"""
WITH RECURSIVE e AS ({_ORDERED}), s AS (
  SELECT user_id, event_id, rn, t AS put, false AS hit FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN e.t - s.put <= 86400000000 THEN s.put ELSE e.t END, e.t - s.put <= 86400000000 FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)
SELECT event_id, hit FROM s""")
def ttl_cache(spark, sf_dir):
    return limits.ttl_cache(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")


@query("""
SELECT user_id, max(open)::BIGINT AS peak FROM (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS open FROM (
  SELECT user_id, ts AS t, 1 AS d FROM events UNION ALL SELECT user_id, ts + INTERVAL 2 DAY, -1 FROM events)) GROUP BY 1""")
def in_flight(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("end", F.col("ts") + F.expr("INTERVAL 2 DAYS"))
    return limits.in_flight(rows, "ts", "end", "user_id")


# --- windows over event time (batch twins of the streaming queries)


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


@query("""
SELECT epoch_us(w) // 1000000 AS start_s, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS w FROM events) GROUP BY 1""")
def sliding_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("start_s"), "n")


@query("""
SELECT user_id, min(t) AS start_us, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT *, epoch_us(ts) AS t, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def session_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.unix_micros(F.col("w.start").cast("timestamp")).alias("start_us"), "n")


# --- documents as a viewer, a cache and a client see them


@query("""
SELECT item_id AS id, contains(lower(text), 'beneficial owner') OR contains(lower(text), 'percent of class') OR contains(lower(text), 'beneficially owned') AS evidence FROM (
  SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text || ' Percent of CLASS' ELSE text END AS text FROM benchmark)""")
def table_evidence(spark, sf_dir):
    text = F.when(F.col("item_id") % 2 == 0, F.concat("text", F.lit(" Percent of CLASS"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), S.contains_evidence(text, "beneficial_ownership").alias("evidence"))


@query(r"""
SELECT page_id, regexp_matches(left(lower(html), 8192), '<html|<!doctype html|<body|<div|<font|<span|<p[\s>]|<t[dr][\s>]') AS is_html, left(sha256(html), 16) AS hash FROM pages""")
def page_kinds(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.looks_like_html(F.col("html")).alias("is_html"), S.content_hash(F.col("html")).alias("hash"))


@query("""
SELECT o_orderkey, 'C' || o_custkey || '/DEF_14A/' || o_orderdate::DATE || '_DEF_14A_t' || o_orderkey || '.htm' AS path FROM orders""")
def cache_paths(spark, sf_dir):
    path = S.cache_path(F.concat(F.lit("c"), "o_custkey"), F.lit("DEF 14A"), F.to_date("o_orderdate"), F.concat(F.lit("t"), "o_orderkey"), F.lit("htm"))
    return table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"))


@query("""
SELECT o_orderkey, CASE WHEN NOT (status IN (403, 429) OR status >= 500) OR attempt >= 4 THEN NULL WHEN k % 4 = 1 THEN (k % 50)::DOUBLE WHEN k % 4 = 2 THEN 0.0 ELSE 2.0 ** attempt END AS wait FROM (
  SELECT o_orderkey, o_orderkey AS k, [200, 403, 404, 429, 500, 503][o_orderkey % 6 + 1] AS status, (o_orderkey // 6) % 6 AS attempt FROM orders)""")
def retry_waits(spark, sf_dir):
    """How long to wait for a busy archive: as it says (never less than nothing), else twice as long each time."""
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, (200, 403, 404, 429, 500, 503))), (k % 6 + 1).cast("int"))
    says = F.when(k % 4 == 1, (k % 50).cast("string")).when(k % 4 == 2, F.lit("-5")).when(k % 4 == 3, F.lit("soon"))
    wait = S.retry_wait(status, F.floor(k / 6) % 6, says)
    return table(spark, sf_dir, "orders").select("o_orderkey", wait.cast("double").alias("wait"))


@query("""
SELECT c_custkey, [NULL, NULL, 'email', 'email', 'ticker', 'ticker', 'year', 'year', 'form', NULL][c_custkey % 10 + 1] AS bad FROM customer""")
def request_checks(spark, sf_dir):
    """Requests, and the first of their fields that cannot be used."""
    k = F.col("c_custkey")
    of = lambda default, **other: F.coalesce(*(F.when(k % 10 == int(i[1:]), v) for i, v in other.items()), default)
    mail = F.concat(F.lit("c"), k.cast("string"), F.lit("@example.com"))
    email = of(mail, _2=F.replace(mail, F.lit("@"), F.lit("")), _3=F.concat(F.lpad(k.cast("string"), 250, "x"), F.lit("@x.com")))
    ticker = of(F.concat(F.lit("t"), (k % 1000).cast("string")), _4=k.cast("string"), _5=F.lit("TOOLONGATICKER"), _9=F.lit("brk.b"))
    year = of((k % 100 + 1994).cast("string"), _6=F.lit("20x3"), _7=F.lit("1901"), _9=F.lit(" 1999 "))
    form = of(F.lit("DEF 14A"), _1=F.lit("def 14a"), _8=F.lit("10-K"), _9=F.lit(""))
    return table(spark, sf_dir, "customer").select("c_custkey", S.valid_request(email, ticker, year, form).alias("bad"))


@query("""
SELECT page_id, CASE page_id % 6 WHEN 0 THEN true WHEN 3 THEN true ELSE false END AS allowed FROM pages""")
def fetchable_urls(spark, sf_dir):
    """Documents and history files of the archive over https; other hosts, schemes, folders and hosts that hide behind a name are not."""
    k = F.col("page_id").cast("string")
    made = F.array(
        F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), k, F.lit("/a.txt")), F.concat(F.lit("http://www.sec.gov/Archives/"), k), F.concat(F.lit("https://www.sec.gov@evil.example/Archives/"), k),
        F.concat(F.lit("https://data.sec.gov/submissions/CIK"), k, F.lit(".json")), F.concat(F.lit("https://www.sec.gov/cgi-bin/"), k), F.concat(F.lit("https://evil.example/Archives/"), k),
    )
    return table(spark, sf_dir, "pages").select("page_id", S.fetchable(F.element_at(made, (F.col("page_id") % 6 + 1).cast("int"))).alias("allowed"))


@query("SELECT user_id, event_type, count(*) AS n, json_object('user', user_id, 'type', event_type)::VARCHAR AS js FROM events GROUP BY 1, 2")
def json_rows(spark, sf_dir):
    """Results as JSON."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("js", F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type"))))
