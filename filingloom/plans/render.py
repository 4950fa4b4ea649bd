"""Filings rendered from relational tables, in all three encodings, so that extraction has a SQL twin.

Documents are strings built by expressions; a filing has at most ``ROWS`` rows, so groups of any size are spread over as
many filings as they need. A text scan captures a bounded number of lines: where a row takes several, ``parted`` deals a
filing's rows to documents of the same id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 100
#: Rows of three lines in a document: with its header well under scan_text.CAPTURE.
TALL_ROWS = 60
OWNERS = ("NAME AND ADDRESS OF", "AMOUNT AND NATURE OF", "PERCENT"), ("BENEFICIAL OWNER", "BENEFICIAL OWNERSHIP", "OF CLASS")
TITLE = "SECURITY OWNERSHIP OF MANAGEMENT"


def holders(supplier: DataFrame, least: int = 2) -> DataFrame:
    """(filing_id, pos, holder, shares, pct): suppliers as holders, with their share of the document in hundredths of a percent.

    A nation's suppliers stand in documents of ``ROWS``; one that would be left over alone joins the document before, and
    the only suppliers of their nations stand together as nation 99. least: rows that a document must have; text windows
    need two, which only the one lone supplier of a whole table has not.
    """
    nation = Window.partitionBy("s_nationkey")
    rows = supplier.withColumn("g", F.when(F.count(F.lit(1)).over(nation) == 1, F.lit(99)).otherwise(F.col("s_nationkey")))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("s_suppkey")) - 1).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("g")))
    rows = rows.withColumn("shares", F.round(F.abs("s_acctbal") * 100).cast("bigint") + 1)
    rows = rows.withColumn("filing_id", F.format_string("N%02d-%04d", F.col("g").cast("int"), F.expr(f"least(rn div {ROWS}, greatest(of - 2, 0) div {ROWS})")))
    doc = Window.partitionBy("filing_id")
    rows = rows.withColumn("total", F.sum("shares").over(doc)).withColumn("n", F.count(F.lit(1)).over(doc)).where(F.col("n") >= least)
    return rows.select("filing_id", F.col("rn").alias("pos"), F.col("s_name").alias("holder"), "shares", F.expr("shares * 10000 div total").alias("pct"))


def parted(rows: DataFrame, most: int) -> DataFrame:
    """part: the document of its filing that a row stands in; a document has at most ``most`` rows, and a filing's documents differ by one row at most."""
    w = Window.partitionBy("filing_id")
    rows = rows.withColumn("at", F.row_number().over(w.orderBy("pos")) - 1).withColumn("of", F.count(F.lit(1)).over(w))
    return rows.withColumn("part", F.expr(f"at * ceil(of / {most}) div of")).drop("at", "of")


def percent_text(pct: Column) -> Column:
    return F.format_string("%d.%02d%%", F.expr("pct div 100"), F.expr("pct % 100"))


def documents(rows: DataFrame, line: Column, before: str, after: str, filed: str = "1996-05-01", between: str = "\n") -> DataFrame:
    """One document for each filing_id, and part if rows have one: its rows' lines in order between ``before`` and ``after``."""
    keys = [c for c in ("filing_id", "part") if c in rows.columns]
    lines = rows.select(*keys, F.struct("pos", line.alias("line")).alias("l")).groupBy(*keys).agg(F.array_sort(F.collect_list("l")).alias("ls"))
    text = F.concat(F.lit(before), F.array_join(F.transform("ls", lambda x: x["line"]), between), F.lit(after))
    return lines.select("filing_id", F.lit(filed).cast("date").alias("filing_date"), text.alias("text"))


def _ascii(name: Column, shares: Column, pct: Column) -> Column:
    return F.concat(F.rpad(name, 31, " "), F.lpad(shares, 20, " "), F.lit(" " * 6), F.lpad(pct, 8, " "))


ASCII_HEAD = "\n".join(
    [TITLE, "", "", "", *(f"{a:<31}{b:<26}{c}".rstrip() for a, b, c in OWNERS), f"{'-' * 28:<31}{'-' * 20:<26}{'-' * 8}", ""]
)


def ascii_holders(rows: DataFrame, extra: Column | None = None, head: str = ASCII_HEAD) -> DataFrame:
    """extra: lines that follow each row's first."""
    line = _ascii(F.col("holder"), F.format_number("shares", 0), percent_text(F.col("pct")))
    return documents(rows, line if extra is None else F.concat(line, F.lit("\n"), extra), head, "\n")


def html_holders(rows: DataFrame, head: str = "") -> DataFrame:
    """The percent sign stands in a column of its own, and the header spans both."""
    cells = F.concat(
        F.lit("<tr><td>"), F.col("holder"), F.lit('</td><td align="right">'), F.format_number("shares", 0), F.lit("</td><td>"), F.format_string("%d.%02d", F.expr("pct div 100"), F.expr("pct % 100")), F.lit("</td><td>%</td></tr>")
    )
    top = f"<html><body><p>{TITLE}</p>{head}<table><tr><th>Name and Address of Beneficial Owner</th><th>Amount and Nature of<br>Beneficial Ownership</th><th>Percent of Class</th><th></th></tr>"
    return documents(rows, cells, top, "</table></body></html>", filed="2015-04-01")


def sgml_holders(rows: DataFrame) -> DataFrame:
    cells = F.concat(F.lit("<TR><TD>"), F.col("holder"), F.lit("<TD>"), F.format_number("shares", 0), F.lit("<TD>"), percent_text(F.col("pct")))
    top = f"{TITLE}\n\n<TABLE>\n<TR><TH>Name of Beneficial Owner<TH>Amount and Nature of Beneficial Ownership<TH>Percent of Class\n"
    return documents(rows, cells, top, "\n<FN>\n(1) Includes shares held in trust.\n</FN>\n</TABLE>\n", filed="1997-05-01")


def pay(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    """(filing_id, person, year, salary, bonus): parts as people, a document for each brand."""
    lines = lineitem.join(part, lineitem["l_partkey"] == part["p_partkey"])
    return lines.groupBy(F.col("p_brand").alias("filing_id"), F.initcap("p_name").alias("person"), F.year("l_shipdate").alias("year")).agg(
        F.sum(F.floor("l_extendedprice")).cast("bigint").alias("salary"), F.sum("l_quantity").cast("bigint").alias("bonus")
    )


PAY_HEAD = "<html><body><p>SUMMARY COMPENSATION TABLE</p><table><tr><th>Name and Principal Position</th><th>Year</th><th>Salary ($)</th><th>Bonus ($)</th></tr>"


def html_pay(rows: DataFrame, filed: str = "2002-04-01", title: str = "<br>Vice President") -> DataFrame:
    """A row for each person and year; the person's name and title stand in the first."""
    first = F.row_number().over(Window.partitionBy("filing_id", "person").orderBy("year")) == 1
    rows = rows.withColumn("first", first).withColumn("pos", F.struct("person", "year"))
    who = F.when(F.col("first"), F.concat("person", F.lit(title))).otherwise("")
    cells = F.concat(F.lit("<tr><td>"), who, F.lit("</td><td>"), F.col("year").cast("string"), F.lit("</td><td>$ "), F.format_number("salary", 0), F.lit("</td><td>"), F.format_number("bonus", 0), F.lit("</td></tr>"))
    return documents(rows, cells, PAY_HEAD, "</table></body></html>", filed)


def stacked_pay(rows: DataFrame, filed: str = "2003-04-01") -> DataFrame:
    """A row for each person, the years stacked in its cells."""
    people = rows.groupBy("filing_id", "person").agg(F.array_sort(F.collect_list(F.struct((-F.col("year")).alias("back"), "year", "salary", "bonus"))).alias("ys"))
    stack = lambda f: F.array_join(F.transform("ys", f), "<br>")
    cells = F.concat(
        F.lit("<tr><td>"), F.col("person"), F.lit("<br>Vice President</td><td>"), stack(lambda y: y["year"].cast("string")), F.lit("</td><td>"), stack(lambda y: F.format_number(y["salary"], 0)), F.lit("</td><td>"),
        stack(lambda y: F.format_number(y["bonus"], 0)), F.lit("</td></tr>"),
    )
    return documents(people.withColumn("pos", F.col("person")), cells, PAY_HEAD, "</table></body></html>", filed)


def director_fees(rows: DataFrame, filed: str = "2010-04-01") -> DataFrame:
    """Directors of one year: fees, awards and their total."""
    people = rows.groupBy("filing_id", "person").agg(F.sum("bonus").alias("fees"), F.sum(F.col("salary") % 100_000).alias("awards"))
    cells = F.concat(
        F.lit("<tr><td>"), F.col("person"), F.lit("</td><td>"), F.format_number("fees", 0), F.lit("</td><td>"), F.format_number("awards", 0), F.lit("</td><td>"), F.format_number(F.col("fees") + F.col("awards"), 0), F.lit("</td></tr>")
    )
    head = "<html><body><p>DIRECTOR COMPENSATION</p><table><tr><th>Name</th><th>Fees Earned or<br>Paid in Cash ($)</th><th>Stock Awards ($)</th><th>Total ($)</th></tr>"
    return documents(people.withColumn("pos", F.col("person")), cells, head, "</table></body></html>", filed)
