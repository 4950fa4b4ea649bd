"""The engine on small documents written by hand, its native functions against their Python twins, and round trips."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from filingloom import cli, profiles
from filingloom.functions import roles as R
from filingloom.functions import text as T
from filingloom.operators import assemble, grids, quality, scan_html, scan_text
from filingloom.plans.extract import FLAGS, candidates, extract, facts, wide
from filingloom.sources import filings as S
from filingloom.streaming import ingest


def filing(spark, text, date="2003-03-24", name="f"):
    when = datetime.date.fromisoformat(date) if date else None
    kind = "binary" if isinstance(text, bytes) else "string"
    return spark.createDataFrame([(name, when, text)], f"filing_id string, filing_date date, {'content' if kind == 'binary' else 'text'} {kind}")


def one(spark, text, profile="sct", date="2003-03-24", **options):
    return extract(filing(spark, text, date), profile, **options).first()


RULED = """

                    SUMMARY COMPENSATION TABLE

                                        ANNUAL COMPENSATION
                                     --------------------------
NAME AND                               SALARY         BONUS
PRINCIPAL POSITION            YEAR      ($)            ($)
- - ----------------            ----   -----------    -----------
Anna B. Clark.............    1996     500,000        120,000
Chairman of the Board and     1995     450,000         --
Chief Executive Officer       1994     400,000         90,000
Carl D. Evans, Jr.            1996     300,000         50,000
Vice President                1995     280,000         45,000



SECURITY OWNERSHIP
"""

STACKED = """<?xml version="1.0" encoding="utf-8"?>
<html><body><p>Summary Compensation Table</p>
<table><tr><td>Name and<br>Principal Position</td><td>Fiscal Year</td><td>Salary ($)</td><td>Bonus ($)</td></tr>
<tr><td>Anna B. Clark<br>Chief Executive Officer</td><td>2002<br>2001<br>2000</td><td>500,000<br>450,000<br>400,000</td><td>120,000<br><br>90,000</td></tr></table></body></html>"""

OWNERS = """SECURITY OWNERSHIP OF MANAGEMENT


Title of      Name and Address of               Amount and Nature of     Percent
 Class         Beneficial Owner                 Beneficial Ownership     of Class
--------      ----------------------------      --------------------     --------
Common        Clark Partners, Inc.(1)                    13,552,054        12.8%
              and Subsidiaries
              82 Devon Street
              Boston, MA  02109
              Named Trusts:
Common        Evans Trust                                 6,904,354         6.5%
Common        All directors as a group                   20,000,000        19.0%
"""


def test_ruled_text(spark):
    r = one(spark, RULED, date="1996-10-01")
    assert r.ok and (r.backend, r.era, r.flags) == ("ascii", "pre2006", ["ascii_source"])
    assert r.roles == ["name", "position", "year", "salary", "bonus"]
    title = "Chairman of the Board and Chief Executive Officer"
    assert r.rows == [
        ["Anna B. Clark", title, "1996", "500000", "120000"], ["Anna B. Clark", title, "1995", "450000", ""], ["Anna B. Clark", title, "1994", "400000", "90000"],
        ["Carl D. Evans, Jr.", "Vice President", "1996", "300000", "50000"], ["Carl D. Evans, Jr.", "Vice President", "1995", "280000", "45000"],
    ]


def test_stacked_years_and_bytes(spark):
    r = one(spark, STACKED)
    assert [x[2:] for x in r.rows] == [["2002", "500000", "120000"], ["2001", "450000", ""], ["2000", "400000", "90000"]]
    assert r.flags == [] and r.rows[0][:2] == ["Anna B. Clark", "Chief Executive Officer"]
    assert one(spark, STACKED.encode()).rows == r.rows
    assert one(spark, STACKED.replace("Anna", "Ännä").encode("latin-1")).rows[0][0] == "Ännä B. Clark"


def test_holders(spark):
    r = one(spark, OWNERS, "ownership", "1997-05-01")
    assert r.roles == ["holder_name", "holder_address", "section", "is_group", "share_class", "shares", "percent"]
    assert r.rows == [
        ["Clark Partners, Inc.(1) and Subsidiaries", "82 Devon Street Boston, MA 02109", "", "0", "Common", "13552054", "12.8"],
        ["Evans Trust", "", "Named Trusts", "0", "Common", "6904354", "6.5"], ["All directors as a group", "", "Named Trusts", "1", "Common", "20000000", "19.0"],
    ]
    assert r.flags == ["ascii_source"] and r.margin is None


def test_flags(spark):
    assert one(spark, "nothing here", date=None).flags == ["no_filing_date", "no_table_found"]
    assert one(spark, "", "director", "1999-01-01").flags == ["predates_mandate", "no_table_found"]
    low = one(spark, "<html><body><table><tr><td>a</td></tr></table></body></html>", "ownership")
    assert low.flags == ["no_table_found", "below_score_threshold"] and low.top_score == -999 and not low.ok
    late = one(spark, STACKED.replace("Bonus ($)", "LTIP Payouts"), date="2010-05-01")
    assert "era_mismatch" in late.flags and late.era == "pre2006" and late.era_from_columns == "pre2006"
    assert one(spark, STACKED, date="2010-05-01").missing_roles == ["total"]
    assert [f for f in FLAGS if f in late.flags] == late.flags


def test_two_tables_of_one_score(spark):
    table = STACKED[STACKED.index("<table>") : STACKED.index("</body>")]
    twice = STACKED.replace("</body>", f"<p>Summary Compensation Table</p>{table}</body>")
    assert "ambiguous_selection" not in one(spark, twice).flags
    other = STACKED.replace("</body>", f"<p>Summary Compensation Table</p>{table.replace('Anna', 'Otto')}</body>")
    assert "ambiguous_selection" in one(spark, other).flags
    assert [r.rank for r in candidates(filing(spark, other), "sct").collect()] == [1, 2, 3, 4]


def test_switches(spark):
    raw = one(spark, STACKED, normalize_numbers=False, assemble_rows=False)
    assert raw.roles[0] == "name_and_position" and raw.rows[0][2] == "500,000"
    cells = facts(extract(filing(spark, STACKED), "sct")).where(F.col("role") == "bonus").orderBy("row_ix").collect()
    assert [(c.value, c.value_num and int(c.value_num)) for c in cells] == [("120000", 120000), ("", None), ("90000", 90000)]
    assert wide(extract(filing(spark, STACKED), "sct"), "sct", roles=["name", "salary", "total"]).first().asDict()["extra"] == {"position": "Chief Executive Officer", "year": "2002", "bonus": "120000"}


def test_grid_spans_and_nesting():
    root = scan_html.parse('<table><tr><td rowspan=2>a<td colspan="2">b<tr><td>c<td>d<table><tr><td>in</table></td><tr><td colspan=x>e<tr><td colspan="999999999">f</table>')
    tables = root.find_all("table")
    assert len(tables) == 2
    grid = scan_html.grid(tables[0])
    assert grid[0][:3] == ["a", "b", "b"] and grid[1][:2] == ["a", "c"] and len(grid[-1]) == scan_html.MOST_SPAN
    assert scan_html.cell_text(scan_html.parse("<td>A<br>B<!-- c --> d</td>").children[0]) == "A\nB c d"


def test_text_grids():
    assert grids.ascii_grid("a   b\n1   2\n33  44") == [["a", "b"], ["1", "2"], ["33", "44"]]
    assert grids.sgml_grid("<table><tr><td>x<td>y<tr><td>1</table>") == [["x", "y"], ["1", ""]]
    assert grids.split_header([["Name", "Salary"], ["", "($)"], ["2000", "5"], ["2001", "6"]])[0] == ["Name", "Salary ($)"]
    assert grids.split_header([["x"]]) == (["col_0"], [["x"]])
    assert scan_text.without_notes("<table>a\n<fn>note</table>") == "<table>a\n</table>"


@pytest.mark.parametrize(
    ("cell", "want"),
    [
        ("Roy C. Harvey\nPresident and CEO", ("Roy C. Harvey", "President and CEO")), ("Richard\nP. Dealy", ("Richard P. Dealy", "")), ("D. Christian Koch, Chair, President", ("D. Christian Koch", "Chair, President")),
        ("Michael P. McMasters (7) Chief Executive", ("Michael P. McMasters", "Chief Executive")), ("Tim Cook Chief Executive Officer", ("Tim Cook", "Chief Executive Officer")), ("and Chief Financial Officer", ("", "and Chief Financial Officer")), ("Anna Clark (2)", ("Anna Clark", "")),
    ],
)
def test_names_and_titles(cell, want):
    assert assemble.name_and_title(cell) == want


def test_native_and_python_twins(spark):
    rng = random.Random(1)
    cells = ["".join(rng.choice("(1 2.3,-$%*n/aA)ß— \n") for _ in range(rng.randint(0, 9))) for _ in range(400)]
    cells += ["(1,234)", "N/A", "Not Applicable", "Ronald W. Allen", "Thomas J. Roeck, Jr", "Vice President", "12 Elm Street", "pursuant to", "P.O. Box 5", "Compen- sation ($)(a)", "A | B / C ( )"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    c = F.col("c")
    rows = df.select("c", T.normalize_number(T.nfkc(c)).alias("number"), T.looks_like_person(c).alias("person"), T.looks_like_title(c).alias("title"), T.looks_like_address(c).alias("address"), T.clean_header(T.nfkc(c)).alias("header"), T.is_row_like(c).alias("row"), T.is_heading(c).alias("heading"), T.is_rule_line(c).alias("rule"), T.blank_tags(c).alias("blank")).collect()
    for r in rows:
        assert r.number == assemble.number(r.c), r
        assert r.header == grids.plain_header(r.c), r
        assert (r.person, r.title, r.address) == (assemble.is_person(r.c), assemble.is_title(r.c), assemble.is_address(r.c)), r
        assert (r.heading, r.blank) == (scan_text.is_heading(r.c), scan_text.blank(r.c)), r
        if "\n" not in r.c:
            assert (r.rule, r.row) == (grids.is_rule(r.c), scan_text.row_like(r.c) > 0), r


def test_eras():
    d = datetime.date
    era = profiles.SUMMARY_SCHEMA.era
    assert [era(x) for x in (d(2006, 12, 14), d(2006, 12, 15), d(2007, 12, 31), d(2008, 1, 1), None)] == ["pre2006", "transition", "transition", "post2006", "transition"]
    assert profiles.SUMMARY_SCHEMA.required("transition") == {"name_and_position", "year"}
    assert profiles.SUMMARY_SCHEMA.roles("transition")[:4] == ["name_and_position", "year", "salary", "bonus"] and len(profiles.SUMMARY_SCHEMA.roles("transition")) == 14
    assert profiles.OWNERSHIP_SCHEMA.era(None) == "single"
    with pytest.raises(KeyError):
        profiles.get_profile("nope")


def test_role_marks(spark):
    heads = F.array(*map(F.lit, ["Name", "$", "Salary", "Salary", ""]))
    assert spark.range(1).select(R.infer_roles(heads, profiles.SUMMARY, F.lit("pre2006")).alias("r")).first().r == ["name", "unknown", "salary", "salary_2", "unknown"]


@pytest.mark.parametrize("name", sorted(profiles.PROFILES))
def test_roles_in_columns_and_in_python(spark, name):
    """All known headers, parts of them put together, and eras that the schema has and has not."""
    p = profiles.PROFILES[name]
    rng = random.Random(3)
    texts = [h for q in profiles.PROFILES.values() for h, _ in (*q.exact_headers, *q.header_patterns)] + [f.label for q in profiles.PROFILES.values() for v in q.schema.versions for f in v.fields]
    texts += [" ".join(rng.sample(texts, 2)) for _ in range(60)] + ["", "—", "$", "Compen- sation (a)", "Foo Bar", "?!", "Name", "Title of Class"]
    tables = [[rng.choice(texts) for _ in range(rng.randint(1, 6))] for _ in range(80)]
    rows = [(heads, era) for heads in tables for era in (*p.schema.eras(), "other")]
    reader = R.RoleReader(p)
    df = spark.createDataFrame(rows, "heads array<string>, era string")
    roles = R.infer_roles(F.transform("heads", lambda h: h), p, F.col("era"))
    got = df.select("heads", "era", roles.alias("roles")).withColumn("shown", p.schema.era_of_roles(F.transform("roles", T.base_role))).collect()
    for r in got:
        assert r.roles == reader.roles(r.heads, r.era), r
        assert r.shown == p.schema.era_shown({R.base_of(x) for x in r.roles}), r


def test_spans_under_spans():
    """A cell that reaches below another one, which shows again where that ends; rows shorter than what reaches them."""
    page = "<table><tr><td rowspan=5>a<td rowspan=2>b<td rowspan=4>c<tr><td colspan=3 rowspan=2>d<tr><td>e<tr><td>f<tr><td>g</table>"
    assert scan_html.grid(scan_html.parse(page).find_all("table")[0]) == [["a", "b", "c", "", "", ""], ["a", "b", "c", "d", "d", "d"], ["a", "e", "c", "d", "d", "d"], ["a", "f", "c", "", "", ""], ["a", "g", "", "", "", ""]]


def test_tables_found_by_a_row_are_told_apart_by_markup():
    table = "<table><tr><td>Name<td>principal position<tr><td>A<td>1</table>"
    found = scan_html.candidates(f"<html><body>{table}<p>x</p>{table}{table.replace('<td>A', '<td>B')}", profiles.SUMMARY, True)
    assert [(t.index, t.by_row) for t in found] == [(0, False), (1, False), (2, False), (0, True), (1, True)]


def test_only_tables_that_can_win_are_tabulated():
    page = "<table><tr><td>menu<td>5,000</table><table><tr><td>Name<td>Salary<tr><td>A<td>1</table>"
    menu, pay = scan_html.candidates(f"<html><body>{page}", profiles.SUMMARY, False)
    assert menu.tabulated(profiles.SUMMARY) == [] and pay.tabulated(profiles.SUMMARY) == [["Name", "Salary"], ["A", "1"]]


def test_pages_of_many_rows_are_read_in_linear_time():
    """Twice the rows take about twice the time, not four times."""

    def seconds(n: int) -> float:
        page = "<html><body><table>" + "<tr><td>Name<td>x y</td></tr>" * n + "</table></body></html>"
        began = time.process_time()
        scan_html.candidates(page, profiles.SUMMARY, True)
        return time.process_time() - began

    seconds(500)
    assert seconds(16_000) < 3 * seconds(8_000) + 0.2


def test_column_repairs():
    table = lambda **c: [assemble.Column(k, k, v) for k, v in c.items()]
    names = lambda cs: [(c.role, c.values) for c in cs]
    assert names(assemble.fold_markers(table(salary=["", ""], salary_2=["5", "6"]))) == [("salary", ["5", "6"])]
    assert names(assemble.clean_columns(table(name=["a", " "], bonus=["1", ""]))) == [("name", ["a"]), ("bonus", ["1"])]
    assert [c.role for c in assemble.clean_columns(table(share_class=["5%", "6.1 %"], holder_name=["x", "y"]))] == ["percent", "holder_name"]
    assert [c.role for c in assemble.clean_columns(table(name=["a", "b"], unknown=["(1)", "%"], bonus=["1", "2"], bonus_2=["", ""]))] == ["name", "bonus"]


def test_problems(spark):
    text = STACKED.replace("450,000", "7").replace("2000<", "1950<").replace("Anna B. Clark<br>", "")
    found = quality.problems(extract(filing(spark, text), "sct"), "sct").first()
    assert "salary_implausible" in found.problems
    clean = quality.problems(extract(filing(spark, STACKED), "sct"), "sct").first()
    assert clean.problems == []


@pytest.fixture
def archive(tmp_path):
    for ticker, date, suffix, body in (("ABC", "2003-03-24", "html", STACKED), ("ABC", "1996-10-01", "txt", RULED), ("ABC", "2001-02-30", "txt", RULED), ("XYZ", "2003-01-01", "htm", "no table here"), ("ABC", "2003-03-24", "doc", "x")):
        folder = tmp_path / "root" / ticker / "DEF_14A"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{date}_DEF_14A.{suffix}").write_text(body)
    return tmp_path


def test_scan_and_pick(spark, archive):
    rows = S.scan(spark, str(archive / "root"))
    assert sorted((r.ticker, r.form, str(r.filing_date), r.suffix) for r in rows.drop("content").collect()) == [("ABC", "DEF 14A", "1996-10-01", "txt"), ("ABC", "DEF 14A", "2003-03-24", "html"), ("XYZ", "DEF 14A", "2003-01-01", "htm")]
    assert "content" not in rows.select("ticker", "filing_date")._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    assert S.pick_filing(rows.where("ticker = 'ABC'"), ["ticker"], "earliest").first().suffix == "txt"


def test_stream_equals_batch(spark, archive):
    stream = ingest.extract_stream(ingest.filing_stream(spark, str(archive / "root")), "sct").select("filing_id", "ok", "rows")
    ingest.write_extractions(stream, str(archive / "out"), str(archive / "log")).awaitTermination()
    batch = extract(S.scan(spark, str(archive / "root")).where("bytes > 0"), "sct").select("ok", "rows")
    key = lambda r: str(r.rows)
    assert sorted(map(key, spark.read.parquet(str(archive / "out")).collect())) == sorted(map(key, batch.collect()))


def test_windows_over_a_stream(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{source}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).schema
    events = spark.readStream.schema(spark.read.parquet(f"{source}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))
    q = ingest.tumbling(events).writeStream.format("memory").queryName("tumbling_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = ingest.tumbling(spark.read.parquet(f"{source}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    assert schema and {(r.w.start, r.event_type, r.n) for r in spark.table("tumbling_out").collect()} == {(r.w.start, r.event_type, r.n) for r in batch.collect()}


def test_command_line(spark, archive, capsys):
    root = str(archive / "root")
    assert cli.main(["abc", "--root", root, "--year", "2003"], spark) == 0
    assert capsys.readouterr().out.splitlines()[:2] == ["name,position,year,salary,bonus", "Anna B. Clark,Chief Executive Officer,2002,500000,120000"]
    assert cli.main(["XYZ", "--root", root, "-o", str(archive / "x.csv")], spark) == 1
    assert cli.main(["ABC", "--root", root, "--table", "nope"], spark) == 3
    assert cli.main(["NONE", "--root", root], spark) == 3
    assert cli.main(["ABC", "--root", root, "--year", "2003", "--list"], spark) == 0
    assert cli.main(["--tables"], spark) == 0
    with pytest.raises(SystemExit) as e:
        cli.main(["--what"], spark)
    assert e.value.code == 3


def test_sql_functions(spark):
    from filingloom.plans import sql

    sql.register(spark)
    filing(spark, STACKED, name="h").createOrReplaceTempView("html_filings")
    filing(spark, RULED, name="t").createOrReplaceTempView("text_filings")
    cells = spark.sql("SELECT t.* FROM html_filings f, LATERAL html_cells(f.text) t WHERE t.row_ix = 0 ORDER BY col_ix").collect()
    assert [c.text for c in cells] == ["Name and\nPrincipal Position", "Fiscal Year", "Salary ($)", "Bonus ($)"]
    found = spark.sql("SELECT t.backend FROM text_filings f, LATERAL text_tables(f.text, 'sct') t").collect()
    assert found and {c.backend for c in found} == {"ascii"}
    assert spark.sql("SELECT count(*) AS n FROM schema_fields WHERE profile = 'beneficial_ownership'").first().n == 12


def test_extraction_has_no_shuffle(spark, capsys):
    extract(filing(spark, STACKED), "sct").explain("formatted")
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and plan.count("MapInArrow\n") >= 2
