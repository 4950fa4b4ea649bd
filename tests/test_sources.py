"""Sources in two steps, the cache, history files, measurements of a corpus and in-flight counts."""

import dataclasses
import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from filingloom import profiles
from filingloom.operators import assemble, limits, quality
from filingloom.plans import extract as E
from filingloom.sources import archive as A
from filingloom.sources import filings as S

DAY = datetime.date(2003, 4, 1)
PAGE = "<html><body><table><tr><th>Name and Principal Position</th><th>Year</th><th>Salary ($)</th></tr><tr><td>Ann Lee<br>President</td><td>2002</td><td>100,000</td></tr></table></body></html>"


def documents(spark, rows):
    return spark.createDataFrame(rows, "ticker string, form string, filing_date date, suffix string, token string, content binary")


def test_archive_is_written_listed_and_read(spark, tmp_path):
    rows = [("abc", "DEF 14A", DAY, "htm", "t1", b"one"), ("abc", "DEF 14A", DAY, "txt", "t2", b"two\xff"), ("xyz", "10-K", datetime.date(2004, 5, 6), "html", "t3", b"three"), ("xyz", "10-K", DAY, "html", "t4", b""), ("xyz", "10-K", DAY, "html", "t5", None)]
    root = str(tmp_path / "archive")
    for _ in range(2):  # writing again changes nothing
        written = {r.locator.removeprefix(root): r.bytes for r in A.write_archive(documents(spark, rows), root).collect()}
    assert written == {"/ABC/DEF_14A/2003-04-01_DEF_14A_t1.htm": 3, "/ABC/DEF_14A/2003-04-01_DEF_14A_t2.txt": 4, "/XYZ/10-K/2004-05-06_10-K_t3.html": 5}
    assert not list(tmp_path.rglob("*.part"))
    assert {(r.ticker, r.form, str(r.filing_date), bytes(r.content)) for r in S.scan(spark, root).collect()} == {("ABC", "DEF 14A", "2003-04-01", b"one"), ("ABC", "DEF 14A", "2003-04-01", b"two\xff"), ("XYZ", "10-K", "2004-05-06", b"three")}
    source = A.ArchiveSource(spark, root)
    listing = source.list(forms=["def_14a"], years=[2003])
    assert "content" not in listing.columns
    assert sorted(bytes(r.content) for r in source.read(listing).collect()) == [b"one", b"two\xff"]
    assert source.list(tickers=["xyz"], years=[2003]).count() == 0 and source.list(tickers=["xyz"]).count() == 1
    gone = spark.createDataFrame([(f"{root}/none.htm",)], "locator string")
    assert A.read_documents(gone).first().content is None


def test_reading_through_the_cache(spark, tmp_path):
    source, cache = A.ArchiveSource(spark, str(tmp_path / "s")), A.ArchiveSource(spark, str(tmp_path / "c"))
    rows = [("abc", "DEF 14A", DAY, "htm", f"t{i}", f"from source {i}".encode()) for i in range(4)]
    A.write_archive(documents(spark, rows), source.root).count()
    A.write_archive(documents(spark, [(*rows[1][:5], b"from cache 1"), ("old", "DEF 14A", DAY, "htm", "t9", b"other")]), cache.root).count()
    (tmp_path / "c" / "ABC" / "DEF_14A" / "2003-04-01_DEF_14A.htm").write_bytes(b"a name without a token is passed over")
    wanted = source.list().withColumn("token", F.regexp_extract("locator", r"_(t\d+)\.htm$", 1))
    got = {r.token: (bytes(r.content).decode(), r.from_cache) for r in A.through_cache(wanted, cache, source).collect()}
    assert got == {f"t{i}": ("from cache 1", True) if i == 1 else (f"from source {i}", False) for i in range(4)}


def test_default_cache(monkeypatch):
    monkeypatch.setenv("HOME", "/h")
    for name in ("FILINGLOOM_CACHE", "XDG_CACHE_HOME"):
        monkeypatch.delenv(name, raising=False)
    assert A.default_cache() == "/h/.cache/filingloom"
    monkeypatch.setenv("XDG_CACHE_HOME", "/x")
    assert A.default_cache() == "/x/filingloom"
    monkeypatch.setenv("FILINGLOOM_CACHE", "/own")
    assert A.default_cache() == "/own"


def test_history_source_reads_a_mirror(spark, tmp_path):
    (tmp_path / "320193").mkdir()
    (tmp_path / "320193" / "0000320193-97-000001.txt").write_bytes(b"whole submission")
    rows = [("AAPL", "0000320193", "DEF 14A", datetime.date(1997, 1, 2), "0000320193-97-000001", "p.htm"), ("AAPL", "0000320193", "10-K", datetime.date(1998, 1, 2), "x", ""), ("AAPL", "0000320193", "DEF 14A", DAY, "", "p.htm")]
    source = A.HistorySource(spark.createDataFrame(rows, "ticker string, cik string, form string, filing_date date, accession string, document string"), str(tmp_path))
    assert [bytes(r.content) for r in source.read(source.list(forms=["def 14a"])).collect()] == [b"whole submission"]


def test_history_over_pages(spark):
    page = {"form": ["DEF 14A"], "filingDate": ["2001-01-01"], "accessionNumber": ["b"], "primaryDocument": ["d"]}
    main = [(1, json.dumps({"filings": {"recent": page | {"accessionNumber": ["a"]}, "files": [{"name": "x"}, {"name": "gone"}, {"name": "bad"}]}})), (2, "{"), (3, None)]
    files = [("x", json.dumps(page)), ("bad", "{"), ("unasked", json.dumps(page))]
    got = S.full_history(spark.createDataFrame(main, "cik int, json string"), spark.createDataFrame(files, "name string, json string"))
    assert sorted((r.cik, r.accession) for r in got.collect()) == [(1, "a"), (1, "b")]


def test_manifest_counts_crashes_and_unreadable_files(spark, tmp_path, monkeypatch):
    read = E.read_table

    def failing(best, era, profile, normalize, into_rows):
        if best and any("crash" in c for row in best["grid"] for c in row):
            raise ZeroDivisionError("told by its name")
        return read(best, era, profile, normalize, into_rows)

    monkeypatch.setattr(E, "read_table", failing)
    rows = [("a", DAY, PAGE.encode()), ("b", DAY, None), ("c", DAY, PAGE.replace("Ann", "crash").encode()), ("d", DAY, b"<html><body>nothing</body></html>"), ("e", DAY, b"<html><body>Name and Principal Position</body></html>"), ("f", None, PAGE.encode())]
    filed = quality.manifest(spark.createDataFrame(rows, "path string, filing_date date, content binary"), "sct")
    got = {r.path: r for r in filed.collect()}
    assert {k: r.outcome for k, r in got.items()} == {"a": "strict", "b": "unreadable", "c": "crashed", "d": "table_absent", "e": "missed", "f": "strict"}
    assert (got["a"].rows, got["a"].backend, got["a"].bytes, got["c"].flags, got["b"].sha256) == (1, "dom", len(PAGE), ["exception:ZeroDivisionError"], None)
    counts = {(r.bucket, r.kind, r.name): r.n for r in quality.counters(filed).collect()}
    assert counts["2001-2005", "filings", "filings"] == 5 and counts["ALL", "outcome", "strict"] == 2 and counts["ALL", "rows", "rows"] == 2
    assert counts["ALL", "flag", "exception:ZeroDivisionError"] == 1 and counts["ALL", "backend", "dom"] == 2
    quality.write_manifest(filed, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/filings").count() == 6
    assert spark.read.json(f"{tmp_path}/fingerprint").first().files == 6


def test_without_an_error_column_a_crash_fails_the_job(spark, monkeypatch):
    def failing(*_, **__):
        raise ZeroDivisionError

    monkeypatch.setattr(E, "read_table", failing)
    found = E.extract(spark.createDataFrame([(DAY, PAGE)], "filing_date date, text string"), "sct")
    try:
        found.collect()
    except Exception as e:
        assert "ZeroDivisionError" in str(e)
    else:
        raise AssertionError("it passed")


def test_in_flight_over_slots(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), s := rng.randrange(2000), s + rng.randrange(1, 900)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, s long, e long").select("k", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("e").alias("e"))
    want = {k: max(sum(s <= t < e for kk, s, e in rows if kk == k) for t in range(3000)) for k in ("a", "b", None)}
    for slot in (1, 60, 10_000):
        assert {r.k: r.peak for r in limits.in_flight(df, "s", "e", "k", slot).collect()} == want


def test_a_document_that_takes_too_long_is_told(spark, monkeypatch):
    read = E.read_table

    def slow(best, era, profile, normalize, into_rows):
        while best and "slow" in str(best["grid"]):
            pass
        return read(best, era, profile, normalize, into_rows)

    monkeypatch.setattr(E, "read_table", slow)
    rows = [("a", DAY, PAGE.encode()), ("b", DAY, PAGE.replace("Ann", "slow").encode())]
    filed = quality.manifest(spark.createDataFrame(rows, "path string, filing_date date, content binary"), "sct", limit_s=0.5)
    assert {r.path: (r.outcome, r.flags) for r in filed.collect()} == {"a": ("strict", []), "b": ("crashed", ["exception:TimeoutError"])}


def test_profiles_and_assemblies_of_ones_own(spark):
    """A profile and an assembly that are registered on the driver work on the executors."""
    assemble.register_assembly("shouting", lambda columns: [dataclasses.replace(c, values=[v.upper() for v in c.values]) for c in columns])
    own = dataclasses.replace(profiles.SUMMARY, name="shouted_pay", assembly="shouting")
    profiles.register_profile(own, "shout")
    r = E.extract(spark.createDataFrame([(DAY, PAGE)], "filing_date date, text string"), "SHOUT").first()
    assert r.rows[0][0] == "ANN LEE\nPRESIDENT" and "shouted_pay" in profiles.available_tables()
    for again in (lambda: profiles.register_profile(dataclasses.replace(own), "shout"), lambda: assemble.register_assembly("shouting", lambda columns: columns)):
        with pytest.raises(ValueError, match="exists"):
            again()
    del profiles.PROFILES["shouted_pay"], profiles.ALIASES["shout"], assemble.ASSEMBLIES["shouting"]
