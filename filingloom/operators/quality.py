"""Plausibility of extractions and how a corpus of them came out, all as expressions and partial sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingloom.functions.text import decode, looks_like_title
from filingloom.plans.extract import extract
from filingloom.profiles import TableProfile, get_profile
from filingloom.sources.filings import contains_evidence, content_hash


def era_bucket(year: Column) -> Column:
    return F.when(year <= 2000, "1994-2000").when(year <= 2005, "2001-2005").when(year <= 2010, "2006-2010").otherwise("2011+")


def _number(cells: Column, role: str) -> Column:
    return F.nullif(F.try_element_at(cells, F.lit(role)), F.lit("")).try_cast("double")


def out_of_bounds(value: Column, low: float, high: float) -> Column:
    return F.coalesce((value != 0) & ~value.between(low, high), F.lit(False))


def sum_mismatch(total: Column, parts: list[Column], tolerance: float = 0.02) -> Column:
    """Whether a stated total differs from its parts by more than the tolerance and by more than 1."""
    whole = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    return F.coalesce((total > 0) & (F.abs(whole - total) > F.greatest(tolerance * total, F.lit(1.0))), F.lit(False))


def year_out_of_range(year: Column, filed_year: Column) -> Column:
    return F.coalesce(~year.between(filed_year - 12, filed_year + 1), F.lit(False))


def problems(extractions: DataFrame, profile: str | TableProfile) -> DataFrame:
    """``extractions`` with problems: which implausibilities their rows show. Read from each row's arrays, no shuffle."""
    p = get_profile(profile)
    maps = F.transform("rows", lambda r: F.map_from_entries(F.filter(F.arrays_zip(F.col("roles").alias("k"), r.alias("v")), lambda x: x["k"].isin(*_used(p)))))
    found: list[Column] = []
    any_row = lambda test: F.coalesce(F.exists(F.col("_cells"), lambda c: test(c)), F.lit(False))
    if p.identity_is_person:
        named = lambda c: F.coalesce(F.try_element_at(c, F.lit(p.identity_role)), F.lit(""))
        found.append(F.when(any_row(lambda c: (F.coalesce(F.try_element_at(c, F.lit("is_group")), F.lit("0")) != "1") & looks_like_title(named(c))), "title_as_name"))
    found.append(F.when(any_row(lambda c: year_out_of_range(_number(c, "year"), F.year("filing_date"))), "year_out_of_range"))
    for role, low, high in p.bounds:
        found.append(F.when(any_row(partial(_beyond, role, low, high)), f"{role}_implausible"))
    if p.total_of:
        total, parts, tolerance = p.total_of
        found.append(F.when(any_row(lambda c: sum_mismatch(_number(c, total), [_number(c, r) for r in parts], tolerance)), "sum_mismatch"))
    return extractions.withColumn("_cells", maps).withColumn("problems", F.filter(F.array(*found), lambda x: x.isNotNull())).drop("_cells")


def _beyond(role: str, low: float, high: float, cells: Column) -> Column:
    return out_of_bounds(_number(cells, role), low, high)


def _used(p: TableProfile) -> list[str]:
    parts = [p.total_of[0], *p.total_of[1]] if p.total_of else []
    return list(dict.fromkeys([p.identity_role, "is_group", "year", *(r for r, _, _ in p.bounds), *parts]))


def outcome(found: Column, evidence: Column, applies: Column, n_problems: Column, n_review: Column, readable: Column | None = None, crashed: Column | None = None) -> Column:
    """unreadable, crashed, not_applicable, table_absent, missed, implausible, clean or strict."""
    no = F.lit(False)
    return (
        F.when(no if readable is None else ~readable, "unreadable").when(no if crashed is None else crashed, "crashed")
        .when(~found & ~applies, "not_applicable").when(~found & ~evidence, "table_absent").when(~found, "missed").when(n_problems > 0, "implausible").when(n_review > 0, "clean").otherwise("strict")
    )


def manifest(filings: DataFrame, profile: str | TableProfile = "summary_compensation", limit_s: float | None = None) -> DataFrame:
    """One row for each filing of a measurement: what it is and what became of it.

    filings: path, filing_date and content, null where it could not be read; further columns stay. A document whose
    extraction raises, or takes longer than limit_s, is told as crashed and flagged by the exception's name. No shuffle.
    """
    p = get_profile(profile)
    facts = {"sha256": content_hash(F.col("content")), "bytes": F.octet_length("content").cast("long"), "readable": F.col("content").isNotNull(), "evidence": F.coalesce(contains_evidence(decode(F.col("content")), p.name), F.lit(False))}
    found = problems(extract(filings.withColumns(facts), p, error="raised", limit_s=limit_s), p)
    crashed = F.col("raised").isNotNull()
    flags = F.when(~F.col("readable"), F.array().cast("array<string>")).when(crashed, F.array(F.concat(F.lit("exception:"), "raised"))).otherwise(F.col("flags"))
    result = outcome(F.col("ok"), F.col("evidence"), ~F.array_contains("flags", "predates_mandate"), F.size("problems"), F.size("review_flags"), F.col("readable"), crashed)
    kept = [c for c in filings.columns if c not in ("content", "filing_date")]
    return found.select(
        *kept, "sha256", "bytes", "filing_date", era_bucket(F.year("filing_date")).alias("bucket"), F.col("ok").alias("extracted"), "backend", F.col("era").alias("schema_era"), flags.alias("flags"),
        F.when(F.col("ok"), F.size("rows")).otherwise(0).cast("long").alias("rows"), result.alias("outcome"), F.when(F.col("ok"), F.col("problems")).otherwise(F.array().cast("array<string>")).alias("problems"), F.array_sort("review_flags").alias("review_flags"),
    )


def counters(filed: DataFrame) -> DataFrame:
    """(bucket, kind, name, n) of a manifest: filings, outcomes, backends, flags, problems and rows by era and, as ALL,
    together. Each row becomes a few counts that are summed partially."""
    kind = "array<struct<kind:string,name:string,n:bigint>>"
    one = lambda kind, name, n=1: F.struct(F.lit(kind).alias("kind"), name.alias("name"), (n if isinstance(n, Column) else F.lit(n)).alias("n"))
    each = lambda kind, names: F.transform(names, lambda x: one(kind, x))
    always = F.array(one("filings", F.lit("filings")), one("outcome", F.col("outcome"))), F.array(one("rows", F.lit("rows"), F.col("rows")))
    backend = F.filter(F.array(one("backend", F.col("backend"))), lambda x: F.col("extracted") & x["name"].isNotNull())
    every = F.concat(*(c.cast(kind) for c in (*always, backend, each("flag", F.col("flags")), each("problem", F.col("problems")))))
    rows = filed.select(F.explode(F.array(F.coalesce("bucket", F.lit("undated")), F.lit("ALL"))).alias("bucket"), every.alias("e"))
    return rows.select("bucket", F.explode("e").alias("c")).groupBy("bucket", "c.kind", "c.name").agg(F.sum("c.n").alias("n"))


def write_manifest(filed: DataFrame, folder: str) -> None:
    """The manifest as JSON lines and, beside it, the fingerprint of the paths that it covers."""
    filed.write.mode("overwrite").json(f"{folder}/filings")
    fingerprint(filed.sparkSession.read.json(f"{folder}/filings"), "path").write.mode("overwrite").json(f"{folder}/fingerprint")


def report(outcomes: DataFrame, bucket: str = "bucket", result: str = "outcome") -> DataFrame:
    """Counts and rates by bucket and for all: yield, clean and strict. ``rollup`` over partial counts."""
    n = lambda *names: F.count_if(F.col(result).isin(*names)).alias(names[0])
    found = F.count_if(F.col(result).isin("strict", "clean", "implausible"))
    available = F.count_if(F.col(result).isin("strict", "clean", "implausible", "missed"))
    clean = F.count_if(F.col(result).isin("strict", "clean"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return outcomes.rollup(bucket).agg(
        F.count(F.lit(1)).alias("n"), n("table_absent"), n("missed"), found.alias("found"), available.alias("available"), rate(found, available).alias("yield_rate"), rate(clean, found).alias("clean_rate"), rate(F.count_if(F.col(result) == "strict"), found).alias("strict_rate")
    ).withColumn(bucket, F.coalesce(bucket, F.lit("ALL")))


def top_flags(flags: DataFrame, bucket: str, flag: str, k: int = 6) -> DataFrame:
    """The most frequent flags of each bucket, ties by name."""
    counts = flags.groupBy(bucket, flag).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(bucket).orderBy(F.desc("n"), flag)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fingerprint(rows: DataFrame, column: str) -> DataFrame:
    """A digest of a corpus: of its sorted paths, joined by bars, and their number.

    The digest is sequential by nature: the paths are sorted in parallel, with spilling, and one task reads them in
    order without holding more than a batch.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, n = hashlib.sha256(), 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                whole.update(b"|" * (n > 0) + path.encode())
                n += 1
        yield pa.record_batch([pa.array([whole.hexdigest()[:16]]), pa.array([n], pa.int64())], names=["fingerprint", "files"])

    paths = rows.select(F.col(column).cast("string").alias("path")).where(F.col("path").isNotNull())
    return paths.orderBy("path").coalesce(1).mapInArrow(digest, "fingerprint string, files bigint")
