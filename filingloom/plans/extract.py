"""Filings to tables: the whole plan.

One filing is one row throughout. Two Arrow functions bracket the native middle: the first enumerates candidate tables
(text windows, HTML trees) and leaves the document's text behind, then Catalyst scores, ranks and chooses; the second
turns the chosen one into a grid, names its columns under the era's schema and folds rows into entities. There is no
shuffle from scan to result, so the plan grows with the input and with nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.functions.arrow import append
from filingloom.functions.roles import RoleReader
from filingloom.functions.text import base_role, decode, is_text_filing
from filingloom.operators import assemble, grids, scan_html, scan_text
from filingloom.operators.select import CANDIDATE, collapsed, margin, scored
from filingloom.profiles import TRANSITION, TableProfile, get_profile

#: bare: no data rows; seen: the era that the columns show; the rest is null where there is no usable table.
TABLE = "failed boolean, bare boolean, seen string, roles array<string>, header array<string>, rows array<array<string>>, rows_before bigint, suspects array<string>"
FLAGS = (
    "no_filing_date", "predates_mandate", "no_table_found", "below_score_threshold", "ambiguous_selection", "tabulation_failed", "no_data_rows", "era_mismatch", "ascii_source", "sgml_source",
    "assembly_emptied_table", "unmapped_columns", "suspect_identity_values", "missing_required_columns",
)
REVIEW = ("ambiguous_selection", "missing_required_columns", "unmapped_columns", "era_mismatch", "below_score_threshold", "suspect_identity_values")
PROVENANCE = ("ascii_source", "sgml_source", "no_filing_date", "predates_mandate")


def _struct(fields: str) -> str:
    return "struct<" + ",".join(f.replace(" ", ":", 1) for f in fields.split(", ")) + ">"


def enumerate_candidates(text: str, is_text: bool, profile: TableProfile) -> list[dict]:
    """All candidates of a document in order of appearance."""

    def of_text() -> list[dict]:
        return [{"backend": c.backend, "kind": c.kind, "index": c.index, "snippet": c.snippet} for c in scan_text.Page(text, profile).candidates()]

    tables = [
        {"backend": "dom", "kind": t.kind, "index": t.index, "header": t.header, "full": t.full, "caption": t.caption, "title": t.title, "grid": t.tabulated(profile)} for t in scan_html.candidates(text, profile, by_row=not is_text)
    ]
    found = of_text() + tables if is_text else tables or of_text()
    empty = {"snippet": "", "header": "", "full": "", "caption": False, "title": False, "grid": []}
    return [empty | c | {"seq": i} for i, c in enumerate(found)]


@lru_cache(maxsize=16)
def _reader(profile: TableProfile) -> RoleReader:
    return RoleReader(profile)


def read_table(best: dict | None, era: str, profile: TableProfile, normalize: bool, into_rows: Callable | None) -> dict | None:
    """The chosen candidate as rows under roles; into_rows: the assembly, none to leave rows as they are."""
    if best is None:
        return None
    kind, snippet = best["backend"], best["snippet"]
    table = best["grid"] if kind == "dom" else grids.sgml_grid(snippet) if kind == "sgml" else grids.ascii_grid(scan_text.blank(snippet))
    header, rows = grids.without_empty_columns(*grids.split_header(table))
    if not table or not rows:
        return {"failed": not table, "bare": bool(table)}
    seen, roles = _reader(profile).under_shown_era(header, era)
    return {"failed": False, "bare": False, "seen": seen} | assemble.finish(roles, header, rows, profile, normalize, into_rows)


def with_candidates(filings: DataFrame, profile: str | TableProfile = "summary_compensation", error: str | None = None, limit_s: float | None = None) -> DataFrame:
    """``filings`` (content or text, filing_date) with ranked in place of their texts: the scored candidates, equal ones at the top collapsed."""
    p = get_profile(profile)
    text = F.col("text") if "text" in filings.columns else decode(F.col("content"))
    df = filings.select(*(c for c in filings.columns if c not in ("content", "text")), F.coalesce(text, F.lit("")).alias("_text")).withColumn("is_text", is_text_filing(F.col("_text")))
    df = append(df, "_found", f"array<{_struct(CANDIDATE)}>", ["_text", "is_text"], partial(enumerate_candidates, profile=p), drop=("_text",), error=error, limit_s=limit_s)
    return df.withColumn("_ranked", scored(F.col("_found"), p)).withColumn("ranked", collapsed(F.col("_ranked"))).drop("_found", "_ranked")


def candidates(filings: DataFrame, profile: str | TableProfile = "summary_compensation", key: str = "filing_id") -> DataFrame:
    """The ranked candidates as rows."""
    df = with_candidates(filings, profile).select(key, F.posexplode("ranked").alias("pos", "c"))
    return df.select(key, (F.col("pos") + 1).alias("rank"), "c.score", "c.of.backend", "c.of.kind", "c.of.index", "c.of.snippet", F.col("c.said").alias("content"))


def extract(filings: DataFrame, profile: str | TableProfile = "summary_compensation", *, normalize_numbers: bool = True, assemble_rows: bool = True, error: str | None = None, limit_s: float | None = None) -> DataFrame:
    """One row for each filing: its other columns, era, backend, roles, header, rows, flags and how they came about.

    filings: filing_date (date), and text (string) or content (binary). error: the name of a column for what a document's
    extraction raised; without it the first such document fails the job. limit_s: seconds that each of the two steps may
    take for one document.
    """
    p = get_profile(profile)
    df = with_candidates(filings, p, error, limit_s)
    top = F.try_element_at(F.col("ranked"), F.lit(1))
    df = df.select(
        *[c for c in df.columns if c != "ranked"],
        F.size("ranked").alias("n_candidates"),
        top["score"].alias("top_score"),
        margin(F.col("ranked")).alias("margin"),
        F.when(top["score"] >= p.min_score, top["of"]).alias("best"),
        p.schema.era_column(F.col("filing_date")).alias("dated_era"),
    ).withColumn("backend", F.col("best.backend"))
    read = partial(read_table, profile=p, normalize=normalize_numbers, into_rows=assemble.ASSEMBLIES[p.assembly] if assemble_rows else None)
    df = append(df, "table", _struct(TABLE), ["best", "dated_era"], read, drop=("best",), error=error, limit_s=limit_s)
    df = df.withColumn("era_from_columns", F.col("table.seen")).withColumn("era", F.coalesce("era_from_columns", "dated_era"))
    return _flagged(df, p, assemble_rows)


def _flagged(df: DataFrame, p: TableProfile, assembled: bool) -> DataFrame:
    none = F.col("backend").isNull()
    failed, bare = ~none & F.col("table.failed"), ~none & F.col("table.bare")
    mismatch = F.coalesce((F.col("dated_era") != TRANSITION) & (F.col("era") != F.col("dated_era")), F.lit(False))
    emptied = F.lit(assembled) & F.coalesce(F.size("table.rows") == 0, F.lit(False))
    done = F.col("table.rows").isNotNull() & ~emptied
    roles = F.col("table.roles")
    unmapped = F.transform(F.filter(F.arrays_zip(roles.alias("role"), F.col("table.header").alias("header")), lambda x: (x["role"] == "unknown") | x["role"].startswith("unknown_")), lambda x: x["header"])
    eras = p.schema.eras()
    required = F.try_element_at(F.create_map(*(x for e in eras for x in (F.lit(e), F.array(*map(F.lit, sorted(p.schema.required(e))))))), F.col("era"))
    missing = F.array_except(required, F.transform(roles, base_role))
    composite = F.array_contains(roles, "name") & F.array_contains(roles, "position")
    missing = F.when(composite, F.array_remove(missing, "name_and_position")).otherwise(missing)
    df = df.withColumns({"unmapped": F.when(done, unmapped), "missing_roles": F.when(done, F.array_sort(missing)), "suspect_identities": F.when(done, F.slice("table.suspects", 1, 5))})
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    raised = {
        "no_filing_date": F.col("filing_date").isNull() & F.lit(len(p.schema.versions) > 1),
        "predates_mandate": ~p.schema.applies(F.col("filing_date")),
        "no_table_found": none,
        "below_score_threshold": none & (F.col("n_candidates") > 0),
        "ambiguous_selection": ~none & F.coalesce(F.col("margin") == 0, F.lit(False)),
        "tabulation_failed": failed,
        "no_data_rows": bare,
        "era_mismatch": mismatch,
        "ascii_source": F.col("table.rows").isNotNull() & (F.col("backend") == "ascii"),
        "sgml_source": F.col("table.rows").isNotNull() & (F.col("backend") == "sgml"),
        "assembly_emptied_table": emptied,
        "unmapped_columns": some("unmapped"),
        "suspect_identity_values": some("suspect_identities"),
        "missing_required_columns": some("missing_roles"),
    }
    flags = F.filter(F.array(*(F.when(F.coalesce(raised[f], F.lit(False)), F.lit(f)) for f in FLAGS)), lambda x: x.isNotNull())
    df = df.withColumn("flags", flags)
    hidden = {"table", "dated_era", "is_text"}
    names = [c for c in df.columns if c not in hidden | {"era_from_columns"}]
    return df.select(
        *names,
        F.when(mismatch, F.col("era_from_columns")).alias("era_from_columns"),
        F.when(done, roles).alias("roles"),
        F.when(done, F.col("table.header")).alias("header"),
        F.when(done, F.col("table.rows")).alias("rows"),
        F.col("table.rows_before").alias("rows_before_assembly"),
        done.alias("ok"),
        *partition_flags(F.col("flags")),
    )


def partition_flags(flags: Column) -> list[Column]:
    """Flags that ask for a review, flags that tell the source, and others; and whether a review is needed."""
    review, provenance = (F.array(*map(F.lit, x)) for x in (REVIEW, PROVENANCE))
    return [
        F.array_intersect(flags, review).alias("review_flags"),
        F.array_intersect(flags, provenance).alias("provenance_flags"),
        F.array_except(F.array_except(flags, review), provenance).alias("other_flags"),
        (F.size(F.array_intersect(flags, review)) > 0).alias("needs_review"),
    ]


def facts(extractions: DataFrame, key: str = "filing_id") -> DataFrame:
    """Cells as rows: the form that any profile and era shares."""
    rows = extractions.where("ok").select(key, "era", "roles", "header", F.posexplode("rows").alias("row_ix", "cells"))
    cells = rows.select(key, "era", "row_ix", F.posexplode(F.arrays_zip("roles", "header", "cells")).alias("col_ix", "c"))
    value = F.coalesce(F.col("c.cells"), F.lit(""))
    return cells.select(key, "era", "row_ix", "col_ix", F.col("c.roles").alias("role"), F.col("c.header").alias("header"), value.alias("value"), F.expr("try_cast(nullif(c.cells, '') AS DECIMAL(38, 6))").alias("value_num"))


def wide(extractions: DataFrame, profile: str | TableProfile, key: str = "filing_id", roles: list[str] | None = None) -> DataFrame:
    """A column for each wanted role and a map of all others, without a shuffle: read from the row's arrays."""
    p = get_profile(profile)
    lead = {"people": ["name", "position"], "holders": ["holder_name", "holder_address", "section", "is_group"]}.get(p.assembly, [])
    wanted = roles or list(dict.fromkeys([*lead, *(r for v in p.schema.versions for f in v.fields if (r := f.role) != "name_and_position")]))
    rows = extractions.where("ok").select(key, "era", "roles", F.posexplode("rows").alias("row_ix", "cells"))
    first = F.filter(F.arrays_zip("roles", "cells"), lambda x: ~x["roles"].isin(*wanted))
    return rows.select(key, "era", "row_ix", *(F.try_element_at("cells", F.nullif(F.array_position("roles", r), F.lit(0)).cast("int")).alias(r) for r in wanted), F.map_from_entries(_unique(first)).alias("extra"))


def _unique(pairs: Column) -> Column:
    return F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda y: y["roles"] == x["roles"]))


extract_summary = partial(extract, profile="summary_compensation")
