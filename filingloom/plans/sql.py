"""The engine for SQL users: its dimensions as views and its parsers as table functions.

    register(spark)
    SELECT d.filing_id, t.* FROM filings d, LATERAL html_cells(d.text) t
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from filingloom.operators import scan_html, scan_text
from filingloom.profiles import dimensions, get_profile


class HtmlCells:
    """All cells of all tables of an HTML text, spans filled."""

    def eval(self, text: str) -> Iterator[tuple[int, int, int, str]]:
        root = scan_html.parse(text or "")
        for t, table in enumerate(root.find_all("table") if root is not None else ()):
            for r, row in enumerate(scan_html.grid(table)):
                for c, cell in enumerate(row):
                    yield t, r, c, cell


class TextTables:
    """Candidate tables of a plain-text filing under a profile."""

    def eval(self, text: str, profile: str) -> Iterator[tuple[int, str, int, str]]:
        for i, c in enumerate(scan_text.Page(text or "", get_profile(profile)).candidates()):
            yield i, c.backend, c.kind, c.snippet


def register(spark: SparkSession) -> None:
    spark.udtf.register("html_cells", F.udtf(HtmlCells, returnType="table_ix int, row_ix int, col_ix int, text string"))
    spark.udtf.register("text_tables", F.udtf(TextTables, returnType="seq int, backend string, kind int, snippet string"))
    for name, rows in dimensions(spark).items():
        rows.createOrReplaceTempView(name)
