"""Queries over inputs that the small tables lack, against their SQL twins."""

import duckdb
import pytest

from filingloom.operators import scan_html
from filingloom.plans import queries


def twins(spark, path, name: str, **tables: str) -> tuple[list, list]:
    """Rows of a query and of its SQL over tables given as SQL."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    df = queries.QUERIES[name](spark, str(path))
    names = sorted(df.columns)
    got = sorted(([r[c] for c in names] for r in df.collect()), key=repr)
    cur = con.execute(queries.ORACLE_SQL[name])
    have = [d[0] for d in cur.description]
    return got, sorted(([r[have.index(c)] for c in names] for r in cur.fetchall()), key=repr)


def test_full_documents_of_three_line_holders(spark, tmp_path):
    """Nations of 101, 61 and 130 suppliers: their lines are more than a text scan captures."""
    nation = "CASE WHEN s_suppkey <= 100 THEN 0 WHEN s_suppkey <= 161 THEN 1 ELSE 2 END"
    supplier = f"SELECT * REPLACE (({nation})::INT AS s_nationkey) FROM '/root/testdata/sf0.1/supplier.parquet' WHERE s_suppkey <= 291"
    got, want = twins(spark, tmp_path, "holders_continuation", supplier=supplier)
    assert len(want) == 292 and got == want


def test_all_documents_are_decoded(spark, tmp_path):
    """Odd ids too, and texts that Latin-1 cannot hold."""
    documents = "SELECT * FROM (VALUES (1::BIGINT, 'caf\u00e9'), (2, 'na\u00efve'), (3, 'price \u20ac 5'), (5, ''), (7, NULL)) v(doc_id, text)"
    got, want = twins(spark, tmp_path, "decode_bytes", documents=documents)
    assert [r[0] for r in want] == [1, 2, 3, 5, 7] and got == want


@pytest.mark.parametrize("name", ["every_holder_html", "every_holder_sgml"])
def test_lone_holders(spark, tmp_path, name):
    """Nations of one supplier each, and one of two."""
    supplier = "SELECT * REPLACE (least(s_suppkey, 9)::INT AS s_nationkey) FROM '/root/testdata/sf0.001/supplier.parquet'"
    got, want = twins(spark, tmp_path, name, supplier=supplier)
    assert len(want) == 10 and got == want


def test_no_holder_is_left_over(spark, tmp_path):
    """Nations of 102, 201, 100 and, thrice, one supplier; a row left over joins the document before."""
    nation = "CASE WHEN s_suppkey <= 101 THEN 0 WHEN s_suppkey <= 302 THEN 1 WHEN s_suppkey <= 402 THEN 2 ELSE s_suppkey - 400 END"
    got, want = twins(spark, tmp_path, "holders_ascii", supplier=f"SELECT * REPLACE (({nation})::INT AS s_nationkey) FROM '/root/testdata/sf0.1/supplier.parquet' WHERE s_suppkey <= 405")
    assert len(want) == 406 and got == want


@pytest.mark.parametrize("name", ["holders_ascii", "holders_html", "holders_sgml", "holders_continuation", "holders_group_rows", "ambiguous_ties", "duplicate_collapse", "candidate_rows", "fact_rows"])
def test_holders_where_rows_come_out(spark, tmp_path, name):
    got, want = twins(spark, tmp_path, name, supplier="SELECT * FROM '/root/testdata/sf0.01/supplier.parquet'")
    assert want and got == want


def test_part_keys_longer_than_house_numbers(spark, tmp_path):
    """Keys of six, seven and ten digits, all kinds of cell among each."""
    part = "SELECT p_partkey + first AS p_partkey, p_name FROM '/root/testdata/sf0.001/part.parquet', (SELECT unnest([999900, 1199800, 5000000000]) AS first)"
    got, want = twins(spark, tmp_path, "who_is_it", part=part)
    assert len(want) == 600 and got == want


def test_large_plain_tables_are_kept(monkeypatch):
    """Only places that spans add are bounded."""
    monkeypatch.setattr(scan_html, "MOST_CELLS", 50)
    page = lambda span: scan_html.parse("<html><body><table>" + f"<tr><td{span}>a</td><td>b</td></tr>" * 60 + "</table></body></html>")
    assert scan_html.grid(page("").find_all("table")[0]) == [["a", "b"]] * 60
    assert scan_html.grid(page(' colspan="2"').find_all("table")[0]) == []
