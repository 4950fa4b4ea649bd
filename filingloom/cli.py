"""One filing from a folder to CSV: ``python -m filingloom.cli TICKER --root DIR [--table ownership] [-o out.csv]``.

CSV goes to standard output or a file, the account of it to standard error. Exit codes: 0 a table was found, 1 none was,
2 it needs a review and --strict was given, 3 the request cannot be met.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import functions as F

from filingloom.plans.extract import extract
from filingloom.profiles import ALIASES, PROFILES, available_tables, get_profile
from filingloom.session import session
from filingloom.sources import filings as S

OK, NONE, REVIEW, USAGE = 0, 1, 2, 3


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        self.print_usage(sys.stderr)
        self.exit(USAGE, f"{self.prog}: {message}\n")


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="filingloom", description="Extract one disclosure table from one filing.")
    p.add_argument("ticker", nargs="?")
    p.add_argument("--root", default=".", help="folder of <ticker>/<form>/<date>_<form>.<suffix>")
    p.add_argument("--table", default="sct")
    p.add_argument("--form", default="DEF 14A")
    p.add_argument("--year", type=int)
    p.add_argument("--prefer", choices=("latest", "earliest"), default="latest")
    p.add_argument("-o", "--output")
    p.add_argument("--raw-headers", action="store_true", help="headers as filed in place of roles")
    p.add_argument("--no-normalize", action="store_true")
    p.add_argument("--no-assemble", action="store_true")
    p.add_argument("--strict", action="store_true", help="exit 2 where the table needs a review")
    p.add_argument("--list", action="store_true", help="list the ticker's filings")
    p.add_argument("--tables", action="store_true", help="list the tables that can be asked for")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    say = lambda *x: print(*x, file=sys.stderr)
    if args.tables:
        for name in available_tables():
            print(name, *sorted(a for a, p in ALIASES.items() if p is PROFILES[name]))
        return OK
    if not args.ticker:
        say("a ticker is needed")
        return USAGE
    try:
        profile = get_profile(args.table)
    except KeyError as e:
        say(e.args[0])
        return USAGE
    folder = Path(args.root) / args.ticker.upper()
    if not folder.is_dir():
        say(f"{folder} is no folder")
        return USAGE
    spark = spark or session()
    rows = S.scan(spark, str(folder.parent)).where((F.col("ticker") == args.ticker.upper()) & (F.lower("form") == args.form.replace("_", " ").lower()))
    if args.year:
        rows = rows.where(F.year("filing_date") == args.year)
    if args.list:
        for r in rows.select("filing_date", "form", "locator").orderBy("filing_date", S.suffix_rank(F.col("suffix"))).toLocalIterator():
            print(r.filing_date, r.form, r.locator, sep="\t")
        return OK
    found = extract(S.pick_filing(rows, ["ticker"], args.prefer), profile, normalize_numbers=not args.no_normalize, assemble_rows=not args.no_assemble)
    heads = F.col("header") if args.raw_headers else F.col("roles")
    one = found.withColumn("csv", S.csv_document(heads, F.col("rows"))).first()
    if one is None:
        say("no such filing")
        return USAGE
    say(f"{one.locator}: {one.backend or 'nothing'}, era {one.era}, {len(one.rows or [])} rows, flags {', '.join(one.flags) or 'none'}")
    if not one.ok:
        return NONE
    if args.output:
        Path(args.output).write_text(one.csv, encoding="utf-8")
    else:
        sys.stdout.write(one.csv)
    return REVIEW if args.strict and one.needs_review else OK


if __name__ == "__main__":
    sys.exit(main())
