"""Text predicates and cleaners as Catalyst expressions.

``(?U)`` makes Java's classes follow Unicode. Nothing here needs Python on the executors, except ``nfkc``, which leaves
ASCII text alone.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the words by which titles, groups, addresses and prose are told -------------------------------

TITLE_WORDS = (
    "president chief officer cfo ceo coo cto cao cio evp svp vp vice executive chairman chairwoman chair director treasurer secretary counsel controller principal "
    "manager managing partner founder senior division general interim former operations financial finance legal accounting administrative commercial technology "
    "marketing officers employee head"
).split()
GROUP_PHRASES = ("as a group", "all directors", "all executive officers", "named executive officers", "all officers")
STREET_WORDS = "street|avenue|ave|road|boulevard|blvd|suite|floor|drive|lane|plaza|parkway|way|centre|center|tower|building"
ADDRESS = rf"(?:\b\d{{1,6}}\s+[A-Za-z]|\b(?:{STREET_WORDS})\b|\bp\.?\s*o\.?\s*box\b|\b[A-Z]{{2}}\s+\d{{5}}\b)"
PROSE = r"\b(?:pursuant|schedule 13[gd]|securities and exchange|filed|statement|reported|according to|includes?|represents?|consists?)\b"
NAME_WORD = r"(?:[A-Z]\.|[A-Z][A-Za-z'’\-]+|van|von|der|de|del|da|di|la|le|Jr\.?|Sr\.?|II|III|IV|V)"
NAME = rf"^(?:[A-Z]\.\s*)*[A-Z][A-Za-z'’\-]+,?(?:\s+{NAME_WORD},?)*[.]?$"
FOOTNOTE_TAIL = r"\s*\((?:[0-9]{1,3}|[a-z])\)\s*$"
CREDENTIAL_TAIL = r",?\s*(?:Ph\.?\s?D|M\.?\s?D|J\.?\s?D|M\.?B\.?A|C\.?P\.?A|Ed\.?\s?D|Esq|MBA|CFA)\.?\s*$"
PLACEHOLDERS = ("", "$", "—", "–", "-", "%", "(", ")")
MISSING = ("", "-", "--", "—", "–", "*", "**", "n/a", "na", "nm", "none", "not applicable")

# ------------------------------------------------------------------------------------------------------------------

TITLE = rf"\b(?:{'|'.join(TITLE_WORDS)})\b"
TAG = r"(?s)<[^>]+>"


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(c: Column) -> Column:
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(F.pandas_udf(_nfkc, "string")(c))


def decode(content: Column) -> Column:
    """UTF-8 where it is that, else Latin-1: no byte is lost."""
    as_text = content.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(content, "ISO-8859-1"))


def is_text_filing(text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 4000))
    wrapped = head.contains("<sec-document>") | head.contains("<ims-document>")
    return wrapped | ~(head.contains("<html") | head.contains("<body"))


def lines(text: Column) -> Column:
    """Lines by every line boundary that Unicode and old text files know; a final one does not open another line."""
    split = F.split(text, r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]")
    return F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.size(split) - 1)).otherwise(split)


def blank_tags(line: Column) -> Column:
    """Markup as spaces, so columns stay where they are."""
    return F.aggregate(F.array_distinct(F.regexp_extract_all(line, F.lit(r"(<[^>]+>)"), 1)), line, lambda acc, tag: F.replace(acc, tag, F.repeat(F.lit(" "), F.length(tag))))


def is_heading(line: Column) -> Column:
    upper, letters = F.regexp_count(line, F.lit(r"\p{Lu}")), F.regexp_count(line, F.lit(r"\p{L}"))
    return (F.length(strip(line)) >= 6) & (letters > 0) & F.coalesce(F.try_divide(upper, letters) > 0.7, F.lit(False))


def is_row_like(line: Column) -> Column:
    return line.rlike(r"(?U)\d") & line.rlike(r"(?U)\s{2,}")


def is_rule_line(line: Column) -> Column:
    return strip(line).rlike(r"^(?=.*[-=_])[-=_ ]{4,}$")


def is_table_end(line: Column) -> Column:
    return line.rlike(r"(?i)</\s*table|<\s*/?\s*fn\b")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def content_key(snippet: Column) -> Column:
    """What a candidate says, whatever its markup."""
    return F.lower(squeeze(F.regexp_replace(snippet, TAG, " ")))


def clean_header(raw: Column) -> Column:
    """A header cell in comparable form; ``raw`` in compatibility form already (see ``nfkc``)."""
    s = F.translate(F.coalesce(raw, F.lit("")), "\u00a0\n", "  ")
    s = F.regexp_replace(s, r"(?U)(\w)-\s+(\w)", "$1$2")
    s = F.regexp_replace(s, r"\((?U:\s*)[0-9a-z]{1,3}(?U:\s*)\)", " ")
    s = F.translate(s, "$/|", "   ")
    s = F.regexp_replace(s, r"\((?U:\s*)\)", " ")
    return F.lower(F.btrim(F.regexp_replace(s, r"(?U)\s+", " "), F.lit(" ()")))


def base_role(role: Column) -> Column:
    return F.when(role.rlike(r"\d$"), F.regexp_replace(role, r"_[^_]*$", "")).otherwise(role)


def normalize_number(raw: Column) -> Column:
    """The first number of a cell without its dressing; missing marks give an empty string, never 0."""
    s = strip(F.coalesce(raw, F.lit("")))
    bare = F.translate(F.btrim(s, F.lit("()")), ",$", "")
    found = F.regexp_extract(bare, r"(-?\d+(?:\.\d+)?)", 1)
    negative = s.startswith("(") & s.endswith(")") & ~found.startswith("-")
    return F.when(F.lower(s).isin(*MISSING) | (found == ""), "").when(negative, F.concat(F.lit("-"), found)).otherwise(found)


def corrected_number(raw: Column) -> Column:
    """As ``normalize_number``, but reads a leading decimal point and steps over a footnote mark before the number."""
    s = F.regexp_replace(strip(F.coalesce(raw, F.lit(""))), r"^\(\d{1,2}\)\s+(?=[$\d])", "")
    s = F.regexp_replace(s, r"(?<![\d.])\.(?=\d)", "0.")
    return normalize_number(s)


def looks_like_title(c: Column) -> Column:
    return c.rlike(rf"(?iU){TITLE}")


def looks_like_person(c: Column) -> Column:
    s = strip(F.regexp_replace(F.regexp_replace(c, f"(?U){FOOTNOTE_TAIL}", ""), f"(?iU){CREDENTIAL_TAIL}", ""))
    words = F.size(F.split(squeeze(s), " "))
    return (F.length(s) >= 3) & ~looks_like_title(s) & words.between(2, 6) & s.rlike(f"(?U){NAME}")


def looks_like_group(c: Column) -> Column:
    low = F.lower(c)
    return F.exists(F.array(*map(F.lit, GROUP_PHRASES)), lambda p: F.contains(low, p))


def looks_like_address(c: Column) -> Column:
    s = strip(c)
    return s.rlike(r"(?U)^\d{1,6}\s+[A-Za-z]") | s.rlike(f"(?iU)^{ADDRESS}")


def looks_like_prose(c: Column) -> Column:
    return c.rlike(f"(?iU){PROSE}")


def count_tokens(text: Column, tokens: tuple[str, ...]) -> Column:
    """How many of the tokens occur in lower-cased text."""
    return F.size(F.filter(F.array(*map(F.lit, tokens)), lambda t: F.contains(text, t))) if tokens else F.lit(0)


def has_any(text: Column, tokens: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(text, t)) if tokens else F.lit(False)
