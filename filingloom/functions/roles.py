"""Header texts to roles: as Catalyst expressions over literal rules, for headers in columns, and as plain functions with
the same results (``RoleReader``), for a table that is at hand in Python already."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingloom.functions.arrow import let
from filingloom.functions.text import PLACEHOLDERS, clean_header
from filingloom.profiles import TableProfile


def map_lookup(cleaned: Column, profile: TableProfile) -> Column:
    """The role that filers mean by a header: by its whole text, else by the known part that ends it best.

    Of several parts the last to begin counts, then the longest; a group's label stands before its own column's.
    """
    if not profile.exact_headers:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for pair in profile.exact_headers for x in pair]
    exact = F.try_element_at(F.create_map(*pairs), cleaned)
    options = []
    for i, (part, role) in enumerate(profile.header_patterns):
        at = F.length(cleaned) - F.instr(F.reverse(cleaned), part[::-1])
        found = F.instr(cleaned, part) > 0
        options.append(F.when(found, F.struct((at - len(part)).alias("at"), F.lit(len(part)).alias("size"), F.lit(-i).alias("ord"), F.lit(role).alias("role"))))
    best = F.array_max(F.filter(F.array(*options), lambda x: x.isNotNull()))
    return F.coalesce(exact, best["role"])


def infer_role(header: Column, profile: TableProfile, era: Column) -> Column:
    """The role of one header cell under a profile and an era (a string column)."""
    return let(clean_header(header), lambda cleaned: _infer(cleaned, profile, era))


def _infer(cleaned: Column, profile: TableProfile, era: Column) -> Column:
    eras = profile.schema.eras()
    allowed = F.create_map(*(x for e in eras for x in (F.lit(e), F.array(*map(F.lit, profile.schema.roles(e))))))
    roles = F.try_element_at(allowed, era)
    hits = F.filter(
        F.array(*(F.when(F.regexp_like(cleaned, F.lit("(?U)" + "|".join(f"(?:{p})" for p in patterns))), F.lit(role)) for role, patterns in profile.rules)),
        lambda x: x.isNotNull(),
    )
    snake = F.regexp_replace(F.regexp_replace(cleaned, "[^a-z0-9]+", "_"), "^_+|_+$", "")

    def first(hits: Column) -> Column:
        fitting = F.filter(hits, lambda r: r.isin("name", "position") | roles.isNull() | F.array_contains(roles, r))
        return F.coalesce(F.try_element_at(fitting, F.lit(1)), F.try_element_at(hits, F.lit(1)))

    named = F.coalesce(map_lookup(cleaned, profile), let(hits, first), F.nullif(snake, F.lit("")), F.lit("unknown"))
    return F.when(cleaned.isin(*PLACEHOLDERS), "unknown").otherwise(named)


def number_repeats(roles: Column) -> Column:
    """Second and later columns of a role get _2, _3, ...; unknown ones stay."""
    return F.transform(
        roles,
        lambda r, i: F.when(r == "unknown", r).otherwise(
            F.concat(r, F.when(_before(roles, r, i) > 0, F.concat(F.lit("_"), (_before(roles, r, i) + 1).cast("string"))).otherwise(""))
        ),
    )


def _before(roles: Column, role: Column, i: Column) -> Column:
    return F.size(F.filter(F.slice(roles, F.lit(1), i), lambda x: x == role))


def infer_roles(headers: Column, profile: TableProfile, era: Column) -> Column:
    return let(F.transform(headers, lambda h: infer_role(h, profile, era)), number_repeats)


# --- the same in Python --------------------------------------------------------------------------------------------

_WRAP, _MARK, _SIGNS, _HOLLOW = re.compile(r"(\w)-\s+(\w)"), re.compile(r"\(\s*[0-9a-z]{1,3}\s*\)"), str.maketrans("$/|", "   "), re.compile(r"\(\s*\)")
_LAST = re.compile(r"_[^_]*$")


@lru_cache(maxsize=50_000)
def plain_header(raw: str) -> str:
    """``clean_header`` of any text."""
    s = _WRAP.sub(r"\1\2", unicodedata.normalize("NFKC", raw).replace("\xa0", " ").replace("\n", " "))
    return " ".join(_HOLLOW.sub(" ", _MARK.sub(" ", s).translate(_SIGNS)).split()).strip(" ()").lower()


def base_of(role: str) -> str:
    """A role without its number."""
    return _LAST.sub("", role) if role[-1:].isdigit() else role


class RoleReader:
    """``infer_roles`` under one profile; looked-up headers are remembered."""

    def __init__(self, profile: TableProfile) -> None:
        self.profile, self.exact = profile, dict(profile.exact_headers)
        self.rules = [(role, re.compile("|".join(f"(?:{p})" for p in patterns))) for role, patterns in profile.rules]
        self.allowed = {era: {*profile.schema.roles(era), "name", "position"} for era in profile.schema.eras()}
        self.role = lru_cache(maxsize=50_000)(self._role)

    def _mapped(self, cleaned: str) -> str | None:
        if not self.exact:
            return None
        ends = ((cleaned.rfind(part), len(part), -i, role) for i, (part, role) in enumerate(self.profile.header_patterns) if part in cleaned)
        return self.exact.get(cleaned) or max(ends, default=(None,))[-1]

    def _role(self, header: str, era: str) -> str:
        cleaned = plain_header(header)
        if cleaned in PLACEHOLDERS:
            return "unknown"
        hits = [role for role, pattern in self.rules if pattern.search(cleaned)]
        fitting = [r for r in hits if era not in self.allowed or r in self.allowed[era]]
        return self._mapped(cleaned) or next(iter(fitting + hits), None) or re.sub("[^a-z0-9]+", "_", cleaned).strip("_") or "unknown"

    def roles(self, headers: list[str], era: str) -> list[str]:
        seen: Counter[str] = Counter()
        out = []
        for role in (self.role(h, era) for h in headers):
            seen[role] += 1
            out.append(role if role == "unknown" or seen[role] == 1 else f"{role}_{seen[role]}")
        return out

    def under_shown_era(self, headers: list[str], era: str) -> tuple[str | None, list[str]]:
        """Roles under an era; where they show another one, that era and the roles under it."""
        roles = self.roles(headers, era)
        shown = self.profile.schema.era_shown({base_of(r) for r in roles})
        return shown, roles if shown in (None, era) else self.roles(headers, shown)
