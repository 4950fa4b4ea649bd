"""Table profiles and dated schemas: what is looked for, and which columns a disclosure may and must have.

Everything here is data. A new kind of table is a new ``TableProfile``; the engine turns profiles into literal
expressions, and ``dimensions`` publishes them as small DataFrames for SQL users.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRE, POST, TRANSITION, SINGLE = "pre2006", "post2006", "transition", "single"


@dataclass(frozen=True)
class Field:
    role: str
    label: str
    numeric: bool = True
    required: bool = False


@dataclass(frozen=True)
class Version:
    era: str
    fields: tuple[Field, ...]
    first: date | None = None
    last: date | None = None


@dataclass(frozen=True)
class Schema:
    """Versions of a table's columns by filing date; ``window``: dates for which either version may be in use."""

    name: str
    versions: tuple[Version, ...]
    window: tuple[date, date] | None = None
    mandated: date | None = None

    def era(self, filed: date | None) -> str:
        if len(self.versions) == 1:
            return self.versions[0].era
        if filed is None or (self.window and self.window[0] <= filed <= self.window[1]):
            return TRANSITION
        fits = [v.era for v in self.versions if (v.first is None or filed >= v.first) and (v.last is None or filed <= v.last)]
        return fits[0] if fits else TRANSITION

    def era_column(self, filed: Column) -> Column:
        """``era`` as an expression."""
        if len(self.versions) == 1:
            return F.lit(self.versions[0].era)
        out = F.when(filed.isNull(), TRANSITION)
        if self.window:
            out = out.when(filed.between(F.lit(self.window[0]), F.lit(self.window[1])), TRANSITION)
        for v in self.versions:
            fits = F.lit(True)
            if v.first:
                fits &= filed >= F.lit(v.first)
            if v.last:
                fits &= filed <= F.lit(v.last)
            out = out.when(fits, v.era)
        return out.otherwise(TRANSITION)

    def _of(self, era: str) -> list[Version]:
        return [v for v in self.versions if v.era == era] or list(self.versions)

    def eras(self) -> list[str]:
        return [v.era for v in self.versions] + ([TRANSITION] if len(self.versions) > 1 else [])

    def fields(self, era: str) -> list[Field]:
        """The era's columns; in the transition, all versions' columns, each as first defined."""
        return _ordered(self._of(era))

    def roles(self, era: str) -> list[str]:
        return [f.role for f in self.fields(era)]

    def required(self, era: str) -> set[str]:
        return set.intersection(*({f.role for f in v.fields if f.required} for v in self._of(era)))

    def exclusive(self, era: str) -> set[str]:
        """Roles that no other version has."""
        own = {f.role for v in self.versions if v.era == era for f in v.fields}
        return own - {f.role for v in self.versions if v.era != era for f in v.fields}

    def era_of_roles(self, roles: Column) -> Column:
        """The one era whose exclusive roles occur among base roles; null when none or several do."""
        hits = [F.when(F.arrays_overlap(roles, F.array(*map(F.lit, sorted(ex)))), F.lit(v.era)) for v in self.versions if (ex := self.exclusive(v.era))]
        if not hits:
            return F.lit(None).cast("string")
        found = F.filter(F.array(*hits), lambda x: x.isNotNull())
        return F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1)))

    def era_shown(self, roles: set[str]) -> str | None:
        """``era_of_roles`` of plain roles."""
        hits = [v.era for v in self.versions if roles & self.exclusive(v.era)]
        return hits[0] if len(hits) == 1 else None

    def applies(self, filed: Column) -> Column:
        return F.lit(True) if self.mandated is None else F.coalesce(filed >= F.lit(self.mandated), F.lit(True))


def _ordered(versions: list[Version]) -> list[Field]:
    seen: dict[str, Field] = {}
    for v in versions:
        for f in v.fields:
            seen.setdefault(f.role, f)
    return list(seen.values())


@dataclass(frozen=True)
class TableProfile:
    name: str
    titles: tuple[str, ...]
    tokens: tuple[str, ...]
    decoys: tuple[str, ...]
    stops: tuple[str, ...]
    schema: Schema
    rules: tuple[tuple[str, tuple[str, ...]], ...]
    assembly: str  # people, holders or plain
    required_tokens: tuple[str, ...] = ()
    identity_terms: tuple[str, ...] = ("name", "principal", "position")
    tiers: tuple[tuple[str, ...], ...] = (("name", "principal", "position"), ("principal", "position"), ("position",))
    exact_headers: tuple[tuple[str, str], ...] = ()
    header_patterns: tuple[tuple[str, str], ...] = ()
    identity_role: str = "name"
    identity_is_person: bool = True
    bounds: tuple[tuple[str, float, float], ...] = ()
    total_of: tuple[str, tuple[str, ...], float] | None = None
    decoy_penalty: int = 4
    token_cap: int = 8
    title_bonus: int = 4
    caption_bonus: int = 4
    min_score: int = 4


#: Columns that are never read as numbers.
TEXT_ROLES = ("name", "position", "name_and_position", "year", "holder_name", "holder_address", "share_class", "section", "is_group", "unknown", "ignore")

# --- fixed values: the disclosure rules' columns, titles and wordings ---------------------------------------------

_PERSON = Field("name_and_position", "Name and Principal Position", False, True)
_YEAR = Field("year", "Year", False, True)
_SALARY, _BONUS = Field("salary", "Salary"), Field("bonus", "Bonus")
_LATER = (Field("stock_awards", "Stock Awards"), Field("option_awards", "Option Awards"), Field("non_equity_incentive", "Non-Equity Incentive Plan Compensation"), Field("pension_and_nqdc", "Change in Pension Value and NQDC Earnings"))
_OTHER = Field("all_other_comp", "All Other Compensation")

_BEFORE_2006 = (
    _PERSON, _YEAR, _SALARY, _BONUS, Field("other_annual_comp", "Other Annual Compensation"), Field("restricted_stock_awards", "Restricted Stock Award(s)"),
    Field("options_sars", "Securities Underlying Options/SARs"), Field("ltip_payouts", "LTIP Payouts"), _OTHER, Field("total", "Total"),
)
_AFTER_2006 = (_PERSON, _YEAR, _SALARY, _BONUS, *_LATER, _OTHER, Field("total", "Total", True, True))
_WINDOW = (date(2006, 12, 15), date(2007, 12, 31))

SUMMARY_SCHEMA = Schema("item402c_summary_compensation", (Version(PRE, _BEFORE_2006, last=_WINDOW[0]), Version(POST, _AFTER_2006, first=_WINDOW[1])), window=_WINDOW)
DIRECTOR_SCHEMA = Schema(
    "item402r_director_compensation",
    (Version(SINGLE, (Field("name_and_position", "Name", False, True), Field("fees_earned", "Fees Earned or Paid in Cash"), *_LATER, _OTHER, Field("total", "Total", True, True))),),
    mandated=_WINDOW[0],
)
OWNERSHIP_SCHEMA = Schema(
    "item403_beneficial_ownership",
    (
        Version(
            SINGLE,
            (
                Field("holder_name", "Name of Beneficial Owner", False, True), Field("holder_address", "Address", False), Field("share_class", "Title of Class", False),
                Field("shares", "Amount and Nature of Beneficial Ownership"), Field("shares_right_to_acquire", "Shares Subject to Options Exercisable Within 60 Days"),
                Field("shares_voting_authority", "Shares, Voting Power"), Field("shares_dispositive_authority", "Shares, Dispositive Power"), Field("stock_units", "Stock Units / Deferred Units"),
                Field("total", "Total Beneficial Ownership"), Field("percent", "Percent of Class"), Field("percent_shares", "Percent of Shares Outstanding"), Field("percent_voting_power", "Percent of Voting Power"),
            ),
        ),
    ),
)

_NON_EQUITY = ("non_equity_incentive", (r"non.?equity incentive", r"non.?equity"))
_PENSION = ("pension_and_nqdc", (r"change in pension", r"pension value", r"deferred compensation earnings", r"\bnqdc\b"))

SUMMARY_RULES = (
    ("name_and_position", (r"name and .*position", r"name .*principal position", r"name & .*position")),
    ("position", (r"principal position", r"\bposition\b", r"\btitle\b", r"occupation")),
    ("name", (r"\bname\b", r"named executive")),
    ("year", (r"fiscal year", r"\byear\b", r"\bfy\b")),
    ("salary", (r"\bsalary\b", r"base salary")),
    ("bonus", (r"\bbonus\b",)),
    ("other_annual_comp", (r"other annual",)),
    ("ltip_payouts", (r"\bltip\b", r"long.?term incentive plan payout", r"\bpayouts?\b")),
    ("restricted_stock_awards", (r"restricted stock", r"restricted share")),
    ("options_sars", (r"securities underlying", r"options?\s*/?\s*sars", r"\bsars\b", r"number of options")),
    _NON_EQUITY,
    _PENSION,
    ("stock_awards", (r"stock awards?",)),
    ("option_awards", (r"option awards?",)),
    ("all_other_comp", (r"all other",)),
    ("total", (r"\btotal\b",)),
)
DIRECTOR_RULES = (
    ("fees_earned", (r"fees earned", r"paid in cash", r"\bfees\b", r"retainer")),
    ("name_and_position", (r"name and .*position", r"\bname\b", r"\bdirector\b")),
    ("year", (r"fiscal year", r"\byear\b")),
    _NON_EQUITY,
    _PENSION,
    ("stock_awards", (r"stock awards?", r"share awards?")),
    ("option_awards", (r"option awards?",)),
    ("all_other_comp", (r"all other",)),
    ("total", (r"\btotal\b",)),
)
OWNERSHIP_RULES = (
    ("holder_name", (r"name and address", r"name of beneficial", r"name and principal address")),
    ("holder_address", (r"^address", r"\baddress\b(?!.*\bname\b)")),
    ("share_class", (r"title of class", r"class of (?:stock|securit)", r"^class$", r"\bseries\b")),
    ("percent", (r"percent", r"\bpct\b", r"%\s*of", r"\bof class\b")),
    ("shares", (r"amount and nature", r"\bshares?\b", r"beneficially owned", r"\bamount\b", r"number of")),
    ("share_class", (r"\bclass\b",)),
    ("holder_name", (r"name .*beneficial owner", r"\bname\b", r"beneficial owner", r"\bholder\b")),
    ("shares_right_to_acquire", (r"right to acquire", r"exercisable within", r"\bstock options?\b", r"underlying options", r"acquirable")),
    ("stock_units", (r"stock units", r"share units", r"share equivalent", r"phantom")),
    ("total", (r"^total$", r"total beneficial", r"beneficial ownership total")),
)

#: Header texts as filers write them, by the role they mean.
_EXACT = {
    "holder_name": (
        "name", "name of beneficial owner", "name and address of beneficial owner", "name and address", "name address", "name of individual or number of persons in group",
        "name of beneficial owners", "name of beneficial owner and address", "shareholder s name and address", "name of beneficial owner title of class or series",
    ),
    "share_class": ("title of class", "title of class or series", "title of voting class", "common stock", "class a common stock", "class b common stock", "class c common stock"),
    "ignore": ("position held with the company",),
    "shares": (
        "beneficial ownership", "amount beneficially owned", "amount and nature of beneficial ownership", "amount and nature of beneficial ownership number", "amount of common stock beneficially owned",
        "number of shares", "number of shares beneficially owned", "number of shares owned", "number of shares of common stock beneficially owned", "number of shares of common stock owned",
        "shares of common stock", "shares of common stock beneficially owned", "shares beneficially owned", "shares owned beneficially", "common stock beneficially owned",
        "shares of company common stock beneficially owned", "aggregate number of shares of common stock beneficially owned", "no of shares beneficially owned", "shares beneficially owned number",
        "shares of common stock beneficially owned number",
    ),
    "total": ("total", "total beneficial ownership", "beneficial ownership total", "beneficial ownership total beneficial ownership", "shares of common stock total beneficial ownership"),
    "percent": (
        "percent", "percent of class", "percent of class or series", "percent of common stock", "percent of common stock outstanding", "percent of outstanding shares", "percent of outstanding common stock",
        "percent of shares outstanding", "percent of stock outstanding", "percentage", "percentage of class", "percentage of common stock outstanding", "percentage of common stock owned",
        "percentage of outstanding common stock", "percentage of outstanding shares beneficially owned", "ownership percentage", "percentage beneficially owned",
        "percent of total common shares outstanding 1", "percent of class owned",
    ),
    "percent_voting_power": ("percent of voting power",),
    "stock_units": ("number of options rsus profits interest units", "stock units", "phantom stock", "share equivalent units", "additional underlying stock units"),
    "shares_right_to_acquire": (
        "right to acquire", "shares acquirable within 60 days", "other shares that may be acquired", "shares subject to options", "rights to acquire beneficial ownership of shares",
        "number of rights exercisable and vesting within 60 days",
    ),
}
#: Parts of header texts; their order matters only between equals.
_PARTS = (
    ("holder_name", ("name of beneficial owner", "name and address of beneficial owner", "shareholder s name and address", "name/address")),
    ("share_class", ("title of class", "title of voting class")),
    ("ignore", ("position held with the company",)),
    ("shares_voting_authority", ("voting authority",)),
    ("shares_dispositive_authority", ("dispositive authority",)),
    ("percent_voting_power", ("voting power",)),
    ("shares_right_to_acquire", ("shares subject to options", "right to acquire", "acquirable within 60 days", "other shares that may be acquired")),
    ("stock_units", ("stock units", "phantom stock", "share equivalent units", "profits interest units", "rsus")),
    ("total", ("total beneficial ownership",)),
    ("shares", ("amount and nature of beneficial ownership", "amount beneficially owned", "number of shares", "shares beneficially owned", "common stock beneficially owned")),
    ("percent_shares", ("percent of shares of common stock", "percentage of shares")),
    ("percent", ("percent of class", "percentage of class", "percent of common stock", "percent of outstanding", "percentage of outstanding", "ownership percentage")),
)

_PAY = ("stock_awards", "option_awards", "non_equity_incentive", "pension_and_nqdc", "all_other_comp")

SUMMARY = TableProfile(
    name="summary_compensation",
    titles=("summary compensation table",),
    tokens=(
        "salary", "bonus", "stock", "option", "non-equity", "non equity", "incentive", "pension", "all other", "total", "compensation", "awards", "cash", "year", "fiscal year", "sars",
    ),
    decoys=("grant", "grant date", "estimated future payouts", "exercise price", "expiration date", "number of securities underlying unexercised", "fees earned", "paid in cash"),
    stops=(
        r"grants of plan[- ]based awards", r"outstanding equity awards", r"option exercises and stock vested", r"pension benefits", r"nonqualified deferred compensation", r"director compensation",
        r"change[- ]in[- ]control", r"severance pay plan", r"retirement plans", r"certain relationships", r"security ownership",
    ),
    schema=SUMMARY_SCHEMA,
    rules=SUMMARY_RULES,
    assembly="people",
    bounds=(("salary", 1_000, 50_000_000),),
    total_of=("total", ("salary", "bonus", *_PAY), 0.02),
)
DIRECTOR = TableProfile(
    name="director_compensation",
    titles=("director compensation",),
    tokens=("fees earned", "paid in cash", "stock awards", "option awards", "non-equity", "incentive", "pension", "all other", "total", "year", "compensation", "awards", "retainer"),
    decoys=("named executive", "principal position", "salary", "bonus", "grant date"),
    stops=(r"summary compensation table", r"security ownership", r"certain relationships", r"equity compensation plan information", r"audit fees"),
    schema=DIRECTOR_SCHEMA,
    rules=DIRECTOR_RULES,
    assembly="people",
    required_tokens=("fees earned", "paid in cash", "annual retainer"),
    identity_terms=("name", "fees", "total"),
    tiers=(("name", "fees", "cash"), ("fees", "paid"), ("fees",)),
    bounds=(("fees_earned", 0, 5_000_000),),
    total_of=("total", ("fees_earned", *_PAY), 0.02),
)
OWNERSHIP = TableProfile(
    name="beneficial_ownership",
    titles=("security ownership of certain beneficial owners", "beneficial ownership", "security ownership"),
    tokens=("name", "address", "beneficial owner", "amount and nature", "shares", "percent", "class", "of class", "beneficially owned", "title of class"),
    decoys=("salary", "bonus", "fees earned", "grant date", "principal position"),
    stops=(r"summary compensation table", r"equity compensation plan information", r"section 16\(a\)", r"certain relationships", r"director compensation"),
    schema=OWNERSHIP_SCHEMA,
    rules=OWNERSHIP_RULES,
    assembly="holders",
    required_tokens=("beneficial", "percent of class", "of class", "beneficially owned"),
    identity_terms=("name", "percent", "class"),
    tiers=(("name", "beneficial", "owner"), ("beneficial", "own"), ("percent", "class")),
    exact_headers=tuple((text, role) for role, texts in _EXACT.items() for text in texts),
    header_patterns=tuple((text, role) for role, texts in _PARTS for text in texts),
    identity_role="holder_name",
    identity_is_person=False,
    bounds=(("percent", 0, 100),),
)

# --- registry -----------------------------------------------------------------------------------------------------

PROFILES = {p.name: p for p in (SUMMARY, DIRECTOR, OWNERSHIP)}
ALIASES = {"sct": SUMMARY, "comp": SUMMARY, "director": DIRECTOR, "dircomp": DIRECTOR, "ownership": OWNERSHIP, "bo": OWNERSHIP}


def available_tables() -> list[str]:
    return sorted(PROFILES)


def register_profile(profile: TableProfile, *aliases: str) -> None:
    """Make a profile known by its name and aliases, beside those that come with the engine."""
    names = [profile.name.lower(), *(a.lower() for a in aliases)]
    for n in names:
        if (PROFILES | ALIASES).get(n, profile) is not profile:
            raise ValueError(f"a table named {n!r} exists")
    PROFILES[names[0]] = profile
    ALIASES.update({a: profile for a in names[1:]})


def get_profile(name: str | TableProfile) -> TableProfile:
    if isinstance(name, TableProfile):
        return name
    found = PROFILES.get(name.lower()) or ALIASES.get(name.lower())
    if found is None:
        raise KeyError(f"no table named {name!r}; choose one of {', '.join([*available_tables(), *sorted(ALIASES)])}")
    return found


def dimensions(spark: SparkSession) -> dict[str, DataFrame]:
    """The profiles as DataFrames: fields by era, rules, bounds. A few hundred rows at most."""
    fields = [(p.name, p.schema.name, era, i, f.role, f.label, f.numeric, f.role in p.schema.required(era)) for p in PROFILES.values() for era in p.schema.eras() for i, f in enumerate(p.schema.fields(era))]
    rules = [(p.name, i, role, pattern) for p in PROFILES.values() for i, (role, patterns) in enumerate(p.rules) for pattern in patterns]
    bounds = [(p.name, role, float(low), float(high)) for p in PROFILES.values() for role, low, high in p.bounds]
    versions = [(p.schema.name, i, v.era, v.first, v.last) for p in PROFILES.values() for i, v in enumerate(p.schema.versions)]
    return {
        "schema_fields": spark.createDataFrame(fields, "profile string, schema string, era string, ord int, role string, label string, numeric boolean, required boolean"),
        "role_rules": spark.createDataFrame(rules, "profile string, ord int, role string, pattern string"),
        "value_bounds": spark.createDataFrame(bounds, "profile string, role string, low double, high double"),
        "schema_versions": spark.createDataFrame(versions, "schema string, ord int, era string, first date, last date"),
    }
