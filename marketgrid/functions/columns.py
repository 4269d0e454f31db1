"""Scalar column expressions: ratios, codes, classifiers, labels.

Every function takes columns (or names) and returns a Column, so all of it
stays inside whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str

# Fixed values -------------------------------------------------------------
METRES_PER_MILE = 1609.344
LMI_LIMIT_PCT = 80.0
TIERS = ("metro", "micro", "rural")
APPLICATION_CODES = ("1", "2", "3", "4", "5")
ORIGINATION_CODE = "1"
DENIAL_CODE = "3"
PURCHASED_CODE = "6"
PREAPPROVAL_CODES = ("7", "8")
ACTION_LABELS = {
    "1": ("Loan originated", "origination"),
    "2": ("Application approved but not accepted", "application"),
    "3": ("Application denied", "application"),
    "4": ("Application withdrawn by applicant", "application"),
    "5": ("File closed for incompleteness", "application"),
    "6": ("Purchased loan", "purchased"),
    "7": ("Preapproval request denied", "preapproval"),
    "8": ("Preapproval request approved but not accepted", "preapproval"),
}
FULL_SERVICE_TYPES = ("11", "12")
ADDRESS_TOKENS = {
    "street": "st", "road": "rd", "drive": "dr", "avenue": "ave",
    "boulevard": "blvd", "highway": "hwy", "north": "n", "south": "s",
    "east": "e", "west": "w", "suite": "ste", "lane": "ln", "court": "ct",
    "place": "pl", "parkway": "pkwy", "circle": "cir", "trail": "trl",
}
STATE_CODES = {"55": "WI", "17": "IL"}
STATE_NAMES = {"55": "Wisconsin", "17": "Illinois"}
# (lat min, lat max, lon min, lon max)
DEFAULT_BOX = (36.0, 47.5, -93.5, -86.0)
# --------------------------------------------------------------------------


def col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Col, den: Col, scale: float = 1.0) -> Column:
    """``scale * num / den`` in double, NULL when the denominator is 0 or NULL."""
    den = col(den).cast("double")
    value = col(num).cast("double") / F.when(den != 0, den)
    return value if scale == 1.0 else F.lit(scale) * col(num).cast("double") / F.when(den != 0, den)


def rnd(value: Col, places: int = 0) -> Column:
    """Round half away from zero on the scaled double.

    Scaling first gives the same digits as the SQL engines that round
    ``value * 10^n``; Spark's own ``round`` works on the decimal text, which
    differs for values such as 9.665.
    """
    v = col(value).cast("double")
    return F.round(v) if places == 0 else F.round(v * float(10**places)) / float(10**places)


def pct(num: Col, den: Col) -> Column:
    return ratio(num, den, 100.0)


def growth_pct(now: Col, base: Col) -> Column:
    """Simple growth in percent; NULL without a usable base."""
    return pct(col(now) - col(base), base)


def cagr_pct(now: Col, base: Col, years: Col) -> Column:
    """Annualised growth in percent, refused for a base or span of 0 or less."""
    now, base = col(now).cast("double"), col(base).cast("double")
    years = col(years).cast("double")
    ok = (base > 0) & (now >= 0) & (years > 0)
    return F.when(ok, (F.pow(now / base, F.lit(1.0) / years) - 1) * 100)


def count_where(cond: Column) -> Column:
    """Rows for which the condition is true; 0 when there are none."""
    return F.count(F.when(cond, F.lit(1)))


def sum_where(cond: Column, value: Col) -> Column:
    """Sum over matching rows; NULL when nothing matches."""
    return F.sum(F.when(cond, col(value)))


def market_key(cbsa: Col, state: Col) -> Column:
    """The metropolitan area, or one pseudo-market per state outside of any."""
    return F.coalesce(col(cbsa), F.concat(F.lit("RURAL-"), col(state)))


def market_label(title: Col, state: Col) -> Column:
    return F.coalesce(col(title), F.concat(F.lit("Outside any CBSA, "), col(state)))


def county_of(tract: Col) -> Column:
    """County part of a tract id: all but the last six characters, five at least."""
    text = col(tract)
    return F.substring(text, F.lit(1), F.greatest(F.lit(5), F.length(text) - 6))


def state_of(geoid: Col) -> Column:
    return F.substring(col(geoid), 1, 2)


def pad_code(number: Col, width: int) -> Column:
    """Integer code to text with leading zeros; longer values are kept whole."""
    text = col(number).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def county_fips(state: Col, county: Col) -> Column:
    return F.concat(pad_code(state, 2), pad_code(county, 3))


def label_from(code: Col, labels: dict[str, str], default: Column | None = None) -> Column:
    """Code to label through a literal map; unknown codes take the default."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), col(code))
    return found if default is None else F.coalesce(found, default)


def state_code(fips: Col) -> Column:
    return label_from(fips, STATE_CODES, col(fips))


def state_name(fips: Col) -> Column:
    return label_from(fips, STATE_NAMES)


def action_class(code: Col) -> Column:
    return label_from(code, {k: v[1] for k, v in ACTION_LABELS.items()}, F.lit("unmapped"))


def action_meaning(code: Col) -> Column:
    return label_from(code, {k: v[0] for k, v in ACTION_LABELS.items()})


def is_application(code: Col) -> Column:
    return col(code).isin(*APPLICATION_CODES)


def is_origination(code: Col) -> Column:
    return col(code) == ORIGINATION_CODE


def number(text: Col, kind: str = "double") -> Column:
    """Text to number, anything unreadable becomes NULL."""
    return F.expr(f"try_cast({_sql_name(text)} as {kind})") if isinstance(text, str) else text.try_cast(kind)


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def not_negative(value: Col) -> Column:
    """Any negative census value is a suppression code."""
    return F.when(col(value) >= 0, col(value))


def norm_address(address: Col) -> Column:
    """Lower case, punctuation to blanks, street words to their short form."""
    pairs = [F.lit(x) for kv in ADDRESS_TOKENS.items() for x in kv]
    short = F.create_map(*pairs)
    clean = F.trim(F.regexp_replace(F.lower(col(address)), "[^a-z0-9 ]", " "))
    words = F.filter(F.split(clean, " +"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(short, w), w)), " ")


def county_from_label(name: Col) -> Column:
    """County name out of ``tract; county; state``."""
    return F.trim(F.try_element_at(F.split(col(name), ";"), F.lit(-2)))


def tier_from_area_type(kind: Col) -> Column:
    return (
        F.when(col(kind) == "Metropolitan Statistical Area", "metro")
        .when(col(kind) == "Micropolitan Statistical Area", "micro")
        .otherwise("rural")
    )


def tract_status(geoid: Col, households: Col, income: Col) -> Column:
    code = F.right(col(geoid), F.lit(6))
    return (
        F.when(code.startswith("99") | code.startswith("98"), "water_or_special")
        .when(col(households) == 0, "unpopulated")
        .when(col(households).isNull() | col(income).isNull(), "suppressed")
        .otherwise("ok")
    )


def lmi_flag(income_pct: Col) -> Column:
    """True, false or unknown; an unknown ratio is never read as false."""
    return col(income_pct) < LMI_LIMIT_PCT


def coord_validity(lat: Col, lon: Col, box=DEFAULT_BOX) -> Column:
    lat, lon = col(lat), col(lon)
    return (
        F.when(lat.isNull() | lon.isNull(), "missing_coordinates")
        .when((lat == 0) & (lon == 0), "null_island")
        .when((lon > 0) | (lat < 0), "transposed_coordinates")
        .when(~(lat.between(box[0], box[1]) & lon.between(box[2], box[3])), "out_of_range")
        .otherwise("ok")
    )


def coord_ok(lat: Col, lon: Col, box=DEFAULT_BOX) -> Column:
    return coord_validity(lat, lon, box) == "ok"


def drift_kind(n_seen: Col, miles: Col, address_changed: Col, still: float = 0.1) -> Column:
    return (
        F.when(col(n_seen) < 2, "single_vintage")
        .when(col(miles) <= still, "stable")
        .when(col(address_changed), "relocation")
        .otherwise("regeocode")
    )


def attribution(subject_growth: Col, market_growth: Col) -> Column:
    return (
        F.when(col(subject_growth).isNull(), "no subject presence")
        .when(col(subject_growth) > col(market_growth), "gaining share")
        .otherwise("losing share")
    )


def market_volatile(market_growth: Col, branch_change: Col, swing: float = 40.0, moves: int = 2) -> Column:
    return (F.abs(col(market_growth)) > swing) & (F.abs(F.coalesce(col(branch_change), F.lit(0))) <= moves)


def diagnosis(level: Col, trend: Col) -> Column:
    """Level against trajectory; an unknown trajectory is a state of its own."""
    low = col(level) < 1
    return (
        F.when(col(trend).isNull() & low, "poor level, trajectory unknown")
        .when(col(trend).isNull(), "adequate level, trajectory unknown")
        .when(low & (col(trend) < 0), "poor level AND poor trajectory")
        .when(low, "poor level, positive trajectory")
        .when(col(trend) < 0, "adequate level, poor trajectory")
        .otherwise("adequate level and trajectory")
    )


def opportunity_type(outside: Col, capture: Col) -> Column:
    return (
        F.when(col(outside), "siting - outside the footprint")
        .when(col(capture) == 0, "conversion - present, capturing none")
        .otherwise("conversion - present, under-capturing")
    )


def reconciliation_verdict(have: Col, want: Col, branch_diff: Col, diff_k: Col, diff_pct: Col) -> Column:
    return (
        F.when(col(have).isNull(), "MISSING FROM WAREHOUSE")
        .when(col(want).isNull(), "MISSING FROM REFERENCE")
        .when(col(branch_diff) != 0, "BRANCH COUNT MISMATCH")
        .when(F.abs(col(diff_pct)) > 0.1, "FAIL - outside 0.1%")
        .when(col(diff_k) != 0, "PASS - within tolerance")
        .otherwise("PASS - exact")
    )


def binding_test(rule: Col, lmi: Col, lmi_now: Col, delta_lmi: Col, delta_non: Col) -> Column:
    return (
        F.when(col(rule) == "current", F.lit(None).cast("string"))
        .when(col(lmi).isNull() | col(lmi_now).isNull(), "NOT MEASURED")
        .when(col(delta_lmi) >= col(delta_non), "PASS - expansion is proportional")
        .otherwise("FAIL - non-LMI coverage grows faster")
    )


def match_quality(in_register: Col, rssd: Col, lei: Col) -> Column:
    blank = col(rssd).isNull() | (F.trim(col(rssd)) == "") | (F.lower(F.trim(col(rssd))) == "nan")
    return (
        F.when(~col(in_register), "not_in_fdic")
        .when(blank, "no_fed_rssd")
        .when(col(lei).isNotNull(), "exact_rssd")
        .otherwise("no_lei_for_rssd")
    )


def as_flag(text: Col) -> Column:
    """Three-valued boolean from text."""
    t = F.lower(F.trim(col(text).cast("string")))
    return F.when(t == "true", F.lit(True)).when(t == "false", F.lit(False))


def year_of(text: Col) -> Column:
    """Year of a date text, NULL when it cannot be read."""
    parsed = F.coalesce(
        F.try_to_timestamp(col(text), F.lit("MM/dd/yyyy")), F.try_to_timestamp(col(text))
    )
    return F.year(parsed)


def as_of_date(year: Col) -> Column:
    return F.make_date(col(year), F.lit(6), F.lit(30))


def to_dollars(thousands: Col) -> Column:
    return (col(thousands) * 1000).cast("long")


def present_count(*cols: Col) -> Column:
    return reduce(add, [F.when(col(c).isNotNull(), 1).otherwise(0) for c in cols])


def caption(lmi_share: Col, growth_share: Col, footprint_pct: Col) -> Column:
    return F.concat(
        F.lit("LMI "), F.format_string("%.1f", col(lmi_share)),
        F.lit("% vs "), F.format_string("%.1f", col(footprint_pct)), F.lit("% footprint"),
        F.lit("  |  growth estimated for "), F.format_string("%.1f", col(growth_share)),
        F.lit("% of these tracts"),
    )


def weight_grid(steps: int = 10, step: float = 0.05) -> Column:
    """0, 0.05 .. 0.5 as an array; decimals keep the grid exact."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.round(i * F.lit(step), 2))
