"""Pay figures: canonical sentences, rendering and reading back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postingworks.functions import fixed_values as fv
from postingworks.functions.spans import let

_UNITS = {"hour": "hr", "week": "wk", "month": "mo"}


def pay_sentence(currency: Column, low: Column, high: Column, unit: Column) -> Column:
    """Structured pay fields as one sentence; empty when the figures, currency or unit say nothing."""
    def name_of(u: Column) -> Column:
        name = F.lit(None).cast("string")
        for known in reversed(list(fv.PAY_UNITS)):
            name = F.when(u.contains(known), known).otherwise(name)
        return name

    def number(v: Column) -> Column:
        """The figure; 0 for a missing one, null for text that is none."""
        s = F.trim(F.coalesce(F.nullif(v.cast("string"), F.lit("")), F.lit("0")))
        return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))

    def sentence(p: Column) -> Column:
        top, bottom = F.greatest(p["a"], p["b"]), F.least(p["a"], p["b"])

        def show(x: Column) -> Column:
            cents = F.rtrim(F.rtrim(F.format_number(x, 2), F.lit("0")), F.lit("."))
            return F.when(p["unit"] == "hour", cents).otherwise(F.format_number(x, 0))

        per = F.create_map(*[F.lit(x) for pair in fv.PAY_UNITS.items() for x in pair])[p["unit"]]
        span = F.when((bottom == 0) | (bottom == top), show(top)).otherwise(F.concat(show(bottom), F.lit(" - "), show(top)))
        ok = (p["unit"].isNotNull() & p["a"].isNotNull() & p["b"].isNotNull() & p["currency"].rlike("^[A-Za-z]{3}$") & (top > 0))
        text = F.concat(F.lit(" Compensation: "), F.upper(p["currency"]), F.lit(" "), span, F.lit(" "), per, F.lit("."))
        return F.when(F.coalesce(ok, F.lit(False)), text).otherwise("")

    unit = name_of(F.lower(F.coalesce(F.nullif(unit, F.lit("")), F.lit("year"))))
    return let(F.struct(unit.alias("unit"), number(low).alias("a"), number(high).alias("b"),
                        F.coalesce(currency, F.lit("")).alias("currency")), sentence)


def money(x: Column, symbol: Column) -> Column:
    whole = F.abs(x - F.rint(x)) < 0.005
    return F.concat(symbol, F.when(whole, F.format_number(x, 0)).otherwise(F.format_number(x, 2)))


def thousands(x: Column, symbol: Column) -> Column:
    return F.concat(symbol, F.regexp_replace(F.concat(F.format_number(x / 1000, 1), F.lit("k")), r"\.0k", "k"))


def annual_factor(period: Column) -> Column:
    return F.create_map(*[F.lit(x) for p, v in fv.SALARY_PERIODS.items() for x in (p, v[1])])[period]


def render_salary(low: Column, high: Column, period: Column, symbol: Column, qualifier: Column | None = None) -> Column:
    """`$120,000 - $150,000`, or the stated rate with its yearly estimate."""
    qualifier = F.lit("") if qualifier is None else qualifier
    whole_low, whole_high = low.cast("bigint").cast("double"), high.cast("bigint").cast("double")

    def span(a: Column, b: Column, show) -> Column:
        return F.when(low == high, show(a, symbol)).otherwise(F.concat(show(a, symbol), F.lit(" - "), show(b, symbol)))

    yearly = F.when(whole_low == whole_high, money(whole_low, symbol)).otherwise(
        F.concat(money(whole_low, symbol), F.lit(" - "), money(whole_high, symbol)))
    unit = F.create_map(*[F.lit(x) for pair in _UNITS.items() for x in pair])[period]
    f = annual_factor(period)
    rated = F.concat(span(low, high, money), F.lit("/"), unit, F.lit(" (~"), span(low * f, high * f, thousands),
                     F.lit("/yr)"))
    return F.concat(qualifier, F.when(period == "year", yearly).otherwise(rated))


def annual_bounds(salary: Column) -> Column:
    """STRUCT<low, high> of yearly figures in a rendered salary, null when it holds none."""
    part = F.when(salary.contains("(~"), F.regexp_extract(salary, r"(?s)^.*?\(~(.*)$", 1)).otherwise(salary)
    pattern = r"(\d[\d,]*(?:\.\d+)?)\s*([kK])?"
    numbers = F.regexp_extract_all(part, F.lit(pattern), F.lit(1))
    marks = F.regexp_extract_all(part, F.lit(pattern), F.lit(2))
    values = F.zip_with(numbers, marks, lambda n, k: F.translate(n, ",", "").cast("double")
                        * F.when(k != "", 1000).otherwise(1))
    return F.when(F.size(values) > 0, F.struct(F.array_min(values).alias("low"), F.array_max(values).alias("high")))


def is_stated(salary: Column) -> Column:
    return F.coalesce((salary != "") & (salary != "Unclear"), F.lit(False))


def is_partial(salary: Column, evidence: Column) -> Column:
    """True for a salary that names one bound only."""
    evidence = F.coalesce(evidence, F.lit(""))
    amount = r"\$?\s*[\d,]+(?:\.\d+)?k?"
    lead = F.when(evidence.rlike(amount), F.split(evidence, amount, 2)[0]).otherwise("")
    return is_stated(salary) & (
        salary.startswith("from ") | salary.startswith("up to ")
        | (~salary.contains(" - ") & lead.rlike("(?i)" + fv.PARTIAL_SALARY_LEAD)))
