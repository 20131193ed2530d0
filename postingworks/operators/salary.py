"""Pay ranges stated in description text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingworks.functions import fixed_values as fv
from postingworks.functions.pay import render_salary
from postingworks.functions.spans import FLAGS, matches, shaped, spans, strip, window
from postingworks.session import built_once

_FIGURE = "struct<start:int,end:int,lo:double,hi:double,period:string,sym:string>"
_SPAN = "struct<start:int,end:int>"


def _amount(number: Column, thousand: Column) -> Column:
    return F.translate(number, ",", "").cast("double") * F.when(thousand, 1000).otherwise(1)


def _symbol(*marks: Column) -> Column:
    """Currency sign: the first mark that names one, else dollars."""
    table = F.create_map(*[F.lit(x) for pair in fv.CURRENCY_SYMBOLS.items() for x in pair])

    def look(mark: Column) -> Column:
        mark = F.lower(strip(mark))
        return table[F.when(F.length(mark) > 1, F.regexp_replace(mark, r"\s*\$$", "")).otherwise(mark)]

    return F.coalesce(*[look(m) for m in marks], F.lit("$"))


def _period(hay: Column, start: Column, end: Column) -> Column:
    """Pay period named right after the amount, the earliest wins, else in a short lead-in; null when unstated."""
    after, before = window(hay, end, end + 32), window(hay, start - 30, start)
    named = F.array(*[F.struct(F.regexp_instr(after, F.lit(FLAGS + v[0])).alias("at"), F.lit(i).alias("i"),
                               F.lit(p).alias("period"))
                      for i, (p, v) in enumerate(fv.SALARY_PERIODS.items())])
    earliest = F.array_min(F.filter(named, lambda x: x["at"] > 0))["period"]
    lead = F.coalesce(*[F.when(matches(before, p), F.lit(name)) for name, p in fv.SALARY_LEAD_IN.items()])
    return F.coalesce(earliest, lead)


def _in_bounds(lo: Column, hi: Column, period: Column) -> Column:
    ok = F.lit(False)
    for name, (_, _, low, high) in fv.SALARY_PERIODS.items():
        ok = F.when(period == name, lo.between(low, high) & hi.between(low, high)).otherwise(ok)
    return ok


def _is_scale(hay: Column, start: Column, end: Column) -> Column:
    return (matches(window(hay, start - 20, end + 20), fv.SALARY_DISQUALIFY)
            | matches(window(hay, end, end + 12), fv.SALARY_SCALE_AFTER))


def _is_nonbase(hay: Column, start: Column, end: Column) -> Column:
    before = window(hay, start - 40, start)
    return (matches(before, fv.SALARY_MINIMUM_WAGE)
            | (matches(before, fv.SALARY_NONBASE_BEFORE) & ~matches(before, fv.SALARY_EXCLUDING))
            | matches(window(hay, end, end + 30), fv.SALARY_NONBASE_AFTER))


def _has_context(hay: Column, start: Column, end: Column) -> Column:
    return matches(window(hay, start, end), fv.SALARY_CONTEXT)


def _pairs(hay: Column, pattern: str, stands_alone: bool) -> Column:
    """Two-amount phrases (min/max, from/to) inside their bounds, each marked accepted or rejected."""
    def read(m):
        g = m["groups"]
        unit = F.nullif(F.concat(g[4], g[9]), F.lit(""))
        first_unit = F.when(g[4] != "", g[4]).otherwise(g[9])
        period = F.when(unit.isNotNull(), F.when(F.lower(first_unit).contains("h"), "hour").otherwise("year")).otherwise(
            F.coalesce(_period(hay, m["start"], m["end"]), F.lit("year")))
        guarded = (_has_context(hay, m["start"] - 120, m["end"] + 20) & ~_is_scale(hay, m["start"], m["end"]))
        accepted = (unit.isNotNull() | guarded) if stands_alone else guarded
        return F.struct(m["start"].alias("start"), m["end"].alias("end"),
                        _amount(g[1], g[2] != "").alias("lo"), _amount(g[6], g[7] != "").alias("hi"),
                        period.alias("period"), _symbol(g[0], g[5], g[3], g[8]).alias("sym"),
                        accepted.alias("accepted"))

    found = F.transform(spans(hay, pattern, 10), read)
    return F.filter(found, lambda d: (d["lo"] <= d["hi"]) & _in_bounds(d["lo"], d["hi"], d["period"]))


def _ranges(hay: Column) -> Column:
    """`a - b` spans that are money of a plausible size; `named` and `barred` say what surrounds them."""
    def read(m):
        g = m["groups"]
        k1, k2 = g[2] != "", g[7] != ""
        a = _amount(g[1], k1 | (k2 & (F.translate(g[1], ",", "").cast("double") < 1000)))
        b = _amount(g[6], k2)
        between = (F.lower(g[4]) != "and") | matches(window(hay, m["start"] - 12, m["start"]), r"\bbetween\s*$")
        currency = (g[0] != "") | (g[5] != "") | (strip(g[3]) != "") | (strip(g[8]) != "") | (k1 & k2)
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.least(a, b).alias("lo"),
                        F.greatest(a, b).alias("hi"),
                        F.when(between & currency, F.coalesce(_period(hay, m["start"], m["end"]), F.lit("year"))).alias("period"),
                        _symbol(g[0], g[5], g[3], g[8]).alias("sym"), (k1 | k2).alias("k"))

    def surroundings(d):
        return F.struct(d["start"].alias("start"), d["end"].alias("end"), d["lo"].alias("lo"), d["hi"].alias("hi"),
                        d["period"].alias("period"), d["sym"].alias("sym"),
                        _has_context(hay, d["start"] - 200, d["end"] + 40).alias("named"),
                        (_is_scale(hay, d["start"], d["end"]) | _is_nonbase(hay, d["start"], d["end"])).alias("barred"))

    money = F.filter(F.transform(spans(hay, fv.SALARY_RANGE, 9), read),
                     lambda d: d["period"].isNotNull() & _in_bounds(d["lo"], d["hi"], d["period"])
                     & ~((d["period"] == "year") & (d["lo"] < 1000) & ~d["k"]))
    return F.transform(money, surroundings)


def _figure(d: Column) -> Column:
    return F.struct(*[d[f].alias(f) for f in ("start", "end", "lo", "hi", "period", "sym")])


def _span(d: Column) -> Column:
    return F.struct(d["start"].alias("start"), d["end"].alias("end"))


def _settle(pairs: Column, ranges: Column) -> Column:
    """Accepted figures and rejected spans; a range soon after an accepted one needs no context word of its own."""
    start = F.struct(
        F.transform(F.filter(pairs, lambda d: d["accepted"]), _figure).cast(f"array<{_FIGURE}>").alias("taken"),
        F.transform(F.filter(pairs, lambda d: ~d["accepted"]), _span).cast(f"array<{_SPAN}>").alias("rejected"))

    def step(acc, d):
        continues = F.exists(acc["taken"], lambda t: (d["start"] - t["end"]).between(0, 250))
        ok = (d["named"] | continues) & ~d["barred"]
        return F.struct(
            F.when(ok, F.array_append(acc["taken"], _figure(d).cast(_FIGURE))).otherwise(acc["taken"]).alias("taken"),
            F.when(ok, acc["rejected"]).otherwise(F.array_append(acc["rejected"], _span(d).cast(_SPAN))).alias("rejected"))

    return F.aggregate(ranges, start, step)


def _singles(hay: Column, settled: Column) -> Column:
    """Lone amounts outside every accepted or rejected range."""
    def outside(m):
        def covers(s):
            return (s["start"] <= m["start"]) & (m["start"] < s["end"])
        return ~F.exists(settled["taken"], covers) & ~F.exists(settled["rejected"], covers)

    def read(m):
        g = m["groups"]
        value = _amount(g[1], g[2] != "")
        lead = F.lower(window(hay, m["start"] - 24, m["start"]))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), value.alias("lo"), value.alias("hi"),
                        F.coalesce(_period(hay, m["start"], m["end"]), F.lit("year")).alias("period"),
                        _symbol(g[0], g[3]).alias("sym"),
                        F.when(lead.rlike(fv.SALARY_UP_TO), "up to ")
                        .when(lead.rlike(fv.SALARY_FROM), "from ").otherwise("").alias("qual"))

    def plausible(d):
        return (_in_bounds(d["lo"], d["hi"], d["period"]) & ~((d["period"] == "year") & (d["lo"] < 1000))
                & _has_context(hay, d["start"] - 60, d["end"] + 15) & ~_is_scale(hay, d["start"], d["end"])
                & ~_is_nonbase(hay, d["start"], d["end"]))

    return F.filter(F.transform(F.filter(spans(hay, fv.SALARY_SINGLE, 4), outside), read), plausible)


def _converted(period: Column) -> Column:
    return F.when(period != "year", F.concat(F.lit("[converted from "), period, F.lit("ly pay] "))).otherwise("")


@built_once
def _stages(text: str) -> list[tuple[str, Column]]:
    """The columns of the reading, each building on the ones before it."""
    raw, flat, hay, settled = F.col(text), F.col("_flat"), F.col("_hay"), F.col("_settled")
    # without a currency mark or a thousands suffix no pattern can match
    stages = [
        ("_flat", F.when(raw.rlike(r"(?i)[$£€]|usd|cad|gbp|eur|\d\s?k\b"), F.regexp_replace(raw, r"(?U)\s+", " "))),
        ("_hay", shaped(flat)),
        ("_pairs", F.when(hay.isNotNull(), F.concat(
            F.when(matches(hay, r"\bmin"), _pairs(hay, fv.SALARY_MINMAX, True)).otherwise(F.array()),
            F.when(matches(hay, r"\bfrom\s"), _pairs(hay, fv.SALARY_FROM_TO, False)).otherwise(F.array())))),
        ("_ranges", F.when(hay.isNotNull(), _ranges(hay))),
        ("_settled", _settle(F.col("_pairs"), F.col("_ranges"))),
        ("_taken", F.array_sort(settled["taken"])),
        ("_single", F.when(F.size("_taken") == 0, F.get(_singles(hay, settled), 0))),
    ]
    # ranges of one period and currency listed close together form a location table
    first = F.col("_taken")[0]
    chain = F.aggregate(
        F.slice("_taken", 2, F.greatest(F.size("_taken") - 1, F.lit(0))), F.array(first),
        lambda acc, d: F.when((d["period"] == first["period"]) & (d["sym"] == first["sym"])
                              & (d["start"] - F.element_at(acc, -1)["end"] <= 400), F.array_append(acc, d)).otherwise(acc))
    lows, highs = F.transform("_chain", lambda d: d["lo"]), F.transform("_chain", lambda d: d["hi"])
    kinds = F.size(F.array_distinct(F.transform("_chain", lambda d: F.struct(d["lo"], d["hi"]))))
    stages += [
        ("_chain", F.when(F.size("_taken") > 0, chain)),
        ("_pick", F.when(F.col("_chain").isNotNull(), F.struct(
            F.array_min(lows).alias("lo"), F.array_max(highs).alias("hi"), kinds.alias("kinds"),
            ((kinds > 1) & (F.array_max(highs) <= 2.2 * F.array_min(lows))).alias("table")))),
    ]
    chain, pick, single = F.col("_chain"), F.col("_pick"), F.col("_single")
    first = chain[0]
    lo = F.when(pick["table"], pick["lo"]).otherwise(first["lo"])
    hi = F.when(pick["table"], pick["hi"]).otherwise(first["hi"])
    end = F.when(pick["table"], F.element_at(chain, -1)["end"]).otherwise(first["end"])
    listed = F.when(pick["table"], F.concat(F.lit("["), pick["kinds"].cast("string"),
                                            F.lit(" ranges listed, widest shown] "))).otherwise("")
    quoted = F.concat(_converted(first["period"]), listed, strip(window(flat, first["start"] - 40, end + 40)))
    stages += [
        ("salary", F.when(pick.isNotNull(), render_salary(lo, hi, first["period"], first["sym"]))
         .when(single.isNotNull(), render_salary(single["lo"], single["hi"], single["period"], single["sym"], single["qual"]))
         .otherwise("Unclear")),
        ("salary_evidence", F.when(pick.isNotNull(), quoted)
         .when(single.isNotNull(), F.concat(_converted(single["period"]), strip(window(flat, single["start"] - 40, single["end"] + 40))))
         .otherwise("")),
    ]
    return stages


def classify_salary(df: DataFrame, text: str = "description") -> DataFrame:
    """Adds `salary` (rendered, `Unclear` when unstated) and `salary_evidence`."""
    stages = _stages(text)
    for name, column in stages:
        df = df.withColumn(name, column)
    return df.drop(*[name for name, _ in stages if name.startswith("_")])
