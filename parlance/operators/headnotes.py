"""Sections of reported headnotes, their pairs with summaries, and the summary of an evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How the lines begin that open, continue and close the sections.
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DATE_LINE, DATE_LINE_MOST = rf"(?i)^(?:{MONTHS}).*?(19|20)\d{{2}}", 80
HELD, HELD_FURTHER = r"(?i)^Held\s*:?\s*$", r"(?i)^Held\s+further\s*"
PER_JUDGE = r"^Per\s+.+J\."
HELD_ENDS = [r"(?i)^Cases\s+referred\s+to\s*", r"(?i)^APPEAL\s+from\s+", r"(?i)^An?\s+APPLICATION\s+under"]
CASES, CASES_HEAD = r"(?i)^Cases\s+referred\s+to\s*:?-?", r"(?i)^Cases\s+referred\s+to\s*:?-?\s*"
COUNSEL, RESERVED, INITIALS = r"(?i)\s+for\s+(petitioner|respondent)", r"(?i)^Cur\.\s+adv\.\s+vult", r"^[A-Z]\.\s+[A-Z]"
LEAST_NAME = 6


def headnote_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def _first(lines: Column, pattern: str) -> Column:
    """The place from 1 of the first line that fits; null if none does."""
    return F.nullif(F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), F.lit(True)), F.lit(0))


def _any(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _between(lines: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last``, both included; none where either is null."""
    n = F.greatest(F.lit(0), last - first + 1).cast("int")
    return F.coalesce(F.slice(lines, F.greatest(F.lit(1), first).cast("int"), n), F.array().cast("array<string>"))


def before_held(lines: Column) -> Column:
    """The facts: what stands after the last date line and before the holdings."""
    end = F.coalesce(_first(lines, HELD), F.size(lines) + 1)
    dated = F.transform(lines, lambda x, i: F.when(x.rlike(DATE_LINE) & (F.length(x) < DATE_LINE_MOST) & (i + 1 < end), i + 1))
    start = F.coalesce(F.array_max(dated), F.lit(0)) + 1
    rest = _between(lines, start, end - 1)
    stop = F.coalesce(_first(rest, HELD_FURTHER), F.size(rest) + 1)
    return F.array_join(F.filter(_between(rest, F.lit(1), stop - 1), lambda x: x != ""), " ")


def held(lines: Column) -> Column:
    """The holdings: from the first heading on, without headings, up to the next section; lines of single judges never end it."""
    heading = _any([HELD, HELD_FURTHER])
    rest = _between(lines, _first(lines, heading), F.size(lines))
    ends = F.transform(rest, lambda x: x.rlike(_any(HELD_ENDS)) & ~x.rlike(heading) & ~x.rlike(PER_JUDGE))
    stop = F.coalesce(F.nullif(F.array_position(ends, F.lit(True)), F.lit(0)), F.size(rest) + 1)
    return F.array_join(F.filter(_between(rest, F.lit(1), stop - 1), lambda x: (x != "") & ~x.rlike(heading)), " ")


def cases_referred(lines: Column) -> Column:
    """The lines of the list of cases, up to counsel."""
    rest = _between(lines, _first(lines, CASES), F.size(lines))
    ends = F.transform(rest, lambda x: ~x.rlike(CASES) & (x.rlike(COUNSEL) | x.rlike(RESERVED)))
    stop = F.coalesce(F.nullif(F.array_position(ends, F.lit(True)), F.lit(0)), F.size(rest) + 1)
    kept = F.transform(_between(rest, F.lit(1), stop - 1), lambda x: F.when(x.rlike(CASES), F.trim(F.regexp_replace(x, CASES_HEAD, ""))).when(~x.rlike(INITIALS), x))
    return F.filter(kept, lambda x: x.isNotNull() & (x != ""))


def case_names(cases: Column) -> Column:
    """Names without number and what follows a dash."""
    name = lambda x: F.trim(F.regexp_replace(F.split(F.regexp_replace(x, r"^\d+\.\s*", ""), r"\s+[-\u2013]\s+", 2)[0], r"\s+", " "))
    return F.filter(F.transform(cases, name), lambda x: F.length(x) >= LEAST_NAME)


def summary_candidates(stem: Column) -> Column:
    """Names under which the summary of a headnote may stand, in the order in which they are tried."""
    bare = F.regexp_replace(stem, r"\s", "")
    kind, tail = F.upper(F.regexp_extract(bare, r"(?i)^SC_(CA|FR|SPL)_(.+)$", 1)), F.regexp_extract(bare, r"(?i)^SC_(CA|FR|SPL)_(.+)$", 2)
    short = F.regexp_extract(tail, r"^(\d{1,2})([A-Za-z]?_?\d.*)$", 1)
    padded = F.concat(F.lit("SC_"), F.lpad(short, 2, "0"), F.regexp_extract(tail, r"^(\d{1,2})([A-Za-z]?_?\d.*)$", 2))
    plain = F.concat(F.lit("SC_"), tail)
    names = F.array(bare, F.when(bare != stem, stem), F.when(kind == "FR", F.concat(F.lit("SC_FR_"), tail)), F.when(kind == "SPL", F.concat(F.lit("SC_SPL_"), tail)), F.when(kind.isin("CA", "SPL"), plain), F.when((kind == "CA") & (short != ""), padded))
    return F.array_distinct(F.filter(names, lambda x: x.isNotNull()))


def pair(headnotes: DataFrame, summaries: DataFrame) -> DataFrame:
    """stem and name: each headnote with the first of its candidates among ``summaries`` (name); an equi-join on candidates."""
    tried = headnotes.select("stem", F.posexplode(summary_candidates(F.col("stem"))).alias("place", "name"))
    return tried.join(summaries.select("name").distinct(), "name", "left_semi").groupBy("stem").agg(F.min_by("name", "place").alias("name"))


def evaluation_summary(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """n, and mean and population deviation of every metric over the rows that have it."""
    out = [F.count(F.lit(1)).alias("n")]
    for m in metrics:
        out += [F.count(m).alias(f"n_{m}"), F.round(F.avg(m), 4).alias(f"mean_{m}"), F.round(F.stddev_pop(m), 4).alias(f"std_{m}")]
    return scores.agg(*out)
