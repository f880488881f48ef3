"""Outcome labels, truth classes and evaluation cells, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.dates import leading_year, years_between

#: The day of the snapshot, the years without activity that count as failure, and funding types.
SNAPSHOT = "2024-08-01"
SILENT_YEARS = 5
LATE_FUNDING = ("series_b", "series_c", "private_equity", "post_ipo_equity")
EARLY_FUNDING = ("", "pre_seed", "seed", "angel", "equity_crowdfunding", "grant", "non_equity_assistance")
ACQUIRED = r"(?i)\b(has been acquired|was acquired|got acquired|acquired by|acquisition by)\b"
#: Labels that are a success, a failure, or neither.
SUCCESS = ("POSITIVE_IPO", "POSITIVE_LATE_STAGE_FUNDED", "POSITIVE_ACQUIRED", "EQUIVOCAL_DELISTED")
FAILURE = ("NEGATIVE_CLOSED", "NEGATIVE_NO_TRACTION")
AMBIGUOUS = ("INDETERMINATE", "UNKNOWN")
VERDICTS = ("PASS", "WARN", "FAIL")


def _text(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit("")))


def _day(x: Column) -> Column:
    return F.when(F.length(F.trim(x)) >= 10, F.try_to_date(F.substring(F.trim(x), 1, 10), "yyyy-MM-dd"))


def outcome_label(operating: Column, ipo: Column, funding: Column, founded: Column, last_funding: Column, growth: Column) -> Column:
    """One of eight labels, by the first rule that holds."""
    operating, ipo, funding = _text(operating), _text(ipo), _text(funding)
    snapshot = F.lit(SNAPSHOT).cast("date")
    age = years_between(snapshot, _day(founded))
    silent = F.coalesce(years_between(snapshot, _day(last_funding)), age)
    return (
        F.when(ipo == "public", "POSITIVE_IPO")
        .when(ipo == "delisted", "EQUIVOCAL_DELISTED")
        .when(F.coalesce(growth, F.lit("")).rlike(ACQUIRED), "POSITIVE_ACQUIRED")
        .when(operating == "closed", "NEGATIVE_CLOSED")
        .when((operating == "active") & funding.isin(*LATE_FUNDING), "POSITIVE_LATE_STAGE_FUNDED")
        .when((operating == "active") & funding.isin(*EARLY_FUNDING) & (age >= SILENT_YEARS) & (silent >= SILENT_YEARS), "NEGATIVE_NO_TRACTION")
        .when(operating == "active", "INDETERMINATE")
        .otherwise("UNKNOWN")
    )


def truth_class(label: Column) -> Column:
    return F.when(label.isin(*SUCCESS), "SUCCESS").when(label.isin(*FAILURE), "FAILURE").when(label.isin(*AMBIGUOUS), "AMBIG").otherwise("OTHER")


def evaluation_cell(verdict: Column, label: Column, ambiguous: str = "FILTER_truth_ambiguous") -> Column:
    """TP, FP, TN, FN; the given word for an ambiguous truth; UNEXPECTED for anything else. WARN counts as FAIL."""
    passed = verdict == "PASS"
    return (
        F.when(verdict.isNull() | ~verdict.isin(*VERDICTS), "UNEXPECTED")
        .when(label.isin(*AMBIGUOUS), ambiguous)
        .when(label.isin(*SUCCESS), F.when(passed, "TP").otherwise("FN"))
        .when(label.isin(*FAILURE), F.when(passed, "FP").otherwise("TN"))
        .otherwise("UNEXPECTED")
    )


def cohort_path(categories: Column, description: Column, wanted: tuple[str, ...], keywords: str | None = None) -> Column:
    """How a row enters the cohort: by a category of its comma list, by its description, or not (null)."""
    listed = F.filter(F.transform(F.split(F.coalesce(categories, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    found = F.when(F.arrays_overlap(listed, F.array(*map(F.lit, wanted))), "category")
    return found.when(F.coalesce(description, F.lit("")).rlike(f"(?i){keywords}"), "reverse_recall_keyword") if keywords else found


def founded_between(founded: Column, first: int = 2010, last: int = 2026) -> Column:
    return F.coalesce(leading_year(founded).between(first, last), F.lit(False))
