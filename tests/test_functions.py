import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from eventloom.functions import dates, names, outcomes, stats
from eventloom.plans import catalog_entities


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "text, lo, hi, precision",
    [
        ("2024", "2024-01-01", "2024-12-31", "year"),
        ("2024-02", "2024-02-01", "2024-02-29", "month"),
        ("2023-02-28", "2023-02-28", "2023-02-28", "day"),
        ("2023-02-28T10:00", "2023-02-28", "2023-02-28", "day"),
    ],
)
def test_partial_date(spark, text, lo, hi, precision):
    found = one(spark, dates.partial_date(F.col("t")), t=text)
    assert (str(found.lo), str(found.hi), found.precision) == (lo, hi, precision)


@pytest.mark.parametrize("text", ["2024-02-30", "2024Q1", "", "20245", "2024-13", "abcd"])
def test_invalid_partial_date(spark, text):
    assert one(spark, dates.partial_date(F.col("t")), t=text) is None
    assert one(spark, dates.valid_partial_date(F.col("t")), t=text) is None


def test_strict_partial_date(spark):
    assert one(spark, dates.strict_partial_date(F.col("t")), t="2023-02-28T10:00") is None
    assert one(spark, dates.strict_partial_date(F.col("t")), t="2023-02").hi == dt.date(2023, 2, 28)


@pytest.mark.parametrize("text, day", [("2020", "2020-01-01"), ("2020-05", "2020-05-01"), ("2020-05-06 10:00", "2020-05-06"), ("unknown", None), ("nan", None), ("2020-13", None)])
def test_boundary_date(spark, text, day):
    assert one(spark, dates.boundary_date(F.col("t")).cast("string"), t=text) == day


@pytest.mark.parametrize("raw, name", [("Sequoia Capital", "sequoia"), ("Andreessen Horowitz", "andreessen horowitz"), ("Bain Capital Ventures", "bain"), (" A-B,  Inc. ", "a-b"), ("Fund", ""), ("Éclair Ventures", "éclair")])
def test_normalize_name(spark, raw, name):
    assert one(spark, names.normalize_name(F.col("t")), t=raw) == name


@pytest.mark.parametrize("raw, name", [("Acme, Inc.", "acme"), ("Global Holdings", "global holdings"), ("A-B Corp", "a b")])
def test_normalize_company_name(spark, raw, name):
    assert one(spark, names.normalize_company_name(F.col("t")), t=raw) == name


@pytest.mark.parametrize(
    "file, name",
    [
        ("databricks-horizontal.webp", "databricks"),
        ("OpenAI-Logo-2022.png", "OpenAI"),
        ("Wiz.png", "Wiz"),
        ("Northwind_logo.png", "Northwind"),
        ("Flank_Logotype_Black.png", "Flank"),
        ("writer-KO.png", "writer"),
        ("Calm-e1568058016375.png", "Calm"),
        ("crew_ai_transparent.png", "crew_ai"),
        ("weights-biases.png", "weights_biases"),
        ("zest_logo_2.png", "zest"),
    ],
)
def test_name_from_logo(spark, file, name):
    assert one(spark, names.name_from_logo(F.col("t")), t=f"https://x.com/a/{file}?v=1") == name


@pytest.mark.parametrize("raw, site, domain", [("WWW.Foo.COM/vc/", "https://www.foo.com/vc", "foo.com"), ("http://A.b.co.uk?x=1", "http://a.b.co.uk?x=1", "co.uk"), ("", None, None)])
def test_websites(spark, raw, site, domain):
    assert one(spark, names.normalize_website(F.col("t")), t=raw) == site
    assert one(spark, names.extract_domain(names.normalize_website(F.col("t"))), t=raw) == domain


@pytest.mark.parametrize("raw, found", [("Héllo Wörld", "hello-world"), ("_a_  b!", "a--b"), ("東京 Labs", "東京-labs"), ("a" * 60, "a" * 50)])
def test_slug(spark, raw, found):
    assert one(spark, names.slug(F.col("t")), t=raw).strip("-") == found


def test_slug_query_reads_the_whole_text(spark, tmp_path):
    texts = ["... " * 40 + "Late Wörds", "a " * 60, "é" * 70, "...  \u0301" * 20 + "東京 x", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.slug for r in catalog_entities.make_slug_unicode(spark, str(tmp_path)).collect()}
    assert found == {0: "late-words", 1: "a-" * 25, 2: "e" * 50, 3: "東京-x", 4: None, 5: ""}


@pytest.mark.parametrize("raw, bucket", [("Series A", "series_a"), ("Serie B 2", "series_b"), ("Seed Round", "seed"), ("bridge loan", "bridge_or_extension"), ("N/A", "unknown"), ("", "unknown"), ("growth", "other"), ("Pre-Seed", "pre_seed")])
def test_round_bucket(spark, raw, bucket):
    assert one(spark, names.round_bucket(F.col("t")), t=raw) == bucket


def test_template(spark):
    assert one(spark, names.fill_template("{{a}} in {{b}}", {"a": F.col("t")}), t="x") == "x in <null:b>"


@pytest.mark.parametrize(
    "operating, ipo, funding, founded, last, growth, label",
    [
        ("active", "public", None, None, None, None, "POSITIVE_IPO"),
        ("active", "delisted", None, None, None, None, "EQUIVOCAL_DELISTED"),
        ("closed", None, None, None, None, None, "NEGATIVE_CLOSED"),
        ("active", None, "series_b", None, None, None, "POSITIVE_LATE_STAGE_FUNDED"),
        ("active", None, "private_equity", None, None, None, "POSITIVE_LATE_STAGE_FUNDED"),
        ("active", None, "seed", "2015-01-01", "2015-06-01", None, "NEGATIVE_NO_TRACTION"),
        ("active", None, "seed", "2022-01-01", "2022-06-01", None, "INDETERMINATE"),
        ("active", None, "series_a", "2018-01-01", "2020-01-01", None, "INDETERMINATE"),
        ("", "", None, None, None, None, "UNKNOWN"),
        ("active", "private", "series_unknown", None, None, "x has been acquired by y", "POSITIVE_ACQUIRED"),
        ("active", "private", None, None, None, "x was acquired by y", "POSITIVE_ACQUIRED"),
        ("active", "private", None, None, None, "x has been acquiring y", "INDETERMINATE"),
    ],
)
def test_outcome_label(spark, operating, ipo, funding, founded, last, growth, label):
    values = [F.lit(x).cast("string") for x in (operating, ipo, funding, founded, last, growth)]
    assert one(spark, outcomes.outcome_label(*values)) == label


@pytest.mark.parametrize("verdict", ["PASS", "WARN", "FAIL"])
def test_evaluation_cells(spark, verdict):
    cells = {x: one(spark, outcomes.evaluation_cell(F.lit(verdict), F.lit(x))) for x in outcomes.SUCCESS + outcomes.FAILURE + outcomes.AMBIGUOUS}
    assert {cells[x] for x in outcomes.SUCCESS} == {"TP" if verdict == "PASS" else "FN"}
    assert {cells[x] for x in outcomes.FAILURE} == {"FP" if verdict == "PASS" else "TN"}
    assert {cells[x] for x in outcomes.AMBIGUOUS} == {"FILTER_truth_ambiguous"}


@pytest.mark.parametrize("dollars, score", [(1e7, 0.0), (1e8, 1 / 3), (1e9, 2 / 3), (1e10, 1.0), (1e12, 1.0), (0.0, 0.0)])
def test_market_score(spark, dollars, score):
    assert one(spark, stats.market_score(F.lit(dollars))) == pytest.approx(score)


@pytest.mark.parametrize("m, u, score, verdict, driver", [("PASS", "FAIL", 0.5, "PASS", "U"), ("WARN", "FAIL", 0.25, "WARN", "U"), ("FAIL", "FAIL", 0.0, "FAIL", "M"), ("FAIL", "PASS", 0.5, "PASS", "M")])
def test_aggregate(spark, m, u, score, verdict, driver):
    found = stats.aggregate_score(F.lit(m), F.lit(u))
    assert one(spark, found) == score
    assert one(spark, stats.aggregate_verdict(found)) == verdict
    assert one(spark, stats.dominant_driver(F.lit(m), F.lit(u))) == driver


@pytest.mark.parametrize("s1, n1, s0, n0", [(30, 40, 20, 60), (5, 50, 30, 60), (10, 20, 30, 60), (500, 1000, 505, 1000), (3, 3, 7, 7)])
def test_action_value(spark, s1, n1, s0, n0):
    args = [F.lit(x) for x in (s1, n1, s0, n0)]
    f1, f0 = n1 - s1, n0 - s0
    below = n1 * n0 * (s1 + s0) * (f1 + f0)
    chi2 = (n1 + n0) * (s1 * f0 - f1 * s0) ** 2 / below if below else 0.0
    p = math.erfc(math.sqrt(chi2 / 2))
    p1, p0 = s1 / n1, s0 / n0
    se = math.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)
    cdf = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
    tost = max(1 - cdf((p1 - p0 + 0.05) / se), cdf((p1 - p0 - 0.05) / se)) if se else (0.0 if abs(p1 - p0) < 0.05 else 1.0)
    want = ("RECOMMEND" if p1 > p0 else "AVOID") if p < 0.05 else "INDIFFERENT" if tost < 0.05 else "INCONCLUSIVE"
    assert one(spark, stats.action_value(*args)) == want
    assert one(spark, stats.chi2_p(stats.chi_square(*args))) == pytest.approx(p)
