"""Hand-computed rows of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from lexloom.functions import courts, rulings, text


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).cast("string").alias(k) if v is None or isinstance(v, str) else F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "name,want",
    [("United States v. Smith & Co.", "smith corp"), ("Acme Company, Inc. vs. Jones", "acme corp corp jones"), ("In re Doe", "doe"), ("Smith h/w", "smith spouse"), (None, ""), ("  ", ""), ("José v. Müller", "josé müller")],
)
def test_normalize(spark, name, want):
    assert one(spark, text.normalize_caption(F.col("s")), s=name) == want


@pytest.mark.parametrize("s,want", [("1999-02-03", "1999-02-03 00:00:00"), ("1999-02-03 04:05:06", "1999-02-03 04:05:06"), ("1999-02-30", None), ("soon", None), ("", None), (None, None)])
def test_to_time(spark, s, want):
    got = one(spark, text.to_time(F.col("s")), s=s)
    assert (str(got) if got else None) == want


@pytest.mark.parametrize(
    "name,want",
    [
        ("USA v. Smith", ("usa", "smith")), ("Doe vs Roe", ("doe", "roe")), ("State versus Roe", ("state", "roe")), ("A v. B v. C", ("a v. b", "c")),
        ("USA v. Johnny V. Brown", ("usa v. johnny", "brown")), ("In re Doe", (None, None)), ("v. Smith", (None, None)), (None, (None, None)),
    ],
)
def test_split(spark, name, want):
    assert tuple(one(spark, text.split_caption(F.col("s")), s=name)) == want


def test_dockets(spark):
    f = lambda s: one(spark, text.docket_tokens(F.col("s")), s=s)
    assert f("Nos. 12-345, 12-346") == ["12-345", "12-346"] and f("1:20-cv-00123") == ["120-CV-00123"] and f("No. 7; A/B") == ["7", "A", "B"] and f(None) == []
    g = lambda s: one(spark, text.first_dockets(F.col("s")), s=s)
    assert g("Appeal. No. 12-345 (D.N.J.)") == ["12-345"] and g("No. 12-345 Appeal from\nX") == ["12-345", "APPEAL", "FROM"] and g(None) == []


def test_names(spark):
    f = lambda s: sorted(one(spark, text.judge_needles(F.col("s")), s=s))
    assert f("JOHN A. SMITH, JR., District Judge") == ["JOHN SMITH", "SMITH"] and f("Dix") == [] and f("Smith and Jones") == ["Jones", "Smith"] and f("O'Brien") == ["Brien", "O Brien"] and f(None) == []
    g = lambda t, n: one(spark, text.contains_any(F.col("t"), F.col("n")), t=t, n=n)
    assert not g("Smithson ruled", ["Smith"]) and g("by john smithson", ["John Smith"]) and not g(None, ["A"]) and g("Judge Smith.", ["Smith"])
    h = lambda s: tuple(one(spark, text.split_name(F.col("s")), s=s))
    assert h("William G. Young, Jr.") == ("William", "Young") and h("Hon. Jane Doe,") == ("Jane", "Doe") and h("") == ("", "")
    assert one(spark, text.strip_honorifics(F.col("s")), s="Hon. Jane Doe,") == "Jane Doe"


def test_ids_and_lists(spark):
    f = lambda s: one(spark, text.norm_id(F.col("s")), s=s)
    assert [f(x) for x in ("12.0", " 5 ", "x.0", "12.50", None)] == ["12", "5", "x.0", "12.50", None]
    assert one(spark, text.canon(F.col("s")), s="S.D.N.Y.") == "sdny"
    g = lambda s: one(spark, text.infer_circuit(F.col("s")), s=s)
    assert g("United States Court of Appeals for the Third Circuit") == "third" and g("D.C. Circuit") is None and g("Third District") is None
    c = lambda s: one(spark, text.norm_circuit(F.col("s")), s=s)
    assert c("3rd") == "ca3" and c("11th") == "ca11"
    with pytest.raises(Exception, match="not a numbered circuit"):
        c("dc")
    assert one(spark, text.norm_string(F.col("s")), s="  123 F.3d   45 ") == "123 f.3d 45"
    lists = lambda s: one(spark, text.to_list(F.col("s")), s=s)
    assert lists(None) == [] and lists("a, b,,c") == ["a", "b", "c"] and lists("['a','b']") == ["a", "b"]
    t = lambda n: one(spark, text.truncate_middle(F.col("a"), 2), a=n)
    assert t(list("12345")) == list("1245") and t(list("123")) == list("1223") and t(list("12")) == list("12")


@pytest.mark.parametrize(
    "name,body,want",
    [
        ("United States v. Doe", "The court granted the motion to suppress", 0), ("Doe v. United States", "granted the motion to suppress", 1), ("Doe v. Roe", "denied the motion to suppress", 1),
        ("Doe v. Roe", "judgment for the defendant", 0), ("x", " ", None), ("x", None, None), (None, "demurrer sustained", 0), ("x", "granted\nmotion to suppress", None),
    ],
)
def test_us_support(spark, name, body, want):
    assert one(spark, rulings.us_support(F.col("n"), F.col("t")), n=name, t=body) == want


def test_extraction(spark):
    f = lambda s, c: one(spark, courts.extract_judge(F.col("s"), c), s=s)
    assert f("[Hon. William G. Young, U.S. District Judge]", "1st") == "William G. Young"
    assert f("No. 15-cv-1, Edgardo Ramos, Judge.", "2nd") == "Edgardo Ramos"
    assert f("District Judge: Hon. Ann Lee", "3rd") == "Ann Lee"
    assert f("x\nAnn Lee, D.J.\n", "5th") == "Ann Lee" and f("", "5th") == "" and f(None, "5th") == ""
    g = lambda s: one(spark, courts.extract_court(F.col("s")), s=s)
    assert g("On appeal from the United States District Court for the District of Maine, x") == "District of Maine" and g("Appeal from: D.N.J.") == "D.N.J" and g("none") == ""
    m = lambda s: one(spark, courts.mentions_trial_court(F.col("s")), s=s)
    assert m("On Appeal from x") and m("a District Judge.") and not m("reappeal from") and not m(None)
