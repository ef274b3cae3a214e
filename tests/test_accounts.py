from pyspark.sql import functions as F

from tracelore.catalog import accounts as catalog
from tracelore.catalog.base import Tables
from tracelore.operators import accounts as ac
from tracelore.session import prepare


def test_whitespace_whatever_the_parts(spark, monkeypatch):
    accounts = spark.createDataFrame([(i,) for i in range(6)], "account_id long")
    products = spark.createDataFrame([(f"p{i}",) for i in range(40)] + [("p1",)], "sku string")
    used = [(a, f"p{(a * 7 + i) % 45}") for a in range(5) for i in range(9)]
    usage = spark.createDataFrame(used + used[:5], "account_id long, sku string")
    want = {(a, f"p{i}") for a in range(6) for i in range(40)} - set(used)
    for most in (512, 7):
        monkeypatch.setattr(ac, "PART_SKUS", most)
        got = [tuple(r) for r in ac.whitespace(accounts, products, usage).collect()]
        assert len(got) == len(want) and set(got) == want


def test_null_marks_are_null_where_the_values_are(spark):
    rows = spark.createDataFrame([("long text", None, 2.5, 1), (None, [1.0, 2.0], None, 2)], "a string, b array<float>, c double, d int")
    got = ac.null_marks(rows, ["a", "b", "c"])
    assert got.dtypes == rows.dtypes and [tuple(r) for r in got.orderBy("d").collect()] == [("", None, 0.0, 1), (None, [], None, 2)]


def test_the_profile_joins_marks_instead_of_texts(spark, monkeypatch):
    seen, plain = {}, ac.schema_profile
    monkeypatch.setattr(ac, "schema_profile", lambda tables: seen.update(tables) or plain(tables))
    t = Tables(prepare(spark), "/root/testdata/sf0.001")
    got = catalog.model_profile(t).collect()
    widest = seen["learning"].agg(F.max(F.length("text")).alias("text"), F.max(F.size("embedding")).alias("embedding")).first()
    assert tuple(widest) == (0, 0)
    some = ("learning", "skill", "observation", "usage")
    want = plain({name: getattr(t, name) for name in some}).drop("type").collect()
    assert sorted(map(tuple, want)) == sorted(tuple(r) for r in got if r.table in some)


def test_flat_use_is_not_falling(spark):
    """Units that mirror themselves have a slope of zero, which sums of doubles miss by rounding; a line that falls by little still falls, and so does one of
    units too large for a decimal."""
    rows = [(a, at, float(1 + a * 37 % 250 * (m + 3) % 241) / (10 if a % 2 else 1)) for a in range(120) for m in range(1 + a % 9) for at in {m, 40 - m}]
    rows += [(200, at, 1e9 - (at == 39)) for at in range(40)] + [(201, at, 1e30 / (1 + at)) for at in range(3)] + [(202, 1, float("nan")), (202, 2, 1.0), (203, 1, 5.0), (203, 2, None)]
    usage = spark.createDataFrame(rows, "account_id long, at int, mau double").select("account_id", F.add_months(F.lit("1998-01-01").cast("date"), F.col("at")).alias("month"), "mau")
    assert {r.account_id for r in ac.falling_use(usage.repartition(7)).filter("falling").collect()} == {200, 201}
    lines = usage.withColumns({"sku": F.lit("a"), "monthly_revenue": F.lit(1.0), "contracted_seats": F.lit(1.0)})
    soon = F.lit("2024-02-01").cast("date")
    known = spark.range(300).select(F.col("id").alias("account_id"), F.lit("steady").alias("trajectory"), F.lit(80).alias("health_score"), soon.alias("renewal_date"))
    assert {(r.account_id, r.reasons) for r in ac.renewal_risk(known, lines, soon).collect()} == {(200, "falling"), (201, "falling")}
