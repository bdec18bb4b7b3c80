import pytest
from pyspark.sql import functions as F

from attestry.operators import agreement


def test_kappa(spark):
    rows = [("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15
    assert agreement.cohen_kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first().kappa == pytest.approx(0.4)
    assert agreement.cohen_kappa(spark.createDataFrame([("y", "y")] * 3, "a string, b string"), "a", "b").first().kappa == 1.0
    assert agreement.cohen_kappa(spark.createDataFrame([], "a string, b string"), "a", "b").first().kappa is None


def test_family_kappa_counts_absent_codes(spark):
    codes = spark.createDataFrame([("X-1", "X"), ("X-2", "X"), ("Y-1", "Y")], "code string, family string")
    a = spark.createDataFrame([("p", ["X-1"]), ("q", ["X-1", "X-2"]), ("only", ["Y-1"])], "paper_id string, codes array<string>")
    b = spark.createDataFrame([("p", ["X-1"]), ("q", ["X-1"])], "paper_id string, codes array<string>")
    got = {r.family: r for r in agreement.family_kappa(a, b, codes).collect()}
    assert got["X"].n == 4 and got["X"].kappa == pytest.approx(0.5) and got["X"].flagged
    assert got["Y"].kappa == 1.0 and not got["Y"].flagged


# The published example of four coders and twelve units, and its coefficients.
CODERS = [
    [1, 2, 3, 3, 2, 1, 4, 1, 2, None, None, None], [1, 2, 3, 3, 2, 2, 4, 1, 2, 5, None, 3],
    [None, 3, 3, 3, 2, 3, 4, 2, 2, 5, 1, None], [1, 2, 3, 3, 2, 4, 4, 1, 2, 5, 1, None],
]


def test_alpha(spark):
    rows = [(u, c, v) for c, row in enumerate(CODERS) for u, v in enumerate(row)]
    df = spark.createDataFrame(rows, "unit int, coder int, v int")
    assert agreement.krippendorff_alpha(df, ["unit"], "v", "nominal").first().alpha == pytest.approx(0.743, abs=5e-4)
    assert agreement.krippendorff_alpha(df, ["unit"], "v", "interval").first().alpha == pytest.approx(0.849, abs=5e-4)
    same = spark.createDataFrame([(1, 2), (1, 2), (2, 2), (2, 2)], "unit int, v int")
    assert agreement.krippendorff_alpha(same, ["unit"], "v", "interval").first().alpha == 1.0


def test_bootstrap_repeats_and_brackets(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([0.5, 1.0, -0.25, 0.75, 0.0, 1.5, 0.25, None])], "i int, d double")
    one = agreement.bootstrap(df, "d", ["i"], n_boot=400, seed=3).first()
    two = agreement.bootstrap(df.repartition(3), "d", ["i"], n_boot=400, seed=3).first()
    assert one == two and one.n == 7 and one.lo <= one["mean"] <= one.hi


def test_set_f1(spark):
    df = spark.createDataFrame([([], []), (["A"], []), (["A", "B"], ["A"])], "p array<string>, g array<string>")
    got = [r[0] for r in df.select(agreement.set_f1(F.col("p"), F.col("g"))).collect()]
    assert got[0] is None and got[1] == 0.0 and got[2] == pytest.approx(2 / 3)


def test_bootstrap_of_many_units_draws_as_the_hashes_say(spark):
    from hashlib import md5

    some = [(i, float(i * i % 17)) for i in range(1, 121)]
    got = agreement.bootstrap(spark.createDataFrame(some, "i long, d double").repartition(3), "d", ["i"], n_boot=40, seed=3).first()
    means = sorted(sum(some[int(md5(f"3:{b}:{i}".encode()).hexdigest()[:8], 16) % 120][1] for i in range(120)) / 120 for b in range(40))
    assert (got.n, round(got.lo, 9), round(got.hi, 9)) == (120, round(means[1], 9), round(means[38], 9))
    many = spark.range(1_000_001).select("id", (F.col("id") % 2).cast("double").alias("d"))
    got = agreement.bootstrap(many, "d", ["id"], n_boot=3).first()
    assert got.n == 1_000_001 and got.lo <= got.hi and abs(got.lo - 0.5) < 0.01 and abs(got["mean"] - 0.5) < 1e-5
