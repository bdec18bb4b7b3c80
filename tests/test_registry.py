import hashlib

from pyspark.sql import functions as F

from attestry import schemas
from attestry.operators import registry


def papers(spark, rows, **defaults):
    full = [{c: "" for c in schemas.PAPER_COLUMNS} | defaults | r for r in rows]
    return spark.createDataFrame([tuple(r[c] for c in schemas.PAPER_COLUMNS) for r in full], schemas.PAPER)


def test_period(spark):
    got = spark.createDataFrame([("2009",), ("2016",), ("20xx",), ("2015-03",), (None,), ("2030",)], "y string").select(schemas.period_of(F.col("y"))).collect()
    assert [r[0] for r in got] == ["≤2009", "2016-2020", "", "2010-2015", "", "2021-2026"]


def test_ids_continue_and_pass_a_hundred(spark):
    rows = [{"scholar_key": "AAA", "year": str(2000 + i), "title": "t"} for i in range(3)]
    got = {r.paper_id for r in registry.assign_ids(papers(spark, rows)).collect()}
    assert got == {"AAA-2000-01", "AAA-2001-01", "AAA-2002-01"}
    rows = [{"scholar_key": "B", "year": "2001", "title": "x", "paper_id": "B-2001-99"}, {"scholar_key": "B", "year": "2001", "title": "y"}, {"scholar_key": "B", "year": "", "title": "z"}]
    assert {r.paper_id for r in registry.assign_ids(papers(spark, rows)).collect()} == {"B-2001-99", "B-2001-100", "B-0000-01"}


def split_of(df):
    return {r.paper_id: r.split for r in df.collect()}


def test_sticky_split_under_growth(spark):
    rows = [{"scholar_key": "A", "paper_id": f"A-{i}", "seed_source": "1" if i == 0 else "0"} for i in range(10)]
    first = registry.assign_split(papers(spark, rows), 0.2, 1)
    one = split_of(first)
    order = sorted((f"A-{i}" for i in range(1, 10)), key=lambda p: hashlib.sha256(f"1:{p}".encode()).hexdigest())
    assert one["A-0"] == "train" and {k for k, v in one.items() if v == "heldout"} == set(order[:2])
    more = papers(spark, [{"scholar_key": "A", "paper_id": f"A-{i}"} for i in range(10, 15)])
    two = split_of(registry.assign_split(first.unionByName(more), 0.2, 1))
    assert all(two[k] == v for k, v in one.items()) and sum(v == "heldout" for v in two.values()) == 3


def test_quota_by_hash_equals_a_sort(spark):
    rows = [(g, f"{i}", hashlib.sha256(f"{g}{i}".encode()).hexdigest(), 37 if g else 250) for g in (0, 1) for i in range(300)]
    got = registry.first_by_hash(spark.createDataFrame(rows, "g int, id string, h string, q int"), "g", "h", "q", 1)
    chosen = {(r.g, r.id) for r in got.where("chosen").collect()}
    want = {(g, i) for g, q in ((0, 250), (1, 37)) for h, i in sorted((h, i) for gg, i, h, _ in rows if gg == g)[:q]}
    assert chosen == want and got.count() == 600


def test_import_drops_known_and_repeated_titles(spark):
    old = papers(spark, [{"paper_id": "A-2000-01", "title": "“治理”研究"}])
    new = papers(spark, [{"title": '"治理" 研究'}, {"title": "New"}, {"title": "NEW "}, {"title": "Other"}]).withColumn("rec", F.monotonically_increasing_id())
    fresh, counts = registry.import_rows(old, new, ["rec"])
    assert {r.title for r in fresh.collect()} == {"New", "Other"} and tuple(counts.first()) == (2, 2)


def test_plan_takes_held_out_first(spark):
    rows = [{"paper_id": f"A-{2000 + i}-01", "scholar_key": "A", "split": "heldout" if i < 4 else "train", "seed_source": "1" if i == 7 else "0", "period": str(i % 3), "paper_type": str(i % 2)} for i in range(20)]
    df = papers(spark, rows)
    plan = registry.acquisition_plan(df, spark.createDataFrame([("A-2001-01",)], "paper_id string"), 8).orderBy("rank").collect()
    assert len(plan) == 8 and [p.split for p in plan[:4]] == ["heldout"] * 4 and plan[4].paper_id == "A-2007-01"
    assert plan[1].have_fulltext == "yes" and "seed rule" in plan[4].why
    again = registry.acquisition_plan(df.repartition(3), spark.createDataFrame([("A-2001-01",)], "paper_id string"), 8).orderBy("rank").collect()
    assert plan == again and registry.plan_summary(spark.createDataFrame(plan)).first().planned == 8


def test_status(spark):
    df = papers(spark, [{"paper_id": "1", "scholar_key": "A", "verify_status": "verified", "split": "train", "period": "2016-2020"}, {"paper_id": "2", "scholar_key": "A", "verify_status": "partial", "period": "≤2009"}])
    ids = spark.createDataFrame([("1",)], "paper_id string")
    r = registry.status_table(df, ids, ids).first()
    assert (r.n, r.verified, r.partly, r.with_text, r.annotated, r.train, r.heldout, r.unsplit, r.periods) == (2, 1, 1, 1, 1, 1, 0, 1, "≤2009、2016-2020")


def test_select_rows(spark):
    df = papers(spark, [{"paper_id": "1", "scholar_key": "A", "split": "train"}, {"paper_id": "2", "scholar_key": "B", "split": "train"}])
    assert [r.paper_id for r in registry.select_rows(df, " 1 ,3", "A", "train").collect()] == ["1"]
    assert registry.select_rows(df).count() == 2
