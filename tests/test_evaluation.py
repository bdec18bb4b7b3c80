import pytest
from pyspark.sql import functions as F

from attestry.operators import blind, comments, holdout
from attestry.operators.integrity import IntegrityError


def sheets(spark, n_items, value_of):
    """Sheets of two raters for items with outputs a (baseline) and b, through the key."""
    items = spark.createDataFrame([(f"i{i}", "d", {"a": "x", "b": "y"}) for i in range(n_items)], "item_id string, draft string, outputs map<string,string>")
    key = blind.blind_key(items)
    packed = blind.packets(items, key, 2)
    filled = packed.join(key, ["item_id", "label"]).drop("output", "draft", "place")
    cols = [F.udf(lambda s, d=d: str(value_of(s, d)), "string")("system").alias(d) for d in blind.DIMENSIONS]
    fab = F.udf(lambda s, i: str(value_of(s, i)), "string")("system", "item_id").alias("fabrications")
    return key, filled.select("item_id", "label", "rater", *cols, fab)


def test_round_trip_and_scores(spark):
    key, s = sheets(spark, 6, lambda system, d: 0 if d.startswith("i") else 3 if system == "a" else 4)
    ratings, fab = blind.load_ratings(s, key)
    got = {r.dim: r for r in blind.versus_baseline(ratings, "a", n_boot=100).collect()}
    assert got["D1"]["mean"] == 1.0 and got["D7"].noninferior and got["D8"].noninferior and got["D1"].noninferior is None
    assert {r.rate for r in blind.fabrication_rates(fab).collect()} == {0.0}
    assert blind.fabrication_versus_baseline(fab, "a", n_boot=100).first().noninferior
    assert {r["mean"] for r in blind.system_means(ratings).where("system = 'b'").collect()} == {4.0}


def test_harm_gate_fails(spark):
    def value(system, d):
        if d.startswith("i"):
            return int(system == "b" and int(d[1:]) % 2 == 0)
        return {"a": 4 if d in blind.HARM else 3, "b": 2 if d in blind.HARM else 5}[system]

    key, s = sheets(spark, 10, value)
    ratings, fab = blind.load_ratings(s, key)
    got = {r.dim: r for r in blind.versus_baseline(ratings, "a", n_boot=200).collect()}
    assert got["D1"]["mean"] > 0 and not got["D7"].noninferior and not got["D8"].noninferior
    assert not blind.fabrication_versus_baseline(fab, "a", n_boot=200).first().noninferior
    assert blind.fabrication_rates(fab).where("system = 'b'").first().rate == 0.5
    assert blind.alpha_by_dimension(ratings).where("dim = 'D1'").first().alpha == 1.0


def test_bad_sheets_raise(spark):
    key, s = sheets(spark, 2, lambda system, d: 0 if d.startswith("i") else 3)
    with pytest.raises(IntegrityError, match="labels"):
        blind.load_ratings(s.withColumn("label", F.lit("Z")), key)
    with pytest.raises(IntegrityError, match="1..5"):
        blind.load_ratings(s.withColumn("D1", F.lit("6")), key)
    with pytest.raises(IntegrityError, match="whole"):
        blind.load_ratings(s.withColumn("fabrications", F.lit("-1")), key)
    with pytest.raises(ValueError, match="baseline"):
        blind.versus_baseline(blind.load_ratings(s, key)[0], "none")
    assert blind.load_ratings(s.withColumn("D1", F.lit(" ")), key)[0].where("dim = 'D1'").count() == 0


@pytest.fixture(scope="module")
def gold(spark):
    codes = spark.createDataFrame([("PZ-A", "PZ"), ("PZ-B", "PZ"), ("GAP-A", "GAP")], "code string, family string")
    rows = [("t1", "train", ["PZ-A", "GAP-A"]), ("t2", "train", ["PZ-A", "PZ-B"]), ("t3", "train", ["PZ-A"]), ("h1", "heldout", ["PZ-A", "GAP-A"]), ("h2", "heldout", [])]
    return codes, holdout.gold_sets(spark.createDataFrame(rows, "paper_id string, split string, codes array<string>"), codes, ("PZ", "GAP"))


def test_trivial_predictors(spark, gold):
    codes, g = gold
    assert {r.family: r.pred for r in holdout.majority(g).collect()} == {"PZ": ["PZ-A"], "GAP": ["GAP-A"]}
    one = {r.paper_id: r.score for r in holdout.random_scores(g, 5).collect()}
    assert one == {r.paper_id: r.score for r in holdout.random_scores(g.repartition(3), 5).collect()} and 0 <= one["h1"] <= 1


def test_replies_scores_and_contrasts(spark, gold):
    codes, g = gold
    replies = spark.createDataFrame([("h1", "rules", '{"PZ": ["PZ-A", "GAP-A", "PZ-B"], "GAP": ["GAP-A"]}'), ("h1", "baseline", "nothing"), ("h2", "rules", '{"PZ": []}'), ("h2", "baseline", "{}")], "paper_id string, system string, reply string")
    parsed = holdout.parsed_predictions(replies, codes, ("PZ", "GAP"))
    assert {(r.system, r.family): r.pred for r in parsed.where("paper_id = 'h1'").collect()} == {("rules", "PZ"): ["PZ-A", "PZ-B"], ("rules", "GAP"): ["GAP-A"], ("baseline", "PZ"): [], ("baseline", "GAP"): []}
    s = holdout.scores(parsed, g)
    got = {(r.paper_id, r.system): r.score for r in s.collect()}
    assert got[("h1", "rules")] == pytest.approx((2 / 3 + 1) / 2) and got[("h1", "baseline")] == 0 and got[("h2", "rules")] is None
    c = holdout.contrasts(s, n_boot=50).collect()
    assert [(r.contrast, r.n) for r in c] == [("rules - baseline", 2)] and c[0]["mean"] == pytest.approx(0.8333, abs=1e-4)
    assert {r.system: r.n for r in holdout.summary(s).collect()} == {"rules": 1, "baseline": 1}


def test_prompts(spark):
    lenses = spark.createDataFrame([("SH", "Shared", False, [], ["Why?"]), ("IL", "Logics", True, ["Someone"], []), ("W", "Writing", False, [], [])], "lens string, name string, panel boolean, scholars array<string>, questions array<string>")
    rules = spark.createDataFrame([("R1", "SH", "seed", "x.", "do y"), ("R2", "IL", "rejected", "a", "b"), ("R3", "IL", "seed", "a", "b"), ("R4", "W", "seed", "a", "b")], "rule_id string, lens string, status string, trigger string, action string")
    block = holdout.rules_block(rules, lenses, True)
    assert "R1: when x, do y" in block and "Someone" in block and "R2" not in block and "R4" not in block
    held = spark.createDataFrame([("p", "T", "abcd", '["x","y"]')], "paper_id string, title string, abstract string, evidence string")
    got = holdout.prompts(held, "{{RULES}}|{{TITLE}}|{{ABSTRACT_HALF}}|{{EVIDENCE}}", "", {"baseline": "", "rules": "R"}).orderBy("system").collect()
    assert [r.prompt for r in got] == ["|T|ab|x；y", "R|T|ab|x；y"]


def test_comments(spark):
    rows = [("1", "a", "d1", "t", ["Q1"], ["M"], True), ("2", "a", "d2", "t", ["Q1", "Q1"], None, True), ("3", "a", None, "t", ["bad"], [], None)]
    df = spark.createDataFrame(rows, "comment_id string, advisor string, draft_id string, comment_text string, defect_codes array<string>, move_codes array<string>, generalizable boolean")
    got = {r.code: r for r in comments.aggregate(df).collect()}
    assert (got["Q1"].n, got["Q1"].n_drafts, got["Q1"].share, got["Q1"].candidate) == (3, 2, 1.0, True) and not got["M"].candidate and got["bad"].n_drafts == 1
    assert {r.comment_id for r in comments.invalid(df).collect()} == {"3"}


def test_a_random_draw_has_as_many_codes_as_it_should(spark, monkeypatch):
    """Where tries run out, free places make up the rest: k of k places are all codes."""
    monkeypatch.setattr(holdout, "SPARE", 0)
    rows = [(f"t{i}", "train", "PZ", [f"PZ-{k}" for k in range(4)]) for i in range(1)] + [("h", "heldout", "PZ", [f"PZ-{k}" for k in range(4)])]
    gold = spark.createDataFrame(rows, "paper_id string, split string, family string, gold array<string>")
    assert holdout.random_scores(gold).first().score == 1.0


def test_random_scores_make_no_row_for_a_draw(spark, gold):
    from hashlib import md5

    _, g = gold
    assert "draw" not in holdout.random_scores(g)._jdf.queryExecution().optimizedPlan().toString()
    pool = {"PZ": ["PZ-A"] * 3 + ["PZ-B"], "GAP": ["GAP-A"]}
    have = {"PZ": {"PZ-A"}, "GAP": {"GAP-A"}}
    picked = lambda d, f: pool[f][int(md5(f"0:h1:{d}:{f}:1".encode()).hexdigest()[:8], 16) % len(pool[f])]
    want = sum((picked(d, f) in have[f]) / 2 for d in range(1, 21) for f in have) / 20
    assert round({r.paper_id: r.score for r in holdout.random_scores(g).collect()}["h1"], 9) == round(want, 9)


def test_gold_sets_move_no_rows_and_scores_move_a_row_for_each_paper(spark, gold):
    codes, _ = gold
    records = spark.range(8).select("id").selectExpr("cast(id as string) as paper_id", "if(id < 6, 'train', 'heldout') as split", "array('PZ-A', 'PZ-A', 'GAP-A') as codes")
    g = holdout.gold_sets(records, codes, ("PZ", "GAP", "NONE"))
    moved = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(paper_id" in x]
    assert not moved(g)
    assert {(r.family, tuple(r.gold)) for r in g.collect()} == {("PZ", ("PZ-A",)), ("GAP", ("GAP-A",)), ("NONE", ())}
    pred = g.where("split = 'heldout'").select("paper_id", F.lit("s").alias("system"), "family", F.array(F.lit("PZ-A")).alias("pred")).where("family = 'PZ'")
    s = holdout.scores(pred, g)
    assert len(moved(s)) == 2 and {r.score for r in s.collect()} == {0.5}
