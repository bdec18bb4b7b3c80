import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from attestry.operators import mining, rules
from attestry.operators.rules import Admission, Rule

ADMISSION = Admission(3, 2, 1.5, 0.6, 4)
PERIODS = ("≤2009", "2010-2015", "2016-2020", "2021-2026")


@pytest.fixture(scope="module")
def records(spark):
    rows = [(f"A{i}", "A", PERIODS[i], "train", ["PZ-ANOMALY", "MECH-TENSION"], []) for i in range(4)]
    rows += [(f"B{i}", "B", PERIODS[i], "train", ["PZ-VARIATION", "CON-IDEALTYPE"], ["boundary_conditions"]) for i in range(4)]
    rows += [("A9", "A", PERIODS[0], "heldout", ["PZ-ANOMALY", "MECH-TENSION"], [])]
    return spark.createDataFrame(rows, "paper_id string, scholar_key string, period string, split string, codes array<string>, fields array<string>")


RULES = [
    Rule("SH-X", "SH", "shared", ("PZ-*",)), Rule("IL-X", "IL", "archetype", ("PZ-ANOMALY|PZ-PERSISTENCE", "MECH-TENSION"), keys=("A",), candidate_sources=("A0", "A1", "B0", "A9")),
    Rule("IL-Y", "IL", "archetype", ("MECH-HISTORICAL",), keys=("A",)), Rule("CE-X", "CE", "archetype", ("CON-IDEALTYPE", "field:boundary_conditions"), keys=("B",)), Rule("E", "CE", "archetype", (), keys=("B",)),
]


def test_support(spark, records):
    got = {r.rule_id: r for r in rules.support(records, RULES, ADMISSION).collect()}
    assert got["SH-X"].passed and got["SH-X"].n_support == 8 and got["SH-X"].share == 1.0
    assert got["IL-X"].passed and got["IL-X"].n_support == 4 and got["IL-X"].suggestion == "candidate" and got["IL-X"].lift == pytest.approx(9.0)
    assert got["IL-Y"].suggestion == "rejected" and got["CE-X"].lift == pytest.approx(9.0) and got["E"].n_support == 0
    late = {r.rule_id: r.suggestion for r in rules.support(records, RULES, Admission(3, 2, 1.5, 0.6, 10)).collect()}
    assert late["IL-Y"] == "insufficient_data"
    assert got["IL-X"].periods == list(PERIODS)


def test_held_out_records_do_not_count(spark, records):
    alone = {r.rule_id: r.n_support for r in rules.support(records.where("split <> 'heldout'"), RULES, ADMISSION).collect()}
    assert alone == {r.rule_id: r.n_support for r in rules.support(records, RULES, ADMISSION).collect()}


def test_candidate_hits(spark, records):
    r = rules.candidate_hits(records, RULES).where("rule_id = 'IL-X'").first()
    assert (r.candidate_annotated, r.candidate_hits) == (3, 2)
    assert {x.paper_id for x in rules.support_papers(records, RULES).where("rule_id = 'IL-X'").collect()} == {"A0", "A1", "A2", "A3"}


def test_a_record_without_a_split_raises(spark, records):
    bad = spark.createDataFrame([("Z", "A", "", "", ["X"], [])], records.schema)
    with pytest.raises(Exception, match="records without a split, e.g. Z"):
        rules.support(records.unionByName(bad), RULES, ADMISSION).collect()
    assert rules.support(records.unionByName(bad), RULES, ADMISSION, allow_unsplit=True).count() == 5


def test_matrix_and_cover(spark, records):
    m = {r.code: (r.A, r.B) for r in rules.code_matrix(records).collect()}
    assert m["PZ-ANOMALY"] == (4, 0) and m["CON-IDEALTYPE"] == (0, 4)
    combos = spark.createDataFrame([("A", ["MECH-TENSION", "PZ-ANOMALY"]), ("B", ["PZ-ANOMALY"])], "scholar_key string, combo array<string>")
    assert {r.scholar_key: r.covered for r in rules.covering_rules(combos, RULES).collect()} == {"A": ["IL-X"], "B": []}


def test_mining(spark, records):
    got = mining.mine(records, ADMISSION).orderBy("scholar_key", "place").collect()
    a = [r for r in got if r.scholar_key == "A"]
    assert [tuple(r.combo) for r in a] == [("MECH-TENSION",), ("PZ-ANOMALY",), ("MECH-TENSION", "PZ-ANOMALY")] and all(r.n == 4 and r.n_out == 0 for r in a)


def test_mining_equals_brute_force_for_records_of_any_size(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        codes = rng.sample([f"C-{k}" for k in range(12)], rng.randint(0, 6))
        codes += [f"R-{i}-{k}" for k in range(300)] if i < 2 else []
        rows.append((f"p{i}", rng.choice("AB"), rng.choice(["1", "2", None]), "train", codes + codes[:1], []))
    rows += [("q", "A", "1", "heldout", ["C-0"] * 2, [])]
    df = spark.createDataFrame(rows, "paper_id string, scholar_key string, period string, split string, codes array<string>, fields array<string>")
    a = rules.Admission(min_papers=3, min_periods=2, min_lift=1.2)
    n, periods, inside = Counter(), defaultdict(set), Counter()
    for _, key, period, split, codes, _ in rows:
        if split != "train":
            continue
        inside[key] += 1
        few = sorted(c for c in set(codes) if c.startswith("C-"))  # the others are in one record each
        for size in (1, 2, 3):
            for combo in combinations(few, size):
                n[key, combo] += 1
                periods[key, combo].add(period or "")
    want = set()
    for (key, combo), k in n.items():
        other = "B" if key == "A" else "A"
        lift = ((k + 0.5) / (inside[key] + 1)) / ((n[other, combo] + 0.5) / (inside[other] + 1))
        if k >= 3 and len(periods[key, combo]) >= 2 and lift >= 1.2:
            want.add((key, combo, k, n[other, combo], round(lift, 9)))
    got = mining.mine(df, a, top=10_000).collect()
    assert len(got) == len(want) > 20 and {(r.scholar_key, tuple(r.combo), r.n, r.n_out, round(r.lift, 9)) for r in got} == want
