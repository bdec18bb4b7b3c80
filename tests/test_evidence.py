import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry import schemas
from attestry.functions import text as tx
from attestry.operators import annotations, evidence

TEXT = "第一段讨论制度逻辑的变迁过程。\n\n第二段说明基层政府如何执行上级政策。\n\n第三段给出结论与边界条件。"


@pytest.fixture(scope="module")
def prepared(spark):
    return evidence.prepared_texts(spark.createDataFrame([("p", TEXT)], "paper_id string, text string"))


@pytest.mark.parametrize(
    ("quote", "loc", "want"),
    [("基层政府如何执行上级政策", "P2", "exact"), ("基层政府如何执行上级政策", "P1", "loc_mismatch"), ("基层政府如何执行上级政策", "P9", "exact"), ("基层政府如何执行上级政策", "", "exact"), ("短", "P1", "too_short"), ("字" * 151, "P1", "too_long"), ("基层政府怎样贯彻中央精神", "P2", "miss"), ("变迁过程。第二段说明", "P1-P2", "exact"), ("基层政府如何执行上级规策", "P2", "fuzzy")],
)
def test_statuses(spark, prepared, quote, loc, want):
    q = spark.createDataFrame([("p", quote, loc)], "paper_id string, quote string, loc string")
    fuzzy = 0.9 if want == "fuzzy" else None
    assert evidence.check_quotes(q, prepared, fuzzy=fuzzy).first().status == want


def test_quotes_of_a_paper_without_text_miss(spark, prepared):
    q = spark.createDataFrame([("none", "something long", None)], "paper_id string, quote string, loc string")
    assert evidence.check_quotes(q, prepared).first().status == "miss"


def test_keyless_search_finds_all(spark):
    texts = [("a", "x" * 50 + "the quick brown fox jumps" + "y" * 30), ("b", "the quick brown cat"), ("c", "zz The Quick  Brown Fox Jumps"), ("d", ""), ("e", "abc")]
    quotes = [(1, "quick brown fox jumps"), (2, "quick brown"), (3, "xxxxxxxxxxxxxxxxxxxx"), (4, "ABC"), (5, "absent from all of them")]
    got = {tuple(r) for r in evidence.find_quotes(spark.createDataFrame(quotes, "quote_id int, quote string"), spark.createDataFrame(texts, "paper_id string, text string")).collect()}
    n = lambda s: "".join(s.lower().split())
    assert got == {(q, p) for q, s in quotes for p, t in texts if n(s) in n(t)}


def annotation(code="PZ-ANOMALY", quote="制度逻辑的变迁过程", fields=None, **more):
    ev = [{"quote": quote, "loc": "P1"}]
    f = {n: {"status": "absent", "value": None, "evidence": []} for n in schemas.FIELDS} | {"puzzle": {"status": "present", "value": "v", "evidence": [{"quote": "结论与边界条件", "loc": "P3"}]}} | (fields or {})
    return {"paper_id": "p", "codebook_version": "0.3.0", "paper_type": "mixed", "fields": f, "moves": [{"code": code, "evidence": ev, "note": None}], "annotator_notes": None, "meta": None} | more


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.ANNOTATION)


def verified(spark, prepared, a, **options):
    df = frame(spark, a)
    codes = spark.createDataFrame([("PZ-ANOMALY",), ("CON-X",)], "code string")
    return evidence.verify(df, prepared, codes, annotations.schema_errors(df), **options).first()


def test_a_good_annotation_passes(spark, prepared):
    v = verified(spark, prepared, annotation())
    assert v.passed and v.hit_rate == 1.0 and v.verified_moves == ["PZ-ANOMALY"] and v.verified_fields == ["puzzle"] and v.schema_errors == []


def test_a_fabricated_quote_fails(spark, prepared):
    v = verified(spark, prepared, annotation(quote="作者从未写过的句子"))
    assert not v.passed and v.hit_rate == 0.5 and v.unsupported_moves == ["PZ-ANOMALY"] and v.misses[0]["where"] == "move:PZ-ANOMALY"


def test_unknown_code_and_missing_field_fail(spark, prepared):
    a = annotation(code="QQ-NONE")
    del a["fields"]["actors"]
    v = verified(spark, prepared, a)
    assert not v.passed and v.unknown_codes == ["QQ-NONE"] and v.n_quotes == 1 and "fields/actors: missing" in v.schema_errors


def test_fuzzy_counts_for_the_rate_but_verifies_only_if_accepted(spark, prepared):
    a = annotation(quote="制度逻辑的变迁过呈")
    assert verified(spark, prepared, a, fuzzy=0.8).verified_moves == [] and verified(spark, prepared, a, fuzzy=0.8).hit_rate == 1.0
    assert verified(spark, prepared, a, fuzzy=0.8, accept_fuzzy=True).verified_moves == ["PZ-ANOMALY"]


def test_records_take_the_first_accepted_annotation(spark, prepared):
    good, bad = annotation(), annotation(quote="作者从未写过的句子")
    df = frame(spark, bad, good, annotation(paper_id="unknown")).withColumn("dir_ord", F.lit(0)).withColumn("file", F.lit("x.json"))
    rows = [r.asDict(True) for r in df.collect()]
    for i, r in enumerate(rows):
        r["dir_ord"] = i
        r["meta"] = {"prompt_sha256": None, "text_sha256": None, "model": None, "verification": {"passed": i > 0, "verified_moves": ["PZ-ANOMALY"], "verified_fields": ["puzzle"], "hit_rate": 1.0, "checked_at": None, "codebook_version": None, "fulltext_sha256": None, "accept_fuzzy": None, "min_hit_rate": None, "counts": None, "unsupported_moves": [], "unsupported_fields": []}}
    df = spark.createDataFrame(rows, T.StructType([*schemas.ANNOTATION.fields, T.StructField("dir_ord", T.IntegerType()), T.StructField("file", T.StringType())]))
    papers = spark.createDataFrame([("p", "A", "≤2009", "train")], "paper_id string, scholar_key string, period string, split string")
    records, problems = annotations.load_records(df, papers)
    assert [(r.paper_id, r.codes, r.fields) for r in records.collect()] == [("p", ["PZ-ANOMALY"], ["puzzle"])]
    assert sorted(r.reason for r in problems.collect()) == ["not in the registry", "verification failed"]


def test_stamps_and_verdicts(spark, prepared):
    df = frame(spark, annotation())
    codes = spark.createDataFrame([("PZ-ANOMALY",)], "code string")
    v = evidence.verify(df, prepared, codes, annotations.schema_errors(df))
    s = evidence.stamps(v, "0.3.0", "2026-01-01T00:00:00Z").first()
    assert s.passed and s.counts == {"exact": 2} and evidence.verdicts(v).first().verdict == "PASS"


def test_prompts_and_pending(spark):
    papers = spark.createDataFrame([("a",), ("b",), ("c",)], "paper_id string")
    texts = spark.createDataFrame([("a", "short text"), ("b", "x" * 100)], "paper_id string, text string")
    got = {r.paper_id: r for r in annotations.prompts(papers, texts, "Read {{TEXT}}", "1.0.0", {}, F.col("text"), max_chars=50).collect()}
    assert got["a"].status == "ready" and got["a"].prompt == "Read short text" and got["b"].status == "too_long" and got["c"].status == "no_text"
    ready = annotations.prompts(papers, texts, "Read {{TEXT}}", "1.0.0", {}, F.col("text"), max_chars=50, truncate=True).where("status = 'ready'")
    assert annotations.pending(ready, ready.where("paper_id = 'a'")).select("paper_id").collect()[0][0] == "b"


def test_find_quotes_by_automaton_and_by_grams_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(99, None), (98, "")]
    quotes = [(k, (t := rng.choice(texts[:60])[1])[(a := rng.randint(0, max(0, len(t) - 5))) : a + rng.randint(1, 40)]) for k in range(80)] + [(200, "zzzzzzzzzzzzzzzz"), (201, ""), (202, "a")]
    fold = lambda t: (t or "").replace(" ", "")
    want = {(k, i) for k, q in quotes for i, t in texts if fold(q) and fold(q) in fold(t)}
    q, t = spark.createDataFrame(quotes, "quote_id int, quote string"), spark.createDataFrame(texts, "paper_id int, text string")
    got = evidence.find_quotes(q, t, form=tx.ascii_fold).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    monkeypatch.setattr(evidence, "AUTOMATON_CHARS", 0)
    got = evidence.find_quotes(q, t, form=tx.ascii_fold).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
