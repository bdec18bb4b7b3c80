import pytest
from pyspark.sql import functions as F

from attestry.functions import text as tx
from attestry.functions.fuzzy import best_ratio
from attestry.functions.replies import first_object


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("y")).first()[0]


@pytest.mark.parametrize(("a", "b"), [("“研究”　问题", '"研究"问题'), ("ＡＢＣ１２", "abc12"), ("a——b", "a-b"), ("等……。", "等."), ("结果①显示[12]", "结果显示"), ("x [1, 2-3] y", "xy"), ("ﬁne", "fine"), ("a​b﻿", "ab")])
def test_normal_forms_are_equal(spark, a, b):
    assert one(spark, tx.normalize(F.col("x")), a) == one(spark, tx.normalize(F.col("x")), b)


def test_null_stays_null(spark):
    assert one(spark, tx.normalize(F.col("x")), None) is None


def test_blank_line_paragraphs_and_joined_lines(spark):
    assert one(spark, tx.paragraphs(F.col("x")), "a\nb\r\n\r\n\n c \n\n\n") == ["a b", "c"]
    assert one(spark, tx.paragraphs(F.col("x")), "研究\n问题") == ["研究问题"]


def test_hard_wrapped_text(spark):
    text = "一、引言\n" + "本文研究" * 40 + "\n" + "继续。\n" + ("另一段" * 300 + "\n") * 4 + "完。\n剩余"
    got = one(spark, tx.paragraphs(F.col("x")), text)
    assert got[0] == "一、引言" and got[1].endswith("继续。") and got[2].endswith("完。") and got[3] == "剩余"


@pytest.mark.parametrize(("loc", "want"), [("P12-P14", [12, 13, 14]), ("P3", [3]), ("P5–3", [3, 4, 5]), ("p2 至 P3", [2, 3]), ("page three", []), (None, []), ("P1-P90", list(range(1, 22))), ("P1, P4-5", [1, 4, 5])])
def test_locators(spark, loc, want):
    assert one(spark, tx.located(F.col("x")), loc) == want


def test_abstract_half_numbering_template(spark):
    assert one(spark, tx.abstract(F.col("x")), "题名\n摘 要：本文 研究\n治理。关键词：治理") == "本文研究治理。"
    assert one(spark, tx.first_half(F.col("x")), "a") == "a"
    assert one(spark, tx.first_half(F.col("x")), "") == "(none)"
    assert one(spark, tx.numbered(F.split("x", ",")), "a,b") == "[P1] a\n[P2] b"
    assert one(spark, tx.filled(F.lit("{{A}}-{{A}}-{{B}}"), {"A": F.col("x"), "B": F.lit(None).cast("string")}), "1") == "1-1-"
    assert one(spark, tx.without_leading_comment(F.col("x")), "<!-- c -->\nbody <!-- d -->") == "body <!-- d -->"


def test_fuzzy_ratio():
    text = "组织变革需要制度支持而非单纯的技术改造"
    assert best_ratio("组织变革需要制度支持", text) == 1.0
    assert 0.85 <= best_ratio("组织变革需要制度支撑", text) < 1
    assert best_ratio("短句", text) == 0.0 and best_ratio(None, None) == 0.0


@pytest.mark.parametrize(("reply", "want"), [("<think>{x</think>```json\n{\"a\": \"}\"}\n```", '{"a": "}"}'), ("junk</think> {\"a\": {\"b\": 1}} tail }", '{"a": {"b": 1}}'), ("no object", None), ("{\"a\": 1", None), ("{bad}", None), (None, None), ('{"a": "\\"}"}', '{"a": "\\"}"}')])
def test_reply_object(reply, want):
    assert first_object(reply) == want


def test_a_text_is_split_once_for_its_normal_form(spark):
    from attestry.operators.evidence import prepared_texts

    texts = spark.createDataFrame([("a", " A--b .. C　d\x1c\x85。。[1, 2] ")], "paper_id string, text string")
    found = prepared_texts(texts)
    assert found.first().whole == "a-b.cd."
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("joinedlines") + plan.count("array_join(transform(") <= 4 and plan.count("reduce(") <= 1


def test_white_space_is_that_of_unicode(spark):
    from attestry.functions import text as tx

    cs = spark.range(1, 0x3100).select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c")).select(F.concat("c", F.lit("a"), "c", F.lit("b"), "c", "c").alias("t"))
    same = lambda a, b: cs.where(~a.eqNullSafe(b)).count() == 0
    assert same(tx.stripped(F.col("t")), F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))
    assert same(tx.without_white(F.col("t")), F.regexp_replace("t", r"(?U)[\s\x1C-\x1F]+", ""))
    assert same(tx.ascii_fold(F.col("t")), F.lower(F.regexp_replace("t", r"[\x20\x09-\x0D]+", "")))


def test_fuzzy_ratio_takes_arrow_arrays():
    from attestry.functions import fuzzy

    assert "pandas" not in vars(fuzzy) and "pd" not in vars(fuzzy)
