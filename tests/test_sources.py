import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from attestry.operators.integrity import IntegrityError, bundle_errors, keyed_difference, mentions, require_unique
from attestry.sources import bibliography, chat, tables

RIS = "TY  - JOUR\nAU  - 周遥\nAU  - 何川\nTI  - 河流与渡口\nT2  - 水文札记\nPY  - 2013\nIS  - 07\nSP  - 41\nEP  - 58\nER  - \n\nTY  - JOUR\nT1  - Second\nPY  - 20x\nTY  - JOUR\nTI  - Third, unclosed\nER  - \n"
ENW = "%0 Journal Article\n%A 周遥\n%T 山路的名称\n%J 地名季刊\n%D 2017\n%N 02\n%P 5-19\n%X 一段说明\n\n%0 Journal Article\n%A A, B; C\n%T Two\n%P 7\n"


def files(spark, text):
    return spark.createDataFrame([("f", text)], "file string, text string")


def test_ris(spark):
    rows = bibliography.paper_rows(bibliography.parse_ris(files(spark, RIS)), "ris", "A", "周遥").orderBy("rec").collect()
    assert [r.title for r in rows] == ["河流与渡口", "Second", "Third, unclosed"]
    r = rows[0]
    assert (r.authors, r.issue, r.pages, r.author_role, r.period, r.year) == ("周遥、何川", "7", "41-58", "first", "2010-2015", "2013")
    strict = bibliography.paper_rows(bibliography.parse_ris(files(spark, RIS), keep_unclosed=False), "ris", "A").collect()
    assert sorted(r.title for r in strict) == ["Third, unclosed", "河流与渡口"]


def test_endnote(spark):
    rows = bibliography.paper_rows(bibliography.parse_endnote(files(spark, ENW)), "enw", "A", "周遥").orderBy("rec").collect()
    assert (rows[0].year, rows[0].issue, rows[0].pages, rows[0].author_role, rows[0].abstract) == ("2017", "2", "5-19", "sole", "一段说明")
    assert (rows[1].authors, rows[1].pages) == ("A、B、C", "7")
    whole = bibliography.paper_rows(bibliography.parse_endnote(files(spark, ENW)), "enw", "A", whole_names=True).orderBy("rec").collect()
    assert whole[1].authors == "A, B、C"


def test_papers_round_trip(spark, tmp_path):
    assert tables.read_papers(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "p.csv").write_text("paper_id,title,extra\nA-1,\"x, y\",z\n", encoding="utf-8")
    one = tables.read_papers(spark, str(tmp_path / "p.csv"))
    tables.write_papers(one, str(tmp_path / "out"))
    again = tables.read_papers(spark, str(tmp_path / "out"))
    assert one.collect() == again.collect() and again.first().title == "x, y" and again.first().split == ""


def test_the_registry_is_replaced_in_place(spark, tmp_path):
    path = str(tmp_path / "p.csv")
    (tmp_path / "p.csv").write_text("paper_id,title,topic\nA-1,x,water\n", encoding="utf-8")
    for n in (2, 3):
        old = tables.read_papers(spark, path)
        tables.write_papers(old.unionByName(old.where("paper_id = 'A-1'").withColumn("paper_id", F.lit(f"A-{n}"))), path)
    assert [(r.paper_id, r.topic) for r in tables.read_papers(spark, path).orderBy("paper_id").collect()] == [("A-1", "water"), ("A-2", "water"), ("A-3", "water")]
    broken = tables.read_papers(spark, path).withColumn("title", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        tables.write_papers(broken, path)
    assert tables.read_papers(spark, path).count() == 3
    assert [p.name for p in tmp_path.iterdir() if ".old" in p.name] == []


def test_columns_of_the_registry(spark, tmp_path):
    (tmp_path / "p.csv").write_text("paper_id,notes\nA,n\n", encoding="utf-8")
    tables.write_papers(tables.read_papers(spark, str(tmp_path / "p.csv")), str(tmp_path / "q"))
    first = next(p for p in (tmp_path / "q").iterdir() if p.suffix == ".csv").read_text().splitlines()[0]
    assert first == "paper_id,scholar_key,authors,title,journal,year,issue,pages,author_role,topic,paper_type,period,verify_status,verified_fields,source_url,oa_url,seed_source,split,fulltext,notes"


def test_json_lines_name_the_broken_line(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"comment_id": "1", "generalizable": true, "more": 1}\n\n{"comment_id": \n', encoding="utf-8")
    with pytest.raises(Exception, match=r"c\.jsonl:3"):
        tables.read_comments(spark, str(tmp_path / "c.jsonl")).collect()
    (tmp_path / "c.jsonl").write_text('{"comment_id": "1", "generalizable": true}\r\n', encoding="utf-8")
    assert tables.read_comments(spark, str(tmp_path / "c.jsonl")).first().comment_id == "1"


def test_unknown_properties_are_found(spark):
    text = json.dumps({"paper_id": "a", "odd": 1, "fields": {"puzzle": {"status": "absent", "x": 1, "evidence": [{"quote": "q", "loc": "P1", "page": 2}]}}, "moves": [{"code": "A-B", "evidence": [], "why": ""}]})
    got = spark.createDataFrame([(text,), ("no json",)], "t string").select(tables.unknown_properties(F.col("t")).alias("u")).collect()
    assert [r.u for r in got] == [["fields/puzzle/evidence/page", "fields/puzzle/x", "moves/why", "odd"], []]


def test_annotation_folders_keep_their_order(spark, tmp_path):
    for d, names in (("one", ["b.json", "_skip.json"]), ("two", ["a.json"])):
        (tmp_path / d).mkdir()
        for n in names:
            (tmp_path / d / n).write_text(json.dumps({"paper_type": "mixed", "fields": {"puzzle": {"status": "present", "value": ["x"], "evidence": []}}}, indent=1), encoding="utf-8")
    got = tables.read_annotations(spark, [str(tmp_path / "one"), str(tmp_path / "two")]).orderBy("dir_ord", "file").collect()
    assert [(r.dir_ord, r.file, r.paper_id) for r in got] == [(0, "b.json", "b"), (1, "a.json", "a")]
    assert json.loads(got[0].fields["puzzle"]["value"]) == ["x"]


def test_items_and_sheets(spark, tmp_path):
    (tmp_path / "items.jsonl").write_text('{"item_id": "1", "draft": "d", "outputs": {"a": "x", "b": "y"}}\n\n{"item_id": "2", "draft": "d", "outputs": {"a": "x", "b": "y"}}\n', encoding="utf-8")
    assert tables.read_items(spark, str(tmp_path / "items.jsonl")).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"item_id": "1", "outputs": {"a": "x"}}\n', encoding="utf-8")
    with pytest.raises(IntegrityError):
        tables.read_items(spark, str(tmp_path / "bad.jsonl"))
    (tmp_path / "scores_R1.csv").write_text("item_id,label,D1\n1,A,3\n", encoding="utf-8")
    assert tables.read_sheets(spark, str(tmp_path)).first().rater == "R1"


def test_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿正文".encode() + b"\xff")
    (tmp_path / "a.md").write_text("other", encoding="utf-8")
    texts = tables.read_texts(spark, str(tmp_path))
    papers = spark.createDataFrame([("a", ""), ("b", "missing.txt")], "paper_id string, fulltext string")
    got = tables.full_texts(papers, texts).collect()
    assert [(r.paper_id, r.text) for r in got] == [("a", "正文�")]
    stored = spark.createDataFrame([("b", " kept ")], "stem string, text string")
    assert {r.paper_id: r.abstract for r in tables.abstracts(papers, stored, tables.full_texts(papers, texts)).collect()} == {"a": "", "b": "kept"}


def test_registry_loaders_check_integrity(spark):
    book = {"families": {"PZ": {"label": "l"}}, "moves": [{"code": "PZ-A", "family": "PZ"}]}
    fam, moves = tables.codebook(spark, book)
    assert fam.count() == 1 and moves.first().code == "PZ-A"
    with pytest.raises(IntegrityError):
        tables.codebook(spark, {"families": {"PZ": None}, "moves": [{"code": "X", "family": "NO"}]})
    reg = {"lenses": [{"id": "SH", "tradition": {"keys": []}}], "rules": [{"id": "R", "lens": "SH", "layer": "shared", "status": "seed", "requires": ["A"]}], "admission": {"min_papers": 3}}
    assert tables.rule_registry(spark, reg)[1].first().requires == ["A"]
    with pytest.raises(IntegrityError):
        tables.rule_registry(spark, reg | {"rules": reg["rules"] * 2})


def test_integrity_helpers(spark):
    a, b = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b"), (3, None)], [(1, "a"), (2, "c"), (4, "d"), (3, None)]))
    assert {tuple(r) for r in keyed_difference(a, b, "k", "v").collect()} == {(2, "stale"), (4, "extra")}
    with pytest.raises(IntegrityError):
        require_unique(a.unionByName(a), ["k"])
    docs = spark.createDataFrame([("p", "see refs/a.md and refs/b.md")], "path string, text string")
    assert {tuple(r) for r in mentions(docs, spark.createDataFrame([("a",), ("c",)], "name string"), r"refs/(\w+)\.md").collect()} == {("b", "missing"), ("c", "unused")}


@pytest.fixture
def service():
    script: list = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            reply = script.pop(0)
            self.send_response(reply if isinstance(reply, int) else 200)
            self.end_headers()
            if not isinstance(reply, int):
                self.wfile.write(json.dumps({"choices": [{"message": {"content": reply}}]}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield script, f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_chat_retries_and_gives_up(service):
    script, url = service
    client = chat.ChatClient(chat.checked_options({"base_url": url, "model": "m", "extra": {"top_p": 1}}, {}), chat.Retry(waits=(0, 0)))
    script += [503, 429, "hello"]
    assert client([]) == "hello" and client.body([]) == {"messages": [], "model": "m", "temperature": 0.0, "top_p": 1}
    script += [400]
    with pytest.raises(RuntimeError, match="400"):
        client([])
    script += [503, 503, 503]
    with pytest.raises(RuntimeError, match="503"):
        client([])
    told = json.loads(client.provenance())
    assert told["host"].startswith("127.0.0.1") and url not in client.provenance()


@pytest.mark.parametrize("given", [{}, {"base_url": "u"}, {"base_url": "u", "model": "m", "top": 1}, {"base_url": "u", "model": "m", "timeout": "x"}])
def test_chat_options_are_checked(given):
    with pytest.raises(ValueError):
        chat.checked_options(given, {})


def test_chat_options_come_from_the_environment():
    got = chat.checked_options({"temperature": 1}, {"ATTESTRY_CHAT_URL": "http://h/v1", "ATTESTRY_CHAT_MODEL": "m"})
    assert (got["base_url"], got["model"], got["temperature"], got["timeout"]) == ("http://h/v1", "m", 1.0, 900)


def test_replies_repair_and_report(spark):
    def client(messages):
        if "boom" in messages[0]["content"]:
            raise ValueError("boom")
        return "{}" if len(messages) > 1 else "not json"

    def accept(reply):
        return [] if reply == "{}" else ["no JSON"]

    prompts = spark.createDataFrame([("a", "x"), ("b", "boom")], "id string, prompt string")
    got = {r.id: r for r in chat.replies(prompts, client, accept).collect()}
    assert (got["a"].status, got["a"].attempts, got["b"].status) == ("ok", 2, "failed") and "boom" in got["b"].error


def test_reports_are_put_in_place(tmp_path):
    tables.write_report(str(tmp_path / "x" / "r.md"), "text")
    assert (tmp_path / "x" / "r.md").read_text() == "text" and len(list((tmp_path / "x").iterdir())) == 1


def test_text_hash(spark):
    assert spark.range(1).select(tables.text_sha256(F.lit("abc"))).first()[0].startswith("ba7816bf")


def test_bundles(spark):
    good = "---\nname: rivers\ndescription: >\n  Reads accounts of rivers and of the roads beside them, with care.\n  Use when 河流 is asked for in any of its forms.\nlicense: own\n---\nSee references/a.md.\n"
    files = [
        ("rivers/SKILL.md", good), ("rivers/references/a.md", "text <!-- references/b.md -->\n"),
        ("roads/SKILL.md", good.replace("references/a.md", "references/gone.md") + "line\n" * 500), ("roads/references/b.md", "see references/c.md\n" + "x\n" * 100), ("none/references/a.md", "TODO by Ann Lee"), ("bare/SKILL.md", None),
        ("short/SKILL.md", "---\nname: Short_\ndescription: 'Too short.'\n---\nbody"),
    ]
    got = {tuple(r) for r in bundle_errors(spark.createDataFrame(files, "path string, text string"), ["Ann Lee"]).collect()}
    assert got == {
        ("roads/SKILL.md", "name differs from its folder"), ("roads/SKILL.md", "more than 500 lines"), ("roads/SKILL.md", "points to missing gone.md"), ("roads/SKILL.md", "never mentions b.md"),
        ("roads/references/b.md", "points to a further reference"), ("roads/references/b.md", "over 100 lines without contents"), ("none", "no SKILL.md"), ("none/references/a.md", "has a placeholder"), ("none/references/a.md", "has the name Ann Lee"),
        ("bare/SKILL.md", "no front matter"), ("short/SKILL.md", "name differs from its folder"), ("short/SKILL.md", "name is not in kebab case"), ("short/SKILL.md", "description outside 80 to 1024 characters"),
        ("short/SKILL.md", "description without 'Use when'"), ("short/SKILL.md", "description without Chinese phrases"), ("short/SKILL.md", "no license"),
    }
