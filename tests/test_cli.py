import json

import pytest
from pyspark.sql import functions as F

from attestry import cli, render
from attestry.streaming.comments import windowed_counts


@pytest.fixture
def corpus(spark, tmp_path):
    (tmp_path / "refs.ris").write_text("".join(f"TY  - JOUR\nTI  - Title {i}\nAU  - A\nPY  - {2000 + i}\nER  - \n" for i in range(10)), encoding="utf-8")
    (tmp_path / "book.yaml").write_text("families:\n  PZ: {label: Puzzle}\nmoves:\n  - {code: PZ-A, family: PZ, label: a, definition: d}\n", encoding="utf-8")
    (tmp_path / "rules.yaml").write_text("lenses:\n  - {id: SH, name: Shared, tradition: {keys: []}}\nadmission: {min_papers: 1, shared_min_scholar_share: 0.5}\nrules:\n  - {id: R1, lens: SH, layer: shared, status: seed, requires: [PZ-A], trigger: t, action: a}\n", encoding="utf-8")
    return tmp_path


def test_import_split_status_aggregate(spark, corpus, capsys):
    p = str(corpus)
    assert cli.main(["import", f"{p}/refs.ris", "--scholar", "A", "--papers", f"{p}/none", "--out", f"{p}/papers"]) == 0
    assert "'added': 10" in capsys.readouterr().out
    assert cli.main(["split", "--papers", f"{p}/papers", "--out", f"{p}/split"]) == 0
    assert "| A | heldout | 2 |" in capsys.readouterr().out
    (corpus / "texts").mkdir()
    (corpus / "texts" / "A-2000-01.txt").write_text("some text", encoding="utf-8")
    assert cli.main(["status", "--papers", f"{p}/split", "--texts", f"{p}/texts"]) == 0
    assert cli.main(["plan", "--papers", f"{p}/split", "--texts", f"{p}/texts", "--out", f"{p}/plan", "--per-scholar", "4"]) == 0
    assert "| A | 4 |" in capsys.readouterr().out
    (corpus / "ann").mkdir()
    (corpus / "ann" / "A-2000-01.json").write_text(json.dumps({"paper_id": "A-2000-01", "moves": [{"code": "PZ-A", "evidence": []}], "fields": {}}), encoding="utf-8")
    assert cli.main(["validate", f"{p}/ann", "--papers", f"{p}/split", "--texts", f"{p}/texts", "--codebook", f"{p}/book.yaml", "--strict", "--write", f"{p}/stamps"]) == 1
    assert "FAIL" in capsys.readouterr().out
    assert cli.main(["aggregate", f"{p}/ann", "--papers", f"{p}/split", "--rules", f"{p}/rules.yaml", "--out", f"{p}/support", "--report", f"{p}/r.md", "--allow-unverified"]) == 0
    assert "unverified annotations" in (corpus / "r.md").read_text() and "| R1 | SH | seed |" in (corpus / "r.md").read_text()
    assert cli.main(["agree", f"{p}/ann", f"{p}/ann", "--papers", f"{p}/split", "--codebook", f"{p}/book.yaml", "--strict"]) == 0


def test_wrong_use(spark, corpus):
    assert cli.main(["aggregate", f"{corpus}", "--rules", f"{corpus}/none.yaml", "--out", "x", "--report", "y"]) == 2
    with pytest.raises(SystemExit):
        cli.main(["nothing"])


def test_comments_and_tables(spark, tmp_path, capsys):
    (tmp_path / "c.jsonl").write_text('{"advisor": "a", "draft_id": "d", "defect_codes": ["Q1"], "generalizable": true}\n', encoding="utf-8")
    assert cli.main(["comments", str(tmp_path / "c.jsonl"), "--min-comments", "1", "--min-drafts", "1"]) == 0
    assert "| a | Q1 | 1 | 1 | 1 | yes |" in capsys.readouterr().out.replace("True", "yes")
    assert render.cell(None) == "-" and render.cell([1, 2]) == "1, 2" and render.cell("a|b") == "a\\|b"


def test_streaming_counts_equal_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-0{d} 10:00:00", "a", f"d{d}", ["Q1"], None, True) for d in (1, 1, 2, 9)], "t string, advisor string, draft_id string, defect_codes array<string>, move_codes array<string>, generalizable boolean").withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "t")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("counted").collect()) == [1, 1, 2]
