import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from attestry.llm import sentencepiece_viterbi as sp
from attestry.llm import token_files as tf

ALPHABET = "aeinrst th▁\n  .,é漢字🙂\t\x00ab's12"


def texts(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(80))) for _ in range(n)]


@pytest.fixture(scope="module")
def pieces():
    return sp.Encoder(sp.model_path()), sentencepiece.SentencePieceProcessor(model_file=sp.model_path())


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_ids_equal_the_library(pieces, documents):
    mine, library = pieces
    for t in texts() + [r.text for r in documents.collect()] + ["", " ", "a" * 3000, "thein" * 2000]:
        assert ids(mine(t)) == library.encode(t)


def test_decoding_gives_the_text_back(pieces):
    mine, _ = pieces
    for t in texts():
        if "▁" not in t:
            assert mine.model.decode(ids(mine(t))) == t


def test_the_stream_commits_before_it_ends(pieces):
    taken = []
    stream = pieces[0].model.encode(iter("▁" + "the▁cat▁" * 50))
    for _ in range(5):
        taken.append(next(stream))
    assert taken == ids(pieces[0].stream("▁" + "the▁cat▁" * 50))[:5]


def test_unigram_paths_have_the_best_score(tmp_path):
    raw = bytearray(open(sp.model_path(), "rb").read())
    # the model type is one enum in the file: as a unigram model the same pieces are ranked by the sum of their scores
    m = sp.Model(sp.model_path(), "unigram")
    assert raw

    def best(text):
        score = [0.0] + [-1e18] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(max(0, j - m.longest), j):
                if text[i:j] in m.ids:
                    score[j] = max(score[j], score[i] + m.score[m.ids[text[i:j]]])
            if text[j - 1] not in m.ids:
                score[j] = max(score[j], score[j - 1] + m.worst - sp.UNKNOWN_COST)
        return score[-1]

    for t in texts(60, 3):
        t = "▁" + t.replace(" ", "▁")
        got = [i for i in m.encode(t) if i in set(m.ids.values())]
        unknown = sum(c not in m.ids for c in t)
        assert sum(m.score[i] for i in got) + unknown * (m.worst - sp.UNKNOWN_COST) == pytest.approx(best(t))


def test_encode_rows(spark, odd, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=sp.model_path())
    got = sp.encode(odd, keep=["doc_id", "source"])
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in got.collect()) == Counter((r.doc_id, tuple(library.encode(r.text or ""))) for r in odd.collect())
    assert all(r.round_trip for r in got.collect()) and sp.encode(empty).count() == 0
    assert {r.text for r in sp.decode(got.select("doc_id", "token_ids")).collect()} == {r.text or "" for r in odd.collect()}


def test_byte_bpe_equals_the_library(documents):
    mine, library = tf.ByteBpe(tf.vocabulary()), Tokenizer.from_file(tf.vocabulary())
    for t in texts(600, 2) + [r.text for r in documents.collect()] + ["", "a  b", "x<|endoftext|>y", "a\n\nb", "a\r\nb", " lead", "tail "]:
        assert ids(mine(t)) == library.encode(t, add_special_tokens=False).ids


def test_token_files_round_trip(spark, odd, empty, documents):
    library = Tokenizer.from_file(tf.vocabulary())
    for df in (odd, documents):
        got = sorted(tf.round_trip(df).collect(), key=lambda r: r.start)
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, (r.text or "").encode()) for r in df.collect()))
        at = 0
        for r, (known, doc_id, text) in zip(got, rows, strict=True):
            want = library.encode(text.decode(), add_special_tokens=False).ids + [2]
            assert (r.doc_id if known else 0, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
            at += len(want)
    assert tf.round_trip(empty).count() == 0


def test_files_have_indexes_and_selective_reads(spark, documents, tmp_path):
    import pyarrow.parquet as pq

    path = tf.write_token_files(documents, str(tmp_path / "t"))
    file = next(p for p in (tmp_path / "t").glob("*.parquet"))
    meta = pq.ParquetFile(file).metadata
    cols = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    ids_col = next(c for n, c in cols.items() if n.startswith("token_ids"))
    assert any("DELTA" in e for e in ids_col.encodings) and cols["doc_id"].has_column_index and cols["doc_id"].has_offset_index
    plan = tf.read_token_files(spark, path).where("doc_id = 5").select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "token_ids" not in plan.split("ReadSchema")[1].split("\n")[0] and "EqualTo(doc_id,5)" in plan


def test_a_hot_id_fills_several_files_in_the_same_order(spark, monkeypatch):
    rows = [(None if i % 3 else 7, f"t{i % 11} x{i % 17}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r.start, r.n_tokens, r.ids_crc32, r.doc_id)
    want = sorted(map(key, tf.round_trip(df).collect()))
    monkeypatch.setattr(tf, "HOT_ROWS", 20)
    assert sorted(map(key, tf.round_trip(df).collect())) == want
    assert tf.encoded(df, tf.vocabulary()).groupBy("file").count().count() > 2


def test_unsupported_vocabularies_are_refused(tmp_path):
    found = json.loads(open(tf.vocabulary(), encoding="utf-8").read())
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": found["pre_tokenizer"] | {"add_prefix_space": True}}):
        (tmp_path / "v.json").write_text(json.dumps(found | change), encoding="utf-8")
        tf.check_vocabulary.cache_clear()
        with pytest.raises(ValueError):
            tf.check_vocabulary(str(tmp_path / "v.json"))
    raw = open(sp.model_path(), "rb").read()
    assert sp.checked_kind(sp.model_path()) == "bpe"
    (tmp_path / "m.model").write_bytes(raw + bytes([sp.NORMALIZER << 3 | 2, 2, sp.SQUEEZES_BLANKS << 3, 1]))  # a later field counts
    with pytest.raises(ValueError, match="blanks removed"):
        sp.checked_kind(str(tmp_path / "m.model"))


def test_words_and_punctuation_over_a_small_cache():
    rng = random.Random(8)
    mine, library = tf.ByteBpe(tf.vocabulary()), Tokenizer.from_file(tf.vocabulary())
    mine.cache.size = 40
    words = ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randrange(1, 6))) for _ in range(60)] + ["x" * 80, "it's", "a.b", "12", "1a"]
    for _ in range(60):
        lines = [" ".join(rng.choice(words) + rng.choice(["", "", ",", ".", ").", "?!", '",', "/"]) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 5))]
        batch = ["\n".join(lines), rng.choice(["", "\t", "\x1c", "\x85", "\r"]).join(lines), "".join(lines[:1])]
        assert list(map(ids, mine.all(batch))) == [library.encode(t, add_special_tokens=False).ids for t in batch]
    assert max(map(len, {**mine.cache.young, **mine.cache.old})) <= tf.CACHE_CHARS


def test_odd_space_is_what_the_pattern_finds():
    for c in map(chr, [*range(0x300), 0x1680, *range(0x2000, 0x2070), 0x3000]):
        assert tf.odd_space(f"a{c}b") == tf.odd_space(f"é{c}b") == (tf.ODD_SPACE.search(c) is not None)
