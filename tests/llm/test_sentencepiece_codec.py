import pyarrow as pa
import pytest
import sentencepiece
from llm_tables import clashing
from hypothesis import given, settings
from hypothesis import strategies as st

from kgloom.llm import sentencepiece_codec as sp

LIB = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)


def ids(texts):
    c = sp.codec(sp.MODEL)
    n, flat = c.encode(pa.array(texts, pa.string()))
    out, at = [], 0
    for k in n:
        out.append(flat[at : at + k].tolist())
        at += k
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" ab▁\n\tZé�  　😀한0.,\x00"), max_size=25), min_size=1, max_size=6))
def test_equals_the_library(texts):
    assert ids(texts) == LIB.encode(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40).filter(lambda t: "▁" not in t and not any(0xD800 <= ord(c) < 0xE000 for c in t)), min_size=1, max_size=4))
def test_round_trip(texts):
    got = sp.codec(sp.MODEL).decode(pa.array(ids(texts), pa.list_(pa.int32()))).to_pylist()
    assert got == [LIB.decode(x) for x in ids(texts)] == texts


def test_documents_equal_the_library(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    rows = sp.encode_checked(d).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert r["ids"] == LIB.encode(text[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) and r["round_trip"]
    back = {r["doc_id"]: r["text"] for r in sp.decode(sp.encode(d)).collect()}
    assert back == text
    assert {r["doc_id"]: r["n_tokens"] for r in sp.with_token_counts(d).collect()} == {r["doc_id"]: r["n_tokens"] for r in rows}


def test_edge_cases(docs, words):
    long = "word " * 300_000
    d = clashing(docs([(1, None), (2, ""), (3, " "), (None, "a"), (4, "b"), (4, "b"), (5, long)]))
    got = sorted([(r["doc_id"] or 0, r["n_tokens"], r["ids"], r["round_trip"]) for r in sp.encode_checked(d).collect()], key=lambda x: x[0])
    assert [g[0] for g in got] == [0, 1, 2, 3, 4, 4, 5]
    assert got[1][1:] == (None, None, None) and got[2][1:] == (0, [], True) and got[3][2] == LIB.encode(" ")
    assert got[6][2] == LIB.encode(long) and got[6][3]
    assert sp.encode(docs([])).collect() == []
    assert sp.decode(sp.encode(docs([(1, None), (2, "")]))).orderBy("doc_id").select("text").collect() == [(None,), ("",)]


def test_table_restarts_without_changing_results(monkeypatch):
    c = sp.Codec(sp.MODEL)
    monkeypatch.setattr(sp, "TABLE_SIZE", 3)
    for t in ["a b c d e", "f g a b", "a", "h i j k l m"]:
        n, flat = c.encode(pa.array([t]))
        assert flat.tolist() == LIB.encode(t)


def test_models_that_cross_markers_are_run_whole(monkeypatch):
    c = sp.Codec(sp.MODEL)
    c.splits = False
    n, flat = c.encode(pa.array(["a  b", None, "c"]))
    assert flat.tolist() == LIB.encode("a  b") + LIB.encode("c") and list(n) == [len(LIB.encode("a  b")), 0, len(LIB.encode("c"))]


@pytest.mark.parametrize("bad", [[130, 140, 3], [259, 260]])
def test_broken_bytes_decode_like_the_library(bad):
    got = sp.codec(sp.MODEL).decode(pa.array([bad], pa.list_(pa.int32()))).to_pylist()
    assert got == [LIB.decode(bad)]
