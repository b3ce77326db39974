"""Every stage of the corpus pipeline on odd texts, empty tables and columns of clashing names, and the whole of it twice."""

import re
from collections import Counter

import pytest

import corpus_pipeline as cp
from spikeloom.llm import minhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
STAGES = dict(cp.STAGES)


def test_order_of_stages():
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "pii", "mix", "tokens"]


@pytest.mark.parametrize("name", ["quality", "near_dedup", "pii", "mix"])
def test_stages_keep_the_columns(shared, frame, empty, name):
    """All stages but the last return the columns of their input, whatever their names, also of an empty table."""
    for df in (frame.withColumn("n_replaced", frame.n_words), empty.withColumn("n_replaced", empty.n_words)):
        made = STAGES[name](shared, df, SF)
        assert made.columns == df.columns and [t for _, t in made.dtypes] == [t for _, t in df.dtypes]
        rows = made.collect()
        assert df is not frame or rows or name == "quality"
        if name == "pii":
            assert Counter((r.doc_id, r.n_replaced) for r in rows) == Counter((r.doc_id, r.n_replaced) for r in df.collect())


def test_quality_keeps_what_it_judges_good(shared, frame):
    """Short and null texts go; what stays stays to the sign."""
    have = Counter((r.doc_id, r.text) for r in frame.collect())
    kept = Counter((r.doc_id, r.text) for r in STAGES["quality"](shared, frame, SF).collect())
    assert not kept - have and all(len(WORD.findall(t or "")) >= 50 for _, t in kept)


def test_one_of_each_class(shared, frame):
    """Of each class (compared with brute force elsewhere) the least doc_id stays, once, also of repeated rows; a null doc_id stays."""
    kept = Counter(r.doc_id for r in STAGES["near_dedup"](shared, frame, SF).collect())
    least = {r.class_id for r in minhash.near_duplicates(frame).collect()}
    assert kept == Counter([*least, None]) and 1 in least and not least & {2, 3, 7, 8, 13}


def test_mix_takes_whole_words(shared, frame):
    by = {}
    for r in frame.collect():
        by.setdefault(r.doc_id, []).append(WORD.findall(r.text or ""))
    for r in STAGES["mix"](shared, frame, SF).collect():
        got = WORD.findall(r.text)
        assert got and not Counter(got) - Counter(max(by[r.doc_id], key=len))


def test_tokens_decode(shared, frame):
    rows = STAGES["tokens"](shared, frame, SF).collect()
    assert len(rows) == frame.count() and all(r.decoded_ok for r in rows)
    assert all(not r.ids for r in rows if not r.text)


def test_whole_pipeline_is_repeatable(shared):
    runs = [Counter((r.doc_id, r.text, tuple(r.ids)) for r in cp.run(shared, SF).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and runs[0]
    docs = shared.read.parquet(f"{SF}/documents.parquet")
    assert {i for i, _, _ in runs[0]} <= {r.doc_id for r in docs.collect()}
