"""The count of links says what it counts."""

from spikeloom.llm import minhash


def test_verified_links(shared):
    words = [f"w{i}" for i in range(400)]
    texts = [(k, " ".join(words[:40 * k] + [f"other{k}"] + words[40 * k + 1 :])) for k in range(1, 7)]
    got = minhash.near_duplicates(shared.createDataFrame(texts, "doc_id long, text string"))
    assert got.columns == ["doc_id", "class_id", "n_verified"]
    got = got.collect()
    assert {r.class_id for r in got} == {1} and 2 * (len(texts) - 1) <= sum(r.n_verified for r in got) <= len(texts) * (len(texts) - 1)


def test_several_texts_of_one_document(shared):
    """Each text of a doc_id is compared on its own; its documents' classes are one."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(300)) for k in "abc")
    rows = [(7, a), (7, b), (8, a + " more"), (9, "more " + b), (10, c), (6, "lone " + c), (11, "nothing alike"), (11, None), (None, a)]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(shared.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {7: 7, 8: 7, 9: 7, 10: 6, 6: 6, 11: 11}


def test_one_row_of_each_class_stays(shared):
    a, b = (" ".join(f"{k}{i}" for i in range(300)) for k in "ab")
    rows = [(7, a, 1), (7, a, 1), (7, a, 2), (9, a, 3), (5, b, 4), (5, a + " z", 5), (None, a, 6), (None, a, 7), (3, "alone", 8)]
    got = minhash.keep_one(shared.createDataFrame(rows, "doc_id long, text string, _again int")).collect()
    kept = sorted((r.doc_id, r.text) for r in got if r.doc_id is not None)
    assert kept == [(3, "alone"), (5, min(b, a + " z"))] and sum(r.doc_id is None for r in got) == 2
