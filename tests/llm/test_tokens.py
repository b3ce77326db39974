"""The relational lattice, one search a unit whatever chunks hold it, against the search in tasks."""

from spikeloom.llm import pieces


def test_units_of_many_chunks(shared):
    """Chunks of a few bytes share units; a long unit, unknown signs and ties give the ids of the search in tasks."""
    texts = ["the the heron", "the heron ined", "x" * 3000, "heron" * 200, "日本語 the ü", " ", "", None, "the\x00heron 12 12"]
    df = shared.createDataFrame([(k, t) for k, t in enumerate(texts * 3)], "doc_id long, text string")
    want = sorted(map(str, pieces.encoded(df).collect()))
    for size in (30, 1 << 20):
        assert sorted(map(str, pieces.encoded_relational(df, chunk_bytes=size).collect())) == want
