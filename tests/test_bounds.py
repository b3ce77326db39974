"""Views over tables that are wider or longer than the given ones."""

from datetime import datetime, timedelta

from spikeloom import schema as S
from spikeloom.operators import chunks as ch


def test_wide_vectors(spark, tmp_path):
    rows = [(1, 0, [float(i) for i in range(96)]), (2, 0, [float(i) for i in range(64)]), (3, 0, [1.0] * 20)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = S.signal_chunks(spark, str(tmp_path), 16).collect()
    for vec, _, values in rows:
        mine = sorted((r.chunk, r.samples) for r in got if r.channel == vec)
        assert [c for c, _ in mine] == list(range(-(-len(values) // 16))) and [v for _, s in mine for v in s] == values


def test_events_outside_the_month(spark, tmp_path):
    hours = [-30, -1, 0, 5, 5, 719, 720, 751]  # day 31 and the days before the first
    rows = [(k, 1, datetime(2024, 1, 1) + timedelta(hours=h, minutes=30), 1.0, "a") for k, h in enumerate(hours)] + [(99, 1, datetime(2024, 1, 2), 1.0, "b")]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, value double, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.channel, r.idx): r.v for r in S.hourly(spark, str(tmp_path)).collect()}
    assert sorted(i for c, i in got if c == "a") == sorted(i for c, i in got if c == "b") == list(range(-120, 752))
    assert {i: v for (c, i), v in got.items() if c == "a" and v} == {h: float(hours.count(h)) for h in hours}
    chunked = {r.chunk: r.samples for r in ch.to_chunks(S.hourly(spark, str(tmp_path)).where("channel = 'a'"), 120).collect()}
    assert [x for k in sorted(chunked) for x in chunked[k]] == [got["a", i] for i in range(-120, 752)] and sorted(chunked) == list(range(-1, 7))
