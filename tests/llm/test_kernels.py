"""Operators against brute force, on the smallest tables and on odd texts."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row

import __spark_entry__ as entry
from spikeloom.llm import fingerprint, minhash, mixing, pieces, pii, quality, suffix, urls, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(shared):
    return shared.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def profile(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def likeness(a, b):
    both = set(a) & set(b)
    every = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in every) for d in both)


@pytest.mark.parametrize("which", ["docs", "frame"])
def test_near_duplicates(request, shared, which):
    df = request.getfixturevalue(which)
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    have = [(i, profile(t)) for i, t in rows(df) if i is not None]
    assert set(got) == {i for i, _ in have}
    up = {i: i for i in got}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, (i, a) in enumerate(have):
        for j, b in have[n + 1 :]:
            if a and b and (a == b or not set(a).isdisjoint(b) and likeness(a, b) >= 0.8 - 1e-9):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    assert {i: r.class_id for i, r in got.items()} == {i: root(i) for i in got}


def test_no_documents(empty):
    for made in (minhash.near_duplicates(empty), suffix.deduplicated(empty), fingerprint.fingerprints(empty), mixing.mixed(empty), mixing.mixed_documents(empty), pii.pseudonymised(empty), pieces.encoded(empty)):
        assert made.count() == 0


@pytest.mark.parametrize("which", ["docs", "frame"])
def test_suffix(request, shared, which):
    df = request.getfixturevalue(which)
    have = [(i, (t or "").encode()) for i, t in rows(df)]
    least = {}
    for i, t in have:
        for k in range(len(t) - 49):
            if i is not None:
                least[t[k : k + 50]] = min(least.get(t[k : k + 50], i), i)
    want = Counter()
    for i, t in have:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 49):
            if i is not None and least[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want[(i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(map(tuple, suffix.deduplicated(df).collect())) == want


@pytest.mark.parametrize("which", ["docs", "frame"])
def test_base_rules(request, shared, which):
    df = request.getfixturevalue(which)
    model = quality.Model(np.zeros(1 << quality.BITS, np.float32), 0.0, 10.0)
    want = Counter()
    for i, t in rows(df):
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        seen = defaultdict(list)
        for k in range(len(w) - 2):
            seen[tuple(w[k : k + 3])].append(k)
        rep = {k + d for v in seen.values() if len(v) > 1 for k in v for d in range(3)}
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        want[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(rep), failed, not failed)] += 1
    got = Counter(tuple(r)[:8] for r in quality.judge(df, model).collect())
    assert got == want
    assert quality.keep_good(df, model).columns == df.columns


def test_symbols_are_the_eight_of_the_class():
    texts = [b"a [b] c", b"# * $ % & | < >", "é[#]é".encode()]
    at = np.cumsum([0] + [len(t) for t in texts])
    assert quality.base_counts(np.frombuffer(b"".join(texts), np.uint8), at)["n_symbols"].tolist() == [0, 8, 1]


def test_features_of_slices_and_wholes_agree():
    """Families come alike whether texts are worked on together or alone; scores follow from them."""
    texts = [b"", b"ab", "zwei Wörter".encode(), b"one two  three\nfour " * 9, b"x" * 50]
    weight = np.random.default_rng(1).normal(size=1 << quality.BITS).astype(np.float32)
    at = np.cumsum([0] + [len(t) for t in texts])
    together = quality.scores(np.frombuffer(b"".join(texts), np.uint8), at, weight)
    alone = [quality.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]), weight)[0] for t in texts]
    assert np.allclose(together, alone, rtol=0, atol=1e-12)
    n = [[np.bincount(r, minlength=5).tolist() for r, _ in quality.features(np.frombuffer(b"".join(texts), np.uint8), at)][k] for k in range(4)]
    assert n == [[0, 1, 2, 36, 1], [0, 0, 1, 35, 0], [0, 0, 10, 9 * len(texts[3]) // 9 - 2, 48], [0, 0, 9, len(texts[3]) - 3, 47]]


def test_quality_held_out(shared):
    spark, sf = shared, "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = "pmod(hash(doc_id), 4) = 0"
    model = quality.train(d, lab.where(f"not {fold}"))
    held = quality.judge(d, model).join(lab.where(fold), "doc_id").collect()
    right = [(r.good >= quality.MIN_GOOD) == (r.quality == 1) for r in held if not r.base_failed]
    assert len(right) > 40 and np.mean(right) >= 0.95


@pytest.mark.parametrize("which", ["docs", "frame"])
def test_fingerprints(request, shared, which):
    df = request.getfixturevalue(which)
    have = sorted(((i if i is not None else -(1 << 63), t or "") for i, t in rows(df)), key=lambda x: x[0])
    got = fingerprint.with_following(df, 50)  # several parts
    assert got.select("part").distinct().count() >= min(2, len(have) // 100 + 1)
    made = sorted(fingerprint.fingerprints(df).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    assert len(made) == len(have)
    for k, ((i, t), r) in enumerate(zip(have, made)):
        after = have[(k + 1) % len(have)][1]
        assert r.n_chars == len(t) and r.fingerprint == fingerprint.digest(t.encode())
        assert r.edited_sha256 == hashlib.sha256(fingerprint.edited(t, after).encode()).hexdigest()
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1


def test_fingerprint_parts(shared, docs, monkeypatch):
    many = fingerprint.fingerprints(docs).collect()
    part = fingerprint.with_following
    monkeypatch.setattr(fingerprint, "with_following", lambda d: part(d, 13))
    assert Counter(map(tuple, fingerprint.fingerprints(docs).collect())) == Counter(map(tuple, many))
    near, far = np.mean([r.near_edited for r in many]), np.mean([r.near_next for r in many])
    assert near > far + 0.2


def test_pieces(shared, frame, docs):
    v = pieces.Vocabulary(pieces.MODEL)
    score = {p: (s, i) for p, i, s in v.edges}

    def best(text):
        t = ("▁" + text.replace(" ", "▁")) if text else ""
        top = [(0.0, 0, [])] + [None] * len(t)
        for e in range(1, len(t) + 1):
            for s in range(max(0, e - v.longest), e):
                hit = score.get(t[s:e])
                if hit is None and e - s == 1:
                    hit = (v.least - pieces.UNKNOWN_PENALTY, None)
                if hit and (top[e] is None or top[s][0] + hit[0] > top[e][0]):
                    top[e] = (top[s][0] + hit[0], s, [hit[1]] if hit[1] is not None else [v.bytes[b] for b in t[s:e].encode()])
        out, e = [], len(t)
        while e:
            out[:0], e = top[e][2], top[e][1]
        return out

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for df in (frame, docs):
        made = pieces.encoded(df).collect()
        other = pieces.encoded_relational(df, chunk_bytes=20_000).select("doc_id", "ids").collect()
        assert sorted(map(str, other)) == sorted(str(Row(doc_id=r.doc_id, ids=r.ids)) for r in made)
        assert len(made) == df.count()
        for r in made:
            assert r.decoded_ok and list(r.ids) == best(r.text or "") and r.n_tokens == len(r.ids)
            assert library.decode(list(r.ids)) == (r.text or "")


def test_mixing(shared, frame, docs):
    for df in (frame, docs):
        have = [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]
        size = Counter()
        for _, t, s in have:
            size[s] += len(WORD.findall(t or ""))
        names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
        target, left, total = {}, set(names), 1.5 * sum(size.values())
        while left:
            rest = total - sum(target.values())
            give = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
            over = {s for s in left if give[s] > 2 * size[s] + 1e-9}
            target |= {s: 2 * size[s] for s in over} if over else give
            left -= over or left
        made = mixing.mixed(df).collect()
        assert Counter((r.doc_id, r.size) for r in made) == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in have)
        assert all(0 <= r.taken <= 2 * r.size for r in made)
        by = defaultdict(list)
        for i, t, s in have:
            by[i].append(s)
        goal = {(r.source_size, round(r.target, 3)) for r in made}
        assert goal == {(size[s], round(target[s], 3)) for s in names}
        whole = sum(r.taken for r in made)
        source = dict(((i, len(WORD.findall(t or ""))), s) for i, t, s in have)
        if df is docs:  # every source near its own target
            got = Counter()
            for r in made:
                got[source[r.doc_id, r.size]] += r.taken
            assert all(abs(got[s] - target[s]) < 0.03 * target[s] + 2 * mixing.BLOCK for s in names)
        assert abs(whole - total) < 0.03 * total + 256
        assert Counter(map(tuple, mixing.mixed(df).collect())) == Counter(map(tuple, made))
        texts = mixing.mixed_documents(df)
        assert texts.columns == df.columns
        assert sum(len(WORD.findall(r.text)) for r in texts.collect()) == whole


def test_mixing_of_many_equal_rows(shared):
    """Passes of equal rows are joined by copy, so thousands of them take no quadratic lists."""
    df = shared.createDataFrame([(1, "one two three " * 9, "a")] * 3000 + [(2, "four five", "b")], "doc_id long, text string, source string")
    made = mixing.mixed_documents(df)
    assert sum(len(r.text.split()) for r in made.collect()) == sum(r.taken for r in mixing.mixed(df).collect())


def test_urls(shared):
    bad = [(1, None), (2, ""), (3, "no scheme"), (4, "http://Ex.ORG/fr/x?q#z"), (5, "http://a.example.com/de/1"), (6, "http://example.net/en/"), (7, "https://b.net/q"), (8, "http://c.net"), (9, "http://c.net?x"), (9, "http://c.net?x"), (None, "ftp://x.notnet/a")]
    got = urls.judged(shared.createDataFrame([(i, u, 1) for i, u in bad], "page_id long, url string, host int")).collect()
    want = {1: ("", "", None), 2: ("", "", None), 3: ("", "", None), 4: ("ex.org", "/fr/x", "org/fr/"), 5: ("a.example.com", "/de/1", "example.com/de/"), 6: ("example.net", "/en/", "example.net/en/"), 7: ("b.net", "/q", "net/"), 8: ("c.net", "", None), 9: ("c.net", "", None), None: ("x.notnet", "/a", None)}
    assert len(got) == len(bad)
    for r in got:
        assert (r.host, r.path, r.rule) == want[r.page_id] and r.verdict in ("allow", "block")
    assert urls.judged(shared.createDataFrame([], "page_id long, url string")).count() == 0
    known = {r.rule: r.verdict for r in entry.queries()["op8_url_filter"](shared, "/root/testdata/sf0.01").collect() if r.rule}
    assert known == {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def test_warc(shared, tmp_path):
    big, other = "payload é " * 200, "another " * 200
    have = [(1, "http://a/\r\nx", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "%", other), (7, "u", big), (None, "u", other), (8, "u", ""), (6, "u", big)]
    df = shared.createDataFrame([(*x, 0) for x in have], "page_id long, url string, html string, digest int")
    made = warc.archived(df, f"file://{tmp_path}/w").collect()
    most = {}
    for i, _, h in have:
        if i is not None and h and len(h.encode()) >= 1000:
            most[h] = max(most.get(h, i), i)
    want = Counter()
    for i, u, h in have:
        b = (h or "").encode()
        ref = most.get(h) if len(b) >= 1000 and most.get(h) != i else None
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "response" if ref is None else "revisit", ref)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in made) == want
    assert all(r.body_digest == r.payload_digest for r in made if r.record_type == "response")


def test_archives_are_spread(shared, tmp_path, monkeypatch):
    """Few bytes of paths, much work behind them: the archives lie in many tasks, not in one."""
    folder = f"file://{tmp_path}/w"
    pages = shared.createDataFrame([(i, "u", f"{i} " * 500) for i in range(200)], "page_id long, url string, html string")
    first = warc.checkpoint(warc.written(warc.decided(pages), folder, file_bytes=4000))
    assert first.count() > 50
    assert sum(1 for n in warc.spread(first.select("path")).rdd.glom().map(len).collect() if n) > 20
    assert warc.read(warc.normalised(first.select("path"), folder).select("path"), folder).count() == 200


def test_warc_streams():
    import io
    import zlib

    ones = [warc.record("response", k, "u", b"x" * k, "d", k, None) for k in (0, 5, 70_000)]
    tool = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = b"".join(tool.compress(o) for o in ones) + tool.flush()
    for raw in (whole, b"".join(zlib.compress(o, wbits=31) for o in ones)):
        split = warc.Records()
        assert [x for d in warc.inflated(io.BytesIO(raw)) for x in split.feed(d)] == ones
    with pytest.raises(ValueError):
        list(warc.inflated(io.BytesIO(whole[:-9])))


def test_touching_spans_are_one():
    got = suffix.joined(np.array([30, 0, 5, 60, 10]), np.array([40, 20, 10, 70, 30]))
    assert got.tolist() == [[0, 40], [60, 70]]
    assert suffix.joined(np.zeros(0, np.int64), np.zeros(0, np.int64)).shape == (0, 2)


def test_suffix_in_parts_of_a_range(shared, docs, monkeypatch):
    whole = Counter(map(tuple, suffix.deduplicated(docs).collect()))
    monkeypatch.setattr(suffix, "PART_BYTES", 64)
    monkeypatch.setattr(suffix, "RANGES", 4)
    monkeypatch.setattr(suffix, "CHUNK_BYTES", 4096)
    assert Counter(map(tuple, suffix.deduplicated(docs).collect())) == whole
