"""The prefix trie against a dictionary of all prefixes."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import __spark_entry__ as entry
from spikeloom.llm import trie

COLUMNS = "conv_id long, turn long, role string, text string, depth long, rep long, weight string, index int, s1 long, kept boolean"


def by_dictionary(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        made = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
        ends[made].append(c)
        for d in range(len(made) + 1):
            members[made[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in members.items())


def collected(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def through_table(shared, tmp_path, rows):
    shared.createDataFrame([(*r, 1, 2, "x", 3, 4, True) for r in rows], COLUMNS).write.parquet(str(tmp_path / "conversations.parquet"))
    return collected(entry.queries()["op12_prefix_trie"](shared, str(tmp_path)))


def test_given_conversations(shared):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in shared.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(entry.queries()["op12_prefix_trie"](shared, sf)) == by_dictionary(rows)


def test_odd_conversations(shared, tmp_path, monkeypatch):
    """Nulls, ties, repeated turns, absent heads, conversations without a turn left, one that spans many stretches."""
    monkeypatch.setattr(trie, "STRETCH", 7)
    rows = [(0, t, "user", f"t{t}") for t in range(8)]
    rows += [(c, t, "user", f"t{t}") for c in range(1, 30) for t in range(c % 9 + 1)]  # copies and proper prefixes
    rows += [(40, 0, None, None), (40, 0, None, None), (40, None, "user", "first"), (41, 1, "a", "tie"), (41, 1, "a", "tie"), (41, 1, "A", "tie")]
    rows += [(350 + c, 0, "user", "no head") for c in range(12)] + [(None, 0, "user", "nobody"), (-5, 0, "user", "é" * 9)]
    rows += [(500, t, "user", "x" * (t % 5)) for t in range(60)] + [(501, t, "user", "x" * (t % 5)) for t in range(60)]
    assert through_table(shared, tmp_path, rows) == by_dictionary(rows)


def test_no_conversations(shared, tmp_path):
    assert through_table(shared, tmp_path, []) == []


def test_parts_in_text_do_not_move_between_role_and_text(shared):
    turns = shared.createDataFrame([(1, 1, "a", "b:c"), (2, 1, "a:b", "c"), (3, 1, "", "a:b:c")], "conv_id long, depth long, role string, text string")
    made = trie.trie(turns, turns.select("conv_id"))
    assert sorted((r.depth, r.n_convs) for r in made.nodes.collect()) == [(0, 3), (1, 1), (1, 1), (1, 1)]
    assert made.ends.count() == 3
