"""The search of a unit's lattice against all its segmentations."""

import numpy as np

from spikeloom.llm import pieces


def ways(unit, scores, lone):
    if not unit:
        yield 0.0, ()
    for k in range(1, len(unit) + 1):
        piece = unit[:k]
        if piece in scores or k == 1:
            for s, rest in ways(unit[k:], scores, lone):
                yield s + scores.get(piece, lone), (piece, *rest)


def test_best_path():
    rng = np.random.default_rng(6)
    signs = "abcü"
    names = sorted({"".join(rng.choice(list(signs[:3]), rng.integers(1, 5))) for _ in range(25)} - {"b"})
    scores = {p: -float(rng.integers(8, 200)) / 8 for p in names}  # sums are exact
    number = {p: 300 + i for i, p in enumerate(names)}
    root = pieces.trie([(p, number[p], s) for p, s in scores.items()])
    least, known = min(scores.values()), {b: b for b in range(256)}
    for _ in range(200):
        unit = "".join(rng.choice(list(signs), rng.integers(1, 9)))
        # Of equal sums, that whose last piece starts first, then the one before it.
        best = max(ways(unit, scores, least - pieces.UNKNOWN_PENALTY), key=lambda x: (x[0], [len(p) for p in reversed(x[1])]))
        want = [i for p in best[1] for i in ([number[p]] if p in number else p.encode())]
        assert pieces.best_path(unit, root, least, known).tolist() == want
        assert pieces.best_path("ü", root, least, {}).tolist() == [0]
