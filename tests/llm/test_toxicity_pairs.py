"""The factorization machine: pairs that balance singly, and margins against an explicit sum over pairs."""

import numpy as np

from logweir.llm import toxicity

WORDS = [f"{a}{b}{c}" for a in ("bal", "dor", "fen", "gim") for b in ("ak", "ol", "ur") for c in ("tin", "mos", "rel")]


def texts_of(rng, n):
    """Toxic iff both or neither of two words stand in the text; each word alone says nothing."""
    rows = []
    for _ in range(n):
        a, b = rng.integers(0, 2, 2)
        words = [*rng.choice(WORDS, 12), *(["wretch"] if a else []), *(["outsider"] if b else [])]
        rng.shuffle(words)
        rows.append((" ".join(words), int(a == b)))
    return rows


def test_singly_balanced_pair_is_learned(spark):
    rng = np.random.default_rng(3)
    rows = texts_of(rng, 4000)
    model = toxicity.train(spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, toxic int"))
    held = texts_of(rng, 1000)
    right = (model.scores([t for t, _ in held]) >= 0.5) == np.array([y for _, y in held], bool)
    assert right.mean() > 0.95


def test_margins_are_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    linear, factors = rng.normal(size=9), rng.normal(size=(9, 3))
    sets = [[], [4], [0, 3, 8], list(range(9))]
    owner = np.array([i for i, s in enumerate(sets) for _ in s])
    index = np.array([c for s in sets for c in s])
    got = toxicity.margins(owner, index, len(sets), 0.25, linear, factors)[0]
    for z, s in zip(got, sets):
        want = 0.25 + sum(linear[c] for c in s) + sum(factors[a] @ factors[b] for k, a in enumerate(s) for b in s[k + 1 :])
        assert abs(z - want) < 1e-9


def test_no_pair_among_random_labels():
    rng = np.random.default_rng(5)
    owner = np.repeat(np.arange(3000, dtype=np.int32), 20)
    flat = np.concatenate([rng.choice(200, 20, replace=False) for _ in range(3000)]).astype(np.int32)
    assert len(toxicity.paired_columns(owner, flat, rng.integers(0, 2, 3000).astype(float))) == 0
