"""Groups of near copies around the threshold, and lines many documents share, against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quayside.llm import jaccard_join
from tests.llm.test_queries import components, shingles


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    line = "this line stands in very many of the documents here".split()
    texts = []
    for group in range(2):
        base = rng.choices(vocabulary, k=140)
        for _ in range(120):
            copy = [w if rng.random() > 0.03 else rng.choice(vocabulary) for w in base]
            texts.append(copy)
    for _ in range(150):
        words = rng.choices(vocabulary, k=rng.randrange(20, 90))
        at = rng.randrange(len(words))
        texts.append(words[:at] + line + words[at:])
    for _ in range(40):
        words = rng.choices(vocabulary, k=rng.choice([3, 5, 6, 9, 30, 400]))
        texts += [words, words[:-1] if len(words) > 8 else words]
    rng.shuffle(texts)
    return {i: " ".join(words) for i, words in enumerate(texts)}


@pytest.mark.parametrize("settings", [
    {"LARGE_BUCKET": 8, "BLOCK_SETS": 16, "HOT_IN_BLOCK": 3, "SENT_IDS": 0},
    {"FREQUENT_SHARE": 0.0, "FREQUENT_MOST": 10, "LARGE_BUCKET": 1000},
])
def test_components_around_the_threshold(spark, monkeypatch, settings):
    texts = corpus()
    for name, value in settings.items():
        monkeypatch.setattr(jaccard_join, name, value)
    expected = components({i: shingles(t.encode()) for i, t in texts.items()})
    assert 20 < len(texts) - len(set(expected.values())) < len(texts)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5, "doc_id")
    found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(rows).collect()}
    assert found == expected


@pytest.mark.parametrize("size", [40, 300, 1200])
def test_bits_rule_out_most_pairs_below_the_threshold_and_none_above(size):
    """Sets that share two thirds are hardly ever compared whole; those that share four fifths always are."""
    rng = np.random.default_rng(size)

    def found(own):
        """Pairs of sets of ``size`` shingles, ``own`` of them of each set alone, that are left to compare."""
        sets = []
        for _ in range(100):
            pool = rng.integers(1, 1 << 63, size + own).astype(np.uint64)
            sets += [np.sort(pool[:size]), np.sort(pool[own:])]
        side = jaccard_join._sides(pa.table({
            "id": pa.array(range(200), pa.int64()), "c": pa.array(range(200), pa.int64()), "n": pa.array([size] * 200, pa.int64()),
            "sketch": pa.array([jaccard_join._sketch(one) for one in sets], pa.binary())}))
        pairs = {tuple(sorted(p)) for p in jaccard_join._near(side, side, 80).tolist()}
        assert all(a // 2 == b // 2 for a, b in pairs)
        return len(pairs)

    assert found(size // 10) == found(size // 9) == 100
    assert found(size // 5) < 5
