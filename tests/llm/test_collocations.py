"""Collocations against counting by hand."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quayside.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, f long"


def counted(rows, longest=4):
    """Occurrences of phrases by language, and of all words."""
    found = Counter()
    for _, text, lang, *_ in rows:
        text = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for size in range(1, longest + 1):
                found.update((lang or "und", tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    return found


def best(found, least, share=80, top=2000):
    out = []
    for (lang, phrase), a in found.items():
        if len(phrase) < 2 or a < least:
            continue
        longer = [f for (g, p), f in found.items() if g == lang and len(p) > len(phrase) and f >= least
                  and any(p[i : i + len(phrase)] == phrase for i in range(len(p)))]
        if any(100 * f >= share * a for f in longer):
            continue
        cuts = []
        for k in range(1, len(phrase)):
            left, right = found[lang, phrase[:k]], found[lang, phrase[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        n = sum(f for (g, p), f in found.items() if g == lang and len(p) == 1)
        out.append((lang, -score, -a, " ".join(phrase).encode(), left, right, n))
    rows, rank = [], Counter()
    for lang, score, a, phrase, left, right, n in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], phrase.decode(), -a, left, right, n, -score))
    return rows


@pytest.fixture(scope="module")
def rows():
    """Few words, so that phrases repeat; a passage with an end of its own; nulls, odd spaces, a hot line."""
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(12))
    out = []
    for i in range(120):
        words = rng.choices(["a", "b", "B", "été", "d\x1ce", "\x00", "中文", "x\xa0y"], [9, 5, 2, 2, 1, 1, 1, 1], k=rng.randrange(30))
        text = "".join(w + rng.choice([" ", "  ", "\t", ". ", "\n", "; "]) for w in words)
        if i % 3 == 0:
            text += "! " + passage + (" tail" if i % 2 else ". end")
        out.append((i, text, rng.choice(["en", "en", None, "und"]), "z", 1))
    out += [(200, None, "en", "z", 1), (None, "", "fr", "z", 1), (201, " \n\t", "xx", "z", 1), (5, "hot line here", "en", "z", 1)]
    return out + [(300, "hot line here", "en", "z", 1)] * 60


def plain(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_all_phrases(spark, rows, monkeypatch):
    documents = spark.createDataFrame(rows, SCHEMA).repartition(3)
    expected = sorted(best(counted(rows), 5))
    assert plain(collocations.mined(documents, least=5)) == expected
    monkeypatch.setattr(collocations, "HELD", 20)  # many flushes, few cells
    monkeypatch.setattr(collocations, "HELD_BYTES", 100)
    monkeypatch.setattr(collocations, "CELLS", 16)
    assert plain(collocations.mined(documents, least=5)) == expected
    assert plain(collocations.mined(documents, least=5, top=3)) == [r for r in expected if r[1] <= 3]


@pytest.mark.parametrize("longest, least", [(3, 4), (5, 1)])
def test_other_lengths(spark, rows, longest, least, monkeypatch):
    monkeypatch.setattr(collocations, "CELLS", 16)
    few = rows[:25]
    documents = spark.createDataFrame(few, SCHEMA)
    counts = collocations.phrase_counts(documents, longest, least)
    found = {(r.lang, tuple(r.phrase.split(" "))): r.f for r in counts.where("size > 0").collect()}
    every = counted(few, longest)
    assert found == {key: f for key, f in every.items() if f >= least}
    assert plain(collocations.mined(documents, longest, least)) == sorted(best(every, least))


def test_paths(spark, rows):
    documents = spark.createDataFrame(rows, SCHEMA)
    counts = collocations.phrase_counts(documents, least=5)
    paths = {(r.lang, r.path): (r.size, r.f) for r in collocations.unary_paths(counts).collect()}
    edges = {(r.lang, r.phrase): r.f for r in counts.where(F.col("size") == 4).collect()}
    windows = Counter()
    for (lang, path), (size, f) in paths.items():
        words = path.split(" ")
        assert len(words) == size
        for i in range(size - 3):
            windows[lang, " ".join(words[i : i + 4])] += 1
            assert edges[lang, " ".join(words[i : i + 4])] == f
    assert windows == Counter(dict.fromkeys(edges, 1))
    passage = " ".join(f"p{i}" for i in range(12))
    assert {path for _, path in paths if "p4 p5 p6 p7" in path} == {passage}


def test_nothing(spark):
    documents = spark.createDataFrame([], SCHEMA)
    assert collocations.mined(documents).count() == 0
    assert collocations.mined(spark.createDataFrame([(1, None, None, "z", 1)], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        collocations.mined(documents, longest=2)
