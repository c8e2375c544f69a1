"""Learned models against their formulas, computed one token or byte at a time."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm import class_lm, language_id
from quayside.llm.catalogue import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()


def test_class_model_scores_token_by_token(spark, documents):
    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    tokens = {i: [*t.lower().split(), b""] for i, t in texts.items()}
    training = [ts for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 10]
    learned = documents.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0)
    model, _ = class_lm.train(learned.select("text"))

    counts = Counter(t for ts in training for t in ts)
    number = {word: i for i, word in enumerate(model.words)}
    other, end = class_lm.CLASSES, class_lm.CLASSES + 1
    kind = {word: int(model.classes[i]) for word, i in number.items()} | {b"": end}
    pairs, of_class = Counter(), Counter()
    for ts in training:
        for a, b in zip([b"", *ts], ts):
            pairs[kind.get(a, other), kind.get(b, other)] += 1
    for word, n in counts.items():
        of_class[kind.get(word, other)] += n
    once = sum(n == 1 for word, n in counts.items() if word)
    of_class[other] += once  # everything unseen counts as often as words were seen once
    classes, total = class_lm.CLASSES + 2, sum(of_class.values())
    share = [(of_class[c] + 1) / (total + classes) for c in range(classes)]
    begun = Counter()
    for (a, _), n in pairs.items():
        begun[a] += n

    def log10(word, before):
        a, b = kind.get(before, other), kind.get(word, other)
        transition = (pairs[a, b] + share[b]) / (begun[a] + 1)
        if word == b"":
            return math.log10(transition)
        weight = counts[word] or once + class_lm.ADDED
        of = of_class[b] if b != other else of_class[b] + class_lm.ADDED
        return math.log10(transition * weight / of)

    found = {r.doc_id: r.score for r in QUERIES["op3_class_lm"](spark, FOLDER).collect()}
    assert found.keys() == tokens.keys()
    for i, ts in tokens.items():
        expected = sum(log10(word, before) for word, before in zip(ts, [b"", *ts]))
        assert found[i] == pytest.approx(expected, rel=1e-6)


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def states(cell, window):
    """Gated recurrent states after each byte, from the textbook's equations."""
    h, out, size = np.zeros(len(cell.state)), [], len(cell.state)
    inputs, gates, state = (np.asarray(x, np.float64) for x in (cell.inputs, cell.gates, cell.state))
    for byte in window:
        z = sigmoid(inputs[:size, byte] + gates[:size] @ h)
        r = sigmoid(inputs[size : 2 * size, byte] + gates[size:] @ h)
        n = np.tanh(inputs[2 * size :, byte] + r * (state @ h))
        h = (1 - z) * n + z * h
        out.append(h)
    return out


def test_language_byte_by_byte(spark, documents):
    network = language_id.fit(documents)
    found = {r.doc_id: r for r in QUERIES["op5_language_id"](spark, FOLDER).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    short = sorted((i for i in texts if found[i].lang_pred != "und"), key=lambda i: len(texts[i]))[:25]
    for i in short:
        total = np.zeros(len(network.languages))
        for start in range(0, len(texts[i]), language_id.WINDOW):
            window = texts[i][start : start + language_id.WINDOW]
            ahead, back = states(network.forward, window), states(network.backward, window[::-1])[::-1]
            for f, b in zip(ahead, back):
                logits = network.forward.out @ f + network.backward.out @ b + network.bias[:, 0]
                p = np.exp(logits - logits.max())
                total += p / p.sum()
        total /= len(texts[i])
        assert found[i].score == pytest.approx(total.max(), abs=1e-4)
        assert found[i].lang_pred == network.languages[int(total.argmax())]
