"""Language of whole texts by a bidirectional gated recurrent network over bytes.

The network reads windows of 64 bytes in both directions and gives every byte a probability per
language; a document's probabilities are the mean over all its bytes. It is trained in numpy by
backpropagation through time on a bounded sample: at most ``SAMPLE_DOCUMENTS`` labelled documents
per language, ``SAMPLE_WINDOWS`` windows of each. Every language with a label is learned; the model and the
sample have a part for each. Prediction uses the text alone and reads all of it.

Defined results: a NULL text, or one without a letter, is ``und`` with score 0; without a labelled
document to learn from every text is ``und``; a NULL id counts as held out; repeated rows get equal
results; an empty table gives no rows; other columns are carried along.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm.common import blocks, free_name, id_remainder, table, texts_of

WINDOW = 64
HIDDEN = 8
SAMPLE_DOCUMENTS = 600
SAMPLE_WINDOWS = 4
STEPS, BATCH, RATE = 300, 64, 0.02
WINDOWS_AT_ONCE = 4096
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


class Cell(NamedTuple):
    """One direction: per byte the gates' input (z, r, n stacked), and the recurrent weights."""

    inputs: np.ndarray  # (3 * HIDDEN, 256)
    gates: np.ndarray  # (2 * HIDDEN, HIDDEN)
    state: np.ndarray  # (HIDDEN, HIDDEN)
    out: np.ndarray  # (languages, HIDDEN)


class Network(NamedTuple):
    languages: list[str]
    forward: Cell
    backward: Cell
    bias: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _run(cell: Cell, steps, keep: bool = False):
    """States after each step of bytes (windows side by side); with ``keep`` what training needs."""
    size = len(cell.state)
    h, states, kept = None, [], []
    for byte, mask in steps:
        if h is None:
            h = np.zeros((size, len(byte)), np.float32)
        zr = _sigmoid(cell.inputs[: 2 * size].take(byte, axis=1) + cell.gates @ h)
        z, r = zr[:size], zr[size:]
        u = cell.state @ h
        n = u * r
        n += cell.inputs[2 * size :].take(byte, axis=1)
        n *= 2
        n = _sigmoid(n)
        n *= 2
        n -= 1
        new = h - n
        new *= z
        new += n
        if mask is not None:
            new *= mask
        if keep:
            kept.append((h, zr, u, n, byte))
        h = new
        states.append(h)
    return (states, kept) if keep else states


def position_probabilities(network: Network, windows: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """(languages, windows): probabilities summed over the positions that count."""
    steps = np.ascontiguousarray(windows.T)
    masks = [None] * len(steps) if mask is None else list(np.ascontiguousarray(mask.T, np.float32))
    order = list(zip(steps, masks))
    ahead = _run(network.forward, order)
    back = _run(network.backward, order[::-1])[::-1]
    total = np.zeros((len(network.languages), windows.shape[0]), np.float32)
    for f, b, m in zip(ahead, back, masks):
        p = network.forward.out @ f
        p += network.backward.out @ b
        p += network.bias
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        total += p if m is None else p * m
    return total


def _grads(cell: Cell, states, kept, d_states) -> Cell:
    """Gradients of one direction by backpropagation through time."""
    size = len(cell.state)
    gates, state = np.zeros_like(cell.gates), np.zeros_like(cell.state)
    inputs = np.zeros_like(cell.inputs)
    d_next = np.zeros_like(states[0])
    eye = np.eye(256, dtype=np.float32)
    for (h, zr, u, n, byte), d in zip(kept[::-1], d_states[::-1]):
        d = d + d_next
        z, r = zr[:size], zr[size:]
        d_n = d * (1 - z) * (1 - n * n)
        d_zr = np.concatenate((d * (h - n) * z * (1 - z), d_n * u * r * (1 - r)))
        d_u = d_n * r
        gates += d_zr @ h.T
        state += d_u @ h.T
        inputs += np.concatenate((d_zr, d_n)) @ eye[byte]
        d_next = d * z + cell.gates.T @ d_zr + cell.state.T @ d_u
    return Cell(inputs, gates, state, None)


def loss_and_grads(network: Network, windows: np.ndarray, labels: np.ndarray):
    """Mean cross-entropy over all positions, and its gradients."""
    steps = [(byte, None) for byte in np.ascontiguousarray(windows.T)]
    ahead, kept_ahead = _run(network.forward, steps, keep=True)
    back, kept_back = _run(network.backward, steps[::-1], keep=True)
    one = np.eye(len(network.languages), dtype=np.float32)[labels].T
    count, loss, d_logits = windows.size, 0.0, []
    for f, b in zip(ahead, back[::-1]):
        p = network.forward.out @ f + network.backward.out @ b + network.bias
        p = np.exp(p - p.max(axis=0))
        p /= p.sum(axis=0)
        loss -= float(np.log((p * one).sum(axis=0) + 1e-30).sum()) / count
        d_logits.append((p - one) / count)
    grads = []
    for cell, states, kept, d in ((network.forward, ahead, kept_ahead, d_logits),
                                  (network.backward, back, kept_back, d_logits[::-1])):
        own = _grads(cell, states, kept, [cell.out.T @ x for x in d])
        grads.append(own._replace(out=sum(x @ s.T for x, s in zip(d, states))))
    return loss, Network(network.languages, *grads, sum(x.sum(axis=1, keepdims=True) for x in d_logits))


def _arrays(network: Network) -> list[np.ndarray]:
    return [*network.forward, *network.backward, network.bias]


def untrained(languages: list[str], seed: int = 0) -> Network:
    rng = np.random.default_rng(seed)

    def cell():
        def draw(*shape):
            return (rng.standard_normal(shape) * 0.3).astype(np.float32)

        return Cell(draw(3 * HIDDEN, 256), draw(2 * HIDDEN, HIDDEN), draw(HIDDEN, HIDDEN), draw(len(languages), HIDDEN))

    return Network(languages, cell(), cell(), np.zeros((len(languages), 1), np.float32))


def train(languages: list[str], windows: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 0) -> Network:
    """Adam on random batches with equal shares of the languages."""
    network, rng = untrained(languages, seed), np.random.default_rng(seed)
    values = _arrays(network)
    means, squares = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    share = np.bincount(labels, minlength=len(languages))[labels]
    chance = 1 / share / (1 / share).sum()
    for step in range(1, steps + 1):
        pick = rng.choice(len(windows), BATCH, p=chance)
        _, grads = loss_and_grads(network, windows[pick], labels[pick])
        rate = RATE * (1 - 0.9 * step / steps)
        for value, mean, square, grad in zip(values, means, squares, _arrays(grads)):
            np.clip(grad, -0.5, 0.5, out=grad)
            mean += 0.1 * (grad - mean)
            square += 0.01 * (grad * grad - square)
            value -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return network


def sample(documents: DataFrame, id_column="doc_id", text_column="text", language_column="lang"):
    """Languages, training windows and their labels, from a bounded number of documents."""
    language = F.col(language_column)
    rows = documents.select(
        id_remainder(id_column, 5).alias("fold"), language.alias("lang"), F.col(text_column).alias("text"),
        F.pmod(F.xxhash64(id_column), F.lit(1 << 30)).alias("draw"),
    ).where("fold <> 0 AND lang IS NOT NULL AND text <> ''").drop("fold")
    counts = rows.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return [], np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64)
    most = [(r["lang"], (1 << 30) * min(1.0, 1.5 * SAMPLE_DOCUMENTS / r["count"])) for r in counts]
    # One row per language, as the model has.
    most = F.broadcast(documents.sparkSession.createDataFrame(most, "lang string, most double"))

    def cut(batches):
        for batch in batches:
            for lang, text, draw in zip(batch["lang"].to_pylist(), texts_of(batch["text"]), batch["draw"].to_pylist()):
                starts = np.linspace(0, max(0, len(text) - WINDOW), SAMPLE_WINDOWS).astype(int).tolist()
                pieces = [text[s : s + WINDOW] for s in starts]
                yield pa.RecordBatch.from_pydict({"lang": [lang], "draw": [draw], "windows": pa.array([pieces], pa.list_(pa.binary()))})

    limit = 2 * SAMPLE_DOCUMENTS * len(languages)
    drawn = rows.join(most, "lang").where(F.col("draw") < F.col("most")).drop("most").orderBy("draw", F.xxhash64("text")).limit(limit)
    taken: dict[str, list] = {name: [] for name in languages}
    for r in drawn.mapInArrow(cut, "lang string, draw bigint, windows array<binary>").collect():
        taken[r["lang"]].append((r["draw"], [bytes(w) for w in r["windows"]]))
    windows, labels = [], []
    for number, name in enumerate(languages):
        for _, pieces in sorted(taken[name])[:SAMPLE_DOCUMENTS]:
            for piece in pieces:
                # Short texts are repeated up to a window.
                windows.append(np.frombuffer((piece * (WINDOW // len(piece) + 1))[:WINDOW], np.uint8))
                labels.append(number)
    return languages, np.array(windows), np.array(labels)


def document_probabilities(network: Network, texts: list[bytes]) -> np.ndarray:
    """(documents, languages): mean probabilities over all bytes; zeros for an empty text."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts])
    padded = b"".join(t.ljust(c * WINDOW, b"\0") for t, c in zip(texts, counts.tolist()))
    windows = np.frombuffer(padded, np.uint8).reshape(-1, WINDOW)
    document = np.repeat(np.arange(len(texts)), counts)
    sizes = np.full(len(windows), WINDOW)
    ends = np.cumsum(counts)[counts > 0] - 1
    sizes[ends] = np.array([len(t) for t in texts])[counts > 0] - (counts[counts > 0] - 1) * WINDOW
    total = np.zeros((len(texts), len(network.languages)))
    for rows, whole in ((np.flatnonzero(sizes == WINDOW), True), (np.flatnonzero(sizes < WINDOW), False)):
        for i in range(0, len(rows), WINDOWS_AT_ONCE):
            part = rows[i : i + WINDOWS_AT_ONCE]
            mask = None if whole else np.arange(WINDOW) < sizes[part][:, None]
            found = position_probabilities(network, windows[part], mask)
            for k in range(len(network.languages)):
                total[:, k] += np.bincount(document[part], found[k], len(texts))
    return total / np.maximum(1, [len(t) for t in texts])[:, None]


def fit(documents: DataFrame, **names) -> Network | None:
    languages, windows, labels = sample(documents, **names)
    return train(languages, windows, labels) if languages else None


def identify(
    documents: DataFrame, network: Network | None, text_column="text", keep=None, names=("lang_pred", "score")
) -> DataFrame:
    """Documents (columns ``keep``, or all) with the predicted language and its score."""
    columns = keep or documents.columns
    plain = network and (network.languages, tuple(network.forward), tuple(network.backward), network.bias)
    shared = documents.sparkSession.sparkContext.broadcast(plain)
    fields = [*documents.select(*columns).schema.fields,
              T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]

    def run(batches):
        network = None
        if shared.value is not None:
            languages, forward, backward, bias = shared.value
            network = Network(languages, Cell(*forward), Cell(*backward), bias)
        for block in blocks(batches, text_column):
            raw = texts_of(block.column(text_column))
            lettered = [bool(t and LETTER.search(t.decode(errors="replace"))) for t in raw]
            labels, scores = [UNKNOWN] * len(raw), [0.0] * len(raw)
            if network is not None:
                at = [i for i, yes in enumerate(lettered) if yes]
                found = document_probabilities(network, [raw[i] for i in at])
                for i, p in zip(at, found):
                    best = int(p.argmax())
                    labels[i], scores[i] = network.languages[best], min(1.0, float(p[best]))
            yield pa.RecordBatch.from_arrays(
                [*(block.column(c) for c in columns), pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                [*columns, *names],
            )

    return documents.mapInArrow(run, T.StructType(fields))


def in_some_language(documents: DataFrame, **columns) -> DataFrame:
    """Documents less those that are in no language: without text or without a letter.

    Where no document has a label to learn from, the others all stay.
    """
    names = [free_name(documents.columns, name) for name in ("lang_pred", "score")]
    network = fit(documents, **columns)
    text = columns.get("text_column", "text")
    if network is None:  # no label to learn from: a text with a letter is in some language all the same
        lettered = F.udf(lambda value: bool(value and LETTER.search(value)), T.BooleanType(), useArrow=True)
        return documents.where(F.coalesce(lettered(F.col(text)), F.lit(False)))
    marked = identify(documents, network, text, names=names)
    return marked.where(F.col(names[0]) != UNKNOWN).select(*documents.columns)


def op5_language_id(spark, folder: str) -> DataFrame:
    """Language of every document, by a network trained on four fifths of them."""
    documents = table(spark, folder, "documents")
    rows = documents.select("doc_id", "text", (id_remainder("doc_id", 5) == 0).alias("held_out"))
    return identify(rows, fit(documents), keep=["doc_id", "held_out"])
