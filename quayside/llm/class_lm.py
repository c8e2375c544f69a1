"""Perplexity under a Brown class-based bigram model.

``P(w | v) = P(class of w | class of v) * P(w | class of w)``. Counts of words, of word pairs and of
class pairs come from all training texts. Classes come from exchange clustering: starting from
classes by frequency, words move to the class that raises the likelihood of the class pairs most,
half of the words in a round. This runs over the ``CLUSTERED`` most frequent words; the other words
of the dictionary (the ``DICTIONARY`` most frequent ones) are then each exchanged once, by the
classes of their neighbours. All rarer words, those seen once among them, form a class of their
own. It emits its words by their counts and, as one more word, everything unseen: that counts as
often as there are words seen once, the estimate of Good and Turing. So the probabilities of all
words and one unseen word add up to 1.

Tasks hold the dictionary, whose size is bounded, and count and score in place. Counts of rarer
words are joined.

Defined results: a NULL or empty text is its end alone; a NULL id counts as held out; without a
training document every word is unseen; repeated rows are scored alike and count as often as they
occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import LOWER, blocks, id_remainder, stored, table, texts_of

CLASSES = 64
CLUSTERED = 4096
DICTIONARY = 1 << 18
ROUNDS = 8
ADDED = 0.1
HELD_WORDS = 300_000
END = b""


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER).split() if text else []


class Dictionary:
    """Numbers of the most frequent words, and of the end; -1 for all others."""

    def __init__(self, words: list[bytes]):
        self.number = {word: i for i, word in enumerate(words)}
        self.end = len(words)

    def numbers(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Numbers of all tokens, each text after an end and with its own; lengths; words."""
        split = [words_of(text) for text in texts]
        flat = [word for words in split for word in (*words, END)]
        get = self.number.get
        found = np.fromiter((get(word, -1) for word in flat), np.int64, len(flat))
        sizes = np.array([len(words) + 1 for words in split])
        found[np.cumsum(sizes) - 1] = self.end
        return found, sizes, flat


def _previous(tokens: np.ndarray, end: int) -> np.ndarray:
    """The token before each one; texts follow each other, so an end comes before each text."""
    return np.concatenate(([end], tokens[:-1]))


def word_counts(texts: DataFrame) -> DataFrame:
    """word and count; the empty word is the end of a text."""

    def run(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
            )

        for block in blocks(batches, "text"):
            for text in texts_of(block.column("text")):
                held.update(words_of(text))
                held[END] += 1
            if len(held) > HELD_WORDS:
                yield out()
                held = Counter()
        if held:
            yield out()

    return texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)


def _pair_counts(texts: DataFrame, dictionary, kind, number_of_kinds: int) -> DataFrame:
    """Counts n of (a, b), the kinds of a token and the next; ``kind`` maps dictionary numbers."""
    shared = texts.sparkSession.sparkContext.broadcast((dictionary, kind))

    def run(batches):
        words, kinds = shared.value
        index = Dictionary(words)
        kinds = np.asarray(kinds, np.int64)
        codes, counts, held = [], [], 0
        for block in blocks(batches, "text"):
            tokens, _, _ = index.numbers(texts_of(block.column("text")))
            code = kinds[_previous(tokens, index.end)] * number_of_kinds + kinds[tokens]
            code, count = np.unique(code, return_counts=True)
            codes.append(code)
            counts.append(count)
            held += len(code)
            if held > 2_000_000:
                merged = _summed(codes, counts)
                codes, counts, held = [merged[0]], [merged[1]], len(merged[0])
                if held > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(codes[0]), pa.array(counts[0])], ["code", "n"])
                    codes, counts, held = [], [], 0
        if codes:
            code, count = _summed(codes, counts)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(count)], ["code", "n"])

    rows = texts.mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    return rows.select(
        F.floor(F.col("code") / number_of_kinds).cast("int").alias("a"),
        (F.col("code") % number_of_kinds).cast("int").alias("b"), "n",
    )


def _entropy_terms(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(classes: np.ndarray, before: np.ndarray, after: np.ndarray, own: np.ndarray, movable: np.ndarray) -> np.ndarray:
    """Best class of each movable word, with all other words where they are.

    ``before`` and ``after`` (words, kinds) count the classes next to a word, ``own`` how often it
    follows itself. Only the first ``CLASSES`` kinds can be moved into.
    """
    kinds = before.shape[1]
    pairs = np.zeros((kinds, kinds))
    np.add.at(pairs, classes, after)
    f = _entropy_terms
    out = classes.copy()
    for word in np.flatnonzero(movable):
        at, left, right = classes[word], before[word].astype(float), after[word].astype(float)
        count = right.sum()
        rest = pairs.copy()
        rest[at] -= right
        rest[:, at] -= left
        rest[at, at] += own[word]
        rest = np.maximum(rest, 0)
        # The word's pairs with itself move with it.
        left[at] -= own[word]
        right[at] -= own[word]
        totals_out, totals_in = rest.sum(axis=1)[:CLASSES], rest.sum(axis=0)[:CLASSES]
        rows, columns = rest[:CLASSES], rest.T[:CLASSES]
        used_right, used_left = np.flatnonzero(right), np.flatnonzero(left)
        gain = (f(rows[:, used_right] + right[used_right]) - f(rows[:, used_right])).sum(axis=1)
        gain += (f(columns[:, used_left] + left[used_left]) - f(columns[:, used_left])).sum(axis=1)
        diagonal = np.arange(CLASSES)
        same = rest[diagonal, diagonal]
        l, r = left[:CLASSES], right[:CLASSES]
        gain += f(same + l + r + own[word]) - f(same + l) - f(same + r) + f(same)
        gain -= f(totals_out + count) - f(totals_out) + f(totals_in + count) - f(totals_in)
        out[word] = int(gain.argmax())
    return out


def likelihood(pairs: np.ndarray) -> float:
    """Log-likelihood of the class pairs, up to a constant of the words."""
    f = _entropy_terms
    return float(f(pairs).sum() - f(pairs.sum(axis=0)).sum() - f(pairs.sum(axis=1)).sum())


def cluster(pairs: DataFrame, words: int) -> np.ndarray:
    """Classes of the clustered words, by exchange in rounds; the best round is kept.

    ``pairs`` counts (a, b) of word numbers, ``words`` for all other words, ``words + 1`` for ends.
    What reaches the driver has a row per word and class.
    """
    spark = pairs.sparkSession
    fixed = np.array([CLASSES, CLASSES + 1])
    classes = np.concatenate((np.arange(words) % CLASSES, fixed))
    kinds = CLASSES + 2
    itself = pairs.where("a = b").toArrow()
    own = np.zeros(words + 2)
    own[itself["a"].to_numpy()] = itself["n"].to_numpy()
    best, best_value = classes, -np.inf
    rng = np.random.default_rng(0)
    for number in range(ROUNDS + 1):
        named = spark.createDataFrame(pa.table({"w": np.arange(words + 2, dtype=np.int32), "c": classes.astype(np.int32)}))
        named = F.broadcast(named)  # one row per clustered word
        after = pairs.join(named.toDF("b", "c"), "b").groupBy(F.col("a").alias("w"), "c").agg(F.sum("n").alias("n"))
        before = pairs.join(named.toDF("a", "c"), "a").groupBy(F.col("b").alias("w"), "c").agg(F.sum("n").alias("n"))
        found = after.withColumn("side", F.lit(1)).unionByName(before.withColumn("side", F.lit(0))).toArrow()
        profile = np.zeros((2, words + 2, kinds))
        profile[found["side"].to_numpy(), found["w"].to_numpy(), found["c"].to_numpy()] = found["n"].to_numpy()
        matrix = np.zeros((kinds, kinds))
        np.add.at(matrix, classes, profile[1])
        value = likelihood(matrix)
        if value > best_value:
            best, best_value = classes, value
        if number == ROUNDS:
            return best[:words]
        movable = rng.random(words + 2) < 0.5
        movable[words:] = False
        classes = exchange(classes, profile[0], profile[1], own, movable)


def _neighbours(texts: DataFrame, dictionary, classes) -> DataFrame:
    """number, and the classes before and after each occurrence, of the words without a class yet."""
    shared = texts.sparkSession.sparkContext.broadcast((dictionary, classes))

    def run(batches):
        words, classes = shared.value
        index = Dictionary(words)
        clustered = len(classes)
        # By number: clustered words, the rest of the dictionary, the end; last (-1) all others.
        kind = np.full(len(words) + 2, CLASSES, np.uint8)
        kind[:clustered] = classes
        kind[index.end] = CLASSES + 1
        for block in blocks(batches, "text", 16 << 20):
            tokens, _, _ = index.numbers(texts_of(block.column("text")))
            near = kind[tokens]
            at = np.flatnonzero((tokens >= clustered) & (tokens < index.end))
            if not len(at):
                continue
            codes = np.stack((np.concatenate(([CLASSES + 1], near[:-1]))[at], near[at + 1]), axis=1).astype(np.uint8)
            order = np.argsort(tokens[at], kind="stable")
            number, first = np.unique(tokens[at][order], return_index=True)
            offsets = np.append(first, len(at)).astype(np.int32) * 2
            column = pa.BinaryArray.from_buffers(
                pa.binary(), len(number), [None, pa.py_buffer(offsets), pa.py_buffer(codes[order].tobytes())]
            )
            yield pa.RecordBatch.from_arrays([pa.array(number), column], ["number", "codes"])

    return texts.mapInArrow(run, "number bigint, codes binary")


def _placed(neighbours: DataFrame, pairs: np.ndarray) -> DataFrame:
    """number and class: one exchange of each word against the counted class pairs."""
    kinds = CLASSES + 2

    def run(batches):
        into = np.log(pairs[:, :CLASSES] + 0.5)  # (class before, candidate)
        out_of = np.log(pairs[:CLASSES] + 0.5).T  # (class after, candidate)
        total = np.log(pairs[:CLASSES].sum(axis=1) + 1) + np.log(pairs[:, :CLASSES].sum(axis=0) + 1)

        def best(numbers, profile):
            score = profile[:, 0] @ into + profile[:, 1] @ out_of - profile[:, 0].sum(axis=1)[:, None] * total
            return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(score.argmax(axis=1).astype(np.int32))], ["number", "class"])

        last, carried = None, np.zeros((2, kinds))
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column("number").to_numpy()
            codes = batch.column("codes").to_pylist()
            sizes = np.array([len(c) // 2 for c in codes])
            unique, row = np.unique(numbers, return_inverse=True)
            flat = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, 2).astype(np.int64)
            at = np.repeat(row, sizes) * kinds
            profile = np.stack([
                np.bincount(at + flat[:, side], minlength=len(unique) * kinds).reshape(-1, kinds) for side in (0, 1)
            ], axis=1).astype(float)
            if last is not None and unique[0] == last:
                profile[0] += carried
            elif last is not None:
                yield best(np.array([last]), carried[None])
            last, carried = int(unique[-1]), profile[-1]
            if len(unique) > 1:
                yield best(unique[:-1], profile[:-1])
        if last is not None:
            yield best(np.array([last]), carried[None])

    rows = neighbours.repartition("number").sortWithinPartitions("number")
    return rows.mapInArrow(run, "number bigint, class int")


class Model(NamedTuple):
    """What scoring needs in every task; sizes follow from the parameters alone."""

    words: list[bytes]
    counts: np.ndarray  # by dictionary number, then the end
    classes: np.ndarray  # by dictionary number; then the end's, then that of all others
    transitions: np.ndarray  # log10 P(class | class before)
    emissions: np.ndarray  # log10 P(word | class) by dictionary number, then the end
    tokens: int
    distinct: int
    rare_tokens: int
    once: int


def _dictionary(vocabulary: DataFrame, limit: int) -> tuple[list[bytes], np.ndarray]:
    """Words seen at least twice, and often enough that they keep within ``limit``."""
    by_count = vocabulary.where((F.octet_length("word") > 0) & (F.col("n") > 1)).groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    steps = by_count.orderBy(F.desc("n")).limit(limit + 1).toArrow().sort_by([("n", "descending")])
    enough = np.flatnonzero(np.cumsum(steps["words"].to_numpy()) <= limit)
    if not len(enough):
        return [], np.zeros(0, np.int64)
    least = int(steps["n"][int(enough[-1])].as_py())
    rows = vocabulary.where((F.col("n") >= least) & (F.octet_length("word") > 0)).toArrow()
    rows = rows.sort_by([("n", "descending"), ("word", "ascending")])
    return rows["word"].to_pylist(), rows["n"].to_numpy()


def train(texts: DataFrame, limit: int = DICTIONARY, clustered: int = CLUSTERED) -> tuple[Model, DataFrame]:
    """Model of the texts (column ``text``), and the counts of all their words."""
    vocabulary = stored(word_counts(texts), "vocabulary")
    is_end = F.octet_length("word") == 0
    tokens, distinct, ends, once = vocabulary.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)),
        F.coalesce(F.sum(F.when(is_end, F.col("n"))), F.lit(0)), F.count_if(~is_end & (F.col("n") == 1)),
    ).first()
    words, counts = _dictionary(vocabulary, limit)
    top = min(clustered, len(words))

    kinds = np.full(len(words) + 2, top)
    kinds[:top] = np.arange(top)
    kinds[len(words)] = top + 1
    classes = np.full(len(words) + 2, CLASSES)
    classes[len(words)] = CLASSES + 1
    if top:
        numbered = stored(_pair_counts(texts, words[:], kinds.tolist(), top + 2), "pairs")
        classes[:top] = cluster(numbered, top)
        # Words without a class of their own are one kind there already.
        pairs = _grouped_pairs(numbered, np.append(classes[:top], (CLASSES, CLASSES + 1)))
        rest = _placed(_neighbours(texts, words, classes[:top].tolist()), pairs).toArrow()
        classes[rest["number"].to_numpy()] = rest["class"].to_numpy()
    pairs = _class_pairs(texts, words, classes)

    rare_tokens = int(tokens - ends - counts.sum())
    of_class = np.bincount(classes[: len(words)], counts, CLASSES + 2)
    of_class[CLASSES], of_class[CLASSES + 1] = rare_tokens + once, ends
    share = (of_class + 1) / (of_class.sum() + len(of_class))
    smooth = (pairs + share) / (pairs.sum(axis=1, keepdims=True) + 1)
    emissions = np.append(np.log10(counts / np.maximum(1, of_class[classes[: len(words)]])), 0.0)
    model = Model(words, np.append(counts, ends), classes, np.log10(smooth), emissions,
                  int(tokens), int(distinct), rare_tokens, int(once))
    return model, vocabulary


def _grouped_pairs(pairs: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Counts of class pairs from those of kinds; ``classes`` has one of each kind."""
    rows = pa.table({"kind": np.arange(len(classes), dtype=np.int32), "class": classes.astype(np.int32)})
    named = F.broadcast(pairs.sparkSession.createDataFrame(rows))  # one row per clustered word
    found = pairs.join(named.toDF("a", "before"), "a").join(named.toDF("b", "after"), "b").groupBy("before", "after").agg(
        F.sum("n").alias("n")).toArrow()
    counts = np.zeros((CLASSES + 2, CLASSES + 2))
    counts[found["before"].to_numpy(), found["after"].to_numpy()] = found["n"].to_numpy()
    return counts


def _class_pairs(texts: DataFrame, words: list[bytes], classes: np.ndarray) -> np.ndarray:
    kinds = CLASSES + 2
    found = _pair_counts(texts, words, classes.tolist(), kinds).toArrow()
    pairs = np.zeros((kinds, kinds))
    pairs[found["a"].to_numpy(), found["b"].to_numpy()] = found["n"].to_numpy()
    return pairs


def score(documents: DataFrame, model: Model, vocabulary: DataFrame) -> DataFrame:
    """Documents' columns but ``text``, with n_tokens, n_known, base_score and score.

    ``base_score`` is that of a unigram model with ``ADDED`` for each word and one unseen word.
    """
    columns = [c for c in documents.columns if c != "text"]
    plain = tuple(model)
    shared = documents.sparkSession.sparkContext.broadcast(plain)
    whole = np.log10(model.tokens + ADDED * (model.distinct + 1))
    unseen = model.once + ADDED
    rare = np.log10(model.rare_tokens + unseen)
    rarely = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))

    def run(batches):
        words, counts, classes, transitions, emissions = shared.value[:5]
        index = Dictionary(words)
        unigram = np.append(np.log10(counts + ADDED) - whole, -whole)
        emitted = np.append(emissions, -rare)
        seen = np.append(counts > 0, False)
        for block in blocks(batches, "text"):
            tokens, sizes, flat = index.numbers(texts_of(block.column("text")))
            kinds = classes[tokens]
            steps = transitions[_previous(kinds, CLASSES + 1), kinds] + emitted[tokens]
            first = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(sizes)), sizes)
            others: list[list[dict]] = [[] for _ in sizes]
            at = np.flatnonzero(tokens < 0)
            times = Counter(zip(row[at].tolist(), map(flat.__getitem__, at.tolist())))
            for (number, word), n in times.items():
                others[number].append({"word": word, "times": n})
            yield pa.RecordBatch.from_arrays([
                *(block.column(c) for c in columns), pa.array(sizes),
                pa.array(np.add.reduceat(seen[tokens].astype(np.int64), first)),
                pa.array(np.add.reduceat(unigram[tokens], first)), pa.array(np.add.reduceat(steps, first)),
                pa.array(others, rarely),
            ], [*columns, "n_tokens", "known", "base", "steps", "others"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*columns).schema)
    rows = documents.mapInArrow(run, f"{schema}, n_tokens bigint, known bigint, base double, steps double, "
                                     "others array<struct<word:binary,times:bigint>>")
    rows = stored(rows.withColumn("row_id", F.monotonically_increasing_id()), "scores")
    others = rows.select("row_id", F.explode("others").alias("o")).select("row_id", "o.word", "o.times")
    n = F.coalesce("n", F.lit(0))
    found = others.join(vocabulary, "word", "left").groupBy("row_id").agg(
        F.sum(F.col("times") * F.log10(n + ADDED)).alias("base_more"),
        F.sum(F.col("times") * F.log10(F.when(n > 0, n).otherwise(unseen))).alias("more"),
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("also"),
    )
    base_more, more = F.coalesce("base_more", F.lit(0.0)), F.coalesce("more", F.lit(0.0))
    return rows.drop("others").join(found, "row_id", "left").select(
        *columns, "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        (F.col("base") + base_more).alias("base_score"), (F.col("steps") + more).alias("score"),
    )


def op3_class_lm(spark, folder: str) -> DataFrame:
    """log10 probability of every document, learned from nine tenths of them."""
    documents = table(spark, folder, "documents").select(
        "doc_id", (id_remainder("doc_id", 10) == 0).alias("held_out"), "text"
    )
    model, vocabulary = train(documents.where("NOT held_out").select("text"))
    scored = score(documents, model, vocabulary)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        "base_score", "score",
    )


