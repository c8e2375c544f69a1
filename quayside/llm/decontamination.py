"""Benchmark passages found in training documents by suffix arrays.

Each task sorts the word suffixes of a few megabytes of documents (a shard) and looks up every
suffix of the benchmark items by binary search, all of them at once. The search gives the longest
stretch of words each test suffix shares with the shard and where. Documents never leave their
task, so nothing is shuffled. The benchmark is sent to all tasks in blocks of bounded size; each
block adds its matches to the documents' rows.

Words are maximal runs of letters A-Z (lower-cased), digits and non-ASCII characters. A window is
``size`` consecutive words of an item; an item with fewer words, but not none, is one window.

Defined results: NULL and empty texts have no words and no hits; items without words or with NULL
text never occur; repeated item ids count as one item; items without an id count as one item without a name,
and their passages are hits like any others; an empty benchmark marks nothing; repeated
documents are marked alike; other columns are carried along.

:func:`benchmark_matches` gives every match of every item, a row's worth of them per document; where many
items share a passage, :func:`benchmark_hits` is the one to use: its stretches do not name items, and each item is
named once per document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm.common import LOWER, blocks, free_name, stored, table, texts_of

WINDOW = 10
SHARD_BYTES = 4 << 20
BENCHMARK_BYTES = 8 << 20
_WORD_BYTES = {*b"0123456789", *range(65, 91), *range(97, 123), *range(128, 256)}
_WORDS = bytes(LOWER[b] if b in _WORD_BYTES else 32 for b in range(256))
MATCHES = "array<struct<item_id:string,item_start:bigint,start:bigint,length:bigint>>"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the numbers above 0, ordered by the next ``depth`` numbers, by prefix doubling.

    Zeros stand for words of no item: no suffix starts there.
    """
    active = np.flatnonzero(ids)
    rank, width = ids.astype(np.int64), 1
    order = active[np.argsort(rank[active])]
    while width < depth and len(active):
        after = np.concatenate((rank[width:], np.zeros(width, np.int64)))
        key = rank[active] * (int(rank.max()) + 1) + after[active]
        by = np.argsort(key)
        order, key = active[by], key[by]
        rank = np.zeros(len(ids), np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], key[1:] != key[:-1])))
        width *= 2
    return order


def prefix_range(text: np.ndarray, suffixes: np.ndarray, prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``prefixes``, the range of ``suffixes`` that start with it.

    ``text`` ends with as many zeros as a prefix has columns; a zero in a prefix ends it.
    """
    columns = np.arange(prefixes.shape[1])
    used = prefixes > 0

    def bound(upper: bool) -> np.ndarray:
        low = np.zeros(len(prefixes), np.int64)
        high = np.full(len(prefixes), len(suffixes), np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) // 2
            there = text[suffixes[middle][:, None] + columns]
            ended = np.cumsum(there == 0, axis=1) > 0
            there = np.where(ended, 0, there)
            differs = (there != prefixes[open_]) & used[open_]
            at = differs.argmax(axis=1)
            rows = np.arange(len(open_))
            unequal = differs[rows, at]
            less = unequal & (there[rows, at] < prefixes[open_][rows, at])
            right = less | (~unequal if upper else False)
            low[open_] = np.where(right, middle + 1, low[open_])
            high[open_] = np.where(right, high[open_], middle)

    return bound(False), bound(True)


class Benchmark:
    """Words and windows of a block of items, as numbers."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        self.size = size
        rows, item, at, length, self.names = [], [], [], [], []
        for name, text in items:
            found = words(text)
            if not found:
                continue
            ids = np.array([self.vocabulary.setdefault(word, len(self.vocabulary) + 1) for word in found], np.int32)
            count, held = max(1, len(ids) - size + 1), min(size, len(ids))
            own = np.zeros((count, size), np.int32)
            own[:, :held] = np.lib.stride_tricks.sliding_window_view(ids, held)
            rows.append(own)
            item.append(np.full(count, len(self.names), np.int32))
            at.append(np.arange(count, dtype=np.int32))
            length.append(np.full(count, held, np.int32))
            self.names.append(name)
        none = [np.zeros(0, np.int32)]
        self.item, self.at, self.length = (np.concatenate(x or none).astype(np.int64) for x in (item, at, length))
        every = np.concatenate(rows) if rows else np.zeros((0, size), np.int32)
        # Equal rows next to each other: each distinct window once, and which one every row is.
        order = np.lexsort(every.T[::-1])
        every = every[order]
        new = np.ones(len(every), bool)
        new[1:] = (every[1:] != every[:-1]).any(axis=1)
        self.windows = every[new].astype(np.int64)
        self.which = np.empty(len(every), np.int64)
        self.which[order] = np.cumsum(new) - 1
        #: Items of each window: those from ``starts[w]`` to ``starts[w + 1]``.
        owners = np.unique(np.stack((self.which, self.item), axis=1), axis=0) if len(every) else np.zeros((0, 2), np.int64)
        self.owner, self.starts = owners[:, 1], np.searchsorted(owners[:, 0], np.arange(len(self.windows) + 1))
        self.held = (self.windows > 0).sum(axis=1)

    def _text(self, documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words, a zero behind each document, and where documents start."""
        get = self.vocabulary.get
        sizes = np.array([len(d) for d in documents], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes + 1)))
        text = np.zeros(starts[-1], np.int64)
        for start, document in zip(starts.tolist(), documents):
            text[start : start + len(document)] = [get(word, 0) for word in document]
        return text, starts

    def _ranges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes in order, and the range of those that begin with each window."""
        text = np.concatenate((text, np.zeros(self.size, np.int64)))
        # A word outside the benchmark (zero) starts no match and ends every match that meets it.
        order = suffix_array(text, self.size)
        return order, *prefix_range(text, order, self.windows)

    def hits(self, documents: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], list]]:
        """Stretches of hit words (start, end) of each document, and the items that occur, once each."""
        out: list[tuple[list, list]] = [([], []) for _ in documents]
        if not len(self.windows):
            return out
        text, starts = self._text(documents)
        order, low, high = self._ranges(text)
        found = high - low
        window = np.repeat(np.arange(len(found)), found)
        position = order[np.repeat(low - np.concatenate(([0], np.cumsum(found)[:-1])), found) + np.arange(len(window))]
        if not len(window):
            return out
        change = np.zeros(len(text) + 1, np.int64)
        np.add.at(change, position, 1)
        np.add.at(change, position + self.held[window], -1)
        covered = np.concatenate(([False], np.cumsum(change)[:-1] > 0, [False]))
        edges = np.flatnonzero(covered[1:] != covered[:-1])
        document = np.searchsorted(starts, edges[::2], "right") - 1
        for d, begin, end in zip(document.tolist(), edges[::2].tolist(), edges[1::2].tolist()):
            out[d][0].append((begin - int(starts[d]), end - int(starts[d])))
        # Each window of a document once, then its items: no more rows than documents have different items and windows.
        owner = np.searchsorted(starts, position, "right") - 1
        pairs = np.unique(owner * len(self.windows) + window)
        owner, window = pairs // len(self.windows), pairs % len(self.windows)
        for d in np.unique(owner).tolist():
            own = window[np.searchsorted(owner, d) : np.searchsorted(owner, d, "right")]
            mask = np.zeros(len(self.names), bool)
            for w in own.tolist():
                mask[self.owner[self.starts[w] : self.starts[w + 1]]] = True
            out[d][1].extend(map(self.names.__getitem__, np.flatnonzero(mask).tolist()))
        return out

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window number and position in ``text`` of every occurrence."""
        order, low, high = self._ranges(text)
        found = (high - low)[self.which]
        rows = np.repeat(np.arange(len(self.which)), found)
        first = np.repeat(low[self.which] - np.concatenate(([0], np.cumsum(found)[:-1])), found)
        return rows, order[first + np.arange(len(rows))]

    def matches(self, documents: list[list[bytes]]) -> list[list[dict]]:
        """Longest verbatim matches of each document, as runs of windows."""
        out: list[list[dict]] = [[] for _ in documents]
        if not len(self.windows):
            return out
        text, starts = self._text(documents)
        rows, position = self.occurrences(text)
        if not len(rows):
            return out
        item, shift = self.item[rows], position - self.at[rows]
        order = np.lexsort((position, shift, item))
        item, shift, position, rows = item[order], shift[order], position[order], rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (position[1:] != position[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(rows)])) - 1
        document = np.searchsorted(starts, position[first], "right") - 1
        for d, f, e in zip(document.tolist(), first.tolist(), last.tolist()):
            start = int(position[f] - starts[d])
            out[d].append({
                "item_id": self.names[item[f]], "item_start": int(self.at[rows[f]]), "start": start,
                "length": int(position[e] + self.length[rows[e]] - position[f]),
            })
        return out


def _shards(batches, text):
    for block in blocks(batches, text, SHARD_BYTES):
        yield block, [words(t) for t in texts_of(block.column(text))]


def _benchmark_blocks(benchmark: DataFrame, id_column: str, text_column: str):
    """Items in blocks of about ``BENCHMARK_BYTES``, one on the driver at a time; whether it is the last."""
    items = benchmark.select(
        F.col(id_column).cast("string").alias("id"), F.col(text_column).cast("binary").alias("text")
    ).where("octet_length(text) > 0")
    total = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.length("id"), F.lit(0)))).first()[0] or 0
    count = -(-total // BENCHMARK_BYTES)
    if count <= 1:
        yield items.collect(), True
        return
    count *= 2
    part = F.pmod(F.xxhash64("id", "text"), F.lit(count))
    items = stored(items.withColumn("part", part), "benchmark")
    for k in range(count):
        yield items.where(F.col("part") == k).select("id", "text").collect(), k == count - 1


def benchmark_matches(
    documents: DataFrame, benchmark: DataFrame, size: int = WINDOW,
    text_column="text", item_column="item_id", item_text_column="text", column="matches", keep=None,
    count_column="n_words",
) -> DataFrame:
    """Documents (columns ``keep``, or all) with their number of words and their longest matches.

    A match is a stretch of words a document and an item share, at least one window long.
    """
    added = [T.StructField(count_column, T.LongType()), T.StructField(column, T.DataType.fromDDL(MATCHES))]
    arrow = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int64()),
                                ("start", pa.int64()), ("length", pa.int64())]))
    result, number = documents, 0
    for items, last in _benchmark_blocks(benchmark, item_column, item_text_column):
        columns = (keep or documents.columns) if last else documents.columns
        shared = documents.sparkSession.sparkContext.broadcast([(r["id"], bytes(r["text"])) for r in items])

        def run(batches, shared=shared, first=number == 0, columns=columns):
            index = Benchmark(shared.value, size)
            for block, texts in _shards(batches, text_column):
                found = index.matches(texts)
                if not first:
                    found = [[*old, *new] for old, new in zip(block.column(column).to_pylist(), found)]
                counts = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(block.column(c) for c in columns), counts, pa.array(found, arrow)],
                    [*columns, count_column, column],
                )

        result = result.mapInArrow(run, T.StructType([*documents.select(*columns).schema.fields, *added]))
        number += 1
        if not last and number % 4 == 0:
            result = stored(result, "matches")
    return result


def joined(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches (start, end) in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(stretches):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def benchmark_hits(
    documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, text_column="text", item_column="item_id",
    item_text_column="text", keep=None, names=("n_words", "stretches", "items"),
) -> DataFrame:
    """Documents (columns ``keep``, or all) with their number of words, the stretches of hit words and the items.

    Stretches (start, end) don't overlap; ``items`` are the ids of the items that occur, in order, each once.
    """
    stretch = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    added = [T.StructField(names[0], T.LongType()),
             T.StructField(names[1], T.DataType.fromDDL("array<struct<start:bigint,end:bigint>>")),
             T.StructField(names[2], T.DataType.fromDDL("array<string>"))]
    result, number = documents, 0
    for items, last in _benchmark_blocks(benchmark, item_column, item_text_column):
        columns = (keep or documents.columns) if last else documents.columns
        shared = documents.sparkSession.sparkContext.broadcast([(r["id"], bytes(r["text"])) for r in items])

        def run(batches, shared=shared, first=number == 0, columns=columns):
            index = Benchmark(shared.value, size)
            for block, texts in _shards(batches, text_column):
                found = index.hits(texts)
                if not first:
                    before = zip(block.column(names[1]).to_pylist(), block.column(names[2]).to_pylist())
                    found = [([*((s["start"], s["end"]) for s in old), *new], [*held, *more])
                             for (old, held), (new, more) in zip(before, found)]
                runs = [[{"start": s, "end": e} for s, e in joined(own)] for own, _ in found]
                ids = [sorted(set(own), key=lambda name: (name is None, name or "")) for _, own in found]
                yield pa.RecordBatch.from_arrays(
                    [*(block.column(c) for c in columns), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array(runs, stretch), pa.array(ids, pa.list_(pa.string()))], [*columns, *names])

        result = result.mapInArrow(run, T.StructType([*documents.select(*columns).schema.fields, *added]))
        number += 1
        if not last and number % 4 == 0:
            result = stored(result, "hits")
    return result


def decontaminated(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, **names) -> DataFrame:
    """Documents without any window of the benchmark, with their own columns only."""
    own = [free_name(documents.columns, name) for name in ("n_words", "stretches", "items")]
    marked = benchmark_hits(documents, benchmark, size, names=own, **names)
    return marked.where(F.size(own[1]) == 0).select(*documents.columns)


def op9_decontamination(spark, folder: str) -> DataFrame:
    """Per document: its words, the words hit, the items that occur, and whether any does."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    marked = benchmark_hits(documents, table(spark, folder, "benchmark"), keep=["doc_id"])

    def run(batches):
        for batch in batches:
            names = batch.column("items").to_pylist()
            hit = [sum(s["end"] - s["start"] for s in row) for row in batch.column("stretches").to_pylist()]
            named = [",".join(x for x in row if x is not None) for row in names]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()),
                pa.array([len(x) for x in names], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in named]),
                pa.array([x > 0 for x in hit]),
            ], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return marked.mapInArrow(
        run, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    )


OP9_SQL = r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(lowered, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered
          FROM documents)
), items AS (
    SELECT item_id, regexp_extract_all(lowered, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM (SELECT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM benchmark)
), windows AS (
    SELECT DISTINCT item_id, words[i : i + least(len(words), 10) - 1] AS run
    FROM items, LATERAL (SELECT unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i) WHERE len(words) > 0
), sizes AS (SELECT DISTINCT len(run) AS n FROM windows),
runs AS (
    SELECT doc_id, i, n, words[i : i + n - 1] AS run
    FROM texts, sizes, LATERAL (SELECT unnest(range(1, len(words) - n + 2)) AS i)
), hits AS (SELECT doc_id, item_id, i, n FROM runs JOIN windows USING (run)),
covered AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM hits, LATERAL (SELECT unnest(range(i, i + n)) AS place) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM texts LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
