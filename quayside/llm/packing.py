"""Token sequences of fixed capacity by harmonic packing.

A piece of ``n`` tokens belongs to class ``capacity // n``: that many pieces of the class always
fit one bin, so each class fills its bins with a fixed count and needs no search. Documents are
cut so that pieces come close to the largest length of their class (capacity/1, capacity/2, ...),
which leaves little padding. Every worker packs on its own; full bins never leave it. Only the
pieces of its unfinished bins, a bounded number, are packed again in groups of workers, round by
round, until one group is left, whose last few pieces go first-fit into what remains.

Defined results: a NULL text counts as empty; an empty text is its end token alone; the name of a special token
inside a text is that token, as the tokenizer has it when loaded; repeated rows are packed each on its own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import blocks, kept, table, texts_of
from quayside.session import scratch_folder

CAPACITY = 1024
SLACK = 1 / 64
GROUP = 64
CACHED_WORDS = 700_000
ENCODED_AT_ONCE = 4096
TOKENIZER = "byte_bpe_50k.json"


class Encoder:
    """Token ids of texts, as little-endian 32-bit numbers, with a cache of words.

    The tokenizer splits in front of a space that follows a non-space, so the parts of a text
    between such spaces are encoded on their own and remembered. A text with white space before
    a space is encoded whole, and so is one that spells a special token, which becomes that token's id.

    When half of the words to remember are new, the half before is let go, but for what was met since: rare
    words make room, frequent ones stay.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.cached_words, self.as_loaded = path, cached_words, None
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.special = [token.content.encode() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[bytes, bytes | None] = {}
        self.before: dict[bytes, bytes | None] = {}
        space = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0][0]
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.opens[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(space)]] = True

    @classmethod
    def of(cls, path: str, cached_words: int = CACHED_WORDS) -> Encoder:
        """The Python worker's encoder for a file, kept between tasks of packing."""
        return kept(f"encoder of {path}, {cached_words}", lambda: cls(path, cached_words))

    def _encode_special(self, text: str) -> bytes:
        """Ids of a text with special tokens in it, by the tokenizer as loaded, which few tasks need."""
        if self.as_loaded is None:
            self.as_loaded = type(self.tokenizer).from_file(self.path)
        return np.array(self.as_loaded.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[bytes]) -> dict[bytes, bytes | None]:
        """Ids of words behind a space; None for those that cannot be encoded on their own.

        Many go in one text: exactly the first token of each begins with a space.
        """
        odd = [word for word in words if not word or not 32 < word[-1] < 127]
        found = {word: None for word in odd if not word or word[-1] < 33 or word[-1] > 127 and word.decode()[-1].isspace()}
        if found:
            words = [word for word in words if word not in found]
        for i in range(0, len(words), ENCODED_AT_ONCE):
            part = words[i : i + ENCODED_AT_ONCE]
            ids = self._encode([" " + b" ".join(part).decode()])[0]
            first = np.flatnonzero(self.opens[np.frombuffer(ids, "<u4")])
            if len(first) != len(part):
                raise ValueError("the tokenizer does not start a token at each space")
            ends = np.append(first[1:] * 4, len(ids)).tolist()
            found.update(zip(part, map(ids.__getitem__, map(slice, (first * 4).tolist(), ends))))
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [text.split(b" ") for text in texts]
        new = set()
        for parts in split:
            new.update(parts[1:])
        new -= self.words.keys()
        again = new & self.before.keys()
        self.words.update(zip(again, map(self.before.__getitem__, again)))
        self.words.update(self._encode_words(list(new - again)))
        known = self.words.__getitem__
        heads = [parts[0].decode() for parts in split]
        out = []
        for text, parts, head, start in zip(texts, split, heads, self._encode(heads)):
            if any(token in text for token in self.special):
                out.append(self._encode_special(text.decode()))
                continue
            try:
                if len(parts) > 1 and head and head[-1].isspace():
                    raise TypeError
                out.append(start + b"".join(map(known, parts[1:])))
            except TypeError:
                out.append(self._encode([text.decode()])[0])
        if len(self.words) > self.cached_words // 2:
            self.before, self.words = (self.words if len(self.words) <= self.cached_words else {}), {}
        return out


def piece_lengths(tokens: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Lengths a document is cut into: whole bins first, then near the largest of each class."""
    lengths = [capacity] * (tokens // capacity)
    left = tokens % capacity
    while left:
        count = capacity // left
        length = left if left >= (capacity // count) * (1 - slack) else capacity // (count + 1)
        lengths.append(length)
        left -= length
    return lengths


class Bins:
    """Open bins of one worker, one per class."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.base, self.made = capacity, base, 0
        self.open: dict[int, list] = {}

    def close(self, pieces: list) -> list[tuple]:
        """Rows of a finished bin: piece, sequence, offset, padded length."""
        total = sum(piece[2] for piece in pieces)
        padded = total if total & (total - 1) == 0 else self.capacity
        rows, offset = [], 0
        for piece in pieces:
            rows.append((*piece[:5], self.base + self.made, offset, padded, *piece[5:]))
            offset += piece[2]
        self.made += 1
        return rows

    def add(self, piece: tuple) -> list[tuple]:
        count = self.capacity // piece[2]
        held = self.open.setdefault(count, [])
        held.append(piece)
        if len(held) < count:
            return []
        del self.open[count]
        return self.close(held)

    def left(self) -> list[tuple]:
        return [piece for held in self.open.values() for piece in held]

    def first_fit(self) -> Iterator[list[tuple]]:
        """What is left, longest first, each into the first bin with room."""
        bins: list[list] = []
        room: list[int] = []
        for piece in sorted(self.left(), key=lambda p: -p[2]):
            at = next((i for i, r in enumerate(room) if r >= piece[2]), len(bins))
            if at == len(bins):
                bins.append([])
                room.append(self.capacity)
            bins[at].append(piece)
            room[at] -= piece[2]
        yield from map(self.close, bins)


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"]
IDS = pa.list_(pa.int32())


def _batch(rows: list[tuple], kinds: list[pa.DataType], tail: bool) -> pa.RecordBatch:
    """Rows (columns, then ids as bytes if they are wanted) as a batch."""
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    arrays = [pa.array(c, k) if k is not IDS else _id_lists(c) for c, k in zip(columns, kinds)]
    names = [*COLUMNS, "ids"][: len(kinds)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([tail] * len(rows), pa.bool_())], [*names, "tail"])


def _id_lists(column: tuple[bytes, ...]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(ids) // 4 for ids in column)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(column), "<i4")))


def pack(
    documents: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, slack: float = SLACK,
    id_column="doc_id", text_column="text", with_ids: bool = True, cached_words: int = CACHED_WORDS,
) -> DataFrame:
    """One row per piece: its document, start and length there, ids, and place in a sequence.

    ``ids_crc32`` is the checksum of the ids as little-endian 32-bit numbers, ``padded_length`` what
    the sequence is padded to: the capacity, or its own length where that is a power of two. A worker keeps the
    ids of ``cached_words`` words and those of two blocks, about 200 bytes each; fewer cost more time.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
              f"offset bigint, padded_length bigint{', ids array<int>' if with_ids else ''}, tail boolean")

    def types(batch):
        return [batch.schema.field("doc_id").type, *[pa.int64()] * 7, *([IDS] if with_ids else [])]

    def left(bins, kinds):
        return _batch([(*piece[:5], None, None, None, *piece[5:]) for piece in bins.left()], kinds, True)

    def first_round(batches):
        encoder = Encoder.of(tokenizer, cached_words)
        bins, kinds = Bins(capacity, TaskContext.get().partitionId() << 40), None
        end = np.array([end_id], "<u4").tobytes()
        for block in blocks(batches, "text", keep=True):
            kinds, out = types(block), []
            encoded = encoder.encode([text or b"" for text in texts_of(block.column("text"))])
            for doc, ids in zip(block.column("doc_id").to_pylist(), encoded):
                ids += end
                total, start = len(ids) // 4, 0
                for length in piece_lengths(total, capacity, slack):
                    own = ids[4 * start : 4 * (start + length)]
                    out += bins.add((doc, start, length, zlib.crc32(own), total, *([own] if with_ids else [])))
                    start += length
            yield _batch(out, kinds, False)
        if kinds:
            yield left(bins, kinds)

    def next_round(number: int, last: bool):
        def run(batches):
            bins, kinds = Bins(capacity, number << 60 | TaskContext.get().partitionId() << 40), None
            for batch in batches:
                kinds, out = types(batch), []
                columns = [batch.column(c).to_pylist() for c in COLUMNS[:5]]
                if with_ids:
                    columns.append([np.array(ids, "<i4").tobytes() for ids in batch.column("ids").to_pylist()])
                for piece in zip(*columns):
                    out += bins.add(piece)
                yield _batch(out, kinds, False)
            if kinds and last:
                yield _batch([row for rows in bins.first_fit() for row in rows], kinds, False)
            elif kinds:
                yield left(bins, kinds)

        return run

    folder = scratch_folder(spark, "packed")
    workers = rows.rdd.getNumPartitions()
    step, number = rows.mapInArrow(first_round, schema), 0
    while True:
        step.write.partitionBy("tail").parquet(f"{folder}/round={number}")
        done = spark.read.schema(schema).parquet(f"{folder}/round={number}")
        full = done.where(~F.col("tail")) if number == 0 else full.unionByName(done.where(~F.col("tail")))
        if number and workers == 1:
            return full.drop("tail")
        workers, number = -(-workers // GROUP), number + 1
        tails = done.where("tail").drop("tail").coalesce(workers)
        step = tails.mapInArrow(next_round(number, workers == 1), schema)


def op6_packing(spark, folder: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    return pack(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), with_ids=False)
