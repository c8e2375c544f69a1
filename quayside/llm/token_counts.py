"""Token counts from a tokenizer compiled to a finite-state transducer.

The tokenizer merges the adjacent pair of the best score until no pair of pieces makes a piece. A
row of pieces is what it gives for a text exactly if it gives each neighbouring pair for the pair's own
text. So a text can be read from left to right: a *thread* is a place where a piece could have ended,
with that piece and the beginning of the next one that has been read since (a node of the tree of
all pieces). A character leads a thread on to a deeper node; where the node is a piece that fits the one
before it, a new thread begins. Of all threads that end at a place, one at most fits.

The transducer is deterministic: its state is the set of threads with their numbers of pieces, as
differences, and each transition carries how far the count of the first thread moves. States are
made when they are first reached; where no piece holds two characters next to each other, what was before
does not matter, so texts return to few states.

Long texts are cut into chunks. A chunk does not know in which state it is entered, but knows the
threads it can be entered with, as these follow from the last characters before it. It maps each of
them to the threads at its end, with counts; maps of neighbouring chunks compose, in any grouping, and
are composed in rounds like a scan.

Defined results: a NULL or empty text has no tokens (``n_bytes`` 0); strings of special tokens inside a text
are ordinary text; repeated rows are counted each, long equal texts only once; an empty table gives no
rows; only the columns in ``keep`` are kept. A text of the length of a chunk and, where long texts are
cut, the whole text must fit in a task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm.common import blocks, table

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CHUNK = 1 << 15
FAN_IN = 64
TRANSITIONS = 250_000  # kept by a task; beyond that it starts anew
SMALL = 12  # pieces below a node that are all compared
SPACE = "▁"
NONE = -1

# Numbers of fields and kinds in a model file.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2


class Pieces(NamedTuple):
    """Rank of each piece by its score, 0 the best, and whether texts begin with a space.

    ``names`` are the pieces that can be in a result, and single characters that aren't pieces themselves;
    ``halves`` the two pieces each of them is merged from last.
    """

    ranks: dict[str, int]
    prefix: bool
    names: list[str]
    halves: dict[str, list[str]]

    @property
    def longest(self) -> int:
        return max(map(len, self.names), default=1)

    def written(self, text: str) -> str:
        """A text as pieces spell it."""
        if not text:
            return text
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a message."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = number() if key & 7 == 2 else 4 if key & 7 == 5 else 8
        yield key >> 3, message[at : at + size]
        at += size


def read_pieces(path: str) -> Pieces:
    """Pieces of a model file; an error for models that need more than merges by score."""
    import struct

    with open(path, "rb") as file:
        fields = list(_fields(file.read()))
    trainer = dict(_fields(next(v for f, v in fields if f == TRAINER)))
    normalizer = dict(_fields(next(v for f, v in fields if f == NORMALIZER)))
    if trainer.get(3) != BPE or not trainer.get(35) or trainer.get(24):
        raise ValueError("only models with merges and bytes for unknown characters can be compiled")
    if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
        raise ValueError("only models that leave the text as it is can be compiled")
    scored = []
    for field, value in fields:
        if field == PIECE:
            piece = dict(_fields(value))
            kind = piece.get(3, NORMAL)
            if kind not in (NORMAL, UNKNOWN, CONTROL, BYTE):
                raise ValueError(f"pieces of kind {kind} cannot be compiled")
            if kind == NORMAL:
                scored.append((struct.unpack("<f", piece[2])[0], piece[1].decode()))
    ranks = {score: rank for rank, score in enumerate(sorted({score for score, _ in scored}, reverse=True))}
    ranks = {name: ranks[score] for score, name in scored}
    # A piece that its own text does not give never occurs in a result.
    names = [name for name in ranks if len(name) == 1 or merged(name, ranks) == [name]]
    names += [character for character in dict.fromkeys("".join(ranks)) if character not in ranks]
    halves = {name: merged(name, ranks, 2) for name in names if len(name) > 1}
    return Pieces(ranks, bool(normalizer.get(3, 1)), names, halves)


def merged(text: str, ranks: dict[str, int], few: int = 1) -> list[str]:
    """Pieces of a text by the rule itself: the best pair, of equal ones the leftmost, again and again.

    ``few`` ends it early, at that many pieces.
    """
    parts = list(text)
    while len(parts) > few:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            break
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class State(dict):
    """Transitions by character, made when first asked for: next state and change of the count."""

    __slots__ = ("threads", "of")

    def __missing__(self, character: str) -> tuple[State, int]:
        self[character] = made = self.of.follow(self.threads, character)
        return made


#: Node, and the piece before it; near the ends of the tree the pieces below the node that fit it.
Thread = tuple[int, int | tuple[int, ...]]
Map = dict[Thread, dict[Thread, int]]


class Transducer:
    """Counts pieces; states and transitions are compiled on the way."""

    def __init__(self, pieces: Pieces):
        self.written, self.longest = pieces.written, pieces.longest
        self.ranks, self.names, self.halves = pieces.ranks, pieces.names, pieces.halves
        self.weights = [1 if n in self.ranks else len(n.encode()) for n in self.names]
        self.together = {n[i : i + 2] for n in self.names for i in range(len(n) - 1)}
        self.children: list[dict[str, int]] = [{}]
        self.piece: list[int] = [NONE]
        for number, name in enumerate(self.names):
            node = 0
            for character in name:
                below = self.children[node].get(character)
                if below is None:
                    below = self.children[node][character] = len(self.children)
                    self.children.append({})
                    self.piece.append(NONE)
                node = below
            self.piece[node] = number
        self.below = [0] * len(self.children)  # pieces below a node; children have larger numbers
        for node in reversed(range(len(self.children))):
            for child in self.children[node].values():
                self.below[node] += self.below[child] + (self.piece[child] != NONE)
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple, State] = {}
        self.lower: dict[int, tuple[int, ...]] = {}
        self.edges: dict[tuple[int, int], list] = {}
        self.alike: dict[tuple, int | tuple | None] = {}
        self.made = 0

    def prune(self) -> None:
        """Bound the memory; called between texts, where no state is held."""
        if self.made > TRANSITIONS:
            self.forget()

    def edge(self, number: int, side: int) -> list[tuple[str, float]]:
        """What stands at one side (-1 right, 0 left) of a piece while it is merged, and the rank that ends it."""
        found = self.edges.get((number, side))
        if found is None:
            name, ends, found = self.names[number], float("inf"), []
            while True:
                found.append((name, ends))
                if len(name) == 1:
                    break
                ends, name = self.ranks[name], self.halves[name][side]
            found = self.edges[number, side] = found[::-1]
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether the text of two pieces gives these two: no merge across their border comes first."""
        if self.names[left][-1] + self.names[right][0] not in self.together:
            return True
        a, b = self.edge(left, -1), self.edge(right, 0)
        i = j = done = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            across, following = self.ranks.get(x + y, float("inf")), min(x_ends, y_ends)
            if across == following < float("inf") or following <= done and done:  # ranks alone do not tell
                return merged(self.names[left] + self.names[right], self.ranks) == [self.names[left], self.names[right]]
            if across < following:
                return False
            if following == float("inf"):
                return True
            done = following
            if x_ends == following:
                i += 1
            else:
                j += 1

    def under(self, node: int) -> tuple[int, ...]:
        """Pieces below a node."""
        if node in self.lower:
            return self.lower[node]
        found, ahead = [], list(self.children[node].values())
        while ahead:
            at = ahead.pop()
            ahead += self.children[at].values()
            if self.piece[at] != NONE:
                found.append(self.piece[at])
        self.lower[node] = tuple(sorted(found))
        return self.lower[node]

    def like(self, node: int, piece: int | tuple[int, ...]) -> int | tuple[int, ...] | None:
        """The piece before a node as far as it matters there: to the few pieces below.

        None if none of them fits, NONE if all do, otherwise those that do: the same for
        all pieces that are alike here, whichever was met first.
        """
        if piece == NONE or self.below[node] > SMALL:
            return piece
        if (node, piece) not in self.alike:
            under = self.under(node)
            fitting = tuple(p for p in under if (p in piece if isinstance(piece, tuple) else self.fits(piece, p)))
            self.alike[node, piece] = (fitting if len(fitting) < len(under) else NONE) if fitting else None
        return self.alike[node, piece]

    def before(self, piece: int, character: str) -> int:
        """The piece as far as it matters to what begins with a character."""
        if piece != NONE and self.names[piece][-1] + character not in self.together:
            return NONE
        return piece

    def state(self, threads: tuple) -> State:
        state = self.states.get(threads)
        if state is None:
            state = self.states[threads] = State()
            state.threads, state.of = threads, self
        return state

    def start(self) -> State:
        return self.state(((0, NONE, 0),))

    def follow(self, threads: tuple, character: str) -> tuple[State, int]:
        self.made += 1
        ended, going = None, []
        for node, piece, count in threads:
            if node == 0:
                piece = self.before(piece, character)
            below = self.children[node].get(character)
            if below is None:
                if node == 0 and character not in self.children[0]:  # in no piece: its bytes
                    ended = (0, NONE, count + len(character.encode()))
                continue
            number = self.piece[below]
            if number != NONE and (piece == NONE or (number in piece if isinstance(piece, tuple) else self.fits(piece, number))):
                ended = (0, number, count + self.weights[number])
            if self.children[below] and (piece := self.like(below, piece)) is not None:
                going.append((below, piece, count))
        found = ([ended] if ended else []) + going
        if not found:
            return self.state(()), 0
        moved = found[0][2]
        return self.state(tuple((node, piece, count - moved) for node, piece, count in found)), moved

    def run(self, state: State, text: str) -> tuple[State, int]:
        total = 0
        for character in text:
            state, moved = state[character]
            total += moved
        return state, total

    def count(self, text: str) -> int:
        self.prune()
        return self.run(self.start(), self.written(text))[1]

    # --- chunks of a longer text, as pieces spell it --------------------------------------

    def entries(self, before: str, first: str) -> list[Thread]:
        """Threads a chunk can be entered with: all that the characters in front of it allow."""
        if not before:
            return [(0, NONE)]
        found = []
        for back in range(min(self.longest, len(before) + 1)):
            at, node = len(before) - back, 0
            for character in before[at:]:
                node = self.children[node].get(character)
                if node is None:
                    break
            else:
                if node and not self.children[node]:
                    continue
                following = before[at] if back else first
                ends = {self.before(self.piece[n], following) for n in self._ending(before[:at])}
                if node:
                    ends = {self.like(node, piece) for piece in ends} - {None}
                if at and before[at - 1] not in self.children[0] or not at and len(before) < 2 * self.longest:
                    ends.add(NONE)
                found += [(node, piece) for piece in ends]
        return found

    def _ending(self, text: str) -> Iterator[int]:
        """Nodes of the pieces a text can end with."""
        for size in range(1, min(self.longest, len(text)) + 1):
            node = 0
            for character in text[len(text) - size :]:
                node = self.children[node].get(character)
                if node is None:
                    break
            else:
                if self.piece[node] != NONE:
                    yield node

    def chunk_map(self, before: str, chunk: str, after: str) -> Map:
        """The threads at the end of a chunk, with counts, for each it can be entered with."""
        self.prune()
        lanes: dict[int, tuple[State, list]] = {}
        for node, piece in self.entries(before, chunk[:1]):
            state = self.state(((node, piece, 0),))
            lanes.setdefault(id(state), (state, []))[1].append(((node, piece), 0))
        at = 0
        while at < len(chunk) and len(lanes) > 1:
            further: dict[int, tuple[State, list]] = {}
            for state, entered in lanes.values():
                state, moved = state[chunk[at]]
                if state.threads:
                    further.setdefault(id(state), (state, []))[1].extend((e, n + moved) for e, n in entered)
            lanes, at = further, at + 1
        out: Map = {}
        for state, entered in lanes.values():
            state, moved = self.run(state, chunk[at:])
            for entry, count in entered:
                out[entry] = {
                    (node, self.before(piece, after) if node == 0 and after else piece): count + moved + more
                    for node, piece, more in state.threads
                }
        return out


def composed(first: Map, second: Map) -> Map:
    """What the second map makes of what the first one leaves."""
    out: Map = {}
    for entry, left in first.items():
        reached: dict[Thread, int] = {}
        for thread, count in left.items():
            for end, more in second.get(thread, {}).items():
                reached[end] = count + more
        if reached:
            out[entry] = reached
    return out


def packed(made: Map) -> bytes:
    return json.dumps([[*entry, [[*end, n] for end, n in ends.items()]] for entry, ends in made.items()]).encode()


def unpacked(value: bytes) -> Map:
    def whole(piece):
        return tuple(piece) if isinstance(piece, list) else piece

    return {(node, whole(piece)): {(n, whole(p)): count for n, p, count in ends} for node, piece, ends in json.loads(value)}


def _whole(pieces: Pieces):
    """Counts of texts no longer than a chunk, which need no map."""

    def run(batches):
        transducer = Transducer(pieces)
        for block in blocks(batches, "text"):
            texts = block.column("text").to_pylist()
            yield block.drop_columns("text").append_column(
                "n_tokens", pa.array([transducer.count(text or "") for text in texts], pa.int64()))

    return run


def _cut(pieces: Pieces, chunk: int):
    """Chunks of long texts, each with the characters in front of it and the one behind it."""

    def run(batches):
        margin = 2 * pieces.longest
        for block in blocks(batches, "text"):
            for key, text in zip(block.column("key").to_pylist(), block.column("text").to_pylist()):
                text = pieces.written(text)
                for part, start in enumerate(range(0, len(text), chunk)):
                    end = start + chunk
                    yield pa.RecordBatch.from_pydict({
                        "key": [key], "part": pa.array([part], pa.int64()), "before": [text[max(0, start - margin) : start]],
                        "chunk": [text[start:end]], "after": [text[end : end + 1]]})

    return run


def _maps(pieces: Pieces):
    def run(batches):
        transducer = Transducer(pieces)
        for batch in batches:
            rows = batch.to_pydict()
            maps = [packed(transducer.chunk_map(*row)) for row in zip(rows["before"], rows["chunk"], rows["after"])]
            yield pa.RecordBatch.from_pydict({
                "key": batch.column("key"), "part": batch.column("part"), "map": pa.array(maps, pa.binary())})

    return run


def _composed(batches):
    for batch in batches:
        rows = batch.to_pydict()
        for key, part, maps in zip(rows["key"], rows["part"], rows["maps"]):
            maps = [unpacked(m["map"]) for m in maps]
            whole = maps[0]
            for following in maps[1:]:
                whole = composed(whole, following)
            yield pa.RecordBatch.from_pydict({
                "key": [key], "part": pa.array([part], pa.int64()), "map": pa.array([packed(whole)], pa.binary())})


def _counted(batches):
    """The count of a whole text: it is entered at its start and left where a piece ends."""
    for batch in batches:
        counts = []
        for value in batch.column("map").to_pylist():
            ends = unpacked(value)[0, NONE]
            counts.append(next(count for (node, _), count in ends.items() if node == 0))
        yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "n_tokens": pa.array(counts, pa.int64())})


def token_counts(
    documents: DataFrame, model: str, limit: int = LIMIT, keep: Sequence[str] = ("doc_id",), text_column="text",
    chunk: int = CHUNK,
) -> DataFrame:
    """``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every text.

    ``model`` is the path of the tokenizer's model, read on the driver; its pieces go to the tasks.
    Texts of more than ``chunk`` bytes are cut into chunks of that many characters.
    """
    pieces = read_pieces(model)
    own = [f"_{i}" for i in range(len(keep))]
    size = F.coalesce(F.octet_length(text_column), F.lit(0)).cast("bigint")
    rows = documents.select(
        *[F.col(name).alias(o) for name, o in zip(keep, own)], size.alias("n_bytes"), F.col(text_column).alias("text"))
    schema = T.StructType([*rows.drop("text").schema.fields, T.StructField("n_tokens", T.LongType())])

    short = rows.where(F.col("n_bytes") <= chunk).mapInArrow(_whole(pieces), schema)
    longer = rows.where(F.col("n_bytes") > chunk).withColumn("key", F.unhex(F.sha2("text", 256)))
    parts = longer.select("key", "text").mapInArrow(
        _cut(pieces, chunk), "key binary, part bigint, before string, chunk string, after string")
    parts = parts.groupBy("key", "part").agg(*[F.first(c).alias(c) for c in ("before", "chunk", "after")])
    maps = parts.mapInArrow(_maps(pieces), "key binary, part bigint, map binary")
    most = rows.agg(F.max("n_bytes")).first()[0] or 0
    left = -(-(most + 1) // chunk)
    while left > 1:
        maps = maps.groupBy("key", F.floor(F.col("part") / FAN_IN).alias("part")).agg(
            F.array_sort(F.collect_list(F.struct(F.col("part").alias("at"), "map"))).alias("maps")
        ).select("key", "part", "maps").mapInArrow(_composed, "key binary, part bigint, map binary")
        left = -(-left // FAN_IN)
    counted = maps.select("key", "map").mapInArrow(_counted, "key binary, n_tokens bigint")
    long_rows = longer.drop("text").join(counted, "key").select(*short.columns)
    return short.unionByName(long_rows).select(
        *[F.col(o).alias(name) for name, o in zip(keep, own)], "n_bytes", "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"))


def op12_token_counts(spark, folder: str) -> DataFrame:
    """Tokens of every document."""
    import public_tokenizers

    return token_counts(table(spark, folder, "documents"), public_tokenizers.path(MODEL))
