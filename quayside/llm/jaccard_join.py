"""Exact Jaccard join of documents' word shingles by PartEnum signatures.

Sizes are cut into bands whose ends are 1/similarity apart, so a link joins sets of one band or of
two neighbours; a set takes part in the instance of its own band and of the next. In an instance
the sets have at most r elements, so linked ones differ in at most k = 2 r (1 - s) / (1 + s) of
them. The feature domain is hashed into groups of parts. With more than k / (k2 + 1) groups, some
group holds at most k2 of the differences, and leaving out the right k2 of its parts leaves the
same elements in both sets. Each subset of n2 - k2 parts of each group is a signature; linked sets
share one.

Signatures of no elements say nothing, so they are left out: a set is safe under a seed if it has
enough groups without an empty subset, and signs under further seeds until it is. Two linked sets
then both sign under the first seed where one of them is safe, and share a signature there. Under
the first seeds frequent shingles are left out of the sets, which keeps linked sets as near to each
other as they were; so a passage that many documents share does not bring them together. Which
shingles count as frequent changes the work, never the result. The join is exact, up to collisions
of 64-bit hashes.

Signatures meet in a shuffle; all sets of one signature are compared with the smallest of them,
which needs as many comparisons as rows. Where sets of one signature are then still in different
components, their other pairs go through a filter that drops no link, in blocks: in how many of
``BINS`` bins one set has an odd number of shingles and the other has not. Every link is a comparison
of whole texts.

Defined results: NULL texts and texts without words have no shingles and are linked with nothing;
fewer words than a shingle are one shingle; repeated rows are of one component; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm.common import LOWER, blocks, free_name, stored, table, texts_of, without_rows
from quayside.llm.components import connected_components

SHINGLE = 5
PERCENT = 80
SMALL = 256
HOT_IN_BLOCK = 8
BINS = 1024
SENT_IDS = 1 << 20
READ_BYTES = 2 << 20
FREQUENT_SEEDS = 2  # seeds under which frequent shingles are left out
FREQUENT_SHARE, FREQUENT_IN_STRETCH, FREQUENT_MOST = 1 / 4096, 4, 1 << 16
STRETCH_SHINGLES = 4_000_000
LARGE_BUCKET, BLOCK_SETS, SEEN_PAIRS = 64, 512, 1_000_000

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _K1
    x ^= x >> np.uint64(29)
    x *= _K2
    return x ^ (x >> np.uint64(32))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER).split() if text else []


def word_hashes(documents: list[list[bytes]]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, chain.from_iterable(documents)), np.uint64, sum(map(len, documents)))


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values in order; for short arrays much quicker than ``np.unique``."""
    values = np.sort(values)
    new = values[1:] != values[:-1]
    return values if new.all() else values[np.concatenate(([True], new))]


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words."""
    out = hashes[: len(hashes) - width + 1].copy()
    for i in range(1, width):
        out = mixed(out) + hashes[i : len(hashes) - width + 1 + i]
    return mixed(out)


def shingle_sets(documents: list[list[bytes]], size: int = SHINGLE) -> list[np.ndarray]:
    """Distinct hashes of each document's shingles, in order."""
    counts = [len(words) for words in documents]
    flat = word_hashes(documents)
    whole = rolled(flat, size) if len(flat) >= size else flat[:0]
    sets, start = [], 0
    for count in counts:
        if count >= size:
            sets.append(distinct(whole[start : start + count - size + 1]))
        else:
            sets.append(rolled(flat[start : start + count], count) if count else flat[:0])
        start += count
    return sets


def set_id(words: list[bytes], seed: int) -> int:
    """Signed 64-bit number of a word sequence."""
    return xxhash.xxh3_64_intdigest(b" ".join(words), seed=seed) - (1 << 63)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


class Instance:
    """Signature scheme of a size band: g groups of n2 parts, subsets of n2 - k2."""

    def __init__(self, most: int, percent: int):
        self.most = most
        self.k = 2 * most * (100 - percent) // (100 + percent)
        self.n2, self.k2 = (3, 1) if most <= SMALL and self.k else (1, 0)
        needed = self.k // (self.k2 + 1) + 1
        self.groups = 1 if not self.k else needed + max(1, -(-needed * (3 if self.k2 else 5) // 32))
        self.spare = self.groups - needed
        self.subsets = list(combinations(range(self.n2), self.n2 - self.k2))


class Bands:
    """Band of a set size, and the instances a set of that size signs in."""

    def __init__(self, percent: int = PERCENT):
        self.percent, self.ends, self.instances = percent, [1], [Instance(1, percent)]

    def _grow(self, size: int) -> None:
        while self.ends[-1] < size:
            self.ends.append((self.ends[-1] + 1) * 100 // self.percent)
            self.instances.append(Instance(self.ends[-1], self.percent))

    def of(self, size: int) -> list[int]:
        largest = size * 100 // self.percent
        self._grow(max(size, largest))
        own = int(np.searchsorted(self.ends, size))
        return [own, own + 1] if largest > self.ends[own] else [own]


def _without(one: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent) or not len(one):
        return one
    at = np.minimum(np.searchsorted(frequent, one), len(frequent) - 1)
    return one[frequent[at] != one]


def signatures(sets: list[np.ndarray], bands: Bands, frequent=np.zeros(0, np.uint64)) -> tuple[np.ndarray, np.ndarray]:
    """Signatures, and the number of the set each is of; ``frequent`` in order."""
    signs: dict[int, list[int]] = {}
    for number, one in enumerate(sets):
        for band in bands.of(len(one)) if len(one) else ():
            signs.setdefault(band, []).append(number)
    rare = [_without(one, frequent) for one in sets] if len(frequent) else sets
    out, owners = [], []
    for band, members in signs.items():
        scheme, seed = bands.instances[band], 0 if len(frequent) else FREQUENT_SEEDS
        while members:
            used = rare if seed < FREQUENT_SEEDS else sets
            salt = mixed(np.array([band * 1009 + seed + 1], np.uint64))
            flat = mixed(np.concatenate([used[m] for m in members]) ^ salt)
            sizes = np.array([len(used[m]) for m in members])
            row = np.repeat(np.arange(len(members)), sizes)
            parts = scheme.groups * scheme.n2
            at = row * parts + (flat % np.uint64(parts)).astype(np.int64)
            counts = np.bincount(at, minlength=len(members) * parts).reshape(len(members), scheme.groups, scheme.n2)
            sums = np.zeros(len(members) * parts, np.uint64)
            np.add.at(sums, at, mixed(flat))
            sums = sums.reshape(counts.shape)
            empty = np.zeros(counts.shape[:2], bool)
            for which, subset in enumerate(scheme.subsets):
                held = counts[:, :, subset].sum(axis=2) > 0
                empty |= ~held
                place = salt + np.arange(scheme.groups, dtype=np.uint64) * np.uint64(16) + np.uint64(which)
                signed = mixed(sums[:, :, subset].sum(axis=2, dtype=np.uint64) ^ mixed(place))
                out.append(signed[held])
                owners.append(np.array(members)[np.nonzero(held)[0]])
            unsafe = empty.sum(axis=1) > scheme.spare
            members = [m for m, bad in zip(members, unsafe) if bad]
            seed += 1
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(owners)


def repeated(values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Values that occur at least so often, and how often; sorts them where they are."""
    values.sort()
    often = np.unique(values[least - 1 :][values[least - 1 :] == values[: len(values) - least + 1]])
    return often, np.searchsorted(values, often, "right") - np.searchsorted(values, often)


class _Stretch:
    """Shingles of the sets of a task; reports those that several sets of a stretch have."""

    def __init__(self):
        self.held, self.count = np.empty(STRETCH_SHINGLES, np.uint64), 0

    def add(self, one: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.count and self.count + len(one) > len(self.held):
            yield self.report()
        if len(one) > len(self.held):
            self.held = np.empty(len(one), np.uint64)
        self.held[self.count : self.count + len(one)] = one
        self.count += len(one)

    def report(self) -> tuple[np.ndarray, np.ndarray]:
        found = repeated(self.held[: self.count], FREQUENT_IN_STRETCH)
        self.count = 0
        return found


def frequent_shingles(reports: DataFrame, documents: int) -> np.ndarray:
    """Shingles of a noticeable share of all documents, the most frequent ones if they are many, from all reports."""
    found = reports.groupBy("shingle").agg(F.sum("times").alias("n"))
    top = found.where(F.col("n") >= documents * FREQUENT_SHARE).orderBy(F.desc("n"), "shingle").limit(FREQUENT_MOST).toArrow()
    return np.sort(top["shingle"].to_numpy().view(np.uint64))


def block_rows(signs: np.ndarray, ids: np.ndarray):
    """Rows (key, id, main) of a block.

    Where a signature is frequent in the block only its first set is sent under it; that set and
    the others of the block are sent under a key of their own, with the signature as ``main``.
    """
    order = np.argsort(signs)
    given, signs, ids = ids, signs[order], ids[order]
    first = np.flatnonzero(np.concatenate(([True], signs[1:] != signs[:-1])))
    sizes = np.diff(np.append(first, len(signs)))
    # Not the first one of the sorted rows: where signatures are equal, their order is not to matter.
    size, start = np.repeat(sizes, sizes), np.repeat(np.minimum.reduceat(order, first), sizes)
    hot, head = size >= HOT_IN_BLOCK, start == order
    main = np.where(hot, signs, np.uint64(0))
    sub = mixed(signs ^ mixed(given[start].view(np.uint64)))
    key = np.where(hot & ~head, sub, signs)
    again = hot & head
    key, ids, main = (np.concatenate(x) for x in ((key, sub[again]), (ids, ids[again]), (main, main[again])))
    return key.view(np.int64), ids, main.view(np.int64)


class _Stars:
    """Turns rows sorted by (key, id) into rows (bucket, center, id), a batch at a time."""

    def __init__(self):
        self.key = self.ids = self.main = np.zeros(0, np.int64)

    def add(self, key, ids, main, last=False):
        key, ids, main = (np.concatenate(x) for x in ((self.key, key), (self.ids, ids), (self.main, main)))
        if not len(key):
            return None
        same = np.concatenate(([False], (key[1:] == key[:-1]) & (ids[1:] == ids[:-1]) & (main[1:] == main[:-1])))
        key, ids, main = key[~same], ids[~same], main[~same]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        open_ = len(key) if last else first[-1]
        # Of the group that may go on, its first row is kept, and one more while it has but two.
        tail = len(key) - open_
        keep = np.arange(open_, len(key))[: tail if tail <= 2 else 1]
        self.key, self.ids, self.main = key[keep], ids[keep], main[keep].copy()
        if tail > 2 and not self.main[0]:  # so that what follows is not taken for a group of two
            self.main[0] = key[open_]
        sizes = np.diff(np.append(first, len(key)))
        start = np.repeat(first, sizes)
        kept = np.maximum.reduceat((main != 0).astype(np.int8), first).repeat(sizes) > 0
        pair = (sizes.repeat(sizes) == 2) & ~kept
        bucket = np.where(pair, 0, np.where(main != 0, main, key))
        done = (np.arange(len(key)) < open_) if tail <= 2 else np.ones(len(key), bool)
        use = done & (start != np.arange(len(key))) & (ids != ids[start])
        return bucket[use], ids[start][use], ids[use]


def star_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stars, held, count = _Stars(), [], 0

    def out():
        rows = np.unique(np.stack([np.concatenate(x) for x in zip(*held)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in np.ascontiguousarray(rows.T)], ["bucket", "center", "id"])

    none = np.zeros(0, np.int64)
    for batch in batches:
        made = stars.add(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id", "main")))
        if made is not None and len(made[0]):
            held.append(made)
            count += len(made[0])
        if count > 200_000:
            yield out()
            held, count = [], 0
    made = stars.add(none, none, none, last=True)
    if made is not None and len(made[0]):
        held.append(made)
    if held:
        yield out()


def _sketch(one: np.ndarray) -> bytes:
    """A bit for each bin: whether the number of its shingles is odd."""
    counts = np.bincount((one & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _bits(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BINS // 64)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles at least are in one set only: as many as bins are odd in one only."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def set_rows(documents: DataFrame, seed: int) -> DataFrame:
    """doc_id, id and control number of the word sequence, shingles, and bits by bin.

    Beside these rows (``shingle`` NULL), reports of shingles that several sets of a task have: one pass makes both.
    """
    names = ["doc_id", "id", "control", "n", "sketch", "shingle", "times"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches):
        stretch, first = _Stretch(), None

        def reported(shingles, times):
            nothing = [pa.nulls(len(shingles), kind) for kind in (first, *kinds[:4])]
            return pa.RecordBatch.from_arrays([*nothing, pa.array(shingles.view(np.int64)), pa.array(times.astype(np.int64))], names)

        for block in blocks(batches, "text", READ_BYTES):
            first = block.schema.field("doc_id").type
            documents = [words_of(text) for text in texts_of(block.column("text"))]
            sets = shingle_sets(documents)
            ids = [set_id(w, seed) if w else None for w in documents]
            yield pa.RecordBatch.from_arrays([
                block.column("doc_id"), pa.array(ids, pa.int64()),
                pa.array([set_id(w, ~seed & 0xFFFFFFFF) if w else None for w in documents], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_sketch(s) if len(s) else None for s in sets], pa.binary()),
                *(pa.nulls(len(sets), kind) for kind in kinds[4:]),
            ], names)
            for one in {i: s for i, s in zip(ids, sets) if i is not None}.values():
                for found in stretch.add(one):
                    yield reported(*found)
        if stretch.count:
            yield reported(*stretch.report())

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.mapInArrow(
        run, f"doc_id {kind}, id bigint, control bigint, n bigint, sketch binary, shingle bigint, times bigint")


def signature_rows(documents: DataFrame, seed: int, percent: int, frequent: np.ndarray) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        bands = Bands(percent)
        for block in blocks(batches, "text", READ_BYTES):
            unique = {set_id(w, seed): w for w in map(words_of, texts_of(block.column("text"))) if w}
            signs, owners = signatures(shingle_sets(list(unique.values())), bands, sent.value)
            if len(signs):
                key, ids, main = block_rows(signs, np.array(list(unique), np.int64)[owners])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(main)], ["key", "id", "main"])

    return documents.mapInArrow(run, "key bigint, id bigint, main bigint")


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (center, id) whose sizes and bits by bin do not rule a link out."""
    narrow = classes.select("id", "n", "sketch")
    rows = pairs.join(narrow.toDF("center", "n_a", "a"), "center").join(narrow.toDF("id", "n_b", "b"), "id").where(
        (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    )

    def run(batches):
        for batch in batches:
            n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            use = _apart(_bits(batch.column("a")), _bits(batch.column("b"))) * (100 + percent) <= n * (100 - percent)
            yield batch.select(["center", "id"]).filter(pa.array(use))

    return rows.select("center", "id", "n_a", "n_b", "a", "b").mapInArrow(run, "center bigint, id bigint")


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _texts(documents: DataFrame, pairs: DataFrame, seed: int) -> DataFrame:
    """id and words of every set that ``pairs`` names."""
    spark = documents.sparkSession
    needed = stored(pairs.select("id").union(pairs.select("center")).distinct(), "needed")
    sent = None
    if needed.count() <= SENT_IDS:  # at most 8 MB; otherwise the join alone picks the texts
        sent = spark.sparkContext.broadcast(np.sort(needed.toArrow()["id"].to_numpy()))

    def run(batches):
        for block in blocks(batches, "text", READ_BYTES):
            unique = {set_id(w, seed): w for w in map(words_of, texts_of(block.column("text"))) if w}
            wanted = np.ones(len(unique), bool) if sent is None else _among(np.array(list(unique), np.int64), sent.value)
            found = {i: b" ".join(w) for (i, w), use in zip(unique.items(), wanted.tolist()) if use}
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["id", "words"]
            )

    rows = documents.mapInArrow(run, "id bigint, words binary").join(needed, "id", "left_semi")
    return stored(rows.dropDuplicates(["id"]), "words")


def _verified(documents: DataFrame, pairs: DataFrame, seed: int, percent: int) -> DataFrame:
    """Links (a, b): the pairs whose shingle sets are similar, compared whole."""
    pairs = stored(pairs, "pairs")
    texts = _texts(documents, pairs, seed)
    rows = pairs.join(texts, "id").withColumnRenamed("words", "member").join(
        texts.withColumnsRenamed({"id": "center", "words": "middle"}), "center"
    )

    def run(batches):
        center = middle = None
        for batch in batches:
            keep = []
            for c, m, w in zip(batch.column("center").to_pylist(), batch.column("middle"), batch.column("member")):
                if c != center:
                    center, middle = c, shingle_sets([m.as_py().split(b" ")])[0]
                keep.append(similar(middle, shingle_sets([w.as_py().split(b" ")])[0], percent))
            yield batch.select(["center", "id"]).filter(pa.array(keep, pa.bool_())).rename_columns(["a", "b"])

    return stored(rows.select("center", "id", "middle", "member").mapInArrow(run, "a bigint, b bigint"), "verified")


def with_component(rows: DataFrame, components: DataFrame, column: str, name: str) -> DataFrame:
    own = components.select(F.col("node").alias(column), F.col("component").alias(name))
    return rows.join(own, column, "left").withColumn(name, F.coalesce(name, column))


def _near(left, right, percent: int) -> np.ndarray:
    """Pairs (rows of left, rows of right) of different components that the bits do not rule out.

    Both sides are (ids, components, sizes, bits by bin).
    """
    found = []
    for i in range(0, len(left[0]), 32):
        part = slice(i, i + 32)
        most = (left[2][part, None] + right[2]) * (100 - percent)
        rows, columns = np.nonzero((left[1][part, None] != right[1]) & (
            np.minimum(left[2][part, None], right[2]) * 100 >= np.maximum(left[2][part, None], right[2]) * percent))
        use = _apart(left[3][part][rows], right[3][columns]) * (100 + percent) <= most[rows, columns]
        found.append(np.stack((rows[use] + i, columns[use]), axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _sides(table) -> tuple:
    return (*(table.column(c).to_numpy() for c in ("id", "c", "n")), _bits(table.column("sketch")))


def _pairs_table(left, right, found):
    a, b = left[0][found[:, 0]], right[0][found[:, 1]]
    return np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)


def _other_pairs(members: DataFrame, components: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Possible pairs (center, id) of sets that share a signature, but not a component.

    The sets of small buckets are compared bucket by bucket. Large buckets overlap, as those of many
    near copies do: sets they connect are compared once, in blocks of about ``BLOCK_SETS`` by as many,
    each block pair by itself. Only pairs that the bits do not rule out come back.
    """
    sizes = stored(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least")), "bucket-sizes")
    large = sizes.where(F.col("size") > LARGE_BUCKET)
    sides = with_component(classes.select("id", "n", "sketch"), components, "id", "c")
    sides = stored(sides.join(members.select("id").distinct(), "id", "left_semi"), "sides")

    hubs = members.join(large, "bucket").select(F.col("least").alias("a"), F.col("id").alias("b"))
    hubs = stored(connected_components(hubs).toDF("id", "hub"), "hubs")
    blocks_of = stored(hubs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).cast("int").alias("parts")), "hub-sizes")
    dealt = hubs.join(blocks_of, "hub").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.join(sides, "id")
    first = dealt.select("*", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"))
    second = dealt.where("part > 0").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("i"), F.col("part").alias("j"))
    copies = first.unionByName(second)

    def block(key, table):
        own, other = key[1].as_py(), key[2].as_py()
        part = table.column("part").to_numpy()
        left = _sides(table.filter(pa.array(part == own)))
        right = left if own == other else _sides(table.filter(pa.array(part == other)))
        found = _pairs_table(left, right, _near(left, right, percent))
        return pa.table({"center": pa.array(found[:, 0], pa.int64()), "id": pa.array(found[:, 1], pa.int64())})

    between = copies.select("hub", "i", "j", "part", "id", "c", "n", "sketch").groupBy("hub", "i", "j").applyInArrow(
        block, "center bigint, id bigint")

    def buckets(batches):
        seen: set = set()

        def pairs(table):
            side = _sides(table)
            hub = np.array([h or f"none {i}" for i, h in enumerate(table.column("hub").to_pylist())])
            found = _near(side, side, percent)
            same = hub[found[:, 0]] == hub[found[:, 1]]
            new = set(map(tuple, _pairs_table(side, side, found[~same]).tolist())) - seen
            seen.update(new)
            return new

        held, out = None, []
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            bucket = table.column("bucket").to_numpy()
            ends = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            for start, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
                out += pairs(table.slice(start, end - start))
            held = table.slice(int(ends[-1]) if len(ends) else 0)
            if len(seen) > SEEN_PAIRS:
                seen.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["center", "id"])
                out = []
        if held is not None and (out := list(pairs(held))):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["center", "id"])

    small = members.join(sizes.where(F.col("size") <= LARGE_BUCKET).select("bucket"), "bucket", "left_semi")
    small = small.join(sides.join(hubs, "id", "left").withColumn("hub", F.col("hub").cast("string")), "id")
    within = small.select("bucket", "id", "c", "n", "sketch", "hub").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        buckets, "center bigint, id bigint")
    return between.unionByName(within).distinct()


def linked_sets(documents: DataFrame, seed: int, classes: DataFrame, percent: int, frequent: np.ndarray) -> DataFrame:
    """node and component of every set id that has a link."""
    rows = signature_rows(documents, seed, percent, frequent)
    stars = stored(
        rows.repartition("key").sortWithinPartitions("key", "id")
        .mapInArrow(star_rows, "bucket bigint, center bigint, id bigint"), "stars",
    )
    pairs = stored(_possible(stars.select("center", "id").distinct(), classes, percent), "possible")

    def apart(rows, components):
        rows = with_component(with_component(rows, components, "center", "c_a"), components, "id", "c_b")
        return rows.where("c_a <> c_b")

    # One comparison for each set, then those that are still needed.
    first = pairs.groupBy("id").agg(F.min("center").alias("center")).select("center", "id")
    links = _verified(documents, first, seed, percent)
    components = connected_components(links)
    left = stored(apart(pairs, components).select("center", "id").join(first, ["center", "id"], "left_anti"), "left")
    if not left.isEmpty():
        links = links.unionByName(_verified(documents, left, seed, percent))
        components = connected_components(links)

    # Signatures whose sets are not all in one component: their other pairs.
    open_ = stored(apart(stars.where("bucket <> 0"), components).select("bucket").distinct(), "open")
    if not open_.isEmpty():
        inside = stars.join(open_, "bucket", "left_semi")
        members = inside.select("bucket", "id").union(inside.select("bucket", F.col("center"))).distinct()
        rest = _other_pairs(stored(members, "members"), components, classes, percent)
        rest = stored(rest.join(pairs, ["center", "id"], "left_anti"), "rest")
        if not rest.isEmpty():
            links = links.unionByName(_verified(documents, rest, seed, percent))
            components = connected_components(links)
    return components


def _jaccard_components(documents: DataFrame, id_column: str, text_column: str, percent: int):
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    seed = 0
    while True:
        found = stored(set_rows(rows, seed), "sets")
        sets = found.where("shingle IS NULL").drop("shingle", "times")
        classes = stored(sets.where("id IS NOT NULL").groupBy("id").agg(
            F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"),
            F.max("sketch").alias("sketch"), F.min("control").alias("low"), F.max("control").alias("high"),
        ), "classes")
        if classes.where("low <> high").isEmpty():
            break
        seed += 1  # two word sequences with one number: number them anew
    frequent = frequent_shingles(found.where("shingle IS NOT NULL"), sets.count())
    components = linked_sets(rows, seed, classes, percent, frequent)
    merged = stored(with_component(classes.select("id", "first_doc", "rows"), components, "id", "component"), "merged")
    stays = F.min(F.struct(F.col("first_doc").isNull(), "first_doc", "id"))
    least = stored(merged.groupBy("component").agg(stays.alias("stays"), F.sum("rows").alias("rows")).where(
        "rows > 1").select("component", F.col("stays.first_doc").alias("component_id"), F.col("stays.id").alias("stays")
    ), "component-ids")
    named = stored(merged.join(least, "component").select("id", "component_id", "stays"), "named")
    alone = F.col("stays").isNull()
    found = sets.join(named, "id", "left").select(
        "doc_id", "id", F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | ((F.col("stays") == F.col("id")) & F.col("doc_id").eqNullSafe(F.col("component_id")))).alias("stays"),
    )
    return found, seed


def jaccard_components(documents: DataFrame, id_column="doc_id", text_column="text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document, and whether it stays for its component.

    ``component_id`` is the smallest doc_id that links lead to, the document's own included.
    """
    return _jaccard_components(documents, id_column, text_column, percent)[0].drop("id")


def without_near_copies(documents: DataFrame, id_column="doc_id", text_column="text", percent: int = PERCENT) -> DataFrame:
    """Documents with one row of each component, all columns as they are; all without words stay."""
    found, seed = _jaccard_components(documents, id_column, text_column, percent)
    number = free_name(documents.columns, "set_id")
    repeated = F.count(F.lit(1)) > 1
    dropped = found.where("id IS NOT NULL").groupBy(F.col("doc_id").alias(id_column), F.col("id").alias(number)).agg(
        (~F.bool_or("stays")).alias("_all"), repeated.alias("_repeated")
    ).where("_all OR _repeated").drop("_repeated")
    columns = documents.columns

    def run(batches):
        for block in blocks(batches, text_column):
            split = map(words_of, texts_of(block.column(text_column)))
            ids = pa.array([set_id(w, seed) if w else None for w in split], pa.int64())
            yield pa.RecordBatch.from_arrays([*block.columns, ids], [*columns, number])

    schema = T.StructType([*documents.schema.fields, T.StructField(number, T.LongType())])
    return without_rows(documents.mapInArrow(run, schema), dropped, [id_column, number]).drop(number)


def op2_jaccard_join(spark, folder: str) -> DataFrame:
    """Shingle count and component of every document."""
    return jaccard_components(table(spark, folder, "documents")).drop("stays")


OP2_SQL = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(lowered, '[^\x20\x09-\x0D]+') AS words
    FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered
          FROM documents)
), shingles AS (
    SELECT DISTINCT doc_id, words[i : i + 4] AS shingle
    FROM texts, LATERAL (SELECT unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i) WHERE len(words) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM texts
    UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT a AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(b) AS component_id
FROM reach LEFT JOIN sizes ON sizes.doc_id = a GROUP BY a
"""
