"""Collocations of words, mined from a weighted de Bruijn graph.

An edge of the graph is a run of ``longest`` words; it leads from the node of its first words to
that of its last. A window starts at every word of a piece: an edge where the piece has words enough,
and what is left of the piece at its end. All longer and shorter counts follow from these: a
phrase occurs as often as windows begin with it, which is the flow out of its node plus the pieces
that end in it.

Windows are counted in two shuffles. Tasks add up equal windows, then the hash of the whole window
chooses the cell that adds up the tasks' counts; each cell sums its windows by their beginnings,
and the hash of the beginning chooses the cell for these. A key reaches a cell once per flush of a task,
however often it occurs, so a frequent phrase loads no task more than others do. Cells hold what at most
``CELL_BYTES`` of text give, so their number follows the input and their size does not.

Edges between which all flow stays together (the node has no other edge, start or end) form unary
paths, which are compacted to one row: a passage that occurs often is one path, whose inner phrases
are told from it as a whole.

Defined results: a NULL text counts as empty and gives nothing; a NULL language is ``und``; texts of
a repeated row count each time; an empty table gives no rows; other columns are ignored. A text and
the windows of ``HELD_BYTES`` of text (of a longer piece, all of it) are held in memory at a time.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import blocks, stored, table, texts_of

LONGEST = 4
LEAST = 30  # occurrences of a candidate
SHARE = 80  # percent of a phrase's occurrences that a longer one takes over
TOP = 2000
UNKNOWN = "und"
SCALE = 2_000_000

CELL_BYTES = 4 << 20
CELLS = 256  # at least
CELLS_A_TASK = 8
HELD_BYTES = 6 << 20  # of text whose windows are added up at a time
HELD = 600_000  # phrases of cells that are added up at a time
SALTS = 64

#: A byte that no text holds ends a piece.
END = b"\xff"
#: A-Z in lower case, a tab as a space, and every character that ends a piece as that byte.
PLAIN = bytes.maketrans(bytes(range(65, 91)) + b"\t" + b".,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + b" " + END * 10)

LARGE = pa.large_binary()
COUNTED = "cell int, lang string, phrases binary, counts binary"
Numbers = list[np.ndarray]  # of words, a column by place; -1 where a phrase is shorter


def _added(columns: Numbers, counts: np.ndarray) -> tuple[Numbers, np.ndarray]:
    """Different rows of numbers, and their summed counts."""
    names = [f"w{i}" for i in range(len(columns))]
    rows = pa.table([*columns, counts], [*names, "count"]).group_by(names, use_threads=False).aggregate([("count", "sum")])
    return [rows[name].to_numpy() for name in names], rows["count_sum"].to_numpy()


def _phrases(words: pa.Array, columns: Numbers) -> pa.Array:
    """The words of each row, joined."""
    parts = [words.take(pa.array(column, mask=column < 0)) for column in columns]
    return pc.binary_join_element_wise(*parts, pa.scalar(b" ", LARGE), null_handling="skip")


def _handed_on(lang: str, words: pa.Array, columns: Numbers, counts: np.ndarray, cells: int) -> pa.RecordBatch:
    """Counted phrases as one row per cell, packed; the words' hashes choose the cell."""
    import zstandard

    hashes = np.array([zlib.crc32(word) + 1 for word in words.to_pylist()] + [0], np.uint64)
    mixed = np.zeros(len(counts), np.uint64)
    for column in columns:
        mixed = (mixed + hashes[column]) * np.uint64(0x9E3779B97F4A7C15)
    cell = (mixed >> np.uint64(24)) % np.uint64(cells)
    order = np.argsort(cell, kind="stable")
    cell, counts = cell[order], counts[order]
    lines = pc.binary_join_element_wise(
        _phrases(words, [column[order] for column in columns]), pa.scalar(b"", LARGE), pa.scalar(b"\n", LARGE))
    ends = np.frombuffer(lines.buffers()[1], np.int64)[: len(lines) + 1]
    data, pack = memoryview(lines.buffers()[2] or b""), zstandard.ZstdCompressor(level=1).compress
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, int)
    spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(cell)]))
    return pa.RecordBatch.from_arrays([
        pa.array(cell[starts].astype(np.int32)),
        pa.array([lang] * len(starts), pa.string()),
        pa.array([pack(data[ends[i] : ends[j] - 1]) for i, j in spans], pa.binary()),
        pa.array([pack(counts[i:j].tobytes()) for i, j in spans], pa.binary()),
    ], ["cell", "lang", "phrases", "counts"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, tuple[bytes, np.ndarray]]]:
    """Lines of phrases and their counts by language, of some whole cells; rows come in their order."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    current, held, size = None, defaultdict(lambda: ([], [])), 0

    def joined():
        return {lang: (b"\n".join(lines), np.concatenate(counts)) for lang, (lines, counts) in held.items()}

    for batch in batches:
        for row in range(batch.num_rows):
            cell, lang, phrases, counts = (column[row].as_py() for column in batch.columns)
            if cell != current and size > HELD:
                yield joined()
                held.clear()
                size = 0
            current = cell
            held[lang][0].append(unpack(phrases))
            held[lang][1].append(np.frombuffer(unpack(counts), np.int64))
            size += len(held[lang][1][-1])
    if held:
        yield joined()


def _split(text: bytes, by: str) -> pa.Array:
    return pc.split_pattern(pa.array([text], LARGE), by).flatten()


def _coded(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Different words, and the number of each word among them."""
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def _windows_of(text: bytes, longest: int) -> tuple[pa.Array, Numbers]:
    """Words, and the numbers of up to ``longest`` of them from each word on, to the next end of a piece."""
    words = _split(text.replace(END, b" " + END + b" "), " ")
    words, numbers = _coded(words.filter(pc.greater(pc.binary_length(words), 0)))
    at = pc.index(words, pa.scalar(END, LARGE)).as_py()
    padded = np.append(numbers, np.full(longest, at, np.int32))
    left = np.ones(len(numbers), bool)
    columns = []
    for place in range(longest):
        column = padded[place : place + len(numbers)]
        left = left & (column != at)
        columns.append(np.where(left, column, np.int32(-1)))
    begins = columns[0] >= 0
    return words, [column[begins] for column in columns]


def _lines_of(lines: bytes, longest: int) -> tuple[pa.Array, Numbers]:
    """Words, and their numbers in lines of up to ``longest`` words."""
    parts = pc.split_pattern(_split(lines, "\n"), " ")
    words, numbers = _coded(parts.flatten())
    sizes, starts = pc.list_value_length(parts).to_numpy(), parts.offsets.to_numpy()[:-1]
    padded = np.append(numbers, np.full(longest, -1, np.int32))
    return words, [np.where(sizes > place, padded[starts + place], np.int32(-1)) for place in range(longest)]


def _windows(rows: DataFrame, cells: int, longest: int) -> DataFrame:
    """Windows of all pieces, added up within tasks."""

    def counted(held):
        for lang, texts in held.items():
            words, columns = _windows_of(END.join(texts) + END, longest)
            yield _handed_on(lang, words, *_added(columns, np.ones(len(columns[0]), np.int64)), cells)

    def run(batches):
        held, size = defaultdict(list), 0
        for block in blocks(batches, "text"):
            for lang, text in zip(block.column("lang").to_pylist(), texts_of(block.column("text"))):
                text, start = (text or b"").translate(PLAIN), 0
                while start < len(text):  # parts end where pieces do
                    end = text.find(END, start + HELD_BYTES)
                    end = len(text) if end < 0 else end
                    held[lang].append(text[start:end])
                    size, start = size + end - start, end + 1
                    if size > HELD_BYTES:
                        yield from counted(held)
                        held, size = defaultdict(list), 0
        yield from counted(held)

    return rows.mapInArrow(run, COUNTED)


def _flows(rows: DataFrame, cells: int, longest: int, least: int) -> DataFrame:
    """Per phrase shorter than an edge, the windows of a cell that begin with it; frequent edges too."""

    def run(batches):
        for cell in _cells(batches):
            for lang, (lines, counts) in cell.items():
                words, columns = _lines_of(lines, longest)
                columns, counts = _added(columns, counts)
                frequent = (columns[-1] >= 0) & (counts >= least)
                found = [([column[frequent] for column in columns], counts[frequent])]
                for size in range(longest - 1, 0, -1):
                    whole = columns[size - 1] >= 0
                    found.append(_added([column[whole] for column in columns[:size]], counts[whole]))
                none = [np.full(len(counts), -1, np.int32) for _, counts in found]
                merged = [np.concatenate([f[place] if place < len(f) else pad for (f, _), pad in zip(found, none)])
                          for place in range(longest)]
                yield _handed_on(lang, words, merged, np.concatenate([counts for _, counts in found]), cells)

    return rows.mapInArrow(run, COUNTED)


def _frequent(rows: DataFrame, least: int) -> DataFrame:
    """lang, size, phrase and f of frequent phrases; per cell also size 0, where f counts all words."""

    def run(batches):
        for cell in _cells(batches):
            for lang, (lines, counts) in cell.items():
                added = pa.table([_split(lines, "\n"), counts], ["phrase", "f"]).group_by("phrase", use_threads=False).aggregate([("f", "sum")])
                phrases, f = added["phrase"].combine_chunks(), added["f_sum"].to_numpy()
                size = pc.count_substring(phrases, b" ").to_numpy() + 1
                kept = np.flatnonzero(f >= least)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * (len(kept) + 1), pa.string()),
                    pa.array(np.append(size[kept], 0), pa.int32()),
                    pa.concat_arrays([phrases.take(pa.array(kept)).cast(pa.binary()), pa.array([b""], pa.binary())]),
                    pa.array(np.append(f[kept], f[size == 1].sum()), pa.int64())], ["lang", "size", "phrase", "f"])

    return rows.mapInArrow(run, "lang string, size int, phrase binary, f bigint").withColumn(
        "phrase", F.col("phrase").cast("string"))


def phrase_counts(
    documents: DataFrame, longest: int = LONGEST, least: int = LEAST, text_column="text", lang_column="lang",
) -> DataFrame:
    """How often each phrase of up to ``longest`` words occurs, of those with ``least`` or more.

    Columns lang, size (words), phrase (joined by one space) and f. Rows of size 0 hold, in parts
    to be added up, the number of all words of the language.
    """
    rows = documents.select(
        F.coalesce(F.col(lang_column).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_column).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    cells = max(CELLS, 1 + size // CELL_BYTES)
    tasks = cells // CELLS_A_TASK

    def gathered(counted):
        return counted.repartition(tasks, "cell").sortWithinPartitions("cell")

    windows = gathered(_windows(rows, cells, longest))
    return _frequent(gathered(_flows(windows, cells, longest, least)), least)


def _words(first: int | Column, count: int | Column, words: str = "words") -> Column:
    return F.array_join(F.slice(words, first, count), " ")


def unary_paths(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """The frequent edges, with those joined that follow each other in every occurrence.

    Columns lang, path, size and f: each run of ``longest`` words of the path is an edge that occurs
    f times. A node whose count equals that of one edge in and one edge out has no others, and no
    piece begins or ends there. Each edge then points to the one before it; pointers double until all
    reach the first of their path. A closed ring would need pieces without a beginning.
    """
    spark = counts.sparkSession
    words = F.split("phrase", " ")
    edges = counts.where(F.col("size") == longest).select(
        "lang", F.col("phrase").alias("edge"), "f", words.alias("words"))
    into = edges.select("lang", _words(2, longest - 1).alias("node"), "f", F.col("edge").alias("before"))
    out = edges.select("lang", _words(1, longest - 1).alias("node"), "f", "edge")
    nodes = counts.where(F.col("size") == longest - 1).select("lang", F.col("phrase").alias("node"), "f")
    links = nodes.join(into, ["lang", "node", "f"]).join(out, ["lang", "node", "f"]).select("lang", "edge", "before")
    links = stored(links, "links")
    # The first edges of paths are those that are followed but follow none.
    firsts = links.select("lang", F.col("before").alias("edge")).join(links, ["lang", "edge"], "left_anti")
    reach = stored(
        links.select("lang", "edge", F.col("before").alias("first"), F.lit(1).cast("bigint").alias("steps"))
        .unionByName(firsts.select("lang", "edge", F.col("edge").alias("first"), F.lit(0).cast("bigint").alias("steps"))),
        "reach")
    before = None
    while (total := reach.agg(F.sum("steps")).first()[0]) != before:
        before = total
        ahead = reach.select(
            "lang", F.col("edge").alias("first"), F.col("first").alias("further"), F.col("steps").alias("more"))
        reach = stored(
            reach.join(ahead, ["lang", "first"]).select(
                "lang", "edge", F.col("further").alias("first"), (F.col("steps") + F.col("more")).alias("steps")),
            "reach")
    placed = edges.join(reach, ["lang", "edge"], "left").select(
        "lang", F.coalesce("first", "edge").alias("first"), F.coalesce("steps", F.lit(0)).alias("steps"),
        F.element_at("words", -1).alias("last"), "f")
    following = F.transform(F.array_sort(F.collect_list(F.when(F.col("steps") > 0, F.struct("steps", "last")))),
                            lambda step: step["last"])
    paths = placed.groupBy("lang", "first").agg(F.max("f").alias("f"), following.alias("following"))
    words = F.concat(F.split("first", " "), F.col("following"))
    return paths.select("lang", F.array_join(words, " ").alias("path"), F.size(words).alias("size"), "f")


def _runs(size: int) -> Column:
    """All runs of ``size`` words of the array ``words``."""
    last = F.size("words") - size + 1
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.explode(F.array_distinct(F.transform(starts, lambda i: _words(i, F.lit(size)))))


def collocations(
    counts: DataFrame, paths: DataFrame, longest: int = LONGEST, share: int = SHARE, top: int = TOP,
) -> DataFrame:
    """The best ``top`` phrases of each language, from stored counts and paths.

    A phrase is as good as its worst cut: ``SCALE`` times its count over the sum of the counts of
    both parts, whole. Phrases most of whose occurrences lie in one longer phrase are left out.
    """
    wide = "decimal(38,0)"
    of_paths = paths.select("lang", "f", F.split("path", " ").alias("words"))
    shorter = counts.where(F.col("size").between(2, longest - 1)).select(
        "lang", "f", F.col("phrase"), F.split("phrase", " ").alias("words"))
    candidates = of_paths.select("lang", _runs(longest).alias("phrase"), "f").select(
        "lang", "f", "phrase", F.split("phrase", " ").alias("words")).unionByName(shorter)

    inside = [of_paths.select("lang", "f", _runs(size).alias("phrase")) for size in range(2, longest)]
    inside += [shorter.where(F.size("words") > size).select("lang", "f", _runs(size).alias("phrase"))
               for size in range(2, longest - 1)]
    contained = inside[0]
    for part in inside[1:]:
        contained = contained.unionByName(part)
    contained = contained.groupBy("lang", "phrase").agg(F.max("f").alias("within"))

    parts = counts.where(F.col("size").between(1, longest - 1)).select("lang", F.col("phrase").alias("part"), "f")
    cuts = candidates.select(
        "lang", "phrase", F.col("f").alias("a"), "words",
        F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"),
    ).select("lang", "phrase", "a", "k", _words(1, F.col("k")).alias("left"),
             _words(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr(f"(CAST(a AS {wide}) * {SCALE}) DIV (CAST(l AS {wide}) + CAST(r AS {wide}))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    kept = scored.join(contained, ["lang", "phrase"], "left").where(
        F.expr(f"within IS NULL OR CAST(within AS {wide}) * 100 < CAST(a AS {wide}) * {int(share)}"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score",
                       (F.xxhash64("phrase") % SALTS).alias("salt"))
    # No language is ordered in one task: the best of each part are ordered again.
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    best = best.where(F.col("rank") <= top).drop("salt", "rank")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    best = best.withColumn("rank", rank).where(F.col("rank") <= top)
    words = counts.where(F.col("size") == 0).groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mined(
    documents: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP,
    text_column="text", lang_column="lang",
) -> DataFrame:
    """Collocations of the documents, from their texts."""
    if longest < 3:
        raise ValueError("a graph needs edges of at least three words")
    counts = stored(phrase_counts(documents, longest, least, text_column, lang_column), "phrases")
    return collocations(counts, stored(unary_paths(counts, longest), "paths"), longest, share, top)


def op13_phrase_collocations(spark, folder: str) -> DataFrame:
    """The 2,000 best phrases of two to four words in each language of all documents."""
    return mined(table(spark, folder, "documents"))


OP13_SQL = r"""
with lines as (
    select coalesce(lang, 'und') as lang,
           unnest(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[.,;:!?\x0A-\x0D]')) as line
    from documents
), pieces as (
    select lang, list_filter(regexp_split_to_array(line, '[ \t]+'), lambda word: word <> '') as words from lines
), grams as (
    select lang, size, unnest([array_to_string(words[i : i + size - 1], ' ')
                               for i in range(1, len(words) - size + 2)]) as phrase
    from pieces, (values (1), (2), (3), (4)) sizes(size)
), counts as (
    select lang, size, phrase, count(*) as f from grams group by all
), totals as (
    select lang, sum(f)::bigint as n from counts where size = 1 group by lang
), candidates as (
    select lang, size, phrase, f as a, string_split(phrase, ' ') as words
    from counts where size > 1 and f >= 30
), cuts as (
    select lang, phrase, a, k, array_to_string(words[:k], ' ') as head, array_to_string(words[k + 1 :], ' ') as rest
    from candidates, (values (1), (2), (3)) cut(k) where k < size
), scored as (
    select cuts.lang, cuts.phrase, a, k, h.f as l, r.f as r,
           (a::hugeint * 2000000) // (h.f::hugeint + r.f::hugeint) as score
    from cuts
    join counts h on h.lang = cuts.lang and h.phrase = head
    join counts r on r.lang = cuts.lang and r.phrase = rest
), worst as (
    select * from scored
    qualify row_number() over (partition by lang, phrase order by score, k) = 1
), contained as (
    select distinct s.lang, s.phrase
    from (select lang, a, size, words, unnest([1, 2, 3]) as start from candidates) q,
         (values (2), (3)) inner_size(len), candidates s
    where len < q.size and start + len - 1 <= q.size
      and s.lang = q.lang and s.phrase = array_to_string(q.words[start : start + len - 1], ' ')
      and 100 * q.a >= 80 * s.a
), ranked as (
    select lang, phrase, a, l, r, score,
           row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank
    from worst anti join contained using (lang, phrase)
)
select lang, rank, phrase, a, l, r, n, score::bigint as score
from ranked join totals using (lang) where rank <= 2000
"""
