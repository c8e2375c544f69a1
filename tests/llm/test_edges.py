"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quayside.llm import (
    chat_format, class_lm, common, decontamination, exact_dedup, jaccard_join, language_id, packing, sharding, substring_dedup,
    url_filters,
)
from quayside.llm.components import connected_components

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long, row_id long,"
    " id long, control long, text_sha256 string, matches string, lang_pred string, _all string, value string"
)
PROSE = " ".join(random.Random(5).choice("alpha beta gamma delta the of and quick brown fox river stone".split()) + str(i % 97)
                 for i in range(60))
LONG = " ".join(f"w{i * 7919 % 50021}" for i in range(30_000))
#: A NULL id, NULL and empty texts, white space alone, a long text, a tie, a repeated row.
ROWS = [
    (None, "One text without an id."), (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, PROSE), (6, PROSE + "\n"),
    (7, PROSE.upper()), (7, PROSE.upper()), (8, "12 34 !?"), (9, "Été 中文 short"),
]
TOKENS = public_tokenizers.path(packing.TOKENIZER)


@pytest.fixture(scope="module")
def odd(spark):
    lang = {4: "en", 5: "en", 6: "en", 7: "en", 9: "fr"}
    rows = [(i, t, lang.get(i), None if i == 2 else "s", None if t is None else len(t), 1.0, 2, 3, 4, 5, "a", "b", "c", "d", "e")
            for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    words = PROSE.split()
    return spark.createDataFrame(
        [(1, " ".join(words[10:30])), (1, "One text"), (2, None), (3, ""), (None, "short"), (4, "?!")],
        "item_id long, text string")


def ids(rows):
    return sorted((r.doc_id for r in rows), key=str)


ALL = sorted((i for i, _ in ROWS), key=str)


def test_passages(odd, nothing):
    rows = substring_dedup.repeated_passages(odd).collect()
    assert {r.doc_id for r in rows} == {5, 6, 7}
    assert {r.row_id for r in rows if r.doc_id == 7} and len({r.row_id for r in rows if r.doc_id == 7}) == 2
    assert {r.doc_id for r in rows if r.kept} == {5} and {r.keep_doc_id for r in rows} == {5}
    assert substring_dedup.repeated_passages(nothing).count() == 0


def test_jaccard(odd, nothing):
    rows = jaccard_join.jaccard_components(odd).collect()
    assert ids(rows) == ALL
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert found[1] == found[2][:1] + (1,) == (0, 1) and found[3] == (0, 3)
    assert found[5][1] == found[6][1] == found[7][1] == 5 and found[None] == (1, None)
    assert found[8] == (1, 8) and found[4][0] == 30_000 - 4
    kept = jaccard_join.without_near_copies(odd)
    assert kept.columns == odd.columns
    assert ids(kept.collect()) == sorted([None, 1, 2, 3, 4, 5, 8, 9], key=str)
    assert jaccard_join.jaccard_components(nothing).count() == 0
    assert jaccard_join.without_near_copies(nothing).count() == 0


def test_class_model(odd, nothing):
    rows = odd.select("doc_id", "text")
    model, vocabulary = class_lm.train(rows.select("text"))
    scored = {r.doc_id: r for r in class_lm.score(rows, model, vocabulary).collect()}
    assert scored[1].n_tokens == scored[2].n_tokens == scored[3].n_tokens == 1
    assert scored[1].score == scored[2].score and scored[4].n_tokens == 30_001 and scored[4].n_known == 30_001
    assert class_lm.score(nothing.select("doc_id", "text"), model, vocabulary).count() == 0
    model, vocabulary = class_lm.train(nothing.select("text"))
    assert all(r.n_known == 0 and np.isfinite(r.score) for r in class_lm.score(rows, model, vocabulary).collect())


def test_class_probabilities_add_up(odd):
    """Over all words and one unseen word, after any class."""
    model, vocabulary = class_lm.train(odd.select("text"), limit=30, clustered=10)
    share = np.zeros(class_lm.CLASSES + 2)
    for c in range(class_lm.CLASSES):
        share[c] = (10 ** model.emissions[:-1][model.classes[:-2] == c]).sum()
    counts = vocabulary.where(~F.col("word").isin(model.words) & (F.octet_length("word") > 0)).agg(F.sum("n")).first()[0]
    unseen = model.once + class_lm.ADDED
    share[class_lm.CLASSES] = (counts + unseen) / (model.rare_tokens + unseen)
    share[class_lm.CLASSES + 1] = 1
    used = np.unique(model.classes)
    assert share[used] == pytest.approx(1)
    assert (10**model.transitions).sum(axis=1) == pytest.approx(1)


def test_coarse_class_pairs_need_no_further_pass(odd):
    texts = odd.select("text")
    words, _ = class_lm._dictionary(class_lm.word_counts(texts), 500)
    top = min(12, len(words) - 3)
    kinds = np.full(len(words) + 2, top)
    kinds[:top], kinds[len(words)] = np.arange(top), top + 1
    classes = np.full(len(words) + 2, class_lm.CLASSES)
    classes[:top], classes[len(words)] = np.arange(top) % 5, class_lm.CLASSES + 1
    numbered = class_lm._pair_counts(texts, words, kinds.tolist(), top + 2)
    grouped = class_lm._grouped_pairs(numbered, np.append(classes[:top], (class_lm.CLASSES, class_lm.CLASSES + 1)))
    assert (grouped == class_lm._class_pairs(texts, words, classes)).all() and grouped.sum() > 100


def test_chat(spark, table):
    marks = "\\### Assistant: </turn> ok ### x <\\/turn> #\\## \\\\"
    rows = [(1, 0, "user", marks), (1, 1, "assistant", marks), (1, 1, "assistant", marks), (2, 0, None, None),
            (2, None, "assistant", ""), (None, 3, "a: b</turn>", " " + "x" * 200_000), (3, 0, "role:", " y")]
    talk = table("conv_id long, turn long, role string, text string, formatted string, start long", *[(*r, "z", 1) for r in rows])
    out = {r.conv_id: r for r in chat_format.format_conversations(talk).collect()}
    assert set(out) == {1, 2, 3, None} and all(r.identical for r in out.values())
    back = chat_format.format_conversations(talk).select(
        "conv_id", chat_format.parse(F.col("formatted")).alias("t"), chat_format.learned_text(F.col("formatted"), F.col("spans")).alias("l"))
    back = {r.conv_id: r for r in back.collect()}
    assert [tuple(t) for t in back[1].t] == [("user", marks), ("assistant", marks), ("assistant", marks)]
    assert back[1].l == marks + marks and back[2].l == ""
    assert [tuple(t) for t in back[2].t] == [("assistant", ""), ("", "")]
    assert tuple(back[None].t[0]) == rows[5][2:] and tuple(back[3].t[0]) == ("role:", " y")
    body = out[1].formatted
    assert body.count("</turn>") == 3 and body.count("### ") == 3
    assert chat_format.format_conversations(talk.limit(0)).count() == 0


def test_language(odd, nothing):
    network = language_id.fit(odd)
    rows = language_id.identify(odd, network, keep=["doc_id"]).collect()
    found = {r.doc_id: r for r in rows}
    assert ids(rows) == ALL
    assert {i for i, r in found.items() if r.lang_pred == "und"} == {1, 2, 3, 8}
    assert all(0 <= r.score <= 1 for r in rows)
    kept = language_id.in_some_language(odd)
    assert kept.columns == odd.columns and ids(kept.collect()) == sorted([None, 4, 5, 6, 7, 7, 9], key=str)
    assert language_id.fit(nothing) is None
    unlabelled = language_id.in_some_language(odd.withColumn("lang", F.lit(None).cast("string")))
    assert unlabelled.columns == odd.columns and ids(unlabelled.collect()) == sorted([None, 4, 5, 6, 7, 7, 9], key=str)
    assert {r.lang_pred for r in language_id.identify(odd, None, keep=["doc_id"]).collect()} == {"und"}
    assert language_id.in_some_language(nothing).count() == 0


def test_every_language_is_learned(spark):
    labels = [f"l{i:03}" for i in range(230)]
    documents = spark.createDataFrame([(i, f"{name} text", name) for i, name in enumerate(labels * 6)], "doc_id long, text string, lang string")
    languages, windows, numbers = language_id.sample(documents)
    assert languages == labels and set(numbers.tolist()) == set(range(230)) and len(windows) == len(numbers)


def test_gradients_of_the_network():
    rng = np.random.default_rng(3)
    network = language_id.untrained(["a", "b", "c"], 1)
    network = network._replace(
        forward=language_id.Cell(*[x.astype(np.float64) for x in network.forward]),
        backward=language_id.Cell(*[x.astype(np.float64) for x in network.backward]))
    windows, labels = rng.integers(0, 256, (4, 6)).astype(np.uint8), np.array([0, 1, 2, 0])
    _, grads = language_id.loss_and_grads(network, windows, labels)
    for value, grad in zip(language_id._arrays(network), language_id._arrays(grads)):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        before, step = value[at], 1e-3
        value[at] = before + step
        up, _ = language_id.loss_and_grads(network, windows, labels)
        value[at] = before - step
        down, _ = language_id.loss_and_grads(network, windows, labels)
        value[at] = before
        assert (up - down) / (2 * step) == pytest.approx(grad[at], rel=0.02, abs=1e-4)


def test_packing(odd, nothing):
    rows = packing.pack(odd, TOKENS).collect()
    assert ids({(r.doc_id, r.start): r for r in rows if r.start == 0 and r.doc_id != 7}.values()) == sorted(
        [i for i in ALL if i != 7], key=str)
    assert sum(r.start == 0 for r in rows) == len(ROWS)
    assert {r.doc_tokens for r in rows if r.doc_id in (1, 2)} == {1}
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert packing.pack(nothing, TOKENS).count() == 0


def test_workers_let_go_of_what_other_tasks_kept():
    batch = pa.RecordBatch.from_pydict({"text": ["a", None, "b" * 10]})
    one = packing.Encoder.of(TOKENS)
    assert packing.Encoder.of(TOKENS) is one
    assert sum(b.num_rows for b in common.blocks([batch], "text", keep=True)) == 3 and packing.Encoder.of(TOKENS) is one
    assert [b.num_rows for b in common.blocks([batch], "text", 5)] == [2, 1]
    assert packing.Encoder.of(TOKENS) is not one


def test_encoder_agrees_with_the_tokenizer():
    encoder, rng = packing.Encoder(TOKENS), random.Random(1)
    loaded = Tokenizer.from_file(TOKENS)
    assert loaded.encode("a <|endoftext|> b", add_special_tokens=False).ids.count(50256) == 1
    parts = [*" \n\t\r\x0b\x0c\x1c\x85\xa0 　ab's\xe91,!<|>中\U0001f642\x00", "<|endoftext|>", "  ", " a", "'re "]
    for _ in range(100):
        texts = ["".join(rng.choices(parts, k=rng.randrange(60))).encode() for _ in range(20)]
        for text, ids in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == loaded.encode(text.decode(), add_special_tokens=False).ids


def test_encoder_remembers_frequent_words_that_come_late(monkeypatch):
    encoder, asked = packing.Encoder(TOKENS, cached_words=8), []
    encode = encoder._encode_words
    monkeypatch.setattr(encoder, "_encode_words", lambda words: asked.extend(words) or encode(words))
    loaded = Tokenizer.from_file(TOKENS)
    for number in range(40):
        text = f"x rare{number} {'often' if number > 19 else 'early'}"
        ids = encoder.encode([text.encode()])[0]
        assert np.frombuffer(ids, "<u4").tolist() == loaded.encode(text, add_special_tokens=False).ids
    assert asked.count(b"often") == 1 and len(encoder.words) + len(encoder.before) <= 12


def test_exact(odd, nothing):
    rows = exact_dedup.exact_duplicates(odd).collect()
    assert ids(rows) == ALL
    assert sum(r.kept for r in rows if r.doc_id == 7) == 1
    found = {r.doc_id: r for r in rows}
    assert (found[2].keep_id, found[2].group_size, found[2].kept) == (1, 2, False)
    assert found[3].group_size == 1 and found[None].keep_id is None and found[None].kept
    assert found[3].text_sha256 == hashlib.sha256(b" ").hexdigest()
    assert found[5].group_size == 1 and found[6].group_size == 1  # one ends in white space
    kept = exact_dedup.without_copies(odd)
    assert kept.columns == odd.columns and ids(kept.collect()) == sorted([None, 1, 3, 4, 5, 6, 7, 8, 9], key=str)
    assert exact_dedup.exact_duplicates(nothing).count() == 0 and exact_dedup.without_copies(nothing).count() == 0


def test_shared_identifiers_are_noticed(spark, table, monkeypatch):
    rows = table("identifier binary, chunk binary", (b"a", b"1"), (b"a", b"1"), (b"a", b"2"), (b"b", b"1"))
    assert [bytes(r.identifier) for r in exact_dedup.shared_identifiers(rows).collect()] == [b"a"]
    texts = table("doc_id long, text string", *[(i, f"text {i % 200}") for i in range(400)])
    rows = exact_dedup.exact_duplicates(texts, digests=(1, 16)).collect()  # one byte cannot tell 200 chunks apart
    assert {r.doc_id: r.keep_id for r in rows} == {i: i % 200 for i in range(400)}
    with pytest.raises(ValueError):
        exact_dedup.exact_duplicates(texts, digests=(1,))


def test_chunks_follow_the_content():
    text = bytes(random.Random(2).choices(b"abcdefgh ", k=200_000))
    (_, whole), (_, shifted) = exact_dedup._chunked([text, b"more in front " * 9 + text])
    assert b"".join(whole) == exact_dedup.normalised(text)
    assert len(set(whole) & set(shifted)) > 0.8 * len(whole) and max(map(len, whole)) <= exact_dedup.MAX_CHUNK


def test_shards(odd, nothing):
    rows = sharding.kd_shards(odd, shards=3).collect()
    assert ids(rows) == ALL and {r.shard for r in rows} <= {0, 1, 2}
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert {r.size for r in rows if r.doc_id in (1, 2)} == {1}
    assert sharding.kd_shards(nothing, shards=16).count() == 0
    assert sharding.kd_shards(odd, target_bytes=10**9).select("shard").distinct().count() == 1


def test_one_source_is_split_evenly(spark):
    same = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 50).alias("text"),
                                    F.lit("en").alias("lang"), F.lit("src").alias("source"), F.lit(50).alias("n_chars"))
    sizes = [r["n"] for r in sharding.kd_shards(same, shards=16).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) <= 1.02 * min(sizes)


def test_decontamination(odd, nothing, benchmark):
    rows = decontamination.benchmark_matches(odd.select("doc_id", "text"), benchmark).collect()
    assert ids(rows) == ALL
    found = {r.doc_id: r for r in rows}
    assert found[1].n_words == found[2].n_words == found[3].n_words == 0
    hit = {i: {m.item_id for m in r.matches} for i, r in found.items()}
    assert hit[5] == hit[6] == hit[7] == {"1"} and hit[None] == {"1"} and hit[9] == {None}
    assert not any(hit[i] for i in (1, 2, 3, 4, 8))
    for r in decontamination.benchmark_hits(odd.select("doc_id", "text"), benchmark).collect():
        words = sorted({w for m in found[r.doc_id].matches for w in range(m.start, m.start + m.length)})
        assert [w for s in r.stretches for w in range(s.start, s.end)] == words and r.n_words == found[r.doc_id].n_words
        assert set(r["items"]) == hit[r.doc_id] and len(r["items"]) == len(hit[r.doc_id])
    match = found[5].matches[0]
    assert (match.start, match.item_start, match.length) == (10, 0, 20)
    kept = decontamination.decontaminated(odd, benchmark)
    assert kept.columns == odd.columns and ids(kept.collect()) == [1, 2, 3, 4, 8]
    assert decontamination.decontaminated(nothing, benchmark).count() == 0
    assert decontamination.decontaminated(odd, benchmark.limit(0)).count() == len(ROWS)


def test_shared_prompts_do_not_multiply(spark):
    """Every item and every document have the same ten words: 400 x 400 items named, one stretch a document."""
    prompt = " ".join(f"q{i}" for i in range(10))
    items = spark.createDataFrame([(i, f"{prompt} x{i}") for i in range(400)], "item_id long, text string")
    documents = spark.createDataFrame([(i, f"a {prompt} b") for i in range(400)], "doc_id long, text string")
    rows = decontamination.benchmark_hits(documents, items).collect()
    assert all([tuple(s) for s in r.stretches] == [(1, 11)] and len(r["items"]) == 400 for r in rows) and len(rows) == 400
    assert decontamination.decontaminated(documents, items).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_hits_of_random_texts(seed):
    """Stretches and items against every window, items of fewer words than a window among them."""
    rng = random.Random(seed)

    def text(longest):
        return [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(longest))]

    items = [(str(i) if i else None, b" ".join(text(9))) for i in range(12)]
    documents = [text(40) for _ in range(30)]
    index = decontamination.Benchmark(items, 4)
    for document, (stretches, names) in zip(documents, index.hits(documents)):
        hit, found = set(), set()
        for name, item in items:
            words = item.split()
            for i in range(max(1, len(words) - 3) if words else 0):
                window = words[i : i + 4]
                for at in range(len(document) - len(window) + 1):
                    if document[at : at + len(window)] == window:
                        hit |= set(range(at, at + len(window)))
                        found.add(name)
        assert {w for s, e in stretches for w in range(s, e)} == hit and set(names) == found and len(names) == len(found)


def test_large_benchmarks_go_block_by_block(odd, benchmark, monkeypatch):
    hits = sorted(map(str, decontamination.benchmark_hits(odd.select("doc_id", "text"), benchmark).collect()))
    whole = decontamination.benchmark_matches(odd.select("doc_id", "text"), benchmark, keep=["doc_id"]).collect()
    monkeypatch.setattr(decontamination, "BENCHMARK_BYTES", 60)
    blocks = decontamination.benchmark_matches(odd.select("doc_id", "text"), benchmark, keep=["doc_id"]).collect()
    assert hits == sorted(map(str, decontamination.benchmark_hits(odd.select("doc_id", "text"), benchmark).collect()))

    def plain(rows):
        return sorted(((str(r.doc_id), r.n_words, sorted(map(tuple, r.matches))) for r in rows), key=str)

    assert plain(whole) == plain(blocks)


def test_url_lists(spark, table):
    day = "timestamp_ntz'2024-03-0{} 12:00:00'"
    urls = ["https://User@A.Example.org:80/x/y?q", "http://b.example.org./x", "http://c.org/", None, "no url", "ftp://example.org"]
    captures = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)] + [(0, urls[0], "x", 1)],
                                     "page_id long, url string, pattern string, row_id long")
    captures = captures.withColumn("fetched_at", F.expr(day.format(5)).cast("timestamp")).unionByName(
        captures.limit(1).withColumn("fetched_at", F.lit(None).cast("timestamp")))
    changes = spark.sql("""
        SELECT pattern, action, to_date(day) AS day, listed FROM VALUES
        ('example.org', 'block', '2024-03-01', true), ('example.org', 'block', '2024-03-01', false),
        ('a.example.org/x', 'allow', '2024-02-01', true), ('b.example.org', 'block', '2024-02-01', true),
        ('b.example.org', 'block', '2024-03-05', false), ('b.example.org/x', 'allow', '2024-03-06', true),
        ('c.org', 'block', '2024-03-05', true), (NULL, 'block', '2024-03-01', true), ('c.org', 'allow', NULL, true)
        AS t(pattern, action, day, listed)""")
    rows = url_filters.evaluate(captures, changes).collect()
    assert len(rows) == len(urls) + 2
    got = {r.page_id: (r.decision, r.pattern) for r in rows if r.fetched_at is not None}
    assert got == {0: ("allow", "a.example.org/x"), 1: ("block", "example.org"), 2: ("block", "c.org"),
                   3: ("none", None), 4: ("none", None), 5: ("block", "example.org")}
    assert [r.decision for r in rows if r.fetched_at is None] == ["none"]
    assert url_filters.evaluate(captures.limit(0), changes).count() == 0
    assert {r.decision for r in url_filters.evaluate(captures, changes.limit(0)).collect()} == {"none"}


def test_long_urls_and_other_zones(spark):
    """A pattern per listed depth only; days are those of UTC."""
    long = "https://a.b.example.org/" + "/".join("x" * 1 for _ in range(6000))
    captures = spark.createDataFrame([(0, long), (1, "https://example.org/x/x/y")], "page_id long, url string").withColumn(
        "fetched_at", F.timestamp_seconds(F.lit(1709510400 - 60)))  # one minute before 2024-03-04 in UTC
    changes = spark.sql("""SELECT pattern, 'block' AS action, to_date(day) AS day, listed FROM VALUES
        ('example.org/x/x', '2024-03-03', true), ('example.org/x/x', '2024-03-04', false), ('b.example.org', '2024-03-04', true)
        AS t(pattern, day, listed)""")
    found = captures.select(F.size(url_filters.patterns(F.col("url"), 2, 3)).alias("n")).collect()
    assert [r.n for r in found] == [9, 6]
    for zone in ("UTC", "Asia/Tokyo", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            rows = url_filters.evaluate(captures, changes).collect()
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert {r.page_id: (r.decision, r.pattern) for r in rows} == dict.fromkeys((0, 1), ("block", "example.org/x/x"))


def test_components(table):
    links = table("a long, b long", (1, 2), (2, 3), (9, 8), (8, 9), (5, 5), (3, 1), *[(100 + i, 101 + i) for i in range(30)])
    found = {r.node: r.component for r in connected_components(links).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, **{100 + i: 100 for i in range(31)}}
    assert connected_components(links.limit(0)).count() == 0


def test_every_pair_above_the_threshold_shares_a_signature():
    """Random sets at the threshold and above, of all sizes: no pair is lost."""
    rng, bands = np.random.default_rng(0), jaccard_join.Bands()
    for size in (2, 3, 4, 5, 6, 8, 9, 13, 25, 40, 100, 200, 230, 260, 500, 1500):
        for _ in range(20):
            pool = rng.integers(1, 1 << 63, 3 * size).astype(np.uint64)
            common = pool[:size]
            extra = size // 4
            left = int(rng.integers(0, extra + 1))
            a = np.unique(np.concatenate((common, pool[size : size + left])))
            b = np.unique(np.concatenate((common, pool[size + left : size + extra])))
            assert jaccard_join.similar(a, b)
            signs, owners = jaccard_join.signatures([a, b], bands)
            assert np.intersect1d(signs[owners == 0], signs[owners == 1]).size


def test_repeated_values_are_counted():
    rng = np.random.default_rng(4)
    for size in (0, 1, 3, 50, 400):
        values = rng.integers(0, 60, size).astype(np.uint64)
        found, counts = np.unique(values, return_counts=True)
        often, times = jaccard_join.repeated(values.copy(), 4)
        assert often.tolist() == found[counts >= 4].tolist() and times.tolist() == counts[counts >= 4].tolist()
    known = np.array([-5, 0, 7], np.int64)
    assert jaccard_join._among(np.array([7, 8, -5, -9], np.int64), known).tolist() == [True, False, True, False]
    assert not jaccard_join._among(np.array([1], np.int64), known[:0]).any()


def test_stars_do_not_depend_on_batches():
    rng = np.random.default_rng(1)
    key, ids = np.sort(rng.integers(0, 40, 300)), rng.integers(0, 50, 300)
    order = np.lexsort((ids, key))
    key, ids, main = key[order] + 1, ids[order], np.zeros(300, np.int64)

    def stars(size):
        maker, out = jaccard_join._Stars(), set()
        for i in range(0, 300, size):
            made = maker.add(key[i : i + size], ids[i : i + size], main[i : i + size])
            out |= set(zip(*(x.tolist() for x in made))) if made else set()
        none = np.zeros(0, np.int64)
        made = maker.add(none, none, none, last=True)
        return out | (set(zip(*(x.tolist() for x in made))) if made else set())

    whole = stars(300)
    assert all(stars(size) == whole for size in (1, 2, 3, 7, 50))
    assert {(c, i) for _, c, i in whole} == {
        (ids[key == k].min(), i) for k in set(key.tolist()) for i in ids[key == k].tolist() if i != ids[key == k].min()}


def test_a_shard_of_documents_takes_little_memory():
    """12 MB of text, of which a shard's words and suffixes are held at a time."""
    rng = np.random.default_rng(3)
    vocabulary = np.array([f"word{i}" for i in range(2000)])
    texts = [" ".join(vocabulary[rng.integers(0, 2000, 2000)]) for _ in range(700)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    benchmark = decontamination.Benchmark([("a", texts[5].encode()[:4000])], decontamination.WINDOW)
    tracemalloc.start()
    try:
        hits = [bool(spans) for _, documents in decontamination._shards(iter([batch]), "text") for spans, _ in benchmark.hits(documents)]
        assert tracemalloc.get_traced_memory()[1] < 70 << 20
    finally:
        tracemalloc.stop()
    assert np.flatnonzero(hits).tolist() == [5]
