"""Registered queries against SQL, brute force, round trips or held-out labels."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quayside.llm import decontamination, jaccard_join
from quayside.llm.catalogue import QUERIES, SQL
from quayside.llm.packing import TOKENIZER

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "conversations"):
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def texts(duck):
    return {i: (text or "").encode() for i, text in duck.execute("select doc_id, text from documents").fetchall()}


def rows_by_id(spark, name):
    rows = QUERIES[name](spark, FOLDER).collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r for r in rows}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, FOLDER)
    expected = duck.execute(SQL[name])
    columns = [column[0] for column in expected.description]
    assert sorted(columns) == sorted(result.columns)
    got = [tuple(row) for row in result.select(*columns).collect()]
    assert sorted(got, key=str) == sorted(expected.fetchall(), key=str)


def shingles(text):
    words = jaccard_join.words_of(text)
    return frozenset(zip(*[words[i:] for i in range(5)])) if len(words) > 4 else frozenset([tuple(words)] if words else [])


def components(sets):
    """Smallest id of each component, all pairs compared that share a shingle."""
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_shingle = defaultdict(list)
    for i in sorted(sets):
        for j in {j for s in sets[i] for j in by_shingle[s]}:
            common = len(sets[i] & sets[j])
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            by_shingle[s].append(i)
    return {i: root(i) for i in sets}


def test_jaccard_join_against_all_pairs(spark, texts):
    sets = {i: shingles(text) for i, text in texts.items()}
    expected = components(sets)
    found = rows_by_id(spark, "op2_jaccard_join")
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == {
        i: (len(sets[i]), expected[i]) for i in sets}


def test_class_model_base_score_and_gain(spark, texts):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    tokens = {i: [*text.lower().split(), b""] for i, text in texts.items()}
    counts = Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    total, distinct = sum(counts.values()), len(counts)
    found = rows_by_id(spark, "op3_class_lm")
    assert found.keys() == texts.keys()
    for i, r in found.items():
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens[i])
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(tokens[i]), total)
        assert r.n_known == sum(counts[t] > 0 for t in tokens[i])
    for part in (True, False):
        rows = [r for r in found.values() if r.held_out is part]
        assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_language_of_held_out_documents(spark, duck):
    labels = dict(duck.execute("select doc_id, lang from documents").fetchall())
    found = rows_by_id(spark, "op5_language_id")
    assert found.keys() == labels.keys()
    held = [r for r in found.values() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found.values())
    assert sum(r.lang_pred == labels[r.doc_id] for r in held) >= 0.95 * len(held)


def test_packing_round_trip(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op6_packing"](spark, FOLDER).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == texts.keys()
    for i, parts in pieces.items():
        ids = np.array([*tokenizer.encode(texts[i].decode(), add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    used = padded = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        used += at
        padded += at if at & (at - 1) == 0 else 1024
    assert used > 0.97 * padded


def test_shards_of_near_equal_bytes(spark, texts):
    found = rows_by_id(spark, "op8_sharding")
    sizes, slots = Counter(), defaultdict(list)
    for i, r in found.items():
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[i]) + 1, zlib.crc32(texts[i]), "bytes", None)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert found.keys() == texts.keys() and set(sizes) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= max(map(len, texts.values())) + 1


def windows_hit(words, windows):
    hit, items = set(), set()
    for size in {len(w) for w in windows}:
        for at in range(len(words) - size + 1):
            if found := windows.get(tuple(words[at : at + size])):
                hit.update(range(at, at + size))
                items |= found
    return hit, items


def benchmark_windows(duck):
    windows = defaultdict(set)
    for item, text in duck.execute("select item_id, text from benchmark").fetchall():
        words = decontamination.words(text.encode())
        for at in range(max(1, len(words) - 9) if words else 0):
            windows[tuple(words[at : at + 10])].add(str(item))
    return windows


def test_decontamination_against_every_window(spark, duck, texts):
    windows = benchmark_windows(duck)
    for i, r in rows_by_id(spark, "op9_decontamination").items():
        words = decontamination.words(texts[i])
        hit, items = windows_hit(words, windows)
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (
            len(words), len(hit), len(items), digest, bool(hit))


def test_passages_of_51_words_are_found(spark, texts):
    words = {i: jaccard_join.words_of(text) for i, text in texts.items()}

    def sharing(size):
        seen = defaultdict(set)
        for i, w in words.items():
            for at in range(len(w) - size + 1):
                seen[tuple(w[at : at + size])].add(i)
        return {i for found in seen.values() if len(found) > 1 for i in found}

    rows = QUERIES["op1_substring_dedup"](spark, FOLDER).collect()
    found = {r.doc_id for r in rows}
    assert sharing(51) <= found <= sharing(20)
    first = {r.passage_id: r.keep_doc_id for r in rows}
    assert any(r.kept for r in rows) and any(not r.kept for r in rows) and set(first.values()) <= found


def test_pipeline_against_brute_force(spark, duck, texts):
    """Languages reject nothing here; copies, near copies and contaminated documents go in turn."""
    first = {}
    for i in sorted(texts):
        first.setdefault(b" ".join(texts[i].split()), i)
    kept = set(first.values())
    expected = components({i: shingles(texts[i]) for i in kept})
    kept = {i for i in kept if expected[i] == i}
    windows = benchmark_windows(duck)
    kept = {i for i in kept if not windows_hit(decontamination.words(texts[i]), windows)[0]}
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == kept
    tokenizer = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for i, parts in by_doc.items():
        ids = [x for r in sorted(parts, key=lambda r: r.start) for x in r.ids]
        assert ids[-1] == 0 and tokenizer.decode(ids[:-1], skip_special_tokens=False) == texts[i].decode()
