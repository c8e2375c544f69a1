"""Token counts against the library of the tokenizer."""

import random

import public_tokenizers
import pytest
import sentencepiece

from quayside.llm import token_counts
from quayside.llm.catalogue import QUERIES

PATH = public_tokenizers.path(token_counts.MODEL)
PARTS = ["a", "b", "the", "tion", "ing", " ", "  ", "\n", "\t", "1", "23", "é", "ß", "世", "🙂", "\x00", "▁", "▁▁", "<s>",
         "</s>", "<unk>", "<0x0A>", "..", "==", "////", "не", " ", "﻿"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def transducer():
    return token_counts.Transducer(token_counts.read_pieces(PATH))


def test_odd_strings(library, transducer):
    rng = random.Random(0)
    names = list(transducer.ranks)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(14))) for _ in range(5000)]
    texts += ["".join(rng.choices(names, k=rng.randrange(1, 6))).replace("▁", rng.choice([" ", "▁", ""])) for _ in range(5000)]
    assert [transducer.count(t) for t in texts] == [len(ids) for ids in library.encode(texts, num_threads=1)]


def test_few_transitions_are_enough(library, transducer, monkeypatch):
    monkeypatch.setattr(token_counts, "TRANSITIONS", 50)
    small = token_counts.Transducer(token_counts.read_pieces(PATH))
    rng = random.Random(1)
    texts = ["".join(rng.choices(PARTS, k=40)) for _ in range(200)]
    assert [small.count(t) for t in texts] == [len(ids) for ids in library.encode(texts, num_threads=1)]
    assert small.made < 150


@pytest.mark.parametrize("text", ["a" * 3000, " " * 777, "ab" * 500, "=-" * 500, "世" * 99, "1" * 100, "aaaa b" * 50, "the " * 40])
@pytest.mark.parametrize("chunk", [1, 2, 3, 17, 64])
def test_maps_compose(library, transducer, text, chunk):
    """Left to right and in pairs, also where nothing in a chunk ends what came before."""
    text = transducer.written(text)
    margin = 2 * transducer.longest
    maps = [transducer.chunk_map(text[max(0, i - margin) : i], text[i : i + chunk], text[i + chunk : i + chunk + 1])
            for i in range(0, len(text), chunk)]
    maps = [token_counts.unpacked(token_counts.packed(m)) for m in maps]
    whole = maps[0]
    for following in maps[1:]:
        whole = token_counts.composed(whole, following)
    while len(maps) > 1:
        maps = [token_counts.composed(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    expected = len(library.encode(text.removeprefix("▁").replace("▁", " ")))
    for made in (whole, maps[0]):
        assert [count for (node, _), count in made[0, token_counts.NONE].items() if node == 0] == [expected]


def test_maps_of_other_workers(library):
    """Chunks mapped by transducers that have read other texts before."""
    pieces, rng = token_counts.read_pieces(PATH), random.Random(7)
    names = list(pieces.ranks)
    made = [token_counts.Transducer(pieces) for _ in range(3)]
    for transducer in made:
        for _ in range(300):
            transducer.count("".join(rng.choices(names, k=20)))
    for _ in range(150):
        text = "".join(rng.choices(names, k=60)).replace("▁", "")
        written, whole = pieces.written(text), None
        for start in range(0, len(written), 13):
            chunk = rng.choice(made).chunk_map(
                written[max(0, start - 2 * pieces.longest) : start], written[start : start + 13], written[start + 13 : start + 14])
            chunk = token_counts.unpacked(token_counts.packed(chunk))
            whole = chunk if whole is None else token_counts.composed(whole, chunk)
        assert [n for (node, _), n in whole[0, token_counts.NONE].items() if node == 0] == [len(library.encode(text))]


def test_query(spark, library):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op12_token_counts"](spark, folder).collect()
    assert len(rows) == len(texts)
    counts = dict(zip(texts, map(len, library.encode(list(texts.values()), num_threads=4))))
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {
        i: (len(text.encode()), counts[i], counts[i] > 4096) for i, text in texts.items()}


def test_cases(spark, library):
    """Nulls, empty and long texts, repeated rows, clashing columns; chunks in several rounds."""
    rng = random.Random(4)
    long = "".join(rng.choices(PARTS, k=9000))
    rows = [(None, "no id", 1), (1, None, 1), (2, "", 1), (3, " \n\t ", 1), (4, long, 1), (4, long, 1), (5, "x" * 20_000, 1),
            (6, long[:5000], 1), (7, " " * 40, 1)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    expected = sorted(((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, _ in rows), key=str)
    for chunk in (50, 1000, token_counts.CHUNK):
        found = token_counts.token_counts(documents, PATH, chunk=chunk)
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in found.collect()), key=str) == expected
    assert token_counts.token_counts(documents.limit(0), PATH).count() == 0
    assert token_counts.token_counts(documents, PATH, limit=2).where("over_limit").count() == 6


def test_other_models_are_refused(tmp_path):
    with open(PATH, "rb") as file:
        data = file.read()
    changed = tmp_path / "model"
    at = data.rindex(b"\x0a\x08identity\x12\x00\x18\x01\x20\x00")
    changed.write_bytes(data[: at + 15] + b"\x01" + data[at + 16 :])  # white space would be dropped
    with pytest.raises(ValueError):
        token_counts.read_pieces(str(changed))
