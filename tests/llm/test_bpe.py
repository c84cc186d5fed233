import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from facetrank.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    with open(bpe.default_vocabulary(), "rb") as f:
        return bpe.load_ranks(f.read())


@pytest.fixture(scope="module")
def coder(ranks):
    """Segments so small that nearly every text takes the streaming way."""
    return bpe.Transducer(ranks, segment=64, inner=32)


@pytest.fixture(scope="module")
def whole():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return lambda text: made.encode(text, add_special_tokens=False).ids


PARTS = ["a", "b", "the", " ", "  ", "\n", "\r\n", "'s", "'", "'re", "1", "9", "é", "中", "—", "=", "-", "​", "🎉", "\x85", "\xa0", "ing", "\t", "<|endoftext|>", "�"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=400).map("".join))
def test_streaming_gives_the_ids_of_the_whole(coder, whole, text):
    assert [i for part in coder.stream(text) for i in part] == whole(text)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300))
def test_any_text_and_back(coder, whole, text):
    ids = coder.encode(text)
    assert ids == whole(text) and bpe.decode(ids, coder.tokens, part=2) == text


@pytest.mark.parametrize("unit", ["a", "=", "ab", "-=", "1", " ", "\n", "é", "中", "abcdefgh", "e" * 7 + "r"])
def test_long_pieces(coder, whole, unit):
    rng = random.Random(unit)
    for text in (unit * 3000, "".join(rng.choice(unit) for _ in range(5000)), " " + unit * 700 + " x" + unit * 700):
        assert [i for part in coder.stream(text) for i in part] == whole(text)


def test_long_piece_of_random_letters(coder, whole):
    text = "".join(random.Random(5).choice("abcdeilnorst") for _ in range(60_000))
    assert [i for part in coder.stream(text) for i in part] == whole(text)


SCRIPTS = [
    *(chr(i) for i in range(33)), "\x7f", "\x85", "\xa0", "\u2028", "\u3000", "'", "'", "'", "s", "t", "re", "ve", "m", "ll", "d", "'s", "'ll", "'LL", "’s",
    "a", "B", "word", "é", "e\u0301", "\u0301", "я", "слово", "中文", "の", "ก็", "ا", "हि", "ß", "ǅ", "ª", "1", "٣", "Ⅷ", "½", "_", "-", "=", "€", "🎉", "👩\u200d🔬", "\ufe0f", "\ufffd", "\U0001fae8", "\U0002ebf0", "\U0010ffff",
]


@pytest.mark.parametrize("segment", [4, 5, 7, 16, 64])
def test_segments_of_any_size_give_the_ids_of_the_whole(ranks, coder, segment):
    rng = random.Random(segment)
    small = bpe.Transducer(ranks, segment=segment, inner=8)
    for _ in range(20_000):
        some = rng.sample(SCRIPTS, rng.randrange(1, 9))
        text = "".join(rng.choice(some) * rng.choice((1, 1, 1, 2, 5)) for _ in range(rng.randrange(1, 30)))
        assert small.encode(text) == coder.coder.encode_ordinary(text), (segment, text)


def test_classes_are_those_of_the_pattern(coder):
    assert [coder.classes[c] for c in " \x1c\x85aя中1½'_\u0301🎉"] == list("sosLLLNNoooo")


def test_memory_is_a_segment_however_long_the_text(coder):
    import tracemalloc

    text = "x" * 3_000_000 + " some words of it's own, " * 2_000_000
    tracemalloc.start()
    n = sum(len(part) for part in coder.stream(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) > 50_000_000 and n > 10_000_000 and peak < 2_000_000


def test_one_coder_a_vocabulary():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        multi = f.read()
    with open(bpe.default_vocabulary(), "rb") as f:
        assert bpe._transducer(f.read()) is not bpe._transducer(multi)


def test_machine_waits_for_whole_characters():
    machine = bpe.Utf8Machine()
    data = "aé中🎉".encode()
    assert "".join([machine.feed(bytes([b])) for b in data] + [machine.feed(b"", True)]) == "aé中🎉"
    assert machine.feed(b"\xe4\xb8") == "" and machine.feed(b"", True) == "�"


def test_documents(spark, whole):
    texts = ["plain text", "", None, "x" * 300_000, "plain text", " \n\n ", "snake_case 12,5"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "null key"), (0, "plain text")], "doc_id long, text string").withColumns({"ids": F.lit(1), "n_tokens": F.lit(2)})
    got = bpe.encode_texts(docs).collect()
    assert len(got) == 9 and dict(bpe.encode_texts(docs).dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    by = {r["doc_id"]: r["ids"] for r in got}
    assert all(by[i] == (whole(t) if t else []) for i, t in enumerate(texts)) and by[None] == whole("null key")
    counts = {r["doc_id"]: r["n_tokens"] for r in bpe.encode_texts(docs, count_only=True).collect()}
    assert counts == {i: len(x) for i, x in by.items()}
    back = {r["doc_id"]: r["text"] for r in bpe.decode_ids(bpe.encode_texts(docs)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_texts(none).count() == 0 and bpe.decode_ids(bpe.encode_texts(none)).count() == 0
