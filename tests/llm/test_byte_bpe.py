import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from ledgerlens.llm.byte_bpe import (
    Assembler, Merges, encode_documents, merge, pairs, read_ranks)

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def test_long_pieces_like_the_library(ranks, library):
    rng = random.Random(3)
    for text in ("unbelievable", "ñciónmentequeado", "é", "a" * 700, "ab" * 400, "=" * 1000, "é" * 300,
                 "".join(rng.choice("etaoinshr") for _ in range(3000))):
        assert merge(text.encode(), ranks) == library.encode_ordinary(text)


@pytest.mark.parametrize("dictionary", [0, 10_000])
def test_like_the_library_and_back(spark, ranks, library, dictionary):
    rng = random.Random(5)
    texts = [None, "", " ", "Hello world's  end\n\n", "naïve ciónmente здравствуй 你好 😀👍🏽",
             "a b c 　x\x85y\x1cz", "tab\t\tand  12345 it'll 'S <|endoftext|>",
             "x" * 1500 + " tail", "same same", "same same", "\x00\x01 ok"]
    letters = "abcdefghij éñ.,\n'0189"
    texts += ["".join(rng.choice(letters) for _ in range(n)) for n in (40, 300, 5000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)],
                               "doc_id long, text string, IDS int")
    got = encode_documents(df, ranks, public_tokenizers.PATTERN, dictionary=dictionary)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = library.encode_ordinary(t or "")
        said = ",".join(map(str, want))
        r = rows[i]
        assert r["ids"] == want, t
        assert r["n_tokens"] == len(want) and bytes(r["decoded"]) == (t or "").encode()
        assert r["ids_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_empty_table(spark, ranks):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encode_documents(df, ranks, public_tokenizers.PATTERN).count() == 0


def test_word_by_word_like_the_library(ranks, library):
    work = Assembler(public_tokenizers.PATTERN, {"a": (64).to_bytes(4, "little")},
                     Merges(ranks, pairs(ranks)))
    assert ranks[b"a"] == 64
    work.room, rng = 3000, random.Random(9)      # words are forgotten on the way
    letters = ["a", "é", " ", "  ", "\n", "\t", "\u3000", "\x1c", "'s", "!", "7", "\u200b", "\x85", "你",
               "tion", "zq", "x" * 70]
    texts = ["".join(rng.choice(letters) for _ in range(n % 40)) for n in range(900)]
    for at in range(0, 900, 90):
        for text, found in zip(texts[at:], work.texts(texts[at:at + 90])[0]):
            ids = [int.from_bytes(found[i:i + 4], "little") for i in range(0, len(found), 4)]
            assert ids == library.encode_ordinary(text), repr(text)


def test_merges_of_many_pieces(ranks, library):
    rng = random.Random(4)
    pieces = list({"".join(rng.choice("abcdeéñ你inotsr") for _ in range(rng.randrange(1, 90)))
                   for _ in range(6000)})
    found = Merges(ranks, pairs(ranks)).many([p.encode() for p in pieces])
    for piece, packed in zip(pieces, found):
        ids = [int.from_bytes(packed[i:i + 4], "little") for i in range(0, len(packed), 4)]
        assert ids == merge(piece.encode(), ranks) == library.encode_ordinary(piece)


def test_rare_pieces_go_and_the_dictionary_stays(ranks, library, monkeypatch):
    monkeypatch.setattr("ledgerlens.llm.byte_bpe.REMEMBERED", 1)
    known = {" the": (ranks[b" the"]).to_bytes(4, "little")}
    work = Assembler(public_tokenizers.PATTERN, known, Merges(ranks, pairs(ranks)))
    for text in ("zqxv the wörd the", "zqxv kwyjibo the the", ""):
        (ids,), (digest,) = work.texts([text])
        want = library.encode_ordinary(text)
        assert list(memoryview(ids).cast("i")) == want
        assert digest == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        # one table of ids, without a second copy of the dictionary
        assert list(work.ids) == [" the"] and work.ids is known
