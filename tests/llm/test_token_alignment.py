import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerlens.llm.token_alignment import align_tokens, byte_of_character

A_FILE = public_tokenizers.path("byte_bpe_50k.json")
B_FILE = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY, MODEL = open(A_FILE, "rb").read(), open(B_FILE, "rb").read()
TEXTS = [None, "", " ", "Hello world, aligned tokens!", "a <|endoftext|> b <s> </s> <unk>",
         "naïve ciónes 你好 😀 straße", "▁ lower block", "\n\n\ttabs  and   blanks \n",
         "Hello world, aligned tokens!", "\x00\x01 control", "aaaaaaaaaaaaaaaaaaaaaaa", "a",
         "word " * 3000, "internationalisation of unusual xqzvw words", "￭ ﬁ ligature ½"]


def plain(texts):
    """Every token against every token, one document after the other."""
    left = Tokenizer.from_file(A_FILE)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    back = byte_of_character()

    def piece(i):
        name = right.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if right.is_byte(i) else name.replace("▁", " ").encode()

    def spans(tokens):
        out, at = [], 0
        for i, raw in tokens:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out

    docs, count = [], Counter()
    for t in texts:
        raw = (" " + (t or "")).encode()
        a = [(i, bytes(back[c] for c in left.id_to_token(i)))
             for i in left.encode(" " + (t or ""), add_special_tokens=False).ids]
        b = [(i, piece(i)) for i in right.encode(t or "")]
        if not t or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            docs.append(None)
            continue
        a, b = spans(a), spans(b)
        common = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, start = [], 0
        for stop in common:
            groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= stop)
                                   for side in (a, b)))
            start = stop
        links = [(i, j) for i, s, e in a for j, s2, e2 in b if s < e2 and s2 < e]
        count.update(links)
        docs.append((len(a), len(b), groups, links))
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return [(0, 0, 0, 0, "", 0, 0) if d is None else (
        d[0], d[1], len(d[2]), len(d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest(),
        sum(count[x] == best[x[1]] for x in d[3]), sum(count[x] for x in d[3])) for d in docs]


@pytest.mark.parametrize("hot", [0, 40, 1 << 19])
def test_equals_every_token_against_every_token(spark, hot):
    rng = random.Random(hot)
    letters = "abcdeéßñ 你 .,-"
    texts = TEXTS[:12] + ["word " * 60] + TEXTS[13:] + [
        "".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)],
                               "doc_id long, text string, N_A string, row string, key int")
    got = align_tokens(df, VOCABULARY, MODEL, hot=hot)
    assert got.columns == ["doc_id", "row", "key", "n_a", "n_b", "n_groups", "n_links",
                           "groups_sha256", "n_best", "count_sum"]
    rows = sorted(got.collect(), key=lambda r: r["doc_id"])
    assert [tuple(r)[3:] for r in rows] == plain(texts)


def test_long_text_and_empty_table(spark):
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(100_000))
    df = spark.createDataFrame([(1, long), (2, long[:1000]), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in align_tokens(df, VOCABULARY, MODEL).collect()}
    assert rows[1]["n_links"] >= max(rows[1]["n_a"], rows[1]["n_b"]) > 100_000
    assert rows[1]["n_groups"] <= min(rows[1]["n_a"], rows[1]["n_b"])
    assert align_tokens(df.limit(0), VOCABULARY, MODEL).collect() == []
