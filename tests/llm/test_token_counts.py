"""The compiled tokenizer against the library that its file belongs to."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wingtally.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda texts: [len(x.ids) for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD = [
    "", None, "a", "  a", "a  ", "a\n\n b", "it's  'sup ''s 'll'd", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "　x  y", "x'rex're' re", "'s's", "\t\n\r a", " 'll", "“it’s”",
    "日本語のテキスト" * 300, "a" * 5000, " " * 3000, "=-" * 3000 + "=", "😀😀 x", "é x́", "<|endoftext", "1234567 ①②", "x   \n  y", "'", "' s", "don't've", "'S", "'reabc", "''re", "  's", "ՠ֋ⱟ",
]


@pytest.mark.parametrize("batch", [64, 257, 1 << 22])
def test_odd_texts(library, batch):
    _, tokens = tc.count(tc.machine(PATH), pa.array(ODD, pa.string()), batch)
    assert tokens.tolist() == library(ODD)


def test_random_texts(library):
    draw = random.Random(3)
    parts = [*"abcdefghst'lrevmd  \n\t.,-=<|>1289éàßü日本語  ́😀", "<|endoftext|>", "'s", "'re", " the", "ing", "tion"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 80))) for _ in range(4000)]
    texts += ["".join(chr(draw.choice([draw.randint(32, 126), draw.randint(0, 0x2FFF), draw.randint(0xE000, 0x10FFFF)])) for _ in range(draw.randint(0, 30))) for _ in range(4000)]
    sizes, tokens = tc.count(tc.machine(PATH), pa.array(texts))
    assert sizes.tolist() == [len(t.encode()) for t in texts]
    assert tokens.tolist() == library(texts)


def test_a_merge_across_the_border_is_known(library):
    m, draw = tc.machine(PATH), random.Random(1)
    spelled = lambda t: bytes([t]) if t < 256 else spelled(m.parts[t][0]) + spelled(m.parts[t][1])

    def plain(word: bytes) -> list[int]:
        out = list(word)
        while pairs := [(m.merge[p], i) for i, p in enumerate(zip(out, out[1:])) if p in m.merge]:
            rank, i = min(pairs)
            out[i : i + 2] = [rank]
        return out

    for _ in range(3000):
        a, b = draw.randrange(50_000), draw.randrange(draw.choice([300, 2000, 50_000]))
        if plain(spelled(a)) == [a] and plain(spelled(b)) == [b]:
            assert m.follows(a, b) == (plain(spelled(a) + spelled(b)) == [a, b])


def test_chunks_of_any_length_and_forgotten_states(library, monkeypatch):
    m = tc.machine(PATH)
    text = ("aab" * 700 + "=" * 900 + "thethethe" * 200).encode()
    data, start = np.frombuffer(text, np.uint8), np.zeros(len(text), bool)
    start[0] = start[2100] = start[3000] = True
    for chunk, before in ((7, 2), (64, 1), (256, 24)):
        added, _ = tc.added_tokens(m, data, start, chunk=chunk, before=before)
        assert added.sum() == library([text.decode()])[0]
    monkeypatch.setattr(tc, "STATES", 10)
    _, tokens = tc.count(m, pa.array(ODD, pa.string()))
    assert tokens.tolist() == library(ODD)


def test_rows(spark, odd, library):
    rows = odd.collect()
    got = tc.token_counts(odd, PATH)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted(((str(r["doc_id"]), len((r["text"] or "").encode()), n, n > 512) for r, n in zip(rows, library([r["text"] for r in rows]))))
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want
    assert tc.token_counts(odd.where("false"), PATH).count() == 0


def test_query(spark, library):
    got = {r["doc_id"]: r["n_tokens"] for r in tc.op13_token_counts(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert got == dict(zip([d["doc_id"] for d in docs], library([d["text"] for d in docs])))
