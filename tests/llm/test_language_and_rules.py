import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest

from wingtally.llm import language, quality_rules, shared

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = defaultdict(list)
    for i in range(len(words) - 7):
        grams[tuple(words[i : i + 8])].append(i)
    hit = {i + j for at in grams.values() if len(at) > 1 for i in at for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def texts(n, seed=3):
    rng = random.Random(seed)
    out = [None, "", "\n", "a\n\na\n a\nA", "é|ß\x0bü <x>\r\nq", "x"]
    for _ in range(n):
        out.append("".join(rng.choice(["a", "b", "é ", " ", "\n", "c d e f g h i j ", "#", "a b\n"]) for _ in range(rng.randint(0, 60))))
    return out


@pytest.mark.parametrize("chunk", [7, 1 << 19])
def test_counts_match_brute_force(chunk):
    rows = texts(300)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.string())], names=["doc_id", "text"]).slice(1)
    got = []
    for part in shared.pieces(batch, chunk):
        c, (off, number, _, words) = quality_rules.measure(part.column(1))
        got += list(zip(*(c[k].tolist() for k in quality_rules._COUNTS), strict=True))
        for i, t in enumerate(part.column(1).to_pylist()):
            want = [(k, len(WORD.findall(x))) for k, x in enumerate((t or "").split("\n")) if WORD.search(x)]
            assert list(zip(number[off[i] : off[i + 1]].tolist(), words[off[i] : off[i + 1]].tolist(), strict=True)) == want, t
    assert got == [counts(t) for t in rows[1:]]


def test_shared_lines_go(spark):
    rows = [(i, f"Cookie  notice here\nsome own words of text number {i} {'w ' * 20}", "h") for i in range(40)] + [(99, "cookie notice HERE\nx", "h"), (100, "cookie notice here\nx " + "y" * 9, None)]
    out = {r.doc_id: r for r in quality_rules.line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), least=5, with_text=True).collect()}
    assert out[3].removed_lines == [0] and out[3].removed_words == 3 and "Cookie" not in out[3].text and out[3].kept is not None
    assert not out[99].kept and out[99].removed_words == 3 and out[99].text == "x"
    assert out[100].removed_words == 0


def test_copies_count_as_documents(spark):
    page = "the same page stands here once again\n" + "w x y z " * 6
    rows = [(i, page, "h") for i in range(30)] + [(100 + i, f"own words of text {i} " + "v " * 20, "h") for i in range(30)]
    rows += [(200, f"one document\n{i} " + "u " * 20, "h") for i in range(30)] + [(None, "no name at all\n" + "t " * 20, "h")] * 30
    out = quality_rules.line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == len(rows)
    for r in out:
        copy = r.doc_id is not None and r.doc_id < 30
        assert r.removed_lines == ([0, 1] if copy else []) and r.removed_words == (r.n_words if copy else 0)
        assert not (copy and r.kept)


def test_rules_on_odd_rows(spark, odd):
    got = quality_rules.line_rules(odd).collect()
    assert len(got) == odd.count()
    want = sorted(((r.doc_id or -1, *counts(r.text)) for r in odd.collect()))
    assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert quality_rules.line_rules(odd.limit(0)).count() == 0


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(language.sample(docs, ~language.held_out(), 100), pieces=4000)
    out = language.identify(docs.where(language.held_out()), model).selectExpr("avg(int(lang = lang_pred)) a", "avg(int(rejected)) r").first()
    assert out.a > 0.98 and out.r < 0.02
    got = language.identify(odd, model).collect()
    assert len(got) == odd.count()
    for r in got:
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and (r.lang_pred != "und" or r.rejected)
    assert {r.lang_pred for r in got if r.doc_id in (6, 7)} == {"de"}
    assert language.identify(odd.limit(0), model).count() == 0
    none = language.train([])
    assert {r.lang_pred for r in language.identify(odd, none).collect()} == {"und"}
    clash = language.identify(odd.withColumnRenamed("score_", "score"), model)  # the result's columns take the place of those of their names
    assert clash.columns == [*odd.columns[:-1], "lang_pred", "score", "rejected"] and {round(r.score, 6) for r in clash.collect()} == {round(r.score, 6) for r in got}
