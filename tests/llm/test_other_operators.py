import base64
import json
import random
import re

import pytest

from wingtally.llm import decontamination, licenses, mixing, quality, secrets


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")) + body


KEY = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01") + der(5, b"")) + der(4, bytes(range(200))))


def b64url(x):
    return base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()


def test_secret_structures():
    pem = "-----BEGIN PRIVATE KEY-----\n" + base64.encodebytes(KEY).decode() + "-----END PRIVATE KEY-----"
    token = b64url({"alg": "HS256"}) + "." + b64url({"sub": "x"}) + ".c2ln"
    text = f"é {pem} ü {token} Ü {KEY.hex()} ß {base64.b64encode(KEY).decode()} end"
    found = {(k, text[a:b]) for a, b, k in secrets.in_points(text.encode(), secrets.spans(text.encode()))}
    assert {("pem", pem), ("jwt", token), ("der", KEY.hex()), ("der", base64.b64encode(KEY).decode())} <= found
    broken = KEY[:-1]
    assert not secrets.is_private_key(broken) and not secrets.is_private_key(KEY + b"x") and not secrets.is_private_key(b"")
    assert secrets.spans(f"{base64.b64encode(broken).decode()} eyJhbGciOiI.eyJ4.x".encode()) == []


def test_wrapped_and_encrypted_keys():
    body = base64.encodebytes(KEY).decode()
    pem = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n" + body + "-----END RSA PRIVATE KEY-----"
    mixed = KEY.hex()[:-60] + KEY.hex()[-60:].upper()
    find = lambda t: {(k, t[a:b]) for a, b, k in secrets.spans(t.encode()) if k in ("pem", "der")}
    assert find(f"a {pem} b") == {("pem", pem)} and find(f"a {mixed} b") == {("der", mixed)}
    assert find(f"key: {body}next line") == {("der", body.rstrip("\n"))}
    wrapped = body.replace("\n", "\r\n").rstrip("\r\n")
    assert find(f"key: {wrapped}\r\nwords") == {("der", wrapped)}
    assert find("key: " + body.replace("\n", "\n\n")) == set() and find("-----BEGIN RSA PRIVATE KEY-----\na: b\n\n-----END RSA PRIVATE KEY-----") == set()


def test_base_spans_match_plain_patterns():
    rng = random.Random(5)
    bits = ["password", "PassWD", "secret", "ToKen", "api_key", "apikey", '"', "'", " ", "=", ":", "abcdef012345", "AKIA", "ABCDEFGH12345678", "ſecret", "é", "\n", "0123456789abcdef", "x", "/+_.-", "K"]
    one = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        want = [(*m.span(), "assign") for m in one.finditer(t) if len(m[2]) >= 12]
        want += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        got = [s for s in secrets.in_points(t.encode(), secrets.spans(t.encode())) if s[2] in secrets.BASE]
        assert got == sorted(want, key=lambda s: (s[0], secrets.KINDS.index(s[2]))), t


def test_secret_query_and_redaction(spark, odd):
    docs = spark.createDataFrame([(1, 'a token = "0123456789abcdef0123" é'), (2, None), (3, "clean")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert got == {1: 'a [secret]" é', 2: None, 3: "clean"}
    rows = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan(docs).collect()}
    assert rows == {1: [("assign", 2, 31), ("hex", 11, 31)], 2: [], 3: []}
    assert secrets.scan(odd).count() == odd.count() and secrets.redact(odd.limit(0)).count() == 0
    assert sorted(map(str, secrets.redact(odd).collect())) == sorted(map(str, odd.collect()))


def edits(a, b):
    """Least distance of a to a substring of b, by the plain table."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_edit_matching_against_brute_force():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 12)))) for i in range(12)]
    matcher = decontamination.Matcher(items, 0.1)
    hits = 0
    for _ in range(150):
        t = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 6)):
            i = rng.randrange(len(t))
            t[i : i + 1] = rng.choice([[], [rng.choice("abcde")], [t[i], "e"]])
        t = decontamination.normal(" ".join(word() for _ in range(5)) + " " + "".join(t).upper() + "\n" + word())
        got = {k: d for k, d, *_ in matcher.find(t)}
        want = {k: d for k, x in items if (d := edits(x, t)) <= int(len(x) * 0.1)}
        assert set(got) == set(want) and all(want[k] == got[k] for k in got)
        hits += len(got)
    assert hits > 50


def test_decontamination(spark, odd):
    bench = spark.createDataFrame([(1, "the cat and the dog sat on the mat"), (2, None), (3, "")], "item_id long, text string")
    got = decontamination.matches(odd, bench).select("doc_id", "item_id", "distance").collect()
    assert sorted((r.doc_id or -1, r.item_id, r.distance) for r in got) == [(-1, 1, 0), (5, 1, 0), (5, 1, 0)]
    left = decontamination.clean(odd, bench)
    assert left.columns == odd.columns and left.count() == odd.count() - 3
    assert decontamination.matches(odd, bench.limit(0)).count() == 0 and decontamination.clean(odd.limit(0), bench).count() == 0
    monkey = list(decontamination.blocks(bench, "item_id", "text", chars=5))
    assert [len(b) for b in monkey] == [1, 1] or sum(map(len, monkey)) == 2


def test_mix(spark, odd):
    got = mixing.mix(odd)
    rows = got.collect()
    assert len(rows) == odd.count() and got.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, [r.source_size, r.target, 0])[2] += r.taken
    assert sum(t for _, t, _ in by.values()) == pytest.approx(sum(r.size for r in rows))
    for size, target, taken in by.values():
        assert target <= 3 * size and taken == pytest.approx(target, abs=1.01)
    assert mixing.mix(odd.limit(0)).count() == 0
    assert sorted(map(str, mixing.mix(odd.repartition(3)).collect())) == sorted(map(str, rows))


def test_mix_shares(spark):
    rows = [(i, "w " * (i % 50), f"s{i % 7}" if i % 3 else "s0") for i in range(2000)]
    out = {r.source: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg({"taken": "sum", "target": "max", "source_size": "max"}).collect()}
    size = {k: r["max(source_size)"] for k, r in out.items()}
    weight = dict(zip(sorted(size), (5, 2, 1) * 3, strict=False))
    target, free, rest = {}, set(size), float(sum(size.values()))
    while True:
        share = {k: rest * weight[k] / sum(weight[j] for j in free) for k in free}
        over = {k for k in free if share[k] > 3 * size[k]}
        if not over:
            break
        target |= {k: 3.0 * size[k] for k in over}
        rest, free = rest - sum(3 * size[k] for k in over), free - over
    target |= share
    for k, r in out.items():
        assert r["max(target)"] == pytest.approx(target[k]) and r["sum(taken)"] == pytest.approx(target[k], abs=1.01)


def test_licenses(spark, odd):
    mit = licenses.TEXTS["MIT"]
    rows = [(1, mit), (2, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("COPYRIGHT HOLDERS", "copyright-holders")), (3, "words\nReleased under the MIT Licence.\nLicensed under CC BY-NC 4.0!"), (4, None), (5, "..."), (6, mit + " more")]
    got = {r.doc_id: (r.license_id, r.notices) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][0] == got[2][0] == "MIT" and got[3] == (None, ["CC-BY-NC-4.0", "MIT"]) and got[4] == got[5] == (None, []) and got[6][0] is None
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(odd.limit(0)).count() == 0


def test_entire_licenses(spark):
    wrap = lambda t: re.sub(r"[ \n]+", lambda m: "\n\n" if "\n\n" in m[0] else "\n" if m.start() % 3 == 0 else " ", t)
    texts = {k: t for k, t in {**licenses.TEXTS, **licenses.MORE_TEXTS}.items() if k in licenses.TITLES}
    rows = [(k, f"{title}\n\nCopyright (c) 2021 Some One\n{said}\n{wrap(t)}\n") for k, t in texts.items() for title in ["", *licenses.TITLES[k]] for said in ("", "All rights reserved.\n")]
    rows += list(licenses.LONG_TEXTS.items())
    rows += [("Apache-2.0", licenses.LONG_TEXTS["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 Some One")), ("GPL-3.0", licenses.LONG_TEXTS["GPL-3.0"].split("How to Apply These")[0])]
    assert {k for k, _ in rows} >= {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense", "MIT"}
    rows += [("none", licenses.LONG_TEXTS["GPL-2.0"] + " and more"), ("none", licenses.MORE_TEXTS["BSD-2-Clause"][:-40])]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [r.license_id or "none" for r in got] == [r.doc_id for r in got] and len(got) == len(rows)


def test_quality(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(quality.sample(docs, labels.where("doc_id % 3 > 0"), 200))
    out = quality.classify(docs, labels.where("doc_id % 3 > 0"), model).select("kept", "doc_id").join(labels.where("doc_id % 3 = 0"), "doc_id")
    right = out.selectExpr("avg(int(kept = (quality = 1))) a").first().a
    assert right > 0.95
    got = quality.classify(odd, labels.limit(0), model).collect()
    assert len(got) == odd.count() and all(0 <= r.quality <= 1 for r in got)
    assert quality.classify(odd.limit(0), labels, model).count() == 0
    assert quality.classify(odd, labels, quality.train([])).count() == odd.count()


def test_sites_shrink(spark):
    rows = [(i, "x", "good" if i < 400 else "bad" if i < 800 else "tiny", "p") for i in range(801)]
    labels = spark.createDataFrame([(i, int(i < 400 or i % 4 == 0)) for i in range(801)], "doc_id long, quality int")
    out = {r.source: r.path_quality for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), labels, quality.train([])).join(spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, source string"), "doc_id").select("source", "path_quality").distinct().collect()}
    assert out["bad"] < 0.35 < out["tiny"] < 0.99 and out["good"] > 0.95

