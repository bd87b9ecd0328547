"""Secret scans with structural confirmation.

Each pattern reads a text once, whatever it holds: none looks at a run of
characters again from each of its places.

Patterns find assignments, access ids and hex runs. Beside these, whatever may
be an encoded key is decoded and taken apart before it is reported: PEM blocks
and bare base64 or hex runs must decode to a private key whose nested DER lengths
add up to the last byte (PKCS#1, PKCS#8 plain or encrypted, SEC 1, OpenSSH),
and signed tokens must have a base64url header that is JSON with an algorithm and
a payload that is JSON.

Scans run over whole texts as UTF-8 bytes, one Arrow batch at a time; cheap
searches for bytes that any match must hold come first. Nothing is shuffled.

Defined cases: a null text is empty and has no spans. Spans of one start are in
order of kind, then of end. Columns of any other name have no say. Repeated rows get the same
answer each. An empty table gives an empty result. `scan` keeps no other columns;
`redact` keeps all.
"""

from __future__ import annotations

import base64
import bisect
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "pem", "der", "jwt"]
BASE = KINDS[:3]

_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
_KEYWORDS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_PEM = re.compile(rb"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----(?:[ \t]*\r?\n)?((?:[A-Za-z][A-Za-z0-9-]*+:[^\n]*+\n(?:[ \t][^\n]*+\n)*+)*+)([A-Za-z0-9+/=\s]++)-----END \1-----")
_RUN64 = re.compile(rb"[A-Za-z0-9+/_-]{40,}={0,2}")
_WRAPPED64 = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+(?:\r?\n[A-Za-z0-9+/_-]++)++={0,2}")
_DEK = re.compile(rb"(?m)^DEK-Info:[ \t]*[A-Z0-9-]+,[0-9A-Fa-f]+\s*$")
_MIXED_HEX_KEY = re.compile(rb"30[0-9a-fA-F]{40,}")
_HEX_KEY = re.compile(rb"(?:30[0-9a-f]{40,}|30[0-9A-F]{40,})")
_TOKEN = re.compile(rb"[A-Za-z0-9_-]*+")


def _ones(chars: bytes) -> bytes:
    return bytes(c in chars for c in range(256))


_IS_HEX = _ones(b"0123456789abcdefABCDEF")
_IS_64 = _ones(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def tlv(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The DER elements between at and end as (tag, start, end), or None if their lengths don't add up."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_openssh_key(data: bytes) -> bool:
    """Whether the nested lengths of an OpenSSH key add up to the last byte: cipher, derivation and its options, then public keys and one private part."""

    def string(at: int) -> int:
        return at + 4 + int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else len(data) + 1

    at = 15
    for _ in range(3):
        at = string(at)
    n = int.from_bytes(data[at : at + 4], "big")
    if at + 4 > len(data) or not 1 <= n <= 64:
        return False
    at += 4
    for _ in range(n):
        at = string(at)
    end = string(at)
    plain = data[15:23] == b"\0\0\0\4none"
    return end == len(data) and end - at >= 12 and (not plain or data[at + 4 : at + 8] == data[at + 8 : at + 12])


def is_encrypted_key(data: bytes) -> bool:
    """Whether data is exactly one DER sequence of an algorithm and an octet string, as an encrypted PKCS#8 key is."""
    top = tlv(data, 0, len(data))
    parts = tlv(data, *top[0][1:]) if top and len(top) == 1 and top[0][0] == 0x30 else None
    if not parts or [t for t, _, _ in parts] != [0x30, 0x04]:
        return False
    inner = tlv(data, *parts[0][1:])
    return bool(inner) and inner[0][0] == 0x06 and parts[1][2] - parts[1][1] >= 8


def is_pem_key(label: bytes, headers: bytes, body: bytes) -> bool:
    data = decoded(body) or b""
    if label.startswith(b"ENCRYPTED"):
        return is_encrypted_key(data)
    return len(data) >= 16 if _DEK.search(headers) else is_private_key(data)


def is_private_key(data: bytes) -> bool:
    """Whether data is an OpenSSH key, or exactly one DER sequence of the members of a private key."""
    if data.startswith(b"openssh-key-v1\0"):
        return is_openssh_key(data)
    top = tlv(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = tlv(data, *top[0][1:])
    if not parts or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return False
    version, tags = data[parts[0][1]], [t for t, _, _ in parts]
    if version <= 1 and len(tags) >= 9 and set(tags[:9]) == {0x02}:  # PKCS#1
        return True
    if version <= 1 and len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:  # PKCS#8
        inner = tlv(data, *parts[1][1:])
        return bool(inner) and inner[0][0] == 0x06
    return version == 1 and len(tags) >= 2 and tags[1] == 0x04  # SEC 1


def decoded(run: bytes) -> bytes | None:
    run = re.sub(rb"\s+", b"", run).rstrip(b"=").translate(bytes.maketrans(b"-_", b"+/"))
    try:
        return base64.b64decode(run + b"=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def wrapped_key(run: bytes) -> int:
    """How many bytes of a base64 run over several lines are a DER key by the length that its first bytes state; 0 if none."""
    head = decoded(run[:8]) or b""
    if len(head) < 6 or head[0] != 0x30:
        return 0
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if n > 4:
        return 0
    size = 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])
    left, at = -(-size * 4 // 3), 0
    while at < len(run) and left:
        left -= run[at] not in b"\r\n"
        at += 1
    if left or run[at : at + 1] not in (b"", b"=", b"\r", b"\n") or not is_private_key(decoded(run[:at]) or b""):
        return 0
    return at + len(run[at:]) - len(run[at:].lstrip(b"="))


def is_signed_token(run: bytes) -> bool:
    try:
        head, body = (json.loads(decoded(x) or b"") for x in run.split(b".")[:2])
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def signed_tokens(data: bytes) -> list[tuple[int, int]]:
    """Signed tokens: from the first eyJ of a run, two runs with a dot after each, and what run follows. Each byte is looked at a few times at most."""
    out, at = [], data.find(b"eyJ")
    while at >= 0:
        end = _TOKEN.match(data, at).end()
        if end - at > 3 and data[end : end + 1] == b".":
            body = _TOKEN.match(data, end + 1).end()
            if body > end + 1 and data[body : body + 1] == b".":
                last = _TOKEN.match(data, body + 1).end()
                if is_signed_token(data[at:last]):
                    out.append((at, last))
                    end = last
        at = data.find(b"eyJ", end)
    return out


def spans(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, by start and then by kind as listed."""
    out = []
    low = data.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(data) if len(m[2]) >= 12]
    if b"AKIA" in data:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(data) if len(m[0]) >= 18]
    hexed = data.translate(_IS_HEX)
    if b"\1" * 16 in hexed:
        out += [(*m.span(), "hex") for m in _HEX.finditer(data)]
        if b"\1" * 42 in hexed:
            found = set()
            for m in (*_HEX_KEY.finditer(data), *_MIXED_HEX_KEY.finditer(data)):
                run = m[0][: len(m[0]) // 2 * 2]
                if is_private_key(bytes.fromhex(run.decode())):
                    found.add((m.start(), m.start() + len(run), "der"))
            out += found
    blocks = [m for m in _PEM.finditer(data) if is_pem_key(m[1], m[2], m[3])] if b"-----BEGIN" in data else []
    out += [(*m.span(), "pem") for m in blocks]
    if b"\1" * 40 in data.translate(_IS_64):
        starts = [m.start() for m in blocks]

        def outside(at: int) -> bool:
            k = bisect.bisect_right(starts, at)
            return not k or at >= blocks[k - 1].end()

        for m in _RUN64.finditer(data):
            if outside(m.start()) and is_private_key(decoded(m[0]) or b""):
                out.append((*m.span(), "der"))
        for m in _WRAPPED64.finditer(data):
            if outside(m.start()) and (n := wrapped_key(m[0])):
                out.append((m.start(), m.start() + n, "der"))
    out += [(a, b, "jwt") for a, b in signed_tokens(data)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def in_points(data: bytes, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The same spans counted in code points."""
    if data.isascii():
        return found
    at, n, place = 0, 0, {}
    for b in sorted({x for s in found for x in s[:2]}):
        n += len(data[at:b].decode("utf-8", "replace"))
        at, place[b] = b, n
    return [(place[a], place[b], k) for a, b, k in found]


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def _scanned(batches):
    for batch in batches:
        rows = []
        for data in _bytes(batch.column(1)):
            found = spans(data)
            rows.append(in_points(data, found) if found else found)
        lists = [[{"kind": k, "start": a, "end": b} for a, b, k in r] for r in rows]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, kind)], names=["doc_id", "spans"])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id and spans, an array of (kind, start, end) in code points."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_scanned, f"doc_id {dict(docs.dtypes)[key]}, spans array<struct<kind:string,start:long,end:long>>")


def cleaned(data: bytes, mark: bytes = b"[secret]") -> bytes:
    """The text with each stretch of spans that overlap or touch replaced by the mark."""
    out, at, end = [], 0, -1
    for a, b, _ in spans(data):
        if a > end:
            out += [data[at:a], mark]
        at = end = max(end, b)
    return b"".join(out) + data[at:] if out else data


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with each secret in the text replaced by the mark; a null text stays null."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            old = batch.column(at)
            raw, known = _bytes(old), old.is_valid().to_pylist()
            new = [cleaned(x, mark.encode()) if ok else None for x, ok in zip(raw, known, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.binary()).cast(old.type) if not pa.types.is_large_string(old.type) else pa.array(new, pa.large_binary()).cast(old.type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    one = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, one), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", one), ",").alias("spans"),
    )
