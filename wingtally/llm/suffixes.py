"""Removal of repeated passages by sparse, distributed prefix doubling.

A byte goes if a string of LENGTH bytes that covers it also starts in a document
with a smaller doc_id. Full prefix doubling would sort a rank for every byte of
the corpus in every round; here the same rounds run on sampled positions, which
loses nothing: every string of LENGTH bytes holds one position picked by its
content alone (the least hash of its GRAM-byte pieces), so equal strings meet at
the same piece.

Round 0 ranks picked positions by their first GRAM bytes: Spark deals the (rank,
text) pairs by rank, tasks sort them, and ranks that one text alone has are
unique and drop out. Round 1 doubles the depth for what is left: each position
brings the bytes around it, up to LENGTH on either side, the strings over it are
ranked at LENGTH, the threshold, and the least document of each rank is found.
Strings whose least document is smaller mark their bytes, once their bytes have
been compared with that document's.

Copies of a text are one text from the start, of the least doc_id, and ranks travel
with its number in its batch alone: what they take does not grow with the buckets. In a task, equal surroundings travel once, so a passage that a third of all documents share
is at most one row a task. Pairs travel packed, surroundings compressed;
texts are dealt out once, by doc_id and hash, and used twice.

Ranks are 64-bit hashes; a clash costs a comparison. Copies are known by a 64-bit
hash and their size, surroundings in a task by 128 bits. Defined cases: ties and
columns of any other name have no say; a null text has no bytes. A null doc_id
is larger than all others. Rows with the same doc_id are one document: they never
remove each other's bytes. Repeated rows get the same answer each. An empty table
gives an empty result. Other columns are not returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

LENGTH, GRAM = 50, 24
_LAST = 2**63 - 1  # stands for a null doc_id


class Picked:
    """The picked positions of each text: at, the first and last start of the strings it is picked for, and its row."""

    def __init__(self, text: pa.Array, length: int = LENGTH, gram: int = GRAM):
        self.off, self.data = shared.offsets(text)
        n = len(self.data)
        m, width = n - gram + 1, length - gram + 1
        if n < length:
            self.at = self.low = self.high = self.row = np.zeros(0, np.int64)
            self.rank = np.zeros(0, np.uint64)
            return
        at = np.arange(m)
        rank = shared.grams(shared.mixed(shared.eights(self.data)), slice(0, m), gram)
        v = (rank & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64)  # least hash, and the first place that has it
        have = 1
        while have < width:
            step = min(have, width - have)
            v = np.minimum(v[:-step], v[step:])
            have += step
        pick = (v & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the string at each start
        row = np.searchsorted(self.off, np.arange(len(pick)), "right") - 1
        ok = np.flatnonzero(np.arange(len(pick)) + length <= self.off[row + 1])
        pick, row = pick[ok], row[ok]
        cut = np.flatnonzero(np.r_[True, (pick[1:] != pick[:-1]) | (row[1:] != row[:-1])]) if len(ok) else np.zeros(0, np.int64)
        self.at, self.row, self.low, self.high = pick[cut], row[cut], ok[cut], ok[np.r_[cut[1:], len(ok)][: len(cut)] - 1]
        self.rank = rank[self.at]


#: Ranks travel as their upper 5 bytes; within a bucket that is enough to tell them apart, and a chance tie only means that a position is looked at again.
_TOP = ~np.uint64(0xFFFFFF)


def _packed(rank: np.ndarray) -> bytes:
    return np.ascontiguousarray(rank.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, 3:] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _dealt(key: np.ndarray, buckets: int):
    b = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    b = b[order]
    if len(b):
        cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        for a, z in zip(cut, np.r_[cut[1:], len(b)], strict=True):
            yield int(b[a]), order[a:z]


_RANKS = ["bucket", "source", "ranks", "numbers", "texts"]


def _first_round(length: int, gram: int, buckets: int):
    """(bucket, source, ranks, numbers): the picked ranks of each text, once each, with its number in the batch, the
    source; and once for each source its texts, as id and content."""

    def run(batches):
        seen: set[tuple] = set()
        for batch in batches:
            out: dict[int, list] = {}
            texts: list[tuple] = []
            for part in shared.pieces(batch):
                p, names = Picked(part.column(0), length, gram), list(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True))
                new = np.array([not (x in seen or seen.add(x)) for x in names], bool)
                use = new[p.row]
                rank, row = p.rank[use], p.row[use]
                order = np.lexsort((rank, row))
                rank, row = rank[order], row[order]
                once = np.r_[True, (rank[1:] != rank[:-1]) | (row[1:] != row[:-1])][: len(rank)]
                rank, row = rank[once], row[once] + len(texts)
                texts += names
                for b, i in _dealt(rank, buckets):
                    x = out.setdefault(b, [[], []])
                    x[0].append(rank[i])
                    x[1].append(row[i].astype(np.uint32))
            named = np.array(texts, np.int64).tobytes()
            source = xxhash.xxh3_64_intdigest(named) >> 1
            small = np.uint16 if len(texts) <= 1 << 16 else np.uint32
            rows = [(b, source, _packed(np.concatenate(rank)), np.concatenate(row).astype(small).tobytes(), None) for b, (rank, row) in out.items()]
            rows += [(source % buckets, source, None, None, named)] * bool(out)
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n < 2 else pa.binary()) for n, c in enumerate(cols)], names=_RANKS)

    return run


def _buckets(batches):
    at, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != at and held:
                yield held
                held = []
            at = row[0]
            held.append(row[1:])
    if held:
        yield held


def _numbers(numbers: bytes, ranks: bytes) -> np.ndarray:
    return np.frombuffer(numbers, np.uint16 if len(numbers) * 5 == len(ranks) * 2 else np.uint32)


def _not_unique(batches):
    """(source, ranks, numbers, texts): the rows of the first round with the ranks that another text has too."""
    for rows in _buckets(batches):
        out = [r for r in rows if r[3] is not None]
        rows = [r for r in rows if r[3] is None]
        rank = _unpacked(b"".join(r[1] for r in rows))
        number = [_numbers(r[2], r[1]) for r in rows]
        at_row = np.repeat(np.arange(len(rows)), [len(n) for n in number])
        _, inverse, n = np.unique(rank, return_inverse=True, return_counts=True)
        ok = n[inverse] > 1  # a source has a rank of a text once, and a text has one source
        cut = np.searchsorted(at_row[ok], np.arange(len(rows) + 1))
        rank = rank[ok]
        for r, x, own, a, z in zip(rows, np.split(ok, np.cumsum([len(x) for x in number])[:-1]), number, cut[:-1], cut[1:], strict=True) if rows else ():
            if z > a:
                out.append((r[0], _packed(rank[a:z]), own[x].tobytes(), None))
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n else pa.int64()) for n, c in enumerate(cols)], names=_RANKS[1:])


def _resolved(batches):
    """(doc, of, ranks): the ranks of each text that has some, from the rows of its source, which come together."""
    for rows in _buckets(batches):
        held = [r for r in rows if r[2] is None]
        if not held:
            continue
        texts = np.frombuffer(next((r[2] for r in rows if r[2] is not None), b""), np.int64).reshape(-1, 2)
        number = np.concatenate([_numbers(r[1], r[0]) for r in held]).astype(np.int64)
        order = np.argsort(number, kind="stable")
        rank, number = _unpacked(b"".join(r[0] for r in held))[order], number[order]
        cut = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        packed = [_packed(rank[a:z]) for a, z in zip(cut, np.r_[cut[1:], len(number)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(texts[number[cut], 0]), pa.array(texts[number[cut], 1]), pa.array(packed, pa.binary())], names=["doc", "of", "ranks"])


_PART = ["bucket", "ids", "contents", "starts", "sizes", "bytes", "done_ids", "done_contents", "done_starts", "done_sizes"]


def _second_round(length: int, gram: int, buckets: int):
    """The surroundings of shared positions by bucket of their rank, and spans settled in the task: equal surroundings of a smaller document."""

    def run(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            out: dict[int, list] = {}
            for part in shared.pieces(batch):
                ids, contents, ranks = part.column(0).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False), part.column(3).to_pylist()
                p = Picked(part.column(1), length, gram)
                row_at = np.searchsorted(p.row, np.arange(len(ids) + 1))
                top = p.rank & _TOP
                keep = np.concatenate([a + np.flatnonzero(np.isin(top[a:z], _unpacked(r))) for a, z, r in zip(row_at[:-1], row_at[1:], ranks, strict=True)])
                low, high, row = p.low[keep], p.high[keep] + length, p.row[keep]
                doc, content = ids[row], contents[row]
                whole = p.data.tobytes()
                around = [whole[x:y] for x, y in zip(low.tolist(), high.tolist(), strict=True)]
                fresh = np.array([seen.setdefault(xxhash.xxh3_128_intdigest(x), d) for x, d in zip(around, doc.tolist(), strict=True)], np.int64) >= doc
                start, size = (low - p.off[row]).astype(np.uint32), (high - low).astype(np.uint8)
                for b, j in _dealt(p.rank[keep], buckets):
                    x = out.setdefault(b, [[] for _ in _PART[1:]])
                    for at, k in ((0, j[fresh[j]]), (5, j[~fresh[j]])):
                        for i, column in enumerate((doc, content, start, size)):
                            x[at + i].append(column[k])
                    x[4] += [around[k] for k in j[fresh[j]].tolist()]
            pack = zstandard.ZstdCompressor(level=1).compress
            rows = [(b, *(pack(b"".join(c)) if n == 4 else b"".join(a.tobytes() for a in c) for n, c in enumerate(x))) for b, x in out.items()]
            cols = list(zip(*rows, strict=True)) or [()] * len(_PART)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=_PART)

    return run


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that overlap or touch, joined."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    # the furthest end so far in the same owner: owners follow each other, so lift each by its place
    _, place = np.unique(owner, return_inverse=True)
    lift = place.astype(np.int64) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + lift)
    new = np.r_[True, (start + lift)[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    return owner[at], start[at], (reach - lift)[np.r_[at[1:], len(owner)] - 1]


def least_owner(data: np.ndarray, start: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For the string of `length` bytes at each start, the least owner of an equal one. Strings of equal hash are compared byte by byte."""
    exact = shared.eights(data)
    h = shared.grams(shared.mixed(exact), start, length)
    order = np.lexsort((owner, h))
    cut = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, np.int64)
    first = np.empty(len(h), np.int64)
    first[order] = np.repeat(order[cut], np.diff(np.r_[cut, len(h)]))
    same = np.ones(len(h), bool)
    for k in [*range(0, length - 7, 8), length - 8]:
        same &= exact[start + k] == exact[start[first] + k]
    least = owner[first]
    if not same.all():  # a clash of hashes
        by: dict[bytes, int] = {}
        clash = np.flatnonzero(np.isin(h, h[~same]))
        text = [data[s : s + length].tobytes() for s in start[clash].tolist()]
        for x, o in zip(text, owner[clash].tolist(), strict=True):
            by[x] = min(by.get(x, o), o)
        least[clash] = [by[x] for x in text]
    return least


def _marked(length: int):
    """(id, content, starts, ends): bytes of each text that a string of a smaller document covers."""

    def run(batches):
        for rows in _buckets(batches):
            kinds = [np.int64, np.int64, np.uint32, np.uint8, np.uint8, np.int64, np.int64, np.uint32, np.uint8]
            unpack = zstandard.ZstdDecompressor().decompress
            blobs = (b"".join(unpack(r[i]) if i == 4 else r[i] for r in rows) for i in range(len(kinds)))
            ids, content, start, size, data, d_id, d_content, d_start, d_size = (np.frombuffer(x, k) for x, k in zip(blobs, kinds, strict=True))
            size, start, d_start, d_size = (x.astype(np.int64) for x in (size, start, d_start, d_size))
            n = size - length + 1
            item = np.repeat(np.arange(len(n)), n)
            inside = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
            hit = least_owner(data, (np.cumsum(size) - size)[item] + inside, ids[item], length) < ids[item]
            at = (start[item] + inside)[hit]
            ids, content = np.r_[d_id, ids[item][hit]], np.r_[d_content, content[item][hit]]
            order = np.lexsort((content, ids))
            ids, content = ids[order], content[order]
            new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (content[1:] != content[:-1])]) if len(ids) else np.zeros(0, np.int64)
            number = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(ids)]))
            o, a, z = merged(number, np.r_[d_start, at][order], np.r_[d_start + d_size, at + length][order])
            ends = np.searchsorted(o, np.arange(len(new) + 1))
            cutting = lambda x, ends=ends: pa.array([x[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids[new]), pa.array(content[new]), cutting(a.astype(np.int64)), cutting(z.astype(np.int64))], names=["id", "content", "starts", "ends"])

    return run


def _cut_out(length: int):
    """Each document's bytes without its spans; a copy of an earlier text of LENGTH bytes or more goes whole."""

    def run(batches):
        for batch in batches:
            rows = []
            ids, first, starts, ends = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            off, data = shared.offsets(batch.column(1))
            for i, doc in enumerate(ids):
                own = data[off[i] : off[i + 1]]
                if first[i] < doc:
                    a, z = (np.array([0]), np.array([len(own)])) if len(own) >= length else (np.zeros(0, np.int64),) * 2
                else:
                    a, z = (np.frombuffer(b"".join(x or []), np.int64) for x in (starts[i], ends[i]))
                _, a, z = merged(np.zeros(len(a), np.int64), a, z)
                sha, at = hashlib.sha256(), 0
                for x, y in zip(a.tolist(), z.tolist(), strict=True):
                    sha.update(own[at:x])
                    at = y
                sha.update(own[at:])
                spans = [{"start": x, "end": y} for x, y in zip(a.tolist(), z.tolist(), strict=True)]
                rows.append((None if doc == _LAST else doc, len(own), int((z - a).sum()), spans, sha.hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"])

    return run


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, spans (start and end of each removed run, in bytes) and kept_sha256.

    key is an integer below 2**63 - 1. length is at most 100, so that surroundings fit their packing."""
    spark = docs.sparkSession
    n_tasks = shared.tasks(spark)
    buckets = 4 * n_tasks
    d = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("content"))
    known = shared.written(d.select("id", "content", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).distinct(), "texts")
    firsts = shared.written(known.groupBy("content", "size").agg(F.min("id").alias("first")), "firsts")
    info = known.join(firsts, ["content", "size"]).groupBy(F.col("id").alias("doc"), "content").agg(F.min("first").alias("first"))
    info = shared.written(info, "info")
    dealt = d.repartition(n_tasks, "id", "content")  # used three times: one exchange
    own = info.where(F.col("first") == F.col("doc")).select("doc", F.col("content").alias("of"))
    ranks = dealt.join(own.hint("shuffle_hash"), (dealt["id"] == own["doc"]) & (dealt["content"] == own["of"])).select("text", "id", "content").sortWithinPartitions("id", "content")
    ranks = ranks.mapInArrow(_first_round(length, gram, buckets), "bucket long, source long, ranks binary, numbers binary, texts binary")
    ranks = ranks.repartition(n_tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_not_unique, "source long, ranks binary, numbers binary, texts binary")
    ranks = ranks.repartition(n_tasks, "source").sortWithinPartitions("source").mapInArrow(_resolved, "doc long, of long, ranks binary")
    near = dealt.join(ranks.hint("shuffle_hash"), (dealt["id"] == ranks["doc"]) & (dealt["content"] == ranks["of"])).select("id", "text", "content", "ranks").sortWithinPartitions("id")
    parts = near.mapInArrow(_second_round(length, gram, buckets), ", ".join(f"{c} {'long' if c == 'bucket' else 'binary'}" for c in _PART))
    spans = parts.repartition(n_tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_marked(length), "id long, content long, starts binary, ends binary")
    spans = spans.groupBy(F.col("id").alias("marked"), F.col("content").alias("of")).agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))
    info = info.join(spans, (info["doc"] == spans["marked"]) & (info["content"] == spans["of"]), "left").drop("marked", "of")
    out = dealt.join(info.hint("shuffle_hash"), (dealt["id"] == info["doc"]) & (dealt["content"] == info["content"])).select("id", "text", "first", "starts", "ends")
    return out.mapInArrow(_cut_out(length), "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
