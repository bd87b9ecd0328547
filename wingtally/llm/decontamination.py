"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of k edits is split into k + 1 pieces. Wherever the
item occurs with at most k edits, one piece at least occurs unchanged, so exact
piece hits (Aho-Corasick, all pieces at once) give every candidate place, and
Myers' bit-parallel distance over the place and k characters around it decides.

Texts and items are compared in lower case with one blank between words. Items
travel to the tasks in blocks of a bounded number of characters, one pass over
the documents a block, so a large benchmark costs passes and not memory.

A text's hits of an item join to stretches, and the distance runs over each once,
so that a text that repeats the item all over costs no more than its length.

Defined cases: a null or empty text matches nothing, nor does an empty item. Of
places with the same distance the first is taken. Null and repeated keys of
items or documents stand in the result as they are. Columns of any other name
have no say, and `clean` leaves them as they are. Repeated rows get the same answer each; repeated items count as items. An empty
table gives an empty result. Whole texts are read, however long.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Edits that an item may have, as a share of its characters.
BUDGET = 0.05
#: Characters of items that one pass looks for.
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def cut(item: str, budget: float) -> list[tuple[int, str]]:
    """The item's pieces with their offsets; as many as its edits and one."""
    n = int(len(item) * budget) + 1
    ends = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False) if b > a]


class Pattern:
    """Myers' distance of one item to substrings of a text."""

    def __init__(self, item: str):
        self.m, self.peq = len(item), {}
        for i, c in enumerate(item):
            self.peq[c] = self.peq.get(c, 0) | (1 << i)

    def best(self, text: str) -> tuple[int, int]:
        """Least distance of the item to a substring of text, and the first end where it has it."""
        return min(self.ends(text, self.m), default=(self.m, 0))

    def ends(self, text: str, most: int) -> list[tuple[int, int]]:
        """(distance, end) of each end where a substring of text is within `most` edits of the item."""
        high, mask = 1 << (self.m - 1), (1 << self.m) - 1
        pv, mv, score = mask, 0, self.m
        out = []
        get = self.peq.get
        for i, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (~(xh | pv) & mask)
            mh = pv & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
            ph = (ph << 1) & mask
            pv = ((mh << 1) & mask) | (~(xv | ph) & mask)
            mv = ph & xv
            if score <= most:
                out.append((score, i + 1))
        return out


class Matcher:
    """All occurrences within budget of a block of items in a text."""

    def __init__(self, items: list[tuple], budget: float):
        self.items = [(key, normal(t)) for key, t in items]
        self.budget = [int(len(t) * budget) for _, t in self.items]
        self.patterns = [None] * len(self.items)
        pieces: dict[str, list] = {}
        for i, (_, t) in enumerate(self.items):
            for offset, piece in cut(t, budget):
                pieces.setdefault(piece, []).append((i, offset))
        self.finder = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.finder.add_word(piece, (len(piece), where))
        self.finder.make_automaton()

    def find(self, text: str | None) -> list[tuple]:
        """(item, distance, start, end, places) in the normal text for each item found: its best place and the number of places."""
        text = normal(text)
        near: dict[int, list[tuple[int, int]]] = {}
        for last, (size, where) in self.finder.iter(text) if text and len(self.finder) else ():
            for i, offset in where:
                k, m = self.budget[i], len(self.items[i][1])
                at = last + 1 - size - offset  # where the item starts if nothing is amiss before the piece
                low, high = max(0, at - k), min(len(text), at + m + k)
                spans = near.setdefault(i, [])
                # hits come by their end: only stretches at the end can still meet this one
                while spans and low <= spans[-1][1] and high >= spans[-1][0]:
                    low, high = min(low, spans[-1][0]), max(high, spans.pop()[1])
                spans.append((low, high))
        out = []
        for i, spans in sorted(near.items()):
            found = [x for low, high in _joined(spans) for x in self._places(i, text, low, high)]
            if found:
                out.append((self.items[i][0], *min(found), len(found)))
        return out

    def _places(self, i: int, text: str, low: int, high: int) -> list[tuple[int, int, int]]:
        """(distance, start, end) of places of item i in a stretch, none over another; each character is looked at a few times, however often the item recurs."""
        k, item = self.budget[i], self.items[i][1]
        p = self.patterns[i] = self.patterns[i] or (Pattern(item), Pattern(item[::-1]))
        ends, out, at = p[0].ends(text[low:high], k), [], 0
        while at < len(ends):
            # the best of the ends that belong to one place
            stop = at
            while stop < len(ends) and ends[stop][1] <= ends[at][1] + 2 * k:
                stop += 1
            distance, end = min(ends[at:stop])
            begin = max(0, end - len(item) - k)
            back, length = p[1].best(text[low + begin : low + end][::-1])
            out.append((distance, low + end - length, low + end))
            # the next place starts after this one and has all but k of the item's characters
            while at < len(ends) and (at < stop or ends[at][1] < end + len(item) - k):
                at += 1
        best = min(ends, default=None)
        if best and best[0] < min(out)[0]:  # it lies over a place found before
            begin = max(0, best[1] - len(item) - k)
            length = p[1].best(text[low + begin : low + best[1]][::-1])[1]
            out = [(best[0], low + best[1] - length, low + best[1]), *(x for x in out if x[2] <= low + best[1] - length or x[1] >= low + best[1])]
        return out


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def blocks(benchmark: DataFrame, item_key: str, item_text: str, chars: int = BLOCK_CHARS):
    """The items in lists of at most `chars` characters (or one item), as they come."""
    block, size = [], 0
    for key, text in benchmark.where(F.col(item_text).isNotNull()).select(item_key, item_text).toLocalIterator():
        if block and size + len(text) > chars:
            yield block
            block, size = [], 0
        block.append((key, text))
        size += len(text)
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", budget: float = BUDGET) -> DataFrame:
    """doc_id, item_id, distance, start, end, places: one row for each row of docs and each item found in it."""
    spark = docs.sparkSession
    kind, item_kind = dict(docs.dtypes)[key], dict(benchmark.dtypes)[item_key]
    item_type = to_arrow_type(benchmark.schema[item_key].dataType)
    schema = f"doc_id {kind}, item_id {item_kind}, distance int, start int, end int, places int"
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in blocks(benchmark, item_key, item_text):
        shared_block = spark.sparkContext.broadcast(block)  # BLOCK_CHARS at most

        def run(batches, shared_block=shared_block):
            matcher = Matcher(shared_block.value, budget)
            for batch in batches:
                found = [(batch.column(0)[i], *f) for i, t in enumerate(batch.column(1).to_pylist()) for f in matcher.find(t)]
                columns = list(zip(*found, strict=True)) or [()] * 6
                kinds = [batch.column(0).type, item_type, *[pa.int32()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([getattr(x, "as_py", lambda x=x: x)() for x in c], t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "distance", "start", "end", "places"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the rows that hold an item: each pass filters, so nothing is joined."""
    budget = how.get("budget", BUDGET)
    for block in blocks(benchmark, "item_id", "text"):
        shared_block = docs.sparkSession.sparkContext.broadcast(block)
        at = docs.columns.index("text")

        def run(batches, shared_block=shared_block, at=at):
            matcher = Matcher(shared_block.value, budget)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
