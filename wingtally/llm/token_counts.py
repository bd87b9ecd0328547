"""Token counts by a tokenizer compiled into finite-state transducers.

The tokenizer is byte-level BPE behind a pattern that cuts a text into pieces.
Both are deterministic machines whose transitions carry the number of tokens
that they add:

* Pieces: whether a piece starts at a character depends on its class (letter,
  number, space, other), on its neighbours' and on contractions beside it. That
  machine has one character of memory and of lookahead, so it runs on columns.
* BPE: the encoding of a prefix ends in one token, and that token begins where
  an encoding of a shorter prefix ended. A state holds, for each suffix of the
  bytes read that begins some longer token, its place in the trie of tokens,
  the token that ended before it and how many tokens ago. The next byte picks
  the one token that may follow its predecessor; the count changes by one less
  the tokens that it swallows. States are made when a byte first leads to them.

Texts are laid end to end and cut into chunks of equal length, each a lane; all
lanes step together. A chunk's state map is the set of its known (entry, exit)
pairs: the first entry is the state that the bytes before it lead to from a
fresh start, which is the true one where a piece starts among them. Maps are
composed by a prefix scan of doubling steps; where a chunk's entry is not the
exit of what stands before it, the chunk runs once more from that exit, until
no such chunk is left. Results are exact for pieces of any length.

Defined cases: a null or empty text has 0 bytes and 0 tokens. Texts are read
whole. Repeated rows and doc_ids get their answer each, in no order. Columns of
the input other than key and text are not returned, so names cannot clash. An
empty table gives an empty result. Memory in a task: some 40 bytes for each of
the `BATCH` bytes at hand, the batch of texts itself, and the machine's tables,
which are dropped and made anew at `STATES` states.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from . import shared

#: Bytes of text that are handled at once, bytes of a chunk, bytes before a chunk that its first entry is taken from.
BATCH, CHUNK, BEFORE = 1 << 22, 256, 24
#: States after which the tables are made anew; a matter of memory alone (1.3 kB each).
STATES = 100_000
#: Under a trie node with at most so many tokens, predecessors that allow the same of them count as one.
NARROW = 16

_LETTER, _NUMBER, _BLANK, _OTHER, _END = range(5)


# ------------------------------------------------------------------ pieces


@cache
def classes() -> np.ndarray:
    """The class of each code point. Letters and numbers that are younger than the Unicode of the tokenizers library
    are other characters to it, so it is asked of each whether it joins a letter or a digit."""
    out = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            start, stop = (i if i < 0xD800 else i + 0x800 for i in (m.start(), m.end() - 1))
            out[start : stop + 1] = kind
    out[0xD800:0xE000] = _OTHER
    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    points = np.flatnonzero(out < _BLANK)
    for part in np.array_split(points, 64):
        cuts = np.array([span[0] for _, span in split("".join(f"a{chr(c)}1{chr(c)} " for c in part))])
        place = 5 * np.arange(len(part))
        out[part] = np.where(~np.isin(place + 1, cuts), _LETTER, np.where(~np.isin(place + 3, cuts), _NUMBER, _OTHER))
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first byte of each character of UTF-8 bytes, and its code point."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int64)
    data = np.r_[data, np.zeros(3, np.uint8)]  # the last character may be cut off
    size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
    point = lead & np.array([0, 0x7F, 0x1F, 0x0F, 0x07])[size]
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        point[more] = point[more] << 6 | (data[at[more] + k] & 0x3F)
    return at, point


def piece_starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each byte, whether a piece starts there. edges: bytes at which a text or stretch of one begins."""
    at, point = code_points(data)
    n = len(at)
    start = np.zeros(len(data), bool)
    if not n:
        return start
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(at, edges[edges < len(data)])] = True
    edge[n] = True
    edge, last = edge[:n], edge[1:]
    kind = classes()[point]
    before = np.r_[_END, kind[:-1]]
    before[edge] = _END
    after = np.r_[kind[1:], _END]
    after[last] = _END
    blank = kind == _BLANK
    ordinary = point == 32
    glued = np.r_[False, ordinary[:-1]] & ~edge
    first = kind != before
    # a blank space joins what follows; in a run of blanks the last one is a piece's start unless the text ends there
    begin = np.where(blank, first | ((after != _BLANK) & (after != _END)), first & ~glued)
    # contractions: an apostrophe that starts a piece takes these letters
    mark = np.flatnonzero((point == 39) & begin)
    padded, edged = np.r_[point, 0, 0, 0], np.r_[edge, True, True, True]
    one, two = padded[mark + 1], padded[mark + 2]
    single = np.isin(one, [ord(c) for c in "stmd"]) & ~edged[mark + 1]
    double = np.zeros(len(mark), bool)
    for a, b in ("re", "ve", "ll"):
        double |= (one == ord(a)) & (two == ord(b))
    double &= ~edged[mark + 1] & ~edged[mark + 2]
    for hit, size in ((mark[single], 1), (mark[double & ~single], 2)):
        begin[hit + 1] = False
        nxt = hit + 1 + size
        nxt = nxt[nxt < n]
        # what follows a contraction starts a piece, but for a mark or blank that does so by itself
        begin[nxt] |= kind[nxt] == _LETTER
    start[at] = begin
    return start


# ------------------------------------------------------------------ BPE


def _bytes_of(word: str, back: dict[str, int]) -> bytes:
    return bytes(back[c] for c in word)


class Machine:
    """The transducer of a byte-level BPE vocabulary. Tokens are numbered: bytes first, then merges by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.special = [x["content"].encode() for x in content["added_tokens"]]
        number = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int]] = [(-1, -1)] * 256
        self.merge: dict[tuple[int, int], int] = {}
        for pair in content["model"]["merges"]:
            left, right = (_bytes_of(w, back) for w in (pair if isinstance(pair, list) else pair.split(" ")))
            a, b = number[left], number[right]
            if left + right in number:
                raise ValueError("two merges that give one token are not supported")
            number[left + right] = self.merge[a, b] = len(self.parts)
            self.parts.append((a, b))
        self._trie: dict[int, int] = {}
        self._token, self._inner = [-1], [True]
        for word, token in number.items():
            if token >= 256 and not self.follows(*self.parts[token], stop=token):
                continue  # never the encoding of its own bytes
            node = 0
            for b in word:
                key = node << 8 | b
                if key not in self._trie:
                    self._trie[key] = len(self._token)
                    self._token.append(-1)
                    self._inner.append(False)
                    self._inner[node] = True
                node = self._trie[key]
            self._token[node] = token
        self._below: list[list[int]] = [[] for _ in self._token]
        for word, token in number.items():
            node = 0
            for b in word[:-1]:
                node = self._trie.get(node << 8 | b, -1)
                if node < 0:
                    break
                if len(self._below[node]) <= NARROW:
                    self._below[node].append(token)
        self.clear()

    def clear(self) -> None:
        """Forget the states, which are made again as bytes lead to them."""
        self._pairs: dict[int, bool] = {}
        self._like: dict[tuple[int, int], int | None] = {}
        self._named: dict[tuple, int] = {}
        self._states: list[tuple] = [((0, -1, 0),)]
        self._number = {self._states[0]: 0}
        self.to = np.full(1024 * 256, -1, np.int32)
        self.adds = np.zeros(1024 * 256, np.int8)

    def follows(self, left: int, right: int, stop: int | None = None) -> bool:
        """Whether no merge crosses the border of two tokens whose bytes stand side by side (below the merge `stop`)."""
        never = len(self.parts)
        ends = []  # tokens at the border of the left one: when they come about and when they are used up
        token, used = left, never
        while True:
            ends.append((token, token if token >= 256 else -1, used))
            if token < 256:
                break
            token, used = self.parts[token][1], token
        token, used = right, never
        while True:
            made = token if token >= 256 else -1
            for x, x_made, x_used in ends:
                rank = self.merge.get((x, token))
                if rank is not None and x_made <= used and made < x_used and rank < x_used and rank <= used and not (rank == stop and x == left and token == right):
                    return False
            if token < 256:
                return True
            token, used = self.parts[token][0], token

    def _may(self, left: int, right: int) -> bool:
        if left < 0:
            return True
        known = self._pairs.get(left << 20 | right)
        if known is None:
            known = self._pairs[left << 20 | right] = self.follows(left, right)
        return known

    def _alike(self, node: int, before: int) -> int | None:
        """A token that the tokens below node may follow just as they may follow `before`; None where none may."""
        tokens = self._below[node]
        if len(tokens) > NARROW:
            return before
        known = self._like.get((node, before), -2)
        if known == -2:
            fit = tuple(t for t in tokens if before < 0 or self.follows(before, t))
            known = self._like[node, before] = self._named.setdefault((node, fit), before) if fit else None
        return known

    def learn(self, keys: np.ndarray) -> None:
        """Make the transitions of these keys (state * 256 + byte)."""
        trie, tokens, inner = self._trie, self._token, self._inner
        for key in keys.tolist():
            b = key & 255
            step, kept = None, []
            for node, before, ago in self._states[key >> 8]:
                child = trie.get(node << 8 | b)
                if child is None:
                    continue
                token = tokens[child]
                if step is None and token >= 0 and self._may(before, token):
                    step, last = 1 - ago, token
                if inner[child] and (alike := self._alike(child, before)) is not None:
                    kept.append((child, alike, ago))
            state = (*((c, t, ago + step) for c, t, ago in kept), (0, last, 0))
            to = self._number.setdefault(state, len(self._states))
            if to == len(self._states):
                self._states.append(state)
                if len(self._states) * 256 > len(self.to):
                    self.to = np.concatenate([self.to, np.full(len(self.to), -1, np.int32)])
                    self.adds = np.concatenate([self.adds, np.zeros(len(self.adds), np.int8)])
            self.to[key], self.adds[key] = to, step

    def run(self, data: np.ndarray, start: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lanes in columns: exit states, and what each byte adds. start: a piece starts at the byte."""
        state = entry.astype(np.int32)
        added = np.zeros(data.shape, np.int8)
        fresh = (~start).astype(np.int32)
        for k in range(len(data)):
            key = (state * fresh[k] << 8) + data[k]
            state = self.to[key]
            if state.min() < 0:
                self.learn(np.unique(key[state < 0]))
                state = self.to[key]
            added[k] = self.adds[key]
        return state, added


@cache
def machine(path: str) -> Machine:
    return Machine(path)


def _broken(entry: np.ndarray, leave: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Chunks whose entry differs from their predecessor's exit while all before them, back to a fixed one, fit.

    The scan composes neighbours in doubling steps: a stretch of chunks is sound where both halves are and the exit of the left is the entry of the right."""
    fits = np.r_[True, entry[1:] == leave[:-1]] | fixed
    sound, since = fits.copy(), fixed.copy()
    since[0] = True
    reach = 1
    while reach < len(entry):
        left_sound, left_since = np.r_[np.ones(reach, bool), sound[:-reach]], np.r_[np.ones(reach, bool), since[:-reach]]
        sound = np.where(since, sound, sound & left_sound)
        since = since | left_since
        reach *= 2
    before = np.r_[True, sound[:-1]]
    return np.flatnonzero(~fits & before)


def added_tokens(m: Machine, data: np.ndarray, start: np.ndarray, first: int = 0, chunk: int = CHUNK, before: int = BEFORE) -> tuple[np.ndarray, int]:
    """What each byte adds to its text's number of tokens, and the state behind the last one.

    data are texts end to end, start says where pieces start, first is the state before the first byte."""
    n = len(data)
    lanes = -(-n // chunk)
    if not lanes:
        return np.zeros(0, np.int64), first
    pad = lanes * chunk - n
    flat, begin = np.r_[np.zeros(before, np.uint8), data, np.zeros(pad, np.uint8)], np.r_[np.ones(before, bool), start, np.ones(pad, bool)]
    rows = lambda x: np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, before)[: lanes * chunk : chunk].T)
    entry, _ = m.run(rows(flat), rows(begin), np.zeros(lanes, np.int32))
    block = np.ascontiguousarray(flat[before:].reshape(lanes, chunk).T)
    opens = np.ascontiguousarray(begin[before:].reshape(lanes, chunk).T)
    fixed = opens[0]
    entry[fixed] = 0
    entry[0] = first
    leave, added = m.run(block, opens, entry)
    while len(bad := _broken(entry, leave, fixed)):
        entry[bad] = leave[bad - 1]
        leave[bad], added[:, bad] = m.run(block[:, bad], opens[:, bad], entry[bad])
    if pad:  # the state behind the last byte, not behind what fills its chunk up
        leave[-1:], _ = m.run(block[: chunk - pad, -1:], opens[: chunk - pad, -1:], entry[-1:])
    return added.T.reshape(-1)[:n].astype(np.int64), int(leave[-1])


def count(m: Machine, text: pa.Array, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each text; `batch` bytes at a time."""
    if len(m._states) > STATES:
        m.clear()
    off, data = shared.offsets(text)
    edges, gone, extra = [off[:-1]], [], np.zeros(len(text), np.int64)
    for word in m.special:
        for hit in regex.finditer(regex.escape(word), memoryview(data)):
            row = np.searchsorted(off, hit.start(), "right") - 1
            if hit.end() <= off[row + 1]:
                extra[row] += 1
                edges.append(np.array(hit.span()))
                gone.append(hit.span())
    edges = np.sort(np.concatenate(edges))
    total, state, so_far = np.zeros(len(off), np.int64), 0, 0
    for low in range(0, len(data), batch):
        high = min(low + batch, len(data))
        left, right = max(0, low - 32), min(high + 32, len(data))  # the pieces' machine looks at a few characters on either side
        near = edges[np.searchsorted(edges, left) : np.searchsorted(edges, right)] - left
        start = piece_starts(data[left:right], near)[low - left : high - left]
        added, state = added_tokens(m, data[low:high], start, state)
        for begin, end in gone:
            added[max(0, begin - low) : max(0, end - low)] = 0
        sums = np.r_[so_far, so_far + np.cumsum(added)]
        inside = slice(np.searchsorted(off, low, "right"), np.searchsorted(off, high, "right"))
        total[inside] = sums[off[inside] - low]
        so_far = sums[-1]
    return np.diff(off), np.diff(total) + extra


def _counted(path: str):
    def run(batches):
        m = machine(path)
        for batch in batches:
            for part in shared.pieces(batch, BATCH):
                size, tokens = count(m, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens by the byte-level BPE file at path, and over_limit (n_tokens > limit).

    The file is read on each executor, at the same path."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    out = rows.mapInArrow(_counted(path), f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
