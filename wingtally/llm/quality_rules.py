"""Quality rules: lines that many documents of a host share are removed, and
documents that this depletes are rejected, beside rules on each text alone.

One pass of a byte kernel gives each document's counts and, for each of its
lines, a hash of the normalised line (lower case, one blank between words). The
rest is relational: documents for each (host, line) are counted with
partial aggregation, so that a line found in a third of all rows is summed
before it is shuffled, and only lines above their limit come back.

Defined cases: a null text counts as empty; a null host is a host of its own.
Rows of one doc_id count once for a line; exact copies under other doc_ids count
each. Without a doc_id, each text counts once. Repeated rows get the same answer
each. Columns of the input other than the named ones are not returned.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(w: shared.Words, h: np.ndarray, size: int = 8) -> np.ndarray:
    """For each word, whether it lies in a window of `size` words found twice or more in its text."""
    n = len(h)
    hit = np.zeros(n, bool)
    if n < size:
        return hit
    key = shared.windows(h, size)
    ok = w.doc[: len(key)] == w.doc[size - 1 :]
    at = np.flatnonzero(ok)
    key = key[at] ^ shared.mixed(w.doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + size, -1)
    return np.cumsum(change)[:n] > 0


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[off[1:]] - total[off[:-1]]


def measure(text: pa.Array) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """Counts of each text, and (row, line number, hash of the normalised line, words) of each line with a word."""
    w = shared.Words(text, lower=False)
    h = w.hashes()
    start_char = (w.data & 0xC0) != 0x80
    # lines: a word's line is the number of newlines before it
    newline = np.cumsum(w.data == 10)
    line = newline[w.start] if len(h) else np.zeros(0, np.int64)
    cut = np.flatnonzero(np.r_[True, (np.diff(line) != 0) | (np.diff(w.doc) != 0)]) if len(h) else np.zeros(0, np.int64)
    stop = np.r_[cut[1:], len(h)]
    doc = w.doc[cut]
    begins = newline[np.minimum(w.off[:-1], max(0, len(w.data) - 1))] if len(w.data) else np.zeros(w.n, np.int64)
    opens = (w.data[np.minimum(w.off[:-1], max(0, len(w.data) - 1))] == 10) if len(w.data) else np.zeros(w.n, bool)
    number = line[cut] - (begins - opens)[doc] if len(cut) else np.zeros(0, np.int64)
    # raw lines, whole bytes between newlines, for repeats in the text itself
    breaks = np.flatnonzero(w.data == 10)
    k = np.searchsorted(breaks, w.start[cut])
    left = np.maximum(np.where(k > 0, breaks[np.maximum(k - 1, 0)] + 1 if len(breaks) else 0, 0), w.off[doc])
    right = np.minimum(np.where(k < len(breaks), breaks[np.minimum(k, len(breaks) - 1)] if len(breaks) else 0, len(w.data)), w.off[doc + 1])
    raw = shared.spans_hash(w.data, left, right) ^ shared.mixed(doc.astype(np.uint64) + np.uint64(1))
    _, once = np.unique(raw, return_index=True)
    dup = np.ones(len(raw), bool)
    dup[once] = False
    # normalised lines: lower-case words in order
    low = shared.Words(text).hashes()
    place = np.arange(len(low)) - np.repeat(cut, stop - cut)
    keyed = shared.mixed(low + shared.mixed(place.astype(np.uint64)))
    norm = shared.mixed(np.add.reduceat(keyed, cut)) if len(cut) else np.zeros(0, np.uint64)
    off_l = np.searchsorted(doc, np.arange(w.n + 1))
    counts = {
        "n_words": np.diff(w.off_w), "word_chars": _sums(w.solid & start_char, w.off), "n_symbols": _sums(_SYMBOLS[w.data], w.off),
        "n_dup_lines": _sums(dup, off_l), "n_repeat_words": _sums(repeated_words(w, h), w.off_w),
    }
    return counts, [off_l, number, norm.view(np.int64), stop - cut]


def _measured(batches):
    for batch in batches:
        for part in shared.pieces(batch):
            text = part.column(1)
            counts, (off, number, norm, words) = measure(text)
            off = pa.array(off, pa.int32())
            lists = [pa.ListArray.from_arrays(off, pa.array(x, pa.int64())) for x in (number, norm, words)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), part.column(3), *(pa.array(counts[c], pa.int64()) for c in _COUNTS), *lists],
                names=["doc_id", "host", "content", *_COUNTS, "line_no", "line_hash", "line_words"],
            )


def line_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", least: int = 20, share: float = 0.02, depleted: float = 0.5, with_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, the counts, removed_lines, removed_words, base_failed and kept.

    A line of a host is removed where over max(least, share * the host's documents)
    of the host's documents have it. kept is false where base_failed is true or
    where over the share `depleted` of the words went with removed lines.
    with_text adds the text without the removed lines.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(host).cast("string").alias("host"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("content"))
    kind = dict(docs.dtypes)[key]
    found = rows.mapInArrow(_measured, f"doc_id {kind}, host string, content long, {', '.join(f'{c} long' for c in _COUNTS)}, line_no array<long>, line_hash array<long>, line_words array<long>")
    found = shared.written(found, "lines")
    lines = found.select("doc_id", "host", "content", F.explode(F.arrays_zip("line_no", "line_hash", "line_words")).alias("l")).select("doc_id", "host", "content", "l.*")
    document = ["doc_id", F.when(F.col("doc_id").isNull(), F.col("content")).alias("unnamed")]
    often = lines.groupBy("host", "line_hash", *document).agg(F.lit(1).alias("one")).groupBy("host", "line_hash").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > least)
    hosts = found.groupBy("host", *document).agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("host_docs"))
    often = often.join(hosts, often["host"].eqNullSafe(hosts["host"])).where(F.col("n_docs") > F.col("host_docs") * share).select(often["host"].alias("h"), F.col("line_hash").alias("lh"))
    # equal rows fold into one, and so count once for what they lose
    gone = lines.join(often, lines["host"].eqNullSafe(often["h"]) & (lines["line_hash"] == often["lh"]), "left_semi")
    gone = gone.groupBy("doc_id", "host", "content", "line_no").agg(F.first("line_words").alias("line_words"))
    gone = gone.groupBy(F.col("doc_id").alias("d"), F.col("host").alias("h"), F.col("content").alias("c")).agg(F.sum("line_words").alias("removed_words"), F.collect_set("line_no").alias("removed_lines"))
    base = found.drop("line_no", "line_hash", "line_words")
    out = base.join(gone, base["doc_id"].eqNullSafe(gone["d"]) & base["host"].eqNullSafe(gone["h"]) & (base["content"] == gone["c"]), "left")
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0))).withColumn("removed_lines", F.array_sort(F.coalesce("removed_lines", F.array().cast("array<long>"))))
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= F.col("n_words") * depleted))
    out = out.select("doc_id", "host", "content", *_COUNTS, "removed_words", "removed_lines", "base_failed", "kept")
    if with_text:
        keyed = rows.select(F.col("doc_id").alias("d"), F.col("host").alias("h"), F.col("content").alias("c"), "text").dropDuplicates(["d", "h", "c"])
        out = out.join(keyed, out["doc_id"].eqNullSafe(keyed["d"]) & out["host"].eqNullSafe(keyed["h"]) & (out["content"] == keyed["c"]), "left").drop("d", "h", "c")
        kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("removed_lines", i.cast("long")))
        out = out.withColumn("text", F.array_join(kept, "\n"))
    return out.drop("content")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_rules(docs).select("doc_id", *_COUNTS, "base_failed", "kept", "removed_words")
