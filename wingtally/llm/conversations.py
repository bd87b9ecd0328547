"""Repair of conversation structure at least cost, by layers of bits.

A conversation is right where the initials of its roles read `(s?(ua)+)?`. Rows
may be kept (0), get another role (1) or go (2; blank rows and repeats must),
and empty rows may be put in (5); a row that is cut off in mid-sentence costs 5
where it stays. For each turn there is one word of bits: bit 4k + q says whether
the end can be reached from state q of the grammar at a cost of at most k above
the turn's least. A turn's word follows from the next turn's by shifts, one for
each edit: the edit's cost moves its layers up, its role moves its states. The
first layer that holds the start is the cost; from the first turn on the bits
then show, at each turn, the ASCII-least edit that keeps to that cost.

Sixteen layers are exact. From a state, a user turn can be put in after start, s
or a, and an assistant turn after u, so no state is over 10 above state a; state
a costs at most 2 more than start (a kept s turns into a deleted one), nothing
more than s, and 5 more than u. So no state is over 12 above the least one, and
all layers from the thirteenth on are full.

Only one byte for each turn, its role's initial and fault, meets in a group: in
blocks of `BLOCK` turns first, then a conversation's blocks in one row, as
long as the audit that the row answers with. Texts are dealt out by conversation
and turn, so that one huge conversation spreads over many tasks, and joined with
their edits by position; they come together only to be hashed, as a sorted
stream through one SHA-256, whose definition has no other order; nothing is
held there beside the hash.

Defined cases: a null role or text is one space, so such a text is blank and
such a role must change or go. Null turns stand first, turns of one number by
role and then text. A null conv_id is a conversation of its own. Repeated rows
are repeats within their conversation. Long texts and conversations are taken
whole. Other columns of the input are not read, so names cannot clash. An empty
table gives an empty result; a conversation of which nothing is left has zeros.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Turns that are gathered to a string in one group.
BLOCK = 4096
DELETE, REROLE, INSERT, CUT_OFF = 2, 1, 5, 5
_BLANKS = r"\x20\x09-\x0D"
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with one of five faults in a quarter of the rows, chosen by the checksum of `conv_id:turn`."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fault.alias("fault")).where("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


# ------------------------------------------------------------------ layers

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_LAYERS = 16
_FULL = (1 << 4 * _LAYERS) - 1
_ONE = sum(1 << 4 * k for k in range(2 * _LAYERS))
#: From which states a role's turn may follow, and to which state it leads.
_INTO = {"s": ((_START,), _SYSTEM), "u": ((_START, _SYSTEM, _ASSISTANT), _USER), "a": ((_USER,), _ASSISTANT)}
#: The state after an own turn put in, or after a change of role.
_NEXT = [_USER, _USER, _ASSISTANT, _USER]
_ROLE = ["u", "u", "a", "u"]
_GOOD, _BLANK, _REPEAT, _CUT = range(4)


def _came(word: int, role: str) -> int:
    """Bits of the states from which a turn of that role leads to a set bit."""
    sources, target = _INTO[role]
    bits = word >> target & _ONE
    return sum(bits << q for q in sources)


def _moved(word: int) -> int:
    return _came(word, "u") | _came(word, "a")


def _closed(word: int) -> int:
    """With turns put in; two are enough, since they lead back."""
    for _ in range(2):
        word |= _moved(word) << 4 * INSERT
    return word


class Layers:
    """Words of layers by number; each (word, kind of turn) leads to one word and raises the least cost by so much."""

    def __init__(self):
        self.words: list[int] = []
        self.levels: list[tuple[int, ...]] = []
        self._number: dict[int, int] = {}
        self.back: dict[tuple[int, int], tuple[int, int]] = {}
        accepted = (1 << _START) | (1 << _ASSISTANT)
        self.end, _ = self._named(_closed(sum(accepted << 4 * k for k in range(2 * _LAYERS))))

    def _named(self, word: int) -> tuple[int, int]:
        rise = ((word & -word).bit_length() - 1) // 4
        word = word >> 4 * rise & _FULL
        if word not in self._number:
            self._number[word] = len(self.words)
            self.words.append(word)
            self.levels.append(tuple(next(k for k in range(_LAYERS) if word >> 4 * k + q & 1) for q in range(4)))
        return self._number[word], rise

    def before(self, number: int, kind: int) -> tuple[int, int]:
        known = self.back.get((number, kind))
        if known is None:
            word = self.words[number] | _FULL << 4 * _LAYERS
            role, fault = "sua-"[kind >> 2], kind & 3
            out = word << 4 * DELETE
            if fault not in (_BLANK, _REPEAT):
                extra = CUT_OFF * (fault == _CUT)
                out |= _moved(word) << 4 * (REROLE + extra)
                if role != "-":
                    out |= _came(word, role) << 4 * extra
            known = self.back[number, kind] = self._named(_closed(out))
        return known

    def repair(self, kinds: bytes) -> tuple[int, str, list[str]]:
        """Cost, audit, and what happens at each turn and behind the last: turns put in (u, a), then K, D, or the role given (U, A)."""
        n = len(kinds)
        at, number, least = array("L", [self.end]) * (n + 1), self.end, 0
        for i in range(n - 1, -1, -1):
            number, rise = self.before(number, kinds[i])
            at[i] = number
            least += rise
        state, cost = _START, least + self.levels[number][_START]
        audit, steps = [], []
        for i in range(n + 1):
            put, here = "", self.levels[at[i]]
            while True:
                left, edit = here[state], ""
                if i < n:
                    kind = kinds[i]
                    role, fault, then = "sua-"[kind >> 2], kind & 3, self.levels[at[i + 1]]
                    left_after = left + self.back[at[i + 1], kind][1]
                    if then[state] + DELETE == left_after:
                        edit = "D"
                elif left == 0:
                    break
                if not edit and here[_NEXT[state]] + INSERT == left:
                    put += _ROLE[state]
                    audit.append("I")
                    state = _NEXT[state]
                    continue
                if not edit:
                    extra = CUT_OFF * (fault == _CUT)
                    if role != "-" and state in _INTO[role][0] and then[_INTO[role][1]] + extra == left_after:
                        edit, state = "K", _INTO[role][1]
                    else:
                        edit, state, role = "R", _NEXT[state], _ROLE[state]
                audit.append(edit)
                put += role.upper() if edit == "R" else edit
                break
            steps.append(put)
        return cost, "".join(audit), steps


_SCHEMA = f"{', '.join(f'{c} long' for c in _COUNTS)}, audit string, tail string, edits array<struct<first:long,steps:string>>"
_EDITS = pa.list_(pa.struct([("first", pa.int64()), ("steps", pa.string())]))


def _repaired(batches):
    """A conversation's blocks in order: what is wrong with it and how it is repaired."""
    layers = Layers()
    for batch in batches:
        out = {c: [] for c in (*_COUNTS, "audit", "tail", "edits")}
        for blocks in batch.column(1):
            blocks = [b.as_py() for b in blocks.values]
            kinds = bytes(ord(c) - 65 for b in blocks for c in b["kinds"])
            cost, audit, steps = layers.repair(kinds)
            for name, fault in (("blank", _BLANK), ("duplicate", _REPEAT), ("truncated", _CUT)):
                out[name].append(sum(kinds.count(4 * role + fault) for role in range(4)))
            roles = "".join("sua-"[k >> 2] for k in kinds)
            out["illegal"].append(len(roles) - 1 - sum(pair in ("su", "ua", "au") for pair in map("".join, zip(roles, roles[1:], strict=False))))
            numbered = [b for b in blocks if b["n_turns"]]
            distinct = sum(b["n_turns"] for b in numbered) - sum(a["high"] == b["low"] for a, b in zip(numbered, numbered[1:], strict=False))
            out["gaps"].append(numbered[-1]["high"] - numbered[0]["low"] + 1 - distinct if numbered else 0)
            out["cost"].append(cost)
            out["audit"].append(audit)
            out["tail"].append(steps[-1])
            edits, i = [], 0
            for b in blocks:
                edits.append({"first": b["first"], "steps": "".join(steps[i : i + len(b["kinds"])])})
                i += len(b["kinds"])
            out["edits"].append(edits)
        kinds_of = {c: pa.int64() for c in _COUNTS} | {"audit": pa.string(), "tail": pa.string(), "edits": _EDITS}
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[c], kinds_of[c]) for c in out)], names=["conv_id", *out])


def _hashed(batches):
    """SHA-256 of each conversation's pieces joined by newlines; rows come sorted by conversation and place."""
    now, digest = None, None
    for batch in batches:
        ids, done = batch.column(0).to_pylist(), ([], [])
        for conv, piece in zip(ids, batch.column(2), strict=True):
            if digest is None or conv != now:
                if digest is not None:
                    done[0].append(now)
                    done[1].append(digest.hexdigest())
                now, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(piece.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(done[0], batch.schema.field(0).type), pa.array(done[1], pa.string())], names=["conv_id", "sha"])
        kind = batch.schema.field(0).type
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()])], names=["conv_id", "sha"])


def _spelled(op: Column, role: Column, text: Column) -> Column:
    """The piece that an edit leaves: turns put in, then the turn itself."""
    put = F.transform(F.filter(F.split(op, ""), lambda c: c.isin("u", "a")), lambda c: F.when(c == "u", "user:").otherwise("assistant:"))
    last = F.substring(op, -1, 1)
    own = F.when(last == "K", F.concat(role, F.lit(":"), text)).when(last == "U", F.concat(F.lit("user:"), text)).when(last == "A", F.concat(F.lit("assistant:"), text))
    return F.array_join(F.concat(put, F.array_compact(F.array(own))), "\n")


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (conv_id, turn, role, text): faults, cost, audit and edits by conversation, and the repaired turns.

    The repaired turns have conv_id, at (their order), and piece: `role:text` lines."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)["conv_id"]
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    rows = rows.repartitionByRange(shared.tasks(spark), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = shared.written(rows, "turns")
    initial = F.substring("role", 1, 1)
    light = rows.select(
        "at", "conv_id", "turn", F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("role"),
        F.when(~F.col("text").rlike(f"[^{_BLANKS}]"), _BLANK).alias("blank"), F.when(F.col("text").rlike(rf"[^{_BLANKS}.!?][{_BLANKS}]*\z"), _CUT).otherwise(_GOOD).alias("cut"),
        F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)).alias("content"),
    )
    firsts = light.groupBy("conv_id", "content").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    light = light.drop("content").join(firsts, "at", "left")
    fault = F.coalesce(F.col("blank"), F.when(F.col("first").isNull(), _REPEAT), F.col("cut"))
    light = light.select("at", "conv_id", "turn", F.char(65 + 4 * F.col("role") + fault).alias("kind"))
    blocks = light.groupBy("conv_id", F.floor(F.col("at") / BLOCK).alias("block")).agg(
        F.min("at").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "kind"))), lambda x: x["kind"]), "").alias("kinds"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.array_distinct(F.collect_list("turn"))).alias("n_turns"),
    )
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "first", "kinds", "low", "high", "n_turns"))).alias("blocks"))
    plan = shared.written(whole.mapInArrow(_repaired, f"conv_id {kind}, {_SCHEMA}"), "repairs")
    steps = plan.select(F.explode("edits").alias("e")).select("e.first", F.posexplode(F.regexp_extract_all("e.steps", F.lit("[ua]*[KDUA]"), F.lit(0))).alias("place", "op"))
    steps = steps.where("op != 'D'").select((F.col("first") + F.col("place")).alias("at"), "op")
    turns = rows.join(steps, "at").select("conv_id", "at", _spelled(F.col("op"), F.col("role"), F.col("text")).alias("piece"))
    tail = plan.where("tail != ''").select("conv_id", F.lit(2**63 - 1).alias("at"), _spelled(F.concat("tail", F.lit("D")), F.lit(""), F.lit("")).alias("piece"))
    return plan, turns.unionByName(tail)


def report(rows: DataFrame, all_rows: DataFrame) -> DataFrame:
    """Per conv_id of all_rows: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of its conversation in rows."""
    kind = dict(rows.dtypes)["conv_id"]
    plan, turns = repaired(rows)
    sha = turns.repartition(shared.tasks(rows.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id"), F.col("at")).mapInArrow(_hashed, f"conv_id {kind}, sha string")
    plan, sha = plan.withColumnRenamed("conv_id", "c"), sha.withColumnRenamed("conv_id", "d")
    out = all_rows.select("conv_id").distinct()
    out = out.join(plan, out["conv_id"].eqNullSafe(plan["c"]), "left")
    out = out.join(sha, out["conv_id"].eqNullSafe(sha["d"]), "left")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return report(damaged(rows), rows)


ORACLE = r"""
with recursive crc as (select list_transform(range(256), lambda n: list_reduce([n, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tbl),
keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(4294967295, list_reduce(list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda c: cast(ascii(c) as bigint)),
      lambda a, b: xor(a >> 8, tbl[cast((xor(a, b) & 255) + 1 as integer)]), cast(4294967295 as bigint))) % 20 as fault
  from conversations, crc),
damaged as (
  select conv_id, turn, case fault when 4 then 'user' else role end as role, case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from keyed, (select unnest([0, 1]) as copy) where fault <> 0 and (copy = 0 or fault = 3)),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, left(role, 1) as r from damaged),
marked as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd'
    when regexp_matches(text, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*$') then 't' else '' end as fault, lag(r) over (partition by conv_id order by i) || r as pair
  from numbered),
stats as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
    count(*) filter (fault = 't') as truncated, count(*) filter (pair not in ('su', 'ua', 'au') and i > 1) as illegal, max(i) as n
  from marked group by conv_id),
walk as (
  select conv_id, n + 1 as i, [{'c': 0, 'a': '', 't': []::varchar[]}, {'c': 10, 'a': 'II', 't': ['user:', 'assistant:']}, {'c': 5, 'a': 'I', 't': ['assistant:']}, {'c': 0, 'a': '', 't': []::varchar[]}] as h from stats
  union all
  select conv_id, i, list_transform([1, 2, 3, 4], lambda q: list_sort([g[q], {'c': g[nxt[q]].c + 5, 'a': 'I' || g[nxt[q]].a, 't': list_concat([roles[q] || ':'], g[nxt[q]].t)}])[1]) from (
  select conv_id, i, nxt, roles, list_transform([1, 2, 3, 4], lambda q: list_sort([f[q], {'c': f[nxt[q]].c + 5, 'a': 'I' || f[nxt[q]].a, 't': list_concat([roles[q] || ':'], f[nxt[q]].t)}])[1]) as g from (
  select m.conv_id, m.i, [3, 3, 4, 3] as nxt, ['user', 'user', 'assistant', 'user'] as roles, list_transform([1, 2, 3, 4], lambda q: list_sort(list_filter([
      {'c': h[q].c + 2, 'a': 'D' || h[q].a, 't': h[q].t},
      case when m.fault in ('b', 'd') then null else {'c': h[case when q = 3 then 4 else 3 end].c + 1 + case m.fault when 't' then 5 else 0 end, 'a': 'R' || h[case when q = 3 then 4 else 3 end].a,
        't': list_concat([case when q = 3 then 'assistant' else 'user' end || ':' || m.text], h[case when q = 3 then 4 else 3 end].t)} end,
      case when m.fault in ('b', 'd') or not ((m.r = 's' and q = 1) or (m.r = 'u' and q <> 3) or (m.r = 'a' and q = 3)) then null else
        {'c': h[case m.r when 's' then 2 when 'u' then 3 else 4 end].c + case m.fault when 't' then 5 else 0 end, 'a': 'K' || h[case m.r when 's' then 2 when 'u' then 3 else 4 end].a,
        't': list_concat([m.role || ':' || m.text], h[case m.r when 's' then 2 when 'u' then 3 else 4 end].t)} end], lambda o: o is not null))[1]) as f
  from walk w join marked m on m.conv_id is not distinct from w.conv_id and m.i = w.i - 1)))
select o.conv_id, coalesce(s.gaps, 0) as gaps, coalesce(s.blank, 0) as blank, coalesce(s.duplicate, 0) as duplicate, coalesce(s.truncated, 0) as truncated, coalesce(s.illegal, 0) as illegal,
  coalesce(w.h[1].c, 0) as cost, coalesce(w.h[1].a, '') as audit, sha256(coalesce(array_to_string(w.h[1].t, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join stats s on s.conv_id is not distinct from o.conv_id left join walk w on w.conv_id is not distinct from o.conv_id and w.i = 1
"""
