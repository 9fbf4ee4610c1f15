"""Repair of conversations by the cheapest edits, with time-major tensors.

A conversation's role initials should read ``(s?(ua)+)?``.  An automaton of four states reads them: START, after a
system row, after a user row, after an assistant row; it may end in the first and the last.  Each row is kept
(0), given the role user or assistant (1) or deleted (2); empty user and assistant rows may be put in anywhere (5 each).
Blank and repeated rows must go, and a truncated row that stays costs 5 more.  The cheapest edits, written by their
initials D, I, K, R in order, are a string; of several the least one in ASCII order counts.

Rows become codes (role and fault).  A conversation's codes are cut into pieces of at most ``PIECE`` rows, and pieces of
like length make one tensor of time x pieces, over which NumPy runs one step for each place, last to first, storing
what each state has yet to pay.  Then edits are traced first to last, all pieces at once: of the edits that pay no more than
that, the least letter.  A letter leads from a state to one state only, so the trace needs no search.

A conversation of many pieces is not one task's.  What a piece does to the costs behind it is a 4 x 4 matrix over
(min, +), what it does to the state in front of it a map of 4 states; both compose, so runs of ``FAN`` pieces are put together,
then runs of those, and the costs and states at the borders come back down the same way.

Edge cases: nulls in conv_id, turn, role or text count as one space (a null conv_id is one conversation).  Rows of one turn
come by role, then by the sha256 of their text, so repeated rows and ties have one order.  Unknown roles can only be
replaced or deleted.  Very long texts are read as they are.  Only the four columns are read, so extra ones cannot clash.
An empty table gives no rows.  One cell of a result is as long as its conversation (audit), and a conversation's hash is
taken by one task, which holds a row at a time, as sha256 has to be.
"""

from __future__ import annotations

import hashlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, release, stored
from .op13_manifest import CRC_TABLE, crc_sql

PIECE = 1024
FAN = 256
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAR = np.int64(1) << 40
_SOLID = r"[^\x20\x09-\x0D]"
#: The state that an inserted or renamed row leads to, by the state before it.
_NEXT = np.array([USER, USER, ASSISTANT, USER])
#: The state that a kept row leads to, by its role (system, user, assistant, other) and the state before it; -1: none.
_KEPT = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1] * 4])
#: Costs of ending after the last row, and the rows put in there.
_END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
_END_ROWS = ("", "II", "I", "")
#: A code is 4 * fault + role, with faults 0 none, 1 to delete, 2 truncated; 12 is no row.
_NONE = 12


def _tables() -> tuple[np.ndarray, ...]:
    """By code and state: cost and next state of keeping, cost of renaming, cost of deleting."""
    keep, to, rename = np.full((13, 4), FAR), np.zeros((13, 4), np.int64), np.full((13, 4), FAR)
    drop = np.full((13, 4), DELETE, np.int64)
    for fault in (0, 2):
        for role in range(4):
            known = _KEPT[role] >= 0
            keep[4 * fault + role] = np.where(known, TRUNCATED * (fault == 2), FAR)
            to[4 * fault + role] = np.where(known, _KEPT[role], 0)
            rename[4 * fault + role] = ROLE + TRUNCATED * (fault == 2)
    drop[_NONE] = 0  # what is not there goes for nothing
    return keep, to, rename, drop


_KEEP, _TO, _RENAME, _DROP = _tables()


def tensor(codes: list[str]) -> np.ndarray:
    """time x pieces; short pieces end in places without a row."""
    out = np.full((max(map(len, codes), default=0), len(codes)), _NONE, np.int64)
    for j, c in enumerate(codes):
        out[: len(c), j] = np.frombuffer(c.encode(), np.uint8) - 97
    return out


def backward(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """costs[t, piece, state] yet to pay before the row at t (rows may be put in first), given those at the end (piece, state).

    Behind the last axis of ``end`` there may be more: each of its slices is a case of its own.
    """
    steps = len(codes)
    costs = np.empty((steps + 1, *end.shape), np.int64)
    costs[steps] = end
    more = (..., *[None] * (end.ndim - 2))
    for t in range(steps - 1, -1, -1):
        code, after = codes[t], costs[t + 1]
        kept = np.take_along_axis(after, np.broadcast_to(_TO[code][more], after.shape), 1) + _KEEP[code][more]
        now = np.minimum(np.minimum(kept, after[:, _NEXT] + _RENAME[code][more]), after + _DROP[code][more])
        there = (code != _NONE)[(slice(None), None, *[None] * (end.ndim - 2))]
        once, twice = now[:, _NEXT] + INSERT, now[:, _NEXT[_NEXT]] + 2 * INSERT
        costs[t] = np.where(there, np.minimum(now, np.minimum(once, twice)), now)
    return np.minimum(costs, FAR)


def trace(codes: np.ndarray, costs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """edits[t, piece] (letter of the row's edit, plus 128 for each row put in before it) and the last state, from the states at the front."""
    steps, n = codes.shape
    edits, all_of = np.zeros((steps, n), np.int64), np.arange(n)
    for t in range(steps):
        code, after = codes[t], costs[t + 1]
        due = costs[t][all_of, state]
        before = np.zeros(n, np.int64)
        open_ = code != _NONE
        letter = np.zeros(n, np.int64)
        for _ in range(3):
            drop = open_ & (after[all_of, state] + _DROP[code, state] == due)
            to, more = _TO[code, state], _NEXT[state]
            # a row put in comes before K and R: the costs after it are those before this same row
            put = open_ & ~drop & (costs[t][all_of, more] + INSERT == due)
            keep = open_ & ~drop & ~put & (after[all_of, to] + _KEEP[code, state] == due)
            rename = open_ & ~drop & ~put & ~keep
            letter = np.where(drop, ord("D"), np.where(keep, ord("K"), np.where(rename, ord("R"), letter)))
            state = np.where(keep, to, np.where(put | rename, more, state))
            due, before = due - INSERT * put, before + put
            open_ = put
        edits[t] = letter + 128 * before
    return edits, state


# -- damage and faults -----------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that tests of the repair are made of, by crc32 of conv_id:turn."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(some("text"), ".!?", "")).otherwise(some("text"))
    twice = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(some("role")).alias("role"), text.alias("text"), twice).drop("copy")


def _key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("c"), conv.cast("string")), F.lit("n"))


def coded(rows: DataFrame) -> DataFrame:
    """key, turn, role, hash, pos, piece, code of each row: its role and fault as a letter."""
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    last = F.regexp_extract("text", f"({_SOLID})[\\x20\\x09-\\x0D]*\\z", 1)
    own = F.when(last == "", 1).when(last.rlike("[.!?]"), 0).otherwise(2)
    narrow = rows.select(_key(F.col("conv_id")).alias("key"), "turn", "role", F.sha2("text", 256).alias("hash"), role.alias("kind"), own.alias("own"))
    placed = ranked(narrow, ["key"], ["turn", "role", "hash"]).withColumn("piece", F.expr(f"pos div {PIECE}"))
    # the first of each row's equals: of its piece, then of the pieces, so that a row with many equals is no single task's
    near = placed.groupBy("key", "role", "hash", "piece").agg(F.min("pos").alias("first"))
    first = near.groupBy("key", "role", "hash").agg(F.min("first").alias("first"), F.count("*").alias("pieces"))
    far = near.select("key", "role", "hash", "piece").join(first, ["key", "role", "hash"]).drop("pieces")
    met = placed.join(far, ["key", "role", "hash", "piece"])
    fault = F.when(F.col("own") == 1, 1).when(F.col("pos") > F.col("first"), 3).otherwise(F.col("own"))
    return met.select("key", "turn", "role", "hash", "pos", "piece", F.chr(97 + 4 * fault + F.col("kind")).alias("code"))


def pieces(rows: DataFrame) -> DataFrame:
    """key, piece, codes, and turn, role, hash of its first row; codes have 'm'.. for repeated rows (fault 3)."""
    g = rows.groupBy("key", "piece").agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("run"), F.min(F.struct("pos", "turn", "role", "hash")).alias("f"))
    return g.select("key", "piece", F.array_join("run.code", "").alias("codes"), F.col("f.turn").alias("turn"), F.col("f.role").alias("role"), F.col("f.hash").alias("hash"))


def _plain(codes: str) -> str:
    """Repeated rows are to be deleted, as blank ones."""
    return codes.translate({97 + 12 + r: 97 + 4 + r for r in range(4)})


def _buckets(codes: list[str], most: int = 1 << 21):
    """Indices of pieces of like length, in tensors of bounded size."""
    order = sorted(range(len(codes)), key=lambda i: len(codes[i]))
    i = 0
    while i < len(order):
        top, j = len(codes[order[i]]), i
        while j < len(order) and len(codes[order[j]]) <= max(8, 1.25 * top) and (j - i) * len(codes[order[j]]) < most:
            j += 1
        yield order[i : max(j, i + 1)]
        i = max(j, i + 1)


# -- pieces of long conversations --------------------------------------------------------------------


def _matrices(batches):
    """What the costs at a piece's end become at its front, for a cost of 0 in one end state each."""
    for batch in batches:
        codes = [_plain(c) for c in batch.column("codes").to_pylist()]
        out = np.empty((len(codes), 4, 4), np.int64)
        for some in _buckets(codes):
            unit = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, FAR), (len(some), 4, 4))
            out[some] = backward(tensor([codes[i] for i in some]), unit)[0]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("piece"), pa.array(list(out.reshape(-1, 16)), pa.list_(pa.int64()))], names=["key", "at", "does"])


def _after(does: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Costs in front of a piece, from those behind it."""
    return np.minimum((does.reshape(4, 4) + behind).min(axis=1), FAR)


def _spread(steps: DataFrame, join, carry, start, backwards: bool) -> DataFrame:
    """key, at, value: what holds behind (or in front of) each step (key, at, does) of a chain, from ``start`` at its end (or front).

    Runs of FAN steps become steps of a shorter chain by ``join``, until one run is left; values come back down by ``carry``.
    """
    chain = [steps]
    turned = (lambda x: x[::-1]) if backwards else list

    def shorter(key, table):
        whole = None
        for does in turned(table.sort_by("at").column("does").to_pylist()):
            whole = np.array(does) if whole is None else join(np.array(does), whole)
        return pa.table({"key": pa.array([key[0].as_py()]), "at": pa.array([key[1].as_py()], pa.int64()), "does": pa.array([whole.tolist()], pa.list_(pa.int64()))})

    def down(key, table):
        table = table.sort_by("at")
        value, values = np.array(table.column("value")[0].as_py() or start), []
        for does in turned(table.column("does").to_pylist()):
            values.append(value)
            value = carry(np.array(does), value)
        return pa.table({"key": table.column("key"), "at": table.column("at"), "value": pa.array([v.tolist() for v in turned(values)], pa.list_(pa.int64()))})

    while chain[-1].agg(F.max("at")).first()[0] >= FAN:
        chain.append(stored(chain[-1].groupBy("key", F.expr(f"at div {FAN}").alias("up")).applyInArrow(shorter, "key string, at bigint, does array<bigint>")))
    above = None
    for level in reversed(chain):
        held = level.withColumn("up", F.expr(f"at div {FAN}"))
        if above is None:
            held = held.withColumn("value", F.lit(None).cast("array<bigint>"))
        else:
            held = held.join(above.select("key", F.col("at").alias("up"), "value"), ["key", "up"])
        above = stored(held.groupBy("key", "up").applyInArrow(down, "key string, at bigint, value array<bigint>"))
    release(*chain[1:])
    return above


def _join_costs(front: np.ndarray, behind: np.ndarray) -> np.ndarray:
    a, b = front.reshape(4, 4), behind.reshape(4, 4)
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), FAR).ravel()


def borders(parts: DataFrame) -> DataFrame:
    """key, piece, behind (costs, 4) and front (state) of every piece of conversations that have several."""
    many = parts.join(parts.where("piece = 1").select("key"), "key", "left_semi")
    costs = stored(many.select("key", "piece", "codes").mapInArrow(_matrices, "key string, at bigint, does array<bigint>"))
    behind = _spread(costs, _join_costs, _after, _END.tolist(), True)
    met = many.join(behind.select("key", F.col("at").alias("piece"), F.col("value").alias("behind")), ["key", "piece"])

    def maps(batches):
        for batch in batches:
            codes, end = [_plain(c) for c in batch.column("codes").to_pylist()], batch.column("behind").to_pylist()
            out = np.empty((len(codes), 4), np.int64)
            for some in _buckets(codes):
                t = tensor([codes[i] for i in some])
                costs = backward(t, np.array([end[i] for i in some]))
                for s in range(4):
                    out[some, s] = trace(t, costs, np.full(len(some), s))[1]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("piece"), pa.array(list(out), pa.list_(pa.int64()))], names=["key", "at", "does"])

    states = stored(met.select("key", "piece", "codes", "behind").mapInArrow(maps, "key string, at bigint, does array<bigint>"))
    # a state is one number; as a list of one it travels as the costs do
    front = _spread(states, lambda new, old: new[old], lambda does, state: does[state], [START], False)
    found = behind.withColumnRenamed("value", "behind").join(front.select("key", "at", F.col("value")[0].alias("front")), ["key", "at"])
    return found.select("key", F.col("at").alias("piece"), "behind", "front")


# -- repair ----------------------------------------------------------------------------------------


def edited(parts: DataFrame) -> DataFrame:
    """parts with edits (for each row the letter of its edit, behind an I for each row put in before), last (state) and cost (from the front on)."""
    known = parts.join(borders(parts), ["key", "piece"], "left") if parts.where("piece = 1").limit(1).count() else parts.withColumn("behind", F.lit(None).cast("array<bigint>")).withColumn("front", F.lit(None).cast("bigint"))

    def run(batches):
        for batch in batches:
            codes = [_plain(c) for c in batch.column("codes").to_pylist()]
            end = np.array([e or _END.tolist() for e in batch.column("behind").to_pylist()], np.int64).reshape(-1, 4)
            front = np.array([s or 0 for s in batch.column("front").to_pylist()], np.int64)
            edits, last, cost = [""] * len(codes), np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
            for some in _buckets(codes):
                t = tensor([codes[i] for i in some])
                costs = backward(t, end[some])
                found, last[some] = trace(t, costs, front[some])
                cost[some] = costs[0, np.arange(len(some)), front[some]]
                for j, i in enumerate(some):
                    edits[i] = "".join("I" * (e >> 7) + chr(e & 127) for e in found[: len(codes[i]), j].tolist())
            cols = {n: batch.column(n) for n in ("key", "piece", "turn", "role", "hash", "codes")} | {"edits": pa.array(edits), "last": pa.array(last), "cost": pa.array(cost)}
            yield pa.RecordBatch.from_pydict(cols)

    kinds = dict(parts.dtypes)
    schema = f"key string, piece bigint, turn {kinds['turn']}, role string, hash string, codes string, edits string, last bigint, cost bigint"
    return known.select("key", "piece", "turn", "role", "hash", "codes", "behind", "front").mapInArrow(run, schema)


class _Conversation:
    """What is known of one conversation as its rows pass by, in order."""

    def __init__(self, conv_id):
        self.conv_id, self.heads, self.codes, self.edits, self.at, self.state, self.cost = conv_id, deque(), "", iter(""), 0, START, None
        self.audit, self.sha, self.any = [], hashlib.sha256(), False
        self.turns, self.low, self.turn, self.initial, self.counts = 0, None, None, None, [0] * 4

    def _say(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def _put_in(self) -> None:
        self.state = int(_NEXT[self.state])
        self._say("user" if self.state == USER else "assistant", "")

    def head(self, codes: str, edits: str, cost: int) -> None:
        self.heads.append((codes, edits))
        self.cost = cost if self.cost is None else self.cost

    def row(self, turn, role: str, text: str) -> None:
        if self.at == len(self.codes):
            self.codes, edits = self.heads.popleft()
            self.edits, self.at = iter(edits), 0
            self.audit.append(edits)
        code = ord(self.codes[self.at]) - 97
        self.at += 1
        if turn is not None:
            self.turns += self.turn is None or turn != self.turn
            self.low = turn if self.low is None else self.low
            self.turn = turn
        self.counts[0] += code // 4 == 1
        self.counts[1] += code // 4 == 3
        self.counts[2] += code // 4 == 2
        initial = role[:1]
        self.counts[3] += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        for edit in self.edits:
            if edit != "I":
                break
            self._put_in()
        if edit == "K":
            self.state = int(_KEPT[code % 4][self.state])
            self._say(role, text)
        elif edit == "R":
            self.state = int(_NEXT[self.state])
            self._say("user" if self.state == USER else "assistant", text)

    def done(self) -> tuple:
        for x in _END_ROWS[self.state]:
            self.audit.append(x)
            self._put_in()
        gaps = 0 if self.turn is None else self.turn - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.counts, self.cost or 0, "".join(self.audit), self.sha.hexdigest())


_OUT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repaired(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of rows.

    rows: conv_id, turn, role, text.  conversations: conv_ids that have a row even if no row is left of them.
    """
    kind = dict(rows.dtypes)["conv_id"]
    parts = stored(pieces(coded(rows)))
    heads = edited(parts).withColumn("order", F.lit(0))
    texts = rows.select(_key(F.col("conv_id")).alias("key"), "conv_id", "turn", "role", F.sha2("text", 256).alias("hash"), "text", F.lit(1).alias("order"))
    every = (conversations if conversations is not None else rows).select("conv_id").distinct()
    # in front of a conversation its id, and in front of a piece's first row the piece's edits
    names = every.select(_key(F.col("conv_id")).alias("key"), "conv_id", F.lit(-1).alias("order"))
    both = texts.withColumn("rank", F.lit(1)).unionByName(heads.withColumn("rank", F.lit(1)), allowMissingColumns=True).unionByName(names.withColumn("rank", F.lit(0)), allowMissingColumns=True)
    dealt = both.repartition("key").sortWithinPartitions("key", "rank", "turn", "role", "hash", "order", "piece")
    columns = ["conv_id", "order", "turn", "role", "text", "codes", "edits", "cost"]

    def run(batches):
        now = None

        def told(done):
            names = ["conv_id", *_OUT, "audit", "repaired_sha256"]
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], schema.field(0).type if i == 0 else pa.int64() if i < 7 else pa.string()) for i in range(9)], names=names)

        schema = None
        for batch in batches:
            schema, done = schema or batch.schema, []
            for conv_id, order, turn, role, text, codes, edits, cost in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if order == 1:
                    now.row(turn, role, text)
                elif order == 0:
                    now.head(codes, edits, cost)
                else:
                    if now:
                        done.append(now.done())
                    now = _Conversation(conv_id)
            if done:
                yield told(done)
        if now:
            yield told([now.done()])

    return dealt.select(*columns).mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} bigint' for c in _OUT)}, audit string, repaired_sha256 string")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repaired(damaged(rows), rows)


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""WITH RECURSIVE {CRC_TABLE},
r AS (SELECT conv_id, coalesce('c' || conv_id, 'n') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations, crc_table),
d AS (SELECT key, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM r, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) x(copy)),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos, rtrim(text, {_SPACES}) AS cut, left(role, 1) AS i FROM d),
f AS (SELECT *, CASE WHEN cut = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(i) OVER (PARTITION BY key ORDER BY pos) AS before, count(*) OVER (PARTITION BY key) AS n FROM o),
moves(letter, role, q, z, cost) AS (VALUES ('D', '', 0, 0, 2), ('D', '', 1, 1, 2), ('D', '', 2, 2, 2), ('D', '', 3, 3, 2), ('R', '', 0, 2, 1), ('R', '', 1, 2, 1), ('R', '', 3, 2, 1), ('R', '', 2, 3, 1), ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'u', 3, 2, 0), ('K', 'a', 2, 3, 0)),
ins(q, k, z) AS (VALUES (0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (0, 1, 2), (1, 1, 2), (3, 1, 2), (2, 1, 3), (0, 2, 3), (1, 2, 3), (2, 2, 2), (3, 2, 3)),
back(key, pos, q, cost, audit) AS (SELECT key, n, e.q, e.cost, e.audit FROM (SELECT DISTINCT key, n FROM f), (VALUES (0, 0, ''), (1, 10, 'II'), (2, 5, 'I'), (3, 0, '')) e(q, cost, audit)
  UNION ALL SELECT key, p, q, b.c, b.a FROM (SELECT f.key, f.pos - 1 AS p, ins.q, min(struct_pack(c := back.cost + m.cost + 5 * ins.k + CASE WHEN f.fault = 'truncated' AND m.letter <> 'D' THEN 5 ELSE 0 END, a := repeat('I', ins.k) || m.letter || back.audit)) AS b
    FROM back JOIN f ON f.key = back.key AND f.pos = back.pos JOIN moves m ON m.z = back.q AND (m.letter <> 'K' OR m.role = f.i) AND (m.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate')) JOIN ins ON ins.z = m.q GROUP BY f.key, f.pos, ins.q)),
best AS (SELECT key, cost, audit FROM back WHERE pos = 0 AND q = 0),
l AS (SELECT key, k, audit[k] AS letter, length(replace(left(audit, CAST(k AS BIGINT)), 'I', '')) AS pos FROM best, range(1, length(audit) + 1) t(k)),
w AS (SELECT l.key, l.k, l.letter, f.role, f.text, row_number() OVER (PARTITION BY l.key ORDER BY l.k) AS j, first_value(letter = 'K' AND f.i = 's') OVER (PARTITION BY l.key ORDER BY l.k) AS sys FROM l LEFT JOIN f ON f.key = l.key AND f.pos = l.pos AND l.letter <> 'I' WHERE letter <> 'D'),
t AS (SELECT key, string_agg((CASE WHEN letter = 'K' THEN role WHEN (j - CAST(sys AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS repaired FROM w GROUP BY key),
c AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY key)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, key FROM r) LEFT JOIN c USING (key) LEFT JOIN best USING (key) LEFT JOIN t USING (key)"""
