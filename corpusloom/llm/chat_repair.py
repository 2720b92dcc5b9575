"""Repair of conversations: the cheapest edits that make roles alternate, by forward Viterbi over four grammar states.

A conversation is well formed when its role initials read (s?(ua)+)?: nothing, or an optional system
turn and then pairs of user and assistant. Each turn is kept (K, 0), given another role (R, 3) or
deleted (D, 4); empty turns can be inserted anywhere (I, 3). Blank and repeated turns have to go; a
truncated turn that stays costs 3 more. Of the cheapest edits those count whose initials are
ASCII-least.

The grammar has four states: nothing yet, after system, after user, after assistant. The forward pass
carries the least (cost, audit) of each state; after every turn the layer is closed under insertions.
At most two of them stand side by side, as a third would return to a state at a higher cost. Audits of
one state and layer are never prefixes of one another unless their costs differ, so the least prefix
stays least whatever follows.

Scale: turns are numbered in their conversation by one range exchange (`ordered`), and cut into
blocks of `block` turns. A block's pass starts from each of the four states, and a chain of these
4 x 4 answers gives the whole conversation's: a conversation of any length is passed in parallel,
and no task holds more than a block of turns. What the chain holds is the audit itself, one character
a turn, which is one value of the result. Repaired turns come from the blocks and their parts of the
audit, in parallel again.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, read
from .ordered import ordered

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
#: Where a turn with this initial leads, if it is kept.
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Where a turn whose role is ours to choose leads.
CHOSEN = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
REROLE = INSERT = TRUNCATED = 3
DELETE = 4
FINE, BLANK, DUPLICATE, CUT = range(4)

SPACE = r"[\x20\x09-\x0D]"
WORDY = r"[^\x20\x09-\x0D]"


def _close(layer: dict) -> dict:
    """The layer with what up to two insertions after it reach."""
    for _ in range(2):
        for state, (cost, audit) in sorted(layer.items()):
            offer = (cost + INSERT, audit + "I")
            if (to := CHOSEN[state]) not in layer or offer < layer[to]:
                layer[to] = offer
    return layer


def first_layer() -> dict:
    return _close({NOTHING: (0, "")})


def next_layer(layer: dict, initial: str, fault: int) -> dict:
    """state -> (cost, audit) after one more turn."""
    out: dict = {}

    def offer(to, cost, audit):
        if to not in out or (cost, audit) < out[to]:
            out[to] = (cost, audit)

    more = TRUNCATED if fault == CUT else 0
    for state, (cost, audit) in layer.items():
        offer(state, cost + DELETE, audit + "D")
        if fault not in (BLANK, DUPLICATE):
            if (state, initial) in KEPT:
                offer(KEPT[state, initial], cost + more, audit + "K")
            offer(CHOSEN[state], cost + REROLE + more, audit + "R")
    return _close(out)


def chained(layer: dict, block: dict) -> dict:
    """A layer carried over a whole block: block maps a state before it to the layer after it."""
    out: dict = {}
    for state, (cost, audit) in layer.items():
        for to, (c, a) in block.get(state, {}).items():
            offer = (cost + c, audit + a)
            if to not in out or offer < out[to]:
                out[to] = offer
    return out


_STEP = "struct<start:int,state:int,cost:bigint,audit:string>"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


class _Block:
    """The pass over up to `block` turns."""

    def __init__(self, key: tuple):
        self.key = key
        self.layers = {NOTHING: first_layer()} if key[1] == 0 else {s: {s: (0, "")} for s in range(4)}
        self.counts, self.n, self.first, self.last = dict.fromkeys(_COUNTS, 0), 0, "", ""
        self.turns, self.low, self.high = 0, None, None

    def add(self, turn, initial: str, fault: int) -> None:
        if fault:
            self.counts[_COUNTS[fault - 1]] += 1
        if self.n:
            self.counts["illegal"] += self.last + initial not in LEGAL
        else:
            self.first = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.n, self.last = self.n + 1, initial
        self.layers = {s: next_layer(layer, initial, fault) for s, layer in self.layers.items()}

    def row(self) -> tuple:
        steps = [{"start": s, "state": t, "cost": c, "audit": a} for s, layer in self.layers.items() for t, (c, a) in layer.items()]
        return (*self.key, self.n, *(self.counts[k] for k in _COUNTS), self.first, self.last, self.turns, self.low, self.high, steps)


def _emit(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.field(k).type) for k in range(len(schema))], schema=schema)


def _pass_blocks(schema: pa.Schema):
    """mapInArrow function over turns sorted by conversation, block and place."""

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for conv, block, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
                if now is None or now.key != (conv, block):
                    if now is not None:
                        rows.append(now.row())
                    now = _Block((conv, block))
                now.add(turn, initial, fault)
            if len(rows) > 1000:
                yield _emit(rows, schema)
                rows = []
        if now is not None:
            yield _emit([*rows, now.row()], schema)

    return run


def _chain(schema: pa.Schema):
    """mapInArrow function over blocks sorted by conversation and block: a row a conversation."""

    def result(conv, layer, c):
        cost, audit = min(layer[s] for s in ENDS if s in layer)
        gaps = c["high"] - c["low"] + 1 - c["turns"] if c["low"] is not None else 0
        return conv, gaps, *(c[k] for k in _COUNTS), cost, audit

    def run(batches):
        conv, layer, c, rows = None, None, None, []
        for batch in batches:
            for b in batch.to_pylist():
                answers: dict = {}
                for s in b["steps"]:
                    answers.setdefault(s["start"], {})[s["state"]] = (s["cost"], s["audit"])
                if b["block"] == 0:
                    if layer is not None:
                        rows.append(result(conv, layer, c))
                    conv, layer, c = b["conv"], answers[NOTHING], b
                    continue
                layer = chained(layer, answers)
                for k in _COUNTS:
                    c[k] += b[k]
                c["illegal"] += c["last"] + b["first"] not in LEGAL
                c["last"] = b["last"]
                if b["low"] is not None:
                    c["turns"] += b["turns"] - (b["low"] == c["high"])
                    c["low"], c["high"] = b["low"] if c["low"] is None else c["low"], b["high"]
            if len(rows) > 1000:
                yield _emit(rows, schema)
                rows = []
        if layer is not None:
            yield _emit([*rows, result(conv, layer, c)], schema)

    return run


def audit_parts(audit: str, block: int):
    """(block, its part of the audit, turns of the result before it, has the result a system turn); a part holds the edits of `block` turns and the insertions around them."""
    system = (len(audit) - audit.count("D")) % 2 == 1  # (ua)+ is even
    number, begin, turns, out, before = 0, 0, 0, 0, 0
    for k, letter in enumerate(audit):
        if letter != "I":
            if turns == block:
                yield number, audit[begin:k], before, system
                number, begin, turns, before = number + 1, k, 0, out
            turns += 1
        out += letter != "D"
    if audit:
        yield number, audit[begin:], before, system


def _parts(block: int, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            rows = [(conv, number, -1, "", edits, before, system) for conv, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True) for number, edits, before, system in audit_parts(audit, block)]
            yield _emit(rows, schema)

    return run


def _edited(schema: pa.Schema):
    """mapInArrow function over turns sorted by conversation, block and place, each block led by its part of the audit: the repaired turns."""

    def run(batches):
        edits = out = system = conv = None
        for batch in batches:
            rows = []

            def put(role, text, edit):
                nonlocal out
                rows.append((conv, out, role or ("user" if (out - system) % 2 == 0 else "assistant"), text, edit))
                out += 1

            def inserted():
                while letter := next(edits, None):
                    if letter != "I":
                        return letter
                    put(None, "", "I")

            for key, _, at, role, text, before, has_system in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at < 0:
                    conv, edits, out, system = key, iter(text), before, int(has_system)
                    letter = inserted()  # the edit of the next turn
                    continue
                edit = letter
                if edit == "K":
                    rows.append((conv, out, role, text, edit))
                    out += 1
                elif edit == "R":
                    put(None, text, edit)
                letter = inserted()
            yield _emit(rows, schema)

    return run


def _hashes(schema: pa.Schema):
    """mapInArrow function over repaired turns sorted by conversation and place: one digest a conversation, read as a stream."""

    def run(batches):
        conv, digest = None, None
        for batch in batches:
            rows = []
            for key, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest is None or key != conv:
                    if digest is not None:
                        rows.append((conv, digest.hexdigest()))
                    conv, digest = key, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield _emit(rows, schema)
        if digest is not None:
            yield _emit([(conv, digest.hexdigest())], schema)

    return run


def arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class Repair:
    """The repair of a table of turns: `audits`, one row a conversation, and `turns()`, the repaired turns.

    Turns of a conversation come by turn (nulls first), then role, then the digest of the text. Null is
    a conversation of its own; a null role or text counts as one space. Turns without a word are blank;
    turns whose role and text an earlier turn has are duplicates; turns whose last character that is no
    white space isn't one of .!? are truncated. Rows that are equal in everything are turns that
    repeat each other. Texts may be of any length: the pass itself sees digests and flags only. An empty
    table gives empty results, and columns beside the four are not looked at.

    audits: conv, gaps, blank, duplicate, truncated, illegal, cost (longs), audit.
    """

    def __init__(self, rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = 1_000):
        self.space, self.block = Workspace(rows.sparkSession, "chat_repair"), block
        self.conv = T.StructField("conv", rows.schema[conv_col].dataType)
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
        role = F.coalesce(F.col(role_col).cast("string"), F.lit(" "))
        turns = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
        turns = turns.withColumn("said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
        turns = ordered(self.space, turns, "conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("said")], "at")
        self._turns = turns.withColumn("block", F.floor(F.col("at") / block))
        self.audits = self._audits()

    def _audits(self) -> DataFrame:
        space, turns = self.space, self._turns
        blank, whole = ~F.col("text").rlike(WORDY), F.col("text").rlike(rf"[.!?]{SPACE}*\z")
        told = turns.select("conv", "block", "at", "turn", F.substring("role", 1, 1).alias("initial"), "said", blank.alias("blank"), whole.alias("whole"))
        # Which words were said before: sums come before the exchange, and Spark splits a text that many turns repeat.
        again = space.table(turns.groupBy("conv", "said").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("of"), F.col("said").alias("words"), "first"))
        told = told.join(again, F.col("conv").eqNullSafe(F.col("of")) & (F.col("said") == F.col("words")), "left")
        fault = F.when(F.col("blank"), BLANK).when(F.col("at") > F.col("first"), DUPLICATE).when(~F.col("whole"), CUT).otherwise(FINE)
        told = told.select("conv", "block", "turn", "initial", fault.alias("fault"), "at").repartition("conv", "block").sortWithinPartitions("conv", "block", "at")
        blocks = T.StructType([self.conv]).add("block", "long").add("n", "long")
        for k in _COUNTS:
            blocks = blocks.add(k, "long")
        blocks = blocks.add("first", "string").add("last", "string").add("turns", "long").add("low", "long").add("high", "long").add("steps", T._parse_datatype_string(f"array<{_STEP}>"))
        passed = space.table(told.mapInArrow(_pass_blocks(arrow(blocks)), blocks))
        out = T.StructType([self.conv]).add("gaps", "long")
        for k in _COUNTS:
            out = out.add(k, "long")
        out = out.add("cost", "long").add("audit", "string")
        return space.table(passed.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_chain(arrow(out)), out))

    def turns(self) -> DataFrame:
        """conv, place, role, text, edit (K, R or I): the repaired turns."""
        lead = T.StructType([self.conv]).add("block", "long").add("at", "long").add("role", "string").add("text", "string").add("before", "long").add("system", "boolean")
        heads = self.audits.select("conv", "audit").mapInArrow(_parts(self.block, arrow(lead)), lead)
        turns = self._turns.select("conv", "block", "at", "role", "text", F.lit(None).cast("long").alias("before"), F.lit(None).cast("boolean").alias("system"))
        out = T.StructType([self.conv]).add("place", "long").add("role", "string").add("text", "string").add("edit", "string")
        rows = heads.unionByName(turns).repartition("conv", "block").sortWithinPartitions("conv", "block", "at")
        return rows.mapInArrow(_edited(arrow(out)), out)

    def digests(self) -> DataFrame:
        """conv, repaired_sha256 of the repaired turns as lines role:text. A digest is sequential, so each conversation's turns pass through one task, in a stream."""
        out = T.StructType([self.conv]).add("repaired_sha256", "string")
        rows = self.turns().select("conv", "place", "role", "text").repartition("conv").sortWithinPartitions("conv", "place")
        return rows.select("conv", "role", "text").mapInArrow(_hashes(arrow(out)), out)


def damaged(rows: DataFrame) -> DataFrame:
    """The turns that op11 repairs: faults dealt out by crc32 of `conv_id:turn`. Nulls count as one space."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text, role, kind = F.coalesce("text", space), F.coalesce("role", space), F.pmod(F.crc32(named), F.lit(20))
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    repair = Repair(damaged(rows))
    empty = hashlib.sha256().hexdigest()
    convs = rows.select("conv_id").distinct()
    audits, digests = repair.audits, repair.digests().withColumnRenamed("conv", "of")
    out = convs.join(audits, convs["conv_id"].eqNullSafe(audits["conv"]), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *_COUNTS, "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


#: The table of CRC-32, and the checksum of a text of ASCII characters, in SQL.
CRC_TABLE = """(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS t(i)))"""


def crc(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text of ASCII characters; crc_t.t is the table."""
    return f"xor(list_reduce(list_concat([4294967295]::BIGINT[], list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, crc_t.t[(xor(c, b) & 255) + 1])), 4294967295)"


def _plus(state: str, more: str) -> str:
    """SQL for a state's cost and audit, the cost raised."""
    return f"lpad((left({state}, 8)::INT + {more})::VARCHAR, 8, '0') || substr({state}, 9)"


#: States are b (nothing yet), s, u and a; each holds its cost in eight digits and then its audit, so that least() picks the cheapest and then the ASCII-least.
ORACLE = rf"""
WITH RECURSIVE crc_t AS MATERIALIZED (SELECT {CRC_TABLE} AS t),
kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, crc_t),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, unnest(CASE kind WHEN 0 THEN []::INT[] WHEN 3 THEN [0, 1] ELSE [0] END) AS c(copy)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS former FROM hurt),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][ 	-]*\z') THEN 't' ELSE '-' END AS fault FROM r),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
    count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE former IS NOT NULL AND former || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
dp AS (
  SELECT conv_id, n, 0 AS i, '00000000' AS b, NULL::VARCHAR AS s, '00000003I' AS u, '00000006II' AS a FROM c
  UNION ALL
  SELECT conv_id, n, i, b, s,
    least(u, b3 || 'I', s3 || 'I', a3 || 'I'),
    least(a, u3 || 'I', {_plus("b", "6")} || 'II', {_plus("s", "6")} || 'II')
  FROM (SELECT *, {", ".join(f"{_plus(x, '3')} AS {x}3" for x in "bsua")} FROM (
    SELECT conv_id, n, i + 1 AS i, {_plus("b", "4")} || 'D' AS b,
      least({_plus("s", "4")} || 'D', CASE WHEN may AND initial = 's' THEN {_plus("b", "more")} || 'K' END) AS s,
      least({_plus("u", "4")} || 'D', CASE WHEN may AND initial = 'u' THEN least({_plus("b", "more")} || 'K', {_plus("s", "more")} || 'K', {_plus("a", "more")} || 'K') END, CASE WHEN may THEN least({_plus("b", "3 + more")} || 'R', {_plus("s", "3 + more")} || 'R', {_plus("a", "3 + more")} || 'R') END) AS u,
      least({_plus("a", "4")} || 'D', CASE WHEN may AND initial = 'a' THEN {_plus("u", "more")} || 'K' END, CASE WHEN may THEN {_plus("u", "3 + more")} || 'R' END) AS a
    FROM (SELECT dp.*, f.initial, f.fault NOT IN ('b', 'd') AS may, CASE WHEN f.fault = 't' THEN 3 ELSE 0 END AS more FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1)))
),
e AS (SELECT conv_id, least(b, a) AS best FROM dp WHERE i = n),
w AS (SELECT conv_id, substr(best, 9) AS audit, unnest(range(1, length(best) - 7)) AS k FROM e),
v AS (SELECT conv_id, k, substr(audit, k, 1) AS edit, k - length(replace(left(audit, k), 'I', '')) AS gone, length(replace(left(audit, k), 'D', '')) - 1 AS o, length(replace(audit, 'D', '')) % 2 AS system FROM w),
t AS (SELECT v.conv_id, string_agg(CASE WHEN edit = 'K' THEN f.role WHEN (o - system) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY k) AS lines
  FROM v LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = k - gone WHERE edit <> 'D' GROUP BY v.conv_id)
SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(left(best, 8)::BIGINT, 0) AS cost, coalesce(substr(best, 9), '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM x.conv_id
"""
