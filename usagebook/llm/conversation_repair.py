"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation is repaired by the cheapest edits after which the roles' initials
read (s?(ua)+)?. Keep is free, Rerole (to user or assistant) costs 1, Delete 2,
Insert (an empty user or assistant turn, anywhere) 5, and a truncated row that
stays 5 more; blank rows and duplicates must be deleted. Of equally cheap edits
the one whose letters (D, I, K, R in order) are ASCII-least is taken.

There are four states: nothing yet, after the system turn, after a user turn,
after an assistant turn. An edit's letter and the state before it give the state
after it, so letters alone fix the repaired conversation. A row takes states to
states at a cost, with the inserts before it; the end of the conversation is a
last step that leads from any state, by inserts where needed, to the accepted
one. To rebuild the edits between two known states in memory that doesn't grow
with the length, forward costs from the first and backward costs from the last
are brought to the middle row; their least sum names the state to cross in, and
both halves are rebuilt by themselves. The forward costs carry the order of the
states' own least letters (no letters that consume the same rows begin each
other, so one order serves whatever follows), and so ties cross where the
letters are least.

Rows are range-partitioned by (conv_id, turn, role, digest of the text, number of
the row) and numbered, and a segment is up to 1,024 neighbours, so a conversation
of any length is spread over as many tasks as it needs. Only the runs at a
segment's two ends can go on in another: of these a 4 by 4 table of costs and
orders is made, the tables of a conversation meet (one for each 1,024 rows) and
the same divide and conquer over them fixes the states between segments. Then
each segment is repaired by itself. Digests need the text in order: a segment
gives its repaired text in one piece, and the pieces of a conversation are
hashed one after the other, none held longer.

Duplicates are found by the least place of each (conversation, role, text),
aggregated before it moves; rows meet those by place, which is no group's key.

Defined cases: a null is one space: in the key of the damage, as a role (which can't be
kept) and as a text (which is blank); a null turn comes first; rows of equal turn
are ordered by role, then by the SHA-256 of the text; repeated rows are duplicates of the first; a
null conv_id is a conversation; an empty table gives an empty result; other
columns are ignored. A very long text is held once in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagebook.llm.shared import stored, table
from usagebook.shipping import ship

STATES, ACCEPTED = 4, 0
INITIALS = "sua"
#: Role initials by state, and the state after them.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_SPOKEN = {"u": "user", "a": "assistant"}
#: The initial that an inserted or reroled turn has after each state.
_WANTED = "uuau"
INSERT, REROLE, DELETE, CUT = 5, 1, 2, 5
FINE, TRUNCATED, REMOVED = 0, 1, 2
#: Rows of a segment, as a power of two.
SEGMENT_BITS = 10
#: Repaired conversations of whose kinds a process remembers the edits.
KNOWN = 50_000
_FAR = 1 << 60

#: From each state the reachable ones: (before, after, cost, letters), in the order of the letters.
Step = tuple[tuple[int, int, int, object], ...]


def _ranked(ways: dict[tuple[int, int], tuple[int, str]]) -> tuple[tuple[int, int, int, str], ...]:
    return tuple((a, b, cost, letters) for (a, b), (cost, letters) in sorted(ways.items(), key=lambda x: (x[0][0], x[1][1])))


def _steps() -> dict[int, Step]:
    """What each kind of row can do: kind is the initial's code (3: any other) plus 4 times the fault."""
    out = {}
    for initial in range(4):
        for fault in (FINE, TRUNCATED, REMOVED):
            ways: dict[tuple[int, int], tuple[int, str]] = {}
            for a in range(STATES):
                at, paid, letters = a, 0, ""
                for _ in range(3):  # two inserts at most: a third repeats a state
                    edits = [(at, DELETE, "D")]
                    if fault != REMOVED:
                        more = CUT if fault == TRUNCATED else 0
                        edits.append((_NEXT[at, _WANTED[at]], REROLE + more, "R"))
                        if initial < 3 and (at, INITIALS[initial]) in _NEXT:
                            edits.append((_NEXT[at, INITIALS[initial]], more, "K"))
                    for b, cost, letter in edits:
                        ways[a, b] = min(ways.get((a, b), (_FAR, "")), (paid + cost, letters + letter))
                    at, paid, letters = _NEXT[at, _WANTED[at]], paid + INSERT, letters + "I"
            out[initial + 4 * fault] = _ranked(ways)
    return out


ROWS = _steps()
#: The end of a conversation: from every state to the accepted one.
END: Step = _ranked({(0, 0): (0, ""), (1, 0): (2 * INSERT, "II"), (2, 0): (INSERT, "I"), (3, 0): (0, "")})


def forward(steps: list[Step], first: int) -> tuple[list[int], list[int]]:
    """From a state, the costs of all states after the steps, and the order of their least letters."""
    cost, order = [_FAR] * STATES, [0] * STATES
    cost[first] = 0
    for step in steps:
        best: list[tuple] = [(_FAR,)] * STATES
        for place, (a, b, c, _) in enumerate(step):
            if cost[a] < _FAR:
                way = (cost[a] + c, order[a], place)
                if way < best[b]:
                    best[b] = way
        cost = [w[0] for w in best]
        ranks = sorted(range(STATES), key=lambda b: best[b][1:])
        for k, b in enumerate(ranks):
            order[b] = k
    return cost, order


def backward(steps: list[Step], last: int) -> list[int]:
    """The costs from all states before the steps to a state after them."""
    cost = [_FAR] * STATES
    cost[last] = 0
    for step in reversed(steps):
        now = [_FAR] * STATES
        for a, b, c, _ in step:
            if cost[b] + c < now[a]:
                now[a] = cost[b] + c
        cost = now
    return cost


def crossings(steps: list[Step], first: int, last: int) -> Iterator[int]:
    """The states after each of the steps on the cheapest way between two states, of equal ones that of the least letters."""
    if len(steps) < 2:
        yield from [last] * len(steps)
        return
    middle = len(steps) // 2
    left, order = forward(steps[:middle], first)
    right = backward(steps[middle:], last)
    at = min(range(STATES), key=lambda s: (left[s] + right[s], order[s]))
    yield from crossings(steps[:middle], first, at)
    yield from crossings(steps[middle:], at, last)


def edits(steps: list[Step], first: int, last: int) -> tuple[int, list[str]]:
    """The cost of the cheapest way between two states, and the letters of each step."""
    cost, letters, at = 0, [], first
    for step, after in zip(steps, crossings(steps, first, last), strict=True):
        paid, own = next((c, w) for a, b, c, w in step if (a, b) == (at, after))
        cost += paid
        letters.append(own)
        at = after
    return cost, letters


def summary(steps: list[Step]) -> Step:
    """Steps as one: the costs between all states, those from one state in the order of their letters."""
    out = []
    for a in range(STATES):
        cost, order = forward(steps, a)
        out += [(a, b, cost[b], None) for b in sorted(range(STATES), key=order.__getitem__) if cost[b] < _FAR]
    return tuple(out)


@lru_cache(KNOWN)
def _short(kinds: bytes) -> tuple[int, tuple[str, ...]]:
    cost, letters = edits([*(ROWS[k] for k in kinds), END], 0, ACCEPTED)
    return cost, tuple(letters)


def repair(kinds: bytes, first: int = 0, last: int | None = None) -> tuple[int, tuple[str, ...]]:
    """Cost and letters of a run of rows, whole or between states. Without `last` the conversation ends with it, and the last letters are those of its end."""
    if first == 0 and last is None and len(kinds) <= 64:
        return _short(kinds)
    steps = [ROWS[k] for k in kinds] + ([END] if last is None else [])
    cost, letters = edits(steps, first, ACCEPTED if last is None else last)
    return cost, tuple(letters)


def rebuilt(rows: list[tuple[str, str]], letters: tuple[str, ...], first: int) -> Iterator[str]:
    """The repaired lines of rows (role, text)."""
    at = first
    for own, (role, text) in zip(letters, [*rows, ("", "")], strict=False):
        for letter in own:
            initial = role[:1] if letter == "K" else _WANTED[at]
            if letter == "I":
                yield f"{_SPOKEN[initial]}:"
            elif letter != "D":
                yield f"{role if letter == 'K' else _SPOKEN[initial]}:{text}"
            if letter != "D":
                at = _NEXT[at, initial]


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text of the rows after damage: some dropped, emptied, cut, repeated or set to user, as the crc32 of `conv_id:turn` says."""
    written = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(" "))
    what = F.pmod(F.crc32(F.concat(written(conv_id), F.lit(":"), written(turn)).cast("binary")), F.lit(20))
    rows = conversations.select(_ident(conversations, conv_id), conversations[turn].cast("long").alias("turn"), written(role).alias("role"), written(text).alias("text"), what.alias("what"))
    rows = rows.where("what <> 0").withColumn("copy", F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text_ = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"), text_.alias("text"))


def placed(rows: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """Adds place, which grows along each conversation, and segment; no conversation is between another's rows."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.sha2("text", 256), F.col("number")]
    numbered = rows.withColumn("number", F.monotonically_increasing_id())  # divides rows that repeat; their order among each other changes nothing
    ordered = numbered.repartitionByRange(*order).sortWithinPartitions(*order).drop("number").withColumn("place", F.monotonically_increasing_id())
    return stored(ordered.withColumn("segment", F.shiftright("place", segment_bits)), "turns")


def faults(rows: DataFrame) -> DataFrame:
    """segment, place, conv_id, kind and fault (0 none, 1 blank, 2 duplicate, 3 truncated) of placed rows, without texts."""
    spaces = r"[\x20\x09-\x0D]"
    last: Column = F.substring(F.regexp_replace("text", rf"{spaces}+$", ""), -1, 1)
    seen = rows.select("segment", "place", "conv_id", "role", last.alias("last"), F.unhex(F.sha2("text", 256)).alias("digest"))
    first = stored(seen.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first")), "turns-first")
    found = seen.join(first, "place", "left")
    fault = F.when(F.col("last") == "", 1).when(F.col("first").isNull(), 2).when(~F.col("last").isin(".", "!", "?"), 3).otherwise(0)
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    code = F.when((F.col("role") == "") | (initial == 0), 3).otherwise(initial - 1)
    found = found.select("segment", "place", "conv_id", fault.alias("fault"), code.alias("code"))
    return found.withColumn("kind", F.col("code") + F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 4 * TRUNCATED).otherwise(4 * REMOVED))


def _runs(group: pa.Table) -> Iterator[tuple[object, list[dict], bool]]:
    """The conversations of a segment: id, rows in order, and whether it may go on outside."""
    rows = sorted(group.to_pylist(), key=lambda r: r["place"])
    runs = [(c, list(own)) for c, own in groupby(rows, key=lambda r: r["conv_id"])]
    for k, (c, own) in enumerate(runs):
        yield c, own, k in (0, len(runs) - 1)


def states_between(marks: DataFrame) -> DataFrame:
    """segment, conv_id, before, after: the states at the ends of the runs that may go on in another segment; after is null at a conversation's end."""
    conv = marks.schema["conv_id"].dataType.simpleString()
    kind = "segment long, conv_id " + conv

    def summarise(group: pa.Table) -> pa.Table:
        out = []
        for c, own, is_open in _runs(group):
            if is_open:
                out.append({"segment": own[0]["segment"], "conv_id": c, "ways": [x for way in summary([ROWS[r["kind"]] for r in own]) for x in way[:3]]})
        return pa.Table.from_pylist(out, pa.schema([("segment", pa.int64()), group.schema.field("conv_id"), ("ways", pa.list_(pa.int64()))]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted tables of each conversation become the states between its segments."""
        for c, own in groupby(_rows(batches), key=lambda r: r["conv_id"]):
            parts = [(r["segment"], tuple((*r["ways"][k : k + 3], None) for k in range(0, len(r["ways"]), 3))) for r in own]
            before, after = 0, [*crossings([*(w for _, w in parts), END], 0, ACCEPTED)][:-2]
            out = []
            for (segment, _), at in zip(parts, [*after, None], strict=True):
                out.append({"segment": segment, "conv_id": c, "before": before, "after": at})
                before = at
            for k in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_pylist(out[k : k + 10_000], pa.schema([("segment", pa.int64()), ("conv_id", ids), ("before", pa.int32()), ("after", pa.int32())]))

    ids = _arrow_type(marks, "conv_id")
    tables = marks.select("segment", "place", "conv_id", "kind").groupBy("segment").applyInArrow(summarise, f"{kind}, ways array<long>")
    return tables.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(meet, f"{kind}, before int, after int")


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return pa.string() if df.schema[column].dataType.simpleString() == "string" else pa.int64()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def repaired_parts(rows: DataFrame, marks: DataFrame, ends: DataFrame) -> DataFrame:
    """segment, conv_id, counts, first and last initial, audit and repaired text (null: nothing left) of each run of each segment."""
    ids = _arrow_type(rows, "conv_id")
    schema = pa.schema([("segment", pa.int64()), ("conv_id", ids), *[(n, pa.int64()) for n in _COUNTS], ("head", pa.int32()), ("tail", pa.int32()), ("audit", pa.string()), ("body", pa.string())])

    def mend(turns: pa.Table, given: pa.Table) -> pa.Table:
        known = {r["place"]: r for r in given.to_pylist() if r["place"] is not None}
        states = {r["conv_id"]: (r["before"], r["after"]) for r in given.to_pylist() if r["place"] is None}
        out = []
        for c, own, is_open in _runs(turns):
            own = [r | known[r["place"]] for r in own]
            first, last = states[c] if is_open else (0, None)
            cost, letters = repair(bytes(r["kind"] for r in own), first, last)
            lines = list(rebuilt([(r["role"], r["text"]) for r in own], letters, first))
            codes, found = [r["code"] for r in own], [r["fault"] for r in own]
            out.append(
                {
                    "segment": own[0]["segment"], "conv_id": c, "blank": found.count(1), "duplicate": found.count(2), "truncated": found.count(3),
                    "illegal": sum(pair not in _LEGAL for pair in zip(codes, codes[1:], strict=False)), "cost": cost, "head": codes[0], "tail": codes[-1],
                    "audit": "".join(letters), "body": "\n".join(lines) if lines else None,
                }
            )
        return pa.Table.from_pylist(out, schema)

    none = lambda *names: [F.lit(None).cast("int").alias(n) for n in names]
    given = marks.select("segment", "conv_id", "place", "kind", "code", "fault", *none("before", "after")).unionByName(
        ends.select("segment", "conv_id", F.lit(None).cast("long").alias("place"), *none("kind", "code", "fault"), "before", "after")
    )
    conv = rows.schema["conv_id"].dataType.simpleString()
    ddl = f"segment long, conv_id {conv}, {', '.join(f'{n} long' for n in _COUNTS)}, head int, tail int, audit string, body string"
    return rows.select("segment", "place", "conv_id", "role", "text").groupBy("segment").cogroup(given.groupBy("segment")).applyInArrow(mend, ddl)


def _ident(df: DataFrame, conv_id: str) -> Column:
    """conv_id as a string or a long."""
    return df[conv_id].cast("string" if df.schema[conv_id].dataType.simpleString() == "string" else "long").alias("conv_id")


def repaired(conversations: DataFrame, rows: DataFrame, conv_id: str = "conv_id", segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """One row for each conv_id of `conversations`: the faults of its rows (conv_id, turn, role, text), the cheapest edits and the digest of what they leave."""
    ship(conversations.sparkSession)
    turns = placed(rows, segment_bits)
    marks = stored(faults(turns), "turn-faults")
    parts = repaired_parts(turns, marks, states_between(marks))
    spans = turns.groupBy("conv_id").agg(F.max("turn").alias("most"), F.min("turn").alias("least"), F.count_distinct("turn").alias("met"))
    gaps = spans.select("conv_id", F.coalesce(F.col("most") - F.col("least") + 1 - F.col("met"), F.lit(0)).alias("gaps"))
    every = conversations.select(_ident(conversations, conv_id)).distinct().select("conv_id", F.lit(0).cast("long").alias("gaps"))
    base = every.unionByName(gaps).groupBy("conv_id").agg(F.max("gaps").alias("gaps"))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in parts.schema.fields[2:]]
    pieces = base.select(F.lit(-1).cast("long").alias("segment"), "conv_id", *empty, "gaps").unionByName(parts.withColumn("gaps", F.lit(None).cast("long")))
    ids = _arrow_type(rows, "conv_id")
    names = ("gaps", *_COUNTS)
    schema = pa.schema([("conv_id", ids), *[(n, pa.int64()) for n in names], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A conversation's pieces follow each other: first the one of no segment, with its gaps."""
        out = []
        for c, own in groupby(_rows(batches), key=lambda r: r["conv_id"]):
            row, digest, audit, tail, begun = dict.fromkeys(names, 0) | {"conv_id": c}, hashlib.sha256(), [], None, False
            for r in own:
                if r["segment"] < 0:
                    row["gaps"] = r["gaps"]
                    continue
                for n in _COUNTS:
                    row[n] += r[n]
                row["illegal"] += tail is not None and (tail, r["head"]) not in _LEGAL
                tail = r["tail"]
                audit.append(r["audit"])
                if r["body"] is not None:
                    digest.update((b"\n" if begun else b"") + r["body"].encode())
                    begun = True
            out.append(row | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()})
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    conv = rows.schema["conv_id"].dataType.simpleString()
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(join, f"conv_id {conv}, {', '.join(f'{n} long' for n in names)}, audit string, repaired_sha256 string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each conversation, after the contract's damage."""
    conversations = table(spark, sf_dir, "conversations")
    return repaired(conversations, damaged(conversations))


def _sql() -> str:
    """Rows are taken in turn order; of each of four states the cheapest and ASCII-least edits so far are kept, with the text that they give."""
    hops = []
    for s in range(STATES):
        at, letters, lines = s, "", []
        for k in range(3):
            hops.append(f"({s}, {at}, {INSERT * k}, '{letters}', [{', '.join(repr(x) for x in lines)}]::VARCHAR[], '{_WANTED[at]}')")
            lines = [*lines, f"{_SPOKEN[_WANTED[at]]}:"]
            at, letters = _NEXT[at, _WANTED[at]], letters + "I"
    moves = ", ".join(f"({a}, '{i}', {b})" for (a, i), b in _NEXT.items())
    ends = ", ".join(f"({a}, {c}, '{w}', [{', '.join(repr(x) for x in (['user:', 'assistant:'] if len(w) == 2 else ['assistant:'] * len(w)))}]::VARCHAR[])" for a, _, c, w in END)
    # DuckDB has no crc32: each byte is followed by eight shifts, written as -1
    crc = "xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(k, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"
    return f"""
WITH RECURSIVE
h(state, here, paid, letters, lines, wanted) AS (VALUES {", ".join(hops)}),
m(here, initial, after) AS (VALUES {moves}),
e(state, paid, letters, lines) AS (VALUES {ends}),
b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS what FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations)),
d AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN what = 3 THEN [0, 1] ELSE [0] END) AS copy FROM b WHERE what <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS seen, right(regexp_replace(text, '[\\x20\\x09-\\x0D]+$', ''), 1) AS last_one FROM r),
k AS (SELECT conv_id, turn, role, text, n, left(role, 1) AS initial, CASE WHEN last_one = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN last_one NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault FROM f),
z AS (SELECT conv_id, max(n) AS rows_, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM k GROUP BY conv_id),
x AS (SELECT conv_id, count(*) AS illegal FROM (SELECT conv_id, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair, n FROM k) WHERE n > 1 AND pair NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
p(conv_id, n, state, cost, audit, lines) AS (
  SELECT conv_id, 0::BIGINT, 0, 0, '', []::VARCHAR[] FROM z
  UNION ALL
  SELECT conv_id, n, state, best.cost, best.audit, best.lines FROM (
    SELECT p.conv_id, k.n, o.after AS state, min({{'cost': p.cost + h.paid + o.paid, 'audit': p.audit || h.letters || o.letter, 'lines': p.lines || h.lines || o.line}}) AS best
    FROM p JOIN k ON k.conv_id IS NOT DISTINCT FROM p.conv_id AND k.n = p.n + 1 JOIN h ON h.state = p.state,
      LATERAL (
        SELECT h.here AS after, {DELETE} AS paid, 'D' AS letter, []::VARCHAR[] AS line
        UNION ALL SELECT m.after, {REROLE} + CASE WHEN k.fault = 'truncated' THEN {CUT} ELSE 0 END, 'R', [CASE h.wanted WHEN 'u' THEN 'user:' ELSE 'assistant:' END || k.text] FROM m WHERE m.here = h.here AND m.initial = h.wanted AND k.fault NOT IN ('blank', 'duplicate')
        UNION ALL SELECT m.after, CASE WHEN k.fault = 'truncated' THEN {CUT} ELSE 0 END, 'K', [k.role || ':' || k.text] FROM m WHERE m.here = h.here AND m.initial = k.initial AND k.fault NOT IN ('blank', 'duplicate')
      ) o
    GROUP BY p.conv_id, k.n, o.after)
),
w AS (SELECT z.conv_id, min({{'cost': p.cost + e.paid, 'audit': p.audit || e.letters, 'lines': p.lines || e.lines}}) AS best FROM p JOIN z ON z.conv_id IS NOT DISTINCT FROM p.conv_id AND z.rows_ = p.n JOIN e ON e.state = p.state GROUP BY z.conv_id)
SELECT c.conv_id, coalesce(z.gaps, 0) AS gaps, coalesce(z.blank, 0) AS blank, coalesce(z.duplicate, 0) AS duplicate, coalesce(z.truncated, 0) AS truncated, coalesce(x.illegal, 0) AS illegal,
  CAST(coalesce(w.best.cost, 0) AS BIGINT) AS cost, coalesce(w.best.audit, '') AS audit, sha256(coalesce(array_to_string(w.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id
"""


SQL = _sql()
