"""Chat formatting: roles of a transcript's lines by a hidden Markov model.

States are (role, first line of a turn or not). A line shows a speaker marker or
none, whether an empty line stands before it, whether it asks a question, and how
long it is; the features' probabilities in a state multiply. Probabilities are
counts plus one over whole labelled conversations: about TRAIN_CONVERSATIONS of
those whose crc32(conv_id as text) mod 5 is not 0, drawn by a hash of conv_id, of
no more than TRAIN_BYTES of text in all; one that exceeds what is left is passed
over. Viterbi gives the likeliest states of all lines of a conversation. Every turn
is rendered as <|role|>, a line end, its text and a line end: the marker is taken
off a turn's first line only, further lines stay as they are, with their
indentation and the empty lines between them, and a role tag inside a text is
written <\\|role|>, so that tags are turns and nothing else.

Rows are range-partitioned by (conv_id, position, hash of the text), so a conversation of any
length is spread over as many tasks as it needs. Conversations that lie inside
one task are decoded there. For one that may go on in another, each task gives
the scores of the best paths between any two states at its part's ends; a
(max, +) product of those small matrices, one for each task and conversation,
fixes the states at the ends, and then each part is decoded between them. The
result is the same as decoding the whole at once.

Defined cases: a null text is an empty line; a row with a null conv_id is a
conversation of its own; rows of equal position follow each other ordered by
a hash of the text; a null position comes first; repeated rows are each rendered; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagebook.llm.shared import stored, table
from usagebook.shipping import ship

ROLES = ("system", "user", "assistant")
#: States: a turn's first line for each role, then its further lines.
STATES = 2 * len(ROLES)
#: Conversations that the probabilities are counted on.
TRAIN_CONVERSATIONS = 2000
#: Bytes of text that these may have in all.
TRAIN_BYTES = 32 << 20

_SPEAKERS = {"system": 1, "sys": 1, "context": 1, "user": 2, "human": 2, "customer": 2, "question": 2, "q": 2, "instruction": 2, "prompt": 2, "assistant": 3, "ai": 3, "bot": 3, "model": 3, "answer": 3, "a": 3, "response": 3}
_MARKER = re.compile(r"\s*(?:#{1,4}\s*|\*\*|\[)?(?:(" + "|".join(sorted(_SPEAKERS, key=len, reverse=True)) + r")\s*(?:\*\*|\])?\s*:|<\|(system|user|assistant)\|>)(?:\*\*)?\s?", re.IGNORECASE)
_TAG = re.compile(r"<\|(system|user|assistant)\|>")
#: Sizes of the features: marker, empty line before, question, length.
SIZES = (4, 2, 2, 4)


def split_marker(line: str) -> tuple[int, str]:
    """The speaker that a line's marker names (0: none), and the line without it."""
    found = _MARKER.match(line)
    return (_SPEAKERS[(found[1] or found[2]).lower()], line[found.end() :]) if found else (0, line)


def features(line: str, after_empty: bool) -> tuple[int, int, int, int]:
    speaker, rest = split_marker(line)
    return speaker, int(after_empty), int("?" in rest), min(3, len(rest) // 100)


class RoleModel:
    """Log-probabilities of starts, steps and features."""

    def __init__(self, conversations: list[list[tuple[str | None, str]]]):
        """conversations: turns (role, text with its marker) in order."""
        start, step = np.ones(STATES), np.ones((STATES, STATES))
        counts = [np.ones((STATES, n)) for n in SIZES]
        for turns in conversations:
            before, empty = None, True
            for role, text in turns:
                if role not in ROLES:
                    continue
                first = True
                for line in text.split("\n"):
                    if not line.strip():
                        empty = True
                        continue
                    state = ROLES.index(role) + (0 if first else len(ROLES))
                    for table_, value in zip(counts, features(line, empty), strict=True):
                        table_[state, value] += 1
                    if before is None:
                        start[state] += 1
                    else:
                        step[before, state] += 1
                    before, first, empty = state, False, False
        for r in range(len(ROLES)):  # a further line follows only a line of its own turn
            for other in range(STATES):
                if other % len(ROLES) != r:
                    step[other, len(ROLES) + r] = 1e-9
            start[len(ROLES) + r] = 1e-9
        self.start = np.log(start / start.sum())
        self.step = np.log(step / step.sum(1, keepdims=True))
        self.features = [np.log(c / c.sum(1, keepdims=True)) for c in counts]

    def scores(self, seen: np.ndarray) -> np.ndarray:
        """Each line's log-probability in each state."""
        return sum(t[:, seen[:, k]].T for k, t in enumerate(self.features)) if len(seen) else np.zeros((0, STATES))

    def decode(self, scores: np.ndarray, before: int | None = None, last: int | None = None) -> np.ndarray:
        """Viterbi: the likeliest states, after state `before` (None: at the start) and ending in `last` (None: any)."""
        n = len(scores)
        if not n:
            return np.zeros(0, int)
        best = (self.start if before is None else self.step[before]) + scores[0]
        back = np.zeros((n, STATES), int)
        for i in range(1, n):
            ways = best[:, None] + self.step
            back[i] = ways.argmax(0)
            best = ways[back[i], np.arange(STATES)] + scores[i]
        out = np.zeros(n, int)
        out[-1] = best.argmax() if last is None else last
        for i in range(n - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out

    def ends(self, scores: np.ndarray) -> np.ndarray:
        """Scores of the best paths through lines, from each state before them (the last row: from the start) to each state at their end."""
        if not len(scores):
            return np.where(np.eye(STATES + 1, STATES) > 0, 0.0, -np.inf)
        best = np.vstack((self.step, self.start)) + scores[0]
        for row in scores[1:]:
            best = (best[:, :, None] + self.step[None]).max(1) + row
        return best


def observed(texts: list[str], empty: bool) -> tuple[list[list[str]], np.ndarray, bool]:
    """Lines of each text, the features of all that aren't empty, and whether an empty line comes last."""
    lines, seen = [], []
    for text in texts:
        own = text.split("\n")
        lines.append(own)
        for line in own:
            if line.strip():
                seen.append(features(line, empty))
                empty = False
            else:
                empty = True
    return lines, np.array(seen, int).reshape(-1, len(SIZES)), empty


def render(lines: list[list[str]], states: np.ndarray) -> tuple[list[str], list[str | None], list[int]]:
    """Each text's canonical turns, the role of its first line that isn't empty, and the turns that begin in it."""
    rendered, roles, begun, at = [], [], [], 0
    for own in lines:
        out, role, turns, empty = [], None, 0, 0
        for line in own:
            if not line.strip():
                empty += 1
                continue
            state = int(states[at])
            at += 1
            name = ROLES[state % len(ROLES)]
            role = role or name
            if state < len(ROLES):
                out.append(f"<|{name}|>\n")
                turns += 1
                line = split_marker(line)[1].strip()
            elif out:
                out.append("\n" * empty)
            out.append(_TAG.sub(r"<\\|\1|>", line) + "\n")
            empty = 0
        rendered.append("".join(out))
        roles.append(role)
        begun.append(turns)
    return rendered, roles, begun


_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("seq", pa.int64()), ("conv_id", pa.int64()), ("position", pa.int64()), ("raw", pa.string()), ("after_empty", pa.bool_()), ("role_pred", pa.string()), ("n_turns", pa.int32()), ("rendered", pa.string()), ("ends", pa.list_(pa.float64()))])
_DDL = "kind int, part int, seq long, conv_id long, position long, raw string, after_empty boolean, role_pred string, n_turns int, rendered string, ends array<double>"
DECODED, OPEN, ENDS = 0, 1, 2


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[int | None], list[str]]]:
    """Neighbouring rows of one conversation: conv_id, positions, texts."""
    conv, positions, texts = None, [], []
    for batch in batches:
        for c, p, t in zip(*(x.to_pylist() for x in batch.columns[:3]), strict=True):
            if positions and (c is None or c != conv):
                yield conv, positions, texts
                positions, texts = [], []
            conv = c
            positions.append(p)
            texts.append(t)
    if positions:
        yield conv, positions, texts


def recover_roles(rows: DataFrame, model: RoleModel) -> DataFrame:
    """conv_id, position, role_pred, n_turns, rendered of each row of (conv_id long, position long, raw string), whose texts in order make the transcripts."""
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = shared.value, TaskContext.get().partitionId()
        out, seq = [], 0

        def give(run, is_open: bool) -> None:
            nonlocal seq
            conv, positions, texts = run
            lines, seen, _ = observed(texts, True)
            row = dict.fromkeys(_SCHEMA.names) | {"part": part, "conv_id": conv}
            if is_open:  # whether an empty line comes before is known only with the part before; the rest is as here
                for p, t in zip(positions, texts, strict=True):
                    out.append(row | {"kind": OPEN, "seq": seq, "position": p, "raw": t})
                    seq += 1
                for flag in (True, False):
                    _, seen, last = observed(texts, flag)
                    out.append(row | {"kind": ENDS, "after_empty": flag, "raw": str(int(last)), "ends": own.ends(own.scores(seen)).ravel().tolist()})
                return
            for p, r, role, n in zip(positions, *(lambda x: (x[0], x[1], x[2]))(render(lines, own.decode(own.scores(seen)))), strict=True):
                out.append(row | {"kind": DECODED, "seq": seq, "position": p, "role_pred": role, "n_turns": n, "rendered": r})
                seq += 1

        held, first = None, True
        for run in _runs(batches):
            if held is not None:
                give(held, first and held[0] is not None)
                first = False
            held = run
            if len(out) > 2000:
                yield pa.RecordBatch.from_pylist(out, _SCHEMA)
                out = []
        if held is not None:
            give(held, held[0] is not None)
        yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    order = [F.col("conv_id").asc_nulls_first(), F.col("position").asc_nulls_first(), F.xxhash64("raw")]  # boundaries are sampled: hashes, not texts
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "raw")
    passed = stored(ordered.mapInArrow(first_pass, _DDL), "transcript-parts")

    def join_ends(group: pd.DataFrame) -> pd.DataFrame:
        """Of one conversation's parts, at most one a task: the states at each part's ends."""
        own = shared.value
        empty, best, backs, chosen = True, np.full(STATES + 1, -np.inf), [], []
        best[-1] = 0.0
        for part, pair in group.sort_values("part").groupby("part"):
            row = pair[pair.after_empty == empty].iloc[0]
            ends = np.array(row.ends).reshape(STATES + 1, STATES)
            ways = best[:, None] + ends
            backs.append(ways.argmax(0))
            now = ways.max(0)
            silent = not np.isfinite(ends[-1]).any()  # only empty lines: the state stays, or the start does
            chosen.append((part, empty, silent))
            best = best if silent else np.append(now, -np.inf)
            empty = row.raw == "1"
        out, state = [], None if not np.isfinite(best[:-1]).any() else int(best[:-1].argmax())
        for (part, flag, silent), back in zip(reversed(chosen), reversed(backs), strict=True):
            before = state if silent or state is None else (None if back[state] == STATES else int(back[state]))
            out.append((group.conv_id.iloc[0], part, flag, before, state))
            state = before
        del own
        return pd.DataFrame(out, columns=["conv_id", "part", "flag", "before", "last"]).astype({"before": "Int64", "last": "Int64"})

    ends = passed.where(f"kind = {ENDS}").select("conv_id", "part", "after_empty", "raw", "ends").groupBy("conv_id").applyInPandas(join_ends, "conv_id long, part int, flag boolean, before long, last long")

    def second_pass(key, group: pd.DataFrame) -> pd.DataFrame:
        """One part of one conversation, no larger than its task was."""
        own, group = shared.value, group.sort_values("seq")
        state = lambda x: None if pd.isna(x) else int(x)
        lines, seen, _ = observed(group.raw.tolist(), bool(group.flag.iloc[0]))
        rendered, roles, begun = render(lines, own.decode(own.scores(seen), state(group.before.iloc[0]), state(group["last"].iloc[0])))
        return pd.DataFrame({"conv_id": group.conv_id, "position": group.position, "role_pred": roles, "n_turns": begun, "rendered": rendered})

    late = passed.where(f"kind = {OPEN}").select("conv_id", "part", "seq", "position", "raw").join(ends, ["conv_id", "part"]).groupBy("conv_id", "part").applyInPandas(second_pass, "conv_id long, position long, role_pred string, n_turns int, rendered string")
    return passed.where(f"kind = {DECODED}").select("conv_id", "position", "role_pred", "n_turns", "rendered").union(late)


def transcripts(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, position, role and raw: each turn as transcripts show it, with its conversation's style of marker, one turn in eight without, and an empty line after it."""
    ident, place = conversations[conv_id].cast("long"), conversations[turn].cast("long")
    styles = [("System: ", "User: ", "Assistant: "), ("Context: ", "Human: ", "AI: "), ("### System: ", "### Instruction: ", "### Response: "), ("<|system|>", "<|user|>", "<|assistant|>"), ("**System**: ", "**Q**: ", "**A**: ")]
    style = F.pmod(F.xxhash64(ident), F.lit(len(styles)))

    def marker(k: int) -> Column:
        return F.element_at(F.array(*[F.lit(s[k]) for s in styles]), (style + 1).cast("int"))

    mark = F.coalesce(*[F.when(conversations[role] == r, marker(k)) for k, r in enumerate(ROLES)], F.lit(""))
    shown = F.when(F.pmod(F.xxhash64(ident, place, F.lit("marker")), F.lit(8)) > 0, mark).otherwise("")
    return conversations.select(ident.alias("conv_id"), place.alias("position"), conversations[role].cast("string").alias("role"), F.concat(shown, F.coalesce(conversations[text].cast("string"), F.lit("")), F.lit("\n\n")).alias("raw"))


def train(shown: DataFrame) -> RoleModel:
    """Probabilities from about TRAIN_CONVERSATIONS conversations of (conv_id, position, role, raw) whose crc32(conv_id as text) mod 5 is not 0."""
    labelled = shown.where("conv_id is not null and crc32(cast(cast(conv_id as string) as binary)) % 5 <> 0")
    total = labelled.agg(F.approx_count_distinct("conv_id")).first()[0]
    chance = F.xxhash64("conv_id", F.lit("train"))
    drawn = labelled.where(F.pmod(chance, F.lit(1 << 30)) / float(1 << 30) < TRAIN_CONVERSATIONS / max(1, total))
    sizes = drawn.groupBy("conv_id").agg(F.sum(F.octet_length("raw")).alias("size")).orderBy(F.xxhash64("conv_id", F.lit("train")), "conv_id").collect()  # about TRAIN_CONVERSATIONS rows
    chosen, left = [], TRAIN_BYTES
    for r in sizes:
        if r["size"] <= left:
            left -= r["size"]
            chosen.append(r["conv_id"])
    found: dict[int, list] = {k: [] for k in chosen}
    for r in drawn.where(F.col("conv_id").isin(chosen)).select("conv_id", "position", "role", "raw").toLocalIterator():
        found[r["conv_id"]].append((-1 if r["position"] is None else r["position"], r["role"], r["raw"]))
    return RoleModel([[(role, raw) for _, role, raw in sorted(turns, key=lambda x: (x[0], x[2]))] for turns in found.values()])


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role_pred, n_turns, rendered: one row for each row of conversations."""
    shown = transcripts(table(spark, sf_dir, "conversations"))
    return recover_roles(shown.select("conv_id", "position", "raw"), train(shown)).withColumnRenamed("position", "turn")
