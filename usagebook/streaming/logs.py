"""Streams of log lines: client B's whole records, repeated responses, daily usage."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from usagebook.operators.ordered import FLAGS, SNAPSHOT, advance
from usagebook.sources import log_b

_COUNTS = T.StructType([*[T.StructField(c, T.LongType()) for c in SNAPSHOT], *[T.StructField(f, T.BooleanType()) for f in FLAGS]])
_TEXT = ("thread", "session", "version", "meta_provider", "meta_auth", "model", "provider", "tier", "auth")
#: What is remembered of a log: its last line, epoch and number of events, the last baseline, and what its lines stated.
_STATE = T.StructType([
    *[T.StructField(c, T.LongType()) for c in ("line", "epoch", "event_index", "window", "meta_line", "provider_line", "auth_line")], T.StructField("before", _COUNTS), *[T.StructField(c, T.StringType()) for c in _TEXT],
])
_START = {"line": 0, "epoch": 0, "event_index": 0, "meta_line": 0, "provider_line": 0, "auth_line": 0, "window": None, "before": None} | dict.fromkeys(_TEXT)
_KEYED = T.StructType([T.StructField("code", T.StringType()), T.StructField("key", T.StringType())])
_SINCE = T.StructType([T.StructField("line", T.LongType())])
#: Deltas and codes of records, as log_b.judged takes them.
_TOLD = T.StructType([
    T.StructField("source_id", T.StringType()), T.StructField("line_number", T.LongType()), T.StructField("occurred_at", T.TimestampType()), T.StructField("now", _COUNTS), T.StructField("delta", _COUNTS),
    *[T.StructField(c, T.BooleanType()) for c in ("reset", "billable", "event")], T.StructField("epoch", T.LongType()), T.StructField("event_index", T.LongType()), T.StructField("_session", T.StringType()), T.StructField("_known", T.BooleanType()),
    *[T.StructField(c, T.StringType()) for c in ("client_version", "raw_model", "provider", "service_tier", "auth_mode")], T.StructField("_auth_said", T.BooleanType()), T.StructField("context_window", T.LongType()),
    T.StructField("codes", T.ArrayType(T.StringType())),
])


class Fold:
    """The fold of one log, record by record: rows of log_b.records with `own` (the thread in the file's name) and `name` go in, in the order of lines."""

    def __init__(self, state: dict | None, warned):
        """state: as left by the record before; warned(code, key): whether a code was given before, which marks it as given."""
        self.s, self.warned = dict(state or _START), warned

    def _codes(self, pairs: list[tuple[str, str]]) -> list[str]:
        return [c for c, k in pairs if c not in log_b.ONCE or not self.warned(c, k)]

    def take(self, r: dict) -> dict | None:
        """What a record tells (see _TOLD); None if nothing, or if it was taken before."""
        s = self.s
        if r["line_number"] <= s["line"]:
            return None
        s["line"] = r["line_number"]
        pairs = [(c["code"], c["key"] or "") for c in r["codes"] or []]
        if (meta := r["meta"]) is not None and not s["meta_line"]:
            if r["own"] is None or meta["thread"] is None or meta["thread"] == r["own"]:
                s |= {"meta_line": r["line_number"], "thread": meta["thread"], "session": meta["session"], "version": meta["version"], "meta_provider": meta["provider"], "meta_auth": meta["auth"]}
                if meta["version"] is None:
                    pairs.append(("codex_missing_client_version", ""))
            else:
                pairs.append(("codex_primary_session_meta_missing", ""))
        if r["model"] is not None:
            s["model"] = r["model"]
        if r["provider"] is not None:
            s |= {"provider": r["provider"], "provider_line": r["line_number"]}
        if r["auth"] is not None:
            s |= {"auth": r["auth"]["v"], "auth_line": r["line_number"]}
        for name in ("tier", "window"):
            if r[name] is not None:
                s[name] = r[name]["v"]
        out = None
        if (now := r["now"]) is not None:
            out = self._count(r, now, pairs)
        codes = self._codes(pairs)
        if out is None and not codes:
            return None
        return (out or {}) | {"source_id": r["source_id"], "line_number": r["line_number"], "codes": codes}

    def _count(self, r: dict, now: dict, pairs: list[tuple[str, str]]) -> dict:
        s, known = self.s, self.s["meta_line"] > 0
        reset, billable, delta = advance(s["before"], now)
        event = billable and r["occurred_at"] is not None
        epoch = s["epoch"] + reset
        if reset:
            pairs.append(("codex_counter_reset", ""))
        if event or not billable:
            s |= {"before": now, "epoch": epoch}
        else:
            pairs.append(("codex_invalid_usage_timestamp", ""))
        if event:
            s["event_index"] += 1
            parts = delta["cached_tokens"] + delta["w5m"] + delta["w1h"] + delta["w_other"]
            judged = {"codex_usage_without_session_meta": not known, "codex_usage_without_model_context": s["model"] is None, "codex_invalid_input_subsets": parts > delta["input_tokens"], "codex_invalid_reasoning_subset": delta["reasoning_tokens"] > delta["output_tokens"]}
            pairs += [(c, "") for c, bad in judged.items() if bad]
        by_meta = s["meta_auth"] is not None and s["meta_line"] > s["auth_line"]
        own = (s["session"] or s["thread"]) if known else None
        return {
            "occurred_at": r["occurred_at"], "now": now, "delta": delta, "reset": reset, "billable": billable, "event": event, "epoch": epoch, "event_index": s["event_index"], "_session": own or r["own"] or r["name"], "_known": known, "client_version": s["version"], "raw_model": s["model"],
            "provider": s["meta_provider"] if s["meta_line"] > s["provider_line"] else s["provider"], "service_tier": s["tier"], "auth_mode": s["meta_auth"] if by_meta else s["auth"], "_auth_said": by_meta or s["auth_line"] > 0, "context_window": s["window"],
        }


def _plain(value):
    """Rows and dictionaries of them as dictionaries."""
    return {k: _plain(v) for k, v in (value.asDict() if isinstance(value, Row) else value).items()} if isinstance(value, Row | dict) else value


def _tuple(value, kind: T.StructType) -> tuple:
    return tuple(_tuple(value[f.name], f.dataType) if isinstance(f.dataType, T.StructType) and value[f.name] is not None else value[f.name] for f in kind.fields)


class LogProcessor(StatefulProcessor):
    """Fold of each log over micro-batches: a value state for the fold, a map state for the codes that a log gets once. A log without lines for `expiry_ms` is forgotten."""

    def __init__(self, expiry_ms: int | None):
        self.expiry = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fold = handle.getValueState("fold", _STATE, ttlDurationMs=self.expiry)
        self.given = handle.getMapState("given", _KEYED, _SINCE, ttlDurationMs=self.expiry)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        def warned(code: str, k: str) -> bool:
            if self.given.containsKey((code, k)):
                return True
            self.given.updateValue((code, k), (fold.s["line"],))
            return False

        state = self.fold.get()
        fold = Fold(None if state is None else dict(zip(_STATE.names, state, strict=True)) | {"before": _before(state[_STATE.names.index("before")])}, warned)
        for r in sorted((_plain(x) for x in rows), key=lambda x: x["line_number"]):  # a batch's lines of one log
            told = fold.take(r)
            if told is not None:
                yield Row(**(dict.fromkeys(_TOLD.names) | told))
        self.fold.update(_tuple(fold.s, _STATE))

    def close(self) -> None:
        pass


def _before(value) -> dict | None:
    return None if value is None else dict(zip(_COUNTS.names, value, strict=True))


def record_stream(lines: DataFrame, expiry: str | None = None) -> DataFrame:
    """Deltas and codes of a stream of client B's lines (source_id, path, line_number, text), resumed over micro-batches cut anywhere.

    A source's lines arrive in order, or again. With an expiry in milliseconds a
    log that is silent for so long is forgotten, and begins anew. observed_stream
    gives the observations. Needs the RocksDB state store.
    """
    name = F.regexp_replace(F.regexp_extract("path", r"([^/\\]*)$", 1), r"(\.zst)+$", "")
    rows = log_b.records(lines).withColumns({"own": log_b.file_thread(F.col("path")), "name": name}).drop("path")
    processor = LogProcessor(int(expiry) if expiry else None)
    return rows.groupBy("source_id").transformWithState(statefulProcessor=processor, outputStructType=_TOLD, outputMode="append", timeMode="processingTime" if expiry else "none")


def observed_stream(told: DataFrame) -> DataFrame:
    """The observations of record_stream's rows."""
    return log_b.observed(log_b.judged(told.withColumn("_profile", F.lit(None).cast("string"))))


DELTAS = "source_id string, line_number long, delta_input long, delta_output long, epoch long"
_LAST = "line long, input long, output long, epoch long"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Deltas of one log's new lines; the state is its last line, counters and epoch."""
    line, last_in, last_out, epoch = state.get if state.exists else (0, 0, 0, 0)
    rows = []
    for row in pd.concat(list(batches)).sort_values("line_number").itertuples():
        if row.line_number <= line:  # delivered again
            continue
        reset = row.input_tokens < last_in or row.output_tokens < last_out
        epoch += reset
        d_in, d_out = row.input_tokens - (0 if reset else last_in), row.output_tokens - (0 if reset else last_out)
        line, last_in, last_out = row.line_number, row.input_tokens, row.output_tokens
        if d_in or d_out:
            rows.append((key[0], int(line), int(d_in), int(d_out), int(epoch)))
    state.update((int(line), int(last_in), int(last_out), int(epoch)))
    yield pd.DataFrame(rows, columns=["source_id", "line_number", "delta_input", "delta_output", "epoch"])


def stream_deltas(lines: DataFrame) -> DataFrame:
    """Differences of (source_id, line_number, input_tokens, output_tokens), resumed over micro-batches; a source's lines arrive in order."""
    return lines.groupBy("source_id").applyInPandasWithState(_advance, DELTAS, _LAST, "append", GroupStateTimeout.NoTimeout)


def without_repeats(observations: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first observation of each event within the delay; the exact fold of copies stays a batch job."""
    return observations.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["client", "event_key"])


def daily_usage(observations: DataFrame, zone: str, delay: str = "1 day") -> DataFrame:
    """Requests and tokens of each local day, client and model, updated as observations arrive."""
    local = observations.withColumn("local_ts", F.from_utc_timestamp("occurred_at", zone)).withWatermark("local_ts", delay)
    sums = local.groupBy(F.window("local_ts", "1 day"), "client", "raw_model").agg(F.count("*").alias("requests"), F.sum("input_tokens_total").alias("input_tokens_total"), F.sum("output_tokens_total").alias("output_tokens_total"))
    return sums.select(F.to_date("window.start").alias("day"), "client", "raw_model", "requests", "input_tokens_total", "output_tokens_total")
