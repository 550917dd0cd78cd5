"""Client B's logs: differences that know what was reported, warnings, divided logs, streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from usagebook.operators import ordered
from usagebook.sources import log_b
from usagebook.streaming import logs

T0 = "2026-07-10T13:00:{:02d}Z"


def count(k, usage, time=True, **info):
    return {"timestamp": T0.format(k % 60) if time else "never", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": usage} | info}}


def usage(i, o, **more):
    return {"input_tokens": i, "output_tokens": o} | more


META = {"timestamp": T0.format(0), "type": "session_meta", "payload": {"id": "T1", "cli_version": "0.9", "model_provider": "openai"}}
TURN = {"timestamp": T0.format(0), "type": "turn_context", "payload": {"model": "gpt-alpha"}}


def lines(spark, logs_):
    rows = [(name, f"/h/sessions/{name}.jsonl", k + 1, x if isinstance(x, str) else json.dumps(x)) for name, log in logs_.items() for k, x in enumerate(log)]
    return spark.createDataFrame(rows, "source_id string, path string, line_number long, text string").repartition(3)


def counted(spark, *usages):
    seen, warnings = log_b.observations(lines(spark, {"f": [META, TURN, *[count(k, u) for k, u in enumerate(usages)]]}))
    return sorted(seen.collect(), key=lambda r: r.line_number), [w.code for w in warnings.collect()]


def test_a_counter_that_is_no_longer_reported_is_no_fall(spark):
    rows, codes = counted(spark, usage(100, 10, cache_write_tokens=40), usage(150, 20))
    assert [(r.input_tokens_total, r.cache_write_unknown_tokens, r.cache_write_data_complete) for r in rows] == [(100, 40, True), (50, 0, False)] and codes == []


def test_a_counter_that_begins_to_be_reported_is_no_gain(spark):
    rows, _ = counted(spark, usage(100, 10), usage(150, 20, cache_write_tokens=90), usage(180, 30, cache_write_tokens=95))
    assert [(r.cache_write_unknown_tokens, r.cache_write_data_complete, r.coverage) for r in rows] == [(0, False, "partial"), (0, False, "partial"), (5, True, "partial")]
    assert rows[1].notes == ["cached_input_not_fully_reported", "cache_write_not_reported", "reasoning_output_not_fully_reported"]


def test_reasoning_alone_is_no_event(spark):
    rows, codes = counted(spark, usage(100, 10, reasoning_output_tokens=1), usage(100, 10, reasoning_output_tokens=5), usage(110, 20, reasoning_output_tokens=7))
    assert [(r.input_tokens_total, r.reasoning_output_tokens, r.usage_event_index) for r in rows] == [(100, 1, 1), (10, 2, 2)] and codes == []


def test_a_falling_total_begins_an_epoch(spark):
    rows, codes = counted(spark, usage(100, 10, total_tokens=500), usage(150, 20, total_tokens=170))
    assert [r.input_tokens_total for r in rows] == [100, 150] and codes == ["codex_counter_reset"]
    assert "total_tokens_not_component_additive" in rows[0].notes and "total_tokens_not_component_additive" not in rows[1].notes


def test_specific_writes_take_the_place_of_generic_ones(spark):
    rows, _ = counted(spark, usage(200, 10, cache_write_5m_tokens=30, cache_write_tokens=70, cached_input_tokens=20, reasoning_output_tokens=0))
    assert [(r.cache_write_5m_tokens, r.cache_write_unknown_tokens, r.input_tokens_uncached, r.coverage) for r in rows] == [(30, 0, 150, "complete")]
    rows, codes = counted(spark, usage(5, 1, cache_write_tokens=None, cache_write_input_tokens=3))  # the first name that is present counts
    assert [(r.cache_write_unknown_tokens, r.cache_write_data_complete) for r in rows] == [(0, False)] and codes == []


def test_compaction_is_a_baseline_without_usage(spark):
    rows, codes = counted(spark, usage(100, 10), usage(0, 0, total_tokens=9000), usage(30, 5, total_tokens=9035))
    assert [(r.input_tokens_total, r.output_tokens_total) for r in rows] == [(100, 10), (30, 5)] and codes == ["codex_counter_reset"]


#: A line for each code; where a code is given once a log, the line stands twice.
FAULTY = {
    "codex_blank_record": ["", " \t"], "codex_malformed_record": ["{"], "codex_non_object_record": ["[1]", "3"], "codex_missing_record_type": [{"payload": {}}], "codex_unknown_record_type": [{"type": "novel"}, {"type": "novel"}, {"type": "other"}],
    "codex_invalid_session_meta": [{"type": "session_meta", "payload": 1}], "codex_invalid_turn_context": [{"type": "turn_context"}], "codex_invalid_event_message": [{"type": "event_msg", "payload": None}], "codex_missing_event_type": [{"type": "event_msg", "payload": {}}],
    "codex_invalid_thread_settings": [{"type": "event_msg", "payload": {"type": "thread_settings_applied"}}], "codex_invalid_token_info": [{"type": "event_msg", "payload": {"type": "token_count", "info": 3}}],
    "codex_invalid_context_window": [count(1, usage(1, 1), model_context_window="x"), count(1, usage(1, 1), model_context_window=-1)], "codex_missing_cumulative_usage": [{"type": "event_msg", "payload": {"type": "token_count", "info": {}}}],
    "codex_invalid_cumulative_usage": [count(1, None), count(1, [])], "codex_unsupported_usage_schema": [count(1, usage(-1, 1)), count(1, {"input_tokens": 1}), count(1, usage(1, 1, total_tokens="9"))],
    "codex_format_drift": [count(1, usage(1, 1, new_tokens=3)), count(2, usage(1, 1, new_tokens=4)), count(2, usage(1, 1), extra=1)], "codex_invalid_usage_timestamp": [count(1, usage(9, 9), time=False)],
    "codex_counter_reset": [count(1, usage(9, 9)), count(1, usage(5, 9))], "codex_invalid_input_subsets": [count(1, usage(1, 9, cached_input_tokens=3))], "codex_invalid_reasoning_subset": [count(1, usage(1, 2, reasoning_output_tokens=3))],
}
TIMES = {"codex_non_object_record": 2, "codex_unknown_record_type": 2, "codex_format_drift": 2, "codex_invalid_cumulative_usage": 2, "codex_unsupported_usage_schema": 3}


def test_every_code(spark):
    logs_ = {code: [META, TURN, *faulty] for code, faulty in FAULTY.items()}
    logs_["quiet"] = [META, TURN, {"type": "event_msg", "payload": {"type": "token_count", "info": None}}, {"type": "event_msg", "payload": {"type": "token_count"}}, *[{"type": t} for t in log_b.IGNORED], {"type": "event_msg", "payload": {"type": "said"}}]
    logs_["codex_missing_client_version"] = [{"type": "session_meta", "payload": {"id": "x"}}, {"type": "session_meta", "payload": {"id": "y"}}]
    logs_["codex_usage_without_session_meta"] = [TURN, count(1, usage(1, 1)), count(2, usage(2, 2))]
    logs_["codex_usage_without_model_context"] = [META, count(1, usage(1, 1)), count(2, usage(2, 2))]
    thread = "rollout-2026-11111111-1111-7111-8111-111111111111"
    logs_[thread] = [{"type": "session_meta", "payload": {"id": "parent", "cli_version": "1"}}] * 2 + [{"type": "session_meta", "payload": {"id": thread[-36:].upper(), "cli_version": "1"}}, META]
    _, warnings = log_b.observations(lines(spark, logs_))
    got = {}
    for w in warnings.collect():
        got.setdefault(w.source_id, []).append((w.code, w.line_number))
    assert got.pop(thread) == [("codex_primary_session_meta_missing", 1)] and "quiet" not in got
    assert got.keys() == logs_.keys() - {"quiet", thread}
    for code, found in got.items():
        assert sorted(c for c, _ in found) == [code] * TIMES.get(code, 1), code
    assert got["codex_blank_record"] == [("codex_blank_record", 3)]


def random_logs(seed, n=6, longest=60):
    """Logs whose client starts and stops to report counters, falls, repeats itself, loses times, states and clears its context."""
    rng = random.Random(seed)
    out = {}
    for f in range(n):
        log, totals = [], dict.fromkeys(("input_tokens", "output_tokens", "cached_input_tokens", "reasoning_output_tokens", "cache_write_5m_tokens", "cache_write_tokens", "total_tokens"), 0)
        for _ in range(rng.randint(1, longest)):
            what = rng.random()
            if what < 0.15:
                log.append({"timestamp": T0.format(1), "type": "turn_context", "payload": {k: v for k, v in {"model": rng.choice(["a", "b", None]), "model_provider": rng.choice(["p", None]), "service_tier": rng.choice(["fast", "Standard", None]), "auth_mode": rng.choice(["x", None, 3])}.items() if rng.random() < 0.6}})
            elif what < 0.22:
                log.append({"type": "session_meta", "payload": {k: v for k, v in {"id": rng.choice(["t1", "t2"]), "session_id": "s", "cli_version": "1", "model_provider": "q", "auth_mode": "m"}.items() if rng.random() < 0.6}})
            elif what < 0.3:
                log.append(rng.choice([x for v in FAULTY.values() for x in v]))
            else:
                if rng.random() < 0.15:
                    totals = {k: v // 3 if rng.random() < 0.5 else 0 for k, v in totals.items()}
                elif rng.random() < 0.8:
                    totals = {k: v + rng.choice([0, 0, 1, 7]) for k, v in totals.items()}
                kept = {k: v for k, v in totals.items() if k in ("input_tokens", "output_tokens") or rng.random() < 0.75}
                log.append(count(rng.randint(0, 59), kept, time=rng.random() < 0.7, **({"model_context_window": rng.choice([5, None, "x"])} if rng.random() < 0.2 else {})))
        out[f"rollout-{f}"] = log
    return out


def one_by_one(spark, lines_):
    """Observations and warnings by the fold record by record."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    rows = sorted((logs._plain(r) for r in log_b.records(lines_).withColumns({"own": log_b.file_thread(F.col("path")), "name": name}).collect()), key=lambda r: (r["source_id"], r["line_number"]))
    told, folds = [], {}
    for r in rows:
        if r["source_id"] not in folds:
            given = set()
            folds[r["source_id"]] = logs.Fold(None, lambda c, k, given=given: (c, k) in given or given.add((c, k)) is not None)
        if (x := folds[r["source_id"]].take(r)) is not None:
            told.append(x)
    frame = spark.createDataFrame([logs._tuple(dict.fromkeys(logs._TOLD.names) | x, logs._TOLD) for x in told], logs._TOLD)
    return logs.observed_stream(frame), sorted((x["source_id"], x["line_number"], c) for x in told for c in x["codes"])


def plain(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("size", [1, 4, ordered.SEGMENT])
def test_divided_logs_equal_a_fold_line_by_line(spark, size):
    given = lines(spark, random_logs(size % 17)).cache()
    seen, warnings = log_b.observations(given, size=size)
    want, codes = one_by_one(spark, given)
    assert plain(seen, want.columns) == plain(want, want.columns) and seen.count() > 30
    assert sorted((w.source_id, w.line_number, w.code) for w in warnings.collect()) == codes
    assert {"codex_counter_reset", "codex_invalid_usage_timestamp"} <= {c for *_, c in codes}


def test_one_log_of_all_rows_is_divided(spark):
    """No task of a window gets more than a segment."""
    rows = spark.range(20_000).select(F.lit("f").alias("source_id"), F.col("id").alias("line_number"), (F.col("id") * 3 % 50_000).alias("input_tokens"), F.col("id").alias("cached_tokens"), F.lit(1).alias("output_tokens"))
    whole, parts = ordered.counter_deltas(rows), ordered.counter_deltas(rows, size=500)
    assert plain(whole, whole.columns) == plain(parts, whole.columns)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "_segment" in plan
    marks = rows.withColumn("flag", (F.col("id") if False else F.col("line_number")) % 701 == 0).withColumn("value", F.when(F.col("flag") & (F.col("line_number") % 2 == 0), F.col("line_number")))
    got = ordered.carried(marks, {"value": "flag"}, size=100)
    assert plain(got, ["line_number", "value"]) == sorted(((n, m if (m := n // 701 * 701) % 2 == 0 else None) for n in range(20_000)), key=repr)


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    """Micro-batches cut anywhere, a restart of the query after each, and lines delivered again."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    given = lines(spark, random_logs(3, n=3, longest=25)).cache()
    rows = sorted((tuple(r) for r in given.collect()), key=lambda r: (r[2], r[0]))
    source = tmp_path / "in"
    source.mkdir()
    told = []
    for k, (i, j) in enumerate([(0, 7), (5, 30), (30, len(rows))]):
        (source / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(given.columns, r, strict=True))) for r in rows[i:j]))
        stream = logs.record_stream(spark.readStream.schema(given.schema).json(str(source)))
        stream.writeStream.outputMode("append").foreachBatch(lambda df, _: told.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    frame = spark.createDataFrame(told, logs._TOLD)
    want, codes = one_by_one(spark, given)
    assert plain(logs.observed_stream(frame), want.columns) == plain(want, want.columns)
    assert sorted((r.source_id, r.line_number, c) for r in told for c in r.codes) == codes


def test_a_record_is_parsed_once(spark):
    """The choice of rows is not pushed below the steps that parse a record, where it would parse it hundreds of times."""
    plan = log_b.records(lines(spark, {"f": [META, TURN]}))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
