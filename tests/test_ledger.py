"""The ledger that grows by merging."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from usagebook.functions.values import COUNTERS
from usagebook.operators import ledger
from usagebook.plans import views

OWN = ("client", "source_id", "event_key", "occurred_at", "session_id", "raw_model", "provider", *COUNTERS, "coverage", "quality_rank", "service_tier")


@pytest.fixture(scope="module")
def seen(spark, sf):
    rows = views.view(spark, sf, views.OBSERVATIONS).where("line_number % 5 = 0").withColumn("speed", F.lit(None).cast("string"))
    return rows.cache()


def rows(df):
    return sorted((tuple(r) for r in df.select(*OWN).collect()), key=repr)


def test_runs_over_parts_equal_one_over_all(spark, tmp_path, seen):
    """Events grow from run to run; a run over everything at once gives the same ledger."""
    path = str(tmp_path / "l")
    assert ledger.read(spark, path) is None
    early = seen.withColumns({c: F.floor(F.col(c) / 3).cast("long") for c in COUNTERS} | {"coverage": F.lit("partial"), "raw_model": F.when(F.col("quality_rank") > 1, F.col("raw_model")).otherwise("unknown"), "service_tier": F.lit("old")})
    runs = [early, seen.where("line_number % 2 = 0"), seen.where("line_number % 2 = 1"), early]
    born = seen.select("source_id").distinct().withColumn("born", F.date_add(F.lit("2026-01-01").cast("date"), F.pmod(F.xxhash64("source_id"), F.lit(4)).cast("int")))
    for k, new in enumerate(runs):
        ledger.merge(spark, path, new, born, k + 1)
    every = None
    for k, new in enumerate(runs):
        new = new.withColumn("run", F.lit(k + 1).cast("long"))
        every = new if every is None else every.unionByName(new)
    assert rows(ledger.read(spark, path)) == rows(ledger.merged(every))
    assert {r.raw_model for r in ledger.read(spark, path).collect()} == {r.raw_model for r in seen.collect()}


def test_formulas_of_clients(spark):
    base = {c: 0 for c in COUNTERS}
    one = lambda client, run, coverage, **more: (client, "s", "e", run, coverage, 1, f"t{run}", *(base | more).values())
    given = [one("claude_code", 1, "complete", input_tokens_uncached=5, cache_write_5m_tokens=4), one("claude_code", 2, "partial", input_tokens_uncached=7, cache_write_1h_tokens=3, cache_write_unknown_tokens=2), one("openai_codex", 1, "partial", input_tokens_total=50, input_tokens_cached=10), one("openai_codex", 2, "partial", input_tokens_total=60, cache_write_unknown_tokens=8)]
    frame = spark.createDataFrame(given, "client string, source_id string, event_key string, run long, coverage string, quality_rank int, service_tier string, " + ", ".join(f"{c} long" for c in COUNTERS))
    frame = frame.withColumns({"occurred_at": F.timestamp_seconds(F.lit(100) - F.col("run")), "session_id": F.lit("x"), "raw_model": F.lit("m"), "provider": F.lit("p")})
    a, b = sorted(ledger.merged(frame).collect(), key=lambda r: r.client)
    assert (a.input_tokens_total, a.cache_write_5m_tokens, a.cache_write_1h_tokens, a.cache_write_unknown_tokens, a.coverage, a.service_tier) == (14, 4, 3, 0, "complete", "t1")
    assert (b.input_tokens_total, b.input_tokens_uncached, b.cache_write_unknown_tokens, b.coverage, b.service_tier) == (60, 42, 8, "partial", "t2")


def test_only_touched_parts_are_written_and_the_manifest_decides(spark, tmp_path, seen):
    path = tmp_path / "l"
    sources = sorted(r.source_id for r in seen.select("source_id").distinct().collect())
    born = spark.createDataFrame([(s, f"2026-01-{k % 20 + 1:02d}") for k, s in enumerate(sources)], "source_id string, born string")
    ledger.merge(spark, str(path), seen, born, 1)
    before = rows(ledger.read(spark, str(path)))
    grown = seen.where(F.col("source_id") == sources[0]).withColumn("output_tokens_total", F.col("output_tokens_total") + 1)
    clients = grown.select("client").distinct().count()
    wrote = ledger.merge(spark, str(path), grown, born, 2)
    folders = lambda run: [p for p in Path(path / "data" / f"written={run}").rglob("*.parquet")]
    assert wrote.count() == clients and len({p.parent for p in folders(2)}) == clients < len({p.parent for p in folders(1)})
    after = rows(ledger.read(spark, str(path)))
    assert len(after) == len(before) and after != before
    # a run that died before its manifest is as if it had not been
    ledger.merged(seen.withColumns({"run": F.lit(3).cast("long"), "born": F.lit("2026-01-01").cast("date"), "part": F.lit(0)})).withColumn("written", F.lit(3).cast("long")).write.partitionBy("written", *ledger.PART).mode("append").parquet(str(path / "data"))
    assert rows(ledger.read(spark, str(path))) == after


def test_a_run_grows_the_ledger_from_logs(spark, tmp_path):
    """A log that grows is merged into its part; one that is rewritten is replaced; the day a source was first seen stays."""
    import json
    from datetime import date

    from usagebook.plans import jobs

    logs, path = tmp_path / "projects", str(tmp_path / "ledger")
    logs.mkdir()
    line = lambda k, n: json.dumps({"type": "assistant", "timestamp": f"2026-07-10T13:00:{k:02d}Z", "sessionId": "s", "message": {"id": f"m{k}", "model": "x", "usage": {"input_tokens": n, "output_tokens": 1}}}) + "\n"
    (logs / "a.jsonl").write_text(line(1, 10) + line(2, 20))
    (logs / "b.jsonl").write_text(line(3, 30))
    roots = {"claude_code": str(tmp_path)}
    jobs.ledger_run(spark, roots, path, 1, date(2026, 7, 10))
    (logs / "a.jsonl").write_text(line(1, 10) + line(2, 20) + line(2, 25) + line(4, 40))
    run, wrote = jobs.ledger_run(spark, roots, path, 2, date(2026, 7, 11))
    assert [str(r.born) for r in wrote.collect()] == ["2026-07-10"] and run.fresh.count() == 3
    assert sorted(r.input_tokens_total for r in ledger.read(spark, path).collect()) == [10, 25, 30, 40]
    (logs / "a.jsonl").write_text(line(5, 1))
    jobs.ledger_run(spark, roots, path, 3, date(2026, 7, 12))
    assert sorted(r.input_tokens_total for r in ledger.read(spark, path).collect()) == [1, 30]
    (logs / "a.jsonl").write_text('{"type": "user"}\n')  # shorter than before, and without any usage
    jobs.ledger_run(spark, roots, path, 4, date(2026, 7, 13))
    assert sorted(r.input_tokens_total for r in ledger.read(spark, path).collect()) == [30]


def test_runs_of_a_part_are_written_without_a_shuffle_and_merged_when_many(spark, tmp_path, seen, monkeypatch):
    """Runs are appended as they were read; the run after MOST_RUNS of them makes them one, and a part of one merged run is read as it is."""
    monkeypatch.setattr(ledger, "MOST_RUNS", 2)
    path = str(tmp_path / "l")
    born = seen.select("source_id").distinct().withColumn("born", F.lit("2026-01-01").cast("date"))
    kept = born.where("source_id > 's5'").cache()
    shuffled = lambda df: df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(client")
    runs = [seen.where(f"line_number % 3 = {k % 3}").withColumn("quality_rank", F.lit(k)) for k in range(5)]
    for k, new in enumerate(runs[:4]):
        ledger.merge(spark, path, new, born, k + 1)
        found = ledger._manifest(spark, path)
        assert found.groupBy(*ledger.PART).count().agg(F.max("count")).first()[0] == (1, 2, 1, 2)[k]
        assert shuffled(ledger.read(spark, path)) == (k != 2)
    every = lambda n: [new.withColumn("run", F.lit(k + 1).cast("long")) for k, new in enumerate(runs[:n])]
    union = every(4)[0].unionByName(every(4)[1]).unionByName(every(4)[2]).unionByName(every(4)[3])
    assert rows(ledger.read(spark, path)) == rows(ledger.merged(union))
    # of rewritten sources only what the run read anew is left, whatever runs the part has
    ledger.merge(spark, path, runs[4].where("source_id > 's7'"), born, 5, kept.select("source_id"))
    union = union.join(kept, "source_id", "left_anti").unionByName(every(5)[4].where("source_id > 's7'"))
    assert rows(ledger.read(spark, path)) == rows(ledger.merged(union))
    with pytest.raises(ValueError, match="follow"):
        ledger.merge(spark, path, seen, born, 5)


def test_overlaps_by_sweep_equal_all_pairs(spark):
    import itertools
    import random

    from usagebook.operators.catalog import overlapping

    rng = random.Random(4)
    given = [(f"i{k:03d}", rng.choice(["a", "b", None]), rng.randint(0, 30), rng.choice([None, 5, 12, 31, 40])) for k in range(120)] + [("i000", "a", 3, 9)]
    found = overlapping(spark.createDataFrame(given, "id string, k string, effective_from int, effective_to int").repartition(3), ["k"])
    got = sorted((r.a_id, r.b_id) for r in found.collect())
    meet = lambda x, y: (y[3] is None or x[2] < y[3]) and (x[3] is None or y[2] < x[3])
    assert got == sorted(tuple(sorted((x[0], y[0]))) for x, y in itertools.combinations(given, 2) if x[1] == y[1] and x[0] != y[0] and meet(x, y))
