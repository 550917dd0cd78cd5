"""Logs by byte ranges."""

import json
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from usagebook.sources import common, log_b, ranges


def plain(raw):
    """(line, first byte, end byte, text) of complete lines, and where an incomplete last one starts."""
    out, at = [], 0
    while (cut := raw.find(b"\n", at)) >= 0:
        out.append((len(out) + 1, at, cut + 1, raw[at:cut].removesuffix(b"\r").decode("utf-8", "replace")))
        at = cut + 1
    return out, at if at < len(raw) else None


CONTENTS = [b"", b"\n", b"one", b"one\n", b"a\n\n\nb\r\nlast without end", "é\n日本\n🎉x\n".encode() * 5, b"x" * 500 + b"\n" + b"y" * 70 + b"\n", b"\n" * 40, b"\xff\xfe\n" * 3, b"tail " * 100]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("with space")
    for k, raw in enumerate(CONTENTS):
        (root / f"{k}.jsonl").write_bytes(raw)
        (root / f"{k}z.jsonl.zst").write_bytes(zstandard.compress(raw[: len(raw) // 2]) + zstandard.compress(raw[len(raw) // 2 :]))
    return common.listed_files(spark, [str(root)], "*.jsonl*")


@pytest.mark.parametrize("step", [1, 7, 64, ranges.RANGE])
def test_every_record_is_read_once_with_its_place(files, step, monkeypatch):
    monkeypatch.setattr(ranges, "READ", 5 if step < 64 else 1 << 20)
    lines, facts = ranges.read_ranges(files, step)
    got, tails = {}, {}
    for r in lines.collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.line_number, r.byte_start, r.byte_end, r.text))
    for r in facts.where("tail is not null").collect():
        tails[r.path.rsplit("/", 1)[1]] = r.tail
    for k, raw in enumerate(CONTENTS):
        for name in (f"{k}.jsonl", f"{k}z.jsonl.zst"):
            want, tail = plain(raw)
            assert sorted(got.get(name, [])) == want and tails.get(name) == tail, (name, step)
    hashes = {r.path.rsplit("/", 1)[1]: r.content_hash for r in ranges.contents(facts).collect()}
    assert len(hashes) == 2 * len(CONTENTS) - 1  # Spark lists no empty file
    assert len({hashes[f"{k}.jsonl"] for k in range(1, len(CONTENTS))}) == len(CONTENTS) - 1


def test_a_range_holds_a_record_at_most(tmp_path):
    """A task that reads a small range of a large file stops behind it."""
    path = tmp_path / "large.jsonl"
    path.write_bytes((b"r" * 99 + b"\n") * 100_000)
    found = list(ranges.owned(f"file://{path}", 5_000_050, 5_000_250))
    assert [(a, b) for a, b, _, _ in found] == [(5_000_100, 5_000_200), (5_000_200, 5_000_300)]


def test_observations_know_their_bytes(spark, tmp_path):
    rng = random.Random(0)
    root = tmp_path / "sessions"
    root.mkdir()
    total, log = 0, [{"type": "session_meta", "payload": {"id": "t", "cli_version": "1"}}, {"type": "turn_context", "payload": {"model": "m"}}]
    for k in range(60):
        total += rng.randint(1, 9)
        log.append({"timestamp": f"2026-07-10T13:00:{k % 60:02d}Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": total, "output_tokens": k}}}})
    raw = "".join(json.dumps(x) + "\n" for x in log).encode() + b'{"type": "event_msg"'
    (root / "rollout-1.jsonl").write_bytes(raw)
    listed = log_b.listed(spark, str(tmp_path))
    found, lines, tails = common.file_lines(listed, step=256)
    seen, warnings = log_b.observations(lines, size=5)
    rows = seen.collect()
    assert len(rows) == 60 and sum(r.input_tokens_total for r in rows) == total
    assert all(json.loads(raw[r.byte_start : r.byte_end])["type"] == "event_msg" and r.line_number == raw[: r.byte_start].count(b"\n") + 1 for r in rows)
    assert [(t.code, t.line_number) for t in tails.collect()] == [("incomplete_tail", 63)] and warnings.count() == 0
    assert found.select(F.col("content_hash").isNotNull()).first()[0]
