"""WARC files, transcripts and the pipeline."""

import gzip
import hashlib
import io
import itertools
import os
import random
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from usagebook.llm import registry, transcripts, warc

PAGES = [
    (1, "http://a/1", "<p>" + "same body " * 200), (5, "http://a/5", "<p>" + "same body " * 200), (3, "http://a/3", "<p>" + "same body " * 200),
    (6, "http://a/6", "short"), (7, "http://a/7", "short"), (8, None, None), (9, "http://a/9", ""), (None, "http://a/x\r\nX: y", "<p>" + "same body " * 200),
    (11, "u", "é" * 700), (12, "u", "é" * 700), (12, "u", "é" * 700), (13, "u", "z" * 200_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 1, "x") for p in PAGES], "page_id long, url string, html string, digest int, record_type string").repartition(3)


def test_warc_round_trip(spark, pages, tmp_path):
    files = warc.write_warc(pages, str(tmp_path / "w"))
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": [p[0] for p in PAGES], "html": [p[2] for p in PAGES]}))
    want = sorted(con.execute(warc.SQL).fetchall(), key=repr)
    for split in (7, 100, 1000, warc.SPLIT):
        got = warc.read_warc(files, split=split).collect()
        assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=repr) == want, split
    by = {r.page_id: r for r in got if r.page_id is not None}
    assert bytes(by[13].payload).decode() == "z" * 200_000 and by[1].payload is None and by[1].refers_to == 5
    assert warc.read_warc(warc.write_warc(pages.where("1 = 0"), str(tmp_path / "none"))).count() == 0
    # any gzip reader can read a file from end to end
    whole = b"".join(gzip.open(p).read() for p in sorted(Path(tmp_path / "w").glob("*.gz")))
    assert whole.count(b"WARC/1.1\r\n") == len(PAGES) and b"\r\nX: y" not in whole


def test_warc_revisits_by_a_join(spark, pages, tmp_path, monkeypatch):
    """The records are the same where repeated payloads are too many to broadcast."""
    want = sorted(warc.with_revisits(pages).collect(), key=repr)
    monkeypatch.setattr(warc, "BROADCAST_HEADS", 0)
    assert sorted(warc.with_revisits(pages).collect(), key=repr) == want


def test_ranges_own_each_record_once():
    rng = random.Random(9)
    payloads = [bytes(rng.randrange(32, 127) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    payloads[7] = warc.member(b"WARC/1.1\r\n\r\n") + warc.MAGIC * 5  # looks like members; it is stored compressed
    data = b"".join(warc.member(warc.record(k, "u", p, hashlib.sha1(p).hexdigest(), None, warc.DATE)) for k, p in enumerate(payloads))
    for step in (1, 13, 250, 5000):
        got = [warc.parsed(*r) for s in range(0, len(data), step) for r in warc.records(warc.Range(io.BytesIO(data), s), s, s + step)] if step > 1 else None
        if got is not None:
            assert [g["page_id"] for g in got] == list(range(60)) and [g["payload"] for g in got] == payloads
    with pytest.raises(ValueError):
        warc.parsed({"warc-type": "response", "warc-payload-digest": "sha1:" + "A" * 32}, b"HTTP/1.1 200 OK\r\n\r\nbody")


MODEL = [[("system", "System: be kind\n\n"), ("user", "User: hello there?\nmore\n\n"), ("assistant", "Assistant: hi\nline\n\n"), ("user", "and this?\n\n"), ("assistant", "Assistant: yes\n\n")]] * 30


def test_viterbi_against_all_paths():
    model = transcripts.RoleModel(MODEL)
    rng = np.random.default_rng(1)
    for n in (1, 2, 4):
        scores = rng.normal(size=(n, transcripts.STATES))
        value = lambda path, before: (model.start if before is None else model.step[before])[path[0]] + sum(model.step[a, b] for a, b in itertools.pairwise(path)) + sum(scores[i, s] for i, s in enumerate(path))  # noqa: B023, E731
        paths = list(itertools.product(range(transcripts.STATES), repeat=n))
        ends = model.ends(scores)
        for before in (None, 0, 4):
            best = max(paths, key=lambda p: value(p, before))  # noqa: B023
            assert value(tuple(model.decode(scores, before)), before) == pytest.approx(value(best, before))
            for last in range(transcripts.STATES):
                fixed = max((p for p in paths if p[-1] == last), key=lambda p: value(p, before))  # noqa: B023
                assert value(tuple(model.decode(scores, before, last)), before) == pytest.approx(value(fixed, before))
                assert ends[transcripts.STATES if before is None else before, last] == pytest.approx(value(fixed, before))


def test_parts_decode_as_the_whole(spark):
    """A conversation spread over tasks gets the states of the whole."""
    model = transcripts.RoleModel(MODEL)
    noise = np.random.default_rng(6)  # so that no two paths score the same
    model.step = model.step + noise.normal(scale=0.05, size=model.step.shape)
    model.features = [f + noise.normal(scale=0.05, size=f.shape) for f in model.features]
    rng = random.Random(3)
    turns = []
    for k in range(400):
        role = ("user", "assistant")[k % 2]
        mark = {"user": "User: ", "assistant": "Assistant: "}[role] if rng.random() < 0.6 else ""
        turns.append((1, k, mark + rng.choice(["why so?", "long " * 60, "fine\nmore", "", "\n"]) + ("\n\n" if rng.random() < 0.8 else "")))
    rows = [*turns, (2, 0, "User: a\n\n"), (2, 1, "Assistant: b\n\n"), (None, 0, "User: alone"), (None, 0, "Assistant: alone too"), (3, None, ""), (3, 1, None), (2, 1, "Assistant: b\n\n")]
    frame = spark.createDataFrame([(c, p, t or "") for c, p, t in rows], "conv_id long, position long, raw string").repartition(5)
    got = transcripts.recover_roles(frame, model).collect()
    assert len(got) == len(rows)
    lines, seen, _ = transcripts.observed([t for _, _, t in turns], True)
    rendered, roles, begun = transcripts.render(lines, model.decode(model.scores(seen)))
    mine = {r.position: (r.rendered, r.role_pred, r.n_turns) for r in got if r.conv_id == 1}
    assert mine == {k: (rendered[k], roles[k], begun[k]) for k in range(400)}
    assert [r.n_turns for r in got if r.conv_id is None] == [1, 1]
    assert transcripts.recover_roles(frame.where("1 = 0"), model).count() == 0


def test_chat_format_recovers_roles(spark, sf):
    """On conversations that weren't learned from, and there on turns without a marker alone."""
    shown = transcripts.transcripts(spark.read.parquet(f"{sf}/conversations.parquet")).collect()
    truth = {(r.conv_id, r.position): r for r in shown}
    got = transcripts.op10_chat_format(spark, sf).collect()
    assert len(got) == len(truth)
    held_out = [r for r in got if zlib.crc32(str(r.conv_id).encode()) % 5 == 0]
    right = lambda rows: np.mean([truth[r.conv_id, r.turn].role == r.role_pred for r in rows])
    bare = [r for r in held_out if transcripts.split_marker(truth[r.conv_id, r.turn].raw)[0] == 0]
    print(f"held out {len(held_out)}: {right(held_out):.4f}; unmarked {len(bare)}: {right(bare):.4f}")
    assert right(held_out) > 0.97 and right(bare) > 0.8
    assert all(r.rendered.startswith("<|") for r in got if r.n_turns)


def test_turns_keep_their_inner_lines():
    text = "User: run this\n    x = 1\n\n    A: print(x)\n<|user|> is a tag\n\n"
    lines, seen, _ = transcripts.observed([text], True)
    rendered, roles, begun = transcripts.render(lines, np.array([1, 4, 4, 4]))
    assert rendered == ["<|user|>\nrun this\n    x = 1\n\n    A: print(x)\n<\\|user|> is a tag\n"]
    assert roles == ["user"] and begun == [1] and len(seen) == 4


def test_transcripts_edges(spark):
    """Null texts, turns, roles and ids, and columns of the names that are made here."""
    rows = [(1, 0, "user", None, "x"), (1, None, "assistant", "hi", "y"), (None, 2, None, "who?", "z"), (1, 0, "user", None, "x"), (2, 3, "robot", "  \n", None)]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, raw string")
    shown = transcripts.transcripts(talk)
    assert shown.columns == ["conv_id", "position", "role", "raw"] and shown.count() == len(rows) and shown.where("raw is null").count() == 0
    got = transcripts.recover_roles(shown.select("conv_id", "position", "raw"), transcripts.train(shown)).collect()
    assert sorted((r.conv_id or -1, r.position or -1) for r in got) == sorted((c or -1, t or -1) for c, t, *_ in rows)
    assert transcripts.recover_roles(shown.where("1 = 0").select("conv_id", "position", "raw"), transcripts.train(shown.where("1 = 0"))).count() == 0


def test_chat_training_is_bounded(spark, monkeypatch):
    """By bytes; long conversations are learned whole or not at all."""
    seen = []
    monkeypatch.setattr(transcripts, "RoleModel", seen.append)
    monkeypatch.setattr(transcripts, "TRAIN_BYTES", 50_000)
    rows = [(c, t, ("user", "assistant")[t % 2], "word " * 10) for c in range(40) for t in range(100)] + [(1000, t, "user", "w" * 1000) for t in range(200)]
    transcripts.train(transcripts.transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert seen[0] and all(len(c) == 100 for c in seen[0]) and sum(len(t.encode()) for c in seen[0] for _, t in c) <= 50_000


def test_markers():
    for line, want in (("User: x", (2, "x")), ("### Response: y", (3, "y")), ("<|system|>z", (1, "z")), ("**A**: w", (3, "w")), ("Utter: no", (0, "Utter: no")), ("AI: ok", (3, "ok"))):
        assert transcripts.split_marker(line) == want


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    benchmark = [set(r.text.lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before, gone = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.columns == docs.columns
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        gone[name] = [r for r in before.collect() if r.doc_id not in kept]
        before = after
    assert all(not any(c.isalpha() for c in r.text) for r in gone["language_id"])
    kept = {r.text.lower() for r in before.collect()}
    assert len(kept) == before.count()
    for r in gone["decontaminate"]:
        assert any(len(b & set(r.text.lower().split())) > 0.6 * len(b) for b in benchmark)
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == {r.doc_id for r in before.collect()} and all(n >= 0 for n in got.values())


def test_every_operator_is_registered():
    assert {q.split("_")[0] for q in registry.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert os.path.exists(corpus_pipeline.__file__)
