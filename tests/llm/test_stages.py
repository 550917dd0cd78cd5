"""Every stage of the pipeline against a plain version, and the bounds of the near copies' exact part."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from usagebook.llm import components, langid, near_dedup, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EXTRA = ("_id", "_sha", "_sum", "__sum", "_gone_id", "_gone_hash", "id", "component", "text_hash", "kept", "_crc")


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    item = " ".join(word() for _ in range(14))
    base = [" ".join(word() for _ in range(rng.randint(30, 60))) for _ in range(12)]
    rows = []
    for k, text in enumerate(base):
        rows += [(10 * k + 1, text), (10 * k + 2, text.upper()), (10 * k + 3, text + " tail"), (10 * k + 4, " ".join(reversed(text.split())))]
    rows += [(900, base[0] + " " + item), (901, item), (902, " ".join(word() for _ in range(20)) + " " + item.upper() + " " + " ".join(word() for _ in range(20))), (903, None), (904, ""), (905, "123 456 !!"), (906, None), (None, base[1]), (None, "alone without any id at all here"), (907, "few"), (908, "FEW"), (909, "word " * 30_000)]
    return rows + rows[:3] + [rows[-8]], item


def plain_exact(rows):
    keep = {}
    for i, t in rows:
        key = (t or "").translate(LOWER)
        keep[key] = max(keep.get(key, (-1, None)), (-1 if i is None else i, i), key=lambda x: x[0])
    return sorted({(i, t) for i, t in rows if keep[(t or "").translate(LOWER)][1] == i}, key=repr)


def plain_near(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    top = list(range(len(rows)))
    for _ in rows:
        for a, b in itertools.combinations(range(len(rows)), 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                top[a] = top[b] = min(top[a], top[b])
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top[k]] = min((x for x in (least.get(top[k]), i) if x is not None), default=None)
    return sorted([r for k, r in enumerate(rows) if r[0] == least[top[k]] or least[top[k]] is None], key=repr)


@pytest.fixture(scope="module")
def given(spark):
    rows, item = corpus(random.Random(12))
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return rows, item, spark.createDataFrame([(*r, "en", "s", *EXTRA) for r in rows], schema).repartition(3)


def result(after, before):
    assert after.columns == before.columns
    found = after.collect()
    assert all(tuple(r[c] for c in EXTRA) == EXTRA for r in found)
    return sorted(((r.doc_id, r.text) for r in found), key=repr)


def test_stages_equal_plain_versions(spark, sf, given):
    rows, item, docs = given
    stages = dict(corpus_pipeline.STAGES)
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert result(stages["language_id"](spark, docs, sf), docs) == sorted(kept, key=repr)
    assert result(stages["exact_dedup"](spark, docs, sf), docs) == plain_exact(rows)
    unique = plain_exact(rows)
    few = spark.createDataFrame([(*r, "en", "s", *EXTRA) for r in unique], docs.schema)
    assert result(stages["near_dedup"](spark, few, sf), few) == plain_near(unique)
    wanted = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    from usagebook.llm.decontamination import clean_documents

    clean = result(clean_documents(docs, wanted), docs)
    assert clean == sorted([r for r in rows if item not in (r[1] or "").translate(LOWER)], key=repr)
    ids = stages["sentencepiece"](spark, docs, sf).collect()
    assert len(ids) == len(rows) and all(r.n_tokens == len(r.ids) for r in ids) and all(r.ids == [] for r in ids if r.doc_id in (903, 904))


def test_stages_take_an_empty_table(spark, sf, given):
    none = given[2].where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_frequent_shingles_are_bounded(spark):
    counts = spark.range(5000).select(F.col("id").alias("shingle"), F.lit(20_000).cast("long").alias("n")).union(spark.range(5000, 5300).select("id", F.lit(40).cast("long")))
    for most in (0, 100, 1000, 5200, 10_000):
        hashes, n = near_dedup.frequent(counts, most)
        assert len(hashes) == len(n) <= most and (np.diff(hashes.view(np.int64)) > 0).all()
        assert len(hashes) >= min(0.9 * most, 5000)
    assert len(near_dedup.frequent(counts, 10_000)[0]) == 5300 and (near_dedup.frequent(counts, 1000)[1] == 20_000).all()


def test_cells_let_all_components_meet(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(6)
    rows = [(1, k, 0 if k < 60 else rng.randrange(1, 30)) for k in range(100)] + [(2, k, 7) for k in range(90)] + [(3, k, k) for k in range(40)] + [(4, k, k % 2) for k in range(5)]
    entries = spark.createDataFrame([(*r, 0, 9) for r in rows], "shingle long, id long, component long, place int, size int")
    cells = {}
    for r in near_dedup.in_cells(entries).collect():
        cells.setdefault((r.shingle, r.cell), []).append((r.id, r.component))
    met = {(s, *sorted((a[0], b[0]))) for (s, _), own in cells.items() for a, b in itertools.combinations(own, 2) if a[1] != b[1]}
    want = {(s, *sorted((a, b))) for s, a, x in rows for t, b, y in rows if s == t and a < b and x != y}
    assert met == want and not any(s == 2 for s, _ in cells)  # one component has nothing to compare
    assert sum(len(own) for (s, _), own in cells.items() if s == 1) < 100 * 100 / 8


def test_components_of_a_star(spark, monkeypatch):
    """One centre of very many edges, over rounds of joins."""
    monkeypatch.setattr(components, "EDGES_PER_TASK", 500)
    edges = spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).union(spark.range(5000, 5900).select("id", F.col("id") + 1)).repartition(7)
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {k: 0 for k in range(3000)} | {k: 5000 for k in range(5000, 5901)}


def test_rows_that_repeat_id_and_text_are_divided(spark, tmp_path):
    docs = spark.createDataFrame([(None, None)] * 4000, "doc_id long, text string").repartition(4)
    files = token_files.write_token_files(docs, str(tmp_path / "t")).collect()
    assert len(files) > 1 and sum(f.n_tokens for f in files) == 4000


def test_language_scores_are_the_same_by_table_and_by_search(monkeypatch):
    rng = random.Random(1)
    texts = [(lang, " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(80))) for lang, letters in (("a", "abcde"), ("b", "cdefé"), ("c", "xyzab")) for _ in range(20)]
    table = langid.ContextTrees(texts)
    monkeypatch.setattr(langid, "TABLE_BYTES", 0)
    search = langid.ContextTrees(texts)
    assert table.longest is not None and search.longest is None
    from usagebook.llm.textvec import as_bytes

    import pyarrow as pa

    column = as_bytes(pa.array([t for _, t in texts] + ["unseen Ω letters", ""]))
    assert (table.lengths(*column) == search.lengths(*column)).all()
