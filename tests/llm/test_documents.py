"""The operators on documents, held against brute force on small tables."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from usagebook.llm import components, decontamination, exact_dedup, langid, near_dedup, pieces, sharding, textvec, token_files, toxicity
from usagebook.llm.textvec import SpanTable, as_bytes, chunks, spans

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = [
    (1, "The cat sat on the mat. And left", "en", "a"),
    (2, "the CAT sat on the mat. And left", "en", "a"),
    (3, None, "en", None),
    (4, "", None, "b"),
    (5, "Été à la plage, déjà vu", "fr", "b"),
    (6, "ÉTÉ À LA PLAGE, DÉJÀ VU", "fr", "b"),
    (7, "The cat sat on the mat. And left", "en", "a"),
    (7, "The cat sat on the mat. And left", "en", "a"),
    (None, "no identity here at all", "en", "c"),
    (None, None, None, None),
    (8, "x" * 9000, "en", "c"),
    (9, "12345 --- 678", "en", "c"),
    (10, " \t\n ", "de", "c"),
    (11, "日本語 テキスト 😀 emoji", "ja", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty, long, tied and repeated texts, with columns whose names the operators use."""
    extra = "size long, shard int, n_shingles int, key string, kept boolean, ids string, score string"
    rows = [(*r, 5, 1, 2, "k", False, "i", "s") for r in ROWS]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {extra}")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("1 = 0")


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(ROWS)
    groups = collections.defaultdict(list)
    for doc_id, text, *_ in ROWS:
        groups[(text or "").translate(LOWER)].append(doc_id)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
    assert exact_dedup.exact_groups(none).count() == 0


def test_chunks_join_to_the_text(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab .\né") for _ in range(n)) for n in (0, 1, 511, 513, 5000, 20000)] + ["a" * 10000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    out = [r.c for r in df.select(exact_dedup.chunks(df.text).alias("c")).collect()]
    assert ["".join(c) for c in out] == texts
    assert all(len(x) <= exact_dedup.MAX_CHUNK for c in out for x in c)


def test_recipes_by_digest_where_identifiers_collide(spark, docs, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: exact_dedup.F.lit(7))
    got = {(r.doc_id, r.keep_id) for r in exact_dedup.exact_groups(docs.where("doc_id is not null")).collect()}
    assert (1, 7) in got and (5, 5) in got and (4, 10) not in got


def shards_hold(got, rows, shards):
    total = sum(r.size for r in got)
    assert sorted((r.doc_id or -1, r.text_crc32) for r in got) == sorted((i or -1, zlib.crc32((t or "").encode())) for i, t in rows)
    largest = max((r.size for r in got), default=0)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for rows_ in by.values():
        assert sorted(r.slot for r in rows_) == list(range(len(rows_)))
        assert abs(sum(r.size for r in rows_) - total / shards) <= largest


def test_sharding(spark, docs, none):
    shards_hold(sharding.assign_shards(docs).collect(), [(r[0], r[1]) for r in ROWS], 16)
    assert sharding.assign_shards(none).count() == 0
    rows = [(k, "copy" * 20 if k % 3 == 0 else f"text {k} " * (k % 50)) for k in range(3000)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    shards_hold(got, rows, 16)
    assert {r.law for r in got} == {"bytes"}


def test_sharded_files(spark, tmp_path):
    rows = [(k, f"text {k} " * (k % 9)) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assigned = sharding.assign_shards(df, 4).cache()
    sharding.write_shards(df, assigned, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == rows
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in assigned.collect()}


def near_by_force(rows):
    sets, parent = {}, {}
    for doc_id, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.setdefault(doc_id, []).append(frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else []))
        parent[doc_id] = doc_id

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, own in sets.items() for s in own]
    for k, (i, s) in enumerate(flat):
        for j, t in flat[:k]:
            both = len(s & t)
            if s and t and 100 * both >= 80 * (len(s) + len(t) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, sets


def test_near_dedup_against_all_pairs(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for group in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.choice([1, 2, 5, 40 if group < 3 else 3])):
            edited = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 100003, " ".join(edited).upper() if rng.random() < 0.2 else " ".join(edited)))
    rows += [(900001, "one two three"), (900002, "ONE two  three"), (900003, "one two"), (900004, ""), (900005, None), (900006, "one two")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    want, sets = near_by_force(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id][0]) and r.kept == (r.component_id == r.doc_id) for r in got)


def test_near_dedup_in_a_large_group(spark):
    """Of hundreds of near copies some are similar enough to a few of the others only; none may be lost."""
    rng = random.Random(21)
    vocabulary = [f"v{k}" for k in range(500)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for k in range(420):
        edited = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
        rows.append((k, " ".join(edited)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want, _ = near_by_force(rows)
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_dedup_links_tight_groups(spark):
    """Two groups of many near copies each, joined by one link of just over 0.8 between their first texts."""
    rng = random.Random(31)
    rows = []
    for pair in range(6):
        base = [f"p{pair}w{k}" for k in range(300)]
        far = [f"q{pair}w{k}" if k % 36 == 20 else w for k, w in enumerate(base)]
        for first in (base, far):
            for k in range(41):
                edited = list(first)
                for at in rng.sample([x for x in range(300) if x % 36 == 4], 2 if k else 0):
                    edited[at] = f"e{len(rows)}x{at}"
                rows.append((len(rows), " ".join(edited)))
    want, _ = near_by_force(rows)
    assert len(set(want.values())) == 6
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_dedup_edges(docs, none):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert by[(7, 5)] == 1 and by[(3, 0)] == 3 and by[(None, 0)] is None
    assert near_dedup.near_duplicates(none).count() == 0


def test_components(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5100)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7).cache()
    for share in (50, 100_000):
        monkeypatch.setattr(components, "EDGES_PER_TASK", share)
        got = components.connected_components(frame).collect()
        assert {r.node: r.component for r in got} == {n: find(n) for n in parent}
    assert components.connected_components(frame.where("1 = 0")).count() == 0


def test_alignment_against_a_table():
    rng = np.random.default_rng(2)
    items = rng.integers(1, 6, (40, 9)).astype(np.uint64)
    windows = rng.integers(1, 6, (40, 21)).astype(np.uint64)
    lengths, widths = rng.integers(1, 10, 40), rng.integers(1, 22, 40)
    score, start, end = decontamination.align(items, lengths, windows, widths)
    for k in range(40):
        a, b = items[k, : lengths[k]], windows[k, : widths[k]]
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i, j] = max(0, table[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
        assert score[k] == table.max()
        assert 0 <= start[k] <= end[k] <= len(b)


def test_decontamination(spark, docs, none):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(rng.randint(12, 50)))) for k in range(12)] + [(99, None), (98, "too short"), (97, "")]
    filler = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], set()
    for k in range(120):
        text = filler(rng.randint(0, 300))
        if k % 3 == 0:
            item, body = items[k % 12]
            w = body.split()
            if k % 2:
                for at in range(3, len(w), 5):
                    w[at] = word()  # every fifth word replaced
            if k % 4 == 0:
                del w[len(w) // 2]
            text, _ = f"{text} {' '.join(w).upper()}, {filler(rng.randint(0, 100))}", want.add((k, item))
        rows.append((k, text))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id) for r in decontamination.find_contamination(frame, benchmark).collect()}
    assert got == want
    clean = {r.doc_id for r in decontamination.clean_documents(frame, benchmark).collect()}
    assert clean == {k for k, _ in rows} - {d for d, _ in want}
    assert decontamination.find_contamination(docs, benchmark).count() == 0
    assert decontamination.clean_documents(docs, benchmark).count() == len(ROWS)
    assert decontamination.find_contamination(none, benchmark).count() == 0
    assert decontamination.find_contamination(frame, benchmark.where("1 = 0")).count() == 0


def test_a_passage_in_most_documents_is_still_found(spark):
    passage = "alder birch cedar dogwood elm fir gum hazel ilex juniper kauri larch maple"
    rows = [(k, f"start {k} {passage} end {k}" if k % 3 else f"other {k} words only") for k in range(3000)]
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id for r in decontamination.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert got == {k for k, _ in rows if k % 3}


TEXTS = ["", " ", " a", "  Hello  wörld\n\nfoo ▁bar", "日本語 テスト\t\r\n x", "a▁ b ▁▁  c", "😀 emoji   \n \n", "<s> <0x0A> </s>", "a" * 70, "    def f(x):\r\n        return x;\r\n", "3.14 it's (ok) [x]; e.g. U.S. {y} \x00\x7f"]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = pieces.default_model()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    encoded = pieces.encode_documents(frame)
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert got == {k: library.encode(t) for k, t in enumerate(TEXTS)}
    assert {r.doc_id: r.text for r in pieces.decode_documents(encoded).collect()} == {k: library.decode(library.encode(t)) for k, t in enumerate(TEXTS)}


def test_unigram_forward_scores_against_all_segmentations():
    p = pieces.Pieces(pieces.default_model())
    p.bpe = False
    for word in ("▁therein", "▁aaa", "▁inthe", "ing"):
        best, at = [0.0], [0]
        for end in range(1, len(word) + 1):
            options = [(best[s] + p.scores[p.ids[word[s:end]]], -s) for s in range(end) if word[s:end] in p.ids]
            score, start = max(options)
            best.append(score)
            at.append(-start)
        assert sum(p.scores[i] for i in p.encode_sorted([word])[0]) == pytest.approx(best[-1])


def test_pieces_edges(docs, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = [(r.doc_id, list(r.ids)) for r in pieces.encode_documents(pieces.id_and_text(docs)).collect()]
    assert sorted(got, key=repr) == sorted([(r[0], library.encode(r[1] or "")) for r in ROWS], key=repr)
    assert pieces.encode_documents(pieces.id_and_text(none)).count() == 0


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    rows = [(k * 37 % 1009, t) for k, t in enumerate(TEXTS * 30 + ["<|endoftext|> a<|startoftext|>b", "it's they'll IT'S 'sabc a'sb don't 7 77", "é é Ab́c x́", None, "word " * 5000])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    files = token_files.write_token_files(frame, str(tmp_path / "a"), length=128)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(files).collect()}
    at, stream = 0, []
    for doc_id, text in sorted(rows):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert got[doc_id] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        stream += ids
    back = []
    for r in sorted(files.collect(), key=lambda r: r.part):
        reader = token_files.open_sequences(r.file)
        for k in range(reader.num_record_batches):
            batch = reader.get_batch(k)
            assert batch.column(0).type.list_size == 128
            ids, mask = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False)
            assert not ids.flags.writeable  # a view of the file
            back += ids[mask].tolist()
    assert back == stream
    edge = token_files.read_token_files(token_files.write_token_files(docs, str(tmp_path / "b"))).collect()
    assert len(edge) == len(ROWS) and sorted(r.start for r in edge)[0] == 0
    assert token_files.read_token_files(token_files.write_token_files(none, str(tmp_path / "c"))).count() == 0


def test_code_lengths_are_exact():
    trees = langid.ContextTrees([("en", "the cat and the hat"), ("fr", "le chat et la plage à l'été"), ("en", "there")])
    a = trees.size
    spread = np.ones(a)
    spread[0] = 256 - (a - 1)
    for k in range(len(trees.languages)):
        probabilities = np.exp2(trees.bits[k].astype(np.float64)).reshape(-1, a)
        assert np.allclose((probabilities * spread).sum(1), 1, atol=1e-5)


def test_code_lengths_against_a_plain_coder():
    corpus = {"en": ["the cat and the hat", "there"], "fr": ["le chat et la plage"]}
    trees = langid.ContextTrees([(k, t) for k, v in corpus.items() for t in v])

    def length(lang, text):
        counts = collections.defaultdict(collections.Counter)
        for t in corpus[lang]:
            padded = b"   " + t.encode()
            for i in range(3, len(padded)):
                for order in range(4):
                    counts[padded[i - order : i]][padded[i]] += 1
        bits, padded = 0.0, b"   " + text.encode()
        for i in range(3, len(padded)):
            symbol, distribution = padded[i], {b: 1 / 256 for b in range(256)}
            for order in range(4):
                c = counts[padded[i - order : i]]
                if c:
                    n, d = sum(c.values()), len(c)
                    left = 1 - sum(distribution[b] for b in c)
                    distribution = {b: c[b] / (n + d) if b in c else p * d / (n + d) / left for b, p in distribution.items()}
            bits += np.log2(distribution[symbol])
        return bits

    texts = ["the chat", "zz? the", "cat", "plage et hat"]
    got = trees.lengths(*as_bytes(pa.array(texts)))
    trees.longest = None  # by searches instead of the table
    assert np.allclose(trees.lengths(*as_bytes(pa.array([*texts, "", "Zq\u20ac"])))[:4], got, rtol=1e-5)
    for i, t in enumerate(texts):
        for k, lang in enumerate(trees.languages):
            assert got[i, k] == pytest.approx(length(lang, t), rel=1e-4)


def test_language_id(spark, docs, none, sf):
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(docs, langid.train(docs)).collect()}
    assert {(3, "und"), (4, "und"), (9, "und"), (10, "und")} <= got and (5, "und") not in got
    assert {r.lang_pred for r in langid.predict(docs, langid.train(none)).collect()} == {"und"}
    assert langid.predict(none, None).count() == 0
    table = spark.read.parquet(f"{sf}/documents.parquet")
    found = langid.op7_language_id(spark, sf).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95
    assert langid.identified_documents(docs, langid.train(docs)).columns == docs.columns


def test_kernel_against_its_definition():
    def features(word):
        out, word = collections.Counter(), "".join(c for c in word if c.isalnum())
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(len(word), i + toxicity.SPAN)):
                    out[word[i] + word[j] + word[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    def kernel(a, b):
        x, y = features(a), features(b)
        norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
        return sum(v * y[f] for f, v in x.items()) / norm if norm else 0.0

    names = ["idiot", "pathetic", "house"]
    marks = toxicity.Landmarks([n.encode() for n in names])
    words = ["idiot", "i.d.i.o.t", "idddiot", "houses", "ab", "", "pat-hetic", "***", "xidiotx", "i--d--i--o--t", "you.idiot", "sixteenlettersxx"]
    block = all_kernels(marks, words)
    for i, w in enumerate(words):
        for j, n in enumerate(names):
            want = kernel(w, n)
            assert block[i, j] == pytest.approx(want, abs=1e-5) or (block[i, j] == 0 and want < toxicity.FLOOR)
    assert min(block[1, 0], block[2, 0], block[6, 1]) > toxicity.FLOOR and block[9, 0] == pytest.approx(1)


def all_kernels(marks, words):
    """Each word's closest window's kernel with each landmark."""
    block = np.zeros((len(words), len(marks.names)))
    for unit, part in marks.kernels(*spans([w.encode() for w in words])):
        np.maximum.at(block, unit, part)
    return block


def test_a_landmark_inside_a_long_run_counts_wherever_it_stands():
    marks = toxicity.Landmarks([b"worthless", b"pathetic"])
    rng = random.Random(2)
    for n in (40, 300, 5000):
        at = [0, 1, 7, 17, n // 2, n - 9, n]
        runs = ["".join(rng.choice("qzjkv") for _ in range(a)) + "worthless" + "".join(rng.choice("qzjkv") for _ in range(n - a)) for a in at]
        assert (all_kernels(marks, runs)[:, 0] > toxicity.FLOOR).all()
        assert (all_kernels(marks, [r.replace("worthless", "") for r in runs]) == 0).all()


def test_toxicity_training_is_bounded(spark, monkeypatch):
    """By rows and bytes, however often a row repeats; a long text is taken whole."""
    seen = []
    monkeypatch.setattr(toxicity, "ToxicityModel", lambda texts, classes: seen.append((texts, classes)))
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 300_000)
    rows = [(1, "again and again")] * 3000 + [(2, "long " * 40_000), (3, "short"), (4, None), (6, "")]
    labels = spark.createDataFrame([(k, k % 2) for k in (1, 2, 3, 4, 6)] * 50, "doc_id long, toxic int")
    toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    texts, classes = seen[0]
    assert sorted(texts, key=len) == ["short", "again and again", "long " * 40_000] and classes.sum() == 2
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 100_000)
    toxicity.train(spark.createDataFrame([(k, f"{k} " * 500) for k in range(1000)], "doc_id long, text string"), spark.range(1000).selectExpr("id as doc_id", "int(id % 2) as toxic"))
    assert 20_000 < sum(map(len, seen[1][0])) <= 100_000


def test_words_that_share_a_hash_get_their_own_codes(monkeypatch):
    real, calls = textvec.hash_spans, []

    def poor(buf, starts, ends, salt=0):
        calls.append(salt)
        return real(buf, starts, ends, salt) if salt else np.full(len(starts), 5, np.uint64)

    monkeypatch.setattr(textvec, "hash_spans", poor)
    known = SpanTable(100, np.int64)
    code = textvec.listed(lambda raw: [[int(x)] for x in raw], np.int64)
    for words in (["7"], ["7", "7"], ["8"], ["9", "7", "8"]):
        codes, sizes = known.encode(*spans([w.encode() for w in words]), code)
        assert codes.tolist() == [int(w) for w in words] and set(sizes) == {1}
    assert known.salt == 2 and 0 in calls


def test_toxicity(spark, docs, none, sf):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in toxicity.score_toxicity(docs, toxicity.train(docs, labels.where("1 = 0"))).collect()} == {0.0}
    assert toxicity.score_toxicity(none, toxicity.train(docs, labels)).count() == 0


def test_toxicity_held_out(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))
    bad = ["idiot", "worthless", "pathetic"]
    texts, marks = [], []
    for k in range(800):
        w = [word() for _ in range(40)]
        if k % 4 == 0:
            w[rng.randrange(40)] = rng.choice(bad)
        texts.append(" ".join(w))
        marks.append(k % 4 == 0)
    model = toxicity.ToxicityModel(texts[:600], np.array(marks[:600]))
    known = SpanTable(10_000, np.uint16)
    score = lambda ts: np.concatenate([model.scores(b, o, known) for _, _, b, o in chunks(*as_bytes(pa.array(ts)))])
    assert np.mean((score(texts[600:]) > 0.5) == np.array(marks[600:])) > 0.97
    disguised = [" ".join([word() for _ in range(20)] + [b]) for b in ("i.d.i.o.t", "w-o-r-t-h-l-e-s-s", "i d i o t", "pathhetic", "idi_ot", "i--d--i--o--t")]
    assert (score(disguised) > 0.5).all()


def test_exact_dedup_sql(spark, docs):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in ROWS], "text": [r[1] for r in ROWS]}))
    want = sorted(con.execute(exact_dedup.SQL).fetchall(), key=repr)
    got = sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs).collect()], key=repr)
    assert got == want


def components_by_products(rows):
    """Component ids by the products of all pairs' sets, for tables that are too large for near_by_force."""
    sets, columns = [], {}
    for _, text in rows:
        w = (text or "").split()
        sets.append({columns.setdefault(tuple(w[k : k + 4]), len(columns)) for k in range(len(w) - 3)})
    matrix = np.zeros((len(rows), len(columns)), np.float32)
    for k, own in enumerate(sets):
        matrix[k, list(own)] = 1
    both, size = matrix @ matrix.T, matrix.sum(1)
    linked = 100 * both >= 80 * (size[:, None] + size[None] - both)
    label = np.arange(len(rows))
    while True:
        least = np.array([label[linked[k]].min() for k in range(len(rows))])
        if (least == label).all():
            return {rows[k][0]: rows[v][0] for k, v in enumerate(label)}
        label = least


def crowded(rng, one, three, size=120):
    """A text; copies with a word of the first half replaced; copies with words of the second half replaced, far apart, which only the text itself is similar enough to."""
    base = [f"c{rng.randrange(10**9)}" for _ in range(size)]
    out = [base]
    for many, places in ((one, lambda: [rng.randrange(size // 2)]), (three, lambda: [size // 2 + k * size // 6 + rng.randrange(size // 12) for k in range(3)])):
        for _ in range(many):
            copy = list(base)
            for at in places():
                copy[at] = f"n{rng.randrange(10**9)}"
            out.append(copy)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize(("seed", "tables"), [(1, [(2000, 200, 120)]), (2, [(60, 60, 60), (500, 40, 200), (30, 300, 90)]), (3, [(0, 700, 140), (250, 250, 66)])])
def test_no_link_is_crowded_out(spark, seed, tables):
    rng = random.Random(seed)
    texts = [t for one, three, size in tables for t in crowded(rng, one, three, size)]
    rows = list(enumerate(rng.sample(texts, len(texts))))
    want = components_by_products(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_remainder_finds_every_link_without_the_forest(spark, monkeypatch):
    """Whatever the forest leaves out, the components are the same; shingles of many texts are compared in several cells."""
    rng = random.Random(17)
    texts = [t for size in (40, 90) for t in crowded(rng, 60, 30, size)] + [f"{k} {k} {k} short text {k}" for k in range(50)]
    rows = list(enumerate(texts))
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(near_dedup, "candidates", lambda classes: none)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in got} == components_by_products(rows)


def test_leaves_hold_a_bounded_number_of_rows():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 3, (4000, near_dedup.SKETCH)).astype(np.uint8), axis=0)
    differ = keys[1:] != keys[:-1]
    leaf = near_dedup.leaves(np.concatenate(([0], differ.argmax(1))), near_dedup.SKETCH)
    assert (leaf >= 0).all() and np.unique(leaf, return_counts=True)[1].max() <= near_dedup.LEAF
    assert (near_dedup.leaves(np.full(200, near_dedup.SKETCH), near_dedup.SKETCH) == -1).all()


def test_distinct_documents(spark):
    """A row without id goes where a row with one has the same set; other rows without id stay."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(4, text, "a"), (9, text + " more", "b"), (None, text.upper() + " ", "c"), (None, "some other words that stand alone", "d"), (None, None, "e"), (5, "x y z q r", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash string")
    kept = near_dedup.distinct_documents(docs)
    assert kept.columns == docs.columns and sorted(r.text_hash for r in kept.collect()) == ["a", "d", "e", "f"]


def test_short_items_are_found_whole(spark):
    benchmark = spark.createDataFrame([(1, "Paris"), (2, "red green"), (3, "one two three four"), (4, "..."), (5, "red green")], "item_id long, text string")
    rows = [("a", 1, "to PARIS, then paris"), ("b", 2, "parisian reds; red\ngreen"), ("c", 3, "one two three, four!"), ("d", 4, "one two three and four"), ("e", 5, None)]
    docs = spark.createDataFrame(rows, "name string, doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.score, r.passage) for r in decontamination.find_contamination(docs, benchmark).collect()}
    assert got == {(1, 1, 1.0, "PARIS"), (2, 2, 1.0, "red\ngreen"), (2, 5, 1.0, "red\ngreen"), (3, 3, 1.0, "one two three, four")}
    assert [r.name for r in decontamination.clean_documents(docs, benchmark).collect()] == list("abcde")  # the first column needs to be no id


def test_contamination_against_alignment_of_all_pairs(spark):
    """Every document against every item, aligned over the whole text without seeds."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6)))
    items = [[word() for _ in range(rng.randint(8, 30))] for _ in range(8)]
    rows = []
    for k in range(60):
        w = [word() for _ in range(rng.randint(20, 80))]
        if k % 2:
            own = list(rng.choice(items))
            for _ in range(rng.randint(0, len(own) // 4)):
                own[rng.randrange(len(own))] = word()
            w[10:10] = own
        rows.append((k, w))
    want = set()
    for k, w in rows:
        for i, item in enumerate(items):
            code = {x: n for n, x in enumerate({*w, *item}, 1)}
            pad = lambda x: np.array([[code[y] for y in x]], np.uint64)
            score = decontamination.align(pad(item), np.array([len(item)]), pad(w), np.array([len(w)]))[0][0]
            if score / (2 * len(item)) >= decontamination.MIN_SCORE:
                want.add((k, i))
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.find_contamination(docs, benchmark).collect()} == want and len(want) > 20


def test_sharding_of_many_equal_rows(spark):
    rows = [(None, "")] * 2000 + [(k, f"text {k}") for k in range(500)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    shards_hold(got, rows, 16)


def test_every_language_is_learned(spark, monkeypatch):
    """Three hundred languages, one of which stands in long texts only; training is bounded by bytes, and repeated rows count once."""
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyzäöüß"
    words = {k: ["".join(rng.choice(letters) for _ in range(5)) for _ in range(4)] for k in range(300)}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    rows = [(k * 10 + i, text(k, 30), f"l{k}") for k in range(299) for i in range(6)] + [(9000 + i, text(299, 30_000), "l299") for i in range(6)]
    rows += [(77777, rows[0][1], "l0")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "TRAIN_BYTES", 300_000)
    seen = []
    monkeypatch.setattr(langid, "ContextTrees", lambda texts, real=langid.ContextTrees: seen.append(texts) or real(texts))
    trees = langid.train(docs)
    monkeypatch.undo()
    assert len(trees.languages) == 300 and sum(len(t) for lang, t in seen[0] if lang != "l299") < 300_000
    assert sum(lang == "l299" for lang, _ in seen[0]) == 1 and len(set(seen[0])) == len(seen[0])
    found = langid.predict(docs, trees).distinct().collect()
    assert np.mean([r.lang_pred == f"l{r.doc_id // 10}" for r in found if r.doc_id < 9000]) > 0.98
    assert {r.lang_pred for r in found if 9000 <= r.doc_id < 9006} == {"l299"}


@pytest.mark.parametrize("length", [16, 17, 30, 60, 400])
def test_long_words_mark_toxic_texts_too(length):
    """A mark of any length is learned: a word of more than LONG letters gives its windows as landmarks."""
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))
    mark = "".join(rng.choice("schweinhudkrlbg") for _ in range(length))
    marks = [k % 4 == 0 for k in range(800)]
    texts = [" ".join([word() for _ in range(20)] + [mark.capitalize() + rng.choice(["", ".", "!"])] * m + [word() for _ in range(20)] + (["".join(rng.choice("aeioulnrst") for _ in range(40))] if k % 3 == 0 else [])) for k, m in enumerate(marks)]
    model = toxicity.ToxicityModel(texts[:600], np.array(marks[:600]))
    known = SpanTable(10_000, np.uint16)
    got = np.concatenate([model.scores(b, o, known) for _, _, b, o in chunks(*as_bytes(pa.array(texts[600:])))]) >= 0.5
    want = np.array(marks[600:])
    assert (got & want).sum() / want.sum() > 0.97 and (got == want).mean() > 0.97


def test_scores_equal_a_plain_machine(spark, sf):
    """op6's scores on whole texts: the weighted sum of each landmark's closest unit or window, word by word, through the curve."""
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    marks = model.landmarks
    rows = {r.doc_id: r.text or "" for r in docs.limit(40).collect()}
    def plain_subsequences(codes):
        out = {}
        for i, j, k in ((i, j, k) for i in range(len(codes)) for k in range(i + 2, min(len(codes), i + toxicity.SPAN)) for j in range(i + 1, k)):
            out[codes[i], codes[j], codes[k]] = out.get((codes[i], codes[j], codes[k]), 0) + toxicity.DECAY ** (k - i - 2)
        return out

    weigh = lambda codes: (lambda w: {k: v / sum(x * x for x in w.values()) ** 0.5 for k, v in w.items()})(plain_subsequences(codes))
    letters = lambda raw: [int(c) for c in toxicity._CODE[np.frombuffer(raw, np.uint8)] if c]
    own = [weigh(letters(n)) for n in marks.names]

    for ident, text in rows.items():
        best = np.zeros(len(own))
        for unit in set(re.sub(r"(?<!\S)\S(?:\s+\S(?!\S))+", lambda m: re.sub(r"\s+", "\x00", m[0]), lowered(text), flags=re.A).encode().split()):
            codes = letters(unit)
            n = len(codes)
            parts = [codes] if n <= toxicity.LONG else [codes[min(s, n - toxicity.WINDOW) :][: toxicity.WINDOW] for s in range(0, n - toxicity.WINDOW + toxicity.STEP, toxicity.STEP)]
            for part in parts:
                if len(part) > 2:
                    w = weigh(part)
                    found = np.array([sum(v * o.get(k, 0) for k, v in w.items()) for o in own])
                    best = np.maximum(best, np.where(found >= toxicity.FLOOR, found, 0))
        value = float(best @ model.weights + model.bias)
        want = 1 / (1 + np.exp(-np.clip(model.slope * value + model.shift, -30, 30)))
        got = model.scores(*as_bytes(pa.array([text])), SpanTable(10_000, np.uint16))[0]
        assert got == pytest.approx(want, abs=0.02), ident


def lowered(text):
    return text.translate({c: c + 32 for c in range(65, 91)})
