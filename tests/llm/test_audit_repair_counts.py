"""Filter audit, conversation repair and token counts against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import duckdb
import pyarrow as pa
import pytest

from usagebook.llm import conversation_repair as repair
from usagebook.llm import filter_audit as audit
from usagebook.llm import token_counts as counts
from usagebook.llm.pieces import default_model
from usagebook.llm.textvec import as_bytes


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    return sorted(names), sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in cursor.fetchall()), key=repr)


def by_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


# ---- op11


def documents(rng):
    long = " ".join(f"w{k}" for k in range(130))
    kinds = [None, "", "  \n", "few words", long, long + " $", "A" * 300 + " " + long, ("same " * 120).strip(), long.upper(), "a b " * 60, "É" * 5 + " " + long, ("x y " * 60) + "|", "word\u000bword " * 70, long * 900]
    rows = [(rng.choice([k, k, None]) if k % 9 == 0 else k, rng.choice(kinds), rng.choice(["en", "de", "", None])) for k in range(120)]
    return rows + rows[:10]  # repeated rows


def test_filter_audit_equals_sql(spark):
    rng = random.Random(5)
    docs = documents(rng)
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 120, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    more = ", part string, fails int, digest string, first int, good int, docs int"
    d = spark.createDataFrame([(*r, "x", 1, "y", 2, 3, 4) for r in docs], "doc_id long, text string, lang string" + more).repartition(3)
    lab = spark.createDataFrame([(*r, 9, 9) for r in labels], "doc_id long, quality int, toxic int, good int, bad int")
    table = audit.tabulated(audit.failure_sets(d), lab)
    names, got = by_spark(audit.interactions(table))
    tables = {"documents": pa.table(dict(zip(("doc_id", "text", "lang"), map(list, zip(*docs, strict=True)), strict=True))), "labels": pa.table(dict(zip(("doc_id", "quality", "toxic"), map(list, zip(*labels, strict=True)), strict=True)))}
    assert (names, got) == by_sql(audit.SQL, **tables)
    assert len(got) == 3 * 600
    assert audit.interactions(audit.tabulated(audit.failure_sets(d.where("1 = 0")), lab)).count() == 0
    assert audit.interactions(audit.tabulated(audit.failure_sets(d), lab.where("1 = 0"))).selectExpr("sum(good_lost + toxic_lost)").first()[0] == 0


@pytest.mark.parametrize("n", [2, 3, 5])
def test_least_squares_give_shapley_values(n):
    rng = random.Random(n)
    removed = audit.coalition_sums([rng.randrange(50) for _ in range(1 << n)])
    want = [Fraction(0)] * n
    orders = list(itertools.permutations(range(n)))
    for order in orders:
        before = 0
        for f in order:
            want[f] += removed[before | 1 << f] - removed[before]
            before |= 1 << f
    assert audit.shapley_values(removed) == [w / len(orders) for w in want]


# ---- op12


def cheapest(rows):
    """Cost, audit and lines by search over all edits: rows (role, text, must go, truncated)."""
    best = {0: (0, "", ())}
    for role, text, gone, cut in [*rows, (None, None, False, False)]:
        for _ in range(3):
            for s, (c, w, lines) in list(best.items()):
                initial = "uuau"[s]
                way = (c + 5, w + "I", (*lines, {"u": "user:", "a": "assistant:"}[initial]))
                t = {"u": 2, "a": 3}[initial]
                best[t] = min(best.get(t, way), way)
        if role is None:
            return min((best[s] for s in (0, 3) if s in best), default=None)
        now = {}
        for s, (c, w, lines) in best.items():
            ways = [(s, (c + 2, w + "D", lines))]
            if not gone:
                more = 5 if cut else 0
                for name, letter, paid in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    t = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, name[:1]))
                    if t is not None:
                        ways.append((t, (c + paid + more, w + letter, (*lines, f"{name}:{text}"))))
            for t, way in ways:
                now[t] = min(now.get(t, way), way)
        best = now


def plain_repair(rows):
    """The contract over rows (conv_id, turn, role, text), conversation by conversation."""
    out = []
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            what = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if what:
                text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
                kept += [(turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        turns = {r[0] for r in kept} - {None}
        seen, marked, n = set(), [], [0, 0, 0]
        for _, role, text in kept:
            body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            blank, again = not body, (role, text) in seen
            cut = not blank and not again and body[-1] not in ".!?"
            for k, x in enumerate((blank, again and not blank, cut)):
                n[k] += x
            seen.add((role, text))
            marked.append((role, text, blank or again, cut))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, letters, lines = cheapest(marked)
        out.append((letters, n[0], conv, cost, n[1], max(turns) - min(turns) + 1 - len(turns) if turns else 0, illegal, hashlib.sha256("\n".join(lines).encode()).hexdigest(), n[2]))
    return sorted(out, key=repr)


def conversations(rng, convs, longest):
    rows = []
    for c in convs:
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, ""]) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Fine.", "Fine!", "cut", f"own {turn}?", f"own {turn}.", f"own {turn}", "", " \n\x0b", None, "…", "end. \t"])
            rows.append((c, None if rng.random() < 0.05 else turn * (3 if rng.random() < 0.1 else 1), role, text))
    return rows + rows[:7]


@pytest.mark.parametrize("bits", [0, 2, 10])
def test_repair_equals_plain_search(spark, bits):
    """Also where a conversation is divided over many segments and tasks."""
    rng = random.Random(8)
    rows = conversations(rng, [None, *range(1, 40)], 12) + conversations(rng, [1000], 400)
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "conv_id long, turn long, role string, text string, place long, kind int, segment string").repartition(5)
    names, got = by_spark(repair.repaired(df, repair.damaged(df), segment_bits=bits))
    assert names == ["audit", "blank", "conv_id", "cost", "duplicate", "gaps", "illegal", "repaired_sha256", "truncated"]
    assert got == plain_repair(rows)


def test_repair_equals_sql_and_odd_tables(spark):
    rng = random.Random(2)
    rows = conversations(rng, [None, *range(1, 25)], 9)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sql = by_sql(repair.SQL, conversations=pa.table(dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*rows, strict=True)), strict=True))))
    assert by_spark(repair.repaired(df, repair.damaged(df))) == sql
    assert repair.repaired(df.where("1 = 0"), repair.damaged(df.where("1 = 0"))).count() == 0
    named = df.selectExpr("concat('c', conv_id) AS conv_id", "cast(turn AS int) AS turn", "role", "text")
    want = plain_repair([(None if c is None else f"c{c}", t, r, x) for c, t, r, x in rows])
    assert by_spark(repair.repaired(named, repair.damaged(named)))[1] == want
    # one conversation of nothing but one repeated row, and a very long text
    same = spark.createDataFrame([(7, 1, "user", "Hi.")] * 500 + [(8, 0, "user", "a" * 3_000_000 + "."), (8, 1, "assistant", "b.")], df.schema)
    got = {r.conv_id: r for r in repair.repaired(same, same, segment_bits=3).collect()}
    assert got[7].duplicate == 499 and got[7].audit == "D" * 500 and got[8].audit == "KK" and got[7].gaps == 0


def test_crossings_in_every_division():
    rng = random.Random(4)
    for _ in range(300):
        kinds = bytes(rng.randrange(12) for _ in range(rng.randint(0, 9)))
        rows = [("sua?"[k % 4], "", k >= 8, 4 <= k < 8) for k in kinds]
        cost, letters = repair.repair(kinds)
        assert (cost, "".join(letters)) == cheapest(rows)[:2]
        cut = rng.randint(0, len(kinds))
        whole = [repair.ROWS[k] for k in kinds]
        tables = [repair.summary(part) for part in (whole[:cut], whole[cut:]) if part]
        states = [*repair.crossings([*tables, repair.END], 0, 0)]
        assert states[: len(tables)] == [[*repair.crossings([*whole, repair.END], 0, 0)][k - 1] for k in ([cut] if 0 < cut < len(kinds) else []) + [len(kinds)] if kinds]


# ---- op13

TEXTS = ["", " ", "  a  b ", "Hello world, hello", "naïve café\n\nüber ▁x▁▁y  ", "日本語のテキスト and 🎉🎉 mixed", "<s> </s> <unk> <0x41>", "a\x00b\tc\r\n", "a" * 40, "x" * 30 + " " * 12, "été" * 9, "def f(x):\n    return x**2  # ok"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=default_model())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return TEXTS + ["".join(rng.choice("abcdeé ▁ \nthe日,.") for _ in range(rng.randint(1, 60))) for _ in range(150)]


@pytest.fixture(scope="module")
def prefixes(library, texts):
    """(text, bytes) -> tokens, by encoding every prefix; None inside a character."""
    out = {}
    for i, t in enumerate(texts):
        ends = {len(t[:k].encode()): len(library.encode(t[:k])) for k in range(1, len(t) + 1)}
        out |= {(i, n): ends.get(n) for n in range(1, len(t.encode()) + 1)}
    return out


def test_every_prefix_equals_the_library(texts, prefixes):
    buf, offsets = as_bytes(pa.array(texts))
    got = counts.PrefixCounter(default_model()).counts(buf, offsets)
    assert [int(x) for x in got] == [prefixes[i, n] or 0 for i, t in enumerate(texts) for n in range(1, len(t.encode()) + 1)]


def test_questions_from_the_index(spark, texts, prefixes):
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, "no id")], "doc_id long, text string").repartition(3)
    index = counts.prefix_index(docs, block=16)
    asked = spark.createDataFrame([(i, n) for i, t in enumerate(texts) for n in range(1, len(t.encode()) + 3)], "doc_id long, n_bytes long")
    assert {(r.doc_id, r.n_bytes): r.n_tokens for r in counts.tokens_before(index, asked, 16).collect()} == prefixes
    budgets = [(i, n) for i, t in enumerate(texts) for n in (0, 1, 3, 7, 20) if t]
    got = counts.longest_prefix(index, spark.createDataFrame(budgets, "doc_id long, budget long")).collect()
    assert {(r.doc_id, r.budget): r.n_bytes for r in got} == {(i, n): max([k for (j, k), c in prefixes.items() if j == i and c and c <= n], default=0) for i, n in budgets}


def test_counts_of_documents(spark, sf, library, texts):
    odd = spark.createDataFrame([(None, None, 1, 2), (1, "", 1, 2), (2, "a b", 1, 2), (2, "a b", 1, 2), (3, "word " * 300_000, 1, 2)], "doc_id long, text string, n_tokens int, block int")
    got = sorted(counts.count_tokens(odd, limit=1).collect(), key=lambda r: (r.n_bytes, r.doc_id or 0))
    assert [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit, r.limit_bytes) for r in got[:4]] == [(None, 0, 0, False, 0), (1, 0, 0, False, 0), (2, 3, 2, True, 1), (2, 3, 2, True, 1)]
    assert got[4].n_tokens == len(library.encode("word " * 300_000)) and got[4].limit_bytes == 4
    assert counts.count_tokens(odd.where("1 = 0")).count() == 0
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = counts.op13_token_counts(spark, sf).collect()
    assert len(rows) == len(docs) and all((r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n := len(library.encode(docs[r.doc_id])), n > 4096) for r in rows)
