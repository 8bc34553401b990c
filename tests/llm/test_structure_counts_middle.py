"""Conversation repair, token counts and fill-in-the-middle against brute force, the tokenizer's library and SQL."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from docketry.llm import fim, repair, tokencounts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def cheapest(symbols):
    """Least (cost, audit) by trying every edit of every row, inserts anywhere."""
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    @lru_cache(None)
    def go(i, state, inserted):
        out = [(0, "")] if i == len(symbols) and state in (0, 3) else []

        def edit(cost, letter, rest):
            if rest is not None:
                out.append((rest[0] + cost, letter + rest[1]))

        if inserted < 2 * len(symbols) + 2:
            for role in "ua":
                if (state, role) in after:
                    edit(5, "I", go(i, after[state, role], inserted + 1))
        if i < len(symbols):
            own, fault = symbols[i]
            edit(2, "D", go(i + 1, state, inserted))
            if fault not in "bd":
                late = 5 * (fault == "t")
                if (state, own) in after:
                    edit(late, "K", go(i + 1, after[state, own], inserted))
                for role in "ua":
                    if (state, role) in after:
                        edit(1 + late, "R", go(i + 1, after[state, role], inserted))
        return min(out, default=None)

    return go(0, 0, 0)


def expected(rows):
    """The contract, by plain Python: rows of (conv_id, turn, role, text)."""
    conversations = {}
    for c, t, role, text in rows:
        kept = conversations.setdefault(c, [])
        damage = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if damage:
            text = "" if damage == 1 else re.sub("[.!?]", "", text) if damage == 2 else text
            kept += [(t, "user" if damage == 4 else role, text)] * (2 if damage == 3 else 1)
    out = []
    for c, kept in conversations.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        symbols, seen = [], set()
        for _, role, text in kept:
            rest = text.strip(" \t\n\v\f\r")
            symbols.append((role[:1], "b" if not rest else "d" if (role, text) in seen else "t" if rest[-1] not in ".!?" else "-"))
            seen.add((role, text))
        cost, audit = cheapest(tuple(symbols))
        left = len(audit) - audit.count("D")
        roles = ["system"] * (left % 2) + ["user", "assistant"] * (left // 2)
        lines, row = [], iter(kept)
        for letter in audit:
            if letter == "I":
                lines.append(roles[len(lines)] + ":")
                continue
            _, role, text = next(row)
            if letter != "D":
                lines.append(f"{role if letter == 'K' else roles[len(lines)]}:{text}")
        turns = {t for t, _, _ in kept if t is not None}
        faults = [f for _, f in symbols]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((c, gaps, *map(faults.count, "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0))


def op11(spark, rows, tmp_path, extra=""):
    df = spark.createDataFrame([(*r, *("x" for _ in extra.split())) for r in rows], "conv_id long, turn long, role string, text string" + "".join(f", {c} string" for c in extra.split()))
    df.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op11_structure_repair(spark, str(tmp_path)).collect()
    return sorted((tuple(r) for r in got), key=lambda r: (r[0] is None, r[0] or 0))


def test_chart_finds_the_cheapest_audit():
    rng = random.Random(11)
    for _ in range(1500):
        symbols = tuple((rng.choice("suau-"), rng.choice("---tbd")) for _ in range(rng.randint(0, 8)))
        assert repair.parsed("".join(a + b for a, b in symbols)) == cheapest(symbols), symbols


def test_audits_compare_like_strings():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choices("DIKR", k=rng.randint(1, 6))) for _ in "ab")
        if a.startswith(b) or b.startswith(a):
            continue
        lists = []
        for text in (a, b):
            node = None
            for letter in text:
                node = repair.Audit(node, letter)
            lists.append(node)
        assert repair.Audit.less(*lists) == (a < b)


def test_repair_of_conversations(spark, tmp_path):
    rng = random.Random(7)
    texts = ["Yes.", "No!", "Well, it is so", "", " \n", "Why?", "é 😀.", "x" * 50_000, None]
    rows = [(c, rng.choice([None, t, t, t, t + 1]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice(texts)) for c in [*range(60), None] for t in range(rng.randint(1, 7))]
    assert op11(spark, rows, tmp_path, extra="audit nth digest fault copy damage of") == expected(rows)


def test_long_conversation_and_repeated_rows(spark, tmp_path):
    rng = random.Random(9)
    rows = [(1, t, ["user", "assistant"][t % 2] if rng.random() < 0.9 else "system", f"Turn {t // 3}.") for t in range(300)] * 2 + [(2, 0, "user", "One.")]
    got = op11(spark, rows, tmp_path)
    assert [r[0] for r in got] == [1, 2] and got[1] == expected(rows[-1:])[0]
    symbols = repair.symbols(repair.damaged(spark.createDataFrame(rows[:-1], "conv_id long, turn long, role string, text string"))).collect()
    assert got[0][3] == sum(s["fault"] == "d" for s in symbols) and len(got[0][7]) - got[0][7].count("I") == len(symbols)
    # The same rows through the chart at once and a row at a time.
    order = sorted(symbols, key=lambda s: (s["turn"], s["role"], s["digest"], s["nth"]))
    assert repair.parsed("".join((s["initial"] if s["initial"] in "sua" else "-") + s["fault"] for s in order)) == got[0][6:8]


def test_no_conversations(spark, tmp_path):
    assert op11(spark, [], tmp_path) == []


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def counts(df, **more):
    return sorted((tuple(r) for r in tokencounts.count(df, VOCABULARY, **more).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_counts_equal_the_library(spark, frame, library):
    rng = random.Random(3)
    marks = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "don't", "'S", "naïve", "՘", "Ᲊ", "६७", "…", "the", "😀", "　", "q" * 700]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 30))) for _ in range(300)] + [None, "", "<|endoftext|>", "a <|endoftext|>  b", "<|endoftext|>" * 3, "wort " * 30_000, "A" * 20_000]
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in enumerate(texts)]
    df = frame([(i, t, "en", "s", 0) for i, t in enumerate(texts)]).coalesce(2)
    assert counts(df) == want


def test_small_blocks_give_the_same(spark, frame, monkeypatch, library):
    texts = [f"word{i % 7} other{i} zqxj{i % 3}" for i in range(200)]
    monkeypatch.setattr(tokencounts, "frequencies", lambda docs, path, f=tokencounts.frequencies: f(docs, path, 100))
    got = counts(frame([(i, t, "en", "s", 0) for i, t in enumerate(texts)]))
    assert [r[2] for r in got] == [len(library.encode(t).ids) for t in texts]


def test_counts_of_odd_rows(odd, library):
    rows = odd.select("doc_id", "text").collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "").ids), n > 1024) for r in rows]
    assert counts(odd) == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    assert counts(odd.limit(0)) == []


def test_counts_of_words_go_back_to_their_blocks(spark, library):
    rows = [(i % 3, i, f" wörd{i % 50}") for i in range(400)]
    lists = spark.createDataFrame([(of, i, w.encode()) for of, i, w in rows], "of long, id int, word binary").coalesce(1)
    got = {}
    for r in tokencounts.pieces(lists, VOCABULARY).collect():
        ids, at = tokencounts.unpacked(pa.array([bytes(r["ids"])]))
        n, _ = tokencounts.unpacked(pa.array([bytes(r["pieces"])]))
        got |= {(r["of"], int(i)): int(k) for i, k in zip(tokencounts.sums(ids, at), n, strict=True)}
    assert got == {(of, i): len(library.encode(w).ids) for of, i, w in rows}


def test_packed_numbers():
    rng = random.Random(6)
    rows = [sorted(rng.sample(range(1 << 30), rng.randint(0, 40))) for _ in range(60)] + [[], [0], [127, 128, 1 << 28, (1 << 31) - 1], []]
    at = np.append(0, np.cumsum([len(r) for r in rows]))
    flat = np.array([x for r in rows for x in r], dtype=np.int64)
    back, again = tokencounts.unpacked(tokencounts.packed(tokencounts.steps(flat, at), at))
    assert (again == at).all() and (tokencounts.sums(back, at) == flat).all()
    assert tokencounts.unpacked(pa.array([], pa.binary()))[1].tolist() == [0]


def test_rank_and_select():
    rng = np.random.default_rng(4)
    for size in (1, 63, 64, 65, 511, 512, 513, 5000):
        for density in (0.0, 0.01, 0.5, 1.0):
            marks = rng.random(size) < density
            bits, places = fim.Bits(marks), np.flatnonzero(marks)
            assert (bits.rank(np.arange(size + 1)) == np.append(0, np.cumsum(marks))).all()
            if len(places):
                assert (bits.select(np.arange(len(places))) == places).all()


def plain_fim(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(tokens), "plain", None, None, text, text
    if h4 % 100 < 80:
        return doc_id, len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def middle(df):
    made = fim.transform(df)
    rows = made.withColumn("text", fim.restored(made["output"], made["form"])).collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_fill_in_middle(frame, odd):
    rng = random.Random(5)
    marks = ["<", "<P", ">", "<S", "<M>", "a", "é", "😀", " ", "\n\t", " ", "\x00", "word "]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 40))) for _ in range(400)] + [None, "", " ", "x " * 100_000, "y" * 100_000]
    df = frame([(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    want = [plain_fim(i, t) for i, t in enumerate(texts)]
    assert middle(df) == sorted(want, key=str) and {w[2] for w in want} == {"plain", "spm", "psm"}
    assert middle(odd) == sorted((plain_fim(r["doc_id"], r["text"]) for r in odd.collect()), key=str)
    assert middle(odd.limit(0)) == []


def test_fill_in_middle_by_sql(spark, odd, tmp_path):
    odd.select("doc_id", "text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = fim.op13_fill_in_middle(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(fim.OP13_SQL)
    assert got.columns == want.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_kinds_of_characters_are_the_librarys(library):
    """Of every assigned block and what lies between them; libraries differ in their version of Unicode."""
    from docketry.llm import bpe

    kinds, cut = bpe.kinds(), library.pre_tokenizer.pre_tokenize_str
    rng = random.Random(1)
    for c in [0x558, 0x58B, 0x88F, 0x1C89, 0x323B0, 0x3FC3D, 0x85, 0xA0, 0x27, *rng.sample(range(0xD800), 3_000), *rng.sample(range(0xE000, 0x110000), 3_000)]:
        joins = [len(cut(x + chr(c))) == 1 for x in "a1%"]
        assert kinds[c] == (joins.index(True) if any(joins) else bpe.BLANK), hex(c)
