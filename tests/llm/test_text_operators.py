"""Operators on texts against plain Python versions."""

import hashlib
import random
import re
from collections import Counter

import pytest
from helpers import rows_of, words

from docketry.llm import bpe, jaccard, lines, packing, pii, quality, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df):
    out = {}
    for r in df.collect():
        assert r["doc_id"] not in out
        out[r["doc_id"]] = r
    return out


def repeated_bytes(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("many, hold", [(suffixes.MANY, suffixes.HOLD), (1, 3)])
def test_suffix_dedup_matches_brute_force(frame, monkeypatch, many, hold):
    monkeypatch.setattr(suffixes, "MANY", many)
    monkeypatch.setattr(suffixes, "HOLD", hold)
    monkeypatch.setattr(suffixes, "CHUNK", 200 if many == 1 else suffixes.CHUNK)
    rng = random.Random(1)
    passages = [" ".join(words(rng, 70)) for _ in range(4)]
    texts = [None, "", "a" * 900, "ab" * 300, "x" * 199, "é" * 150]
    for _ in range(60):
        parts = [" ".join(words(rng, rng.randint(5, 80)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 120)
            parts += [p[a : a + rng.randint(150, 330)], " ".join(words(rng, rng.randint(1, 30)))]
        texts.append(rng.choice(["", " "]).join(parts))
    texts += texts[8:12]
    # One segment altered in the middle: windows on both sides still repeat.
    texts += [texts[9][:40] + "#" + texts[9][41:], texts[10] + texts[10]]
    got = by_id(suffixes.dedup(frame(rows_of(texts))))
    for i, want in enumerate(repeated_bytes(texts, 200)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, i


@pytest.mark.parametrize("alphabet", [2, 3, 26])
def test_suffix_array_is_sorted(alphabet):
    import numpy as np

    rng = np.random.default_rng(alphabet)
    for n in (1, 2, 3, 10, 200, 700):
        t = np.append(rng.integers(1, alphabet + 1, n), 0)
        order = suffixes.suffix_array(t, alphabet + 1)
        assert order.tolist() == sorted(range(n + 1), key=lambda i: t[i:].tolist())


def test_line_dedup_matches_brute_force(frame):
    rng = random.Random(2)
    pool = [" ".join(words(rng, 4)) for _ in range(30)]
    texts, sources = [], []
    for i in range(120):
        own = [" ".join(words(rng, 5)) for _ in range(rng.randint(0, 3))] + rng.choices(pool, weights=[1 / (1 + k) ** 2 for k in range(30)], k=rng.randint(0, 6)) + ["", "  "]
        own = [rng.choice(["", " ", "\t"]) + x for x in own]
        rng.shuffle(own)
        texts.append(None if i == 7 else "\n".join(own))
        sources.append(None if i % 9 == 0 else f"s{i % 13}")
    spread, first = {}, {}
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            key = line.strip(" \t\r\f\v")
            if key:
                spread.setdefault(key, set()).add(sources[i])
                first.setdefault(key, (i, k))
    got = by_id(lines.dedup(frame(rows_of(texts, sources)), 5))
    assert any(len(s) >= 5 for s in spread.values()) and any(len(s) == 4 for s in spread.values())
    for i, t in enumerate(texts):
        keep = [x for k, x in enumerate((t or "").split("\n")) if not ((key := x.strip(" \t\r\f\v")) and len(spread[key]) >= 5 and first[key] != (i, k))]
        r = got[i]
        assert (r["text"] or "") == "\n".join(keep), i
        assert r["line_dedup"]["n_removed"] == len((t or "").split("\n")) - len(keep)


def base_counts(text):
    found = WORD.findall(text or "")
    windows = Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
    hit = set()
    for i in range(len(found) - 2):
        if windows[tuple(found[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_quality_counts_match_brute_force(frame):
    rng = random.Random(3)
    texts = [None, "", "\n\n", "a b c a b c", "a\nb\na\n \na", "é😀 ﻿  x\x85y", "x " * 500, "\x00 \x1c a\x0bb"]
    for _ in range(80):
        pool = words(rng, rng.choice([3, 20, 200]))
        texts.append("".join(rng.choice(pool) + rng.choice([" ", "\n", " # ", "\t", "\r\n", " é|"]) for _ in range(rng.randint(1, 200))))
    got = by_id(quality.statistics(frame(rows_of(texts))))
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in quality.BASE) == base_counts(t), (i, t[:60] if t else t)


def test_trees_learn_and_keep_their_constraints():
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.random((3000, len(quality.FEATURES)))
    names = list(quality.FEATURES)
    good = (x[:, names.index("symbols")] < 0.6) & (x[:, names.index("distinct")] > 0.2)
    trees = quality.grow(x[:2000], good[:2000].astype(float))
    assert ((trees.score(x[2000:]) > 0.5) == good[2000:]).mean() > 0.97
    for name, sign in quality.FEATURES.items():
        if sign:
            many = np.repeat(x[:60], 21, axis=0)
            many[:, names.index(name)] = np.tile(np.linspace(0, 1, 21), 60)
            steps = np.diff(trees.score(many).reshape(60, 21), axis=1) * sign
            assert steps.min() >= -1e-12, name


def test_trees_without_labels_reject_nothing(spark, frame):
    docs = frame(rows_of(["many different words here number " + " ".join(map(str, range(60)))]))
    stats = quality.statistics(docs)
    trees = quality.train(stats, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r["kept"] for r in quality.judge(stats, trees).collect()] == [True]


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = WORD.findall(low)
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4)) if len(found) >= 5 else frozenset([tuple(found)])


def brute_components(ids, sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(sets)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(len(s), ids[find(i)], links[i]) for i, s in enumerate(sets)]


def near_texts(rng, n):
    texts = [None, "", " ", "one", "One", "one two three", "one two three four", "a b c d e", "A b c d e", "a a a a a a a a a"]
    while len(texts) < n:
        base = words(rng, rng.choice([6, 12, 40, 150]))
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(["zz", "yy", "ww"])
            if rng.random() < 0.3:
                copy += words(rng, rng.randint(1, len(base) // 5 + 1))
            texts.append(" ".join(copy))
    return texts[:n]


@pytest.mark.parametrize("block", [jaccard.BLOCK, 4])
def test_jaccard_join_matches_brute_force(frame, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = near_texts(random.Random(6), 260)
    want = brute_components(list(range(len(texts))), [shingle_set(t) for t in texts])
    assert len({w[1] for w in want}) < len(texts) - 50
    got = by_id(jaccard.join(frame(rows_of(texts))))
    for i, w in enumerate(want):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["n_links"]) == w, i


def test_byte_bpe_equals_the_library(frame):
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    texts = [None, "", " ", "a", "  two  blanks \n\n and\tmore ", "don't I'LL we've", "<|endoftext|>", "x" * 5000, "ab" * 700, "naïve façade 😀😀 中文字符 ١٢٣ ² Ⅷ", "a b c\x85d\x1ce​f　g", "123456789 3.14 --==>>", "\x00\x01\x7f", "é ́x", "\U0001d400\U0001d7d8 กำ ªº _a_ ①", "﻿bom", "z" * 192 + " " + "q" * 193]
    texts += [" ".join(words(rng, 200)) for _ in range(10)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0xFFFF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(400)) for _ in range(20)]
    got = by_id(bpe.encode(frame(rows_of(texts)), ranks, public_tokenizers.PATTERN))
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids), (i, t[:50] if t else t)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_the_fold_of_higher_order_functions_gives_the_same_ids(spark):
    import public_tokenizers
    import tiktoken
    from pyspark.sql import functions as F

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    known = [" hello", "aaaaaaa", "é", " extraordinarily", "q", "zxqj", "ababab", " the"]
    df = spark.createDataFrame([(w, [ranks[bytes([b])] for b in w.encode()]) for w in known], "word string, tokens array<int>")
    pairs = bpe.PairRanks(ranks)
    got = {r["word"]: r["ids"] for r in df.select("word", bpe.fold(F.col("tokens"), pairs, pairs.literal).alias("ids")).collect()}
    assert got == {w: library.encode_ordinary(w) for w in known}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def test_personal_data_matches_brute_force(frame):
    rng = random.Random(9)
    pieces = ["a.b+c@ex-ample.co.uk", "a@b", "x@@y.z", "q@r.s.", "1.2.3.4", "999.1.1.1", "01.002.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "1234567890123456", "+1 (555) 010-9999", "+44 20 7946 0958", "+1", "+12345", "++49 30 1234567", "é😀", "1 2 3", "0" * 16, "5500005555555559", "mail:", ".@.", "-", " ", "\n", "12.", "@x.yy", "+999 999 999 999 999 999", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "123-45-6789 ssn", "١٢.1.1.1", "7.7.7.7@h.io"]
    texts = [None, ""] + ["".join(rng.choice(pieces) + rng.choice(["", " ", ", ", "x"]) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    found = pii.find(frame(rows_of(texts)))
    got = by_id(found)
    for i, t in enumerate(texts):
        for kind, (pattern, good) in BASE.items():
            want = [(m.start(), m.end()) for m in re.finditer(pattern, t or "") if good(m[0])]
            assert [(s["start"], s["end"]) for s in got[i]["pii"][kind]] == want, (kind, t)
        for spans in got[i]["pii"]:
            for s in spans:
                assert t[s["start"] : s["end"]] == s["value"]


def test_checksums_and_context(frame):
    texts = ["iban GB82 WEST 1234 5698 7654 32 ok", "iban GB83 WEST 1234 5698 7654 32 no", "ssn 123-45-6789", "part 123-45-6789 of", "api_key = sk9f8e7d6c5b4a3b2c1d0e", "sk9f8e7d6c5b4a3b2c1d0e alone"]
    got = by_id(pii.find(frame(rows_of(texts))))
    assert [len(got[i]["pii"]["iban"]) for i in (0, 1)] == [1, 0]
    assert [len(got[i]["pii"]["ssn"]) for i in (2, 3)] == [1, 0]
    assert [len(got[i]["pii"]["secret"]) for i in (4, 5)] == [1, 0]
    clean = by_id(pii.redact(frame(rows_of(["write to a@b.com now", "nothing", None]))))
    assert [clean[i]["text"] for i in range(3)] == ["write to [EMAIL] now", "nothing", None]


def check_packed(rows, ids_of, seq_len):
    import zlib

    import numpy as np

    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(ids_of)
    for doc, own in pieces.items():
        own.sort(key=lambda r: r["start"])
        at = 0
        for r in own:
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids_of[doc])
            assert r["ids_crc32"] == zlib.crc32(np.array(ids_of[doc][at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids_of[doc])
    for own in windows.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= seq_len
    assert len(windows) == -(-sum(map(len, ids_of.values())) // seq_len)
    return windows


def test_packing_keeps_every_id_once_and_holds_the_mixture(frame):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(10)
    texts = [None, "", " \n", "Hello, World!! it's 3.5% <|endoftext|> <b>", "naïve ÉCOLE 😀 中文", "a b c \x85 x\x1cy", "ǅ İstanbul ß", "don't stop... (well) #tag @x", "éa"] + [" ".join(words(rng, rng.randint(1, 300))) for _ in range(150)]
    sources = [["big", "small", None][0 if i % 10 < 7 else 1 if i % 10 < 9 else 2] for i in range(len(texts))]
    tokens = packing.tokenized(frame(rows_of(texts, sources)), public_tokenizers.path("word_bpe_49k.json")).cache()
    ids_of = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    windows = check_packed(packing.pack(tokens, 1024).collect(), ids_of, 1024)
    total = sum(map(len, ids_of.values()))
    share = sum(len(ids_of[i]) for i, s in enumerate(sources) if s == "big") / total
    longest = max(map(len, ids_of.values()))
    for k, own in windows.items():
        if k < len(windows) - 1:
            big = sum(r["length"] for r in own if sources[r["doc_id"]] == "big")
            assert abs(big - share * 1024) <= 3 * longest


def test_packing_takes_weights(frame):
    import public_tokenizers

    rng = random.Random(11)
    texts = [" ".join(words(rng, 20)) for _ in range(400)]
    sources = ["a" if i % 2 else "b" for i in range(400)]
    tokens = packing.tokenized(frame(rows_of(texts, sources)), public_tokenizers.path("word_bpe_49k.json")).cache()
    rows = packing.pack(tokens, 512, {"a": 3.0, "b": 1.0}).collect()
    first = [r for r in rows if r["sequence_id"] < 8]
    a = sum(r["length"] for r in first if sources[r["doc_id"]] == "a")
    assert 0.65 < a / sum(r["length"] for r in first) < 0.85


@pytest.mark.parametrize("empty", [False, True])
def test_odd_tables(spark, odd, empty):
    import public_tokenizers

    docs = odd.limit(0) if empty else odd
    n = docs.count()
    assert suffixes.dedup(docs).count() == n
    assert lines.dedup(docs, 2).count() == n
    stats = quality.statistics(docs)
    trees = quality.train(stats, spark.createDataFrame([(3, 1, None), (5, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int"))
    assert quality.judge(stats, trees).count() == n
    assert quality.keep(docs, trees).columns == docs.columns
    assert jaccard.join(docs).count() == n
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert bpe.encode(docs, ranks, public_tokenizers.PATTERN).count() == n
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs).count() == n
    tokens = packing.tokenized(docs, public_tokenizers.path("word_bpe_49k.json")).cache()
    assert packing.pack(tokens).agg({"length": "sum"}).first()[0] == tokens.agg({"n": "sum"}).first()[0]
