"""Nearest neighbours, pages and the pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from helpers import rows_of, words
from pyspark.sql import functions as F

from docketry.llm import ann, html, warc


def brute_nearest(ids, vectors, queries, k):
    out = {}
    for q in queries:
        x = vectors[q]
        scores = sorted((-float((x * v).sum() / (np.sqrt((x**2).sum()) * np.sqrt((v**2).sum()))), i) for i, v in zip(ids, vectors, strict=True) if i != q)
        out[q] = scores[:k]
    return out


def test_nearest_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 24))
    vectors = np.concatenate([centres[rng.integers(0, 20, 560)] + 0.4 * rng.normal(size=(560, 24)), np.repeat(rng.normal(size=(1, 24)), 40, axis=0)]).astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (950, [0.0] * 24), (1000, [float("nan")] * 24), (1050, [1.0, None] + [0.0] * 22), (1100, [1.0] * 3)]
    df = spark.createDataFrame(rows + rows[1:3], "vec_id long, vector array<double>")  # repeated rows are candidates of their own
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    want = brute_nearest(range(600), vectors, range(0, 600, 50), 5)
    assert set(got) == set(want)
    hits = 0
    for q, best in want.items():
        assert [r for _, _, r in got[q]] == [1, 2, 3, 4, 5]
        for v, score, _ in got[q]:
            x, y = vectors[q], vectors[v]
            assert abs(score - (x @ y) / np.sqrt((x @ x) * (y @ y))) < 1e-12
        hits += len({v for v, _, _ in got[q]} & {v for _, v in best})
    assert hits >= 0.9 * 5 * len(want)
    # Equal vectors tie exactly: a query among 560..599 meets the smallest other ids that bear its vector.
    twins = ann.nearest(df, F.col("vec_id").isin(560, 575)).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in twins] == [561, 562, 563, 564, 565, 560, 561, 562, 563, 564]


def test_vectors_of_any_finite_length(spark):
    rng = np.random.default_rng(8)
    vectors = np.concatenate([rng.normal(size=(30, 8)), np.full((1, 8), 1e-200), np.full((1, 8), 1e200), rng.normal(size=(2, 8)) * 1e300, rng.normal(size=(2, 8)) * 1e-308])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, vector array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, F.lit(True)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    hits = 0
    for q, best in brute_nearest(range(len(unit)), unit, range(len(unit)), 5).items():
        assert len(got[q]) == 5 and np.isfinite([s for _, s in got[q]]).all()
        for v, score in got[q]:
            assert abs(score - unit[q] @ unit[v] / np.sqrt((unit[q] @ unit[q]) * (unit[v] @ unit[v]))) < 1e-12
        hits += len({v for v, _ in got[q]} & {v for _, v in best})
    assert hits >= 0.9 * 5 * len(unit)


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (7, [1.0, 1.0]), (50, [0.0, 2.0])], "vec_id long, vector array<double>")
    got = [tuple(r) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7), (0, 2, 50), (50, 1, 7), (50, 2, 0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_pigeonhole_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    coder = ann.Codes(np.zeros(64), np.zeros((64, ann.BITS)), 40, ann.BITS)
    for radius in (15, 16, 40, 71):
        shares = coder.shares(radius)
        assert sum(shares) == radius - coder.m + 1
        codes = rng.integers(0, 2**63, (2000, 4), dtype=np.uint64)
        near = codes.copy()
        for _ in range(radius):
            near[np.arange(2000), rng.integers(0, 4, 2000)] ^= np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64)
        hit = (np.bitwise_count(ann.subs(codes) ^ ann.subs(near)) <= shares).any(axis=1)
        assert hit[np.bitwise_count(codes ^ near).sum(axis=1) <= radius].all()


def _clustered(seed, groups, size, noise):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 64))
    return (np.repeat(centres, size, axis=0) + noise * rng.normal(size=(groups * size, 64)))[rng.permutation(groups * size)]


def test_buckets_leave_most_vectors_uncompared(spark, tmp_path):
    """50,000 vectors of 5,000 clusters: recall, and how many of the pairs were compared."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    x = _clustered(3, 5_000, 10, 0.35)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "vector": pa.array(list(x))}), tmp_path / "v.parquet")
    compared = spark.sparkContext.accumulator(0)
    rows = ann.nearest(spark.read.parquet(str(tmp_path / "v.parquet")), F.col("vec_id") % 50 == 0, compared=compared).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    queries = np.arange(0, len(x), 50)
    scores = unit[queries] @ unit.T
    scores[np.arange(len(queries)), queries] = -np.inf
    best = np.argpartition(-scores, 5, axis=1)[:, :5]
    got = {(r["query_id"], r["vec_id"]) for r in rows}
    recall = np.mean([(q, v) in got for q, b in zip(queries.tolist(), best.tolist(), strict=True) for v in b])
    share = compared.value / (len(queries) * len(x))
    print(f"recall {recall:.3f}, compared {compared.value} of {len(queries) * len(x)} pairs ({share:.4f})")
    assert len(rows) == 5 * len(queries) and recall >= 0.9
    assert ann.PREFIX > 6 and share < 0.05


def test_hot_buckets_give_what_others_give(spark, monkeypatch):
    x = np.concatenate([_clustered(4, 30, 10, 0.3), np.ones((300, 64)) + 0.05 * np.random.default_rng(5).normal(size=(300, 64))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>")
    plain = sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 50 == 0).collect()))
    for name, value in (("HOT_ROWS", 16), ("GROUP_ROWS", 8), ("STEP", 3)):
        monkeypatch.setattr(ann, name, value)
    assert sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 50 == 0).collect())) == plain
    # All of the tight cluster's queries find their neighbours in it.
    assert all(r[2] >= 300 for r in plain if r[0] >= 300)


def test_rows_that_repeat_an_id_are_candidates_and_queries(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [4.0, 0.0]), (3, [8.0, 0.0]), (4, [1.0, 1.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, vector array<double>, entry string, uid string")
    got = Counter((r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect())
    half = round(0.5**0.5, 9)
    same = [(1, 0, 1.0), (2, 1, 1.0), (3, 2, 1.0), (4, 3, 1.0), (5, 4, half)]
    assert got == Counter([*same, *same, (1, 4, half), (2, 0, 0.0), (3, 0, 0.0), (4, 1, 0.0), (5, 2, 0.0)])


PAGE = """<!doctype html><html><head><title>T</title><style>x</style></head><body>
<header class="site-header">Top <a href="/">home</a></header><nav><ul><li>Menu</li></ul></nav>
<div id="cookie-notice">We use cookies</div><div class="ad-banner">Buy now</div>
<div class="wrap"><article class="post post-{n}"><h1>Title {n}</h1><p>First &amp; main para<b>graph</b> of   page {n} which is long enough to win the vote.</p>
<!-- hidden --><script>var x = "<p>no</p>";</script><p>Second one &lt;{n}&gt;&nbsp;caf&eacute;.<br>After</p><ul><li>point a<li>point b</ul></article>
<aside class="sidebar">Related things to read that are many</aside><section id="comments"><p>A reader comment that goes on and on and on for long</p></section></div>
<form><input value="q">Search</form><footer>Foot</footer></body></html>"""


def test_main_text_of_pages(spark):
    rows = [(n, f"http://h{n % 2}.example/{n}", PAGE.replace("{n}", str(n))) for n in range(6)] + [(6, None, None), (7, "x", ""), (8, "http://h0.example/z", "plain words only"), (9, "http://h0.example/y", "<div><p>unclosed <b>tags and text")]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in range(6):
        assert got[n]["text"] == f"Title {n} First & main paragraph of page {n} which is long enough to win the vote. Second one <{n}> café. After point a point b"
        assert got[n]["n_chars"] == len(got[n]["text"])
    assert [got[n]["text"] for n in (6, 7, 8, 9)] == ["", "", "plain words only", "unclosed tags and text"]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_records_round_trip(spark, tmp_path):
    rows = [(n, f"http://h/{n}", PAGE.replace("{n}", str(n))) for n in range(3)] + [(3, None, None), (3, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    derived = warc.derive(warc.responses(pages), keep=("page_id",)).cache()
    assert derived.count() == 2 * len(rows)
    warc.save(derived, str(tmp_path / "out"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    records = list(warc.parse(data))
    assert len(records) == 2 * len(rows)
    source = {r["record_id"]: r for r in warc.responses(pages).collect()}
    by_id = {h["WARC-Record-ID"]: (h, block) for h, block in records}
    for head, block in records:
        of = source[head["WARC-Refers-To"].strip("<>")]
        assert head["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        assert head["WARC-Source-Payload-Digest"] == "sha256:" + hashlib.sha256(of["payload"].encode()).hexdigest()
        assert head["WARC-Refers-To-Target-URI"] == (of["target_uri"] or "")
        assert by_id[head["WARC-Concurrent-To"]][0]["WARC-Concurrent-To"] == head["WARC-Record-ID"]
        if head["WARC-Type"] == "conversion":
            assert b"<p>" not in block and b"var x" not in block


def _page(rng, n):
    """A page and its article's text; what stands around the article varies."""
    said = lambda k: " ".join(words(rng, k))
    lead, parts, title = said(6), [said(rng.randint(20, 60)) for _ in range(rng.randint(2, 5))], said(4)
    other = lambda name: f'<div class="{name}"><p>{said(30)}</p></div>'
    kind = n % 4
    if kind == 0:  # headline and lead beside the body
        body, want = f'<article><h1>{title}</h1><p>{lead}</p><div class="body">' + "".join(f"<p>{p}" for p in parts) + "</div></article>", [title, lead, *parts]
    elif kind == 1:  # sections of different classes, no article
        body, want = f'<div class="content has-sidebar"><h1>{title}</h1>' + "".join(f'<section class="part{"" if i else " intro"}"><p>{p}</p></section>' for i, p in enumerate(parts)) + "</div>", [title, *parts]
    elif kind == 2:  # classes inside the article that hold words for something else
        body, want = f'<main><div class="share-price-report"><p>{lead}</p></div><div class="no-ads">' + "".join(f"<p>{p}</p>" for p in parts) + f"</div>{other('related-posts')}</main>", [lead, *parts]
    else:  # the article inside a wrapper that is named for what it also holds
        body, want = f'<div id="page" class="with-header notice"><article><h2>{title}</h2>' + "".join(f"<p>{p}</p>" for p in parts) + f"{other('ad-banner')}</article></div>", [title, *parts]
    head = f"<head><title>{title}</title><meta charset=utf-8>" + ("</head>" if n % 3 else "")
    if n // 4 % 4 == 1:  # names of attributes in the values of others
        body = f'<div style="overflow:hidden" data-role="navigation" data-id="banner" onclick="x.hidden=1" title=\'hidden "gems"\'>{body}</div>'
    attrs = ' aria-hidden="true"' if n // 4 % 4 == 3 else ""
    if n // 4 % 4 == 2:  # a form around the whole page
        page = f'<html>{head}<body><form id="aspnetForm" method="post"><nav><a href="/">{said(9)}</a></nav>{body}<aside>{said(20)}</aside><div id="comments">{said(5)}</div></form></body></html>'
        return page, " ".join(want)
    page = f'<html>{head}<body class="with-header"{attrs}><nav><a href="/">{said(9)}</a></nav>{other("cookie-notice")}{body}<aside>{said(20)}</aside><div id="comments">{said(25)}</div><footer>{said(5)}</footer></body></html>'
    return page, " ".join(want)


def test_main_text_of_made_pages(spark):
    rng = random.Random(21)
    made = [_page(rng, n) for n in range(160)]
    rows = [(n if n % 9 else None, f"https://site{n % 4}.example/{n}", p, str(n), "x") for n, (p, _) in enumerate(made)]
    got = {r["url"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string, paths string")).collect()}
    for n, (_, want) in enumerate(made):
        assert got[f"https://site{n % 4}.example/{n}"]["text"] == want, n


def test_what_is_left_out_of_a_page():
    story = "<p>" + "The council met to hear the plan. " * 6 + "</p>"
    said = " ".join(("The council met to hear the plan. " * 6).split())

    def text(page):
        parsed = html.Page(page)
        return parsed.text(next((p for p, _ in parsed.best(1)), None))

    for page in (
        f'<nav>Menu</nav><div style="overflow:hidden">{story}</div>',
        f'<form id="aspnetForm"><div class="main">{story}</div><input type=hidden></form><footer hidden>Foot</footer>',
        f'<form><article>{story}</article><div role="dialog">Log in</div></form>',
        f'<body aria-hidden="true"><div>{story}</div></body>',
        f'<article>{story}<p class="newsletter-signup">Sign up</p></article><aside><article>Read also</article></aside>',
        f'<div data-x="class=ad" CLASS=content>{story}</div><div hidden>Not shown</div><div role=navigation>Menu</div>',
        f'<article>{story}<form>Name <button>Send</button></form><div class="comments">{story}</div></article>',
    ):
        assert text(page) == said, page
    assert text(f'<article>{story}<p class="story-alert">A storm came.</p></article>') == f"{said} A storm came."


def test_pages_of_broken_markup_take_linear_time(spark):
    import time

    long = "a long sentence of the story " * 40
    pages = ['<a "' * 100_000, "<div class='x" * 100_000, "<!" * 100_000, "<" * 200_000, "<p>" * 50_000, "<div>" * 50_000 + long, f"<html><head><title>t</title><p>{long}", f"<html><head><style>x</style>{long}", "x" * 2_000_000]
    began = time.monotonic()
    texts = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")).collect()}
    assert time.monotonic() - began < 60
    assert [texts[i] for i in (5, 6, 7)] == [long.strip()] * 3 and len(texts[8]) == 2_000_000


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "title", "template", "noscript")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "title", "template", "noscript") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_conversion_records_hold_the_visible_text_and_metadata_the_links(spark):
    rng = random.Random(22)
    made = [_page(rng, n)[0].replace("<p>", f'<p><a href="/to/{n}">x &amp; y</a> ', 1) for n in range(40)]
    pages = spark.createDataFrame([(n, f"http://h/{n}\r\nWARC-Type: evil", p) for n, p in enumerate(made)] + [(0, "http://h/0", made[0])] * 3 + [(None, "http://h/n", "a"), (None, "http://h/n", "b")], "page_id long, url string, html string")
    derived = warc.derive(warc.responses(pages), keep=("page_id",)).cache()
    assert derived.select("record_id").distinct().count() == derived.count() == 2 * (40 + 5)
    for r in derived.where("page_id > 0").collect():
        if r["record_type"] == "conversion":
            seen = _Visible()
            seen.feed(made[r["page_id"]])
            assert "".join(r["content"].split()) == "".join("".join(seen.out).split())
        else:
            assert f"outlink: /to/{r['page_id']}\r\n" in r["content"]
    heads = warc.serialized(derived).collect()
    assert not any("\nWARC-Type: evil" in r["record"] for r in heads)


def test_warc_files_are_read(spark, tmp_path):
    import gzip

    def record(kind, n, block):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{n}>\r\nWARC-Target-URI: http://h/{n}\r\nWARC-Date: 2024-01-0{n}T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n"
    blocks = [record("warcinfo", 1, b"software: x"), record("response", 2, http + "caf\xe9".encode("latin-1")), record("response", 3, b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress("naïve".encode())), record("response", 4, b"HTTP/1.1 204 No Content\r\n\r\n")]
    (tmp_path / "a.warc").write_bytes(b"".join(blocks[:2]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, blocks[2:])))
    got = sorted(tuple(r)[:3] + (r["payload"],) for r in warc.read(spark, str(tmp_path)).collect())
    assert got == [(f"urn:uuid:{n}", f"http://h/{n}", f"2024-01-0{n}T00:00:00Z", text) for n, text in ((2, "café"), (3, "naïve"), (4, ""))]
    assert warc.derive(warc.read(spark, str(tmp_path))).count() == 6


@pytest.fixture
def corpus(spark, tmp_path):
    """Documents and labels whose fate in the pipeline is known."""
    rng = random.Random(12)
    line = " ".join(words(rng, 9))
    good = ["\n".join([" ".join(words(rng, 60)), line, " ".join(words(rng, 40))]) for _ in range(60)]
    copies = [good[0], good[1].replace("\n", " \n"), good[2] + " extra word"]
    junk = ["#### spam | spam | spam ####" * 20, "short text", None, ""]
    mail = [good[3].rsplit(" ", 1)[0] + " new words to stand apart " + " ".join(words(rng, 80)) + " write to joe@example.com"]
    rows = [(i, t, "en", f"s{i % 15}", len(t or "")) for i, t in enumerate(good + copies + junk + mail)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(63, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), good, line


def test_pipeline_stages(spark, corpus):
    import corpus_pipeline

    sf, good, line = corpus
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    after_rules, after_lines, after_copies, after_pii = seen
    assert set(after_rules) == {*range(63), 67}
    assert sum(line in t for t in after_lines.values()) == 1
    assert set(after_copies) == {*range(60), 67}
    assert after_pii[67].endswith("write to [EMAIL]") and not any("@" in t for t in after_pii.values())
    pieces = corpus_pipeline.run(spark, sf).collect()
    tokens = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert set(tokens) == set(after_pii)
    got = defaultdict(int)
    for r in pieces:
        got[r["doc_id"]] += r["length"]
    assert got == tokens
    assert all(re.fullmatch(r"[a-z0-9_]+", c) for c in pieces[0].asDict())


def test_registry_names(spark):
    from docketry.llm import registry

    names = [n for n in registry.queries() if n != "pipeline"]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert rows_of(["x"])[0][1] == "x"
