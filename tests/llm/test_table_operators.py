"""WARC, sharding, HTML, search, mixing, near copies, and the pipeline, against brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vertexloom.llm import html_text, mixing, pages_by_build, sharding, simhash, topk, warc
from vertexloom.llm.common import fresh_path, table

from .conftest import DE, EN, rows_of

# WARC


def archive(spark, rows, **how):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = fresh_path(spark, "test-warc")
    warc.write_archive(df, path, **how)
    return path


FAKE = "before WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nbroken"


def test_archive_round_trip(spark):
    big = "y" * 200
    rows = [(1, "http://a/", "x" * 50), (2, None, big), (3, "http://b/ \r\nX: 1", big), (4, "u", None), (5, "u", ""), (6, "u", FAKE + "é" * 100), (7, "u", "WARC/1.1\r\n"), (8, "u", FAKE), (None, "u", big), (9, "u", "x" * 50), (2, "u", big)]
    found = warc.read_archive(spark, archive(spark, rows))
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found.collect()), key=repr)
    expected = []
    for i, _, h in rows:
        payload = (h or "").encode()
        again = h == big and i != 2
        expected.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert got == sorted(expected, key=repr)


def test_false_records_alone_are_dropped(spark):
    path = archive(spark, [(i, "u", f"{i} " + FAKE * (i % 3)) for i in range(12)])
    every = warc.candidates(spark, path).where("offset >= 0")
    kept = warc.chained(warc.candidates(spark, path))
    assert every.count() > kept.count() == 12


def test_successors_that_skip_are_followed(spark):
    """Runs that a jump enters in their middle, over several rounds of doubling."""
    rng = random.Random(5)
    rows = [(i, "u", "".join(rng.choice([FAKE, "text ", "WARC/1.1\r\nContent-Length: 40\r\n\r\n"]) for _ in range(rng.randrange(9)))) for i in range(60)]
    found = {r["page_id"]: r for r in warc.read_archive(spark, archive(spark, rows, least=10**9)).collect()}
    assert {i: hashlib.sha256(h.encode()).hexdigest() for i, _, h in rows} == {i: r["payload_digest"] for i, r in found.items()}


def test_empty_archive(spark):
    assert warc.read_archive(spark, archive(spark, [])).count() == 0


# sharding


def brute_capacity(sizes, shards):
    best = [0] + [float("inf")] * len(sizes)
    prefix = np.concatenate([[0], np.cumsum(sizes)])
    for _ in range(shards):
        best = [min(max(best[j], prefix[i] - prefix[j]) for j in range(i + 1)) for i in range(len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize("seed", range(4))
def test_capacity_is_minimal(spark, seed):
    rng = np.random.default_rng(seed)
    keys = np.sort(rng.choice(1 << 62, 60, replace=False)) - (1 << 61)
    sizes = rng.integers(1, 50, 60)
    if seed % 2:
        sizes[7] = sizes.sum() // 2
    rows = spark.createDataFrame([(int(k), int(s)) for k, s in zip(keys, sizes, strict=True)] * 2, "key long, size long")
    capacity, cuts = sharding.minimax_cuts(rows, 5)
    assert capacity == brute_capacity(2 * sizes, 5)
    where = np.searchsorted(cuts, keys, "right")
    assert max(Counter({s: 0 for s in range(5)} | {int(s): int(2 * sizes[where == s].sum()) for s in set(where)}).values()) == capacity and where.max() < 5


def test_shards(spark, odd, crowded, empty):
    for law in ("bytes", "rows", "key"):
        out = sharding.shard(odd, 3, law)
        rows = out.collect()
        assert len(rows) == odd.count() and {r["law"] for r in rows} == {law}
        for s in range(3):
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
        texts = {(r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in odd.collect()}
        assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == texts
        assert sharding.shard(empty, 3, law).count() == 0 and sharding.shard(crowded, 3, law).count() == len(rows)
    by_text = {}
    for r in sharding.shard(odd, 3).collect():
        by_text.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())
    counts = Counter(r["shard"] for r in sharding.shard(odd, 4, "rows").collect())
    assert max(counts.values()) - min(counts.values()) <= 1
    assert all(r["grown_shard"] in (r["shard"], 3) for r in sharding.shard(odd, 3, "key").collect())
    with pytest.raises(ValueError):
        sharding.shard(odd, 3, "none")


# HTML


def test_extraction():
    body = "<article><h1>A &amp; B</h1><p>One  two\n three <b>four</b>.<p>Five<br>six &eacute;&#33;</article>"
    page = f"<html><head><title>T</title><style>p{{}}</style><script>if (a<b) '</p>'</script></head><body><nav><a href=/>Home</a></nav><div class='ad banner'>Buy it now for less money</div>{body}<footer>&copy; all of us</footer>"
    assert html_text.extract(page) == "A & B\nOne two three four.\nFive six é!"
    assert html_text.extract("") == "" and html_text.extract("<p></p><!-- x") == ""


def test_blocks_within_the_text():
    """Blocks that are left out part nothing, however long they are beside the text before and behind them."""
    junk, long = "buy new boots " * 40, "and so it went on " * 30
    for block in (f"<div class=ad>{junk}</div>", f"<aside><p>{junk}</p></aside>", f"<form>{'<p>x</p>' * 50}</form>", f"<section id=comments>{junk}</section>"):
        for top in ("article", "main", "div id=content", "div"):
            page = f"<{top}><h1>The river rose again</h1>{block}<p>{long}</p>{block}<p>It was the end of it.</p></{top.split()[0]}>"
            assert html_text.extract(page) == f"The river rose again\n{long.strip()}\nIt was the end of it.", page


def test_containers_with_never_words():
    """Class lists that name a sidebar or comments by the way, and pages within one form, keep their text."""
    body = "<h1>The river rose again</h1><p>It was the end of it.</p>"
    text = "The river rose again\nIt was the end of it."
    for tag in ('div class="content with-sidebar"', 'div id=main class="social-enabled"', 'section class="entry-content comments-open"'):
        assert html_text.extract(f"<nav>home news</nav><{tag}>{body}</{tag.split()[0]}>") == text, tag
    inner = (f"<article>{body}</article>", f"<main>{body}</main>", f"<div id=content>{body}</div>")
    for outer in ('form action="/"', 'div class="page with-sidebar"', 'div class="page social-enabled"'):
        for x in inner:
            assert html_text.extract(f"<{outer}><nav>home news</nav>{x}<p>search here</p></{outer.split()[0]}>") == text, (outer, x)
    # what is left out stays out
    for junk in ('<div class="sidebar-content"><p>no no</p></div>', "<section id=comments><article><p>no no</p></article></section>", '<form><label>no no</label></form>', '<div hidden><main>no no</main></div>', "<aside><article>no no</article></aside>"):
        assert html_text.extract(f"<article>{body}</article>{junk}") == text, junk


def test_pages_of_other_builds():
    """Pages drawn with another seed than those learned from: blocks found of blocks there are, and the other way round."""
    there = found = both = 0
    for page, spans, text in pages_by_build.labelled_pages(300, 99):
        assert [page[a:b] for a, b in spans][0].split()[0] in page and spans == sorted(spans)
        own, got = Counter(text.split("\n")), Counter(html_text.extract(page).split("\n"))
        there, found, both = there + own.total(), found + got.total(), both + (own & got).total()
    assert both / there > 0.97 and both / found > 0.96


def test_weights_decide():
    page = "<nav><ul><li><a href=/>Home</a></li></ul></nav><div class=ad>Buy it now</div><article><h1>The river rose</h1><p>It was the end of it.</p></article><footer>All of us</footer>"
    weights = html_text.default_weights()
    assert html_text.extract(page) == "The river rose\nIt was the end of it." and html_text.extract(page, {}) == ""
    turned = {k: v if k.startswith("tag:") else -v for k, v in weights.items()}
    assert "river" not in html_text.extract(page, turned) and html_text.extract(page, turned)
    # learned from pages where what is called an advert is the text, it is the text
    pages = []
    for k in range(40):
        text = f"<p>word {'more ' * (k % 7)}end</p>"
        html = f"<article><h1>Top</h1>{text}</article><div class=ad>"
        pages.append((f"{html}{text}</div>", [(len(html), len(html) + len(text))]))
    assert html_text.extract("<article><h1>Top</h1><p>word here end</p></article><div class=ad><p>what it says</p></div>", html_text.learn(pages)) == "what it says"


def test_best_run_against_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        scores = [rng.choice([-3.0, -1.0, -0.5, 0.0, 1.0, 2.5]) for _ in range(rng.randrange(12))]
        sums = {(a, b): sum(scores[a : b + 1]) for a in range(len(scores)) for b in range(a, len(scores))}
        best, run = max(sums.values(), default=0), html_text.best_run(scores)
        assert run is None if best <= 0 else sums[run] == best


@pytest.mark.parametrize("page", ["<a " * 350_000, "<b>" * 20_000 + "x" + "</i>" * 20_000, '<a ="> ' * 150_000, "<p><li>" + "<b>" * 20_000 + "<hr>" * 20_000, "<div class=a>" * 50_000, "<" * 500_000, "<!--" * 200_000, "<script>" * 100_000, "<object>" * 50_000])
def test_hostile_pages_take_linear_time(page):
    html_text.default_weights()
    began = time.perf_counter()
    html_text.extract(page)
    assert time.perf_counter() - began < 6


def test_elements_without_an_end():
    body = "<h1>The river rose again</h1><p>It was the end of it.</p>"
    for junk in ("<svg/>", "<object data=x>", "<canvas id=c>", "<video src=v>", "<iframe src=x>", "<object></object>", "<template/>"):
        assert html_text.extract(f"<div>{junk}{body}</div>") == "The river rose again\nIt was the end of it.", junk
    for o in ('div class="page has-sidebar"><article', 'div id="main-search-results"', 'article><div class="share-price content"'):
        assert html_text.extract(f"<{o}>{body}") == "The river rose again\nIt was the end of it.", o
    assert html_text.extract(f'<article>{body}<p class="alert">Mind the water.</p></article>').endswith("Mind the water.")
    assert html_text.extract(f"<article>{body}<p>AT&amp;T R&am<b>p;D</b></p></article>").endswith("AT&T R&amp;D")


def test_pieces_that_never_belong():
    text = "<p>" + "The field lay under water for a week. " * 6 + "</p>"
    for extra in ("<aside><p>More to read here today</p></aside>", "<form><label>Mail</label><button>Go</button></form>", "<div id='comments'><p>I liked it a lot myself</p></div>", "<div class=cookie-consent>We use cookies here</div>", "<div hidden>secret words</div>", "<noscript>turn it on</noscript>", "<header><p>By somebody else</p></header>", "<footer>Filed under fields</footer>"):
        for page in (f"<article><h1>Water</h1>{text}{extra}{text}</article>", f"<article>{text}{text}</article>{extra}"):
            got = html_text.extract(page)
            assert "water" in got and not set(re.findall(r"More|Mail|liked|cookies|secret|turn|somebody|Filed", got)), (extra, got)


def test_broken_markup():
    words = "The field lay under water for a week and a day. " * 4
    for page in (f"<div><p>{words}<p>{words}", f"<article><p>{words}<b><p>{words}</article></div></div>", f"<p {words}", f"<article>{words} a < b <p>{words}</article>", f"<article><p title='x>y'>{words}</p></article>", f"<ul><li>{words}<li>{words}</ul>"):
        assert isinstance(html_text.extract(page), str)
    assert html_text.extract(f"<article>{words} a < b</article>").endswith("a < b")
    long = "<article>" + f"<p>{words}</p>" * 3000 + "</article>"
    assert html_text.extract(long).count("\n") == 2999


def test_pages(spark, sf_dir):
    out = html_text.extract_pages(table(spark, sf_dir, "pages"))
    assert out.count() == table(spark, sf_dir, "pages").count() and out.where("n_chars <> char_length(text)").isEmpty()
    rows = spark.createDataFrame([(1, None), (2, ""), (None, "<p>x</p>")], "page_id long, html string")
    assert rows_of(html_text.extract_pages(rows).select("page_id", "text", "n_chars"))[:2] == [(1, "", 0), (2, "", 0)]
    assert html_text.extract_pages(rows.limit(0)).count() == 0
    # clashing names, repeated and equal rows
    again = rows.unionByName(rows).withColumns({"text": F.lit("mine"), "N_CHARS": F.lit(-1), "_text": F.lit("too")})
    found = html_text.extract_pages(again)
    assert found.columns == ["page_id", "html", "__text", "_N_CHARS", "_text", "text", "n_chars"]
    assert rows_of(found.select("page_id", "text", "n_chars").distinct()) == rows_of(html_text.extract_pages(rows).select("page_id", "text", "n_chars"))
    assert found.where("__text <> 'mine' or _text <> 'too'").isEmpty() and found.count() == 6


# search


def brute_search(rows, k, scale=64):
    good = [(i, np.array([int(np.floor(scale * float(x))) for x in v], dtype=object)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % 20 == 0}):
        # rows that share an id ask together
        dot = [(-sum(int(a) * int(b) for a, b in zip(v, w, strict=False)), i) for j, v in good if j == q for i, w in good if i != q]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(dot)[:k])]
    return sorted(out)


def searched(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return sorted(tuple(r) for r in topk.search(df, F.col("id") % 20 == 0, k).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("side", [64, 8 << 20])
def test_search(spark, monkeypatch, side):
    monkeypatch.setattr(topk, "SIDE_BYTES", side)
    monkeypatch.setattr(topk, "LEAST_SIDE", 16)
    monkeypatch.setattr(topk, "STRIP", 3)
    monkeypatch.setattr(topk, "CHUNK", 16)
    monkeypatch.setattr(topk, "PROBES", 30)
    rng = np.random.default_rng(0)
    common = rng.normal(size=8).astype(np.float32).tolist()
    rows = [(i, common if i % 3 == 0 else rng.normal(size=8).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200, None), (220, []), (240, [1.0, None]), (260, [float("nan")] * 8), (280, [float("inf")] * 8), (None, common), (300, [0.5, -0.25]), (40, rows[40][1])]
    assert searched(spark, rows) == brute_search(rows, 5)


def test_search_few_and_large(spark):
    assert searched(spark, []) == []
    assert searched(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 64 * 128)]
    big = [(0, [1e6, 3e5]), (20, [2e6, 1.0]), (21, [1e6, 1e6])]
    assert searched(spark, big) == brute_search(big, 5)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    q, x = rng.normal(size=(20, 13)), rng.normal(size=(30, 13))
    for energy in (np.full(13, 1 / 13), topk.turned(x)[1], np.eye(13)[0], np.eye(13)[12]):
        for n in (*topk.LEVELS, 13, 40):
            cuts = topk.cuts_of(energy, n)
            assert cuts[0] == 0 and cuts[-1] == 13 and len(cuts) == min(n, 13) + 1 and (np.diff(cuts) > 0).all()
            assert (topk.statistics(q, cuts) @ topk.statistics(x, cuts).T >= q @ x.T - 1e-9).all()
    directions, energy = topk.turned(x)
    assert np.allclose((q @ directions) @ (x @ directions).T, q @ x.T) and energy.sum() == pytest.approx(1) and (np.diff(energy) <= 0).all()


def test_most_pairs_are_dropped_by_bounds():
    """Vectors with energy in some directions: coarse to fine, each level leaves fewer pairs, and few are computed exactly."""
    rng = np.random.default_rng(2)
    x = np.floor(64 * rng.normal(size=(4000, 32)) / np.arange(1, 33) @ np.linalg.qr(rng.normal(size=(32, 32)))[0])
    ids, good, counts = np.arange(len(x)), np.ones(len(x), bool), []
    scores = (x[::20] @ x.T).astype(int)
    scores[np.arange(200), np.arange(0, 4000, 20)] = -(10**9)
    floor = np.sort(scores[:, :400], 1)[:, -20]
    found = topk.best(ids[::20], x[::20], ids, x, 20, good[::20], good, floor, *topk.turned(x), counts)
    expected = [(20 * q, int(c), int(row[c])) for q, row in enumerate(scores) for c in np.lexsort((ids, -row))[:20]]
    assert sorted(found) == sorted(expected)
    assert counts == sorted(counts, reverse=True) and counts[-1] < counts[0] / 10


def test_huge_values_slow_none_but_their_own(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(60)] + [(60, [2.0**100, 1.0, 0.0, 0.0, 0.0, -1024.0]), (61, [-(2.0**120)] * 6), (62, [2.0**40] * 6)]
    held = [(q, r, i, max(-(1 << 63), min((1 << 63) - 1, s))) for q, r, i, s in brute_search(rows, 100)]
    # scores beyond 64 bits are held at the largest, where smaller ids come first
    expected = []
    for q in sorted({q for q, *_ in held}):
        top = sorted((-s, i) for p, _, i, s in held if p == q)[:5]
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(top)]
    assert searched(spark, rows) == expected


# mixing


def brute_targets(sizes, weights, share, limit):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(1e-300, sum(w[s] for s in rest))
        over = [s for s in rest if level * w[s] > limit * sizes[s]]
        if not over:
            return {s: fixed.get(s, level * w[s]) for s in names}
        fixed |= {s: limit * sizes[s] for s in over}


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROUND_BITS", 4)
    monkeypatch.setattr(mixing, "EDGE", 4)
    rng = random.Random(1)
    sources = [None, "a", "b", "é", "Z", "𝔷"]
    docs = [(i, "w " * rng.randrange(1, 30), "a" if i % 3 == 0 else rng.choice(sources)) for i in range(600)] + [(None, None, "a"), (7, "", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    rows = mixing.mix(df).collect()
    assert len(rows) == len(docs) and [tuple(r) for r in sorted(mixing.mix(df).collect(), key=repr)] == [tuple(r) for r in sorted(rows, key=repr)]
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 2
    expected = brute_targets(sizes, [5.0, 2.0, 1.0], 1.5, 2.0)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(expected[r["source"]])
    assert all(abs(taken[s] - expected[s]) <= 30 for s in sizes)
    out = mixing.mixed_rows(df)
    # the rows are drawn by their content, so the sample is another of the same sizes
    words = Counter()
    for r in out.collect():
        words[r["source"]] += len((r["text"] or "").split())
    assert out.columns == df.columns and all(abs(words[s] - expected[s]) <= 30 for s in sizes)


def test_inclusion_follows_the_odds(spark):
    """Over many seeds: how often a document gets one more copy is its inclusion odds, which are unequal."""
    rng = random.Random(4)
    docs = [(i, "w " * rng.choice([1, 3, 20, 60, 200]), "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1).cache()
    extra, odds, seeds = Counter(), {}, 12
    for seed in range(seeds):
        for r in mixing.mix(df, weights=(3.0, 2.0), total_share=0.9, seed=seed).collect():
            extra[r["source"], r["size"]] += r["copies"] / seeds
            odds.setdefault((r["source"], r["size"]), []).append(r["odds"])
    for key, p in odds.items():
        own = np.array(p[: len(p) // seeds])
        assert len(set(p)) == 1 and abs(extra[key] - own.sum()) < 4.5 * np.sqrt((own * (1 - own)).sum() / seeds) + 1
    for s in "ab":
        mine = [odds[k][0] for k in sorted(odds) if k[0] == s]
        assert mine == sorted(mine) and (mine[0] < mine[-1] or mine[0] in (0, 1))


def test_rows_alike_at_the_cut(spark, monkeypatch):
    """A source of one text many times: as many rows as the target needs are taken, whole lots or parts of them."""
    monkeypatch.setattr(mixing, "EDGE", 16)
    df = spark.createDataFrame([(1, "a b c", "x")] * 300 + [(None, "d e", None)] * 50 + [(2, "f", "y")], "doc_id long, text string, source string").repartition(5)
    rows = mixing.mix(df, weights=(1.0,), total_share=0.5).collect()
    assert len(rows) == 351
    for r in {(r["source"], r["target"], r["size"]) for r in rows}:
        assert abs(sum(x["size"] * x["copies"] for x in rows if x["source"] == r[0]) - r[1]) <= r[2] / 2 + 1e-9
    assert mixing.mixed_rows(df, weights=(1.0,), total_share=0.5).count() == sum(r["copies"] for r in rows)


def test_many_sources_have_the_same_targets(spark, monkeypatch):
    sizes = [(None if i == 9 else f"s{i:03}", (i * 37) % 91) for i in range(60)]
    df = spark.createDataFrame(sizes, "source string, source_size long").repartition(4)
    one = rows_of(mixing.targets(df, [5.0, 2.0, 1.0], 1.5, 2.0))
    monkeypatch.setattr(mixing, "EDGE", 4)
    many = rows_of(mixing.targets(df, [5.0, 2.0, 1.0], 1.5, 2.0))
    expected = brute_targets(dict(sizes), [5.0, 2.0, 1.0], 1.5, 2.0)
    assert one == many and all(t == pytest.approx(expected[s]) for s, _, t in one)


def test_odd_mixing(odd, crowded, empty):
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0
    assert mixing.mixed_rows(crowded).columns == crowded.columns


# near copies


def brute_fingerprint(text, words=4, seed=42):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i : i + words]).encode(), seed) for i in range(max(1, len(found) - words + 1))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def labels(links, n):
    label = list(range(n))
    while True:
        new = [min([label[i], *(label[j] for j in links[i])]) for i in range(n)]
        if new == label:
            return label
        label = new


def test_fingerprints(odd):
    for r in odd.collect():
        assert simhash.fingerprint(r["text"] or "", 4, 42) == brute_fingerprint(r["text"])


@pytest.mark.parametrize("n", [100, 10**6, 10**9, 10**12, 10**15])
def test_bands_miss_no_pair(n):
    masks, rng = simhash.band_masks(n, 4), random.Random(n)
    assert len(masks) <= 70
    for _ in range(500):
        bits = rng.sample(range(64), rng.randrange(5))
        far = sum(1 << b for b in bits)
        assert any(not far & m for m in masks)
    assert len(simhash.band_masks(100, 4)) == 5 and len(simhash.band_masks(10**9, 4)) > 5


@pytest.mark.parametrize("tile", [4, 1024])
def test_links(spark, monkeypatch, tile):
    """Clusters, chains and a crowd around one value, dealt to tiles of any size."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(2)
    values = [int(v) for v in rng.integers(0, 1 << 63, 40)]
    values += [values[0] ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)) for _ in range(60)]
    chain = values[1]
    for b in range(0, 60, 4):
        chain ^= 0b1111 << b
        values.append(chain)
    values = sorted(set(values))
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 4)).collect()}
    linked = [[j for j, w in enumerate(values) if (v ^ w).bit_count() <= 4] for v in values]
    expected = labels(linked, len(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = [roots.get(s, s) for s in signed]
    assert len(set(got)) == len(set(expected)) and len(set(zip(got, expected, strict=True))) == len(set(got))


def test_near_duplicates(odd, crowded, empty):
    out = simhash.near_duplicates(odd)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in out.collect()}
    assert out.count() == odd.count() and found[1] == found[2] and found[1][1] == 1
    assert found[4] == found[5] == found[6] == ("0" * 16, 4) and found[None][1] is None
    assert simhash.near_duplicates(empty).count() == 0 and rows_of(simhash.near_duplicates(crowded)) == rows_of(out)


def near_texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 400))]
        for _ in range(1 + g % 4):
            copy = list(base)
            for _ in range(len(base) // 100):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_deduplication(spark, empty, crowded, odd):
    texts = near_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    kept = sorted(r["doc_id"] for r in simhash.deduplicated(df).collect())
    expected = labels([[j for j, u in enumerate(texts) if jaccard(t, u) >= 0.8] for t in texts], len(texts))
    assert kept == sorted(set(expected))
    assert simhash.deduplicated(empty).count() == 0
    left = simhash.deduplicated(crowded)
    assert left.columns == crowded.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 7, 8, 9, 10, 11] and ids.count(None) == 1


def test_wide_blocks(spark, monkeypatch):
    """The same groups, whatever the blocks and tiles."""
    texts = near_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    whole = rows_of(simhash.deduplicated(df))
    monkeypatch.setattr(simhash, "BLOCK", 4)
    monkeypatch.setattr(simhash, "TILE", 2)
    assert rows_of(simhash.deduplicated(df)) == whole


def graded_texts(shares, groups=6, size=200):
    """Groups of a text and copies whose similarity to it is about each share; copies share less with each other."""
    rng = random.Random(9)
    out = []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(size)]
        out.append(" ".join(base))
        for k, share in enumerate(shares):
            # a run of other words at the end: the shingles that stay are the base's first
            same = round(size * 2 * share / (1 + share))
            out.append(" ".join(base[:same] + [f"x{g}y{k}z{rng.random()}" for _ in range(size - same)]))
    return out


@pytest.mark.parametrize("sets", [1 << 20, 3000])
def test_links_are_confirmed(spark, monkeypatch, sets):
    """Texts under the similarity stay, though their fingerprints are near and others lie between; blocks don't matter."""
    monkeypatch.setattr(simhash, "SETS", sets)
    texts = graded_texts([0.95, 0.9, 0.85, 0.81, 0.78, 0.76, 0.74, 0.7, 0.65, 0.6]) + near_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    kept = sorted(r["doc_id"] for r in simhash.deduplicated(df).collect())
    assert kept == sorted(set(labels([[j for j, u in enumerate(texts) if jaccard(t, u) >= 0.8] for t in texts], len(texts))))


# pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        path = fresh_path(spark, f"test-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == table(spark, sf_dir, "documents").columns
        if k < 3:
            assert 0.5 * before < docs.count() <= before
    assert {"doc_id", "ids"} <= set(docs.columns) and docs.count() > 0


def test_empty_pipeline(spark, empty, sf_dir):
    import corpus_pipeline

    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, f"test-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.count() == 0


def test_shared_texts_stay(spark):
    """A passage that many documents share doesn't make them copies."""
    rng = random.Random(6)
    words = [f"v{i}" for i in range(5000)]
    passage = EN + DE
    rows = [(i, " ".join(rng.choice(words) for _ in range(120)) + " " + passage) for i in range(40)]
    assert simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).count() == 40
