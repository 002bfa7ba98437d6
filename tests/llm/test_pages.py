import html
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from keepset.llm import html as pages
from keepset.llm import urls

SF = "/root/testdata/sf0.001"


def text_of(page):
    return "\n".join(pages.blocks(page)[0])


def test_article_text():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Home</ul></nav>
      <div class="cookie-notice">We use</div><!-- x --><article><h1>Caf&eacute; &amp; bar</h1><p>One <b>two</b>
      three<br>four&nbsp;five<p>six &lt;7&gt; <script>var a = "</p>";</script><div class='ad-slot'>Buy</div><ul><li>a<li>b</ul>
      <form><input>q</form><section class="comments"><article><p>me too</p></article></section></article>
      <aside>side</aside><footer>end</footer></body></html>"""
    assert text_of(page) == "Café & bar\nOne two three four five\nsix <7>\na\nb"


def test_names_of_wrappers_keep_the_article():
    for start, end in [("<div class='layout has-sidebar'><article>", "</article></div>"), ("<div id='content-sidebar-wrap'><main>", "</main></div>"),
                       ("<main class='site-main no-ads'>", "</main>"), ("<div class='page comments-open'><article>", "</article></div>"), ("<article class='post related-12'>", "</article>"),
                       ("<div class='sidebar'>menu<article>", "</article>links</div>"), ("<main><div class='widget'><article>", "</article></div></main>")]:
        assert pages.blocks(f"<body>{start}<p>text</p><div class='ad'>buy</div>{end}</body>") == (["text"], True)
    assert text_of("<article>a<div class='related'><article>b</article></div></article>") == "a"
    assert text_of("<article>a</article><div class='comments-area'><article class='x'>b</article></div><article class='comment'>c</article>") == "a"
    assert text_of("<aside>b</aside><div class='layout has-sidebar'>a</div><div class='left-sidebar'>c</div>") == "a"


def test_broken_markup_never_fails():
    for page in ["", "<", "<p", "<p>a", "<article>x &am", "<article><p>x &amp", "</p></div>a", "<script>var x", "<!-- open", "<a href='x>y</a>z",
                 "<article><p class=\"a>b</p>c", "a < b and c > d", "<p>" * 3000 + "x"]:
        pages.blocks(page)
    assert text_of("<article><p>x &amp") == "x &" and text_of("<article>x &am") == "x &am"
    assert text_of("a < b") == "a < b"


def test_all_pages_against_a_plain_reading(spark):
    """The given pages have one article each: its block elements, read with expressions."""
    found = {r.page_id: r for r in pages.page_texts(spark, SF).collect()}
    given = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(found) == len(given)
    for r in given:
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = (html.unescape(re.sub(r"<[^>]*>", "", b)) for b in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " ")))
        want = "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)
        assert found[r.page_id].text == want and found[r.page_id].n_chars == len(want)
        assert found[r.page_id].url == r.url


def brute(streams, least):
    """Which tokens of each stream lie in a run of ``least`` that a different stream holds too."""
    grams = [{tuple(s[i:i + least]) for i in range(len(s) - least + 1)} for s in streams]
    out = []
    for a, s in enumerate(streams):
        gone = np.zeros(len(s), dtype=bool)
        for i in range(len(s) - least + 1):
            if any(tuple(s[i:i + least]) in g for b, g in enumerate(grams) if streams[b] != s):
                gone[i:i + least] = True
        out.append([t for t, g in zip(s, gone) if not g])
    return out


def test_runs_that_distinct_pages_share_go(spark):
    rng = np.random.default_rng(2)
    common = [f"c{i}" for i in range(14)]
    streams = []
    for _ in range(30):
        own = [f"w{i}" for i in rng.integers(0, 60, rng.integers(0, 50))]
        at = int(rng.integers(0, len(own) + 1))
        streams.append(own[:at] + common[:rng.integers(0, 15)] + own[at:])
    streams.append(streams[0])  # a copied page keeps its text
    rows = [(i, "http://one.example/" + str(i), "<div>" + "</div><div>".join(s) + "</div>") for i, s in enumerate(streams)]
    rows += [(100, None, "<div>" + " ".join(common) + "</div>"), (101, "http://x", None), (102, "http://x", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = [" ".join(s) for s in brute(streams, 6)]
    for chunk in (10**6, 300):  # one suffix array for the host, and many
        found = {r.page_id: r.text for r in pages.main_text(frame, least=6, chunk_tokens=chunk).collect()}
        assert [" ".join(found[i].split()) for i in range(len(streams))] == want
        assert found[100] == " ".join(common) and found[101] == "" and found[102] == ""
    assert pages.main_text(frame.limit(0)).count() == 0


def test_runs_on_nearly_every_page_of_a_host_go_from_articles_too(spark):
    rng = np.random.default_rng(5)
    notice, passage = [f"n{i}" for i in range(9)], [f"p{i}" for i in range(12)]
    rows, want = [], {}
    for i in range(40):
        own = [f"w{i}x{j}" for j in range(rng.integers(1, 30))]
        body = own + (passage if i % 3 else [])  # two thirds share a passage, which is theirs
        rows.append((i, f"http://one.example/{i}", f"<article><p>{' '.join(body)}</p><div>{' '.join(notice)}</div></article>"))
        want[i] = " ".join(body)
    for i in range(40, 60):  # of nine pages, and of twenty copies of one, all stays
        text = " ".join(notice + [f"v{i}"] * (i < 49))
        rows.append((i, f"http://{'few' if i < 49 else 'copies'}.example/{i}", f"<main>{text}</main>"))
        want[i] = text
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for chunk in (10**6, 2000):  # one suffix array for the host, and many
        found = {r.page_id: r.text for r in pages.main_text(frame, chunk_chars=chunk).collect()}
        assert found == want


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def rule(host, path):
    fits = [r for r, _ in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


def test_rules_and_parts(spark):
    odd = [None, "", "no scheme", "http://", "http://NET/", "https://a.example.net/en/1?x#y", "http://example.com/de/", "http://badexample.net/en/x",
           "x://y://z/", "http://EXAMPLE.org/fr/é", "http://É.org/fr/", "http://a.net?x=/en/", "http://a.net#/", "http://a.net"]
    rows = [(i, u, "html", 1.0) for i, u in enumerate(odd)] + [(5, odd[5], None, None)]
    found = urls.judged(spark.createDataFrame(rows, "page_id long, url string, html string, score double")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.host, r.path) == split(odd[r.page_id]) and r.rule == rule(r.host, r.path) and r.verdict in ("allow", "block")
        if r.rule:
            assert r.verdict == dict(urls.RULES)[r.rule]
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_verdicts_of_the_pages(spark):
    found = urls.url_verdicts(spark, "/root/testdata/sf0.1").collect()
    for r in found:
        assert r.rule == rule(r.host, r.path)
    ruled = [r for r in found if r.rule]
    agree = sum((r.score > 0) == (r.verdict == "allow") for r in ruled) / len(ruled)
    assert agree > 0.95  # the models tell what they learned apart


def test_scores_against_counts_in_dictionaries(spark, monkeypatch):
    """The Markov mixture computed longhand, over counts that Spark gathered; in chunks of every size."""
    good = [f"http://a.b/en/{i}" for i in range(40)] + ["http://a.c/é"]
    bad = [f"http://zz.q/de/{i * i}" for i in range(40)] + ["http://zz.r/" + "x" * 70000]
    other = ["http://a.b/en/x", "http://zz.q/", "q", "", None] + ["http://hot/1"] * 50
    rows = [(u, True) for u in good] + [(u, False) for u in bad] + [(u, None) for u in other]
    frame = spark.createDataFrame(rows, "url string, accepted boolean").repartition(5)
    tables = []
    for part in (good, bad):
        seen = Counter()
        for u in (u.encode() for u in part if zlib.crc32(u.encode()) % 5):
            u = bytes(urls.ORDER) + u
            for i in range(urls.ORDER, len(u)):
                for k in range(urls.ORDER + 1):
                    seen[k, u[i - k:i + 1]] += 1
                    seen["c", k, u[i - k:i]] += 1
        tables.append(seen)

    def longhand(url):
        padded, total = bytes(urls.ORDER) + url, 0.0
        for seen, sign in ((tables[0], 1), (tables[1], -1)):
            for i in range(urls.ORDER, len(padded)):
                p = 1 / 256
                for k in range(urls.ORDER + 1):
                    p = (seen[k, padded[i - k:i + 1]] + urls.PRIOR * p) / (seen["c", k, padded[i - k:i]] + urls.PRIOR)
                total += sign * np.log(p)
        return total / max(len(url), 1)

    counts = urls.gram_counts(frame)
    assert counts.count() == len(tables[0].keys() | tables[1].keys())
    results = []
    for size in (1 << 18, 300):
        monkeypatch.setattr(urls, "CHUNK_BYTES", size)
        results.append(sorted((r.url or "", r.score) for r in urls.with_scores(frame, counts).collect()))
    assert results[0] == results[1] and len(results[0]) == len(rows)
    for url, score in set(results[0]):
        assert abs(score - longhand(url.encode())) < 1e-9


def test_counts_of_urls_are_not_broadcast(spark):
    rows = [(i, f"http://a.example.{'com' if i % 2 else 'net'}/{lang}/{i}") for i in range(40) for lang in ("en", "de")]
    pages_table = spark.createDataFrame(rows, "id long, url string").withColumn("accepted", F.col("id") % 2 == 0)
    counts = urls.gram_counts(pages_table)
    scored = urls.with_scores(pages_table, counts)
    assert "Broadcast" not in scored._jdf.queryExecution().sparkPlan().toString()
    assert scored.count() == len(rows)
