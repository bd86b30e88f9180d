import random

import numpy as np
from helpers import prose, shuffled_bytes

from sparkcomm.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p><p>no</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/x">Home</a><li><a>News</a></ul></nav><!-- <p>gone</p> -->
<div class="cookie-notice">We use cookies</div><article><h1>Head&nbsp;line</h1><p><b>Title<br>line two<p>One &lt;b&gt; &#233;&#x1F600;
 two</p><ul><li>first<li>second</ul><div class="ad">Buy</div><table><tr><td>a<td>b</table><form><input><button>Go</button></form><p hidden>hid</p>
<blockquote>said <em>so</em></blockquote></article><section id="comments"><p>Nice post</p></section><aside>More</aside><footer>&copy; us</footer></body></html>"""


def test_blocks_of_an_article():
    assert html.main_texts([PAGE]) == ["\n\n".join(["Head line", "Title line two", "One <b> é\U0001f600 two", "first", "second", "a", "b", "said so"])]


def test_odd_pages():
    assert html.main_texts(["", " ", "<", "plain text", "<p>a<p>b", "</div></p>x</article>", "<article></article>", "<p>a < b & c</p>", "<body><p>x<script>y"]) == ["", "", "<", "plain text", "a\n\nb", "x", "", "a < b & c", "x"]


def test_repeated_runs_decide_where_markup_says_nothing():
    menu, foot = "alpha beta gamma delta epsilon zeta", "all rights kept by the makers of this site"
    bodies = [prose(i, 40).replace("\n", " ") for i in range(6)]
    pages = [f"<body><div>{menu}</div><div>{b}</div><div>{foot}</div></body>" for b in bodies]
    assert html.main_texts(pages) == [" ".join(b.split()) for b in bodies]
    assert html.main_texts(pages[:1])[0].startswith(menu)  # nothing to compare it with
    assert html.main_texts(pages[:1] * 9)[0].startswith(menu)  # copies are one page
    shared = "a passage that two or more of the articles quote word for word"
    articles = [f"<div>{menu}</div><article><div>{foot}</div><p>{shared}</p><p>{b}</p></article>" for b in bodies]
    assert html.main_texts(articles) == [f"{shared}\n\n{' '.join(b.split())}" for b in bodies]


def test_suffix_array_orders_and_measures():
    rng = np.random.default_rng(4)
    for n in (2, 3, 30, 400):
        tokens = rng.integers(0, 3, n)
        tokens[-1] = -1
        order, shared = html.suffix_array(tokens, 8)
        suffixes = [tuple(tokens[i : i + 8]) for i in order]
        assert suffixes == sorted(suffixes) and sorted(order) == list(range(n))
        for a, b, s in zip(order, order[1:], shared[1:], strict=False):
            x, y = tokens[a:], tokens[b:]
            k = 0
            while k < min(len(x), len(y)) and x[k] == y[k]:
                k += 1
            assert min(s, 8) == min(k, 8)


def test_covered_tokens_equal_brute_force():
    rng = random.Random(3)
    streams = [[rng.choice("abc") for _ in range(rng.randint(0, 60))] for _ in range(8)] + [list("abcabcabc")] * 2
    got = html.repeated(streams, run=5, pages=3)
    distinct = {tuple(s) for s in streams}
    for s, covered in zip(streams, got, strict=True):
        want = [False] * len(s)
        for i in range(len(s) - 4):
            if sum(any(t[j : j + 5] == tuple(s[i : i + 5]) for j in range(len(t) - 4)) for t in distinct) >= 3:
                want[i : i + 5] = [True] * 5
        assert covered.tolist() == want


def test_operator_on_odd_rows(spark, monkeypatch):
    table = [(1, "http://a.x/1", PAGE, "u"), (1, "http://a.x/1", PAGE, "u"), (None, None, None, None), (2, "no host", "", "u"), (3, "//b.y", "<p>" + "long " * 50_000 + "</p>", "u")]
    df = spark.createDataFrame(table, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"], r["url"], r["text"]) for r in html.extract(df).collect()), key=repr)
    assert [(a, b, c[:9]) for a, b, c in got] == sorted([(1, "http://a.x/1", "Head line")] * 2 + [(None, None, ""), (2, "no host", ""), (3, "//b.y", "long long")], key=repr)
    assert html.extract(df.limit(0)).count() == 0
    monkeypatch.setattr(html, "SHARD", 2)
    many = spark.createDataFrame([(i, "http://a.x/", f"<article><p>{i}</p></article>") for i in range(50)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.extract(many).collect()} == {i: str(i) for i in range(50)}


def test_driver_pages(spark):
    """The article of every page, by the plain form its generator gives it."""
    import html as entities
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in html.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        parts = [" ".join(entities.unescape(re.sub(r"<br>|</?b>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[p["page_id"]] == "\n\n".join(x for x in parts if x)


def test_runs_across_shards_equal_those_of_one(spark, monkeypatch):
    foot = "all rights kept by the makers of this site"
    bodies = [" ".join(prose(i, 30, 4000).split()) for i in range(60)]
    pages = [f"<body><div>{b}</div>" + (f"<div>{foot}</div>" if i % 15 == 0 else "") + "</body>" for i, b in enumerate(bodies)]
    pages += [f"<body><div>copied {bodies[1]}</div></body>"] * 5  # copies are one page
    df = spark.createDataFrame([(i, "http://a.x/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    whole = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    monkeypatch.setattr(html, "SHARD", 2)
    dealt = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert dealt == whole and all(whole[i] == b for i, b in enumerate(bodies))


def test_packed_pages_and_windows_come_back():
    import pandas as pd

    for page in (PAGE, "", "<p>a\n\n<b>b</b><nav>c</nav>", "\x85<p>\u2028x y"):
        parsed = html.blocks(page)
        assert html.unpack(html.pack(parsed)) == parsed
    pages = [html.pack(html.blocks(f"<p>{prose(i, 200)}</p>")) for i in (1, 2, 3, 3)]
    cut = html._cut(pd.DataFrame({"host": "h", "shards": 2, "blocks": 5, "shard": 1, "page": pages}))
    got = sorted((b << 36 | int(w), int(p)) for b, e, of in zip(cut["block"], cut["entries"], cut["pages"], strict=True) for w, p in zip(*html._entries(e, of), strict=True))
    tokens = [[t for b in html.unpack(p) for t in b.tokens] for p in pages[:3]]
    assert [w for w, _ in got] == sorted(int(w) for t in tokens for w in set(html.codes([t], 5)[0].tolist())) and len({p for _, p in got}) == 3


def test_windows_of_one_page_hardly_travel(spark, monkeypatch):
    """A host over several shards shuffles its packed pages and two bytes or so for a window that stands on one page only."""
    monkeypatch.setattr(html, "SHARD", 100)
    rng, foot = random.Random(5), "all rights kept by the makers of this site"
    bodies = [" ".join(f"w{rng.randrange(20_000)}" for _ in range(800)) for _ in range(400)]
    pages = [f"<body><div>{b}</div>" + (f"<div>{foot}</div>" if i % 80 == 0 else "") + "</body>" for i, b in enumerate(bodies)]
    df = spark.createDataFrame([(i, "http://a.x/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {}
    moved = shuffled_bytes(spark, lambda: got.update((r["page_id"], r["text"]) for r in html.extract(df).collect()))
    assert got == dict(enumerate(bodies))
    shipped = sum(len(html.pack(html.blocks(p))) for p in pages)
    assert moved > shipped and (moved - shipped) / (400 * 796) < 2.5


def test_sorted_numbers_come_back():
    rng = np.random.default_rng(1)
    for bits in (25, 36):
        for n in (0, 1, 2, 7, 8, 1000, 70_000):
            values = np.unique(rng.integers(0, 1 << bits, n))
            for v in (values, np.append(values[:-1], (1 << bits) - 1) if n else values):
                packed = html.pack_sorted(v, bits)
                assert html.unpack_sorted(packed, bits).tolist() == v.tolist()
                assert len(packed) <= 5 + len(v) * (bits + 3 - np.log2(max(len(v), 1))) / 8 + 2


def test_crowded_cells_hold_every_repeated_window():
    """Cells and their count, shard by shard, leave the windows that PAGES pages share, and few others."""
    import pandas as pd

    foot = "all rights kept by the makers of this site"
    texts = [prose(i, 300, 4000) + (f" {foot}" if i % 4 == 0 else "") for i in range(12)]
    shards = [pd.DataFrame({"host": "h", "shards": 4, "blocks": 2, "shard": i, "page": [html.pack(html.blocks(t)) for t in texts[i::4] + texts[:1]]}) for i in range(4)]
    cells = pd.concat([html._cells(s) for s in shards])
    crowded = pd.concat([html._crowded(x) for _, x in cells.groupby("block")])
    cut = pd.concat([html._cut(s, crowded[crowded["shard"] == i]) for i, s in enumerate(shards)])
    every = pd.concat([html._cut(s) for s in shards])
    often = lambda t: {(r.block, c) for _, x in t.groupby("block") for r in html._repeated_codes(x).itertuples() for c in html.unpack_sorted(r.codes, 36)}
    assert often(cut) == often(every) and len(often(every)) >= len(foot.split()) - 4
    size = lambda t: sum(len(html._entries(*x)[0]) for x in zip(t["entries"], t["pages"], strict=True))
    assert size(cut) < size(every)
