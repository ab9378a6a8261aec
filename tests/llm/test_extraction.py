import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from pipecheck.llm import extraction as x


def page(rng, article="article", extra=True):
    def words(n):
        return " ".join(rng.choice(["land", "over", "tree", "été", "run", "far", "hill"]) for _ in range(n)) + "."

    paragraphs = [words(rng.randrange(4, 40)) for _ in range(rng.randrange(2, 7))]
    body = "".join(f"<p>{p.replace('over', '<b>over</b>')}" + ("</p>" if k % 2 else "<br>") for k, p in enumerate(paragraphs))
    parts = [f"<nav><ul>{''.join(f'<li><a href=x>{words(1)}</a>' for _ in range(4))}</ul></nav>", f"<{article}>{body}</{article.split()[0]}>"]
    if extra:
        for name in rng.sample(["sidebar", "cookie-notice", "ad", "comments"], 2):
            parts.insert(rng.randrange(len(parts) + 1), f'<div class="{name}"><p>{words(12)}</p><p>{words(9)}</p></div>')
    html = f"<!DOCTYPE html><html><head><title>{words(3)}</title><script>var a='</p>';</script></head><body>{''.join(parts)}<footer>&copy; {words(5)}</footer>"
    return html, "\n".join(" ".join(p.split()) for p in paragraphs)


def test_pages_of_the_same_and_of_other_make(spark):
    rng = random.Random(1)
    made = [page(rng) for _ in range(120)]
    other = [page(rng, 'div class="content"') for _ in range(30)] + [page(rng, "main") for _ in range(30)]
    rows = [(n, f"u{n}", h) for n, (h, _) in enumerate(made + other)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    labeller = x.fit_labeller(df.filter("page_id < 90"))
    got = {r["page_id"]: r for r in x.extract_text(df.withColumn("TEXT", F.lit(1)), labeller).collect()}
    want = {n: t for n, (_, t) in enumerate(made + other)}
    assert sum(got[n]["text"] == want[n] for n in range(90, 120)) == 30
    assert sum(got[n]["text"] == want[n] for n in range(120, 180)) >= 54
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "plain"), (4, "<article><p>" + "word " * 60000), (5, "<div" * 5000), (6, '<p a="' * 3000)], "page_id long, html string")
    assert x.fit_labeller(df.filter("page_id < 4")) is None
    rows = {r["page_id"]: r["text"] for r in x.extract_text(df.union(df), None).collect()}
    assert rows[1] == rows[2] == "" and rows[3] == "plain" and len(rows[4]) == 5 * 60000 - 1
    assert x.extract_text(df.limit(0), None).count() == 0


def test_sample_is_of_pages_that_can_teach(spark, monkeypatch):
    monkeypatch.setattr(x, "SAMPLE_PAGES", 4)
    good = [f"<body><{tag}><p>text {n}</p></{tag.split()[0]}>" for n, tag in enumerate(["article", "main", "ARTICLE\nid=a", "article class=b"] * 2)]
    long = ["<article>" + "<p>a</p>" * 130 + f"{n}</article>" for n in range(60)] + [f"<article>{'word ' * 9000}{n}</article>" for n in range(9)]
    none = [f"<div>text {n}</div>" for n in range(900)] + [f"<nav><article>text {n}</article></nav>" for n in range(60)] + [None, ""]
    taught = []
    monkeypatch.setattr(x, "training_pages", lambda blocks: taught.append(blocks) or [])
    for own in (good, good[:3], good + good):
        df = spark.createDataFrame([(h,) for h in none + long + own], "html string")
        assert x.fit_labeller(df) is not None
        order = [r["html"] for r in spark.createDataFrame([(h,) for h in set(own)], "html string").orderBy(x.hash_order("html")).collect()]
        assert taught.pop() == [x.leaves(h) for h in order[:4]]


def texts(html):
    return [t for _, t, _ in x.leaves(html)]


def test_blocks():
    assert texts("<div>a < b &amp; c&nbsp;d<br>e<b>f</b>g<script>x</p></script><p>q<ul><li>1<li>2</ul>tail<foot") == ["a < b & c d efg", "q", "1", "2", "tail"]
    assert texts("<!-- <p>no --><p title='a>b'>yes<!-- open") == ["yes"]
    assert texts("&#233;&eacute;&lt;p&gt;&am") == ["éé<p>&am"]
    assert texts("<style>p{}</style><textarea><p>t</textarea>\n \t") == []
    (path, _, linked), *_ = x.leaves('<DIV id=Main class="a-b c"><p><a href="x">all</a>')
    assert path == (("div", ("main", "a", "b", "c")), ("p", ())) and linked == 1.0


def test_long_and_many_attributes():
    rest = '><p>one</p></div><div class="b">two</div>'
    plain = x.leaves('<body><div class="ad"' + rest)
    assert [path[-1] for path, _, _ in plain] == [("p", ()), ("div", ("b",))]
    for more in (f'x="{"5" * 5000}"', f"x='{'a > b ' * 1000}'", f'x="{"<p>in</p>" * 500}"', " ".join(f'x{k}="{k}>"' for k in range(300))):
        assert x.leaves(f'<body><div class="ad" {more}{rest}') == plain
        assert x.leaves(f'<body><div {more} class="ad"{rest}') == plain
        assert texts(f"a<script {more}>var b='<p>';</script><style {more}>p{{}}</style>c<p>d</p {more}>e") == ["a", "c", "d", "e"]


def test_tags_are_those_of_the_unbounded_pattern():
    tag = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[a-zA-Z!?/][^<>]*+>", re.S)
    rng = random.Random(5)
    for _ in range(20000):
        html = "".join(rng.choice(["<", ">", '"', "'", "/", "p", "<p", "</p>", "<b ", "=", " ", "!", "<!--", "-->", "\n"]) for _ in range(rng.randrange(40)))
        got, at, dead = [], 0, set()
        while own := x._next_tag(html, at, dead):
            got.append(own)
            at = own[1]
        assert got == [(m.start(), m.end(), m[1] or "", m[2], m[3] or "") for m in tag.finditer(html)], html


def test_open_quotes_take_linear_time():
    for piece in ('<a" "', "<a' \"", '<a" \'" ', '<p a="', "<p '\"", '<p "" ', "<p ''\"\"<"):
        start = time.process_time()
        x.leaves(piece * 100000)
        assert time.process_time() - start < 10, piece


def test_gradients():
    rng = np.random.default_rng(0)
    net = x.Labeller()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    size = x.PATH + x.WORDS + x.MORE
    batch = [(rng.normal(size=(n, size)), rng.integers(0, 2, n).astype(float)) for n in (4, 2)]

    def loss():
        v, mask = x.padded([b for b, _ in batch])
        s = np.concatenate([net._run(net._drive(v, d), mask, d, False)[0] for d in "fb"], axis=2)
        z = s.astype(np.float64) @ net.w["out"] + net.w["bias"]
        y = np.zeros(mask.shape)
        for k, (_, own) in enumerate(batch):
            y[: len(own), k] = own
        return float(((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum())

    grads = net._gradients(batch)
    for name in ("xf", "hf", "bf", "xb", "hb", "bb", "out", "bias"):
        at = tuple(rng.integers(0, n) for n in net.w[name].shape)
        old = net.w[name][at]
        net.w[name][at] = old + 1e-2
        up = loss()
        net.w[name][at] = old - 1e-2
        down = loss()
        net.w[name][at] = old
        assert abs((up - down) / 2e-2 - grads[name][at]) < 2e-3


def test_padding_changes_nothing():
    rng = random.Random(3)
    net = x.Labeller()
    pages = [x.leaves(page(rng)[0]) for _ in range(7)] + [[]]
    alone = [net.label([p])[0] for p in pages]
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(alone, net.label(pages), strict=True))


def test_deep_nesting_takes_linear_time_and_little_memory():
    import tracemalloc

    for piece in ("<div>a", "<div class=c>a<p>b", "<b><div>a</p>", "<ul><li>a"):
        start = time.process_time()
        assert len(x.leaves(piece * 100000)) >= 100000
        assert time.process_time() - start < 15, piece
        tracemalloc.start()
        x.leaves(piece * 10000)
        _, most = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert most < 40e6, piece
    net, start = x.Labeller(), time.process_time()
    assert len(net.label([x.leaves("<div>a" * 30000)])[0]) == 30000
    assert time.process_time() - start < 20


def test_end_tags_without_a_beginning():
    start = time.process_time()
    assert len(texts("<div>a" * 50000 + "</section>b" * 50000)) == 100000
    assert time.process_time() - start < 10
    assert [tuple(p) for p, _, _ in x.leaves("<div><p>a</div>b</div>c")] == [(("div", ()), ("p", ())), (), ()]


def test_what_is_not_shown_is_no_text():
    assert texts('<article><p>a<p style="color:red; display : none">b<b>c</b><p>d<div hidden>e<p>f</div>g<p class="hidden">h') == ["a", "d", "g", "h"]
    assert texts("<div style='display:none'><div>a</div>b</div>c<p data-hidden=1 style='x-display:block'>d") == ["c", "d"]


def test_containers_of_other_names(spark):
    rng = random.Random(4)
    labeller = x.fit_labeller(spark.createDataFrame([(page(rng)[0],) for _ in range(100)], "html string"))
    for tag in ('div class="x1"', 'section id="body"', "div", "td", "main", 'div class="content"', "center"):
        made = [page(rng, tag) for _ in range(100)]
        blocks = [x.leaves(h) for h, _ in made]
        good = 0
        for own, p, (_, want) in zip(blocks, labeller.label(blocks), made, strict=True):
            good += "\n".join(b[1] for b, q in zip(own, p, strict=True) if q >= 0.5) == want
        assert good >= 96, tag


def test_workers_need_no_copy_of_the_package(spark):
    """What goes to the workers is unpickled in a process that cannot import the package."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    def labelled(pages):
        return [x.leaves(page) for page in pages], x.Labeller().label([x.leaves(p) for p in pages])

    code = "import sys, pickle; f = pickle.load(sys.stdin.buffer); b, p = f(['<article><p>a</article>']); print(b[0][0][1], len(p[0]))"
    done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(labelled), capture_output=True, cwd="/", env={"PATH": "/usr/bin"})
    assert done.stdout.decode().split() == ["a", "1"], done.stderr.decode()
