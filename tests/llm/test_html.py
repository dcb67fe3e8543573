"""Page parsing by cases, the network by differences, extraction by held-out pages and other layouts."""

import html
import re
import resource
import threading

import numpy as np
import pytest
from saccadia.llm import html_blocks as hb


def test_blocks():
    page = ("<html><head><title>T</title><style>p{}</style></head><body class='Home page'><p>a <b>b</b>c&amp;d<br>e<p>f\n  g<!-- x --> h"
            "<div id=mainContent><script>var t='</p>';</script><ul><li>one<li><a href='x>y'>two</a></ul>&nbsp;tail</div>1 < 2")
    got = hb.blocks_of(page)
    assert [b.text for b in got] == ["a bc&d e", "f g h", "one", "two", "tail", "1 < 2"]
    assert got[0].path == ("html", "body.home.page", "p") and got[2].path[-3:] == ("div.main.content", "ul", "li") and got[3].linked == 3
    assert hb.blocks_of("") == [] and hb.blocks_of("<<<>>") != None and hb.blocks_of("</p></div>") == []  # noqa: E711


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    p = hb._start(rng)
    pages = [rng.normal(size=(n, hb.INPUT)) for n in (3, 5)]
    y = np.zeros((2, 5))
    y[0, :2], y[1, 3:] = 1, 1
    x, mask = hb._padded(pages)
    loss = lambda: float((np.logaddexp(0, hb._logits(x, mask, p)[0]) - y * hb._logits(x, mask, p)[0])[mask].sum())
    logits, both, kept, back = hb._logits(x, mask, p)
    error = (hb._sigmoid(logits) - y) * mask
    upper = error[:, :, None] * p["out"]
    g = dict(zip(("fx", "fh", "fc"), hb._back(x, kept, upper[:, :, :hb.HIDDEN], p["fx"], p["fh"])))
    g |= dict(zip(("bx", "bh", "bc"), hb._back(x[:, ::-1], back, upper[:, ::-1, hb.HIDDEN:], p["bx"], p["bh"])))
    for name, v in g.items():
        at = np.unravel_index(np.argmax(np.abs(v)), v.shape)
        old, p[name][at] = p[name][at], p[name][at] + 1e-6
        up = loss()
        p[name][at] = old
        assert (up - loss()) / 1e-6 == pytest.approx(v[at], rel=1e-3)


@pytest.fixture(scope="module")
def model(spark):
    return hb.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), hb.SampleBound(pages=120))


def article(page: str) -> str:
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1].replace("<b>", "").replace("</b>", "")
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


def test_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in hb.extract(pages, model).collect()}
    rows = pages.collect()
    assert len(got) == len(rows) and all(got[r["page_id"]]["text"] == article(r["html"]) for r in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_other_layouts(model):
    rng = np.random.default_rng(77)
    sample = [f"Satz {k} hat wohl {k % 9} Worte und noch mehr davon." for k in range(50)]
    made = [hb.other_layout(sample, rng) for _ in range(120)]
    got = hb.label([b for b, _ in made], model)
    right = np.concatenate([g == (y > 0) for g, (_, y) in zip(got, made)])
    assert right.mean() > 0.97


def test_awkward_pages(spark, model):
    rows = [(1, "u", None), (1, None, ""), (2, "v", "no tags at all"), (3, "w", "<article><p>" + "word " * 40000 + "</p></article>"), (None, "x", "<p>&#x110000; &bogus; \x00"), (3, "w", "<b><i></b>")]
    got = hb.extract(spark.createDataFrame([(*r, 1.0) for r in rows], "page_id long, url string, html string, text double"), model).collect()
    assert len(got) == 6 and [r["n_chars"] for r in got][:2] == [0, 0]
    assert got[3]["text"] == ("word " * 40000).strip()
    assert hb.extract(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


@pytest.mark.parametrize("tag", ["svg", "math", "object", "select", "noscript", "template"])
def test_elements_that_hold_text_are_read(tag):
    closed = [b.text for b in hb.blocks_of(f"<article><p>a</p><{tag} class=i><p>inside</p></{tag}><p>rest</p></article>")]
    empty = [b.text for b in hb.blocks_of(f"<article><p>a</p><{tag} class='i'/><p>rest of it</p></article><p>end</p>")]
    never = [b.text for b in hb.blocks_of(f"<article><p>a</p><{tag}><p>rest</p></article><p>end</p>")]
    assert closed == ["a", "inside", "rest"] and empty == ["a", "rest of it", "end"] and never == ["a", "rest", "end"]


@pytest.mark.parametrize("tag", ["script", "style", "textarea", "title", "iframe"])
def test_raw_elements_hold_no_text(tag):
    assert [b.text for b in hb.blocks_of(f"<p>a</p><{tag} x='>'>var t = '<p>no</p>';</{tag} ><p>b</p>")] == ["a", "b"]
    assert [b.text for b in hb.blocks_of(f"<p>a</p><{tag}/><p>b</p>")] == ["a", "b"]
    assert [b.text for b in hb.blocks_of(f"<div><p>a</p><{tag}>no <b>no</b></div><p>b</p>")] == ["a", "b"]
    assert [b.text for b in hb.blocks_of(f"<div><{tag}>no</div>" * 3 + "<p>b</p>")] == ["b"]


def resident() -> int:
    with open("/proc/self/statm") as file:
        return int(file.read().split()[1]) * resource.getpagesize()


def test_a_page_of_many_blocks_is_labelled_in_bounded_memory(model):
    short = [hb.Block(("html", "body", "article", "p"), f"Satz {k} steht hier.", 0) for k in range(2_000)]
    want = hb.label([short], model)[0]
    x, mask = hb._padded([hb.features(short)])
    assert (want == (hb._logits(x.astype(np.float32), mask, model)[0][0] > 0)).all()
    page = "<html><body><article>" + "".join(f"<p>Satz {k} steht hier.</p>" for k in range(300_000)) + "</article></body></html>"
    blocks = hb.blocks_of(page)
    peak, done = [resident()], threading.Event()
    watch = threading.Thread(target=lambda: [peak.append(resident()) for _ in iter(lambda: done.wait(0.05), True)])
    watch.start()
    got = hb.label([blocks], model)[0]
    done.set()
    watch.join()
    assert len(got) == 300_000 and got.mean() > 0.99 and max(peak) - peak[0] < 600e6
