"""Main text of web pages: a recurrent labeller over the blocks of a page, trained in numpy.

A page becomes the sequence of its leaf blocks, each with the path of open tags (names, classes, ids) and its words. Path
tokens and words are hashed into two vectors; a bidirectional LSTM reads the whole sequence, so that the blocks before and
after a block count, and labels every block as article or not. The article blocks in page order are the text.

There are no labels in the table. The network learns from a bounded sample of its pages: a teacher labels blocks by the
meaning of tag and class names around them, and the same texts are set again into pages of random other layouts, whose
labels are known. So the network does not depend on the layout at hand.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

PATH_SIZE, WORD_SIZE, NUMBERS = 384, 24, 6
INPUT = PATH_SIZE + WORD_SIZE + NUMBERS
HIDDEN = 16
#: Blocks times pages that one pass over padded sequences holds.
PADDED = 8_000
#: Blocks whose input vectors are made at a time; of a page only what the gates get from them is kept.
STRETCH = 4_000

# fixed values of the HTML language
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup "
                   "time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
                     "main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# elements whose content is no markup, and those that show no text
RAW = frozenset("script style textarea title iframe".split())
HIDDEN_PARTS = RAW | {"head"}

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"""
    r"""|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<close2>/?)(?P<name2>[a-z][a-z0-9:-]*)[^>]*>""", re.S | re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(frozen=True)
class Block:
    path: tuple[str, ...]  # "tag" or "tag.token.token", outermost first
    text: str
    linked: int            # characters inside links


@lru_cache(maxsize=20_000)
def _element(name: str, attributes: str) -> str:
    tokens = [p.lower() for value in _ATTRIBUTE.findall(attributes) for p in _PART.findall(value)] if "=" in attributes else []
    return ".".join([name, *dict.fromkeys(tokens)])


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks with text, scripts, styles, comments and the page head left out.

    A raw element that is never closed ends with the element around it; a tag that ends with ``/>`` holds nothing.
    """
    found: list[Block] = []
    stack: list[tuple[str, str]] = []
    pieces: list[str] = []
    path: tuple[str, ...] = ()
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                found.append(Block(path, text, linked))
            pieces.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal path, linked
        if not piece:
            return
        if not any(not p.isspace() for p in pieces):
            path = tuple(e for _, e in stack)
        piece = html.unescape(piece)
        pieces.append(piece)
        linked += len(piece) if in_link else 0

    at, unclosed = 0, set()
    while m := _TAG.search(page, at):
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name, closing = name.lower(), bool(m["close"] or m["close2"])
        if name not in INLINE:
            flush()
        elif name in ("br", "img"):
            pieces.append(" ")
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    in_link -= sum(n == "a" for n, _ in stack[k:])
                    del stack[k:]
                    break
                if name in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if name in CLOSES_P or name in SIBLINGS:
            goal = {"p"} if name in CLOSES_P else SIBLINGS[name]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in goal:
                    in_link -= sum(n == "a" for n, _ in stack[k:])
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
        if name not in VOID and not (m["attributes"] or "").rstrip().endswith("/"):
            if name in RAW and name not in unclosed:
                if end := _RAW_END[name].search(page, at):
                    at = end.end()
                    continue
                unclosed.add(name)
            stack.append((name, _element(name, m["attributes"] or "")))
            in_link += name == "a"
    if at < len(page):
        add(page[at:])
    flush()
    return [b for b in found if not any(e.split(".")[0] in HIDDEN_PARTS for e in b.path)]


# ---------------------------------------------------------------- features

@lru_cache(maxsize=100_000)
def _slot(token: str, size: int) -> tuple[int, float]:
    value = zlib.crc32(token.encode("utf-8", "surrogatepass"))
    return value % size, 1.0 if value >> 31 else -1.0


@lru_cache(maxsize=20_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Path tokens, the nearest of a kind weighing most; the last tags also on their own."""
    out = np.zeros(PATH_SIZE)
    for depth, element in enumerate(reversed(path)):
        for token in element.split("."):
            slot, sign = _slot(token, PATH_SIZE)
            out[slot] += sign * 0.9 ** depth
    if path:
        slot, sign = _slot("leaf:" + path[-1].split(".")[0], PATH_SIZE)
        out[slot] += sign
    return out


def features(blocks: list[Block], first: int = 0, last: int | None = None) -> np.ndarray:
    """Input vectors of the blocks from ``first`` to before ``last``."""
    some = blocks[first:last]
    out = np.zeros((len(some), INPUT))
    for k, b in enumerate(some):
        out[k, :PATH_SIZE] = _path_vector(b.path)
        words = b.text.lower().split()
        for w in words:
            slot, sign = _slot(w, WORD_SIZE)
            out[k, PATH_SIZE + slot] += sign
        heard = out[k, PATH_SIZE:PATH_SIZE + WORD_SIZE]
        heard /= max(np.sqrt((heard * heard).sum()), 1.0)
        out[k, PATH_SIZE + WORD_SIZE:] = (np.log1p(len(words)) / 4, b.linked / max(len(b.text), 1), min(b.text.count(".") / len(words), 1), len(b.path) / 8,
                                          (first + k) / len(blocks), float(b.text[-1] in ".!?"))
    return out


# ---------------------------------------------------------------- network

def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {}
    for way in "fb":
        p[f"{way}x"] = rng.normal(0, 1 / np.sqrt(INPUT), (INPUT, 4 * HIDDEN))
        p[f"{way}h"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        p[f"{way}c"] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))
    p["out"], p["bias"] = rng.normal(0, 0.3, 2 * HIDDEN), np.zeros(1)
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _run(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states of one direction; padded steps leave the state as it is."""
    pages, steps, _ = x.shape
    gates_in = x @ wx + bias
    h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    out, kept = np.zeros((pages, steps, HIDDEN)), []
    for t in range(steps):
        g = gates_in[:, t] + h @ wh
        i, f, o = _sigmoid(g[:, :HIDDEN]), _sigmoid(g[:, HIDDEN:2 * HIDDEN]), _sigmoid(g[:, 2 * HIDDEN:3 * HIDDEN])
        z = np.tanh(g[:, 3 * HIDDEN:])
        m = mask[:, t, None]
        new = f * c + i * z
        kept.append((i, f, o, z, c, h, new, m))
        c = np.where(m, new, c)
        h = np.where(m, o * np.tanh(new), h)
        out[:, t] = h
    return out, kept


def _back(x: np.ndarray, kept: list, upper: np.ndarray, wx: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dwh, dgates = np.zeros_like(wh), np.zeros((*x.shape[:2], 4 * HIDDEN))
    dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
    for t in range(x.shape[1] - 1, -1, -1):
        i, f, o, z, c, h, new, m = kept[t]
        dh = dh + upper[:, t]
        th = np.tanh(new)
        dnew = dc + dh * o * (1 - th * th)
        g = np.concatenate((dnew * z * i * (1 - i), dnew * c * f * (1 - f), dh * th * o * (1 - o), dnew * i * (1 - z * z)), axis=1) * m
        dgates[:, t] = g
        dwh += h.T @ g
        dh = np.where(m, g @ wh.T, dh)
        dc = np.where(m, dnew * f, dc)
    flat = dgates.reshape(-1, 4 * HIDDEN)
    return x.reshape(-1, INPUT).T @ flat, dwh, flat.sum(axis=0)


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((len(pages), steps, INPUT)), np.zeros((len(pages), steps), bool)
    for k, p in enumerate(pages):
        x[k, :len(p)], mask[k, :len(p)] = p, True
    return x, mask


def _logits(x: np.ndarray, mask: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray, list, list]:
    ahead, kept = _run(x, mask, p["fx"], p["fh"], p["fc"])
    back, kept_back = _run(x[:, ::-1], mask[:, ::-1], p["bx"], p["bh"], p["bc"])
    both = np.concatenate((ahead, back[:, ::-1]), axis=2)
    return both @ p["out"] + p["bias"], both, kept, kept_back


def train(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, batch: int = 24, rate: float = 0.01, seed: int = 3) -> dict[str, np.ndarray]:
    """Fit on (features, labels) of whole pages by backpropagation through time."""
    rng = np.random.default_rng(seed)
    p = _start(rng)
    mean, square, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    pages = [q for q in pages if len(q[0])]
    total = epochs * -(-len(pages) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(pages))
        for at in range(0, len(order), batch):
            part = [pages[i] for i in order[at:at + batch]]
            x, mask = _padded([q[0] for q in part])
            y = np.zeros(mask.shape)
            for k, q in enumerate(part):
                y[k, :len(q[1])] = q[1]
            logits, both, kept, kept_back = _logits(x, mask, p)
            error = (_sigmoid(logits) - y) * mask / mask.sum()
            upper = error[:, :, None] * p["out"]
            g = {"out": (both * error[:, :, None]).sum(axis=(0, 1)), "bias": np.array([error.sum()])}
            g["fx"], g["fh"], g["fc"] = _back(x, kept, upper[:, :, :HIDDEN], p["fx"], p["fh"])
            g["bx"], g["bh"], g["bc"] = _back(x[:, ::-1], kept_back, upper[:, ::-1, HIDDEN:], p["bx"], p["bh"])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            step += 1
            now = rate * min(1.0, 2 * (1 - step / (total + 1)))
            for k, v in g.items():
                v = v * min(1.0, 1 / max(norm, 1e-12))
                mean[k] = 0.9 * mean[k] + 0.1 * v
                square[k] = 0.999 * square[k] + 0.001 * v * v
                p[k] = p[k] - now * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _gate_inputs(blocks: list[Block], w: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """What the gates of both directions get from each block."""
    return np.concatenate([features(blocks, at, at + STRETCH).astype(np.float32) @ w for at in range(0, len(blocks), STRETCH)]) + bias


def _states(gates_in: np.ndarray, mask: np.ndarray, wh: np.ndarray) -> np.ndarray:
    """Hidden states of one direction, as ``_run`` has them, without what training needs."""
    pages, steps, _ = gates_in.shape
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    out = np.zeros((pages, steps, HIDDEN), np.float32)
    for t in range(steps):
        g = gates_in[:, t] + h @ wh
        opened = _sigmoid(g[:, :3 * HIDDEN])
        new = opened[:, HIDDEN:2 * HIDDEN] * c + opened[:, :HIDDEN] * np.tanh(g[:, 3 * HIDDEN:])
        m = mask[:, t, None]
        c = np.where(m, new, c)
        h = np.where(m, opened[:, 2 * HIDDEN:] * np.tanh(new), h)
        out[:, t] = h
    return out


def label(pages: list[list[Block]], model: dict[str, np.ndarray]) -> list[np.ndarray]:
    """For each page which of its blocks belong to the article; pages of like length are read together.

    A block takes some hundred bytes while its page is labelled, however many a page has.
    """
    out: list[np.ndarray] = [np.zeros(len(b), bool) for b in pages]
    order = sorted((k for k, b in enumerate(pages) if b), key=lambda k: len(pages[k]))
    w, bias, half = np.concatenate((model["fx"], model["bx"]), axis=1), np.concatenate((model["fc"], model["bc"])), 4 * HIDDEN
    at = 0
    while at < len(order):
        last = at + 1
        while last < len(order) and (last + 1 - at) * len(pages[order[last]]) <= PADDED:
            last += 1
        part = order[at:last]
        sizes = np.array([len(pages[k]) for k in part])
        gates = np.zeros((len(part), sizes.max(), 2 * half), np.float32)
        for row, k in enumerate(part):
            gates[row, :sizes[row]] = _gate_inputs(pages[k], w, bias)
        mask = np.arange(sizes.max()) < sizes[:, None]
        logits = _states(gates[:, :, :half], mask, model["fh"]) @ model["out"][:HIDDEN]
        logits += _states(gates[:, ::-1, half:], mask[:, ::-1], model["bh"])[:, ::-1] @ model["out"][HIDDEN:] + model["bias"]
        for row, k in enumerate(part):
            out[k] = logits[row, :sizes[row]] > 0
        at = last
    return out


# ---------------------------------------------------------------- teacher

# names that say what a part of a page is, as authors use them
ARTICLE = frozenset("article main content post entry story body text prose paragraph".split())
OTHER = frozenset("nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot sidebar side aside widget ad ads advert advertisement adbox "
                  "banner sponsor sponsored promo promotion form login signup subscribe newsletter search cookie cookies consent notice alert message popup "
                  "modal overlay comment comments reply replies discussion disqus responses related recommended more share social tags meta copyright legal "
                  "pagination pager button toolbar skip select option datalist".split())


def teach(block: Block) -> int:
    """1 if the nearest telling name around the block is that of an article; a header inside an article is part of it."""
    for k in range(len(block.path) - 1, -1, -1):
        tokens = set(block.path[k].split("."))
        if tokens & OTHER:
            inside = any("article" in e.split(".") for e in block.path[:k])
            if not ("header" in tokens and not tokens & (OTHER - {"header"}) and inside):
                return 0
        elif tokens & ARTICLE and block.path[k] != "body":
            return 1
    return 0


_FRAMES = (("main",), ("article",), ("main", "article"), ("div.content",), ("div.main.content", "article"), ("div.post",), ("section.entry.content",), ("div.article.body",),
           ("div.story", "div.text"), ("main.content", "section"), ("div.wrapper", "article.post"), ("div.page", "div.container", "main"), ("div.row", "div.col", "article.entry"))
_LEAVES = ("p", "p", "p", "p", "h1", "h2", "h3", "ul|li", "ol|li", "blockquote", "blockquote|p", "table|tr|td", "pre", "div", "section|p", "figure|figcaption", "dl|dd", "p|b", "p|a")
_NOISE = (("nav", "ul", "li", "a"), ("div.menu", "ul", "li", "a"), ("header",), ("header", "h1"), ("header", "p"), ("div.header", "a"), ("div.masthead", "h1"), ("footer",), ("footer", "p"),
          ("div.footer", "p"), ("div.footer", "ul", "li", "a"), ("aside",), ("aside", "p"), ("aside", "h3"), ("aside", "ul", "li", "a"), ("div.sidebar", "p"), ("div.sidebar", "div.widget", "h3"),
          ("div.widget", "ul", "li", "a"), ("div.ad",), ("div.ads", "a"), ("div.advert", "p"), ("div.advertisement",), ("aside.ad", "p"), ("section.advert", "p"), ("div.banner", "p"), ("div.sponsored", "p"), ("div.promo", "a"),
          ("form", "label"), ("form", "p"), ("form", "button"), ("form.search", "label"), ("form", "select", "option"), ("select", "option"), ("div.login", "form", "label"), ("div.newsletter", "form", "p"), ("form.subscribe", "p"),
          ("div.cookie", "p"), ("div.cookie.notice",), ("div.cookie.banner", "p"), ("div.consent", "p"), ("div.notice", "p"), ("div.notice",), ("aside.notice", "p"), ("div.alert", "p"), ("p.notice",), ("div.popup", "p"), ("div.modal", "p"),
          ("section.comments", "p"), ("section.comments", "h2"), ("div.comments", "div.comment", "p"), ("div.comments", "ul", "li.comment", "p"), ("ol.comments", "li", "p"), ("div.comment",), ("section.comments", "article.comment", "p"),
          ("div.reply", "p"), ("section.discussion", "p"), ("div.responses", "p"), ("div.related", "a"), ("section.related", "ul", "li", "a"), ("div.share", "a"), ("div.social", "a"), ("div.breadcrumbs", "a"), ("nav.breadcrumb", "a"),
          ("div.pagination", "a"), ("div.tags", "a"), ("div.meta", "span"), ("div.copyright",), ("a.skip",), ("div.toolbar", "button"), ("menu", "li", "a"))


def other_layout(texts: list[str], rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The given texts set into a page of a random layout, with what is article and what is not."""
    draw = lambda of: of[int(rng.integers(len(of)))]
    blocks: list[Block] = []
    labels: list[int] = []

    def put(path: tuple[str, ...], text: str, kind: int) -> None:
        linked = len(text) if path[-1].split(".")[0] == "a" else 0
        blocks.append(Block(("html", "body", *path), text, linked))
        labels.append(kind)

    def noise(inside: tuple[str, ...] = ()) -> None:
        path = draw(_NOISE)
        long = rng.random() < 0.5 and path[-1] not in ("a", "label", "button")
        for _ in range(int(rng.integers(1, 7)) if path[-1] == "a" or "comment" in path[0] else int(rng.integers(1, 3))):
            words = draw(texts).split()
            put((*inside, *path), " ".join(words[:int(rng.integers(8, 60))] if long else words[:int(rng.integers(1, 8))]), 0)

    frame = draw(_FRAMES)
    outer = () if rng.random() < 0.6 else (draw(("div", "div.wrapper", "div.container", "div.page", "div.site", "div.layout")),)
    for _ in range(int(rng.integers(0, 5))):
        noise(outer)
    for _ in range(int(rng.integers(1, 12))):
        put((*outer, *frame, *draw(_LEAVES).split("|")), draw(texts), 1)
        if rng.random() < 0.12:
            noise((*outer, *frame))
    if rng.random() < 0.4:
        noise((*outer, *frame))
    for _ in range(int(rng.integers(0, 5))):
        noise(outer)
    return blocks, np.array(labels)


@dataclass(frozen=True)
class SampleBound:
    """What the fit may see: pages, characters of each, and how many pages of other layouts are made from them."""

    pages: int = 240
    characters: int = 60_000
    layouts: int = 1200


def fit(pages: DataFrame, bound: SampleBound = SampleBound()) -> dict[str, np.ndarray]:
    """Train on a hash sample of the pages, of bounded number and size; equal pages count once.

    The sample is chosen by hashes alone, so that no task sends more than numbers for pages that are not in it.
    """
    cut = pages.select(F.substring(text_or_empty("html"), 1, bound.characters).alias("html")).where("html <> ''").select(
        F.xxhash64(F.lit(7), "html").alias("h"), "html")
    chosen = [r["h"] for r in cut.select("h").distinct().orderBy("h").limit(bound.pages).collect()]
    rows = cut.where(F.col("h").isin(chosen)).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect() if chosen else []
    found = [blocks_of(r["html"]) for r in rows]
    given = [(features(b), np.array([teach(x) for x in b])) for b in found if b]
    texts = sorted({x.text for b in found for x in b}) or ["text"]
    rng = np.random.default_rng(11)
    made = [other_layout(texts, rng) for _ in range(bound.layouts)]
    return train(given + [(features(b), y) for b, y in made])


def extract(pages: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by one space. NULL or
    empty html gives an empty text. Pages are read whole, whatever their length, broken markup as far as it can be. Repeated
    rows stay, other columns are ignored.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            for at in range(0, batch.num_rows, 256):
                found = [blocks_of(h.as_py()) for h in batch.column(2).slice(at, 256)]
                texts += [" ".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep) for blocks, kept in zip(found, label(found, model), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
