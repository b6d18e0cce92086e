"""HTML extraction with a recurrent block labeller.

A page is read as its sequence of leaf blocks: stretches of text between block-level tags, with their tag path. Every
block has a tag-path vector (hashed tags and classes), a hashed-word vector and a few numbers. A bidirectional LSTM in
numpy reads the whole sequence and labels each block as content or not, so context counts: what stands before
and after, however far.

Pages have no labels; the teacher is the markup itself: blocks inside ``article`` or ``main`` and not inside navigation, asides,
footers, advertisements or forms are content. In training those two tags are often hidden, so that the network learns
from the rest of the path, the words and the context, and can label pages that lack them.

Defined cases: a null page has null text and 0 blocks, the empty page the empty text; broken markup is read as far as tags
can be told (open tags close with their parents), however deep it nests; scripts, styles and comments are no text; whole pages are read,
however long; repeated rows give equal results; other columns are ignored, whatever their names; with no pages to train on nothing is content; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, trim

#: pages used for training at most: those with the smallest MD5 of their id
SAMPLE = 400
PATH_DIM, WORD_DIM, NUMBERS, HIDDEN = 24, 24, 4, 12
DIM = PATH_DIM + WORD_DIM + NUMBERS
EPOCHS, BATCH, RATE, HIDE = 12, 32, 0.02, 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([^<]+|<)",
    re.S | re.I,
)
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*["']?([\w -]+)""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big br cite code data em font i img kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_INSIDE = frozenset({"article", "main"})
_OUTSIDE = frozenset("nav aside footer form button select head title ad ads advert advertisement promo sponsored share social related comments menu sidebar breadcrumb cookie banner".split())


class Open:
    """An open element: its tag and classes, and the element around it. Elements share their paths instead of copying them."""

    __slots__ = ("around", "tag", "names", "inside", "outside")

    def __init__(self, around: Open | None, tag: str, names: tuple[str, ...]):
        self.around, self.tag, self.names = around, tag, names
        self.inside = bool(around and around.inside) or not _INSIDE.isdisjoint(names)
        self.outside = bool(around and around.outside) or not _OUTSIDE.isdisjoint(names)


@dataclass
class Block:
    at: Open | None
    text: str
    linked: int

    @property
    def path(self) -> tuple[str, ...]:
        out, at = [], self.at
        while at is not None:
            out.append(at.names)
            at = at.around
        return tuple(x for names in reversed(out) for x in names)


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in their order; blank ones are left out. Takes time and memory in proportion to the page, however deep it nests."""
    out: list[Block] = []
    top: Open | None = None
    count: dict[str, int] = {}
    parts: list[str] = []
    linked, at = 0, None

    def end() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(at, text, linked))
        parts.clear()
        linked = 0

    def close() -> None:
        nonlocal top
        count[top.tag] -= 1
        top = top.around

    for m in _TOKEN.finditer(page):
        text = m[5]
        if text is not None:
            if not parts:
                at = top
            parts.append(text)
            if count.get("a"):
                linked += len(text)
            continue
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in _INLINE:
            end()
        elif tag == "br":
            parts.append(" ") if parts else None
        if m[2]:
            if count.get(tag):
                while top.tag != tag:
                    close()
                close()
        elif tag not in _VOID and not m[4].endswith("/"):
            if tag in _SELF_CLOSING and top and top.tag in _SELF_CLOSING[tag]:
                close()
            names = (tag,)
            if m[4]:
                names += tuple(x.lower() for c in _CLASS.findall(m[4]) for x in c.split())
            top = Open(top, tag, names)
            count[tag] = count.get(tag, 0) + 1
    end()
    return out


def teacher(block: Block) -> bool:
    return block.at is not None and block.at.inside and not block.at.outside


def _slot(cache: dict[str, int], word: str, dim: int) -> int:
    k = cache.get(word)
    if k is None:
        if len(cache) > 300_000:
            cache.clear()
        k = cache[word] = zlib.crc32(word.encode()) % dim
    return k


def vectors(found: list[Block], cache: dict[str, int], hide: frozenset[str] = frozenset()) -> np.ndarray:
    """One row for each block: hashed tag path, hashed words, numbers. Tags in ``hide`` are left out."""
    x = np.zeros((len(found), DIM), np.float32)
    if not found:
        return x
    slots, owner, paths = [], [], {None: np.zeros(PATH_DIM, np.float32)}
    for k, b in enumerate(found):
        new, at = [], b.at
        while at not in paths:
            new.append(at)
            at = at.around
        for at in reversed(new):  # an element's vector is that of the one around it, and its own names
            own = paths[at] = paths[at.around].copy()
            for t in at.names:
                if t not in hide:
                    own[_slot(cache, "<" + t, PATH_DIM)] += 1
        x[k, :PATH_DIM] = paths[b.at]
        ws = b.text.lower().split()
        slots.extend([_slot(cache, w, WORD_DIM) for w in ws])
        owner.append(len(ws))
        x[k, -4:] = (np.log1p(len(b.text)) / 4, np.log1p(len(ws)) / 4, min(1.0, b.linked / len(b.text)), b.text[-1] in ".!?…")
    at = np.repeat(np.arange(len(found)), owner) * WORD_DIM + np.array(slots, np.int64)
    counts = np.bincount(at, minlength=len(found) * WORD_DIM).reshape(len(found), WORD_DIM)
    x[:, PATH_DIM : PATH_DIM + WORD_DIM] = counts / np.maximum(1, np.array(owner))[:, None]
    np.minimum(x[:, :PATH_DIM], 2, out=x[:, :PATH_DIM])
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class BiLSTM:
    """A bidirectional LSTM with a logistic output for each step; sequences are padded and masked."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> BiLSTM:
        p = {}
        for d in "fb":
            p["w" + d] = (rng.standard_normal((DIM + HIDDEN, 4 * HIDDEN)) / np.sqrt(DIM + HIDDEN)).astype(np.float32)
            p["c" + d] = np.zeros(4 * HIDDEN, np.float32)
            p["c" + d][HIDDEN : 2 * HIDDEN] = 1
        p["o"] = (rng.standard_normal(2 * HIDDEN) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        p["z"] = np.zeros(1, np.float32)
        return cls(p)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        w, c = self.p["w" + d], self.p["c" + d]
        t, b, _ = x.shape
        gates = x.reshape(t * b, -1) @ w[:DIM] + c
        gates = gates.reshape(t, b, 4 * HIDDEN)
        h, s = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        out = np.zeros((t, b, HIDDEN), np.float32)
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            a = gates[k] + h @ w[DIM:]
            i, f, o = _sigmoid(a[:, :HIDDEN]), _sigmoid(a[:, HIDDEN : 2 * HIDDEN]), _sigmoid(a[:, 2 * HIDDEN : 3 * HIDDEN])
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[k][:, None]
            s2 = f * s + i * g
            ts = np.tanh(s2)
            if keep is not None:
                keep.append((k, h, s, i, f, o, g, ts, m))
            h, s = np.where(m, o * ts, h), np.where(m, s2, s)
            out[k] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run("f", x, mask, None), self._run("b", x, mask, None)], 2)
        return both @ self.p["o"] + self.p["z"]

    def loss_and_gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        kept = {"f": [], "b": []}
        both = np.concatenate([self._run(d, x, mask, kept[d]) for d in "fb"], 2)
        z = both @ self.p["o"] + self.p["z"]
        n = mask.sum()
        loss = float((np.logaddexp(0, z) - y * z)[mask].sum() / n)
        dz = np.where(mask, (_sigmoid(z) - y) / n, 0).astype(np.float32)
        grads = {"o": np.einsum("tb,tbh->h", dz, both), "z": dz.sum(keepdims=False).reshape(1)}
        for e, d in enumerate("fb"):
            w = self.p["w" + d]
            dh_out = dz[:, :, None] * self.p["o"][e * HIDDEN : (e + 1) * HIDDEN]
            dw, dc = np.zeros_like(w), np.zeros_like(self.p["c" + d])
            dh, ds = np.zeros(dh_out.shape[1:], np.float32), np.zeros(dh_out.shape[1:], np.float32)
            for k, h, s, i, f, o, g, ts, m in reversed(kept[d]):
                dh = dh + dh_out[k]
                dh_in, ds_in = np.where(m, dh, 0), np.where(m, ds, 0)
                dst = ds_in + dh_in * o * (1 - ts**2)
                da = np.concatenate([dst * g * i * (1 - i), dst * s * f * (1 - f), dh_in * ts * o * (1 - o), dst * i * (1 - g**2)], 1)
                dw[:DIM] += x[k].T @ da
                dw[DIM:] += h.T @ da
                dc += da.sum(0)
                dh, ds = np.where(m, da @ w[DIM:].T, dh), np.where(m, dst * f, ds)
            grads["w" + d], grads["c" + d] = dw, dc
        return loss, grads


def padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Time-major batch and mask."""
    t = max(len(x) for x in xs)
    out, mask = np.zeros((t, len(xs), DIM), np.float32), np.zeros((t, len(xs)), bool)
    for k, x in enumerate(xs):
        out[: len(x), k], mask[: len(x), k] = x, True
    return out, mask


def train(pages: list[str], seed: int = 5) -> BiLSTM | None:
    """Fit the labeller; None without a block to learn from."""
    rng = np.random.default_rng(seed)
    found = [b for b in map(blocks, pages) if b]
    if not found:
        return None
    net, cache = BiLSTM.fresh(rng), {}
    labels = [np.array([teacher(b) for b in bs], np.float32) for bs in found]
    seen = [vectors(bs, cache) for bs in found]
    hidden = [vectors(bs, cache, _INSIDE) for bs in found]
    m1, m2, step = {k: 0 * v for k, v in net.p.items()}, {k: 0 * v for k, v in net.p.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(found))
        for s in range(0, len(order), BATCH):
            pick = order[s : s + BATCH]
            x, mask = padded([hidden[k] if rng.random() < HIDE else seen[k] for k in pick])
            y = np.zeros(mask.shape, np.float32)
            for j, k in enumerate(pick):
                y[: len(labels[k]), j] = labels[k]
            _, grads = net.loss_and_gradients(x, y, mask)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            step += 1
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g**2
                rate = RATE * (1 - 0.8 * epoch / EPOCHS)
                net.p[k] = (net.p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def label(net: BiLSTM | None, found: list[list[Block]], cache: dict[str, int]) -> list[np.ndarray]:
    """For every page, whether each block is content. Pages of like length go through the network together."""
    out = [np.zeros(len(bs), bool) for bs in found]
    if net is None:
        return out
    order = sorted((k for k in range(len(found)) if found[k]), key=lambda k: len(found[k]))
    begin = 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and (end - begin + 1) * len(found[order[end]]) <= 20_000:
            end += 1
        pick = order[begin:end]
        x, mask = padded([vectors(found[k], cache) for k in pick])
        z = net.logits(x, mask)
        for j, k in enumerate(pick):
            out[k] = z[: len(found[k]), j] > 0
        begin = end
    return out


def extract(pages: DataFrame, net: BiLSTM | None) -> DataFrame:
    """``page_id, text, n_blocks, n_content`` for every row; the text's lines are the content blocks."""
    sent = pages.sparkSession.sparkContext.broadcast(None if net is None else net.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = None if sent.value is None else BiLSTM(sent.value), {}
        for batch in batches:
            for part in slices(batch, "html", 2 << 20):
                raw = part.column("html").to_pylist()
                found = [blocks(p) if p else [] for p in raw]
                good = label(own, found, cache)
                texts = [None if p is None else "\n".join(b.text for b, ok in zip(bs, g) if ok) for p, bs, g in zip(raw, found, good)]
                n, c = [len(bs) for bs in found], [int(g.sum()) for g in good]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(texts, pa.string()), pa.array(n, pa.int32()), pa.array(c, pa.int32())], ["page_id", "text", "n_blocks", "n_content"])
        trim()

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["html"].alias("html"))
    return rows.mapInArrow(run, "page_id long, text string, n_blocks int, n_content int")


def sample(pages: DataFrame, n: int = SAMPLE) -> list[str]:
    """At most ``n`` pages, for training."""
    ids = pages.select(pages["page_id"].alias("id")).filter("id IS NOT NULL").distinct().orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(n)
    rows = pages.select(pages["page_id"].alias("id"), pages["html"].alias("html")).filter("html IS NOT NULL")
    return [r["html"] for r in rows.join(F.broadcast(ids), "id").orderBy("id", "html").collect()]


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(sample(pages)))
