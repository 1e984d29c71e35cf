"""Main text of web pages with a recurrent block labeller.

A page becomes the sequence of its text blocks (runs of text between block-level tags) in page order. Each block is
described by hashed vectors of its tag path (tags and the words of their class, id and role) and of its
words, and by a few numbers; a bidirectional LSTM reads the whole sequence and labels every block as main
text or not. The weights are trained here, on pages that are put together from known parts (menus, headers,
adverts, notices, sidebars, forms, comments, footers around an article) with words of a bounded sample of
the table's own blocks: the part that a block was put into is its label.

Text inside scripts, styles and other parts that are never shown is left out, character references are
decoded, white space inside a block becomes one blank, and kept blocks are joined by line feeds. Null and empty
pages have empty text. Repeated rows get equal results. Pages of any length are read whole.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityops.llm import words as W

# Fixed tag names of the HTML standard.
RAW = "script style title textarea iframe".split()
HIDDEN = "noscript template svg math object canvas select".split()
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"body": {"head"}, "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div article section main aside nav header footer form body blockquote".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(" + "|".join(HIDDEN) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?</\2\s*>"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|([^<]+|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-z]+|\d+")
PATH, WORDS, DENSE = 48, 32, 8


@dataclass(frozen=True)
class Settings:
    """``sample`` pages give the words that ``pages`` training pages are made of."""

    hidden: int = 16
    sample: int = 200
    pages: int = 600
    epochs: int = 6
    batch: int = 16
    rate: float = 0.01
    seed: int = 11
    threshold: float = 0.5


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int


def blocks(page: str | None) -> list[Block]:
    """Text blocks in page order, with the tags around them from the outside in."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    path: tuple[str, ...] | None = None
    linked = links = 0

    def close() -> None:
        nonlocal text, path, linked
        if text:
            plain = " ".join("".join(text).split())
            if plain:
                out.append(Block(plain, path or (), min(linked, len(plain))))
        text, path, linked = [], None, 0

    for m in _TOKEN.finditer(page or ""):
        end, name, attributes, words = m.groups()[2:]
        if words is not None:
            plain = entities.unescape(words)
            if plain.strip():
                if path is None:
                    path = tuple(p for _, ps in stack for p in ps)
                linked += len(plain) if links else 0
            text.append(plain)
        elif name is not None:
            tag = name.lower()
            if tag == "br":
                text.append(" ")
                continue
            if tag not in INLINE:
                close()
            if end:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        links -= sum(t == "a" for t, _ in stack[k:])
                        del stack[k:]
                        break
            elif tag not in VOID and not attributes.endswith("/"):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in CLOSES.get(tag, ()):
                        links -= sum(t == "a" for t, _ in stack[k:])
                        del stack[k:]
                    elif stack[k][0] in SCOPES:
                        break
                named = [w for a in _NAMES.findall(attributes) for w in _PARTS.findall("".join(a).lower())] if attributes else []
                stack.append((tag, (tag, *(f".{w}" for w in named))))
                links += tag == "a"
    close()
    return out


_HASH: dict[str, int] = {}


def _slot(name: str) -> int:
    if name not in _HASH:
        if len(_HASH) > 1 << 16:
            _HASH.clear()
        _HASH[name] = zlib.crc32(name.encode()) % PATH
    return _HASH[name]


def features(found: list[Block]) -> np.ndarray:
    """One row a block: tag path, words, and numbers."""
    out = np.zeros((len(found), PATH + WORDS + DENSE), dtype=np.float32)
    if not found:
        return out
    hashed = W.split_words([b.text.encode() for b in found])
    bucket = (hashed.hash >> np.uint64(40)).astype(np.int64) % WORDS
    sign = np.where(hashed.hash & np.uint64(1), 1.0, -1.0)
    n_words = np.diff(hashed.first)
    out[:, PATH : PATH + WORDS] = np.bincount(hashed.doc * WORDS + bucket, weights=sign, minlength=len(found) * WORDS).reshape(len(found), WORDS) / np.sqrt(np.maximum(n_words, 1))[:, None]
    for i, b in enumerate(found):
        for k, name in enumerate(b.path[::-1]):
            out[i, _slot(name)] += 1.0 / (1 + 0.25 * k)
    size = np.array([len(b.text) for b in found], dtype=np.float64)
    dense = PATH + WORDS
    out[:, dense] = np.log1p(size) / 8
    out[:, dense + 1] = np.log1p(n_words) / 6
    out[:, dense + 2] = np.array([b.linked for b in found]) / size
    out[:, dense + 3] = np.arange(len(found)) / len(found)
    out[:, dense + 4] = [b.text[-1] in ".!?…" for b in found]
    out[:, dense + 5] = [len(b.path) / 10 for b in found]
    out[:, dense + 6] = np.arange(len(found)) == 0
    out[:, dense + 7] = 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _run(m: dict[str, np.ndarray], side: str, x: np.ndarray, live: np.ndarray) -> dict[str, np.ndarray]:
    """One direction over (time, batch, features); steps that are not ``live`` keep the state."""
    steps, batch, _ = x.shape
    n = m[f"{side}_u"].shape[0]
    given = x @ m[f"{side}_w"]
    h, c = np.zeros((steps + 1, batch, n), given.dtype), np.zeros((steps + 1, batch, n), given.dtype)
    gates, squash = np.zeros((steps, batch, 4 * n), given.dtype), np.zeros((steps, batch, n), given.dtype)
    order = range(steps) if side == "f" else range(steps - 1, -1, -1)
    for t in order:
        past = t if side == "f" else t + 1
        now = t + 1 if side == "f" else t
        z = given[t] + h[past] @ m[f"{side}_u"] + m[f"{side}_b"]
        z[:, : 3 * n] = _sigmoid(z[:, : 3 * n])
        z[:, 3 * n :] = np.tanh(z[:, 3 * n :])
        gates[t] = z
        new = z[:, n : 2 * n] * c[past] + z[:, :n] * z[:, 3 * n :]
        squash[t] = np.tanh(new)
        on = live[t][:, None]
        c[now] = np.where(on, new, c[past])
        h[now] = np.where(on, z[:, 2 * n : 3 * n] * squash[t], h[past])
    return {"h": h, "c": c, "gates": gates, "squash": squash}


def _back(m: dict[str, np.ndarray], side: str, x: np.ndarray, live: np.ndarray, f: dict[str, np.ndarray], dh_out: np.ndarray, grad: dict[str, np.ndarray]) -> None:
    steps, batch, _ = x.shape
    n = m[f"{side}_u"].shape[0]
    dz_all = np.zeros((steps, batch, 4 * n), dh_out.dtype)
    dh, dc = np.zeros((batch, n), dh_out.dtype), np.zeros((batch, n), dh_out.dtype)
    for t in range(steps - 1, -1, -1) if side == "f" else range(steps):
        past = t if side == "f" else t + 1
        on = live[t][:, None]
        g, squash = f["gates"][t], f["squash"][t]
        total = dh + dh_out[t]
        now_h, now_c = np.where(on, total, 0), np.where(on, dc, 0)
        dc_new = now_c + now_h * g[:, 2 * n : 3 * n] * (1 - squash * squash)
        dz = np.concatenate(
            (dc_new * g[:, 3 * n :], dc_new * f["c"][past], now_h * squash, dc_new * g[:, :n]),
            axis=1,
        )
        dz[:, : 3 * n] *= g[:, : 3 * n] * (1 - g[:, : 3 * n])
        dz[:, 3 * n :] *= 1 - g[:, 3 * n :] ** 2
        dz_all[t] = dz
        grad[f"{side}_u"] += f["h"][past].T @ dz
        dh = dz @ m[f"{side}_u"].T + np.where(on, 0, total)
        dc = dc_new * g[:, n : 2 * n] + np.where(on, 0, dc)
    grad[f"{side}_w"] += x.reshape(-1, x.shape[2]).T @ dz_all.reshape(-1, 4 * n)
    grad[f"{side}_b"] += dz_all.sum((0, 1))


def start(s: Settings) -> dict[str, np.ndarray]:
    draw, size, n = np.random.default_rng(s.seed), PATH + WORDS + DENSE, s.hidden
    m = {}
    for side in "fb":
        m[f"{side}_w"] = (draw.standard_normal((size, 4 * n)) / np.sqrt(size)).astype(np.float32)
        m[f"{side}_u"] = (draw.standard_normal((n, 4 * n)) / np.sqrt(n)).astype(np.float32)
        m[f"{side}_b"] = np.concatenate((np.zeros(n), np.ones(n), np.zeros(2 * n))).astype(np.float32)
    m["out"], m["out_b"] = (draw.standard_normal(2 * n) / np.sqrt(2 * n)).astype(np.float32), np.zeros(1, np.float32)
    return m


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), PATH + WORDS + DENSE), dtype=np.float32)
    live = np.zeros((steps, len(pages)), dtype=bool)
    for i, p in enumerate(pages):
        x[: len(p), i], live[: len(p), i] = p, True
    return x, live


def _labels(m: dict[str, np.ndarray], x: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, dict, dict]:
    ahead, behind = _run(m, "f", x, live), _run(m, "b", x, live)
    both = np.concatenate((ahead["h"][1:], behind["h"][:-1]), axis=2)
    return _sigmoid(both @ m["out"] + m["out_b"]), ahead, behind


def gradient(m: dict[str, np.ndarray], x: np.ndarray, live: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy over live blocks."""
    p, ahead, behind = _labels(m, x, live)
    d = (np.where(live, p - y, 0) / live.sum()).astype(p.dtype)
    grad = {k: np.zeros_like(v) for k, v in m.items()}
    both = np.concatenate((ahead["h"][1:], behind["h"][:-1]), axis=2)
    grad["out"], grad["out_b"] = np.einsum("tb,tbn->n", d, both), d.sum(keepdims=True).reshape(1)
    n = len(m["out"]) // 2
    _back(m, "f", x, live, ahead, d[:, :, None] * m["out"][:n], grad)
    _back(m, "b", x, live, behind, d[:, :, None] * m["out"][n:], grad)
    return grad


# Parts of training pages: element and names around the text, by whether it is main text. Each is a pattern of mark-up.
OUTSIDE = [
    ("<nav{}><ul>{}</ul></nav>", "", "menu main-menu navigation navbar breadcrumbs", "<li><a href='#'>{}</a></li>"),
    ("<header{}>{}</header>", "", "header site-header top masthead", "<div>{}</div>"),
    ("<div{}>{}</div>", "ad", "ad ads advert advertisement banner sponsored promo", "{}"),
    ("<div{}>{}</div>", "cookie", "cookie notice cookie-banner consent alert gdpr", "<p>{}</p>"),
    ("<aside{}>{}</aside>", "", "sidebar related widget recommended", "<p>{}</p>"),
    ("<div{}>{}</div>", "sidebar", "sidebar related widget links", "<li><a href='#'>{}</a></li>"),
    ("<form{}>{}</form>", "", "search login newsletter subscribe signup", "<label>{}</label><button>{}</button>"),
    ("<section{}>{}</section>", "comments", "comments comment-list discussion replies", "<div class='comment'><p>{}</p></div>"),
    ("<div{}>{}</div>", "comments", "comments user-comments responses", "<p>{}</p>"),
    ("<ul{}>{}</ul>", "share", "share social tags pagination", "<li><a href='#'>{}</a></li>"),
    ("<footer{}>{}</footer>", "", "footer site-footer bottom copyright", "{}"),
]
INSIDE = ["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p><b>{}</b></p>", "<p><b>{}<br></p>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote><p>{}</p></blockquote>", "<div>{}</div>", "<table><tr><td>{}</td></tr></table>", "<pre>{}</pre>"]
BODIES = ["<article>{}</article>", "<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", "<div class='content'>{}</div>", "<div id='main-content' class='post entry'>{}</div>", "<section class='article-body'>{}</section>", "<div class='story text'>{}</div>"]
_MARK = "\x02"


def training_page(draw: np.random.Generator, stock: list[str]) -> str:
    """A page of known parts; main text is marked by a letter that is removed before features are taken."""

    def text(low: int, high: int) -> str:
        source = stock[int(draw.integers(len(stock)))].split()
        at, n = int(draw.integers(max(1, len(source)))), int(draw.integers(low, high))
        return entities.escape(" ".join((source * (1 + (at + n) // max(1, len(source))))[at : at + n]))

    def part(pattern: tuple[str, str, str, str]) -> str:
        shell, fixed, names, row = pattern
        name = str(draw.choice(names.split()))
        shown = name if fixed or draw.random() < 0.5 else ""
        attribute = f" {draw.choice(['class', 'id'])}='{shown}'" if shown else ""
        short = "<li>" in row or "label" in row
        rows = "".join(row.format(*[text(1, 4) if short else text(3, 40)] * row.count("{}")) for _ in range(int(draw.integers(1, 8))))
        return shell.format(attribute, rows)

    def article() -> str:
        rows = [f"<h1>{_MARK}{text(2, 10)}</h1>"] if draw.random() < 0.8 else []
        rows += [str(draw.choice(INSIDE)).format(_MARK + (text(1, 6) if draw.random() < 0.25 else text(4, 120))) for _ in range(int(draw.integers(1, 16)))]
        for _ in range(int(draw.integers(0, 3)) if draw.random() < 0.4 else 0):
            rows.insert(int(draw.integers(1, len(rows) + 1)), part(OUTSIDE[int(draw.choice([2, 4, 5, 9]))]))
        return str(draw.choice(BODIES)).format("".join(rows))

    before = [part(OUTSIDE[i]) for i in range(6) if draw.random() < (0.7 if i in (0, 2) else 0.3)]
    after = [part(OUTSIDE[i]) for i in range(2, 11) if draw.random() < (0.7 if i == 10 else 0.25)]
    if draw.random() < 0.3:
        draw.shuffle(before)
    return f"<html><head><title>x</title></head><body>{''.join(before)}{article()}{''.join(after)}</body></html>"


def fit(pages: DataFrame, s: Settings = Settings(), html: str = "html", page_id: str = "page_id") -> dict[str, np.ndarray]:
    """Weights from training pages; the table gives the words, by a sample of the pages whose ids hash lowest."""
    chosen = pages.where(F.col(page_id).isNotNull()).select(F.col(page_id).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(s.sample)
    rows = pages.join(F.broadcast(chosen), F.col(page_id) == F.col("_id")).select(F.xxhash64("_id").alias("h"), F.col(html))

    def run(batches):
        for batch in batches:
            texts = [sorted((b.text for b in blocks(v)), key=len)[-4:] for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[t[:2000] for t in ts] for ts in texts], pa.list_(pa.string()))], names=["h", "texts"])

    found = sorted(rows.mapInArrow(run, "h long, texts array<string>").collect())
    return train([t for r in found for t in r["texts"]] or ["word"], s)


def train(stock: list[str], s: Settings) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(s.seed)
    data = []
    for _ in range(s.pages):
        found = blocks(training_page(draw, stock))
        y = np.array([b.text.startswith(_MARK) for b in found], dtype=np.float32)
        for b in found:
            b.text = b.text.lstrip(_MARK) or "x"
        data.append((features(found), y))
    m = start(s)
    low, high = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    step = 0
    for epoch in range(s.epochs):
        order = draw.permutation(len(data))
        for at in range(0, len(order), s.batch):
            part = [data[i] for i in order[at : at + s.batch]]
            x, live = _padded([f for f, _ in part])
            y = np.zeros(live.shape, np.float32)
            for i, (_, labels) in enumerate(part):
                y[: len(labels), i] = labels
            step += 1
            rate = s.rate * (1 - epoch / s.epochs)
            for k, v in gradient(m, x, live, y).items():
                low[k], high[k] = 0.9 * low[k] + 0.1 * v, 0.999 * high[k] + 0.001 * v * v
                m[k] = (m[k] - rate * (low[k] / (1 - 0.9**step)) / (np.sqrt(high[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def main_text(pages: DataFrame, model: dict[str, np.ndarray], s: Settings = Settings(), html: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text, and ``n_chars``; pages of like length are read side by side."""
    names = [c for c in pages.columns if c not in ("text", "n_chars")]
    place = names.index(html)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in W.slices(batches, place, 4 << 20):
            found = [blocks(v) for v in batch.column(place).to_pylist()]
            texts = [""] * len(found)
            order = sorted((i for i in range(len(found)) if found[i]), key=lambda i: len(found[i]))
            group: list[int] = []
            for k, i in enumerate(order):
                group.append(i)
                if len(group) == 64 or len(group) * len(found[i]) > 8192 or k + 1 == len(order):
                    x, live = _padded([features(found[j]) for j in group])
                    p = _labels(m, x, live)[0]
                    for column, j in enumerate(group):
                        texts[j] = "\n".join(b.text for b, keep in zip(found[j], p[:, column], strict=False) if keep >= s.threshold)
                    group = []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"]
            )

    rows = pages.select(*names)
    return rows.mapInArrow(run, type(rows.schema)(list(rows.schema.fields)).add("text", "string").add("n_chars", "long"))
