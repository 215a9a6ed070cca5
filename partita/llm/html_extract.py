"""Main text of web pages by a recurrent block labeller.

A page is read as the sequence of its leaf blocks. A block's vector holds its hashed tag path (tags with
the words of class, id and role), its hashed words and a few sizes. A bidirectional LSTM in numpy reads
the sequence in both directions, so each block is labelled with the whole page as context; blocks
labelled as content are joined in page order.

There are no labels, so pages teach themselves: in at most SAMPLE pages, chosen by the smallest hashes of
page_id, blocks inside a content element (article, main, ...) and outside boilerplate elements are
content. Each page is also shown with other wrappers, without its telling tags, and with blocks of other
kinds put in (sidebars, notices, forms, comments), whose words come from the pages themselves.

Defined cases: null or empty html gives an empty text; unclosed tags, comments and scripts end with the
page; repeated rows are treated one by one; an empty table gives an empty result; further columns are
ignored; pages of any length are read whole, in time that grows with their length however broken or deep
they are, and nothing of a content block is dropped.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal
from .words import chunks, encode, hashes

SAMPLE = 300
PATH_DIM, WORD_DIM, HIDDEN = 192, 16, 20
DIM = PATH_DIM + WORD_DIM + 8
#: Blocks whose vectors exist at once when pages are labelled.
ROWS = 4096
EPOCHS = 14

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript ol optgroup option p pre search section select summary"
    " table tbody td template tfoot th thead tr ul".split()
)
#: Elements that a new one of the same kind closes, up to the element that holds them.
CLOSES = {"li": "ul ol menu dir", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}
CLOSES = {k: frozenset(v.split()) for k, v in CLOSES.items()}
KIN = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}

# Words of tags, classes, ids and roles that tell content from the rest when pages teach themselves.
CONTENT = frozenset("article main articlebody article-body post-content entry-content post-body story-body article-content maincontent main-content content-body".split())
REST = frozenset(
    "nav aside footer form header menu sidebar ad ads advert advertisement banner cookie consent notice comment comments respond reply share social related promo"
    " newsletter breadcrumb breadcrumbs pagination navbar popup modal widget navigation contentinfo complementary search subscribe sponsor sponsored toolbar button select".split()
)

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
MARK = re.compile(r"[>\"']")
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)


class Path:
    """An element within the one above it. Blocks of a page share their elements, so that paths take no more
    room than the page, however deep it is."""

    __slots__ = ("above", "element", "sum")

    def __init__(self, above: Path | None, element: tuple[str, ...]):
        self.above, self.element, self.sum = above, element, None

    def elements(self) -> list[tuple[str, ...]]:
        """From the outermost one."""
        out, at = [], self
        while at is not None:
            out.append(at.element)
            at = at.above
        return out[::-1]


def path_of(elements: Iterable[tuple[str, ...]], above: Path | None = None) -> Path | None:
    for element in elements:
        above = Path(above, element)
    return above


class Block(NamedTuple):
    path: Path | None  # the innermost element; an element is its tag and the words of its names
    text: str
    linked: int  # code points of the text inside links


class Tags:
    """The tags of a page, found in one scan from left to right.

    A tag ends at the first > outside quotes. Where quotes don't close, it ends at its first >, and so do all
    tags up to where that scan failed; behind the last > of the page there are no tags."""

    def __init__(self, page: str):
        self.page, self.last, self.loose_to = page, page.rfind(">"), -1

    def at(self, lt: int) -> tuple[int, bool, str, str] | None:
        """End, whether it closes, name and the rest of the tag that begins at ``lt``."""
        m = NAME.match(self.page, lt) if lt < self.last else None
        if m is None or m.end() > self.last:
            return None
        end = self._end(lt, m.end())
        return end + 1, bool(m[1]), m[2].lower(), self.page[m.end() : end]

    def _end(self, lt: int, at: int) -> int:
        first = at
        while lt >= self.loose_to:
            mark = MARK.search(self.page, at)
            if mark is not None and mark[0] == ">":
                return mark.start()
            close = -1 if mark is None else self.page.find(mark[0], mark.end())
            if close < 0:
                self.loose_to = len(self.page) if mark is None else mark.start()
                break
            at = close + 1
        return self.page.find(">", first)


class Open:
    """The open elements; where the innermost one of each kind stands is kept, so nothing is searched for."""

    def __init__(self):
        self.tags: list[str] = []
        self.paths: list[Path | None] = []  # the innermost block at or above each element
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    @property
    def path(self) -> Path | None:
        return self.paths[-1] if self.paths else None

    def innermost(self, tags: Iterable[str]) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)

    def push(self, tag: str, names: list[str]) -> None:
        self.where.setdefault(tag, []).append(len(self.tags))
        path = self.path
        if tag in BLOCK:
            self.blocks.append(len(self.tags))
            path = Path(path, (tag, *names))
        self.tags.append(tag)
        self.paths.append(path)

    def cut(self, at: int) -> None:
        """Closes the elements from place ``at`` on."""
        while len(self.tags) > at:
            tag = self.tags.pop()
            self.paths.pop()
            self.where[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def close(self, tag: str) -> None:
        """The innermost element of this kind ends; one that is no block only within its block."""
        at = self.innermost((tag,))
        if at >= 0 and (tag in BLOCK or not self.blocks or at > self.blocks[-1]):
            self.cut(at)

    def make_room(self, tag: str) -> None:
        """A block ends an open paragraph; list items, cells and the like end their sibling."""
        if tag in CLOSES:
            at = self.innermost(("p", *KIN.get(tag, (tag,))))
            if at > self.innermost(CLOSES[tag]):
                self.cut(at)
        elif self.blocks and self.tags[self.blocks[-1]] == "p":
            self.cut(self.blocks[-1])


def blocks(page: str) -> list[Block]:
    """The leaf blocks with text of a page, in order, with character references decoded."""
    out: list[Block] = []
    tags, stack = Tags(page), Open()
    pieces: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(stack.path, text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def words(text: str) -> None:
        nonlocal linked
        text = entities.unescape(text) if "&" in text else text
        pieces.append(text)
        if links:
            linked += len(text)

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            words(page[at:])
            break
        if lt > at:
            words(page[at:lt])
        found = tags.at(lt)
        if found is None:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = size if end < 0 else end + 3
            elif page.startswith(("<!", "<?"), lt):
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                words("<")
                at = lt + 1
            continue
        at, closing, tag, rest = found
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK:
                flush()
            stack.close(tag)
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(page, at)
            if end is None:
                break
            close = page.find(">", end.start())
            at = size if close < 0 else close + 1
            continue
        if tag in BLOCK:
            flush()
            stack.make_room(tag)
        if tag in VOID:  # a slash at the end closes nothing else
            continue
        if tag == "a":
            links += 1
        stack.push(tag, [w for x in NAMES.findall(rest) for w in "".join(x).lower().split()] if "=" in rest else [])
    flush()
    return out


def name_parts(element: tuple[str, ...]) -> list[str]:
    """An element's tag, its names and their parts."""
    return [p for name in element for p in (name, *(re.split(r"[^a-z0-9]+", name) if not name.isalnum() else ()))]


def taught(path: Path | None) -> bool:
    """Whether a block on this path is content, by telling names: the innermost one decides."""
    while path is not None:
        names = name_parts(path.element)
        if not REST.isdisjoint(names):
            return False
        if not CONTENT.isdisjoint(names):
            return True
        path = path.above
    return False


class PathVectors:
    """Signed hashing of path words; the last three elements count twice. Elements repeat, so they are remembered."""

    def __init__(self, keep: int = 20_000):
        self.keep, self.known = keep, {}

    def _own(self, element: tuple[str, ...]) -> np.ndarray:
        found = self.known.get(element)
        if found is None:
            found = np.zeros(PATH_DIM, np.int16)
            for w in dict.fromkeys(name_parts(element)):
                h = zlib.crc32(w.encode())
                for part in (h, h * 2654435761 & 0xFFFFFFFF):
                    found[part % PATH_DIM] += 1 if part >> 16 & 1 else -1
            if len(self.known) >= self.keep:
                self.known.clear()
            self.known[element] = found
        return found

    def of(self, path: Path | None) -> np.ndarray:
        if path is None:
            return np.zeros(PATH_DIM)
        above, at = [], path
        while at is not None and at.sum is None:
            above.append(at)
            at = at.above
        total = at.sum if at is not None else np.zeros(PATH_DIM, np.int16)
        for at in reversed(above):
            at.sum = total = total + self._own(at.element)
        last, at = np.zeros(PATH_DIM, np.int16), path
        for _ in range(3):
            if at is not None:
                last += self._own(at.element)
                at = at.above
        return 0.5 * total + 0.5 * last


def vectors(pages: list[list[Block]], paths: PathVectors) -> np.ndarray:
    """One row for each block of all pages."""
    place = np.concatenate([np.arange(len(p)) / max(1, len(p) - 1) for p in pages]) if pages else np.empty(0)
    total = np.repeat([np.log1p(len(p)) for p in pages], [len(p) for p in pages])
    return _rows([b for page in pages for b in page], place, total, paths)


def _rows(flat: list[Block], place: np.ndarray, total: np.ndarray, paths: PathVectors) -> np.ndarray:
    if not flat:
        return np.zeros((0, DIM))
    path = np.stack([paths.of(b.path) for b in flat])
    hashed, n = np.zeros((len(flat), WORD_DIM)), np.zeros(len(flat))
    for part in encode(pa.array([b.text for b in flat], pa.string()), size=2 << 20):
        h = hashes(part.vocabulary).view(np.uint64)
        rows = len(part.offsets) - 1
        row = np.repeat(np.arange(rows), np.diff(part.offsets))
        slot = (h % np.uint64(WORD_DIM)).astype(np.int64)[part.codes]
        sign = np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)[part.codes]
        hashed[part.start : part.start + rows] = np.bincount(row * WORD_DIM + slot, weights=sign, minlength=rows * WORD_DIM).reshape(rows, WORD_DIM)
        n[part.start : part.start + rows] = np.diff(part.offsets)
    size = np.array([len(b.text) for b in flat], float)
    linked = np.array([b.linked for b in flat], float)
    ended = np.array([b.text[-1] in ".!?:;\"'" for b in flat], float)
    more = np.stack([np.log1p(size) / 4, np.log1p(n) / 3, linked / np.maximum(size, 1), ended, place, total / 4, (n < 4) * 1.0, np.ones(len(flat))], axis=1)
    return np.hstack([path, 0.3 * hashed / np.sqrt(np.maximum(n, 1))[:, None], more])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM and a logistic output; all pages of a call advance together."""

    def __init__(self, dim: int, hidden: int = HIDDEN, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        make = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.weights = [w for _ in range(2) for w in (make(dim, 4 * hidden), make(hidden, 4 * hidden), np.repeat([0.0, 1.0, 0.0, 0.0], hidden))]
        self.weights += [make(2 * hidden, 1)[:, 0], np.zeros(1)]

    def project(self, x: np.ndarray) -> list[np.ndarray]:
        """What the vectors put into the gates of each direction."""
        return [x @ self.weights[3 * i] + self.weights[3 * i + 2] for i in (0, 1)]

    def _run(self, inputs: np.ndarray, sizes: np.ndarray, back: bool, keep: bool = False) -> tuple:
        """States of one direction, and what gradients need if ``keep``. A step's rows are one block of each
        page that is long enough, longest first."""
        wh, k = self.weights[4 if back else 1], self.hidden
        order = np.argsort(-sizes, kind="stable")
        start = (np.cumsum(sizes) - sizes)[order]
        size = sizes[order]
        h, now = np.zeros((len(inputs), k)), np.zeros((len(sizes), k))
        c, gates = (np.zeros((len(inputs), k)), np.zeros((len(inputs), 4 * k))) if keep else (None, None)
        steps, before = [], None
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, "left"))
            at = start[:n] + (size[:n] - 1 - t if back else t)
            z = inputs[at]
            if before is not None:
                z = z + h[before[:n]] @ wh
            g = np.empty_like(z, dtype=float)
            g[:, : 3 * k], g[:, 3 * k :] = _sigmoid(z[:, : 3 * k]), np.tanh(z[:, 3 * k :])
            now = g[:, :k] * g[:, 3 * k :] + g[:, k : 2 * k] * now[:n]
            h[at] = g[:, 2 * k : 3 * k] * np.tanh(now)
            if keep:
                c[at], gates[at] = now, g
                steps.append((at, before[:n] if before is not None else None))
            before = at
        return h, c, gates, steps

    def label(self, inputs: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        """The chance of being content for each block, from projected vectors."""
        both = np.hstack([self._run(inputs[0], sizes, False)[0], self._run(inputs[1], sizes, True)[0]])
        return _sigmoid(both @ self.weights[6] + self.weights[7])

    def predict(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self.label(self.project(x), sizes)

    def gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss, by back-propagation through both directions."""
        runs = [self._run(inputs, sizes, bool(i), True) for i, inputs in enumerate(self.project(x))]
        both, k = np.hstack([r[0] for r in runs]), self.hidden
        miss = (_sigmoid(both @ self.weights[6] + self.weights[7]) - y) / len(y)
        out: list[np.ndarray] = []
        for i, (h, c, gates, steps) in enumerate(runs):
            wh = self.weights[3 * i + 1]
            dh, dc, dz = np.outer(miss, self.weights[6][i * k : (i + 1) * k]), np.zeros_like(c), np.zeros_like(gates)
            dwh = np.zeros_like(wh)
            for at, before in reversed(steps):
                g, tc = gates[at], np.tanh(c[at])
                dct = dc[at] + dh[at] * g[:, 2 * k : 3 * k] * (1 - tc**2)
                d = np.empty_like(g)
                d[:, :k] = dct * g[:, 3 * k :] * g[:, :k] * (1 - g[:, :k])
                d[:, k : 2 * k] = (dct * c[before] * g[:, k : 2 * k] * (1 - g[:, k : 2 * k])) if before is not None else 0
                d[:, 2 * k : 3 * k] = dh[at] * tc * g[:, 2 * k : 3 * k] * (1 - g[:, 2 * k : 3 * k])
                d[:, 3 * k :] = dct * g[:, :k] * (1 - g[:, 3 * k :] ** 2)
                dz[at] = d
                if before is not None:
                    dwh += h[before].T @ d
                    dh[before] += d @ wh.T
                    dc[before] += dct * g[:, k : 2 * k]
            out += [x.T @ dz, dwh, dz.sum(axis=0)]
        return [*out, both.T @ miss, np.array([miss.sum()])]


def _rewrapped(labelled: list[tuple[Block, bool]], wrapper: tuple[str, ...]) -> list[tuple[Block, bool]]:
    """The blocks with ``wrapper`` in the place of article and main elements; shared elements stay shared."""
    new: dict[int, Path] = {}

    def moved(path: Path | None) -> Path | None:
        above, at = [], path
        while at is not None and id(at) not in new:
            above.append(at)
            at = at.above
        now = new[id(at)] if at is not None else None
        for at in reversed(above):
            now = new[id(at)] = Path(now, wrapper if at.element[0] in ("article", "main") else at.element)
        return now

    return [(b._replace(path=moved(b.path)), y) for b, y in labelled]


def _variants(page: list[Block], pool: list[str], rng: np.random.Generator) -> list[tuple[Block, bool]]:
    """A page with its labels, its telling names changed or taken away, and blocks of other kinds put in."""
    labelled = [(b, taught(b.path)) for b in page]
    if not any(y for _, y in labelled):  # no content element: long blocks with few links
        free = lambda p: p is None or REST.isdisjoint(w for e in p.elements() for w in name_parts(e))
        labelled = [(b, len(b.text) > 80 and b.linked * 3 < len(b.text) and free(b.path)) for b in page]
    mode = rng.integers(4)
    if mode:
        names = sorted(CONTENT)
        wrapper = (("main",), ("div", names[rng.integers(len(names))]), ("section", names[rng.integers(len(names))]))[rng.integers(3)] if mode < 3 else ("div",)
        labelled = _rewrapped(labelled, wrapper)
    rest, body = sorted(REST), path_of((("html",), ("body",)))
    for _ in range(int(rng.integers(0, 7))):
        name = rest[rng.integers(len(rest))]
        outer = (name,) if name in BLOCK else ("div", (name, f"{name}-box", f"site-{name}")[rng.integers(3)])
        inner = ((("p",),), (("ul",), ("li",)), (("div", f"{name}-item"), ("p",)), (("label",),), ())[rng.integers(5)]
        at = int(rng.integers(len(labelled) + 1))
        near = labelled[min(at, len(labelled) - 1)][0].path if labelled and rng.random() < 0.5 else None
        path = path_of((outer, *inner), near.above if near is not None else body)
        own = []
        for _ in range(int(rng.integers(1, 6))):
            text = pool[rng.integers(len(pool))]
            if rng.random() < 0.6:
                text = " ".join(text.split()[: int(rng.integers(1, 12))])
            own.append((Block(path, text, len(text) if rng.random() < 0.3 else 0), False))
        labelled[at:at] = own
    return labelled


def fit(pages: list[str], epochs: int = EPOCHS, seed: int = 4) -> Labeller | None:
    parsed = [p for p in (blocks(x) for x in pages) if p]
    if not parsed:
        return None
    rng, paths = np.random.default_rng(seed), PathVectors()
    pool = [b.text for p in parsed for b in p]
    model = Labeller(DIM)
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in model.weights]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(parsed))
        for a in range(0, len(order), 16):
            shown = [_variants(parsed[i], pool, rng) for i in order[a : a + 16]]
            x = vectors([[b for b, _ in p] for p in shown], paths)
            y = np.array([v for p in shown for _, v in p], float)
            step += 1
            for i, g in enumerate(model.gradients(x, np.array([len(p) for p in shown]), y)):
                g = np.clip(g, -1, 1)
                m, v = state[i]
                m += 0.1 * (g - m)
                v += 0.01 * (g**2 - v)
                model.weights[i] = model.weights[i] - 0.02 * 0.9995**step * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def train(pages: DataFrame, sample: int = SAMPLE) -> Labeller | None:
    """The labeller from at most ``sample`` pages."""
    ids = F.broadcast(pages.where(F.col("html").isNotNull()).select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample))
    rows = pages.select("page_id", "html").join(ids, "page_id").where(F.col("html").isNotNull()).dropDuplicates(["page_id"]).collect()
    return fit([r["html"] for r in sorted(rows, key=lambda r: r["page_id"])])


def texts(pages: list[str], model: Labeller | None, paths: PathVectors) -> list[str]:
    parsed = [blocks(p) for p in pages]
    if model is None:
        return ["" for _ in parsed]
    sizes = np.array([len(p) for p in parsed], dtype=np.int64)
    some = sizes > 0
    flat = [b for p in parsed for b in p]
    place = np.concatenate([np.arange(n) / max(1, n - 1) for n in sizes.tolist()])
    total = np.repeat(np.log1p(sizes), sizes)
    parts = [model.project(_rows(flat[a : a + ROWS], place[a : a + ROWS], total[a : a + ROWS], paths)) for a in range(0, len(flat), ROWS)]
    inputs = [np.concatenate(x).astype(np.float32) for x in zip(*parts, strict=True)] if parts else [np.empty((0, 4 * model.hidden))] * 2
    content = model.label(inputs, sizes[some]) >= 0.5
    out, at = [], 0
    for p in parsed:
        out.append("\n".join(b.text for b, y in zip(p, content[at : at + len(p)], strict=True) if y))
        at += len(p)
    return out


def extract(pages: DataFrame, model: Labeller | None) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of ``pages``."""

    def run(batches):
        paths = PathVectors()
        for batch in batches:
            found: list[str] = []
            for _, part in chunks(batch.column(2), 3 << 20):
                found += texts(part.to_pylist(), model, paths)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(frugal(run), "page_id long, url string, text string, n_chars long")
