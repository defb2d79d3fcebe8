"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: text between block-level tags, with the tags and class
words of its ancestors.  Hashed features of ancestors and text, and the label of the
block before, score two labels (main text or not); Viterbi decoding picks the best
sequence.  Weights come from labelled pages: each partition runs stochastic gradient
steps on its pages and Spark averages the partitions' weights after each round.

Defined results: null or empty html, or html without text, gives an empty text; text
before or after any tags is a block of its own; unclosed and stray tags are tolerated:
self-closed or unclosed drawings and embedded elements hide nothing after them, unclosed
scripts and styles hide the rest of the page, as in browsers; features read the innermost
NEAREST ancestors of a block, texts are whole at any depth and length; repeated rows give
repeated results; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import small_batches
from lodegraph.llm.quality import summed

DIMS = 1 << 13
ROUNDS = 3
EPOCHS = 4
RATE = 0.2
SHRINK = 1e-5
NEAREST = 64

# How HTML treats its elements.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr img".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title".split())
TO_THE_END = frozenset("script style".split())
FOREIGN = frozenset("svg math".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
SELF_CLOSING |= {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
P_CLOSERS = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "menu nav ol p pre section table ul".split()
)

CONTAINERS = frozenset("body article main section div aside nav footer header form details fieldset".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>", re.S
)
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-zA-Z]+")
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


class Block:
    __slots__ = ("text", "tag", "path", "linked", "names", "near", "parent")

    def __init__(self, text, tag, path, linked, names, near, parent):
        self.text, self.tag, self.path, self.linked, self.names = text, tag, path, linked, names
        self.near, self.parent = near, parent


def leaf_blocks(page: str) -> list[Block]:
    """Blocks of text in page order, with their ancestors' tags and class words."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], int]] = []
    depth: Counter = Counter()
    parts: list[str] = []
    linked = opened = anchors = 0

    def close():
        nonlocal linked
        text = " ".join(html_lib.unescape("".join(parts)).split())
        if text:
            around = stack[-NEAREST:]
            path = [t for t, _, _ in around if t not in INLINE]
            names = {n for _, ns, _ in around for n in ns}
            near, _, parent = next((e for e in reversed(around) if e[0] in CONTAINERS), ("", (), -1))
            tag = path[-1] if path else ""
            out.append(Block(text, tag, tuple(path), min(1.0, linked / len(text)), names, near, parent))
        parts.clear()
        linked = 0

    def add(text):
        nonlocal linked
        parts.append(text)
        if anchors:
            linked += len(text)

    def pop_to(name, stop=()):
        nonlocal anchors
        if not depth[name]:
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                for gone, _, _ in stack[i:]:
                    depth[gone] -= 1
                del stack[i:]
                anchors = depth["a"]
                return
            if stack[i][0] in stop:
                return

    def push(name, names=(), number=-1):
        nonlocal anchors
        stack.append((name, names, number))
        depth[name] += 1
        anchors = depth["a"]

    at, find, unclosed = 0, _MARKUP.search, set()
    while m := find(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in RAW and not m[1]:
            if name not in unclosed and not (name in FOREIGN and m[3].endswith("/")):
                if end := _ENDS[name].search(page, at):
                    at = end.end()
                elif name in TO_THE_END:
                    at = len(page)
                else:
                    unclosed.add(name)
            if name not in INLINE:
                close()
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in INLINE:
            if m[1]:
                pop_to(name, P_CLOSERS)
            elif name not in VOID:
                push(name)
            continue
        close()
        if m[1]:
            pop_to(name)
            continue
        if name in P_CLOSERS:
            pop_to("p", P_CLOSERS - {"p"})
        for other in SELF_CLOSING.get(name, ()):
            pop_to(other, ("ul", "ol", "table", "dl", "select"))
        if name not in VOID and not m[3].endswith("/"):
            values = [a or b or c for a, b, c in _NAMED.findall(m[3])]
            opened += 1
            push(name, tuple(w.lower() for v in values for w in _PART.findall(v))[:8], opened)
    add(page[at:])
    close()
    return out


def _bucket(x: float, edges) -> int:
    return sum(x >= e for e in edges)


def features(blocks: list[Block]) -> list[np.ndarray]:
    """Hashed feature numbers of each block."""
    out = []
    cache: dict[str, int] = {}

    def place(name: str) -> int:
        if (found := cache.get(name)) is None:
            found = cache[name] = zlib.crc32(name.encode()) % DIMS
        return found

    for b in blocks:
        words, n = b.text.count(" ") + 1, len(b.text)
        long = _bucket(words, (2, 4, 8, 15, 30, 80))
        link = _bucket(b.linked, (0.01, 0.3, 0.7, 0.95))
        ends = b.text[-1] in ".!?:;\"»…"
        names = ["bias", f"tag={b.tag}", f"long={long}", f"link={link}", f"tag={b.tag},long={long},link={link}"]
        names += [f"in={t}" for t in set(b.path)] + [f"name={w}" for w in b.names]
        names.append(f"end={ends},{long}")
        names += [f"sign={'©' in b.text or '(c)' in b.text}", f"digits={_bucket(sum(map(str.isdigit, b.text)) / n, (0.05, 0.3))}"]
        plain = "" if b.names else ",plain"
        names += [f"near={b.near}{plain}", f"near={b.near},tag={b.tag}{plain}", f"near={b.near},long={long}"]
        names.append("path=" + ">".join(t for t in b.path if t in CONTAINERS) + plain)
        out.append(np.array([place(x) for x in names], np.int64))
    return out


class Crf:
    """Weights of two labels: features (DIMS x 2), transitions, first labels (2).

    There are two tables of transitions (2 x 2): into another container, within one.
    """

    SIZE = DIMS * 2 + 10

    def __init__(self, vector: np.ndarray | None = None):
        self.vector = np.zeros(self.SIZE) if vector is None else vector
        self.emit = self.vector[: DIMS * 2].reshape(DIMS, 2)
        self.move = self.vector[DIMS * 2 : DIMS * 2 + 8].reshape(2, 2, 2)
        self.first = self.vector[DIMS * 2 + 8 :]

    def scores(self, found: list[np.ndarray]) -> np.ndarray:
        return np.array([self.emit[f].sum(0) for f in found])

    def decode(self, found: list[np.ndarray], same: list[int]) -> list[int]:
        """Viterbi: the label sequence with the highest score."""
        emit, moves = self.scores(found).tolist(), self.move.tolist()
        s0, s1 = emit[0][0] + self.first[0], emit[0][1] + self.first[1]
        back = []
        for (e0, e1), within in zip(emit[1:], same[1:]):
            (m00, m01), (m10, m11) = moves[within]
            back.append((int(s1 + m10 > s0 + m00), int(s1 + m11 > s0 + m01)))
            s0, s1 = max(s0 + m00, s1 + m10) + e0, max(s0 + m01, s1 + m11) + e1
        labels = [int(s1 > s0)]
        for pair in reversed(back):
            labels.append(pair[labels[-1]])
        return labels[::-1]

    def step(self, found: list[np.ndarray], same: list[int], labels: list[int], rate: float) -> None:
        """One gradient step on the log-likelihood of a labelled page (forward-backward)."""
        emit, n = self.scores(found), len(found)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        forward[0] = self.first + emit[0]
        for i in range(1, n):
            forward[i] = np.logaddexp.reduce(forward[i - 1][:, None] + self.move[same[i]], axis=0) + emit[i]
        for i in range(n - 2, -1, -1):
            backward[i] = np.logaddexp.reduce(self.move[same[i + 1]] + (emit[i + 1] + backward[i + 1])[None, :], axis=1)
        total = np.logaddexp.reduce(forward[-1])
        expected = np.exp(forward + backward - total)
        target = np.zeros((n, 2))
        target[np.arange(n), labels] = 1
        for i in range(1, n):
            joint = np.exp(forward[i - 1][:, None] + self.move[same[i]] + (emit[i] + backward[i])[None, :] - total)
            self.move[same[i]] -= rate * joint / n
            self.move[same[i], labels[i - 1], labels[i]] += rate / n
        self.first += rate * (target[0] - expected[0]) / n
        push = rate * (target - expected)
        for f, p in zip(found, push):
            np.add.at(self.emit, f, p / len(f) ** 0.5)
        self.vector *= 1 - SHRINK


def within(blocks: list[Block]) -> list[int]:
    """1 for blocks that stand in the container of the block before."""
    return [0, *(int(a.parent == b.parent) for a, b in zip(blocks, blocks[1:]))]


def block_labels(blocks: list[Block], text: str) -> list[int]:
    """1 for blocks that continue the known main text, in order."""
    wanted, at, out = text.split("\n\n"), 0, []
    for b in blocks:
        hit = at < len(wanted) and b.text == wanted[at]
        at += hit
        out.append(int(hit))
    return out


def fit(labelled: DataFrame, rounds: int = ROUNDS) -> Crf:
    """Weights from labelled pages (html, text: main blocks joined by two line feeds)."""
    model = Crf()
    for turn in range(rounds):
        start = model.vector.copy()

        def trained(batch, start=start, turn=turn):
            own = Crf(start.copy())
            pages = []
            for page, text in zip(batch.column("html").to_pylist(), batch.column("text").to_pylist()):
                if blocks := leaf_blocks(page or ""):
                    pages.append((features(blocks), within(blocks), block_labels(blocks, text or "")))
            rng = np.random.default_rng(turn)
            for epoch in range(EPOCHS):
                for i in rng.permutation(len(pages)):
                    own.step(*pages[i], RATE / (1 + turn * EPOCHS + epoch) ** 0.5)
            return np.r_[own.vector * len(pages), len(pages)]

        total = summed(labelled.select("html", "text"), trained)
        if not len(total) or not total[-1]:
            return model
        model = Crf(total[:-1] / total[-1])
    return model


def main_text(page: str, model: Crf) -> str:
    """Blocks that the model takes for main text, joined by two line feeds."""
    blocks = leaf_blocks(page)
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, y in zip(blocks, model.decode(features(blocks), within(blocks))) if y)


def extract(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    small_batches(pages.sparkSession)
    model = fit(labelled)
    sent = pages.sparkSession.sparkContext.broadcast(model.vector)

    def run(batches):
        own = Crf(sent.value)
        for batch in batches:
            texts = [main_text(p or "", own) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                names=["page_id", "url", "text"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn(
        "n_chars", F.length("text").cast("long")
    )
