"""Operator 4, HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is read into text blocks: text between block-level tags, inline tags leaving it whole. Each block has features of its
ancestors (tags, words of their class, id and role) and of its text (length, links, punctuation); labels are main text or
not. The field is trained on pages made and labelled by html_pages.py and decoded by Viterbi. Blocks labelled main, character
references decoded and white space folded, joined by blank lines, are the page's text. Nothing else is dropped or cut.

Never text: comments, scripts, styles, templates, head elements, form fields and their options. Reading never fails and takes time in
proportion to the page, however malformed: a stray '<' is text, unclosed elements end with their parent or the page, unknown tags
are inline. A head without an end tag ends at <body> or at the first tag or text that can't stand in it. If a quote in a tag
never closes, that tag and those after it end at the next '>', whatever quotes say.

Edge cases: null or empty html gives ''; equal pages give equal texts; a page without markup is one block.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_pages import MARK, labelled_pages

WIDTH = 1 << 14
ROUNDS = 160

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option select textarea".split())
RAW = frozenset("script style template noscript iframe object svg math head title select textarea option button datalist".split())
#: Raw text up to the end tag: markup in it doesn't count.
OPAQUE = frozenset("script style title textarea iframe".split())
#: What can stand in a head; its end tag may be left out, so anything else ends it.
HEAD = frozenset("html head base basefont bgsound link meta title style script noscript template".split())
#: An opening tag on the left ends an open element on the right.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK - {"body", "html", "button", "label", "legend", "option", "select", "textarea", "caption"}
#: No element ends beyond these when a tag within them is closed by another.
WALLS = frozenset("div article section main aside nav header footer form table td th ul ol body blockquote".split())

OPENING = re.compile(r"/?([a-zA-Z][^\s/>]*)")
MARKS = re.compile("[>\"']")
VALUE = re.compile(r"=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME = re.compile(r"[a-z]+")
HOLDERS = frozenset("article main aside nav header footer form section table".split())
#: Distinct paths that are kept for the next pages.
PATHS = 20_000


class Node:
    """An open element with all that hold it: a path from the root. Equal paths are one object, with their features."""

    __slots__ = ("_slots", "children", "holders", "outer", "parent", "tag", "top", "words")

    def __init__(self, tag: str, words: frozenset[str], parent: Node | None):
        self.tag, self.words, self.parent = tag, words, parent
        self.children: dict[tuple[str, frozenset[str]], Node] = {}
        self._slots: tuple[frozenset[int], bool] | None = None
        outer, holders, self.top = (parent.outer, parent.holders, parent.top) if parent else ((), (), "")
        if tag in BLOCK and tag not in ("html", "body"):
            outer, self.top = (*outer[-1:], tag), self.top or tag
        self.outer, self.holders = outer, (*holders[-1:], tag) if tag in HOLDERS else holders

    def inherited(self) -> tuple[frozenset[int], bool]:
        """Features of all elements on the path, and whether any has words; WIDTH features at most."""
        todo, node = [], self
        while node._slots is None and node.parent is not None:
            todo.append(node)
            node = node.parent
        slots, any_words = node._slots or (frozenset(), False)
        for n in reversed(todo):
            own = {_slot(f"in {n.tag}"), *(_slot(f"word {w}") for w in n.words)}
            slots = slots if own <= slots else slots | own
            any_words = any_words or bool(n.words)
            n._slots = slots, any_words
        return slots, any_words

    def features(self) -> list[int]:
        slots, any_words = self.inherited()
        names = ["bias", f"own {self.outer[-1] if self.outer else ''}", f"pair {' '.join(self.outer)}", f"top {self.top}", f"holders {' '.join(self.holders)}"]
        return [*slots, *(_slot(x) for x in names + ["no words"] * (not any_words))]


class Paths:
    """The tree of known paths; dropped when it has grown to PATHS."""

    def __init__(self) -> None:
        self.root, self.many = Node("", frozenset(), None), 0

    def fresh(self) -> Node:
        if self.many > PATHS:
            self.__init__()
        return self.root

    def below(self, node: Node, tag: str, words: frozenset[str]) -> Node:
        if (child := node.children.get((tag, words))) is None:
            child = node.children[tag, words] = Node(tag, words, node)
            self.many += 1
        return child


_paths = Paths()


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, path: Node, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def attributes(text: str) -> frozenset[str]:
    """Words of class, id and role, and whether the element is hidden."""
    names, at = set(), 0
    for m in VALUE.finditer(text):
        key = text[at : m.start()].lower().split()[-1:]
        value, at = m[1] or m[2] or m[3] or "", m.end()
        if key in (["class"], ["id"], ["role"]):
            names.update(w for w in NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()) if len(w) > 1)
        elif key == ["aria-hidden"] and value == "true" or key == ["style"] and "display:none" in value.replace(" ", ""):
            names.add("HIDDEN")
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", text):
        names.add("HIDDEN")
    return frozenset(names)


def markup(page: str) -> Iterator[tuple[str, str, str, int]]:
    """Text and tags of a page in order, in one pass: (text, "", "", end) or ("", "/name" or "name", attributes, end). Comments,
    declarations and instructions are left out. The reader may send a place to go on from."""
    at, text, n = 0, 0, len(page)
    last, quotes = page.rfind(">"), True
    while True:
        at = page.find("<", at)
        if at < 0 or at > last:
            break
        began, end, m = at, -1, None
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = n if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1
        elif m := OPENING.match(page, at + 1):
            end = m.end()
            while quotes and (mark := MARKS.search(page, end)) and mark[0] != ">":
                end = page.find(mark[0], mark.end()) + 1
                quotes = end > 0
            if quotes and mark is None:
                quotes = False
            end = mark.end() if quotes else page.find(">", m.end()) + 1
        else:
            at += 1
            continue
        if began > text:
            yield page[text:began], "", "", began
        at = text = end
        if m:
            go = yield "", m[0], page[m.end() : end - 1], end
            if go is not None:
                at = text = go
    if text < n:
        yield page[text:], "", "", n


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with the elements that hold them."""
    out: list[Block] = []
    node = _paths.fresh()
    stack: list[Node] = []
    places: dict[str, list[int]] = {}  # of each tag in the stack
    walls: list[int] = []
    tight: list[int] = []  # walls but table cells
    raw = links = linked = 0
    parts: list[str] = []

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(node, text, linked))
            parts.clear()
        linked = 0

    def push(tag: str, words: frozenset[str]) -> None:
        nonlocal raw, links, node
        places.setdefault(tag, []).append(len(stack))
        if tag in WALLS:
            walls.append(len(stack))
            if tag not in ("td", "th"):
                tight.append(len(stack))
        node = _paths.below(node, tag, words)
        stack.append(node)
        raw += tag in RAW
        links += tag == "a"

    def pop(upto: int) -> None:
        nonlocal raw, links, node
        if any(x.tag in BLOCK for x in stack[upto:]):
            flush()
        for x in reversed(stack[upto:]):
            places[x.tag].pop()
            raw -= x.tag in RAW
            links -= x.tag == "a"
        del stack[upto:]
        for some in (walls, tight):
            while some and some[-1] >= upto:
                some.pop()
        node = stack[-1] if stack else _paths.root

    def last(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else -1

    def text(t: str) -> None:
        nonlocal linked
        if stack and stack[-1].tag == "head" and t.strip():
            pop(places["head"][0])
        if not raw and t:
            parts.append(t)
            if links:
                linked += len(t)

    pieces, go = markup(page), None
    while True:
        try:
            t, tag, inside, at = pieces.send(go)
        except StopIteration:
            break
        go = None
        if not tag:
            text(t)
            continue
        tag = tag.lower()
        if tag[0] == "/":
            tag = tag[1:]
            k = last(tag)
            if k >= 0 and (tag in WALLS or not walls or k > walls[-1]):
                pop(k)
            continue
        if raw and tag not in HEAD and last("head") >= 0 and (stack[-1].tag == "head" or tag == "body" and last("template") < 0):
            pop(places["head"][0])
        if tag == "br":
            text(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCK:
            flush()
            ended = ENDS.get(tag, frozenset()) | ({"p"} if tag in CLOSES_P else frozenset())
            while ended and (k := max(map(last, ended))) > (tight[-1] if tight else -1):
                pop(k)
                if tag != "tr":
                    break
        if tag in OPAQUE:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            go = end.end() if end else len(page)
            continue
        tail = inside.split()[-1:]
        if tail and tail[0].endswith("/") and ("=" not in tail[0] or tail[0][-2:-1] in "\"'") and tag not in BLOCK:
            continue  # closes itself; the slash of href=/ is a value
        push(tag, attributes(inside))
    flush()
    return out


@functools.lru_cache(maxsize=200_000)
def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % WIDTH


def features(block: Block, text: str) -> list[int]:
    n = len(text)
    count = text.count(" ") + 1
    names = [
        f"chars {min(n.bit_length(), 11)}",
        f"words {min(count.bit_length(), 8)}",
        f"linked {min(int(4 * block.linked / max(n, 1)), 4)}",
        f"ends {text[-1] in '.!?:;\"'}",
        f"capital {text[0].isupper()}",
        f"sentences {min(text.count('. '), 3)}",
        f"bars {'|' in text or '·' in text or '»' in text}",
        f"rights {'©' in text}",
        f"linked {min(int(4 * block.linked / max(n, 1)), 4)} own {block.path.tag}",
    ]
    return [*block.path.features(), *map(_slot, names)]


class Chain:
    """Weights: emission[feature, label], transition[label, next label], start[label]. Label 1 is main text."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray, start: np.ndarray):
        self.emission, self.transition, self.start = emission, transition, start

    def decode(self, rows: list[list[int]]) -> list[int]:
        """Viterbi; ties go to label 0."""
        (a00, a01), (a10, a11) = self.transition.tolist()
        back: list[tuple[int, int]] = []
        b0, b1 = self.start.tolist()
        for k, row in enumerate(rows):
            e0, e1 = self.emission[row].sum(axis=0).tolist()
            if k:
                to0, to1 = (b0 + a00, b1 + a10), (b0 + a01, b1 + a11)
                back.append((int(to0[1] > to0[0]), int(to1[1] > to1[0])))
                b0, b1 = max(to0), max(to1)
            b0, b1 = b0 + e0, b1 + e1
        if not rows:
            return []
        labels = [int(b1 > b0)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def extract(page: str | None, chain: Chain) -> str:
    found = blocks(page or "")
    labels = chain.decode([features(b, b.text) for b in found])
    return "\n\n".join(b.text for b, y in zip(found, labels, strict=True) if y)


def train(pages: list[str]) -> Chain:
    """Maximum likelihood by Adam; forward and backward sums run over all pages at once."""
    rows, labels, sizes = [], [], []
    for p in pages:
        got = [(b, t, y) for b in blocks(p) if (t := " ".join(b.text.replace(MARK, "").split())) for y in [int(MARK in b.text)]]
        sizes.append(len(got))
        rows += [features(b, t) for b, t, _ in got]
        labels += [y for _, _, y in got]
    steps, many = max(sizes), len(sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])
    flat, owner = np.concatenate([np.array(r) for r in rows]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    page_of, step_of = np.repeat(np.arange(many), sizes), np.concatenate([np.arange(s) for s in sizes])
    y = np.array(labels)
    live = np.arange(steps)[:, None] < np.array(sizes)[None, :]
    same = np.ones(len(y), bool)
    same[first[1:][first[1:] < len(y)]] = False
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[:-1][same[1:]], y[1:][same[1:]]), 1)
    begun = np.bincount(y[first[:-1][np.array(sizes) > 0]], minlength=2)
    seen = np.stack([np.bincount(flat, weights=(y[owner] == c), minlength=WIDTH) for c in (0, 1)], axis=1)
    theta = np.zeros(WIDTH * 2 + 6)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    log_sum = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    for t in range(1, ROUNDS + 1):
        emission, transition, start = theta[: WIDTH * 2].reshape(WIDTH, 2), theta[-6:-2].reshape(2, 2), theta[-2:]
        score = np.stack([np.bincount(owner, weights=emission[flat, c], minlength=len(y)) for c in (0, 1)], axis=1)
        grid = np.zeros((steps, many, 2))
        grid[step_of, page_of] = score
        ahead, behind = np.zeros_like(grid), np.zeros_like(grid)
        ahead[0] = grid[0] + start
        for k in range(1, steps):
            ahead[k] = np.where(live[k][:, None], log_sum(ahead[k - 1][:, :, None] + transition, 1) + grid[k], ahead[k - 1])
        for k in range(steps - 2, -1, -1):
            behind[k] = np.where(live[k + 1][:, None], log_sum(transition + (grid[k + 1] + behind[k + 1])[:, None, :], 2), 0.0)
        total = log_sum(ahead[-1], 1)
        mean = np.exp(ahead + behind - total[None, :, None])[step_of, page_of]
        both = ahead[:-1, :, :, None] + transition + (grid[1:] + behind[1:])[:, :, None, :] - total[None, :, None, None]
        g = np.concatenate([
            (seen - np.stack([np.bincount(flat, weights=mean[owner, c], minlength=WIDTH) for c in (0, 1)], axis=1)).ravel(),
            (pairs - np.exp(both)[live[1:]].sum(axis=0)).ravel(),
            begun - np.exp(ahead[0] + behind[0] - total[:, None]).sum(axis=0),
        ]) - 0.3 * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta = theta + 0.08 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    return Chain(theta[: WIDTH * 2].reshape(WIDTH, 2), theta[-6:-2].reshape(2, 2), theta[-2:])


@functools.cache
def default_chain() -> Chain:
    """Trained on the labelled pages; the same each time, and once in a process."""
    return train(labelled_pages())


def save(chain: Chain, spark: SparkSession, folder: str) -> None:
    """Keeps a trained field as a small table, so that later jobs needn't train it."""
    parts = [(n, getattr(chain, n).ravel().tolist()) for n in ("emission", "transition", "start")]
    spark.createDataFrame(parts, "name string, weights array<double>").coalesce(1).write.mode("overwrite").parquet(folder)


def load(spark: SparkSession, folder: str) -> Chain:
    rows = {r["name"]: np.array(r["weights"]) for r in spark.read.parquet(folder).collect()}  # three rows of fixed size
    return Chain(rows["emission"].reshape(WIDTH, 2), rows["transition"].reshape(2, 2), rows["start"])


def main_text(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row; no shuffle. Other columns are ignored."""
    shared = pages.sparkSession.sparkContext.broadcast(chain or default_chain())  # 2 * WIDTH numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(p, shared.value) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)
    return pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html")).mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
