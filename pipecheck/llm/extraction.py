"""Main text of web pages by a recurrent labeller of their blocks (operator 2)."""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipecheck.llm.common import hash_cut, hash_order, table, with_fields, without

# How HTML tags behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong"
    " sub sup time tt u var wbr".split()
)
HIDDEN = frozenset("script style template noscript head title svg math iframe object canvas textarea select option audio video".split())
# Tags and names of containers that the training pages are labelled by.
BOILER_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
BOILER_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert advertisement banner sponsor promo"
    " cookie cookies consent notice popup modal newsletter subscribe signup share social related recommended comment comments reply widget"
    " tags pagination pager login search copyright".split()
)
MAIN_TAGS = frozenset(("article", "main"))
MAIN_NAMES = ("content", "article", "post", "entry", "story", "main", "text")

# Sizes of the vectors and of the hidden state of each direction.
PATH, WORDS, MORE, HIDDEN_SIZE = 257, 48, 3, 24
# The labeller learns from so many pages of the smallest hash, each of at most so many characters and blocks.
SAMPLE_PAGES, SAMPLE_CHARS, SAMPLE_BLOCKS = 160, 40000, 120
EPOCHS, BATCH, RATE = 14, 32, 0.01

# A comment; the start of a tag up to its first quote or to its end; anything else in tag brackets.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)[^<>\"']*+(>)?|<[!?/][^<>]*+>", re.S)
_PLAIN = re.compile(r"[^<>\"']*+")
_BRACKETS = re.compile(r"<[^<>]*+>")
_CUT_OFF = re.compile(r"<[a-zA-Z!?/][^<>]*+\Z")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)
_PART = re.compile(r"[a-z]+")

# Attributes by which a browser does not show an element.
_UNSEEN = re.compile(r"\bstyle\s*=\s*(?:\"[^\"]*?|'[^']*?)\bdisplay\s*:\s*none\b|(?:^|\s)hidden(?=[\s=/]|$)", re.I)


class Path:
    """The open tags around a block, with the words of their names, from the root on.

    Each step knows its parent and what its parent knows of the vector and of the kinds of containers above, so a path of any depth costs as
    much as its last step. ``step`` gives the same object for the same child, so blocks beside each other share theirs.
    """

    __slots__ = ("boiler", "leaf", "main", "names", "parent", "slots", "steps", "tag")

    def __init__(self, parent: Path | None = None, tag: str = "", names: tuple[str, ...] = ()):
        self.parent, self.tag, self.names, self.steps = parent, tag, names, {}
        if parent is None:
            self.slots, self.leaf, self.boiler, self.main = frozenset(), -1, False, False
            return
        own = {_slot(feature, PATH - 1) for feature in (tag, *(f".{n}" for n in names))}
        self.slots = parent.slots if own <= parent.slots else parent.slots | own
        self.leaf = _slot(f"leaf {tag}", PATH - 1)
        self.boiler = parent.boiler or tag in BOILER_TAGS or not BOILER_NAMES.isdisjoint(names)
        self.main = parent.main or tag in MAIN_TAGS

    @classmethod
    def of(cls, steps) -> Path:
        path = cls()
        for tag, names in steps:
            path = path.step(tag, names)
        return path

    def step(self, tag: str, names: tuple[str, ...] = ()) -> Path:
        if (tag, names) not in self.steps:
            self.steps[tag, names] = Path(self, tag, names)
        return self.steps[tag, names]

    def __iter__(self):
        out, at = [], self
        while at.parent is not None:
            out.append((at.tag, at.names))
            at = at.parent
        return reversed(out)

    def __getitem__(self, k):
        return tuple(self)[k]

    def __eq__(self, other) -> bool:
        return tuple(self) == tuple(other)

    __hash__ = None

    @property
    def key(self) -> tuple[frozenset[int], int, bool]:
        """What the vector of the path depends on: few values, however many paths a page has."""
        return self.slots, self.leaf, self.boiler


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """Where the > of the tag stands whose attributes go on at ``at``, > in quotes aside; -1 if another tag or the end comes first.

    ``dead`` keeps the opening quotes, over the whole page, from which no end was found: none is tried twice, so the time is linear in the
    page, however long, many or open its quotes are.
    """
    seen: list[int] = []
    while (at := _PLAIN.match(page, at).end()) < len(page) and page[at] != "<" and at not in dead:
        if page[at] == ">":
            return at
        seen.append(at)
        close = page.find(page[at], at + 1)
        if close < 0:
            break
        at = close + 1
    dead.update(seen)
    return -1


def _next_tag(page: str, at: int, dead: set[int]) -> tuple[int, int, str, str | None, str] | None:
    """Start, end, slash, name and attributes of the next tag or comment from ``at`` on; comments and what has no end as a tag have no name."""
    while tag := _TAG.search(page, at):
        if tag[2] is None:
            return tag.start(), tag.end(), "", None, ""
        end = tag.end() - 1 if tag[3] else _tag_end(page, tag.end(), dead)
        if end >= 0:
            return tag.start(), end + 1, tag[1], tag[2], page[tag.end(2) : end]
        if brackets := _BRACKETS.match(page, tag.start()):
            return tag.start(), brackets.end(), "", None, ""
        at = tag.start() + 1
    return None


def leaves(page: str | None) -> list[tuple[Path, str, float]]:
    """Path, text and share of linked characters of every block with text, in page order.

    A block is the text between two tags that are not inline. Its path lists the open tags with the words of their
    class, id and role. Texts have their character references decoded and one space for any white space. What browsers
    do not show as text (scripts, styles, comments, the head, elements with ``hidden`` or ``display: none``, a tag cut off at the end) is in no
    block. Tags left open end with the element around them. Time is linear in the page, however deep its tags are nested.
    """
    out: list[tuple[Path, str, float]] = []
    stack = [Path()]
    # How often each tag is open: an end tag without a beginning is not looked for.
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        raw = "".join(parts)
        text = " ".join(entities.unescape(raw).split())
        if text:
            out.append((stack[-1], text, min(1.0, linked / len(raw))))
        parts.clear()
        linked = 0

    # Size of the stack within the outermost element that is not shown; 0 outside.
    unseen = 0

    def leave() -> str:
        nonlocal unseen
        if len(stack) == unseen:
            unseen = 0
        gone = stack.pop().tag
        opened[gone] -= 1
        return gone

    page, at, links = page or "", 0, 0
    dead: set[int] = set()
    while at < len(page):
        tag = _next_tag(page, at, dead)
        text = page[at : tag[0]] if tag else _CUT_OFF.sub("", page[at:])
        if text and not unseen:
            parts.append(text)
            linked += len(text) if links else 0
        if not tag:
            break
        _, at, slash, name, attributes = tag
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            links = 0 if slash else 1
        if name in INLINE:
            if name in ("br", "img"):
                parts.append(" ")
            continue
        flush()
        if slash:
            while opened[name]:
                if leave() == name:
                    break
            continue
        if name in HIDDEN and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        # A block tag ends an open paragraph, an item ends the item before it.
        for closes in ("p", name if name in ("li", "td", "th", "tr", "dt", "dd", "option") else "p"):
            if stack[-1].tag == closes:
                leave()
        if name not in VOID:
            names = tuple(_PART.findall(" ".join(_NAMES.findall(attributes)).lower())) if attributes.strip() else ()
            opened[name] += 1
            stack.append(stack[-1].step(name, names))
            if not unseen and attributes and _UNSEEN.search(attributes):
                unseen = len(stack)
    flush()
    return out


def _slot(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % size


def path_vector(path: Path) -> np.ndarray:
    """Tags and names on a path, hashed; the tag of the block itself once more; last, whether any container names itself as no main text."""
    v = np.zeros(PATH, dtype=np.float32)
    v[list(path.slots)] = 1
    v[-1] = path.boiler
    if path.leaf >= 0:
        v[path.leaf] = 1
    return v


def word_vector(text: str, linked: float) -> np.ndarray:
    """Hashed words of a block as shares, its length, its linked share and its share of sentence ends."""
    words = text.lower().split()
    v = np.zeros(WORDS + MORE, dtype=np.float32)
    v[:WORDS] = np.bincount([_slot(w, WORDS) for w in words], minlength=WORDS)
    v[:WORDS] /= len(words)
    v[WORDS:] = np.log1p(len(words)) / 4, linked, sum(w[-1] in ".!?:;" for w in words) / len(words)
    return v


class Labeller:
    """A bidirectional LSTM that gives every block of a page its probability of being main text."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        size, h = PATH + WORDS + MORE, HIDDEN_SIZE
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = rng.normal(0, 0.1, (size, 4 * h)).astype(np.float32)
            self.w[f"h{d}"] = rng.normal(0, 0.2, (h, 4 * h)).astype(np.float32)
            bias = np.zeros(4 * h, dtype=np.float32)
            bias[h : 2 * h] = 1  # remember at first
            self.w[f"b{d}"] = bias
        self.w["out"] = rng.normal(0, 0.2, 2 * h).astype(np.float32)
        self.w["bias"] = np.zeros(1, dtype=np.float32)

    def _run(self, drive: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States of one direction; ``drive`` [time, page, 4h] is what the inputs add, with the bias."""
        steps, pages, _ = drive.shape
        n = HIDDEN_SIZE
        h, c = np.zeros((pages, n), dtype=np.float32), np.zeros((pages, n), dtype=np.float32)
        states, tape = np.zeros((steps, pages, n), dtype=np.float32), []
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        for t in order:
            z = drive[t] + h @ self.w[f"h{d}"]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * n], -30, 30)))
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            g = np.tanh(z[:, 3 * n :])
            m = mask[t][:, None]
            c_new = f * c + i * g
            squashed = np.tanh(c_new)
            if keep:
                tape.append((t, h, c, i, f, o, g, squashed, m))
            h = m * (o * squashed) + (1 - m) * h
            c = m * c_new + (1 - m) * c
            states[t] = h
        return states, tape

    def _drive(self, x: np.ndarray, d: str) -> np.ndarray:
        return x @ self.w[f"x{d}"] + self.w[f"b{d}"]

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], seed: int = 1) -> None:
        """Learn from pages of (vectors, labels) by back-propagation through time, with Adam."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), BATCH):
                step += 1
                for k, g in self._gradients([pages[i] for i in order[at : at + BATCH]]).items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    rise = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                    self.w[k] = (self.w[k] - RATE * rise).astype(np.float32)

    def _gradients(self, batch) -> dict[str, np.ndarray]:
        x, mask = padded([v for v, _ in batch])
        y = np.zeros(mask.shape, dtype=np.float32)
        for k, (_, labels) in enumerate(batch):
            y[: len(labels), k] = labels
        runs = {d: self._run(self._drive(x, d), mask, d, True) for d in "fb"}
        states = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        p = 1 / (1 + np.exp(-np.clip(states @ self.w["out"] + self.w["bias"], -30, 30)))
        error = (p - y) * mask / mask.sum()
        grads = {"out": np.einsum("tp,tph->h", error, states), "bias": np.array([error.sum()])}
        n = HIDDEN_SIZE
        back = error[:, :, None] * self.w["out"]
        for d, part in (("f", back[:, :, :n]), ("b", back[:, :, n:])):
            dz_all = np.zeros((*mask.shape, 4 * n), dtype=np.float32)
            grad_h = np.zeros_like(self.w[f"h{d}"])
            dh, dc = np.zeros_like(part[0]), np.zeros_like(part[0])
            for t, h, c, i, f, o, g, squashed, m in reversed(runs[d][1]):
                dh = dh + part[t]
                through = m * dh
                dc_new = m * dc + through * o * (1 - squashed**2)
                dz = np.concatenate(
                    [dc_new * g * i * (1 - i), dc_new * c * f * (1 - f), through * squashed * o * (1 - o), dc_new * i * (1 - g**2)], axis=1
                )
                dz_all[t] = dz
                grad_h += h.T @ dz
                dh = (1 - m) * dh + dz @ self.w[f"h{d}"].T
                dc = (1 - m) * dc + dc_new * f
            flat = dz_all.reshape(-1, 4 * n)
            grads[f"x{d}"] = x.reshape(-1, x.shape[2]).T @ flat
            grads[f"h{d}"] = grad_h
            grads[f"b{d}"] = flat.sum(axis=0)
        return grads

    def label(self, pages: list[list[tuple[Path, str, float]]], padded_blocks: int = 8192) -> list[np.ndarray]:
        """Probability of every block of every page; pages of like length run together."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
        while order:
            longest = len(pages[order[-1]])
            group = [order.pop() for _ in range(min(len(order), max(1, padded_blocks // longest)))]
            mask = np.zeros((longest, len(group)), dtype=np.float32)
            drive = {d: np.zeros((longest, len(group), 4 * HIDDEN_SIZE), dtype=np.float32) for d in "fb"}
            for at, k in enumerate(group):
                # Paths look alike: each kind is multiplied once.
                own: dict[tuple, tuple[int, Path]] = {}
                for path, _, _ in pages[k]:
                    own.setdefault(path.key, (len(own), path))
                paths = np.stack([path_vector(path) for _, path in own.values()])
                which = [own[path.key][0] for path, _, _ in pages[k]]
                words = np.stack([word_vector(text, linked) for _, text, linked in pages[k]])
                mask[: len(which), at] = 1
                for d in "fb":
                    w = self.w[f"x{d}"]
                    drive[d][: len(which), at] = (paths @ w[:PATH])[which] + words @ w[PATH:] + self.w[f"b{d}"]
            states = np.concatenate([self._run(drive[d], mask, d, False)[0] for d in "fb"], axis=2)
            p = 1 / (1 + np.exp(-np.clip(states @ self.w["out"] + self.w["bias"], -30, 30)))
            for at, k in enumerate(group):
                out[k] = p[: len(pages[k]), at]
        return out


def padded(vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(v) for v in vectors)
    x = np.zeros((steps, len(vectors), vectors[0].shape[1]), dtype=np.float32)
    mask = np.zeros((steps, len(vectors)), dtype=np.float32)
    for k, v in enumerate(vectors):
        x[: len(v), k] = v
        mask[: len(v), k] = 1
    return x, mask


def is_boiler(path: Path) -> bool:
    return path.boiler


def is_main(path: Path) -> bool:
    return path.main and not path.boiler


def training_pages(blocks: list[list[tuple[Path, str, float]]], seed: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of sample pages and of three altered copies of each.

    A block is labelled main text if it is in an article or main element and in no container that names itself a menu, header, footer,
    sidebar, notice, advert, form or comments. Copies give the article another container, of any name or
    none, and add groups of blocks under such names, before, within and after it, with texts of other pages, so that the labeller learns the
    names that these pages happen not to use, and to do without a name for the main text.
    """
    rng = np.random.default_rng(seed)
    texts = [text for page in blocks for _, text, _ in page]
    names = sorted(BOILER_NAMES)

    def letters() -> str:
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(1, 9)))

    def group(inside: tuple) -> list[tuple[tuple, str, float]]:
        tag = str(rng.choice(sorted(BOILER_TAGS))) if rng.random() < 0.25 else str(rng.choice(["div", "ul", "section", "p"]))
        own = () if tag in BOILER_TAGS and rng.random() < 0.5 else (str(rng.choice(names)),)
        if own and rng.random() < 0.5:
            own = (str(rng.choice([*MAIN_NAMES, letters()])), *own)
        leaf = ((tag, own), (str(rng.choice(["p", "li", "div", "h3"])), ())) if rng.random() < 0.7 else ((tag, own),)
        chosen = [texts[rng.integers(len(texts))] for _ in range(rng.integers(1, 6))]
        cut = [" ".join(t.split()[: rng.integers(1, 40)]) for t in chosen]
        return [(inside + leaf, t, float(rng.random() < 0.3)) for t in cut]

    def container() -> tuple:
        kind = rng.random()
        if kind < 0.15:
            return (("main", ()),)
        if kind < 0.5:
            return (("div", (str(rng.choice(MAIN_NAMES)),)),)
        if kind < 0.6:
            return (("article", ()), ("div", (str(rng.choice(MAIN_NAMES)),)))
        # Names that say nothing, or none.
        own = () if rng.random() < 0.4 else tuple(letters() for _ in range(rng.integers(1, 3)))
        return ((str(rng.choice(["div", "section", "td", "center", "body"])), own),)

    def altered(page):
        new = container()
        wrap = (("div", (str(rng.choice(["page", "wrapper", "container", "site", letters()])),)),) if rng.random() < 0.5 else ()
        rows = []
        for path, text, linked in page:
            changed = tuple(x for e in path for x in (new if e[0] in MAIN_TAGS else (e,)))
            rows.append((wrap + changed, text, linked, is_main(path)))
        inner = [k for k, r in enumerate(rows) if r[3]]
        for k in range(rng.integers(2, 6)):
            # One group at least stands within the main text.
            at = int(rng.choice(inner)) + 1 if k == 0 else int(rng.integers(len(rows) + 1))
            within = at < len(rows) and rows[at][3] and at != inner[0]
            inside = rows[at][0][:-1] if within else wrap + (("body", ()),)
            rows[at:at] = [(*b, False) for b in group(inside)]
            inner = [k for k, r in enumerate(rows) if r[3]]
        return rows

    out = []
    for page in blocks:
        for rows in ([(*b, is_main(b[0])) for b in page], altered(page), altered(page), altered(page)):
            x = np.stack([np.concatenate([path_vector(p if isinstance(p, Path) else Path.of(p)), word_vector(t, a)]) for p, t, a, _ in rows])
            out.append((x, np.array([m for *_, m in rows], dtype=np.float32)))
    return out


def _teaches(blocks: list[tuple[Path, str, float]]) -> bool:
    return len(blocks) <= SAMPLE_BLOCKS and any(is_main(path) for path, _, _ in blocks)


def training_sample(pages: DataFrame) -> list[str]:
    """The SAMPLE_PAGES different pages of the smallest hash that can teach; all if there are fewer, wherever they stand.

    A page can teach if it has main text by its article or main elements and is within the bounds of characters and blocks. The cut
    by hash is among pages that name such an element, and is widened as long as too few of it can teach.
    """
    named = pages.select("html").filter(F.length("html").between(1, SAMPLE_CHARS) & F.lower("html").rlike("<(article|main)"))

    def teaching(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[_teaches(leaves(page)) for page in batch["html"]]]

    rows, most = named.count(), SAMPLE_PAGES
    while True:
        found = hash_cut(named, "html", rows, most).mapInPandas(teaching, "html string").distinct()
        sample = found.orderBy(hash_order("html")).limit(SAMPLE_PAGES).collect()  # the bound of the sample
        if len(sample) == SAMPLE_PAGES or 8 * most >= rows:
            return [r["html"] for r in sample]
        most *= 8


def fit_labeller(pages: DataFrame) -> Labeller | None:
    """A labeller trained on SAMPLE_PAGES of ``pages`` (html); none if no page at all can teach (training_sample)."""
    blocks = [leaves(page) for page in training_sample(pages)]
    if not blocks:
        return None
    labeller = Labeller()
    labeller.fit(training_pages(blocks))
    return labeller


def extract_text(pages: DataFrame, labeller: Labeller | None) -> DataFrame:
    """The columns of ``pages`` (html needed) and text, n_chars: the main blocks of the whole page joined by a line feed.

    Null and empty pages and pages without main text have an empty text. Pages are read where they lie and nothing is shuffled. Without a labeller,
    blocks outside of named containers for menus, adverts and the like are taken. Clashing columns are replaced.
    """
    rest = without(pages, ["text", "n_chars"])

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            blocks = [leaves(page) for page in batch["html"]]
            main = labeller.label(blocks) if labeller else [np.array([not is_boiler(p) for p, _, _ in b], dtype=float) for b in blocks]
            texts = ["\n".join(b[1] for b, p in zip(page, own, strict=True) if p >= 0.5) for page, own in zip(blocks, main, strict=True)]
            yield batch.assign(text=texts, n_chars=[len(t) for t in texts])

    return rest.mapInPandas(extracted, with_fields(rest, "text string, n_chars long"))


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages, fit_labeller(pages)).select("page_id", "url", "text", "n_chars")


QUERIES = {"op2_html_text": (op2_html_text, None)}
