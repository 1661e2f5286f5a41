"""Main text of web pages by a recurrent block labeller.

A page becomes its leaf sequence: one entry per text block with the tag path (tags, class and id words of
all ancestors) and all of the block's words, both hashed into fixed vectors.  A bidirectional LSTM in numpy reads
the whole sequence and labels every block as article or not, so a block is judged with the rest of the
page in view.  It is trained once, on about ``train_pages`` pages picked by hash: a teacher labels their
blocks from sectioning tags and class words, and each page is also seen with its containers renamed and
with boilerplate sections mixed in; ``made`` made-up pages join them.  For every such page ``sites`` pages of made-up
sites are told in the same words: articles with headings in headers, quotes, lists, tables and captions among menus, notices,
adverts, sidebars and readers' comments, in sectioning tags or plain containers, with usual, unknown or no class names.
Every block of every page is then labelled by the network.

Null or empty html gives the empty text.  Character references are decoded, white space inside a block is
one space, blocks are joined in page order by one newline; nothing else is dropped or capped.  Repeated
pages are treated alike; an empty table gives none.  Without any page to learn from, the network is
trained on the made-up ones alone.
"""

from __future__ import annotations

import bisect
import html as _html
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.fitting import below, fit_once
from tallyfold.llm.rows import column, map_rows, text_bytes
from tallyfold.llm.tokens import LOWER, NOT_SPACE, U64, per_text, prefix_hash, range_hash, runs

RAW = re.compile(r"<(script|style)(?=[\s/>])", re.IGNORECASE)
RAW_END = {n: re.compile(rf"</{n}\s*>", re.IGNORECASE) for n in ("script", "style")}
OPEN = re.compile(r"<[/!?]?[a-zA-Z]")
SPECIAL = re.compile(r"[>\"']")
# Elements that are left out as far as their own end tag; a tag without one is left out alone.
HIDDEN_TAGS = frozenset("noscript template svg iframe object".split())
HIDES = re.compile(r"<(?:noscript|template|svg|iframe|object)(?=[\s/>])", re.IGNORECASE)
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
WORDS = re.compile(r"[a-z0-9]+")
SPACES = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "select summary table tbody td textarea tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"html", "body", "head"}
OUTSIDE = frozenset("nav header footer aside form head title button select option textarea menu dialog fieldset".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert advertisement sponsor sponsored promo banner nav navbar navigation menu sidebar side footer header "
    "masthead breadcrumb breadcrumbs comment comments comentarios kommentare commentaires disqus reply replies share "
    "sharing social cookie cookies consent notice gdpr popup modal newsletter subscribe signup login related "
    "recommended widget toolbar pagination pager search tags copyright legal skip alert".split()
)
INSIDE_WORDS = frozenset("article content main post entry story body text".split())
N_PATH, N_WORD, N_NUM, HIDDEN = 128, 128, 5, 16
PATH_ENDS = 48  # a block's path holds so many outermost and innermost elements at most
WIDTH = N_PATH + N_WORD + N_NUM
STEP_BLOCKS = 16384


def _hash(word: str) -> int:
    h = 2166136261
    for c in word.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) * 2246822519 & 0xFFFFFFFF


def scan(page: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of every piece of a page: ``text``, ``tag``, or ``skip`` (comments, scripts, styles).

    The time is linear but for binary searches: a quote that is known to lead to no end of a tag is not followed
    again, and no search starts where none can succeed.
    """
    marks = [m.start() for m in SPECIAL.finditer(page)]
    ends = [i for i in marks if page[i] == ">"]
    last = ends[-1] if ends else -1
    dead: set[int] = set()

    def next_of(places: list[int], at: int) -> int:
        i = bisect.bisect_left(places, at)
        return places[i] if i < len(places) else -1

    def tag_end(at: int) -> int:
        """Place after the first ``>`` outside quotes, or -1."""
        seen = []
        i = bisect.bisect_left(marks, at)
        while i < len(marks):
            place = marks[i]
            if page[place] == ">":
                return place + 1
            if place in dead:
                break
            seen.append(place)
            close = page.find(page[place], place + 1)
            if close < 0:
                break
            i = bisect.bisect_right(marks, close)
        dead.update(seen)
        return -1

    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            yield at, n, "text"
            return
        if start > at:
            yield at, start, "text"
        at = start + 1
        kind = "text"
        raw = RAW.match(page, start) if start < last else None
        if page.startswith("<!--", start):
            close = page.find("-->", start + 4)
            at, kind = (close + 3 if close >= 0 else n), "skip"
        elif raw:
            close = RAW_END[raw.group(1).lower()].search(page, next_of(ends, raw.end()) + 1)
            at, kind = (close.end() if close else n), "skip"
        elif opened := OPEN.match(page, start):
            end = tag_end(opened.end()) if start < last else -1
            if end < 0:
                # no end outside quotes: as far as the next bracket, if that ends the tag
                other, close = page.find("<", opened.end()), next_of(ends, opened.end())
                if close >= 0 and (other < 0 or close < other):
                    end = close + 1
                elif other < 0:
                    end = n
                elif page[start + 1] in "!?" and close >= 0:
                    end = close + 1
            if end >= 0:
                at, kind = end, "tag"
        elif page[start + 1 : start + 2] in ("!", "?"):
            close = next_of(ends, start + 2)
            if close >= 0:
                at, kind = close + 1, "tag"
        yield start, at, kind


def hidden_spans(page: str, pieces: Sequence[tuple[int, int, str]]) -> dict[int, int]:
    """Start of every hidden element that has an end tag of its own, with the end of that tag."""
    if not HIDES.search(page):
        return {}
    found: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for start, end, kind in pieces:
        tag = TAG.match(page, start, end) if kind == "tag" else None
        name = tag.group(2).lower() if tag else ""
        if name not in HIDDEN_TAGS:
            continue
        stack = opened.setdefault(name, [])
        if not tag.group(1):
            if name != "svg" or not page.endswith("/>", start, end):
                stack.append(start)
        elif stack:
            found[stack.pop()] = end
    return found


def leaves(page: str | None) -> list[tuple[str, tuple[str, ...], float]]:
    """(text, tag path, share of linked characters) of every non-empty block in page order."""
    out: list[tuple[str, tuple[str, ...], float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = total = links = 0

    def flush():
        nonlocal linked, total
        if parts:
            text = SPACES.sub(" ", _html.unescape("".join(parts))).strip()
            if text:
                ends = stack if len(stack) <= 2 * PATH_ENDS else stack[:PATH_ENDS] + stack[-PATH_ENDS:]
                path = tuple(t for _, tokens in ends for t in tokens)
                out.append((text, path, linked / max(1, total)))
            parts.clear()
        linked = total = 0

    def leave(depth: int):
        """Close the elements from ``depth`` on."""
        nonlocal links
        for t, _ in stack[depth:]:
            open_now[t] -= 1
            links -= t == "a"
        del stack[depth:]

    page = page or ""
    open_now: Counter = Counter()
    pieces = list(scan(page))
    hidden = hidden_spans(page, pieces)
    shown = 0
    for start, end, kind in pieces:
        if start < shown or kind == "skip":
            continue
        tok = page[start:end]
        if kind == "text":
            parts.append(tok)
            total += len(tok)
            linked += len(tok) if links else 0
            continue
        tag = TAG.match(tok)
        if not tag:
            continue
        close, name = tag.group(1), tag.group(2).lower()
        if name in HIDDEN_TAGS:
            shown = hidden.get(start, shown)
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name in ("br", "wbr", "img"):
                parts.append(" " if name == "br" else "")
            continue
        block = name in BLOCK
        if block:
            flush()
        if close:
            if open_now[name]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        leave(i)
                        break
                    if not block and stack[i][0] in BLOCK:
                        break
            continue
        if name in CLOSES_P or name in ("li", "td", "th", "tr", "dd", "dt", "option"):
            ends = {"p"} | ({name} if name in ("li", "tr", "option") else {"td", "th"} if name in ("td", "th") else {"dd", "dt"} if name in ("dd", "dt") else set())
            for i in range(len(stack) - 1, -1, -1):
                t = stack[i][0]
                if t in ends:
                    leave(i)
                    break
                if t in BLOCK:
                    break
        if tok.endswith("/>") and not block:
            continue
        tokens = [name]
        for a in MARK.finditer(tok):
            tokens += [f"{name}.{w}" for w in WORDS.findall((a.group(1) or a.group(2) or a.group(3) or "").lower())]
            tokens += ["." + w for w in WORDS.findall((a.group(1) or a.group(2) or a.group(3) or "").lower())]
        stack.append((name, tuple(tokens)))
        open_now[name] += 1
        links += name == "a"
    flush()
    return out


def teacher(path: tuple[str, ...], text: str, linked: float) -> bool:
    """Label of a training block from its containers."""
    # the header of an article holds its headings
    tags = path[: path.index("article")] + tuple(t for t in path if t not in ("header", ".header")) if "article" in path else path
    if any(t in OUTSIDE for t in tags) or any(t[0] == "." and t[1:] in OUTSIDE_WORDS for t in tags):
        return False
    if "article" in path or "main" in path or any(t[0] == "." and t[1:] in INSIDE_WORDS for t in path):
        return True
    return linked < 0.3 and len(text) >= 25


def vectors(blocks: list[tuple[str, tuple[str, ...], float]], paths: dict) -> np.ndarray:
    """One row per block; ``paths`` keeps the path vectors already made in this task."""
    out = np.zeros((len(blocks), WIDTH), np.float32)
    out[:, N_PATH : N_PATH + N_WORD], n_words = word_vectors([b[0] for b in blocks])
    for i, (text, path, linked) in enumerate(blocks):
        v = paths.get(path)
        if v is None:
            v = np.zeros(N_PATH, np.float32)
            for t in path:
                h = _hash(t)
                v[h % N_PATH] += 1 if h >> 16 & 1 else -1
            v = np.clip(v, -2, 2)
            if len(paths) < 20000:
                paths[path] = v
        out[i, :N_PATH] = v
        out[i, N_PATH + N_WORD :] = (np.log1p(len(text)) / 5, linked, np.log1p(n_words[i]) / 3, text[-1] in ".!?", i == 0)
    return out


def word_vectors(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the hashed lower-case words of every text in ``N_WORD`` bins, and the numbers of words."""
    raw, off = text_bytes(pa.array(texts, pa.string()))
    raw = LOWER[raw]
    starts, ends, text = runs(NOT_SPACE[raw], off)
    bins = (range_hash(prefix_hash(raw), starts, ends) % U64(N_WORD)).astype(np.int64)
    counts = per_text(text * N_WORD + bins, len(texts) * N_WORD).reshape(-1, N_WORD)
    n_words = counts.sum(1)
    return counts / np.maximum(1, n_words)[:, None], n_words


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p["x" + d] = rng.normal(0, 0.15, (WIDTH, 4 * HIDDEN))
        p["h" + d] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
        p["c" + d] = np.zeros(4 * HIDDEN)
        p["c" + d][HIDDEN : 2 * HIDDEN] = 1
    p["o"] = rng.normal(0, 0.3, (2 * HIDDEN, 1))
    p["s"] = rng.normal(0, 0.1, (WIDTH, 1))
    p["b"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _pass(x, mask, p, d, keep):
    """Hidden states of one direction; x is time x page x feature, in reading order of the direction."""
    t_n, b, _ = x.shape
    gates = x @ p["x" + d] + p["c" + d]
    h, c = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
    out, tape = np.zeros((t_n, b, HIDDEN), np.float32), []
    for t in range(t_n):
        g = gates[t] + h @ p["h" + d]
        s = _sigmoid(g[:, : 3 * HIDDEN])
        i, f, o, u = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        c_new = m * (f * c + i * u)
        tc = np.tanh(c_new)
        h_new = m * (o * tc)
        if keep:
            tape.append((i, f, o, u, c, tc, h))
        h, c = h_new, c_new
        out[t] = h
    return out, tape


def forward(x, mask, p, keep=False):
    """Log-odds that a block is article text; time x page."""
    hf, tf = _pass(x, mask, p, "f", keep)
    hb, tb = _pass(x[::-1], mask[::-1], p, "b", keep)
    both = np.concatenate([hf, hb[::-1]], 2)
    z = (both @ p["o"] + x @ p["s"] + p["b"])[..., 0]
    return (z, both, tf, tb) if keep else z


def _back(x, mask, p, d, tape, dh_out, grad):
    dh_next = dc_next = np.zeros(dh_out.shape[1:], np.float32)
    dg_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
    for t in range(len(tape) - 1, -1, -1):
        i, f, o, u, c, tc, h = tape[t]
        m = mask[t][:, None]
        dh = (dh_out[t] + dh_next) * m
        dc = (dh * o * (1 - tc * tc) + dc_next) * m
        dg = np.concatenate([dc * u * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], 1)
        dg_all[t] = dg
        grad["h" + d] += h.T @ dg
        dh_next = dg @ p["h" + d].T
        dc_next = dc * f
    grad["x" + d] += np.tensordot(x, dg_all, ([0, 1], [0, 1]))
    grad["c" + d] += dg_all.sum((0, 1))


def train(pages: list[tuple[list, np.ndarray]], epochs: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Adam on the cross entropy of all blocks; a step takes up to 32 pages of like length, or one long page."""
    p, paths = _start(rng), {}
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = sorted(rng.permutation(len(pages)).tolist(), key=lambda i: len(pages[i][0]) // 8)
        groups: list[list[int]] = []
        for i in order:
            if groups and len(groups[-1]) < 32 and (len(groups[-1]) + 1) * (len(pages[i][0]) + 7) <= STEP_BLOCKS:
                groups[-1].append(i)
            else:
                groups.append([i])
        for g in rng.permutation(len(groups)):
            some = [pages[i] for i in groups[g]]
            x, mask = padded([vectors(b, paths) for b, _ in some])
            y = np.zeros(mask.shape, np.float32)
            for j, (_, t) in enumerate(some):
                y[: len(t), j] = t
            z, both, tf, tb = forward(x, mask, p, keep=True)
            dz = (_sigmoid(z) - y) * mask / mask.sum()
            grad = {k: np.zeros_like(v) for k, v in p.items()}
            grad["o"] = np.tensordot(both, dz, ([0, 1], [0, 1]))[:, None]
            grad["s"] = np.tensordot(x, dz, ([0, 1], [0, 1]))[:, None]
            grad["b"] = np.array([dz.sum()], np.float32)
            dh = dz[..., None] * p["o"][:, 0]
            _back(x, mask, p, "f", tf, dh[..., :HIDDEN], grad)
            _back(x[::-1], mask[::-1], p, "b", tb, dh[::-1][..., HIDDEN:], grad)
            step += 1
            for k in p:
                m1[k] = 0.9 * m1[k] + 0.1 * grad[k]
                m2[k] = 0.99 * m2[k] + 0.01 * grad[k] ** 2
                p[k] = (p[k] - 0.02 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return p


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t_n = max(len(r) for r in rows)
    x = np.zeros((t_n, len(rows), WIDTH), np.float32)
    mask = np.zeros((t_n, len(rows)), np.float32)
    for j, r in enumerate(rows):
        x[: len(r), j] = r
        mask[: len(r), j] = 1
    return x, mask


# Containers that training pages are re-told with.
_WITHIN = ("article", "main", "div .content div.content", "div .post div.post .body div.body", "section .entry section.entry", "div .main div.main", "div")
_AROUND = (
    "nav ul li a", "header p", "header h1", "footer p", "footer div", "aside p", "aside h3", "aside ul li", "form label",
    "form p", "form button", "div .ad div.ad", "div .ads div.ads p", "div .advert div.advert p", "div .sidebar div.sidebar p",
    "div .sidebar div.sidebar ul li a", "div .comments div.comments p", "section .comments section.comments div p",
    "div .comment div.comment p", "ol .comment ol.comment li p", "div .cookie div.cookie .notice div.notice p",
    "div .notice div.notice p", "div .menu div.menu a", "ul .menu ul.menu li", "div .footer div.footer p",
    "div .header div.header p", "div .related div.related a", "div .share div.share a", "div .newsletter div.newsletter p",
    "div .promo div.promo p", "div .banner div.banner", "div .breadcrumb div.breadcrumb a", "div .widget div.widget p",
    "section .reader section.reader .comments section.comments p",
)


def retold(blocks, rng: np.random.Generator):
    """A training page with its article container renamed and boilerplate sections mixed in."""
    named = [(b, teacher(b[1], b[0], b[2])) for b in blocks]
    inside = tuple(_WITHIN[rng.integers(len(_WITHIN))].split())
    root = ("html", "body")
    out = []
    for (text, path, linked), good in named:
        if good:
            leaf = path[-1] if path and path[-1] in ("p", "h1", "h2", "h3", "li", "blockquote", "pre", "td") else "p"
            path = root + inside + (leaf,)
        out.append(((text, path, linked), good))
    words = [w for (t, _, _), _ in named for w in t.split()][:400] or "some plain words stand here".split()
    first = next((i for i, (_, g) in enumerate(out) if g), 0)
    for _ in range(int(rng.integers(1, 5))):
        kind = tuple(_AROUND[rng.integers(len(_AROUND))].split())
        size = int(rng.integers(1, 5)) if "a" in kind or "li" in kind else int(rng.integers(2, 40))
        within = rng.random() < 0.4 and kind[0] != "header"
        path = root + (inside if within else ()) + kind
        place = int(rng.integers(first, len(out) + 1)) if within else int(rng.choice([0, first, len(out)]))
        section = []
        for _ in range(int(rng.integers(1, 5))):
            at = int(rng.integers(len(words)))
            section.append(((" ".join(words[at : at + size]) or "more", path, 1.0 if kind[-1] == "a" else 0.0), False))
        out[place:place] = section
    return [b for b, _ in out], np.array([g for _, g in out], np.float32)


def made_up(rng: np.random.Generator):
    """Blocks of a plain page with random words, so that training has clear cases whatever the sample holds."""
    letters = "etaoinshrdlu"

    def text(n: int) -> str:
        words = ["".join(letters[i] for i in rng.integers(0, 12, int(rng.integers(2, 9)))) for _ in range(n)]
        return " ".join(words).capitalize() + ("." if rng.random() < 0.7 else "")

    root = ("html", "body") if rng.random() < 0.7 else ()
    blocks = [(text(2), (*root, "nav", "ul", "li", "a"), 1.0) for _ in range(int(rng.integers(0, 5)))]
    blocks += [(text(int(rng.integers(2, 9))), (*root, "article", "h1"), 0.0)] if rng.random() < 0.6 else []
    blocks += [(text(int(rng.integers(1, 60))), (*root, "article", "p"), 0.0) for _ in range(int(rng.integers(1, 8)))]
    blocks += [(text(int(rng.integers(1, 12))), (*root, "footer"), 0.0)] if rng.random() < 0.7 else []
    return blocks


# Usual class names of the parts of a page.
_NAMES = {
    "head": ("header", "top", "masthead", "branding"), "menu": ("nav", "menu", "navbar", "links"), "story": ("content", "post", "entry", "story"),
    "body": ("body", "text", "copy", "inner"), "note": ("cookie", "notice", "consent", "banner"), "ad": ("ad", "promo", "sponsored", "advert"),
    "side": ("sidebar", "widget", "related", "rail"), "talk": ("comments", "replies", "discussion", "responses"), "reply": ("comment", "reply", "item", "row"),
    "foot": ("footer", "bottom", "legal", "copyright"), "share": ("share", "social", "tools", "actions"), "page": ("page", "wrapper", "container", "site"),
}


def site(rng: np.random.Generator, words: Sequence[str]):
    """One page of a made-up site told in ``words``, with its labels."""
    naming, sectioned = int(rng.choice(3, p=(0.3, 0.5, 0.2))), bool(rng.random() < 0.5)
    chosen: dict[str, str] = {}
    out: list[tuple[tuple[str, tuple[str, ...], float], bool]] = []

    def some(low: int, high: int) -> int:
        return int(rng.integers(low, high + 1))

    def say(low: int, high: int, end: str = "") -> str:
        at, n = int(rng.integers(len(words))), some(low, high)
        text = " ".join(words[(at + i) % len(words)] for i in range(n))
        return (text[:1].upper() + text[1:]).rstrip(".,;:!?") + end

    def box(part: str, tag: str = "div", section: str = "") -> tuple[str, ...]:
        """The element that holds a part of the page: a sectioning tag, or a container named by the style of the site."""
        if section and sectioned:
            tag = section
            if rng.random() < 0.6:
                return (tag,)
        if naming == 2:
            return (tag,)
        if part not in chosen:
            usual = _NAMES[part]
            chosen[part] = usual[rng.integers(len(usual))] if naming == 0 else "".join("abcdefghiklmnoprstuvwz"[i] for i in rng.integers(0, 22, some(3, 9)))
        return (tag, f"{tag}.{chosen[part]}", "." + chosen[part])

    def add(text: str, path: tuple[str, ...], good: bool = False, linked: float = 0.0) -> None:
        out.append(((text, path, linked), good))

    root = ("html", "body") + (box("page") if rng.random() < 0.5 else ())

    def links(path: tuple[str, ...]) -> None:
        tail = (("ul", "li", "a"), ("a",), ("p", "a"), ("li", "a"))[rng.integers(4)]
        for _ in range(some(2, 7)):
            add(say(1, 4), path + tail, linked=1.0)

    def sidebar() -> None:
        side = root + box("side", section="aside")
        for _ in range(some(1, 3)):
            add(say(1, 5), side + (("h2", "h3", "h4", "p")[rng.integers(4)],))
            if rng.random() < 0.5:
                add(say(4, 30, "."), side + (("p",), ())[rng.integers(2)])
            else:
                links(side)

    def article() -> None:
        story = root + box("story", section="article" if rng.random() < 0.8 else "main")
        top = story + (("header",) if rng.random() < 0.4 else ())
        add(say(2, 12), top + (("h1", "h1", "h2")[rng.integers(3)],), True)
        if rng.random() < 0.3:
            add(say(4, 25, "."), top + (("p", "h2")[rng.integers(2)],), True)
        body = story + (box("body") if rng.random() < 0.4 else ())
        for kind in rng.choice(8, some(2, 11), p=(0.58, 0.1, 0.08, 0.08, 0.04, 0.05, 0.04, 0.03)):
            if kind == 0:
                add(say(3, 70, ".!?"[rng.integers(3)]), body + ("p",), True)
            elif kind == 1:
                add(say(1, 8), body + (("h2", "h3", "h4")[rng.integers(3)],), True)
            elif kind == 2:
                add(say(5, 50, "."), body + (("blockquote",), ("blockquote", "p"))[rng.integers(2)], True)
            elif kind == 3:
                for _ in range(some(2, 6)):
                    add(say(1, 20, ("", ".")[rng.integers(2)]), body + ("ul" if rng.random() < 0.6 else "ol", "li"), True)
            elif kind == 4:
                add(say(3, 15, ("", ".")[rng.integers(2)]), body + ("figure", "figcaption"), True)
            elif kind == 5:
                add(say(1, 6), body + ("table", "caption"), True)
                for _ in range(some(3, 9)):
                    add(say(1, 4), body + ("table", "tbody", "tr", ("td", "th")[rng.integers(2)]), True)
            elif kind == 6:
                add(say(5, 40), body + (("pre",), ("dl", "dd"))[rng.integers(2)], True)
            else:
                add(say(4, 25, "."), body + box("ad") + (("p",), ())[rng.integers(2)])
        if rng.random() < 0.25:
            links(story + box("share"))

    def comments() -> None:
        talk = root + box("talk", section="section")
        if rng.random() < 0.5:
            add(say(1, 2), talk + (("h2", "h3")[rng.integers(2)],))
        for _ in range(some(1, 6)):
            item = talk + box("reply", ("div", "li", "div")[rng.integers(3)])
            add(say(1, 2) + ("", f" {some(1, 28)}.{some(1, 12)}.20{some(10, 25)}", ":")[rng.integers(3)], item + (("p",), ("h4",), ("div",), ())[rng.integers(4)])
            for _ in range(some(1, 2)):
                add(say(2, 50, ".!?"[rng.integers(3)]), item + (("p",), ("p",), ("div",), ())[rng.integers(4)])
            if rng.random() < 0.3:
                add(say(1, 1), item + ("a",), linked=1.0)

    if rng.random() < 0.8:
        add(say(2, 10), ("html", "head", "title"))
    if rng.random() < 0.3:
        add(say(6, 35, "."), root + box("note") + (("p",), ())[rng.integers(2)])
    if rng.random() < 0.7:
        head = root + box("head", section="header")
        add(say(1, 3), head + (("a",), ("h1",), ("p",), ())[rng.integers(4)], linked=float(rng.integers(2)))
        if rng.random() < 0.4:
            add(say(3, 9), head + ("p",))
    if rng.random() < 0.8:
        links(root + box("menu", section="nav"))
    first = rng.random() < 0.5
    if first and rng.random() < 0.5:
        sidebar()
    article()
    if rng.random() < 0.5:
        comments()
    if not first and rng.random() < 0.5:
        sidebar()
    if rng.random() < 0.3:
        form = root + ("form",)
        add(say(3, 15, "."), form + (("p",), ("label",))[rng.integers(2)])
        add(say(1, 3), form + ("button",))
    if rng.random() < 0.8:
        foot = root + box("foot", section="footer")
        if rng.random() < 0.4:
            links(foot)
        add(("\u00a9 ", "")[rng.integers(2)] + say(2, 18, ("", ".")[rng.integers(2)]), foot + (("p",), ())[rng.integers(2)])
    return [b for b, _ in out], np.array([g for _, g in out], np.float32)


def _fit(table: pa.Table | None, epochs: int, copies: int, made: int, sites: int = 0):
    rng = np.random.default_rng(11)
    pages = []
    htmls = sorted(h for h in table.column("h").to_pylist() if h) if table is not None else []
    for blocks in [*(leaves(h) for h in htmls), *(made_up(rng) for _ in range(made))]:
        if not blocks:
            continue
        pages.append((blocks, np.array([teacher(p, t, a) for t, p, a in blocks], np.float32)))
        for _ in range(copies):
            pages.append(retold(blocks, rng))
        words = [w for t, _, _ in blocks for w in t.split()][:5000]
        pages += [site(rng, words) for _ in range(sites)]
    return train(pages, epochs, rng)


def extract_text(
    pages: DataFrame,
    html_col: str = "html",
    carry: Sequence[str] = ("page_id", "url"),
    prefix: str = "",
    train_pages: int = 250,
    copies: int = 2,
    epochs: int = 6,
    made: int = 100,
    sites: int = 4,
) -> DataFrame:
    """``carry`` columns of every page with text, n_chars and n_blocks (all blocks of the page)."""
    n = pages.count()
    sample = pages.filter(below(column(html_col), train_pages / max(1, n), 5)).select(column(html_col).cast("string").alias("h"))
    model = fit_once(sample.distinct(), lambda t: _fit(t, epochs, copies, made, sites)) or _fit(None, epochs, copies, made, sites)

    def extract(htmls):
        paths: dict = {}
        found = [leaves(h) for h in htmls.to_pylist()]
        picked: list[list[str]] = [[] for _ in found]
        order = sorted((i for i, b in enumerate(found) if b), key=lambda i: len(found[i]))
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b - a) < 128 and len(found[order[b]]) * (b - a + 1) <= 8192:
                b += 1
            some = order[a:b]
            x, mask = padded([vectors(found[i], paths) for i in some])
            yes = forward(x, mask, model) > 0
            for j, i in enumerate(some):
                picked[i] = [blk[0] for t, blk in enumerate(found[i]) if yes[t, j]]
            a = b
        texts = ["\n".join(p) for p in picked]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(f) for f in found], pa.int64())]

    return map_rows(pages, [html_col], [("text", "string"), ("n_chars", "bigint"), ("n_blocks", "bigint")], extract, carry, prefix)
