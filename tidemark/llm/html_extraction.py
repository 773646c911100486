"""HTML extraction: union-free regular-expression wrappers, inferred from the token streams of pages of one host.

A page is a stream of structural tags (with their depth and class) and text slots. Complete flow elements
and neighbouring repeats of a run become repeated groups. The streams of a host are aligned one after the other, most
frequent first; what only one side has becomes an optional piece, and texts become slots whose statistics are carried
along: characters, characters in links, pages, and whether the text is ever another one.

From the wrapper comes the host's main region: the innermost element of the wrapper that holds nearly all text that differs
from page to page, an article or main element first. Navigation, notices, adverts, forms, reader comments and the like, known by element, role
or class, count as boilerplate before. Every page's whole html is then read: its stream is aligned with its host's wrapper, and
the text of the elements that meet the main region is kept, whatever of it is constant, optional or unknown to the wrapper. A page that
has nothing there keeps all its text outside boilerplate.

Streams and their slots are counted per host and distinct stream in Spark, and every distinct stream goes into its host's wrapper: the
STREAMS most frequent ones of a host are aligned in one task, the others in parts of about as many, and the parts' wrappers are aligned FAN at a time
until one is left. So a task gathers STREAMS streams or FAN wrappers, however many pages and streams the host has; a wrapper is as long as what
differs in the host's structure. Two elements' differing middle parts longer than CELLS allows are cut at anchors first.
Defined cases: null html gives an empty text; null url or one without `://` belongs to
the host ""; markup that never closes is closed at the end; repeated rows give repeated
results, and a host whose pages are all equal keeps their text; an empty table gives an empty one; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import json
import re
from bisect import bisect_left
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import lean

#: Distinct streams of a host that are aligned in one task, and wrappers of such parts that are joined in one.
STREAMS, FAN = 48, 8
#: Product of the lengths of two elements' differing parts up to which those are aligned at once; longer ones are cut at anchors first.
CELLS = 1 << 14
#: Characters of all wrappers, and of the longest one, up to which they are broadcast and come with each page; beyond, a wrapper comes once before its host's pages.
BROADCAST_CHARS, ROW_CHARS = 1 << 25, 1 << 16
SALTS = 16
#: Share of the text outside boilerplate that the main region must hold; of it, what an article or main element must hold.
MASS, NAMED = 0.9, 0.3
#: Longest run of tokens whose repeats are folded, and alignments and rules that a task remembers.
WIDTH, REMEMBERED = 12, 5_000

# Elements by role.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "math", "object", "canvas", "audio", "video")
VOID = {"area", "base", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "br"}
DROP = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "label", "fieldset", "dialog", "menu", "head", "input"}
BLOCK = {"html", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "details", "summary", "center", "hgroup"} | DROP
CONTAINER = {"html", "body", "article", "main", "section", "div", "td", "table", "tbody", "tr", "center", "blockquote"}
#: Elements that a group may stand for even if they come once.
FLOW = BLOCK - {"html", "body", "article", "main", "section", "div", "center"}
CLOSES_P = BLOCK - {"html", "body", "head", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "option", "summary", "figcaption", "label", "button", "select", "input"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alertdialog", "alert"}
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertis\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|sidebar|side-?bar|menus?|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|comments?|commentlist|respond|replies|reply|disqus|share|sharing|social|related|recommended|newsletter|subscribe|popup|modal|widget|toolbar|login|signup|search|skip|copyright)(?:$|[\s_-])",
    re.I,
)

# Parts of names that say nothing of what an element holds.
AFFIXES = set("""article area bar body bottom box block button buttons cell col column content contents count entry form global group icon icons inner item items
left link links list main outer page panel post posts primary right row secondary section site slot stories story thread title top unit widget wrap wrapper""".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW_END = {x: re.compile(rf"</{x}\b[^>]*>|\Z", re.I) for x in RAW}


def _plain(label: str) -> bool:
    """Whether a class or id is a boilerplate name and nothing else (`comment-list`, but not `search-engines`)."""
    return any(NAMES.fullmatch(x) or (NAMES.search(x) and all(not y or y.isdigit() or y.lower() in AFFIXES or NAMES.fullmatch(y) for y in re.split("[_-]+", x))) for x in label.split())


def events(html: str):
    """("open", name, key, dropped: True, False, or "outside" if only outside an article), ("close", name), ("break",), ("text", text, in a link) of the page."""
    at, links, n = 0, 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None or m.start() > at:
            yield ("text", html[at : m.start() if m else n], links > 0)
            if m is None:
                return
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCK:
                yield ("close", name)
            continue
        attrs = m[3] or m[6] or ""
        if name in RAW:
            if not attrs.rstrip().endswith("/"):
                at = _RAW_END[name].search(html, at).end()
            continue
        if name == "a":
            links += 1
        if name in ("br", "hr"):
            yield ("break",)
        if name in BLOCK and name not in VOID:
            key, drop = name, name in DROP
            if attrs:
                a = {x[1].lower(): htmllib.unescape(x[2] or x[3] or x[4] or "") for x in _ATTR.finditer(attrs)}
                label = f"{a.get('class', '')} {a.get('id', '')}".strip()
                drop = drop or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true"
                if not drop and name not in ("html", "body") and NAMES.search(label):
                    drop = _plain(label) or "outside"
                if label and name not in ("html", "body"):
                    key = f"{name}.{re.sub(r'[^A-Za-z_-]+', '_', label)[:40]}"
            yield ("open", name, key, drop)


class Page:
    """The stack of open blocks: (name, label, dropped, whether an article or main element is open)."""

    def __init__(self):
        self.stack: list[tuple] = []
        self.places: dict[str, list[int]] = {}

    def open(self, name, key, drop):
        """Labels of the elements that the tag closes, and its own."""
        closed = []
        if name in CLOSES_P:
            closed += self._shut("p", ("td", "th", "li", "div", "article", "section", "body", "blockquote"))
        if name in ("li", "tr", "td", "th", "dt", "dd", "option"):
            closed += self._shut({"th": "td"}.get(name, name), ("ul", "ol", "table", "dl", "select", "tbody", "thead") if name != "td" else ("tr", "table"))
        label = f"{len(self.stack)}{key}"
        inside = bool(self.stack) and self.stack[-1][3]
        if inside and name == "header":
            # An article's own header holds its title.
            drop = bool(NAMES.search(key.replace("header", "")))
        drop = bool(drop) and not (inside and drop == "outside")
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, label, drop or (bool(self.stack) and self.stack[-1][2]), inside or name in ("article", "main")))
        return closed, label

    def _last(self, name):
        at = self.places.get(name)
        return at[-1] if at else -1

    def _shut(self, name, stop):
        i = self._last(name)
        return self._cut(i) if i >= 0 and i >= max(map(self._last, stop)) else []

    def close(self, name):
        i = self._last(name)
        return self._cut(i) if i >= 0 else []

    def _cut(self, i):
        out = []
        while len(self.stack) > i:
            x = self.stack.pop()
            self.places[x[0]].pop()
            out.append(x[1])
        return out


def tokens(html: str) -> tuple[list[str], dict]:
    """The page's tokens (`label`, `/label`, `#`), and the texts of each `#`: place to [(text, characters in links, boilerplate)]."""
    page, labels, texts, held, linked = Page(), [], {}, [], 0

    def flush():
        nonlocal linked
        if held and (t := " ".join(htmllib.unescape("".join(held)).split())):
            if not labels or labels[-1] != "#":
                labels.append("#")
            texts.setdefault(len(labels) - 1, []).append((t, min(linked, len(t)), bool(page.stack) and page.stack[-1][2]))
        held.clear()
        linked = 0

    for e in events(html):
        if e[0] == "text":
            held.append(e[1])
            linked += len(e[1].strip()) * e[2]
            continue
        flush()
        if e[0] == "open":
            closed, own = page.open(*e[1:])
            labels += ["/" + x for x in closed] + [own]
        elif e[0] == "close":
            labels += ["/" + x for x in page.close(e[1])]
    flush()
    return labels + ["/" + x[1] for x in reversed(page.stack)], texts


def _name(label: str) -> str:
    return label.lstrip("0123456789").partition(".")[0]


def fold(labels: list[str]) -> list[tuple]:
    """Items (label, members): complete flow elements and neighbouring equal runs as groups ("+", run), inner ones first; members: the places of each of its tokens."""
    items = [(x, [[i]]) for i, x in enumerate(labels)]
    for width in range(2, WIDTH + 1):
        out, i = [], 0
        heads = [x for x, _ in items]
        while i < len(items):
            first = heads[i]
            if isinstance(first, str) and first != "#" and first[0] != "/":
                run, j = heads[i : i + width], i + width
                if len(run) == width and _balanced(run):
                    while heads[j : j + width] == run:
                        j += width
                    flow = run[-1] == "/" + first and _name(first) in FLOW
                    if flow or (j > i + width and ("." in first or _name(first) in FLOW)):
                        members = [m for _, x in items[i : i + width] for m in x]
                        for k in range(i + width, j, width):
                            for m, more in zip(members, (m for _, x in items[k : k + width] for m in x), strict=True):
                                m += more
                        out.append((("+", tuple(run)), members))
                        i = j
                        continue
            out.append(items[i])
            i += 1
        items = out
    return items


def _balanced(run: list) -> bool:
    still = []
    for x in run:
        if isinstance(x, str) and x != "#":
            if x[0] != "/":
                still.append(x)
            elif not still or still.pop() != x[1:]:
                return False
    return not still


def leaves(label) -> list[str]:
    """The tokens of a piece of a stream, groups written out once."""
    return [label] if isinstance(label, str) else [y for x in label[1] for y in leaves(x)]


class Wholes(dict):
    """Numbers of equal wholes; those that `base` has keep its numbers. And the labels inside each, counted when first asked for."""

    def __init__(self, base=()):
        self.base, self.labels = base, {}

    def number(self, key) -> int:
        return self.base[key] if key in self.base else self.setdefault(key, len(self.base) + len(self))

    def inside(self, u: tuple) -> Counter:
        if u[3] < len(self.base):
            return self.base.inside(u)
        if u[3] not in self.labels:
            self.labels[u[3]] = Counter(v[2] for v in u[4])
        return self.labels[u[3]]


def _both(a: Counter, b: Counter) -> int:
    """Labels that both hold."""
    if len(a) > len(b):
        a, b = b, a
    return sum(min(n, b[x]) for x, n in a.items() if x in b)


def _units(s: list, ids: Wholes) -> list:
    """A stream as a forest of (place, place of the end, label, id of the whole, units inside)."""
    still: list = [(0, "", [])]
    for i, x in enumerate(s):
        if isinstance(x, str) and x != "#" and x[0] != "/":
            still.append((i, x, []))
        elif isinstance(x, str) and x != "#":
            if len(still) > 1:
                j, label, inside = still.pop()
                still[-1][2].append((j, i, label, ids.number((label, *(u[3] for u in inside))), inside))
        else:
            still[-1][2].append((i, i, x, ids.number((x,)), []))
    return still[0][2]


def _rising(pairs: list[tuple]) -> list[tuple]:
    """The longest run of pairs (first members ascending) whose second members ascend too."""
    ends, at, before = [], [], []
    for k, (_, j) in enumerate(pairs):
        i = bisect_left(ends, j)
        before.append(at[i - 1] if i else -1)
        if i == len(ends):
            ends.append(j)
            at.append(k)
        else:
            ends[i], at[i] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _anchors(x: list, y: list) -> list[tuple[int, int]]:
    """Places that belong together in two long lists of units, in order: labels that both hold once, else equal wholes that both hold once, else the k-th of a label."""
    for of in (2, 3):
        one, two = Counter(u[of] for u in x), Counter(v[of] for v in y)
        at = {v[of]: j for j, v in enumerate(y) if two[v[of]] == 1}
        if pairs := [(i, at[u[of]]) for i, u in enumerate(x) if one[u[of]] == 1 and u[of] in at]:
            return _rising(pairs)
    times, seen = [], {}
    for side in (x, y):
        n: Counter = Counter()
        times.append([])
        for u in side:
            times[-1].append((u[2], n[u[2]]))
            n[u[2]] += 1
    seen = {t: j for j, t in enumerate(times[1])}
    return _rising([(i, seen[t]) for i, t in enumerate(times[0]) if t in seen])


def _matched(x: list, y: list, ids: Wholes) -> list[tuple]:
    """Pairs of units of two lists, in order, of the largest total weight (1 for the label, 1 for each label both hold inside, 1 for equal
    wholes); lists whose product is over CELLS are cut at their anchors until the parts are shorter or have nothing in common."""
    out, todo = [], [(x, y)]
    while todo:
        x, y = todo.pop()
        lo, n = 0, min(len(x), len(y))
        while lo < n and x[lo][3] == y[lo][3]:
            lo += 1
        hi = 0
        while hi < n - lo and x[-1 - hi][3] == y[-1 - hi][3]:
            hi += 1
        out += [*zip(x[:lo], y[:lo], strict=True), *zip(x[len(x) - hi :], y[len(y) - hi :], strict=True)]
        x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
        if len(x) * len(y) <= CELLS:
            out += _best(x, y, ids)
            continue
        i = j = 0
        found = _anchors(x, y)
        for p, q in found:
            out.append((x[p], y[q]))
            todo.append((x[i:p], y[j:q]))
            i, j = p + 1, q + 1
        if found:
            todo.append((x[i:], y[j:]))
    return out


def _best(x: list, y: list, ids: Wholes) -> list[tuple]:
    """As `_matched`, of all pairs at once."""
    out: list = []
    if x and y:
        weight = [[1 + (u[3] == v[3]) + _both(ids.inside(u), ids.inside(v)) if u[2] == v[2] else 0 for v in y] for u in x]
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            row, under = best[i], best[i + 1]
            for j in range(len(y) - 1, -1, -1):
                row[j] = max(under[j], row[j + 1], under[j + 1] + weight[i][j])
        i = j = 0
        while i < len(x) and j < len(y):
            if weight[i][j] and best[i][j] == best[i + 1][j + 1] + weight[i][j]:
                out.append((x[i], y[j]))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return out


class Fitted(list):
    """A wrapper's labels, taken apart once for many pages: alignments with it go no deeper than to the main places."""

    def __init__(self, labels: list, main: set):
        super().__init__(labels)
        self.ids = Wholes()
        self.units = _units(labels, self.ids)
        found = elements(labels)
        self.end = {i: j for i, j, _ in found}
        at = [*sorted(main), len(labels)]
        self.around = {i for i, j, _ in found if at[bisect_left(at, i + 1)] < j}


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Places of two streams' pieces that stand for each other: elements, slots and groups in order, an element's tag and end together."""
    fitted = isinstance(a, Fitted)
    ids = Wholes(a.ids if fitted else ())
    out, todo = [], [(a.units if fitted else _units(a, ids), _units(b, ids))]
    while todo:
        for u, v in _matched(*todo.pop(), ids):
            out.append((u[0], v[0]))
            if u[1] > u[0]:
                out.append((u[1], v[1]))
                if not fitted or u[0] in a.around:
                    todo.append((u[4], v[4]))
    return sorted(out)


def _joined(s: list, t: list) -> list:
    """Statistics of a slot: [pages, characters, of them in links, least and greatest hash of a page's text, pages where it is boilerplate]."""
    return [s[0] + t[0], s[1] + t[1], s[2] + t[2], min(s[3], t[3]), max(s[4], t[4]), s[5] + t[5]]


def extended(wrapper: list, stream: list) -> list:
    """The wrapper that also accepts the stream, or what another wrapper accepts. Pieces: (label, optional, statistics of its slots)."""
    out, i, j = [], 0, 0
    for p, q in [*align([x[0] for x in wrapper], [x[0] for x in stream]), (len(wrapper), len(stream))]:
        out += [(x, True, s) for x, _, s in wrapper[i:p]] + [(x, True, s) for x, _, s in stream[j:q]]
        if p < len(wrapper):
            x, optional, s = wrapper[p]
            out.append((x, optional or stream[q][1], [_joined(u, v) for u, v in zip(s, stream[q][2], strict=True)]))
        i, j = p + 1, q + 1
    return out


def written_out(wrapper: list) -> str:
    """The wrapper as a regular expression over tokens."""

    def piece(x) -> str:
        return ("#text" if x == "#" else f"<{x}>") if isinstance(x, str) else f"({''.join(map(piece, x[1]))})+"

    return "".join(f"({piece(x)})?" if optional else piece(x) for x, optional, _ in wrapper)


def elements(labels: list) -> list[tuple[int, int, int]]:
    """(place of the tag, of its end, elements around it) of the elements that a stream holds whole, outside groups."""
    still, out, opened = [], [], Counter()
    for i, x in enumerate(labels):
        if isinstance(x, str) and x != "#":
            if x[0] != "/":
                still.append((i, x))
                opened[x] += 1
            elif opened[x[1:]]:
                while still[-1][1] != x[1:]:
                    opened[still.pop()[1]] -= 1
                opened[x[1:]] -= 1
                out.append((still.pop()[0], i, len(still)))
    return sorted(out)


def joined(streams: list[list]) -> list:
    """The wrapper of streams, pieces (label, False, statistics), most frequent first, or of wrappers of such parts."""
    wrapper: list = []
    for k, s in enumerate(streams):
        wrapper = extended(wrapper, s) if k else list(s)
    return wrapper


def infer(streams: list[list]) -> tuple[list, list[int]]:
    """Wrapper of streams, or of wrappers, and places in it of the elements that make the main region."""
    wrapper = joined(streams)
    good, varied, once = [0] * len(wrapper), [0] * len(wrapper), [0] * len(wrapper)
    for i, (_, _, slots) in enumerate(wrapper):
        for pages, chars, linked, low, high, dropped in slots:
            if not dropped and 2 * linked < chars:
                good[i] += chars
                varied[i] += chars * (low != high)
                once[i] += chars * (pages == 1)
    # Text that is the same on every page says where the template is, unless all of it is. What one page alone has
    # says nothing, unless that is most of what there is.
    if sum(varied) < NAMED * (sum(varied) + sum(once)):
        varied = [u + v for u, v in zip(varied, once, strict=True)]
    mass = varied if any(varied) else good
    labels = [x for x, _, _ in wrapper]
    total, found = sum(mass), [(sum(mass[i:j]), deep, i) for i, j, deep in elements(labels)]
    if not total:
        return wrapper, []
    named = [x for x in found if _name(labels[x[2]]) in ("article", "main") and x[0] >= NAMED * total]
    inner = [x for x in named if _name(labels[x[2]]) == "article"]
    other = [x for x in found if _name(labels[x[2]]) in CONTAINER and x[0] >= MASS * total]
    if inner:
        top = min(x[1] for x in inner)
        best = max((x for x in inner if x[1] == top), key=lambda x: (x[0], -x[2]))
    elif named or other:
        best = max(named or other, key=lambda x: (x[1], x[0], -x[2]))
    else:
        return wrapper, []
    # Others of the same label at the same depth are instances of the region too, if anything in them differs between pages.
    label = labels[best[2]]
    return wrapper, sorted(x[2] for x in found if x[2] == best[2] or (labels[x[2]] == label and _telling(label) and x[0] > 0))


def _telling(label: str) -> bool:
    """Whether a label says more than the kind of a box."""
    return "." in label or _name(label) in ("article", "main")


def extract(html: str | None, rule: dict | None, known: dict | None = None, host: str | None = None) -> str:
    """The page's main text by its host's rule (wrapper's labels, main places). known: alignments met before, by host and stream, REMEMBERED at most."""
    if not html:
        return ""
    labels, texts = tokens(html)
    spans = []
    if rule and rule["main"]:
        items = fold(labels)
        stream = tuple(x for x, _ in items)
        found = known.get((host, stream)) if known is not None else None
        if found is None:
            found = regions(rule, list(stream))
            if known is not None:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[host, stream] = found
        spans = [(items[i][1][0][0], items[j][1][0][0]) for i, j in found]
    every = [(at, t) for at, found in sorted(texts.items()) for t, _, dropped in found if not dropped]
    inside = [t for at, t in every if any(a < at < b for a, b in spans)]
    return "\n".join(inside or [t for _, t in every])


def regions(rule: dict, stream: list) -> list[tuple[int, int]]:
    """The elements (places of tag and end) of a page's folded stream that meet the wrapper's main region."""
    main = rule["main"]
    if "fitted" not in rule:
        rule["fitted"] = Fitted(rule["wrapper"], main)
    wrapper = rule["fitted"]
    met = {j: i for i, j in align(wrapper, stream)}
    own = elements(stream)
    out = [(i, j) for i, j, _ in own if met.get(i) in main and met.get(j) == wrapper.end[met[i]]]
    labels = {wrapper[i] for i in main if _telling(wrapper[i])}
    return out + [(i, j) for i, j, _ in own if stream[i] in labels and (i, j) not in out]


def _with_host(pages: DataFrame) -> DataFrame:
    from .url_filters import host_and_path

    return pages.select("page_id", "url", "html", host_and_path(F.col("url"))[0].alias("host"))


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=7).digest(), "big")


def streams(pages: DataFrame) -> DataFrame:
    """Rows (host, sid, stream, pages, slots) of pages (url, html): distinct folded streams of a batch, and statistics of their slots."""
    slot = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in SLOT]))
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("sid", T.LongType()), T.StructField("stream", T.StringType()), T.StructField("pages", T.LongType()), T.StructField("slots", slot)])
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in SLOT]))

    def scan(batches):
        for batch in batches:
            seen: dict = {}
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                labels, texts = tokens(html or "")
                items = fold(labels)
                slots = []
                for x, members in items:
                    for leaf, places in zip(leaves(x), members, strict=True):
                        if leaf == "#":
                            of = [t for i in places for t in texts.get(i, ())]
                            h = _digest("\n".join(t for t, _, _ in of))
                            slots.append([1, sum(len(t) for t, _, _ in of), sum(n for _, n, _ in of), h, h, int(any(d for _, _, d in of))])
                key = (host, json.dumps([x for x, _ in items]))
                n, old = seen.get(key, (0, None))
                seen[key] = (n + 1, slots if old is None else [_joined(u, v) for u, v in zip(old, slots, strict=True)])
            rows = [{"host": h, "sid": _digest(x), "stream": x, "pages": n, "slots": [dict(zip(SLOT, s, strict=True)) for s in slots]} for (h, x), (n, slots) in seen.items()]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in rows], t) for c, t in (("host", pa.string()), ("sid", pa.int64()), ("stream", pa.string()), ("pages", pa.int64()))), pa.array([r["slots"] for r in rows], kind)], names=schema.names)

    return _with_host(pages.select(F.lit(None).cast("long").alias("page_id"), "url", "html")).select("host", "html").mapInArrow(lean(scan), schema)


SLOT = ("pages", "chars", "linked", "low", "high", "dropped")


def wrappers(pages: DataFrame) -> DataFrame:
    """One row per host of pages (url, html): host, wrapper (a regular expression over tokens), labels (its pieces, as JSON), main (places of the main region's tags)."""
    from .textops import forget, written

    found, first = written(streams(pages), "streams")
    rank = Window.partitionBy("host").orderBy(F.desc("pages"), "sid")
    every = found.groupBy("host", "sid").agg(F.sum("pages").alias("pages"))
    top = every.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= STREAMS).select("host", "sid", F.lit(0).cast("long").alias("part"))
    parts = every.groupBy("host").agg(F.ceil((F.count("*") - STREAMS) / STREAMS).alias("parts")).where("parts > 0")
    part = F.coalesce("part", 1 + F.pmod(F.col("sid"), F.col("parts")))
    dealt, second = written(every.join(top, ["host", "sid"], "left").join(parts, "host", "left").select("host", "sid", part.alias("part"), F.col("pages").alias("of")), "streams-parts")
    # Statistics of each slot of the streams; the stream itself comes along with the place before the first slot.
    rows, key = found.join(dealt, ["host", "sid"]).select("host", "part", "of", "sid", "stream", "slots"), ["host", "part", "of", "sid"]
    told = rows.groupBy(*key).agg(F.max("stream").alias("stream"))
    sums = rows.select(*key, F.posexplode("slots").alias("at", "s")).groupBy(*key, "at").agg(
        *[F.sum(f"s.{c}").alias(c) for c in ("pages", "chars", "linked", "dropped")], F.min("s.low").alias("low"), F.max("s.high").alias("high")
    )
    none = F.lit(None).cast("long")
    both = told.select(*key, F.lit(-1).alias("at"), "stream", *[none.alias(c) for c in SLOT]).unionByName(sums.withColumn("stream", F.lit(None).cast("string")))
    schema = "host string, part long, pieces string"

    def row(pdf: pd.DataFrame, part: int, wrapper: list) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "part": [part], "pieces": [json.dumps(wrapper)]})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, every = pdf.sort_values(["of", "sid", "at"], ascending=[False, True, True]), []
        for _, of in pdf.groupby("sid", sort=False):
            slots = iter(of.loc[of["at"] >= 0, list(SLOT)].astype("int64").to_numpy().tolist())
            labels = map(_tupled, json.loads(of["stream"].iloc[0]))
            every.append([(x, False, [next(slots) for y in leaves(x) if y == "#"]) for x in labels])
        return row(pdf, pdf["part"].iloc[0], joined(every))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        return row(pdf, pdf["part"].iloc[0] // FAN, joined(_pieces(x) for x in pdf["pieces"]))

    def rule(batches):
        for pdf in batches:
            for host, pieces in zip(pdf["host"], pdf["pieces"], strict=True):
                wrapper, main = infer([_pieces(pieces)])
                yield pd.DataFrame({"host": [host], "wrapper": [written_out(wrapper)], "labels": [json.dumps([x for x, _, _ in wrapper])], "main": [main]})

    fitted = both.groupBy("host", "part").applyInPandas(fit, schema)
    last = dealt.agg(F.max("part")).first()[0] or 0
    while last:
        fitted, last = fitted.groupBy("host", F.floor(F.col("part") / FAN).alias("to")).applyInPandas(join, schema), last // FAN
    out, _ = written(fitted.mapInPandas(rule, "host string, wrapper string, labels string, main array<int>"), "wrappers")
    forget(pages.sparkSession, first, second)
    return out


def _pieces(pieces: str) -> list[tuple]:
    return [(_tupled(x), optional, slots) for x, optional, slots in json.loads(pieces)]


def _tupled(x):
    return x if isinstance(x, str) else (x[0], tuple(map(_tupled, x[1])))


def main_text(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html)."""
    rules = wrappers(pages) if rules is None else rules
    rules, rows = rules.select("host", "labels", "main"), _with_host(pages)
    size = rules.agg(F.sum(F.length("labels")), F.max(F.length("labels"))).first()
    if (size[0] or 0) <= BROADCAST_CHARS and (size[1] or 0) <= ROW_CHARS:
        met = rows.join(F.broadcast(rules), "host", "left").withColumn("page", F.lit(True))
    else:
        none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("page_id", "url", "html")]
        ahead = rules.select(*none, "host", "labels", "main", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(False).alias("page"))
        own = rows.select("*", *[F.lit(None).cast(rules.schema[c].dataType).alias(c) for c in ("labels", "main")], F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(True).alias("page"))
        met = ahead.unionByName(own).repartition("host", "salt").sortWithinPartitions("host", "salt", "page")
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def apply(batches):
        rules_of: dict = {}
        known: dict = {}
        for batch in batches:
            out = []
            pages = batch.column("page")
            for host, html, labels, main, page in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "labels", "main", "page")), strict=True):
                if host not in rules_of or not page:
                    if len(rules_of) >= REMEMBERED or not page:
                        rules_of.clear()
                    rules_of[host] = {"wrapper": [_tupled(x) for x in json.loads(labels)], "main": set(main)} if labels else None
                if page:
                    out.append(extract(html, rules_of[host], known, host))
            yield pa.RecordBatch.from_arrays([batch.column("page_id").filter(pages), batch.column("url").filter(pages), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[f.name for f in schema.fields])

    return met.select("page_id", "url", "host", "html", "labels", "main", "page").mapInArrow(lean(apply), schema)
