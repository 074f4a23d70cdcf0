"""Main text of web pages by a maximum-scoring subsequence of page tokens.

A page is a sequence of tokens: words score positive, tags negative, and a linear scan finds the
contiguous run of the highest sum, which is the content region. The weights are learned from the
labelled pages below by a structured perceptron. Elements that by their name, role or invisibility
never hold article text (scripts, menus, labels and buttons of forms, ...) count as a single negative
token and their words are left out. Class names and ids are hints only, and so is being a form: an
element with a name such as `ad` or `comments` is taken for one, and a form for a form, if the page has
other content beside it, in proportion; one that holds nearly all the words of its surroundings, as a
form around a whole page does, is content, whatever its name.

Defined cases: null or empty html, and pages without a word outside such elements, give an empty text;
an empty table gives an empty one; columns of the names of the result's are replaced, all others stay;
of runs of equal sums the first counts; very long and malformed pages are scanned once, linearly but
for the searches of an unclosed tag; repeated rows are repeated.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches

# Element names of HTML by their role, and words of class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
DROPPED = RAW | frozenset("head nav aside footer template svg math button select option label legend dialog menu object canvas audio video map".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
SPACED = frozenset("br td th".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies "
    "consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar sidebars aside widget widgets related recommended recommendations share sharing social footer masthead toolbar pagination pager comment comments "
    "commentlist disqus replies respond copyright disclaimer hidden".split()
)
#: Words of an element with a hinting name to one word beside it, over which the name counts for nothing.
TRUST = 8
NOISE_STARTS = ("cookie", "advert", "sidebar", "newsletter", "sponsor", "breadcrumb")
EXEMPT = frozenset("no has with without".split())

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?>(?:[^>"']|"[^"]*"|'[^']*')*))>|</?[A-Za-z][^>]*(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Pages whose content lies between [[ and ]]; the rest is not content.
LABELLED = (
    '<html><head><title>One day</title></head><body><nav><a href="/">Home</a> <a href="/x">More</a></nav><div>Subscribe to our letters and read every day '
    "what happens in town and in the country around it, free for a month.</div><article>[[<h1>One day</h1><p>It rained on the hills.</p><p>Then.</p><p>The "
    "river rose and the people moved their boats up the bank, as they do every year.</p><ul><li>one boat</li><li>two carts</li></ul>]]</article><div>Read "
    "our other stories about boats and carts, about people and about rivers and hills in this and other countries.</div></body></html>",
    "<body><div><a href=1>World</a> <a href=2>Sports</a> <a href=3>Local news</a> <a href=4>Weather today</a></div><div><div>[[<h2>Market</h2><p>Prices "
    "fell.</p><p>Traders said that <a href=5>the harvest</a> was good and that they <b>expect</b> more of it.</p><blockquote>So it is.</blockquote><p>End."
    "</p>]]</div></div><div><a href=6>Terms</a> <a href=7>Privacy</a> <a href=8>About us</a></div></body>",
    "<body><main>[[<h1>Bread</h1><p>Take flour, water and salt.<br>Wait.</p><table><tr><td>flour</td><td>500</td></tr><tr><td>water</td><td>350</td></tr>"
    "</table><p>Bake it hot.</p>]]</main><section><p>Our shop has new ovens, tins, scales and bowls, all at a low price this week, come and see them in town."
    "</p></section></body>",
    "<div><span>Hello guest</span> <a href=a>Sign in</a></div><article><div>[[<p><b>Short piece.<br><p>Only this is said here, and it is not said "
    "twice.</p><h3>Why</h3><p>Because.</p>]]</div></article><div><span>All rights reserved by the town press company of the county</span></div>",
    "<body><p>You are reading the free edition of this paper, which shows one story a day to every guest.</p><article>[[<header><h1>Night</h1></header><p>The "
    "lamps went out at ten.</p><pre>ten  o'clock</pre><p>Nobody saw it, for all were asleep, and the watchman too.</p>]]</article><p>More from the same hand "
    "can be found in the list of all the stories of this year and of the years before.</p></body>",
    '<div class="x1"><div class="q7"><a href=1>Start</a> <a href=2>Harbour</a> <a href=3>Letters</a></div><div class="k2"><div>[[<h1>The harbour</h1><p>Ships came in at noon '
    "with the tide and left at dusk, as the master of the port had told us they would do.</p><p>One stayed.</p><p>Its crew had no papers, said the clerk, and so it lay "
    'there for a week.</p>]]</div></div><div class="z9"><div><a href=4>More ships</a></div><div><a href=5>More clerks</a></div></div></div>',
    '<body><div class="promotion-story"><div>[[<h2>Promoted</h2><p>The keeper of the light became the master of the port in spring, after ten years on the rock alone.</p>'
    '<div class="ad">Buy a lamp today</div><p>He keeps a lamp at home, too, and it burns all night, his sister says.</p>]]</div></div><div>All rights reserved</div></body>',
    '<body><section>[[<h1>Snow</h1><p>Snow fell on the pass and closed the road to all but sledges.</p>]]</section><div class="comments"><p>We drove there in spring and it was '
    "closed then as well, which nobody had told us at the inn where we had stayed the night before.</p><p>You should have asked the post, they know it all, as they drive there every day "
    "of the year, in snow and in rain and in sun.</p></div></body>",
)


def _never(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element's name, role or invisibility tells that it holds no article text."""
    if name in DROPPED or name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "role" and value in ROLES or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:[\s=/]|$)", re.sub(r"""("[^"]*"|'[^']*')""", "", attributes)))


def _hinted(name: str, attributes: str, inside: bool) -> bool:
    """Whether a class or id, or being a form, hints that an element holds no article text."""
    if name == "form":
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        if key.lower() not in ("class", "id"):
            continue
        parts = {x.lower() for x in _PART.findall("".join(values))}
        if (parts & NOISE or any(x.startswith(NOISE_STARTS) for x in parts)) and not parts & EXEMPT:
            return True
        if "header" in parts and not inside and not parts & {"article", "post", "entry"}:
            return True
    return False


class Page:
    """The tokens of a page with its hinted elements."""

    def __init__(self, html: str):
        #: Of each hinted element (0: the page): the one around it, and whether it lies in article or main.
        self.around, self.inside = [0], [True]
        self.marked = list(self._tokens(html))

    def _tokens(self, html: str) -> Iterator[tuple[str, str, int, bool]]:
        """(kind, text or tag, hinted element, whether the token opens it): kinds are v (words in article or main), w (other words), A (words of a link), X (an element that never holds text) or a tag's name, with + in article or main."""
        stack: list[tuple[str, bool, int]] = []
        opened: Counter[str] = Counter()
        dropped = hint = 0
        pos, n = 0, len(html)

        def within() -> bool:
            return bool(opened["article"] or opened["main"])

        def kind(name: str) -> str:
            return f"+{name}" if within() else name

        def close(name: str) -> None:
            nonlocal dropped, hint
            while stack:
                top, gone, own = stack.pop()
                opened[top] -= 1
                dropped -= gone
                if own:
                    hint = self.around[own]
                if top == name:
                    return

        while pos < n:
            m = _TAG.search(html, pos)
            text = html[pos : m.start()] if m else html[pos:]
            if text and not dropped:
                yield "A" if opened["a"] else "v" if within() else "w", _html.unescape(text) if "&" in text else text, hint, False
            if not m:
                return
            pos = m.end()
            if m["name"] is None:
                continue
            name = m["name"].lower()
            if m["end"]:
                was_dropped, was = dropped, hint
                if opened[name]:
                    close(name)
                if not was_dropped:
                    yield kind(name), name, was, False
                continue
            if opened["p"] and name in BLOCKS:
                close("p")
            elif name == "li" and opened["li"] and stack and stack[-1][0] == "li":
                close("li")
            gone = _never(name, m["rest"], within())
            holds = not (name in VOID or name in RAW or m["rest"].endswith("/") and name in ("svg", "path"))
            own = 0
            if not dropped and not gone and holds and _hinted(name, m["rest"], within()):
                self.around.append(hint), self.inside.append(within())
                own = hint = len(self.around) - 1
            if not dropped:
                yield "X" if gone else kind(name), name, hint, bool(own)
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}[^>]*>", re.I).search(html, pos)
                pos = end.end() if end else n
            if holds:
                stack.append((name, gone, own))
                opened[name] += 1
                dropped += gone

    def noise(self) -> list[bool]:
        """Of each hinted element whether it is what its name says: not if it has over TRUST words to one beside it, all within the next such element around it that isn't, and, outside article and main, none of theirs beside it."""
        words, article = [0] * len(self.around), [0] * len(self.around)
        for kind, text, hint, _ in self.marked:
            if kind in "vw":
                size = len(text.split())
                words[hint] += size
                article[hint] += size if kind == "v" else 0
        for k in range(len(words) - 1, 0, -1):
            words[self.around[k]] += words[k]
            article[self.around[k]] += article[k]
        out = [False]
        for k in range(1, len(words)):
            p = self.around[k]
            holds_all = words[k] > TRUST * (words[p] - words[k]) and (self.inside[k] or article[p] == article[k])
            out.append(out[p] or not holds_all)
        return out


def tokens(html: str) -> list[tuple[str, str]]:
    """(kind, text or tag) of a page's tokens; an element that is noise by its hint is one token X."""
    page = Page(html)
    noise = page.noise()
    # noise in noise is no token of its own
    return [("X" if opens and noise[hint] else kind, text) for kind, text, hint, opens in page.marked if not noise[hint] or opens and not noise[page.around[hint]]]


def best_run(scores: list[float]) -> tuple[int, int]:
    """The first contiguous run [start, end) of the highest positive sum; (0, 0) if there is none."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, at = total, (start, i + 1)
    return at


def _score(token: tuple[str, str], weights: dict[str, float]) -> float:
    kind, text = token
    return weights[kind] * len(text.split()) if kind in "vwA" else weights.get(kind, weights["+" if kind[0] == "+" else "?"])


def learn(pages: tuple[str, ...] = LABELLED, rounds: int = 60, rate: float = 0.05) -> dict[str, float]:
    """Weights by a structured perceptron: words stay positive (those of links may not), tags negative; v fixes the scale."""
    weights = {"v": 1.0, "w": 0.5, "A": -0.2, "X": -0.5, "?": -0.3, "+": -0.05}
    examples = []
    for page in pages:
        stream, gold = [], []
        start, end = page.index("[["), page.index("]]")
        marked = page[:start] + "\x01" + page[start + 2 : end] + "\x02" + page[end + 2 :]
        inside = False
        for kind, text in tokens(marked):
            if "\x01" in text or "\x02" in text:
                for part in re.split("([\x01\x02])", text):
                    if part in ("\x01", "\x02"):
                        inside = part == "\x01"
                    elif part:
                        stream.append((kind, part)), gold.append(inside)
                continue
            stream.append((kind, text)), gold.append(inside)
        at = gold.index(True), len(gold) - gold[::-1].index(True)
        examples.append((stream, at))
        for kind, _ in stream:
            weights.setdefault(kind, weights["+" if kind[0] == "+" else "?"])

    def amounts(run: list[tuple[str, str]]) -> Counter[str]:
        out: Counter[str] = Counter()
        for kind, text in run:
            out[kind] += len(text.split()) if kind in "vwA" else 1
        return out

    for _ in range(rounds):
        wrong = 0
        for stream, (start, end) in examples:
            found = best_run([_score(t, weights) for t in stream])
            if found == (start, end):
                continue
            wrong += 1
            want, got = amounts(stream[start:end]), amounts(stream[slice(*found)])
            for kind in want.keys() | got.keys():
                if kind == "v":
                    continue
                weights[kind] += rate * (want[kind] - got[kind]) * (0.2 if kind in "wA" else 4)
                weights[kind] = max(weights[kind], 0.2) if kind == "w" else min(weights[kind], 0.5 if kind == "A" else -0.02)
        if not wrong:
            break
    return weights


def extract(html: str | None, weights: dict[str, float]) -> str:
    """The main text: blocks of the best run in page order, joined by one line break."""
    if not html:
        return ""
    stream = tokens(html)
    start, end = best_run([_score(t, weights) for t in stream])
    blocks: list[str] = []
    parts: list[str] = []
    for kind, text in stream[start:end]:
        if kind in "vwA":
            parts.append(text)
        elif text in BLOCKS:
            blocks.append(" ".join("".join(parts).split()))
            parts = []
        elif text in SPACED:
            parts.append(" ")
    blocks.append(" ".join("".join(parts).split()))
    return "\n".join(b for b in blocks if b)


def extract_pages(pages: DataFrame, html: str = "html", into: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """pages with the main text of each row's html in the column `into`, in place of the html.

    A column of that name, and html itself, are replaced; all others stay. Every row gives one row.
    """
    small_batches(pages.sparkSession)
    weights = weights or learn()
    kept = [c for c in pages.columns if c not in (html, into)]
    source = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html}`").cast("string").alias("__html"))
    schema = pages.select(*[f"`{c}`" for c in kept]).schema.add(into, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array([extract(h, weights) for h in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], got], names=[*kept, into])

    return source.mapInArrow(run, schema)
