"""Main text of web pages by tree scoring.

A page is tokenised in one pass into nodes in page order, with the end tags that HTML leaves out implied. Each run of
text between block boundaries is a paragraph. Paragraphs pass points for their length and commas to their ancestors,
half as many with each level; a container's points are discounted by its share of link text. The best container and
those of its siblings that score near it, or are plain prose, are kept, and their blocks are joined in page order.
Subtrees that are no article (menus, forms, comments and so on, by tag, role or class) are left out first.

Defined results: null or empty html, and pages without text, give an empty text; pages without a long paragraph give
the text of their article, main or body element; unclosed comments and raw-text elements run to the end of the page;
white space of any kind, line breaks and ``br`` within a block are one space. No recursion, so depth is not limited.
Further columns are ignored by the query and kept by :func:`with_main_text`.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches

# Element names of the HTML standard by their role, and words of class, id and role attributes. The words name
# menus, headers, footers, sidebars, notices, adverts and reader comments, nothing else.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
LEAF = frozenset("p pre td th li blockquote h1 h2 h3 h4 h5 h6 dd dt figcaption caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("html head body option optgroup caption tbody td tfoot th thead tr legend".split())
#: Opening one of the keys ends an open element of the first group, unless one of the second lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "body": ({"head"}, {"html"}),
}
BARRIERS = frozenset("table td th caption button object".split())
OUT_TAGS = frozenset("head nav footer aside form button select option dialog menu object canvas audio video map search fieldset input datalist".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist status".split())
OUT_WORDS = frozenset(
    "nav navbar navigation menu sidebar sidenav aside footer header masthead topbar banner cookie cookies consent gdpr notice notices alert popup modal overlay ad ads adv advert adverts advertisement "
    "advertising adslot adsense sponsor sponsored sponsors promo promotion promoted comment comments commentlist disqus respond reply replies discussion "
    "breadcrumb breadcrumbs pagination pager toolbar copyright disclaimer outbrain taboola".split()
)
#: First words of class names that tell what a page has or lacks, not what the element is.
HAS_WORDS = frozenset("no not non with without has have hide show is".split())
#: Words of a heading's wrapper, whose headings stay within an article.
HEADER_WORDS = frozenset("header masthead topbar".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies".split())
GOOD_WORDS = frozenset("article content main post entry body story text page hentry blog prose".split())

LEAST_CHARS = 25
_TOKEN = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[!?/][^>]*>)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Nodes in page order, as parallel lists, and paragraphs (owner node, text, characters in links)."""

    def __init__(self, html: str):
        self.tags, self.parents, self.attributes = ["#root"], [-1], [""]
        self.paragraphs: list[tuple[int, str, int]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        tags, parents, attributes = self.tags, self.parents, self.attributes
        stack, at, anchors = [0], 0, 0
        where: dict[str, list[int]] = {}  # places in the stack of the open elements of each name
        blocks: list[int] = []  # and of the open blocks
        run: list[tuple[str, bool]] = []

        def flush() -> None:
            if run:
                text = " ".join("".join(t for t, _ in run).split())
                if text:
                    owner = stack[blocks[-1]] if blocks else 0
                    links = sum(len(" ".join(t.split())) for t, a in run if a)
                    self.paragraphs.append((owner, text, min(links, len(text))))
                run.clear()

        def pop_to(k: int) -> None:
            nonlocal anchors
            if blocks and blocks[-1] >= k:
                flush()
                while blocks and blocks[-1] >= k:
                    blocks.pop()
            for i in stack[k:]:
                where[tags[i]].pop()
            anchors = len(where.get("a", ()))
            del stack[k:]

        def innermost(names) -> int:
            return max((where[t][-1] for t in names if where.get(t)), default=0)

        def close(names, barriers) -> None:
            k = innermost(names)
            if k and k > (blocks[-1] if barriers is BLOCK and blocks else innermost(barriers)):
                pop_to(k)

        n = len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                run.append((entities.unescape(html[at:lt]), anchors > 0))
            if lt == n:
                break
            m = _TOKEN.match(html, lt)
            if m is None:  # a lone < is text; an unfinished tag at the end is dropped
                if re.match(r"</?[a-zA-Z!?]", html[lt : lt + 3]) and html.find(">", lt) < 0:
                    break
                run.append(("<", anchors > 0))
                at = lt + 1
                continue
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                if name == "p" and not where.get("p"):
                    flush()
                elif name == "br":
                    run.append((" ", False))
                elif name in BLOCK or name == "a":
                    close({name} if name not in HEADINGS else HEADINGS, BARRIERS - {name} if name not in ("table", "article", "div", "section", "main", "body", "html", "ul", "ol", "tr", "tbody", "thead", "tfoot") else ())
                else:
                    close({name}, BLOCK)
                continue
            if name == "br":
                run.append((" ", False))
                continue
            if name in BLOCK:
                flush()
            if name in CLOSES_P:
                close({"p"}, BARRIERS)
            if name in ENDS:
                close(*ENDS[name])
            if name in HEADINGS and tags[stack[-1]] in HEADINGS:
                pop_to(len(stack) - 1)
            if name == "a" and anchors:
                close({"a"}, BARRIERS)
            text = m[3] if m[3] is not None else m[6] or ""
            if name in VOID:
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)  # a slash before > closes nothing here
                if end is None:
                    break
                at = html.find(">", end.end())
                at = n if at < 0 else at + 1
                continue
            tags.append(name)
            parents.append(stack[-1])
            attributes.append(text)
            where.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                blocks.append(len(stack))
            stack.append(len(tags) - 1)
            anchors = len(where.get("a", ()))
        flush()


def _names(value: str) -> list[set[str]]:
    """The words of each class name, without names of what the page has or lacks (with-sidebar, no-ads)."""
    words = [[w.lower() for w in _CAMEL.findall(name)] for name in value.split()]
    return [set(w) for w in words if w and not (len(w) > 1 and w[0] in HAS_WORDS)]


def _unwanted(page: Page) -> tuple[list[int], list[bool]]:
    """For each node 2 if it is no part of an article, 1 if its class alone says so (-1: a class of comments), else 0; and whether it is a header of an article, of which headings stay."""
    out, header = [], [False] * len(page.tags)
    inside = [False] * len(page.tags)  # within an article or main element
    for i, (tag, parent, attributes) in enumerate(zip(page.tags, page.parents, page.attributes, strict=True)):
        inside[i] = tag in ("article", "main") or (parent >= 0 and inside[parent])
        header[i] = tag == "header"
        sort = 2 if tag in OUT_TAGS or (tag == "header" and not inside[i]) else 0
        if attributes and not sort:
            names: list[set[str]] = []
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                value = a or b or c
                name = name.lower()
                if name in ("class", "id"):
                    names += _names(value)
                elif name == "role":
                    sort = max(sort, 2 * (value.strip().lower() in OUT_ROLES))
                elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                    sort = 2
            words = set().union(*names)
            bad = words & OUT_WORDS
            if not sort and bad and tag not in ("html", "body", "main") and not (tag == "article" and words & GOOD_WORDS and not words & COMMENT_WORDS):
                if inside[i] and tag != "article" and bad <= HEADER_WORDS:
                    header[i] = True
                elif not (tag in LEAF and not any(n <= OUT_WORDS for n in names)) and not (tag == "section" and inside[i] and bad == {"discussion"}):
                    sort = -1 if bad & COMMENT_WORDS else 1  # a paragraph's class has to say nothing else; an article's section may be its discussion
        out.append(sort)
    return out, header


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in page order, one a line."""
    if not html:
        return ""
    page = Page(html)
    tags, parents, paragraphs = page.tags, page.parents, page.paragraphs
    size = len(tags)
    out, header = _unwanted(page)

    def carried(start: list) -> list:
        for i in range(1, size):
            start[i] = start[i] or start[parents[i]]
        return start

    # A container that is unwanted by its class alone but holds an article, or most of the prose of what is around it (the nearest article or main, else the page), is a wrapper.
    # Comments may well be longer than what they are on, so these have to be nearly all of it.
    prose = [0] * size
    surely = carried([x == 2 for x in out])
    for owner, text, links in paragraphs:
        if not surely[owner] and len(text) >= LEAST_CHARS:
            prose[owner] += len(text) - links
    for i in range(size - 1, 0, -1):
        prose[parents[i]] += prose[i]
    holds = [False] * size
    for i in range(size - 1, 0, -1):
        holds[parents[i]] = holds[parents[i]] or holds[i] or (tags[i] in ("article", "main") and out[i] == 0)
    around = [0] * size
    for i in range(1, size):
        around[i] = parents[i] if tags[parents[i]] in ("article", "main") else around[parents[i]]
    wraps = [holds[i] or ((around[i] > 0 or not holds[0]) and 20 * prose[i] > (19 if out[i] < 0 else 14) * max(prose[around[i]], 1)) for i in range(size)]
    unwanted = carried([x == 2 or (x != 0 and not wraps[i]) for i, x in enumerate(out)])
    header = carried(header)
    live = [(o, t, l) for o, t, l in paragraphs if not unwanted[o] and (not header[o] or tags[o] in HEADINGS)]
    if not live:
        return ""

    chars, linked, points = [0] * size, [0] * size, [0.0] * size
    for owner, text, links in live:
        chars[owner] += len(text)
        linked[owner] += links
        if len(text) >= LEAST_CHARS and tags[owner] not in HEADINGS:
            gain = (1 + text.count(",") + text.count("、") + text.count("،") + min(len(text) / 100, 3)) * (1 - links / len(text))
            node, share = parents[owner] if tags[owner] in LEAF else owner, 1.0
            while node > 0 and share > 0.05:
                points[node] += gain * share
                node, share = parents[node], share / 2
    for i in range(size - 1, 0, -1):
        chars[parents[i]] += chars[i]
        linked[parents[i]] += linked[i]
    density = [linked[i] / chars[i] if chars[i] else 0.0 for i in range(size)]
    scores = [0.0 if unwanted[i] else points[i] * (1 - density[i]) * (1.25 if tags[i] in ("article", "main") else 1.0) for i in range(size)]
    named = [i for i in range(size) if tags[i] in ("article", "main") and not unwanted[i] and chars[i]]
    if named:  # where a page names its article, containers outside it aren't candidates, unless the named are teasers beside most of the prose
        within = [False] * size
        for i in named:
            within[i] = True
        within = carried(within)
        own = sum(len(t) - l for o, t, l in live if within[o] and len(t) >= LEAST_CHARS)
        if 4 * own >= sum(len(t) - l for o, t, l in live if len(t) >= LEAST_CHARS):
            scores = [x if y else 0.0 for x, y in zip(scores, within, strict=True)]
        else:
            named = []
    best = max(range(size), key=lambda i: (scores[i], -i))
    chosen = [False] * size
    if scores[best] <= 0:
        chosen[max(named, key=lambda i: (chars[i], -i)) if named else 0] = True
    else:
        top, node = best, parents[best]
        while node > 0:  # the article around the best container holds its title
            if tags[node] in ("article", "main") and density[node] < 0.5 and (tags[node] == "article" or tags[top] != "article"):
                top = node
            node = parents[node]
        chosen[top] = True
        least = max(10.0, 0.2 * scores[best])
        direct = {}
        for owner, text, links in live:
            direct.setdefault(owner, []).append((text, links))
        for i in range(1, size):
            if parents[i] == parents[top] and i != top and not unwanted[i]:
                prose_like = tags[i] in LEAF and any((len(t) > 80 and 4 * l < len(t)) or (not l and len(t) <= 80 and t.rstrip()[-1:] in ".!?") for t, l in direct.get(i, ()))
                chosen[i] = scores[i] >= least or (prose_like and tags[i] not in HEADINGS) or (tags[i] == "h1")
    chosen = carried(chosen)
    return "\n".join(text for owner, text, _ in live if chosen[owner])


def with_main_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``df`` without ``html``, with the main text in ``out`` and its number of code points in ``n_chars``."""
    bounded_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["_fw_row", "_fw_text", "_fw_n"])

    others = [c for c in df.columns if c not in (html, out, "n_chars")]
    packed = df.select(F.struct(*(others or [F.lit(0).alias("_fw_none")])).alias("_fw_row"), F.col(html).cast("string").alias("_fw_html"))
    made = packed.mapInArrow(run, f"_fw_row {packed.schema['_fw_row'].dataType.simpleString()}, _fw_text string, _fw_n long")
    return made.select(*[f"_fw_row.{c}" for c in others], F.col("_fw_text").alias(out), F.col("_fw_n").alias("n_chars"))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
