"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  The first pass decides blocks by
themselves: link density, length and the share of stop words make a block good,
bad or ambiguous.  In the second pass an ambiguous block inherits the label of
its nearest decided neighbour.  Only four languages have a stop word list; a page
that as a whole has few of these words is judged by length and link density
alone.  Blocks inside elements that never hold an
article's text (menus, footers, forms, adverts, reader comments and so on, by
tag or by class, id and role) are out before the rules apply, so they are no
neighbours either.  A name may also stand on an element that wraps the article:
an element that holds it, or most of the page's good text, stays.  Inside an article
few names decide by themselves: there a section may well be called ``menu`` or
``related-work``.  Other names only make their short blocks and links bad; headings
and paragraphs are never out by name in an article.  What is hidden (``hidden``,
``display: none``, ``visibility: hidden``) is out anywhere.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks shorter than SHORT characters are ambiguous; LONG ones are decided.
SHORT, LONG = 70, 200
#: A larger share of characters inside links makes a block bad.
LINKS = 0.5
#: Shares of stop words: from HIGH a long block is good, below LOW it is bad.
LOW, HIGH = 0.12, 0.20
#: In an article a heading looks this many blocks ahead.
AHEAD = 3

#: Frequent function words of four languages, fixed values.
STOP_WORDS = frozenset(
    """
    a about after all an and any are as at be been but by can could did do for from had has have he her his how i if in
    into is it its like more my no not of on one or our out said she so some than that the their them then there they
    this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die ein eine einem einen einer es für hat ich ihr im
    ist mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war was wenn wer wie wir zu
    zum zur
    au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou où
    par pas plus pour qu que qui sa se ses son sont sur un une vous
    al como con del el ella en entre era es esta este fue ha hay la las lo los más mi muy no nos o para pero por que se
    ser si sin sobre su sus también un una y ya
    """.split()
)
RAW = frozenset("script style noscript iframe textarea template svg math object canvas".split())
OUT_TAGS = frozenset("head nav footer aside form select button dialog menu fieldset".split())
CONTAINERS = frozenset("html body head div section article main nav header footer aside form select button dialog menu fieldset ul ol dl table tbody thead tr figure details".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre address hr figcaption caption summary center option label legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|copyright|disclaimer|disqus|dropdown|foot|footer|gdpr|header|login"
    r"|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|overlay|pager|pagination|popup|promo\w*|recommended|related|replies|reply|respond"
    r"|search|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
#: Parts of names that say nothing about the element itself: what a page has, prefixes of page builders, heading wrappers.
IGNORED = re.compile(
    r"(?<!\S)(?:(?:has|no|not|with|without|hide)[-_]\S+|(?:elementor|siteorigin|so|fl|jet)-widget-?"
    r"|(?:entry|article|post|story|content|blog|news)[-_]+header(?!\S))",
    re.I,
)
#: In an article these wrap headings too.
ARTICLE_IGNORED = re.compile(r"(?<!\S)(?:page|section|single|title|headline)[-_]+header(?!\S)", re.I)
#: Elements that hold much text that isn't the article's; they stay only around the article itself.
STRICT_TAGS = frozenset("nav footer aside dialog menu".split())
STRICT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|comments?|consent|cookies?|copyright|disclaimer|disqus|foot|footer|gdpr|modal|newsletter|overlay|popup|promo\w*"
    r"|recommended|related|replies|reply|respond|sponsor\w*)(?:$|[\s_-])",
    re.I,
)
#: In an article only these names decide: notices, adverts, comments and the like, as words of a name,
#: and a few others as a name of their own, before a word for what they hold, or as its last word.
DECIDING_NAMES = re.compile(
    r"(?:^|[\s_-])(?:advert\w*|comments?|consent|cookies?|copyright|disclaimer|disqus|foot|footer|gdpr|modal|newsletter|notices?|overlay|popup|promo\w*|replies|respond|sidebar|signup|sponsor\w*|subscribe)(?:$|[\s_-])"
    r"|(?:^|[\s_-])(?:ads?|related|recommended|reply)(?:(?!\S)|[-_](?:articles?|banner|block|box|container|content|items?|links?|list|news|pages?|posts?|products?|slot|stories|topics?|unit|wrapper)(?!\S))",
    re.I,
)
#: Leaf blocks of running text are out by names of their own only.
OWN_NAMES = re.compile(r"(?<!\S)(?:ads?|advert\w*|breadcrumbs?|comments?|consent|cookies?|copyright|disclaimer|footer|newsletter|notices?|pagination|promo\w*|related|share|sharing|sponsor\w*|subscribe)(?!\S)", re.I)
RUNNING = frozenset("p blockquote pre".split())
_HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
#: How firmly an element is out.
IN, WRAPPER, STRICT, NEVER = range(4)
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

#: Scripts whose letters stand for a syllable or a word and need no spaces; each counts twice.
WIDE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|[^<]+|<""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}


def _attributes(attrs: str) -> list[tuple[str, str]]:
    return [(name.lower(), "".join(values)) for name, *values in _ATTRIBUTE.findall(attrs)]


def _is_hidden(attrs: str) -> bool:
    """Whether an element says that it isn't shown; most have no attribute that could."""
    low = attrs.lower()
    if "hidden" not in low and "none" not in low:
        return False
    return any(name == "hidden" or name == "style" and _HIDING.search(value) for name, value in _attributes(attrs))


def _is_out(tag: str, attrs: str, in_article: bool) -> tuple[int, bool]:
    """Whether an element never holds the text of an article, and how firmly; else whether its name is suspect."""
    level, suspect = IN, False
    if tag in OUT_TAGS or tag == "header" and not in_article:
        level = STRICT if tag in STRICT_TAGS else WRAPPER if tag in ("form", "fieldset", "header") else NEVER
    if attrs and tag not in ("html", "body"):
        if _is_hidden(attrs):
            return NEVER, False
        for name, value in _attributes(attrs):
            if name in ("class", "id") and tag not in ("main",) and not (in_article and value.lower() == "header"):
                own = IGNORED.sub(" ", value)
                if tag == "header" and level == WRAPPER and own != value and not OUT_NAMES.search(own):
                    level = IN
                if in_article:
                    own = ARTICLE_IGNORED.sub(" ", own)
                if tag in HEADINGS or tag in RUNNING and in_article:
                    # Text of its own: the rules alone decide.
                    suspect |= bool(tag in RUNNING and OWN_NAMES.search(own))
                elif tag in RUNNING:
                    level = max(level, WRAPPER if OWN_NAMES.search(own) else IN)
                elif OUT_NAMES.search(own):
                    if in_article and not DECIDING_NAMES.search(own):
                        suspect = True
                    else:
                        level = max(level, STRICT if STRICT_NAMES.search(own) else WRAPPER)
            if name == "role" and value.lower() in OUT_ROLES:
                level = max(level, WRAPPER if value.lower() in ("form", "search") else STRICT)
            if name == "aria-hidden" and value.lower() == "true":
                level = max(level, STRICT)
    return level, suspect


class _Out:
    """An element that is out, below the next such element around it.

    Good characters and article text in it count without inner elements that are
    out; ``article`` and ``main`` tell whether it is or holds such an element.
    """

    __slots__ = ("parent", "level", "main", "article", "lifted", "size", "text", "sum", "any", "reach")

    def __init__(self, parent: _Out | None, level: int):
        self.parent, self.level, self.main, self.article, self.lifted = parent, level, False, False, False
        self.size, self.text = 0, False


class _Block:
    __slots__ = ("parts", "linked", "heading", "article", "suspect", "out")

    def __init__(self, heading: bool, article: bool, suspect: bool, out: _Out | None):
        self.parts, self.linked, self.heading, self.article, self.suspect, self.out = [], 0, heading, article, suspect, out


def _reach(outs: list[_Out], through: Callable[[_Out], bool]) -> None:
    """Mark the elements where they and all around them are passed through."""
    for o in outs:
        o.reach = through(o) and (o.parent is None or o.parent.reach)


def _sums(outs: list[_Out], through: Callable[[_Out], bool], lifts: Callable[[_Out], bool]) -> None:
    """Lift elements, inner ones first, by the sums over what they hold and what is passed through."""
    for o in outs:
        o.sum, o.any = o.size, o.text
    for o in reversed(outs):
        o.lifted = o.lifted or lifts(o)
        if o.parent and through(o):
            o.parent.sum += o.sum
            o.parent.any |= o.any


def _lift(rows: list[tuple[tuple[str, int, bool, bool, bool], _Out | None]], outs: list[_Out]) -> None:
    """Mark the elements that are out by name but hold the article.

    That is a main element; an article, where no article's text is outside; or
    most of the good text.  Strict ones need that nothing good is outside.
    """
    lifted = lambda o: o.lifted
    passed = lambda o: o.lifted or o.level == WRAPPER
    for o in outs:
        o.lifted = o.main
    _reach(outs, passed)
    unlisted = _is_unlisted([row for row, out in rows if out is None or out.reach])
    free, free_text = 0, False
    for row, out in rows:
        label = _first_label(*row, unlisted)
        size = len(row[0]) if label or label is None and not row[2] and len(row[0]) >= SHORT else 0
        text = row[3] and not _linked(row[0], row[1])
        if out is None:
            free, free_text = free + size, free_text or text
        else:
            out.size, out.text = out.size + size, out.text or text

    def outside(through: Callable[[_Out], bool] = lifted) -> tuple[int, bool]:
        _reach(outs, through)
        return free + sum(o.size for o in outs if o.reach), free_text or any(o.text for o in outs if o.reach)

    if not outside()[1]:
        _sums(outs, lifted, lambda o: o.level == WRAPPER and o.article and o.any)
    if not outside()[1]:
        good = outside(passed)[0]
        _sums(outs, passed, lambda o: o.level == WRAPPER and 2 * o.sum > good)
    if not outside()[0]:
        _sums(outs, lifted, lambda o: o.level == WRAPPER and o.sum > 0)
    if not outside()[0]:
        _sums(outs, lifted, lambda o: o.level == STRICT and o.article and o.any)
    _reach(outs, lifted)


def blocks(page: str) -> Iterator[tuple[str, int, bool, bool, bool]]:
    """(text, characters in links, is a heading, is in an article, has a suspect name) of each block kept."""
    stack: list[tuple[str, _Out | None, bool]] = []  # open containers, whether they are out, or suspect
    unclosed: set[str] = set()
    open_names: Counter[str] = Counter()
    outs: list[_Out] = []
    over: _Out | None = None
    articles = links = never = suspects = 0
    block = _Block(False, False, False, over)
    found: list[_Block] = []

    def new(heading: bool = False, suspect: bool = False) -> None:
        nonlocal block
        if block.parts:
            found.append(block)
        block = _Block(heading, articles > 0, suspect or suspects > 0, over)

    def pop() -> None:
        nonlocal over, articles, never, suspects
        name, out, suspect = stack.pop()
        suspects -= suspect
        open_names[name] -= 1
        if out:
            over = out.parent
            never -= out.level == NEVER
        articles -= name in ("article", "main")

    at = 0
    while token := _TOKEN.match(page, at):
        at = token.end()
        tag = token["tag"]
        if tag is None:
            if not never and not token[0].startswith(("<!", "<?")):
                text = html.unescape(token[0])
                block.parts.append(text)
                if links:
                    block.linked += len("".join(text.split()))
            continue
        tag, ends = tag.lower(), bool(token["end"])
        if tag in RAW and not ends:
            if not token["attrs"].endswith("/") or tag in ("script", "style", "textarea"):
                close = _RAW_END[tag].search(page, at)
                at = close.end() if close else len(page)
            continue
        if tag == "a":
            links = max(0, links + (-1 if ends else 1)) if ends else 1
            continue
        if tag == "br":
            block.parts.append(" ")
            continue
        if tag in BLOCKS:
            if tag == "body" and not ends:
                while stack and stack[-1][0] == "head":
                    pop()
            if tag in CONTAINERS:
                if not ends:
                    level, suspect = _is_out(tag, token["attrs"], articles > 0)
                    out = _Out(over, level) if level else None
                    suspects += suspect
                    stack.append((tag, out, suspect))
                    open_names[tag] += 1
                    if out:
                        outs.append(out)
                        over = out
                        never += level == NEVER
                    if tag in ("article", "main"):
                        o = over
                        while o and not (o.main if tag == "main" else o.article):
                            o.article, o.main = True, o.main or tag == "main"
                            o = o.parent
                    articles += tag in ("article", "main")
                elif open_names[tag]:
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                links = 0
            leaf = _is_out(tag, token["attrs"], articles > 0) if tag not in CONTAINERS and not ends and token["attrs"] and not never else (IN, False)
            if leaf[0]:
                # A leaf block that is out ends at its own end tag or at the next block.
                new()
                nxt = re.compile(rf"</{tag}\b[^>]*>|<(?=(?:{'|'.join(sorted(BLOCKS))})\b)", re.I).search(page, at)
                at = (nxt.end() if nxt[0].startswith("</") else nxt.start()) if nxt else len(page)
                continue
            new(tag in HEADINGS and not ends, leaf[1])
        elif token["attrs"] and not ends and tag not in _VOID and tag not in unclosed and _is_hidden(token["attrs"]):
            at = _past(page, at, tag)
            if at < 0:
                at = token.end()
                unclosed.add(tag)
    new()
    rows = []
    for b in found:
        text = " ".join("".join(b.parts).split())
        if text:
            rows.append(((text, b.linked, b.heading, b.article, b.suspect), b.out))
    if outs:
        _lift(rows, outs)
    for row, out in rows:
        if out is None or out.reach:
            yield row


def _past(page: str, at: int, tag: str) -> int:
    """Where an inline element that is open ends, inner ones of its name included; -1 if it never does."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return -1


def _linked(text: str, linked: int) -> bool:
    return linked > LINKS * len(text.replace(" ", ""))


def _stop_words(text: str) -> tuple[int, int]:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words), len(words)


def _is_unlisted(found: list[tuple[str, int, bool, bool, bool]]) -> bool:
    """Whether the stop words say nothing about a page whose text is outside article and main.

    A page in a listed language has a share of HIGH or more in its text as a whole.
    """
    texts = [(text, article) for text, linked, _, article, _ in found if not _linked(text, linked)]
    if 2 * sum(len(text) for text, article in texts if article) >= sum(len(text) for text, _ in texts):
        return False
    counts = [_stop_words(text) for text, _ in texts if len(text) + len(WIDE.findall(text)) >= SHORT]
    return sum(n for n, _ in counts) < HIGH * sum(n for _, n in counts)


def _first_label(text: str, linked: int, heading: bool, article: bool, suspect: bool = False, unlisted: bool = False) -> bool | None:
    """Good, bad, or None where a block alone doesn't tell."""
    size = len(text) + len(WIDE.findall(text)) if unlisted else len(text)
    if _linked(text, linked):
        return False
    if suspect and not heading and size < SHORT:
        return False
    if heading or size < SHORT:
        return False if linked and not article else None
    if unlisted:
        return True
    stops, words = _stop_words(text)
    density = stops / words
    if size >= LONG and density >= HIGH:
        return True
    if density >= LOW or article:
        return None if size < LONG else True
    return False


def _inherit(labels: list[bool | None], flags: list[tuple[bool, bool]]) -> list[bool]:
    """The second pass: the nearest decided label, an article's text where none is near.

    A heading takes the next decided label, the previous one where none follows.
    """
    n = len(labels)
    before, after, last = [None] * n, [None] * n, None
    for i in range(n):
        before[i] = last
        last = i if labels[i] is not None else last
    last = None
    for i in reversed(range(n)):
        after[i] = last
        last = i if labels[i] is not None else last
    out, undecided = [], all(x is None for x in labels)
    for i, label in enumerate(labels):
        if label is None:
            heading, article = flags[i]
            # Neighbours outside the article say nothing about what is in it.
            prev = before[i] if before[i] is not None and (not article or flags[before[i]][1]) else None
            nxt = after[i] if after[i] is not None and (not article or flags[after[i]][1]) else None
            if heading and article:
                label = labels[nxt] if nxt is not None and nxt - i <= AHEAD else True
            elif heading and (nxt is not None or prev is not None):
                label = labels[nxt if nxt is not None else prev]
            elif prev is None and nxt is None:
                label = article or undecided
            elif prev is None or nxt is None:
                label = labels[nxt if prev is None else prev]
            elif i - prev == nxt - i:
                label = (labels[prev] or labels[nxt]) if article else (labels[prev] and labels[nxt])
            else:
                label = labels[prev if i - prev < nxt - i else nxt]
        out.append(bool(label))
    return out


def main_text(page: str | None) -> str:
    """The main text of one page, blocks joined by an empty line."""
    found = list(blocks(page or ""))
    unlisted = _is_unlisted(found)
    labels = _inherit([_first_label(*b, unlisted) for b in found], [(b[2], b[3]) for b in found])
    return "\n\n".join(b[0] for b, good in zip(found, labels) if good)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text and n_chars, its code points.

    A null or empty html gives an empty text.  Markup may be cut off anywhere:
    an unfinished tag or comment is dropped.  The whole html is read and nothing
    of the text found is dropped or capped.  Repeated rows each get a row; ids
    and urls may be null; other columns are ignored; an empty table gives no
    rows.  Where two neighbours are equally near, an article's block is good if
    one of them is, another block if both are.
    """
    rows = pages.select("page_id", "url", "html")
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string"
    return rows.mapInArrow(_extract, schema).withColumn("n_chars", F.length("text").cast("long"))
