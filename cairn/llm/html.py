"""Main text of web pages: two-pass block rules by stop-word density, length and link density."""

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Elements whose whole content is no text of the page.
SKIPPED = frozenset("noscript template head button select option textarea iframe svg math object canvas audio video map dialog menu datalist".split())
#: Elements that tell of no article.
ASIDE = frozenset("nav footer aside form".split())
#: Elements whose content is raw, with their ends: markup inside isn't parsed.
RAW = {x: re.compile(rf"</{x}(?![a-z0-9])[^>]*>?", re.I) for x in "script style textarea title noscript iframe template".split()}
#: Blocks that hold text without being containers of other blocks.
PLAIN = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 td th tr pre blockquote".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meter nobr output picture progress q rb rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names in class, id or role, alone or as a part before or after - or _, that tell of no article.
MARKED = re.compile(
    r"(?:\w+[_-])?(?:ads?|advert|adverts|advertisement|banner|sponsor|sponsored|promo|cookie|cookies|consent|notice|gdpr|newsletter|subscribe|sidebar|comments?|respond|disqus|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|sharing|popup|modal|overlay|login|signup|pagination|pager|toolbar|complementary|contentinfo)(?:[_-]\w+)?",
    re.I,
)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)(?:>|(?=<)|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>\"']++))?")
TELLS = re.compile(r"class|id|role|style", re.I)
HIDES = re.compile(r"display\s*:\s*none", re.I)
#: The commonest words of the four languages of the corpus, as fixed values.
STOP = frozenset(
    "the of and to in a is it that was for on with as by at be this are from or an not they you have had but all he his she her we which their there been were will would what when can more if no out so who has its them than then "
    "der die das und ist nicht von zu mit ein eine im den dem des sich auf für als auch an es bei oder aus wie wird werden nach einer um am sind noch war hat "
    "le la les de des et est un une du en que qui dans pour pas sur au par plus avec ce il elle se sont ne son sa ses ou mais nous vous cette "
    "el los las una y que en por con para no del al lo como más pero sus este ya o cuando muy sin sobre también me hay donde fue son".split()
)
WORDS = re.compile(r"[^\W_]+", re.U)
WHITE = re.compile(r"\s+")
#: The published thresholds of this family of rules.
LONG, SHORT, LINKS, STOP_LOW, STOP_HIGH = 200, 70, 0.2, 0.30, 0.32


class Block:
    """A run of text between block-level tags. region: 0 none, 1 article, -1 what tags or names tell is none; step: containers opened or closed before it."""

    __slots__ = ("parts", "linked", "heading", "region", "step", "kind", "text", "length")

    def __init__(self, heading=False, region=0, step=0):
        self.parts, self.linked, self.heading, self.region, self.step = [], 0, heading, region, step


def _told(attributes: str):
    """(whether class, id or role name what is no article; whether the element is hidden)."""
    named, hidden = False, False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id", "role"):
            named = named or any(MARKED.fullmatch(x) for x in value.split())
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDES.search(value):
            hidden = True
    return named, hidden


def blocks(page: str) -> list:
    """The text blocks in page order, without what SKIPPED and hidden elements hold. Time and memory follow the page's length."""
    out, stack, open_, now = [], [], {}, Block()
    skip = away = article = step = at = breaks = 0
    link = None  # depth of the stack where an anchor was opened

    def close(heading=False):
        nonlocal now, step
        if now.parts:
            out.append(now)
            step = 0
        now = Block(heading)

    def put(raw):
        nonlocal breaks
        if raw and not skip:
            t = entities.unescape(raw)
            if not now.parts:
                if not t.strip():
                    return
                now.region, now.step = (1 if article and not away else -1 if away else 0), step
            breaks = breaks if t.isspace() else 0
            now.parts.append(t)
            if link is not None:
                now.linked += len("".join(t.split()))

    def pop():
        nonlocal skip, away, article, link, step
        tag, skipped, marked, before = stack.pop()
        open_[tag] -= 1
        skip -= skipped
        if tag in ("article", "main"):
            article, away = article - 1, before
        else:
            away -= marked
        if link is not None and link > len(stack):
            link = None
        step += tag not in PLAIN
        close()

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            if m[0].startswith("<![CDATA["):
                put(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                link = None if m[1] else len(stack)
            elif name == "img":
                put(" ")
            continue
        if name == "br":  # one is white space, two end a block
            breaks += 1
            close() if breaks > 1 else put(" ")
            continue
        if m[1]:
            if open_.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            else:
                close()
            continue
        if name in RAW:
            close()
            m = RAW[name].search(page, at)
            at = m.end() if m else end
            continue
        if stack and stack[-1][0] == "p":
            pop()
        if stack and name in ("li", "tr", "td", "th", "dt", "dd", "option") and stack[-1][0] == name:
            pop()
        close(name in HEADINGS)
        if name in VOID or m[3].endswith("/"):
            continue
        named, hidden = _told(m[3]) if TELLS.search(m[3]) else (False, False)
        marked = int(name in ASIDE or name == "header" and not article or named and name not in ("article", "main", "body", "html", *HEADINGS))
        skipped = int(name in SKIPPED or hidden)
        stack.append((name, skipped, marked, away))
        open_[name] = open_.get(name, 0) + 1
        skip += skipped
        if name in ("article", "main"):
            article, away = article + 1, 0 if name == "main" or not open_.get("aside") else away
        else:
            away += marked
        step += name not in PLAIN
    close()
    for b in out:
        b.text = WHITE.sub(" ", "".join(b.parts)).strip()
        b.length = len(b.text)
    return [b for b in out if b.text]


def first_labels(found: list, regions: bool = True) -> None:
    """Pass 1, each block by itself: good, near (probably good), short or low (undecided) or bad.

    Much linked text is bad, little text or few stop words leave a block undecided; the rest goes by length and by the density of stop words. An article's
    tag is evidence: it lowers what is asked, and leaves linked text undecided. What tags and names tell is none is bad.
    Where no block has the lower density of stop words the page's language is unknown, and length alone decides.
    """
    words = [WORDS.findall(b.text.lower()) for b in found]
    density = [sum(x in STOP for x in w) / len(w) if w else 0.0 for w in words]
    unknown = not any(d >= STOP_LOW and b.length >= SHORT for b, d in zip(found, density))
    for b, d in zip(found, density):
        linked = b.linked > LINKS * len("".join(b.text.split()))
        d = STOP_HIGH if unknown else d
        if regions and b.region < 0:
            b.kind = "bad"
        elif linked:
            b.kind = "short" if b.region > 0 else "bad"
        elif b.region > 0:
            b.kind = "good" if b.length >= SHORT or not unknown and d >= STOP_HIGH and len(b.text.split()) > 3 else "short"
        elif b.length < SHORT:
            b.kind = "short"
        elif d >= STOP_HIGH:
            b.kind = "good" if b.length > LONG else "near"
        else:
            b.kind = "near" if d >= STOP_LOW else "low"


def second_labels(found: list) -> None:
    """Pass 2: undecided blocks take the label of the nearest decided neighbours; those in the same container are nearer than others.

    The page's edges count as bad neighbours in other containers. Where both neighbours agree, that is the label, but low
    blocks need one of them in their own container. Where only one of two that differ stands in the block's container,
    its label holds. Otherwise near blocks are good, and so are headings before a good block and what stands in an
    article; short and low ones are bad. On a page without any decided block all undecided ones are good.
    """
    n, place = len(found), []
    for b in found:
        place.append((place[-1] if place else 0) + b.step)
    kinds = [b.kind for b in found]
    decided = [i for i in range(n) if kinds[i] in ("good", "bad")]
    before, after = [None] * n, [None] * n
    for order, to in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = None
        for i in order:
            to[i] = last
            if kinds[i] in ("good", "bad"):
                last = i
    for i, b in enumerate(found):
        if kinds[i] in ("good", "bad"):
            continue
        if not decided:
            b.kind = "good"
            continue
        (left, near_left), (right, near_right) = ((kinds[x] if x is not None else "bad", x is not None and place[x] == place[i]) for x in (before[i], after[i]))
        if b.region > 0 and not (near_left or near_right):
            b.kind = "good"  # an article of undecided blocks alone
        elif left == right:
            b.kind = left if kinds[i] != "low" or near_left or near_right or b.region > 0 else "bad"
        elif near_left != near_right:
            b.kind = left if near_left else right
        else:
            b.kind = "good" if kinds[i] == "near" or b.region > 0 or b.heading and right == "good" else "bad"


def classify(found: list) -> None:
    """Both passes. Where tags and names leave nothing good (a page inside one form, say), the rules decide without them."""
    for regions in (True, False):
        first_labels(found, regions)
        second_labels(found)
        if any(b.kind == "good" for b in found):
            return


def main_text(page: str | None) -> str:
    """The article's blocks, joined by one newline; empty for null, empty or article-less pages."""
    found = blocks(page or "")
    classify(found)
    return "\n".join(b.text for b in found if b.kind == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, repeated rows included; whole pages are read, and no other column."""

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    x = pages.select("page_id", "url", "html")
    return x.mapInArrow(run, pages.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema)
