"""Main text of HTML pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks of text at every block-level tag. A block is described by
the word counts and link densities of itself and its neighbours and by where it stands
(in an article, in a menu, under a name that tells of adverts, ...). A decision tree,
grown on the small table of labelled blocks below, says which blocks are main text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Elements that don't end a block of text, elements whose content is no text of the page, elements without an end tag.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("script style noscript template svg math head title iframe object canvas audio video select option textarea button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset("article main".split())
FRAME = frozenset("nav header footer aside form menu dialog fieldset figure".split())
#: Those of them that an article may not stand in; a form or a header may hold the whole page.
APART = FRAME - {"form", "header"}
#: Words in class, id or role that tell of something beside the main text.
BESIDE = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side|nav\w*|menu|breadcrumb\w*|header|masthead|foot\w*|cookie\w*|consent|"
    r"notice|alert|popup|modal|newsletter|subscribe|signup|login|share|social|related|recommend\w*|comment\w*|replies|reply|respond|widget|"
    r"copyright|legal|disclaimer|toolbar|search|pager|pagination|tags?|meta|byline|complementary|contentinfo|navigation|search|form)(?:$|[-_ ])"
)
#: Those of them that tell so of an article, too; the others may name a whole page, as on a page of search results.
ASIDE = re.compile(r"(?:^|[-_ ])(?:ads?|advert\w*|sponsor\w*|promo\w*|related|recommend\w*|comment\w*|replies|reply|respond)(?:$|[-_ ])")
CONTENT = re.compile(r"(?:^|[-_ ])(?:article\w*|content|main|post|entry|story|text|body)(?:$|[-_ ])")
#: Only these can stand in a head; any other tag ends one that is open.
IN_HEAD = frozenset("title meta link base basefont bgsound style script noscript template noframes".split())
#: These can't stand in each other: the next one ends the one before.
SIBLINGS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: An element that lacks its end tag is not looked for beyond these.
WALLS = ("ul", "ol", "table", "div", "article", "dl", "section")

FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "beside", "in_article", "in_content", "heading",
)


class Blocks(HTMLParser):
    """Collects (text, words, words in links, beside, in_article, in_content, heading) for every flat block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # Open elements: tag, and whether it is beside, in an article, in content, in something that is beside any article.
        self.open: list[tuple[str, bool, bool, bool, bool]] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # where a tag is open; "" is any tag that ends a block
        self.silent, self.link, self.heading = 0, 0, 0
        self.parts: list[tuple[str, bool]] = []
        self.found: list[tuple] = []

    def state(self) -> tuple[bool, bool, bool, bool]:
        return self.open[-1][1:] if self.open else (False, False, False, False)

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element with one of these tags, -1 if there is none."""
        return max((self.places[tag][-1] for tag in tags if self.places.get(tag)), default=-1)

    def flush(self) -> None:
        text = " ".join("".join(part for part, _ in self.parts).split())
        if text:
            linked = sum(len(part.split()) for part, is_link in self.parts if is_link)
            count = len(text.split())
            self.found.append((text, count, min(linked, count), *self.state()[:3], self.heading > 0))
        self.parts = []

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Sections such as ``<![CDATA[ ]]>`` and declarations of unknown kind are comments."""
        if not self.rawdata.startswith("<![CDATA[", i):
            return self.parse_bogus_comment(i, 0)
        end = self.rawdata.find("]]>", i)
        return end + 3 if end >= 0 else -1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.flush()
        if tag not in IN_HEAD:  # the end tag of the head was left out
            self.end_head()
        if tag in VOID:
            return
        if tag in SIBLINGS:  # an end tag was left out
            before = self.last(SIBLINGS[tag])
            if before > self.last(WALLS):
                self.end(before)
        beside, article, content, aside = self.state()
        names = " ".join(v for k, v in attrs if v and k in ("class", "id", "role")).lower()
        hidden = any(k == "hidden" or (k == "style" and v and "display:none" in v.replace(" ", "").lower()) for k, v in attrs)
        if tag in ("html", "body"):
            names = ""
        aside = aside or hidden or tag in APART or bool(ASIDE.search(names))
        if tag in ARTICLE and not article:  # names of the page around it, and its own, don't put an article beside
            beside = aside
        else:
            beside = beside or tag in FRAME or hidden or bool(BESIDE.search(names))
        article = article or tag in ARTICLE
        content = content or tag in ARTICLE or bool(CONTENT.search(names))
        self.open.append((tag, beside, article, content, aside))
        self.places[tag].append(len(self.open) - 1)
        if tag not in INLINE:
            self.places[""].append(len(self.open) - 1)
        self.count(tag, 1)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        at = self.last((tag,))
        if at >= 0 and not (tag in INLINE and self.last(("",)) > at):  # an inline end tag closes nothing beyond its block
            self.end(at)

    def end_head(self) -> None:
        # What stands in an element within the head, such as a template, is not the page's body.
        if self.open and self.open[-1][0] == "head":
            self.end(len(self.open) - 1)

    def end(self, at: int) -> None:
        for tag, *_ in self.open[at:]:
            self.count(tag, -1)
            self.places[tag].pop()
            if tag not in INLINE:
                self.places[""].pop()
        del self.open[at:]

    def count(self, tag: str, step: int) -> None:
        self.silent += step * (tag in SILENT)
        self.link += step * (tag == "a")
        self.heading += step * (tag in ("h1", "h2", "h3", "h4", "h5", "h6"))

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.end_head()
        if not self.silent:
            self.parts.append((data, self.link > 0))


def page_blocks(page: str) -> list[tuple]:
    parser = Blocks()
    parser.feed(page)
    parser.close()
    parser.flush()
    return parser.found


def describe(found: list[tuple]) -> np.ndarray:
    """The features of a page's blocks, a row each."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b[1] for b in found], float)
    links = np.array([b[2] for b in found], float) / words
    shift = lambda x, by: np.concatenate([[0.0], x[:-1]]) if by < 0 else np.concatenate([x[1:], [0.0]])
    own = np.array([b[3:] for b in found], float)
    return np.column_stack([words, links, shift(words, -1), shift(links, -1), shift(words, 1), shift(links, 1), own])


#: The labelled table: small pages of our own; blocks that begin with + are main text, those with - are not.
LABELLED = (
    '<body><nav><ul><li><a>-Home</a><li><a>-World news</a></ul></nav><article><h1>+A headline of some words</h1><p>+Long paragraph with many words in a row that tells the whole story of the day at length.<p>+Short one.<p>+End</article><footer>-&copy; Site and more words here</footer>',
    '<body><div class="top-menu"><a>-Start</a> <a>Blog</a></div><div class="ad">-Buy this now and save a lot of money today.</div><article><p><b>+One bold opening paragraph of the article goes on for many words indeed.<br><p>+Second.<p>+<a>A link</a> within running text of the article that goes on and on.</article><div class="comments"><p>-Nice article, thanks for writing it, I liked it a lot.</p></div>',
    '<body><header><h1>-Site name</h1><p>-The slogan of this site in a few words</p></header><div id="content"><h2>+Title of the text</h2><p>+Plain text of the page in a paragraph that has quite a few words so that it is long.</p><p>+Brief.</p><ul><li>+A point made in the text with some words</li><li>+And another</li></ul></div><aside><h3>-Related</h3><p><a>-See also this other story of ours</a></p></aside>',
    '<body><div><a>-Home</a> | <a>About us</a> | <a>Contact</a></div><div><p>+A page without any structure still has a long paragraph of running words that is the main text of it all.</p><p>+It goes on with a second long paragraph in which no links stand, only many more words of the same kind.</p><p>+Then ends shortly.</p><p>+As a third paragraph of good length follows the short one before it, all is well with it.</p></div><div>-Copyright by us</div><div><a>-Imprint</a> <a>Privacy</a> <a>Terms</a></div>',
    '<body><article><div class="notice">-We use cookies on this site to make it better for you, please agree.</div><h1>+Heading</h1><p>+Body text of the article in one line with more than a few words.</p><form><p>-Your e-mail address</p><label>-Subscribe</label></form><p>+More of the body after the form with a good number of words.</p><section class="comments"><h2>-3 comments</h2><p>-I do not agree with this at all, it is all wrong and so on.</p></section></article>',
    '<body><main><p>+Only</p></main><footer><p>-Words in the foot of the page that go on for a while, about the owners and their terms.</p></footer>',
    '<body><div class="post"><h1>+Name of the post</h1><div>+Text right in a division with no paragraph around it, as older pages have it, many words long.</div><div class="share"><a>-Share</a> <a>Like</a></div></div><div class="sidebar"><p>-About me: words on the author that are long enough to look like a text of the page itself.</p></div>',
    '<body><table><tr><td><a>-Link one</a><br><a>-Link two</a></td><td>+The text in a table cell that lays out an old page, with enough words to be the main part of it.</td></tr></table>',
    '<body><article><h1>+T</h1><p>+W</p><p>+Few words.</p><blockquote>+Quoted words within the article are part of it</blockquote><pre>+code = 1</pre></article><div class="related"><a>-Next article about this</a></div>',
    '<body><div><h2>-Archive</h2><ul><li><a>-First of May</a></li><li><a>-Second of May</a></li></ul></div><div><p>-Log in</p></div>',
    '<body><div><a>-Top</a> <a>News</a></div><div><h3>+A heading over the text</h3><p>+The first of two long paragraphs without any names around them, in which quite a lot of words stand.</p><p>+The second of these two, also with a good number of words in it, so that both together are the text.</p></div><div>-All rights reserved</div>',
    '<body><table><tr><td><a>-Home</a></td><td><a>-Shop</a></td></tr><tr><td>+Old pages put all of their text into cells of a table, and so does this one with its many words.</td></tr><tr><td>-Made with care</td></tr></table>',
    '<body><div id="cookie-banner"><p>-This site keeps small files on your machine to remember you, as it says in its policy.</p></div><div class="article-body"><p>+Opening words of the article.</p><p>+More.</p><p>+And a longer paragraph with many words that goes on in the same manner for a whole line of text.</p></div><div class="newsletter"><p>-Get our letter every week, with all that is new and much more besides.</p></div>',
    '<body><section><p>+Sections without names hold text as well, and a paragraph with this many words is surely part of the text.</p><p>+So is the next one, which is a little shorter but still holds more than ten words.</p></section><section><ul><li><a>-Older</a></li><li><a>-Newer</a></li></ul></section><section><p>-Sign in</p></section>',
    '<body><div class="menu"><p>-Our menu has a lot of words in it for once, far more than menus have in general, and no links.</p></div><main><h1>+Heading</h1><div>+x</div><p>+A word</p><ol><li>+one</li><li>+two</li></ol></main>',
    '<body><nav><a>-Home</a></nav><article><h1>+Nothing stands after this article</h1><p>+Its paragraphs are of good length and run over many words up to the last.</p><p>+Its last one is short.</p></article></body>',
    '<body><div class="content"><p>+A text without a foot below it, whose opening paragraph is long enough to be told as a text.</p><p>+The next also has some length, and nothing but the last few words come after it.</p><p>+The end.</p></div></body>',
    '<body><article><p>+Brief</p><p>+Few words here</p><p>+Last of them</p></article></body>',
    '<body><p>+Just one paragraph of text makes up the whole of this page, with words enough to see that it is.</p><p>-<a>Back to the start page</a></p>',
)


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    rows, labels = [], []
    for page in LABELLED:
        found = page_blocks(page)
        rows.append(describe(found))
        labels += [b[0].startswith("+") for b in found]
    return np.concatenate(rows), np.array(labels)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 6, least: int = 1) -> tuple:
    """A tree of (feature, limit, tree up to the limit, tree above it), with the share of main text at its leaves.

    Each split is the one with the lowest Gini impurity; ties go to the first feature and the lowest limit.
    """
    if depth == 0 or labels.all() or not labels.any():
        return (float(labels.mean()),)
    best = None
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        for limit in (values[1:] + values[:-1]) / 2:
            low = rows[:, feature] <= limit
            if min(low.sum(), (~low).sum()) >= least:
                impurity = sum(side.sum() * (p := labels[side].mean()) * (1 - p) for side in (low, ~low))
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, feature, float(limit), low)
    if best is None:
        return (float(labels.mean()),)
    _, feature, limit, low = best
    return (feature, limit, grow(rows[low], labels[low], depth - 1, least), grow(rows[~low], labels[~low], depth - 1, least))


def decide(tree: tuple, row: np.ndarray) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0] >= 0.5


def main_text(page: str, tree: tuple) -> str:
    found = page_blocks(page)
    return " ".join(block[0] for block, row in zip(found, describe(found)) if decide(tree, row))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text`` (the main text, '' if there is none) and ``n_chars`` (its code points).

    Character references are decoded, white space in a block becomes one space, and blocks
    are joined in page order by one space. Null and empty pages, and pages without main
    text, give ''. Broken markup is read as far as it goes. Other columns are kept, also
    for repeated rows; columns named like the new ones are replaced.
    """
    kept = pages.drop(*(c for c in ("text", "n_chars") if c != column))
    rest = [c for c in kept.columns if c not in ("text", "n_chars")]
    tree = grow(*labelled_blocks())
    schema = T.StructType([*kept.select(rest).schema, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py() or "", tree) for page in batch.column(batch.schema.get_field_index(column))]
            own = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), sizes], [*rest, "text", "n_chars"])

    return kept.mapInArrow(run, schema)
