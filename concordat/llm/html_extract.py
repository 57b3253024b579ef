"""Main-text extraction with a tree-structured graphical model of the DOM.

Every block element is a node with a hidden state, content or boilerplate.
Parent-child potentials tie neighbours, emission potentials tie a node to its
tag, class and id words, length and link share. Both are trained by counting on
labelled pages: a few pages labelled by hand (``LABELLED``) and pages of the
input that mark their own article with one ``<article>``, or else one ``<main>``
(pages with several of either train nothing). Sum-product
message passing, one upward and one downward pass, gives each node's content
marginal; the text blocks of nodes at 0.5 or more are the main text, in page
order, joined by two line breaks. Nothing else is dropped or cut.

Training reads at most about ``max_train`` pages (by a hash of the id; counts of
whole pages are summed in Spark); extraction reads every whole page. Null or
empty html gives empty text. Rows repeat as in the input; only the id, url and
html columns are read.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import map_rows, prepare
from concordat.llm.html_dom import Dom, read

CONTENT, BOILER = 1, 0
MAX_TRAIN = 2000

# Labelled pages: data-is="c" starts content, data-is="b" boilerplate; children inherit.
LABELLED = (
    '<body data-is=b><header class="site-header"><div class="logo">Daily News</div><nav class="menu main-menu"><ul class="nav"><li><a href=#>Home</a></li><li><a href=#>World</a></li></ul></nav></header>'
    '<div class="cookie-notice notice banner"><p>We use cookies to improve your visit.</p></div><main data-is=c id="main"><article class="post"><h1>Title of a story</h1><p class="byline">By someone on a day</p><p>A first long paragraph of the story which goes on for quite some words, as stories do, until it ends.</p>'
    '<aside data-is=b class="related"><h3>Related</h3><ul><li><a href=#>More news</a></li></ul></aside><blockquote><p>A quotation in the story that matters, and is content.</p></blockquote><ul><li>A list item of the article itself, with some words</li><li>Another item</li></ul></article></main>'
    '<aside class="sidebar"><h2>Popular</h2><p>Ten things to read now</p></aside><section class="comments" id="comments"><h2>Comments</h2><div class="comment"><p>I do not agree with what the author says here, it is wrong.</p></div></section><footer class="footer"><p>Copyright, all rights reserved</p><ul><li><a href=#>Privacy</a></li></ul></footer></body>',
    '<body data-is=b><div id="header"><div class="top-bar">Call us</div></div><div id="nav"><ul><li><a href=#>Products</a></li></ul></div><div id="wrapper" data-is=c><div id="content" class="content main-content"><h1>Guide</h1><div class="entry-content"><p>Paragraph one of the guide is long enough to be read as the text of the page by a person.</p><h2>Part</h2><p>Short one.</p><pre>code sample</pre><table><tr><td>cell one</td><td>cell two</td></tr></table></div>'
    '<div data-is=b class="share social"><a href=#>Share</a></div><div data-is=b class="ad advert advertisement"><p>Buy this now at half the price and be happy.</p></div></div><div data-is=b id="sidebar"><div class="widget"><h3>Archive</h3><ul><li><a href=#>May</a></li></ul></div><form class="newsletter"><p>Subscribe to our letter</p></form></div></div><div id="footer">Imprint</div></body>',
    '<body data-is=b><nav class="breadcrumb"><a href=#>Home</a></nav><div class="alert notice">The site is down tonight for repairs.</div><article data-is=c><header><h1>Recipe</h1></header><section><p>Mix the flour with water, and wait for an hour before you go on with it.</p><figure><figcaption>The dough</figcaption></figure></section><footer data-is=b class="article-footer"><p>Tags and sharing</p></footer><div data-is=b class="promo banner"><p>Get our app</p></div><form data-is=b><p>Leave a reply</p></form></article>'
    '<div class="comments-area"><ol class="comment-list"><li class="comment"><div class="comment-body"><p>Great recipe, I made it twice and my children loved it so much.</p></div></li></ol></div><div class="popup modal"><p>Join us today</p></div><footer><div>About</div></footer></body>',
    '<body data-is=b><div class="menu"><ul><li><a href=#>One</a></li></ul></div><div class="page" data-is=c><div class="text body"><h2>Chapter</h2><p>It was late in the year when they came to the town by the river, and it rained.</p><p>No.</p><dl><dt>Term</dt><dd>Meaning of the term</dd></dl></div><div data-is=b class="pagination pager"><a href=#>Next</a></div><div data-is=b class="author-bio bio"><p>The author lives in a town.</p></div><div data-is=b class="sponsored"><p>A word from our sponsor about shoes.</p></div></div>'
    '<div class="ads"><p>Cheap flights to the sun</p></div><div class="ad-banner sponsor"><p>Sale ends soon</p></div><div class="disclaimer notice">Notice to readers</div><noscript>Please turn on scripts to see this page.</noscript><div class="login form search"><form><label>Name</label></form></div><div class="copyright">Copyright</div></body>',
    '<body data-is=b><h1 data-is=c>A plain page</h1><p data-is=c>It has no containers, and its paragraphs stand in the body itself.</p><p data-is=c>The second one.</p><ul data-is=c><li>An item of the text</li></ul><hr><div class="footer">Contact us</div></body>',
    '<body data-is=b><div class="sidebar"><p>Latest</p></div><div data-is=c class="article-body"><p>The text of the article stands in a box of its own, as it does on many pages.</p><p>More of it.</p></div><div class="footer"><p>Terms</p></div></body>',
    '<body data-is=b><div class="topmenu menu"><a href=#>Start</a></div><div data-is=c class="page text"><div class="post-content"><h2>Head</h2><p>The text of the post stands here.</p></div></div><div class="comments"><p>First!</p></div></body>',
    '<body data-is=b><div data-is=c class="story article"><div class="entry"><p>One more story, with a few words in its text.</p></div></div><div class="banner ads"><p>Sale</p></div></body>',
    # Layout tables: the cells of one row are menu, article and margin.
    '<body data-is=b><table class="layout"><tr><td class="header">The town paper</td></tr><tr><td class="menu"><a href=#>Front page</a><ul><li><a href=#>Sport</a></li></ul></td><td data-is=c><h1>Old bridge closed</h1><p>The bridge over the river was closed to all traffic on Monday, and will stay so until the spring.</p><p>Walkers may still cross.</p></td><td class="sidebar"><p>Weather and tides</p></td></tr><tr><td class="footer">All rights reserved</td></tr></table></body>',
    '<body data-is=b><center><table><tr><td><a href=#>Home</a></td><td><a href=#>Archive</a></td></tr></table></center><table data-is=c><tr><td><h2>Notes on bread</h2></td></tr><tr><td><p>Bread needs time more than it needs work, which is why it suits people who stay at home.</p><table><tr><th>Flour</th><td>500 g</td></tr><tr><th>Water</th><td>350 g</td></tr></table></td></tr></table><table><tr><td class="copyright">Contact</td></tr></table></body>',
    '<body data-is=b><table id="main"><tbody><tr><td class="nav left"><ul><li><a href=#>Start</a></li><li><a href=#>Shop</a></li></ul></td><td class="content" data-is=c><p>This text stands in a cell of its own, and has no heading at all above it.</p><p>It goes on here for some words more.</p></td><td class="ads"><p>Buy two and pay for one</p></td></tr></tbody></table></body>',
    '<body data-is=b><table><tbody><tr><td><table><tr><td class="logo">The village</td><td><a href=#>Index</a></td></tr></table></td></tr><tr data-is=c><td><table><tr><td><h1>The well</h1></td></tr><tr><td><p>The old well behind the church was dug out again last summer by twelve people and a goat.</p></td></tr><tr><td><p>It holds water now.</p></td></tr></table></td></tr></tbody></table></body>',
    # Sections of the text itself.
    '<body data-is=b><header class="top"><ul><li><a href=#>Home</a></li></ul></header><main data-is=c><section><h2>First part</h2><p>The first part tells of the year in which the mill was built, and who paid for it.</p></section><section><h2>Second part</h2><p>The second part tells how it burnt down, and why nobody was sad.</p><p>It was insured.</p></section><section><h2>Third</h2><p>And so on.</p></section></main><section class="newsletter"><p>Get our letter</p></section><footer><p>Imprint</p></footer></body>',
    # Parts of an article that open on a click, forms and remarks of readers inside it.
    '<body data-is=b><nav><a href=#>Home</a></nav><article data-is=c><h1>Questions</h1><p>Some things are asked again and again, so here are the answers to them.</p><details><summary>What does it cost?</summary><p>Nothing at all, and it never will, as long as there are people who help.</p></details><details><summary>More</summary><p>There is more to read in the next part.</p><ul><li>One point</li></ul></details>'
    '<section class="comments" id="comments" data-is=b><h3>2 comments</h3><ol class="comment-list"><li class="comment"><p>Thank you, that was what I wanted to know all along.</p></li></ol><form><p>Leave a reply</p></form></section></article></body>',
    '<body data-is=b><main><div class="post" data-is=c><h1>On rain</h1><p>It rained for a week, and when it stopped the roads were gone.</p><address>Written by the river</address><fieldset><legend>Note</legend><p>A box with a note that belongs to the text.</p></fieldset><div id="respond" class="respond discussion" data-is=b><h2>Responses</h2><div><p>We had the same here last year, it was hard.</p></div></div></div></main></body>',
)


def emissions(dom: Dom, i: int) -> list[str]:
    """Observed features of node ``i``."""
    n = dom.chars[i]
    out = [f"l={0 if not n else min(7, 1 + n.bit_length() // 2)}", f"a={int(4 * dom.linked[i] / n) if n else -1}"]
    out += [f"n={w}" for w in set(dom.names[i])]
    return out


PAGE = 2


def over(dom: Dom, state: list[int], i: int) -> int:
    """What a node hangs on: the state of its parent, or PAGE right under the page itself."""
    p = dom.parent[i]
    return PAGE if dom.tag[p] in ("#root", "html", "body") else state[p]


def count_page(dom: Dom, state: list[int]) -> Counter:
    """Counts of edges and emissions of a labelled page."""
    c: Counter = Counter()
    for i in range(1, len(dom.tag)):
        s = state[i]
        c[f"edge|{over(dom, state, i)}|{dom.tag[i]}|{s}"] += 1
        for f in emissions(dom, i):
            c[f"{s}|{f}"] += 1
        c[f"node|{s}"] += 1
    return c


#: Names of sections for readers' remarks: boilerplate in an article too, heading and all.
REMARKS = frozenset("comment comments commentlist discussion respond replies disqus".split())


def own_labels(dom: Dom) -> list[int] | None:
    """States of a page that marks one article (or else one main part) of its own; None otherwise."""
    for kind in ("article", "main"):
        roots = [i for i, t in enumerate(dom.tag) if t == kind]
        if len(roots) == 1:
            break
    else:
        return None
    state = [BOILER] * len(dom.tag)
    inner = {"nav", "aside", "footer", "form"}
    for i in range(1, len(dom.tag)):
        if i == roots[0]:
            state[i] = CONTENT
        elif dom.tag[i] not in inner and REMARKS.isdisjoint(dom.names[i]):
            state[i] = state[dom.parent[i]]
    return state


def hand_counts() -> Counter:
    """Counts of the pages labelled by hand."""
    total: Counter = Counter()
    for page in LABELLED:
        # The label is read as a name and then taken off, so that it is never a feature.
        dom = read(page.replace("data-is=b class=\"", 'class="isboiler ').replace("data-is=c class=\"", 'class="iscontent ').replace("data-is=b", 'class="isboiler"').replace("data-is=c", 'class="iscontent"'))
        state = [BOILER] * len(dom.tag)
        for i in range(1, len(dom.tag)):
            names = dom.names[i]
            state[i] = BOILER if "isboiler" in names else CONTENT if "iscontent" in names else state[dom.parent[i]]
            dom.names[i] = tuple(w for w in names if w not in ("isboiler", "iscontent"))
        total.update(count_page(dom, state))
    return total


def blend(hand: Counter, own: dict[str, int]) -> dict[str, float]:
    """Both sets of counts, with the hand-labelled pages as heavy as all others together."""
    size = [sum(c.get(f"node|{s}", 0) for s in (0, 1)) for c in (hand, own)]
    by = max(1.0, size[1] / max(size[0], 1))
    return {k: hand.get(k, 0) * by + own.get(k, 0) for k in hand.keys() | own.keys()}


class Model:
    """Log potentials from counts, with additive smoothing."""

    def __init__(self, counts: dict[str, float], smooth: float = 1.0):
        n = [counts.get(f"node|{s}", 0) for s in (0, 1)]
        tags = {k.split("|")[2] for k in counts if k.startswith("edge|")} | {""}
        # Log share of a child's state, given its tag and what it hangs on; "" stands for tags never seen.
        self.edge = {}
        for p in (0, 1, PAGE):
            rest = [sum(v for k, v in counts.items() if k.startswith(f"edge|{p}|") and k.endswith(f"|{s}")) + smooth for s in (0, 1)]
            for t in tags:
                own = [counts.get(f"edge|{p}|{t}|{s}", 0) + smooth * rest[s] / sum(rest) for s in (0, 1)]
                self.edge[p, t] = tuple(math.log(x / sum(own)) for x in own)
        features = {k.split("|", 1)[1] for k in counts if k[:2] in ("0|", "1|")}
        self.emit = {f: tuple(math.log((counts.get(f"{s}|{f}", 0) + smooth) / (n[s] + 2 * smooth)) for s in (0, 1)) for f in features}

    def marginals(self, dom: Dom) -> list[float]:
        """Content marginal of every node by sum-product on the tree."""
        size, emit, parent, tag = len(dom.tag), self.emit, dom.parent, dom.tag
        e0, e1 = [0.0] * size, [0.0] * size
        down = [((0.0, 0.0), (0.0, 0.0))] * size  # edge potentials [parent state][own state]
        for i in range(1, size):
            t = tag[i] if (0, tag[i]) in self.edge else ""
            down[i] = (self.edge[PAGE, t],) * 2 if tag[parent[i]] in ("#root", "html", "body") else (self.edge[0, t], self.edge[1, t])
            for f in emissions(dom, i):
                if g := emit.get(f):
                    e0[i] += g[0]
                    e1[i] += g[1]
        up0, up1 = e0[:], e1[:]  # emission and messages from below
        m0, m1 = [0.0] * size, [0.0] * size  # message of a node to its parent
        for i in range(size - 1, 0, -1):
            edge = down[i]
            m0[i] = _logsum(edge[0][0] + up0[i], edge[0][1] + up1[i])
            m1[i] = _logsum(edge[1][0] + up0[i], edge[1][1] + up1[i])
            up0[parent[i]] += m0[i]
            up1[parent[i]] += m1[i]
        b0, b1 = up0[:], up1[:]  # beliefs
        for i in range(1, size):
            p, edge = parent[i], down[i]
            r0, r1 = b0[p] - m0[i], b1[p] - m1[i]  # the parent without this child
            b0[i] = up0[i] + _logsum(edge[0][0] + r0, edge[1][0] + r1)
            b1[i] = up1[i] + _logsum(edge[0][1] + r0, edge[1][1] + r1)
        return [1 / (1 + math.exp(min(700.0, max(-700.0, a - b)))) for a, b in zip(b0, b1)]

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        dom = read(page)
        if len(dom.tag) == 1:  # no element at all: plain text
            return "\n\n".join(t for _, t in dom.blocks)
        m = self.marginals(dom)
        return "\n\n".join(t for node, t in dom.blocks if m[node] >= 0.5)


def _logsum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def fit(pages: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "page_id", html_col: str = "html") -> Model:
    """Potentials from the pages labelled by hand and those of ``pages`` that label themselves."""
    prepare(pages.sparkSession)
    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).where("html is not null")
    total = picked.count()
    rate = 1_000_000
    share = min(1.0, max_train / max(total, 1))
    sample = picked.where(F.pmod(F.xxhash64("page_id", F.lit(3)), F.lit(rate)) < share * rate).select("html")

    def run(batches):
        c: Counter = Counter()
        for b in batches:
            for page in b.column(0).to_pylist():
                dom = read(page)
                if (state := own_labels(dom)) is not None:
                    c.update(count_page(dom, state))
        yield pa.RecordBatch.from_pydict({"k": list(c), "v": list(c.values())}, schema=pa.schema([("k", pa.string()), ("v", pa.int64())]))

    # Words seen on one page only say nothing of others; there may be as many as pages.
    rows = sample.mapInArrow(run, "k string, v long").groupBy("k").agg(F.sum("v").alias("v")).where("v > 1").collect()
    return Model(blend(hand_counts(), {r["k"]: r["v"] for r in rows}))


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    prepare(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # bounded by the words of max_train pages

    def start():
        m = shared.value

        def step(b: pa.RecordBatch) -> dict:
            text = [m.extract(x) for x in b.column(2).to_pylist()]
            return {"page_id": b.column(0), "url": b.column(1), "text": text, "n_chars": list(map(len, text))}

        return step

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_rows(picked, start, schema, "page_id long, url string, text string, n_chars long")
