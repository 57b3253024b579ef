"""Pages labelled by hand that training never sees: layout tables, parts that open, remarks inside the article."""

from collections import Counter

import pytest

from concordat.llm import html_extract

A = "The harbour was quiet on the morning after the storm, and only a few boats had been lost."
B = "Most of the nets were found again on the beach, torn but not beyond repair."
C = "By noon people had begun to carry stones to the broken wall."
LINKS = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul>"
PAGES = {
    "menu cell": (f"<body><table><tr><td class=menu>{LINKS}</td><td><p>{A}</p><p>{B}</p></td></tr></table></body>", [A, B]),
    "cells without names": (f"<body><table><tr><td>{LINKS}</td><td><h1>Storm</h1><p>{A}</p><p>{B}</p></td></tr></table></body>", ["Storm", A, B]),
    "three columns": (f"<body><table width=100%><tr><td class=left-nav>{LINKS}</td><td class=main><p>{A}</p><p>{B}</p></td><td class='sidebar'><p>Latest offers</p></td></tr></table></body>", [A, B]),
    "header and footer rows": (f"<body><table><tr><td class=header>Site name</td></tr><tr><td><p>{A}</p><p>{B}</p></td></tr><tr><td class=footer>Copyright</td></tr></table></body>", [A, B]),
    "single cell": (f"<body><table><tr><td><p>{A}</p><p>{B}</p></td></tr></table></body>", [A, B]),
    "nested tables": (f"<body><table><tr><td><table><tr><td class=nav>{LINKS}</td></tr></table></td><td><table><tr><td><p>{A}</p></td></tr><tr><td><p>{B}</p></td></tr></table></td></tr></table></body>", [A, B]),
    "data table": (f"<body><article><p>{A}</p><table><tr><th>Boat</th><th>State</th></tr><tr><td>Anna</td><td>lost</td></tr></table><p>{B}</p></article><footer>F</footer></body>", [A, "Boat", "State", "Anna", "lost", B]),
    "data table in a div": (f"<body><div class='content'><p>{A}</p><table><tr><td>Anna</td><td>lost</td></tr></table><p>{B}</p></div><div class=footer>F</div></body>", [A, "Anna", "lost", B]),
    "details": (f"<body><nav>{LINKS}</nav><article><p>{A}</p><details><summary>More</summary><p>{B}</p></details></article></body>", [A, "More", B]),
    "details alone": (f"<body><div class=post><details><summary>More</summary><p>{A}</p><p>{B}</p></details></div></body>", ["More", A, B]),
    "fieldset": (f"<body><article><p>{A}</p><fieldset><legend>Note</legend><p>{B}</p></fieldset></article></body>", [A, "Note", B]),
    "comments in the article": (f"<body><article><p>{A}</p><p>{B}</p><section id=comments><h3>2 comments</h3><ol><li class=comment><p>I was there and saw it all with my own eyes.</p></li></ol></section></article></body>", [A, B]),
    "comments after it": (f"<body><article><p>{A}</p><p>{B}</p></article><div class='comments-area'><h2>3 comments</h2><div class=comment-body><p>I was there and saw it all with my own eyes.</p></div></div></body>", [A, B]),
    "respond": (f"<body><div class=entry-content><p>{A}</p><p>{B}</p></div><div id=respond><h3>Leave a reply</h3><p>Your address will not be shown.</p></div></body>", [A, B]),
    "section in main": (f"<body><header>{LINKS}</header><main><section><h2>One</h2><p>{A}</p></section><section><h2>Two</h2><p>{B}</p></section></main></body>", ["One", A, "Two", B]),
    "figure and quote": (f"<body><article><figure><figcaption>The harbour</figcaption></figure><p>{A}</p><blockquote><p>{B}</p></blockquote></article><aside><p>Read next</p></aside></body>", ["The harbour", A, B]),
    "center": (f"<body><center><p>{A}</p><p>{B}</p></center><div class=banner><p>Sale</p></div></body>", [A, B]),
    "plain body": (f"<body><h1>Storm</h1><p>{A}</p><p>{B}</p><div class=footer>Contact</div></body>", ["Storm", A, B]),
    "sidebar before": (f"<body><div id=sidebar><h3>Archive</h3>{LINKS}</div><div id=content><p>{A}</p><p>{B}</p><p>{C}</p></div></body>", [A, B, C]),
    "advert inside": (f"<body><div class='article-text'><p>{A}</p><div class='ad-slot advertisement'><p>Cheap flights</p></div><p>{B}</p></div></body>", [A, B]),
    "newsletter inside": (f"<body><article><p>{A}</p><form class=newsletter><p>Subscribe to our letter</p></form><p>{B}</p></article></body>", [A, B]),
    "list article": (f"<body><div class='post'><h2>Ways</h2><ol><li>{A}</li><li>{B}</li></ol></div><div class='share'><a href=#>Share</a></div></body>", ["Ways", A, B]),
    "definition list": (f"<body><article><dl><dt>Harbour</dt><dd>{A}</dd><dt>Net</dt><dd>{B}</dd></dl></article><footer>F</footer></body>", ["Harbour", A, "Net", B]),
    "notice above": (f"<body><div class='cookie-notice'><p>We use cookies on this site.</p></div><main><p>{A}</p><p>{B}</p></main><footer><p>Imprint</p></footer></body>", [A, B]),
}
FOLD = "<html><body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>A paragraph of the story that is long enough.</p>{}</article><footer>F</footer></body></html>"


@pytest.fixture(scope="module")
def model(spark):
    """Trained on the pages labelled by hand and on some that label themselves, remarks inside the article among them."""
    rows = [(i, FOLD.format("<section class=comments><h3>4 comments</h3><div class=comment><p>So true, I think.</p></div></section>" if i % 2 else "<p>And more.</p>")) for i in range(60)]
    return html_extract.fit(spark.createDataFrame(rows, "page_id long, html string"))


@pytest.mark.parametrize("trained", [False, True])
def test_held_out_pages(model, trained):
    m = model if trained else html_extract.Model(html_extract.hand_counts())
    hit = got = want = 0
    bad = []
    for name, (page, text) in PAGES.items():
        a, b = Counter(filter(None, m.extract(page).split("\n\n"))), Counter(text)
        hit, got, want = hit + (a & b).total(), got + a.total(), want + b.total()
        if a != b:
            bad.append((name, list((b - a)), list((a - b))))
    print(f"precision {hit / got:.3f} recall {hit / want:.3f}", bad)
    assert hit / got >= 0.95 and hit / want >= 0.97, bad


@pytest.mark.parametrize("name", ["menu cell", "three columns", "details", "comments in the article"])
def test_reported_layouts_keep_the_whole_article(model, name):
    page, text = PAGES[name]
    assert model.extract(page) == "\n\n".join(text)
