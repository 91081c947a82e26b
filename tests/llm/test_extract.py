"""Main text by shape: hand-written pages, most without an article, and what must not be taken for it."""

import pytest

from sievelight.llm import extract

say = lambda n: " ".join(["word"] * n)

PAGES = [
('''<body><div class="topbar"><a href="/">Daily Harbour</a> <a href="/s">Sport</a> <a href="/c">Culture</a></div>
<div id="cookie-consent"><p>We use cookies and similar techniques to give you the best experience on our site. By clicking accept you agree to the storing of cookies on your device, to the analysis of how the site is used, and to help with our marketing efforts.</p><button>Accept</button></div>
<div class="content"><h1>Ferry returns to the northern islands</h1><p>After two winters without a connection, the ferry to the northern islands took up its service again on Monday morning.</p>
<p>"We waited long," said the harbour master.</p><p>The <a href="/b">new boat</a> carries sixty cars and makes the crossing in under two hours.</p></div>
<div class="user-comments"><p>Finally! My parents live there and I have not been able to visit them for more than a year, so this is really good news for all of us.</p><p>What does a ticket cost?</p></div>
<div class="footer"><p>Daily Harbour is published by Harbour Media, 12 Quay Street. The publisher is not responsible for the content of external sites to which this site refers, nor for comments of readers.</p></div></body>''',
'Ferry returns to the northern islands After two winters without a connection, the ferry to the northern islands took up its service again on Monday morning. "We waited long," said the harbour master. The new boat carries sixty cars and makes the crossing in under two hours.'),
('''<table><tr><td><a href="/">Home</a></td><td><a href="/faq">FAQ</a></td></tr></table><div><h2>How to repot a cactus</h2><p>Choose a pot that is one size larger, fill it to a third with a mix of soil and sand, and let the plant rest for a week before you water it.</p><ul><li>a pot with a hole</li><li>soil for <a href="/s">succulents</a> and some sand</li><li>gloves</li></ul><p>Done.</p></div><div><ul><li><a href="/1">Ten easy house plants</a></li><li><a href="/2">When to water</a></li><li><a href="/3">Light and shade</a></li></ul></div><p>&copy; 2021 Green Corner</p>''',
'How to repot a cactus Choose a pot that is one size larger, fill it to a third with a mix of soil and sand, and let the plant rest for a week before you water it. a pot with a hole soil for succulents and some sand gloves Done.'),
('''<div><p>One long paragraph of a plain page stands here without any frame at all, written by hand a long time ago, and it ends where the page ends.</p></div><footer><p>Written by hand with a plain editor. If you find an error on this page, or a link that leads nowhere, write to the owner of the page, who reads all letters.</p></footer>''',
'One long paragraph of a plain page stands here without any frame at all, written by hand a long time ago, and it ends where the page ends.'),
('''<article><header><h1>Bridges</h1><p>By A. Writer</p></header><p>A bridge carries a road over an obstacle such as a river, and the first ones were trees that had fallen.</p><section class="related-work"><h2>Related work</h2><p>Earlier surveys list beams, arches and suspended bridges, and give for each the longest span that was built.</p></section><p>Short end.</p><div><h3>More</h3><ul><li><a href="/t">Tunnels</a></li><li><a href="/d">Dams of the north</a></li></ul></div></article><div class="widget"><p>This week: win a trip to the great bridges of the south with our quiz.</p></div>''',
'Bridges By A. Writer A bridge carries a road over an obstacle such as a river, and the first ones were trees that had fallen. Related work Earlier surveys list beams, arches and suspended bridges, and give for each the longest span that was built. Short end.'),
]

#: (page, whether the word "extra" belongs to its main text)
PROBES = [
    (f"<div><p>{say(60)}</p></div><footer><p>extra {say(40)}</p></footer>", False),
    (f"<div><p>{say(60)}</p></div><div class='comments'><p>extra {say(40)}</p></div>", False),
    (f"<div id='cookie-notice'><p>extra {say(40)}</p></div><div><p>{say(60)}</p></div>", False),
    (f"<div><a href='/'>extra</a></div><p>{say(80)}</p>", False),
    (f"<article><p>{say(60)}</p><p>{say(50)}</p><ul><li><a href='/'>extra</a></li><li><a href='/'>extra two</a></li><li><a href='/'>extra three four</a></li></ul></article>", False),
    (f"<article><p>{say(60)}</p></article><div class='user-feedback'><p>extra {say(20)}</p></div>", False),
    (f"<article><p>{say(60)}</p><div class='user-feedback'><p>extra {say(20)}</p></div></article>", False),
    (f"<article><p>{say(60)}</p><div class='related-work'><h2>Related work</h2><p>extra {say(40)}</p></div></article>", True),
    (f"<article><p>{say(60)}</p><p>extra</p><p>All rights reserved.</p></article>", True),
    (f"<article><p>{say(60)} <a href='/'>extra</a> {say(10)}</p></article>", True),
    (f"<p>{say(30)}</p><p class='advert'>extra {say(30)}</p><p>{say(30)}</p>", False),
    (f"<main><p>{say(30)}</p></main><aside><p>extra {say(100)}</p></aside>", False),
]


@pytest.fixture(scope="module")
def tree():
    return extract.grow(*extract.labelled())


@pytest.mark.parametrize("page, want", PAGES)
def test_hand_labelled_pages(tree, page, want):
    assert extract.main_text(page, tree) == want


@pytest.mark.parametrize("page, belongs", PROBES)
def test_probes(tree, page, belongs):
    got = extract.main_text(page, tree)
    assert "word" in got and ("extra" in got) == belongs


def test_the_tree_asks_for_shape(tree):
    asked = set()

    def walk(t):
        if isinstance(t, tuple):
            asked.add(extract.FEATURES[t[0]])
            walk(t[2])
            walk(t[3])

    walk(tree)
    assert {"words", "links", "links_before", "links_after", "words_after"} <= asked


def test_other_pages_of_the_same_kind(tree):
    """Pages that the tree was not grown on."""
    x, y = extract.labelled(150, seed=1234)
    got = [extract.kept(tree, row) for row in x]
    assert sum(g == bool(k) for g, k in zip(got, y, strict=True)) >= 0.99 * len(y)


LONG = "The river rises in the hills and runs for many miles through meadows, woods and small towns before it meets the sea."


@pytest.mark.parametrize("link", ['<a href="/x">a link that nobody ends', '<a href="/x">one <a href="/y">two</a>', '<a name="top">'])
def test_an_unclosed_link_ends_with_its_block(link):
    page = f"<html><body><article><p>{LONG} {link}</p><p>{LONG}</p><p>{LONG} Again.</p></article></body></html>"
    own = extract.blocks(page)
    assert [b.linked for b in own[1:]] == [0, 0] and own[0].linked <= 6
    assert all(b.linked == b.words for b in extract.blocks('<div><a href="/x"><h3>A closed card</h3><p>spans its blocks</p></a></div>'))


def test_formulas_are_text():
    page = f"<article><p>{LONG} Here <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x = 2</annotation></semantics></math> holds.</p></article>"
    assert [b.text for b in extract.blocks(page)] == [f"{LONG} Here x=2 holds."]
