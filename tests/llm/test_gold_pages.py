"""Pages written by hand in common layouts, each with the plain texts that should come out."""

import pytest

from corpusframe.llm import html_lstm
from corpusframe.llm.html_blocks import blocks

HEAD = "Along the river"
ONE = "The river bends twice before it meets the old bridge, and the town has grown along both of its banks."
TWO = "Every spring the water rises, and the lower streets are closed for a week or two while people wait."
THREE = "People here measure the year by the floods rather than by the calendar, and few would live elsewhere."
BODY = f"<h1>{HEAD}</h1><p>{ONE}</p><p>{TWO}</p><p>{THREE}</p>"
TEXT = [HEAD, ONE, TWO, THREE]
MENU = "<ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/c'>Contact</a></li></ul>"
SAID = ["I grew up there and remember the floods very well.", "Great piece, thank you for writing it down."]
REPLIES = "".join(f"<li><p>{s}</p></li>" for s in SAID)

PAGES = {
    "plain article": (f"<html><body><article>{BODY}</article></body></html>", TEXT),
    "blog with comments in a list": (f"<div id='page'><div class='entry-content'>{BODY}</div><div id='comments'><h2>2 thoughts on this</h2><ol>{REPLIES}</ol></div></div>", TEXT),
    "comments in an unordered list": (f"<main>{BODY}</main><section class='comments'><h3>Comments</h3><ul>{REPLIES}</ul></section>", TEXT),
    "comments as blocks": (f"<article>{BODY}</article><div class='comments'><h3>Comments</h3><div class='comment'><b>Ann</b><p>{SAID[0]}</p><a href='#'>Reply</a></div></div>", TEXT),
    "notice without a telling name": (f"<div class='css-9k2x1'><div class='css-1x2y3'>We use cookies to improve your experience. Accept all</div><div class='css-77ab'>{BODY}</div></div>", TEXT),
    "notice with a telling name": (f"<div class='cookie-banner'><p>We use cookies on this site.</p><button>Accept</button></div><article>{BODY}</article>", TEXT),
    "menu in a table cell": (f"<table><tr><td><a href='/'>Home</a> <a href='/l'>Links</a></td><td>{BODY}</td></tr></table>", TEXT),
    "menu row above a table cell": (f"<table><tr><td><a href='/'>Home</a> | <a href='/l'>Links</a> | <a href='/a'>About</a></td></tr><tr><td>{BODY}</td></tr></table>", TEXT),
    "paragraphs as div": (f"<div class='c1'><h1>{HEAD}</h1><div>{ONE}</div><div>{TWO}</div></div>", [HEAD, ONE, TWO]),
    "paragraphs as div among parts": (f"<nav>{MENU}</nav><div id='main'><h1>{HEAD}</h1><div>{ONE}</div><div>{TWO}</div></div><footer><p>Copyright. All rights reserved</p></footer>", [HEAD, ONE, TWO]),
    "menu, sidebar and footer": (f"<nav>{MENU}</nav><main><article>{BODY}</article></main><aside><h3>Related articles</h3><ul><li><a href='/x'>Old mills</a></li></ul></aside><footer><p>All rights reserved</p></footer>", TEXT),
    "header with a site name": (f"<header class='site-header'><h1>The Valley Post</h1>{MENU}</header><div class='content'>{BODY}</div>", TEXT),
    "search form": (f"<form class='search'><label>Search</label><input name='q'><button>Go</button></form><article>{BODY}</article>", TEXT),
    "advert inside the text": (f"<article><h1>{HEAD}</h1><p>{ONE}</p><div class='advert'><p>Sponsored content. Buy two pairs.</p></div><p>{TWO}</p></article>", [HEAD, ONE, TWO]),
    "share buttons and tags": (f"<article>{BODY}</article><ul class='share-buttons'><li><a href='#'>Share this</a></li><li><a href='#'>Follow us</a></li></ul>", TEXT),
    "list, quote and headings": (f"<article><h1>{HEAD}</h1><p>{ONE}</p><h2>What floods leave</h2><ul><li>Sand in every cellar of the lower town</li><li>Fish in the gardens near the bridge</li></ul><blockquote><p>{TWO}</p></blockquote></article>", [HEAD, ONE, "What floods leave", "Sand in every cellar of the lower town", "Fish in the gardens near the bridge", TWO]),
    "references and white space": (f"<article><h1>{HEAD}</h1><p>Tea &amp; café\n   at  the &lt;old&gt; mill, said the keeper to everyone who asked for it.</p><p>{ONE}</p></article>", [HEAD, "Tea & café at the <old> mill, said the keeper to everyone who asked for it.", ONE]),
    "scripts, styles and comments of markup": (f"<script>var a='<p>no</p>';</script><style>p{{color:red}}</style><!-- <p>no</p> --><article>{BODY}</article>", TEXT),
    "utility classes": (f"<body class='overflow-hidden'><div class='mx-auto md:flex'><article class='overflow-hidden p-4'>{BODY}</article></div></body>", TEXT),
    "newsletter box below": (f"<main>{BODY}</main><div class='newsletter'><p>Subscribe to our newsletter</p><form><input><button>Sign up</button></form></div>", TEXT),
    "breadcrumbs and byline": (f"<ol class='breadcrumb'><li><a href='/'>Home</a></li><li><a href='/t'>Travel</a></li></ol><article>{BODY}</article><div class='author-bio'><a href='/ann'>Posted by Ann</a></div>", TEXT),
    "empty page": ("<html><body></body></html>", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    html, want = PAGES[name]
    found = blocks(html)
    p = html_lstm.BlockLabeller.load().label([found])[0]
    assert [b.text for b, v in zip(found, p, strict=True) if v >= html_lstm.THRESHOLD] == want


def test_kept_names_never_clash(spark):
    df = spark.createDataFrame([(1, "<article><p>a b c</p></article>", "t", "u", "v")], "page_id long, html string, url string, text string, text_ string")
    assert html_lstm.extract(df, ("url", "text", "text_", "page_id")).columns == ["page_id", "url", "text_", "text__", "page_id_", "text"]
