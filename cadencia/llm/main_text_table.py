"""The labelled table from which the block classifier of ``main_text`` is learned.

Each page is a list of (is it main text?, html); the pieces of a page follow one
another, and each holds one block or none. ``...`` lets a piece open or close an
element around others.
"""

from __future__ import annotations

LONG = "The council met on Tuesday to discuss the plans for the old harbour and heard from several residents who live near the water."
LINKED = 'As <a href="/r">reported earlier</a>, the repairs will take two years and cost more than the town had hoped to spend on them.'
SHORT = "It was late."
LINKS = '<li><a href="/a">News</a></li>'

PAGES: list[list[tuple[int | None, str]]] = [
    # an article element between menus and a footer
    [
        (None, "<body><nav><ul>"), (0, '<li><a href="/">Home</a></li>'), (0, '<li><a href="/sport">Sport</a></li>'), (0, LINKS), (None, "</ul></nav>"),
        (0, '<div class="ad">Buy two, get one for nothing at the market hall this week.</div>'),
        (None, "<article>"), (1, "<h1>Harbour plans</h1>"), (1, f"<p>{LONG}</p>"), (1, f"<p>{SHORT}</p>"), (1, f"<p>{LINKED}</p>"), (1, "<p>Yes.</p>"), (None, "</article>"),
        (0, "<footer>&copy; 2020 The Harbour Post. All rights reserved by the publisher and its partners.</footer>"),
    ],
    # a short article
    [
        (None, '<body><header>'), (0, "<div>The Post</div>"), (0, '<a href="/login">Log in</a>'), (None, "</header><article>"), (1, "<h1>Notes</h1>"), (1, "<p>Rain.</p>"), (None, "</article>"),
        (0, '<footer><a href="/imprint">Imprint</a> <a href="/privacy">Privacy</a></footer>'),
    ],
    # a main element, a side column and comments
    [
        (None, "<body><main>"), (1, "<h1>How to plant trees</h1>"), (1, "<ul><li>Dig a hole.</li>"), (1, "<li>Water it well for a week.</li></ul>"), (1, f"<blockquote>{SHORT}</blockquote>"),
        (1, f"<p>{LONG}</p>"), (1, '<p><a href="/more">All of the rules for planting</a></p>'), (None, "</main><aside>"), (0, "<h3>Related</h3>"), (0, '<p><a href="/b">Ten trees for small gardens</a></p>'),
        (0, f"<p>{LONG}</p>"), (None, '</aside><section class="comments">'), (0, "<h2>Comments</h2>"), (0, "<p>I planted one of these last spring and it has grown taller than my house already, thanks.</p>"), (0, "<p>Me too.</p>"), (None, "</section>"),
    ],
    # no article element: words and links decide
    [
        (None, "<body><table><tr><td>"), (0, '<a href="/1">One</a> | <a href="/2">Two</a> | <a href="/3">Three</a>'), (0, '<div><a href="/4">Four and more of these</a></div>'), (None, "</td><td>"),
        (1, "<h1>A walk along the river</h1>"), (1, f"<p>{LONG}</p>"), (1, f"<p>{LONG} {LONG}</p>"), (1, f"<p>{SHORT}</p>"), (1, f"<p>{LINKED}</p>"), (None, "</td></tr></table>"),
        (0, '<div><a href="/c">Contact</a> <a href="/t">Terms of use</a></div>'), (0, "<div>Copyright 2019</div>"),
    ],
    [
        (None, "<body>"), (0, "<div>My site</div>"), (0, '<div><a href="/x">Start</a></div>'), (0, '<div><a href="/y">Archive of all posts</a></div>'), (1, f"<div>{LONG} {LONG}</div>"), (1, f"<div>{LONG}</div>"),
        (1, "<h3>What came next</h3>"), (1, f"<div>{LINKED}</div>"), (1, f"<div>{LONG}</div>"), (0, '<div><a href="/z">Older posts</a></div>'), (0, "<div>Share</div>"), (0, '<div><a href="/q">Top</a></div>'),
    ],
    # marked boxes without an article element
    [
        (None, '<body><div id="menu">'), (0, LINKS), (0, "<div>Search the whole site</div>"), (None, '</div><div id="content">'), (1, "<h2>Bread</h2>"), (1, f"<p>{LONG}</p>"), (1, "<p>Bake it.</p>"),
        (1, f"<p>{LINKED}</p>"), (None, '</div><div class="sidebar">'), (0, "<h4>Popular</h4>"), (0, f"<p>{LONG} {LONG}</p>"), (0, f"<p>{SHORT}</p>"), (None, "</div>"),
        (0, '<div class="cookie-notice">We and our partners store cookies on your device to show content that fits you and to count visits.</div>'),
        (0, "<form><label>Write to us and get our letter every week, free of charge and without obligation</label></form>"),
    ],
    # boxes inside an article
    [
        (None, "<body><article>"), (1, "<header><h1>Trains</h1></header>"), (1, f"<p>{LONG}</p>"), (0, '<div class="advert">A bank that listens to what you need, now also in your town and on your phone.</div>'),
        (1, f"<p>{SHORT}</p>"), (0, "<aside>Read also: the night train that came back after twenty years of waiting and hope.</aside>"), (1, f"<p>{LINKED}</p>"),
        (0, '<div class="newsletter">Get our letter every morning.</div>'), (1, '<ul><li><a href="/t">Timetable</a></li></ul>'), (1, "<p>No.</p>"), (0, "<footer>Filed under travel</footer>"), (None, "</article>"),
        (None, '<div id="comments">'), (0, f"<p>{LONG}</p>"), (0, f"<article><p>{LONG}</p></article>"), (None, "</div>"),
    ],
    # nothing but navigation
    [
        (None, "<body>"), (0, '<div><a href="/1">Page one of the list</a></div>'), (0, '<div><a href="/2">Page two of the list</a></div>'), (0, '<div><a href="/3">Page three of the list</a></div>'), (0, "<p>Page 1 of 3</p>"),
    ],
    # one long block by itself
    [(None, "<body>"), (1, f"<p>{LONG} {LONG}</p>")],
    [(None, "<body>"), (1, "<h1>Notice to all</h1>"), (1, f"<p>{LONG}</p>"), (1, f"<p>{LONG}</p>"), (1, "<p>Thank you.</p>")],
]
