"""Labelled pages for the tree model: layouts written by hand, and random ones.

A block that is content carries the word x (in pages written by hand: an attribute x, put
in as role="xcontent"); the word is no feature. Blocks that hold others are content if most
of their text is. Sentences are put in where a page has {n}, a paragraph of n of them.
"""

from __future__ import annotations

import re

import numpy as np

# Sentences of the pages written by hand.
SENTENCES = [
    "The council met on Tuesday to discuss the plan for the old harbour.", "Nobody expected the vote to be close.", "Engineers had warned for years that the wall would not hold.", "A second survey, paid for by the county, found the same cracks.",
    "We drove north until the road became gravel.", "Prices rose by four per cent in the spring, faster than wages.", "The method is simple: measure twice, write both numbers down, and keep the larger.", "It was raining.", "Her first book sold three hundred copies, most of them to friends.",
    "In the following section we describe how the samples were taken and why two of them were left out.", "The museum keeps the original drawings in a room without windows.", "Add the flour slowly and stir until no lumps are left.", "Critics called it a mistake; visitors did not seem to mind.",
    "When the function returns, the buffer is released and must not be read again.", "He said that he would think about it.", "After the war the factory made bicycles, then lawn mowers, then nothing.", "The tables below list all versions since the first release.", "Two rivers meet here, one brown and one green, and for a mile they do not mix.",
]

# The pages written by hand.
LAYOUTS = [
    # a newspaper, all in divs
    '<body><div id="masthead"><h1><a href=/>The Daily Note</a></h1><ul><li><a href=/w>World</a></li><li><a href=/s>Sport</a></li></ul></div><div class="cookie-banner"><p>We use cookies to make this site work. By going on you agree.</p><button>OK</button></div><div class="story-wrap"><h1 x>{1}</h1><p class="byline">By A. Writer, 3 May</p><div class="body"><p x>{3}</p><p x>{4}</p><div class="ad-slot"><p>Buy two, get one. Offer ends soon, see the shop for details.</p></div><h2 x>{1}</h2><p x>{3}</p><blockquote x><p x>{1}</p></blockquote><p x>{2}</p></div><div class="share-links"><a href=#>Mail</a><a href=#>Print</a></div></div><div id="comments"><h3>4 comments</h3><div class="comment"><p>{2}</p></div><div class="comment"><p>{3}</p></div></div><div class="footer"><p>All rights reserved by the paper. Contact us for reprints.</p></div></body>',
    # a blog whose readers' comments are a list without a name
    '<body><div class="top"><a href=/>Home</a> <a href=/about>About</a></div><div class="post"><h2 x>{1}</h2><p x>{4}</p><p x>{3}</p><p x>{5}</p><ul x><li x>{1}</li><li x>{1}</li></ul><p x>{2}</p></div><ol><li><p>Anna wrote: {1}</p></li><li><p>Ben wrote: {2}</p></li><li><p>Cem wrote: {1}</p></li></ol><p>Powered by a blog program</p></body>',
    '<body><article><h1 x>{1}</h1><p x>{4}</p><p x>{2}</p><p x>{3}</p></article><h3>What readers say</h3><ol><li><b>Kim</b> <p>{2}</p></li><li><b>Lee</b> <p>{3}</p></li></ol><form><textarea></textarea></form></body>',
    # a page of a laboratory; names of its parts sound like those of other things
    '<body><div id="header"><p>Institute of Stones</p><ul><li><a href=1>People</a></li><li><a href=2>Papers</a></li></ul></div><div id="content"><h1 x>{1}</h1><p x>{3}</p><div class="related-work"><h2 x>Related work</h2><p x>{4}</p><p x>{3}</p></div><div class="search-method"><h2 x>Search</h2><p x>{3}</p><p x>{3}</p></div><div class="results"><p x>{5}</p></div></div><div id="footer">Last changed in June</div></body>',
    '<body><main><section class="intro"><h1 x>{1}</h1><p x>{2}</p></section><section class="notice-period-law"><h2 x>Notice</h2><p x>{4}</p></section><section class="comment-on-rules"><h2 x>{1}</h2><p x>{3}</p><p x>{3}</p></section></main><div class="newsletter"><p>Get our letter every week. Leave your address.</p><input></div></body>',
    # a layout table
    '<body><table width=100%><tr><td valign=top><a href=a>Start</a><br><a href=b>News</a><br><a href=c>Links</a></td><td><h1 x>{1}</h1><p x>{4}</p><p x>{3}</p><p x>{4}</p></td><td><p>Webring</p><a href=d>next</a></td></tr><tr><td colspan=3><font size=1>Made with a text editor</font></td></tr></table></body>',
    '<body bgcolor=white><center><a href=x>up</a> | <a href=y>down</a></center><h1 x>{1}</h1><p x>{5}<p x>{4}<p x>{3}<table border=1 x><tr x><th x>Year</th><th x>Count</th></tr><tr x><td x>1990</td><td x>12</td></tr><tr x><td x>1991</td><td x>15</td></tr></table><p x>{2}<hr><p><a href=z>back to the index</a></body>',
    # documentation
    '<body><nav><a href=1>Guide</a></nav><div class="sidebar"><ul><li><a href=1>Install</a></li><li><a href=2>Use</a></li><li><a href=3>Errors</a></li></ul></div><div class="document"><h1 x>{1}</h1><p x>{2}</p><pre x>make install\nmake test</pre><h2 x>Options</h2><dl x><dt x>size</dt><dd x>{1}</dd><dt x>depth</dt><dd x>{2}</dd></dl><p x>{2} <a href=4>See there</a>.</p></div><div class="pager"><a href=5>Previous</a><a href=6>Next</a></div></body>',
    # a wiki
    '<body><div id="siteNotice"><p>Please give to keep this site free. Every gift helps the editors.</p></div><div id="content" class="mw-body"><h1 x>{1}</h1><div id="bodyContent"><p x>{4}</p><div class="toc"><ul><li><a href=#1>1 Past</a></li><li><a href=#2>2 Use</a></li></ul></div><h2 x>Past</h2><p x>{5}</p><h2 x>Use</h2><p x>{3}</p><ul x><li x>{1}</li><li x>{2}</li></ul></div></div><div id="mw-navigation"><h2>Menu</h2><ul><li><a href=1>Talk</a></li><li><a href=2>History</a></li></ul></div></body>',
    # a recipe
    '<body><header><h2>Good Kitchen</h2></header><div class="breadcrumbs"><a href=1>Food</a> &gt; <a href=2>Bread</a></div><div class="entry-content"><h1 x>{1}</h1><p x>{2}</p><h3 x>You need</h3><ul x><li x>500 g flour</li><li x>salt</li><li x>300 ml water</li></ul><ol x><li x>{1}</li><li x>{2}</li><li x>{1}</li></ol></div><div class="related-posts"><h3>You may also like</h3><ul><li><a href=1>Rye bread</a></li><li><a href=2>Plum cake</a></li></ul></div><section class="replies"><div><p>{1}</p></div><div><p>{3}</p></div></section></body>',
    # text in divs, without paragraphs
    '<body><div class="menu"><div><a href=1>One</a></div><div><a href=2>Two</a></div></div><div class="main"><div x>{1}</div><div x>{4}</div><div x>{3}</div><div x>{5}</div></div><div class="promo"><div>Half price this week only, in all our shops.</div></div></body>',
    '<body><div><div x>{3}</div><br><div x>{4}</div><br><div x>{2}</div></div><div><a href=1>a</a> <a href=2>b</a> <a href=3>c</a></div></body>',
    '<body x>{4}<br><br>{3}<br><br>{5}<br><a href=1>home</a></body>',
    # a list of articles, each short
    '<body><nav><a href=1>All</a></nav><main><article><h2 x>{1}</h2><p x>{2}</p></article><article><h2 x>{1}</h2><p x>{3}</p></article><div class="sponsored"><p>A word from those who pay for this page.</p></div><article><h2 x>{1}</h2><p x>{2}</p></article></main><aside><p>{2}</p></aside></body>',
    '<body><div class="container"><div class="row"><div class="col-8"><h1 x>{1}</h1><p x>{3}</p><p x>{4}</p><figure x><img src=1><figcaption x>{1}</figcaption></figure><p x>{3}</p></div><div class="col-4"><h4>Most read</h4><ol><li><a href=1>A storm</a></li><li><a href=2>A goal</a></li></ol></div></div></div><div class="copyright"><p>Copyright of this page is with its owner.</p></div></body>',
    '<body><div role="banner"><p>The River Society, since 1902</p></div><div class="warning-box"><p>This form is out of use. Please do not send it any more.</p></div><div id="article-text"><p x>{5}</p><p x>{1}</p><p x>{4}</p><div class="tags"><a href=1>rivers</a><a href=2>fish</a></div></div><div class="author-widget"><p>The author walks a lot and lives by the sea.</p></div></body>',
    # a page in a form
    '<body><form id="aspnetForm" method="post"><input type="hidden"><div id="top"><a href=1>Home</a> <a href=2>Search</a></div><div id="ctl00_Body"><h1 x>{1}</h1><p x>{4}</p><p x>{3}</p><div class="callout"><p>Please log in to save this page to your list.</p></div><p x>{4}</p></div><div id="ctl00_End"><p>You are reading this page as a guest.</p></div></form></body>',
    # parts without a telling name
    '<body><div class="infobox-a"><p>You have not read your messages. Please open your inbox.</p></div><article><h1 x>{1}</h1><p x>{3}</p><p x>{4}</p><div class="pull"><p>Sign up and get our stories in your inbox.</p></div><p x>{3}</p><section class="bridge-history"><h2 x>{1}</h2><p x>{3}</p><p x>{4}</p></section><p x>{2}</p></article><div class="under"><p>Follow us where you like.</p></div></body>',
    '<body><div class="zz1"><p>{1}</p></div><div class="zz2"><h1 x>{1}</h1><p x>{3}</p><div class="zz3"><p>{1}</p></div><p x>{4}</p><p x>{2}</p><div class="zz4"><a href=1>{1}</a><a href=2>{1}</a></div><p x>{3}</p></div><div class="zz5"><p>{2}</p></div></body>',
    # short ones
    '<p x>one</p><p x>two</p>', '<p x>A word.</p>', '<div x>Short</div>', '<body><h1 x>Note</h1><p x>It was raining.</p></body>', '<body><a href=1>back</a><p x>Closed on Monday.</p></body>', '<ul x><li x>one<li x>two</ul>', '<article><p x>Gone.</p></article><footer>end</footer>',
]


def hand_written() -> list[str]:
    at = 0

    def some(m: re.Match) -> str:
        nonlocal at
        n = int(m[1])
        at += n
        return " ".join(SENTENCES[(at - n + i) * 5 % len(SENTENCES)] for i in range(n))

    return [re.sub(r"(?<=[\w\"%]) x(?=[ >])", ' role="xcontent"', re.sub(r"\{(\d)\}", some, page)) for page in LAYOUTS]


def random_pages(n: int = 120, seed: int = 7, named: bool = True) -> list[str]:
    """Layouts of random parts; content blocks have the class xcontent. Not named: half of the parts have names in no list, and there are more boxes in the text, lines of links, and forms."""
    rng = np.random.default_rng(seed)
    pick = lambda *a: a[int(rng.integers(len(a)))]

    def words(low: int, high: int) -> str:
        return " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, 9)))) for _ in range(int(rng.integers(low, high)))).capitalize() + "."

    def prose() -> str:
        out = [f'<h1 class="xcontent">{words(2, 9)}</h1>']
        for _ in range(int(rng.integers(1, 8))):
            kind = rng.integers(12)
            if kind == 0:
                out.append(f'<h2 class="xcontent">{words(1, 6)}</h2>')
            elif kind == 1:
                out.append('<ul class="xcontent">' + "".join(f'<li class="xcontent">{words(1, 15)}</li>' for _ in range(3)) + "</ul>")
            elif kind == 2:
                out.append(f'<blockquote class="xcontent"><p class="xcontent">{words(3, 40)}</p></blockquote>')
            elif kind == 3:
                out.append(f'<table class="xcontent"><tr class="xcontent"><td class="xcontent">{words(1, 5)}</td><td class="xcontent">{words(1, 5)}</td></tr></table>')
            elif kind == 4:
                out.append(f'<p class="xcontent">{words(1, 3)}</p>')
            elif kind == 5:
                out.append(f'<p class="xcontent">{words(3, 20)} <a href="/x">{words(1, 4)}</a> {words(2, 20)}</p>')
            elif kind == 6 and not named:
                name = pick("", "", f' id="{name_of()}"')
                out.append(f'<{pick("div", "section")}{name} class="{pick(name_of(), "part", "block")} xcontent"><h3 class="xcontent">{words(1, 6)}</h3>' + "".join(f'<p class="xcontent">{words(25, 90)}</p>' for _ in range(int(rng.integers(2, 5)))) + "</div>")
            else:
                out.append(f'<p class="xcontent">{words(5, 120)}</p>')
            if rng.integers(9 if named else 4) == 0:
                out.append(boiler())
        return "".join(out)

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 4)}</a></li>' for i in range(k)) + "</ul>"

    def link_line() -> str:
        return f"<{(kind := pick("p", "div", "p"))}>" + pick(" | ", " ", " - ").join(f'<a href="/{i}">{words(1, 3)}</a>' for i in range(int(rng.integers(1, 6)))) + f"</{kind}>"

    def name_of() -> str:
        """A name that is in no list."""
        return "".join(pick("ba", "ke", "li", "mo", "nu", "ra", "se", "to", "vi", "zu") for _ in range(int(rng.integers(2, 5)))) + pick("", "-box", "-wrap", "_1")

    def said() -> str:
        """Short text of the page itself: it speaks to its reader more often than not."""
        some = words(2, 40)
        return some if rng.integers(3) == 0 else f"{pick('Please', 'You can', 'Sign up and', 'We use what you', 'Click here and')} {some.lower()} {pick('Your', 'Subscribe', 'Contact us')} {words(1, 8).lower()}"

    def boiler() -> str:
        name = name_of() if not named and rng.integers(2) else pick("ad", "sidebar", "comments", "cookie-notice", "related", "share-bar", "newsletter", "menu", "breadcrumb", "promo banner", "footer", "notice")
        inner = pick(*([] if named else [f"<p>{said()}</p>"]), f"<p>{words(2, 60)}</p>", links(3), f"{words(2, 30)}", f"<h3>{words(1, 4)}</h3><p>{words(2, 40) if named else said()}</p><p>{words(2, 40)}</p>", f"<div><p>{words(4, 50)}</p></div>")
        return f'<{pick("div", "section", "div")} {pick("class", "id")}="{name}">{inner}</div>' if rng.integers(2) else f'<div class="{name}">{inner}</div>'

    out = []
    for _ in range(n):
        top = pick(f"<nav>{links(5)}</nav>", f'<div class="nav">{links(4)}</div>', f"<header><h1>{words(1, 4)}</h1>{links(3)}</header>", f"<ul>{''.join(f'<li><a href=#>{words(1, 3)}</a></li>' for _ in range(5))}</ul>", *([] if named else [link_line(), link_line()]), "")
        tail = pick(f"<footer>{words(2, 14)}</footer>", f'<div id="footer"><p>{words(3, 20)}</p></div>', f"<aside>{words(3, 30)}</aside><footer>{links(3)}</footer>", *([] if named else [link_line(), "<hr>" + link_line(), link_line()]), "")
        box = pick(("article", ""), ("main", ""), ("div", "content"), ("div", "post-body"), ("div", "article-text"), ("div", ""), ("section", "story"))
        body = f'<{box[0]} class="{box[1]} xcontent">{prose()}</{box[0]}>'
        if rng.integers(3) == 0:
            body = f"<div>{body}</div>"
        ask = f'<form action="/s"><label>{words(1, 3)}</label><input><p>{said()}</p></form>' if not named and rng.integers(3) == 0 else ""
        between = "".join(boiler() for _ in range(int(rng.integers(0, 3))))
        after = "".join(boiler() for _ in range(int(rng.integers(0, 3))))
        inner = f"{top}{between}{body}{ask}{after}{tail}"
        if not named and rng.integers(8) == 0:  # one form around the page
            inner = f'<form method="post" id="{pick("aspnetForm", "form1", name_of())}"><div><input type="hidden"></div>{inner.replace("<form", "<div").replace("</form", "</div")}</form>'
        out.append(f"<html><head><title>{words(1, 5)}</title><style>p{{}}</style></head><body>{inner}</body></html>")
    return out
