"""Pages written by hand for the tests alone: no layout is among those that the model learns from.

Each page is a list of (part, html); parts named text are the main text, all others are what must go.
"""

A = "The ferry leaves at six in the morning and comes back after dark, whatever the weather is like."
B = "Most of the passengers work on the other shore, in the yards or in the two schools that are left there."
C = "In winter the crossing takes an hour longer, and the captain makes coffee for everyone on board."
D = "A bridge has been promised since 1968; the model of it still stands in the town hall, under glass."
E = "Three bids were received, all of them above the sum that had been set aside."
F = "Then the money went to the airport."
G = "The study followed 1,200 households over nine years and asked each of them the same forty questions."
H = "Results are given in the table, together with the error of each estimate and the number of answers."

PAGES = {
    "news site": [
        ("header", '<!DOCTYPE html><html><head><title>Ferry</title><style>.x{color:red}</style></head><body class="home"><div class="site-header"><span>The Evening Paper</span></div>'),
        ("menu", '<div class="main-nav"><ul><li><a href="/a">Politics</a></li><li><a href="/b">Money</a></li><li><a href="/c">Weather</a></li></ul></div>'),
        ("notice", '<div id="gdpr-consent"><p>We and our partners store data on your device. Choose what you allow.</p></div>'),
        ("text", f'<div class="article__wrapper"><h1>Six in the morning</h1><div class="article__text"><p>{A}</p><p>{B} {C}</p>'),
        ("advert", '<div class="advert"><p>Fly for nine euros. Book today and pay next year.</p></div>'),
        ("text", f"<h2>Under glass</h2><p>{D}</p><p>{E}</p><p>{F}</p></div></div>"),
        ("menu", '<div class="share-tools"><a href="#">Share</a><a href="#">Print</a></div>'),
        ("comments", '<div class="comments-area"><h4>Two comments</h4><div><p>My father was on that boat for thirty years and never missed a day of it.</p></div><div><p>They will never build it, mark my words.</p></div></div>'),
        ("footer", '<div class="page-footer"><p>Printed on paper from forests that are looked after.</p></div></body></html>'),
    ],
    "home page of a person": [
        ("menu", "<html><body><p><a href=1>Home</a> | <a href=2>Photos</a> | <a href=3>Guestbook</a></p>"),
        ("text", f"<h2>The ferry</h2><p>{A}<p>{B}<p>{C}<ul><li>blankets<li>tea<li>a lamp</ul><p>{D}"),
        ("footer", "<hr><small><a href=4>Mail me</a></small></body></html>"),
    ],
    "paper": [
        ("header", '<body><div class="masthead"><p>Annals of Small Places</p></div>'),
        ("text", f'<div class="paper"><h1>Crossing times</h1><h3>Abstract</h3><p>{G}</p><h3>Related work</h3><div class="related"><p>{H} {G}</p><p>{B} {A}</p><p>{D} {E}</p></div><h3>Method</h3><p>{H}</p><p>{C}</p></div>'),
        ("menu", '<div class="citation-tools"><a href=1>BibTeX</a> <a href=2>RIS</a></div></body>'),
    ],
    "forum of questions": [
        ("menu", "<body><header><a href=1>Questions</a><a href=2>Tags</a></header>"),
        ("text", f'<main><div class="question"><h1>How long is the crossing?</h1><div class="post-text"><p>{A}</p><p>{B}</p><p>{C}</p></div></div></main>'),
        ("sidebar", '<div class="right-sidebar"><h4>Linked</h4><ul><li><a href=1>When does the bridge open?</a></li><li><a href=2>Who pays for it?</a></li></ul></div>'),
        ("footer", "<footer><p>Answers are under a free licence.</p></footer></body>"),
    ],
    "comments in an ordered list": [
        ("text", f"<body><article><h1>Under glass</h1><p>{D}</p><p>{E}</p><p>{A}</p><p>{G}</p></article>"),
        ("comments", "<section><ol><li><p>I saw the model as a child, it had little cars on it.</p></li><li><p>So did I. The cars were taken later.</p></li></ol></section>"),
        ("form", '<form action="/c"><label>Your comment</label><textarea>Write here</textarea><button>Send</button></form></body>'),
    ],
    "layout in a table": [
        ("menu", '<body><table border=0><tr><td width=120><a href=1>Timetable</a><br><a href=2>Fares</a><br><a href=3>Map</a></td>'),
        ("text", f"<td><h1>Fares</h1><p>{A} {B}</p><p>{C} {D}</p><p>{E}</p></td></tr></table>"),
        ("footer", "<p><font size=1><a href=5>Webmaster</a></font></p></body>"),
    ],
    "plain divs": [
        ("menu", "<body><div><a href=1>Start</a> <a href=2>Archive</a></div>"),
        ("text", f"<div><h1>Winter</h1><div>{C} {A}</div><div>{B} {D}</div><div>{E} {G}</div></div>"),
        ("advert", '<div class="sponsored-links"><div>Cheap cars, cheap flats, cheap phones.</div></div></body>'),
    ],
    "shop's blog": [
        ("menu", '<body><nav class="navbar"><a href=1>Shop</a></nav>'),
        ("text", f'<div class="container"><div class="post-content"><h1>Blankets</h1><p>{A}</p><figure><img src=b><figcaption>A blanket on the ferry.</figcaption></figure><p>{B} {C}</p><ol><li>Wash at thirty degrees.</li><li>Dry in the wind.</li></ol><p>{F} {D}</p></div></div>'),
        ("advert", '<div class="newsletter-signup"><h3>Stay in touch</h3><p>Leave your address and get ten per cent off the first order.</p></div>'),
        ("menu", '<div class="recommended"><ul><li><a href=1>Wool socks</a></li><li><a href=2>Red lamp</a></li></ul></div>'),
        ("notice", '<div class="notification" hidden>Your basket is empty.</div></body>'),
    ],
    "manual": [
        ("menu", '<body><aside class="toc"><ul><li><a href=1>Setup</a></li><li><a href=2>Use</a></li></ul></aside>'),
        ("text", f'<section id="usage"><h1>Use</h1><p>{H}</p><pre>ferry --at 6</pre><h2>Errors</h2><p>{G}</p><table><tr><th>code</th><th>meaning</th></tr><tr><td>1</td><td>no water</td></tr></table><p>{A} {C}</p></section>'),
        ("footer", '<div role="contentinfo" class="footer">Built with a generator.</div></body>'),
    ],
    "search study": [
        ("menu", '<body><div class="topmenu"><a href=1>Group</a><a href=2>People</a></div>'),
        ("text", f'<div id="content"><h1>Search on water</h1><div class="search-results-study"><p>{G} {H}</p><p>{E} {A}</p></div><div class="notice-board-history"><p>{D} {B}</p><p>{C}</p></div></div>'),
        ("sidebar", '<div id="sidebar"><p>Next talk on Monday at noon in the small room.</p></div></body>'),
    ],
}

#: Pages whose parts have names that are in no list of the operator, or none.
UNNAMED = {
    "boxes in an article": [
        ("menu", "<body><div class='ribbon'><a href=1>Front</a> <a href=2>City</a> <a href=3>Sea</a></div>"),
        ("notice", "<div class='alert'><p>You are reading an old edition. Please use the new one.</p></div>"),
        ("text", f"<article><h1>Six in the morning</h1><p>{A} {B}</p><p>{C}</p>"),
        ("advert", "<div class='outbrain'><p>Boats at half the price, only this week.</p></div>"),
        ("text", f"<p>{D} {E}</p><p>{G}</p>"),
        ("notice", "<div class='paywall'><p>Choose one of our offers and go on reading for a month.</p></div>"),
        ("text", f"<p>{H}</p><p>{F} {A}</p></article>"),
        ("sidebar", "<div class='most-read'><h4>Most read</h4><ol><li><a href=1>Storm closes the harbour</a></li><li><a href=2>Goal in the last minute</a></li></ol></div>"),
        ("comments", "<div class='user-opinions'><p>My father was on that boat for thirty years.</p><p>They will never build it.</p></div></body>"),
    ],
    "boxes in a container": [
        ("menu", "<body><div id='zz'><a href=1>Start</a><a href=2>Trips</a></div>"),
        ("text", f"<div class='left-part'><h1>Winter</h1><p>{C} {A}</p><p>{B}</p>"),
        ("notice", "<div class='disclaimer'><p>What is said here is the opinion of its author alone.</p></div>"),
        ("text", f"<p>{D} {G}</p><p>{H} {E}</p>"),
        ("sidebar", "<div class='author-bio'><p>The author lives by the sea and has two dogs.</p></div>"),
        ("text", f"<p>{B} {F}</p></div>"),
        ("advert", "<div class='jobs'><p>We are hiring drivers and cooks in three towns.</p></div></body>"),
    ],
    "a page in a form": [
        ("menu", "<body><form id='aspnetForm' method='post'><div id='ctl00_Bar'><a href=1>Home</a> <a href=2>Archive</a></div>"),
        ("text", f"<div id='ctl00_Text'><h1>Crossing times</h1><p>{G}</p><p>{H} {C}</p><p>{A} {B}</p></div>"),
        ("form", "<div id='ctl00_Ask'><label>Your address</label><input><p>Leave your address and we will write to you.</p></div>"),
        ("footer", "<div id='ctl00_End'><p>Please tell us when you find a mistake.</p></div></form></body>"),
    ],
    "sections with names of their own": [
        ("header", "<body><div class='topline'><span>Harbour Society</span></div>"),
        ("text", f"<div class='zone'><div class='crossing-alert-systems'><h2>Alerts</h2><p>{A} {B}</p><p>{C} {D}</p></div><div class='legal-history'><h2>Law</h2><p>{G} {H}</p><p>{E} {A}</p></div><div class='jobs-on-board'><h2>Work</h2><p>{B} {C}</p><p>{D}</p></div></div>"),
        ("footer", "<div class='baseline'><p>Made by its members.</p></div></body>"),
    ],
    "comments without a name": [
        ("text", f"<body><div><h1>Under glass</h1><p>{D} {E}</p><p>{A} {C}</p><p>{G}</p></div>"),
        ("comments", "<div><h3>What others say</h3><div><b>Kim</b><p>I saw the model as a child.</p></div><div><b>Lee</b><p>So did I. The cars were taken later.</p></div></div>"),
        ("form", "<form action='/c'><label>Name</label><input><label>Text</label><textarea></textarea></form></body>"),
    ],
    "infobars and toasts": [
        ("notice", "<body><div class='infobar'><p>This website stores data so that it can serve you better.</p></div>"),
        ("text", f"<main><h1>Fares</h1><p>{E} {F} {A}</p><p>{B} {G}</p>"),
        ("advert", "<div class='trending'><p>Now: heat wave, cup final, election night</p></div>"),
        ("text", f"<p>{H} {D}</p></main>"),
        ("notice", "<div class='toast'><p>Saved to your list.</p></div><div class='cc-window'><p>We use data to give you a better visit.</p></div></body>"),
    ],
}
