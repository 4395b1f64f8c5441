"""Pages written by hand, none made by the rules that the tree learned from."""

import pytest

from codeweft.llm import html_text

P = "The committee met for three hours on Tuesday and agreed, after much debate, that the bridge should be repaired before winter and paid for by the county, although two members of the council said that they would vote against it."
Q, R = P.replace("Tuesday", "Monday"), P.replace("Tuesday", "Friday")
NAV = "<ul>" + "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("News", "Sport", "Weather", "Local", "Opinion")) + "</ul>"

CASES = {
    "wrapper without a sidebar": (f'<div class="page no-sidebar"><main><h1>T</h1>{P}</main></div>', ["T", P]),
    "wrapper with a sidebar to the right": (f'<div class="layout sidebar-right"><article>{P}</article></div>', [P]),
    "main with sidebar": (f'<div class="main with-sidebar"><p>{P}</p><p>{Q}</p></div>', [P, Q]),
    "main with sidebar, bare text": (f'<div class="main with-sidebar">{P} {Q}</div>', [f"{P} {Q}"]),
    "widget content": (f'<div class="widget-content"><p>{P}</p><p>{Q}</p></div>', [P, Q]),
    "widget content, bare text": (f'<div class="widget-content">{P} {Q}</div>', [f"{P} {Q}"]),
    "an id from a headline": (f'<div id="comments-on-the-law"><h1>Law</h1><p>{P}</p><p>{Q}</p></div>', ["Law", P, Q]),
    "a section on social history": (f'<article><p>{P}</p><div class="social-history"><p>{Q}</p></div></article>', [P, Q]),
    "a short one": (f'<article>{P}<div class="social-history"><p>It was so.</p></div></article>', [P, "It was so."]),
    "a line with a link": (f"<div>{P}<p>See <a href=x>the report</a>.</p>{Q}</div>", [P, "See the report.", Q]),
    "a line that is a link": (f"<div>{P}<p><a href=x>Full report of the committee</a></p><p>{Q}</p><p>{R}</p></div>", [P, "Full report of the committee", Q, R]),
    "a short line after a link": (f"<div>{P}<p><a href=x>Read it</a></p><p>It was late.</p><p>{Q}</p></div>", [P, "Read it", "It was late.", Q]),
    "owner's line below an article": (f"<article><h1>T</h1><p>{P}</p></article><div>Copyright 2020 Daily News. All rights reserved.</div>", ["T", P]),
    "owner's line below a div": (f"<div><h1>T</h1><p>{P}</p><p>{Q}</p></div><div>Copyright 2020 Daily News. All rights reserved.</div>", ["T", P, Q]),
    "comments beside a misnamed wrapper": (f'<div class="sidebar-left"><article><h1>T</h1><p>{P}</p><p>{Q}</p></article></div><section class="comments"><p>{R}</p><p>No way.</p></section>', ["T", P, Q]),
    "a whole site": (f'<header><a href="/">Daily</a></header><nav>{NAV}</nav><div id="page" class="has-sidebar"><main><article><h1>Bridge</h1><p>{P}</p><h2>Costs</h2><p>{Q}</p><ul><li>Two piers</li><li>One road</li></ul></article></main><aside><h3>More</h3><p>{R}</p></aside></div><footer>Daily News, Main Street</footer>', ["Bridge", P, "Costs", Q, "Two piers", "One road"]),
    "a cookie notice over a blog": (f'<div class="cookie-consent"><p>We use cookies. By going on you agree.</p></div><div id="nav-main">{NAV}</div><div class="post"><h1>Bridge</h1><p>{P}</p><p>{Q}</p></div><div class="comment-list"><p>{R}</p><p>I agree.</p></div>', ["Bridge", P, Q]),
    "an advert between paragraphs": (f'<div><h1>Bridge</h1><p>{P}</p><div class="ad">Buy now, pay later, get more of everything.</div><p>{Q}</p></div>', ["Bridge", P, Q]),
    "a form around all": (f'<form id="aspnet"><div>{NAV}</div><article><p>{P}</p><p>{Q}</p></article></form>', [P, Q]),
    "an old page of bare text": (f"<body>{P}<br><br>{Q}</body>", [f"{P} {Q}"]),
}


@pytest.mark.parametrize("case", CASES)
def test_page(case):
    page, want = CASES[case]
    assert html_text.main_text(page).split("\n") == want


def test_an_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, text int")
    assert html_text.extract(none, ["page_id", "url"]).collect() == []


def test_a_long_page_stays_whole():
    page = "<article>" + "".join(f"<p>{P} Number {i}.</p>" for i in range(20_000)) + "</article>"
    assert html_text.main_text(page).count("\n") == 19_999
    deep = "<div>" * 50_000 + f"<p>{P}</p>"
    assert html_text.main_text(deep) == P
