import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamwork.llm import html as module
from loamwork.llm.html import extract, main_text, stretches

BODY = "<h1>Title &amp; more</h1><p>First <b>bold\n  and</b> plain text that goes on for a good while.</p><p>Short.</p><p>A second, rather long paragraph of the article&nbsp;itself, with &lt;tags&gt;.<br>After a break.<p>Unclosed one with enough text to count.<ul><li>Point one<li>Point two</ul>"
TEXT = "Title & more\nFirst bold and plain text that goes on for a good while.\nShort.\nA second, rather long paragraph of the article itself, with <tags>.\nAfter a break.\nUnclosed one with enough text to count.\nPoint one\nPoint two"
JUNK = [
    "<nav><ul><li><a href='/a'>A menu entry of some length</a></li></ul></nav>", "<header><p>Site header with a long slogan that is text too.</p></header>", "<footer>Copyright, imprint and a long legal text at the end.</footer>",
    "<aside><p>Sidebar with plenty of text about something else entirely.</p></aside>", "<div class='cookie-notice'><p>We use cookies to make this site better for you and others.</p></div>",
    "<div class=\"ad\">Buy this now, it is a very good product for everyone.</div>", "<form><label>Mail</label><input><button>Subscribe to the newsletter right now</button></form>",
    "<script>var t = '</p> some text';</script>", "<style>p{margin:0}</style>", "<!-- a <p>comment</p> -->", "<section id=comments><article><p>A reader says something long about this article here.</p></article></section>",
    "<div class='userComments'><p>Another reader comment, which is longer than the article's short lines.</p></div>", "<div role='navigation'>Navigation by role with text</div>", "<div style='display: none'>Hidden text that nobody sees on the page.</div>",
]


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div id='content'>%s</div>", "<div><div class='post'>%s</div></div>", "<body><article class='post header-big'>%s</article></body>"])
@pytest.mark.parametrize("junk", JUNK)
def test_boilerplate_goes_and_the_article_stays(wrap, junk):
    page = "<!DOCTYPE html><html><head><title>T</title></head><body>" + junk + (wrap % (BODY + junk)) + junk + "</body></html>"
    assert main_text(page) == TEXT


def test_cut_off_pages_and_odd_input():
    page = "<html><body><nav>menu</nav><article>" + BODY + "</article><footer>foot"
    assert main_text(page) == TEXT and main_text(page[: page.index("</article>")]) == TEXT
    assert main_text(None) == main_text("") == main_text("<nav>only a menu here</nav>") == main_text("<p><br></p>") == ""
    assert main_text("just text") == "just text" and main_text("<p>1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"
    assert main_text("<p>&#x41;&eacute;&unknown; &amp;amp;</p>") == "Aé&unknown; &amp;"
    long = "word " * 100_000
    assert main_text(f"<article><p>{long}</p></article>") == long.strip()


LONG = "A paragraph of the article with enough text to count as its body. " * 8


@pytest.mark.parametrize("inner", ["div", "section", "div class='text'"])
@pytest.mark.parametrize("outer", ["article", "main", "div id='content'"])
def test_lines_around_an_inner_section_stay(outer, inner):
    middle = f"<{inner}><p>{LONG}</p><p>{LONG}</p></{inner.split()[0]}>"
    page = f"<body><nav>A menu</nav><{outer}><h1>T</h1><p>lead</p>{middle}<p>end</p></{outer.split()[0]}><footer>foot</footer></body>"
    assert main_text(page) == "\n".join(["T", "lead", LONG.strip(), LONG.strip(), "end"])


def test_short_lines_beyond_the_stretch_stay_with_the_article():
    short = ["T", "by", "on", "at", "x"]
    page = "<body><article>" + "".join(f"<p>{x}</p>" for x in short) + f"<div><p>{LONG}</p></div><p><a href=x>y</a></p><p><a href=x>z</a></p><p><a href=x>w</a></p><p>end</p></article></body>"
    assert main_text(page) == "\n".join([*short, LONG.strip(), "y", "z", "w", "end"])


def test_text_of_the_stretch_outside_the_section_stays():
    page = f"<body><div><p>{LONG}</p><p>{LONG}</p></div><p>The last line.</p></body>"
    assert main_text(page) == "\n".join([LONG.strip(), LONG.strip(), "The last line."])


def test_stretches():
    assert stretches([0, 0, 50, 10, 0, 60, 0, 0, 0, 9, 0, 45, 0], 3, 40) == [(2, 6), (9, 12)]
    assert stretches([], 3, 40) == stretches([5, 5], 3, 40) == []


PLAIN = f"<h1>The headline of it</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p>"
PLAIN_TEXT = "\n".join(["The headline of it", LONG.strip(), "Short.", LONG.strip()])
MENU = "".join(f"<div><a href=/{k}>Menu entry number {k}</a></div>" for k in range(8))


@pytest.mark.parametrize("page", [
    f"<body><div class='layout has-sidebar'>{PLAIN}</div><footer>foot</footer></body>",
    f"<body class='no-sidebar'><div class='no-sidebar'><div>{PLAIN}</div></div></body>",
    f"<body><form id='aspnetForm' action='x'><input name=v>{PLAIN}</form></body>",
    f"<body><div class='post tag-related category-ads'>{PLAIN}</div><p>© Some firm 2024</p></body>",
    f"<body><div class='page-header widget'><div>{PLAIN}</div></div></body>",
    f"<body><article><header>{PLAIN}</header></article></body>",
    f"<body><article><header><h1>The headline of it</h1></header>{PLAIN.split('</h1>')[1]}</article></body>",
    f"<body><article><div class='post-header'><h1>The headline of it</h1></div>{PLAIN.split('</h1>')[1]}</article></body>",
    f"<body><div>{MENU}</div><div>{PLAIN}</div><div><a href=/i>Imprint and privacy of this site</a></div><div>© 2024 A firm with a long name, all rights reserved</div></body>",
    f"<body><div><div>{MENU}</div><div>{PLAIN}</div><div>Contact us</div><div>{MENU}</div></div></body>",
    f"<body><table><tr><td>{MENU}</td><td>{PLAIN}</td></tr></table></body>",
    f"<body><div>{PLAIN}</div><div class='comments'>{'<p>A reader says something rather long about it, again and again.</p>' * 60}</div></body>",
])
def test_names_on_wrappers_and_unmarked_menus(page):
    assert main_text(page) == PLAIN_TEXT


def test_the_method_decides(monkeypatch):
    menu = MENU.replace("div", "p")
    page = f"<body>{menu}{PLAIN}{menu}</body>"
    assert main_text(page) == PLAIN_TEXT
    monkeypatch.setattr(module, "stretches", lambda lengths: [(0, len(lengths))])
    assert main_text(page).count("Menu entry") == 16


def test_small_marked_elements_go_from_small_pages():
    for text in ("Be.", "A short page."):
        assert main_text(f"<body><div class='ad'>An advert with more text than the article, by far.</div><article><h1>{text}</h1></article></body>") == text
        assert main_text(f"<body><div><h1>{text}</h1></div><div class='cookie-bar'>We use cookies to make this site better.</div></body>") == text
    assert main_text(f"<body><div class='widget'>{PLAIN}</div><p>Some line</p></body>") == PLAIN_TEXT + "\nSome line"


def test_marked_elements_beside_an_article_go_whatever_their_size():
    for junk in (f"<div class='sidebar'><p>{LONG}</p><p>{LONG}</p></div>", f"<div id='comments'><p>{LONG}</p></div>", f"<form><input><p>{LONG}</p></form>", f"<div role='alert'><p>{LONG}</p></div>"):
        assert main_text(f"<body>{junk}<article><h1>Be.</h1><p>It is.</p></article>{junk}</body>") == "Be.\nIt is."
        assert main_text(f"<body><main><p>Short.</p></main>{junk}</body>") == "Short."
    assert main_text(f"<body><div class='widget'><article>{PLAIN}</article></div></body>") == PLAIN_TEXT
    assert main_text(f"<body><article><div class='widget'>{PLAIN}</div></article><div class='widget'><p>{LONG}</p></div></body>") == PLAIN_TEXT


def test_text_after_a_list_of_links_stays():
    page = f"<body><div id=text><p>{LONG}</p>{'<p><a href=x>A link to somewhere</a></p>' * 5}<p>{LONG[:199]}</p></div><div>{'<p>Another box.</p>' * 9}</div></body>"
    assert main_text(page) == LONG.strip() + "\n" + LONG[:199].strip()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<article>", "</article>", "<a href=x>", "</a>", "text ", "<script>", "</script>", "<", "&amp;", "<br/>", "<!--", "-->", "\n", "<li>", "<nav>", "</nav>", "'", '"']), max_size=30))
def test_any_tags(parts):
    for line in main_text("".join(parts)).split("\n"):
        assert line == " ".join(line.split())


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", BODY, "t", 3), (1, "u", BODY, "t", 3), (None, None, None, None, None), (2, "v", "", "x", 0)], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (None, None, "", 0), (2, "v", "", 0)], key=str)
    assert extract(pages.limit(0)).count() == 0
