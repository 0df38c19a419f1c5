import html as entities
import re

import numpy as np

from cloakwork.llm import main_text as M

PARAGRAPHS = "".join(f"<p>Paragraph {i} has a good many words of prose in it, and a link <a href=x>here</a>, for reading.</p>" for i in range(6))


def test_article_without_what_stands_around_it():
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies, a lot of them, really.</div>"
        f"<main><article><h1>Title</h1>{PARAGRAPHS}<aside>See also</aside><form><input><p>Subscribe to it</p></form><p>End.</p></article>"
        "<section id=comments><p>A reader's comment, which is long enough to look like prose to anyone who counts.</p></section></main>"
        "<div class=sidebar>More things to read on this side of the page</div><footer>&copy; us</footer></body></html>"
    )
    got = M.main_text(page).split("\n")
    assert got[0] == "Title" and got[-1] == "End." and len(got) == 8
    assert got[1] == "Paragraph 0 has a good many words of prose in it, and a link here, for reading."


def test_article_found_without_a_marked_element():
    page = f"<body><div><ul>{'<li><a href=x>link</a></li>' * 20}</ul></div><div id=content>{PARAGRAPHS}</div><div><p>Imprint</p></div></body>"
    assert len(M.main_text(page).split("\n")) == 6


def test_articles_in_unequal_sections_are_whole():
    long, short = ("".join(f"<p>{k} {i} is a paragraph of plain prose that goes on for some time.</p>" for i in range(n)) for k, n in (("L", 10), ("S", 4)))
    links = f"<div><ul>{'<li><a href=x>link</a></li>' * 20}</ul></div>"
    for parts in (
        f"<div>{long}</div><div>{short}</div>",
        f"<section>{short}</section><section>{long}</section>",
        f"<table><tr><td>{long}</td><td>{short}</td></tr></table>",
        f"<div><div>{short}</div><p>In between.</p><div><div>{long}</div></div></div>",
    ):
        want = 14 + parts.count("In between.")
        for page in (f"<body>{links}<div id=content>{parts}</div><div><p>Imprint</p></div></body>", f"<body><p>{parts}</body>"):
            got = M.main_text(page).split("\n")
            assert len([t for t in got if t != "Imprint"]) == want and "link" not in got
    lead = "The lead stands in the outer element and says in one sentence what the article is about."
    got = M.main_text(f"<body>{links}<div><h1>Title</h1><p>{lead}</p><div>{long}</div></div></body>").split("\n")
    assert got[:2] == ["Title", lead] and len(got) == 12
    got = M.main_text(f"<body>{links}<hr><div>{short}</div><div>Short.</div><div>{long}</div><div><ul>{'<li><a href=x>more</a></li>' * 20}</ul></div>").split("\n")
    assert [t for t in got if t not in ("link", "more")] == [*M.main_text(short).split("\n"), "Short.", *M.main_text(long).split("\n")]
    assert got.count("link") + got.count("more") <= 2 * M.REACH


def test_names_of_what_holds_the_article_drop_nothing():
    side = "<div class='sidebar'><p>More things to read on this side of the page, many of them.</p></div>"
    for around in (
        "<body class='single-post has-sidebar'>{}",
        "<html class='no-banner with-ads'><body id=menu>{}",
        "<body><div id='content' class='with-sidebar'>{}</div>",
        "<body><div class='layout sidebar-right'>{}</div>",
        "<body><div class='social'>{}</div>",
        "<body><div class='widget'><div class='promo'>{}</div></div>",
        "<body><article class='post social'>{}</article>",
        "<body><main id=header class='comments-open'>{}</main>",
        "<body><x-page class='social'>{}</x-page>",
    ):
        got = M.main_text(around.format(PARAGRAPHS + side)).split("\n")
        assert len(got) == 6 and got[0].startswith("Paragraph 0"), around
    comments = "".join(f"<p>A reader says at some length what there is to say, for the {i}th time.</p>" for i in range(30))
    got = M.main_text(f"<body><div>{PARAGRAPHS}</div><div class=comments>{comments}</div><div class='sidebar-right'><p>Aside.</p></div>")
    assert len(got.split("\n")) == 6
    got = M.main_text(f"<body><div class=widget>{PARAGRAPHS}<p>Seen <span class=ad>unseen</span><div>End.</div></div><p>x <b class=ad><div>y")
    assert "unseen" not in got and got.split("\n")[6:8] == ["Seen", "End."]


def test_broken_empty_and_plain():
    assert M.main_text(None) == M.main_text("") == M.main_text("<script>x</script>") == M.main_text("<nav>x</nav>") == ""
    assert M.main_text("just &amp; text\n  here") == "just & text here"
    assert M.main_text("<article><p>One<p>two <b>three<p>four &lt;5 &nope; &am") == "One\ntwo three\nfour <5 &nope; &am"
    assert M.main_text("<article><p>a<br>b</p></article><nav>c") == "a b"


def test_long_pages_are_fed_in_parts():
    page = "<article>" + "<p>" + "word &amp; " * 5000 + "</p><p>x</p>" * 3000
    got = M.main_text(page).split("\n")
    assert got[0] == " ".join(["word &"] * 5000) and len(got) == 3001


def test_smoothing_is_a_weighted_mean():
    got = M.smoothed(np.array([0.0, 0.0, 6.0, 0.0, 0.0]))
    assert got.argmax() == 2 and abs(got[1] - got[3]) < 1e-12 and abs(M.smoothed(np.ones(4)) - 1).max() < 1e-12


def test_frames(llm):
    df = llm.createDataFrame([(1, None, "x"), (1, "<p>a", "x"), (1, "<p>a", "x")], "page_id long, html string, text string")
    assert sorted(r.text for r in M.extract(df).collect()) == ["", "a", "a"]
    assert M.extract(df.limit(0)).count() == 0


def test_query_gives_the_articles(llm):
    from cloakwork.llm import queries

    path = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in llm.read.parquet(f"{path}/pages.parquet").collect()}
    got = queries.op6_html_main_text(llm, path).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.DOTALL)[1].replace("<br>", " ")
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text)
