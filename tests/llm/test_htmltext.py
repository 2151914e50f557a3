import pytest

from graphquarry.llm import htmltext as H

LONG = "It was the best of times and it was the worst of times, so we went to the sea with all of our friends. " * 3
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>var a="</p>";</script></head><body>
<div class="site-menu"><a href=/>Home</a></div><div>Short teaser</div><p>{LONG}<p>Tiny &amp; odd.</p><p>{LONG}</p>
<ul><li><a href=x>One link</a></li><li><a href=y>Another link here</a></li></ul><div id=comments><p>{LONG}</p></div>
<div>© 2020 Somebody</div></body>"""


def test_rules_without_an_article_element():
    one = " ".join(LONG.split())
    assert H.main_text(PAGE) == f"{one}\nTiny & odd.\n{one}"


def test_short_blocks_take_the_nearer_side_and_leaning_ones_the_content():
    assert H.second_pass(["content", "short", "short", "short", "boilerplate"]) == [
        "content", "content", "content", "boilerplate", "boilerplate"]
    assert H.second_pass(["boilerplate", "near", "content"]) == ["boilerplate", "content", "content"]
    assert H.second_pass(["short", "near"]) == ["content", "content"]
    assert H.second_pass(["boilerplate", "short"]) == ["boilerplate", "boilerplate"]
    assert H.second_pass([]) == []


def test_article_element_without_its_furniture():
    page = (
        "<body><p>outside</p><article><header>h</header><h1>Head\n line</h1><p>a&nbsp;&lt;b&gt;<br>c <i>d</i>e</p>"
        "<aside>x</aside><div class='x cookie-notice'>n</div><form><p>f</p></form><section class=comments><article><p>r"
        "</p></article></section><table><tr><td>1<td>2</table><p><a href=/>only a link</a></p>tail<footer>f</article>"
    )
    assert H.main_text(page) == "Head line\na <b> c de\n1\n2\ntail"


@pytest.mark.parametrize("html", [None, "", "   ", "<script>x", "<!-- a", "<nav>menu</nav>", "&nbsp;"])
def test_nothing_to_say(html):
    assert H.main_text(html) == ""


def test_unclosed_and_very_long():
    assert H.main_text("<p>" * 3000 + "the word and more of it") == "the word and more of it"
    assert H.main_text("<article>" + "<b>x " * 5000) == " ".join(["x"] * 5000)
    assert len(H.main_text("<article><p>" + "word " * 200_000)) == 999_999


def test_extract_replaces_text_and_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "<article>a</article>", "old"), (1, None, None)], "page_id long, html string, text string")
    rows = sorted((r["page_id"], r["text"]) for r in H.extract(pages).collect())
    assert rows == [(1, ""), (1, "a")]


def test_an_article_element_is_evidence_and_not_the_verdict():
    story = " ".join(LONG.split())
    teaser = "<article><p>Read this card</p></article>"
    assert H.main_text(f"<body><div><a href=/>Site</a></div><p>{LONG}</p><p>{LONG}</p><p><a href=/>All cards</a></p>{teaser}<p><a href=/>More</a></p></body>") == f"{story}\n{story}"
    notice = "Filed: Berlin, Gotham, Springfield; Ref. 2020/11/XX-42; Nr. 12345678; Lic. ABC; Vol. 7; Ed. 3" * 2
    page = f"<body><p>outside</p><article><p>{LONG}</p><p>{LONG}</p><p><a href=/>all tags</a></p><p>{notice}</p></article><p>{LONG}</p></body>"
    assert H.main_text(page) == f"{story}\n{story}\n{story}"


@pytest.mark.parametrize("wrapper", ["no-sidebar", "content-with-sidebar", "legal-analysis", "ad-free", "post comments-open", "widget"])
def test_a_name_on_a_wrapper_does_not_drop_the_story(wrapper):
    story = " ".join(LONG.split())
    inner = f"<h1>Head</h1><p>{LONG}</p><p>Short one.</p><p>{LONG}</p>"
    for tag in ("div", "section", "article"):
        page = f"<body><{tag} class='{wrapper}'>{inner}</{tag}><div class=comments><article><p>{LONG * 9}</p></article></div></body>"
        if wrapper != "widget" or tag == "article":
            assert H.main_text(page) == f"Head\n{story}\nShort one.\n{story}"
    assert H.main_text(f"<body><div class='{wrapper}'>{inner}</div></body>") == f"Head\n{story}\nShort one.\n{story}"


def test_half_linked_text_stays_in_an_article():
    half = "It is in the book of " + "<a href=/>the names that are known to all</a>" + " and."
    story = " ".join(LONG.split())
    assert H.main_text(f"<article><p>{LONG}</p><p>{half}</p><p>{LONG}</p></article>").split("\n")[0] == story
    assert "names that are known" in H.main_text(f"<article><p>{LONG}</p><p>{half}</p><p>{LONG}</p></article>")
