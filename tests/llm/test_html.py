import re
import time

from broadsheet.llm import html_text
from hypothesis import given, settings
from hypothesis import strategies as st

LONG = "This is the first paragraph of the article and it has quite a few of the words that are in the list, so that it is good. "
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p {{ x: "</p>" }}</style><script>var a = "<p>no</p>";</script></head><body>
<header><a href=/>Home</a> The site of the day</header><nav><ul><li><a href=/a>One</a></li></ul></nav><!-- <p>{LONG}</p> -->
<div class="cookie-notice">{LONG}</div><article><h1>Head &amp; line</h1><p>{LONG}<b>Bold</b>
  and &lt;more&gt;<br>of&nbsp;it</p><div class='ad'>{LONG}</div><p>Short.</p><form><p>{LONG}</p></form></article>
<aside>{LONG}</aside><section id="comments"><p>{LONG}</p></section><footer>{LONG}</footer></body></html>"""


def test_article():
    assert html_text.main_text(PAGE).split("\n") == ["Head & line", LONG + "Bold and <more> of it", "Short."]


def test_without_article():
    page = f"<body><div id=menu><a href=x>{LONG}</a></div><div><h2>A title</h2><p>{LONG * 2}</p><p>Short one.</p><p>{LONG * 2}</p></div><div><a href=x>Links</a> <a href=y>{LONG}</a></div>"
    assert html_text.main_text(page).split("\n") == ["A title", (LONG * 2).strip(), "Short one.", (LONG * 2).strip()]


def test_void_and_self_closed_elements_swallow_nothing():
    for odd in ("<embed src=a.swf>", '<svg class="x" viewBox="0 > 1" />', "<math/>", "<svg><path/></svg>"):
        assert html_text.main_text(f"<article><p>{LONG}</p>{odd}<p>Then {LONG}</p></article>").split("\n") == [LONG.strip(), f"Then {LONG}".strip()]


def test_head_without_end_tag():
    page = f"<html><head><title>T</title><meta charset=utf-8><script>var a = '<p>no</p>';</script><body><article><p>{LONG}</p></article>"
    assert html_text.main_text(page) == LONG.strip() == html_text.main_text(page.replace("<body>", ""))


def test_class_names_of_articles_and_wrappers():
    for wrapper in ("<article class='post has-sidebar comments-open'>", "<article class='sidebar'>", "<div class='content-sidebar-wrap'><article>", "<div class=sidebar><main>"):
        page = f"{wrapper}<div class='entry-header'><h1>The title</h1></div><p>{LONG}</p><div class='post-comments'><p>No, {LONG}</p></div>"
        assert html_text.main_text(page).split("\n") == ["The title", LONG.strip()], wrapper
    page = f"<div class='no-sidebar'><article><p>{LONG}</p></article></div><div id='comments'><article><p>No, {LONG}</p></article></div>"
    assert html_text.main_text(page) == LONG.strip()


def test_names_and_marks_are_hints():
    """A name never empties a page; a comment's article isn't the page's; stop words decide where nothing is marked."""
    for name in ("layout with-sidebar", "search", "header", "related", "form", "alert"):
        assert html_text.main_text(f"<body><div class='{name}'><h1>T</h1><p>{LONG * 2}</p></div></body>").split("\n") == ["T", (LONG * 2).strip()], name
    page = f"<article><p>{LONG}</p></article><article class='comment'><p>No, {LONG}</p></article>"
    assert html_text.main_text(page) == LONG.strip()
    bare = f"<body><p>{LONG * 2}</p><p>{'keyword lists ' * 30}</p><p>Short.</p></body>"
    assert html_text.main_text(bare).split("\n") == [(LONG * 2).strip()]
    assert html_text.main_text(bare, frozenset({"keyword"})).split("\n") == [("keyword lists " * 30).strip()]
    assert html_text.main_text(f"<article><p>{LONG}</p><p>{'keyword lists ' * 30}</p><p>Short.</p></article>").count("\n") == 2
    assert html_text.main_text("<article><p>Tre.</p></article>") == "Tre."
    assert html_text.main_text(f"<p>one <span hidden>two <span>three</span></span> {LONG}</p>").startswith("one This is")


def test_reading_is_linear():
    """Adversarial pages of a megabyte: no tag is read twice in search of its end."""
    odd = ("<script x ", "<a ", "<p>x", "<a href='", '<p title="a', "<svg>", "<span hidden>", "<!--", "<h2>x</h2>", "</", "< ", "<div class='x y'>", "&", "<object>")
    for piece in odd:
        took = []
        for size in (1 << 15, 1 << 17):
            began = time.process_time()
            html_text.main_text(piece * (size // len(piece)))
            took.append(time.process_time() - began)
        assert took[1] < 1 + 12 * took[0], (piece, took)


def plainly(found, stop_words):
    """Both passes as the rules say them, block by block and without regard to time; for pages with no names or headings."""
    marked = any(b.region and not b.outside for b in found)
    first = []
    for b in found:
        words = re.findall(r"[^\W\d_]+", b.text.lower())
        share = sum(w in stop_words for w in words) / max(1, len(words))
        links = b.linked / len(b.text)
        if b.outside or (links > 0.33 and (not b.region or links >= 0.9 or len(b.text) <= 70)):
            first.append("bad")
        elif len(b.text) < 70:
            first.append("bad" if marked and not b.region else "short")
        else:
            step = ["bad", "near", "good"].index("bad" if share < 0.08 else "good" if share >= 0.16 and len(b.text) >= 200 else "near")
            first.append(["bad", "bad", "near", "good", "good"][step + 1 + (1 if b.region else -1 if marked else 0)])
    assert "good" in first
    out = []
    for i, b in enumerate(found):
        if first[i] in ("good", "bad"):
            out.append(first[i])
            continue
        sides = []
        for side in (range(i - 1, -1, -1), range(i + 1, len(found))):
            seen = [first[k] for k in side if first[k] in ("good", "bad") and (not b.region or (found[k].region == b.region and not found[k].outside))]
            sides.append(seen[0] if seen else None)
        if first[i] == "short" and not b.region:
            out.append("good" if sides == ["good", "good"] else "bad")
        else:
            out.append("good" if "good" in sides else "bad")
    return out


STOPS = frozenset({"the", "of"})
TEXT = st.tuples(st.integers(1, 60), st.integers(0, 8)).map(lambda x: " ".join("the" if x[1] and i % x[1] == 0 else "word" for i in range(x[0])))
BLOCK = st.builds(lambda text, part, outside, region: html_text.Block(text, round(part * len(text)), outside, False, False, region, False), TEXT, st.sampled_from([0, 0, 0.2, 0.5, 1]), st.sampled_from([False] * 4 + [True]), st.sampled_from([0, 1, 1, 2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(BLOCK, max_size=12))
def test_rules_against_brute_force(found):
    found.append(html_text.Block("the word of " * 30, 0, False, False, False, found[-1].region if found else 0, False))
    want = plainly(found, STOPS) if html_text.first_label(found[-1], STOPS, any(b.region and not b.outside for b in found)) == "good" else None
    if want is not None:
        assert [b.label for b in html_text.classify(found, STOPS)] == want


def test_odd_pages(spark):
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<html><nav>x</nav>") == ""
    assert html_text.main_text("plain &amp; bare") == "plain & bare"
    assert html_text.main_text("<article><p>open <b>tag <p>next & last") == "open tag\nnext & last"
    assert "x" not in html_text.main_text("<article><p>kept words</p><script>x")
    rows = [(1, "u", PAGE, "mine", 1), (2, None, None, None, 2), (3, "u", "<p>" + LONG * 2000, "mine", 3), (1, "u", PAGE, "mine", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, `a.b` int")
    got = html_text.extract(df).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(df.limit(0)).count() == 0
