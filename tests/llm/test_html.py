import html as H
import random

from graphloom.llm.html_extract import extract, extract_pages, smoothed

PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad --><div class="ad">Buy this.</div>{}<footer>&copy; x</footer></body></html>'


def page(blocks):
    return PAGE.replace("{}", "<article><h1>" + H.escape(blocks[0]) + "</h1>" + "".join(f"<p>{H.escape(b)}</p>" for b in blocks[1:]) + "</article>")


def test_articles_come_whole():
    rng = random.Random(2)
    for _ in range(50):
        blocks = [" ".join(rng.choice(["a", "b & c", "<d>", "é", "longer words"]) for _ in range(rng.choice([1, 2, 30, 200]))) for _ in range(rng.randint(1, 12))]
        assert extract(page(blocks)) == "\n\n".join(" ".join(b.split()) for b in blocks)


def test_white_space_references_and_open_tags():
    assert extract("<article><p>a&nbsp;&amp;\n\t b<br>c<p>d <b>e</b>f<ul><li>g<li>h</ul>") == "a & b c\n\nd ef\n\ng\n\nh"
    assert extract("<body><article><p>one<p>two</article><footer>x") == "one\n\ntwo"
    assert extract("<nav>menu<article><p>Text of the page.</article>") == "Text of the page."


def test_parts_that_are_no_content():
    inside = '<article><p>Real text stays here.</p><aside>side</aside><form>f <input></form><div class="cookie-notice">n</div><div id="comments"><article class="comment"><p>first!</p></article></div><script>x</script><div hidden>h</div><div style="display:none">s</div><p>And here.</p></article>'
    assert extract(PAGE.replace("{}", inside)) == "Real text stays here.\n\nAnd here."


def test_marks_that_speak_of_the_page():
    assert extract('<body><div class="content no-sidebar"><p>Body text of this page.</p></div><div class="left-sidebar">x</div>') == "Body text of this page."


def test_pages_without_article_use_the_ratio():
    menu = "<div>" + "".join(f'<div><a href="/{i}">Link {i}</a></div>' for i in range(12)) + "</div>"
    body = "<div><div>" + "".join(f"<p>{'Many words of running text stand in this block. ' * 4}</p>" for _ in range(4)) + "<p>Short.</p>" + f"<p>{'More running text closes the page as it should. ' * 3}</p></div></div>"
    got = extract(f"<html><body>{menu}{body}{menu}</body></html>")
    assert "Link" not in got and "Short." in got and got.count("\n\n") == 5


def test_odd_pages(spark):
    assert [extract(x) for x in (None, "", "<", "<p", "plain &amp; text", "</p></div>")][0:2] == ["", ""]
    assert extract("plain &amp; text") == "plain & text"
    big = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    assert len(extract(big)) == 20_000 * 6 - 2
    assert extract("<div>" * 3000 + "deep") == "deep"
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>é&#x1F389;</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((tuple(r) for r in extract_pages(df.select("page_id", "url", "html"), ["page_id", "url"]).collect()), key=str) == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "é🎉", 2)], key=str)


def test_smoothing_keeps_a_level():
    import numpy as np

    assert np.allclose(smoothed(np.full(7, 3.0), 2), 3.0)


def test_names_that_only_hint_at_a_part():
    inside = "<article><p>First words of it.</p>{}<p>Last words of it.</p></article>"
    for name in ("social-history", "related-work", "notice-period", "banner-of-war"):
        for tag in ("div", "section"):
            assert "The history told." in extract(inside.format(f'<{tag} class="{name}"><p>The history told.</p></{tag}>'))
    for name in ("related", "share-buttons", "cookie-notice", "ad slot", "newsletter-signup box"):
        assert extract(inside.format(f'<div class="{name}"><p>Gone.</p></div>')) == "First words of it.\n\nLast words of it."
    links = '<div class="related-work">' + '<div><a href="/">One link</a></div>' * 9 + "</div>"
    assert "link" not in extract("<article>" + "<p>Many words of running text stand in this block.</p>" * 9 + links + "</article>")


def test_an_element_closes_over_any_number_of_open_ones():
    for n in (3, 70, 5000):
        assert extract("<article><ul><li class='ad'>" + "<b>" * n + "gone<li>keep this</ul></article>") == "keep this"


def test_malformed_markup_is_no_error():
    got = {h: extract(h) for h in ("<p>a<![foo[ x ]]>b", "<p>a<![ x", "<p>a<!-- b > c", "<p>a<!-->b", "<p>a<![CDATA[ x ]]>b", "a&#" + "9" * 5000 + ";b", "<p>a</", "<p>a < b", '<p>a<i b="x>y')}
    assert list(got.values()) == ["ab", "a<![ x", "a c", "ab", "ab", "a�b", "a</", "a < b", "ay"]


def test_mutated_pages_raise_nothing():
    rng = random.Random(1)
    parts = ["<!", "<![", "<!--", "-->", "<?", "</", "<a ", '"', "'", "=", ">", "<", "&#", "&", "\0", "<script>", "</script>", "<p>", "<table><td>", "]]>", "&#x110000;", "&#xD800;", "<![CDATA[", "<li class=ad>", "<svg>", '<div id="promo-x">', "<article>"]
    whole = page(["Title", "Some words.", "More words & signs."]) * 2
    for _ in range(10_000):
        h = whole[: rng.randint(0, len(whole))]
        for _ in range(rng.randint(1, 10)):
            i = rng.randint(0, len(h))
            h = h[:i] + "".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) + h[i + rng.randint(0, 5) :]
        extract(h).encode()


def test_time_is_linear():
    import time

    for part in ("<!--", "<", "<a ", "<div>", "</x>", "<![", "<?", '<a x="', "<div class=ad><article>", "<!-- >", "&#", '<b><div class="ad"></b>', "<p>x", "</"):
        began = time.perf_counter()
        extract(part * 60_000)
        assert time.perf_counter() - began < 15, part


def test_clusters_equal_a_plain_reckoning():
    import math

    rng = random.Random(5)
    for _ in range(200):
        lines = [(rng.choice(["word", "a few words here", "x" * rng.randint(1, 300)]), rng.randint(0, 3), rng.choice(["", "linked text"])) for _ in range(rng.randint(1, 25))]
        html = "<html><body><div>" + "".join(f"<p>{t}{'<i></i>' * k}" + (f"<a href='/'>{a}</a>" if a else "") + "</p>" for t, k, a in lines) + "</div></body></html>"
        # Tags of a line: those within it and the one that closes it.
        ratio = [len(t) / max(1, 2 * k + 2 * bool(a) + 1) for t, k, a in lines]
        smooth = []
        for i in range(len(ratio)):
            near = [(math.exp(-(d * d) / 8), ratio[i + d]) for d in range(-2, 3) if 0 <= i + d < len(ratio)]
            smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
        mean = sum(ratio) / len(ratio)
        spread = math.sqrt(sum((r - mean) ** 2 for r in ratio) / len(ratio))
        least = min(spread, sum(smooth) / len(smooth))
        at = [i for i, s in enumerate(smooth) if s >= least - 1e-9]
        if any(abs(s - least) < 1e-6 for s in smooth):
            continue
        assert extract(html) == "\n\n".join(t + a for t, _, a in lines[at[0] : at[-1] + 1])
