"""Articles found through the host's template alone, and hostile pages in linear time."""

import random
import time

import pytest

from quarry.llm import html

SCHEMA = "page_id bigint, url string, html string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijkl", k=rng.randint(2, 9))) for _ in range(n))


def neutral(rng, host, i, extra=""):
    """A page of plain divs without telling names; the article's paragraphs vary in number."""
    title, paragraphs = words(rng, 6), [words(rng, rng.randint(20, 60)) for _ in range(rng.randint(1, 6))]
    menu = "".join(f"<div><a href='/{w}'>{w}</a></div>" for w in ("home", "news", "about us"))
    aside = f"<div class='c9'>{words(rng, 8)}</div>"
    body = f"<div class='x{i}'><h2>{title}</h2>" + "".join(f"<p>{p}</p>" for p in paragraphs) + extra + "</div>"
    page = f"<html><body class='p-{i}'><div>{menu}</div>{aside}{body}<div class='c7'>{host} {words(rng, 5)}</div></body></html>"
    return page, "\n".join([title, *paragraphs])


def texts(spark, rows, **options):
    found = html.extract(spark.createDataFrame(rows, SCHEMA), **options)
    return {r["page_id"]: r["text"] for r in found.collect()}


def test_neutral_pages_need_the_template(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(30):
        page, want[i] = neutral(rng, "h.example", i)
        rows.append((i, f"https://h.example/{i}", page))
    # A host of another make, a page that does not fit, an empty one, and exact copies.
    other = [(100 + i, f"https://o.example/{i}", f"<table><tr><td>{words(rng, 3)}<td><p>{words(rng, 50)}<p>last {i}</table>") for i in range(5)]
    odd = [(200, "https://h.example/odd", "<article>only <i>this</i></article><nav>not this</nav>"), (201, "https://h.example/e", None)]
    copies = [(300 + i, "https://h.example/copy", rows[3][2]) for i in range(4)]
    got = texts(spark, rows + other + odd + copies)
    assert {i: got[i] for i in want} == want
    assert all(got[100 + i].endswith(f"\nlast {i}") and len(got[100 + i].split("\n")) == 2 for i in range(5))
    assert got[200] == "only this" and got[201] == "" and all(got[300 + i] == want[3] for i in range(4))
    without = texts(spark, rows, min_pages=1000)
    assert all(without[i] != want[i] and want[i].split("\n")[0] in without[i] for i in want)


def test_constant_texts_in_the_article_go_and_telling_names_are_compared_whole(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for i in range(12):
        extra = "<p>Read our other pages too.</p><div class='related-work'>kept " + words(rng, 5) + "</div><div class='comments-on-law'>law</div>"
        page, text = neutral(rng, "h.example", i, extra + "<div class='comments'>a reader wrote</div>")
        rows.append((i, "https://h.example/", page))
        kept = extra.split("'related-work'>")[1].split("<")[0]
        want[i] = f"{text}\n{kept}\nlaw"
    got = texts(spark, rows)
    # "law" stands on every page in that place, so the template has it as well.
    assert got == {i: w.removesuffix("\nlaw") for i, w in want.items()}
    alone = html.main_text("<article><p>a</p><div class='related-work'>b</div><div class='comments-on-law'>c</div><div id='comments'>d</div></article>", frozenset(), frozenset())
    assert alone == "a\nb\nc"


def test_vectors_group_tokens_into_nested_classes():
    tokens = [(0, 0, 0, 1, 7, 500, 0), (1, 0, 0, 1, 7, 480, 0), (2, 0, 1, 1, 7, 20, 20), (3, 0, 1, 1, 7, 460, 460), (4, 0, 3, 1, 8, 100, 100)]
    found = html.deduce(tokens)
    assert found.classes == {7: [0, 1, 2, 3], 8: [4]} and found.content == [3] and found.constant == []


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 100_000 + "text" + "</div>" * 100_000,
        "<b>" * 100_000 + "<i>" * 100_000 + "text" + "</p></u></b>" * 100_000,
        "<p>text " + "<a '" * 100_000,
        "<p>text " + '<a x="' * 100_000,
        "<p>text " + "<a x='>" * 100_000,
        "<p>text " + "< <! <" * 100_000,
        "<p>text<!-- " + "<!-- " * 100_000,
        "<p>text " + "<script>" * 100_000,
        "<li>" * 100_000 + "text",
    ],
)
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    assert "text" in html.main_text(page, frozenset(), frozenset())
    assert time.process_time() - began < 8


def test_tags_are_told_from_text():
    page = "<p title='a > b' hidden>no</p><p>1 < 2 &lt; 3 <B>x</b><!-- <p>no</p> -->y<?x ?><p class=a>z<br/>w<textarea><p>no</textarea>"
    assert html.main_text(page, frozenset(), frozenset()) == "1 < 2 < 3 xy\nz w"
