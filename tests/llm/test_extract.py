from __future__ import annotations

import random
from functools import cache

import pytest

from trialmart.llm import extract, queries
from trialmart.llm.markup import page_lines


def texts(html):
    return [line.text for line in page_lines(html)]


@pytest.mark.parametrize(
    ("html", "lines"),
    [
        (None, []),
        ("", []),
        ("plain text", ["plain text"]),
        ("<p>a  <b>b</b>\n c<p>d", ["a b c", "d"]),
        ("<p>one<br>two</p>", ["one two"]),
        ("<p>AT&amp;T &lt;x&gt; &eacute &#8211; &copy2</p>", ["AT&T <x> é – ©2"]),
        ("<p>&nbsp;</p><p>a&nbsp;b</p>", ["a b"]),
        ("<p>1 < 2 and 3 > 2</p>", ["1 < 2 and 3 > 2"]),
        ("<script>var t='<p>no</p>';</script><p>yes", ["yes"]),
        ("<SCRIPT>x</scripty></SCRIPT >yes", ["yes"]),
        ("<p>a</p><script>never ends <p>b</p>", ["a"]),
        ("a<!-- b --> c<!-- never ends <p>d", ["a c"]),
        ("<p>a</p><div class='x", ["a"]),
        ('<p title="a > b">c</p>', ["c"]),
        ("<p title=it's>c</p><p>d</p>", ["c", "d"]),
        ("<nav><ul><li>a<li>b</ul></nav><p>c</p><footer><p>d</footer>e", ["c", "e"]),
        ("<nav><li>menu<article><h1>t</h1><p>a</article>", ["t", "a"]),
        ("<article><header><h1>t</h1></header><p>a<article>comment</article></article>", ["t", "a"]),
        ("<main><article><p>a</article></main>", ["a"]),
        ("<div class='ad box'><div>x</div>y</div><p>z", ["z"]),
        ("<div class='has-sidebar'><p>z</div>", ["z"]),
        ("<p class='notice'>x<p>y", ["y"]),
        ("<p>a <span class='share'>x <span>y</span></span> b</p>", ["a b"]),
        ("<div role='navigation'>x</div><div hidden>y</div><div style='display: none'>z</div>a", ["a"]),
        ("<form>Name <input> <button>Go</button></form><p>longer text", ["longer text"]),
        ("<form><div><p>the whole page is in a form</p></div></form>", ["the whole page is in a form"]),
        ("<form><article><p>a</p></article></form>", ["a"]),
        ("<table><tr><td>a<td>b</table>", ["a", "b"]),
        ("</div></p>a</b>", ["a"]),
    ],
)
def test_lines(html, lines):
    assert texts(html) == lines


def test_hostile_markup_is_linear():
    for html in ("<" * 300_000, "<p " * 100_000, "=\"" * 200_000, "<a b='" * 60_000, "<!--" * 90_000,
                 "<div>" * 50_000 + "x", "&" * 200_000):
        page_lines(html)


def lcs(a, b):
    @cache
    def length(i, j):
        if i == len(a) or j == len(b):
            return 0
        if a[i] == b[j]:
            return 1 + length(i + 1, j + 1)
        return max(length(i + 1, j), length(i, j + 1))

    return length(0, 0)


@pytest.mark.parametrize("table_bits", [extract._TABLE_BITS, 20])
def test_alignment_is_a_longest_common_subsequence(monkeypatch, table_bits):
    monkeypatch.setattr(extract, "_TABLE_BITS", table_bits)
    chance = random.Random(2)
    for _ in range(300):
        a, b = ([chance.randrange(chance.choice([2, 5, 30])) for _ in range(chance.randint(0, 30))]
                for _ in range(2))
        found = extract.aligned(a, b)
        assert found == sorted(set(found)) and len(found) == lcs(tuple(a), tuple(b))
        taken, rest = [a[i] for i in found], iter(b)
        assert all(value in rest for value in taken)


def page(n, body, *, menu=("Home", "News", "About us", "Contact"), varying=True):
    entries = [*menu, f"Topic of {n}"] if varying else menu
    items = "".join(f"<li>{entry}</li>" for entry in entries)
    return (
        f"<html><body><div class=top><ul>{items}</ul></div><div class=b><p>We keep crumbs.</p>"
        f"</div><div class=c>{body}</div><div>All rights are ours, {n % 2}</div></body></html>"
    )


def body(n):
    return f"<h1>Title {n}</h1><p>Body text {n} goes on for a while.</p><p>More of {n}.</p>"


def content(n):
    return f"Title {n}\nBody text {n} goes on for a while.\nMore of {n}."


def extracted(llm, rows, **options):
    df = llm.createDataFrame(rows, "page_id long, url string, html string, text int, k1 string")
    found = extract.main_texts(df, **options).collect()
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("options", [{}, {"max_broadcast_bytes": -1}, {"block_pages": 3}])
def test_differencing_finds_what_markup_does_not_say(llm, options):
    rows = [(n, f"https://a.example/x/{n}", page(n, body(n)), 1, "x") for n in range(20)]
    # The hash of the address decides on no one: other sites in between do not matter.
    rows += [(100 + n, f"http://b{n}.example/x/3", f"<p>Only {n}</p><p>Same</p>", 1, "x")
             for n in range(5)]
    found = {row.page_id: row.text for row in extracted(llm, rows, **options)}
    assert all(found[n] == content(n) for n in range(20))
    assert all(found[100 + n] == f"Only {n}\nSame" for n in range(5))


def test_copies_are_not_held_against_each_other(llm):
    text = "".join(f"<p>A paragraph of some length, number {i}.</p>" for i in range(30))
    rows = [(n, f"https://a.example/x/{n}", page(n, text, varying=False), 1, "x") for n in range(4)]
    rows += [(n, f"https://a.example/x/{n}", page(n, body(n)), 1, "x") for n in range(4, 9)]
    found = {row.page_id: row.text for row in extracted(llm, rows)}
    assert all(found[n].count("A paragraph") == 30 for n in range(4))
    # Page 3 has page 4 beside it, which is no copy.
    assert "crumbs" not in found[3] and found[6] == content(6)


def test_a_passage_shared_by_articles_stays(llm):
    quote = "<p>Nobody expects the same quotation.</p>"
    share = "<div class=s><span>Mail</span><p>Print</p><p>Send</p></div>"
    rows = [(n, f"https://a.example/{n}",
             f"<article><h1>T{n}</h1><p>Body {n} of it, long enough.</p>{quote}{share}</article>",
             1, "x") for n in range(6)]
    found = {row.page_id: row.text for row in extracted(llm, rows)}
    for n in range(6):
        assert found[n] == f"T{n}\nBody {n} of it, long enough.\nNobody expects the same quotation."


def test_awkward_rows(llm):
    rows = [
        (1, None, "<p>a", 1, "x"), (2, "https://h.example/1", None, 1, "x"), (None, None, None, 1, "x"),
        (3, "no scheme", "<p>b</p><p>c</p>", 1, "x"), (4, "https://h.example/2", "", 1, "x"),
        (5, "https://h.example/3", "<p>only markup</p>", None, None),
        (5, "https://h.example/3", "<p>only markup</p>", None, None),
        (6, "https://h.example/4", "<p>w</p>" * 20_000 + "<p>end", 1, "x"),
    ]
    found = extracted(llm, rows)
    assert [row.text for row in found if row.page_id == 5] == ["only markup"] * 2
    assert {row.page_id: row.text for row in found if row.page_id not in (5, 6)} == {
        1: "a", 2: "", None: "", 3: "b\nc", 4: "",
    }
    assert next(row.text for row in found if row.page_id == 6).endswith("\nend")
    assert extracted(llm, []) == []


def test_query_keeps_the_articles(llm, small):
    """The articles of the given pages, read off by their tags alone."""
    import html as references
    import re

    rows = queries.op13_html(llm, small).collect()
    pages = {r.page_id: r.html for r in llm.read.parquet(f"{small}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for row in rows:
        article = re.search(r"<article>(.*?)</article>", pages[row.page_id], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)[^>]*>", article)
        plain = (references.unescape(re.sub(r"<[^>]*>", " ", block)) for block in blocks)
        wanted = "\n".join(text for text in (" ".join(x.split()) for x in plain) if text)
        assert row.text == wanted and row.n_chars == len(wanted)
