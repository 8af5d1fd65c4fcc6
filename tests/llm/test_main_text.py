import random
import time

import pytest

from quire.llm.main_text import extract, main_text, op7, parse

LONG = "This is a long sentence of the story, with commas, and more words to make it count. " * 3
SHORT = LONG[:90]


def heads(page):
    return [b.split()[0] for b in extract(page).split("\n\n")] if extract(page) else []


def para(name, text=LONG):
    return f"<p>{name} {text}</p>"


@pytest.mark.parametrize(
    "page, blocks",
    [
        # Titles and leads beside the container of the text belong to it.
        (f'<div class="wrap"><h1>T</h1><p class="lead">L</p><div class="content">{para("A")}{para("B")}</div></div><footer>f</footer>', "TLAB"),
        (f'<body><section>{para("A")}{para("B")}</section><section>{para("C", SHORT)}</section></body>', "ABC"),
        (f'<main><article>{para("A", SHORT)}</article><article>{para("B")}{para("C")}</article></main>', "ABC"),
        # Names set aside what is outside the article only.
        (f'<article><div class="content header-text">{para("A")}</div>{para("B")}<p class="legal">C</p></article>', "ABC"),
        (f'<div class="page">{para("A")}{para("B")}</div><div class="legal">{para("X")}</div>', "AB"),
        (f'<div class="header-text">{para("A")}</div>', "A"),
        (f'<article>{para("A")}<div class="share">{para("X")}</div><div id="comments">{para("Y")}</div><aside>Z</aside></article>', "A"),
        # A form around the page is none of its parts; one in the page is.
        (f'<body><form action="x"><h1>T</h1>{para("A")}{para("B")}<input value="3"></form></body>', "TAB"),
        (f'<body><form><p>Search here</p><input></form><div>{para("A")}</div></body>', "A"),
        # Scores decide, not tags: an article of links beside a long text.
        (f'<article><a href="/">{SHORT}</a></article><div>{para("A")}{para("B")}</div>', "AB"),
        (f'<nav><ul><li><a href="/">X</a></li></ul></nav><div class="ad">{para("X")}</div><article><h1>T</h1>{para("A")}<p>B so.</p></article><footer>X</footer>', "TAB"),
        ("", ""),
        ("<nav>menu</nav>", ""),
        ("<script>var a = '<p>no</p>';</script><style>p{}</style>", ""),
        ("plain words", ["plain"]),
    ],
)
def test_pages(page, blocks):
    assert heads(page) == list(blocks)


def test_text_is_decoded_and_white_space_is_one_space():
    page = "<p>A &amp;  b&nbsp;c\n\t&#100;<br>e <b>f</b>g</p><!-- no --><p>H</p>"
    assert extract(f"<article>{page}</article>") == "A & b c d e fg\n\nH"


def plain_parse(tokens):
    """Nested lists of well-formed tokens, by recursion."""
    out = []
    while tokens:
        token = tokens.pop(0)
        if token.startswith("</"):
            return out
        if token.startswith("<"):
            out.append((token[1:-1], plain_parse(tokens)))
        else:
            out.append(token)
    return out


def tree(node):
    return [c.text if not c.tag else (c.tag, tree(c)) for c in node.children]


def test_parser_on_random_well_formed_trees():
    rng = random.Random(5)

    def make(depth):
        parts = []
        for _ in range(rng.randint(1, 3)):
            if depth and rng.random() < 0.7:
                tag = rng.choice(["div", "section", "span", "b", "blockquote"])
                # Blocks stand in blocks only, as an inline end tag closes no block.
                parts += [f"<{tag}>", *(make(depth - 1) if tag not in ("span", "b") else ["t"]), f"</{tag}>"]
            elif not parts or parts[-1].startswith("<"):
                parts.append("x")
        return parts

    for _ in range(200):
        tokens = make(5)
        assert tree(parse("".join(tokens))) == plain_parse(list(tokens))


def test_faulty_markup_is_repaired():
    assert tree(parse("<p>a<p>b</p></p>c")) == [("p", ["a"]), ("p", ["b"]), ("br", []), "c"]
    assert tree(parse("<ul><li>a<li>b<ul><li>c</ul></ul>")) == [("ul", [("li", ["a"]), ("li", ["b", ("ul", [("li", ["c"])])])])]
    assert tree(parse("<table><tr><td>a<td>b<tr><td>c</table>")) == [("table", [("tr", [("td", ["a"]), ("td", ["b"])]), ("tr", [("td", ["c"])])])]
    assert tree(parse("<div><b>a<div>b</b>c</div></div>d")) == [("div", [("b", ["a", ("div", ["b", "c"])])]), "d"]
    assert tree(parse("<a>x<a>y</a></i>z<p")) == [("a", ["x"]), ("a", ["y"]), "z"]
    assert tree(parse("<p>a<table><tr><td><p>b</table>c")) == [("p", ["a"]), ("table", [("tr", [("td", [("p", ["b"])])])]), "c"]


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<ul><li>" * 50_000 + "x", "<p><span>" * 50_000 + "x", "<p><table><tr><td>" + "<div>" * 50_000 + "x"])
def test_deep_pages_take_linear_time(page):
    start = time.process_time()
    assert extract(page) == "x"
    assert time.process_time() - start < 12


def test_very_long_page_is_whole():
    page = "<article>" + "".join(para(f"n{k}") for k in range(5_000)) + "</article>"
    assert len(page) > 1 << 20 and heads(page) == [f"n{k}" for k in range(5_000)]


def test_rows(spark):
    rows = [(1, "u", f"<article>{para('A')}</article>"), (1, "u", None), (None, None, ""), (2, "v", "<p>b</p>")] * 2
    frame = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    found = sorted(tuple(r) for r in main_text(frame).collect() if r["page_id"] is not None)
    long = f"A {LONG.strip()}"
    assert found == sorted([(1, "u", long, len(long)), (1, "u", "", 0), (2, "v", "b", 1)] * 2)
    assert main_text(frame.limit(0)).collect() == []


def test_given_pages_lose_nothing_and_add_nothing(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = op7(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    for row in rows:
        inside = extract(pages[row["page_id"]].partition("<article>")[2].partition("</article>")[0].join(["<article>", "</article>"]))
        assert row["text"] == inside and row["n_chars"] == len(row["text"]) > 0
