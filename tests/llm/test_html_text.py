import random

import time

import pytest

from cardwright.llm.html_text import WRAP, extract_text, html_to_text


def test_implied_tags_and_blocks():
    assert html_to_text("<p>one<p>two<br>three<div>four</div>five") == "one\n\ntwo\nthree\n\nfour\nfive"
    assert html_to_text("<h1>A &amp; B</h1>x <b>y</b>z<!-- c -->&lt;") == "A & B\n\nx yz<"
    assert html_to_text("<pre>\n a  b\n  c</pre>") == " a  b\n  c"


def test_lists():
    assert html_to_text("<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>") == "- a\n- b\n  3. c\n  4. d\n- e"
    assert html_to_text("<dl><dt>T<dd>def</dl>") == "T\n  def"


def test_tables_line_up():
    got = html_to_text("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td colspan=2>x</table>")
    assert got == "Name      | N\nlong name | 1\nx"
    wide = " ".join(["word"] * 20)
    first, second = "word " * 11 + "word", "word " * 7 + "word"
    assert len(first) <= WRAP
    assert html_to_text(f"<table><tr><td>{wide}<td>a<tr><td>b<td>c</table>") == f"{first} | a\n{second}\n{'b'.ljust(len(first))} | c"
    assert html_to_text(f"<table><tr><td>a<td>{wide}<tr><td>b<td>c</table>") == f"a | {wide}\nb | c"


def test_cells_across_rows_and_columns():
    assert html_to_text("<table><tr><td rowspan=2>A<td>b<tr><td>c<tr><td>d<td>e</table>") == "A | b\n  | c\nd | e"
    assert html_to_text("<table><tr><td>a<td>b<td>c<tr><td colspan=2>wide one<td>d</table>") == "a | b | c\nwide one | d"
    assert html_to_text("<table><tr><td rowspan=0>A<td>b<tr><td colspan=999>c<tr><td>d<td>e</table>") == "A | b\n  | c\n  | d | e"


def test_cells_keep_their_blocks():
    got = html_to_text("<table><tr><td><p>one<p>two<ul><li>a<li>b</ul><td>right<tr><td>x<td>y</table>")
    assert got == "one | right\n\ntwo\n\n- a\n- b\nx   | y"
    assert html_to_text("<table><tr><td>o<td><table><tr><td>1<td>22<tr><td>333<td>4</table><td>p</table>") == "o | 1   | 22 | p\n  | 333 | 4"


def test_formulas_pictures_and_chosen_options():
    assert html_to_text("<p>E = <math><mi>m</mi><mi>c</mi><annotation>tex</annotation></math>!") == "E = mc!"
    assert html_to_text("<svg><title>t</title><defs><text>no</text></defs><text>one</text><text>two</text></svg>after") == "one\ntwo\nafter"
    assert html_to_text("Size: <select><option>S<option selected>M<option>L</select>.") == "Size: M ."
    assert html_to_text("<select><optgroup><option disabled>-<option>A</select>") == "A"
    assert html_to_text("<select multiple><option>S<option>M</select>") == "S\nM"
    assert html_to_text("<div style='visibility:hidden'>no<i style='visibility: visible'>yes<b hidden>no</b></i>no</div>") == "yes"


@pytest.mark.parametrize("page", [
    "<div>" * 200_000 + "x", '<a href="' * 100_000, '<a href="x>' * 90_000, '<a x=">" ' * 100_000, "<span>" * 80_000 + "</b>" * 80_000,
    "<table><tr><td>" + "<span>" * 80_000 + "</b>" * 80_000, "<p><b>" * 150_000, "<" * 1_000_000, "<ul><li>x" * 100_000,
    "<script>" + "</script " * 100_000, "<table><tr><td>x" * 50_000, "<table><tr><td>a<td>" * 40_000, "<!-" * 300_000, "<blockquote>x" * 70_000,
    "<table><tr>" + "<td rowspan=9999>x" * 20_000 + "<tr><td>y" * 60_000,
], ids=lambda p: p[:24])
def test_a_hostile_megabyte_takes_time_and_room_in_proportion(page):
    plain = "<p>word <b>bold</b></p>" * (1_000_000 // 23)
    start = time.process_time()
    html_to_text(plain)
    usual = time.process_time() - start
    start = time.process_time()
    out = html_to_text(page)
    assert time.process_time() - start < 5 * usual + 1 and len(out) < 40 * len(page) + 1000


def rendered(rows):
    """Independent layout of a table of (text, colspan, rowspan): a grid is filled cell by cell, then printed."""
    grid, begins = {}, {}
    for r, row in enumerate(rows):
        c = 0
        for text, across, down in row:
            while (r, c) in grid:
                c += 1
            for i in range(down):
                for j in range(across):
                    grid[r + i, c + j] = (r, c)
            begins[r, c] = (text, across)
            c += across
    columns = sorted({c for _, c in begins})
    end = lambda c, across: next((x for x in columns if x >= c + across), None)
    wide = dict.fromkeys(columns, 0)
    for (r, c), (text, across) in begins.items():
        following = next((x for x in columns if x > c), None)
        if end(c, across) == following:
            wide[c] = max(wide[c], len(text))
    lines = []
    for r in range(len(rows)):
        own = sorted(c for q, c in begins if q == r)
        line, c = [], 0
        for at in own:
            line += ["".ljust(wide[x]) for x in columns if c <= x < at]
            text, across = begins[r, at]
            over = [x for x in columns if at <= x and (end(at, across) is None or x < end(at, across))]
            line.append(text.ljust(sum(wide[x] for x in over) + 3 * (len(over) - 1)))
            c = at + across
        lines.append(" | ".join(line).rstrip())
    return "\n".join(lines)


def test_generated_tables_against_a_grid():
    rng = random.Random(8)
    for _ in range(300):
        rows = [
            [("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))), rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2])) for _ in range(rng.randint(1, 4))]
            for _ in range(rng.randint(1, 5))
        ]
        shown = [rng.choice(["", "<i hidden>no</i>", "<b style='display:none'>no</b>", "<s style='visibility:hidden'>no</s>"]) for _ in range(20)]
        page = "<table>" + "".join(
            "<tr>" + "".join(f"<td colspan={a} rowspan={d}>{rng.choice(shown)}{t}" for t, a, d in row) for row in rows
        ) + "</table>"
        assert html_to_text(page) == rendered(rows).strip("\n")


def test_visibility():
    hidden = ("<script>if(a<b){}</script><style>p{}</style><template>t</template><span style='display: none'>n</span><div hidden>h</div>"
              "<p style=\"VISIBILITY:hidden\">v</p><input value=i><title>t</title><noscript>n</noscript>")
    assert html_to_text(f"<html><head><title>x</title></head><body>{hidden}seen") == "seen"


def test_unclosed_and_hostile_markup():
    assert html_to_text("3 < 4 and <b>bold") == "3 < 4 and bold"
    assert html_to_text("<div>" * 20_000 + "deep") == "deep"
    assert html_to_text("</p>x</div></li>") == "x"
    for page in ("<" * 5000, '<a href="' * 2000, "&#x110000;&bogus;", "<script>never closed", "<li>x</ul><td>y"):
        html_to_text(page)


def test_round_trip_of_generated_pages():
    rng = random.Random(4)
    words = lambda: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 8)))
    for _ in range(200):
        page, want = [], []
        for _ in range(rng.randint(1, 6)):
            kind = rng.choice(["p", "ul", "ol", "table"])
            if kind == "p":
                t = words()
                page.append(f"<p>{t.replace(' ', '  ')}" + rng.choice(["", "</p>"]))
                want.append(t)
            elif kind == "table":
                rows = [[words() for _ in range(2)] for _ in range(rng.randint(1, 3))]
                rows = [[c[:30].strip() or "x" for c in r] for r in rows]
                page.append("<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in rows) + "</table>")
                wide = max(len(r[0]) for r in rows)
                want.append("\n".join(f"{r[0].ljust(wide)} | {r[1]}" for r in rows))
            else:
                items = [words() for _ in range(rng.randint(1, 4))]
                page.append(f"<{kind}>" + "".join(f"<li>{i}" + rng.choice(["", "</li>"]) for i in items) + f"</{kind}>")
                want.append("\n".join((f"{k}. " if kind == "ol" else "- ") + i for k, i in enumerate(items, 1)))
        assert html_to_text("".join(page)) == "\n\n".join(want)


def test_whole_table(spark):
    rows = [(1, "<p>a<p>b", "x"), (2, None, "x"), (3, "", "x"), (None, "plain  text", "x"), (1, "<p>a<p>b", "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted(((r["page_id"], r["text"], r["n_chars"], r["n_lines"]) for r in extract_text(pages).collect()), key=repr)
    assert got == sorted([(1, "a\n\nb", 4, 3), (2, "", 0, 0), (3, "", 0, 0), (None, "plain text", 10, 1), (1, "a\n\nb", 4, 3)], key=repr)
    assert extract_text(pages.limit(0)).collect() == []


def test_words_after_stray_quotes_survive():
    assert html_to_text("<p title=it's>Hello, we don't lose this</p>") == "Hello, we don't lose this"
    assert html_to_text('<a href="x"">first link</a>') == "first link"
    assert html_to_text('<p "hidden">a</p><p a=b"c>b</p><p title=a="b>c</p>') == "a\n\nb\n\nc"
    assert html_to_text("""<a href="a>b" title = 'c>d'>x</a> <img alt="1 > 0">""") == "x 1 > 0"
    assert html_to_text("<a href=http://x/?q='a>y</a>") == "y"


def test_empty_comments():
    assert html_to_text("<!-->a<!--->b<!---->c<!-- d -->e") == "abce"
