"""Wrappers and extraction."""

import re

from driftframe.llm import html_extract
from driftframe.llm.html_extract import Reader, main_text, reader
from driftframe.llm.html_tree import parse, squeeze
from driftframe.llm.wrappers import Decision, Element, align, constant, digest, fold, merge
from driftframe.llm.wrappers import page as one_page


def page(title, paras, extra=""):
    body = "".join(f"<p>{p}</p>" for p in paras)
    return f"<html><head><title>{title}</title></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>B</a></li></ul></nav><div class='ad'>Buy now</div><article><h1>{title}</h1>{body}{extra}</article><footer>&copy; x</footer></body></html>"


def wrapper(*pages):
    return merge([one_page(p, parse(p)) for p in pages])


def where(d):
    return (d.main, d.top, d.whole, d.beside, d.fixed)


def test_wrapper_has_slots_groups_and_optionals():
    marks, e = wrapper(page("A", ["x", "y"]), page("B", ["z"], "<blockquote>q</blockquote>"))
    text = str(e)
    assert len(marks) == 2 and "p(#)+" in text and "blockquote('q')?" in text and "h1(#)" in text and "li(#" in text and "div.ad('Buy now')" in text
    assert where(Decision(marks, e)) == (["html", "body", "article"], 3, True, [], [])


def test_merging_order_does_not_matter_for_structure():
    pages = [page("A", ["x"]), page("B", ["y", "z"]), page("C", [], "<h2>s</h2><p>k</p>")]
    one = [wrapper(p) for p in pages]
    a = merge([merge(one[:2]), one[2]])
    one = [wrapper(p) for p in pages]
    b = merge([one[0], merge(one[1:])])
    assert where(Decision(*a)) == where(Decision(*b)) and a[0] == b[0]
    assert Element.unpack(a[1].pack()).pack() == a[1].pack()


def test_groups_of_two_fold():
    e = fold([Element("dt", chars=1, text="a"), Element("dd"), Element("dt", chars=1, text="b"), Element("dd")])
    assert len(e) == 1 and e[0].repeated and [x.key for x in e[0].inner] == ["dt", "dd"] and e[0].inner[0].text is None
    wide = align([Element(f"k{i}") for i in range(60)], [Element(f"k{i}") for i in range(30, 90)])
    assert len(wide) == 90 and all(x.optional for x in wide)


def test_text_of_the_article():
    assert main_text(page("T &amp; U", ["one <b>bold</b>\n  text", "two&nbsp;words<br>more"])) == "T & U\n\none bold text\n\ntwo words more"
    messy = "<body><div id=menu><a href=1>x</a></div><main><header><h1>H</h1></header><p>a<p>b<ul><li>c<li>d</ul><form><input><p>no</p></form><section class='comments'><p>nice</p></section><aside>no</aside><script>var x='</p>'</script><footer>no</footer></main>"
    assert main_text(messy) == "H\n\na\n\nb\n\nc\n\nd"
    assert main_text("<p>cut <b>off <i>here") == "cut off here"
    assert main_text("<div>" * 5000 + "deep") == main_text("<b>" * 5000 + "deep") == "deep"
    assert main_text("<article>" + "<p>x</p>" * 20_000 + "</article>").count("x") == 20_000


def test_comments_notices_and_sidebars_go():
    html = "<body><header>Site</header><div class='cookie-notice'>ok?</div><div class='content'><h2>Title</h2><p>Body text of some length here.</p></div><div class='sidebar'><p>Popular posts and so on</p></div><div id='comments'><p>first!</p></div></body>"
    assert main_text(html) == "Title\n\nBody text of some length here."


def test_names_of_what_stands_beside():
    body = "<article><h1>T</h1><p>text</p><div class='reader-comments'>c</div></article>"
    assert main_text(f"<body class='no-sidebar'><div class='layout has-sidebar'>{body}<div class='sidebar'>s</div></div></body>") == "T\n\ntext"
    assert main_text(f"<body><div class='sidebar-layout sidebar'>{body}</div></body>") == "T\n\ntext"


def test_constants_of_a_template_go(spark):
    pages = [(i, f"http://h.example/{i}", page(f"T{i}", [f"text {i}"], "<p class='tail'>Read more on our site.</p>"), 1) for i in range(12)]
    pages += [(100, "http://h.example/q", None, 1), (101, None, "<p>alone</p>", 1), (102, "odd", "", 1), (100, "http://h.example/q", None, 1), (None, "http://o.example/", "<div><p>x y</p></div>", 1)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string, text int")
    got = html_extract.extract(d).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 17 and by[3] == "T3\n\ntext 3" and by[100] == by[102] == "" and by[101] == "alone" and by[None] == "x y"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(d.limit(0)).count() == 0


def by_host(pages):
    r = reader(Decision(*wrapper(*pages)))
    return [main_text(p, r) for p in pages]


def test_a_constant_goes_by_its_string_not_by_its_path():
    body = lambda i: f"<body><article><h1>T{i}</h1><p>By our staff</p><h2>Summary</h2><p>body {i}</p><p>more {i}</p><div>Filed under<p>topic {i}</p></div><h2>Part {i}</h2></article></body>"
    assert by_host([body(i) for i in range(12)]) == [f"T{i}\n\nbody {i}\n\nmore {i}\n\ntopic {i}\n\nPart {i}" for i in range(12)]


def test_a_constant_is_a_string_that_nearly_all_pages_show():
    inner = ["<blockquote><p>short quote</p></blockquote>", "<ul><li>one item</li></ul>", "<section><h2>a part</h2></section>", "<table><tr><td>a cell</td></tr></table>"]
    pages = [page(f"T{i}", [f"text {i}"], (inner[i] if i < 4 else "") + ("" if i == 19 else "<div><p>On every page but one.</p></div>")) for i in range(20)]
    said = ["\n\nshort quote", "\n\none item", "\n\na part", "\n\na cell"]
    assert by_host(pages) == [f"T{i}\n\ntext {i}" + (said[i] if i < 4 else "") for i in range(20)]
    half = [page(f"T{i}", [f"text {i}"], "<div><p>On half of the pages.</p></div>" * (i % 2)) for i in range(20)]
    assert by_host(half) == [f"T{i}\n\ntext {i}" + "\n\nOn half of the pages." * (i % 2) for i in range(20)]


def test_text_beside_the_core_of_an_unnamed_article_stays():
    menu = "<ul><li><a href='/'>Home</a> |<li><a href=/b>About us</a></ul>"
    long = "A paragraph of the body that is long enough to weigh much more than what stands around it. "
    page = f"<body>{menu}<h1>Title</h1><div><p>{long}</p><p>{long * 3}</p></div><div><p>closing part</p><p>See <a href=/x>a page with a long name</a></p></div><footer>f</footer></body>"
    assert main_text(page) == f"Title\n\n{long.strip()}\n\n{(long * 3).strip()}\n\nclosing part\n\nSee a page with a long name"
    assert main_text(f"<body><div><p>{long}</p></div><section><header><h2>End</h2></header><p>closing part</p></section></body>") == f"{long.strip()}\n\nEnd\n\nclosing part"
    items = "".join(f"<li>point {i} of a long list</li>" for i in range(30))
    assert main_text(f"<body><header>Site</header>bare words<div><p>intro one</p><p>intro two</p><ul>{items}</ul></div></body>").startswith("bare words\n\nintro one\n\nintro two\n\npoint 0")
    texts = by_host([f"<body><div>Our site</div>{menu}<h1>T{i}</h1><div><p>{long}{i}</p><p>{long * 2}{i}</p></div><div><p>closing {i}</p></div></body>" for i in range(12)])
    assert texts == [f"T{i}\n\n{long}{i}\n\n{long * 2}{i}\n\nclosing {i}" for i in range(12)]


def test_a_long_constant_goes_and_a_long_text_of_one_page_stays():
    notice = "All opinions on this site are those of their authors and no advice of any kind. " * 5
    pages = [page(f"T{i}", [f"text {i}"], f"<div><p>{notice}</p></div>" + (f"<blockquote><p>{notice}{i}</p></blockquote>" if i == 3 else "")) for i in range(12)]
    assert by_host(pages) == [f"T{i}\n\ntext {i}" + (f"\n\n{notice}{i}" if i == 3 else "") for i in range(12)]
    unnamed = lambda i: f"<body><section><p>{notice}</p><p>{notice}</p></section><div><p>{notice[:150]}{i}</p><{'ul' if i else 'ol'}><li>{notice}{i}</li></{'ul' if i else 'ol'}></div></body>"
    assert Decision(*wrapper(unnamed(0), unnamed(1))).main == ["body", "div"]


def test_reader_mends_markup():
    assert squeeze(" a&amp;b &#65;\n c&nbsp;d ") == "a&b A c d"
    root = parse("<table><tr><td>a<td>b<tr><td>c</table><p>x<div>y</div><option>z")
    assert [c.tag for c in root.children] == ["table", "p", "div", "option"] and len(root.children[0].children) == 2
    assert parse("<a href='x>y").children[0].children == ["y"] and parse("a < b").children == ["a < b"] and parse("x<a href=").children == ["x"]


WORDS = "river stone quiet morning light over the green hill went old house under walls and on".split()


def prose(i, k, n):
    return " ".join(WORDS[(i * 7 + k * 3 + j * (k + 2)) % len(WORDS)] for j in range(n)) + f" {i}-{k}."


def unnamed(i):
    """A page without an article element and without a telling name."""
    menu = "<div class=qa><ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li></ul></div>"
    side = f"<div class=qb><h3>You may also like</h3><p>{prose(i, 50, 40)}</p></div><div class=qc>{prose(i, 51, 6)}</div>"
    said = f"<div class=qd><h4>Readers say</h4><div><b>Ann</b><p>{prose(i, 60, 12)}</p></div></div>"
    return f"<html><body>{menu}<div class=qe><h1>Title {i}</h1>" + "".join(f"<p>{prose(i, k, 30)}</p>" for k in range(3 + i % 3)) + f"</div>{side}{said}<div class=qf>All rights reserved</div></body></html>"


def article(i):
    return "\n\n".join([f"Title {i}", *(prose(i, k, 30) for k in range(3 + i % 3))])


def test_the_wrapper_finds_an_article_that_no_name_tells():
    pages = [unnamed(i) for i in range(30)]
    assert by_host(pages) == [article(i) for i in range(30)]
    assert all(main_text(p) != article(i) for i, p in enumerate(pages))


def test_the_number_of_pages_is_no_switch():
    tail = lambda i: page(f"T{i}", [f"text {i}", f"and more {i}"], "<p class='tail'>Read more on our site.</p>")
    for n in (2, 3, 7, 8, 9):
        assert by_host([tail(i) for i in range(n)])[0] == "T0\n\ntext 0\n\nand more 0"
        assert by_host([unnamed(i) for i in range(n)])[0] == article(0)


def test_copies_of_a_page_are_no_template():
    pages = [page("A", ["one", "two"])] * 20 + [page("B", ["three"])]
    assert by_host(pages)[0] == "A\n\none\n\ntwo" and by_host(pages)[-1] == "B\n\nthree"
    near = [page("A", [f"paragraph {k} of many" if k or i < 15 else "edited" for k in range(9)]) for i in range(16)]
    assert all(t.count("paragraph") >= 8 for t in by_host(near))


def test_names_of_real_content_stay():
    inside = "<section class='related-work'><p>prior art</p></section><div class='widget-theory'><p>on widgets</p></div><p><label>a label</label> and text</p>"
    assert main_text(f"<article><h1>T</h1><p>x</p><p>y</p>{inside}</article>") == "T\n\nx\n\ny\n\nprior art\n\non widgets\n\na label and text"
    for name in ("related-posts", "comment-list", "cookie_notice", "share-buttons", "ad", "sidebar"):
        assert main_text(f"<article><p>x</p><p>y</p><div class='{name}'><p>no</p></div></article>") == "x\n\ny"


def test_template_strings_equal_brute_force():
    pages = [page(f"T{i % 4}", [f"text {i}", "same on all", f"half {i % 2}"], "<div><p>Tail of the site.</p></div>" if i else "") for i in range(20)]
    held = {}
    for i, p in enumerate(pages):
        for path, text in re.findall(r"<(h1|p)>(.*?)</\1>", p[p.index("<article>") :]):
            held.setdefault((("/div/" if text.startswith("Tail") else "/") + path, text), set()).add(i)
    want = sorted(constant(path, digest(text)) for (path, text), seen in held.items() if len(seen) >= 0.9 * len(pages))
    assert len(want) == 2 and Decision(*wrapper(*pages)).fixed == want


def test_a_decision_that_does_not_fit_is_not_used():
    assert main_text("<body><p>alone</p></body>", Reader(["html", "body", "article"], 3, True, [], [])) == "alone"


def test_a_sample_of_distinct_pages_tells_strings_apart():
    pages = [page(f"T{i}", [f"text {i}", f"more {i}"], "<p>Read more on our site.</p>") for i in range(300)]
    marks, e = merge([wrapper(*pages[k::7]) for k in range(7)])
    assert len(marks) == 24 and Element.unpack(e.pack(frozenset(marks))).pack() == e.pack(frozenset(marks))
    r = reader(Decision(marks, e))
    assert main_text(pages[250], r) == "T250\n\ntext 250\n\nmore 250"


def test_template_strings_are_told_on_all_pages_of_a_host(spark):
    # a line on the 24 pages of least digest alone, which a sample of 24 takes for the template's
    noted = sorted((one_page(p, parse(p))[0][0], i, p) for i, p in ((i, page(f"T{i}", [f"text {i}"], "<p class='tail'>A line of some pages.</p>")) for i in range(200)))
    plain = [(i, page(f"T{i}", [f"text {i}"])) for _, i, _ in noted[24:]]
    pages = [(i, p) for _, i, p in noted[:24]] + [(i, p) for i, p in plain if one_page(p, parse(p))[0][0] > noted[23][0]]
    assert len(pages) > 100 and "A line of some pages." not in main_text(pages[0][1], reader(Decision(*wrapper(*(p for _, p in pages)))))
    d = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in pages] * 2, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(d).collect()}
    lines = {i for _, i, _ in noted[:24]}
    assert got == {i: f"T{i}\n\ntext {i}" + "\n\nA line of some pages." * (i in lines) for i, _ in pages}


def test_counts_over_pages_equal_brute_force(spark):
    pages = [page(f"T{i % 4}", [f"text {i}", "same on all", f"half {i % 2}"], "<div><p>Tail of the site.</p></div>" if i else "") for i in range(20)]
    d = spark.createDataFrame([("h", p) for p in pages * 3], "host string, html string").repartition(5)
    assert html_extract.decisions(html_extract.wrappers(d)).first()["fixed"] == Decision(*wrapper(*pages)).fixed != []
