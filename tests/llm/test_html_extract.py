from seqloom.llm import html_extract as h

SCHEMA = "page_id long, url string, html string"


def page(i, n=3):
    paragraphs = "".join(f"<p>Para {k} of {i} &amp; more\n  text.<br>Next" + ("</p>" if k % 2 else "") for k in range(n))
    return (
        f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>if (a<b) x='</p>';</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href='/a>b'>Menu {i}</a></ul></nav>"
        f"<div class='cookie notice'>We use cookies {i}</div><!-- <p>no</p> --><div class='content'><h1>Head {i}</h1><div class=\"ad\">Buy {i}</div>{paragraphs}<form><input name=x>Go</form></div>"
        f"<aside>Side {i}</aside><div id='comments'><p>Reader says {i} a lot of words here and there and more</p></div><footer>&copy; {i}</footer></body></html>"
    )


def expected(i, n=3):
    return "\n".join([f"Head {i}", *[f"Para {k} of {i} & more text. Next" for k in range(n)]])


def test_pages(spark):
    rows = [(i, f"https://a.example/{i}", page(i, i % 4 + 1)) for i in range(12)] + [(100, None, None), (101, "x", ""), (102, "https://b.example/", "plain words only"), (103, None, "<p>One<p>Two &lt;3"), (None, "https://a.example/n", page(5))]
    got = {r["page_id"]: r["text"] for r in h.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    for i in range(12):
        assert got[i] == expected(i, i % 4 + 1)
    assert got[100] == "" and got[101] == "" and got[102] == "plain words only" and got[103] == "One\nTwo <3" and got[None] == expected(5)


def test_wrapper_finds_optional_and_repeated_parts():
    w = None
    for i in range(1, 5):
        p = h.wrapper_of(h.parse(f"<body><div><p>a{i}" + "<p>b" * (i % 3) + ("<hr><b>x</b>" if i == 2 else "") + "</div></body>"))
        w = h.align(w, p) if w else p
    said = h.expression(w)
    assert "(<p>#slot" in said and ")+" in said and "?" in said


def test_alignment_keeps_order():
    a, b = h.wrapper_of(h.parse("<i>1</i><b>2</b><u>3</u>")), h.wrapper_of(h.parse("<b>2</b><s>4</s><u>5</u>"))
    assert list(h.align(a, b)[h.CHILDREN]) == ["i", "b", "s", "u"]


def test_deep_and_broken():
    deep = "<div>" * 400 + "word" + "</div>" * 400
    assert h.text_of(deep, None) == "word"
    assert h.text_of("a < b <p class='x", None) == "a < b"
    assert h.text_of("<script>never ends", None) == ""


def test_empty(spark):
    assert h.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_classes_of_the_page_and_of_content():
    page = "<body class='sidebar-right comments-open'><div class='entry-content comments-open'><p>Main words here.</p><div class='post-header'>no</div></div><div class='comments'><p>Reader words here and more of them, really many of them.</p></div></body>"
    assert h.text_of(page, None) == "Main words here."


def test_nothing_beside_the_largest_child_is_lost():
    long = " ".join(["word"] * 300)
    assert h.text_of("<body><article><h1>Head</h1><p>Lead words.</p><div class='content'><p>Body one.</p></div></article></body>", None) == "Head\nLead words.\nBody one."
    assert h.text_of("<body><div class='post-intro'><p>Intro.</p></div><div class='post-body'><p>Body of more words.</p></div></body>", None) == "Intro.\nBody of more words."
    assert h.text_of(f"<body><h1>Head</h1><div><p>{long}</p></div></body>", None) == f"Head\n{long}"
    assert h.text_of("<body><div class='top'><a href='/'>Home</a> <a href='/x'>More</a></div><div class='text'><h2><a href='/t'>Title</a></h2><p>Text.</p></div></body>", None) == "Title\nText."


def test_marks_inside_the_article():
    words = " ".join(["word"] * 25)
    body = (
        "<section id='related-work'><h2 id='search'>Search</h2><p class='notice'>Note well.</p><h2 id='header-fields'>Fields</h2><table class='form-factor'><tr><td>ATX</table><pre>x <span class='comment'># why</span></pre></section>"
        f"<div data-id='search' data-class='menu'>Kept.</div><div class='form-factor'><p>{words}</p></div>"
    )
    gone = "<div class='comment-list'><p>Reader.</p></div><div class='search-form'><p>Go there</p></div><div class='related-links'><a href='/'>" + words + "</a></div>"
    assert h.text_of(f"<body><article><p>Start.</p>{body}{gone}</article></body>", None) == f"Start.\nSearch\nNote well.\nFields\nATX\nx # why\nKept.\n{words}"


def test_ten_thousand_levels(spark):
    deep = "<div>" * 10_000 + "word"
    other = "<div>" * 9_000 + "text</div><p>end"
    w = h.wrapper_of(h.parse(deep))
    assert h.flat(h.unflat(h.flat(w))) == h.flat(w) and h.expression(w).count("<div>") == 10_000
    rows = [(1, "https://a.example/1", deep), (2, "https://a.example/2", other), (3, "https://b.example/", "<p>plain")]
    assert {r["page_id"]: r["text"] for r in h.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == {1: "word", 2: "text\nend", 3: "plain"}


def test_constants_of_a_host_go():
    long = "Our shop has " + " ".join(["fine"] * 30)

    def made(i):
        menu = "<div class='c1'><ul><li>Home<li>Shop</ul></div>"
        notice = f"<div class='c2'><p>{long} .</p></div>"
        table = f"<table><tr><th>Weight<td>{i} kg</table>"
        return f"<body>{menu if i % 2 else ''}<div class='c3'><p>Text {i} <b>by</b> us.</p><h2>Data</h2>{table}<p>{long} {i}.</p><h2>More</h2></div>{notice}</body>"

    w = None
    for i in range(8):
        own = h.wrapper_of(h.parse(made(i)))
        w = h.align(w, h.unflat(h.flat(own))) if w else own
    plan = h.decide(w)
    for i in range(8):
        assert h.text_of(made(i), plan) == f"Text {i} by us.\nData\nWeight\n{i} kg\n{long} {i}."


def test_copies_of_a_page_show_no_constants():
    page = "<body><div><p>One text.</p><p>More of it.</p></div></body>"
    w = h.wrapper_of(h.parse(page))
    for x in [page, page, page.replace("One", "Other")]:
        w = h.align(w, h.wrapper_of(h.parse(x)))
    assert h.text_of(page, h.decide(w)) == "One text.\nMore of it."


def test_content_with_names_of_other_parts():
    def made(i):
        return (
            f"<body><div class='related-posts'><a href='/'>See page {i}</a> <a href='/x'>or {i + 1}</a></div><article><h1>T {i}</h1><p>Lead {i}</p><div class='related-work'><p>Earlier work {i}.</p></div>"
            f"<div class='notice-of-death'><p>Died in {1900 + i}.</p></div><div class='story-search'><p>Search for gold {i}.</p></div><div class='search-box'><p>Find {i}</p><input name=q></div></article></body>"
        )

    w = None
    for i in range(6):
        own = h.wrapper_of(h.parse(made(i)))
        w = h.align(w, own) if w else own
    for plan in (h.decide(w), None):
        assert h.text_of(made(2), plan) == "T 2\nLead 2\nEarlier work 2.\nDied in 1902.\nSearch for gold 2."


def test_host_without_telling_names(spark):
    """Menu and footer bear no tag or class that tells: they are what all pages share."""

    def made(i):
        return (
            f"<html><body><div><div><a href='/'>Home</a> <a href='/n'>News</a></div><div>Welcome to Site X and our many services</div></div><div><h1>Title {i}</h1><p>Text of page {i}.</p>"
            + "".join(f"<p>More {k} of {i}</p>" for k in range(i % 3))
            + "</div><div>Copyright 2020 Site X, all rights reserved</div></body></html>"
        )

    rows = [(i, f"https://x.example/{i}", made(i)) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in h.extract(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert got == {i: "\n".join([f"Title {i}", f"Text of page {i}.", *[f"More {k} of {i}" for k in range(i % 3)]]) for i in range(9)}


def test_twenty_thousand_levels(spark):
    rows = [(1, "https://a.example/1", "<div>" * 20_000 + "word" + "</div>" * 20_000), (2, "https://a.example/2", "<p>plain")]
    assert {r["page_id"]: r["text"] for r in h.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == {1: "word", 2: "plain"}


def brute_wrapper(pages):
    """All pages at once: for each chain of names how many pages have it, whether siblings repeat it, and
    whether its text is the same everywhere."""
    places = {}

    def walk(node, chain, here, counts):
        said = " ".join(" ".join(p.split()) for p in node.parts if isinstance(p, str) and p.split())
        here.setdefault(chain, []).append(said)
        for c in (p for p in node.parts if isinstance(p, h.Node)):
            n = sum(isinstance(p, h.Node) and p.name == c.name for p in node.parts)
            counts[(*chain, c.name)] = max(n, counts.get((*chain, c.name), 0))
            walk(c, (*chain, c.name), here, counts)

    for page in pages:
        here, counts = {}, {}
        walk(h.parse(page), (), here, counts)
        for chain, texts in here.items():
            p = places.setdefault(chain, [0, False, set()])
            p[0] += 1
            p[1] |= counts.get(chain, 1) > 1
            p[2] |= set(texts)
    return {c: (n, r, len(t) == 1 and t != {""}) for c, (n, r, t) in places.items()}


def test_alignment_against_brute_force():
    import random

    r = random.Random(9)

    def part(depth):
        tag = r.choice(["div", "p", "ul", "b"])
        inner = "".join(part(depth - 1) for _ in range(r.randrange(3))) if depth and tag != "p" else ""
        return f"<{tag}>{r.choice(['same', 'x', 'word ' + str(r.randrange(3))])}{inner}</{tag}>"

    for _ in range(40):
        pages = ["".join(part(3) for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 6))]
        w = None
        for page in pages:
            own = h.wrapper_of(h.parse(page))
            w = h.align(h.unflat(h.flat(w)), own) if w else own
        mine, todo = {}, [((), w)]
        while todo:
            chain, node = todo.pop()
            mine[chain] = (node[h.PAGES], bool(node[h.REPEATED]), node[h.CONSTANT] is not None)
            todo.extend(((*chain, k), c) for k, c in node[h.CHILDREN].items())
        assert mine == brute_wrapper(pages)


def test_op7_over_broadcast_and_join(spark, tmp_path, monkeypatch):
    from seqloom.llm.queries import QUERIES

    rows = [(i, f"https://h{i % 3}.example/{i}", page(i, i % 4 + 1)) for i in range(40)] + [(None, None, None), (3, "https://h0.example/3", page(3, 4)), (99, "https://h0.example/", "<p>" + "é word " * 200_000)]
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "url as host", "html as page", "html as text").write.parquet(str(tmp_path / "pages.parquet"))
    want = [(i, u, expected(i, i % 4 + 1)) if i is not None and i < 99 else (i, u, "" if i is None else ("é word " * 200_000).strip()) for i, u, _ in rows]
    for limit in (h.BROADCAST, 0):
        monkeypatch.setattr(h, "BROADCAST", limit)
        got = QUERIES["op7_html"](spark, str(tmp_path))
        assert got.columns == ["page_id", "url", "text", "n_chars"]
        assert sorted((repr(r["page_id"]), r["text"], r["n_chars"]) for r in got.collect()) == sorted((repr(i), t, len(t)) for i, _, t in want)
