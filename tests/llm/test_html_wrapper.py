import html
import re

from verity.llm import html_wrapper as op

SF = "/root/testdata/sf0.01"


def brute(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", body)]
    return "\n".join(b for b in blocks if b)


def test_whole_table_against_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: brute(r.html) for r in pages.collect()}
    got = {r.page_id: r for r in op.extract_main_text(pages).collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def page(i, main, wrap="<article>{}</article>"):
    return f"<html><head><title>t{i}</title><script>x='<p>no</p>'</script></head><body><nav><a href=/>Menu {i}</a></nav><div class='cookie-banner'>We use cookies</div>{wrap.format(main)}<aside>side {i}</aside><section id=comments><p>reader {i}</p></section><footer>© {i}</footer></body></html>"


def test_wrapper_without_an_article_element(spark):
    wrap = "<div class=page><div class=top><p>Site slogan here</p></div><div class=story>{}</div><div class=end><p>All rights reserved</p></div></div>"
    rows = [(i, f"http://h.example/{i}", page(i, f"<h2>Title {i}</h2><p>Body number {i} has <b>many</b>&nbsp;words &amp; more<br>second line {i}", wrap)) for i in range(12)]
    got = {r.page_id: r.text for r in op.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\nBody number {i} has many words & more\nsecond line {i}" for i in range(12)}


def test_alignment_is_the_greatest_matching():
    a = op.parse("<div><p>x</p><ul><li>1</li><li>2</li></ul><p>y</p></div>")
    b = op.parse("<div><h2>t</h2><p>x</p><ul><li>1</li><li>3</li><li>2</li></ul></div>")
    pairs = op.align(a, b)
    assert len(pairs) == 6  # root, div, p, ul, two li
    assert {(x.text(), y.text()) for x, y in pairs if x.tag == "li"} == {("1", "1"), ("2", "2")}


def test_constant_nodes_are_template_and_copies_are_no_evidence():
    root, marks = op.induce([page(i, f"<p>text {i}</p><p>Subscribe to our letter</p>") for i in range(4)])
    assert any("p" in m for m in marks)
    text = op.main_text(page(9, "<p>text 9</p><p>Subscribe to our letter</p>"), root, frozenset(marks))
    assert text == "text 9"
    assert op.induce([page(1, "<p>only</p>")])[1] == []


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "<p>deep" + "</div>" * 3000
    rows = [(1, None, None), (2, "x", ""), (3, "http://a/", "<article><p>cut off <b>he"), (4, "http://a/", "a < b <3 <unfinished"), (5, "http://[", deep), (6, "http://a/", "<table><tr><td>one<td>two<tr><td>three</table>"), (6, "http://a/", "<ul><li>x<li>y</ul><p>" + "long " * 100_000), (None, None, "<p>a&lt;b&#233;&#x41;&copy&nbsp; c</p><!-- no --><style>p{}</style>")]
    df = spark.createDataFrame([(i, u, h, "t", 1) for i, u, h in rows], "page_id long, url string, html string, text string, host int")
    got = [(r.page_id, r.text) for r in op.extract_main_text(df).collect()]
    by = {i: t for i, t in got if i != 6}
    assert len(got) == 8 and by[1] == "" and by[2] == "" and by[3] == "cut off he" and by[4].startswith("a < b <3") and by[5] == "deep"
    assert by[None] == "a<béA© c"
    assert sorted(t[:10] for i, t in got if i == 6) == ["one\ntwo\nth", "x\ny\nlong l"]
    assert op.extract_main_text(df.limit(0)).count() == 0


def extracted(spark, rows):
    return {r.page_id: r.text for r in op.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_template_of_most_pages_and_of_small_hosts(spark):
    """Hosts of exactly four pages, and a host on which some pages lack the template node."""
    letter = "<p>Subscribe to our letter</p>"
    rows = [(i, f"http://h{i // 4}.example/{i}", page(i, f"<p>text {i}</p>{letter}")) for i in range(40)]
    rows += [(i, "http://big.example/", page(i, f"<p>text {i}</p>{letter if i % 5 else ''}")) for i in range(100, 160)]
    rows += [(i, "http://long.example/", page(i, "".join(f"<p>{i} {k}</p>" for k in range(100 + i - 200)) + letter)) for i in range(200, 208)]
    got = extracted(spark, rows)
    assert not [i for i, t in got.items() if "Subscribe" in t]
    assert all(got[i] == f"text {i}" for i in [*range(40), *range(100, 160)])


def test_end_tags_of_deep_elements_close_only_themselves():
    page = "<article>" + "<div>" * 2000 + "deep<nav>menu</nav>" + "</div>" * 2000 + "<p>after</p></article><p>outside</p>"
    assert op.main_text(page) == "deep\nafter"
    tree = op.parse("<div>" * 149 + "<b><i>x</i></b><u>y</u>" + "</div>" * 149 + "z")
    assert [c for c in tree.children if isinstance(c, str)] == ["z"]


def test_the_wrapper_finds_the_article_of_the_whole_table_without_its_tag(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    many = [r for r in pages.collect()]
    host = lambda r: r.url.split("/")[2]
    sizes = {}
    for r in many:
        sizes.setdefault(host(r), set()).add(r.html)
    want = {r.page_id: brute(r.html) for r in many if len(sizes[host(r)]) >= op.MIN_PAGES}
    bare = [(r.page_id, r.url, r.html.replace("<article>", "<div class='story'>").replace("</article>", "</div>")) for r in many]
    got = extracted(spark, bare)
    assert len(want) > 50 and {k: got[k] for k in want} == want


def test_names_and_attributes_that_drop_nothing(spark):
    kept = ["<div class='social-policy'>policy {}</div>", "<p class=share-price>price {}</p>", "<p title='the hidden gems of Rome'>gems {}</p>", "<h2 id='related-work'>work {}</h2>", "<p>has <b>many</b> words {}</p>"]
    gone = ["<p hidden>hidden {}</p>", "<div class='cookie-banner'>cookies {}</div>", "<ul class='x comment-list'><li>reader {}</ul>", "<div id=sidebar-2>side {}</div>"]
    body = lambda i: "".join(x.format(i) for pair in zip(kept, [*gone, ""], strict=True) for x in pair)
    for wrap in ("<article>{}</article>", "<div class=story>{}</div>"):
        got = extracted(spark, [(i, "http://a.example/", page(i, body(i), wrap)) for i in range(8)])
        assert got == {i: f"policy {i}\nprice {i}\ngems {i}\nwork {i}\nhas many words {i}" for i in range(8)}


SNIPPETS = ["<p class=notice>notice {}</p>", "<div class=share>share {}</div>", "<p id=reply>reply {}</p>", "<section class=related>related {}</section>", "<div class=widget>widget {}</div>"]


def test_words_within_the_article_count_only_where_the_host_repeats_them(spark):
    alone = [(i, f"http://one{i}.example/", page(i, f"<p>text {i}</p>{x.format(i)}")) for i, x in enumerate(SNIPPETS)]
    odd = [(i, "http://host.example/", page(i, f"<p>text {i}</p>" + (SNIPPETS[i % 5].format(i) if i >= 145 else ""))) for i in range(100, 150)]
    always = [(i, "http://all.example/", page(i, f"<p>text {i}</p>" + "".join(x.format(i) for x in SNIPPETS))) for i in range(200, 208)]
    got = extracted(spark, alone + odd + always)
    word = ["notice", "share", "reply", "related", "widget"]
    assert all(got[i] == f"text {i}\n{word[i]} {i}" for i in range(5))
    assert all(got[i] == f"text {i}" + (f"\n{word[i % 5]} {i}" if i >= 145 else "") for i in range(100, 150))
    assert all(got[i] == f"text {i}" for i in range(200, 208))


def test_the_root_is_told_from_siblings_of_its_label(spark):
    story = lambda i: "".join(f"<p>part {k} of story {i} with many words</p>" for k in range(9))
    side = lambda i: f"<p>side {i} has few</p>"
    grid = lambda a, b: f"<html><body><div class=row><div class={a}>{{}}</div><div class={b}>{{}}</div></div></body></html>"
    rows = [(i, "http://grid.example/", grid("col-8", "col-4").format(story(i), side(i))) for i in range(8)]
    rows += [(i, "http://words.example/", grid("wide", "slim").format(story(i), side(i))) for i in range(10, 18)]
    rows += [(i, "http://bare.example/", f"<html><body><div>{side(i)}</div><div>{story(i)}</div><div>end {i}</div></body></html>") for i in range(20, 28)]
    rows += [(i, "http://ids.example/", f"<html><body><div class=top>{side(i)}</div><div id=post-{i}>{story(i)}</div></body></html>") for i in range(30, 38)]
    got = extracted(spark, rows)
    assert got == {i: "\n".join(f"part {k} of story {i} with many words" for k in range(9)) for i, _, _ in rows}


def test_the_whole_table_with_bare_divs(spark):
    many = spark.read.parquet(f"{SF}/pages.parquet").collect()
    host = lambda r: r.url.split("/")[2]
    sizes = {}
    for r in many:
        sizes.setdefault(host(r), set()).add(r.html)
    plain = lambda text: re.sub(r"<(/?)(article|nav|footer)\b[^>]*>", r"<\1div>", text)
    got = extracted(spark, [(r.page_id, r.url, plain(r.html)) for r in many])
    want = {r.page_id: brute(r.html) for r in many if len(sizes[host(r)]) >= op.MIN_PAGES}
    assert len(want) > 50 and sum(got[k] == v for k, v in want.items()) >= 0.95 * len(want)
