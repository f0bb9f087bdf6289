import random

from sparkredact.llm import extract


def page(i, body, extra=""):
    nav = "".join(f"<li><a href='/{k}'>menu {i} {k}</a></li>" for k in range(2 + i % 3))
    return f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul>{nav}</ul></nav>{extra}{body}<footer>&copy; {i}</footer></body></html>"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    return {r.page_id: r.text for r in extract.extract(df).collect()}


def paths(node):
    """The names around each slot of an expression."""
    found, places = extract.slots(node)

    def path(at):
        return (*(path(places[at].above) if places[at].above >= 0 else ()), places[at].sig)

    return [path(at) for _, at in found]


def test_articles_with_optional_and_repeated_parts(spark):
    rows, want = [], {}
    for i in range(40):
        paragraphs = [f"Par {i} {k} &lt;b&gt; a&nbsp;\n b" for k in range(1 + i % 4)]
        extra = "<div class='ad'>Buy now</div>" * (i % 2) + "<div id='cookie-notice'><p>We use</p></div>" * (i % 3 == 0)
        inner = "<h1>Head</h1>" + "".join(f"<p>{p}<br>" + "</p>" * (k % 2) for k, p in enumerate(paragraphs))
        inner += "<aside>side</aside><form><p>mail</p><input></form>" * (i % 5 == 0) + "<section class='comments'><p>reader says</p></section>"
        if i % 7 == 0:
            inner += "<ul><li>one<li>two</ul>"
        rows.append((i, f"https://h{i % 2}.example/{i}", page(i, f"<article>{inner}</article>", extra)))
        want[i] = "\n".join(["Head", *(f"Par {i} {k} <b> a b" for k in range(len(paragraphs))), *(["one", "two"] if i % 7 == 0 else [])])
    assert run(spark, rows) == want


def test_pages_without_article_use_the_evidence_of_the_host(spark):
    rows = []
    for i in range(12):
        body = f"<div class='x1'><div>Same on all pages of this site</div></div><div class='c'><h2>Title {i}</h2><p>{'long text ' * 20}{i}</p><p>more {i}</p></div><div class='l'><a href='/'>link {i} {'away ' * 9}</a></div>"
        rows.append((i, "http://plain.example/", page(i, body)))
    got = run(spark, rows)
    assert all(got[i] == f"Title {i}\n{('long text ' * 20)}{i}\nmore {i}" for i in range(12))


def test_copies_of_a_page_are_no_evidence_for_boilerplate(spark):
    one = "<div class='c'><h2>Title</h2><p>the whole text</p></div>"
    two = "<div class='c'><h2>Other</h2><p>another text</p><table><tr><td>only here</td></tr></table></div>"
    rows = [(i, "http://copies/", page(i, one)) for i in range(4)] + [(4 + i, None, page(0, one)) for i in range(3)]
    rows += [(10 + i, "http://mixed/", page(0, two)) for i in range(5)] + [(20 + i, "http://mixed/", page(i, f"<div class='c'><h2>T{i}</h2><p>text {i}</p></div>")) for i in range(3)]
    rows += [(30 + i, "http://many/", page(0, f"<div class='x'>Same everywhere</div><div class='c'><p>text {i}</p></div>")) for i in range(40)]
    got = run(spark, rows)
    assert all(got[i] == "Title\nthe whole text" for i in range(7))
    assert all(got[10 + i] == "Other\nanother text\nonly here" for i in range(5)) and all(got[20 + i] == f"T{i}\ntext {i}" for i in range(3))
    assert all(got[30 + i] == f"text {i}" for i in range(40))


def test_pages_without_article_on_a_host_that_has_some(spark):
    old = lambda i: page(i, f"<div class='x'>Old site</div><div class='c'><h2>Title {i}</h2><p>old text {i} {'word ' * 20}</p></div>")
    new = lambda i: page(i, f"<div class='x'>New site {i}</div><article><h2>Head {i}</h2><p>new text {i} {'word ' * 40}</p></article>")
    rows = [(i, "http://both/", old(i)) for i in range(6)] + [(10 + i, "http://both/", new(i)) for i in range(9)]
    rows += [(30, None, "<div>alone</div>"), (31, "http://[bad", new(1)), (32, None, new(2))]
    got = run(spark, rows)
    assert all(got[i] == f"Title {i}\nold text {i} {'word ' * 19}word" for i in range(6))
    assert all(got[10 + i] == f"Head {i}\nnew text {i} {'word ' * 39}word" for i in range(9))
    assert got[30] == "alone" and got[31].startswith("Head 1\n") and got[32].startswith("Head 2\n")


def test_rows_that_are_odd(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://[bad", "just text"), (4, "http://a/", "<article>cut &am"), (5, "http://a/", "<nav>open<article><p>in</article>"), (None, "http://a/", "<script>if (a<b)"), (6, "http://a/", "<article>" + "<p>word</p>" * 20_000 + "</article>"), (7, "http://a/", "<div hidden><p>no</p></div><article><!-- <p>no</p> --><header><h1>Yes</h1><p>by me</p></header>t</article>")]
    got = run(spark, rows)
    assert got[1] == got[2] == got[None] == "" and got[3] == "just text" and got[4] == "cut &am" and got[5] == "in"
    assert got[6] == "\n".join(["word"] * 20_000) and got[7] == "Yes\nt"


def test_aligned_wrapper_takes_every_skeleton():
    rng = random.Random(2)
    pages = []
    for _ in range(60):
        parts = [f"<p>{rng.random()}</p>" if rng.random() < 0.6 else "<h2>t</h2><ul><li>a<li>b</ul>" if rng.random() < 0.5 else "<table><tr><td>1<td>2</table>" for _ in range(rng.randint(0, 6))]
        pages.append(page(0, "<article>" + "".join(parts) + "</article>"))
    skeletons = [extract.skeleton(p) for p in pages]
    wrapper = skeletons[0]
    for s in skeletons[1:]:
        wrapper = extract.Node("html", extract.aligned(wrapper.children, extract.loaded(extract.dumped(s)).children))
    for s in skeletons:
        at = extract.placed(s, wrapper)
        whole = paths(wrapper)
        assert [whole[p] for p in at] == paths(s)


def test_marks_far_back_tell_what_is_aside(spark):
    many, long = " ".join(f"u-{c}" for c in "abcdefghijkl"), "x" * 60
    body = f"<article><p class='{many}'>in</p><div class='{many} sidebar'>far</div><div id='{long}-comments'>long</div><div class='{many} loads'>on</div><section role='{many} ad-{long}'><p>ad</p></section></article>"
    assert run(spark, [(1, "http://a/", page(0, body)), (2, "http://b/", page(0, body.replace("article", "div")))]) == {1: "in\non", 2: "in\non"}
    assert extract.signature("div", f"class='{many}'") != extract.signature("div", f"class='{many} sidebar'")


def test_every_slot_is_placed_where_siblings_have_equal_keys(spark):
    bodies = ["<section><p>A</p></section>", "<ul><li>x</li></ul><section><p>B</p></section>", "<section><table><tr><td>t</td></tr></table></section><ul><li>y</li></ul><section><p>C</p></section>"]
    rows = [(i, "http://one/", page(0, f"<article>{body}</article>")) for i, body in enumerate(bodies)]
    assert run(spark, rows) == {0: "A", 1: "x\nB", 2: "t\ny\nC"}


def test_nested_siblings_with_equal_keys_are_all_placed():
    rng = random.Random(7)

    def body(depth):
        kinds = ["<p>t</p>", "<ul><li>a</li></ul>", "<table><tr><td>1</td></tr></table>"]
        return "".join(f"<section>{body(depth - 1)}</section>" if depth and rng.random() < 0.5 else rng.choice(kinds) for _ in range(rng.randint(1, 4)))

    for _ in range(40):
        skeletons = [extract.skeleton(f"<article>{body(3)}</article>") for _ in range(25)]
        wrapper = skeletons[0]
        for s in skeletons[1:]:
            wrapper = extract.Node("html", extract.aligned(wrapper.children, extract.loaded(extract.dumped(s)).children))
        whole = paths(wrapper)
        for s in skeletons:
            at = extract.placed(s, wrapper)
            assert at == sorted(set(at)) and [whole[p] for p in at] == paths(s)


def test_verdicts_by_join_and_by_broadcast_agree(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}/", page(i, f"<article><p>t {i}</p></article>")) for i in range(9)]
    one = run(spark, rows)
    monkeypatch.setattr(extract, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(extract, "TOGETHER", 2)
    assert run(spark, rows) == one == {i: f"t {i}" for i in range(9)}


def boilerplate_pages(n, host="http://evidence/"):
    """Pages whose article ends with a line that is the same on all, and with a list of links; and the texts without them."""
    rows, want = [], {}
    for i in range(n):
        own = [f"Par {i} {k}" for k in range(1 + i % 3)]
        tail = "<p class='side-note'>Aside of %d</p><section><p>Thank you for reading.</p></section><ul><li><a href='/a'>See %d</a><li><a href='/b'>And %d</a></ul>" % (i, i, i + 1)
        notice = f"<div class='notice'><p>{'Mind the rules' if host.endswith('same/') else f'Edited {i}'}</p></div>"
        rows.append((i, host, page(i, f"<article><h1>All alike</h1>{notice}{''.join(f'<p>{p}</p>' for p in own)}{tail}</article>")))
        want[i] = "\n".join(["All alike", *([] if host.endswith("same/") else [f"Edited {i}"]), *own, f"Aside of {i}"])
    return rows, want


def test_the_wrapper_decides_within_articles(spark, monkeypatch):
    for host in ("http://evidence/", "http://same/"):
        rows, want = boilerplate_pages(12, host)
        assert run(spark, rows) == want
    # Without alignment across pages, nothing tells the article's boilerplate.
    rows, want = boilerplate_pages(12)
    alone = run(spark, [(i, f"http://alone{i}/", html) for i, _, html in rows])
    assert all("Thank you for reading." in alone[i] and f"See {i}" in alone[i] and f"Edited {i}" not in alone[i] for i in want)


def test_against_planted_texts(spark):
    """Random templates of hosts, whose blocks of main text are known."""
    rng, rows, want = random.Random(8), [], {}
    for h in range(6):
        frame = rng.choice(["<article>%s</article>", "<main><div class='x y z'>%s</div></main>", "<div id='page'><section><article class='post'>%s</article></section></div>"])
        around = [f"<div class='{c}'><p>%s</p></div>" for c in rng.sample(["sidebar", "ad", "cookie-bar", "promo box", "widget", "related"], 3)]
        for i in range(rng.randint(1, 14)):
            n = len(rows)
            kinds = [rng.choice(["<p>%s</p>", "<h2>%s</h2>", "<ul><li>%s</li></ul>", "<blockquote><p>%s</p></blockquote>", "<pre>%s</pre>"]) for _ in range(rng.randint(1, 9))]
            texts = [f"text {n} {k} {rng.random()}" for k in range(len(kinds))]
            body = "".join(kind % t for kind, t in zip(kinds, texts, strict=True))
            inner = rng.choice(["", "<aside>by the way</aside>", "<form><p>mail</p></form>", f"<section class='{'u ' * 20}comments'><p>says {n}</p></section>"])
            rows.append((n, f"https://t{h}.example/{i}", page(n, frame % (body + inner), "".join(a % f"around {n}" for a in around))))
            want[n] = "\n".join(texts)
    assert run(spark, rows) == want


def test_deep_pages_long_series_and_formulas(spark):
    deep = "<div>" * 10_000 + "down here" + "</div>" * 10_000
    series = "".join(f"<h2>h{i}</h2><p>p{i}</p><ul><li>u{i}</ul><pre>r{i}</pre><table><td>t{i}</table>" for i in range(40))
    formula = "<p>before <math><mi>x</mi></math> <svg><text>y</text></svg> <object>z</object> <span style='display:none'>w</span></p>"
    got = run(spark, [(1, "http://deep/", f"<article>{deep}</article>"), (2, "http://deep/", deep), (3, "http://series/", f"<article>{series}</article>"), (4, "http://math/", f"<article>{formula}</article>")])
    assert got[1] == got[2] == "down here" and got[4] == "before x y z w"
    assert got[3] == "\n".join(f"{k}{i}" for i in range(40) for k in "hpurt")
    group = extract.skeleton(f"<article>{series}</article>").children[0].children
    assert len(group) == 1 and group[0].sig == "+" and len(group[0].children) == 5


def test_empty_table(spark):
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
