import math
from collections import Counter, defaultdict

from strandline.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=x>Home</a><li>More</ul></nav><!-- <p>no</p> --><div class="ad">Buy</div><div id="cookie-notice">We use</div>
<article><header><h1>Head &amp;  line</h1></header><p><b>First para.<br><p>Second\n para &lt;b&gt; &#233;&nbsp;x<aside>side</aside><div class="comments"><p>I disagree</p></div>
<form><p>Sign</p></form><table><tr><td>a<td>b</table></article><footer>&copy; me</footer></body></html>"""


def test_main_text_of_a_page():
    assert html.main_text(PAGE, {}) == "Head & line\nFirst para.\nSecond para <b> é x\na\nb"
    assert html.main_text(None, {}) == html.main_text("", {}) == html.main_text("<nav>x</nav>", {}) == ""
    assert html.main_text("just text", {}) == "just text"
    assert html.main_text("<p>a<p>b</p></p>c", {}) == "a\nb\nc"
    assert html.main_text('<div class="page no-sidebar has-menu"><p>a</p></div><article class="comment"><p>b</p></article>', {}) == "a"
    assert html.main_text('<main class="ad"><div class="adventure shared">a</div></main><div role=search>b</div><p hidden>c</p>', {}) == "a"


def plain_importance(pages):
    """(node, leaf) of every path, straight from the definition."""
    seen = defaultdict(dict)
    for p in pages:
        root, blocks = html.parse(p)
        key = html.page_key(blocks)
        for path, (style, content) in html.merged_nodes(root).items():
            a, b = seen[path].get(key, (style, content))
            seen[path][key] = (min(a, style), min(b, content))
    out = {}
    for path, by_key in seen.items():
        both, m = list(by_key.values()), len(by_key)
        if m >= html.LEAST_PAGES:
            node = -sum(c / m * math.log(c / m, m) for c in Counter(s for s, _ in both).values())
            leaf = 1 - sum(c / m * math.log(c, m) for c in Counter(t for _, t in both).values())
            if min(node, leaf) < 0.999:
                out[path] = (round(node, 9), round(leaf, 9))
    return out


def test_branches_that_repeat_on_a_host_go(spark):
    body = "<div><div class=x><p>Same on every page</p></div><div class=y><p>Story number {0}</p>{1}</div></div>"
    pages = [body.format(i, "<p>More %d</p>" % i * (i % 3)) for i in range(9)]
    rows = [(i, f"http://a.example.org/{i}", p) for i, p in enumerate(pages)] + [(50, None, None), (51, "http://b.example.org/", pages[0]), (51, "http://b.example.org/", pages[0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    tree = {r.path: (round(r.node, 9), round(r.leaf, 9)) for r in html.site_tree(df.where("page_id < 50")).collect()}
    assert tree == plain_importance(pages)
    got = defaultdict(list)
    for r in html.extract(df).collect():
        got[r.page_id].append(r.text)
    for i in range(9):
        assert got[i] == ["\n".join([f"Story number {i}"] + [f"More {i}"] * (i % 3))]
    assert got[50] == [""]
    assert got[51] == ["Same on every page\nStory number 0"] * 2
    assert html.extract(df.limit(0)).count() == 0


def texts(spark, pages, host="a.example.org"):
    df = spark.createDataFrame([(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html.extract(df).orderBy("page_id").collect()]


def test_the_tree_decides_where_names_tell_nothing(spark, monkeypatch):
    """No landmark and no telling class: menus, notes and a line within the article go since they repeat, the story stays."""
    body = (
        "<div class=k1><ul>" + "".join(f"<li class=m{i}>Topic {i}</li>" for i in range(5)) + "</ul></div><div class=k2><div class=k3>Story number {0} of our town, told at length by its people</div><p class=k4>Lines of {0}</p>"
        "<div class=k5>Subscribe to hear more</div></div><div class=k6>All rights with us</div>"
    )
    pages = [body.format(i) for i in range(8)]
    want = [f"Story number {i} of our town, told at length by its people\nLines of {i}" for i in range(8)]
    assert texts(spark, pages) == want
    alone = html.main_text(pages[0], {})
    assert alone.startswith("Topic 0\nTopic 1") and alone.endswith("All rights with us")  # without the tree nothing goes
    monkeypatch.setattr(html, "BROADCAST_NODES", 0)  # joined by host
    assert texts(spark, pages) == want
    article = "<article><h1>Head {0}</h1><p>Body of {0} goes on</p><div class=z1>Read on in our app</div></article><nav>Menu {0}</nav>"
    assert texts(spark, [article.format(i) for i in range(6)]) == [f"Head {i}\nBody of {i} goes on" for i in range(6)]


def test_a_long_list_of_labels_goes_by_its_presentation(spark):
    """Labels that differ on every page in a structure that never does; paragraphs of the same structure stay."""
    menu = "<div class=q><div class=r>" + "".join("<div class=s{0}>Item {0} {{0}}</div>".format(k) for k in range(14)) + "</div></div>"
    story = "<div class=t>" + "".join("<p class=u{0}>Paragraph {0} of page {{0}} says something longer than a label does</p>".format(k) for k in range(14)) + "</div>"
    got = texts(spark, [(menu + story).format(i) for i in range(7)])
    assert all(t.count("Paragraph") == 14 and "Item" not in t for t in got)


def test_copies_on_one_host_keep_their_article(spark):
    page = "<nav>Menu {0}</nav><article><h1>One headline</h1><p>The same story, word for word</p></article>"
    assert texts(spark, [page.format(i) for i in range(40)]) == ["One headline\nThe same story, word for word"] * 40


def test_names_that_only_look_like_boilerplate():
    keep = {
        '<div id="content-sidebar-wrap"><article><h1>a</h1></article><div class="side-nav">b</div></div>': "a", '<article class="post comments-open"><p>a</p></article>': "a",
        '<article><h2 id="social-impact">a</h2><p id="notice">b</p></article>': "a\nb", '<div class="ad"><article><p>a</p></article></div>': "a", "<nav><main>a</main></nav>": "",
    }
    assert {p: html.main_text(p, {}) for p in keep} == keep


def test_hard_pages_take_linear_time():
    import time

    pages = ["<div>" * 200_000, "<div>" * 50_000 + "</x>" * 50_000, "<a '" * 250_000, "<a x='>'" * 125_000, "<a x='" * 160_000, "<li><ul>" + "<div>" * 60_000 + "<li></li>" * 60_000, "<p><button>" + "<div>" * 100_000, "<" * 1_000_000, "<!" * 500_000]
    for p in pages:
        began = time.process_time()
        html.main_text(p, {})
        assert time.process_time() - began < 5, p[:20]
    assert html.main_text("<p>" + "word " * 200_000 + "</p>", {}) == ("word " * 200_000).strip()


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a.org/", "<p>x</p>", 7, 8)], "page_id long, url string, html string, host long, nodes long")
    assert html.extract(df, extra=("page_id", "host", "nodes", "html")).first().asDict() == {"page_id": 1, "host": 7, "nodes": 8, "html": "<p>x</p>", "text": "x"}


def plain_extraction(pages):
    """{page_id: text} by the definition, on well-formed pages of div, p, ul, nav and article without classes that tell anything; no code of the module."""
    import xml.etree.ElementTree as ET

    least, label, damping, dull = 0.3, 40, 0.9, {"nav"}
    docs = {}
    for page_id, host, body in pages:
        root, nodes = ET.fromstring(f"<r>{body}</r>"), []

        def walk(e, path, main, dim, nodes=nodes):
            kids = list(e)
            n = {"path": path, "kids": [], "main": main or e.tag == "article", "prior": 0.1 if dim or e.tag in dull else 1.5 if main or e.tag == "article" else 1.0, "tag": e.tag, "text": (e.text or "").strip()}
            nodes.append(n)
            for k in kids:
                name = f"{k.tag}.{k.get('class')}" if k.get("class") else k.tag
                n["kids"].append(walk(k, (*path, name), n["main"], dim or e.tag in dull))
            n["style"] = [k["path"][-1] for k in n["kids"]]
            n["holds"] = any(k["holds"] or k["main"] for k in n["kids"])
            n["size"] = len(n["text"]) + sum(k["size"] for k in n["kids"])
            return n

        walk(root, (), False, False)
        main = [n for n in nodes if n["main"] and n["prior"] >= 1 and n["text"]]
        heads = [n["text"] for n in main if n["tag"] == "h1"]
        key = tuple(heads or [n["text"] for n in main] or [n["text"] for n in nodes if n["prior"] >= 1 and n["text"]])
        docs[page_id] = host, nodes, key
    seen = defaultdict(dict)
    for host, nodes, key in docs.values():
        merged = defaultdict(lambda: [[], [], 0, True])
        for n in nodes:
            m = merged[n["path"]]
            m[0].append(" ".join(n["style"]))
            m[1] += [n["text"]] if n["text"] else []
            m[2] += n["size"]
            m[3] &= not n["main"] and not n["holds"] and n["tag"] not in ("h1", "h2")
        within = sum(len(n["text"]) for n in nodes if n["main"] and n["prior"] >= 1)
        for path, m in merged.items():
            seen[host, path].setdefault(key, []).append((html.digest("\n".join(m[0])), html.digest("\n".join(m[1])), m[2], within, m[3]))
    folded = {k: [tuple(min(f[i] for f in forms) for i in range(5)) for forms in v.values()] for k, v in seen.items()}
    entropy = lambda values: -sum(c / len(values) * math.log(c / len(values), len(values)) for c in Counter(values).values())
    weigh = lambda forms: min(sum(f[2] for f in forms) / sum(f[3] for f in forms), 1) if all(f[4] for f in forms) and sum(f[3] for f in forms) else 1.0
    every = defaultdict(list)
    for (_, path), forms in folded.items():
        every[path] += forms
    out = {}
    for page_id, (host, nodes, _) in docs.items():
        def of(n, host=host):
            forms = folded[host, n["path"]]
            if len(forms) >= 5:
                return entropy([f[0] for f in forms]), entropy([f[1] for f in forms]), weigh(forms)
            return 1.0, 1.0, weigh(every[n["path"]]) if len(every[n["path"]]) >= 5 else 1.0

        comp, worthy = {}, {}

        def rate(n):
            for k in n["kids"]:
                rate(k)
            node, leaf, _ = of(n)
            w = damping ** len(n["kids"])
            below = [comp[id(k)] for k in n["kids"]] + ([leaf] if n["text"] else [])
            comp[id(n)] = (1 - w) * node + w * sum(below) / len(below) if n["kids"] else leaf
            saved = n["main"] and n["prior"] >= 1
            worthy[id(n)] = bool(n["kids"]) and comp[id(n)] * n["prior"] >= least or len(n["text"]) >= label and (saved or leaf * n["prior"] >= least) or any(worthy[id(k)] for k in n["kids"])

        rate(nodes[0])
        low, light, blocks = set(), set(), []
        for n in nodes:
            if id(n) in low or n["kids"] and not worthy[id(n)]:
                low |= {id(n)} | {id(k) for k in n["kids"]}
            if id(n) in light or not n["main"] and not n["holds"] and n["tag"] not in ("h1", "h2") and of(n)[2] < least:
                light |= {id(n)} | {id(k) for k in n["kids"]}
            if n["text"]:
                long = n["main"] and n["prior"] >= 1 and len(n["text"]) >= label
                blocks.append([n["text"], n["prior"] >= least and (long or n["prior"] * of(n)[1] >= least and id(n) not in low), id(n) in light, n["prior"]])
        longest = [b for b in blocks if b[3] >= 1 and len(b[0]) >= label]
        if longest:
            max(longest, key=lambda b: len(b[0]))[1] = True
        styled = [b[0] for b in blocks if b[1] and not b[2]]
        out[page_id] = "\n".join(styled or [b[0] for b in blocks if b[1]])
    return out


def test_extraction_equals_the_definition(spark, monkeypatch):
    """Random pages of several hosts, one of them with too few pages for a tree of its own, against an extractor written apart."""
    import random

    rng = random.Random(12)
    kinds = ["<div class=c{0}>{1}</div>", "<p class=d{0}>{1}</p>", "<ul class=e{0}><li>{1}</li><li>fixed</li></ul>", "<nav>{1}</nav>", "<article class=f{0}><h1>{1}</h1><p>{1} goes on for a while, longer than a label</p></article>"]
    kinds = [k.replace("{0}>", '"{0}">').replace('class=c"', 'class="c').replace('class=d"', 'class="d').replace('class=e"', 'class="e').replace('class=f"', 'class="f') for k in kinds]
    said = ["the same on all", "shared by many", "{0} alone", "a text of more than forty signs that many pages of the host share", "{0} is told at some length here, and at more length than elsewhere"]
    rows = []
    for i in range(90):
        body = "".join(kinds[rng.randrange(5)].format(rng.randrange(3), rng.choice(said).format(i)) for _ in range(rng.randrange(1, 7))) + '<div class="z">a line of the layout</div>'
        rows.append((i, f"h{i % 3 if i < 87 else 9}.example.org", body))
    rows += [(100 + i, r[1], r[2]) for i, r in enumerate(rows[:9])]  # repeated pages
    df = spark.createDataFrame([(i, f"http://{h}/{i}", b) for i, h, b in rows], "page_id long, url string, html string")
    want = plain_extraction(rows)
    assert {r.page_id: r.text for r in html.extract(df).collect()} == want
    assert sum(html.main_text(b, {}) != want[i] for i, _, b in rows) > 20
    monkeypatch.setattr(html, "BROADCAST_NODES", 60)  # joined by host; the weights over all hosts still fit
    assert {r.page_id: r.text for r in html.extract(df).collect()} == want


def test_nodes_beyond_those_sent_are_joined(spark, monkeypatch):
    """Many hosts of one page each and some of seven, on six layouts: the weights over all hosts decide, whether sent or joined with the pages."""
    page = '<div class="k{1}"><p>Go {0}</p><p>See {0}</p></div><article class="f{1}"><h1>Head {0}</h1><p>Story {0} is a long one, and it goes on and on until it ends at last.</p></article><div class="z{1}">(c) {0}</div>'
    rows = [(i, f"h{i if i < 60 else 100 + i % 6}.example.org", page.format(i, i % 6)) for i in range(102)]
    rows += [(200 + i, r[1], r[2]) for i, r in enumerate(rows[:9])]  # repeated pages
    df = spark.createDataFrame([(i, f"http://{h}/{i}", b) for i, h, b in rows], "page_id long, url string, html string")
    want = plain_extraction(rows)
    assert all(t.startswith("Head") and t.endswith("at last.") for t in want.values())
    assert sum(html.main_text(b, {}) != want[i] for i, _, b in rows) == len(rows)
    for sent in (0, 1, 20, 40, html.BROADCAST_NODES):
        monkeypatch.setattr(html, "BROADCAST_NODES", sent)
        got = html.extract(df).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want, sent


def test_shared_bodies_and_introductions_stay(spark):
    body = "<p>The agency's report, word for word, as it stands on every page of this host today.</p>"
    pages = [f"<nav>Menu {i}</nav><article><h1>Headline {i}</h1>{body}<p>And the second paragraph of it, which is shorter by far</p></article>" for i in range(8)]
    texts_of = texts(spark, pages)
    assert texts_of == [f"Headline {i}\nThe agency's report, word for word, as it stands on every page of this host today.\nAnd the second paragraph of it, which is shorter by far" for i in range(8)]
    intro = "<article><h1>Number {0}</h1><div class=intro>What this series of articles is about and who writes it</div><p>The part {0} has its own words.</p></article>"
    assert all("What this series" in t and "its own words" in t for t in texts(spark, [intro.format(i) for i in range(8)]))
    plain = "<div><h1>Headline {0}</h1></div><div>One body of text on all pages, longer than any label could be</div>"
    assert texts(spark, [plain.format(i) for i in range(8)]) == [f"Headline {i}\nOne body of text on all pages, longer than any label could be" for i in range(8)]


def test_the_style_decides_where_neither_words_nor_names_repeat(spark, monkeypatch):
    """Menus and adverts of other words on every page, in elements whose names tell nothing."""
    import re

    monkeypatch.setattr(html, "BOILERPLATE", re.compile("(?!)"))
    page = "<div class=k1><ul><li><a href=/{0}>Go {0}</a></li><li><a href=/x{0}>See {0}</a></li></ul></div><div class=k2>Buy {0} now</div><article><h1>Head {0}</h1><p>Story {0} is a long one, and it goes on and on until it ends at last.</p></article><div class=k3>(c) {0}</div>"
    want = [f"Head {i}\nStory {i} is a long one, and it goes on and on until it ends at last." for i in range(8)]
    pages = [page.format(i) for i in range(8)]
    assert html.main_text(pages[0], {}).startswith("Go 0")
    assert texts(spark, pages) == want
    df = spark.createDataFrame([(i, f"http://h{i}.example.org/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    assert [r.text for r in html.extract(df).orderBy("page_id").collect()] == want  # one page a host: the weights over all hosts
    links = "<div class=k4>" + "".join(f"<p><a href=/{k}>Topic {k} of {{0}}</a></p>" for k in range(4)) + "</div><div class=k5>Words of {0} that stand alone on a page without any article</div>"
    assert all(t.startswith("Words of") for t in texts(spark, [links.format(i) for i in range(8)]))
