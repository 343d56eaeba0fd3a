import random
import re
from collections import Counter, defaultdict

import pytest

from strataloom.llm import wrappers


def tree(page):
    shapes = wrappers.Shapes()
    return wrappers.Tree(wrappers.skeleton(wrappers.parse(page)), shapes), shapes


def best(a, b, labels, x=0, y=0):
    """Simple tree matching by its definition."""
    if labels[0][x] != labels[1][y]:
        return 0
    xs, ys = a.children[x], b.children[y]
    m = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, u in enumerate(xs):
        for j, v in enumerate(ys):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + best(a, b, labels, u, v))
    return 1 + m[-1][-1]


@pytest.mark.parametrize("cells", [1 << 20, 4])
def test_matching_is_the_largest(monkeypatch, cells):
    monkeypatch.setattr(wrappers, "CELLS", cells)
    rng = random.Random(3)

    def grow(depth):
        return "".join(f"<{t}{c}>{grow(depth - 1) if depth else 'x'}</{t}>" for t, c in ((rng.choice(("div", "section")), rng.choice(("", " class=a"))) for _ in range(rng.randint(0, 4))))

    shapes = wrappers.Shapes()
    for _ in range(60):
        texts = [wrappers.skeleton(wrappers.parse(grow(3))) for _ in range(2)]
        a, b = (wrappers.Tree(t, shapes) for t in texts)
        labels = [[line.split(" ", 1)[1] for line in t.split("\n")] for t in texts]
        found = wrappers.match(a, b, shapes)
        assert len(found) == best(a, b, labels)
        assert len(set(found.values())) == len(found) and all(labels[0][x] == labels[1][y] for x, y in found.items())
        assert all(x == 0 or found[a.parent[x]] == b.parent[y] for x, y in found.items())
        order = sorted(found)
        assert all(found[x] < found[y] for x, y in zip(order, order[1:]))


def test_equal_labels_are_not_paired_by_place():
    a, shapes = tree("<body><div><ul><li>1</ul></div><div><p>2</div><div><table><tr><td>3</table></div>")
    b = wrappers.Tree(wrappers.skeleton(wrappers.parse("<body><div>new</div><div><ul><li>1</ul></div><div><p>2</div><div><table><tr><td>3</table></div>")), shapes)
    found = wrappers.match(a, b, shapes)
    assert sorted(found) == list(range(len(a.tag)))
    assert [b.tag[found[i]] for i in range(len(a.tag))] == a.tag


WORDS = [a + b + c for a in "bdfgklm" for b in "aeiou" for c in "nrst"]


def plain_pages(n, seed=1):
    """Pages without an article element, telling names or lists: only what varies, and where, tells the text."""
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    out = []
    for i in range(n):
        head, body = say(4), [say(rng.randint(20, 60)) for _ in range(rng.randint(1, 6))]
        box = f"<div><div>Buy {say(5)} now</div></div>" if rng.random() < 0.5 else ""
        links = "".join(f"<div><a href=/{k}>{say(2)}</a></div>" for k in range(rng.randint(3, 9)))
        page = f"<html><body><div><b>The Daily</b></div><div>{links}</div>{box}<div><h1>{head}</h1><div><div>Share this story</div>" + "".join(f"<p>{x}</p>" for x in body)
        page += f"</div></div><div><div>{say(3)}</div><div>All rights reserved</div></div></body></html>"
        out.append((i, f"http://plain.example/{i}", page, "\n\n".join([head, *body])))
    return out


def induced(pages, refs_from):
    """The wrapper and texts in plain Python, the statistics by brute force."""
    read = [wrappers.read_page(p) for p in pages]
    ref = [{"k": 1, "key": wrappers._structure(read[refs_from][0]), "skeleton": read[refs_from][0]}]
    aligner, held = wrappers.Aligner(), defaultdict(list)
    for shape, found in read:
        _, at = aligner.align(shape, 0, ref)
        for text, owner, link, veto, _ in found:
            held[at[owner]].append((text, 0 if veto else len(text) * (100 - link) // 100))
    slots = []
    for at, xs in held.items():
        h, n = Counter(t for t, _ in xs).most_common(1)[0]
        slots.append({"at": at, "pages": len(xs), "top": n, "h": h, "mass": sum(m for _, m in xs)})
    region, fixed = wrappers.induce(ref[0]["skeleton"], slots)
    refs = [ref[0] | {"region": region, "fixed": fixed}]
    out = []
    for shape, found in read:
        rows = [{"text": t, "at": a, "h": t, "veto": v, "ok": ok} for t, a, _, v, ok in found]
        out.append("\n\n".join(x["text"] for x, keep in zip(rows, wrappers.content(aligner, shape, 0, rows, refs)) if keep))
    return out


def test_induction_alone_finds_the_text(monkeypatch):
    """No list of elements, classes or roles; the wrapper is all there is."""
    monkeypatch.setattr(wrappers, "DROP", wrappers.RAW)
    monkeypatch.setattr(wrappers, "ROLE", re.compile("(?!)"))
    monkeypatch.setattr(wrappers, "ROLES_ATTR", set())
    pages = plain_pages(30)
    assert induced([p for _, _, p, _ in pages], 0) == [t for *_, t in pages]


def test_induction_carries_the_result(spark):
    pages = plain_pages(40)
    schema = "page_id long, url string, html string, host string, h string, blocks string, refs string"
    rows = [(i, u, p, "x", "y", "z", "r") for i, u, p, _ in pages] + [(None, None, None, None, None, None, None)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, schema)).collect()}
    assert [got[i] for i, *_ in pages] == [t for *_, t in pages] and got[None] == ""
    alone = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame([(i, f"http://h{i}.example/", p) for i, _, p, _ in pages], "page_id long, url string, html string")).collect()}
    assert all(alone[i] != got[i] for i, *_ in pages)  # one page a host: nothing to induce from


def test_long_deep_and_broad_pages(spark):
    rng = random.Random(5)
    say = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    pages, want = [], {}
    for i in range(6):  # each over 128 KiB, 260 levels deep, of over a thousand blocks
        body = [say(rng.randint(20, 30)) for _ in range(1400 + 10 * i)]
        html = "<body>" + "<div>" * 250 + "<div>The same head</div><div>" + "".join(f"<p>{x}" for x in body) + "</div>" + "</div>" * 250 + f"<div>Note {say(3)}</div>"
        assert len(html) > 1 << 17
        pages.append((i, "http://deep.example/x", html))
        want[i] = "\n\n".join(body)
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == want


def test_kinds_of_pages_have_their_references(spark):
    rng = random.Random(7)
    say = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    pages, want = [], {}
    for i in range(60):
        text = say(60)
        if i % 3:
            html = f"<body><div><p>Site name</p></div><section><p>{text}</p><p>Terms of sale</p></section><div>{say(4)}</div>"
        else:
            html = f"<body><div><p>Site name</p></div><table><tr><td>Price list</td></tr></table><section><div><p>{text}</p></div><div><ul><li>In stock</ul></div></section>"
        pages.append((i, "http://shop.example/x", html))
        want[i] = text
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == want


def test_headings_that_texts_share_stay(spark):
    rng = random.Random(11)
    say = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    pages = [(i, "http://cook.example/x", f"<body><div>Cooking</div><div><p>{say(30)}</p><h2>Method</h2><p>{say(30)}</p><p>Rate us</p></div>") for i in range(9)]
    got = wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all(re.fullmatch(r"[a-z ]+\n\nMethod\n\n[a-z ]+", r["text"]) for r in got)


def probes(spark, body, n=10):
    """Texts of pages with a menu and a footer around what ``body`` makes, and what it says is the article."""
    rng = random.Random(13)
    say = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    pages, want = [], {}
    for i in range(n):
        html, want[i] = body(say, rng)
        pages.append((i, "http://probe.example/x", f"<body><div><a href=/>Home</a> <a href=/t>Topics</a></div>{html}<div>All rights kept by us</div></body>"))
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    return got, want


@pytest.mark.parametrize("form", ["<article><section><p>{}</p></section><section><p>{}</p></section></article>", "<article><div><p>{}</p></div><div><p>{}</p></div></article>", "<div><div>{}</div><div>{}</div></div>"])
def test_parts_of_an_article_stay(spark, form):
    def body(say, rng):
        a, b = say(60), say(40)
        return form.format(a, b), f"{a}\n\n{b}"

    got, want = probes(spark, body)
    assert got == want


@pytest.mark.parametrize("count", [(4, 4), (2, 7)])
def test_a_thread_is_not_the_story(spark, count):
    def body(say, rng):
        story = say(20)
        thread = "".join(f"<div><div>{say(2)}</div><p>{say(18)}</p></div>" for _ in range(rng.randint(*count)))
        return f"<div><p>{story}</p></div><div>{thread}</div>", story

    got, want = probes(spark, body)
    assert got == want


def test_every_structure_has_a_reference(spark):
    """Seven structures of one host, more than serve all of its pages, each with template text of its own."""

    def body(say, rng):
        k, text = rng.randrange(7), say(50)
        wraps = ["section", "main", "div", "center", "details", "article", "dl"]
        return f"<{wraps[k]}><div><div>Own note {k}</div><div><p>{text}</p></div></div></{wraps[k]}>" + f"<table><tr><td>Table {k}</td></tr></table>" * k, text

    got, want = probes(spark, body, 140)
    assert got == want
