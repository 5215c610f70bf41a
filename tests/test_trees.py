"""Document trees against a recursive parser, and structured chunks against a plain fold."""

import random
import re
import xml.etree.ElementTree as ET

import pytest

from longview.operators import structured, trees

ARTICLE = """<?xml version="1.0"?><!DOCTYPE article><article><front><contrib-group>
<contrib><name><surname>Ng</surname><given-names>Ana</given-names></name><xref ref-type="aff" rid="a1"/><xref ref-type="aff" rid="a9"/></contrib>
<contrib><name><surname>Öz</surname></name><xref ref-type="aff" rid="a1 a2"/></contrib><contrib><collab>Group</collab></contrib></contrib-group>
<aff id="a1">One</aff><aff id="a2">Two</aff><abstract><p>Short &amp; <italic>sweet</italic> abstract.</p></abstract></front><body>
<p>Intro in the body.</p>
<sec id="s1"><label>1</label><title>Methods <b>here</b></title><p>First. Second one.</p>
  <sec id="s2"><title>Inner</title><p>Deep text, see <xref rid="t1">Table</xref> and <xref rid="gone">none</xref>.</p>
    <table-wrap id="t1"><label>Table 1</label><caption><title>Ages</title><p>by group</p></caption><table><thead><tr><th>a</th><th></th><th>b</th></tr></thead><tr><td>1</td><td>2 <i>x</i></td></tr><tr/></table></table-wrap></sec>
  <list><list-item><p>one</p></list-item><list-item>two<list><list-item>three</list-item></list></list-item></list>
  <fig><label>2</label><caption><title>A plot</title></caption></fig><def-list><def-item><term>BP</term><def><p>pressure</p></def></def-item></def-list></sec>
<sec id="s3"><title>Funding</title><p>Money.</p><sec><title>Sub</title><p>More money.</p></sec></sec></body>
<back><sec><title>Data availability</title><p>On request.</p></sec><sec><title>Other</title><p>Skipped.</p></sec><sec><p>Untitled stays.</p></sec></back></article>"""


def text(el):
    return re.sub(r"\s+", " ", " ".join(el.itertext())).strip()


def plain_sections(root):
    out = []

    def walk(el, chain, region):
        for c in el:
            here = region or trees.REGIONS.get(c.tag)
            if c.tag == "sec":
                title = next((text(x) for x in c if x.tag == "title"), "")
                out.append((len(out) + 1, len(chain) + 1, chain[-1][0] if chain else None, c.get("id"), next((text(x) for x in c if x.tag == "label"), ""), title, " > ".join([t for _, t in chain] + [title]), here))
                walk(c, [*chain, (len(out), title)], here)
            else:
                walk(c, chain, here)

    walk(root, [], None)
    return out


def article(rng):
    """A random well-formed article."""
    def sec(depth):
        parts = [f"<title>{rng.choice(['Methods', 'Results', 'Funding', 'T' + str(rng.random())])}</title>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(0, 4)):
            parts.append(sec(depth + 1) if rng.random() < 0.4 and depth < 4 else f"<p>{' '.join(rng.choice(['Alpha.', 'beta', 'Gamma!']) for _ in range(rng.randint(0, 30)))}<i>x</i></p>")
        return f"<sec id='s{rng.random()}'>{''.join(parts)}</sec>"

    return "<article>" + "".join(f"<{r}>{''.join(sec(1) for _ in range(rng.randint(0, 4)))}</{r}>" for r in ("body", "back")) + "</article>"


@pytest.fixture(scope="module")
def tree(spark):
    rng = random.Random(6)
    pages = [(1, ARTICLE)] + [(10 + i, article(rng)) for i in range(12)] + [(90, None), (91, ""), (92, "just text")]
    return trees.nodes(spark.createDataFrame(pages, "page_id long, html string")), dict(pages)


def test_labels_equal_a_recursive_parser():
    """Every element's ancestors and text are those of a parser of well-formed markup."""
    rng = random.Random(7)
    for markup in [ARTICLE, *(article(rng) for _ in range(20))]:
        root = ET.fromstring(re.sub(r"<!DOCTYPE[^>]*>", "", markup))
        want, rows = [], trees.label_page(markup)

        def walk(el, chain, want=want):
            want.append((el.tag, tuple(chain), text(el)))
            for c in el:
                walk(c, [*chain, el.tag], want)

        walk(root, [])
        got = []
        for s, e, depth, _, tag, _, _ in rows:
            if tag != "#text":
                chain = [t for a, b, _, _, t, _, _ in rows if a < s and e <= b and t != "#text"]
                got.append((tag, tuple(chain), re.sub(r"\s+", " ", " ".join(t for a, b, _, _, k, _, t in rows if k == "#text" and s < a and b <= e)).strip()))
                assert depth == len(chain)
        assert got == want


@pytest.mark.parametrize("markup,want", [
    ("<ul><li>a<li>b</ul>c", [("ul", 0), ("li", 1), ("#text", 2), ("li", 1), ("#text", 2), ("#text", 0)]),
    ("<p>a<p>b", [("p", 0), ("#text", 1), ("p", 0), ("#text", 1)]),
    ("<b>x<i>y</b>z</i>w", [("b", 0), ("#text", 1), ("i", 1), ("#text", 2), ("#text", 0), ("#text", 0)]),
    ("a</div>b<br>c<hr/>d", [("#text", 0), ("#text", 0), ("br", 0), ("#text", 0), ("hr", 0), ("#text", 0)]),
    ("<script>if (a<b) '</p>'</SCRIPT><!-- <p> --><p title=\"a>b\" x=1 x=2>1 < 2", [("script", 0), ("p", 0), ("#text", 1), ("#text", 1), ("#text", 1)]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", [("table", 0), ("tr", 1), ("td", 2), ("#text", 3), ("td", 2), ("#text", 3), ("tr", 1), ("td", 2), ("#text", 3)]),
    ("<div><p>a</div>b", [("div", 0), ("p", 1), ("#text", 2), ("#text", 0)]),
    ("<![CDATA[<p>]]>&lt;", [("#text", 0), ("#text", 0)]),
])
def test_markup_that_is_not_well_formed(markup, want):
    rows = trees.label_page(markup)
    assert [(r[4], r[2]) for r in rows] == want
    for s, e, *_ in rows:  # intervals lie in one another or apart
        assert s <= e and all(b < s or a > e or (a <= s and e <= b) or (s <= a and b <= e) for a, b, *_ in rows)


def test_sections(tree):
    rows, pages = tree
    got = trees.sections(rows).select("page", "order", "depth", "parent_order", "section_id", "label", "title", "path", "region").collect()
    for page, markup in pages.items():
        want = plain_sections(ET.fromstring(re.sub(r"<!DOCTYPE[^>]*>", "", markup))) if markup and "<article" in markup else []
        assert sorted(tuple(r)[1:] for r in got if r["page"] == page) == want


def test_rendered_parts(tree):
    rows, _ = tree
    one = lambda df: [r["rendered"] for r in df.filter("page = 1").orderBy("start").collect()]
    assert one(trees.tables(rows)) == ["Caption: Ages by group Rows: a | b / 1 | 2 x"]
    assert one(trees.lists(rows)) == ["one two three three", "three", "BP: pressure"]
    assert one(trees.figures(rows)) == ["Fig. 2: A plot"]
    who = sorted(tuple(r)[1:] for r in trees.authors(rows).collect())
    assert sorted(who, key=str) == sorted([(1, "Ng", "Ana", "a1", True), (1, "Ng", "Ana", "a9", False), (2, "Öz", None, "a1", True), (2, "Öz", None, "a2", True), (3, None, None, None, None)], key=str)
    assert [tuple(r) for r in trees.dangling(rows).orderBy("target").collect()] == [(1, "a9", 1), (1, "gone", 1)]


def plain_elements(root):
    out = []

    def walk(el, region, secs):
        for c in el:
            if c.tag == "sec":
                secs[0] += 1
                own, title = secs[0], next((text(x) for x in c if x.tag == "title"), "")
                if re.search(structured.LEFT_OUT, title) or (region == "BACK" and title and not re.search(structured.TAKEN, title)):
                    secs[0] += len(list(c.iter("sec"))) - 1
                else:
                    walk_in(c, region, own, secs)
            elif c.tag == "p" and text(c):
                out.append((region, None, "P", text(c)))

    def walk_in(el, region, own, secs):
        for c in el:
            if c.tag == "p" and text(c):
                out.append((region, own, "P", text(c)))
            elif c.tag == "sec":
                holder = ET.Element("x")
                holder.append(c)
                walk(holder, region, secs)

    secs = [0]
    for c in root:
        walk(c, trees.REGIONS[c.tag], secs)
    return out


def test_elements_and_chunks(spark, tree, monkeypatch):
    rows, pages = tree
    found = structured.elements(rows, structured.Layout())
    got = found.orderBy("page", "element").collect()
    for page, markup in pages.items():
        if page >= 10 and markup and "<article" in markup:
            assert [(r["region"], r["section"], r["type"], r["text"]) for r in got if r["page"] == page] == plain_elements(ET.fromstring(markup))
    first = [(r["region"], r["section"], r["type"], r["text"]) for r in got if r["page"] == 1]
    assert first == [
        ("ABSTRACT", None, "P", "Short & sweet abstract."), ("BODY", None, "P", "Intro in the body."), ("BODY", 1, "P", "First. Second one."),
        ("BODY", 2, "P", "Deep text, see Table and none ."), ("BODY", 2, "TABLE", "Caption: Ages by group Rows: a | b / 1 | 2 x"), ("BODY", 1, "LIST", "one two three three"),
        ("BODY", 1, "FIGURE_CAPTION", "Fig. 2: A plot"), ("BODY", 1, "LIST", "BP: pressure"), ("BACK", 5, "P", "On request."), ("BACK", 7, "P", "Untitled stays."),
    ]
    made = structured.chunks(found)
    names = [r["chunk_id"] for r in made.filter("page = 1").orderBy("chunk").collect()]
    assert names[0] == "1__ABSTRACT__000__PROSE__00000" and names[4] == "1__BODY__002__TABLE__00004" and len(names) == 10
    for r in structured.coverage(found, made).collect():
        assert r["elements"] == r["covered"] and r["dropped"] == r["falls"] == 0
    cut = structured.coverage(found, made.filter("chunk <> 1")).filter("page = 1").first()
    assert (cut["dropped"], cut["covered"]) == (1, 9)


def test_fold():
    words = lambda n, end=".": " ".join(["Word"] * (n - 1) + ["end" + end])
    rows = [(0, "BODY", 1, "P", words(100)), (1, "BODY", 1, "P", words(120)), (2, "BODY", 1, "P", words(1)), (3, "BODY", 2, "P", words(5)), (4, "BODY", 2, "TABLE", "t"), (5, "BODY", 2, "P", " ".join([words(140)] * 4)), (6, "BODY", 2, "P", words(301))]
    got = structured.fold(rows)
    assert [(k, s, len(t.split()), a, b, n, split, un) for k, _, s, t, a, b, n, split, un in got] == [
        ("PROSE", 1, 220, 0, 1, 2, False, False), ("PROSE", 1, 1, 2, 2, 1, False, False), ("PROSE", 2, 5, 3, 3, 1, False, False), ("TABLE", 2, 1, 4, 4, 1, False, False),
        ("PROSE", 2, 280, 5, 5, 1, True, False), ("PROSE", 2, 280, 5, 5, 1, True, False), ("PROSE", 2, 280, 5, 5, 1, True, False), ("PROSE", 2, 301, 6, 6, 1, False, True),
    ]


def test_queries_over_pages_equal_another_parser(spark, sf):
    """The page queries against the standard library's parser, which knows nothing of intervals."""
    from html.parser import HTMLParser

    from longview.plans import pages as plans

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.links, self.items, self.lists, self.skip, self.inside, self.article = [], 0, [], [], 0, [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")
            self.links += tag == "a"
            if tag == "ul":
                self.lists.append([])
            self.inside.append(tag)
            self.article += tag == "article"

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style")
            self.article -= tag == "article"
            while tag in self.inside and self.inside.pop() != tag:
                pass

        def handle_data(self, data):
            if not self.skip and self.article:
                self.words += data.split()
            if not self.skip and "li" in self.inside and data.strip():
                self.lists[-1].append(data.strip())

    read = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        read[r["page_id"]] = Reader()
        read[r["page_id"]].feed(r["html"])
    got = {r["page_id"]: r["words"] for r in plans.j11_sections(spark, sf).filter("region = 'BODY'").collect()}
    assert got == {k: len(v.words) for k, v in read.items()} and sum(got.values()) > 1000
    lists = {(r["page_id"], r["list"]): r["rendered"] for r in plans.b38_lists(spark, sf).collect()}
    assert lists == {(k, i + 1): " ".join(" ".join(x).split()) for k, v in read.items() for i, x in enumerate(v.lists)}
    audit = plans.d25_chunks(spark, sf).collect()
    assert audit and all(r["dropped"] == 0 and r["falls"] == 0 and r["covered"] == r["elements"] for r in audit)
