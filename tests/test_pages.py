from __future__ import annotations

import pytest

from partloom.sources import pages, responses
from partloom.sources.markup import Selector, parse

LISTING = """
<div class="panel"><div class="panel-header"><h4>Radiator</h4></div>
<div class="row app"><h4><a href="/items/3951">3951</a> - Radiator</h4>
<table class="table table-borderless"><tbody><tr><td>Eng. Base: <b>1.5L L4 1497cc</b></td><td>Size: 4</td><td>Size: 5</td></tr></tbody></table>
<ul class="no-padding"><li>Upgraded</li></ul></div>
<div class="row app"><h4>broken</h4></div></div>
<div class="row app"><h4><a>CSF-7</a></h4></div>
"""


def _pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "id int, html string")


def test_listing_blocks(spark):
    got = {r.sku: r for r in pages.extract_application_parts(_pages(spark, LISTING), ["id"]).collect()}
    assert set(got) == {"CSF-3951", "CSF-7"}
    first = got["CSF-3951"]
    assert (first.name, first.category, first.page_pos) == ("3951- Radiator", "Radiator", 0)
    assert first.specifications == {"Size": "5"} and first.engine == "1.5L L4 1497cc"
    assert got["CSF-7"].category == "Unknown" and got["CSF-7"].page_pos == 2


def test_listing_joined_with_space(spark):
    row = pages.extract_application_parts(_pages(spark, LISTING), ["id"], join_with_space=True).where("sku = 'CSF-3951'").first()
    assert row.name == "Radiator"
    assert row.specifications == {"Eng. Base": "1.5L L4 1497cc", "Size": "5"}


def test_empty_and_null_pages(spark):
    assert pages.extract_application_parts(_pages(spark, "", None, "<p>nothing"), ["id"]).count() == 0


DETAIL = """
<div class="col-6"><h5>1 Row</h5><p>Radiator</p>Aluminum core; made to fit; great!<ul><li>One</li><li> </li></ul></div>
<table><tr><td>Core (in):</td><th>7/8</th></tr><tr><td>Box:32 1/4</td></tr>
<tr><td>x</td><td>Hose:</td><th>13/16</th><td>y</td><td>Core (in):</td><th>late</th></tr><tr><td>Tech Note</td><td>OEM style</td></tr></table>
<table><tr><th>Make</th><th>Model</th></tr><tr><td>Honda</td><td>Civic</td></tr></table>
<table><tr><th>Reference Number</th><th>Reference Name</th></tr><tr><td>30048</td><td>OEM</td></tr><tr><td></td><td>DPI</td></tr></table>
<img src="https://images.example.com/catalog196/large/a.jpg" alt="A"><img src="https://images.example.com/catalog196/small/b.jpg">
<img src="https://images.example.com/catalog196/large/c.jpg">
"""


def test_detail_page(spark):
    row = pages.extract_details(_pages(spark, DETAIL), ["id"], host="images.example.com").first()
    assert pages.extract_details(_pages(spark, DETAIL), ["id"], host="elsewhere.example").first().additional_images == []
    assert row.specifications == {"Core (in)": "7/8", "Box": "32 1/4", "Hose": "13/16", "Tech Note": "OEM style"}
    assert row.tech_notes == "OEM style"
    assert [tuple(r) for r in row.interchange_data] == [("30048", "OEM")]
    assert [(i.url[-5:], i.is_primary) for i in row.additional_images] == [("a.jpg", True), ("c.jpg", False)]
    assert row.full_description == (
        "<h5>1 Row</h5>\n<p><strong>Radiator</strong></p>\n<p>Aluminum core. made to fit. great!</p>\n<ul><li>One</li></ul>"
    )


def test_detail_page_without_anything(spark):
    row = pages.extract_details(_pages(spark, "<p>x</p>"), ["id"]).first()
    assert (row.specifications, row.full_description, row.interchange_data, row.additional_images) == ({}, None, [], [])


@pytest.mark.parametrize(
    ("css", "wanted"),
    [("li", ["a", "b", "c"]), ("ul.x li", ["a", "b"]), ("#z", ["c"]), ("ol li", ["c"]), ("*[href]", ["b"]), ("div li", [])],
)
def test_selectors_on_unclosed_markup(css, wanted):
    root = parse('<ul class="x y"><li>a<li><a href="/q">b</a></ul><ol><li id=z>c</ol><script>var t="<li>no</li>"</script>')
    assert [e.text() for e in Selector(css).all(root)] == wanted


def test_selector_rejects_what_it_does_not_know():
    with pytest.raises(ValueError):
        Selector("a > b")


def test_deep_pages_do_not_fail_the_others(spark):
    deep, broken = "<b>" * 100_000 + LISTING, "<![part[" + LISTING
    frame = _pages(spark, LISTING, deep, broken, None)
    got = pages.extract_application_parts(frame, ["id"])
    assert sorted((r.id, r.sku) for r in got.collect()) == [(0, "CSF-3951"), (0, "CSF-7"), (1, "CSF-3951"), (1, "CSF-7")]
    failed = pages.page_failures(frame, ["id"]).collect()
    assert [(r.id, r.page_pos) for r in failed] == [(2, None)] and "marked section" in failed[0].error


def test_detail_pages_that_cannot_be_read_are_listed(spark):
    frame = _pages(spark, DETAIL, "<i>" * 100_000 + DETAIL, "<![part[" + DETAIL, None)
    got = {r.id: r for r in pages.extract_details_or_errors(frame, ["id"]).collect()}
    assert got[1][1:] == got[0][1:] and got[0].specifications and got[0].error is None
    assert "marked section" in got[2].error and not got[2].specifications
    assert got[3].error is None
    assert [r.id for r in pages.detail_failures(frame, ["id"]).collect()] == [2]
    assert pages.extract_details(frame, ["id"]).columns == pages.extract_details_or_errors(frame, ["id"]).columns[:-1]


@pytest.mark.parametrize(
    "html",
    ["<b>" * 170_000 + "</i>" * 120_000, "<b><i>" * 80_000 + "</b></u>" * 60_000, "<p><li>" * 150_000, "<tr><td>" * 120_000,
     "<div>" * 100_000 + "<div class='row app'><h4>x</h4></div>" * 10_000],
)
def test_a_page_of_tags_is_read_in_linear_time(html):
    from time import process_time

    from partloom.sources.structure import listing_reader

    start = process_time()
    listing_reader("")(parse(html))
    # About a second on an idle core; a quadratic reader needs minutes.
    assert process_time() - start < 15


def _plain_tree(html):
    """The same repairs, found by going up from the innermost open element."""
    from html.parser import HTMLParser

    from partloom.sources.markup import ENDS_PARAGRAPH, IMPLIED_END, VOID

    done, open_ = [], []

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            tags, stop = IMPLIED_END.get(tag, (("p",), ("table", "td", "th", "div", "li")) if tag in ENDS_PARAGRAPH else ((), ()))
            cut = None
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] in stop:
                    break
                if open_[i][0] in tags:
                    cut = i
            if cut is not None:
                del open_[cut:]
            done.append((tag, [k for _, k in open_]))
            if tag not in VOID:
                open_.append((tag, len(done)))

        def handle_endtag(self, tag):
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == tag:
                    del open_[i:]
                    break

    reader = Reader()
    reader.feed(html)
    reader.close()
    return done


def test_repairs_and_searches_equal_a_plain_reading():
    import random

    draw = random.Random(5)
    names = "p li ul ol tr td th table tbody div b i br select option h4".split()
    for _ in range(300):
        html = "".join(f"<{draw.choice(['', '', '/'])}{draw.choice(names)}>" for _ in range(60))
        root, plain = parse(html), _plain_tree(html)
        made = root.page.elements[1:]

        def above(e):
            return [] if e.parent is root else [*above(e.parent), e.parent.at]

        assert [(e.tag, above(e)) for e in made] == plain
        below = {e.at: [d for d in made if e.at in above(d)] for e in made}
        assert all(e.find("td", "b") == [d for d in below[e.at] if d.tag in ("td", "b")] for e in made)
        tags = {i + 1: tag for i, (tag, _) in enumerate(plain)}

        def under(e, first, second):
            chain = [tags[k] for k in above(e)]
            return second in chain and first in chain[: len(chain) - 1 - chain[::-1].index(second)]

        assert Selector("table tr td").all(root) == [e for e in made if e.tag == "td" and under(e, "table", "tr")]


def test_a_bad_block_leaves_the_others(monkeypatch):
    from partloom.sources import structure
    from partloom.sources.markup import Element

    whole = Element.ancestor

    def fails(self, tag, css):
        if "broken" in self.text():
            raise RuntimeError("no")
        return whole(self, tag, css)

    monkeypatch.setattr(Element, "ancestor", fails)
    blocks = structure.listing_reader("")(parse(LISTING))["blocks"]
    assert [b.get("sku") for b in blocks] == ["3951", None, "CSF-7"] and blocks[1]["error"] == "RuntimeError: no"


def _built(spark, frame, on_invalid):
    from partloom import schemas as sc
    from partloom.plans.build import build_catalog

    crawled = frame.withColumnRenamed("id", "application_id")
    applications = crawled.selectExpr("application_id", "application_id AS app_pos", "'Honda' AS make", "'Civic' AS model", "'2020' AS year")
    details = spark.createDataFrame([("CSF-3951", None, None, None, None, None, "E: broken")], "sku string, full_description string, specifications map<string,string>, tech_notes string, "
        "interchange_data array<struct<reference_number:string,reference_type:string>>, additional_images array<struct<url:string,alt_text:string,is_primary:boolean>>, error string")
    previous = spark.createDataFrame([], sc.EXPORT_PART)
    built = build_catalog(crawled, applications, details, previous, current_year=2026, on_invalid=on_invalid)
    failed = [(r.identifier, r.error_type, r.error_message) for r in built.failures.orderBy("identifier").collect()]
    return sorted(r.sku for r in built.parts.collect()), failed


def test_build_lists_pages_and_blocks_that_cannot_be_read(spark, monkeypatch):
    other = LISTING.replace("3951", "41").replace("CSF-7", "CSF-8")
    deep = "<b>" * 5000 + LISTING.replace("3951", "42").replace("CSF-7", "CSF-9")
    whole = pages.listing_reader

    def reader(glue):
        def read(root):
            if "fail" in root.text():
                raise RuntimeError("page")
            found = whole(glue)(root)
            return {"blocks": [{"error": "RuntimeError: block"} if b.get("sku") == "bad" else b for b in found["blocks"]]}

        return read

    monkeypatch.setattr(pages, "listing_reader", reader)
    frame = _pages(spark, LISTING, other + '<div class="row app"><h4><a>bad</a></h4></div>', deep, "fail" + LISTING, None)
    failed = [("1", "unreadable page", "RuntimeError: block"), ("3", "unreadable page", "RuntimeError: page"),
              ("CSF-3951", "unreadable page", "E: broken")]
    assert _built(spark, frame, "fail_page") == (["CSF-3951", "CSF-42", "CSF-7", "CSF-9"], failed)
    assert _built(spark, frame, "drop_row") == (["CSF-3951", "CSF-41", "CSF-42", "CSF-7", "CSF-8", "CSF-9"], failed)


def test_large_pages_are_handed_on_in_slices(spark, monkeypatch):
    monkeypatch.setattr(pages, "SLICE_CHARS", 10)
    assert pages.select_text(_pages(spark, *["<p>x</p>"] * 7, None), "p", ["id"]).where("text = 'x'").count() == 7


def test_entities_comments_and_cells():
    root = parse("<table><tr><td>a &amp; b<td>c<tr><td><!-- x -->d</table>")
    assert [[c.text() for c in r.find("td")] for r in root.find("tr")] == [["a & b", "c"], ["d"]]


def test_references_need_their_semicolon():
    root = parse('<p>a &amp b &lt; c &#38; d&copy</p><a href="?x=1&copy=2&amp;y=3">l</a>')
    assert root.find("p")[0].text() == "a &amp b < c & d&copy"
    assert root.find("a")[0].attrs["href"] == "?x=1&copy=2&y=3"


def test_dropdown_options(spark):
    js = '$("#x").text("y")\n$("#btnYear").next().html("<ul><li><a data-remote=\\"true\\" href=\\"remote:/get_model_by_make_year/192\\">2025</a></li>'
    js += '<li><a href=\\"/get_model_by_make_year\\/all\\">all</a></li><li><a href=\\"/other/5\\">no</a></li></ul>")'
    frame = spark.createDataFrame([(3, js), (4, "no call")], "make_id int, js string")
    assert [tuple(r) for r in responses.options(frame, "make_id", "get_model_by_make_year").collect()] == [(3, 192, "2025")]


def test_makes_fall_back_to_the_fixed_list(spark):
    assert responses.discovered_makes(spark.createDataFrame([("<p>none</p>",)], "html string")).count() == 51


def test_split_renderable(spark):
    ready, waiting = pages.split_renderable(_pages(spark, '<div class="row app">', "<p>", None))
    assert (ready.count(), waiting.count()) == (1, 2)
    ready, _ = pages.split_renderable(_pages(spark, "<i class=selling-part>"), detail=True)
    assert ready.count() == 1


def _tree(root):
    return [(e.tag, e.attrs, e.until, e.parent and e.parent.at, [c if isinstance(c, str) else c.at for c in e.children]) for e in root.page.elements]


def test_plain_pages_are_read_without_the_tokenizer(monkeypatch):
    """Pages that are plain throughout pass it by; what both read is the same tree, and any other page is left to it."""
    from partloom.sources import markup

    plain = [
        '<!DOCTYPE html><html><!-- a > b --><P class="x y" CLASS=\'z\' hidden>a &amp; b<br/>c<table><tr><td>1<td>2<tr><th id="q&lt;">3</table></p>d',
        '<script type="t">if (a < b) "</p>"</SCRIPT >x<style>p{}</style><ul><li>a<li>b</ul></b>',
        "no markup", "<i>" * 50 + "deep", "a<b>x</b>&copy; y & z",
    ]
    other = ["a < b", "<a href=u>x", "<p", "<a b = 'c'>d", "<script>open", "</ b>x", "<?pi?><b>", '<a b="1"c="2">x', "<!-- open", "<a b/c>"]
    def standard(html):
        builder = markup._Builder()
        builder.feed(markup._BARE_AMPERSAND.sub("&amp;", html))
        builder.close()
        builder._close_from(0)
        return _tree(builder.root)

    for html in plain + other:
        assert _tree(markup.parse(html)) == standard(html), html
    fed = []
    feed = markup._Builder.feed
    monkeypatch.setattr(markup._Builder, "feed", lambda self, data: (fed.append(data), feed(self, data)))
    for html in plain + other:
        markup.parse(html)
    assert fed == other
