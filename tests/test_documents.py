import io
import zipfile

from pyspark.sql import functions as F
from quarry.functions import markdown, pdf
from quarry.functions import text as T
from quarry.sources import documents, files, office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def archive(**parts):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return buf.getvalue()


def docx():
    p = lambda text, style="", num="": f'<w:p><w:pPr>{f"<w:pStyle w:val=\"{style}\"/>" if style else ""}{num}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    item = lambda text, n, level=0: p(text, num=f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{n}"/></w:numPr>')
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Title &amp; more", "Kop1") + p("Some text.") + item("one", 1) + item("deep", 1, 1) + item("first", 2) + item("second", 2) + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('')}{cell('')}</w:tr></w:tbl>"
    levels = lambda fmt: "".join(f'<w:lvl w:ilvl="{i}"><w:numFmt w:val="{fmt}"/></w:lvl>' for i in range(2))
    numbering = f'<w:numbering {W}><w:abstractNum w:abstractNumId="0">{levels("bullet")}</w:abstractNum><w:abstractNum w:abstractNumId="1">{levels("decimal")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/></w:num></w:numbering>'
    styles = f'<w:styles {W}><w:style w:styleId="Kop1"><w:name w:val="heading 1"/></w:style></w:styles>'
    return archive(**{"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles, "word/numbering.xml": numbering, "word/media/a.PNG": b"img", "word/media/a.wmf": b"no"})


def pptx():
    para = lambda t: f"<a:p><a:r><a:t>{t[:3]}</a:t></a:r><a:r><a:t>{t[3:]}</a:t></a:r></a:p>"
    slide = lambda *ts: f"<p:sld {A}><p:txBody>{''.join(map(para, ts))}</p:txBody><a:tbl><a:tr><a:tc>{para('Name')}</a:tc><a:tc>{para('Year 1')}</a:tc></a:tr></a:tbl></p:sld>"
    rels = lambda *rs: "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{REL}/{k}" Target="{t}"/>' for i, k, t in rs) + "</Relationships>"
    return archive(**{
        "ppt/presentation.xml": f'<p:presentation {A}><p:sldIdLst><p:sldId id="1" r:id="r2"/><p:sldId id="2" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("r1", "slide", "slides/slide1.xml"), ("r2", "slide", "slides/slide2.xml")),
        "ppt/slides/slide1.xml": slide("Second shown", "point"), "ppt/slides/slide2.xml": slide("First shown"),
        "ppt/slides/_rels/slide1.xml.rels": rels(("a", "notesSlide", "../notesSlides/n.xml"), ("b", "image", "../media/i.png")),
        "ppt/notesSlides/n.xml": f"<p:notes {A}><p:txBody>{para('Say this')}</p:txBody></p:notes>", "ppt/media/i.png": b"img",
    })


def epub():
    return archive(**{
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>',
        "OPS/book.opf": '<package><manifest><item id="b" href="two.xhtml"/><item id="a" href="one%20x.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="gone"/></spine></package>',
        "OPS/one x.xhtml": "<html><body><h1>One</h1><p>First.</p></body></html>", "OPS/two.xhtml": "<html><body><p>Second.</p></body></html>",
    })


def test_office_files():
    assert office.docx_markdown(docx()) == "# Title & more\n\nSome text.\n\n- one\n  - deep\n1. first\n2. second\n\na | b"
    assert office.pptx_markdown(pptx()) == "## Slide 1: First shown\nName | Year 1\n\n## Slide 2: Second shown\n- point\nName | Year 1\n\n### Notes\nSay this"
    assert office.pptx_markdown(pptx(), notes=False).endswith("Name | Year 1")
    assert office.epub_markdown(epub()) == "# One\n\nFirst.\n\nSecond." and office.epub_markdown(b"no zip") == ""
    assert [x["archive_path"] for x in office.archive_images(docx(), "docx")] == ["word/media/a.PNG"]
    assert [(x["location"], x["mime_type"]) for x in office.archive_images(pptx(), "pptx")] == [("Slide 2", "image/png")]


def test_dispatch():
    for name, data, want in [
        ("a.HTML", b"<body><h4>T</h4><p>x</p></body>", ("### T\n\nx", None)), ("a.md", b"**b** [t](u)", ("b t", None)), ("a.txt", b"Head\n\nbody text.", ("## Head\n\nbody text.", None)),
        ("a.txt", b"  ", (None, "text.empty")), ("a.docx", b"broken", (None, "docx.error")), ("a.epub", b"broken", (None, "epub.empty")), ("a.png", b"", (None, "image.ocr-disabled")), ("a.pdf", b"", (None, "pdf.missing-client")),
        ("a.rar", b"", (None, "unsupported-extension")), ("a", None, (None, "unsupported-extension")),
    ]:
        assert documents.parse(name, data)[:2] == want
    assert documents.parse("a.png", b"", documents.Readers(enable_ocr=True))[1] == "image.error"
    assert documents.parse("a.png", b"x", documents.Readers(enable_ocr=True, ocr=lambda b: "Seen"))[0] == "## Seen"
    readers = documents.Readers(pdf=(("styled", lambda b: 1 / 0), ("short", lambda b: "x"), ("plain", lambda b: "long enough " * 9)))
    assert documents.parse("a.pdf", b"", readers) == (("long enough " * 9).strip(), None, "styled: division by zero; short: 1 characters")
    assert documents.ocr_scale(1000, 1000) == 2.0 and documents.ocr_scale(5000, 5000) == 1.25 and documents.ocr_scale(10_000, 10_000) is None
    assert documents.ocr_pages(["short"]) == "" and documents.ocr_pages(["", "A line that is long enough to be kept here, surely."]).startswith("## Page 2\n\n")


def test_files_frame(spark):
    rows = [("a.docx", docx(), "d/a.docx", "docx"), ("b.pptx", pptx(), "d/b.pptx", "pptx"), ("c.txt", None, "d/c.txt", "txt"), ("d.docx", b"bad", "d/d.docx", "docx")]
    df = spark.createDataFrame(rows, "file_name string, content binary, path string, extension string")
    got = {r["path"]: r for r in documents.parse_files(df).collect()}
    assert got["d/a.docx"]["text"].startswith("# Title") and got["d/c.txt"]["reason"] == "text.empty" and got["d/d.docx"]["reason"] == "docx.error"
    assert {(r["path"], r["location"]) for r in documents.images(df).collect()} == {("d/a.docx", None), ("d/b.pptx", "Slide 2")}
    assert documents.parse_files(df.limit(0)).count() == 0


def test_markdown_rules(spark):
    md = "# T\r\n\n```\ncode\n```\n> quoted `x` ![alt](u) [l](v)\n***\n* star\n**bold** and *it* and _u_ snake_case_x\n\n| a | b |\n|---|---|\n|1|2|\n<b>t</b>  \n\n\n\nend"
    want = "# T\n\nquoted x alt l\n\n- star\nbold and it and u snake_case_x\n\na | b\n1 | 2\n t\n\nend"
    assert documents.normalise_markdown(md) == want
    df = spark.createDataFrame([(md,)], "t string").select(T.normalise_markdown(F.col("t")).alias("t"))
    assert df.first()["t"] == want


def test_structure():
    assert markdown.infer_structure("1. first item that\nwraps here\n\nA) letter\n2026. no item") == "1. first item that wraps here\n\nA. letter 2026. no item"
    assert markdown.infer_structure("Line one\x0bstill one\nx.") == "## Line one still one\n\nx."
    assert markdown.infer_structure("Not a heading,\nbut text") == "Not a heading, but text"
    assert markdown.linearise_tables("Item | Price\nTea | 3\nName | Kind\nCup | tall") == "Item | Price\nTea — Price: 3\nName | Kind\nCup — Kind: tall"
    assert markdown.linearise_tables("Item | Price | Note\nTea | 3 | ") == "Item | Price | Note\nTea — Price: 3; Note: "
    assert [markdown.numeric_cell(x) for x in ("(1,577)", "-3.5%", "a1", "", "$-3")] == [True, True, False, False, False]


def test_exclude_patterns(spark):
    assert files.exclude_patterns("a.md\n# no\n\n *.txt ") == ["a.md", "*.txt"] and files.exclude_patterns("a;b", ";") == ["a", "b"]
    paths = ["a.md", "aa.md", "x/a.md", "x/y/b.txt", ".hid/c.txt", "drafts/d.html", "x/drafts/d.html"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    hit = lambda *ps: [r["p"] for r in df.where(files.excluded_by(F.col("p"), list(ps)).isNotNull()).collect()]
    assert hit("a.md") == ["a.md", "x/a.md"]
    assert hit("x/*") == ["x/a.md"] and hit("x/**") == ["x/a.md", "x/y/b.txt", "x/drafts/d.html"]
    assert hit("drafts/*.html") == ["drafts/d.html"] and hit("**/drafts/*.{html,md}") == ["drafts/d.html", "x/drafts/d.html"]
    assert hit("?.md") == ["a.md", "x/a.md"] and hit("[bc].txt") == ["x/y/b.txt", ".hid/c.txt"] and hit() == []


def lines(*rows, page=0):
    out = []
    for i, (text, size, bold, y) in enumerate(rows):
        out.append(pdf.Line(page, i, text, size, bold, False, 50, y, 300, y + size))
    return out


def test_pdf_styles():
    body = "some longer words of the body text that go on for quite a while here."
    pages = []
    for p in range(4):
        pages += lines(("My Report 2024", 8, False, 10), ("Chapter " + "one two three four".split()[p], 18, False, 100), (body, 10, False, 140), (body, 10, False, 155), (body, 10, False, 170), (body, 10, False, 185), ("Part", 12, True, 215), (body, 10, False, 240), (body, 10, False, 255), (body, 10, False, 270), (body, 10, False, 285), (body, 10, False, 300), (f"Page {p + 1} of 4", 8, False, 770), page=p)
    heights, widths = dict.fromkeys(range(4), 800.0), dict.fromkeys(range(4), 612.0)
    md = pdf.styled_markdown(pages, heights, widths)
    assert md.count("# Chapter") == 4 and md.startswith("# Chapter one") and md.count("## Part") == 4 and "My Report" not in md and "Page 1" not in md
    assert pdf.styled_markdown([x for x in pages if x.size == 10], heights, widths) is None
    row = [pdf.Line(0, 0, t, 10, False, False, x, 100, x + 40, 110) for t, x in (("Tea", 50), ("3", 200))]
    merged = pdf.merge_rows(row)
    assert len(merged) == 1 and merged[0].text == "Tea 3"
    table = [pdf.Line(0, 0, "", 10, False, False, 50, y, 300, y + 10, cells=cells) for y, cells in ((0, (("Item", 50.0), ("Price", 200.0))), (12, (("Tea", 51.0), ("3", 199.0))), (24, (("1.", 50.0), ("x", 200.0))))]
    assert pdf.table_rows(table, 612) == {0: "Item | Price", 1: "Tea | 3"}
    assert pdf.plain_text(lines(("a", 9, False, 1), ("b", 9, False, 20))) == "a\n\nb"


def test_pdf_documents_frame(spark):
    rows = [(7, p, i, 0, t, s, False, False, 50.0, y, 300.0, y + s, 612.0, 800.0) for p in range(3) for i, (t, s, y) in enumerate([("Same Head", 9.0, 5.0), ("Big Title", 20.0, 100.0), *[("plain words of the body " * 3, 10.0, 150.0 + 20 * k) for k in range(8)]])]
    df = spark.createDataFrame(rows, "doc_id long, page int, block int, line int, text string, size double, bold boolean, italic boolean, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double")
    got = pdf.styled_documents(df).first()
    assert got["markdown"].count("## Big Title") == 3 and "Same Head" not in got["markdown"]
    assert [tuple(r) for r in pdf.furniture_keys(df).collect()] == [(7, "same head")]
