import gzip
import random
import time

import pytest
from pyarrow import fs
from quarry.llm import op1_license, op2_html, op3_warc

BIG = 2**53


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>" + "Some longer words of an article. " * 20
    rows = [(BIG + 1, "u", long), (None, "n", long), (BIG + 3, "v  \n w", long), (BIG + 5, None, None), (BIG + 5, "w", "<p>short"), (BIG + 5, "w", "<p>short"), (None, "x", "é" * 10**6)]
    return spark.createDataFrame([(*r, "s", 1) for r in rows], "page_id long, url string, html string, text string, payload int")


def folder_of(spark):
    return f"{op3_warc.shared_dir(spark)}/test-{op3_warc.uuid.uuid4().hex}"


def test_warc_keeps_large_and_null_ids(spark, pages):
    folder = folder_of(spark)
    op3_warc.write_archive(pages, folder)
    rows = op3_warc.read_archive(spark, folder, payload=True).collect()
    assert len(rows) == 7
    response = next(r for r in rows if r["page_id"] == str(BIG + 1))
    assert response["record_type"] == "response" and bytes(response["payload"]).startswith(b"<p>Some")
    assert {(r["page_id"], r["refers_to"]) for r in rows if r["record_type"] == "revisit"} == {(None, str(BIG + 1)), (str(BIG + 3), str(BIG + 1))}
    assert max(len(r["payload"]) for r in rows) == 2 * 10**6
    got = op3_warc.read_archive(spark, folder).where(f"record_type = 'response' AND page_id IN ('{BIG + 5}', 'q') AND payload_bytes > 0").collect()
    assert [r["payload_bytes"] for r in got] == [8, 8]
    assert {r["url"] for r in rows} == {"u", "n", "v w", None, "w", "x"}


def test_warc_any_id_and_empty(spark):
    folder = folder_of(spark)
    odd = spark.createDataFrame([("a b>é", "u", "x"), ("", "u", "y")], "page_id string, url string, html string")
    op3_warc.write_archive(odd, folder)
    assert {r["page_id"] for r in op3_warc.read_archive(spark, folder).collect()} == {"a b>é", ""}
    folder = folder_of(spark)
    op3_warc.write_archive(odd.limit(0), folder)
    assert op3_warc.read_archive(spark, folder).count() == 0


def test_unwanted_payloads_are_neither_inflated_nor_read(tmp_path):
    noise = random.Random(1).randbytes(10**6)
    record = lambda i: op3_warc.member(f"WARC/1.1\r\nWARC-Record-ID: {i}\r\nContent-Length: {len(noise)}\r\n\r\n".encode() + noise + b"\r\n\r\n")
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(record(i) for i in range(5)))
    assert gzip.decompress(path.read_bytes()).count(noise) == 5

    class Counted:
        def __init__(self, f):
            self.f, self.bytes = f, 0

        def read(self, n):
            out = self.f.read(n)
            self.bytes += len(out)
            return out

        def __getattr__(self, name):
            return getattr(self.f, name)

    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        c = Counted(f)
        got = list(op3_warc.records(c, lambda h: h["WARC-Record-ID"] == "3"))
        assert [h["WARC-Record-ID"] for h, _ in got] == ["0", "1", "2", "3", "4"]
        assert [b == noise for _, b in got] == [False, False, False, True, False] and c.bytes < 1.2 * 10**6
    path.write_bytes(b"".join(gzip.compress(gzip.decompress(record(i))) for i in range(3)))
    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        assert [h["WARC-Record-ID"] for h, _ in op3_warc.records(f, lambda h: False)] == ["0", "1", "2"]


def test_html_names(spark):
    for html, want in [
        ("<body class='has-sidebar'><article><p>This is the text.</article>", "This is the text."),
        ("<article class='post tag-news'><h1>T</h1><p>Text here.</article>", "T\nText here."),
        ("<form id='aspnet'><div id='content'><p>" + "All of the page stands in a form. " * 5 + "</div></form>", ("All of the page stands in a form. " * 5).strip()),
        ("<main><p>One.</p><div class='comments'><article class='comment'><p>" + "I like it a lot, really. " * 9 + "</article></div></main>", "One."),
        ("<article><p>It's a < b &amp; c.<p title=it's>Don't</article><aside><p>More words of another page.</aside>", "It's a < b & c.\nDon't"),
        ("<article><p>Cut <a href='x", "Cut"),
        ("<div><p>" + "A long text without any names around it. " * 4 + "<ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div>", ("A long text without any names around it. " * 4).strip()),
    ]:
        assert op2_html.main_text(html) == want


def test_edges_decide_and_fold_exactly():
    page = op2_html.Page("<body><nav><a href=a>Home</a></nav><article><h1>Head</h1><p>Yes.</p><p>" + "word " * 30 + "end.</p></article>")
    terminals, edges = op2_html.network(page)
    alone = [a > b for a, b in terminals[: len(page.blocks)]]
    cut = op2_html.max_flow_side(len(terminals), terminals, edges)[: len(page.blocks)]
    assert alone == [False, True, False, True] and cut == [False, True, True, True]
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 8)
        ter = [(rng.randint(0, 20), rng.randint(0, 20)) for _ in range(n)]
        edges = [(i, j, rng.randint(1, 9)) for i in range(n) for j in range(i + 1, n) if rng.random() < rng.choice([0.2, 0.9])]
        cost = lambda side: sum(b if s else a for s, (a, b) in zip(side, ter, strict=True)) + sum(c for i, j, c in edges if side[i] != side[j])  # noqa: E731, B023
        assert cost(op2_html.max_flow_side(n, ter, edges)) == min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(2**n))


@pytest.mark.parametrize("html", ["<a " * 350_000, '<p title="' * 100_000, "<div>" * 100_000 + "x", "<!--" * 200_000, ("<div><p>" + "word " * 20 + "</p><ul><li><a>x</a></ul>") * 5000, "<option>a" * 50_000])
def test_html_takes_linear_time(html):
    began = time.process_time()
    op2_html.main_text(html)
    assert time.process_time() - began < 10


def test_html_odd_pages(spark, pages):
    rows = op2_html.extract(pages).collect()
    assert sorted((r["page_id"] or 0) for r in rows) == [0, 0, BIG + 1, BIG + 3, BIG + 5, BIG + 5, BIG + 5]
    assert all(r["n_chars"] == len(r["text"]) for r in rows) and {r["text"] for r in rows if r["page_id"] == BIG + 5} == {"", "short"} - ({"short"} if op2_html.main_text("<p>short") == "" else set())
    assert op2_html.extract(pages.limit(0)).count() == 0


def brute(words, template, coverage):
    """Whether some window of the text has the coverage, by longest common subsequence."""
    best = 0
    for lo in range(max(1, len(words))):
        window = words[lo : lo + len(template) + len(template) // 8 + 2 * max(6, len(template) // 4)]
        row = [0] * (len(template) + 1)
        for w in window:
            new = [0]
            for j, t in enumerate(template):
                new.append(row[j] + 1 if w == t else max(row[j + 1], new[j]))
            row = new
        best = max(best, row[-1])
    return best >= coverage * len(template) - 1e-9


def test_license_occurrences():
    mit = next(t for n, t in op1_license.TEXTS if n == "MIT" and len(t) > 100)
    got = op1_license.licenses("Copyright\n" + mit + "\nfoo bar " + mit.replace("TORT", "tort or so"))
    assert [x[0] for x in got] == ["MIT", "MIT"] and got[0][1] == 1.0
    assert [x[0] for x in op1_license.licenses("x. Released under the MIT license. y Released under the MIT license. All rights reserved, all rights reserved")] == ["MIT", "MIT", "All-Rights-Reserved", "All-Rights-Reserved"]
    assert op1_license.licenses("This work is licensed under the General Public License, version 3")[0][0] == "GPL-3.0"
    assert op1_license.licenses("licensed under the Apache Software Foundation's well known License, Version 2.0")[0][:2] == ("Apache-2.0", 1.0)
    for name, text in op1_license.TEXTS:
        assert [x[:2] for x in op1_license.licenses("zz " * 5000 + text + " zz" * 5000)] == [(name, 1.0)]


def test_license_against_brute_force():
    rng, short = random.Random(4), [(n, t) for n, t in op1_license.TEMPLATES if len(t) < 16]
    hits = 0
    for _ in range(150):
        name, template = rng.choice(short)
        own = [w for w in template if rng.random() > 0.12]
        if rng.random() < 0.5 and own:
            own.insert(rng.randrange(len(own)), rng.choice(["zz", "yy"]))
        words = rng.choices(["aa", "bb", "under", "the"], k=rng.randint(0, 20)) + own + rng.choices(["aa", "bb", "license"], k=rng.randint(0, 20))
        want = brute(words, template, 0.8)
        at = {}
        for i, w in enumerate(words):
            at.setdefault(w, []).append(i)
        got = bool(op1_license.statements(words, at, template, 0.8))
        hits += want
        assert want or not got
        assert got or not want or len(set(words)) < len(words)  # repeated words may hide an anchor
    assert hits > 40


def test_license_odd_rows(spark):
    rows = [(BIG + 1, None), (None, ""), (BIG + 3, "All rights reserved."), (BIG + 3, "All rights reserved."), (7, "x " * 10**5 + "all rights reserved")]
    df = spark.createDataFrame([(i, t, "a", 1.0) for i, t in rows], "doc_id long, text string, license string, coverage double")
    got = op1_license.scan(df).collect()
    assert sorted((r["doc_id"] or 0, r["license"] or "") for r in got) == [(0, ""), (7, "All-Rights-Reserved"), (BIG + 1, ""), (BIG + 3, "All-Rights-Reserved"), (BIG + 3, "All-Rights-Reserved")]
    assert op1_license.scan(df.limit(0)).count() == 0
