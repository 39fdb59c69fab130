"""Main text, WARC derivatives and near vectors."""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pytest

from revtide.llm import lattice, queries, tagpaths, warc

SF = "/root/testdata/sf0.001"

ODD = [
    (1, "u", None, ""),
    (2, "u", "", ""),
    (3, None, "<p>Hello, world. It is.", "Hello, world. It is."),
    (
        4,
        "u",
        "<body><div class='menu'><a href=x>Home</a></div><div id=content><h2>T</h2><p>One, two. Three.</p><div class='comments'><p>Great, I think so too.</p></div>"
        "<p>A &lt;b&gt; &amp;\n c&nbsp;d</p></div><div class=footer>(c)</div><script>if (a<b) '</p>'</script></body>",
        "T\nOne, two. Three.\nA <b> & c d",
    ),
    (5, "u", "<div>" * 2000 + "deep text, here." + "</div>" * 2000, "deep text, here."),
    (5, "u", "<nav><a>only</a></nav><!-- open", ""),
    (6, "u", "<form>name <input></form><aside>side, bar.</aside><article><p>In, it.<p>And out.</article>", "In, it.\nAnd out."),
]


def test_main_text_of_pages(spark):
    table = queries.open_table(spark, SF, "pages")
    got = {r.page_id: r for r in tagpaths.extraction_report(table).collect()}
    for page in table.collect():
        body = re.search(r"<article>(.*?)(</article>|<footer|\Z)", page.html, re.S)[1]
        body = re.sub(r"</?(p|h1|h2|br|div|li|ul|section)\b[^>]*>", "\n", body)
        body = re.sub(r"<!--.*?-->|<[^>]+>", "", body, flags=re.S)
        lines = (" ".join(html.unescape(line).split()) for line in body.split("\n"))
        assert got[page.page_id].text == "\n".join(x for x in lines if x)
        assert got[page.page_id].n_chars == len(got[page.page_id].text)


def test_main_text_of_odd_pages(spark):
    table = spark.createDataFrame([x[:3] for x in ODD], "page_id long, url string, html string")
    got = tagpaths.extract_main_text(table.withColumnRenamed("url", "text"), "main").collect()
    assert sorted((r.page_id, r.main) for r in got) == sorted((x[0], x[3]) for x in ODD)
    assert tagpaths.extraction_report(table.limit(0)).count() == 0


def test_derivatives_refer_to_their_response(spark):
    table = spark.createDataFrame([x[:3] for x in ODD], "page_id long, url string, html string")
    source = warc.responses(table)
    by_id = {r.record_id: r for r in source.collect()}
    rows = warc.serialized(warc.derivatives(source.selectExpr("*", "1 AS header", "2 AS block"))).collect()
    assert len(rows) == 2 * len(ODD)
    sha = lambda text: "sha256:" + hashlib.sha256(text.encode()).hexdigest()
    for r in rows:
        response = by_id[r.refers_to]
        fields = dict(line.split(": ", 1) for line in r.header.strip().split("\r\n")[1:])
        assert fields["WARC-Refers-To"] == r.refers_to
        assert fields["WARC-Source-Payload-Digest"] == sha(response.payload)
        assert fields["WARC-Block-Digest"] == sha(r.block)
        assert int(fields["Content-Length"]) == len(r.block.encode())
        assert bytes(r.record) == (r.header + r.block + "\r\n\r\n").encode()
        if r.warc_type == "metadata":
            assert "source-Content-Type: text/html; charset=utf-8\r\n" in r.block and r.block.startswith("status: HTTP/1.1 200 OK\r\n")
    conversions = {(r.refers_to, r.block) for r in rows if r.warc_type == "conversion"}
    metadata = [r for r in rows if r.warc_type == "metadata"]
    for r in metadata:
        assert any(f"conversion-digest: {sha(block)}\r\n" in r.block for of, block in conversions if of == r.refers_to)
    assert any("A <b> & c" in x for _, x in conversions)
    assert warc.derivatives(source.limit(0)).count() == 0


def expected_links(rows):
    units, ids = [], []
    for i, x in rows:
        if i is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x):
            v = np.array(x, np.float32).astype(float)
            units.append(v / np.sqrt(v @ v))
            ids.append(i)
    n = len(ids)
    near = np.array([[i != j and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.9 for j in range(n)] for i in range(n)])
    component = np.array(ids)
    for _ in range(n):
        new = np.array([min([component[i], *component[near[i]]]) for i in range(n)])
        if (new == component).all():
            break
        component = new
    return sorted(zip(ids, near.sum(1).tolist(), component.tolist(), strict=True))


def test_near_vectors(spark):
    rnd = np.random.default_rng(1)
    centre = rnd.normal(size=(4, 16))
    rows = [(i, (centre[i % 4] + 0.1 * rnd.normal(size=16)).tolist()) for i in range(120)]
    rows += [(500 + i, rows[3][1]) for i in range(5)] + [(600, [2 * v for v in rows[3][1]]), (700, [1.0, 0.0, 0.0]), (701, [1.0, 0.1, 0.0])]
    bad = [(800, None), (801, []), (802, [0.0] * 16), (803, [float("nan")] * 16), (804, [float("inf")] + [1.0] * 15), (805, [None] + [1.0] * 15), (None, rows[0][1])]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").selectExpr("*", "1 AS size", "2 AS cell").repartition(4)
    got = {}
    out = lattice.near_vector_report(table).collect()
    assert len(out) == len(rows) + len(bad)
    for r in out:
        got.setdefault(r.vec_id, (r.vec_id, r.n_links, r.component_id))
    good = expected_links(rows)
    assert sorted(got[i] for i, _ in rows) == good
    for i, _ in bad:
        assert got[i][1] == 0 and got[i][2] == i
    assert lattice.near_vectors(table.limit(0)).count() == 0


def test_a_cell_of_many_blocks(spark, monkeypatch):
    rnd = np.random.default_rng(2)
    centre = rnd.normal(size=16)
    rows = [(i, (centre + 0.2 * rnd.normal(size=16)).tolist()) for i in range(150)]
    monkeypatch.setattr(lattice, "BLOCK", 40)
    got = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    want = expected_links(rows)
    found = sum(r.n_links for r in got)
    assert all(r.n_links <= w[1] for r, w in zip(sorted(got), want, strict=True))
    assert found >= 0.98 * sum(w[1] for w in want)


def test_nearest_lattice_point():
    rnd = np.random.default_rng(3)
    points = rnd.normal(size=(200, 8)) * 2
    near = lattice.nearest_e8(points)
    base = ((points - near) ** 2).sum(1)
    for root in lattice.ROOTS:
        assert (((points - near - root) ** 2).sum(1) >= base - 1e-9).all()
    assert np.allclose(near.sum(1) % 2, 0) and len(lattice.ROOTS) == 240


@pytest.mark.parametrize("cosine", [0.901, 0.95])
def test_recall(spark, cosine):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rnd.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = cosine * x + np.sqrt(1 - cosine**2) * z
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    found = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).where("n_links > 0").count()
    assert found >= 0.95 * len(rows)
