import html

import numpy as np
import pytest

from gridwake.llm import embedding_dedup, html_extract


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, host string")


def texts(spark, rows):
    return {r.page_id: r.text for r in html_extract.main_text(pages(spark, rows)).collect()}


def test_roles_alone(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p><p>no';</script></head><body><header>Site</header><nav><ul><li>Home</ul></nav><div class=\"cookie-notice\">We use cookies</div><main><article><h1>A &amp; B&nbsp;&lt;c&gt;</h1>"
        "<p>First  <b>bold\n text<br>here<p>Second &quot;one&quot;<!-- hidden <p>x</p> --></p><ul><li>One<li>Two</ul><aside>See also</aside><form><input><p>Search</p></form><div id='comments'><p>Nice!</p></div></article></main><footer>&copy; us</footer></body>"
    )
    got = texts(spark, [(1, "http://a.example/1", page), (2, None, None), (3, "x", ""), (None, "http://a.example/1", page), (5, "http://a.example/2", "<p>cut <b>off &amp; \"<a href='x"), (6, "http://a.example/3", "plain text"), (7, "http://a.example/4", "<nav>only</nav>")])
    assert got[1] == 'A & B <c>\nFirst bold text here\nSecond "one"\nOne\nTwo'
    assert got[None] == got[1] and got[2] == got[3] == got[7] == "" and got[5].startswith("cut off &") and got[6] == "plain text"
    assert html_extract.main_text(pages(spark, [])).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_template_of_a_host_without_roles(spark, monkeypatch, broadcast):
    """Neither tags nor names mark the parts: only the template tells fixed text and the slot of the article."""
    if not broadcast:
        monkeypatch.setattr(html_extract, "BROADCAST_BYTES", -1)
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefg"), 5)) for _ in range(n))
    rows, want = [], {}
    for i in range(30):
        body = [prose(30) for _ in range(rng.integers(1, 5))]
        rows.append((i, f"https://h.example/{i}", "<html><body><div class=x1>Our Site since 1999</div><div class=x2>" + "".join(f"<p>{html.escape(b)}</p>" for b in body) + f"<p>Read more on this site</p></div><div class=x3><p>{prose(2)}</p></div></body></html>"))
        want[i] = "\n".join(body)
    rows += [(100 + i, f"https://h.example/{100 + i}", rows[0][2]) for i in range(40)]  # copies say nothing new
    got = texts(spark, rows)
    assert all(got[i] == want[i] for i in want) and got[120] == want[0]


def test_near_copies_and_quotes_keep_their_text(spark):
    """Pages that share an article, or a clause, aren't a template: alone on a host, and among other pages."""
    rng = np.random.default_rng(21)
    body = [_words(rng, 20) for _ in range(8)]
    page = lambda parts, note="": "<div class=top><p>Our site</p></div><article>" + "".join(f"<p>{p}</p>" for p in parts) + note + "</article><div class=end><p>All rights reserved</p></div>"
    copies = [[f"{body[0]} {i}", *body[1:]] for i in range(3)]
    rows = [(i, f"http://copies.example/{i}", page(c)) for i, c in enumerate(copies)]
    others = [[_words(rng, 20) for _ in range(3)] for _ in range(10)]
    rows += [(10 + i, f"http://mixed.example/{i}", page(c)) for i, c in enumerate(copies + others)]
    clause = "A clause that three of ten articles quote word for word."
    quoted = [(o, f"<div class=quote><p>{clause}</p></div>" if i < 3 else "") for i, o in enumerate(others)]
    rows += [(40 + i, f"http://quotes.example/{i}", page(o, q)) for i, (o, q) in enumerate(quoted)]
    ten = [[f"{body[0]} {i}", *body[1:]] for i in range(10)]
    rows += [(60 + i, f"http://ten.example/{i}", page(c)) for i, c in enumerate(ten)]
    got = texts(spark, rows)
    want = {i: c for i, c in enumerate(copies)} | {10 + i: c for i, c in enumerate(copies + others)} | {40 + i: [*o, clause] if q else o for i, (o, q) in enumerate(quoted)} | {60 + i: c for i, c in enumerate(ten)}
    assert {i: got[i].split("\n") for i in want} == want


def test_marks_are_whole_words(spark):
    kept = ("social-history", "share-prices", "menu-planning", "adventure", "navigator", "commented")
    gone = ("sidebar-2", "cookie-notice", "share-buttons", "nav-main", "ad", "comments", "sidebar left")
    page = "<article><p>Text</p>" + "".join(f"<div class='{c}'><p>{c}</p></div>" for c in (*kept, *gone)) + "</article>"
    assert texts(spark, [(1, "x", page)])[1].split("\n") == ["Text", *kept]


def test_broken_pages_take_linear_time():
    import time

    for broken in ("<a '", "<a '\"", "<a <b ", "<div>", "<div></x>", "<noscript>", "<p>'\"", "</a ' "):
        began = time.time()
        html_extract.page_tokens(broken * (1_000_000 // len(broken)) + "text")
        assert time.time() - began < 15, broken  # quadratic ones took minutes


def _words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefg"), 5)) for _ in range(n))


def test_layouts_and_odd_pages_keep_their_templates(spark):
    """Two layouts, empty pages, an error page and a very long page on one host, without telling tags or names."""
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for i in range(40):
        body = [_words(rng, 25) for _ in range(rng.integers(1, 4))]
        if i == 39:
            body = [_words(rng, 60_000)]
        text = "".join(f"<p>{b}</p>" for b in body)
        if i % 2:
            page = f"<div class=a1><p>{_words(rng, 3)}</p></div><div class=a2><p>Printed here</p>{text}</div>"
        else:
            page = f"<div class=b1>{text}<p>All rights kept</p></div><div class=b2><p>{_words(rng, 4)}</p></div>"
        rows.append((i, "https://h.example/x", f"<html><body><div class=top>Our Site</div>{page}</body></html>"))
        want[i] = "\n".join(body)
    rows += [(100, "https://h.example/e", None), (101, "https://h.example/e", ""), (102, "https://h.example/e", "<html><body><p>Not found</p></body></html>")]
    got = {r.page_id: r.text for r in html_extract.main_text(pages(spark, rows), roles=False).collect()}
    assert all(got[i] == want[i] for i in want)
    assert got[100] == got[101] == "" and got[102] == "Not found"


def test_templates_alone_find_the_articles(spark):
    """The given pages with roles switched off: right wherever a host has two different pages."""
    import duckdb

    from gridwake.llm.queries import OP3

    con = duckdb.connect()
    con.sql("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    want = {r[0]: r[2] for r in con.sql(OP3).fetchall()}
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.main_text(table, roles=False).collect()}
    assert sum(got[i] == want[i] for i in want) >= 244


def test_near_copies_on_a_host_keep_what_they_share(spark):
    rng = np.random.default_rng(5)
    body = [_words(rng, 30) for _ in range(5)]
    rows = [(i, "https://n.example/1", "<html><body><div class=m>" + "".join(f"<p>{b}</p>" for b in [*body[:i], f"edit {i}", *body[i + 1 :]]) + "</div></body></html>") for i in range(2)]
    assert texts(spark, rows) == {i: "\n".join([*body[:i], f"edit {i}", *body[i + 1 :]]) for i in range(2)}


@pytest.mark.parametrize("part, line", [("<header class='entry-header'><h1>Title</h1></header>", "Title"), ("<h2 id='related-work'>Rel</h2>", "Rel"), ("<p class='side-note'>Side</p>", "Side"), ("<p>E <math><mi>m</mi></math> end</p>", "E m end")])
def test_article_text_with_telling_names_stays(part, line):
    page = f"<html><body><main><article>{part}<p>Text</p><div class='comments'><p>Nice</p></div></article></main></body></html>"
    assert html_extract.extract(page, None) == f"{line}\nText"


def test_few_pages_have_no_template(spark):
    rows = [(i, "https://s.example/1", "<html><body><p>The same words</p></body></html>") for i in range(20)]
    assert set(texts(spark, rows).values()) == {"The same words"}


def brute(rows, threshold=0.95):
    ids, v = [i for i, x in rows], []
    d = 16
    for _, x in rows:
        ok = x is not None and len(x) == d and all(c is not None and np.isfinite(c) for c in x) and any(x)
        a = np.array(x, np.float32).astype(np.float64) if ok else np.zeros(d)
        v.append(a / np.linalg.norm(a) if ok else a)
    near = np.array(v) @ np.array(v).T >= threshold
    np.fill_diagonal(near, False)
    root = {i: i for i in ids}
    for a, b in zip(*np.nonzero(near)):
        lo, hi = sorted((root[ids[a]], root[ids[b]]))
        root = {k: lo if r == hi else r for k, r in root.items()}
    return {i: (int(n), root[i]) for i, n in zip(ids, near.sum(axis=1))}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 16))
    rows = [(i, base[i % 60] + 0.04 * (i >= 60) * rng.normal(size=16)) for i in range(200)]
    rows = [(i, x.astype(np.float32).tolist()) for i, x in rows]
    rows += [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [None] * 16), (504, []), (505, [1.0] * 3), (506, rows[3][1]), (507, rows[3][1])]
    d = spark.createDataFrame([(i, x, 0) for i, x in rows] + [(None, rows[0][1], 0)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(d).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    found = sum(n for n, _ in got.values()) / sum(n for n, _ in want.values())
    assert found >= 0.9 and all(got[i][0] <= want[i][0] for i in want)
    assert all(got[i] == (0, i) for i in range(500, 506))
    assert embedding_dedup.near_duplicates(d.limit(0)).count() == 0


def test_vectors_of_several_lengths_and_sizes(spark):
    """Each length links within itself; components near the ends of a double's range neither over- nor underflow."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(30)]
    rows += [(100 + i, (np.array([1.0, 2.0, 3.0]) * 10.0 ** (200 * (i - 1))).tolist()) for i in range(3)] + [(110, [1.0, 2.0, 3.1]), (111, [-3.0, 1.0, 0.0])]
    rows += [(200, [0.0] * 3), (201, [1.0, float("inf"), 0.0]), (202, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(d).collect()}
    assert all(got[i] == (3, 100) for i in (100, 101, 102, 110))
    assert all(got[i] == (0, i) for i in (111, 200, 201, 202))


def test_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 10)
    rng = np.random.default_rng(7)
    base = rng.normal(size=16)
    rows = [(i, (base + 0.001 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(45)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(d).collect()}
    assert got == {i: (44, 0, i == 0) for i in range(45)}


def test_decode_finds_the_nearest_lattice_point():
    rng = np.random.default_rng(8)
    x = rng.normal(0, 2, (500, 8))
    p, gap = embedding_dedup.decode(x)
    assert np.allclose(((x - p[:, 0] / 2) ** 2).sum(axis=1), gap[:, 0]) and gap[:, 0].max() <= 1 + 1e-9
    assert ((p[:, 0] % 2 == p[:, 0, :1] % 2).all()) and ((p[:, 0].sum(axis=1) % 4) == 0).all()
