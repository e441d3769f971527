"""HTML extraction on pages of known text; nearest neighbours against brute force."""

import numpy as np
import pytest

from textloom.llm.common import table
from textloom.llm.html_extraction import extract, main_text, templates
from textloom.llm.vector_search import Forest, _common_bits, forest_search, measured_share, nearest

PAGES = [
    ("<article><h1>T &amp; &eacute;&#233;</h1><p>one\n  two<br>three<p>four <b>bo</b>ld</article>", "T & éé\none two three\nfour bold"),
    ("<nav>menu</nav><header>head</header><article><p>text</p><aside>side</aside><div class='ad'>buy</div></article><footer>foot</footer>", "text"),
    ("<body><div id=cookie-notice>cookies</div><main><p>a</p><form><p>f</p></form><section class='comments'><p>c</p></section></main>", "a"),
    ("<article><p>x</p><script>var t='</p>';</script><style>p{}</style><p>y</p><!-- <p>no</p> --></article><article class='comment'>z</article>", "x\ny"),
    ("<p>no article</p><div>second <i>block</i></div><div class=sidebar>gone</div>", "no article\nsecond block"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e</table>", "a\nb\nc\nd\ne"),
    ("<article><p>5 < 6 &lt; 7 &nbsp; 8 &copy; &unknown;</p></article>", "5 < 6 < 7 8 © &unknown;"),
    ("<article><p title=\"a > b\">quoted</p><p hidden>h</p><p style='display: none'>n</p></article>", "quoted\nh\nn"),
    ("<p>unclosed <b>bold<p>next", "unclosed bold\nnext"),
    ("plain text", "plain text"), ("", ""), ("<!-- open", ""), ("<script>x", ""), ("<", "<"), ("<article></article>", ""),
    ("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</article>", "deep"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert main_text(page) == text


def test_templates_go_and_articles_stay(spark):
    rows = []
    for i in range(40):
        own = f"<div><span>story {i} of its own</span></div>"
        shared = "<p>a passage that many pages quote</p>" if i % 5 < 2 else ""
        template = "<div><span>Brought to you by the site</span></div>"
        rows.append((i, "http://one.example/x", f"<body>{template}{own}</body>"))
        rows.append((100 + i, "http://two.example/x", f"<article>{shared}<p>{i}</p></article>"))
        rows.append((200 + i, "http://three.example/x", f"<body>{template}<div>one copied page</div></body>"))
    rows += [(300, None, None), (301, "http://one.example/", ""), (301, "http://one.example/", ""), (None, "no url", "<p>z</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as subtrees", "3 as text")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract(pages).collect()}
    assert extract(pages).count() == len(rows)
    for i in range(40):
        assert got[i] == (f"story {i} of its own", len(f"story {i} of its own"))
        assert got[100 + i][0] == (f"a passage that many pages quote\n{i}" if i % 5 < 2 else str(i))
        assert got[200 + i][0] == "Brought to you by the site\none copied page"
    assert got[300] == got[301] == ("", 0) and got[None] == ("z", 1)
    assert {r["host"] for r in templates(pages).collect()} == {"one.example"}
    assert extract(pages.limit(0)).count() == 0


def test_pages_have_all_text_of_their_articles(spark):
    import html
    import re

    pages = table(spark, "/root/testdata/sf0.01", "pages")
    sources = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in extract(pages).collect():
        article = re.search("<article>(.*?)</article>", sources[r["page_id"]], re.DOTALL)[1]
        bare = html.unescape(re.sub(r"<[a-z/!][^>]*>", "", article))
        assert "".join(r["text"].split()) == "".join(bare.split()) and r["n_chars"] == len(r["text"])


def brute(rows, k, every):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = min(good.get(i, v), v)
    dims = [len(v) for v in good.values()]
    dim = max(set(dims), key=lambda d: (dims.count(d), -d)) if dims else 0
    good = {i: np.array(v, np.float64) for i, v in good.items() if len(v) == dim}
    out = {}
    for q in good:
        if q % every == 0:
            scored = sorted(((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        own = out.setdefault(r["query_id"], [])
        own.append((r["vec_id"], r["score"]))
        assert r["rank"] == len(own)
    return out


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    same = [[1.0, 0.5, -1.0]] * 30
    rows = [(i, v) for i, v in enumerate(same)]
    rows += [(100, None), (120, [0.0, 0.0, 0.0]), (140, [1.0, nan, 0.0]), (160, [inf, 0.0, 0.0]), (180, [1.0, None, 2.0]), (200, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(220, [3.0, 1.0, 2.0]), (220, [3.0, 1.0, 2.0]), (240, [-5.0, 2.0, 9.0]), (241, [0.125, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as vector", "3 as query")
    assert by_query(nearest(df)) == brute(rows, 20, 20)
    assert nearest(df.limit(0)).count() == 0
    assert nearest(df.filter("vec_id = 220")).count() == 0


def recall(got, want):
    assert got.keys() == want.keys()
    assert all(len(got[q]) == len(want[q]) for q in want)
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def vectors(spark, x):
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).astype(float).tolist())]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def measured(df):
    """The share of strings that is found by measuring, on vectors that are good and different."""
    dim = len(df.first()["embedding"])
    rows = df.selectExpr("vec_id as id", "embedding as vector")
    norm = max(float(np.linalg.norm(r["vector"])) for r in rows.collect())
    return measured_share(rows, rows.filter("id % 20 = 0"), 21, Forest(dim, norm))


def test_recall_on_embeddings(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    want = brute([(r["vec_id"], list(r["embedding"])) for r in df.collect()], 20, 20)
    assert measured(df) < 0.12  # queries descend: an eighth of a tree or less
    assert recall(by_query(nearest(df)), want) >= 0.9
    # a smaller share finds less, and queries ascend past small blocks
    assert 0.5 < recall(by_query(nearest(df, share=0.02, part=100)), want) < 0.9


def test_recall_on_vectors_of_unequal_length_in_clusters(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 32))
    rows, df = vectors(spark, (centres[rng.integers(0, 60, 3000)] + 0.3 * rng.standard_normal((3000, 32))) * rng.uniform(0.7, 1.3, (3000, 1)))
    assert measured(df) < 0.05
    assert recall(by_query(nearest(df, part=300)), brute(rows, 20, 20)) >= 0.9


def test_recall_with_one_long_and_many_short_vectors(spark):
    x = unit(np.random.default_rng(5).standard_normal((2000, 24)))
    x[77] *= 1000
    x[100:140] *= 1e-30
    rows, df = vectors(spark, x)
    assert measured(df) < 0.2
    assert recall(by_query(nearest(df)), brute(rows, 20, 20)) >= 0.9


def test_recall_with_a_hot_prefix(spark):
    """A third of all vectors lie so close that they share long prefixes."""
    rng = np.random.default_rng(6)
    x = unit(rng.standard_normal((3000, 24)))
    x[:1000] = unit(x[0] + 0.01 * rng.standard_normal((1000, 24)))
    rows, df = vectors(spark, x)
    want, got = brute(rows, 20, 20), by_query(nearest(df, part=200))
    assert recall(got, want) >= 0.9
    assert recall({q: r for q, r in got.items() if q < 1000}, {q: r for q, r in want.items() if q < 1000}) >= 0.85


def test_keys_and_bands():
    rng = np.random.default_rng(7)
    forest, x = Forest(8, 4.0, trees=3), rng.standard_normal((50, 8))
    x *= (rng.uniform(0.01, 4, 50) / np.linalg.norm(x, axis=1))[:, None]
    assert forest.bands(x).tolist() == [int(np.floor(-np.log2(n / 4))) for n in np.linalg.norm(x, axis=1)]
    keys = forest.keys(x, forest.bands(x))
    bits = np.unpackbits(keys, axis=2)
    for i in range(50):
        common = [next((n for n, (a, b) in enumerate(zip(bits[i, t], bits[7, t], strict=True)) if a != b), 128) for t in range(3)]
        assert _common_bits(keys, keys[7])[i].tolist() == common


def test_queries_dealt_over_copies_of_a_part_find_the_same(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((600, 8)) + 2)]
    index = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = index.filter("id % 3 = 0")
    norm = max(float(np.linalg.norm(v)) for _, v in rows)
    found = [
        sorted(map(tuple, forest_search(index, queries, 5, Forest(8, norm, 3), 0.1, part=50, asking_at_once=n).select("query", "id", "score").collect()))
        for n in (8192, 7)
    ]
    assert found[0] == found[1] and len(found[0]) == 200 * 5
