import html as entities
import itertools
import random
import re

import corpus_pipeline
from brindle.llm import decontamination, html_extract, language_id, packing, quality_rules, simhash_dedup


def costs(odds, edges, side):
    own = sum(max(o, 0) if not k else max(-o, 0) for o, k in zip(odds, side, strict=True))
    return own + sum(w for (a, b), w in edges.items() if side[a] != side[b])


def test_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 9)
        odds = [rng.choice([-3, -1, -0.5, 0, 0.3, 1, 2, 4]) * rng.random() for _ in range(n)]
        edges = {(a, b): rng.random() * 2 for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}
        best = min(costs(odds, edges, s) for s in itertools.product([0, 1], repeat=n))
        assert abs(costs(odds, edges, html_extract.cut(odds, edges)) - best) < 1e-9
    assert html_extract.cut([], {}) == []


def test_articles_of_the_pages_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"(?s)<article>(.*?)(</article>|$)", r.html)[1].replace("<br>", " ")
        parts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in re.split(r"</?(?:p|h1)>", body)]
        want = "\n".join(p for p in parts if p)
        assert got[r.page_id] == (want, len(want))


PAGE = """<html><head><title>T</title><script>if(a<b){x("<p>no</p>")}</script></head><body><header><h1>Site</h1><ul class="menu"><li><a href=x>Home</a></li></ul></header>
<div id="cookie-notice">We use cookies.</div><div class="layout"><div class="post-content"><h2>Real title &amp; more</h2><p>The article&#39;s text, long enough,
 with&nbsp;space.<p>Second paragraph of <a href=x>the article</a> here.<div class="related"><a href=1>One</a> <a href=2>Two</a></div><blockquote>A quote.</blockquote></div>
<div class="sidebar"><p>Sidebar text that looks like a paragraph. It goes on.</p></div><section id="comments"><h3>Comments</h3><div class="comment"><p>I think it is great. Really.</p></div></section></div>
<form><p>Your address please.</p></form><!-- <p>no</p> --><aside><p>Advert of a thing that you may buy today.</p></aside><footer><p>Copyright us.</p></footer></body></html>"""


def test_boilerplate_goes():
    assert html_extract.main_text(PAGE) == "Real title & more\nThe article's text, long enough, with space.\nSecond paragraph of the article here.\nA quote."
    assert html_extract.main_text("<article><header><h1>Head</h1></header><p>Hi.</p><p>x &lt;b&gt; &#169; &eacute;</article>") == "Head\nHi.\nx <b> © é"


def test_unfinished_and_odd_markup():
    assert html_extract.main_text("plain text only") == "plain text only"
    assert html_extract.main_text("<p>a < b and c</p><p class=x") == "a < b and c"
    assert html_extract.main_text("<p>open <!-- comment") == "open"
    assert html_extract.main_text("<p>text</p><script>var a = 1") == "text"
    assert html_extract.main_text('<p title="a>b">quoted</p>') == "quoted"
    deep = "<div>" * 3000 + "<p>deep text here.</p>"
    assert html_extract.main_text(deep) == "deep text here."


def test_page_edges(spark):
    rows = [(1, "u", None, "x"), (None, None, "", "x"), (2, "u", "<p>Long. " + "word " * 50000 + "</p>", "x"), (2, "u", "<p>Long. " + "word " * 50000 + "</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r.n_chars for r in got.collect()) == [0, 0, 250005, 250005]
    assert html_extract.extract(pages.where("false")).count() == 0


def test_pipeline_matches_its_parts(spark):
    """Every stage by hand on the same rows: the driver-side forms of the operators, and brute-force groups."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    pieces = quality_rules.WordPieces.shared(quality_rules.VOCABULARY)
    kept = [bool(k) for k in quality_rules.judge([t.encode() for _, t in rows], pieces)["kept"]]
    rows = [r for r, k in zip(rows, kept, strict=True) if k]
    left = docs.where(docs.doc_id.isin([i for i, _ in rows]))
    named = {r.doc_id for r in language_id.language_id(left).where("lang_pred <> 'und' and score >= 0.5").collect()}
    rows = sorted(r for r in rows if r[0] in named)
    fps = [simhash_dedup.fingerprint(t.encode()) for _, t in rows]
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = i, j
                while up[a] != a:
                    a = up[a]
                while up[b] != b:
                    b = up[b]
                up[max(a, b)] = min(a, b)
    rows = [r for k, r in enumerate(rows) if up[k] == k]
    items = [(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    index = decontamination.Index(items)
    dirty = {rows[r][0] for r, k, g, h in decontamination._hits([t.encode() for _, t in rows], index) if index.search(k, g, h)}
    rows = [r for r in rows if r[0] not in dirty]
    want = sorted(r[0] for r in rows)
    got = corpus_pipeline.run(spark, d).toPandas()
    assert sorted(got.doc_id.unique().tolist()) == want
    bpe = packing.ByteBpe.shared("byte_bpe_50k.json")
    assert got.length.sum() == sum(len(bpe.ids(t.encode())) // 4 + 1 for _, t in rows)
    for _, b in got.sort_values("offset").groupby("sequence_id"):
        assert (b.length.cumsum() - b.length == b.offset).all() and b.length.sum() <= 1024


def test_stages_return_documents_and_take_no_rows(spark, docs, no_docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, no_docs, "/root/testdata/sf0.001").columns == docs.columns
        assert stage(spark, no_docs, "/root/testdata/sf0.001").count() == 0
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns


def test_queries_are_registered():
    from brindle.llm import queries

    names = list(queries.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 14))
    assert set(queries.oracle_sql()) == {"op11_source_mixing", "op12_hard_negatives"}
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
