"""Language, toxicity, nearest neighbours, pages, mixing and the pipeline."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from support import SF

from rootflow.llm import ann, common, html_text, language, source_mix, toxicity


# ---- language -------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    d = SF.replace("0.001", "0.01")
    truth = {r.doc_id: r.lang for r in common.documents(spark, d).collect()}
    rows = language.op2_language(spark, d).collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_awkward_documents(docs, no_docs):
    model = language.train(language.learning_rows(docs))
    got = language.predict(docs, model)
    assert got.columns == [*docs.columns[:-1], "lang_pred", "score"]  # the input has a column score
    plain = got.collect()
    assert len(plain) == docs.count()
    for r in plain:
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in model.languages
    assert language.train(language.learning_rows(no_docs)) is None
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}
    assert language.predict(no_docs, model).count() == 0


def test_grams_match_a_plain_count():
    texts = ["Ab  c", "", "É", "a" * 5]
    buckets, ends = language.grams(texts)
    assert np.diff(ends).tolist() == [4 + 3 + 2, 0, 1, 5 + 4 + 3]
    again, _ = language.grams(["ab c"])
    assert sorted(buckets[:9].tolist()) == sorted(again.tolist())


def test_ftrl_separates_and_is_sparse():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        y = i % 3
        at = np.unique(np.concatenate([[y], rng.integers(3, 200, 5)]))
        rows.append((at, np.ones(len(at)), y))
    w, b = language.ftrl(rows, 3, 200, 5, 0.5, 1.0, 1.0, 0.1, 1)
    assert (w[:3].argmax(axis=1) == np.arange(3)).all() and (w == 0).mean() > 0.5
    assert 0.4 < language.temperature(np.array([[2.0, 0.0]] * 10), np.array([0] * 9 + [1])) < 20


def test_many_languages_leave_a_rare_one_its_share(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_SAMPLE", 220)
    fitted = []
    fit = language.ftrl
    monkeypatch.setattr(language, "ftrl", lambda rows, *a: fitted.extend(y for *_, y in rows) or fit(rows, *a))
    rows = [(i, f"text number {i}", f"l{i % 10}") for i in range(4000)] + [(5000 + i, f"rare text {i}", "rare") for i in range(30)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=60)
    counts = np.bincount(fitted, minlength=11)
    # A quarter of the 20 rows of each language is held back.
    assert model.languages[-1] == "rare" and counts.sum() == 165 and counts.min() >= 8


# ---- toxicity -------------------------------------------------------------------------------------


def test_nn_pu_finds_the_feature():
    rng = np.random.default_rng(0)
    p = (rng.random((300, 6)) < [0.9, 0.5, 0.5, 0.5, 0.5, 0.5]).astype(float)
    u = np.vstack([(rng.random((900, 6)) < [0.02, 0.5, 0.5, 0.5, 0.5, 0.5]), (rng.random((100, 6)) < [0.9, 0.5, 0.5, 0.5, 0.5, 0.5])]).astype(float)
    w, b = toxicity.nn_pu(p, u, 0.1)
    assert w[0] > 2 * np.abs(w[1:]).max()
    m, s = toxicity.calibrate(p @ w + b, u @ w + b, 0.1)
    assert (np.diff(s) >= 0).all() and np.interp(m[0], m, s) < 0.2 and s[-1] > 0.6


def test_toxicity_held_out(spark):
    d = SF.replace("0.001", "0.1")
    rows = {r.doc_id: r for r in toxicity.op7_toxicity(spark, d).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for k, r in rows.items())
    held = [(rows[k].predicted, t) for k, t in labels.items() if rows[k].held_out]
    hit = sum(p and t for p, t in held)
    assert hit / sum(t for _, t in held) >= 0.6 and hit / max(1, sum(p for p, _ in held)) >= 0.85


def test_rare_sure_words_count_however_many_positives(spark):
    rng = np.random.default_rng(4)
    plain = [f"plain{i}" for i in range(300)]
    sure = [f"{i:05d}z" for i in range(230)]  # each in nine positives of 2,070 and in no other text
    rows = [(i, " ".join(rng.choice(plain, 8)) + (f" {sure[i // 9]}" if i < 2070 else "")) for i in range(22_070)]
    labels = spark.createDataFrame([(i, int(i < 2070)) for i in range(22_070)], "doc_id long, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", language.held_out(3, 1))
    got = {r.doc_id: r.score for r in toxicity.score(df, toxicity.train(df, labels)).collect()}
    assert np.mean([got[i] >= toxicity.THRESHOLD for i in range(2070)]) > 0.95
    assert np.mean([got[i] >= toxicity.THRESHOLD for i in range(2070, 22_070)]) < 0.01


def test_toxicity_of_awkward_documents(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (9, 0), (9, 1), (None, 1), (10, None)], "doc_id long, toxic int")
    rows = docs.withColumn("held_out", language.held_out(3, 1))
    model = toxicity.train(rows, labels)
    for m in (model, None):
        got = toxicity.score(rows, m).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.train(rows, labels.limit(0)) is None
    assert toxicity.score(no_docs.withColumn("held_out", language.held_out(3, 1)), model).count() == 0


# ---- nearest neighbours ---------------------------------------------------------------------------


def test_nearest_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 24)) * 2
    x = (centres[rng.integers(12, size=3000)] + rng.standard_normal((3000, 24))).astype(np.float32)
    x[500:1500] = x[500]  # a third are one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x, hit = x.astype(float), 0
    for q in range(0, 3000, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        hit += len(set(want.tolist()) & {v for v, _ in got[q]})
        assert all(abs(s - d[v]) < 1e-9 for v, s in got[q]) and [s for _, s in got[q]] == sorted(s for _, s in got[q])
    assert hit / 600 >= 0.9
    assert [v for v, _ in got[500]] == list(range(501, 511))


def test_query_recall_on_the_given_vectors(spark):
    d = SF.replace("0.001", "0.1")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got, hit, n = defaultdict(set), 0, 0
    for r in ann.op5_nearest(spark, d).collect():
        got[r.query_id].add(r.vec_id)
    for i in np.flatnonzero(ids % 100 == 0):
        dist = ((x - x[i]) ** 2).sum(axis=1)
        dist[ids == ids[i]] = np.inf
        hit, n = hit + len(got[int(ids[i])] & set(ids[np.lexsort((ids, dist))[:10]].tolist())), n + 10
    print("recall", hit / n)
    assert hit / n >= 0.95


def test_codes_choose_few_vectors():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 64)) * 2
    x = centres[rng.integers(20, size=4000)] + rng.standard_normal((4000, 64))
    c, turn, read, hit = ann.centroids_of(x, 60), ann.rotation(64), 0, 0
    own = ann.nearest_cells(x, c, 1)[:, 0]
    probes = ann.probes_for(x, c, 10)
    assert probes <= 20
    for i in range(0, 4000, 100):
        found, limit = [], np.inf
        for cell in ann.nearest_cells(x[i : i + 1], c, probes)[0]:
            at = np.flatnonzero(own == cell)
            low, high = ann.bounds(x[i : i + 1], c[cell], turn, *ann.encode(x[at], c[cell], turn))
            some, dist, n = ann.scan(x[i], limit, low[0], high[0], x[at], 11)
            read += n
            found += list(zip(dist, at[some], strict=True))
            limit = min(limit, sorted(found)[10][0]) if len(found) > 10 else limit
        d = ((x - x[i]) ** 2).sum(axis=1)
        hit += len({a for _, a in sorted(found)[:11]} & set(np.argsort(d)[:11].tolist()))
    print("read", read / 40 / 4000, "recall", hit / 440, "probes", probes)
    assert read / 40 / 4000 < 0.2 and hit / 440 > 0.95


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, q, c = rng.standard_normal((400, 64)), rng.standard_normal((20, 64)), rng.standard_normal(64) * 0.1
    turn = ann.rotation(64)
    low, high = ann.bounds(q, c, turn, *ann.encode(x, c, turn))
    true = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    assert ((low <= true) & (true <= high)).mean() > 0.93


def test_awkward_vectors(spark):
    from pyspark.sql import functions as F

    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [])]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "vec_id long, embedding array<float>, cell int, part int")
    got = ann.search(df, F.lit(True)).orderBy("query_id", "rank").collect()
    rows = [(5, [3.0, 4.0]), (5, [1.0, 1.0]), (6, [0.0, 1.0]), (7, [-0.0, 1.0])]
    twice = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.lit(True)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in twice if r.query_id != 7] == [(5, 6, 1.0), (5, 7, 1.0), (6, 7, 0.0), (6, 5, 1.0), (6, 5, 18**0.5)]
    assert {r.query_id for r in got} == {0, 1, 8} and [(r.vec_id, r.score) for r in got if r.query_id == 0] == [(1, 0.0), (8, 1.0), (8, 1.0)]
    assert [(r.rank, r.vec_id) for r in got if r.query_id == 8] == [(1, 0), (2, 1)]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


# ---- pages ----------------------------------------------------------------------------------------

PAGE = """<html><head><title>t</title><style>p{}</style></head><body class="home"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div>
<div class="sidebar"><p>side</p></div><main><article class="post"><header><h2>Title &amp; more</h2></header><p>First  para<br>line two &lt;b&gt; 1 &lt; 2</p>
<ul><li>one<li>two</ul><form><label>Name</label></form><div class="advert">Buy</div><p>Last &#233; <script>x("</p>")</script>&hellip;</p></article>
<section id="comments"><p>reader says</p></section></main><nav>n</nav><footer>foot</footer>"""


def test_blocks():
    assert html_text.blocks(PAGE) == (["Title & more", "First para", "line two <b> 1 < 2", "one", "two", "Last é …"], True)
    assert html_text.blocks("plain\n text") == (["plain text"], False) and html_text.blocks("") == ([], False)
    assert html_text.blocks("<p>a<p>b<div>c</div>d <!-- x > y --> e")[0] == ["a", "b", "c", "d e"]
    assert html_text.blocks("<b>x<p>y</b>z &amp;amp; <a href='a>b'>l</a><")[0] == ["x", "yz &amp; l<"]


@pytest.mark.parametrize("url,want", [(None, ("", "/")), ("http://A.example:80/x/y?q#f", ("a.example", "/x/y")), ("//h/p", ("h", "/p")), ("https://u@h.com", ("h.com", "/"))])
def test_urls(url, want):
    assert html_text.split_url(url) == want


def test_shared_is_a_longest_common_subsequence():
    a, b = list("abcxdef"), list("zabydcf")
    assert len(html_text.shared(a, b)) == 4 and html_text.shared(a, []) == set()


def test_pages_without_marks_lose_what_neighbours_share(spark):
    page = lambda i: f"<div>Home of this site</div><p>Article number {i} has its own words about topic {i * 7}.</p><div>All rights kept {'©'}</div>"
    rows = [(i, f"http://h.example/a/{i}", page(i), "x", "y") for i in range(6)] + [(10, "http://one.example/a", page(10), "x", "y"), (11, None, None, "x", "y"), (12, "", "", "x", "y"), (11, None, None, "x", "y")]
    # Copies of one article aren't template.
    rows += [(20 + i, f"http://c.example/{i}", "<p>One and the same article text.</p><p>Another paragraph of it.</p>", "x", "y") for i in range(2)]
    rows += [(30, "http://m.example/a", PAGE, "x", "y"), (31, "http://m.example/b", PAGE.replace("First", "Second"), "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string")
    got = sorted(html_text.main_texts(df).collect(), key=lambda r: r.page_id)
    by = {r.page_id: r.text for r in got}
    assert [by[i] for i in range(6)] == [f"Article number {i} has its own words about topic {i * 7}." for i in range(6)]
    assert by[10].startswith("Home of") and by[11] == by[12] == "" and len(got) == len(rows)
    assert by[20].count("\n") == 1 and by[30].startswith("Title & more\nFirst para") and all(r.n_chars == len(r.text) for r in got)
    assert html_text.main_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [3, 40, 300])
def test_any_alignment_is_longest(n):
    rng = np.random.default_rng(n)
    a, b = ([f"line {x}" for x in rng.integers(0, n // 2, n)] for _ in range(2))
    table = [[0] * (n + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(n):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    found, at = [a[i] for i in sorted(html_text.shared(a, b))], iter(b)
    assert len(found) == table[n][n] and all(x in at for x in found)


def test_classes_of_content_stay():
    page = "<article><div class='article-header'><h1>Head</h1></div><p class='share-price'>12</p><p class='post-footer x'>End</p><div class='advert'>Buy</div></article>"
    assert html_text.blocks(page)[0] == ["Head", "12", "End"]
    assert html_text.blocks("<div class='entry-header'>Head</div><div id='cookie-notice'>c</div><div class='SiteFooter'>f</div><p class='share-price'>1</p>")[0] == ["Head", "1"]


def test_ranges_do_not_matter(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet").unionByName(spark.createDataFrame([(1000 + i, f"http://big.example/{i % 4}/{i:03}", f"<div>Menu {i % 5}</div><p>Own text {i}</p><div>Foot</div>") for i in range(90)], "page_id long, url string, html string"))
    want = sorted(map(tuple, html_text.main_texts(df, ranges=1).collect()))
    assert len(want) == df.count() and any("Own text 7" in t and "Foot" not in t for _, _, t, _ in want)
    for ranges in (4, 40):
        assert sorted(map(tuple, html_text.main_texts(df, ranges=ranges).collect())) == want


def test_page_query(spark):
    """The given pages mark their articles, so these are what a plain reading of the element gives."""
    import html

    rows = {r.page_id: r.text for r in html_text.op4_main_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for r in pages:
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = re.split(r"</?(?:p|br|h1|ul|li|div)[^>]*>", inner)
        plain = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in parts]
        assert rows[r.page_id] == "\n".join(p for p in plain if p)


def test_short_articles_in_a_long_template(spark):
    menu = "".join(f"<div>Entry {i} of the long menu that all pages of this site have</div>" for i in range(20))
    rows = [(i, f"http://long.example/a/{i}", f"{menu}<p>Short text {i * 7}.</p><div>A notice</div>") for i in range(6)]
    # Two copies of one article among others of the template keep their article.
    rows += [(10 + i, f"http://two.example/a/{i}", f"{menu}<p>Text {max(i, 1)} of its own.</p><p>More {max(i, 1)}.</p>") for i in range(5)]
    by = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [by[i] for i in range(6)] == [f"Short text {i * 7}." for i in range(6)]
    assert [by[10 + i] for i in range(5)] == [f"Text {max(i, 1)} of its own.\nMore {max(i, 1)}." for i in range(5)]


# ---- mixing ---------------------------------------------------------------------------------------


def plain_targets(sizes, share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    fixed, free, total = {}, set(names), share * sum(sizes.values())
    while free:
        per = (total - sum(fixed.values())) / sum(weight[n] for n in free)
        over = [n for n in free if per * weight[n] > cap * sizes[n]]
        if not over:
            return fixed | {n: per * weight[n] for n in free}
        for n in over:
            fixed[n] = cap * sizes[n]
            free.discard(n)
    return fixed


def test_mix_of_awkward_documents(docs, no_docs):
    rows = source_mix.mix_sources(docs).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        assert 0 <= r.copies <= 2 and (r.size or not r.copies)
    want = plain_targets(sizes)
    assert len(rows) == docs.count() and target.keys() == want.keys() and all(abs(target[s] - want[s]) < 1e-6 for s in want)
    assert all(r.source_size == sizes[r.source] for r in rows)
    again = source_mix.mix_sources(docs.repartition(3)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert source_mix.mix_sources(no_docs).count() == 0
    mixed = source_mix.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(1, 60)), f"s{i % 7 if i % 3 else 0}") for i in range(3000)]
    got = source_mix.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)


def test_mix_query(spark):
    docs = {r.doc_id: r for r in common.documents(spark, SF).collect()}
    words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for d, r in docs.items()}
    sizes = defaultdict(int)
    for d, r in docs.items():
        sizes[r.source] += words[d]
    want, taken, longest = plain_targets(sizes), defaultdict(int), defaultdict(int)
    rows = source_mix.op8_source_mix(spark, SF).collect()
    assert {r.doc_id: (r.size, r.source_size) for r in rows} == {d: (words[d], sizes[r.source]) for d, r in docs.items()} and len(rows) == len(docs)
    for r in rows:
        source = docs[r.doc_id].source
        assert abs(r.target - want[source]) < 1e-6 and r.taken in (0, r.size, 2 * r.size)
        taken[source] += r.taken
        longest[source] = max(longest[source], r.size)
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in want)


def test_transfer_keeps_words():
    for u in (0.0, 0.3, 0.999):
        for p, s, q, t in ((0.3, 5, 0.6, 9), (0.5, 100, 0.5, 1), (0.9, 2, 0.2, 70)):
            a, b = source_mix.transfer(p, s, q, t, u)
            assert abs(a * s + b * t - p * s - q * t) < 1e-9 and (a in (0.0, 1.0) or b in (0.0, 1.0)) and 0 <= a <= 1 and 0 <= b <= 1


# ---- the pipeline ---------------------------------------------------------------------------------


def plain_pieces(rows):
    """Multiset of what packing has to give for each row: (doc_id, piece, start, length, crc32)."""
    from test_tokens import plain

    out = Counter()
    for d, t in rows:
        ids = np.array([*plain(t), 1], "<u4")
        out.update((d, k, i, len(ids[i : i + 4096]), zlib.crc32(ids[i : i + 4096].tobytes())) for k, i in enumerate(range(0, len(ids), 4096)))
    return out


def check_stages(spark, start):
    """Each stage against a plain version over all that the one before it left; the last stage's pieces."""
    import hashlib

    import corpus_pipeline as p
    from test_dedup import brute_lines, groups
    from test_tokens import check_packing

    of = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    stages, before = dict(p.STAGES), start
    kept = common.written(stages["language"](spark, before, SF), "language")
    letters = Counter((d, t) for d, t in of(before) if re.search(r"[^\W\d_]", t or ""))
    assert not Counter(of(kept)) - letters and sum((letters - Counter(of(kept))).values()) <= 0.02 * sum(letters.values())
    lines = common.written(stages["lines"](spark, kept, SF), "lines")
    assert sorted((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in of(lines) if d is not None) == sorted((d, h) for d, *_, h in brute_lines(of(kept)) if d is not None)
    near = common.written(stages["near_copies"](spark, lines, SF), "near")
    rows, first, want = of(lines), {}, Counter()
    for (d, t), (_, n, c) in zip(rows, groups(rows, 5), strict=True):
        if n:
            first.setdefault(("id", c) if c is not None else ("none", t), []).append((d, t))
        else:
            want[d, t] += 1
    alone = {k: min(v, key=lambda r: (r[0] is None, r[0])) for k, v in first.items()}
    assert Counter(of(near)) == want + Counter(alone.values())
    mixed = common.written(stages["mixture"](spark, near, SF), "mixture")
    copies, rows = Counter(), Counter(of(near))
    for r in source_mix.mix_sources(near).collect():
        copies[r.doc_id] += r.copies
    assert Counter(d for d, _ in of(mixed)) == +copies and set(of(mixed)) <= set(rows) and max(Counter(of(mixed)).values()) <= 2
    for df in (kept, lines, near, mixed):
        assert df.columns == start.columns
    packed = stages["packing"](spark, mixed, SF).collect()
    check_packing(packed, 4096)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == plain_pieces(of(mixed))
    return packed


def test_stages_of_awkward_documents(spark, docs, no_docs):
    import corpus_pipeline as p

    check_stages(spark, docs)
    at = no_docs
    for name, stage in p.STAGES[:-1]:
        at = common.written(stage(spark, at, SF), name)
        assert at.columns == docs.columns
    assert p.STAGES[-1][1](spark, at, SF).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language", "lines", "near_copies", "mixture", "packing"]
    packed = check_stages(spark, common.documents(spark, SF))
    assert sorted(map(tuple, packed)) == sorted(map(tuple, p.run(spark, SF).collect()))
