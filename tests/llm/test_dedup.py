"""Line and near duplicates, and fingerprints, against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from support import SF, same

from pyspark.sql import functions as F

from rootflow.llm import common, fingerprints, line_dedup, near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if c < "\x80" else c for c in t)


def shingles(text, k):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def groups(rows, k):
    """Smallest id of each row's group, from all pairs; a text's rows are one node each."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return [(d, len(s), min(least[find(i)], default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def mutated(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("k", [2, 5])
def test_near_groups_of_awkward_documents(docs, k):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_groups(docs, k).collect()), key=repr)
    assert got == sorted(groups([(r.doc_id, r.text) for r in docs.collect()], k), key=repr)


def test_near_groups_of_dense_and_chained_copies(spark):
    rng = random.Random(5)
    rows = []
    for g in range(6):
        base = [f"w{g}x{rng.randrange(400)}" for _ in range(120)]
        for _ in range((3, 40, 8, 1, 25, 12)[g]):
            base = mutated(rng, base, rng.choice((0, 1, 3, 6))).split() if g % 2 else base
            rows.append(mutated(rng, base, rng.randrange(7)))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())
    assert got == groups(rows, 2)


def template_rows(n, seed=11):
    """Documents of one template, most not linked (0.77), every second one with a partner (0.825) elsewhere in the table."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(330)]
    rows = []
    for g in range(n // 2):
        own = [f"o{g}x{i}" for i in range(13)]
        rows += [" ".join(template + own + [f"p{g}s{side}x{i}" for i in range(36)]) for side in range(2)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_groups_of_one_template(spark):
    rows = template_rows(400)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_groups(df, 2).collect())
    want = groups(rows, 2)
    assert len({c for *_, c in want}) == 200 and got == want


def classes_of(df):
    sigs = near_dedup.signatures(df, 2)
    return common.written(sigs.select(F.col("doc_id").alias("cls"), F.col("n_shingles").alias("n"), "sig", F.struct("doc_id", "text_key").alias("first")), "classes")


def joined(pairs, n):
    """The groups that pairs make of 0 ... n - 1."""
    up = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    return up


def test_blocks_connect_what_a_whole_region_connects(spark):
    classes = classes_of(spark.createDataFrame(template_rows(120), "doc_id long, text string"))
    whole = {(r.a, r.b) for r in near_dedup.candidates(classes).collect()}
    assert joined(whole, 120) == [0] * 120 and len(whole) <= near_dedup.TREES * 119
    assert joined({(r.a, r.b) for r in near_dedup.candidates(classes, block=16).collect()}, 120) == [0] * 120


def test_links_block_by_block(spark):
    rows = template_rows(120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes = classes_of(df)
    grouped = classes.select(F.col("cls").alias("node"), F.lit(0).cast("long").alias("label"))
    want = groups(rows, 2)
    for block in (1 << 20, 3000):
        got = {r.node: r.label for r in near_dedup.links(df, classes, grouped, 2, 80, block).collect()}
        same_group = defaultdict(set)
        for i in range(120):
            same_group[got.get(i, i)].add(i)
        assert sorted(min(x) for x in same_group.values() for _ in x) == sorted(c for *_, c in want)


def test_linked_sets():
    rng = np.random.default_rng(4)
    base = rng.choice(10**6, 100, replace=False).astype(np.uint64)
    sets = []
    for i in range(40):
        own = base.copy() if i % 3 else rng.choice(10**6, 100).astype(np.uint64)
        own[: i % 13] = rng.integers(10**7, 10**8, i % 13)
        sets.append(np.unique(own))
    near = lambda x, y: 100 * (c := len(np.intersect1d(x, y))) >= 80 * (len(x) + len(y) - c)
    pairs = [(i, j) for i in range(40) for j in range(i) if near(sets[i], sets[j])]
    assert near_dedup.linked(sets, 80).tolist() == joined(pairs, 40)
    side = np.arange(40) % 2 == 1
    assert near_dedup.linked(sets, 80, side).tolist() == joined([(i, j) for i, j in pairs if side[i] != side[j]], 40)


def test_long_texts_share_hashes_only_with_their_copies(spark):
    n, many = 100_000, 12
    texts = [[f"{g}x{i}" for i in range(n)] for g in range(many)]
    rows = [(g, " ".join(w)) for g, w in enumerate(texts)] + [(many + g, " ".join(w[: n - n // 10])) for g, w in enumerate(texts)]
    classes = classes_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(sorted((r.a, r.b))) for r in near_dedup.candidates(classes).collect()} == {(g, many + g) for g in range(many)}


def test_one_of_each_group_keeps_what_resembles_nothing(spark, docs, no_docs):
    kept = near_dedup.one_of_each_group(docs, 5)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    first = {}
    for (d, t), (_, n, c) in zip(rows, groups(rows, 5), strict=True):
        if n:
            first.setdefault(c, []).append((d, t))
    want = [(d, t) for (d, t), (_, n, _) in zip(rows, groups(rows, 5), strict=True) if not n]
    want += [min(v, key=lambda r: (r[0] is None, r[0])) for v in first.values()]
    assert got == sorted(want, key=repr) and (15, "another text of the same id") in got and (None, "no id here") in got
    assert near_dedup.one_of_each_group(no_docs).count() == 0


def test_near_query_matches_sql(spark, duck):
    same(near_dedup.op3_near_dedup(spark, SF), duck, near_dedup.OP3_SQL)


def test_nothing_to_compare(spark, no_docs):
    assert near_dedup.near_groups(no_docs).count() == 0
    one = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_groups(one).collect()) == [(1, 1, True), (2, 2, True)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.label for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(len(want)):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


def brute_lines(rows, least=40, many=5):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(list)
    for d, t in set(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least:
                holders[k].append(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        rank = lambda v: (v is not None, v)
        gone = [len(holders[key(x)]) >= many and rank(d) < rank(max(holders[key(x)], key=rank)) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((d, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_lines_of_awkward_documents(docs):
    from pyspark.sql import functions as F

    runs = line_dedup.with_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    lines = line_dedup.lines_of(F.col("text"))
    got = runs.select("doc_id", F.size(lines), line_dedup.n_dropped(F.col("keep_runs")), F.sha2(F.array_join(line_dedup.kept_lines(lines, F.col("keep_runs")), "\n"), 256)).collect()
    want = brute_lines([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and sum(w[2] for w in want) == 5
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.where("doc_id = 10").first().text == "b" and out.where("doc_id = 10").first().n_chars == 1


@pytest.mark.parametrize("ranges", [1, 7])
def test_keys_over_borders_of_ranges(spark, monkeypatch, ranges):
    rng = random.Random(3)
    hot = ["Q" * 45, "R" * 50 + " x"]
    rows = [(d, "\n".join(rng.sample([*hot, *hot, f"a line that only a few of them have, number {rng.randrange(12):04d}", "short", "z" * 60 + str(d)], rng.randrange(1, 7)))) for d in range(60)]
    rows += [(3, "Q" * 45), (None, hot[0] + "\n" + hot[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ranged = common.written(line_dedup.line_ranges(df, ranges=ranges), "ranged")
    monkeypatch.setattr(line_dedup, "line_ranges", lambda *_: ranged)
    key = lambda x: lower(x.strip())
    got = {(r.doc_id, r.row_key): r.keep_runs for r in line_dedup.keep_bitmaps(df).collect()}
    docs = line_dedup.with_bitmaps(df, line_dedup.keep_bitmaps(df))
    lines = line_dedup.lines_of(F.col("text"))
    found = docs.select("doc_id", F.size(lines), line_dedup.n_dropped(F.col("keep_runs")), F.sha2(F.array_join(line_dedup.kept_lines(lines, F.col("keep_runs")), "\n"), 256)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute_lines(rows), key=repr) and got
    spans = ranged.groupBy("h1", "h2").agg(F.countDistinct("range").alias("n")).agg(F.max("n")).first()[0]
    assert spans > 1 or ranges == 1
    if ranges > 1:  # the order decides: rows dealt to ranges at random lose the first occurrences
        monkeypatch.setattr(line_dedup, "line_ranges", lambda *_: ranged.withColumn("range", F.pmod(F.xxhash64("row_key"), F.lit(7)).cast("int")))
        assert {(r.doc_id, r.row_key): r.keep_runs for r in line_dedup.keep_bitmaps(df).collect()} != got


def test_runs(spark):
    from pyspark.sql import functions as F

    for dropped in ([], [0], [0, 1, 4], [3], [2, 3, 7, 8, 9]):
        d = F.array(*[F.lit(x) for x in dropped]).cast("array<int>")
        lines = F.array(*[F.lit(str(i)) for i in range(10)])
        got = spark.range(1).select(line_dedup.kept_lines(lines, line_dedup.runs_of(d)).alias("x"), line_dedup.n_dropped(line_dedup.runs_of(d)).alias("n")).first()
        assert got.x == [str(i) for i in range(10) if i not in dropped] and got.n == len(dropped)


def test_line_query_matches_sql(spark, duck, no_docs):
    same(line_dedup.op9_line_dedup(spark, SF), duck, line_dedup.OP9_SQL)
    assert line_dedup.keep_bitmaps(no_docs).count() == 0


def test_line_plan_has_no_python(spark):
    plan = line_dedup.op9_line_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fingerprints_of_awkward_documents(docs, no_docs):
    got = fingerprints.edit_report(docs).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0]), reverse=True)
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0), reverse=True)] == [d for d, _ in rows]
    unique = [i for i, (d, _) in enumerate(rows) if d not in (15, None, 1) and rows[i + 1][0] != 15]
    by = {r.doc_id: r for r in got}
    for i in unique:
        d, t = rows[i]
        e = fingerprints.edited(t, rows[i + 1][1])
        assert by[d].n_chars == len(t) and by[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert by[d].edited_fingerprint == fingerprints.fingerprint_texts([e.encode()])[0]
    assert by[1].fingerprint == by[2].fingerprint and by[2].near_next == 1.0
    assert fingerprints.edit_report(no_docs).count() == 0
    assert fingerprints.edit_report(docs.where("doc_id = 8")).first().near_next == 1.0


def test_estimates_are_near_the_truth():
    rng = random.Random(1)
    errors = []
    for _ in range(40):
        a = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((3, 30, 300, 2000)))]
        b = mutated(rng, a, rng.randrange(max(1, len(a) // 20)))
        x, y = fingerprints.fingerprint_texts([" ".join(a).encode(), b.encode()])
        s, t = shingles(" ".join(a), 5), shingles(b, 5)
        errors.append(fingerprints.likeness(x, y) - len(s & t) / len(s | t))
    assert abs(np.mean(errors)) < 0.03 and np.sqrt(np.mean(np.square(errors))) < 0.06


def test_fingerprint_query(spark):
    rows = sorted(((r.doc_id, r.text or "") for r in common.documents(spark, SF).collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.op6_fingerprints(spark, SF).collect()}
    sets, off_edited, off_next = {d: shingles(t, 5) for d, t in rows}, [], []
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)]
        m = len(t) // 2
        edited = t[: len(t) - m] + after[1][:m]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        off_edited.append(r.near_edited - near(sets[d], shingles(edited, 5)))
        off_next.append(r.near_next - near(sets[d], sets[after[0]]))
    assert np.sqrt(np.mean(np.square(off_edited))) < 0.06 and np.sqrt(np.mean(np.square(off_next))) < 0.06
    same_text = defaultdict(set)
    for d, t in rows:
        same_text[t].add(got[d].fingerprint)
    assert all(len(v) == 1 for v in same_text.values())
