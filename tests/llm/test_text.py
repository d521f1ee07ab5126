import gzip
import random
import subprocess
import sys
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import components, decontam, html, jaccard, langid, quality, queries, warc
from tests.llm.test_models import fold, list_profile

SF = "/root/testdata/sf0.001"


def words(text):
    return [w for w in (text or "").lower().encode().split()]


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_classes(rows, k, t):
    sets = [shingles(x, k) for _, x in rows]
    up = list(range(len(rows)))
    find = lambda i: i if up[i] == i else find(up[i])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) or rows[i][0] == rows[j][0] and sets[i] and sets[j]:
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d))
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("k", "t", "small"), [(3, Fraction(9, 10), False), (5, Fraction(4, 5), False), (3, Fraction(9, 10), True), (5, Fraction(4, 5), True)])
def test_jaccard_equals_brute_force(spark, monkeypatch, k, t, small):
    if small:  # every token is dealt to several tasks, listed by two tokens and matched in many buckets
        for name, size in (("HOT", 3), ("CROWD", 0), ("BUCKET", 50)):
            monkeypatch.setattr(jaccard, name, size)
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(50)]
    rows = [(10, None), (11, ""), (12, " \n"), (13, "one"), (14, "ONE"), (15, "one two"), (15, "one two three")]
    for g in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 40, 120]))]
        for c in range(25):
            text = list(base)
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((100 + g * 30 + c, " ".join(text)))
    rows += [(i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(400, 430)]
    rows += [(500 + i, rows[40][1]) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit(1)).withColumn("n", F.lit("clash"))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(df, k, t).collect())
    assert got == brute_classes(rows, k, t)


def test_jaccard_empty(spark):
    assert jaccard.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("sparse", [True, False])
def test_jaccard_sets_use_one_worker_a_task(spark, monkeypatch, sparse):
    if not sparse:
        monkeypatch.setattr(jaccard, "SPARSE", 0)
    rows = [(i, f"w{i} w{i % 7} w{i % 5} w{i % 3}") for i in range(300)] + [(6, "another text of six"), (None, "w1 w2 w3"), (9, None)]
    wanted = spark.createDataFrame([(i,) for i in range(0, 300, 3)], "doc_id long")
    sets = jaccard._sets(spark.createDataFrame(rows, "doc_id long, text string"), wanted, 3)
    plan = sets._jdf.queryExecution().executedPlan().toString()
    python, joins = plan.count("MapInArrow"), plan.count("SortMergeJoin")
    assert (python, joins, plan.count("BroadcastHashJoin")) == ((1, 0, 0) if sparse else (2, 1, 0))  # with two, an exchange is between them
    got = sorted((r.rep, r.n, len(set(r.tokens))) for r in sets.collect() if r.rep is not None and r.rep % 3 == 0)
    assert got == sorted((i, len(shingles(x, 3)), len(shingles(x, 3))) for i, x in rows if i is not None and i % 3 == 0)


def test_classes_of_characters_load_no_pandas():
    code = "import sys; before = 'pandas' in sys.modules; from barloom.llm import decontam, jaccard, langid, quality; sys.exit('pandas' in sys.modules and not before)"
    assert subprocess.run([sys.executable, "-c", code], check=False).returncode == 0


def test_jaccard_null_ids_and_a_group_of_a_third(spark):
    rows = [(None, "a b c d e f"), (None, "x y z"), (9, "a b c d e f")] + [(100 + i, "one text that very many rows hold") for i in range(300)] + [(500 + i, "") for i in range(300)] + [(1000 + i, f"alone number {i}") for i in range(300)]
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == sorted(
        [(-1, 4, 9), (-1, 1, -1), (9, 4, 9)] + [(100 + i, 5, 100) for i in range(300)] + [(500 + i, 0, 500 + i) for i in range(300)] + [(1000 + i, 1, 1000 + i) for i in range(300)]
    )


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1050)] + [(7, 7), (None, 3), (2000, 2001), (2001, 2000)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1050), 1000), 2000: 2000, 2001: 2000}


# -- decontamination


def reduce(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return decontam.reduce_texts(raw, np.array([0, len(raw)]))[0].tobytes().strip()


def distance(p, t):
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        new = [0]
        for i, x in enumerate(p, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
        row, best = new, min(best, new[-1])
    return best


def test_best_match_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(200):
        p, t = (bytes(rng.choice(b"abc") for _ in range(rng.randint(lo, 25))) for lo in (1, 0))
        got = decontam.best_match(p, t, len(p))
        assert got[0] == distance(p, t)
        assert decontam.best_match(p, t, got[0] - 1) is None


def test_planted_passages_are_found(spark):
    rng = random.Random(2)
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    clean = [(d, t) for d, t in docs if not any(reduce(x) in reduce(t) for _, x in items)]
    planted, want = [], set()
    for n, (i, x) in enumerate(items):
        d, t = clean[n % len(clean)]
        cut = rng.randint(0, len(t))
        planted.append((10_000 + n, t[:cut] + " " + x.upper().replace(" ", "  ") + " " + t[cut:]))
        want.add((10_000 + n, i))
    rows = clean + planted + [(1, None), (2, ""), (3, "x" * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([*items, (98, None), (99, "short")], "item_id long, text string")
    got = decontam.matches(df, bench).collect()
    assert want <= {(r.doc_id, r.item_id) for r in got}
    texts, passages = dict(rows), dict(items)
    for r in got:
        limit = decontam.allowed_edits(len(reduce(passages[r.item_id])), 0.8)
        assert r.distance <= limit
        assert distance(reduce(passages[r.item_id]), reduce(texts[r.doc_id][r.begin : r.end])) <= r.distance + 1
    kept = {r.doc_id for r in decontam.clean(df, bench).collect()}
    assert kept == {d for d, _ in rows} - {r.doc_id for r in got}
    assert decontam.matches(df.limit(0), bench).count() == 0 and decontam.matches(df, bench.limit(0)).count() == 0


def test_edited_passages_reach_the_target_recall(spark):
    rng = random.Random(4)
    items = [reduce(r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    known = decontam.Items.build(list(range(len(items))), items)
    hits = 0
    for i, x in enumerate(items):
        edited = bytearray()
        for c in x:
            r = rng.random()
            if r > 0.05 / 3:
                edited.append(c if r > 0.1 / 3 else rng.choice(b"abcdefgh "))
            if r > 1 - 0.05 / 3:
                edited.append(rng.choice(b"abcdefgh "))
        text = np.frombuffer(b"some other words " * rng.randint(1, 5) + bytes(edited) + b" and the rest", np.uint8)
        hits += any(f[1] == i for f in decontam._find(known, text, np.array([0, len(text)]), 0.8))
    assert hits / len(items) >= 0.95


def edited(x, share, rng):
    """``x`` (bytes or str) with exactly that share of random insertions, deletions and replacements."""
    other = [x[:0], *("abcdefgh " if isinstance(x, str) else (bytes([c]) for c in b"abcdefgh "))]
    out = [x[i : i + 1] for i in range(len(x))]
    for p in rng.sample(range(len(x)), int(len(x) * share + 1e-9)):
        kind = rng.randrange(3)
        out[p] = other[0] if kind == 0 else rng.choice(other[1:]) + (out[p] if kind == 2 else other[0])
    return x[:0].join(out)


@pytest.mark.parametrize("symbols", [64, 120, None])
@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.2])
def test_recall_reaches_the_stated_similarity(spark, symbols, share):
    rng = random.Random(7)
    items = [reduce(r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    items = [x[:symbols].strip() for x in items if len(x) >= (symbols or 0)]
    texts = [b"some other words " * rng.randint(1, 5) + edited(x, share, rng) + b" and the rest" for x in items]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    known = decontam.Items.build(list(range(len(items))), items)
    found = {(t, i) for t, i, *_ in decontam._find(known, np.frombuffer(b"".join(texts), np.uint8), at, 0.8)}
    assert sum((i, i) in found for i in range(len(items))) / len(items) >= 0.97


def test_matches_equal_brute_force_over_every_pair(spark):
    rng = random.Random(9)
    passages = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    items = [(i, reduce(x)) for i, x in passages]
    rows = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    for n, (_, x) in enumerate(passages):
        rows.append((10_000 + n, "before it " + edited(x, (0.05, 0.1, 0.15, 0.18)[n % 4], rng) + " after it"))
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.matches(spark.createDataFrame(rows, "doc_id long, text string"), queries.table(spark, SF, "benchmark")).collect()}
    want = {}
    for d, t in rows:
        symbols = reduce(t or "")
        for i, x in items:
            if best := decontam.best_match(x, symbols, decontam.allowed_edits(len(x), 0.8)):
                want[d, i] = best[0]
    assert len(want) >= len(items) and got == want


def test_repeated_rows_and_items(spark):
    passage = "the quick brown fox jumps over the lazy dog by the river"
    docs = spark.createDataFrame([(1, passage), (1, passage), (None, passage), (2, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, passage), (5, passage), (5, passage.upper()), (6, passage)], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.distance) for r in decontam.matches(docs, bench.distinct()).collect())
    assert got == sorted((d, i, 0) for d in (0, 1, 1) for i in (5, 5, 6))
    assert [r.doc_id for r in decontam.clean(docs, bench).collect()] == [2]


def test_short_and_nameless_items(spark):
    rows = [(1, "see: What is PI? now"), (2, "what is pie"), (3, "Yes!"), (4, "yes it is"), (5, "x 今天天气怎么样呢。 y"), (6, "what is pi"), (7, ""), (8, "a nameless passage of some length here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "what is pi"), (2, "yes"), (3, "今天天气怎么样呢"), (None, "nameless passage of some length"), (4, "?!")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.begin, r.end) for r in decontam.matches(df, bench).collect()}
    assert got == {(1, 1, 5, 15), (6, 1, 0, 10), (3, 2, 0, 3), (5, 3, 2, 10)}
    assert {r.doc_id for r in decontam.clean(df, bench).collect()} == {2, 4, 7}
    assert decontam.matches(df, bench.where("item_id = 2")).count() == 1


# -- WARC


def test_audit_finds_every_fault(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 1000)
    monkeypatch.setattr(warc, "FANOUT", 3)
    rows = [(i % 3, 100 * (i // 3), 100, f"d{i}") for i in range(600)] + [(None, 0, 1, "x"), (0, None, 1, "x")]
    other = [(a, o, n, "bad" if (a, o) == (1, 500) else d) for a, o, n, d in rows if (a, o) not in {(2, 19900), (0, 0)}] + [(1, 50, 7, "new"), (7, 0, 9, "whole")]
    kind = "archive long, byte_offset long, n_bytes long, digest string"
    a, b = spark.createDataFrame(rows, kind), spark.createDataFrame(other, kind)
    got = {(r.archive, r.byte_offset): r.state for r in warc.audit(a, b).collect()}
    assert got == {(1, 500): "changed", (2, 19900): "missing", (0, 0): "missing", (1, 50): "extra", (7, 0): "extra"}
    assert warc.audit(a, a).count() == 0 and warc.audit(a.limit(0), b.limit(0)).count() == 0


def test_records_round_trip_through_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "<p>é</p>"), (2, None, ""), (3, "u", None), (3, "u", None), (None, "n", "x")], "page_id long, url string, html string")
    placed = warc.archive(pages)
    rows = placed.withColumn("raw", warc.record_bytes(F.col("page_id"), F.col("url"), F.col("html"))).orderBy("archive", "byte_offset").collect()
    raw = b"".join(bytes(r.raw) for r in rows if r.archive == 0)
    (tmp_path / "a.warc").write_bytes(raw)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(raw))
    want = [(r.byte_offset, r.n_bytes, (r.html or "").encode()) for r in rows if r.archive == 0]
    read = warc.read(spark, str(tmp_path)).collect()
    for name in ("a.warc", "b.warc.gz"):
        assert sorted((r.byte_offset, r.n_bytes, bytes(r.body)) for r in read if r.archive.endswith(name)) == sorted(want)


def test_audit_of_pages_without_ids_and_repeated_pages(spark):
    rows = [(i, f"u{i}", f"<p>{i}</p>") for i in range(40)] + [(None, f"n{i}", f"<p>{i}</p>") for i in range(40)] + [(7, "u7", "<p>7</p>")] * 3 + [(None, None, None)] * 2 + [(8, "u8", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("archive", F.lit("clash")).withColumn("_body", F.lit("clash"))
    sha = lambda c: F.sha2(warc.record_bytes(F.col("page_id"), F.col("url"), c), 256)
    placed = warc.archive(pages, per_archive=16, keep=("page_id", "url"), digest=sha(F.col("html")), other=sha(F.when(F.col("url") == "n3", "bad").otherwise(F.col("html"))))
    found = placed.collect()
    assert len(found) == len(rows) and len({r.archive for r in found if r.page_id is None}) > 20 and all((r.archive < 0) == (r.page_id is None) for r in found)
    for number in {r.archive for r in found}:
        at = 0
        for r in sorted((r for r in found if r.archive == number), key=lambda r: r.byte_offset):
            assert r.byte_offset == at
            at += r.n_bytes
    bad = warc.audit(warc.leaves(placed, F.col("digest")), warc.leaves(placed.where("url is null or url <> 'n4'"), F.col("other"))).collect()
    assert sorted(r.state for r in bad) == ["changed", "missing"]


# -- HTML


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, None),
        ("", ""),
        ("<p>a<p>b <b>c", "a\n\nb c"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<div>a</div><div>b</div>", "a\nb"),
        ("<ul><li>a<li>b<ol><li>c<li>d</ol></ul>e", "* a\n* b\n  1. c\n  2. d\n\ne"),
        ("<table><tr><th>Name<th>N<tr><td>x<td>12<tr><td>longer<td>3</table>", "Name    N\nx       12\nlonger  3"),
        ("<p hidden>a</p><p style='DISPLAY : none'>b</p><script>c</script><!-- d --><title>e</title>f", "f"),
        ("<pre>\n a\n   b</pre>c", " a\n   b\n\nc"),
        ("x &lt; y &amp;amp; &copy;", "x < y &amp; ©"),
        ("<dl><dt>t<dd>d</dl>", "t\n    d"),
        ("<script>never closed", ""),
        ("<div>" * 3000 + "deep", "deep"),
        ("3 < 4 > 2", "3 < 4 > 2"),
        ("<html><head><title>t</title><p>Hello", "Hello"),
        ("<html><head><title>t</title>\n<style>s</style>Hello <b>you</b>", "Hello you"),
        ("<head><title>t</title><meta name=x><noscript><img alt=n></noscript><template><p>u</template><div>a</div></head><body>b", "a\nb"),
        ("<head><title>t</title></head><p>a<body><p>b", "a\n\nb"),
        ("<a title=don't>Hello world</a> It's late <b>x</b>", "Hello world It's late x"),
        ('<p class="a"">Hello</p>', "Hello"),
        ("<p a= >b</p><p 'x y'>c</p><p title='d > e' hidden>f</p><p =\"g>h</p><p class=a\"b hidden>i</p>", "b\n\nc\n\nh"),
        ('<p>x <a title="oops>link</a> y</p>', "x"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"),
        ("<table><tr><td rowspan=2 colspan=2>ab<td>c<tr><td>d<tr><td>1<td>2<td>3</table>", "ab    c\n      d\n1  2  3"),
        ("<table><tr><td colspan=999>a<td>b</table>", "a  b"),
        ("<div style='visibility:hidden'>a <b style='visibility:visible'>shown</b> c<p>d</div>e", "shown\n\ne"),
        ("<table><tr><td style='visibility: hidden'>aa<td>b<tr><td>cc<td>d</table>", "    b\ncc  d"),
        ("<style>.h, p .q {display:none} /* .r{display:none} */</style><p class='x h'>no</p><p>yes <i class=q>no</i></p><i class=q>q</i> <i class=r>r</i>", "yes\n\nq r"),
        ("<style>.h{display:none} #k.h{display:block} @media print{.r{display:none}} @media screen{.s{visibility:hidden}}</style><p class=h id=k>k</p><p class=r>r</p><p class=s>s</p><p class=h style='display:block'>t</p>", "k\n\nr\n\nt"),
        ("<style>.h{display:none!important}</style><p class=h style='display:block'>no</p><p hidden style='display:block'>yes", "yes"),
        ("<p style='content:\"x\";display : NONE ;'>a</p><pre>b <i style='visibility:hidden'>c</i>\nd</pre>", "b\nd"),
        ("<img alt = \"a > 'b'\"/><img alt=c/><br/>d<p" + " a" * 50_000 + ">e", "a > 'b'c/\nd\n\ne"),
    ],
)
def test_rendering(source, want):
    assert html.visible_text(source) == want


def test_every_visible_word_of_the_pages_is_kept(spark):
    rows = queries.op8_html_layout_text(spark, SF).collect()
    pages = {r.page_id: r.html for r in queries.table(spark, SF, "pages").collect()}
    assert len(rows) == len(pages)
    import re
    from html import unescape

    for r in rows:
        body = re.sub(r"(?s)<!--.*?-->|<head>.*?</head>|<(script|style)>.*?</\1>", " ", pages[r.page_id])
        assert re.sub(r"^\* ", "", r.text, flags=re.M).split() == unescape(re.sub(r"(?s)<[^>]*>", lambda m: " " if not re.match(r"</?(b|a)\b", m[0]) else "", body)).split()
    odd = spark.createDataFrame([(None, "x"), ("<p>a</p>", "x"), ("<p>a</p>", "x")], "html string, text string")
    assert [r.text for r in html.extract(odd).collect()] == [None, "a", "a"]


# -- pipeline


def brute_language(rows):
    """Ids that the stage keeps, by plain lists: profiles of the learnt rows, out-of-place distances and the margin."""
    learnt = {lang: list_profile([r.text for r in rows if r.lang == lang and fold(r.doc_id) != 0]) for lang in {r.lang for r in rows}}
    kept = set()
    for r in rows:
        own = list_profile([r.text])
        score = {lang: 1 - sum(abs(p.index(g) - i) if g in p else langid.PROFILE for i, g in enumerate(own)) / (langid.PROFILE * len(own)) for lang, p in learnt.items()} if own else {}
        if own and max(score.values()) - score[r.lang] <= corpus_pipeline.MARGIN:
            kept.add(r.doc_id)
    return kept


def test_pipeline_stages(spark):
    docs = queries.table(spark, SF, "documents")
    items = [reduce(r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    seen = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        before = seen
        out = stage(spark, spark.createDataFrame(before, docs.schema), SF)
        seen = out.collect()
        if name == "tokens":
            assert sorted(r.doc_id for r in seen) == sorted(r.doc_id for r in before)
            break
        assert out.columns == docs.columns and {tuple(r) for r in seen} <= {tuple(r) for r in before}
        kept = {r.doc_id for r in seen}
        if name == "near":
            assert kept == {c for _, _, c in brute_classes([(r.doc_id, r.text) for r in before], 5, Fraction(4, 5))}
        if name == "benchmark":
            assert kept == {r.doc_id for r in before if not any(x in reduce(r.text) for x in items)}
        if name == "quality":
            labels = queries.table(spark, SF, "labels")
            table = spark.createDataFrame(before, docs.schema)
            net = quality.fit(quality.sample(table, labels.where(langid.fold() != 0)))
            assert kept == {r.doc_id for r in quality.score(table, net).collect() if r.score >= corpus_pipeline.QUALITY}
            assert kept >= {r.doc_id for r in labels.where("quality = 1").collect() if fold(r.doc_id) != 0}
        if name == "language":
            assert kept == brute_language(before)


def test_pipeline_keeps_clashing_columns_when_chained_lazily(spark):
    docs = queries.table(spark, SF, "documents").limit(25).collect()
    odd = [(None, docs[0].text, docs[0].lang, "s", 1), (None, docs[0].text, docs[0].lang, "s", 1), (9001, docs[1].text, docs[1].lang, "s", 1), (9002, None, "en", "s", 0), (9003, "", "en", "s", 0), (9004, "12 34", "en", "s", 5)]
    odd += [(9005, docs[2].text, docs[2].lang, "s", 1), (9005, docs[3].text, None, "s", 1), (9005, docs[3].text, None, "s", 1)]
    table = spark.createDataFrame([*map(tuple, docs), *odd], queries.table(spark, SF, "documents").schema)
    clash = {c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in ("score", "quality", "_quality", "best", "best_score", "Own_Score", "lang_pred", "_text", "label", "component_id", "text_")}
    table = table.withColumns(clash)
    lazy, step = table, table.collect()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        lazy = stage(spark, lazy, SF)
        before = {str(r) for r in step}
        step = stage(spark, spark.createDataFrame(step, table.schema), SF).collect()
        assert lazy.columns == table.columns and {str(r) for r in step} <= before
    got = lazy.collect()
    assert sorted(map(str, got)) == sorted(map(str, step))
    assert all(r["_quality"] == "_quality" + ("" if r.doc_id is None else str(r.doc_id)) for r in got)
    ids = [r.doc_id for r in got]
    assert ids.count(None) == 2 * ids.count(docs[0].doc_id) and not {9002, 9003, 9004} & set(ids)
    assert 9001 not in ids or docs[1].doc_id not in ids


def test_repeated_ids_lose_no_text(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "h i j k l m n", "x"), (1, "h i j k l m n", "x"), (2, "a b c d e f g", "x"), (3, "other words that stand alone here", "x")]
    kept = corpus_pipeline.keep_distinct(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), SF).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted({r[:2] for r in rows if r[0] != 2})


def test_pipeline_of_an_empty_table(spark):
    docs = queries.table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (name == "tokens" or out.columns == docs.columns)
