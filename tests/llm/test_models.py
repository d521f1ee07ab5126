import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from barloom.llm import langid, lattice, quality, queries

SF = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", "  \n", "x", "a" * 5000, "漢字 テスト", "...!?", "same text", "same text"]


def odd(spark, texts=ODD):
    return spark.createDataFrame([(i, t, "zz", 1.5) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score double")


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


# -- language identification


def list_profile(texts):
    count = Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            p = f" {w} "
            count.update(w)
            count.update(p[i : i + 2] for i in range(len(p) - 1))
            count.update(p[i : i + 3] for i in range(len(p) - 2))
    code = lambda g: (sum((ord(c) if c != " " else 0) << 18 * (len(g) - 1 - i) for i, c in enumerate(g)) << 2) | len(g)
    return [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], code(x[0])))][: langid.PROFILE]


def test_language_equals_brute_force(spark):
    docs = queries.table(spark, SF, "documents").limit(120).collect()
    df = spark.createDataFrame(docs)
    got = {r.doc_id: r for r in langid.predict(df, langid.fit(df)).collect()}
    known = {lang: list_profile([d.text for d in docs if d.lang == lang]) for lang in {d.lang for d in docs}}
    for d in docs:
        own = list_profile([d.text])
        far = {lang: sum(abs(p.index(g) - i) if g in p else langid.PROFILE for i, g in enumerate(own)) for lang, p in known.items()}
        best = min(sorted(far), key=far.get)
        assert got[d.doc_id].lang_pred == best
        assert got[d.doc_id].score == pytest.approx(1 - far[best] / (langid.PROFILE * len(own)))


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in queries.table(spark, SF, "documents").collect()}
    rows = queries.op7_language_profiles(spark, SF).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all((fold(r.doc_id) == 0) == r.held_out for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98


def test_language_in_blocks_and_declared(spark, monkeypatch):
    docs = spark.createDataFrame(queries.table(spark, SF, "documents").limit(60).collect())
    profiles = langid.fit(docs)
    plain = sorted((r.doc_id, r.lang_pred, r.score) for r in langid.predict(docs, profiles).collect())
    monkeypatch.setattr(langid, "AT_ONCE", 1)
    rows = langid.predict(docs, profiles, declared="lang").collect()
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in rows) == plain
    assert all(r.declared_score <= r.score and (r.declared_score == r.score or r.lang != r.lang_pred) for r in rows)
    other = langid.predict(docs.withColumn("lang", F.lit("zz")), profiles, lang="p", out="s", declared="lang", declared_out="d")
    assert {r.d for r in other.collect()} == {None} and other.columns[-3:] == ["p", "s", "d"]


def test_language_odd_rows(spark):
    df = odd(spark)
    profiles = langid.fit(spark.createDataFrame([("the thing", "en"), ("der die das", "de"), (None, "fr"), ("x", None)], "text string, lang string"))
    assert profiles.languages == ["de", "en"]
    rows = {r.doc_id: r for r in langid.predict(df, profiles).collect()}
    assert len(rows) == len(ODD)
    assert [rows[i].lang_pred for i in (0, 1, 2, 6)] == ["und"] * 4
    assert rows[7].lang_pred == rows[8].lang_pred == "en"
    assert langid.predict(odd(spark, []), profiles).count() == 0
    nothing = langid.fit(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}


# -- quality


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect()}
    rows = queries.op4_quality_network(spark, SF).collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    good = [r for r in held if labels[r.doc_id] == 1]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.97
    assert np.mean([r.predicted for r in good]) > 0.97


def test_quality_odd_rows_and_layout(spark):
    rows = quality.score(odd(spark), quality.fit([])).collect()
    assert [r.score for r in rows] == [0.5] * len(ODD)
    assert quality.score(odd(spark, []), quality.fit([])).count() == 0
    data = np.arange(1300, dtype=np.int64).astype(np.uint8)
    chunks, owner, size = quality.layout(data, np.array([0, 0, 1300]))
    assert owner.tolist() == [0, 1, 1, 1] and size.tolist() == [1, 512, 512, 276]
    assert (chunks[1] == data[:520]).all() and (chunks[2] == data[512:1032]).all() and (chunks[3, :276] == data[1024:]).all()
    nobody = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.sample(odd(spark), nobody) == []


def small_network(seed):
    rng = np.random.default_rng(seed)
    shape = [(256, quality.EMBED), (quality.WINDOW * quality.EMBED, quality.FILTERS), quality.FILTERS, quality.FILTERS]
    return quality.Network(*(rng.normal(0, 0.4, s) for s in shape), 0.3)


def plain_logit(net, chunk):
    """The forward pass of one laid-out chunk, filter by filter and window by window."""
    total = net.offset
    for f in range(quality.FILTERS):
        best = max(
            sum(net.embed[chunk[at + w], e] * net.kernel[w * quality.EMBED + e, f] for w in range(quality.WINDOW) for e in range(quality.EMBED))
            for at in range(0, quality.CHUNK, quality.STRIDE)
        )
        total += max(best + net.bias[f], 0) * net.dense[f]
    return total


def test_quality_forward_equals_plain_loops(spark):
    net = small_network(1)
    rng = np.random.default_rng(2)
    texts = ["", "short", "".join(map(chr, rng.integers(32, 127, 1200)))]
    want = []
    for t in texts:
        raw = t.encode()
        parts = [raw[i : i + quality.CHUNK + quality.WINDOW] for i in range(0, max(1, len(raw)), quality.CHUNK)]
        size = [max(1, min(quality.CHUNK, len(raw) - i)) for i in range(0, max(1, len(raw)), quality.CHUNK)]
        logit = sum(plain_logit(net, list(p.ljust(quality.CHUNK + quality.WINDOW, b"\0"))) * n for p, n in zip(parts, size, strict=True)) / sum(size)
        want.append(1 / (1 + math.exp(-logit)))
    got = quality.score(odd(spark, texts), net).orderBy("doc_id").collect()
    assert [r.score for r in got] == pytest.approx(want, rel=1e-4)


def test_quality_gradients_equal_finite_differences():
    net = small_network(3)
    rng = np.random.default_rng(4)
    x, y, weight = rng.integers(0, 256, (3, quality.CHUNK + quality.WINDOW)).astype(np.uint8), np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.5, 1.0])

    def loss():
        z = (quality._windows(net.embed[x]) @ net.kernel).reshape(len(x), quality.PER_CHUNK, quality.FILTERS).max(1)
        p = 1 / (1 + np.exp(-(np.maximum(z + net.bias, 0) @ net.dense + net.offset)))
        decay = sum((a**2).sum() for a in (net.embed, net.kernel, net.dense)) * 1e-4 / 2
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean() + decay

    grads = quality._gradients(net, x, y, weight, net.offset)
    for array, grad in zip((net.embed, net.kernel, net.bias, net.dense), grads, strict=False):
        for at in rng.integers(0, array.size, 12):
            flat, step = array.reshape(-1), 1e-6
            old = flat[at]
            flat[at] = old + step
            up = loss()
            flat[at] = old - step
            down = loss()
            flat[at] = old
            assert grad.reshape(-1)[at] == pytest.approx((up - down) / (2 * step), abs=2e-5)
    net.offset += 1e-6
    up = loss()
    net.offset -= 2e-6
    assert grads[4][0] == pytest.approx((up - loss()) / 2e-6, abs=2e-5)


def test_quality_sample_takes_every_chunk_and_clashing_names(spark):
    texts = [(i, f"text {i} " * (400 if i == 3 else 1)) for i in range(8)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("k", "y", "chunk", "score")})
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] + [(None, 1), (5, 0), (7, None)], "doc_id long, quality int").withColumn("k", F.lit(9)).withColumn("y", F.lit(9))
    rows = quality.sample(docs, labels)
    assert sorted({(r.k, r.y) for r in rows}) == [(0, 0), (1, 1), (2, 0), (3, 1), (4, 0), (5, 0), (6, 0)]
    assert sum(r.k == 3 for r in rows) == -(-len(texts[3][1]) // quality.CHUNK)
    assert len({r.k for r in quality.sample(docs, labels, max_rows=2)}) == 2
    scored = quality.score(docs, quality.fit(rows, epochs=1))
    assert scored.count() == 8 and scored.columns[-1] == "score" and {r.k for r in scored.collect()} == {"clash"}


# -- lattice


def brute_word(word, table):
    """Sum over all segmentations, by recursion."""
    total = 0.0
    for cut in range(1, len(word) + 1):
        if word[:cut] in table:
            total += table[word[:cut]] * (brute_word(word[cut:], table) if cut < len(word) else 1.0)
    return total


def test_lattice_sums_all_segmentations():
    table = {bytes([b]): 0.01 for b in range(256)} | {b"ab": 0.1, b"abc": 0.05, b"bc": 0.07, "▁a".encode(): 0.2}
    pieces = lattice.Pieces(list(table), np.log(list(table.values())))
    words = ["▁abcab".encode(), b"", b"abcabc", b"z", "▁".encode()]
    got, expected = pieces.forward(words, np.array([1, 1, 2, 1, 1]))
    for w, p in zip(words, got, strict=True):
        assert p == pytest.approx(math.log(brute_word(w, table)) if w else 0.0)
    # Expected counts cover every byte of every word once.
    assert sum(e * len(n) for e, n in zip(expected, pieces.names, strict=True)) == pytest.approx(8 + 12 + 1 + 3)


def test_base_score_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "B", "cc", "Dé", "e\x0b"]) for _ in range(rng.randint(0, 9))) for _ in range(60)] + [None, "", "only-here", "Zz " * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = df.where(langid.fold() != 1)
    cut = lambda t: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    count = Counter()
    for i, t in enumerate(texts):
        if fold(i) != 1:
            count.update([*cut(t), None])
    n, v = sum(count.values()), len(count)
    for frequent in (2, 1 << 17):
        lattice.FREQUENT, before = frequent, lattice.FREQUENT
        rows = lattice.score(df, MODEL, train=train, keep=("doc_id",), buckets=3).collect()
        lattice.FREQUENT = before
        assert len(rows) == len(texts)
        for r in rows:
            own = [*cut(texts[r.doc_id]), None]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[w] > 0 for w in own), n)
            assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
            assert r.score < 0


def test_lattice_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lattice.score(df, MODEL, keep=("doc_id",)).count() == 0
    one = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    (row,) = lattice.score(one, MODEL, train=df, keep=("doc_id",)).collect()
    assert row.n_known == 0 and row.train_tokens == 0 and row.score < 0


def plain_counts(words, table):
    """Expected piece counts over all segmentations, by forward and backward sums."""
    out = Counter()
    for word, times in words.items():
        n = len(word)
        a, b = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        arcs = [(i, j, word[i:j]) for i in range(n) for j in range(i + 1, n + 1) if word[i:j] in table]
        for i, j, piece in arcs:
            a[j] += a[i] * table[piece]
        for i, j, piece in reversed(arcs):
            b[i] += table[piece] * b[j]
        for i, j, piece in arcs:
            out[piece] += times * a[i] * table[piece] * b[j] / a[n]
    return out


@pytest.mark.parametrize("rounds", [0, 1])
def test_lattice_score_of_texts_equals_brute_force(spark, rounds):
    texts = ["the cat sat on the mat", "the dog", None, "a cat and a dog sat", "Zebra 12", "", "the the the"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [t for i, t in enumerate(texts) if fold(i) != 1]
    cut = lambda t: ["▁".encode() + w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())]
    names, log_weight = lattice.Pieces.read(MODEL)
    table = dict(zip(names, np.exp(log_weight), strict=True))
    words = Counter(w for t in train for w in cut(t))
    if rounds:
        counted = plain_counts(words, table)
        table = {p: w * lattice.PRIOR + counted[p] for p, w in table.items()}
        whole = sum(table.values())
        table = {p: w / whole for p, w in table.items()}
    tokens = sum(words.values()) + len(train)
    end = len(train) / tokens
    rows = lattice.score(df, MODEL, train=df.where(langid.fold() != 1), keep=("doc_id",), rounds=rounds, buckets=3).collect()
    for r in rows:
        own = cut(texts[r.doc_id])
        assert r.score == pytest.approx(sum(math.log10(brute_word(w, table)) + math.log10(1 - end) for w in own) + math.log10(end), rel=1e-9)
    with pytest.raises(ValueError, match="score"):
        lattice.score(df.withColumn("Score", F.lit(1)), MODEL, keep=("Score",))
