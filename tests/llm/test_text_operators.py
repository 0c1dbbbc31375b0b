"""Operators on documents against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linelake.llm import components, decontaminate, hmm, jaccard, license, packing, quality, recompress, toxicity
from linelake.llm.common import WordHashes, alnum_words, rolling
from tests.llm.data import awkward, words


@pytest.fixture(scope="module")
def docs(spark):
    df, rows = awkward(spark)
    return df.cache(), rows


def components_of(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("width,percent,block,product", [(4, 85, 512, 4096), (4, 85, 4, 4096), (5, 80, 7, 8)])
def test_jaccard(spark, monkeypatch, width, percent, block, product):
    monkeypatch.setattr(jaccard, "PRODUCT", product)
    r = random.Random(5)
    base = [r.choices([f"w{i}" for i in range(400)], k=60) for _ in range(5)]
    near = []
    for i in range(90):
        b = list(r.choice(base))
        for _ in range(r.randint(0, 6)):
            b[r.randrange(60)] = f"x{r.randint(0, 9999)}"
        near.append((1000 + i, " ".join(b)))
    df, rows = awkward(spark, near)
    sets = {}
    for i, t in rows:
        w = words(t and t.lower() if t is None or t.isascii() else t)
        w = [x.lower() for x in w]
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    ids = [i for i in sets if i is not None]
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and (n := len(sets[a] & sets[b])) and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    want = components_of(ids, linked)
    got = jaccard.similar(df, width, percent, block=block).collect()
    assert len(got) == len(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got if x.doc_id is not None} == {i: (len(sets[i]), want[i]) for i in ids}
    kept = jaccard.near_duplicates(df, width=width, percent=percent)
    assert kept.columns == df.columns
    assert {x.doc_id for x in kept.collect() if x.doc_id is not None} == set(want.values())
    assert jaccard.similar(df.limit(0), width, percent).count() == 0


def test_sparse_and_dense_products_agree(monkeypatch):
    r = np.random.default_rng(3)
    for density in (0.02, 0.3, 0.9):
        sets = [np.flatnonzero(r.random(200) < density * r.random()).astype(np.uint64) for _ in range(70)]
        want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
        for dense, pairs in ((0, 100), (1000, 100), (8, 1 << 20)):
            monkeypatch.setattr(jaccard, "DENSE", dense)
            monkeypatch.setattr(jaccard, "PAIRS", pairs)
            assert (jaccard.overlaps(sets[:20], sets[20:]) == want[:20, 20:]).all()
            got = jaccard.overlaps(sets, sets)
            assert all(got[i, j] == want[i, j] for i in range(70) for j in range(70) if i != j)


def test_prefix_of_linked_sets_meets():
    r = np.random.default_rng(0)
    weight = r.integers(0, 3, jaccard.BUCKETS)
    for _ in range(300):
        a = np.unique(r.integers(0, 60, r.integers(1, 50)).astype(np.uint64))
        b = np.unique(np.append(a[r.random(len(a)) < 0.95], r.integers(0, 60, 2).astype(np.uint64)))
        n = len(np.intersect1d(a, b))
        assert jaccard.overlaps([a, b], [a, b])[0, 1] == n
        if jaccard.links(len(a), len(b), n, 80):
            assert len(np.intersect1d(jaccard.prefix(a, weight), jaccard.prefix(b, weight)))


def repeats_by_force(rows, window):
    seen, gone = {}, {}
    for i, t in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        w = words(t)
        g = gone.setdefault(i, [False] * len(w))
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if seen.setdefault(key, (i, p)) != (i, p):
                g[p : p + window] = [True] * window
    return gone


@pytest.mark.parametrize("window", [6, 20])
def test_substring_dedup(docs, window):
    df, rows = docs
    gone = repeats_by_force(rows, window)
    got = recompress.remove_repeats(df, window, layout=False).collect()
    assert len(got) == len(rows)
    for x in got:
        text = dict(rows).get(x.doc_id) if x.doc_id is not None else next(t for i, t in rows if i is None)
        w = words(text)
        g = gone.get(x.doc_id, [False] * len(w))
        assert (x._n_words, x._n_removed) == (len(w), sum(g))
        assert (x.text or "").encode() == b" ".join(a for a, b in zip(w, g) if not b)
    kept = recompress.remove_repeats(df, window, counts=False)
    assert kept.columns == df.columns and "_n_words" not in df.columns
    whole = {i: t for i, t in rows}
    for x in kept.collect():
        if x.doc_id is not None and not any(gone[x.doc_id]):
            assert x.text == whole[x.doc_id]
    assert recompress.remove_repeats(df.limit(0), window).count() == 0


@pytest.mark.parametrize("levels", [1, 4])
def test_equal_windows_have_equal_inner_symbols(levels):
    counted = 0
    for seed in range(60):
        r = random.Random(seed)
        voc = [b"a", b"b", b"c", b"d", b"e"][: r.choice([1, 2, 3, 5])]
        phrases = [r.choices(voc + [b"f", b"g"], k=20) for _ in range(3)]
        texts = []
        for _ in range(8):
            w = r.choices(voc + [b"u%d" % r.randint(0, 200) for _ in range(30)], k=r.randint(0, 40))
            i = r.randint(0, len(w))
            w[i:i] = r.choice(phrases)
            texts.append(b" ".join(w))
        w = recompress.Words(texts, WordHashes(), levels)
        number = {s: i for i, s in enumerate([*w.start.tolist(), len(w.h)])}
        at = {}
        for end, begin in zip(w.ends, w.begins):
            for p in range(begin, end - 11):
                lo, hi = int(w.later[p]), int(w.earlier[p + 12])
                inner = [(int(w.start[k]) - p, int(w.sym[k])) for k in range(number[lo], number[hi])] if lo < hi else []
                assert all(0 < d < 12 for d, _ in inner)
                counted += len(inner)
                assert at.setdefault(tuple(w.h[p : p + 12].tolist()), inner) == inner
        a, b = np.array([0, 3]), np.array([2, 3])
        assert w.digests(a, b)[1] == w.digests(b, b)[0]
    assert counted > 1000


def matches_by_force(texts, items, width):
    out = []
    for x in texts:
        w, hit, names = alnum_words(x), set(), set()
        for name, t in items:
            v = alnum_words(t)
            m = min(width, len(v))
            for i in range(len(v) - m + 1 if m else 0):
                for p in range(len(w) - m + 1):
                    if w[p : p + m] == v[i : i + m]:
                        hit |= set(range(p, p + m))
                        names.add(name)
        out.append((len(w), len(hit), sorted(names)))
    return out


@pytest.mark.parametrize("seed", range(25))
def test_suffix_arrays(seed):
    r = random.Random(seed)
    voc = [b"a", b"b", b"c", b"D", b"e"]
    texts = [b" ".join(r.choices(voc + [b"zz"], k=r.randint(0, 50))) for _ in range(5)]
    items = [(str(i), b"-".join(r.choices(voc[:3], k=r.randint(0, 9)))) for i in range(5)]
    assert [x[:3] for x in decontaminate.judge(texts, decontaminate.tests(items, 4))] == matches_by_force(texts, items, 4)


def test_decontamination(spark, docs):
    df, rows = docs
    r = random.Random(2)
    source = rows[9][1].split()
    items = [(1, " ".join(source[3:16]).upper()), (10, "a, B"), (2, None), (None, "w1"), (3, " ".join(r.choices(source, k=12)))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = Counter((i, *x[:2], tuple(x[2])) for (i, _), x in zip(rows, matches_by_force([(t or "").encode() for _, t in rows], [("" if i is None else str(i), (t or "").encode()) for i, t in items], 10)))
    got = decontaminate.find_matches(df, bench)
    assert Counter((x.doc_id, x.n_words, x.n_hit, tuple(x["items"])) for x in got.collect()) == want
    blocks = decontaminate.find_matches(df.filter("doc_id is not null").dropDuplicates(["doc_id"]), bench, block_bytes=100).collect()
    single = {x.doc_id: x for x in got.collect() if x.doc_id is not None}
    for x in blocks:
        y = single[x.doc_id]
        assert (x.n_words, x.n_hit, x["items"], x.longest) == (y.n_words, y.n_hit, y["items"], y.longest)
    clean = decontaminate.decontaminate(df, bench)
    assert Counter(x.doc_id for x in clean.collect()) == Counter(i for (i, _, hit, _), n in want.items() if not hit for _ in range(n))
    assert decontaminate.find_matches(df, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.find_matches(df.limit(0), bench).count() == 0


def test_longest_match():
    (_, _, _, _, longest, item, at), _ = decontaminate.judge([b"x a b c d e f y", b"q"], decontaminate.tests([("i", b"z a b c d e f g")], 3))
    assert (longest, item, at) == (6, "i", 1)


def test_packing(docs):
    df, rows = docs
    pieces = packing.encode_pieces(df, capacity=256).cache()
    got = packing.pack(pieces, 256, shard=50)
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.default_vocabulary())
    want = Counter()
    for i, t in rows:
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first, at = (len(ids) - 1) % 256 + 1, 0
        for k, end in enumerate(range(first, len(ids) + 1, 256)):
            want[i, k, at, end - at, ids[at:end].tobytes()] += 1
            at = end
    assert Counter((x.doc_id, x.piece, x.start, x.length, bytes(x.ids)) for x in pieces.collect()) == want
    seqs = got.toPandas().sort_values("offset").groupby("sequence_id")
    for _, own in seqs:
        assert (own["offset"].to_numpy() == np.append(0, np.cumsum(own["length"])[:-1])).all() and own["length"].sum() <= 256
    assert packing.pack(pieces.limit(0)).count() == 0
    wide = pieces.limit(3).withColumn("doc_id", F.when(F.col("piece") >= 0, F.lit(2**60 + 1)))
    assert {x.doc_id for x in packing.pack(wide.unionByName(wide.withColumn("doc_id", F.lit(None).cast("long"))), 256).collect()} == {2**60 + 1, None}


def test_packed_ids_are_the_documents(docs):
    df, _ = docs
    some = df.filter("doc_id < 30").dropDuplicates(["doc_id"])
    pieces = packing.encode_pieces(some, capacity=256).cache()
    seqs = packing.sequences(pieces, packing.pack(pieces, 256))
    assert sum(len(x.ids) // 4 for x in seqs.collect()) == pieces.agg(F.sum("length")).first()[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_sum_of_squares(lengths):
    where, offset = packing.place(np.array(lengths, np.int64), 40)
    fill, counts = {}, Counter()
    for s, w, o in zip(lengths, where.tolist(), offset.tolist()):
        assert fill.get(w, 0) == o and o + s <= 40
        square = lambda c: sum(v * v for g, v in c.items() if g > 0)

        def after(gap):
            c = counts.copy()
            if gap < 40:
                c[gap] -= 1
            c[gap - s] += 1
            return square(c)

        choices = [after(g) for g in {40 - f for f in fill.values() if 40 - f >= s} | {40}]
        assert after(40 - o) == min(choices)
        if o:
            counts[40 - o] -= 1
        counts[40 - o - s] += 1
        fill[w] = o + s


def test_ids_are_those_of_the_plain_call():
    from tokenizers import Tokenizer

    plain, e = Tokenizer.from_file(packing.default_vocabulary()), packing.encoder(packing.default_vocabulary())
    r = random.Random(6)
    long = "".join(r.choices("abc é\n\t.,'1 \u00a0漢🙂", k=20_000))
    for text in ("a<|endoftext|>b", "<|endoftext|>", "<|endoftext|", long, "x" * 6000 + " <|endoftext|>", "y" * 4999 + " z", " ".join(["word"] * 5000), long.replace(" ", "<|endoftext|>")):
        assert e(text.encode()).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert e(b"<|endoftext|>").tolist() == [50256]


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80))
def test_both_tokenizers_agree(text):
    e = packing.encoder(packing.default_vocabulary())
    assert e(text.encode()).tolist() == e.slow.encode(text, add_special_tokens=False).ids


def test_license_scan(spark):
    rows = [
        (1, "Foo\nLicensed under the Apache License, Version 2.0.\nall RIGHTS, reserved! cc-by"), (2, None), (3, ""), (4, "the License Apache version 0 2 under licensed x"), (5, "General Public\nLicense cc by by cc by"),
        (5, "Released under the MIT License"), (None, "Released under the MIT License."), (6, "mit license"), (7, "...---"), (8, "w " * 30_000 + "cc by"), (9, "ccbyé cc byé"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit(1)).withColumn("number", F.lit(2))
    got = {x.doc_id: x for x in license.scan(df).collect() if x.doc_id != 5}
    assert (got[1].labels, got[1].base_labels, got[1].n_base, got[1].first_word, got[1].last_word) == (["apache-2.0", "cc-by", "reserved"], ["cc-by", "reserved"], 2, 9, 12)
    assert (got[2].n_words, got[3].n_words, got[7].n_words) == (0, 0, 0) and got[2].labels == [] and got[2].first_word is None
    assert got[4].labels == ["apache-2.0"] and got[4].score == 1.0 and got[6].labels == [] and got[None].labels == ["mit"]
    assert (got[8].first_word, got[8].n_words) == (30_000, 30_002) and got[9].n_base == 0
    fives = [x for x in license.scan(df).collect() if x.doc_id == 5]
    assert sorted((x.n_words, x.n_base, x.labels) for x in fives) == [(5, 0, ["mit"]), (8, 3, ["cc-by", "gpl"])]
    assert license.scan(df.limit(0)).count() == 0


def test_containment_join_is_exact(spark):
    r = random.Random(3)
    voc = [f"t{i}" for i in range(12)]
    templates = [(i, f"l{i}", sorted(set(r.choices(voc, k=r.randint(2, 9))))) for i in range(6)]
    blocks = [(i, sorted(set(r.choices(voc, k=r.randint(0, 12))))) for i in range(80)]
    frequency = Counter(w for _, b in blocks for w in b)
    rows = license.ordered(templates, frequency)
    for threshold in (0.5, 0.8, 1.0):
        got = {(x.k, x.template) for x in license.contained(spark.createDataFrame(blocks, "k int, tokens array<string>"), ["k"], rows, threshold).collect()}
        assert got == {(k, i) for k, b in blocks for i, _, t in templates if len(set(b) & set(t)) >= math.ceil(threshold * len(t) - 1e-9)}


def test_forward_recursion_is_exact():
    import itertools

    r = np.random.default_rng(0)
    m = hmm.Hmm(np.array([0.5, 0.3, 0.2]), r.dirichlet(np.ones(3), 3), r.dirichlet(np.ones(6), 3))
    docs = [r.integers(0, 6, n) for n in (6, 6, 4, 1)]
    rec = hmm.Recursion(m, docs)
    for d, l in zip(docs, hmm.log_likelihoods(m, docs)):
        paths = itertools.product(range(3), repeat=len(d))
        total = sum(math.prod([m.start[z[0]] * m.emit[z[0], d[0]], *(m.move[z[i - 1], z[i]] * m.emit[z[i], d[i]] for i in range(1, len(d)))]) for z in paths)
        assert math.isclose(math.log(total), l, abs_tol=1e-9)
    start, move, emit = rec.expected()
    assert (start.sum(), move.sum(), emit.sum()) == pytest.approx((4, 13, 17))


def test_baum_welch_raises_the_likelihood():
    r = np.random.default_rng(1)
    docs = [r.integers(0, 3, 40) + 3 * (k % 2) for k in range(20)]
    f = np.full(6, 1 / 6)
    m, last = hmm.Hmm.begin(f, 2), -math.inf
    for _ in range(6):
        rec = hmm.Recursion(m, sorted(docs, key=len))
        now = hmm.log_likelihoods(m, sorted(docs, key=len)).sum()
        assert now > last - 1e-6
        last = now
        start, move, emit = rec.expected()
        m = hmm.Hmm(start / start.sum(), (move + 1e-9) / (move + 1e-9).sum(1, keepdims=True), (emit + 1e-9) / (emit + 1e-9).sum(1, keepdims=True))
    assert last > 20 * 40 * math.log(1 / 6) + 300


def test_hmm_scores(docs):
    df, rows = docs
    held = {i: zlib.crc32((str(i) if i is not None else "").encode()) % 10 == 0 for i, _ in rows}
    text = [(i, [*((t or "").encode().lower().split()), None]) for i, t in rows]
    c = Counter(w for i, own in text if not held[i] for w in own)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held[i], len(own), sum(c[w] > 0 for w in own), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), 4)) for i, own in text)
    got = hmm.score(df, rounds=2).collect()
    assert Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 4)) for x in got) == want
    assert all(math.isfinite(x.score) and x.score < 0 for x in got)
    assert hmm.score(df.limit(0), rounds=1).count() == 0


def test_hmm_beats_counts_on_held_out_texts(spark, sf):
    got = hmm.score(spark.read.parquet(f"{sf}/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_tail_words_are_joined(spark, docs, monkeypatch):
    df, _ = docs
    a = {x.doc_id: x.base_score for x in hmm.score(df, rounds=1).collect()}
    monkeypatch.setattr(hmm, "HEAD", 20)
    b = {x.doc_id: x.base_score for x in hmm.score(df, rounds=1).collect()}
    assert a == pytest.approx(b)


def test_quality_against_labels(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    seen = quality.judge(docs).join(labels, "doc_id").groupBy("quality", "keep").count().collect()
    right = sum(x["count"] for x in seen if (x.quality == 1) == x.keep)
    assert right / sum(x["count"] for x in seen) > 0.95
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns


def test_quality_of_awkward_texts(docs):
    df, rows = docs
    got = quality.judge(df).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    assert all(x.keep for x in got if x.doc_id in (300, 301, 302))
    assert quality.judge(df.limit(0)).count() == 0


def test_quality_votes_and_features_by_force():
    import regex
    import xxhash

    r = random.Random(3)
    voc = ["Alpha,", "is", "NASA", "|", "$x$", "word", "of", "a", "Über", "12", "don't", "…", "loooooooooooooong"]
    texts = ["", "one", " ".join(r.choices(voc, k=40)), "x y z " * 30, " ".join(f"w{i % 9}" for i in range(300)), "A | B | C", " ".join(r.choices(voc, k=900)), " ".join(f"w{r.randrange(90)}" for _ in range(5000))]

    def shape(w):
        s = "".join("0" if regex.match(r"\p{N}", c) else "A" if regex.match(r"\p{Lu}", c) else "a" if regex.match(r"\p{L}", c) else c for c in w)
        s = regex.sub("(A+|a+|0+)", lambda m: m[0][0], s)
        return xxhash.xxh3_64_intdigest((s[:6] + s[-6:] if len(s) > 12 else s).encode())

    got = quality.Texts([t.encode() for t in texts], quality.Words())
    votes, (many, keys, values) = got.votes(), got.features()
    ends = np.cumsum(many)
    for d, t in enumerate(texts):
        w = t.split()
        n = len(w)
        c = Counter(shape(x) % quality.DIMENSIONS for x in w)
        c.update((shape(x) * 31 + shape(y) * 17) % quality.DIMENSIONS for x, y in zip(w, w[1:]))
        same = sum(x == y for x, y in zip(w, w[1:]))
        if n:
            c.update({1: same, 2: n - same})
        norm = math.sqrt(sum(v * v for v in c.values()))
        own = dict(zip(keys[ends[d] - many[d] : ends[d]].tolist(), values[ends[d] - many[d] : ends[d]].tolist()))
        assert own == pytest.approx({k: v / norm for k, v in c.items()})
        if n >= 4:
            assert got.distinct_runs()[d] == pytest.approx(len({tuple(w[i : i + 4]) for i in range(n - 3)}) / (n - 3))
        bars = sum(x == "|" for x in w) / max(n, 1)
        assert votes[d][1] == (-1 if n and bars >= 0.1 else 0)
        marks = sum(not k.isalnum() for x in w for k in x) / max(1, sum(map(len, w)))
        assert votes[d][6] == (0 if not n else -1 if marks >= 0.09 else 1 if marks <= 0.06 else 0)
    assert [v[4] for v in votes] == [0, 0, 0, -1, -1, 0, 0, 0]  # the longest one has few words, but ever new runs


def test_expectation_maximisation_by_force():
    r = np.random.default_rng(2)
    v = r.integers(-1, 2, (300, len(quality.LABELLERS)))
    p, n = np.unique(quality.vote_pattern(v), return_counts=True)
    got = quality.expectation_maximisation(p, n.astype(float), rounds=7)
    prior, right = 0.8, np.tile([0.4, 0.98], (v.shape[1], 1))
    for _ in range(7):
        post = []
        for row in v:
            good, bad = prior, 1 - prior
            for k, x in enumerate(row):
                good *= right[k, 1] if x == 1 else 1 - right[k, 1] if x == -1 else 1
                bad *= right[k, 0] if x == -1 else 1 - right[k, 0] if x == 1 else 1
            post.append(good / (good + bad))
        post = np.array(post)
        for k in range(v.shape[1]):
            hit = (1 - post)[v[:, k] == -1].sum() + 1, post[v[:, k] == 1].sum() + 9
            miss = (1 - post)[v[:, k] == 1].sum() + 1, post[v[:, k] == -1].sum() + 1
            right[k] = [min(max(a / (a + b), 0.01), 0.999) for a, b in zip(hit, miss)]
        prior = min(max((post.sum() + 4) / (len(v) + 5), 0.01), 0.99)
    assert got.prior == pytest.approx(prior) and got.right == pytest.approx(right)


def test_scorer_reaches_the_smallest_loss():
    r = np.random.default_rng(5)
    keys = [r.choice(30, 6, replace=False) for _ in range(200)]
    values = [np.full(6, 6**-0.5) for _ in keys]
    target = np.array([0.9 if (k < 8).sum() > 1 else 0.1 for k in keys])
    s = quality.fit_scorer(keys, values, target, rounds=2000)
    x = np.zeros((200, 31))
    for i, k in enumerate(keys):
        x[i, k] = values[i]
    x[:, 30] = 1
    weigh = target / target.mean() + (1 - target) / (1 - target.mean())
    loss = lambda w: float(np.mean(weigh * (np.logaddexp(0, x @ w) - target * (x @ w))))
    w = np.zeros(31)
    for _ in range(50):  # Newton
        q = 1 / (1 + np.exp(-(x @ w)))
        w -= np.linalg.solve((x * (weigh * q * (1 - q))[:, None]).T @ x + 1e-4 * np.eye(31), x.T @ (weigh * (q - target)) + 1e-4 * w)
    assert loss(np.append(s.weights[:30], s.bias)) < loss(w) + 1e-3


def test_expectation_maximisation_finds_accuracies():
    r = np.random.default_rng(0)
    truth = r.random(20_000) < 0.8
    k = len(quality.LABELLERS)
    acc = np.linspace(0.7, 0.95, k)
    votes = np.where(r.random((len(truth), k)) < acc, truth[:, None], ~truth[:, None]) * 2 - 1
    p, n = np.unique(quality.vote_pattern(votes), return_counts=True)
    assert (quality.unpattern(p)[:, 0] ** 2 == 1).all()
    m = quality.expectation_maximisation(p, n.astype(float))
    assert m.right[:, 1] == pytest.approx(acc, abs=0.05) and m.prior == pytest.approx(0.8, abs=0.05)


def toxic_corpus(spark):
    r = random.Random(0)
    bad = ["grubble", "snark", "vexol"]
    rows, labels = [], []
    for i in range(500):
        w = r.choices([f"w{k}" for k in range(200)], k=30)
        n = r.randint(1, 6) if i % 4 == 0 else 0
        for _ in range(n):
            w[r.randrange(30)] = r.choice(bad)
        rows.append((i, " ".join(w)))
        if i < 400:
            labels.append((i, 1 if any(b in w for b in bad) else 0))
    return rows, labels, bad


def test_toxicity(spark):
    rows, labels, bad = toxic_corpus(spark)
    df = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "snark"), rows[1], rows[1]], "doc_id long, text string").withColumn("toxic", F.lit("x")).withColumn("row", F.lit(1))
    lab = spark.createDataFrame([*labels, (5000, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, lab)
    assert (np.diff(model.thresholds) > 0).all()
    got = toxicity.severity(df, model).collect()
    assert len(got) == len(rows) + 5
    held = [x for x in got if x.doc_id is not None and 400 <= x.doc_id < 500]
    assert all(x.toxic == any(b in rows[x.doc_id][1].split() for b in bad) for x in held)
    level = {k: np.mean([x.expected_severity for x in held if sum(w in bad for w in rows[x.doc_id][1].split()) == k]) for k in (0, 1, 5)}
    assert level[0] < level[1] < level[5]
    assert not any(x.toxic for x in got if x.doc_id in (900, 901))
    assert toxicity.severity(df.limit(0), model).count() == 0
    none = toxicity.train(df, lab.limit(0))
    assert toxicity.severity(df, none).agg(F.max("expected_severity")).first()[0] < 1e-6


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    want = components_of({x for e in edges for x in e}, edges)
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {x.node: x.component for x in got.collect()} == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_digest_queries(spark, sf):
    from linelake.llm.queries import QUERIES

    rows = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    gone = repeats_by_force(sorted(rows.items()), 20)
    for x in QUERIES["op4_substring_dedup"](spark, sf).collect():
        kept = b" ".join(w for w, g in zip(words(rows[x.doc_id]), gone[x.doc_id]) if not g)
        assert (x.n_removed, x.kept_sha256) == (sum(gone[x.doc_id]), hashlib.sha256(kept).hexdigest())
    items = [(str(x.item_id), x.text.encode()) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    some = sorted(rows)[:40]
    want = dict(zip(some, matches_by_force([rows[i].encode() for i in some], items[:60], 10)))
    got = {x.doc_id: x for x in QUERIES["op7_benchmark_decontamination"](spark, sf).collect()}
    assert len(got) == len(rows)
    for i, (n, _, _) in want.items():
        assert got[i].n_words == n and got[i].contaminated == (got[i].n_hit > 0)
