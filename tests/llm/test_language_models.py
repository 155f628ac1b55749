"""Decontamination and the trained models against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rateforge.llm import fm_index, hmm, kneser_ney, neighbours, ngram_shards

ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def brute_hits(texts, items, window):
    owners = defaultdict(set)
    for i, t in items:
        words = ITEM_WORD.findall(lower(t))
        for k in range(max(1, len(words) - window + 1) if words else 0):
            owners[tuple(words[k:k + window])].add(i)
    out = []
    for t in texts:
        words = ITEM_WORD.findall(lower(t))
        hit, found = np.zeros(len(words), bool), set()
        for n in {len(w) for w in owners}:
            for k in range(len(words) - n + 1):
                if (o := owners.get(tuple(words[k:k + n]))):
                    hit[k:k + n] = True
                    found |= o
        out.append((hit, found))
    return out


def random_words(rng, words, most):
    return " ".join(rng.choice(words) for _ in range(rng.randrange(most)))


def test_phrases_equal_brute_force():
    rng = random.Random(4)
    for _ in range(40):
        words = [f"w{i}" for i in range(rng.choice([2, 3, 6, 30]))]
        texts = [random_words(rng, [*words, "zz", "W1"], 60) for _ in range(25)] + ["", None]
        texts += texts[:3]
        items = [(str(i), random_words(rng, words, 8)) for i in range(12)] + [("9", "w0 w1"), ("x", None)]
        window = rng.choice([2, 3, 4])
        phrases = fm_index.Phrases(items, window)
        hit, found = phrases.find([fm_index.words_of(t) for t in texts])
        for h, f, (want_hit, want_found) in zip(hit, found, brute_hits(texts, items, window)):
            assert (h == want_hit).all() and {phrases.names[x] for x in f} == want_found


def test_suffix_array_orders_runs():
    rng = np.random.default_rng(0)
    for _ in range(30):
        s = rng.integers(0, 3, 60).astype(np.int32)
        s[-1] = 0
        order = fm_index.suffix_array(s)
        n_zero, zeros = int((s == 0).sum()), np.cumsum(s == 0) - 1
        keys = [tuple(int(zeros[i]) if s[i] == 0 else int(s[i]) + n_zero for i in range(k, len(s))) for k in range(len(s))]
        ends = [k[:next(i for i, x in enumerate(k) if x < n_zero) + 1] for k in keys]
        assert order.tolist() == sorted(range(len(s)), key=lambda i: ends[i])


def test_hits_in_blocks_equal_one_block(spark, odd, empty):
    rng = random.Random(8)
    words = ["aa", "bb", "cc", "dd"]
    bench = spark.createDataFrame([(i, random_words(rng, words, 9) or None) for i in range(20)] + [(None, "aa bb cc")], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, random_words(rng, [*words, "zz"], 40)) for i in range(40)], "doc_id bigint, text string")
    one = sorted(map(tuple, fm_index.hits(docs, bench, 3).collect()))
    many = sorted(map(tuple, fm_index.hits(docs, bench, 3, shard_bytes=100, block_bytes=100).collect()))
    assert one == many
    items = [(str(r.item_id) if r.item_id is not None else None, r.text) for r in bench.collect()]
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    for got, (hit, found) in zip(one, brute_hits([t for _, t in rows], items, 3)):
        assert got[2] == hit.sum() and got[3] == sorted(found - {None})
        assert sum(b - a for a, b in zip(got[4], got[5])) == hit.sum()
    assert fm_index.contamination(odd, bench).count() == odd.count()
    assert fm_index.contamination(empty, bench).count() == 0
    assert fm_index.contamination(odd, bench.where("false")).where("contaminated").count() == 0


def test_removal_in_blocks_equals_one_block(spark):
    rng = random.Random(4)
    w = [f"w{i}" for i in range(1, 26)]
    words = ["aa", "bb", "cc", "dd"]
    items = [(1, " ".join(w[:20])), (2, " ".join(w[10:]))] + [(i, random_words(rng, words, 9)) for i in range(3, 9)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(0, "x " + " ".join(w) + " y", 1), (1, None, None), (2, "", 0)] + [(i, random_words(rng, [*words, "zz"], 60), 3) for i in range(3, 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    assert len(fm_index.phrase_blocks(bench, 5, 100)) > 1
    one = sorted(map(tuple, fm_index.removed(docs, bench, 5).collect()))
    many = sorted(map(tuple, fm_index.removed(docs, bench, 5, block_bytes=100).collect()))
    assert one == many and one[0][1].split() == ["x", "y"]


def test_removal_leaves_no_window(spark, odd):
    bench = spark.createDataFrame([(1, "a b c d"), (2, "one")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x A, b; c d y", 14), (2, "a b a b c d c d z", 17), (3, "clean", 5), (4, None, None)],
                                 "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in fm_index.removed(docs, bench, 4).collect()}
    assert got[1] == ("x \n y", 5) and got[3] == ("clean", 5) and got[4] == (None, None)
    assert got[2][0].split() == ["z"]
    out = fm_index.removed(odd, bench)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert {r.doc_id: r.text for r in out.collect()}[8] == "\n"


def brute_kneser_ney(texts):
    """p(w | u, v) by the textbook's recursion over dictionaries."""
    three = Counter()
    for t in texts:
        words = ["", "", *t.split(), None]
        three.update(zip(words, words[1:], words[2:]))
    two = Counter((v, w) for _, v, w in three if v != "")
    two.update({(v, w): c for (u, v, w), c in three.items() if v == ""})
    one = Counter(w for _, w in two)
    words = {w for w in one}

    def discounts(counts):
        n = Counter(counts.values())
        if not all(n[k] for k in (1, 2, 3, 4)):
            return 0.5, 1.0, 1.5
        y = n[1] / (n[1] + 2 * n[2])
        return tuple(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) for k in (1, 2, 3))

    def level(counts, context, w, below):
        d = discounts(counts)
        own = {k: c for k, c in counts.items() if k[:-1] == context}
        if not own:
            return below
        total = sum(own.values())
        left = sum(d[min(c, 3) - 1] for c in own.values()) / total
        c = own.get((*context, w), 0)
        return (c - d[min(c, 3) - 1] if c else 0) / total + left * below

    def p(u, v, w):
        below = level({(x,): c for x, c in one.items()}, (), w, 1 / (len(words) + 1))
        return level(three, (u, v), w, level(two, (v,), w, below))

    return p, words


def test_probabilities_equal_the_recursion(spark):
    rng = random.Random(1)
    texts = [random_words(rng, "abcdefg", 12) for _ in range(40)]
    model = kneser_ney.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    p, words = brute_kneser_ney(texts)
    scorer = model.scorer()
    for text in ["a b c", "", "z a z z b", "g f e d c b a", *texts[:5]]:
        tokens = ["", "", *text.split(), None]
        want = sum(math.log10(p(*t)) for t in zip(tokens, tokens[1:], tokens[2:]))
        n, logs = scorer.scores([text])
        assert n[0] == len(tokens) - 2 and logs[0] == pytest.approx(want, abs=1e-9)
    # Every context's probabilities, the unknown word's included, sum to one.
    ids = np.arange(model.base - 1)
    for u, v in itertools.product([0, 1, 2, model.base - 1], [0, 1, 3]):
        assert scorer.probabilities(np.full(len(ids), u), np.full(len(ids), v), ids).sum() == pytest.approx(1)


def clean_and_junk(n):
    rng = random.Random(2)
    words = ["the", "of", "and", "sun", "moon", "river", "stone", "tree", "light", "wind"]
    good = [(i, " ".join(rng.choice(words) for _ in range(40)), "en" if i % 3 else None, 1) for i in range(n)]
    return good + [(10_000 + i, " ".join(f"X{rng.random()}%" for _ in range(40)), "en", 0) for i in range(n // 10)]


def test_quality_keeps_clean_and_drops_junk(spark, odd, empty):
    rows = clean_and_junk(300)
    docs = spark.createDataFrame([r[:3] for r in rows] + [(None, None, None), (1, rows[1][1], "en")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3], 0) for r in rows] + [(None, 1, 0), (5, None, None)], "doc_id bigint, quality int, toxic int")
    got = kneser_ney.judged(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.kept == (r.doc_id is None or r.doc_id < 10_000) for r in got)
    assert kneser_ney.kept(docs, labels).count() == 302
    assert kneser_ney.judged(odd, labels.where("false")).where("kept").count() == odd.count()
    assert kneser_ney.judged(empty, labels).count() == 0
    assert kneser_ney.kept(odd, labels).columns == odd.columns


def test_shards_of_all_trusted_texts_equal_one_model(spark, odd, empty, monkeypatch):
    """No trusted text of the training share is left out, and a model in shards scores alike."""
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(400)]
    rows = [(i, random_words(rng, words, 30), rng.choice(["en", "fr", None])) for i in range(400)]
    rows += [(1000 + i, " ".join(f"X{rng.random()}" for _ in range(40)), "en") for i in range(30)]
    rows += [(2000, None, "en"), (2001, "", None), (None, "w1 w2", "en"), (2002, " \u00e9\u00a0x\r\n w1\x0bw2\x1c ", "fr"), *rows[:5]]
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id bigint, text string, lang string, shard string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, *_ in rows if i is not None], "doc_id bigint, quality int")
    for name, value in (("SHARD_TOKENS", 500), ("ROUND_BYTES", 1500), ("TOP", 5)):
        monkeypatch.setattr(ngram_shards, name, value)
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    one = sorted(kneser_ney.judged(docs, labels).collect(), key=key)
    many = sorted(kneser_ney.judged(docs, labels, local_tokens=100).collect(), key=key)
    assert len(one) == len(many) == len(rows) and not all(r.kept for r in one)
    for a, b in zip(one, many):
        assert (a.doc_id, a.lang, a.n_tokens, a.kept) == (b.doc_id, b.lang, b.n_tokens, b.kept)
        assert b.log10_prob == pytest.approx(a.log10_prob, abs=1e-6) and b.threshold == pytest.approx(a.threshold, abs=2e-3)
    kept = kneser_ney.kept(docs, labels, local_tokens=100)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.where("doc_id is not null").collect() if r.text) == sorted(
        (r.doc_id, t) for r, t in zip(one, (t for _, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)))) if r.kept and r.doc_id is not None and t)
    # The words of every trusted text of the share are in the model.
    trusted = labels.where("quality = 1").select("doc_id")
    ids = {r.doc_id for r in kneser_ney.training_ids(trusted).collect()}
    assert abs(len(ids) / trusted.distinct().count() - kneser_ney.TRAIN_SHARE) < 0.1
    assert kneser_ney.judged(odd, labels, local_tokens=0).count() == odd.count()
    assert kneser_ney.kept(empty, labels, local_tokens=0).count() == 0


def test_index_equals_brute_force():
    rng = np.random.default_rng(5)
    vectors = []
    for _ in range(300):
        terms = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        weights = rng.integers(1, 4, len(terms)).astype(float)
        vectors.append((terms, weights / np.sqrt((weights ** 2).sum())))
    index = neighbours.BlockMaxIndex(vectors, 40, 16)
    dense = np.zeros((300, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(0, 300, 7):
        scores = np.round(dense @ dense[i], 12)
        want = sorted(((s, e) for e, s in enumerate(scores.tolist()) if s > 0), key=lambda x: (-x[0], x[1]))[:9]
        got = index.nearest(*vectors[i], 9)
        assert [e for _, e in got] == [e for _, e in want] or np.allclose([s for s, _ in got], [s for s, _ in want])


def test_toxicity_on_held_out_rows(spark, odd, empty):
    rng = random.Random(3)
    words, bad = [f"word{chr(97 + i)}" for i in range(26)], ["grobian", "lumpen", "schurke"]
    rows = []
    for i in range(900):
        toxic = i % 9 == 0
        text = [rng.choice(words) for _ in range(30)] + ([rng.choice(bad) + rng.choice(["", "en", "x"]) for _ in range(3)] if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (9000, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(7, None), (None, 1)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in neighbours.toxicity(docs, labels).collect()}
    assert len(got) == 902
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert all(got[i].predicted == y for i, _, y in rows)
    assert 0 <= got[9000].score < 0.1 and got[None].score == got[9000].score
    model = neighbours.fit(docs, labels)
    assert neighbours.kept(docs, model).count() == 802
    # Labels of the held-out fold play no part.
    held = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0 or doc_id is null")
    assert {r.doc_id: r.score for r in neighbours.toxicity(docs, held).collect()} == {i: r.score for i, r in got.items()}
    assert neighbours.toxicity(odd, labels.where("false")).where("score = 0").count() == odd.count()
    assert neighbours.toxicity(empty, labels).count() == 0


def test_forward_and_expected_counts_equal_enumeration():
    rng = np.random.default_rng(9)
    k, size = 3, 5
    model = hmm.HMM(*(x / x.sum(-1, keepdims=True) for x in (rng.random(k), rng.random((k, k)), rng.random((k, size)))))
    texts = [rng.integers(0, size, n).astype("<u2") for n in (1, 4, 3, 4, 2)]
    start, move, emit, logs = np.zeros(k), np.zeros((k, k)), np.zeros((k, size)), []
    for t in texts:
        paths = list(itertools.product(range(k), repeat=len(t)))
        p = np.array([model.start[z[0]] * np.prod([model.emit[s, x] for s, x in zip(z, t)]) * np.prod([model.move[a, b] for a, b in zip(z, z[1:])]) for z in paths])
        logs.append(np.log10(p.sum()))
        for z, share in zip(paths, p / p.sum()):
            start[z[0]] += share
            for a, b in zip(z, z[1:]):
                move[a, b] += share
            for s, x in zip(z, t):
                emit[s, x] += share
    assert np.allclose(model.log10(texts), logs)
    for got, want in zip(model.expected(texts), (start, move, emit)):
        assert np.allclose(got, want)


def test_language_scores(spark, odd, empty):
    rng = random.Random(11)
    rows = [(i, random_words(rng, ["Aa", "bb", "cc", f"r{i}", f"q{i % 7}"], 30) if i % 10 else None) for i in range(120)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id bigint, text string")
    got = hmm.language_scores(docs, states=2, steps=2, own=3, hot_words=6).collect()
    tokens = [(i, [*lower(t).split(), None]) for i, t in rows + rows[:2]]
    counts = Counter(w for i, ws in tokens if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((i, zlib.crc32(str(i).encode()) % 10 == 0, len(ws), sum(counts[w] > 0 for w in ws), n) for i, ws in tokens)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
    base = {i: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) for i, ws in tokens}
    assert all(r.base_score == pytest.approx(base[r.doc_id], abs=1e-9) for r in got)
    assert all(r.score < 0 for r in got)
    # The first words of all texts, an unseen one per symbol included, have probability one together.
    assert hmm.language_scores(odd, states=2, steps=1).count() == odd.count()
    assert hmm.language_scores(empty, states=2, steps=1).count() == 0


def test_score_equals_a_plain_forward_pass(spark, odd):
    """Whole texts under the trained model: one path sum a word, times the word's share."""
    rng = random.Random(12)
    rows = [(i, random_words(rng, ["Aa", "bb", "cc", f"r{i}", f"q{i % 7}", "tail"], 40) if i % 9 else "") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(
        odd.where("doc_id > 6 or doc_id is null").select((hmm.F.col("doc_id") + 1000).alias("doc_id"), "text"))
    options = {"own": 3, "hot_words": 7}
    got = {r.doc_id: r.score for r in hmm.language_scores(docs, states=3, steps=3, **options).collect()}
    training = docs.where(hmm.fold(hmm.F.col("doc_id"), hmm.FOLDS) != 0)
    counts = hmm.cut(hmm.word_counts(training))
    v = hmm.vocabulary(counts, training.count(), **options)
    model = hmm.trained(hmm.encoded(docs, v).where("not held_out").select("row", "n_tokens", "symbols"), v, 3, 3)
    c = {bytes(r.word): r.c for r in counts.collect()}
    for r in docs.collect():
        total, alpha = 0.0, None
        for w in [*hmm.tokens_of(r.text), None]:
            own = v.words[:3].index(w) if w in v.words[:3] else None
            s = v.end if w is None else own if own is not None else v.end + 1 + hmm.suffix(w)
            if w is not None and own is None:
                k = hmm.suffix(w)
                total += math.log10((c.get(w, 0) + hmm.SMOOTH) / (v.sum[k] + hmm.SMOOTH * (v.types[k] + 1)))
            alpha = (model.start if alpha is None else alpha @ model.move) * model.emit[:, s]
            total += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        assert got[r.doc_id] == pytest.approx(total, rel=1e-9)


def test_training_refuses_numbers_that_are_not_finite(spark):
    sequences = spark.createDataFrame([(0, 2, bytearray(np.array([1, 2], "<u2").tobytes()))], "row bigint, n_tokens bigint, symbols binary")
    broken = hmm.HMM(np.ones(2) / 2, np.full((2, 2), 0.5), np.full((2, 9), np.nan))
    with pytest.raises(FloatingPointError):
        hmm.baum_welch_step(sequences, broken, np.ones(9) / 9)


def test_training_covers_all_rows_until_it_gains_little(spark):
    """Equal models from any partitioning, and no step over all rows gains more than stated."""
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 5, 30) if i % 2 else rng.integers(4, 9, 30) for i in range(80)]
    rows = [(i, len(t), bytearray(t.astype("<u2").tobytes())) for i, t in enumerate(texts)]
    sequences = spark.createDataFrame(rows, "row bigint, n_tokens bigint, symbols binary")
    v = hmm.Vocabulary([(bytes([97 + i]), 300) for i in range(8)], 2400, 9, 80, 8, {}, 4)
    a, b = (hmm.trained(sequences.repartition(n), v, 2) for n in (1, 5))
    assert np.allclose(a.emit, b.emit) and np.allclose(a.move, b.move)
    after = hmm.HMM.of_counts(*a.expected(texts), v.overall())
    assert (after.log10(texts).sum() - a.log10(texts).sum()) * np.log(10) / 2400 < hmm.TOLERANCE


def test_symbols_and_shares_sum_to_one(spark):
    docs = spark.createDataFrame([(i, f"aa bb c{i} d{i % 5} xa ya") for i in range(30)], "doc_id bigint, text string")
    counts = hmm.cut(hmm.word_counts(docs))
    v = hmm.vocabulary(counts, 30, own=2, hot_words=5)
    words = {bytes(r.word): r.c for r in counts.collect()}
    assert v.n_tokens == 30 * 7 and v.n_types == len(words) + 1
    shares = defaultdict(float)
    for w, c in words.items():
        if w not in v.words[:2]:
            s = hmm.suffix(w)
            shares[s] += (c + hmm.SMOOTH) / (v.sum[s] + hmm.SMOOTH * (v.types[s] + 1))
    assert all(x == pytest.approx(1 - hmm.SMOOTH / (v.sum[s] + hmm.SMOOTH * (v.types[s] + 1))) for s, x in shares.items())
    assert v.counts.sum() == v.n_tokens
    sent = {bytes(r.word): r.s for r in counts.select("word", hmm._suffix_col(hmm.F.col("word")).alias("s")).collect()}
    assert sent == {w: hmm.suffix(w) for w in words}


def test_counts_do_not_depend_on_where_sums_are_scaled(monkeypatch):
    """Texts end before, at and behind a scaled place; rare symbols do not underflow."""
    rng = np.random.default_rng(5)
    emit = rng.random((3, 7)) * np.array([1, 1, 1, 1, 1e-9, 1e-15, 1e-18])
    model = hmm.HMM(np.ones(3) / 3, *(x / x.sum(1, keepdims=True) for x in (rng.random((3, 3)), emit)))
    texts = [rng.integers(0, 7, n) for n in (*range(1, 14), 1024, 7, 1)] + [np.full(40, 6)]
    found = {}
    for every in (1, 4, 5):
        monkeypatch.setattr(hmm, "SCALED", every)
        found[every] = model.expected_and_log(texts)
    for every, got in found.items():
        for x, y in zip(got, found[1]):
            assert np.allclose(x, y, rtol=1e-9), every
    assert abs(found[4][3] / math.log(10) - model.log10(texts).sum()) < 1e-6
    assert abs(found[4][2].sum() - sum(map(len, texts))) < 1e-6


def test_single_precision_counts_equal_double_ones():
    """Also where every symbol is as rare as 1e-30, which four places would bring to zero."""
    rng = np.random.default_rng(6)
    emit = rng.random((3, 12))
    emit[:, :11] *= 1e-30
    model = hmm.HMM(np.ones(3) / 3, *(x / x.sum(1, keepdims=True) for x in (rng.random((3, 3)) ** 8, emit)))
    texts = [rng.integers(0, 11, n) for n in (1, 2, 5, 400, 400, 37)]
    want, got = model.expected_and_log(texts), model.expected_and_log(texts, np.float32)
    assert got[3] == pytest.approx(want[3], rel=1e-6)
    assert want[3] == pytest.approx(model.log10(texts).sum() * np.log(10), rel=1e-9)
    for a, b in zip(got[:3], want):
        assert a == pytest.approx(b, rel=1e-4, abs=1e-4)
