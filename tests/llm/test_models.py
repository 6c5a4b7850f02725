"""The ranking's fit and the fingerprints against plain definitions."""

import random

import numpy as np
import pyarrow as pa
import pytest

from ridgeline.llm import fingerprint, quality
from ridgeline.llm.common import mix, shingle_hashes, text_slices


def test_ranking_is_the_logistic_fit_of_its_pairs():
    """Weights by plain gradient ascent on the pairs' log-likelihood with its ridge, one pair after another in the sum."""
    rng = np.random.default_rng(1)
    y = np.r_[np.ones(60), np.zeros(40)].astype(int)
    x = rng.normal(size=(100, quality.N_FEATURES)) + y[:, None] * rng.normal(size=quality.N_FEATURES) * 0.7
    model = quality.Ranker(x, y, pairs=400)
    draw = np.random.default_rng(8)
    good, bad = draw.choice(np.flatnonzero(y == 1), 400), draw.choice(np.flatnonzero(y == 0), 400)
    z = np.clip((x - x.mean(0)) / np.maximum(x.std(0), 1e-4), -6, 6)
    w = np.zeros(quality.N_FEATURES)
    for _ in range(20_000):
        slope = -1e-3 * w
        p = 1 / (1 + np.exp(-(z[good] - z[bad]) @ w))
        slope += ((1 - p)[:, None] * (z[good] - z[bad])).sum(0) / 400
        w += 0.5 * slope
    assert np.abs(slope).max() < 1e-7 and np.allclose(model.weights, w, atol=1e-4)
    scores = model.score(x)
    assert abs((scores < quality.CUT).mean() - 0.4) <= 0.02  # the threshold is the quantile at the share of label 0
    assert np.allclose(model.score(x[::-1]), scores[::-1])


def test_a_repeated_document_is_one_row_of_the_fit(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["the", "quiet", "house", "stood"] if i % 2 else ["WIN!!", "$$$", "CLICK***"], k=20)), "x") for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    fit = lambda rs: quality.train(spark.createDataFrame(rs, "doc_id long, text string, _label string"), labels)
    once, often = fit(rows), fit(rows + [rows[3]] * 500 + [(3, None, "y")])
    assert np.array_equal(once.weights, often.weights) and once.threshold == often.threshold


def plain_signature(hashes, bins=256, bits=8):
    """One-permutation MinHash with densification by repeated draws, bin by bin."""
    least = [None] * bins
    for h in map(int, hashes):
        k, rest = h >> 56, h & (2**56 - 1)
        if least[k] is None or rest < least[k]:
            least[k] = rest
    one = lambda v: int(mix(np.array([v % 2**64], np.uint64))[0])
    out = []
    for k in range(bins):
        attempt, source = 0, k
        while least[source] is None:
            source = one((k + attempt * bins) * 0x9E3779B97F4A7C15) % bins
            attempt += 1
        out.append(one(least[source] + k * 0x9E3779B97F4A7C15) & (2**bits - 1))
    return bytes(out)


def test_fingerprints_are_densified_minima():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(200)]
    texts = [" ".join(rng.choices(vocabulary, k=n)) for n in (1, 2, 4, 5, 6, 9, 30, 120, 400, 2000)] + ["", "  \n", "a b c d e " * 50]
    sig, has = fingerprint.text_signatures(texts)
    for k, (_, _, data, offsets) in enumerate(s for t in texts for s in text_slices(pa.array([t], pa.large_string()))):
        h, begin = shingle_hashes(data, offsets, 5)
        words = texts[k].split()
        assert bool(has[k]) == bool(words) and len(set(h.tolist())) == len({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else [])
        if words:
            assert sig[k].tobytes() == plain_signature(h)


def test_likeness_is_unbiased():
    """Pairs of known likeness: the estimate's mean is within three standard errors, chance matches taken off."""
    rng = random.Random(4)
    for shared, own in ((100, 0), (80, 10), (50, 50), (10, 100), (0, 100)):
        true, found = shared / (shared + 2 * own), []
        for k in range(40):
            word = lambda n: [f"w{rng.getrandbits(60)}" for _ in range(n)]
            both = [" ".join(word(5)) for _ in range(shared)]
            sets = [np.concatenate([shingle_hashes(*_one(s), 5)[0] for s in both + [" ".join(word(5)) for _ in range(own)]]) for _ in range(2)]
            a, b = (np.frombuffer(plain_signature(h), np.uint8)[None, :] for h in sets)
            found.append(float(fingerprint.likeness(a, np.array([True]), b, np.array([True]))[0]))
        assert abs(np.mean(found) - true) < 3 * (true * (1 - true) / 256 / 40) ** 0.5 + 0.01


def _one(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def test_ranges_of_uneven_ids(spark, monkeypatch):
    """Ids in far clusters, with outliers at both ends and nulls: ranges stay small, and the order holds across them."""
    import hashlib

    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 8)
    monkeypatch.setattr(fingerprint, "COARSE", 16)
    ids = [*range(0, 900, 3), *range(10**12, 10**12 + 300), 2**63 - 1, -(2**63), *range(-50, -20), *([7] * 12), None, None]
    rows = [(i, f"text {k} of {i} " * (1 + k % 5)) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    held = [r["count"] for r in fingerprint._in_order(df, "doc_id", "text").filter("_tail = 0").groupBy("_range").count().collect()]
    assert sum(held) == len(rows) and max(held) <= 8 * 8
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = set()
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        want.add((i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()))
    far = spark.createDataFrame([(-(2**63), "a"), (2**63 - 1, "b")], "doc_id long, text string")
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 1024)
    assert [r.near_next for r in fingerprint.fingerprint_pairs(far).collect()] == [0.0, 0.0]
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 8)
    got = fingerprint.fingerprint_pairs(df).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.n_chars, r.edited_sha256) for r in got} == want


def test_every_labelled_row_is_in_the_fit(spark):
    """Moments and threshold are those of all rows, and each row of either class is in pairs, whichever class is larger."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["the", "Quiet", "9", "WIN!!", "water."], 1 + i % 37))) for i in range(21_500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows], "doc_id long, quality int")
    kept = {r.doc_id for r in docs.filter(~quality.held_out(docs.doc_id)).collect()}
    model = quality.train(docs, labels)
    x = quality.labelled(docs, labels, "doc_id", "text", "quality").collect()
    assert {r.id for r in x} == kept
    all_ = np.stack([np.frombuffer(r.x, np.float32) for r in x])
    y = np.array([r.y for r in x])
    assert np.allclose(model.mean, all_.mean(0, dtype=float), atol=1e-6) and np.allclose(model.scale, np.maximum(all_.std(0, dtype=float), 1e-4), atol=1e-6)
    assert abs(model.threshold - np.quantile(model.strength(all_), (y == 0).mean())) < 1e-9 and np.abs(model.weights).max() > 0
    values = spark.createDataFrame([(float(v),) for v in (all_[:, 1] * 7).round(2)], "s double")
    for k in (0, 5, 9_000, len(x) - 1):
        assert quality.order_statistic(values, k, few=100) == np.sort((all_[:, 1] * 7).round(2).astype(float))[k]


@pytest.mark.parametrize("flip", [0, 1])
def test_pairs_hold_each_row(spark, flip):
    rows = [(i, int(i % 10 > 0) ^ flip, bytes(np.full(quality.N_FEATURES, i, np.float32))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, y long, x binary")
    model = quality.Ranker.of(np.zeros(quality.N_FEATURES), np.full(quality.N_FEATURES, 100.0))
    n_good = sum(y for _, y, _ in rows)
    got = {round(float(np.frombuffer(r.d, np.float32)[0]) * 100) for r in quality.differences(df, model, n_good, 300 - n_good).collect()}
    good, bad = ([i for i, y, _ in rows if y == k] for k in (1, 0))
    assert got == {a - b for a in good for b in bad}  # 270 rows meet all 30 others, as the table is small


def test_features_are_of_one_row_alone():
    texts = ["the quiet house stood AB", "CD the the quiet", "", "AB", "CD AB CD", None, "x"]
    slices = lambda ts: np.concatenate([quality.features(data, offsets) for _, _, data, offsets in text_slices(pa.array(ts, pa.string()))])
    assert np.array_equal(slices(texts), np.concatenate([slices([t]) for t in texts]))
