"""Score, threshold and verdict of the quality rules against plain Python on whole texts."""

import collections
import math
import random

import pytest

from lithic.llm import quality
from lithic.llm import textops as T

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def plain_grams(text):
    """Hash buckets of a text's words, shapes and word pairs, one word at a time."""
    import numpy as np

    words = []
    now = b""
    for b in (text or "").encode():
        if b in SPACE:
            words, now = ([*words, now] if now else words), b""
        else:
            now += bytes([b])
    words += [now] if now else []
    hasher, shaper = T.WordHasher(2), quality._Shape(22)

    def alone(h, raw):
        data = np.frombuffer(raw, dtype=np.uint8)
        return h.ranges(data, np.array([0]), np.array([len(raw)]))

    own = [alone(hasher, w) for w in words]
    grams = [h ^ np.uint64(1) for h in own]
    for w in words:
        shape = quality._collapsed(np.frombuffer(w, dtype=np.uint8), np.array([0])).tobytes()
        grams.append(alone(shaper, shape) ^ np.uint64(2))
    grams += [T.ngrams(np.concatenate([a, b]), 2) ^ np.uint64(3) for a, b in zip(own, own[1:], strict=False)]
    return [int(T.mix(g)[0] >> np.uint64(48)) % quality.BUCKETS for g in grams]


def plain_model(rows, labels):
    """(score of each text, threshold) from all n-grams of all texts."""
    grams = [plain_grams(text) for _, text in rows]
    raw, trusted = collections.Counter(), collections.Counter()
    for (doc, _), own in zip(rows, grams, strict=True):
        raw.update(own)
        if labels.get(doc) == 1:
            trusted.update(own)
    share = lambda c, k: (c[k] / c.total() + quality.SMOOTH / quality.BUCKETS) / (1 + quality.SMOOTH)
    scores = [sum(math.log(share(trusted, k)) - math.log(share(raw, k)) for k in own) / max(len(own), 1) for own in grams]
    return scores


def plain_cut(scores, rows, labels, failed):
    """Of all cuts between steps of scores the lowest with the best balanced accuracy, in the middle of the empty steps below it."""
    marked = [(math.floor(s / quality.STEP), labels[doc]) for s, (doc, _), bad in zip(scores, rows, failed, strict=True) if doc in labels and not bad]
    steps = sorted({step for step, _ in marked})
    total = collections.Counter(q for _, q in marked)
    best, cut = 0.0, float("-inf")
    for before, step in zip([steps[0], *steps], steps, strict=False):
        below = collections.Counter(q for s, q in marked if s < step)
        gain = below[0] / total[0] - below[1] / total[1]
        if gain > best + 1e-12:
            best, cut = gain, (min(before + 1, step) + step) / 2 * quality.STEP
    return cut


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(12)
    good = [f"good{k}" for k in range(300)] + ["Plain", "words"]
    bad = [f"bad{k}" for k in range(60)] + ["BUY!!!", "***", "né", "日本"]
    rows = []
    for k in range(150):
        from_ = good if k % 3 else good[:50] + bad
        rows.append((k, " ".join(rnd.choice(from_) for _ in range(rnd.randint(40, 160)))))
    rows += [(150, None), (151, ""), (152, "x " * 90)]
    labels = {k: int(k % 3 != 0) for k in range(0, 150, 2)}
    return rows, labels


def test_same_as_plain(spark, table):
    rows, labels = table
    marks = [(k, q) for k, q in labels.items()] + [(4, 0), (None, 1), (5, None)]  # the greatest quality counts
    frames = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(marks, "doc_id long, quality int")
    found = {r.doc_id: r for r in quality.quality_rules(*frames).collect()}
    scores = plain_model(rows, labels)
    assert all(math.isclose(found[doc].score, s, rel_tol=1e-9, abs_tol=1e-12) for (doc, _), s in zip(rows, scores, strict=True))
    failed = [found[doc].base_failed for doc, _ in rows]
    cut = plain_cut(scores, rows, labels, failed)
    assert math.isfinite(cut)
    assert [found[doc].kept for doc, _ in rows] == [not bad and s >= cut for s, bad in zip(scores, failed, strict=True)]


def test_all_labels_count(spark, table, monkeypatch):
    """More labels than are broadcast: counts and threshold still come from every one of them."""
    rows, labels = table
    marks = [(k, q) for k, q in labels.items()] + [(4, 0), (None, 1), (5, None), (99_999, 1)]
    frames = spark.createDataFrame([*rows, rows[2]], "doc_id long, text string").repartition(4), spark.createDataFrame(marks, "doc_id long, quality int")
    for name in ("FEW", "LABELLED"):
        monkeypatch.setattr(quality, name, 10, raising=False)
    found = sorted(quality.quality_rules(*frames).collect(), key=str)
    scores = plain_model([*rows, rows[2]], labels)
    by_id = {r[0]: r for r in found}
    assert all(math.isclose(by_id[doc].score, s, rel_tol=1e-9, abs_tol=1e-12) for (doc, _), s in zip(rows, scores, strict=False))
    for name in ("FEW", "LABELLED"):
        monkeypatch.setattr(quality, name, 1000, raising=False)
    assert found == sorted(quality.quality_rules(*frames).collect(), key=str)


def test_filter_keeps_all_that_match(spark):
    from lithic import sieve

    rows, wanted = spark.range(5000).selectExpr("id", "cast(id % 7 as string) as name"), spark.range(0, 9000, 9).selectExpr("id", "cast(id % 7 as string) as name")
    for keys in (["id"], ["id", "name"]):
        left = sieve.may_match(rows, keys, wanted)
        assert left.join(wanted, keys).count() == rows.join(wanted, keys).count() == 556
        assert left.count() < 600
    assert sieve.may_match(rows, ["id"], wanted.where("false")).count() == 0


@pytest.mark.parametrize("bits", [1 << 26, 1 << 12, 64])
def test_settled_tells_what_matches(spark, monkeypatch, bits):
    """True and false hold whatever collides; with room for the keys hardly any is left to the join."""
    from lithic import sieve

    monkeypatch.setattr(sieve, "BITS", bits)
    ids = [*range(2000), *range(500), *(k << 40 for k in range(1, 500)), None, None]
    wanted = {*range(0, 3000, 9), *(k << 40 for k in range(1, 500, 7))}
    rows = spark.createDataFrame([(k,) for k in ids], "id long").repartition(4)
    found = sieve.settled(rows, ["id"], spark.createDataFrame([(k,) for k in wanted], "id long"), "told").collect()
    assert sorted((r.id for r in found), key=str) == sorted(ids, key=str)
    assert all(r.told is None or r.told == (r.id in wanted) for r in found)
    open_ = sum(r.told is None for r in found)
    assert open_ < 10 if bits == 1 << 26 else open_ > 0
    assert not any(r.told for r in sieve.settled(rows, ["id"], rows.where("false"), "told").collect())


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_trusted_texts_stay_where_they_lie(spark, table, monkeypatch, bits):
    """Above the broadcast bound too, few texts go through the join, or all if the filter is full; results are the same."""
    from lithic import sieve

    rows, labels = table
    rows = [*rows, rows[2], (None, "no id " * 60)]
    frames = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    joined = []
    real = quality.log_ratios

    def counted(docs, known=None):
        joined.append(0 if known is None else known.count())
        return real(docs, known)

    monkeypatch.setattr(quality, "log_ratios", counted)
    same = sorted(quality.quality_rules(*frames).collect(), key=str)
    monkeypatch.setattr(quality, "FEW", 10)
    monkeypatch.setattr(sieve, "BITS", bits)
    assert sorted(quality.quality_rules(*frames).collect(), key=str) == same
    assert joined[0] == 0 and (joined[1] < 5 if bits > 64 else joined[1] > 20)
