"""Hard negatives, token alignment and token files against plain Python on small made-up tables."""

import collections
import functools
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lithic.llm import hard_negatives, perfect_hash, token_alignment, token_files
from lithic.llm.common import new_path

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n", "one", " lead", "trail ", "a  b", "  a   b  ", "a\n\nb c\td", "don't we'll  x", "tab\x1c d\x85e f", "nul \x00 x", "<|endoftext|>", "so <|endoftext|>ends", "<s> x </s> <unk>",
    "a▁b ▁c", "é ß 日本語 😀 ſ ﬁ ½", "zero​width a b", "é ̈x", "x" * 70_000, "x " * 20_000, " " * 3000, "日本" * 9000, "a" + " " * 40 + "b", "word.\nNext line, and (more) 12345 67,890.5",
]
SCHEMA = "doc_id long, text string, n long, digest string, start long, part int"


def texts(seed=3):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéoß") for _ in range(rnd.randint(1, 9))) for _ in range(300)] + ["the", "The", "and,", "end.\n", "\n", "x1", " ", "日本"]
    made = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 90))) for _ in range(60)]
    return ODD + made + [made[0]] * 30


@pytest.fixture(scope="module")
def rows():
    made = [(3 * k - 40, t, 7, "d", -1, 9) for k, t in enumerate(texts())]
    return [*made, made[30], made[30], (5, "not the same text", 0, "", 0, 0), (5, "the same id", 0, "", 0, 0), (None, "no id", 0, "", 0, 0), (None, None, 0, "", 0, 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


# ---- operator 11


def negatives_of(rows):
    """All results by sorting all scores."""
    held = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        held.append((vec_id, [math.floor(256 * x) for x in vector], label))
    out = []
    for a, (vec_id, q, label) in enumerate(held):
        if vec_id is None or vec_id % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, r, strict=False)), i is None, i or 0, k) for k, (i, r, _) in enumerate(held) if k != a)
        scored = [(-s, None if null else i, held[k][2]) for s, null, i, k in scored]
        for p, positive, _ in [x for x in scored if x[2] == label][:5]:
            fit = [(s, i) for s, i, other in scored if other != label and 50 * p <= 100 * s <= 95 * p]
            out += [(vec_id, positive, r, i, p, s) for r, (s, i) in enumerate(fit[:3], 1)]
    return out


def vectors(seed, n=260, dims=6, labels=10):
    rnd = random.Random(seed)
    rows = [(k, [rnd.gauss(0, 1) + (k % 3) for _ in range(dims)], rnd.randrange(labels)) for k in range(n)]
    rows += [(k, [0.5] * dims, k % 2) for k in range(1000, 1060)]  # ties
    return rows


@pytest.mark.parametrize("block, portion", [(16, 600), (8192, 8 << 20)])
def test_hard_negatives(spark, block, portion):
    rows = vectors(1)
    odd = [
        (None, [1.0] * 6, 1), (2000, None, 1), (2050, [1.0] * 6, None), (2100, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (2150, [math.nan] * 6, 1), (2151, [math.inf] * 6, 1), (2200, [], 3), (2250, [0.0] * 6, 3), (2300, [1.5] * 3, 2),
        (2350, [1.0] * 9, 2), (-50, [-1.0] * 6, 4), (-7, [2.0] * 6, 4), rows[50], rows[50], rows[51], rows[53],
    ]
    rows += odd
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, n long, q long").repartition(4)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    found = [tuple(r) for r in hard_negatives.hard_negatives(frame, block=block, portion=portion).collect()]
    assert sorted(found, key=repr) == sorted(negatives_of(rows), key=repr) and len(found) > 30


def test_hard_negatives_beyond_exact_doubles(spark):
    rows = [(k * 25, [2.0**20 * (k % 5) + k, 3.0 + k, 2.0**18], k % 3) for k in range(40)]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = [tuple(r) for r in hard_negatives.hard_negatives(frame(rows)).collect()]
    assert sorted(found) == sorted(negatives_of(rows)) and max(r[4] for r in found) > 1 << 53
    wider = hard_negatives.hard_negatives(frame([(i, [x * 2**30 for x in v], label) for i, v, label in rows]))
    assert all(abs(r[4]) < 1 << 63 for r in wider.collect())  # scores beyond a long are held at its bounds


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.hard_negatives(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(50, [1.0], 1)], "vec_id long, embedding array<float>, label int")).count() == 0


def test_a_walk_stops_early():
    """On lists where one component decides, few rows are scored, and the best are right."""
    import pyarrow as pa

    n = 4000
    q = [[n - k, k % 3, 1] for k in range(n)]
    rows = hard_negatives.Rows(pa.table({"vec_id": range(n), "label": [1] * n, "q": q, "n": [1] * n}))
    window = hard_negatives.Window(5, True, float("-inf"), float("inf"))
    anchor = hard_negatives.Anchor(0, rows, [window])
    values = rows.q.astype(float)
    assert hard_negatives.Lists(rows, values).walk(anchor, values[0]) < n / 10
    assert [i for _, _, i in window.best] == [1, 2, 3, 4, 5]


# ---- operator 12


def alignment_of(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {chr(c): bytes([c]) for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    letters |= {chr(256 + k): bytes([c]) for k, c in enumerate(c for c in range(256) if chr(c) not in letters)}

    def aligned(text):
        if not text:
            return None
        raw = (" " + text).encode()
        one, two = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        left = [b"".join(letters[c] for c in a.id_to_token(i)) for i in one]
        right = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in two]
        if b"".join(left) != raw or b"".join(right) != raw:
            return None
        end_a, end_b = np.cumsum([len(x) for x in left]).tolist(), np.cumsum([len(x) for x in right]).tolist()
        at_a, at_b = {e: k + 1 for k, e in enumerate(end_a)}, {e: k + 1 for k, e in enumerate(end_b)}
        groups, i, j = [], 0, 0
        for end in sorted(set(end_a) & set(end_b)):
            groups.append((one[i : at_a[end]], two[j : at_b[end]]))
            i, j = at_a[end], at_b[end]
        return one, two, groups

    found = [aligned(r[1]) for r in rows]
    links = [collections.Counter((x, y) for g in f[2] for x in g[0] for y in g[1]) if f else collections.Counter() for f in found]
    counts = collections.Counter(pair for own in links for pair in own)
    highest = collections.defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = []
    for row, f, own in zip(rows, found, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in f[2]) if f else None
        digest = hashlib.sha256(text.encode()).hexdigest() if text is not None else ""
        one, two, groups = f or ([], [], [])
        out.append((row[0], len(one), len(two), len(groups), sum(own.values()), sum(n for p, n in own.items() if counts[p] == highest[p[0]]), sum(n * counts[p] for p, n in own.items()), digest))
    return out


def test_alignment(docs, rows):
    expected = sorted(map(repr, alignment_of(rows)))
    for together in (1 << 22, 900):  # one slice of the pairs, and many
        found = token_alignment.align_tokens(docs, A, B, together)
        assert sorted(repr(tuple(r)) for r in found.collect()) == expected
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_each_distinct_text_is_aligned_once(docs, rows):
    aligned = token_alignment.aligned_texts(docs, A, B)
    distinct = collections.Counter(r[1] for r in rows if r[1])
    assert aligned.count() == aligned.select("digest").distinct().count() <= len(distinct)
    assert {r["digest"]: r["n"] for r in aligned.collect()}.items() <= {hashlib.sha256(t.encode()).hexdigest(): n for t, n in distinct.items()}.items()


def test_alignment_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert token_alignment.align_tokens(empty, A, B).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, token_alignment.align_tokens(blank, A, B).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_pieces_across_words_are_refused():
    class Model:
        get_piece_size = lambda self: 1
        id_to_piece = lambda self, i: "▁a▁b"
        is_byte = lambda self, i: False

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(token_alignment.sentencepiece, "SentencePieceProcessor", lambda **_: Model())
        with pytest.raises(ValueError, match="across words"):
            token_alignment.Pieces(b"")


# ---- operator 13


@functools.cache
def library():
    return Tokenizer.from_file(A)


def encoded(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 2]


@pytest.fixture(scope="module")
def written(spark, docs):
    path = new_path(spark, "ids")
    token_files.write_token_files(docs, path, A, shard_ids=500)
    return path


def test_token_files(spark, rows, written):
    found = [tuple(r) for r in token_files.read_documents(spark, written).orderBy("start").collect()]
    expected = collections.Counter((r[0], len(ids := encoded(r[1])), zlib.crc32(np.array(ids, dtype="<u4").tobytes())) for r in rows)
    assert collections.Counter((i, n, c) for i, _, n, c in found) == expected
    keys = [r[0] for r in found]
    assert keys == sorted(keys, key=lambda k: (k is None, k or 0))
    assert [r[1] for r in found] == [0, *np.cumsum([r[2] for r in found])[:-1].tolist()]
    assert spark.read.schema(token_files.SHARD).parquet(written).count() > 20


def test_payloads_are_raw_ids(spark, written):
    for row in spark.read.schema(token_files.SHARD).parquet(written).collect():
        assert len(row["payload"]) == row["n_ids"] * row["width"] and row["width"] == 2
        assert len(row["slots"]) == 12 * len({k for k in row["keys"] if k is not None})  # minimal: a slot a key


@pytest.mark.parametrize("routes", [1 << 20, 3])
def test_lookup(spark, rows, written, routes, monkeypatch):
    monkeypatch.setattr(token_files, "ROUTES", routes)
    wanted = [r[0] for r in rows if r[0] is not None][::2] + [5, 5, -(1 << 60), 1 << 60, 0, 1, None]
    found = token_files.lookup(spark, written, spark.createDataFrame([(k,) for k in wanted], "doc_id long"))
    expected = collections.Counter((r[0], tuple(encoded(r[1]))) for r in rows if r[0] is not None and r[0] in wanted)
    assert collections.Counter((r[0], tuple(r[1])) for r in found.collect()) == expected


def test_token_files_of_nothing(spark):
    path = new_path(spark, "ids")
    token_files.write_token_files(spark.createDataFrame([], SCHEMA), path, A)
    assert token_files.read_documents(spark, path).count() == 0
    assert token_files.lookup(spark, path, spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_perfect_hash():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 5000, 200_000):
        keys = np.unique(rnd.integers(-(1 << 63), (1 << 63) - 1, n, dtype=np.int64)) if n % 2 else np.arange(n, dtype=np.int64) - 7
        levels = perfect_hash.build(keys)
        assert np.array_equal(np.sort(perfect_hash.slots(levels, keys)), np.arange(len(keys)))
        assert sum(map(len, levels)) <= 1000 + len(keys)  # some 5 bits a key
        other = perfect_hash.slots(levels, keys + (1 << 40)) if n else np.array([])
        assert ((other >= -1) & (other < max(len(keys), 1))).all()


def test_whole_tables(spark, small):
    """The queries on the given documents: each against the libraries' own encoding of whole texts."""
    documents = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    start, expected = 0, []
    for doc_id, text in documents:
        ids = encoded(text)
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_files.op13_token_files(spark, small).collect())) == expected
    aligned = token_alignment.op12_token_alignment(spark, small).select("doc_id", F.col("n_a"), "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(repr, map(tuple, aligned.collect()))) == sorted(map(repr, alignment_of([tuple(r) for r in documents])))
