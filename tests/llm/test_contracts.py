"""The numbered queries' operators against plain Python on small made-up tables.

The tables hold nulls in every column, empty and blank texts, long texts, exact
and near copies, repeated rows, non-ASCII text and columns whose names clash
with those that the operators add.
"""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lithic.llm import decontaminate, html_text, mixing, near_dedup, quality, secrets, sharding, substring_dedup, token_counts, warc
from lithic.llm.common import new_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, row string"
SPECIAL = [None, "", " \n\t ", "one", "Two words", "é ß 日本 😀 ſ", "a" * 70_000, "x " * 30_000]


def words(text):
    return WORD.findall(text or "")


def make_documents(seed=1, n=160):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéoß") for _ in range(rnd.randint(1, 7))) for _ in range(400)] + ["***", "THE!!", "a&b", "<p>"]
    base = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(5, 220))) for _ in range(n)]
    texts = list(base)
    texts += [base[k % 7] for k in range(40)]  # copies
    for k in range(40):  # near copies of one text, and of others
        own = base[3 if k % 2 else k].split()
        for _ in range(rnd.randint(0, 6)):
            own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
        texts.append(" ".join(own).upper() if k % 5 == 0 else "\n".join(own))
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    texts += [f"{rnd.choice(base)} {passage} {rnd.choice(base)}" for _ in range(12)] + SPECIAL
    rows = [(k, t, "en", rnd.choice(["s1", "s1", "s1", "s2", "é", None]), 0, -1, None, "clash") for k, t in enumerate(texts)]
    rows += [(None, base[0], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows + [rows[5], rows[5]]  # repeated rows


@pytest.fixture(scope="module")
def rows():
    return make_documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def same(found, expected):
    assert sorted(map(repr, found)) == sorted(map(repr, expected))


# ---------------------------------------------------------------- 1 mixing


def test_mixing_near_targets(docs, rows):
    found = mixing.mix_sources(docs).collect()
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in found:
        assert r["size"] == len(words(r.text)) and 0 <= r.taken <= 3 * r["size"] and r.taken == r.times * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(found) == len(rows) and {r.source: r.source_size for r in found} == dict(sizes)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    want, rest, open_ = {}, sum(sizes.values()), set(order)
    while open_:  # share, stop those above, share the excess again
        share = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        for s in over or open_:
            want[s] = 3 * sizes[s] if over else share * weight[s]
        rest -= sum(want[s] for s in over)
        open_ -= over or open_
    longest = max(len(words(r[1])) for r in rows)
    for s in order:
        assert math.isclose(target[s], want[s], rel_tol=1e-9) and abs(taken[s] - want[s]) <= longest
    assert sum(taken.values()) <= sum(sizes.values())
    again = mixing.mix_sources(docs.repartition(3)).collect()
    same([(r.doc_id, r.taken) for r in again], [(r.doc_id, r.taken) for r in found])


def test_mixed_documents_keep_columns(docs, nothing):
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    times = {r.doc_id: r.times for r in mixing.mix_sources(docs).where("doc_id is not null and doc_id <> 5").collect()}
    counts = {r.doc_id: r["count"] for r in mixed.where("doc_id is not null and doc_id <> 5").groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in times.items() if v}
    assert mixing.mix_sources(nothing).count() == 0


# ---------------------------------------------------------------- 2 quality


def plain_statistics(text):
    own = words(text)
    count = collections.Counter(zip(own, own[1:], own[2:], strict=False))
    repeat = [False] * len(own)
    for k in range(len(own) - 2):
        if count[tuple(own[k : k + 3])] > 1:
            repeat[k : k + 3] = [True] * 3
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(own) < 50 or 100 * sum(repeat) > 50 * len(own)
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, sum(repeat), failed


def test_quality_statistics(spark, docs, rows, nothing):
    labels = spark.createDataFrame([(k, k % 3 != 0, None) for k in range(120)] + [(None, True, 0)], "doc_id long, good boolean, toxic int").selectExpr("doc_id", "cast(good as int) as quality", "toxic")
    found = quality.quality_rules(docs, labels).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found], [(r[0], *plain_statistics(r[1])) for r in rows])
    assert not any(r.kept and r.base_failed for r in found)
    assert quality.quality_rules(nothing, labels).count() == 0
    assert all(r.kept != r.base_failed for r in quality.quality_rules(docs, labels.where("false")).collect())
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in found)


def test_quality_on_held_out_labels(spark, small):
    """Trained on half of the labels, it sorts the other half."""
    table = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{table}/documents.parquet"), spark.read.parquet(f"{table}/labels.parquet")
    found = quality.quality_rules(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    right = found.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert found.count() > 50 and right > 0.95


# ---------------------------------------------------------------- 3 near copies


def plain_components(rows, n, percent):
    sets = {}
    for r in rows:
        own = words((r[1] or "").translate(LOWER))
        sets[r[0]] = frozenset(zip(*(own[k:] for k in range(n)), strict=False)) if len(own) >= n else frozenset([tuple(own)] if own else [])
    ids = sorted(k for k in sets if k is not None)
    parent = {k: k for k in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sets, {k: root(k) for k in ids}


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, nothing, n, percent):
    sets, root = plain_components(rows, n, percent)
    found = near_dedup.near_duplicates(docs, n, percent, 6 if percent == 85 else 5).collect()
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert len(found) == len(rows) and {k: r.component_id for k, r in by_id.items()} == root
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in by_id.values())
    assert all(r.component_id is None and r.kept for r in found if r.doc_id is None)
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    """More near copies than a block holds, linked along a chain."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rnd = random.Random(4)
    own = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):
        own[rnd.randrange(len(own))] = f"n{k}"
        rows.append((k, " ".join(own)))
    _, root = plain_components(rows, 3, 85)
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 6).collect()
    assert {r.doc_id: r.component_id for r in found} == root


def test_common_boilerplate(spark, monkeypatch):
    """Texts that share half of their shingles make one cluster, in which few pairs are compared."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rnd = random.Random(6)
    fresh = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    common = fresh(80)
    rows = [(k, " ".join(common + fresh(40))) for k in range(600)]
    for k in range(0, 600, 50):  # with true copies among them
        own = rows[k][1].split()
        own[100] = "x"
        rows.append((1000 + k, " ".join(own)))
    dense = fresh(300)  # and a group that is linked at once
    rows += [(2000 + k, " ".join([*dense[: 100 + k], f"n{k}", *dense[100 + k :]])) for k in range(60)]
    _, root = plain_components(rows, 3, 85)
    sizes, sent = [], []
    first, within, between = near_dedup._first_links, near_dedup._within_buckets, near_dedup._between_blocks
    monkeypatch.setattr(near_dedup, "_first_links", lambda sets, *more: sizes.extend(r["count"] for r in sets.groupBy("cluster").count().collect()) or first(sets, *more))
    monkeypatch.setattr(near_dedup, "_within_buckets", lambda sets, buckets, *more: sent.append(buckets.count()) or within(sets, buckets, *more))
    monkeypatch.setattr(near_dedup, "_between_blocks", lambda sets, open_, *more: sent.append(open_.count()) or between(sets, open_, *more))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 6).collect()
    assert {r.doc_id: r.component_id for r in found} == root
    assert max(sizes) > 500 and sum(sent) < 20 * 600 < 600 * 600 / 8


def test_drop_near_duplicates_keeps_one_row(spark, docs, rows):
    """One row of each group: repeated rows, null ids and ids with several texts included."""
    more = [*rows, (7, rows[9][1], None, None, None, None, None, "other text"), (None, rows[30][1], None, None, None, None, None, None)]
    numbered = [(k, *r[1:]) for k, r in enumerate(sorted(more, key=lambda r: (r[0] is None, r[0] or 0)))]
    sets, root = plain_components(numbered, 5, 80)
    kept = near_dedup.drop_near_duplicates(spark.createDataFrame(more, SCHEMA).repartition(3))
    assert kept.columns == docs.columns
    order = sorted(more, key=lambda r: (r[0] is None, r[0] or 0))
    groups = {root[k] for k in sets if sets[k]}
    wordless = [order[k] for k in sets if not sets[k]]
    found = kept.collect()
    assert len(found) == len(groups) + len(wordless)
    # the least id of each group stays
    least = collections.Counter(order[g][0] for g in groups) + collections.Counter(r[0] for r in wordless)
    assert collections.Counter(r.doc_id for r in found) == least


# ---------------------------------------------------------------- 4 pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div id="cookie-notice">We use cookies</div>
<div class="left sidebar"><p>A long sidebar text that goes on and on for a while, really.</p></div><!-- ad --><div class='ad'>Buy this now, it is cheap.</div>
<article><h1>Title &amp;
  more</h1><p><b>First&nbsp;para</b> &lt;x&gt; &#233;<br>line<p>Second.</p><form><input name=q><p>Form text</p></form><p>Third</p>
<section class="comments"><p>A reader wrote a very long comment about this article here.</p></section></article>
<aside>Related things</aside><footer>&copy; someone</footer></body></html>"""


def test_pages(spark):
    pages = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, None, "<p>only <i>text</i>"), (5, "u", "<div><p>" + "word " * 30_000 + "</p></div>"), (6, "u", "<script>x"), (6, "u", "a < b <br/> c")]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    found = [(r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract_text(frame).collect()]
    first = "Title & more\nFirst para <x> é line\nSecond.\nThird"
    expected = [first, "", "", "only text", ("word " * 30_000).strip(), "", "a < b c"]
    same(found, [(p[0], p[1], t, len(t)) for p, t in zip(pages, expected, strict=True)])
    assert html_text.extract_text(frame.limit(0)).count() == 0


def test_dense_text_without_marks():
    menu = "".join(f'<div><a href="/{k}">Item {k}</a></div>' for k in range(12))
    body = "".join(f"<p>{'Some real sentence about things. ' * 4}</p>" for _ in range(5))
    found = html_text.main_text(f"<body>{menu}{body}{menu}</body>")
    assert found.count("Some real sentence") == 20 and "Item" not in found


# ---------------------------------------------------------------- 5 archives


@pytest.mark.parametrize("split", [20_000, 1 << 27])
def test_archive_round_trip(spark, split):
    fake = f"x{warc.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n{warc.MAGIC}Content-Length: 3"
    pages = [(1, "u", "a"), (2, "u", "a"), (3, None, None), (4, "u v\n", ""), (5, "u", fake), (6, "u", fake), (7, "u", warc.MAGIC), (None, "u", "a"), (None, "u", "zz"), (8, "é", "é😀\r\n\r\nx"), (9, "u", "y" * 100_000 + fake * 50), (10, "u", warc.MAGIC * 3 + "WARC/1.1\r")]
    first = {}
    for page_id, _, html in pages:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", 1 << 62), page_id)
    expected = []
    for page_id, _, html in pages:
        raw, lead = (html or "").encode(), first.get(html or "")
        again = lead is not None and page_id != lead
        expected.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", lead if again else None))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    clash = "page_id long, url string, html string, digest string, bytes int, first string, value string"
    try:
        for frame, result in ((spark.createDataFrame([(*p, "x", 1, "y", "z") for p in pages], clash).repartition(2), expected), (spark.createDataFrame([], "page_id long, url string, html string"), [])):
            path = new_path(spark, "warc")
            warc.write_archives(frame, path)
            same([tuple(r) for r in warc.read_archives(spark, path).drop("url").collect()], result)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


# ---------------------------------------------------------------- 6 shards


def test_shards(docs, rows, nothing):
    found = sharding.assign_shards(docs).collect()
    slots = collections.defaultdict(list)
    for r in found:
        raw = (r.text or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert len(found) == len(rows) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.assign_shards(nothing).count() == 0


def test_shards_follow_weights_and_move_little(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    base = sharding.zone_tree(0)
    heavy = [(a, b, c, 3.0 if c == 5 else w) for a, b, c, w in base]
    both = ids.select(sharding.shard_of(F.col("doc_id"), base).alias("a"), sharding.shard_of(F.col("doc_id"), heavy).alias("b")).groupBy("a", "b").count().collect()
    share = sum(r["count"] for r in both if r.b == 5) / 20_000
    assert abs(share - 3 / 18) < 0.02
    # movement stays below nodes whose weights changed: into region 1 (shards 4-7), and there towards shard 5
    assert all(r.a == r.b or r.b // 4 == 1 for r in both)
    sizes = collections.Counter()
    for r in both:
        sizes[r.a] += r["count"]
    assert max(sizes.values()) < 1.2 * 20_000 / 16


# ---------------------------------------------------------------- 7 decontamination


@pytest.mark.parametrize("block", [3, 20_000])
def test_decontamination(spark, docs, rows, nothing, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block)
    inside = [ALNUM.findall((r[1] or "").translate(LOWER)) for r in rows]
    items = [("b", " ".join(inside[2][3:30])), ("c", " ".join(inside[2][6:34])), ("a", " - ".join(inside[8][:12]).upper()), ("short", " ".join(inside[9][4:7])), ("none", "... !"), ("null", None), (None, " ".join(inside[11][:11])), ("b", "zz yy xx ww"), ("é", "é ß 日本")]
    windows = collections.defaultdict(set)
    for item, text in items:
        own = ALNUM.findall((text or "").translate(LOWER))
        size = min(10, len(own))
        for k in range(len(own) - size + 1 if size else 0):
            windows[tuple(own[k : k + size])].add(item)
    expected = []
    for r, own in zip(rows, inside, strict=True):
        hit, found = [False] * len(own), set()
        for size in {len(w) for w in windows}:
            for k in range(len(own) - size + 1):
                if tuple(own[k : k + size]) in windows:
                    hit[k : k + size] = [True] * size
                    found |= windows[tuple(own[k : k + size])] - {None}
        expected.append((r[0], len(own), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    benchmark = spark.createDataFrame([(*x, 1) for x in items], "item_id string, text string, row int")
    found = decontaminate.decontaminate(docs, benchmark)
    same([tuple(r)[:6] for r in found.collect()], expected)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in found.collect())
    clean = decontaminate.drop_contaminated(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == sum(not e[5] for e in expected)
    assert decontaminate.decontaminate(nothing, benchmark).count() == 0
    assert decontaminate.decontaminate(docs, benchmark.limit(0)).where("contaminated").count() == 0


def test_one_block_of_phrases_at_a_time(spark, docs, monkeypatch):
    """A benchmark larger than a block is never held whole: each block is gone before the next is read."""
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 10)
    sent, send = [], decontaminate.send_block

    def watched(*given):
        assert all(s._path is None or not s._jbroadcast.isValid() for s in sent)
        sent.append(send(*given))
        assert len(sent[-1].value[0]) < 40
        return sent[-1]

    monkeypatch.setattr(decontaminate, "send_block", watched)
    texts = [r.text for r in docs.where("length(text) between 200 and 2000").orderBy("doc_id").limit(100).collect()]
    benchmark = spark.createDataFrame([(f"i{k}", " ".join(t.split()[:12])) for k, t in enumerate(texts)], "item_id string, text string")
    found = decontaminate.decontaminate(docs, benchmark)
    assert len(sent) == 10
    monkeypatch.undo()
    same([tuple(r) for r in found.collect()], [tuple(r) for r in decontaminate.decontaminate(docs, benchmark).collect()])


# ---------------------------------------------------------------- 8 secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def plain_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def test_secrets(spark):
    rnd = random.Random(3)
    code = lambda n, letters: "".join(rnd.choice(letters) for _ in range(n))
    hexa, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = [f"é😀 some words {'password' if k % 2 else 'API_KEY'}: \"{code(24, mixed)}\" and hash {code(40, hexa)} end AKIA{code(16, 'ABCDEFGHIJ234567')}" for k in range(60)]
    texts += [" ".join(rnd.choice(["ordinary", "identifiers", "ofwords", "continue", "some_function_name"]) for _ in range(80)) for _ in range(60)]
    texts += ["token=secret=abcdefgh", "secret=token:abcdefgh", "passwd='short'", "AKIAAKIA" + "A" * 14, "AKIA123", "f" * 23, "f" * 24 + "g" + "0" * 30, "Secret = x.y-z/long==", "key 9fQ2xLr8Tz0bVw7KpY3mNc", None, "", "a" * 60_000]
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, texts[0], "x")], "doc_id long, text string, assign string")
    found = {r.doc_id: r for r in secrets.find_secrets(frame).collect()}
    for k, text in enumerate(texts):
        base = plain_spans(text)
        assert found[k].base_spans == ",".join(base)
        assert [found[k].n_assign, found[k].n_access, found[k].n_hex] == [sum(s.startswith(kind) for s in base) for kind in secrets.KINDS]
        assert set(base) <= set(found[k].spans.split(",")) | {""}
    added = {k for k, r in found.items() if "markov" in r.spans}
    assert texts.index("key 9fQ2xLr8Tz0bVw7KpY3mNc") in added and not added & set(range(60, 120))
    assert secrets.find_secrets(frame.limit(0)).count() == 0


def test_planted_secrets(spark):
    """Random strings of letters, of letters and digits and of base 64, in documents without any base find."""
    rnd = random.Random(11)
    table = "/root/testdata/sf0.01"
    alphabets = ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    planted, docs = {}, []
    for r in spark.read.parquet(f"{table}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect():
        if r.doc_id % 5 == 0 and r.text and not plain_spans(r.text):
            code = "".join(rnd.choice(alphabets[r.doc_id % 4]) for _ in range(rnd.randint(20, 40)))
            planted[r.doc_id] = f"markov:{len(r.text) + 1}:{len(r.text) + 1 + len(code)}"
            docs.append((r.doc_id, f"{r.text} {code} end"))
        else:
            docs.append((r.doc_id, r.text))
    found = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("markov")] for r in secrets.find_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    right = sum(p in found[k] for k, p in planted.items())
    added = sum(map(len, found.values()))
    assert len(planted) > 100 and right >= 0.95 * len(planted) and right >= 0.9 * added


def test_many_matches_in_one_text(spark):
    text = " ".join(f"token={k:06d}" for k in range(9000))
    row = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_assign == 9000 and row.base_spans == ",".join(plain_spans(text))


# ---------------------------------------------------------------- 9 tokens


def test_token_counts(docs, rows, nothing):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    found = token_counts.token_counts(docs, path).collect()
    same([tuple(r) for r in found], [(r[0], len((r[1] or "").encode()), count(r[1]), count(r[1]) > 1024) for r in rows])
    assert token_counts.token_counts(nothing, path).count() == 0
    counter = token_counts.Counter(token_counts.Vocabulary(open(path, "rb").read()))
    rnd = random.Random(5)
    parts = ["a", "B", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "日", "1", "²", "́", "😀", "'s", "'LL", "<|endoftext|>", "<|endoftext", "the", "_"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    assert [counter.count(t) for t in texts] == [count(t) for t in texts]


def test_other_vocabularies_are_refused():
    import json

    public = pytest.importorskip("public_tokenizers")
    spec = json.load(open(public.path("byte_bpe_50k.json")))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"ignore_merges": True}}, {"added_tokens": [{"content": "<x>", "lstrip": True}]}):
        with pytest.raises(ValueError, match="byte-level"):
            token_counts.Vocabulary(json.dumps(spec | change).encode())


# ---------------------------------------------------------------- 10 passages


@pytest.mark.parametrize(("window", "cells"), [(35, 1 << 29), (20, 1 << 29), (1, 1 << 29), (35, 1), (20, 1)])
def test_repeated_windows(docs, rows, nothing, window, cells, monkeypatch):
    """With the sketch broadcast, and with one that is too large for that."""
    monkeypatch.setattr(substring_dedup, "HOLD", 3000)
    monkeypatch.setattr(substring_dedup, "MAX_CELLS", cells)
    monkeypatch.setattr(substring_dedup, "BLOCK_CELLS", 1 << (20 if cells > 1 else 12))
    count = collections.Counter(tuple(w[k : k + window]) for w in (words(r[1]) for r in rows) for k in range(len(w) - window + 1))
    expected = []
    for r in rows:
        own = words(r[1])
        gone = [False] * len(own)
        for k in range(len(own) - window + 1):
            if count[tuple(own[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        expected.append((r[0], len(own), sum(gone), " ".join(w for w, g in zip(own, gone, strict=True) if not g)))
    same([tuple(r) for r in substring_dedup.remove_repeats(docs, window).collect()], expected)
    assert substring_dedup.remove_repeats(nothing, window).count() == 0
