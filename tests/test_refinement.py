"""Order statistics by refinement and intervals in dyadic trees, against brute force."""

import math
import random

from pyspark.sql import functions as F

from lithic.operators.graph import enclosing
from lithic.operators.quantiles import exact_ranks, middle_and_p95
from lithic.operators.symbols import dyadic_nodes, nest


def test_middle_and_p95_of_many_groups(spark):
    rnd = random.Random(4)
    groups = {"normal": [rnd.gauss(0, 1) for _ in range(3000)], "ties": [1.0] * 700 + [2.0] * 701, "wide": [10.0 ** rnd.uniform(-300, 300) * rnd.choice((1, -1)) for _ in range(900)], "one": [3.5], "two": [1.0, 2.0], None: [float(k) for k in range(100)], "odd": [math.inf, -math.inf, 0.0, 5e-324]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("one", None), ("none", None)]
    rnd.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, v double").repartition(6)
    for few in (4, 50, 4096):
        found = {r.g: (r.n, r.mid, r.p95) for r in middle_and_p95(frame, ["g"], "v", few).collect()}
        for g, values in groups.items():
            s, n = sorted(values), len(values)
            assert found[g] == (n, (s[(n + 1) // 2 - 1] + s[n // 2]) / 2, s[max(math.ceil(0.95 * n), 1) - 1]), (g, few)
        assert found["none"] == (0, None, None) and len(found) == len(groups) + 1


def test_ten_million_distinct_values_in_a_group(spark):
    """The values left to put in order are few, whatever the group's size."""
    n = 10_000_000
    rows = spark.range(n).select(F.lit("hot").alias("g"), ((F.col("id") * 7_777_777) % n).alias("v"))
    (found,) = exact_ranks(rows, ["g"], "v", {"first": F.lit(1), "mid": F.floor(F.col("n") / 2), "last": F.col("n")}).collect()
    assert tuple(found) == ("hot", n, 0, n // 2 - 1, n - 1)


def test_dyadic_nodes(spark):
    rnd = random.Random(5)
    spans = [(0, 0), (0, 1023), (1, 1023), (5, 5), (3, 1_000_000), (1 << 40, (1 << 40) + 12345)] + [tuple(sorted((rnd.randrange(5000), rnd.randrange(5000)))) for _ in range(200)]
    rows = spark.createDataFrame(spans, "s long, e long").select("s", "e", dyadic_nodes(F.col("s"), F.col("e")).alias("nodes")).collect()
    for r in rows:
        covered = sorted((n.place << n.level, (n.place + 1 << n.level) - 1) for n in r.nodes)
        assert covered[0][0] == r.s and covered[-1][1] == r.e and all(a[1] + 1 == b[0] for a, b in zip(covered, covered[1:], strict=False))
        assert len(r.nodes) <= 2 * math.log2(r.e - r.s + 2)


def test_long_spans_are_not_copied_along_their_length(spark):
    """A class around a megabyte of text, nested ones inside it, and facts at all depths."""
    spans = [(1, k, f"n{k}", k * 10, 1_000_000 - k * 10) for k in range(40)] + [(1, 100 + k, f"m{k}", 500_000 + 3 * k, 500_001 + 3 * k) for k in range(300)] + [(2, 900, "other", 0, 5)]
    symbols = spark.createDataFrame(spans, "file_id long, symbol long, name string, start_at long, end_at long")
    copies = symbols.select(F.size(dyadic_nodes(F.col("start_at"), F.col("end_at"))).alias("k")).agg(F.sum("k")).first()[0]
    assert copies <= 2 * 20 * len(spans)

    def around(file_id, at):
        inside = [(s, -e, k) for f, k, _, s, e in spans if f == file_id and s <= at <= e]
        return max(inside)[2] if inside else None

    points = [(f, k, at) for k, (f, at) in enumerate((f, at) for f in (1, 2, 3) for at in (0, 5, 9, 10, 395, 499_999, 500_000, 500_001, 500_002, 999_999, 1_000_000, 1_000_001))]
    facts = spark.createDataFrame(points, "file_id long, fact long, at long")
    assert {r.fact: r.symbol for r in enclosing(facts, symbols.select("file_id", "symbol", "start_at", "end_at")).collect()} == {k: around(f, at) for f, k, at in points}
    found = {r.symbol: (r.parent, r.qualified_name) for r in nest(symbols).collect()}
    for f, k, name, s, e in spans:
        outer = sorted((s2, -e2, k2, n2) for f2, k2, n2, s2, e2 in spans if f2 == f and (s2 < s and e2 >= e or s2 == s and e2 > e))
        assert found[k] == ((outer[-1][2], ".".join([n for *_, n in outer] + [name])) if outer else (None, None))
