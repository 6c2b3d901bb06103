"""Secret scans: fixed patterns and character Markov models.

The base patterns find assignments to secret-like names, access keys and
hexadecimal keys. On top, every other token of ``CANDIDATE`` characters, letters
and digits or either alone, is compared under two first-order character models,
one of random strings and one of ordinary identifiers. Its log-likelihood ratio
decides: it must exceed ``TOTAL`` for the token and ``MARGIN`` a character pair.
Shorter tokens cannot reach ``TOTAL`` with any certainty and are not compared.

The models are trained on the whole corpus, labelled by the patterns: the values
of all base finds are random strings, the words of all documents without any
find are ordinary, but for those that mix letters and digits over a candidate's
length. A random string hardly ever occurs twice, so an ordinary word counts
once less often than it occurs. Finds of a corpus show few of the forms that
random strings have: their model is mixed half and half with the even one over
all symbols. Equal strings are counted first, then their character pairs; only
the counts of pairs (at most two for each pair of symbols) come to the driver.
DataFrame operations alone; positions come from the lengths of the pieces
between matches, so they count code points.

Defined results: null and empty texts have no spans; repeated rows and null
ids are rows like others; without any find in the corpus there is no model and
no added span; tokens that touch a base span are never added; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from math import log
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import table

#: patterns of the contract, with the least length of a match, or of group 2 for assignments
NAMES = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"(?:{NAMES})[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
ASSIGN_HEAD = rf"^(?:{NAMES})[\"']?\x20*[:=]\x20*[\"']?"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")

#: the alphabet of the models; any other character is the last symbol
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=-_"
LEAST = 12
CANDIDATE = rf"[A-Za-z0-9+/=_-]{{{LEAST},}}"
#: weight, in pairs, of a symbol's own frequency in the models
BACKOFF = 20.0
#: share of the even model in that of random strings
EVEN = 0.5
#: nats by which the random model must be better: a token, a character pair
TOTAL, MARGIN = 20.0, 0.8


_FOUND = "array<struct<start:int,end:int,value:string>>"


def _matches(text: Column, pattern: str, needs: tuple[str, ...] = ()) -> Column:
    """Array of (start, end, value) of the pattern's matches, in code points.

    Only texts with one of the strings ``needs`` can have any.
    """
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zipped = F.filter(F.arrays_zip(values.alias("value"), gaps.alias("gap")), lambda x: x["value"].isNotNull())
    none = F.array().cast(_FOUND)

    def one(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        return F.struct(F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("found"), end.alias("at"))

    def piece(acc: Column, xs: Column) -> Column:
        found = F.aggregate(xs, F.struct(none.alias("found"), acc["at"].alias("at")), one, lambda a: a["found"])
        end = F.aggregate(xs, acc["at"], lambda at, x: at + F.length(x["gap"]) + F.length(x["value"]))
        return F.struct(F.concat(acc["found"], F.array(found)).alias("found"), end.alias("at"))

    def fold(xs: Column) -> Column:
        # a fold copies what it has found so far, so matches are folded in pieces of the root of their number
        width = F.ceil(F.sqrt(F.size(xs))).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / width).cast("int")), lambda k: F.slice(xs, k * width + 1, width))
        return F.aggregate(pieces, F.struct(F.array().cast(f"array<{_FOUND}>").alias("found"), F.lit(0).alias("at")), piece, lambda acc: F.flatten(acc["found"]))

    found = F.element_at(F.transform(F.array(zipped), fold), 1)  # the matches by a name, so that they are looked for once
    possible = F.rlike(text, F.lit(pattern))
    if needs:
        possible = reduce(or_, (F.contains(text, F.lit(x)) for x in needs)) & possible
    return F.when(possible, found).otherwise(none)


def _base(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with the base matches of each kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    assign = F.filter(_matches(F.col("text"), ASSIGN, (":", "=")), lambda m: F.length(F.regexp_replace(m["value"], ASSIGN_HEAD, "")) >= 6)
    return found.withColumns({"assign": assign, "access": _matches(F.col("text"), ACCESS, ("AKIA",)), "hex": _matches(F.col("text"), HEX)})


def _pair_counts(tokens: DataFrame) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """Counts of adjacent symbols in tokens(random, token), ordinary and random, but for ordinary ones that the models are to decide; symbol len(ALPHABET) is any other."""
    undecided = (F.length("token") >= LEAST) & F.rlike("token", F.lit("[0-9]")) & F.rlike("token", F.lit("[A-Za-z]"))
    strings = tokens.groupBy("random", "token").agg(F.count(F.lit(1)).alias("n")).where((F.length("token") > 1) & (F.col("random") | ~undecided))
    strings = strings.withColumn("n", F.when(F.col("random"), F.col("n")).otherwise(F.col("n") - 1)).where("n > 0")
    pairs = strings.select("random", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, F.lit(2)))).alias("pair"))
    index = lambda k: F.pmod(F.instr(F.lit(ALPHABET), F.substring("pair", k, 1)) - 1, F.lit(len(ALPHABET) + 1))
    counts: tuple[dict, dict] = ({}, {})
    for r in pairs.groupBy("random", index(1).alias("a"), index(2).alias("b")).agg(F.sum("n").alias("n")).collect():
        counts[r.random][r.a, r.b] = r.n
    return counts


def train(docs: DataFrame) -> list[float] | None:
    """log(p_random / p_ordinary) of every symbol pair, or None without random strings."""
    finds = F.concat(F.transform("assign", lambda m: F.regexp_replace(m["value"], ASSIGN_HEAD, "")), F.transform(F.concat("access", "hex"), lambda m: m["value"]))
    words = F.split("text", r"[^A-Za-z0-9+/=_-]+")
    found = _base(docs).select("text", finds.alias("finds"))
    some = F.size("finds") > 0
    tokens = found.select(some.alias("random"), F.explode(F.when(some, F.col("finds")).otherwise(words)).alias("token"))
    ordinary, random = _pair_counts(tokens)
    if not random:
        return None
    n = len(ALPHABET) + 1

    def model(counts: dict, even: float) -> list[float]:
        """Log probabilities of a symbol after another, drawn towards the symbol's own frequency and mixed with the even model."""
        rows = [sum(counts.get((a, b), 0) for b in range(n)) for a in range(n)]
        own = [sum(counts.get((a, b), 0) for a in range(n)) for b in range(n)]
        single = [(c + 1) / (sum(own) + n) for c in own]
        return [log((1 - even) * (counts.get((a, b), 0) + BACKOFF * single[b]) / (rows[a] + BACKOFF) + even / n) for a in range(n) for b in range(n)]

    return [x - y for x, y in zip(model(random, EVEN), model(ordinary, 0.0), strict=True)]


def _ratio(token: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a token of alphabet characters."""
    table_ = F.from_json(F.lit("[" + ",".join(f"{x:.6f}" for x in ratios) + "]"), "array<double>")
    symbol = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1))) - 1
    return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda acc, i: acc + F.element_at(table_, symbol(i) * (len(ALPHABET) + 1) + symbol(i + 1) + 1))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_spans, spans (kind:start:end), kinds after those listed are added ones."""
    found = _base(docs)
    ratios = train(docs)
    if ratios is None:
        found = found.withColumn("markov", F.array().cast(_FOUND))
    else:
        likely = lambda m: _ratio(m["value"], ratios) > F.greatest(F.lit(TOTAL), MARGIN * (F.length(m["value"]) - 1))
        known = F.concat("assign", "access", "hex")
        free = lambda m: ~F.exists(known, lambda k: (k["start"] < m["end"]) & (m["start"] < k["end"]))
        found = found.withColumn("markov", F.filter(F.filter(_matches(F.col("text"), CANDIDATE), likely), free))

    def spans_of(kind: str, order: int) -> Column:
        return F.transform(kind, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    tagged = lambda kinds: F.array_sort(F.concat(*(spans_of(k, n) for n, k in enumerate(kinds))))
    text = lambda kinds: F.array_join(F.transform(tagged(kinds), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        text(KINDS).alias("base_spans"),
        text((*KINDS, "markov")).alias("spans"),
    )


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
