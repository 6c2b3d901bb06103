"""Catalogue queries: search, facets, rollups, top-k, neighbours and map places."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithic.functions.hashing import unit_hash
from lithic.operators.catalogue import CATEGORIES, CLASSIFIED, catalogue_order, classify
from lithic.operators.nearest import nearest_in_group
from lithic.operators.ordering import number_rows
from lithic.registry import query

_CATEGORY_ROWS = ", ".join(f"({k}, '{c}')" for k, c in enumerate(CATEGORIES))
C = f"({CLASSIFIED}) c"


def _classified(t) -> DataFrame:
    return classify(t("repos")).withColumn("ordinal", F.col("id"))


def search(rows: DataFrame, category: str | None = None, language: str | None = None, topic: str | None = None, needle: str = "", subgroup: bool = False) -> DataFrame:
    """Rows that meet every condition given; the needle may stand anywhere in their text."""
    fields = ["name", "description", "category", *(["subgroup"] if subgroup else []), "language"]
    text = F.lower(F.concat_ws(" ", *(F.coalesce(f, F.lit("")) for f in fields), F.array_join("topics", " ")))
    wanted = needle.strip().lower()
    conditions = [F.col("category") == category if category else None, F.col("language") == language if language else None, F.array_contains("topics", topic) if topic else None, F.contains(text, F.lit(wanted)) if wanted else None]
    for condition in conditions:
        if condition is not None:
            rows = rows.where(condition)
    return rows


@query("qry1", f"""SELECT id FROM {C} WHERE language = 'Java' AND list_contains(topics, 'kafka') AND contains(lower(concat_ws(' ', name, coalesce(description, ''), category, language, array_to_string(topics, ' '))), 'spring')""")
def qry1_search(t):
    return search(_classified(t), language="Java", topic="kafka", needle="  Spring ").select("id")


@query("qry2", "SELECT id, row_number() OVER (ORDER BY pushed_at DESC NULLS LAST, id) AS by_push, row_number() OVER (ORDER BY name COLLATE en, id) AS by_name, row_number() OVER (ORDER BY forks DESC, id) AS by_forks FROM repos")
def qry2_sort(t):
    rows = t("repos").select("id", "pushed_at", "name", "forks")
    for order, out in (([F.desc_nulls_last("pushed_at")], "by_push"), ([F.collate("name", "UNICODE")], "by_name"), ([F.desc("forks")], "by_forks")):
        rows = number_rows(rows, [*order, F.asc("id")], out)
    return rows.select("id", "by_push", "by_name", "by_forks")


@query("qry3", f"""SELECT id FROM {C} WHERE contains(lower(concat_ws(' ', name, coalesce(description, ''), category, subgroup, coalesce(language, ''), array_to_string(topics, ' '))), 'containers') ORDER BY stars DESC, coalesce(pushed_at, '') DESC, id LIMIT 6""")
def qry3_quick_search(t):
    found = search(_classified(t), needle="containers", subgroup=True)
    return found.orderBy(*catalogue_order()).limit(6).select("id")


@query("qry4", "SELECT DISTINCT language FROM repos WHERE language <> ''")
def qry4_languages(t):
    return t("repos").where("language <> ''").select("language").distinct()


def topic_facet(rows: DataFrame, n: int) -> DataFrame:
    """The n commonest topics; ties in the order in which they are first seen."""
    each = rows.select("ordinal", F.posexplode("topics").alias("place", "topic"))
    counted = each.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ordinal", "place")).alias("seen"))
    return counted.orderBy(F.desc("n"), "seen").limit(n).select("topic", "n")


def _topic_sql(n: int) -> str:
    return f"""SELECT topic, count(*) AS n FROM (SELECT id, unnest(topics) AS topic, generate_subscripts(topics, 1) AS place FROM repos) q GROUP BY topic ORDER BY n DESC, min(id * 10 + place) LIMIT {n}"""


@query("qry5", _topic_sql(30))
def qry5_topics(t):
    return topic_facet(t("repos").withColumn("ordinal", F.col("id")), 30)


def category_counts(rows: DataFrame) -> DataFrame:
    """(place, category, n) for every category in fixed order, 0 where there is none."""
    names = rows.sparkSession.createDataFrame(list(enumerate(CATEGORIES)), "place int, category string")
    counts = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "category", "left").select("place", "category", F.coalesce("n", F.lit(0)).alias("n"))


_COUNTS = f"(SELECT place, category, count(c.id) AS n FROM (VALUES {_CATEGORY_ROWS}) v(place, category) LEFT JOIN {C} USING (category) GROUP BY place, category) k"


@query("qry6", f"SELECT place, category, n FROM {_COUNTS}")
def qry6_category_counts(t):
    return category_counts(_classified(t))


@query("qry7", f"SELECT category, n, row_number() OVER (ORDER BY n DESC, place) AS k, row_number() OVER (ORDER BY n DESC, place) <= 5 AS leading FROM {_COUNTS}")
def qry7_category_split(t):
    k = F.row_number().over(W.orderBy(F.desc("n"), "place")).cast("long")  # nine rows
    return category_counts(_classified(t)).select("category", "n", k.alias("k")).withColumn("leading", F.col("k") <= 5)


@query("qry8", f"SELECT category, subgroup, count(*) AS n FROM {C} GROUP BY ROLLUP (category, subgroup) HAVING grouping(category) = 0")
def qry8_subgroups(t):
    rolled = _classified(t).rollup("category", "subgroup").agg(F.count(F.lit(1)).alias("n"), F.grouping("category").alias("g"))
    return rolled.where("g = 0").select("category", "subgroup", "n")


@query(
    "qry9",
    f"""WITH c AS MATERIALIZED (SELECT * FROM {C}), s AS (SELECT category, string_agg(subgroup, '|' ORDER BY n DESC, subgroup) AS subgroups FROM (SELECT category, subgroup, count(*) AS n FROM c GROUP BY 1, 2) q GROUP BY 1),
    l AS (SELECT category, string_agg(language, '|' ORDER BY seen) AS languages FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY seen) AS k FROM (SELECT category, language, min(id) AS seen FROM c WHERE language IS NOT NULL GROUP BY 1, 2) q) r WHERE k <= 4 GROUP BY 1),
    b AS (SELECT category, string_agg(id::VARCHAR, '|' ORDER BY stars DESC, id) AS best FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY stars DESC, id) AS k FROM c) q WHERE k <= 3 GROUP BY 1),
    n AS (SELECT category, count(*) AS n FROM c GROUP BY 1)
    SELECT category, n, CAST(floor(100.0 * n / (SELECT count(*) FROM c) + 0.5) AS BIGINT) AS percent, subgroups, languages, best FROM n JOIN s USING (category) LEFT JOIN l USING (category) JOIN b USING (category)""",
)
def qry9_cards(t):
    return category_cards(_classified(t))


def category_cards(rows: DataFrame) -> DataFrame:
    """One card a category: subgroups by size, first languages, best repositories, share."""
    joined = lambda pieces, value: F.array_join(F.transform(F.array_sort(F.collect_list(pieces)), lambda p: p[value].cast("string")), "|")
    groups = rows.groupBy("category", "subgroup").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.groupBy("category").agg(F.sum("n").alias("n"), joined(F.struct((-F.col("n")).alias("o"), "subgroup"), "subgroup").alias("subgroups"))
    languages = rows.where("language is not null").groupBy("category", "language").agg(F.min("ordinal").alias("seen"))
    languages = languages.groupBy("category").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("seen", "language"))), 1, 4), lambda p: p["language"]), "|").alias("languages"))
    best = rows.withColumn("k", F.row_number().over(W.partitionBy("category").orderBy(F.desc("stars"), "ordinal"))).where("k <= 3")
    best = best.groupBy("category").agg(joined(F.struct("k", "id"), "id").alias("best"))
    total = groups.agg(F.sum("n").alias("total"))
    cards = groups.join(languages, "category", "left").join(best, "category").crossJoin(F.broadcast(total))  # nine rows by one
    return cards.select("category", "n", F.floor(100 * F.col("n") / F.col("total") + 0.5).alias("percent"), "subgroups", "languages", "best")


@query("qry10", f"SELECT place, category, n FROM {_COUNTS} WHERE n > 0")
def qry10_filled_categories(t):
    return category_counts(_classified(t)).where("n > 0")


@query("qry11", "SELECT language, count(*) AS n FROM repos WHERE language <> '' GROUP BY language ORDER BY n DESC, min(id) LIMIT 10")
def qry11_languages(t):
    counts = t("repos").where("language <> ''").groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("seen"))
    return counts.orderBy(F.desc("n"), "seen").limit(10).select("language", "n")


@query("qry12", _topic_sql(12))
def qry12_topics(t):
    return topic_facet(t("repos").withColumn("ordinal", F.col("id")), 12)


@query("qry13", f"SELECT id, stars, category FROM {C} ORDER BY stars DESC, id LIMIT 15")
def qry13_top_starred(t):
    return _classified(t).orderBy(F.desc("stars"), "id").limit(15).select("id", "stars", "category")


def push_activity(rows: DataFrame, months: int = 18) -> DataFrame:
    """Repositories by month of the last push, the last months that have any."""
    counts = rows.where("pushed_at is not null").groupBy(F.substring("pushed_at", 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("month")).limit(months).select("month", F.substring("month", 6, 2).alias("label"), "n")


@query("qry14", "SELECT substr(pushed_at, 1, 7) AS month, substr(pushed_at, 6, 2) AS label, count(*) AS n FROM repos WHERE pushed_at IS NOT NULL GROUP BY 1, 2 ORDER BY 1 DESC LIMIT 18")
def qry14_push_activity(t):
    return push_activity(t("repos"))


@query("qry15", """SELECT count(*) AS repositories, sum(stars)::BIGINT AS stars, sum(forks)::BIGINT AS forks, count(DISTINCT nullif(language, '')) AS languages, count(*) FILTER (WHERE len(topics) > 0) AS with_topics,
    CAST(floor(100.0 * count(*) FILTER (WHERE len(topics) > 0) / greatest(1, count(*)) + 0.5) AS BIGINT) AS percent FROM repos""")
def qry15_kpis(t):
    tagged, n = F.count_if(F.size("topics") > 0), F.count(F.lit(1))
    languages = F.count_distinct(F.when(F.col("language") != "", F.col("language")))
    return t("repos").agg(n.alias("repositories"), F.sum("stars").alias("stars"), F.sum("forks").alias("forks"), languages.alias("languages"), tagged.alias("with_topics"), F.floor(100 * tagged / F.greatest(F.lit(1), n) + 0.5).alias("percent"))


@query("qry16", "SELECT (SELECT id FROM repos ORDER BY stars DESC, id LIMIT 1) AS starred, (SELECT id FROM repos ORDER BY coalesce(pushed_at, '') DESC, id LIMIT 1) AS pushed")
def qry16_leaders(t):
    first = lambda value: F.max_by("id", F.struct(value, -F.col("id")))
    return t("repos").agg(first(F.col("stars")).alias("starred"), first(F.coalesce("pushed_at", F.lit(""))).alias("pushed"))


@query("qry17", f"""WITH c AS MATERIALIZED (SELECT * FROM {C}), s AS (SELECT category FROM c WHERE id = 3)
    SELECT id, c.category = 'Mobile' AS by_category, coalesce(language = 'Go', false) AS by_language, list_contains(topics, 'cli') AS by_topic, c.category = s.category AS same, NOT (c.category = s.category OR list_contains(topics, 'cli')) AS dimmed FROM c, s""")
def qry17_match_flags(t):
    rows = _classified(t)
    focus = rows.where("id = 3").select(F.col("category").alias("chosen"))
    flagged = rows.crossJoin(F.broadcast(focus))  # one row
    topic, same = F.array_contains("topics", "cli"), F.col("category") == F.col("chosen")
    return flagged.select("id", (F.col("category") == "Mobile").alias("by_category"), F.coalesce(F.col("language") == "Go", F.lit(False)).alias("by_language"), topic.alias("by_topic"), same.alias("same"), (~(same | topic)).alias("dimmed"))


def _unit_sql(text: str) -> str:
    """32-bit FNV-1a of an ASCII text in DuckDB."""
    return f"list_reduce(list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT) / 4294967295.0::DOUBLE"


@query("qry18", f"SELECT id, {_unit_sql("concat(id, ':a')")} AS a, {_unit_sql("concat(id, ':b')")} AS b, {_unit_sql("concat(id, ':c')")} AS c FROM repos")
def qry18_unit_hash(t):
    salted = lambda salt: unit_hash(F.concat(F.col("id").cast("string"), F.lit(":"), F.lit(salt)))
    return t("repos").select("id", salted("a").alias("a"), salted("b").alias("b"), salted("c").alias("c"))


def map_places(rows: DataFrame, total: Column) -> DataFrame:
    """x, y, z of each row(id, category, position) in a funnel ordered by position."""
    seed = {s: unit_hash(F.concat(F.col("id").cast("string"), F.lit(f":{s}"))) for s in "abc"}
    # ---- fixed values: the funnel's shape
    seeded = rows.withColumns({f"_{s}": h for s, h in seed.items()}).withColumn("t", (F.col("position") - 1) / F.greatest(F.lit(1), total - 1))
    a, b, c, at = F.col("_a"), F.col("_b"), F.col("_c"), F.col("t")
    crown = 0.5 + F.pow(1 - at, F.lit(1.4)) * 5.2
    waist = -0.55 * F.sin(at * pi * 1.8) * (0.7 + c * 0.3)
    flare = 0.4 * F.pow(at, F.lit(3.5))
    radius = F.greatest(F.lit(0.3), (crown + waist + flare) * (0.72 + b * 0.38))
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")) - 1
    angle = at * 12 + place * (pi * 2 / len(CATEGORIES)) + a * 1.6
    return seeded.select("id", (F.cos(angle) * radius).alias("x"), (6.2 - at * 12.4 + (a - 0.5) * 1.4).alias("y"), (F.sin(angle) * radius * 0.7).alias("z"))


_PLACES = f"""WITH r AS (SELECT id, category, row_number() OVER (ORDER BY stars DESC, coalesce(pushed_at, '') DESC, id) AS position, count(*) OVER () AS total FROM {C}),
    h AS (SELECT *, (position - 1) / greatest(1, total - 1) AS t, {_unit_sql("concat(id, ':a')")} AS a, {_unit_sql("concat(id, ':b')")} AS b, {_unit_sql("concat(id, ':c')")} AS c FROM r),
    m AS (SELECT *, greatest(0.3, (0.5 + pow(1 - t, 1.4) * 5.2 - 0.55 * sin(t * pi() * 1.8) * (0.7 + c * 0.3) + 0.4 * pow(t, 3.5)) * (0.72 + b * 0.38)) AS radius, t * 12 + (list_position({CATEGORIES!r}, category) - 1) * (pi() * 2 / {len(CATEGORIES)}) + a * 1.6 AS angle FROM h)
    SELECT id, round(cos(angle) * radius, 6) AS x, round(6.2 - t * 12.4 + (a - 0.5) * 1.4, 6) AS y, round(sin(angle) * radius * 0.7, 6) AS z FROM m"""


@query("qry19", _PLACES)
def qry19_map_places(t):
    ranked = number_rows(_classified(t).select("id", "category", "stars", "pushed_at", "ordinal"), catalogue_order())
    total = ranked.agg(F.count(F.lit(1)).alias("total"))
    places = map_places(ranked.crossJoin(F.broadcast(total)), F.col("total"))  # one row
    return places.select("id", *(F.round(c, 6).alias(c) for c in "xyz"))


def _distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


_DISTANCE = "round(list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE) for x in list_zip(a.embedding, b.embedding)]), 9)"


@query("qry20", f"SELECT id, other AS nearest, d FROM (SELECT a.vec_id AS id, b.vec_id AS other, {_DISTANCE} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DISTANCE}, b.vec_id) AS k FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id) q WHERE k = 1")
def qry20_nearest(t):
    return nearest_in_group(t("vectors").select(F.col("vec_id").alias("id"), F.col("label").alias("group"), F.col("embedding").alias("v")))


@query("qry21", f"SELECT b.vec_id AS id, {_DISTANCE} AS d FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id = 7 ORDER BY d, id LIMIT 12")
def qry21_neighbours(t):
    rows = t("vectors")
    focus = rows.where("vec_id = 7").select("label", F.col("embedding").alias("w"))
    near = rows.where("vec_id <> 7").join(F.broadcast(focus), "label")  # one row
    return near.select(F.col("vec_id").alias("id"), F.round(_distance("embedding", "w"), 9).alias("d")).orderBy("d", "id").limit(12)
