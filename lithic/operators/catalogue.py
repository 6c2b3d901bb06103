"""Catalogue ingest: classification, ranking, merging of sources, warnings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithic.operators.ordering import number_rows
from lithic.registry import query

# ---- fixed values: taxonomy in order of precedence, with each category's subgroup rules in order
CATEGORIES = ["AI & Agents", "Enterprise Java", "Cloud & DevOps", "Web Development", "Data & Tools", "Security", "Developer Tools", "Mobile", "Other"]
TAXONOMY = [
    (
        "AI & Agents",
        "agent rag llm langchain langgraph ollama openai gemini machine-learning artificial-intelligence chatbot gpt ai ml neural transformer",
        [("RAG & Retrieval", "rag retrieval embedding vector"), ("Agent Systems", "agent langgraph agentic")],
        "Applied AI",
    ),
    (
        "Enterprise Java",
        "spring java microservice hibernate quarkus maven gradle junit jakarta",
        [("Microservices", "microservice eureka gateway kafka"), ("Spring Boot", "spring boot")],
        "Java Foundations",
    ),
    (
        "Security",
        "security auth oauth jwt ssl tls encryption vulnerability penetration firewall sast dast siem xss csrf",
        [("Auth & Identity", "auth oauth jwt sso iam"), ("Offensive Security", "penetration vulnerability exploit")],
        "Security Tooling",
    ),
    (
        "Cloud & DevOps",
        "docker kubernetes terraform ansible aws azure gcp devops ci-cd jenkins cloud helm k8s gitops pipeline nginx",
        [("Containers", "docker kubernetes k8s container helm"), ("Infrastructure", "terraform ansible infrastructure iac")],
        "Cloud Platforms",
    ),
    (
        "Mobile",
        "android ios flutter react-native swift kotlin mobile expo",
        [("Android", "android kotlin"), ("iOS", "ios swift")],
        "Cross-Platform",
    ),
    (
        "Developer Tools",
        "cli tool plugin extension linter formatter generator boilerplate template starter scaffold utility helper sdk library package",
        [("CLI Tools", "cli terminal shell bash"), ("Plugins & Extensions", "plugin extension addon")],
        "Developer Utilities",
    ),
    (
        "Web Development",
        "react angular vue next javascript typescript html css frontend web tailwind svelte nuxt astro remix",
        [("React Ecosystem", "react next remix"), ("Angular", "angular"), ("Vue Ecosystem", "vue nuxt")],
        "Web Foundations",
    ),
    (
        "Data & Tools",
        "python sql database postgres mysql mongo data analytics etl pipeline airflow spark kafka redis elasticsearch rust go",
        [("Databases", "sql database postgres mysql mongo redis elasticsearch"), ("Data Workflows", "python data analytics etl spark")],
        "Developer Utilities",
    ),
]
#: an earlier, coarser word list over name, description and topics; the second rule also takes Java by language
SIMPLE = [
    ("AI & Agents", "ai agent gpt llama langchain llm nlp openai anthropic agentic brain knowledge-forge"),
    ("Enterprise Java", "java spring hibernate maven gradle jakarta jee microservices jpa springboot jms ejb ossrh"),
    ("Cloud & DevOps", "docker kubernetes k8s aws azure gcp terraform ansible jenkins ci-cd devops cloud nginx traefik prometheus grafana compose vnc"),
    (
        "Web Development",
        "react vue angular nextjs html css javascript typescript web frontend backend express node tailwind sass bootstrap ui app ionic cordova auth admin tracker hub portfolio cv me website portal liquid",
    ),
    ("Data & Tools", "data sql nosql database tool cli utility script automation csv json redis mongodb postgresql mysql elasticsearch algorithms structure docs api collection postman"),
]
PURPOSE = [
    ("Mobile Applications", "app mobile android ios"),
    ("Backend/Services", "api server backend service"),
    ("Frontend/Web", "ui frontend web react css"),
    ("Bots/Integrations", "bot slack discord"),
    ("Tools/Config", "config dotfiles setup scripts"),
]
MESSAGES = {
    "VALIDATION_EMPTY": "Add at least one user, org, or repository URL.",
    "VALIDATION_INVALID_URL": '"{input}" is not a user, org, or repository URL.',
    "TOO_MANY_SOURCES": "You can load at most 5 sources.",
    "SOURCE_NOT_FOUND": 'The forge could not find "{login}". Check the URL.',
    "SOURCE_FORBIDDEN": 'The forge refused "{login}". If this is a private org, it cannot be loaded.',
    "RATE_LIMITED": "Rate limit reached. Try again later or set a token.",
    "NETWORK": "Could not reach the forge. Check your connection and try again.",
    "PARTIAL_FAILURE": "Loaded {ok} source(s). {fail} failed.",
}
STORED, SHOWN = 2000, 800


def _any(text: Column, words: str) -> Column:
    """Whether any word stands anywhere in the text; the words are letters, digits and hyphens."""
    return F.rlike(text, F.lit("|".join(words.split())))


def _sql_any(text: str, words: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words.split()) + ")"


def _first_match(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    chain = F.when(*rules[0])
    for condition, value in rules[1:]:
        chain = chain.when(condition, value)
    return chain.otherwise(otherwise)


def search_text() -> Column:
    return F.lower(F.concat(F.col("name"), F.lit(" "), F.coalesce("description", F.lit("")), F.lit(" "), F.coalesce("language", F.lit("")), F.lit(" "), F.array_join("topics", " ")))


def classify(repos: DataFrame) -> DataFrame:
    """Category and subgroup: the first category with a keyword in the row's text, then its first subgroup rule."""
    with_text = repos.withColumn("_text", search_text())
    text = F.col("_text")
    category = [(_any(text, words), F.lit(name)) for name, words, _, _ in TAXONOMY]
    subgroup = [(_any(text, words), _first_match([(_any(text, w), F.lit(g)) for g, w in groups], F.lit(rest))) for _, words, groups, rest in TAXONOMY]
    other = F.when(F.col("fork"), "Forks & Experiments").otherwise("General Projects")
    return with_text.withColumns({"category": _first_match(category, F.lit("Other")), "subgroup": _first_match(subgroup, other)}).drop("_text")


def importance() -> Column:
    return F.least(F.lit(1.0), F.log10(F.greatest(F.lit(1), F.col("stars")) + 1) / 5)


def dedupe_by_id(rows: DataFrame) -> DataFrame:
    """The last record of each id, at the place of the first."""
    whole = F.struct(*(c for c in rows.columns if c not in ("id", "ordinal")))
    merged = rows.groupBy("id").agg(F.max_by(whole, "ordinal").alias("r"), F.min("ordinal").alias("ordinal"))
    return merged.select("id", "r.*", "ordinal")


def catalogue_order() -> list[Column]:
    return [F.desc("stars"), F.desc(F.coalesce("pushed_at", F.lit(""))), F.asc("ordinal")]


def top(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows in catalogue order with their position; a task keeps n rows, not the table."""
    first = rows.orderBy(*catalogue_order()).limit(n)
    return first.withColumn("position", F.row_number().over(W.orderBy(*catalogue_order())).cast("long"))


def without_default_owner(rows: DataFrame, requested: bool, owner: str) -> DataFrame:
    return rows if requested else rows.where(~F.startswith(F.lower("full_name"), F.lit(owner.lower() + "/")))


def ingest(rows: DataFrame, owner: str, requested: bool = False, stored: int = STORED) -> DataFrame:
    """Live rows of all sources, classified, merged by id, ranked and capped."""
    live = rows.where(~F.col("archived"))
    merged = without_default_owner(dedupe_by_id(live), requested, owner)
    best = top(merged, stored)
    return classify(best).withColumn("importance", importance())


_TEXT_SQL = "lower(concat(name, ' ', coalesce(description, ''), ' ', coalesce(language, ''), ' ', array_to_string(topics, ' ')))"
CLASSIFY_SQL = (
    f"SELECT *, CASE {' '.join(f'WHEN {_sql_any(chr(95) + chr(116), w)} THEN {chr(39)}{n}{chr(39)}' for n, w, _, _ in TAXONOMY)} ELSE 'Other' END AS category, "
    + "CASE "
    + " ".join(f"WHEN {_sql_any('_t', w)} THEN CASE " + " ".join(f"WHEN {_sql_any('_t', x)} THEN '{g}'" for g, x in groups) + f" ELSE '{rest}' END" for _, w, groups, rest in TAXONOMY)
    + f" WHEN fork THEN 'Forks & Experiments' ELSE 'General Projects' END AS subgroup FROM (SELECT *, {_TEXT_SQL} AS _t FROM {{source}}) q"
)
CLASSIFIED = CLASSIFY_SQL.format(source="repos")


@query("cat1", f"SELECT id, category, subgroup FROM ({CLASSIFIED}) c")
def cat1_classify(t):
    return classify(t("repos")).select("id", "category", "subgroup")


@query("cat2", "SELECT id, round(least(1.0, log10(greatest(1, stars) + 1) / 5), 9) AS importance FROM repos")
def cat2_importance(t):
    return t("repos").select("id", F.round(importance(), 9).alias("importance"))


@query("cat3", "SELECT id, full_name FROM repos WHERE NOT archived")
def cat3_live(t):
    return t("repos").where(~F.col("archived")).select("id", "full_name")


@query(
    "cat4",
    """SELECT id, stars, first_at AS ordinal FROM (SELECT id, stars, min(ordinal) OVER (PARTITION BY id) AS first_at,
       row_number() OVER (PARTITION BY id ORDER BY ordinal DESC) AS k FROM repo_sources) q WHERE k = 1""",
)
def cat4_last_record(t):
    return dedupe_by_id(t("repo_sources")).select("id", "stars", "ordinal")


@query("cat5", "SELECT id, full_name FROM repos WHERE NOT starts_with(lower(full_name), 'owner7/')")
def cat5_without_default_owner(t):
    return without_default_owner(t("repos"), False, "Owner7").select("id", "full_name")


@query("cat6", "SELECT id, row_number() OVER (ORDER BY stars DESC, coalesce(pushed_at, '') DESC, id) AS position FROM repos")
def cat6_rank(t):
    rows = t("repos").select("id", "stars", "pushed_at", F.col("id").alias("ordinal"))
    return number_rows(rows, catalogue_order()).select("id", "position")


@query(
    "cat7",
    """WITH r AS (SELECT id, stars, row_number() OVER (ORDER BY stars DESC, coalesce(pushed_at, '') DESC, id) AS position FROM repos)
       SELECT id, stars, position, position <= 800 AS shown, (SELECT count(*) FROM repos) > 2000 AS cut_stored, (SELECT count(*) FROM repos) > 800 AS cut_shown FROM r WHERE position <= 2000""",
)
def cat7_cap(t):
    rows = t("repos").withColumn("ordinal", F.col("id"))
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    best = top(rows, STORED).crossJoin(F.broadcast(total))  # one row
    return best.select("id", "stars", "position", (F.col("position") <= SHOWN).alias("shown"), (F.col("n") > STORED).alias("cut_stored"), (F.col("n") > SHOWN).alias("cut_shown"))


@query(
    "cat8",
    """WITH o AS (SELECT login, code, failed, row_number() OVER (PARTITION BY login ORDER BY ordinal) AS k FROM source_outcomes), f AS (SELECT login, failed, code FROM o WHERE k = 1),
       n AS (SELECT count(*) FILTER (WHERE failed) AS bad, count(*) FILTER (WHERE NOT failed) AS good FROM f)
       SELECT code, login AS detail FROM f WHERE failed
       UNION ALL SELECT 'PARTIAL_FAILURE', concat(good, '/', bad) FROM n WHERE bad > 0 AND good > 0""",
)
def cat8_warnings(t):
    first = t("source_outcomes").groupBy("login").agg(F.min_by(F.struct("failed", "code"), "ordinal").alias("o")).select("login", "o.*")
    each = first.where("failed").select("code", F.col("login").alias("detail"))
    counts = first.agg(F.count_if("failed").alias("bad"), F.count_if(~F.col("failed")).alias("good"))
    partial = counts.where("bad > 0 and good > 0").select(F.lit("PARTIAL_FAILURE").alias("code"), F.concat_ws("/", "good", "bad").alias("detail"))
    return each.unionByName(partial)


INGEST_SQL = (
    """WITH live AS (SELECT * FROM repo_sources WHERE NOT archived),
  merged AS (SELECT * FROM (SELECT *, min(ordinal) OVER (PARTITION BY id) AS first_at, row_number() OVER (PARTITION BY id ORDER BY ordinal DESC) AS k FROM live) q WHERE k = 1 AND NOT starts_with(lower(full_name), 'owner7/')),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY stars DESC, coalesce(pushed_at, '') DESC, first_at) AS position FROM merged) q WHERE position <= 2000)
  SELECT id, full_name, stars, category, subgroup, round(least(1.0, log10(greatest(1, stars) + 1) / 5), 9) AS importance, position FROM ("""
    + CLASSIFY_SQL.format(source="best")
    + ") c"
)


@query("cat9", INGEST_SQL)
def cat9_ingest(t):
    done = ingest(t("repo_sources"), "owner7")
    return done.select("id", "full_name", "stars", "category", "subgroup", F.round("importance", 9).alias("importance"), "position")


@query(
    "cat10",
    """WITH r AS (SELECT source_login AS login, count(*) AS n FROM repos GROUP BY 1), f AS (SELECT DISTINCT login FROM source_outcomes WHERE failed)
       SELECT coalesce(r.login, f.login) AS login, coalesce(n, 0) AS repositories, CASE WHEN f.login IS NULL THEN 'connected' WHEN n > 0 THEN 'degraded' ELSE 'error' END AS status
       FROM r FULL OUTER JOIN f ON r.login = f.login""",
)
def cat10_connected_sources(t):
    return connected_sources(t("repos"), t("source_outcomes").where("failed"))


def connected_sources(repos: DataFrame, failures: DataFrame) -> DataFrame:
    """Repositories and status of each login that has rows or failed."""
    counts = repos.where("source_login is not null").groupBy(F.col("source_login").alias("login")).agg(F.count(F.lit(1)).alias("n"))
    failed = failures.select("login").distinct().withColumn("f", F.lit(True))
    n = F.coalesce("n", F.lit(0))
    return counts.join(failed, "login", "full_outer").select("login", n.alias("repositories"), F.when(F.col("f").isNull(), "connected").when(n > 0, "degraded").otherwise("error").alias("status"))


@query(
    "cat11",
    """SELECT login, kind, url FROM (SELECT coalesce(nullif(CASE WHEN id % 4 = 0 THEN NULL ELSE source_login END, ''), split_part(full_name, '/', 1), 'unknown') AS login, 'user' AS kind,
       concat('https://forge.example/', split_part(full_name, '/', 1)) AS url, id, row_number() OVER (PARTITION BY coalesce(CASE WHEN id % 4 = 0 THEN NULL ELSE source_login END, split_part(full_name, '/', 1)) ORDER BY id) AS k FROM repos) q WHERE k = 1""",
)
def cat11_sync_sources(t):
    rows = t("repos").withColumn("source_login", F.when(F.col("id") % 4 != 0, F.col("source_login")))
    owner = F.substring_index("full_name", "/", 1)
    keyed = rows.select(F.coalesce("source_login", owner, F.lit("unknown")).alias("login"), F.lit("user").alias("kind"), F.concat(F.lit("https://forge.example/"), owner).alias("url"), "id")
    return keyed.groupBy("login").agg(F.min_by(F.struct("kind", "url"), "id").alias("s")).select("login", "s.*")


@query(
    "cat12",
    """WITH req AS (SELECT p_partkey AS request, CASE WHEN p_partkey % 5 = 0 THEN concat('Owner', p_partkey % 40, '/missing') ELSE upper(concat('owner', p_partkey % 40, '/', replace(p_name, ' ', '-'), '-', p_partkey)) END AS wanted, concat('owner', p_partkey % 40) AS login FROM part WHERE p_partkey % 3 = 0),
       f AS (SELECT login, bool_and(code IN ('SOURCE_NOT_FOUND', 'SOURCE_FORBIDDEN')) AS gone FROM source_outcomes WHERE failed GROUP BY login),
       n AS (SELECT source_login AS login, count(*) AS n FROM repos GROUP BY 1)
       SELECT request, CASE WHEN r.id IS NOT NULL THEN 'ready' WHEN f.login IS NOT NULL AND gone THEN 'not_found' WHEN f.login IS NOT NULL THEN 'provider_error' WHEN n.n = 1 THEN 'identity_mismatch' ELSE 'not_found' END AS status
       FROM req LEFT JOIN repos r ON lower(r.full_name) = lower(wanted) LEFT JOIN f ON f.login = req.login LEFT JOIN n ON n.login = req.login""",
)
def cat12_resolve_lookup(t):
    part, outcomes, repos = t("part"), t("source_outcomes"), t("repos")
    owner = F.concat(F.lit("owner"), F.col("p_partkey") % 40)
    name = F.upper(F.concat(owner, F.lit("/"), F.regexp_replace("p_name", " ", "-"), F.lit("-"), F.col("p_partkey")))
    wanted = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("Owner"), F.col("p_partkey") % 40, F.lit("/missing"))).otherwise(name)
    requests = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("request"), wanted.alias("wanted"), owner.alias("login"))
    return resolve_lookup(requests, repos, outcomes.where("failed"))


def resolve_lookup(requests: DataFrame, repos: DataFrame, failures: DataFrame) -> DataFrame:
    """What became of each request(request, wanted, login)."""
    found = repos.select(F.lower("full_name").alias("_name"), F.lit(True).alias("found"))
    gone = failures.groupBy("login").agg(F.bool_and(F.col("code").isin("SOURCE_NOT_FOUND", "SOURCE_FORBIDDEN")).alias("gone"))
    counts = repos.groupBy(F.col("source_login").alias("login")).agg(F.count(F.lit(1)).alias("n"))
    joined = requests.join(found, F.lower("wanted") == F.col("_name"), "left").join(gone, "login", "left").join(counts, "login", "left")
    status = F.when(F.col("found"), "ready").when(F.col("gone"), "not_found").when(F.col("gone").isNotNull(), "provider_error").when(F.col("n") == 1, "identity_mismatch").otherwise("not_found")
    return joined.select("request", status.alias("status"))


def message(code: Column, parameters: dict[str, Column]) -> Column:
    """The text of a code with its parameters put in."""
    table = F.create_map(*(F.lit(x) for pair in MESSAGES.items() for x in pair))
    text = F.element_at(table, code)
    for name, value in parameters.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


@query(
    "cat13",
    "SELECT ordinal, replace(CASE code "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MESSAGES.items())
    + " END, '{login}', login) AS message FROM source_outcomes WHERE failed",
)
def cat13_messages(t):
    return t("source_outcomes").where("failed").select("ordinal", message(F.col("code"), {"login": F.col("login")}).alias("message"))


def summary() -> Column:
    """One sentence about a classified repository."""
    language = F.when(F.col("language").isNotNull(), F.concat(F.lit("a "), F.col("language"))).otherwise("an open-source")
    topics = F.array_join(F.slice("topics", 1, 3), ", ")
    return F.concat(
        F.col("name"), F.lit(" is "), language, F.lit(" repository in the "), F.col("subgroup"), F.lit(" space, falling under the broader "), F.col("category"), F.lit(" category."),
        F.when(F.col("description") != "", F.concat(F.lit(" "), F.col("description"), F.lit("."))).otherwise(""),
        F.when(topics != "", F.concat(F.lit(" Key topics include "), topics, F.lit("."))).otherwise(""),
        F.when(F.col("stars") > 0, F.concat(F.lit(" It has earned "), F.format_number("stars", 0), F.lit(" stars."))).otherwise(""),
        F.lit(" Explore the code to discover its full capabilities."),
    )


@query(
    "cat14",
    f"""SELECT id, concat(name, ' is ', coalesce('a ' || language, 'an open-source'), ' repository in the ', subgroup, ' space, falling under the broader ', category, ' category.',
        CASE WHEN description <> '' THEN concat(' ', description, '.') ELSE '' END, CASE WHEN len(topics) > 0 THEN concat(' Key topics include ', array_to_string(topics[1:3], ', '), '.') ELSE '' END,
        CASE WHEN stars > 0 THEN concat(' It has earned ', format('{{:,}}', stars), ' stars.') ELSE '' END, ' Explore the code to discover its full capabilities.') AS summary FROM ({CLASSIFIED}) c""",
)
def cat14_summary(t):
    return classify(t("repos")).select("id", summary().alias("summary"))


_SHORT_SQL = "lower(concat(name, ' ', coalesce(description, ''), ' ', array_to_string(topics, ' ')))"


def classify_simple(repos: DataFrame) -> DataFrame:
    """The coarse category and the purpose of each repository."""
    text = F.lower(F.concat("name", F.lit(" "), F.coalesce("description", F.lit("")), F.lit(" "), F.array_join("topics", " ")))
    java = F.lower(F.coalesce("language", F.lit(""))) == "java"
    rules = [(_any(text, words) | java if name == "Enterprise Java" else _any(text, words), F.lit(name)) for name, words in SIMPLE]
    name, about = F.lower("name"), F.lower(F.coalesce("description", F.lit("")))
    purpose = [(_any(name, words) | _any(about, words), F.lit(kind)) for kind, words in PURPOSE]
    return repos.withColumns({"simple": _first_match(rules, F.lit("Other")), "purpose": _first_match(purpose, F.lit("Uncategorized"))})


SIMPLE_SQL = (
    "SELECT *, CASE "
    + " ".join(f"WHEN {_sql_any('_t', w)}" + (" OR lower(coalesce(language, '')) = 'java'" if n == "Enterprise Java" else "") + f" THEN '{n}'" for n, w in SIMPLE)
    + " ELSE 'Other' END AS simple, CASE "
    + " ".join(f"WHEN {_sql_any('_n', w)} OR {_sql_any('_d', w)} THEN '{n}'" for n, w in PURPOSE)
    + f" ELSE 'Uncategorized' END AS purpose FROM (SELECT *, {_SHORT_SQL} AS _t, lower(name) AS _n, lower(coalesce(description, '')) AS _d FROM repos) q"
)


@query("cat15", f"SELECT id, simple, purpose FROM ({SIMPLE_SQL}) c")
def cat15_classify_simple(t):
    return classify_simple(t("repos")).select("id", "simple", "purpose")


@query(
    "cat16",
    f"""WITH c AS (SELECT id, simple, stars, pushed_at, row_number() OVER (PARTITION BY simple ORDER BY stars DESC, coalesce(pushed_at, '') DESC, id) AS k FROM ({SIMPLE_SQL}) c),
        two AS (SELECT id, simple FROM c WHERE k <= 2), rest AS (SELECT id, simple FROM c WHERE k > 2 ORDER BY stars DESC, coalesce(pushed_at, '') DESC, id LIMIT 12)
        SELECT id, simple FROM two UNION ALL SELECT id, simple FROM (SELECT id, simple, row_number() OVER (ORDER BY stars DESC, coalesce(pushed_at, '') DESC, id) AS k FROM c WHERE k > 2) r WHERE r.k <= 12 - (SELECT count(*) FROM two)""",
)
def cat16_representatives(t):
    return representatives(classify_simple(t("repos")), per_category=2, total=12)


def representatives(rows: DataFrame, per_category: int, total: int) -> DataFrame:
    """The best of each category, filled up with the best of the rest."""
    order = [F.desc("stars"), F.desc(F.coalesce("pushed_at", F.lit(""))), "id"]
    ranked = rows.select("id", "simple", "stars", "pushed_at", F.row_number().over(W.partitionBy("simple").orderBy(*order)).alias("k"))
    first = ranked.where(F.col("k") <= per_category).select("id", "simple", F.lit(0).alias("part"), F.lit(0).alias("place"))
    rest = ranked.where(F.col("k") > per_category).orderBy(*order).limit(total)
    rest = rest.select("id", "simple", F.lit(1).alias("part"), F.row_number().over(W.orderBy(*order)).alias("place"))
    chosen = first.unionByName(rest)
    return chosen.withColumn("n", F.row_number().over(W.orderBy("part", "place", "id"))).where(f"part = 0 or n <= {total}").select("id", "simple")


@query(
    "cat17",
    """SELECT 'total' AS kind, '' AS name, count(*) AS n FROM repos UNION ALL SELECT 'archived', '', count(*) FROM repos WHERE archived UNION ALL SELECT 'forks', '', count(*) FROM repos WHERE fork
       UNION ALL SELECT 'language', language, count(*) FROM repos WHERE language IS NOT NULL GROUP BY language UNION ALL SELECT 'topic', topic, count(*) FROM (SELECT unnest(topics) AS topic FROM repos) q GROUP BY topic""",
)
def cat17_corpus_counts(t):
    repos = t("repos")
    flags = F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("on")) for k, c in (("total", F.lit(True)), ("archived", F.col("archived")), ("forks", F.col("fork")))))
    parts = [
        repos.select(F.explode(flags).alias("f")).groupBy(F.col("f.kind").alias("kind")).agg(F.count_if("f.on").alias("n")).select("kind", F.lit("").alias("name"), "n"),
        repos.where("language is not null").groupBy(F.col("language").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("language").alias("kind"), "name", "n"),
        repos.select(F.explode("topics").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(F.lit("topic").alias("kind"), "name", "n"),
    ]
    return reduce(DataFrame.unionByName, parts)
