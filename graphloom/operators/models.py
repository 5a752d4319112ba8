"""LinUCB bandit, context manifold, budget split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.model import Graph, twin

D = 8

# Base weights of the nine context dimensions, and words that raise one of them.
BASE_WEIGHTS = {"structural": 0.20, "semantic": 0.25, "temporal": 0.10, "requirements": 0.05, "summary": 0.15, "navigational": 0.05, "session": 0.10, "intent": 0.05, "impact": 0.05}
DIMENSION_WORDS = {
    "structural": ["call", "depend", "import", "inherit", "graph", "relationship"], "semantic": ["similar", "search", "find", "like", "related"], "temporal": ["recent", "history", "change", "commit", "hot", "active"],
    "requirements": ["requirement", "prd", "spec", "feature", "user story"], "summary": ["overview", "summary", "explain", "what does", "purpose"], "navigational": ["navigate", "explore", "traverse", "drill", "zoom"],
    "session": ["working", "modified", "staged", "current", "branch"], "intent": ["why", "intent", "purpose", "goal", "motivation"], "impact": ["impact", "break", "affect", "refactor", "risk", "caller"],
}
#: Words that double a dimension, and the minutes after which its state is stale.
DOUBLING_WORDS = {"requirements": ["requirement", "prd", "spec"], "impact": ["refactor", "change", "break"]}
STALE_MINUTES = 10


def bandit_update(rewards: DataFrame, arm: str, features: list[str], reward: str) -> DataFrame:
    """Per arm: A (upper triangle, the identity added), b, pulls, total reward: plain sums, so updates commute."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    a = [(F.sum(F.col(features[i]) * F.col(features[j])) + (1.0 if i == j else 0.0)).alias(f"a{i}{j}") for i, j in pairs]
    b = [F.sum(F.col(reward) * F.col(x)).alias(f"b{i}") for i, x in enumerate(features)]
    return rewards.groupBy(arm).agg(*a, *b, F.count("*").alias("pulls"), F.sum(reward).alias("total_reward"))


def bandit_score(arms: DataFrame, arm: str, x: list[float], alpha: float = 1.0) -> DataFrame:
    """Upper confidence bound of each arm for a context: with A = L L' (Cholesky), the mean is (L^-1 x).(L^-1 b), the
    width the length of L^-1 x.  All of it are column expressions; each step names its columns, so none is written out
    twice."""
    d = len(x)
    df = arms.select(F.col(arm).cast("string").alias("arm"), *[F.col(f"a{i}{j}").cast("double") for i in range(d) for j in range(i, d)], *[F.col(f"b{i}").cast("double") for i in range(d)])
    c = F.col
    for i in range(d):  # row i of L, then of L^-1 x and L^-1 b
        diagonal = c(f"a{i}{i}")
        for k in range(i):
            diagonal = diagonal - c(f"l{i}{k}") * c(f"l{i}{k}")
        df = df.withColumn(f"l{i}{i}", F.sqrt(diagonal))
        below = {}
        for j in range(i + 1, d):
            value = c(f"a{i}{j}")
            for k in range(i):
                value = value - c(f"l{i}{k}") * c(f"l{j}{k}")
            below[f"l{j}{i}"] = value / c(f"l{i}{i}")
        u, w = F.lit(float(x[i])), c(f"b{i}")
        for k in range(i):
            u, w = u - c(f"l{i}{k}") * c(f"u{k}"), w - c(f"l{i}{k}") * c(f"w{k}")
        df = df.withColumns(below | {f"u{i}": u / c(f"l{i}{i}"), f"w{i}": w / c(f"l{i}{i}")})
    mean = sum((c(f"u{i}") * c(f"w{i}") for i in range(1, d)), c("u0") * c("w0"))
    width = sum((c(f"u{i}") * c(f"u{i}") for i in range(1, d)), c("u0") * c("u0"))
    return df.select("arm", F.round(mean + alpha * F.sqrt(width), 9).alias("score"))


def new_arm_score(x: Column, alpha: float = 1.0) -> Column:
    """An arm never pulled: alpha times the context's norm."""
    return alpha * F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))


def rank_dimensions(queries: DataFrame, budget: int, state: DataFrame) -> DataFrame:
    """Score and budget of each dimension per query.

    queries: query, current_file and session (whether a file is open, and whether the query's session navigates);
    state: dimension, available, age_minutes.  Words of a dimension add 0.05 each, 0.15 at most; an open file
    raises session and impact by half, the session doubles navigational; a stale state costs 0.3, and words about
    requirements or refactoring double theirs.  The budget is split by score; a dimension without a state has none."""
    rows = [(k, w, DIMENSION_WORDS[k], DOUBLING_WORDS.get(k, [])) for k, w in BASE_WEIGHTS.items()]
    table = queries.sparkSession.createDataFrame(rows, "dimension string, base double, words array<string>, doubling array<string>")
    has = lambda w: F.contains(F.lower("query"), w)
    score = F.col("base") + F.least(0.05 * F.size(F.filter("words", has)), F.lit(0.15))
    score = score * F.when(F.col("current_file") & F.col("dimension").isin("session", "impact"), 1.5).otherwise(1.0) * F.when(F.col("session") & (F.col("dimension") == "navigational"), 2.0).otherwise(1.0)
    score = score * F.when(F.col("age_minutes") > STALE_MINUTES, 0.7).otherwise(1.0) * F.when(F.exists("doubling", has), 2.0).otherwise(1.0)
    scored = queries.crossJoin(F.broadcast(table)).join(F.broadcast(state), "dimension").withColumn("score", F.round(F.when(F.col("available"), score).otherwise(0.0), 9))
    total = F.sum("score").over(Window.partitionBy("query"))
    return scored.select("query", "dimension", F.round("score", 6).alias("score"), F.when(total > 0, F.floor(budget * F.col("score") / total)).otherwise(0).alias("budget"))


def manifold_health(state: DataFrame) -> DataFrame:
    """Active, stale and missing dimensions, and the whole: healthy from five active ones on, degraded from two on."""
    kind = F.when(~F.col("available") | F.col("age_minutes").isNull(), "missing").when(F.col("age_minutes") > STALE_MINUTES, "stale").otherwise("active")
    counted = state.withColumn("kind", kind).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("active", "stale", "missing")])
    return counted.withColumn("health", F.when(F.col("active") >= 5, "healthy").when(F.col("active") >= 2, "degraded").otherwise("unavailable"))


def assemble(ranked: DataFrame, texts: DataFrame, least: int = 50) -> DataFrame:
    """Sections of dimensions that score, have text, and whose budget is worth it, cut to four characters a token."""
    kept = ranked.filter((F.col("score") > 0) & (F.col("budget") >= least)).join(texts, "dimension").filter(F.trim("text") != "")
    body = F.substring("text", F.lit(1), (F.col("budget") * 4).cast("int"))
    xml = F.concat(F.lit('    <dimension name="'), "dimension", F.lit('">\n      <![CDATA['), body, F.lit("]]>\n    </dimension>"))
    return kept.select("query", "dimension", xml.alias("section"), F.ceil(F.length(xml) / 4).alias("tokens"))


def dimensions_state(spark) -> DataFrame:
    rows = [(k, k != "summary", 3 * i) for i, k in enumerate(BASE_WEIGHTS)]
    return spark.createDataFrame(rows, "dimension string, available boolean, age_minutes int")


_QUERIES_TEXT = [("what depends on this call", True, False), ("recent changes and impact", True, True), ("requirement spec for a feature", False, False), ("overview", False, True), ("Explore why this could break a caller", True, True)]


def _queries(spark) -> DataFrame:
    return spark.createDataFrame(_QUERIES_TEXT, "query string, current_file boolean, session boolean")


def _rewards(g: Graph) -> DataFrame:
    e = g.table("events")
    k = F.get_json_object("props", "$.k").cast("double")
    f = {"f0": F.lit(1.0), "f1": F.hour("ts") / 24, "f2": k / 100, "f3": F.dayofmonth("ts") / 31, "f4": (F.col("event_id") % 7) / 7, "f5": (F.col("user_id") % 5) / 5, "f6": F.minute("ts") / 60, "f7": (F.col("event_id") % 3) / 3}
    return e.select("event_type", *[v.cast("double").alias(n) for n, v in f.items()], (F.floor("value") / 100).alias("reward"))


_FEATURES = [f"f{i}" for i in range(D)]


def _update(g: Graph) -> DataFrame:
    out = bandit_update(_rewards(g), "event_type", _FEATURES, "reward")
    return out.select("event_type", "pulls", *[F.round(c, 4).alias(c) for c in out.columns if c not in ("event_type", "pulls")])


def _score(g: Graph) -> DataFrame:
    return bandit_score(bandit_update(_rewards(g), "event_type", _FEATURES, "reward"), "event_type", [1.0, 0.5, 0.2, 0.1, 0.3, 0.4, 0.9, 0.6]).orderBy(F.desc("score"), "arm")


def _assembled(g: Graph) -> DataFrame:
    state = dimensions_state(g.spark)
    texts = state.select("dimension", F.rpad("dimension", 300, "x").alias("text"))
    return assemble(rank_dimensions(_queries(g.spark), 1000, state), texts)


def _q(f):
    return lambda spark, sf_dir: f(Graph(spark, sf_dir))


QUERIES = {
    "bandit_update": _q(_update),
    "bandit_rank": _q(lambda g: _score(g).select("arm", F.round("score", 6).alias("score"))),
    "bandit_stats": _q(lambda g: _rewards(g).groupBy("event_type").agg(F.count("*").alias("pulls"), F.round(F.sum("reward"), 4).alias("total"), F.round(F.avg("reward"), 6).alias("mean"))),
    "bandit_new_arm": _q(lambda g: g.vectors.select("id", F.round(new_arm_score(F.slice("embedding", 1, 8)), 6).alias("score"))),
    "rank_dimensions": _q(lambda g: rank_dimensions(_queries(g.spark), 1000, dimensions_state(g.spark))),
    "manifold_health": _q(lambda g: manifold_health(dimensions_state(g.spark))),
    "assemble_manifold": _q(_assembled),
    "transition_stats": _q(lambda g: g.table("events").agg(F.count("*").alias("steps"), F.count_distinct("event_type").alias("phases"), F.count_distinct("user_id").alias("sequences"))),
}

_RW = ", rw AS (SELECT event_type, 1.0::DOUBLE AS f0, hour(ts) / 24 AS f1, json_extract_string(props, '$.k')::DOUBLE / 100 AS f2, day(ts) / 31 AS f3, (event_id % 7) / 7 AS f4, (user_id % 5) / 5 AS f5, minute(ts) / 60 AS f6, (event_id % 3) / 3 AS f7, floor(value) / 100 AS reward FROM events)"
# The twin's values are written out here by hand and not taken from the tables above.
_ST = """, st AS (SELECT * FROM (VALUES ('structural', 0.2::DOUBLE, ['call', 'depend', 'import', 'inherit', 'graph', 'relationship'], true, 0), ('semantic', 0.25, ['similar', 'search', 'find', 'like', 'related'], true, 3),
  ('temporal', 0.1, ['recent', 'history', 'change', 'commit', 'hot', 'active'], true, 6), ('requirements', 0.05, ['requirement', 'prd', 'spec', 'feature', 'user story'], true, 9),
  ('summary', 0.15, ['overview', 'summary', 'explain', 'what does', 'purpose'], false, 12), ('navigational', 0.05, ['navigate', 'explore', 'traverse', 'drill', 'zoom'], true, 15),
  ('session', 0.1, ['working', 'modified', 'staged', 'current', 'branch'], true, 18), ('intent', 0.05, ['why', 'intent', 'purpose', 'goal', 'motivation'], true, 21),
  ('impact', 0.05, ['impact', 'break', 'affect', 'refactor', 'risk', 'caller'], true, 24)) v(dimension, base, words, available, age)),
qs AS (SELECT * FROM (VALUES ('what depends on this call', true, false), ('recent changes and impact', true, true), ('requirement spec for a feature', false, false), ('overview', false, true), ('Explore why this could break a caller', true, true)) v(query, open, session))"""
_RK = _ST + """, hs AS (SELECT *, len(list_filter(words, lambda w: contains(lower(query), w))) AS hits FROM qs, st),
  sc AS (SELECT query, dimension, round(CASE WHEN available THEN (base + least(0.05::DOUBLE * hits, 0.15::DOUBLE)) * CASE WHEN session AND dimension = 'navigational' THEN 2 WHEN open AND dimension IN ('session', 'impact') THEN 1.5::DOUBLE ELSE 1 END
    * CASE WHEN age > 10 THEN 0.7::DOUBLE ELSE 1 END * CASE WHEN (dimension = 'requirements' AND regexp_matches(lower(query), 'requirement|prd|spec')) OR (dimension = 'impact' AND regexp_matches(lower(query), 'refactor|change|break')) THEN 2 ELSE 1 END ELSE 0 END, 9) AS score FROM hs),
  rk AS (SELECT query, dimension, round(score, 6) AS score, floor(1000 * score / sum(score) OVER (PARTITION BY query))::BIGINT AS budget FROM sc)"""
_AB = ", ".join([f"round(sum(f{i} * f{j}){' + 1' if i == j else ''}, 4) AS a{i}{j}" for i in range(D) for j in range(i, D)] + [f"round(sum(reward * f{i}), 4) AS b{i}" for i in range(D)])
ORACLES = {k: twin(v) for k, v in {
    "bandit_update": _RW + f" SELECT event_type, count(*) AS pulls, {_AB}, round(sum(reward), 4) AS total_reward FROM rw GROUP BY event_type",
    "bandit_stats": _RW + " SELECT event_type, count(*) AS pulls, round(sum(reward), 4) AS total, round(avg(reward), 6) AS mean FROM rw GROUP BY event_type",
    "bandit_new_arm": "SELECT id, round(sqrt(list_sum(list_transform(embedding[1:8], lambda x: x * x))), 6) AS score FROM vectors",
    "rank_dimensions": _RK + " SELECT * FROM rk",
    "manifold_health": "SELECT 4::BIGINT AS active, 4::BIGINT AS stale, 1::BIGINT AS missing, 'degraded' AS health",
    "assemble_manifold": _RK + ", se AS (SELECT query, dimension, '    <dimension name=\"' || dimension || '\">' || chr(10) || '      <![CDATA[' || rpad(dimension, 300, 'x')[1:budget * 4] || ']]>' || chr(10) || '    </dimension>' AS section FROM rk WHERE budget >= 50) SELECT *, ceil(length(section) / 4)::BIGINT AS tokens FROM se",
    "transition_stats": "SELECT count(*) AS steps, count(DISTINCT event_type) AS phases, count(DISTINCT user_id) AS sequences FROM events",
}.items()}
