"""Analytics, behaviour, recommendation and conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlspring.functions.scalars import q6
from marlspring.operators import analytics as N
from marlspring.registry import register
from marlspring.session import table

P = "floor(({}) * 1000000 + 0.5)::BIGINT"


@register(
    "correlation_pairs",
    f"""WITH d AS (SELECT n_chars AS chars, len(regexp_extract_all(text, '[a-z]+')) AS words, doc_id AS id FROM documents),
    c AS (SELECT count(*) AS n, corr(chars, words) AS a, corr(chars, id) AS b, corr(words, id) AS c FROM d),
    p AS (SELECT n, 'chars' AS a, 'words' AS b, a AS r FROM c UNION ALL SELECT n, 'chars', 'id', b FROM c UNION ALL SELECT n, 'words', 'id', c FROM c)
    SELECT a, b, {P.format("r")} AS r, CASE WHEN abs(r) > 0.8 THEN 'strong' WHEN abs(r) > 0.5 THEN 'moderate' ELSE 'weak' END AS strength, {P.format("CASE WHEN abs(r) * sqrt((n - 2) / (1 - r * r)) > 2 THEN 0.05 ELSE 0.1 END")} AS significance FROM p WHERE abs(r) >= 0.3""",
)
def correlation_pairs(spark, sf):
    d = table(spark, sf, "documents").select(F.col("n_chars").alias("chars"), F.regexp_count("text", F.lit("[a-z]+")).alias("words"), F.col("doc_id").alias("id"))
    c = N.correlations(d, ["chars", "words", "id"], 0.3)
    return c.select("a", "b", q6(F.col("r")).alias("r"), "strength", q6(F.col("significance")).alias("significance"))


def _daily(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.floor(F.sum("value") * 100 + 0.5).cast("long").alias("cents"))


DAILY = "d AS (SELECT event_type, ts::DATE AS day, count(*) AS n, floor(sum(value) * 100 + 0.5)::BIGINT AS cents FROM events GROUP BY 1, 2)"
TREND = f"{DAILY}, x AS (SELECT event_type, n::DOUBLE AS y, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS x FROM d), t AS (SELECT event_type, count(*) AS n, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2, max_by(y, x) AS last FROM x GROUP BY 1)"


@register("daily_statistics", f"WITH {DAILY} SELECT * FROM d")
def daily_statistics(spark, sf):
    return _daily(spark, sf)


@register("trends", f"WITH {TREND} SELECT event_type, n, {P.format('slope')} AS slope, {P.format('r2')} AS r2, {P.format('last')} AS last, CASE WHEN slope > 0.1 THEN 'increasing' WHEN slope < -0.1 THEN 'decreasing' ELSE 'stable' END AS direction FROM t")
def trends(spark, sf):
    t = N.trend(_daily(spark, sf), "event_type", ["day"], "n")
    return t.select("event_type", "n", *[q6(F.col(c)).alias(c) for c in ("slope", "r2", "last")], "direction")


@register("forecast", f"WITH {TREND} SELECT event_type, s AS step, {P.format('last + slope * s')} AS value FROM t, (SELECT unnest(generate_series(1, 7)) AS s) WHERE n >= 10")
def forecast(spark, sf):
    return N.forecast(N.trend(_daily(spark, sf), "event_type", ["day"], "n"), "event_type").withColumn("value", q6(F.col("value")))


@register("anomalies", f"WITH w AS (SELECT *, avg(value) OVER p AS m, stddev_pop(value) OVER p AS s, count(*) OVER p AS n FROM events WINDOW p AS (PARTITION BY event_type)) SELECT event_id, event_type, {P.format('abs(value - m) / s')} AS z FROM w WHERE n >= 3 AND s > 0 AND abs(value - m) / s > 3")
def anomalies(spark, sf):
    return N.anomalies(table(spark, sf, "events"), "event_type", "value", 3.0).select("event_id", "event_type", q6(F.col("z")).alias("z"))


@register("fused_values", "SELECT user_id, floor(sum(value) * 100 + 0.5)::BIGINT AS s, floor(max(value) * 100 + 0.5)::BIGINT AS hi, floor(min(value) * 100 + 0.5)::BIGINT AS lo, count(*) AS n, arg_max(event_type, event_id) AS last FROM events GROUP BY 1")
def fused_values(spark, sf):
    c = lambda x: F.floor(x * 100 + 0.5).cast("long")
    return table(spark, sf, "events").groupBy("user_id").agg(c(F.sum("value")).alias("s"), c(F.max("value")).alias("hi"), c(F.min("value")).alias("lo"), F.count("*").alias("n"), F.max_by("event_type", "event_id").alias("last"))


@register(
    "feature_share",
    f"""WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS t, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM g)
    SELECT user_id, event_type, n, {P.format("n / t::DOUBLE")} AS share, {P.format("CASE WHEN t < 10 THEN 0.3 WHEN t < 50 THEN 0.6 WHEN t < 100 THEN 0.8 ELSE 0.9 END")} AS confidence FROM w WHERE k <= 5 AND n / t::DOUBLE > 0.1""",
)
def feature_share(spark, sf):
    f = N.feature_share(table(spark, sf, "events"), "user_id", "event_type")
    return f.select("user_id", "event_type", "n", q6(F.col("share")).alias("share"), q6(F.col("confidence")).alias("confidence"))


@register("active_hours", "WITH g AS (SELECT user_id, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, hour, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, hour) AS k FROM g QUALIFY k <= 3")
def active_hours(spark, sf):
    return N.active_hours(table(spark, sf, "events"), "user_id", "ts")


@register(
    "workflow_sequences",
    """WITH e AS (SELECT *, (event_type = 'purchase')::INT AS done FROM events), s AS (SELECT *, coalesce(sum(done) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM e),
    g AS (SELECT user_id, s, max(done) AS closed, string_agg(event_type, '->' ORDER BY ts, event_id) FILTER (done = 0) AS q FROM s GROUP BY 1, 2)
    SELECT q AS sequence, count(*) AS n FROM g WHERE closed = 1 AND q IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
)
def workflow_sequences(spark, sf):
    return N.sequences(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type", F.col("event_type") == "purchase")


@register(
    "preference_weights",
    f"""WITH g AS (SELECT user_id, hour(ts) % 6 AS feature, sum(CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 2.0 WHEN 'purchase' THEN 5.0 ELSE 0.0 END) AS w FROM events GROUP BY 1, 2)
    SELECT user_id, feature, {P.format("coalesce(w / nullif(sum(w) OVER (PARTITION BY user_id), 0)::DOUBLE, 0)")} AS weight FROM g""",
)
def preference_weights(spark, sf):
    e = table(spark, sf, "events").select("user_id", (F.hour("ts") % 6).cast("long").alias("feature"), F.col("event_type").alias("kind"))
    return N.preference_weights(e, "user_id", "feature", {"view": 1.0, "click": 2.0, "purchase": 5.0}).withColumn("weight", q6(F.col("weight")))


#: The users asked for are those whose key is divisible by 100, against all users.
RATED = "r AS (SELECT o_custkey AS u, l_partkey AS item, count(*) AS r FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"
SIMILAR = f"""{RATED}, nm AS (SELECT u, sqrt(sum(r * r)) AS n FROM r GROUP BY 1), dt AS (SELECT a.u, b.u AS o, sum(a.r * b.r) AS d FROM r a JOIN r b ON a.item = b.item AND a.u <> b.u AND a.u % 100 = 0 GROUP BY 1, 2),
sm AS (SELECT dt.u, o, {P.format("d / (x.n * y.n)")} AS s FROM dt JOIN nm x ON x.u = dt.u JOIN nm y ON y.u = o QUALIFY row_number() OVER (PARTITION BY dt.u ORDER BY s DESC, o) <= 10)"""


def _rated(spark, sf):
    o = table(spark, sf, "orders")
    return o.join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).agg(F.count("*").alias("r"))


def _asked(rated):
    return rated.where("user % 100 = 0")


@register("similar_users", f'WITH {SIMILAR} SELECT u AS "user", o AS other, s AS similarity FROM sm')
def similar_users(spark, sf):
    r = _rated(spark, sf)
    return N.similar_users(r, _asked(r))


CF = f"{SIMILAR}, cf AS (SELECT sm.u, r.item, sum(s * r.r)::BIGINT AS score FROM sm JOIN r ON r.u = sm.o WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.u = sm.u AND x.item = r.item) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY sm.u ORDER BY score DESC, r.item) <= 10)"


@register("recommend_items", f'WITH {CF} SELECT u AS "user", item, score FROM cf')
def recommend_items(spark, sf):
    r = _rated(spark, sf)
    return N.recommend(r, N.similar_users(r, _asked(r)))


@register(
    "recommend_merged",
    f"""WITH {CF}, pop AS (SELECT item, sum(r)::BIGINT AS score FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20), us AS (SELECT DISTINCT u FROM r WHERE u % 100 = 0),
    pu AS (SELECT u, item, score FROM us, pop WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.u = us.u AND x.item = pop.item)), m AS (SELECT *, 0 AS source FROM cf UNION ALL SELECT *, 1 FROM pu),
    f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY u, item ORDER BY source) = 1)
    SELECT u AS "user", item, score, source FROM f QUALIFY row_number() OVER (PARTITION BY u ORDER BY score DESC, source, item) <= 10""",
)
def recommend_merged(spark, sf):
    r = _rated(spark, sf)
    top = r.groupBy("item").agg(F.sum("r").alias("score")).orderBy(F.desc("score"), "item").limit(20)
    popular = _asked(r).select("user").distinct().crossJoin(F.broadcast(top)).join(r.select("user", "item"), ["user", "item"], "left_anti")  # top is 20 rows
    return N.merge_recommendations([N.recommend(r, N.similar_users(r, _asked(r))), popular])


@register("popularity", f"SELECT p_partkey, {P.format('(0.1 * p_size + 0.5 * (p_retailprice / 1000)) * exp(-0.1 * (p_partkey % 30))')} AS popularity FROM part")
def popularity(spark, sf):
    p = N.popularity(table(spark, sf, "part"), F.col("p_size"), F.col("p_retailprice") / 1000, F.col("p_partkey") % 30)
    return p.select("p_partkey", q6(F.col("popularity")).alias("popularity"))


@register("high_frequency_users", "SELECT user_id, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1 HAVING count(*) > 3")
def high_frequency_users(spark, sf):
    ref = F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    e = table(spark, sf, "events").where((F.col("ts") > ref - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") <= ref))
    return e.groupBy("user_id").agg(F.count("*").alias("n")).where("n > 3")


INTENTS = {"ask": ["the", "who", "que"], "state": ["and", "la", "der"], "point": ["that", "von", "los"]}
TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@register(
    "intent_scores",
    f"""WITH t AS (SELECT conv_id, turn, {TOK} AS t FROM conversations), h AS (SELECT conv_id, turn, len(t) AS n, len(list_filter(t, lambda w: w IN ('the', 'who', 'que'))) AS a, len(list_filter(t, lambda w: w IN ('and', 'la', 'der'))) AS s, len(list_filter(t, lambda w: w IN ('that', 'von', 'los'))) AS p FROM t)
    SELECT conv_id, turn, CASE WHEN greatest(a, s, p) = 0 THEN 'none' WHEN s = greatest(a, s, p) THEN 'state' WHEN p = greatest(a, s, p) THEN 'point' ELSE 'ask' END AS intent, {P.format("coalesce(greatest(a, s, p) * 100 / nullif(n, 0)::DOUBLE, 0)")} AS score FROM h""",
)
def intent_scores(spark, sf):
    return N.intents(table(spark, sf, "conversations"), INTENTS)


@register(
    "entities",
    r"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b\d+(?:\.\d+)?\b'))), ',') AS numbers, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\d+(?:\.\d+)?%'))), ',') AS percents,
    array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b[A-Za-z0-9_-]+\.(?:pdf|csv|json|xlsx)\b'))), ',') AS files, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}\b'))), ',') AS dates
    FROM (SELECT conv_id, turn, regexp_replace(text, '[^ -~]', ' ', 'g') || ' ' || turn || '.5% in run_' || conv_id || '.csv on 2024-01-0' || (turn % 9) AS text FROM conversations)""",
)
def entities(spark, sf):
    t = F.concat(F.regexp_replace("text", "[^ -~]", " "), F.lit(" "), "turn", F.lit(".5% in run_"), "conv_id", F.lit(".csv on 2024-01-0"), (F.col("turn") % 9))
    return N.entities(table(spark, sf, "conversations").select("conv_id", "turn", t.alias("text")))


@register("last_turns", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations QUALIFY back <= 2")
def last_turns(spark, sf):
    return N.last_turns(table(spark, sf, "conversations"), 2).select("conv_id", "turn", "back")


@register("session_summary", "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, sum(length(text))::BIGINT AS chars, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1")
def session_summary(spark, sf):
    c = table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.sum(F.length("text")).alias("chars"), F.max_by("role", "turn").alias("last_role"))


@register("latency_percentiles", f"SELECT event_type, count(*) AS n, count(*) FILTER (value < 50) AS success, count(*) FILTER (value >= 50) AS failed, {P.format('quantile_cont(value, 0.5)')} AS p50, {P.format('quantile_cont(value, 0.95)')} AS p95, {P.format('max(value)')} AS max FROM events GROUP BY 1")
def latency_percentiles(spark, sf):
    s = N.latency_summary(table(spark, sf, "events"), "event_type", "value", F.col("value") < 50)
    return s.select("event_type", "n", "success", "failed", *[q6(F.col(c)).alias(c) for c in ("p50", "p95", "max")])


@register("user_medians", f"WITH m AS (SELECT user_id, event_type, median(value) AS m FROM events GROUP BY 1, 2) SELECT event_type, {P.format('quantile_cont(m, 0.5)')} AS p50, {P.format('quantile_cont(m, 0.95)')} AS p95 FROM m GROUP BY 1")
def user_medians(spark, sf):
    m = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.median("value").alias("m"))
    p = m.groupBy("event_type").agg(F.percentile("m", F.array(F.lit(0.5), F.lit(0.95))).alias("p"))
    return p.select("event_type", q6(F.col("p")[0]).alias("p50"), q6(F.col("p")[1]).alias("p95"))


@register(
    "annotation_rates",
    f"""WITH a AS (SELECT source, CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END AS l FROM documents JOIN labels USING (doc_id)), c AS (SELECT source AS mode, l, count(*) AS n FROM a GROUP BY 1, 2 UNION ALL SELECT 'all', l, count(*) FROM a GROUP BY 2),
    g AS (SELECT mode, label FROM (SELECT DISTINCT mode FROM c), (SELECT unnest(['good', 'bad', 'unclear']) AS label)), f AS (SELECT g.mode, g.label, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.mode = g.mode AND c.l = g.label)
    SELECT mode, label, n, {P.format("coalesce(n / nullif(sum(n) OVER (PARTITION BY mode), 0)::DOUBLE, 0)")} AS share FROM f""",
)
def annotation_rates(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("source", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("l"))
    return N.label_rates(d, "source", "l", ["good", "bad", "unclear"]).withColumn("share", q6(F.col("share")))


@register("support_crosstab", "SELECT source, count(*) FILTER (quality = 0) AS q0, count(*) FILTER (quality = 1) AS q1 FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def support_crosstab(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    p = d.groupBy("source").pivot("quality", [0, 1]).count()
    return p.select("source", F.coalesce("0", F.lit(0)).alias("q0"), F.coalesce("1", F.lit(0)).alias("q1"))
