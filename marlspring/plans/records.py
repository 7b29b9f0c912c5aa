"""Normalization, validation and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlspring.functions.scalars import q6, tokens
from marlspring.operators import normalize as E
from marlspring.operators import review as L
from marlspring.operators import validation as V
from marlspring.operators.text import chunks
from marlspring.plans.text import CHUNKS
from marlspring.registry import register
from marlspring.session import table

P = "floor(({}) * 1000000 + 0.5)::BIGINT"
PLAIN = r"CASE WHEN lower(regexp_replace(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'), '^ | $', '', 'g')) IN ('', 'unknown', 'n/a', 'na', 'none', 'null', 'not specified', '{{}}', '[]') THEN '' ELSE regexp_replace(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'), '^ | $', '', 'g') END"
LINE = "split_part(text, chr(10), 1)"


@register("plain_values", f"SELECT p_partkey, {PLAIN.format('v')} AS v FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN ' N/A ' WHEN 1 THEN 'None' ELSE '  ' || p_name || '  ' END AS v FROM part)")
def plain_values(spark, sf):
    v = F.when(F.col("p_size") % 4 == 0, " N/A ").when(F.col("p_size") % 4 == 1, "None").otherwise(F.concat(F.lit("  "), "p_name", F.lit("  ")))
    return table(spark, sf, "part").select("p_partkey", E.plain(v).alias("v"))


@register("phrase_split", f"SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array({LINE}, '[;,，；、]'), lambda x: {PLAIN.format('x')}), lambda x: x <> ''), '|') AS phrases FROM documents")
def phrase_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(E.phrases(F.split("text", "\n")[0]), "|").alias("phrases"))


@register(
    "distinct_phrases",
    rf"""WITH a AS (SELECT doc_id, regexp_extract_all({LINE}, '[A-Za-z]+') AS w FROM documents)
    SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i)[1:12], '|') AS phrases FROM a""",
)
def distinct_phrases(spark, sf):
    w = F.regexp_extract_all(F.split("text", "\n")[0], F.lit("[A-Za-z]+"), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", F.array_join(E.distinct_ignoring_case(w, 12), "|").alias("phrases"))


RULES = [("ring", "fastener ring"), ("bolt|widget", "hardware"), ("^small", "compact")]


@register(
    "canonical_names",
    """WITH p AS (SELECT p_partkey, p_name AS n, list_filter([CASE WHEN contains(p_name, 'ring') THEN 'fastener ring' END, CASE WHEN regexp_matches(p_name, 'bolt|widget') THEN 'hardware' END, CASE WHEN starts_with(p_name, 'small') THEN 'compact' END], lambda x: x IS NOT NULL) AS l FROM part)
    SELECT p_partkey, array_to_string(CASE WHEN len(l) > 0 THEN l ELSE [n] END, ';') AS names FROM p""",
)
def canonical_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(E.canonical(F.col("p_name"), RULES, 6), ";").alias("names"))


KNOWN = {"ring": "Ring", "bolt": "Bolt", "gear": "Gear"}


@register(
    "normalized_names",
    r"""WITH p AS (SELECT p_partkey, p_name || ' ' || p_brand AS t FROM part), c AS (SELECT p_partkey, t, regexp_extract_all(t, 'Brand#\d+') || list_transform(regexp_extract_all(lower(t), '\b(ring|bolt|gear)\b', 1), lambda w: upper(w[1]) || w[2:]) AS l FROM p)
    SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:3], '; ') AS name FROM c""",
)
def normalized_names(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", E.names(F.concat_ws(" ", "p_name", "p_brand"), r"Brand#\d+", KNOWN).alias("name"))


@register(
    "aligned_tokens",
    r"""WITH a AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents),
    k AS (SELECT doc_id, t, list_filter(t, lambda x: regexp_matches(x, '^th') OR NOT regexp_matches(x, 'on$|er$')) AS k FROM a)
    SELECT doc_id, len(k)::BIGINT AS kept, (len(t) - len(k))::BIGINT AS removed, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), ',') AS classes FROM
    (SELECT *, list_filter(list_transform(k, lambda x: CASE WHEN starts_with(x, 'th') THEN 'th' WHEN regexp_matches(x, 'ing') THEN 'ing' WHEN length(x) > 8 THEN 'long' END), lambda x: x IS NOT NULL) AS c FROM k)""",
)
def aligned_tokens(spark, sf):
    t = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    d = table(spark, sf, "documents").select("doc_id", t.alias("t"))
    kept, removed = E.keep_matching(F.col("t"), "^th", "on$|er$")
    return d.select("doc_id", F.size(kept).cast("long").alias("kept"), F.size(removed).cast("long").alias("removed"), F.array_join(E.projected(kept, [("^th", "th"), ("ing", "ing"), (".{9,}", "long")]), ",").alias("classes"))


@register(
    "chunk_vote",
    f"""WITH {CHUNKS}, t AS (SELECT doc_id, chunk_index, regexp_extract_all(lower(content), '[a-z]+') AS t FROM chunks),
    u AS (SELECT doc_id, flatten(list(t ORDER BY chunk_index)) AS l FROM t GROUP BY 1)
    SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:8], ',') AS tokens FROM u""",
)
def chunk_vote(spark, sf):
    c = chunks(table(spark, sf, "documents")).withColumn("t", F.regexp_extract_all(F.lower("content"), F.lit("[a-z]+"), F.lit(0)))
    return E.vote(c, "doc_id", "chunk_index", "t", 8).select("doc_id", F.array_join("tokens", ",").alias("tokens"))


@register(
    "existing_keys",
    """WITH u AS (SELECT p_name, p_type, p_partkey, 'approved' AS source FROM part WHERE p_size > 25 UNION ALL SELECT p_name, p_type, p_partkey, 'pending' FROM part WHERE p_size <= 25)
    SELECT lower(p_name) || '|' || lower(p_type) AS entity, source, p_partkey AS id FROM u QUALIFY row_number() OVER (PARTITION BY entity ORDER BY source, p_partkey) = 1""",
)
def existing_keys(spark, sf):
    p = table(spark, sf, "part").select("p_name", "p_type", "p_partkey", "p_size")
    return E.existing_keys(p.where("p_size > 25").drop("p_size"), p.where("p_size <= 25").drop("p_size"), "p_name", "p_type", "p_partkey")


@register(
    "merged_records",
    f"""WITH o AS (SELECT p_type AS k, list(DISTINCT p_name) AS l, CASE WHEN p_type < 'M' THEN 'none' ELSE min(p_brand) END AS t, avg(p_size) AS c FROM part WHERE p_size > 25 GROUP BY 1), n AS (SELECT p_type AS k, list(DISTINCT p_name) AS l, max(p_brand) AS t, avg(p_size) AS c FROM part WHERE p_size <= 25 GROUP BY 1)
    SELECT k, md5(array_to_string(list_sort(list_distinct(o.l || n.l)), ',')) AS names, CASE WHEN o.t = 'none' THEN n.t ELSE o.t END AS t, {P.format("(o.c + n.c) / 2")} AS c FROM o JOIN n USING (k)""",
)
def merged_records(spark, sf):
    p = table(spark, sf, "part").withColumnRenamed("p_type", "k")
    o = p.where("p_size > 25").groupBy("k").agg(F.collect_set("p_name").alias("l"), F.when(F.col("k") < "M", "none").otherwise(F.min("p_brand")).alias("t"), F.avg("p_size").alias("c"))
    n = p.where("p_size <= 25").groupBy("k").agg(F.collect_set("p_name").alias("l"), F.max("p_brand").alias("t"), F.avg("p_size").alias("c"))
    m = E.merge_records(o, n, "k", ["l"], ["t"], "c")
    return m.select("k", F.md5(F.array_join("l", ",")).alias("names"), "t", q6(F.col("c")).alias("c"))


@register("best_match")
def best_match(spark, sf):
    s = table(spark, sf, "customer").select("c_custkey", "c_name")
    return E.best_match(s, s, F.substring("c_name", 1, 17), "c_name", "c_custkey", 0.9).withColumn("ratio", q6(F.col("ratio")))


WEIGHTS = {"ring": 12, "small": 9, "red": 6, "bolt": 3}


@register(
    "candidate_scores",
    """WITH s AS (SELECT p_partkey, p_name, CASE WHEN contains(p_name, 'ring') THEN 12 ELSE 0 END + CASE WHEN contains(p_name, 'small') THEN 9 ELSE 0 END + CASE WHEN contains(p_name, 'red') THEN 6 ELSE 0 END + CASE WHEN contains(p_name, 'bolt') THEN 3 ELSE 0 END - CASE WHEN contains(p_name, 'large') THEN 10 ELSE 0 END AS score,
      array_to_string(list_filter([CASE WHEN contains(p_name, 'ring') THEN 'ring' END, CASE WHEN contains(p_name, 'small') THEN 'small' END, CASE WHEN contains(p_name, 'red') THEN 'red' END, CASE WHEN contains(p_name, 'bolt') THEN 'bolt' END, CASE WHEN contains(p_name, 'large') THEN 'soft' END], lambda x: x IS NOT NULL), ',') AS reasons, contains(p_name, 'blue') AS excluded FROM part)
    SELECT p_partkey, score::BIGINT AS score, reasons, excluded, CASE WHEN excluded THEN 'out' WHEN score >= 24 THEN 'high' WHEN score >= 16 THEN 'medium' ELSE 'low' END AS bucket FROM s""",
)
def candidate_scores(spark, sf):
    return E.candidate_score(table(spark, sf, "part"), "p_name", WEIGHTS, "blue", "large").select("p_partkey", "score", "reasons", "excluded", "bucket")


@register("diverse_picks")
def diverse_picks(spark, sf):
    p = table(spark, sf, "part").select("p_type", "p_partkey", (F.col("p_size") % 5).alias("base"), F.split("p_name", " ").alias("tags"))
    return E.pick_diverse(p, "p_type", "p_partkey", 5)


@register(
    "reference_parts",
    r"""WITH r AS (SELECT p_partkey, 'Smith J. (' || (1990 + p_size) || ') ' || p_name || ' https://x.org/' || p_partkey || ' 10.1234/ab.' || p_partkey AS t FROM part)
    SELECT p_partkey, regexp_extract(t, '(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)', 1) AS doi, regexp_extract(t, '(https?://\S+)', 1) AS url, nullif(regexp_extract(t, '\b((?:19|20)\d\d)\b', 1), '') AS year, regexp_extract(t, '^\s*([A-Z][a-z]+(?: [A-Z]\.)?)', 1) AS author FROM r""",
)
def reference_parts(spark, sf):
    t = F.concat(F.lit("Smith J. ("), F.col("p_size") + 1990, F.lit(") "), "p_name", F.lit(" https://x.org/"), "p_partkey", F.lit(" 10.1234/ab."), "p_partkey")
    return table(spark, sf, "part").select("p_partkey", E.references(t).alias("r")).select("p_partkey", "r.*")


@register(
    "record_scores",
    f"""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'unknown' ELSE p_name END AS p_name, p_brand, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS p_type FROM part)
    SELECT p_partkey, {P.format("(CASE WHEN p_name = 'unknown' THEN 0.0 ELSE 1.0 END + 1.0 + CASE WHEN p_type = '' THEN 0.0 WHEN regexp_matches(lower(p_type), 'promo|small') THEN 1.0 ELSE 0.5 END) / 3")} AS score, array_to_string(list_filter([CASE WHEN p_name = 'unknown' THEN 'p_name' END, CASE WHEN p_type = '' THEN 'p_type' END], lambda x: x IS NOT NULL), ',') AS missing FROM p""",
)
def record_scores(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, "unknown").otherwise(F.col("p_name")).alias("p_name"), "p_brand", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")).alias("p_type"))
    return V.field_scores(p, "p_partkey", ["p_name", "p_brand", "p_type"], {"p_type": ["promo", "small"]}).withColumn("score", q6(F.col("score")))


@register(
    "weighted_checks",
    f"""WITH c AS (SELECT o_orderkey, (o_totalprice > 1000)::INT AS a, (o_orderstatus IN ('O', 'F'))::INT AS b, regexp_matches(o_orderpriority, '^[12]')::INT AS d FROM orders)
    SELECT o_orderkey, (a + b + d)::BIGINT AS passed, 3::BIGINT AS total, {P.format("(a + b + d) / 3.0::DOUBLE")} AS pass_rate, {P.format("(a * 0.5 + b * 0.3 + d * 0.2)::DOUBLE / 1.0")} AS weighted, {P.format("0.7 * ((a + b + d) / 3.0::DOUBLE) + 0.3 * (a * 0.5 + b * 0.3 + d * 0.2)::DOUBLE")} AS confidence,
      CASE WHEN floor((a * 0.5 + b * 0.3 + d * 0.2) * 1000000 + 0.5) >= 800000 THEN 3 WHEN floor((a * 0.5 + b * 0.3 + d * 0.2) * 1000000 + 0.5) >= 600000 THEN 2 ELSE 1 END AS priority FROM c""",
)
def weighted_checks(spark, sf):
    w = V.weighted_checks(table(spark, sf, "orders"), "o_orderkey", {"price": (F.col("o_totalprice") > 1000, 0.5), "status": (F.col("o_orderstatus").isin("O", "F"), 0.3), "priority": (F.col("o_orderpriority").rlike("^[12]"), 0.2)})
    conf = V.final_confidence(F.col("pass_rate"), F.col("weighted"))
    return w.select("o_orderkey", "passed", "total", q6(F.col("pass_rate")).alias("pass_rate"), q6(F.col("weighted")).alias("weighted"), q6(conf).alias("confidence"), V.priority(q6(F.col("weighted")) / 1e6).alias("priority"))


@register("class_match", f"SELECT p_partkey, {P.format('''CASE WHEN lower(p_type) IN ('promo', 'small') THEN 0.9 WHEN regexp_matches(lower(p_type), 'promo|small') THEN 0.6 ELSE 0.3 END''')} AS score FROM part")
def class_match(spark, sf):
    return table(spark, sf, "part").select("p_partkey", q6(V.class_match(F.col("p_type"), ["promo", "small"])).alias("score"))


@register("answer_check", "SELECT event_id, CASE WHEN length(a) < 10 THEN 'too_short' WHEN NOT json_valid(a) THEN 'not_json' WHEN json_extract(a, '$.k') IS NOT NULL THEN 'ok' ELSE 'no_required_key' END AS result FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN 'no json here at all' WHEN 2 THEN '{\"other\": \"value\"}' ELSE '{\"k\": 123456}' END AS a FROM events)")
def answer_check(spark, sf):
    a = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, "no json here at all").when(F.col("event_id") % 4 == 2, '{"other": "value"}').otherwise('{"k": 123456}')
    return table(spark, sf, "events").select("event_id", V.answer_check(a, ["k", "name"]).alias("result"))


@register(
    "error_taxonomy",
    f"""WITH a AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS p, CASE WHEN doc_id % 5 = 0 THEN []::VARCHAR[] WHEN doc_id % 3 = 0 THEN list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) ELSE list_distinct(regexp_extract_all(lower(regexp_replace(text, '[a-z]+[.]', 'end.', 'g')), '[a-z0-9]+')) END AS g FROM documents),
    c AS (SELECT doc_id, CASE WHEN len(p) = 0 AND len(g) = 0 THEN 'both_empty' WHEN len(list_filter(p, lambda x: NOT list_contains(g, x))) = 0 AND len(list_filter(g, lambda x: NOT list_contains(p, x))) = 0 THEN 'match' WHEN len(p) = 0 THEN 'missed' WHEN len(g) = 0 THEN 'invented' ELSE 'mismatch' END AS category FROM a)
    SELECT k.category, count(doc_id) AS n, {P.format("count(doc_id) / (SELECT count(*) FROM c)::DOUBLE")} AS share, min(doc_id) AS first FROM (SELECT unnest(['both_empty', 'invented', 'match', 'mismatch', 'missed']) AS category) k LEFT JOIN c USING (category) GROUP BY 1""",
)
def error_taxonomy(spark, sf):
    whole, other = F.array_distinct(tokens(F.col("text"))), F.array_distinct(tokens(F.regexp_replace("text", "[a-z]+[.]", "end.")))
    g = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 3 == 0, whole).otherwise(other)
    c = table(spark, sf, "documents").select("doc_id", V.token_errors(whole, g).alias("category"))
    return V.error_table(c, "category", "doc_id", ["both_empty", "invented", "match", "mismatch", "missed"]).withColumn("share", q6(F.col("share")))


ACTIONS = "CASE event_type WHEN 'signup' THEN 'submit' WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'restore' ELSE 'delete' END"
AFTER = "CASE action WHEN 'submit' THEN 'pending' WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'restore' THEN 'pending' ELSE 'deleted' END"


def _log(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", F.expr(ACTIONS).alias("action"), "value")


@register("review_state", f"WITH l AS (SELECT *, {ACTIONS} AS action FROM events) SELECT user_id, arg_max({AFTER}, event_id) AS state, count(*) AS n_actions FROM l GROUP BY 1")
def review_state(spark, sf):
    return L.current_state(_log(spark, sf), "user_id", ["event_id"])


@register(
    "illegal_transitions",
    f"""WITH l AS (SELECT event_id, user_id, {ACTIONS} AS action FROM events), b AS (SELECT *, coalesce(lag({AFTER}) OVER (PARTITION BY user_id ORDER BY event_id), 'none') AS before FROM l)
    SELECT event_id, action, before FROM b WHERE NOT ((action = 'submit' AND before IN ('none', 'rejected')) OR (action = 'approve' AND before = 'pending') OR (action = 'reject' AND before IN ('pending', 'approved')) OR (action = 'restore' AND before IN ('rejected', 'deleted')) OR (action = 'delete' AND before IN ('pending', 'approved', 'rejected')))""",
)
def illegal_transitions(spark, sf):
    return L.illegal_transitions(_log(spark, sf), "user_id", ["event_id"]).select("event_id", "action", "before")


@register(
    "review_shares",
    f"""WITH l AS (SELECT *, {ACTIONS} AS action FROM events), s AS (SELECT user_id, arg_max({AFTER}, event_id) AS state, avg(value) AS c FROM l GROUP BY 1), t AS (SELECT count(*) AS total, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'approved') AS approved, count(*) FILTER (state = 'rejected') AS rejected, count(*) FILTER (state = 'deleted') AS deleted FROM s)
    SELECT *, (SELECT {P.format("avg(c)")} FROM (SELECT c FROM s WHERE state = 'pending' ORDER BY user_id LIMIT 20)) AS avg_confidence, floor(pending / total::DOUBLE * 10000 + 0.5)::BIGINT AS pending_share, floor(approved / total::DOUBLE * 10000 + 0.5)::BIGINT AS approved_share, floor(rejected / total::DOUBLE * 10000 + 0.5)::BIGINT AS rejected_share FROM t""",
)
def review_shares(spark, sf):
    log = _log(spark, sf)
    s = L.current_state(log, "user_id", ["event_id"]).join(log.groupBy("user_id").agg(F.avg("value").alias("c")), "user_id")
    return L.state_shares(s, "c", 20, [F.col("user_id")]).withColumn("avg_confidence", q6(F.col("avg_confidence")))


@register("restorable", f"WITH l AS (SELECT *, {ACTIONS} AS action FROM events), s AS (SELECT user_id, arg_max({AFTER}, event_id) AS state FROM l GROUP BY 1) SELECT user_id FROM s WHERE state IN ('rejected', 'deleted')")
def restorable(spark, sf):
    return L.restorable(L.current_state(_log(spark, sf), "user_id", ["event_id"])).select("user_id")


@register(
    "task_progress",
    f"""WITH g AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'view') AS done, count(*) FILTER (event_type NOT IN ('view', 'error')) AS good, max(ts) AS last FROM events GROUP BY 1)
    SELECT user_id, total, {P.format("done / total::DOUBLE")} AS progress, {P.format("coalesce(good / nullif(done, 0)::DOUBLE, 0)")} AS success_rate, epoch_us(TIMESTAMP '2024-01-30 23:00:00') - epoch_us(last) > 300000000 AS stale FROM g""",
)
def task_progress(spark, sf):
    t = L.task_progress(table(spark, sf, "events"), "user_id", F.col("event_type") != "view", F.col("event_type") != "error", "ts", F.to_timestamp(F.lit("2024-01-30 23:00:00")))
    return t.withColumn("progress", q6(F.col("progress"))).withColumn("success_rate", q6(F.col("success_rate")))


@register("failure_budget", "SELECT event_id, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS failures, failures < 3 AS allowed FROM events")
def failure_budget(spark, sf):
    return L.failure_budget(table(spark, sf, "events"), "user_id", ["event_id"], F.col("event_type") == "error").select("event_id", "failures", "allowed")


@register(
    "attempt_gate",
    """WITH a AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS c FROM conversations)
    SELECT conv_id, turn, EXISTS (SELECT 1 FROM a b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND len(list_filter(a.c, lambda x: NOT list_contains(b.c, x))) = 0) AS skipped FROM a""",
)
def attempt_gate(spark, sf):
    a = table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("c"))
    return L.attempt_gate(a, "conv_id", "turn", "c").select("conv_id", "turn", "skipped")


@register("work_batches", "SELECT doc_id // 20 AS batch, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def work_batches(spark, sf):
    left = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")
    return L.batches(left, "doc_id", 20).groupBy("batch").agg(F.count("*").alias("n"))


@register("stale_candidates", f"WITH {CHUNKS} SELECT doc_id, 'unprocessed' AS reason FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'no_chunks' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM chunks WHERE length(content) > 400)")
def stale_candidates(spark, sf):
    d = table(spark, sf, "documents")
    return L.stale_candidates(d, table(spark, sf, "labels"), chunks(d).where(F.length("content") > 400), "doc_id")
