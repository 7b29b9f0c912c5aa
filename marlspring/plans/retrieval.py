"""Retrieval, confidence and evaluation over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlspring.functions.scalars import q6
from marlspring.operators import confidence as C
from marlspring.operators import evaluation as M
from marlspring.operators import retrieval as R
from marlspring.operators.blocks import dense_blocks
from marlspring.operators.ranking import best_texts, overlap_of
from marlspring.operators.text import chunks
from marlspring.plans.text import CHUNKS
from marlspring.registry import register
from marlspring.session import table

Q6 = "floor(({}) * 1000000 + 0.5)::BIGINT"
SCORES = f"""d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
q AS (SELECT item_id AS qid, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark),
qt AS (SELECT qid, len(t) AS nt, unnest(t) AS term FROM q),
dn AS (SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS nd FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
st AS (SELECT count(*) AS total, avg(n) AS a FROM dn),
bm AS (SELECT qid, doc_id, {Q6.format("sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / a)))")} AS s
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dn USING (doc_id), st GROUP BY 1, 2),
ov AS (SELECT qid, doc_id, {Q6.format("count(*) / (any_value(nt) + any_value(nd) - count(*))::DOUBLE")} AS s FROM qt JOIN tf USING (term) JOIN dn USING (doc_id) GROUP BY 1, 2)"""


def cut(name: str, source: str, k: int) -> str:
    return f"{name} AS (SELECT qid, doc_id, s, s / 1e6 AS score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id) AS rank FROM {source} QUALIFY rank <= {k})"


def fused(alpha: str) -> str:
    return f"""j AS (SELECT qid, doc_id, coalesce(v.score, 0) AS v, coalesce(k.score, 0) AS k FROM vc v FULL JOIN kc k USING (qid, doc_id)),
r AS (SELECT *, max(v) FILTER (v > 0) OVER w AS vh, min(v) FILTER (v > 0) OVER w AS vl, max(k) FILTER (k > 0) OVER w AS kh, min(k) FILTER (k > 0) OVER w AS kl FROM j WINDOW w AS (PARTITION BY qid)),
nn AS (SELECT qid, doc_id, v, k, CASE WHEN v > 0 THEN (v - vl) / CASE WHEN vh > vl THEN vh - vl ELSE 1 END ELSE 0 END AS nv,
  CASE WHEN k > 1 THEN (k - kl) / CASE WHEN kh > kl THEN kh - kl ELSE 1 END WHEN k > 0 THEN k ELSE 0 END AS nk FROM r),
f AS (SELECT qid, doc_id, v, k, {Q6.format(f"CASE WHEN v > 0 AND k > 0 THEN {alpha} * nv + (1 - {alpha}) * nk WHEN v > 0 THEN nv ELSE nk END")} AS s FROM nn)"""


def _queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def _best(spark, sf, how, k):
    """The k best documents of each question: qid, doc_id, score. They are few and used more than once, so they are kept."""
    hits = best_texts(table(spark, sf, "documents"), _queries(spark, sf), how, k)
    return hits.select("qid", "doc_id", (F.col("s") / 1e6).alias("score")).persist()


def _keyword(spark, sf, k):
    return _best(spark, sf, "bm25", k)


def _vector(spark, sf, k):
    return _best(spark, sf, "overlap", k)


def _ranked(df, k, score="score"):
    return R.top_k(df.withColumn("s", q6(F.col(score))), k, "s").select("qid", "doc_id", F.col("s").alias("score"), "rank")


@register("bm25_topk", f"WITH {SCORES}, {cut('c', 'bm', 10)} SELECT qid, doc_id, s AS score, rank FROM c")
def bm25_topk(spark, sf):
    return _ranked(_keyword(spark, sf, 10), 10)


@register("overlap_topk", f"WITH {SCORES}, {cut('c', 'ov', 10)} SELECT qid, doc_id, s AS score, rank FROM c")
def overlap_topk(spark, sf):
    return _ranked(_vector(spark, sf, 10), 10)


@register("hybrid_search", f"WITH {SCORES}, {cut('vc', 'ov', 20)}, {cut('kc', 'bm', 20)}, {fused('0.7::DOUBLE')}, {cut('o', 'f', 10)} SELECT qid, doc_id, s AS score, rank FROM o")
def hybrid_search(spark, sf):
    """The flagship: keyword and overlap scores fused, ten documents for each benchmark question."""
    return R.search("hybrid", _vector(spark, sf, 20), _keyword(spark, sf, 20), 10)


@register("fusion_scores", f"WITH {SCORES}, {cut('vc', 'ov', 20)}, {cut('kc', 'bm', 20)}, {fused('0.5::DOUBLE')} SELECT qid, doc_id, {Q6.format('v')} AS vector_score, {Q6.format('k')} AS bm25_score, s AS score FROM f")
def fusion_scores(spark, sf):
    c = lambda df: R.top_k(df.withColumn("score", q6(F.col("score")) / 1e6), 20)
    f = R.fuse(c(_vector(spark, sf, 20)), c(_keyword(spark, sf, 20)), 0.5)
    return f.select("qid", "doc_id", *[q6(F.col(n)).alias(n) for n in ("vector_score", "bm25_score", "score")])


@register(
    "alpha_sweep",
    f"""WITH {SCORES}, {cut("vc", "ov", 20)}, {cut("kc", "bm", 20)}, {fused("a.alpha").replace("FROM nn)", "FROM nn, (SELECT unnest([0.3, 0.5, 0.7, 0.9])::DOUBLE AS alpha) a)").replace("SELECT qid, doc_id, v, k, floor", "SELECT alpha, qid, doc_id, v, k, floor")},
    t AS (SELECT alpha, qid, doc_id, s FROM f QUALIFY row_number() OVER (PARTITION BY alpha, qid ORDER BY s DESC, doc_id) <= 5)
    SELECT floor(alpha * 10 + 0.5)::BIGINT AS alpha10, count(*) AS n, sum(s)::BIGINT AS score FROM t GROUP BY 1""",
)
def alpha_sweep(spark, sf):
    """Every alpha over the same two cut lists: a query and an alpha together are one query of the fusion."""
    alphas = F.explode(F.array(*[F.lit(a) for a in (0.3, 0.5, 0.7, 0.9)]))
    c = lambda df: R.top_k(df.withColumn("score", q6(F.col("score")) / 1e6), 20).withColumn("alpha", alphas).withColumn("qid", F.struct("qid", "alpha"))
    f = R.fuse(c(_vector(spark, sf, 20)), c(_keyword(spark, sf, 20)), F.col("qid.alpha"))
    return _ranked(f, 5).groupBy(F.round(F.col("qid.alpha") * 10).cast("long").alias("alpha10")).agg(F.count("*").alias("n"), F.sum("score").alias("score"))


@register("plain_scores", f"WITH {SCORES}, {cut('c', 'bm', 10)} SELECT qid, doc_id, {Q6.format('CASE WHEN score <= 0 THEN 0 WHEN score > 1 THEN least(1.0, score / 10) ELSE score END')} AS score FROM c")
def plain_scores(spark, sf):
    return _ranked(_keyword(spark, sf, 10), 10).select("qid", "doc_id", q6(R.plain_score(F.col("score") / 1e6)).alias("score"))


@register(
    "rerank_combine",
    f"""WITH {SCORES}, {cut("vc", "ov", 20)}, {cut("kc", "bm", 20)}, {fused("0.7::DOUBLE")}, x AS (SELECT f.qid, f.doc_id, {Q6.format("0.4 * greatest(0, least(1, f.s / 1e6)) + 0.6 / (1 + exp(-(coalesce(ov.s, 0) / 1e6)))")} AS s FROM f LEFT JOIN ov USING (qid, doc_id)), {cut("o", "x", 10)}
    SELECT qid, doc_id, s AS score, rank FROM o""",
)
def rerank_combine(spark, sf):
    def scorer(hits):
        ov = overlap_of(hits, table(spark, sf, "documents"), _queries(spark, sf)).select("qid", "doc_id", (q6(F.col("score")) / 1e6).alias("rerank_score"))
        return hits.withColumn("score", q6(F.col("score")) / 1e6).join(ov, ["qid", "doc_id"], "left").withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))

    return R.search("hybrid_rerank", _vector(spark, sf, 20), _keyword(spark, sf, 20), 10, scorer=scorer)


COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
DENSE = f"dn AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, {Q6.format(COS)} AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 25 = 0 AND a.vec_id <> b.vec_id)"
QRELS = "qr AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, CASE WHEN a.label = b.label THEN 2 ELSE 1 END AS relevance FROM embeddings a JOIN embeddings b ON a.vec_id % 25 = 0 AND a.vec_id <> b.vec_id AND abs(a.label - b.label) <= 1)"


def _dense(spark, sf, k=None, least=None, among="true"):
    """The query set, vectors whose id is divisible by 25, which those divisible by 100 are part of, against all: cosine in millionths."""
    e = table(spark, sf, "embeddings")
    v = e.where(among).select(F.col("vec_id").alias("doc_id"), "embedding")
    q = e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    d = dense_blocks(v, q, k, least)
    return d if k is None else R.top_k(d, k)


def _qrels(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    a, b = e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("la")), e.select(F.col("vec_id").alias("doc_id"), F.explode(F.array(F.col("label") - 1, F.col("label"), F.col("label") + 1)).alias("la"), "label")
    return a.join(b, "la").where("qid <> doc_id").select("qid", "doc_id", F.when(F.col("la") == F.col("label"), 2).otherwise(1).alias("relevance"))


@register("dense_topk", f"WITH {DENSE}, {cut('c', 'dn', 10)} SELECT qid, doc_id, s AS score, rank FROM c")
def dense_topk(spark, sf):
    return _dense(spark, sf, 10)


@register("dense_threshold", f"WITH {DENSE} SELECT qid, count(*) AS n FROM dn WHERE s >= 200000 GROUP BY 1")
def dense_threshold(spark, sf):
    return _dense(spark, sf, least=200_000).groupBy("qid").agg(F.count("*").alias("n"))


def _run(spark, sf):
    """Two methods: cosine, and cosine within the odd vectors only."""
    a, b = _dense(spark, sf, 20).withColumn("method", F.lit("dense")), _dense(spark, sf, 20, among="vec_id % 2 = 1").withColumn("method", F.lit("odd"))
    return a.union(b).select("method", "qid", "doc_id", "rank")


RUN = f"""{DENSE}, {QRELS}, {cut("ra", "dn", 20)}, od AS (SELECT * FROM dn WHERE doc_id % 2 = 1), {cut("rb", "od", 20)},
run AS (SELECT 'dense' AS method, qid, doc_id, rank FROM ra UNION ALL SELECT 'odd', qid, doc_id, rank FROM rb),
g AS (SELECT method, qid, count(*) FILTER (coalesce(relevance, 0) > 0) AS hits, sum((pow(2, coalesce(relevance, 0)) - 1) / log2(rank + 1)) AS dcg,
  coalesce(sum(1 / log2(rank + 1)) FILTER (coalesce(relevance, 0) > 0), 0) AS bdcg, min(rank) FILTER (coalesce(relevance, 0) > 0) AS first, count(relevance) AS judged, count(*) AS retrieved
  FROM run LEFT JOIN qr USING (qid, doc_id) WHERE rank <= 10 GROUP BY 1, 2),
pl AS (SELECT qid, relevance, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, doc_id) AS p FROM qr),
id AS (SELECT qid, count(*) AS relevant, sum((pow(2, relevance) - 1) / log2(p + 1)) FILTER (p <= 10) AS idcg, sum(1 / log2(p + 1)) FILTER (p <= 10) AS ibdcg FROM pl GROUP BY 1),
pq AS (SELECT method, qid, relevant > 0 AS evaluable, hits / relevant::DOUBLE AS recall, dcg / idcg AS ndcg, least(1.0, bdcg / ibdcg) AS binary_ndcg, coalesce(1.0 / first, 0)::DOUBLE AS mrr, judged, retrieved FROM g JOIN id USING (qid))"""
METRICS = ("recall", "ndcg", "binary_ndcg", "mrr")


@register("ranking_per_query", f"WITH {RUN} SELECT method, qid, evaluable, judged, retrieved, {', '.join(f'{Q6.format(m)} AS {m}' for m in METRICS)} FROM pq")
def ranking_per_query(spark, sf):
    p = M.ranking_metrics(_run(spark, sf), _qrels(spark, sf))
    return p.select("method", "qid", "evaluable", "judged", "retrieved", *[q6(F.col(m)).alias(m) for m in METRICS])


@register("method_summary", f"WITH {RUN} SELECT method, count(*) AS queries, count(*) FILTER (evaluable) AS evaluable, {', '.join(f'{Q6.format(f'avg({m})')} AS {m}' for m in METRICS)}, {Q6.format('avg(CASE WHEN ndcg > 0 THEN 1.0 ELSE 0 END)')} AS hit_rate FROM pq GROUP BY 1")
def method_summary(spark, sf):
    s = M.method_summary(M.ranking_metrics(_run(spark, sf), _qrels(spark, sf)))
    return s.select("method", "queries", "evaluable", *[q6(F.col(m)).alias(m) for m in (*METRICS, "hit_rate")])


@register("qrels_pool", f"WITH {RUN}, p AS (SELECT qid, doc_id, method || ':' || rank AS x FROM run WHERE rank <= 10) SELECT qid, doc_id, string_agg(x, ';' ORDER BY x) AS sources, count(*) AS n_methods FROM p GROUP BY 1, 2")
def qrels_pool(spark, sf):
    return M.pool(_run(spark, sf), 10)


@register("qrels_stats", f"WITH {QRELS} SELECT count(*) AS judgments, count(DISTINCT doc_id) AS docs, count(*) FILTER (relevance > 0) AS positives, count(*) FILTER (relevance = 2) AS high FROM qr")
def qrels_stats(spark, sf):
    return _qrels(spark, sf).agg(F.count("*").alias("judgments"), F.countDistinct("doc_id").alias("docs"), F.count_if(F.col("relevance") > 0).alias("positives"), F.count_if(F.col("relevance") == 2).alias("high"))


@register("unjudged", f"WITH {RUN} SELECT method, count(*) AS n FROM run ANTI JOIN qr USING (qid, doc_id) WHERE rank <= 10 GROUP BY 1")
def unjudged(spark, sf):
    return _run(spark, sf).where("rank <= 10").join(_qrels(spark, sf), ["qid", "doc_id"], "left_anti").groupBy("method").agg(F.count("*").alias("n"))


@register("bootstrap_interval")
def bootstrap_interval(spark, sf):
    b = M.bootstrap(M.ranking_metrics(_run(spark, sf), _qrels(spark, sf)), "method", "qid", "ndcg")
    return b.select("method", *[q6(F.col(c)).alias(c) for c in ("mean", "lower", "upper")])


@register("mmr_selection")
def mmr_selection(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    hits = _dense(spark, sf, 30).withColumn("score", F.col("score") / 1e6).join(e, "doc_id").withColumn("chunk_index", F.lit(0).cast("long"))
    return R.mmr(hits.withColumn("doc_id", F.expr("doc_id div 3")).select("qid", "doc_id", "chunk_index", "score", "embedding"))


CHUNK_HITS = f"""{CHUNKS}, bt AS (SELECT item_id AS qid, text AS question, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark),
ct AS (SELECT doc_id, chunk_index, content, list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+')) AS t FROM chunks),
ci AS (SELECT qid, doc_id, chunk_index, count(*) AS sh FROM (SELECT qid, unnest(t) AS term FROM bt) JOIN (SELECT doc_id, chunk_index, unnest(t) AS term FROM ct) USING (term) GROUP BY ALL),
cs AS (SELECT qid, question, doc_id, chunk_index, content, {Q6.format("sh / (len(bt.t) + len(ct.t) - sh)::DOUBLE")} AS s FROM ci JOIN bt USING (qid) JOIN ct USING (doc_id, chunk_index)),
ch AS (SELECT *, s / 1e6 AS score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id, chunk_index) AS rank FROM cs QUALIFY rank <= 12)"""


def _chunk_hits(spark, sf, k=12):
    """The best chunks by token overlap: qid, question, doc_id, chunk_index, content, score, rank."""
    d = table(spark, sf, "documents")
    top = best_texts(chunks(d), _queries(spark, sf), "overlap", k, ("doc_id", "chunk_index"), "content").withColumn("score", F.col("s") / 1e6).persist()
    # k hits a question are few; texts stay where they are read.
    c = chunks(d.join(F.broadcast(top.select("doc_id").distinct()), "doc_id", "left_semi"))
    hits = c.join(F.broadcast(top), ["doc_id", "chunk_index"]).join(_queries(spark, sf), "qid")
    return hits.select("qid", "question", "doc_id", "chunk_index", "content", "score", "rank").persist()


@register(
    "doc_aggregate",
    f"""WITH {CHUNK_HITS}, g AS (SELECT qid, doc_id, min(chunk_index)::BIGINT AS min_page, max(chunk_index)::BIGINT AS max_page, count(*) AS n, avg(score) AS a, max(score) AS h, min(score) AS l FROM ch GROUP BY 1, 2)
    SELECT qid, doc_id, min_page, max_page, n, {Q6.format("a")} AS avg_score, {Q6.format("h")} AS max_score, {Q6.format("l")} AS min_score, {Q6.format("least(1.0, 0.4 * a + 0.4 * h + 0.2 * least(1.0, n / 5.0))")} AS relevance FROM g""",
)
def doc_aggregate(spark, sf):
    a = R.aggregate_documents(_chunk_hits(spark, sf))
    return a.select("qid", "doc_id", "min_page", "max_page", "n", *[q6(F.col(c)).alias(c) for c in ("avg_score", "max_score", "min_score", "relevance")])


@register(
    "context_budget",
    rf"""WITH {CHUNK_HITS}, w AS (SELECT qid, rank, doc_id, regexp_extract_all(content, '\S+') AS w FROM ch WHERE rank <= 8),
    l AS (SELECT *, 900 - coalesce(sum(len(w)) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM w)
    SELECT qid, rank, doc_id, md5(array_to_string(w[1:room], ' ')) AS digest FROM l WHERE room > 0""",
)
def context_budget(spark, sf):
    return R.context_budget(_chunk_hits(spark, sf), 8, 900).select("qid", "rank", "doc_id", F.md5("content").alias("digest"))


@register(
    "combined_content",
    f"""WITH {CHUNKS}, b AS (SELECT *, coalesce(sum(length(content)) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM chunks),
    k AS (SELECT doc_id, chunk_index, substr(content, 1, (6000 - before)::BIGINT) AS c FROM b WHERE before + length(content) <= 6000 OR (6000 - before > 100 AND before < 6000))
    SELECT doc_id, md5(string_agg(c, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_index)) AS digest FROM k GROUP BY 1""",
)
def combined_content(spark, sf):
    return R.combine_content(chunks(table(spark, sf, "documents")), 6000).select("doc_id", F.md5("content").alias("digest"))


@register("neighbour_chunks", f"WITH {CHUNK_HITS} SELECT DISTINCT ch.qid, c.doc_id, c.chunk_index::BIGINT AS chunk_index FROM ch JOIN chunks c ON c.doc_id = ch.doc_id AND abs(c.chunk_index - ch.chunk_index) <= 1")
def neighbour_chunks(spark, sf):
    hits, d = _chunk_hits(spark, sf), table(spark, sf, "documents")
    return R.neighbours(hits, chunks(d.join(F.broadcast(hits.select("doc_id").distinct()), "doc_id", "left_semi"))).select("qid", "doc_id", "chunk_index")


CONF = rf"""{CHUNK_HITS}, x AS (SELECT *, list_distinct(regexp_extract_all(lower(question), '\S+')) AS asked, list_distinct(regexp_extract_all(lower(content), '\S+')) AS held, length(content) AS len FROM ch),
pr AS (SELECT a.qid, avg(len(list_intersect(a.held, b.held)) / len(list_distinct(a.held || b.held))::DOUBLE) AS alike FROM x a JOIN x b ON a.qid = b.qid AND a.rank < b.rank GROUP BY 1),
g AS (SELECT qid, count(*) AS n, max(score) AS hi, min(score) AS lo, avg(score) AS av, stddev_pop(score) AS sd, avg(len(list_intersect(asked, held)) / len(asked)::DOUBLE) AS m, any_value(asked) AS asked, list_distinct(flatten(list(held))) AS allh,
  avg(len) AS ln, count(DISTINCT doc_id) AS docs, avg((least(1.0, len / 500.0) + length(regexp_replace(content, '\s', '', 'g')) / len::DOUBLE + 0.5 + CASE WHEN regexp_matches(content, '\d') THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(content, '[.!?;:]') THEN 0.2 ELSE 0 END) / 3) AS cq FROM x GROUP BY 1),
p AS (SELECT qid, greatest(0, least(1, (0.5 * hi + 0.4 * av + 0.1 * m) * greatest(0.5, 1 - sd))) AS relevance,
  0.3 * least(1.0, n / 5.0) + 0.2 * least(1.0, ln / 1000) + 0.3 * len(list_intersect(asked, allh)) / len(asked)::DOUBLE + 0.2 * least(1.0, docs / 3.0) AS completeness,
  CASE WHEN n < 2 THEN 0.5 ELSE greatest(0, least(1, 0.4 * greatest(0, 1 - sd / av) + 0.4 * coalesce(alike, 0.5) + 0.2 * (1 - docs / n::DOUBLE))) END AS consistency,
  greatest(0, least(1, 0.3 * 0.6 + 0.3 * least(1.0, (hi - lo) * 2) + 0.4 * cq)) AS quality FROM g LEFT JOIN pr USING (qid))"""


@register("confidence_components", f"WITH {CONF} SELECT qid, {', '.join(f'{Q6.format(c)} AS {c}' for c in ('relevance', 'completeness', 'consistency', 'quality'))}, {Q6.format('greatest(0.05, least(0.95, (0.4 * relevance + 0.25 * completeness + 0.2 * consistency + 0.15 * quality) * 0.8))')} AS overall FROM p")
def confidence_components(spark, sf):
    c = C.confidence(_chunk_hits(spark, sf))
    return c.select("qid", *[q6(F.col(n)).alias(n) for n in ("relevance", "completeness", "consistency", "quality", "overall")])


@register("simple_confidence", f"WITH {CHUNK_HITS} SELECT qid, {Q6.format('greatest(0, least(1, avg(score) * least(1.0, count(*) / 5.0) * greatest(0.5, 1 - var_pop(score)) * least(1.0, sum(length(content)) / 1000.0)))')} AS confidence FROM ch GROUP BY 1")
def simple_confidence(spark, sf):
    return C.simple_confidence(_chunk_hits(spark, sf)).select("qid", q6(F.col("confidence")).alias("confidence"))


@register(
    "adaptive_threshold",
    f"""WITH {SCORES}, {cut("c", "bm", 30)}, w AS (SELECT *, avg(score) OVER p AS a, stddev_pop(score) OVER p AS sd, min(score) OVER p AS lo, max(score) OVER p AS hi FROM c WINDOW p AS (PARTITION BY qid))
    SELECT qid, doc_id FROM w WHERE NOT (sd > 0.5 * a) OR score >= least(greatest(a - 1.5 * sd, 0.06, 0.9 * lo), 0.5 * hi)""",
)
def adaptive_threshold(spark, sf):
    return R.adaptive_threshold(_ranked(_keyword(spark, sf, 30), 30).withColumn("score", F.col("score") / 1e6)).select("qid", "doc_id")


@register(
    "keyword_filter",
    f"""WITH {CHUNK_HITS}, m AS (SELECT qid, doc_id, chunk_index, len(list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ('the', 'and', 'that', 'with') AND contains(lower(content), w))) > 0 AS m FROM ch)
    SELECT qid, doc_id, chunk_index::BIGINT AS chunk_index FROM (SELECT *, bool_or(m) OVER (PARTITION BY qid) AS sm FROM m) WHERE m OR NOT sm""",
)
def keyword_filter(spark, sf):
    return R.keyword_filter(_chunk_hits(spark, sf), ["the", "and", "that", "with"]).select("qid", "doc_id", "chunk_index")


@register("keyword_index", "SELECT p_partkey AS key, sum(CASE WHEN lower(w) = 'widget' THEN 3 WHEN contains(lower(w), 'widget') THEN 1 ELSE 0 END)::BIGINT AS score FROM (SELECT p_partkey, unnest(string_split(p_type, ' ') || string_split(p_name, ' ')) AS w FROM part) GROUP BY 1 HAVING score > 0 ORDER BY 2 DESC, 1 LIMIT 10")
def keyword_index(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.explode(F.concat(F.split("p_type", " "), F.split("p_name", " "))).alias("keyword"))
    return R.keyword_index(p, "widget")


@register(
    "citations",
    r"""WITH a AS (SELECT conv_id, turn, text || ' [s' || (turn % 4) || '] and [s' || (length(text) % 5) || ']' AS t FROM conversations),
    c AS (SELECT conv_id, turn, t, list_sort(list_distinct(list_transform(regexp_extract_all(t, '\[s(\d+)\]', 1), lambda x: x::INT))) AS c FROM a)
    SELECT conv_id, turn, array_to_string(c, ',') AS cited, list_min(c) >= 1 AND list_max(c) <= 3 AND len(list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ') <> '' AND NOT regexp_matches(x, '\[s\d+\]'))) = 0 AS valid FROM c""",
)
def citations(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" [s"), F.col("turn") % 4, F.lit("] and [s"), F.length("text") % 5, F.lit("]")).alias("answer"), F.lit(3).alias("n_sources"))
    return R.citations(t).select("conv_id", "turn", F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"), "valid")


@register(
    "prf_token_set",
    rf"""WITH a AS (SELECT lang AS field, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS p, list_distinct(regexp_extract_all(lower(regexp_replace(text, '[a-z]+[.]', 'end.', 'g')), '[a-z0-9]+')) AS g FROM documents),
    s AS (SELECT field, sum(len(list_intersect(p, g)))::BIGINT AS tp, sum(len(p) - len(list_intersect(p, g)))::BIGINT AS fp, sum(len(g) - len(list_intersect(p, g)))::BIGINT AS fn, count(*) AS samples FROM a WHERE len(p) > 0 OR len(g) > 0 GROUP BY 1)
    SELECT *, {Q6.format("tp / (tp + fp)::DOUBLE")} AS precision, {Q6.format("tp / (tp + fn)::DOUBLE")} AS recall, {Q6.format("2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE)")} AS f1 FROM s""",
)
def prf_token_set(spark, sf):
    from marlspring.functions.scalars import tokens

    d = table(spark, sf, "documents").select(F.col("lang").alias("field"), tokens(F.col("text")).alias("p"), tokens(F.regexp_replace("text", "[a-z]+[.]", "end.")).alias("g"))
    return M.set_scores(d, "doc_id", "field", "p", "g").select("field", "tp", "fp", "fn", "samples", *[q6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@register(
    "prf_exact",
    f"""WITH a AS (SELECT source AS field, CASE WHEN n_chars > 1500 THEN '1' ELSE '0' END AS p, quality::VARCHAR AS g FROM documents LEFT JOIN labels USING (doc_id)),
    s AS (SELECT field, count(*) FILTER (p = g) AS tp, count(*) FILTER (p IS NOT NULL AND p IS DISTINCT FROM g) AS fp, count(*) FILTER (g IS NOT NULL AND p IS DISTINCT FROM g) AS fn, count(*) AS samples FROM a GROUP BY 1),
    r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS r FROM s)
    SELECT field, tp, fp, fn, samples, {Q6.format("p")} AS precision, {Q6.format("r")} AS recall, {Q6.format("coalesce(2 * p * r / nullif(p + r, 0), 0)")} AS f1 FROM r""",
)
def prf_exact(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(F.col("source").alias("field"), F.when(F.col("n_chars") > 1500, "1").otherwise("0").alias("p"), F.col("quality").cast("string").alias("g"))
    return M.exact_scores(d, "field", "p", "g").select("field", "tp", "fp", "fn", "samples", *[q6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])
