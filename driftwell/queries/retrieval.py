"""Retrieval queries over ``embeddings``: insertion index vec_id + 1, every id divisible by 20 a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.functions import vectors as V
from driftwell.operators import retrieval as R
from driftwell.operators import scan as S
from driftwell.session import stored

RULE = R.Rule()
LAMBDAS = (1.0, 0.9995, 0.99861, 0.995, 0.99)
WINDOW, LIMIT, BLOCK, HALF_LIFE = 100, 20, 32, 50.0


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("id"), (F.col("vec_id") + 1).alias("ins"), F.col("embedding").alias("v"), "label")


def asked(mem: DataFrame) -> DataFrame:
    return mem.filter(F.col("id") % 20 == 0).select(F.col("id").alias("qid"), F.col("ins").alias("qins"), "v")


def _out(found: DataFrame) -> DataFrame:
    return found.select("qid", "rank", "id", "age", F.round("cosine", 9).alias("cosine"), F.round("score", 9).alias("score"))


def retrieve_topk(spark, sf_dir, rule=RULE, order=R.ONLINE):
    m = memory(spark, sf_dir)
    return _out(R.retrieve(asked(m), m, rule, order))


def retrieve_topk_no_decay(spark, sf_dir):
    return retrieve_topk(spark, sf_dir, R.Rule(decay=1.0))


def retrieve_gate_empty(spark, sf_dir):
    return retrieve_topk(spark, sf_dir, R.Rule(tau=0.7))


def exhaustive_weighted_topk(spark, sf_dir):
    return retrieve_topk(spark, sf_dir, RULE, R.EXHAUSTIVE)


def standalone_topk(spark, sf_dir):
    """Ties of the score stay in insertion order."""
    return retrieve_topk(spark, sf_dir, RULE, R.STANDALONE)


def triangular_topk(spark, sf_dir):
    """Every record asks, over the whole prefix before it; its walk ends where nothing older can enter its top K."""
    m = memory(spark, sf_dir).filter("ins is not null")
    store = S.BlockStore.write(m)
    oldest = min((low for low, _ in store.bounds.values()), default=1)
    q = m.select(F.col("id").alias("qid"), F.col("ins").alias("qins"), "v", F.lit(oldest).alias("first"))
    found = stored(S.walk(q, store, RULE, S.growing(WINDOW), order=R.ONLINE), "walk")
    store.drop(spark)
    return _out(S.hits_of(found, RULE, R.ONLINE))


def fixed_recency_topk(spark, sf_dir):
    m = memory(spark, sf_dir)
    return _out(R.fixed_recency(asked(m), m, RULE, WINDOW))


def semantic_candidates_rerank(spark, sf_dir):
    m = memory(spark, sf_dir)
    return _out(R.rerank(R.semantic_candidates(asked(m), m, RULE, LIMIT).drop("rank"), RULE))


def rerank_dedup(spark, sf_dir):
    """Two candidate lists that overlap: the semantic one comes first, the recent one adds what is new."""
    m = memory(spark, sf_dir)
    q = asked(m)
    a = R.semantic_candidates(q, m, RULE, LIMIT).withColumn("source", F.lit(1))
    b = R.fixed_recency(q, m, RULE, WINDOW).withColumn("source", F.lit(2))
    return _out(R.rerank(a.unionByName(b).drop("rank"), RULE, first="source"))


FAST = R.Rule(decay=0.99)


def _walked(spark, sf_dir, *searches: tuple[R.Rule, S.Schedule, int | None]) -> list[DataFrame]:
    """The memory packed once and walked for each search; the blocks go when all results are written."""
    m = memory(spark, sf_dir)
    store = S.BlockStore.write(m)
    out = [stored(S.walk(asked(m), store, *search), "walk") for search in searches]
    store.drop(spark)
    return out


def adaptive_window_topk(spark, sf_dir):
    (found,) = _walked(spark, sf_dir, (RULE, S.growing(WINDOW), None))
    return _out(S.hits_of(found, RULE))


def adaptive_window_horizon(spark, sf_dir):
    (found,) = _walked(spark, sf_dir, (FAST, S.growing(WINDOW), None))
    return found.select("qid", "horizon", "calls")


def certified_topk(spark, sf_dir):
    (found,) = _walked(spark, sf_dir, (FAST, S.steps(BLOCK), None))
    return _out(S.hits_of(found, FAST))


def certified_horizon(spark, sf_dir):
    (found,) = _walked(spark, sf_dir, (FAST, S.steps(BLOCK), None))
    return found.select("qid", "horizon")


def recent_blocks_topk(spark, sf_dir):
    """The newest records alone, from the blocks that hold them."""
    (found,) = _walked(spark, sf_dir, (RULE, S.steps(WINDOW), WINDOW))
    return _out(S.hits_of(found, RULE))


STRATEGIES = {"adaptive_window": (S.growing(WINDOW), None), "certified_scan": (S.steps(BLOCK), None), "fixed_recency": (S.steps(WINDOW), WINDOW)}


def search_metrics(spark, sf_dir):
    """What each strategy costs at each decay: windows asked for, records passed, horizon and its share of the memory."""
    runs = [(decay, name, R.Rule(decay=decay), *STRATEGIES[name]) for decay in LAMBDAS for name in STRATEGIES]
    out = None
    for (decay, name, *_), found in zip(runs, _walked(spark, sf_dir, *(run[2:] for run in runs)), strict=True):
        share = F.when(F.col("qins") > 1, F.col("horizon") / (F.col("qins") - 1)).otherwise(0.0)
        spread = [F.round(F.percentile(c, q), 9).alias(f"{c}_p{round(100 * q)}") for c in ("horizon", "candidates") for q in (0.5, 0.95)]
        means = [F.round(F.avg(c), 9).alias(f"mean_{n}") for n, c in (("horizon", F.col("horizon")), ("share", share), ("candidates", F.col("candidates")), ("calls", F.col("calls")))]
        row = found.agg(F.count("*").alias("queries"), *means, F.round(F.stddev_pop("candidates"), 9).alias("sd_candidates_pop"), *spread)
        row = row.select(F.lit(decay).alias("decay"), F.lit(name).alias("strategy"), "*")
        out = row if out is None else out.union(row)
    return out


def safe_horizon(spark, sf_dir):
    m = memory(spark, sf_dir)
    found = R.retrieve(asked(m), m, RULE, R.EXHAUSTIVE)
    kth = found.groupBy("qid").agg(F.count("*").alias("found"), F.min("score").alias("kth"))
    full = kth.filter(F.col("found") == RULE.k)
    return full.select("qid", V.minimum_safe_horizon(RULE.decay, F.col("kth")).alias("horizon"))


def _ids(found: DataFrame, name: str) -> DataFrame:
    return found.groupBy("qid").agg(F.collect_list("id").alias(name))


def _recall(q: DataFrame, truth: DataFrame, other: DataFrame) -> DataFrame:
    rows = q.select("qid").join(_ids(truth, "expected"), "qid", "left").join(_ids(other, "observed"), "qid", "left")
    none = F.array().cast("array<long>")
    return rows.select("qid", V.recall(F.coalesce("expected", none), F.coalesce("observed", none)).alias("recall"))


def recall_at_k(spark, sf_dir):
    m = memory(spark, sf_dir)
    q = asked(m)
    return _recall(q, R.retrieve(q, m, RULE, R.EXHAUSTIVE), R.fixed_recency(q, m, RULE, WINDOW)).select("qid", F.round("recall", 9).alias("recall"))


def lambda_sweep_recall(spark, sf_dir):
    """Mean recall of the recency window and of semantic candidates, for each decay."""
    m = memory(spark, sf_dir)
    q = asked(m)
    candidates = R.semantic_candidates(q, m, RULE, LIMIT).drop("rank")
    out = None
    for decay in LAMBDAS:
        rule = R.Rule(decay=decay)
        truth = R.retrieve(q, m, rule, R.EXHAUSTIVE)
        for name, found in (("fixed_recency", R.fixed_recency(q, m, rule, WINDOW)), ("candidates", R.rerank(candidates, rule))):
            row = _recall(q, truth, found).agg(F.round(F.avg("recall"), 9).alias("mean_recall"))
            row = row.select(F.lit(decay).alias("decay"), F.lit(name).alias("strategy"), "mean_recall")
            out = row if out is None else out.union(row)
    return out


def halflife_retrieval(spark, sf_dir):
    """Similarity times 0.5 ^ (age / half-life): a decay of 0.5 ^ (1 / half-life); larger scores, then younger ages."""
    m = memory(spark, sf_dir)
    return _out(R.retrieve(asked(m), m, R.Rule(decay=0.5 ** (1 / HALF_LIFE))))


def max_cross_similarity(spark, sf_dir):
    """For each query vector the most similar one of another label."""
    m = memory(spark, sf_dir)
    q = m.join(asked(m).select("qid"), F.col("id") == F.col("qid")).select("qid", "v", "label")
    return R.nearest(q, m, other="label").select("qid", "id", F.round("cosine", 9).alias("cosine"))


def max_inner_similarity(spark, sf_dir):
    """For each query vector the most similar other one of its own label."""
    m = memory(spark, sf_dir)
    q = m.join(asked(m).select("qid"), F.col("id") == F.col("qid")).select("qid", "v", "label")
    return R.nearest(q, m, same="label", same_table=True).select("qid", "id", F.round("cosine", 9).alias("cosine"))


def retrieval_context_text(spark, sf_dir):
    m = memory(spark, sf_dir)
    found = R.retrieve(asked(m), m, RULE)
    shown = F.format_string("[%d] age %d", "id", "age")
    rows = R.context_text(found, shown)
    return asked(m).select("qid").join(rows, "qid", "left").select("qid", F.coalesce("context", F.lit("None.")).alias("context"))


def normalised_embeddings(spark, sf_dir):
    m = memory(spark, sf_dir).withColumn("u", V.normalised(F.col("v")))
    return m.select("id", F.round(V.norm(F.col("v")), 6).alias("norm"), F.round(V.norm(F.col("u")), 6).alias("unit_norm"))


_PAIRS = """
m AS (SELECT vec_id AS id, vec_id + 1 AS ins, embedding::DOUBLE[] AS v, label FROM embeddings),
q AS (SELECT id AS qid, ins AS qins, v FROM m WHERE {asked}),
p AS (SELECT qid, qins, id, ins, qins - 1 - ins AS age, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, list_dot_product(q.v, m.v))) AS cosine
      FROM q JOIN m ON m.ins < q.qins)"""
_SHOWN = "round(cosine, 9) AS cosine, round(score, 9) AS score"


def _pairs(asked: str = "id % 20 = 0") -> str:
    return _PAIRS.format(asked=asked)


def _scored(decay: float, tau: float = 0.2, where: str = "true", source: str = "p") -> str:
    return f"SELECT *, cosine * pow({decay!r}::DOUBLE, age) AS score FROM {source} WHERE cosine > 0 AND cosine >= {tau}::DOUBLE AND {where}"


def _top(scored: str, order: str, k: int = 5) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS rank FROM ({scored})) WHERE rank <= {k}"


_ON, _EX, _SE = "score DESC, ins DESC, id DESC", "score DESC, cosine DESC, ins DESC, id DESC", "cosine DESC, ins DESC, id DESC"


def _sql(top: str, asked: str = "id % 20 = 0") -> str:
    return f"WITH {_pairs(asked)} SELECT qid, rank, id, age, {_SHOWN} FROM ({top})"


_CAND = f"SELECT qid, qins, id, ins, age, cosine FROM ({_top('SELECT * FROM p WHERE cosine > 0 AND cosine >= 0.2::DOUBLE', _SE, LIMIT)})"
_TRUTH = _top(_scored(RULE.decay), _EX)
_RECENT = _top(_scored(RULE.decay, where=f"age < {WINDOW}"), _EX)


def _recall_sql(truth: str, found: str) -> str:
    return f"""SELECT q.qid, CASE WHEN t.e IS NULL THEN 1.0::DOUBLE ELSE len(list_intersect(t.e, coalesce(f.o, []::BIGINT[])))::DOUBLE / len(t.e) END AS recall
      FROM q LEFT JOIN (SELECT qid, list(id) AS e FROM ({truth}) GROUP BY qid) t USING (qid)
             LEFT JOIN (SELECT qid, list(id) AS o FROM ({found}) GROUP BY qid) f USING (qid)"""


def _sweep() -> str:
    rows = []
    for decay in LAMBDAS:
        truth = _top(_scored(decay), _EX)
        for name, found in (("fixed_recency", _top(_scored(decay, where=f"age < {WINDOW}"), _EX)), ("candidates", _top(_scored(decay, source=f"({_CAND})"), _EX))):
            rows.append(f"SELECT {decay!r}::DOUBLE AS decay, '{name}' AS strategy, round(avg(recall), 9) AS mean_recall FROM ({_recall_sql(truth, found)})")
    return f"WITH {_pairs()} " + " UNION ALL ".join(rows)


def _windows(decay: float, ends: str) -> str:
    """First window end at which a scan may stop; ``ends`` makes (qid, qins, h)."""
    return f"""WITH {_pairs()}, s AS ({_scored(decay)}), w AS ({ends}),
      k AS (SELECT w.qid, w.qins, w.h, list_sort(list(s.score), 'DESC')[{RULE.k}] AS kth FROM w LEFT JOIN s ON s.qid = w.qid AND s.age < w.h GROUP BY ALL),
      ok AS (SELECT qid, min(h) AS h FROM k WHERE kth > 0 AND pow({decay!r}::DOUBLE, h) < kth GROUP BY qid)"""


_ADAPT = f"SELECT qid, qins, unnest([least({WINDOW} * pow(2, i)::BIGINT, 1000000000) for i in range(0, 24)]) AS h FROM q"
_SCAN = f"SELECT qid, qins, unnest(range({BLOCK}, qins + {BLOCK}, {BLOCK})) AS h FROM q"


def _near(left: str, right: str) -> str:
    return f"""WITH m AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)
      SELECT qid, id, round(cosine, 9) AS cosine FROM (
        SELECT a.id AS qid, b.id, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, list_dot_product(a.v, b.v))) AS cosine,
               row_number() OVER (PARTITION BY a.id ORDER BY greatest(-1.0::DOUBLE, least(1.0::DOUBLE, list_dot_product(a.v, b.v))) DESC, b.id DESC) AS n
        FROM m a JOIN m b ON {left} AND {right}) WHERE n = 1"""


def _ends_sql(decay: float, name: str) -> str:
    """``(qid, qins, horizon, calls)`` of a strategy."""
    all_of_it = "SELECT qid, qins, qins - 1 AS horizon, 1::BIGINT AS calls FROM q"
    if name == "fixed_recency":
        return all_of_it.replace("qins - 1 AS", f"least(qins - 1, {WINDOW}) AS")
    if decay == 1:
        return all_of_it
    ends = _ADAPT if name == "adaptive_window" else _SCAN
    body = _windows(decay, ends).split(", s AS (", 1)[1]
    calls = f"(1 + log2(a.h / {WINDOW}))::BIGINT" if name == "adaptive_window" else f"greatest(1, a.h // {BLOCK})"
    return f"""WITH s AS ({body}, a AS (SELECT k.qid, min(k.h) AS h FROM k LEFT JOIN ok USING (qid) WHERE k.h = ok.h OR k.h >= k.qins - 1 GROUP BY k.qid)
      SELECT q.qid, q.qins, least(coalesce(a.h, 0), q.qins - 1) AS horizon, coalesce({calls}, 1) AS calls FROM q LEFT JOIN a USING (qid)"""


def _metrics_sql() -> str:
    rows = []
    for decay in LAMBDAS:
        for name in STRATEGIES:
            spread = ", ".join(f"round(quantile_cont({c}, {q}), 9) AS {c}_p{round(100 * q)}" for c in ("horizon", "candidates") for q in (0.5, 0.95))
            rows.append(
                f"""SELECT {decay!r}::DOUBLE AS decay, '{name}' AS strategy, count(*) AS queries, round(avg(horizon), 9) AS mean_horizon,
              round(avg(CASE WHEN qins > 1 THEN horizon / (qins - 1)::DOUBLE ELSE 0 END), 9) AS mean_share, round(avg(candidates), 9) AS mean_candidates,
              round(avg(calls), 9) AS mean_calls, round(stddev_pop(candidates), 9) AS sd_candidates_pop, {spread}
              FROM (SELECT e.*, (SELECT count(*) FROM p WHERE p.qid = e.qid AND p.age < e.horizon AND cosine > 0 AND cosine >= 0.2::DOUBLE) AS candidates FROM ({_ends_sql(decay, name)}) e)"""
            )
    return f"WITH {_pairs()} " + " UNION ALL ".join(rows)


ORACLE = {
    "retrieve_topk": _sql(_top(_scored(RULE.decay), _ON)),
    "retrieve_topk_no_decay": _sql(_top(_scored(1.0), _ON)),
    "retrieve_gate_empty": _sql(_top(_scored(RULE.decay, 0.7), _ON)),
    "exhaustive_weighted_topk": _sql(_TRUTH),
    "standalone_topk": _sql(_top(_scored(RULE.decay), "score DESC, ins ASC")),
    "triangular_topk": _sql(_top(_scored(RULE.decay), _ON), "true"),
    "fixed_recency_topk": _sql(_RECENT),
    "recent_blocks_topk": _sql(_RECENT),
    "search_metrics": _metrics_sql(),
    "semantic_candidates_rerank": _sql(_top(_scored(RULE.decay, source=f"({_CAND})"), _EX)),
    "rerank_dedup": _sql(_top(_scored(RULE.decay, source=f"({_CAND} UNION SELECT qid, qins, id, ins, age, cosine FROM ({_RECENT}))"), _EX)),
    "adaptive_window_topk": _sql(_TRUTH),
    "adaptive_window_horizon": _windows(0.99, _ADAPT)
    + f""", a AS (SELECT k.qid, min(k.h) AS h FROM k LEFT JOIN ok USING (qid) WHERE k.h = ok.h OR k.h >= k.qins - 1 GROUP BY k.qid)
      SELECT a.qid, least(a.h, q.qins - 1) AS horizon, (1 + log2(a.h / {WINDOW}))::BIGINT AS calls FROM a JOIN q USING (qid)""",
    "certified_topk": _sql(_top(_scored(0.99), _EX)),
    "certified_horizon": _windows(0.99, _SCAN) + " SELECT q.qid, least(coalesce(ok.h, q.qins - 1), q.qins - 1) AS horizon FROM q LEFT JOIN ok USING (qid)",
    "safe_horizon": f"WITH {_pairs()} SELECT qid, (floor(ln(min(score)) / ln({RULE.decay}::DOUBLE)) + 1)::BIGINT AS horizon FROM ({_TRUTH}) GROUP BY qid HAVING count(*) = 5",
    "recall_at_k": f"WITH {_pairs()} SELECT qid, round(recall, 9) AS recall FROM ({_recall_sql(_TRUTH, _RECENT)})",
    "lambda_sweep_recall": _sweep(),
    "halflife_retrieval": f"WITH {_pairs()} SELECT qid, rank, id, age, {_SHOWN} FROM ("
    + _top(f"SELECT *, cosine * pow(0.5::DOUBLE, age / {HALF_LIFE}::DOUBLE) AS score FROM p WHERE cosine >= 0.2::DOUBLE", _ON)
    + ")",
    "max_cross_similarity": _near("a.id % 20 = 0", "a.label <> b.label"),
    "max_inner_similarity": _near("a.id % 20 = 0", "a.label = b.label AND a.id <> b.id"),
    "retrieval_context_text": f"""WITH {_pairs()} SELECT q.qid, coalesce(c, 'None.') AS context FROM q LEFT JOIN (
        SELECT qid, string_agg('[' || id || '] age ' || age, chr(10) || chr(10) ORDER BY rank) AS c FROM ({_top(_scored(RULE.decay), _ON)}) GROUP BY qid) USING (qid)""",
    "normalised_embeddings": "SELECT vec_id AS id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, 1.0::DOUBLE AS unit_norm FROM embeddings",
}

QUERIES = {name: globals()[name] for name in ORACLE}
