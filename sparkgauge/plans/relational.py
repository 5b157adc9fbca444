"""Scans, projections, filters, joins, set operations and sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import merge
from ..sources import archive
from .registry import query
from .views import PROVIDERS, SQL_ATTEMPTS, SQL_TASKS, SQL_TRIALS, attempts, table, tasks, trials

KEYS = ["run", "line"]


def _arrival():
    return [F.col(c) for c in ("shard", "part", "price")]


@query(f"""WITH {SQL_ATTEMPTS} SELECT run, line, evaluated, success, ts, shard, count AS copies FROM
    (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY run, line) AS count FROM attempts WINDOW w AS (PARTITION BY run, line ORDER BY evaluated DESC, ts DESC, shard, part, price)) WHERE rn = 1""")
def dedup_keep_best(spark: SparkSession, sf: str) -> DataFrame:
    best = merge.keep_best(attempts(spark, sf), KEYS, "evaluated", "ts", _arrival())
    return best.select("run", "line", "evaluated", "success", "ts", "shard", "copies")


SQL_CONFLICTS = f"""{SQL_ATTEMPTS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY run, line ORDER BY shard, part, price) AS arrival FROM attempts),
    seen AS (SELECT *, max({{'e': evaluated, 't': ts, 'a': -arrival, 's': success, 'sh': shard}}) OVER (PARTITION BY run, line ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM numbered),
    conflicts AS (SELECT run, line, arrival, CASE WHEN best.sh <> shard THEN 'cross_shard' ELSE 're_execution' END AS kind FROM seen WHERE best.e AND evaluated AND best.s <> success)"""


@query(f"WITH {SQL_CONFLICTS} SELECT * FROM conflicts")
def merge_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return merge.conflicts(attempts(spark, sf), KEYS, "evaluated", "success", "ts", "shard", _arrival())


@query(f"""WITH {SQL_CONFLICTS} SELECT (SELECT count(*) FROM attempts) AS rows_in, (SELECT count(DISTINCT (run, line)) FROM attempts) AS rows_out,
    (SELECT count(*) FROM conflicts WHERE kind = 'cross_shard') AS cross_shard, (SELECT count(*) FROM conflicts WHERE kind = 're_execution') AS re_execution""")
def agg_merge_manifest(spark: SparkSession, sf: str) -> DataFrame:
    rows = attempts(spark, sf)
    sizes = rows.groupBy(*KEYS).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows_in"), F.count("*").alias("rows_out"))
    found = merge_conflicts(spark, sf).agg(F.count_if(F.col("kind") == "cross_shard").alias("cross_shard"), F.count_if(F.col("kind") == "re_execution").alias("re_execution"))
    return sizes.crossJoin(found)  # one row each


@query(f"""WITH {SQL_ATTEMPTS} SELECT provider, count(*) AS attempts, count(*) FILTER (evaluated) AS evaluated, count(*) FILTER (success) AS successes, count(*) FILTER (has_error) AS transport,
    coalesce(string_agg(DISTINCT CASE WHEN latency_s = 50 AND success THEN task_id::VARCHAR END, ',' ORDER BY CASE WHEN latency_s = 50 AND success THEN task_id::VARCHAR END), '') AS canary_tasks FROM attempts GROUP BY provider""")
def agg_per_leg(spark: SparkSession, sf: str) -> DataFrame:
    rows = attempts(spark, sf).withColumn("task_name", F.col("task_id").cast("string"))
    legs = merge.per_leg(rows, "provider", "evaluated", "success", "has_error", "task_name", (F.col("latency_s") == 50) & F.col("success"))
    return legs.withColumn("canary_tasks", F.concat_ws(",", "canary_tasks"))


@query(f"""WITH {SQL_ATTEMPTS}, {SQL_TRIALS}, {SQL_TASKS}, units AS (SELECT p.r AS provider, task_id, k.r AS trial FROM (SELECT DISTINCT s_suppkey % 7 AS r FROM supplier) p, tasks, range(120) k(r))
    SELECT u.* FROM units u WHERE NOT EXISTS (SELECT 1 FROM trials x WHERE x.provider = u.provider AND x.task_id = u.task_id AND x.trial = u.trial AND NOT x.has_error)""")
def anti_missing_units(spark: SparkSession, sf: str) -> DataFrame:
    providers = table(spark, sf, "supplier").select((F.col("s_suppkey") % PROVIDERS).alias("provider")).distinct()
    units = merge.planned_units(providers, tasks(spark, sf).select("task_id"), 120)
    return merge.missing_units(units, trials(attempts(spark, sf)), ["provider", "task_id", "trial"], "has_error")


@query(f"""WITH {SQL_ATTEMPTS}, {SQL_TRIALS}, {SQL_TASKS}, units AS (SELECT p.r AS provider, task_id, k.r AS trial FROM (SELECT DISTINCT s_suppkey % 7 AS r FROM supplier) p, tasks, range(120) k(r))
    SELECT DISTINCT u.task_id FROM units u WHERE NOT EXISTS (SELECT 1 FROM trials x WHERE x.provider = u.provider AND x.task_id = u.task_id AND x.trial = u.trial AND NOT x.has_error)""")
def anti_missing_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return anti_missing_units(spark, sf).select("task_id").distinct()


SQL_ORDINALS = f"""{SQL_TASKS}, units AS (SELECT s_suppkey AS provider, task_id, k.r AS trial FROM supplier, tasks, range(3) k(r)),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY md5(concat_ws('|', '0', provider, task_id)), task_id, trial) - 1 AS ordinal FROM units)"""


@query(f"WITH {SQL_TASKS} SELECT s_suppkey AS provider, task_id, k.r AS trial FROM supplier, tasks, range(3) k(r)")
def join_cross_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Every supplier as a provider, against the bounded task dimension."""
    return merge.planned_units(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("provider")), tasks(spark, sf).select("task_id"), 3)


@query(f"WITH {SQL_ORDINALS} SELECT * FROM ordered")
def win_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    return merge.ordinals(join_cross_plan(spark, sf), "provider", "task_id", "trial")


@query(f"WITH {SQL_ORDINALS} SELECT * FROM ordered WHERE ordinal % 7 = 3")
def win_stride_shard(spark: SparkSession, sf: str) -> DataFrame:
    return merge.shard(win_ordinal(spark, sf), 3, 7)


@query(f"WITH {SQL_ATTEMPTS}, {SQL_TRIALS}, {SQL_ORDINALS} SELECT o.* FROM ordered o ANTI JOIN (SELECT * FROM trials WHERE NOT has_error) t USING (provider, task_id, trial)")
def anti_resume(spark: SparkSession, sf: str) -> DataFrame:
    done = trials(attempts(spark, sf))
    return merge.missing_units(win_ordinal(spark, sf), done, ["provider", "task_id", "trial"], "has_error")


@query(f"""WITH {SQL_ATTEMPTS}, placed AS (SELECT provider, concat_ws('|', run, line, part, shard, ts) AS value, row_number() OVER (PARTITION BY provider ORDER BY run, line, part, shard, price) AS place FROM attempts),
    blocks AS (SELECT provider, (place - 1) // 4096 AS block, count(*) AS lines, sha256(string_agg(sha256(value), '' ORDER BY place)) AS digest FROM placed GROUP BY ALL)
    SELECT provider::VARCHAR AS leg, sum(lines)::BIGINT AS lines, list_reduce(list_prepend('', list(digest ORDER BY block)), lambda a, d: sha256(a || d)) AS head FROM blocks GROUP BY provider""")
def archive_chain(spark: SparkSession, sf: str) -> DataFrame:
    """The chained digests of each provider's attempts as a log: what an archive's manifest says of a leg."""
    rows = attempts(spark, sf).select(F.col("provider").cast("string").alias("leg"), F.concat_ws("|", "run", "line", "part", "shard", "ts").alias("value"), "run", "line", "part", "shard", "price")
    return archive.chain_heads(archive.block_digests(archive.placed(rows, ["run", "line", "part", "shard", "price"])))


@query(f"WITH {SQL_ATTEMPTS} SELECT DISTINCT provider, task_id, line FROM attempts WHERE NOT has_error")
def agg_distinct_keys(spark: SparkSession, sf: str) -> DataFrame:
    return attempts(spark, sf).where(~F.col("has_error")).select("provider", "task_id", "line").distinct()


@query("SELECT p_partkey AS task_id, p_name AS task_name, p_type AS family FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) AS rn FROM part) WHERE rn = 1")
def src_index_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Later rows of a name replace earlier ones."""
    last = table(spark, sf, "part").groupBy(F.col("p_name").alias("task_name")).agg(F.max_by(F.struct("p_partkey", "p_type"), "p_partkey").alias("r"))
    return last.select(F.col("r.p_partkey").alias("task_id"), "task_name", F.col("r.p_type").alias("family"))


SQL_LOADED = f"WITH {SQL_ATTEMPTS}, {SQL_TASKS} "


@query(SQL_LOADED + """SELECT a.run, a.line, a.provider, a.task_id, a.shard, a.price, t.tier, t.family, CASE WHEN a.flag <> 'A' THEN 'stored' WHEN NOT a.has_error THEN CASE WHEN a.success THEN 'pass' WHEN a.evaluated THEN 'collision' ELSE 'no_tool_call' END END AS derived
    FROM attempts a LEFT JOIN tasks t ON t.task_id = a.part""")
def src_attempts_load(spark: SparkSession, sf: str) -> DataFrame:
    """Facts with their task, if it is known, and the derived label filled in where it is missing and no error stands against it."""
    a, t = attempts(spark, sf), tasks(spark, sf).withColumnRenamed("task_id", "t")
    filled = F.when(F.col("flag") != "A", "stored").when(~F.col("has_error"), F.when(F.col("success"), "pass").when(F.col("evaluated"), "collision").otherwise("no_tool_call"))
    return a.join(F.broadcast(t), F.col("part") == F.col("t"), "left").select("run", "line", "provider", "task_id", "shard", "price", "tier", "family", filled.alias("derived"))


@query(SQL_LOADED + "SELECT a.run, a.line, a.shard, a.price, t.tier, t.family, t.archetype FROM attempts a LEFT JOIN tasks t ON t.task_id = a.part")
def join_left_meta(spark: SparkSession, sf: str) -> DataFrame:
    t = tasks(spark, sf).withColumnRenamed("task_id", "t")
    return attempts(spark, sf).join(F.broadcast(t), F.col("part") == F.col("t"), "left").select("run", "line", "shard", "price", "tier", "family", "archetype")


@query(SQL_LOADED + "SELECT a.run, a.line, a.shard, a.price, t.task_name FROM attempts a LEFT JOIN tasks t ON t.task_id = coalesce(CASE WHEN a.part < 50 THEN a.part END, a.task_id)")
def join_coalesced_key(spark: SparkSession, sf: str) -> DataFrame:
    key = F.coalesce(F.when(F.col("part") < 50, F.col("part")), F.col("task_id"))
    t = tasks(spark, sf).select(F.col("task_id").alias("t"), "task_name")
    return attempts(spark, sf).join(F.broadcast(t), key == F.col("t"), "left").select("run", "line", "shard", "price", "task_name")


@query(SQL_LOADED + "SELECT a.provider, a.task_id, a.success, t.size, t.length_px FROM attempts a JOIN tasks t USING (task_id) WHERE NOT a.has_error AND t.size > 5")
def join_inner_design(spark: SparkSession, sf: str) -> DataFrame:
    t = tasks(spark, sf).where(F.col("size") > 5).select("task_id", "size", "length_px")
    return attempts(spark, sf).where(~F.col("has_error")).join(F.broadcast(t), "task_id").select("provider", "task_id", "success", "size", "length_px")


@query(SQL_LOADED + "SELECT a.run, a.line, a.task_id, a.provider, t.tier FROM attempts a JOIN tasks t USING (task_id) WHERE NOT a.has_error AND NOT a.success AND t.tier <> 'easy'")
def join_semi_failures(spark: SparkSession, sf: str) -> DataFrame:
    t = tasks(spark, sf).where(F.col("tier") != "easy").select("task_id", "tier")
    failed = attempts(spark, sf).where(~F.col("has_error") & ~F.col("success"))
    return failed.join(F.broadcast(t.select("task_id")), "task_id", "left_semi").join(F.broadcast(t), "task_id").select("run", "line", "task_id", "provider", "tier")


@query(f"WITH {SQL_ATTEMPTS}, verdicts AS (SELECT provider, task_id, line, count(*) AS n FROM attempts WHERE success GROUP BY ALL) SELECT a.run, a.provider, a.task_id, a.line, v.n AS verdicts FROM attempts a LEFT JOIN verdicts v USING (provider, task_id, line)")
def join_three_key_left(spark: SparkSession, sf: str) -> DataFrame:
    a, key = attempts(spark, sf), ["provider", "task_id", "line"]
    verdicts = a.where("success").groupBy(*key).agg(F.count("*").alias("verdicts"))
    return a.join(verdicts, key, "left").select("run", *key, "verdicts")


@query(f"WITH {SQL_ATTEMPTS} SELECT provider, task_id, r.r::BIGINT AS radius, avg((latency_s >= r.r * 5)::INT) AS rate FROM attempts, (VALUES (1), (2), (3), (5), (8)) r(r) WHERE NOT has_error GROUP BY ALL")
def join_cross_radius(spark: SparkSession, sf: str) -> DataFrame:
    radii = spark.createDataFrame([(r,) for r in (1, 2, 3, 5, 8)], "radius long")
    a = attempts(spark, sf).where(~F.col("has_error")).select("provider", "task_id", "latency_s")
    return a.crossJoin(F.broadcast(radii)).groupBy("provider", "task_id", "radius").agg(F.avg((F.col("latency_s") >= F.col("radius") * 5).cast("int")).alias("rate"))


@query("WITH pool AS (SELECT p_partkey AS id FROM part WHERE p_size > 40) SELECT p_partkey AS task_id FROM part WHERE p_partkey IN (SELECT id FROM pool)")
def join_semi_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks of a pool; ids of the pool that no index has are an error."""
    index = table(spark, sf, "part").select(F.col("p_partkey").alias("task_id"))
    pool = table(spark, sf, "part").where(F.col("p_size") > 40).select(F.col("p_partkey").alias("task_id"))
    if not pool.join(index, "task_id", "left_anti").isEmpty():
        raise ValueError("the pool names unknown tasks")
    return index.join(pool, "task_id", "left_semi")


SQL_PRICES = "prices(provider, p_in, p_out) AS (VALUES (0, 1.25::DOUBLE, 10.0::DOUBLE), (1, 0.5, 3.0), (2, 5.0, 25.0), (3, NULL, NULL), (4, 2.0, 12.0))"


def prices(spark: SparkSession) -> DataFrame:
    """Price per million tokens, in and out; unknown prices are null, unlisted providers absent."""
    return spark.createDataFrame([(0, 1.25, 10.0), (1, 0.5, 3.0), (2, 5.0, 25.0), (3, None, None), (4, 2.0, 12.0)], "provider long, p_in double, p_out double")


@query(f"WITH {SQL_PRICES} SELECT provider::BIGINT AS provider, p_in, p_out, p_in IS NOT NULL AS priced FROM prices")
def dim_pricing(spark: SparkSession, sf: str) -> DataFrame:
    return prices(spark).withColumn("priced", F.col("p_in").isNotNull())


@query(f"""WITH {SQL_ATTEMPTS}, {SQL_PRICES} SELECT a.run, a.line, a.shard, a.price, p.p_in IS NOT NULL AS priced, round(a.tokens_in / 1e6::DOUBLE * p.p_in + a.tokens_out / 1e6::DOUBLE * p.p_out, 6) AS cost
    FROM attempts a LEFT JOIN prices p USING (provider)""")
def join_price_left(spark: SparkSession, sf: str) -> DataFrame:
    cost = F.col("tokens_in") / F.lit(1e6) * F.col("p_in") + F.col("tokens_out") / F.lit(1e6) * F.col("p_out")
    return attempts(spark, sf).join(F.broadcast(prices(spark)), "provider", "left").select("run", "line", "shard", "price", F.col("p_in").isNotNull().alias("priced"), F.round(cost, 6).alias("cost"))


@query(SQL_LOADED + """SELECT a.run, a.line, a.task_id, CASE WHEN a.success AND t.tier = 'hard' THEN 'win' WHEN a.evaluated AND a.latency_s > 40 THEN 'near_miss' ELSE coalesce(t.family, 'unknown') END AS branch
    FROM attempts a LEFT JOIN tasks t USING (task_id) WHERE NOT a.has_error""")
def join_branching(spark: SparkSession, sf: str) -> DataFrame:
    branch = F.when(F.col("success") & (F.col("tier") == "hard"), "win").when(F.col("evaluated") & (F.col("latency_s") > 40), "near_miss").otherwise(F.coalesce("family", F.lit("unknown")))
    return attempts(spark, sf).where(~F.col("has_error")).join(F.broadcast(tasks(spark, sf)), "task_id", "left").select("run", "line", "task_id", branch.alias("branch"))


@query(f"WITH {SQL_TASKS} SELECT family, archetype, count(*) AS slots FROM tasks WHERE (family, archetype) NOT IN (SELECT family, archetype FROM tasks WHERE size < 10) GROUP BY ALL")
def join_anti_composite(spark: SparkSession, sf: str) -> DataFrame:
    t = tasks(spark, sf)
    banned = t.where(F.col("size") < 10).select("family", "archetype").distinct()
    return t.join(banned, ["family", "archetype"], "left_anti").groupBy("family", "archetype").agg(F.count("*").alias("slots"))


@query(SQL_LOADED + """, base AS (SELECT provider, avg(success::INT) AS base FROM attempts WHERE NOT has_error AND task_id IN (SELECT task_id FROM attempts WHERE line = 7) GROUP BY 1),
    var AS (SELECT provider, avg(success::INT) AS variant FROM attempts WHERE NOT has_error AND line = 7 GROUP BY 1)
    SELECT provider, round(base, 6) AS base, round(variant, 6) AS variant, round(variant - base, 6) AS delta FROM base JOIN var USING (provider)""")
def ablation_delta(spark: SparkSession, sf: str) -> DataFrame:
    """A variant's rate against the main run's on the variant's own tasks."""
    a = attempts(spark, sf)
    variant = a.where(F.col("line") == 7)
    own = a.where(~F.col("has_error")).join(variant.select("task_id").distinct(), "task_id", "left_semi")
    rate = lambda rows, name: rows.groupBy("provider").agg(F.avg(F.col("success").cast("int")).alias(name))
    both = rate(own, "base").join(rate(variant.where(~F.col("has_error")), "variant"), "provider")
    return both.select("provider", F.round("base", 6).alias("base"), F.round("variant", 6).alias("variant"), F.round(F.col("variant") - F.col("base"), 6).alias("delta"))


# projections and filters


@query(f"WITH {SQL_ATTEMPTS} SELECT provider, task_id, run, line, ts, latency_s, success FROM attempts")
def proj_keep(spark: SparkSession, sf: str) -> DataFrame:
    return attempts(spark, sf).select("provider", "task_id", "run", "line", "ts", "latency_s", "success")


@query(f"WITH {SQL_ATTEMPTS} SELECT provider::VARCHAR || ':' || task_id::VARCHAR || ':' || line::VARCHAR AS key, count(*) AS n FROM attempts GROUP BY 1")
def proj_composite_key(spark: SparkSession, sf: str) -> DataFrame:
    key = attempts(spark, sf).groupBy(F.struct("provider", "task_id", "line").alias("k")).agg(F.count("*").alias("n"))
    return key.select(F.concat_ws(":", "k.provider", "k.task_id", "k.line").alias("key"), "n")


@query(SQL_LOADED + "SELECT run, line, provider, tier, round(latency_s / 50, 3) AS rp FROM attempts a JOIN tasks t USING (task_id) WHERE NOT has_error")
def proj_viewer_summary(spark: SparkSession, sf: str) -> DataFrame:
    return attempts(spark, sf).where(~F.col("has_error")).join(F.broadcast(tasks(spark, sf)), "task_id").select("run", "line", "provider", "tier", F.round(F.col("latency_s") / 50, 3).alias("rp"))


@query(f"WITH {SQL_ATTEMPTS} SELECT provider, task_id, run, line, success FROM attempts WHERE NOT has_error")
def flt_scored(spark: SparkSession, sf: str) -> DataFrame:
    return attempts(spark, sf).where(~F.col("has_error")).select("provider", "task_id", "run", "line", "success")


@query(f"WITH {SQL_ATTEMPTS} SELECT provider, count(*) FILTER (evaluated) AS evaluated, count(*) FILTER (coalesce(CASE WHEN evaluated THEN success END, false)) AS succeeded FROM attempts GROUP BY 1")
def flt_null_safe_bool(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.coalesce(F.when(F.col("evaluated"), F.col("success")), F.lit(False))
    return attempts(spark, sf).groupBy("provider").agg(F.count_if("evaluated").alias("evaluated"), F.count_if(outcome).alias("succeeded"))


@query("SELECT s_suppkey AS provider, CASE WHEN s_nationkey % 3 = 0 THEN 'explicit' ELSE 'enabled' END AS why FROM supplier WHERE CASE WHEN s_nationkey % 3 = 0 THEN s_acctbal > 0 ELSE s_acctbal > 5000 END")
def flt_case_select(spark: SparkSession, sf: str) -> DataFrame:
    explicit, balance = F.col("s_nationkey") % 3 == 0, F.col("s_acctbal")
    return table(spark, sf, "supplier").where(F.when(explicit, balance > 0).otherwise(balance > 5000)).select(F.col("s_suppkey").alias("provider"), F.when(explicit, "explicit").otherwise("enabled").alias("why"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE 400 + user_id % 30 END AS status FROM events WHERE event_type = 'error' OR 400 + user_id % 30 IN (408, 409, 425, 429)")
def flt_in_or_null(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("user_id") % 30 + 400).alias("status"))
    return rows.where(F.col("status").isNull() | F.col("status").isin(408, 409, 425, 429))


@query("SELECT p_partkey AS task_id, p_name AS task_name FROM part WHERE p_type IN ('PROMO', 'SMALL')")
def flt_in_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(F.col("p_type").isin("PROMO", "SMALL")).select(F.col("p_partkey").alias("task_id"), F.col("p_name").alias("task_name"))


@query(SQL_LOADED + "SELECT a.run, a.line, a.task_id FROM attempts a JOIN tasks t USING (task_id) WHERE a.provider = 3 AND t.tier = 'hard' AND a.success")
def flt_optional_conj(spark: SparkSession, sf: str) -> DataFrame:
    """A conjunction of the predicates that are set; those left out match everything."""
    wanted = {"provider": 3, "tier": "hard", "family": None, "success": True, "archetype": None}
    rows = attempts(spark, sf).join(F.broadcast(tasks(spark, sf)), "task_id")
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    return rows.select("run", "line", "task_id")


@query("SELECT o_orderkey AS run, o_custkey AS customer, o_totalprice AS price FROM orders WHERE o_orderkey = 42")
def flt_point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where(F.col("o_orderkey") == 42).select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("price"))


@query(SQL_LOADED + "SELECT a.run, a.line, a.latency_s FROM attempts a JOIN tasks t USING (task_id) WHERE NOT a.has_error AND a.evaluated AND a.latency_s >= 6 AND t.size BETWEEN 2 AND 49")
def flt_chain(spark: SparkSession, sf: str) -> DataFrame:
    t = tasks(spark, sf).where(F.col("size").between(2, 49)).select("task_id")
    return attempts(spark, sf).where(~F.col("has_error") & F.col("evaluated") & (F.col("latency_s") >= 6)).join(F.broadcast(t), "task_id", "left_semi").select("run", "line", "latency_s")


@query("SELECT p_partkey AS task_id, coalesce(CASE WHEN p_size <= 16 THEN 'easy' WHEN p_size <= 33 THEN 'medium' WHEN p_size < 45 THEN 'hard' END, 'unknown') AS tier FROM part")
def dim_tier(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("task_id"), F.coalesce(F.when(size <= 16, "easy").when(size <= 33, "medium").when(size < 45, "hard"), F.lit("unknown")).alias("tier"))


# set operations


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("task_id"), "p_size")
    return p.where(F.col("p_size") < 30).select("task_id"), p.where(F.col("p_size") > 20).select("task_id")


@query("SELECT p_partkey AS task_id FROM part WHERE p_size < 30 INTERSECT SELECT p_partkey FROM part WHERE p_size > 20")
def set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _halves(spark, sf)
    return a.intersect(b)


@query("SELECT p_partkey AS task_id FROM part WHERE p_size < 30 EXCEPT SELECT p_partkey FROM part WHERE p_size > 20")
def set_except(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _halves(spark, sf)
    return a.subtract(b)


@query("SELECT p_partkey AS task_id FROM part WHERE p_size < 30 UNION ALL SELECT p_partkey FROM part WHERE p_size > 20")
def set_union_all(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _halves(spark, sf)
    return a.unionByName(b)


@query("SELECT p_partkey AS task_id FROM part WHERE p_size < 30 UNION SELECT p_partkey FROM part WHERE p_size > 20")
def set_union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _halves(spark, sf)
    return a.unionByName(b).distinct()


@query("""WITH a AS (SELECT p_partkey AS id FROM part WHERE p_size < 30), b AS (SELECT p_partkey AS id FROM part WHERE p_size > 20), l AS (SELECT count(*) AS n FROM (FROM a EXCEPT ALL FROM b)), r AS (SELECT count(*) AS n FROM (FROM b EXCEPT ALL FROM a))
    SELECT l.n AS only_left, r.n AS only_right, l.n = 0 AND r.n = 0 AS equal, l.n = 0 AS subset FROM l, r""")
def set_equality(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _halves(spark, sf)
    left, right = a.exceptAll(b).agg(F.count("*").alias("only_left")), b.exceptAll(a).agg(F.count("*").alias("only_right"))
    return left.crossJoin(right).select("only_left", "only_right", ((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("equal"), (F.col("only_left") == 0).alias("subset"))


@query("SELECT p_name AS hash, count(DISTINCT p_size % 3) AS splits FROM part GROUP BY 1 HAVING count(DISTINCT p_size % 3) > 1")
def agg_leakage(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes that occur in more than one split."""
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("hash")).agg(F.countDistinct(F.col("p_size") % 3).alias("splits")).where(F.col("splits") > 1)


@query("WITH h AS (SELECT doc_id, md5(text) AS hash FROM documents) SELECT min(doc_id) AS doc_id, hash FROM h WHERE hash NOT IN (SELECT md5(text) FROM benchmark) GROUP BY hash")
def dedup_hash(spark: SparkSession, sf: str) -> DataFrame:
    """The first document of each hash that a registry doesn't hold."""
    registry = table(spark, sf, "benchmark").select(F.md5(F.col("text").cast("binary")).alias("hash"))
    first = table(spark, sf, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("hash")).agg(F.min("doc_id").alias("doc_id"))
    return first.join(registry, "hash", "left_anti").select("doc_id", "hash")


@query("SELECT p_partkey AS id FROM part ORDER BY md5('7|' || p_partkey), p_partkey LIMIT 25")
def sample_hash(spark: SparkSession, sf: str) -> DataFrame:
    """A seeded sample without replacement: the smallest hashes, kept per partition before they meet."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id")).orderBy(F.md5(F.concat(F.lit("7|"), F.col("id").cast("string")).cast("binary")), "id").limit(25)


# sorts and limits


@query(f"WITH {SQL_ATTEMPTS} SELECT coalesce(provider, 0) AS provider, coalesce(task_id, 0) AS task_id, coalesce(line, 0) AS line, run FROM attempts ORDER BY 1, 2, 3, 4")
def sort_null_default(spark: SparkSession, sf: str) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return attempts(spark, sf).select(zero("provider"), zero("task_id"), zero("line"), "run").orderBy("provider", "task_id", "line", "run")


@query(f"WITH {SQL_ATTEMPTS} SELECT run, line, shard, part, coalesce(latency_s, 0) AS latency_s FROM attempts ORDER BY latency_s DESC, run, line, shard, part, price LIMIT 400")
def topk_400(spark: SparkSession, sf: str) -> DataFrame:
    rows = attempts(spark, sf).withColumn("latency_s", F.coalesce("latency_s", F.lit(0.0)))
    return rows.orderBy(F.desc("latency_s"), "run", "line", "shard", "part", "price").limit(400).select("run", "line", "shard", "part", "latency_s")


@query(f"WITH {SQL_CONFLICTS} SELECT * FROM conflicts ORDER BY run, line, arrival LIMIT 5")
def topk_5(spark: SparkSession, sf: str) -> DataFrame:
    return merge_conflicts(spark, sf).orderBy("run", "line", "arrival").limit(5)


@query(f"""WITH RECURSIVE {SQL_ATTEMPTS}, best AS (SELECT provider, task_id, max(latency_s) AS score FROM attempts WHERE success GROUP BY ALL), picks(k, task, score, used) AS (
    SELECT 0::BIGINT, NULL::BIGINT, NULL::DOUBLE, []::BIGINT[] UNION ALL
    SELECT k + 1, b.task_id, b.score, list_append(used, b.task_id) FROM picks, LATERAL (SELECT task_id, score FROM best WHERE provider = k AND NOT list_contains(used, task_id) ORDER BY score DESC, task_id LIMIT 1) b WHERE k < 7)
    SELECT k - 1 AS provider, task AS task_id, score FROM picks WHERE k > 0""")
def topk_exclusive(spark: SparkSession, sf: str) -> DataFrame:
    """The best task of each provider in turn, no task twice: of PROVIDERS candidates each, one must be free."""
    best = attempts(spark, sf).where("success").groupBy("provider", "task_id").agg(F.max("latency_s").alias("score"))
    rank = F.row_number().over(Window.partitionBy("provider").orderBy(F.desc("score"), "task_id"))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= PROVIDERS).groupBy("provider").agg(F.array_sort(F.collect_list(F.struct("rank", "task_id", "score"))).alias("c"))
    ordered = ranked.agg(F.array_sort(F.collect_list(F.struct("provider", "c"))).alias("legs"))  # PROVIDERS rows of PROVIDERS candidates
    pick = "array<struct<provider:bigint,task_id:bigint,score:double>>"
    taken = F.aggregate(
        "legs", F.array().cast(pick),
        lambda acc, leg: F.concat(acc, F.transform(F.slice(F.filter(leg["c"], lambda c: ~F.exists(acc, lambda a: a["task_id"] == c["task_id"])), 1, 1), lambda c: F.struct(leg["provider"].alias("provider"), c["task_id"].alias("task_id"), c["score"].alias("score")))),
    )
    return ordered.select(F.explode(taken).alias("p")).select("p.*")
