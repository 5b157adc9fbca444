"""Group statistics: leaderboards, taxonomies, economics, fingerprints, windows and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import estimators
from ..functions.estimators import binomial_two_sided, hash_index
from ..operators.scan import nearest_ranks
from .registry import query
from .relational import SQL_LOADED, SQL_PRICES, prices
from .views import PROVIDERS, SQL_ATTEMPTS, SQL_TASKS, SQL_TRIALS, attempts, table, tasks, trials

A = f"WITH {SQL_ATTEMPTS}"
#: Per provider and task: n scored attempts, c successes.
SQL_CELLS = f"{SQL_ATTEMPTS}, cells AS (SELECT provider, task_id, count(*) AS n, count(*) FILTER (success) AS c, avg(success::INT) AS rate FROM attempts WHERE NOT has_error GROUP BY ALL)"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return attempts(spark, sf).where(~F.col("has_error"))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Success per provider and task; at most providers x tasks rows."""
    return scored(spark, sf).groupBy("provider", "task_id").agg(F.count("*").alias("n"), F.count_if("success").alias("c"), F.avg(F.col("success").cast("int")).alias("rate"))


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


@query(A + " SELECT provider, task_id, success AS outcome, count(*) AS n, round(avg(tokens_out), 6) AS tokens FROM attempts WHERE NOT has_error GROUP BY ALL")
def agg_by_task(spark: SparkSession, sf: str) -> DataFrame:
    """The values of a key of all scored rows by provider and task, each with its number of rows: no list grows with the attempts."""
    return by_key(scored(spark, sf), F.col("success"), F.avg("tokens_out").alias("tokens")).withColumn("tokens", r6("tokens"))


def by_key(rows: DataFrame, key: Column, *more: Column) -> DataFrame:
    """provider, task_id, outcome (any key that a caller gives as an expression on a row), n, and further aggregates."""
    return rows.groupBy("provider", "task_id", key.alias("outcome")).agg(F.count("*").alias("n"), *more)


@query(f"WITH {SQL_CELLS} SELECT provider, task_id, round(rate, 6) AS rate FROM cells")
def agg_task_means(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).select("provider", "task_id", r6("rate").alias("rate"))


SQL_PASS8 = "1 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(0, 8), lambda i: (n - c - i)::DOUBLE / (n - i))), lambda a, b: a * b)"


@query(f"WITH {SQL_CELLS} SELECT provider, task_id, n, c, round(CASE WHEN n - c < 8 THEN 1 ELSE {SQL_PASS8} END, 6) AS pass8 FROM cells WHERE n >= 8")
def pass_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).where(F.col("n") >= 8).select("provider", "task_id", "n", "c", r6(estimators.pass_at_k(F.col("n"), F.col("c"), 8)).alias("pass8"))


@query(f"""WITH {SQL_CELLS} SELECT provider, round(100 * avg(rate), 1) AS pass1, round(100 * avg(CASE WHEN n >= 8 THEN CASE WHEN n - c < 8 THEN 1 ELSE {SQL_PASS8} END END), 1) AS pass8, sum(n)::BIGINT AS attempts, count(*) AS tasks
    FROM cells GROUP BY provider ORDER BY pass1 DESC, provider""")
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """Macro pass@1 (mean over tasks of their rates) and pass@8 over tasks with eight attempts, best first."""
    eight = F.when(F.col("n") >= 8, estimators.pass_at_k(F.greatest("n", F.lit(8)), F.col("c"), 8))
    board = cells(spark, sf).groupBy("provider").agg(F.round(100 * F.avg("rate"), 1).alias("pass1"), F.round(100 * F.avg(eight), 1).alias("pass8"), F.sum("n").alias("attempts"), F.count("*").alias("tasks"))
    return board.orderBy(F.desc("pass1"), "provider")


@query(f"WITH {SQL_CELLS} SELECT provider, count(*) AS tasks FROM cells WHERE n >= 8 GROUP BY 1")
def agg_having(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).where(F.col("n") >= 8).groupBy("provider").agg(F.count("*").alias("tasks"))


@query(f"WITH {SQL_ATTEMPTS}, {SQL_TRIALS}, eight AS (SELECT provider, task_id, count(*) FILTER (success) AS c FROM trials WHERE NOT has_error AND trial < 8 GROUP BY ALL) SELECT provider, round(avg((c BETWEEN 1 AND 7)::INT), 6) AS flaky FROM eight GROUP BY 1")
def flakiness(spark: SparkSession, sf: str) -> DataFrame:
    eight = trials(attempts(spark, sf)).where(~F.col("has_error") & (F.col("trial") < 8)).groupBy("provider", "task_id").agg(F.count_if("success").alias("c"))
    return eight.groupBy("provider").agg(r6(F.avg(F.col("c").between(1, 7).cast("int"))).alias("flaky"))


@query(f"""WITH {SQL_ATTEMPTS}, {SQL_PRICES}, s AS (SELECT provider, count(*) AS attempts, count(*) FILTER (success) AS passes, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, avg(latency_s) AS latency FROM attempts WHERE NOT has_error GROUP BY 1),
    c AS (SELECT s.*, tokens_in / 1e6::DOUBLE * p_in + tokens_out / 1e6::DOUBLE * p_out AS cost FROM s LEFT JOIN prices USING (provider))
    SELECT provider, attempts, passes, tokens_in, tokens_out, round(latency, 2) AS latency, round(cost, 4) AS cost, round(CASE WHEN cost <> 0 AND passes > 0 THEN cost / passes END, 4) AS cost_per_solve FROM c""")
def economics(spark: SparkSession, sf: str) -> DataFrame:
    legs = scored(spark, sf).groupBy("provider").agg(F.count("*").alias("attempts"), F.count_if("success").alias("passes"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.avg("latency_s"), 2).alias("latency"))
    cost = F.col("tokens_in") / F.lit(1e6) * F.col("p_in") + F.col("tokens_out") / F.lit(1e6) * F.col("p_out")
    priced = legs.join(F.broadcast(prices(spark)), "provider", "left").withColumn("cost", cost)
    per = F.when((F.col("cost") != 0) & (F.col("passes") > 0), F.col("cost") / F.col("passes"))
    return priced.select("provider", "attempts", "passes", "tokens_in", "tokens_out", "latency", F.round("cost", 4).alias("cost"), F.round(per, 4).alias("cost_per_solve"))


@query(A + """ SELECT provider, count(*) AS requested, count(*) FILTER (NOT has_error) AS completed, count(*) FILTER (success) AS successes, round(count(*) FILTER (success)::DOUBLE / count(*) FILTER (NOT has_error), 4) AS pass_rate,
    round(avg(CASE WHEN success THEN latency_s END), 4) AS efficiency, round(avg(latency_s) FILTER (NOT has_error), 2) AS latency FROM attempts GROUP BY 1""")
def agg_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    ok = ~F.col("has_error")
    return attempts(spark, sf).groupBy("provider").agg(F.count("*").alias("requested"), F.count_if(ok).alias("completed"), F.count_if("success").alias("successes"), F.round(F.try_divide(F.count_if("success").cast("double"), F.count_if(ok)), 4).alias("pass_rate"), F.round(F.avg(F.when(F.col("success"), F.col("latency_s"))), 4).alias("efficiency"), F.round(F.avg(F.when(ok, F.col("latency_s"))), 2).alias("latency"))


@query("SELECT count(*) AS rows, count(*) FILTER (n_chars > 2000) AS with_raw, count(*) FILTER (lang = 'en') AS with_reasoning, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, count(DISTINCT source) AS sources FROM documents")
def agg_census(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(F.count("*").alias("rows"), F.count_if(F.col("n_chars") > 2000).alias("with_raw"), F.count_if(F.col("lang") == "en").alias("with_reasoning"), F.concat_ws(",", F.sort_array(F.collect_set("lang"))).alias("langs"), F.countDistinct("source").alias("sources"))


@query("SELECT source, count(*) AS runs, sum(n_chars)::BIGINT AS total, count(*) FILTER (n_chars = 0) AS empty, string_agg(CASE WHEN n_chars < 12 THEN doc_id::VARCHAR END, ',' ORDER BY CASE WHEN n_chars < 12 THEN doc_id END) AS tiny FROM documents GROUP BY 1")
def agg_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Roll-up per source, with the list of runs too small to hold anything (a report of exceptions)."""
    tiny = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n_chars") < 12, F.col("doc_id")))), lambda i: i.cast("string")), ",")
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("runs"), F.sum("n_chars").alias("total"), F.count_if(F.col("n_chars") == 0).alias("empty"), F.nullif(tiny, F.lit("")).alias("tiny"))


MODE = "CASE WHEN has_error THEN 'transport' WHEN success THEN 'pass' WHEN NOT evaluated THEN 'no_tool_call' WHEN latency_s < 10 THEN 'wrong_start' WHEN latency_s < 40 THEN 'collision' ELSE 'stopped_short' END"


def mode() -> Column:
    latency = F.col("latency_s")
    return F.when(F.col("has_error"), "transport").when(F.col("success"), "pass").when(~F.col("evaluated"), "no_tool_call").when(latency < 10, "wrong_start").when(latency < 40, "collision").otherwise("stopped_short")


@query(A + f" SELECT provider, {MODE} AS mode, count(*) AS n FROM attempts GROUP BY ALL")
def agg_mode_by_provider(spark: SparkSession, sf: str) -> DataFrame:
    return attempts(spark, sf).groupBy("provider", mode().alias("mode")).agg(F.count("*").alias("n"))


SQL_LEGS = ", ".join(f"count(*) FILTER (provider = {p}) AS p{p}" for p in range(PROVIDERS))


@query(A + f", m AS (SELECT {MODE} AS mode, provider FROM attempts) SELECT mode, {SQL_LEGS}, count(*) AS n FROM m GROUP BY mode ORDER BY n DESC, mode")
def agg_mode_pivot(spark: SparkSession, sf: str) -> DataFrame:
    m = attempts(spark, sf).select(mode().alias("mode"), "provider")
    wide = m.groupBy("mode").agg(*[F.count_if(F.col("provider") == p).alias(f"p{p}") for p in range(PROVIDERS)], F.count("*").alias("n"))
    return wide.orderBy(F.desc("n"), "mode")


@query(A + f", m AS (SELECT provider, {MODE} AS mode, count(*) AS n FROM attempts WHERE NOT has_error GROUP BY ALL) SELECT provider, mode, n, round(n / sum(n) OVER (PARTITION BY provider), 6) AS share FROM m")
def taxonomy_share(spark: SparkSession, sf: str) -> DataFrame:
    m = scored(spark, sf).groupBy("provider", mode().alias("mode")).agg(F.count("*").alias("n"))
    return m.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("provider"))))


@query(A + f" SELECT success, evaluated, has_error, {MODE} AS category, count(*) AS n FROM attempts GROUP BY ALL")
def failure_category(spark: SparkSession, sf: str) -> DataFrame:
    return attempts(spark, sf).groupBy("success", "evaluated", "has_error", mode().alias("category")).agg(F.count("*").alias("n"))


@query(SQL_LOADED + "SELECT provider, tier, round(avg(success::INT), 6) AS rate, count(*) AS n FROM attempts JOIN tasks USING (task_id) WHERE NOT has_error GROUP BY ALL")
def tier_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Micro average over attempts; grouped by task before the dimension is joined, so the join sees few rows."""
    few = scored(spark, sf).groupBy("provider", "task_id").agg(F.count("*").alias("n"), F.count_if("success").alias("c"))
    return few.join(F.broadcast(tasks(spark, sf)), "task_id").groupBy("provider", "tier").agg(r6(F.sum("c") / F.sum("n")).alias("rate"), F.sum("n").alias("n"))


@query(SQL_LOADED + """, j AS (SELECT * FROM attempts JOIN tasks USING (task_id) WHERE NOT has_error)
    SELECT tier, family, archetype, count(*) AS n, round(avg(success::INT), 6) AS rate FROM j GROUP BY GROUPING SETS ((), (tier), (family), (archetype))""")
def slices_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    few = scored(spark, sf).groupBy("task_id").agg(F.count("*").alias("n"), F.count_if("success").alias("c"))
    few.join(F.broadcast(tasks(spark, sf)), "task_id").createOrReplaceTempView("sliced_tasks")
    return spark.sql("SELECT tier, family, archetype, sum(n) AS n, round(sum(c) / sum(n), 6) AS rate FROM sliced_tasks GROUP BY GROUPING SETS ((), (tier), (family), (archetype))")


@query("SELECT p_brand AS name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, name")
def agg_count_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name")


@query("SELECT DISTINCT p_type AS family, p_size % 5 AS mode FROM part")
def agg_distinct_menu(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_type").alias("family"), (F.col("p_size") % 5).alias("mode")).distinct()


@query("SELECT split_part(url, '/', 3) AS prefix, sum(strlen(html))::BIGINT AS bytes FROM pages GROUP BY 1 ORDER BY bytes DESC, prefix")
def agg_bytes_by_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").groupBy(F.split_part("url", F.lit("/"), F.lit(3)).alias("prefix")).agg(F.sum(F.octet_length("html").cast("long")).alias("bytes")).orderBy(F.desc("bytes"), "prefix")


@query("SELECT p_type AS family, count(*) AS size, count(*) FILTER (p_size <= 16) AS easy, count(*) FILTER (p_size BETWEEN 17 AND 33) AS medium, count(*) FILTER (p_size > 33) AS hard, count(DISTINCT p_brand) AS archetypes, min(p_retailprice) AS low, round(median(p_retailprice), 6) AS mid, max(p_retailprice) AS high, round(avg(p_size), 2) AS rejections FROM part GROUP BY 1")
def split_stats(spark: SparkSession, sf: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("family")).agg(F.count("*").alias("size"), F.count_if(size <= 16).alias("easy"), F.count_if(size.between(17, 33)).alias("medium"), F.count_if(size > 33).alias("hard"), F.countDistinct("p_brand").alias("archetypes"), F.min(price).alias("low"), r6(F.median(price)).alias("mid"), F.max(price).alias("high"), F.round(F.avg(size), 2).alias("rejections"))


@query(f"WITH {SQL_TASKS}, g AS (SELECT family, tier, count(*) AS n, count(DISTINCT archetype) AS styles FROM tasks GROUP BY ALL) SELECT family, sum(n)::BIGINT AS tasks, min(styles) AS least FROM g GROUP BY family HAVING bool_and(styles >= 1) AND count(*) = 3")
def agg_complete_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Families whose every tier has a style: all or nothing."""
    g = tasks(spark, sf).groupBy("family", "tier").agg(F.count("*").alias("n"), F.countDistinct("archetype").alias("styles"))
    return g.groupBy("family").agg(F.sum("n").alias("tasks"), F.min("styles").alias("least"), F.bool_and(F.col("styles") >= 1).alias("whole"), F.count("*").alias("tiers")).where(F.col("whole") & (F.col("tiers") == 3)).select("family", "tasks", "least")


@query("""WITH t AS (SELECT conv_id, turn, role, length(text) % 7 = 0 AND role = 'assistant' AS success, length(text) AS progress FROM conversations)
    SELECT conv_id, count(*) AS turns, bool_or(success) AS solved, min(CASE WHEN success THEN turn END) AS first_success, string_agg(progress::VARCHAR, ',' ORDER BY turn) AS progress, max_by(role, turn) AS last_role FROM t GROUP BY 1""")
def episode_summary(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role", ((F.length("text") % 7 == 0) & (F.col("role") == "assistant")).alias("success"), F.length("text").alias("progress"))
    trail = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "progress"))), lambda x: x["progress"].cast("string")), ",")
    return t.groupBy("conv_id").agg(F.count("*").alias("turns"), F.bool_or("success").alias("solved"), F.min(F.when(F.col("success"), F.col("turn"))).alias("first_success"), trail.alias("progress"), F.max_by("role", "turn").alias("last_role"))


@query("""WITH t AS (SELECT conv_id, turn, length(text) % 3 = 0 AND role = 'assistant' AS success FROM conversations), e AS (SELECT conv_id, bool_or(success AND turn <= 1) AS first, bool_or(success) AS ever FROM t GROUP BY 1),
    b AS (SELECT avg((length(text) % 3 = 0)::INT) AS blind FROM conversations WHERE role = 'assistant' AND turn > 1)
    SELECT count(*) AS failed_first, count(*) FILTER (ever) AS rescued, round(count(*) FILTER (ever)::DOUBLE / count(*), 6) AS rescue_rate, round(any_value(blind), 6) AS blind_rate FROM e, b WHERE NOT first""")
def rescue_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Of the episodes that failed at first, the share that a later turn solved, next to a blind retry."""
    good = (F.length("text") % 3 == 0) & (F.col("role") == "assistant")
    rows = table(spark, sf, "conversations").withColumn("success", good)
    ends = rows.groupBy("conv_id").agg(F.bool_or(F.col("success") & (F.col("turn") <= 1)).alias("first"), F.bool_or("success").alias("ever")).where(~F.col("first"))
    rescued = ends.agg(F.count("*").alias("failed_first"), F.count_if("ever").alias("rescued"))
    blind = rows.where((F.col("role") == "assistant") & (F.col("turn") > 1)).agg(F.avg(F.col("success").cast("int")).alias("blind"))
    return rescued.crossJoin(blind).select("failed_first", "rescued", r6(F.try_divide(F.col("rescued").cast("double"), "failed_first")).alias("rescue_rate"), r6("blind").alias("blind_rate"))


# fingerprints and percentiles


@query("SELECT l_suppkey % 7 AS provider, least(length(rtrim(split_part(printf('%.10f', l_discount * l_tax), '.', 2), '0')), 6)::BIGINT AS places, count(*) AS n FROM lineitem GROUP BY ALL")
def decimal_places(spark: SparkSession, sf: str) -> DataFrame:
    digits = F.rtrim(F.split_part(F.format_string("%.10f", F.col("l_discount") * F.col("l_tax")), F.lit("."), F.lit(2)), F.lit("0"))
    return table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("provider"), F.least(F.length(digits), F.lit(6)).cast("long").alias("places")).agg(F.count("*").alias("n"))


@query("SELECT l_suppkey % 7 AS provider, g.g::DOUBLE AS grid, round(avg((abs(v / g.g - round_even(v / g.g, 0)) < 1e-6)::INT), 6) AS share FROM (SELECT l_suppkey, l_extendedprice / 10000.0::DOUBLE AS v FROM lineitem), (VALUES (0.5::DOUBLE), (0.25), (0.1), (0.05), (0.01)) g(g) GROUP BY ALL")
def grid_snap(spark: SparkSession, sf: str) -> DataFrame:
    grids = spark.createDataFrame([(g,) for g in (0.5, 0.25, 0.1, 0.05, 0.01)], "grid double")
    cell = F.col("v") / F.col("grid")
    rows = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 7).alias("provider"), (F.col("l_extendedprice") / 10000).alias("v")).crossJoin(F.broadcast(grids))
    return rows.groupBy("provider", "grid").agg(r6(F.avg((F.abs(cell - F.rint(cell)) < 1e-6).cast("int"))).alias("share"))


@query("WITH p AS (SELECT vec_id, label, 400 * sqrt(pow(embedding[1]::DOUBLE, 2) + pow(embedding[2]::DOUBLE, 2)) AS error FROM embeddings) SELECT label::BIGINT AS provider, count(*) AS n, round(avg(error), 4) AS mean_px, round(max(error), 4) AS worst_px FROM p GROUP BY 1")
def localization_error(spark: SparkSession, sf: str) -> DataFrame:
    """Pixel distance of the first point from the start."""
    error = F.hypot(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")) * 400
    return table(spark, sf, "embeddings").groupBy(F.col("label").cast("long").alias("provider")).agg(F.count("*").alias("n"), F.round(F.avg(error), 4).alias("mean_px"), F.round(F.max(error), 4).alias("worst_px"))


@query("""WITH r AS (SELECT l_suppkey % 7 AS provider, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey % 7 ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey % 7) AS n FROM lineitem)
    SELECT provider, p.p::BIGINT AS percent, v AS value FROM r, (VALUES (50), (75), (90), (95)) p(p) WHERE i = least(n - 1, round_even(p.p / 100.0::DOUBLE * (n - 1), 0))""")
def nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Exact nearest-rank percentiles: counts per value, dealt by ranges of provider and value."""
    values = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 7).alias("provider"), F.col("l_extendedprice").alias("price"))
    return nearest_ranks(values, ["provider"], "price", (50, 75, 90, 95)).withColumn("percent", F.col("percent").cast("long"))


@query(A + " SELECT r.r::BIGINT AS radius, provider, round(avg((latency_s >= r.r * 5 AND success)::INT), 6) AS rate FROM attempts, (VALUES (1), (2), (3), (5), (8)) r(r) WHERE NOT has_error GROUP BY ALL")
def tolerance_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Rates at every radius in one pass: a conditional count each instead of a copy of the rows."""
    at = {r: F.avg((F.col("success") & (F.col("latency_s") >= r * 5)).cast("int")) for r in (1, 2, 3, 5, 8)}
    wide = scored(spark, sf).groupBy("provider").agg(F.array(*[F.struct(F.lit(r).cast("long").alias("radius"), r6(c).alias("rate")) for r, c in at.items()]).alias("c"))
    return wide.select("provider", F.inline("c"))


SQL_CURVES = A + """, curves AS (SELECT r.r::BIGINT AS radius, provider, avg((latency_s >= r.r * 5 AND success)::INT) AS rate FROM attempts, (VALUES (1), (2), (3), (5), (8)) r(r) WHERE NOT has_error GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY radius ORDER BY round(rate, 6) DESC, provider) AS rank FROM curves)"""


@query(SQL_CURVES + """ SELECT a.radius, bool_and(a.rank = b.rank) AS stable, (SELECT count(*) FROM ranked x JOIN ranked y ON x.radius = y.radius AND x.rank < y.rank JOIN ranked bx ON bx.radius = 3 AND bx.provider = x.provider JOIN ranked by_ ON by_.radius = 3 AND by_.provider = y.provider WHERE x.radius = a.radius AND bx.rank > by_.rank) AS inversions
    FROM ranked a JOIN ranked b ON b.radius = 3 AND b.provider = a.provider GROUP BY a.radius""")
def rank_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Rankings at each radius against those at 3 px; ties by provider."""
    rank = F.row_number().over(Window.partitionBy("radius").orderBy(F.desc("rate"), "provider"))
    ranked = tolerance_curve(spark, sf).withColumn("rank", rank)
    base = ranked.where(F.col("radius") == 3).select("provider", F.col("rank").alias("base"))
    both = ranked.join(F.broadcast(base), "provider")  # PROVIDERS rows
    order = F.array_sort(F.collect_list(F.struct("rank", "base")))
    later = lambda o: F.aggregate(F.transform(o, lambda x, i: F.size(F.filter(o, lambda y: (y["rank"] > x["rank"]) & (y["base"] < x["base"])))), F.lit(0), lambda a, b: a + b)
    return both.groupBy("radius").agg(F.bool_and(F.col("rank") == F.col("base")).alias("stable"), order.alias("o")).select("radius", "stable", later(F.col("o")).cast("long").alias("inversions"))


@query(f"WITH {SQL_CELLS}, b AS (SELECT provider, avg(rate) AS pass1 FROM cells GROUP BY 1) SELECT provider, lead(provider) OVER (ORDER BY round(pass1, 9) DESC, provider) AS below, round(pass1 - lead(pass1) OVER (ORDER BY round(pass1, 9) DESC, provider), 6) AS gap FROM b")
def adjacent_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each provider and the next one below; the window has a row per provider."""
    board = cells(spark, sf).groupBy("provider").agg(F.avg("rate").alias("pass1"))
    w = Window.orderBy(F.desc(F.round("pass1", 9)), "provider")
    return board.select("provider", F.lead("provider").over(w).alias("below"), r6(F.col("pass1") - F.lead("pass1").over(w)).alias("gap"))


@query(f"""WITH {SQL_CELLS}, {SQL_TASKS}, q AS (SELECT task_id, length_px, ntile(5) OVER (ORDER BY length_px, task_id) AS quintile FROM tasks)
    SELECT provider, quintile::BIGINT AS quintile, round(median(length_px), 6) AS mid, round(avg(rate), 6) AS rate FROM cells JOIN q USING (task_id) GROUP BY ALL""")
def quintile_response(spark: SparkSession, sf: str) -> DataFrame:
    """Response by fifths of a predictor; the window ranks the bounded task dimension."""
    q = tasks(spark, sf).select("task_id", "length_px", F.ntile(5).over(Window.orderBy("length_px", "task_id")).cast("long").alias("quintile"))
    return cells(spark, sf).join(F.broadcast(q), "task_id").groupBy("provider", "quintile").agg(r6(F.median("length_px")).alias("mid"), r6(F.avg("rate")).alias("rate"))


@query(f"WITH {SQL_TASKS} SELECT task_id, round((size - avg(size) OVER ()) / stddev_pop(size) OVER (), 6) AS z_size, round((length_px - avg(length_px) OVER ()) / stddev_pop(length_px) OVER (), 6) AS z_length FROM tasks")
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    """Population z-scores from one-row moments, so the rows themselves never meet in one task."""
    t = tasks(spark, sf)
    names = {"size": "z_size", "length_px": "z_length"}
    moments = t.agg(*[f(c).alias(f"{n}_{c}") for c in names for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    return t.crossJoin(F.broadcast(moments)).select("task_id", *[r6((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(z) for c, z in names.items()])


SQL_GRID = f"{SQL_ATTEMPTS}, {SQL_TASKS}, grid AS (SELECT task_id % 20 AS topology, line AS style, avg(success::INT) AS rate FROM attempts WHERE NOT has_error GROUP BY ALL)"


def style_grid(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).groupBy((F.col("task_id") % 20).alias("topology"), F.col("line").alias("style")).agg(F.avg(F.col("success").cast("int")).alias("rate"))


@query(f"""WITH {SQL_GRID}, m AS (SELECT *, avg(rate) OVER () AS grand, avg(rate) OVER (PARTITION BY topology) AS row_, avg(rate) OVER (PARTITION BY style) AS col_ FROM grid),
    s AS (SELECT sum(pow(row_ - grand, 2)) AS topo, sum(pow(col_ - grand, 2)) AS style, sum(pow(rate - row_ - col_ + grand, 2)) AS inter FROM m)
    SELECT round(topo / (topo + style + inter), 6) AS topology, round(style / (topo + style + inter), 6) AS style, round(inter / (topo + style + inter), 6) AS interaction FROM s""")
def variance_components(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of the sums of squares of a topology x style grid, which has one row per cell."""
    mean = lambda *by: F.avg("rate").over(Window.partitionBy(*by))
    m = style_grid(spark, sf).withColumns({"grand": mean(F.lit(1)), "row": mean("topology"), "col": mean("style")})
    s = m.agg(F.sum((F.col("row") - F.col("grand")) ** 2).alias("a"), F.sum((F.col("col") - F.col("grand")) ** 2).alias("b"), F.sum((F.col("rate") - F.col("row") - F.col("col") + F.col("grand")) ** 2).alias("c"))
    whole = F.col("a") + F.col("b") + F.col("c")
    return s.select(*[r6(F.try_divide(F.col(x), whole)).alias(n) for x, n in (("a", "topology"), ("b", "style"), ("c", "interaction"))])


@query(f"WITH {SQL_GRID}, s AS (SELECT style, avg(rate) AS m FROM grid GROUP BY 1), t AS (SELECT topology, max(rate) - min(rate) AS swing FROM grid GROUP BY 1) SELECT (SELECT round(max(m) - min(m), 6) FROM s) AS effect_range, (SELECT round(avg(swing), 6) FROM t) AS mean_swing, (SELECT round(max(swing), 6) FROM t) AS worst_swing")
def style_swing(spark: SparkSession, sf: str) -> DataFrame:
    grid = style_grid(spark, sf)
    effect = grid.groupBy("style").agg(F.avg("rate").alias("m")).agg(r6(F.max("m") - F.min("m")).alias("effect_range"))
    swing = grid.groupBy("topology").agg((F.max("rate") - F.min("rate")).alias("w")).agg(r6(F.avg("w")).alias("mean_swing"), r6(F.max("w")).alias("worst_swing"))
    return effect.crossJoin(swing)


# paired tests and resampling over at most providers x tasks cells


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The rates of provider p and p + 1 on every task that both have."""
    c = cells(spark, sf)
    a = c.select("provider", "task_id", F.col("rate").alias("ra"), F.col("c").alias("ca"))
    b = c.select((F.col("provider") - 1).alias("provider"), "task_id", F.col("rate").alias("rb"), F.col("c").alias("cb"))
    return a.join(b, ["provider", "task_id"])


SQL_PAIRS = f"{SQL_CELLS}, pairs AS (SELECT a.provider, a.task_id, a.rate AS ra, b.rate AS rb, a.c AS ca, b.c AS cb FROM cells a JOIN cells b ON b.provider = a.provider + 1 AND b.task_id = a.task_id)"


@query(f"WITH {SQL_PAIRS} SELECT provider, count(*) AS tasks, round(avg(ra - rb), 6) AS diff FROM pairs GROUP BY 1")
def paired_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).groupBy("provider").agg(F.count("*").alias("tasks"), r6(F.avg(F.col("ra") - F.col("rb"))).alias("diff"))


@query(f"""WITH RECURSIVE {SQL_PAIRS}, d AS (SELECT provider, count(*) FILTER (ca > 12 AND NOT cb > 12) AS a_only, count(*) FILTER (cb > 12 AND NOT ca > 12) AS b_only FROM pairs GROUP BY 1),
    t AS (SELECT provider, a_only, b_only, sum(exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2))) AS tail FROM d, range(0, 200) r(i) WHERE i <= least(a_only, b_only) GROUP BY ALL)
    SELECT provider, a_only, b_only, round(CASE WHEN a_only + b_only = 0 THEN 1 ELSE least(1, 2 * tail) END, 6) AS p FROM t""")
def mcnemar(spark: SparkSession, sf: str) -> DataFrame:
    """Exact test on tasks that one provider solves (more than a dozen times here) and the other doesn't."""
    a, b = F.col("ca") > 12, F.col("cb") > 12
    d = _pairs(spark, sf).groupBy("provider").agg(F.count_if(a & ~b).alias("a_only"), F.count_if(b & ~a).alias("b_only"))
    return d.withColumn("p", r6(binomial_two_sided(F.col("a_only"), F.col("b_only"))))


RESAMPLES = 200


def _draws(values: DataFrame, value: str, resamples: int) -> DataFrame:
    """Means of resamples drawn with replacement by hash: provider, draw, mean. values: provider, task_id, value; bounded groups."""
    ranked = values.withColumn("i", F.row_number().over(Window.partitionBy("provider").orderBy("task_id")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("provider")))
    held = ranked.groupBy("provider").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col(value).alias("v")))), lambda x: x["v"]).alias("vs"))
    draws = held.select("provider", "vs", F.size("vs").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("draw"))
    picks = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.get("vs", hash_index([F.col("provider").cast("string"), F.col("draw").cast("string"), j.cast("string")], F.col("n")).cast("int")))
    return draws.select("provider", "draw", (F.aggregate(picks, F.lit(0.0), lambda a, v: a + v) / F.col("n")).alias("mean"))


SQL_DRAWS = """ranked AS (SELECT provider, v, row_number() OVER (PARTITION BY provider ORDER BY task_id) - 1 AS i, count(*) OVER (PARTITION BY provider) AS n FROM vals),
    draws AS (SELECT r.provider, b.b AS draw, avg(p.v) AS mean FROM ranked r, range(0, 200) b(b), ranked p WHERE p.provider = r.provider AND p.i = ('0x' || substr(md5(concat_ws('|', r.provider, b.b, r.i)), 1, 8))::BIGINT % r.n GROUP BY ALL)"""


@query(f"WITH {SQL_CELLS}, vals AS (SELECT provider, task_id, rate AS v FROM cells), {SQL_DRAWS} SELECT provider, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi FROM draws GROUP BY 1")
def bootstrap_ci_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Task-clustered percentile interval of the macro mean, with draws that any engine repeats."""
    draws = _draws(cells(spark, sf), "rate", RESAMPLES)
    return draws.groupBy("provider").agg(r6(F.percentile("mean", F.lit(0.025))).alias("lo"), r6(F.percentile("mean", F.lit(0.975))).alias("hi"))


@query(f"""WITH {SQL_PAIRS}, vals AS (SELECT provider, task_id, ra - rb AS v FROM pairs), {SQL_DRAWS}, o AS (SELECT provider, avg(v) AS diff FROM vals GROUP BY 1),
    flips AS (SELECT r.provider, b.b AS draw, avg(CASE WHEN ('0x' || substr(md5(concat_ws('|', 'f', r.provider, b.b, r.i)), 1, 8))::BIGINT % 2 = 0 THEN r.v ELSE -r.v END) AS m FROM ranked r, range(0, 200) b(b) GROUP BY ALL),
    f AS (SELECT provider, avg((round(abs(m), 9) >= round(abs(diff), 9))::INT) AS p FROM flips JOIN o USING (provider) GROUP BY 1)
    SELECT provider, round(any_value(diff), 6) AS diff, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi, round(any_value(p), 6) AS p FROM draws JOIN o USING (provider) JOIN f USING (provider) GROUP BY provider""")
def paired_bootstrap_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Mean paired difference, its interval, and a two-sided sign-flip p."""
    vals = _pairs(spark, sf).select("provider", "task_id", (F.col("ra") - F.col("rb")).alias("v"))
    seen = vals.groupBy("provider").agg(F.avg("v").alias("diff"))
    ci = _draws(vals, "v", RESAMPLES).groupBy("provider").agg(r6(F.percentile("mean", F.lit(0.025))).alias("lo"), r6(F.percentile("mean", F.lit(0.975))).alias("hi"))
    held = vals.groupBy("provider").agg(F.transform(F.array_sort(F.collect_list(F.struct("task_id", "v"))), lambda x: x["v"]).alias("vs"))
    sign = lambda v, i: F.when(hash_index([F.lit("f"), F.col("provider").cast("string"), F.col("draw").cast("string"), i.cast("string")], F.lit(2)) == 0, v).otherwise(-v)
    flips = held.select("provider", "vs", F.explode(F.sequence(F.lit(0), F.lit(RESAMPLES - 1))).alias("draw"))
    flips = flips.select("provider", (F.aggregate(F.transform("vs", sign), F.lit(0.0), lambda a, v: a + v) / F.size("vs")).alias("m"))
    p = flips.join(F.broadcast(seen), "provider").groupBy("provider").agg(r6(F.avg((F.round(F.abs("m"), 9) >= F.round(F.abs("diff"), 9)).cast("int"))).alias("p"))
    return seen.join(ci, "provider").join(p, "provider").select("provider", r6("diff").alias("diff"), "lo", "hi", "p")


# windows over the plan and dimensions


@query("WITH o AS (SELECT p_partkey AS slot, (row_number() OVER (ORDER BY p_partkey) - 1) AS i FROM part WHERE p_partkey < 100) SELECT slot, i % 8 AS family, CASE WHEN i < round_even(0.3 * 100, 0) THEN 'easy' WHEN i < round_even(0.7 * 100, 0) THEN 'medium' ELSE 'hard' END AS tier FROM o")
def win_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    """Slots dealt to eight families in turn, tiers by rounded shares, the rest hard; over the bounded task list."""
    t = tasks(spark, sf).select(F.col("task_id").alias("slot"), (F.row_number().over(Window.orderBy("task_id")) - 1).cast("long").alias("i"))
    return t.select("slot", (F.col("i") % 8).alias("family"), F.when(F.col("i") < 30, "easy").when(F.col("i") < 70, "medium").otherwise("hard").alias("tier"))


@query(f"""WITH {SQL_TASKS}, r AS (SELECT task_id, tier, row_number() OVER (PARTITION BY tier ORDER BY md5('5|' || task_id), task_id) - 1 AS i, count(*) OVER (PARTITION BY tier) AS n FROM tasks)
    SELECT a.task_id, b.task_id AS source_id FROM r a JOIN r b ON b.tier = a.tier AND b.i = (a.i + 1) % a.n WHERE a.n > 1""")
def win_derangement(spark: SparkSession, sf: str) -> DataFrame:
    """Within a tier, every task gets the next one's image in hash order, so none gets its own."""
    w = Window.partitionBy("tier")
    r = tasks(spark, sf).select("task_id", "tier", (F.row_number().over(w.orderBy(F.md5(F.concat(F.lit("5|"), F.col("task_id").cast("string")).cast("binary")), "task_id")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    b = r.select(F.col("tier").alias("tier"), F.col("i").alias("next"), F.col("task_id").alias("source_id"))
    return r.where(F.col("n") > 1).withColumn("next", ((F.col("i") + 1) % F.col("n")).cast("int")).join(b, ["tier", "next"]).select("task_id", "source_id")


@query("SELECT p_partkey AS task_id, round(p_retailprice / 500 + (p_size % 13) / 12.0::DOUBLE + least(p_size % 20, 15) / 10.0::DOUBLE, 4) AS score, CASE WHEN p_retailprice / 500 + (p_size % 13) / 12.0::DOUBLE + least(p_size % 20, 15) / 10.0::DOUBLE < 1.6 THEN 'easy' WHEN p_retailprice / 500 + (p_size % 13) / 12.0::DOUBLE + least(p_size % 20, 15) / 10.0::DOUBLE < 3 THEN 'medium' ELSE 'hard' END AS tier FROM part")
def difficulty_tier(spark: SparkSession, sf: str) -> DataFrame:
    """length / diagonal + turns / 12 + min(branches, 15) / 10, banded at 1.6 and 3.0 before it is rounded."""
    size = F.col("p_size")
    score = F.col("p_retailprice") / 500 + (size % 13) / F.lit(12.0) + F.least(size % 20, F.lit(15)) / F.lit(10.0)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("task_id"), F.round(score, 4).alias("score"), F.when(score < 1.6, "easy").when(score < 3, "medium").otherwise("hard").alias("tier"))
