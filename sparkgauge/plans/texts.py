"""Queries on text, JSON, maps, hashes and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import session
from ..functions import text as T
from .registry import query
from .shapes import SQL_TURNS, outside_flags
from .views import polylines, table


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, whatever their language and letters; a null text counts as empty."""
    return table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))


#: DuckDB's word boundaries know ASCII only, so its texts have an underscore, a word character that no pattern names, for every other letter.
SQL_PLAIN = r"regexp_replace(lower(trace), '[ªµºÀ-ÖØ-öø-\x{2FF}\x{370}-\x{1FFF}\x{2C00}-\x{2DFF}\x{3040}-\x{D7FF}\x{F900}-\x{FDFF}]', '_', 'g')"


def _sql_match(column: str, patterns) -> str:
    return "(" + " OR ".join("regexp_matches({}, '{}')".format(column, p.replace("'", "''")) for p in patterns) + ")"


def trace():
    """Driver documents hold no reasoning, so a phrase that depends on the id is put in front."""
    phrases = ["this path is clear. ", "assume a gap here. ", "good enough, i'll commit to it. ", "the walls are the paths. ", "node A and node B, adjacency. ", "we backtrack. ", "x = 12. ", ""]
    start = F.element_at(F.array(*map(F.lit, phrases)), (F.col("doc_id") % len(phrases) + 1).cast("int"))
    return F.concat(start, "text")


SQL_TRACES = r"traces AS (SELECT doc_id, ['this path is clear. ', 'assume a gap here. ', 'good enough, i''ll commit to it. ', 'the walls are the paths. ', 'node A and node B, adjacency. ', 'we backtrack. ', 'x = 12. ', ''][doc_id % 8 + 1] || coalesce(text, '') AS trace FROM documents), plain AS (SELECT *, " + SQL_PLAIN + " AS low FROM traces)"
SQL_HITS = "hits AS (SELECT doc_id, trace, low, array_to_string(list_filter([{}], lambda m: m IS NOT NULL), ',') AS modes FROM plain)".format(", ".join(f"CASE WHEN {_sql_match('low', ps)} THEN '{m}' END" for m, ps in T.LEXICAL.items()))


@query(f"WITH {SQL_TRACES}, {SQL_HITS} SELECT doc_id, modes FROM hits")
def lexical_hits(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.array_join(T.lexical_hits(trace()), ",").alias("modes"))


@query(f"WITH {SQL_TRACES} SELECT doc_id, {_sql_match('low', T.PERCEPTUAL)} AS perceptual FROM plain")
def perceptual_flag(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", T.perceptual(trace()).alias("perceptual"))


_RULES = {
    "procedural_template": f"NOT {_sql_match('low', T.PERCEPTUAL)} AND modes = '' AND length(trace) < 1200",
    "figure_ground_inversion": "outside > 0.45 AND coalesce(first_out, 1) < 0.25 AND (contains(modes, 'figure_ground_inversion') OR (outside > 0.7 AND started))",
    "endpoint_misidentification": "NOT started",
    "analytic_parameterisation": "contains(modes, 'analytic_parameterisation') AND cv < 0.55",
    "graph_abstraction": "contains(modes, 'graph_abstraction') AND mean_seg > 55",
    "exploration_leakage": "contains(modes, 'exploration_leakage') AND reversals >= 1",
    "topology_fabrication": "contains(modes, 'topology_fabrication') AND progress > 0.25",
    "fabricated_verification": "contains(modes, 'fabricated_verification')",
    "satisficing": "contains(modes, 'satisficing')",
    "clearance_failure": "outside < 0.02 AND NOT free",
    "corridor_departure": "outside >= 0.02 AND NOT free",
    "near_miss_precision": "progress > 0.6 AND outside < 0.08 AND start_error <= 60",
    "wrong_branch": "outside < 0.02 AND free",
}


@query(f"""WITH {SQL_TURNS}, {SQL_TRACES}, {SQL_HITS}, segs AS (SELECT vec_id, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS len FROM points WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
    l AS (SELECT vec_id, avg(len) AS mean_seg, stddev_pop(len) / avg(len) AS cv FROM segs WHERE len IS NOT NULL GROUP BY 1), t AS (SELECT vec_id, count(*) FILTER (a > 2) AS reversals FROM turns GROUP BY 1),
    o AS (SELECT vec_id, avg((x < 60 OR x > 140)::INT) AS outside, min(CASE WHEN x < 60 OR x > 140 THEN i END) / 32.0::DOUBLE AS first_out, max(CASE WHEN i = 0 THEN sqrt(pow(x - 100, 2) + pow(y - 100, 2)) END) AS start_error FROM points GROUP BY 1),
    j AS (SELECT doc_id, trace, low, modes, l.*, reversals, outside, first_out, start_error, start_error <= 60 AS started, doc_id % 3 > 0 AS free, (doc_id % 10) / 10.0::DOUBLE AS progress FROM hits JOIN l ON vec_id = doc_id JOIN t USING (vec_id) JOIN o USING (vec_id)),
    c AS (SELECT doc_id, list_filter([{", ".join(f"CASE WHEN {_RULES[m]} THEN '{m}' END" for m in T.PRECEDENCE)}], lambda m: m IS NOT NULL) AS modes FROM j)
    SELECT doc_id, coalesce(modes[1], 'unclassified') AS primary_mode, array_to_string(modes[2:], ',') AS secondary FROM c""")
def classify_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts from a trace and a path each: candidates in order of precedence, the first is primary."""
    pts = F.col("pts")
    paths = polylines(spark, sf).select(F.col("vec_id").alias("doc_id"), G.segments(pts).alias("s"), G.turn_angles(pts).alias("a"), outside_flags(pts).alias("o"), F.hypot(pts[0]["x"] - 100, pts[0]["y"] - 100).alias("start_error"))
    at = F.array_position("o", True) - 1
    g = {"points": F.lit(32), "outside_fraction": F.size(F.filter("o", lambda x: x)) / 32, "first_outside": F.when(at >= 0, at / 32), "spacing_cv": G.variation(F.col("s")), "mean_segment": G.total(F.col("s")) / 31, "reversals": F.size(F.filter("a", lambda a: a > 2)), "revisit": F.lit(0.0), "start_error": F.col("start_error"), "start_radius": F.lit(60.0)}
    rows = docs(spark, sf).select("doc_id", trace().alias("trace")).join(paths, "doc_id").withColumn("hits", T.lexical_hits(F.col("trace")))
    modes = T.classify(F.col("trace"), F.col("hits"), g, F.col("start_error") <= 60, F.col("doc_id") % 3 > 0, (F.col("doc_id") % 10) / F.lit(10.0))
    rows = rows.select("doc_id", modes.alias("m"))
    return rows.select("doc_id", F.coalesce(F.get("m", F.lit(0)), F.lit("unclassified")).alias("primary_mode"), F.array_join(F.slice("m", 2, 13), ",").alias("secondary"))


@query("SELECT event_id, props FROM events WHERE try_cast(json_extract_string(CASE WHEN event_id % 11 = 0 THEN NULL ELSE props END, '$.k') AS BIGINT) IS NOT NULL")
def src_malformed_skip(spark: SparkSession, sf: str) -> DataFrame:
    """Blank and malformed lines are dropped: every eleventh line is cut short here."""
    line = F.when(F.col("event_id") % 11 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    rows = table(spark, sf, "events").select("event_id", "props", F.from_json(line, "k long, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("j"))
    return rows.where((F.trim("props") != "") & F.col("j._corrupt_record").isNull() & F.col("j").isNotNull()).select("event_id", "props")


@query("WITH l AS (SELECT CASE WHEN event_id % 11 = 0 THEN substr(props, 1, 4) ELSE props END AS line FROM events) SELECT count(*) AS lines, count(*) FILTER (NOT json_valid(line)) AS malformed, count(*) FILTER (json_valid(line)) AS rows FROM l WHERE trim(line) <> ''")
def src_malformed_count(spark: SparkSession, sf: str) -> DataFrame:
    line = F.when(F.col("event_id") % 11 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    bad = F.from_json(line, "k long, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})["_corrupt_record"].isNotNull()
    return table(spark, sf, "events").where(F.trim(line) != "").agg(F.count("*").alias("lines"), F.count_if(bad).alias("malformed"), F.count_if(~bad).alias("rows"))


@query("WITH s AS (SELECT DISTINCT source FROM documents), l AS (SELECT source || ', ' || source || '-b,#' || source || ',,' AS line FROM s), p AS (SELECT unnest(string_split(line, ',')) AS part FROM l) SELECT trim(part) AS id, count(*) AS n FROM p WHERE trim(part) <> '' AND part NOT LIKE '#%' GROUP BY 1")
def src_id_list(spark: SparkSession, sf: str) -> DataFrame:
    """Ids by comma or line, trimmed; blanks and parts that begin with # are dropped."""
    s = F.col("source")
    line = F.concat(s, F.lit(", "), s, F.lit("-b,#"), s, F.lit(",,"))
    parts = table(spark, sf, "documents").select("source").distinct().select(F.explode(F.split(F.regexp_replace(line, ",", "\n"), "\n")).alias("part"))
    return parts.where((F.trim("part") != "") & ~F.col("part").startswith("#")).groupBy(F.trim("part").alias("id")).agg(F.count("*").alias("n"))


@query("SELECT 'part' AS split, p_name AS hash, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'supplier', s_name, count(*) FROM supplier GROUP BY ALL")
def src_multi_split(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda t, c: table(spark, sf, t).select(F.lit(t).alias("split"), F.col(c).alias("hash"))
    return one("part", "p_name").unionByName(one("supplier", "s_name")).groupBy("split", "hash").agg(F.count("*").alias("n"))


def _submission(spark: SparkSession, sf: str) -> DataFrame:
    """Submissions of every kind of fault, by event."""
    k = F.get_json_object("props", "$.k")
    forms = [
        F.concat(F.lit('{"points": [{"x": 0.'), k, F.lit(', "y": 0.5}, {"x": 1, "y": 0}]}')), F.lit("[1, 2]"), F.lit('{"p": 1}'), F.lit('{"points": 3}'), F.lit('{"points": [{"x": 0, "y": 0}]}'),
        F.lit('{"points": [{"x": 0, "y": 0}, 7]}'), F.lit('{"points": [{"x": 0, "y": 0}, {"x": 0}]}'), F.lit('{"points": [{"x": true, "y": 0}, {"x": 0, "y": 0}]}'), F.concat(F.lit('{"points": [{"x": 0, "y": 0, "z": 1}, {"x": 0, "y": -0.'), k, F.lit("1}]}")), F.lit("not json"),
    ]
    return table(spark, sf, "events").select("event_id", F.element_at(F.array(*forms), (F.col("event_id") % len(forms) + 1).cast("int")).alias("body"))


SQL_BODIES = """k AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events), b AS (SELECT event_id, ['{"points": [{"x": 0.' || k || ', "y": 0.5}, {"x": 1, "y": 0}]}', '[1, 2]', '{"p": 1}', '{"points": 3}', '{"points": [{"x": 0, "y": 0}]}',
    '{"points": [{"x": 0, "y": 0}, 7]}', '{"points": [{"x": 0, "y": 0}, {"x": 0}]}', '{"points": [{"x": true, "y": 0}, {"x": 0, "y": 0}]}', '{"points": [{"x": 0, "y": 0, "z": 1}, {"x": 0, "y": -0.' || k || '1}]}', 'not json'][event_id % 10 + 1] AS body FROM k)"""
_COORDINATE = "CASE WHEN NOT json_exists(p, '$.{0}') THEN 'point ' || i || ' is missing ''{0}''' WHEN json_type(p, '$.{0}') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'point ' || i || ' ''{0}'' is not a number' WHEN json_extract(p, '$.{0}')::DOUBLE NOT BETWEEN 0 AND 1 THEN 'point ' || i || ' ''{0}'' is outside [0, 1]' END"


@query(f"""WITH {SQL_BODIES}, j AS (SELECT event_id, CASE WHEN json_valid(body) THEN body::JSON END AS body FROM b),
    e AS (SELECT event_id, body, CASE WHEN coalesce(json_type(body), '') <> 'OBJECT' THEN 'arguments must be an object' WHEN NOT json_exists(body, '$.points') THEN 'missing required ''points'' array' WHEN json_type(body, '$.points') <> 'ARRAY' THEN '''points'' must be an array'
        WHEN json_array_length(body, '$.points') < 2 THEN 'too few points (' || json_array_length(body, '$.points') || ' < 2)' WHEN json_array_length(body, '$.points') > 512 THEN 'too many points (' || json_array_length(body, '$.points') || ' > 512)' END AS error FROM j),
    q AS (SELECT event_id, unnest(json_extract(body, '$.points[*]')) AS p, unnest(range(json_array_length(body, '$.points')::BIGINT)) AS i FROM e WHERE error IS NULL),
    r AS (SELECT event_id, i, CASE WHEN json_type(p) <> 'OBJECT' THEN 'point ' || i || ' is not an object' ELSE coalesce({_COORDINATE.format('x')}, {_COORDINATE.format('y')}) END AS error FROM q),
    f AS (SELECT event_id, min_by(error, i) FILTER (error IS NOT NULL) AS error FROM r GROUP BY 1)
    SELECT e.event_id, coalesce(e.error, f.error) AS error FROM e LEFT JOIN f USING (event_id)""")
def json_validate(spark: SparkSession, sf: str) -> DataFrame:
    return _submission(spark, sf).select("event_id", T.submission_error(F.try_parse_json("body")).alias("error"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN json_extract_string(props, '$.k')::BIGINT WHEN 1 THEN 0 ELSE 0 END AS tokens_in, CASE WHEN event_id % 3 = 1 THEN json_extract_string(props, '$.k')::BIGINT ELSE 0 END AS tokens_out FROM events")
def json_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts under whichever name a vendor gives them."""
    name = F.element_at(F.array(*map(F.lit, ("prompt_tokens", "completion_tokens", "cached"))), (F.col("event_id") % 3 + 1).cast("int"))
    body = F.regexp_replace("props", F.lit('"k"'), F.concat(F.lit('"'), name, F.lit('"')))
    return table(spark, sf, "events").select("event_id", T.usage(body, T.USAGE_IN).alias("tokens_in"), T.usage(body, T.USAGE_OUT).alias("tokens_out"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN json_extract_string(props, '$.k') WHEN 1 THEN 'u' || user_id WHEN 2 THEN event_type ELSE NULL END AS stack FROM events")
def json_first_key(spark: SparkSession, sf: str) -> DataFrame:
    """The first of three keys with text in it."""
    m = F.col("event_id") % 4
    key = lambda i, v: F.when(m == i, v).otherwise("")
    stack = F.nullif(F.coalesce(F.nullif(key(0, F.get_json_object("props", "$.k")), F.lit("")), F.nullif(key(1, F.concat(F.lit("u"), F.col("user_id").cast("string"))), F.lit("")), key(2, F.col("event_type"))), F.lit(""))
    return table(spark, sf, "events").select("event_id", stack.alias("stack"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, CASE event_id % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'block' ELSE 'text' END AS form FROM events")
def json_tool_call(spark: SparkSession, sf: str) -> DataFrame:
    """Tool arguments from a JSON call, else from a tagged block, else from the first typed block that is an object."""
    m = F.col("event_id") % 3
    call = F.when(m == 0, F.concat(F.lit('{"arguments": '), "props", F.lit("}")))
    said = F.when(m == 1, F.concat(F.lit("I move. <call>"), "props", F.lit("</call> done")))
    blocks = F.when(m == 2, F.concat(F.lit('[{"type": "text", "input": null}, {"type": "tool_use", "input": '), "props", F.lit("}]")))
    typed = F.filter(F.from_json(blocks, "array<struct<type:string,input:struct<k:long>>>"), lambda b: (b["type"] == "tool_use") & b["input"].isNotNull())
    found = F.coalesce(F.from_json(call, "arguments struct<k:long>")["arguments"]["k"], F.from_json(F.nullif(F.regexp_extract(said, r"<call>(.*?)</call>", 1), F.lit("")), "k long")["k"], F.get(typed, F.lit(0))["input"]["k"])
    return table(spark, sf, "events").select("event_id", found.alias("k"), F.when(m == 0, "json").when(m == 1, "block").otherwise("text").alias("form"))


@query("SELECT p_partkey AS task_id, CASE WHEN p_size % 2 = 0 THEN p_name WHEN p_size % 3 = 0 THEN p_brand ELSE NULL END AS reasoning FROM part")
def str_first_nonblank(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    a, b = F.when(size % 2 == 0, F.col("p_name")).otherwise("  "), F.when(size % 3 == 0, F.col("p_brand")).otherwise("")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("task_id"), T.first_nonblank(a, b).alias("reasoning"))


@query("SELECT p_partkey AS task_id, 'rescale@' || p_size || 'x' AS label, 'stopped at ' || printf('%.3f', p_retailprice / 997) || ' by ' || p_type AS feedback FROM part")
def str_format(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("task_id"), F.format_string("rescale@%dx", "p_size").alias("label"), F.format_string("stopped at %.3f by %s", F.col("p_retailprice") / 997, F.col("p_type")).alias("feedback"))


@query("SELECT page_id, CASE WHEN contains(url, 'http://') THEN replace(url, 'http://', '') WHEN contains(url, 'https://') THEN replace(url, 'https://', '') ELSE url END AS route FROM pages")
def str_scrub(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.scrub(F.col("url"), {"https://": "", "http://": ""}).alias("route"))


@query(r"WITH l AS (SELECT page_id, url FROM pages WHERE regexp_matches(url, '(spam|casino|pills)')) SELECT page_id, regexp_extract(url, '(spam|casino|pills)', 1) AS hit FROM l")
def str_grep(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").where(F.regexp_like("url", F.lit("(spam|casino|pills)"))).select("page_id", F.regexp_extract("url", "(spam|casino|pills)", 1).alias("hit"))


@query("SELECT a.doc_id, starts_with(a.text, b.text) AS prefix FROM documents a JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(substr(text, 1, 40)) WHEN doc_id % 3 = 1 THEN substr(text, 2, 40) ELSE substr(text, 1, 40) END AS text FROM documents) b USING (doc_id)")
def str_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Whether archived bytes begin the live ones: of every third document they have been changed, of another third the first letter is lost."""
    d, m = table(spark, sf, "documents"), F.col("doc_id") % 3
    archived = d.select("doc_id", F.when(m == 0, F.upper(F.substring("text", 1, 40))).when(m == 1, F.substring("text", 2, 40)).otherwise(F.substring("text", 1, 40)).alias("archived"))
    return d.join(archived, "doc_id").select("doc_id", F.startswith("text", "archived").alias("prefix"))


@query("SELECT p_partkey AS task_id, (p_partkey % 7)::BIGINT AS shard, p_size::BIGINT AS shards, p_partkey % 7 < p_size AS valid FROM part")
def str_split_cast(spark: SparkSession, sf: str) -> DataFrame:
    """``i/n`` arguments."""
    given = F.split(F.concat((F.col("p_partkey") % 7).cast("string"), F.lit("/"), F.col("p_size").cast("string")), "/")
    i, n = given[0].try_cast("bigint"), given[1].try_cast("bigint")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("task_id"), i.alias("shard"), n.alias("shards"), F.coalesce((i >= 0) & (i < n), F.lit(False)).alias("valid"))


@query("SELECT p_partkey AS task_id, CASE WHEN p_size % 2 = 0 THEN 'model,size' ELSE 'size' END AS kept FROM part")
def map_redact(spark: SparkSession, sf: str) -> DataFrame:
    even = F.col("p_size") % 2 == 0
    settings = F.create_map(F.lit("API_Key"), F.lit("x"), F.when(even, "model").otherwise("modelkey"), F.col("p_name"), F.lit("size"), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("task_id"), F.array_join(F.array_sort(F.map_keys(T.redact(settings))), ",").alias("kept"))


@query("SELECT doc_id, sha256(text) AS sha256, sha256('100x200;' || text) AS mask_sha256 FROM documents")
def hash_sha256(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text").cast("binary")
    return table(spark, sf, "documents").select("doc_id", F.sha2(text, 256).alias("sha256"), F.sha2(F.concat(F.lit(b"100x200;"), text), 256).alias("mask_sha256"))


@query("SELECT p_partkey AS task_id, round(least(60.0::DOUBLE, 2.0::DOUBLE * pow(2.0::DOUBLE, p_size % 6)) * ((p_partkey % 10) / 10.0::DOUBLE), 6) AS wait_s FROM part")
def num_backoff(spark: SparkSession, sf: str) -> DataFrame:
    u = (F.col("p_partkey") % 10) / F.lit(10.0)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("task_id"), F.round(T.backoff((F.col("p_size") % 6).cast("double"), 2.0, 60.0, u), 6).alias("wait_s"))


@query("SELECT p_partkey AS task_id, (p_type = 'PROMO')::INT::DOUBLE AS promo, (p_type = 'SMALL')::INT::DOUBLE AS small FROM part")
def num_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    hot = lambda v: (F.col("p_type") == v).cast("double")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("task_id"), hot("PROMO").alias("promo"), hot("SMALL").alias("small"))


@query("""SELECT l_suppkey % 7 AS provider, l_partkey % 100 AS task_id, count(*) AS n, count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'R') AS c,
    round(CASE WHEN n - c < 8 THEN 1 ELSE 1 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(0, 8), lambda i: (n - c - i)::DOUBLE / (n - i))), lambda a, b: a * b) END, 6) AS pass8,
    (l_suppkey % 7)::VARCHAR || '/' || (l_partkey % 100)::VARCHAR || '/0' AS key FROM lineitem GROUP BY ALL HAVING n >= 8""")
def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    """A SQL text that calls the registered functions over all attempts."""
    session.register(spark)
    return spark.sql("""SELECT provider, task_id, n, c, round(pass_at_k(n, c, 8), 6) AS pass8, composite_key(CAST(provider AS STRING), CAST(task_id AS STRING), NULL) AS key
        FROM (SELECT l_suppkey % 7 AS provider, l_partkey % 100 AS task_id, count(*) AS n, count_if(l_linestatus = 'F' AND l_returnflag = 'R') AS c FROM {lines} GROUP BY ALL) WHERE n >= 8""", lines=table(spark, sf, "lineitem"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def sql_tool_call(spark: SparkSession, sf: str) -> DataFrame:
    """Tool arguments of all events by the registered SQL function, in their three forms."""
    session.register(spark)
    return spark.sql("""SELECT event_id, CAST(get_json_object(json_tool_call(IF(event_id % 3 = 0, '{{"arguments": ' || props || '}}', NULL), IF(event_id % 3 = 1, 'I move. <call>' || props || '</call> done', NULL),
        IF(event_id % 3 = 2, '[{{"type": "text", "input": null}}, {{"type": "tool_use", "input": ' || props || '}}]', NULL)), '$.k') AS BIGINT) AS k FROM {events}""", events=table(spark, sf, "events"))
