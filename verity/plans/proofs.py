"""Registered queries of small operators and column functions, each over a given table, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verity.functions import scores
from verity.functions import text as tx
from verity.operators import audit, graphs, propagate, reports, trajectory
from verity.operators.calibration import calibrate
from verity.plans.catalog import G, register
from verity.plans.tables import shared_dir
from verity.plans.views import view, with_views
from verity.sources import runs as sources
from verity.sources import sinks, store


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return view(spark, sf_dir, name).selectExpr(*columns)


# ---------------------------------------------------------------- numbers

_SCORE = "cast((conv_id * 17 + turn * 5) % 130 as double) / 100"
register("probability_range", f"SELECT conv_id, turn, {_SCORE} BETWEEN 0 AND 1 AS ok FROM conversations")(lambda s, d: _table(s, d, "conversations", "conv_id", "turn", f"{_SCORE} as x").select("conv_id", "turn", scores.is_probability("x").alias("ok")))
_GAPS = "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END"
register("missing_values", f"SELECT event_id, x IS NULL OR isnan(x) AS missing FROM (SELECT event_id, {_GAPS} AS x FROM events) e")(lambda s, d: _table(s, d, "events", "event_id", f"{_GAPS} as x").select("event_id", scores.missing(F.col("x")).alias("missing")))
register("rescaled_scores", "SELECT c_custkey, round((c_custkey % 11 - 0) / CAST(10 AS DOUBLE), 6) AS score FROM customer")(lambda s, d: view(s, d, "customer").select("c_custkey", scores.rescale((F.col("c_custkey") % 11).cast("double"), 0.0, 10.0).alias("score")))
_PAIR = "-(cast(c_custkey % 5 as double) + 1) / 10 as yes, -(cast(c_custkey % 7 as double) + 1) / 10 as no"
register("true_shares", f"SELECT c_custkey, round(exp(yes) / (exp(yes) + exp(no)), 6) AS share FROM (SELECT c_custkey, {_PAIR} FROM customer) x")(
    lambda s, d: _table(s, d, "customer", "c_custkey", _PAIR.split(", -")[0], "-" + _PAIR.split(", -")[1]).select("c_custkey", F.array(F.lit(" True"), F.lit("maybe"), F.lit("FALSE ")).alias("t"), F.array("yes", F.lit(-0.05), "no").alias("p")).select("c_custkey", scores.true_share("t", "p").alias("share"))
)


# ---------------------------------------------------------------- texts and paths

_PATHS = "concat(CASE page_id % 6 WHEN 0 THEN '/abs/' WHEN 1 THEN 'a/../' WHEN 2 THEN 'a/..b/' WHEN 3 THEN '../' WHEN 4 THEN 'a/.../' ELSE 'ok/' END, CAST(page_id AS STRING))"
register("safe_paths", f"SELECT page_id, NOT starts_with(p, '/') AND NOT list_contains(string_split(p, '/'), '..') AS safe FROM (SELECT page_id, {_PATHS} AS p FROM pages) x")(lambda s, d: _table(s, d, "pages", "page_id", f"{_PATHS} as p").select("page_id", tx.safe_relative_path(F.col("p")).alias("safe")))
_FOLDERS = "concat('/base/group-', CAST(o_custkey % 7 AS STRING), '/run-', CAST(o_orderkey % 11 AS STRING), '/results.csv')"
register("run_names", f"SELECT DISTINCT regexp_extract(p, '^/base/(.*)/[^/]+$', 1) AS run FROM (SELECT {_FOLDERS} AS p FROM orders) x")(lambda s, d: sources.run_names(_table(s, d, "orders", f"{_FOLDERS} as file_path"), "/base"))
_KEYS = "concat('i', CAST(o_orderkey AS STRING), CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '/m' ELSE '/org/m/v1' END)"
register("keys_from_paths", f"SELECT o_orderkey, split_part(p, '/', 1) AS instance_id, CASE WHEN contains(p, '/') THEN substr(p, strpos(p, '/') + 1) ELSE '' END AS model FROM (SELECT o_orderkey, {_KEYS} AS p FROM orders) x")(
    lambda s, d: _table(s, d, "orders", "o_orderkey", f"{_KEYS} as p").select("o_orderkey", *sources.key_from_path(F.col("p")))
)
_SAID = "concat(text, CASE turn % 3 WHEN 0 THEN concat({n}, 'Critic: well', {n}, 'done  ') WHEN 1 THEN concat({n}, ' ', {n}) ELSE ' Critic: inside' END)"
register("without_critic", f"SELECT conv_id, turn, regexp_replace(regexp_replace(x, '(?ms)^Critic:.*', ''), '\\s+$', '') AS said FROM (SELECT conv_id, turn, {_SAID.replace('{n}', 'chr(10)')} AS x FROM conversations) c")(
    lambda s, d: _table(s, d, "conversations", "conv_id", "turn", f"{_SAID.replace('{n}', 'char(10)')} as x").select("conv_id", "turn", trajectory.strip_critic(F.col("x")).alias("said"))
)
_ECHO = "concat('ls ', CAST(conv_id AS STRING)) AS command, concat(CASE WHEN turn % 2 = 0 THEN concat('ls ', CAST(conv_id AS STRING), {n}, '  ') WHEN turn % 3 = 0 THEN ' ls' ELSE '' END, text) AS output"
register("without_echo", f"SELECT conv_id, turn, CASE WHEN starts_with(output, command || chr(10)) THEN regexp_replace(substr(output, length(command) + 2), '^\\s+', '') ELSE output END AS shown FROM (SELECT conv_id, turn, {_ECHO.replace('{n}', 'chr(10)')} FROM conversations) c")(
    lambda s, d: _table(s, d, "conversations", "conv_id", "turn", *(f"{x}" for x in _ECHO.replace("{n}", "char(10)").split(" AS command, ")[:1]), "text").toDF("conv_id", "turn", "command", "text").selectExpr("conv_id", "turn", "command", _ECHO.replace("{n}", "char(10)").split(" AS command, ")[1]).select("conv_id", "turn", tx.without_echo(F.col("output"), F.col("command")).alias("shown"))
)
_HEADED = "concat(CASE turn % 3 WHEN 0 THEN concat('Tool: grep ', CAST(conv_id AS STRING), {n}, 'Result:', {n}) WHEN 1 THEN concat('Tool: x', {n}) ELSE '' END, text)"
register("result_headers", f"SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'grep ' || CAST(conv_id AS VARCHAR) END AS tool, md5(CASE WHEN turn % 3 = 1 THEN 'Tool: x' || chr(10) ELSE '' END || text) AS rest FROM conversations")(
    lambda s, d: _table(s, d, "conversations", "conv_id", "turn", f"{_HEADED.replace('{n}', 'char(10)')} as x").select("conv_id", "turn", tx.result_tool(F.col("x")).alias("tool"), F.md5(tx.without_result_header(F.col("x")).cast("binary")).alias("rest"))
)
_PROMPT = "concat('<|im_start|>user', {n}, 'q<|im_end|>', {n}, '<|im_start|>assistant', {n}, text, '<|im_end|>', {n}, CASE WHEN turn % 2 = 0 THEN concat('<|im_start|>assistant', {n}, 'open ', role) ELSE '' END)"
register("assistant_regions", "SELECT conv_id, turn, 1 + CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END::INT AS regions, md5(text || CASE WHEN turn % 2 = 0 THEN '|open ' || role ELSE '' END) AS texts FROM conversations")(
    lambda s, d: _table(s, d, "conversations", "conv_id", "turn", f"{_PROMPT.replace('{n}', 'char(10)')} as x").select("conv_id", "turn", tx.assistant_regions(F.col("x")).alias("r")).select("conv_id", "turn", F.size("r").alias("regions"), F.md5(F.array_join("r", "|").cast("binary")).alias("texts"))
)
register("outdated_rationales", "SELECT conv_id, turn, '*OUTDATED: aggregated: product*: ' || coalesce(CASE WHEN turn % 4 > 0 THEN role END, '') AS rationale FROM conversations")(lambda s, d: view(s, d, "conversations").select("conv_id", "turn", tx.outdated(F.when(F.col("turn") % 4 > 0, F.col("role")), "product").alias("rationale")))
_CONFIG = """CASE o_orderkey % 6 WHEN 0 THEN concat('<<"estimator":<<"estimator_type":"oh_gsn","graph_populator":<<"agent":<<"model_name":"p', CAST(o_custkey AS STRING), '">>>>,"graph_generator":<<"agent":<<"model_name":"g">>>>>>>>')
  WHEN 1 THEN '<<"estimator":<<"estimator_type":"oh_gsn","graph_generator":<<"agent":<<"model_name":"g">>>>>>>>' WHEN 2 THEN '<<"estimator":<<"estimator_type":"litellm_verbal","litellm":<<"agent":<<"model_name":"v">>>>>>>>'
  WHEN 3 THEN '<<"estimator":<<"estimator_type":"log_probs_estimator","agent":<<"model_name":"l">>>>>>' WHEN 4 THEN '<<"estimator":<<"estimator_type":"replay">>>>' ELSE '<<"estimator":<<"estimator_type":"gsn_aggregate">>>>' END""".replace("<<", "{").replace(">>", "}")
register("estimator_labels", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'p' || CAST(o_custkey AS VARCHAR) WHEN 1 THEN 'g' WHEN 2 THEN 'v' WHEN 3 THEN 'l' WHEN 4 THEN 'replay' ELSE 'N/A' END AS label FROM orders""")(
    lambda s, d: view(s, d, "orders").withColumn("c", F.expr(_CONFIG)).select("o_orderkey", reports.estimator_model(F.col("c")).alias("label"))
)


# ---------------------------------------------------------------- graphs

_NAMED = f"CASE WHEN id LIKE 'n%' OR (gid % 5 = 0 AND id LIKE 'c%' AND confidence > 0.95) THEN '{graphs.ROOT_NAME.replace(chr(39), chr(39) * 2)}' ELSE id END"
register("named_roots", f"""{G}, byname AS (SELECT gid, min(id) AS id FROM (SELECT gid, id, {_NAMED} AS name FROM gnodes) x WHERE name = '{graphs.ROOT_NAME.replace("'", "''")}' GROUP BY gid HAVING count(*) = 1),
given AS (SELECT DISTINCT gid, 'given' || CAST(gid AS VARCHAR) AS root FROM gnodes WHERE gid % 7 = 0) SELECT coalesce(b.gid, g.gid) AS gid, coalesce(g.root, b.id) AS root FROM byname b FULL JOIN given g ON g.gid = b.gid""")(
    lambda s, d: graphs.roots(view(s, d, "gnodes").withColumn("goal_name", F.expr(_NAMED.replace("''", "\\'"))), view(s, d, "gnodes").where("gid % 7 = 0").selectExpr("gid", "concat('given', cast(gid as string)) as root").distinct())
)
register("root_confidences", f"{G} SELECT gid, round(confidence, 6) AS confidence FROM gnodes WHERE id LIKE 'c%'")(
    lambda s, d: propagate.root_confidence(view(s, d, "gnodes"), view(s, d, "gnodes").where("id like 'c%'").select("gid", F.col("id").alias("root")).unionByName(view(s, d, "nation").selectExpr("n_nationkey as gid", "'lost' as root")))
)
register("dangling_edges", f"{with_views('badedges', 'gnodes')} SELECT e.gid, e.source, e.target, e.relationship_type FROM badedges e WHERE NOT EXISTS (SELECT 1 FROM gnodes n WHERE n.gid = e.gid AND n.id = e.source) OR NOT EXISTS (SELECT 1 FROM gnodes n WHERE n.gid = e.gid AND n.id = e.target)")(
    lambda s, d: graphs.dangling_edges(view(s, d, "gnodes"), view(s, d, "badedges"))
)
register("predecessor_contexts", f"""{G}, p AS (SELECT gid, target AS id, string_agg(source || ':' || relationship_type, ',' ORDER BY pos) AS predecessors FROM gedges GROUP BY gid, target) SELECT n.gid, n.id, p.predecessors FROM gnodes n LEFT JOIN p USING (gid, id)""")(
    lambda s, d: graphs.predecessor_contexts(view(s, d, "gnodes"), view(s, d, "gedges")).select("gid", "id", F.array_join(F.transform("predecessors", lambda x: F.concat(x["node"], F.lit(":"), x["relation"])), ",").alias("predecessors"))
)


# ---------------------------------------------------------------- runs

_RESULTS = with_views("results")
_RAW = "CASE WHEN ord % 3 = 0 THEN 1 - estimated_confidence END"
register("calibrated_resume", f"""{_RESULTS}, r AS (SELECT ord, coalesce({_RAW}, estimated_confidence) AS raw FROM results)
SELECT ord, round(raw, 6) AS raw_confidence, round(CASE WHEN raw <= 0 OR raw >= 1 THEN raw ELSE 1 / (1 + exp(-ln(raw / (1 - raw)) / 3)) END, 6) AS estimated_confidence FROM r""")(
    lambda s, d: calibrate(view(s, d, "results").selectExpr("ord", "estimated_confidence", f"{_RAW} as raw_confidence"), 3.0)
)
_FINISH = """user_id AS traj, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, event_id, CASE WHEN event_id % 2 = 0 THEN 'message' ELSE 'action' END AS kind, CASE WHEN event_id % 3 = 0 THEN 'user' ELSE 'assistant' END AS role,
  CASE WHEN event_id % 5 < 4 THEN 'finish' ELSE 'think' END AS tool_name, CASE WHEN event_id % 2 = 0 AND event_id % 8 = 0 THEN '  done ' WHEN event_id % 7 < 5 THEN 'done' ELSE 'other' END AS text"""
register("without_repeated_finish", f"""WITH e AS (SELECT {_FINISH} FROM events), n AS (SELECT *, lead(kind) OVER w AS nk, lead(tool_name) OVER w AS nt, lead(text) OVER w AS nx FROM e WINDOW w AS (PARTITION BY traj ORDER BY idx))
SELECT traj, event_id FROM n WHERE NOT coalesce(kind = 'message' AND role = 'assistant' AND nk = 'action' AND nt = 'finish' AND nx = trim(text), false)""")(
    lambda s, d: trajectory.drop_repeated_finish(s.sql(f"SELECT {_FINISH} FROM {{events}}", events=view(s, d, "events"))).select("traj", "event_id")
)
_AUDITED = """concat('i', CAST(o_orderkey AS STRING)) AS instance_id, CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE 'm' END AS model, 'p' AS problem_statement, CASE o_orderkey % 5 WHEN 0 THEN '/abs.jsonl' WHEN 1 THEN 'x.tar.gz' ELSE 'x.jsonl' END AS conversation_archive_path,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'b' END AS benchmark, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE true END AS resolved, CASE WHEN o_orderkey % 4 = 0 THEN 'native' ELSE 'acp' END AS trajectory_type, o_orderkey % 3 AS finishes, o_orderkey % 6 AS fallbacks, o_orderkey % 2 AS a, o_orderkey % 11 AS b"""
_TEXT = "concat(CASE WHEN a = 1 THEN concat('<action step=1>', {n}) ELSE '' END, CASE WHEN b > 1 THEN concat('<observation step=1>', {n}) ELSE '' END, CASE WHEN b = 5 THEN '<message role=user>' ELSE '' END, repeat('<combined_agent_messages>', CAST(b % 3 AS INT)))"
_SHORT = "concat('<summarized_action step=1>', {n}, CASE WHEN b = 7 THEN '' ELSE '<summarized_observation step=1>' END)"
_TESTS = [
    ("error", "blank_field", "trim(model) = ''"), ("error", "unsafe_path", "starts_with(conversation_archive_path, '/')"), ("error", "archive_is_no_record_file", "trajectory_type = 'acp' AND conversation_archive_path LIKE '%.tar.gz'"),
    ("error", "no_action", "a = 0"), ("error", "unpaired_actions", "a <> CASE WHEN b > 1 THEN 1 ELSE 0 END"), ("error", "user_message", "b = 5"), ("error", "condensed_actions", "a <> 1"),
    ("error", "condensed_observations", "CASE WHEN b = 7 THEN 0 ELSE 1 END <> CASE WHEN b > 1 THEN 1 ELSE 0 END"), ("error", "finish_blocks", "b % 3 <> finishes AND trajectory_type = 'acp'"), ("warning", "missing_benchmark", "benchmark = ''"),
    ("warning", "missing_label", "resolved IS NULL"), ("warning", "trajectory_type", "trajectory_type <> 'acp'"), ("warning", "unknown_content", "fallbacks > 0"), ("warning", "finish_count", "finishes <> 1"),
]
register("trajectory_audit", f"WITH r AS (SELECT {_AUDITED.replace('STRING', 'VARCHAR')} FROM orders) " + " UNION ALL ".join(f"SELECT instance_id, model, '{severity}' AS severity, '{code}' AS code FROM r WHERE {test}" for severity, code, test in _TESTS))(
    lambda s, d: audit.audit_trajectories(s.sql(f"SELECT *, {_TEXT.replace('{n}', 'char(10)')} AS text, {_SHORT.replace('{n}', 'char(10)')} AS condensed FROM (SELECT {_AUDITED} FROM {{orders}}) r", orders=view(s, d, "orders"))).select("instance_id", "model", "severity", "code")
)


# ---------------------------------------------------------------- what writers leave and readers find


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/written-{uuid.uuid4().hex}"


def _as_file(spark: SparkSession, folder: str, name: str) -> None:
    """The one part of a written folder, moved to ``name`` beside it."""
    fs, at = spark._jvm.org.apache.hadoop.fs, spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    (part,) = [f.getPath() for f in files.listStatus(at) if f.getPath().getName().startswith("part-")]
    files.rename(part, fs.Path(at.getParent(), name))
    files.delete(at, True)


def _results_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A results file for each run, in the run's folder, read together."""
    base, rows = _folder(spark), view(spark, sf_dir, "results_runs").withColumn("cost", F.lit(None).cast("double"))
    columns = [c.split()[0] for c in sources.RESULTS.split(", ")]
    for run in ("run-a", "run-b", "run-c"):
        sinks.results_csv(rows.where(F.col("run") == run).select(*columns).coalesce(1), f"{base}/{run}/parts")
        _as_file(spark, f"{base}/{run}/parts", "results.csv")
    return sources.results_csv(spark, base).drop("cost")


_FILED = "instance_id, model, benchmark, difficulty, resolved, round(estimated_confidence, 6) AS estimated_confidence, total_tokens, generated_tokens, run"
register("results_files", f"{with_views('results_runs')} SELECT {_FILED.replace('total_tokens, generated_tokens', 'total_tokens::BIGINT AS total_tokens, generated_tokens::BIGINT AS generated_tokens')} FROM results_runs")(_results_files)


def _graph_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Graphs written as a document each, read with the typed schema and taken apart again."""
    nodes = view(spark, sf_dir, "gnodes").select("gid", F.row_number().over(Window.partitionBy("gid").orderBy("id")).alias("pos"), "id", "kind", "confidence", "confidence_in_children")
    edges = view(spark, sf_dir, "gedges").select("gid", "pos", "source", "target", "relationship_type")
    path = _folder(spark)
    sinks.graph_json(nodes, edges, path)
    return sources.graph_tables(spark.read.schema(f"gid int, {sources.GRAPH}").json(path), F.col("gid"))


register("graph_document_nodes", f"{G} SELECT gid, (row_number() OVER (PARTITION BY gid ORDER BY id) - 1)::INT AS pos, id, kind, round(confidence, 6) AS confidence, round(confidence_in_children, 6) AS confidence_in_children FROM gnodes")(
    lambda s, d: _graph_documents(s, d)[0].select("gid", "pos", "id", "kind", "confidence", "confidence_in_children")
)
register("graph_document_edges", f"{G} SELECT gid, (row_number() OVER (PARTITION BY gid ORDER BY pos, source, target) - 1)::INT AS pos, source, target, relationship_type FROM gedges")(lambda s, d: _graph_documents(s, d)[1].select("gid", "pos", "source", "target", "relationship_type"))


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters of two attempts, one added to the other."""
    path, rows = _folder(spark), view(spark, sf_dir, "events").where("event_type = 'error'")
    for attempt in (1, 2):
        sinks.failures(rows.where(F.col("event_id") % 2 == attempt % 2).selectExpr("cast(event_id as string) as instance_id", "concat('m', cast(user_id as string)) as model", f"'attempt {attempt}' as error"), path)
    return spark.read.schema("instance_id string, model string, error string").json(path)


register("failure_letters", "SELECT CAST(event_id AS VARCHAR) AS instance_id, 'm' || CAST(user_id AS VARCHAR) AS model, CASE WHEN event_id % 2 = 1 THEN 'attempt 1' ELSE 'attempt 2' END AS error FROM events WHERE event_type = 'error'")(_failures)


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of a run, of which a second writer replaces every third and adds new ones."""
    path, rows = _folder(spark), view(spark, sf_dir, "results").selectExpr("'r' as run", "instance_id", "model", "estimated_confidence as confidence", "ord")
    key = ["run", "instance_id", "model"]
    store.write_store(rows.where("ord % 2 = 0").drop("ord"), key, path)
    store.write_store(rows.where("ord % 3 = 0").selectExpr("run", "instance_id", "model", "confidence / 2 as confidence"), key, path)
    return store.read_store(spark, path).select(*key, "confidence")


register("stored_outputs", f"{_RESULTS} SELECT 'r' AS run, instance_id, model, round(CASE WHEN ord % 3 = 0 THEN estimated_confidence / 2 ELSE estimated_confidence END, 6) AS confidence FROM results WHERE ord % 2 = 0 OR ord % 3 = 0")(_stored)


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested rows as a flat table: structs to columns, lists as JSON."""
    path = _folder(spark)
    sinks.flat_csv(view(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "named_struct('cust', o_custkey, 'more', named_struct('status', o_orderstatus)) as who", "array(o_orderkey % 3, o_orderkey % 5) as places"), path)
    return spark.read.schema("id long, who_cust long, who_more_status string, places string").csv(path, header=True)


register("flat_tables", "SELECT o_orderkey AS id, o_custkey AS who_cust, o_orderstatus AS who_more_status, '[' || CAST(o_orderkey % 3 AS VARCHAR) || ',' || CAST(o_orderkey % 5 AS VARCHAR) || ']' AS places FROM orders")(_flat)


def _record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories of JSON lines, one file each, with fields that no schema knows."""
    path = _folder(spark)
    lines = view(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "to_json(named_struct('type', case when turn % 2 = 0 then 'user_message' else 'agent_message' end, 'text', text, 'extra', turn * 2)) as line")
    files = lines.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("value"))
    files.repartition("conv_id").write.partitionBy("conv_id").text(path)
    got = sources.acp_records(spark, path).withColumn("conv_id", F.regexp_extract("traj", r"conv_id=(\d+)", 1).cast("long"))
    return got.select("conv_id", "idx", "type", F.md5(F.col("text").cast("binary")).alias("text"), F.try_variant_get("payload", "$.extra", "bigint").alias("extra"))


register("record_lines", "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS idx, CASE WHEN turn % 2 = 0 THEN 'user_message' ELSE 'agent_message' END AS type, md5(text) AS text, turn * 2 AS extra FROM conversations")(_record_lines)
