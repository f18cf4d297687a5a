"""Audits of runs: every check is a table of issues; a report is their union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verity.functions.scores import missing, values_equal
from verity.functions.text import nonblank, safe_relative_path
from verity.operators.metrics import METRICS, run_metrics

KEY = ("instance_id", "model")
ISSUE = "scope string, instance_id string, model string, severity string, code string, message string, details map<string,string>"


def issues(found: DataFrame, severity: str, code: str, message: str, details: Sequence[str] = (), scope: str = "item") -> DataFrame:
    """Rows with a key as issues; ``details`` are columns."""
    pairs = [x for c in details for x in (F.lit(c), F.col(c).cast("string"))]
    column = lambda c: F.col(c).cast("string") if c in found.columns else F.lit(None).cast("string")
    return found.select(F.lit(scope).alias("scope"), column("instance_id").alias("instance_id"), column("model").alias("model"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(message).alias("message"), (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>").alias("details"))


def duplicate_keys(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, key: Sequence[str] = KEY) -> None:
    if (found := duplicate_keys(df, key).limit(20).collect()):
        raise ValueError(f"duplicate keys: {found}")


def key_difference(left: DataFrame, right: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    return left.select(*key).distinct().join(right.select(*key), list(key), "left_anti")


def stale_metrics(results: DataFrame, stored: DataFrame, run: str = "run", tolerance: float = 1e-5) -> DataFrame:
    """(run, metric, stored, actual) where a stored metric differs from the recomputed one."""
    fresh = run_metrics(results, [run])
    names = [m for m in METRICS if m in stored.columns]
    long = lambda df, name: df.select(run, F.explode(F.create_map(*[x for m in names for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", name))
    both = long(stored, "stored").join(long(fresh, "actual"), [run, "metric"], "full")
    return both.where(~values_equal(F.col("stored"), F.col("actual"), tolerance))


def value_mismatches(results: DataFrame, outputs: DataFrame, columns: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """(key, column, result, output) of numbers that differ between a table and its outputs."""
    a = results.select(*key, *[F.col(c).cast("double").alias(f"a_{c}") for c in columns])
    b = outputs.select(*key, *[F.col(c).cast("double").alias(f"b_{c}") for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("result"), F.col(f"b_{c}").alias("output")) for c in columns]))
    return a.join(b, list(key)).select(*key, each.alias("x")).select(*key, "x.*").where(~values_equal(F.col("result"), F.col("output")))


def config_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Of flattened configurations (path, value, type): paths that are missing or differ in value or type."""
    a = left.select("path", F.col("value").alias("left_value"), F.col("type").alias("left_type"))
    b = right.select("path", F.col("value").alias("right_value"), F.col("type").alias("right_type"))
    both = a.join(b, "path", "full")
    return both.where(~(F.col("left_value").eqNullSafe(F.col("right_value")) & F.col("left_type").eqNullSafe(F.col("right_type"))))


def flatten_config(value: object, path: str = "") -> list[tuple[str, str | None, str]]:
    """(path, value, type) rows of a configuration document."""
    if isinstance(value, dict):
        return [r for k, v in sorted(value.items()) for r in flatten_config(v, f"{path}.{k}" if path else str(k))] or [(path, None, "dict")]
    if isinstance(value, list):
        return [r for i, v in enumerate(value) for r in flatten_config(v, f"{path}[{i}]")] or [(path, None, "list")]
    return [(path, None if value is None else str(value), type(value).__name__)]


# Columns on which a dataset and its results must agree, and the output's names of results.
PROVENANCE = ("problem_statement", "conversation_archive_path", "benchmark", "resolved", "trajectory_type")
OUTPUT_RESULT = {"confidence": "estimated_confidence", "total_tokens": "total_tokens", "generated_tokens": "generated_tokens", "cost": "cost"}
EXAMPLES = 20


def _whole(found: DataFrame, code: str, message: str, severity: str = "error", key: Sequence[str] = KEY) -> DataFrame:
    """One issue of a run, with the number of keys found and the first of them; none without any."""
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    rows = found.select(name.alias("k")).distinct()
    first = rows.orderBy("k").limit(EXAMPLES).agg(F.array_join(F.array_sort(F.collect_list("k")), ", ").alias("examples"))
    told = rows.agg(F.count(F.lit(1)).alias("count")).crossJoin(first).where("count > 0")  # one row each
    return issues(told, severity, code, message, ["count", "examples"], scope="run")


def missing_columns(result_columns: Sequence[str], wanted: Sequence[str], items: DataFrame, code: str) -> DataFrame | None:
    """An issue of every item for each column that the results lack."""
    lost = [c for c in wanted if c not in result_columns]
    if not lost:
        return None
    each = items.select(*KEY, F.explode(F.array(*map(F.lit, lost))).alias("field"))
    return issues(each, "error", code, "results lack a column", ["field"])


def provenance_mismatches(dataset: DataFrame, results: DataFrame, fields: Sequence[str] = PROVENANCE) -> DataFrame:
    """(key, field, dataset_value, result_value) where a result's copy of a dataset column differs."""
    both = [c for c in fields if c in dataset.columns and c in results.columns]
    pair = lambda df, name: df.select(*KEY, F.create_map(*[x for c in both for x in (F.lit(c), F.col(c).cast("string"))]).alias(name))
    if not both:
        return dataset.select(*KEY, F.lit("").alias("field"), F.lit("").alias("dataset_value"), F.lit("").alias("result_value")).where("false")
    joined = pair(dataset, "_d").join(pair(results, "_r"), list(KEY))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col("_d")[c].alias("dataset_value"), F.col("_r")[c].alias("result_value")) for c in both]))
    return joined.select(*KEY, each.alias("x")).select(*KEY, "x.*").where(~F.col("dataset_value").eqNullSafe(F.col("result_value")))


def audit_graphs(outputs: DataFrame, graph_roots: DataFrame) -> DataFrame:
    """Issues of outputs (key, confidence) against their graphs' roots (key, root, confidence): no
    graph, no root, and another confidence."""
    g = graph_roots.select(*KEY, F.lit(True).alias("_there"), F.col("root").alias("_root"), F.col("confidence").alias("graph_confidence"))
    both = outputs.select(*KEY, F.col("confidence").alias("output_confidence")).join(g, list(KEY), "left")
    there, rooted = F.col("_there").isNotNull(), F.col("_root").isNotNull()
    return (
        issues(both.where(~there), "error", "missing_graph", "an output has no graph")
        .unionByName(issues(both.where(there & ~rooted), "error", "missing_graph_root", "a graph has no root"))
        .unionByName(issues(both.where(there & rooted & ~values_equal(F.col("graph_confidence"), F.col("output_confidence"))), "error", "graph_output_confidence_mismatch", "the root's confidence is not the output's", ["graph_confidence", "output_confidence"]))
    )


def audit_config(spark: SparkSession, target_text: str, saved_text: str | None, target: dict, saved: dict | None, dataset: str | None = None, split: str | None = None) -> DataFrame:
    """Issues of a run's configuration (two documents on the driver): a lost or invalid copy, fields
    that differ, texts that differ alone (a warning), and another dataset or split than asked for."""
    found: list[tuple[str, str, str, dict[str, str]]] = []
    if saved_text is None:
        found.append(("error", "missing_saved_config", "the run keeps no configuration", {}))
    elif not isinstance(saved, dict):
        found.append(("error", "invalid_saved_config", "the kept configuration is no object", {}))
    else:
        rows = lambda doc: spark.createDataFrame(flatten_config(doc), "path string, value string, type string")
        apart = [r["path"] for r in config_difference(rows(target), rows(saved)).select("path").orderBy("path").collect()]
        if apart:
            found.append(("error", "saved_config_field_mismatch", "the kept configuration differs", {"fields": ", ".join(apart)}))
        elif saved_text != target_text:
            found.append(("warning", "saved_config_text_mismatch", "the configurations differ as texts alone", {}))
    own = target.get("dataset", {})
    for code, asked, there in (("dataset_argument_config_mismatch", dataset, own.get("path")), ("split_argument_config_mismatch", split, own.get("split"))):
        if asked is not None and asked != there:
            found.append(("error", code, "the argument differs from the configuration", {"argument": str(asked), "config": str(there)}))
    estimator = target.get("estimator", {})
    if estimator.get("estimator_type") == "oh_gsn" and (estimator.get("graph_generator") or {}).get("generator_type") != "agentic":
        found.append(("error", "non_agentic_oh_gsn_generator", "the graph generator is not the agentic one", {}))
    return spark.createDataFrame([("run", None, None, *row) for row in found], ISSUE)


def audit_run(dataset: DataFrame, results: DataFrame | None, outputs: DataFrame, failures: DataFrame | None = None, stored_metrics: DataFrame | None = None, graph_roots: DataFrame | None = None) -> DataFrame:
    """Issues of a run as one table (ISSUE), each check a join or a grouping.

    ``outputs``: key, and any of OUTPUT_RESULT; ``stored_metrics``: one row of METRICS; ``graph_roots``
    for runs that make graphs. A run without results (None) has that issue and lacks all predictions.
    """
    spark = dataset.sparkSession
    run_issue = lambda severity, code, message: spark.createDataFrame([("run", None, None, severity, code, message, {})], ISSUE)
    checks = [_whole(duplicate_keys(dataset), "duplicate_dataset_keys", "keys of the dataset repeat")]
    keys = dataset.select(*KEY).distinct()
    if results is None:
        checks.append(run_issue("error", "missing_results", "the run has no results"))
        lost = keys
    else:
        lost = key_difference(dataset, results)
        c = F.col("estimated_confidence")
        checks += [
            _whole(duplicate_keys(results), "duplicate_result_keys", "keys of the results repeat"),
            _whole(key_difference(results, dataset), "extra_results", "results that are not in the dataset"),
            issues(results.where(~nonblank(F.col("instance_id")) | ~nonblank(F.col("model"))), "error", "item_audit_exception", "a key is blank"),
            issues(results.where(missing(c) | ~c.between(0.0, 1.0)), "error", "item_audit_exception", "a confidence is missing or not in [0, 1]", ["estimated_confidence"]),
            issues(provenance_mismatches(dataset, results), "error", "result_dataset_mismatch", "a result differs from its dataset row", ["field", "dataset_value", "result_value"]),
        ]
        there = keys.join(results.select(*KEY), list(KEY), "left_semi")
        checks += [x for x in (missing_columns(results.columns, [c for c in PROVENANCE if c in dataset.columns], there, "missing_result_provenance_field"), missing_columns(results.columns, [r for o, r in OUTPUT_RESULT.items() if o in outputs.columns], there, "missing_result_output_field")) if x is not None]
        shared = [r for o, r in OUTPUT_RESULT.items() if o in outputs.columns and r in results.columns]
        named = outputs.select(*KEY, *[F.col(o).alias(r) for o, r in OUTPUT_RESULT.items() if o in outputs.columns])
        if shared:
            checks.append(issues(value_mismatches(results.join(keys, list(KEY), "left_semi"), named, shared), "error", "result_output_mismatch", "result and output differ", ["column", "result", "output"]))
        if stored_metrics is None:
            checks.append(run_issue("error", "missing_metrics", "the run has no metrics"))
        else:
            one = lambda df: df.withColumn("run", F.lit("run"))
            checks.append(_whole(stale_metrics(one(results), one(stored_metrics)), "stale_metrics", "stored metrics differ from recomputed ones", key=["metric"]))
    cut_at = 120
    if failures is not None:
        why = failures.groupBy(*KEY).agg(F.min("error").alias("_e")).withColumn("failure", F.left("_e", F.lit(cut_at))).withColumn("failure_truncated", F.length("_e") > cut_at)
        lost = lost.join(why.drop("_e"), list(KEY), "left")
        severity = "error" if not lost.isEmpty() else "warning"
        checks += [_whole(duplicate_keys(failures), "duplicate_failure_keys", "keys of the failures repeat"), _whole(failures, "recorded_failures", "the run has failures", severity)]
    checks += [
        issues(lost, "error", "missing_prediction", "a dataset row has no result", ["failure", "failure_truncated"] if failures is not None else []),
        issues(key_difference(dataset, outputs), "error", "missing_output", "a dataset row has no output"),
        _whole(key_difference(outputs, dataset), "orphan_outputs", "outputs that are not in the dataset", "warning"),
    ]
    if graph_roots is not None:
        checks.append(audit_graphs(outputs.join(keys, list(KEY), "left_semi"), graph_roots))
    out = checks[0]
    for other in checks[1:]:
        out = out.unionByName(other)
    return out


def audit_trajectories(rows: DataFrame) -> DataFrame:
    """Errors and warnings of rows (key and dataset columns) with their renderings: ``text`` from the
    first action on, ``condensed`` with no step cited, and ``finishes``, the number of finish actions.
    ``fallbacks`` (if there) counts calls whose content is of an unknown shape."""
    tag = lambda column, name: F.regexp_count(column, F.lit(rf"(?m)^<{name} step="))
    path = F.col("conversation_archive_path")
    counted = rows.withColumn("actions", tag("text", "action")).withColumn("observations", tag("text", "observation"))
    fallbacks = F.col("fallbacks") > 0 if "fallbacks" in rows.columns else F.lit(False)
    blocks = F.regexp_count("text", F.lit("<combined_agent_messages>"))
    tests = [
        ("error", "blank_field", ~nonblank(F.col("instance_id")) | ~nonblank(F.col("model")) | ~nonblank(F.col("problem_statement")) | ~nonblank(path)),
        ("error", "unsafe_path", ~safe_relative_path(path)),
        ("error", "archive_is_no_record_file", (F.col("trajectory_type") == "acp") & path.endswith(".tar.gz")),
        ("error", "no_action", F.col("actions") == 0),
        ("error", "unpaired_actions", F.col("actions") != F.col("observations")),
        ("error", "user_message", F.col("text").contains("<message role=user>")),
        ("error", "condensed_actions", tag("condensed", "summarized_action") != F.col("actions")),
        ("error", "condensed_observations", tag("condensed", "summarized_observation") != F.col("observations")),
        ("error", "finish_blocks", (blocks != F.col("finishes")) & (F.col("trajectory_type") == "acp")),
        ("warning", "missing_benchmark", ~nonblank(F.col("benchmark"))),
        ("warning", "missing_label", F.col("resolved").isNull()),
        ("warning", "trajectory_type", F.col("trajectory_type") != "acp"),
        ("warning", "unknown_content", fallbacks),
        ("warning", "finish_count", F.col("finishes") != 1),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))) for severity, code, test in tests]))
    each = counted.withColumn("_x", F.explode(found))
    return each.select(F.lit("item").alias("scope"), "instance_id", "model", "_x.severity", "_x.code", F.col("_x.code").alias("message"), F.create_map(F.lit("actions"), F.col("actions").cast("string"), F.lit("observations"), F.col("observations").cast("string")).alias("details"))


def roll_up(found: DataFrame, items: DataFrame) -> DataFrame:
    """(instance_id, model, status): error before warning before ok; issues of a run are no item's."""
    found = found.where(F.col("scope") == "item")
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    worst = found.groupBy(*KEY).agg(F.max(rank).alias("_r"), F.count(F.lit(1)).alias("issues"))
    status = F.element_at(F.array(*map(F.lit, ("ok", "warning", "error"))), F.coalesce("_r", F.lit(0)) + 1)
    return items.select(*KEY).distinct().join(worst, list(KEY), "left").select(*KEY, status.alias("status"), F.coalesce("issues", F.lit(0)).alias("issues"))
