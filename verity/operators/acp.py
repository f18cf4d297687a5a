"""Tool calls of the agent protocol, from their raw input, output and content blocks (JSON)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verity.functions.summaries import call_action_summary, call_observation_summary
from verity.functions.text import call_input, resolved_output
from verity.operators.trajectory import snapshot_index, summary_block
from verity.sources.loose import kind_of

EDIT = "struct<path:string,old_text:string,new_text:string>"
NO_PATH = "a call names no file"
#: Fields of a raw output that tell a command.
COMMAND_FIELDS = ("command", "aggregated_output", "formatted_output")
BLOCK = "array<struct<type:string,content:struct<type:string,text:string>,path:string,old_text:string,new_text:string>>"


def _at(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _string(value: Column, name: str) -> Column:
    """A field that is a string; null for any other kind."""
    return F.when(kind_of(_at(value, name)) == "STRING", F.try_variant_get(value, f"$.{name}", "string"))


def file_edits(content: Column) -> Column:
    """The edits (path, old_text, new_text) of content blocks (JSON): all blocks must be diffs with a path
    and a new text, and an old text or none; else, and without a block, null."""
    v = F.try_parse_json(content)
    blocks = F.when(kind_of(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))
    told = F.transform(blocks, lambda b: F.struct(_string(b, "path").alias("path"), _string(b, "old_text").alias("old_text"), _string(b, "new_text").alias("new_text")))
    old = lambda b: F.coalesce(kind_of(_at(b, "old_text")).isin("STRING", "VOID"), F.lit(True))
    fits = F.forall(blocks, lambda b: F.coalesce(_string(b, "type") == "diff", F.lit(False)) & _string(b, "path").isNotNull() & _string(b, "new_text").isNotNull() & old(b))
    return F.when((F.size(blocks) > 0) & fits, told)


def file_operation(call_kind: Column, raw_input: Column, edits: Column, status: Column) -> Column:
    """(operation, path, problem) of a call that reads or edits: its path from the input (``file_path``
    if it is there, else ``path``), else the one key of ``changes``, else that of the only edit. Without
    any, a command and a failed call are of no file, and another has a problem."""
    v = F.try_parse_json(raw_input)
    is_object = F.coalesce(kind_of(v) == "OBJECT", F.lit(False))
    named = F.when(_at(v, "file_path").isNotNull(), _string(v, "file_path")).otherwise(_string(v, "path"))
    changed = F.map_keys(F.when(kind_of(_at(v, "changes")) == "OBJECT", F.try_variant_get(v, "$.changes", "map<string,variant>")))
    path = F.coalesce(F.when(is_object, named), F.when(is_object & (F.size(changed) == 1), changed[0]), F.when(F.size(edits) == 1, edits[0]["path"]))
    operation = F.when(call_kind == "read", "view").when(call_kind == "edit", "edit")
    bare = (is_object & _at(v, "command").isNotNull()) | F.coalesce(status == "failed", F.lit(False))
    there = operation.isNotNull() & path.isNotNull()
    problem = F.when(operation.isNotNull() & path.isNull() & ~F.coalesce(bare, F.lit(False)), F.lit(NO_PATH))
    return F.struct(F.when(there, operation).alias("operation"), F.when(there, path).alias("path"), problem.alias("problem"))


def call_output(raw_output: Column, content: Column, call_kind: Column) -> Column:
    """The output of a call as text, see ``resolved_output``."""
    v = F.try_parse_json(raw_output)
    command = F.coalesce(kind_of(v) == "OBJECT", F.lit(False)) & F.coalesce(*[F.when(_at(v, c).isNotNull(), F.lit(True)) for c in COMMAND_FIELDS], F.lit(False))
    told = F.when(kind_of(v) != "VOID", raw_output)
    return resolved_output(command, _string(v, "formatted_output"), F.from_json(content, BLOCK), content, told, call_kind)


def calls_of(snapshots: DataFrame, key: str = "traj") -> DataFrame:
    """One row per call of ``snapshots`` (key, idx, tool_call_id, call_kind, title, status, raw_input,
    raw_output, content): step, first and last place, and from its newest input and its terminal
    snapshot what it did: shown_input, summary, command, edits, operation, path, output, status."""
    index = snapshot_index(snapshots.withColumn("input", F.col("raw_input")), key)
    terminal = snapshots.select(F.col(key).alias("_k"), F.col("tool_call_id").alias("_c"), F.col("idx").alias("_i"), "status", "raw_output", F.col("content").alias("blocks"))
    both = index.join(terminal, (index[key] == terminal["_k"]) & (index["tool_call_id"] == terminal["_c"]) & (index["last_idx"] == terminal["_i"])).drop("_k", "_c", "_i")
    v = F.try_parse_json("input")
    told = both.withColumn("edits", file_edits(F.col("blocks"))).withColumn("file", file_operation(F.col("call_kind"), F.col("input"), F.col("edits"), F.col("status")))
    checked = F.when(F.col("file.problem").isNotNull(), F.raise_error(F.concat("file.problem", F.lit(": "), "tool_call_id")).cast("string"))
    return told.select(
        key, "tool_call_id", "step", "first_idx", "last_idx", "title", "call_kind", "status", "edits", F.coalesce(checked, F.col("file.operation")).alias("operation"), F.col("file.path").alias("path"),
        call_input(F.col("input"), F.col("title")).alias("shown_input"), F.coalesce(F.nullif(_string(v, "description"), F.lit("")), _string(v, "summary")).alias("summary"), _string(v, "command").alias("command"),
        call_output(F.col("raw_output"), F.col("blocks"), F.col("call_kind")).alias("output"),
    )


def condense_raw_calls(snapshots: DataFrame, cited: DataFrame, key: str = "traj") -> DataFrame:
    """(key, idx, tool_call_id, step, summary): calls whose step is not cited (key, step) as a summary at
    the first and one at the terminal snapshot (the snapshots between go); every snapshot of cited calls
    with a null summary. A call without output, or one that reads or edits no named file, is an error."""
    calls = calls_of(snapshots, key)
    marks = cited.select(F.col(key).alias("_k"), F.col("step").alias("_s")).distinct()
    own = calls.join(marks, (calls[key] == marks["_k"]) & (calls["step"] == marks["_s"]), "left")
    tool = F.coalesce("call_kind", F.lit("unknown"))
    begun = summary_block("action", F.col("step"), call_action_summary(tool, F.col("title"), F.col("shown_input"), summary=F.col("summary"), command=F.col("command"), operation=F.col("operation"), path=F.col("path")))
    only = F.when(F.size("edits") == 1, F.col("edits")[0])
    ended = summary_block("observation", F.col("step"), call_observation_summary(tool, F.col("status"), F.col("output"), operation=F.col("operation"), path=F.col("path"), old=only["old_text"], new=only["new_text"]))
    short = own.where("_s is null").select(key, "tool_call_id", "step", "first_idx", "last_idx", begun.alias("begun"), ended.alias("ended"))
    alone = F.col("first_idx") == F.col("last_idx")
    parts = F.when(alone, F.array(F.struct(F.col("first_idx").alias("idx"), F.concat_ws("\n\n", "begun", "ended").alias("summary")))).otherwise(F.array(F.struct(F.col("first_idx").alias("idx"), F.col("begun").alias("summary")), F.struct(F.col("last_idx").alias("idx"), F.col("ended").alias("summary"))))
    summed = short.select(key, "tool_call_id", "step", F.explode(parts).alias("p")).select(key, "p.idx", "tool_call_id", "step", "p.summary")
    whole = own.where("_s is not null").select(F.col(key).alias("_k"), F.col("tool_call_id").alias("_c"), "step")
    kept = snapshots.join(whole, (snapshots[key] == whole["_k"]) & (snapshots["tool_call_id"] == whole["_c"])).select(key, "idx", snapshots["tool_call_id"], "step", F.lit(None).cast("string").alias("summary"))
    return summed.unionByName(kept)
