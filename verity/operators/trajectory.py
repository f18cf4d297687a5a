"""Event logs of finished runs: steps, branches, prefixes, snapshots, condensing and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verity.functions.summaries import action_summary, call_action_summary, call_observation_summary, observation_summary
from verity.functions.text import call_parts, content, json_object, rstrip, strip, without_result_header
from verity.plans.tables import cut, cut_counted

TERMINAL = ("completed", "failed")


def _log(key: str = "traj", order: str = "idx"):
    return Window.partitionBy(key).orderBy(order)


def action_steps(events: DataFrame, key: str = "traj") -> DataFrame:
    """Events with ``step``: the 1-based number of the latest action, 0 before the first."""
    upto = _log(key).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("step", F.coalesce(F.sum((F.col("kind") == "action").cast("int")).over(upto), F.lit(0)))


def with_action(events: DataFrame, key: str = "traj") -> DataFrame:
    """Observations and errors with ``of_step``, the number of the action that they answer, null where
    they answer none that came before.

    An observation names its action by ``action_id``; an error names a ``tool_call_id`` and answers the
    latest action with it. Both kinds of names are found in one pass: the events that speak of one name
    are laid out in order, and each takes the last action before it.
    """
    is_action, is_seen = F.col("kind") == "action", F.col("kind") == "observation"
    name = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("name"))
    names = F.when(is_action, F.array(name("id", "event_id"), name("call", "tool_call_id"))).when(is_seen, F.array(name("id", "action_id"))).when(F.col("kind") == "error", F.array(name("call", "tool_call_id")))
    spoken = action_steps(events, key).select("*", F.explode(names).alias("_name"))
    upto = Window.partitionBy(key, "_name").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    named = F.col("_name.name").isNotNull()
    of = F.when(named, F.last(F.when(is_action, F.col("step")), ignorenulls=True).over(upto))
    return spoken.withColumn("of_step", of).where(~is_action).drop("_name", "step")


def observations_with_action(events: DataFrame, key: str = "traj") -> DataFrame:
    """Observations with the step of their action (``of_step``); none is an error."""
    lost = F.raise_error(F.concat(F.lit("an observation is of no action before it: "), F.col("event_id").cast("string"))).cast("long")
    return with_action(events, key).where("kind = 'observation'").withColumn("of_step", F.coalesce(F.col("of_step").cast("long"), lost))


def errors_with_action(events: DataFrame, key: str = "traj") -> DataFrame:
    """Errors with the step of the latest action of their call (``of_step``); none is an error."""
    lost = F.raise_error(F.concat(F.lit("an error is of no call before it: "), F.col("event_id").cast("string"))).cast("long")
    return with_action(events, key).where("kind = 'error'").withColumn("of_step", F.coalesce(F.col("of_step").cast("long"), lost))


UNKNOWN_ACTION, UNKNOWN_CALL, MISSING = "an observation is of no action before it", "an error is of no call before it", "an action has no observation"


def prefix_cuts(events: DataFrame, k: int, key: str = "traj") -> DataFrame:
    """(key, cut, problem) of each log for its prefix of ``k`` actions: the greatest index that stays
    (null: all of it) and what stands against a prefix (null: nothing).

    Actions may overlap: each spans from itself to the last of its observations and errors, and the
    prefix ends with the longest span of the first ``k`` actions. Without ``k`` actions a log stays
    whole. For k = 0 it ends before the first action, for -1 all stays and nothing is checked.
    """
    if k < -1:
        raise ValueError("k is -1 or more")
    if k == -1:
        return events.select(key).distinct().select(key, F.lit(None).cast("long").alias("cut"), F.lit(None).cast("string").alias("problem"))
    is_action = F.col("kind") == "action"
    if k == 0:
        first, early = F.min(F.when(is_action, F.col("idx"))), F.min(F.when(F.col("kind") == "observation", F.col("idx")))
        found = events.groupBy(key).agg(first.alias("_first"), early.alias("_early"))
        problem = F.when(F.col("_early") < F.coalesce("_first", F.col("_early") + 1), F.lit(UNKNOWN_ACTION))
        return found.select(key, (F.col("_first") - 1).cast("long").alias("cut"), problem.alias("problem"))
    seen = with_action(events, key)
    chosen = F.col("of_step").between(1, k)
    spans = seen.groupBy(key).agg(
        F.max(F.when(chosen, F.col("idx"))).cast("long").alias("_end"), F.countDistinct(F.when(chosen, F.col("of_step"))).alias("_answered"),
        F.max(F.col("of_step").isNull() & (F.col("kind") == "observation")).alias("_no_action"), F.max(F.col("of_step").isNull() & (F.col("kind") == "error")).alias("_no_call"),
    )
    logs = events.groupBy(key).agg(F.count_if(is_action).alias("_actions")).withColumnRenamed(key, "_key")
    both = logs.join(spans, logs["_key"].eqNullSafe(spans[key]), "left")
    short = F.col("_actions") < k
    problem = F.when(F.col("_no_action"), F.lit(UNKNOWN_ACTION)).when(F.col("_no_call"), F.lit(UNKNOWN_CALL)).when(~short & (F.coalesce("_answered", F.lit(0)) < k), F.lit(MISSING))
    return both.select(F.col("_key").alias(key), F.when(~short, F.col("_end")).alias("cut"), problem.alias("problem"))


def prefix_after_actions(events: DataFrame, k: int, key: str = "traj") -> DataFrame:
    """Events up to the last observation or error of the first ``k`` actions, see ``prefix_cuts``; what
    stands against it is an error. ``events``: key, idx, event_id, kind, action_id, tool_call_id."""
    if k == -1:
        return events
    cuts = prefix_cuts(events, k, key).withColumnRenamed(key, "_key")
    joined = events.join(cuts, events[key].eqNullSafe(cuts["_key"]))
    told = F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem")).cast("boolean")).otherwise(F.coalesce(F.col("idx") <= F.col("cut"), F.lit(True)))
    return joined.where(told).select(*[events[c] for c in events.columns])


def from_first_action(events: DataFrame, key: str = "traj") -> DataFrame:
    """Events from the first action on; runs without an action vanish (see the audit)."""
    first = F.min(F.when(F.col("kind") == "action", F.col("idx"))).over(Window.partitionBy(key))
    return events.withColumn("_first", first).where("idx >= _first").drop("_first")


def active_branch(events: DataFrame, leaf: DataFrame, key: str = "traj", max_levels: int = 1 << 20) -> DataFrame:
    """Events from the root of the log to its ``leaf`` (key, event_id), with ``place`` from 0.

    Ancestors are found by doubling: after round r every event knows its ancestor 2^r up, so a branch
    of n events takes log2 n rounds of joins.
    """
    up = cut(events.select(key, F.col("event_id").alias("at"), F.col("parent_id").alias("above")), "branch-up")
    reach, n = cut_counted(leaf.select(key, F.col("event_id").alias("at"), F.lit(0).cast("long").alias("depth")), "branch-reach")
    step = 1
    while step < max_levels:
        jump = up.where("above is not null").withColumnRenamed("at", "_at")
        new = reach.join(jump, (reach[key] == jump[key]) & (reach["at"] == jump["_at"])).select(reach[key], F.col("above").alias("at"), (F.col("depth") + step).alias("depth"))
        before = n
        reach, n = cut_counted(reach.unionByName(new), "branch-reach")
        if n == before:
            break
        twice = up.select(F.col(key).alias("_k"), F.col("at").alias("_at"), F.col("above").alias("_above"))
        up = cut(up.join(twice, (up[key] == twice["_k"]) & (up["above"] == twice["_at"]), "left").select(key, "at", F.col("_above").alias("above")), "branch-up")
        step *= 2
    low = F.max("depth").over(Window.partitionBy(key))
    placed = reach.withColumn("place", low - F.col("depth")).select(F.col(key).alias("_k"), F.col("at").alias("_at"), "place")
    return events.join(placed, (events[key] == placed["_k"]) & (events["event_id"] == placed["_at"])).select(*[events[c] for c in events.columns], "place")


def default_leaf(events: DataFrame, key: str = "traj") -> DataFrame:
    """Where no leaf is recorded: the last event if it has no parent, else none."""
    last = events.groupBy(key).agg(F.max_by(F.struct("event_id", "parent_id"), "idx").alias("e"))
    return last.where("e.parent_id is null").select(key, "e.event_id")


def first_seen_ids(events: DataFrame, column: str, key: str = "traj", pattern: str = "tool_call_%04d") -> DataFrame:
    """Events with ``stable_id``: ids renumbered in the order in which they first appear."""
    first = F.min("idx").over(Window.partitionBy(key, column))
    ranked = events.withColumn("_first", F.when(F.col(column).isNotNull(), first))
    place = F.dense_rank().over(Window.partitionBy(key).orderBy(F.col("_first").asc_nulls_last()))
    return ranked.withColumn("stable_id", F.when(F.col("_first").isNotNull(), F.format_string(pattern, place))).drop("_first")


def merge_adjacent_snapshots(calls: DataFrame, key: str = "traj") -> DataFrame:
    """Two adjacent records of one call are merged if the first is finished, a tool or skill without
    title but with content, and the second a pending read, edit or other with a title and no content:
    the second goes and the first takes its title and kind. ``conflict`` marks any other adjacent
    repetition of an id. Every pair is told from its own two records, so three in a row conflict."""
    w = _log(key)
    nxt = lambda c: F.lead(c).over(w)
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    same = F.coalesce(nxt("tool_call_id") == F.col("tool_call_id"), F.lit(False))
    first = F.col("status").isin(*TERMINAL) & F.col("call_kind").isin("tool", "skill") & blank(F.col("title")) & ~blank(F.col("content"))
    second = (nxt("status") == "pending") & nxt("call_kind").isin("read", "edit", "other") & ~blank(nxt("title")) & blank(nxt("content"))
    marked = calls.withColumn("_again", same).withColumn("_pair", F.coalesce(same & first & second, F.lit(False))).withColumn("_title", nxt("title")).withColumn("_kind", nxt("call_kind"))
    out = marked.withColumn("_gone", F.coalesce(F.lag("_pair").over(w), F.lit(False)))
    out = out.withColumn("title", F.when(F.col("_pair"), F.col("_title")).otherwise(F.col("title"))).withColumn("call_kind", F.when(F.col("_pair"), F.col("_kind")).otherwise(F.col("call_kind")))
    return out.where("not _gone").withColumn("conflict", F.col("_again") & ~F.col("_pair")).drop("_pair", "_title", "_kind", "_again", "_gone")


def snapshot_index(calls: DataFrame, key: str = "traj") -> DataFrame:
    """One row per call: ``step`` by first appearance, the newest non-empty title, kind and input, the
    terminal status, and whether there is exactly one terminal snapshot and it is last."""
    terminal = F.col("status").isin(*TERMINAL)
    newest = lambda c: F.max_by(F.expr(f"nullif({c}, '')"), F.when(F.expr(f"nullif({c}, '')").isNotNull(), F.col("idx")))
    per = calls.groupBy(key, "tool_call_id").agg(
        F.min("idx").alias("first_idx"),
        F.max("idx").alias("last_idx"),
        F.count(F.lit(1)).alias("snapshots"),
        newest("title").alias("title"),
        newest("call_kind").alias("call_kind"),
        newest("input").alias("input"),
        F.max_by("status", F.when(terminal, F.col("idx"))).alias("terminal"),
        ((F.count_if(terminal) == 1) & (F.max(F.when(terminal, F.col("idx"))) == F.max("idx"))).alias("valid"),
    )
    return per.withColumn("step", F.dense_rank().over(Window.partitionBy(key).orderBy("first_idx")))


def summary_block(what: str, step: Column, text: Column) -> Column:
    """``what`` is action or observation."""
    return F.concat(F.lit(f"<summarized_{what} step="), step.cast("string"), F.lit(">\n"), text, F.lit(f"\n</summarized_{what}>"))


def condense(events: DataFrame, cited: DataFrame, key: str = "traj") -> DataFrame:
    """Events whose step is not cited (key, step) become summaries: kind ``summary`` and a tagged text.

    Actions and observations (errors too) are matched by ``tool_call_id``; an observation without an
    action is an error. Ids, times and parents stay, and so do all other events. The columns that the
    summaries are made of may be absent: summary, arguments, command, path, exit_code, is_error,
    observed_command, old_content, new_content. ``step`` is added, and ``render`` keeps it, so that
    actions keep their numbers.
    """
    have = set(events.columns)
    text = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    is_action, is_seen = F.col("kind") == "action", F.col("kind").isin("observation", "error")
    numbered = action_steps(events, key)
    actions = numbered.where(is_action).groupBy(F.col(key).alias("_k"), F.col("tool_call_id").alias("_id")).agg(F.min(F.struct("step", text("command").alias("asked"), text("operation").alias("operation"), text("path").alias("path"))).alias("_a"))
    marks = cited.select(F.col(key).alias("_ck"), F.col("step").alias("_s")).distinct()
    joined = numbered.join(actions, (numbered[key] == actions["_k"]) & (numbered["tool_call_id"] == actions["_id"]), "left")
    step = F.when(is_action, F.col("step")).otherwise(F.col("_a.step"))
    joined = joined.withColumn("_step", F.when(is_seen & F.col("_a").isNull(), F.raise_error(F.lit("an observation has no action")).cast("long")).otherwise(step.cast("long")))
    both = joined.join(marks, (joined[key] == marks["_ck"]) & (joined["_step"] == marks["_s"]), "left")
    uncited = F.col("_s").isNull()
    done = action_summary(F.col("tool_name"), text("summary"), text("arguments"), F.coalesce(text("operation"), text("command")), text("path"))
    result = strip(F.coalesce(text("text"), F.lit("")))
    operation = F.coalesce(F.col("_a.operation"), F.col("_a.asked"))
    seen = observation_summary(
        F.col("tool_name"), result, command=text("observed_command"), asked=F.col("_a.asked"), exit_code=text("exit_code"), operation=operation, path=F.coalesce(F.col("_a.path"), text("path")),
        failed=F.col("is_error") if "is_error" in have else F.col("kind") == "error", old=text("old_content"), new=text("new_content"),
    )
    shown = F.when(is_action & uncited, summary_block("action", F.col("_step"), done)).when(is_seen & uncited, summary_block("observation", F.col("_step"), seen)).otherwise(text("text"))
    kind = F.when((is_action | is_seen) & uncited, F.lit("summary")).otherwise(F.col("kind"))
    call = F.when(~uncited | ~(is_action | is_seen), F.col("tool_call_id"))
    changed = {"kind": kind, "text": F.col("_shown"), "tool_call_id": call}
    both = both.withColumn("_shown", shown)
    return both.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in events.columns if c != "step"], "step")


def condense_calls(calls: DataFrame, cited: DataFrame, key: str = "traj") -> DataFrame:
    """Snapshots of calls that are not cited shrink to a summary at the first and one at the terminal
    snapshot (``summary``: the tagged text); those between go. Snapshots of cited calls and records
    that are no calls stay with a null summary. ``content`` is the call's output as text."""
    index = snapshot_index(calls, key).select(F.col(key).alias("_k"), F.col("tool_call_id").alias("_id"), "step", "first_idx", "last_idx", F.col("title").alias("_title"), F.col("call_kind").alias("_kind"), F.col("input").alias("_input"))
    joined = calls.join(index, (calls[key] == index["_k"]) & (calls["tool_call_id"] == index["_id"]), "left").drop("_k", "_id")
    marks = cited.select(F.col(key).alias("_k"), F.col("step").alias("_s")).distinct()
    both = joined.join(marks, (joined[key] == marks["_k"]) & (joined["step"] == marks["_s"]), "left")
    plain = F.col("_s").isNotNull() | F.col("step").isNull()
    first, last = F.col("idx") == F.col("first_idx"), F.col("idx") == F.col("last_idx")
    tool = F.coalesce("_kind", F.lit("unknown"))
    begun = summary_block("action", F.col("step"), call_action_summary(tool, F.col("_title"), F.coalesce("_input", F.lit("{}"))))
    ended = summary_block("observation", F.col("step"), call_observation_summary(tool, F.col("status"), F.coalesce("content", F.lit("<empty>"))))
    summary = F.when(~plain, F.concat_ws("\n\n", F.when(first, begun), F.when(last, ended)))
    return both.where(plain | first | last).withColumn("summary", summary).drop("_k", "_s", "first_idx", "last_idx", "_title", "_kind", "_input")


def acp_to_events(records: DataFrame, key: str = "traj") -> DataFrame:
    """Records (key, idx, type, text, tool_call_id, kind, title, status, output) as events in order.

    A user message is a message; the agent's message finishes (without the critic's part); thoughts
    and tool calls give an action and an observation. The parent of an observation is its action, of
    any other event the event before. Records are numbered from 1 in order, thoughts by themselves.
    """
    w = _log(key)
    thought = F.sum((F.col("type") == "agent_thought").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    output = F.coalesce("output", F.lit(""))
    numbered = records.withColumn("_n", F.row_number().over(w)).withColumn("_t", thought).withColumn("_c", call_parts(output, F.col("kind"), F.col("title")))
    none, no = F.lit(None).cast("string"), F.lit(False)

    def event(kind: str, call: Column, tool: Column = none, text: Column = none, arguments: Column = none, summary: Column = none, command: Column = none, path: Column = none, operation: Column = none, failed: Column = no) -> Column:
        own = {"kind": F.lit(kind), "tool_call_id": call, "tool_name": tool, "text": text, "arguments": arguments, "summary": summary, "command": command, "path": path, "operation": operation, "is_error": failed}
        return F.struct(*[v.alias(k) for k, v in own.items()])

    finish, think = F.format_string("acp-finish-%04d", F.col("_n")), F.format_string("acp-think-%04d", F.col("_t"))
    ended, call = strip_critic(F.col("text")), F.col("_c")
    arguments = json_object(name=call["skill"], path=call["path"], command=F.coalesce(call["command"], F.when(call["operation"] == "view", F.lit("view"))), operation=F.when(call["operation"] == "edit", F.lit("edit")))
    made = (
        F.when(F.col("type") == "user_message", F.array(event("message", none, text=F.col("text"))))
        .when(F.col("type") == "agent_message", F.array(event("action", finish, F.lit("finish"), ended, json_object(message=ended))))
        .when(F.col("type") == "agent_thought", F.array(event("action", think, F.lit("think"), F.lit(""), json_object(thought=F.col("text"))), event("observation", think, F.lit("think"), F.lit("Your thought has been logged."))))
        .when(
            F.col("type") == "tool_call",
            F.array(
                event("action", F.col("tool_call_id"), call["tool"], F.lit(""), arguments, F.nullif(call["summary"], F.lit("")), call["command"], call["path"], call["operation"]),
                event("observation", F.col("tool_call_id"), call["tool"], without_result_header(output), path=call["path"], failed=F.col("status") == "failed"),
            ),
        )
        .otherwise(F.raise_error(F.lit("a record is of an unknown type")).cast("array<struct<kind:string,tool_call_id:string,tool_name:string,text:string,arguments:string,summary:string,command:string,path:string,operation:string,is_error:boolean>>"))
    )
    each = numbered.select(key, F.col("idx").alias("_r"), F.posexplode(made).alias("_p", "e"))
    order = Window.partitionBy(key).orderBy("_r", "_p")
    placed = each.select(key, (F.row_number().over(order) - 1).alias("idx"), "e.*")
    role = F.when(F.col("kind") == "message", F.lit("user"))
    named = placed.withColumn("event_id", F.format_string("event-%06d", "idx")).withColumn("role", role)
    return named.withColumn("parent_id", F.lag("event_id").over(_log(key)))


def strip_critic(text: Column) -> Column:
    """Without the critic's part at the end, and without white space after what is left."""
    return rstrip(F.regexp_replace(text, r"(?ms)^Critic:.*", ""))


def drop_repeated_finish(events: DataFrame, key: str = "traj") -> DataFrame:
    """Without the assistant's messages directly before a finish action of the same text."""
    w = _log(key)
    own = strip(F.coalesce("text", F.lit("")))
    repeated = (F.col("kind") == "message") & (F.col("role") == "assistant") & (F.lead("kind").over(w) == "action") & (F.lead("tool_name").over(w) == "finish") & (F.lead("text").over(w) == own)
    return events.withColumn("_rep", F.coalesce(repeated, F.lit(False))).where("not _rep").drop("_rep")


def call_text(tool: Column, arguments: Column, call: Column) -> Column:
    return F.concat(tool, F.lit("("), content(F.coalesce(arguments, F.lit(""))), F.lit(") [id="), call, F.lit("]"))


def _content(text: Column) -> Column:
    own = strip(F.coalesce(text, F.lit("")))
    return F.concat(F.lit("<content>\n"), F.when(own == "", F.lit("<empty>")).otherwise(content(own)), F.lit("\n</content>"))


def event_blocks(events: DataFrame, key: str = "traj", normalize_ids: bool = True) -> DataFrame:
    """(key, idx, block): the tagged text of each event, null for events that are not shown.

    Actions of one reply (``response_id``, if there is such a column) share a block at the first of
    them. Tool-call ids are renumbered by first appearance unless ``normalize_ids`` is off.
    """
    steps = events if "step" in events.columns else action_steps(events, key)
    steps = first_seen_ids(steps, "tool_call_id", key) if normalize_ids else steps.withColumn("stable_id", F.col("tool_call_id"))
    is_action = F.col("kind") == "action"
    of_action = F.min(F.when(is_action, F.col("step"))).over(Window.partitionBy(key, "tool_call_id"))
    w = _log(key)
    reply = F.col("response_id") if "response_id" in events.columns else F.lit(None).cast("string")
    goes_on = is_action & F.coalesce((F.lag("kind").over(w) == "action") & (F.lag("_reply").over(w) == F.col("_reply")), F.lit(False))
    marked = steps.withColumn("_reply", reply).withColumn("_on", goes_on).withColumn("_of", of_action)
    marked = marked.withColumn("_group", F.sum((~F.col("_on")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    call = F.struct("idx", "step", call_text(F.col("tool_name"), F.col("arguments"), F.col("stable_id")).alias("call"))
    calls = F.sort_array(F.collect_list(F.when(is_action, call)).over(Window.partitionBy(key, "_group")))
    marked = marked.withColumn("_calls", F.when(is_action & ~F.col("_on"), calls))
    one = F.size("_calls") == 1
    opening = F.when(one, F.concat(F.lit("<action step="), F.col("_calls")[0]["step"].cast("string"))).otherwise(F.concat(F.lit("<action steps="), F.array_join(F.transform("_calls", lambda c: c["step"].cast("string")), ",")))
    several = F.transform("_calls", lambda c: F.concat(F.lit("<tool_call step="), c["step"].cast("string"), F.lit(">\n"), c["call"], F.lit("\n</tool_call>")))
    listed = F.when(one, F.col("_calls")[0]["call"]).otherwise(F.array_join(several, "\n"))
    action = F.concat(opening, F.lit(">\n"), _content(F.col("text")), F.lit("\n<tool_calls>\n"), listed, F.lit("\n</tool_calls>\n</action>"))
    seen = F.concat(F.lit("<observation step="), F.col("_of").cast("string"), F.lit(" tool_call_id="), F.col("stable_id"), F.lit(">\n"), _content(F.col("text")), F.lit("\n</observation>"))
    role = F.coalesce(F.col("role"), F.lit("user")) if "role" in events.columns else F.lit("user")
    said = F.concat(F.lit("<message role="), role, F.lit(">\n"), _content(F.col("text")), F.lit("\n</message>"))
    block = F.when(is_action & ~F.col("_on"), action).when(F.col("kind").isin("observation", "error"), seen).when(F.col("kind") == "message", said).when(F.col("kind") == "summary", F.col("text"))
    return marked.select(key, "idx", block.alias("block"))


def render(events: DataFrame, key: str = "traj", start_at_first_action: bool = False, normalize_ids: bool = True) -> DataFrame:
    """(key, text): tagged blocks of the events in order, joined by a blank line.

    ``events``: key, idx, kind (message, action, observation, error, summary), text, tool_name,
    arguments, tool_call_id, and role, response_id and step if there are any. Steps are counted over
    all events, also if those before the first action are left out.
    """
    blocks = event_blocks(events, key, normalize_ids)
    if start_at_first_action:
        shown = from_first_action(events, key).select(F.col(key).alias("_k"), F.col("idx").alias("_i"))
        blocks = blocks.join(shown, (blocks[key] == shown["_k"]) & (blocks["idx"] == shown["_i"]), "left_semi")
    listed = blocks.where("block is not null").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", "block"))).alias("l"))
    return listed.select(key, F.array_join(F.transform("l", lambda x: x["block"]), "\n\n").alias("text"))


def call_blocks(index: DataFrame, key: str = "traj", normalize_ids: bool = True) -> DataFrame:
    """(key, idx, block) of tool calls (``snapshot_index`` with ``output`` and ``exit_code``): an action
    where a call begins and an observation where it ends."""
    call = F.format_string("tool_call_%04d", F.col("step")) if normalize_ids else F.col("tool_call_id")
    step = F.col("step").cast("string")
    action = F.concat(F.lit("<action step="), step, F.lit(">\n<content>\n<empty>\n</content>\n<tool_calls>\n"), call_text(F.coalesce("call_kind", F.lit("unknown")), F.col("input"), call), F.lit("\n</tool_calls>\n</action>"))
    code = F.coalesce(F.concat(F.lit("<exit_code>"), F.col("exit_code").cast("string"), F.lit("</exit_code>\n")), F.lit("")) if "exit_code" in index.columns else F.lit("")
    seen = F.concat(F.lit("<observation step="), step, F.lit(" tool_call_id="), call, F.lit(" status="), F.col("terminal"), F.lit(">\n"), code, F.lit("<content>\n"), content(F.col("output")), F.lit("\n</content>\n</observation>"))
    both = F.explode(F.array(F.struct(F.col("first_idx").alias("idx"), F.lit(0).alias("part"), action.alias("block")), F.struct(F.col("last_idx").alias("idx"), F.lit(1).alias("part"), seen.alias("block"))))
    return index.select(key, both.alias("b")).select(key, "b.*")


def step_log_probs(tokens: DataFrame, key: str = "traj") -> DataFrame:
    """Per action (key, step, lp; one row per token): sum, mean and length of its log-probabilities."""
    return tokens.where("lp is not null").groupBy(key, "step").agg(F.sum("lp").alias("total"), F.avg("lp").alias("mean"), F.count(F.lit(1)).alias("length"))


def log_prob_modes(per_step: DataFrame, key: str = "traj") -> DataFrame:
    """Sequence probabilities of the first, last and least likely action and their mean, plain and
    length-normalised."""
    of = lambda c: [F.exp(F.min_by(c, "step")).alias(f"first_{c}"), F.exp(F.max_by(c, "step")).alias(f"last_{c}"), F.exp(F.min(c)).alias(f"min_{c}"), F.avg(F.exp(c)).alias(f"mean_{c}")]
    return per_step.groupBy(key).agg(*of("total"), *of("mean"))


def token_spans(tokens: DataFrame, key: str = "traj") -> DataFrame:
    """Tokens (key, pos, token) with their start and end by length."""
    end = F.sum(F.length("token")).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return tokens.withColumn("end", end).withColumn("start", F.col("end") - F.length("token"))


#: Characters of a bin: of the length of regions, so that most lie in one or two.
BIN = 256


def overlapping(spans: DataFrame, regions: DataFrame, key: str = "traj", width: int = BIN) -> DataFrame:
    """Tokens that touch a region (key, region, rs, re): end > rs and start < re.

    Spans and regions are copied to the bins of ``width`` characters that they reach into, and meet by
    (key, bin); a pair that shares several bins is told in the first of them. So a token meets the
    regions around it, however many its log has, and a long log is many keys.
    """
    bins = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.greatest(F.col(high) - 1, F.col(low)) / width))).alias("_bin")
    near = spans.select("*", bins("start", "end")).join(regions.select("*", bins("rs", "re")), [key, "_bin"])
    first = F.floor(F.greatest("start", "rs") / width) == F.col("_bin")
    return near.where(first & (F.col("end") > F.col("rs")) & (F.col("start") < F.col("re"))).drop("_bin")


TAGS = ("action", "observation", "summarized_action", "summarized_observation")


def tag_counts(rendered: DataFrame, text: str = "text") -> DataFrame:
    """How often a line begins with each of TAGS, in a column named by it."""
    return rendered.select("*", *[F.regexp_count(text, F.lit(rf"(?m)^<{name} step=")).alias(f"{name}s") for name in TAGS])
