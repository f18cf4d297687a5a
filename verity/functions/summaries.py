"""Short accounts of actions and observations that are not cited, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verity.functions.text import EXCERPT, changed_lines, excerpt, prefix, without_echo

#: Commands whose empty output means that nothing was found.
SEARCHES = r"\b(?:find|grep|rg|ag|ack)\b"


def _told(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value)


def _text(value: Column | None) -> Column:
    return F.lit(None).cast("string") if value is None else value


def action_summary(tool: Column, summary: Column, arguments: Column, operation: Column | None = None, path: Column | None = None) -> Column:
    """A file edit by operation and path; else the event's own summary; else its call. An action with
    neither is an error."""
    unknown = F.lit("unknown")
    edit = F.concat(F.lit("file_editor "), F.coalesce(_text(operation), unknown), F.lit(": "), F.coalesce(_text(path), unknown))
    call = F.concat(_told("Tool", tool), F.lit("\n"), _told("Arguments", arguments))
    lost = F.raise_error(F.lit("an action has neither a summary nor a call")).cast("string")
    return F.when(tool == "file_editor", edit).when(summary.isNotNull(), summary).when(arguments.isNotNull(), call).otherwise(lost)


def file_edit_summary(tool: Column, operation: Column, path: Column, failed: Column, result: Column, old: Column | None = None, new: Column | None = None) -> Column:
    """Operation, path and outcome of a file edit, with the changed lines and, on failure, the result."""
    lines = F.when(_text(new).isNotNull(), changed_lines(_text(old), _text(new)))
    return F.concat_ws(
        "\n",
        _told("Tool", tool),
        _told("Operation", operation),
        _told("Path", path),
        _told("Status", F.when(failed, "failure").otherwise("success")),
        _told("Changed lines", lines),
        F.when(failed, _told("Result", prefix(result, EXCERPT))),
    )


def terminal_summary(output: Column, command: Column, asked: Column, exit_code: Column) -> Column:
    """Excerpt of a command's output without its echo; without output, whether a search found nothing.
    ``command`` is what the terminal echoes, ``asked`` what the action ran."""
    left = without_echo(output, command)
    code = exit_code.cast("string")
    status = F.coalesce(F.concat(F.lit("exit code "), code), F.lit("exit code unavailable"))
    what = F.when(F.coalesce(asked, F.lit("")).rlike(SEARCHES), "No matches; ").otherwise("No output; ")
    nothing = F.concat(F.lit("Tool: terminal\n"), what, status, F.lit("."))
    some = F.concat(F.lit("Tool: terminal\nExit code: "), F.coalesce(code, F.lit("None")), F.lit("\nOutput:\n"), excerpt(left))
    return F.when(left == "", nothing).otherwise(some)


def observation_summary(tool: Column, result: Column, *, command: Column, asked: Column, exit_code: Column, operation: Column, path: Column, failed: Column, old: Column, new: Column) -> Column:
    """By the tool: a terminal's or a file editor's account, else the beginning of the result."""
    unknown = F.lit("unknown")
    edit = file_edit_summary(F.lit("file_editor"), F.coalesce(operation, unknown), F.coalesce(path, unknown), F.coalesce(failed, F.lit(False)), result, old, new)
    plain = F.concat(_told("Tool", tool), F.lit("\n"), _told("Result", prefix(result, EXCERPT)))
    return F.when(tool == "terminal", terminal_summary(result, command, asked, exit_code)).when(tool == "file_editor", edit).otherwise(plain)


def call_action_summary(kind: Column, title: Column, shown_input: Column, *, summary: Column | None = None, command: Column | None = None, operation: Column | None = None, path: Column | None = None) -> Column:
    """A tool call in bounded form: its file edit, else its summary, command, title or input."""
    some = lambda c: _text(c).isNotNull() & (_text(c) != "")
    short = lambda c: prefix(_text(c), EXCERPT)
    tool = _told("Tool", kind)
    edit = F.concat(kind, F.lit(" "), _text(operation), F.lit(": "), _text(path))
    return (
        F.when(_text(operation).isNotNull(), edit)
        .when(some(summary), short(summary))
        .when(_text(command).isNotNull(), F.concat(tool, F.lit("\n"), _told("Command", short(command))))
        .when(some(title), F.concat(tool, F.lit("\n"), _told("Title", short(title))))
        .otherwise(F.concat(tool, F.lit("\n"), _told("Input", short(shown_input))))
    )


def call_observation_summary(kind: Column, status: Column, output: Column, *, operation: Column | None = None, path: Column | None = None, old: Column | None = None, new: Column | None = None) -> Column:
    """A tool call's result in bounded form: its file edit, else status and excerpt."""
    edit = file_edit_summary(kind, _text(operation), _text(path), F.coalesce(status == "failed", F.lit(False)), output, old, new)
    plain = F.concat(_told("Tool", kind), F.lit("\n"), _told("Status", F.coalesce(status, F.lit("unknown"))), F.lit("\nOutput:\n"), excerpt(output))
    return F.when(_text(operation).isNotNull(), edit).otherwise(plain)
