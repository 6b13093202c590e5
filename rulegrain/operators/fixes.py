"""Planned fixes of findings, and their edits applied to files.

Safe are: deleting the lower-ranking of two equal rules, renaming a path whose history shows one target that
exists, and moving rules to the front that their author wrote in capitals. All else is a suggestion.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.diffs import unified_diff
from ..schema import KINDS
from ..sources.settled import settled

HEADING = "## Critical rules"
EDIT = "struct<type: string, start_line: int, end_line: int, find: string, replace_with: string>"
#: Columns of planned fixes; edit is null for suggestions.
FIXES = ["repo_id", "kind", "safe", "description", "message", "evidence", "file", "edit"]


def kind_rank(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), kind)


def _edit(kind: str, find: Column | None = None, replace: Column | None = None, prefix: str = "") -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("type"), F.col(f"{prefix}start_line").alias("start_line"), F.col(f"{prefix}end_line").alias("end_line"),
        (none if find is None else find).alias("find"), (none if replace is None else replace).alias("replace_with"),
    ).cast(EDIT)


def _told(rows: DataFrame, kind: Column, safe: bool, description: Column, evidence: Column | None = None, file: Column | None = None, edit: Column | None = None) -> DataFrame:
    return rows.select(
        "repo_id", kind.alias("kind"), F.lit(safe).alias("safe"), description.alias("description"), "message", (F.col("evidence") if evidence is None else evidence).alias("evidence"),
        (F.lit(None).cast("string") if file is None else file).alias("file"), (F.lit(None).cast(EDIT) if edit is None else edit).alias("edit"),
    )


def plan(findings: DataFrame, rules: DataFrame, surfaces: DataFrame, renames: DataFrame, index: DataFrame) -> DataFrame:
    """FIXES of findings. renames: repo_id, old, targets; index: repo_id, path of existing files and directories."""
    own = surfaces.filter("scope <> 'user-global'").select("repo_id", "surface_id", "path", kind_rank(F.col("kind")).alias("rank"))
    placed = rules.join(own, ["repo_id", "surface_id"]).select("repo_id", "rule_id", "text", "path", "rank", "start_line", "end_line", "ord")
    f = settled(findings.withColumn("row", F.monotonically_increasing_id()), "numbered")  # both sides of joins see the same numbers

    # two equal rules: the one that ranks lower goes, each place once
    side = lambda s: placed.select(F.col("repo_id"), F.col("rule_id").alias(s), F.struct("text", "path", "rank", "start_line", "end_line").alias(f"r{s}"))
    pairs = f.filter("category = 'duplication' and size(rule_ids) > 1").withColumns({"a": F.col("rule_ids")[0], "b": F.col("rule_ids")[1]})
    both = pairs.join(side("a"), ["repo_id", "a"]).join(side("b"), ["repo_id", "b"])
    words = lambda c: F.array_join(T.normalize_words(F.col(c)), " ")
    both = both.withColumn("equal", words("ra.text") == words("rb.text"))
    a_loses = (F.col("ra.rank") > F.col("rb.rank")) | ((F.col("ra.rank") == F.col("rb.rank")) & (F.col("ra.path") > F.col("rb.path")))
    lost = both.filter("equal").withColumns({"loser": F.when(a_loses, F.col("ra")).otherwise(F.col("rb")), "winner": F.when(a_loses, F.col("rb")).otherwise(F.col("ra"))}).select("*", "loser.start_line", "loser.end_line")
    once = lost.withColumn("rn", F.row_number().over(Window.partitionBy("repo_id", "loser.path", "start_line", "end_line").orderBy("message"))).filter("rn = 1")
    deletes = _told(
        once, F.lit("delete-rule"), True,
        F.format_string("Delete the copy in %s (lines %d-%d); %s:%d keeps it.", "loser.path", "start_line", "end_line", "winner.path", "winner.start_line"), file=F.col("loser.path"), edit=_edit("delete"),
    )
    merges = _told(both.filter("not equal"), F.lit("merge-rules"), False, F.lit("Nearly alike, but not equal: merge by hand."))

    # a stale path with one target that exists
    stale = f.filter("category = 'stale-reference'").withColumns({"rule_id": F.col("rule_ids")[0], "old": F.regexp_replace("fix.ref", "/$", "")}).join(placed, ["repo_id", "rule_id"])
    moved = stale.join(renames.filter(F.size("targets") == 1).select("repo_id", "old", F.col("targets")[0].alias("target")), ["repo_id", "old"], "left")
    there = moved.join(index.select("repo_id", F.col("path").alias("target"), F.lit(True).alias("exists")).distinct(), ["repo_id", "target"], "left")
    sure = there.filter("exists").withColumn("rn", F.row_number().over(Window.partitionBy("repo_id", "path", "start_line", "old", "target").orderBy("message"))).filter("rn = 1")
    updates = _told(sure, F.lit("update-path"), True, F.format_string("History shows that `%s` became `%s`: update %s:%d.", "old", "target", "path", "start_line"), file=F.col("path"), edit=_edit("replace", F.col("old"), F.col("target")))
    by_hand = _told(there.filter("exists is null"), F.lit("update-path"), False, F.lit("History shows no single target that exists: fix by hand."))

    # buried rules
    buried = f.filter("fix.kind = 'move-to-front'").select("row", "repo_id", "message", "evidence", F.explode("rule_ids").alias("rule_id")).join(placed, ["repo_id", "rule_id"]).withColumn("loud", T.is_emphasized(F.col("text")))
    moves = _told(
        buried.filter("loud"), F.lit("move-to-front"), True, F.format_string("Move the rule at %s:%d-%d into a section at the top.", "path", "start_line", "end_line"), F.concat(F.lit('"'), F.substring("text", 1, 160), F.lit('"')), F.col("path"), _edit("move-to-top"),
    )
    rest = buried.filter("not loud").groupBy("row", "repo_id", "message", "evidence").agg(F.count("*").alias("n"))
    left = _told(rest, F.lit("move-to-front"), False, F.format_string("%d more buried critical rule(s) stay: their author didn't write them in capitals. Review by hand.", "n"))

    plain = f.filter("category in ('drift', 'contradiction') or (category = 'structure' and fix is not null) or fix.kind = 'split-file'")
    others = _told(plain, F.col("fix.kind"), False, F.col("fix.description"))
    out = deletes
    for more in (merges, updates, by_hand, moves, left, others):
        out = out.unionByName(more)
    return out


def apply_edits(content: str, edits: list[dict]) -> str:
    """A file's text after its edits: replacements in place, deletions, then moved rules under a heading after the first title."""
    lines = content.split("\n")
    for e in edits:
        if e["type"] == "replace" and e["find"] and e["replace_with"] is not None:
            alone = re.compile(rf"(?<![A-Za-z0-9_@./-]){re.escape(e['find'])}(?![A-Za-z0-9_@./-])")
            for i in range(e["start_line"] - 1, min(e["end_line"], len(lines))):
                lines[i] = alone.sub(lambda _, new=e["replace_with"]: new, lines[i])
    taken = [e for e in edits if e["type"] in ("delete", "move-to-top")]
    moved = [x for e in taken if e["type"] == "move-to-top" for x in lines[e["start_line"] - 1 : e["end_line"]]]
    gone = {i for e in taken for i in range(e["start_line"] - 1, e["end_line"])}
    lines = [x for i, x in enumerate(lines) if i not in gone]
    if moved:
        titled = next((i + 1 for i, x in enumerate(lines) if x.strip() == HEADING), None)
        top = next((i + 1 for i, x in enumerate(lines) if re.match(r"#\s", x)), 0)
        lines[titled or top : titled or top] = ["", *moved] if titled else ["", HEADING, "", *moved]
    out: list[str] = []
    fenced = False
    for x in lines:
        fenced ^= bool(re.match(r"\s*(?:```|~~~)", x))
        if fenced or x.strip() or not out or out[-1].strip():
            out.append(x)
    return "\n".join(out)


def apply_plan(fixes: DataFrame, surfaces: DataFrame) -> DataFrame:
    """repo_id, path, before, after, diff of the files that safe fixes edit."""
    edits = fixes.filter("safe").groupBy("repo_id", F.col("file").alias("path")).agg(F.array_sort(F.collect_list("edit")).alias("edits"))
    files = surfaces.select("repo_id", "path", F.col("raw").alias("before")).join(edits, ["repo_id", "path"])

    @F.arrow_udf("struct<after: string, diff: string>")
    def run(path: pa.Array, before: pa.Array, todo: pa.Array) -> pa.Array:
        rows = []
        for p, b, e in zip(path.to_pylist(), before.to_pylist(), todo.to_pylist(), strict=True):
            after = apply_edits(b, e)
            rows.append({"after": after, "diff": unified_diff(p, b, after)})
        return pa.array(rows, pa.struct([("after", pa.string()), ("diff", pa.string())]))

    return files.withColumn("new", run("path", "before", "edits")).select("repo_id", "path", "before", "new.after", "new.diff")
