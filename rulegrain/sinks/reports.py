"""Reports of a scan: one JSON payload per repository, and its renderings as JSON, Markdown, text and SARIF."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.contexts import provenance
from ..operators.scoring import WEIGHT
from ..schema import RANK

VERSION = 2
LEVELS = {"error": "error", "warn": "warning", "info": "note"}
DESCRIPTIONS = {
    "stale-reference": "A reference to something that doesn't exist", "duplication": "A rule kept twice", "drift": "Copies of a rule that differ", "contradiction": "Opposite instructions",
    "budget": "Too much context, or critical rules too deep in it", "structure": "Shape of the context files", "load-semantics": "A file that tools don't load as its author thinks", "dead-rule": "A rule that applied to nothing",
}


def located(findings: DataFrame, rules: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Findings with locations (path, start_line, end_line): their rules', each once, else line 1 of their surfaces."""
    f = findings.withColumn("row", F.monotonically_increasing_id())
    at = rules.join(surfaces.select("repo_id", "surface_id", "path"), ["repo_id", "surface_id"]).select("repo_id", "rule_id", "path", "start_line", "end_line")
    by_rule = f.select("row", "repo_id", F.posexplode("rule_ids").alias("pos", "rule_id")).join(at, ["repo_id", "rule_id"])
    by_surface = f.select("row", "repo_id", F.posexplode("surface_ids").alias("pos", "surface_id")).join(surfaces.select("repo_id", "surface_id", "path"), ["repo_id", "surface_id"]).withColumns({"start_line": F.lit(1), "end_line": F.lit(1)})
    gathered = lambda d, n: d.groupBy("row", "path", "start_line", "end_line").agg(F.min("pos").alias("pos")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "path", "start_line", "end_line"))).alias(n))
    told = f.join(gathered(by_rule, "a"), "row", "left").join(gathered(by_surface, "b"), "row", "left")
    plain = lambda c: F.transform(c, lambda x: F.struct(x["path"].alias("path"), x["start_line"].alias("startLine"), x["end_line"].alias("endLine")))
    return told.withColumn("locations", F.coalesce(plain(F.col("a")), plain(F.col("b")), F.array())).drop("row", "a", "b")


def payloads(scan: dict[str, DataFrame], generated_at: str = "") -> DataFrame:
    """repo_id, report: the scan of each repository as JSON text. A report is as large as one repository's findings."""
    surfaces, rules, findings, contexts = (scan[k] for k in ("surfaces", "rules", "findings", "contexts"))
    n_rules = rules.groupBy("repo_id", "surface_id").agg(F.count("*").alias("ruleCount"))
    listed = surfaces.join(n_rules, ["repo_id", "surface_id"], "left").groupBy("repo_id").agg(
        F.array_sort(F.collect_list(F.struct("path", F.col("surface_id").alias("id"), "kind", "scope", "tools", F.col("tokens_est").alias("tokensEstimated"), F.coalesce("ruleCount", F.lit(0)).alias("ruleCount")))).alias("surfaces"),
        F.count("*").alias("n_surfaces"), F.sum(F.coalesce("ruleCount", F.lit(0))).alias("n_rules"),
    )
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("severity"))
    told = located(findings, rules, surfaces).groupBy("repo_id").agg(
        F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "category", "message", "severity", "evidence", F.col("rule_ids").alias("ruleIds"), F.col("surface_ids").alias("surfaceIds"), "fix", "locations"))).alias("findings")
    )
    loaded = contexts.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("tool", "directory", "entries", F.col("tokens_always").alias("totalTokensEstimated"), F.col("tokens_conditional").alias("conditionalTokensEstimated")))).alias("effectiveContexts"))
    behave = provenance(contexts).groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("tool", F.col("docs_url").alias("docsUrl"), F.col("last_verified").alias("lastVerified"), "assumptions"))).alias("toolBehavior"))
    files = scan["files"].groupBy("repo_id").agg(F.count("*").alias("n_files"))
    score = scan["scores"].select("repo_id", F.struct("total", F.struct(*WEIGHT).alias("subscores")).alias("score"))
    joined = score
    for more in (listed, told, loaded, behave, files, *([scan["baseline"]] if "baseline" in scan else [])):
        joined = joined.join(more, "repo_id", "left")
    base = [F.when(F.col("suppressed").isNotNull(), F.struct("suppressed", "stale")).alias("baseline")] if "baseline" in scan else []
    body = F.struct(
        F.lit(VERSION).alias("version"), F.lit(generated_at).alias("generatedAt"), F.col("repo_id").alias("root"), "score",
        F.struct(F.coalesce("n_surfaces", F.lit(0)).alias("surfaces"), F.coalesce("n_rules", F.lit(0)).alias("rules"), F.coalesce("n_files", F.lit(0)).alias("filesIndexed")).alias("stats"),
        "surfaces", "effectiveContexts", "toolBehavior", *base, F.coalesce(F.transform("findings", lambda x: x.dropFields("rank")), F.array()).alias("findings"),
    )
    return joined.select("repo_id", F.to_json(body).alias("report"))


def read_payload(text: str) -> dict:
    told = json.loads(text)
    if told.get("version") != VERSION:
        raise ValueError(f"a report of version {told.get('version')}; {VERSION} is read")
    return told


def as_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False)


def _counts(report: dict) -> dict[str, int]:
    return {s: sum(f["severity"] == s for f in report["findings"]) for s in RANK}


def as_markdown(report: dict) -> str:
    """Score table, surfaces, contexts, findings by category."""
    out = ["# Context health", "", f"**Score: {report['score']['total']}/100**", "", "| subscore | value |", "| --- | ---: |"]
    out += [f"| {k} | {v} |" for k, v in report["score"]["subscores"].items()]
    n = _counts(report)
    out += ["", f"{n['error']} errors, {n['warn']} warnings, {n['info']} notes.", "", "## Surfaces", "", "| path | kind | tools | tokens (estimated) | rules |", "| --- | --- | --- | ---: | ---: |"]
    out += [f"| {s['path']} | {s['kind']} | {', '.join(s['tools']) or '-'} | {s['tokensEstimated']} | {s['ruleCount']} |" for s in report.get("surfaces") or []]
    out += ["", "## Contexts", "", "| tool | directory | always | conditional | files |", "| --- | --- | ---: | ---: | --- |"]
    out += [f"| {c['tool']} | {c['directory']} | {c['totalTokensEstimated']} | {c['conditionalTokensEstimated']} | {', '.join(e['path'] for e in c.get('entries') or [])} |" for c in report.get("effectiveContexts") or []]
    out += ["", "## Findings", ""]
    for f in report["findings"]:
        out += [f"### {f['severity']}: {f['category']}", "", f["message"], "", *[f"> {line}" for line in f["evidence"].split("\n")], ""]
    return "\n".join(out)


def as_text(report: dict) -> str:
    """Padded lines for a terminal, without colors."""
    n = _counts(report)
    out = [f"Context health {report['score']['total']}/100 ({color(report['score']['total'])})", ""]
    wide = max((len(s["path"]) for s in report.get("surfaces") or []), default=0)
    out += [f"  {s['path']:<{wide}}  {s['tokensEstimated']:>7} tokens  {s['ruleCount']:>4} rules" for s in report.get("surfaces") or []]
    out += ["", *(f"{f['severity']:<5}  {f['category']:<15}  {f['message']}" for f in report["findings"]), "", f"{n['error']} errors, {n['warn']} warnings, {n['info']} notes"]
    return "\n".join(out)


def color(score: int) -> str:
    return "green" if score >= 85 else "yellow" if score >= 60 else "red"


def as_sarif(report: dict) -> str:
    """SARIF 2.1.0: a descriptor for each category that occurs, a result for each finding."""
    categories = sorted({f["category"] for f in report["findings"]})
    rules = [{"id": c, "shortDescription": {"text": DESCRIPTIONS[c]}} for c in categories]
    results = []
    for f in report["findings"]:
        places = [{"physicalLocation": {"artifactLocation": {"uri": x["path"]}, "region": {"startLine": x["startLine"], "endLine": x["endLine"]}}} for x in f["locations"]]
        results.append({"ruleId": f["category"], "ruleIndex": categories.index(f["category"]), "level": LEVELS[f["severity"]], "message": {"text": f["message"]}, "locations": places})
    run = {"tool": {"driver": {"name": "rulegrain", "rules": rules}}, "results": results}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2, ensure_ascii=False)


RENDERERS = {"json": as_json, "md": as_markdown, "text": as_text, "sarif": as_sarif}


def render(report: dict, form: str) -> str:
    if form not in RENDERERS:
        raise ValueError(f"no such format: {form}")
    return RENDERERS[form](report)


def fixes_markdown(fixes: list[dict], score: int, root: str) -> str:
    """Safe fixes first, then suggestions with their evidence."""
    safe, rest = [f for f in fixes if f["safe"]], [f for f in fixes if not f["safe"]]
    out = ["# Fix plan", "", f"`{root}` has a score of {score}/100.", "", f"**{len(safe)} safe fix(es)** and **{len(rest)} suggestion(s)**.", ""]
    for title, some in (("## Safe fixes", safe), ("## Suggestions", rest)):
        out += [title, ""] if some else []
        for f in some:
            out += [f"### {f['kind']}: {f['description']}", "", f"- finding: {f['message']}", *([] if f["safe"] else [f"  > {x}" for x in f["evidence"].split("\n")]), ""]
    return "\n".join(out)
