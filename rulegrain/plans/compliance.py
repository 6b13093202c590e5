"""The compliance flow: recent changes against rules, judged by an injected client, with calibration by a second one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import Counter, Vocabulary
from ..operators import compliance as C
from ..sources import repos as R
from ..sources.config import Config
from ..sources.settled import settled
from ..sources.verdicts import VERDICTS as CACHE
from ..sources.verdicts import VerdictStore

#: Dollars per million tokens, in and out, of a model that no price is given for.
PRICE = (3.0, 15.0)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Verdicts that earlier runs kept in a folder; none if it isn't there yet. One row for each rule, chunk and model."""
    return VerdictStore(spark, path).read()


def keep_verdicts(outcome: Outcome, path: str) -> None:
    """Add a run's new verdicts to the folder, so that a rerun asks only for what has changed."""
    if outcome.new_verdicts:
        store = VerdictStore(outcome.new_verdicts[0].sparkSession, path)
        # they are told from what was read of the store, which the next generation leaves as it is
        store.keep(reduce(DataFrame.unionByName, outcome.new_verdicts))


@dataclass
class Outcome:
    """status is ok, no-git, no-rules, nothing-to-judge or over-cap; frames are there as far as the flow came."""

    status: str
    usd: float = 0.0
    pairs: DataFrame | None = None
    dead: DataFrame | None = None
    judged: DataFrame | None = None
    reports: DataFrame | None = None
    agreement: DataFrame | None = None
    new_verdicts: list[DataFrame] = field(default_factory=list)


def compliance(
    repos: DataFrame, rules: DataFrame, surfaces: DataFrame, client: Callable[[str], str], cache: DataFrame | None = None, config: Config | None = None, agreed: bool = False,
    second: Callable[[str], str] | None = None, second_cache: DataFrame | None = None, price: tuple[float, float] = PRICE, prices: dict[str, tuple[float, float]] | None = None,
    vocabulary: Vocabulary | None = None,
) -> Outcome:
    """Judge the rules of repositories (repo_id, root) against their last changes.

    agreed lets a spend above the cap pass. With a second client every k-th judged pair is judged again; what
    that may cost counts towards the cap. prices are those of models by name, price that of all others. Chunks
    are packed by a vocabulary's tokens, if there is one. new_verdicts are to be appended to the caches.
    """
    c, spark = (config or Config()).compliance, repos.sparkSession
    none = spark.createDataFrame([], CACHE)
    cache, second_cache = (x if x is not None else none for x in (cache, second_cache))
    changes = settled(R.changes(repos, c.commits), "changes")
    if changes.filter("error is null").isEmpty():
        return Outcome(C.status(True, 0, 0, 0, c.spend_cap_usd))
    asked = settled(C.judgeable(rules, surfaces), "judgeable")
    if asked.isEmpty():
        return Outcome(C.status(False, 0, 0, 0, c.spend_cap_usd))
    count = C.tokens_of if vocabulary is None else Counter(vocabulary)
    chunks = settled(C.pack_chunks(C.file_diffs(changes), tokens=count), "chunks")
    keys = C.applicable(asked, chunks)
    told = asked.select("repo_id", "rule_id", "text", F.col("path").alias("surface_path"))
    pairs = settled(keys.join(told, ["repo_id", "rule_id"]).join(chunks.select("repo_id", "chunk_id", "sha", "files", "diff").dropDuplicates(["repo_id", "chunk_id"]), ["repo_id", "chunk_id"]), "pairs")
    out = Outcome("nothing-to-judge", pairs=pairs, dead=C.dead_rules(asked, pairs))
    if pairs.isEmpty():
        return out
    total = lambda p, k, m: C.cost(p, k, m, *(prices or {}).get(m, price)).agg(F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd")).first()["usd"]
    out.usd = total(pairs, cache, c.model)
    if second:
        out.usd += total(C.calibration_sample(pairs, c.calibration_sample_ratio), second_cache, c.calibration_model)
    out.status = C.status(False, 1, 1, out.usd, c.spend_cap_usd, agreed)
    if out.status != "ok":
        return out
    out.judged = settled(C.judge(pairs, cache, client, c.model, c.concurrency), "judged")
    out.reports = settled(C.rule_reports(out.judged), "reports")
    # rules that the judge found to apply to nothing are dead too
    idle = out.reports.filter("applicable = 0 and errors = 0").select("repo_id", "rule_id")
    out.dead = out.dead.unionByName(asked.join(idle, ["repo_id", "rule_id"], "left_semi"))
    out.new_verdicts.append(C.new_verdicts(out.judged))
    if second:
        sample = C.calibration_sample(out.judged.filter("verdict is not null"), c.calibration_sample_ratio).select(pairs.columns)
        again = settled(C.judge(sample, second_cache, second, c.calibration_model, c.concurrency), "judged")
        out.agreement = C.agreement(out.judged, again)
        out.new_verdicts.append(C.new_verdicts(again))
    return out


def as_text(outcome: Outcome, threshold: float = 0.8) -> str:
    """Percentages of each rule, three quotes of violations, twenty dead rules, and what calibration found."""
    lines = [f"compliance: {outcome.status}, about ${outcome.usd:.4f}"]
    if outcome.reports is not None:
        texts = outcome.pairs.select("repo_id", "rule_id", "text", "surface_path").dropDuplicates(["repo_id", "rule_id"])
        for r in outcome.reports.filter("applicable > 0 or errors > 0").join(texts, ["repo_id", "rule_id"]).orderBy(F.desc("violated"), F.desc("applicable"), "rule_id").toLocalIterator():
            share = lambda n, of=r["applicable"]: int(100 * n / of + 0.5) if of else 0
            lines += [f"{r['surface_path']}: applicable {r['applicable']}, followed {share(r['followed'])}%, violated {share(r['violated'])}%, errors {r['errors']}", f'    "{r["text"][:100]}"']
            lines += [f'    violated @ {e["sha"]}: "{e["evidence"][:120]}"' for e in r["evidences"][:3]]
    if outcome.dead is not None:
        lines += [f"dead: {r['path']}:{r['start_line']} \"{r['text'][:80]}\"" for r in outcome.dead.orderBy("path", "start_line").limit(20).collect()]
    if outcome.agreement is not None:
        for r in outcome.agreement.collect():
            note = "" if r["agreement"] >= threshold else ": take the figures as directions only"
            lines.append(f"calibration: {int(100 * r['agreement'] + 0.5)}% agreement ({r['agreed']}/{r['compared']}){note}")
    return "\n".join(lines)
