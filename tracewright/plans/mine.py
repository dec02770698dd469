"""The whole mining plan: sources to ranked candidates."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.scrub import scrub_all
from tracewright.functions.session import cut
from tracewright.functions.times import now_ms
from tracewright.operators import incremental, miners, scoring
from tracewright.sources import inventory, logs

SCHEMA_VERSION = "1"
EVENT_COLUMNS = ["session", "segments", "ln", "pos", "kind", "item", "input", "cwd_by_then"]


@dataclass
class Mined:
    candidates: DataFrame
    envelope: dict = field(default_factory=dict)
    state: DataFrame | None = None


def candidates(parts: list[DataFrame], managed: bool) -> DataFrame:
    """All miners' rows, scored, ranked and numbered; texts are scrubbed last, so ids follow the unscrubbed signatures."""
    found = reduce(DataFrame.unionByName, parts)
    ranked = scoring.ranked(scoring.finish(found, managed))
    order = ["id", "kind", "signature", "title", "summary", "projects", "proof_paths", "evidence", "frequency", "steps_saved", "automatability", "already_automated", "score", "recommended_primitive", "primitive_rationale", "managed_hook_warning"]
    return scrub_all(ranked.select(*order))


def project_list(heads: DataFrame) -> DataFrame:
    """The first project folders, in order."""
    return heads.where("cwd is not null").select("cwd").distinct().orderBy("cwd").limit(inventory.MOST_PROJECTS)


def mine(spark: SparkSession, root: str, since_ms: int | None = None, state: DataFrame | None = None, managed: bool | None = None, least_sessions: int = 3) -> Mined:
    """Mine a log folder.  ``state``: what an earlier run returned; unchanged files are not parsed again."""
    if managed is None:
        managed = inventory.policy(root)[0]
    in_reach = logs.listing(spark, f"{root}/projects", "*.jsonl")
    window = in_reach if since_ms is None else in_reach.where(F.col("mtime_ms") >= since_ms)
    files = logs.transcript_files(spark, root, since_ms)
    todo, hits = incremental.split_by_state(window.withColumn("file", F.col("file")), state)
    changed = files.join(todo.select("file"), "file", "left_semi") if state is not None else files
    records = logs.session_records(changed)
    new_heads, new_events = logs.session_heads(records), logs.session_events(records)
    stamped = changed.select("file", F.lit(incremental.STATE_VERSION).alias("version"), "mtime_ms", "size")
    new_events = new_events.withColumn("input", F.to_json("input"))
    parsed = (
        stamped.join(new_heads.withColumnRenamed("session", "file").select("file", F.struct("segments", "project_dir", "cwd", "git_branch", "session_id", "first_ts", "last_ts", "project").alias("head")), "file", "left")
        .join(new_events.groupBy(F.col("session").alias("file")).agg(F.collect_list(F.struct(*[c for c in EVENT_COLUMNS if c != "session"])).alias("events")), "file", "left")
    )
    # one file is one session: its events fit a row, as the caps of a session bound them
    full = cut(incremental.merged(state, in_reach, parsed))
    used = full.join(window.select("file"), "file", "left_semi")
    heads = used.where("head is not null").select(F.col("file").alias("session"), "head.*")
    events = used.select(F.col("file").alias("session"), F.explode("events").alias("e")).select("session", "e.*").withColumn("input", F.try_parse_json("input"))
    events = cut(events)

    prompts, all_prompts = logs.prompts(spark, root, since_ms)
    plans = logs.plans(spark, root, since_ms)
    skills, hooks = inventory.skills(spark, root), inventory.hooks(spark, root)
    tokens = inventory.known_tokens(skills, hooks)
    known = F.lit(tokens) if tokens else F.array().cast("array<string>")
    calls = logs.calls(events)
    found = [
        miners.sequences(calls, heads, known, least_sessions),
        miners.loops(calls, heads, known),
        miners.hotspots(logs.edits(events), heads, known),
        miners.commands(logs.commands(events), heads, known),
        miners.error_fixes(logs.error_fixes(events), heads, known),
        miners.prompt_clusters(prompts, known, f"{root}/history.jsonl"),
        miners.plan_clusters(plans, known),
    ]
    ranked = cut(candidates(found, managed))
    n_todo, n_hits = todo.count(), hits.count()
    projects = [r.cwd for r in project_list(heads).collect()]
    envelope = {
        "schema_version": SCHEMA_VERSION,
        "generated_at_ms": now_ms(),
        "since_ms": since_ms,
        "sources": {
            "history": {"total": all_prompts.count(), "count": prompts.count()},
            "transcripts": {"files_total": in_reach.count(), "files_in_window": n_todo + n_hits, "files_parsed": n_todo, "cache_hits": n_hits, "sessions": n_todo + n_hits},
            "plans": {"total": logs.listing(spark, f"{root}/plans", "*.md", False).count(), "count": plans.count()},
        },
        "existing_automations": {"skills": skills.count(), "hooks": hooks.count(), "rules": len(inventory.project_rules(projects)), "skill_names": [r.name for r in skills.select("name").orderBy("name").limit(500).collect()]},
        "candidate_count": ranked.count(),
    }
    return Mined(ranked, envelope, full)
