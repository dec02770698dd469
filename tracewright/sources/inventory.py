"""Automations that exist already: skills, hooks, rules; and the environment's policy."""

from __future__ import annotations

import platform
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.sources.logs import TEXT_LINES, _missing, listing, read_json, whole_files

MOST_SKILLS, MOST_PROJECTS = 4000, 200
# Settings files in order of reading; the last one that sets the policy names it.
SETTINGS = ["settings.json", "settings.local.json", "remote-settings.json"]
POLICY_SETTINGS = ["settings.json", "settings.local.json", "managed-settings.json", "remote-settings.json"]


def _from(items: Column, start) -> Column:
    """The items from a place on, however many."""
    return F.slice(items, start, F.greatest(F.size(items), F.lit(1)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _value(x: Column) -> Column:
    """What stands after the colon: a quoted text, a list (its items joined by ', '), or plain."""
    raw = F.trim(F.substr(x, F.instr(x, ":") + 1))
    inner = F.substr(raw, F.lit(2), F.greatest(F.length(raw) - 2, F.lit(0)))
    quoted = raw.rlike(r"""(?s)^(["']).*\1$""") & (F.length(raw) >= 2)
    items = F.filter(F.split(inner, ","), lambda v: F.trim(v) != "")
    listed = F.array_join(F.transform(items, lambda v: F.regexp_replace(F.trim(v), r"""^["']+|["']+$""", "")), ", ")
    return F.when(quoted, inner).when(raw.rlike(r"(?s)^\[.*\]$"), listed).otherwise(raw)


def frontmatter(text: Column) -> Column:
    """Struct (meta map<string,string>, body)."""
    clean = F.regexp_replace(text, "^﻿+", "")
    empty = F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))

    def parsed(lines: Column) -> Column:
        closed = F.when(F.trim(lines[0]) == "---", F.array_position(F.transform(_from(lines, 2), lambda x: F.trim(x) == "---"), True).cast("int")).otherwise(0)
        return _let(F.coalesce(closed, F.lit(0)), lambda end: F.when(end > 0, between(lines, end)).otherwise(F.struct(empty.alias("meta"), clean.alias("body"))))

    def between(lines: Column, end: Column) -> Column:
        own = F.filter(F.slice(lines, 2, F.greatest(end - 1, F.lit(0))), lambda x: (F.trim(x) != "") & ~F.startswith(F.ltrim(x), F.lit("#")) & F.contains(x, F.lit(":")))
        pairs = F.transform(own, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), _value(x).alias("v")))
        # of a repeated key the last value counts
        last = _let(pairs, lambda all_: F.filter(all_, lambda p, i: ~F.exists(_from(all_, i + 2), lambda q: q["k"] == p["k"])))
        return F.struct(F.map_from_entries(last).alias("meta"), F.array_join(_from(lines, end + 2), "\n").alias("body"))

    return F.when(F.startswith(clean, F.lit("---")), _let(F.split(clean, TEXT_LINES), parsed)).otherwise(F.struct(empty.alias("meta"), clean.alias("body")))


def skills(spark: SparkSession, root: str) -> DataFrame:
    """Name, description, file; own skills first, then those of plugins, MOST_SKILLS in all."""
    own = whole_files(spark, f"{root}/skills", "SKILL.md").where(F.col("file").rlike(r"/skills/[^/]+/SKILL\.md$")).withColumn("rank", F.lit(0))
    theirs = whole_files(spark, f"{root}/plugins", "SKILL.md").withColumn("rank", F.lit(1))
    rows = own.unionByName(theirs).withColumn("f", frontmatter(F.col("text"))["meta"])
    rows = rows.select("rank", "segments", "file", F.coalesce(F.nullif(F.col("f")["name"], F.lit("")), F.element_at("segments", -2)).alias("name"), F.substring(F.coalesce(F.col("f")["description"], F.lit("")), 1, 400).alias("description"))
    return rows.orderBy("rank", "segments").limit(MOST_SKILLS).select("name", "description", "file")


def hooks(spark: SparkSession, root: str) -> DataFrame:
    """Event, matcher, source of the settings files."""
    rows = []
    for name in SETTINGS:
        data = read_json(f"{root}/{name}")
        events = data.get("hooks") if isinstance(data, dict) else None
        for event, entries in (events.items() if isinstance(events, dict) else ()):
            rows += [(event, str(e.get("matcher", "")), name) for e in (entries if isinstance(entries, list) else ()) if isinstance(e, dict)]
    return spark.createDataFrame(rows, "event string, matcher string, source string")


def project_rules(projects: list[str]) -> list[dict]:
    """Rule files of the first MOST_PROJECTS project folders."""
    found = []
    for project in projects[:MOST_PROJECTS]:
        folder = Path(project) / ".claude"
        if folder.is_dir():
            found += [{"name": p.stem, "path": str(p), "project": project} for p in sorted(folder.glob("hookify.*.local.md"))]
    return found


def known_tokens(skill_rows: DataFrame, hook_rows: DataFrame) -> list[str]:
    """Distinct lower-case words of all skills and hooks (at most MOST_SKILLS descriptions of 400 characters)."""
    texts = skill_rows.select(F.concat_ws(" ", "name", "description").alias("t")).unionByName(hook_rows.select(F.concat_ws(" ", "matcher", "event").alias("t")))
    return sorted(r.w for r in token_bag(texts).collect())


def token_bag(texts: DataFrame) -> DataFrame:
    """w: the distinct lower-case words of texts (t)."""
    return texts.select(F.explode(F.split(F.lower("t"), "[^a-z0-9]+")).alias("w")).where("w <> ''").distinct()


def policy(root: str) -> tuple[bool, str | None]:
    """Whether only managed hooks are allowed, and the last settings file that says so."""
    source = None
    for name in POLICY_SETTINGS:
        data = read_json(f"{root}/{name}")
        if isinstance(data, dict) and data.get("allowManagedHooksOnly") is True:
            source = name
    return source is not None, source


def find_skill(root: str, name: str) -> str | None:
    """Its own folder, else the first match among plugins."""
    direct = Path(root) / "skills" / name / "SKILL.md"
    if direct.exists():
        return str(direct)
    return next((str(p) for p in sorted(Path(root, "plugins").rglob(f"{name}/SKILL.md"))), None)


def environment(spark: SparkSession, root: str) -> dict:
    """Policy and counts of what can be read."""
    managed, source = policy(root)
    files = listing(spark, f"{root}/projects", "*.jsonl")
    history = Path(root) / "history.jsonl"
    projects = Path(root) / "projects"
    env = {
        "config_dir": root,
        "config_dir_exists": not _missing(spark, root),
        "platform": platform.system(),
        "allow_managed_hooks_only": managed,
        "managed_policy_source": source,
        "data": {
            "history_exists": history.exists(),
            "history_bytes": history.stat().st_size if history.exists() else 0,
            "project_dirs": sum(p.is_dir() for p in projects.iterdir()) if projects.is_dir() else 0,
            "transcript_files": files.count(),
            "plan_files": listing(spark, f"{root}/plans", "*.md", False).count(),
        },
        "warnings": [],
    }
    if not env["config_dir_exists"]:
        env["warnings"].append(f"no such folder: {root}")
    if managed:
        env["warnings"].append(f"only managed hooks are allowed ({source}); guards become rules that are read at run time")
    if not history.exists() and not env["data"]["transcript_files"]:
        env["warnings"].append("neither prompts nor sessions: nothing to mine")
    return env


def safe_relative(path: str) -> bool:
    """A relative path that stays below its base, with either separator."""
    parts = re.split(r"[\\/]+", path)
    return bool(path) and not re.match(r"[A-Za-z]:|[\\/]", path) and ".." not in parts


def is_safe_relative(path: Column) -> Column:
    """T14 on a column."""
    return (path != "") & ~path.rlike(r"^(?:[A-Za-z]:|[\\/])") & ~F.array_contains(F.split(path, r"[\\/]+"), "..")
