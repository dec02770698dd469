"""Command line: preflight, scan, validate-skill, validate-hook, package, install, scrub.

    python -m tracewright.cli scan --root /path/to/logs --since 30d --out /path/to/result
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tracewright.functions.scrub import with_scrubbed
from tracewright.functions.times import parse_since
from tracewright.operators import quality, sinks
from tracewright.plans.mine import mine
from tracewright.sources import inventory
from tracewright.sources.logs import _missing, read_json


def _session() -> SparkSession:
    return SparkSession.builder.appName("tracewright").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _told(findings: list[tuple[str, str]]) -> int:
    for level, msg in findings:
        print(f"[{level}] {msg}")
    return int(any(level == "error" for level, _ in findings))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    target = Path(path, "SKILL.md") if Path(path).is_dir() else Path(path)
    return spark.createDataFrame([(target.read_text(encoding="utf-8", errors="replace"),)], "text string")


def preflight(args) -> int:
    print(json.dumps(inventory.environment(_session(), args.root), indent=2))
    return 0


def scan(args) -> int:
    """Rank what recurs; the state of earlier runs is used, and kept unless --no-cache is given."""
    spark = _session()
    out = args.out or f"{args.root}/tracewright/last-run"
    held = f"{out}/state.parquet"
    state = None if _missing(spark, held) else spark.read.parquet(held)
    found = mine(spark, args.root, parse_since(args.since), state, least_sessions=args.min_sessions)
    rows = [json.loads(line) for line in found.candidates.orderBy("id").toJSON().toLocalIterator()]
    sinks.write_json(f"{out}/scan.json", {**found.envelope, "candidates": rows})
    sinks.write_json(f"{out}/env.json", inventory.environment(spark, args.root))
    if not args.no_cache:
        sinks.write_state(found.state, held)
    for row in sinks.top_report(found.candidates, args.top).collect():
        print(row.line)
    return 0


def validate_skill(args) -> int:
    row = quality.skill_findings(_documents(_session(), args.path)).first()
    return _told([(f.level, f.msg) for f in row.findings])


def validate_hook(args) -> int:
    """A JSON hook definition, or a Markdown rule."""
    if args.path.endswith(".md"):
        row = quality.rule_findings(_documents(_session(), args.path)).first()
        return _told([(f.level, f.msg) for f in row.findings])
    return _told(quality.hook_findings(read_json(args.path), bool(args.root) and inventory.policy(args.root)[0]))


def package(args) -> int:
    code = validate_skill(args)
    if not code:
        print("\n".join(sinks.package(args.path, args.out)))
    return code


def install(args) -> int:
    plan = read_json(args.plan)
    if not isinstance(plan, dict):
        print(f"cannot read {args.plan}", file=sys.stderr)
        return 1
    allowed = [str(Path.home()), *args.allow_project_root]
    print("\n".join(sinks.install(args.root, plan, inventory.policy(args.root)[0], args.yes and not args.dry_run, allowed)))
    return 0


def scrub(args) -> int:
    """A text file, or standard input."""
    text = sys.stdin.read() if args.path == "-" else Path(args.path).read_text(encoding="utf-8", errors="replace")
    row = with_scrubbed(_session().createDataFrame([(text,)], "t string"), "t").first()
    print(row.scrubbed, end="")
    if args.stats:
        print(f"{row.hits} redactions", file=sys.stderr)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tracewright")
    commands = top.add_subparsers(required=True)

    def add(run, *options: tuple) -> None:
        sub = commands.add_parser(run.__name__.replace("_", "-"), help=run.__doc__)
        for names, given in options:
            sub.add_argument(*names.split(), **given)
        sub.set_defaults(run=run)

    root, path = ("--root", {"required": True}), ("path", {})
    flag = {"action": "store_true"}
    add(preflight, root)
    add(scan, root, ("--since", {"default": "90d"}), ("--min-sessions", {"type": int, "default": 3}), ("--top", {"type": int, "default": 20}), ("--out", {}), ("--no-cache", flag))
    add(validate_skill, path)
    add(validate_hook, path, ("--root", {}))
    add(package, path, ("--out", {"required": True}))
    add(install, root, ("--plan", {"required": True}), ("--yes", flag), ("--dry-run", flag), ("--allow-project-root", {"action": "append", "default": []}))
    add(scrub, path, ("--stats", flag))
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
