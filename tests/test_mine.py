import json

import pytest
from pyspark.sql import functions as F

from tests.logs_fixture import FAKE_TOKEN, HOME, build, result, use, write_lines
from tracewright.operators import incremental, sinks
from tracewright.plans.mine import mine
from tracewright.sources import inventory, logs

GOLDEN = [
    ("edit-hotspot", ["edit", "src/app.py"], 4, 4, 0.6, 0.0, 9.6, "skill"),
    ("tool-sequence", ["Grep", "Read", "Edit"], 4, 3, 0.7, 0.333, 5.6, "skill"),
    ("plan-type", ["plan", "refactor the auth module"], 2, 4, 0.75, 0.25, 4.5, "skill-chain"),
    ("prompt-cluster", ["prompt", "please deploy the app with token=[REDACTED]"], 3, 2, 0.65, 0.167, 3.25, "skill"),
    ("bash-template", ["bash", "pytest tests/ -q"], 4, 2, 0.8, 0.5, 3.2, "hookify-rule"),
    ("error-fix", ["errfix", "Bash", "Edit"], 3, 3, 0.5, 0.5, 2.25, "hookify-rule"),
    ("tool-sequence", ["Bash", "Edit"], 3, 2, 0.7, 0.5, 2.1, "skill"),
    ("repeated-call-loop", ["Read", "loop"], 1, 4, 0.255, 0.0, 1.02, "skill"),
    ("prompt-cluster", ["prompt", "<path>"], 3, 2, 0.65, 1.0, 0.0, "skill"),
]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return str(build(tmp_path_factory.mktemp("logs")))


@pytest.fixture(scope="module")
def mined(spark, root):
    return mine(spark, root)


def test_golden_table(mined):
    rows = mined.candidates.orderBy("id").collect()
    assert [(r.kind, r.signature, r.frequency, r.steps_saved, r.automatability, r.already_automated, r.score, r.recommended_primitive) for r in rows] == GOLDEN
    assert [r.id for r in rows] == [f"cand-{i:04d}" for i in range(1, 10)]
    assert [r.kind for r in rows if r.managed_hook_warning] == ["bash-template", "error-fix"]


def test_proofs_and_projects(mined):
    by = {(r.kind, tuple(r.signature)): r for r in mined.candidates.collect()}
    hot = by["edit-hotspot", ("edit", "src/app.py")]
    assert [(p.session, p.line, p.detail) for p in hot.proof_paths] == [(f"seqA{i}", 5, "edit src/app.py") for i in range(1, 5)]
    assert hot.projects == ["work/proj-a"]
    assert json.loads(by["repeated-call-loop", ("Read", "loop")].evidence) == {"max_run": 4, "sessions": 1}
    assert json.loads(by["plan-type", ("plan", "refactor the auth module")].evidence) == {"plan_count": 2, "avg_steps": 4}


def test_no_secret_survives(mined):
    assert FAKE_TOKEN not in json.dumps([r.asDict(True) for r in mined.candidates.collect()])


def test_envelope(mined):
    s = mined.envelope["sources"]
    assert s["history"] == {"total": 6, "count": 6} and s["plans"] == {"total": 2, "count": 2}
    assert s["transcripts"] == {"files_total": 9, "files_in_window": 9, "files_parsed": 9, "cache_hits": 0, "sessions": 9}
    assert mined.envelope["existing_automations"]["skill_names"] == ["pytest-runner"] and mined.envelope["candidate_count"] == 9


def test_incremental_rerun(spark, root, mined, tmp_path):
    sinks.write_state(mined.state, str(tmp_path / "state"))
    again = mine(spark, root, state=spark.read.parquet(str(tmp_path / "state")))
    assert again.envelope["sources"]["transcripts"]["cache_hits"] == 9 and again.envelope["sources"]["transcripts"]["files_parsed"] == 0
    assert again.candidates.orderBy("id").collect() == mined.candidates.orderBy("id").collect()


def test_state_version_and_prune(spark):
    listing = spark.createDataFrame([("a", 1, 10), ("b", 1, 10)], "file string, mtime_ms long, size long")
    state = spark.createDataFrame([("a", "0", 1, 10), ("b", "1", 1, 10), ("gone", "1", 1, 1)], "file string, version string, mtime_ms long, size long")
    todo, hits = incremental.split_by_state(listing, state)
    assert [r.file for r in todo.collect()] == ["a"] and [r.file for r in hits.collect()] == ["b"]
    assert sorted(r.file for r in incremental.prune(state, listing).collect()) == ["a", "b"]


def test_nothing_there(spark, tmp_path):
    out = mine(spark, str(tmp_path / "absent"))
    assert out.candidates.count() == 0 and out.envelope["candidate_count"] == 0


def test_window(spark, root):
    assert mine(spark, root, since_ms=4_000_000_000_000).envelope["sources"]["transcripts"]["files_in_window"] == 0


def events_of(spark, root):
    records = logs.session_records(logs.transcript_files(spark, str(root)))
    return logs.session_events(records)


def test_reader_edges(spark, tmp_path):
    path = tmp_path / "projects" / "p" / "s" / "subagents" / "agent-1.jsonl"
    path.parent.mkdir(parents=True)
    good = json.dumps(use("1", "Read"))
    path.write_bytes(b"not json\r\n\r\n" + good.encode() + b"\n\xff\xfe\n[1]\n" + json.dumps({"type": "assistant", "message": {"content": "text"}}).encode() + b"\n" + good.encode())
    found = logs.calls(events_of(spark, tmp_path)).orderBy("ord").collect()
    assert [(r.ln, r.item) for r in found] == [(3, "Read"), (7, "Read")]
    heads = logs.session_heads(logs.session_records(logs.transcript_files(spark, str(tmp_path)))).first()
    assert heads.session_id == "agent-1" and heads.project_dir == "p" and heads.project == "p"


def test_error_pairs(spark, tmp_path):
    write_lines(tmp_path / "projects" / "p" / "a.jsonl", [use("1", "Bash"), result("1", True), result("unknown", True), use("2", "Edit"), use("3", "Read"), result("3"), result("2", True)])
    assert [(r.err, r.fix) for r in logs.error_fixes(events_of(spark, tmp_path)).collect()] == [("?", "Edit")]


def test_late_cwd_and_paths(spark, tmp_path):
    first = use("1", "Edit", path="C:/work/proj-a/x.py")
    write_lines(tmp_path / "projects" / "p" / "a.jsonl", [first, {**use("2", "Write", notebook_path="c:\\WORK\\proj-a\\d\\y.py"), "cwd": HOME}, use("3", "Edit", file_path="/else/where.py")])
    assert [r.path for r in logs.edits(events_of(spark, tmp_path)).orderBy("ord").collect()] == ["x.py", "d/y.py", "where.py"]


def test_saturation_keeps_the_current_record(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "MOST_CALLS", 3)
    many = {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": str(i), "name": "Edit", "input": {"path": f"/f{i}"}} for i in range(3)]}}
    write_lines(tmp_path / "projects" / "p" / "a.jsonl", [use("0", "Read"), many, use("9", "Edit", path="/late")])
    events = events_of(spark, tmp_path)
    assert logs.calls(events).count() == 3
    assert [r.path for r in logs.edits(events).orderBy("ord").collect()] == ["f0", "f1", "f2"]


def test_line_cap(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "MOST_LINES", 3)
    write_lines(tmp_path / "projects" / "p" / "a.jsonl", [use(str(i), "Read") for i in range(10)])
    assert logs.calls(events_of(spark, tmp_path)).count() == 3


def test_prompts(spark, tmp_path):
    write_lines(tmp_path / "history.jsonl", [{"display": "  "}, {"text": "no"}, {"display": "/run now", "timestamp": 5}, {"display": "keep", "project": "/a/b/c/"}, {"display": "iso", "timestamp": "2026-07-01T00:00:00.12Z"}])
    kept, total = logs.prompts(spark, str(tmp_path), since_ms=1000)
    assert total.count() == 4
    assert [(r.sample, r.project_slug) for r in kept.orderBy("ord").collect()] == [("keep", "b/c"), ("iso", "unknown")]


def test_policy_order(tmp_path):
    (tmp_path / "settings.json").write_text('{"allowManagedHooksOnly": true}')
    assert inventory.policy(str(tmp_path)) == (True, "settings.json")
    (tmp_path / "remote-settings.json").write_text('{"allowManagedHooksOnly": true}')
    (tmp_path / "managed-settings.json").write_text('{"allowManagedHooksOnly": 1}')
    assert inventory.policy(str(tmp_path)) == (True, "remote-settings.json")


def test_report(mined):
    lines = [r.line for r in sinks.top_report(mined.candidates, 2).collect()]
    assert len(lines) == 2 and lines[0].startswith("cand-0001")


def test_environment(spark, root):
    env = inventory.environment(spark, root)
    assert env["allow_managed_hooks_only"] and env["data"]["transcript_files"] == 9 and env["data"]["plan_files"] == 2
