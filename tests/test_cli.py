import json

from tests.logs_fixture import build
from tracewright import cli


def test_scan_twice_and_report(spark, tmp_path, capsys):
    root = str(build(tmp_path / "logs"))
    assert cli.main(["scan", "--root", root, "--since", "all", "--top", "2", "--out", f"{root}/out"]) == 0
    assert capsys.readouterr().out.count("cand-") == 2
    first = json.loads((tmp_path / "logs" / "out" / "scan.json").read_text())
    assert cli.main(["scan", "--root", root, "--since", "all", "--out", f"{root}/out"]) == 0
    second = json.loads((tmp_path / "logs" / "out" / "scan.json").read_text())
    assert first["candidates"] == second["candidates"] and len(first["candidates"]) == 9
    assert second["sources"]["transcripts"]["cache_hits"] == 9


def test_validators_and_scrub(spark, tmp_path, capsys):
    root = build(tmp_path / "logs")
    assert cli.main(["validate-skill", str(root / "skills" / "pytest-runner")]) == 0
    (tmp_path / "hook.json").write_text('{"Stop": [{"hooks": [{"type": "command", "command": "echo"}]}]}')
    assert cli.main(["validate-hook", str(tmp_path / "hook.json")]) == 0
    (tmp_path / "rule.md").write_text("no frontmatter")
    assert cli.main(["validate-hook", str(tmp_path / "rule.md")]) == 1
    (tmp_path / "t.txt").write_text("password=abc123xyz")
    capsys.readouterr()
    assert cli.main(["scrub", str(tmp_path / "t.txt"), "--stats"]) == 0
    assert capsys.readouterr().out == "password=[REDACTED]"
    assert cli.main(["package", str(root / "skills" / "pytest-runner"), "--out", str(tmp_path / "s.zip")]) == 0


def test_install_previews_unless_told(tmp_path):
    root = build(tmp_path / "logs")
    (tmp_path / "plan.json").write_text(json.dumps({"artifacts": [{"type": "skill", "name": "New one", "files": {"SKILL.md": "---\nname: x\n---\n"}}]}))
    run = ["install", "--root", str(root), "--plan", str(tmp_path / "plan.json")]
    assert cli.main(run) == 0 and not (root / "skills" / "new-one").exists()
    assert cli.main([*run, "--yes"]) == 0 and (root / "skills" / "new-one" / "SKILL.md").exists()
    assert cli.main(["install", "--root", str(root), "--plan", str(tmp_path / "absent.json")]) == 1
