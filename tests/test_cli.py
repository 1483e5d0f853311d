import json

import pytest

from riskweave.cli import main, overlap, seconds
from riskweave.sources.packages import COUNTERS, guarded


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "in" / "notes").mkdir(parents=True)
    (tmp_path / "in" / "notes" / "README.md").write_text("A list of notes.")
    return tmp_path


def test_complete_scan(spark, tree):
    assert main([str(tree / "in"), str(tree / "out"), "--collection"], spark) == 0
    assert (tree / "out" / "scan-complete.json").is_file() and not list((tree / "out").glob("_analysis*"))
    assert [json.loads(r["value"])["verdict"] for r in spark.read.text(str(tree / "out" / "results")).collect()] == ["benign"]


def test_incomplete_scan(spark, tree):
    (tree / "in" / "notes" / "a.zip").write_bytes(b"PK")
    assert main([str(tree / "in"), str(tree / "out")], spark) == 3
    assert main([str(tree / "in"), str(tree / "out2"), "--allow-partial"], spark) == 0


def test_bounds_and_the_variable_for_partial_scans(spark, tree, monkeypatch):
    given = [str(tree / "in"), str(tree / "out")]
    assert main([*given, "--max-visited", "0"], spark) == main([*given, "--max-report-mib", "0"], spark) == 2
    assert not (tree / "out" / "scan-complete.json").exists() and not list((tree / "out").glob("_analysis*"))
    (tree / "in" / "notes" / "a.zip").write_bytes(b"PK")
    monkeypatch.setenv("RISKWEAVE_ALLOW_PARTIAL", "true")
    assert main(given, spark) == 0


def test_refusals(spark, tree):
    inside = str(tree / "in" / "notes" / "out")
    assert main([str(tree / "in"), inside], spark) == 2
    assert main([str(tree / "none"), str(tree / "out")], spark) == 2
    assert main([str(tree / "in")], spark) == main([str(tree / "in"), "x", "--single", "--collection"], spark) == main([str(tree / "in"), "x", "--timeout", "25h"], spark) == 2
    assert main([str(tree / "in"), str(tree / "late"), "--timeout", "0.01"], spark) == 2
    assert overlap("/a/b", "/a") and not overlap("/a/b", "/a/bc") and seconds("2h") == 7200


def test_a_package_that_cannot_be_read_is_incomplete(monkeypatch):
    from riskweave.sources import packages

    def broken(*_):
        raise RuntimeError("x")
        yield

    monkeypatch.setattr(packages, "read_package", broken)
    rows = list(guarded("a", "/nowhere"))
    assert len(rows) == 1 and rows[0][1] == "status" and rows[0][8 + len(COUNTERS)] is False
