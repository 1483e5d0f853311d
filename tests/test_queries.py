import pytest
from oracle import compare

from riskweave.operators.rules import ALL_SIGNALS
from riskweave.plans.planted import NUMBER, PLANTS
from riskweave.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.001")


def test_package_queries_read_every_document(spark, tmp_path):
    texts = {0: "import os, requests", 5: None}
    rows = [(n, texts.get(n, f"Plain text {n}.")) for n in range(16)] + [(None, "Plain.")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    verdicts = {r["skill_id"]: (r["verdict"], r["category"]) for r in run("package_verdicts")}
    assert set(verdicts) == {f"p{n}" for n in (-1, *range(16))}
    # The first plants are whole packages: flows, a bridge over one path and none over two, a bundled file, a safe loader, an own key.
    assert [verdicts[f"p{n}"][0] for n in (0, 1, 2, 3, 4, 5, 7, 9, 10, 12)] == ["malicious"] * 7 + ["benign", "suspicious", "benign"]
    flows = {(r["skill_id"], r["rule_id"]) for r in run("package_flows")}
    assert {("p0", "R0001"), ("p1", "R0002"), ("p2", "R0003"), ("p3", "R0004"), ("p4", "R0005"), ("p5", "R0006")} <= flows
    assert not any(p in ("p6", "p9", "p12") for p, r in flows if r == "R0006")
    taken = [n % NUMBER for n in (-1, *range(16))]
    assert len(run("path_roles")) == sum(taken.count(p[0]) for p in PLANTS) and len(run("document_signals")[0]) == 1 + len(ALL_SIGNALS)
