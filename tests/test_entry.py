"""The driver contract: names agree, and a query of every family equals its oracle at sf0.001."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry
from check import TABLES, norm
from inkstat.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are absent")
SAMPLE = ["a2_pair_items", "a14_release_scores", "b7_prose_view", "b12_reference_events", "c4_redundancy_score", "c13_crossref_score", "c15_citation_isolation",
          "c24_figure_kinds", "d2_cross_perplexity", "e8_strata", "f9_partial_spearman_strata", "f31_poststratification", "g12_multi_key_rank", "g20_source_coverage", "h8_bin_sample", "i11_effects", "k3_coverage_windows"]


def test_registered_names():
    qs, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(qs) and set(SAMPLE) <= set(sqls)
    # the library's own queries; those of a package that may be absent are not counted
    assert len(QUERIES) > 200 and len(QUERIES) - len(ORACLES) <= 13
    assert set(QUERIES) <= set(qs)


def test_imports_without_the_optional_package(tmp_path):
    """A copy without it, with a left-over folder, and without the pipeline still has the library's own queries."""
    root = Path(entry.__file__).parent
    shutil.copytree(root / "inkstat", tmp_path / "inkstat", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    ask = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), e.__file__)"
    for _ in range(2):
        out = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
        assert out[:2] == [str(len(QUERIES)), str(len(ORACLES))] and out[2].startswith(str(tmp_path))
        (tmp_path / "inkstat" / "llm" / "__pycache__").mkdir(parents=True, exist_ok=True)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "doc_id" and df.count() == 200


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(str(tuple(norm(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    assert got == want
