"""Every speech query against its SQL on the smallest tables, and the entry module without the corpus operators."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from voxlake.plans import speech

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def tables():
    own = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        own.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return own


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    shown = lambda v: "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(shown(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(speech.QUERIES))
def test_query(spark, tables, name):
    df = speech.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows or name == "resample_8k"
    if name in speech.ORACLES:
        want = tables.sql(speech.ORACLES[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert canonical(rows, df.columns) == canonical(want.fetchall(), want.columns)


def test_entry_without_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py",):
        (tmp_path / name).write_text((ROOT / name).read_text())
    (tmp_path / "voxlake").mkdir()
    for child in (ROOT / "voxlake").iterdir():
        if child.name != "llm":
            (tmp_path / "voxlake" / child.name).symlink_to(child)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-B", "-c", code], check=True, cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)})
