"""Vault queries on a cluster."""

import pytest

from driftline.plans import catalogue, reg_streaming
from driftline.sources import listing


@pytest.fixture
def documents(spark, tmp_path):
    rows = [(i, f"src{i % 2}", ("en", "de")[i % 3 % 2], "text" * i, 4 * i) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["src1_vault_rows", "src1_vault_scan"])
def test_vault_queries_on_a_cluster_whose_shared_folder_has_no_scheme(spark, documents, monkeypatch, name):
    monkeypatch.setattr(listing, "is_local", lambda spark: False)
    monkeypatch.setattr(reg_streaming, "scratch_path", lambda spark, label: f"{documents}/shared/{label}")
    rows = catalogue.QUERIES[name](spark, documents).collect()
    files = [r for r in rows if r.kind != "folder"]
    assert len(files) == (12 if name == "src1_vault_rows" else 4)
    sizes = [r.size if name == "src1_vault_rows" else r.n_bytes for r in files]
    assert sum(sizes) == sum(4 * i for i in range(12)) + (0 if name == "src1_vault_rows" else 12)
