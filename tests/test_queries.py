"""Every registered query of the engine against SQL on the same tables."""

import pytest

from folium import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(name, same_as_sql):
    same_as_sql(registry.QUERIES[name], registry.ORACLES[name])


def test_singular_values(spark, sf_dir):
    import numpy as np

    m = np.array([r[0] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("embedding").collect()], float)
    expected = np.linalg.svd(m, compute_uv=False)[:10]
    got = [r["s"] for r in registry.QUERIES["svd_singular_values"](spark, sf_dir).orderBy("k").collect()]
    assert np.allclose(got, expected, atol=1e-3)


def test_reconstruction_keeps_norms_of_the_leading_subspace(spark, sf_dir):
    import numpy as np

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    m = np.array([r[1] for r in rows], float)
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    norms = np.sqrt(((u[:, :10] * s[:10]) ** 2).sum(axis=1))
    got = {r["row"]: r["norm"] for r in registry.QUERIES["svd_reconstruction"](spark, sf_dir).collect()}
    assert np.allclose([got[r[0]] for r in rows], norms, atol=1e-2)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert not __spark_entry__.entry(spark).isEmpty()
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(registry.ORACLES) <= set(__spark_entry__.oracle_sql())
