"""Queries over the answers of all frames where some texts are empty, against their SQL."""

import glob
import os

import duckdb
import pytest

from assayer import catalog
from test_oracles import DATA, normal

#: Queries that failed by a division by zero.
NAMES = [
    "answer_matches",
    "cluster_bootstrap",
    "card_digest",
    "cluster_sizes",
    "dataset_export",
    "design_effects_by_task",
    "design_effect",
    "error_dependence",
    "figure_tables",
    "fleiss_panel",
    "gold_and_unlabelled",
    "headline_rates",
    "gold_needed",
    "iid_bootstrap",
    "logprob_answers",
    "margins",
    "ppi_variance_split",
    "prevalence_naive",
    "prevalence_ppi_classical",
    "prevalence_ppi_clustered",
    "prevalence_ppi_plus",
    "published_comparison",
    "replication_verdicts",
    "response_violations",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The smallest tables with 40 empty documents, half of them labelled."""
    out = str(tmp_path_factory.mktemp("empty"))
    more = {
        "documents": "SELECT 1000 + i, '', ['en', 'fr', 'de', 'es'][i % 4 + 1], 'web-' || i % 3, 0 FROM range(40) t(i)",
        "labels": "SELECT 1000 + i, (i % 4 = 0)::INT, (i % 6 = 0)::INT FROM range(0, 40, 2) t(i)",
    }
    for f in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(f)[:-8]
        if name in more:
            duckdb.sql(f"COPY (SELECT * FROM '{f}' UNION ALL {more[name]}) TO '{out}/{name}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f, f"{out}/{name}.parquet")
    return out


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_empty_texts(spark, duck, folder, name):
    got = catalog.QUERIES[name](spark, folder).toPandas()
    want = duck.execute(catalog.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
