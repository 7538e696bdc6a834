"""Queries that left out rows of their tables."""

import duckdb
import numpy as np
import pytest

from tilewright.plans import model_queries, standins

from tests.conftest import SMALL
from tests.test_resampling import plain_fit


def test_cross_validation_of_four_takes_every_field(spark, tmp_path):
    con = duckdb.connect()
    own = f"SELECT * FROM '{SMALL}/lineitem.parquet'"
    odd = " UNION ALL ".join(f"(SELECT * REPLACE ({c}) FROM '{SMALL}/lineitem.parquet' LIMIT 400)" for c in ("-l_suppkey - 1 AS l_suppkey", "NULL AS l_suppkey", "NULL AS l_shipdate"))
    con.execute(f"COPY ({own} UNION ALL {odd}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    f = con.execute(f"WITH {standins.SQL['features']} SELECT slide_id, coverage, edges, entropy, contrast FROM features").df()
    assert f["contrast"].isna().sum() > 100 and f["slide_id"].isna().any() and (f["slide_id"] < 0).any()
    x = f[list(model_queries.NAMES)].to_numpy(np.float64)
    y = np.clip(np.floor((x[:, 0] - 0.3) * 8 + (x[:, 1] - 0.3) * 3), 0, 4).astype(int)
    fold = f["slide_id"].mod(8).fillna(0).to_numpy(np.int64)
    got = {r.fold: r for r in model_queries.cross_validate_four(spark, str(tmp_path)).collect()}
    assert sum(r.n for r in got.values()) == len(f)
    for k in range(8):
        held = fold == k
        score, cuts = plain_fit(x[~held], y[~held], 5)
        s = score(x[held])
        assert min(abs(s - t).min() for t in cuts) > 1e-9
        gap = np.abs((s[:, None] >= np.array(cuts)).sum(1) - y[held])
        assert (got[k].n, got[k].exact, got[k].within_one) == (held.sum(), pytest.approx((gap == 0).mean(), abs=1e-6), pytest.approx((gap <= 1).mean(), abs=1e-6))
