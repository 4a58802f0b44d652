"""The registered queries give the same rows when every session counts as hot."""

import pytest

from spikegrid.plans import base, catalog, null_scores, recordings, remapping, reports, spatial, units
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = ["track_speed", "head_direction", "track_boxcar", "isi_stats", "bursts_split", "asof_nearest", "map_stats", "hd_vector",
         "gauss_smooth_1d", "sliced_w", "temporal_emd", "adaptive_rate", "isolation_2d", "mann_whitney_u", "weighted_ks",
         "bh_correction", "object_history", "value_quantiles", "null_report", "rate_slots", "unit_mixture", "windowed_speed"]


@pytest.fixture()
def hot(monkeypatch):
    small = base.OPTIONS.but(rows_per_chunk=15)
    for module in (base, null_scores, recordings, remapping, reports, spatial, units):
        monkeypatch.setattr(module, "OPTIONS", small)
    return small


@pytest.mark.parametrize("name", NAMES)
def test_hot(spark, hot, name):
    assert compare(catalog.QUERIES[name](spark, SF), connect(SF), catalog.ORACLE[name]) is None
