"""Registered queries against their SQL twins.

A quick selection by default; ``ALL_QUERIES=1`` runs every one.
"""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
QUICK = [
    "a1_tensor_csv", "a9_index_decode", "a17_tally_csv", "b4_random_4d", "c2_reverse_axis_1", "d1_add",
    "d8_multiply_2d", "e10_mode_earliest", "f5_midrank_quantiles", "g5_primary_category", "g14_cropped_labels",
    "h9_iou", "i5_rendered_order", "j11_location_names", "k4_clique_communities_3", "l3_extracted_features",
    "m5_blur_masks", "m7_field_crops",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()) if os.environ.get("ALL_QUERIES") else QUICK)
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert ok, note


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
