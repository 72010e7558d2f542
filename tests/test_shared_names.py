"""Keys of five digits share their sessions' names: every query against its SQL on such tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, compare, connect

SF = "/root/testdata/sf0.001"
#: Suppliers 0 to 9; by their first four digits and animals these are six sessions.
KEYS = "[7, 1000, 10000, 10001, 10004, 10008, 12345, 1234, 20000, 20004]"
KEYED = {"lineitem": "l_suppkey", "supplier": "s_suppkey", "events": "user_id"}
NAMES = [
    "bce_loss", "build_manifest", "combine_overlapping_rois", "contrast_and_brightness", "dilate_mask", "display_normalise",
    "error_overlay", "hit_test", "image_percentiles", "label_boundary", "label_overlay", "rasterise_last_wins",
    "recommended_parameters", "robust_normalise", "roi_summary_of_parts", "session_splits", "sigmoid",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    made = tmp_path_factory.mktemp("shared-names")
    for name in TABLES:
        key = KEYED.get(name)
        swapped = f"replace (cast({KEYS}[{key} % 10 + 1] as bigint) as {key})" if key else ""
        duckdb.connect().execute(f"copy (select * {swapped} from '{SF}/{name}.parquet') to '{made}/{name}.parquet' (format parquet)")
    return str(made)


@pytest.mark.parametrize("name", NAMES)
def test_names_that_keys_share(spark, folder, name):
    compare(spark, connect(folder), folder, entry.queries()[name], entry.oracle_sql()[name])
