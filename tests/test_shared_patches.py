"""Training patches of sessions whose names several keys share, against their SQL."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from test_shared_names import folder  # noqa: F401


@pytest.mark.parametrize("name", ["train_val_patches", "patch_dataset"])
def test_patches_of_names_that_keys_share(spark, folder, name):  # noqa: F811
    compare(spark, connect(folder), folder, entry.queries()[name], entry.oracle_sql()[name])
