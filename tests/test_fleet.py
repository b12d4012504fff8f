"""The inventory that grows with the parts."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vigil import vocab
from vigil.plans import corpus

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


def test_every_part_is_an_asset(spark):
    fleet, parts = corpus.fleet(spark, SF), corpus.load(spark, SF, "part").count()
    assert fleet.count() == fleet.select("asset_id").distinct().count() == parts > 150
    assert fleet.groupBy("owner_id").count().agg(F.max("count")).first()[0] <= vocab.MAX_ASSETS
