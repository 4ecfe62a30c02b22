import os

import pytest

from lexgrove.plans import catalogue
from lexgrove.sources.store import IndexStore

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_every_document_takes_part(spark, monkeypatch):
    seen, rebuild = [], IndexStore.rebuild
    monkeypatch.setattr(IndexStore, "rebuild", lambda self, rows, *a, **k: seen.append(rows.count()) or rebuild(self, rows, *a, **k))
    catalogue.upsert_find(spark, SMALL)
    assert seen == [spark.read.parquet(f"{SMALL}/documents.parquet").count()]
