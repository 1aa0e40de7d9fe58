"""Tables whose rows are some MB each hold every row in a row group of its own, so neither their writer nor their reader has more of them at once."""

import glob

import pyarrow.parquet as pq
import pytest

from tidemark.llm.decontaminate import build
from tidemark.llm.packing import encode


@pytest.mark.parametrize("make", [build, encode])
def test_each_row_is_read_alone(spark, make):
    text = "some words of a text that is long " * 140_000  # more than a step of 4 MB
    table = make(spark.createDataFrame([(k, text) for k in range(3)], "doc_id long, text string").coalesce(1))
    (file,) = glob.glob(f"{table.stored_at.removeprefix('file:')}/part-*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert [meta.row_group(k).num_rows for k in range(meta.num_row_groups)] == [1, 1, 1]
    assert table.count() == 3
