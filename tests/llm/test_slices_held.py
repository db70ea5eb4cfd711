"""What a task of op13 holds at once doesn't grow with its input split."""

import glob

import pyarrow.parquet as pq
from eventloom.llm import alignment


def test_row_groups_of_slices_are_small(spark, monkeypatch):
    """A reader holds a row group's rows at once, so a group has few slices, however many a task writes."""
    paths, written = [], alignment.written
    monkeypatch.setattr(alignment, "written", lambda df, name, **options: paths.append(name) or written(df, name, **options))
    docs = spark.createDataFrame([(k, f"some words {k % 7} of a text") for k in range(60)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in alignment.alignment(docs, limit=30).collect()}
    assert len(got) == 60 and got[3].n_best == got[10].n_best and paths == ["slices", "pair-counts", "alignment"]
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://").removeprefix("file:")
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{shared}/eventloom/slices-*/*.parquet")]
    most = max((m.row_group(g).num_rows for m in files for g in range(m.num_row_groups)), default=0)
    assert max(m.num_rows for m in files) >= 30 and 0 < most <= 4
