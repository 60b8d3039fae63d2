"""Paged listings: ranges, listings that loop or stand still, and a stream that goes on where it ended."""

import json

import pytest

from lodestone.sources.paged import followed, paged

SCHEMA = "id long, title string"


@pytest.mark.parametrize(
    ("pages", "want"),
    [
        ({"": ([1], "a"), "a": ([2], "b"), "b": ([3], None)}, [1, 2, 3]),
        ({"": ([1], "a"), "a": ([2], "a")}, [1, 2]),
        ({"": ([1], "a"), "a": ([2], "")}, [1, 2]),
        ({"": ([1], "a"), "a": ([2], "b"), "b": ([3], "a")}, [1, 2, 3]),
        ({"": ([1], "a"), "a": ([], "b"), "b": ([3], None)}, [1]),
        ({"": ([], None)}, []),
    ],
)
def test_followed(pages, want):
    assert [x for items in followed(pages.__getitem__) for x in items] == want


def test_batch(spark):
    def listing(cursor):
        """100 items, ten a page; cursors are numbers of pages."""
        page = int(cursor or 0)
        return [(k, f"t{k}") for k in range(10 * page, 10 * page + 10)], str(page + 1) if page < 9 else None

    spark.dataSource.register(paged("listed", listing, SCHEMA))
    whole = spark.read.format("listed").load()
    assert whole.rdd.getNumPartitions() == 1 and [r.id for r in whole.collect()] == list(range(100))
    parts = spark.read.format("listed").option("ranges", json.dumps([["", "4"], ["4", "7"], ["7", None]])).load()
    assert parts.rdd.getNumPartitions() == 3 and sorted(r.id for r in parts.collect()) == list(range(100))
    assert parts.filter("id = 55").first().title == "t55"


def test_stream_goes_on(spark, tmp_path):
    """A listing that grows between two runs is read once, its last page too."""
    path = tmp_path / "pages.json"

    def grown(cursor):
        pages = json.loads(path.read_text())
        k = int(cursor or 0)
        return [tuple(x) for x in pages[k]], str(k + 1) if k + 1 < len(pages) else None

    spark.dataSource.register(paged("grown", grown, SCHEMA))

    def run():
        out = spark.readStream.format("grown").load().writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").start(f"{tmp_path}/out")
        try:
            out.processAllAvailable()
        finally:
            out.stop()
        return sorted(r.id for r in spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").collect())

    path.write_text(json.dumps([[[1, "a"], [2, "b"]], [[3, "c"]]]))
    assert run() == [1, 2, 3]
    path.write_text(json.dumps([[[1, "a"], [2, "b"]], [[3, "c"], [4, "d"]], [[5, "e"]]]))
    assert run() == [1, 2, 3, 4, 5]
    assert run() == [1, 2, 3, 4, 5]
