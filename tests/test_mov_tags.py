"""Tags and tracks of MOV files from one pass over their bytes."""

from cuemill.jobs import catalog
from cuemill.sources import containers, mov_writer


def test_files_are_parsed_once(spark, sf_dir):
    """One Python pass makes the files, one reads them; no pandas frame per file."""
    plan = catalog.QUERIES["mov_tags"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and plan.count("MapInArrow") == 2


def test_broken_tags_leave_the_tracks_and_the_other_way(spark):
    """Either part of a file is whole or not there, and a tag of its own may be named like a track's."""
    good = mov_writer.movie([b"x"], [1], language=5575, handler_name="h", ilst=mov_writer.freeform("m", "language", "any") + mov_writer.data_atom(b"\xa9nam", 1, b"t"))
    odd = mov_writer.movie([b"x"], [1], handler_name="", ilst=mov_writer.data_atom(b"\xa9nam", 1, b"\xff"))
    bare = mov_writer.box(b"moov", mov_writer.box(b"udta", mov_writer.full(b"meta", mov_writer.box(b"ilst", mov_writer.data_atom(b"\xa9nam", 1, b"t")))))
    files = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate((good, odd, bare, odd.replace(b"\xff", b"x")))], "file_id bigint, content binary")
    got = sorted(tuple(r) for r in containers.mov_tags(files).select("file_id", "key", "value").collect())
    assert got == [(0, "handler_name", "h"), (0, "language", "any"), (0, "language", "eng"), (0, "title", "t"), (2, "title", "t"), (3, "title", "x")]
