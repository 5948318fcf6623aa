"""Radar texts are read block by block."""

import tracemalloc

import pytest

from trackweave.plans.source_queries import _archives
from trackweave.sources import radar

HEAD = "\n".join(f"h{i}" for i in range(len(radar.SHORT)))


@pytest.mark.parametrize("kind", [str, str.encode])
def test_a_long_file_is_never_held_as_lines(kind):
    point = "1.25,2.5,100.0,90.0,3.0\n"
    content = kind("".join(f"TRACK {i}\n{HEAD}\n200\n{point * 200}" for i in range(2_000)))
    tracemalloc.start()
    found = sum(len(row["lines"]) for row in radar.blocks("f", content))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 400_000
    assert peak < len(content) / 10


@pytest.mark.parametrize("text", ["", "x\nTRACK", "a\rTRACK 1\r\nb\x0bc,d TRACK 2\n\nz", "TRACK 1\n" + HEAD + "\r\n1\r1,2\r\n\n", "TRACK 3\n\x85é,1\n", "TRACK 4\nno end"])
def test_lines_are_those_of_splitlines(text):
    assert list(radar._lines(text)) == text.splitlines() == list(radar._lines(text.encode()))
    bad = text.encode() + b"\xe2\x28\n\xff\xe2\x82\nend\xc3"
    assert list(radar._lines(bad)) == bad.decode("utf-8", "replace").splitlines()


def test_archives_come_by_day(spark):
    rows = _archives(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 2 and {r.path.rsplit("/", 1)[-1] for r in rows} == {"days0.zip", "days1.zip"}
