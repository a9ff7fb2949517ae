"""Captures in folders as channels: a restart reads nothing twice, a broken one doesn't stop the others."""

import pytest

from evidex.sources import stream

FEED = "<rss>{}</rss>"
ITEM = "<item><title>{0}</title><link>https://n.example.com/{0}</link></item>"


@pytest.fixture
def folders(tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
    return tmp_path


def put(folder, name, *titles):
    folder.joinpath(name).write_text(FEED.format("".join(ITEM.format(t) for t in titles)))


def taken(spark, out, what):
    return sorted(tuple(r) for r in spark.read.parquet(f"{out}/{what}").select("source_id", "title" if what == "items" else "reason").collect())


def test_a_restart_reads_nothing_twice(spark, folders, tmp_path):
    out = str(tmp_path / "out")
    sources = [{"id": n, "channel": "rss", "folder": str(folders / n)} for n in ("a", "b", "gone")]
    put(folders / "a", "001.xml", "one", "two")
    put(folders / "a", "002.xml", "three")
    put(folders / "b", "001.xml", "x")
    put(folders / "b", "_hidden.xml", "never")
    stream.take_in(spark, sources, out)
    assert taken(spark, out, "items") == [("a", "one"), ("a", "three"), ("a", "two"), ("b", "x")]
    put(folders / "b", "002.xml", "y")
    (folders / "a" / "003.xml").write_text("")
    stream.take_in(spark, sources, out)
    stream.take_in(spark, sources, out)
    assert taken(spark, out, "items") == [("a", "one"), ("a", "three"), ("a", "two"), ("b", "x"), ("b", "y")]
    assert [r[0] for r in taken(spark, out, "failures")] == ["a"]


def test_offsets_do_not_go_back(folders):
    for n in range(5):
        put(folders / "a", f"{n}.xml", f"t{n}")
    options = {"sources": f'[{{"id": "a", "channel": "rss", "folder": "{folders / "a"}"}}]', "batch": "2", "state": str(folders / "state.json")}
    reader = stream.ChannelReader(options)
    end = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), end)
    assert [[row[5].decode().split("<title>")[1][:2] for row in reader.read(p)] for p in parts] == [["t0", "t1"], ["t2", "t3"], ["t4"]]
    reader.commit(end)
    (folders / "a").rename(folders / "away")
    again = stream.ChannelReader(options)
    assert again.latestOffset() == end == {"a": "4.xml"} and again.partitions(end, again.latestOffset()) == []
    (folders / "away").rename(folders / "a")
    put(folders / "a", "5.xml", "t5")
    assert [p.names for p in again.partitions(end, again.latestOffset())] == [["5.xml"]]
