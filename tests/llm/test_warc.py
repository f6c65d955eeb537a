"""WARC bundles: round trip, single records, revisits against SQL."""

import duckdb
import pytest

from casewright.llm import warc

PAGES = "page_id bigint, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    long = "<html>" + "é" * 600 + "</html>"
    rows = [(i, f"http://x/{i}", long if i % 4 == 0 else f"<p>{i}\r\n\r\n</p>" * (i % 90)) for i in range(200)] + [(300, None, None), (301, "a\r\nb", ""), (302, "u", "WARC/1.1\r\n\r\n" * 200), (303, "u", "x" * 700_000), (304, "v", "x" * 700_000)]
    return spark.createDataFrame(rows, PAGES).repartition(3)


def test_round_trip(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/w"
    index = warc.write(pages, folder, frame_bytes=5000, bundle_bytes=2000)
    source = {r.page_id: r.html or "" for r in pages.collect()}
    back = {r.page_id: r for r in warc.read(spark, folder).collect()}
    assert set(back) == set(source)
    for i, html in source.items():
        assert back[i].payload_bytes == len(html.encode())
        held = back[i if back[i].record_type == "response" else back[i].refers_to]
        assert bytes(held.payload) == html.encode() and held.record_type == "response"
    entries = {r.record_id: r.asDict() for r in index.collect()}
    for i in (0, 7, 300, 302, 303):
        headers, block = warc.fetch(folder, entries[warc.record_id(i)])
        assert headers["X-Page-ID"] == str(i) and block == (source[i].encode() if headers["WARC-Type"] == "response" else b"")
    assert len({e["bundle"] for e in entries.values()}) > 3


def test_seek_table_is_a_frame_that_readers_skip(spark, pages, tmp_path):
    import zstandard

    warc.write(pages, f"file://{tmp_path}/w")
    for path in (tmp_path / "w").glob("*.zst"):
        data = path.read_bytes()
        table = warc.read_seek_table(data)
        plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert sum(x[2] for x in table) == len(plain) and len(list(warc.parse(plain))) > 0
        with pytest.raises(ValueError):
            warc.read_seek_table(data[:-1])


def test_op5_against_sql(spark, pages, tmp_path):
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = c.execute(warc.OP5_SQL)
    columns = [x[0] for x in found.description]
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r)) for r in warc.op5_warc(spark, str(tmp_path)).select(*columns).collect())


def test_awkward(spark, tmp_path):
    rows = [(1, None, "y" * 2000, 1), (1, None, "y" * 2000, 2), (None, "u", "y" * 2000, 3), (None, None, None, None)]
    df = spark.createDataFrame(rows, PAGES + ", payload_bytes int")
    warc.write(df, f"file://{tmp_path}/a")
    assert warc.read(spark, f"file://{tmp_path}/a").count() == 4
    warc.write(df.limit(0), f"file://{tmp_path}/b")
    assert warc.read(spark, f"file://{tmp_path}/b").count() == 0


def test_damage_is_found():
    data = warc.record(1, "u", b"abc", "a9993e364706816aba3e25717850c26c9cd0d89d", None)
    ((headers, block),) = warc.parse(data)
    assert warc._row(headers, block, True)[-1] == b"abc"
    with pytest.raises(ValueError):
        warc._row(headers, b"abd", True)
    with pytest.raises(ValueError):
        list(warc.parse(data.replace(b"Length: 3\r\n\r\n", b"Length: 2\r\n\r\n")))
