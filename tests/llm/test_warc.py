import pytest

from assetsweep.llm import warc
from assetsweep.llm.common import filesystem


def pages(spark):
    big = "é" * 600
    rows = [(1, "http://a", big), (2, "http://b", big), (9, "http://c", big), (3, "http://d", "small"), (4, "http://e", "small"),
            (5, None, None), (6, "http://f\r\nx: y", ""), (7, "u", "z" * 400_000), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 100),
            (None, "n", big), (2, "http://b", big)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_id", warc.F.lit("clash"))


def test_round_trip(spark):
    p = pages(spark)
    index = warc.write_archive(p, frame_bytes=4096, bundle_bytes=10_000)
    got = warc.read_archive(index).collect()
    want = sorted(((r.page_id, r.html or "") for r in p.collect()), key=str)
    full = {r.record_id: r for r in got}
    back = []
    for r in got:
        source = r if r.record_type == "response" else full[r.refers_to]
        assert r.payload_digest == source.payload_digest and r.payload_bytes == len(source.payload)
        back.append((None if r.record_id is None else int(r.record_id), source.payload.decode()))
    assert sorted(back, key=str) == want
    kinds = sorted((str(r.record_id), r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([("1", "revisit", "9"), ("2", "revisit", "9"), ("2", "revisit", "9"), ("None", "revisit", "9"), ("9", "response", None)]
                           + [(str(k), "response", None) for k in (3, 4, 5, 6, 7, 8)])


def test_one_record_is_read_by_its_frame_and_seek_table_agrees(spark):
    index = warc.write_archive(pages(spark), frame_bytes=2048).cache()
    one = warc.read_archive(index.where("record_id = '7'")).collect()
    assert len(one) == 1 and one[0].payload == b"z" * 400_000
    for bundle in {r.bundle for r in index.collect()}:
        fs, path = filesystem(bundle)
        with fs.open_input_file(path) as f:
            table = warc.seek_table(lambda at, n: f.read_at(n, at), f.size())
            rows = [r for r in index.collect() if r.bundle == bundle]
            assert {(r.frame_offset, r.frame_bytes) for r in rows} == {(a, n) for a, n, _ in table}
            for r in rows:
                assert r.record_offset + r.record_bytes <= table[r.frame][2]
            # A plain decoder reads the whole bundle as one stream and skips the seek table.
            import zstandard
            with fs.open_input_stream(path, compression=None) as s:
                plain = zstandard.ZstdDecompressor().stream_reader(s, read_across_frames=True).read()
            assert len(plain) == sum(n for _, _, n in table)
            index.unpersist()


def test_empty_table_and_damage(spark):
    assert warc.read_archive(warc.write_archive(pages(spark).limit(0))).collect() == []
    raw = warc.record_bytes("1", "u", b"abc", "00", None)
    with pytest.raises(ValueError):
        warc.parse_record(raw)
