import hashlib
import json

from docquarry.sources.files import bulletins_xml, new_files, read_tle, scan_folder, seed_chunks, seed_documents, seed_satellites, write_chunks, write_markdown

# A public sample record of the format.
TLE = """ISS (ZARYA)
1 25544U 98067A   08264.51782528 -.00002182  00000-0 -11606-4 0  2927
2 25544  51.6416 247.4627 0006703 130.5360 325.0288 15.72125391563537
"""


def test_scan_names_hashes_and_skips(spark, tmp_path):
    for name, data in (("a.pdf", b"one"), ("b.pdf", b"one"), ("c.v2.pdf", b"two"), ("d.txt", b"no")):
        (tmp_path / name).write_bytes(data)
    got = scan_folder(spark, str(tmp_path))
    assert {r.title: r.checksum for r in got.collect()} == {"a": hashlib.sha256(b"one").hexdigest(), "b": hashlib.sha256(b"one").hexdigest(), "c.v2": hashlib.sha256(b"two").hexdigest()}
    known = spark.createDataFrame([(hashlib.sha256(b"two").hexdigest(),)], "checksum string")
    assert [r.title for r in new_files(got, known).collect()] == ["a"]


def test_seed_files(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"title": "t", "source_type": "pdf", "checksum": "c1"}]))
    (tmp_path / "c.json").write_text(json.dumps([{"document_checksum": c, "content": c, "chunk_index": 0, "token_count": 1} for c in ("c1", "c9")]))
    (tmp_path / "s.json").write_text(json.dumps([{"norad_id": 5, "name": "v", "epoch": "2024-01-02T03:04:05+00:00", "source": "x"}, {"norad_id": 6, "epoch": "never"}]))
    docs = seed_documents(spark, str(tmp_path / "d.json"))
    held, rejected = seed_chunks(spark, str(tmp_path / "c.json"), docs)
    assert [r.content for r in held.collect()] == ["c1"] and [r.content for r in rejected.collect()] == ["c9"]
    rows = {r.norad_id: str(r.e) for r in seed_satellites(spark, str(tmp_path / "s.json")).selectExpr("norad_id", "date_format(epoch, 'yyyy-MM-dd HH:mm:ss') e").collect()}
    assert rows == {5: "2024-01-02 03:04:05", 6: "None"}


def test_tle(spark, tmp_path):
    (tmp_path / "x.tle").write_text(TLE + "LOST\n1 00001U\n" + TLE.replace("25544", "25545"))
    rows = read_tle(spark, str(tmp_path / "x.tle")).selectExpr("*", "date_format(epoch, 'yyyy-MM-dd HH:mm') at").orderBy("norad_id").collect()
    assert [r.norad_id for r in rows] == [25544, 25545]
    r = rows[0]
    assert (r.name, r.international_designator, r.inclination, r.eccentricity, r.mean_motion, r.rev_number, r.at) == ("ISS (ZARYA)", "98067A", 51.6416, 0.0006703, 15.72125391, 56353, "2008-09-20 12:25")


def test_xml_and_sinks(spark, tmp_path):
    texts = spark.createDataFrame([(1, "<b><id>n1</id><level>3</level></b>"), (2, None)], "k int, xml string")
    assert [(r.k, r.id, r.level) for r in bulletins_xml(texts, "id string, level int").orderBy("k").collect()] == [(1, "n1", 3), (2, None, None)]
    docs = spark.createDataFrame([("t1", "# A\nx")], "title string, text string")
    write_markdown(docs, str(tmp_path / "md"))
    write_chunks(docs, str(tmp_path / "js"))
    assert spark.read.text(str(tmp_path / "md"), wholetext=True).first().value.strip() == "# A\nx"
    assert spark.read.json(str(tmp_path / "js")).first().title == "t1"
