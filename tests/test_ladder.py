"""Files of four encodings, drifting headers and broken lines in one reading."""

from pricestrata.sources import ladder


def test_encodings_headers_and_broken_lines(spark, tmp_path):
    files = {
        "a.csv": "﻿Id,Part Name\r\n1,vänster dörr\r\n2,\"quoted, comma\"\r\n".encode(),
        "b.csv": "id,part name\n3,höger €\n4,too,many\n\n5\n6,ok\n".encode(),
        "c.csv": "part name,id\nmärke,7\n".encode("latin-1"),
        "d.csv": "id,part name\n8,pris 5 € – ny\n".encode("cp1252"),
        "e.csv": b"",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = ladder.read_ladder(spark, str(tmp_path))
    rows = {r["id"]: (r["part_name"], r["source_file"].rsplit("/", 1)[1], r["line"]) for r in got.rows.collect()}
    assert rows == {"1": ("vänster dörr", "a.csv", 2), "2": ("quoted, comma", "a.csv", 3), "3": ("höger €", "b.csv", 2), "6": ("ok", "b.csv", 6), "7": ("märke", "c.csv", 2), "8": ("pris 5 € – ny", "d.csv", 2)}
    assert sorted((r["source_file"][-5:], r["line"], r["text"]) for r in got.quarantine.collect()) == [("b.csv", 3, "4,too,many"), ("b.csv", 5, "5")]
    assert {r["source_file"][-5:]: r["encoding"] for r in got.encodings.collect()} == {"a.csv": "utf-8", "b.csv": "utf-8", "c.csv": "iso-8859-1", "d.csv": "cp1252"}
    ladder.keep_quarantine(got, str(tmp_path / "bad"))
    ladder.keep_quarantine(got, str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 4


def test_lines_of_a_split_file_keep_their_numbers(spark, tmp_path):
    (tmp_path / "big.csv").write_text("id;v\n" + "".join(f"{i};x\n" for i in range(2, 3000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = ladder.read_ladder(spark, str(tmp_path / "big.csv"), ";")
        assert got.rows.where("cast(id as long) <> line").count() == 0 and got.rows.count() == 2998
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
