"""The content-addressed WARC archive: exact records, revisits, files, and damage."""

import base64
import hashlib
import re
from collections import defaultdict

import pytest

from tessera.llm import warc

SCHEMA = "page_id long, url string, html string, head string, digest long, record string"

ROWS = [
    (1, "http://a.example/1", "<p>one</p>"),
    (2, "http://a.example/2", "<p>one</p>"),
    (9, None, "<p>one</p>"),
    (3, "http://a.example/3 x\r\nWARC-Type: forged", "é" * 70_000),
    (4, "http://a.example/4", None),
    (5, "http://a.example/5", ""),
    (6, "http://a.example/6", "body\r\n\r\nWARC/1.1\r\n\r\n"),
    (7, "http://a.example/7", "twice"),
    (7, "http://a.example/7", "twice"),
    (None, "http://a.example/n", "twice"),
    (None, None, "none"),
    (None, None, "none"),
]


def archive(spark, rows=ROWS, **how):
    pages = spark.createDataFrame([(*r, "h", 1, "r") for r in rows], SCHEMA)
    return warc.write_archive(pages, warc.new_folder(spark), **how)


def test_query_columns(spark):
    got = defaultdict(list)
    out = warc.digests(warc.resolved(warc.parsed(warc.records(archive(spark)))))
    assert out.dtypes == [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")]
    for r in out.collect():
        got[r.page_id].append(tuple(r)[1:])
    payload = {p: (h or "").encode() for p, _, h in ROWS}
    for page, rows in got.items():
        for r in rows:
            assert page is None or r[:2] == (len(payload[page]), base64.b32encode(hashlib.sha1(payload[page]).digest()).decode())
    kind = {p: sorted((r[2], r[3]) for r in rows) for p, rows in got.items() if p is not None}
    assert kind == {
        1: [("revisit", 9)], 2: [("revisit", 9)], 9: [("response", None)], 3: [("response", None)], 4: [("revisit", 5)], 5: [("response", None)], 6: [("response", None)],
        7: [("response", None), ("revisit", 7)],
    }
    assert sorted((r[2:] for r in got[None]), key=str) == [("response", None), ("revisit", 7), ("revisit", None)]
    assert sum(r[2] == "response" for rows in got.values() for r in rows) == len({h or "" for _, _, h in ROWS})


def test_records_are_whole_and_payloads_once(spark):
    made = archive(spark)
    assert sorted(bytes(r.payload) for r in made.payloads.collect()) == sorted({(h or "").encode() for _, _, h in ROWS})
    found = [bytes(r.record) for r in warc.records(made).collect()]
    assert len(found) == len(ROWS)
    for r in found:
        f = warc.parse_record(r)
        head, _, block = r.partition(b"\r\n\r\n")
        assert len(block) == int(f["content-length"]) + 4 and r.count(b"WARC-Type: forged") == 0
        assert (f["warc-type"] == "revisit") == ("warc-refers-to" in f) == ("warc-profile" in f)
        assert re.fullmatch("sha1:[A-Z2-7]{32}", f["warc-payload-digest"])
    whole = sorted(bytes(r.payload) for r in warc.originals(made).collect())
    assert whole == sorted((h or "").encode() for _, _, h in ROWS)


def test_short_payloads_are_all_responses(spark):
    kinds = [r.record_type for r in warc.parsed(warc.records(archive(spark, least=6))).collect()]
    assert kinds.count("revisit") == 2


def test_files_hold_the_same_records(spark):
    made = archive(spark)
    files = warc.write_files(made, warc.new_folder(spark))
    assert sum(r.n_records for r in files.collect()) == len(ROWS)
    assert sorted(bytes(r.record) for r in warc.read_files(files).collect()) == sorted(bytes(r.record) for r in warc.records(made).collect())


def test_records_across_reads_of_a_file():
    import io

    rows = [b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % n + b"x" * n + warc.END for n in (0, 5, 100)]
    for at_once in (1, 7, 1000):
        assert [r.as_py() for b in warc._cut_records(io.BytesIO(b"".join(rows)), at_once) for r in b.column(0)] == rows
    with pytest.raises(ValueError, match="ends within"):
        list(warc._cut_records(io.BytesIO(b"".join(rows)[:-3])))


def test_damage_is_an_error(spark):
    whole = next(bytes(r.record) for r in warc.records(archive(spark)).collect() if b"<p>one" in bytes(r.record))
    for bad in (whole.replace(b"<p>one", b"<p>two"), whole[:-5], whole.replace(b"WARC/1.1", b"WARC/0.9")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_empty_table(spark):
    made = archive(spark, [])
    assert warc.resolved(warc.parsed(warc.records(made))).count() == 0 and made.payloads.count() == 0


def test_oracle(spark):
    import duckdb

    from tessera.llm import queries

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet' UNION ALL SELECT page_id + 1000, url, html FROM '{folder}/pages.parquet' WHERE page_id % 3 = 0")
    spark.createDataFrame(con.sql("SELECT * FROM pages").df()).write.parquet(f"{(at := warc.new_folder(spark))}/pages.parquet")
    got = queries.op11_warc(spark, at)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(warc.oracle_sql()).fetchall())
