"""Archive records, their files and the fixity audit."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from utilscope.llm.warc import END, audit, audit_archive, leaves, read_archive, records, tree, write_archive

SCHEMA = "page_id long, url string, html string, node long, digest string, file int"


def pages(spark, n=700):
    rows = [(i, f"http://h{i % 7}/é{i}", f"<p>{i}\r\n\r\nWARC/1.1 é" * (i % 5), 1, "x", 2) for i in range(n)]
    rows += [(None, None, None, 1, "x", 2), (3, "http://h3/é3", "", 1, "x", 2), (3, "http://h3/é3", "", 1, "x", 2)]
    return spark.createDataFrame(rows, SCHEMA)


def test_files_hold_the_records_that_the_leaves_tell(spark, tmp_path):
    rows = records(pages(spark))
    path = str(tmp_path / "archive")
    write_archive(rows, path)
    told = leaves(rows).select("file", "place", "start", "length", "digest")
    assert sorted(told.collect()) == sorted(read_archive(spark, path).collect())
    first = (tmp_path / "archive" / "file=0").glob("*.txt").__next__().read_bytes()
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: resource\r\n") and first.endswith(b"\r\n\r\n")


def test_the_audit_names_the_damaged_records(spark):
    rows = records(pages(spark))
    ours = tree(leaves(rows))
    assert audit(ours, tree(leaves(rows))).collect() == []
    hit = F.col("id") == 400
    found = leaves(rows.withColumn("record", F.when(hit, F.lit("other")).otherwise(F.col("record"))))
    theirs = tree(found.where("id is null or id != 650"))
    wrong = {r["node"]: r["kind"] for r in audit(ours, theirs).collect()}
    place = {r["id"]: r["file"] * 256 + r["place"] for r in leaves(rows).collect()}
    assert wrong == {place[400]: "changed", place[650]: "missing"}
    assert {r["kind"] for r in audit(theirs, ours).collect()} == {"changed", "extra"}


def test_only_mismatching_branches_are_compared(spark):
    ours = tree(leaves(records(pages(spark))))
    assert [level.count() for level in ours] == [703, 44, 3, 1]
    root = ours[-1].first()
    assert root["records"] == 703 and root["length"] == sum(r["length"] for r in ours[0].collect())


def test_replicas_of_other_height_and_empty_ones(spark):
    few, many = tree(leaves(records(pages(spark, 5)))), tree(leaves(records(pages(spark, 300))))
    assert len(few) < len(many)
    nothing = tree(leaves(records(pages(spark).limit(0))))
    assert audit(nothing, nothing).collect() == []
    assert {r["kind"] for r in audit(few, nothing).collect()} == {"missing"}
    assert audit(nothing, many).where("kind = 'extra'").count() == 303
    assert str(uuid.UUID(records(pages(spark, 1)).first()["record"].split("urn:uuid:")[1][:36]))


def test_damaged_files_are_audited_record_by_record(spark, tmp_path):
    rows = records(pages(spark))
    expected = leaves(rows).cache()
    write_archive(rows, str(tmp_path / "archive"))
    told = {(r["file"], r["place"]): (r["start"], r["start"] + r["length"]) for r in expected.collect()}

    def damaged(name, *changes):
        """The audit of the archive with bytes of records changed, the last ones of a file first."""
        for number in range(3):
            content = next((tmp_path / "archive" / f"file={number}").glob("*.txt")).read_bytes()
            for file, place, change in changes:
                if file == number:
                    start, end = told[file, place]
                    content = content[:start] + change(content[start:end]) + content[end:]
            folder = tmp_path / name / f"file={number}"
            folder.mkdir(parents=True)
            (folder / "part.txt").write_bytes(content)
        return sorted((r["node"], r["kind"]) for r in audit_archive(spark, str(tmp_path / name), expected).collect())

    cut_out = lambda record: b""
    longer = lambda record: record.replace(b"Content-Length: ", b"Content-Length: 9")
    no_length = lambda record: record.replace(b"Content-Length: ", b"Content-Length: x")
    no_magic = lambda record: b"w" + record[1:]
    half = lambda record: record[:len(record) // 2] + END.encode()
    assert damaged("whole") == []
    assert damaged("cut", (0, 10, cut_out)) == [(10, "missing")]
    assert damaged("length", (1, 100, longer)) == [(256 + 100, "changed")]
    assert damaged("many", (0, 254, half), (0, 200, no_magic), (0, 101, longer), (0, 100, cut_out), (0, 0, no_length),
                   (1, 255, half), (1, 0, cut_out)) == [
        (0, "changed"), (100, "missing"), (101, "changed"), (200, "changed"), (254, "changed"), (256, "missing"), (511, "changed")]


def test_a_record_too_many_has_no_place(spark, tmp_path):
    rows = records(pages(spark, 5))
    write_archive(rows, str(tmp_path / "archive"))
    content = next((tmp_path / "archive" / "file=0").glob("*.txt")).read_bytes()
    (tmp_path / "more" / "file=0").mkdir(parents=True)
    (tmp_path / "more" / "file=0" / "part.txt").write_bytes(content + b"WARC/1.1\r\nContent-Length: 1" + END.encode() + b"x" + END.encode())
    got = audit_archive(spark, str(tmp_path / "more"), leaves(rows)).collect()
    assert [(r["node"], r["kind"], r["expected"]) for r in got] == [(None, "extra", None)]
