"""The text sink under failures, and containers of both layouts."""

import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from tidewrack.sources import containers, sinks


def files(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n)).read() for d, _, names in os.walk(root) for n in names if not n.startswith(".")}


def modules(spark, *rows):
    return spark.createDataFrame([(n, c) for n, c in rows], "filename string, code string").repartition(3)


def test_files_appear_and_are_not_replaced_unasked(spark, tmp_path):
    root = str(tmp_path / "out")
    sinks.write_files(modules(spark, ("a.js", "1"), ("lib/./b.js", "é"), ("lib/c.js", None)), root)
    assert files(root) == {"a.js": "1", "lib/b.js": "é", "lib/c.js": ""}
    with pytest.raises(Exception, match="already there"):
        sinks.write_files(modules(spark, ("new.js", "2"), ("lib/b.js", "3")), root)
    assert files(root) == {"a.js": "1", "lib/b.js": "é", "lib/c.js": ""} and not [x for x in os.listdir(root) if x.startswith(".")]
    sinks.write_files(modules(spark, ("new.js", "2"), ("lib/b.js", "3")), root, replace=True)
    assert files(root) == {"a.js": "1", "lib/b.js": "3", "lib/c.js": "", "new.js": "2"}
    sinks.write_files(modules(spark, ("none.js", "")).limit(0), root)


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    bad = modules(spark, *((f"f{i}.js", "x") for i in range(20))).withColumn("code", F.when(F.col("filename") == "f7.js", F.raise_error(F.lit("no code"))).otherwise(F.col("code")))
    with pytest.raises(Exception, match="no code"):
        sinks.write_files(bad, root)
    assert files(root) == {} and not (os.path.exists(root) and os.listdir(root))


def test_names_that_lead_out_and_names_given_twice(spark, tmp_path):
    for name in ("../x.js", "a/../../x.js", "/etc/x.js", "", ".", "a/..", None):
        with pytest.raises(ValueError, match="unsafe"):
            sinks.write_files(modules(spark, ("a.js", "1"), (name, "2")), str(tmp_path / "out"))
    with pytest.raises(ValueError, match="2 modules claim 'a/b.js'"):
        sinks.write_files(modules(spark, ("a/b.js", "1"), ("A/./B.js", "2")), str(tmp_path / "out"))
    (tmp_path / "out").mkdir()
    (tmp_path / "other").mkdir()
    os.symlink(tmp_path / "other", tmp_path / "out" / "link")
    with pytest.raises(Exception, match="leads out"):
        sinks.write_files(modules(spark, ("link/x.js", "1"), ("ok.js", "1")), str(tmp_path / "out"))
    assert files(tmp_path / "other") == {} and files(tmp_path / "out") == {}


def test_envelopes(spark):
    made = spark.createDataFrame([("in", "amd", "b.js", "javascript", "done", None), ("in", "amd", "a.js", "javascript", "done", "src/a.js"), ("other", "plain", "c.js", "javascript", "done", None)], "input string, format string, filename string, kind string, status string, source_filename string")
    said = spark.createDataFrame([("in", "b.js", "parse", True, "x"), ("in", "b.js", "note", False, "y"), ("gone", "z.js", "read", True, "z")], "input string, filename string, kind string, is_error boolean, message string")
    got = {r.input: json.loads(r.json) for r in sinks.envelope_json(made, said, "input").collect()}
    assert [m["filename"] for m in got["in"]["modules"]] == ["a.js", "b.js"] and "source_filename" not in got["in"]["modules"][1]
    assert (got["in"]["total"], got["in"]["failed"], len(got["in"]["warnings"]), got["in"]["detected_formats"]) == (2, 1, 2, ["amd"])
    assert (got["other"]["failed"], got["other"]["warnings"], got["gone"]["total"], got["gone"]["modules"]) == (0, [], 0, [])


def container(size, entries, entry=0, prefix=b"MZ\xff", change=None, kinds=bytes([2, 1, 1, 0])):
    data, records = bytearray(), bytearray()
    for name, contents in entries:
        record = bytearray(size)
        for at, part in ((0, name), (8, contents)):
            struct.pack_into("<II", record, at, len(data), len(part))
            data += part + b"\0"
        record[containers.LAYOUTS[size][1] :] = kinds
        records += record
    table = len(data)
    data += records
    if change:
        change(data, table)
    return prefix + bytes(data) + struct.pack("<QIIIIII", len(data), table, len(records), entry, 0, 0, 0) + containers.TRAILER


def test_containers_of_both_layouts(spark):
    some = [(b"/root/entry.js", b"console.log(1)"), (b"asset-\xff", b"")]
    rows = [(k, container(size, some, entry=1)) for k, size in enumerate(containers.LAYOUTS)] + [(2, b"no trailer"), (3, None), (4, container(52, some) + b"signature")]
    got = sorted((r.id, r.file_index, r.name, bytes(r.contents), r.is_entry, r.encoding, r.format, r.side, r.loader, r.stop - r.start, r.error) for r in containers.container_files(spark.createDataFrame(rows, "id int, content binary")).collect())
    want = [(k, i, n, c, i == e, "utf8", "esm", "server", 1, len(c), None) for k, e in ((0, 1), (1, 1), (4, 0)) for i, (n, c) in enumerate([("/root/entry.js", b"console.log(1)"), ("asset-�", b"")])]
    assert got == want
    whole = container(52, some)
    assert all(whole[r[9] : r[10]] == r[2] for r in containers.decode(whole))


def test_broken_containers_are_one_row(spark):
    one = [(b"a", b"b")]

    def moved(data, table):
        struct.pack_into("<I", data, table + 8, 10**6)

    def unended(data, table):
        data[1] = 1

    cases = {
        "beyond": container(52, one, change=moved), "end mark": container(52, one, change=unended), "entry 3 of 1": container(52, one, entry=3), "unknown kind": container(36, one, kinds=bytes([9, 1, 1, 0])),
        "a file table of 0": container(52, []), "no offsets": containers.TRAILER, "larger than": b"\xff" * 32 + containers.TRAILER,
    }
    # 9 records of 52 bytes are 13 of 36; with zeroes only, both readings are right.
    data = bytes(9 * 52)
    cases["both layouts"] = data + struct.pack("<QIIIIII", len(data), 0, len(data), 0, 0, 0, 0) + containers.TRAILER
    for part, content in cases.items():
        (row,) = containers.decode(content)
        assert part in row[-1] and row[:-1] == (None,) * 11, part
    broken = spark.createDataFrame([(1, cases["beyond"])], "id int, content binary")
    assert [(r.id, r.name) for r in containers.container_files(broken).collect()] == [(1, None)]
    assert [r[1] for r in containers.decode(container(52, one) + containers.TRAILER)] == ["a"]  # an earlier trailer has the payload


def test_packed_rows_decode(spark):
    rows = spark.createDataFrame([(1, "text é", 52), (2, "", 36), (3, None, 36)], "id int, text string, size int")
    packed = containers.pack(rows, [(F.concat(F.lit("n"), F.col("id").cast("string")), F.col("text")), (F.lit("x"), F.lit("y"))], F.col("size"))
    got = sorted((r.id, r.file_index, r.name, bytes(r.contents).decode(), r.error) for r in containers.container_files(packed).collect())
    assert got == [(i, k, n, c, None) for i, t in ((1, "text é"), (2, ""), (3, "")) for k, (n, c) in enumerate([(f"n{i}", t), ("x", "y")])]
