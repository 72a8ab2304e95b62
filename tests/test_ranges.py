"""Multi-line CSV and JSON arrays read by ranges, against Spark's one-task readers and Python's own."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import files, ranges as R


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def quoted(value, rnd):
    if value is None:
        return ""
    needs = any(c in value for c in ',"\n\r') or value == "" or rnd.random() < 0.3
    return '"' + value.replace('"', '""') + '"' if needs else value


def write_docs(path, n, newline, seed=3, bom=False):
    rnd = random.Random(seed)
    bits = ["plain words", 'a "quote"', '""', "line\nbreak", "comma, and", "é日🙂", "\n\n", '"', "tail\n", ",\n\"x\",", "crlf\r\nin"]
    rows = []
    for i in range(n):
        text = " ".join(rnd.choices(bits, k=rnd.choice([1, 2, 5, 60 if i % 40 == 0 else 3])))
        rows.append((text if newline == "\n" or "\r" not in text else text.replace("\r\n", "\n"), rnd.choice("xyz")))
    body = newline.join(["abstract,label", *[f"{quoted(t, rnd)},{lab}" for t, lab in rows], ""])
    path.write_bytes(("﻿" if bom else "").encode() + body.encode())
    return rows


@pytest.mark.parametrize("newline, bom", [("\n", False), ("\r\n", False), ("\n", True)])
def test_csv_ranges_equal_the_one_task_reader(spark, tmp_path, small_splits, newline, bom):
    rows = write_docs(tmp_path / "a.csv", 400, newline, bom=bom)
    more = write_docs(tmp_path / "b.csv", 5, newline, seed=9)
    one = files.csv_reader(spark, files.DOC_SCHEMA, multi_line=True).csv(str(tmp_path))
    found = R.pieces(spark, str(tmp_path / "a.csv"), "\n")
    assert found.select("start").distinct().count() > 12 < found.rdd.getNumPartitions()
    got = files.scan_documents(spark, str(tmp_path), record_col="n")
    assert sorted((r["text"], r["label"]) for r in got.collect()) == sorted(map(tuple, one.collect())) == sorted(rows + more)
    numbers = sorted((r["n"], r["text"]) for r in got.collect())
    assert [t for _, t in numbers] == [t for t, _ in rows + more]  # the order of the files
    assert len({n for n, _ in numbers}) == 405


def test_record_numbers_do_not_depend_on_splits(spark, tmp_path, small_splits):
    write_docs(tmp_path / "a.csv", 60, "\n")
    few = sorted(map(tuple, files.scan_documents(spark, str(tmp_path), record_col="n").collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    assert sorted(map(tuple, files.scan_documents(spark, str(tmp_path), record_col="n").collect())) == few


@pytest.mark.parametrize("body, want", [
    ("abstract,label\n", []), ("abstract,label\na,b", [("a", "b")]), ("abstract,label\n\n\na,b\n\n", [("a", "b")]),
    ('abstract,label\n"open ""and"" closed",b\n5" disk,c\n', [('open "and" closed', "b"), ('5" disk', "c")])])
def test_small_files(spark, tmp_path, body, want):
    (tmp_path / "a.csv").write_text(body)
    assert [(r["text"], r["label"]) for r in files.scan_documents(spark, str(tmp_path)).collect()] == want


def test_malformed_files_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,label\n1,a\nx,b\n")
    with pytest.raises(Exception):
        files.scan_documents(spark, str(tmp_path), "n INT, label STRING").collect()


def objects(n, seed=4):
    rnd = random.Random(seed)
    words = ["plain", 'quo"te', "back\\slash", "}{][", "\\\"", "é🙂", "line\nbreak", "\\"]
    return [{"row_id": i, "name": " ".join(rnd.choices(words, k=rnd.choice([0, 2, 9, 200 if i % 50 == 0 else 1]))),
             "inner": {"a": [rnd.random() for _ in range(rnd.randrange(4))], "b": {"c": rnd.choice(words)}}} for i in range(n)]


SCHEMA = "row_id LONG, name STRING, inner STRUCT<a: ARRAY<DOUBLE>, b: STRUCT<c: STRING>>"


@pytest.mark.parametrize("indent", [2, None])
def test_json_ranges_equal_the_one_task_reader(spark, tmp_path, small_splits, indent):
    (tmp_path / "run=a").mkdir()
    data = objects(300)
    (tmp_path / "run=a" / "p.json").write_text(json.dumps(data, indent=indent, ensure_ascii=False))
    (tmp_path / "run=a" / "q.json").write_text(json.dumps(data[:1][0], indent=indent))
    (tmp_path / "run=a" / "empty.json").write_text("[]")
    path = f"{tmp_path}/*/*.json"
    found = R.pieces(spark, f"{tmp_path}/*/p.json", "}")
    assert found.select("start").distinct().count() > 20
    got = files.scan_json_arrays(spark, path, SCHEMA)
    one = spark.read.schema(SCHEMA).option("multiLine", True).json(f"{tmp_path}/*/[pq].json")
    assert got.columns == ["run", "row_id", "name", "inner"] and got.select("run").distinct().collect()[0][0] == "a"
    assert sorted(map(repr, got.drop("run").collect())) == sorted(map(repr, one.select("row_id", "name", "inner").collect()))
    assert got.count() == 301


@pytest.mark.parametrize("line, inside, want", [
    ('a,"b', False, True), ('b",c', True, False), ('a,"b""', False, True), ('a,"b"""', False, False), ("plain", True, True),
    ('x "y",z', False, False), ('"', False, True), ('""', False, False), ('","', True, True)])
def test_quote_states(line, inside, want):
    assert R.CsvRecords().step(line, inside)[0] is want
