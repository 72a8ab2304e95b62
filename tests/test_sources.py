"""File sources (A2-A5) on hand-written files in a fresh folder."""

import json
import os
import tempfile

import pytest

from tessera.sources import files


def test_scan_nested_runs_crlf_and_odd_dirs(spark):
    root = tempfile.mkdtemp(prefix="tessera-runs-")
    for vec, hidden, losses in (("count", "(100, 50)", [0.5, 0.25]), ("tfidf", "(50,)", [0.9])):
        d = os.path.join(root, vec, hidden)
        os.makedirs(d)
        with open(os.path.join(d, "loss.csv"), "w", newline="") as f:
            f.write("epoch,loss\r\n" + "".join(f"{i + 1},{v}\r\n" for i, v in enumerate(losses)))
    df = files.scan_nested_runs(spark, root, "loss.csv", "epoch INT, loss DOUBLE", ("vectorizer", "hidden"))
    got = sorted((r["vectorizer"], r["hidden"], r["epoch"], r["loss"]) for r in df.collect())
    assert got == [("count", "(100, 50)", 1, 0.5), ("count", "(100, 50)", 2, 0.25), ("tfidf", "(50,)", 1, 0.9)]


def test_scan_json_arrays_pretty_printed(spark):
    root = tempfile.mkdtemp(prefix="tessera-json-")
    os.makedirs(os.path.join(root, "runA"))
    recs = [{"true_label": "a", "predicted_label": "b", "confidence": 0.9},
            {"true_label": "b", "predicted_label": "b", "confidence": 0.6}]
    with open(os.path.join(root, "runA", "misclassified.json"), "w") as f:
        json.dump(recs, f, indent=2)
    df = files.scan_json_arrays(spark, f"{root}/*/misclassified.json",
                                "true_label STRING, predicted_label STRING, confidence DOUBLE")
    assert sorted((r["run"], r["confidence"]) for r in df.collect()) == [("runA", 0.6), ("runA", 0.9)]


def test_attention_trace_numeric_order(spark):
    root = tempfile.mkdtemp(prefix="tessera-trace-")
    for e in (0, 1, 2, 10, 9):
        with open(os.path.join(root, f"epoch_{e}.json"), "w") as f:
            json.dump({"epoch": e, "tokens": ["a"], "attention_weights": [1.0]}, f, indent=2)
    got = [r["file_epoch"] for r in files.scan_attention_trace(spark, root).collect()]
    assert got == [0, 1, 2, 9, 10]


def test_scan_vectors_of_real_files(spark):
    root = tempfile.mkdtemp(prefix="tessera-vec-")
    with open(os.path.join(root, "vec.txt"), "w") as f:
        f.write("3 3\nhello 0.1 0.2 0.3 \nworld 1 2 3\nHello -1 2e-3 3 \n")  # header, lines that end in a space
    got = {r["token"]: r["vector"] for r in files.scan_vectors(spark, root, dim=3).collect()}
    assert set(got) == {"hello", "world", "Hello"} and got["world"] == [1.0, 2.0, 3.0]
    assert files.rejected_vectors(spark, root, dim=3).count() == 0


def test_scan_vectors_refuses_other_lines(spark):
    root = tempfile.mkdtemp(prefix="tessera-vec-")
    with open(os.path.join(root, "vec.txt"), "w") as f:
        f.write("a 1 2\nb 1\nc 1 x\n")
    assert sorted(r["value"] for r in files.rejected_vectors(spark, root, dim=2).collect()) == ["b 1", "c 1 x"]
    with pytest.raises(Exception, match="not a word vector"):
        files.scan_vectors(spark, root, dim=2).collect()


def test_optional_inputs(spark):
    req = spark.createDataFrame([("a",), ("b",)], "run string")
    found = spark.createDataFrame([("a",)], "run string")
    assert [r["run"] for r in files.optional_inputs(req, found).collect()] == ["b"]


def test_runs_without_the_file(spark):
    root = tempfile.mkdtemp(prefix="tessera-none-")
    os.makedirs(os.path.join(root, "runA"))
    empty = files.scan_runs(spark, root, "test_metrics.csv", "epoch INT, val_loss DOUBLE")
    assert empty.columns == ["run", "epoch", "val_loss"] and empty.count() == 0
    missing = files.optional_inputs(spark.createDataFrame([("runA",)], "run string"), empty)
    assert [(r["run"], r["status"]) for r in missing.collect()] == [("runA", "missing")]


def test_json_arrays_round_trip_pretty_printed(spark):
    root = os.path.join(tempfile.mkdtemp(prefix="tessera-json-"), "p")
    df = spark.createDataFrame([("a", i, f"x{i}") for i in range(7)] + [("b", 9, None)], "run string, row_id long, name string")
    files.write_json_arrays(df, root, "run", rows_per_file=3)
    back = files.scan_json_arrays(spark, f"{root}/*/*.txt", "row_id BIGINT, name STRING")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    part = next(os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".txt"))
    assert len(open(part).read().splitlines()) > 3  # not one line per object


def test_document_ids_do_not_depend_on_splits(spark):
    root = tempfile.mkdtemp(prefix="tessera-docs-")
    with open(os.path.join(root, "a.csv"), "w") as f:
        f.write('abstract,label\n"two\nlines",x\nplain,y\nplain,y\n')
    ids = [sorted((r["text"], r["doc_id"]) for r in files.scan_documents(spark, root).repartition(n).collect()) for n in (1, 4)]
    assert ids[0] == ids[1] and len({i for _, i in ids[0]}) == 2 and ids[0][-1][0] == "two\nlines"


def test_half_a_set_is_never_read(spark, tmp_path):
    """A writer that fails between two tables leaves the set before it in force."""
    root = str(tmp_path / "set")
    with pytest.raises(FileNotFoundError):
        files.published(spark, root)
    files.save_artifacts({"a": spark.range(3), "b": spark.range(2)}, root)

    def fail(folder):
        raise OSError("executor lost")

    with pytest.raises(OSError):
        files.publish(spark, root, {"a": spark.range(50).write.parquet, "b": fail})
    back = files.load_artifacts(spark, root, ("a", "b"))
    assert (back["a"].count(), back["b"].count()) == (3, 2)
    files.save_artifacts({"a": spark.range(5), "b": spark.range(4)}, root)
    again = files.load_artifacts(spark, root, ("a", "b"))
    assert (again["a"].count(), again["b"].count()) == (5, 4)
    assert (back["a"].count(), back["b"].count()) == (3, 2)  # a reader keeps the set it began with


def test_evaluation_documents_round_trip(spark, tmp_path):
    root = str(tmp_path / "evaluation")
    hidden = spark.createDataFrame([("r", 1, [0.5, -1.0], 'la "b"'), ("s", 2, [], "x")], "run string, row_id long, hidden_state array<double>, label string")
    wrong = spark.createDataFrame([("r", 1, "a", "b", 0.75)], "run string, row_id long, true_label string, predicted_label string, confidence double")
    shown = spark.createDataFrame([("r", 1, ["a", "{b}"], [0.25, 0.75])], "run string, row_id long, tokens array<string>, attention_weights array<double>")
    files.sink_evaluation({"hidden_states": hidden, "misclassified": wrong, "attention_examples": shown}, root)
    for name, df in (("hidden_states", hidden), ("misclassified", wrong), ("attention_examples", shown)):
        back = files.scan_evaluation(spark, root, name)
        assert sorted(map(repr, map(tuple, back.select(*df.columns).collect()))) == sorted(map(repr, map(tuple, df.collect())))


def test_mandatory_file_must_be_there(spark, tmp_path):
    for run in ("a", "b"):
        (tmp_path / run).mkdir()
    (tmp_path / "a" / "metrics.csv").write_text("epoch,val_loss\n1,0.5\n")
    with pytest.raises(FileNotFoundError, match="metrics.csv is missing in: b"):
        files.scan_mandatory(spark, str(tmp_path), "metrics.csv", "epoch INT, val_loss DOUBLE")
    (tmp_path / "b" / "metrics.csv").write_text("epoch,val_loss\n2,0.25\n")
    assert files.scan_mandatory(spark, str(tmp_path), "metrics.csv", "epoch INT, val_loss DOUBLE").count() == 2


def test_vectors_of_asked_tokens_are_parsed_only(spark, tmp_path):
    (tmp_path / "v.txt").write_text("a 1 2\nb 3 4\nbroken x y\n")
    asked = spark.createDataFrame([("b",), ("zz",)], "token string")
    assert [tuple(r) for r in files.scan_vectors(spark, str(tmp_path), dim=2, tokens=asked).collect()] == [("b", [3.0, 4.0])]


def _files(root, suffix):
    return [os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(suffix)]


def test_history_has_one_file_per_experiment_and_other_depths_are_left_out(spark):
    root = tempfile.mkdtemp(prefix="tessera-history-") + "/h"
    rows = spark.range(0, 400, 1, 8).selectExpr("concat('r-', id % 20) run", "if(id % 2 = 0, 'train', 'val') phase", "cast(id / 20 as int) epoch", "id / 7 loss")
    files.sink_history(rows.withColumnRenamed("run", "vectorizer").withColumnRenamed("phase", "hidden"), root)
    found = _files(root, ".csv")
    assert len(found) == 20  # was one for each task that held a row
    with open(os.path.join(root, "vectorizer=r-0", "part-0.csv"), "w") as f:
        f.write("epoch,loss\n1,1.0\n")
    back = files.scan_nested_runs(spark, root, "*.csv", "epoch INT, loss DOUBLE", ("vectorizer", "hidden"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_traces_are_written_and_scanned_by_many_tasks(spark):
    root = tempfile.mkdtemp(prefix="tessera-traces-") + "/t"
    rows = spark.range(0, 60, 1, 1).selectExpr("concat('a b-', id div 6) run", "cast(id % 6 + 7 as int) epoch", "array('x') tokens", "array(1.0D) attention_weights")
    files.write_traces(rows, root)
    found = _files(root, ".json")
    assert len(found) == 60
    assert len({os.path.basename(f).split("-")[1] for f in found}) > 1  # tasks that wrote: one row group is no one-task write
    os.makedirs(f"{root}/epoch_3")
    with open(f"{root}/epoch_3/x.json", "w") as f:
        json.dump({"epoch": 3, "tokens": ["a"], "attention_weights": [1.0]}, f)
    back = files.scan_attention_trace(spark, root, pattern="*/*/*.json", tag="run")
    assert sorted((r["run"], r["file_epoch"]) for r in back.collect()) == sorted((r["run"], r["epoch"]) for r in rows.collect())
