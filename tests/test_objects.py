"""Large JSON objects read in several tasks."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from photospark.sources import objects as O
from photospark.sources.files import read_labels

TRICKY = ['p}1', 'a "quoted", {id}', "back\\slash\\\\", "ä€😀]", "plain", "tail}}", "", 'end\\"}']


def labels(n):
    return {f"{TRICKY[i % len(TRICKY)]}#{i}": {e: {"Exposure": i / 7, "Tint": -i * 1.0} for e in ("A", "B}", 'C"')[: i % 4]} for i in range(n)}


def long_rows(data):
    return sorted((p, e, k, v) for p, es in data.items() for e, ps in es.items() for k, v in ps.items())


@pytest.mark.parametrize("indent", [None, 2])
def test_one_file_in_many_tasks(spark, tmp_path, indent):
    data = labels(300)
    (tmp_path / "labels.json").write_text(json.dumps(data, indent=indent, ensure_ascii=False) + "\n", encoding="utf-8")
    with (tmp_path / "records.json").open("w") as f:
        f.writelines(json.dumps({"photo_id": p, "experts": es}) + "\n" for p, es in data.items())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        path = str(tmp_path / "labels.json")
        assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 5
        got = sorted(tuple(r) for r in O.read_label_object(spark, path).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got == long_rows(data)
    assert got == sorted(tuple(r) for r in read_labels(spark, str(tmp_path / "records.json")).collect())


def test_odd_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "empty.json").write_text("{}")
    (folder / "blank.json").write_text(" \n{ }\n")
    (folder / "one.json").write_text('{"x": {"A": {"Exposure": 1}}}')
    assert [tuple(r) for r in O.read_label_object(spark, str(folder)).collect()] == [("x", "A", "Exposure", 1.0)]
    (tmp_path / "bad.json").write_text('{"x": {"A": {"Exposure": 1}}, "y": 3}')
    with pytest.raises(Exception, match="can't be read"):
        O.read_label_object(spark, str(tmp_path / "bad.json")).collect()


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.text(alphabet='a"\\{}[],: ', max_size=5), st.recursive(st.floats(-5, 5) | st.text(alphabet='b"\\{}[],', max_size=4), lambda x: st.lists(x, max_size=2) | st.dictionaries(st.text(alphabet='c}"', max_size=2), x, max_size=2), max_leaves=4), max_size=5),
       st.lists(st.integers(1, 6), min_size=1, max_size=8))
def test_any_cut_of_any_object(data, sizes):
    text = json.dumps(data)
    chunks = [c + "}" for c in text.split("}")[:-1]]
    splits, i = [], 0
    while i < len(chunks):
        n = sizes[len(splits) % len(sizes)]
        splits.append(chunks[i:i + n])
        i += n
    quoted, depth, entries = False, 0, []
    for split in splits:
        for kind, piece in O._pieces(split, quoted, depth):
            if kind == "rest":
                entries[-1] += piece
            else:
                entries.append(piece)
        ended, deeper = O._ends(split, quoted)
        quoted, depth = ended, depth + deeper
    assert {k: v for e in entries if e.strip() for k, v in json.loads("{" + e + "}").items()} == data
