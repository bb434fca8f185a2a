"""Maps of tokens: split anywhere, braces and quotes in text, nested values, broken files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from skyledger.sources import tokens as tok


def _write(tmp_path, text, name="m.json"):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path)


def _read(spark, path, schema="n bigint, s string, l array<struct<v: bigint>>"):
    return sorted((r["token"], r["value"].asDict(True)) for r in tok.read_token_map(spark, path, schema).collect())


@pytest.mark.parametrize("indent", [None, 2])
def test_one_object_is_split_over_tasks(spark, tmp_path, indent):
    rng = random.Random(5)
    marks = ['}', '{', '"', '\\', ',', ':', '[', ']', '\n', 'é', 'x', '}, "k": {']
    text = lambda: "".join(rng.choice(marks) for _ in range(rng.randrange(12)))
    want = {f"{text()}#{i}": {"n": i, "s": text(), "l": [{"v": j} for j in range(i % 4)]} for i in range(3000)}
    path = _write(tmp_path, json.dumps(want, indent=indent) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "4096")
        assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 10
        got = _read(spark, path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted(want.items())


def test_empty_maps_files_and_several_maps(spark, tmp_path):
    _write(tmp_path, "", "a.json")
    _write(tmp_path, " { }\n", "b.json")
    _write(tmp_path, '{"p": {"n": 1}}\n{"q": {}, "r" : {"n": 2}}', "c.json")
    got = _read(spark, str(tmp_path), "n bigint")
    assert got == [("p", {"n": 1}), ("q", {"n": None}), ("r", {"n": 2})]


@pytest.mark.parametrize("text", ['{"a": 1, "b": {"n": 1}}', '{"a": {"n": 1}, "b": {"n": ', '{"a": {"n": 1}, "b', '[{"n": 1}]'])
def test_other_files_fail(spark, tmp_path, text):
    with pytest.raises(Exception, match="no map of objects"):
        _read(spark, _write(tmp_path, text), "n bigint")


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, 'a"]: }', 1), (0, "b", 2), (1, "c", 3)], "part int, token string, n long")
    tok.write_token_map(df, str(tmp_path / "o"), file="part", token="token", value=F.struct("n"))
    assert _read(spark, str(tmp_path / "o"), "n bigint") == [('a"]: }', {"n": 1}), ("b", {"n": 2}), ("c", {"n": 3})]


def test_text_of_pieces_is_not_shuffled(spark, tmp_path, monkeypatch):
    """Pieces are summed up and joined where they are read: what is written on the way holds each entry once, and only the text at the ends of splits meets in a group."""
    kept = {}
    write = tok.cut
    monkeypatch.setattr(tok, "cut", lambda df, label: kept.setdefault(label, write(df, label)))
    monkeypatch.setattr(tok, "drop", lambda *tables: None)
    path = _write(tmp_path, json.dumps({f"k{i}": {"n": i} for i in range(2000)}))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    try:
        for k in names:
            spark.conf.set(k, "4096")
        got = _read(spark, path, "n bigint")
    finally:
        for k, v in zip(names, before):
            spark.conf.set(k, v)
    assert len(got) == 2000
    splits = kept["splits"].count()
    assert 1 < splits and kept["entries"].where("led OR NOT ended").count() <= 2 * splits and kept["entries"].count() <= 2000 + 2 * splits
