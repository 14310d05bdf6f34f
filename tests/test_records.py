"""Records of JSON files of all forms, cut into many byte ranges, against a plain reader of whole texts."""

import json
import random
from collections.abc import Iterator, Sequence

import pytest

from utterlake.sources import files, records

WRAPPERS = ("data", "items", "records", "examples")


def records_of(text: str, keys: Sequence[str]) -> Iterator[dict]:
    """Record-like objects (with one of the keys) of an array, a wrapper, a map of records, or objects one after another."""
    decoder, at, end = json.JSONDecoder(), 0, len(text)

    def walk(value) -> Iterator[dict]:
        if isinstance(value, list):
            for x in value:
                yield from walk(x)
        elif isinstance(value, dict):
            if any(k in value for k in keys):
                yield value
            elif wrapped := [value[w] for w in WRAPPERS if isinstance(value.get(w), list)]:
                yield from walk(wrapped[0])
            else:
                for x in value.values():
                    if isinstance(x, dict):
                        yield from walk(x)

    while at < end:
        if text[at] not in "{[":
            at += 1
            continue
        try:
            value, at = decoder.raw_decode(text, at)
        except ValueError:
            at += 1
            continue
        yield from walk(value)


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def record(r, k):
    text = r.choice(["plain", 'a "quoted" }{ text', "back\\slash \\", "é漢 ][", "", "tab\t, end}", "x" * r.randint(0, 90)])
    extra = r.choice([{}, {"meta": {"a": [1, {"b": "}"}], "c": {}}}, {"list": [[], [{}], "]["]}])
    return {"id": k, "text": text, **extra} if r.random() < 0.8 else {**extra, "text": text, "id": k}


def forms(r, found, indent):
    dump = lambda x: json.dumps(x, ensure_ascii=r.random() < 0.5, indent=indent)
    yield "array", dump(found)
    yield "mixed array", json.dumps([1, "x{", *found, None, [2]])
    yield "wrapper", dump({"version": 1, "name": "a{b", "items": found, "more": {"x": []}})
    yield "map", dump({f"r{{{k}": x for k, x in enumerate(found)})
    yield "stream", "junk it's " + " ".join(json.dumps(x) for x in found)
    yield "lines", "\n".join(json.dumps(x) for x in found) + "\n"
    yield "broken lines", "\n".join(line for x in found for line in (json.dumps(x), r.choice(['{"id": 7, "te', "", '"no', "{broken}", '{"other": {"k": 1']))[: r.randint(1, 2)])
    yield "single", dump({"meta": {"k": {"id": "no"}}, "other": {"z": 1}, "id": 5, "text": "one"})
    yield "lines of wrappers", "\n".join(json.dumps({"data": found[k : k + 3]}) for k in range(0, len(found), 3))
    yield "empty array", "[]"
    yield "nothing", " \n "


@pytest.mark.parametrize("indent", [None, 1])
def test_all_forms_in_many_ranges(spark, tmp_path, small_ranges, indent):
    r = random.Random(indent or 0)
    found = [record(r, k) for k in range(50)]
    for k, (name, text) in enumerate(forms(r, found, indent)):
        if indent and k not in (0, 2, 3, 7):  # the other forms have no layout
            continue
        path = tmp_path / f"{name}.json"
        path.write_text(text, encoding="utf-8")
        want = [(x.get("id"), x.get("text")) for x in records_of(text, ["id", "text"])]
        df = files.read_records(spark, str(path), "id string, text string", ["id"])
        got = [tuple(x) for x in df.collect()]
        assert sorted(got, key=str) == sorted(((None if a is None else str(a), b) for a, b in want), key=str), name
        if name == "array":
            assert records.pieces_of(spark, str(path)).rdd.getNumPartitions() > 3 and len(got) == 50


def test_several_files_at_once(spark, tmp_path, small_ranges):
    r = random.Random(3)
    want = []
    for k in range(4):
        found = [record(r, 100 * k + i) for i in range(20)]
        want += [x["id"] for x in found]
        (tmp_path / f"{k}.json").write_text([json.dumps(found), json.dumps({"data": found}), "\n".join(map(json.dumps, found)), json.dumps({str(i): x for i, x in enumerate(found)})][k])
    assert sorted(x[0] for x in files.read_records(spark, str(tmp_path), "id long").collect()) == sorted(want)
