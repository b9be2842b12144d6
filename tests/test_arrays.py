"""Elements of large arrays, whatever the cuts are."""

import json
import random

import pytest

from creditlake.sources import arrays as A
from creditlake.sources import readers as R


def value(rng, deep=0):
    kind = rng.randrange(6 if deep < 3 else 4)
    if kind == 4:
        return [value(rng, deep + 1) for _ in range(rng.randrange(4))]
    if kind == 5:
        return {rng.choice(["data", "a", 'q"[', "é\\"]): value(rng, deep + 1) for _ in range(rng.randrange(4))}
    return [rng.randrange(99), None, "".join(rng.choice('ab"\\[]{},: é\n') for _ in range(rng.randrange(12))), "\\" * rng.randrange(5)][kind]


def read(spark, path, keys=None, size=7):
    got = A.read_elements(spark, path, keys, size).collect()
    return [json.loads(r.value) for r in sorted(got, key=lambda r: (r.path, r.at))]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_elements_are_those_of_the_whole_file_at_any_cut(spark, tmp_path, size):
    rng, want = random.Random(size), []
    for n in range(6):
        elements = [value(rng) for _ in range(rng.randrange(14))]
        (tmp_path / f"f{n}.json").write_text(" \n" * rng.randrange(2) + json.dumps(elements, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5))
        want += elements
    assert read(spark, str(tmp_path), None, size) == want


@pytest.mark.parametrize("size", [7, 40, 1 << 20])
def test_the_first_key_that_has_a_list_at_the_top_counts(spark, tmp_path, size):
    def one(name, text):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text(text)
        return read(spark, str(tmp_path / name), ["Table", "data"], size)

    assert one("a", json.dumps({"n": {"Table": [7], "s": '"Table": ['}, "data": [{"Table": [1, {"data": [2]}]}, "]"], "Table": [{"data": [3]}, 4], "z": [5, [6]]})) == [{"data": [3]}, 4]
    assert one("b", json.dumps({"data": [1, 2, [3, 4]], "more": [8, 9, "x" * 50], "n": 1})) == [1, 2, [3, 4]]
    assert one("c", json.dumps({"other": [1]})) == [] == one("d", "") == one("e", '{"Table": []}') == one("f", "  ")
    assert one("g", '{"Table" \n:   [ {"a": "\\\\"} , {"b": "\\\\\\"]"}]}') == [{"a": "\\"}, {"b": '\\"]'}]


def test_readers_read_large_files_by_ranges(spark, tmp_path):
    rows = [{"CompanyName": f'A "{i}" {{', "FileURL": f"u{i}", "FileTitle": None, "PublishedDate": "2024"} for i in range(300)]
    (tmp_path / "p.json").write_text(json.dumps({"data": rows}))
    whole = R.read_press_releases(spark, str(tmp_path)).drop("pos").collect()
    parts = R.read_press_releases(spark, str(tmp_path), size=500)
    assert [tuple(r) for r in parts.orderBy("pos").drop("pos").collect()] == [tuple(r) for r in whole] and len(whole) == 300
    results = R.read_results(spark, str(tmp_path), size=500)
    assert results.count() == 300


def test_listing_and_scrip_lists_by_ranges(spark, tmp_path):
    docs = [{"companyName": f"C{i}", "companyCode": "x", "ratingFileName": "" if i % 3 == 0 else f'f"{i}].html', "ratingDate": None, "prId": str(i)} for i in range(90)]
    (tmp_path / "l.json").write_text(json.dumps({"total": 90, "docs": docs, "facets": {"docs": [1]}}))
    whole = R.read_listing_docs(spark, str(tmp_path / "l.json"))
    assert sorted(map(tuple, R.read_listing_docs(spark, str(tmp_path / "l.json"), size=256).collect())) == sorted(map(tuple, whole.collect())) and whole.count() == 60
    (tmp_path / "s.json").write_text(json.dumps({"data": [{"ScripCd": i, "ScripName": f"N{i}"} for i in range(50)]}))
    ranges = R.read_scrips(spark, str(tmp_path / "s.json"), size=100)
    assert [tuple(r)[1:] for r in ranges.orderBy("pos").collect()] == [tuple(r)[1:] for r in R.read_scrips(spark, str(tmp_path / "s.json")).orderBy("pos").collect()]
