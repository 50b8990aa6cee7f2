"""JSON sources: files in a folder, and every way in which one can be wrong."""

import json

from evidentia.sources import json_files as j


def write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.json").write_text(text if isinstance(text, str) else json.dumps(text), encoding="utf-8")


def named(rows):
    return {(r.path.rsplit("/", 1)[-1].removesuffix(".json"), *[x for x in r[1:]]) for r in rows}


def test_registries(spark, tmp_path):
    good = {"version": 3, "entities": [{"id": " e1 ", "name": "One", "aliases": ["Uno", {"text": " two ", "mode": "casefold"}, {"text": ""}, 5, None], "distinct_from": ["e2", "", 7]}, {"id": "", "name": "x"}, "no", {"id": "e2", "name": "Two"}]}
    write(tmp_path, good=good, empty={}, bad="{", wrong={"entities": {}}, array=[], big="[" + "1," * 3000 + "1]", odd={"entities": [], "version": "x"})
    files = j.json_files(spark, str(tmp_path), most_bytes=5000)
    found, issues = j.registry_entities(files)
    got = {r.id: (r.version, r.name, [tuple(a) for a in r.aliases], r.distinct_from) for r in found.collect()}
    assert got == {"e1": (3, "One", [("Uno", "exact_case"), ("two", "casefold"), ("One", "casefold")], ["e2"]), "e2": (3, "Two", [("Two", "casefold")], [])}
    assert named(issues.collect()) == {("bad", "invalid_json"), ("wrong", "not_a_registry"), ("array", "not_a_registry"), ("big", "too_large")}


def test_profiles(spark, tmp_path):
    write(tmp_path, a={"language": "German", "custom_instructions": ["x", 1], "glossary": {"k": "v"}, "answer_style": 5}, b=[1], c="no")
    got = {r.path.rsplit("/", 1)[-1]: r for r in j.profiles(j.json_files(spark, str(tmp_path))).collect()}
    assert (got["a.json"].language, got["a.json"].answer_style, got["a.json"].custom_instructions, got["a.json"].glossary, got["a.json"].issue) == ("German", j.PROFILE["answer_style"], ["x"], {"k": "v"}, None)
    assert (got["b.json"].issue, got["c.json"].issue, got["c.json"].language) == ("not_an_object", "invalid_json", j.PROFILE["language"])


def test_records_of_lists_and_objects(spark, tmp_path):
    write(tmp_path, many=[{"title": "a", "seconds": 3}, 7, {"title": "b", "more": 1}], one={"title": "c", "seconds": 9}, none="x")
    rows, issues = j.records(j.json_files(spark, str(tmp_path)), "title string, seconds long")
    assert named(rows.collect()) == {("many", 0, "a", 3), ("many", 2, "b", None), ("one", 0, "c", 9)}
    assert named(issues.collect()) == {("many", 1, "not_an_object"), ("none", None, "invalid_json")}


def test_manifests(spark):
    manifest = {"schema": "v1", "revision": "r", "files": [{"path": "config.json", "bytes": 2, "sha256": "a"}, {"path": "gone", "bytes": 1, "sha256": "b"}, {"path": "twice", "bytes": 1, "sha256": "c"}, {"path": "twice", "bytes": 1, "sha256": "c"}]}
    files = spark.createDataFrame([("m", json.dumps(manifest)), ("n", "nothing"), ("o", "{}")], "path string, text string")
    found = spark.createDataFrame([("m", "config.json", 3, "a"), ("m", "twice", 1, "c"), ("m", "extra.bin", 1, "d"), ("m", "NOTES.MD", 1, "e"), ("m", "provenance_x.json", 1, "f"), ("m", "manifest.json", 9, "g")], "path string, name string, bytes long, sha256 string")
    got = {(r.path, r.issue) for r in j.manifest_issues(files, found, {"schema": "v1", "revision": "q"}, ("config.json", "model")).collect()}
    assert got == {
        ("m", "unrecognized:revision"), ("m", "changed:config.json"), ("m", "missing:gone"), ("m", "listed_twice:twice"), ("m", "unlisted:extra.bin"), ("m", "omits:model"), ("n", "invalid_json"),
        ("o", "unrecognized:schema"), ("o", "unrecognized:revision"), ("o", "omits:config.json"), ("o", "omits:model"),
    }
