"""Overlays, provenance, the mutable store, score runs and streams, by brute force and by hand."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import hierarchy, overlays, provenance, scorestore, synthesis
from lodestrata.streaming import usage


def deep(base, over):
    out = dict(base)
    for k, v in over.items():
        out[k] = deep(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


def test_overlays_equal_a_deep_merge(spark):
    rng = random.Random(2)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice([1, 2.5, "x", None, True, [1, {"a": 2}], "1/2"])
        return {rng.choice("abcd"): tree(depth - 1) for _ in range(rng.randrange(1, 4))}

    def clean(node):  # empty objects that something replaces are covered below
        return {k: clean(v) for k, v in node.items()} if isinstance(node, dict) else node

    files, want = [], {}
    for s in range(150):
        layers = [{rng.choice("abc"): tree(3) for _ in range(3)} for _ in range(rng.randrange(1, 5))]
        merged = {}
        for k, layer in enumerate(layers):
            merged = deep(merged, clean(layer))
            files.append((s, k, json.dumps(layer)))
        want |= {(s, path): value for path, value in overlays._leaves(merged, "")}
    files += [(900, 0, "no json"), (901, 0, None), (902, 0, "[1]"), (903, 0, "{}")]
    got = {(r.scenario, r.path): r.value for r in overlays.merged(overlays.flattened(spark.createDataFrame(files, "scenario int, layer int, body string"))).collect()}
    assert {k: v for k, v in got.items() if k[0] < 900} == want
    assert not {k for k in got if k[0] >= 900}


@pytest.mark.parametrize("layers, want", [
    (['{"a": {}}', '{"a": {"b": 1}}'], {"a/b": "1"}), (['{"a": {"b": 1}}', '{"a": {}}'], {"a/b": "1"}), (['{"a": 1}', '{"a": {}}'], {"a": "{}"}), (['{"a": {"b": 1}}', '{"a": 2}', '{"a": {"c": 3}}'], {"a/c": "3"}), (['{"a": null}'], {"a": "null"}), (['{"a": 1}', '{"a": null}'], {"a": "null"}),
])
def test_overlays_of_empty_objects_and_nulls(spark, layers, want):
    rows = overlays.merged(overlays.flattened(spark.createDataFrame([("s", k, b) for k, b in enumerate(layers)], "scenario string, layer int, body string")))
    assert {r.path: r.value for r in rows.collect()} == want


def test_citations(spark):
    body = '{"a": {"value": 5, "source": "s1", "locator": {"page": 3}, "confidence": 0.5}, "b": {"value": null, "source": "s9"}, "c": {"value": 1}, "d": {"e": {"value": "x", "source": "s1", "note": "n"}}}'
    rows = overlays.citations(overlays.merged(overlays.flattened(spark.createDataFrame([("s", 0, body)], "scenario string, layer int, body string"))))
    got = {r.path: (r.value, r.source, r.confidence, r.note, r.locator) for r in rows.collect()}
    assert got == {"a": ("5", "s1", 0.5, None, {"page": "3"}), "b": (None, "s9", 1.0, None, {}), "d/e": ("x", "s1", 1.0, "n", {})}
    registry = spark.createDataFrame([("s1", "PRIMARY")], "source_id string, tier string")
    assert [r.path for r in overlays.unregistered(rows, registry).collect()] == ["b"] and overlays.cited_values(rows, registry).count() == 2


def test_provenance_order(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), "k int, rent double, growth double, n long")
    parts = [
        provenance.assumptions(df((1, 10.0, None, 5), (1, 11.0, None, 9), (2, float("nan"), 0.5, 1)), ["k"], ["rent", "growth"], "PROPERTY_DERIVED", "d", F.col("n")), provenance.assumptions(df((1, 99.0, 0.3, 1), (2, 7.0, 0.1, 1)), ["k"], ["rent", "growth"], "MARKET_BENCHMARK"),
        provenance.assumptions(df((1, 50.0, None, 1)), ["k"], ["rent"], "PROPERTY_DERIVED", "low", F.col("n"), "low"),
    ]
    best = provenance.merged(parts, ["k"])
    got = {(r.k, r.field): (r.value, r.source, r.confidence, r.sample_size, r.candidates, r.passed_over) for r in best.collect()}
    assert got[1, "rent"] == (11.0, "PROPERTY_DERIVED", "high", 9, 4, ["MARKET_BENCHMARK"]) and got[2, "rent"][:2] == (7.0, "MARKET_BENCHMARK") and got[2, "growth"][:2] == (0.5, "PROPERTY_DERIVED") and got[1, "growth"][5] == []
    assert {(r.k, r.rent, r.own, r.known) for r in provenance.wide(best, ["k"], ["rent"]).collect()} == {(1, 11.0, 1, 2), (2, 7.0, 1, 2)}
    with pytest.raises(ValueError):
        provenance.assumptions(df((1, 1.0, 1.0, 1)), ["k"], ["rent"], "GUESS")


def test_deletes_reach_all_children(spark, tmp_path):
    rng = random.Random(3)
    tables = {"a": [(i, None) for i in range(8)], "b": [(i, rng.randrange(9)) for i in range(30)], "c": [(i, rng.randrange(32)) for i in range(90)], "d": [(i, rng.choice([None, *range(8)])) for i in range(20)]}
    relations = [hierarchy.Relation("c", "id", "up", "b"), hierarchy.Relation("b", "id", "up", "a"), hierarchy.Relation("d", "id", "up", "a")]
    frames = {k: spark.createDataFrame(v, "id int, up int") for k, v in tables.items()}
    asked = spark.createDataFrame([("a", "3"), ("a", "77"), ("b", "5"), ("d", "1")], "table string, id string")
    dead = {"a": {3}, "b": {5}, "c": set(), "d": {1}}
    for child, parent in (("b", "a"), ("d", "a"), ("c", "b")):
        dead[child] |= {i for i, up in tables[child] if up in dead[parent]}
    want = {(k, str(i)) for k, ids in dead.items() for i in ids} | {("a", "77")}
    found = hierarchy.cascade(asked, frames, relations)
    assert {tuple(r) for r in found.collect()} == want
    assert {tuple(r) for r in hierarchy.cascade(asked, frames, relations, keep=False).collect()} == want - {("a", "3"), ("a", "77"), ("b", "5"), ("d", "1")}
    path = str(tmp_path / "dead")
    for _ in range(2):
        hierarchy.bury(found, path)
    stones = hierarchy.buried(spark, path)
    assert stones.count() == len(want)
    assert {r.id for r in hierarchy.alive(frames["c"], "c", "id", stones).collect()} == {i for i, _ in tables["c"]} - dead["c"]
    kept, rest = hierarchy.compacted(frames["b"], "b", "id", stones, str(tmp_path / "b"))
    assert {r.id for r in kept.collect()} == {i for i, _ in tables["b"]} - dead["b"] and rest.filter("table = 'b'").count() == 0
    with pytest.raises(ValueError):
        hierarchy.parents_first([hierarchy.Relation("x", "id", "up", "y"), hierarchy.Relation("y", "id", "up", "x")])
    made = hierarchy.created(frames["a"], "id", spark.createDataFrame([(3, 1), (99, 2)], "id int, up int"))
    assert made.count() == 9 and made.filter("id = 99").first().up == 2


def test_period_modes():
    assert scorestore.period_weights("standalone", 3) == {"Yr1": 10.0, "Yr2": 10.0, "Yr3": 10.0} and scorestore.period_weights("auto", 5)["5Yr"] == 0.25 and scorestore.period_weights("fixed", fixed={"Q1": 1.0}) == {"Q1": 1.0}
    with pytest.raises(ValueError):
        scorestore.period_weights("other")


def test_score_configuration(spark):
    got = {(r.kind, r.name): r.weight for r in scorestore.configuration(spark).collect()}
    assert got["area", "rent"] == 0.40 and got["tier", "All"] == 0.40 and got["10 years", "10Yr"] == 0.5


def test_notes_without_periods(spark):
    cols = "property_id int, document_id string, document_type string, period string, category string, line_item string, amount double, is_subtotal boolean, is_total boolean, page_number int"
    items = spark.createDataFrame([(1, "a", "loan", "2099A", "income", "Rent", 1.0, False, False, 1)], cols)
    assert [r.notes for r in synthesis.notes(synthesis.synthesize(items, 2024), items).collect()] == [["No financial periods found."]]


def test_folder_stream_remembers_contents(spark, tmp_path):
    """Contents are skipped across runs by state alone: the second run writes to another store."""
    folder = tmp_path / "in"
    folder.mkdir()

    def run(store, **files):
        for name, text in files.items():
            (folder / f"{name}.txt").write_text(text)
        usage.watch(spark, str(folder), str(tmp_path / store), str(tmp_path / "cp")).awaitTermination(120)
        return sorted(r.text for r in spark.read.schema("text string").parquet(str(tmp_path / store / "part-*")).collect())

    assert run("one", a="one", b="one", c="two") == ["one", "two"]
    assert run("other", d="two", e="three") == ["three"]


def test_limit_state_expires(spark, tmp_path):
    schema = "org_id long, event_id long, created_at timestamp"
    at = lambda minute, second: datetime(2024, 1, 1, 0, minute, second)
    batches = [[(1, 1, at(0, 0)), (1, 2, at(0, 1)), (1, 3, at(0, 2)), (2, 4, at(0, 2))], [(1, 5, at(0, 30)), (2, 6, at(0, 50))], [(1, 7, at(1, 1)), (3, 8, at(40, 0))], [(1, 9, at(41, 0)), (1, 10, at(41, 0)), (1, 11, at(41, 1))]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "e" / f"b{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "e"))
    query = usage.limited(stream, 60, 2, "1 minute").writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert {r.event_id: r.allowed for r in spark.table("limits").collect()} == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True, 7: True, 8: True, 9: True, 10: True, 11: False}
