"""Scenario files as rows: nested parameters, overlays by precedence, citations checked against a registry, and validated figures laid over actuals.

A scenario's layers (base, overlay, overlay of the overlay) are JSON objects. They are flattened to one row a leaf, ``scenario, layer, path, value``, and merged by paths: a higher layer's leaf takes the place of
what lower layers have at its path, below it, or, as a plain value, above it. That is the deep merge of nested objects in which the overlay wins, for any number of layers and scenarios at once.

Defined results: lists are values and are replaced whole; an explicit null is a value; an empty object is a leaf only where nothing is below it; a body that isn't a JSON object, or an empty one, has no rows; of equal
paths in one layer the greatest value counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread

#: Parts the steps of a path.
STEP = "/"
#: Places by sections of a validated file, and the field that each sets (fixed values).
VALIDATED_FIELDS = {"Property NOI": "property_noi", "AMF (in OpEx)": "amf_amount", "Routine CapEx": "routine_capex", "Improvement CapEx": "improvement_capex"}
VALIDATED_CONFIDENCE, THOUSAND = 0.95, 1000.0


def _leaves(node, path: str) -> Iterator[tuple[str, str]]:
    if isinstance(node, dict) and node:
        for name, below in node.items():
            yield from _leaves(below, f"{path}{STEP}{name}" if path else str(name))
    else:
        yield path, json.dumps(node, sort_keys=True)


def flattened(files: DataFrame) -> DataFrame:
    """(scenario, layer, body) -> (scenario, layer, path, value): the leaves of every body, values as JSON."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for scenario, layer, body in zip(batch["scenario"], batch["layer"], batch["body"], strict=True):
                try:
                    node = json.loads(body or "")
                except ValueError:
                    continue
                if isinstance(node, dict) and node:
                    out += [(scenario, layer, *leaf) for leaf in _leaves(node, "")]
            yield pd.DataFrame(out, columns=["scenario", "layer", "path", "value"])

    rows = spread(files.select("scenario", F.col("layer").cast("int").alias("layer"), F.col("body").cast("string").alias("body")), "scenario", "layer")
    kind = rows.schema["scenario"].dataType.simpleString()
    return rows.mapInPandas(run, f"scenario {kind}, layer int, path string, value string").groupBy("scenario", "layer", "path").agg(F.max("value").alias("value"))


def _at_prefixes(rows: DataFrame) -> DataFrame:
    """Every leaf at its own path and at each path above it."""
    steps = rows.select("scenario", "layer", "path", "value", F.explode(F.sequence(F.lit(1), F.size(F.split("path", STEP)))).alias("_n"))
    return steps.select("scenario", "layer", "path", "value", F.expr(f"substring_index(path, '{STEP}', _n)").alias("at"))


def merged(leaves: DataFrame) -> DataFrame:
    """(scenario, layer, path, value) of the leaves that are left, with the layer that each comes from. Leaves meet at the paths above them by windows, so that no table of paths is sent anywhere."""
    own, empty, here = F.col("at") == F.col("path"), F.col("value") == "{}", Window.partitionBy("scenario", "at")
    # the highest layer with a leaf at or below a path, and the highest with a value exactly there; an empty object takes nothing away from what is below it
    above = _at_prefixes(leaves.filter("scenario is not null")).withColumns({"_below": F.max("layer").over(here), "_here": F.max(F.when(own & ~empty, F.col("layer"))).over(here)})
    lost = F.when(own, F.col("_below") > F.col("layer")).otherwise(F.coalesce(F.col("_here") > F.col("layer"), F.lit(False)))
    kept = above.groupBy("scenario", "layer", "path", "value").agg(F.max(lost.cast("int")).alias("_lost")).filter("_lost = 0")
    held = F.max((~own).cast("int")).over(here)
    return _at_prefixes(kept).withColumn("_held", held).filter(own & ~(empty & (F.col("_held") == 1))).select("scenario", "layer", "path", "value")


def under(rows: DataFrame, path: str) -> DataFrame:
    """The leaves below a path, with paths from there on."""
    return rows.filter(F.col("path").startswith(path + STEP)).withColumn("path", F.substring("path", len(path) + 2, 1 << 20))


def plain(value):
    """A JSON value as text, without quotes."""
    return F.when(value == "null", None).otherwise(F.coalesce(F.get_json_object(F.concat(F.lit('{"x":'), value, F.lit("}")), "$.x"), value))


def citations(rows: DataFrame) -> DataFrame:
    """Merged leaves -> (scenario, path, value, source, note, confidence, verbatim, locator): every object with a value and a source; confidence is 1 where none is given."""
    steps = F.split("path", STEP)
    leaf, parent = F.element_at(steps, -1), F.array_join(F.slice(steps, F.lit(1), F.size(steps) - 1), STEP)
    in_locator = (F.size(steps) >= 2) & (F.element_at(steps, -2) == "locator")
    holder = F.when(in_locator, F.array_join(F.slice(steps, F.lit(1), F.size(steps) - 2), STEP)).otherwise(parent)
    marked = rows.filter(F.size(steps) >= 2).select("scenario", holder.alias("path"), in_locator.alias("_in"), leaf.alias("_name"), plain(F.col("value")).alias("_v"), "value")
    one = lambda name: F.max(F.when(~F.col("_in") & (F.col("_name") == name), F.col("_v"))).alias(name)
    locator = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("_in") & F.col("_v").isNotNull(), F.struct("_name", "_v"))))).alias("locator")
    has = lambda name: F.max((~F.col("_in") & (F.col("_name") == name)).cast("int"))
    found = marked.groupBy("scenario", "path").agg(one("value"), one("source"), one("note"), one("verbatim"), one("confidence"), locator, (has("value") * has("source")).alias("_cited"))
    return found.filter("_cited = 1").drop("_cited").withColumn("confidence", F.coalesce(F.col("confidence").try_cast("double"), F.lit(1.0)))


def unregistered(cited: DataFrame, registry: DataFrame) -> DataFrame:
    """Citations of sources that the registry (``source_id``) doesn't have."""
    return cited.join(registry.select(F.col("source_id").alias("source")).distinct(), "source", "left_anti")


def cited_values(cited: DataFrame, registry: DataFrame) -> DataFrame:
    """Citations with their source's ``tier`` and title; those of unknown sources are left out (see ``unregistered``)."""
    return cited.join(registry.withColumnRenamed("source_id", "source"), "source")


def validated(files: DataFrame) -> DataFrame:
    """(asset, section, body) -> (asset, year, suffix, field, amount, confidence): bodies map "2023A" to thousands."""
    entries = files.select("asset", F.element_at(F.create_map(*[F.lit(x) for kv in VALIDATED_FIELDS.items() for x in kv]), F.col("section")).alias("field"), F.explode(F.from_json("body", "map<string,double>")).alias("key", "thousands"))
    year = F.regexp_extract("key", r"^(\d{4})", 1).try_cast("int")
    return entries.filter("thousands is not null and field is not null").select("asset", year.alias("year"), F.regexp_extract("key", r"^\d{4}\s*([A-Za-z]*)", 1).alias("suffix"), "field", (F.col("thousands") * THOUSAND).alias("amount"), F.lit(VALIDATED_CONFIDENCE).alias("confidence")).filter("year is not null")


def overlaid(actuals: DataFrame, checked: DataFrame) -> DataFrame:
    """Actual periods (``asset, year, label, period_type``) with the validated fields of their year.

    A year's figures go to its period of the type YEAR, or where there is none to the year's first other period by label.
    """
    rank = F.struct((F.col("period_type") != "YEAR").cast("int"), "label")
    target = actuals.groupBy("asset", "year").agg(F.min_by("label", rank).alias("label"))
    of = lambda c: F.max(F.when(F.col("field") == c, F.col("amount"))).alias(c)
    wide = checked.groupBy("asset", "year").agg(*map(of, VALIDATED_FIELDS.values()), F.max("confidence").alias("confidence"))
    return actuals.join(target.join(wide, ["asset", "year"]), ["asset", "year", "label"], "left")
