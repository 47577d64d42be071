"""Joining paths with many globs, by what is literal in them.

Each alternative of a glob has an anchor: a whole path, a folder (its literal
prefix), or an extension.  A path meets the globs whose anchor is the path itself, one of
the folders above it, or its extension, by an equi-join; the pattern then verifies.
Globs without anything literal are few by nature; they are folded into
one expression, which all paths are tested with.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktake.functions import globs

_EXTENSION = re.compile(r"\.([^.*?\[\]{}\\/]+)\Z")


def anchor(pattern: str) -> str | None:
    """What a path must have to match a pattern without braces: ``=path``, ``/folder``, ``.extension``; None if nothing is literal."""
    if not globs._WILD.search(pattern):
        return "=" + pattern
    if prefix := globs.literal_prefix(pattern):
        return "/" + prefix
    last = pattern.rsplit("/", 1)[-1]
    found = _EXTENSION.search(last)
    # A class may hold a dot, and an escape a wildcard: what follows the last of them is literal.
    return "." + found.group(1) if found else None


def anchors(path: Column | str) -> Column:
    """All anchors that a path meets."""
    path = F.col(path) if isinstance(path, str) else path
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    name = F.element_at(parts, -1)
    own = F.when(F.contains(name, F.lit(".")), F.array(F.concat(F.lit("."), F.substring_index(name, ".", -1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.concat(F.lit("="), path)), F.when(F.size(parts) > 1, folders).otherwise(F.array().cast("array<string>")), own)


def index(policies: DataFrame, id_col: str = "id", glob_col: str = "glob") -> DataFrame:
    """``id, anchor, regex``: a row for each alternative of each glob."""
    kind = policies.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, glob in enumerate(batch.column("glob").to_pylist()):
                for one in dict.fromkeys(globs.alternatives(glob)):
                    at.append(i)
                    found.append((anchor(one), globs.glob_to_regex(one)))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int32())), *(pa.array([f[k] for f in found], pa.string()) for k in (0, 1))], names=["id", "anchor", "regex"])

    named = policies.where(F.col(glob_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(glob_col).alias("glob"))
    return named.mapInArrow(run, f"id {kind}, anchor string, regex string")


def match(paths: DataFrame, policies: DataFrame, id_col: str = "id", glob_col: str = "glob") -> DataFrame:
    """``path, id`` for every distinct path and each policy whose glob matches it, once."""
    rules, paths = index(policies, id_col, glob_col), paths.select("path").distinct()
    met = paths.select("path", F.explode(anchors("path")).alias("anchor")).join(rules.where(F.col("anchor").isNotNull()), "anchor")
    out = met.where(F.expr("path rlike regex")).select("path", "id")
    # The policy table is edited by hand; of it, globs like ``**`` or ``*`` alone come to the driver.
    loose = [(r["id"], r["regex"]) for r in rules.where(F.col("anchor").isNull()).collect()]
    if loose:
        kind = policies.schema[id_col].dataType
        fits = F.array_compact(F.array(*(F.when(F.col("path").rlike(regex), F.lit(i).cast(kind)) for i, regex in loose)))
        out = out.unionByName(paths.select("path", F.explode(fits).alias("id")))
    return out.distinct()
