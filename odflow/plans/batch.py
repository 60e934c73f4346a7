"""The preparation batch as one restartable run (Q9).

Stages form a graph: each names the tables it needs and makes one or more tables.  A table is
written aside under a version of its own; only when all tables of a stage are there does one
manifest row name them, so a run that dies between stages, or while writing, leaves nothing
half-visible.  A later run skips every stage whose manifest row has the same state, that is
the stage's own key and the versions of the tables it needs; a change upstream runs what
depends on it again.  Tables with several outputs from one input are written in one pass.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odflow.operators.joins import attach_centroids
from odflow.operators.locate import cell_index
from odflow.operators.segments import StopRule, attach_segments, classify_stops, on_off
from odflow.plans.prepare import zone_trips
from odflow.plans.survey import prepare_survey

_MANIFEST = "stage string, state string, version string, tables array<string>"
Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Split:
    """Several tables out of one scan: each is an array of structs of a row of ``df``, one row each."""

    df: DataFrame
    outputs: Mapping[str, Column]


@dataclass(frozen=True)
class Stage:
    """``make(tables)`` gives the stage's tables; ``key`` says what it computes, with its parameters."""

    name: str
    tables: Sequence[str]
    make: Callable[[Tables], Tables | Split]
    needs: Sequence[str] = ()
    key: object = field(default="")


def _committed(spark: SparkSession, root: str) -> dict[tuple[str, str], str]:
    """Version of each committed (stage, state)."""
    try:
        rows = spark.read.schema(_MANIFEST).json(f"{root}/manifest/*").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {(r["stage"], r["state"]): r["version"] for r in sorted(rows, key=lambda r: r["version"])}


def _path(root: str, stage: Stage, version: str) -> str:
    return f"{root}/tables/{stage.name}-{version}"


def _read(spark: SparkSession, path: str, table: str, split: bool) -> DataFrame:
    if not split:
        return spark.read.parquet(f"{path}/{table}")
    rows = spark.read.parquet(f"{path}/split").where(F.col("_table") == table)
    return rows.select(f"_{table}.*")


def _write(made: Tables | Split, path: str, tables: Sequence[str]) -> None:
    if isinstance(made, Split):
        def named(t):
            return lambda s: F.struct(F.lit(t).alias("_table"), *[(s if u == t else F.lit(None)).alias(f"_{u}") for u in tables])

        each = [F.transform(made.outputs[t], named(t)) for t in tables]
        # The arrays' types differ only in which struct is there; each keeps its own column.
        made.df.select(F.explode(F.concat(*each)).alias("_r")).select("_r.*").write.partitionBy("_table").parquet(f"{path}/split")
        return
    for t in tables:
        made[t].write.parquet(f"{path}/{t}")


def run_stages(spark: SparkSession, root: str, stages: Sequence[Stage]) -> Tables:
    """Run what is not committed yet, in the order given; all tables, read from their files."""
    root = root.rstrip("/")
    done = _committed(spark, root)
    tables: Tables = {}
    versions: dict[str, str] = {}
    for stage in stages:
        state = hashlib.sha256(json.dumps([stage.name, str(stage.key), list(stage.tables), [versions[n] for n in stage.needs]])
                               .encode()).hexdigest()
        version = done.get((stage.name, state))
        split = None
        if version is None:
            version = uuid.uuid4().hex
            made = stage.make({n: tables[n] for n in stage.needs})
            split = isinstance(made, Split)
            _write(made, _path(root, stage, version), stage.tables)
            version += "-split" if split else ""
            row = spark.createDataFrame([(stage.name, state, version, list(stage.tables))], _MANIFEST)
            row.coalesce(1).write.json(f"{root}/manifest/{stage.name}-{version}")
        split = version.endswith("-split")
        path = _path(root, stage, version.removesuffix("-split"))
        for t in stage.tables:
            tables[t] = _read(spark, path, t, split)
            versions[t] = version
    return tables


def _points(keep: Sequence[str], key: str) -> dict[str, Column]:
    """Trip ends with the boarding or alighting point alongside, and both lines' vertices."""
    c = F.col
    end = lambda kind, lon, lat, by_lon, by_lat: F.struct(
        *[c(k).alias(k) for k in keep], F.lit(kind).alias("Type"), c(lon).alias("lon"), c(lat).alias("lat"),
        c(by_lon).alias("ba_lon"), c(by_lat).alias("ba_lat"))

    def line(lon1, lat1, lon2, lat2):
        vertex = lambda i, lon, lat: F.struct(c(key).alias(key), F.lit(i).alias("vertex"), c(lon).alias("lon"), c(lat).alias("lat"))
        there = c(lon1).isNotNull() & c(lat1).isNotNull() & c(lon2).isNotNull() & c(lat2).isNotNull()
        both = F.array(vertex(0, lon1, lat1), vertex(1, lon2, lat2))
        return F.when(there, both).otherwise(F.slice(both, 1, 0))

    return {"trip_ends": F.array(end("Orig", "o_lon", "o_lat", "b_lon", "b_lat"), end("Dest", "d_lon", "d_lat", "a_lon", "a_lat")),
            "od_lines": line("o_lon", "o_lat", "d_lon", "d_lat"), "ba_lines": line("b_lon", "b_lat", "a_lon", "a_lat")}


def preparation(raw: DataFrame, key: str, layer: DataFrame, stops: DataFrame, rules: Sequence[StopRule],
                rides: Sequence[DataFrame], panel: DataFrame, survey: Mapping[str, object] | None = None,
                keep: Sequence[str] = (), source: str = "") -> list[Stage]:
    """The stages of the whole batch: trips, their ends and lines, stop segments, rides with segments,
    the panel with zone points, and zone trips (J1, J4, J7, J13, P15, G1, U4, Q10).

    ``raw`` has ``o_lon .. d_lat`` and the boarding and alighting points ``b_lon .. a_lat``;
    ``survey`` are the options of :func:`odflow.plans.survey.prepare_survey`; ``keep`` are the
    columns that ends and zone trips carry; ``source`` names the version of the inputs.  The
    table ``rides`` holds identical rows of the lookup once, with their number in ``copies``
    (:func:`odflow.operators.segments.repeat_rows` gives them back), as it would grow with the
    square of the times a stop is listed.
    """
    survey = dict(survey or {})
    said = [source, key, sorted((k, str(v)) for k, v in survey.items()), list(keep)]
    return [
        Stage("trips", ["trips"], lambda t: {"trips": prepare_survey(raw, key, **survey)}, key=said),
        Stage("points", ["trip_ends", "od_lines", "ba_lines"], lambda t: Split(t["trips"], _points(keep, key)), ["trips"], said),
        Stage("stop_segments", ["stop_segments"], lambda t: {"stop_segments": classify_stops(stops, rules)}, key=[source, list(rules)]),
        Stage("rides", ["rides"], lambda t: {"rides": on_off(*[attach_segments(r, t["stop_segments"], copies="copies") for r in rides])},
              ["stop_segments"], [source, "copies"]),
        Stage("panel", ["panel"], lambda t: {"panel": attach_centroids(panel, layer, "o_zone", "d_zone")}, key=source),
        Stage("zone_trips", ["zone_trips"], lambda t: {"zone_trips": zone_trips(
            t["trips"], layer, keep=keep, index=cell_index(layer, carry=["cx", "cy"]))}, ["trips"], said),
    ]
