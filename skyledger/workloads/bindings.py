"""Domain tables derived from the driver's tables by arithmetic that Spark and DuckDB share.

Each binding is one select over one driver table, written once and rendered for both engines, so the
domain tables grow with the driver tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_K = {
    "spark": "CAST(get_json_object(props, '$.k') AS BIGINT)",
    "duck": "CAST(json_extract_string(props, '$.k') AS BIGINT)",
}
_DIV = {"spark": "div", "duck": "//"}
_SECONDS = {
    "spark": "(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c}) / 1000000e0)",
    "duck": "(epoch_us({c}) / 1000000e0)",
}


def _render(text: str, engine: str) -> str:
    for c in ("ts", "o_orderdate", "l_shipdate"):
        text = text.replace("<seconds " + c + ">", _SECONDS[engine].format(c=c))
    return text.replace("<k>", _K[engine]).replace("<div>", _DIV[engine])


_X1 = "CAST((event_id * 7919 + <k> * 13) % 24 * 26 + event_id % 7 AS DOUBLE)"
_Y1 = "CAST((event_id * 104729 + <k> * 29) % 24 * 26 + event_id % 5 AS DOUBLE)"
_LX = "CAST(l_partkey % 6 AS DOUBLE) * 0.15e0"
_LY = "CAST(l_suppkey % 4 AS DOUBLE) * 0.22e0"
_LW = "(0.02e0 + CAST(l_linenumber AS DOUBLE) * 0.07e0)"
_LH = "(0.02e0 + CAST(CAST(l_quantity AS BIGINT) % 5 AS DOUBLE) * 0.06e0)"
_ROW_ID = (
    "concat(lpad(CAST(l_orderkey AS VARCHAR(20)), 10, '0'), lpad(CAST(l_linenumber AS VARCHAR(20)), 2, '0'), "
    "lpad(CAST(l_partkey AS VARCHAR(20)), 10, '0'), lpad(CAST(l_suppkey AS VARCHAR(20)), 8, '0'), "
    "lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR(20)), 12, '0'))"
)

# name -> (driver table, {column: expression}, distinct)
BINDINGS: dict[str, tuple[str, dict[str, str], bool]] = {
    "detections": (
        "events",
        {
            "det_id": "event_id",
            "image_id": "user_id",
            "prompt": "event_type",
            "class_name": "CASE CAST(floor(value) AS BIGINT) % 3 WHEN 0 THEN 'car' WHEN 1 THEN 'bus' ELSE 'truck' END",
            "confidence": "least(1e0, value / 500e0)",
            "x1": _X1,
            "y1": _Y1,
            "x2": f"{_X1} + (24 + event_id % 17)",
            "y2": f"{_Y1} + (24 + event_id % 13)",
        },
        False,
    ),
    "objects": (
        "lineitem",
        {
            "obj_id": _ROW_ID,
            "image_id": "l_orderkey <div> 8",
            "split": "CASE l_orderkey <div> 8 % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END",
            "class_id": "l_suppkey % 3",
            "x1": _LX,
            "y1": _LY,
            "x2": f"{_LX} + {_LW}",
            "y2": f"{_LY} + {_LH}",
        },
        False,
    ),
    "runs": (
        "lineitem",
        {
            "mask_id": "l_orderkey <div> 50",
            "y": "l_partkey % 40",
            "x0": "(l_suppkey * 7) % 60",
            "x1": "(l_suppkey * 7) % 60 + 1 + CAST(l_quantity AS BIGINT) % 9",
        },
        True,
    ),
    "layers": (
        "lineitem",
        {
            "image": "l_orderkey <div> 50",
            "layer": "CASE l_returnflag WHEN 'A' THEN 'facility' WHEN 'N' THEN 'band' ELSE 'road' END",
            "y": "l_partkey % 40",
            "x0": "(l_suppkey * 7) % 60",
            "x1": "least(64, (l_suppkey * 7) % 60 + 1 + CAST(l_quantity AS BIGINT) % 9 + CASE l_returnflag WHEN 'A' THEN 12 ELSE 0 END)",
            "part": "l_linenumber",
        },
        False,
    ),
    "index": (
        "orders",
        {
            "target_id": "o_orderkey",
            "pos": "o_orderkey",
            "image": "concat('img_', CAST(o_orderkey <div> 4 AS VARCHAR(20)), '.jpg')",
            "class_name": "CASE o_orderpriority WHEN '1-URGENT' THEN 'car' WHEN '2-HIGH' THEN 'bus' WHEN '3-MEDIUM' THEN 'truck' "
            "WHEN '4-NOT SPECIFIED' THEN 'car' ELSE 'van' END",
            "confidence": "CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE round(o_totalprice / 500000e0, 4) END",
            "prompt_hits": "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey % 3 + 1 END",
            "mask_file": "CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE concat('m', CAST(o_orderkey AS VARCHAR(20)), '.png') END",
        },
        False,
    ),
    "log": (
        "lineitem",
        {
            "rec_id": _ROW_ID,
            "target_id": "l_orderkey",
            "noted": "<seconds l_shipdate>",
            "label": "CASE l_linenumber WHEN 1 THEN 'reject' WHEN 2 THEN 'hard_negative' WHEN 3 THEN 'hard_positive' WHEN 7 THEN 'needs_review' "
            "WHEN 6 THEN CASE WHEN l_returnflag = 'R' THEN '' ELSE 'empty_ok' END ELSE 'accept' END",
            "is_auto": "l_returnflag = 'A'",
            "source": "CASE WHEN l_linestatus = 'O' THEN 'human' WHEN l_returnflag = 'A' THEN 'machine' ELSE 'import' END",
            "object_type": "CASE l_partkey % 5 WHEN 0 THEN 'car' WHEN 1 THEN 'bus' WHEN 2 THEN 'truck' WHEN 3 THEN '' ELSE NULL END",
            "issue_type": "CASE l_suppkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'blurred' WHEN 2 THEN 'occluded' ELSE NULL END",
            "verifiable": "CASE l_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END",
        },
        False,
    ),
    "frames": (
        "events",
        {"track_id": "user_id", "frame_id": "event_id", "t": "<seconds ts> / 3600e0", "kind": "event_type", "value": "value"},
        False,
    ),
    "signals": (
        "lineitem",
        {
            "candidate_id": "l_orderkey",
            "signal_id": _ROW_ID,
            "kind": "CASE l_partkey % 7 WHEN 0 THEN 'parking_marking' WHEN 1 THEN 'vehicle_arrangement' WHEN 2 THEN 'exclusion_coverage' "
            "WHEN 3 THEN 'entrance_connectivity' WHEN 4 THEN 'external_parking_map' WHEN 5 THEN 'surface_compatibility' ELSE 'non_parking_conflict' END",
            "source_id": "concat('s', CAST(l_suppkey AS VARCHAR(20)))",
            "independence_group": "concat('g', CAST(l_suppkey % 5 AS VARCHAR(20)))",
            "strength": "least(1e0, 0.4e0 + l_discount * 6e0)",
        },
        False,
    ),
}


def cte(*names: str) -> str:
    """The named bindings as SQL common table expressions."""
    parts = []
    for name in names:
        table, columns, distinct = BINDINGS[name]
        body = ", ".join(f"{_render(e, 'duck')} AS {c}" for c, e in columns.items())
        parts.append(f"{name} AS (SELECT {'DISTINCT ' if distinct else ''}{body} FROM {table})")
    return ",\n".join(parts)


IOU_SQL = (
    "(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))) / "
    "((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - "
    "(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))))"
)


class Tables:
    """Driver tables as attributes and derived tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def bound(self, name: str) -> DataFrame:
        table, columns, distinct = BINDINGS[name]
        df = self.raw(table).selectExpr(*[f"{_render(e, 'spark')} AS `{c}`" for c, e in columns.items()])
        return df.distinct() if distinct else df

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.bound(name) if name in BINDINGS else self.raw(name)
