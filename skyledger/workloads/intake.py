"""Intake of linked token maps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyledger.operators import tracks as tk
from skyledger.session import scratch_path
from skyledger.sources import tokens as tok
from skyledger.workloads.registry import workload

# Every third scene of 250 events has faults: lost links and frames, an instance that says another scene, an agent without entry.
_PARTS = (
    "event_id, event_id {div} 250 AS scene, user_id % 7 AS k, value, event_id {div} 250 % 3 = 1 AND event_id % 97 = 0 AS lost, "
    "event_id {div} 250 % 3 = 1 AND event_id % 31 = 0 AS foreign_one, event_id {div} 250 % 3 = 1 AND event_id % 53 = 5 AS gone"
)
TOKENS_SQL = (
    f"WITH e AS (SELECT {_PARTS.format(div='//')} FROM events), o AS (SELECT *, lag(event_id) OVER w AS pv, lead(event_id) OVER w AS nx FROM e WINDOW w AS (PARTITION BY scene, k ORDER BY event_id)), "
    "i AS (SELECT event_id, CASE WHEN foreign_one THEN scene + 1 ELSE scene END AS scene, CASE WHEN gone THEN NULL ELSE scene END AS frame_scene, scene % 6 = 1 AND k = 2 AS no_agent, "
    "CASE WHEN pv IS NULL THEN NULL WHEN lost THEN -1 ELSE pv END AS prev, CASE WHEN nx IS NULL THEN NULL WHEN lost THEN -1 ELSE nx END AS nxt, value FROM o), "
    "b AS (SELECT a.scene FROM i a LEFT JOIN i n ON a.nxt = n.event_id WHERE a.nxt IS NOT NULL AND n.prev IS DISTINCT FROM a.event_id UNION ALL SELECT a.scene FROM i a LEFT JOIN i n ON a.prev = n.event_id WHERE a.prev IS NOT NULL AND n.nxt IS DISTINCT FROM a.event_id), "
    "f AS (SELECT scene, 'f' AS what FROM e UNION ALL SELECT scene, 'i' FROM i UNION ALL SELECT DISTINCT scene, concat('a', k::VARCHAR) FROM e WHERE NOT (scene % 6 = 1 AND k = 2) "
    "UNION ALL SELECT scene, 'mf' FROM i WHERE frame_scene IS NULL UNION ALL SELECT scene, 'ma' FROM i WHERE no_agent UNION ALL SELECT scene, 's' FROM i WHERE frame_scene <> scene UNION ALL SELECT scene, 'c' FROM b), "
    "g AS (SELECT scene, count(*) FILTER (what = 'f') AS frames, count(*) FILTER (what = 'i') AS instances, count(*) FILTER (what[1] = 'a') AS agents, count(*) FILTER (what = 'mf') AS missing_frame, count(*) FILTER (what = 'ma') AS missing_agent, "
    "count(*) FILTER (what = 's') AS foreign_scene, count(*) FILTER (what = 'c') AS chain_breaks FROM f GROUP BY scene)"
)


def _token_maps(t, *names):
    """The named of frames, instances and agents, written as maps of some 5,000 entries and read back."""
    e = t.events.selectExpr(*_split(_PARTS.format(div="div")))
    w = Window.partitionBy("scene", "k").orderBy("event_id")
    e = e.withColumns({"pv": F.lag("event_id").over(w), "nx": F.lead("event_id").over(w), "part": F.expr("event_id div 5000")})
    token = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    agent = F.concat(F.lit("a"), F.col("scene").cast("string"), F.lit("_"), F.col("k").cast("string"))
    link = lambda c: F.when(F.col(c).isNull(), "").when(F.col("lost"), "lost").otherwise(token("i", c))
    root = scratch_path(t.spark, "maps")
    # Values that look like structure, to be read as text.
    note = F.concat(F.lit('}{"n": ['), F.col("k").cast("string"), F.lit('\\'))
    frames = e.select("part", token("f", "event_id").alias("token"), F.struct("scene", note.alias("note"), F.array("value").alias("at")).alias("v"))
    inst = e.select("part", token("i", "event_id").alias("token"), F.struct(
        F.when(F.col("foreign_one"), F.col("scene") + 1).otherwise(F.col("scene")).alias("scene"), F.when(F.col("gone"), "gone").otherwise(token("f", "event_id")).alias("frame_token"),
        agent.alias("agent_token"), link("pv").alias("prev"), link("nx").alias("next"), F.struct("value").alias("state")).alias("v"))
    agents = e.where("NOT (scene % 6 = 1 AND k = 2)").select("part", agent.alias("token"), F.struct("scene", F.lit("car").alias("type")).alias("v")).distinct()
    out = []
    made = {"frames": frames, "instances": inst, "agents": agents}
    schemas = dict(zip(made, ("scene bigint, note string, at array<double>", "scene bigint, frame_token string, agent_token string, prev string, next string, state struct<value: double>", "scene bigint, type string")))
    for name in names:
        tok.write_token_map(made[name], f"{root}/{name}", file="part", token="token", value=F.col("v"))
        out.append(tok.read_token_map(t.spark, f"{root}/{name}", schemas[name]).select("token", "value.*"))
    return out


def _split(columns: str) -> list[str]:
    return [c.strip() for c in columns.split(", ")]


@workload(
    "token_maps", "S12 E16 J17",
    TOKENS_SQL + " SELECT *, CASE WHEN missing_frame + missing_agent + foreign_scene + chain_breaks = 0 THEN 'accepted' ELSE 'blocked' END AS status FROM g",
)
def _(t):
    return tk.link_facts(*_token_maps(t, "frames", "instances", "agents"))


@workload(
    "token_map_values", "S12",
    "SELECT user_id % 7 AS k, count(*) AS frames, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
def _(t):
    # Its result rests on the frames alone, so the other maps are not made.
    (frames,) = _token_maps(t, "frames")
    k = F.regexp_extract("note", r'^\}\{"n": \[(\d)\\$', 1).cast("bigint")
    return frames.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("frames"), F.round(F.sum(F.col("at")[0]), 4).alias("total"))
