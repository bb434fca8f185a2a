"""Column expressions on free text: model replies, metric logs and subtitle blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_label(text: Column, allowed: Sequence[str]) -> Column:
    """The label a reply names: its last line if that is exactly a label, else the longest label among its words, else null."""
    reply = F.trim(text)
    last = F.lower(F.trim(F.element_at(F.split(reply, r"[\r\n]+"), -1)))
    exact = [F.when(last == label.lower(), label) for label in allowed]
    spaced = lambda t: F.concat(F.lit(" "), F.array_join(F.split(F.lower(t), "[^a-z0-9_]+"), " "), F.lit(" "))
    words = spaced(reply)
    named = [F.when(F.contains(words, spaced(F.lit(label))), label) for label in sorted(allowed, key=len, reverse=True)]
    return F.when(F.coalesce(reply, F.lit("")) != "", F.coalesce(*exact, *named))


def _candidate(text: Column) -> Column:
    """What stands between the first two code fences, without the language named there, else the span from the first { to the last }."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    parts = F.split(text, "```")
    block = strip(F.get(parts, F.lit(1)))
    fenced = strip(F.when(F.startswith(F.lower(block), F.lit("json")), F.substring(block, 5, 1 << 30)).otherwise(block))
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    span = F.when((first > 0) & F.contains(text, F.lit("}")) & (last > first), F.substr(text, first, last - first + 1))
    return F.when((F.size(parts) > 2) & (fenced != ""), fenced).otherwise(span)


def _is_object(candidate: Column) -> Column:
    """One valid JSON object."""
    return F.startswith(F.trim(candidate), F.lit("{")) & F.try_parse_json(candidate).isNotNull()


# The tokens of JSON text: strings, marks of structure, and runs of anything else, each with the white space after it.
_TOKENS = r'(?:"(?:[^"\\]++|\\.)*+"|[{}\[\]:,]|[^\s{}\[\]:,"]+|")\s*+'


def repair_json(candidate: Column) -> Column:
    """JSON text token by token: a comma before a closing mark goes, a bare name before a colon is quoted; strings stay as they are."""
    tokens = F.regexp_extract_all(candidate, F.lit(_TOKENS), F.lit(0))

    def mended(token, i):
        body, space = F.regexp_extract(token, r"^\S*", 0), F.regexp_extract(token, r"\s*$", 0)
        after = F.regexp_extract(F.get(tokens, i + 1), r"^\S*", 0)
        name = F.regexp_extract(body, "^[A-Za-z_][A-Za-z_0-9]*$", 0) != ""
        return F.when((body == ",") & after.isin("}", "]"), space).when(name & (after == ":"), F.concat(F.lit('"'), body, F.lit('"'), space)).otherwise(token)

    return F.array_join(F.transform(tokens, mended), "")


def extract_json(text: Column) -> Column:
    """The JSON object in a reply as text, repaired if need be, or null."""
    candidate = _candidate(F.trim(text))
    return F.get(F.filter(F.array(candidate, repair_json(candidate)), _is_object), F.lit(0))


def choose_label(text: Column, allowed: Sequence[str]) -> Column:
    """The structured label if it is allowed, else the label named in the text."""
    structured = F.get_json_object(extract_json(text), "$.label")
    return F.coalesce(F.when(structured.isin(list(allowed)), structured), parse_label(text, allowed))


# Verdicts of a machine review.
VERDICTS = ("pass", "needs_review", "fail")


def verdict(json_text: Column, evidence_limit: int | None = None) -> Column:
    """verdict, confidence in 0..1, problem count from 0 up and evidence (its first evidence_limit characters where a
    consumer sets such a limit); null when the verdict is not an allowed one."""
    evidence = F.coalesce(F.get_json_object(json_text, "$.evidence"), F.lit(""))
    name = F.lower(F.coalesce(F.get_json_object(json_text, "$.verdict"), F.lit("")))
    number = lambda path: F.coalesce(F.get_json_object(json_text, path).try_cast("double"), F.lit(0.0))
    return F.when(
        name.isin(list(VERDICTS)),
        F.struct(
            name.alias("verdict"),
            F.greatest(F.lit(0.0), F.least(number("$.confidence"), F.lit(1.0))).alias("confidence"),
            F.greatest(F.lit(0), F.coalesce(F.get_json_object(json_text, "$.estimated_problem_count").try_cast("int"), F.lit(0))).alias("problems"),
            (evidence if evidence_limit is None else F.substring(evidence, 1, evidence_limit)).alias("evidence"),
        ),
    )


def nested(json_text: Column, path: str, default: str | None = None) -> Column:
    """The value at a dotted path of a JSON text, or the default."""
    return F.coalesce(F.get_json_object(json_text, "$." + path), F.lit(default))


# Metric log patterns.
_ALL_ROW = r"^\s*all\s+\d+\s+\d+\s+([\d.]+)\s+([\d.]+)\s+([\d.]+)\s+([\d.]+)"
_P_AND_R = r"P[:\s]*([\d.]+).*R[:\s]*([\d.]+)"


def line_metrics(line: Column) -> Column:
    """precision, recall, map50 and map50_95 named on one log line; the summary row wins."""
    def pick(pattern: str, group: int) -> Column:
        text = F.regexp_extract(line, pattern, group)
        return F.when(text != "", text.try_cast("double"))

    return F.struct(
        F.coalesce(pick(_ALL_ROW, 1), pick(_P_AND_R, 1)).alias("precision"),
        F.coalesce(pick(_ALL_ROW, 2), pick(_P_AND_R, 2)).alias("recall"),
        F.coalesce(pick(_ALL_ROW, 3), pick(r"mAP50[:\s]*([\d.]+)", 1)).alias("map50"),
        F.coalesce(pick(_ALL_ROW, 4), pick(r"mAP50-95[:\s]*([\d.]+)", 1)).alias("map50_95"),
    )


# Subtitle block patterns.
_GPS = r"(?i)GPS\s*\(\s*(-?\d+\.\d+)\s*[,，]\s*(-?\d+\.\d+)(?:\s*[,，]\s*(-?\d+(?:\.\d+)?))?\s*\)"
_ALTITUDE = r"(?i)(?:ALT|H)\s*(-?\d+(?:\.\d+)?)\s*m"
_TIME = r"(\d{2}):(\d{2}):(\d{2})[,.](\d{3})"
_LAT_LON = r"(?i)(?:lat|纬度)\s*[:=]?\s*(-?\d+\.\d+)\s*[,，;]\s*(?:lon|lng|经度)\s*[:=]?\s*(-?\d+\.\d+)"


def subtitle_record(block: Column) -> Column:
    """time_seconds, latitude, longitude and altitude_m of one subtitle block, each null when absent;
    null for a block with neither time nor position."""
    def pick(pattern: str, group: int) -> Column:
        text = F.regexp_extract(block, pattern, group)
        return F.when(text != "", text.try_cast("double"))

    timed, gps, pair = block.rlike(_TIME), block.rlike(_GPS), block.rlike(_LAT_LON)
    seconds = pick(_TIME, 1) * 3600 + pick(_TIME, 2) * 60 + pick(_TIME, 3) + pick(_TIME, 4) / 1000.0
    return F.when(
        timed | gps | pair,
        F.struct(
            seconds.alias("time_seconds"),
            F.when(gps, pick(_GPS, 1)).when(pair, pick(_LAT_LON, 1)).alias("latitude"),
            F.when(gps, pick(_GPS, 2)).when(pair, pick(_LAT_LON, 2)).alias("longitude"),
            F.bround(F.coalesce(F.when(gps, pick(_GPS, 3)), pick(_ALTITUDE, 1)), 1).alias("altitude_m"),
        ),
    )
