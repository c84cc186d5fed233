"""Queries of the general problems (p3, p5) by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrank.functions.runtime import table
from facetrank.functions.values import point_of
from facetrank.operators.spatial_join import spatial_links, spatial_pairs
from facetrank.sources import rejects


def company_points(spark: SparkSession, folder: str) -> DataFrame:
    point = point_of(F.col("geometry"))
    return table(spark, folder, "companies").select("id", point.alias("p")).where("p is not null").select("id", "p.x", "p.y")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    areas = table(spark, folder, "areas").select("area_id", "geometry")
    return spatial_pairs(company_points(spark, folder), areas, 0.01)


def p3_near(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of companies only."""
    return spatial_pairs(company_points(spark, folder), None, 0.01)


def p3_links(spark: SparkSession, folder: str) -> DataFrame:
    """One row a company and place, with the number of companies there and near it."""
    return spatial_links(company_points(spark, folder), 0.01).select("id", "copies", "links")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.rejected(table(spark, folder, "token_lines")).select("line_id", "reason")


def p5_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The correct lines as keyword sets, tokens joined by `;`."""
    rows = rejects.loaded(table(spark, folder, "token_lines"))
    return rows.select("line_id", "id", F.array_join("tokens", ";").alias("tokens"), "positive_sentiment")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Lines by reason; `ok` for the correct ones."""
    rows = rejects.read_lines(table(spark, folder, "token_lines"))
    return rows.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("lines"))


QUERIES = {f.__name__: f for f in (p3_found, p3_near, p3_links, p5_found, p5_loaded, p5_report)}

_N = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_SPELLINGS = (
    rf"^\s*(?:SRID\s*=\s*[0-9]+\s*;\s*)?POINT\s*\(\s*({_N})\s+({_N})\s*\)\s*$",
    rf"^\s*({_N})\s*,\s*({_N})\s*$",
    rf"^\s*\[\s*({_N})\s*,\s*({_N})\s*\]\s*$",
    rf'^\s*\[\s*"\s*({_N})\s*"\s*,\s*"\s*({_N})\s*"\s*\]\s*$',
)


def _part(i: int) -> str:
    found = ", ".join(f"nullif(regexp_extract(geometry, '{s}', {i}, 'i'), '')" for s in _SPELLINGS)
    return f"try_cast(coalesce({found}) as double)"


_FIELD = r'(?:[^",]*|"(?:[^"]|"")*")'
_LINES = rf"""
with lines as (
  select line_id, raw_line,
    raw_line is not null and not regexp_full_match(raw_line, '(?s){_FIELD}(?:,{_FIELD})*') badly_quoted,
    len(regexp_replace(regexp_replace(raw_line, '"(?:[^"]|"")*"', '', 'g'), '[^,]', '', 'g')) + 1 fields
  from token_lines
),
split as (
  select *, regexp_extract(raw_line, '(?s)^({_FIELD}),({_FIELD}),({_FIELD}),({_FIELD})$', ['a', 'b', 'c', 'd']) f
  from lines
),
bare as (
  select *, {", ".join(rf'''replace(case when f.{x} like '"%' then f.{x}[2:-2] else f.{x} end, '""', '"') {x}''' for x in "abcd")}
  from split
),
judged as (
  select *, case when badly_quoted then 'quoting' when fields is distinct from 4 then 'columns'
    when not regexp_full_match(a, 'nw[0-9]{{10}}') or not regexp_full_match(b, '[0-9]{{14}}') or try_strptime(b, '%Y%m%d%H%M%S') is null
      or not regexp_matches(c, '[^;\s]') or not regexp_full_match(d, '([+-]?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?)?') then 'value'
    end reason
  from bare
)
"""

#: Usable companies' places, for other modules too.
POINTS = f"""
points as (
  select distinct id, x, y from (select id, {_part(1)} x, {_part(2)} y from companies)
  where id is not null and x between -180 and 180 and y between -90 and 90
)"""
_NEAR = f"""
with {POINTS},
cells as (select *, floor(x / 0.02)::bigint cx, floor(y / 0.02)::bigint cy from points),
around as (
  select c.*, cx + i kx, cy + j ky
  from cells c, (values (-1), (0), (1)) s(i), (values (-1), (0), (1)) t(j)
),
near as (
  select a.id ia, a.x ax, a.y ay, b.id ib, b.x bx, b.y by_ from around a join cells b on a.kx = b.cx and a.ky = b.cy and a.id <> b.id
  where sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.01 + 1e-12
)
"""
#: Even-odd rule over the edges of all rings; a point on an edge isn't inside.
_INSIDE = r""",
ring as (select area_id, unnest(regexp_extract_all(geometry, '\(([^()]+)\)', 1)) r, generate_subscripts(regexp_extract_all(geometry, '\(([^()]+)\)', 1), 1) k from areas),
corner as (select area_id, k, trim(unnest(string_split(r, ','))) p, generate_subscripts(string_split(r, ','), 1) i from ring),
xy as (select area_id, k, i, regexp_extract(p, '^(\S+)\s+(\S+)', 1)::double x, regexp_extract(p, '^(\S+)\s+(\S+)', 2)::double y from corner),
edge as (select a.area_id, a.x x1, a.y y1, b.x x2, b.y y2 from xy a join xy b on a.area_id = b.area_id and a.k = b.k and b.i = a.i + 1),
held as (
  select area_id, id, x, y from edge, points
  group by area_id, id, x, y
  having count(*) filter ((y1 > y) <> (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1
    and count(*) filter ((x2 - x1) * (y - y1) = (y2 - y1) * (x - x1) and x between least(x1, x2) and greatest(x1, x2) and y between least(y1, y2) and greatest(y1, y2)) = 0
)
"""

ORACLE = {
    "p3_found": _NEAR + _INSIDE + """
select least(ia, ib) id_a, greatest(ia, ib) id_b from near
union select least(area_id, id), greatest(area_id, id) from held where area_id <> id
""",
    "p3_near": _NEAR + "select distinct least(ia, ib) id_a, greatest(ia, ib) id_b from near",
    "p3_links": _NEAR + """
, at_place as (select x, y, count(*) copies from points group by x, y),
link as (select ia, ax, ay, count(*) links from near where (ax, ay) <> (bx, by_) group by ia, ax, ay)
select id, copies, coalesce(links, 0) links from points join at_place using (x, y) left join link on ia = id and ax = x and ay = y
""",
    "p5_found": _LINES + "select line_id, reason from judged where reason is not null",
    "p5_loaded": _LINES
    + """
select line_id, a id,
  array_to_string(list_filter(list_transform(string_split(c, ';'), lambda t: trim(t)), lambda t, i: t <> ''
    and list_position(list_transform(string_split(c, ';'), lambda u: trim(u)), t) = i), ';') tokens,
  try_cast(d as double) positive_sentiment
from judged where reason is null
""",
    "p5_report": _LINES + "select coalesce(reason, 'ok') reason, count(*) as lines from judged group by 1",
}
