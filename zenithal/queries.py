"""The registered queries: each operator of the engine over a sky catalog derived from the test tables.

Customers are the objects of a director table, orders its child sources, suppliers a
second director (references) of the same partitioning; nations are a regular table, and
a match table pairs objects with references. Positions are exact in hundredths of a
degree. Every query has its DuckDB counterpart, which derives the same catalog.
"""

from __future__ import annotations

import atexit
import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import CHILD, DIRECTOR, MATCH, Striping, TableSpec
from .engine import Engine
from .errors import EngineError
from .functions import spherical as S
from .functions.box import SphericalBox
from .operators import duplication as D
from .operators import partitioning as P
from .operators.chunker import Chunker
from .operators.near_neighbour import near_join
from .sources import readers
from .sources.store import Store
from .streaming.ingest import stream_into

STRIPING = Striping(18, 3, 2.0, 1)
_MATCH_RADIUS = 1.999


def sky(lon_key: str, lon_mul: int, lat_mul: int) -> tuple[str, str]:
    """SQL, the same in Spark and DuckDB, of a position derived from a key."""
    return f"CAST(({lon_key} * {lon_mul}) % 36000 AS DOUBLE) / 100", f"CAST(({lon_key} * {lat_mul}) % 17801 AS DOUBLE) / 100 - 89"


_O, _S, _R = sky("c_custkey", 7919, 104729), sky("o_custkey", 7919, 104729), sky("s_suppkey", 6101, 130363)
TABLES = {
    "Object": ("customer", f"c_custkey AS objectId, {_O[0]} AS ra, {_O[1]} AS decl, c_name AS name, c_nationkey AS fieldId, c_acctbal AS balance, c_mktsegment AS segment, c_acctbal * 1e-30 AS flux"),
    "Source": ("orders", f"o_orderkey AS sourceId, o_custkey AS objectId, {_S[0]} AS sra, {_S[1]} AS sdecl, o_totalprice AS price, o_orderstatus AS status, o_orderpriority AS priority, o_orderdate AS taken"),
    "Ref": ("supplier", f"s_suppkey AS refId, {_R[0]} AS ra, {_R[1]} AS decl, s_nationkey AS fieldId, s_acctbal AS balance"),
    "Field": ("nation", "n_nationkey AS fieldId, n_name AS fieldName, n_regionkey AS zone"),
}
_SPECS = [
    TableSpec("Object", DIRECTOR, "objectId", "ra", "decl"),
    TableSpec("Source", CHILD, "objectId", "sra", "sdecl", director="Object"),
    TableSpec("Ref", DIRECTOR, "refId", "ra", "decl"),
    TableSpec("Field"),
    TableSpec("RefMatch", MATCH, "objectId", director="Object", director2="Ref", key2="refId", flag="flags", ang_sep=2.0),
]


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = TABLES[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*_split(columns))


def _split(columns: str) -> list[str]:
    out, depth = [""], 0
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append("")
        else:
            out[-1] += ch
    return [c.strip() for c in out]


def matches(spark: SparkSession, sf_dir: str, chunker: Chunker | None = None) -> DataFrame:
    """Pairs of objects and references, partitioned by the positions of both."""
    o = derived(spark, sf_dir, "Object").select("objectId", F.col("ra").alias("ora"), F.col("decl").alias("odecl"))
    r = derived(spark, sf_dir, "Ref").select("refId", F.col("ra").alias("rra"), F.col("decl").alias("rdecl"))
    pairs = near_join(o, r, (F.col("ora"), F.col("odecl")), (F.col("rra"), F.col("rdecl")), _MATCH_RADIUS)
    located = P.matches_by_position(pairs, chunker or Chunker(STRIPING.stripes, STRIPING.sub_stripes, STRIPING.overlap), ("ora", "odecl"), ("rra", "rdecl"))
    return located.select("objectId", "refId", "flags", "chunkId", "subChunkId")


def scratch(spark: SparkSession, what: str) -> str:
    """A folder of its own in the warehouse, which goes when the driver ends."""
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{what}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            Store(spark).delete(path)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass

    atexit.register(drop)
    return path


def catalog(spark: SparkSession, sf_dir: str, **options) -> Engine:
    """An engine over the derived tables; nothing is read or written until a query runs."""
    engine = Engine(spark, scratch(spark, "sky"), "sky", **options)
    engine.catalog.create_database("sky", STRIPING)
    for spec in _SPECS:
        load = (lambda: matches(spark, sf_dir)) if spec.name == "RefMatch" else (lambda name=spec.name: derived(spark, sf_dir, name))
        engine.catalog.register("sky", spec, load)
    return engine


# ---------------------------------------------------------------- DuckDB side

_CHUNKER = Chunker(STRIPING.stripes, STRIPING.sub_stripes, STRIPING.overlap)


def sep(a: str, b: str, c: str, d: str) -> str:
    """DuckDB SQL of the angular separation."""
    return f"degrees(2 * asin(sqrt(least(1.0, pow(sin(radians({d} - {b}) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - {a}) / 2), 2)))))"


def _strips() -> str:
    rows = ", ".join(f"({k}, {w!r}::DOUBLE, {n}, {n * _CHUNKER.chunks[k // _CHUNKER.sub_stripes]}, {a!r}::DOUBLE)" for k, (w, n, a) in enumerate(zip(_CHUNKER.width, _CHUNKER.sub_chunks, _CHUNKER.alpha, strict=True)))
    return f"strips(ss, w, n, total, alpha) AS (VALUES {rows})"


def _located(table: str, lon: str, lat: str) -> str:
    """DuckDB SQL: a table with chunkId and subChunkId."""
    c = _CHUNKER
    ss = f"least(CAST(floor(({lat} + 90) / {c.sub_height!r}::DOUBLE) AS INT), {c.stripes * c.sub_stripes - 1})"
    cell = "least(CAST(floor(_lon / w) AS BIGINT), total - 1)"
    return f"""(SELECT *, CAST({2 * c.stripes} * (ss // {c.sub_stripes}) + {cell} // n AS INT) AS chunkId, CAST({c.most} * (ss % {c.sub_stripes}) + {cell} % n AS INT) AS subChunkId
        FROM (SELECT *, {ss} AS _ss, {lon} AS _lon FROM {table}) JOIN strips ON ss = _ss)"""


_MATCHES = f"""pairs AS (
    SELECT o.objectId, o.ra AS ora, o.decl AS odecl, r.refId, r.ra AS rra, r.decl AS rdecl FROM Object o JOIN Ref r ON abs(o.decl - r.decl) < 2 AND {sep("o.ra", "o.decl", "r.ra", "r.decl")} < {_MATCH_RADIUS}
), m1 AS (SELECT objectId, refId, chunkId AS c1 FROM {_located("pairs", "ora", "odecl")}),
m2 AS (SELECT objectId AS o2, refId AS r2, chunkId AS c2 FROM {_located("pairs", "rra", "rdecl")}),
RefMatch AS (
    SELECT objectId, refId, CASE WHEN c1 = c2 THEN 3 ELSE 1 END AS flags, c1 AS chunkId FROM m1 JOIN m2 ON objectId = o2 AND refId = r2
    UNION ALL SELECT objectId, refId, 2, c2 FROM m1 JOIN m2 ON objectId = o2 AND refId = r2 WHERE c1 <> c2)"""


def duck(select: str, *extra: str) -> str:
    tables = ", ".join(f"{n} AS (SELECT {c} FROM {t})" for n, (t, c) in TABLES.items())
    return f"WITH RECURSIVE {', '.join([tables, *extra])} {select}"


# ---------------------------------------------------------------- statements of the dialect

_BAND = {"box": "ra >= 10.005 AND ra <= 60.005 AND decl >= -20.005 AND decl <= 30.005"}
#: name: (statement, DuckDB select, further tables of the DuckDB side)
STATEMENTS: dict[str, tuple] = {
    "scan_filter": ("SELECT objectId, ra, decl FROM Object WHERE balance > 5000.005 AND segment = 'BUILDING'", "SELECT objectId, ra, decl FROM Object WHERE balance > 5000.005 AND segment = 'BUILDING'"),
    "qualified_names": ("SELECT sky.Object.objectId AS id, Object.ra FROM sky.Object WHERE sky.Object.objectId < 50", "SELECT objectId AS id, ra FROM Object WHERE objectId < 50"),
    "star": ("SELECT * FROM Field", "SELECT * FROM Field"),
    "table_star": ("SELECT f.*, s.sourceId FROM Source s, Object o, Field f WHERE s.objectId = o.objectId AND o.fieldId = f.fieldId AND s.price < 2000.005", "SELECT f.*, s.sourceId FROM Source s JOIN Object o USING (objectId) JOIN Field f ON o.fieldId = f.fieldId WHERE s.price < 2000.005"),
    "pk_lookup": ("SELECT objectId, name FROM Object WHERE objectId = 42", "SELECT objectId, name FROM Object WHERE objectId = 42"),
    "pk_in": ("SELECT objectId, name FROM Object WHERE objectId IN (1, 17, 42, 100)", "SELECT objectId, name FROM Object WHERE objectId IN (1, 17, 42, 100)"),
    "pk_between": ("SELECT objectId, name FROM Object WHERE objectId BETWEEN 10 AND 20", "SELECT objectId, name FROM Object WHERE objectId BETWEEN 10 AND 20"),
    "child_by_fk": ("SELECT sourceId, price FROM Source WHERE objectId = 42", "SELECT sourceId, price FROM Source WHERE objectId = 42"),
    "areaspec_box": ("SELECT objectId FROM Object WHERE areaspec_box(10.005, -20.005, 60.005, 30.005)", f"SELECT objectId FROM Object WHERE {_BAND['box']}"),
    "areaspec_box_wrap": ("SELECT objectId, ra FROM Object WHERE areaspec_box(350.005, -40.005, 20.005, 40.005)", "SELECT objectId, ra FROM Object WHERE (ra >= 350.005 OR ra <= 20.005) AND decl BETWEEN -40.005 AND 40.005"),
    "areaspec_circle": ("SELECT o.objectId, COUNT(*) AS n_sources, MAX(s.price) AS dearest FROM Object o JOIN Source s USING (objectId) WHERE areaspec_circle(30, 10, 40.0051) GROUP BY o.objectId", f"SELECT o.objectId, COUNT(*) AS n_sources, MAX(s.price) AS dearest FROM Object o JOIN Source s USING (objectId) WHERE {sep('o.ra', 'o.decl', '30', '10')} <= 40.0051 GROUP BY o.objectId"),
    "areaspec_ellipse": (
        "SELECT objectId FROM Object WHERE areaspec_ellipse(120, 0, 108000.5, 72000.5, 90)",
        # a position angle of 90 degrees at the equator puts the foci on the equator
        f"SELECT objectId FROM Object WHERE {sep('ra', 'decl', '(120 + f)', '0')} + {sep('ra', 'decl', '(120 - f)', '0')} <= 2 * 108000.5 / 3600 + 1e-12",
        "foc AS (SELECT degrees(acos(cos(radians(108000.5 / 3600)) / cos(radians(72000.5 / 3600)))) AS f)",
    ),
    "areaspec_poly": ("SELECT objectId FROM Object WHERE areaspec_poly(0.005, 0.003, 90.005, 0.003, 45.005, 85.003)", None),
    "area_equals": ("SELECT COUNT(*) AS n FROM Object WHERE areaspec_box(10.005, -20.005, 60.005, 30.005) = 1 AND balance > 0.005", f"SELECT COUNT(*) AS n FROM Object WHERE {_BAND['box']} AND balance > 0.005"),
    "area_with_limit": ("SELECT objectId, ra FROM Object WHERE areaspec_box(10.005, -20.005, 60.005, 30.005) ORDER BY ra, objectId LIMIT 7", f"SELECT objectId, ra FROM Object WHERE {_BAND['box']} ORDER BY ra, objectId LIMIT 7"),
    "region_function": ("SELECT COUNT(*) AS n FROM Object WHERE s2PtInCircle(ra, decl, 30, 10, 40.0051) = 1 AND balance BETWEEN 100.005 AND 9000.005", f"SELECT COUNT(*) AS n FROM Object WHERE {sep('ra', 'decl', '30', '10')} <= 40.0051 AND balance BETWEEN 100.005 AND 9000.005"),
    "region_truth": ("SELECT objectId FROM Object WHERE s2PtInBox(ra, decl, 10.005, -20.005, 60.005, 30.005) ORDER BY objectId", f"SELECT objectId FROM Object WHERE {_BAND['box']}"),
    "angsep_filter": ("SELECT objectId, ROUND(angSep(ra, decl, 200, -30), 6) AS d FROM Object WHERE angSep(ra, decl, 200, -30) < 25.0051", f"SELECT objectId, ROUND({sep('ra', 'decl', '200', '-30')}, 6) AS d FROM Object WHERE {sep('ra', 'decl', '200', '-30')} < 25.0051"),
    "flux_to_mag": ("SELECT objectId, ROUND(fluxToAbMag(flux), 6) AS mag FROM Object WHERE fluxToAbMag(flux) BETWEEN 17 AND 19.5", "SELECT objectId, ROUND(-2.5 * log10(flux) - 48.6, 6) AS mag FROM Object WHERE flux > 0 AND -2.5 * log10(flux) - 48.6 BETWEEN 17 AND 19.5"),
    "null_safe_eq": ("SELECT objectId FROM Object WHERE fluxToAbMag(flux) <=> NULL", "SELECT objectId FROM Object WHERE flux <= 0 OR flux IS NULL"),
    "is_null": ("SELECT COUNT(*) AS n FROM Object WHERE fluxToAbMag(flux) IS NOT NULL AND name IS NOT NULL", "SELECT COUNT(*) AS n FROM Object WHERE flux > 0"),
    "like_not_like": ("SELECT objectId, segment FROM Object WHERE segment LIKE 'B%' AND name NOT LIKE '%7'", "SELECT objectId, segment FROM Object WHERE segment LIKE 'B%' AND name NOT LIKE '%7'"),
    "between_not_between": ("SELECT objectId FROM Object WHERE balance NOT BETWEEN 100.005 AND 9000.005", "SELECT objectId FROM Object WHERE balance NOT BETWEEN 100.005 AND 9000.005"),
    "in_not_in": ("SELECT objectId, fieldId FROM Object WHERE fieldId IN (1, 2, 3) AND segment NOT IN ('BUILDING', 'MACHINERY')", "SELECT objectId, fieldId FROM Object WHERE fieldId IN (1, 2, 3) AND segment NOT IN ('BUILDING', 'MACHINERY')"),
    "and_or_alt": ("SELECT objectId FROM Object WHERE (fieldId = 3 || fieldId = 5) && NOT (balance < 0.005)", "SELECT objectId FROM Object WHERE (fieldId = 3 OR fieldId = 5) AND NOT (balance < 0.005)"),
    "truth_of_value": ("SELECT COUNT(*) AS n FROM Object WHERE fieldId AND objectId % 2", "SELECT COUNT(*) AS n FROM Object WHERE fieldId <> 0 AND objectId % 2 <> 0"),
    "mod_div": ("SELECT objectId, objectId % 7 AS a, objectId MOD 5 AS b, objectId DIV 3 AS c, objectId / 0 AS z FROM Object WHERE objectId % 3 = 1", "SELECT objectId, objectId % 7 AS a, objectId % 5 AS b, objectId // 3 AS c, CAST(NULL AS DOUBLE) AS z FROM Object WHERE objectId % 3 = 1"),
    "bitwise": ("SELECT objectId, objectId & 6 AS a, objectId | 9 AS b, objectId ^ 5 AS c, objectId << 2 AS d, objectId >> 1 AS e FROM Object WHERE objectId & 1 = 1", "SELECT objectId, objectId & 6 AS a, objectId | 9 AS b, xor(objectId, 5) AS c, objectId << 2 AS d, objectId >> 1 AS e FROM Object WHERE (objectId & 1) = 1"),
    "precedence": ("SELECT objectId, 2 ^ 1 + 1 AS a, 1 | 2 + 4 AS b, 6 - 2 * -1 AS c FROM Object WHERE objectId < 3", "SELECT objectId, 4::BIGINT AS a, 7::BIGINT AS b, 8 AS c FROM Object WHERE objectId < 3"),
    "scalar_functions": ("SELECT objectId, UPPER(segment) AS u, LENGTH(name) AS n, CONCAT(name, '-', segment) AS j, LEFT(name, 4) AS l, ABS(balance) AS a, FLOOR(balance) AS f, GREATEST(fieldId, 7) AS g, MD5(name) AS h FROM Object WHERE objectId < 100", "SELECT objectId, UPPER(segment) AS u, strlen(name)::INT AS n, name || '-' || segment AS j, LEFT(name, 4) AS l, ABS(balance) AS a, FLOOR(balance)::BIGINT AS f, GREATEST(fieldId, 7) AS g, MD5(name) AS h FROM Object WHERE objectId < 100"),
    "functions_math": (
        "SELECT objectId, CEIL(balance) AS c, FLOOR(balance) AS f, ROUND(SQRT(ABS(balance)), 6) AS r, SQRT(-1 - ABS(balance)) AS none, SIGN(balance) AS s, GREATEST(fieldId, 7) AS g, LEAST(fieldId, 7, NULL) AS l, ROUND(LN(ABS(balance) + 1), 9) AS ln, ROUND(LOG10(objectId), 9) AS lt, ROUND(POWER(objectId, 0.5), 6) AS p, ROUND(DEGREES(RADIANS(ra)), 6) AS d, ROUND(ATAN2(ra, 10), 9) AS a, CONV(objectId, 10, 16) AS x, BIT_COUNT(objectId) AS b FROM Object",
        "SELECT objectId, ceil(balance)::BIGINT AS c, floor(balance)::BIGINT AS f, round(sqrt(abs(balance)), 6) AS r, CAST(NULL AS DOUBLE) AS none, sign(balance)::DOUBLE AS s, greatest(fieldId, 7) AS g, CAST(NULL AS INT) AS l, round(ln(abs(balance) + 1), 9) AS ln, CASE WHEN objectId > 0 THEN round(log10(objectId), 9) END AS lt, round(pow(objectId, 0.5), 6) AS p, round(degrees(radians(ra)), 6) AS d, round(atan2(ra, 10), 9) AS a, printf('%X', objectId) AS x, bit_count(objectId)::INT AS b FROM Object",
    ),
    "functions_string": (
        "SELECT objectId, LOWER(segment) AS lo, RIGHT(name, 3) AS r, LPAD(segment, 12, '*') AS lp, RPAD(segment, 12, '-') AS rp, REVERSE(name) AS re, LOCATE('#', name) AS lc, INSTR(name, '#') AS i, CONCAT_WS('/', segment, NULL, name) AS cw, SUBSTRING_INDEX(name, '#', 1) AS si, FIELD(segment, 'BUILDING', 'MACHINERY') AS fi, ELT(2, name, segment) AS e, STRCMP(segment, 'FURNITURE') AS sc, HEX(segment) AS h, QUOTE(segment) AS q, FIND_IN_SET(segment, 'AUTOMOBILE,BUILDING') AS fs, EXPORT_SET(5, 'Y', 'N', ',', 4) AS es, MAKE_SET(5, segment, 'b', 'c') AS ms, CHAR_LENGTH(name) AS cl FROM Object",
        "SELECT objectId, lower(segment) AS lo, right(name, 3) AS r, lpad(segment, 12, '*') AS lp, rpad(segment, 12, '-') AS rp, reverse(name) AS re, instr(name, '#')::INT AS lc, instr(name, '#')::INT AS i, concat_ws('/', segment, NULL, name) AS cw, split_part(name, '#', 1) AS si, CASE segment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS fi, segment AS e, CASE WHEN segment < 'FURNITURE' THEN -1 WHEN segment > 'FURNITURE' THEN 1 ELSE 0 END AS sc, hex(segment) AS h, chr(39) || segment || chr(39) AS q, CASE segment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 0 END AS fs, 'Y,N,Y,N' AS es, segment || ',c' AS ms, length(name)::INT AS cl FROM Object",
    ),
    "functions_date": (
        "SELECT sourceId, YEAR(taken) AS y, MONTH(taken) AS m, DAYOFMONTH(taken) AS d, DAYOFWEEK(taken) AS dw, WEEKDAY(taken) AS wd, DAYOFYEAR(taken) AS dy, QUARTER(taken) AS q, TO_DAYS(taken) AS td, WEEK(taken) AS w0, WEEK(taken, 3) AS w3, WEEK(taken, 5) AS w5, WEEKOFYEAR(taken) AS wy, YEARWEEK(taken, 3) AS yw, DATEDIFF(taken, '1995-01-01') AS dd, MONTHNAME(taken) AS mn, DAYNAME(taken) AS dn, UNIX_TIMESTAMP(taken) AS u, TO_SECONDS(taken) AS ts FROM Source",
        "SELECT sourceId, year(taken)::INT AS y, month(taken)::INT AS m, day(taken)::INT AS d, dayofweek(taken)::INT + 1 AS dw, isodow(taken)::INT - 1 AS wd, dayofyear(taken)::INT AS dy, quarter(taken)::INT AS q, datediff('day', DATE '1970-01-01', taken::DATE)::INT + 719528 AS td, strftime(taken, '%U')::INT AS w0, weekofyear(taken)::INT AS w3, strftime(taken, '%W')::INT AS w5, weekofyear(taken)::INT AS wy, (isoyear(taken) * 100 + weekofyear(taken))::INT AS yw, datediff('day', DATE '1995-01-01', taken::DATE)::INT AS dd, monthname(taken) AS mn, dayname(taken) AS dn, epoch(taken)::BIGINT AS u, (datediff('day', DATE '1970-01-01', taken::DATE) + 719528) * 86400 + hour(taken) * 3600 + minute(taken) * 60 + second(taken) AS ts FROM Source",
    ),
    "functions_date_format": (
        "SELECT sourceId, DATE_FORMAT(taken, '%Y-%m-%d %H:%i:%s %j %U %w %W %b %a %y %e') AS f, DATE_FORMAT(taken, '%x week %v, 100%%') AS g, STR_TO_DATE(DATE_FORMAT(taken, '%d.%m.%Y'), '%d.%m.%Y') AS day FROM Source",
        "SELECT sourceId, strftime(taken, '%Y-%m-%d %H:%M:%S %j %U %w %A %b %a %y %-d') AS f, strftime(taken, '%G week %V, 100%%') AS g, date_trunc('day', taken)::TIMESTAMP AS day FROM Source",
    ),
    "functions_hash": (
        "SELECT objectId, MD5(name) AS m, SHA1(name) AS s, SHA2(name, 256) AS t, TO_BASE64(name) AS b FROM Object WHERE FROM_BASE64(TO_BASE64(name)) = name AND MD5(name) < 'c'",
        "SELECT objectId, md5(name) AS m, sha1(name) AS s, sha256(name) AS t, to_base64(name::BLOB) AS b FROM Object WHERE md5(name) < 'c'",
    ),
    "functions_network": (
        "SELECT objectId, INET_ATON(CONCAT('10.0.', fieldId, '.7')) AS n, INET_NTOA(167772160 + objectId) AS a, IS_IPV4(CONCAT('10.0.', objectId, '.7')) AS v FROM Object",
        "SELECT objectId, (10 * 16777216 + fieldId * 256 + 7)::BIGINT AS n, '10.' || (objectId // 65536) || '.' || (objectId // 256) % 256 || '.' || objectId % 256 AS a, (objectId < 256)::INT AS v FROM Object",
    ),
    "functions_null": (
        "SELECT objectId, IFNULL(SIGN(fluxToAbMag(flux)), -1) AS bright, NULLIF(fieldId, 3) AS n, ISNULL(fluxToAbMag(flux)) AS i, COALESCE(NULLIF(fieldId, 3), -3) AS c FROM Object",
        "SELECT objectId, CASE WHEN flux > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS bright, nullif(fieldId, 3) AS n, (NOT flux > 0)::INT AS i, CASE fieldId WHEN 3 THEN -3 ELSE fieldId END AS c FROM Object",
    ),
    "separation_test": ("SELECT objectId FROM Object WHERE spDist(ra, decl, 200, -30, 25.0051)", f"SELECT objectId FROM Object WHERE {sep('ra', 'decl', '200', '-30')} < 25.0051"),
    "polygon_value": ("SELECT objectId FROM Object WHERE s2PtInCPoly(ra, decl, s2CPolyToBin(0.005, 0.003, 90.005, 0.003, 45.005, 85.003)) = 1", None),
    "join_order": ("SELECT o.objectId, r.refId, f.fieldName FROM Object o, Ref r, Field f WHERE o.fieldId = f.fieldId AND r.fieldId = f.fieldId AND o.balance > 9000.005 AND r.balance > 5000.005", "SELECT o.objectId, r.refId, f.fieldName FROM Object o, Ref r, Field f WHERE o.fieldId = f.fieldId AND r.fieldId = f.fieldId AND o.balance > 9000.005 AND r.balance > 5000.005"),
    "alias": ("SELECT objectId AS id, ra * 2 AS twice, segment seg FROM Object WHERE objectId < 20 ORDER BY id DESC", "SELECT objectId AS id, ra * 2 AS twice, segment AS seg FROM Object WHERE objectId < 20"),
    "count_star": ("SELECT COUNT(*) AS n FROM Source", "SELECT COUNT(*) AS n FROM Source"),
    "sum_min_max_avg": ("SELECT COUNT(price) AS n, ROUND(SUM(price), 2) AS total, MIN(price) AS low, MAX(price) AS high, ROUND(AVG(price), 4) AS mean FROM Source", "SELECT COUNT(price) AS n, ROUND(SUM(price), 2) AS total, MIN(price) AS low, MAX(price) AS high, ROUND(AVG(price), 4) AS mean FROM Source"),
    "agg_expr": ("SELECT status, MAX(price) - MIN(price) AS spread, SUM(sourceId) + 1 AS s FROM Source GROUP BY status", "SELECT status, MAX(price) - MIN(price) AS spread, (SUM(sourceId) + 1)::BIGINT AS s FROM Source GROUP BY status"),
    "group_by": ("SELECT fieldId, COUNT(*) AS n, MAX(balance) AS most FROM Object GROUP BY fieldId", "SELECT fieldId, COUNT(*) AS n, MAX(balance) AS most FROM Object GROUP BY fieldId"),
    "group_by_two": ("SELECT fieldId, segment FROM Object GROUP BY fieldId, segment", "SELECT DISTINCT fieldId, segment FROM Object"),
    "group_by_expr": ("SELECT objectId % 10 AS digit, COUNT(*) AS n FROM Object GROUP BY digit ORDER BY digit", "SELECT objectId % 10 AS digit, COUNT(*) AS n FROM Object GROUP BY objectId % 10"),
    "having_expr": ("SELECT objectId, MAX(price) - MIN(price) AS spread FROM Source GROUP BY objectId HAVING MAX(price) - MIN(price) > 200000.005", "SELECT objectId, MAX(price) - MIN(price) AS spread FROM Source GROUP BY objectId HAVING MAX(price) - MIN(price) > 200000.005"),
    "having_alias": ("SELECT objectId, COUNT(*) AS n FROM Source GROUP BY objectId HAVING n > 12", "SELECT objectId, COUNT(*) AS n FROM Source GROUP BY objectId HAVING COUNT(*) > 12"),
    "distinct": ("SELECT DISTINCT segment, fieldId FROM Object WHERE balance > 0.005", "SELECT DISTINCT segment, fieldId FROM Object WHERE balance > 0.005"),
    "order_limit": ("SELECT sourceId, price FROM Source ORDER BY sourceId LIMIT 25", "SELECT sourceId, price FROM Source ORDER BY sourceId LIMIT 25"),
    "topk": ("SELECT sourceId, price FROM Source ORDER BY price DESC, sourceId LIMIT 10", "SELECT sourceId, price FROM Source ORDER BY price DESC, sourceId LIMIT 10"),
    "topk_group": ("SELECT objectId, COUNT(*) AS n FROM Source GROUP BY objectId ORDER BY n DESC, objectId LIMIT 10", "SELECT objectId, COUNT(*) AS n FROM Source GROUP BY objectId ORDER BY n DESC, objectId LIMIT 10"),
    "join_using": ("SELECT o.objectId, s.sourceId FROM Object o JOIN Source s USING (objectId) WHERE o.balance > 9000.005", "SELECT o.objectId, s.sourceId FROM Object o JOIN Source s USING (objectId) WHERE o.balance > 9000.005"),
    "join_on": ("SELECT o.name, s.price FROM Object o INNER JOIN Source s ON o.objectId = s.objectId AND s.status = 'P'", "SELECT o.name, s.price FROM Object o JOIN Source s ON o.objectId = s.objectId AND s.status = 'P'"),
    "join_comma": ("SELECT o.objectId, s.sourceId FROM Object o, Source s WHERE o.objectId = s.objectId AND o.fieldId = 4", "SELECT o.objectId, s.sourceId FROM Object o, Source s WHERE o.objectId = s.objectId AND o.fieldId = 4"),
    "natural_join": ("SELECT objectId, fieldName FROM Object NATURAL JOIN Field WHERE objectId < 200", "SELECT objectId, fieldName FROM Object NATURAL JOIN Field WHERE objectId < 200"),
    "natural_left_join": ("SELECT objectId, fieldName FROM Object NATURAL LEFT JOIN Field WHERE objectId < 200", "SELECT objectId, fieldName FROM Object NATURAL LEFT JOIN Field WHERE objectId < 200"),
    "left_join": ("SELECT o.objectId, s.sourceId FROM Object o LEFT JOIN Source s ON o.objectId = s.objectId AND s.price > 300000.005 WHERE o.objectId < 300", "SELECT o.objectId, s.sourceId FROM Object o LEFT JOIN Source s ON o.objectId = s.objectId AND s.price > 300000.005 WHERE o.objectId < 300"),
    "cross_join": ("SELECT COUNT(*) AS n FROM Field f CROSS JOIN Field g WHERE f.zone = g.zone", "SELECT COUNT(*) AS n FROM Field f CROSS JOIN Field g WHERE f.zone = g.zone"),
    "join_replicated": ("SELECT f.fieldName, COUNT(*) AS n FROM Object o, Field f WHERE o.fieldId = f.fieldId GROUP BY f.fieldName", "SELECT f.fieldName, COUNT(*) AS n FROM Object o, Field f WHERE o.fieldId = f.fieldId GROUP BY f.fieldName"),
    "join_child_child": ("SELECT a.sourceId AS s1, b.sourceId AS s2 FROM Source a, Source b WHERE a.objectId = b.objectId AND a.sourceId < b.sourceId AND a.price > 350000.005", "SELECT a.sourceId AS s1, b.sourceId AS s2 FROM Source a, Source b WHERE a.objectId = b.objectId AND a.sourceId < b.sourceId AND a.price > 350000.005"),
    "join_residual_range": ("SELECT o.objectId, s.sourceId FROM Object o JOIN Source s USING (objectId) WHERE o.balance BETWEEN s.price / 20 - 300 AND s.price / 20 + 300", "SELECT o.objectId, s.sourceId FROM Object o JOIN Source s USING (objectId) WHERE o.balance BETWEEN s.price / 20 - 300 AND s.price / 20 + 300"),
    "column_disambiguation": ("SELECT o.balance AS a, r.balance AS b FROM Object o, Ref r WHERE o.fieldId = r.fieldId AND refId < 5 AND o.objectId < 100", "SELECT o.balance AS a, r.balance AS b FROM Object o, Ref r WHERE o.fieldId = r.fieldId AND refId < 5 AND o.objectId < 100"),
    "near_neighbour": ("SELECT a.objectId AS id1, b.objectId AS id2 FROM Object a, Object b WHERE angSep(a.ra, a.decl, b.ra, b.decl) < 1.50003 AND a.objectId <> b.objectId", f"SELECT a.objectId AS id1, b.objectId AS id2 FROM Object a, Object b WHERE abs(a.decl - b.decl) < 1.51 AND {sep('a.ra', 'a.decl', 'b.ra', 'b.decl')} < 1.50003 AND a.objectId <> b.objectId"),
    "near_neighbour_box": ("SELECT a.objectId AS id1, b.objectId AS id2 FROM Object a, Object b WHERE areaspec_box(200.005, -88.005, 160.005, 88.005) AND angSep(a.ra, a.decl, b.ra, b.decl) < 1.50003 AND a.objectId <> b.objectId", f"SELECT a.objectId AS id1, b.objectId AS id2 FROM Object a, Object b WHERE abs(a.decl - b.decl) < 1.51 AND {sep('a.ra', 'a.decl', 'b.ra', 'b.decl')} < 1.50003 AND a.objectId <> b.objectId AND (a.ra >= 200.005 OR a.ra <= 160.005) AND a.decl BETWEEN -88.005 AND 88.005 AND (b.ra >= 200.005 OR b.ra <= 160.005) AND b.decl BETWEEN -88.005 AND 88.005"),
    "near_neighbour_two": ("SELECT o.objectId, r.refId FROM Object o, Ref r WHERE angSep(o.ra, o.decl, r.ra, r.decl) <= 1.80003", f"SELECT o.objectId, r.refId FROM Object o, Ref r WHERE abs(o.decl - r.decl) < 1.81 AND {sep('o.ra', 'o.decl', 'r.ra', 'r.decl')} <= 1.80003"),
    "near_neighbour_chain": ("SELECT a.objectId AS id1, b.objectId AS id2, r.refId FROM Object a, Object b, Ref r WHERE angSep(a.ra, a.decl, b.ra, b.decl) < 1.90003 AND angSep(b.ra, b.decl, r.ra, r.decl) < 1.90003 AND a.objectId <> b.objectId", f"SELECT a.objectId AS id1, b.objectId AS id2, r.refId FROM Object b JOIN Ref r ON abs(b.decl - r.decl) < 1.91 AND {sep('b.ra', 'b.decl', 'r.ra', 'r.decl')} < 1.90003 JOIN Object a ON abs(a.decl - b.decl) < 1.91 AND {sep('a.ra', 'a.decl', 'b.ra', 'b.decl')} < 1.90003 AND a.objectId <> b.objectId"),
    "match_scan_dedup": ("SELECT objectId, refId FROM RefMatch", "SELECT objectId, refId FROM RefMatch WHERE flags <> 2", _strips(), _MATCHES),
    "match_join": ("SELECT o.objectId, r.refId, m.flags FROM Object o, RefMatch m, Ref r WHERE o.objectId = m.objectId AND m.refId = r.refId AND o.balance > 0.005", "SELECT o.objectId, r.refId, m.flags FROM Object o JOIN RefMatch m ON o.objectId = m.objectId JOIN Ref r ON m.refId = r.refId WHERE o.balance > 0.005", _strips(), _MATCHES),
    "chunk_group_count": ("SELECT chunkId, COUNT(*) AS n FROM Object GROUP BY chunkId", f"SELECT chunkId, COUNT(*) AS n FROM {_located('Object', 'ra', 'decl')} GROUP BY chunkId", _strips()),
    "default_names": ("SELECT objectId, ra * 2, fieldId + 1 FROM Object WHERE objectId < 50", "SELECT objectId, ra * 2 AS \"ra * 2\", fieldId + 1 AS \"fieldId + 1\" FROM Object WHERE objectId < 50"),
    "self_join": ("SELECT a.objectId AS id, b.segment AS segment FROM Object a, Object b WHERE a.objectId = b.objectId AND a.balance > 5000.005", "SELECT a.objectId AS id, b.segment AS segment FROM Object a, Object b WHERE a.objectId = b.objectId AND a.balance > 5000.005"),
    "left_join_partitioned": ("SELECT f.fieldName, o.objectId FROM Field f LEFT JOIN Object o ON f.fieldId = o.fieldId AND o.balance > 9500.005", "SELECT f.fieldName, o.objectId FROM Field f LEFT JOIN Object o ON f.fieldId = o.fieldId AND o.balance > 9500.005"),
    "right_join_replicated": ("SELECT o.objectId, f.fieldName FROM Object o RIGHT JOIN Field f ON f.fieldId = o.fieldId AND o.balance > 9500.005", "SELECT o.objectId, f.fieldName FROM Object o RIGHT JOIN Field f ON f.fieldId = o.fieldId AND o.balance > 9500.005"),
    "aggregate_plus": ("SELECT SUM(sourceId) + 1 AS s, COUNT(*) * 2 AS n, MAX(price) DIV 1000 AS k FROM Source", "SELECT (SUM(sourceId) + 1)::BIGINT AS s, COUNT(*) * 2 AS n, floor(MAX(price) / 1000)::BIGINT AS k FROM Source"),
    "key_range": ("SELECT objectId FROM Object WHERE objectId > 20 AND objectId <= 40 AND objectId <> 30", "SELECT objectId FROM Object WHERE objectId > 20 AND objectId <= 40 AND objectId <> 30"),
    "two_regions": ("SELECT objectId FROM Object WHERE s2PtInBox(ra, decl, 10.005, -20.005, 60.005, 30.005) = 1 AND s2PtInCircle(ra, decl, 30, 10, 20.0051) = 1", f"SELECT objectId FROM Object WHERE {_BAND['box']} AND {sep('ra', 'decl', '30', '10')} <= 20.0051"),
    "magnitudes": ("SELECT objectId, ROUND(abMagToFlux(fluxToAbMag(flux)) / flux, 9) AS one, ROUND(nanojanskyToAbMag(balance), 6) AS m, ROUND(fluxToAbMagSigma(flux, flux / 10), 9) AS s FROM Object WHERE flux > 0", "SELECT objectId, 1.0::DOUBLE AS one, round(31.4 - 2.5 * log10(balance), 6) AS m, round(0.1 * 2.5 / ln(10), 9) AS s FROM Object WHERE flux > 0"),
    "constant_select": ("SELECT 1 + 1 AS two, 'x' AS x", "SELECT 2 AS two, 'x' AS x"),
}


def _statement(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: catalog(spark, sf_dir).sql(text)


# ---------------------------------------------------------------- operators beside the dialect


def chunk_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.locate(derived(spark, sf_dir, "Object"), _CHUNKER, "ra", "decl").select("objectId", "chunkId", "subChunkId")


def overlap_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_overlap(derived(spark, sf_dir, "Object").select("objectId", "ra", "decl"), _CHUNKER, "ra", "decl").select("objectId", "chunkId", "subChunkId", "overlap")


def partition_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).select("objectId", "refId", "flags", "chunkId")


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chunk_summary(P.chunk_stats(chunk_with_keys(spark, sf_dir))).select("n", "smallest", "largest")


def chunk_with_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.locate(derived(spark, sf_dir, "Object"), _CHUNKER, "ra", "decl")


def partition_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = P.object_index(chunk_with_keys(spark, sf_dir), "objectId")
    return P.by_index(derived(spark, sf_dir, "Source"), "objectId", index).select("sourceId", "chunkId", "subChunkId")


def htm_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level-0 triangles, which SQL can name by the octant."""
    return derived(spark, sf_dir, "Object").select("objectId", S.htm_id(F.col("ra"), F.col("decl"), 0).alias("htm"))


def htm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.htm_index(derived(spark, sf_dir, "Object"), "ra", "decl", 8)


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.layout(spark, _CHUNKER)


_BOX = (0.0, -10.0, 90.0, 10.0)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def sub_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the sub-chunks: number, extremes, mean, deviation, quartiles."""
    out = P.chunk_summary(P.chunk_stats(chunk_with_keys(spark, sf_dir), by_sub_chunk=True))
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "deviation", "quartile1", "median", "quartile3")})


def chunk_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of each chunk, and its bounds with the overlap around it."""
    rows = []
    for c in _CHUNKER.all_chunks:
        box = SphericalBox(*_CHUNKER.chunk_bounds(c))
        rows.append((c, round(box.area, 9), *(round(x, 9) for x in box.expand(_CHUNKER.overlap).bounds)))
    return spark.createDataFrame(rows, "chunkId int, area double, lon_min double, lat_min double, lon_max double, lat_max double")


def duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = derived(spark, sf_dir, "Object").select("objectId", "ra", "decl", "segment")
    ranks = D.key_ranks(o, "objectId", "ra", "decl", 3)
    return _rounded(D.duplicate(o, "objectId", "ra", "decl", ranks, 3, _BOX), "ra", "decl")


def duplicate_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the copies, chosen by a seeded hash of their keys."""
    o = derived(spark, sf_dir, "Object").select("objectId", "ra", "decl", "segment")
    ranks = D.key_ranks(o, "objectId", "ra", "decl", 3)
    return _rounded(D.duplicate(o, "objectId", "ra", "decl", ranks, 3, _BOX, fraction=1 / 3, seed=17), "ra", "decl")


def duplicate_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children copied with their directors: both keys are made anew."""
    o, s = derived(spark, sf_dir, "Object"), derived(spark, sf_dir, "Source").select("sourceId", "objectId", "sra", "sdecl", "price")
    ranks = D.key_ranks(o, "objectId", "ra", "decl", 3)
    own = D.child_ranks(s, "sourceId", "objectId", ranks)
    return _rounded(D.duplicate(s, "objectId", "sra", "sdecl", ranks, 3, _BOX, "sourceId", own), "sra", "sdecl")


def duplicate_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = derived(spark, sf_dir, "Object").select("objectId", "ra", "decl")
    return D.shift(o, ["objectId"], "ra", 30.25, 1_000_000).withColumn("ra", F.round("ra", 6))


def duplicate_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = derived(spark, sf_dir, "Object")
    return D.estimate(D.key_ranks(o, "objectId", "ra", "decl", 3), _CHUNKER, 3, _BOX)


def async_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = catalog(spark, sf_dir)
    job = engine.submit("SELECT segment, COUNT(*) AS n FROM Object GROUP BY segment")
    engine.manager.wait(job)
    return engine.sql(f"SELECT * FROM result({job})")


def processlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = catalog(spark, sf_dir)
    engine.manager.wait(engine.submit("SELECT COUNT(*) AS n FROM Field"))
    return engine.sql("SELECT COUNT(*) AS n FROM information_schema.processlist")


def query_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = catalog(spark, sf_dir)
    engine.manager.wait(engine.submit("SELECT COUNT(*) AS n FROM Field"))
    return engine.sql("SELECT ID, STATE, ROWS FROM information_schema.queries")


def show_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).sql("SHOW COLUMNS FROM Field WHERE Field NOT IN ('zone')").select("Field", "Type")


def stored(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with the director and its child stored by chunk, in a folder of its own."""
    engine = Engine(spark, scratch(spark, "stored"), "sky")
    engine.catalog.create_database("sky", STRIPING)
    for spec in _SPECS[:2]:
        engine.ingest.load("sky", spec, derived(spark, sf_dir, spec.name))
    return engine


def ingest_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region of a table stored by chunk: the chunk list is a partition filter."""
    return stored(spark, sf_dir).sql("SELECT objectId, chunkId FROM Object WHERE areaspec_circle(30, 10, 40.0051)")


def director_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of some keys: the index names their chunks."""
    engine = stored(spark, sf_dir)
    engine.ingest.build_director_index("sky", "Object")
    return engine.sql("SELECT objectId, sourceId, price FROM Source WHERE objectId IN (1, 17, 42, 100)")


def row_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = stored(spark, sf_dir)
    engine.ingest.collect_row_counters("sky", "Source")
    return engine.sql("SELECT COUNT(*) AS n FROM Source")


def transaction_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an aborted transaction are gone, those of a committed one stay."""
    engine = stored(spark, sf_dir)
    for end, offset in ((engine.ingest.abort, 10_000_000), (engine.ingest.commit, 20_000_000)):
        t = engine.ingest.begin("sky")
        engine.ingest.append("sky", "Object", derived(spark, sf_dir, "Object").where("objectId < 10").withColumn("objectId", F.col("objectId") + offset), t)
        end(t)
    return engine.sql("SELECT objectId FROM Object WHERE objectId >= 10000000")


def transaction_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second session over the same warehouse aborts a transaction of its own, and leaves one open: the rows that the first committed are there, and no others."""
    first = stored(spark, sf_dir)
    meta = f"{first.ingest.warehouse}/_meta"
    first.catalog.save(meta)
    second = Engine(spark, first.ingest.warehouse, "sky")
    second.catalog.open(meta)
    rows = derived(spark, sf_dir, "Object").where("objectId < 10").withColumn("objectId", F.col("objectId") + 10_000_000)
    aborted, open_ = second.ingest.begin("sky"), second.ingest.begin("sky")
    for t in (aborted, open_):
        second.ingest.append("sky", "Object", rows, t)
    second.ingest.abort(aborted)
    return second.sql("SELECT objectId, segment FROM Object")


def child_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children far from their directors: the index of directors finds them, and so does a region by their own positions."""
    engine = stored(spark, sf_dir)
    far = derived(spark, sf_dir, "Source").withColumn("sra", (F.col("sra") + 50) % 360).withColumn("sdecl", -F.col("sdecl"))
    engine.ingest.load("sky", TableSpec("Far", CHILD, "objectId", "sra", "sdecl", director="Object"), far)
    by_key = engine.sql("SELECT 'key' AS by_what, sourceId FROM Far WHERE objectId IN (1, 17, 42, 100)")
    return by_key.union(engine.sql("SELECT 'region' AS by_what, sourceId FROM Far WHERE areaspec_circle(80, 10, 20.0051)"))


def queries_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that ran on the caller's thread are registered with how they ended."""
    engine = catalog(spark, sf_dir)
    engine.execute("SELECT segment, COUNT(*) AS n FROM Object GROUP BY segment")
    engine.limit_bytes = engine.manager.limit_bytes = 100
    for bad in ("SELECT nope FROM Object", "SELECT objectId, name FROM Object"):
        try:
            engine.execute(bad)
        except EngineError:
            pass
    return engine.sql("SELECT ID, TYPE, STATE, ROWS FROM information_schema.queries")


def region_and_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region and keys together: the chunks of both lists."""
    return stored(spark, sf_dir).sql("SELECT objectId, ra FROM Object WHERE areaspec_box(10.005, -60.005, 200.005, 60.005) AND objectId IN (1, 5, 17, 42, 77, 100)")


def generated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is dropped and filled again, with a column made at ingest."""
    engine = Engine(spark, scratch(spark, "generated"), "sky")
    engine.catalog.create_database("sky", STRIPING)
    engine.ingest.load("sky", TableSpec("Plain"), derived(spark, sf_dir, "Field"))
    engine.ingest.drop("sky", "Plain")
    engine.ingest.load("sky", TableSpec("Plain"), derived(spark, sf_dir, "Field"), {"label": "concat(fieldName, '/', zone)"})
    return engine.sql("SELECT fieldId, label FROM Plain")


def contribution_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contribution that fails and is run again, and one that ends at once."""
    engine = Engine(spark, scratch(spark, "contributions"), "sky")
    engine.catalog.create_database("sky", STRIPING)
    engine.ingest.create("sky", TableSpec("Plain"))
    t, sources = engine.ingest.begin("sky"), [f"{sf_dir}/nothing.parquet", f"{sf_dir}/region.parquet"]
    late = engine.ingest.contribute("sky", "Plain", lambda: spark.read.parquet(sources[0]), t)
    engine.ingest.contribute("sky", "Plain", lambda: spark.read.parquet(sources[1]), t)
    before = engine.ingest.status().select("state")
    sources[0] = f"{sf_dir}/region.parquet"
    engine.ingest.retry(late.id)
    engine.ingest.commit(t)
    return before.groupBy("state").count().union(engine.sql("SELECT 'rows' AS state, COUNT(*) AS count FROM Plain"))


def cancelled_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A background query that ended, its result deleted, and one that was stopped."""
    engine = catalog(spark, sf_dir)
    ended = engine.submit("SELECT COUNT(*) AS n FROM Field")
    engine.manager.wait(ended)
    engine.sql(f"CALL result_delete({ended})")
    stopped = engine.submit("SELECT COUNT(*) AS n FROM Source a, Source b, Source c WHERE a.price + b.price + c.price > 3")
    engine.sql(f"KILL QUERY {stopped}")
    engine.manager.wait(stopped, 120)
    return engine.sql("SELECT ID, STATE FROM information_schema.queries")


def parquet_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen columns in an order of their own, one of them missing in the files."""
    return readers.read_parquet(spark, f"{sf_dir}/nation.parquet", ["n_name", "motto", "n_nationkey"], {"motto": "varchar(9)"})


def rows_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of values with a declared schema."""
    schema = readers.schema([{"name": "id", "type": "bigint not null"}, {"name": "x", "type": "double"}, {"name": "s", "type": "varchar(9)"}, {"name": "day", "type": "date"}])
    return readers.from_rows(spark, [[1, "2.5", "a", "2024-03-05"], ["2", None, None, None]], schema)


def parquet_to_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet files by way of CSV files."""
    path = scratch(spark, "csv")
    readers.parquet_to_csv(spark, f"{sf_dir}/nation.parquet", path, ["n_nationkey", "n_name"])
    schema = readers.schema([{"name": "n_nationkey", "type": "int"}, {"name": "n_name", "type": "varchar(25)"}])
    return readers.read_csv(spark, path, schema, readers.CsvDialect(",", '"'))


def sub_chunk_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-chunks of each stripe of chunks, and the sphere's area that they cover."""
    area = (F.col("lon_max") - F.col("lon_min")) * F.degrees(F.sin(F.radians("lat_max")) - F.sin(F.radians("lat_min")))
    return P.layout(spark, _CHUNKER, by_sub_chunk=True).groupBy(F.floor(F.col("chunkId") / (2 * STRIPING.stripes)).alias("stripe")).agg(F.count("*").alias("n"), F.round(F.sum(area), 6).alias("area"))


def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by way of tab-separated files."""
    path = scratch(spark, "csv")
    readers.write_csv(derived(spark, sf_dir, "Field"), path, readers.CsvDialect())
    schema = readers.schema([{"name": "fieldId", "type": "int(11)"}, {"name": "fieldName", "type": "varchar(25)"}, {"name": "zone", "type": "int"}])
    return readers.read_csv(spark, path, schema)


def streaming_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of rows, appended batch by batch."""
    engine = Engine(spark, scratch(spark, "stream"), "sky")
    engine.catalog.create_database("sky", STRIPING)
    engine.ingest.create("sky", _SPECS[0])
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/customer.parquet").schema).option("pathGlobFilter", "customer.parquet").parquet(sf_dir)
    stream_into(source.selectExpr(*_split(TABLES["Object"][1])), engine.ingest, "sky", "Object", f"{engine.ingest.warehouse}/_checkpoint").awaitTermination()
    return engine.sql("SELECT segment, COUNT(*) AS n FROM Object GROUP BY segment")


OPERATORS = {f.__name__: f for f in (ingest_chunked, director_index_lookup, row_counters, transaction_abort, csv_source, streaming_ingest, chunk_locate, overlap_explode, partition_matches, chunk_stats, partition_by_index, htm_id, htm_index, layout, duplicate, duplicate_sample, duplicate_child, duplicate_shift, duplicate_estimate, sub_chunk_stats, chunk_boxes, transaction_reopen, child_placement, queries_at_once, region_and_index, generated_columns, contribution_states, cancelled_query, parquet_source, rows_source, parquet_to_csv, sub_chunk_layout, async_result, processlist, query_history, show_columns)}

_LOC = _located("Object", "ra", "decl")


def _poly() -> str:
    """DuckDB SQL of the polygon query: three half spaces."""
    corners = [(0.005, 0.003), (90.005, 0.003), (45.005, 85.003)]
    v = [S._vec(*c) for c in corners]
    tests = []
    for a, b in zip(v, v[1:] + v[:1], strict=True):
        n = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
        tests.append(f"cos(radians(decl)) * cos(radians(ra)) * {n[0]!r} + cos(radians(decl)) * sin(radians(ra)) * {n[1]!r} + sin(radians(decl)) * {n[2]!r} >= -1e-15")
    return f"SELECT objectId FROM Object WHERE {' AND '.join(tests)}"


def _overlap() -> str:
    """DuckDB SQL of home and overlap cells, by a join with all sub-chunks near each row."""
    c = _CHUNKER
    last = c.stripes * c.sub_stripes - 1
    ids = f"CAST({2 * c.stripes} * (ss // {c.sub_stripes}) + k // n AS INT) AS chunkId, CAST({c.most} * (ss % {c.sub_stripes}) + k % n AS INT) AS subChunkId"
    return f"""SELECT DISTINCT objectId, {ids}, NOT (ss = home AND k = least(CAST(floor(ra / w) AS BIGINT), total - 1)) AS overlap FROM (
        SELECT objectId, ra, home, ss, w, n, total, unnest(list_transform(range(CAST(floor((ra - alpha) / w) AS BIGINT), least(CAST(floor((ra + alpha) / w) AS BIGINT), CAST(floor((ra - alpha) / w) AS BIGINT) + total - 1) + 1), lambda j: ((j % total) + total) % total)) AS k
        FROM (SELECT objectId, ra, decl, least(CAST(floor((decl + 90) / {c.sub_height!r}::DOUBLE) AS INT), {last}) AS home FROM Object) JOIN strips
        ON ss BETWEEN home - 1 AND home + 1 AND decl >= -90 + ss * {c.sub_height!r}::DOUBLE - {c.overlap!r} AND decl <= -90 + (ss + 1) * {c.sub_height!r}::DOUBLE + {c.overlap!r})"""


def _mid(a: str, b: str) -> str:
    """DuckDB SQL of the unit vector halfway between two."""
    s = [f"({a}[{k}] + {b}[{k}])" for k in (1, 2, 3)]
    size = f"sqrt({' + '.join(f'{x} * {x}' for x in s)})"
    return f"[{', '.join(f'{x} / {size}' for x in s)}]"


def _above(p: str, a: str, b: str) -> str:
    return f"{p}[1] * ({a}[2] * {b}[3] - {a}[3] * {b}[2]) + {p}[2] * ({a}[3] * {b}[1] - {a}[1] * {b}[3]) + {p}[3] * ({a}[1] * {b}[2] - {a}[2] * {b}[1])"


_ROOTS = "roots(root, a, b, c) AS (VALUES " + ", ".join(f"({k}, {', '.join(str([float(x) for x in v]) + '::DOUBLE[]' for v in t)})" for k, t in S.HTM_ROOTS.items()) + ")"
_MIDS = f"{_mid('b', 'c')} AS u, {_mid('c', 'a')} AS v, {_mid('a', 'b')} AS w"
_CORNERS = [("a", "w", "v"), ("b", "u", "w"), ("c", "v", "u"), ("u", "v", "w")]


def _htm(level: int) -> tuple[str, str]:
    """DuckDB SQL: htm(objectId, id), the triangles of the objects."""
    point = "[cos(radians(decl)) * cos(radians(ra)), cos(radians(decl)) * sin(radians(ra)), sin(radians(decl))]"
    root = "CASE WHEN p[3] < 0 THEN 8 + CASE WHEN p[2] >= 0 THEN CASE WHEN p[1] >= 0 THEN 0 ELSE 1 END ELSE CASE WHEN p[1] >= 0 THEN 3 ELSE 2 END END ELSE CASE WHEN p[2] >= 0 THEN CASE WHEN p[1] >= 0 THEN 15 ELSE 14 END ELSE CASE WHEN p[1] >= 0 THEN 12 ELSE 13 END END END"
    pick = f"CASE WHEN {_above('p', 'w', 'v')} >= 0 THEN 0 WHEN {_above('p', 'u', 'w')} >= 0 THEN 1 WHEN {_above('p', 'v', 'u')} >= 0 THEN 2 ELSE 3 END"
    corner = lambda i: "CASE k " + " ".join(f"WHEN {k} THEN {t[i]}" for k, t in enumerate(_CORNERS)) + " END"
    down = f"""descent(objectId, p, level, id, a, b, c) AS (
        SELECT objectId, p, 0, CAST(root AS BIGINT), a, b, c FROM (SELECT objectId, {point} AS p FROM Object) JOIN roots ON root = {root}
        UNION ALL SELECT objectId, p, level + 1, id * 4 + k, {corner(0)}, {corner(1)}, {corner(2)}
        FROM (SELECT *, {pick} AS k FROM (SELECT *, {_MIDS} FROM descent WHERE level < {level})))"""
    return _ROOTS, f"{down}, htm AS (SELECT objectId, id FROM descent WHERE level = {level})"


def _copies() -> tuple[str, ...]:
    """DuckDB SQL: ranks of keys in their triangles, and moves(s, t) with the corners of both."""
    targets = ", ".join(f"({t}, {(t * D._MIX) & (1 << 64) - 1}::UHUGEINT)" for t in D.triangles(3, _BOX))
    mesh = f"""mesh(level, id, a, b, c) AS (SELECT 0, CAST(root AS BIGINT), a, b, c FROM roots
        UNION ALL SELECT level + 1, id * 4 + k, CASE k {' '.join(f'WHEN {k} THEN {t[0]}' for k, t in enumerate(_CORNERS))} END, CASE k {' '.join(f'WHEN {k} THEN {t[1]}' for k, t in enumerate(_CORNERS))} END, CASE k {' '.join(f'WHEN {k} THEN {t[2]}' for k, t in enumerate(_CORNERS))} END
        FROM (SELECT *, {_MIDS}, unnest([0, 1, 2, 3]) AS k FROM mesh WHERE level < 3))"""
    return (
        *_htm(3), mesh, "ranks AS (SELECT objectId, id AS source, row_number() OVER (PARTITION BY id ORDER BY objectId) - 1 AS rank FROM htm)", "filled AS (SELECT list_sort(list(DISTINCT source)) AS f FROM ranks)",
        f"targets(t, pick) AS (VALUES {targets})", "chosen AS (SELECT t, CASE WHEN list_contains(f, t) THEN t ELSE f[CAST(pick % CAST(len(f) AS UHUGEINT) AS BIGINT) + 1] END AS s FROM targets, filled)",
        "moves AS (SELECT s, t, x.a AS a, x.b AS b, x.c AS c, y.a AS d, y.b AS e, y.c AS g FROM chosen JOIN mesh x ON x.id = s AND x.level = 3 JOIN mesh y ON y.id = t AND y.level = 3)",
    )


def _copied(lon: str, lat: str, columns: str, source: str) -> str:
    """DuckDB SQL: the rows of a source (with rank and triangle s) in their new places."""
    point = f"[cos(radians({lat})) * cos(radians({lon})), cos(radians({lat})) * sin(radians({lon})), sin(radians({lat}))]"
    det = _above("a", "b", "c")
    share = [f"({_above('p', x, y)}) / ({det})" for x, y in (("b", "c"), ("c", "a"), ("a", "b"))]
    q = [f"i * d[{k}] + j * e[{k}] + l * g[{k}]" for k in (1, 2, 3)]
    around = "degrees(atan2(y, x))"
    return f"""SELECT {columns}, round(CASE WHEN {around} < 0 THEN {around} + 360 ELSE {around} END, 6) AS {lon}, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS {lat} FROM (
        SELECT * EXCLUDE ({lon}, {lat}), {q[0]} AS x, {q[1]} AS y, {q[2]} AS z FROM (SELECT *, {share[0]} AS i, {share[1]} AS j, {share[2]} AS l FROM (SELECT *, {point} AS p FROM {source} JOIN moves ON s = source)))"""


def _spot(t: int) -> int:
    """Chunk of the centre of a triangle."""
    x, y, z = D.corners(t).sum(0)
    lon, lat = math.degrees(math.atan2(y, x)) % 360, math.degrees(math.atan2(z, math.hypot(x, y)))
    return _CHUNKER.locate(lon, lat)[0]


_KEY = "t * 4294967296 + rank"
_DUPLICATED = _copied("ra", "decl", f"{_KEY} AS objectId, segment", "(SELECT Object.*, source, rank FROM Object JOIN ranks USING (objectId))")
ORACLE = {name: duck(s[1] if name != "areaspec_ellipse" else s[1].replace("FROM Object", "FROM Object, foc"), *s[2:]) for name, s in STATEMENTS.items() if s[1]}
ORACLE |= {
    "polygon_value": duck(_poly()),
    "htm_index": duck("SELECT id AS htm_id, COUNT(*) AS n_rows FROM htm GROUP BY id", *_htm(8)),
    "duplicate": duck(_DUPLICATED, *_copies()),
    "duplicate_sample": duck(f"SELECT * FROM ({_DUPLICATED}) WHERE CAST('0x' || substr(md5('17:' || objectId), 1, 8) AS BIGINT) < {int((1 << 32) / 3)}", *_copies()),
    "duplicate_child": duck(_copied("sra", "sdecl", f"{_KEY} AS objectId, t * 4294967296 + own AS sourceId, price", "(SELECT Source.*, source, rank, row_number() OVER (PARTITION BY source ORDER BY sourceId) - 1 AS own FROM Source JOIN ranks USING (objectId))"), *_copies()),
    "duplicate_estimate": duck("SELECT chunkId, COUNT(*) AS n_rows FROM ranks JOIN chosen ON s = source JOIN spots ON spots.t = chosen.t GROUP BY chunkId", *_copies(), "spots(t, chunkId) AS (VALUES " + ", ".join(f"({t}, {_spot(t)})" for t in D.triangles(3, _BOX)) + ")"),
    "sub_chunk_stats": duck(f"SELECT COUNT(*) AS n, MIN(r) AS smallest, MAX(r) AS largest, round(avg(r), 9) AS mean, round(stddev_pop(r), 9) AS deviation, round(quantile_cont(r, 0.25), 9) AS quartile1, round(quantile_cont(r, 0.5), 9) AS median, round(quantile_cont(r, 0.75), 9) AS quartile3 FROM (SELECT chunkId, subChunkId, COUNT(*) AS r FROM {_LOC} GROUP BY chunkId, subChunkId)", _strips()),
    "chunk_boxes": f"""
        SELECT chunkId, round(CASE WHEN b - a >= 360 THEN 360 ELSE b - a END * degrees(sin(radians(d)) - sin(radians(c))), 9) AS area, round(CASE WHEN whole THEN 0 ELSE (a - half + 360) % 360 END, 9) AS lon_min, round(greatest(c - o, -90), 9) AS lat_min,
            round(CASE WHEN whole THEN 360 ELSE (a + (b - a) + half) % 360 END, 9) AS lon_max, round(least(d + o, 90), 9) AS lat_max
        FROM (SELECT *, b - a + 2 * half >= 360 - 1.0 / 3600 AS whole FROM (SELECT *, CASE WHEN far + o > 90 - 1.0 / 3600 THEN 180 ELSE degrees(abs(atan(sin(radians(o)) / sqrt(abs(cos(radians(far) - radians(o)) * cos(radians(far) + radians(o))))))) END AS half
            FROM (SELECT *, greatest(abs(c), abs(d)) AS far, {STRIPING.overlap!r}::DOUBLE AS o FROM (VALUES {", ".join(f"({c}, {', '.join(f'{x!r}::DOUBLE' for x in _CHUNKER.chunk_bounds(c))})" for c in _CHUNKER.all_chunks)}) AS t(chunkId, a, c, b, d))))""",
    "region_and_index": duck("SELECT objectId, ra FROM Object WHERE ra BETWEEN 10.005 AND 200.005 AND decl BETWEEN -60.005 AND 60.005 AND objectId IN (1, 5, 17, 42, 77, 100)"),
    "generated_columns": duck("SELECT fieldId, fieldName || '/' || zone AS label FROM Field"),
    "contribution_states": "SELECT * FROM (VALUES ('FAILED', 1::BIGINT), ('FINISHED', 1), ('rows', (SELECT 2 * COUNT(*) FROM region))) AS t(state, count)",
    "cancelled_query": "SELECT * FROM (VALUES (1::BIGINT, 'COMPLETED'), (2, 'ABORTED')) AS t(ID, STATE)",
    "parquet_source": "SELECT n_name, CAST(NULL AS VARCHAR) AS motto, n_nationkey FROM nation",
    "rows_source": "SELECT * FROM (VALUES (1::BIGINT, 2.5::DOUBLE, 'a', DATE '2024-03-05'), (2, NULL, NULL, NULL)) AS t(id, x, s, day)",
    "parquet_to_csv": "SELECT n_nationkey, n_name FROM nation",
    "sub_chunk_layout": f"SELECT ss // {_CHUNKER.sub_stripes} AS stripe, CAST(sum(total) AS BIGINT) AS n, round(360 * degrees(sin(radians(least(90, -90 + (ss // {_CHUNKER.sub_stripes} + 1) * {_CHUNKER.height!r}::DOUBLE))) - sin(radians(-90 + (ss // {_CHUNKER.sub_stripes}) * {_CHUNKER.height!r}::DOUBLE))), 6) AS area FROM (WITH {_strips()} SELECT * FROM strips) GROUP BY ss // {_CHUNKER.sub_stripes}",
    "transaction_reopen": duck("SELECT objectId, segment FROM Object"),
    "child_placement": duck(f"SELECT 'key' AS by_what, sourceId FROM Source WHERE objectId IN (1, 17, 42, 100) UNION ALL SELECT 'region', sourceId FROM Source WHERE {sep('(sra + 50)', '(-sdecl)', '80', '10')} <= 20.0051"),
    "queries_at_once": "SELECT * FROM (VALUES (1::BIGINT, 'SYNC', 'COMPLETED', 5::BIGINT), (2, 'SYNC', 'FAILED', NULL), (3, 'SYNC', 'FAILED_LR', NULL)) AS t(ID, TYPE, STATE, ROWS)",
    "areaspec_poly": duck(_poly()),
    "chunk_locate": duck(f"SELECT objectId, chunkId, subChunkId FROM {_LOC}", _strips()),
    "overlap_explode": duck(_overlap(), _strips()),
    "partition_matches": duck("SELECT objectId, refId, flags, chunkId FROM RefMatch", _strips(), _MATCHES),
    "chunk_stats": duck(f"SELECT COUNT(*) AS n, MIN(r) AS smallest, MAX(r) AS largest FROM (SELECT chunkId, COUNT(*) AS r FROM {_LOC} GROUP BY chunkId)", _strips()),
    "partition_by_index": duck(f"SELECT sourceId, chunkId, subChunkId FROM {_located('Source', 'sra', 'sdecl')}", _strips()),
    "htm_id": duck("SELECT objectId, CASE WHEN decl < 0 THEN 8 + CAST(floor(ra / 90) AS BIGINT) ELSE 15 - CAST(floor(ra / 90) AS BIGINT) END AS htm FROM Object"),
    "layout": "SELECT * FROM (VALUES " + ", ".join(f"({c}, {', '.join(f'{x!r}::DOUBLE' for x in _CHUNKER.chunk_bounds(c))})" for c in _CHUNKER.all_chunks) + ") AS t(chunkId, lon_min, lat_min, lon_max, lat_max)",
    "duplicate_shift": duck("SELECT objectId + 1000000 AS objectId, ROUND(CASE WHEN ra + 30.25 >= 360 THEN ra + 30.25 - 360 ELSE ra + 30.25 END, 6) AS ra, decl FROM Object"),
    "async_result": duck("SELECT segment, COUNT(*) AS n FROM Object GROUP BY segment"),
    "ingest_chunked": duck(f"SELECT objectId, chunkId FROM {_LOC} WHERE {sep('ra', 'decl', '30', '10')} <= 40.0051", _strips()),
    "director_index_lookup": duck("SELECT objectId, sourceId, price FROM Source WHERE objectId IN (1, 17, 42, 100)"),
    "row_counters": duck("SELECT COUNT(*) AS n FROM Source"),
    "transaction_abort": duck("SELECT objectId + 20000000 AS objectId FROM Object WHERE objectId < 10"),
    "csv_source": duck("SELECT * FROM Field"),
    "streaming_ingest": duck("SELECT segment, COUNT(*) AS n FROM Object GROUP BY segment"),
    "processlist": "SELECT 0::BIGINT AS n",
    "query_history": "SELECT 1::BIGINT AS ID, 'COMPLETED' AS STATE, 1::BIGINT AS ROWS",
    "show_columns": "SELECT * FROM (VALUES ('fieldId', 'int'), ('fieldName', 'string')) AS t(Field, Type)",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _statement(s[0]) for name, s in STATEMENTS.items()} | OPERATORS
