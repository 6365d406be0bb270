"""Scalar functions of the dialect by name, as column builders with MySQL's meaning.

Only what differs from Spark's own function of that name is built here; the rest is
named. Names that the dialect rejects are listed with it. A name that nobody knows
falls through to Spark's registry, so users can register functions of their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import AnalysisError, UnsupportedQueryError
from . import photometry, spherical

# MySQL names whose Spark function differs in name only (or not at all).
SAME = """
abs acos asin atan atan2 ceil ceiling conv cos cot crc32 degrees exp floor log log10 log2 pow power radians sign sin tan
bit_count bin character_length char_length concat concat_ws bit_length elt find_in_set hex instr lcase left locate lower lpad
ltrim octet_length position reverse right rpad rtrim soundex substring_index ucase unhex upper nullif datediff day dayname
dayofmonth dayofweek dayofyear hour minute month quarter second weekday weekofyear year md5 sha sha1 sha2
rand uuid pi
""".split()
RENAMED = {"from_base64": "unbase64", "to_base64": "base64", "length": "octet_length", "format": "format_number", "ifnull": "coalesce", "adddate": "date_add", "subdate": "date_sub", "date": "to_date", "timestamp": "to_timestamp", "extractvalue": "xpath_string"}
# Functions that the dialect's grammar knows and rejects.
REJECTED = """
ascii curdate current_date current_time current_timestamp curtime date_add date_sub if insert localtime localtimestamp mid now
replace substr substring sysdate trim utc_date utc_time utc_timestamp cast convert extract char values weight_string get_format password
std stddev stddev_pop stddev_samp var_pop var_samp variance bit_and bit_or bit_xor group_concat
""".split()

# Date format letters of MySQL and their patterns in Spark.
_DATE_LETTERS = {
    "a": "EEE", "b": "MMM", "c": "M", "d": "dd", "e": "d", "f": "SSSSSS", "H": "HH", "h": "hh", "I": "hh", "i": "mm", "j": "DDD", "k": "H", "l": "h",
    "M": "MMMM", "m": "MM", "p": "a", "r": "hh:mm:ss a", "S": "ss", "s": "ss", "T": "HH:mm:ss", "W": "EEEE", "Y": "yyyy", "y": "yy",
}


def date_pattern(mysql: str) -> str:
    """Spark's pattern for a MySQL date format, where there is one."""
    out, at = [], 0
    for m in re.finditer("%(.)", mysql):
        if m[1] in _DATE_PARTS:
            raise UnsupportedQueryError(f"Invalid or unsupported query: the format %{m[1]} can not be read")
        out += [_quoted(mysql[at : m.start()]), _DATE_LETTERS.get(m[1]) or _quoted(m[1])]
        at = m.end()
    return "".join([*out, _quoted(mysql[at:])])


def _week_start(year: Column, monday: bool, four_days: bool) -> Column:
    """The first day of week 1: of the week that has four days of the year, or that begins in it."""
    first = F.make_date(year, F.lit(1), F.lit(1))
    into = F.weekday(first) if monday else F.dayofweek(first) - 1  # days of its week before the first of January
    back = F.when(into <= 3, into).otherwise(into - 7) if four_days else F.pmod(into, F.lit(7)) - F.when(into > 0, 7).otherwise(0)
    return F.date_sub(first, back.cast("int"))


def _weeks(d: Column, mode: int, whole: bool) -> tuple[Column, Column]:
    """(year, week) by a mode from 0 to 7; whole: days before week 1 are of the last week of the year before, and those after the last of the next."""
    d, monday = F.to_date(d), bool(mode & 1)
    rule = monday, bool(mode & 4) != monday
    year = F.year(d)
    start = _week_start(year, *rule)
    number = F.floor(F.datediff(d, start) / 7).cast("int") + 1
    if not whole:
        return year, F.when(d < start, 0).otherwise(number)
    before, after = _week_start(year - 1, *rule), _week_start(year + 1, *rule)
    last = F.floor(F.datediff(d, before) / 7).cast("int") + 1
    return F.when(d < start, year - 1).when(d >= after, year + 1).otherwise(year), F.when(d < start, last).when(d >= after, 1).otherwise(number)


def _mode(args: tuple) -> int:
    if not args:
        return 0
    value = getattr(args[0], "_constant", None)
    if not isinstance(value, int):
        raise AnalysisError("WEEK and YEARWEEK take a constant mode")
    return value & 7


def _week(d: Column, *mode: Column) -> Column:
    m = _mode(mode)
    return _weeks(d, m, bool(m & 2))[1]


def _yearweek(d: Column, *mode: Column) -> Column:
    year, week = _weeks(d, _mode(mode), True)
    return year * 100 + week


def _day_with_suffix(d: Column) -> Column:
    n = F.dayofmonth(d)
    end = F.when(n.between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


#: Parts of a date that no pattern of Spark gives, by MySQL's letter.
_DATE_PARTS: dict[str, Callable[[Column], Column]] = {
    "D": _day_with_suffix,
    "w": lambda d: (F.dayofweek(d) - 1).cast("string"),
    "U": lambda d: _two(_weeks(d, 0, False)[1]),
    "u": lambda d: _two(_weeks(d, 1, False)[1]),
    "V": lambda d: _two(_weeks(d, 2, True)[1]),
    "v": lambda d: _two(_weeks(d, 3, True)[1]),
    "X": lambda d: F.lpad(_weeks(d, 2, True)[0].cast("string"), 4, "0"),
    "x": lambda d: F.lpad(_weeks(d, 3, True)[0].cast("string"), 4, "0"),
}


def date_text(d: Column, format_: Column, name: str) -> Column:
    """A date as text in a constant MySQL format."""
    mysql = getattr(format_, "_constant", None)
    if not isinstance(mysql, str):
        raise AnalysisError(f"{name} takes a constant format")
    d, parts, plain = d.cast("timestamp"), [], ""
    for piece in re.findall("%.|[^%]+|%$", mysql, re.S):
        if piece[0] == "%" and piece[1:] in _DATE_PARTS:
            parts += [F.date_format(d, date_pattern(plain))] if plain else []
            parts.append(_DATE_PARTS[piece[1:]](d))
            plain = ""
        else:
            plain += piece
    parts += [F.date_format(d, date_pattern(plain))] if plain or not parts else []
    return F.concat(*parts)


def _export_set(b: Column, on: Column, off: Column, sep: Column | None = None, bits: Column | None = None) -> Column:
    each = F.array(*[F.when(F.shiftrightunsigned(b.cast("long"), k) % 2 == 1, on).otherwise(off) for k in range(64)])
    n = F.when(bits.between(0, 64), bits).otherwise(64).cast("int") if bits is not None else F.lit(64)
    return F.when(b.isNotNull(), F.call_function("concat_ws", sep if sep is not None else F.lit(","), F.slice(each, F.lit(1), n)))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'" if re.search("[A-Za-z']", text) else text


def _constant(name: str):
    def of(arg: Column) -> str:
        value = getattr(arg, "_constant", None)
        if not isinstance(value, str):
            raise AnalysisError(f"{name} takes a constant format")
        return date_pattern(value)

    return of


def _nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def _field(x: Column, *of: Column) -> Column:
    out = F.lit(0)
    for k in range(len(of), 0, -1):
        out = F.when(x == of[k - 1], k).otherwise(out)
    return out


def _seconds(t: Column) -> Column:
    """Seconds of a time of day or duration [-]h:m:s."""
    t = t.cast("string")
    clock = F.substring_index(t, " ", -1)
    part = lambda k: F.coalesce(F.split(F.regexp_replace(clock, "^-", ""), ":")[k].cast("double"), F.lit(0.0))
    return F.when(t.startswith("-"), -1).otherwise(1) * (part(0) * 3600 + part(1) * 60 + part(2))


def _clock(seconds: Column) -> Column:
    s = F.abs(seconds).cast("long")
    return F.concat(F.when(seconds < 0, "-").otherwise(""), F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))


def _days(d: Column) -> Column:
    """Days since the year 0 as MySQL counts them."""
    return F.datediff(F.to_date(d), F.lit("1970-01-01")) + 719528


def _ipv4(s: Column) -> Column:
    return s.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)(\.(?!$)|$)){4}$")


def _months(p: Column) -> Column:
    return F.floor(p / 100).cast("long") * 12 + p % 100 - 1


def _period(m: Column) -> Column:
    return F.floor(m / 12).cast("long") * 100 + m % 12 + 1


def _unless_null(build: Callable[..., Column]) -> Callable[..., Column]:
    """A function that is null where any argument is."""

    def of(*args: Column) -> Column:
        whole = args[0].isNotNull()
        for a in args[1:]:
            whole &= a.isNotNull()
        return F.when(whole, build(*args))

    return of


BUILT: dict[str, Callable[..., Column]] = {
    "greatest": _unless_null(F.greatest),
    "least": _unless_null(F.least),
    "isnull": lambda x: x.isNull().cast("int"),
    "dayname": lambda d: F.date_format(d, "EEEE"),
    "monthname": lambda d: F.date_format(d, "MMMM"),
    "aes_encrypt": lambda x, key: F.aes_encrypt(x, key, F.lit("ECB"), F.lit("PKCS")),
    "aes_decrypt": lambda x, key: F.aes_decrypt(x, key, F.lit("ECB"), F.lit("PKCS")),
    "round": lambda x, *d: F.round(x, *d),
    "ln": lambda x: F.when(x > 0, F.log(x)),
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)),
    "acos": lambda x: _nan_to_null(F.acos(x)),
    "asin": lambda x: _nan_to_null(F.asin(x)),
    "field": _field,
    "oct": lambda x: F.conv(x.cast("string"), 10, 8),
    "ord": lambda s: F.ascii(s),
    "quote": lambda s: F.when(s.isNull(), F.lit("NULL")).otherwise(F.concat(F.lit("'"), F.regexp_replace(s, r"(['\\])", r"\\$1"), F.lit("'"))),
    "strcmp": lambda a, b: F.when(a < b, -1).when(a > b, 1).when(a == b, 0),
    "make_set": lambda b, *s: F.concat_ws(",", *[F.when(F.shiftright(b.cast("long"), k) % 2 == 1, x) for k, x in enumerate(s)]),
    "export_set": _export_set,
    "convert_tz": lambda t, a, b: F.convert_timezone(a, b, t.cast("timestamp_ntz")),
    "date_format": lambda d, f: date_text(d, f, "DATE_FORMAT"),
    "time_format": lambda d, f: F.date_format(d, _constant("TIME_FORMAT")(f)),
    "str_to_date": lambda s, f: F.try_to_timestamp(s, F.lit(_constant("STR_TO_DATE")(f))),
    "from_unixtime": lambda s, *f: date_text(F.timestamp_seconds(s), f[0], "FROM_UNIXTIME") if f else F.from_unixtime(s),
    "unix_timestamp": lambda *t: F.unix_timestamp(*t),
    "makedate": lambda y, n: F.when(n > 0, F.date_add(F.make_date(y.cast("int"), F.lit(1), F.lit(1)), (n - 1).cast("int"))),
    "maketime": lambda h, m, s: F.when((m < 60) & (s < 60), _clock(h * 3600 + m * 60 + s)),
    "microsecond": lambda t: F.date_format(t, "SSSSSS").cast("int"),
    "period_add": lambda p, n: _period(_months(p) + n),
    "period_diff": lambda a, b: _months(a) - _months(b),
    "sec_to_time": _clock,
    "time_to_sec": lambda t: _seconds(t).cast("long"),
    "addtime": lambda a, b: _clock(_seconds(a) + _seconds(b)),
    "subtime": lambda a, b: _clock(_seconds(a) - _seconds(b)),
    "timediff": lambda a, b: _clock(F.unix_timestamp(a.cast("timestamp")) - F.unix_timestamp(b.cast("timestamp"))),
    "time": lambda t: _clock(_seconds(t)),
    "to_days": _days,
    "from_days": lambda n: F.date_add(F.lit("1970-01-01").cast("date"), (n - 719528).cast("int")),
    "to_seconds": lambda t: _days(t).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t),
    "week": _week,
    "yearweek": _yearweek,
    "timestampadd": lambda u, n, t: F.call_function("timestampadd", u, n, t),
    "inet_aton": lambda s: F.when(_ipv4(s), sum((F.split(s, r"\.")[k].cast("long") * 256 ** (3 - k) for k in range(1, 4)), F.split(s, r"\.")[0].cast("long") * 256**3)),
    "inet_ntoa": lambda n: F.concat_ws(".", *[(F.shiftright(n.cast("long"), 8 * k) % 256).cast("string") for k in (3, 2, 1, 0)]),
    "is_ipv4": lambda s: F.coalesce(_ipv4(s).cast("int"), F.lit(0)),
    "is_ipv6": lambda s: F.coalesce(s.rlike(r"(?i)^([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$|^(([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?::([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?)$").cast("int"), F.lit(0)),
}

#: Domain functions by the name after any prefix: (builder, least, most arguments).
DOMAIN: dict[str, tuple[Callable[..., Column], int, int]] = {
    "angsep": (spherical.ang_sep, 4, 4),
    "spdist": (lambda a, b, c, d, far: (spherical.ang_sep(a, b, c, d) < far).cast("int"), 5, 5),
    "s2ptinbox": (spherical.in_box, 6, 6),
    "s2ptincircle": (spherical.in_circle, 5, 5),
    "s2ptinellipse": (spherical.in_ellipse, 7, 7),
    "fluxtoabmag": (photometry.flux_to_ab_mag, 1, 1),
    "fluxtoabmagsigma": (photometry.flux_to_ab_mag_sigma, 2, 2),
    "abmagtoflux": (photometry.ab_mag_to_flux, 1, 1),
    "abmagtofluxsigma": (photometry.ab_mag_to_flux_sigma, 2, 2),
    "nanojanskytoabmag": (photometry.nanojansky_to_ab_mag, 1, 1),
    "abmagtonanojansky": (photometry.ab_mag_to_nanojansky, 1, 1),
}
POLYGON, TO_BINARY = "s2ptincpoly", "s2cpolytobin"


def domain_name(name: str) -> str | None:
    """The domain function that a call names, with or without a prefix; case does not matter."""
    low = name.lower()
    for known in (*DOMAIN, POLYGON, TO_BINARY):
        if low == known or low.endswith("_" + known):
            return known
    return None


class FunctionRegistry:
    """Builders by lower-case name: the built ones and those of the user."""

    def __init__(self) -> None:
        self.own: dict[str, Callable[..., Column]] = {}

    def register(self, name: str, build: Callable[..., Column]) -> None:
        self.own[name.lower()] = build

    def call(self, name: str, args: list[Column], constants: list) -> Column:
        """Column of a call; constants has the value of each constant argument (else None)."""
        low = name.lower()
        if low in self.own:
            return self.own[low](*args)
        if known := domain_name(name):
            return self._domain(name, known, args, constants)
        if low in BUILT:
            for a, c in zip(args, constants, strict=True):
                a._constant = c
            return BUILT[low](*args)
        return F.call_function(RENAMED.get(low, low), *args)

    @staticmethod
    def _domain(name: str, known: str, args: list[Column], constants: list) -> Column:
        if known == TO_BINARY:
            if len(args) < 6 or len(args) % 2:
                raise AnalysisError(f"Wrong number of arguments for {name}")
            return spherical.polygon_to_binary(args)
        if known == POLYGON and len(args) == 3:
            return spherical.in_binary_polygon(*args)
        if known == POLYGON:
            if len(args) < 8 or len(args) % 2:
                raise AnalysisError(f"Wrong number of arguments for {name}")
            if not all(isinstance(c, (int, float)) for c in constants[2:]):
                raise AnalysisError(f"{name} takes constant vertices")
            flat = [float(c) for c in constants[2:]]
            return spherical.in_polygon(args[0], args[1], list(zip(flat[::2], flat[1::2], strict=True)))
        build, least, most = DOMAIN[known]
        if not least <= len(args) <= most:
            raise AnalysisError(f"Wrong number of arguments for {name}")
        return build(*args)
