"""Text, URL, date and array expressions. Columns in, columns out; nothing here starts a job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The domain pattern and the order of entity escapes are part of the stored data's definition.
DOMAIN_PATTERN = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/?#@]+@)?([^/:?#]+)"
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
#: Fields that are cleaned of NUL characters, in the order in which changes are listed.
TEXT_FIELDS = ("type", "by", "text", "url", "title")
# Seconds of the units of an age; a month has 30 days and a year 365.
MINUTE, HOUR, DAY, MONTH, YEAR = 60, 3600, 86400, 2592000, 31536000


def url_domain(url: Column) -> Column:
    """Lower-cased host of a URL without user and port; null for null, blank or hostless URLs."""
    host = F.nullif(F.lower(F.regexp_extract(url, DOMAIN_PATTERN, 1)), F.lit(""))
    return F.when(F.trim(url) != "", host)


def item_day(time: Column) -> Column:
    """UTC date of unix seconds, whatever the session's zone; floors, so -1 is the last day of 1969."""
    return F.date_from_unix_date(F.floor(time / DAY).cast("int"))


def plural(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {unit}")).otherwise(F.lit(f" {unit}s")))


def relative_age(time: Column, now: Column) -> Column:
    """"3 hours ago" and the like. ``now`` is given, never read, so a plan gives the same rows each time."""
    d = F.greatest(now - time, F.lit(0))
    unit = lambda size, name: F.concat(plural(F.floor(d / size).cast("long"), name), F.lit(" ago"))
    label = F.when(d < MINUTE, F.lit("just now")).when(d < HOUR, unit(MINUTE, "minute")).when(d < DAY, unit(HOUR, "hour"))
    label = label.when(d <= MONTH, unit(DAY, "day")).when(d <= YEAR, unit(MONTH, "month")).otherwise(unit(YEAR, "year"))
    return F.when(time.isNull(), F.lit("unknown age")).otherwise(label)


def strip_nul(c: Column) -> Column:
    return F.translate(c, "\0", "")


def nul_fields(fields: dict[str, Column]) -> Column:
    """Names of the fields that hold a NUL, in the order given."""
    return F.array_compact(F.array(*(F.when(F.contains(c, F.lit("\0")), F.lit(name)) for name, c in fields.items())))


def control_issue(c: Column) -> Column:
    """Array of findings: a NUL anywhere, then the first control character other than tab, newline and return."""
    at = F.regexp_instr(c, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))
    code = F.ascii(F.substring(c, at, F.lit(1)))
    control = F.when(at > 0, F.concat(F.lit("contains control char U+"), F.lpad(F.hex(F.when(F.substring(c, at, F.lit(1)) == "\0", F.lit(0)).otherwise(code)), 4, "0"), F.lit(" at char index "), (at - 1).cast("string")))
    return F.array_compact(F.array(F.when(F.contains(c, F.lit("\0")), F.lit("contains NUL byte")), control))


def escape_html(c: Column) -> Column:
    for char, entity in ENTITIES:
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def sql_quote(c: Column) -> Column:
    """SQL string literal; null becomes the word NULL. For generated scripts only: queries bind columns."""
    return F.coalesce(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def item_url(base: Column, item_id: Column) -> Column:
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/item/"), item_id.cast("string"), F.lit(".json"))


def short_hash(commit: Column) -> Column:
    return F.when(commit == "unknown", commit).otherwise(F.substring(commit, 1, 12))


def error_chain(causes: Column) -> Column:
    return F.array_join(causes, " | caused_by: ")


def run_id(service: Column, pid: Column, millis: Column) -> Column:
    return F.concat_ws("-", service, pid.cast("string"), millis.cast("string"))


def sorted_json(c: Column) -> Column:
    """Compact JSON with the keys of every object in order, null for malformed text. Numbers come in their shortest decimal form."""
    return F.to_json(F.try_parse_json(c))


def pretty_json(c: Column, indent: int = 2) -> Column:
    """The same over several lines: each value of an object or array on its own, indented by its depth; empty ones stay in place.

    Works on compact JSON in one pass of built-ins: strings are set apart, and what lies between them is broken at commas and brackets; a running depth gives the indent.
    """
    # Strings at odd places, the text between them at even ones.
    pieces = F.split(F.regexp_replace(sorted_json(c), r'("(?:[^"\\]|\\.)*")', "\x00$1\x00"), "\x00")
    broken = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?<=[\[{,])(?![\]}])|(?<![\[{])(?=[\]}])", "\x01"), ":", ": ")
    parts = F.transform(pieces, lambda x, i: F.when(i % 2 == 1, x).otherwise(broken(x)))
    # A bracket that a string follows is broken there too, as the string is another part; so is one that a string precedes, above.
    lines = F.split(F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.translate(x, "[]{}", "\x02\x03\x04\x05")).otherwise(x)), ""), "\x01")
    opens = lambda x: F.length(x) - F.length(F.translate(x, "[{", ""))
    closes = lambda x: F.length(x) - F.length(F.translate(x, "]}", ""))
    first = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        leading = F.when(line.rlike(r"^[\]}]"), 1).otherwise(0)
        own = acc["depth"] - leading
        text_ = F.concat(acc["out"], F.when(acc["out"] != "", "\n").otherwise(""), F.repeat(F.lit(" " * indent), own), line)
        return F.struct((acc["depth"] + opens(line) - closes(line)).alias("depth"), text_.alias("out"))

    return F.translate(F.aggregate(lines, first, step, lambda acc: acc["out"]), "\x02\x03\x04\x05", "[]{}")


def parse_parts(c: Column) -> Column:
    """Array of longs from JSON array, brace literal or comma-separated text; blank gives null, a bad element raises."""
    t = F.trim(c)
    longs = lambda a: F.transform(a, lambda x: F.trim(x).cast("long"))
    inner = F.trim(F.regexp_extract(t, r"^\{(.*)\}$", 1))
    empty = F.array().cast("array<bigint>")
    braces = F.when(inner == "", empty).otherwise(longs(F.split(inner, ",")))
    return F.when(t == "", None).when(t.startswith("["), longs(F.from_json(t, "array<string>"))).when(t.startswith("{"), braces).otherwise(longs(F.split(t, ",")))


def format_parts(parts: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(parts, ",", "NULL"), F.lit("}"))
