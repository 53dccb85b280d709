"""Tokens, identifiers, hashes and lines of texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of white space, Unicode's included; named one by one, as that is several times faster than by property.
WHITE = r"[\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def none(text: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(text, F.lit(""))


#: White space at either end. A run within the text is looked at once, from its start.
ENDS = r"(?U)^\s++|(?<!\s)\s++$"


def strip(text: Column) -> Column:
    """Without white space at either end; only texts that have some there are searched for it."""
    return F.when(F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1)).rlike(r"(?U)\s"), F.regexp_replace(text, ENDS, "")).otherwise(text)


#: White space but for the plain space.
ODD_WHITE = WHITE.replace(r"[\s", r"[\t-\r", 1).removesuffix("+")


def tokens(text: Column) -> Column:
    """What lies between white space. Texts whose tokens single spaces part, as those of chunks, are cut without a pattern."""
    text = none(text)
    plain = ~(text.contains("  ") | text.startswith(" ") | text.endswith(" ") | (text == "") | text.rlike(ODD_WHITE))
    return F.when(plain, F.split(text, " ")).otherwise(F.filter(F.split(text, WHITE), lambda w: w != ""))


def terms(text: Column) -> Column:
    """Tokens in lower case, marks and all."""
    return tokens(F.lower(text))


def counted(values: Column) -> Column:
    """The distinct values of an array, ascending, each with how often it is there: array of (value, n).

    Runs of the sorted array; so a row is counted where it lies, and nothing is exploded or shuffled.
    """

    def runs(ordered: Column) -> Column:
        n = F.size(ordered)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return F.when(n > 0, F.zip_with(starts, F.concat(F.slice(starts, 2, n), F.array(n)), lambda a, b: F.struct(F.get(ordered, a).alias("value"), (b - a).alias("n"))))

    # A one-row array, so that sorting is evaluated once.
    return F.coalesce(F.get(F.transform(F.array(F.array_sort(values)), runs), F.lit(0)), F.array())


def snake(kind: str, value: Column) -> Column:
    """An entity's identifier: its kind, two underscores, the value with all but a-z, 0-9 and _ replaced."""
    return F.concat(F.lit(kind + "__"), F.regexp_replace(strip(F.lower(value)), r"[^a-z0-9_]", "_"))


def snake_word(kind: str, value: Column) -> Column:
    """The same of a value without white space of which all that is ASCII are letters, digits and some of "_-./@%+", as patterns find them; plain such values need no search."""
    low = F.lower(value)
    plain = F.octet_length(low) == F.length(low)
    return F.concat(F.lit(kind + "__"), F.when(plain, F.translate(low, "-./@%+", "______")).otherwise(F.regexp_replace(low, r"[^a-z0-9_]", "_")))


def engineer_id(owner: Column) -> Column:
    return F.concat(F.lit("engineer__"), F.replace(F.lower(owner), F.lit(" "), F.lit("_")))


def service_id(service: Column) -> Column:
    return F.concat(F.lit("service__"), F.replace(service, F.lit("-"), F.lit("_")))


def search_key(name: str) -> str:
    """How a service's name is looked for in identifiers and texts."""
    return name.lower().replace("-", "_")


def text_of(title: Column, body: Column) -> Column:
    return F.concat(none(title), F.lit(" "), none(body))


def text_hash(title: Column, body: Column) -> Column:
    """Key of the extraction cache."""
    return F.md5(text_of(title, body))


def content_hash(title: Column, body: Column) -> Column:
    """What the manifest tells changed records by: as text_hash, but without the space between."""
    return F.md5(F.concat(none(title), none(body)))


def document_id(filename: Column, text: Column) -> Column:
    """Twelve digits from the file's name and its first 200 characters: later edits don't change it."""
    return F.substring(F.sha2(F.concat(filename, F.substring(text, 1, 200)), 256), 1, 12)


def lines(text: Column) -> Column:
    return F.split(none(text), "\n")


def after_colon(line: Column) -> Column:
    """What follows the first colon, stripped."""
    return strip(F.regexp_replace(line, r"(?s)^[^:]*:", ""))


def owner_line(body: Column) -> Column:
    """The owner of the first line with "owner:"; what is in parentheses if the line has both. Null without such a line."""
    line = F.get(F.filter(lines(body), lambda x: F.lower(x).contains("owner:")), F.lit(0))
    value = after_colon(line)
    opened, closed = F.locate("(", value), F.locate(")", value)
    # From after the first "(" up to the first ")": empty if that comes before.
    inner = F.substring(value, opened + 1, F.greatest(F.lit(0), closed - opened - 1))
    return F.when((opened > 0) & (closed > 0), inner).otherwise(value)


def escalation_line(body: Column) -> Column:
    """What the last line that names an escalation, and has a colon, says."""
    named = F.filter(lines(body), lambda x: (F.lower(x).contains("on-call:") | F.lower(x).contains("escalation")) & x.contains(":"))
    return after_colon(F.try_element_at(named, F.lit(-1)))


def dependency_lines(body: Column) -> Column:
    """Distinct names in bullets after a line that says "dependencies", up to a line that begins with "#"."""
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, line: Column) -> Column:
        heading, bullet = line.contains("dependencies"), strip(line).startswith("-")
        name = strip(F.split(F.regexp_replace(strip(line), r"^[- ]+", ""), r"\(", 2)[0])
        off = state["on"] & ~heading & ~bullet & line.startswith("#")
        more = state["on"] & ~heading & bullet & (name != "")
        return F.struct((heading | (state["on"] & ~off)).alias("on"), F.when(more, F.concat(state["found"], F.array(name))).otherwise(state["found"]).alias("found"))

    return F.array_distinct(F.aggregate(lines(F.lower(body)), start, step, lambda s: s["found"]))


#: How simple questions begin.
SIMPLE = ("what is", "define", "explain", "describe", "who is", "what does", "how does", "when was")


def is_simple(question: Column) -> Column:
    """Begins like a simple question and has fewer than eight words."""
    low = F.lower(none(question))
    begins = low.startswith(SIMPLE[0])
    for s in SIMPLE[1:]:
        begins = begins | low.startswith(s)
    return begins & (F.size(tokens(question)) < 8)


def parse_json(raw: Column, kind: str) -> Column:
    """A model's answer as a struct: without code fences; else what lies between the first { and the last }. Null if neither is JSON."""
    bare = strip(F.regexp_replace(F.regexp_replace(strip(raw), r"(?m)^```(?:json)?\s*", ""), r"(?m)(?<!\s)\s*+```$", ""))
    inner = F.regexp_extract(bare, r"(?s)^[^{]*+(\{.*\})", 1)

    def parsed(text: Column) -> Column:
        return F.from_json(text, kind, {"mode": "PERMISSIVE"})

    whole = F.get_json_object(bare, "$").isNotNull() & F.ltrim(bare).startswith("{")
    return F.when(whole, parsed(bare)).when(F.get_json_object(inner, "$").isNotNull(), parsed(inner))
