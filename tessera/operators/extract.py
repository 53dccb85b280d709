"""Entities, relations and unresolved names by patterns, as array expressions that Catalyst fuses into one projection."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import none, snake_word, text_of

#: Kinds of entities and their patterns, in order. (?U) gives \w, \d, \s and \b Unicode's meaning.
#: A ticket's pattern also matches what looks like PR-12, and the first kind to match a span has it.
ENTITIES = {
    "jira_ticket": r"(?U)\b([A-Z]{2,6}-\d+)\b",
    "commit_sha": r"(?U)\b([a-f0-9]{7,40})\b",
    "pr_number": r"(?U)\b(?:PR(?!-\d)|pr)[- #]*(\d+)\b",
    "email": r"(?U)\b([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})\b",
    "service": r"(?U)\b([a-z][a-z0-9]*(?:-[a-z0-9]+)*(?:-service|-api|-gateway|-worker|-cache|-store|-db))\b",
    "file_path": r"(?U)\b([\w./]+\.(?:py|js|ts|go|java|yaml|yml|json|cfg))\b",
    "error_code": r"(?U)\b(5\d{2}|4\d{2})\b",
    "timeout_ms": r"(?U)(\d+)\s*ms\b",
}
#: Relations, what triggers them, and which ends are named.
RELATIONS = [
    (r"(?iU)caused\s+by\s+([\w-]+)", "caused_by", "right"),
    (r"(?iU)([\w-]+)\s+depends[_\s]on\s+([\w-]+)", "depends_on", "both"),
    (r"(?iU)owner[:\s]+([\w@.]+)", "owned_by", "right"),
    (r"(?iU)(?:fix|fixed|fixes)\s+([A-Z]{2,6}-\d+)", "fixes", "right"),
    (r"(?iU)modified\s+([\w./]+)", "modified", "right"),
    (r"(?iUd)timeout.*?(?:in|from|of)\s+([\w-]+)", "affects", "right"),
    (r"(?iU)([\w-]+)\s+unresponsive", "affects", "left"),
]
#: Fixed value: two or more capitalised words in a row.
PHRASE = r"(?U)\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"


#: How a service's name ends.
_ENDS = "(?:service|api|gateway|worker|cache|store|db)"
_MAIL, _PATH = "a-zA-Z0-9._%+-", r"\w./"


def _from_start(run: str, rest: str) -> str:
    """`rest`, which begins with characters of a run, only where no other start in the run would do: at the run's first
    boundary, or where the last match ended. If it fails there it fails at all later starts, so a run is looked at once."""
    return rf"(?U)(?:(?<![{run}])|\G)(?:(?!\b)[{run}])*+\b{rest}"


#: The same matches in time that is linear in the text, without recursion: loops give nothing back, and of a run of characters only the first start
#: is tried. Where a pattern consumes what it doesn't want, the group is empty.
LINEAR = {
    "jira_ticket": r"(?U)\b([A-Z]{2,6}-\d++)\b",
    "pr_number": r"(?U)\b(?:PR(?!-\d)|pr)[- #]*+(\d++)\b",
    "email": _from_start(_MAIL, rf"([{_MAIL}]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}})\b"),
    # A chain of parts between hyphens, whole; its name goes up to the last part that is an ending.
    "service": rf"(?U)\b(?=[a-z0-9]++-)(?:[0-9][a-z0-9]*+-(?=[a-z0-9]))*+([a-z][a-z0-9]*+(?:(?:-(?!{_ENDS}(?!\w))[a-z0-9]++(?!\w))*+-{_ENDS}(?!\w))++)?+(?:-?[a-z0-9]++(?!\w))*+",
    "file_path": _from_start(_PATH, rf"([{_PATH}]+\.(?:py|js|ts|go|java|yaml|yml|json|cfg))\b"),
    "timeout_ms": r"(?U)(?<!\d)(\d++)\s*+ms\b",
    "depends_on": r"(?iU)(?<![\w-])([\w-]++)\s++depends[_\s]on\s++([\w-]++)",
    # A line on which nothing follows the first timeout has nothing for the others either.
    "affects right": r"(?iUd)timeout(?:.*?(?:in|from|of)\s++([\w-]++)|.*+)",
    "affects left": r"(?iU)(?:(?<![\w-])|\G)([\w-]++)\s++unresponsive",
    "phrase": r"(?U)\b([A-Z][a-z]++\b(?:\s++[A-Z][a-z]++\b)++)",
}
#: What a text has to contain for a kind to be looked for at all, and a relation, there in capitals: of letters that have one case's sign each.
NEEDED = {
    "jira_ticket": ("-",), "pr_number": ("PR", "pr"), "email": ("@",), "service": ("-service", "-api", "-gateway", "-worker", "-cache", "-store", "-db"),
    "file_path": (".py", ".js", ".ts", ".go", ".java", ".yaml", ".yml", ".cfg"), "timeout_ms": ("ms",),
}
SAID = {"caused_by": ("CAUSED",), "depends_on": ("DEPENDS",), "owned_by": ("OWNER",), "fixes": ("FIX", "F\u0130X"), "modified": ("MOD",), "affects right": ("MEOUT",), "affects left": ("RESPONS",)}
#: What every text with a match has a match of, too, for RE2 and for Java. These look for no word's boundary and no class of Unicode's, which are
#: what searching costs; all that isn't ASCII counts as any class's.
ODD = r"\x{80}-\x{10FFFF}"
LIKELY = {
    "jira_ticket": rf"[A-Z]{{2}}-[0-9{ODD}]", "commit_sha": r"[a-f0-9]{7}", "pr_number": rf"(?:PR|pr)[- #]*[0-9{ODD}]", "email": rf"[{_MAIL}]@[a-zA-Z0-9.-]",
    "service": f"-{_ENDS}", "file_path": r"\.(?:py|js|ts|go|java|yaml|yml|json|cfg)", "error_code": rf"[45][0-9{ODD}]{{2}}", "timeout_ms": rf"[0-9\t-\r {ODD}]ms",
    "phrase": rf"[a-z][\t-\r {ODD}]+[A-Z]",
}
#: Kinds whose matches are within a line, and what is in such a line: only these lines of a longer text are searched.
IN_LINES = {"jira_ticket": "-", "email": "@", "service": "-"}


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _has(text: Column, values: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [text.contains(v) for v in values])


def _lines_with(text: Column, mark: str) -> Column:
    """The lines that hold the mark."""
    return F.when(text.contains("\n"), F.array_join(F.filter(F.split(text, "\n"), lambda line: line.contains(mark)), "\n")).otherwise(text)


def likely(text: Column) -> Column:
    """A bit for each kind of LIKELY: whether the text has a match of its pattern. RE2 tells so for a batch at a time, many times faster than a
    search of each row by Java's patterns."""
    patterns = list(LIKELY.values())

    # Nested, so that workers that can't import this package are sent it whole.
    def bits(texts: pa.Array) -> pa.Array:
        out = pa.array([0], pa.int64()).take(pa.array([0] * len(texts), pa.int64()))
        for i, pattern in enumerate(patterns):
            hit = pc.cast(pc.fill_null(pc.match_substring_regex(texts, pattern), False), pa.int64())
            out = pc.bit_wise_or(out, pc.multiply(hit, pa.scalar(1 << i, pa.int64())))
        return out

    return F.arrow_udf(bits, "long")(text)


def _searched(text: Column, kind: str, found: Column, bits: Column | None) -> Column:
    """What is found, where the text has what the kind needs; other texts aren't searched."""
    if bits is not None:
        some = bits.bitwiseAND(F.lit(1 << list(LIKELY).index(kind)).cast("long")) != 0
    else:
        some = text.rlike(LIKELY[kind])
        some = _has(text, NEEDED[kind]) & some if kind in NEEDED else some
    return F.when(some, found).otherwise(F.array().cast("array<string>"))


def _matches(text: Column, kind: str, pattern: str, bits: Column | None = None) -> Column:
    """All of a kind's matches."""
    place = _lines_with(text, IN_LINES[kind]) if kind in IN_LINES else text
    return _searched(text, kind, F.filter(_all(place, LINEAR.get(kind, pattern)), lambda v: v != ""), bits)


def entities(text: Column, bits: Column | None = None) -> Column:
    """Every match, repeats too, in the order of kinds. `bits` are those of `likely`, if they are known."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(_matches(text, kind, pattern, bits), lambda v: F.struct(snake_word(kind, v).alias("id"), F.lit(kind).alias("type"), v.alias("name"), F.lit(0.95).alias("confidence"), F.lit("rule").alias("source")))

    return F.concat(*[of(k, p) for k, p in ENTITIES.items()])


def relations(record_id: Column, text: Column) -> Column:
    """Every match in the order of RELATIONS; the end that a pattern doesn't name is the record."""

    def edge(start: Column, relation: str, end: Column, confidence: float) -> Column:
        return F.struct(start.alias("from_id"), F.lit(relation).alias("relation"), end.alias("to_id"), F.lit(confidence).alias("confidence"), F.lit("rule").alias("source"))

    def of(pattern: str, relation: str, direction: str) -> Column:
        own = LINEAR.get(relation, LINEAR.get(f"{relation} {direction}", pattern))
        found = F.filter(_all(text, own), lambda v: v != "")
        if direction == "both":
            edges = F.zip_with(found, _all(text, own, 2), lambda a, b: edge(snake_word("service", a), relation, snake_word("service", b), 0.80))
        elif direction == "right":
            edges = F.transform(found, lambda v: edge(record_id, relation, snake_word("unknown", v), 0.75))
        else:
            edges = F.transform(found, lambda v: edge(snake_word("service", v), relation, record_id, 0.75))
        said = SAID.get(relation) or SAID[f"{relation} {direction}"]
        return F.when(_has(upper, said), edges).otherwise(F.array().cast(f"array<{schemas.RELATION}>"))

    # In capitals, as those of the letters that a pattern takes for another's case are among them.
    upper = F.upper(text)
    return F.concat(*[of(*r) for r in RELATIONS])


def unresolved(text: Column, bits: Column | None = None) -> Column:
    """Distinct capitalised phrases in order, joined; null if there are none."""
    found = F.array_sort(F.array_distinct(_searched(text, "phrase", _all(text, LINEAR["phrase"]), bits)))
    return F.when(F.size(found) > 0, F.array_join(found, ", "))


def extract_with_rules(records: DataFrame) -> DataFrame:
    """The records with entities, relationships and unresolved_text, found in title and body."""
    # Columns of their own, so that the text is put together once for all patterns, and tested once.
    text, bits = F.col("text_of_record"), F.col("bits_of_record")
    at = records.withColumn("text_of_record", text_of(F.col("title"), F.col("body"))).withColumn("bits_of_record", likely(text))
    return at.withColumns({"entities": entities(text, bits), "relationships": relations(F.col("id"), text), "unresolved_text": unresolved(text, bits)}).drop("text_of_record", "bits_of_record")


def needs_frontier(body: Column, source: Column, n_entities: Column, n_relations: Column) -> Column:
    """Whether a record is too complex for patterns: a long body, few finds in a middling one, documentation, many finds without a relation."""
    size = F.length(none(body))
    return (size > 800) | ((n_entities < 2) & (size > 300)) | F.coalesce(source == "confluence", F.lit(False)) | ((n_relations == 0) & (n_entities > 3))
