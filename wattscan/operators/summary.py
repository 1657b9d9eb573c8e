"""Aggregates, groupings and reports over findings. Hints are prose on different quantities and are never summed.

Reports are tables of text lines with their order; they are written by Spark and never gathered on the driver. A report
writes the findings once, in order, so their scan runs once however often the report looks at them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattscan.functions.shared import numbered
from wattscan.functions.text import anchor, escaped, relative
from wattscan.operators.rules import RULES, SEVERITIES
from wattscan.operators.scan import FINDING, ordered

ORDER = ["rank", "file", "line", "emit_rank"]


def rank() -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))


# --- filters


def in_file(findings: DataFrame, path: str) -> DataFrame:
    """The findings of one file."""
    return findings.where(F.col("file") == path)


def at_line(findings: DataFrame, path: str, line: int) -> DataFrame:
    """The findings on one line of a file."""
    return in_file(findings, path).where(F.col("line") == line)


# --- aggregates


def by_severity(findings: DataFrame) -> DataFrame:
    """A count for each of the three severities, zero included."""
    counts = findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in SEVERITIES])).alias("x")).select("x.*")


def by_rule(findings: DataFrame) -> DataFrame:
    """Rules with findings, the busiest first."""
    return findings.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule")


def by_file(findings: DataFrame) -> DataFrame:
    return findings.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"))


def total(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count_distinct("file").alias("files"))


def summarise(findings: DataFrame) -> DataFrame:
    """One row: the total, a count for each severity, files, and ``by_rule``, the busiest first. All in one aggregation."""
    each = F.array(*[F.struct(F.lit(r.id).alias("rule"), F.count_if(F.col("rule") == r.id).alias("n")) for r in RULES])
    one = findings.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count_distinct("file").alias("files"), each.alias("each"))
    busy = F.array_sort(F.transform(F.filter("each", lambda x: x["n"] > 0), lambda x: F.struct((-x["n"]).alias("less"), x["rule"].alias("rule"))))
    return one.withColumn("by_rule", F.transform(busy, lambda x: F.struct(x["rule"].alias("rule"), (-x["less"]).alias("n")))).drop("each")


def grouped(findings: DataFrame, by: str, root: str = "") -> DataFrame:
    """Findings with the label, description and size of their group: by ``severity``, ``file`` or ``rule``.

    Members stay rows, as a group may hold any share of them. ``group_at`` orders groups as they first appear among the
    ordered findings (for severities: high, medium, low), and the columns of ``ORDER`` the members.
    """
    path = relative(F.col("file"), root)
    label, place = {
        "severity": (F.col("severity"), F.lit("")),
        "file": (F.element_at(F.split("file", "/"), -1), F.concat(F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"(?s)^(.*)/", 1)).otherwise("."), F.lit(" \u00b7 "))),
        "rule": (F.concat("rule", F.lit(" \u2014 "), "message"), F.lit("")),
    }[by]
    rows = findings.withColumn("rank", rank())
    groups = rows.groupBy(by).agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct(*ORDER)).alias("group_at"))
    return rows.join(groups, by).withColumn("group_label", label).withColumn("group_note", F.concat(place, F.col("group_size").cast("string")))


def in_groups(rows: DataFrame) -> DataFrame:
    return rows.orderBy("group_at", *ORDER)


def exit_code(findings: DataFrame, fail_on_findings: bool) -> int:
    return int(fail_on_findings and not findings.isEmpty())


# --- reports


def text_lines(findings: DataFrame) -> DataFrame:
    return findings.select("severity", "file", "line", "emit_rank", _headline().alias("text"))


def _headline() -> Column:
    return F.format_string("%s:%d: [%s/%s] %s", "file", "line", "rule", "severity", "message")


def _annotation() -> Column:
    level = F.when(F.col("severity") == "high", "error").when(F.col("severity") == "medium", "warning").otherwise("notice")
    return F.concat(F.lit("::"), level, F.format_string(" file=%s,line=%d,title=%s::%s", "file", "line", "rule", "message"), F.lit(" \u2014 "), "suggestion")


def github_lines(findings: DataFrame) -> DataFrame:
    return findings.select("severity", "file", "line", "emit_rank", _annotation().alias("text"))


def _said() -> Column:
    """What people read of a finding: two or three lines."""
    hint = F.when(F.col("co2e_estimate") != "", F.concat(F.lit("    ~ "), "co2e_estimate"))
    return F.array(_headline(), F.concat(F.lit("    \u21b3 "), "suggestion"), hint)


def _object() -> list[Column]:
    """The fields of a finding as lines of a JSON object."""
    return [F.concat(F.lit(f'    "{c}": '), F.regexp_extract(F.to_json(F.struct(F.col(c))), r"(?s)^\{\"[^\"]*\":(.*)\}$", 1), F.lit("," if c != FINDING[-1] else "")) for c in FINDING]


def rendered(findings: DataFrame, kind: str) -> DataFrame:
    """Findings with ``text``, what a report of the kind ``text``, ``github`` or ``json`` says of each."""
    texts = {"text": lambda: F.array_join(_said(), "\n"), "github": _annotation, "json": lambda: F.array_join(F.array(F.lit("  {"), *_object(), F.lit("  }")), "\n")}
    return findings.withColumn("text", texts[kind]())


def in_sequence(findings: DataFrame) -> DataFrame:
    """Findings in order, written once, with their number ``n``: every later step reads what was written."""
    return numbered(findings.withColumn("rank", rank()), *ORDER)


def _report(part: int, rows: DataFrame, texts: Column, section: Column | None = None, at: Column | None = None) -> DataFrame:
    """Rows of a report: part, section, place in it, and a text for each line; null texts of an array are left out."""
    zero = F.lit(0).cast("long")
    lined = rows.select(F.lit(part).alias("part"), (zero if section is None else section).alias("section"), (zero if at is None else at).alias("n"), F.posexplode(texts).alias("i", "text"))
    return lined.where(F.col("text").isNotNull())


def text_report(findings: DataFrame, accepted: int = 0, baseline: str = "") -> DataFrame:
    """The report for people: two or three lines for each finding, an empty one, and the total."""
    rows = in_sequence(findings)
    note = f" ({accepted} accepted by {baseline})" if accepted else ""
    count = rows.agg(F.count(F.lit(1)).alias("total"))
    end = F.array(F.lit(""), F.concat(F.lit("wattscan: "), F.col("total").cast("string"), F.lit(f" finding(s){note}")))
    return _report(0, rows, _said(), at=F.col("n")).unionByName(_report(1, count, end))


def json_report(findings: DataFrame) -> DataFrame:
    """Lines of a JSON array; a comma stands before each object but the first."""
    rows = in_sequence(findings)
    count = rows.agg(F.count(F.lit(1)).alias("total"))
    body = _report(1, rows, F.array(F.when(F.col("n") == 0, "  {").otherwise("  ,{"), *_object(), F.lit("  }")), at=F.col("n"))
    ends = [_report(part, count, F.when(F.col("total") == 0, F.array(F.lit(none) if none else F.lit(None).cast("string"))).otherwise(F.array(F.lit(some)))) for part, none, some in ((0, "[]", "["), (2, None, "]"))]
    return ends[0].unionByName(body).unionByName(ends[1])


def by_sections(rows: DataFrame, by: str = "file") -> DataFrame:
    """Numbered rows with ``section``, the number of its first row, and ``section_size``: sections follow one another as they first appear."""
    sections = rows.groupBy(by).agg(F.min("n").alias("section"), F.count(F.lit(1)).alias("section_size"))
    return rows.join(sections, by)


def html_report(findings: DataFrame, title: str = "Findings", root: str = "", cost: str = "") -> DataFrame:
    """Lines of a static page without script: totals, a table by rule, and a section for each file in order of appearance."""
    numbers = in_sequence(findings)
    cell = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    rules = numbers.groupBy("rule", "message").agg(F.count(F.lit(1)).alias("n"))
    by_rules = _report(1, rules, F.array(F.concat(F.lit("<tr>"), cell(escaped(F.col("rule"))), cell(escaped(F.col("message"))), cell(F.col("n").cast("string")), F.lit("</tr>"))), -F.col("n"), F.regexp_extract("rule", r"(\d{1,9})", 1).try_cast("long"))
    rows = by_sections(numbers)
    label = escaped(relative(F.col("file"), root))
    head = F.when(F.col("n") == F.col("section"), F.concat(F.lit("<h2>"), label, F.lit(" <small>"), F.col("section_size").cast("string"), F.lit("</small></h2>")))
    hint = F.when(F.col("co2e_estimate") != "", F.concat(F.lit("<p>~ "), escaped(F.col("co2e_estimate")), F.lit("</p>")))
    item = F.concat(F.lit("<p><b>"), label, F.lit(":"), F.col("line").cast("string"), F.lit("</b> "), F.col("severity"), F.lit(" <a href=\"#"), anchor(F.col("rule"), F.col("message")), F.lit("\">"), escaped(F.col("rule")), F.lit("</a> "), escaped(F.col("message")), F.lit("</p>"))
    sections = _report(3, rows, F.array(head, item, F.concat(F.lit("<p>\u21b3 "), escaped(F.col("suggestion")), F.lit("</p>")), hint), F.col("section"), F.col("n"))
    count = numbers.agg(F.count(F.lit(1)).alias("total"))
    shown = lambda x: F.lit(x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
    top = F.array(F.lit("<!doctype html>"), F.concat(F.lit("<title>"), shown(title), F.lit("</title>")), F.concat(F.lit("<h1>"), shown(title), F.lit("</h1><p>"), F.col("total").cast("string"), F.lit(" finding(s)"), shown(cost), F.lit("</p>")), F.when(F.col("total") == 0, "<h2>Nothing found</h2>"), F.lit("<table>"))
    return _report(0, count, top).unionByName(by_rules).unionByName(_report(2, count, F.array(F.lit("</table>")))).unionByName(sections)


def scan_cost(files: int, ms: int, scanned: int, reused: int, skipped: int) -> str:
    """What a scan took, for the head of a report."""
    return f" \u00b7 {files} files in {ms} ms ({scanned} scanned, {reused} reused from cache, {skipped} skipped)"


def in_order(report: DataFrame) -> DataFrame:
    """The texts of a report's lines, in order."""
    return report.orderBy("part", "section", "n", "i").select("text")


def write_report(report: DataFrame, path: str) -> None:
    """Write a report's lines as text files whose order is the report's."""
    in_order(report).write.mode("overwrite").text(path)


def write_json(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines, in order."""
    ordered(findings).select(*FINDING).write.mode("overwrite").json(path)
