"""Every registered query of the rule engine, with its SQL. Findings are over the derived corpus of all documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wattscan import project
from wattscan.functions.shared import scratch, shared_dir, written
from wattscan.functions.text import anchor, blank_comments, escaped, relative, with_parts
from wattscan.operators import baseline, globs, incremental, pyfacts, summary
from wattscan.operators.rules import RULES, SEVERITIES, Rule, languages, languages_of, rules_of
from wattscan.operators.scan import register_findings, scan, scannable
from wattscan.operators.store import ScanStore
from wattscan.plans.corpus import TEMPLATES, blanked_sql, expected_sql, files, paths_sql
from wattscan.sources.config import Config
from wattscan.streaming.rescan import current, stream_scan

BRIEF = ["rule", "severity", "file", "line", "message"]
ONE_FILE = "db/f14.sql"


def _rule(rule: str):
    return lambda spark, sf_dir: scan(files(spark, sf_dir), only=(rule,)).select(*BRIEF)


def _all(spark, sf_dir, **options):
    return scan(files(spark, sf_dir), **options)


def _manifests(spark, sf_dir):
    """Then and now: a third of the files has a new time, and a third of those new text."""
    then = files(spark, sf_dir).withColumn("mtime_ns", F.lit(1).cast("long"))
    edited = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    now = then.withColumn("mtime_ns", F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1).cast("long")).withColumn("text", edited)
    return incremental.manifest(now), incremental.manifest(then)


def _merged(spark, sf_dir):
    """A rescan of odd files found nothing in those divisible by three; files divisible by five are being edited."""
    rows = files(spark, sf_dir)
    stored = scan(rows).select(*BRIEF)
    batch = scan(rows.where("doc_id % 2 = 1 AND doc_id % 3 <> 0")).select(*BRIEF)
    return incremental.merge(stored, batch, rows.where("doc_id % 2 = 1"), rows.where("doc_id % 5 = 0"))


def _pruned(spark, sf_dir):
    rows = files(spark, sf_dir)
    return incremental.prune(scan(rows).select(*BRIEF), "src", rows.where("doc_id % 2 = 1"), rows.where("doc_id % 5 = 0"))


def _streamed(spark, sf_dir):
    """The corpus as a table of changes, scanned in micro-batches: some files had other text before, others are deleted.

    In the end all first versions are delivered again; by then they are known or out of date.
    """
    work = f"{shared_dir(spark)}/wattscan-stream-{uuid.uuid4().hex}"
    row = lambda path, version, text, deleted=False: F.struct(path.alias("path"), F.lit(version).cast("long").alias("version"), text.alias("text"), F.lit(deleted).alias("deleted"))
    path, text, old = F.col("path"), F.col("text"), F.lit("from old import *\nSELECT * FROM old;\n")
    gone = F.concat(F.lit("gone/"), path)
    turned = F.when(F.col("doc_id") % 3 == 0, F.array(row(path, 1, old), row(path, 2, text))).when(F.col("doc_id") % 3 == 1, F.array(row(path, 1, text), row(gone, 1, old), row(gone, 2, F.lit(None).cast("string"), True)))
    changes = files(spark, sf_dir).select("doc_id", F.explode(F.coalesce(turned, F.array(row(path, 1, text)))).alias("x")).select("doc_id", "x.*")
    # Versions of even ids come together, those of odd ids in files of their own.
    odd = [changes.where(f"doc_id % 2 <> 0 AND version = {v}") for v in (1, 2)]
    changes.where("doc_id % 2 = 0").union(odd[0]).union(odd[1]).drop("doc_id").write.parquet(f"{work}/changes")
    stream_scan(spark, f"{work}/changes", f"{work}/found", f"{work}/state").awaitTermination()
    changes.where("version = 1").drop("doc_id").write.mode("append").parquet(f"{work}/changes")
    stream_scan(spark, f"{work}/changes", f"{work}/found", f"{work}/state").awaitTermination()
    return current(spark, f"{work}/found").select(*BRIEF)


def _reconfigured(spark, sf_dir):
    """Nothing changed but the options of every second scan: files scanned with other rules are scanned again."""
    now, then = _manifests(spark, sf_dir)
    odd = F.col("path").rlike("[13579][^0-9/]*$")
    options = lambda *ids: F.lit(incremental.config_fingerprint(ids))
    return incremental.reuse(now.withColumn("config", F.when(odd, options("GL001")).otherwise(options())), then.withColumn("config", options()))


def _stored(spark, sf_dir):
    """A store of the files of then, refreshed with those of now: besides what ``_manifests`` changes, some files are gone and some are new."""
    rows = files(spark, sf_dir)
    sized = lambda df: df.select("path", "text", "mtime_ns", F.octet_length("text").cast("long").alias("size"))
    then = rows.where("doc_id % 10 <> 8").withColumn("mtime_ns", F.lit(1).cast("long"))
    edited = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    now = rows.where("doc_id % 10 <> 7").withColumn("mtime_ns", F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1).cast("long")).withColumn("text", edited)
    store = ScanStore(spark, scratch(spark, "store"), 8)
    store.refresh(sized(then))
    touched = store.refresh(sized(now))
    return store, touched


def _invalidated(spark, sf_dir):
    rows = files(spark, sf_dir)
    kept = incremental.invalidate(_manifests(spark, sf_dir)[1], rows.where("doc_id % 2 = 0").select("path"))
    return kept.select("path")


def _own_rule(spark, sf_dir):
    """A rule of one's own, beside the others."""
    rule = Rule("OWN01", "low", (".py",), "regex", "long sleep", "wait for an event", "", r"time\.sleep\([1-9]\)")
    return scan(files(spark, sf_dir), only=("OWN01", "GL028"), own=(rule,)).select(*BRIEF)


def _sql_findings(spark, sf_dir):
    """The scan as a table function in SQL, by path and severity."""
    register_findings(spark, files(spark, sf_dir))
    return spark.sql(f"SELECT {', '.join(BRIEF)} FROM findings('src/%', 'low') UNION ALL SELECT {', '.join(BRIEF)} FROM findings() WHERE severity <> 'low'")


def _new_findings(spark, sf_dir):
    """Findings of every second file by id are accepted, the others are left: one scan, written once."""
    found = written(scan(files(spark, sf_dir), keep=("doc_id",)), "findings")
    return baseline.apply_baseline(found, baseline.accepted_prints(found.where("doc_id % 2 = 0"))).select(*BRIEF)


def _facts(spark, sf_dir):
    """Syntax facts of Python files through SQL."""
    pyfacts.register_facts(spark)
    return spark.sql("SELECT path, f.kind, f.line, f.name FROM {files}, LATERAL python_facts(text) f WHERE path LIKE '%.py'", files=files(spark, sf_dir).select("path", "text"))


def _grouped(by: str):
    return lambda spark, sf_dir: summary.grouped(_all(spark, sf_dir), by).select("group_label", "group_note", F.col("group_size").alias("n"), "rule", "file", "line")


def _checked(spark, sf_dir):
    """Configuration and excludes joined; no baseline file is there."""
    return project.check(files(spark, sf_dir), Config(("GL028",), ["vendor/*"]), globs.editor_excludes({"web": True, "src": False}, {"docs": True}, "")).findings.select(*BRIEF)


def _summary(spark, sf_dir):
    busiest = F.array_join(F.transform("by_rule", lambda x: F.concat(x["rule"], F.lit("="), x["n"].cast("string"))), ",")
    return summary.summarise(_all(spark, sf_dir)).withColumn("by_rule", busiest)


QUERIES = {f"rule_{r.id.lower()}": _rule(r.id) for r in RULES} | {
    "scan_all": lambda s, d: _all(s, d).select(*BRIEF),
    "scan_disabled": lambda s, d: _all(s, d, disable=("GL005", "GL028")).select(*BRIEF),
    "scan_ignored": lambda s, d: _all(s, d, ignore=("vendor/*", "*/web/*", "k8s/f?.y[!m]ml")).select(*BRIEF),
    "test_file_exemption": lambda s, d: _all(s, d, only=("GL001", "GL002", "GL007")).select(*BRIEF),
    "blank_comments": lambda s, d: with_parts(files(s, d)).withColumn("code", blank_comments()).select("path", F.length("code").cast("long").alias("n_chars"), F.md5("code").alias("code_md5"), (F.length("code") == F.length("text")).alias("same_length")),
    "scannable_files": lambda s, d: scannable(files(s, d)).select("path"),
    "languages": lambda s, d: languages_of(files(s, d)).orderBy("language"),
    "list_rules": lambda s, d: rules_of(files(s, d)).select("rule", "severity", "message", "files"),
    "summary_by_severity": lambda s, d: summary.by_severity(_all(s, d)),
    "summary_by_rule": lambda s, d: summary.by_rule(_all(s, d)),
    "findings_by_file": lambda s, d: summary.by_file(_all(s, d)),
    "summary_total": lambda s, d: summary.total(_all(s, d)),
    "fingerprints": lambda s, d: baseline.fingerprinted(_all(s, d)).select("file", "rule", "line", "fingerprint"),
    "baseline_anti_join": _new_findings,
    "baseline_write": lambda s, d: baseline.accepted_prints(_all(s, d)).orderBy("fingerprint"),
    "incremental_reuse": lambda s, d: incremental.reuse(*_manifests(s, d)),
    "incremental_counts": lambda s, d: incremental.reuse(*_manifests(s, d)).groupBy("how").agg(F.count(F.lit(1)).alias("n")),
    "merge_batch": _merged,
    "prune_under": _pruned,
    "stream_scan": _streamed,
    "report_github": lambda s, d: summary.github_lines(_all(s, d)).select("text"),
    "report_text": lambda s, d: summary.text_lines(_all(s, d)).select("text"),
    "report_full": lambda s, d: summary.in_order(summary.text_report(_all(s, d), 3, "b.json")),
    "report_json": lambda s, d: summary.in_order(summary.json_report(_all(s, d))),
    "report_html": lambda s, d: summary.in_order(summary.html_report(_all(s, d), "Findings", "src")),
    "summary": _summary,
    "grouped_by_severity": _grouped("severity"),
    "grouped_by_file": _grouped("file"),
    "grouped_by_rule": _grouped("rule"),
    "scope_file": lambda s, d: summary.in_file(_all(s, d), ONE_FILE).select(*BRIEF),
    "hover_line": lambda s, d: summary.at_line(_all(s, d), ONE_FILE, 2).select(*BRIEF),
    "docs_anchor": lambda s, d: _all(s, d).select("rule", anchor(F.col("rule"), F.col("message")).alias("anchor")).distinct(),
    "relative_labels": lambda s, d: files(s, d).select("path", relative(F.col("path"), "src").alias("label")),
    "html_escape": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(escaped(F.coalesce("text", F.lit("")))).alias("escaped_md5")),
    "exit_code": lambda s, d: s.createDataFrame([(summary.exit_code(_all(s, d), True),)], "code int"),
    "config_changed": _reconfigured,
    "invalidate": _invalidated,
    "own_rule": _own_rule,
    "sql_findings": _sql_findings,
    "sql_facts": _facts,
    "check_project": _checked,
    "store_findings": lambda s, d: _stored(s, d)[0].findings().select(*BRIEF),
    "store_changes": lambda s, d: _stored(s, d)[1],
}

_ALL = f"SELECT * FROM {expected_sql()} x"
_KIND = "CASE WHEN ends_with(p.path, '/Dockerfile') THEN 'Dockerfile' ELSE '.' || string_split(string_split(p.path, '/')[-1], '.')[-1] END"
_PRINT = "sha1(file || '|' || rule || '|' || message)"
_VALUES = lambda rows: ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)
_HOW = "CASE WHEN doc_id % 3 <> 0 THEN 'stat' WHEN doc_id % 9 <> 0 THEN 'hash' ELSE 'scan' END"
_MERGED = "NOT (doc_id % 2 = 1 AND doc_id % 5 <> 0 AND doc_id % 3 = 0)"
_LABEL = "CASE WHEN starts_with(file, 'src/') THEN substr(file, 5) ELSE file END"
_ANCHOR = "replace(regexp_replace(lower(rule || ' \u2014 ' || message), '[^a-z0-9 _-]', '', 'g'), ' ', '-')"


def _esc(sql: str) -> str:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        sql = f"replace({sql}, '{plain}', '{entity}')"
    return sql


_ESCAPED = _esc("coalesce(text, '')")
_RANK = "list_position(['" + "', '".join(SEVERITIES) + "'], severity)"
_MORE = f"(SELECT x.*, t.suggestion, t.hint FROM {expected_sql()} x JOIN (VALUES {_VALUES([(r.id, r.suggestion, r.hint) for r in RULES])}) t(rule, suggestion, hint) USING (rule))"
_FIELDS = " || ".join(f"""'    "{k}": ' || {v} || '{"" if k == "co2e_estimate" else ","}' || chr(10)""" for k, v in {**{k: f"""'"' || {k} || '"'""" for k in ("rule", "severity", "file")}, "line": "line", **{k: f"""'"' || {v} || '"'""" for k, v in (("message", "message"), ("suggestion", "suggestion"), ("co2e_estimate", "hint"))}}.items())
_GROUP = "SELECT {label} AS group_label, {note}CAST(count(*) OVER w AS VARCHAR) AS group_note, count(*) OVER w AS n, rule, file, line FROM {found} x WINDOW w AS (PARTITION BY {by})"
_LINES = {"github": "'::' || CASE severity WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'notice' END || ' file=' || file || ',line=' || line || ',title=' || rule || '::' || message || ' \u2014 ' || suggestion", "text": "file || ':' || line || ': [' || rule || '/' || severity || '] ' || message"}

ORACLES = {f"rule_{r.id.lower()}": f"SELECT * FROM {expected_sql(f"rule = '{r.id}'")} x" for r in RULES} | {
    "scan_all": _ALL,
    "scan_disabled": f"{_ALL} WHERE rule NOT IN ('GL005', 'GL028')",
    "scan_ignored": f"{_ALL} WHERE NOT starts_with(file, 'vendor/') AND NOT starts_with(file, 'web/') AND NOT regexp_full_match(file, 'k8s/f.[.]y[^m]ml')",
    "test_file_exemption": f"{_ALL} WHERE rule IN ('GL001', 'GL002', 'GL007')",
    "scannable_files": f"SELECT path FROM {paths_sql()} x WHERE NOT ends_with(path, '.md')",
    "languages": f"SELECT l.language, count(p.path) AS files FROM (VALUES {_VALUES([(x,) for x in languages()])}) l(language) LEFT JOIN {paths_sql()} p ON {_KIND} = l.language GROUP BY l.language",
    "list_rules": f"SELECT r.rule, r.severity, r.message, count(DISTINCT p.path) AS files FROM (VALUES {_VALUES([(r.id, r.severity, r.message, x) for r in RULES for x in r.langs])}) r(rule, severity, message, language) LEFT JOIN {paths_sql()} p ON {_KIND} = r.language GROUP BY ALL",
    "summary_by_severity": f"SELECT s.severity, count(x.rule) AS n FROM (VALUES ('high'), ('medium'), ('low')) s(severity) LEFT JOIN {expected_sql()} x ON x.severity = s.severity GROUP BY s.severity",
    "summary_by_rule": f"SELECT rule, count(*) AS n FROM {expected_sql()} x GROUP BY rule",
    "findings_by_file": f"SELECT file, count(*) AS n, min(line) AS first_line FROM {expected_sql()} x GROUP BY file",
    "summary_total": f"SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low, count(DISTINCT file) AS files FROM {expected_sql()} x",
    "fingerprints": f"SELECT file, rule, line, {_PRINT} AS fingerprint FROM {expected_sql()} x",
    "baseline_anti_join": f"SELECT * FROM {expected_sql('doc_id % 2 <> 0')} x",
    "baseline_write": f"SELECT DISTINCT {_PRINT} AS fingerprint FROM {expected_sql()} x",
    "incremental_reuse": f"SELECT path, {_HOW} AS how FROM {paths_sql()} x",
    "incremental_counts": f"SELECT {_HOW} AS how, count(*) AS n FROM documents GROUP BY 1",
    "merge_batch": f"SELECT * FROM {expected_sql(_MERGED)} x",
    "prune_under": f"SELECT * FROM {expected_sql("NOT (starts_with(file, 'src/') AND doc_id % 2 <> 1 AND doc_id % 5 <> 0)")} x",
    "stream_scan": _ALL,
    "report_github": f"SELECT {_LINES['github']} AS text FROM {_MORE} x",
    "report_html": f"""
        SELECT unnest(['<!doctype html>', '<title>Findings</title>', '<h1>Findings</h1><p>' || count(*) || ' finding(s)</p>', '<table>', '</table>']) AS text FROM {_MORE} x
        UNION ALL SELECT '<tr><td>' || rule || '</td><td>' || {_esc("message")} || '</td><td>' || count(*) || '</td></tr>' FROM {_MORE} x GROUP BY rule, message
        UNION ALL SELECT '<h2>' || {_esc(_LABEL)} || ' <small>' || count(*) || '</small></h2>' FROM {_MORE} x GROUP BY file
        UNION ALL SELECT unnest(['<p><b>' || {_esc(_LABEL)} || ':' || line || '</b> ' || severity || ' <a href="#' || {_ANCHOR} || '">' || rule || '</a> ' || {_esc("message")} || '</p>', '<p>\u21b3 ' || {_esc("suggestion")} || '</p>', '<p>~ ' || {_esc("hint")} || '</p>']) FROM {_MORE} x""",
    "report_text": f"SELECT {_LINES['text']} AS text FROM {expected_sql()} x",
    "report_full": f"SELECT unnest([{_LINES['text']}, '    \u21b3 ' || suggestion, '    ~ ' || hint]) AS text FROM {_MORE} x UNION ALL SELECT unnest(['', 'wattscan: ' || count(*) || ' finding(s) (3 accepted by b.json)']) FROM {expected_sql()} x",
    "report_json": f"SELECT unnest(string_split(CASE WHEN n = 1 THEN '  {{' ELSE '  ,{{' END || chr(10) || {_FIELDS} || '  }}', chr(10))) AS text FROM (SELECT *, row_number() OVER () AS n FROM {_MORE} y) x UNION ALL SELECT unnest(['[', ']'])",
    "summary": f"SELECT count(*) AS total, {', '.join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in SEVERITIES)}, count(DISTINCT file) AS files, (SELECT string_agg(rule || '=' || n, ',' ORDER BY n DESC, rule) FROM (SELECT rule, count(*) AS n FROM {expected_sql()} y GROUP BY rule)) AS by_rule FROM {expected_sql()} x",
    "grouped_by_severity": _GROUP.format(label="severity", note="", by="severity", found=expected_sql()),
    "grouped_by_file": _GROUP.format(label="string_split(file, '/')[-1]", note="regexp_extract(file, '^(.*)/', 1) || ' \u00b7 ' || ", by="file", found=expected_sql()),
    "grouped_by_rule": _GROUP.format(label="rule || ' \u2014 ' || message", note="", by="rule", found=expected_sql()),
    "scope_file": f"{_ALL} WHERE file = '{ONE_FILE}'",
    "hover_line": f"{_ALL} WHERE file = '{ONE_FILE}' AND line = 2",
    "docs_anchor": f"SELECT DISTINCT rule, {_ANCHOR} AS anchor FROM {expected_sql()} x",
    "relative_labels": f"SELECT path, CASE WHEN starts_with(path, 'src/') THEN substr(path, 5) ELSE path END AS label FROM {paths_sql()} x",
    "html_escape": f"SELECT doc_id, md5({_ESCAPED}) AS escaped_md5 FROM documents",
    "exit_code": f"SELECT CAST(count(*) > 0 AS INTEGER) AS code FROM {expected_sql()} x",
    "config_changed": f"SELECT path, CASE WHEN regexp_matches(path, '[13579][^0-9/]*$') THEN 'scan' ELSE {_HOW} END AS how FROM {paths_sql()} x",
    "invalidate": f"SELECT path FROM {paths_sql()} x WHERE doc_id % 2 <> 0",
    "sql_findings": f"{_ALL} WHERE severity <> 'low' OR starts_with(file, 'src/')",
    "own_rule": f"{_ALL} WHERE rule = 'GL028' UNION ALL SELECT 'OWN01', 'low', path, 3, 'long sleep' FROM {paths_sql()} x WHERE doc_id % {len(TEMPLATES)} = 1",
    "store_findings": f"SELECT * FROM {expected_sql('doc_id % 10 <> 7')} x",
    "store_changes": f"SELECT * FROM (SELECT path, CASE WHEN doc_id % 10 = 7 THEN 'gone' WHEN doc_id % 10 = 8 THEN 'scan' ELSE {_HOW} END AS how FROM {paths_sql()} x) WHERE how <> 'stat'",
    "check_project": f"{_ALL} WHERE rule <> 'GL028' AND NOT starts_with(file, 'vendor/') AND NOT starts_with(file, 'web/') AND NOT starts_with(file, 'docs/')",
    "blank_comments": f"SELECT *, true AS same_length FROM ({blanked_sql()}) x",
}
