"""One scan from end to end: configuration, excludes, source, rules, baseline, report and exit code."""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattscan.operators import baseline, globs, summary
from wattscan.operators.rules import RULES, languages
from wattscan.operators.scan import ordered, scan
from wattscan.sources.config import Config, load_config
from wattscan.sources.tree import TreeSource

BASELINE = ".wattscan-baseline.json"


@dataclass
class Outcome:
    findings: DataFrame
    accepted: DataFrame  # findings that the baseline hides
    baseline: str

    def exit_code(self, fail_on_findings: bool = False) -> int:
        return summary.exit_code(self.findings, fail_on_findings)

    def report(self, kind: str = "text", cost: str = "") -> DataFrame:
        """Lines in order: ``text``, ``json``, ``github`` or ``html``; ``cost`` is what the scan took, for the head of a page."""
        if kind == "github":
            return ordered(summary.github_lines(self.findings)).select("text")
        made = {"text": lambda f: summary.text_report(f, self.accepted.count(), self.baseline), "json": summary.json_report, "html": lambda f: summary.html_report(f, cost=cost)}
        return summary.in_order(made[kind](self.findings))


def tree(spark: SparkSession, paths: list[str], ignore: list[str]) -> DataFrame:
    """Files below the paths that some rule may apply to, without what the globs rule out; others are never opened.

    Filters are pushed into the source, which Spark has to be told to do.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").options(paths=json.dumps(paths), ignore=json.dumps(ignore), cwd=os.getcwd(), pushdown="true").load().where(F.col("kind").isin(languages()))


def split(found: DataFrame, baseline_path: str | None = None) -> Outcome:
    """Findings by whether the baseline has them. One that is named must exist; the default one may."""
    path = baseline_path or BASELINE
    accepted = baseline.read_baseline(found.sparkSession, path, named=baseline_path is not None)
    root = os.path.dirname(path)
    hidden = baseline.fingerprinted(found, root).join(accepted.distinct(), "fingerprint", "left_semi")
    return Outcome(baseline.apply_baseline(found, accepted, root), hidden, path)


def check(files: DataFrame, config: Config | None = None, exclude: list[str] | None = None, baseline_path: str | None = None) -> Outcome:
    """Findings of a table of files (``path, text``), split by the baseline. Excludes are added to the configuration's globs."""
    config = config or Config()
    return split(scan(files, disable=config.disable, ignore=tuple(globs.union(config.ignore, exclude or []))), baseline_path)


# --- the command line

#: What can be asked for; names and meanings are fixed values.
OPTIONS: dict[str, dict] = {
    "paths": {"nargs": "*", "help": "files and folders, by default this folder"},
    "--config": {"help": "configuration file"},
    "--exclude": {"action": "append", "default": [], "metavar": "GLOB", "help": "more globs to skip; may be repeated"},
    "--format": {"choices": ["text", "json", "github", "html"], "default": "text"},
    "--baseline": {"metavar": "FILE", "help": "accepted findings; the file must exist"},
    "--write-baseline": {"nargs": "?", "const": BASELINE, "metavar": "FILE", "help": "accept all findings of now"},
    "--fail-on-findings": {"action": "store_true"},
    "--list-rules": {"action": "store_true"},
    "--store": {"metavar": "FOLDER", "help": "remember the scan there, so that the next one opens only what changed"},
}


class Command:
    """What the options ask for. Spark starts when an action first needs it."""

    def __init__(self, options: argparse.Namespace, spark: SparkSession | None):
        self.options, self._spark = options, spark
        self.paths = options.paths or ["."]
        self.cost = ""

    @property
    def spark(self) -> SparkSession:
        self._spark = self._spark or SparkSession.builder.appName("wattscan").getOrCreate()
        return self._spark

    def findings(self) -> DataFrame:
        """Of the paths, or of the store brought up to the only path."""
        config = load_config(self.options.config)
        if self.options.store is None:
            ignore = globs.union(config.ignore, self.options.exclude)
            return scan(tree(self.spark, self.paths, ignore), disable=config.disable, ignore=tuple(ignore))
        from wattscan.session import Session

        if len(self.paths) > 1:
            raise SystemExit("a store is for one path")
        session = Session(self.spark, self.paths[0], self.options.store, self.options.config)
        session.configure(self.options.exclude)
        self.cost = session.scan_project().cost
        return session.store.findings()

    def list_rules(self) -> int:
        for r in RULES:
            print(f"{r.id} [{r.severity:6s}] ({', '.join(sorted(r.langs))}): {r.message}")
        return 0

    def write_baseline(self) -> int:
        target = self.options.write_baseline
        print(f"wattscan: {baseline.write_baseline(self.findings(), target, os.path.dirname(target))} finding(s) accepted in {target}")
        return 0

    def report(self) -> int:
        outcome = split(self.findings(), self.options.baseline)
        for row in outcome.report(self.options.format, self.cost).toLocalIterator():
            print(row.text)
        if self.cost and self.options.format == "text":
            print(f"wattscan:{self.cost}")
        return outcome.exit_code(self.options.fail_on_findings)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """The command line; returns the exit code."""
    parser = argparse.ArgumentParser(prog="wattscan", description=__doc__)
    for name, settings in OPTIONS.items():
        parser.add_argument(name, **settings)
    command = Command(parser.parse_args(argv), spark)
    asked = [action for action in ("list_rules", "write_baseline") if getattr(command.options, action)]
    return getattr(command, (asked or ["report"])[0])()


if __name__ == "__main__":
    sys.exit(main())
