"""A sink for reports: every task writes its part of the findings, the commit adds what stands around and between them."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.taskcontext import TaskContext

from wattscan.operators.scan import ordered
from wattscan.operators.summary import rendered

#: By kind of report: what stands first, between two findings, behind the last one, and all of one without findings.
AROUND = {"json": ("[\n", ",\n", "\n]\n", "[]\n"), "github": ("", "\n", "\n", ""), "text": ("", "\n", "\n\nwattscan: {n} finding(s)\n", "\nwattscan: 0 finding(s)\n")}


@dataclass
class Part(WriterCommitMessage):
    number: int
    rows: int
    path: str


class ReportWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.kind, self.overwrite = options["path"], options.get("kind", "text"), overwrite
        if self.kind not in AROUND:
            raise ValueError(f"kind must be one of {sorted(AROUND)}")
        self.run = uuid.uuid4().hex

    def write(self, iterator):
        """One task's findings, joined; each attempt has a file of its own."""
        context = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        path, n = f"{self.path}/.{self.run}-{context.partitionId():06d}-{context.taskAttemptId()}", 0
        with open(path, "w", encoding="utf-8") as f:
            for row in iterator:
                f.write((AROUND[self.kind][1] if n else "") + row.text)
                n += 1
        return Part(context.partitionId(), n, path)

    def commit(self, messages) -> None:
        """Give the parts their places. Files in the order of their names are the report."""
        first, between, last, empty = AROUND[self.kind]
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        full, n = [p for p in parts if p.rows], sum(p.rows for p in parts)
        os.makedirs(self.path, exist_ok=True)
        old = [x for x in os.listdir(self.path) if x.startswith("report-")]
        if old and not self.overwrite:
            raise FileExistsError(f"{self.path} holds a report")
        for name in old:
            os.remove(f"{self.path}/{name}")
        for i, part in enumerate(full):
            self._put(2 * i, first if i == 0 else between)
            os.replace(part.path, f"{self.path}/report-{2 * i + 1:07d}")
        self._put(2 * len(full), last.format(n=n) if full else empty.format(n=n))
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _put(self, number: int, text: str) -> None:
        with open(f"{self.path}/report-{number:07d}", "w", encoding="utf-8") as f:
            f.write(text)

    def _clear(self) -> None:
        """Empty parts, and those of attempts that didn't count."""
        for name in os.listdir(self.path) if os.path.isdir(self.path) else []:
            if name.startswith(f".{self.run}-"):
                os.remove(f"{self.path}/{name}")


class ReportSink(DataSource):
    """``df.write.format("findings_report").option("kind", "json").mode("overwrite").save(folder)``.

    ``df`` has one column, ``text``, a finding's, in order. The folder must be one that driver and executors all mount.
    """

    @classmethod
    def name(cls):
        return "findings_report"

    def writer(self, schema, overwrite):
        return ReportWriter(self.options, overwrite)


def write_findings(findings: DataFrame, folder: str, kind: str = "text") -> None:
    """Write a report of ``kind`` ``json``, ``text`` or ``github``: one pass over the findings, no count or first row beforehand."""
    findings.sparkSession.dataSource.register(ReportSink)
    ordered(rendered(findings, kind)).select("text").write.format("findings_report").option("kind", kind).mode("overwrite").save(folder)


def read_report(folder: str):
    """The pieces of a report in order; together they are one document."""
    for name in sorted(x for x in os.listdir(folder) if x.startswith("report-")):
        with open(f"{folder}/{name}", encoding="utf-8") as f:
            yield f.read()
