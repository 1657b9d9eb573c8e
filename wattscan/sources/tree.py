"""Python data sources of source trees: the files of now, and what changes from one look to the next.

Both prune folders before they open them and keep dot-files, which Spark's own sources skip. Paths come in their normal
form: below ``.`` they have no ``./``.
"""

from __future__ import annotations

import gzip
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

from wattscan.functions.paths import normal_path
from wattscan.operators.globs import PRUNED, ignored_path, prunable

#: Files of a chunk, and folders that the driver looks into; those below are walked in the tasks.
CHUNK, LOOKED = 500, 256


class Chunk(InputPartition):
    def __init__(self, files: list[str], folders: list[str]):
        self.files, self.folders = files, folders


def kind_of(path: str) -> str:
    """What rules go by: the suffix with its dot, or the whole name ``Dockerfile``; empty without either."""
    name = path.rpartition("/")[2]
    stem, dot, suffix = name.rpartition(".")
    return name if name == "Dockerfile" else dot + suffix if stem and suffix else ""


def child(folder: str, name: str) -> str:
    return name if folder == "." else f"{folder.rstrip('/')}/{name}"


def listed(folder: str, ignore: list[str], cwd: str = "") -> tuple[list[str], list[str]]:
    """Files and folders in a folder that no glob rules out. Folder links aren't followed; what can't be read is skipped.

    A relative folder is looked for in ``cwd``, and what is found is relative too.
    """
    bases, files, folders = prunable(ignore), [], []
    try:
        with os.scandir(os.path.join(cwd, folder)) as entries:
            for e in sorted(entries, key=lambda e: e.name):
                path = child(folder, e.name)
                if e.is_dir(follow_symlinks=False):
                    if e.name not in PRUNED and not ignored_path(path, bases):
                        folders.append(path)
                elif not e.is_dir() and e.is_file() and not ignored_path(path, ignore):
                    files.append(path)
    except OSError:
        return [], []
    return files, folders


def walk(root: str, ignore: list[str], cwd: str = "") -> Iterator[str]:
    """Files under a root, or the root if it is a file."""
    root = normal_path(root)
    if os.path.isfile(os.path.join(cwd, root)):
        if not ignored_path(root, ignore):
            yield root
        return
    stack = [root]
    while stack:
        files, folders = listed(stack.pop(), ignore, cwd)
        yield from files
        stack += folders


_COMPARE = {EqualTo: lambda x, v: x == v, EqualNullSafe: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, In: lambda x, v: x in v, StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x}
#: Known before a file is opened; never null.
EARLY = ("path", "name", "kind", "size", "mtime_ns")


def keeps(wanted, row: dict) -> bool:
    """Whether a file may stay by one filter on what is known before it is opened."""
    if isinstance(wanted, Not):
        return not keeps(wanted.child, row)
    if isinstance(wanted, IsNotNull):
        return True
    return _COMPARE[type(wanted)](row[wanted.attribute[0]], wanted.value)


def early(wanted) -> bool:
    """Whether a filter can be decided before a file is opened."""
    if isinstance(wanted, Not):
        return not isinstance(wanted.child, (Not, IsNotNull)) and early(wanted.child)
    value = getattr(wanted, "value", "")
    plain = not (value is None or isinstance(value, (list, tuple)) and None in value)
    return type(wanted) in {*_COMPARE, IsNotNull} and len(wanted.attribute) == 1 and wanted.attribute[0] in EARLY and plain


def opened(path: str) -> str:
    """The text of a file: malformed UTF-8 replaced, line ends unified."""
    with open(path, encoding="utf-8", errors="replace") as f:
        return f.read()


def roots(options) -> list[str]:
    return [normal_path(p) for p in (json.loads(options["paths"]) if "paths" in options else [options["path"]])]


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.paths = roots(options)
        self.ignore = json.loads(options.get("ignore", "[]"))
        self.most = int(options["max_bytes"]) if options.get("max_bytes") else None
        self.cwd = options.get("cwd", "")
        self.filters: list = []

    def partitions(self):
        """Chunks of the files in the upper folders, and a chunk for each folder below; overlapping roots count twice, as asked."""
        is_file = {p: os.path.isfile(os.path.join(self.cwd, p)) for p in self.paths}
        files, folders = [p for p in self.paths if is_file[p] and not ignored_path(p, self.ignore)], [p for p in self.paths if not is_file[p]]
        for _ in range(LOOKED):
            if not folders:
                break
            found, below = listed(folders.pop(0), self.ignore, self.cwd)
            files += found
            folders += below
        chunks = [Chunk(files[i : i + CHUNK], []) for i in range(0, len(files), CHUNK)] + [Chunk([], [x]) for x in folders]
        return chunks or [Chunk([], [])]

    def read(self, part):
        for path in (p for root in (*part.files, *part.folders) for p in walk(root, self.ignore, self.cwd)):
            place = os.path.join(self.cwd, path)
            try:
                stat = os.stat(place)
                row = {"path": path, "name": path.rpartition("/")[2], "kind": kind_of(path), "size": stat.st_size, "mtime_ns": stat.st_mtime_ns}
                if all(keeps(f, row) for f in self.filters):
                    text = opened(place) if self.most is None or stat.st_size <= self.most else None
                    yield path, text, stat.st_mtime_ns, stat.st_size, row["name"], row["kind"]
            except OSError:
                continue


class FilteringTreeReader(TreeReader):
    def pushFilters(self, filters):
        """Filters on path, name, kind, size and time are decided here, before a file is opened; the others stay with Spark."""
        for wanted in filters:
            if early(wanted):
                self.filters.append(wanted)
            else:
                yield wanted


class TreeSource(DataSource):
    """``spark.dataSource.register(TreeSource)``, then ``spark.read.format("source_tree").load(root)``.

    Relative paths start at the option ``cwd``, by default at the folder in which Spark was started. Files of any size are read. With the option ``max_bytes`` a larger file is a row whose text is null and which isn't opened (-1: any file). With the option
    ``pushdown`` filters on what is known before a file is opened (path, name, kind, size, mtime_ns) reach the reader; Spark
    then wants ``spark.sql.python.filterPushdown.enabled`` set.
    """

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return "path string, text string, mtime_ns long, size long, name string, kind string"

    def reader(self, schema):
        return (FilteringTreeReader if self.options.get("pushdown") == "true" else TreeReader)(self.options)


class ChangeChunk(InputPartition):
    def __init__(self, rows: list[tuple[str, int, bool]]):
        self.rows = rows  # path, version, deleted


class Looks:
    """What was seen at each look at a tree, kept in a folder: one whole list, and what each later look found changed.

    A list holds ``[path, mtime_ns, size]``; size is null where the file is gone.
    """

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(x.split("-")[1].split(".")[0]) for x in os.listdir(self.folder) if x.startswith(f"{kind}-") and x.endswith(".json.gz"))

    def _path(self, kind: str, number: int) -> str:
        return f"{self.folder}/{kind}-{number}.json.gz"

    def _read(self, kind: str, number: int) -> list:
        with gzip.open(self._path(kind, number), "rt", encoding="utf-8") as f:
            return [json.loads(line) for line in f]

    def _write(self, kind: str, number: int, rows) -> None:
        """Whole or not at all."""
        path = self._path(kind, number)
        with gzip.open(path + ".new", "wt", encoding="utf-8") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        os.replace(path + ".new", path)

    def last(self) -> int:
        return max([*self._numbers("whole"), *self._numbers("changed")], default=0)

    def changed(self, number: int) -> list:
        return self._read("changed", number)

    def known(self, upto: int) -> dict[str, tuple[int, int]]:
        """``path -> (mtime_ns, size)`` as of a look."""
        start = max([n for n in self._numbers("whole") if n <= upto], default=0)
        found = {p: (t, s) for p, t, s in self._read("whole", start)} if start else {}
        for n in self._numbers("changed"):
            if start < n <= upto:
                for path, mtime, size in self.changed(n):
                    if size is None:
                        found.pop(path, None)
                    else:
                        found[path] = mtime, size
        return found

    def look(self, files: dict[str, tuple[int, int]]) -> int:
        """Record a look; the number of the last one that found a change."""
        number = self.last()
        before = self.known(number)
        rows = [[p, *now] for p, now in files.items() if before.get(p) != now] + [[p, 0, None] for p in before if p not in files]
        if rows:
            number += 1
            self._write("changed", number, rows)
        return number

    def forget(self, upto: int) -> None:
        """Fold the looks up to one that is done with into the whole list."""
        if upto not in self._numbers("changed"):
            return
        self._write("whole", upto, [[p, *x] for p, x in self.known(upto).items()])
        for kind, most in (("whole", upto - 1), ("changed", upto)):
            for n in self._numbers(kind):
                if n <= most:
                    os.remove(self._path(kind, n))


class TreeChangeReader(DataSourceStreamReader):
    def __init__(self, options):
        self.paths = roots(options)
        self.ignore, self.kinds = json.loads(options.get("ignore", "[]")), json.loads(options.get("kinds", "null"))
        self.most = int(options["max_bytes"]) if options.get("max_bytes") else None
        self.cwd, self.state = options.get("cwd", ""), options["state"]

    def _now(self) -> dict[str, tuple[int, int]]:
        found = {}
        for path in (p for root in self.paths for p in walk(root, self.ignore, self.cwd)):
            try:
                stat = os.stat(os.path.join(self.cwd, path))
            except OSError:
                continue
            if (self.kinds is None or kind_of(path) in self.kinds) and (self.most is None or stat.st_size <= self.most):
                found[path] = stat.st_mtime_ns, stat.st_size
        return found

    def initialOffset(self):
        return {"look": 0}

    def latestOffset(self):
        return {"look": Looks(self.state).look(self._now())}

    def partitions(self, start, end):
        looks, last = Looks(self.state), {}
        for n in range(start["look"] + 1, end["look"] + 1):
            last.update((path, (path, n, size is None)) for path, _, size in looks.changed(n))
        rows = sorted(last.values())
        return [ChangeChunk(rows[i : i + CHUNK]) for i in range(0, len(rows), CHUNK)]

    def read(self, part):
        for path, version, deleted in part.rows:
            text = None
            if not deleted:
                try:
                    text = opened(os.path.join(self.cwd, path))
                except OSError:
                    continue  # gone since; the next look finds that
            yield path, version, text, deleted

    def commit(self, end):
        Looks(self.state).forget(end["look"])


class TreeChangeSource(DataSource):
    """``readStream.format("source_tree_changes")``: files made, edited (by time or size) and deleted since the last look.

    The option ``state`` names the folder, on a disk that the driver keeps, which remembers the looks; Spark's checkpoint
    holds only their numbers, so a restarted query goes on where it was. ``paths``, ``ignore`` and ``cwd`` are as for ``source_tree``;
    ``kinds`` is a list of suffixes (or ``Dockerfile``), other files and those over ``max_bytes`` count as not there. The
    driver lists the tree (about 200 bytes a file), tasks read the texts.
    """

    @classmethod
    def name(cls):
        return "source_tree_changes"

    def schema(self):
        return "path string, version long, text string, deleted boolean"

    def streamReader(self, schema):
        return TreeChangeReader(self.options)
