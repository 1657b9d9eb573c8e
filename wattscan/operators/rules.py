"""The rule table. Ids, severities, languages, patterns and messages are fixed values; suggestions are prose."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattscan.functions.text import dialect, kind, with_parts

SEVERITIES = ["high", "medium", "low"]
HOT = "worth it only where the code runs often: about 1 g for 500 core-seconds saved"
GB = "about 15 g for each GB not moved"


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    langs: tuple[str, ...]
    kind: str  # regex, block or tree
    message: str
    suggestion: str
    hint: str
    pattern: str | None = None
    flags: str = ""

    @property
    def java(self) -> str:
        return dialect(self.pattern, self.flags)


def _r(i, severity, langs, kind, message, suggestion, hint, pattern=None, flags=""):
    return Rule(f"GL{i:03d}", severity, tuple(langs.split()), kind, message, suggestion, hint, pattern, flags)


_C, _TF, _YML, _DOCKER = ".c .h .cpp .cc .hpp", ".tf .tofu", ".yml .yaml", ".dockerfile Dockerfile"
_EACH = r"for\s+\w+\s+in\s+[^:\n]+:\n[ \t]+"
_LOOP = r"(?:for|while)\s*\([^\n]*\)\s*\{?\s*\n[ \t]*[^\n]*\b"

# Rule table.
RULES = [
    _r(1, "medium", ".py", "tree", "busy loop without sleep", "wait for an event, or sleep and back off", "a pegged core draws some 150-200 g a day"),
    _r(2, "low", f".py .js .ts .sh .go .rs .java .php .pl {_C} .kt .swift .cs", "regex", "sub-100ms polling interval", "poll less often, or let the other side push", "10-40 g a day for each instance kept awake",
       r"setInterval\s*\(\s*[^,]+,\s*([0-9]{1,2})\s*\)|time\.sleep\s*\(\s*0?\.0+[0-9]\s*\)|sleep\s+0?\.0+[0-9]\b|time\.Sleep\(\s*[0-9]{1,2}\s*\*\s*time\.Millisecond\s*\)|thread::sleep\(\s*Duration::from_millis\(\s*[0-9]{1,2}\s*\)\s*\)|Thread\.sleep\(\s*[0-9]{1,2}\s*\)|usleep\(\s*[0-9]{1,5}\s*\)|\bdelay\(\s*[0-9]{1,2}\)|Timer\.scheduledTimer\(withTimeInterval:\s*0?\.0+[0-9]"),
    _r(3, "high", _YML, "regex", "cron job scheduled every minute", "run it as seldom as the task allows", "1 g for 500 core-seconds; a 2 s job is about 6 g a day", r"(?:cron|schedule):\s*['\"]?\*\s+\*\s+\*\s+\*\s+\*"),
    _r(4, "medium", _YML, "block", "full git history clone in CI", "clone shallowly unless a tool reads the history", GB),
    _r(5, "medium", f".sql .py .php .go .js .ts .rs .java {_C} .pl .sh", "regex", "SELECT * query", "name the columns you need", f"{GB}; {HOT}", r"SELECT\s+\*\s+FROM", "i"),
    _r(6, "medium", _DOCKER, "regex", "full-fat base image", "start from a slim, alpine or distroless image", f"{GB}, per pull", r"^FROM\s+(?:ubuntu|debian)(?::|\s|$)(?!.*slim)", "mi"),
    _r(7, "low", ".py", "tree", "quadratic rebuild in a loop (whole sequence copied each iteration)", "append to a list and join once after the loop", HOT),
    _r(8, "high", _TF, "regex", "very large instance type hardcoded", "size by measured use, or scale automatically", "70-300 g a day for each oversized instance", r'instance_type\s*=\s*"(?:m|c|r)[0-9]\.(?:8|12|16|24)xlarge"'),
    _r(9, "low", _DOCKER, "regex", "apt-get install without --no-install-recommends", "leave recommended packages out", f"{GB}, per pull", r"apt-get\s+install(?!.*--no-install-recommends)[^\n]*", "i"),
    _r(10, "low", _DOCKER, "regex", "pip install without --no-cache-dir", "keep the wheel cache out of the layer", f"{GB}, per pull", r"pip3?\s+install(?!.*--no-cache-dir)[^\n]*", "i"),
    _r(11, "low", ".html", "regex", "img tag missing lazy loading", "let images below the fold load lazily", f"{GB}; an unseen 200 KB image is 0.003 g a view", r"<img\b(?![^>]*\bloading=)[^>]*>", "i"),
    _r(12, "medium", ".py", "regex", "database query executed inside a loop (N+1 pattern)", "ask once for all rows", HOT, _EACH + r"\S*\.execute\(", "m"),
    _r(13, "low", _TF, "block", "S3 bucket without a lifecycle policy", "expire old objects or move them to colder storage", "0.5 g a month for each GB kept hot"),
    _r(14, "medium", _YML, "block", "Kubernetes workload without CPU/memory requests or limits", "state requests and limits so pods pack well", "150-600 g a day if it costs a node, else nothing"),
    _r(15, "medium", _DOCKER, "regex", "base image pinned to an end-of-life runtime/OS version", "move to a supported release", f"{GB}, per pull",
       r"^FROM\s+(?:python:2(?:\.\d+)?\b|node:(?:6|8|10|12|14)(?:\.\d+)*(?:-\w+)?\b|ubuntu:(?:14\.04|16\.04|18\.04)\b|debian:(?:7|8|9|wheezy|jessie|stretch)\b|centos:(?:6|7)\b)", "mi"),
    _r(16, "low", _TF, "regex", "x86 instance family with an ARM/Graviton equivalent available", "try the ARM family of the same size", "80-350 g a day for each instance", r'instance_type\s*=\s*"(?:t2|t3|m4|m5|c4|c5|r4|r5)\.[a-z0-9]+"', "i"),
    _r(17, "low", ".html .css", "regex", "GIF referenced for image/animation", "use a video or a modern image format", f"{GB}; a 5 MB GIF as video saves 0.07 g a view", r"""(?:<img\b[^>]*\bsrc\s*=\s*["']|url\(\s*["']?)[^"'\)\s]+\.gif\b""", "i"),
    _r(18, "low", ".py", "tree", "nested loop iterating over the same collection (possible O(n²) pattern)", "look members up in a set or use combinations", HOT),
    _r(19, "medium", ".py", "regex", "HTTP request executed inside a loop (N+1-style network calls)", "batch the calls or share one session", HOT, _EACH + r"(?:\w+\s*=\s*)?requests\.(?:get|post|put|patch|delete)\(", "m"),
    _r(20, "low", ".py", "regex", "logging call built eagerly with an f-string or .format()", "pass the values as arguments", HOT, r"""logging\.(?:debug|info)\(\s*(?:f['"]|['"][^'"]*['"]\s*\.\s*format\()"""),
    _r(21, "medium", ".py", "regex", "row-wise pandas iteration (iterrows/apply(axis=1))", "work on whole columns", HOT, r"\.iterrows\(\)|\.apply\([^)]*axis\s*=\s*1"),
    _r(22, "low", ".py", "regex", "file opened/read inside a loop", "read once before the loop", HOT, _EACH + r"(?:\w+\s*=\s*)?(?:open\(|pd\.read_csv\(|pd\.read_json\()", "m"),
    _r(23, "medium", ".py", "tree", "nested loop with an element swap (manual O(n²) sort)", "call the built-in sort", HOT),
    _r(24, "medium", _TF, "block", "autoscaling group with min_size == max_size", "leave room to scale down", "50-200 g a day for each idle instance"),
    _r(25, "low", _TF, "regex", "EBS volume using gp2 instead of gp3", "use gp3 volumes", "1-10 g a day for each volume, weakly grounded", r'volume_type\s*=\s*"gp2"'),
    _r(26, "medium", _TF, "block", "CloudWatch log group without a retention period", "set a retention period", "0.5 g a month for each GB of logs"),
    _r(27, "low", ".js .ts", "regex", "static assets served without a cache duration (Express)", "send a cache duration", GB, r"express\.static\([^,)]*\)"),
    _r(28, "low", ".py", "regex", "wildcard import", "import the names you use", HOT, r"^from\s+\S+\s+import\s+\*", "m"),
    _r(29, "low", _DOCKER, "block", "separate RUN install layer (image layer bloat)", "chain installs in one RUN", f"{GB}, per pull"),
    _r(30, "low", ".py", "tree", "dict .items() iteration discards the key or value", "iterate keys or values alone", HOT),
    _r(31, "low", ".py", "tree", "exception swallowed every iteration (exceptions as control flow)", "test before you act", HOT),
    _r(32, "medium", _C, "regex", "heap allocation inside a loop", "allocate before the loop and reuse", HOT, _LOOP + r"(?:malloc|calloc|realloc)\s*\(|" + _LOOP + r"new\s+\w", "m"),
    _r(33, "medium", _YML, "block", "HorizontalPodAutoscaler with minReplicas == maxReplicas", "leave room to scale down", "50-200 g a day for each idle replica"),
    _r(34, "medium", _YML, "block", "docker-compose service(s) without resource limits", "limit memory and processors", "150-600 g a day if it costs a host, else nothing"),
    _r(35, "low", ".cs", "regex", "LINQ .Count() used just to check emptiness", "ask Any()", HOT, r"\.Count\(\)\s*(?:==\s*0|!=\s*0|>\s*0)"),
    _r(36, "low", ".rb", "regex", "Hash membership check via keys/values.include?", "ask key? or value?", HOT, r"\.(?:keys|values)\.include\?\("),
    _r(37, "low", ".rb", "regex", "select().map() chain (two passes over the collection)", "use filter_map", HOT, r"\.select\s*(?:\(&:\w+[?!]?\)|\{[^{}]*\})\s*\.map\s*(?:\(&:\w+[?!]?\)|\{[^{}]*\})"),
    _r(38, "low", ".jsx .tsx", "regex", "inline function or object literal passed as a JSX prop", "hoist it or memoise it", HOT, r"(?<!\w)\w++=\{(?:\(\)\s*=>|\{)"),
]
BY_ID = {r.id: r for r in RULES}
#: Order of findings on one line: tree rules, Terraform, YAML, Docker, then the others by id.
EMIT = {i: n for n, i in enumerate([f"GL{i:03d}" for i in (1, 7, 18, 23, 30, 31, 13, 24, 26, 4, 14, 33, 34, 29)] + [r.id for r in RULES if r.kind == "regex"])}
#: Rules that spare test files.
SPARED = ("GL001", "GL002", "GL007")


def languages() -> list[str]:
    return sorted({x for r in RULES for x in r.langs})


def checked(rule: Rule, known) -> Rule:
    """A rule of one's own: a new id, a known severity and a pattern, which must not match the empty string."""
    if rule.id in known:
        raise ValueError(f"{rule.id} is already a rule")
    if rule.severity not in SEVERITIES or rule.kind != "regex" or not rule.pattern:
        raise ValueError("a rule of one's own has a known severity and a pattern")
    return rule


def register_rule(rule: Rule) -> None:
    """Add a rule to all later scans of this process; ``scan(..., own=(rule,))`` is for one scan."""
    checked(rule, BY_ID)
    RULES.append(rule)
    BY_ID[rule.id], EMIT[rule.id] = rule, max(EMIT.values()) + 1


def drop_rule(rule_id: str) -> None:
    """Take a registered rule away again."""
    RULES.remove(BY_ID.pop(rule_id))
    del EMIT[rule_id]


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r.id, r.severity, list(r.langs), r.kind, r.message, r.suggestion, r.hint, EMIT[r.id]) for r in RULES], "rule string, severity string, langs array<string>, mechanism string, message string, suggestion string, co2e_estimate string, emit int")


def languages_of(files: DataFrame) -> DataFrame:
    """``language, files``: every suffix or name that some rule is for, with how many of the files have it."""
    spark = files.sparkSession
    known = spark.createDataFrame([(x,) for x in languages()], "language string")
    counts = with_parts(files.select("path")).groupBy(kind().alias("language")).agg(F.count(F.lit(1)).alias("n"))
    return known.join(counts, "language", "left").select("language", F.coalesce("n", F.lit(0)).alias("files"))


def rules_of(files: DataFrame) -> DataFrame:
    """The rule table with ``files``: how many of the files each rule applies to."""
    table = rules_table(files.sparkSession)
    counts = table.select("rule", F.explode("langs").alias("language")).join(languages_of(files), "language").groupBy("rule").agg(F.sum("files").alias("files"))
    return table.join(counts, "rule")
