"""All rules over a table of files, in one projection: no shuffle, one explode.

Input is ``path, text``; output is ``rule, severity, file, line, message, suggestion, co2e_estimate, emit_rank``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattscan.functions.literals import folded, required
from wattscan.functions.text import NO_LINES, blank_comments, dialect, first_line, kind, match_lines, once, quoted, with_parts
from wattscan.operators.globs import ignored
from wattscan.operators.pyfacts import fact_array
from wattscan.operators.rules import BY_ID, EMIT, RULES, SEVERITIES, SPARED, Rule, checked, languages

FINDING = ["rule", "severity", "file", "line", "message", "suggestion", "co2e_estimate"]
#: Tools that need the whole history.
HISTORY = r"gitleaks|trufflehog|sonar|codecov|scorecard|release-please|semantic-release|git-cliff|gitversion|conventional-changelog|git\s+log|git\s+describe|goreleaser|gandalf|merge-base"
LIMITS = r"mem_limit|nano_cpus|cpus\s*:|memory\s*:"  # fixed values
TEST_NAME = r"(?i)(?u)(^test_|_test\.|\.test\.|\.spec\.|_spec\.)"  # fixed values
TEST_DIRS = ("test", "tests", "spec", "specs")  # fixed values
#: What a text must hold for a rule without a pattern of its own.
KEYS = {"GL001": ("while",), "GL004": ("fetch-depth:",), "GL013": ("resource",), "GL014": ("kind:",), "GL024": ("resource",), "GL026": ("resource",), "GL029": ("install",), "GL033": ("HorizontalPodAutoscaler",), "GL034": ("services:",)}
LOOPS = ("for", "while")
NO_FINDINGS = "cast(array() AS array<struct<rule:string,line:int,emit_rank:int>>)"


def _applies(rule: Rule) -> str:
    fits = [f"suffix IN ({', '.join(quoted(x) for x in rule.langs)})"] if rule.langs else ["false"]
    return f"({' OR '.join([*fits, *["name = 'Dockerfile'"] * ('Dockerfile' in rule.langs)])})"


def applicable(rule: Rule) -> Column:
    return F.expr(_applies(rule))


def needs(rule: Rule) -> tuple[tuple[str, ...], bool]:
    """Literals of which every match of a rule holds one (every text holds the empty one), and whether case doesn't count."""
    if rule.kind == "regex":
        return required(rule.pattern, rule.flags) or ("",), "i" in rule.flags
    return KEYS.get(rule.id, LOOPS), rule.id == "GL029"


def _possible(rule: Rule) -> str:
    literals, bare = needs(rule)
    return f"({' OR '.join(f'contains({"low" if bare else "code"}, {quoted(x)})' for x in literals)})"


def any_possible(rules: list[Rule], text: str) -> Column:
    """Whether a text, or ``low``, holds what some rule for its kind of file needs: the literals of all these rules in one list."""
    found = ["false"]
    for bare in (False, True):
        lists: dict[str, dict[str, None]] = {}
        for r in rules:
            literals, is_bare = needs(r)
            for lang in r.langs if is_bare == bare else ():
                lists.setdefault(lang, {}).update(dict.fromkeys(literals))
        if lists:
            pairs = ", ".join(f"{quoted(k)}, array({', '.join(map(quoted, v))})" for k, v in lists.items())
            of_kind = f"try_element_at(map({pairs}), if(name = 'Dockerfile', name, suffix))"
            found.append(f"coalesce(exists({of_kind}, x -> contains({'low' if bare else text}, x)), false)")
    return F.expr(" OR ".join(found))


def is_test_file() -> Column:
    return F.expr(f"name RLIKE {quoted(TEST_NAME)} OR exists(dir_parts, d -> lower(d) IN ({', '.join(map(quoted, TEST_DIRS))}))")


def scannable(files: DataFrame) -> DataFrame:
    """``files`` with path parts, of which only those that some rule may apply to."""
    return with_parts(files).where(kind().isin(languages()))


def _lines(rows: str) -> str:
    return f"transform({rows}, row -> row.line)"


def _resource(kind: str, fails: str) -> str:
    """Lines of a Terraform resource's headers whose block (up to a closing line, or the end) fails; SQL, as all below."""
    header = rf'resource\s+"{kind}"\s+"[^"]+"\s*\{{'
    blocks = f"regexp_extract_all(code, {quoted(dialect(header + r'(?=((?:[^\n]++|\n(?!\}))*+))'))}, 1)"
    both = f"zip_with({match_lines('code', dialect(header))}, {blocks}, (line, block) -> struct(line, block))"
    return _lines(f"filter({both}, x -> {fails})")


def _same_number(text: str, low: str, high: str) -> str:
    a, b = (f"regexp_extract({text}, {quoted(dialect(x))}, 1)" for x in (low, high))
    return f"({a} <> '' AND {a} = {b})"


def _layers() -> str:
    """Install lines after the first of their build stage: stages and installs as one ordered list."""
    mark = dialect(r"^FROM\s+|^(?i:RUN)\s+.*\b(?i:apt(?:-get)?|pip3?|npm|yum)\s+(?i:install)\b", "m")
    both = f"zip_with({match_lines('code', mark)}, regexp_extract_all(code, {quoted(mark)}, 0), (line, found) -> struct(line, startswith(found, 'FROM') AS stage))"
    # The list holds stages and installs only, so an install right behind another one isn't its stage's first.
    later = "filter(marks, (x, i) -> NOT x.stage AND NOT coalesce(get(marks, i - 1).stage, true))"
    return f"get(transform(array({both}), marks -> {_lines(later)}), 0)"


def _history_clones() -> str:
    """Full clones outside comments in jobs that don't need the history. Jobs are cut by the indent of the first one."""
    key = quoted(dialect(r"^([ \t]+)[\w-]+:[ \t]*$"))
    head = f"regexp_extract(text, {quoted(dialect(r'(?s)\A.*?^jobs:[ \t]*$', 'm'))}, 0)"
    body = f"substring(text, length({head}) + 1, length(text))"
    indent = f"if({head} <> '', regexp_extract({body}, {quoted(dialect(r'^([ \t]+)[\w-]+:[ \t]*$', 'm'))}, 1), '')"
    # Split before each line that starts with the indent and a key; a marker takes the place of the line end.
    marked = f"array_join(transform(split({body}, '\\n'), x -> if(regexp_extract(x, {key}, 1) = {indent}, concat('\\0', x), x)), '\\n')"
    jobs = f"if({indent} <> '', concat(array({head}), split({marked}, '\\0')), array(text))"
    clone = dialect(r"fetch-depth:\s*0")
    # What stands before the first job, in a file cut into jobs, is judged by the whole file.
    whole = f"if(job.i = 0, text, job.part) RLIKE {quoted(dialect(HISTORY, 'i'))}"
    said = rf"coalesce(get(split(text, '\n'), line - 1), '') RLIKE {quoted(dialect(r'#.*fetch-depth:\s*0|#.*fetch-depth:\s*$'))}"
    own = f"filter(transform({match_lines('job.part', clone)}, line -> line + state.at), line -> NOT {said})"
    step = rf"named_struct('at', state.at + length(job.part) - length(translate(job.part, '\n', '')), 'lines', concat(state.lines, if({whole}, {NO_LINES}, {own})))"
    numbered = f"transform({jobs}, (part, i) -> struct(part, i))"
    return f"if(text RLIKE {quoted(clone)}, aggregate({numbered}, named_struct('at', 0, 'lines', {NO_LINES}), (state, job) -> {step}, state -> state.lines), {NO_LINES})"


def _tree(rule: str) -> str:
    """The syntax-tree rules, as semi and anti joins inside a file's own facts."""
    of = lambda kind, also="true": f"filter(facts, fact -> fact.kind = '{kind}' AND {also})"
    within = lambda x, loop: f"array_contains({x}.loops, {loop}.id)"
    if rule == "GL001":
        return _lines(f"filter({of('endless')}, w -> NOT exists({of('sleep')}, s -> {within('s', 'w')}) AND NOT exists({of('exit')}, e -> e.owner = w.id))")
    if rule == "GL007":
        harmless = "b.scope = a.scope AND b.name = a.name AND (b.flag = 'number' OR (b.flag = 'list' AND a.flag = 'in place'))"
        found = f"filter({of('accumulate')}, a -> a.flag <> 'list' AND NOT exists({of('binding')}, b -> {harmless}))"
    elif rule == "GL018":
        found = f"filter({of('for')}, x -> exists({of('for')}, o -> o.name = x.name AND {within('x', 'o')}))"
    elif rule == "GL023":
        found = f"filter({of('for')}, x -> exists({of('for')}, o -> {within('x', 'o')}) AND exists({of('swap')}, s -> {within('s', 'x')}))"
    elif rule == "GL030":
        return _lines(of("for", "fact.flag = 'discards'"))
    else:
        found = of("swallow")
    return f"array_distinct({_lines(found)})"


def _block(rule: str) -> str:
    if rule == "GL004":
        return _history_clones()
    if rule == "GL013":
        return _resource("aws_s3_bucket", "NOT contains(lower(x.block), 'lifecycle')")
    if rule == "GL024":
        return _resource("aws_autoscaling_group", _same_number("x.block", r"min_size\s*=\s*(\d+)", r"max_size\s*=\s*(\d+)"))
    if rule == "GL026":
        return _resource("aws_cloudwatch_log_group", "NOT contains(x.block, 'retention_in_days')")
    if rule == "GL014":
        return f"if((contains(code, '{{{{') AND contains(code, '}}}}')) OR contains(code, 'resources:'), {NO_LINES}, {first_line('code', dialect(r'^kind:\s*(Deployment|StatefulSet|DaemonSet|Pod)\s*$', 'm'))})"
    if rule == "GL033":
        fixed = f"code RLIKE {quoted(dialect(r'^kind:\s*HorizontalPodAutoscaler\s*$', 'm'))} AND {_same_number('code', r'minReplicas:\s*(\d+)', r'maxReplicas:\s*(\d+)')}"
        return f"if({fixed}, {first_line('code', dialect(r'minReplicas:\s*(\d+)'))}, {NO_LINES})"
    if rule == "GL034":
        return f"if(code RLIKE {quoted(dialect(LIMITS))}, {NO_LINES}, {first_line('code', dialect(r'^services:\s*$', 'm'))})"
    return _layers()


def rule_lines(rule: Rule) -> str:
    """SQL for the lines of a rule's findings in one file."""
    found = {"regex": lambda: match_lines("code", rule.java), "block": lambda: _block(rule.id), "tree": lambda: _tree(rule.id)}[rule.kind]()
    fits = _applies(rule)
    if rule.id in SPARED:
        fits += " AND NOT is_test"
    if rule.kind != "tree":  # facts are an array already
        fits += f" AND {_possible(rule)}"
    return f"if({fits}, {found}, {NO_LINES})"


def prepared(files: DataFrame, rules: list[Rule] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scannable files with ``code`` (comments and docstrings blanked), ``low``, ``facts`` and ``is_test``, and the columns ``keep``.

    Files that hold nothing that any of the rules needs are left out before their comments are sought.
    """
    rows = with_parts(files.select("path", "text", *keep).where(F.col("text").isNotNull())).where(kind().isin(sorted({x for r in rules for x in r.langs})))
    bare = sorted({x for r in rules if needs(r)[1] for x in r.langs})
    low = lambda text: F.when(kind().isin(bare), folded(F.col(text))).otherwise("")
    rows = once(rows.withColumn("low", low("text"))).where(any_possible(rules, "text"))
    rows = once(rows.withColumns({"code": blank_comments(), "is_test": is_test_file()}))
    # Facts come from the blanked code: comments aren't part of a tree.
    trees = [r for r in rules if ".py" in r.langs]
    needed = (F.col("suffix") == ".py") & any_possible(trees, "code")
    facts = fact_array(F.when(needed, F.col("code"))) if trees else F.expr("cast(array() AS array<struct<kind:string,first:int,last:int>>)")
    rows = once(rows.withColumn("facts", facts))
    spans = "array_sort(filter(facts, x -> x.kind = 'docstring'), (a, b) -> a.first - b.first)"
    spaced = "regexp_replace(substring(code, s.first + 1, s.last - s.first), '[^\\n]', ' ')"
    before = "coalesce(get(spans, i - 1).last, 0)"
    pieces = f"array_join(transform(spans, (s, i) -> concat(substring(code, {before} + 1, s.first - {before}), {spaced})), '')"
    tail = "substring(code, element_at(spans, -1).last + 1, length(code))"
    rows = once(rows.withColumn("code", F.expr(f"get(transform(array({spans}), spans -> if(size(spans) > 0, concat({pieces}, {tail}), code)), 0)")))
    return once(rows.withColumn("low", low("code")))


def scan(files: DataFrame, disable: tuple[str, ...] = (), ignore: tuple[str, ...] = (), only: tuple[str, ...] | None = None, keep: tuple[str, ...] = (), own: tuple[Rule, ...] = ()) -> DataFrame:
    """Findings of all rules that aren't disabled, in files that no glob ignores, with the files' columns ``keep``.

    ``own`` are more rules, for this scan alone.
    """
    for i, rule in enumerate(own):
        checked(rule, {r.id for r in [*RULES, *own[:i]]})
    rules = [r for r in [*RULES, *own] if r.id not in disable and (only is None or r.id in only)]
    if ignore:
        files = files.where(~ignored(F.col("path"), list(ignore)))
    rows = prepared(files, rules, keep)
    emit = EMIT | {r.id: max(EMIT.values()) + 1 + i for i, r in enumerate(own)}
    found = rows.select(F.col("path").alias("file"), *keep, F.explode(F.expr(f"concat({', '.join([NO_FINDINGS, *(_tagged(r, emit[r.id]) for r in rules)])})")).alias("x")).select("file", *keep, "x.*")
    text = lambda field: F.expr(f"element_at(map({', '.join(quoted(v) for r in rules for v in (r.id, getattr(r, field)))}), rule)" if rules else "rule")
    return found.select("rule", text("severity").alias("severity"), "file", "line", text("message").alias("message"), text("suggestion").alias("suggestion"), text("hint").alias("co2e_estimate"), "emit_rank", *keep)


def _tagged(rule: Rule, place: int) -> str:
    return f"transform({rule_lines(rule)}, (line, i) -> named_struct('rule', {quoted(rule.id)}, 'line', line, 'emit_rank', {place << 20} + i))"


def register_findings(spark: SparkSession, files: DataFrame, name: str = "findings", **options) -> None:
    """A table function for SQL: ``SELECT * FROM findings()``, or ``findings('src/%', 'high')`` for paths like a pattern and one severity.

    It is the scan of ``files`` as a plan, not a function that is called by row: what the query filters by reaches the files.
    """
    rows = scan(files, **options)
    rows.createOrReplaceTempView(f"_{name}_rows")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(pattern STRING DEFAULT '%', level STRING DEFAULT NULL) RETURNS TABLE ({columns})
        RETURN SELECT * FROM _{name}_rows WHERE file LIKE {name}.pattern AND ({name}.level IS NULL OR severity = {name}.level)""")


def ordered(findings: DataFrame) -> DataFrame:
    """High before medium before low, then by file and line, then as found."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return findings.orderBy(rank, "file", "line", "emit_rank")


__all__ = ["BY_ID", "FINDING", "ordered", "prepared", "rule_lines", "scan", "scannable"]
