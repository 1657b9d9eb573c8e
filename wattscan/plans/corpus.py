"""A corpus of files made from the documents table: each document fills one template, by its id.

A template's snippet comes first, so the lines of its findings are known; the whole document follows as a comment (in Markdown, as a quote).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattscan.functions.text import STYLE_OF, STYLES

_TF = 'resource "{}" "x" {{\n  {}\n}}\n'
_JOB = "jobs:\n  a:\n    steps:\n      - uses: checkout\n        with:\n          fetch-depth: 0\n{}  b:\n    steps:\n      - run: make\n"
#: (path before the id, path after it, mark before the document, snippet, [(rule number, line)])
TEMPLATES = [
    ("src/f", ".py", "#", "while True:\n    x = 1\n", [(1, 1)]),
    ("src/f", ".py", "#", "import time\nwhile True:\n    time.sleep(5)\n", []),
    ("src/f", ".py", "#", "while True:\n    if f():\n        break\n", []),
    ("src/f", ".py", "#", "def f():\n    while True:\n        for x in y:\n            break\n", [(1, 2)]),
    ("tests/f", ".py", "#", "while True:\n    x = 1\n", []),
    ("src/f", ".py", "#", "import time\ntime.sleep(0.05)\ntime.sleep(0.1)\n", [(2, 2)]),
    ("src/f", ".js", "//", "setInterval(tick, 50)\nsetInterval(tick, 5000)\n// setInterval(tick, 5)\n", [(2, 1)]),
    ("src/f", "_test.go", "//", "time.Sleep(5 * time.Millisecond)\n", []),
    ("src/f", ".go", "//", "\ntime.Sleep(5 * time.Millisecond)\n", [(2, 2)]),
    (".github/workflows/f", ".yml", "#", "on:\n  schedule:\n    - cron: '* * * * *'\n", [(3, 3)]),
    (".github/workflows/f", ".yml", "#", "# cron: '* * * * *'\n", []),
    (".github/workflows/f", ".yml", "#", _JOB.format(""), [(4, 6)]),
    (".github/workflows/f", ".yml", "#", _JOB.format("      - run: gitleaks\n"), []),
    (".github/workflows/f", ".yml", "#", "steps:\n  # fetch-depth: 0\n  - fetch-depth: 0\n", [(4, 3)]),
    ("db/f", ".sql", "--", "SELECT * FROM t;\nselect *\nfrom u;\n-- SELECT * FROM v\nSELECT a FROM w;\n", [(5, 1), (5, 2)]),
    ("src/f", ".py", "#", 'def q():\n    """SELECT * FROM doc"""\n    return "SELECT * FROM t"  # SELECT * FROM c\n', [(5, 3)]),
    ("img/d", "/Dockerfile", "#", "FROM ubuntu:22.04\nFROM debian:12-slim\n", [(6, 1)]),
    ("src/f", ".py", "#", "out = ()\nfor x in y:\n    out = out + (x,)\nn = 0\nfor x in y:\n    n += x\n", [(7, 3)]),
    ("src/f", ".py", "#", "def f(y):\n    s = ''\n    for x in y:\n        s += x\n    t = []\n    for x in y:\n        t += g(x)\n", [(7, 4)]),
    ("infra/f", ".tf", "#", 'instance_type = "m5.24xlarge"\n', [(8, 1), (16, 1)]),
    ("infra/f", ".tf", "#", 'instance_type = "m6g.large"\n', []),
    ("img/d", "/Dockerfile", "#", "FROM alpine\nRUN apt-get install -y curl\nRUN apt-get install -y --no-install-recommends git\n", [(9, 2), (29, 3)]),
    ("img/d", "/Dockerfile", "#", "FROM alpine\nRUN pip3 install requests\n", [(10, 2)]),
    ("web/f", ".html", "<p>", '<img src="a.png">\n<img\n src="b.gif" loading="lazy">\n', [(11, 1), (17, 2)]),
    ("web/f", ".css", "/*", "a { background: url('x.gif') }\n/* url(y.gif) */\n", [(17, 1), (17, 2)]),
    ("src/f", ".py", "#", "for i in ids:\n    cur.execute(q, i)\ncur.execute(q)\n", [(12, 1)]),
    ("infra/f", ".tf", "#", _TF.format("aws_s3_bucket", 'bucket = "b"'), [(13, 1)]),
    ("infra/f", ".tofu", "#", "\n" + _TF.format("aws_s3_bucket", "lifecycle_rule {}"), []),
    ("k8s/f", ".yaml", "#", "kind: Deployment\nspec: {}\n", [(14, 1)]),
    ("k8s/f", ".yaml", "#", "kind: Deployment\nname: {{ x }}\n", []),
    ("k8s/f", ".yaml", "#", "kind: Pod\nresources:\n  limits: {}\n", []),
    ("img/d", "/Dockerfile", "#", "FROM python:2.7\nFROM node:14-alpine\nFROM node:22\n", [(15, 1), (15, 2)]),
    ("src/f", ".py", "#", "for a in xs:\n    for b in xs:\n        f(a, b)\n", [(18, 2)]),
    ("src/f", ".py", "#", "for u in us:\n    r = requests.get(u)\n", [(19, 1)]),
    ("src/f", ".py", "#", "logging.debug(f'{x}')\nlogging.info('{}'.format(x))\nlogging.info('%s', x)\n", [(20, 1), (20, 2)]),
    ("src/f", ".py", "#", "for i, r in df.iterrows():\n    pass\ndf.apply(f, axis=1)\n", [(21, 1), (21, 3)]),
    ("src/f", ".py", "#", "for p in ps:\n    d = pd.read_csv(p)\n", [(22, 1)]),
    ("src/f", ".py", "#", "for i in range(n):\n    for j in range(n):\n        a[i], a[j] = a[j], a[i]\n", [(23, 2)]),
    ("infra/f", ".tf", "#", _TF.format("aws_autoscaling_group", "min_size = 3\n  max_size = 3"), [(24, 1)]),
    ("infra/f", ".tf", "#", _TF.format("aws_autoscaling_group", "min_size = 1\n  max_size = 3"), []),
    ("infra/f", ".tf", "#", 'volume_type = "gp2"\nvolume_type = "gp3"\n', [(25, 1)]),
    ("infra/f", ".tf", "#", _TF.format("aws_cloudwatch_log_group", 'name = "n"') + _TF.format("aws_cloudwatch_log_group", "retention_in_days = 7"), [(26, 1)]),
    ("src/f", ".js", "//", "app.use(express.static('public'))\napp.use(express.static('public', { maxAge: '1y' }))\n", [(27, 1)]),
    ("src/f", ".py", "#", "from os import *\nfrom os import path\n", [(28, 1)]),
    ("img/d", "/Dockerfile", "#", "FROM a AS b\nRUN npm install x\nRUN npm install y\nFROM c\nRUN yum install z\n", [(29, 3)]),
    ("src/f", ".py", "#", "for _, v in d.items():\n    f(v)\nfor k, v in d.items():\n    f(k, v)\n", [(30, 1)]),
    ("src/f", ".py", "#", "for k in ks:\n    try:\n        v = d[k]\n    except KeyError:\n        pass\n", [(31, 2)]),
    ("src/f", ".c", "//", "for (i = 0; i < n; i++) {\n  p = malloc(4);\n}\n/* while (1)\n new x */\n", [(32, 1)]),
    ("k8s/f", ".yaml", "#", "kind: HorizontalPodAutoscaler\nminReplicas: 2\nmaxReplicas: 2\n", [(33, 2)]),
    ("k8s/f", ".yml", "#", "version: 3\nservices:\n  a: {}\n", [(34, 2)]),
    ("k8s/f", ".yml", "#", "services:\n  a:\n    mem_limit: 1g\n", []),
    ("src/F", ".cs", "//", "if (xs.Count() == 0) {}\nif (xs.Any()) {}\n", [(35, 1)]),
    ("src/f", ".rb", "#", "h.keys.include?(k)\nh.key?(k)\n", [(36, 1)]),
    ("src/f", ".rb", "#", "xs.select(&:ok?).map(&:id)\nxs.filter_map { |x| x }\n", [(37, 1)]),
    ("web/F", ".jsx", "//", "<A onClick={() => f()} />\n<B style={{ a: 1 }} />\n<C f={f} />\n", [(38, 1), (38, 2)]),
    ("docs/f", ".md", ">", "SELECT * FROM t\n", []),
    ("vendor/f", ".py", "#", "from os import *\n", [(28, 1)]),
    ("src/f", ".sh", "#", "sleep 0.01\nsleep .05\nsleep 0.5\nsleep 2\n", [(2, 1), (2, 2)]),
    ("src/f", ".rs", "//", "thread::sleep(Duration::from_millis(20));\nthread::sleep(Duration::from_millis(200));\n", [(2, 1)]),
    ("src/f", ".java", "//", "Thread.sleep(10);\nThread.sleep(100);\n", [(2, 1)]),
    ("src/f", ".c", "//", "usleep(500);\nusleep(500000);\n", [(2, 1)]),
    ("src/f", ".cpp", "//", "delay(5);\ndelay(500);\nmydelay(5);\n", [(2, 1)]),
    ("src/f", ".swift", "//", "Timer.scheduledTimer(withTimeInterval: 0.05, repeats: true) { }\nTimer.scheduledTimer(withTimeInterval: 5, repeats: true) { }\n", [(2, 1)]),
    ("src/f", ".ts", "//", "setInterval(\n  tick, 9)\n", [(2, 1)]),
    ("src/f", ".php", "#", "$q = 'select * from t'; // SELECT * FROM c\nusleep(10);\n", [(5, 1), (2, 2)]),
    ("src/f", ".pl", "#", "# SELECT * FROM c\nmy $q = 'SELECT  *  FROM t';\n", [(5, 2)]),
    ("img/d", "/Dockerfile", "#", "FROM centos:7\nFROM debian:wheezy\nFROM ubuntu:18.04\nFROM python:3.12\n", [(15, 1), (6, 2), (15, 2), (6, 3), (15, 3)]),
    ("img/d", ".dockerfile", "#", "FROM DEBIAN\nfrom ubuntu:24.04-slim\n# FROM ubuntu\n", [(6, 1)]),
    ("infra/f", ".tf", "#", 'instance_type = "t3.micro"\ninstance_type = "r5.16xlarge"\ninstance_type = "C4.large"\n', [(16, 1), (8, 2), (16, 2), (16, 3)]),
    ("src/f", ".py", "#", "for p in ps:\n    open(p)\nfor p in ps:\n    x = pd.read_json(p)\nys = [open(p) for p in ps]\n", [(22, 1), (22, 3)]),
    ("src/f", ".py", "#", "for u in us:\n    requests.post(u, x)\nrequests.get(u)\n", [(19, 1)]),
    ("src/f", ".py", "#", "for k in ks:\n    try:\n        n = int(k)\n    except ValueError:\n        continue\ntry:\n    n = int(k)\nexcept ValueError:\n    pass\n", [(31, 2)]),
    ("src/f", ".cpp", "//", "while (go) {\n  auto p = new Thing();\n}\nfor (;;)\n  q = realloc(q, 9);\n", [(32, 1), (32, 4)]),
    ("src/f", ".cs", "//", "if (xs.Count() > 0) {}\nif (xs.Count() != 0) {}\nif (xs.Count() > 1) {}\n", [(35, 1), (35, 2)]),
    ("src/f", ".rb", "#", "h.values.include?(v)\nxs.select { |x| x.ok? }.map { |x| x.id }\n", [(36, 1), (37, 2)]),
    ("web/F", ".tsx", "//", "<A x={{ a: 1 }} y={() => g()} />\n", [(38, 1), (38, 1)]),
    ("src/f", ".py", "#", "while True:\n    def stop():\n        return 1\n    go()\n", [(1, 1)]),
    ("src/f", ".py", "#", "while 1:\n    x = 1\nwhile True:\n    raise E\n", []),
    ("src/f", ".py", "#", "def f(y):\n    n, s = 0, ''\n    for x in y:\n        n += x\n        s = s + x\n        n += len(x) * 2\n", [(7, 5)]),
    ("src/f", ".py", "#", "for a in xs:\n    def g():\n        for b in xs:\n            pass\n", [(18, 3)]),
    ("src/f", ".py", "#", "df.apply(f, axis = 1)\ndf.apply(f, axis=0)\nlogging.warning(f'{x}')\n", [(21, 1)]),
    (".github/workflows/f", ".yaml", "#", "schedule: \"* * * * *\"\ncron: '*/5 * * * *'\n", [(3, 1)]),
    ("k8s/f", ".yaml", "#", "kind: HorizontalPodAutoscaler\nminReplicas: 2\nmaxReplicas: 5\n", []),
    ("infra/f", ".tf", "#", _TF.format("aws_s3_bucket", "# lifecycle"), [(13, 1)]),
    ("web/f", ".css", "/*", "a { background: url(z.png) }\nb { background: URL( \"w.GIF\" ) }\n", [(17, 2)]),
]


def spread(df: DataFrame) -> DataFrame:
    """A table that comes in fewer parts than there are cores (one small file, say) is dealt out before costly work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, text, doc_id`` of every document. The templates are a fixed few rows, so they are broadcast."""
    made = spark.createDataFrame([(i, a, b, f"{mark} ", body) for i, (a, b, mark, body, _) in enumerate(TEMPLATES)], "tmpl int, a string, b string, mark string, body string")
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("doc")))
    tail = F.concat("mark", F.regexp_replace("doc", r"[\n\r<*/]", " "), F.when(F.col("mark") == "/* ", " */").otherwise(""))
    rows = docs.withColumn("tmpl", F.pmod("doc_id", F.lit(len(TEMPLATES))).cast("int")).join(F.broadcast(made), "tmpl")
    return rows.select(F.concat("a", F.col("doc_id").cast("string"), "b").alias("path"), F.concat("body", tail).alias("text"), "doc_id")


def expected_sql(where: str = "true") -> str:
    """SQL for ``rule, severity, file, line, message`` that the templates promise, as a parenthesised query."""
    from wattscan.operators.rules import BY_ID

    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    paths = ", ".join(f"({i}, {quoted(a)}, {quoted(b)})" for i, (a, b, *_) in enumerate(TEMPLATES))
    found = ", ".join(f"({i}, 'GL{n:03d}', {line})" for i, t in enumerate(TEMPLATES) for n, line in t[4])
    rules = ", ".join(f"({quoted(r.id)}, {quoted(r.severity)}, {quoted(r.message)})" for r in BY_ID.values())
    return f"""(SELECT rule, severity, file, line, message FROM (
        SELECT f.rule, r.severity, p.a || CAST(d.doc_id AS VARCHAR) || p.b AS file, CAST(f.line AS INTEGER) AS line, r.message, d.doc_id
        FROM documents d JOIN (VALUES {paths}) p(tmpl, a, b) ON d.doc_id % {len(TEMPLATES)} = p.tmpl
        JOIN (VALUES {found}) f(tmpl, rule, line) ON f.tmpl = p.tmpl
        JOIN (VALUES {rules}) r(rule, severity, message) ON r.rule = f.rule) WHERE {where})"""


#: A string, or (as group 1) a comment, of each style; enough for the templates.
_COMMENTS = {style: re.compile(r"""(?:"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(""" + comment + ")") for style, comment in {"hash": r"#[^\n]*", "sql": r"--[^\n]*|/\*(?s:.*?)\*/", "slash": r"//[^\n]*|/\*(?s:.*?)\*/"}.items()}


def _style(suffix: str) -> str | None:
    if suffix == "/Dockerfile":
        return "hash"
    return next((style for style, suffixes in STYLE_OF.items() if "." + suffix.rpartition(".")[2] in suffixes), None)


def blanked_sql() -> str:
    """SQL for ``path, n_chars, code_md5``: the templates with their comments as spaces, then the document, which is a comment where the kind of file has any."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = []
    for i, (a, b, mark, body, _) in enumerate(TEMPLATES):
        style = _style(b)
        code = _COMMENTS[style].sub(lambda m: re.sub(r"[^\n]", " ", m[1]) if m[1] else m[0], body) if style else body
        rows.append(f"({i}, {quoted(a)}, {quoted(b)}, {quoted(code)}, {quoted(mark + ' ')}, {str(style is not None and STYLES[style][0] == mark).lower()})")
    whole = "p.mark || regexp_replace(coalesce(d.text, ''), '[\\n\\r<*/]', ' ', 'g') || CASE p.mark WHEN '/* ' THEN ' */' ELSE '' END"
    code = f"p.code || CASE WHEN p.bare THEN repeat(' ', length({whole})) ELSE {whole} END"
    return f"SELECT p.a || CAST(d.doc_id AS VARCHAR) || p.b AS path, CAST(length({code}) AS BIGINT) AS n_chars, md5({code}) AS code_md5 FROM documents d JOIN (VALUES {', '.join(rows)}) p(tmpl, a, b, code, mark, bare) ON d.doc_id % {len(TEMPLATES)} = p.tmpl"


def paths_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    paths = ", ".join(f"({i}, {quoted(a)}, {quoted(b)})" for i, (a, b, *_) in enumerate(TEMPLATES))
    return f"(SELECT d.doc_id, p.a || CAST(d.doc_id AS VARCHAR) || p.b AS path FROM documents d JOIN (VALUES {paths}) p(tmpl, a, b) ON d.doc_id % {len(TEMPLATES)} = p.tmpl)"
