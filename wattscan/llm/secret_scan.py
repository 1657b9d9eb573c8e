"""Secret scan: patterns propose candidates, a random forest drops the false positives.

A candidate is a private-key header, a value assigned to a name that holds a word such as ``password``, or a long run of
letters, digits and a few marks. Candidates have no least or most length beyond the 16 characters that make a run, and
names none: what is no secret is for the forest to drop. Its features are a candidate's length, character classes and
transitions between them, familiar letter pairs, coverage by dictionary words, words of the document's path, and
neighbouring words. The dictionary is a list of technical words and the commonest words of the documents themselves. The
forest is trained on labelled findings; those built in are made by rules with a fixed seed, from no table, and any table
with ``text``, ``path`` and ``secret`` can take their place.

Nulls: a null text has no candidates, a null path has no words, a null id passes through. Repeated rows give repeated
findings. Texts are read whole, in time that grows with their length. Candidates of a text don't overlap: a value
assigned to a name comes before a run. Words of one count enter the dictionary by their order (ties). Extra columns are
ignored. An empty table gives an empty result; labelled findings of a single kind give every candidate that kind.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import accumulate
from random import Random

import ahocorasick
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattscan.llm.common import cut, table, text_of
from wattscan.llm.quality import bucket

#: A name, a sign and the value behind it. A value ends at white space, a quote or a bracket, and where another name follows.
ASSIGNED = re.compile(r"(?<![\w\-])([\w\-]++)[\"']?[ \t]*+(?::=|=>|[:=])[ \t]*+[\"']?((?:(?![&;,?][\w\-]+=)[^\s\"'<>])+)")
NAMES = re.compile(r"password|passwd|passphrase|pwd|token|secret|api[_\-]?key|access[_\-]?key|private[_\-]?key|credential|auth", re.IGNORECASE)
HEADER = re.compile(r"-----BEGIN ([A-Z0-9 ]*+)-----")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=\-])[A-Za-z0-9+/_=\-]{16,}")
#: Common words of the documents that the dictionary takes, at most, and their least length.
COMMON_WORDS, WORD_LETTERS = 5000, 4
#: Words that placeholders, identifiers and slugs are made of.
DICTIONARY = "access account admin alpha api app auth base beta book build cache change check class client code commit config content copy create data date default delete demo dev document dummy email empty encode error event example fake field file filter first folder form format from full group guide handler hash header hello here home house how html http image index info input insert install item java json key last latest letme link list load local log login main make manager map master me message model module my name network new node none note null number object order page param parser pass password path placeholder plain plan point post print private process project public python query read record release remote remove report request reset result route run sample save script search secret select server service session set setting simple site some source spec src start state static status string style system table target task temp test text the time title token tool tree type update upload url user util value version view web welcome what with word work world write your".split()
#: Neighbouring or path words that speak against, and for, a secret.
AGAINST = {"example", "examples", "sample", "dummy", "fake", "test", "tests", "placeholder", "checksum", "sha", "sha256", "md5", "commit", "revision", "digest", "uuid", "version", "slug", "path", "file", "image", "docs", "fixture", "fixtures", "spec", "mock", "demo", "url", "etag", "hash", "id"}
FOR = {"password", "passwd", "pwd", "token", "secret", "key", "apikey", "auth", "credential", "credentials", "access", "aws", "bearer", "login", "prod", "production", "deploy"}
#: Letter pairs that words are full of.
PAIRS = set("th he in er an re nd on en at ou ed ha to or it is hi es ng st se ar te le me nt ro ti al co de ra li ri ic ll ac om el ma ss ex ta ur la ch".split())
_NEAR = re.compile(r"[A-Za-z]+\d{0,3}")
NEAR = 60
FEATURES = ["length", "digits", "uppers", "marks", "transitions", "pairs", "covered", "distinct", "hex", "assigned", "header", "near_for", "near_against", "path_for", "path_against", "uuid", "known_prefix"]
KNOWN = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}$|gh[pousr]_[A-Za-z0-9]{30,}$|xox[abp]-|sk_live_|eyJ[A-Za-z0-9_-]{10,}")
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.IGNORECASE)
TREES, DEPTH, SEED = 40, 9, 11


def common_words(docs: DataFrame, text_col: str = "text", most: int = COMMON_WORDS) -> tuple[str, ...]:
    """The commonest words (letters only) of all texts: a bounded list."""
    words = F.filter(F.split(F.lower(text_of(text_col)), r"[^\p{L}]+"), lambda w: F.length(w) >= WORD_LETTERS)
    counts = cut(docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")), "words")
    # How many words there are from each count on, by logarithmic buckets, tells from where the commonest ones are sought.
    sizes = sorted(((r["b"], r["size"]) for r in counts.groupBy(bucket(F.col("n")).alias("b")).agg(F.count(F.lit(1)).alias("size")).collect()), reverse=True)
    enough = next((b for (b, _), upto in zip(sizes, accumulate(size for _, size in sizes)) if upto >= most), 0)
    rows = counts.where(bucket(F.col("n")) >= enough).orderBy(F.desc("n"), "w").limit(most)
    return tuple(sorted(r["w"] for r in rows.collect()))


@cache
def _dictionary(words: tuple[str, ...]):
    found = ahocorasick.Automaton()
    for w in {*DICTIONARY, *words}:
        if len(w) > 2:
            found.add_word(w, len(w))
    found.make_automaton()
    return found


def _covered(low: str, dictionary) -> int:
    """Characters that lie in some dictionary word."""
    spans = sorted((end + 1 - size, end + 1) for end, size in dictionary.iter(low))
    total = at = 0
    for start, end in spans:
        total += max(0, end - max(start, at))
        at = max(at, end)
    return total


def _features(value: str, kind: str, near: str, path: str, dictionary) -> list[float]:
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "m" for c in value]
    low = value.lower()
    letters = sum(k in "ul" for k in kinds)
    near_words = {w.lower() for w in _NEAR.findall(near)}
    path_words = {w.lower() for w in _NEAR.findall(path)}
    return [
        float(n),
        kinds.count("d") / n,
        kinds.count("u") / n,
        kinds.count("m") / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        sum(low[i : i + 2] in PAIRS for i in range(n - 1)) / max(letters - 1, 1),
        _covered(low, dictionary) / n,
        len(set(low)) / min(n, 40),
        float(all(c in "0123456789abcdef" for c in low)),
        float(kind == "assigned"),
        float(kind == "header"),
        float(len(near_words & FOR)),
        float(len(near_words & AGAINST)),
        float(len(path_words & FOR)),
        float(len(path_words & AGAINST)),
        float(bool(UUID.match(value))),
        float(bool(KNOWN.match(value))),
    ]


def proposed(text: str) -> list[tuple[int, str, str]]:
    """(offset, kind, value) of each candidate of a text, in order."""
    out = [(m.start(), "header", m.group()) for m in HEADER.finditer(text) if m.group(1).endswith("PRIVATE KEY")]
    at = 0
    while m := ASSIGNED.search(text, at):
        value = m.group(2).rstrip(".,;:)]}") if NAMES.search(m.group(1)) else ""
        if value:
            out.append((m.start(2), "assigned", value))
        at = m.end(2) if value else m.end(1)  # what looked like a value may be a name itself
    taken = sorted((a, a + len(v)) for a, _, v in out)
    k = 0
    for m in RUN.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k == len(taken) or taken[k][0] >= m.end():
            out.append((m.start(), "run", m.group()))
    return sorted(out)


def found(text: str, path: str, words: tuple[str, ...] = ()) -> list[tuple[int, str, str, list[float]]]:
    """(offset, kind, value, features) of each candidate of a text."""
    out, dictionary = [], _dictionary(words)
    for at, kind, value in proposed(text):
        near = text[max(0, at - NEAR) : at] + " " + text[at + len(value) : at + len(value) + NEAR]
        out.append((at, kind, value, _features(value, kind, near, path, dictionary)))
    return out


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", keep: list[str] | None = None, words: tuple[str, ...] = ()) -> DataFrame:
    """A row per candidate: the id, columns ``keep``, ``at``, ``kind``, ``value`` and ``features``."""
    kept = [id_col, *(keep or [])]
    shared = docs.sparkSession.sparkContext.broadcast(words)  # at most COMMON_WORDS words

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                some = batch.slice(begin, 500)
                rows = [(i, *c) for i, (t, p) in enumerate(zip(some.column("__text").to_pylist(), some.column("__path").to_pylist())) for c in found(t or "", p or "", shared.value)]
                of, at, kind, value, features = zip(*rows) if rows else ((), (), (), (), ())
                own = [some.column(c).take(pa.array(of, pa.int64())) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, pa.array(at, pa.int64()), pa.array(kind, pa.string()), pa.array(value, pa.string()), pa.array(features, pa.list_(pa.float64()))], [*kept, "at", "kind", "value", "features"])

    schema = docs.select(*kept).schema.add("at", "long").add("kind", "string").add("value", "string").add("features", T.ArrayType(T.DoubleType()))
    return docs.select(*kept, F.col(text_col).alias("__text"), F.col(path_col).cast("string").alias("__path")).mapInArrow(run, schema)


def labelled_findings(spark: SparkSession, each: int = 2400) -> DataFrame:
    """Made-up findings, half of them secrets: ``text, path, secret``."""
    r, rows = Random(SEED), []
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    digits, hexes, lower = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    alnum = lower + lower.upper() + digits
    word = lambda: some("aeioustrnlmdch", r.randint(2, 8))
    prose = lambda: " ".join(word() for _ in range(r.randint(1, 9)))
    slug = lambda n: r.choice("-_").join(r.choice(DICTIONARY) for _ in range(n))
    paths = ["prod/config.yaml", "deploy/env.sh", "app/settings.py", "web/main.js", "notes.txt", "a/b7", "data", "", "infra/main.tf", "chat/log"]
    safe = ["docs/guide.md", "tests/fixtures/a.json", "examples/demo.py", "spec/mock.rb"]

    def named() -> str:
        base = r.choice(["password", "token", "secret", "api_key", "access_key", "auth", "passwd", "client_secret", "credential", "private_key"])
        return r.choice(["", "", "db_", "AWS_", "the-"]) + r.choice([base, base.upper()]) + r.choice(["", "", "_for_" + r.choice(DICTIONARY), "_" + r.choice(DICTIONARY)])

    def assigned(name: str, value: str) -> str:
        return r.choice([f"{name}={value}", f'{name} = "{value}"', f"{name}: {value}", f"'{name}': '{value}'", f"{name} := {value}", f"x={some(digits, 2)}&{name}={value}&{word()}={word()}", f"{name}: '{value}'"])

    for _ in range(each):
        kind = r.randrange(8)
        value = [lambda: some(hexes, r.choice([16, 18, 20, 24, 32, 40, 64])), lambda: "AKIA" + some(lower.upper() + "234567", 16), lambda: "ghp_" + some(alnum, 36), lambda: some(alnum + "+/", r.choice([22, 32, 43, 64])), lambda: some(alnum + "!#%", r.randint(9, 20)), lambda: some(lower + lower.upper(), r.randint(16, 40)), lambda: some(lower, r.randint(2, 6)) + some(digits, r.randint(2, 4)) + r.choice("!#%") + some(alnum, r.randint(2, 5)), lambda: f"sk_live_{some(alnum, 24)}"][kind]()
        if kind in (1, 2, 7) and r.random() < 0.6:
            shown = value
        elif kind in (0, 3) and r.random() < 0.3 and len(value) >= 20:
            shown = f"{r.choice(['key', 'login', 'deploy', 'credentials', 'bearer'])} {value}"
        else:
            shown = assigned(named(), value)
        if r.random() < 0.02:
            shown = f"-----BEGIN {r.choice(['RSA ', 'EC ', '', 'OPENSSH '])}PRIVATE KEY-----"
        rows.append((f"{prose()} {shown} {prose()}", r.choice(paths), 1))
    for _ in range(each):
        kind = r.randrange(14)
        near, path = prose(), r.choice([*paths, *safe])
        if kind == 0:
            shown = assigned(named(), r.choice([slug(3), "changeme123", "your_" + r.choice(["token", "password", "key"]) + "_here", "x" * r.randint(6, 20), some("*", 8), "example" + some(digits, 2), "${" + slug(2).upper() + "}", "%s", "null", "None", "true", "", "{{" + slug(2) + "}}", "os.environ", "get_" + slug(2) + "()"]))
        elif kind == 1:
            shown = f"{r.choice(['id', 'uuid', 'request', ''])} {some(hexes, 8)}-{some(hexes, 4)}-{some(hexes, 4)}-{some(hexes, 4)}-{some(hexes, 12)}"
        elif kind == 2:
            shown = f"{r.choice(['commit', 'sha', 'revision'])} {some(hexes, 40)}"
        elif kind == 3:
            shown = f"{r.choice(['sha256', 'md5', 'checksum', 'digest', 'etag'])} {some(hexes, r.choice([32, 64]))}"
        elif kind == 4:
            shown = f"{slug(r.randint(2, 5))}-{r.randint(1, 2030)}-{r.choice(DICTIONARY)}"
        elif kind == 5:
            shown = "/".join(r.choice(DICTIONARY) for _ in range(r.randint(3, 6))) + some(digits, 1)
        elif kind == 6:
            shown = "".join(r.choice(DICTIONARY).capitalize() for _ in range(r.randint(3, 5))) + r.choice(["", some(digits, r.randint(1, 3))])
        elif kind == 7:
            shown = f"20{some('012', 1)}{some(digits, 1)}-0{some('123456789', 1)}-1{some(digits, 1)}T1{some(digits, 1)}-{some(digits, 2)}-{some(digits, 2)}Z"
        elif kind == 8:
            shown = "".join(word() for _ in range(4)).ljust(16, "e")
            shown = r.choice([shown, shown.capitalize(), shown.upper()])
        elif kind == 9:
            shown = some(digits, r.randint(16, 24))
        elif kind == 10:
            shown = r.choice("-=_") * r.randint(16, 60)
        elif kind == 11:
            shown = f"{named()}: {r.choice([word(), r.choice(DICTIONARY), str(r.randint(1, 99))])}"
        else:
            shown = assigned(named(), some(hexes, r.choice([16, 32, 40])))
            near, path = r.choice(["example", "dummy test", "sample fake", "placeholder"]), r.choice(safe)
        rows.append((f"{near} {shown} {prose()}", path, 0))
    return spark.createDataFrame(rows, "text string, path string, secret int")


def fitted(labelled: DataFrame, words: tuple[str, ...] = ()):
    """The forest, or the only label there is (0 without any)."""
    rows = candidates(labelled.where(F.col("secret").isNotNull()).withColumn("id", F.lit(0)), "id", "text", "path", ["secret"], words)
    rows = cut(rows.select(array_to_vector("features").alias("_features"), F.col("secret").cast("double").alias("_label")), "findings")
    seen = [r[0] for r in rows.select("_label").distinct().collect()]
    if len(seen) < 2:
        return seen[0] if seen else 0.0
    return RandomForestClassifier(featuresCol="_features", labelCol="_label", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_at", numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64).fit(rows.repartition(1).sortWithinPartitions("_label"))


def scanned(docs: DataFrame, labelled: DataFrame, path_col: str = "source", words: tuple[str, ...] | None = None) -> DataFrame:
    """``doc_id, at, kind, value, score, is_secret`` of each candidate. ``words`` take the place of the documents' own in the dictionary."""
    words = common_words(docs) if words is None else words
    rows, model = candidates(docs, path_col=path_col, words=words), fitted(labelled, words)
    if isinstance(model, float):
        judged = rows.withColumn("score", F.lit(model))
    else:
        judged = model.transform(rows.withColumn("_features", array_to_vector("features"))).withColumn("score", vector_to_array("_p")[1])
    return judged.select("doc_id", "at", "kind", "value", "score", (F.col("score") > 0.5).alias("is_secret"))


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    rows = scanned(table(spark, sf_dir, "documents"), labelled_findings(spark))
    return rows.select("doc_id", "at", "kind", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")
