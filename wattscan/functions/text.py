"""Text functions of the rules, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Line-comment token and whether ``/* */`` blocks exist, by comment style.
STYLES = {"hash": ("#", False), "sql": ("--", True), "slash": ("//", True)}
#: Suffixes (or the whole name) of each comment style; other files have no comments.
STYLE_OF = {
    "slash": [".go", ".js", ".ts", ".jsx", ".tsx", ".c", ".h", ".cpp", ".cc", ".hpp", ".java", ".rs", ".kt", ".swift", ".cs", ".php", ".scala"],
    "sql": [".sql"],
    "hash": [".py", ".sh", ".bash", ".rb", ".yml", ".yaml", ".tf", ".tofu", ".toml", ".pl", ".dockerfile"],
}


def once(df: DataFrame) -> DataFrame:
    """``df`` behind a projection that later filters and projections aren't merged with, so it is computed once."""
    return df.withColumn("_once", F.spark_partition_id()).where("_once >= 0").drop("_once")


def dialect(pattern: str, flags: str = "") -> str:
    """A pattern with the meaning it has elsewhere for Unicode classes and line ends. ``flags``: any of m and i."""
    return "(?Ud)" + "".join({"m": "(?m)", "i": "(?i)(?u)"}[f] for f in flags) + pattern


#: Stands before a match; texts hold another private character instead.
_MARK, _OTHER = "\ue000", "\ue001"


def quoted(text: str) -> str:
    """A SQL literal, as the parser reads it by default.

    Long expressions are written as SQL: as columns, each of their nodes is several calls to the JVM, seconds for all rules.
    """
    plain = text.replace("\\", "\\\\").replace("'", "\\'")
    return "'" + plain.replace("${", "\\u0024{") + "'"  # else a variable's value would take its place


NO_LINES = "cast(array() AS array<int>)"


def match_lines(text: str, pattern: str) -> str:
    """SQL for the 1-based line of each match in ``text``, in order, as an array: one pass marks the matches, then each line counts its marks.

    The pattern must not match the empty string.
    """
    marked = f"regexp_replace(translate({text}, '{_MARK}', '{_OTHER}'), {quoted(pattern)}, '{_MARK}$0')"
    lines = f"flatten(transform(split(marked, '\\n'), (piece, i) -> array_repeat(i + 1, length(piece) - length(translate(piece, '{_MARK}', '')))))"
    return f"get(transform(array({marked}), marked -> if(contains(marked, '{_MARK}'), {lines}, {NO_LINES})), 0)"


def first_line(text: str, pattern: str) -> str:
    """SQL for the line of the first match in an array, or an empty array."""
    before = f"get(split({text}, {quoted(pattern)}, 2), 0)"
    return f"if({text} RLIKE {quoted(pattern)}, array(1 + length({before}) - length(translate({before}, '\\n', ''))), {NO_LINES})"


def _tokens(style: str) -> str:
    """One token of a file: a string, a comment, a run of plain characters, or any one character. Possessive throughout."""
    line, block = STYLES[style]
    string = lambda q: rf"{q}(?:[^{q}\\\n]++|\\[^\n]|\\(?=\n))*+(?:{q}|(?=\n)|\\?\z)"
    plain = "[^\"'" + {"#": "#", "--": "/-", "//": "/"}[line].replace("-", r"\-") + "]++"
    parts = [string('"'), r"(?<=\p{L})'(?=\p{L})", string("'"), rf"{line}[^\n]*+"]
    if block:
        parts.append(r"/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)")
    return "(?d)" + "|".join([*parts, plain, r"[\s\S]"])


def _blanked(text: str, style: str) -> str:
    line, block = STYLES[style]
    marks = [line, "/*"] if block else [line]
    is_comment, has = (" OR ".join(f"{test}, '{m}')" for m in marks) for test in ("startswith(token", f"contains({text}"))
    tokens = f"regexp_extract_all({text}, {quoted(_tokens(style))}, 0)"
    return f"if({has}, array_join(transform({tokens}, token -> if({is_comment}, regexp_replace(token, '[^\\n]', ' '), token)), ''), {text})"


def blank_comments(text: str = "text", suffix: str = "suffix", name: str = "name") -> Column:
    """Comments as spaces of the same length, line ends kept; quotes are honoured. The arguments are SQL."""
    styles = " ".join(f"WHEN {suffix} IN ({', '.join(map(quoted, suffixes))}) THEN {_blanked(text, style)}" for style, suffixes in STYLE_OF.items())
    return F.expr(f"CASE WHEN {name} = 'Dockerfile' THEN {_blanked(text, 'hash')} {styles} ELSE {text} END")


def with_parts(files: DataFrame) -> DataFrame:
    """``path, text`` with ``name``, ``suffix`` and ``dir_parts``."""
    parts = F.split("path", "/")
    named = files.withColumns({"name": F.element_at(parts, -1), "dir_parts": F.slice(parts, F.lit(1), F.size(parts) - 1)})
    # A leading dot starts no suffix, and a trailing one ends none.
    return named.withColumn("suffix", F.regexp_extract("name", r"(?s)^.+(\.[^.]+)\z", 1))


def kind() -> Column:
    """What rules go by, from ``name`` and ``suffix``: the suffix, or the whole name ``Dockerfile``."""
    return F.when(F.col("name") == "Dockerfile", F.col("name")).otherwise(F.col("suffix"))


def universal_newlines(content: Column) -> Column:
    """Raw bytes as text: malformed UTF-8 replaced, line ends unified."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def escaped(text: Column) -> Column:
    """Text for HTML."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def relative(path: Column, root: str) -> Column:
    """A path below ``root`` without it; other paths as they are."""
    base = root.rstrip("/") + "/" if root else ""
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path) if base else path


def anchor(rule: Column, message: Column) -> Column:
    """The anchor of a rule's heading (``rule — message``) in a Markdown page: lower case, punctuation dropped, spaces as hyphens."""
    return F.translate(F.regexp_replace(F.lower(F.concat(rule, F.lit(" \u2014 "), message)), r"[^a-z0-9 _\-]", ""), " ", "-")
