"""Bibliography files: reading, auditing and writing."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.operators.entries import promote

ENTRY = T.StructType([T.StructField("entry_type", T.StringType()), T.StructField("key", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("raw", T.StringType()), T.StructField("problem", T.StringType())])
# Months that need no @string.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
NOT_ENTRIES = {"comment", "preamble", "string"}
_head = re.compile(r"@\s*([A-Za-z]+)\s*([{(])")


class Reader:
    """One pass over a bibliography's text, brackets counted, quotes and escapes respected."""

    def __init__(self, text: str):
        self.text, self.strings = text, {m: m for m in MONTHS}

    def close(self, at: int, opened: str) -> int:
        """The place of the bracket that closes the one before `at`, or -1."""
        shut, depth, quoted, i = "}" if opened == "{" else ")", 0, False, at
        while i < len(self.text):
            c = self.text[i]
            if c == "\\":
                i += 1
            elif c == '"' and depth == 0 and opened == "{" and not quoted and self.text[:i].rstrip().endswith("="):
                quoted = True
            elif c == '"' and quoted and depth == 0:
                quoted = False
            elif c == "{":
                depth += 1
            elif c == "}" and depth:
                depth -= 1
            elif c == shut and depth == 0 and not quoted:
                return i
            i += 1
        return -1

    def value(self, body: str, at: int) -> tuple[str, int]:
        """The value at a place of an entry's body (pieces joined by #), and the place behind it."""
        parts = []
        while at < len(body):
            while at < len(body) and body[at].isspace():
                at += 1
            if at < len(body) and body[at] in '{"':
                opened, depth, i = body[at], 0, at + 1
                while i < len(body):
                    c = body[i]
                    if c == "\\":
                        i += 1
                    elif c == "{":
                        depth += 1
                    elif c == "}" and (depth or opened == "{"):
                        if depth == 0:
                            break
                        depth -= 1
                    elif c == '"' and opened == '"' and depth == 0:
                        break
                    i += 1
                parts.append(body[at + 1 : i])
                at = i + 1
            else:
                m = re.compile(r"[^\s,#{}\"]+").match(body, at)
                if not m:
                    break
                parts.append(self.strings.get(m[0].lower(), m[0]))
                at = m.end()
            while at < len(body) and body[at].isspace():
                at += 1
            if at >= len(body) or body[at] != "#":
                break
            at += 1
        return re.sub(r"\s+", " ", "".join(parts)).strip(), at

    def fields(self, body: str) -> dict[str, str]:
        out, at, name = {}, 0, re.compile(r"[\s,]*([A-Za-z_][\w\-:.+]*)\s*=")
        while m := name.match(body, at):
            value, at = self.value(body, m.end())
            out.setdefault(m[1].lower(), value)
            at = max(at, m.end())
        return out

    def entries(self):
        at = 0
        while m := _head.search(self.text, at):
            kind, end = m[1].lower(), self.close(m.end(), m[2])
            if end < 0:
                if kind not in NOT_ENTRIES:
                    yield {"entry_type": kind, "key": None, "fields": {}, "raw": self.text[m.start() :], "problem": "unmatched bracket"}
                at = m.end()
                continue
            body, at = self.text[m.end() : end], end + 1
            if kind == "string":
                self.strings.update({k: v for k, v in self.fields(body).items()})
            elif kind not in NOT_ENTRIES:
                key, _, rest = body.partition(",")
                yield {"entry_type": kind, "key": key.strip(), "fields": self.fields(rest), "raw": self.text[m.start() : at], "problem": None}


@F.pandas_udf(T.ArrayType(ENTRY))
def parse_bib(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: list(Reader(t or "").entries()))


def read_text_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file, text) of whole files under a path that Spark can read."""
    return spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def entries_of(texts: DataFrame) -> DataFrame:
    """Entries of (file, text): entry_id, key, entry_type, file, ord, fields, raw, problem, and the common fields."""
    rows = texts.select("file", F.posexplode(parse_bib("text")).alias("ord", "e"))
    rows = rows.select("file", F.col("ord").cast("long").alias("ord"), "e.*").withColumn("entry_id", F.col("key"))
    return promote(rows)


def read_bib(spark: SparkSession, path: str) -> DataFrame:
    return entries_of(read_text_files(spark, path, "*.bib"))


def dropped_keys(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """(file, key, place) of keys that a file declares and no entry has, in order."""
    declared = F.regexp_extract_all("text", F.lit(r"(?m)^\s*@(?!(?i:comment|string|preamble)\b)[A-Za-z]+\s*[{(]\s*([^,\s{}()]+)\s*,"), 1)
    rows = texts.select("file", F.posexplode(declared).alias("place", "key"))
    first = rows.groupBy("file", "key").agg(F.min("place").alias("place"))
    return first.join(entries.select("file", "key"), ["file", "key"], "left_anti")


def entry_text(entry_type: Column, key: Column, fields: Column) -> Column:
    """An entry as text, two spaces before each field, fields in order of name."""
    pairs = F.array_sort(F.filter(F.map_entries(fields), lambda p: F.coalesce(p["value"], F.lit("")) != ""))
    lines = F.transform(pairs, lambda p: F.concat(F.lit("  "), p["key"], F.lit(" = {"), p["value"], F.lit("}")))
    return F.concat(F.lit("@"), entry_type, F.lit("{"), key, F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}\n"))


def write_bib(entries: DataFrame, path: str) -> None:
    """All entries as one text in order of ord; Spark's commit puts the file in place whole."""
    out = entries.select("ord", entry_text(F.col("entry_type"), F.col("entry_id"), F.col("fields")).alias("value"))
    out.coalesce(1).sortWithinPartitions("ord").select("value").write.mode("overwrite").text(path)


@F.pandas_udf(T.StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    import difflib

    return pd.Series(["\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), "old", "new", lineterm="")) for a, b in zip(old, new, strict=True)])
