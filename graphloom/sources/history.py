"""Mining of histories and source trees: commit logs, diffs, markers, tagged lines."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

RECORD, UNIT = "\x1e", "\x1f"


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """(hash, date, subject, body) of a log written with %H%x1f%ad%x1f%s%x1f%b%x1e."""
    parts = F.split(F.regexp_replace("value", "^\n", ""), UNIT)
    rows = spark.read.text(path, lineSep=RECORD).filter(F.length(F.trim("value")) > 1)
    return rows.select(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("hash", "date", "subject", "body"))))


def is_revert(subject: Column, body: Column) -> Column:
    return subject.rlike(r"^Revert\b") | F.contains(F.coalesce(body, F.lit("")), F.lit("This reverts commit"))


def reverted_subject(subject: Column) -> Column:
    """The subject without nested ``Revert "..."``."""
    return F.regexp_replace(F.regexp_replace(subject, '^(Revert ")+', ""), '"+$', "")


def revert_groups(commits: DataFrame) -> DataFrame:
    """Per reverted subject: reverts, first_hash, last_hash."""
    own = commits.filter(is_revert(F.col("subject"), F.col("body"))).select("hash", reverted_subject(F.col("subject")).alias("reverted"))
    return own.groupBy("reverted").agg(F.count("*").alias("reverts"), F.min("hash").alias("first_hash"), F.max("hash").alias("last_hash"))


def _lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("line_no"), "line")


def scan_markers(files: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, line_no, marker): group 1 of each match, lines from 1."""
    hits = _lines(files.filter(F.col(text).rlike(pattern)), key, text)
    return hits.select(key, "line_no", F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(1))).alias("marker"))


def tagged_lines(files: DataFrame, key: str, text: str, tags: tuple[str, ...] = ("HACK", "FIXME", "WORKAROUND", "XXX"), width: int = 200) -> DataFrame:
    """(key, line_no, tag, line) of lines that hold a tag as a word; lines are cut to ``width``."""
    pattern = rf"(?i)\b({'|'.join(tags)})\b"
    hits = _lines(files.filter(F.col(text).rlike(pattern)), key, text).withColumn("tag", F.regexp_extract("line", pattern, 1)).filter("tag <> ''")
    return hits.select(key, "line_no", F.upper("tag").alias("tag"), F.substring("line", 1, width).alias("line"))


@udtf(returnType="path: string, line_no: int, line: string")
class AddedLines:
    """Added lines of a unified diff, with their numbers on the new side."""

    def eval(self, diff: str):
        path, at = None, 0
        for line in (diff or "").split("\n"):
            if line.startswith("+++ "):
                name = line[4:].split("\t")[0]
                path = None if name == "/dev/null" else name.removeprefix("b/")
            elif line.startswith("@@"):
                at = int(line.split("+", 1)[1].split(" ", 1)[0].split(",")[0])
            elif path is not None and line.startswith("+"):
                yield path, at, line[1:]
                at += 1
            elif path is not None and line.startswith(" "):
                at += 1


def _git(root: str, *args: str) -> list[str]:
    out = subprocess.run(["git", "-C", root, "-c", "core.quotepath=false", *args], check=True, capture_output=True, text=True).stdout
    return [x for x in out.split("\0") if x]


def _paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in sorted(set(paths))], "path string")


def tracked_files(spark: SparkSession, root: str, folder: str | None = None) -> DataFrame:
    """(path) of a work tree's tracked files, or of those right in ``folder``."""
    found = _git(root, "ls-files", "-z")
    return _paths(spark, found if folder is None else [p for p in found if (p.rpartition("/")[0] or ".") == folder])


def changed_files(spark: SparkSession, root: str, revisions: str | None = None) -> DataFrame:
    """(path) that a range of revisions changed; without one, what the work tree changed since its head, new files included."""
    if revisions is not None:
        return _paths(spark, _git(root, "diff", "-z", "--name-only", revisions))
    return _paths(spark, _git(root, "diff", "-z", "--name-only", "HEAD") + _git(root, "ls-files", "-z", "--others", "--exclude-standard"))
