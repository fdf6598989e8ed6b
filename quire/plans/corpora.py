"""File tables derived from document, page and conversation tables.

Every document becomes a file whose path and content variant depend on its id, so that all
reject reasons, languages and path shapes occur in proportion to the data. The expressions
are SQL text that Spark and other engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ID = "cast(doc_id AS string)"

FILE_PATH = f"""CASE doc_id % 16
 WHEN 0 THEN concat('src/', lang, '/mod_', {_ID}, '.py')
 WHEN 1 THEN concat('src/', lang, '/main_', {_ID}, '.c')
 WHEN 2 THEN concat('docs/', lang, '/note_', {_ID}, '.md')
 WHEN 3 THEN concat('tools/run_', {_ID})
 WHEN 4 THEN concat('node_modules/pkg/', {_ID}, '.js')
 WHEN 5 THEN concat('build/out_', {_ID}, '.txt')
 WHEN 6 THEN concat('build/keep/', {_ID}, '.txt')
 WHEN 7 THEN concat('conf/', {_ID}, '/credentials.txt')
 WHEN 8 THEN concat('logs/app_', {_ID}, '.log')
 WHEN 9 THEN concat('keys/tok_', {_ID}, '.txt')
 WHEN 10 THEN concat('data/blob_', {_ID}, '.dat')
 WHEN 11 THEN concat('empty/', {_ID}, '.txt')
 WHEN 12 THEN concat('big/', {_ID}, '.txt')
 WHEN 13 THEN concat('mk/', {_ID}, '/Makefile')
 WHEN 14 THEN concat('odd/we&ird <', {_ID}, '>.txt')
 ELSE concat('src/', lang, '/deep/a/b/', {_ID}, '.sql') END"""

FILE_TEXT = f"""CASE doc_id % 16
 WHEN 1 THEN concat(text, chr(10))
 WHEN 2 THEN concat(text, chr(10), '```', chr(10), 'code', chr(10), '```')
 WHEN 3 THEN concat('#!/usr/bin/env python3', chr(10), text)
 WHEN 9 THEN concat(text, chr(10), 'AKIA', lpad({_ID}, 16, '0'))
 WHEN 10 THEN concat(text, chr(0))
 WHEN 11 THEN ''
 WHEN 12 THEN repeat('x', cast(102401 + doc_id - doc_id AS int))
 ELSE text END"""

_D = "cast(floor(doc_id / {}) AS bigint)"
DEEP_PATH = f"""concat(
 CASE doc_id % 5 WHEN 0 THEN 'apps' WHEN 1 THEN 'build' WHEN 2 THEN 'src'
   WHEN 3 THEN 'vendor' ELSE 'docs' END, '/',
 CASE {_D.format(5)} % 6 WHEN 0 THEN 'web' WHEN 1 THEN 'keep' WHEN 2 THEN 'node_modules'
   WHEN 3 THEN 'cache' WHEN 4 THEN 'docs' ELSE 'lib' END, '/',
 CASE {_D.format(30)} % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'dist' WHEN 2 THEN 'gen' ELSE 'b' END, '/',
 CASE doc_id % 7 WHEN 0 THEN 'main.c' WHEN 1 THEN 'x.log' WHEN 2 THEN 'note.tmp'
   WHEN 3 THEN 'keep.tmp' WHEN 4 THEN 'lib.so' WHEN 5 THEN '.env' ELSE 'readme.md' END)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_files(rows: DataFrame) -> DataFrame:
    """``(repo, path, text)`` rows as a ``files`` table."""
    return rows.select(
        "repo",
        "path",
        F.col("text").cast("binary").alias("content"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.lit("file").alias("kind"),
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per document in 16 variants; the repository is the document's source."""
    return as_files(
        table(spark, sf_dir, "documents").select(
            F.col("source").alias("repo"),
            F.expr(FILE_PATH).alias("path"),
            F.expr(FILE_TEXT).alias("text"),
        )
    )


def plain_document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plain text file per document."""
    return as_files(
        table(spark, sf_dir, "documents").select(
            F.col("source").alias("repo"),
            F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
            "text",
        )
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per web page; the repository is the host."""
    parts = r"^https?://([^/]+)/?([^?#]*)"
    return as_files(
        table(spark, sf_dir, "pages").select(
            F.regexp_extract("url", parts, 1).alias("repo"),
            F.concat(
                F.lit("p"), F.col("page_id").cast("string"), F.lit("/"),
                F.regexp_extract("url", parts, 2), F.lit("_index.html"),
            ).alias("path"),
            F.col("html").alias("text"),
        )
    )


def turn_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per conversation turn; the repository is the speaker's role."""
    return as_files(
        table(spark, sf_dir, "conversations").select(
            F.col("role").alias("repo"),
            F.concat(
                F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("/"),
                F.col("turn").cast("string"), F.lit(".md"),
            ).alias("path"),
            "text",
        )
    )


# --- two snapshots -----------------------------------------------------------
# Base leaves out every seventh document, head every eleventh. In head one document in
# thirteen moves to another folder, every second of them with a new last line, and of those that stay one in five has another third
# line, a new first line, or no second line.
HEAD_PATH = f"""CASE WHEN doc_id % 13 = 0 THEN concat('moved/doc/', {_ID}, '.txt')
 ELSE concat('doc/', {_ID}, '.txt') END"""


def head_text(group: str) -> str:
    """SQL for the text in head; ``group`` is how the engine writes the first group."""
    line = "[^' || chr(10) || ']*"
    return f"""CASE WHEN doc_id % 26 = 13 THEN concat(text, chr(10), 'moved ', {_ID})
 WHEN doc_id % 13 = 0 THEN text
 WHEN doc_id % 5 = 0 THEN regexp_replace(text,
   '^((?:{line}' || chr(10) || '){{2}}){line}', concat('{group}', 'changed ', {_ID}))
 WHEN doc_id % 5 = 1 THEN concat('inserted ', {_ID}, chr(10), text)
 WHEN doc_id % 5 = 2 THEN regexp_replace(text,
   '^({line}' || chr(10) || '){line}' || chr(10), '{group}')
 ELSE text END"""


def base_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(
        table(spark, sf_dir, "documents")
        .filter("doc_id % 7 <> 0")
        .select(
            F.col("source").alias("repo"), F.expr(f"concat('doc/', {_ID}, '.txt')").alias("path"),
            "text",
        )
    )


def head_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(
        table(spark, sf_dir, "documents")
        .filter("doc_id % 11 <> 0")
        .select(
            F.col("source").alias("repo"),
            F.expr(HEAD_PATH).alias("path"),
            F.expr(head_text("$1")).alias("text"),
        )
    )


def rearranged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose halves change places, with the second line once more at the end and every seventh line gone."""
    lines = F.split("text", "\n")
    n = F.size(lines)
    half = F.floor(n / 2).cast("int")
    turned = F.concat(
        F.slice(lines, half + 1, n - half), F.slice(lines, F.lit(1), half), F.slice(lines, F.lit(2), F.lit(1)))
    kept = F.filter(turned, lambda _, i: i % 7 != 5)
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"),
        F.expr(f"concat('doc/', {_ID}, '.txt')").alias("path"),
        F.col("text").alias("base_text"), F.array_join(kept, "\n").alias("head_text"))


# --- version-control text ----------------------------------------------------
_NUL = "chr(0)"
CHANGE_LOG = f"""CASE WHEN doc_id % 19 = 0 THEN concat('M', {_NUL}, 'cut_', {_ID})
 ELSE concat('M', {_NUL}, 'src/m_', {_ID}, '.c', {_NUL},
  'R100', {_NUL}, 'old/', {_ID}, '.c', {_NUL}, 'new/', {_ID}, '.c', {_NUL},
  CASE WHEN doc_id % 3 = 0 THEN 'D' ELSE 'A' END, {_NUL}, 'A', {_NUL}) END"""

PATCH = f"""CASE WHEN doc_id % 97 = 0 THEN concat('@@ -1 @@ broken', chr(10))
 ELSE concat('--- a/x', chr(10), '+++ b/x', chr(10),
  '@@ -1,2 +', cast(doc_id % 5 AS string), ',', cast(doc_id % 4 AS string), ' @@ fn', chr(10),
  '+new', chr(13), chr(10), '-@@ old', chr(10),
  '@@ -3 +', cast(3 + doc_id % 17 AS string), ' @@', chr(13), chr(10),
  '@@ -40,0 +', cast(12 + doc_id % 90 AS string), ',2 @@', chr(10)) END"""

PATH_LIST = f"""concat(CASE WHEN doc_id % 3 = 0 THEN concat('doc/', {_ID}, '.txt', chr(13), chr(10), chr(10),
 './doc/', cast(doc_id - doc_id % 2 AS string), '.txt', chr(10)) ELSE '' END, 'missing/', {_ID}, '.c')"""


def change_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"), F.expr(CHANGE_LOG).alias("blob")
    )


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"),
        F.expr(f"concat('doc/', {_ID}, '.txt')").alias("path"),
        F.expr(PATCH).alias("patch"),
    )


def path_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path list per document: a missing file, and on every third also its own and the even
    one next to it."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"), F.expr(PATH_LIST).alias("blob")
    )
