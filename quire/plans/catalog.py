"""Named queries over the standard tables, each ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.ignore import IgnoreRules
from quire.functions.language import shebang_language
from quire.functions.paths import (
    basename,
    contained_path,
    decode_heading,
    escape_markdown,
    visible_text,
)
from quire.functions.sensitive import SecretRule, is_sensitive_name
from quire.functions.text import (
    estimate_tokens,
    fence_length,
    is_binary,
    line_count,
    split_lines,
    with_final_newline,
)
from quire.operators import changes as change_ops
from quire.operators import delta, hunks as hunk_ops, renames
from quire.operators.change_lists import read_change_lists
from quire.operators.decisions import decisions, entries, skip_counters, skip_summary
from quire.operators.findings import secret_findings
from quire.operators.ignore_files import with_own_rules
from quire.operators.render import file_blocks
from quire.operators.scale import stored, written_folder
from quire.operators.selection import in_subtree, parse_path_lists, select_files, worktree_paths
from quire.operators.stored_artifacts import unpack_stored
from quire.operators.tree import tree_nodes, tree_rows
from quire.operators.unpack import judged_whole, unpack, with_flags
from quire.options import ExportOptions
from quire.plans import corpora
from quire.plans.export import export_changes, export_files, export_snapshots
from quire.sources.splits import folder_value

Query = Callable[[SparkSession, str], DataFrame]

STAMP = "2026-01-01T00:00:00Z"
#: A size limit that admits every text, where the limit is not what a query shows.
WHOLE = 2**31 - 1
SCAN = ExportOptions(ignore_lines=("!build/keep/*.txt",), generated_at=STAMP)
NUMBERED = ExportOptions(
    ignore_lines=("!build/keep/*.txt",), generated_at=STAMP, line_numbers=True
)
HUNKS = ExportOptions(mode="staged", generated_at=STAMP, hunks=True, hunk_context=2, max_file_bytes=WHOLE)
#: Parts this small make every repository continue over several rows.
SMALL_PART = 65_536
#: Parts of whole artifacts: a repository may be larger than any row.
ARTIFACT_PART = 1_048_576
#: Characters missing at the end of an artifact that breaks off.
CUT_END = 40
BUDGET = ExportOptions(
    ignore_lines=("!build/keep/*.txt",), generated_at=STAMP, warn_tokens=20_000, max_tokens=24_000
)

SHARED = ExportOptions(ignore_lines=("cache/*",), max_file_bytes=10_000_000)
DEEP_RULES = IgnoreRules([
    "vendor/", "!vendor/keep/", "*.tmp", "!keep.tmp", "/apps/**/gen/", "!build/**/dist/main.c",
    "docs/**", "!docs/web/", "cache/*",
])
BRACKET_RULES = IgnoreRules([
    "[nk]*.t[!a-l]p", "!k[[:alpha:]]ep.tmp", "/[a-d]*/[!w]*/", "!build/k[aeiou]ep/", "re[]a]dme.md", "[!.]e[m-o]v",
], use_defaults=False)
PRUNE_RULES = IgnoreRules(["vendor/", "!vendor/keep/", "*.tmp", "/apps/**/gen/", "docs/**"])


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return corpora.table(spark, sf_dir, "documents").select(*columns)


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(corpora.document_files(spark, sf_dir), SCAN)


def _entries(spark: SparkSession, sf_dir: str, options: ExportOptions = SCAN) -> DataFrame:
    return entries(corpora.document_files(spark, sf_dir), options)


# --- decisions ---------------------------------------------------------------


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on links and other kinds besides regular files, none of them read."""
    kind = F.expr("CASE length(path) + size % 7 WHEN 10 THEN 'symlink' WHEN 11 THEN 'other' WHEN 12 THEN 'unreadable' "
                  "WHEN 13 THEN 'unreadable_dir' WHEN 14 THEN 'changed' ELSE 'file' END")
    files = corpora.plain_document_files(spark, sf_dir).withColumn("kind", kind)
    return decisions(files, ExportOptions(mode="stdin", max_file_bytes=WHOLE)).select("repo", "path", "skip_reason")


def invalid_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary test of texts that end in overlong, cut-off, surrogate, too large and valid sequences."""
    tail = F.expr("CASE doc_id % 8 WHEN 0 THEN X'C328' WHEN 1 THEN X'EDA080' WHEN 2 THEN X'F4908080' WHEN 3 THEN X'C080' "
                  "WHEN 4 THEN X'C3A9' WHEN 5 THEN X'E282' WHEN 6 THEN X'F09F9880' ELSE X'EE8080' END")
    return _documents(spark, sf_dir, "doc_id", is_binary(F.concat(F.col("text").cast("binary"), tail)).alias("binary"))


def file_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir)


def skip_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skip_summary(_decided(spark, sf_dir))


def skip_counters_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skip_counters(_decided(spark, sf_dir))


def selected_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given paths: no ignore rules, sensitive files allowed."""
    options = ExportOptions(mode="stdin", allow_sensitive=True, max_file_bytes=10_240)
    return skip_summary(decisions(corpora.document_files(spark, sf_dir), options))


def binary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with a number of control characters around the limit of 3 %."""
    head = F.concat(
        F.col("text"),
        F.expr("repeat(chr(7), cast(greatest(0, octet_length(text) * 3 div 97 + doc_id % 6 - 2) AS int))"),
        F.expr("CASE WHEN doc_id % 29 = 0 THEN chr(0) ELSE chr(9) END"),
    )
    return _documents(spark, sf_dir, "doc_id", head.alias("t")).select(
        "doc_id", is_binary(F.col("t").cast("binary")).alias("is_binary")
    )


def sensitive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr(corpora_name_sql())
    return _documents(spark, sf_dir, "doc_id", name.alias("path")).select(
        "doc_id", "path", is_sensitive_name(basename(F.col("path"))).alias("is_sensitive")
    )


def corpora_name_sql() -> str:
    names = (
        "credentials.txt", "credential.txt", ".env.local", "secret.txt", "Secrets.json", "id_dsa",
        ".envrc", "credentials-prod.txt", "credentials-guide.md", "secretary_notes.md",
        "id_rsa_backup", "ID_RSA", "server.PEM", "a.key", "a.key.txt", ".env", "main.c", "x.env",
    )
    arms = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(names))
    return (
        f"concat('d', cast(doc_id AS string), '/', CASE doc_id % {len(names)} {arms} END)"
    )


# --- row functions -----------------------------------------------------------


def language_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("repo", "path", "lang")


SHEBANGS = (
    "#!/usr/bin/env python3", "#!/bin/bash", "#! /bin/sh -e", "#!/usr/bin/env node",
    "#!/usr/local/bin/ruby", "#!/usr/bin/perl -w", "#!lua", "#!/usr/bin/pwsh",
    "#!/usr/bin/python3.11", "#!/usr/bin/env", "# no header", "#!/usr/bin/zsh",
)


def shebang_sql() -> str:
    arms = " ".join(f"WHEN {i} THEN '{line}'" for i, line in enumerate(SHEBANGS))
    return f"concat(CASE doc_id % {len(SHEBANGS)} {arms} END, chr(10), text)"


def shebang_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    script = F.expr(shebang_sql()).cast("binary")
    return _documents(spark, sf_dir, "doc_id", script.alias("c")).select(
        "doc_id", shebang_language(F.col("c")).alias("lang")
    )


def line_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("repo", "path", "total_lines")


def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.posexplode(split_lines(F.concat("text", F.lit("\n")))).alias("pos", "line")
    return _documents(spark, sf_dir, "doc_id", lines).select(
        "doc_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line"
    )


def fence_length_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = F.expr("concat(text, chr(10), repeat('`', cast(doc_id % 9 AS int)), ' ``')")
    return _documents(spark, sf_dir, "doc_id", ticks.alias("t")).select(
        "doc_id", fence_length(F.col("t")).cast("bigint").alias("fence_len")
    )


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text").cast("bigint")
    return _documents(spark, sf_dir, "doc_id", size.alias("n_bytes")).select(
        "doc_id", "n_bytes", estimate_tokens(F.col("n_bytes")).alias("tokens")
    )


def _odd_path() -> str:
    return (
        "concat('a*b/', source, '/[', text, ']', chr(9), '<&>', chr(92), "
        "CASE WHEN doc_id % 5 = 0 THEN chr(7) ELSE '`' END)"
    )


def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading text of awkward paths, and whether reading it gives the path back."""
    path = F.col("path")
    return _documents(spark, sf_dir, "doc_id", F.expr(_odd_path()).alias("path")).select(
        "doc_id",
        escape_markdown(path).alias("heading"),
        visible_text(path).alias("visible"),
        (decode_heading(escape_markdown(path)) == path).alias("round_trip"),
    )


def unsafe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(
        "concat(CASE doc_id % 6 WHEN 0 THEN '/abs/' WHEN 1 THEN '../' WHEN 2 THEN 'a/../' "
        "WHEN 3 THEN 'a/../../' WHEN 4 THEN './x//' ELSE '' END, cast(doc_id AS string), '.txt')"
    )
    return _documents(spark, sf_dir, "doc_id", raw.alias("path")).select(
        "doc_id", "path", contained_path(F.col("path")).alias("safe_path")
    )


# --- secrets -----------------------------------------------------------------


def secret_findings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_findings(corpora.document_files(spark, sf_dir), SCAN)


CONTEXT_RULE = SecretRule(
    "hex_token", "[0-9a-f]{40}", alphabet="0-9a-f", severity="soft", needs_context=True
)


def contextual_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = ExportOptions(mode="stdin", max_file_bytes=WHOLE)
    files = corpora.plain_document_files(spark, sf_dir)
    return secret_findings(files, options, (CONTEXT_RULE,))


# --- ignore rules ------------------------------------------------------------


def ignore_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _documents(spark, sf_dir, "doc_id", F.expr(corpora.DEEP_PATH).alias("path"))
    return paths.select("doc_id", "path", DEEP_RULES.ignored(F.col("path")).alias("ignored"))


def bracket_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with sets, ranges, complements and classes of characters."""
    paths = _documents(spark, sf_dir, "doc_id", F.expr(corpora.DEEP_PATH).alias("path"))
    return paths.select("doc_id", "path", BRACKET_RULES.ignored(F.col("path")).alias("ignored"))


def ignore_pruned_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories a walk would not enter, with the files they hide."""
    pruned = PRUNE_RULES.pruned_directory(F.expr(corpora.DEEP_PATH))
    return (
        _documents(spark, sf_dir, F.col("source").alias("repo"), pruned.alias("directory"))
        .filter(F.col("directory").isNotNull())
        .groupBy("repo", "directory")
        .agg(F.count(F.lit(1)).alias("hidden_files"))
    )


OWN_IGNORE_SQL = (
    "CASE WHEN source LIKE '%1' THEN concat('# own', chr(10), '*.tmp', chr(10), '!keep.tmp') "
    "WHEN source LIKE '%2' THEN concat('docs/', chr(13), chr(10), '!build/lib/') "
    "ELSE concat('/apps/web', chr(10), 'src/**', chr(10), '!src/keep/a/*.c') END"
)


def own_ignore_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions where repositories bring ignore files of three kinds, and some none."""
    documents = corpora.table(spark, sf_dir, "documents")
    texts = documents.filter("source NOT LIKE '%0'").select(
        F.col("source").alias("repo"), F.expr(OWN_IGNORE_SQL).alias("text")
    ).distinct()
    files = corpora.as_files(
        documents.select(
            F.col("source").alias("repo"), F.expr(corpora.DEEP_PATH).alias("path"), "text"
        )
    )
    return decisions(with_own_rules(files, texts, SHARED), SHARED).groupBy("repo", "path").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("skip_reason") == "ignored").alias("n_ignored")
    )


def tracked_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    inventory = _documents(
        spark, sf_dir, F.col("source").alias("repo"), F.expr(corpora.FILE_PATH).alias("path"),
        (F.col("doc_id") % 3 == 0).alias("tracked"),
    )
    return worktree_paths(inventory, SCAN.ignore_rules())


# --- selection and changes ---------------------------------------------------


def path_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_path_lists(corpora.path_lists(spark, sf_dir))


def selected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = select_files(
        corpora.plain_document_files(spark, sf_dir), path_list(spark, sf_dir)
    )
    return entries(chosen, ExportOptions(mode="stdin", max_file_bytes=WHOLE)).select("repo", "path", "n_bytes")


def subtree_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = change_ops.changes_from_name_status(corpora.change_logs(spark, sf_dir))
    return in_subtree(changes, "new/")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_ops.parse_name_status(corpora.change_logs(spark, sf_dir))


def change_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-formed change lists as one large text file per repository, read in splits."""
    logs = corpora.change_logs(spark, sf_dir).filter(~F.col("blob").contains("cut_"))
    location = written_folder(spark)
    # The writer ends every list with the NUL that is cut off here.
    logs.select("repo", F.expr("left(blob, length(blob) - 1)").alias("blob")).repartition("repo").write.partitionBy(
        "repo").option("lineSep", "\0").text(location)
    return read_change_lists(spark, location)


def change_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed change lines and their places: by path, then kind, then previous path."""
    changes = change_ops.changes_from_name_status(corpora.change_logs(spark, sf_dir))
    in_repo = Window.partitionBy("repo").orderBy("order_key")
    return change_ops.change_context(changes).select("repo", "line", F.row_number().over(in_repo).alias("place"))


def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.path_delta(
        corpora.base_snapshot(spark, sf_dir), corpora.head_snapshot(spark, sf_dir)
    ).select("repo", "path", "change_type", "base_sha", "head_sha")


def exact_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = delta.path_delta(
        corpora.base_snapshot(spark, sf_dir), corpora.head_snapshot(spark, sf_dir)
    )
    return delta.exact_renames(stored(found))


def similar_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames of edited files: every second document that moves gets another line."""
    base, head = corpora.base_snapshot(spark, sf_dir), corpora.head_snapshot(spark, sf_dir)
    found = stored(delta.path_delta(base, head))
    return renames.similar_renames(base, head, found, stored(delta.exact_renames(found)))


def change_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed change lines of the files that are exported."""
    head = corpora.head_snapshot(spark, sf_dir)
    changes = change_ops.export_changes(
        delta.snapshot_changes(corpora.base_snapshot(spark, sf_dir), head, renames=False)
    )
    accepted = entries(head, ExportOptions(mode="staged", max_file_bytes=WHOLE))
    survivors = change_ops.surviving_changes(changes, accepted)
    return change_ops.change_context(survivors).select("repo", "line")


# --- changed lines -----------------------------------------------------------


def hunks_from_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hunk_ops.parse_patches(corpora.patches(spark, sf_dir))


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = entries(
        corpora.plain_document_files(spark, sf_dir), ExportOptions(mode="staged", max_file_bytes=WHOLE)
    )
    return hunk_ops.render_ranges(
        hunk_ops.hunks_from_patches(corpora.patches(spark, sf_dir)), described, 1
    )


def render_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir)


def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hunk_ops.merge_ranges(_ranges(spark, sf_dir))


def omission_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hunk_ops.omissions(hunk_ops.merge_ranges(_ranges(spark, sf_dir)))


def line_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = corpora.base_snapshot(spark, sf_dir)
    head = corpora.head_snapshot(spark, sf_dir)
    changes = delta.snapshot_changes(base, head, renames=False)
    head_text = head.select("repo", "path", F.col("content").cast("string").alias("text"))
    return delta.line_hunks(delta.changed_pairs(base, head_text, changes))


def moved_line_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed lines of texts with moved, repeated and deleted lines."""
    return delta.line_hunks(corpora.rearranged_texts(spark, sf_dir))


def sliced_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a patch export: every third document is added, the rest is sliced."""
    files = corpora.plain_document_files(spark, sf_dir)
    changes = _documents(
        spark, sf_dir, F.col("source").alias("repo"),
        F.expr("concat('doc/', cast(doc_id AS string), '.txt')").alias("path"),
        F.expr("CASE WHEN doc_id % 3 = 0 THEN 'A' ELSE 'M' END").alias("change_type"),
        F.lit(None).cast("string").alias("previous_path"),
    )
    options = ExportOptions(mode="staged", hunks=True, hunk_context=1, line_numbers=True, max_file_bytes=WHOLE)
    accepted = entries(files, options)
    hunks = hunk_ops.hunks_from_patches(corpora.patches(spark, sf_dir))
    marked = hunk_ops.with_render_mode(
        accepted, changes, hunk_ops.file_ranges(hunks, accepted, 1)
    )
    return file_blocks(marked, options).select("repo", "path", "body")


def delta_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of whole review artifacts between two snapshots, changed lines only."""
    return export_snapshots(
        corpora.base_snapshot(spark, sf_dir), corpora.head_snapshot(spark, sf_dir), HUNKS
    ).metrics


# --- tree --------------------------------------------------------------------


def tree_nodes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_nodes(_entries(spark, sf_dir)).select(
        "repo", "node", "parent", "name", "depth", "is_dir"
    )


def project_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_rows(_entries(spark, sf_dir)).select("repo", "depth", "is_last", "line")


def tree_depth_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_rows(_entries(spark, sf_dir), max_depth=2).select("repo", "depth", "is_last", "line")


# --- artifacts ---------------------------------------------------------------


def file_blocks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_blocks(_entries(spark, sf_dir), SCAN).select("repo", "path", "body")


def numbered_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_blocks(_entries(spark, sf_dir, NUMBERED), NUMBERED).select("repo", "path", "body")


def _export(spark: SparkSession, sf_dir: str, options: ExportOptions = SCAN):
    return export_files(corpora.document_files(spark, sf_dir), options)


def repo_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _export(spark, sf_dir).metrics


def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _export(spark, sf_dir, BUDGET).metrics.select("repo", "estimated_tokens", "verdict")


def artifact_by_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _export(spark, sf_dir).parts(SMALL_PART).select("repo", "part", "body")


def unpack_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack with line numbers, read back: the accepted files again."""
    parts = _export(spark, sf_dir, NUMBERED).parts(SMALL_PART)
    return unpack(parts).select("repo", "path", "safe_path", "text", "status")


def stored_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write artifacts in ranges, read the folders back: the accepted files again."""
    location = written_folder(spark)
    _export(spark, sf_dir, NUMBERED).write(location, partitions=7)
    return unpack_stored(spark, location).select("repo", "path", "safe_path", "text", "status")


def written_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and bytes of the text files of every artifact."""
    location = written_folder(spark)
    _export(spark, sf_dir, SCAN).write(location, partitions=9)
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(location).select(
        folder_value(F.col("_metadata.file_path"), "repo").alias("repo"), "value")
    return lines.groupBy("repo").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("value") + 1).alias("bytes"))


def broken_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and files of artifacts, most of which break off, hold changed lines, lost a fence or a line number."""
    options = ExportOptions(generated_at=STAMP, line_numbers=True, max_file_bytes=WHOLE)
    # Artifacts of any size, in parts: stored, as they are read for their lengths, their flags and their files.
    whole = stored(export_files(corpora.plain_document_files(spark, sf_dir), options).parts(ARTIFACT_PART).select(
        "repo", "part", "body"))
    last = F.right("repo", F.lit(1))
    body = F.col("body")
    # What is cut from the end of an artifact may reach over its last parts: characters behind each of these.
    behind = Window.partitionBy("repo").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    ends = stored(
        whole.select("repo", "part", F.length(body).alias("n")).withColumn("behind", F.coalesce(F.sum("n").over(behind), F.lit(0)))
        .filter(F.col("behind") < CUT_END).select("repo", "part", "behind"))
    spoiled = (
        F.when(last == "0", F.when(F.col("behind").isNull(), body).otherwise(
            F.left(body, F.greatest(F.length(body) + F.col("behind") - CUT_END, F.lit(0)).cast("int"))))
        .when(last == "1", F.replace(body, F.lit("\nMode: "), F.lit("\nHunks: on (context: 1)\nMode: ")))
        .when(last == "2", F.regexp_replace(body, r"\n\n(`{3,}\n {0,6}1 \| )", "\n\nno fence\n$1"))
        .when(last == "3", F.replace(body, F.lit("1 | "), F.lit("1 ")))
        # A part may begin with a heading, the newline before it being in the part before.
        .when(last == "4", F.regexp_replace(body, r"(\A|\n)## doc/", "$1## ../"))
        .otherwise(body))
    parts = whole.join(ends, ["repo", "part"], "left").select("repo", "part", spoiled.alias("body"))
    read = stored(unpack(with_flags(parts)).select("repo", "path", "status"))
    return judged_whole(read).groupBy("repo", "status").agg(F.count("path").alias("files"))


def page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = ExportOptions(generated_at=STAMP, max_file_bytes=WHOLE)
    return export_files(corpora.page_files(spark, sf_dir), options).metrics


def turn_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = ExportOptions(generated_at=STAMP, line_numbers=True, show_tree=False, max_file_bytes=WHOLE)
    return export_files(corpora.turn_files(spark, sf_dir), options).metrics


def change_log_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of whole-file review artifacts for given change records."""
    files = corpora.plain_document_files(spark, sf_dir)
    changes = _documents(
        spark, sf_dir, F.col("source").alias("repo"),
        F.expr("concat('doc/', cast(doc_id AS string), '.txt')").alias("path"),
        F.expr("CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'R' WHEN 2 THEN 'M' ELSE 'D' END")
        .alias("change_type"),
        F.expr("CASE WHEN doc_id % 4 = 1 THEN concat('old/', cast(doc_id AS string)) END")
        .alias("previous_path"),
    )
    options = ExportOptions(
        mode="diff", diff_range="v1..v2", generated_at=STAMP, show_tree=False, max_file_bytes=WHOLE)
    return export_changes(files, changes, options).metrics


def final_newline(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = with_final_newline(F.col("text"))
    return _documents(spark, sf_dir, "doc_id", line_count(body).alias("total_lines"),
                      F.octet_length(body).cast("bigint").alias("n_bytes"))


QUERIES: dict[str, Query] = {
    "file_decisions": file_decisions,
    "invalid_bytes": invalid_bytes,
    "file_kinds": file_kinds,
    "skip_summary": skip_summary_query,
    "skip_counters": skip_counters_query,
    "selected_decisions": selected_decisions,
    "binary_text": binary_text,
    "sensitive_names": sensitive_names,
    "language_of_file": language_of_file,
    "shebang_language": shebang_query,
    "line_count": line_count_query,
    "line_split": line_split,
    "final_newline": final_newline,
    "fence_length": fence_length_query,
    "token_estimate": token_estimate,
    "heading_paths": heading_paths,
    "unsafe_paths": unsafe_paths,
    "secret_findings": secret_findings_query,
    "contextual_secrets": contextual_secrets,
    "ignore_decisions": ignore_decisions,
    "bracket_rules": bracket_rules,
    "ignore_pruned_dirs": ignore_pruned_dirs,
    "own_ignore_files": own_ignore_files,
    "tracked_union": tracked_union,
    "path_list": path_list,
    "selected_files": selected_files,
    "subtree_scope": subtree_scope,
    "change_log": change_log,
    "change_list_files": change_list_files,
    "snapshot_delta": snapshot_delta,
    "exact_renames": exact_renames,
    "similar_renames": similar_renames,
    "change_context": change_context,
    "change_order": change_order,
    "hunks_from_patch": hunks_from_patch,
    "render_ranges": render_ranges,
    "merged_ranges": merged_ranges,
    "omission_counts": omission_counts,
    "line_hunks": line_hunks,
    "moved_line_hunks": moved_line_hunks,
    "sliced_blocks": sliced_blocks,
    "delta_export": delta_export,
    "change_log_export": change_log_export,
    "tree_nodes": tree_nodes_query,
    "project_tree": project_tree,
    "tree_depth_limited": tree_depth_limited,
    "file_blocks": file_blocks_query,
    "numbered_blocks": numbered_blocks,
    "repo_metrics": repo_metrics,
    "token_budget": token_budget,
    "artifact_by_repo": artifact_by_repo,
    "unpack_roundtrip": unpack_roundtrip,
    "broken_artifacts": broken_artifacts,
    "stored_roundtrip": stored_roundtrip,
    "written_artifacts": written_artifacts,
    "page_metrics": page_metrics,
    "turn_metrics": turn_metrics,
}
