"""Whole artifacts that come in parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import ExportOptions, export_files
from quire.operators.unpack import judged_whole, unpack, with_flags
from quire.plans import catalog


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_no_row_holds_a_whole_large_artifact(spark, tmp_path, monkeypatch):
    rows = [(i, f"line {i}\n" * 6000, "en", f"src{i % 6}", 1) for i in range(240)]
    longest = []

    def seen(artifacts):
        longest.append(artifacts.agg(F.max(F.octet_length("body"))).head()[0])
        return with_flags(artifacts)

    monkeypatch.setattr(catalog, "with_flags", seen)
    found = {tuple(r) for r in catalog.broken_artifacts(spark, documents(spark, tmp_path, rows)).collect()}
    assert found == {("src0", "malformed", 0), ("src1", "hunk_export", 0), ("src2", "malformed", 0),
                     ("src3", "invalid_line_number", 40), ("src4", "unsafe_path", 40), ("src5", "ok", 40)}
    # A block of some 120 kB may reach over the end of a part.
    assert longest[0] < 1_300_000


def test_parts_of_any_size_give_the_same(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i}\nmore", "en", None if i % 8 == 7 else f"src{i % 8}", 1) for i in range(48)]
    folder = documents(spark, tmp_path, rows)
    results = []
    # The end marker alone is shorter than what is cut, so the cut reaches into the part before.
    for size in (2_000_000_000, 400, 60, 1):
        monkeypatch.setattr(catalog, "ARTIFACT_PART", size)
        results.append(sorted(map(str, catalog.broken_artifacts(spark, folder).collect())))
    assert len(results[0]) == 8 and results.count(results[0]) == 4


def test_files_of_parts_are_those_of_the_whole(spark, make_files):
    files = {(f"r{i % 3}", f"d/{i}.c"): f"int x{i};\n" * i for i in range(1, 30)}
    for options in (ExportOptions(line_numbers=True, generated_at="T"), ExportOptions(generated_at="T")):
        export = export_files(make_files(files), options)
        columns = ["repo", "path", "text", "status"]
        read = {}
        for size in (1 << 30, 200):
            parts = export.parts(size).select("repo", "part", "body")
            read[size] = sorted(map(tuple, judged_whole(unpack(with_flags(parts))).select(*columns).collect()))
        assert read[200] == read[1 << 30] and len(read[200]) == len(files)
