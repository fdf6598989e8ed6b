from __future__ import annotations

from quire import ExportOptions
from quire.operators.decisions import decisions
from quire.streaming import read_file_stream, stream_decisions, stream_file_blocks


def test_files_are_classified_as_they_arrive(spark, make_files, tmp_path):
    source, options = str(tmp_path / "in"), ExportOptions()
    first = make_files({"a.c": "x\n", "b.log": "x", "build/c.c": "y"})
    second = make_files({"d.py": "z\n", "e.txt": ""})

    def run():
        for start, name in ((stream_decisions, "decisions"), (stream_file_blocks, "blocks")):
            query = start(
                read_file_stream(spark, source), options, str(tmp_path / name),
                str(tmp_path / f"{name}-checkpoint"), available_now=True,
            )
            query.awaitTermination()

    first.write.mode("append").parquet(source)
    run()
    second.write.mode("append").parquet(source)
    run()
    got = spark.read.parquet(str(tmp_path / "decisions")).select("path", "skip_reason").collect()
    batch = decisions(first.unionByName(second), options).select("path", "skip_reason").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, batch), key=str)
    blocks = spark.read.parquet(str(tmp_path / "blocks")).collect()
    assert sorted(r.path for r in blocks) == ["a.c", "d.py"]
