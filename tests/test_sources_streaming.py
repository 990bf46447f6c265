import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tesserae import streaming
from tesserae.language.session import Session
from tesserae.operators import health
from tesserae.sources import documents, pages, snapshots, suites


def test_snapshot_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, None, None)], "i long, t string, a array<long>")
    snapshots.export_snapshot({"x": df}, f"file://{tmp_path}/s")
    back = snapshots.import_snapshot(spark, f"file://{tmp_path}/s")["x"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "u.json").write_text('{"i": 1, "more": "kept"}\n')
    assert snapshots.with_unknown_fields(spark, f"file://{tmp_path}/u.json", "i long").first()["extra"] == '{"more":"kept"}'
    digests = snapshots.backup({"x": df}, f"file://{tmp_path}/b")
    assert snapshots.verify_backup(spark, f"file://{tmp_path}/b", digests) == []


def test_suites(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("q1\tWhat?\nq2\tWhy \"so\"?\n")
    (tmp_path / "r.tsv").write_text("q1\tQ0\td1\t1\nq1\tQ0\td1\t0\n")
    assert suites.topics_tsv(spark, f"file://{tmp_path}/q.tsv").count() == 2
    with pytest.raises(ValueError, match="repeats"):
        suites.qrels_trec(spark, f"file://{tmp_path}/r.tsv")
    (tmp_path / "run.json").write_text('{"run_id": "a", "query_id": "q1", "status": "failed", "candidates": ["d"]}\n')
    with pytest.raises(ValueError):
        suites.run_json(spark, f"file://{tmp_path}/run.json")


def test_documents(spark, tmp_path):
    def pack(name, files):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for k, v in files.items():
                z.writestr(k, v)
        (tmp_path / name).write_bytes(data.getvalue())

    pack("a.epub", {"META-INF/container.xml": '<c xmlns="x"><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<p xmlns="x"><item id="c" href="c.html"/><itemref idref="c"/></p>', "o/c.html": "<h1>Title</h1><p>One &amp; <b>two</b></p>"})
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    pack("b.docx", {"word/document.xml": f'<w:d xmlns:w="{w}"><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:d>'})
    (tmp_path / "c.docx").write_bytes(b"broken")
    rows = documents.read_documents(spark, f"file://{tmp_path}").orderBy("document_id", "ordinal").collect()
    assert [(r["kind"], r["text"]) for r in rows[:4]] == [("heading", "Title"), ("paragraph", "One & two"), ("heading", "Head"), ("paragraph", "Body")]
    assert rows[4]["kind"] == "error"


def test_pages(spark, tmp_path):
    rows = spark.createDataFrame([("a", "A", "text"), ("b", "B", None)], "row_id string, title string, body string")
    edges = spark.createDataFrame([("a", "cites", "b"), ("a", "cites", "gone")], "source_id string, relation_type string, target_id string")
    found = pages.render(rows, edges)
    assert {r["row_id"]: "[[" in r["page"] for r in found.collect()} == {"a": True, "b": True}
    path = f"file://{tmp_path}/w"
    assert pages.sync(spark, found, path) == {"pages": 2, "written": 2, "removed": 0}
    assert (tmp_path / "w" / "p-a.md").read_text().startswith("# A\n\ntext\n\n## Relations")
    changed = pages.render(rows.where("row_id = 'a'").union(spark.createDataFrame([("c/ü", "C", "x")], rows.schema)), edges)
    assert pages.sync(spark, changed, path) == {"pages": 2, "written": 2, "removed": 1}
    assert pages.sync(spark, changed, path) == {"pages": 2, "written": 0, "removed": 0}
    assert sorted(p.name for p in (tmp_path / "w").glob("*.md")) == ["p-a.md", "p-c_2F__C3BC_.md"]


def test_tail_and_ingest(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}/store")
    s.execute("CREATE DATABASE d PURPOSE 'x' SCOPE 'y'")
    s.execute("CREATE DATABASE e PURPOSE 'x' SCOPE 'y'")
    q = streaming.tail_changes(spark, s.log.root).select("commit_sequence").writeStream.format("memory").queryName("tail").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r[0] for r in spark.table("tail").collect()) == [1, 2]
    run = streaming.ingest(spark, f"file://{tmp_path}/t", f"file://{tmp_path}/x", "id", F.sha2("v", 256))
    batch = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, v string")
    run(batch, 0)
    run(batch, 0)
    run(spark.createDataFrame([(2, "other"), (3, "c")], "id long, v string"), 1)
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 3
    assert [r["id"] for r in spark.read.parquet(f"file://{tmp_path}/x").collect()] == [2]


def test_read_windows_and_chain(spark):
    nodes = spark.createDataFrame([("k", i, "x" * n) for i, n in enumerate([3, 3, 3, 20, 1])], "k string, o long, t string")
    got = sorted((r["window"], r["first"], r["last"], r["n_bytes"]) for r in health.read_windows(nodes, "k", "o", "t", 2, 10).collect())
    assert got == [(0, 0, 1, 6), (1, 2, 2, 3), (2, 3, 3, 20), (3, 4, 4, 1)]
    journal = spark.createDataFrame([("j", 0, None, "a"), ("j", 1, "a", "b"), ("j", 2, "x", "c")], "job_id string, seq long, previous string, hash string")
    assert [r["seq"] for r in streaming.chain_breaks(journal).collect()] == [2]
