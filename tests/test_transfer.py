import pytest
from helpers import DOC, FOLDER, FORM, SHEET, SLIDES, catalog, file, folder
from pyspark.sql import functions as F

from leafgrid.operators.transfer import classify, export_plan, summarize, transfer_manifest
from leafgrid.operators.walk import walk_tree
from leafgrid.plans.download import plan_download, plan_source
from leafgrid.schemas import DRIVE_CATALOG


def test_classes(spark):
    files = catalog(
        spark,
        [
            file("1", "a", mime="application/pdf"), file("2", "a", mime=DOC),
            file("3", "a", mime=SHEET), file("4", "a", mime=SLIDES), file("5", "a", mime=FORM),
            file("6", "a", mime="application/vnd.google.colaboratory"), folder("7", "a"),
            file("8", "a", mime="application/vnd.google-apps.shortcut"),
        ],
    )
    got = {r["id"]: r["disposition"] for r in classify(files).collect()}
    assert got == {
        "1": "binary", "2": "export", "3": "export", "4": "export", "5": "skip", "6": "binary",
        "8": "skip",
    }


def sample(spark):
    return catalog(
        spark,
        [
            file("p", "a.pdf", "r", "application/pdf", size="100"),
            file("n", "nan.bin", "r", "application/x", size="NaN"),
            file("d", "doc", "r", DOC), file("s", "slides", "r", SLIDES),
            file("f", "form", "r", FORM),
            folder("e", "empty/..", "r"), folder("g", "..", "r"),
            file("i", "in:side", "g"), folder("deep", "deep", "g"),
        ],
    )


def test_summary(spark):
    row = summarize(walk_tree(sample(spark), "r", 2)).first().asDict()
    assert row == {
        "binary_files": 3, "binary_bytes": 100, "auto_export": 2, "skipped_natives": 1,
        "subfolders": 2, "skipped_subfolders": 1,
    }
    assert set(summarize(walk_tree(sample(spark), "none")).first()) == {0}


@pytest.mark.parametrize(
    "out, top, below", [(".", ".", "__"), ("out//x/", "out/x", "out/x/__"), ("/", "/", "/__")]
)
def test_manifest(spark, out, top, below):
    rows = transfer_manifest(walk_tree(sample(spark), "r", 2), out).collect()
    got = {r["id"]: (r["action"], r["dir"], r["base"]) for r in rows}
    assert got == {
        "g": ("mkdir", top, "__"), "e": ("mkdir", top, "empty_.."),
        "i": ("binary", below, "in:side"), "deep": ("skip_depth", below, "deep"),
        "p": ("binary", top, "a.pdf"), "n": ("binary", top, "nan.bin"),
        "d": ("export", top, "doc.docx"), "s": ("export", top, "slides.pptx"),
        "f": ("skip_native", top, "form"),
    }


def test_export_requests(spark):
    requests = spark.createDataFrame(
        [
            ("https://docs.google.com/document/d/X/edit", "a/b.DOCX"), ("ID", "t.csv"),
            ("ID", "t.pdf"), ("ID", "noext"), ("https://x.org/none", "t.xlsx"),
        ],
        "source string, output string",
    )
    rows = export_plan(requests).collect()
    office = "application/vnd.openxmlformats-officedocument"
    assert [(r["id"], r["mime"], r["status"] == "ok") for r in rows] == [
        ("X", f"{office}.wordprocessingml.document", True), ("ID", "text/csv", True),
        ("ID", None, False), ("ID", None, False), (None, f"{office}.spreadsheetml.sheet", False),
    ]
    assert ".csv, .docx, .pptx, .xlsx" in rows[2]["status"]


def test_plan_of_a_folder(spark):
    plan = plan_download(sample(spark), "r", "out")
    assert plan.summary.first()["subfolders"] == 3
    got = {r["id"]: r["target"] for r in plan.manifest.collect() if r["target"]}
    assert got == {
        "i": "out/__/in:side", "p": "out/a.pdf", "n": "out/nan.bin", "d": "out/doc.docx",
        "s": "out/slides.pptx",
    }
    assert plan.conflicts.isEmpty()


def test_plan_with_nothing_to_transfer(spark):
    files = catalog(spark, [folder("e", "empty", "r"), file("f", "form", "r", FORM)])
    plan = plan_download(files, "r", "out")
    assert plan.summary.first()["skipped_natives"] == 1
    assert plan.manifest.isEmpty()


def test_plan_of_one_file(spark):
    plan = plan_download(sample(spark), "d", "here")
    assert [r["target"] for r in plan.manifest.collect()] == ["here/doc.docx"]
    taken = spark.createDataFrame([("here", False)], "path string, is_dir boolean")
    blocked = plan_download(sample(spark), "d", "here", existing=taken)
    assert [r["path"] for r in blocked.conflicts.collect()] == ["here"]


def test_plan_from_a_link_or_a_path(spark):
    drives = spark.createDataFrame([("r", "personal", "My Drive", "", 0)], DRIVE_CATALOG)

    def planned(source):
        plan = plan_source(sample(spark), drives, source, "o")
        return sorted(r["target"] for r in plan.manifest.collect() if r["target"])

    assert planned("my drive/DOC") == ["o/doc.docx"]
    assert planned("https://drive.google.com/drive/folders/g") == ["o/in:side"]
    for source, status in [("My Drive/none", "not_found"), ("https://drive.google.com/x", "no_id_in_url")]:
        with pytest.raises(ValueError, match=status):
            planned(source)
