import os
import tempfile

import pytest

from fixtures import DEMO_PROTOTYPES
from setsift.plans.pipeline import RunSettings
from setsift.sources import io


def _write(path, text, bom=False):
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8") as f:
        f.write(text)


def test_read_texts_csv_with_bom_quotes_and_newlines(spark):
    d = tempfile.mkdtemp(prefix="setsift-io-")
    _write(f"{d}/texts.csv", 'case_id,text,outcome\n1,"a, b",1\n2,"line one\nline two",0\n3,"say ""hi""",1\n', bom=True)
    rows = {r.case_id: r for r in io.read_texts(spark, f"{d}/texts.csv", "csv").collect()}
    assert rows[1].text == "a, b"
    assert rows[2].text == "line one\nline two"
    assert rows[3].text == 'say "hi"'
    assert rows[2].outcome == 0


def test_read_prototypes_csv(spark):
    d = tempfile.mkdtemp(prefix="setsift-io-")
    body = "condition_name,prototype,type\n" + "".join(f'{n},"{p}",{t}\n' for n, p, t in DEMO_PROTOTYPES)
    _write(f"{d}/p.csv", body, bom=True)
    p = io.read_prototypes(spark, f"{d}/p.csv")
    assert [tuple(r) for r in p.collect()] == DEMO_PROTOTYPES


def test_required_columns(spark):
    d = tempfile.mkdtemp(prefix="setsift-io-")
    spark.createDataFrame([(1, "x")], "id long, text string").write.parquet(f"{d}/t")
    with pytest.raises(ValueError, match="case_id"):
        io.read_texts(spark, f"{d}/t")
    spark.createDataFrame([(1, 0.5)], "case_id long, x double").write.parquet(f"{d}/s")
    with pytest.raises(ValueError, match="_score"):
        io.read_scores(spark, f"{d}/s")
    with pytest.raises(ValueError, match="outcome"):
        io.read_qca_ready(spark, f"{d}/s")


def test_bundle_and_settings(spark, demo_scores):
    d = tempfile.mkdtemp(prefix="setsift-io-")
    settings = io.settings_table(spark, {k: v for k, v in RunSettings().__dict__.items() if k != "extra"})
    written = io.write_bundle({"scores": demo_scores, "analysis_settings": settings, "absent": None}, d, "csv")
    assert set(written) == {"scores", "analysis_settings"}
    back = io.read_table(spark, written["analysis_settings"], "csv")
    assert float(back.first()["crisp_threshold"]) == 0.3
    assert os.path.isdir(f"{d}/scores")
