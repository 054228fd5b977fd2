"""Queries that have to read whole tables and whole texts."""

import re

from loomlog.plans import library

SF = "/root/testdata/sf0.001"


def test_task_keys_anywhere_in_any_language(spark, tmp_path):
    texts = [
        ("en", "see OPS-7 and, far behind " + "x " * 50 + "OPS-0007, DB-12345."),
        ("de", "\u00c4rger mit WEB-31; \u00c9WEB-32 und WEB-33\u00e9 z\u00e4hlen nicht"),
        ("fr", "(API-4)API-5 _API-6 API-7_ API-8x"),
        ("zh", "\u4efb\u52a1 QA-9 \u5b8c\u6210, A-1 nor qa-2"),
        ("en", None),
        ("en", "none"),
    ]
    spark.createDataFrame([(i, lang, x) for i, (lang, x) in enumerate(texts)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r["keys"] for r in library.queries()["task_mentions_whole_text"](spark, str(tmp_path)).collect()}
    for i, (_, x) in enumerate(texts):
        found = re.findall(r"(?<!\w)([A-Z]{2,})-([0-9]+)(?!\w)", x or "")
        assert got[i] == (None if x is None else sorted({f"{p}-{int(n):04d}" for p, n in found}))
    assert got[0] == ["DB-12345", "OPS-0007"] and got[1] == ["WEB-0031"] and got[3] == ["QA-0009"]


def test_every_line_has_its_price_version(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    got = library.queries()["scd_price_lookup_all_lines"](spark, SF)
    assert got.count() == lines.count() == library.queries()["scd_price_lookup"](spark, SF).count()
