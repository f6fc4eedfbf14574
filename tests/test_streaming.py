"""The streaming form gives what the batch form gives."""

import json

from quadrille.streaming import captures


def test_amounts_by_window(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    pages = [("a", "Fees", "Tuition fee: HK$120,000", "2025-01-01T00:10:00"), ("b", "Fees", "HKD 80,000 and HKD 90,000", "2025-01-01T00:50:00"), ("c", "x", "none", "2025-01-01T05:00:00")]
    (folder / "p.json").write_text("\n".join(json.dumps(dict(zip(("source_url", "page_title", "body_text", "captured_at"), p))) for p in pages))
    q = captures.stream_amounts(spark, str(folder)).writeStream.outputMode("complete").format("memory").queryName("amounts").start()
    q.processAllAvailable()
    q.stop()
    got = [(r["n_pages"], r["n_amounts"], r["max_amount"]) for r in spark.sql("select * from amounts order by window").collect()]
    assert got == [(2, 3, 120000), (1, 0, None)]
