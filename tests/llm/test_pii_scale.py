"""Personal data in very long texts with very many spans, and context on both sides of a span."""

import time

from pyspark.sql import functions as F

from fernglas.llm.pii import FOLD, PIECE, as_text, find_pii, redact


def _run(spark, texts):
    out = find_pii(spark.createDataFrame(list(enumerate(texts)), "n int, text string"))
    return out.select("n", as_text(F.col("pii")).alias("spans"), redact(F.col("text"), F.col("pii")).alias("clean")).orderBy("n").collect()


def test_context_before_and_after(spark):
    rows = _run(spark, ["call 555-123-4567", "555-123-4567 is my phone", "555-123-4567 is a part", "078-05-1120 (SSN)", "x" * 50 + " 078-05-1120 " + "y" * 50 + " ssn", "ssn " + "z" * 60 + " 078-05-1120"])
    assert [r["spans"] for r in rows] == ["local_phone:5:17", "local_phone:0:12", "", "ssn:0:11", "", ""]


def test_spans_over_blocks_and_pieces(spark):
    """Positions and redaction where matches and gaps lie across the borders of blocks and pieces."""
    texts = []
    for gap in (1, 7, PIECE - 9, PIECE, 2 * PIECE + 5):
        texts.append(("é" * gap).join(f" u{k}@b.co " for k in range(3 * FOLD if gap < 10 else 7)))
    for text, r in zip(texts, _run(spark, texts)):
        want, at, clean = [], 0, text
        while (k := text.find("@", at)) >= 0:
            start, stop = text.rfind(" ", 0, k) + 1, text.find(" ", k)
            want.append(f"email:{start}:{stop}")
            clean = clean.replace(text[start:stop], "<EMAIL>", 1)
            at = stop
        assert r["spans"] == ",".join(want) and r["clean"] == clean


def test_cost_grows_with_length(spark):
    """1 MB of spans takes at most about twice the time of 0.5 MB."""
    one = " ".join(f"u{k}@b.co ssn 078-05-1120, {k}" for k in range(15_000))
    _run(spark, [one[:1000]])
    took = []
    for text in (one, one + " " + one):
        began = time.perf_counter()
        assert _run(spark, [text])[0]["spans"].count(",") > 29_000 * len(text) // (len(one) + 1) - 2
        took.append(time.perf_counter() - began)
    assert took[1] < 2.5 * took[0] + 1
    for run in ("1 " * 200_000, "7" * 400_000, "1." * 200_000, "a@b" + ".c" * 200_000, "+1(" * 100_000, "a.b@" * 100_000, "DE12" * 100_000):
        _run(spark, [run])
