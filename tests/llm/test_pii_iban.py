"""IBANs before words that are capitals or digits themselves."""

from pyspark.sql import functions as F

from fernglas.llm.pii import as_text, find_pii, redact

DE, NO, MT = "DE89370400440532013000", "NO9386011117947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"
#: A country that is not in the registry, with right check digits; its end is told by these alone.
ZZ = "ZZ{:02d}ABCD12345678901".format(98 - int("".join(str(int(c, 36)) for c in "ABCD12345678901ZZ00")) % 97)
AFTER = ["", " Bank", " USD", " AND", " 2024", " 20 EUR", " A", ", B", " lower", " " + "X" * 40]


def _found(spark, texts):
    rows = find_pii(spark.createDataFrame(list(enumerate(texts)), "n int, text string")).select("n", as_text(F.col("pii")).alias("spans"), redact(F.col("text"), F.col("pii")).alias("clean")).collect()
    return {r["n"]: ([s for s in r["spans"].split(",") if s.startswith("iban")], r["clean"]) for r in rows}


def test_iban_before_words(spark):
    cases = [(i, a) for i in (DE, "DE89 3704 0044 0532 0130 00", NO, MT) for a in AFTER] + [(ZZ, a) for a in ("", " Bank", " USD", ", B")]
    found = _found(spark, [f"to {iban}{after}" for iban, after in cases])
    for n, (iban, after) in enumerate(cases):
        assert found[n] == ([f"iban:3:{3 + len(iban)}"], f"to <IBAN>{after}"), (iban, after)


def test_ibans_in_a_row(spark):
    found = {n: x[0] for n, x in _found(spark, [f"{DE} {NO} {MT} {DE}", f"{DE}\n{DE}", f"x{DE} {DE}X", f"{DE[:-1]}1 USD", None]).items()}
    a, b = len(DE) + 1, len(DE) + len(NO) + 2
    c = b + len(MT) + 1
    assert found[0] == [f"iban:0:{a - 1}", f"iban:{a}:{b - 1}", f"iban:{b}:{c - 1}", f"iban:{c}:{c + len(DE)}"]
    assert found[1] == [f"iban:0:{len(DE)}", f"iban:{a}:{a + len(DE)}"]
    assert found[2] == found[3] == found[4] == []
