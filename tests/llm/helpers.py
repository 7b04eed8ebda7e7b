"""Frames that every operator is tried on: documents of plain rows and of awkward ones."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
LONG = " ".join(f"word{i % 500}" for i in range(20_000)) + "\n" + "x" * 50_000


def doc_frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def edge_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    text = "The same line here, again and again.\nAnother line of this document, number 5."
    rows = [(1, text, "en", "src1", 5), (1, text, "en", "src1", 5), (2, text, None, None, None), (None, text, "en", "src1", 5),
            (None, None, None, None, None), (3, "", "en", "src2", 0), (4, None, "de", "src2", 0), (5, " \n\t ", "de", "src2", 0),
            (6, LONG, "fr", "src3", 0), (7, "é ñ ß İ ſ \U0001f600 MIT-License mit license", "fr", "src0", 3),
            (-8, "one", "es", "src0", 3), (2**62, "<|endoftext|> 's it's", "es", "x", 3)]
    frame = doc_frame(spark, rows)
    clashing = ["id", "fp", "h", "key", "sim", "place", "root", "node", "row", "shard", "host", "words", "score", "label", "n",
                "tokens", "lines", "rank", "kept", "ids", "u", "v", "a", "b", "t", "last", "prior", "rest", "epochs", "out"]
    return frame.selectExpr("*", *[f"'x' as `{c}`" for c in clashing])
