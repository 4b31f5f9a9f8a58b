"""Tables for the operator tests."""

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
#: Columns that operators use or make themselves, as an input might have them too.
CLASHES = ["id", "t", "fp", "h", "norm", "score", "predicted", "_row", "n_lines", "copies", "rate", "p", "ids", "line", "first", "text_hash", "draw"]
DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in CLASHES]
)
LABELS = "doc_id long, quality int, toxic int"
WORDS = "the quick brown fox jumps over a lazy dog while seven small birds watch from an old stone wall near the river bank today"


def docs(spark, rows):
    """(doc_id, text) rows with a source and clashing columns."""
    return spark.createDataFrame([(i, t, "s", *["x"] * len(CLASHES)) for i, t in rows], DOCS)


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, WORDS), (4, WORDS), (5, WORDS), (6, "word " * 40_000), (None, WORDS + " null id"),
    (7, "Größe 中文 \U0001f600 é \x00 \x1c\x85\xa0 ▁ end"), (8, "|%&$ ??? !!!"), (9, "x" * 200_000),
]


def good_and_bad(n=60):
    """Plain prose labelled 1 and symbol junk labelled 0, with some toxic rows."""
    rows, labels = [], []
    words = WORDS.split()
    for i in range(n):
        w = [words[(i * 7 + k * k) % len(words)] for k in range(30 + i % 9)]
        bad, toxic = i % 3 == 0, i % 5 == 1
        text = " | ".join(x + "%%" for x in w) if bad else " ".join(w) + "."
        rows.append((100 + i, text + (" vile slur" if toxic else "")))
        labels.append((100 + i, int(not bad), int(toxic)))
    return rows, labels
