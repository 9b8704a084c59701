import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata"


def words(text):
    """Words as the shingles take them: runs of ASCII letters, digits and other characters, small."""
    fold = lambda c: c.lower() if c < "\x80" or ("À" <= c <= "Þ" and c != "×") else c
    return ["".join(map(fold, w)) for w in WORD.findall(text or "")]


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def docs(spark, rows):
    """A documents table of (doc_id, text), or of whole rows."""
    whole = [r if len(r) == 5 else (*r, "en", "src", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(whole, SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "a text without an id, of more than five words"), (4, "x" * 300_000), (5, "é ñ 日本語 ß"), (6, "same row of words here twice over"), (6, "same row of words here twice over"), (7, "word " * 60_000)]
CLASH = ("row", "words", "h", "c", "n", "sig", "node", "key", "rep", "score", "_gone", "_metadata", "part", "k", "tokens", "kept", "ids")


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
