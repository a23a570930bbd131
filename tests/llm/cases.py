"""Awkward documents that every operator must take, with extra columns of clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, n long, h string"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(9000)) + "."
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from old oak trees near the quiet river bank at night " * 3


def rows():
    texts = {
        0: None, 1: "", 2: " \n\t ", 3: "one", 4: "one two three four", 5: LONG, 6: BASE, 7: BASE, 8: BASE + "and then sleep", 9: "é" * 300, 10: "é" * 300,
        11: "naïve “quotes” — 漢字 😀 don't\n\n\n  tabs\there\r\n<|endoftext|> end", 12: BASE.upper(), 13: "a b c d e f g h\n" * 30, 14: "0 1 2 3 4 5 6", 15: "\0nul\x1cfs .\x1c x",
    }
    out = [(k, t, "en" if k % 2 else None, "s", None if t is None else len(t), 0.5, k, 1, "h") for k, t in texts.items()]
    return [*out, out[6], out[3], (None, BASE, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
