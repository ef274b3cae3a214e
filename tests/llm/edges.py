"""Documents with every odd case, and small brute-force versions of the contracts."""

import re

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, "one two three four", "en", "a", 18), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n ", "xx", "b", 4),
    (5, "one two three four", "en", "a", 18), (5, "one two three four", "en", "a", 18), (None, "no id at all here", "en", "b", 17),
    (6, "x " * 30000, "en", "a", 60000), (7, "a b \U0001F600 c\x0bd\x0ce\rf\n", "en", None, 14),
    (8, "\n".join(["same line here again"] * 12 + ["other"]), "de", "c", 0), (9, "w%d " * 3 + " ".join(f"w{i}" for i in range(40)), "en", "", 1),
    (10, " ".join(f"k{i % 13}" for i in range(90)), "fr", "b", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark, extra=False):
    df = spark.createDataFrame(ODD, SCHEMA)
    if extra:
        for name in ("score", "kept", "size", "digest", "component_id", "copies"):
            df = df.selectExpr("*", f"'x' as {name}")
    return df


def words(text):
    return WORD.findall(text or "")


def repeat_words(w):
    seen, hit = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                hit.update(range(i, i + 8))
    return len(hit)
