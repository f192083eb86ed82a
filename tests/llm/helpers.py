"""Small tables with the odd cases every operator must take, and plain versions of what operators compute."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def odd_documents(seed=1):
    """(doc_id, text) rows: nulls, empty and blank texts, one long text, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(seed)
    vocab = ["wort", "été", "The", "of", "naïve", "x", "再见", "end.", "it's", "b-c", "100", "Ωmega"] + ["".join(rng.choices("abcdefghilmnorstu", k=rng.randint(2, 9))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base, long = make(70), make(120), make(6000)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "a b c"), (7, "A B c"), (8, base), (9, base), (10, " ".join(near)), (11, base.upper()),
        (12, make(30) + "\n" + passage + "\n" + make(20)), (13, passage), (14, make(5) + "  " + passage + "\r\n" + make(3)), (15, long), (16, long + " tail"),
        (17, "ha " * 200), (18, "ha " * 90), (19, "same line here\nsame line here\n  SAME line here \nother\n\nshort\n"), (20, "Same Line Here\nshort\nnew one of its own"),
        (20, "Same Line Here\nshort\nnew one of its own"), (21, "same line here"), (None, passage + " more"), (None, "same line here\nkept"), (22, make(80)), (-3, base + " " + make(2)),
    ]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], SCHEMA)


def clashing(df):
    """The same rows with columns named like what operators use and return."""
    from pyspark.sql import functions as F

    names = ["doc", "version", "id", "key", "row", "lines", "drops", "n_words", "kept", "n", "label", "node", "owner", "component", "terms", "a", "b", "_t", "_d", "_h", "_p", "language", "ids", "n_tokens", "n_lines"]
    return df.withColumns({c: F.lit(f"own {c}") for c in names})
