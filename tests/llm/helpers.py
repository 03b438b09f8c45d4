"""Documents with all the odd cases, and plain versions of the operators' rules."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, part int, size long, n long, score double, copies int, mark long"


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows(seed=0, n=60):
    """Nulls, empty and blank texts, a long one, exact and near copies, repeated rows, shared lines and passages."""
    rng = random.Random(seed)
    passage = prose(rng, 45, 10_000)
    line = "Licensed under the usual terms since 2001."
    texts = [None, "", "   \n\t ", "one", "two words", "a b c d", "Ünïcode ñandú 語 😀 text", "x" * 3000, " ".join(["again"] * 60), prose(rng, 5000)]
    for k in range(n):
        body = prose(rng, rng.randrange(20, 160), 5000)
        if k % 4 == 0:
            body += "\n" + passage
        if k % 3 == 0:
            body += "\n" + re.sub("2001", str(2000 + k), line)
        texts.append(body)
        if k % 5 == 0:
            texts.append(body)
            changed = body.split(" ")
            changed[len(changed) // 2] = "changed"
            texts.append(" ".join(changed))
    rows = [(k, t, ("aa", "bb", None)[k % 3], (None, "s0", "s0", "s0", "s1", "")[k % 6], None, 1, 1, 1, 1, 1.0, 1, 1) for k, t in enumerate(texts)]
    return [*rows, rows[12], (None, "a text without an id", None, None, None, 1, 1, 1, 1, 1.0, 1, 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
