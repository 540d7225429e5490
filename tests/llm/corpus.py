"""A small random corpus with copies, near copies, shared passages and odd rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, line int"
PARTS = ("th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve").split()


def words(rng, n):
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def text(rng, n):
    out = []
    while n > 0:
        k = min(n, rng.randint(5, 25))
        out.append(" ".join(words(rng, k)).capitalize() + ".")
        n -= k
    return "\n".join(out)


def edited(rng, original, n):
    w = original.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = words(rng, 1)[0]
    return " ".join(w)


def corpus(seed=3, n=120):
    """Rows of SCHEMA: plain texts, exact and near copies, a passage in many texts, very short
    and very long texts, nulls in any column, repeated rows, columns with clashing names."""
    rng = random.Random(seed)
    texts = [text(rng, rng.choice([3, 12, 40, 120, 300])) for _ in range(n)]
    base = text(rng, 130)
    passage = text(rng, 60)
    texts += [base] * 6 + [edited(rng, base, k % 7) for k in range(40)]
    texts += [text(rng, 60) + "\n" + passage + "\n" + text(rng, 30) for _ in range(12)]
    texts += [None, "", " \n\t ", "one", "one", "two words", "two words", "Été naïve 😀 漢字 " * 30, text(rng, 4000),
              "a " * 300, "x" * 500, "x" * 260, passage, passage.upper()]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", None]),
             None if t is None else len(t), 7, "clash", None) for i, t in enumerate(texts)]
    rows.append((None, texts[0], None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None))
    rows += [rows[1], rows[n + 2]]
    rng.shuffle(rows)
    return rows
