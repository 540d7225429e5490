"""Plain versions of the operators, for small tables of rows (id, text, ...)."""

import math
import re


class Forest:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def ngrams(t, n):
    w = re.findall(rb"[^\x20\x09-\x0D]+", lower(t or "").encode())
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def linked(sets, num, den=100):
    """Components of sets (by id) whose Jaccard similarity is num / den or more."""
    forest, ids = Forest(), sorted(sets)
    for i, a in enumerate(ids):
        forest.root(a)
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * den >= num * max(len(x), len(y)) and den * len(x & y) >= num * len(x | y):
                forest.link(a, b)
    return forest


def trimmed(line):
    return lower(line).strip(" \t\n\r\x0b\x0c")


def shingle_set(line, k=8):
    return {line[i:i + k] for i in range(len(line) - k + 1)} or {line}


def removed_lines(rows):
    """id -> numbers of the lines that go, for ids that lose any."""
    seen = {}
    for i, t, *_ in rows:
        if i is not None and t is not None:
            for n, line in enumerate(t.split("\n")):
                if trimmed(line):
                    seen.setdefault(trimmed(line), []).append((i, n))
    lines = sorted(seen)
    forest = linked({k: shingle_set(x) for k, x in enumerate(lines)}, 80)
    places, gone = {}, {}
    for k, x in enumerate(lines):
        places.setdefault(forest.root(k), set()).update(seen[x])
    for group in places.values():
        for i, n in group - {min(group)}:
            gone.setdefault(i, set()).add(n)
    return gone


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def item_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or ""))


def answer_words(t):
    """The last sentence if others stand before it, else the last third of the words."""
    w = item_words(t)
    for at in range(len(t) - 2, 0, -1):
        if t[at] in ".!?\n":
            last = item_words(t[at + 1:])
            if 2 <= len(last) < len(w):
                return last
    return w[-max(1, len(w) // 3):]


def leaks(rows, items, share=0.75, with_answer=0.55, min_words=8):
    """(id, item) of every window of 1.5 item lengths in every text that repeats the item."""
    found = set()
    for item, t in items:
        q = item_words(t)
        if item is None or not q:
            continue
        width, answer, vocabulary = math.ceil(1.5 * len(q)), answer_words(t), set(q)
        for i, text, *_ in rows:
            w = item_words(text)
            if i is None or not w:
                continue
            if len(q) < min_words:
                if any(w[a:a + len(q)] == q for a in range(len(w))):
                    found.add((i, item))
                continue
            hits = [x in vocabulary for x in w]
            for a in range(len(w)):
                if not hits[a] or sum(hits[a:a + width]) < with_answer * len(q):
                    continue
                part = lcs(q, w[a:a + width]) / len(q)
                if part >= share or part >= with_answer and lcs(answer, w[a:a + width]) >= 0.8 * len(answer):
                    found.add((i, item))
                    break
    return found
