"""Plain-Python versions of the corpus operators, and small documents with awkward rows."""
from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, label int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def similar(a, b, num, den):
    i = len(a & b)
    return bool(a) and bool(b) and den * i >= num * (len(a) + len(b) - i)


def crc(value, n):
    return zlib.crc32(("" if value is None else str(value)).encode()) % n


def documents(n=60, seed=1):
    """Rows (doc_id, text): random texts, exact and near copies, a hot family, and awkward texts."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 5))) for _ in range(300)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 120))) for _ in range(n)]
    for t in texts[:20]:
        texts.append(t.upper())
        w = t.split(" ")
        w[rnd.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    base = [rnd.choice(vocab) for _ in range(150)]
    for _ in range(40):  # a family of near copies
        w = list(base)
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        texts.append(" ".join(w[:75]) + "\n" + " ".join(w[75:]))
    texts += [None, "", "   \n\t ", "one", "one two", "One TWO", "é É ß", " ".join(rnd.choice(vocab) for _ in range(30_000)),
              "x" * 50_000, "a\nb\na\n\nb", "\x1c\x85\u00a0 z"]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, "null id"), (None, texts[0])]


def frame(spark, rows):
    """Documents with further columns, some named as the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "k", 1) for i, t in rows], SCHEMA)


def components(rows, k, num, den):
    """Smallest doc_id reachable by links, by row."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j], num, den):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [least.get(top(i)) if sets[i] else rows[i][0] for i in range(len(rows))], [len(s) for s in sets]


def removed_lines(rows, num=80, den=100):
    """Removed line numbers of each (doc_id, text); rows in order of doc_id."""
    seen, out = [], {}
    for doc_id, text in rows:
        if (doc_id, text) in out:
            continue
        gone = []
        for no, line in enumerate((text or "").split("\n")):
            s = shingles(line, 5)
            if s and any(similar(s, x, num, den) for x in seen):
                gone.append(no)
            if s:
                seen.append(s)
        out[doc_id, text] = gone
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def base_scores(rows, folds=5, held=1):
    """(held_out, n_tokens, n_known, train_tokens, base_score) by row."""
    tokens = [[*words(t), None] for _, t in rows]
    c = Counter()
    for (d, _), t in zip(rows, tokens):
        if crc(d, folds) != held:
            c.update(t)
    total, v = sum(c.values()), len(c)
    return [(crc(d, folds) == held, len(t), sum(c[w] > 0 for w in t), total,
             sum(math.log10((c[w] + 0.5) / (total + 0.5 * (v + 1))) for w in t)) for (d, _), t in zip(rows, tokens)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
