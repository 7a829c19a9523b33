"""Plain versions of the training-data operators, for small inputs."""

import itertools
import re
from collections import Counter

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def shingles(text, width=5):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def components(docs, percent=75):
    """{doc_id: smallest reachable id} for {doc_id: text}."""
    sets = {d: shingles(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(docs), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in docs}


def rule_counts(text):
    t, w = text or "", words(text)
    triples = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen = Counter(triples)
    inside = {j for i, x in enumerate(triples) if seen[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if words(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(t.count(c) for c in "#*$%&|<>"),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside)}


def holds_whole(text, item):
    """The item's words, one after another, anywhere in the text."""
    a, b = re.findall(r"\w+", (text or "").lower()), re.findall(r"\w+", (item or "").lower())
    return bool(b) and any(a[i:i + len(b)] == b for i in range(len(a) - len(b) + 1))
