"""Plain Python versions of the corpus operators, for small tables."""

import collections
import hashlib
import re

LOWER = str.maketrans({c: chr(ord(c) + 32) for c in map(chr, range(65, 91))})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACES = " \t\n\x0b\f\r"


def shingles(text):
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(texts):
    """{key: (n_shingles, smallest reachable key)} of {key: text}."""
    sets = {d: shingles(t) for d, t in texts.items()}
    above = {d: d for d in sets}

    def find(x):
        while above[x] != x:
            x = above[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                above[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def hits(text, items):
    """(words, hit words, item ids) of one text; items: (id, text) pairs."""
    w = LETTERED.findall((text or "").translate(LOWER))
    hit, found = [False] * len(w), set()
    for name, given in items:
        v = LETTERED.findall((given or "").translate(LOWER))
        n = min(13, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p:p + n] == v[k:k + n]:
                    found.add(str(name))
                    hit[p:p + n] = [True] * n
    return len(w), sum(hit), sorted(found)


def line_dedup(docs, window=3):
    """[(text, lines, removed)] of [(doc_id, text)] with distinct ids."""
    lines, seen = [], {}
    for _, text in docs:
        every = (text or "").split("\n")
        lines.append([(i, x.strip(SPACES)) for i, x in enumerate(every) if x.strip(SPACES)])
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0))
    gone = [set() for _ in docs]
    for i in order:
        own = lines[i]
        for k in range(len(own) - window + 1):
            key = tuple(x for _, x in own[k:k + window])
            if key in seen:
                gone[i].update(range(k, k + window))
            else:
                seen[key] = (i, k)
    out = []
    for i, (_, text) in enumerate(docs):
        drop = {lines[i][k][0] for k in gone[i]}
        kept = text if text is None or not drop else "\n".join(x for j, x in enumerate(text.split("\n")) if j not in drop)
        out.append((kept, len(lines[i]), len(drop)))
    return out


def quality(docs, min_docs):
    """{row number: counts} of [(host, text)]."""
    def normal(x):
        return re.sub(r"[\x20\x09-\x0D]+", " ", x.strip(SPACES)).lower()

    of_line = collections.Counter()
    for host, text in docs:
        for x in {normal(x) for x in (text or "").split("\n") if x.strip(SPACES)}:
            of_line[host, x] += 1
    out = {}
    for i, (host, text) in enumerate(docs):
        text = text or ""
        words = SPACED.findall(text)
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        windows = collections.Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
        repeated = {p + j for p in range(len(words) - 2) if windows[tuple(words[p:p + 3])] > 1 for j in range(3)}
        removed = sum(len(SPACED.findall(x)) for x in lines
                      if of_line[host, normal(x)] >= min_docs)
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        out[i] = {
            "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated), "n_removed_words": removed,
            "base_failed": failed, "kept": not failed and 2 * removed <= len(words)}
    return out


def sha256(data):
    return hashlib.sha256(data).hexdigest()
