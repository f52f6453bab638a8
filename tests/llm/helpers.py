"""Small inputs with the awkward cases, and brute-force versions of the operators."""

import hashlib
import re

CLASHING = ["node", "n", "component_id", "_key", "_doc", "_text_key", "_marks", "label", "toxic", "shard", "base", "severity", "sequence_id"]


def documents(spark, rows):
    """Documents with a source, a language, a size and columns whose names clash."""
    full = [(i, t, "en", "src0", len(t or ""), *["x"] * len(CLASHING)) for i, t in rows]
    kinds = ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(full, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {kinds}")


def prose(seed, words):
    """Words from a fixed rule: no two seeds share five in a row."""
    return " ".join(hashlib.md5(f"{seed}-{k}".encode()).hexdigest()[:5].translate(str.maketrans("0123456789", "ghijklmnop")) for k in range(words))


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, "one two three"), (6, prose(6, 30_000)), (7, "word"), (7, "word"), (None, "word"), (None, None), (8, "\U0001F600 é \x00 end")]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if len(words) >= 5:
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)]) if words else frozenset()


def components(keys, linked):
    """Smallest key of each component, by a pairwise test."""
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(keys)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def jaccard_linked(a, b):
    both = len(a & b)
    return bool(a and b) and 100 * both >= 75 * (len(a) + len(b) - both)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c)
    return total % 10 == 0


def base_spans(text):
    digits = lambda v: re.sub("[^0-9]", "", v)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
    }
    return [f"{kind}:{m.start()}:{m.end()}" for kind, (pattern, valid) in rules.items() for m in re.finditer(pattern, text or "") if valid(m[0])]
