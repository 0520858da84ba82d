"""Plain Python versions of the corpus operators."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mix_targets(sizes, share=1.5, weights=(3, 1, 2), most=2):
    """sizes: source -> size. Targets by sharing anew what is above a cap, until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return target


def top_k(vectors, queries, k=5):
    """vectors: list of (id, components) with floor() taken; queries: ids."""
    out = []
    for q, a in sorted(dict(queries).items()):
        scored = sorted((-sum(int(x) * int(y) for x, y in zip(a, b)), i) for i, b in vectors if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return out


def judge(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(k), k, a) for a, k in rules if (host == k.partition("/")[0] or host.endswith("." + k.partition("/")[0])) and path.startswith("/" + k.partition("/")[2])]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    spans = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    spans += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    spans += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return spans


def digest(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def shingle_set(text, n=5):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard_components(docs, percent=75, n=5):
    """docs: (doc_id, text). All pairs that share a shingle."""
    sets = [(d, shingle_set(t, n)) for d, t in docs]
    index = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            index[x].append(i)
    root = {d: d for d, _ in docs if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    common = Counter((a, b) for own in index.values() for k, a in enumerate(own) for b in own[k + 1 :])
    for (a, b), both in common.items():
        (da, sa), (db, sb) = sets[a], sets[b]
        if da is not None and db is not None and 100 * both >= percent * (len(sa) + len(sb) - both):
            x, y = find(da), find(db)
            root[max(x, y)] = min(x, y)
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def repeated_lines(docs, min_words=50):
    """docs: (doc_id, text), ids unique -> {doc_id: sorted line numbers}. A run of lines of any length from min_words on goes if it equals an
    earlier one that it doesn't overlap. Blank lines don't break it, and go where the lines around them both go."""
    first, gone = {}, defaultdict(set)
    for d, t in sorted(docs):
        lines = [(i, s, len(WORD.findall(s))) for i, s in enumerate((t or "").split("\n")) if WORD.search(s)]
        for k in range(len(lines)):
            words, run = 0, hashlib.sha256()
            for i, s, n in lines[k:]:
                words += n
                run.update(f"{len(s)}:{s}".encode())
                if words >= min_words:
                    at, last = first.setdefault(run.digest(), (d, i))
                    if at == d and lines[k][0] <= last:  # longer ones overlap too, or are the first of their kind
                        continue
                    gone[d].update(x for x, _, _ in lines if lines[k][0] <= x <= i)
        for (a, _, _), (b, _, _) in zip(lines, lines[1:]):
            if a in gone[d] and b in gone[d]:
                gone[d].update(range(a, b))
    gone = {d: x for d, x in gone.items() if x}
    return {d: sorted(x) for d, x in gone.items()}


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def lower_bound(lengths, room=4096):
    return math.ceil(sum(lengths) / room)
