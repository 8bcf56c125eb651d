"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def shingles(text, k):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def jaccard(rows, k, percent):
    """{doc_id: (size, component)}; rows are (doc_id, text) with distinct ids."""
    sets = {i: shingles(t, k) for i, t in rows}
    groups = Groups()
    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                groups.join(i, j)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


def repeats(rows, length):
    """{doc_id: (words, removed, digest)} of the substring dedup."""
    texts = {i: words(t) for i, t in rows}
    first = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - length + 1):
            first.setdefault(tuple(texts[i][k:k + length]), i)
    out = {}
    for i, w in texts.items():
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k:k + length])] < i:
                gone[k:k + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def boilerplate(rows, ratio, least):
    """{doc_id: text} after line dedup; rows are (doc_id, host, text)."""
    pages, seen = defaultdict(int), defaultdict(set)
    for n, (_, host, text) in enumerate(rows):
        pages[host] += 1
        for line in (text or "").split("\n"):
            if line.strip(" "):
                seen[host, line.strip(" ")].add(n)
    bad = {k for k, v in seen.items() if len(v) >= least and len(v) / pages[k[0]] > ratio}
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" ")) not in bad) for i, h, t in rows}


def mix_targets(sizes, share=1.5, most=2, weights=(5, 2, 1)):
    """{source: target} by refilling until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        left = budget - sum(most * sizes[s] for s in full)
        open_ = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / open_ for s in order}
        over = {s for s in order if s not in full and target[s] >= most * sizes[s]}
        if not over or len(over) + len(full) == len(order):
            return {s: min(t, most * sizes[s]) for s, t in target.items()}
        full |= over


def damage(rows):
    """Spoilt rows, in their order; rows are (conv_id, turn, role, text)."""
    import zlib

    show = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        role, text = show(role), show(text)
        rule = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if rule == 0:
            continue
        text = "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text
        role = "user" if rule == 4 else role
        for _ in range(1 + (rule == 3)):
            yield conv, turn, role, text


def repair(rows):
    """{conv_id: report} of conversation repair: every cheapest audit is compared as a string."""
    groups = {conv: [] for conv, *_ in rows}
    for conv, *row in damage(rows):
        groups[conv].append(tuple(row))
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        turns = [t for t, _, _ in own if t is not None]
        faults, seen = [], set()
        for _, role, text in own:
            body = WORD.findall(text)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1][-1] not in ".!?" else "")
            seen.add((role, text))
        # best (cost, audit, messages) by role initials so far: "", s, u, a
        def closed(best):
            for _ in range(3):
                for last, (c, audit, said) in list(best.items()):
                    to, role = ("a", "assistant") if last == "u" else ("u", "user")
                    put(best, to, c + 2, audit + "I", [*said, role + ":"])
            return best

        def put(best, state, cost, audit, said):
            if state not in best or (cost, audit) < best[state][:2]:
                best[state] = (cost, audit, said)

        best = closed({"": (0, "", [])})
        for (_, role, text), fault in zip(own, faults):
            new = {}
            for last, (c, audit, said) in best.items():
                put(new, last, c + 3, audit + "D", said)
                if fault in ("blank", "duplicate"):
                    continue
                c += fault == "truncated"
                to, given = ("a", "assistant") if last == "u" else ("u", "user")
                put(new, to, c + 2, audit + "R", [*said, f"{given}:{text}"])
                if role[:1] == to or (role[:1] == "s" and last == ""):
                    put(new, role[:1], c, audit + "K", [*said, f"{role}:{text}"])
            best = closed(new)
        cost, audit, said = min(best[s] for s in ("", "a") if s in best)
        pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], pairs, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out
