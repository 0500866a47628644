"""Plain loops that state what the corpus operators return."""

import collections
import hashlib
import math
import re
import zlib

import xxhash

GAP = re.compile(r"[^\x20\x09-\x0d]+")
ALNUM = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


def words(text):
    return GAP.findall(text or "")


def order(docs):
    """Rows by doc_id (null first) and text."""
    return sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or ""))


def substrings(docs, k=20):
    seen, out = set(), []
    for i, text in order(docs):
        w = words(text)
        gone = [False] * len(w)
        for at in range(len(w) - k + 1):
            window = tuple(w[at : at + k])
            if window in seen:
                gone[at : at + k] = [True] * k
            seen.add(window)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def scores(docs, level, kappa, folds=7, held_out=2):
    count, state = collections.Counter(), collections.Counter()
    texts = []
    for i, text in docs:
        held = zlib.crc32(("" if i is None else str(i)).encode()) % folds == held_out
        w = [" b"] * (level - 1) + words(low(text)) + [" e"]
        texts.append((i, held, w))
        if not held:
            for at in range(level - 1, len(w)):
                for n in range(level):
                    count[tuple(w[at - n : at + 1])] += 1
                    state[n, tuple(w[at - n : at])] += 1
    total = sum(c for g, c in count.items() if len(g) == 1)
    types = sum(len(g) == 1 for g in count)
    out = []
    for i, held, w in texts:
        base = score = known = 0
        for at in range(level - 1, len(w)):
            c = count[(w[at],)]
            p = (c + 1) / (total + types + 1)
            base, known = base + math.log10(p), known + (c > 0)
            for n in range(1, level):
                p = (count[tuple(w[at - n : at + 1])] + kappa * p) / (state[n, tuple(w[at - n : at])] + kappa)
            score += math.log10(p)
        out.append((i, held, len(w) - level + 1, known, total, base, score))
    return out


def quality(docs):
    out = []
    for i, text in docs:
        w, text = words(text), text or ""
        grams = collections.Counter(tuple(w[a : a + 8]) for a in range(len(w) - 7))
        inside = {a + b for a in range(len(w) - 7) if grams[tuple(w[a : a + 8])] > 1 for b in range(8)}
        lines = [x for x in text.split("\n") if GAP.search(x)]
        out.append(
            (
                i,
                len(w),
                sum(map(len, w)),
                len(re.findall(r"[#*$%&|<>]", text)),
                len(lines) - len(set(lines)),
                len(inside),
                len(w) < 20 or 100 * len(inside) > 30 * len(w),
            )
        )
    return out


def contamination(docs, items, n=13):
    grams = collections.defaultdict(set)
    for i, text in items:
        w = ALNUM.findall(low(text))
        size = min(n, len(w))
        for at in range(len(w) - size + 1 if w else 0):
            grams[tuple(w[at : at + size])].add("" if i is None else str(i))
    out = []
    for i, text in docs:
        w = ALNUM.findall(low(text))
        hit, found = set(), set()
        for size in {len(g) for g in grams}:
            for at in range(len(w) - size + 1):
                if tuple(w[at : at + size]) in grams:
                    hit |= set(range(at, at + size))
                    found |= grams[tuple(w[at : at + size])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def fingerprint(text):
    w = words(low(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[a : a + 4]), 42) for a in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(docs, threshold=4):
    """Fingerprints, and the root of each document's component."""
    prints = [fingerprint(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= threshold:
                parent[find(a)] = find(b)
    return prints, [find(a) for a in range(len(docs))]


def smallest(docs, roots):
    """By root: the smallest doc_id, null first."""
    groups = collections.defaultdict(list)
    for (i, _), root in zip(docs, roots, strict=True):
        groups[root].append(i)
    return {g: min(ids, key=lambda i: (i is not None, i or 0)) for g, ids in groups.items()}


def near(docs, threshold=4):
    prints, roots = components(docs, threshold)
    least = smallest(docs, roots)
    return [(i, f"{x:016x}", least[root]) for (i, _), x, root in zip(docs, prints, roots, strict=True)]


def heads(docs, threshold=4):
    """One document of each component: of its smallest doc_id, the first given."""
    _, roots = components(docs, threshold)
    least, out = smallest(docs, roots), {}
    for doc, root in zip(docs, roots, strict=True):
        if doc[0] == least[root]:
            out.setdefault(root, doc)
    return [doc for doc in docs if any(doc is x for x in out.values())]


UNIT = re.compile(r"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def infill(docs, rate=50):
    out = []
    for i, text in docs:
        text = text or ""
        units = UNIT.findall(text)
        digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted(x % (len(units) + 1) for x in h[:2])
        p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
            out.append((i, len(units), "plain", text, None, None))
        elif h[3] % 100 < 80:
            out.append((i, len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)))
        else:
            out.append((i, len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)))
    return out


def trie(rows, heads=9, group=5):
    """Rows of (conv_id, turn, role, text) to the nodes of their prefix trie, by path."""
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: tuple(x[2] for x in sorted(v)) for c, v in convs.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - int(math.fmod(c, group))
        paths[c] = own.get(base, ())[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    saved, leaves = collections.Counter(), collections.Counter()
    for p, m in members.items():
        size = len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * size
            leaves[p[:d]] += not kids[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), up, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def statistics(text, stops):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if GAP.search(x)]
    ratio = lambda a, b: a / max(b, 1)
    count = lambda chars: sum(c in chars for c in text)
    return {
        "n_words": len(w),
        "mean_word_chars": ratio(sum(map(len, w)), len(w)),
        "symbols_per_word": ratio(count("#*$%&<>"), len(w)),
        "calls_per_word": ratio(count("!"), len(w)),
        "bars_per_word": ratio(count("|"), len(w)),
        "capital_share": ratio(sum("A" <= c <= "Z" for c in text), len(text)),
        "digit_share": ratio(sum("0" <= c <= "9" for c in text), len(text)),
        "mark_share": ratio(count(".,;:?"), len(text)),
        "repeated_neighbour_share": ratio(sum(a == b for a, b in zip(w, w[1:], strict=False)), len(w)),
        "distinct_word_share": ratio(len(set(w)), len(w)),
        "stop_word_share": ratio(len({x.lower() for x in w} & stops), len(set(w))),
        "words_per_line": ratio(len(w), len(lines)),
        "repeated_line_share": ratio(len(lines) - len(set(lines)), len(lines)),
    }


def auc(pairs):
    """Share of (good, bad) pairs in the right order, of (score, label); ties count half."""
    ranked = sorted(pairs)
    at, good, wins = 0, sum(y for _, y in ranked), 0.0
    bad_before = 0
    while at < len(ranked):
        same = [y for s, y in ranked[at:] if s == ranked[at][0]] if at + 1 < len(ranked) and ranked[at + 1][0] == ranked[at][0] else [ranked[at][1]]
        bad = len(same) - sum(same)
        wins += sum(same) * (bad_before + bad / 2)
        bad_before += bad
        at += len(same)
    return wins / (good * (len(ranked) - good))
