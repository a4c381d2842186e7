"""Plain single-process versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LEAST = -(1 << 63)


def low(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def spaced(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(rows, window=20):
    """rows: (doc_id, text). (doc_id, n_words, n_removed, kept_sha256) per row, in order of rows."""
    firsts, words = {}, [spaced(t) for _, t in rows]
    key = [LEAST if d is None else d for d, _ in rows]
    for i, w in enumerate(words):
        for k in range(len(w) - window + 1):
            gram = tuple(w[k : k + window])
            firsts[gram] = min(firsts.get(gram, key[i]), key[i])
    out = []
    for i, w in enumerate(words):
        gone, seen = [False] * len(w), set()
        for k in range(len(w) - window + 1):
            gram = tuple(w[k : k + window])
            if gram in seen or firsts[gram] < key[i]:
                gone[k : k + window] = [True] * window
            seen.add(gram)
        out.append((rows[i][0], len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def decontamination(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = plain(text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(item)
    out = []
    for doc, text in docs:
        w, found = plain(text), set()
        hit = [False] * len(w)
        for n in {len(g) for g in windows}:
            for k in range(len(w) - n + 1):
                if (gram := tuple(w[k : k + n])) in windows:
                    found |= windows[gram]
                    hit[k : k + n] = [True] * n
        found.discard(None)
        out.append((doc, len(w), sum(hit), len(found), sha(",".join(sorted(map(str, found)))), any(hit)))
    return out


def base_spans(text):
    """kind:start:end of the base spans, joined."""
    either = lambda word: "".join(f"[{c.lower()}{c.upper()}]" for c in word)
    names = "|".join([either("password"), either("passwd"), either("secret"), either("token"), either("api") + "_?" + either("key")])
    kinds = [
        ("assign", f"({names})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ]
    found = [(m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m)]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def shingles(text, size=4):
    w = spaced(low(text))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def jaccard_components(rows, size=4, percent=85):
    """(doc_id, n_shingles, component_id) per row."""
    key = [LEAST if d is None else d for d, _ in rows]
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), key[i]), key[i])
    return [(rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))]


def bm25(rows, is_query, k, n_terms, order):
    """{doc_id of a query: [(doc_id, score)]}; order: sort key of a term among equal weights. Distinct ids."""
    counts = {d: Counter(re.findall(r"[0-9a-z\x80-\U0010ffff]+", low(t))) for d, t in rows}
    lengths = {d: sum(c.values()) for d, c in counts.items()}
    mean = max(1, sum(lengths.values())) / max(1, len(rows))
    df = Counter(x for c in counts.values() for x in c)
    idf = {x: math.log(1 + (len(rows) - n + 0.5) / (n + 0.5)) for x, n in df.items()}
    out = {}
    for q in filter(is_query, counts):
        own = lambda x: round(idf[x] * counts[q][x] * 2.2 / (counts[q][x] + 1.2 * (0.25 + 0.75 * lengths[q] / mean)), 9)  # noqa: B023, E731
        terms = sorted(counts[q], key=lambda x: (-own(x), order(x)))[:n_terms]
        scores = defaultdict(list)
        for d, c in counts.items():
            for x in terms:
                if c[x]:
                    scores[d].append(idf[x] * c[x] * 2.2 / (c[x] + 1.2 * (0.25 + 0.75 * lengths[d] / mean)))
        out[q] = sorted(((d, math.fsum(s)) for d, s in scores.items()), key=lambda x: (-x[1], x[0]))[:k]
    return out


def repetition(text, sizes=(5, 6, 7, 8, 9, 10), base=8):
    """Counts of one text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars and characters by n-gram length."""
    text = text or ""
    w = spaced(text)

    def marked(size):
        places = defaultdict(list)
        for i in range(len(w) - size + 1):
            places[tuple(w[i : i + size])].append(i)
        return {p for at in places.values() if len(at) > 1 for i in at for p in range(i, i + size)}

    again, seen = [], set()
    for line in text.split("\n"):
        if spaced(line):
            if line in seen:
                again.append(line)
            seen.add(line)
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(again), len(marked(base)),
        sum(len(x) for line in again for x in spaced(line)), *[sum(len(w[p]) for p in marked(s)) for s in sizes],
    )


def middle(doc_id, text, unit="chars", seed=1):
    """(doc_id, n, form, prefix_chars, middle_chars, output) of one text."""
    text = text or ""
    starts = {
        "chars": lambda: [*range(len(text))],
        "words": lambda: [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)],
        "lines": lambda: [0] * bool(text) + [m.end() for m in re.finditer("\n", text) if m.end() < len(text)],
    }[unit]()
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(starts)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = (0 if k == 0 else ([*starts, len(text)])[k] for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def damaged(rows):
    """rows: (conv_id, turn, role, text)."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired text) of one conversation: (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1][:64], r[2][:64], r[1], r[2]))
    fault, seen = [], set()
    for _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        fault.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    # plain dynamic programming from the end: states are the role before ("" at the beginning) and insertions in a row
    following = {"": "su", "s": "u", "u": "a", "a": "u"}
    table = {}
    for i in range(len(rows), -1, -1):
        for inserted in range(3, -1, -1):
            for state in following:
                ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
                if inserted < 3:
                    for x in following[state].replace("s", ""):
                        cost, audit, made = table[i, inserted + 1, x]
                        ways.append((cost + 3, "I" + audit, (({"u": "user", "a": "assistant"}[x], ""), *made)))
                if i < len(rows):
                    _, role, text = rows[i]
                    cost, audit, made = table[i + 1, 0, state]
                    ways.append((cost + 4, "D" + audit, made))
                    if fault[i] not in ("blank", "duplicate"):
                        more = 3 * (fault[i] == "truncated")
                        for x in following[state]:
                            cost, audit, made = table[i + 1, 0, x]
                            if role[:1] == x:
                                ways.append((cost + more, "K" + audit, ((role, text), *made)))
                            if x != "s":
                                ways.append((cost + 3 + more, "R" + audit, (({"u": "user", "a": "assistant"}[x], text), *made)))
                table[i, inserted, state] = min(ways, default=(math.inf, "", ()))
    cost, audit, made = table[0, 0, ""]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *(fault.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(f"{r}:{t}" for r, t in made)
