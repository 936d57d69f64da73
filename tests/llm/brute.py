"""Plain Python versions of the contracts, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    base = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), base


def quality_keeps(text):
    """The policy in force, from the measurements."""
    n_words, word_chars, n_symbols, n_dup, _, base = quality(text)
    word_lines = sum(bool(WORD.search(line)) for line in (text or "").split("\n"))
    return not (base or 100 * n_symbols > 50 * n_words or 100 * n_dup > 50 * word_lines or word_chars < 2 * n_words or word_chars > 30 * n_words)


def lines_kept(rows):
    """The texts of line_dedup."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), doc), doc)
    return [
        (doc, "\n".join(x for x in (text or "").split("\n") if doc is None or len(key(x)) < 10 or first[key(x)] == doc))
        for doc, text in rows
    ]


def one_of_each(rows):
    """The rows of the smallest document of each component, each id once."""
    seen, out = set(), []
    for (doc, text), (_, _, component) in zip(rows, jaccard(rows), strict=True):
        if doc is None or doc == component and doc not in seen:
            seen.add(doc)
            out.append((doc, text))
    return out


def pieces(rows, encode, capacity=4096, end=1):
    import struct
    import zlib

    out = []
    for doc, text in rows:
        ids = [*encode(text or ""), end]
        for at in range(0, len(ids), capacity):
            part = ids[at : at + capacity]
            out.append((doc, at // capacity, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    return out


def line_dedup(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 10:
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(key(x)) < 10 or min(holders[key(x)]) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def jaccard(rows, percent=80):
    """Components of (doc_id, words); a component's id is the smallest doc_id."""
    words = lambda t: tuple(WORD.findall((t or "").translate(LOWER)))
    nodes = {(doc, words(text)): shingles(text) for doc, text in rows if doc is not None}
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(set)
    for n, s in nodes.items():
        for x in s:
            holders[x].add(n)
    shared = Counter()
    for own in holders.values():
        own = sorted(own)
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(nodes[a]) + len(nodes[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(doc, len(shingles(text)), None if doc is None else find((doc, words(text)))[0]) for doc, text in rows]


def decontaminate(rows, items):
    words_of = lambda t: BENCH_WORD.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        n = min(13, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i : i + n])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        words, hit, found = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                own = windows.get(tuple(words[i : i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        out.append((doc, len(words), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(words)))
    return out


def suffix(rows, n=50):
    first = {}
    for doc, text in rows:
        raw = (text or "").encode()
        if doc is not None:
            for i in range(len(raw) - n + 1):
                s = raw[i : i + n]
                if first.get(s, doc) >= doc:
                    first[s] = doc
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - n + 1):
            if doc is not None and first[raw[i : i + n]] < doc:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone) if not g))))
    return out
