"""Periodic runs, URL rules with aliases and the prefix trie against brute
force, on tables and on rows with nulls, long texts, ties, repeats, clashing
columns and nothing at all."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from velostat.llm import components, periodic_runs, prefix_trie, url_aliases
from velostat.llm.queries import QUERIES, url_rules
from velostat.llm.url_aliases import Rule

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NONE = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- runs
def brute_runs(words, least=12):
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                best.setdefault((start, i + q - start), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    for least in (12, 2, 5):
        texts = []
        for _ in range(40):
            n, kinds = rng.choice([0, 1, 11, 12, 40, 150]), rng.choice([1, 2, 3, 40])
            words = [rng.randrange(kinds) for _ in range(n)]
            at, q = rng.randrange(n + 1), rng.randrange(1, 20)
            texts.append(words[:at] + [words[at + (i - at) % q] if at + (i - at) % q < n else 0 for i in range(at, n)])
        got = periodic_runs.runs_of([np.array(t, np.int64) for t in texts], least)
        assert [list(map(tuple, g.tolist())) for g in got] == [brute_runs(t, least) for t in texts]


def test_runs_do_not_depend_on_chunks(monkeypatch):
    text = np.array(([1, 2, 3, 1, 2, 4] * 30 + [7] * 50 + list(range(9)) * 9), np.int64)
    want = [list(map(tuple, g.tolist())) for g in periodic_runs.runs_of([text, text[:100]])]
    monkeypatch.setattr(periodic_runs, "CHUNK", 7)
    assert [list(map(tuple, g.tolist())) for g in periodic_runs.runs_of([text, text[:100]])] == want
    assert want[0] == brute_runs(text.tolist())


def test_grammar_agreement_is_the_longest_common_extension():
    rng = np.random.default_rng(3)
    text = np.concatenate(([0], rng.integers(2, 4, 300), rng.integers(2, 4, 40).repeat(9), [1]))
    levels = periodic_runs.grammar(text, 2)
    assert len(levels[-1].symbols) <= 5 and len(levels) < 60
    x = rng.integers(1, len(text) - 2, 500)
    y = np.minimum(x + rng.integers(1, 200, 500), len(text) - 2)
    x, y = x[x < y], y[x < y]
    right, left = (periodic_runs.agreement(levels, x, y, way).tolist() for way in (1, -1))
    for a, b, r, l in zip(x.tolist(), y.tolist(), right, left, strict=True):
        n = next(k for k in range(len(text)) if text[a + k] != text[b + k])
        m = next(k for k in range(len(text)) if text[a - k] != text[b - k])
        assert (n, m) == (r, l)


EDGE_TEXTS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a " * 12), (5, "a " * 11), (5, "a " * 12), (None, "a b " * 8), (None, None),
    (6, "x\x0by\x0cz\r\n" * 4), (7, "é ü " * 5000 + "end"), (8, "a\xa0b a b " * 6), (9, " ".join(map(str, range(40)))),
]


@pytest.mark.parametrize("rows", [EDGE_TEXTS, []])
def test_runs_of_edge_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS runs", "'x' AS collapsed", "2 AS `n.words`")
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.find_runs(docs).collect()]
    want = []
    for doc, text in rows:
        words = WORD.findall(text or "")
        runs = brute_runs(words) if len(words) < 2000 else [(0, 10000, 2)]
        want.append((doc, len(words), runs, collapsed(words, runs)))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_op11_on_the_table(spark):
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted = 0
    for doc, text in docs:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc).encode())
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
            planted += 1
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        row = got[doc]
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        assert row.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert planted > 5 and any(r.n_runs for r in got.values())


# ---------------------------------------------------------------- urls
PAGES = [
    (1, "http://a.example.com/one#top", "<link rel='canonical' href='/two'>"),
    (2, "http://A.example.com/two", None),
    (3, "http://b.example.net/x", "<META content=\"0; URL='http://spam.example.net/de/1'\" http-equiv=Refresh>"),
    (4, "http://c.example.org/keep", "<link href=http://a.example.com/one rel=\"nofollow canonical\">"),
    (5, "http://c.example.com/de/1", "<link rel=canonical href='http://a.example.com/two#x'>"),
    (6, "http://d.example.net/", "<!-- <link rel=canonical href='http://c.example.com/de/1'> --><script>'<link rel=canonical href=/de/>'</script>"),
    (7, None, "<link rel=canonical href='http://c.example.com/de/1'>"), (8, "", ""), (9, "no address", None),
    (10, "http://e.example.net/q?to=http://x.com/de/1", "<link rel=canonical href='javascript:go()'><link rel=canonical href='http://[bad'>"),
    (11, "HTTPS://E.Example.COM/de/\n1", ""), (11, "http://notexample.org", ""), (None, "http://com/fr/", ""),
    (12, "http://f.example.net/p", "<base href='http://c.example.com/de/'><link rel=canonical href='z&amp;y'>"),
    (13, "http://f.example.net/" + "long/" * 20000, "<p>" * 50000 + "<link rel=canonical href='http://f.example.net/p'>"),
]
RULES = [Rule("allow", "example.org", "/"), Rule("block", "com", "/de/"), Rule("allow", "com", "/fr/")]


def verdict_rows(df):
    return sorted(((r.page_id, r.rule, r.verdict) for r in df.collect()), key=repr)


def test_verdicts_follow_aliases(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS host", "'x' AS node", "2 AS `own.rule`")
    want = [
        (1, None, "block"), (2, None, "block"), (3, None, "allow"), (4, "example.org/", "allow"), (5, "com/de/", "block"),
        (6, None, "allow"), (7, None, "allow"), (8, None, "allow"), (9, None, "allow"), (10, None, "allow"), (11, "com/de/", "block"),
        (11, None, "allow"), (None, "com/fr/", "allow"), (12, None, "block"), (13, None, "block"),
    ]
    assert verdict_rows(url_aliases.verdicts(pages, RULES)) == sorted(want, key=repr)
    assert url_aliases.verdicts(pages.limit(0), RULES).collect() == []
    redirects = spark.createDataFrame([("http://b.example.net/x#1", "http://C.example.com/de/1"), (None, "http://x")], "a string, b string")
    got = verdict_rows(url_aliases.verdicts(pages, RULES, redirects))
    assert (3, None, "block") in got and (6, None, "allow") in got


def test_longest_rule_wins_then_allow(spark):
    rules = [Rule("block", "example.org", "/a"), Rule("allow", "org", "/a"), Rule("block", "org", "/b"), Rule("allow", "org", "/b")]
    urls = ["http://example.org/abc", "http://x.org/a", "http://x.org/b", "http://badexample.org/abc", "http://example.org", "ftp://EXAMPLE.ORG/a?b"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_aliases.verdicts(pages, rules).collect()}
    assert got[0] == ("example.org", "/abc", "example.org/a", "block")
    assert got[1] == ("x.org", "/a", "org/a", "allow") and got[2] == ("x.org", "/b", "org/b", "allow")
    assert got[3] == ("badexample.org", "/abc", "org/a", "allow") and got[4] == ("example.org", "", None, "allow")
    assert got[5] == ("example.org", "/a", "example.org/a", "block")


@pytest.mark.parametrize("share, few", [(1000, 50_000), (1000, 0), (3, 0), (3, 20)])
def test_components_of_paths_stars_and_cycles(spark, monkeypatch, share, few):
    monkeypatch.setattr(components, "HOT_SHARE", share)
    monkeypatch.setattr(components, "COLD", share)
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(5)
    edges = [(f"p{i}", f"p{i + 1}") for i in range(60)] + [("hub", f"s{i}") for i in range(80)] + [("c0", "c1"), ("c1", "c2"), ("c2", "c0"), ("me", "me")]
    edges += [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(40)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    groups = defaultdict(set)
    for r in components.connected(spark.createDataFrame(edges, "a string, b string")).collect():
        groups[r.root].add(r.node)
    want = defaultdict(set)
    for n in root:
        want[find(n)].add(n)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_op12_rules_on_the_table(spark):
    rules = url_rules()
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    got = {r.page_id: r for r in QUERIES["op12_url_aliases"](spark, SF).collect()}
    assert len(got) == len(pages)
    for page, url in pages:
        host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url).groups()
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text), default=None)
        assert (got[page].host, got[page].path, got[page].rule) == (host, path, rule and rule.text)
        assert got[page].verdict == (rule.action if rule else "allow")


# ---------------------------------------------------------------- trie
def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    key = lambda t: (t[0], t[1], hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest())
    own = {c: [t[1:] for t in sorted(turns, key=key)] for c, turns in own.items()}
    built, members, ends = {}, defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        ends[built[c]].append(c)
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return [
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(ends[k]))
        for k, m in members.items()
    ]


def trie_rows(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def grown(seed, n):
    """Conversations of few kinds of turns, many of them equal or nested."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), n):
        for t in range(rng.choice([0, 1, 2, 4, 7, 9])):
            rows.append((c, t, rng.choice(["user", "user", "assistant"]), rng.choice(["hi", "hi", "hi", "é\nü", ""])))
    return rows + [(500 + c, t, "user", "same " * (t % 2)) for c in range(n) for t in range(6)]


EDGE_TURNS = [
    (100, None, "user", "first"), (100, 0, None, "x"), (100, 1, "user", None), (101, 3, "b", "t"), (101, 3, "a", "u"), (101, 3, "a", "u"),
    (102, 0, "user", "only"), (None, 0, "user", "nobody"), (None, None, None, None), (207, 5, "user", "no head"), (208, -1, "user", "no head"),
    (300, 1, "user", "y" * 100000), (301, 1, "user", "y" * 100000),
] + [(400, t, "user", str(t % 3)) for t in range(700)] + [(401, t, "user", str(t % 3)) for t in range(600)]


@pytest.mark.parametrize("batch", [10000, 4, 1])
@pytest.mark.parametrize("case", ["edge", "grown", "same", "empty"])
def test_trie(spark, case, batch):
    rows = {"edge": EDGE_TURNS, "grown": grown(batch, 60), "same": [(c, 0, "user", "hi") for c in range(40)], "empty": []}[case]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS turns", "2 AS `a.b`")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = trie_rows(prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.turn_rows(table))))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted(brute_trie(rows), key=repr)


def test_extents_are_binary_searched_both_ways():
    rng = random.Random(2)
    for n in (1, 2, 3, 17, 64):
        seqs = sorted("".join(rng.choice("ab") for _ in range(rng.randrange(6))) for _ in range(n))
        blobs = [b"".join(c.encode() * 16 for c in s) for s in seqs]
        lcp = prefix_trie.lcps(blobs, np.array([len(s) for s in seqs]))
        table = prefix_trie.sparse_table(lcp)
        for i, d in itertools.chain.from_iterable(((i, d) for d in range(1, len(s) + 1)) for i, s in enumerate(seqs)):
            left, right = prefix_trie.extents(table, np.array([i]), np.array([d]))
            own = [j for j, s in enumerate(seqs) if s[:d] == seqs[i][:d]]
            assert (left[0], right[0]) == (own[0], own[-1])


def test_op13_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(QUERIES["op13_prefix_trie"](spark, SF)) == sorted(brute_trie(rows), key=repr)
