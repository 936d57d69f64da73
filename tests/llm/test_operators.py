"""The ten operators against brute force, on the small tables and on rows with
nulls, empty and very long texts, ties, repeats and clashing columns."""

import hashlib
import os
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from velostat.llm import (  # noqa: E402
    chat_parts,
    common,
    decontaminate,
    html_blocks,
    jaccard_join,
    line_runs,
    packing,
    rule_ledger,
    suffix_dedup,
    token_count,
    toxicity,
)
from velostat.llm.queries import QUERIES, piece_vocabulary, word_tokenizer  # noqa: E402

SF = "/root/testdata/sf0.001"
BASE = " ".join(f"word{i}" for i in range(40))
PASSAGE, OTHER = "A passage of some words that is long enough to repeat. " * 2, "Nothing of this is found in any earlier document at all. " * 5
DOCS = [
    (1, BASE), (2, BASE), (3, BASE.replace("word20", "other")), (4, BASE + " tail"), (5, None), (6, ""), (7, "a b"),
    (8, "A b"), (9, "x " * 9000), (9, "x " * 9000), (10, "line one is long\nshort\nLINE one is long \n\nline one is long"),
    (11, "zz\nline one is long\né line of its own"), (None, BASE), (None, None), (12, BASE.upper()), (13, "a b c d e f"),
    (14, "a b c d e f g"), (15, "q" * 120), (16, "é" * 200 + BASE), (17, "é" * 200),
]
ITEMS = [(1, BASE[:120]), (2, "a b"), (3, None), (4, ""), (5, "a b"), (None, "zz line")]


def frame(spark, rows, clash="n_words long, kept string, row long, copy int, digest string, length int"):
    names = [c.split()[0] for c in clash.split(", ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.selectExpr("*", *(f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in clash.split(", "))) if names else docs


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def held(want, have):
    assert have == sorted(map(tuple, want), key=repr)


@pytest.fixture(scope="module")
def table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(params=["table", "edge", "empty"])
def case(request, spark, table):
    if request.param == "table":
        return table
    rows = DOCS if request.param == "edge" else []
    return frame(spark, rows), rows


def test_rules(case):
    docs, rows = case
    got = rule_ledger.apply_policy(rule_ledger.ledger(docs))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    held([(i, *brute.quality(t)) for i, t in rows], rows_of(got, *columns))
    assert got.where("kept AND base_failed").isEmpty()
    assert rule_ledger.keep_good(docs).columns == docs.columns


def test_rule_ablation(table):
    rows = rule_ledger.ledger(table[0])
    bits = [r.fail_bits & rule_ledger.POLICIES[2] for r in rows.collect()]
    for r in rule_ledger.ablation(rows, 2).collect():
        assert r.n_failed == sum(bool(b & r.bit) for b in bits)
        assert r.n_only == sum(b == r.bit for b in bits)


@pytest.mark.parametrize("batches", [1, 6])
def test_lines(case, batches):
    docs, rows = case
    got = line_runs.dedup_lines(docs, batches=batches, fanout=2)
    held(brute.line_dedup(rows), rows_of(got, "row.doc_id", "n_lines", "n_dropped", "kept_sha256"))


@pytest.mark.parametrize("block", [(64, 1024), (2, 3)])
def test_jaccard(case, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "LONG", block[0])
    monkeypatch.setattr(jaccard_join, "BLOCK", block[1])
    docs, rows = case
    held(brute.jaccard(rows), rows_of(jaccard_join.similar_components(docs), "doc_id", "n_shingles", "component_id"))


@pytest.mark.parametrize("few", [["x " * 50, "x " * 60], ["a b c d e " * 20, "a b c d e " * 30, "x y"]])
def test_jaccard_of_long_texts_with_few_shingles(spark, few):
    rows = list(enumerate(few))
    want = brute.jaccard(rows)
    assert [c for _, _, c in want[:2]] == [0, 0]
    held(want, rows_of(jaccard_join.similar_components(frame(spark, rows)), "doc_id", "n_shingles", "component_id"))


LINKED = [
    [(1, BASE), (1, OTHER), (2, OTHER + " tail"), (3, BASE + " tail"), (3, "alone"), (3, "alone"), (None, BASE)],
    [(5, BASE), (5, BASE + " tail"), (2**62, OTHER), (-(2**63), OTHER + " end"), (2**63 - 1, "alone"), (5, BASE.upper())],
    [(2, BASE), (1, OTHER), (2, OTHER), (1, BASE)],
]


@pytest.mark.parametrize("rows", LINKED)
def test_jaccard_of_texts_that_share_an_id(spark, rows):
    docs = frame(spark, rows)
    held(brute.jaccard(rows), rows_of(jaccard_join.similar_components(docs), "doc_id", "n_shingles", "component_id"))
    docs = docs.selectExpr("*", "doc_id AS `a.b`", "text AS digest2")
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    # the smallest document of each component, once, and the rows without an id
    assert sorted(got, key=repr) == sorted(_components(rows) + [doc for doc, _ in rows if doc is None], key=repr)


def _components(rows):
    """The smallest id of each component, found by growing groups of texts."""
    ids = {}
    for doc, text in rows:
        if doc is not None:
            words = " ".join(brute.WORD.findall((text or "").translate(brute.LOWER)))
            ids.setdefault(words, []).append(doc)
    left, out = set(ids), []
    while left:
        new, least = [left.pop()], []
        while new:
            words = new.pop()
            least.append(min(ids[words]))
            near = [w for w in left if _alike(words, w)]
            left.difference_update(near)
            new += near
        out.append(min(least))
    return out


def _alike(a, b):
    x, y = brute.shingles(a), brute.shingles(b)
    return bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)


@pytest.mark.parametrize("in_half", [16, 19, 22])
def test_jaccard_of_a_lower_percent(spark, in_half):
    names = [f"w{i}" for i in range(400)]
    low = [bool(jaccard_join.shingles([w.encode()], 1)[0] < jaccard_join._HALF) for w in names]
    inside, outside = ([w for w, x in zip(names, low, strict=True) if x is side] for side in (True, False))
    one = inside[:in_half] + outside[: 40 - in_half]
    rows = [(1, one), (2, one + inside[50:90]), (3, one[:24] + outside[60:64]), (4, inside[90:100] + outside[90:120])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_components(docs, 1, 50).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
    assert jaccard_join.half_mark(80) == 45


@pytest.mark.parametrize("block_words", [10**6, 20])
def test_decontamination(spark, case, block_words):
    docs, rows = case
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.verdicts(decontaminate.scan(docs, items, block_words=block_words))
    want = brute.decontaminate(rows, [x for x in ITEMS if x[0] is not None])
    held(want, rows_of(got, "row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))


def test_decontamination_cuts_spans(spark):
    docs = spark.createDataFrame([(1, f"Before, {BASE}! After.")], "doc_id long, text string")
    items = spark.createDataFrame([(1, BASE)], "item_id long, text string")
    (row,) = decontaminate.remove_spans(decontaminate.scan(docs, items)).collect()
    assert row.cleaned == "Before, ! After."


@pytest.mark.parametrize("hot", [10_000, 2])
def test_suffixes(case, hot):
    docs, rows = case
    got = suffix_dedup.remove_repeats(docs, hot=hot)
    held(brute.suffix(rows), rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))


SAME_IDS = [
    [(1, PASSAGE), (2, PASSAGE + " " + OTHER), (2, "unrelated " + "".join(map(str, range(400))))],
    [(3, PASSAGE), (3, PASSAGE + "x"), (2, "y" + PASSAGE), (2, "y" + PASSAGE), (1, OTHER), (3, "z" + OTHER), (2, OTHER + OTHER)],
]


@pytest.mark.parametrize("hot", [10_000, 1])
@pytest.mark.parametrize("rows", SAME_IDS)
def test_suffixes_of_texts_that_share_an_id(spark, rows, hot):
    got = suffix_dedup.remove_repeats(frame(spark, rows), hot=hot)
    held(brute.suffix(rows), rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))


def test_suffixes_need_one_python_worker_for_each_task(spark):
    """A second Python step in a task is a second worker, which the executor keeps beside the first."""
    docs = frame(spark, [(1, "x" * 60), (2, "y" + "x" * 60), (None, "x" * 60), (None, None)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = suffix_dedup.remove_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = []  # (depth, whether a Python step) of the exchanges and Python steps above a line
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [x for x in above if x[0] < depth]
        node = line.lstrip(" :+-").split("(")[0].split(" ")[0]
        if "Exchange" in node:
            above.append((depth, False))
        elif "Pandas" in node or "Python" in node:
            assert not above or not above[-1][1], plan
            above.append((depth, True))


def test_suffixes_move_the_texts_once(spark, table):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for key in keys:
        spark.conf.set(key, "-1")
    try:
        got = suffix_dedup.remove_repeats(table[0], hot=20)
        got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        for key in keys:
            spark.conf.unset(key)
    assert plan.count("pack(text") == 2  # the texts with an id, and those without
    assert sum("ReusedExchange" in ln and "packed" in ln for ln in plan.splitlines()) >= 2


def test_packing(case):
    from tokenizers import Tokenizer

    docs, rows = case
    tokenizer, want, total = Tokenizer.from_file(word_tokenizer()), [], 0
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        for at in range(0, len(ids), 4096):
            part = ids[at : at + 4096]
            want.append((doc, at // 4096, at, len(part), zlib.crc32(part.tobytes())))
    got = packing.pack(docs, word_tokenizer)
    held(want, rows_of(got, "doc_id", "piece", "start", "length", "ids_crc32"))
    ends = {}
    for r in got.orderBy("sequence_id", "offset").collect():
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values(), default=0) <= 4096
    assert len(ends) <= -(-total // 4096) * 1.02 + 1


def test_word_ids_encode_plain_words_by_the_model_alone(monkeypatch):
    """Stretches of ASCII letters go to the tokenizer's model, the others
    through all its steps; ids are those of the whole text."""
    from tokenizers import Tokenizer

    texts = [
        "Plain words AND more plain Words", "it's 3's x'll ''s a.'s", "3.5 a..b !!c _d_e f_g", "é. É.! naïve—. ﬁne e\u0301a",
        "a\x01.b \x1c.c \x7f!d a\x1cb \x85e\u00a0f", "[x] {y} `z` ~w @v a@b.c", "İstanbul K ſ ß", "日本。a 한글.b", "<|endoftext|> plain <| x", "", " \t\n\v\f\r ",
    ]
    texts += [" ".join(a + b for a in texts) for b in (".", "e", "7", "'")]
    whole = Tokenizer.from_file(word_tokenizer())
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for remembered in (3, packing.REMEMBERED):
        monkeypatch.setattr(packing, "REMEMBERED", remembered)
        assert [np.frombuffer(x, "<u4").tolist() for x in packing.WordIds(word_tokenizer())(texts)] == want

    class Counted:
        n = 0

        def encode(self, text, **options):
            Counted.n += len(text.split())
            return whole.encode(text, **options)

    ids = packing.WordIds(word_tokenizer())
    ids.tokenizer = Counted()
    ids([" ".join(f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx") + " 7 é."])
    assert Counted.n == 2


def test_packing_plan_covers_each_length_once():
    lengths, counts = [7, 40, 41, 60, 100], [9, 5, 1, 13, 2]
    made = dict.fromkeys(lengths, 0)
    for config, times in packing.plan(lengths, counts, 100)[0]:
        assert sum(a * b for a, b in config.items()) <= 100
        for length, n in config.items():
            made[length] += n * times
    assert made == dict(zip(lengths, counts, strict=True))


def covered(lengths, plan, capacity):
    made = dict.fromkeys(lengths, 0)
    for config, times in plan:
        assert times > 0 and sum(a * b for a, b in config.items()) <= capacity
        for length, n in config.items():
            made[length] += n * times
    return list(made.values())


@pytest.mark.parametrize("seed", range(40))
def test_packing_program_is_near_its_bound(seed):
    """Few lengths, high counts: a program solved to a small tolerance and
    rounded is off by that and about one sequence for each length."""
    rng = np.random.default_rng(seed)
    m = int(rng.integers(3, 14))
    lengths = np.sort(rng.choice(np.arange(20, 1000), m, replace=False)).tolist()
    counts = rng.integers(200, 20_001, m).tolist()
    got, bound = packing.plan(lengths, counts, 1000)
    assert covered(lengths, got, 1000) == counts
    assert sum(a * b for a, b in zip(lengths, counts, strict=True)) <= 1000 * bound * 1.000001
    assert bound <= sum(n for _, n in got) <= 1.005 * bound + m


def test_packing_bound_is_below_the_best_plan():
    """Against all plans of a small histogram."""
    from functools import lru_cache

    lengths, counts = [26, 30, 45, 61], [3, 3, 4, 2]

    @lru_cache(None)
    def fewest(left):
        if not any(left):
            return 0
        first = max(i for i, n in enumerate(left) if n)  # the largest piece goes somewhere
        best = 99

        def fill(i, room, now):
            nonlocal best
            if i < 0:
                best = min(best, 1 + fewest(tuple(now)))
                return
            for n in range(min(now[i], room // lengths[i]) + 1):
                fill(i - 1, room - n * lengths[i], [*now[:i], now[i] - n, *now[i + 1 :]])

        now = list(left)
        now[first] -= 1
        fill(len(lengths) - 1, 100 - lengths[first], now)
        return best

    got, bound = packing.plan(lengths, counts, 100)
    assert bound - 1e-9 <= fewest(tuple(counts)) <= sum(n for _, n in got) <= fewest(tuple(counts)) + 1


@pytest.mark.parametrize("kind", ["documents", "halves", "one", "full"])
def test_packing_program_of_many_lengths(kind):
    rng = np.random.default_rng(8)
    lengths, counts = {
        "documents": (np.unique(np.concatenate([rng.integers(2, 400, 300), rng.integers(2, 1024, 120), [1024]])), None),
        "halves": (np.arange(480, 700), None),
        "one": (np.array([3]), [10**7]),
        "full": (np.array([1024]), [5]),
    }[kind]
    counts = rng.integers(1, 60, len(lengths)).tolist() if counts is None else counts
    got, bound = packing.plan(lengths.tolist(), counts, 1024)
    assert covered(lengths.tolist(), got, 1024) == counts
    assert bound <= sum(n for _, n in got) <= 1.01 * bound + 2
    assert packing.plan([], [], 1024) == ([], 0.0)


def test_token_counts_follow_the_tokenizer(case):
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers  # noqa: F401

    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = range(model.vocab_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    vocab = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)] + [(model.id_to_piece(i), model.get_score(i)) for i in plain]
    reference = Tokenizer(models.Unigram(vocab, 0, byte_fallback=True))
    docs, rows = case
    got = rows_of(token_count.token_counts(docs, piece_vocabulary), "doc_id", "n_chars", "n_tokens")
    tokens = lambda t: len(reference.encode("▁" + t.replace(" ", "▁")).ids) if t else 0
    held([(i, len(t or ""), tokens(t)) for i, t in rows], got)


def test_token_ties_go_to_the_longest_last_piece():
    words = token_count.Vocabulary([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", 0.0)])
    assert words.count("ab") == (2, 0, -2.0)  # ▁ and ab, not ▁, a, b


def test_toxicity_learns_and_tolerates_gaps(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeioustrn"), 6)) for _ in range(300)]
    text = lambda *extra: " ".join([*rng.choice(words, 30), *extra]) + "."
    rows = [(i, text("moron") if i % 4 == 0 else text(), int(i % 4 == 0)) for i in range(400)]
    extra = [(1000, text("mo-ron")), (1001, text("m o r o n")), (1002, text()), (1003, ""), (1004, None), (1002, text())]
    docs = spark.createDataFrame([r[:2] for r in rows] + extra, "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (1002, None)], "doc_id long, toxic int")
    got = [(r.doc_id, r.predicted, r.held_out) for r in toxicity.scores(docs, toxicity.fit(docs, labels)).collect()]
    assert len(got) == 406
    fresh = [(i, p) for i, p, h in got if h and i < 400]
    assert np.mean([p == (i % 4 == 0) for i, p in fresh]) > 0.95
    late = dict((i, p) for i, p, _ in got if i >= 1000)
    assert late == {1000: 1, 1001: 1, 1002: 0, 1003: 0, 1004: 0}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, h in got)
    none = toxicity.scores(docs, toxicity.fit(docs, labels.where("doc_id < 0")))
    assert none.where("score <> 0").isEmpty()


def plain_kernel(a, b, order=3, decay=0.6):
    """The subsequence kernel by its dynamic program: the weights of common
    subsequences of ``order`` characters, decay ** (span in a + span in b)."""

    def raw(s, t):
        k = np.ones((len(s) + 1, len(t) + 1))  # of subsequences that go on to the end
        for i in range(order):
            nxt = np.zeros_like(k)
            total = 0.0
            for x in range(1, len(s) + 1):
                for y in range(1, len(t) + 1):
                    if s[x - 1] == t[y - 1]:
                        total += decay**2 * k[x - 1, y - 1]
                    nxt[x, y] = decay * nxt[x - 1, y] + decay * nxt[x, y - 1] - decay**2 * nxt[x - 1, y - 1]
                    if s[x - 1] == t[y - 1]:
                        nxt[x, y] += decay**2 * k[x - 1, y - 1]
            k = nxt
        return total

    def whole(word):
        return [word[at : at + 16] for at in range(0, max(1, len(word) - 8), 8)]

    best = 0.0
    for p in whole(a):
        for q in whole(b):
            norm = raw(p, p) * raw(q, q)
            best = max(best, raw(p, q) / norm**0.5 if norm else 0.0)
    return best


def test_kernel_is_that_of_the_dynamic_program():
    landmarks = ["idiot", "stupid", "aaaa", "xyz", "worthless", "réeux"]
    words = ["idiot", "idxiot", "i.d.i.o.t", "stpd", "aaa", "ab", "", "réeuxment", "lessworthlessworth" * 3, "zyx", "toidi", "stupidity"]
    got = toxicity.Similarity(landmarks)(words)
    want = np.array([[plain_kernel(w, m) for m in landmarks] for w in words])
    assert np.allclose(got, want, atol=1e-5)


def test_kernel_looks_up_only_words_that_can_be_similar(monkeypatch):
    """Of words that no landmark resembles few are compared in full, and a
    word with other marks at its ends not again; the values stay the same."""
    rng = np.random.default_rng(5)
    scripts = ["".join(map(chr, range(at, at + 12))) for at in range(0x4E00, 0x4E00 + 12 * 8, 12)]  # more kinds than the bound knows
    landmarks = ["idiot", "stupid", "worthless", "réeux", "aaaa", *scripts]
    others = ["".join(rng.choice(list("bcfghjklmnpqvwyz"), rng.integers(3, 14))) for _ in range(2000)]
    similar = ["idxiot", "stupidity", "wrthless", "worthlesss" * 3, "réeuxx", "aaa", *(x[:3] + "a" + x[3:] for x in scripts)]
    words = others + similar
    got, full = toxicity.Similarity(landmarks)(words, 0.4), toxicity.Similarity(landmarks)(words)
    reach = full.max(axis=1) >= 0.4
    assert reach[-len(similar) :].all() and np.allclose(got[reach], full[reach], atol=1e-6)
    assert (got.max(axis=1) >= 0.4).tolist() == reach.tolist()
    compared, whole = [], toxicity._subsequences
    sentences = toxicity.Sentences(landmarks)
    monkeypatch.setattr(toxicity, "_subsequences", lambda codes, *rest: compared.append(len(codes)) or whole(codes, *rest))
    texts = [" ".join(w + mark for w in words) for mark in (".", ",", "!")]
    assert [len(x) for x in sentences(texts)] == [len(similar), 1, len(similar)]  # sentences of one word, and one of all
    assert sum(compared) < len(others) / 4


def test_toxicity_of_no_rows_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "good " * 200_000), (2, "bad words idiot " * 100_000), (3, None), (3, None)], "doc_id long, text string")
    docs = docs.selectExpr("*", "1 AS score", "2 AS held_out", "3 AS `a.b`")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    assert len(toxicity.scores(docs, toxicity.fit(docs, labels)).collect()) == 4
    none = toxicity.scores(docs.limit(0), toxicity.fit(docs.limit(0), labels.limit(0)))
    assert none.collect() == [] and none.columns == ["doc_id", "held_out", "score", "predicted"]


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_blocks.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = r.html.split("<article>", 1)[1].split("</article>")[0]
        assert r.n_chars == len(r.text) and "track(" not in r.text and "<" not in article.split("</h1>")[0][4:]
        assert r.text.split("\n\n")[0] == __import__("html").unescape(article.split("</h1>")[0][4:]).strip()


def test_page_cases(spark):
    body = "<p>One &amp; two.</p><p>Of.</p>"
    cases = [
        (None, ""), ("", ""), ("<p", ""),
        (f"<nav><a>menu</a></nav><article><h1>T</h1>{body}<div class='comments'>no</div></article><footer>f</footer>", "T\n\nOne & two.\n\nOf."),
        (f"<main>{body}<aside>s</aside><script>var a='</p>'</script></main>", "One & two.\n\nOf."),
        ("<div>nav</div>" + "<p></p>" * 4 + "<p>" + "text " * 40 + "</p>", ("text " * 40).strip()),
    ]
    pages = spark.createDataFrame([(i, None, h, 1) for i, (h, _) in enumerate(cases)], "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in html_blocks.extract(pages).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


LONG = "A sentence of the body text, long enough to count as such, and then some more of it."
MENU = "<ul>" + "".join(f"<li><a href='/{w}'>{w} page</a></li>" for w in ("home", "news", "sports", "about")) + "</ul>"
#: Pages and what their text is: a row each of the lines that are kept.
FOUND = [
    # names of attributes and of classes
    (f"<article><p title='a hidden gem'>{LONG}</p><p>Of.</p></article>", [LONG, "Of."]),
    (f"<article><p class='hidden-gems related-work'>{LONG}</p><p data-class='ad'>B.</p></article>", [LONG, "B."]),
    (f"<main id=main><p class='ad-slot'>no</p><p class='siteHeader'>no</p><div id=cookie_banner>no</div><p role=note>{LONG}</p></main>", [LONG]),
    (f"<article><p hidden>no</p><p style='color:red; Display : none'>no</p><p aria-hidden=true>no</p><p aria-hidden=false>{LONG}</p></article>", [LONG]),
    # marks inside what is left out do not count
    (f"<div><p>{LONG}</p></div><div class=comments><article><p>I say {LONG}</p></article></div>", [LONG]),
    (f"<article><h1>T</h1><p>{LONG}</p><article class='comment'>no</article></article>", ["T", LONG]),
    # marked pages lose nothing, however short or far apart
    ("<article><p>Is.</p></article>", ["Is."]),
    (f"<article><p>A.</p><p>B.</p><aside>no</aside><form>no</form><nav>no</nav><p></p><p></p><p></p><p>{LONG * 9}</p><hr><hr><hr><p>C.</p></article>",
     ["A.", "B.", LONG * 9, "C."]),
    (f"<main><article><p>{LONG}</p></article></main><p>{LONG} no</p><article><p>Of.</p></article>", [LONG, "Of."]),
    (f"<article><p><a href=x>only a link</a></p></article>", ["only a link"]),
    # pages without marks
    ("".join(f"<div><div><p>Sentence {i} of a page of short ones.</p></div></div>" for i in range(8)), [f"Sentence {i} of a page of short ones." for i in range(8)]),
    (f"<h1>Title</h1>{''.join(f'<div>{i}. {LONG}</div>' for i in range(3))}", ["Title", *(f"{i}. {LONG}" for i in range(3))]),
    (f"{MENU}<div><p>By John.</p><p>{LONG}</p><p>Of.</p></div>{MENU}", ["By John.", LONG, "Of."]),
    (f"<header>no</header>{MENU}<p>{LONG}</p><div class=ad>no</div><p>{LONG}</p><footer>no</footer>", [LONG, LONG]),
    (f"<p>{LONG}</p>{MENU}<p>Short.</p>{MENU}<p>{LONG} {LONG}</p>", [LONG, f"{LONG} {LONG}"]),
    (f"<body class='home'><table><tr><td>One</td><td>{LONG}</td></tr></table></body>", [f"One {LONG}"]),
    (f"<p>See <a href=x>this page</a> and {LONG}</p>{MENU}", [f"See this page and {LONG}"]),
    ("<p>tiny</p>", ["tiny"]),
    ("plain text &lt;b&gt;\n  two   words", ["plain text <b> two words"]),
    (f"{MENU}", []), ("<nav>no</nav><footer>no</footer>", []), ("<p> </p>\n<div></div>", []),
]


@pytest.mark.parametrize("i", range(len(FOUND)))
def test_text_of_page(i):
    page, want = FOUND[i]
    assert html_blocks.main_text(page) == "\n\n".join(want)


def test_pages_empty_long_and_repeated(spark):
    long = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    rows = [(1, "u", long), (2, None, f"<p>{LONG}</p>"), (2, None, f"<p>{LONG}</p>"), (None, "v", "<p>x</p>"), (3, "w", "<div>" * 30_000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS text", "1L AS n_chars", "2 AS `a.b`")
    got = sorted(((r.page_id, r.url, r.n_chars) for r in html_blocks.extract(pages).collect()), key=repr)
    n = 20_000 * len(LONG) + 2 * 19_999
    assert got == sorted([(1, "u", n), (2, None, len(LONG)), (2, None, len(LONG)), (None, "v", 1), (3, "w", 4)], key=repr)
    empty = html_blocks.extract(pages.limit(0))
    assert empty.collect() == [] and empty.columns == ["page_id", "url", "text", "n_chars"]


def test_chats(spark):
    got = {r.conv_id: r for r in QUERIES["op2_chat_formatting"](spark, SF).collect()}
    chats = {-7: [("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok")]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn", "role", "text").collect():
        chats.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    assert got.keys() == chats.keys()
    for conv, turns in chats.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        text = "".join(f"{role}\n{t}\n" for role, t in turns)
        want = (len(turns), brute.sha(text), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == want


def test_chat_parts(spark):
    part = "named_struct('type',{},'text',{},'ref',{},'width',{},'height',{},'seconds',{},'pages',{})"
    p = lambda *x: part.format(*x)
    parts = ",".join([
        p("'text'", "'a <b> &amp; é'", "NULL", "NULL", "NULL", "NULL", "NULL"), p("'image'", "NULL", "'i.png'", "56", "29", "NULL", "NULL"),
        p("'audio'", "NULL", "'s.wav'", "NULL", "NULL", "1.01D", "NULL"), p("'document'", "NULL", "'d.pdf'", "NULL", "NULL", "NULL", "2"),
    ])
    rows = spark.sql(f"SELECT 1L conv_id, 0L turn, 'assistant' role, array({parts}) parts UNION ALL SELECT 1L, 1L, NULL, NULL UNION ALL SELECT NULL, NULL, NULL, NULL")
    got = {r.conv_id: r for r in chat_parts.format_chats(rows).collect()}
    chat = got[1]
    content = "a &lt;b> &amp;amp; é<image/><audio/><document/>"
    assert chat.formatted == f"<turn>assistant\n{content}</turn><turn>\n</turn>"
    assert [chat.formatted[m.start : m.start + m.length] for m in chat.loss_mask] == [content]
    assert [(a.type, a.ref, a.tokens) for a in chat.attachments] == [("image", "i.png", 4), ("audio", "s.wav", 26), ("document", "d.pdf", 1200)]
    assert chat.attachment_tokens == 1230 and got[None].formatted == "<turn>\n</turn>"


WORDY = " ".join(f"token{i} of the text" for i in range(30))
STAGED = [
    (1, WORDY), (2, WORDY + " and a tail"), (3, "too short"), (4, None), (5, ""), (None, WORDY), (None, "no"),
    (6, "a line that many texts hold\n" + " ".join(f"six{i} words here" for i in range(20))),
    (7, "A LINE that many texts hold \n" + " ".join(f"seven{i} words here" for i in range(20))),
    (8, BASE + " " + " ".join(f"eight{i}" for i in range(30))), (9, " ".join(f"nine{i}" for i in range(9000))),
    (10, "# $ % " * 20 + " ".join(f"ten{i}" for i in range(30))), (11, WORDY.upper()), (12, "x y z " * 30),
    (13, " ".join(f"same{i} row twice" for i in range(12))), (13, " ".join(f"same{i} row twice" for i in range(12))),
]


@pytest.mark.parametrize("which", ["table", "edge", "empty"])
def test_pipeline(spark, tmp_path, which):
    """Every stage against brute force on what its predecessor kept."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    folder = SF
    if which != "table":
        folder = str(tmp_path)
        rows = STAGED if which == "edge" else []
        docs = frame(spark, rows, "lang string, source string, n_chars long, row string, kept int").selectExpr("*", "'d' AS `a.b`")
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, BASE), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    tokenizer = Tokenizer.from_file(word_tokenizer())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, [(r.doc_id, r.text) for r in docs.collect()]
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        want = {
            "quality_rules": lambda: [r for r in rows if brute.quality_keeps(r[1])],
            "line_dedup": lambda: brute.lines_kept(rows),
            "jaccard_join": lambda: brute.one_of_each(rows),
            "decontamination": lambda: [r for r, found in zip(rows, brute.decontaminate(rows, items), strict=True) if not found[5]],
            "packing": lambda: brute.pieces(rows, lambda t: tokenizer.encode(t, add_special_tokens=False).ids),
        }[name]()
        docs = common.saved(stage(spark, docs, folder), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns
            held(want, rows_of(docs, "doc_id", "text"))
            rows = want
        else:
            held(want, rows_of(docs, "doc_id", "piece", "start", "length", "ids_crc32"))
            ends = {}
            for r in docs.orderBy("sequence_id", "offset").collect():
                assert r.offset == ends.get(r.sequence_id, 0)
                ends[r.sequence_id] = r.offset + r.length
            assert max(ends.values(), default=0) <= 4096
        sizes.append(len(want))
    if which == "edge":
        assert len(STAGED) > sizes[0] > sizes[2] > sizes[3] > 3
    held([tuple(r) for r in docs.drop("sequence_id", "offset").collect()], rows_of(corpus_pipeline.run(spark, folder), "doc_id", "piece", "start", "length", "ids_crc32"))


def test_suffixes_with_edits_and_overlaps(spark):
    """Near copies and shifted passages: names with several surroundings."""
    import random

    rng = random.Random(5)
    base = ["".join(rng.choice("abé ") for _ in range(400)) for _ in range(4)]
    rows = []
    for doc in range(60):
        text = list(rng.choice(base)[rng.randrange(60) :] + rng.choice(base)[: rng.randrange(120)])
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = rng.choice("xyz")
        rows.append((doc, "".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held(brute.suffix(rows), rows_of(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
