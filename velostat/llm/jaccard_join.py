"""Similarity join of documents by the Jaccard index of their word shingles,
size-aware: small sets enumerate fixed-size subsets, large sets scan inverted
lists, and a cost model sets the boundary.

A document's set holds its distinct ``words``-word shingles (64-bit hashes of
lower-cased words); with fewer words, the whole sequence is one; without words
it is empty and links with nothing.  A and B link when
100 * |A and B| >= percent * |A or B|.  With t = percent / 100, a link needs an
overlap of at least t * max(|A|, |B|), hence at most slack = |A| - ceil(t |A|)
members of A are missing in B.

Equal texts are one class first.  Then classes meet in lists:

* Light: for each size b <= boundary with t * b <= |A| <= b, all subsets of A
  of size ceil(t * b).  A linked pair, the larger of size b, shares one.
* Heavy: inverted lists.  Members of df 1 are never shared; of the others, in
  order of (df, member), the first slack + 1 - (members of df 1) are posted.
  The rarest shared member of a linked pair is among those of both.  A class
  whose own members are more than its slack is out at once; that takes away
  documents that merely share a passage.  To halve the traffic, lists are made
  over the half of all hashes whose top bit is 0, where the same holds as long
  as that half has more than slack members.  Classes with at most
  (1 - t) / t + (1 - t) of their members there (45 % for t = 0.8) use the lists
  over all hashes as well: if one of a linked pair has too few members, both
  are below that mark.

A list of copies of one text could be as long as the table, so its pairs are
never all made.  First every class is checked against one pivot, the smallest
of the list it shares most often; the links found are contracted to components.
Then only members of different components in a list are compared, all of
them: lists of up to ``LONG`` as pairs, longer ones in blocks of ``BLOCK``
inside tasks (a product of 0/1 matrices for each two blocks), which put out a
forest of the links, never the pairs.  No link between components is lost, and
links inside one are not needed.

A null ``doc_id`` takes no part and gets a null component.  Rows that share a
``doc_id`` but not the words are documents of their own: they link only where
their words do, and a component's id is the smallest ``doc_id`` in it.
Repeated rows are all returned.  A null or empty text has an empty set.  An
empty table gives an empty one.  Other columns are ignored, whatever their
names; ``one_of_each`` keeps them.

A member is its 64-bit hash's low half within a bucket that the high half
chooses; the number of buckets follows the number of members, so the share of
members that collide by chance does not grow, and what a bucket's task holds
neither.  Collisions cost a check, never a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import deleted, is_null, join_hot, mixed, of_ids, packed, parts_for, rows_of, saved, unpacked, whole_row, window_hashes, word_hashes
from .components import connected

WORDS, PERCENT = 5, 80
#: Sets above this size are never enumerated; the boundary is at most this.
LIGHT_LIMIT = 16
#: Members of a list that are compared as pairs; beyond, in blocks of BLOCK.
LONG, BLOCK = 64, 1024
#: Shingles in one product of 0/1 matrices.
COLUMNS = 2048
_HALF = np.uint64(1 << 63)
#: Members of one bucket.
BUCKET_MEMBERS = 1 << 21
#: Ids beyond this get a node number of their own.
LARGEST = 1 << 60


def overlap_needed(size: int, percent: int) -> int:
    return -(-percent * size // 100)


def half_mark(percent: int) -> int:
    """Percent of its members in the half, up to which a class needs the lists
    over all hashes: the half of the other holds at most 1 - t of that one's
    members, itself at most 1 / t times as large, and 1 - t are missing there."""
    missing = 100 - percent
    return -(-missing * (100 + percent) // percent)


def words_of(text) -> list[bytes]:
    return [] if is_null(text) else text.encode().lower().split()


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct hashes of the document's shingles."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(width, len(words))))


def _digest(words: list[bytes]) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join(words))


def classes(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """Per row: doc_id, n_shingles, digest of the word sequence."""

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in rows_of(frames, "doc_id", "text"):
            out = []
            for doc, text in rows:
                words = words_of(text)
                out.append((doc, len(shingles(words, width)), _digest(words)))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "digest"]).astype({"doc_id": "Int64"})

    return docs.mapInPandas(describe, "doc_id long, n_shingles long, digest binary")


def subset_count(size: int, boundary: int, percent: int) -> int:
    """Subsets that a light set of this size enumerates."""
    return sum(comb(size, overlap_needed(b, percent)) for b in range(size, boundary + 1) if overlap_needed(b, percent) <= size)


def boundary_by_cost(sizes: dict[int, int], percent: int) -> int:
    """The boundary at which the rows to shuffle are fewest: a light set costs
    its subsets, and its members too if it can link with a heavy one; a heavy
    set its members and its posted prefix."""

    def cost(boundary: int) -> int:
        total = 0
        for size, n in sizes.items():
            heavy = size + size - overlap_needed(size, percent) + 1
            if size > boundary:
                total += n * heavy
            else:
                total += n * (subset_count(size, boundary, percent) + heavy * (size >= overlap_needed(boundary + 1, percent)))
        return total

    return min(range(LIGHT_LIMIT + 1), key=cost)


def _is_heavy(size: int, boundary: int, percent: int) -> bool:
    """Whether it can link with a set above the boundary."""
    return size >= overlap_needed(boundary + 1, percent)


def _members(docs: DataFrame, width: int, percent: int, boundary: int, buckets: int) -> DataFrame:
    """Members by bucket of their hash: for each batch of documents a list of
    the documents, and per member its low 32 bits and document's position.
    universe 0 is the half of all hashes, 1 is all of them."""
    columns = ["bucket", "docs", "slack", "total", "members", "owners"]
    mark = half_mark(percent)

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in rows_of(frames, "doc_id", "text"):
            for at in range(0, len(rows), 4096):
                docs, slack, total, hashes = [], [], [], []
                for doc, text in rows[at : at + 4096]:
                    own = shingles(words_of(text), width) if doc is not None and not is_null(doc) else ()
                    if not len(own) or not _is_heavy(len(own), boundary, percent):
                        continue
                    missing = len(own) - overlap_needed(len(own), percent)
                    half = own[own < _HALF]
                    lists = [(0, half)] if len(half) > missing else []
                    if 100 * len(half) <= mark * len(own):
                        lists.append((1, own))
                    for universe, part in lists:
                        docs.append(2 * int(doc) + universe)
                        slack.append(missing)
                        total.append(len(part))
                        hashes.append(part if not universe else mixed(part ^ np.uint64(1)))
                if not docs:
                    continue
                member = np.concatenate(hashes)
                owner = np.repeat(np.arange(len(docs), dtype="<u2"), total)
                bucket = (member >> np.uint64(32)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                member, owner = (member & np.uint64(0xFFFFFFFF)).astype("<u4")[order], owner[order]
                out = []
                for b in range(buckets):
                    low, high = cuts[b], cuts[b + 1]
                    if low < high:
                        used, local = np.unique(owner[low:high], return_inverse=True)
                        pick = used.tolist()
                        out.append((b, [docs[i] for i in pick], [slack[i] for i in pick], [total[i] for i in pick], member[low:high].tobytes(), local.astype("<u2").tobytes()))
                yield pd.DataFrame(out, columns=columns)

    return docs.mapInPandas(emit, "bucket int, docs array<long>, slack array<int>, total array<int>, members binary, owners binary")


def _shared(blocks: DataFrame) -> DataFrame:
    """(entry, slack, total, member, df) of the members that several entries
    hold.  A bucket has its share of all members, whatever the texts are like."""

    def count(key, frame: pd.DataFrame) -> pd.DataFrame:
        sizes = np.array([len(d) for d in frame["docs"]], np.int64)
        base = np.cumsum(sizes) - sizes
        entries, slack, total = (np.concatenate(frame[c].tolist()) for c in ("docs", "slack", "total"))
        member = np.concatenate([np.frombuffer(m, "<u4") for m in frame["members"]])
        owner = np.concatenate([np.frombuffer(o, "<u2") + b for o, b in zip(frame["owners"], base, strict=True)])
        order = np.argsort(member, kind="stable")
        member = member[order]
        new = np.flatnonzero(np.concatenate(([True], member[1:] != member[:-1])))
        df = np.diff(np.append(new, len(member)))
        keep = np.repeat(df > 1, df)
        own = owner[order][keep]
        return pd.DataFrame(
            {
                "entry": entries[own],
                "slack": slack[own],
                "total": total[own],
                "member": member[keep].astype(np.int64) | (np.int64(key[0]) << np.int64(32)),
                "df": np.repeat(df, df)[keep].astype(np.int32),
            }
        )

    return blocks.groupBy("bucket").applyInPandas(count, "entry long, slack int, total int, member long, df int")


def _token_of(universe: int):
    return lambda entry: F.xxhash64(F.lit(universe), entry["member"])


def heavy_postings(docs: DataFrame, standing: DataFrame, width: int, percent: int, boundary: int, buckets: int) -> DataFrame:
    """(token, doc_id) of the posted members of heavy classes."""
    shared = _shared(_members(docs, width, percent, boundary, buckets))
    # gathered by document before the shuffle; what is no class's text goes after it
    lists, aggregates = [], [F.max("slack").alias("slack")]
    for u in (0, 1):
        own = F.col("entry").bitwiseAND(F.lit(1)) == u
        aggregates += [F.max(F.when(own, F.col("total"))).alias(f"total{u}"), F.collect_list(F.when(own, F.struct("df", "member"))).alias(f"m{u}")]
        m = F.col(f"m{u}")
        room = F.coalesce(F.greatest(F.col("slack") + 1 - (F.col(f"total{u}") - F.size(m)), F.lit(0)), F.lit(0))
        lists.append(F.transform(F.slice(F.sort_array(m), F.lit(1), room), _token_of(u)))
    own = shared.groupBy(F.shiftright("entry", 1).alias("doc_id")).agg(*aggregates)
    own = own.join(standing.select("doc_id"), "doc_id", "left_semi")
    return own.select(F.explode(F.concat(*lists)).alias("token"), "doc_id")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the ``wanted`` ids, a saved table: found where the texts lie
    if the ids can be broadcast, else texts travel compressed."""
    if (few := of_ids(wanted)) is not wanted:
        return docs.join(few, "doc_id", "left_semi")
    return docs.select("doc_id", packed("text").alias("text")).join(wanted, "doc_id", "left_semi")


def _words(text) -> list[bytes]:
    return words_of(text) if is_null(text) or isinstance(text, str) else unpacked(bytes(text)).lower().split()


def light_postings(docs: DataFrame, standing: DataFrame, width: int, percent: int, boundary: int) -> DataFrame:
    """(token, doc_id) of the subsets of light classes."""

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for rows in rows_of(frames, "doc_id", "text"):
            out = []
            for doc, text in rows:
                own = shingles(_words(text), width).tolist()
                for b in range(len(own), boundary + 1):
                    need = overlap_needed(b, percent)
                    if own and need <= len(own):
                        for subset in combinations(own, need):
                            out.append((xxhash.xxh3_64_intdigest(np.array([b, *subset], "<u8").tobytes()) - (1 << 63), doc))
            yield pd.DataFrame(out, columns=["token", "doc_id"])

    # a text with few shingles can still be long: many repeated words
    light = saved(standing.where(F.col("n_shingles").between(1, boundary)).select("doc_id"), "light")
    return _texts(docs, light).mapInPandas(emit, "token long, doc_id long")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc_id, members) of the ``wanted`` ids, a saved table."""

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            members = [shingles(_words(x), width).tobytes() for x in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "members": members})

    return _texts(docs, wanted).mapInPandas(emit, "doc_id long, members binary")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = []
            for x, y in zip(frame["own"], frame["other"], strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield frame.loc[np.array(good, bool), ["a", "b"]]

    # each side's size is known before its members are joined: a pair of too
    # different sizes never meets
    left = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("own"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("other"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "own", "other")
    low, high = F.least(F.length("own"), F.length("other")), F.greatest(F.length("own"), F.length("other"))
    return both.where(100 * low >= percent * high).mapInPandas(check, "a long, b long")


def _forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs, as few as connect the same nodes."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    out = []
    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[y] = x
            out.append((a, b))
    return out


def _block_links(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between the components of one or two blocks of a list."""
    sets = [np.frombuffer(m, "<u8") for m in frame["members"]]
    sizes = np.array([len(x) for x in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = df[column] > 1
    row, column = row[keep], np.unique(column[keep], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[i:j], column[i:j] - at] = 1
        both += part @ part.T
    alike = 100 * both.astype(np.int64) >= percent * (sizes[:, None] + sizes[None] - both.astype(np.int64))
    roots = frame["root"].to_numpy()
    x, y = np.nonzero(np.triu(alike & (roots[:, None] != roots[None]), 1))
    pairs = np.unique(np.stack([roots[x], roots[y]], 1), axis=0) if len(x) else np.empty((0, 2), np.int64)
    return pd.DataFrame(_forest(pairs), columns=["a", "b"], dtype="int64")


def links_in_blocks(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): component roots that the long lists(token, doc_id, root, n)
    link.  A list of n members makes (n / BLOCK)^2 / 2 groups at most."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks.cast("long")).cast("int")
    rows = lists.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("own", own)
    rows = rows.select("token", "doc_id", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return (
        rows.join(sets, "doc_id")
        .groupBy("token", "i", "j")
        .applyInPandas(lambda frame: _block_links(frame, percent), "a long, b long")
        .distinct()
    )


def _digests(text: str) -> F.Column:
    def digest(texts: pd.Series) -> pd.Series:
        return pd.Series([_digest(words_of(t)) for t in texts], dtype=object)

    return F.pandas_udf(digest, "binary")(text)


def _with_nodes(docs: DataFrame, odd: DataFrame, kinds: DataFrame) -> DataFrame:
    """``docs`` with nodes as ids, where rows of the ``odd`` ids are told apart
    by their words; of these, rows that do not stand for a class go."""
    plain = docs.join(odd, "doc_id", "left_anti")
    told = docs.join(odd, "doc_id", "left_semi").withColumn("digest", _digests("text"))
    nodes = kinds.select(F.col("least").alias("doc_id"), "digest", "node")
    return plain.unionByName(told.join(nodes, ["doc_id", "digest"]).select(F.col("node").alias("doc_id"), "text"))


def similar_components(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_shingles, digest (of its
    words), class_id (the smallest doc_id with the same words), component_id
    and ``stays``: whether the row's id and words are the ones that stand for
    the component, the smallest id in it (and then digest)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    described = saved(classes(docs, width), "described")
    known = described.where("doc_id IS NOT NULL")
    docs = docs.where("doc_id IS NOT NULL")

    # a class has a node: its smallest id, or a number of its own above all
    # ids if another class has that id too
    usable = F.col("least").between(-LARGEST, LARGEST)
    kinds = known.groupBy("digest").agg(F.max("n_shingles").alias("n_shingles"), F.min("doc_id").alias("least"))
    kinds = kinds.withColumn("nr", F.row_number().over(Window.partitionBy("least").orderBy("digest")))
    above = F.lit(LARGEST + 1) + F.monotonically_increasing_id()
    kinds = saved(kinds.select("digest", "n_shingles", "least", F.when(usable & (F.col("nr") == 1), F.col("least")).otherwise(above).alias("node")), "classes")
    n_rows = known.count()
    n_kinds, n_members = kinds.agg(F.count("*"), F.sum("n_shingles")).first()
    odd = known.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    odd = saved(odd.where("low <> high" f" OR NOT doc_id BETWEEN {-LARGEST} AND {LARGEST}").select("doc_id"), "odd-ids")
    if not odd.isEmpty():
        docs = _with_nodes(docs, odd, kinds)
    standing = kinds.where("n_shingles > 0").select(F.col("node").alias("doc_id"), "n_shingles")

    sizes = standing.groupBy("n_shingles").count().where(F.col("n_shingles") <= 2 * LIGHT_LIMIT).collect()
    boundary = boundary_by_cost({r["n_shingles"]: r["count"] for r in sizes}, percent)
    buckets = parts_for(spark, (n_members or 0) // 2, BUCKET_MEMBERS)
    postings = heavy_postings(docs, standing, width, percent, boundary, buckets)
    if boundary:
        postings = postings.unionAll(light_postings(docs, standing, width, percent, boundary))
    postings = saved(postings, "postings")
    pivots = postings.groupBy("token").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    pivots = pivots.where("pivot < last").drop("last")
    lists = join_hot(postings, pivots, "token", postings.count(), "n")
    lists = saved(lists.select("token", "doc_id", "pivot").distinct(), "lists")
    deleted(postings)
    listed = saved(lists.select("doc_id").distinct(), "listed")
    sets = saved(_sets(docs, listed, width), "sets")
    deleted(listed)

    first = lists.where("doc_id <> pivot").groupBy("doc_id", "pivot").agg(F.count("*").alias("n"))
    first = first.groupBy("doc_id").agg(F.max(F.struct("n", "pivot"))["pivot"].alias("b")).withColumnRenamed("doc_id", "a")
    roots = connected(linked(first, sets, percent))

    labelled = lists.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "token", "doc_id", F.coalesce("root", "doc_id").alias("root")
    )
    labelled = saved(labelled, "all-labelled")
    deleted(lists)
    mixed_lists = labelled.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high")
    sized = saved(join_hot(labelled, mixed_lists.select("token", "n"), "token", labelled.count(), "n"), "labelled")
    deleted(labelled)
    short = sized.where(F.col("n") <= LONG)
    left = short.select("token", F.col("doc_id").alias("a"), F.col("root").alias("ra"))
    right = short.select("token", F.col("doc_id").alias("b"), F.col("root").alias("rb"))
    across = left.join(right, "token").where("ra < rb").select("a", "b").distinct()
    more = linked(across, sets, percent).unionAll(links_in_blocks(sized.where(F.col("n") > LONG), sets, percent))
    # the links of the first step as the stars of its components
    star = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    final = connected(star.unionAll(more))
    for table in (sets, sized, roots):
        deleted(table)

    of_kind = saved(kinds.join(final, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    standing_for = of_kind.groupBy("root").agg(F.min(F.struct("least", "digest")).alias("rep"))
    labels = join_hot(of_kind, standing_for, "root", n_kinds).select("digest", F.col("least").alias("class_id"), "rep")
    rows = join_hot(known, saved(labels, "labels"), "digest", n_rows)
    empty = F.col("n_shingles") == 0
    rows = rows.select(
        "doc_id", "n_shingles", "digest",
        F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("rep.least")).alias("component_id"),
        (empty | ((F.col("doc_id") == F.col("rep.least")) & (F.col("digest") == F.col("rep.digest")))).alias("stays"),
    )
    nobody = described.where("doc_id IS NULL")
    none = F.lit(None).cast("long")
    return rows.unionByName(nobody.withColumns({"class_id": none, "component_id": none, "stays": F.lit(True)}))


def one_of_each(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stand for their component, each once; rows
    without an id are in none and stay.  All columns are kept.

    Ids that go (or occur more than once) are joined against the rows, so the
    rows move only if those are too many to broadcast; rows of an id that
    occurs more than once are told apart by their words."""
    found = saved(similar_components(docs, width, percent).select("doc_id", "digest", "stays").where("doc_id IS NOT NULL"), "standing")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("stays").alias("stays"))
    ids = saved(ids.where("n > 1 OR NOT stays"), "ids")
    key = F.col("doc_id").cast("long")
    out = docs.join(of_ids(ids.select(F.col("doc_id").alias("__id"))), key == F.col("__id"), "left_anti")
    again = ids.where("stays").select(F.col("doc_id").alias("__id"))
    if again.isEmpty():
        return out

    rows = docs.join(again, key == F.col("__id"), "left_semi")
    rows = rows.select(key.alias("doc_id"), "text", whole_row(docs).alias("row"))
    rows = rows.withColumn("digest", _digests("text")).join(found.where("stays").select("doc_id", "digest").distinct(), ["doc_id", "digest"])
    rows = rows.groupBy("doc_id", "digest").agg(F.first("row").alias("row"))
    return out.unionByName(rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)))
