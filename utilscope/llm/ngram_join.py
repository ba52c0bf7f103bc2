"""N-gram Jaccard join with prefix filters under several global token orders.

Two documents link when the Jaccard similarity of their sets of word shingles reaches
`numerator / denominator`. The steps:

1. Shingles that repeat are counted over all documents; the count class of a shingle, then a
   seeded hash, sort every set. Each seed gives another global order with rare shingles first.
2. A pair can only link when it shares a shingle in the prefixes under *every* order. The
   first order's prefixes are joined through their shared shingles, under the length and
   position filters; the other orders' prefixes are intersected on the pairs that remain.
3. Pairs that pass all filters are verified on their whole sets.

Equal sets are folded to one node first. Since only the connected classes are returned, pairs
inside a class that is already connected need no check: members of a shared shingle are first
compared with one hub of that shingle, the member with the fewest shingles of its own, then, if
it still spans several classes, with another hub, and at last every pair across two classes is. So a group of near copies costs
about as many checks as it has members, and no link between two classes is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilscope.llm.graph import components
from utilscope.llm.shingles import Sets, mix, shingle_sets
from utilscope.llm.storage import Filter, keep_keys, materialize, splittable, stored

#: Most entries of the broadcast table of repeating shingles (9 bytes each). Shingles beyond it
#: sort as rare ones: this costs speed, never a pair.
COUNTED_SHINGLES = 1 << 20
#: Keys of a node that are looked through for an earlier place where a pair meets.
EARLIER = 32
#: Shingles of the sets that meet in one block when many pairs of a group are verified.
BLOCK_SHINGLES = 1 << 16
#: Most postings of one shingle that a task holds at once.
HELD_ROWS = 1 << 16
#: Distinct shingles after which a task writes out its counts.
COUNT_EVERY = 1_000_000
#: Seeds of the hubs that are tried before all remaining pairs are.
HUB_SEEDS = (0, 1)


@dataclass(frozen=True)
class Similarity:
    """Shingles of `words` words; linked when denominator * |A and B| >= numerator * |A or B|."""

    words: int = 5
    numerator: int = 80
    denominator: int = 100
    orders: int = 3

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """So many first shingles of a set of n can hold the first one that a linked set shares."""
        return n - -(-n * self.numerator // self.denominator) + 1


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(_signed(values), pa.int64()))


def _fingerprints(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each row's set; 0 for an empty set."""
    if not len(sets.hashes):
        zero = np.zeros(len(sets.counts), np.uint64)
        return zero, zero
    filled = sets.counts > 0
    at = sets.starts[:-1][filled]
    out = []
    for seed in (11, 12):
        prints = np.zeros(len(filled), np.uint64)
        prints[filled] = mix(np.add.reduceat(mix(sets.hashes, seed), at), seed)
        out.append(prints)
    return out[0], out[1]


class ShingleClasses:
    """Count classes of repeating shingles: 0 where a shingle is not known to repeat."""

    def __init__(self, hashes: np.ndarray, classes: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.classes = hashes[order], classes[order]
        self.known = np.zeros(1 << 22, bool)
        self.known[self.hashes >> np.uint64(42)] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), np.uint8)
        maybe = np.flatnonzero(self.known[hashes >> np.uint64(42)])
        if len(maybe):
            at = np.searchsorted(self.hashes, hashes[maybe])
            at[at == len(self.hashes)] = 0
            hit = self.hashes[at] == hashes[maybe]
            found[maybe[hit]] = self.classes[at[hit]]
        return found


def _order(sets: Sets, classes: np.ndarray, seed: int) -> np.ndarray:
    """Places of the shingles, row by row, rare classes first, then by the seed's hash."""
    rows = sets.rows
    if seed == 0:  # hashes ascend already
        return np.argsort(rows * 64 + classes, kind="stable") if classes.any() else np.arange(len(rows))
    return np.lexsort((mix(sets.hashes, 100 + seed), classes, rows))


def _prefixes(sets: Sets, classes: np.ndarray, seed: int, like: Similarity, of: np.ndarray | None = None):
    """(starts, hashes, classes) of the rows' prefixes under one order; rows not in `of` get none."""
    order = _order(sets, classes, seed)
    counts = sets.counts
    place = np.arange(len(order)) - np.repeat(sets.starts[:-1], counts)
    taken = np.where(counts > 0, like.prefix(counts), 0)
    taken = taken if of is None else taken * of
    chosen = order[place < np.repeat(taken, counts)]
    return np.concatenate([[0], np.cumsum(taken)]), sets.hashes[chosen], classes[chosen]


def _repeating(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(shingle, documents) of shingles that repeat among the documents of a stretch of the task."""
    def counted(stretch: list[np.ndarray], rows: int) -> pa.RecordBatch:
        all_hashes = np.sort(np.concatenate(stretch)) if stretch else np.zeros(0, np.uint64)
        first = np.flatnonzero(np.concatenate([[True], all_hashes[1:] != all_hashes[:-1]])[:len(all_hashes)])
        counts = np.diff(np.append(first, len(all_hashes)))
        often = counts >= max(2, -(-rows // 4000))
        return pa.RecordBatch.from_arrays(
            [pa.array(_signed(all_hashes[first[often]])), pa.array(counts[often].astype(np.int64))],
            ["shingle", "documents"],
        )

    stretch, held, rows = [], 0, 0
    for batch in batches:
        for sets in shingle_sets(batch.column(0), words):
            stretch.append(sets.hashes)
            held += len(sets.hashes)
            rows += len(sets.counts)
            if held >= COUNT_EVERY:
                yield counted(stretch, rows)
                stretch, held, rows = [], 0, 0
    yield counted(stretch, rows)


def shingle_classes(docs: DataFrame, text: str, words: int) -> ShingleClasses:
    """The most frequent shingles of all documents, at most COUNTED_SHINGLES, by power of two.

    A shingle's documents are counted in stretches of a task and added up; a stretch leaves out
    shingles that it sees once. Counts are therefore lower bounds, and only order the shingles.
    """
    repeating = docs.select(text).mapInArrow(
        lambda batches: _repeating(batches, words), "shingle long, documents long"
    )
    counts = repeating.groupBy("shingle").agg(F.sum("documents").alias("documents"))
    counts = materialize(counts.select("shingle", F.floor(F.log2("documents")).cast("int").alias("class")))
    kept, least = 0, 64
    sizes = {r["class"]: r["count"] for r in counts.groupBy("class").count().collect()}
    for level in sorted(sizes, reverse=True):
        if kept + sizes[level] > COUNTED_SHINGLES:
            break
        kept, least = kept + sizes[level], level
    table = counts.where(F.col("class") >= least).toArrow()
    return ShingleClasses(
        table["shingle"].to_numpy().view(np.uint64), table["class"].to_numpy().astype(np.uint8)
    )


def _node_batches(batches, like: Similarity, known):
    """id, n, fingerprints and the first order's prefix (with classes) of every document.

    Of equal sets in a batch only the first has its prefix, so copies do not heap up on a shingle.
    """
    classes = known.value
    for batch in batches:
        met: set[int] = set()
        for sets in shingle_sets(batch.column(1), like.words):
            f1, f2 = _fingerprints(sets)
            again = np.array([f in met or met.add(f) is not None for f in f1.tolist()], bool)
            starts, hashes, levels = _prefixes(sets, classes.of(sets.hashes), 0, like, ~again)
            here = batch.slice(sets.first_row, len(f1))
            levels = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(levels.astype(np.int8)))
            yield pa.RecordBatch.from_arrays(
                [here.column(0), pa.array(sets.counts.astype(np.int64)), pa.array(_signed(f1)), pa.array(_signed(f2)),
                 _lists(hashes, starts), levels, here.column(2)],
                ["id", "n", "node", "node2", "prefix", "levels", "text_hash"],
            )


def _folded(rows: pa.Table) -> pa.Table:
    """Whole groups of (shingle, salt), sorted: those of several nodes, keyed by their member list."""
    shingle, salt, node = (rows[c].to_numpy() for c in ("shingle", "salt", "node"))
    new_group = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (salt[1:] != salt[:-1])])
    fresh = new_group | np.concatenate([[True], node[1:] != node[:-1]])
    group = np.cumsum(new_group) - 1
    sizes = np.bincount(group[fresh])
    members = np.zeros(len(sizes), np.uint64)
    np.add.at(members, group[fresh], mix(node[fresh].view(np.uint64), 21))
    salted = rows["salts"].to_numpy() > 1
    keep = np.flatnonzero(fresh & ((sizes[group] > 1) | salted))
    key = np.where(salted, shingle, _signed(members)[group])
    return pa.table({"key": key[keep], "node": node[keep], "place": rows["place"].to_numpy()[keep]})


#: Bits of a posting's `at` that hold the logarithm of its salts; its place in the prefix stands above them.
_SALT_BITS = 6


def _unpacked(batch: pa.RecordBatch) -> pa.Table:
    """shingle, node, salts, salt, place of packed postings."""
    at, node = batch.column("at").to_numpy(), batch.column("node").to_numpy()
    salts = np.int64(1) << (at & ((1 << _SALT_BITS) - 1))
    return pa.table({"shingle": batch.column("shingle"), "node": node, "salts": salts.astype(np.int32),
                     "salt": node % salts, "place": (at >> _SALT_BITS).astype(np.int32)})


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, place) of sorted postings whose shingle several nodes hold.

    Shingles with the same member list give the same candidates, so the list's fingerprint is
    their key. A group is held until it is whole; one longer than HELD_ROWS keeps its shingle as
    key and flows through.
    """
    held, flowing = None, None
    for batch in batches:
        table = _unpacked(batch)
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        if not table.num_rows:
            continue
        shingle, salt = table["shingle"].to_numpy(), table["salt"].to_numpy()
        last = (shingle[-1], salt[-1])
        before = np.flatnonzero((shingle != last[0]) | (salt != last[1]))
        whole = int(before[-1]) + 1 if len(before) else 0
        held = table.slice(whole)
        if flowing is not None or held.num_rows > HELD_ROWS:
            salts = np.full(table.num_rows, 1, np.int32)
            out = [(shingle[0], salt[0])] if flowing is not None else []
            out += [last] if held.num_rows > HELD_ROWS else []
            for of in out:
                salts[(shingle == of[0]) & (salt == of[1])] = 2
            salts = np.maximum(salts, table["salts"].to_numpy())
            table = table.set_column(table.schema.get_field_index("salts"), "salts", pa.array(salts))
            still = held.num_rows > HELD_ROWS or (flowing == last)
            flowing = last if still else None
            if still:
                whole, held = table.num_rows, None
        if whole:
            yield from _folded(table.slice(0, whole)).to_batches()
    if held is not None and held.num_rows:
        yield from _folded(held).to_batches()


def _shared_postings(prefixes: DataFrame, ends: DataFrame, like: Similarity) -> DataFrame:
    """(key, node, n, place, most, end) of the first order's prefix shingles that several nodes hold.

    `key` stands for all shingles of one member list, `place` is the smallest of their places.
    `most` leaves out the shingles of a node's prefix that no other prefix holds. Where its
    prefix ends (`end`) no later in the order than another's, all that its prefix shares with the
    other set lies in the other's prefix, so the two have at most `most` in common. Shingles of
    very many nodes are dealt over several tasks.
    """
    places = prefixes.select("node", "levels", F.posexplode("prefix").alias("place", "shingle"))
    # Most postings are of shingles that no other node holds, so no more than this travels with them.
    level = F.expr("greatest(0, levels[place] - 13)")
    packed = (F.shiftleft(F.col("place").cast("long"), _SALT_BITS) + level).alias("at")
    salt = F.pmod("node", F.expr(f"shiftleft(1L, cast(at & {(1 << _SALT_BITS) - 1} as int))"))
    dealt = places.select("shingle", "node", packed).repartition("shingle", salt)
    shared = dealt.sortWithinPartitions("shingle", salt, "node").mapInArrow(_shared, "key long, node long, place int")
    postings = materialize(
        shared.groupBy("key", "node").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("shingles"))
    )
    behind = F.expr(f"(n * {like.numerator} + {like.denominator - 1}) div {like.denominator} - 1")
    most = postings.groupBy("node").agg(F.sum("shingles").alias("held"))
    return materialize(postings.join(most, "node").join(ends, "node").select(
        "key", "node", "n", "place", (behind + F.col("held")).alias("most"), "end"
    ))


def _set_batches(batches, like: Similarity, known, wanted: Filter):
    """node, set in the second order, and the further orders' prefixes of the documents that pass the filter."""
    classes = known.value
    for batch in batches:
        texts = batch.column(0).filter(pa.array(wanted.may_hold(batch.column(1).to_numpy())))
        for sets in shingle_sets(texts, like.words):
            node, _ = _fingerprints(sets)
            levels = classes.of(sets.hashes)
            second = sets.hashes[_order(sets, levels, 1)]
            columns = [pa.array(_signed(node)), pa.array(sets.counts.astype(np.int64)), _lists(second, sets.starts)]
            for seed in range(2, like.orders):
                starts, hashes, _ = _prefixes(sets, levels, seed, like)
                columns.append(_lists(hashes, starts))
            names = ["node", "n", "shingles", *(f"prefix{seed}" for seed in range(2, like.orders))]
            yield pa.RecordBatch.from_arrays(columns, names)


class _Verifier:
    """Sets of the documents that have candidates, and the check of candidate pairs on them."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, known, like: Similarity):
        self.docs, self.nodes, self.known, self.like = docs, nodes, known, like

    def _sets(self, pairs: DataFrame) -> DataFrame:
        """`node`, `n`, `shingles` in the second order and the further orders' prefixes of the nodes in the pairs."""
        like, known = self.like, self.known
        ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node")))
        ids = self.nodes.select("node", F.xxhash64("id").alias("hash")).join(ends, "node", "left_semi")
        wanted = Filter(ids.select("hash"))
        schema = "node long, n long, shingles array<long>" + "".join(f", {p} array<long>" for p in self.further)
        return (
            self.docs.select("text", F.xxhash64("id").alias("hash"))
            .mapInArrow(lambda batches: _set_batches(batches, like, known, wanted), schema)
            .dropDuplicates(["node"])
        )

    @property
    def further(self) -> list[str]:
        return [f"prefix{seed}" for seed in range(2, self.like.orders)]

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of the stored pairs (a, b, hub), those whose prefixes meet under every order and whose sets are similar.

        A member meets its set first. What is dealt out by hub then holds the members' sets, so Spark
        sees how much a hub with many members weighs and splits it.
        """
        like, further, sets = self.like, self.further, self._sets(pairs)
        side = lambda end: sets.select(*[F.col(c).alias(f"{c}_{end}") for c in sets.columns])
        member = F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a"))
        both = (
            pairs.withColumn("member", member).join(side("a"), F.col("member") == F.col("node_a"))
            .join(side("b"), F.col("hub") == F.col("node_b"))
        )
        if like.orders > 1:
            taken = f"n_{{0}} - ceil(n_{{0}} * {like.numerator} / {like.denominator}) + 1"
            first = "slice(shingles_{0}, 1, cast(" + taken + " as int))"
            both = both.where(F.arrays_overlap(F.expr(first.format("a")), F.expr(first.format("b"))))
        for prefix in further:
            both = both.where(F.arrays_overlap(f"{prefix}_a", f"{prefix}_b"))
        common = F.size(F.array_intersect("shingles_a", "shingles_b"))
        total = F.col("n_a") + F.col("n_b") - common
        return both.where(common * like.denominator >= total * like.numerator).select("a", "b")

    def links_of_groups(self, pairs: DataFrame) -> DataFrame:
        """As `links`, for stored pairs (key, a, b, n_a, n_b) of which many meet at one key.

        The nodes of a key are dealt over blocks; a set is sent to each pair of blocks in which it
        has a pair, not to each pair, and a task holds the sets of one pair of blocks.
        """
        like, further = self.like, self.further
        ends = pairs.select("key", F.col("a").alias("node"), F.col("n_a").alias("n")).unionAll(
            pairs.select("key", "b", "n_b")
        ).distinct()
        blocks = F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int")
        sizes = splittable(ends.groupBy("key").agg(blocks.alias("blocks")))
        block = lambda node: F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")
        group = ["key", "low", "high"]
        placed = materialize(pairs.join(sizes, "key").select(
            "key", F.least(block("a"), block("b")).alias("low"), F.greatest(block("a"), block("b")).alias("high"), "a", "b"
        ), pairs.count())
        needed = placed.select(*group, F.col("a").alias("node")).unionAll(placed.select(*group, "b")).distinct()
        lists = ["shingles", *further]
        sent = needed.join(self._sets(pairs), "node").select(*group, "node", F.lit(None).cast("long").alias("other"), *lists)
        asked = placed.select(
            *group, F.col("a").alias("node"), F.col("b").alias("other"),
            *[F.lit(None).cast("array<long>").alias(c) for c in lists],
        )
        dealt = sent.unionAll(asked).repartition(*group).sortWithinPartitions(*group, F.col("other").asc_nulls_first())
        return dealt.mapInArrow(lambda batches: _similar(batches, like), "a long, b long")


def _similar(batches: Iterator[pa.RecordBatch], like: Similarity) -> Iterator[pa.RecordBatch]:
    """Of sorted rows, sets (without `other`) before pairs in each group: the pairs that are similar."""
    at, sets = None, {}

    def linked(a: int, b: int) -> bool:
        (x, *px), (y, *py) = sets[a], sets[b]
        if any(p.isdisjoint(q) for p, q in zip(px, py)):
            return False
        places = np.searchsorted(y, x)
        places[places == len(y)] = 0
        common = int(np.count_nonzero(y[places] == x))
        return common * like.denominator >= (len(x) + len(y) - common) * like.numerator

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "low", "high", "node", "other")]
        lists = [batch.column(c) for c in batch.schema.names[5:]]
        found = []
        for i, (key, low, high, node, other) in enumerate(zip(*columns)):
            if (key, low, high) != at:
                at, sets = (key, low, high), {}
            if other is not None:
                if linked(node, other):
                    found.append((node, other))
                continue
            shingles, *prefixes = (c[i].values.to_numpy() for c in lists)
            if like.orders > 1:  # the shingles stand in the second order
                prefixes.insert(0, shingles[:int(like.prefix(len(shingles)))])
            sets[node] = (np.sort(shingles), *[frozenset(p.tolist()) for p in prefixes])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])


def _candidates(left: DataFrame, right: DataFrame, like: Similarity, more=None) -> DataFrame:
    """Pairs (a, b) of nodes of other classes that share a shingle and pass the length and position filters.

    With the right node as `hub`; or with `more`, a condition that puts the left node first, their sizes and a
    key they share.
    A pair's first shared shingle passes both: nothing before it is common, so as much of either
    set as lies behind it must suffice.
    """
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    enough = lambda common: common * like.denominator >= (l("n") + r("n") - common) * like.numerator
    behind = F.least(l("n") - l("place"), r("n") - r("place"))
    most = F.when(l("end") <= r("end"), l("most")).otherwise(r("most"))
    met = left.alias("l").join(right.alias("r"), l("key") == r("key")).where(
        (l("class") != r("class")) & enough(F.least(l("n"), r("n"), most)) & enough(behind)
    )
    if more is None:
        pair = [F.least(l("node"), r("node")).alias("a"), F.greatest(l("node"), r("node")).alias("b")]
        return met.groupBy(*pair).agg(F.min(r("node")).alias("hub"))
    return met.where(more(l, r)).groupBy(
        l("node").alias("a"), r("node").alias("b"), l("n").alias("n_a"), r("n").alias("n_b")
    ).agg(F.min(l("key")).alias("key"))


def _with_earlier(postings: DataFrame) -> DataFrame:
    """The postings with `earlier`: which of the node's first EARLIER keys come before this one.

    A pair is met at every key that it shares; where both have an earlier shared key the pair is
    left to that one.
    """
    ordered = F.array_sort(F.collect_list(F.struct("place", "key")))
    first = postings.groupBy("node").agg(F.slice(F.transform(ordered, lambda x: x["key"]), 1, EARLIER).alias("first"))
    at = F.array_position("first", F.col("key"))
    earlier = F.when(at > 0, F.slice("first", F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(F.col("first"))
    return postings.join(first, "node").withColumn("earlier", earlier).drop("first")


def _spanning(postings: DataFrame, classes: DataFrame | None) -> DataFrame:
    """The postings of shingles whose nodes lie in several classes, with their class."""
    if classes is None:
        return postings.withColumn("class", F.col("node"))
    found = classes.select("node", F.col("component").alias("class"))
    known = postings.join(found, "node", "left").withColumn("class", F.coalesce("class", "node"))
    mixed = known.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    return known.join(splittable(mixed.where("low < high").select("key")), "key", "left_semi")


def _linked_classes(postings: DataFrame, verifier: _Verifier, like: Similarity) -> DataFrame:
    """(`node`, `component`) of all nodes that have a link."""
    links = classes = tried = None
    n_postings, n_links = postings.count(), 0
    for seed in (*HUB_SEEDS, None):
        if classes is not None:
            postings = materialize(_spanning(postings.drop("class"), classes))
            if postings.isEmpty():
                break
        else:
            postings = _spanning(postings, None)
        if seed is None:
            postings = _with_earlier(postings)
            once = lambda l, r: (l("node") < r("node")) & ~F.arrays_overlap(l("earlier"), r("earlier"))
            pairs = _candidates(postings, postings, like, once)
        else:
            # The node with the fewest shingles of its own is the likeliest centre.
            own = (F.col("n") - F.col("most")) / F.col("n") if seed == 0 else F.lit(0.0)
            hub = F.min(F.struct(
                own.alias("own"), F.xxhash64("node", F.lit(seed)).alias("h"), "node", "n", "place", "most", "end", "class"
            ))
            hubs = postings.groupBy("key").agg(hub.alias("hub")).select("key", "hub.*").drop("own", "h")
            pairs = _candidates(postings, splittable(hubs), like)
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        if seed is None:
            pairs = materialize(pairs)
            found = materialize(verifier.links_of_groups(pairs), pairs.count())
        else:  # a posting meets one hub
            pairs = materialize(pairs, n_postings)
            found = materialize(verifier.links(pairs), pairs.count())
        n_links += found.count()
        met = pairs.select("a", "b")
        tried = met if tried is None else tried.unionAll(met)
        links = found if links is None else links.unionAll(found)
        classes = components(links, "a", "b", n_links)
    return classes


def ngram_classes(docs: DataFrame, like: Similarity = Similarity(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """`id`, `n_shingles`, `component_id` for every row of `docs`, with `text_hash` of its text.

    `component_id` is the smallest id that links reach, the row's own included. A NULL text is
    an empty one. Texts without a word have no shingle and no link; a text of fewer words than a
    shingle is one shingle. NULL ids never name a class: `component_id` is NULL only where a
    class has no other id. Rows of equal ids keep a row each. Other columns are not read. Sets
    are identified by 64-bit fingerprints.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    known = spark.sparkContext.broadcast(shingle_classes(docs, "text", like.words))
    schema = "id long, n long, node long, node2 long, prefix array<long>, levels array<tinyint>, text_hash long"
    # The prefixes are made twice, here for their ends alone: a pass over the texts costs less than to store them.
    prefixes = docs.select("id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        lambda batches: _node_batches(batches, like, known), schema
    )
    last = F.struct(  # in the first order: by class, then by unsigned hash
        F.element_at("levels", -1).alias("level"),
        F.element_at("prefix", -1).bitwiseXOR(F.lit(-(2**63))).alias("hash"),
    )
    signed = materialize(prefixes.select(
        "id", "n", "node", "node2", "text_hash", F.when(F.size("prefix") > 0, last).alias("end")
    ))
    ends = signed.where("end is not null").groupBy("node").agg(F.min("end").alias("end"), F.min("n").alias("n"))
    nodes = materialize(
        signed.where("n > 0").groupBy("node", "node2", "n")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    )
    postings = _shared_postings(prefixes, ends, like)
    classes = _linked_classes(postings, _Verifier(docs, nodes, known, like), like)
    named = nodes.select("node", "id", "copies").join(classes, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"), F.sum("copies").alias("members"))
    grouped = smallest.where("members > 1").select("component", "component_id")
    of_node = named.join(grouped, "component").select("node", "component_id")
    return signed.select("id", "n", "node", "text_hash").join(of_node, "node", "left").select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"),
        "text_hash",
    )


def one_of_each(docs: DataFrame, like: Similarity = Similarity(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` without near-duplicates: of each class, the row of the smallest id.

    Rows of equal id and equal text count as one. Rows of NULL id stay unless their class has an id.
    """
    found = materialize(ngram_classes(docs, like, id, text))
    kept = F.col(id).eqNullSafe(F.col("component_id"))
    keys = stored(found.groupBy(F.col(id).alias("key"), F.col("text_hash").alias("hash")).agg(
        F.bool_and(kept).alias("kept"), F.count(F.lit(1)).alias("rows")
    ).withColumn("both", F.xxhash64("key", "hash")))
    return keep_keys(docs, [F.col(id).cast("long"), F.xxhash64(F.col(text).cast("string"))], keys)
