"""MinHash near dedup by an inverted join on signature coordinates.

Every document's set of five-word shingles gives a signature of COORDINATES minima. Documents with equal sets are one
class at once. Class representatives are posted under (coordinate, value) pairs, in two turns: first under PREFIX
coordinates, and who shares fewer than COLLIDE of these lists with anybody has no partner of similarity 0.75 (but for 2 in
a million) and is left out; the others are posted under every coordinate. Two documents with MATCHES equal coordinates share
as many lists, so each may skip its MATCHES - 1 longest lists: in one global order of lists, the rarest
one they share is among the rest of both. What many documents share, as a common passage's lists, is skipped so, and
a document with too few shared lists has none left. Pairs that meet have their collisions counted over all
coordinates; pairs with MATCHES are confirmed on their full sets, each document with its best partner first.

Lengths and smallest nodes of the longest lists, BROADCAST_ROWS at most, go to the tasks that post documents; joins by list or text
deal what is long still, a list or a text with many copies, to several tasks (`_dealt`).

No list is expanded into all its pairs. Each list links its members to its smallest one, which joins groups of
copies in a pass. Lists whose members are then in one component are done. What the others hold is dealt
with once, in families (components that meet in a list), whole sets side by side: a family is cut into blocks by
size of set (sets of unlike size can't be similar) and pairs of blocks are counted inside tasks, where members with less than three
quarters of their shingles in the other block go first. A pair of blocks gives the links that join components, never a row for a pair that
is refuted. So rows grow with the documents; the counting inside a family of unlinked look-alikes, which no bound
excludes, is the one thing that grows with the square of the family, in blocks.

Components: smallest id by repeated minimum over links and pointer jumping, in tables of links between
classes. Every round's tables are written to the shared folder; nothing but counts and the longest lists' lengths reaches the driver.

Defined cases: null and empty texts have no set and are linked with nothing; fewer than five words make one
shingle; very long texts are read whole, and blocks are bounded by shingles too; a null id takes no part and has a null component, kept; rows that share an id are one
document, compared with the others by one of their texts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfold.llm.common import BROADCAST_ROWS, Scratch, near_by, worker_cache

WORDS, COORDINATES, PREFIX, COLLIDE, MATCHES = 5, 128, 32, 12, 75
SIMILAR = (75, 100)
BLOCK, BLOCK_SHINGLES, COLUMNS, TABLE_WORDS = 2048, 500_000, 4096, 100_000
#: Keys of up to so many rows are joined in one task.
LONG = 256
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _word_codes() -> dict[bytes, int]:
    """Codes of words, one table a worker; emptied when it has TABLE_WORDS."""
    return worker_cache("minhash", dict)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit codes of a text's shingles."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = _word_codes()
    if len(codes) > TABLE_WORDS:
        codes.clear()
    for w in set(words).difference(codes):
        codes[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    total = np.full(n, min(len(h), WORDS), np.uint64)
    for i in range(min(len(h), WORDS)):
        total = _mix(total + h[i : i + n])
    return np.unique(total)


@cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(75)
    return rng.integers(0, 1 << 31, (COORDINATES, 1)).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, (COORDINATES, 1)).astype(np.uint32)


def signature(codes: np.ndarray) -> np.ndarray:
    """COORDINATES minima of 32-bit hashes, as int32."""
    a, b = _multipliers()
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    high = (codes >> np.uint64(32)).astype(np.uint32)[None, :]
    for at in range(0, len(codes), 1024):
        np.minimum(least, (high[:, at : at + 1024] * a + b).min(1), out=least)
    return least.view(np.int32)


def _signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, twin (digest of the set), heads (PREFIX minima), marks (a byte of every minimum) and signature; null for empty sets.

    Bytes of two minima that differ are equal once in 256 times, so marks count a collision too many at times, never one too few.
    """
    schema = "doc_id long, n_shingles long, twin binary, heads binary, marks binary, signature binary"

    def rows(it):
        for batch in it:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, batch.num_rows, 1024):
                n, own = [], [[], [], [], []]
                for text in texts[at : at + 1024].to_pylist():
                    codes = shingles(text)
                    n.append(len(codes))
                    least = signature(codes)
                    values = (xxhash.xxh3_128_digest(codes.tobytes()), least[:PREFIX].tobytes(), least.astype(np.uint8).tobytes(), least.tobytes()) if len(codes) else [None] * 4
                    for column, value in zip(own, values, strict=True):
                        column.append(value)
                columns = [pa.array(ids[at : at + 1024], pa.int64()), pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in own)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "twin", "heads", "marks", "signature"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, schema)


def _lists(minima: pa.Array, rows: int) -> np.ndarray:
    """A row's lists by coordinate; a list's number holds coordinate and value."""
    sigs = np.frombuffer(b"".join(minima.to_pylist()), np.int32).reshape(rows, -1)
    return (np.arange(sigs.shape[1], dtype=np.int64) << 32) | (sigs.astype(np.int64) & 0xFFFFFFFF)


def _postings(nodes: DataFrame, minima: str) -> DataFrame:
    """(list, n, node): for each of the `minima` (heads or signature) how many rows of a batch have it, and their smallest node."""

    def rows(it):
        for batch in it:
            if not batch.num_rows:
                continue
            lists = _lists(batch.column(1), batch.num_rows)
            found, place, n = np.unique(lists, return_inverse=True, return_counts=True)
            least = np.full(len(found), np.iinfo(np.int64).max)
            np.minimum.at(least, place.ravel(), np.repeat(batch.column(0).to_numpy(zero_copy_only=False), lists.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64)), pa.array(least)], ["list", "n", "node"])

    return nodes.select("node", minima).mapInArrow(rows, "list long, n long, node long")


def _sizes(posted: DataFrame) -> DataFrame:
    """(list, n, least) of all lists: length and smallest node."""
    return posted.groupBy("list").agg(F.sum("n").alias("n"), F.min("node").alias("least"))


def _unskipped(nodes: DataFrame, known: pd.DataFrame, skip: int, known_only: bool) -> DataFrame:
    """(list, node, left, least) of each node's lists by signature but those that it skips.

    known: list (sorted), n and least of the longest lists. Of these each node skips its longest ones, `skip` at most; left is how many it may skip still,
    least a known list's smallest node, null for others, which known_only leaves out. A node that may skip still has no known list left.
    """
    numbers, sizes, smallest = (known[c].to_numpy(np.int64) for c in ("list", "n", "least"))

    def rows(it):
        for batch in it:
            if not batch.num_rows:
                continue
            lists = _lists(batch.column(1), batch.num_rows)
            hit, n, least = np.zeros(lists.shape, bool), np.zeros(lists.shape, np.int64), np.zeros(lists.shape, np.int64)
            if len(numbers):
                place = np.minimum(np.searchsorted(numbers, lists), len(numbers) - 1)
                hit = numbers[place] == lists
                n, least = np.where(hit, sizes[place], 0), smallest[place]
            first = np.argsort(-n, axis=1, kind="stable")[:, :skip]  # longest first, then by number, as in _skipped
            keep = np.ones(lists.shape, bool)
            np.put_along_axis(keep, first, ~np.take_along_axis(hit, first, 1), 1)
            left = skip - (~keep).sum(1)
            keep &= hit | (not known_only)
            own = [np.repeat(c, keep.sum(1)) for c in (batch.column(0).to_numpy(zero_copy_only=False), left)]
            columns = [pa.array(lists[keep]), pa.array(own[0]), pa.array(own[1].astype(np.int32)), pa.array(least[keep], mask=~hit[keep])]
            yield pa.RecordBatch.from_arrays(columns, ["list", "node", "left", "least"])

    return nodes.select("node", "signature").mapInArrow(rows, "list long, node long, left int, least long")


def _sharing(nodes: DataFrame, sizes: DataFrame, posts: int, least: int) -> DataFrame:
    """(node) of those that share `least` or more of their `posts` lists with another row: a list of one row is its smallest node's, so no posting is joined."""
    own = nodes.select("node", F.lit(posts).alias("n"))
    alone = sizes.filter("n = 1").select(F.col("least").alias("node"), F.lit(-1).alias("n"))
    return own.union(alone).groupBy("node").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("node")


def _bound(total: int) -> int:
    """Rows from which a key is long: at most BROADCAST_ROWS keys of `total` rows are longer."""
    return max(LONG, -(-total // BROADCAST_ROWS))


def _dealt(rows: DataFrame, key: str, spread: str, found: DataFrame, counted: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """rows joined with found (key, n and more; n rows have the key) by key, where a long key's rows are dealt to several tasks by the column `spread`.

    counted (saved) has key and n of all in found. A key is long from LONG rows and a BROADCAST_ROWS-th part of the `total` rows on: so at most BROADCAST_ROWS
    keys are long, whatever the input, and they alone are broadcast. Rows of a null key, which meet nothing, are dealt too.
    """
    bound = _bound(total)
    parts = F.ceil(F.col("n") / bound).cast("long")
    long = counted.filter(F.col("n") > bound).select(key, parts.alias("_parts"))
    at = F.xxhash64(spread)
    part = F.when(F.col(key).isNull(), at).otherwise(F.pmod(at, F.coalesce("_parts", F.lit(1).cast("long"))))
    salted = rows.join(F.broadcast(long), key, "left").withColumn("_part", part).drop("_parts")
    copies = found.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return salted.join(copies, [key, "_part"], how).drop("_part")


def _known_from(shared: DataFrame, total: int) -> int:
    """Lists of more rows than this are BROADCAST_ROWS at most; never above _bound, so that no longer list is left."""
    top = _bound(total)
    upto, more = F.least("n", F.lit(top + 1)).alias("n"), 0
    for n, count in sorted(map(tuple, shared.groupBy(upto).count().collect()), reverse=True):
        more += count
        if more > BROADCAST_ROWS and n <= top:
            return n
    return 1


def _skipped(nodes: DataFrame, matches: int, scratch: Scratch) -> DataFrame:
    """(list, node, least) of lists of more than one node, without each node's matches - 1 longest lists.

    Nodes that share fewer than `matches` lists have none left and are not posted again. The longest lists, BROADCAST_ROWS at most, are known to the tasks
    that post nodes: these are skipped, or have their smallest node, there, and are joined with nothing. Other lists are short; they are skipped in the same
    order once their lengths are joined. So a member of a large group brings the lists that it keeps, and meets long ones without a join.
    """
    sizes = scratch.save(_sizes(_postings(nodes, "signature")), "sizes")
    sharing = scratch.save(_sharing(nodes, sizes, COORDINATES, matches), "sharing")
    shared = sizes.filter("n > 1")
    bound = _known_from(shared, nodes.count() * COORDINATES)
    known = shared.filter(F.col("n") > bound).orderBy("list").toPandas()
    posted = _unskipped(nodes.join(near_by(sharing), "node", "left_semi"), known, matches - 1, bound == 1)
    if bound == 1:
        return posted.select("list", "node", "least")
    posted = scratch.save(posted, "posted")
    order = W.partitionBy("node").orderBy(F.col("n").desc(), "list")
    short = posted.filter("least is null").drop("least").join(shared.filter(F.col("n") <= bound), "list").withColumn("rank", F.row_number().over(order))
    return posted.filter("least is not null").select("list", "node", "least").union(short.filter(F.col("rank") > F.col("left")).select("list", "node", "least"))


def _likely(pairs: DataFrame, nodes: DataFrame, matches: int) -> DataFrame:
    """(a, b, equal) of the pairs with so many collisions over all coordinates and sets of like size."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("marks").alias(f"s_{c}"), F.col("n_shingles").alias(f"n_{c}"))
    low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    met = pairs.join(side("a"), "a").join(side("b"), "b").filter(low * SIMILAR[1] >= high * SIMILAR[0])

    def agree(it):
        for batch in it:
            a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in batch.columns[2:])
            equal = (a == b).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(equal.astype(np.int32))], ["a", "b", "equal"]).filter(pa.array(equal >= matches))

    return met.select("a", "b", "s_a", "s_b").mapInArrow(agree, "a long, b long, equal int")


def _confirmed(likely: DataFrame, docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(a, b) of the pairs whose full sets are similar."""
    wanted = scratch.save(likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct(), f"{name}-wanted")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(near_by(wanted), "doc_id", "left_semi")
    text = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t_{c}"))

    def confirm(it):
        last, own = None, None
        for batch in it:
            a_ids, b_ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, a in enumerate(a_ids):
                if a != last:
                    last, own = a, shingles(batch.column(2)[i].as_py())
                other = shingles(batch.column(3)[i].as_py())
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(SIMILAR[1] * both >= SIMILAR[0] * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a_ids, pa.int64()), pa.array(b_ids, pa.int64())], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = likely.join(text("b"), "b").join(text("a"), "a").select("a", "b", "t_a", "t_b")
    return both.mapInArrow(confirm, "a long, b long").distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): the smallest node that links (a, b) reach, for every node that has one.

    Tables of up to BROADCAST_ROWS rows (their count is checked) are joined by broadcast, larger ones by shuffle.
    """
    n = links.count()
    parts = max(2, n // 200_000)
    held = F.broadcast if n <= BROADCAST_ROWS else (lambda df: df)
    both = scratch.save(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-both", parts)
    now = scratch.save(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), f"{name}-0", parts)
    turn = 0
    while True:
        turn += 1
        near = both.join(held(now.withColumnRenamed("node", "b")), "b").groupBy("a").agg(F.min("component").alias("near"))
        found = near.join(held(now), now.node == near.a).select("node", F.least("component", "near").alias("next"), F.col("component").alias("was"))
        found = scratch.save(found, f"{name}-found-{turn}", parts)
        hop = found.select(F.col("node").alias("next"), F.col("next").alias("hop"))
        then = scratch.save(found.join(held(hop), "next").select("node", F.least("next", "hop").alias("component"), "was"), f"{name}-{turn}", parts)
        changed = then.filter("component <> was").limit(1).count()
        scratch.drop(f"{name}-found-{turn}", f"{name}-{turn - 1}")
        now = then.select("node", "component")
        if not changed:
            return now


def _extended(links: DataFrame, of: DataFrame, likely: DataFrame, docs: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """The links with those of the likely pairs that join two components, and the components then."""
    side = lambda c: of.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    apart = likely.join(side("a"), "a", "left").join(side("b"), "b", "left").filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b"))
    apart = scratch.save(apart.select("a", "b"), f"{name}-apart")
    new = None if apart.isEmpty() else scratch.save(_confirmed(apart, docs, scratch, name), f"{name}-new")
    if new is None or new.isEmpty():
        return links, of
    links = scratch.save(links.union(new), f"{name}-links")
    return links, components(links, scratch, name)


def _families(lists: DataFrame, of: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(node, component, family) of what lists with several components hold; None if there are none."""
    named = lists.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ends = named.groupBy("list").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = scratch.save(ends.filter("low <> high").select("list", "n", "low"), "mixed")
    members = scratch.save(_dealt(named, "list", "node", mixed, mixed, lists.count()).select("node", "component", "low").distinct(), "members")
    scratch.drop("mixed")
    ties = members.filter("low <> component").select(F.col("low").alias("a"), F.col("component").alias("b")).distinct()
    if ties.isEmpty():
        return None
    family = components(ties, scratch, "families").select(F.col("node").alias("component"), F.col("component").alias("family"))
    return members.select("node", "component").distinct().join(family, "component").select("node", "component", "family")


def _blocks(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(block, family, band, held, members): a family's sets in blocks of at most about BLOCK members and BLOCK_SHINGLES.

    Sets in one or two neighbouring bands may be similar, others can't. A component with many members in a band has blocks of
    its own (held: which), so that what is already linked is not compared; all other members share blocks.
    """

    def rows(it):
        for batch in it:
            nodes, comps, families, texts = batch.columns
            for at in range(0, batch.num_rows, 512):
                sets = [shingles(t) for t in texts[at : at + 512].to_pylist()]
                band = np.floor(np.log([len(x) for x in sets]) / np.log(SIMILAR[1] / SIMILAR[0]) + 1e-9).astype(np.int32)
                n = [len(x) for x in sets]
                columns = [*(c[at : at + 512] for c in (nodes, comps, families)), pa.array(band), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "component", "family", "band", "size", "codes"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(near_by(members), "node").select("node", "component", "family", "text")
    sets = texts.mapInArrow(rows, "node long, component long, family long, band int, size long, codes binary").filter("size > 0")
    keys = ["family", "band"]
    parts = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES), F.lit(1)).cast("int")
    sizes = sets.groupBy(*keys, "component").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    many = F.col("n") >= BLOCK // 4
    own = sizes.select(*keys, "component", F.when(many, parts(F.col("n"), F.col("total"))).alias("own_parts"))
    rest = sizes.filter(~many).groupBy(*keys).agg(parts(F.sum("n"), F.sum("total")).alias("rest_parts"))
    dealt = sets.join(own, [*keys, "component"]).join(rest, keys, "left")
    alone = F.col("own_parts").isNotNull()
    part = F.pmod(F.xxhash64("node"), F.coalesce("own_parts", "rest_parts"))
    name = F.concat_ws("-", "family", "band", F.when(alone, F.col("component").cast("string")).otherwise(F.lit("rest")), part)
    named = dealt.withColumns({"block": name, "held": F.when(alone, F.col("component"))})
    return named.groupBy("block").agg(F.first("family").alias("family"), F.first("band").alias("band"), F.first("held").alias("held"), F.collect_list(F.struct("node", "component", "codes")).alias("members"))


class _Sets:
    """A block's members: nodes, components, sizes of sets, all codes and whose they are."""

    def __init__(self, members: list[dict]):
        members = sorted(members, key=lambda m: m["node"])
        self.nodes, self.components = (np.array([m[k] for m in members], np.int64) for k in ("node", "component"))
        sets = [np.frombuffer(m["codes"], np.uint64) for m in members]
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.codes, self.owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)

    def within(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, place in codes) of the codes that are among `codes` (sorted)."""
        place = np.minimum(np.searchsorted(codes, self.codes), max(len(codes) - 1, 0))
        hit = codes[place] == self.codes if len(codes) else np.zeros(len(self.codes), bool)
        return self.owner[hit], place[hit]

    def only(self, keep: np.ndarray) -> _Sets:
        out = object.__new__(_Sets)
        out.nodes, out.components, out.sizes = self.nodes[keep], self.components[keep], self.sizes[keep]
        held = keep[self.owner]
        out.codes, out.owner = self.codes[held], (np.cumsum(keep) - 1)[self.owner[held]]
        return out


def linked_pairs(left: _Sets, right: _Sets | None) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of links of the full sets that join all components that links between the blocks (None: inside the one) join."""
    same = right is None
    while True:
        right = left if same else right
        if same:
            codes, count = np.unique(left.codes, return_counts=True)
            codes = codes[count > 1]
        else:
            codes = np.intersect1d(left.codes, right.codes)
        found = left.within(codes), right.within(codes)
        enough = [SIMILAR[1] * np.bincount(own, minlength=len(s.sizes)) >= SIMILAR[0] * s.sizes for (own, _), s in zip(found, (left, right), strict=True)]
        if not enough[0].any() or not enough[1].any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if enough[0].all() and enough[1].all():
            break
        left, right = left.only(enough[0]), right if same else right.only(enough[1])
    both = np.zeros((len(left.sizes), len(right.sizes)), np.float32)
    for lo in range(0, len(codes), COLUMNS):
        cube = []
        for (own, place), s in zip(found, (left, right), strict=True):
            at = (place >= lo) & (place < lo + COLUMNS)
            cube.append(np.zeros((len(s.sizes), min(COLUMNS, len(codes) - lo)), np.float32))
            cube[-1][own[at], place[at] - lo] = 1
        both += cube[0] @ cube[1].T
    near = SIMILAR[1] * both >= SIMILAR[0] * (left.sizes[:, None] + right.sizes[None, :] - both)
    i, j = np.nonzero(near & (left.components[:, None] != right.components[None, :]))
    ends = np.sort(np.stack([left.components[i], right.components[j]]), axis=0)
    _, once = np.unique(ends, axis=1, return_index=True)
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while up.setdefault(c, c) != c:
            up[c] = c = up[up[c]]
        return c

    picked = []
    for k in once.tolist():
        x, y = root(int(ends[0, k])), root(int(ends[1, k]))
        if x != y:
            up[max(x, y)] = min(x, y)
            picked.append(k)
    return left.nodes[i[picked]], right.nodes[j[picked]]


def _between(blocks: DataFrame) -> DataFrame:
    """(a, b): links that join the components that the blocks of each family have."""
    named = blocks.select("block", "family", "band", "held")
    other = named.select("family", *[F.col(c).alias(f"{c}2") for c in ("block", "band", "held")])
    apart = F.col("held").isNull() | F.col("held2").isNull() | (F.col("held") != F.col("held2"))
    pairs = named.join(other, "family").filter((F.col("block") <= F.col("block2")) & (F.abs(F.col("band") - F.col("band2")) <= 1) & apart)
    members = blocks.select("block", "members")
    met = pairs.select("block", "block2").join(members, "block").join(members.select(F.col("block").alias("block2"), F.col("members").alias("members2")), "block2")
    met = met.select("block", "block2", "members", F.when(F.col("block") != F.col("block2"), F.col("members2")).alias("members2")).repartition("block", "block2")

    def rows(it):
        for batch in it:
            for i in range(batch.num_rows):
                left, right = (c[0] for c in batch.slice(i, 1).to_pydict().values())
                a, b = linked_pairs(_Sets(left), None if right is None else _Sets(right))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return met.select("members", "members2").mapInArrow(rows, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, matches: int = MATCHES, collide: int = COLLIDE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each input row.

    matches=1, collide=0 is the exact way: all documents are posted under every coordinate, no list is skipped, and what meets in any list is
    compared by full sets. A link is lost then only if no coordinate of 128 is equal (4 ** -128 at a similarity of 0.75).
    """
    if not 1 <= matches <= COORDINATES or not 0 <= collide <= PREFIX:
        raise ValueError(f"matches is from 1 to {COORDINATES}, collide from 0 to {PREFIX}")
    scratch = Scratch(docs.sparkSession, "minhash")
    signed = scratch.save(_signatures(docs), "signed")
    full = signed.filter("twin is not null and doc_id is not null")
    classes = scratch.save(full.groupBy("twin").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "classes")
    first = full.join(classes, (full["doc_id"] == classes["node"]) & (full["twin"] == classes["twin"])).select("node", "heads")

    if collide:
        met = scratch.save(_sharing(first, _sizes(_postings(first, "heads")), PREFIX, collide), "met")
    else:
        met = classes.select("node")
    own = full.join(near_by(met), full["doc_id"] == met["node"]).groupBy("node").agg(F.min_by(F.struct("signature", "marks", "n_shingles"), "twin").alias("own"))
    nodes = scratch.save(own.select("node", "own.*"), "nodes")
    lists = scratch.save(_skipped(nodes, matches, scratch), "lists")
    scratch.drop("sizes", "sharing", "posted")

    stars = lists.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    likely = scratch.save(_likely(stars, nodes, matches), "likely")
    best = W.partitionBy("b").orderBy(F.col("equal").desc(), "a")
    links = scratch.save(_confirmed(likely.withColumn("rank", F.row_number().over(best)).filter("rank = 1"), docs, scratch, "best"), "best")
    links, of = _extended(links, components(links, scratch, "first"), likely, docs, scratch, "stars")
    members = _families(lists, of, scratch)
    if members is not None:
        new = scratch.save(_between(scratch.save(_blocks(scratch.save(members, "family-members"), docs), "blocks")), "between")
        if not new.isEmpty():
            links = links.union(new)
            of = components(links, scratch, "last")
    found = classes.join(of, "node", "left").select("twin", "n", F.coalesce("component", "node").alias("component"))
    own = _dealt(signed.select("doc_id", "n_shingles", "twin"), "twin", "doc_id", found, classes, signed.count(), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return own.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that near_duplicates keeps; of rows that share an id, all stay."""
    gone = near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
