"""Operator 1: MinHash near-duplicates by an inverted join over signature coordinates.

1. Every text becomes its set of distinct word shingles (64-bit hashes) and a signature of
   COORDINATES values, each combining WIDTH MinHash minima, so that texts which merely share a
   passage seldom agree in one.
2. Texts with equal sets form a class; one row stands for it. A class is posted under each
   (coordinate, value) pair. A pair of classes is a candidate when at least MATCHES coordinates
   agree, so a class needs only its rarest values, the prefix of COORDINATES - MATCHES + 1;
   values that one class alone holds take the first places and need no posting at all.
3. Collisions are counted with skips. First every posting list offers only its leader to the
   other members and each class tries the leader it collides with most; lists whose members are
   connected by that are skipped, so a list of near copies costs about one pair per member.
4. Lists that still hold several components, of any length, are merged block by block: a task
   holds two blocks of a list, counts the collisions of their members on whole signatures, skips
   pairs that are connected already and confirms the others on full sets. It yields only the
   links that connect something new, fewer than it has members: no pair becomes a row.
5. Components of the confirmed links give the groups.

The exact rule is 100 * intersection >= percent * union. A link at similarity 0.75 agrees in
12.7 of 40 coordinates on average and in fewer than MATCHES with a probability of 5e-6; such a
pair has a posting in common that both prefixes keep, since both leave out the commonest value
in one order that all classes share. What is found doesn't depend on the order of the links.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import give_back, over_arrow, released, small, stored
from waymark.llm.components import components
from waymark.llm.textkernel import gather, mix, shingle_sets

COORDINATES = 40
WIDTH = 4
MATCHES = 2
MINIMA = COORDINATES * WIDTH
_random = np.random.RandomState(20240607)
_FACTORS = (_random.randint(0, 1 << 31, MINIMA).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFTS = _random.randint(0, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32)
#: Bounds of a block of a posting list, on average: members, and shingles of all their sets.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20
#: Likeliest partners of a member that are confirmed before all its others.
FIRST = 8


def signatures(sets: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """MinHash values (texts x MINIMA, 32 bits) of the sets; all ones for an empty set."""
    sizes = np.diff(offs)
    full = np.flatnonzero(sizes)
    out = np.full((len(sizes), MINIMA), 0xFFFFFFFF, np.uint32)
    if len(full):
        values = (sets >> np.uint64(32)).astype(np.uint32)
        for k in range(MINIMA):
            out[full, k] = np.minimum.reduceat(values * _FACTORS[k] + _SHIFTS[k], offs[full])
    return out


def coordinates(marks: np.ndarray) -> np.ndarray:
    """The (coordinate, value) pairs of signatures, as one 64-bit number each."""
    wide = marks.reshape(len(marks), COORDINATES, WIDTH).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, COORDINATES + 1, dtype=np.uint64), wide.shape[:2]).copy()
    for i in range(WIDTH):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, i])
    return out.view(np.int64)


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit digest of the set), signature (bytes of its coordinates)."""

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, offs = shingle_sets(batch.column("text"), size)
        marks = coordinates(signatures(sets, offs))
        keys = [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() for a, b in zip(offs[:-1], offs[1:])]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(offs)), pa.array(keys, pa.binary()), pa.array([m.tobytes() for m in marks], pa.binary())],
            ["doc_id", "n_shingles", "set_key", "signature"],
        )

    return over_arrow(docs.select("doc_id", "text"), sketch, "doc_id long, n_shingles long, set_key binary, signature binary")


def posted(classes: DataFrame) -> DataFrame:
    """Prefix postings (posting, doc, n, weight) of the classes (doc, n, signature).

    ``weight``, the total length of a class's lists, is largest for the text in the middle of a
    group of near copies.
    """

    def spread(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                values = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.int64)
                doc, n = (np.repeat(part.column(c).to_numpy(), COORDINATES) for c in ("doc", "n"))
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(doc), pa.array(n)], ["posting", "doc", "n"])

    every = classes.select("doc", "n", "signature").mapInArrow(spread, "posting long, doc long, n long")
    shared = every.groupBy("posting").agg(F.count("*").alias("held")).where("held > 1")
    mine = every.join(shared, "posting").groupBy("doc", "n").agg(F.array_sort(F.collect_list(F.struct("held", "posting"))).alias("shared"))
    # the other coordinates are held by this class alone and take the first places of the prefix
    room = F.lit(COORDINATES - MATCHES + 1) - (F.lit(COORDINATES) - F.size("shared"))
    weight = F.aggregate("shared", F.lit(0).cast("long"), lambda a, s: a + s["held"])
    mine = mine.where(F.size("shared") >= MATCHES).select("doc", "n", weight.alias("weight"), F.explode(F.slice("shared", F.lit(1), room)).alias("s"))
    return mine.select(F.col("s.posting").alias("posting"), "doc", "n", "weight")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(src, dst) of the pairs (a, b) that meet the rule on their full sets."""
    one = sets.select(F.col("doc").alias("a"), F.col("items").alias("ia"))
    two = sets.select(F.col("doc").alias("b"), F.col("items").alias("ib"))

    def confirm(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("ia"), batch.column("ib"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["src", "dst"]).filter(pa.array(ok))

    return pairs.join(one, "a").join(two, "b").mapInArrow(confirm, "src long, dst long")


def links(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> list[DataFrame]:
    """Stored tables of confirmed links (src, dst) that connect every group of near-duplicate classes."""
    postings = stored(posted(classes), "postings")
    involved = stored(postings.select("doc").distinct(), "involved")
    classes_in = involved.count()
    texts = docs.select(F.col("doc_id").alias("doc"), "text").join(small(involved, classes_in), "doc", "left_semi")

    def collect(batch: pa.RecordBatch) -> pa.RecordBatch:
        items, offs = shingle_sets(batch.column("text"), size)
        each = pa.array([items[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:])], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(np.diff(offs)), each], ["doc", "n", "items"])

    sets = stored(over_arrow(texts, collect, "doc long, n long, items binary"), "sets")
    if sets.count() > classes_in:  # rows that repeat a doc_id
        once, sets = sets, stored(sets.dropDuplicates(), "sets")
        released(once)
    # the text in the middle of a list leads it; its place comes before all members' in one order of all classes
    lead = F.min(F.struct((-F.col("weight")).alias("h"), "doc")).alias("lead")
    met = postings.join(postings.groupBy("posting").agg(lead), "posting").where("doc <> lead.doc").repartition("doc")
    counted = met.groupBy("doc", F.col("lead.doc").alias("leader")).agg(F.count("*").alias("collisions"))
    best = counted.groupBy("doc").agg(F.max(F.struct("collisions", "leader")).alias("p")).select(F.col("doc").alias("a"), F.col("p.leader").alias("b"))
    first = stored(_confirmed(best, sets, percent), "links")
    lists = _grouped(postings, first)
    members = stored(_open_members(lists), "open")
    released(lists, postings)
    rows = members.join(classes.select("doc", "n", "signature"), ["doc", "n"]).join(sets, ["doc", "n"])
    found = [first, stored(_merged(rows, percent), "links")]
    released(involved, sets, members)
    return found


def _grouped(postings: DataFrame, first: DataFrame) -> DataFrame:
    """Stored lists that still hold several groups, with the group of each member (``grp``).

    Links to leaders form trees, since a leader comes first in one order of all classes; a
    member's group is what its leader's leader hangs on, which is surely connected with it.
    """
    up = first.select(F.col("src").alias("doc"), F.col("dst").alias("grp"))
    top = up.select(F.col("doc").alias("grp"), F.col("grp").alias("top"))
    root = stored(up.join(top, "grp", "left").select("doc", F.coalesce("top", "grp").alias("grp")).groupBy("doc").agg(F.min("grp").alias("grp")), "roots")
    every = postings.join(root, "doc", "left").withColumn("grp", F.coalesce("grp", "doc"))
    mixed = every.groupBy("posting").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low <> high")
    lists = stored(every.join(mixed.select("posting"), "posting").select("posting", "doc", "n", "grp"), "lists")
    released(root)
    return lists


def _open_members(lists: DataFrame) -> DataFrame:
    """Members of open lists by blocks: posting, i, j, side, doc, n, grp, main.

    Members of a list's largest component (``main``) need to meet only the others. Block i of all
    members (side 0) meets block j of the others (side 1); a list of one block has each member
    once, the others with side 2 for both.
    """
    per = lists.groupBy("posting", "grp").agg(F.count("*").alias("k"), F.sum("n").alias("size"))
    main = per.groupBy("posting").agg(F.max(F.struct("k", "grp", "size")).alias("m"), F.sum("k").alias("k"), F.sum("size").alias("size"))

    def blocks(members, shingles):
        return F.ceil(F.greatest(members / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")

    main = main.select("posting", F.col("m.grp").alias("main"), blocks(F.col("k"), F.col("size")).alias("across"), blocks(F.col("k") - F.col("m.k"), F.col("size") - F.col("m.size")).alias("down"))
    every = lists.join(main, "posting")
    other = F.col("grp") != F.col("main")
    i, j = (F.pmod(F.xxhash64("doc", F.lit(salt)), F.col(count)).cast("int") for salt, count in ((0, "across"), (1, "down")))
    to = F.sequence(F.lit(0), F.col("down") - 1)
    left = F.transform(to, lambda x: F.struct(i.alias("i"), x.alias("j"), F.lit(0).alias("side")))
    right = F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda x: F.struct(x.alias("i"), j.alias("j"), F.lit(1).alias("side")))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(other, 2).otherwise(0).alias("side")))
    where = F.when((F.col("across") == 1) & (F.col("down") == 1), one).when(other, F.concat(left, right)).otherwise(left)
    return every.select("posting", F.explode(where).alias("at"), "doc", "n", "grp", "main").select("posting", "at.*", "doc", "n", "grp", "main")


class Block:
    """Two blocks of a posting list: members with groups, coordinates and full sets."""

    def __init__(self, table: pa.Table) -> None:
        self.doc, self.grp, self.n, self.side = (table.column(c).to_numpy() for c in ("doc", "grp", "n", "side"))
        self.main = table.column("main")[0].as_py()
        self.values = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.int64).reshape(-1, COORDINATES)
        flat = np.frombuffer(b"".join(table.column("items").to_pylist()), np.uint64)
        shown, self.items = np.unique(flat, return_inverse=True)
        self.start = np.cumsum(self.n) - self.n
        self.marked = np.zeros(len(shown), bool)

    def shared(self, x: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of x's set with the others'."""
        mine = self.items[self.start[x] : self.start[x] + self.n[x]]
        self.marked[mine] = True
        size = self.n[others]
        got = np.add.reduceat(self.marked[gather(self.items, self.start[others], size)].astype(np.int64), np.cumsum(size) - size)
        self.marked[mine] = False
        return got

    def forest(self, percent: int) -> list[tuple[int, int]]:
        """Links between members of different groups, each connecting two groups that were apart."""
        _, group = np.unique(self.grp, return_inverse=True)
        main = self.grp == self.main
        left, found = np.flatnonzero(self.side != 1), []
        for x in np.flatnonzero(self.side != 0):
            n, nx = self.n[left], self.n[x]
            may = (group[left] != group[x]) & (main[left] | (self.doc[left] < self.doc[x])) & (100 * np.minimum(n, nx) >= percent * np.maximum(n, nx))
            others = left[may]
            if not len(others):
                continue
            collisions = (self.values[others] == self.values[x]).sum(1)
            likely = np.argsort(-collisions, kind="stable")
            others = others[likely[: int((collisions >= MATCHES).sum())]]
            for part in (others[:FIRST], others[FIRST:]):
                part = part[group[part] != group[x]]
                if not len(part):
                    continue
                both = self.shared(x, part)
                for y in part[100 * both >= percent * (self.n[part] + nx - both)].tolist():
                    if group[y] != group[x]:
                        found.append((int(self.doc[y]), int(self.doc[x])))
                        group[group == group[y]] = group[x]
        return found


def _merged(rows: DataFrame, percent: int) -> DataFrame:
    """(src, dst): confirmed links between components, a spanning forest for each two blocks."""
    keys = ["posting", "i", "j"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        held: list[pa.RecordBatch] = []
        last: tuple = ()

        def links_of(parts: list[pa.RecordBatch]) -> list[tuple[int, int]]:
            table = pa.Table.from_batches(parts)
            return Block(table).forest(percent) if table.num_rows > 1 else []

        def table(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in keys], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            out: list[tuple[int, int]] = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and tuple(key[a]) != last:
                    out += links_of(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = tuple(key[a])
            if out:
                yield table(out)
        if held:
            yield table(links_of(held))
        give_back()

    return dealt.select(*keys, "side", "doc", "n", "grp", "main", "signature", "items").mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id that links reach; ``kept`` marks that document.
    Null or blank texts have an empty set and link with nothing. Rows that repeat a doc_id
    count as one document that has all their texts. A null doc_id stays alone, with a null
    component and kept null. Other columns of ``docs`` are not read.
    """
    rows = stored(sketched(docs, size), "sketches")
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    classes = stored(classes, "classes")
    found = links(docs, classes, size, percent)
    # rows of one doc_id with several texts tie their classes together
    held = rows.where("n_shingles > 0 and doc_id is not null")
    twice = stored(held.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low <> high").select("doc_id"), "twice")
    n = twice.count()
    edges = reduce(DataFrame.unionByName, found)
    if n:
        ties = held.join(small(twice, n), "doc_id").select("set_key", F.col("doc_id").alias("dst"))
        edges = edges.unionByName(ties.join(classes.select("set_key", F.col("doc").alias("src")), "set_key").select("src", "dst"))
    groups = components(edges, native=False)
    named = classes.select("set_key", "doc").join(groups.withColumnRenamed("node", "doc"), "doc", "left")
    named = named.select("set_key", F.coalesce("component", "doc").alias("component"))
    out = rows.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(own, "doc_id")).alias("component_id"))
    out = stored(out.withColumn("kept", F.col("doc_id") == F.col("component_id")), "groups")
    released(rows, classes, twice, *found, groups)
    return out
