"""MinHash near-duplicates with sequential Bayesian verification.

Documents with the same shingle set form a class, of which one representative is compared.  Banded MinHash signatures
put similar classes into common buckets.  Within a bucket classes are compared with two pivots first; what these
links connect needs no further comparison, so that a large group of near copies costs a row for each member.  Only
members that are still in different components of a bucket are then compared with one another.

A pair's signatures are compared batch by batch.  With a uniform prior, the posterior of its similarity after m matches
of n is a Beta distribution; once the chance of reaching the threshold falls under the chosen miss probability, the
pair is dropped.  Survivors are verified exactly on the shingle sets of whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import written
from scriptorium.llm.components import connected_components

WIDTH = 5
U64 = np.uint64
PRIME = U64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Similarity:
    """Link where 100 * intersection >= ``percent`` * union.  ``rows`` signature values make a band; there are as many
    bands as keep the chance of missing a pair at the threshold under ``miss``, the limit of Bayesian pruning too."""

    percent: int = 80
    rows: int = 5
    miss: float = 1e-7
    batch: int = 32

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def values(self) -> int:
        return self.bands * self.rows

    def least_matches(self) -> list[tuple[int, int]]:
        """(compared values, matches below which a pair is dropped) after every batch."""
        t, out = self.percent / 100, []
        for n in [*range(self.batch, self.values, self.batch), self.values]:
            # P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m)
            p, m = 0.0, -1
            while p < self.miss:
                m += 1
                p += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            out.append((n, m))
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, U64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))
    n = min(WIDTH, len(h))
    total = np.full(len(h) - n + 1, n, U64)
    for i in range(n):
        total = total * PRIME + h[i : i + len(total)]
    return np.unique(mixed(total))


@lru_cache(4)
def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(6).integers(1, 1 << 63, n, dtype=np.uint64)[:, None] * U64(2) + U64(1)


def signature(own: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHash values of 32 bits."""
    low = np.full(n, ~U64(0))
    for at in range(0, len(own), 1024):
        np.minimum(low, (multipliers(n) * own[at : at + 1024]).min(1), out=low)
    return (low >> U64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    grid = sig.reshape(-1, rows).astype(U64)
    key = np.arange(len(grid)).astype(U64)
    for i in range(rows):
        key = mixed(key * PRIME + grid[:, i])
    return key.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


def sketches(docs: DataFrame, sim: Similarity) -> DataFrame:
    """(row, id, h, n_shingles, content, sig, bands) of (id, h, text) rows; ``content`` identifies the shingle set, and
    ``row`` the row, once the result is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, len(batch), 1000)):
                n, content, sigs, bands = [], [], [], []
                for text in part.column(2).to_pylist():
                    own = shingles(text)
                    n.append(len(own))
                    content.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                    sig = signature(own, sim.values) if len(own) else None
                    sigs.append(sig.tobytes() if len(own) else None)
                    bands.append(band_keys(sig, sim.rows) if len(own) else None)
                columns = [pa.array(range(row, row + len(part)), pa.int64()), part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(content, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "h", "n_shingles", "content", "sig", "bands"])
                row += len(part)

    return docs.mapInArrow(run, "row long, id long, h long, n_shingles long, content binary, sig binary, bands array<long>")


def survivors(pairs: DataFrame, sigs: DataFrame, sim: Similarity) -> DataFrame:
    """The (a, b) rows of ``pairs`` that Bayesian pruning leaves."""
    steps = sim.least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(len(batch), -1) for c in (2, 3))
            going, done, m = np.arange(len(batch)), 0, np.zeros(len(batch), np.int64)
            for n, least in steps:
                m[going] += (left[going, done:n] == right[going, done:n]).sum(1)
                going, done = going[m[going] >= least], n
            yield batch.select([0, 1]).take(pa.array(going))

    both = pairs.join(sigs.toDF("b", "sig_b"), "b").join(sigs.toDF("a", "sig_a"), "a").select("a", "b", "sig_a", "sig_b")
    return both.mapInArrow(run, "a long, b long")


#: Members of a block: those that meet one copy of a pivot, or a block of strays, in one task.
BLOCK_ROWS = 512


def verified(pairs: DataFrame, texts: DataFrame, sim: Similarity) -> DataFrame:
    """The (a, b) rows of ``pairs`` that are links on full shingle sets; ``texts`` has a row (nid, text) for each.

    The members b that meet one a are dealt out in blocks, and the text of a goes to each block once, however many
    members it has."""
    hot = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    members = pairs.join(hot, "a", "left").select("a", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"), F.col("b").alias("nid"), F.lit(True).alias("member"))
    leads = pairs.select("a").distinct().join(hot, "a", "left").select("a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("a").alias("nid"), F.lit(False).alias("member"))
    met = members.union(leads).join(texts, "nid").repartition("a", "part").sortWithinPartitions("a", "part", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, own = None, None
        for batch in batches:
            left, right = [], []
            for a, part, nid, member, text in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "nid", "member", "text"))):
                if not member:
                    lead, own = (a, part), shingles(text)
                elif lead == (a, part) and linked(own, shingles(text), sim.percent):
                    left.append(a)
                    right.append(nid)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return met.select("a", "part", "nid", "member", "text").mapInArrow(run, "a long, b long")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows of equal keys as tables; groups may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(len(batch), bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), len(batch)]
        for start, end in zip(edges, edges[1:]):
            key = tuple(c[start] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def open_members(groups: DataFrame, comps: DataFrame) -> DataFrame:
    """(grp, band, nid, comp, main, n, strays): the members of groups that hold more than one component; ``main`` is the
    component of most of the n members, ``strays`` the number of those outside it."""
    labelled = written(groups.join(comps, "nid", "left").withColumn("comp", F.coalesce("comp", "nid")), "labelled")
    counted = labelled.groupBy("grp", "comp").agg(F.count("*").alias("c")).groupBy("grp").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("comp", "c").alias("main"))
    several = written(counted.where("n > most").select("grp", "n", "main", (F.col("n") - F.col("most")).alias("strays")), "open-groups")
    return labelled.join(several, "grp")


def meetings(members: DataFrame) -> DataFrame:
    """Every member in its home block, and every stray in each home block that it visits.

    Strays, the members outside the group's main component, are blocked too, and a task sees one block of either kind; so
    a group of near copies costs a row for each member and one for each stray and block, members of the main component
    never meet, and no group is gathered anywhere."""
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("int")
    dealt = members.select("grp", "band", "nid", "comp", (F.col("comp") != F.col("main")).alias("stray"), blocks("n").alias("homes"), blocks("strays").alias("visits"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("nid"), F.col("homes")).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    home = dealt.withColumn("visit", every("visits")).select("grp", F.col("own").alias("home"), "visit", F.lit(False).alias("visitor"), "band", "nid", "comp", "stray")
    guests = dealt.where("stray").withColumn("visit", F.pmod(F.xxhash64("nid", F.lit(1)), F.col("visits")).cast("int")).withColumn("home", every("homes"))
    return home.union(guests.select("grp", "home", "visit", F.lit(True).alias("visitor"), "band", "nid", "comp", "stray"))


def met(members: DataFrame, *values: DataFrame) -> DataFrame:
    """The meetings with each member's values, a block of members and one of strays side by side."""
    rows = reduce(lambda left, right: left.join(right, "nid"), values, meetings(members))
    return rows.repartition("grp", "home", "visit").sortWithinPartitions("grp", "home", "visit")


def likely(batches: Iterator[pa.RecordBatch], sim: Similarity) -> Iterator[tuple[pa.Table, int, np.ndarray, np.ndarray]]:
    """(meeting, stray, partners, equal values) for every stray of every meeting: the members of other components that
    Bayesian pruning leaves, most alike first."""
    steps = sim.least_matches()
    for t in grouped(batches, ["grp", "home", "visit"]):
        visitor, nid, comp, stray = (t.column(c).to_numpy() for c in ("visitor", "nid", "comp", "stray"))
        sigs, there = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(len(nid), -1), np.flatnonzero(~visitor)
        for i in np.flatnonzero(visitor).tolist():
            # two strays meet in the home block of either; one of the meetings is enough
            others = there[(comp[there] != comp[i]) & (~stray[there] | (nid[there] < nid[i]))]
            same = sigs[others] == sigs[i]
            keep = np.ones(len(others), bool)
            for n, least in steps:
                keep &= same[:, :n].sum(1) >= least
            if keep.any():
                order = np.argsort(-same[keep].sum(1), kind="stable")
                yield t, i, others[keep][order], same[keep][order]


def pairs_of(left: list, right: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


class Union:
    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        while (p := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(p, p)
            x = p
        return x

    def join(self, x, y) -> None:
        self.parent[self.find(x)] = self.find(y)


def links_within(members: DataFrame, sigs: DataFrame, texts: DataFrame, sim: Similarity) -> DataFrame:
    """Links (a, b) between different components of a cluster: all pairs of a stray and another member are compared, but
    for components that the same task has linked already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, ([], [])
        for t, i, others, _ in likely(batches, sim):
            if t is not last:
                last, sets, union = t, {}, Union()
                comp, nid, text = (t.column(c) for c in ("comp", "nid", "text"))
            get = lambda k: sets[k] if k in sets else sets.setdefault(k, shingles(text[k].as_py()))  # noqa: B023, E731
            own = comp[i].as_py()
            for k in others.tolist():
                if union.find(own) != union.find(comp[k].as_py()) and linked(get(i), get(k), sim.percent):
                    union.join(own, comp[k].as_py())
                    out[0].append(nid[i].as_py())
                    out[1].append(nid[k].as_py())
        yield pairs_of(*out)

    return met(members, sigs, texts).mapInArrow(run, "a long, b long")


def candidates_between(members: DataFrame, sigs: DataFrame, sim: Similarity) -> DataFrame:
    """Pairs (a, b) of different clusters that meet in a bucket and survive Bayesian pruning, each from the first band
    that they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, i, others, same in likely(batches, sim):
            own = others[same.reshape(len(others), sim.bands, sim.rows).all(2).argmax(1) == t.column("band")[0].as_py()]
            if len(own):
                yield pairs_of([t.column("nid")[i].as_py()] * len(own), t.column("nid").to_numpy()[own].tolist())

    return met(members, sigs).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, id: str, text: str, sim: Similarity) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: the set's size, the smallest id that links lead to, and
    whether that is the row's own id.

    A null or empty text, or one without words, has no shingles and is linked with nothing; identical texts are one
    class; rows that repeat an id are one document, linked by whatever any of its texts is linked by.  ``id`` is an
    integer column; a null id comes back with a null component and ``kept`` true, and links nothing.  An empty table
    gives an empty one.

    Classes of equal shingle sets are compared, each by one row of it; ids only come in at the end.

    Scale: band rows are shuffled once to be counted and once to be joined; everything after works on classes that share
    a bucket.  A pivot's text goes to each block of its members once.  What the pivots leave unlinked in a cluster meets
    its members in blocks, each member being sent once and each stray once a block.
    """
    source = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    rows = written(sketches(source, sim), "sketches")
    full = rows.where("content is not null and id is not null")
    classes = written(full.groupBy("content").agg(F.min_by("row", "id").alias("nid"), F.min("id").alias("least")), "classes")
    reps = written(rows.join(classes.select(F.col("nid").alias("row")), "row", "left_semi").select(F.col("row").alias("nid"), "id", "h", "sig", "bands"), "representatives")
    sigs, ids = reps.select("nid", "sig"), reps.select("nid", "id")
    spread = reps.select("nid", F.posexplode("bands").alias("band", "bucket"))
    common = written(spread.groupBy("bucket").agg(F.count("*").alias("n"), F.min("nid").alias("p"), F.max("nid").alias("q")).where("n > 1").drop("n"), "common")
    buckets = written(spread.join(common, "bucket"), "buckets")

    # Each bucket's members meet two pivots, the first of which is a.
    pivots = buckets.select(F.explode(F.array("p", "q")).alias("a"), F.col("nid").alias("b"), "p").where("a <> b and (a = p or b <> p)").select("a", "b").distinct()
    maybe = written(survivors(pivots, sigs, sim), "survivors")
    # The texts of all that share a bucket: the only shuffle of whole texts that all later steps draw on.
    sharing = buckets.select("nid").distinct().join(reps.select("nid", "id", "h"), "nid")
    texts = written(source.join(sharing, ["id", "h"]).select("id", "h", "nid", "text").dropDuplicates(["id", "h"]).select("nid", "text"), "texts")
    links = written(verified(maybe, texts, sim), "links")
    comps = written(connected_components(links), "components").toDF("nid", "comp")
    clusters = written(connected_components(maybe), "clusters").toDF("nid", "cluster")

    # Within the clusters of likely pairs, whose members are each sent once; then between clusters, by bucket.
    inside = open_members(clusters.select(F.col("cluster").alias("grp"), F.lit(-1).alias("band"), "nid"), comps)
    more = written(links_within(inside, sigs, texts, sim), "more-links")
    across = open_members(buckets.select(F.col("bucket").alias("grp"), "band", "nid"), clusters.toDF("nid", "comp"))
    rest = written(candidates_between(across, sigs, sim), "rest")
    links = links.union(more).union(verified(rest, texts, sim))

    by_id = links.join(ids.toDF("b", "id_b"), "b").join(ids.toDF("a", "id_a"), "a").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    same = full.select("id", "content").join(classes, "content").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    final = written(connected_components(by_id.union(same)), "final").toDF("id", "component_id")
    out = rows.select("id", "n_shingles").join(final, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
