"""N-gram Jaccard join by universe partitioning (operator 3).

A document is the set of its distinct word 4-shingles (64-bit hashes).  Sets
fall into size bands.  For a band the universe of shingles is hashed into
``m`` segments, a little more than the largest number of differing shingles
two linked sets can have.  A set is indexed by the hash of each segment's
subset and, for some segments (all of them in bands of small sets), of the
subset less one element (one-deletion neighbourhood).  Two linked sets have
at most H differing shingles, so of any segments with together H + 1 units
of tolerance (one for an exact match, one more for a one-deletion match) at
least one must match.

The allocation of tolerance is by cost: Spark counts every signature in the
corpus; a signature nobody shares costs nothing and is never joined, and of
the shared ones a set probes the rarest that its H + 1 units still need.
Sets sharing a probed signature are verified exactly on their shingles, not
in all pairs: first each against the likeliest of the members (hubs) that
most of its signatures name, twice with different hubs, the links contracted
to components in between.  Pairs inside a component need no check, since only
components are asked for.  What signatures still leave open between
components is narrowed on the shingles themselves: only shingles held by
several components can make a link between them, a set with too few of those
has none, and two linked sets share one of the rarest (prefix filter).  Of
those pairs the likeliest between each two components is verified, then all
whose components that has not merged.  Every step is exact, so no link
between different texts is lost.  Equal sets are one class from the start.

Hot groups: copies collapse to one set; signatures are counted with map-side
combination; hubs of many sets are salted in the verification join.

Defined results: null texts and texts without words have empty sets, linked
with nothing; fewer words than a shingle make one shingle of all; the
smallest doc_id ignores nulls (a component without any doc_id has a null
component_id); repeated rows are members of their component like others;
extra columns are ignored; an empty table gives an empty table.  Sets are
told apart by 61-bit hashes of their whole content, shingles by 64-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopflow.llm.common import Words, flat_utf8, materialize, maybe_broadcast, mix64, read_table, text_chunks, unused_name
from shopflow.llm.components import connected_components

THRESHOLD = 85      # percent
SEG_BITS = 24
ROUNDS = 2  # of verification against hubs
HUBS = 4  # a round compares a set with this many hubs by their parity maps
PARITY_WORDS = 8  # 64-bit words of a set's parity map

_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
               0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


class Bands:
    """Size bands and their segments for a threshold of ``t`` percent.

    ``low``: smallest size of each band; ``m``: segments; ``d``: how many of
    them also have one-deletion neighbourhoods.
    """

    def __init__(self, t: int = THRESHOLD, ratio: float = 1.6, top: int = 1 << 31):
        low = [1]
        while low[-1] < top:
            low.append(max(low[-1] + 1, int(low[-1] * ratio)))
        self.t, self.low = t, np.array(low, np.int64)
        self.high = np.append(self.low[1:] - 1, np.iinfo(np.int64).max >> 20)
        most = self.differ(self.high, 100 * self.high // t)
        self.m = np.where(most > 0, most + 1 + np.maximum(1, -(-8 * (most + 1) // 100)), 0)
        self.d = np.where(self.high < 48, self.m, np.maximum(1, self.m // 32)) * (self.m > 0)

    def differ(self, a, b):
        """Most differing elements of linked sets of sizes a and b (in both together)."""
        return (100 - self.t) * (a + b) // (100 + self.t)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, side="right") - 1

    def plan(self, size: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per set: band to use, segments, deletion segments, spare tolerance (own or next lower band)."""
        own = self.of(np.maximum(size, 1))
        band = np.maximum(own - 1, 0) if cross else own
        partner = np.minimum(size, self.high[band])
        use = size > 0
        if cross:
            use &= (own > 0) & (100 * self.high[band] >= self.t * size)
        m = np.where(use, self.m[band], 0)
        d = np.where(use, self.d[band], 0)
        return band, m, d, m + d - (self.differ(partner, size) + 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, shingles): each document's sorted distinct shingles of lower-cased words."""
    words = Words(data, offsets)
    h = words.hashes(data, lower=True)
    n_docs = len(offsets) - 1
    size = np.where(words.count >= width, words.count - width + 1, (words.count > 0).astype(np.int64))
    bounds = np.zeros(n_docs + 1, np.int64)
    np.cumsum(size, out=bounds[1:])
    shingles = np.empty(bounds[-1], np.uint64)
    full = np.repeat(words.count >= width, size)
    if len(h) >= width:
        at = np.flatnonzero(words.doc[:len(h) - width + 1] == words.doc[width - 1:])
        total = h[at] * _K[0]
        for j in range(1, width):
            total += h[at + j] * _K[j]
        shingles[full] = mix64(total)
    for i in np.flatnonzero((words.count > 0) & (words.count < width)):
        first, n = words.first[i], words.count[i]
        shingles[bounds[i]] = mix64((h[first:first + n] * _K[:n]).sum(dtype=np.uint64, keepdims=True) + _K[4:5] * np.uint64(n))[0]
    for i in range(n_docs):
        shingles[bounds[i]:bounds[i + 1]].sort()
    doc = np.repeat(np.arange(n_docs), size)
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])
    bounds = np.searchsorted(doc[new], np.arange(n_docs + 1))
    return bounds, shingles[new]


def set_ids(bounds: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Order-free hash of each set, low three bits zero."""
    sums = np.zeros(len(shingles) + 1, np.uint64)
    np.cumsum(mix64(shingles ^ _K[5]), out=sums[1:])
    total = sums[bounds[1:]] - sums[bounds[:-1]]
    return mix64(total + np.diff(bounds).astype(np.uint64) * _K[6]) & ~np.uint64(7)


def signatures(bounds: np.ndarray, shingles: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set id | kind << 1 | cross) rows of the given sets."""
    size, ids = np.diff(bounds), set_ids(bounds, shingles)
    doc = np.repeat(np.arange(len(size)), size)
    value = mix64(shingles ^ _K[7])
    out = []
    for cross in (False, True):
        band, m, d, _ = bands.plan(size, cross)
        at = np.flatnonzero(m[doc] > 0)
        if not len(at):
            continue
        who, val = doc[at], value[at]
        seed = mix64((band.astype(np.uint64) + np.uint64(1)) * _K[0])
        seg = ((mix64(shingles[at] ^ seed[who]) >> np.uint64(32)) * m[who].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        start = np.zeros(len(m) + 1, np.int64)
        np.cumsum(m, out=start[1:])
        place = start[who] + seg
        sums = np.zeros(start[-1], np.uint64)
        np.add.at(sums, place, val)
        counts = np.bincount(place, minlength=start[-1])
        owner = np.repeat(np.arange(len(m)), m)
        seg_no = np.arange(start[-1]) - start[owner]

        def sign(total, count, doc_of, seg_of, kind):
            x = mix64(total + count.astype(np.uint64) * _K[1] + seed[doc_of] + seg_of.astype(np.uint64) * _K[2])
            sig = (x << np.uint64(SEG_BITS)) | (seg_of.astype(np.uint64) & np.uint64((1 << SEG_BITS) - 1))
            out.append((sig, ids[doc_of] | np.uint64(kind << 1 | cross)))

        sign(sums, counts, owner, seg_no, 0)
        some = np.flatnonzero(seg < d[who])
        if len(some):
            p = place[some]
            sign(sums[p] - val[some], counts[p] - 1, who[some], seg[some], 1)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sig, who = (np.concatenate(x).view(np.int64) for x in zip(*out))
    return sig, who


def _some(bounds: np.ndarray, shingles: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets numbered ``keep`` only."""
    size = np.diff(bounds)
    mask = np.zeros(len(size), bool)
    mask[keep] = True
    out = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(size[mask], out=out[1:])
    return out, shingles[np.repeat(mask, size)]


# -- Spark side ------------------------------------------------------------------
def _set_rows(width: int, bands: Bands):
    names = ["doc_id", "text_hash", "n_shingles", "sid", "own_d", "own_spare", "cross_d", "cross_spare"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            bounds, shingles = shingle_sets(*flat_utf8(batch.column(0)), width)
            size = np.diff(bounds)
            _, _, d0, s0 = bands.plan(size, False)
            _, _, d1, s1 = bands.plan(size, True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(size), pa.array(set_ids(bounds, shingles).view(np.int64)),
                 pa.array(d0), pa.array(s0), pa.array(d1), pa.array(s1)], names=names)
    return rows


def _signature_rows(width: int, bands: Bands):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            bounds, shingles = shingle_sets(*flat_utf8(batch.column(0)), width)
            _, first = np.unique(set_ids(bounds, shingles), return_index=True)
            sig, who = signatures(*_some(bounds, shingles, np.sort(first)), bands)
            for i in range(0, len(sig), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(sig[i:i + (1 << 17)]), pa.array(who[i:i + (1 << 17)])], names=["sig", "who"])
    return rows


def parity_maps(bounds: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """(sets, PARITY_WORDS): bit i tells whether an odd number of a set's shingles
    hash to i.  Two sets differ in at least as many shingles as their maps in bits."""
    n, bits = len(bounds) - 1, 64 * PARITY_WORDS
    place = np.repeat(np.arange(n), np.diff(bounds)) * bits + (mix64(shingles ^ _K[3]) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(place, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64)


def _shingle_rows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            bounds, shingles = shingle_sets(*flat_utf8(batch.column(0)), width)
            maps = parity_maps(bounds, shingles).reshape(-1)
            steps = pa.array(np.arange(len(bounds), dtype=np.int32) * PARITY_WORDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(set_ids(bounds, shingles).view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(shingles.view(np.int64))),
                 pa.ListArray.from_arrays(steps, pa.array(maps))], names=["sid", "shingles", "parity"])
    return rows


def _probes(hits: DataFrame, sets: DataFrame) -> DataFrame:
    """(sig, sid): the shared signatures each set must look up, rarest first."""
    per_segment = hits.groupBy("sid", "cross", "seg").agg(
        F.max(F.when(~F.col("deleted"), F.col("n"))).alias("e_cost"),
        F.collect_set(F.when(~F.col("deleted"), F.col("sig"))).alias("e_sigs"),
        F.max(F.when(F.col("deleted"), F.col("n"))).alias("d_cost"),
        F.collect_set(F.when(F.col("deleted"), F.col("sig"))).alias("d_sigs"))
    info = sets.groupBy("sid").agg(*[F.first(c).alias(c) for c in ("own_d", "own_spare", "cross_d", "cross_spare")])
    rows = per_segment.join(info, "sid")
    has_deletions = F.col("seg") < F.when(F.col("cross"), F.col("cross_d")).otherwise(F.col("own_d"))
    # A unit of tolerance by deletion needs the exact look-up too, so it costs no less.
    exact = F.struct(F.col("e_cost").alias("cost"), F.lit(0).alias("kind"), F.col("e_sigs").alias("sigs"))
    deletion = F.struct(F.greatest("e_cost", "d_cost").alias("cost"), F.lit(1).alias("kind"), F.col("d_sigs").alias("sigs"))
    units = F.filter(F.array(F.when(F.col("e_cost").isNotNull(), exact), F.when(has_deletions, deletion)), lambda x: x.isNotNull())
    rows = rows.select("sid", "cross", "seg", F.when(F.col("cross"), F.col("cross_spare")).otherwise(F.col("own_spare")).alias("spare"),
                       F.explode(units).alias("unit")).select("sid", "cross", "seg", "spare", "unit.*")
    key = Window.partitionBy("sid", "cross")
    ranked = (rows.withColumn("shared", F.count(F.lit(1)).over(key))
                  .withColumn("rank", F.row_number().over(key.orderBy("cost", "seg", "kind"))))
    return (ranked.where(F.col("rank") <= F.col("shared") - F.col("spare"))
                  .select("sid", F.explode("sigs").alias("sig")).distinct())


def _verified(pairs: DataFrame, shingles: DataFrame, t: int, salt_rows: int = 2000) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold; sets often in ``b`` are salted."""
    # The pairs are two ids a row: while they are few, the sets stay where they
    # are until they meet by b; beyond the bound everything is shuffled.
    often = materialize(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / salt_rows).cast("int").alias("salts")), "often")
    tagged = materialize(pairs.join(often, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt")), "tagged")
    right = (shingles.select(F.col("sid").alias("b"), "shingles").join(maybe_broadcast(often), "b")
                     .select("b", F.col("shingles").alias("sb"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")))
    left = shingles.select(F.col("sid").alias("a"), F.col("shingles").alias("sa")).join(maybe_broadcast(tagged), "a")
    both = left.join(right, ["b", "salt"])
    na, nb = F.size("sa"), F.size("sb")
    close = 100 * F.least(na, nb) >= t * F.greatest(na, nb)
    common = F.size(F.array_intersect("sa", "sb"))
    linked = F.when(close, 100 * common >= t * (na + nb - common)).otherwise(False)
    return both.where(linked).select("a", "b")


def _bits_apart(p: str, q: str) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)


def _hub_pairs(known: DataFrame, shingles: DataFrame, t: int, step: int) -> DataFrame:
    """(a, b): for every set the likeliest linked of its signatures' hubs in other
    components, if its parity map leaves a link possible.

    A signature's hub is its first indexed set in the step's order.  The hubs
    of most of a set's signatures are compared: what a common line or an empty
    segment makes sets share is a few of them only.
    """
    order = F.struct(F.xxhash64(F.lit(step), F.col("sid")).alias("h") if step else F.lit(0).alias("h"), F.col("sid"), F.col("component"))
    hubs = (known.groupBy("sig").agg(F.min("component").alias("c0"), F.max("component").alias("c1"),
                                     F.min(F.when(F.col("indexed") == 1, order)).alias("hub"))
                 .where("c0 <> c1").select("sig", F.col("hub.sid").alias("b"), F.col("hub.component").alias("cb")))
    votes = (known.join(hubs, "sig").where((F.col("sid") != F.col("b")) & (F.col("component") != F.col("cb")))
                  .groupBy(F.col("sid").alias("a"), "b").agg(F.count(F.lit(1)).alias("n")))
    most = (votes.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "b")), asc=False), 1, HUBS).alias("hubs"))
                 .select("a", F.explode("hubs.b").alias("b")))
    of = lambda end: shingles.select(F.col("sid").alias(end), F.col("n").alias(f"n{end}"), F.col("parity").alias(f"p{end}"))
    both, differ = F.col("na") + F.col("nb"), _bits_apart("pa", "pb")
    return (most.join(of("a"), "a").join(of("b"), "b").where((100 + t) * differ <= (100 - t) * both)
                .groupBy("a").agg(F.min(F.struct((differ / both).alias("far"), "b"))["b"].alias("b")))


def _cross_shingles(sets: DataFrame, shingles: DataFrame) -> DataFrame:
    """(sid, component, n, shingle, holders): the shingles that several components hold."""
    each = shingles.join(maybe_broadcast(sets.select("sid", "component")), "sid").select("sid", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    holders = (each.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders"), F.min("component").alias("c0"), F.max("component").alias("c1"))
                   .where("c0 <> c1").select("shingle", "holders"))
    # Written, so the count's shuffle is gone when the shingles themselves are shuffled.
    return each.join(materialize(holders, "holders"), "shingle")


def _open_pairs(sets: DataFrame, shingles: DataFrame, t: int, passes: int = 1, step: float = 1.1) -> DataFrame:
    """(a, b, ca, cb, far): pairs of sets of different components that may be
    linked, their components and how far their parity maps are apart.

    A set links to another component only by shingles that component holds
    (``cross`` of its ``n``), and needs ``t`` percent of its own; sets with
    fewer drop out, and with them the shingles only they held.  Sizes are put
    into bins ``step`` apart; for a partner bin a set needs an overlap that
    grows with the partner, so its prefix (its rarest cross shingles) gets
    shorter.  A pair comes out at its first common shingle only: what the
    prefixes hold before it must not meet, and what stands after it on either
    side bounds the overlap.  The sets differ by at least the bits their parity
    maps differ in.
    """
    least = F.ceil(F.col("n") * t / 100)
    for _ in range(passes):
        sets = materialize(_cross_shingles(sets, shingles).groupBy("sid", "component", "n").agg(F.count(F.lit(1)).alias("cross"))
                           .where(F.col("cross") >= least).select("sid", "component"), "open")

    def bin_of(size: Column) -> Column:
        return F.floor(F.log(size.cast("double")) / F.log(F.lit(step)) + 1e-9).cast("int")

    key = Window.partitionBy("sid")
    ranked = (_cross_shingles(sets, shingles).withColumn("cross", F.count(F.lit(1)).over(key))
              .withColumn("rank", F.row_number().over(key.orderBy("holders", "shingle")))
              .where(F.col("rank") <= F.col("cross") - least + 1))
    # A row per set: its prefix for the smallest partner, in order.
    lists = (ranked.groupBy("sid", "component", "n", "cross").agg(F.sort_array(F.collect_list(F.struct("rank", "shingle"))).alias("list"))
                   .select("sid", "component", "n", "cross", F.transform("list", lambda x: x["shingle"]).alias("list")))
    lists = lists.join(shingles.select("sid", "parity"), "sid").withColumn("bin", bin_of(F.col("n")))
    partners = F.sequence(bin_of(least), bin_of(F.floor(F.col("n") * 100 / t)))
    smallest = F.greatest(F.floor(F.pow(F.lit(step), F.col("partner"))), least)
    overlap = F.ceil(t * (F.col("n") + smallest) / (100 + t))
    own = ["sid", "component", "n", "cross", "parity", "bin"]
    prefix = (lists.withColumn("partner", F.explode(partners)).withColumn("most", (F.col("cross") - overlap + 1).cast("int")).where("most > 0")
                   .select(*own, "partner", "list", F.posexplode(F.slice("list", F.lit(1), F.col("most"))).alias("at", "shingle"))
                   .select(*own, "shingle", F.col("at").alias("before"), F.slice("list", F.lit(1), F.col("at")).alias("earlier"),
                           F.least("bin", "partner").alias("low"), F.greatest("bin", "partner").alias("high")))
    prefix = materialize(prefix, "prefixes")
    x, y = prefix.alias("x"), prefix.alias("y")
    same = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.low") == F.col("y.low")) & (F.col("x.high") == F.col("y.high"))
    both = F.col("x.n") + F.col("y.n")
    most = F.least(F.col("x.cross") - F.col("x.before"), F.col("y.cross") - F.col("y.before"))
    differ = _bits_apart("x.parity", "y.parity")
    close = ((100 + t) * most >= t * both) & ((100 + t) * differ <= (100 - t) * both) & ~F.arrays_overlap("x.earlier", "y.earlier")
    # Each is the other's partner.  Both sides have the same keys and columns, so their rows are shuffled once.
    meant = F.col("x.bin") + F.col("y.bin") == F.col("x.low") + F.col("x.high")
    return (x.join(y, same).where((F.col("x.sid") < F.col("y.sid")) & (F.col("x.component") != F.col("y.component")) & close & meant)
             .select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), F.col("x.component").alias("ca"), F.col("y.component").alias("cb"),
                     (differ / both).alias("far")).distinct())


def _merged(component: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after further links: only the components themselves
    are linked, once a pair, however many links their members have."""
    if component is None:
        return connected_components(links).select("node", "component")
    of = lambda end, name: component.select(F.col("node").alias(end), F.col("component").alias(name))
    edges = (links.select("a", "b").join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left")
                  .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct())
    joined = connected_components(materialize(edges, "contracted"))
    # A component's name is its smallest node, so new names keep to that.
    new = joined.select("node", F.col("node").alias("component")).join(component.select("node"), "node", "left_anti")
    named = joined.select(F.col("node").alias("component"), F.col("component").alias("name"))
    return materialize(component.unionByName(new).join(named, "component", "left")
                                .select("node", F.coalesce("name", "component").alias("component")), "merged")


def _between(pairs: DataFrame, component: DataFrame | None) -> DataFrame:
    """The pairs whose ends are still in different components, with these as ``ca`` and ``cb``."""
    if component is None:
        return pairs
    of = lambda end, name: component.select(F.col("node").alias(end), F.col("component").alias(name))
    return (pairs.drop("ca", "cb").join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left")
                 .withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b")).where("ca <> cb"))


def _likeliest(pairs: DataFrame) -> DataFrame:
    """(a, b): of the pairs between each two components the one likeliest linked."""
    return (pairs.groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(F.min(F.struct("far", "a", "b")).alias("best"))
                 .select("best.a", "best.b"))


def similar_sets(docs: DataFrame, text: str = "text", width: int = 4, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(sets, components): a row per document with its set, and (sid, component)
    for every set that shares a link with another."""
    bands = Bands(threshold)
    source = docs.select(F.col(text).alias("text"), F.col("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    sets = materialize(source.mapInArrow(
        _set_rows(width, bands), f"doc_id {id_type}, text_hash bigint, n_shingles bigint, sid bigint, "
        "own_d bigint, own_spare bigint, cross_d bigint, cross_spare bigint"), "sets")

    emitted = source.select("text").mapInArrow(_signature_rows(width, bands), "sig bigint, who bigint")
    # Written, so the shuffles of the count are gone when the rows themselves are shuffled.
    shared = materialize(emitted.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    hits = materialize(emitted.join(shared, "sig").select(
        "sig", "n", F.col("who").bitwiseAND(~7).alias("sid"), (F.col("who").bitwiseAND(1) == 1).alias("cross"),
        (F.col("who").bitwiseAND(2) == 2).alias("deleted"),
        F.col("sig").bitwiseAND((1 << SEG_BITS) - 1).alias("seg")), "hits")

    probes = materialize(_probes(hits, sets.where("n_shingles > 0")), "probes")
    index = (hits.where(~F.col("cross")).select("sig", "sid")
                 .join(probes.select("sig").distinct(), "sig", "left_semi"))
    members = (index.select("sig", "sid", F.lit(1).alias("i"), F.lit(0).alias("p"))
                    .union(probes.select("sig", "sid", F.lit(0), F.lit(1)))
                    .groupBy("sig", "sid").agg(F.max("i").alias("indexed"), F.max("p").alias("probing")))
    groups = members.groupBy("sig").agg(F.count(F.lit(1)).alias("k"), F.max("indexed").alias("i")).where("k > 1 and i = 1").select("sig")
    members = materialize(members.join(groups, "sig", "left_semi"), "members")

    # Shingles of the sets to verify, from one document of each set.
    wanted = members.select("sid").distinct()
    keys = (sets.join(wanted, "sid", "left_semi").groupBy("sid")
                .agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.*"))
    keys = keys.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    chosen = source.join(maybe_broadcast(keys), F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_hash").eqNullSafe(F.col("_hash")), "left_semi")
    shingles = materialize(chosen.select("text").mapInArrow(_shingle_rows(width), "sid bigint, shingles array<bigint>, parity array<bigint>")
                                 .dropDuplicates(["sid"]).withColumn("n", F.size("shingles")), "shingles")

    component = None

    def known() -> DataFrame:
        if component is None:
            return members.withColumn("component", F.col("sid"))
        return (members.join(component.withColumnRenamed("node", "sid"), "sid", "left")
                       .withColumn("component", F.coalesce("component", "sid")))

    def verify(pairs: DataFrame) -> None:
        nonlocal component
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            return
        found = materialize(_verified(pairs, shingles, threshold), "links")
        if not found.isEmpty():
            component = _merged(component, found)

    for step in range(ROUNDS):
        verify(_hub_pairs(known(), shingles, threshold, step))
    crossed = known().groupBy("sig").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("sig")
    held = known().join(crossed, "sig", "left_semi").select("sid", "component").distinct()
    pairs = materialize(_open_pairs(materialize(held, "held"), shingles, threshold), "open_pairs")
    # First the likeliest pair of each two components; those that this merges need no more.
    if not pairs.isEmpty():
        chosen = materialize(_likeliest(pairs), "likeliest")
        verify(chosen)
        verify(_between(pairs, component).join(chosen, ["a", "b"], "left_anti").select("a", "b"))
    if component is None:
        component = members.where("false").select(F.col("sid").alias("node"), F.col("sid").alias("component"))
    return sets, component.select(F.col("node").alias("sid"), "component")


def components(docs: DataFrame, text: str = "text", width: int = 4, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id of every row."""
    sets, component = similar_sets(docs, text, width, threshold)
    classes = (sets.where("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("first_id"))
                   .join(component, "sid", "left").withColumn("component", F.coalesce("component", "sid")))
    lowest = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = classes.join(lowest, "component").select("sid", "component_id")
    return (sets.join(known, "sid", "left")
                .select("doc_id", "text_hash", "n_shingles",
                        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def keep_first(docs: DataFrame, text: str = "text", width: int = 4, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (all columns) with one document left of each component.

    The document with the smallest doc_id stays; rows that repeat its doc_id
    and text stay with it, and a component without any doc_id stays whole.
    """
    found = materialize(components(docs, text, width, threshold), "components")
    key, digest = unused_name(docs.columns, "gone_id"), unused_name(docs.columns, "gone_hash")
    gone = (found.where(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id")))
                 .select(F.col("doc_id").alias(key), F.col("text_hash").alias(digest)).distinct())
    return docs.join(maybe_broadcast(gone), F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64(F.col(text)) == F.col(digest)), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: set size and component of all documents."""
    return components(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
