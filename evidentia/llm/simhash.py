"""SimHash near-dedup: BK-trees over shards of fingerprints, then connected components.

Fingerprint: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, shingles of `shingle` words joined by spaces (the whole
sequence where there are fewer, none: zero); a bit is 1 where over half of the shingles' XXH64 (seed 42) have it.

Links, fingerprints at `radius` or fewer differing bits, are searched among distinct fingerprints. With the 64 bits in
radius + 2 parts, two linked fingerprints agree on at least two of them; so every fingerprint goes to one shard for
each pair of parts, keyed by their bits, and no link is lost. A shard of more than `SHARD` fingerprints is cut again:
its free bits in radius + 1 parts, of which linked fingerprints agree on one, and so on; since a shard whose
fingerprints have 11 free bits holds 2048 at most, every shard ends within the bound and none is compared with another.
A shard is a BK-tree, children keyed by their distance to the parent; the fingerprints of the shard walk it together
and follow only edges within the radius. Where a shard holds two fingerprints its tree is one edge, read by Spark's own
functions. All trees together grow with the corpus, so a tree is not broadcast: it goes to the one task that holds its
queries. A task emits a spanning forest of its links, never all pairs.

`keep_similar` is for similarities that no small radius reaches. Its fingerprints have 256 bits, of five-word shingles
of folded words; shards are keyed by `BANDS` bands of `ROWS` minimum hashes, in which documents of a Jaccard similarity
of 0.8 meet with a probability of 0.998; the trees find links within a wide radius (such documents differ in 39 bits,
give or take 6), of which the closest that join a shard stay (a minimum spanning forest) and are then confirmed by the
exact similarity of the two documents. Shards beyond `TREE` are dealt into trees of about that size, which share
`PIVOTS` documents. A link that fails may have hidden others, and a dealt shard holds several trees; so what is then still
in different components of a shard is compared by the exact similarity inside the tasks, every pair within the radius until
it is joined: a task emits the links that hold, a forest, and not the pairs that it tried. Large shards meet in blocks, but
for blocks of one component. So no link of a shard within the radius is lost.

Components come from alternating large-star and small-star steps on tables in the shared folder.

Defined results: null texts have no words (fingerprint zero; for `keep_similar` texts without words are all alike);
texts of any length are worked on whole, in slices of 65,536 shingles; repeated rows are copies; where a doc_id is
null its row belongs to its fingerprint's component without naming it; an empty table gives an empty result; other
columns pass through `fingerprints`, except fingerprint itself. Operators that find components run jobs when called.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, sifted, stored
from .decontaminate import split_words

SHARD = 2048


def fingerprint(text: bytes, shingle: int) -> int:
    """As a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # on bytes: A-Z alone, and the white space of the definition
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[k:] for k in range(shingle)]))
    hashes = np.array([xxh64_intdigest(g, 42) for g in grams], "<u8")
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65536):
        part = hashes[a : a + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 5) -> DataFrame:
    """`docs` without its text, with fingerprint (long)."""

    def start():
        return lambda texts: [[fingerprint(t, shingle) for t in texts]]

    return map_texts(docs, text, {"fingerprint": "long"}, start, [c for c in docs.columns if c != text])


class BKTree:
    """Children of a node by their integer Hamming distance to it; values are rows of 64-bit words."""

    def __init__(self, values: np.ndarray):
        self.values = np.ascontiguousarray(values).view("<u8").reshape(len(values), -1)
        self.children: list[dict[int, int]] = []
        width = 8 * self.values.shape[1]
        raw = self.values.tobytes()
        plain = [int.from_bytes(raw[k : k + width], "little") for k in range(0, len(raw), width)]
        for i, x in enumerate(plain):
            self.children.append({})
            node = 0
            while i:
                d = (plain[node] ^ x).bit_count()
                below = self.children[node].get(d)
                if below is None:
                    self.children[node][d] = i
                    break
                node = below

    def search(self, queries: np.ndarray, radius: int):
        """(node, numbers of the queries within the radius of it, their distances), for each node that any query reaches."""
        queries = np.ascontiguousarray(queries).view("<u8").reshape(len(queries), -1)
        stack = [(0, np.arange(len(queries)))] if len(self.values) else []
        while stack:
            node, own = stack.pop()
            d = np.bitwise_count(queries[own] ^ self.values[node]).sum(axis=1, dtype=np.int64)
            near = d <= radius
            if near.any():
                yield node, own[near], d[near]
            for edge, child in self.children[node].items():
                # a value below that edge is within the radius only of queries that differ from it by that much at most
                follow = own[np.abs(d - edge) <= radius]
                if len(follow):
                    stack.append((child, follow))


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Numbers of linked values, enough links to join the components of one tree."""
    label, out = np.arange(len(values)), []
    for node, near, _ in BKTree(values).search(values, radius):
        other = near[label[near] != label[node]]
        if len(other):
            labels, first = np.unique(label[other], return_index=True)
            out += [(node, int(other[k])) for k in first]
            label[np.isin(label, labels)] = label[node]
    return out


def closest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """As `forest`, but the closest links that join the components: a minimum spanning forest."""
    ends: list = [(node, near[near > node], d[near > node]) for node, near, d in BKTree(values).search(values, radius)]
    a = np.concatenate([np.full(len(n), node) for node, n, _ in ends])
    b, apart = np.concatenate([n for _, n, _ in ends]), np.concatenate([d for _, _, d in ends])
    label, out = np.arange(len(values)), []
    for d in np.unique(apart):
        x, y = a[apart == d], b[apart == d]
        while len(x := x[open_ := label[x] != label[y]]):
            y = y[open_]
            # of the links of this length one for each component at a time
            _, first = np.unique(label[x], return_index=True)
            for k in first:
                if label[x[k]] != label[y[k]]:
                    out.append((int(x[k]), int(y[k])))
                    label[label == label[y[k]]] = label[x[k]]
    return out


def _cut(mask: int, parts: int) -> list[int]:
    """`mask` with each of `parts` parts of its free bits."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """(a, b): links between distinct fingerprints of `prints` that join all that belong together."""
    if shard < 2 << radius:
        raise ValueError("a shard must be able to hold every value of its last radius + 1 bits")
    spark = prints.sparkSession
    one = _cut(0, radius + 2)
    masks = [a | b for a, b in combinations(one, 2)]
    own = stored(prints.select("fingerprint").distinct(), "distinct")
    # dealt by number, as fingerprints weigh little until they are multiplied by the shards
    dealt = own.repartition(max(1, own.count() // 20_000))
    keyed = dealt.select("fingerprint", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    pairs, trees = [], []
    while True:
        keyed = keyed.withColumn("key", F.col("fingerprint").bitwiseAND(F.col("mask")))
        large = stored(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > shard), "large").select("mask", "key")
        small = keyed.join(large, ["mask", "key"], "left_anti").groupBy("mask", "key").agg(F.collect_list("fingerprint").alias("tree"))
        pairs.append(small.filter("size(tree) = 2").select(F.col("tree")[0].alias("a"), F.col("tree")[1].alias("b")))
        trees.append(small.filter("size(tree) > 2").select("tree"))
        masks = [m for m in masks if m.bit_count() < 64]
        if not masks or large.isEmpty():
            break
        finer = spark.createDataFrame([(_signed(m), [_signed(x) for x in dict.fromkeys(_cut(m, radius + 1)) if x != m]) for m in masks], "mask long, finer array<long>")
        masks = [*dict.fromkeys(x for m in masks for x in _cut(m, radius + 1) if x != m)]
        rest = keyed.join(large, ["mask", "key"]).join(F.broadcast(finer), "mask")  # at most 10 * 4^7 masks
        keyed = stored(rest.select("fingerprint", F.explode("finer").alias("mask")).distinct(), "finer")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for tree in batch.column(0):
                own = tree.values.to_numpy()
                for x, y in forest(own, radius):
                    a.append(int(own[x]))
                    b.append(int(own[y]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    found = None
    for p, t in zip(pairs, trees, strict=True):
        own = p.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).unionByName(t.mapInArrow(run, "a long, b long"))
        found = own if found is None else found.unionByName(own)
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b): root is the smallest node reachable."""
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    sign = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = sign(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # tables of their own, so that a join's sides are plain exchanges and a hot root's rows can be split
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(least, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = stored(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        after = sign(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of components `found` and further links (a, b), which join their roots."""
    if links.isEmpty():
        return found
    of = lambda d, c: d.join(found.select(F.col("node").alias(c), F.col("root").alias("r")), c, "left").withColumn(c, F.coalesce("r", c)).drop("r")
    roots = stored(components(of(of(links.select("a", "b"), "a"), "b")), "roots")
    up = found.join(roots.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left")
    # a root is no node of its own component, so those that have one now come to the others
    return stored(up.select("node", F.coalesce("up", "root").alias("root")).unionByName(roots), "found")


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (long) and component_id (the smallest doc_id reachable) for each row of `docs`."""
    prints = stored(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", shingle), "prints")
    return _labelled(prints, components(links(prints, radius)))


def _labelled(prints: DataFrame, found: DataFrame) -> DataFrame:
    own = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    rooted = own.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    rooted = stored(rooted, "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = rooted.join(least, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, radius: int = 3) -> DataFrame:
    """One row of each group, as it is: of the smallest doc_id (nulls last), and of rows that share it the one of least hash."""
    prints = stored(fingerprints(_keyed(docs, text, doc_id), "text", shingle), "prints")
    return _first_of_each(docs, doc_id, prints, components(links(prints, radius)))


def _row_key(docs: DataFrame):
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, text and a hash of the whole row as _g_key."""
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), _row_key(docs).alias("_g_key"))


def _first_of_each(docs: DataFrame, doc_id: str, prints: DataFrame, found: DataFrame) -> DataFrame:
    """The row of `docs` that stays of each group; prints: doc_id, _g_key, fingerprint; found: (node, root)."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_g_key"))
    own = prints.groupBy("fingerprint").agg(F.min(rank).alias("least"))
    rooted = own.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    rooted = stored(rooted, "rooted")
    first = stored(rooted.groupBy("root").agg(F.min("least").alias("first")), "first")
    named = stored(rooted.join(first, "root").select("fingerprint", "first"), "firsts")
    out = prints.join(named, "fingerprint").filter(~rank.eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("_g"), F.col("_g_key").alias("_k")).distinct()
    out = stored(out, "out")
    twice = stored(prints.groupBy(F.col("doc_id").alias("_g"), F.col("_g_key").alias("_k")).count().filter("count > 1").select("_g", "_k"), "twice")
    # rows that neither go nor repeat stay where they are
    some, rest = sifted(docs.withColumn("_g_key", _row_key(docs)), F.col("_g_key"), out.select("_k").unionAll(twice.select("_k")))
    same = lambda d: F.col(f"`{doc_id}`").eqNullSafe(d["_g"]) & (F.col("_g_key") == d["_k"])
    left = some.join(out, same(out), "left_anti")
    # equal rows share id and hash: one of them stays
    single, copies = left.join(twice, same(twice), "left_anti"), left.join(twice, same(twice), "left_semi")
    kept = rest.unionByName(single).unionByName(copies.dropDuplicates([doc_id, "_g_key"]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


#: Bands of minimum hashes and the hashes of a band; bits of a wide fingerprint in words of 64; its radius.
BANDS, ROWS, WIDE, WIDE_RADIUS = 16, 5, 4, 72
#: Documents that all trees of a dealt shard share, about.
PIVOTS = 256
#: Documents of a tree of wide fingerprints, whose links a task holds at once.
TREE = 1024
_ODD = (np.arange(1, 1 + BANDS * ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words (multiply and shift)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def shingle_hashes(words: list[bytes], shingle: int, known: dict) -> np.ndarray:
    """Distinct hashes of the shingles, sorted; `known` remembers those of words."""
    from xxhash import xxh64_intdigest

    for w in {*words}.difference(known):
        known[w] = xxh64_intdigest(w)
    h = np.array([*map(known.__getitem__, words)], np.uint64)
    size = min(shingle, len(h))
    if not size:
        return h
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = _mixed(out + h[k : k + n])
    return np.unique(out)


def wide_print(grams: np.ndarray) -> tuple[bytes, list[int]]:
    """A SimHash of 64 * WIDE bits, and the keys of the bands of minimum hashes."""
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    ones = np.zeros(64 * WIDE, np.int64)
    with np.errstate(over="ignore"):
        for a in range(0, len(grams), 4096):
            part = grams[a : a + 4096]
            least = np.minimum(least, ((part[:, None] + _ODD) * _ODD).min(axis=0))
            bits = np.stack([_mixed(part + np.uint64(k)) for k in range(WIDE)], axis=1)
            ones += np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bands = least.reshape(BANDS, ROWS)
        key = np.arange(BANDS, dtype=np.uint64)
        for k in range(ROWS):
            key = _mixed(key + bands[:, k])
    return np.packbits(2 * ones > len(grams), bitorder="little").tobytes(), key.view(np.int64).tolist()


def _known(known: dict) -> dict:
    """The dictionary of words, emptied where it has grown beyond 200,000."""
    if len(known) > 200_000:
        known.clear()
    return known


def shards(prints: DataFrame) -> DataFrame:
    """The stored table (band, fingerprint, n) of distinct wide fingerprints that share a band of minimum hashes with n - 1 others."""
    keyed = prints.groupBy("fingerprint").agg(F.min("bands").alias("bands")).select("fingerprint", F.explode("bands").alias("band"))
    sizes = stored(keyed.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "bands")
    return stored(keyed.join(sizes, "band"), "shards")


def _arrow_links(packed: DataFrame, run) -> DataFrame:
    """(a, b) of run(batches) over `packed`, each pair once and in order."""
    found = packed.mapInArrow(run, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _links_batch(a: list, b: list):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def similar_links(met: DataFrame, radius: int = WIDE_RADIUS, shard: int = SHARD, pivots: int = PIVOTS) -> DataFrame:
    """(a, b): the closest links that join what lies within the radius in a shard; large shards are dealt into trees that share some documents."""
    trees = F.ceil(F.col("n") / shard).cast("int")
    pivot = (F.col("n") > shard) & (F.pmod(F.xxhash64("fingerprint", "band"), F.ceil(F.col("n") / pivots)) == 0)
    dealt = F.when(pivot, F.sequence(F.lit(0), trees - 1)).otherwise(F.array(F.pmod(F.xxhash64("fingerprint"), trees).cast("int")))
    rows = met.select("band", "fingerprint", F.explode(dealt).alias("tree_no"))
    # the same documents meet in many bands: each set of them is searched once
    packed = rows.groupBy("band", "tree_no").agg(F.sort_array(F.collect_list("fingerprint")).alias("tree")).filter("size(tree) > 1").select("tree").distinct()

    def run(batches):
        for batch in batches:
            a, b = [], []
            for tree in batch.column(0):
                names = tree.as_py()
                for x, y in closest(np.frombuffer(b"".join(names), "<u8").reshape(len(names), -1), radius):
                    a.append(names[x])
                    b.append(names[y])
            yield _links_batch(a, b)

    return _arrow_links(packed, run)


def alike(values: np.ndarray, labels: np.ndarray, grams: list[np.ndarray], radius: int, similarity: float) -> list[tuple[int, int]]:
    """Numbers of linked values, enough links to join the labels of one tree: within the radius, and of a Jaccard similarity
    of their `grams` (distinct hashes) of `similarity` or more. Every pair of different labels is compared until they are joined."""
    label, out = labels.copy(), []
    sizes = np.array([len(g) for g in grams], np.int64)
    ids = np.unique(np.concatenate(grams), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(ids) + 1, bool)
    for node, near, _ in BKTree(values).search(values, radius):
        other = near[label[near] != label[node]]
        # sizes alone rule out what is too short or too long
        other = other[np.minimum(sizes[other], sizes[node]) >= similarity * np.maximum(sizes[other], sizes[node])]
        if not len(other):
            continue
        own = ids[starts[node] : starts[node + 1]]
        mark[own] = True
        for a in range(0, len(other), 256):
            part = other[a : a + 256]
            part = part[label[part] != label[node]]
            if not len(part):
                continue
            at = np.concatenate([ids[starts[k] : starts[k + 1]] for k in part])
            shared = np.bincount(np.repeat(np.arange(len(part)), sizes[part]), weights=mark[at], minlength=len(part))
            good = part[shared >= similarity * (sizes[part] + sizes[node] - shared)]
            if len(good):
                found, first = np.unique(label[good], return_index=True)
                out += [(node, int(good[k])) for k in first]
                label[np.isin(label, found)] = label[node]
        mark[own] = False
    return out


def offered(values: np.ndarray, labels: np.ndarray, radius: int, most: int) -> list[tuple[int, int, bool]]:
    """For each value its `most` closest links to values of other labels, and whether it has more of them."""
    out = []
    for node, near, d in BKTree(values).search(values, radius):
        other = labels[near] != labels[node]
        near, d = near[other], d[other]
        more = len(near) > most
        if more:
            first = np.argsort(d, kind="stable")[:most]
            near = near[first]
        out += [(node, int(x), more) for x in near]
    return out


def _in_blocks(rest: DataFrame, half: int) -> DataFrame:
    """(band, x, y, fingerprint, label): the rows of large shards, once for each two blocks x and y that meet; `weight` counts against `half`."""
    sizes = rest.groupBy("band", "label").agg(F.sum("weight").alias("own"))
    pools = sizes.groupBy("band").agg(F.sum(F.when(F.col("own") < half, F.col("own")).otherwise(0)).alias("pooled"))
    sizes = stored(sizes.join(pools, "band"), "sizes")
    pure = F.col("own") >= half
    number = F.when(pure, F.pmod(F.xxhash64("fingerprint"), F.ceil(F.col("own") / half))).otherwise(F.pmod(F.xxhash64("label"), F.greatest(F.lit(1), F.ceil(F.col("pooled") / half))))
    rest = stored(rest.join(sizes, ["band", "label"]).select("band", "fingerprint", "label", F.when(pure, F.col("label")).alias("of"), F.xxhash64(F.when(pure, F.col("label")), number).alias("block")), "blocks")
    blocks = rest.select("band", "block", "of").distinct()
    two = blocks.select("band", F.col("block").alias("other"), F.col("of").alias("other_of"))
    meet = blocks.join(two, "band").filter("block <= other AND NOT coalesce(of = other_of, false)").select("band", "block", "other")
    sides = meet.select("band", "block", "block", "other").toDF("band", "block", "x", "y").unionByName(meet.filter("block < other").select("band", "other", "block", "other").toDF("band", "block", "x", "y"))
    return rest.join(stored(sides, "meet"), ["band", "block"]).select("band", "x", "y", "fingerprint", "label")


def mixed_shards(met: DataFrame, found: DataFrame) -> DataFrame:
    """The stored table (band, fingerprint, label) of the shards that hold several of the components `found` (node, root)."""
    rows = met.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("label", F.xxhash64(F.coalesce("root", "fingerprint")))
    mixed = rows.groupBy("band").agg((F.min("label") != F.max("label")).alias("open")).filter("open").select("band")
    return stored(rows.join(mixed, "band", "left_semi").select("band", "fingerprint", "label"), "open")


#: Hashes of shingles that count as one document against the size of a block, so that a tree has 16 MB of them at most, or two texts.
WEIGHT = 2048


def open_links(rows: DataFrame, grams: DataFrame, similarity: float = 0.8, radius: int = WIDE_RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): links that join the labels of the shards `rows` (band, fingerprint, label), confirmed by the hashes of their shingles.

    grams: (fingerprint, grams binary, size). A task holds the fingerprints and hashes of one tree and compares all pairs of
    different labels within the radius, but emits a forest of the links that hold, not the pairs that it tried. A large
    shard is cut into blocks: components of half a block or more into blocks of their own, the others together; two blocks
    meet in one task unless they are of one component.
    """
    sized = stored(rows.join(grams.select("fingerprint", F.ceil((F.col("size") + 1) / WEIGHT).alias("weight")), "fingerprint"), "sized")
    large = stored(sized.groupBy("band").agg(F.sum("weight").alias("n")).filter(F.col("n") > shard), "large").select("band")
    zero = F.lit(0).cast("long")
    whole = sized.join(large, "band", "left_anti").select("band", zero.alias("x"), zero.alias("y"), "fingerprint", "label")
    if not large.isEmpty():
        whole = whole.unionByName(_in_blocks(sized.join(large, "band", "left_semi"), shard // 2))
    # the same documents meet in many bands: each set of them is searched once, and only then are their hashes fetched
    sets = whole.groupBy("band", "x", "y").agg(F.sort_array(F.collect_list(F.struct("fingerprint", "label"))).alias("tree"), (F.min("label") != F.max("label")).alias("open"))
    sets = stored(sets.filter("open").select("tree").distinct().withColumn("id", F.expr("uuid()")), "sets")
    members = sets.select("id", F.inline("tree")).join(grams.select("fingerprint", "grams"), "fingerprint")
    packed = members.groupBy("id").agg(F.collect_list(F.struct("fingerprint", "label", "grams")).alias("tree")).select("tree")

    def run(batches):
        for batch in batches:
            for tree in batch.column(0):
                names = [x.as_py() for x in tree.values.field("fingerprint")]
                labels = tree.values.field("label").to_numpy()
                own = [np.frombuffer(x.as_buffer(), "<u8") if len(x.as_buffer()) else np.zeros(0, "<u8") for x in tree.values.field("grams")]
                links_ = alike(np.frombuffer(b"".join(names), "<u8").reshape(len(names), -1), labels, own, radius, similarity)
                yield _links_batch([names[x] for x, _ in links_], [names[y] for _, y in links_])

    return _arrow_links(packed, run)


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The pairs (a, b) whose texts (fingerprint, text) have a Jaccard similarity of their shingles of `similarity` or more."""
    one = texts.select(F.col("fingerprint").alias("a"), F.col("text").cast("binary").alias("x"))
    two = texts.select(F.col("fingerprint").alias("b"), F.col("text").cast("binary").alias("y"))

    def run(batches):
        import pyarrow.compute as pc

        known: dict = {}
        for batch in batches:
            last: tuple = (None, None)
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                known = _known(known)
                own = last[1] if last[0] == x else shingle_hashes(split_words(x or b""), shingle, known)
                last = (x, own)
                other = shingle_hashes(split_words(y or b""), shingle, known)
                shared = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(shared >= similarity * (len(own) + len(other) - shared))
            yield batch.select([0, 1]).filter(pc.equal(keep, True)) if keep else batch.select([0, 1])

    met = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return met.mapInArrow(run, "a binary, b binary")


def keep_similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8, shard: int = TREE) -> DataFrame:
    """One row of each group of documents of that similarity, chosen as by `keep_one`, in the columns of `docs`."""

    def start():
        known: dict = {}

        def run(texts):
            out: list[list] = [[], []]
            for t in texts:
                found, bands = wide_print(shingle_hashes(split_words(t), shingle, _known(known)))
                out[0].append(found)
                out[1].append(bands)
            return out

        return run

    keyed = _keyed(docs, text, doc_id)
    prints = stored(map_texts(keyed, "text", {"fingerprint": "binary", "bands": "array<long>"}, start, ["doc_id", "_g_key"]), "prints")
    met = shards(prints)
    pairs = stored(similar_links(met, shard=shard, pivots=max(1, min(PIVOTS, shard // 8))), "pairs")
    good = stored(confirmed(pairs, _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("fingerprint")), prints, keyed), shingle, similarity), "confirmed")
    found = components(good)
    # a link that failed may have hidden longer ones between its components: tasks compare what is left of their shards
    rows = mixed_shards(met, found)
    if not rows.isEmpty():
        found = _joined(found, stored(open_links(rows, _grams_of(rows, prints, keyed, shingle), similarity, shard=shard), "confirmed"))
    return _first_of_each(docs, doc_id, prints, found)


def _grams_of(rows: DataFrame, prints: DataFrame, keyed: DataFrame, shingle: int) -> DataFrame:
    """The stored table (fingerprint, grams, size) of the distinct hashes of the shingles of the fingerprints of `rows`."""

    def start():
        known: dict = {}

        def run(texts):
            made = [shingle_hashes(split_words(t), shingle, _known(known)) for t in texts]
            return [[g.tobytes() for g in made], [len(g) for g in made]]

        return run

    texts = _texts_of(rows.select("fingerprint"), prints, keyed)
    return stored(map_texts(texts, "text", {"grams": "binary", "size": "long"}, start, ["fingerprint"]), "grams")


def _texts_of(ends: DataFrame, prints: DataFrame, keyed: DataFrame) -> DataFrame:
    """The stored texts (fingerprint, text) of the fingerprints `ends`."""
    ends = ends.distinct()
    # one row stands for each fingerprint that has a candidate; its text is looked up by id and row hash
    stand = prints.join(ends, "fingerprint", "left_semi").groupBy("fingerprint").agg(F.min(F.struct("doc_id", "_g_key")).alias("r"))
    stand = stored(stand.select("fingerprint", F.col("r.doc_id").alias("_s_id"), F.col("r._g_key").alias("_s_key")), "stand")
    some, _ = sifted(keyed, F.col("_g_key"), stand.select("_s_key"))
    found = some.join(stand, some["_g_key"] == stand["_s_key"]).filter(F.col("doc_id").eqNullSafe(F.col("_s_id")))
    return stored(found.select("fingerprint", "text").dropDuplicates(["fingerprint"]), "texts")
