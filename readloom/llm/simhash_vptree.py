"""SimHash near-duplicates (operator 2): vantage-point-tree shards and exact pairs within a Hamming radius.

1. ``fingerprints``: one 64-bit SimHash a document, over word shingles (no shuffle).
2. Distinct fingerprints begin as one shard. A shard that holds too many is divided by a vantage-point
   tree fitted on a bounded sample of its own; shards that are still too large are divided again in the
   same way, so the tree grows with the data and no part of it is collected or broadcast. Every
   fingerprint has one home shard; it is also sent to each shard that the triangle bound can't exclude
   (|d(x, vantage point) - border| within the radius), so a pair within the radius always meets in
   the home shard of either one.
3. Within a shard, pairs are compared only where their distances to two local vantage points differ by
   at most the radius. A shard passes on a spanning forest of its links, never all pairs.
4. A ball that no sphere divides (every border would copy most of it to both sides) is linked exactly in
   another way, linear in its size: two fingerprints within 2 bits share a neighbour at distance 1
   or less, so 65 keys each and a grouped minimum connect them.
5. Links make components (see components.py); every document gets its component's least id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import as_bytes, free_name, slices, written
from readloom.llm.components import connected_components

SEED = 42
#: Fingerprints that the tree of one shard is fitted on, at most about so many.
TREE_SAMPLE = 65_536
#: Home fingerprints that a shard should hold, and the most that are compared within one task.
LEAF_HOME, LEAF_MOST = 8_192, 65_536
#: Vantage points that are tried for a node; the one whose distances spread most is taken.
TRIALS = 8
#: A border isn't drawn where it would copy more than this share to both sides.
MOST_COPIED = 0.75
#: Near copies of the stage: words of a shingle, least similarity in fifths, bands of so many MinHash values, rounds of representatives.
NEAR_SHINGLE, NEAR_FIFTHS, BANDS, BAND_ROWS, ROUNDS = 5, 4, 20, 5, 4
#: One of so many texts is counted for the order of shingles; those in so many counted ones come last, of so many the count is known.
#: Any order gives the same links; a better one compares fewer texts.
COUNTED, FREQUENT, MOST_FREQUENT = 16, 3, 262_144
#: Bytes of text of the stage that a task works on at once.
BATCH = 2 << 20

_LANES = np.zeros((256, 2), np.uint64)
for _b in range(256):
    for _i in range(8):
        if _b >> _i & 1:
            _LANES[_b, _i // 4] |= np.uint64(1 << 16 * (_i % 4))


def shingle_hashes(words: list[bytes], k: int) -> list[int]:
    """XXH64 of each run of k words joined by spaces; fewer words: of all of them; none: nothing."""
    if not words:
        return []
    text = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(text, SEED)]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(text[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())]


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of ``counts`` hashes: the bits set in over half of them; none: zero."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    # 16-bit lanes are summed, so runs are cut before a lane can overflow
    cuts = [np.arange(s, s + c, 65_535) for s, c in zip(starts.tolist(), n.tolist())] if n.max() > 65_535 else None
    at = starts if cuts is None else np.concatenate(cuts)
    octets = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    sums = np.empty((len(at), 64), np.int64)
    for j in range(8):
        for half in range(2):
            lanes = np.add.reduceat(_LANES[:, half][octets[:, j]], at)
            for i in range(4):
                sums[:, 8 * j + 4 * half + i] = (lanes >> np.uint64(16 * i)) & np.uint64(0xFFFF)
    if cuts is not None:
        sums = np.add.reduceat(sums, np.concatenate([[0], np.cumsum([len(c) for c in cuts])[:-1]]))
    out[full] = np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def text_fingerprints(texts: list[bytes | None], k: int) -> np.ndarray:
    found = [shingle_hashes((t or b"").lower().split(), k) for t in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((h for x in found for h in x), np.uint64, int(counts.sum()))
    return majorities(flat, counts)


def _mixed(x: np.ndarray, i: int) -> np.ndarray:
    """Hash values as another hash function, number i, would give them (the finaliser of SplitMix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def with_fingerprint(docs: DataFrame, text_col: str = "text", k: int = 3, name: str = "fingerprint") -> DataFrame:
    """``docs`` and a long column: the 64-bit SimHash of the text's k-word shingles, as a signed number.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. Null, empty and blank
    texts have fingerprint 0. A column of ``docs`` with that name gives way. No shuffle.
    """
    docs = docs.drop(name)
    at = docs.columns.index(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 8 << 20):
            prints = text_fingerprints(as_bytes(batch.column(at)), k).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


# --- the tree -------------------------------------------------------------------------------------


def fit_tree(sample: np.ndarray, leaf_size: int, radius: int = 2) -> dict[str, np.ndarray]:
    """Nodes: vantage point, border (inside: distance <= border), and children; ~leaf for leaves."""
    points, borders, kids, leaves = [], [], [], 0
    rng = np.random.default_rng(SEED)

    def grow(part: np.ndarray) -> int:
        nonlocal leaves
        if len(part) > leaf_size:
            tried = part[rng.integers(len(part), size=TRIALS)]
            spread = [np.bitwise_count(part[:4096] ^ v).astype(float).std() for v in tried]
            vantage = tried[int(np.argmax(spread))]
            d = np.bitwise_count(part ^ vantage).astype(np.int64)
            border = int(np.median(d))
            if d.max() <= border:
                border -= 1
            inside = d <= border
            copied = ((d > border - radius) & (d <= border + radius)).mean()
            if 0 < inside.sum() < len(part) and copied <= MOST_COPIED:
                node = len(points)
                points.append(vantage)
                borders.append(border)
                kids.append([0, 0])
                kids[node] = [grow(part[inside]), grow(part[~inside])]
                return node
        leaves += 1
        return -leaves

    root = grow(np.unique(sample))
    return {
        "points": np.array(points, np.uint64),
        "borders": np.array(borders, np.int64),
        "kids": np.array(kids, np.int64).reshape(-1, 2),
        "root": np.int64(root),
        "leaves": np.int64(leaves),
    }


def tree_bytes(tree: dict[str, np.ndarray]) -> bytes:
    parts = [np.array([len(tree["points"]), tree["root"], tree["leaves"]]), tree["points"].view(np.int64), tree["borders"], tree["kids"].ravel()]
    return np.concatenate(parts).astype(np.int64).tobytes()


def tree_of(stored: bytes) -> dict[str, np.ndarray]:
    x = np.frombuffer(stored, np.int64)
    n = int(x[0])
    points, borders, kids = np.split(x[3:], [n, 2 * n])
    return {"points": points.view(np.uint64), "borders": borders, "kids": kids.reshape(-1, 2), "root": x[1], "leaves": x[2]}


def route(tree: dict[str, np.ndarray], prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for every leaf that may hold something within ``radius``; radius 0: the home leaf."""
    row, node = np.arange(len(prints)), np.full(len(prints), tree["root"])
    done_row, done_leaf = [], []
    while len(row):
        leaf = node < 0
        done_row.append(row[leaf])
        done_leaf.append(~node[leaf])
        row, node = row[~leaf], node[~leaf]
        if not len(row):
            break
        d = np.bitwise_count(prints[row] ^ tree["points"][node]).astype(np.int64)
        inside, outside = d - radius <= tree["borders"][node], d + radius > tree["borders"][node]
        row, node = (
            np.concatenate([row[inside], row[outside]]),
            np.concatenate([tree["kids"][node[inside], 0], tree["kids"][node[outside], 1]]),
        )
    return np.concatenate(done_row), np.concatenate(done_leaf)


def links_within(home: np.ndarray, all_: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (home, other) with 1 to ``radius`` differing bits, pruned by two local vantage points."""
    if not len(home):
        return home, home
    p = home[0]
    q = all_[np.argmax(np.bitwise_count(all_ ^ p))]
    keys = [np.bitwise_count(x ^ p).astype(np.int64) * 65 + np.bitwise_count(x ^ q) for x in (home, all_)]
    (hk, ho), (ak, ao) = [(k[o := np.argsort(k, kind="stable")], o) for k in keys]
    left, right = [], []
    cells, first, size = np.unique(hk, return_index=True, return_counts=True)
    for cell, at, n in zip(cells.tolist(), first.tolist(), size.tolist()):
        near = []
        for step in range(-radius, radius + 1):  # one stretch of keys for each distance to p
            low = cell + 65 * step
            a, b = np.searchsorted(ak, [low - radius, low + radius + 1])
            near.append(ao[a:b])
        others, own = all_[np.concatenate(near)], home[ho[at : at + n]]
        block = max(1, (1 << 21) // max(1, len(others)))
        for s in range(0, n, block):
            i, j = np.nonzero(np.bitwise_count(own[s : s + block, None] ^ others[None]) <= radius)
            i = i + s
            apart = own[i] != others[j]
            left.append(own[i[apart]])
            right.append(others[j[apart]])
    return np.concatenate(left), np.concatenate(right)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of the links a-b."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of links a-b that connect what all of them connect, without a cycle."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[: len(a)], flat[len(a) :]
    label, taken = np.arange(len(nodes)), []
    while len(apart := np.flatnonzero(label[i] != label[j])):
        first = np.full(len(nodes), len(a))  # each component takes its first link to another one
        np.minimum.at(first, label[i[apart]], apart)
        np.minimum.at(first, label[j[apart]], apart)
        new = np.unique(first[first < len(a)])
        taken.append(new)
        own, root = forest(label[i[new]], label[j[new]])
        to = np.arange(len(nodes))
        to[own] = root
        label = to[label]
    return np.sort(np.concatenate(taken)) if taken else np.empty(0, np.int64)


def divided(rows: DataFrame, large: DataFrame, radius: int, leaf_home: int, leaf_most: int) -> tuple[DataFrame, DataFrame]:
    """Rows (leaf, print, node, home) of the ``large`` shards (leaf, n, homes), in smaller shards, and those of undivided ones.

    The tree of a shard is fitted in one task on a bounded sample of it. A shard's rows are dealt over
    as many tasks as its size asks for; each of them reads the tree first and then lets its rows pass.
    """
    salts = F.greatest(F.ceil(F.col("n") / leaf_most), F.lit(1)).cast("long")
    inside = rows.join(large.withColumn("salts", salts), "leaf")
    rate = F.least(F.lit(1.0), F.lit(float(TREE_SAMPLE)) / F.col("homes"))
    drawn = inside.filter(F.col("home") & (F.pmod(F.xxhash64("print", "leaf"), F.lit(1 << 20)) <= rate * (1 << 20)))

    def fit(key: tuple, group: pa.Table) -> pa.Table:
        x = group.column("print").to_numpy().view(np.uint64)
        tree = fit_tree(x, max(8, int(len(x) * leaf_home / key[2].as_py())), radius)
        return pa.table({"leaf": [key[0].as_py()], "salts": [key[1].as_py()], "leaves": [int(tree["leaves"])], "tree": [tree_bytes(tree)]})

    trees = written(drawn.groupBy("leaf", "salts", "homes").applyInArrow(fit, "leaf long, salts long, leaves long, tree binary"), "trees")
    good = trees.filter("leaves > 1")
    heads = good.select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "tree")
    heads = heads.select("*", F.lit(0).cast("long").alias("print"), F.lit(0).cast("long").alias("node"), F.lit(False).alias("home"))
    tails = inside.join(good.select("leaf"), "leaf", "left_semi")
    tails = tails.select("leaf", F.pmod(F.xxhash64("print"), F.col("salts")).alias("salt"), F.lit(None).cast("binary").alias("tree"), "print", "node", "home")

    def pass_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            head = batch.column("tree").is_valid().to_numpy(zero_copy_only=False)
            edges = [0, *np.flatnonzero(head).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a < b and head[a]:
                    tree, a = tree_of(batch.column("tree")[a].as_py()), a + 1
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                x = part.column("print").to_numpy().view(np.uint64)
                own = np.empty(len(x), np.int64)
                row, leaf = route(tree, x, 0)
                own[row] = leaf
                row, leaf = route(tree, x, radius)
                # a shard's name is a mix of its parent's and its number there
                name = _mixed(part.column("leaf").to_numpy()[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + leaf.astype(np.uint64), 1)
                home = part.column("home").to_numpy(zero_copy_only=False)[row] & (own[row] == leaf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), pa.array(x[row].view(np.int64)), part.column("node").take(pa.array(row)), pa.array(home)],
                    ["leaf", "print", "node", "home"],
                )

    stream = heads.unionByName(tails).repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", F.col("tree").isNull())
    solid = inside.join(trees.filter("leaves = 1").select("leaf"), "leaf", "left_semi").select("print", "node").distinct()
    return written(stream.mapInArrow(pass_, "leaf long, print long, node long, home boolean"), "shards"), solid


def hamming_links(prints: DataFrame, radius: int = 2, leaf_home: int = LEAF_HOME, leaf_most: int = LEAF_MOST) -> DataFrame:
    """Links (a, b) of nodes that connect what the pairs within ``radius`` bits connect.

    ``prints``: (fingerprint, node) rows, already written down, with one row for each distinct
    fingerprint. The result is a spanning forest of each shard's links, each within the radius: it has
    the same components as all pairs together.
    """
    if radius > 2:
        raise ValueError("undivided balls are linked through 1-bit neighbours, which covers a radius of 2 at most")
    rows = prints.select(F.lit(0).cast("long").alias("leaf"), F.col("fingerprint").alias("print"), "node", F.lit(True).alias("home"))

    def compare(group: pa.Table) -> pa.Table:
        x, home = group.column("print").to_numpy().view(np.uint64), group.column("home").to_numpy()
        order = np.argsort(x)
        node = group.column("node").to_numpy()[order]
        a, b = links_within(x[home], x, radius)
        kept = spanning(a, b)
        own, other = (np.searchsorted(x, v[kept], sorter=order) for v in (a, b))
        return pa.table({"a": node[own], "b": node[other]})

    links, most = [], leaf_home
    while True:
        sizes = rows.groupBy("leaf").agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
        large = written(sizes.filter(F.col("homes") > most), "sizes")
        done = large.isEmpty()
        ready = rows if done else rows.join(large, "leaf", "left_anti")
        links.append(ready.groupBy("leaf").applyInArrow(compare, "a long, b long"))
        if done:
            break
        rows, solid = divided(rows, large, radius, leaf_home, leaf_most)
        links.append(ball_links(solid, radius))
        most = leaf_most
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out


def ball_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) that connect what pairs within ``radius`` (2 at most) bits connect, through neighbours at 1 bit."""
    keys = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)])
    near = prints.select("print", "node", F.explode(keys).alias("bit"))
    near = near.select("print", "node", F.col("print").bitwiseXOR(F.col("bit")).alias("key"))
    least = near.groupBy("key").agg(F.min(F.struct("print", "node")).alias("x"))
    wide = near.join(least, "key").filter(F.col("print") != F.col("x.print"))
    if radius < 2:
        wide = wide.filter(F.bit_count(F.col("print").bitwiseXOR(F.col("x.print"))) <= radius)
    return wide.select(F.col("node").alias("a"), F.col("x.node").alias("b"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 2
) -> DataFrame:
    """(id, fingerprint long, component_id) for every row of ``docs``.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; component_id is the least id
    that links reach. Repeated rows stay and share a component; rows with a null id take part, and
    their component_id is null only where no row of the component has an id. Null, empty and blank
    texts have fingerprint 0, linked like any other. An empty table gives an empty one. Other columns
    are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = written(with_fingerprint(rows, "text", k).select("id", "fingerprint"), "fingerprints")
    return components_of(rows, radius).withColumnRenamed("id", id_col)


def roots_of(rows: DataFrame, radius: int = 2) -> DataFrame:
    """(fingerprint, root): the component of each distinct fingerprint of ``rows``, by its least member."""
    prints = written(rows.select("fingerprint").distinct(), "prints")
    links = hamming_links(prints.select("fingerprint", F.col("fingerprint").alias("node")), radius)
    placed = prints.join(connected_components(links).withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    return written(placed.withColumn("root", F.coalesce("root", "fingerprint")), "roots")


def components_of(rows: DataFrame, radius: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) from (id, fingerprint) rows that are already written down."""
    roots = roots_of(rows, radius)
    least = rows.groupBy("fingerprint").agg(F.min("id").alias("least")).join(roots, "fingerprint")
    firsts = least.groupBy("root").agg(F.min("least").alias("component_id"))
    found = roots.join(firsts, "root").select("fingerprint", "component_id")
    return rows.join(found, "fingerprint").select("id", "fingerprint", "component_id")


# --- near copies of a lower similarity ------------------------------------------------------------


def prints_and_bands(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """A SimHash of the five-word shingles of each text, and BANDS keys of its MinHash values (0 without words).

    Two texts of Jaccard similarity J share a key of some band with chance 1 - (1 - J^5)^20, whatever their
    length and wherever they differ: 0.9996 at 0.8.
    """
    found = [shingle_hashes((t or b"").lower().split(), NEAR_SHINGLE) for t in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    full = np.flatnonzero(counts)
    flat = np.fromiter((h for x in found for h in x), np.uint64, int(counts.sum()))
    keys = np.zeros((len(texts), BANDS), np.uint64)
    if len(full):
        starts = np.cumsum(counts[full]) - counts[full]
        draws = np.random.default_rng(SEED).integers(1 << 64, size=(BANDS * BAND_ROWS, 2), dtype=np.uint64)
        for band in range(BANDS):
            key = np.full(len(full), band, np.uint64)
            for a, b in draws[band * BAND_ROWS : (band + 1) * BAND_ROWS]:
                key = _mixed(key ^ np.minimum.reduceat(flat * (a | np.uint64(1)) + b, starts), 0)
            keys[full, band] = key
    return majorities(flat, counts), keys


def alike(a: bytes | None, b: bytes | None, sets: dict | None = None) -> bool:
    """Whether two texts share four fifths or more of the five-word shingles of both; texts without words don't."""
    sets = {} if sets is None else sets
    for t in (a, b):
        if t not in sets:
            sets[t] = set(shingle_hashes((t or b"").lower().split(), NEAR_SHINGLE))
    x, y = sets[a], sets[b]
    both = len(x & y)
    return both > 0 and 5 * both >= NEAR_FIFTHS * (len(x) + len(y) - both)


def judged(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, near) for distinct (a, b) pairs of nodes; near: their ``texts`` (node, text) are ``alike``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "ta", BATCH), "tb", BATCH):
            sets: dict = {}
            near = [alike(x, y, sets) for x, y in zip(as_bytes(batch.column("ta")), as_bytes(batch.column("tb")))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, pa.bool_())], ["a", "b", "near"])

    full = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    return written(full.mapInArrow(run, "a long, b long, near boolean"), "judged")


def similar_links(classes: DataFrame, texts_of, radius: int = 2) -> DataFrame:
    """Links (a, b) between nodes whose texts are ``alike``, each of them verified.

    ``classes``: (node, print, keys) rows, already written down, one for each distinct text; ``texts_of``
    gives (node, text) for a table of nodes. Candidates are what the fingerprint tree links, and texts
    that share a band's key with a representative of it: of even bands the one that shares most keys, of odd
    bands one drawn by its hash. Texts unlike it get another representative, at last under keys that one
    and two more bands refine, which part them from texts that are only somewhat alike. These links join most
    of what is alike in few comparisons; ``rest_links`` gives what they leave apart.
    """
    prints = written(classes.groupBy(F.col("print").alias("fingerprint")).agg(F.min("node").alias("node"), F.count("*").alias("n")), "prints")
    same = classes.withColumnRenamed("node", "a").join(prints.filter("n > 1"), classes["print"] == prints["fingerprint"])
    close = same.select("a", F.col("node").alias("b")).filter("a <> b").union(hamming_links(prints.select("fingerprint", "node"), radius))

    bands = classes.select("node", F.posexplode("keys").alias("band", "key")).filter("key <> 0")
    shared = bands.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    left = written(bands.join(shared, ["band", "key"]), "bands")
    weight = left.groupBy("node").agg(F.sum("n").alias("weight"))
    left = written(left.drop("n").join(weight, "node"), "bands", replaces=left)
    close = written(close, "close")
    texts = written(texts_of(left.select("node").union(close.select("a")).union(close.select("b")).distinct()), "texts")
    links = judged(close.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), texts).filter("near").select("a", "b")
    met: DataFrame | None = None
    for i in range(ROUNDS):
        if i > 1:  # one more band refines the key
            again = left.join(classes.select("node", "keys"), "node")
            left = again.withColumn("key", F.xxhash64("key", F.element_at("keys", (F.col("band") + (i - 1)) % BANDS + 1))).drop("keys")
        draw = F.xxhash64("node", "band", F.lit(i))
        order = F.struct(F.when(F.col("band") % 2 == 0, -F.col("weight")).otherwise(F.lit(0)).alias("w"), draw.alias("draw"), "node")
        least = left.groupBy("band", "key").agg(F.min(order)["node"].alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
        met = written(left.withColumnRenamed("node", "a").join(least, ["band", "key"]).filter("a <> b"), "met", replaces=met)
        found = judged(met.select("a", "b").distinct(), texts)
        links = links.union(found.filter("near").select("a", "b"))
        left = met.join(found.filter("not near"), ["a", "b"], "left_semi").select("band", "key", F.col("a").alias("node"), "weight")
        if found.filter("not near").isEmpty():
            break
    return links


def shingle_prefix(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of a text's distinct shingles, rare ones first: two texts that are ``alike`` have one of these in common.

    Of n shingles alike texts share four fifths or more, so they can't differ in all of the first n - ceil(4 n / 5) + 1
    in an order that is the same for all texts. ``shingles`` and ``frequent`` (with ``counts``) are sorted.
    """
    n = len(shingles)
    first = n - -(-NEAR_FIFTHS * n // 5) + 1 if n else 0
    if n and len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        count = np.where(frequent[at] == shingles, counts[at], 0)
        if count.any():
            shingles = shingles[np.argsort(count, kind="stable")]
    return shingles[:first]


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The distinct five-word shingles of each text, sorted."""
    return [np.unique(np.array(shingle_hashes((t or b"").lower().split(), NEAR_SHINGLE), np.uint64)) for t in texts]


def frequent_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts), sorted: those that are in several of the (digest, text) rows that are counted, most of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH):
            sets = shingle_sets(as_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["key"])

    counted = texts.filter(F.pmod(F.xxhash64("digest"), F.lit(COUNTED)) == 0).dropDuplicates(["digest"])
    found = counted.select("text").mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT)
    found = found.orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).toPandas()
    keys, counts = found["key"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def rest_links(texts: DataFrame, placed: DataFrame, texts_of) -> DataFrame:
    """Links (a, b) between ``alike`` texts of different components, whatever led to these: none is left out.

    ``texts``: (digest, text) rows; ``placed``: (digest, node, root), one row for each distinct text. Alike texts share
    a shingle of their prefixes (see shingle_prefix). Under such a shingle the texts of its most common component are compared with
    all others, and these with each other, but never two of that component: it is linked already. A pair of
    which too few shingles are left after the one they share isn't compared.
    """
    sent = texts.sparkSession.sparkContext.broadcast(frequent_shingles(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH):
            sets = shingle_sets(as_bytes(batch.column("text")))
            firsts = [shingle_prefix(x, *sent.value) for x in sets]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in firsts])]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(firsts).view(np.int64)))
            sizes = pa.array([len(x) for x in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), sizes, listed], ["digest", "size", "keys"])

    # copies have one prefix
    firsts = texts.mapInArrow(run, "digest binary, size int, keys array<long>").groupBy("digest").agg(F.first("size").alias("size"), F.first("keys").alias("keys"))
    rows = firsts.join(placed, "digest").select("node", "root", "size", F.posexplode("keys").alias("at", "key"))
    own = Window.partitionBy("key")  # one exchange, where a grouping and a join would take two
    rows = rows.withColumn("low", F.min("root").over(own)).withColumn("high", F.max("root").over(own))
    rows = written(rows.filter("low <> high").drop("low", "high"), "prefixes")
    common = rows.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("common"))
    minor = rows.join(common, "key").filter("root <> common").select("key", *[F.col(c).alias(f"{c}_a") for c in ("node", "root", "size", "at")])
    both = F.col("size") + F.col("size_a")
    most = F.least(F.col("size") - F.col("at"), F.col("size_a") - F.col("at_a"))  # shared ones, this one and those after it
    enough = (5 + NEAR_FIFTHS) * most >= NEAR_FIFTHS * both
    near_size = 5 * F.least("size", "size_a") >= NEAR_FIFTHS * F.greatest("size", "size_a")
    met = minor.join(rows, "key").filter((F.col("root") != F.col("root_a")) & near_size & enough)
    pairs = written(met.select(F.greatest("node", "node_a").alias("a"), F.least("node", "node_a").alias("b")).distinct(), "pairs")
    wanted = written(texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()), "texts")
    return judged(pairs, wanted).filter("near").select("a", "b")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each group of near duplicates is kept: the one with the least id.

    Rows are linked if their texts are equal, or ``alike``: of the five-word shingles of both, four fifths or
    more are shared (see similar_links and rest_links: every link is verified, none is left out); groups are what links reach. Rows
    with an id come before rows without; equal ids are told apart by a hash of the whole row, and of
    rows that repeat as a whole one stays. Null, empty and blank texts are one group. An empty table
    gives no rows. All columns stay, whatever their names.
    """
    row_col = free_name("_row", docs.columns)
    hashed = docs.withColumn(row_col, F.xxhash64(*docs.columns))
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.md5(F.when(text.rlike("[^ \\t-\\r]"), text).otherwise("").cast("binary")))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH):
            prints, keys = prints_and_bands(as_bytes(batch.column("text")))
            offsets = np.arange(len(prints) + 1, dtype=np.int32) * BANDS
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).ravel()))
            kept = [batch.column(c) for c in ("id", "row", "digest")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(prints.view(np.int64)), listed], ["id", "row", "digest", "print", "keys"])

    rows = hashed.select(F.col(id_col).alias("id"), F.col(row_col).alias("row"), digest.alias("digest"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = written(rows.mapInArrow(prepare, f"id {kind}, row long, digest binary, print long, keys array<long>"), "fingerprints")
    # one row for each distinct text: what is known of it, and the first of its rows
    first = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "row")).alias("first")
    classes = rows.groupBy("digest").agg(first, F.first("print").alias("print"), F.first("keys").alias("keys"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    def texts_of(nodes: DataFrame) -> DataFrame:
        wanted = classes.select("node", "digest").join(nodes, "node", "left_semi")
        return docs.select(digest.alias("digest"), F.col(text_col).alias("text")).join(wanted, "digest").groupBy("node").agg(F.first("text").alias("text"))

    found = connected_components(similar_links(classes.select("node", "print", "keys"), texts_of, radius))
    placed = classes.select("digest", "node").join(found, "node", "left").select("digest", "node", F.coalesce("root", "node").alias("root"))
    rest = rest_links(docs.select(digest.alias("digest"), F.col(text_col).alias("text")), written(placed, "placed"), texts_of)
    if not rest.isEmpty():
        found = connected_components(found.toDF("a", "b").union(rest))
    placed = classes.select("node", "first").join(found, "node", "left")
    kept = placed.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = written(kept.select(F.col("first.id").alias("kept_id"), F.col("first.row").alias("kept_row")), "kept")
    same = (hashed[row_col] == kept["kept_row"]) & hashed[id_col].eqNullSafe(kept["kept_id"])
    out = hashed.join(kept, same, "left_semi")
    repeated = rows.groupBy("id", "row").count().filter("count > 1").select(F.col("row").alias(row_col)).distinct()
    if not repeated.isEmpty():  # only rows that repeat as a whole are brought together
        once = out.join(repeated, row_col, "left_semi").dropDuplicates([row_col, id_col])
        out = out.join(repeated, row_col, "left_anti").unionByName(once)
    return out.drop(row_col)
