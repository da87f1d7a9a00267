"""The SimHash join at a wide radius: texts whose word shingles are alike to 0.8 or more (Jaccard), one of each group kept.

At that likeness some ten of 64 bits differ, and no choice of whole blocks is sure to agree while it still tells texts
apart. So the embedding is longer and the grid is drawn many times over: 256 fingerprint bits give the bit counts of 128
two-bit segments, and each of `tables` grids takes `segments` of them as a cell. A pair at the threshold shares a given
cell with a chance of about 0.73 ** segments, a closer one with a higher chance; test_near_copies measures what is found.

In a cell the Hamming distance of 128 bits, which the Manhattan distance of the counts bounds from below, picks the pairs
within radius; of those only a minimum spanning forest is kept and the links of its trees' centres (of a crowd, those
alone), never all pairs.
Links are then verified exactly: the Jaccard likeness of the two whole texts' sets of shingle hashes (64 bits).
Equal texts are one node, so copies never meet.

What the grids miss by chance, and what hung on a link that verification took away, an exact pass adds. With hashes in one
order, two sets alike to t or more share one of the first |x| - ceil(t |x|) + 1 of each (the prefix): texts meet under
every hash of their prefix, pairs of different groups whose sizes, places in the order and count of shared prefix hashes
leave room for t are verified as above, and what holds joins their groups. The order puts hashes first that are rare in a sample, so that common passages
bring few together; it changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import cut, release
from textloom.llm.components import components
from textloom.llm.simhash import _LANES, _ODD, _signed

#: At a likeness of 0.8 about 15 % of the bits differ: 19 of the 128 that go along to the cells, with a deviation of 4.
LANES, RADIUS = 4, 31
#: Cells up to this size are searched pair by pair; a root that reaches CROWD members of a larger one takes them all.
SMALL, CROWD, RUN = 128, 32, 1_000_000
#: One text in SHARE is in the sample for the order; COMMON hashes at most come last, those of FEW texts of the sample or more.
SHARE, COMMON, FEW = 8, 100_000, 3
#: Pairs that are compared at once.
PAIRS = 1_000_000
#: Bounds are rounded down by this, so that no binary fraction takes a pair.
_SLACK = 1e-6
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """word -> 64-bit hash; emptied when full, which costs time and changes nothing."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 42)
        return h


def shingle_set(text: str | None, shingle: int, cache: dict) -> np.ndarray:
    """Ascending distinct hashes of a text's word shingles; the whole sequence's where it is shorter, none without words.

    Letters of any alphabet are lower-cased, and white space of any kind parts words.
    """
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        total = _scramble(total * _MIX[0] + h[i : len(h) - width + 1 + i])
    return np.unique(total)


def long_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """LANES words of 64 bits: each bit is the majority of that bit over the scrambled hashes; zeros for none."""
    out = np.zeros(LANES, np.uint64)
    for lane in range(LANES if hashes.size else 0):
        bits = _LANES[_scramble(hashes + _MIX[lane]).view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(bits, np.arange(0, len(hashes), 255), axis=0)
        votes = sums.view(np.uint8).reshape(len(sums), 64).sum(0, dtype=np.int64)
        out[lane] = np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0]
    return out


def _grids(tables: int, segments: int, seed: int = 17) -> list[list[int]]:
    """For each grid a mask for each lane: `segments` two-bit segments of all, in random choice."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(tables):
        masks = [0] * LANES
        for s in rng.permutation(32 * LANES)[:segments].tolist():
            masks[s // 32] |= 3 << (2 * (s % 32))
        out.append(masks)
    return out


def _unary(fp: str) -> Column:
    """Bit counts of two-bit segments, written 00, 01, 11."""
    x, half, odd = F.col(fp), F.shiftrightunsigned(F.col(fp), 1), F.lit(_ODD)
    return x.bitwiseOR(half).bitwiseAND(odd).bitwiseOR(F.shiftleft(x.bitwiseAND(half).bitwiseAND(odd), 1))


def _forest(n: int, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges, trees): a minimum spanning forest by far of the edges (a, b) over nodes 0 to n - 1, by Boruvka's rounds.

    edges are indices of those kept, trees names each node's tree by one of its nodes.
    """
    kept, label = [], np.arange(n)
    order = np.argsort(far, kind="stable")
    a, b = a[order], b[order]
    edge = np.arange(len(order))
    while True:
        x, y = label[a[edge]], label[b[edge]]
        open_ = x != y
        edge, x, y = edge[open_], x[open_], y[open_]
        if not edge.size:
            break
        best = np.full(n, len(order), np.int64)
        np.minimum.at(best, x, edge)
        np.minimum.at(best, y, edge)
        heads = np.flatnonzero(best < len(order))
        chosen = best[heads]
        kept.append(np.unique(chosen))
        p, q = label[a[chosen]], label[b[chosen]]
        parent = np.arange(n)
        parent[heads] = np.where(p == heads, q, p)
        both = parent[parent[heads]] == heads  # two labels that chose one edge: the lesser leads
        lead = heads[both & (heads < parent[heads])]
        parent[lead] = lead
        while not np.array_equal(further := parent[parent], parent):
            parent = further
        label = parent[label]
    return order[np.concatenate(kept)] if kept else np.empty(0, np.int64), label


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints of two words, which are the last axis."""
    return np.bitwise_count(x[..., 0] ^ y[..., 0]) + np.bitwise_count(x[..., 1] ^ y[..., 1])


def _centre(fp: np.ndarray) -> int:
    """Place of the member nearest to the majority of all, which is the text that a crowd was copied from."""
    votes = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.argmin(_far(fp, np.packbits(2 * votes > len(fp), bitorder="little").view("<u8"))))


def _stars(fp: np.ndarray, tree: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The trees' links (a, b) and, of trees of four members or more, those of the centre to all in reach.

    In a crowd the centre's links stand in place of the tree's.
    """
    order = np.argsort(tree, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], tree[order][1:] != tree[order][:-1])))
    sizes = np.diff(np.concatenate((starts, [tree.size])))
    heads, tails, reached = [], [], np.zeros(tree.size, bool)
    for s, n in zip(starts[sizes > 3], sizes[sizes > 3], strict=True):
        own = order[s : s + n]
        root = own[_centre(fp[own])]
        near = own[_far(fp[own], fp[root]) <= radius]
        reached[near] = n >= CROWD // 2
        heads.append(np.full(near.size - 1, root))
        tails.append(near[near != root])
    other = ~(reached[a] & reached[b])
    return np.concatenate([*heads, a[other]]), np.concatenate([*tails, b[other]])


def _small(start: np.ndarray, size: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of many cells (start, size) of SMALL members at most, all at once."""
    heads, tails, fars = [], [], []
    for step in range(1, int(size.max(initial=0))):
        longer = size > step
        start, size = start[longer], size[longer]
        counts = size - step
        i = np.repeat(start - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(int(counts.sum()))
        far = _far(fp[i], fp[i + step])
        near = far <= radius
        heads.append(i[near])
        tails.append(i[near] + step)
        fars.append(far[near])
    if not heads:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b, far = np.concatenate(heads), np.concatenate(tails), np.concatenate(fars)
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    kept, tree = _forest(len(nodes), at[: len(a)], at[len(a) :], far)
    x, y = _stars(fp[nodes], tree, at[: len(a)][kept], at[len(a) :][kept], radius)
    return nodes[x], nodes[y]


def _large(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one cell: crowds hang on the member nearest to their centre, the rest is searched in blocks of rows."""
    heads, tails, rest = [], [], np.arange(len(fp))
    while rest.size > SMALL:
        root = rest[0]
        for _ in range(2):  # around any member first, then around the centre of what that reaches
            near = rest[_far(fp[rest], fp[root]) <= radius]
            if near.size < CROWD:
                break
            root = near[_centre(fp[near])]
        near = rest[_far(fp[rest], fp[root]) <= radius]
        if near.size < CROWD:
            break
        hung = near[near != root]
        heads.append(np.full(hung.size, root))
        tails.append(hung)
        rest = rest[~np.isin(rest, near)]
    a = b = np.empty(0, np.int64)
    far = np.empty(0, np.uint8)
    for at in range(0, rest.size, 256):
        rows = rest[at : at + 256]
        gap = _far(fp[rows][:, None], fp[rest[at:]][None, :])
        i, j = np.nonzero((gap <= radius) & (np.arange(rest.size - at)[None, :] > np.arange(rows.size)[:, None]))
        a, b, far = np.concatenate((a, at + i)), np.concatenate((b, at + j)), np.concatenate((far, gap[i, j]))
        kept, tree = _forest(rest.size, a, b, far)
        a, b, far = a[kept], b[kept], far[kept]
    x, y = _stars(fp[rest], tree, a, b, radius) if rest.size else (a, b)
    return np.concatenate([*heads, rest[x]]), np.concatenate([*tails, rest[y]])


def _links(cell: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int) -> pd.DataFrame:
    """Links of whole cells, which follow one another."""
    start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    size = np.diff(np.concatenate((start, [len(cell)])))
    small = (size > 1) & (size <= SMALL)
    parts = [_small(start[small], size[small], fp, radius)]
    for s, n in zip(start[size > SMALL], size[size > SMALL], strict=True):
        a, b = _large(fp[s : s + n], radius)
        parts.append((a + s, b + s))
    a, b = node[np.concatenate([p[0] for p in parts])], node[np.concatenate([p[1] for p in parts])]
    return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)}).drop_duplicates()


def candidate_links(nodes: DataFrame, tables: int, segments: int, radius: int = RADIUS) -> DataFrame:
    """nodes(node, f0 .. f3) -> distinct links (a, b), a > b, within radius bits of f0 and f1 in some cell."""
    coded = nodes.select("node", "f0", "f1", *[_unary(f"f{i}").alias(f"u{i}") for i in range(LANES)])
    cells = F.array(*[F.xxhash64(F.lit(t), *[F.col(f"u{i}").bitwiseAND(F.lit(_signed(m))) for i, m in enumerate(masks) if m]) for t, masks in enumerate(_grids(tables, segments))])
    placed = coded.select("node", "f0", "f1", F.explode(cells).alias("cell"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []  # rows that may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            held.append((batch["cell"].to_numpy(), np.stack((batch["f0"].to_numpy(), batch["f1"].to_numpy()), axis=1).view(np.uint64), batch["node"].to_numpy()))
            rows = sum(len(h[0]) for h in held)
            if rows < 50_000 or held[0][0][0] == held[-1][0][-1] and rows < RUN:
                continue
            cell, fp, node = (np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.searchsorted(cell, cell[-1], "left"))
            if last:
                yield _links(cell[:last], fp[:last], node[:last], radius)
                held = [(cell[last:], fp[last:], node[last:])]
            else:  # a cell of RUN members: the next part of it begins with a member of this one
                yield _links(cell, fp, node, radius)
                held = [(cell[-SMALL:], fp[-SMALL:], node[-SMALL:])]
        if held:
            yield _links(*(np.concatenate(x) for x in zip(*held, strict=True)), radius)

    # In one order, so that a crowd hangs on the same member in cell after cell.
    return placed.repartition("cell").sortWithinPartitions("cell", "node").mapInPandas(run, "a long, b long").distinct()


def common_hashes(texts: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of the shingles that occur in most of texts(text), rarest first; the driver gets COMMON at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, shingle, cache).view(np.int64))], names=["s"])

    counted = texts.mapInArrow(run, "s long").groupBy("s").count().filter(F.col("count") >= FEW)
    return counted.orderBy(F.desc("count"), "s").limit(COMMON).select("s").toArrow().column(0).to_numpy().view(np.uint64)[::-1]


def _prefix(hashes: np.ndarray, least: float, common: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first |x| - ceil(least |x|) + 1 of a set's hashes, those of ascending `common` last in the order of `place`; 0 for none."""
    if not hashes.size:
        return np.zeros(1, np.uint64)
    n = hashes.size - int(np.ceil(least * hashes.size - _SLACK)) + 1
    if common.size:
        at = np.minimum(np.searchsorted(common, hashes), common.size - 1)
        hit = common[at] == hashes
        if hit.any():
            hashes = np.concatenate((hashes[~hit], hashes[hit][np.argsort(place[at[hit]])]))
    return hashes[:n]


def _across(rows: pd.DataFrame, least: float) -> Iterator[pd.DataFrame]:
    """Pairs under one token that may be alike to least or more, but none of one label; rows are in order of both."""
    token, label = rows["token"].to_numpy(), rows["label"].to_numpy()
    other = token[1:] != token[:-1]
    ends = np.flatnonzero(np.append(other, True)) + 1
    end = ends[np.searchsorted(ends, np.arange(len(token)), "right")]
    turns = np.flatnonzero(np.append(other | (label[1:] != label[:-1]), True)) + 1
    after = turns[np.searchsorted(turns, np.arange(len(token)), "right")]
    first = np.flatnonzero(end > after)
    counts = (end - after)[first]
    node, size, pos = (rows[c].to_numpy().astype(np.int64) for c in ("node", "size", "pos"))
    total, lo = np.cumsum(counts), 0
    while lo < first.size:
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        n, i = counts[lo:hi], np.repeat(first[lo:hi], counts[lo:hi])
        j = np.arange(i.size) - np.repeat(np.cumsum(n) - n, n) + after[i]
        # Where it is the first hash that they share, they share no more than what follows it in both.
        most = 1 + np.minimum(size[i] - pos[i] - 1, size[j] - pos[j] - 1)
        may = most >= np.ceil(least / (1 + least) * (size[i] + size[j]) - _SLACK)
        a, b = node[i[may]], node[j[may]]
        yield pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)}).drop_duplicates()
        lo = hi


def _roomy(pairs: DataFrame, prefixes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that share so many hashes of their prefixes that they may be alike to least.

    Of two prefixes let x's end first: what x and y share up to there is in both, and |x| - |prefix| hashes of x follow.
    """
    x, y = (prefixes.select(F.col("node").alias(end), F.col("size").alias(f"{end}_size"), F.col("prefix").alias(f"{end}_prefix")) for end in "ab")
    total, longer = F.col("a_size") + F.col("b_size"), F.greatest("a_size", "b_size")
    room = F.ceil(total * F.lit(least / (1 + least)) - _SLACK) - F.ceil(longer * F.lit(least) - _SLACK) + 1
    return pairs.join(x, "a").join(y, "b").filter(F.size(F.array_intersect("a_prefix", "b_prefix")) >= room).select("a", "b")


def missed_links(prefixes: DataFrame, least: float) -> DataFrame:
    """prefixes(node, label, size, prefix) -> distinct (a, b), a > b: every pair of two labels alike to least or more, and others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows whose token may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if held[0]["token"].iat[0] == batch["token"].iat[-1]:
                continue
            rows = pd.concat(held, ignore_index=True)
            last = int(np.searchsorted(rows["token"].to_numpy(), rows["token"].iat[-1], "left"))
            yield from _across(rows[:last], least)
            held = [rows[last:]]
        if held:
            yield from _across(pd.concat(held, ignore_index=True), least)

    placed = prefixes.select("node", "label", "size", F.posexplode("prefix").alias("pos", "token"))
    return _roomy(placed.repartition("token").sortWithinPartitions("token", "label").mapInPandas(run, "a long, b long").distinct(), prefixes, least)


def verified(links: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The links whose ends' sets(node, hashes) have a Jaccard likeness of least or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = p.size + q.size - np.union1d(p, q).size
                keep.append(shared >= least * (p.size + q.size - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = links.join(sets.withColumnsRenamed({"node": "b", "hashes": "y"}), "b").join(sets.withColumnsRenamed({"node": "a", "hashes": "x"}), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, tables: int = 100, segments: int = 9) -> DataFrame:
    """docs without its near-duplicates: of every group linked by likeness of least or more one row stays, whole.

    It is the row with the smallest id; rows without an id come last. Rows that repeat both id and text count once. Rows
    that repeat an id with another text are rows of their own. Null texts are empty, and texts without words are alike.
    An empty table gives an empty result. Names of columns are free. `segments` is to grow with the corpus, by about two
    for each tenfold number of documents beyond ten million, and `tables` by a factor of about 1.9 with it, so that cells
    stay small.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    whole = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"), text.alias("text"), F.struct("*").alias("row"))
    lanes = [f"f{i}" for i in range(LANES)]
    common = common_hashes(whole.filter(F.pmod("h", F.lit(SHARE)) == 0).dropDuplicates(["h", "g"]).select("text"), shingle)
    place = np.argsort(common)
    common = common[place]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for batch in batches:
            sizes, fps, firsts = [], [], []
            for t in batch.column(3).to_pylist():
                hashes = shingle_set(t, shingle, cache)
                sizes.append(hashes.size)
                fps.append(long_fingerprint(hashes))
                firsts.append(_prefix(hashes, least, common, place).view(np.int64))
            ends = np.cumsum([0, *map(len, firsts)])
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *firsts])))
            columns = np.array(fps, np.uint64).reshape(-1, LANES).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int32()), prefix, *(pa.array(np.ascontiguousarray(columns[:, i])) for i in range(LANES))], names=["id", "h", "g", "size", "prefix", *lanes])

    marked = cut(whole.select("id", "h", "g", "text").mapInArrow(mark, "id long, h long, g long, size int, prefix array<long>, " + ", ".join(f"{x} long" for x in lanes)))
    # A node for each text; ids are compared as (is null, id). Numbers are read off a written table, so they hold.
    nodes = cut(marked.groupBy("h", "g").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"), *[F.first(x).alias(x) for x in lanes]))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, shingle, cache).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["node", "hashes"])

    def alike(links: DataFrame) -> DataFrame:
        met = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", F.col("first.id").alias("i"), F.col("h").alias("p"), F.col("g").alias("q")), "node")
        # Of a text's copies only rows with its smallest id are read: a text copied often is no hot key.
        own = (F.col("id").eqNullSafe(F.col("i"))) & (F.col("h") == F.col("p")) & (F.col("g") == F.col("q"))
        met_texts = whole.select("id", "h", "g", "text").join(met, own).select("node", "text").dropDuplicates(["node"])
        return verified(links, cut(met_texts.mapInArrow(collect, "node long, hashes binary")), least)

    labels = components(alike(cut(candidate_links(nodes.select("node", *lanes), tables, segments))))
    named = cut(nodes.join(labels, "node", "left").select("node", "h", "g", "first", F.coalesce("label", "node").alias("label")))
    release(docs.sparkSession)
    # The exact pass, over groups that the first one left apart.
    prefixes = marked.groupBy("h", "g").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix")).join(named, ["h", "g"])
    missed = cut(missed_links(cut(prefixes.select("node", "label", "size", "prefix")), least))
    release(docs.sparkSession)
    group = named.select("node", "label")
    joined = alike(missed).join(group.withColumnsRenamed({"node": "a", "label": "x"}), "a").join(group.withColumnsRenamed({"node": "b", "label": "y"}), "b")
    wider = components(joined.select(F.col("x").alias("a"), F.col("y").alias("b")))
    named = named.join(wider.select(F.col("node").alias("label"), F.col("label").alias("wider")), "label", "left").select("h", "g", "first", F.coalesce("wider", "label").alias("label"))
    # The one that stays of each group: its smallest id and, of texts under that id, one.
    stays = named.groupBy("label").agg(F.min(F.struct("first", "h", "g")).alias("s")).select(F.col("s.first.id").alias("i"), F.col("s.h").alias("p"), F.col("s.g").alias("q"))
    repeated = marked.groupBy("id", "h", "g").count().filter("count > 1")
    stays = cut(stays.join(repeated, F.col("i").eqNullSafe(F.col("id")) & (F.col("p") == F.col("h")) & (F.col("q") == F.col("g")), "left").select("i", "p", "q", F.col("count").isNotNull().alias("more")))
    kept = whole.join(stays, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("p")) & (F.col("g") == F.col("q")))
    once = kept.filter("more").groupBy("i", "p", "q").agg(F.first("row").alias("row"))
    return kept.filter("NOT more").select("row.*").unionByName(once.select("row.*"))
