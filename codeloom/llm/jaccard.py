"""N-gram Jaccard join: which documents share most of their word shingles.

A document is the set of its distinct ``K``-word shingles, as 64-bit hashes in
order.  Two sets link when their Jaccard similarity is at least 0.8.

1. Documents with the same set are one class, known by two further hashes.
2. Keys.  Linked sets agree on one of the first ``n - ceil(0.8 n) + 1``
   shingles under any fixed order; here frequent shingles come last, so that
   passages which many documents share seldom become keys.  A bitmap of fixed
   size says what is frequent; it moves keys, and never decides about links.
3. Tiles of signatures.  The classes of a key, in order of size, are cut where
   sizes differ too much to link, then into blocks of bounded total size; pairs
   of blocks whose sizes may link are tiles.  Equal tiles of several keys are one.
   A class comes with a bitmap of two to four bits a shingle.  A bit that only
   one side has is a shingle that the other lacks, so bit counts bound the
   overlap from above.  Pairs within the bound are joined into clusters; a tile
   reports no more pairs than it has classes.
4. Tiles of arrays.  Each cluster is cut into tiles in the same way, so a class
   fetches its sorted array about once.  Pairs within the bound are intersected
   exactly, and a tile again reports at most one link per class.
5. Components of the links name the documents.

Texts are read whole, once per step that needs them, and are never shuffled.
Null and empty texts have no shingles and link with nothing.  Rows of one id
are one document.  A row without id takes the smallest id among its links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import store_table
from . import common as C
from .components import components, stored

K = 5
# A shingle is frequent from so many sightings on; sightings are counted per block of shingles.
FREQUENT, BLOCK_SEEN, BLOCK_SHINGLES = 64, 4, 1 << 20
# Shingles in a block of a tile, when tiles hold signatures and when they hold arrays.
SIGNED_BLOCK, ARRAY_BLOCK = 2_000_000, 3_000_000
SEEN_SETS = 200_000


def shingle_sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    raw, offs = C.binary_column(batch, "text")
    for _, _, data, o in C.groups(raw, offs):
        w = C.words_of(data, o, C.NOT_SPACE)
        g = C.grams(w.hash, K)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            if b - a >= K:
                yield np.unique(g[a: b - K + 1])
            elif b > a:
                yield C.grams(w.hash[a:b], b - a)
            else:
                yield np.zeros(0, dtype=C.U)


def signature(s: np.ndarray) -> bytes:
    """A bitmap with at least two bits per shingle; sizes are powers of two."""
    bits = 64
    while bits < 2 * len(s):
        bits *= 2
    out = np.zeros(bits, dtype=bool)
    out[(s >> C.U(20)).astype(np.int64) & (bits - 1)] = True
    return np.packbits(out, bitorder="little").tobytes()


def _digest(s: np.ndarray) -> tuple[int, int]:
    a, b = C.mix(s + C.U(0x51ED27)).sum(dtype=C.U), np.bitwise_xor.reduce(C.mix(s ^ C.U(0xA24BAED4963EE407)), initial=C.U(0))
    return int(np.int64(a)), int(np.int64(b))


def _scan_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row its size, digests and signature; further rows with n < 0 are counts of shingles seen often."""
    names = ["rid", "n", "s1", "s2", "bits"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    held: list[np.ndarray] = []
    size = 0

    def often() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, C.U), np.zeros(0, np.int64))
        h, n = h[n >= BLOCK_SEEN], n[n >= BLOCK_SEEN]
        none = pa.nulls(len(h), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array((-n).astype(np.int32)), pa.array(h.astype(np.int64)), none, pa.nulls(len(h), pa.binary())], names=names)

    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for s in shingle_sets(batch):
            s1, s2 = _digest(s)
            for c, v in zip(rows, (len(s), s1, s2, signature(s))):
                c.append(v)
            held.append(s)
            size += len(s)
            if size >= BLOCK_SHINGLES:
                yield often()
                held, size = [], 0
        yield pa.RecordBatch.from_arrays([batch.column("rid"), *(pa.array(c, k) for c, k in zip(rows, kinds[1:]))], names=names)
    yield often()


def _scan_keys(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = frequent.value
        seen: set[tuple[int, int, int]] = set()  # spares copies inside a task; forgetting one costs work only
        for batch in batches:
            keys, rids, sizes = [], [], []
            for rid, s in zip(batch.column("rid").to_pylist(), shingle_sets(batch)):
                n = len(s)
                mark = (n, *_digest(s)) if n else None
                if n == 0 or mark in seen:
                    continue
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(mark)
                p = n - (4 * n + 4) // 5 + 1
                late = C.in_bitmap(bits, s)
                first = s[~late][:p]
                if len(first) < p:
                    first = np.concatenate([first, s[late][: p - len(first)]])
                keys.append(first)
                rids.append(np.full(p, rid, dtype=np.int64))
                sizes.append(np.full(p, n, dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(rids)), pa.array(np.concatenate(sizes))], names=["k", "d", "n"])

    return run


def _scan_arrays(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            keep = C.in_bitmap(bits, np.asarray(batch.column("rid")).astype(C.U))
            part = batch.filter(pa.array(keep))
            sets = [s.astype(np.int64) for s in shingle_sets(part)]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("rid"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["rep", "arr"])

    return run


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Rows of one tile at a time, from batches sorted by tile."""
    held: dict[str, list] = {}
    for batch in batches:
        cols = {c: batch.column(c) for c in batch.schema.names}
        t = np.asarray(cols["tile"])
        cuts = [0, *(np.flatnonzero(np.diff(t)) + 1).tolist(), len(t)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if held and held["tile"][0] != t[a]:
                yield held
                held = {}
            for c, v in cols.items():
                held.setdefault(c, []).extend(v.slice(a, b - a) if c == "arr" else v.slice(a, b - a).to_pylist())
    if held:
        yield held


class _Sheets:
    """The signatures of a tile by width.  A pair meets at the smaller width, half the other's at most."""

    def __init__(self, bits: list[bytes]):
        self.width = np.array([len(x) for x in bits])  # rises with the size of the set
        self.first = {int(w): int(np.searchsorted(self.width, w)) for w in np.unique(self.width)}
        self.at: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for w, lo in self.first.items():
            own = np.frombuffer(b"".join(x for x in bits if len(x) == w), dtype=np.uint64).reshape(-1, w // 8)
            self._keep(w, w, own)
            if w // 2 in self.first:
                self._keep(w, w // 2, own[:, : w // 16] | own[:, w // 16:])

    def _keep(self, width: int, shown: int, sheet: np.ndarray) -> None:
        self.at[width, shown] = sheet, np.bitwise_count(sheet).sum(axis=1, dtype=np.int64)

    def alone(self, i: int, js: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits that only row ``i`` has, and bits that only each of the later rows ``js`` has."""
        w = int(self.width[i])
        x, nx = (v[i - self.first[w]] for v in self.at[w, w])
        mine, theirs = [], []
        for other in (w, 2 * w):
            part = js[self.width[js] == other]
            if len(part):
                sheet, ones = self.at[other, w]
                rows = part - self.first[other]
                both = np.bitwise_count(sheet[rows] & x).sum(axis=1, dtype=np.int64)
                mine.append(nx - both)
                theirs.append(ones[rows] - both)
        return np.concatenate(mine), np.concatenate(theirs)


def _connect(g: dict[str, list], accept: Callable[[int, int], bool]) -> pa.RecordBatch:
    """Accepted pairs that connect the classes of a tile, of those that sizes and bit counts allow.

    Pairs that are connected already are not looked at, so a tile of copies is
    about one comparison per class.
    """
    n, side, rep = np.array(g["n"], dtype=np.int64), np.array(g["side"]), g["rep"]
    sheets = _Sheets(g["bits"])
    two = side.max() > 0
    group = np.arange(len(n))
    out: list[tuple[int, int]] = []
    ends = np.searchsorted(n, n * 5 // 4, side="right")  # rows come in order of size
    for i in range(len(n) - 1):
        open_ = group[i + 1: ends[i]] != group[i]
        if two:
            open_ &= side[i + 1: ends[i]] != side[i]
        js = np.flatnonzero(open_) + i + 1
        if not len(js):
            continue
        only_i, only_j = sheets.alone(i, js)
        most = np.minimum(n[i] - only_i, n[js] - only_j)
        for j in js[9 * most >= 4 * (n[i] + n[js])].tolist():
            if group[j] != group[i] and accept(i, j):
                group[group == group[j]] = group[i]
                out.append((rep[i], rep[j]))
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within the bound that connect the classes of a tile."""
    for g in _tiles(batches):
        yield _connect(g, lambda i, j: True)


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect the classes of a tile, found by intersecting sorted arrays."""
    for g in _tiles(batches):
        sets = [np.asarray(x.values).view(np.uint64) for x in g["arr"]]  # sorted as unsigned

        def linked(i: int, j: int, sets=sets) -> bool:
            x, y = sets[i], sets[j]
            p = np.searchsorted(y, x)
            p[p == len(y)] = 0
            return 9 * int((y[p] == x).sum()) >= 4 * (len(x) + len(y))

        yield _connect(g, linked)


def _blocks(rows: DataFrame, limit: int) -> DataFrame:
    """Tiles (tile, rep, side) of ``rows(k, run, rep, n)``: pairs of blocks whose sizes may link."""
    inside = Window.partitionBy("k", "run").orderBy("n", "rep").rowsBetween(Window.unboundedPreceding, 0)
    rows = stored(rows.withColumn("block", F.floor((F.sum("n").over(inside) - F.col("n")) / F.lit(limit))))
    blocks = rows.groupBy("k", "run", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    later = blocks.select("k", "run", F.col("block").alias("block2"), F.col("lo").alias("lo2"))
    pairs = blocks.join(later, ["k", "run"]).where("block2 >= block and 4 * lo2 <= 5 * hi").select(
        "k", "run", F.xxhash64("k", "run", "block", "block2").alias("tile"), F.col("block").alias("b1"), F.col("block2").alias("b2"))
    one = pairs.select("k", "run", "tile", F.col("b1").alias("block"), F.lit(0).alias("side"))
    two = pairs.where("b1 <> b2").select("k", "run", "tile", F.col("b2").alias("block"), F.lit(1).alias("side"))
    return rows.join(one.union(two), ["k", "run", "block"]).select("tile", "rep", "side")


def _sorted_tiles(df: DataFrame) -> DataFrame:
    return df.repartition("tile").sortWithinPartitions("tile", "n", "rep")


def _key_tiles(keyed: DataFrame) -> DataFrame:
    """Tiles of the keys ``keyed(k, rep, n)``, each set of classes once."""
    line = Window.partitionBy("k").orderBy("n", "rep")
    # sizes that differ by more than a quarter cannot link, so a key falls apart there
    runs = keyed.withColumn("cut", F.coalesce((4 * F.col("n") > 5 * F.lag("n").over(line)).cast("int"), F.lit(0)))
    runs = stored(runs.withColumn("run", F.sum("cut").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("cut"))
    groups = runs.groupBy("k", "run").agg(
        F.count("*").alias("m"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("f1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("f2")).where("m > 1")
    once = groups.groupBy("m", "f1", "f2").agg(F.min(F.struct("k", "run")).alias("x")).select("x.k", "x.run")
    return _blocks(runs.join(once, ["k", "run"]), SIGNED_BLOCK)


def _links(texts: DataFrame, classes: DataFrame, keyed: DataFrame) -> DataFrame:
    """Links (a, b) that connect the classes as all links do; ``classes(rep, n, bits)``."""
    signed = _sorted_tiles(_key_tiles(keyed).join(classes, "rep").select("tile", "rep", "n", "side", "bits"))
    likely = stored(signed.mapInArrow(_candidates, "a long, b long").distinct())
    clusters = components(likely)
    members = clusters.select(F.col("label").alias("k"), F.lit(0).alias("run"), F.col("node").alias("rep")).join(classes.select("rep", "n"), "rep")
    tiles = _blocks(members.select("k", "run", "rep", "n"), ARRAY_BLOCK)
    ids = clusters.select(F.col("node").alias("rep"))
    wanted = C.broadcast(texts.sparkSession, C.bitmap_of(ids, "rep"))
    arrays = texts.mapInArrow(_scan_arrays(wanted), "rep long, arr array<bigint>").join(ids, "rep").dropDuplicates(["rep"])
    full = _sorted_tiles(tiles.join(classes, "rep").join(arrays, "rep").select("tile", "rep", "n", "side", "bits", "arr"))
    return stored(full.mapInArrow(_exact, "a long, b long"))


def similar_documents(documents: DataFrame, alike: bool = False) -> DataFrame:
    """Per row of documents: doc_id, n_shingles, component_id, rid (a hash of id and text).

    With ``alike`` also the component by similarity alone, where a shared id links nothing.
    """
    docs = C.only(documents, "doc_id", "text")
    texts = C.spread(docs.select(F.xxhash64("doc_id", "text").alias("rid"), "text"))
    scanned, _ = store_table(texts.mapInArrow(_scan_sets, "rid long, n int, s1 long, s2 long, bits binary"))
    often = scanned.where("n < 0").groupBy("s1").agg(F.sum(-F.col("n")).alias("seen")).where(F.col("seen") >= FREQUENT)
    frequent = C.broadcast(docs.sparkSession, C.bitmap_of(often, "s1"))
    sets = scanned.where("n > 0").dropDuplicates(["rid"])
    first = sets.groupBy("n", "s1", "s2").agg(F.min("rid").alias("rep"), F.min_by("bits", "rid").alias("bits"))
    classes = stored(first)
    member = stored(sets.select("rid", "n", "s1", "s2").join(classes.drop("bits"), ["n", "s1", "s2"]).select("rid", "rep"))
    keys = texts.mapInArrow(_scan_keys(frequent), "k long, d long, n int")
    line = Window.partitionBy("k").orderBy("n", "d")
    near = ((4 * F.col("n") <= 5 * F.lag("n").over(line)) | (4 * F.lead("n").over(line) <= 5 * F.col("n")))
    shared, _ = store_table(keys.withColumn("near", near).where("near").drop("near"))
    keyed = shared.join(member.withColumnRenamed("rid", "d"), "d").select("k", "rep", "n").distinct()
    links = _links(texts, classes.select("rep", "n", "bits"), keyed)
    # rows of one id are one document
    ids = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"))
    node = stored(ids.join(scanned.where("n >= 0").select("rid", "n").distinct(), "rid").join(member, "rid", "left").select(
        "doc_id", "rid", "n", F.coalesce("rep", "rid").alias("rep")))
    twice = node.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    same = node.join(twice, "doc_id").select("a", F.col("rep").alias("b")).distinct()
    label = components(links.union(same))
    by_class = node.groupBy("rep").agg(F.min("doc_id").alias("least"))
    placed = by_class.join(label, F.col("rep") == F.col("node"), "left").select("rep", "least", F.coalesce("label", "rep").alias("comp"))
    of_comp = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = placed.join(of_comp, "comp").select("rep", "component_id", F.col("comp").alias("alike"))
    if alike and twice.limit(1).count():
        apart = components(links).select(F.col("node").alias("rep"), "label")
        named = named.join(apart, "rep", "left").withColumn("alike", F.coalesce("label", "rep"))
    return node.join(named, "rep").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "rid", *["alike"] * alike)


def report(documents: DataFrame) -> DataFrame:
    return similar_documents(documents).drop("rid")


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each component: the one with its smallest id, or of those without id one; of equal rows one.

    Of texts under the smallest id that are alike one stays, the one with the
    smallest hash; texts under that id that are not alike all stay.
    """
    rows = stored(similar_documents(documents, alike=True))
    named = rows.where("doc_id is not distinct from component_id")
    least = named.groupBy("alike", "doc_id").agg(F.min("rid").alias("rid")).select("rid")
    copies = named.join(least, "rid", "left_anti")
    gone = rows.where("doc_id is distinct from component_id").union(copies.select(*rows.columns)).select(F.col("rid").alias("k1")).distinct()
    kept = C.keyed(documents).join(gone, "k1", "left_anti")
    first = Window.partitionBy("k1").orderBy("k2")
    return C.named(kept.withColumn("nth", F.row_number().over(first)).where("nth = 1"), documents)
