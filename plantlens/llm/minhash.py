"""Near-duplicate documents by MinHash.

One permutation hashes every word shingle of a document once; the hash space is
cut into bins, each keeps its least value, and an empty bin takes the value of
a bin that a hash of its number chooses (optimal densification). Bands of bins
name buckets. Equal shingle sets form one class first, so that copies cost one
row. In each bucket the star from one centre gives the candidate edges, one
fewer than its members. They are confirmed on full sets and linked classes
contracted; only buckets that still hold several components go on, and there
the full sets of bounded blocks of members are compared inside a task, which
gives back a spanning forest of the links, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import byte_view, id_and_text, lower_ascii, map_batches, mix64, slices, span_hashes, word_spans, written
from plantlens.llm.graph import connected_components

BINS, ROWS = 128, 4
ORDERED = {"string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz", "binary"}
#: Members of one block of a large bucket; a task's group has at most two blocks.
BLOCK = 256
_U = np.uint64
_NONE = _U(2**64 - 1)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, ascending, and their offsets by
    row. A text of fewer words has its whole sequence as one shingle."""
    raw, at = byte_view(texts)
    raw = lower_ascii(raw)
    start, end, row = word_spans(raw, at)
    h = span_hashes(raw, start, end)
    n = len(at) - 1
    per = np.bincount(row, minlength=n)
    acc = np.zeros(max(0, len(h) - words + 1), _U)
    for k in range(words):
        acc = mix64(acc * _U(0x9E3779B97F4A7C15) + h[k : k + len(acc)])
    whole = row[: len(acc)] == row[words - 1 :][: len(acc)] if len(acc) else np.zeros(0, bool)
    hashes, owner = acc[whole], row[: len(acc)][whole]
    first = np.cumsum(per) - per
    for r in np.flatnonzero((per > 0) & (per < words)):
        value = np.zeros(1, _U)
        for x in h[first[r] : first[r] + per[r]]:
            value = mix64(value * _U(0x9E3779B97F4A7C15) + x)
        hashes, owner = np.append(hashes, mix64(value + _U(per[r]))), np.append(owner, r)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(n + 1))


def signatures(hashes: np.ndarray, at: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` values for each set; rows of empty sets mean nothing."""
    n = len(at) - 1
    sig = np.full((n, bins), _NONE)
    owner = np.repeat(np.arange(n), np.diff(at))
    place = (hashes >> _U(64 - bins.bit_length() + 1)).astype(np.int64)
    key = owner * bins + place
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    sig.ravel()[key[first]] = hashes[first]
    taken = sig != _NONE
    r, j = np.nonzero(~taken & (np.diff(at) > 0)[:, None])
    attempt = 0
    while len(r):
        attempt += 1
        choice = (mix64(j.astype(_U) * _U(0xD1342543DE82EF95) + _U(attempt)) % _U(bins)).astype(np.int64)
        hit = taken[r, choice]
        sig[r[hit], j[hit]] = sig[r[hit], choice[hit]]
        r, j = r[~hit], j[~hit]
    return sig


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = sig.shape[1] // rows
    parts = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U), (len(sig), bands)).copy()
    for k in range(rows):
        key = mix64(key * _U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key


def _set_sums(hashes: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix64(hashes ^ _U(seed)))])
    return (sums[at[1:]] - sums[at[:-1]]).view(np.int64)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit name of the set, and the keys of its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, at = shingle_sets(part.column(1), words)
                n = np.diff(at)
                keys = band_keys(signatures(hashes, at)).view(np.int64)
                full = n > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(full, keys.shape[1], 0))])
                cols = [
                    part.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(_set_sums(hashes, at, 0x243F6A8885A308D3)),
                    pa.array(_set_sums(hashes, at, 0x13198A2E03707344)),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[full].ravel())),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "set_a", "set_b", "keys"])

    return map_batches(docs, run, "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and its shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, at = shingle_sets(part.column(1), words)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "shingles"])

    return map_batches(docs, run, "doc_id long, shingles array<long>")


def block_links(ids: np.ndarray, comp: np.ndarray, flat: np.ndarray, sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different components, without those that earlier
    ones make needless. Sizes of intersections come from a matrix product over
    frequent shingles and from runs of equal hashes for the rest."""
    n = len(ids)
    row = np.repeat(np.arange(n), sizes)
    _, inverse, df = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.zeros((n, n), np.int32)
    often = df >= 16
    column = np.cumsum(often) - 1
    dense = often[inverse]
    width = int(often.sum())
    for c in range(0, width, 2048):
        here = dense & (column[inverse] >= c) & (column[inverse] < c + 2048)
        m = np.zeros((n, min(2048, width - c)), np.float32)
        m[row[here], column[inverse[here]] - c] = 1
        common += (m @ m.T).astype(np.int32)
    rare = (df[inverse] > 1) & ~dense
    order = np.lexsort((row[rare], inverse[rare]))
    r, s = row[rare][order], inverse[rare][order]
    for k in range(1, 16):
        same = np.flatnonzero(s[k:] == s[:-k]) if len(s) > k else []
        if not len(same):
            break
        np.add.at(common, (r[same], r[same + k]), 1)
    i, j = np.triu_indices(n, 1)
    c = common[i, j].astype(np.int64)
    linked = (100 * c >= percent * (sizes[i] + sizes[j] - c)) & (comp[i] != comp[j])
    i, j = i[linked], j[linked]
    pair = np.stack([np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])], 1)
    _, pick = np.unique(pair, axis=0, return_index=True)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for p in pick.tolist():
        a, b = find(int(comp[i[p]])), find(int(comp[j[p]]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(ids[i[p]]), int(ids[j[p]])))
    return out


def _links_of_groups(percent: int):
    """Runs over partitions sorted by group (columns g, rep, comp, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            lists = t.column("shingles").combine_chunks()
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            ids, comp = t.column("rep").to_numpy(), t.column("comp").to_numpy()
            pairs = block_links(ids, comp, flat, sizes, percent) if len(ids) > 1 else []
            u, v = zip(*pairs) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            g = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if held and g[a] != current:
                    yield flush()
                    held.clear()
                current = g[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield flush()

    return run


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups documents whose shingle sets have a Jaccard similarity of at
    least ``percent``, directly or over others.

    Returns one row per row of the table: doc_id, n_shingles, component_id (the
    least doc_id reachable) and kept (doc_id = component_id). Null and empty
    texts, and rows without doc_id, are linked with nothing and kept; their
    component is their own doc_id. Repeated rows are copies: each has the same
    component. Other columns are not read.
    """
    docs = id_and_text(df, id_col, text_col)
    drawn = written(sketches(docs, words), "sketches", "none")
    usable = drawn.filter("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "n_shingles", "keys")).alias("r"), F.count("*").alias("n"))
    held = written(classes.select("set_a", "set_b", F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("size"), F.col("r.keys").alias("keys"), "n"), "classes", "none")

    inside = held.select("rep", "size", F.explode("keys").alias("key"))
    shared = inside.groupBy("key").agg(F.count("*").alias("members"), F.min("rep").alias("centre")).filter("members > 1")
    buckets = written(inside.join(shared, "key"), "buckets")
    members = buckets.select(F.col("rep").alias("doc_id")).distinct()
    sets = written(full_sets(docs.join(members, "doc_id", "left_semi"), words).dropDuplicates(["doc_id"]), "sets", "none")

    sized = buckets.join(buckets.filter("rep = centre").select("key", F.col("size").alias("centre_size")), "key")
    alike = F.lit(100) * F.least("size", "centre_size") >= F.lit(percent) * F.greatest("size", "centre_size")
    edges = sized.filter((F.col("rep") != F.col("centre")) & alike).select(F.col("centre").alias("u"), F.col("rep").alias("v")).distinct()
    first = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("su"))
    second = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    confirmed = (
        edges.join(first, "u")
        .join(second, "v")
        .select("u", "v", both.alias("i"), (F.size("su") + F.size("sv")).alias("t"))
        .filter(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("t") - F.col("i")))
        .select("u", "v")
    )
    stars = connected_components(confirmed)
    rest = written(_residual_links(buckets, stars, sets, percent), "rest")
    roots = stars if rest.isEmpty() else connected_components(rest.union(stars.toDF("u", "v")))

    grouped = held.filter("n > 1").select("set_a", "set_b", "rep")
    # empty sets have one name; under names of their own they are no hot key
    named = drawn.withColumn("set_a", F.when(F.col("n_shingles") > 0, F.col("set_a")).otherwise(F.xxhash64("doc_id")))
    known = named.join(grouped, ["set_a", "set_b"], "left").withColumn("rep", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
    out = known.join(roots, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("root", "rep")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, unchanged: the one of the
    least doc_id, and of repeated rows of it the first in order of all columns.
    Rows without doc_id stay; so do those without words, one of each doc_id. Other columns may have any
    name and type; those without an order are compared by their JSON."""
    groups = near_duplicates(df, words, percent, id_col, text_col)
    names, free = df.columns, lambda c: c + "_" * (1 + max(map(len, df.columns)))
    key, rank = free("key"), free("rank")
    at = F.col(f"`{id_col}`").cast("long")
    gone = groups.filter(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct()
    stay = df.join(gone, at == F.col(key), "left_anti")
    again = groups.groupBy("doc_id").agg(F.count("*").alias(rank)).filter((F.col(rank) > 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(key))
    if again.isEmpty():
        return stay
    # columns without an order, such as maps, are compared by their text
    order = [F.col(f"`{c}`") if kind in ORDERED else F.to_json(F.struct(F.col(f"`{c}`"))) for c, kind in df.dtypes]
    repeated = stay.join(again, at == F.col(key), "left_semi")
    least = repeated.select(at.alias(key), F.struct(*order).alias(rank), F.struct(*[F.col(f"`{c}`") for c in names]).alias(free("row")))
    once = least.groupBy(key).agg(F.min_by(free("row"), rank).alias(free("row"))).select(*[F.col(free("row")).getField(c).alias(c) for c in names])
    return stay.join(again, at == F.col(key), "left_anti").unionByName(once)


def _residual_links(buckets: DataFrame, stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components of one bucket that its star has not shown.

    A bucket of up to twice BLOCK members is one group. In a larger one the
    members outside the centre's component are dealt to blocks, and each such
    block meets every block; members of the centre's component, linked already,
    never meet each other."""
    comp = F.coalesce("root", "rep")
    placed = buckets.join(stars, F.col("rep") == F.col("node"), "left").select("key", "rep", comp.alias("comp"))
    # the key of the centre's component: that of most members, the least on ties
    tally = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
    spread = tally.groupBy("key").agg(F.count("*").alias("comps"), F.sum("n").alias("all"), F.max(F.struct("n", (-F.col("comp")).alias("m"))).alias("top")).filter("comps > 1")
    open_ = placed.join(spread.select("key", "all", (-F.col("top.m")).alias("main"), (F.col("all") - F.col("top.n")).alias("out")), "key")
    # buckets of the same members are one bucket
    name = written(open_, "open")
    prints = name.groupBy("key").agg(F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("print"), F.count("*").alias("n"))
    one = prints.groupBy("print", "n").agg(F.min("key").alias("key")).select("key")
    work = name.join(one, "key").withColumn("is_out", F.col("comp") != F.col("main"))
    whole = F.col("all") <= 2 * BLOCK
    out_blocks = F.ceil(F.col("out") / BLOCK).cast("int")
    in_blocks = F.ceil((F.col("all") - F.col("out")) / BLOCK).cast("int")
    spot = F.pmod(F.xxhash64("rep", "key"), F.when(F.col("is_out"), out_blocks).otherwise(in_blocks)).cast("int")
    meets = F.when(
        F.col("is_out"),
        F.concat(
            F.transform(F.sequence(F.lit(0), out_blocks - 1), lambda j: F.struct(F.least(spot, j).alias("x"), F.greatest(spot, j).alias("y"))),
            F.transform(F.sequence(F.lit(0), in_blocks - 1), lambda j: F.struct(spot.alias("x"), (-1 - j).alias("y"))),
        ),
    ).otherwise(F.transform(F.sequence(F.lit(0), out_blocks - 1), lambda j: F.struct(j.alias("x"), (-1 - spot).alias("y"))))
    groups = F.when(whole, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(meets)
    dealt = work.select("key", "rep", "comp", F.explode(groups).alias("at")).select(F.xxhash64("key", "at.x", "at.y").alias("g"), "rep", "comp")
    full = dealt.join(sets.withColumnRenamed("doc_id", "rep"), "rep").select("g", "rep", "comp", "shingles")
    return map_batches(full.repartition("g").sortWithinPartitions("g"), _links_of_groups(percent), "u long, v long")
