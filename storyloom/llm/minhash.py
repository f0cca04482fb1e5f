"""Near-duplicate detection by MinHash, banding and connected components.

1. Each text's set of distinct word shingles (64-bit hashes) gives the minima of many universal hash functions. Equal
   sets are one class; only a class's first row goes on, so exact copies never meet in a bucket.
2. Bands of minima are bucket keys. In each bucket all rows are paired with one root (a star, not all pairs): the row
   that meets most others over all its buckets, which in a group of copies is the one nearest to all. Pairs are
   confirmed on the full sets.
3. Large-star and small-star rounds make components of the confirmed links.
4. Buckets that hold several components draw new roots, and their components are contracted by what is found, as long
   as that links a fair share of what is open.
5. The rows of buckets that are still split are compared across components only: a pair must share one of the rarest
   shingles of both sets, which every similar pair does (`rare_pairs`). So every link between two different texts that
   share a bucket is found (but for the signatures, below), and neither a group of copies nor a passage that many texts
   share costs its square.

With 32 bands of 4 minima, two sets of similarity 0.8 share no bucket with a chance of 5e-8. Pairs whose 128 minima agree
in a share below similarity - 6 sigma (0.588 for 0.8) are dropped before the full sets are compared, stars and rare pairs
alike; that loses a pair of similarity 0.8 with a chance of 2.7e-8. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm import textkit as T
from storyloom.llm.storage import ID, RID, TEXT, kept_rows, keyed, same_key, stored, with_ids

_RNG = np.random.default_rng(4021)


def shingle_sets(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, shingle: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles of A-Z-folded words; all words as one if they are fewer."""
    for i, j in T.slices(starts, ends):
        w = T.words(raw, starts[i:j], ends[i:j], fold=True)
        grams = T.windows(w.hashes, shingle)
        for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
            if b - a >= shingle:
                yield np.unique(grams[a : b - shingle + 1])
            elif b > a:
                yield T.mix(T.windows(w.hashes[a:b], b - a) + T.U(b - a))
            else:
                yield np.zeros(0, T.U)


def signatures(rows: DataFrame, shingle: int, bands: int, per_band: int) -> DataFrame:
    """For rows (_rid, _text): _rid, n, two keys of the whole set, 16 bits of each minimum, the band keys."""
    k = bands * per_band
    mul, add = (_RNG.integers(1, 1 << 63, k, dtype=np.int64).astype(T.U) * T.U(2) + T.U(1))[:, None], _RNG.integers(1, 1 << 63, k, dtype=np.int64).astype(T.U)[:, None]
    salt = np.arange(bands, dtype=T.U) * T.U(0x9E3779B97F4A7C15)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, s, e, _ = T.text_bytes(batch.column(1))
            size, key1, key2, low, keys = [], [], [], [], []
            for x in shingle_sets(raw, s, e, shingle):
                size.append(len(x))
                y = T.mix(x)
                key1.append(int(y.sum()) & (2**64 - 1))
                key2.append(int(np.bitwise_xor.reduce(y * T.U(0xC2B2AE3D27D4EB4F))) if len(x) else 0)
                minima = np.full(k, np.iinfo(T.U).max, T.U)
                for at in range(0, len(x), 512):
                    np.minimum(minima, (x[None, at : at + 512] * mul + add).min(axis=1), out=minima)
                low.append((minima >> T.U(40)).astype(np.uint16).view(np.int16))
                keys.append(T.mix(T.windows(minima, per_band)[::per_band] + salt).view(np.int64) if len(x) else np.zeros(0, np.int64))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(size, pa.int64()), pa.array(np.array(key1, T.U).view(np.int64)), pa.array(np.array(key2, T.U).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(low) + 1, dtype=np.int32) * k), pa.array(np.concatenate(low) if low else np.zeros(0, np.int16))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
            ], [RID, "n", "key1", "key2", "low", "bands"])

    return rows.select(RID, TEXT).mapInArrow(sign, f"{RID} long, n long, key1 long, key2 long, low array<short>, bands array<long>")


#: Bytes of full sets that one Arrow batch holds at most, but for one longer set.
BATCH = 1 << 22


def full_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """For rows (_rid, _text): _rid and the sorted set as bytes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, s, e, _ = T.text_bytes(batch.column(1))
            found = shingle_sets(raw, s, e, shingle)
            at, out, held = 0, [], 0
            for x in found:
                out.append(x.tobytes())
                held += len(out[-1])
                if held >= BATCH:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(out)), pa.array(out, pa.binary())], [RID, "set"])
                    at, out, held = at + len(out), [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(out)), pa.array(out, pa.binary())], [RID, "set"])

    return rows.select(RID, TEXT).mapInArrow(sets, f"{RID} long, set binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), T.U), np.frombuffer(y.as_buffer(), T.U)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    x = pairs.join(sets.select(F.col(RID).alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col(RID).alias("a"), F.col("set").alias("set_a")), "a")
    return x.select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long")


def alike(pairs: DataFrame, low: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of which a share of at least `least` of the minima (low: _rid, low) agrees."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(i).flatten().to_numpy().reshape(batch.num_rows, -1) for i in (2, 3))
                keep = pa.array((x == y).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], ["a", "b"])

    pairs = pairs.join(low.select(F.col(RID).alias("b"), F.col("low").alias("low_b")), "b").join(low.select(F.col(RID).alias("a"), F.col("low").alias("low_a")), "a")
    return pairs.select("a", "b", "low_a", "low_b").mapInArrow(check, "a long, b long")


def rare_pairs(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of rows (_rid, n, component) of different components that share one of the rarest shingles of both.

    If two sets are similar enough, they share percent of the larger one's shingles at least, and so one of the rarest
    n - ceil(percent * n) + 1 of each, whatever the order of shingles. With the rarest first, sets that share a frequent
    passage only, or that each differ from a group in shingles of their own, share none of these. A shingle's place in a
    set bounds what two sets can share from it on. Rows for which no row of the token can be similar by that go before
    the join; the join meets only rows of like sizes (each fits sizes within a factor, which are its class of sizes and
    the two beside it).
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
            sizes = [len(x) for x in parts]
            rid = np.repeat(batch.column(0).to_numpy(), sizes)
            token = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            for at in range(0, len(rid), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(rid[at : at + 100_000]), pa.array(token[at : at + 100_000])], [RID, "token"])

    tokens = stored(sets.join(rows.select(RID), RID, "left_semi").mapInArrow(spread, f"{RID} long, token long"), "tokens")
    often = stored(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"), "often")
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    shared = tokens.join(often, "token").groupBy(RID).agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("x"))
    # The shingles that no other row has are the rarest; what they leave of the first ones is taken from the others.
    left = shared.join(rows, RID).withColumn("left", first - (F.col("n") - F.size("x"))).filter("left > 0")
    keys = left.select(RID, "n", "component", (F.col("n") - F.size("x")).alias("own"), F.posexplode(F.slice("x", F.lit(1), F.col("left").cast("int"))))
    # follow: how many shingles this and the later ones are; two sets that meet here first share no more.
    keys = stored(keys.select(RID, "n", "component", (F.col("n") - F.col("own") - F.col("pos")).alias("follow"), F.col("col.token").alias("token")), "rare")
    lead = keys.groupBy("token").agg(F.min("component").alias("main"), F.max("component").alias("high"), F.min("n").alias("least"), F.max("follow").alias("best")).filter("main < high").drop("high")
    lead = stored(lead, "lead")
    smallest = F.greatest("least", F.ceil(F.col("n") * percent / 100))
    can = (100 + percent) * F.least("follow", "best") >= percent * (F.col("n") + smallest)
    class_ = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(percent / 100 - 1e-9)))
    inside = stored(keys.join(lead, "token").filter(can).withColumn("class", class_), "rare_split")
    side = lambda x: [F.col(c).alias(c + x) for c in (RID, "n", "component", "follow")]
    outer = inside.filter("component <> main").select("token", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"), *side("x"))
    other = inside.select("token", "class", *side("y"))
    both = lambda c: (F.col(c + "x"), F.col(c + "y"))
    (nx, ny), (fx, fy), (cx, cy) = both("n"), both("follow"), both("component")
    near = 100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)
    enough = (100 + percent) * F.least(fx, fy) >= percent * (nx + ny)
    pairs = outer.join(other, (outer["token"] == other["token"]) & (outer["class"] == other["class"]) & (cx != cy) & near & enough)
    return pairs.select(F.least(*both(RID)).alias("a"), F.greatest(*both(RID)).alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of the edges (a, b), by alternating large-star and small-star.

    Each round is a grouped minimum and a join, so no node's neighbours are ever gathered.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        edges = stored(small.filter("u <> v").distinct(), "edges")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def contracted(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (node, component) after more links (a, b), which may name any nodes: the links are taken between
    components, which the components of these then join."""
    if found is None:
        return stored(components(links), "components")
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    edges = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    over = stored(components(edges), "joined")
    up = over.select(F.col("node").alias("component"), F.col("component").alias("top"))
    old = found.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    new = over.join(found.select("node"), "node", "left_anti")
    return stored(old.unionByName(new), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bands: int = 32, per_band: int = 4) -> DataFrame:
    """One row per row of docs: _rid, _id, n_shingles, component (the _rid of its component's first row) and kept.

    Texts without words (null, empty) have no shingles and are linked with nothing; rows with equal sets are linked; very
    long texts give long sets, which are compared whole. Null ids rank first and repeated ids are rows of their own, in the
    order of a hash of their texts; the first row of a component stays; an empty table gives no rows; only the two named
    columns are read.
    """
    return link(keyed(docs, id_col, text_col), shingle, similarity, bands, per_band)


def link(rows: DataFrame, shingle: int = 5, similarity: float = 0.8, bands: int = 32, per_band: int = 4, fair: float = 0.05) -> DataFrame:
    """near_duplicates() for keyed rows. fair: roots are drawn again if the last ones linked this share of the open rows;
    how often does not change the result, only what is left for rare_pairs()."""
    percent = round(100 * similarity)
    signed = stored(signatures(rows, shingle, bands, per_band), "signatures")
    classes = stored(signed.filter("n > 0").groupBy("n", "key1", "key2").agg(F.min(RID).alias("first")), "classes")
    firsts = signed.join(classes.select(F.col("first").alias(RID)), RID, "left_semi")
    dealt = firsts.select(RID, "n", F.explode("bands").alias("key"))
    several = stored(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "buckets")  # joins of plain exchanges can split a hot key
    busy = dealt.join(several, "key").groupBy(RID, "n").agg(F.collect_list("key").alias("keys"), F.sum("m").alias("meets"))
    busy = stored(busy.join(signed.select(RID, "low"), RID), "busy")
    sets = stored(full_sets(rows.join(busy.select(RID), RID, "left_semi"), shingle), "sets")
    low = busy.select(RID, "low")
    least = similarity - 6 * (similarity * (1 - similarity) / (bands * per_band)) ** 0.5

    def linked(pairs: DataFrame) -> DataFrame:
        return stored(confirmed(stored(alike(pairs, low, least), "alike"), sets, percent), "links")

    def stars(places: DataFrame, order) -> DataFrame:
        """Pairs of the rows (_rid, n, meets, key, component) of each bucket and its root, if of different components."""
        root = F.max_by(F.struct(RID, "n", "component"), F.struct(order, "meets", -F.col(RID)))
        roots = stored(places.groupBy("key").agg(root.alias("root")), "roots")
        near = 100 * F.least(F.col("n"), F.col("root.n")) >= percent * F.greatest(F.col("n"), F.col("root.n"))
        pairs = places.join(roots, "key").filter(near & (F.col("component") != F.col("root.component")))
        return pairs.select(F.least(RID, f"root.{RID}").alias("a"), F.greatest(RID, f"root.{RID}").alias("b")).distinct()

    found = contracted(None, linked(stars(busy.select(RID, "n", "meets", F.explode("keys").alias("key"), F.col(RID).alias("component")), F.lit(0))))
    draw, more = 0, None
    while True:
        inside = busy.drop("low").join(found.select(F.col("node").alias(RID), "component"), RID, "left").withColumn("component", F.coalesce("component", RID))
        inside = stored(inside, "placed").select(RID, "n", "meets", "component", F.explode("keys").alias("key"))
        split = inside.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
        split = stored(split.select("key"), "split_keys")
        inside = stored(inside.join(split, "key", "left_semi"), "split")
        open_ = stored(inside.select(RID, "n", "component").distinct(), "open")
        size = open_.count()
        if not size or (more is not None and more < fair * size):
            break
        # A component is drawn in each bucket, a large one no more often than others; its row that meets most is the root.
        draw += 1
        links = linked(stars(inside, F.xxhash64(F.lit(draw), "component")))
        more = links.count()
        if not more:
            break
        found = contracted(found, links)
    links = linked(rare_pairs(open_, sets, percent))
    if not links.isEmpty():
        found = contracted(found, links)
    classed = signed.join(classes, ["n", "key1", "key2"], "left").select(RID, "n", F.coalesce("first", RID).alias("node"))
    return finish(classed.join(found, "node", "left").select(RID, F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component")), rows)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each component (the one with the smallest id), with its columns; texts without words stay."""
    return kept_rows(docs, lambda rows: link(rows, **how).filter("kept").select(RID), id_col, text_col)


def finish(out: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds _id, component_id (the id of the component's first row) and kept."""
    out = with_ids(out.withColumn("kept", F.col(RID) == F.col("component")), rows)
    if same_key(rows):
        return out.withColumn("component_id", F.col("component"))
    return out.join(rows.select(F.col(RID).alias("component"), F.col(ID).alias("component_id")), "component")
