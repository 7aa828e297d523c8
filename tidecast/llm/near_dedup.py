"""Near duplicates by SetSketch registers.

1. One pass makes of each text its distinct 5-word shingles, a digest of that
   set and SetSketch registers: of exponential variates of all shingles the
   least, on a scale of powers of ``B``, truncated to whole steps.  The
   registers of a union are the larger of each pair of registers.
2. Texts with equal sets are one class, led by their least id.
3. Bands of registers put class leaders into buckets.  Small buckets propose
   all their pairs; larger ones propose each member against a few members
   picked by hashes of their ids, so proposals grow with the members only.
4. The joint likelihood of two sketches drops pairs that cannot be similar, and
   the full shingle sets decide on the others.
5. Buckets that still hold more than one component are finished exactly: each
   member outside the bucket's largest component meets all the others, in
   blocks of bounded size, and only the links come out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.components import components
from tidecast.llm.words import U64, lists, shingle_sets, slices, window_hashes
from tidecast.storage import written_table

REGISTERS = 160
MISSED = 1e-7              # most likely share of pairs at the asked similarity that meet in no band
B, RATE = 1.1, 20.0
SMALL_BUCKET = 8           # up to this size all pairs are proposed
PIVOTS = 2                 # members that the others of a larger bucket are held against
UNLIKELY = 20.0            # natural log of a likelihood ratio: six standard deviations
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 1 << 18

_rng = np.random.default_rng(7)
_MUL = _rng.integers(0, 1 << 63, REGISTERS).astype(U64) * U64(2) + U64(1)
_ADD = _rng.integers(0, 1 << 63, REGISTERS).astype(U64)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers, one row per set; empty sets have zeros."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([sets[i] for i in full])
    starts = np.cumsum(sizes[full]) - sizes[full]
    least = np.empty((len(full), REGISTERS))
    for j in range(REGISTERS):
        least[:, j] = np.minimum.reduceat(flat * _MUL[j] + _ADD[j], starts)
    exponential = -np.log1p(-(least + 1) / 2.0**64 * (1 - 2.0**-52)) / RATE
    out[full] = np.maximum(np.floor(1 - np.log(exponential) / math.log(B)), 0)
    return out


def band_rows(percent: int) -> int:
    """Registers in a band: as many as leave at most ``MISSED`` of the pairs unmet."""
    met = (percent / 100) ** np.arange(9.0)
    return max(r for r in (8, 5, 4, 2, 1) if r == 1 or (1 - met[r]) ** (REGISTERS // r) <= MISSED)


def band_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    bands = REGISTERS // rows
    tagged = regs.astype(U64).reshape(-1, bands, rows)
    tagged = tagged + (np.arange(bands, dtype=U64)[None, :, None] << U64(32))
    return window_hashes(tagged.reshape(-1), rows)[::rows].reshape(-1, bands)


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sketches may reach the similarity, by their joint likelihood."""
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = REGISTERS - up - down
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)
    goal = percent / 100
    grid = np.linspace(0, 1, 201)
    best = np.full(len(a), -np.inf)
    good = np.full(len(a), -np.inf)
    step = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (B - 1) / B) / math.log(B)
    for share in grid:
        j = share * top
        p, q = step(u - v * j), step(v - u * j)
        at = up * np.log(p) + down * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))
        best = np.maximum(best, at)
        good = np.where(j >= goal - 0.005, np.maximum(good, at), good)
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (good >= best - UNLIKELY)


def _sketches(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = list(shingle_sets(part.column("text")))
                regs = registers(sets)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                keys = band_keys(regs, rows).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column("_row_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                    pa.array([r.tobytes() for r in regs], pa.binary()), lists(list(keys))],
                    names=["_id", "_n", "_digest", "_regs", "_bands"])
    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = [s.tobytes() for s in shingle_sets(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("_row_id"), pa.array(sets, pa.binary())], names=["_id", "_set"])


def _unpacked(column: pa.Array, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _likely_pairs(percent: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.stack(_unpacked(batch.column(c), np.uint16)) for c in ("a_regs", "b_regs"))
                na, nb = (batch.column(c).to_numpy() for c in ("a_n", "b_n"))
                yield batch.select(["a", "b"]).filter(pa.array(likely(a, b, na, nb, percent)))
    return keep


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def _linked(shared: int, na: int, nb: int, percent: int) -> bool:
    return 100 * shared >= percent * (na + nb - shared)


def _similar_pairs(percent: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_unpacked(batch.column(c), U64) for c in ("a_set", "b_set"))
            good = [_linked(_overlap(x, y), len(x), len(y), percent) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], names=["u", "v"]).filter(pa.array(good, pa.bool_()))
    return keep


def _block_links(percent: int):
    """Links from a block's queries to its members; of each query and component the first."""
    def links(block: pa.Table) -> pa.Table:
        ids = block.column("_id").to_numpy()
        labels = block.column("_label").to_numpy()
        asks = block.column("_asks").to_numpy(zero_copy_only=False)
        sets = _unpacked(block.column("_set").combine_chunks(), U64)
        queries, members = np.flatnonzero(asks), np.flatnonzero(~asks)
        found: list[tuple[int, int]] = []
        lo = 0
        while lo < len(queries):
            hi = lo + 1
            while hi < len(queries) and sum(len(sets[q]) for q in queries[lo: hi + 1]) <= BLOCK_SHINGLES // 4:
                hi += 1
            part = queries[lo:hi]
            seen = np.unique(np.concatenate([sets[q] for q in part]))
            has = np.zeros((len(seen), len(part)), np.uint8)
            for k, q in enumerate(part):
                has[np.searchsorted(seen, sets[q]), k] = 1
            sizes = np.array([len(sets[q]) for q in part])
            done = set()
            for m in members:
                at = np.minimum(np.searchsorted(seen, sets[m]), len(seen) - 1)
                shared = has[at[seen[at] == sets[m]]].sum(0, dtype=np.int64)
                hit = (100 * shared >= percent * (sizes + len(sets[m]) - shared)) & (labels[part] != labels[m])
                for k in np.flatnonzero(hit):
                    if (k, labels[m]) not in done:
                        done.add((k, labels[m]))
                        found.append((ids[part[k]], ids[m]))
            lo = hi
        u, v = zip(*found) if found else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
    return links


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Two documents are linked if ``100 * shared >= percent * union`` of their
    lower-cased 5-word shingles (fewer words: the whole sequence).  The
    component is the least id reachable, and the document of that id is kept.

    Null and empty texts, and texts without words, link with nothing.  Rows
    without an id are their own component (null) and kept.  Rows that repeat an
    id are one document and share the decision.  An empty table gives an empty
    table; other columns are ignored.

    A text is held whole in a task, at about 40 times its bytes.
    """
    source = docs.select(F.col(id_col).cast("long").alias("_row_id"), F.col(text_col).cast("string").alias("text"))
    sketched = written_table(source.mapInArrow(
        _sketches(band_rows(percent)), "_id long, _n long, _digest binary, _regs binary, _bands array<long>"), "sketches")
    named = sketched.where("_id is not null and _n > 0")
    classes = written_table(named.groupBy("_digest").agg(
        F.min("_id").alias("_leader"), F.first("_n").alias("_n"), F.first("_regs").alias("_regs"),
        F.first("_bands").alias("_bands")), "classes")

    rows = classes.select(F.explode("_bands").alias("_key"), F.col("_leader").alias("_id"), F.col("_n").alias("_shingles")).distinct()
    picks = [F.min(F.struct(F.xxhash64("_id", F.lit(k)), F.col("_id"))).alias(f"_p{k}") for k in range(PIVOTS)]
    # What is joined back by a hot key is a table of its own: Spark may then split the join.
    sized = written_table(rows.groupBy("_key").agg(F.count("*").alias("_size"), *picks).where("_size > 1").select(
        "_key", "_size", F.array_distinct(F.array(*[F.col(f"_p{k}._id") for k in range(PIVOTS)])).alias("_pivots")), "bucket-sizes")
    buckets = written_table(rows.join(sized, "_key"), "buckets")
    few = buckets.where(F.col("_size") <= SMALL_BUCKET).groupBy("_key").agg(
        F.array_sort(F.collect_list("_id")).alias("_ids"))
    small = few.select(F.explode("_ids").alias("a"), "_ids").select(
        "a", F.explode(F.filter("_ids", lambda x: x > F.col("a"))).alias("b"))
    large = buckets.where(F.col("_size") > SMALL_BUCKET).select("_id", F.explode("_pivots").alias("_p")).where(
        "_id != _p").select(F.least("_id", "_p").alias("a"), F.greatest("_id", "_p").alias("b"))
    leaders = classes.select("_leader", "_n", "_regs")
    side = lambda c: leaders.select(F.col("_leader").alias(c), F.col("_n").alias(f"{c}_n"), F.col("_regs").alias(f"{c}_regs"))
    proposed = small.unionByName(large).distinct().join(side("a"), "a").join(side("b"), "b")
    pairs = written_table(proposed.mapInArrow(_likely_pairs(percent), "a long, b long").distinct(), "pairs")

    several = buckets.where(F.col("_size") > SMALL_BUCKET).select("_id")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("_row_id")).unionByName(
        several.withColumnRenamed("_id", "_row_id")).distinct()
    sets = written_table(
        source.join(needed, "_row_id", "left_semi").mapInArrow(_sets, "_id long, _set binary"), "sets")
    half = lambda c: sets.select(F.col("_id").alias(c), F.col("_set").alias(f"{c}_set"))
    links = written_table(pairs.join(half("a"), "a").join(half("b"), "b").mapInArrow(
        _similar_pairs(percent), "u long, v long"), "similar")
    first = written_table(components(links), "components")

    # Buckets of several components: all that are not in the largest one are held against the rest.
    labelled = buckets.where(F.col("_size") > SMALL_BUCKET).select("_key", "_id", "_shingles").join(
        first.withColumnRenamed("node", "_id"), "_id", "left").select(
        "_key", "_id", "_shingles", F.coalesce("component", "_id").alias("_label"))
    shares = labelled.groupBy("_key", "_label").agg(F.count("*").alias("_n"))
    main = written_table(shares.groupBy("_key").agg(
        F.max(F.struct("_n", "_label"))["_label"].alias("_main"), F.sum("_n").alias("_all"),
        F.max("_n").alias("_most")).where("_all > _most"), "open-buckets")
    open_rows = written_table(
        labelled.join(main, "_key").withColumn("_asks", F.col("_label") != F.col("_main")), "open")
    weight = F.col("_shingles") / F.lit(BLOCK_SHINGLES / BLOCK_MEMBERS) + 1
    weights = written_table(open_rows.groupBy("_key").agg(
        F.ceil(F.sum(weight) / BLOCK_MEMBERS).alias("_member_blocks"),
        F.ceil(F.sum(F.when(F.col("_asks"), weight)) / BLOCK_MEMBERS).alias("_query_blocks")), "bucket-weights")
    placed = open_rows.join(weights, "_key").join(sets, "_id")
    spot = lambda n, seed: F.pmod(F.xxhash64("_id", F.lit(seed)), F.col(n))
    asked = placed.where("_asks").withColumn("_q", spot("_query_blocks", 1)).withColumn(
        "_m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_member_blocks") - 1)))
    others = placed.withColumn("_asks", F.lit(False)).withColumn("_m", spot("_member_blocks", 2)).withColumn(
        "_q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_query_blocks") - 1)))
    more = asked.unionByName(others).select("_key", "_q", "_m", "_id", "_label", "_asks", "_set").groupBy(
        "_key", "_q", "_m").applyInArrow(_block_links(percent), "u long, v long")
    label = lambda c: first.select(F.col("node").alias(c), F.col("component").alias(f"{c}_label"))
    lifted = more.distinct().join(label("u"), "u", "left").join(label("v"), "v", "left").select(
        F.coalesce("u_label", "u").alias("u"), F.coalesce("v_label", "v").alias("v"))
    second = components(lifted)

    nodes = classes.select("_digest", "_leader").join(first.withColumnRenamed("node", "_leader"), "_leader", "left").select(
        "_digest", F.coalesce("component", "_leader").alias("_mid"))
    final = nodes.join(second.withColumnRenamed("node", "_mid"), "_mid", "left").select(
        "_digest", F.coalesce("component", "_mid").alias("_component"))
    part = F.when(F.col("_id").isNotNull() & (F.col("_n") > 0), F.coalesce("_component", "_id")).otherwise(F.col("_id"))
    return sketched.select("_id", "_n", "_digest").join(final, "_digest", "left").select(
        F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), part.alias("component_id"),
        F.coalesce(F.col("_id") == part, F.lit(True)).alias("kept"))
