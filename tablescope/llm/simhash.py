"""SimHash near-duplicates with vantage-point partitioning.

A document's fingerprint is the bitwise majority of the XXH64 values of its word shingles. Documents with the same
fingerprint form a class; classes link when at most ``radius`` bits differ, and linked classes form a component.

The links come from a vantage-point tree over all distinct fingerprints. At each level the distance ``d`` to a vantage
point splits a node at a threshold ``mu`` into an inside and an outside. By the triangle bound, a pair across the split
within ``radius`` has both ends within ``radius`` of the threshold, so only the two boundary bands meet again, in a
third (crossing) child that compares inside with outside. Every pair therefore meets in exactly one leaf, whatever the
vantage points are; they only decide the balance. A leaf ends where its expected size is small, so the number of leaves
follows the number of fingerprints. Leaves that turn out larger are cut into blocks that are compared block by block.

Defined results: a null or empty text has fingerprint zero and links like any other; repeated rows stay, one result
row each; a component's id ignores null ids and is null if there are only such; an empty table gives an empty result;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import encoded, map_batches, staged

SEED = 42
SAMPLE = 4096  # fingerprints that choose the vantage points and thresholds
LEAF = 16_000  # expected fingerprints of a leaf that compares with itself; crossing leaves hold twice as many
BLOCK = 40_000  # leaves above this are compared block by block


def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint as an unsigned number."""
    words = encoded(text).lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    stops = (ends - 1)[width - 1 :].tolist()
    votes = np.zeros(64, np.int64)
    n = len(starts)
    for at in range(0, n, 65_536):
        pairs = zip(starts[at : at + 65_536], stops[at : at + 65_536], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long, one row for each row of ``docs``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(x) for x in batch.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long", work)


@dataclass(frozen=True)
class Level:
    """A vantage point, its threshold, and the shares of the inside, the outside and their boundary bands."""

    vantage: int
    mu: int
    shares: tuple[float, float, float, float]


def plan_levels(sample: np.ndarray, total: int, radius: int, leaf: int = LEAF) -> list[Level]:
    """Vantage points for ``total`` fingerprints, from a bounded sample of them.

    Each level takes the candidate whose best threshold leaves the least work: the squares of the children's shares.
    """
    levels: list[Level] = []
    size = float(total)
    rng = np.random.default_rng(SEED)
    while size > leaf and len(levels) < 30 and len(sample):
        best = None
        for vantage in rng.choice(sample, 8):
            d = np.bitwise_count(sample ^ vantage)
            for mu in {int(np.quantile(d, q)) for q in (0.4, 0.5, 0.6)}:
                shares = (
                    float((d <= mu).mean()),
                    float((d > mu).mean()),
                    float(((d <= mu) & (d > mu - radius)).mean()),
                    float(((d > mu) & (d <= mu + radius)).mean()),
                )
                work = shares[0] ** 2 + shares[1] ** 2 + 2 * shares[2] * shares[3]
                if best is None or work < best[0]:
                    best = (work, Level(int(vantage), mu, shares))
        levels.append(best[1])
        size *= max(best[1].shares[:2])
    return levels


def route(fps: np.ndarray, levels: list[Level], total: int, radius: int, leaf: int = LEAF):
    """The leaves each fingerprint goes to: arrays of leaf code, role and fingerprint.

    A code holds two bits a level: inside, outside, or one of the two crossings. Role 0 compares with all of its leaf,
    roles 1 and 2 with each other. A node ends when its expected size, which follows from its code, is small. A crossing
    node saves half the comparisons by a split that moves as many rows, so it ends at twice the size.
    """
    code = np.ones(len(fps), np.int64)
    role = np.zeros(len(fps), np.int8)
    expect = np.full(len(fps), float(total))
    done = []
    for level in levels:
        open_ = expect > np.where(role == 0, leaf, 2 * leaf)
        done.append((code[~open_], role[~open_], fps[~open_]))
        fps, code, role, expect = fps[open_], code[open_], role[open_], expect[open_]
        d = np.bitwise_count(fps ^ np.uint64(level.vantage)).astype(np.int64)
        outside = d > level.mu
        inner, outer, inner_band, outer_band = level.shares
        band = np.where(outside, d <= level.mu + radius, d > level.mu - radius)
        # In a crossing child the inside of a self-comparison has role 1, its outside role 2; later roles stay.
        as_role = np.where(role == 0, np.where(outside, 2, 1), role).astype(np.int8)
        crossing = np.where(role == 0, 2, np.where((role == 2) == outside, 2, 3))
        stay = (code * 4 + outside, role, fps, expect * np.where(outside, outer, inner))
        cross = (code * 4 + crossing, as_role, fps, expect * (inner_band + outer_band) / np.where(role == 0, 1, 2))
        code, role, fps, expect = (np.concatenate([a, b[band]]) for a, b in zip(stay, cross, strict=True))
    done.append((code, role, fps))
    return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def linked(fps: np.ndarray, role: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one leaf as stars: fingerprints, and the smallest fingerprint each is connected to here."""
    a = np.flatnonzero(role < 2)
    b = np.flatnonzero(role != 1)
    label = np.arange(len(fps))
    if len(a) == 0 or len(b) == 0:
        return fps[:0], fps[:0]
    right = fps[b]
    step = max(1, 2_000_000 // len(b))
    for at in range(0, len(a), step):
        rows = a[at : at + step]
        i, j = np.nonzero(np.bitwise_count(fps[rows][:, None] ^ right[None, :]) <= radius)
        i, j = rows[i], b[j]
        while True:
            x, y = label[i], label[j]
            apart = x != y
            if not apart.any():
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    moved = label != np.arange(len(fps))
    return fps[moved], fps[label[moved]]


def class_links(classes: DataFrame, radius: int = 3, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """``fp, other``: links that connect the same classes as all pairs of fingerprints within ``radius`` bits.

    ``classes`` has one row for each fingerprint. In a leaf, every fingerprint is tied to one that it reaches there,
    so a dense group leaves a row for each member and not one for each pair.
    """
    total = classes.count()
    picked = classes.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64)
    levels = plan_levels(picked.view(np.uint64), total, radius, leaf)

    def routed(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        code, role, fps = route(fps, levels, total, radius, leaf)
        return pa.RecordBatch.from_arrays(
            [pa.array(code), pa.array(role.astype(np.int32)), pa.array(fps.view(np.int64))], ["leaf", "role", "fp"]
        )

    tree = staged(map_batches(classes.select("fp"), "leaf long, role int, fp long", routed), "tree")
    large = (
        tree.groupBy("leaf")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > block)
        .select("leaf", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    # A cell compares two blocks of a large leaf. Self-comparing rows meet their own block, and each other block once.
    own, numbers = F.col("own"), F.sequence(F.lit(0), F.col("blocks") - 1)
    with_all = F.transform(
        numbers,
        lambda k: F.struct(
            F.least(own, k).alias("i"),
            F.greatest(own, k).alias("j"),
            F.when(k == own, 0).when(own < k, 1).otherwise(2).alias("role"),
        ),
    )
    across = F.transform(
        numbers,
        lambda k: F.struct(
            F.when(F.col("role") == 1, own).otherwise(k).alias("i"),
            F.when(F.col("role") == 1, k).otherwise(own).alias("j"),
            F.col("role").alias("role"),
        ),
    )
    cut = (
        tree.join(large, "leaf")
        .withColumn("own", F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("blocks")).cast("int"))
        .select("leaf", "fp", F.explode(F.when(F.col("role") == 0, with_all).otherwise(across)).alias("c"))
        .select("leaf", "c.i", "c.j", "c.role", "fp")
    )
    whole = tree.join(large, "leaf", "left_anti").select("leaf", F.lit(0).alias("i"), F.lit(0).alias("j"), "role", "fp")

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        fps, other = linked(pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["role"].to_numpy(), radius)
        return pd.DataFrame({"fp": fps.view(np.int64), "other": other.view(np.int64)})

    return whole.union(cut).groupBy("leaf", "i", "j").applyInPandas(compared, "fp long, other long")


def components(links: DataFrame) -> DataFrame:
    """``fp, root`` for every linked fingerprint; the root is the same throughout a component.

    Alternates the large-star and small-star steps until the links stop changing; each round is written to the shared
    folder. Both steps only need the smallest neighbour of a node, so a large star is combined before the shuffle.
    """
    edges = staged(
        links.select(F.greatest("fp", "other").alias("u"), F.least("fp", "other").alias("v"))
        .filter(F.col("u") != F.col("v"))
        .distinct(),
        "links",
    )
    state = None
    while True:
        both = edges.select("u", "v").union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = (
            both.filter(F.col("v") > F.col("u"))
            .join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = staged(
            edges.join(low, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .filter(F.col("u") != F.col("v"))
            .distinct(),
            "links",
        )
        row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if tuple(row) == state:
            return edges.select(F.col("u").alias("fp"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct()
            )
        state = tuple(row)


def grouped(
    docs: DataFrame, radius: int = 3, leaf: int = LEAF, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, fp, root, component_id`` for each row of ``docs``; the root tells components apart that share an id."""
    prints = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    member = staged(components(class_links(classes, radius, leaf, block)), "members")
    smallest = (
        member.join(classes, "fp").groupBy("root").agg(F.min("first_id").alias("component_id"))
    )
    found = classes.join(member.join(smallest, "root").select("fp", "root", "component_id"), "fp", "left")
    found = found.select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first_id").alias("component_id")
    )
    # Two plain tables meet, so that the rows of one fingerprint with very many copies can be split over tasks.
    found = staged(found, "components")
    return prints.join(found, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame, radius: int = 3, leaf: int = LEAF, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``."""
    return grouped(docs, radius, leaf, block, id_col, text_col).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
