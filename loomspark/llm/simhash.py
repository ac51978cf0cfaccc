"""Operator 4, SimHash near-dedup with pigeonring filtering.

A document's fingerprint is the majority bit of the XXH64 hashes of its 3-word shingles. Two
fingerprints link when at most three bits differ. Candidates come from the strong pigeonring
principle: with the 64 bits in a ring of four 16-bit segments and a budget of three differences, some
segment starts a chain whose first l segments differ in at most floor(3 l / 4) bits, so 0, 1, 2 and 3.
The first segment of such a chain is equal and the next differs in one bit at most, so one of its two
halves is equal too: eight 24-bit join keys find every link. Longer chains prune candidates before the
full Hamming check.

Defined cases: a null text counts as empty; texts without words have fingerprint zero and link like any
other; a null doc_id gets a fingerprint and takes no part in links; repeated rows are returned as often
as they came; ids of any size are kept exactly; of equal fingerprints the smallest doc_id stands for all; very
long texts are read whole, their votes counted in blocks; an empty table gives an empty result; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import drop_ids, one_row_per_id, read, settle
from loomspark.llm.graph import connected_components

#: Keys with more fingerprints than this are dealt anew by further bits.
BUCKET = 256
#: Other ways to cut the 64 bits into four blocks; of any four, a pair within three bits shares one whole.
CUTS = [
    [sum(1 << b for b in range(64) if b % 4 == k) for k in range(4)],
    [sum(1 << b for b in range(64) if b // 4 % 4 == k) for k in range(4)],
]


def fingerprint(text: str | None, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z fold, only \x09-\x0D and space split
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < 3:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends[:-1]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[2:])]
    counts = np.zeros(64, dtype=np.int64)
    array = np.array(hashes, dtype="<u8")
    for at in range(0, len(array), 65_536):
        block = array[at : at + 65_536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py()) for x in batch.column("text")]
            signed = pa.array([x - (1 << 64) if x >> 63 else x for x in fps], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), signed], ["doc_id", "fp"])  # ids never leave Arrow

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _segment(k: int) -> str:
    return f"(shiftrightunsigned(fp, {16 * (k % 4)}) & 65535)"


def _keyed(nodes: DataFrame) -> DataFrame:
    """(node, fp, seg, key): for each segment, the segment with each half of the next."""
    keys = ", ".join(f"named_struct('seg', {k}, 'key', {2 * k + h} * 16777216L + {_segment(k)} * 256 + (shiftrightunsigned({_segment(k + 1)}, {8 * h}) & 255))" for k in range(4) for h in range(2))
    return nodes.select("node", "fp", F.expr(f"inline(array({keys}))"))


def hamming_links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between nodes(node, fp) with distinct fp that differ in three bits or fewer; all of them."""
    rows, joined = _keyed(nodes), []
    for cut in [*CUTS, None]:
        if cut is None:
            joined.append(rows)
            break
        counts = rows.groupBy("key").count()
        hot = settle(counts.where(f"count > {bucket}").select("key"))
        if hot.isEmpty():
            joined.append(rows)
            break
        joined.append(rows.join(hot, "key", "left_anti"))
        blocks = ", ".join(f"xxhash64(key, {k}, fp & {m if m < 1 << 63 else m - (1 << 64)}L)" for k, m in enumerate(cut))
        rows = rows.join(hot, "key", "left_semi").select("node", "fp", "seg", F.expr(f"explode(array({blocks}))").alias("key"))
    pairs = None
    for part in joined:
        a, b = part.select(F.col("node").alias("a"), F.col("fp").alias("fa"), "seg", "key"), part.select(F.col("node").alias("b"), F.col("fp").alias("fb"), F.col("seg").alias("seg_b"), F.col("key").alias("key_b"))
        x = "(fa ^ fb)"
        turned = f"(shiftrightunsigned({x}, 16 * seg) | shiftleft({x}, 64 - 16 * seg))"  # shifts count modulo 64
        chains = [f"bit_count({turned} & {(1 << 16 * n) - 1}L) <= {3 * n // 4}" for n in (1, 2, 3)]
        found = a.join(b, (a["key"] == b["key_b"]) & (a["seg"] == b["seg_b"]) & (a["fa"] < b["fb"]) & F.expr(" and ".join([*chains, f"bit_count({x}) <= 3"])))
        found = found.select("a", "b")
        pairs = found if pairs is None else pairs.union(found)
    return pairs.distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs; component_id is the smallest doc_id linked, itself included."""
    prints = settle(fingerprints(docs))
    groups = settle(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    comps = connected_components(hamming_links(groups))
    named = groups.join(comps, "node", "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, prints["fp"] == named["_fp"], "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest doc_id. Rows without doc_id stay."""
    gone = near_duplicates(docs).where("component_id <> doc_id").select("doc_id")
    return one_row_per_id(drop_ids(docs, gone))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
