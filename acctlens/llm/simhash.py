"""SimHash near-duplicates of documents by multi-index hashing.

A 64-bit fingerprint is cut into two 32-bit segments. Of two fingerprints that differ in at most
three bits, one segment differs in at most one bit, so looking up the radius-one Hamming ball of
each segment in a table of segments finds every such pair; whole distances are then verified.
Of the ball only the members that set a clear bit are looked up: the partner looks up the rest.

Segments shared by very many fingerprints are looked up at a second level, by the radius-one balls of
the two halves of the other segment, so that no bucket is ever compared with itself pair by pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, slices, table
from .components import components

#: Segments held by more fingerprints than this are looked up at the second level.
HOT_SEGMENT = 512
_LOW = 0xFFFFFFFF


def simhash(text: bytes | None, width: int = 3) -> int:
    """Fingerprint of one text (UTF-8): a bit is set where over half of the shingles' XXH64 (seed 42) set it.

    A-Z is lower-cased; words are runs without ASCII white space. With fewer words than `width` the
    whole sequence is the one shingle; without words the fingerprint is zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.zeros(len(words), np.int64)
    np.cumsum(size[:-1], out=start[1:])
    end = (start + size - 1)[width - 1 :] if len(words) >= width else np.array([len(data)])
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[a:b], 42) for a, b in zip(start.tolist(), end.tolist())), np.uint64, len(end))
    bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 16384):
        part = h[i : i + 16384].astype(">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(h)).tobytes(), "big")


def _fingerprint_batches(batches):
    for batch in batches:
        for b in slices(batch, 1 << 20):
            fp = np.array([simhash(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long. A null text counts as empty."""
    pairs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return pairs.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _segments(fps: DataFrame) -> DataFrame:
    """A row for each fingerprint and segment: seg, key (the segment), rest (the other one)."""
    high = F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit(_LOW))
    low = F.col("fp").bitwiseAND(F.lit(_LOW))
    both = F.array(F.struct(F.lit(0).alias("seg"), high.alias("key"), low.alias("rest")), F.struct(F.lit(1).alias("seg"), low.alias("key"), high.alias("rest")))
    return fps.select("node", F.explode(both).alias("s")).select("node", "s.*")


def _ball(column, bits: int):
    """The column and its values with one more bit set (clear bits only), as an array."""
    masks = F.array(*[F.lit(1 << i).cast("long") for i in range(bits)])
    up = F.transform(F.filter(masks, lambda m: column.bitwiseAND(m) == 0), lambda m: column.bitwiseOR(m))
    return F.concat(F.array(column), up)


def _full_ball(column, bits: int):
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(bits)])
    return F.transform(masks, lambda m: column.bitwiseXOR(m))


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of nodes whose fingerprints differ in at most three bits.

    fps: (node, fp), one row for each fingerprint.
    """
    index = materialize(_segments(fps), "simhash-index")
    probes = index.select("seg", F.col("node").alias("p_node"), F.col("key").alias("p_key"), F.col("rest").alias("p_rest"), F.explode(_ball(F.col("key"), 32)).alias("key"))
    crowded = materialize(index.groupBy("seg", "key").count().filter(F.col("count") > HOT_SEGMENT).select("seg", "key"), "simhash-crowded")
    whole = F.bit_count(F.col("key").bitwiseXOR(F.col("p_key"))) + F.bit_count(F.col("rest").bitwiseXOR(F.col("p_rest")))
    distinct = (F.col("node") != F.col("p_node")) & ~((F.col("key") == F.col("p_key")) & (F.col("node") < F.col("p_node")))
    pair = [F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")]
    if crowded.isEmpty():
        found = index.hint("merge").join(probes, ["seg", "key"])
        return found.filter(distinct & (whole <= 3)).select(*pair).distinct()
    plain = index.join(crowded, ["seg", "key"], "left_anti").join(probes, ["seg", "key"])
    # The other segment differs in at most three bits, so one of its halves differs in at most one.
    halves = F.array(
        F.struct(F.lit(0).alias("half"), F.shiftright("rest", 16).alias("sub")),
        F.struct(F.lit(1).alias("half"), F.col("rest").bitwiseAND(F.lit(0xFFFF)).alias("sub")),
    )
    held = index.join(crowded, ["seg", "key"], "left_semi").select("*", F.explode(halves).alias("h")).select("seg", "key", "rest", "node", "h.*")
    asked = probes.join(crowded, ["seg", "key"], "left_semi")
    p_halves = F.array(
        F.struct(F.lit(0).alias("half"), _full_ball(F.shiftright("p_rest", 16), 16).alias("subs")),
        F.struct(F.lit(1).alias("half"), _full_ball(F.col("p_rest").bitwiseAND(F.lit(0xFFFF)), 16).alias("subs")),
    )
    asked = asked.select("*", F.explode(p_halves).alias("h")).select("seg", "key", "p_node", "p_key", "p_rest", "h.half", F.explode("h.subs").alias("sub"))
    dense = held.join(asked, ["seg", "key", "half", "sub"])
    cols = ["node", "key", "rest", "p_node", "p_key", "p_rest"]
    return plain.select(cols).union(dense.select(cols)).filter(distinct & (whole <= 3)).select(*pair).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each input row.

    component_id is the smallest doc_id that can be reached over links of at most three differing bits.
    Null and empty texts have fingerprint zero and are linked like any other; rows with a null doc_id get
    a null component_id and join none; repeated rows are returned as often as they occur; an empty table
    gives an empty result. Further columns of docs are ignored.
    """
    marked = materialize(fingerprints(docs), "simhash-fp")
    classes = materialize(marked.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-classes")
    reached = components(links(classes))
    named = classes.hint("merge").join(reached, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    out = marked.hint("merge").join(named, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
