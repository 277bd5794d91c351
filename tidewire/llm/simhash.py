"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at most 2r bits apart share a value within r bits of each. Every
distinct fingerprint therefore emits all values of its ball of radius r; the values are
shuffled, and fingerprints that meet at one are verified and linked. Any two that meet at r = 1
are within two bits by the triangle inequality, and a value has at most 65 neighbours, so a
meeting point is a bounded group however often a text was copied; linking each to the smallest
one there keeps the components whole without making all pairs.

Cases: null and word-less texts have fingerprint zero and are linked like any other; fewer words
than the shingle width make one shingle of all; repeated rows are returned each; rows without
doc_id keep their fingerprint and are never the smallest id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import spans as T
from tidewire.llm._shared import Scratch, bucketed, fresh, release, stored
from tidewire.operators.graph import components

SEED = 42


def _shingles(text: bytes, width: int) -> list[bytes]:
    w = text.lower().split()  # bytes: A-Z and ASCII white space only
    if len(w) <= width:
        return [b" ".join(w)] if w else []
    return [b" ".join(x) for x in zip(*(w[i:] for i in range(width)))]


def fingerprint(text: bytes, width: int) -> int:
    """The fingerprint of one text, as an unsigned integer."""
    return int(_fingerprints([text], width)[0])


def _fingerprints(texts: list[bytes], width: int) -> np.ndarray:
    digest, hashes, n = xxhash.xxh64_intdigest, [], []
    for t in texts:
        before = len(hashes)
        hashes.extend([digest(x, SEED) for x in _shingles(t, width)])
        n.append(len(hashes) - before)
    out = np.zeros(len(texts), np.uint64)
    n = np.array(n)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = (np.cumsum(n) - n)[full]
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > n[full][:, None], axis=1).view(">u8")[:, 0]
    return out


def with_fingerprints(documents: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_fingerprints([s.raw(i) for i in range(len(s))], width) for s in T.slices(batch.column("text"), 1 << 20)]
            values = np.concatenate(out) if out else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "fingerprint"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint long")


def ball(fingerprint: Column, radius: int) -> Column:
    """All values within `radius` bits, as an array: C(64, 0) + ... + C(64, radius) of them."""
    bits = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    masks, out = [0], [0]
    for _ in range(radius):
        masks = sorted({m ^ b for m in masks for b in bits} - set(out))
        out += masks
    return F.transform(F.array(*map(F.lit, out)), lambda m: fingerprint.bitwiseXOR(m))


def links(fingerprints: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b): verified links between distinct fingerprints, a component's worth (not all pairs)."""
    variants = fingerprints.select("fingerprint", F.explode(ball(F.col("fingerprint"), (distance + 1) // 2)).alias("value"))
    meet = variants.withColumn("b", F.min("fingerprint").over(Window.partitionBy("value")))
    pairs = meet.where("fingerprint <> b").select(F.col("fingerprint").alias("a"), "b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def near_duplicates(documents: DataFrame, width: int = 3) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id linked over at most 2 bits a step)."""
    docs = stored(with_fingerprints(documents, width))
    distinct = docs.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    root = components(links(distinct.select("fingerprint")))
    rooted = distinct.join(root.select(F.col("a").alias("fingerprint"), "b"), "fingerprint", "left").select("fingerprint", "least", F.coalesce("b", "fingerprint").alias("root"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(component, "root").select("fingerprint", "component_id")
    return docs.join(of, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


# --- one document of each near-duplicate group, at a similarity of shingle sets ------------------
#
# At a similarity of 0.8 over five-word shingles a 64-bit fingerprint differs in some ten bits, out of
# reach of a small ball, and how many depends on the kind of edit. So candidates come from the sets that are
# verified: BANDS values of ROWS minima each over the five-word shingles (a minimum agrees with
# the probability of the similarity, whatever the edit and however often a shingle repeats). Two texts
# of similarity s share no value with probability (1 - s^ROWS)^BANDS: 6e-5 at 0.8, 3e-7 at 0.85.
# Texts with a value in common are then compared exactly, in rounds, until no two of them are left
# that are neither compared nor in one component.

BANDS = 32
ROWS = 6
SIMILARITY = 0.8
#: From one round to the next, so many times more texts of a value are compared with all others of it.
MORE_LEADERS = 16
#: Texts from which a value is crowded, and the owners up to which a shingle there is listed rather than counted as common to all.
CROWD, FEW = 64, 8
#: Pairs of one text that a task compares.
DEALT = 256


def _set_hashes(s: T.Slice, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text of a slice (lower-cased), and where each text's begin."""
    data = _LOWER[s.data]
    w = T.words(data, s.offsets)
    hashes = T.span_hashes(data, w.starts, w.ends)
    n = w.counts
    grams = T.gram_hashes(hashes, width)
    owner = w.owner()
    inside = np.flatnonzero(owner[: len(grams)] == owner[width - 1 :]) if len(grams) else np.zeros(0, np.int64)
    values, text = grams[inside], owner[inside]
    short = np.flatnonzero((n > 0) & (n < width))
    whole = [T.gram_hashes(hashes[w.off[i] : w.off[i + 1]], int(n[i]))[0] for i in short]
    values, text = np.concatenate([values, np.array(whole, np.uint64)]), np.concatenate([text, short])
    order = np.argsort(text, kind="stable")
    return values[order], np.searchsorted(text[order], np.arange(len(s) + 1))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text -> key and the values of its BANDS bands."""
    odd = T.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    for batch in batches:
        made = [np.zeros((0, BANDS), np.int64)]
        for s in T.slices(batch.column("text"), 1 << 19):
            values, off = _set_hashes(s, 5)
            full = np.flatnonzero(np.diff(off))
            out = np.zeros((len(s), BANDS), np.uint64)
            turned = np.empty_like(values)
            for j in range(BANDS * ROWS if len(full) else 0):
                np.multiply(values, odd[j], out=turned)
                out[full, j // ROWS] += T.mix(np.minimum.reduceat(turned, off[:-1][full]) + odd[j])
            made.append(T.mix(out + np.arange(BANDS, dtype=np.uint64)).view(np.int64))
        rows = np.concatenate(made)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS), pa.array(rows.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column("key"), lists], names=["key", "bands"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text -> key and the set of its five-word shingles' hashes."""
    for batch in batches:
        sets = []
        for s in T.slices(batch.column("text")):
            values, off = _set_hashes(s, 5)
            sets += [np.unique(values[a:b]).view(np.int64) for a, b in zip(off, off[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sets, pa.list_(pa.int64()))], names=["key", "shingles"])


def _can_reach(similarity: float, common, size, other=0) -> Column:
    """Whether sets of so many members, at most `common` of them shared, can be as similar as asked."""
    return common >= similarity * (size + other - common)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b, lead: the one of the two that many pairs may have) whose shingle sets are as similar as asked (two empty sets are).

    The pairs of one text are dealt over as many tasks as they need, with a copy of its set for each.
    """
    member = F.when(F.col("lead") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    hot = scratch.store(pairs.groupBy("lead").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("salts")).where("salts > 1"))
    salts = F.coalesce("salts", F.lit(1))
    dealt = pairs.join(hot, "lead", "left").select("a", "b", "lead", member.alias("member"), F.pmod(F.xxhash64("a", "b"), salts).cast("int").alias("salt"))
    leads = sets.join(pairs.select(F.col("lead").alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias("lead"), F.col("shingles").alias("y"))
    copies = leads.join(hot, "lead", "left").select("lead", "y", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    both = dealt.join(sets.select(F.col("key").alias("member"), F.col("shingles").alias("x")), "member").join(copies, ["lead", "salt"])
    return both.where(_can_reach(similarity, F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b")


def _possible(members: DataFrame, sets: DataFrame, similarity: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Members (value, key, n, most) that can be similar to any other, and pairs (a, b) to compare besides.

    Of its n shingles a text shares at most those that another one has: a shingle of one text alone counts against it. So this costs one
    count of shingles and drops no similar pair. Where many texts share a value, `most` is tighter: two texts without a common
    shingle of at most FEW owners share at most the other ones; and those with one are listed by a join on these
    shingles, which has at most FEW texts to a shingle.
    """
    each = scratch.store(sets.select("key", F.explode("shingles").alias("s")))
    owners = scratch.store(each.groupBy("s").agg(F.count("*").alias("owners"), F.min("key").alias("key")).where(F.col("owners") <= FEW))
    alone = owners.where("owners = 1").groupBy("key").agg(F.count("*").alias("own"))
    facts = sets.select("key", F.size("shingles").alias("n")).join(alone, "key", "left").select("key", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("most"))
    facts = scratch.store(facts.where(_can_reach(similarity, F.col("most"), F.col("n"), F.col("most"))))
    left = scratch.store(members.select("value", "key").join(facts, "key"))
    sizes = scratch.store(left.groupBy("value").agg(F.count("*").alias("size")).where("size > 1"))
    left = scratch.store(left.join(sizes, "value"))
    few = scratch.store(each.join(owners.where("owners > 1").select("s"), "s"))
    few = scratch.store(few.join(left.where(F.col("size") > CROWD).select("key", "n", "most").distinct(), "key"))
    common = scratch.store(few.groupBy("key", "n", "most").agg(F.count("*").alias("own")).select("key", "n", (F.col("most") - F.col("own")).alias("common")))
    one, other = (few.select("s", F.col("key").alias(x)) for x in "ab")
    shared = one.join(other, "s").where("a > b").groupBy("a", "b").agg(F.count("*").alias("few"))
    for x in "ab":
        shared = shared.join(common.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("common").alias(f"common_{x}")), x)
    pairs = shared.where(_can_reach(similarity, F.col("few") + F.least("common_a", "common_b"), F.col("n_a"), F.col("n_b"))).select("a", "b")
    most = F.when(F.col("size") > CROWD, F.coalesce("common", "most")).otherwise(F.col("most"))
    return scratch.store(left.join(common.select("key", "common"), "key", "left").select("value", "key", "n", most.alias("most"))), pairs


def _linked(members: DataFrame, known: DataFrame, sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Components (a, b) of the similar texts among those that share a value; `members` has (value, key, n, most), `sets` (key, shingles).

    `known` are pairs to compare besides, in the first round.

    Each round compares some texts of a value, its leaders, with all others of it that are in another component and can
    be similar, and takes the leaders out. Values whose texts are in one component are done. Leaders are the texts with the
    smallest share of shingles of their own (so the original rather than an edited copy), one of a value at first, then
    MORE_LEADERS times more each round, outside the value's largest component: so a large group of copies is tied to few texts,
    and whoever a leader rejected is compared with the others.
    """
    compared = verified = root = None
    slices = 1
    edited = (F.col("n") - F.col("most")) / F.greatest("n", F.lit(1))
    leader = F.min(F.struct(edited.alias("edited"), "key", "root", "n", "most")).alias("x")
    before = None
    while True:
        step, mine = Scratch(scratch.spark), Scratch(scratch.spark)  # what one round needs, and the members it leaves to the next
        if root is None:
            at = members.withColumn("root", F.col("key"))
            chosen = at.groupBy("value").agg(leader)
        else:
            at = step.store(members.join(root.select(F.col("a").alias("key"), F.col("b").alias("root")), "key", "left").select("value", "key", "n", "most", F.coalesce("root", "key").alias("root")))
            most = at.groupBy("value", "root").agg(F.count("*").alias("n")).groupBy("value").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root"))["root"].alias("largest"))
            most = step.store(most.where("roots > 1").select("value", "largest"))
            at = step.store(at.join(most, "value"))
            chosen = at.where("root <> largest").groupBy("value", F.pmod(F.xxhash64("key"), F.lit(slices)).alias("slice")).agg(leader)
        chosen = step.store(chosen.select("value", F.col("x.key").alias("leader"), F.col("x.root").alias("own"), F.col("x.n").alias("m"), F.col("x.most").alias("least")))
        if root is not None and chosen.isEmpty():
            for x in (step, before):
                x.clear()
            return root
        near = (F.col("root") != F.col("own")) & _can_reach(similarity, F.least("most", "least"), F.col("n"), F.col("m"))
        pairs = at.join(chosen, "value").where(near).select(F.greatest("key", "leader").alias("a"), F.least("key", "leader").alias("b"), F.col("leader").alias("lead"))
        pairs = (pairs.unionByName(known.withColumn("lead", F.col("b"))) if root is None else pairs).groupBy("a", "b").agg(F.min("lead").alias("lead"))
        pairs = scratch.store(pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti"))
        similar = scratch.store(_verified(pairs, sets, similarity, step))
        compared = pairs.select("a", "b") if compared is None else compared.unionByName(pairs.select("a", "b"))
        verified = similar if verified is None else verified.unionByName(similar)
        root = components(verified)
        members = mine.store(at.select("value", "key", "n", "most").join(chosen.select("value", F.col("leader").alias("key")), ["value", "key"], "left_anti"))
        slices *= MORE_LEADERS
        for x in (step, before):
            if x:
                x.clear()
        before = mine
        release(scratch.spark)


def one_of_each(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents (all columns) with the smallest doc_id of each group of near-duplicates, one row each; rows without doc_id count last."""
    row, key = fresh(documents, "row", "key")
    text = F.coalesce("text", F.lit(""))
    scratch = Scratch(documents.sparkSession)
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = bucketed(documents.withColumns({key: F.xxhash64(text), row: F.xxhash64(text, F.lit("/"), F.col("doc_id"))}).repartition(n, row), row)
    base = docs.select(F.col(key).alias("key"), F.col(row).alias("row"), "doc_id", text.alias("text"))

    # of equal texts one is looked at: the row with the smallest id
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    of_key = scratch.store(base.groupBy("key").agg(first.alias("x")).select("key", "x.none", "x.doc_id", "x.row"))
    # rows that repeat id and text stand in one bucket, so dropping them shuffles nothing
    alone = base.join(of_key.select("row"), "row", "left_semi").select("key", "row", "text").dropDuplicates(["row"])
    bands = scratch.store(alone.select("key", "text").mapInArrow(_bands, "key long, bands array<long>")).select("key", F.explode("bands").alias("value"))
    shared = bands.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    members = scratch.store(bands.join(shared, "value"))
    met = members.select("key").distinct()
    sets = scratch.bucketed(alone.select("key", "text").join(met, "key", "left_semi").mapInArrow(_shingle_sets, "key long, shingles array<long>"), "key")
    root = _linked(*_possible(members, sets, similarity, scratch), sets, similarity, scratch)
    grouped = of_key.join(root.select(F.col("a").alias("key"), F.col("b").alias("root")), "key", "left")
    keep = stored(grouped.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min(F.struct("none", "doc_id", "row")).alias("x")).select(F.col("x.row").alias(row)))
    scratch.clear()
    kept = docs.join(keep, row, "left_semi")
    # rows that repeat id and text are equal here; one of them stays
    repeated = kept.groupBy(row).agg(F.count("*").alias("n")).where("n > 1").select(row)
    columns = [F.col(f"`{c}`") for c in documents.columns]
    once = kept.join(repeated, row, "left_anti").select(*columns)
    return once.unionByName(kept.join(repeated, row, "left_semi").dropDuplicates([row]).select(*columns))
