"""N-gram Jaccard join with PartEnum signatures, and the components of its links.

A text's set are the hashes of its word n-grams. Sizes are cut into bands; a set signs for its own band and, if a larger
partner may lie in the next one, for that too. A band has a number k that bounds the symmetric difference of any
linked pair. The hashed domain is dealt to n1 parts, each of n2 smaller ones; a set's signature for a part and a choice
of n2 - 1 of its smaller parts is the hash of its members there. As a pair differs in at most k places, some part holds
at most one difference, and one choice leaves that place out: the pair shares a signature.

More can be said. A place in which two sets differ spoils, at worst, one signature more of a set; so sets that differ in at
most k' places agree in 2 n1 - k' signatures or more, and the size of one set alone bounds k' for all its partners. Its
slack is what is left of those agreements, less one, when its signatures of no members are taken out (they say nothing
and are not passed on, unless the slack is negative). ``spare`` parts more than needed give slack. It is spent twice:

- A set that shares no more of its signatures than its slack, with sets of other components, is linked with none of
  them: it leaves. Then others may share less, and leave too.
- At last, sets leave the signatures that very many share, if these are no more than the slack: a link of theirs shows in
  a signature that is not crowded, which its partner keeps too.

No link is lost. What stays in crowded groups are sets that are crowded nearly everywhere, such as large groups of near
copies.

Copies (equal sets) are one class. Before signatures meet, each class is compared with a lead for each of a few of its
members: the class that leads all those whose least member in one range of the hashes is the same. What links there is
one component, so a group of n near copies costs about n checks, and signatures within one component go no further. All
other groups are searched for pairs of classes of different components: classes carry the parities of hashed buckets of
their members, of which no more can differ than members do, and only pairs that this does not rule out leave the group,
to be checked exactly on their texts. A place of many such pairs gives a few of each class at a time; what they link is one
component then, only places that hold pairs back have another turn, and the last turn gives all that are left. No pair of different components that shares a signature is left
untested; leads decide on cost alone.

A signature that very many classes share does not gather them in one task: a task that has signed more than LOCAL
classes alike sends one of them to where signatures meet, and the others, known to be crowded, their own way.

Members are 64-bit hashes of n-grams of word hashes; a class is named by 64 bits, and a second name of 64 bits tells
whether two sets share the first, in which case both are named anew. So sets are told apart by 128 bits, and members are
only ever compared within a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.components import components
from terrane.llm.tables import LOCAL, apart, dropped, salted_join, scratch, settled, unused, written
from terrane.llm.text import bytes_of, crowded, gram_hashes, lean, lower_ascii, mix, slices, word_hashes, word_spans

#: Width of a band of sizes (largest over smallest), in hundredths; smaller parts of a part for large and small sets.
BAND, FEW_PARTS, MORE_PARTS, MORE_BELOW = 140, 2, 3, 64
#: Parts to spare: one for each so many parts.
SPARE_SHARE = 8
#: Rounds in which sets that share too little leave, and the share of rows that a round must take out for another one.
ROUNDS, YIELD = 4, 0.1
#: Classes that a task remembers having signed; classes of a group from which it counts as crowded; signatures that a
#: task holds before they go on.
SEEN, CROWDED, HELD = 500_000, 8, 1 << 18
#: Ranges of the hashes whose least members give a class its leads.
RANGES = 8
#: Classes of a group that are compared in one task, and pairs of one class; larger ones are cut to blocks.
BLOCK = 256
#: Pairs that a class leaves a group with in one turn, and turns; the last one holds nothing back.
EACH, TURNS = 2, 4
#: Parts that the crowded groups of one lead are dealt to.
DEALT = 4
#: Low bits of a signature that hold its band.
BAND_BITS = 7
#: Rows up to which a side is sent to all tasks (some 30 bytes each).
MOST = 1_000_000
_SALT = np.random.default_rng(77).integers(1, 2**63, 64, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-grams of each text of a slice; all its words as one if there are fewer than n."""
    data = lower_ascii(data)
    starts, ends, words = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    grams = gram_hashes(hashes, n)
    out = []
    for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(mix(gram_hashes(hashes[a:b], b - a) + _SALT[b - a :][:1]) if b > a else grams[:0])
    return out


def _name(members: np.ndarray, which: int) -> int:
    total = mix(members ^ _SALT[which]).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total + np.uint64(len(members))).view(np.int64)[0]) if len(members) else 0


def identity(members: np.ndarray, shared: frozenset[int] = frozenset()) -> tuple[int, int]:
    """Two 64-bit names of a set, the same for equal sets; mixed members are summed, so order does not matter. ``shared``
    are the first names that several sets have, which are named by both names together."""
    first, second = _name(members, 1), _name(members, 4)
    if first in shared:
        both = mix(np.array([first, second], np.int64).view(np.uint64))
        first = int(mix(both[:1] + both[1:] * _SALT[5]).view(np.int64)[0])
    return first, second


def leading(members: np.ndarray) -> np.ndarray:
    """The least member in each of RANGES equal ranges of the hashes, where there is one."""
    at = np.searchsorted(members, (np.arange(RANGES, dtype=np.uint64) << np.uint64(61)).astype(np.uint64))
    return np.unique(members[at[at < len(members)]])


@dataclass(frozen=True)
class Scheme:
    """Bands of sizes for links of at least num / den."""

    num: int
    den: int

    def bounds(self) -> list[int]:
        """First sizes of the bands, as far as sizes go."""
        out = [1]
        while out[-1] < 1 << 40:
            out.append(max(out[-1] + 1, out[-1] * max(BAND * self.num, 100 * self.den) // (100 * self.num)))
        return out

    def band_of(self, size: int, bounds: list[int]) -> int:
        return int(np.searchsorted(bounds, size, "right")) - 1

    def differences(self, band: int, bounds: list[int]) -> int:
        """The most places in which two linked sets of at most the band's largest size differ."""
        largest = bounds[band + 1] - 1
        return (self.den - self.num) * 2 * largest // (self.den + self.num)

    def parts(self, band: int, bounds: list[int]) -> int:
        """n1, with the parts to spare."""
        least = self.differences(band, bounds) // 2 + 1
        return least + least // SPARE_SHARE

    def slack(self, size: int, band: int, bounds: list[int]) -> int:
        """Agreements of a set of this size with any linked one, less one."""
        most = min(self.differences(band, bounds), (self.den - self.num) * size // self.num)
        return 2 * self.parts(band, bounds) - most - 1

    def bands(self, size: int, bounds: list[int]) -> list[int]:
        own = self.band_of(size, bounds)
        reaches = size * self.den >= self.num * bounds[own + 1]
        return [own, own + 1] if reaches else [own]


def signatures(members: np.ndarray, scheme: Scheme, bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of one set, and beside each the slack of the set in its band. A band whose sets can only be linked
    if equal gives none: equal sets are one class."""
    out, slacks = [], []
    for band in scheme.bands(len(members), bounds):
        if not scheme.differences(band, bounds):
            continue
        n1, n2 = scheme.parts(band, bounds), MORE_PARTS if bounds[band] < MORE_BELOW else FEW_PARTS
        # Part and smaller part of each member, from the high bits of one mixed hash.
        spread = mix(members + _SALT[2:3] * np.array([band + 1], np.uint64))
        part = ((spread >> np.uint64(32)) * np.uint64(n1 * n2) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(n1 * n2, np.uint64)
        np.add.at(sums, part, mix(spread ^ _SALT[3]))
        counts = np.bincount(part, minlength=n1 * n2).reshape(n1, n2)
        sums = sums.reshape(n1, n2)
        # Leaving one smaller part out: what the other n2 - 1 hold.
        held = counts.sum(1, keepdims=True) - counts
        value = sums.sum(1, keepdims=True, dtype=np.uint64) - sums
        place = np.arange(n1 * n2, dtype=np.uint64).reshape(n1, n2) + np.uint64(band << 40)
        value = mix(value ^ mix(place + held.astype(np.uint64) * _SALT[0]))
        value = (value << np.uint64(BAND_BITS)) | np.uint64(band)
        slack = scheme.slack(len(members), band, bounds) - int((held == 0).sum())
        out.append(value[held > 0] if slack >= 0 else value.reshape(-1))
        slacks.append(np.full(len(out[-1]), slack, np.int32))
    return (np.concatenate(out), np.concatenate(slacks)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, mark (a hash of the text, which tells apart the texts of rows that repeat an id)."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))


def classes_of(texts: DataFrame, words: int, shared: frozenset[int] = frozenset()) -> DataFrame:
    """id, mark, n (members), class, check, and where a task sees a class first its parities and leading members."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for members in (s for _, _, part, at in slices(*bytes_of(batch.column(1))) for s in shingle_sets(part, at, words)):
                first, second = identity(members, shared)
                new = len(members) and first not in seen
                if new:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(first)
                rows.append((len(members), first, second, parities(members) if new else None, leading(members).view(np.int64) if new else None))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["id", "mark", "n", "class", "check", "parities", "leading"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, mark long, n long, class long, check long, parities binary, leading array<bigint>")


def named_classes(texts: DataFrame, words: int) -> tuple[DataFrame, str, frozenset[int]]:
    """The written table of ``classes_of``, its path, and the first names that sets had to share. At 10**10 different
    sets about three pairs are expected to."""
    shared: frozenset[int] = frozenset()
    while True:
        found, path = written(classes_of(texts, words, shared))
        twice = found.groupBy("class").agg(F.min("check").alias("low"), F.max("check").alias("high")).filter("low < high")
        more = frozenset(r["class"] for r in twice.select("class").toLocalIterator())
        if more <= shared:
            return found, path, shared
        dropped(texts.sparkSession, path)
        shared |= more


def signed(texts: DataFrame, words: int, similarity: tuple[int, int], shared: frozenset[int] = frozenset()) -> DataFrame:
    """signature, class, slack (of the class in the band), weight of every text. A task signs a class that it has
    signed already only once; weight is that of ``crowded``."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(*similarity)
        bounds = scheme.bounds()
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def passed() -> pa.RecordBatch:
            signs, names, slacks = (np.concatenate([h[k] for h in held]) for k in range(3))
            return pa.RecordBatch.from_arrays([pa.array(signs.view(np.int64)), pa.array(names), pa.array(slacks), pa.array(crowded(signs, LOCAL))], names=["signature", "class", "slack", "weight"])

        for batch in batches:
            for _, _, part, at in slices(*bytes_of(batch.column(0))):
                for members in shingle_sets(part, at, words):
                    name = identity(members, shared)[0]
                    if not len(members) or name in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                    values, slacks = signatures(members, scheme, bounds)
                    held.append((values, np.full(len(values), name, np.int64), slacks))
                    size += len(values)
                    if size >= HELD:
                        yield passed()
                        held, size = [], 0
        if held:
            yield passed()

    return texts.select("text").mapInArrow(run, "signature long, class long, slack int, weight int")


def parities(members: np.ndarray) -> bytes:
    """One bit for each bucket of a mixed hash: whether an odd number of members lies in it; four buckets a member or more,
    so that few differences fall together and pairs just short of the similarity are ruled out, too."""
    bits = max(3, 2 + int(np.ceil(np.log2(max(1, len(members))))))
    place = (mix(members ^ _SALT[2]) >> np.uint64(64 - bits)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=1 << bits) & 1).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """Parities of ``size`` bytes: those of neighbouring buckets put together."""
    raw = np.frombuffer(bits, np.uint8)
    if len(raw) == size:
        return raw
    return np.packbits(np.bitwise_xor.reduce(np.unpackbits(raw).reshape(8 * size, -1), axis=1))


def near_pairs(bits: list[bytes], sizes: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Which pairs (left, right) sizes and parities do not rule out; all are folded to the shortest.

    A bucket whose parities differ holds a member that the sets do not share, and linked sets have at most
    (den - num) / (den + num) of both sizes of such members.
    """
    num, den = similarity
    a, b = sizes[left], sizes[right]
    keep = np.minimum(a, b) * den >= np.maximum(a, b) * num
    least = min(map(len, bits))
    table = np.stack([folded(x, least) for x in bits])
    at = np.flatnonzero(keep)
    step = max(1, (1 << 22) // least)
    for k in range(0, len(at), step):
        i, j = left[at[k : k + step]], right[at[k : k + step]]
        miss = np.bitwise_count(table[i] ^ table[j]).sum(1, dtype=np.int64)
        keep[at[k : k + step]] = miss * (den + num) <= (den - num) * (sizes[i] + sizes[j])
    return keep


def beside(pairs: DataFrame, known: DataFrame, end: str, spread: str, *columns: str) -> DataFrame:
    """Pairs with columns of the class at one end, named ``column_end``; classes of very many pairs are salted."""
    side = known.select(F.col("class").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
    return salted_join(pairs, side.join(pairs.select(end).distinct(), end, "left_semi"), end, spread, "inner")


def close(pairs: DataFrame, known: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that sizes and parities do not rule out."""
    num, den = similarity
    zero, one = np.array([0]), np.array([1])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(k).to_pylist() for k in (2, 3, 4, 5)], strict=True)
            keep = [bool(near_pairs([h, i], np.array([n, m]), zero, one, similarity)[0]) for n, h, m, i in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = beside(beside(pairs, known, "b", "a", "n", "parities"), known, "a", "b", "n", "parities")
    fit = both.filter(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
    return fit.select("a", "b", "n_a", "parities_a", "n_b", "parities_b").mapInArrow(run, "a long, b long")


def linked(pairs: DataFrame, known: DataFrame, texts: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of classes whose texts reach the similarity. Each pair carries the text of b; the text of a comes
    once for each BLOCK of its pairs, ahead of them. A class's text is that of the one row that ``known`` has of it."""
    num, den = similarity
    wanted, wanted_at = written(known.select("class", "id", "mark").join(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "class", "left_semi"))
    count = wanted.count()
    side = wanted.select(F.col("id").alias("the_id"), F.col("mark").alias("the_mark"), "class")
    on = F.col("id").eqNullSafe(F.col("the_id")) & (F.col("mark") == F.col("the_mark"))
    chosen, chosen_at = written(texts.join(F.broadcast(side) if count <= MOST else side, on).select("class", "text").dropDuplicates(["class"]))
    dropped(texts.sparkSession, wanted_at)
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cut = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"))
    ahead = blocks.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(chosen.withColumnRenamed("class", "a"), "a")
    rows = cut.join(chosen.withColumnRenamed("class", "b"), "b").select("a", "block", "b", "text").unionAll(ahead.select("a", "block", F.lit(None).cast("long").alias("b"), "text"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            sets = (s for _, _, part, at in slices(*bytes_of(batch.column(2))) for s in shingle_sets(part, at, words))
            for leads, members in zip(batch.column(1).is_null().to_pylist(), sets, strict=True):
                if leads:
                    kept = members
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(kept, members), len(kept) - 1)
                both = int((kept[at] == members).sum())
                keep.append(den * both >= num * (len(members) + len(kept) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    dealt = rows.repartition("a", "block").sortWithinPartitions("a", "block", F.asc_nulls_first("b"))
    found, found_at = written(dealt.select("a", "b", "text").mapInArrow(run, "a long, b long"))
    dropped(texts.sparkSession, chosen_at)
    return found


def led(known: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes b with the lead a of each of their leading members. Members rank classes each in its own
    way, so that the leads of a class differ."""
    keyed = known.select("class", F.explode("leading").alias("member"))
    rank = F.col("class").bitwiseXOR(F.col("member"))
    leads = keyed.groupBy("member").agg(F.min(rank).alias("low"), F.count("*").alias("n")).filter("n > 1")
    pairs = salted_join(keyed, leads.select("member", F.col("low").bitwiseXOR(F.col("member")).alias("lead")), "member", "class", "inner")
    return pairs.filter(F.col("class") != F.col("lead")).select(F.col("lead").alias("a"), F.col("class").alias("b")).distinct()


def shared_signatures(signs: DataFrame) -> DataFrame:
    """signature, class, slack of the signatures that several classes share. Rows of one signature stand together, and
    a task looks at what it is given from one row to the next."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # What follows the last change of the signature waits for the next rows.
            signs = batch.column(0).to_numpy()
            last = int(np.searchsorted(signs, signs[-1]))
            if tail and last == 0 and tail[-1].column(0)[-1].as_py() == int(signs[0]):
                tail.append(batch)
                continue
            yield _several(pa.Table.from_batches([*tail, batch.slice(0, last)]))
            tail = [batch.slice(last)]
        if tail:
            yield _several(pa.Table.from_batches(tail))

    dealt = signs.repartition(*apart("signature", "class")).sortWithinPartitions("signature")
    return dealt.select("signature", "class", "slack", "weight").mapInArrow(run, "signature long, class long, slack int")


def _several(rows: pa.Table) -> pa.RecordBatch:
    signs, names, weight = (rows.column(k).to_numpy() for k in (0, 1, 3))
    keep = weight != 1
    if len(signs):
        first = np.flatnonzero(np.append(True, signs[1:] != signs[:-1]))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(signs))))
        differ = np.minimum.reduceat(names, first) != np.maximum.reduceat(names, first)
        # A row of weight 0 stands apart from its group, which a row of larger weight vouches for.
        keep |= (differ | (np.maximum.reduceat(weight, first) > 1))[group]
    kept = rows.select([0, 1, 2]).filter(pa.array(keep, pa.bool_()))
    return pa.RecordBatch.from_arrays([c.combine_chunks() for c in kept.columns], names=kept.column_names)


def rooted(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """Groups with the root and the band of each class, a class once a group."""
    named = groups.distinct().join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    return named.withColumn("band", F.col("signature").bitwiseAND((1 << BAND_BITS) - 1).cast("int"))


def several(groups: DataFrame) -> DataFrame:
    """Groups with n (their classes), without those whose classes are all of one component."""
    found = groups.groupBy("signature").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low < high")
    return groups.drop("n").join(found.select("signature", "n"), "signature")


def staying(groups: DataFrame) -> DataFrame:
    """Groups without the classes that share too little to be linked with one of another component."""
    stay = groups.groupBy("class", "band").agg(F.count("*").alias("shared"), F.max("slack").alias("slack")).filter("shared > slack")
    return groups.join(stay.select("class", "band"), ["class", "band"], "left_semi")


def uncrowded(groups: DataFrame) -> DataFrame:
    """Groups without the crowded signatures of the classes that have slack for them."""
    crowd = groups.filter(F.col("n") > CROWDED)
    held = crowd.groupBy("class", "band").agg(F.count("*").alias("crowded"), F.max("slack").alias("slack")).filter("crowded > slack").select("class", "band")
    return groups.filter(F.col("n") <= CROWDED).unionAll(crowd.join(held, ["class", "band"], "left_semi").select(groups.columns))


def open_groups(first: DataFrame, roots: DataFrame) -> tuple[DataFrame, str]:
    """The table of the groups in which pairs of classes of different components may be linked."""
    spark = first.sparkSession
    groups, path = written(several(rooted(first, roots)))
    n = groups.count()
    for _ in range(ROUNDS if n else 0):
        fewer, there = written(several(staying(groups)))
        dropped(spark, path)
        settled(spark)
        groups, path, rows, n = fewer, there, n, fewer.count()
        if not n or n > rows * (1 - YIELD):
            break
    out = written(uncrowded(groups).select("signature", "class", "root"))
    dropped(spark, path)
    return out


def first_of_each(left: np.ndarray, right: np.ndarray, n: int, each: int, turn: int) -> np.ndarray:
    """Places of pairs of n classes that leave in a turn: each class with its ``each`` first partners ahead of it, in an
    order that is another one in each turn."""
    order = np.random.default_rng(turn).permutation(n) if turn else np.arange(n)
    high, low = np.maximum(order[left], order[right]), np.minimum(order[left], order[right])
    at = np.lexsort((low, high))
    first = np.flatnonzero(np.append(True, np.diff(high[at]) != 0))
    rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return np.sort(at[rank < each])


#: Where classes of crowded groups meet.
PLACE = ["lead", "part", "i", "j"]


def crossing(groups: DataFrame, known: DataFrame, similarity: tuple[int, int], each: int | None = None, turn: int = 0, waiting: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of classes of different components that share a group and are not ruled out. groups: signature,
    class, root. With ``each``, a place of many pairs gives those of ``first_of_each`` and a row of its own without a pair, which
    says that others wait: most are of one component once these have been checked. ``waiting``: such rows of the turn before;
    all other places have given their pairs."""
    # Groups with one first class mostly hold the same pairs: they meet in one place, where each pair is tested once.
    facts = groups.groupBy("signature").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.min(F.xxhash64("class")).alias("lead")).filter("low < high")
    rows = groups.join(facts.select("signature", "n", "lead"), "signature")
    # Groups of more than BLOCK classes are dealt to blocks; a class meets each block of its group, one pair of blocks a task.
    blocks = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("n") / BLOCK, F.lit(1.0))))).cast("int")
    part = F.when(F.col("n") > CROWDED, F.pmod("signature", F.lit(DEALT))).otherwise(F.lit(0)).cast("int")
    placed = rows.select("lead", part.alias("part"), blocks.alias("blocks"), "class", "root", "signature")
    if waiting is not None:
        placed = placed.join(waiting.select("lead", "part").distinct(), ["lead", "part"], "left_semi")
    gathered = placed.groupBy("lead", "part", "blocks", "class", "root").agg(F.collect_set("signature").alias("signatures"))
    # Members are looked up once a class and place, before blocks repeat them.
    full = gathered.join(known.select("class", "n", "parities"), "class").withColumn("side", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")})
    if waiting is not None:
        dealt = dealt.join(waiting.select(*PLACE), PLACE, "left_semi")
    full = dealt.select(*PLACE, "side", "class", "root", "signatures", "n", "parities")

    def pairs_of(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, bool]:
        names, roots, sides, sizes = (np.array([r[k] for r in rows]) for k in (5, 6, 4, 8))
        signs = np.concatenate([np.asarray(r[7], np.int64) for r in rows])
        holder = np.repeat(np.arange(len(rows)), [len(r[7]) for r in rows])
        order = np.lexsort((holder, signs))
        signs, holder = signs[order], holder[order]
        cuts = np.flatnonzero(np.concatenate([[True], signs[1:] != signs[:-1], [True]]))
        # The same members under several signatures are looked at once.
        sets = {holder[x:y].tobytes() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if y - x > 1}
        out = []
        for raw in sets:
            members = np.frombuffer(raw, np.int64)
            x, y = np.triu_indices(len(members), 1)
            x, y = members[x], members[y]
            ok = roots[x] != roots[y]
            if rows[0][2] != rows[0][3]:
                ok &= sides[x] != sides[y]
            out.append(np.unique(x[ok] * len(rows) + y[ok]))
        found = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
        if not len(found):
            return found, found, False
        left, right = found // len(rows), found % len(rows)
        keep = near_pairs([r[9] for r in rows], sizes, left, right, similarity)
        left, right = left[keep], right[keep]
        wait = False
        if each is not None and len(left) > each * len(rows):
            chosen = first_of_each(left, right, len(rows), each, turn)
            left, right, wait = left[chosen], right[chosen], True
        a, b = names[left], names[right]
        return np.minimum(a, b), np.maximum(a, b), wait

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def made() -> pa.RecordBatch:
            a, b, wait = pairs_of(held)
            none = pa.nulls(len(a), pa.int64()).to_pylist()
            columns = [[*a.tolist(), None], [*b.tolist(), None], *[[*none, v] for v in held[0][:4]]]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(),) * 3 + (pa.int32(),) * 3, strict=True)], names=["a", "b", *PLACE]).slice(0, len(a) + wait)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and row[:4] != held[0][:4]:
                    if len(held) > 1:
                        yield made()
                    held = []
                held.append(row)
        if len(held) > 1:
            yield made()

    return full.repartition(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(run, "a long, b long, lead long, part int, i int, j int").distinct()


def class_links(texts: DataFrame, classes: DataFrame, words: int, similarity: tuple[int, int], shared: frozenset[int] = frozenset()) -> DataFrame:
    """class, root of every class that is linked with another."""
    spark = texts.sparkSession
    known, known_at = written(classes.filter("parities IS NOT NULL").select("class", "id", "mark", "n", "parities", "leading").dropDuplicates(["class"]))
    fresh, fresh_at = written(close(led(known), known, similarity))
    links = linked(fresh, known, texts, words, similarity)
    roots = components(links).select(F.col("node").alias("class"), "root")
    dropped(spark, fresh_at)
    settled(spark)
    first, first_at = written(shared_signatures(signed(texts, words, similarity, shared)))
    settled(spark)
    open_, open_at = open_groups(first, roots)
    dropped(spark, first_at)
    settled(spark)
    waiting, waiting_at = None, []
    for turn in range(TURNS):
        met, met_at = written(crossing(open_, known, similarity, EACH if turn < TURNS - 1 else None, turn, waiting))
        pairs = met.filter("a IS NOT NULL").select("a", "b")
        if not pairs.isEmpty():
            links = links.unionAll(linked(pairs, known, texts, words, similarity))
            roots = components(links).select(F.col("node").alias("class"), "root")
        dropped(spark, *waiting_at)
        waiting, waiting_at = met.filter("a IS NULL"), [met_at]
        if waiting.isEmpty():
            break
        settled(spark)
        joined_, there = written(rooted(open_.select("signature", "class"), roots).select("signature", "class", "root"))
        dropped(spark, open_at)
        open_, open_at = joined_, there
    dropped(spark, *waiting_at)
    dropped(spark, open_at, known_at)
    return roots


def joined(docs: DataFrame, words: int, similarity: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """id, mark, n, class, root of every row."""
    with scratch(docs.sparkSession) as kept:
        texts = texts_of(docs, id_col, text_col)
        classes, _, shared = named_classes(texts, words)
        roots = class_links(texts, classes, words, similarity, shared)
        named = salted_join(classes.select("id", "mark", "n", "class"), roots, "class", "mark")
        out, path = written(named.select("id", "mark", "n", "class", F.coalesce("root", "class").alias("root")))
        kept.append(path)
    return out


def jaccard_components(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), class of every row.

    Defined results: null, empty and blank texts have no shingles and are linked with nothing; equal sets are linked;
    repeated rows are copies; rows that repeat an id with different texts are linked each by its own text; rows without
    an id are components of their own class without id; other columns are not read.
    """
    named = joined(docs, words, similarity, id_col, text_col)
    # A component of one row is its own least id; the others may be very large, so their side is salted.
    least = named.filter("n > 0").groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    found = salted_join(named, least, "root", "mark")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), "class")


def one_of_each(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """The documents, columns unchanged, of the smallest id of each group of linked texts; of rows that repeat an id and a
    text, one. Of texts that share an id and a group, the one of the smallest hash stays.

    Rows without an id are no one's copy and stay, as do texts without words.
    """
    spark = docs.sparkSession
    named = joined(docs, words, similarity, "doc_id", "text").filter("id IS NOT NULL AND n > 0")
    best = named.groupBy("root").agg(F.min("id").alias("least"), F.count("*").alias("rows")).filter("rows > 1")
    firsts = salted_join(named, best, "root", "mark", "inner")
    # Ties on the id, which different texts of one id make, go by the hash of the text.
    mark = firsts.filter("id = least").groupBy("root").agg(F.min("mark").alias("the_mark"), F.count("*").alias("times"))
    both, both_at = written(salted_join(firsts, mark, "root", "mark", "inner"))
    its_id, its_mark = unused(docs.columns, "its_id"), unused(docs.columns, "its_mark")
    named_ = lambda rows: written(rows.select(F.col("id").alias(its_id), F.col("mark").alias(its_mark)).distinct())[0]
    gone = named_(both.filter("id <> least OR mark <> the_mark"))
    again = named_(both.filter("times > 1 AND id = least AND mark = the_mark"))
    dropped(spark, both_at)
    on = (F.col("doc_id") == F.col(its_id)) & (F.xxhash64("text") == F.col(its_mark))
    side = lambda rows, n: F.broadcast(rows) if n <= MOST else rows
    n, m = gone.count(), again.count()
    kept = docs.join(side(gone, n), on, "left_anti") if n else docs
    if not m:
        return kept
    single = kept.join(side(again, m), on, "left_anti")
    return single.unionByName(kept.join(side(again, m), on, "left_semi").dropDuplicates(["doc_id", "text"]))
