"""Near duplicates by order MinHash.

The five-word shingles of a text are labelled with their occurrence, so that all
are distinct. A sketch samples the shingles with the smallest hash values under
one hash function and keeps them in text order; two texts agree in a sketch with
a chance that falls with their edit distance, not just with shared shingles.
Texts of few shingles would agree only when nearly all are equal, so they are not
sketched: they meet, without loss, by the rarest of their shingles (a prefix
filter), and so do the somewhat longer texts that may be similar to them.
Texts that agree in a sketch or meet by a shingle are candidates, and are verified
by aligning their shingles within a band.

No bucket of equal sketches is expanded into pairs while it may be one large
group. First every member is verified against one leader of its bucket, and the
links found are joined into components; large buckets that are not one component
yet get further leaders. Then members of a bucket that are still in different
components are verified pairwise, so that no link between texts that share a
bucket can be lost.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.llm.components import components, joined_components
from martlens.llm.words import ascii_words, packed, unpacked
from martlens.session import written

SHINGLE = 5
SIMILARITY = 0.8
# A pair with s of u shingles shared in order agrees in a sketch with a chance of
# C(s, 6) / C(u, 6) or more. At the limit, that is 0.24 for the shortest texts that
# are only sketched (s = 40, u = 50), which agree in none of 32 sketches with
# 1.5e-4; for long texts it is 0.8 ** 6 = 0.26, and 6e-5.
SKETCHES = 32
SAMPLED = 6
# Pairs with a text of so many shingles at most are found exactly.
EXACT = 40
# Rounds of further leaders while buckets hold more open pairs than this for each
# text and a round settles half of them; all pairs that are left then are compared.
ROUNDS = 4
PAIRS_PER_TEXT = 4
LIST = 16  # members in a row when components are compared
ROWS_PER_BATCH = "1000"  # rows that a task holds at once; they carry whole texts
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_CELLS = 4_000_000
_COLUMNS = 65_536
_WORDS: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the lower-case words of a text, kept per word between calls."""
    words = ascii_words(text)
    try:
        return np.array([_WORDS[w] for w in words], np.uint64)
    except KeyError:
        if len(_WORDS) > 500_000:
            _WORDS.clear()
        for w in words:
            if w not in _WORDS:
                _WORDS[w] = xxhash.xxh64_intdigest(w)
        return np.array([_WORDS[w] for w in words], np.uint64)


def labelled_shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles of a text, in order: shingle and occurrence.

    A text of fewer words, but not none, is one shingle.
    """
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    value = np.zeros(n, np.uint64)
    for offset in range(size):
        value = _mix(value * _FACTOR + words[offset : offset + n])
    order = np.argsort(value, kind="stable")
    ranked = value[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    if new.all():
        return value
    firsts = np.flatnonzero(new)
    place = np.arange(n)
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = place - firsts[np.cumsum(new) - 1]
    return _mix(value + occurrence * _FACTOR)


def sketches(shingles: np.ndarray, count: int = SKETCHES, sampled: int = SAMPLED) -> np.ndarray:
    """``count`` sketches as 64-bit integers; none for no shingles."""
    n = len(shingles)
    if not n:
        return np.array([], np.int64)
    seeds = _mix(np.arange(1, count + 1, dtype=np.uint64) * _FACTOR)
    out = []
    step = max(1, _CELLS // n)
    for first in range(0, count, step):
        part = seeds[first : first + step]
        if n > sampled:
            values = _mix(shingles[None, :] ^ part[:, None])
            chosen = np.argpartition(values, sampled - 1, axis=1)[:, :sampled]
            chosen.sort(axis=1)
        else:
            chosen = np.broadcast_to(np.arange(n), (len(part), n))
        key = part.copy()
        for column in range(chosen.shape[1]):
            key = _mix(key * _FACTOR + shingles[chosen[:, column]])
        out.append(key)
    return np.concatenate(out).view(np.int64)


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned shingles over all shingles of two texts: 0 to 1.

    The alignment is the longest common subsequence. Labelled shingles are
    distinct, so it is the longest increasing run of the positions in ``b`` of
    those in ``a``. Shingles further apart than the band are not aligned: at a
    similarity of ``least``, so many can't be unmatched before them.
    """
    if not len(a) or not len(b):
        return 0.0
    band = int((1 / least - 1) * max(len(a), len(b))) + 1
    _, in_a, in_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(in_a - in_b) <= band
    order = np.argsort(in_a[near])
    run = in_b[near][order]
    if len(run) > 1 and not (run[1:] > run[:-1]).all():
        tails: list[int] = []
        for x in run.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        length = len(tails)
    else:
        length = len(run)
    return length / (len(a) + len(b) - length)


def text_node(text: Column) -> Column:
    """Equal for equal texts: 128-bit digest; null for null."""
    return F.unhex(F.md5(text))


def sketch_table(docs: DataFrame, count: int = SKETCHES, sampled: int = SAMPLED,
                 least: float = SIMILARITY) -> DataFrame:
    """(node, keys, shingles), one row per distinct text.

    Texts of more than ``EXACT`` shingles have sketches as keys. Those that can be
    similar to one of ``EXACT`` or fewer have their shingles, else null.
    """
    longest = int(EXACT / least + 1e-9)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                every = [labelled_shingles(t) for t in part.column("text").to_pylist()]
                keys = [sketches(x, count, sampled).tolist() if len(x) > EXACT else [] for x in every]
                few = [x.view(np.int64).tolist() if len(x) <= longest else None for x in every]
                long_list = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array(keys, long_list), pa.array(few, long_list)],
                    names=["node", "keys", "shingles"],
                )

    texts = docs.where("text is not null").select(text_node(F.col("text")).alias("node"), "text")
    rows = texts.mapInArrow(sketch, "node binary, keys array<long>, shingles array<long>")
    return rows.dropDuplicates(["node"])


def prefix_keys(table: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(node, key): the shared ones among the first shingles of texts of few shingles.

    Shingles are ordered by the number of texts that have them, then by value. Of
    n shingles, a text that is similar to this one has at least ``least * n``, so
    one of the first n - ceil(least * n) + 1 of either text is among those of the
    other. As rare shingles come first, few texts meet by a common one.
    """
    few = table.where("shingles is not null").select("node", F.explode("shingles").alias("s"))
    counts = few.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    counted = few.join(counts.select(F.col("s").alias("c"), "n"), F.col("s") == F.col("c"), "left")
    one = F.struct(F.coalesce("n", F.lit(1)).alias("n"), "s")
    ordered = counted.groupBy("node").agg(F.sort_array(F.collect_list(one)).alias("a"))
    size = F.size("a")
    first = F.slice("a", 1, (size - F.ceil(size * F.lit(least) - 1e-6) + 1).cast("int"))
    rows = ordered.select("node", F.explode(first).alias("x")).where(F.col("x.n") > 1)
    return rows.select("node", F.xxhash64("x.s").alias("key"))


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes: one row each.

    One document stands for all with its text. The join is on node and document,
    so the copies of one text are spread over the tasks.
    """
    keyed = docs.where("text is not null").select(text_node(F.col("text")).alias("node"), "doc_id", "text")
    owners = (
        keyed.groupBy("node").agg(F.min("doc_id").alias("owner"))
        .join(nodes.select(F.col("node").alias("wanted")), F.col("node") == F.col("wanted"), "left_semi")
        .select(F.col("node").alias("o_node"), "owner")
    )
    own = keyed.join(
        owners, (F.col("node") == F.col("o_node")) & F.col("doc_id").eqNullSafe(F.col("owner"))
    )
    return own.select("node", "text").dropDuplicates(["node"])


def verified(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (u, v) whose texts align to at least the given similarity."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def shingles(node: bytes, text: str) -> np.ndarray:
            if node not in kept:
                kept[node] = labelled_shingles(text)
                if len(kept) > 500:
                    kept.popitem(last=False)
            return kept[node]

        for batch in batches:
            columns = [batch.column(n) for n in ("u", "v", "tu", "tv")]
            good = []
            for i in range(batch.num_rows):
                u, v, tu, tv = (c[i].as_py() for c in columns)
                good.append(aligned_similarity(shingles(u, tu), shingles(v, tv), least) >= least)
            yield batch.filter(pa.array(good, pa.bool_())).select(["u", "v"])

    one = texts.select(F.col("node").alias("nu"), F.col("text").alias("tu"))
    two = texts.select(F.col("node").alias("nv"), F.col("text").alias("tv"))
    joined = pairs.join(one, F.col("u") == F.col("nu")).join(two, F.col("v") == F.col("nv"))
    return joined.select("u", "v", "tu", "tv").mapInArrow(verify, "u binary, v binary")


def leader_pairs(members: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's smallest node."""
    leaders = members.groupBy("key").agg(F.min("node").alias("u")).select(F.col("key").alias("k"), "u")
    pairs = members.join(leaders, F.col("key") == F.col("k")).where(F.col("node") != F.col("u"))
    return pairs.select("u", F.col("node").alias("v")).distinct()


def in_mixed_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label) of the buckets whose members are in several components."""
    labels = labels.select(F.col("node").alias("n"), "label")
    placed = members.join(labels, F.col("node") == F.col("n"), "left").select(
        "key", "node", F.coalesce("label", "node").alias("label")
    )
    mixed = (
        placed.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"))
        .where(F.col("least") != F.col("most")).select(F.col("key").alias("k"))
    )
    return placed.join(mixed, F.col("key") == F.col("k"), "left_semi")


def count_open_pairs(mixed: DataFrame) -> int:
    """Pairs of a bucket's members in different components, counted from sizes."""
    sizes = mixed.groupBy("key", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    per_key = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    total = per_key.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()[0]
    return int(total or 0)


def round_pairs(mixed: DataFrame, links: DataFrame, round_number: int) -> DataFrame:
    """Members of mixed buckets with one more leader of the bucket.

    Hubs come first: the text that copies were made from matches them all, while
    two copies may both be close to it and not to each other. Every other round
    draws leaders by a hash instead.
    """
    ends = links.select(F.col("u").alias("n")).union(links.select(F.col("v").alias("n")))
    degrees = ends.groupBy("n").agg(F.count(F.lit(1)).alias("degree"))
    drawn = F.xxhash64("node", F.lit(round_number))
    if round_number % 2:
        rated = mixed.join(degrees, F.col("node") == F.col("n"), "left")
        rank = F.struct(F.coalesce("degree", F.lit(0)), drawn)
    else:
        rated, rank = mixed, F.struct(drawn)
    leaders = rated.groupBy("key").agg(F.max_by(F.struct("node", "label"), rank).alias("leader")).select(
        F.col("key").alias("k"), F.col("leader.node").alias("lead"), F.col("leader.label").alias("lead_label")
    )
    pairs = mixed.join(leaders, F.col("key") == F.col("k")).where(F.col("label") != F.col("lead_label"))
    return pairs.select(F.least("node", "lead").alias("u"), F.greatest("node", "lead").alias("v")).distinct()


def open_lists(mixed: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of lists of a bucket's members that together hold all its open pairs.

    Members are listed with their texts, up to about 16 in a row: those of a large
    component among themselves, the rest pooled. Lists of one large component are
    not paired with each other. Comparing list with list moves a text once for
    each list it meets, not for each member.
    """
    sizes = mixed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"))
    small = F.col("size") < LIST
    pools = sizes.groupBy("key").agg(F.sum(F.when(small, F.col("size"))).alias("pooled"))
    cells = sizes.join(pools.select(F.col("key").alias("pk"), "pooled"), F.col("key") == F.col("pk")).select(
        F.col("key").alias("gk"), F.col("label").alias("gl"),
        F.when(~small, F.col("label")).alias("own"),
        F.ceil(F.when(small, F.col("pooled")).otherwise(F.col("size")) / LIST).alias("parts"),
    )
    body = texts.select(F.col("node").alias("tn"), "text")
    member = F.struct("node", "label", "text")
    lists = (
        mixed.join(cells, (F.col("key") == F.col("gk")) & (F.col("label") == F.col("gl")))
        .join(body, F.col("node") == F.col("tn"))
        .groupBy("key", "own", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
        .agg(F.collect_list(member).alias("a"))
        .withColumn("id", F.xxhash64("own", "part"))
    )
    lists = written(lists)
    other = lists.select(F.col("key").alias("k2"), F.col("own").alias("own2"), F.col("id").alias("id2"), F.col("a").alias("b"))
    met = (F.col("key") == F.col("k2")) & (F.col("id") <= F.col("id2"))
    apart = F.col("own").isNull() | F.col("own2").isNull() | (F.col("own") != F.col("own2"))
    return lists.join(other, met & apart).select("id", "id2", "a", "b")


def may_reach(one: list[np.ndarray], two: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of two lists whose shared shingles allow ``least``.

    No alignment is longer than the number of shared shingles, which a product of
    incidence matrices gives for all pairs at once, a block of columns at a time.
    """
    texts = one + two
    sizes = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    values, place = np.unique(np.concatenate(texts), return_inverse=True)
    shared = np.zeros((len(one), len(two)))
    for first in range(0, len(values), _COLUMNS):
        here = (place >= first) & (place < first + _COLUMNS)
        block = np.zeros((len(texts), min(_COLUMNS, len(values) - first)), np.float32)
        block[owner[here], place[here] - first] = 1
        shared += block[: len(one)] @ block[len(one) :].T
    total = sizes[: len(one), None] + sizes[None, len(one) :]
    return np.nonzero(shared * (1 + least) >= least * total - 1e-6)


def links_of_lists(lists: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Links (u, v) between members of two lists that are in different components."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def shingled(members: list[dict]) -> list[tuple]:
            out = []
            for m in members:
                if m["node"] not in kept:
                    kept[m["node"]] = labelled_shingles(m["text"])
                    if len(kept) > 1000:
                        kept.popitem(last=False)
                out.append((m["node"], m["label"], kept[m["node"]]))
            return out

        for batch in batches:
            found = set()
            for row in range(batch.num_rows):
                one, two = (shingled(batch.column(n)[row].as_py()) for n in ("a", "b"))
                for i, j in zip(*may_reach([m[2] for m in one], [m[2] for m in two], least)):
                    (u, lu, su), (v, lv, sv) = one[i], two[j]
                    if lu != lv and aligned_similarity(su, sv, least) >= least:
                        found.add((min(u, v), max(u, v)))
            cells = list(zip(*found)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cells], names=["u", "v"])

    return lists.mapInArrow(compare, "u binary, v binary").distinct()


def untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    old = tested.select(F.col("u").alias("su"), F.col("v").alias("sv"))
    return pairs.join(old, (F.col("u") == F.col("su")) & (F.col("v") == F.col("sv")), "left_anti")


def class_labels(members: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(node, label) of the components of all verified links between bucket members.

    Rounds of leaders go on while buckets hold many open pairs and each round
    settles half of them; each costs one comparison per member. The pairs then left are
    all compared, so the result does not depend on the rounds.
    """
    with _small_batches(members.sparkSession):
        return _class_labels(members, texts, least)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Fewer rows for a Python task at a time, unless the submitter chose a number."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    if not spark.sparkContext.getConf().contains(batch):
        spark.conf.set(batch, ROWS_PER_BATCH)
    try:
        yield
    finally:
        spark.conf.set(batch, before)


def _class_labels(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    tested = written(leader_pairs(members))
    links = written(verified(tested, texts, least))
    labels = written(components(links))
    few, before = PAIRS_PER_TEXT * texts.count(), None
    for number in range(1, ROUNDS + 1):
        mixed = written(in_mixed_buckets(members, labels))
        n_open = count_open_pairs(mixed)
        if n_open <= few or (before and 2 * n_open > before):
            break
        before = n_open
        pairs = written(untested(round_pairs(mixed, links, number), tested))
        found = written(verified(pairs, texts, least))
        tested, links = tested.union(pairs), links.union(found)
        if not found.isEmpty():
            labels = written(joined_components(labels, found))
    else:
        mixed = written(in_mixed_buckets(members, labels))
    more = written(links_of_lists(open_lists(mixed, texts), least))
    return labels if more.isEmpty() else written(joined_components(labels, more))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, count: int = SKETCHES,
                    sampled: int = SAMPLED) -> DataFrame:
    """One row per document row: doc_id, node, class_id.

    ``class_id`` is the smallest doc_id of the documents joined by equal texts or
    by links, directly or through others. A null text has a class of its own, as
    has a text without words and without an equal. A class whose ids are all null
    has a null class_id. Repeated rows get equal results.
    """
    docs = docs.select("doc_id", "text")
    rows = written(sketch_table(docs, count, sampled, least))
    sketched = rows.select("node", F.explode("keys").alias("key"))
    # Keys alone are counted first; only rows of shared keys are kept.
    table = written(sketched.union(prefix_keys(rows, least)))
    shared = table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    members = written(
        table.join(shared.select(F.col("key").alias("k")), F.col("key") == F.col("k"), "left_semi")
    )
    texts = written(texts_of(docs, members.select("node").distinct()))
    labels = class_labels(members, texts, least)

    node = text_node(F.col("text"))
    keyed = docs.select("doc_id", node.alias("node"))
    owners = keyed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least_id"))
    placed = owners.join(labels.select(F.col("node").alias("n"), "label"), F.col("node") == F.col("n"), "left")
    placed = placed.select("node", "least_id", F.coalesce("label", "node").alias("label"))
    classes = placed.groupBy("label").agg(F.min("least_id").alias("class_id"))
    by_node = placed.select(F.col("node").alias("n"), F.col("label").alias("l")).join(
        classes, F.col("l") == F.col("label")
    ).select("n", "class_id")
    result = keyed.join(by_node, F.col("node") == F.col("n"), "left")
    class_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return result.select("doc_id", "node", class_id.alias("class_id"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, the one with the smallest id; all columns kept.

    Rows that repeat the kept id with the same text stay, as do null texts.
    """
    classes = near_duplicates(docs, **options)
    kept = (
        classes.where("node is not null").groupBy("node").agg(F.min("class_id").alias("class_id"))
        .select(F.col("node").alias("n"), "class_id")
    )
    marked = packed(docs, text_node(F.col("text")).alias("node"), F.col("doc_id").alias("id"))
    joined = marked.join(
        kept, (F.col("node") == F.col("n")) & F.col("id").eqNullSafe(F.col("class_id")), "left"
    )
    return unpacked(joined.where(F.col("node").isNull() | F.col("n").isNotNull()), docs.columns)
