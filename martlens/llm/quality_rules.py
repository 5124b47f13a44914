"""Quality rules: text statistics and the frequency of lines across documents.

All of it is Spark expressions. Statistics of a text are computed inside its row.
For the line rule only hashes travel: a line counts once for each distinct document
of a host, so a page that stands there in many copies is boilerplate, and the first
copy alone is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.llm.words import SPACE, lower_ascii, split_words

MIN_WORDS = 50
MAX_REPEATED_PCT = 50
# A line of a host goes if more distinct documents than both limits have it.
MAX_LINE_DOCS = 10
MAX_LINE_PCT = 1
# A document is depleted if less than this part of its words is left.
MIN_LEFT_PCT = 30


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash of their words. Sorted by hash, equal
    windows are neighbours; their positions, sorted again, show how many words
    each window adds to the one before it.
    """

    def windows(w: Column) -> Column:
        place = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(
            place,
            lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")),
        )

    def repeats(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        kept = F.filter(s, lambda x, j: same(x, j - 1) | ((j < last) & same(x, j + 1)))
        return F.array_sort(F.transform(kept, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        added = F.transform(
            p, lambda x, j: F.when(j == 0, 3).otherwise(F.least(x - F.get(p, j - 1), F.lit(3)))
        )
        return F.aggregate(added, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def with_repeats(w: Column) -> Column:
        return _let(_let(F.sort_array(windows(w)), repeats), covered)

    def count(w: Column) -> Column:
        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(with_repeats(w))

    return _let(words, count)


def text_statistics(text: Column) -> dict[str, Column]:
    """The base statistics of a text; all are 0 for null."""
    text = F.coalesce(text, F.lit(""))
    solid = F.regexp_replace(text, SPACE, "")
    plain = F.regexp_replace(solid, r"[#*$%&|<>]", "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = split_words(text, SPACE)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(solid).cast("long"),
        "n_symbols": (F.length(solid) - F.length(plain)).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def normal_line(line: Column) -> Column:
    """A-Z in lower case, numbers as 0, single blanks, none at the ends."""
    line = F.regexp_replace(lower_ascii(line), r"[0-9]+", "0")
    return F.trim(F.regexp_replace(line, SPACE, " "))


def line_table(docs: DataFrame) -> DataFrame:
    """One row per document row and line with a word, normalised and hashed.

    ``place`` counts all lines of the text, from 0.
    """
    lines = F.transform(
        F.split(F.coalesce("text", F.lit("")), "\n"),
        lambda x, j: F.struct(normal_line(x).alias("line"), j.alias("place")),
    )
    hashed = F.transform(
        F.filter(lines, lambda x: x["line"] != ""),
        lambda x: F.struct(
            F.xxhash64(x["line"], F.lit(1)).alias("h1"),
            F.xxhash64(F.lit(2), x["line"]).alias("h2"),
            F.size(F.split(x["line"], " ")).alias("words"),
            x["place"].alias("place"),
        ),
    )
    return (
        docs.select(
            "doc_id",
            F.col("source").alias("host"),
            F.xxhash64("text", F.lit(1)).alias("t1"),
            F.xxhash64(F.lit(2), "text").alias("t2"),
            F.explode(hashed).alias("line"),
        )
        .select("doc_id", "host", "t1", "t2", "line.*")
    )


def lost_words(docs: DataFrame, max_docs: int = MAX_LINE_DOCS, max_pct: int = MAX_LINE_PCT) -> DataFrame:
    """What documents lose to the line rule: doc_id, host, t1, t2, lost_words, places.

    ``places`` are those of the removed lines. A document is an id with a text, so
    repeated rows are one. A line over the limits is removed wherever it stands, except
    in the document of the host with the smallest id that has it. Null hosts form one
    host, and documents without an id are told apart by their texts.
    """
    lines = line_table(docs)
    key = ["host", "h1", "h2"]
    # Two steps: the lines of a document fall together first, spread over all of host,
    # line and document, so that a line of a third of all rows isn't one task.
    counts = (
        lines.select(*key, "doc_id", "t1", "t2").distinct()
        .groupBy(*key).agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first"))
        .where(F.col("docs") > max_docs)
    )
    documents = docs.select(
        F.col("source").alias("host"), "doc_id", F.xxhash64("text", F.lit(1)).alias("t1"),
        F.xxhash64(F.lit(2), "text").alias("t2"),
    )
    hosts = documents.distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    frequent = (
        counts.join(hosts, counts.host.eqNullSafe(hosts.host)).drop(hosts.host)
        .where(100 * F.col("docs") > max_pct * F.col("host_docs"))
        .select(F.col("host").alias("f_host"), F.col("h1").alias("f1"), F.col("h2").alias("f2"), "first")
    )
    gone = lines.join(
        frequent,
        (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2"))
        & F.col("host").eqNullSafe(F.col("f_host")),
    ).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    # A row that is repeated loses each of its lines once.
    document = ["doc_id", "host", "t1", "t2"]
    lost = gone.select(*document, "place", "words").distinct()
    return lost.groupBy(*document).agg(
        F.sum("words").alias("lost_words"), F.collect_list("place").alias("places")
    )


def without_lines(text: Column, places: Column) -> Column:
    """The text without the lines at these places; the other lines are unchanged."""

    def left(lines: Column) -> Column:
        # By set, since a long text can lose as many lines as it has.
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
        return F.array_join(F.transform(kept, lambda j: lines[j]), "\n")

    return _let(F.split(text, "\n"), left)


def _verdicts(docs: DataFrame, columns: list[str], **limits) -> DataFrame:
    """``columns`` of every row, its statistics, losses, ``base_failed`` and ``kept``."""
    loss = lost_words(docs, **limits).select(
        F.col("doc_id").alias("l_id"), F.col("host").alias("l_host"),
        F.col("t1").alias("l1"), F.col("t2").alias("l2"), "lost_words", "places",
    )
    stats = text_statistics(F.col("text"))
    rows = docs.select(
        F.struct(*columns).alias("row"), F.col("doc_id").alias("r_id"), F.col("source").alias("r_host"),
        F.xxhash64("text", F.lit(1)).alias("r1"), F.xxhash64(F.lit(2), "text").alias("r2"),
        F.struct(*[c.alias(n) for n, c in stats.items()]).alias("s"),
    )
    judged = rows.join(
        loss,
        F.col("r_id").eqNullSafe(F.col("l_id")) & F.col("r_host").eqNullSafe(F.col("l_host"))
        & (F.col("r1") == F.col("l1")) & (F.col("r2") == F.col("l2")),
        "left",
    )
    n, repeat = F.col("s.n_words"), F.col("s.n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEATED_PCT * n)
    lost = F.coalesce("lost_words", F.lit(0)).cast("long")
    return judged.select(
        "row", "s", failed.alias("base_failed"), lost.alias("lost_words"), "places",
        (~failed & (100 * (n - lost) >= MIN_LEFT_PCT * n)).alias("kept"),
    )


def assess(docs: DataFrame, **limits) -> DataFrame:
    """One row per document row: doc_id, statistics, base_failed, lost_words, kept.

    Null and empty texts have no words and fail. Repeated rows are one text, and
    each gets the same verdict. Only doc_id, source and text of ``docs`` are used.
    """
    return _verdicts(docs, ["doc_id"], **limits).select(
        F.col("row.doc_id").alias("doc_id"), "s.*", "base_failed", "kept", "lost_words"
    )


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The document rows that are kept, without the lines above the limits.

    All columns of ``docs`` are kept; ``n_chars``, if there, follows the text.
    """
    kept = _verdicts(docs, docs.columns, **limits).where("kept")
    text, same = F.col("row.text"), F.col("places").isNull()
    cleaned = kept.withColumn("cleaned", F.when(same, text).otherwise(without_lines(text, F.col("places"))))
    new = {"text": F.col("cleaned")}
    if "n_chars" in docs.columns:
        chars = F.length("cleaned").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(same, F.col("row.n_chars")).otherwise(chars)
    return cleaned.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
