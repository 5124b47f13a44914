"""Spelling variants: frequent words that differ by one edit, found by composing automata.

Two words are near if one inserted, deleted or replaced code point turns one into
the other. All near pairs of a set of words are what its minimised acceptor A
accepts together with a one-edit transducer T and A again, A o T o A: a state of
the composition is a pair of states of A and whether the edit has been made.

The composition is dealt out by its initial states. The edit of a pair is taken to
be at the first place where the two differ. If that lies in a segment of the word,
both have the same code points before and after it; these are the key, and one
machine is built of the middles under a key. Every word is under one key for each
segment and for each length that its pairs can have, and every pair is under
exactly one key. Segments are halves of a word at first; under keys with more than
``GROUP`` words they are halved again, down to single code points, so that a key's
words are bounded by the alphabet.
"""

from __future__ import annotations

import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.session import written

MIN_LENGTH, MIN_COUNT = 5, 3
# One (document, run) in so many loses a code point.
DAMAGED = 97
# Words of one machine before its segment is halved, and counts held by a task.
GROUP = 4_096
_HELD = 400_000
_GROUPS_AT_ONCE = 2_000

_RUN_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256)
)


def runs(text: str | None) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF in Latin-1, A-Z in lower case.

    Code points beyond Latin-1 become a question mark there, which ends a run as
    they do.
    """
    return text.encode("latin-1", "replace").translate(_RUN_TABLE).split() if text else []


def document_words(doc_id: int | None, text: str | None) -> Iterator[tuple[bytes, int]]:
    """The words of a document long enough to count, damaged where the hash says so."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(runs(text)).items():
        if len(run) < MIN_LENGTH:
            continue
        utf8 = run if run.isascii() else run.decode("latin-1").encode()
        h = zlib.crc32(utf8, start)
        if h % DAMAGED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < MIN_LENGTH:
                continue
        yield run, n


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def table() -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in held], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], ["word", "n"])

    held: dict[bytes, int] = {}
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            for word, n in document_words(doc_id.as_py(), text.as_py()):
                held[word] = held.get(word, 0) + n
            if len(held) > _HELD:
                yield table()
                held = {}
    if held:
        yield table()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of whole texts with ``MIN_COUNT`` occurrences or more."""
    counts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    return (
        counts.mapInArrow(_count_words, "word string, n long")
        .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)
    )


class Acceptors:
    """Minimised acceptors of sets of equally long strings, sharing their states.

    A state is its arcs (code point, next state, strings before it in order), so
    equal right languages are one state; state 0 accepts the empty string only.
    Strings are named by their place in the sorted set.
    """

    def __init__(self) -> None:
        self.arcs: list[tuple] = [()]
        self.size = [1]
        self._known: dict[tuple, int] = {}
        self._common: dict[tuple[int, int], list] = {}
        self._replaced: dict[int, list] = {}
        self._inserted: dict[tuple[int, int, bool], list] = {}

    def build(self, words: list[str], lo: int, hi: int, at: int) -> int:
        """State after ``at`` code points for the sorted words from lo to hi."""
        if at == len(words[lo]):
            return 0
        arcs, total = [], 0
        while lo < hi:
            first, end = words[lo][at], lo + 1
            while end < hi and words[end][at] == first:
                end += 1
            state = self.build(words, lo, end, at + 1)
            arcs.append((first, state, total))
            total += self.size[state]
            lo = end
        key = tuple(arcs)
        if key not in self._known:
            self._known[key] = len(self.arcs)
            self.arcs.append(key)
            self.size.append(total)
        return self._known[key]

    def common(self, p: int, q: int) -> list[tuple[int, int]]:
        """Places of the strings that both states accept: nothing is left to edit."""
        if p == q:
            return [(i, i) for i in range(self.size[p])]
        found = self._common.get((p, q))
        if found is None:
            found, there = [], {a: (state, before) for a, state, before in self.arcs[q]}
            for a, p_next, p_before in self.arcs[p]:
                if a in there:
                    q_next, q_before = there[a]
                    found += [(p_before + i, q_before + j) for i, j in self.common(p_next, q_next)]
            self._common[p, q] = found
        return found

    def replaced(self, q: int) -> list[tuple[int, int]]:
        """Pairs i < j of strings of one state that differ in one code point."""
        found = self._replaced.get(q)
        if found is None:
            found, arcs = [], self.arcs[q]
            for place, (_, state, before) in enumerate(arcs):
                found += [(before + i, before + j) for i, j in self.replaced(state)]
                for _, other, further in arcs[place + 1 :]:
                    found += [(before + i, further + j) for i, j in self.common(state, other)]
            self._replaced[q] = found
        return found

    def inserted(self, p: int, q: int, at_end: bool) -> list[tuple[int, int]]:
        """Pairs of a string of p and the same with one code point more in q.

        That code point stands at the first difference, so it is not followed by
        itself. Behind the last code point it counts only where ``at_end`` says.
        """
        found = self._inserted.get((p, q, at_end))
        if found is None:
            found, there = [], {a: (state, before) for a, state, before in self.arcs[q]}
            if p == 0 and at_end:
                found = [(0, before) for _, before in there.values()]
            for a, p_next, p_before in self.arcs[p]:
                if a in there:
                    q_next, q_before = there[a]
                    found += [
                        (p_before + i, q_before + j)
                        for i, j in self.inserted(p_next, q_next, at_end)
                    ]
                for b, (q_next, q_before) in there.items():
                    if b == a:
                        continue
                    for c, state, before in self.arcs[q_next]:
                        if c == a:
                            found += [
                                (p_before + i, q_before + before + j)
                                for i, j in self.common(p_next, state)
                            ]
            self._inserted[p, q, at_end] = found
        return found


def near_pairs(short: list[str], long: list[str], at_end: bool) -> tuple[list, list]:
    """Near pairs of sorted distinct strings: within ``short``, and short with long.

    All of ``short`` have one length, all of ``long`` one more. Pairs are places in
    the lists. A difference behind the end of the shorter counts if ``at_end``.
    """
    # The recursion goes as deep as the strings are long; its frames are on the heap.
    depth = len(short[0] if short else long[0]) if short or long else 0
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 2 * depth + 1_000))
    machine = Acceptors()
    p = machine.build(short, 0, len(short), 0) if short else None
    q = machine.build(long, 0, len(long), 0) if long else None
    same = machine.replaced(p) if p else []
    return same, machine.inserted(p, q, at_end) if p is not None and q is not None else []


def _near_in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of a key: near words under it, and the one of largest n."""
    for whole in batches:
        for first in range(0, whole.num_rows, _GROUPS_AT_ONCE):
            batch = whole.slice(first, _GROUPS_AT_ONCE)
            groups = batch.column("members")
            ends = groups.offsets.to_numpy()
            # Offsets count from the start of the flat arrays, slices or not.
            members = groups.values
            base, last = int(ends[0]), int(ends[-1])
            names = members.field("word").slice(base, last - base).to_pylist()
            counts = members.field("n").slice(base, last - base).to_numpy()
            out: tuple[list, list, list, list] = ([], [], [], [])
            keys = zip(*(batch.column(c).to_pylist() for c in ("m", "lo", "hi")))
            for (m, lo, hi), start, end in zip(keys, ends - base, ends[1:] - base):
                _summarise(names[start:end], counts[start:end], m, lo, hi, out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())],
                ["word", "n_near", "near_n", "near"],
            )


def _summarise(names: list[str], counts: np.ndarray, m: int, lo: int, hi: int, out: tuple) -> None:
    by_name = dict(zip(names, counts.tolist()))
    short = sorted(w for w in names if len(w) == m)
    long = sorted(w for w in names if len(w) != m)
    # Under one key words differ in the middle only, so both orders agree.
    same, other = near_pairs(
        [w[lo:hi] for w in short], [w[lo : hi + 1] for w in long], at_end=hi == m
    )
    found: dict[str, tuple[int, int, str]] = {}

    def note(word: str, near: str) -> None:
        n = by_name[near]
        old = found.get(word)
        if old is None:
            found[word] = (1, n, near)
        elif n > old[1] or (n == old[1] and near < old[2]):
            found[word] = (old[0] + 1, n, near)
        else:
            found[word] = (old[0] + 1, old[1], old[2])

    for pairs, partners in ((same, short), (other, long)):
        for i, j in pairs:
            note(short[i], partners[j])
            note(partners[j], short[i])
    for word, (n_near, n, near) in found.items():
        for column, value in zip(out, (word, n_near, n, near)):
            column.append(value)


def _with_outer(rows: DataFrame) -> DataFrame:
    """Adds what of the word lies outside its segment; m, lo and hi say how it splits."""
    outer = F.concat(
        F.expr("substring(word, 1, lo)"), F.expr("right(word, m - hi)")
    )
    return rows.withColumn("outer", outer)


def _segments(words: DataFrame) -> DataFrame:
    """A row for each word, length m of the shorter word of a pair, and half of it."""
    m = F.explode(F.expr(
        f"filter(array(length(word), length(word) - 1), m -> m >= {MIN_LENGTH})"
    ))
    half = F.floor(F.col("m") / 2).cast("int")
    cut = F.explode(F.array(
        F.struct(F.lit(0).alias("lo"), half.alias("hi")),
        F.struct(half.alias("lo"), F.col("m").alias("hi")),
    ))
    rows = words.select("word", "n", m.alias("m")).select("word", "n", "m", cut.alias("cut"))
    return _with_outer(rows.select("word", "n", "m", "cut.lo", "cut.hi"))


def _halved(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    cut = F.explode(F.array(
        F.struct(F.col("lo").alias("lo"), middle.alias("hi")),
        F.struct(middle.alias("lo"), F.col("hi").alias("hi")),
    ))
    return _with_outer(
        rows.select("word", "n", "m", cut.alias("cut")).select("word", "n", "m", "cut.lo", "cut.hi")
    )


_KEY = ("m", "lo", "hi", "outer")


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n_near, near_n, near) of words with a near word; ``near`` has most n.

    ``words`` is (word, n) with distinct words. Keys with more than ``group`` words
    go on with halved segments instead of being collected; the loop asks once a
    round whether there are any.
    """
    rows, parts = _segments(words), []
    while True:
        sizes = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("size"))
        hot = written(
            sizes.where((F.col("size") > group) & (F.col("hi") - F.col("lo") > 1)).select(*_KEY)
        )
        done = hot.isEmpty()
        cold = rows if done else rows.join(hot, list(_KEY), "left_anti")
        collected = (
            cold.groupBy(*_KEY).agg(F.collect_list(F.struct("word", "n")).alias("members"))
            .where(F.size("members") > 1).select("m", "lo", "hi", "members")
        )
        parts.append(written(collected.mapInArrow(
            _near_in_groups, "word string, n_near long, near_n long, near string"
        )))
        if done:
            break
        rows = written(_halved(rows.join(hot, list(_KEY), "left_semi")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    return (
        every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
        .select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every (word, form): forms followed to the last.

    Each round doubles the length of the steps. A form has twice the n of its word
    at least, so there is no circle and rounds are few.
    """
    steps = written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        steps = written(
            steps.join(further, F.col("root") == F.col("_word"), "left").select(
                "word", F.coalesce("_root", "root").alias("root"),
                F.col("_root").isNotNull().alias("moved"),
            )
        )
        if steps.where("moved").isEmpty():
            return steps.select("word", "root")
        steps = steps.select("word", "root")


def variants(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """Words of the texts with their near words, form and root.

    Columns: word, n, n_near (0 if none), form (the near word of largest n, ties by
    code points, if it has twice the n of the word; else null), form_n, root (the
    last form, or the word itself). A null text has no words; a null doc_id counts
    as an empty text in the hash that damages runs. Repeated rows count again.
    Only ``doc_id`` and ``text`` of ``docs`` are read, so other columns may have any
    name. No words, no rows.
    """
    words = written(count_words(docs))
    near = near_words(words, group)
    is_form: Column = F.col("near_n") >= 2 * F.col("n")
    joined = written(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(is_form, F.col("near")).alias("form"),
            F.when(is_form, F.col("near_n")).alias("form_n"),
        )
    )
    last = roots(joined.where(F.col("form").isNotNull()))
    return joined.join(last, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )
