"""Text operators against brute force, exact round trips and hand-made cases."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from martlens.llm import (
    chat, chunks, decontamination, language_id, licences, order_minhash, quality_rules, queries, range_coder,
    token_files, toxicity, warc,
)
from martlens.llm.components import components, joined_components
from martlens.llm.pieces import PieceEncoder
from martlens.llm.range_coder import HEAD, decode_blocks, encode_blocks
from tests.parity import connect, spark_rows, sql_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lambda mu nu xi omi pi rho".split()


def prose(seed: int, n: int, words=WORDS) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "ed"]) for _ in range(n))


def documents(spark, rows):
    full = [(i, t, *(rest or ("en", "s")), len(t or "")) for i, t, *rest in rows]
    return spark.createDataFrame(full, DOCS)


def edge_rows():
    """Null and empty texts, null ids and hosts, a repeated row, a long text."""
    return [
        (1, None, "en", "s"), (2, "", "en", "s"), (3, " \n\t", "en", None), (None, prose(1, 80), None, "s"),
        (4, prose(2, 80), "en", "s"), (4, prose(2, 80), "en", "s"), (5, prose(3, 20_000), "en", "s"),
        (6, "<|endoftext|> x  <|endoftext|>", "en", "t"), (7, "日本語テキスト" * 60, "en", "t"),
    ]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, la, s, len(t or "")) for i, t, la, s in edge_rows()]
    return spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit("clash")).withColumn("scan", F.lit(1))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def con(sample_dir):
    return connect(sample_dir)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sample_dir, con, name):
    columns, rows = spark_rows(queries.queries()[name](spark, sample_dir))
    assert (columns, rows) == sql_rows(con, queries.oracle_sql()[name])
    assert rows


# Quality rules

def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


def test_text_statistics(spark, edges):
    texts = [r[1] for r in edge_rows()] + ["a b c a b c a b", "x x x x", "a\nb\na\n \n", "é#é| $"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    stats = quality_rules.text_statistics(F.col("text"))
    rows = df.select("text", *[c.alias(n) for n, c in stats.items()]).collect()
    for row in rows:
        assert tuple(row)[1:] == brute_statistics(row.text)


def test_frequent_lines_are_removed_and_depleted_documents_rejected(spark):
    banner = "Subscribe to our news letter today and never miss anything again 123"
    rows = [(i, f"{banner.replace('123', str(i))}\n{prose(i, 60)}", "en", "h") for i in range(20)]
    rows += [(100 + i, f"{banner}\n" * 8 + prose(100 + i, 9), "en", "h") for i in range(3)]
    rows += [(200 + i, f"{banner}\n{prose(7, 70)}", "en", "other") for i in range(30)]  # copies
    rows += [(300, f"{banner}\n" * 8 + prose(100, 9), "en", None)]
    kept = {r.doc_id: r for r in quality_rules.assess(documents(spark, rows)).collect()}
    assert kept[0].lost_words == 0 and kept[1].lost_words == 12  # the first carries the line
    assert kept[1].kept and kept[200].kept and kept[200].lost_words == 0
    # Copies are documents of their own: all but the first lose every line.
    assert all(kept[i].lost_words == 82 and not kept[i].kept for i in range(201, 230))
    assert [kept[i].n_repeat_words * 2 > kept[i].n_words for i in (100, 300)] == [True, True]
    footer = "\n".join(prose(400 + k, 7) for k in range(17))
    long = [(i, f"{footer}\n{prose(i, 6)}", "en", "h") for i in range(20)]
    verdicts = {r.doc_id: r.kept for r in quality_rules.assess(documents(spark, long)).collect()}
    assert verdicts == {i: i == 0 for i in range(20)}


def test_lines_count_once_for_each_document(spark):
    line = "One line that stands in the documents of a host"
    body = {i: f"{line}\n{prose(i, 60)}" for i in range(11)}
    few = [(i % 10, body[i % 10], "en", "h") for i in range(40)]
    assert {r.lost_words for r in quality_rules.assess(documents(spark, few)).collect()} == {0}
    many = few + [(10, body[10], "en", "h"), (10, body[10], "en", "other")]
    lost = {(r.doc_id, r.lost_words) for r in quality_rules.assess(documents(spark, many)).collect()}
    assert lost == {(0, 0), (10, 0)} | {(i, 10) for i in range(1, 11)}
    nameless = [(None, body[i], "en", "h") for i in range(11)]
    lost = [r.lost_words for r in quality_rules.assess(documents(spark, nameless)).collect()]
    assert lost == [0] * 11  # each is as much the first as the others


def test_kept_texts_lose_their_frequent_lines(spark):
    banner = "Subscribe to our news letter today number 7"
    body = [f"{prose(i, 40)}\r\n\n  {prose(50 + i, 40)} " for i in range(20)]
    rows = [(i, f"{banner}\n{x}\n\t{banner.upper()} \n", "en", "h") for i, x in enumerate(body)]
    rows += [(5, rows[5][1], "en", "h"), (100, prose(100, 60), "en", "h"), (101, f"{banner}\n{prose(9, 60)}", "en", None)]
    docs = documents(spark, rows)
    cleaned = quality_rules.keep_good(docs)
    assert cleaned.schema.names == docs.schema.names and cleaned.dtypes == docs.dtypes
    got = sorted((r.doc_id, r.text, r.n_chars) for r in cleaned.collect())
    want = [(i, t if i in (0, 100, 101) else f"{body[i]}\n") for i, t, *_ in rows]  # 0 carries the line
    assert got == sorted((i, t, len(t)) for i, t in want)
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_edges(spark, edges, nothing):
    rows = quality_rules.assess(edges).collect()
    assert len(rows) == len(edge_rows()) and sum(r.doc_id == 4 and r.kept for r in rows) == 2
    kept = quality_rules.keep_good(edges)
    assert kept.columns == edges.columns and kept.count() == 4
    assert quality_rules.assess(nothing).isEmpty() and quality_rules.keep_good(nothing).isEmpty()
    plan = quality_rules.assess(edges)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Decontamination

def brute_hits(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = find(text), set(), set()
    for item, body in items:
        w = find(body)
        for i in range(max(1, len(w) - 9)) if w else ():
            window = w[i : i + 10]
            for j in range(len(words) - len(window) + 1):
                if words[j : j + len(window)] == window:
                    hit |= set(range(j, j + len(window)))
                    found |= {str(item)} - {"None"}
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_windows", [1_000_000, 7])
def test_decontamination(spark, edges, nothing, block_windows):
    items = [(1, prose(50, 25)), (2, "Rare Short item"), (3, None), (4, " .,"), (None, prose(51, 12)),
             (1, prose(50, 25)), (10, prose(50, 14))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [prose(50, 25), f"{prose(60, 30)} {prose(50, 12)} tail", "a RARE, short!item b", prose(51, 12).upper(),
             prose(61, 200), None, "", "short item rare"]
    docs = documents(spark, [(i, t) for i, t in enumerate(texts)])
    scanned = decontamination.scan(docs, benchmark, block_windows=block_windows)
    for row in scanned.collect():
        got = row.scan.n_words, sum(b - a for a, b in zip(row.scan.starts, row.scan.ends)), list(row.scan["items"])
        assert got == brute_hits(row.text, items)
    clean = decontamination.remove_documents(docs, benchmark)
    assert {r.doc_id for r in clean.collect()} == {4, 5, 6, 7} and clean.columns == docs.columns
    cut = {r.doc_id: r.text for r in decontamination.remove_spans(docs, benchmark).collect()}
    assert cut[2] == "a  b" and cut[4] == texts[4] and cut[0] == "" and cut[5] is None
    assert decontamination.scan(edges, benchmark).count() == len(edge_rows())
    assert decontamination.scan(docs, benchmark.limit(0)).where("size(scan.starts) > 0").isEmpty()
    assert decontamination.scan(nothing, benchmark).isEmpty()


# Language

def test_languages(spark, edges, nothing, sample_dir):
    found = language_id.identify(spark.read.parquet(f"{sample_dir}/documents.parquet"))
    row = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a")).first()
    assert row.a > 0.97
    rows = {r.doc_id: r for r in language_id.identify(edges).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == "und"
    assert rows[4].lang_pred == "en" and rows[4].score == 1.0
    assert language_id.identify(nothing).isEmpty()
    unlabelled = documents(spark, [(1, "words here")]).withColumn("lang", F.lit(None).cast("string"))
    assert language_id.identify(unlabelled).first().lang_pred == "und"
    assert language_id.keep_identified(edges).columns == edges.columns


def test_filters_hold_their_grams_and_counts_are_exact_enough():
    texts = {"a": prose(1, 400), "b": "".join(reversed(prose(2, 400)))}
    grams = {k: np.unique(language_id.grams_of([language_id.letters_only(t)])[0]) for k, t in texts.items()}
    owners = np.concatenate([np.full(len(g), i) for i, g in enumerate(grams.values())])
    model = language_id.BitSlicedFilter(["a", "b"], np.concatenate(list(grams.values())), owners)
    total, found = model.counts([language_id.letters_only(t) for t in texts.values()])
    assert found[0, 0] == total[0] and found[1, 1] == total[1]  # no false negatives
    both = np.isin(language_id.grams_of([language_id.letters_only(texts["a"])])[0], grams["b"]).sum()
    assert abs(found[0, 1] - both) <= 5


def test_more_languages_than_a_plane_holds():
    names = [f"l{i:03}" for i in range(150)]
    grams = np.arange(150 * 20) * 7919 + 0x41414141
    model = language_id.BitSlicedFilter(names, grams, np.repeat(np.arange(150), 20))
    assert model.planes.shape[0] == 3
    slots = model._slots(grams[140 * 20 : 141 * 20])
    masks = model.planes[2][slots[0]] & model.planes[2][slots[1]] & model.planes[2][slots[2]]
    assert ((masks >> np.uint64(140 - 128)) & np.uint64(1)).all()


# Licences

def test_entire_texts_and_headers_of_common_licences(spark):
    folder = Path(licences.__file__).parent / "licence_texts"
    texts = [(p.stem, p.read_text()) for p in sorted(folder.glob("*.txt"))]
    assert len(texts) == 21
    texts += [(n, "\r\n".join(f"  {x.upper()}" for x in t.splitlines())) for n, t in texts]
    apache, gpl = ((folder / f"{n}.txt").read_text() for n in ("Apache-2.0", "GPL-2.0-only"))
    texts += [
        ("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "2019 Some One")),
        ("Apache-2.0", apache.partition("APPENDIX")[0]),
        ("BSD-3-Clause", "Copyright (c) 2001, A. Person\n" + next(t for n, t in licences.LICENCE_TEXTS if n == "BSD-3-Clause")),
        ("MIT", licences.LICENCE_TEXTS[0][1].replace("MIT License", "The MIT Licence (MIT)").replace("<year>", "2020")),
    ]
    comment = """ * Copyright (C) 2011  A. Person
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 *
 * You should have received a copy of the GNU General Public License
 * along with this program.  If not, see <https://www.gnu.org/licenses/>."""
    texts += [("GPL-3.0-or-later", comment), (None, comment.replace("hope", "faith")), (None, gpl + " and more")]
    got = {r.doc_id: r.licence for r in licences.scan(documents(spark, [(i, t) for i, (_, t) in enumerate(texts)])).collect()}
    assert got == {i: n for i, (n, _) in enumerate(texts)}


def test_licences(spark, edges, nothing):
    mit = dict(licences.LICENCE_TEXTS[:1])["MIT"]
    changed = mit.upper().replace("<YEAR> <COPYRIGHT HOLDERS>", "2024 Somebody").replace(",", " ;").replace("MIT LICENSE", "MIT Licence")
    rows = [(1, mit), (2, changed), (3, mit + " more"), (4, "text\nreleased under the mit licence\nLicensed under CC-BY-NC 4.0"),
            (5, "(c) 2020 Somebody"), (6, None)]
    found = {r.doc_id: r for r in licences.scan(documents(spark, rows)).collect()}
    assert found[1].licence == found[2].licence == "MIT" and found[1].digest == found[2].digest
    assert found[3].licence is None and found[4].notices == "CC-BY-NC-4.0,MIT" and found[4].notice_lines == 2
    assert found[5].digest is None and found[6].digest is None
    assert licences.scan(edges).count() == len(edge_rows()) and licences.scan(nothing).isEmpty()
    plan = licences.scan(edges)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# WARC

def test_warc(spark):
    big, small = "<p>" + "x" * 200, "<p>y</p>"
    pages = [(5, "http://a/ü\r\n", big), (2, None, big), (9, "u", big), (3, "u", small), (4, "u", small), (7, "u", None),
             (2, None, big), (None, "u", big), (8, "u", "é" * 60), (11, "u", "z" * 400_000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    index = warc.archive(frame.withColumn("digest", F.lit("clash")))
    rows = warc.read_archives(index).collect()
    assert len(rows) == len(pages)
    for row in rows:
        html = next(h for i, _, h in pages if i == row.page_id) or ""
        assert row.payload_bytes == len(html.encode())
        assert row.payload_digest == hashlib.sha256(html.encode()).hexdigest()
        refers = 2 if html == big and row.page_id != 2 else None
        assert (row.record_type, row.refers_to) == (("revisit", 2) if refers else ("response", None))
        assert row.payload == (b"" if refers else html.encode())
    for page in (5, 11):
        (record,) = warc.read_record(index, page)
        assert record[0] == page
    assert warc.read_archives(warc.archive(frame.limit(0))).isEmpty()


# Tokens

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.VOCABULARY)


HARD = ["", " ", "a  b", "x <|endoftext|>  y<|endoftext|>", " \n\n x\t\ty  ", "don't we'll I'M", "\x1cq\x85w\xa0 e　 r",
        "日本 語  テ", "a" * 300, "1234 56,78.9", "́e é", "end ", "\r\n\r\nz", "🙂🙂 🙂", "foo \n bar", "x y \x0b z"]


def as_ids(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_pieces_equal_the_library(library):
    pieces, rng = PieceEncoder(queries.VOCABULARY), random.Random(4)
    texts = HARD + ["".join(rng.choice(HARD + WORDS + [" ", "\n", "'s"]) for _ in range(40)) for _ in range(200)]
    for text in texts:
        ids = pieces.encode(text)
        assert ids == as_ids(library, text)
        assert pieces.decode(ids) == library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_chunks_equal_the_library(library):
    rng = random.Random(5)
    pieces = PieceEncoder(queries.VOCABULARY)
    coder = chunks.ChunkEncoder(pieces)
    shared = prose(77, 900)
    for i in range(40):
        text = "".join(rng.choice([*HARD, prose(i, 200), shared, "x" * 700, "語" * 900, "\n\n"]) for _ in range(6))
        data = text.encode()
        borders = chunks.cuts(data)
        assert borders[0] == 0 and borders[-1] == len(data) and borders == sorted(set(borders))
        assert max(np.diff(borders), default=0) <= chunks.MAX_BYTES + 3
        assert coder.encode(text) == as_ids(library, text)


def test_equal_passages_have_equal_chunks():
    passage = prose(9, 3000).encode()
    one, two = b"head " + passage, prose(3, 500).encode() + passage
    keys = [{data[a:b] for a, b in zip(c, c[1:])} for data in (one, two) for c in [chunks.cuts(data)]]
    assert len(keys[0] & keys[1]) > 0.8 * len(keys[0])


def test_bpe_documents(spark, edges, nothing, library):
    rows = chunks.digests(chunks.encode_documents(edges, queries.VOCABULARY)).collect()
    texts = {i: t or "" for i, t, *_ in edge_rows()}
    assert len(rows) == len(edge_rows())
    for row in rows:
        ids = as_ids(library, texts[row.doc_id])
        assert (row.n_tokens, row.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
    assert chunks.encode_documents(nothing, queries.VOCABULARY).isEmpty()


@pytest.mark.parametrize("size", [1, 7, 2048])
def test_range_coder(size):
    rng = np.random.default_rng(3)
    for ids in ([], [0], rng.integers(0, 50257, 3000), np.zeros(5000), rng.integers(0, 2**32, 500), np.arange(3000) % 7):
        ids = np.array(ids, "<u4")[: 40 * size]
        blocks = encode_blocks(ids, size)
        assert len(blocks) == -(-len(ids) // size)
        assert (decode_blocks(blocks) == ids).all()
        for number, block in enumerate(blocks[:3]):  # every block by itself
            assert (decode_blocks([block]) == ids[number * size : (number + 1) * size]).all()
    assert sum(map(len, encode_blocks(np.tile(rng.integers(0, 50257, 50), 200)))) < 5000


def test_coded_ids_are_smaller_than_zlib_makes_them(sample_dir, library):
    texts = pq.read_table(f"{sample_dir}/documents.parquet", columns=["text"])["text"].to_pylist()
    ids = np.concatenate([library.encode(t, add_special_tokens=False).ids for t in texts if t])[:200_000]
    for size in (range_coder.BLOCK_IDS, 65_536):
        runs = [ids[i : i + size].astype("<u2").tobytes() for i in range(0, len(ids), size)]
        coded = sum(map(len, encode_blocks(ids, size)))
        assert coded < 0.85 * sum(len(zlib.compress(r, 9)) for r in runs)
        assert 8 * coded < (8.3 if size < 65_536 else 7.9) * len(ids)


def test_halved_counts_and_mixed_blocks():
    ids = np.tile(np.arange(700, dtype="<u4") % 3, 30)
    assert (decode_blocks(encode_blocks(ids, 20_000)) == ids).all()
    other = np.array([2**32 - 1, 0, 2**31], "<u4")
    assert (decode_blocks(encode_blocks(ids) + encode_blocks(other)) == np.concatenate([ids, other])).all()


def test_coding_an_id_takes_no_sums_over_whole_rows():
    """Both ways take less than three running sums over the 256 counts of a row would."""
    ids = np.minimum(np.random.default_rng(5).zipf(1.3, 1 << 20), 50_000).astype("<u4")
    rows = np.ones((1024, 256), np.int16)
    began = time.process_time()
    for _ in range(100):
        np.cumsum(rows, axis=1, dtype=np.int32)
    sums = (time.process_time() - began) / 102_400
    began = time.process_time()
    assert (decode_blocks(encode_blocks(ids)) == ids).all()
    assert (time.process_time() - began) / len(ids) < 3 * sums


def test_frequent_pieces_stay_kept(library, monkeypatch):
    monkeypatch.setattr("martlens.llm.pieces.KEPT_PIECES", 40)
    pieces, seen = PieceEncoder(queries.VOCABULARY), []
    learn = pieces._learn
    monkeypatch.setattr(pieces, "_learn", lambda missing: seen.extend(missing) or learn(missing))
    for i in range(60):
        text = f"the same words stand here, then w{i} x{i} and " + "y" * (40 + i)
        assert pieces.encode(text) == as_ids(library, text)
    assert len(pieces.kept) <= 60
    assert seen.count(" words") == 1 and seen.count(" w7") == 1


def test_a_short_last_block_stands_by_itself():
    for ids in (np.full(1702, 65_535, "<u4"), np.arange(1702, dtype="<u4") % 90 * 1000):
        for size in (5000, 1700, 1000):
            blocks = encode_blocks(ids, size)
            assert (decode_blocks(blocks) == ids).all()
            assert (decode_blocks(blocks[-1:]) == ids[(len(blocks) - 1) * size :]).all()


def test_damaged_block_is_noticed():
    (block,) = encode_blocks(np.arange(500) % 50)
    at = HEAD.size + 20
    with pytest.raises(ValueError, match="damaged"):
        decode_blocks([block[:at] + bytes([block[at] ^ 255]) + block[at + 1 :]])


def test_token_files(spark, edges, nothing, library):
    files = token_files.write_tokens(edges, queries.VOCABULARY, file_ids=400)
    assert files.count() > 1
    rows = token_files.read_tokens(files, with_ids=True).orderBy("start").collect()
    texts = sorted(((r[0], r[1]) for r in edge_rows()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in rows] == [i for i, _ in texts]
    start = 0
    for row, (_, text) in zip(rows, texts):
        ids = as_ids(library, text or "") + (2).to_bytes(4, "little")
        assert (row.start, row.n_tokens, row.ids_crc32, bytes(row.ids)) == (start, len(ids) // 4, zlib.crc32(ids), ids)
        start += row.n_tokens
    assert token_files.read_tokens(token_files.write_tokens(nothing, queries.VOCABULARY)).isEmpty()


# Near duplicates

def edited(text, seed, edits):
    rng, words = random.Random(seed), text.split()
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + rng.choice([0, 1])] = [f"new{rng.randrange(999)}"]
    return " ".join(words)


def brute_similarity(a, b):
    def shingles(text):
        words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())
        seen, out = Counter(), []
        for i in range(max(1, len(words) - 4)):
            key = tuple(words[i : i + 5])
            out.append((key, seen[key]))
            seen[key] += 1
        return out

    x, y = shingles(a), shingles(b)
    row = [0] * (len(y) + 1)
    for s in x:
        last = row[:]
        for j, t in enumerate(y):
            row[j + 1] = last[j] + 1 if s == t else max(row[j], last[j + 1])
    return row[-1] / (len(x) + len(y) - row[-1])


def test_alignment_is_the_longest_common_subsequence():
    for seed in range(25):
        a = prose(seed, 120)
        b = edited(a, seed, seed % 9)
        got = order_minhash.aligned_similarity(*map(order_minhash.labelled_shingles, (a, b)))
        assert got == pytest.approx(brute_similarity(a, b)) or brute_similarity(a, b) < 0.8


def test_near_duplicates_against_brute_force(spark):
    texts = []
    passage = prose(999, 60)
    for group in range(12):
        base = prose(group, 150 + group)
        texts += [edited(base, group * 50 + k, k % 4) for k in range(group + 1)] + [base]
        texts.append(f"{passage} {prose(500 + group, 120)}")
    rows = list(enumerate(texts))
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in rows:
        for j, b in rows[:i]:
            if abs(len(a) - len(b)) < 0.4 * len(a) and brute_similarity(a, b) >= 0.8:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    docs = documents(spark, rows)
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    assert got == {i: root(i) for i, _ in rows}
    kept = order_minhash.keep_first(docs)
    assert {r.doc_id for r in kept.collect()} == set(got.values()) and kept.columns == docs.columns


def test_short_texts_meet_without_loss(spark):
    texts, n = {}, 0
    for size in [*range(1, 60)]:
        for extra in (0, 1, 2):
            base = [f"w{size}x{extra}y{k}" for k in range(size + extra)]
            longer = " ".join(base)
            middle = base[: size // 2] + ["new"] + base[size // 2 + 1 :]
            for text in (" ".join(base[:size]), longer, " ".join(middle), longer.upper() + "!"):
                texts[n], n = f"{text}", n + 1
    # A frequent passage in texts that are else different.
    texts |= {n + k: f"all of these words stand in each text {prose(k, 3 + k % 40)}" for k in range(150)}
    docs = documents(spark, list(texts.items()))
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    shingles = {i: order_minhash.labelled_shingles(t) for i, t in texts.items()}
    want = {i: i for i in texts}
    # Only pairs with a text of few shingles are sure to be found.
    for i in texts:
        for j in range(i):
            a, b = shingles[i], shingles[j]
            if min(len(a), len(b)) <= order_minhash.EXACT and order_minhash.aligned_similarity(a, b) >= 0.8:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = {k: new if v == old else v for k, v in want.items()}
    pairs = [(8, 9), (9, 10), (11, 12)]
    for one, two in pairs:
        words = [f"z{k}" for k in range(two)]
        a, b = (order_minhash.labelled_shingles(" ".join(words[:k])) for k in (one, two))
        assert order_minhash.aligned_similarity(a, b) >= 0.8
    for size, _ in pairs:
        at = (size - 1) * 12 + 4  # the texts of one more word
        assert got[at] == got[at + 1] == at
    sure = {i for i in texts if len(shingles[i]) <= order_minhash.EXACT}
    assert {i: got[i] for i in sure} == {i: want[i] for i in sure}


def test_links_beyond_the_leader_are_found(spark):
    """Members of a bucket that the leader does not match are compared with each other."""
    members = spark.createDataFrame([(b"a", 1), (b"b", 1), (b"c", 1), (b"d", 1)], "node binary, key long")
    assert {(bytes(r.u), bytes(r.v)) for r in order_minhash.leader_pairs(members).collect()} == {
        (b"a", b"b"), (b"a", b"c"), (b"a", b"d")}
    base = prose(1, 120)
    texts = {b"a": prose(9, 120), b"b": prose(8, 120), b"c": base, b"d": edited(base, 1, 1)}
    labels = spark.createDataFrame([(b"a", b"a"), (b"b", b"a")], "node binary, label binary")
    mixed = order_minhash.in_mixed_buckets(members, labels)
    assert order_minhash.count_open_pairs(mixed) == 5
    frame = spark.createDataFrame(list(texts.items()), "node binary, text string")
    links = order_minhash.links_of_lists(order_minhash.open_lists(mixed, frame)).collect()
    assert {(bytes(r.u), bytes(r.v)) for r in links} == {(b"c", b"d")}


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    links += [(300, 300 + i) for i in range(1, 50)]
    parent = {x: x for link in links for x in link}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got.get(x, x) == root(x) for x in parent)
    assert components(spark.createDataFrame([], "u long, v long")).isEmpty()


def test_components_joined_step_by_step_equal_those_of_all_links(spark):
    rng = random.Random(3)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(20)]
    rng.shuffle(links)
    frame = lambda part: spark.createDataFrame(part, "u long, v long")
    labels = components(frame(links[:30]))
    for part in (links[30:50], links[50:], links[:5], []):
        labels = joined_components(labels, frame(part))
    whole = {r.node: r.label for r in components(frame(links)).collect()}
    got = labels.collect()
    assert len(got) == len(whole) and {r.node: r.label for r in got} == whole


@pytest.mark.parametrize("columns", [7, 65_536])
def test_no_alignable_pair_is_ruled_out(monkeypatch, columns):
    monkeypatch.setattr(order_minhash, "_COLUMNS", columns)
    texts = [edited(prose(n, size), 10 * n + k, k) for n, size in enumerate((3, 60, 200)) for k in range(6)]
    lists = [order_minhash.labelled_shingles(t) for t in ["", *texts]]
    passed = set(zip(*(x.tolist() for x in order_minhash.may_reach(lists, lists, 0.8))))
    alike = {
        (i, j) for i, a in enumerate(lists) for j, b in enumerate(lists)
        if order_minhash.aligned_similarity(a, b) >= 0.8
    }
    assert alike and alike <= passed and len(passed) < len(lists) ** 2 / 2


def test_near_duplicate_edges(spark, edges, nothing):
    rows = order_minhash.near_duplicates(edges).collect()
    assert len(rows) == len(edge_rows())
    assert {r.class_id for r in rows if r.doc_id == 1} == {1}
    assert order_minhash.near_duplicates(nothing).isEmpty() and order_minhash.keep_first(nothing).isEmpty()


# Toxicity

def test_toxicity(spark, edges, nothing):
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = prose(i, 60).split()
        if toxic:
            for bad in random.Random(i).sample(["scoundrel", "villainous", "wretched"], 2):
                words.insert(random.Random(i).randrange(50), bad)
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    docs = documents(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = toxicity.score(docs, marks).where("held_out").collect()
    assert all(r.predicted == int(r.doc_id % 6 == 0) for r in scored) and len(scored) > 50
    first = {r.doc_id: r.score for r in toxicity.score(docs, marks).collect()}
    flipped = marks.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert first == {r.doc_id: r.score for r in toxicity.score(docs, flipped).collect()}
    edge = toxicity.score(edges, marks).collect()
    assert len(edge) == len(edge_rows()) and all(0 <= r.score <= 1 for r in edge)
    assert toxicity.score(nothing, marks.limit(0)).isEmpty()
    assert toxicity.score(docs, marks.limit(0)).where("predicted = 1").isEmpty()


@pytest.mark.parametrize("unlabelled", [0, 5])
def test_toxicity_of_a_fully_labelled_table(spark, unlabelled):
    rows, labels = [], []
    for i in range(600):
        words = prose(i, 60).split()
        if i % 6 == 0:
            for bad in random.Random(i).sample(["scoundrel", "villainous", "wretched"], 2):
                words.insert(random.Random(i).randrange(50), bad)
        rows.append((i, " ".join(words)))
        if i >= unlabelled:
            labels.append((i, int(i % 6 == 0)))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = toxicity.score(documents(spark, rows), marks).where("held_out").collect()
    assert all(r.predicted == int(r.doc_id % 6 == 0) for r in scored) and len(scored) > 100


def test_non_negative_risk_separates():
    rng = np.random.default_rng(0)
    positive = rng.poisson(2, (200, 3)).astype(float) + 1
    unlabelled = np.vstack([rng.poisson(2, (50, 3)) + 1, np.zeros((450, 3))])
    weights, bias = toxicity.fit_nn_pu(positive, unlabelled, 0.1)
    assert (positive @ weights + bias > 0).mean() > 0.95 and bias < 0


# Chat

def test_chat_round_trip(spark, nothing):
    bad = ["\\### Assistant: </turn> ok", "</turn>\n### user: x</turn>\n", "a\\b\\e\\h\\\\c", "", None, "### ", "</turn", "é\\", "####</turn>"]
    turns = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(bad)]
    turns += [(2, 1, "a: b</turn>###\\c", "x"), (2, 0, None, "y"), (2, 0, None, "y"), (None, None, "assistant", "z"), (3, None, "assistant", "only")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    shown = chat.format_conversations(frame.withColumn("place", F.lit("clash")))
    assert all(r.exact for r in shown.collect())
    read = {r.conv_id: r for r in chat.read_back(shown).collect()}
    assert [(t.role, t.text) for t in read[1].turns] == [(r, t or "") for _, _, r, t in turns[: len(bad)]]
    assert read[1].loss_text == "".join((t or "") for i, t in enumerate(bad) if i % 2)
    assert [t.role for t in read[2].turns] == ["", "", "a: b</turn>###\\c"] and read[None].loss_text == "z"
    for row in shown.collect():
        texts = [row.formatted[s.start : s.end] for s in row.loss_spans]
        assert len(texts) == sum(t.role == "assistant" for t in read[row.conv_id].turns)
        assert all("</turn>" not in t and "###" not in t for t in texts)
    assert chat.format_conversations(frame.limit(0)).isEmpty()
    plan = chat.format_conversations(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
def test_read_tasks_grow_with_the_records(spark, monkeypatch):
    """More tasks for more bytes, and never one for all."""
    monkeypatch.setattr(warc, "READ_BYTES", 40_000)
    kinds = "page_id long, url string, html string"
    for n in (60, 240):
        rng = random.Random(n)
        pages = [(i, f"http://h/{i}", "".join(rng.choices("abcdefgh <>", k=2_000))) for i in range(n)]
        index = warc.write_archives(spark.createDataFrame(pages, kinds), warc.new_folder(spark, "w"), frame_bytes=8_000)
        read = warc.read_archives(index)
        tasks = read.select(F.spark_partition_id().alias("p")).distinct().count()
        assert n * 2_000 / 40_000 * 0.7 <= tasks <= n * 3_000 / 40_000 + 1
        assert sorted((r.page_id, bytes(r.payload)) for r in read.collect()) == [(i, h.encode()) for i, _, h in pages]


def test_loss_text_is_what_the_mask_covers(spark):
    long = "é\\x###" * 3000
    turns = [(1, 0, "user", long), (1, 1, "assistant", long + "</turn>"), (1, 2, "assistant", ""), (1, 3, "assistant", "zé" * 4096),
             (2, 0, "user", "no reply"), (-7, 0, "user", "a"), (-7, 1, "assistant", "b")]
    shown = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    read = {r.conv_id: r.loss_text for r in chat.read_back(shown).collect()}
    assert read == {1: long + "</turn>" + "zé" * 4096, 2: "", -7: "b"}
    moved = F.transform("loss_spans", lambda s: F.struct((s["start"] - 1).alias("start"), s["end"].alias("end")))
    wrong = chat.read_back(shown.withColumn("loss_spans", moved)).collect()
    assert {r.conv_id: r.loss_text for r in wrong}[-7] == " b"
    broken = shown.withColumn("exact", F.col("conv_id") != 2)
    with pytest.raises(Exception, match="not recovered: conversation 2"):
        chat.read_back(broken).collect()


def test_smallest_document_id_is_kept(spark):
    rows = [(-(2**63), "a b"), (None, "c"), (0, "d"), (2**63 - 1, None)]
    files = token_files.write_tokens(documents(spark, rows), queries.VOCABULARY)
    read = token_files.read_tokens(files).orderBy("start").collect()
    assert [r.doc_id for r in read] == [None, -(2**63), 0, 2**63 - 1]
