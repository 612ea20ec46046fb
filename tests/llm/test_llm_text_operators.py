import hashlib
import zlib

import numpy as np
import pytest
from check_oracles import compare, connect
from llm_cases import components, documents, edge_rows, kept_lines, lower, shingles, words
from pyspark.sql import functions as F

from linktm.llm import minhash_hamming, oracles, queries
from linktm.llm.components import connected_components, contracted, relabelled, thinned
from linktm.llm.line_dedup import bitmap_positions, dedup_lines
from linktm.llm.minhash_hamming import (
    CHUNKS,
    ERRORS,
    PER_CHUNK,
    distance,
    near_duplicates,
    postings,
    signature,
)
from linktm.llm.minhash_hamming import _families as families
from linktm.llm.quality_rules import base_counts, quality_rules
from linktm.llm.shingles import shingle_set
from linktm.llm.token_files import BATCH, SEQUENCE, Encoder, TokenFile, read_digests, starts, token_folder, write_tokens
from linktm.scratch import recorded

ROWS = edge_rows()
EMPTY = []


@pytest.mark.parametrize("name", oracles.ORACLES)
def test_query_equals_its_sql(spark, tables, name):
    assert compare(spark, connect(tables), name, tables) is None


def by_row(frame, *columns):
    return sorted([tuple(r) for r in frame.select(*columns).collect()], key=repr)


# Quality rules


def repeat_words(w):
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = set()
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            covered |= set(range(i, i + 8))
    return len(covered)


def test_base_counts_equal_a_plain_count(spark):
    rows = [r for r in ROWS if len(r[1] or "") < 1000]
    rows += [(90, "a b c d e f g h " * 3 + "z", "a"), (91, "x# y$\nx# y$\n\n x# y$\n|<>", "a"), (92, "a " * 20, "a")]
    want = []
    for i, t, _ in rows:
        w, t = words(t), t or ""
        lines = [x for x in t.split("\n") if words(x)]
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat_words(w)))
    got = base_counts(documents(spark, rows))
    assert by_row(got, "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == sorted(want, key=repr)


def test_rules_reject_documents_of_host_boilerplate_only(spark):
    own = [f"word{i} " * 3 + " ".join(f"x{i}y{k}" for k in range(30)) for i in range(40)]
    line = " ".join(f"menu{k}" for k in range(25))
    rows = [(i, f"{line}\n{own[i]}", "a") for i in range(40)]
    rows += [(100, f"{line}\nhello", "a"), (101, f"{line}\nhello", "b"), (102, None, None)]
    # A text copied often is no boilerplate of its host.
    rows += [(200 + i, " ".join(f"copy{k}" for k in range(40)), "c") for i in range(50)]
    kept = {r.doc_id: r.kept for r in quality_rules(documents(spark, rows)).collect()}
    assert [i for i, k in kept.items() if not k] == [100, 102] or {i for i, k in kept.items() if not k} == {100, 102}


def test_a_limit_of_a_line_does_not_weaken_with_its_host(spark):
    """21 of 3,000 texts of a host, and of a null host, are boilerplate; 20 are not."""
    def text(i, line):
        return " ".join(f"own{i}x{k}" for k in range(6)) + "\n" + line

    rows = []
    for host, start in (("big", 0), (None, 10_000)):
        often, seldom = (" ".join(f"{w}{k}" for k in range(20)) for w in ("often", "seldom"))
        lines = [often] * 21 + [seldom] * 20
        rows += [(start + i, text(start + i, line), host) for i, line in enumerate(lines)]
        rows += [(start + i, text(start + i, f"other{i} " * 3 + f"z{i} " * 14), host) for i in range(41, 3_000)]
    got = quality_rules(documents(spark, rows)).where("not base_failed").collect()
    assert {r.doc_id for r in got if not r.kept} == {*range(21), *range(10_000, 10_021)}
    assert {r.n_boilerplate_words for r in got if r.kept} == {0}


def test_rules_on_edge_rows_and_nothing(spark):
    assert quality_rules(documents(spark, ROWS)).count() == len(ROWS)
    assert quality_rules(documents(spark, EMPTY)).count() == 0


# Line dedup


@pytest.mark.parametrize("keep_first", [False, True])
def test_lines_equal_a_plain_version(spark, keep_first):
    rows = ROWS + [(50, "\n".join(["own"] * 70 + ["A line that many SHARE"] * 3 + ["z"] * 70), "a")]
    got = dedup_lines(documents(spark, rows), 10, 1, keep_first)
    want = kept_lines([(i, t) for i, t, _ in rows], 10, keep_first)
    pairs = [(r[0], *w) for r, w in zip(rows, want)]
    assert by_row(got, "row.doc_id", "n_lines", "n_dropped", "kept_text") == sorted(pairs, key=repr)
    assert dedup_lines(documents(spark, EMPTY)).count() == 0


def test_other_columns_pass(spark):
    got = dedup_lines(documents(spark, ROWS)).select("row.*")
    assert got.columns == documents(spark, ROWS).columns


def test_bitmaps_read_back(spark):
    frame = spark.sql("SELECT array(named_struct('word', 0L, 'bits', 5L), named_struct('word', 2L, 'bits', shiftleft(1L, 63))) AS b")
    assert frame.select(bitmap_positions(F.col("b")).alias("p")).first().p == [0, 2, 191]


def test_a_hot_line_is_not_shuffled(spark):
    rows = [(i, "the common line\nown" + str(i), "a") for i in range(300)]
    got = dedup_lines(documents(spark, rows)).select(F.sum("n_dropped")).first()[0]
    assert got == 300


# Near-duplicates


def test_shingles_are_sets_of_word_runs():
    for text in ["", "a", "A b", "a b c d e", "A B C D E F A B C D E", "x " * 50, "é b c"]:
        assert len(shingle_set(text)) == len(shingles(text))
    assert set(shingle_set("A b c d e f")) & set(shingle_set("b c d e F g"))


def near_rows():
    draw = np.random.default_rng(1)
    rows = []
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(120)]
        for j in range(25):
            copy = list(base)
            for at in draw.choice(120, j // 4, replace=False):
                copy[at] = f"n{g}_{j}_{at}"
            rows.append((g * 100 + j, " ".join(copy), "a"))
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(1000 + i, passage + " " + " ".join(f"own{i}_{k}" for k in range(40)), "b") for i in range(60)]
    return rows + ROWS


def test_components_equal_brute_force(spark):
    rows = near_rows()
    got = near_duplicates(documents(spark, rows))
    # Rows of one id and other texts are told apart by their sets' sizes here.
    want = [(r[0], len(shingles(r[1])), c) for r, c in zip(rows, components([(i, t) for i, t, _ in rows]))]
    want = [(i, n, i if n == 0 else c) for i, n, c in want]
    assert by_row(got, "id", "n_shingles", "component_id") == sorted(want, key=repr)


def test_no_documents(spark):
    assert near_duplicates(documents(spark, EMPTY)).count() == 0
    assert near_duplicates(documents(spark, [(1, None, None)])).count() == 1


def test_a_large_group_is_joined_without_all_its_pairs(spark, monkeypatch):
    """The prefix filter alone has to join 40 near copies, all pairs of which are links."""
    base = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join([*base[: 2 * k + 5], f"own{k}", *base[2 * k + 6 :]]), "a") for k in range(40)]
    near, measured, pairs = minhash_hamming._near, minhash_hamming.measured, []
    monkeypatch.setattr(minhash_hamming, "_near", lambda *a: near(*a).where("false"))
    monkeypatch.setattr(minhash_hamming, "measured", lambda p, s: pairs.append(p.count()) or measured(p, s))
    assert {r.component_id for r in near_duplicates(documents(spark, rows)).collect()} == {0}
    assert sum(pairs) <= 40 * minhash_hamming.NEAREST


def test_signatures_within_the_limit_meet(spark):
    draw = np.random.default_rng(2)
    base = draw.integers(0, 1 << 16, CHUNKS * PER_CHUNK).astype("<u2")
    rows = [(0, base.view("<i8").tolist())]
    for c in range(1, 40):
        other = base.copy()
        other[draw.choice(len(base), ERRORS, replace=False)] ^= 1
        rows.append((c, other.view("<i8").tolist()))
    frame = spark.createDataFrame(rows, "c long, signature array<long>")
    keys = postings(frame)
    met = keys.alias("a").join(keys.alias("b"), "key").where("a.c = 0 and b.c > 0").select("b.c").distinct()
    assert met.count() == 39
    far = frame.alias("a").join(frame.alias("b"), F.col("a.c") < F.col("b.c")).where("a.c = 0")
    assert {r[0] for r in far.select(distance(F.col("a.signature"), F.col("b.signature"))).collect()} == {ERRORS}


def test_signatures_estimate_similarity():
    a, b = [" ".join(f"w{k}" for k in range(i, 1000 + i)) for i in (0, 100)]
    x, y = (signature(shingle_set(t), families()).view("<u2") for t in (a, b))
    assert 0.65 < (x == y).mean() <= 1.0


def test_no_prefix_filter_where_no_key_is_open(spark):
    with recorded() as paths:
        got = near_duplicates(documents(spark, [(i, f"a b c d e {i} f g h i", "s") for i in range(3)]))
        assert got.count() == 3
    stored = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in paths}
    assert "open-classes" in stored and not stored & {"prefixes", "late-links"}


def test_slots_that_differ_are_counted_by_a_short_expression(spark):
    draw = np.random.default_rng(1)
    a = draw.integers(-(2**63), 2**63, (300, CHUNKS))
    lanes = draw.choice(np.array([0, 0, 1, 0x7FFF, 0x8000, 0xFFFF], "<u2"), (300, CHUNKS, PER_CHUNK))
    b = a ^ lanes.view("<i8")[:, :, 0]
    rows = spark.createDataFrame([(x, y) for x, y in zip(a.tolist(), b.tolist())], "a array<long>, b array<long>")
    far = distance(F.col("a"), F.col("b"))
    assert [r.far for r in rows.select(far.alias("far")).collect()] == (lanes != 0).sum(axis=(1, 2)).tolist()
    assert str(far).count("^") <= 2 * CHUNKS


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 502), (500, 502)]
    got = connected_components(spark.createDataFrame(links, "a long, b long"))
    assert {(r.node, r.label) for r in got.collect()} == {(i, 0) for i in range(201)} | {(i, 500) for i in (500, 501, 502)}


def test_thinned_and_late_links_keep_the_components(spark):
    draw = np.random.default_rng(8)
    links = [tuple(map(int, sorted(draw.choice(60, 2, replace=False)))) for _ in range(40)]
    links += [(100 + h, 110 + c) for h in range(5) for c in range(30)]
    late = [(0, 100), (105, 200), (139, 200), (3, 3)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")

    def labels(pairs):
        label = {n: n for pair in pairs for n in pair}
        for _ in label:
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    thin = thinned(frame(links))
    assert thin.where("a >= 100").count() == 34
    first = connected_components(thin)
    assert {r.node: r.label for r in first.collect()} == labels(links)
    further = connected_components(contracted(frame(late), first))
    got = relabelled(first, further)
    want = labels(links + late)
    assert {r.node: r.label for r in got.collect() if r.node != 3} == {n: c for n, c in want.items() if n != 3}
    assert connected_components(frame([(4, 4), (7, 6)])).count() == 3
    assert connected_components(frame([])).count() == 0


# Token files


def tokenizer_path():
    return queries.tokenizer_path("byte_bpe_50k.json")


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    encoder = Encoder(tokenizer_path())
    draw = np.random.default_rng(3)
    parts = [" ", "\n", "\t", "\x1c", " ", "  ", "a", "the", "'s", ".", "..", "1", "é", "日", "😀", "<|endoftext|>", "x" * 90]
    for _ in range(2000):
        text = "".join(draw.choice(parts, draw.integers(0, 25)))
        ids = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == ids, text


def test_files_hold_all_ids_in_order(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    folder = token_folder(spark)
    index = write_tokens(documents(spark, ROWS), folder, tokenizer_path())
    got = read_digests(starts(index), folder).collect()
    got.sort(key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = sorted((i is not None, i or 0, len(x := plain.encode(t or "", add_special_tokens=False).ids + [0]), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t, _ in ROWS)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want


def test_sequences_and_masks(spark):
    folder = token_folder(spark)
    text = " ".join(f"w{i}" for i in range(100_000))
    index = write_tokens(documents(spark, [(1, text, "a")]), folder, tokenizer_path())
    row = index.first()
    source = TokenFile(f"{folder}/{row.file}")
    flat = np.concatenate(list(source.pieces(0, row.n_tokens)))
    assert row.n_tokens > BATCH * SEQUENCE
    last = (row.n_tokens - 1) // SEQUENCE
    for n in (0, BATCH - 1, BATCH, last):
        ids, mask = source.sequence(n)
        left = min(SEQUENCE, row.n_tokens - n * SEQUENCE)
        assert len(ids) == SEQUENCE and mask.sum() == left
        assert (ids[:left] == flat[n * SEQUENCE : n * SEQUENCE + left]).all()


def test_no_documents_no_tokens(spark):
    folder = token_folder(spark)
    index = write_tokens(documents(spark, EMPTY), folder, tokenizer_path())
    assert read_digests(starts(index), folder).count() == 0


def test_query_digests(spark, tables):
    docs = {r.doc_id: r for r in queries.table(spark, tables, "documents").collect()}
    got = queries.op9_line_dedup(spark, tables).collect()
    assert len(got) == len(docs)
    whole = [r for r in got if r.n_dropped == 0]
    assert whole and all(r.kept_sha256 == hashlib.sha256((docs[r.doc_id].text or "").encode()).hexdigest() for r in whole)
    assert lower("ÀA") == "Àa"
