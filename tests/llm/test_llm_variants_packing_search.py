"""Spelling variants, window packing and ranked search beside plain versions of them."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_cases import documents, edge_rows, lower

from linktm.llm import dual_tree_search, spelling_variants, window_packing

ROWS = edge_rows()
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# Spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form[w], form[w] and counts[form[w]], root)
    return out


def variants(frame):
    found = spelling_variants.spelling_variants(frame).collect()
    assert len(found) == len({r.word for r in found})
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found}


def variant_rows():
    rows = [(i, t) for i, t, _ in ROWS]
    chain = ["abcdefgh", "abcdefgi", "abcdefji", "abcdekji", "abclekji"]
    rows += [(50 + i, " ".join([w] * (3 << k))) for i, (k, w) in enumerate(enumerate(chain))]
    rows += [(70, "Größe größe GRÖßE grosse große große große grösse " * 4), (71, "×÷×÷× " * 3 + "×÷×÷ " * 9)]
    # Anagrams share all letters, ties share all counts.
    rows += [(80 + i, "stale least steal tales slate stael teals") for i in range(5)]
    rows += [(90 + i, "aaaaa aaaaaa aaaaaaa baaaaa aaaaab") for i in range(4)]
    return rows


def test_variants_equal_a_plain_version(spark):
    rows = variant_rows()
    got = variants(documents(spark, [(i, t, "a") for i, t in rows]))
    assert got == plain_variants(rows)
    assert got["abcdefgh"][4] == "abclekji"


def test_variants_of_a_table_equal_a_plain_version(spark, tables):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    got = variants(spark.read.parquet(f"{tables}/documents.parquet"))
    want = plain_variants(rows)
    assert got == want and any(r[2] for r in want.values())


def test_counts_are_handed_on_when_the_table_is_full(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "TABLE", 2)
    rows = variant_rows()
    assert variants(documents(spark, [(i, t, "a") for i, t in rows])) == plain_variants(rows)


def test_every_near_pair_shares_a_signature(spark):
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abcé"), rng.integers(5, 9))) for _ in range(400)}
    frame = spark.createDataFrame([(w, 1) for w in sorted(words)], "word string, n long")
    got = {(r.word, r.near) for r in spelling_variants.near_words(frame).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_no_variants_in_nothing(spark):
    assert variants(documents(spark, [])) == {} and variants(documents(spark, [(1, None, "a")])) == {}


# Packing


def check_packing(rows, pieces, window=window_packing.WINDOW):
    """Every id of every row lies in one piece, and sequences are gapless. Returns the sequences' lengths."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = defaultdict(Counter)
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        texts[i][ids.tobytes()] += 1
    for i, wanted in texts.items():
        mine = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        if len(wanted) == 1 and sum(wanted.values()) == 1:
            ids = b"".join(bytes(p.ids) for p in mine)
            assert Counter([ids]) == wanted
            assert [p.start for p in mine] == [sum(q.length for q in mine[:k]) for k in range(len(mine))]
        assert sum(p.length for p in mine) == sum(n * len(ids) // 4 for ids, n in wanted.items())
    of_sequence = defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(p.ids) and len(p.ids) == 4 * p.length and p.length > 0
        of_sequence[p.sequence_id].append((p.offset, p.length))
    sizes = []
    for parts in of_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        sizes.append(sum(n for _, n in parts))
    assert max(sizes, default=0) <= window
    return sizes


def packing_rows():
    rows = [(i, t) for i, t, _ in ROWS]
    rows += [(100, "the <|endoftext|> of<|startoftext|>a text"), (101, "Ǆ ﬁ é ́x İ ß a\x1cb can't.. it's!!")]
    rows += [(200 + i, " ".join(["sea"] * (i * 37 % 3000))) for i in range(60)]
    return rows


def test_packing_keeps_every_id(spark):
    rows = packing_rows()
    pieces = window_packing.pack(documents(spark, [(i, t, "a") for i, t in rows]), TOKENIZER)
    found = pieces.collect()
    sizes = check_packing(rows, found)
    assert sum(sizes) > 0.97 * window_packing.WINDOW * (len(sizes) - 1)
    whole = {r.sequence_id: (bytes(r.ids), list(r.ends)) for r in window_packing.packed_sequences(pieces).collect()}
    for number, (ids, ends) in whole.items():
        mine = sorted((p for p in found if p.sequence_id == number), key=lambda p: p.offset)
        assert ids == b"".join(bytes(p.ids) for p in mine) and ends == [p.offset + p.length for p in mine]


def test_texts_that_cannot_be_combined_are_cut(spark):
    rows = [(i, " ".join(["sea"] * 2999)) for i in range(40)]
    sizes = check_packing(rows, window_packing.pack(documents(spark, [(i, t, "a") for i, t in rows]), TOKENIZER).collect())
    assert len(sizes) == -(-40 * 3000 // 4096)


def test_packing_a_table_leaves_little_empty(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    sizes = check_packing([(r.doc_id, r.text) for r in docs.collect()], window_packing.pack(docs, TOKENIZER).collect())
    assert sum(sizes) > 0.98 * window_packing.WINDOW * (len(sizes) - 1)


def test_packing_nothing(spark):
    assert window_packing.pack(documents(spark, []), TOKENIZER).count() == 0


def test_words_are_encoded_alike_when_the_cache_is_full(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(window_packing, "CACHE", 3)
    encoder, whole = window_packing.WordEncoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    texts = [t or "" for _, t in packing_rows()] + ["(one, two!) three.", "one two three", "x" * 200 + ". one,"]
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_least_squares_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.random((8, 20)), rng.normal(size=8)
        x = window_packing.non_negative_least_squares(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gradient <= 1e-6).all() and np.abs(gradient[x > 0]).max(initial=0) < 1e-6


def test_combinations_fill_the_window_and_the_plan_uses_what_is_there():
    have = np.zeros(17, np.int64)
    have[[1, 3, 5, 8, 16]] = 4
    rows = window_packing.combinations(16, have, 3)
    plain = {tuple(sorted(x)) for x in np.ndindex(17, 17, 17) if sum(x) == 16 and all(v == 0 or have[v] for v in x)}
    assert {tuple(r) for r in rows.tolist()} == plain
    histogram = {1: 100, 3: 7, 5: 11, 8: 3, 16: 2}
    used = Counter()
    for chosen, times in window_packing.plan_windows(histogram, 16, 3):
        assert times > 0 and sum(b * m for b, m in chosen.items()) <= 16
        used.update({b: m * times for b, m in chosen.items()})
    assert all(used[b] <= n for b, n in histogram.items())


# Ranked search


def plain_ranks(rows, items, k=50):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(i, Counter(pattern.findall(lower(t or "")))) for i, t in rows]
    n_docs, n_terms = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = Counter()
    for item, text in set(items):
        scored = []
        for i, c in docs:
            score = 0
            for t in set(pattern.findall(lower(text or ""))) & c.keys():
                m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is not None, i))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out.update((item, n + 1, i, -s) for n, (s, _, i) in enumerate(scored[:k]))
    return out


def benchmark(spark, items):
    rows = [(i, t, "x", "x", "x") for i, t in items]
    return spark.createDataFrame(rows, "item_id long, text string, id string, item string, `rank` string")


def ranks(docs, items, **kw):
    return Counter(tuple(r) for r in dual_tree_search.rank_documents(docs, items, **kw).select("item_id", "rank", "doc_id", "score").collect())


ITEMS = [(1, "Some words of line two"), (2, "日本 Ünï w3 w4 w5"), (2, "own 3"), (2, "own 3"), (3, None), (4, ""), (5, "zzz"), (None, "id but w9")]


@pytest.mark.parametrize("first", [1, 10**6])
def test_ranks_equal_a_plain_version(spark, monkeypatch, first):
    monkeypatch.setattr(dual_tree_search, "FIRST", first)
    rows = [(i, t) for i, t, _ in ROWS] + [(1000 + i, f"w{i % 7} w{i % 11} line own{i}") for i in range(300)]
    got = ranks(documents(spark, [(i, t, "a") for i, t in rows]), benchmark(spark, ITEMS))
    assert got == plain_ranks(rows, ITEMS)


def test_ranks_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(dual_tree_search, "BLOCK", 20)
    rows = [(i, t) for i, t, _ in ROWS]
    got = ranks(documents(spark, [(i, t, "a") for i, t in rows]), benchmark(spark, ITEMS), k=3)
    assert got == plain_ranks(rows, ITEMS, 3)


def test_ranks_of_nothing(spark):
    rows = [(i, t, "a") for i, t, _ in ROWS]
    assert not ranks(documents(spark, []), benchmark(spark, ITEMS))
    assert not ranks(documents(spark, [(1, None, "a")]), benchmark(spark, ITEMS))
    assert not ranks(documents(spark, rows), benchmark(spark, []))


def test_bounds_leave_pairs_out(spark):
    """Items about one subject each: documents of another are left out without a look at them."""
    weights = np.full(400, 1000, np.int64)
    tree = dual_tree_search.ItemTree([[8 * i + j for j in range(8)] for i in range(50)], weights)
    doc, term = np.divmod(np.arange(2000 * 4), 4)
    term = (doc * 7 % 50) * 8 + term
    value = np.full(len(doc), 1000, np.int64)
    row, item, score, scored = dual_tree_search.search_batch(tree, doc, term, value, 2000, np.zeros(50, np.int64))
    assert len(row) == 2000 and (score == 4_000_000).all() and scored < 2000 * 50 / 5
    none = dual_tree_search.search_batch(tree, doc, term, value, 2000, np.full(50, 10**9))
    assert len(none[0]) == 0 and none[3] == 0
