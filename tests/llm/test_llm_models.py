import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import counts, documents, edge_rows, words
from pyspark.sql import functions as F

from linktm.llm import line_crf, maxent_lm, mixing, permutation_index, piece_lattice, queries, url_filter
from linktm.llm.frequent import most_frequent
from linktm.llm.skew import join_counted

ROWS = edge_rows()


# SentencePiece


def model_path():
    return queries.tokenizer_path("piece_bpe_32k.model")


def test_pieces_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path())
    draw = np.random.default_rng(4)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "é", "日", "😀", ".", "---", "1", "_", "x" * 70, "==", "́", " ", "'s"]
    rows = ROWS + [(100 + i, "".join(draw.choice(parts, draw.integers(0, 40))), "a") for i in range(300)]
    docs = documents(spark, rows)
    got = piece_lattice.encode(docs, model_path()).collect()
    want = [(i, tuple(model.encode(t or ""))) for i, t, _ in rows]
    assert sorted([(r.doc_id, tuple(r.pieces)) for r in got], key=repr) == sorted(want, key=repr)
    assert all(r.round_trip and r.n_pieces == len(r.pieces) for r in got)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.pieces, "<u4").tobytes()) for r in got)
    texts = piece_lattice.decode(piece_lattice.encode(docs, model_path()), model_path()).collect()
    assert Counter(r.text for r in texts) == Counter(t or "" for _, t, _ in rows)


def test_joined_words_equal_sent_words(spark, monkeypatch):
    docs = documents(spark, ROWS)
    want = {r.ids_crc32 for r in piece_lattice.encode(docs, model_path()).collect()}
    monkeypatch.setattr(piece_lattice, "HOT", 0)
    got = piece_lattice.encode(docs, model_path()).collect()
    assert {r.ids_crc32 for r in got} == want and all(r.round_trip for r in got)


def test_viterbi_equals_the_library(spark):
    """The same pieces as a unigram model: the fold takes the path that the library takes."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model_path(), "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1
    draw = np.random.default_rng(5)
    for piece in proto.pieces:
        if piece.type == 1:
            piece.score = -float(draw.uniform(1, 12)) * len(piece.piece) ** 0.5
    model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    bpe = piece_lattice.load_pieces(model_path())
    scores = {p: model.get_score(i) for p, i in bpe.ids.items()}
    pieces = piece_lattice.Pieces("", "unigram", bpe.ids, scores, bpe.byte_ids, 0, bpe.longest)
    texts = ["the", "another", "tokenization", "ndtheinger", "a", "été", "...", "internationally"]
    frame = spark.createDataFrame([("▁" + t, 1) for t in texts], "word string, n long").repartition(2, "word")
    for r in piece_lattice.word_cuts(frame, pieces).collect():
        got = np.frombuffer(pieces.cut(r.word, r.mask), "<u2").tolist()
        assert sum(scores[p] for p in (model.id_to_piece(i) for i in got)) == pytest.approx(
            sum(model.get_score(i) for i in model.encode(r.word[1:])), abs=1e-3
        )


def test_no_texts(spark):
    assert piece_lattice.encode(documents(spark, []), model_path()).count() == 0


def test_most_frequent_stays_within_its_limit(spark):
    frame = spark.range(1, 1001).select(F.col("id").alias("n"))
    for limit in (0, 1, 100, 5000):
        kept = [r.n for r in most_frequent(frame, limit).collect()]
        assert len(kept) <= limit and sorted(kept) == list(range(1001 - len(kept), 1001))


def test_counted_join_equals_a_join(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    counted = rows.groupBy("k").agg(F.count("*").alias("rows_here"))
    assert join_counted(rows, counted, ["k"], 30_000).count() == 30_000


# Nearest neighbours


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string, v string")


def plain_neighbours(rows, nearest=20):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v and None not in v and all(math.isfinite(x) for x in v) and any(v) and len(v) == 8:
            good.setdefault((i, tuple(np.float32(v))), None)
    out = {}
    for q, v in good:
        if q % 20 == 0:
            x = np.array(v, np.float64)
            found = sorted((-float((np.array(w, np.float64) * x).sum()), i) for i, w in good if i != q)
            out[q] = [(i, -s) for s, i in found[:nearest]]
    return out


def test_neighbours_of_edge_rows(spark):
    draw = np.random.default_rng(6)
    rows = [(i, [float(x) for x in draw.normal(size=8)], 0, "a", "b") for i in range(60)]
    same = [float(x) for x in draw.normal(size=8)]
    rows += [(i, same, 0, "a", "b") for i in range(60, 160)]
    rows += [rows[3], rows[20], (300, None, 0, "", ""), (320, [], 0, "", ""), (340, [0.0] * 8, 0, "", "")]
    rows += [(360, [float("nan")] * 8, 0, "", ""), (380, [None] * 8, 0, "", ""), (None, same, 0, "", ""), (400, [1.0], 0, "", "")]
    got = permutation_index.nearest_neighbours(vectors(spark, rows), F.col("id") % 20 == 0).collect()
    want = plain_neighbours(rows)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by.keys() == want.keys()
    assert all([r for r, _ in by[q]] == [r for r, _ in want[q]] for q in want)
    assert all(s == t for q in want for (_, s), (_, t) in zip(by[q], want[q]))


def test_few_and_no_vectors(spark):
    rows = [(i, [float(i + 1)] * 8, 0, "", "") for i in range(0, 60, 20)]
    got = permutation_index.nearest_neighbours(vectors(spark, rows), F.col("id") % 20 == 0)
    assert got.count() == 6
    assert permutation_index.nearest_neighbours(vectors(spark, []), F.col("id") % 20 == 0).count() == 0


def test_recall_on_the_table(spark, tables):
    frame = queries.table(spark, tables, "embeddings")
    got = queries.op3_permutation_index(spark, tables).toPandas()
    table = frame.toPandas()
    x = np.array(table.embedding.tolist(), np.float64)
    ids = table.vec_id.to_numpy()
    hits = total = 0
    for at in np.flatnonzero(ids % 20 == 0):
        score = x @ x[at]
        score[at] = -np.inf
        near = ids[np.lexsort((ids, -score))[:20]]
        hits += len(set(near) & set(got.vec_id[got.query_id == ids[at]]))
        total += 20
    assert hits / total >= 0.9


def test_files_are_cut(spark, tables, monkeypatch):
    monkeypatch.setattr(permutation_index, "PIECE", 7)
    frame = queries.table(spark, tables, "embeddings")
    got = permutation_index.nearest_neighbours(frame, F.col("id") % 20 == 0)
    assert got.groupBy("query_id").count().where("count != 20").count() == 0


def test_a_constant_share_of_files_is_read():
    assert permutation_index.files_read(20) == 20
    assert permutation_index.files_read(60) == 24
    assert permutation_index.files_read(600) == 100
    assert permutation_index.files_read(4096) == 683
    draw = np.random.default_rng(8)
    x = draw.normal(size=(40_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots = permutation_index.Pivots(x[:200].astype(float), 1.0)
    read = pivots.order(x[:50].astype(float), False, permutation_index.files_read(200))
    posted = pivots.order(x.astype(float), True, permutation_index.POSTED)
    assert np.mean([np.isin(posted, r).any(axis=1).mean() for r in read]) > 0.65


def test_the_cut_is_over_all_files_of_a_query():
    # 150 far candidates in one file and 150 near ones in another: only near ones are within the limit.
    counted = pa.table(
        [pa.array([5, 5]), pa.array([[100], [10, 11]], pa.list_(pa.int32())), pa.array([[150], [100, 50]])],
        ["ask", "distances", "counts"],
    )
    assert permutation_index._limit(counted, 20, 1).to_pylist() == [{"ask": 5, "most": 11}]


def test_footrule_ranks_like_its_definition():
    draw = np.random.default_rng(7)
    length, pivots = 5, 12
    for _ in range(50):
        q, x = (draw.choice(pivots, length, replace=False) for _ in range(2))
        place = lambda order: [list(order).index(p) if p in order else length for p in range(pivots)]
        want = sum(abs(a - b) for a, b in zip(place(q), place(x)))
        cost = permutation_index._costs(q, pivots, length)
        got = cost[x, np.arange(length)].sum() + length * (length + 1) // 2
        assert got == want


# Mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    wanted, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rate = (wanted - sum(fixed.values())) / max(1, sum(weight[s] for s in free)) if free else 0
        above = [s for s in free if rate * weight[s] > 2 * sizes[s]]
        if not above:
            return fixed | {s: rate * weight[s] for s in free}
        fixed |= {s: 2.0 * sizes[s] for s in above}


def test_targets_equal_iterated_resharing(spark):
    draw = np.random.default_rng(8)
    for trial in range(3):
        sizes = {f"s{i}": int(draw.integers(0, 5000)) for i in range(10)} | {None: 700, "": 40, "É": 90}
        frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
        want = plain_targets(sizes)
        assert got == pytest.approx(want)


def test_mixture_of_edge_rows(spark):
    docs = documents(spark, ROWS)
    got = mixing.taken_words(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted(
        (i is None, i or 0, len(words(t))) for i, t, _ in ROWS
    )
    assert all(r.taken <= 2 * r.size for r in got)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.taken_words(docs.repartition(3)).collect()), key=repr)
    taken, sizes = Counter(), Counter()
    for r in got:
        taken[r.source_size, r.target] += r.taken
    for (size, target), n in taken.items():
        assert abs(n - target) <= mixing.BLOCK
    assert mixing.taken_words(documents(spark, [])).count() == 0
    assert not sizes


def test_mixed_texts_hold_the_taken_words(spark):
    docs = documents(spark, ROWS)
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sum(len(words(r.text)) for r in rows) == sum(r.taken for r in mixing.taken_words(docs).collect())
    assert all(r.n_chars == len(r.text) for r in rows)
    texts = Counter(w for r in rows for w in words(r.text))
    assert set(texts) <= set(counts([(i, t) for i, t, _ in ROWS]))


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_permutations_are_permutations(spark, n):
    frame = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(77).cast("long")).alias("p"))
    got = [r.p for r in frame.collect()]
    assert sorted(got) == list(range(n))
    assert n < 64 or got != sorted(got)


def test_counts_per_shard_add_up(spark, tables):
    docs = queries.table(spark, tables, "documents")
    _, parts, slots = mixing.mix(docs)
    per = mixing.shard_counts(slots).groupBy("s").agg(F.sum("n").alias("n")).collect()
    assert sum(r.n for r in per) == slots.count()


# Language model


def test_scores_equal_plain_counts(spark):
    rows = ROWS + [(i, f"the cat {i % 5} sat on the mat", "a") for i in range(100, 160)]
    got = maxent_lm.score_texts(documents(spark, rows)).collect()
    count, n = Counter(), 0
    for i, t, _ in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            tokens = maxent_lm.tokens(t) + [b"\n"]
            count.update(tokens)
            n += len(tokens)
    want = []
    for i, t, _ in rows:
        tokens = maxent_lm.tokens(t) + [b"\n"]
        base = sum(math.log10((count[w] + 1) / (n + len(count) + 1)) for w in tokens)
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        want.append((repr(i), held, len(tokens), sum(count[w] > 0 for w in tokens), n, round(base, 6)))
    rounded = [(repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert sorted(rounded) == sorted(want)
    assert all(r.score < 0 for r in got)


def test_model_beats_the_base_on_held_out_texts(spark, tables):
    got = queries.op7_maxent_lm(spark, tables).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_joined_counts_equal_sent_counts(spark, monkeypatch):
    docs = documents(spark, ROWS)
    want = sorted((r.n_known, round(r.base_score, 6)) for r in maxent_lm.score_texts(docs).collect())
    monkeypatch.setattr(maxent_lm, "HOT", 0)
    assert sorted((r.n_known, round(r.base_score, 6)) for r in maxent_lm.score_texts(docs).collect()) == want


def test_probabilities_sum_to_one():
    draw = np.random.default_rng(9)
    weights = draw.normal(size=(1 << maxent_lm.FEATURE_BITS, maxent_lm.CLASSES)).astype(np.float32)
    codes = draw.integers(0, 1 << 40, 50)
    rows = maxent_lm.features(codes, np.arange(50))
    bias = np.zeros(maxent_lm.CLASSES, np.float32)
    p = maxent_lm.probabilities(weights, bias, rows)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    for label in (0, 7):
        logs = maxent_lm.log_probabilities(weights, bias, rows, np.full(50, label))
        assert np.allclose(np.exp(logs), p[:, label], atol=1e-4)


def test_language_model_of_nothing(spark):
    assert maxent_lm.score_texts(documents(spark, [])).count() == 0
    alone = maxent_lm.score_texts(documents(spark, [(1, None, None)])).first()
    assert alone.n_tokens == 1


def test_runs_of_words_follow_texts_whatever_the_blocks(monkeypatch):
    monkeypatch.setattr(maxent_lm, "CHUNK", 9)
    texts = [None, "", " \t\n", "  a\x0bB\x0cc\r d ", "\x1c\x85 \u00a0x É a", "a b c d e f g h i j", "k"] + [f"a {i} A" for i in range(40)]
    words = [maxent_lm.tokens(t) for t in texts]
    looked = []

    class Table(maxent_lm._Words):
        def __getitem__(self, word):
            looked.append(word)
            return super().__getitem__(word)

    found = []
    for block, size in ((1 << 30, 1 << 30), (20, 16), (1, 1)):
        monkeypatch.setattr(maxent_lm, "BLOCK", block)
        monkeypatch.setattr(maxent_lm, "SPLIT_BYTES", size)
        looked.clear()
        table, rows = Table(len), []
        batches = [pa.record_batch([pa.array(part, pa.string())], ["text"]) for part in (texts[:30], [], texts[30:])]
        runs = list(maxent_lm.chunks(batches, "text", table))
        for batch, begin, run, numbers, sizes in runs:
            assert [table[w] for w in run.cast(pa.binary()).to_pylist()] == numbers.tolist()
            ends = np.cumsum(sizes)
            flat = run.cast(pa.binary()).to_pylist()
            rows += [flat[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
        assert rows == words
        found.append([(begin, sizes.tolist()) for _, begin, _, _, sizes in runs])
        if block == 1 << 30:
            first = looked[: len(looked) - sum(map(len, words))]
            assert len(first) == sum(len({w for t in part for w in t}) for part in (words[:30], words[30:]))
    assert found[0] == found[1] == found[2]


def plain_scores(rows):
    """Scores of a model whose class factor is the class frequencies: the plain sum over all words of the class."""
    learnt = [maxent_lm.tokens(t) for i, t, _ in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for t in learnt for w in t)
    begins = Counter()
    for w, n in count.items():
        begins[w[:3]] += n
    own = sorted(begins, key=lambda b: (-begins[b], b))[: maxent_lm.CLASSES - maxent_lm.SHARED_CLASSES - 1]
    words = maxent_lm.Vocabulary({b: i + 1 for i, b in enumerate(own)}, np.zeros(0), 0, 0, 0)

    def before(text):
        codes = np.array([words.code(w) for w in text], np.int64)
        return maxent_lm.history(codes, np.arange(len(text))).tolist() if text else []

    pairs = Counter(p for t in learnt for p in zip(before(t), t))
    mass, size = Counter(words.class_of(w) for t in learnt for w in t), Counter(map(words.class_of, count))
    mass[0], size[0] = len(learnt), 1
    total = sum(mass.values()) + maxent_lm.CLASSES

    def unigram(word, c):
        return (count[word] + 1) / (mass[c] + size[c] + 1)

    def within(past, word, c):
        met = {w: n for (b, w), n in pairs.items() if b == past and words.class_of(w) == c}
        if not met:
            return unigram(word, c)
        d = maxent_lm.DISCOUNT
        return (max(met.get(word, 0) - d, 0) + d * len(met) * unigram(word, c)) / sum(met.values())

    for past in range(maxent_lm.HISTORIES):
        for c in set(map(words.class_of, count)):
            # None stands for all unknown words of the class.
            share = [within(past, w, c) for w in [None, *count] if w is None or words.class_of(w) == c]
            assert math.isclose(sum(share), 1)
    scores = []
    for i, t, _ in rows:
        text = maxent_lm.tokens(t)
        each = [(mass[c] + 1) / total * within(b, w, c) for b, w in zip(before(text), text) for c in [words.class_of(w)]]
        end = (mass[0] + 1) / total * (len(learnt) + 1) / (mass[0] + size[0] + 1)
        scores.append((repr(i), sum(map(math.log10, each)) + math.log10(end)))
    return sorted(scores)


@pytest.mark.parametrize("hot, hot_pairs", [(250_000, 2_000_000), (250_000, 3), (4, 2), (0, 0)])
def test_a_words_factor_within_its_class_depends_on_the_word_before(spark, monkeypatch, hot, hot_pairs):
    draw = np.random.default_rng(12)
    parts = ["a", "the", "then", "them", "cat", "cats", "catch", "on", "of", "mat", "é", "x1", "x2", "qqa", "qqb"]
    rows = ROWS + [(100 + i, " ".join(draw.choice(parts, draw.integers(0, 30))), "a") for i in range(60)]
    monkeypatch.setattr(maxent_lm, "HOT", hot)
    monkeypatch.setattr(maxent_lm, "HOT_PAIRS", hot_pairs)
    # The class factor without its features.
    monkeypatch.setattr(
        maxent_lm,
        "train",
        lambda texts, words, mass: (
            np.zeros((1 << maxent_lm.FEATURE_BITS, maxent_lm.CLASSES), np.float32),
            np.log((mass + 1) / (mass.sum() + maxent_lm.CLASSES)).astype(np.float32),
        ),
    )
    got = maxent_lm.score_texts(documents(spark, rows)).collect()
    scores = sorted((repr(r.doc_id), r.score) for r in got)
    for (i, score), (j, want) in zip(scores, plain_scores(rows), strict=True):
        assert i == j and score == pytest.approx(want, rel=1e-4, abs=1e-3)


# Quality classifier


def test_marginals_equal_enumeration():
    draw = np.random.default_rng(10)
    for n in (1, 2, 5, 8):
        scores, steps = draw.normal(size=n), draw.normal(size=(2, 2))
        total, good = 0.0, np.zeros(n)
        for labels in itertools.product((0, 1), repeat=n):
            weight = math.exp(sum(scores[i] * y for i, y in enumerate(labels)) + sum(steps[a, b] for a, b in zip(labels, labels[1:])))
            total += weight
            good += [weight * (y == 0) for y in labels]
        got = line_crf.forward_backward(scores, steps, np.array([n]))
        assert np.allclose(got, good / total, atol=1e-9)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.op8_quality_classifier(spark, sf)
    both = scored.join(queries.table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    assert (both.predicted == both.quality).mean() > 0.9


def test_classifier_on_edge_rows(spark):
    docs = documents(spark, ROWS)
    labels = spark.createDataFrame(
        [(2, 1), (3, 0), (4, 1), (None, 1), (7, None), (0, 0), (0, 1)], "doc_id long, quality int"
    )
    scored = line_crf.classify(docs, labels)
    assert scored.select("row.*").columns == docs.columns and scored.count() == len(ROWS)
    assert all(0 <= r.score <= 1 for r in scored.select("score").collect())
    none = line_crf.classify(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    assert line_crf.classify(documents(spark, []), labels).count() == 0


# URL filter


def urls(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, words string")


def test_rules_and_parts(spark):
    cases = {
        "http://a.example.net/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "https://EXAMPLE.net/de?q": ("example.net", "/de", "net/", "block"),
        "http://badexample.net": ("badexample.net", "", None, None),
        "http://x.org/fr/#a": ("x.org", "/fr/", "org/fr/", "allow"),
        "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, None),
        "http://a.com://b.net/c": ("a.com:", "//b.net/c", None, None),
        "no scheme.net/": ("", "", None, None),
        None: ("", "", None, None),
        "": ("", "", None, None),
    }
    rows = [(i, u, "<p>some cheap words", "h", "w") for i, u in enumerate(cases)] * 2
    got = url_filter.filter_urls(urls(spark, rows)).collect()
    assert len(got) == 2 * len(cases)
    for r in got:
        host, path, rule, verdict = list(cases.values())[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert url_filter.filter_urls(urls(spark, [])).count() == 0


def test_segments_equal_enumeration():
    logs = {w: math.log(p) for w, p in {"cheap": 0.1, "pills": 0.1, "che": 0.05, "ap": 0.1, "a": 0.2, "p": 0.01}.items()}
    assert url_filter.segment("cheappills", logs) == ["cheap", "pills"]
    assert url_filter.segment("cheapxpills", logs) == ["cheap", url_filter.UNKNOWN, "pills"]
    assert url_filter.segment("", logs) == []


def plain_log_odds(rows):
    texts = Counter(w for _, _, html, *_ in rows for w in html.lower().split() if len(w) > 1)
    least = max(1.0, url_filter.SEED_SHARE * sum(texts.values()))
    counts = dict(texts) | {s: max(least, texts[s]) for s in url_filter.SEEDS}
    logs = {w: math.log(n / sum(counts.values())) for w, n in counts.items()}
    pages = []
    for _, url, *_ in rows:
        host, _, path = url.partition("://")[2].partition("/")
        hosts, paths = ([w for n in part.replace("-", ".").replace("/", ".").split(".") for w in url_filter.segment(n, logs)] for part in (host, path))
        pages.append((not set(hosts).isdisjoint(url_filter.SEEDS), hosts + paths))
    bad, good = (Counter(w for seeded, words in pages if seeded == k for w in words) for k in (True, False))
    n, k = len(bad | good), url_filter.SMOOTHING
    odds = {w: math.log((bad[w] + k) / (bad.total() + k * (n + 1))) - math.log((good[w] + k) / (good.total() + k * (n + 1))) for w in bad | good}
    prior = math.log((sum(s for s, _ in pages) + 1) / (sum(not s for s, _ in pages) + 1))
    return [prior + math.fsum(odds[w] for w in words) for _, words in pages]


def test_rare_and_long_words_split_names(spark):
    # More different words than 50,000, all of the same count but one, and one of 26 letters.
    draw = ["".join(p) for p in itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=4)][:60_000]
    long = "zyxwvutsrqponmlkjihgfedcba"
    hosts = ["aabcaabd.com", f"{long}.com", "casino-aabc.com", "aabccasino.org/q", f"x.com/{long}aabd", "com.com"]
    rows = [(i, f"http://{h}", "com org " if i else " ".join([*draw, long]), "h", "w") for i, h in enumerate(hosts)]
    frame = urls(spark, rows)
    known = url_filter.lexicon(frame)
    names = spark.createDataFrame([("aabcaabd", 1), (f"{long}aabd", 1), ("q", 1)], "name string, rows_here long")
    words = {r.name: r.words for r in url_filter.split_names(names, known).collect()}
    assert words == {"aabcaabd": ["aabc", "aabd"], f"{long}aabd": [long, "aabd"], "q": [url_filter.UNKNOWN]}
    got = url_filter.filter_urls(frame, ()).orderBy("page_id").collect()
    assert np.allclose([r.log_odds for r in got], plain_log_odds(rows), atol=1e-9)


def test_model_blocks_seeded_hosts(spark, tables):
    got = queries.op10_url_filter(spark, tables).where("rule is null").collect()
    seeds = set(url_filter.SEEDS)
    for r in got:
        named = not seeds.isdisjoint(r.host.replace("-", ".").split("."))
        assert (r.verdict == "block") == named, r


def test_very_long_names_and_words(spark):
    """Words above the length met as substrings, one the beginning of another, in a name of thousands of letters."""
    letters = np.random.default_rng(3).choice(list("bcdfghjklm"), 900)
    first = "".join(letters[:300])
    second = first[: url_filter.SHORT] + "".join(letters[300:])
    name = (first + second + "zq") * 3
    frame = urls(spark, [(0, f"http://{name}.com/", f"{first} {second} zq zq zq com", "h", "w")])
    names = spark.createDataFrame([(name, 1)], "name string, rows_here long")
    got = url_filter.split_names(names, url_filter.lexicon(frame)).first()
    assert got.words == [first, second, "zq"] * 3 and got.rows_here == 1
