"""The training-data operators against brute force, and on the odd cases that their docstrings define."""

import re
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T

import public_tokenizers
from veristrata.llm import bpe, features, language_id, lm, mixing, ngram_join, packing, quality_model, quality_rules, toxicity, vector_dedup
from veristrata.llm.components import components, local_roots

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, kept string, label string"
PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "one", "a b c d", "x" * 5000, "the same line\nthe same line\n", "é ü 日本 😀 z", "a  b \n c", "the cat of the house and the dog " * 400]


def documents(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), None if i % 4 == 0 else f"s{i % 3}", 0, -i, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD + ["one", "one"])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(rng, n):
    return " ".join(rng.choice(["ka", "lo", "mi", "tu", "re", "son", "da", "vi"]) + rng.choice(["p", "q", "z", "x"]) + str(rng.integers(40)) for _ in range(n))


# ------------------------------------------------------------------ mixing


def test_mixing_reaches_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(1, 30)), "a" if i % 3 else "b" if i % 2 else None) for i in range(900)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    total = sum(r.size for r in out)
    sizes, taken = {}, {}
    source = {i: s for i, _, s in rows}
    for r in out:
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        sizes[source[r.doc_id]] = (r.source_size, r.target)
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    assert abs(sum(t for _, t in sizes.values()) - total) < 1e-6
    for s, (size, target) in sizes.items():
        assert target <= 3 * size + 1e-9 and abs(taken[s] - target) <= 60
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in out}


def test_mixing_odd_and_empty(odd, none):
    got = {r.doc_id: r for r in mixing.mix(odd).collect()}
    assert got[0].size == 0 and got[0].taken == 0 and len(got) == odd.count()
    assert mixing.mix(none).count() == 0


# ------------------------------------------------------------------ byte pairs


def test_codec_equals_the_library(spark, odd, none):
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    for r in bpe.encode(odd, PATH, PATTERN, keep=("doc_id", "text", "uid"), decoded=True).collect():
        ids = encoding.encode_ordinary(r.text or "")
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes() and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(none, PATH, PATTERN, decoded=True).count() == 0
    back = bpe.decode(bpe.encode(odd, PATH, PATTERN), PATH, PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in back} == {i: t or "" for i, t in enumerate([*ODD, "one", "one"])}


def test_contraction_equals_the_library_on_random_text():
    ranks = bpe.read_ranks(PATH)
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    work, rng = bpe.Codec(ranks, PATTERN), np.random.default_rng(3)
    alphabet = list("ab '\n\t s re.é1² \x1c日😀ß-")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(2000)] + ["ab" * 1500, "don't  we'll"]
    for text, ids in zip(texts, work.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(text)


def test_codec_works_in_bounded_memory(monkeypatch):
    """Queries over few pieces at a time give the same ids, and a chunk of one piece is kept once."""
    ranks = bpe.read_ranks(PATH)
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(bpe, "PIECES_AT_ONCE", 7)
    work, rng = bpe.Codec(ranks, PATTERN), np.random.default_rng(5)
    texts = [" ".join("".join(rng.choice(list("abcdeß"), 9)) for _ in range(30)) for _ in range(3)]
    assert [np.frombuffer(i, "<u4").tolist() for i in work.encode(texts)] == [encoding.encode_ordinary(t) for t in texts]
    assert len(work.spaced.now) > 80 and not work.pieces.now
    assert np.frombuffer(work.encode([texts[0] + ", end."])[0], "<u4").tolist() == encoding.encode_ordinary(texts[0] + ", end.")
    assert set(work.pieces.now) == {" " + texts[0].split()[-1], ",", " end", "."}
    work.forget()
    assert not work.spaced.now and not work.pieces.now


def test_a_batch_looks_each_distinct_chunk_up_once():
    """Repeats within a batch cost no look-up, and what was met is known again after 300,000 others."""
    ranks = bpe.read_ranks(PATH)
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    work, asked = bpe.Codec(ranks, PATTERN), []
    unmet = work.spaced.unmet
    work.spaced.unmet = lambda keys: asked.extend(w for k in keys for w in k) or unmet(keys)
    texts = ["the same grobnik " * 500 + "end", None, "", " ", " lead", "trail ", "a  b\n c", "tab\tx y\n", "\n", "nul\x00 \x00nul", "ÿ日 é日😀 ÿ日", "one", "the same grobnik"]
    coded = work.encode(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i in coded] == [encoding.encode_ordinary(t or "") for t in texts]
    assert [d.decode() for d in work.decode(coded)] == [t or "" for t in texts]
    assert len(asked) == len(set(asked)) and {"the", "same", "grobnik", "end", "lead", ""} <= set(asked)
    work.spaced.unmet = unmet
    work.contract = lambda pieces: [b"\0\0\0\0"] * len(pieces)
    for a in (0, 100_000, 200_000):
        work.encode([" ".join(f"w{i}" for i in range(a, a + 100_000))])
    work.contract = None
    assert len(work.encode([" w1 w150000 w299999 w2"])[0]) > 0


def test_the_pipeline_encodes_within_its_own_bounds(spark, odd, monkeypatch):
    """The last stage keeps fewer entries and takes less text at once than the query; ids are the same, and a worker loads the ranks once."""
    import corpus_pipeline as cp

    given, whole = [], bpe.encode
    monkeypatch.setattr(bpe, "encode", lambda *a, **k: given.append(k) or whole(*a, **k))
    docs = odd.withColumn("source", F.lit("s"))
    mine = {r.doc_id: bytes(r.ids) for r in cp.encode(spark, docs, "").collect() if r.round_trip}
    assert given[0]["kept"] <= bpe.KEPT // 4 and given[0]["at_once"] <= bpe.AT_ONCE // 2
    assert mine == {r.doc_id: bytes(r.ids) for r in whole(odd, PATH, PATTERN).collect()} == {r.doc_id: bytes(r.ids) for r in whole(odd, PATH, PATTERN, kept=4, at_once=1).collect()}
    work = bpe.codec(lambda: bpe.read_ranks(PATH), PATTERN, "test_bounds")
    work.forget(8)
    assert (work.raw.most, work.spaced.most, work.pieces.most) == (2, 8, 4)
    assert bpe.codec(None, PATTERN, "test_bounds") is work


def test_every_byte_decodes(monkeypatch):
    ranks = bpe.read_ranks(PATH)
    monkeypatch.setattr(bpe, "DECODE_AT_ONCE", 100)
    work, every = bpe.Codec(ranks, PATTERN), [bytes([i]) for i in range(256)] * 3
    ids = [np.array([ranks[b] for b in every], "<u4").tobytes(), b"", np.array(sorted(ranks.values()), "<u4").tobytes()]
    assert work.decode(ids) == [b"".join(every), b"", b"".join(sorted(ranks, key=ranks.get))]


def test_a_worker_keeps_nothing_of_a_task_that_has_ended(spark, odd):
    def kept(batches):
        import sys

        list(batches)
        found = vars(sys.modules["_veristrata_codecs"]).values() if "_veristrata_codecs" in sys.modules else []
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(k.now) + len(k.before) for c in found if isinstance(c, bpe.Codec) for k in (c.raw, c.spaced, c.pieces))], pa.int64())], ["n"])

    assert bpe.encode(odd, PATH, PATTERN).count() and len(bpe.encode(odd, PATH, PATTERN).collect()) == odd.count()
    assert sum(r.n for r in spark.range(8).repartition(4).mapInArrow(kept, "n long").collect()) == 0


# ------------------------------------------------------------------ quality rules


def test_rules_equal_brute_force(odd, none):
    for r in quality_rules.judge(odd).select("doc_id", "text", "quality.*").collect():
        w = WORD.findall(r.text or "")
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)} if len(w) < 5000 else None
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert covered is None or r.n_repeat_words == len(covered)
        assert r.base_failed == (len(w) < 50 or 100 * r.n_repeat_words > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.kept(odd).columns == odd.columns
    assert quality_rules.kept(none).count() == 0


# ------------------------------------------------------------------ language model


def test_gradients():
    model = lm.Attention(64, np.ones(64))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(0)
    past, now, want = (rng.integers(0, 62, (3, model.half)) for _ in range(3))
    past[0] = 63
    _, g = model.gradients(past, now, want, 63)
    assert set(g) == set(model.p) - set(lm.COUNTED)
    for name in g:
        value = model.p[name]
        at = np.unravel_index(np.argmax(np.abs(g[name])), value.shape)
        kept, sides = value[at], []
        for step in (1e-5, -1e-5):
            value[at] = kept + step
            sides.append(model.gradients(past, now, want, 63)[0])
        value[at] = kept
        assert abs((sides[0] - sides[1]) / 2e-5 - g[name][at]) < 1e-6


def test_model_is_a_distribution():
    model = lm.Attention(64, np.arange(1, 65.0))
    h = np.random.default_rng(2).standard_normal((1, lm.WIDTH)).astype(np.float32)
    logs = model.log_probs(np.repeat(h, 64, 0), np.zeros(64, np.int64), np.arange(64))
    assert abs(np.exp(logs).sum() - 1) < 1e-4


def test_a_token_sees_at_least_64_before_it():
    model = lm.Attention(64, np.arange(1, 65.0))
    ids = np.random.default_rng(3).integers(0, 62, 400)

    def hidden(text):
        now, _ = model.windows(text, 62, 63)
        h, _ = model.forward(np.vstack([np.full((1, model.half), 63), now[:-1]]), now, 63)
        return h.reshape(-1, lm.WIDTH)

    other = ids.copy()
    other[200] = (ids[200] + 1) % 62
    changed = np.flatnonzero((hidden(ids) != hidden(other)).any(1))
    assert changed[0] == 201 and changed[-1] >= 201 + 63


def test_windows_are_drawn_from_start_to_end():
    model = lm.Attention(64, np.arange(1, 65.0))
    line = np.concatenate([[62], np.random.default_rng(5).integers(0, 62, 4000), [62]])
    whole, _ = lm.chosen_windows(line, 63, model.half, 1.0)
    given, asked = model.rows(line, 63)
    assert len(whole) == len(given)
    assert (np.where(whole[:, model.half + 1 :] == 63, -1, whole[:, model.half + 1 :].astype(np.int64)) == asked).all()
    assert (whole[1:, : model.half] == given[:-1]).all() and (whole[0, : model.half] == 63).all()
    assert (whole[:, model.half : -1][asked >= 0] == given[asked >= 0]).all()
    some, draw = lm.chosen_windows(line, 63, model.half, 0.4)
    at = [int(np.flatnonzero((whole == w).all(1))[0]) for w in some]
    assert len(some) == len(draw) and 12 <= len(some) <= 38 and at[0] < 16 and at[-1] > 46


def test_training_lowers_the_loss():
    rng = np.random.default_rng(12)
    lines = [np.concatenate([[62], np.tile(rng.permutation(8) + 8 * rng.integers(0, 4), 30), [62]]) for _ in range(60)]
    model = lm.Attention(64, np.bincount(np.concatenate(lines), minlength=64) + 1.0)
    windows = np.concatenate([lm.chosen_windows(line, 63, model.half, 1.0)[0] for line in lines])
    before = lm.Scorer(model).score([line[1:-1] for line in lines[:5]], 62, 63).sum()
    for turn in range(3):
        model.train(windows, 63, turn, 3, batch=64)
    assert lm.Scorer(model).score([line[1:-1] for line in lines[:5]], 62, 63).sum() > 0.6 * before


def test_fast_scores_equal_the_plain_pass():
    model = lm.Attention(64, np.arange(1, 65.0))
    rng = np.random.default_rng(6)
    model.p = {k: v + rng.standard_normal(v.shape).astype(np.float32) * 0.05 for k, v in model.p.items()}
    texts = [rng.integers(0, 62, n) for n in (0, 1, 7, 8, 9, 40, 333)]
    for text, got in zip(texts, lm.Scorer(model).score(texts, 62, 63, rows_at_once=5), strict=True):
        now, want = model.windows(text, 62, 63)
        past = np.vstack([np.full((1, model.half), 63), now[:-1]])
        h, _ = model.forward(past, now, 63)
        real = want >= 0
        plain = model.log_probs(h[real], now[real], want[real]).sum() / np.log(10)
        assert got == pytest.approx(plain, rel=1e-5)


def test_scores_equal_brute_force(spark, odd):
    rng = np.random.default_rng(4)
    docs = documents(spark, [*ODD, *[words_of(rng, 60) for _ in range(40)]])
    texts = {r.doc_id: r.text for r in docs.collect()}
    spelled = {i: [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(t or "")] + ["\n"] for i, t in texts.items()}
    counts = {}
    for i, w in spelled.items():
        if zlib.crc32(str(i).encode()) % 10:
            for x in w:
                counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for head in (150_000, 8):
        for r in lm.score(docs, PATH, head_words=head).collect():
            w = spelled[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in counts for x in w), n)
            assert r.base_score == pytest.approx(sum(np.log10((counts.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel=1e-9)
            assert r.score < 0 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)


def test_the_end_token_is_known_however_few_documents_there_are(spark):
    docs = documents(spark, [" ".join(f"w{i}" for i in range(20)) + " w1" * k for k in range(4)]).repartition(1)
    whole, part = ({r.doc_id: r for r in lm.score(docs, PATH, head_words=head).collect()} for head in (150_000, 8))
    for i, r in whole.items():
        assert (part[i].n_known, part[i].n_tokens) == (r.n_known, r.n_tokens)
        assert part[i].base_score == pytest.approx(r.base_score, rel=1e-9)


def test_the_language_model_learns_from_all_training_documents(spark, odd):
    rng = np.random.default_rng(8)
    docs = documents(spark, [*ODD, *[words_of(rng, 60) for _ in range(40)]]).repartition(3)
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0, F.lit(False))
    ranks = {b: i for b, i in bpe.read_ranks(PATH).items() if i < lm.SUBWORDS - 2}
    speller = lm.Speller(ranks)
    lines = [[speller.end, *speller.ids(lm.words_of(r.text)), speller.end] for r in docs.filter(train).collect()]
    seen = np.bincount([i for line in lines for i in line[1:]], minlength=lm.SUBWORDS)
    assert (lm.subword_counts(lm.count_words(docs, train), ranks) == seen).all()
    model = lm.Attention(lm.SUBWORDS, seen)
    pairs = np.zeros((lm.SUBWORDS, lm.CLASSES))
    for line in lines:
        np.add.at(pairs, (line[:-1], model.group[line[1:]]), 1)
    read = lm.read_all(docs, train, ranks, model.group, 1.0, 3)
    assert (lm.summed(read.filter("at is not null").select("at", "c"), lm.SUBWORDS * lm.CLASSES).reshape(-1, lm.CLASSES) == pairs).all()
    before = {k: v.copy() for k, v in model.p.items()}
    windows = read.filter("at is null")
    assert {r.shard for r in windows.collect()} == {0, 1, 2}
    assert lm.learn_from(model, windows.select("shard", "window"), 3) == windows.count() == sum(-(-(len(line) - 1) // model.half) for line in lines)
    assert all(model.p[k].shape == v.shape for k, v in before.items()) and (model.p["embed"] != before["embed"]).any()


@pytest.mark.parametrize("least", [0, 10**9])
def test_parameters_are_trained_on_every_window(spark, odd, least):
    """Both where documents are trained on as they are read and where their windows are staged."""
    rng = np.random.default_rng(9)
    docs = documents(spark, [*ODD, *[words_of(rng, 60) for _ in range(300)]]).repartition(3)
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0, F.lit(False))
    ranks = {b: i for b, i in bpe.read_ranks(PATH).items() if i < lm.SUBWORDS - 2}
    speller = lm.Speller(ranks)
    sizes = [len(speller.ids(lm.words_of(r.text))) + 1 for r in docs.filter(train).collect()]
    model = lm.fit(docs, train, ranks, lm.count_words(docs, train), least=least, shard=10_000)
    assert model.windows_met == sum(-(-n // model.half) for n in sizes)
    plain = lm.Attention(lm.SUBWORDS, lm.subword_counts(lm.count_words(docs, train), ranks))
    texts = [speller.ids(lm.words_of(r.text)) for r in docs.filter(~train).collect()]
    assert lm.Scorer(model).score(texts, speller.end, speller.fill).sum() > lm.Scorer(plain).score(texts, speller.end, speller.fill).sum()


# ------------------------------------------------------------------ classifiers


def test_languages_are_told_apart(spark, none):
    rng = np.random.default_rng(5)
    sets = {"aa": ["kalo", "mitu", "reso"], "bb": ["kala", "mita", "rese"], "cc": ["xyzz", "qwop", "vrrt"]}
    rows = [(i, " ".join(rng.choice(sets[lang], 30)), lang) for i, lang in enumerate(list(sets) * 60)] + [(1000, None, "aa"), (1001, "12 !", "aa"), (1002, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert sum(got[i][0] == lang for i, _, lang in rows[:180]) == 180
    assert got[1000] == got[1001] == got[1002] == ("und", 0.0)
    assert language_id.identify(none, language_id.fit(none)).count() == 0


def test_every_language_is_learnt(spark):
    rng = np.random.default_rng(9)
    langs = {f"l{k:02d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(5)] for k in range(70)}
    rows = [(i, " ".join(rng.choice(langs[lang], 20)), lang) for i, lang in enumerate(list(langs) * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.languages == sorted(langs)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.99 * len(rows)
    few = language_id.fit(docs, each=2)
    assert few.languages == sorted(langs)


def test_quality_is_learnt(spark, none):
    rng = np.random.default_rng(6)
    rows = [(i, words_of(rng, 80) if i % 3 else "### " * 30 + "BUY!! " * 40) for i in range(240)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(240)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_model.grade(docs, quality_model.fit(docs, labels)).collect()}
    assert all(got[i].predicted == (1 if i % 3 else 0) for i in range(240))
    assert 0 <= got[900].score <= 1 and got[900].score == got[901].score
    empty = quality_model.fit(docs, labels.limit(0))
    assert {r.score for r in quality_model.grade(docs, empty).collect()} == {0.5}


def test_a_rare_toxic_term_behind_many_common_ones_is_learnt(spark):
    common = " ".join("".join("abcdefghij"[int(d)] for d in f"{k:04d}") for k in range(3300))
    rows = [(i, common + (" grobnik" if i % 10 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert "grobnik" in model.weights and not any(w in model.weights for w in common.split())


def test_toxicity_is_learnt_from_positives(spark, none):
    rng = np.random.default_rng(7)
    rows = [(i, words_of(rng, 60) + (" nastyword here" if i % 5 == 0 else "")) for i in range(600)] + [(2000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 600, 2)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.predicted for r in toxicity.rate(docs, model).collect()}
    assert all(got[i] == (i % 5 == 0) for i in range(600)) and got[2000] == 0
    assert {r.predicted for r in toxicity.rate(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0}


# ------------------------------------------------------------------ packing


def test_best_fit_takes_the_fullest_row_that_holds_it():
    rng = np.random.default_rng(8)
    for _ in range(30):
        lengths = rng.integers(1, 33, rng.integers(1, 200))
        row, room = packing.best_fit(lengths, 32), {}
        for i in np.argsort(-lengths, kind="stable"):
            fits = [v for v in room.values() if v >= lengths[i]]
            assert (row[i] in room and room[row[i]] == min(fits)) if fits else row[i] not in room
            room[row[i]] = room.get(row[i], 32) - lengths[i]


def test_long_white_space_is_encoded():
    ranks, pattern = bpe.read_ranks(PATH), PATTERN
    encode, bytes_of = packing.Library(ranks, pattern, "test"), {i: b for b, i in ranks.items()}
    for text in ("a" + " " * 3000 + "b", " \n" * 600_000):
        got = encode(text)
        assert b"".join(map(bytes_of.__getitem__, got.tolist())).decode() == text
        if len(text) < 10_000:
            assert got.tolist() == list(encode.fast(text))


def test_packing_loses_nothing(spark, odd, none):
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    parts = {}
    for r in packing.pack(odd, PATH, PATTERN, length=64, shard_segments=8).collect():
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == 64 and r.cu_seqlens[-1] == r.n_tokens <= 64 and r.position_resets == r.cu_seqlens[:-1]
        for k, doc in enumerate(r.doc_ids):
            parts[doc, r.parts[k]] = ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()
    for r in odd.collect():
        mine = sum((parts[k] for k in sorted(parts) if k[0] == r.doc_id), [])
        assert mine == [*encoding.encode_ordinary(r.text or ""), packing.END_ID]
    assert packing.pack(none, PATH, PATTERN).count() == 0


# ------------------------------------------------------------------ vectors


def test_vector_links_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    x[100:160] = x[:60] + 0.05 * rng.standard_normal((60, 16))
    x[160:180] = x[0]
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [None] * 16, 1), (403, [float("nan")] * 16, 1), (404, x[0].tolist(), None), (405, [], 1), (406, [1.0, 2.0], 1), (407, [1.0, 2.0], 1)]
    frame = spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())]))
    got = {r.vec_id: r for r in vector_dedup.link(frame).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.arange(300)[:, None] % 2 == np.arange(300) % 2)
    np.fill_diagonal(near, False)
    assert [got[i].n_links for i in range(300)] == near.sum(1).tolist()
    root = np.arange(300)
    for _ in range(300):
        root = np.array([min(root[i], *root[near[i]]) if near[i].any() else root[i] for i in range(300)])
    assert [got[i].component_id for i in range(300)] == root.tolist()
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(400, 406))
    assert got[407].component_id == 406 and got[406].n_links == 1 and not got[407].kept
    assert vector_dedup.link(frame.limit(0)).count() == 0


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def test_links_between_clusters_join_them(spark):
    at = np.radians([0, 60, 20, 40])
    got = vector_dedup.link(spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))], 1) for i, a in enumerate(at)], VECTORS)).orderBy("vec_id").collect()
    assert [(r.n_links, r.component_id, r.kept) for r in got] == [(1, 0, True), (1, 0, False), (2, 0, False), (2, 0, False)]


def test_vector_chains_and_recall(spark, monkeypatch):
    # Many small lists, a finer level among them, and blocks: chains of near vectors cross all of them.
    monkeypatch.setattr(vector_dedup, "LIST_ROWS", 8)
    monkeypatch.setattr(vector_dedup, "CENTRE_ROWS", 60)
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    rng = np.random.default_rng(14)
    chains = []
    for _ in range(20):
        x = rng.standard_normal(16)
        for _ in range(50):
            chains.append(x := x / np.linalg.norm(x) + 0.06 * rng.standard_normal(16))
    x = np.array(chains, np.float32)
    order = rng.permutation(len(x))
    frame = spark.createDataFrame([(int(i), x[i].tolist(), 1) for i in order], VECTORS)
    got = {r.vec_id: r for r in vector_dedup.link(frame).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.93
    np.fill_diagonal(near, False)
    found = np.array([got[i].n_links for i in range(len(x))])
    asked = np.arange(0, len(x), 50)
    assert (found <= near.sum(1)).all() and found[asked].sum() >= 0.9 * near.sum(1)[asked].sum() and found.sum() >= 0.9 * near.sum()
    root = roots_of(list(zip(*np.nonzero(near), strict=True)))
    assert np.mean([got[i].component_id == root.get(i, i) for i in range(len(x))]) >= 0.9


def test_vector_ties_copies_and_clashing_columns(spark):
    rows = [(5, [1.0, 0.0], 1)] * 1000 + [(4, [1.0, 0.0], 1), (3, [0.0, 1.0], 1)]
    frame = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("clash") for c in ("uid", "n_links", "kept", "node", "cell", "codes")})
    got = vector_dedup.link(frame).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(5, 1000, 4, False), (4, 1000, 4, True), (3, 0, 3, True)} and len(got) == 1002


# ------------------------------------------------------------------ n-grams


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_ngram_links_equal_brute_force(spark, none):
    rng = np.random.default_rng(10)
    texts = [words_of(rng, int(rng.integers(20, 120))) for _ in range(60)]
    for i in range(0, 60, 3):
        w = texts[i].split()
        for k in range(3):
            v = list(w)
            v[int(rng.integers(len(v)))] = f"new{k}"
            texts.append(" ".join(v))
    texts += ["one", "one", "", None, texts[0], texts[0] + "\n", "a b c d", "x" * 3000]
    docs = documents(spark, texts)
    grams = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := WORD.findall(t or "")) else frozenset() for t in texts]
    n = len(texts)
    near = np.array([[i != j and bool(grams[i]) and bool(grams[j]) and jaccard(grams[i], grams[j]) >= 0.8 for j in range(n)] for i in range(n)])
    got = {r.doc_id: r.link_ for r in ngram_join.link(docs).collect()}
    assert [got[i].n_links for i in range(n)] == near.sum(1).tolist()
    root = np.arange(n)
    for _ in range(n):
        root = np.array([min(root[i], *root[near[i]]) if near[i].any() else root[i] for i in range(n)])
    assert [got[i].class_id for i in range(n)] == root.tolist()
    assert [i for i in range(n) if got[i].kept] == sorted(set(root.tolist()))
    assert ngram_join.representatives(docs).columns == docs.columns
    assert ngram_join.link(none).count() == 0


def test_large_group_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:-1] + [f"end{k}"]) for k in range(50)]
    got = [r.link_ for r in ngram_join.link(documents(spark, texts)).collect()]
    assert {g.n_links for g in got} == {49} and {g.class_id for g in got} == {0}


def roots_of(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_components_of_paths_stars_and_trees(spark):
    rng = np.random.default_rng(13)
    path = [0, *range(4999, 0, -1)]
    shapes = [
        [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)],
        list(zip(path[:-1], path[1:], strict=True)),
        [(60_000, i) for i in range(50_000)],
        [(i, int(rng.integers(0, i))) for i in range(1, 3000) if i % 11],
    ]
    for edges in shapes:
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5, "b", "a")).collect()}
        assert got == roots_of([e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_over_many_tasks(spark):
    path = [0, *range(299, 0, -1)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = components(spark.createDataFrame(list(zip(path[:-1], path[1:], strict=True)), "a long, b long").repartition(8, "b", "a")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.node: r.root for r in got} == dict.fromkeys(range(300), 0)


def test_local_roots_in_any_order():
    path = np.array([0, *range(4999, 0, -1)])
    assert (local_roots(path[:-1], path[1:], 5000) == 0).all()


# ------------------------------------------------------------------ pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = np.random.default_rng(11)
    clean = ["the " + words_of(rng, 70).replace(" ", " and the ", 20) for _ in range(60)]
    texts = clean + [t + " nastyword nastyword" for t in clean[:20]] + [clean[30]] * 5 + ["### " * 80, None, ""]
    docs = documents(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(60 <= i < 80)) for i in range(85)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = str(tmp_path)
    step = cp.drop_toxic(spark, docs, at)
    assert {r.doc_id for r in step.collect()} == set(range(60)) | set(range(80, 88))
    ruled = cp.apply_rules(spark, step, at)
    assert {r.doc_id for r in ruled.collect()} == set(range(60)) | set(range(80, 85))
    alone = cp.drop_copies(spark, ruled, at)
    assert {r.doc_id for r in alone.collect()} == set(range(60))
    mixed = cp.mix_sources(spark, alone, at)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    out = cp.run(spark, at).collect()
    assert len(out) == mixed.count() and all(r.round_trip and len(r.ids) == 4 * r.n_tokens for r in out)


# ------------------------------------------------------------------ repeated rows, clashing names, long texts, empty tables

CLASHES = ["score", "predicted", "lang_pred", "link_", "quality", "uid", "label_", "h_", "text_", "c0", "k0", "size", "target", "copies", "ids", "held_out", "n_tokens"]


@pytest.fixture(scope="module")
def repeated(spark):
    """One doc_id a thousand times, half of them alike, and a hundred others."""
    rng = np.random.default_rng(15)
    same = "the same words and the same words " + words_of(rng, 30)
    rows = [(7, same if i % 2 else f"row {i} " + words_of(rng, 8), "en", "hot", 0) for i in range(1000)]
    rows += [(100 + i, words_of(rng, 60) + (" grobnik vile" if i % 3 == 0 else ""), "de" if i % 2 else "en", "cold", 0) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(4).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(7, 1, 0)] * 3 + [(100 + i, int(i % 4 > 0), int(i % 3 == 0)) for i in range(100)], "doc_id long, quality int, toxic int")


def test_repeated_rows_are_learnt_once(spark, repeated, labels):
    got = features.sample(repeated.filter("doc_id = 7"), F.col("lang"), 400, "language").collect()
    assert len(got) == 400 and len({r.h_ for r in got}) == 400
    known = labels.select("doc_id", "quality").distinct()
    assert features.sample(repeated, F.col("quality"), 10_000, "quality", known).count() == 501 + 100
    assert features.sample(repeated, F.col("quality"), 30, "quality", known).groupBy("label_").count().filter("count > 30").count() == 0
    for many in (5, 50):
        again = [sorted(r.h_ for r in features.sample(repeated, F.lit(0), many, "plain").collect()) for _ in range(2)]
        assert again[0] == again[1] and len(again[0]) == many


def test_classifiers_on_repeated_rows_and_clashing_names(spark, repeated, labels):
    n = repeated.count()
    keep = ("doc_id", "score", "predicted")
    for scored, out in ((language_id.identify(repeated, language_id.fit(repeated), keep), "lang_pred"), (quality_model.grade(repeated, quality_model.fit(repeated, labels), keep), "predicted"), (toxicity.rate(repeated, toxicity.fit(repeated, labels), keep), "predicted")):
        assert out in scored.columns and "score_" in scored.columns and scored.count() == n
        assert all(0 <= r.score <= 1 and r.score_ == "clash" for r in scored.collect())
    assert toxicity.clean(repeated, toxicity.fit(repeated, labels)).columns == repeated.columns


def test_other_operators_on_repeated_rows_and_clashing_names(spark, repeated):
    n = repeated.count()
    coded = bpe.encode(repeated, PATH, PATTERN, keep=("doc_id", "text", "k0"), decoded=True)
    assert all(bytes(r.decoded).decode() == r.text and r.k0 == "clash" for r in coded.collect())
    assert quality_rules.kept(repeated).columns == repeated.columns and quality_rules.judge(repeated).count() == n
    linked = ngram_join.link(repeated)
    assert linked.count() == n and linked.filter("text like 'the same%'").select("link_.n_links").distinct().collect()[0][0] == 499
    alone = ngram_join.representatives(repeated)
    assert alone.columns == repeated.columns and alone.filter("text like 'the same%'").count() == 1
    scored = lm.score(repeated, PATH).collect()
    assert len(scored) == n and len({(round(r.score, 3), r.base_score) for r in scored if r.doc_id == 7}) <= 501


def test_shards_stay_bounded_on_repeated_rows(spark, repeated):
    sizes = packing.pack(repeated, PATH, PATTERN, length=256, shard_segments=100).groupBy("shard").agg(F.sum(F.size("doc_ids")).alias("n")).collect()
    assert sum(r.n for r in sizes) == repeated.count() and max(r.n for r in sizes) <= 160


def test_equal_rows_meet_the_target(spark):
    rows = [(7, "a b c", "x")] * 1000 + [(100 + i, "a b c", "y") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = []
    for frame in (docs, docs.repartition(5)):
        out = mixing.mix(frame).collect()
        for want in {r.target for r in out}:
            mine = [r for r in out if r.target == want]
            assert abs(sum(r["taken"] for r in mine) - want) <= 3 and max(r["taken"] for r in mine) <= 9
        runs.append(sorted((r.doc_id, r["taken"]) for r in out))
    assert runs[0] == runs[1]
    kept = mixing.mix(docs.withColumn("uid", F.lit("clash")), keep=("uid", "text"), names=("uid", "text"))
    assert kept.count() == 1500 and {r.uid for r in kept.collect()} == {"clash"}


def test_long_texts(spark, labels):
    rng = np.random.default_rng(16)
    long = words_of(rng, 200_000)
    assert len(long) > 1_000_000
    docs = spark.createDataFrame([(1, long, "en", "a"), (2, "kap lox " * 30, "en", "a"), (100, "kap lox grobnik " * 20, "de", "b"), (103, "kap lox grobnik " * 20, "de", "b")], "doc_id long, text string, lang string, source string")
    hasher = features.NgramHasher(buckets=64)
    whole, features.TEXT_BYTES = features.TEXT_BYTES, 1 << 22
    one = hasher([long])
    features.TEXT_BYTES = whole
    assert np.allclose(hasher([long]), one, rtol=1e-5)
    assert language_id.identify(docs, language_id.fit(docs, held=9)).count() == 4
    assert quality_model.grade(docs, quality_model.fit(docs, labels)).count() == 4
    assert toxicity.rate(docs, toxicity.fit(docs, labels)).count() == 4
    assert {r.doc_id: r.link_.n_links for r in ngram_join.link(docs).collect()} == {1: 0, 2: 0, 100: 1, 103: 1}
    assert [len(r.ids) > 0 for r in bpe.encode(docs, PATH, PATTERN).collect()] == [True] * 4
    assert packing.pack(docs, PATH, PATTERN).count() > 100 and mixing.mix(docs).count() == 4 and quality_rules.judge(docs).count() == 4


def test_empty_tables(spark, none, labels):
    no = labels.limit(0)
    docs = none.select("doc_id", "text", "lang", "source")
    assert lm.score(docs, PATH).count() == 0
    assert quality_model.grade(docs, quality_model.fit(docs, labels)).count() == 0 == quality_model.grade(docs, quality_model.fit(docs, no)).count()
    assert toxicity.rate(docs, toxicity.fit(docs, labels)).count() == 0 == toxicity.rate(docs, toxicity.fit(docs, no)).count()


def test_pipeline_on_empty_tables_and_clashing_names(spark, tmp_path, none, repeated, labels):
    import corpus_pipeline as cp

    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "a" / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "a" / "labels.parquet"))
    assert cp.run(spark, str(tmp_path / "a")).count() == 0
    docs = repeated
    for name, step in cp.STAGES[:-1]:
        docs = step(spark, docs, str(tmp_path / "a"))
        assert docs.columns == repeated.columns, name
    assert cp.STAGES[-1][1](spark, docs, str(tmp_path / "a")).filter("not round_trip").count() == 0


def test_workers_need_no_install(tmp_path):
    """What is sent to workers loads where the repository is not on the path."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    ranks = {bytes([i]): i for i in range(256)}
    (tmp_path / "sent").write_bytes(cloudpickle.dumps((bpe.Codec, bpe.codec, packing.Library, lm.Scorer, lm.Speller, toxicity.ToxicityModel({}, 0.0), features.NgramHasher(), quality_model.statistics)))
    code = f"import pickle, sys; sys.path[:] = [p for p in sys.path if p]; got = pickle.load(open({str(tmp_path / 'sent')!r}, 'rb')); print(got[0]({ranks!r}, {PATTERN!r}).encode(['a b']))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert "ModuleNotFoundError" not in done.stderr and done.returncode == 0, done.stderr


# ------------------------------------------------------------------ classifiers against direct computation


def test_machine_is_the_optimum():
    rng = np.random.default_rng(17)
    x = rng.standard_normal((120, 5)) + np.repeat([[0.8], [-0.8]], 60, 0)
    y, c = np.repeat([1.0, -1.0], 60), 20.0
    w = language_id.train_svm(x, y, epochs=4000, c=c)
    z = np.hstack([x, np.ones((120, 1))])
    cost = np.full(120, c)  # both classes are as large, so their weights are 1

    def loss(v):
        return 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (z @ v)) ** 2).sum()

    v = np.zeros(6)
    for _ in range(60):  # Newton's steps on the primal
        at = y * (z @ v) < 1
        gradient = v - 2 * (cost * y * np.maximum(0, 1 - y * (z @ v))) @ z
        v = v - np.linalg.solve(np.eye(6) + 2 * (z[at].T * cost[at]) @ z[at], gradient)
    assert loss(w) <= loss(v) * (1 + 1e-3) + 1e-6


def test_quadratic_scores_equal_the_densities():
    rng = np.random.default_rng(18)
    y = (np.arange(400) % 3 > 0).astype(int)
    x = rng.standard_normal((400, 6)) @ rng.standard_normal((6, 6)) + y[:, None]
    model = quality_model.QuadraticModel(x, y)
    z = (x - x.mean(0)) / x.std(0)
    parts = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum(p * (y == c).mean() for c, p in enumerate(parts))
    logs = []
    for c, cov in enumerate(parts):
        keep = max(quality_model.SHRINK_POOLED, 6 / (y == c).sum())
        cov = (1 - keep) * cov + keep * pooled
        cov = (1 - quality_model.SHRINK_IDENTITY) * cov + quality_model.SHRINK_IDENTITY * np.trace(cov) / 6 * np.eye(6)
        away = z - z[y == c].mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(-quality_model.TEMPER * (logs[1] - logs[0]))), atol=1e-6)


def test_risk_gradient_is_the_numeric_one():
    rng = np.random.default_rng(19)
    p, u = rng.integers(0, 2, (30, 4)).astype(float), rng.integers(0, 2, (50, 4)).astype(float)
    p, u = np.hstack([p, np.ones((30, 1))]), np.hstack([u, np.ones((50, 1))])
    for prior, least in ((0.2, True), (0.9, False)):
        w = rng.standard_normal(5)
        g, kept = toxicity.risk_gradient(p, u, w, prior, 0.0)
        log_loss = lambda z: np.logaddexp(0, -z)

        def risk(v, prior=prior):
            negative = log_loss(-(u @ v)).mean() - prior * log_loss(-(p @ v)).mean()
            return prior * log_loss(p @ v).mean() + negative, negative

        assert kept == (risk(w)[1] >= 0)
        part = 0 if kept else 1
        numeric = np.array([(risk(w + e)[part] - risk(w - e)[part]) / 2e-6 for e in np.eye(5) * 1e-6])
        assert np.allclose(g if kept else -g, numeric, atol=1e-5)
