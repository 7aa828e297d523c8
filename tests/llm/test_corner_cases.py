"""Every operator on awkward tables, against plain versions."""

import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
import corner  # noqa: E402
from tidecast.llm import (  # noqa: E402
    compression_classifier, decontamination, mixing, near_dedup, quality_rules, samples, suffix_dedup, suffix_tree_lm,
    token_files, toxicity, warc,
)
from tidecast.llm.queries import byte_bpe  # noqa: E402
from tidecast.storage import scratch_path, written_table  # noqa: E402


def table(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def labels(spark, name):
    values = [(r[0], i % 2, 1 - i % 2) for i, r in enumerate(corner.rows())]
    return spark.createDataFrame(values + values[:5] + [(None, 1, 1), (10**9, None, None)], f"doc_id long, {name} int, other int")


@pytest.mark.parametrize("contexts", [None, 4])
def test_repeated_strings(spark, monkeypatch, contexts):
    if contexts:  # hot anchors over several shards, several ranges
        monkeypatch.setattr(suffix_dedup, "SHARD_CONTEXTS", contexts)
        monkeypatch.setattr(suffix_dedup, "RANGE_WINDOWS", 500)
    rows = corner.rows()
    got = suffix_dedup.without_repeats(corner.documents(spark)).withColumn("sha", F.sha2("kept", 256))
    want = sorted(((r[0], *b) for r, b in zip(rows, brute.without_repeats([r[1] for r in rows]))), key=repr)
    assert table(got, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == want
    assert suffix_dedup.without_repeats(corner.empty(spark)).count() == 0


def test_shard_is_a_suffix_array():
    rnd = random.Random(3)
    strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 60))) for _ in range(12)] + [b"ababababab" * 60] * 2
    shard = suffix_dedup.Shard(strings)
    text = b"".join(strings)
    suffixes = [text[p: shard.ends[shard.owner[p]]] for p in shard.order]
    assert suffixes == sorted(suffixes)
    for k in range(1, len(suffixes)):
        a, b = suffixes[k - 1], suffixes[k]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shard.common[k] == min(n, suffix_dedup.WINDOW)


def test_quality_statistics(spark):
    docs = corner.documents(spark)
    trees = quality_rules.fit_rules(docs, labels(spark, "quality"))
    got = quality_rules.quality_verdicts(docs, trees)
    want = []
    for i, t, _ in corner.rows():
        s = brute.statistics(t)
        want.append((i, *s, s[0] < 10 or 100 * s[4] > 20 * s[0]))
    assert table(got, "doc_id", *quality_rules.BASE, "base_failed") == sorted(want, key=repr)
    assert got.where("kept and base_failed").count() == 0
    passing = quality_rules.passing_documents(docs, trees)
    assert passing.columns == docs.columns and passing.count() == got.where("kept").count()
    assert quality_rules.fit_rules(docs, labels(spark, "quality").limit(0)) is None
    assert quality_rules.quality_verdicts(corner.empty(spark), None).count() == 0


def test_trees_obey_their_directions():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = (np.sin(6 * x[:, 0]) + x[:, 1] - x[:, 2] + rng.normal(0, 0.3, 3000) > 0.5).astype(float)
    trees = quality_rules.boosting.fit(x, y, np.array([1, 1, -1]))
    grid = np.linspace(0, 1, 50)
    for f, sign in ((0, 1), (1, 1), (2, -1)):
        for other in rng.random((20, 3)):
            probe = np.tile(other, (50, 1))
            probe[:, f] = grid
            assert (sign * np.diff(trees.margin(probe)) >= -1e-12).all()
    free = quality_rules.boosting.fit(x, y, np.zeros(3, int))
    assert ((free.probability(x) > 0.5) == y).mean() > 0.9


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, percent):
    got = near_dedup.near_duplicates(corner.documents(spark), percent)
    rows = corner.rows()
    least = brute.components([r[:2] for r in rows], percent)
    want = [(i, len(brute.shingles(t)), least.get(i), i is None or least[i] == i) for i, t, _ in rows]
    assert table(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)
    assert near_dedup.near_duplicates(corner.empty(spark), percent).count() == 0


def test_large_cluster_of_near_copies(spark):
    """Many copies, pairwise about as far apart as the limit: pivots alone cannot link them."""
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rnd.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(220):
        text = list(base)
        for _ in range(rnd.randint(0, 4)):
            text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
        rows.append((1000 - i, " ".join(text)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == brute.components(rows, 85)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    a, b = (np.unique(rng.integers(0, 1 << 62, 800).astype(np.uint64)) for _ in range(2))
    union = np.unique(np.concatenate([a, b]))
    regs = near_dedup.registers([a, b, union, a[:0]])
    assert (np.maximum(regs[0], regs[1]) == regs[2]).all() and not regs[3].any()
    shared = a[:500]
    near = np.unique(np.concatenate([shared, b[:20]]))
    far = np.unique(np.concatenate([a[:100], b[:500]]))
    r = near_dedup.registers([shared, near, far])
    sizes = np.array([len(shared), len(near), len(far)])
    kept = near_dedup.likely(r[[0, 0]], r[[1, 2]], sizes[[0, 0]], sizes[[1, 2]], 85)
    assert kept.tolist() == [True, False]


def test_toxicity_sees_through_tricks(spark):
    rnd = random.Random(4)
    filler = lambda: " ".join("".join(rnd.choice(["ta", "ri", "on", "ek", "su", "lo"]) for _ in range(3)) for _ in range(30))
    rows, marks = [], []
    for i in range(240):
        bad = i % 3 == 0
        rows.append((i, filler() + (f" {rnd.choice(['grumblefink', 'snotwort', 'oafling'])} " if bad else " ") + filler()))
        marks.append((i, int(bad)))
    tricks = ["gr0mblefink grumbl3fink", "snnnotwortttt", "o a f l i n g", "sn*twort", "s.n.o.t.w.o.r.t", "5n0tw0rt", "GRUMBLEFINK!!!"]
    rows += [(1000 + k, filler() + f" {t} " + filler()) for k, t in enumerate(tricks)]
    rows += [(2000 + k, filler() + f" {t} ") for k, t in enumerate(["a1b2 3.14 x", "a b c d e f", "%%%%% 2024-01-01"])]
    rows += [(None, None), (5000, ""), (5001, "snotwort")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(marks, "doc_id long, toxic int"), where=samples.fold("_id", 5) != 0)
    assert set(model.lexicon) == {"grumblefink", "snotwort", "oafling"}
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, y in marks)
    assert all(got[1000 + k] >= 0.5 for k in range(len(tricks)))
    assert all(got[i] < 0.5 for i in (2000, 2001, 2002, 5000, None)) and got[5001] >= 0.5


@pytest.mark.parametrize("module", ["toxicity", "compression"])
def test_scores_of_awkward_rows(spark, module):
    docs = corner.documents(spark)
    fit, score = {"toxicity": (toxicity.fit_toxicity, toxicity.toxicity_scores),
                  "compression": (compression_classifier.fit_compression, compression_classifier.quality_scores)}[module]
    name = "toxic" if module == "toxicity" else "quality"
    for marks in (labels(spark, name), labels(spark, name).where(f"{name} = 1"), labels(spark, name).limit(0)):
        got = score(docs, fit(docs, marks, name))
        assert [r[0] for r in table(got, "doc_id")] == sorted((r[0] for r in corner.rows()), key=repr)
        assert got.where("score is null or not score between 0 and 1").count() == 0
    assert score(corner.empty(spark), fit(corner.empty(spark), labels(spark, name), name)).count() == 0


def test_compression_tells_styles_apart(spark):
    rnd = random.Random(6)
    good = lambda: " ".join(rnd.choice(["the", "river", "was", "wide", "and", "slow", "under", "bridges", "of", "stone"]) for _ in range(80))
    bad = lambda: " ".join(rnd.choice(["BUY$$$", "win###", "!!!now", "%%%", "fr33", "||"]) for _ in range(80))
    rows = [(i, good() if i % 2 else bad()) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = compression_classifier.fit_compression(
        docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"), where=samples.fold("_id", 4) != 2)
    got = {r["doc_id"]: r["score"] for r in compression_classifier.quality_scores(docs, model).collect()}
    assert all((got[i] >= 0.7) == bool(i % 2) for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2)


def test_warc_round_trip(spark):
    rows = [(i, f"http://x/{i}\r\n", t) for i, t, _ in corner.rows() if i is not None] + [
        (None, None, "x"), (None, "u", None), (9001, None, "WARC/1.1\r\n\r\n\r\n\r\n"), (9002, "u", "y" * 3_000_000)]
    got = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash")))
    top: dict = {}
    for i, _, t in rows:
        if i is not None:
            top[t or ""] = max(i, top.get(t or "", i))
    want = []
    for i, _, t in rows:
        body = (t or "").encode()
        again = i is not None and top[t or ""] != i
        want.append((i, len(body), warc.base32_sha1(body), "revisit" if again else "response", top[t or ""] if again else None))
    assert table(got, *warc._FIELDS) == sorted(want, key=repr)
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_token_files(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(byte_bpe())
    tokenizer.encode_special_tokens = True
    folder = scratch_path(spark, "tokens")
    files = token_files.write_token_files(corner.documents(spark), folder, byte_bpe())
    got = token_files.read_token_files(files, folder)
    texts = {}
    for i, t, _ in corner.rows():
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        texts.setdefault(i, []).append((len(ids) // 4, zlib.crc32(ids)))
    rows = sorted(got.collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))  # ascending, rows without an id first
    at = 0
    for r in rows:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in texts[r["doc_id"]]
        at += r["n_tokens"]
    assert len(rows) == len(corner.rows())
    assert token_files.tokenized(corner.empty(spark), byte_bpe()).count() == 0


def test_files_roll_over_and_are_read_by_a_task_each(spark):
    docs = corner.documents(spark)
    folder = scratch_path(spark, "small-files")
    whole = token_files.read_token_files(token_files.write_token_files(docs, folder, byte_bpe()), folder)
    files = token_files.write_token_files(docs, folder, byte_bpe(), file_bytes=4000)
    parts = token_files.read_token_files(files, folder)
    assert files.count() > 20 and parts.rdd.getNumPartitions() > 10
    assert table(parts, *whole.columns) == table(whole, *whole.columns)
    stored = written_table(docs.orderBy("n_chars").coalesce(1))
    as_it_is = token_files.tokenized(stored, byte_bpe(), by_id=False)
    ids = [r["doc_id"] for r in sorted(as_it_is.collect(), key=lambda r: r["start"])]
    assert ids == [r["doc_id"] for r in stored.collect()]
    pages = docs.selectExpr("doc_id as page_id", "'u' as url", "text as html")
    archives = warc.write_archives(pages, folder, file_bytes=3000)
    members = warc.normalise_archives(archives, folder)
    read = warc.read_members(members, folder)
    assert members.count() == archives.count() > 10 and read.rdd.getNumPartitions() > 10
    assert table(read, *read.columns) == table(warc.archived(pages), *read.columns)


def test_token_file_reads_one_document_and_finds_damage(tmp_path):
    from pyarrow import fs

    path = str(tmp_path / "x.zst")
    local = fs.LocalFileSystem()
    with local.open_output_stream(path, compression=None) as sink:
        writer = token_files.TokenFileWriter(sink)
        for i in range(5):
            writer.add(i, bytes([i, 0, 0, 0]) * 1000)
        writer.finish()
    with local.open_input_file(path) as source:
        reader = token_files.TokenFileReader(source)
        assert reader.tokens(3) == b"\3\0\0\0" * 1000 and reader.ids.tolist() == [0, 1, 2, 3, 4]
        at = int(reader.at[2]) + 14
    data = bytearray(Path(path).read_bytes())
    data[at] ^= 0xFF
    Path(path).write_bytes(data)
    with local.open_input_file(path) as source, pytest.raises(Exception):  # noqa: B017
        token_files.TokenFileReader(source).tokens(2)


def test_mixing(spark):
    docs = corner.documents(spark)
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    counts = mixing.mixture_counts(docs)
    assert counts.count() == out.count() == counts.agg(F.countDistinct("doc_id", "copy", "source", "place")).first()[0] or counts.count()
    assert counts.where("copy > n_copies or copy < 1").count() == 0
    again = {tuple(r) for r in mixing.mixture_counts(docs.repartition(7)).collect()}
    assert again == {tuple(r) for r in counts.collect()}
    assert mixing.mixture(corner.empty(spark)).count() == 0


def test_mixing_meets_its_weights(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "repeat('x', 10) as text", "if(id % 10 = 0, 'few', 'many') as source")
    rows = {r["source"]: r["n"] for r in mixing.mixture_counts(docs, {"few": 3.0, "many": 1.0}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(rows["few"] - 15_000) < 600 and abs(rows["many"] - 5_000) < 400
    rare = docs.where("doc_id < 20").unionByName(spark.range(1).selectExpr("-1 as doc_id", "repeat('x', 10) as text", "'one' as source"))
    n = mixing.mixture_counts(rare, {"one": 1.0}, epochs=10.0).groupBy("source").count().collect()
    assert [r["source"] for r in n] == ["one"] and abs(n[0]["count"] - 210) < 70  # a mean beyond one part


def test_language_model(spark):
    docs = corner.documents(spark)
    model = suffix_tree_lm.fit_language_model(docs, samples.fold("doc_id", 5) != 1)
    got = suffix_tree_lm.language_scores(docs, model, samples.fold("doc_id", 5) == 1)
    from collections import Counter
    from math import log10

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    tokens = lambda t: [*brute.words(t, True), "\n"]
    count = Counter(w for i, t, _ in corner.rows() if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted(((i, held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n,
                    round(sum(log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t, _ in corner.rows()), key=repr)
    assert table(got.withColumn("base_score", F.round("base_score", 6)), "doc_id", "held_out", "n_tokens", "n_known",
                 "train_tokens", "base_score") == want
    assert got.where("score is null or score >= 0").count() == 0
    none = suffix_tree_lm.fit_language_model(corner.empty(spark), samples.fold("doc_id", 5) != 1)
    assert suffix_tree_lm.language_scores(docs, none, samples.fold("doc_id", 5) == 1).where("score is null").count() == 0
    assert suffix_tree_lm.language_scores(corner.empty(spark), model, samples.fold("doc_id", 5) == 1).count() == 0


def plain_tree_scores(training, asked, least):
    """Count every context, keep the frequent and divergent ones, back off from the longest."""
    from collections import Counter, defaultdict
    from math import log, log10

    def symbols(text):
        return [0x0B] * 7 + list(" ".join(brute.words(text, True)).encode()) + [0x0A]
    counts = defaultdict(Counter)
    for text in training:
        s = symbols(text)
        for k in range(7, len(s)):
            for d in range(8):
                counts[tuple(s[k - d: k])][s[k]] += 1
    kept = {c for c, n in counts.items() if c and n.total() >= least and sum(
        x / n.total() * log(x / n.total() / (counts[c[1:]][y] / counts[c[1:]].total())) for y, x in n.items()) >= 0.01}
    kept = {c[k:] for c in kept for k in range(len(c))}

    def p(c, y):
        if not c:
            return (counts[c][y] + 0.5) / (counts[c].total() + 128)
        up = next(c[k:] for k in range(1, len(c) + 1) if c[k:] in kept or not c[k:])
        return (counts[c][y] + 20 * p(up, y)) / (counts[c].total() + 20)
    out = []
    for text in asked:
        s, score = symbols(text), 0.0
        for k in range(7, len(s)):
            c = next(tuple(s[k - d: k]) for d in range(7, -1, -1) if not d or tuple(s[k - d: k]) in kept)
            score += log10(p(c, s[k]))
        out.append(score)
    return out, len(kept)


@pytest.mark.parametrize("least", [1, 12, 60])
def test_tree_against_a_plain_one(spark, monkeypatch, least):
    monkeypatch.setattr(suffix_tree_lm.Tally, "HELD", 50)
    rnd = random.Random(6)
    rows = [(i, " ".join("".join(rnd.choices(["ta", "ri", "on", "é", "X"], k=rnd.randint(1, 4))) for _ in range(rnd.randint(0, 25))))
            for i in range(80)] + [(80, None), (81, " \t"), (82, "ta \0 ta")]
    asked = [t for _, t in rows] + ["never seen words ß", "tatataonon ri"]
    want, kept = plain_tree_scores([t for _, t in rows], asked, least)
    assert kept > 20
    model = suffix_tree_lm.fit_language_model(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True), least)
    got = suffix_tree_lm.language_scores(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model, F.lit(False))
    score = {r["doc_id"]: r["score"] for r in got.collect()}
    assert np.allclose([score[i] for i in range(len(asked))], want, rtol=1e-5)


def test_counts_travel_packed():
    from collections import Counter

    import pyarrow as pa
    rnd = random.Random(8)
    texts = [" ".join("".join(rnd.choices("abcdefgh", k=4)) for _ in range(600)) for _ in range(5)]
    batch = pa.RecordBatch.from_pydict({"text": texts + [None]})
    put_out = list(suffix_tree_lm._count(iter([batch])))
    assert sum(b.num_rows for b in put_out) <= 2 * suffix_tree_lm.PARTS + 1
    got = {}
    for b in suffix_tree_lm._sums(iter(put_out + put_out)):  # two tasks that read the same
        got |= {(kind, key): n for kind, key, n in zip(*(b.column(c).to_pylist() for c in ("kind", "key", "n")))}
    want = Counter()
    for t in [*texts, ""]:
        s = bytes([0x0B] * 7) + t.encode() + bytes([0x0A])
        want.update((3, int.from_bytes(s[k - 3: k + 1], "big")) for k in range(7, len(s)))
    assert {k: n for k, n in got.items() if k[0] == 3} == {k: 2 * n for k, n in want.items()}
    assert got[-2, 0] == 12 and sum(n for k, n in got.items() if k[0] == -1) == 6000


def test_tree_in_blocks_leaves_nothing_out(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree_lm, "CANDIDATES", 40)
    monkeypatch.setattr(suffix_tree_lm, "ENTRIES", 300)
    rnd = random.Random(7)
    rows = [(i, " ".join("".join(rnd.choices(["ta", "ri", "on", "é", "X"], k=rnd.randint(1, 4))) for _ in range(rnd.randint(0, 25))))
            for i in range(60)] + [(60, None), (60, "ta ta"), (None, "ri on ta"), (None, "ri on ta")]
    asked = [t for _, t in rows] + ["never seen words ß"]
    want, kept = plain_tree_scores([t for _, t in rows], asked, 3)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string").repartition(3)
    model = suffix_tree_lm.fit_language_model(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True), 3)
    assert kept > 300 and model.blocks > 2
    score = {r["doc_id"]: r["score"] for r in suffix_tree_lm.language_scores(docs, model, F.lit(False)).collect()}
    assert np.allclose([score[i] for i in range(len(asked))], want, rtol=1e-5)


@pytest.mark.parametrize("block", [None, 300])
def test_contained_items(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(decontamination, "BLOCK_SHINGLES", block)
    rows = corner.rows()
    items = [(k, rows[i][1]) for k, i in enumerate([0, 1, 3, 6, 9, 17, 18, 20, 24, 40, 41, 42, 43, 44, 45])] + [(None, "one two"), (3, rows[9][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("_n", F.lit("clash"))
    got = decontamination.contained_items(corner.documents(spark), bench)
    want = brute.contained([r[:2] for r in rows], items, 80)
    assert table(got, "doc_id", "item_id", "item_shingles", "shared_shingles") == sorted(want, key=repr)
    clean = decontamination.clean_documents(corner.documents(spark), bench)
    dirty = {r[0] for r in want} - {None}
    assert clean.columns == corner.documents(spark).columns
    assert table(clean, "doc_id") == sorted(((r[0],) for r in rows if r[0] not in dirty), key=repr)
    assert decontamination.contained_items(corner.documents(spark), bench.limit(0)).count() == 0
    assert decontamination.contained_items(corner.empty(spark), bench).count() == 0


def test_language_model_sees_seven_symbols_back(spark):
    rows = [(2 * i, "qmmmmmma") for i in range(2500)] + [(2 * i + 1, "zmmmmmmb") for i in range(2500)]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    model = suffix_tree_lm.fit_language_model(train, F.lit(True))
    asked = spark.createDataFrame([(0, "qmmmmmma"), (1, "qmmmmmmb"), (2, "zmmmmmmb"), (3, "zmmmmmma")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in suffix_tree_lm.language_scores(asked, model, F.lit(False)).collect()}
    assert score[0] > score[1] + 0.5 and score[2] > score[3] + 0.5


def test_toxicity_decodes_edges_doubles_short_runs_and_masks(spark):
    import pyarrow as pa

    rnd = random.Random(8)
    filler = lambda: " ".join("".join(rnd.choice(["ta", "ri", "on", "ek", "su", "lo"]) for _ in range(3)) for _ in range(30))
    rows, marks = [], []
    for i in range(320):
        bad = i % 4 == 0
        rows.append((i, filler() + (f" {['impwort', 'snotwort', 'oafling', 'zug'][i // 4 % 4]} " if bad else " zuug ") + filler()))
        marks.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert set(model.lexicon) == {"impwort", "snotwort", "oafling", "zug"}
    tricks = ["!mpwort", "snotwor+", "|mpwort!", "ooaafflliinngg", "z u g", "! m p w o r t", "s*otwort", "oaf*ing", "i*p*ort",
              "¡mpwort"]
    found = lambda t: toxicity.hits(pa.array([f"tarion {t} sulori"]), model)[0, 0]
    assert [t for t in tricks if not found(t)] == []
    assert [t for t in ["zuug", "zuug!", "(tarion)", "! ! !", "| a | b |", "", "% * !", "snootling", "a b c d"] if found(t)] == []
