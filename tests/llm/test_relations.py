"""The operators on turns, vectors and sources against plain versions, awkward rows included."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.llm import chat_format, hard_negatives, source_divergence
from tidecast.llm.chat_format import formatted_conversations, parsed_conversations, running_totals
from tidecast.llm.hard_negatives import LengthBucket, integer_rows
from tidecast.llm.source_divergence import galloping, priced, shares

TURNS = "conv_id long, turn long, role string, text string, formatted string, _turns int"


def chat_rows():
    rnd = random.Random(3)
    bits = ["<|im_end|>", "<|im_start|>assistant\n", "<|im_sep|>", "<\\|nl|>", "<|", "<", "|", "\\", "é", "\n", " word", "𝄞", "<\\\\|x"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "us\ner", "<|nl|>", "a<"]), "".join(rnd.choices(bits, k=rnd.randint(0, 9))), "x", 1)
            for c in range(40) for t in range(rnd.randint(1, 7))]
    rows += [(50, 0, "assistant", None, None, None), (50, 0, "assistant", None, None, None), (50, None, None, "late", None, None)]
    rows += [(None, 3, "assistant", "no id", "x", 1), (51, 0, "assistant", "long <| " * 40_000, "x", 1)]
    return rows + [(52, t, "assistant" if t % 3 else "user", f"turn {t}", "x", 1) for t in range(700)]


def test_chat_round_trip(spark):
    rows = chat_rows()
    formatted = formatted_conversations(spark.createDataFrame(rows, TURNS))
    found = {r["conv_id"]: r for r in parsed_conversations(formatted).collect()}
    spans = {r["conv_id"]: [tuple(s) for s in r["loss_spans"]] for r in formatted.collect()}
    plain = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        plain[r[0]].append((r[2] or "", r[3] or ""))
    assert found.keys() == plain.keys()
    for conv, turns in plain.items():
        r = found[conv]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["loss_texts"] == [t for role, t in turns if role == "assistant"]
        assert r["formatted"].count("<|im_start|>") == sum(i == 0 or turns[i - 1][0] != t[0] for i, t in enumerate(turns))
        unescape = lambda t: re.sub(r"<\\(\\*)\|", r"<\1|", t)
        assert [unescape(r["formatted"][a:b]) for a, b in spans[conv]] == r["loss_texts"]
    assert not formatted_conversations(spark.createDataFrame([], TURNS)).count()


def test_chat_plan_has_no_python(spark):
    plan = parsed_conversations(formatted_conversations(spark.createDataFrame(chat_rows(), TURNS)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("n", [0, 1, 256, 257, 1000])
def test_running_totals(spark, n):
    values = list(range(n))
    got = spark.createDataFrame([(values,)], "v array<long>").select(running_totals(F.col("v")).alias("x")).first()["x"]
    assert got == [sum(values[:i]) for i in range(n)]


VECTORS = "vec_id long, embedding array<float>, label int, norm2 string, _bucket int, v int"


def vector_rows():
    rnd = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rnd.normal(size=8) * rnd.choice([0.1, 1, 3])], int(rnd.integers(0, 3)), "x", 1, 1) for i in range(0, 900, 3)]
    rows += [(i + 1, rows[i // 3][1], rows[i // 3][2], "x", 1, 1) for i in range(0, 300, 3)]               # equal vectors: ties
    rows += [(2000, [0.0] * 8, 1, "x", 1, 1), (2100, [], 1, "x", 1, 1), (2101, [9.0, 9.0], 2, "x", 1, 1)]
    rows += [(2200, None, 1, "x", 1, 1), (2300, [1.0, None], 1, "x", 1, 1), (2400, [float("nan")], 1, "x", 1, 1),
             (2500, [float("inf")], 1, "x", 1, 1), (2600, [1.0], None, "x", 1, 1), (None, [1.0], 1, "x", 1, 1), (2700, [1e30], 1, "x", 1, 1)]
    return rows + [rows[5], rows[5]]


def plain_negatives(rows):
    kept = {}
    for r in rows:
        vec = r[1]
        if r[0] is None or r[2] is None or vec is None or any(x is None or not np.isfinite(x) or abs(x) > 1e9 for x in vec):
            continue
        kept[r[0]] = (r[2], [int(np.floor(256 * float(np.float32(x)))) for x in vec])
    out = []
    for a, (la, va) in kept.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, vb)), b, lb) for b, (lb, vb) in kept.items() if b != a)
        for ps, p, _ in [x for x in scored if x[2] == la][:5]:
            near = [x for x in scored if x[2] != la and 30 * -ps <= 100 * -x[0] <= 90 * -ps][:10]
            out += [(a, p, k + 1, n, -ps, -ns) for k, (ns, n, _) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("bucket", [16, 100, 2048])
def test_hard_negatives(spark, monkeypatch, bucket):
    monkeypatch.setattr(hard_negatives, "BUCKET_ROWS", bucket)
    rows = vector_rows()
    df = integer_rows(spark.createDataFrame(rows, VECTORS), F.col("label"))
    got = hard_negatives.hard_negatives(df, F.col("id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    empty = integer_rows(spark.createDataFrame([], VECTORS), F.col("label"))
    assert not hard_negatives.hard_negatives(empty, F.col("id") % 100 == 0).count()


def test_candidates_lose_nothing_and_prune():
    rnd = np.random.default_rng(1)
    rows = np.floor(256 * rnd.normal(size=(500, 6))).astype(np.int64)
    bucket, pruned = LengthBucket(np.arange(500), np.zeros(500, int), rows), 0
    for anchor in rows[:60]:
        scores, length = rows @ anchor, float(np.sqrt((anchor**2).sum()))
        for least in np.quantile(scores, [0, 0.2, 0.5, 0.9, 1]):
            met = bucket.candidates(anchor, length, least)
            assert set(np.flatnonzero(scores >= least)) <= set(met.tolist())
            assert np.array_equal(bucket.scores(anchor, length, met), scores[met])
            pruned += len(met) < 500
    assert pruned > 60
    assert np.array_equal(bucket.scores(rows[0] * 2**40, 2.0**52, np.arange(500)), rows @ (rows[0] * 2**40))


def test_galloping():
    rnd = np.random.default_rng(2)
    for n, m in [(0, 0), (0, 5), (5, 0), (1, 1), (300, 20), (20, 3000), (1000, 1000)]:
        needles, sorted_ = (np.unique(rnd.integers(0, 4000, k)) for k in (n, m))
        assert np.array_equal(galloping(needles, sorted_), np.searchsorted(sorted_, needles))


def test_priced_both_ways():
    rnd = np.random.default_rng(4)
    for held in (0, 1, 40, 190):
        a, b = rnd.integers(0, 3, 200) * (rnd.random(200) < 0.5), rnd.integers(0, 9, 200) * (np.arange(200) < held)
        sides = [(np.flatnonzero(x), x[x > 0], int(x.sum()) + 5 * 200) for x in (a, b)]
        p, q = (shares(x, s[2]) for x, s in zip((a, b), sides))
        seen = (a > 0) | (b > 0)
        assert priced(*sides) == priced(*sides[::-1]) == (np.abs(p - q)[seen].sum(), seen.sum())
    big = np.array([10**13, 3])
    assert shares(big, 10**15 + 7).tolist() == [1 + 10**9 * (c + 5) // (10**15 + 7) for c in big.tolist()]


DOCS = "doc_id long, text string, lang string, source string, term string, n int, id string, p int"


def source_rows():
    rnd = random.Random(9)
    words = ["Wort", "wort", "mot", "naïve", "ÀB", "x1y", "a_b", "don't", "日本", "", "  ", "42", "the", "THE"]
    rows = [(i, " ".join(rnd.choices(words[: rnd.choice([6, 14])], k=rnd.randint(0, 30))), rnd.choice(["en", "en", "fr", None]),
             rnd.choice(["s1", "s1", "s2", "s3", "é", None]), "x", 1, "y", 2) for i in range(400)]
    rows += [(None, None, None, None, None, None, None, None), (1, None, "de", "s1", "x", 1, "y", 2), (2, "", "de", "s2", "x", 1, "y", 2)]
    return rows + [(3, "only here " * 40_000, "it", "s1", "x", 1, "y", 2), rows[0], rows[0], (4, "so long", "en", "empty\n", "x", 1, "y", 2), (5, "12 34", "en", "bare", "x", 1, "y", 2)]


def plain_divergence(rows, least=30):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        text, lang, source = ((x or "") for x in r[1:4])
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        whole = Counter()
        for c in groups.values():
            whole.update(c)

        def prices(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}
        q = prices(whole)
        for s, c in groups.items():
            p = prices(c)
            pairs = sorted((-sum(abs(p[t] - x[t]) for t in kept), o.encode(), o) for o, x in ((o, prices(d)) for o, d in groups.items() if o != s))
            terms = sorted((q[t] - p[t], t.encode(), t) for t in kept if c[t] and p[t] > q[t])[:50]
            out += [(lang, s, part, x[2], -x[0], k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, x in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block", [2, 65_536])
def test_source_divergence(spark, monkeypatch, block):
    monkeypatch.setattr(source_divergence, "BLOCK", block)
    rows = source_rows()
    got = source_divergence.source_divergence(spark.createDataFrame(rows, DOCS).repartition(3))
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows)


def test_source_divergence_of_nothing(spark):
    assert not source_divergence.source_divergence(spark.createDataFrame([], DOCS)).count()


def test_chat_probe(spark, sf):
    from tidecast.llm.queries import op11

    text = "<|im_end|><|im_start|>assistant ok"
    r = op11(spark, sf).where("conv_id = -1").first()
    assert (r["n_turns"], r["loss_chars"]) == (2, len(text))
    assert r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert chat_format.START not in text.replace("<|", "<\\|")
