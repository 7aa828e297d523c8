"""Toxicity behind spelling tricks, as a noisy channel.

A word is written through a channel that may swap letters for look-alikes,
put marks between them, repeat them or space them out.  Suspicious tokens (and
only these) become lattices of characters, which a Viterbi search decodes under
a character trigram model; every known word in a lattice is followed to its
end and preferred.  Words with doubled letters are looked up without them.
The restored words are looked up in a lexicon, and a logistic curve of the
hits is the score.

Character model, lexicon and curve are learned from all labelled documents
that the caller allows: the lexicon holds the words that occur in more toxic
documents than chance explains.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm import logistic
from tidecast.llm.samples import labelled_documents
from tidecast.llm.words import U64, Words, find_words, prefix_sums, range_hashes, slices
from tidecast.storage import written_table

LEXICON_WORDS = 20_000
LEAST_TOXIC = 4        # toxic documents that a lexicon word occurs in
CHANCE = 1e-6          # of so many toxic documents by chance
TRIGRAMS = 100_000
# Look-alikes, and what it costs (in natural log) to see one for a letter.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a",
         "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "¡": "i"}
WILD = "*#?%"          # may stand for any letter, or for nothing
SWAP_COST, DROP_COST, WILD_COST, KNOWN_BONUS = 1.0, 0.3, 2.5, 4.0

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CORE = _LETTER | _DIGIT
_SWAP = np.zeros(256, bool)
_SWAP[list(b"@$")] = True
_EDGE = np.zeros(256, bool)    # signs that stand for letters at a word's edges
_EDGE[[ord(c) for c in LOOKS if c.isascii() and not c.isdigit()]] = True
_ALONE = _EDGE.copy()          # and alone, among spaced letters
_ALONE[list(WILD.encode())] = True
_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
_REPEATED = re.compile(r"([a-z])\1+")


@dataclass
class ToxicityModel:
    trigrams: dict[str, float]
    lexicon: dict[str, float]
    curve: logistic.Logistic | None = None
    ordinary: frozenset[str] = frozenset()  # no lexicon words, but alike without doubled letters
    _cache: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self.known = set(self.lexicon)
        self.keys = np.sort(_word_keys(sorted(self.known))) if self.known else np.zeros(0, U64)
        self.begun = {w[:k] for w in self.known for k in range(len(w) + 1)}
        self.short: dict[str, list[str]] = {}
        for w in sorted(self.known):
            self.short.setdefault(collapsed(w), []).append(w)
        self.short_keys = np.sort(_word_keys(sorted(self.short))) if self.short else np.zeros(0, U64)

    def __getstate__(self):
        return self.trigrams, self.lexicon, self.curve, self.ordinary

    def __setstate__(self, state):
        self.trigrams, self.lexicon, self.curve, self.ordinary = state
        self._cache = {}
        self.__post_init__()

    def echoed(self, token: str) -> list[str]:
        """Lexicon words that give the token when letters are repeated."""
        if token in self.ordinary:
            return []
        runs = _run_lengths(token)
        return [w for w in self.short.get(collapsed(token), ()) if all(a >= b for a, b in zip(runs, _run_lengths(w)))]

    def restored(self, token: str) -> str:
        if token not in self._cache:
            if len(self._cache) > 200_000:
                self._cache.clear()
            self._cache[token] = decode(token, self.trigrams, self.known, self.begun)
        return self._cache[token]


def collapsed(word: str) -> str:
    return _REPEATED.sub(r"\1", word)


def _run_lengths(word: str) -> list[int]:
    return [len(m[0]) for m in re.finditer(r"([a-z])\1*|[^a-z]", word)]


def _word_keys(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in data])
    return range_hashes(prefix_sums(np.frombuffer(b"".join(data), np.uint8)), ends - [len(w) for w in data], ends)


def _lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each character what it may stand for, at what cost; "" is nothing."""
    out = []
    last = ""
    for c in token:
        if c.isalpha():
            # a letter that repeats the one before may be an echo of it
            choices = [(c, 0.0)] + ([("", DROP_COST)] if c == last else [])
        elif c in LOOKS:
            choices = [(x, SWAP_COST) for x in LOOKS[c]] + [("", 3 * SWAP_COST)]
        elif c in WILD:
            choices = [(x, WILD_COST) for x in _ALPHABET] + [("", DROP_COST)]
        else:
            choices = [("", DROP_COST)]
        out.append(choices)
        last = c if c.isalpha() else last
    return out


def _known_paths(lattice: list[list[tuple[str, float]]], trigrams: dict[str, float], known: set[str],
                 begun: set[str]) -> list[tuple[float, str]]:
    """Score of each known word in a lattice; ``begun``: all beginnings of known words."""
    floor = trigrams.get("", -12.0)
    best = {"": 0.0} if known else {}
    for choices in lattice:
        after: dict[str, float] = {}
        for text, score in best.items():
            for letter, cost in choices:
                longer, value = text + letter, score - cost
                if letter:
                    if longer not in begun:
                        continue
                    value += trigrams.get(("^^" + text)[-2:] + letter, floor)
                if longer not in after or value > after[longer]:
                    after[longer] = value
        best = after
        if not best:
            break
    return [(score + trigrams.get(("^^" + text)[-2:] + "$", floor) + KNOWN_BONUS, text) for text, score in best.items() if text in known]


def decode(token: str, trigrams: dict[str, float], known: set[str], begun: set[str]) -> str:
    """The likeliest word behind a token: the best path into each last pair of letters, or a known word."""
    floor = trigrams.get("", -12.0)
    lattice = _lattice(token)
    best = {"^^": (0.0, "")}
    for choices in lattice:
        after: dict[str, tuple[float, str]] = {}
        for state, (score, path) in best.items():
            for letter, cost in choices:
                if letter:
                    key, value, text = state[1] + letter, score - cost + trigrams.get(state + letter, floor), path + letter
                else:
                    key, value, text = state, score - cost, path
                if key not in after or value > after[key][0]:
                    after[key] = value, text
        best = after
    ends = [(score + trigrams.get(state + "$", floor) + KNOWN_BONUS * (text in known), text) for state, (score, text) in best.items()]
    return max(ends + _known_paths(lattice, trigrams, known, begun))[1]


def _cores(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Words without the marks around them; look-alike signs (one or two in a row) stay."""
    data = words.data
    core = _CORE[data]
    sign = _SWAP[data]
    if sign.any():
        padded = np.concatenate([[0, 0], data, [0, 0]])
        n = len(data)
        same = lambda k: padded[2 + k: 2 + k + n] == data
        core = core | sign & ~((same(-1) & same(1)) | (same(-1) & same(-2)) | (same(1) & same(2)))
    at = np.flatnonzero(core)
    left = np.searchsorted(at, words.starts)
    right = np.searchsorted(at, words.ends)
    some = right > left
    starts = np.where(some, at[np.minimum(left, len(at) - 1)] if len(at) else 0, words.starts)
    ends = np.where(some, at[np.maximum(right - 1, 0)] + 1 if len(at) else 0, words.starts)
    return starts, ends


@dataclass
class Tokens:
    words: Words
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    odd: np.ndarray     # tokens that may hide a word
    spaced: np.ndarray  # tokens in a run of three or more single letters
    sign: np.ndarray    # single signs, which are letters of such runs only
    outer_starts: np.ndarray  # with the look-alike signs at the token's edges
    outer_ends: np.ndarray
    twice: np.ndarray   # tokens with doubled letters

    def text(self, i: int) -> str:
        return self.words.data[self.starts[i]: self.ends[i]].tobytes().decode("utf-8", "ignore")

    def outer(self, i: int) -> str:
        return self.words.data[self.outer_starts[i]: self.outer_ends[i]].tobytes().decode("utf-8", "ignore")


def _edges(words: Words, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cores with the look-alike signs next to them, inside their words."""
    others = np.flatnonzero(~_EDGE[words.data])
    before = np.searchsorted(others, starts) - 1  # the last other byte before, and the first at or after
    after = np.searchsorted(others, ends)
    left = np.where(before >= 0, others[np.maximum(before, 0)] + 1, 0) if len(others) else np.zeros(len(starts), int)
    right = np.where(after < len(others), others[np.minimum(after, len(others) - 1)], len(words.data)) if len(others) else np.full(
        len(ends), len(words.data))
    return np.maximum(left, words.starts), np.minimum(right, words.ends)


def _look_bytes(data: np.ndarray) -> np.ndarray:
    """Last bytes of the look-alike signs beyond ASCII."""
    out = np.zeros(len(data), bool)
    for c in LOOKS:
        code = c.encode()
        if len(code) > 1 and len(data) >= len(code):
            same = np.ones(len(data) - len(code) + 1, bool)
            for k, byte in enumerate(code):
                same &= data[k: k + len(same)] == byte
            out[len(code) - 1:] |= same
    return out


def find_tokens(texts: pa.Array) -> Tokens:
    words = find_words(texts, lower=True)
    data = words.data
    starts, ends = _cores(words)
    alone = (ends == starts) & (words.ends - words.starts == 1)
    if len(data):
        alone &= _ALONE[data[words.starts]]
    ends = np.where(alone, words.ends, ends)
    outer_starts, outer_ends = _edges(words, starts, ends)
    doc = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.first))
    some = np.flatnonzero(ends > starts)
    starts, ends, doc, sign = starts[some], ends[some], doc[some], alone[some]
    outer_starts, outer_ends = outer_starts[some], outer_ends[some]
    count = lambda mask: (lambda s: s[ends] - s[starts])(np.concatenate([[0], np.cumsum(mask)]))
    letters = count(_LETTER[data])
    strange = (ends - starts) - letters
    strange += count(_look_bytes(data))
    double = np.zeros(len(data), bool)
    double[1:] = (data[1:] == data[:-1]) & _LETTER[data[1:]] & (data[1:] < 128)
    double[starts] = False
    twice = count(double) > 0
    thrice = np.zeros(len(data), bool)
    thrice[2:] = (data[2:] == data[1:-1]) & (data[2:] == data[:-2]) & _LETTER[data[2:]] & (data[2:] < 128)
    echo = count(thrice) > 0
    points = count((data & 0xC0) != 0x80)
    odd = ((letters > 0) | (count(_SWAP[data]) > 0)) & ((strange > 0) | echo) & (points > 2)
    single = np.concatenate([[False], points == 1, [False]])
    near = np.concatenate([[-1, -1], doc, [-2, -2]])
    here = near[2:-2]
    s = single[1:-1]
    before = np.concatenate([[False], s[:-1]]) & (near[1:-3] == here)
    before2 = np.concatenate([[False, False], s[:-2]])[: len(s)] & (near[:-4] == here)
    after = np.concatenate([s[1:], [False]])[: len(s)] & (near[3:-1] == here)
    after2 = np.concatenate([s[2:], [False, False]])[: len(s)] & (near[4:] == here)
    spaced = s & ((before & after) | (before & before2) | (after & after2))
    return Tokens(words, starts, ends, doc, odd, spaced, sign, outer_starts, outer_ends, twice)


def _runs(tokens: Tokens) -> Iterator[tuple[int, str]]:
    """(document, letters) of each spaced-out run."""
    at = np.flatnonzero(tokens.spaced)
    if not len(at):
        return
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(tokens.doc[at]) != 0)) + 1
    for run in np.split(at, cut):
        yield int(tokens.doc[run[0]]), "".join(tokens.text(i) for i in run)


def hits(texts: pa.Array, model: ToxicityModel) -> np.ndarray:
    """Per text: lexicon words seen, the same after restoring, and words in all."""
    tokens = find_tokens(texts)
    n = len(tokens.words.offsets) - 1
    found = np.zeros(n)
    weight = np.zeros(n)
    hashes = range_hashes(prefix_sums(tokens.words.data), tokens.starts, tokens.ends)
    if len(model.keys):
        plain = np.flatnonzero(model.keys[np.minimum(np.searchsorted(model.keys, hashes), len(model.keys) - 1)] == hashes)
        for i in plain:
            found[tokens.doc[i]] += 1
            weight[tokens.doc[i]] += model.lexicon.get(tokens.text(i), 0.0)
        is_plain = np.zeros(len(hashes), bool)
        is_plain[plain] = True
        edged = (tokens.outer_ends - tokens.outer_starts > tokens.ends - tokens.starts) & ~tokens.sign & ~is_plain
        # A token may be a known word written twice over: first by hash, then letter by letter.
        kept = np.ones(len(tokens.words.data), bool)
        kept[1:] = (tokens.words.data[1:] != tokens.words.data[:-1]) | ~_LETTER[tokens.words.data[1:]] | (tokens.words.data[1:] > 127)
        kept[tokens.starts] = True
        place = np.concatenate([[0], np.cumsum(kept)])
        short = range_hashes(prefix_sums(tokens.words.data[kept]), place[tokens.starts], place[tokens.ends])
        echo = tokens.twice & ~is_plain & (
            model.short_keys[np.minimum(np.searchsorted(model.short_keys, short), len(model.short_keys) - 1)] == short)
        for i in np.flatnonzero(tokens.odd | edged | echo):
            raw = tokens.text(i)
            seen = model.echoed(raw) if echo[i] else []
            if tokens.odd[i]:
                seen += "".join(c if c.isalpha() else " " for c in raw).split() + [model.restored(raw)]
            if edged[i] and raw not in model.ordinary:
                seen.append(model.restored(tokens.outer(i)))
            seen = [w for w in seen if w in model.known and w != raw]
            if seen:
                found[tokens.doc[i]] += 1
                weight[tokens.doc[i]] += max(model.lexicon[w] for w in seen)
        for d, run in _runs(tokens):
            word = model.restored(run)
            inside = [w for w in model.known if len(w) >= 4 and w in word or len(w) == 3 and w == word]
            if inside:
                found[d] += 1
                weight[d] += max(model.lexicon[w] for w in inside)
    words = np.diff(tokens.words.first)
    return np.column_stack([found > 0, np.log1p(found), np.log1p(weight), found / np.maximum(words, 1) ** 0.5])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label per word, and letter trigrams of the words."""
    for batch in batches:
        for part in slices(batch):
            labels = part.column("_label").to_numpy()
            tokens = find_tokens(part.column("text"))
            in_doc = [Counter(), Counter()]
            grams: Counter = Counter()
            clean = np.flatnonzero(~tokens.odd & ~tokens.sign)
            by_doc = np.searchsorted(tokens.doc[clean], np.arange(len(labels) + 1))
            for d, y in enumerate(labels.tolist()):
                bag = Counter(tokens.text(i) for i in clean[by_doc[d]: by_doc[d + 1]])
                in_doc[y > 0].update(bag.keys())
            for w, docs in (in_doc[0] + in_doc[1]).items():  # a document's word counts once
                w = f"^^{w}$"
                for i in range(len(w) - 2):
                    grams[w[i: i + 3]] += docs
            for kind, counter in (("clean", in_doc[0]), ("toxic", in_doc[1]), ("gram", grams)):
                yield pa.RecordBatch.from_arrays([
                    pa.array([kind] * len(counter), pa.string()), pa.array(list(counter), pa.string()),
                    pa.array(list(counter.values()), pa.int64())], names=["kind", "item", "n"])


def _chance(toxic: int, seen: int, share: float) -> float:
    """Chernoff bound of so many toxic among the documents seen."""
    p = toxic / seen
    if p <= share:
        return 1.0
    away = p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0.0)
    return math.exp(-seen * away)


def _features(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = hits(part.column("text"), model)
                yield pa.RecordBatch.from_arrays([
                    part.column("_id"), part.column("_label"), pa.array(x.tolist(), pa.list_(pa.float64()))],
                    names=["_id", "_label", "_x"])
    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", where: Column | None = None) -> ToxicityModel:
    """Learn from all labelled documents; ``where`` is a condition on ``_id``."""
    sample = labelled_documents(docs, labels, label, where)
    counts = written_table(sample.mapInArrow(_counts, "kind string, item string, n long").groupBy("kind", "item").agg(
        F.sum("n").alias("n")), "token-counts")
    sizes = {r[0]: r[1] for r in sample.groupBy("_label").count().collect()}
    total = sum(sizes.values())
    share = (sizes.get(1, 0) + 0.5) / (total + 1)
    grams = counts.where("kind = 'gram'").orderBy(F.desc("n"), "item").limit(TRIGRAMS).collect()
    before: Counter = Counter()
    for r in grams:
        before[r["item"][:2]] += r["n"]
    letters = len({r["item"][2] for r in grams}) + 1
    trigrams = {r["item"]: math.log((r["n"] + 0.1) / (before[r["item"][:2]] + 0.1 * letters)) for r in grams}
    trigrams[""] = math.log(0.1 / (0.1 * letters + 100))
    toxic = counts.where("kind = 'toxic'").where(F.col("n") >= LEAST_TOXIC).select("item", F.col("n").alias("_toxic"))
    clean = counts.where("kind = 'clean'").select("item", F.col("n").alias("_clean"))
    rows = toxic.join(clean, "item", "left").na.fill(0, ["_clean"]).where(
        F.col("_toxic") / (F.col("_toxic") + F.col("_clean")) > F.lit(min(0.5, 3 * share))).orderBy(
        F.desc("_toxic"), "item").limit(LEXICON_WORDS).collect()
    lexicon = {}
    for r in rows:
        a, b = r["_toxic"], r["_clean"]
        if _chance(a, a + b, share) <= CHANCE:
            lexicon[r["item"]] = math.log((a + 0.5) / (b + 0.5) * (1 - share) / share)
    # Seen in more clean documents than toxic ones: a word of its own, not a lexicon word with doubled letters.
    alike = docs.sparkSession.createDataFrame([(w,) for w in sorted({collapsed(w) for w in lexicon})], "_short string")
    seen = counts.where("kind != 'gram'").groupBy("item").agg(
        F.sum(F.when(F.col("kind") == "clean", F.col("n")).otherwise(-F.col("n"))).alias("_more")).where("_more > 0")
    ordinary = seen.withColumn("_short", F.regexp_replace("item", "([a-z])\\1+", "$1")).join(alike, "_short").select("item").collect()
    model = ToxicityModel(trigrams, {w: max(v, 0.1) for w, v in lexicon.items()},
                          ordinary=frozenset(r["item"] for r in ordinary) - lexicon.keys())
    fitted = written_table(sample.mapInArrow(_features(model), "_id long, _label int, _x array<double>"), "toxic-features")
    model.curve = logistic.fit_table(fitted, 4)
    return model


def _scores(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = model.curve.probability(hits(part.column("text"), model))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], names=["doc_id", "score"])
    return run


def toxicity_scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score`` for each row, 0 to 1.

    Null and empty texts have no words and get the curve's value there.  Null
    ids stay null, repeated rows score alike, other columns are ignored.

    A text is held whole in a task, at about 40 times its bytes; rows repeated
    whole score alike, and an empty table gives no row.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _scores(model), "doc_id long, score double")
