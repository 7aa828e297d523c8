"""Small tables with all that is awkward: nulls, empty and long texts, repeats, ties, clashing columns."""

from __future__ import annotations

import random

NAMES = ["_id", "_n", "_row", "_doc", "_th", "_key", "_copy", "_cdf", "_parts", "_source", "_hit", "_gone", "h", "kept",
         "score", "label", "n_words", "features", "spans", "component_id", "_label", "begin", "asked"]


def texts(seed: int = 5) -> list[str | None]:
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["ta", "ri", "ön", "ek", "su", "lo", "mé"]) for _ in range(rnd.randint(1, 4)))
    text = lambda n: "".join(word() + rnd.choice([" ", " ", " ", "\n", ". "]) for _ in range(n)).strip()
    passage = text(90)
    out: list[str | None] = [None, "", " \n\t ", "one two", "ONE two", "one two", "a", "é ü"]
    base = text(120)
    for k in range(6):
        words = base.split(" ")
        for _ in range(k):
            words[rnd.randrange(len(words))] = word()
        out.append(" ".join(words))
    out += [base, base, base.upper(), text(30) + " " + passage, passage, text(50) + "\n" + passage + " " + text(40)]
    out += ["ab" * 900, "x" * 1500, "tick tock " * 200, (text(60) + "\n") * 3, text(9000), text(9000)]
    out += ["!!! ### " + text(40), "Ärger mit  Leerraum\t\tund\r\nZeilen " + text(60), "<|endoftext|> " + text(20)]
    return out + [text(rnd.randint(3, 150)) for _ in range(40)]


def rows(seed: int = 5) -> list[tuple]:
    all_texts = texts(seed)
    out = [(i * 7 - 20, t, None if i % 11 == 3 else f"src{i % 4 if i % 3 else 0}") for i, t in enumerate(all_texts)]
    out += [out[9], out[9], out[20]]                                   # rows repeated whole
    out += [(None, all_texts[9], "src1"), (None, None, None), (None, all_texts[-1], "src2")]
    return out


def documents(spark, seed: int = 5):
    df = spark.createDataFrame(rows(seed), "doc_id long, text string, source string")
    return df.selectExpr("*", "'en' as lang", "length(text) as n_chars", *[f"'clash' as `{c}`" for c in NAMES]).repartition(3)


def empty(spark):
    return documents(spark).limit(0)
