"""Licence scans: a trained classifier names the licence family of every paragraph, and templates confirm it.

A paragraph is a line with a word.  Its features are the word n-grams (one to three words) of a vocabulary that is learnt
with the model, so they are sparse and a paragraph without any licence word is decided without looking further.  A
multinomial logistic regression over the families and an ``unknown`` class is trained on varied templates and on ordinary
paragraphs of the corpus (a bounded sample); its probabilities are calibrated by a temperature on templates and paragraphs
held out of the training.  A prediction only counts if a template of the family confirms it: enough of the template's
distinctive words must occur, in order, or a title of the family as it stands.  Lines that hold no notice themselves are judged
together with the next ones up to a blank line, as a notice may be wrapped; the lines it takes are one entry.  SPDX
identifiers name their families exactly and need no prediction.

Defined cases: a null or empty text has no paragraphs and no families; repeated rows are scanned each; ties between families go
to the first by name; if the corpus gives no ordinary paragraphs, the built-in ones train the unknown class alone.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ticktape.llm.tables import sampled, text_of

# The notices by which each family is commonly declared.
TEMPLATES = {
    "AGPL": ["licensed under the gnu affero general public license version 3", "released under the agpl v3 license"],
    "Apache": ["licensed under the apache license version 2.0", "released under the apache 2.0 license", "you may not use this file except in compliance with the apache license"],
    "BSD": ["licensed under the bsd 3-clause license", "released under the bsd license", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "CC-BY": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "CC-BY-NC": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "CC-BY-ND": ["licensed under cc by-nd 4.0", "this work is licensed under a creative commons attribution-noderivatives 4.0 international license"],
    "CC-BY-SA": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "CC0": ["dedicated to the public domain under cc0 1.0", "released under the cc0 1.0 universal public domain dedication"],
    "GPL": ["this work is licensed under the gnu general public license version 3", "released under the gpl v3 license", "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "ISC": ["licensed under the isc license", "released under the isc license"],
    "LGPL": ["licensed under the gnu lesser general public license version 2.1", "released under the lgpl v3 license"],
    "MIT": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "MPL": ["licensed under the mozilla public license version 2.0", "this source code form is subject to the terms of the mozilla public license"],
    "Proprietary": ["all rights reserved", "copyright all rights reserved", "all rights reserved no part of this work may be reproduced without written permission"],
    "Unlicense": ["this is free and unencumbered software released into the public domain", "licensed under the unlicense"],
}
# The families' titles, without versions.
TITLES = {
    "AGPL": ["gnu affero general public license", "gnu agpl"],
    "Apache": ["apache license"],
    "BSD": ["bsd license", "bsd 2-clause license", "bsd 3-clause license"],
    "CC-BY": ["creative commons attribution"],
    "CC-BY-NC": ["creative commons attribution-noncommercial"],
    "CC-BY-ND": ["creative commons attribution-noderivatives"],
    "CC-BY-SA": ["creative commons attribution-sharealike"],
    "CC0": ["cc0 1.0 universal", "creative commons zero"],
    "GPL": ["gnu general public license", "gnu gpl"],
    "ISC": ["isc license"],
    "LGPL": ["gnu lesser general public license", "gnu lgpl"],
    "MIT": ["mit license"],
    "MPL": ["mozilla public license"],
    "Unlicense": ["the unlicense"],
}
# The families by the beginning of an SPDX identifier.
SPDX = [
    ("agpl-", "AGPL"), ("apache-", "Apache"), ("bsd-", "BSD"), ("0bsd", "BSD"), ("cc-by-nc", "CC-BY-NC"), ("cc-by-nd", "CC-BY-ND"),
    ("cc-by-sa", "CC-BY-SA"), ("cc-by-", "CC-BY"), ("cc0-", "CC0"), ("gpl-", "GPL"), ("isc", "ISC"), ("lgpl-", "LGPL"), ("mit", "MIT"),
    ("mpl-", "MPL"), ("unlicense", "Unlicense"),
]
# Ordinary sentences with licence words in them.
PLAIN = [
    "his driving license was renewed last week", "the license plate of the car was found", "a licensed doctor works in the city",
    "the general public was admitted version by version", "students of mit and apache helicopters", "the work is under way in the public garden",
    "the film was released under the bridge in may", "copyright law is taught at the university", "software is used in source and in binary",
    "the free fishing license costs two dollars", "permission to enter is granted to any person", "the foundation published its terms for the general assembly",
    "a creative attribution of the painting", "the public domain of knowledge", "all rights of the citizens are reserved for the court",
]
UNKNOWN = "unknown"
SAMPLE_DOCS, SAMPLE_LINES, SEED = 1_000, 5_000, 11
#: Least calibrated probability of a family; a template confirms it by this share of its distinctive words in order, or by
#: so many of them (a passage out of a long notice).
CERTAIN, CONFIRMED, PASSAGE = 0.7, 0.75, 6
#: A notice may be wrapped to a word a line.
WRAPPED = max(len(t.split()) for some in TEMPLATES.values() for t in some)
_TAGGED = re.compile(r"spdx-license-identifier:[ \t]*([^\n]*)")
_EXPRESSION = re.compile(r"[(]*[a-z0-9][a-z0-9.+-]*[)]*(?:[ \t]+(?:and|or|with)[ \t]+[(]*[a-z0-9][a-z0-9.+-]*[)]*)*")
_JOINED = re.compile(r"[ \t]+(?=(?:and|or|with)[ \t])")
_WORDS = re.compile(r"[a-z0-9][a-z0-9.\-/]*[a-z0-9]|[a-z0-9]")
_VERSIONS = ("1.0", "2.0", "2.1", "3", "3.0", "4.0", "v2", "v3")
_BEFORE = ("", "", "copyright 2019 the authors", "copyright (c) 2021 contributors", "notice:", "note that this text is", "all files are", "spdx-license-identifier:")
_AFTER = ("", "", "see the license file for details", "or later", "and may be shared", "by the authors", "unless stated otherwise")


def words_of(paragraph: str) -> list[str]:
    return _WORDS.findall(paragraph.lower())


def grams(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def varied(rng: random.Random, template: str) -> str:
    """A template as someone might have written it."""
    words = template.split()
    if len(words) > 9 and rng.random() < 0.4:
        a = rng.randrange(0, len(words) - 8)
        words = words[a : a + rng.randint(8, len(words))]
    words = [rng.choice(_VERSIONS) if w in _VERSIONS and rng.random() < 0.4 else w for w in words]
    return " ".join([rng.choice(_BEFORE), *words, rng.choice(_AFTER)]).strip()


@dataclass
class Model:
    classes: list[str]
    columns: dict[str, int]
    triggers: frozenset[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def probabilities(self, words: list[str]) -> np.ndarray:
        at = [self.columns[g] for g in set(grams(words)) if g in self.columns]
        raw = (self.bias + self.weights[at].sum(axis=0)) / self.temperature
        e = np.exp(raw - raw.max())
        return e / e.sum()


def _softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(ordinary: list[str], copies: int = 60, seed: int = SEED) -> Model:
    """Trains the classes on varied templates and on ``ordinary`` paragraphs."""
    rng = random.Random(seed)
    classes = [*sorted(TEMPLATES), UNKNOWN]
    texts = [(varied(rng, t), k) for k, name in enumerate(classes[:-1]) for t in [*TEMPLATES[name], *TITLES.get(name, ())] for _ in range(copies)]
    plain = [*PLAIN * 10, *ordinary]
    texts += [(t, len(classes) - 1) for t in plain]
    rng.shuffle(texts)
    rows = [(Counter(set(grams(words_of(t)))), k) for t, k in texts]
    notice, other = Counter(), Counter(g for t in ordinary for g in set(words_of(t)))
    for found, k in rows:
        if k < len(classes) - 1:
            notice.update(found)
    # single words that notices use and ordinary paragraphs of the corpus hardly do; longer n-grams must hold one of them
    rare = 0.02 * len(ordinary)
    triggers = frozenset(g for g, n in notice.items() if " " not in g and n >= 5 and other[g] <= rare and any(c.isalpha() for c in g))
    kept = sorted(g for g, n in notice.items() if n >= 5 and not triggers.isdisjoint(g.split(" ")))
    columns = {g: i for i, g in enumerate(kept)}
    x = np.zeros((len(rows), len(kept)), np.float32)
    for i, (found, _) in enumerate(rows):
        x[i, [columns[g] for g in found if g in columns]] = 1
    y = np.array([k for _, k in rows])
    # ordinary paragraphs without any feature are all alike: one weighted row stands for them
    blank = ~x.any(axis=1)
    x, y, weight = np.r_[x[~blank], np.zeros((1, len(kept)), np.float32)], np.r_[y[~blank], len(classes) - 1], np.r_[np.ones((~blank).sum()), max(1, blank.sum())]
    held = np.arange(len(y)) % 5 == 4
    held[-1] = False
    w, b = np.zeros((len(kept), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    goal, train = np.eye(len(classes), dtype=np.float32)[y], np.flatnonzero(~held)
    scale = np.minimum(weight / weight[train].sum(), 0.2).astype(np.float32)[train, None]
    x_train, goal = x[train], goal[train]
    velocity_w, velocity_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(300):
        miss = (_softmax(x_train @ w + b) - goal) * scale
        velocity_w = np.float32(0.9) * velocity_w - np.float32(2.0) * (x_train.T @ miss + np.float32(2e-5) * w)
        velocity_b = np.float32(0.9) * velocity_b - np.float32(2.0) * miss.sum(axis=0)
        w, b = w + velocity_w, b + velocity_b
    raw = x[held] @ w + b

    def loss(t: float) -> float:
        return -np.log(np.maximum(_softmax(raw / t)[np.arange(len(raw)), y[held]], 1e-12)).mean() if len(raw) else t

    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    return Model(classes, columns, triggers, w, b, temperature)


def in_order(template: list[str], words: list[str]) -> float:
    """Share of the template's words that occur in ``words`` in the template's order (longest common subsequence)."""
    row = [0] * (len(words) + 1)
    for t in template:
        last = 0
        for j, w in enumerate(words, 1):
            last, row[j] = row[j], last + 1 if w == t else max(row[j], row[j - 1])
    return row[-1] / len(template)


def confirmed(family: str, words: list[str], triggers: frozenset[str]) -> bool:
    """Whether a template of the family is there: its distinctive words, in order."""
    for template in TEMPLATES[family]:
        marks = [w for w in words_of(template) if w in triggers and w not in _VERSIONS]
        share = in_order(marks, [w for w in words if w in triggers]) if marks else 0.0
        if share >= CONFIRMED or share * len(marks) >= PASSAGE:
            return True
    return False


def titled(family: str, words: list[str]) -> bool:
    """Whether a title of the family is there, word by word; versions may stand inside."""
    said = " " + " ".join(w for w in words if w not in _VERSIONS) + " "
    return any(" " + " ".join(w for w in words_of(t) if w not in _VERSIONS) + " " in said for t in TITLES.get(family, ()))


def identified(low: str) -> list[str]:
    """The families that an SPDX tag of a lower-case line names, each once."""
    found = []
    for tag in _TAGGED.findall(low):
        expression = _EXPRESSION.match(tag)
        for part in _JOINED.split(expression[0]) if expression else ():
            joint, _, name = part.strip().rpartition(" ")
            family = next((f for start, f in SPDX if name.strip("()").startswith(start)), None)
            if family and joint != "with" and family not in found:
                found.append(family)
    return found


def judge(model: Model, words: list[str]) -> tuple[str, float] | None:
    """The family that the words declare and its probability."""
    p = model.probabilities(words)
    k = int(p.argmax())
    family = model.classes[k]
    if family != UNKNOWN and p[k] >= CERTAIN and (confirmed(family, words, model.triggers) or titled(family, words)):
        return family, float(p[k])
    return None


def notices(model: Model, text: str) -> tuple[int, list[tuple[str, list[tuple[str, float]]]]]:
    """Number of paragraphs, and the notices: each with its lines and its families."""
    n, found = 0, []
    block: list[tuple[str, list[str], bool]] = []  # lines without a notice of their own: line, words, whether a trigger is there

    def wrapped() -> None:
        i = 0
        while i < len(block):
            taken = i + 1
            if block[i][2]:
                words = list(block[i][1])
                for j in range(i + 1, min(len(block), i + WRAPPED)):
                    words += block[j][1]
                    if block[j][2] and (one := judge(model, words)):
                        found.append(("\n".join(line for line, _, _ in block[i : j + 1]), [one]))
                        taken = j + 1
                        break
            i = taken
        block.clear()

    for line in text.split("\n"):
        if not line or line.isspace():
            wrapped()
            continue
        n += 1
        low = line.lower()
        # without a trigger a paragraph has no feature and is unknown; words are only cut if one can be there
        words = _WORDS.findall(low)
        held = not model.triggers.isdisjoint(words)
        own = [(f, 1.0) for f in identified(low)] if "spdx-license-identifier:" in low else []
        if not own and held and (one := judge(model, words)):
            own = [one]
        if own:
            wrapped()
            found.append((line, own))
        else:
            block.append((line, words, held))
    wrapped()
    return n, found


def scan(model: Model, text: str) -> tuple[int, list[tuple[str, float, str]]]:
    """Number of paragraphs, and (family, probability, paragraph) of those that hold a licence."""
    n, found = notices(model, text)
    return n, [(f, p, lines) for lines, some in found for f, p in some]


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE_DOCS, lines: int = SAMPLE_LINES) -> Model:
    """A model whose unknown class has seen ordinary paragraphs of about ``sample`` documents, chosen by a hash of their text."""
    n = max(1, docs.count())
    body = text_of(text)
    some = docs.select(body.alias("t")).where(sampled(F.xxhash64("t"), sample, n))
    named = r"(?i)licen[sc]|copyright|public domain|all rights|spdx|\bcc[ -]by"
    cut = some.select(F.explode(F.split("t", "\n")).alias("line")).where((F.trim("line") != "") & ~F.col("line").rlike(named))
    rows = cut.distinct().orderBy(F.xxhash64("line"), "line").limit(lines).collect()
    return fit([r["line"] for r in rows])


def scanned(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``row`` (the input row), ``n_paragraphs``, ``n_notices`` and ``licences``: family, probability and paragraph of each notice."""

    @pandas_udf("n_paragraphs long, n_notices long, licences array<struct<family: string, probability: double, paragraph: string>>")
    def scan_all(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = [notices(model, t) for t in batch]
            dicts = [[{"family": f, "probability": p, "paragraph": line} for line, some in found for f, p in some] for _, found in rows]
            numbers = {"n_paragraphs": [n for n, _ in rows], "n_notices": [len(found) for _, found in rows]}
            yield pd.DataFrame({k: pd.Series(v, dtype="int64") for k, v in numbers.items()} | {"licences": dicts})

    return docs.select(F.struct("*").alias("row"), scan_all(text_of(text)).alias("found")).select("row", "found.*")
