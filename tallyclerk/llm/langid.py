"""Language identification: sparse multinomial logistic regression on character n-gram TF-IDF.

Texts become lower-case letters with every other character a space; their 1-, 2- and 3-grams are
hashed into `2 ** BITS` features, weighted by relative frequency times inverse document frequency.
The model is trained with follow-the-regularised-leader (per-coordinate rates, elastic net) on a
bounded sample of labelled documents, and its scores are calibrated with a temperature fitted on a
part of the sample that training did not see. Document frequencies are counted over all documents that may
be learned from. Predicting is one pass over the texts in Arrow batches: no shuffle, and whole texts, in
pieces where they are long.

The fit uses at most about `per_lang` documents of each language (a hashed sample of the training
documents, so it does not depend on order), of longer ones a stretch of `max_chars` characters from a hashed
place on, and of more than `max_langs` languages those with the most documents. This is the only bounded part.

Odd input: a null text and one without a letter are `und` with score 0; so is everything when there
is nothing to learn from. Rows with null lang teach nothing. Repeated rows are predicted each.
A null doc_id is not held out and teaches nothing. An empty table gives an empty result. Columns
other than doc_id, text and lang are not looked at, and lang only in training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

BITS, PER_LANG, MAX_CHARS, MAX_LANGS, EPOCHS = 16, 400, 100_000, 200, 6
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 1e-3
SCALE = 30.0
UNKNOWN = "und"
_CHUNK = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point to the lower-case letter's, or to the space's, for the basic plane; made once."""
    if _table:
        return _table[0]
    out = np.full(1 << 16, 32, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else i
    _table.append(out)
    return out


def letters_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if len(codes) and codes.max() >= 1 << 16:
        far = np.unique(codes[codes >= 1 << 16])
        good = far[[chr(c).isalpha() for c in far.tolist()]]
        codes = np.where(codes < 1 << 16, codes, np.where(np.isin(codes, good), 0x4E00 + codes % 0x4000, 32))
    return _letters()[codes]


def grams(letters: np.ndarray) -> Iterator[np.ndarray]:
    """Feature numbers of all n-grams that are not blank, piece by piece."""
    shift = np.uint32(32 - BITS)
    blank = np.full(1, 32, np.uint32)
    padded = np.concatenate([blank, letters, blank])
    for at in range(0, len(letters), _CHUNK):
        c = padded[at : at + _CHUNK + 2]  # the centres of the trigrams are all but the ends
        word = c[1:-1] != 32
        one = c * np.uint32(2654435761)
        two = c[:-1] * np.uint32(31) + c[1:] * np.uint32(40503) + np.uint32(7)
        three = two[:-1] * np.uint32(2246822519) + c[2:] * np.uint32(3266489917) + np.uint32(13)
        yield one[1:-1][word] >> shift
        yield (two[:-1] * np.uint32(2654435761))[word | (c[:-2] != 32)] >> shift
        yield (three * np.uint32(2654435761))[word] >> shift


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # features x languages, idf included
    bias: np.ndarray
    temperature: float

    def scores(self, letters: np.ndarray) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for g in grams(letters):
            total += self.weights[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        return self.bias + SCALE * total / max(n, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        letters = letters_of(text or "")
        if not self.langs or not (letters != 32).any():
            return UNKNOWN, 0.0
        z = self.scores(letters) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def fit(texts: list[str], labels: list[str], epochs: int = EPOCHS, seed: int = 1, frequencies: tuple[int, np.ndarray] | None = None) -> Model:
    """Train on the given documents; a fifth of them only sets the temperature.

    frequencies: a number of documents and in how many of them each feature is; by default those trained on.
    """
    langs = sorted(set(labels))
    rows = [(langs.index(y), np.concatenate([*grams(x)])) for t, y in zip(texts, labels, strict=True) if ((x := letters_of(t)) != 32).any()]
    if not rows:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
    counts = [np.unique(g, return_counts=True) for _, g in rows]
    order = np.random.default_rng(seed).permutation(len(rows))
    spare = set(order[: len(rows) // 5].tolist())
    seen = np.zeros(1 << BITS)
    for i, (f, _) in enumerate(counts):
        if i not in spare:
            seen[f] += 1
    n_train = len(rows) - len(spare)
    if frequencies is not None:
        n_train, seen = frequencies
    idf = np.where(seen > 0, np.log((1 + n_train) / (1 + seen)) + 1, 0.0)
    vectors = [(f, SCALE * (k / k.sum()) * idf[f]) for f, k in counts]
    z, n = np.zeros((1 << BITS, len(langs))), np.zeros((1 << BITS, len(langs)))
    zb, nb = np.zeros(len(langs)), np.zeros(len(langs))
    lead = lambda z, n, l1: -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    rng = np.random.default_rng(seed + 1)
    train = [i for i in range(len(rows)) if i not in spare]
    for _ in range(epochs):
        for i in rng.permutation(train):
            f, x = vectors[i]
            w, b = lead(z[f], n[f], L1), lead(zb, nb, 0.0)
            s = x @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[rows[i][0]] -= 1
            g = x[:, None] * p
            z[f] += g - (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA * w
            n[f] += g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / ALPHA * b
            nb += p * p
    model = Model(langs, (lead(z, n, L1) * idf[:, None]).astype(np.float32), lead(zb, nb, 0.0), 1.0)
    if spare:
        held = sorted(spare)
        s = np.array([model.bias + vectors[i][1] @ lead(z[vectors[i][0]], n[vectors[i][0]], L1) for i in held])
        y = np.array([rows[i][0] for i in held])

        def loss(log_t: float) -> float:
            q = s / np.exp(log_t)
            top = q.max(axis=1, keepdims=True)
            return float((np.log(np.exp(q - top).sum(axis=1)) + top[:, 0] - q[np.arange(len(y)), y]).mean())

        model.temperature = float(np.exp(min(np.linspace(-2.5, 2.5, 101), key=loss)))
    return model


def learnable(documents: DataFrame) -> DataFrame:
    """(doc_id, text, lang) of documents that may be learned from."""
    return documents.select("doc_id", "text", "lang").filter(
        F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def training_sample(documents: DataFrame, per_lang: int = PER_LANG, max_chars: int = MAX_CHARS, max_langs: int = MAX_LANGS) -> DataFrame:
    """(text, lang) of about `per_lang` documents of each language, none of them held out."""
    usable = learnable(documents)
    most = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
    counts = {r.lang: r.n for r in most.collect()}
    if not counts:
        return usable.select("text", "lang")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_003)) / 1_000_003
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_lang / n))) for k, n in counts.items()])
    begin = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.length("text") - max_chars, F.lit(0)) + 1) + 1
    return usable.filter(draw < share).select(F.substring("text", begin.cast("int"), F.lit(max_chars)).alias("text"), "lang")


def document_frequencies(documents: DataFrame) -> tuple[int, np.ndarray]:
    """How many documents there are to learn from, and in how many of them each feature is.

    A task adds up its documents and sends a row per feature, of which there are 2 ** BITS.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                letters, has = letters_of(text), np.zeros(1 << BITS, bool)
                for g in grams(letters):
                    has[g] = True
                total += has
                n += bool(has.any())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["f", "n"])

    rows = by_bytes(learnable(documents)).select("text").mapInArrow(run, "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n")).collect()
    seen, n = np.zeros(1 << BITS), 0
    for r in rows:
        if r.f < 0:
            n = r.n
        else:
            seen[r.f] = r.n
    return n, seen


def fit_documents(documents: DataFrame, per_lang: int = PER_LANG, max_chars: int = MAX_CHARS) -> Model:
    rows = sorted((r.lang, r.text) for r in training_sample(documents, per_lang, max_chars).collect())
    return fit([t for _, t in rows], [y for y, _ in rows], frequencies=document_frequencies(documents))


def said(text: Column, model: Model, documents: DataFrame) -> Column:
    """struct<lang_pred, score> of a text column of `documents`."""
    # 2 ** BITS x languages floats, as plain values: workers build the model from them.
    shared = documents.sparkSession.sparkContext.broadcast((model.langs, model.weights, model.bias, model.temperature))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        for texts in batches:
            yield pd.DataFrame([own.predict(t) for t in texts], columns=["lang_pred", "score"]).astype({"lang_pred": object, "score": float})

    # Not pushed into filters of the caller, where it would run a second time.
    return F.pandas_udf(run, "struct<lang_pred:string,score:double>").asNondeterministic()(text)


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """`documents` with lang_pred and score, in place of columns of those names."""
    others = [F.col(f"`{c}`") for c in documents.columns if c not in ("lang_pred", "score")]
    own = "_said" + "_" * max(map(len, documents.columns))  # longer than any name that is there
    parts = by_bytes(documents).select(*others, said(F.col("text"), model, documents).alias(own))
    return parts.select(*others, F.col(f"{own}.lang_pred").alias("lang_pred"), F.col(f"{own}.score").alias("score"))
