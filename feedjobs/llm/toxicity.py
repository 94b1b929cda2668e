"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is the sum of two hashed embeddings: of the whole word and of its first four bytes. Filters of
widths 1, 2 and 3 run over the words of the whole text; the maximum of each filter over all places goes
through a rectifier to a logistic output. Training uses at most TRAIN_ROWS labelled documents (half of them
toxic if there are as many), drawn by a hash of the id; these go to the driver as word numbers. A second
sample of at most CALIBRATE_ROWS in natural proportion sets one threshold for each language, and the score is
moved so that 0.5 is the threshold. The language is guessed from function words of the text.

The table of labels, lang, source and doc_id are no inputs of a score. Rows with crc32(doc_id) mod 5 = 0 are
held out from training and calibration.

Defined results: of texts that share a labelled doc_id the smallest is the one learned; a null or empty text gets the score of a text without known words; texts are scored row by row,
so repeated rows get equal scores; without labels of both kinds all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_sample, materialise, sliced, text_bytes, word_hashes, word_spans

TRAIN_ROWS, CALIBRATE_ROWS = 6000, 3000
WORD_BITS, PREFIX_BITS, PREFIX = 18, 15, 4
DIM, WIDTHS, FILTERS = 8, (1, 2, 3), 8
EPOCHS, BATCH, RATE = 5, 32, 0.1
#: Small samples are passed more often (40 times at most), to make so many steps.
MIN_STEPS = 600
#: One empty clean text is added to the training rows for each so many.
EMPTY_SHARE = 20

# Function words by which the language of a text is guessed.
LANGUAGES = {
    "en": "the of and to in is that it for on with as was be by are this from or",
    "fr": "le la les des du et une que qui dans pour par sur est pas au avec ce elle",
    "de": "der die das und den von zu mit sich auf ist im dem nicht ein eine als auch",
    "es": "el los las y una del se con para no su al lo como pero sus este ya entre",
}

_inside = np.ones(256, dtype=bool)
_inside[:128] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _inside[_a:_b] = True


def _hash_words(words: list[str]) -> np.ndarray:
    data, offsets = text_bytes(pa.array([" ".join(words)]))
    starts, ends, _ = word_spans(data, offsets, _inside)
    return word_hashes(data, starts, ends)[0]


def word_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of both embedding tables for each word, the index of the first word of each text, and its language."""
    data, offsets = text_bytes(texts)
    starts, ends, first = word_spans(data, offsets, _inside)
    h, short = word_hashes(data, starts, ends, PREFIX)
    votes = np.zeros((len(first) - 1, len(LANGUAGES)))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for i, words in enumerate(LANGUAGES.values()):
        votes[:, i] = np.bincount(text[np.isin(h, _hash_words(words.split()))], minlength=len(votes))
    return (h >> np.uint64(64 - WORD_BITS)).astype(np.int32), (short >> np.uint64(64 - PREFIX_BITS)).astype(np.int32), first, votes.argmax(axis=1)


class Model:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.word = np.zeros(((1 << WORD_BITS) + 1, DIM), np.float32)  # the last row is the padding
        self.prefix = np.zeros(((1 << PREFIX_BITS) + 1, DIM), np.float32)
        self.conv = [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out_bias = np.float32(0)
        self.edge = np.zeros(len(LANGUAGES), np.float32)

    def padded(self, words: np.ndarray, prefixes: np.ndarray, first: np.ndarray):
        """Both numbers with padding words after each text, the start of each text there, and its places."""
        pad, n = max(WIDTHS) - 1, np.diff(first)
        length = np.maximum(n, 1)
        start = np.concatenate([[0], np.cumsum(length + pad)])
        at = np.arange(len(words)) + np.repeat(start[:-1] - first[:-1], n)
        w, p = np.full(start[-1], 1 << WORD_BITS, np.int32), np.full(start[-1], 1 << PREFIX_BITS, np.int32)
        w[at], p[at] = words, prefixes
        return w, p, start[:-1], length

    def forward(self, w: np.ndarray, p: np.ndarray):
        """Embedded words and the value of each filter at each place."""
        x = self.word[w] + self.prefix[p]
        maps = []
        for c, width in zip(self.conv, WIDTHS, strict=True):
            m = x @ c[0]
            for j in range(1, width):
                m[:-j] += x[j:] @ c[j]
            maps.append(m)
        return x, np.concatenate(maps, axis=1) + self.bias

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Output before the threshold, and the guessed language. Texts pass in chunks of about 20,000 words."""
        words, prefixes, first, lang = word_numbers(texts)
        out, i = np.zeros(len(lang), np.float32), 0
        while i < len(lang):
            j = max(i + 1, int(np.searchsorted(first, first[i] + 20_000, side="right")) - 1)
            part = slice(first[i], first[j])
            w, p, start, length = self.padded(words[part], prefixes[part], first[i : j + 1] - first[i])
            _, m = self.forward(w, p)
            cuts = np.stack([start, start + length], axis=1).ravel()
            best = np.maximum.reduceat(m, np.minimum(cuts, len(m) - 1), axis=0)[::2]
            out[i:j] = np.maximum(best, 0) @ self.out + self.out_bias
            i = j
        return out, lang

    def score(self, texts: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for b in sliced([pa.RecordBatch.from_arrays([texts], ["text"])], "text"):
            z, lang = self.logits(b["text"])
            out.append(1 / (1 + np.exp(-np.clip(z - self.edge[lang], -30, 30).astype(np.float64))))
        return np.concatenate(out)

    def train(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> None:
        """Adagrad on the logistic loss, both labels weighted alike. Only rows of words at a maximum change."""
        rng = np.random.default_rng(seed)
        weight = np.where(labels == 1, 0.5 / max(1e-9, labels.mean()), 0.5 / max(1e-9, 1 - labels.mean()))
        state: dict[str, np.ndarray] = {}

        def move(name: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None, rate: float = RATE) -> None:
            s = state.setdefault(name, np.full(value.shape, 1e-3, np.float32))
            if rows is None:
                s += grad * grad
                value -= rate * grad / np.sqrt(s)
            else:
                s[rows] += grad * grad
                value[rows] -= rate * grad / np.sqrt(s[rows])

        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // BATCH)):
                first = np.concatenate([[0], np.cumsum([len(docs[i][0]) for i in part])])
                w, p, start, length = self.padded(np.concatenate([docs[i][0] for i in part]), np.concatenate([docs[i][1] for i in part]), first)
                x, m = self.forward(w, p)
                top = np.stack([s + m[s : s + n].argmax(axis=0) for s, n in zip(start, length, strict=True)])  # [text, filter]
                best = np.take_along_axis(m, top, axis=0)
                on = np.maximum(best, 0)
                z = on @ self.out + self.out_bias
                d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) * weight[part] / len(part)).astype(np.float32)
                d_best = d[:, None] * self.out[None, :] * (best > 0)
                d_conv, rows, grads = [], [], []
                for k, width in enumerate(WIDTHS):
                    cols = slice(k * FILTERS, (k + 1) * FILTERS)
                    g = np.zeros_like(self.conv[k])
                    for j in range(width):
                        at = top[:, cols] + j
                        g[j] = np.einsum("tfd,tf->df", x[at], d_best[:, cols])
                        rows.append(at.ravel())
                        grads.append((d_best[:, cols, None] * self.conv[k][j].T[None]).reshape(-1, DIM))
                    d_conv.append(g)
                rows, grads = np.concatenate(rows), np.concatenate(grads)
                for name, table, ids, pad in (("w", self.word, w, 1 << WORD_BITS), ("p", self.prefix, p, 1 << PREFIX_BITS)):
                    some, where = np.unique(ids[rows], return_inverse=True)
                    total = np.stack([np.bincount(where, grads[:, c], len(some)) for c in range(DIM)], axis=1).astype(np.float32)
                    total[some == pad] = 0
                    move(name, table, total, some)
                for k, g in enumerate(d_conv):
                    move(f"c{k}", self.conv[k], g, rate=RATE / 5)
                move("b", self.bias, d_best.sum(axis=0), rate=RATE / 5)
                move("o", self.out, on.T @ d, rate=RATE / 5)
                self.out_bias = np.float32(self.out_bias - RATE / 5 * d.sum())

    def calibrate(self, z: np.ndarray, lang: np.ndarray, labels: np.ndarray) -> None:
        """Per language the threshold with the fewest errors, drawn towards the one for all languages where
        there are few labels."""
        every = _edge(z, labels, 0.0)
        for i in range(len(self.edge)):
            on = lang == i
            self.edge[i] = _edge(z[on], labels[on], every) if min(labels[on].sum(), (1 - labels[on]).sum()) >= 10 else every


def _edge(z: np.ndarray, labels: np.ndarray, otherwise: float) -> float:
    if not len(z) or labels.min() == labels.max():
        return otherwise
    order = np.argsort(z, kind="stable")
    z, labels = z[order], labels[order]
    wrong = np.concatenate([[0], np.cumsum(labels)]) + np.concatenate([np.cumsum((1 - labels)[::-1])[::-1], [0]])  # cut before i
    cuts = np.flatnonzero(wrong == wrong.min())
    i = int(cuts[len(cuts) // 2])
    low, high = z[max(0, i - 1)], z[min(len(z) - 1, i)]
    return float((low + high) / 2)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5))


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, prefixes, first, lang = word_numbers(b["text"])
        cut = lambda a: pa.array([a[i:j].astype("<i4").tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([b["toxic"], b["calibrate"], cut(words), cut(prefixes), pa.array(lang.astype(np.int32))], ["toxic", "calibrate", "words", "prefixes", "lang"])


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, calibrate_rows: int = CALIBRATE_ROWS) -> Model | None:
    """A model from labels (doc_id, toxic) outside fold 0; None without both kinds of labels."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = materialise(known.withColumn("fold", fold(F.col("doc_id"))).where("fold != 0"), "labels")
    first = lambda where, n: bounded_sample(known.where(where), n, "doc_id")
    sample = first("fold != 1 AND toxic = 1", train_rows // 2).unionByName(first("fold != 1 AND toxic = 0", train_rows - train_rows // 2)).withColumn("calibrate", F.lit(False))
    sample = sample.unionByName(first("fold = 1", calibrate_rows).withColumn("calibrate", F.lit(True)))
    sample = materialise(sample.select(F.col("doc_id").alias("_id"), "toxic", "calibrate"), "labelled-sample")  # bounded by both parameters
    texts = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("calibrate").alias("calibrate"))
    rows = texts.mapInArrow(lambda it: _with_id(it), "doc_id long, toxic int, calibrate boolean, words binary, prefixes binary, lang int").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    train, check = rows[~rows["calibrate"]], rows[rows["calibrate"]]
    if train["toxic"].nunique() < 2:
        return None
    model = Model()
    decode = lambda r: [(np.frombuffer(a, "<i4"), np.frombuffer(b, "<i4")) for a, b in zip(r["words"], r["prefixes"], strict=True)]
    nothing = len(train) // EMPTY_SHARE + 1  # texts without words count as clean
    none = np.zeros(0, np.int32)
    model.train(decode(train) + [(none, none)] * nothing, np.concatenate([train["toxic"].to_numpy(), np.zeros(nothing)]).astype(np.float32), max(EPOCHS, min(40, MIN_STEPS * BATCH // len(train))))
    held = check if len(check) else train
    each = np.arange(len(LANGUAGES))  # a text without words must end up on the clean side in every language
    z = np.array([_logit(model, a, b) for a, b in decode(held)] + [_logit(model, none, none)] * len(each))
    model.calibrate(z, np.concatenate([held["lang"].to_numpy(), each]), np.concatenate([held["toxic"].to_numpy(), 0 * each]))
    return model


def _with_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, "text"):
        for out in _numbers(iter([b])):
            yield pa.RecordBatch.from_arrays([b["doc_id"], *out.columns], ["doc_id", *out.schema.names])


def _logit(model: Model, words: np.ndarray, prefixes: np.ndarray) -> float:
    w, p, start, length = model.padded(words, prefixes, np.array([0, len(words)]))
    _, m = model.forward(w, p)
    return float(np.maximum(m[: length[0]].max(axis=0), 0) @ model.out + model.out_bias)


def with_scores(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with score."""
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(t):
        return t.__class__(shared.value.score(pa.array(t, pa.string(), from_pandas=True)))

    return docs.withColumn("score", score(F.col(text)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = with_scores(docs, fit(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
