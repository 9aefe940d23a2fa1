"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first
4, 5 and 6 letters. Only buckets that the learning rows show to go with a label
(the signed root of the likelihood ratio of their texts, `LEAST_STRENGTH` or
more) have an embedding, whose first number begins as that strength; the others
are zero, so that few labels cannot be learnt by heart. Filters of widths 1, 2
and 3 run over the whole text, each takes its maximum over the text, and a
logistic layer weighs the maxima. The network is fitted with Adam on a bounded
sample of labelled rows: at most `max_rows` of each label, those with the
smallest hash of their id, from all labelled rows. A fifth of them is held
back: on it an offset is fitted so that 0.7 parts the labels with the fewest
mistakes, and a threshold for each language that has enough of both labels (0.7
for the others). Neither labels, language, source nor ids are inputs of the
score; the language only picks the threshold.

Scoring runs where the documents are scanned, in blocks: distinct words of a
block are embedded and multiplied with the filters once, then gathered.

Defined results: a null or empty text has a score too (the filters' bias); rows
with a null label or id are not learnt from; with labels of one kind only, or
none, every score is the rate of that label (0 without any); an empty table
gives no rows; rows that repeat a doc_id are scored one by one; other columns
are ignored (a missing or null language has the threshold 0.7).
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockboard.llm.common import ALNUM_LOWER, mapped, one_array, slices, split_words, word_hashes

THRESHOLD = 0.7
MAX_ROWS = 2000
WORD_BUCKETS, PREFIX_BUCKETS = 1 << 17, 1 << 17
BUCKETS = WORD_BUCKETS + PREFIX_BUCKETS + 1       # the last one is of blanks
PREFIXES = (4, 5, 6)
DIM, FILTERS, WIDTHS = 16, 16, (1, 2, 3)
EPOCHS, BATCH_DOCS, RATE, DECAY, SEED = 8, 32, 0.01, 1e-4, 7
LEAST_STEPS = 500                 # of Adam: few labelled rows are gone through more often
LEAST_STRENGTH = 3.0              # in standard deviations, for a word or beginning to have an embedding
LEAST_PER_LANGUAGE = 20
STRENGTH_DOCS = 128               # texts whose words are counted at once
BLOCK_BYTES = 1 << 20


def features(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word of each place, where each text begins and the end, buckets of each
    distinct word). Every text is followed by two blanks, whose buckets are -1."""
    words, offsets, vocabulary = split_words(mapped(texts, ALNUM_LOWER))
    n = len(vocabulary)
    buckets = np.full((n + 1, 1 + len(PREFIXES)), -1, np.int64)
    if n:
        buckets[:n, 0] = word_hashes(vocabulary) % np.uint64(WORD_BUCKETS)
        for k, size in enumerate(PREFIXES):
            starts = pc.utf8_slice_codeunits(vocabulary, 0, size).dictionary_encode()
            h = word_hashes(starts.dictionary, 1) + np.uint64(size)
            buckets[:n, 1 + k] = (h % np.uint64(PREFIX_BUCKETS))[starts.indices.to_numpy(zero_copy_only=False)]
            buckets[:n, 1 + k] += WORD_BUCKETS
    ends = np.repeat(offsets[1:], 2)
    return np.insert(words, ends, n), offsets + 2 * np.arange(len(offsets)), buckets


@dataclass
class Network:
    """The row of each bucket among the embeddings, the embeddings (the last is zero), one matrix
    for each place of each filter width, biases, the logistic layer."""
    index: np.ndarray
    embedding: np.ndarray
    filters: list[list[np.ndarray]]
    bias: list[np.ndarray]
    weight: np.ndarray
    offset: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None

    @classmethod
    def fresh(cls, strengths: np.ndarray, seed: int = SEED) -> Network:
        r = np.random.default_rng(seed)
        used = np.flatnonzero(strengths)
        index = np.full(BUCKETS, len(used), np.int32)
        index[used] = np.arange(len(used))
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        table = (0.1 * r.standard_normal((len(used) + 1, DIM))).astype(np.float32)
        table[:-1, 0] = strengths[used] / LEAST_STRENGTH
        table[-1] = 0
        return cls(index, table, [[draw(DIM, FILTERS) for _ in range(w)] for w in WIDTHS],
                   [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                   0.1 * draw(FILTERS * len(WIDTHS)), np.zeros(1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *(m for f in self.filters for m in f), *self.bias, self.weight, self.offset]

    def vectors(self, buckets: np.ndarray) -> np.ndarray:
        return self.embedding[self.index[buckets]].sum(axis=1)        # -1 is the last bucket, which has none

    def maxima(self, words: np.ndarray, begins: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """The maximum of each filter over each text (not below 0)."""
        out = []
        for matrices, bias in zip(self.filters, self.bias, strict=True):
            places = None
            for k, m in enumerate(matrices):
                one = (vectors @ m)[words[k:]]
                if places is None:
                    places = one
                else:
                    places[:len(one)] += one               # the last places are blanks of the last text
            out.append(np.maximum(np.maximum.reduceat(places, begins[:-1], axis=0) + bias, 0))
        return np.concatenate(out, axis=1)

    def logits(self, texts: pa.StringArray) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        words, begins, buckets = features(texts)
        return (self.maxima(words, begins, self.vectors(buckets)) @ self.weight + self.offset).astype(np.float64)

    def scores(self, texts: pa.StringArray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(texts) + self.shift, -40, 40)))


def gradients(net: Network, words: np.ndarray, begins: np.ndarray, buckets: np.ndarray,
              label: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean logistic loss; only the places of the maxima carry any."""
    vectors = net.vectors(buckets)
    n, top, where = len(label), [], []
    for matrices, bias in zip(net.filters, net.bias, strict=True):
        places = np.zeros((len(words), FILTERS), np.float32)
        for k, m in enumerate(matrices):
            places[:len(words) - k] += (vectors @ m)[words[k:]]
        at = np.stack([a + places[a:b].argmax(axis=0) for a, b in zip(begins[:-1], begins[1:], strict=True)])
        top.append(np.maximum(np.take_along_axis(places, at, axis=0) + bias, 0))
        where.append(at)
    hidden = np.concatenate(top, axis=1)
    logit = hidden @ net.weight + net.offset
    d_logit = ((1 / (1 + np.exp(-np.clip(logit, -40, 40))) - label) / n).astype(np.float32)
    d_hidden = (d_logit[:, None] * net.weight) * (hidden > 0)
    d_vectors = np.zeros_like(vectors)
    d_filters, d_bias = [], []
    for k, (matrices, at) in enumerate(zip(net.filters, where, strict=True)):
        d = d_hidden[:, k * FILTERS:(k + 1) * FILTERS]
        d_bias.append(d.sum(axis=0))
        for j, m in enumerate(matrices):
            word = words[np.minimum(at + j, len(words) - 1)]
            d_filters.append(np.einsum("nfd,nf->df", vectors[word], d))
            np.add.at(d_vectors, word, d[:, :, None] * m.T[None])
    touched = np.flatnonzero(np.abs(d_vectors).sum(axis=1))
    d_embedding = np.zeros_like(net.embedding)
    for column in net.index[buckets[touched]].T:
        np.add.at(d_embedding, column, d_vectors[touched])
    d_embedding[-1] = 0
    return [d_embedding, *d_filters, *d_bias, hidden.T @ d_logit, d_logit.sum(keepdims=True)]


def strengths(texts: pa.StringArray, labels: np.ndarray) -> np.ndarray:
    """For each bucket the signed root of the likelihood ratio of its texts' labels against
    all texts' (positive: label 1 likelier); 0 below LEAST_STRENGTH."""
    ones, zeros = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for low in range(0, len(texts), STRENGTH_DOCS):
        words, begins, buckets = features(one_array(texts[low:low + STRENGTH_DOCS]))
        row = np.repeat(np.arange(low, low + len(begins) - 1), np.diff(begins))
        found = np.unique(np.concatenate([np.unique(row * BUCKETS + buckets[words, k] % BUCKETS)
                                          for k in range(buckets.shape[1])]))
        toxic = labels[found // BUCKETS] > 0
        for count, rows in ((ones, toxic), (zeros, ~toxic)):
            count += np.bincount((found % BUCKETS)[rows], minlength=BUCKETS)
    rate, n = labels.mean(dtype=float), ones + zeros
    term = lambda x, p: x * np.log(np.maximum(x, 1e-9) / np.maximum(n * p, 1e-9))
    out = np.sign(ones - n * rate) * np.sqrt(np.maximum(2 * (term(ones, rate) + term(zeros, 1 - rate)), 0))
    out[-1] = 0
    return np.where(np.abs(out) >= LEAST_STRENGTH, out, 0)


def fit(texts: list[str], labels: np.ndarray, languages: list[str | None], epochs: int = EPOCHS,
        seed: int = SEED) -> Network:
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        net = Network.fresh(np.zeros(BUCKETS), seed)
        net.constant = float(labels.mean()) if len(labels) else 0.0
        return net
    r = np.random.default_rng(seed)
    order = r.permutation(len(labels))
    back = order[:len(order) // 5]
    learn = order[len(order) // 5:]
    array = pa.array(texts, pa.string())
    net = Network.fresh(strengths(one_array(array.take(pa.array(learn))), labels[learn]), seed)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    per_epoch = max(1, -(-len(learn) // BATCH_DOCS))
    for _ in range(max(epochs, -(-LEAST_STEPS // per_epoch))):
        r.shuffle(learn)
        for a in range(0, len(learn), BATCH_DOCS):
            chosen = learn[a:a + BATCH_DOCS]
            found = gradients(net, *features(one_array(array.take(pa.array(chosen)))), labels[chosen])
            step += 1
            for p, g, (m, v) in zip(net.parameters(), found, state, strict=True):
                g = g + DECAY * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    calibrate(net, net.logits(one_array(array.take(pa.array(back)))), labels[back], [languages[k] for k in back])
    return net


def best_cut(values: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap between distinct values that parts the labels with the fewest
    mistakes, of several the widest; the open ends count as gaps, so that values which say
    nothing mark only what is the more frequent label."""
    order = np.argsort(values, kind="stable")
    v, y = values[order], labels[order]
    edges = np.concatenate(([v[0] - 2], v, [v[-1] + 2]))
    gap = np.diff(edges)
    wrong = np.concatenate(([0], np.cumsum(y))) + np.concatenate((np.cumsum((1 - y)[::-1])[::-1], [0]))
    k = int(np.lexsort((-gap, np.where(gap > 0, wrong, np.inf)))[0])
    return float((edges[k] + edges[k + 1]) / 2)


def calibrate(net: Network, logits: np.ndarray, labels: np.ndarray, languages: list[str | None]) -> None:
    both = len(labels) and labels.min() < labels.max()
    cut = best_cut(logits, labels) if both else 0.0
    net.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - net.scale * cut)
    scores = 1 / (1 + np.exp(-np.clip(net.scale * logits + net.shift, -40, 40)))
    for language in sorted({x for x in languages if x}):
        own = np.array([x == language for x in languages])
        if min(labels[own].sum(), (1 - labels[own]).sum()) >= LEAST_PER_LANGUAGE:
            net.thresholds[language] = best_cut(scores[own], labels[own])


def scorer(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in slices(batches, BLOCK_BYTES):
            scores = net.scores(one_array(block.column("text")))
            cut = [net.thresholds.get(x, THRESHOLD) for x in block.column("lang").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64()), pa.array(cut, pa.float64())],
                ["doc_id", "score", "threshold"])
    return run


def remainder(doc_id: Column, of: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_rows: int = MAX_ROWS) -> Network:
    """The network fitted on at most `max_rows` documents of each label. `usable`
    is a condition on the column doc_id."""
    lang = docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    d = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), lang.alias("lang"))
    marked = labels.where(labels["toxic"].isin(0, 1) & labels["doc_id"].isNotNull()) \
        .select(labels["doc_id"].alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    if usable is not None:
        marked = marked.where(usable)
    rows = []
    for label in (0, 1):
        chosen = marked.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        rows += d.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "lang", "toxic").collect()
    rows.sort(key=lambda x: (x.doc_id, x.text or "", x.toxic))
    return fit([x.text or "" for x in rows], np.array([x.toxic for x in rows]), [x.lang for x in rows])


def toxicity(docs: DataFrame, net: Network) -> DataFrame:
    """One row per document: doc_id, score, threshold (of its language), toxic."""
    lang = docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    d = docs.select(docs["doc_id"], docs["text"], lang.alias("lang"))
    return d.mapInArrow(scorer(net), "doc_id long, score double, threshold double") \
        .withColumn("toxic", F.col("score") >= F.col("threshold"))


def drop_toxic(docs: DataFrame, net: Network) -> DataFrame:
    """The documents below their threshold, with all their columns, in one pass over them."""
    has_lang = "lang" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in slices(batches, BLOCK_BYTES):
            scores = net.scores(one_array(block.column("text")))
            lang = block.column("lang").cast(pa.string()).to_pylist() if has_lang else [None] * len(scores)
            yield block.filter(pa.array(scores < np.array([net.thresholds.get(x, THRESHOLD) for x in lang])))
    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder(F.col("doc_id"), 3) != 1)
    found = toxicity(docs, net)
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "threshold", "toxic")
