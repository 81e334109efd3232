"""Language identification of words by a linear-chain conditional random field.

Each word of a text gets a label, a language.  A word's emission score adds learned weights
of its features: prefixes and suffixes of one to three bytes, byte bigrams and trigrams, and
its lexicon entry, how often documents of each language hold it.  A learned transition score
for each pair of languages links neighbours, so that single borrowed words and real switches
of language within a text are told apart.  Forward-backward gives every word's probability of
each language; a text's language is the one with the most expected words, and its score the
share of words it is expected to have.

The CRF is trained by stochastic gradient ascent of the conditional likelihood on sequences
that switch between languages: pieces of texts with one language are spliced, so the labels
of words are known and transitions can be learned.  The sample is bounded: at most
``SAMPLE_DOCS`` documents of each language, of each a piece of at most ``SAMPLE_CHARS``
characters, both chosen by a hash.  The lexicon counts all documents that may be learned from;
words are hashed into ``LEXICON`` buckets.  All other features are hashed into ``FEATURES``
weights.  Every language that occurs is learned; the model takes 1.5 MB for each.

Scale: one pass counts the lexicon (tasks add up before the shuffle), one pass labels; no text
is shuffled.  Forward-backward runs over all words of many texts at once: texts are cut into
segments of ``SEGMENT`` words, whose transfer matrices are multiplied up, so very long texts
need no long loop.  Results do not depend on the cuts.

Edge cases: a null text, or one without any letter, is `und` with score 0.  Rows without a
language or text are not learned from; if nothing can be learned, every text is `und`.  Null
ids are held out of nothing (they may be learned from).  Ties go to the language that sorts first.
Repeated rows stay rows.  Empty tables give empty results.  Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import broadcast_if_small, column, fold_of, materialize, sliced, text_bytes

FOLDS, HELD_OUT = 4, 2
SAMPLE_DOCS, SAMPLE_CHARS = 250, 12_000
LEXICON = 1 << 19
FEATURES = 1 << 17
SEGMENT = 32
#: Training sequences (at least, and for each language), their words, and passes over them.
SEQUENCES, PER_LANGUAGE, LENGTH, EPOCHS = 6000, 100, 48, 4
#: Words that are labelled at once, and word types that a task remembers.
_WORDS, _HELD = 400_000, 300_000
_FLUSH = 300_000

_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Longer runs of letters are labelled in pieces of so many bytes.
PIECE = 40


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of letters, A-Z lower-cased; all other characters of ASCII separate them."""
    words = (text or b"").translate(_LETTERS).split()
    if any(len(w) > PIECE for w in words):
        words = [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]
    return words


def has_letter(text: bytes | None) -> bool:
    """Whether a text has any letter of any script."""
    if not text:
        return False
    if text.translate(_LETTERS).translate(None, bytes(range(0x80, 0x100)) + b" "):
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _feature_ids(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all features of the words but their lexicon entries."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    begin = np.cumsum(lens) - lens
    row = np.repeat(np.arange(len(words)), lens)
    place = np.arange(len(flat)) - begin[row]
    rows, ids = [np.arange(len(words))], [np.zeros(len(words), np.int64)]  # the bias

    def add(kind: int, which: np.ndarray, size: int) -> None:
        """The ``size`` bytes from each place of ``which``."""
        h = np.full(len(which), kind + 1, np.uint64)
        for k in range(size):
            h = (h ^ flat[which + k]) * _STEP
            h ^= h >> np.uint64(29)
        rows.append(row[which])
        ids.append((h % np.uint64(FEATURES - 1)).astype(np.int64) + 1)

    for size in (1, 2, 3):
        long = np.flatnonzero(lens >= size)
        add(size, begin[long], size)
        add(10 + size, begin[long] + lens[long] - size, size)
        if size > 1:
            add(20 + size, np.flatnonzero(place + size <= lens[row]), size)
    return np.concatenate(rows), np.concatenate(ids)


def _buckets(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) % LEXICON for w in words], np.int64)


@dataclass
class Model:
    """Languages, feature weights, lexicon scores and their weights, transition scores."""

    languages: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    mix: np.ndarray
    switch: np.ndarray

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Emission scores of word types."""
        rows, ids = _feature_ids(words)
        out = np.stack([np.bincount(rows, self.weights[ids, k], len(words)) for k in range(len(self.languages))], 1)
        return out + self.lexicon[_buckets(words)].astype(np.float64) @ self.mix


def _learnable(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"), column(lang_col).alias("lang"))
    held = F.coalesce(fold_of(F.col("id"), FOLDS) == HELD_OUT, F.lit(False))
    return rows.where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull())


def _lexicon(train: DataFrame, languages: list[str]) -> np.ndarray:
    """Scores of each bucket for each language from all of ``train``."""
    index = {x: k for k, x in enumerate(languages)}

    def count(batches):
        known: dict[bytes, int] = {}
        n: dict[tuple[int, int], int] = {}

        def rows():
            both = np.array([*n.keys()], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].astype(np.int32)), pa.array(both[:, 1].astype(np.int32)), pa.array([*n.values()], pa.int64())], ["bucket", "lang", "n"])

        for batch in sliced(batches, of="text"):
            for text, lang in zip(text_bytes(batch.column("text")), batch.column("lang").to_pylist(), strict=True):
                k = index.get(lang)
                if k is None:
                    continue
                for w in set(words_of(text)):
                    b = known.get(w)
                    if b is None:
                        b = known[w] = xxhash.xxh64_intdigest(w) % LEXICON
                    key = (b, k)
                    n[key] = n.get(key, 0) + 1
                if len(known) > _FLUSH:
                    known.clear()
                if len(n) > _FLUSH:
                    yield rows()
                    n.clear()
        yield rows()

    counts = train.select("text", "lang").mapInArrow(count, "bucket int, lang int, n long").groupBy("bucket", "lang").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "lexicon")
    total = np.ones(len(languages))
    for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect():
        total[r["lang"]] += r["n"]

    def scored(batches):
        for batch in sliced(batches, rows=2000):
            own = batch.column("own")
            n = np.zeros((batch.num_rows, len(languages)))
            at = np.repeat(np.arange(batch.num_rows), np.asarray(own.value_lengths()))
            n[at, np.asarray(own.flatten().field("lang"))] = np.asarray(own.flatten().field("n"))
            share = (n + 0.1) / total
            share /= share.sum(1, keepdims=True)
            trust = np.minimum(1, np.log1p(n.sum(1, keepdims=True)) / 4)
            rows = (trust * np.log(share * len(languages))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array([x.tobytes() for x in rows], pa.binary())], ["bucket", "scores"])

    # two bytes for each bucket and language come to the driver
    rows = counts.groupBy("bucket").agg(F.collect_list(F.struct("lang", "n")).alias("own")).mapInArrow(scored, "bucket int, scores binary")
    out = np.zeros((LEXICON, len(languages)), np.float16)
    got = rows.toArrow()
    for batch in got.to_batches():
        out[batch.column("bucket").to_numpy()] = np.frombuffer(b"".join(batch.column("scores").to_pylist()), np.float16).reshape(-1, len(languages))
    return out


def _sequences(samples: list[tuple[str, bytes]], languages: list[str], seed: int) -> tuple[list[list[bytes]], np.ndarray]:
    """Sequences of ``LENGTH`` words spliced from texts, and the labels of their words."""
    rng = np.random.default_rng(seed)
    texts = {k: [w for lang, t in samples if lang == x and len(w := words_of(t)) > 2] for k, x in enumerate(languages)}
    texts = {k: v for k, v in texts.items() if v}
    out, labels = [], np.zeros((max(SEQUENCES, PER_LANGUAGE * len(texts)), LENGTH), np.int64)
    keys = sorted(texts)
    for s in range(max(SEQUENCES, PER_LANGUAGE * len(keys)) if keys else 0):
        words: list[bytes] = []
        while len(words) < LENGTH:
            k = keys[rng.integers(len(keys))]
            own = texts[k][rng.integers(len(texts[k]))]
            size = min(int(rng.geometric(1 / 14)), LENGTH - len(words), len(own))
            at = int(rng.integers(len(own) - size + 1))
            labels[s, len(words) : len(words) + size] = k
            words += own[at : at + size]
        out.append(words)
    return out, labels[: len(out)]


def _marginals(e: np.ndarray, switch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of labels, and expected transitions, for sequences of one length.

    e: (sequences, words, languages) scores.  The label before the first word is uniform.
    """
    p, a = np.exp(e - e.max(2, keepdims=True)), np.exp(switch - switch.max())
    size, length, langs = p.shape
    alpha = np.empty_like(p)
    f = np.full((size, langs), 1.0 / langs)
    for t in range(length):
        f = (f @ a) * p[:, t]
        f /= f.sum(1, keepdims=True)
        alpha[:, t] = f
    beta = np.ones((size, langs))
    gamma, moves = np.empty_like(p), np.zeros((langs, langs))
    for t in range(length - 1, -1, -1):
        g = alpha[:, t] * beta
        gamma[:, t] = g / g.sum(1, keepdims=True)
        ahead = p[:, t] * beta
        before = alpha[:, t - 1] if t else np.full((size, langs), 1.0 / langs)
        joint = before[:, :, None] * a[None] * ahead[:, None, :]
        moves += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        beta = ahead @ a.T
        beta /= beta.sum(1, keepdims=True)
    return gamma, moves


def train(samples: list[tuple[str, bytes]], languages: list[str], lexicon: np.ndarray, *, seed: int = 7, batch: int = 200, rate: float = 0.2) -> Model:
    """Fit the weights on spliced sequences of the samples by Adagrad."""
    langs = len(languages)
    model = Model(languages, np.zeros((FEATURES, langs)), lexicon, np.eye(langs), np.zeros((langs, langs)))
    sequences, labels = _sequences(samples, languages, seed)
    steps = [np.full(x.shape, 1e-2) for x in (model.weights, model.mix, model.switch)]
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(sequences))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            flat = [w for s in some for w in sequences[s]]
            types = {w: k for k, w in enumerate(dict.fromkeys(flat))}
            ids = np.fromiter(map(types.__getitem__, flat), np.int64, len(flat))
            words = [*types]
            rows, feats = _feature_ids(words)
            lex = lexicon[_buckets(words)].astype(np.float64)
            e = np.stack([np.bincount(rows, model.weights[feats, k], len(words)) for k in range(langs)], 1) + lex @ model.mix
            y = labels[some]
            gamma, moves = _marginals(e[ids].reshape(len(some), LENGTH, langs), model.switch)
            goal = np.eye(langs)[y]
            diff = (goal - gamma).reshape(-1, langs)
            per_word = np.stack([np.bincount(ids, diff[:, k], len(words)) for k in range(langs)], 1)
            seen = np.zeros((langs, langs))
            np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1.0)
            seen += np.bincount(y[:, 0], minlength=langs)[None, :] / langs
            grads = [np.stack([np.bincount(feats, per_word[rows, k], FEATURES) for k in range(langs)], 1) - 1e-4 * model.weights, lex.T @ per_word, seen - moves]
            for own, step, g in zip((model.weights, model.mix, model.switch), steps, grads, strict=True):
                g = g / len(some)
                step += g * g
                own += rate * g / np.sqrt(step)
    model.weights = model.weights.astype(np.float32)
    return model


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learn from the documents outside the held-out fold that have a language."""
    known = _learnable(docs, id_col, text_col, lang_col)
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not languages:
        return Model([], np.zeros((1, 0)), np.zeros((1, 0)), np.zeros((0, 0)), np.zeros((0, 0)))
    lexicon = _lexicon(known, languages)
    # the limit of each language's rank is applied in the tasks before the shuffle
    rank = Window.partitionBy("lang").orderBy("h")
    chosen = known.select("lang", F.xxhash64("id", "text").alias("h")).distinct().withColumn("r", F.row_number().over(rank)).where(F.col("r") <= sample_docs)
    chosen = materialize(chosen.select(F.col("lang").alias("l"), "h"), "language-sample")
    picked = known.join(broadcast_if_small(chosen, chosen.count()), (F.col("lang") == F.col("l")) & (F.xxhash64("id", "text") == F.col("h")), "left_semi")
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - sample_chars + 1, F.lit(1)).cast("long")) + 1
    rows = picked.select("lang", F.substring("text", start.cast("int"), F.lit(sample_chars)).alias("text")).distinct().collect()
    return train([(r["lang"], r["text"].encode()) for r in sorted(rows)], languages, lexicon)


def expected(e: np.ndarray, lens: np.ndarray, switch: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Expected words of each language in each text, by forward-backward.

    e: scores of all words, texts one after the other; lens: words of each text, none 0.
    """
    langs = e.shape[1]
    p = np.exp(e - e.max(1, keepdims=True))
    a = np.exp(switch - switch.max())
    segs = -(-lens // segment)
    text = np.repeat(np.arange(len(lens)), segs)
    first = np.cumsum(segs) - segs
    nth = np.arange(len(text)) - first[text]
    begin = (np.cumsum(lens) - lens)[text] + nth * segment
    size = np.minimum(segment, lens[text] - nth * segment)
    # whole segments stand first in this order, so that a step takes a prefix
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    live = [int(np.searchsorted(-size, -t, "left")) for t in range(segment)]  # those longer than t
    m = np.broadcast_to(np.eye(langs), (len(size), langs, langs)).copy()
    for t in range(segment):
        n = live[t]
        if not n:
            break
        x = (m[:n].reshape(-1, langs) @ a).reshape(n, langs, langs) * p[begin[:n] + t][:, None, :]
        m[:n] = x / x.max((1, 2), keepdims=True)
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    # what comes into each segment from before and from behind, text by text
    into, back = np.empty((len(size), langs)), np.empty((len(size), langs))
    by_segs = np.argsort(-segs, kind="stable")
    counts = segs[by_segs]
    f, g = np.full((len(lens), langs), 1.0 / langs), np.ones((len(lens), langs))
    for j in range(int(segs.max())):
        n = int(np.searchsorted(-counts, -j, "left"))
        own = by_segs[:n]
        at = where[first[own] + j]
        into[at] = f[own]
        f[own] = np.einsum("nl,nlk->nk", f[own], m[at])
        f[own] /= f[own].sum(1, keepdims=True)
        at = where[first[own] + segs[own] - 1 - j]
        back[at] = g[own]
        g[own] = np.einsum("nlk,nk->nl", m[at], g[own])
        g[own] /= g[own].sum(1, keepdims=True)
    alpha = np.empty((segment, len(size), langs))
    f = into
    for t in range(segment):
        n = live[t]
        f[:n] = (f[:n] @ a) * p[begin[:n] + t]
        f[:n] /= f[:n].sum(1, keepdims=True)
        alpha[t, :n] = f[:n]
    total, beta = np.zeros((len(size), langs)), back
    for t in range(segment - 1, -1, -1):
        n = live[t]
        x = alpha[t, :n] * beta[:n]
        total[:n] += x / x.sum(1, keepdims=True)
        beta[:n] = (p[begin[:n] + t] * beta[:n]) @ a.T
        beta[:n] /= beta[:n].sum(1, keepdims=True)
    return np.stack([np.bincount(text[order], total[:, k], len(lens)) for k in range(langs)], 1)


def _labeller(model: Model):
    """A function, built in the task, from texts to (languages, scores)."""
    index: dict[bytes, int] = {}
    table = [np.empty((0, len(model.languages)))]

    def emissions(texts: list[list[bytes]]) -> np.ndarray:
        if len(index) > _HELD:
            index.clear()
            table[0] = table[0][:0]
        new = [*set().union(*texts).difference(index)]
        if new:
            index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
            table[0] = np.concatenate([table[0], model.emissions(new)])
        return table[0][np.fromiter((index[w] for t in texts for w in t), np.int64, sum(map(len, texts)))]

    def label(texts: list) -> tuple[list, list]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not model.languages:
            return names, scores
        words = [words_of(t) for t in texts]
        own = [i for i, w in enumerate(words) if w and has_letter(texts[i])]
        at = 0
        while at < len(own):
            end, total = at, 0
            while end < len(own) and (end == at or total + len(words[own[end]]) <= _WORDS):
                total += len(words[own[end]])
                end += 1
            some = [words[i] for i in own[at:end]]
            lens = np.fromiter(map(len, some), np.int64, len(some))
            share = expected(emissions(some), lens, model.switch) / lens[:, None]
            best = share.argmax(1)
            for i, b, s in zip(own[at:end], best.tolist(), share.max(1).tolist(), strict=True):
                names[i], scores[i] = model.languages[b], min(1.0, s)
            at = end
        return names, scores

    return label


_TEXTS = 1000


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        label = _labeller(sent.value)
        for batch in sliced(batches, of="text"):
            names, scores = [], []
            texts = text_bytes(batch.column("text"))
            for i in range(0, len(texts), _TEXTS):
                a, b = label(texts[i : i + _TEXTS])
                names += a
                scores += b
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from those of ``identify``."""
    held = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
