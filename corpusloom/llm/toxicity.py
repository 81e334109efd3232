"""Toxicity by class-conditional Kneser-Ney models of words.

Two models spell words byte by byte, one for toxic and one for ordinary documents: each
predicts the next byte from the whole beginning of the word,

    P_class(c | beginning) = (max(n - D, 0) + D * T * P_shared(c | last bytes)) / N,

with n, N and T the class's counts of the continued beginning, of the beginning and of its
different continuations.  What the discount D frees goes to a backoff that both classes
share: a Kneser-Ney model over the word types of both, by their last bytes.  So a rare
expression that only one class has seen is weighed against how likely it is to be spelled at
all, and where neither has seen the beginning both give the same and the rest of the word
says nothing.

A toxic document says most things as any other does, so its words come from a mixture: with
probability 1 - MIX the ordinary model, with MIX the toxic one.  A document's evidence is the
difference of its log-likelihoods as a toxic and as an ordinary document, normalised by its
length in words:

    1 / n * sum over its words of  ln(1 - MIX + MIX * exp(r)),   r = ln P_toxic - ln P_ordinary

Nothing is clipped; the plain difference (MIX = 1) is drowned by the noise of ordinary words
(figures in the README).  A logistic function that is fitted on labelled documents which the
counts have not seen turns the evidence into a score from 0 to 1; MIX is that of ``MIXES`` under
which these documents' labels are likeliest.

Counts are numbers of documents that hold a word, over all labelled rows of the training
folds; every beginning that either class has seen is in the model.  MIX and the logistic function
are fitted on at most ``CALIBRATION`` labelled rows of a fold of their own.

Scale: word types and their beginnings are counted by partial aggregations; the labels are
broadcast only while their counted number is within the bound, else both tables are shuffled
by id.  The model is a table.  While it has at most ``MODEL_ROWS`` rows it is broadcast, and
scoring is one pass over the documents without a shuffle; beyond that the distinct words of
the corpus are joined with the model and the texts with the words.  Both ways give the same.

Edge cases: a null, empty or wordless text has no evidence and gets the score of zero evidence.
Null labels and labels of null ids are not used; a doc_id that several labels name is toxic
if any says so.  Repeated rows count several times.  Empty tables, or labels of one class
only, give everyone the share of toxic labels (0 without labels).  Only the named columns are
read; ``drop_toxic`` keeps all columns of its input.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import broadcast_if_small, column, filtered, fold_of, materialize, sliced, temporary, text_bytes

FOLDS, HELD_OUT, CALIBRATE = 5, 0, 4
DISCOUNT, SHARED_DISCOUNT = 0.9, 0.75
#: Bytes that the shared backoff looks back.
BACK = 4
#: Shares of the words of a toxic document that the toxic model may say; the calibration chooses one.
MIXES = (0.0003, 0.001, 0.003, 0.01, 0.03, 0.1, 0.3)
#: Rows of the model (continuations of beginnings) that are broadcast at most: 16 bytes each.
MODEL_ROWS = 6_000_000
CALIBRATION = 20_000
#: Longer words are read in pieces of so many bytes.
PIECE = 48
#: Word types that a task holds before it passes their counts on, or forgets their ratios.
_HELD = 100_000

_BEGIN, _END = 1, 2
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text: runs of letters (A-Z lower-cased), long ones in pieces."""
    words = (text or b"").translate(_WORD_BYTES).split()
    if any(len(w) > PIECE for w in words):
        words = [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]
    return words


def _next(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The hash of a beginning with one more byte."""
    x = (h ^ byte.astype(np.uint64)) * _STEP
    return x ^ (x >> np.uint64(29))


def _spelled(words: list[bytes]):
    """For each place: rows of ``words``, hashes of the beginning before and after it, and
    the code of the last bytes with it (with the number of bytes before it on top)."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.zeros((len(words), (int(lens.max()) if len(words) else 0) + 1), np.uint8)
    flat = np.frombuffer(b"".join(words), np.uint8)
    row = np.repeat(np.arange(len(words)), lens)
    letters[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    letters[np.arange(len(words)), lens] = _END
    rows = np.arange(len(words))
    h = np.full(len(words), _BEGIN, np.uint64)
    code = np.full(len(words), _BEGIN, np.int64)
    for k in range(letters.shape[1]):
        rows = rows[lens[rows] >= k] if k else rows
        byte = letters[rows, k]
        after = _next(h[rows], byte)
        code[rows] = ((code[rows] << 8) | byte) & ((1 << 8 * (BACK + 1)) - 1)
        yield rows, h[rows], after, code[rows] | (min(k + 1, BACK) << 8 * (BACK + 1))
        h[rows] = after


def _word_types(train: DataFrame) -> DataFrame:
    """(word, ordinary, toxic): documents of each class that hold the word."""

    def count(batches):
        n: dict[bytes, list] = {}

        def rows():
            both = np.array([*n.values()], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array([*n.keys()], pa.binary()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["word", "ordinary", "toxic"])

        for batch in sliced(batches):
            for text, toxic in zip(text_bytes(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                for w in set(words_of(text)):
                    if w in n:
                        n[w][toxic] += 1
                    else:
                        n[w] = [1 - toxic, toxic]
                if len(n) > _HELD:
                    yield rows()
                    n.clear()
        yield rows()

    counts = train.mapInArrow(count, "word binary, ordinary long, toxic long")
    return counts.groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _gathered(batches, emit):
    """Run ``emit`` over the words and counts of several batches at once."""
    words, ordinary, toxic = [], [], []
    for batch in batches:
        words += batch.column("word").to_pylist()
        ordinary.append(batch.column("ordinary").to_numpy())
        toxic.append(batch.column("toxic").to_numpy())
        if len(words) > _HELD // 2:
            yield emit(words, np.concatenate(ordinary), np.concatenate(toxic))
            words, ordinary, toxic = [], [], []
    if words:
        yield emit(words, np.concatenate(ordinary), np.concatenate(toxic))


def _added(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list, list]:
    """Sums of the values by the combined keys."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return [k[at] for k in keys], [np.add.reduceat(v[order], at) if len(at) else v for v in values]


def _shared(types: DataFrame) -> DataFrame:
    """(code, p): the shared backoff's probability of a byte after the last ones."""

    def emit(words, _ordinary, _toxic):
        code = np.concatenate([c for *_, c in _spelled(words)])
        (key,), (n,) = _added([code], [np.ones(len(code), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["code", "n"])

    top = materialize(types.mapInArrow(lambda b: _gathered(b, emit), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "spellings")
    bits = 8 * (BACK + 1)
    order, letters = F.shiftright("code", bits), F.col("code").bitwiseAND((1 << bits) - 1)
    below, out = None, None
    for o in range(BACK + 1):
        own = top.where(order >= o).groupBy(letters.bitwiseAND((1 << 8 * (o + 1)) - 1).alias("g")).agg(F.sum("n").alias("n"))
        by = Window.partitionBy(F.shiftright("g", 8))
        own = own.withColumns({"all": F.sum("n").over(by), "kinds": F.count("*").over(by)})
        lower = F.lit(1 / 256.0)
        if below is not None:
            own = own.join(below.select(F.col("g").alias("s"), F.col("p").alias("lower")), F.col("g").bitwiseAND((1 << 8 * o) - 1) == F.col("s"))
            lower = F.col("lower")
        p = (F.greatest(F.col("n") - SHARED_DISCOUNT, F.lit(0.0)) + SHARED_DISCOUNT * F.col("kinds") * lower) / F.col("all")
        below = materialize(own.select("g", p.alias("p")), "backoff")
        starts = F.shiftright("g", 8 * o) == _BEGIN  # shorter ones only at a word's begin
        part = below.where(starts) if o < BACK else below
        part = part.select(F.col("g").bitwiseOR(F.lit(o << bits).cast("long")).alias("code"), "p")
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class Model:
    """Log-ratios of continuations and backoffs, and the logistic function.

    ``nodes`` (ctx, key, r, b): for the hash of a beginning and of it with one more byte the
    log-ratio, and what it is for bytes that have no row.  ``arrays`` has the same if it is small
    enough: sorted keys with their ratios and, where a key is a beginning of more, what its
    unknown bytes give; the same of the empty beginning; and where the keys of each first bits start.
    """

    nodes: DataFrame
    arrays: tuple[np.ndarray, ...] | None
    slope: float = 0.0
    base: float = -40.0
    mix: float = MIXES[0]
    _sent: Broadcast | None = field(default=None, repr=False)

    def sent(self) -> Broadcast:
        """The arrays, broadcast once for fitting and scoring."""
        if self._sent is None:
            self._sent = self.nodes.sparkSession.sparkContext.broadcast(self.arrays)
        return self._sent

    def odds(self, evidence: Column) -> Column:
        x = F.lit(self.base) + F.lit(self.slope) * F.ln(evidence + 2 * self.mix)
        return F.greatest(F.least(x, F.lit(40.0)), F.lit(-40.0))


#: Rows of the model that come to the driver at once.
_SLICE = 500_000


def _arrays(nodes: DataFrame, rows: int) -> tuple[np.ndarray, ...]:
    """``Model.arrays`` of the model's rows, which come in slices of the range of keys."""
    begins = nodes.select(F.col("ctx").alias("c"), "b").distinct()
    joined = nodes.select("key", "r").join(begins, F.col("key") == F.col("c"), "left").select("key", "r", F.coalesce("b", F.lit(0.0)).cast("float").alias("b"))
    own = materialize(joined, "model-rows")
    cuts = np.linspace(-(2.0**63), 2.0**63, max(1, -(-rows // _SLICE)) + 1)[1:-1].astype(np.int64).tolist()
    parts = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        some = own if low is None else own.where(F.col("key") >= low)
        got = (some if high is None else some.where(F.col("key") < high)).toArrow()
        order = np.argsort(got.column("key").to_numpy())
        parts.append([got.column(c).to_numpy()[order] for c in ("key", "r", "b")])
    keys, ratios, backs = (np.concatenate(x) for x in zip(*parts, strict=True))
    first = begins.where(F.col("c") == _BEGIN).select("b").collect()
    bits = min(22, max(4, len(keys).bit_length()))
    places = np.searchsorted(keys >> (64 - bits), np.arange(-(1 << bits - 1), (1 << bits - 1) + 1)).astype(np.int32)
    return keys, ratios, backs, np.array([r["b"] for r in first] or [0.0], np.float32), places


def _places(wanted: np.ndarray, keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Where the ``wanted`` stand among the sorted ``keys``, -1 if they don't; the keys of each beginning of
    bits start at its place."""
    bits = len(places).bit_length() - 1
    prefix = (wanted >> (64 - bits)) + (1 << bits - 1)
    at, end = places[prefix], places[prefix + 1]
    out, open_ = np.full(len(wanted), -1, np.int32), np.flatnonzero(at < end)
    while len(open_):
        here, mine = at[open_], wanted[open_]
        key = keys[here]
        met = key == mine
        out[open_[met]] = here[met]
        open_ = open_[(key < mine) & (here + 1 < end[open_])]
        at[open_] += 1
    return out


def ratios_of(words: list[bytes], arrays: tuple[np.ndarray, ...]) -> np.ndarray:
    """The log-likelihood ratio of each word.

    From the first byte on that no class has seen after its beginning both models spell alike.
    """
    keys, ratios, backs, start, places = arrays
    out = np.zeros(len(words))
    if not len(keys):
        return out
    on, unknown = np.ones(len(words), bool), np.full(len(words), start[0], np.float32)
    for rows, _, after, _ in _spelled(words):
        use = on[rows]
        rows, after = rows[use], after[use].view(np.int64)
        if not len(rows):
            break
        k = _places(after, keys, places)
        found = k >= 0
        out[rows] += np.where(found, ratios[k], unknown[rows])
        on[rows[~found]] = False
        unknown[rows] = backs[k]
    return out


def _said(ratios: np.ndarray, mix: float) -> np.ndarray:
    """What a word with a log-ratio adds to the evidence."""
    return np.log1p(mix * np.expm1(ratios))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, toxic, fold) of the labelled documents outside the held-out fold."""
    fold = fold_of(F.col("d"), FOLDS)
    marks = labels.select(column(id_col).alias("d"), column(label_col).cast("int").alias("toxic")).where("d is not null and toxic in (0, 1)")
    marks = marks.groupBy("d").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold).where(F.col("fold") != HELD_OUT)
    own = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    return own.join(broadcast_if_small(marks, marks.count()), F.col("id") == F.col("d")).select("text", "toxic", "fold")


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", calibration: int = CALIBRATION, model_rows: int = MODEL_ROWS) -> Model:
    """Learn from the labelled rows outside the held-out fold."""
    with temporary(docs.sparkSession):
        return _fit(docs, labels, id_col, text_col, label_col, calibration, model_rows)


def _fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, calibration: int, model_rows: int) -> Model:
    known = _labelled(docs, labels, id_col, text_col, label_col)
    types = materialize(_word_types(known.where(F.col("fold") != CALIBRATE).select("text", "toxic")), "word-types")

    def emit(words, ordinary, toxic):
        parts = [(before.view(np.int64), after.view(np.int64), code, ordinary[rows], toxic[rows]) for rows, before, after, code in _spelled(words)]
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
        keys, sums = _added(cols[:3], cols[3:])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*keys, *sums)], ["ctx", "key", "code", "ordinary", "toxic"])

    nodes = types.mapInArrow(lambda b: _gathered(b, emit), "ctx long, key long, code long, ordinary long, toxic long")
    nodes = nodes.groupBy("ctx", "key", "code").agg(F.sum("ordinary").alias("o"), F.sum("toxic").alias("t"))
    nodes = nodes.join(_shared(types).withColumnRenamed("code", "c"), F.col("code") == F.col("c"))
    by = Window.partitionBy("ctx")
    total = {f"{n}_{c}": (F.sum(c) if n == "all" else F.sum((F.col(c) > 0).cast("int"))).over(by) for c in ("o", "t") for n in ("all", "kinds")}
    nodes = nodes.withColumns(total)

    def freed(c):
        return F.least(DISCOUNT * F.col(f"kinds_{c}"), F.col(f"all_{c}")) / F.col(f"all_{c}")

    def p(c):
        own = F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"all_{c}") + freed(c) * F.col("p")
        return F.when(F.col(f"all_{c}") > 0, own).otherwise(F.col("p"))

    back = F.when(F.col("all_t") > 0, F.ln(freed("t"))).otherwise(0.0) - F.when(F.col("all_o") > 0, F.ln(freed("o"))).otherwise(0.0)
    nodes = materialize(nodes.select("ctx", "key", F.ln(p("t") / p("o")).cast("float").alias("r"), back.cast("float").alias("b")), "toxicity-model", keep=True)
    count = nodes.count()
    model = Model(nodes, _arrays(nodes, count) if count <= model_rows else None)
    sample = known.where(F.col("fold") == CALIBRATE).select("toxic", "text")
    rows = _evidence(sample, model, MIXES).orderBy(F.xxhash64("toxic", "e0", f"e{len(MIXES) - 1}")).limit(calibration).toArrow()
    fits = [(*_logistic(rows.column(f"e{k}").to_numpy(), rows.column("toxic").to_numpy(), mix), mix) for k, mix in enumerate(MIXES)]
    _, model.base, model.slope, model.mix = min(fits)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, mix: float) -> tuple[float, float, float]:
    """Loss, base and slope over log(x + 2 * mix), by Newton's method with a weak prior."""
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return 0.0, (-40.0 if share == 0 else 40.0), 0.0
    f = np.stack([np.ones(len(x)), np.log(x + 2 * mix)], 1)
    prior = np.array([0.0, 0.02])

    def loss(w):
        z = f @ w
        return np.logaddexp(0, z).sum() - (y * z).sum() + (prior * w * w).sum() / 2

    w = np.array([math.log(share / (1 - share)), 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        grad = f.T @ (p - y) + prior * w
        hess = (f * (p * (1 - p))[:, None]).T @ f + np.diag(prior + 1e-6)
        step, scale = np.linalg.solve(hess, grad), 1.0
        while scale > 1e-6 and loss(w - scale * step) > loss(w):
            scale /= 2
        w = w - scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    if w[1] < 0:  # evidence that speaks against itself says nothing
        w = np.array([math.log(share / (1 - share)), 0.0])
    return float(loss(w)), float(w[0]), float(w[1])


def _weigher(arrays: tuple[np.ndarray, ...], mix: float):
    """A function, built in the task, from texts to their evidence."""
    cache: dict[bytes, float] = {}

    def weigh(texts: list) -> np.ndarray:
        words = [words_of(t) for t in texts]
        if len(cache) > _HELD:
            cache.clear()
        new = [*set().union(*words).difference(cache)]
        if new:
            cache.update(zip(new, _said(ratios_of(new, arrays), mix).tolist(), strict=True))
        return np.array([sum(map(cache.__getitem__, w)) / len(w) if w else 0.0 for w in words])

    return weigh


def _word_ratios(words: DataFrame, model: Model) -> DataFrame:
    """(word, ratio) of each of the distinct ``words``, by a join of their beginnings with the model."""

    def spell(batches):
        for batch in sliced(batches, rows=20_000):
            own = batch.column("word").to_pylist()
            for rows, before, after, _ in _spelled(own):
                yield pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(rows)), pa.array(before.view(np.int64)), pa.array(after.view(np.int64))], ["word", "before", "after"])

    places = words.mapInArrow(spell, "word binary, before long, after long")
    contexts = model.nodes.groupBy(F.col("ctx").alias("c")).agg(F.first("b").alias("back"))
    seen = model.nodes.select(F.col("key").alias("k"), "r")
    # beginnings of a known beginning are known, so each word's known places are its first ones
    rows = places.join(contexts, F.col("before") == F.col("c")).join(seen, F.col("after") == F.col("k"), "left")
    return rows.groupBy("word").agg(F.sum(F.coalesce("r", "back").cast("double")).alias("ratio"))


def _evidence_by_joins(rows: DataFrame, model: Model, mixes: tuple[float, ...]) -> DataFrame:
    """The other columns of ``rows`` and ``e0`` and so on, the evidence of ``text`` for each of ``mixes``,
    for a model that is not broadcast.  Equal texts are weighed once."""
    text = F.coalesce("text", F.lit(""))
    hashes = {"__t": F.xxhash64(text), "__u": F.xxhash64(F.lit(1), text)}
    ident = ("__t", "__u")

    def split(batches):
        for batch in sliced(batches, of="text"):
            at, word, n = [], [], []
            for i, t in enumerate(text_bytes(batch.column("text"))):
                counts = Counter(words_of(t))
                at += [i] * len(counts)
                word += counts.keys()
                n += counts.values()
            own = [batch.column(c).take(pa.array(at, pa.int64())) for c in ident]
            yield pa.RecordBatch.from_arrays([*own, pa.array(word, pa.binary()), pa.array(n, pa.int64())], [*ident, "word", "n"])

    held = rows.select("text").withColumns(hashes).mapInArrow(split, "__t long, __u long, word binary, n long")
    held = materialize(held.groupBy(*ident, "word").agg(F.max("n").alias("n")), "toxicity-words")
    said = _word_ratios(held.select("word").distinct(), model).withColumnRenamed("word", "w")
    sums = [(F.sum(F.col("n") * F.log1p(mix * F.expm1(F.coalesce("ratio", F.lit(0.0))))) / F.sum("n")).alias(f"e{k}") for k, mix in enumerate(mixes)]
    per = held.join(said, F.col("word") == F.col("w"), "left").groupBy(*ident).agg(*sums)
    per = materialize(per.withColumnsRenamed({"__t": "__a", "__u": "__b"}), "toxicity-texts")
    named = rows.withColumns(hashes).drop("text")
    both = named.join(per, (F.col("__t") == F.col("__a")) & (F.col("__u") == F.col("__b")), "left")
    return both.select(*[column(c) for c in rows.columns if c != "text"], *[F.coalesce(f"e{k}", F.lit(0.0)).alias(f"e{k}") for k in range(len(mixes))])


def _evidence(rows: DataFrame, model: Model, mixes: tuple[float, ...]) -> DataFrame:
    """The other columns of ``rows`` and ``e0`` and so on, the evidence of ``text`` for each of ``mixes``."""
    if model.arrays is None:
        return _evidence_by_joins(rows, model, mixes)
    sent = model.sent()
    others, new = [c for c in rows.columns if c != "text"], [f"e{k}" for k in range(len(mixes))]
    kind = ", ".join([*[f"{c} {rows.schema[c].dataType.simpleString()}" for c in others], *[f"{c} double" for c in new]])

    def run(batches):
        weighers = [_weigher(sent.value, mix) for mix in mixes]
        for batch in sliced(batches, of="text"):
            texts = text_bytes(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], *[pa.array(weigh(texts)) for weigh in weighers]], [*others, *new])

    return rows.mapInArrow(run, kind)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, evidence, score) of every document."""
    rows = _evidence(docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")), model, (model.mix,)).withColumnRenamed("e0", "evidence")
    return rows.withColumn("score", 1 / (1 + F.exp(-model.odds(F.col("evidence")))))


def digest(scored: DataFrame) -> DataFrame:
    """The contract's columns from those of ``score``."""
    held = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The documents with a score under 0.5, with all their columns."""
    if model.arrays is None:
        whole = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("doc"), column(text_col).alias("text"))
        rows = _evidence(whole, model, (model.mix,)).where(model.odds(F.col("e0")) < 0)
        return rows.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
    sent = model.sent()
    base, slope, mix = model.base, model.slope, model.mix

    def keep(batches):
        weigh = _weigher(sent.value, mix)
        for batch in sliced(batches, of="text"):
            evidence = weigh(text_bytes(batch.column("text")))
            yield batch.filter(pa.array(base + slope * np.log(evidence + 2 * mix) < 0))

    return filtered(docs, text_col, keep)
