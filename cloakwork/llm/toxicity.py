"""Toxicity by class-conditional Kneser-Ney models of words, spelled character by character.

A class gives a word the product of its characters' probabilities after what was spelled
before them, and the end's.  A beginning that the class has seen `n` times has its counts
discounted by modified Kneser-Ney (three discounts from the counts of counts of the class),
and what that sets free goes to counts that both classes share: in how many distinct words a
beginning goes on so, discounted likewise and smoothed by equal shares.  So a rare word, or
one never seen, is judged by the stem it has in common with others, and where neither class
knows more the shared counts cancel.  All counts are continuation counts (in how many
contexts of two words a word occurs), so a text copied a thousand times counts once.

A word of a toxic text comes from the toxic model with probability `rho`, else from the
ordinary one, as a toxic text is mostly ordinary words.  The difference of the two
log-likelihoods is divided by the number of words (and a few more, so that one word does
not decide on a text of two).  A logistic curve makes it a score; its middle is the cut at
which the two classes' shares of errors sum to least.  It is chosen by cross-fitting: each
labelled text is judged by the model of the other `FOLDS - 1` folds, so all serve both.

Bounded: the models are fitted on at most `sample` labelled documents per class, chosen
by a hash of the id, whole texts.  Beginnings that these hold `LEAST` times are collected;
rarer ones are smoothed away.  What is broadcast to score all texts leaves out beginnings
that tell nothing their stem doesn't tell.

Defined results: null and empty texts have no evidence and score what that means under
the curve (0 if nothing could be learned); labels that are null or not 0 or 1, and ids
that are null or have no document, teach nothing; an id labelled both ways counts as
toxic; without toxic or without ordinary examples all texts score 0 or 1 accordingly;
repeated rows give repeated results; other columns are kept, those named like an
output are replaced.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.shared import smallest_by_hash, staged, with_struct

SAMPLE = 4_000
RHO = 0.02
#: Words added to a text's length.
LENGTH_PRIOR = 20
#: The least hash of a text's three-word shingles is its fold, so near copies mostly share one.
FOLDS, SHINGLE = 3, 3
#: Words are told apart by so many characters; beginnings seen less than LEAST times are not kept.
LONGEST, LEAST = 16, 2
END = " "
#: Beginnings after which all words give the same evidence, to this, are kept as one.
SAME = 0.005
#: Words whose evidence a worker keeps at a time, and texts that it has as strings.
MOST_VALUES, TEXTS_AT_ONCE, CONTEXTS_OF = 100_000, 256, 64

WORD = re.compile(r"\w+")
CLASSES = (0, 1)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def discounts(counts: list[int]) -> np.ndarray:
    """What is taken off counts 0, 1, 2, and 3 or more, given how many there are of 1 to 4."""
    n = [max(1, c) for c in counts]
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))])


def _numbered(names: pa.Array) -> dict[str, int]:
    return dict(zip(names.to_pylist(), range(len(names))))


class Numbers(Mapping):
    """A number for each beginning, from 0 in order.

    The driver, which looks up none, holds one Arrow array; a worker gets a dict.
    """

    def __init__(self, names: pa.Array) -> None:
        self.names = names

    def __reduce__(self):
        return _numbered, (self.names,)

    @functools.cached_property
    def _found(self) -> dict[str, int]:
        return _numbered(self.names)

    def __getitem__(self, beginning: str) -> int:
        return self._found[beginning]

    def __iter__(self) -> Iterator[str]:
        return iter(self._found)

    def __len__(self) -> int:
        return len(self.names)


def _parents(names: pa.Array) -> np.ndarray:
    """For each beginning the number of that without its last character; the empty one's own."""
    return pc.index_in(pc.utf8_slice_codeunits(names, 0, -1), names).to_numpy().astype(np.int64)


@dataclass
class Model:
    """By beginning: the log-ratio of the classes up to there, and of going on as neither has.

    Models may share the numbers; a beginning that one doesn't have is NaN there.
    """

    numbers: Mapping[str, int]
    upto: np.ndarray
    leaving: np.ndarray
    rho: float = RHO
    values: dict[str, float] = field(default_factory=dict, repr=False)

    def ratio(self, word: str) -> float:
        """Log-likelihood of the word in toxic text over that in ordinary text."""
        spelled = word[:LONGEST] + END
        for known in range(len(spelled), -1, -1):
            at = self.numbers.get(spelled[:known])
            if at is not None and self.upto[at] == self.upto[at]:
                return float(self.upto[at] + (self.leaving[at] if known < len(spelled) else 0.0))
        return 0.0

    def compact(self, same: float = SAME) -> Model:
        """The model without beginnings below one whose words all give the same evidence."""
        names = self.numbers.names if isinstance(self.numbers, Numbers) else pa.array(self.numbers, pa.string())
        whole = pc.ends_with(names, END).to_numpy(zero_copy_only=False)
        value = np.log1p(self.rho * np.expm1(np.minimum(self.upto + np.where(whole, 0, self.leaving), 50.0)))
        parent = _parents(names)
        low, high = value.copy(), value.copy()
        lengths = pc.utf8_length(names).to_numpy()
        for length in range(lengths.max(), 0, -1):
            own = np.flatnonzero(lengths == length)
            np.minimum.at(low, parent[own], low[own])
            np.maximum.at(high, parent[own], high[own])
        kept = np.flatnonzero((high - low)[parent] >= same)
        kept = np.union1d(kept, [0])
        return Model(Numbers(names.take(pa.array(kept))), self.upto[kept], self.leaving[kept], self.rho)

    def value(self, word: str) -> float:
        found = self.values.get(word)
        if found is None:
            if len(self.values) >= MOST_VALUES:
                self.values.clear()
            found = self.values[word] = math.log1p(self.rho * math.expm1(min(self.ratio(word), 50.0)))
        return found

    def difference(self, text: str | None) -> float:
        """Toxic minus ordinary log-likelihood over the text's length."""
        own = words(text)
        return sum(map(self.value, own)) / (len(own) + LENGTH_PRIOR)


@dataclass
class Scorer:
    model: Model | None
    cut: float
    slope: float
    constant: float = 0.0

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), self.constant)
        found = np.array([self.model.difference(t) for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(self.slope * (found - self.cut), -30, 30)))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (label, fold, the two words before as a number, word) of some texts at a time."""
    for batch in batches:
        for part in (batch.slice(k, CONTEXTS_OF) for k in range(0, batch.num_rows, CONTEXTS_OF)):
            seen: set[tuple] = set()
            for label, fold, text in zip(*(c.to_pylist() for c in part.columns)):
                own = words(text)
                before = [xxhash.xxh64_intdigest(f"{u} {v}") >> 1 for u, v in zip(["", "", *own], ["", *own])]
                seen.update(zip([label] * len(own), [fold] * len(own), before, own))
            if seen:
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string())
                arrays = [pa.array(c, kind) for c, kind in zip(zip(*seen), kinds)]
                yield pa.RecordBatch.from_arrays(arrays, ["label", "fold", "before", "w"])


def fold_of(text: str | None) -> int:
    own = words(text)
    shingles = (" ".join(own[i : i + SHINGLE]) for i in range(max(1, len(own) - SHINGLE + 1)))
    return min(zlib.crc32(s.encode()) for s in shingles) % FOLDS


def _folds(texts: pa.Array) -> pa.Array:
    return pa.array([fold_of(t) for t in texts.to_pylist()], pa.int32())


def _beginnings(sample: DataFrame) -> DataFrame:
    """A row per beginning of a word, the empty one too: counts `c` by class and fold, and `t`, distinct words.

    `t` has an entry for each fold left out, and one for all.
    """
    contexts = sample.select("label", "fold", "text").mapInArrow(_contexts, "label int, fold int, before bigint, w string")
    parts = [(c, k) for c in CLASSES for k in range(FOLDS)]
    counted = contexts.distinct().groupBy("w").agg(
        *(F.count_if((F.col("label") == c) & (F.col("fold") == k)).alias(f"c{c}_{k}") for c, k in parts)
    )
    spelled = F.concat(F.substring("w", 1, LONGEST), F.lit(END))
    beginnings = F.transform(F.sequence(F.lit(0), F.length(spelled)), lambda n: F.substr(spelled, F.lit(1), n))
    without = [functools.reduce(lambda a, b: a + b, (F.col(f"c{c}_{j}") for c, j in parts if j != k)) for k in range(FOLDS + 1)]
    return (
        counted.select(*(f"c{c}_{k}" for c, k in parts), *(w.alias(f"w_{k}") for k, w in enumerate(without)), F.explode(beginnings).alias("beginning"))
        .groupBy("beginning")
        .agg(*(F.sum(f"c{c}_{k}").alias(f"c{c}_{k}") for c, k in parts), *(F.count_if(F.col(f"w_{k}") > 0).alias(f"t_{k}") for k in range(FOLDS + 1)))
    )


def _models(sample: DataFrame, rho: float) -> list[Model]:
    """The models without each fold, and that of all; none where a class has no word.

    The driver holds the counts by class and fold, and those of one model at a time.
    """
    rows = staged(_beginnings(sample), "toxicity-beginnings")
    parts = [[f"c{c}_{k}" for k in range(FOLDS)] for c in CLASSES]
    counts = [
        [functools.reduce(lambda a, b: a + b, (F.col(own[j]) for j in range(FOLDS) if j != k)) for own in parts]
        + [F.col(f"t_{k}")]
        for k in range(FOLDS + 1)
    ]
    both = counts[FOLDS][0] + counts[FOLDS][1]
    letters, most, *of_counts = rows.where("beginning <> ''").agg(
        F.count_distinct(F.substring("beginning", -1, 1)),
        # The whole words' counts sum to those of the empty beginning, which has the most.
        F.sum(F.when(F.endswith("beginning", F.lit(END)), both)),
        *(F.count_if(counts[m][k] == n) for m in range(FOLDS + 1) for k in range(3) for n in (1, 2, 3, 4)),
    ).first()
    kept = rows.where((both >= LEAST) | (F.col("beginning") == ""))
    kind = "int" if (most or 0) < 1 << 31 else "long"
    columns = [*parts[0], *parts[1], *(f"t_{k}" for k in range(FOLDS + 1))]
    table = kept.select("beginning", *(F.col(c).cast(kind).alias(c) for c in columns)).toArrow()
    # In the order of length and then text, which has a beginning after what it goes on from.
    sizes = pc.utf8_length(table["beginning"])
    order = pc.sort_indices(pa.table([sizes, table["beginning"]], ["size", "beginning"]), [("size", "ascending"), ("beginning", "ascending")])
    sizes = pc.take(sizes, order).to_numpy()
    names = pc.take(table["beginning"], order).combine_chunks()
    table = table.drop_columns("beginning")
    seen = {}
    for column in columns:
        seen[column] = pc.take(table[column], order).to_numpy()
        table = table.drop_columns(column)
    del table, order
    if not len(names) or not all(sum(int(seen[c][0]) for c in own) for own in parts):
        return []
    numbers, parent = Numbers(names), _parents(names)
    ends = np.flatnonzero(np.diff(sizes, append=-1)) + 1
    by_length = list(zip([1, *ends[1:-1].tolist()], ends[1:].tolist()))
    least = np.array(of_counts).reshape(FOLDS + 1, 3, 4)
    models = []
    for m in range(FOLDS + 1):
        x = np.empty((3, len(parent)), np.int64)
        for k, own in enumerate([*([c[j] for j in range(FOLDS) if j != m] for c in parts), [f"t_{m}"]]):
            x[k] = seen[own[0]]
            for c in own[1:]:
                x[k] += seen[c]
        known = x[0] + x[1] >= LEAST
        known[0] = True
        upto, leaving = _ratios(x, known, parent, by_length, [discounts(row.tolist()) for row in least[m]], letters)
        models.append(Model(numbers, np.where(known, upto, np.nan).astype(np.float32), leaving.astype(np.float32), rho))
    return models


def _ratios(x, known, parent, by_length, taken_off, letters) -> tuple[np.ndarray, np.ndarray]:
    """For each beginning the log-ratio up to there and that of what is set free after it.

    Counts that both classes share come last in `x` and are worked out first.
    """

    def discounted(k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a row of counts, the share that each beginning keeps, and what is set free after it."""
        own = np.where(known, np.maximum(x[k] - taken_off[k][np.minimum(x[k], 3)], 0), 0)
        own[0] = 0
        free = np.bincount(parent[1:], weights=own[1:], minlength=len(parent))
        np.subtract(x[k], free, out=free)
        free /= np.maximum(x[k], 1)
        np.maximum(free, 1e-9, out=free)
        free[x[k] <= 0] = 1.0
        own /= np.maximum(x[k, parent], 1)
        return own, free

    shared, free = discounted(2)
    shared += free[parent] / max(1, letters)
    step, free_toxic = discounted(1)
    step += free_toxic[parent] * shared
    ordinary, leaving = discounted(0)
    shared *= leaving[parent]
    ordinary += shared
    step /= ordinary
    np.log(step, out=step)
    np.divide(free_toxic, leaving, out=leaving)
    np.log(leaving, out=leaving)
    upto = np.zeros(len(parent))
    for start, end in by_length:
        upto[start:end] = upto[parent[start:end]] + step[start:end]
    return upto, leaving


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = SAMPLE,
    rho: float = RHO,
) -> Scorer:
    """A scorer from the documents that `labels` (id, label) marks."""
    marked = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
    marked = marked.where(F.col("label").isin(0, 1) & F.col("id").isNotNull()).groupBy("id").agg(F.max("label").alias("label"))
    shares = {r.label: r["count"] for r in marked.groupBy("label").count().collect()}
    if len(shares) < 2:
        return Scorer(None, 0.0, 0.0, 1.0 if 1 in shares else 0.0)
    # Bounded by the sample size per class, so its ids may be broadcast.
    picked = F.broadcast(smallest_by_hash(marked, sample, "id", "label"))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(picked, "id")
    chosen = staged(texts.select("label", "text", F.arrow_udf(_folds, "int")("text").alias("fold")), "toxicity-sample")
    models = _models(chosen, rho)
    if not models:
        return Scorer(None, 0.0, 0.0, 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(models[:FOLDS])
    whole = models.pop()
    models.clear()

    def evidence(column: pa.Array, fold: pa.Array) -> pa.Array:
        held = zip(column.to_pylist(), fold.to_pylist())
        return pa.array([shared.value[k].difference(t) for t, k in held], pa.float64())

    judged = chosen.select("label", F.arrow_udf(evidence, "double")("text", "fold").alias("x")).toArrow()
    shared.destroy()
    x, y = (judged[c].to_numpy() for c in ("x", "label"))
    weight = np.where(y == 1, 1 / max(1, (y == 1).sum()), 1 / max(1, (y == 0).sum()))
    cut, _ = least_wrong_cut(x, y, weight)
    return Scorer(whole.compact(), cut, slope_at(x - cut, y, weight))


def least_wrong_cut(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """The value from which on a text is called toxic with the least weight of errors, and that weight.

    Of equal values the middle of the widest gap.
    """
    order = np.argsort(x, kind="stable")
    x, y, weight = x[order], y[order], weight[order]
    missed = np.concatenate([[0.0], np.cumsum(np.where(y == 1, weight, 0))])
    alarms = np.concatenate([np.cumsum(np.where(y == 0, weight, 0)[::-1])[::-1], [0.0]])
    wrong = missed + alarms
    low, high = np.concatenate([[x[0] - 1e-6], x]), np.concatenate([x, [x[-1] + 1e-6]])
    wrong = np.where((high > low) | (np.arange(len(wrong)) % len(x) == 0), wrong, np.inf)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    at = best[np.argmax((high - low)[best])]
    return float((low[at] + high[at]) / 2), float(wrong[at])


def slope_at(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The slope of the likeliest logistic curve through 1/2 at zero."""
    scale = np.abs(x).mean() + 1e-12
    slopes = np.geomspace(0.1, 100, 200) / scale
    signed = np.where(y == 1, x, -x)
    losses = [(weight * np.logaddexp(0, -s * signed)).sum() for s in slopes]
    return float(slopes[int(np.argmin(losses))])


def score(df: DataFrame, scorer: Scorer, text: str = "text", score_as: str = "score", predicted_as: str = "predicted") -> DataFrame:
    """The frame with the score of every whole text and whether it is 1/2 or more."""
    shared = df.sparkSession.sparkContext.broadcast(scorer)
    kind = pa.struct([("score", pa.float64()), ("predicted", pa.int32())])

    def scored(texts: pa.Array) -> pa.Array:
        parts = (texts.slice(k, TEXTS_AT_ONCE).to_pylist() for k in range(0, len(texts), TEXTS_AT_ONCE))
        s = np.concatenate([np.empty(0), *map(shared.value.scores, parts)])
        return pa.StructArray.from_arrays([pa.array(s), pa.array((s >= 0.5).astype(np.int32))], fields=list(kind))

    value = F.arrow_udf(scored, "struct<score:double,predicted:int>")(F.col(text))
    return with_struct(df, value, {"score": score_as, "predicted": predicted_as})
