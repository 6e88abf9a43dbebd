"""How demanding a document is to read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.session import materialise, ship

WORD = re.compile(r"[^\W_]+")
PAUSE = re.compile(r"(?<=[.!?])[\"')]*\s+|\n\s*\n")
#: Bands with the grades between which they lie. Fixed values.
BANDS = ("early", "middle", "upper", "expert")
EDGES = (3.5, 8.5, 13.5)
#: The places of the scale, in school grades, and the powers of them (about the middle of the scale) that difficulties weigh.
GRID = np.arange(1.0, 17.01, 0.5)
T = (GRID - 9.0) / 5.0
POWERS = np.vstack([np.ones_like(T), T, T * T])
COEF = ["c0", "c1", "c2"]
TALLY = "word long, n double, m1 double, m2 double"
#: Rows of a tally that count no word: -1 - i is place i of the scale, LIKELIHOOD the log-likelihood.
LIKELIHOOD = -1000


def sentence_units(docs: DataFrame, min_words: int, doc_id: str, text: str, most: int = 40) -> DataFrame:
    """(doc_id, words, sizes, lengths): the distinct words of every sentence as packed 32-bit hashes, and how many they and all words are.

    Sentences of more than `most` words count as several. Documents with fewer
    than min_words words are left out; numbers count as words of a text but say
    nothing about its level.
    """
    kind = dict(docs.dtypes)[doc_id]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        code: dict[str, int] = {}
        for batch in batches:
            rows = []
            if len(code) > 500_000:
                code.clear()
            for d, t in zip(batch["doc_id"], batch["text"]):
                words, sizes, lengths, n = [], [], [], 0
                for part in PAUSE.split(t.lower()):
                    found = WORD.findall(part)
                    n += len(found)
                    for at in range(0, len(found), most):
                        piece = found[at : at + most]
                        said = set()
                        for w in set(piece):
                            h = code.get(w)
                            if h is None:
                                h = code[w] = 0 if w.isdigit() else xxhash.xxh32_intdigest(w) | 1
                            if h:
                                said.add(h)
                        if said:
                            words += said
                            sizes.append(len(said))
                            lengths.append(len(piece))
                if n >= min_words:
                    rows.append((d, *(np.array(x, dtype=np.uint32).tobytes() for x in (words, sizes, lengths))))
            yield pd.DataFrame(rows, columns=["doc_id", "words", "sizes", "lengths"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.length("text") >= 2 * min_words - 1))
    return slim.mapInPandas(work, f"doc_id {kind}, words binary, sizes binary, lengths binary")


def unpacked(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all sentences of a batch, the sentence sizes and lengths, and the document row of each sentence."""
    words, sizes, lengths = (np.frombuffer(b"".join(batch[c]), dtype=np.uint32) for c in ("words", "sizes", "lengths"))
    doc = np.repeat(np.arange(len(batch)), [len(x) // 4 for x in batch["sizes"]])
    return words, sizes.astype(np.int64), lengths.astype(np.int64), doc


def near_grade(grade: np.ndarray, usual: np.ndarray, width: float = 1.5, trust: float = 0.7) -> np.ndarray:
    """The log chance of every place of the scale for a sentence of a document with a grade: around it, or with 1 - trust anywhere."""
    around = np.exp(-0.5 * ((GRID[None, :] - grade[:, None]) / width) ** 2)
    return np.log(trust * around / around.sum(axis=1, keepdims=True) + (1 - trust) * usual)


@dataclass
class Scale:
    """Difficulties of the words that are sent to the tasks, and how usual every place of the scale is.

    The log odds that a word occurs in a sentence of level t are c0 + c1 t +
    c2 t^2 with c2 <= 0: its ease less its discrimination times the squared
    distance of the level from the word's difficulty. silent is the log chance
    that no word at all occurs, by level.
    """

    words: np.ndarray
    coef: np.ndarray
    usual: np.ndarray
    silent: np.ndarray

    def place(self, words: np.ndarray) -> np.ndarray:
        """The row of each word; the last, which says nothing, for words that were not sent."""
        at = np.minimum(np.searchsorted(self.words, words), max(len(self.words) - 1, 0))
        return np.where(self.words[at] == words, at, len(self.words)) if len(self.words) else np.zeros(len(words), dtype=np.int64)

    def levels(self, at: np.ndarray, sizes: np.ndarray, rest: np.ndarray | None, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chance of each place of the scale for sentences of the given words, and their log-likelihoods; rest adds what words that were not sent weigh."""
        weight = np.add.reduceat(self.coef[at], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        score = (weight if rest is None else weight + rest) @ POWERS + self.silent + prior
        top = score.max(axis=1, keepdims=True)
        p = np.exp(score - top)
        total = p.sum(axis=1, keepdims=True)
        return p / total, (top + np.log(total))[:, 0]


def curves(n: np.ndarray, m1: np.ndarray, m2: np.ndarray, at: np.ndarray, ridge: float = 0.1, steps: int = 25) -> np.ndarray:
    """(c0, c1, c2) of words by Newton steps, from the number n of their sentences and the sums of the levels and squared levels of these; at: sentences by place.

    The sums are all that the likelihood needs: at its maximum the expected sums
    agree with them. The ridge keeps words of few sentences near to a flat
    curve; words that would be rarest in the middle get c2 = 0.
    """
    total = at.sum()
    c = np.zeros((len(n), 3))
    c[:, 0] = np.log((n + 0.1) / (total - n + 0.5).clip(0.5))
    want = np.column_stack([n, m1, m2])
    pull = np.array([1e-6, ridge, ridge])

    def gain(c: np.ndarray, want: np.ndarray) -> np.ndarray:
        return (want * c).sum(axis=1) - np.logaddexp(0.0, c @ POWERS) @ at - 0.5 * (pull * c * c).sum(axis=1)

    live, best = np.arange(len(n)), gain(c, want)
    for _ in range(steps):
        x, w, was = c[live], want[live], best[live]
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ POWERS, -40, 40)))
        grad = w - (p * at) @ POWERS.T - pull * x
        flat = (x[:, 2] >= 0) & (grad[:, 2] > 0)
        h = np.einsum("wq,iq,jq->wij", (p * (1 - p)) * at, POWERS, POWERS, optimize=True) + np.diag(pull + 1e-9)
        h[flat, 2, :], h[flat, :, 2], h[flat, 2, 2], grad[flat, 2] = 0.0, 0.0, 1.0, 0.0
        step = np.linalg.solve(h, grad[:, :, None])[:, :, 0]
        todo = np.arange(len(live))
        for _ in range(12):  # a step that gains nothing is halved
            new = x[todo] + step[todo]
            new[:, 2] = np.minimum(new[:, 2], 0.0)
            value = gain(new, w[todo])
            better = value > best[live[todo]]
            c[live[todo[better]]], best[live[todo[better]]] = new[better], value[better]
            todo = todo[~better]
            if not len(todo):
                break
            step[todo] /= 2
        live = live[best[live] - was > 1e-7 * np.abs(was)]
        if not len(live):
            break
    return c


def fitted_words(sums: DataFrame, at: np.ndarray) -> DataFrame:
    """(word, n, c0, c1, c2) of every word of a tally, each where its sums lie."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 20_000):
                part = batch.iloc[lo : lo + 20_000]
                c = curves(*(part[k].to_numpy() for k in ("n", "m1", "m2")), at)
                yield pd.DataFrame({"word": part["word"].to_numpy(), "n": part["n"].to_numpy(), **{k: c[:, i] for i, k in enumerate(COEF)}})

    return sums.where("word >= 0").mapInPandas(work, "word long, n double, c0 double, c1 double, c2 double")


def silence(words: DataFrame) -> np.ndarray:
    """The log chance at each place of the scale that none of the words occurs."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            odds = np.clip(batch[COEF].to_numpy() @ POWERS, -40, 40)
            yield pd.DataFrame({"place": np.arange(len(GRID)), "v": -np.log1p(np.exp(odds)).sum(axis=0)})

    out = np.zeros(len(GRID))
    for r in words.select(*COEF).mapInPandas(work, "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).collect():
        out[r["place"]] = r["v"]
    return out


def tallied(units: DataFrame, scale: Scale, graded_only: bool) -> DataFrame:
    """One pass over the sentences: the sums that every word, every place of the scale and the likelihood get from the levels under a scale."""
    sent = units.sparkSession.sparkContext.broadcast(scale)
    has_rest = "rest" in units.columns

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = sent.value
        size = len(s.words) + 1
        table, places, like = np.zeros((size, 3)), np.zeros(len(GRID)), 0.0
        for batch in batches:
            words, sizes, _, doc = unpacked(batch)
            if not len(words):
                continue
            at = s.place(words)
            p, ll = s.levels(at, sizes, rest_of(batch, len(sizes)) if has_rest else None, priors(batch, s)[doc])
            places += p.sum(axis=0)
            like += ll.sum()
            m1, m2 = np.repeat(p @ POWERS[1], sizes), np.repeat(p @ POWERS[2], sizes)
            for i, w in enumerate((None, m1, m2)):
                table[:, i] += np.bincount(at, weights=w, minlength=size)
            other = at == size - 1
            if other.any():
                word, back = np.unique(words[other], return_inverse=True)
                yield sums(word, *(np.bincount(back, weights=None if w is None else w[other]) for w in (None, m1, m2)))
        kept = table[:-1, 0] > 0
        yield sums(s.words[kept], *table[:-1][kept].T)
        yield sums(-1 - np.arange(len(GRID)), places, 0 * places, 0 * places)
        yield sums(np.array([LIKELIHOOD]), np.array([like]), np.zeros(1), np.zeros(1))

    rows = units.where("grade is not null") if graded_only else units
    parts = rows.drop("doc_id").mapInPandas(work, TALLY)
    return materialise(parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "m1", "m2")]), "tally")


def sums(word: np.ndarray, n: np.ndarray, m1: np.ndarray, m2: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"word": word.astype(np.int64), "n": np.asarray(n, dtype=float), "m1": m1, "m2": m2})


def priors(batch: pd.DataFrame, scale: Scale) -> np.ndarray:
    """The log chance of every place for each document's sentences: around its grade if it has one."""
    out = np.tile(np.log(scale.usual), (len(batch), 1))
    graded = batch["grade"].notna().to_numpy()
    if graded.any():
        out[graded] = near_grade(batch["grade"].to_numpy(dtype=float)[graded], scale.usual)
    return out


def rest_of(batch: pd.DataFrame, n: int) -> np.ndarray:
    """What words that were not sent weigh in each sentence of a batch: packed by document as (sentence, c0, c1, c2)."""
    out, first = np.zeros((n, 3)), 0
    for sizes, rest in zip(batch["sizes"], batch["rest"]):
        if rest is not None:
            for r in rest:
                out[first + r["sentence"]] = (r["c0"], r["c1"], r["c2"])
        first += len(sizes) // 4
    return out


def rare_tokens(units: DataFrame, sent_words: np.ndarray) -> DataFrame:
    """(doc_id, sentence, word) of the words that are not sent to the tasks."""
    sent = units.sparkSession.sparkContext.broadcast(sent_words)
    kind = dict(units.dtypes)["doc_id"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, sizes, _, doc = unpacked(batch)
            starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in batch["sizes"]])[:-1]]).astype(np.int64)
            other = ~np.isin(words, sent.value)
            row = np.repeat(np.arange(len(sizes)), sizes)[other]
            owner = doc[row]
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[owner], "sentence": (row - starts[owner]).astype(np.int32), "word": words[other].astype(np.int64)})

    return units.select("doc_id", "words", "sizes", "lengths").mapInPandas(work, f"doc_id {kind}, sentence int, word long")


def with_rest(units: DataFrame, rare: DataFrame, words: DataFrame) -> DataFrame:
    """units with `rest`: what the rare words of each sentence weigh, by an equi-join on the word."""
    weighed = rare.join(words.select("word", *COEF), "word").groupBy("doc_id", "sentence").agg(*[F.sum(c).alias(c) for c in COEF])
    packed = weighed.groupBy("doc_id").agg(F.collect_list(F.struct("sentence", *COEF)).alias("rest"))
    return units.join(packed, "doc_id", "left")


@dataclass
class Reading:
    """A fitted model: words (word, n, c0, c1, c2), the scale of those that are sent, the band of every place, and the log-likelihood of every round."""

    words: DataFrame
    scale: Scale
    units: DataFrame
    trace: list[float]
    bands: np.ndarray


def fit_scale(units: DataFrame, sent_words: int, tolerance: float, most_rounds: int) -> Reading:
    """Fits levels of sentences and difficulties of words in turn, until the log-likelihood gains less than `tolerance` of itself.

    The grades give the first levels, then every round takes the levels that the
    difficulties give to all sentences, graded or not (grades stay as prior), and
    the difficulties that these levels give to all words. Sums meet by word, and
    words are fitted where their sums lie. The sent_words most frequent words are
    sent to the tasks; the weights of the others come by an equi-join on the
    word, so that no word is left out however many there are.
    """
    empty = Scale(np.empty(0, np.uint32), np.zeros((1, 3)), np.full(len(GRID), 1 / len(GRID)), np.zeros(len(GRID)))

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            word, n = np.unique(unpacked(batch)[0], return_counts=True)
            yield pd.DataFrame({"word": word.astype(np.int64), "n": n})

    counts = units.select("words", "sizes", "lengths").mapInPandas(seen, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "words")
    sizes = sorted(((r["k"], r["n"]) for r in counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    floor, held = 0, 0
    for k, n in sizes:  # the least power of two that leaves at most sent_words words
        held += n
        if held > sent_words:
            floor = 1 << (int(k) + 1)
            break
    often = np.sort(counts.where(F.col("n") >= floor).select("word").toPandas()["word"].to_numpy(np.uint32))
    rare = materialise(rare_tokens(units, often), "rare") if floor else None

    def solved(tally: DataFrame) -> tuple[DataFrame, Scale, float]:
        extra = {r["word"]: r["n"] for r in tally.where("word < 0").collect()}
        at = np.array([extra.get(-1 - i, 0.0) for i in range(len(GRID))])
        words = materialise(fitted_words(tally, at), "difficulties")
        sent = words.where(F.col("n") >= 0).join(F.broadcast(counts.where(F.col("n") >= floor).select("word")), "word", "left_semi") if floor else words
        found = sent.toPandas().sort_values("word")
        coef = np.vstack([found[COEF].to_numpy(), np.zeros((1, 3))])
        usual = (at + 0.5) / (at + 0.5).sum()
        return words, Scale(found["word"].to_numpy(np.uint32), coef, usual, silence(words)), extra.get(LIKELIHOOD, 0.0)

    words, scale, _ = solved(tallied(units, empty, True))
    trace: list[float] = []
    for _ in range(most_rounds):
        seen_now = with_rest(units, rare, words) if rare is not None else units
        words, scale, like = solved(tallied(seen_now, scale, False))
        trace.append(like)
        if len(trace) > 1 and abs(trace[-1] - trace[-2]) <= tolerance * abs(trace[-2]):
            break
    units = with_rest(units, rare, words) if rare is not None else units
    return Reading(words, scale, units, trace, cut_places(units, scale))


def cut_places(units: DataFrame, scale: Scale) -> np.ndarray:
    """The band of every place of the scale: each cut is where the sentences of graded documents lie least on the wrong side of it.

    The graded documents' own grades play no part in where their sentences lie.
    The scale has as many places however many documents are graded.
    """
    sent = units.sparkSession.sparkContext.broadcast(scale)
    has_rest = "rest" in units.columns

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, held = sent.value, np.zeros((len(BANDS), len(GRID)))
        for batch in batches:
            words, sizes, _, doc = unpacked(batch)
            if len(words):
                p, _ = s.levels(s.place(words), sizes, rest_of(batch, len(sizes)) if has_rest else None, np.log(s.usual))
                np.add.at(held, np.searchsorted(EDGES, batch["grade"].to_numpy(dtype=float))[doc], p)
        band, place = np.indices(held.shape).reshape(2, -1)
        yield pd.DataFrame({"band": band, "place": place, "n": held.ravel()})

    held = np.zeros((len(BANDS), len(GRID)))
    for r in units.where("grade is not null").drop("doc_id").mapInPandas(work, "band int, place int, n double").groupBy("band", "place").agg(F.sum("n").alias("n")).collect():
        held[r["band"], r["place"]] = r["n"]
    cuts = []
    for k in range(1, len(BANDS)):
        low, high = held[:k].sum(axis=0), held[k:].sum(axis=0)
        wrong = np.concatenate([[0.0], np.cumsum(high)]) + low.sum() - np.concatenate([[0.0], np.cumsum(low)])
        sound = low.sum() > 0 and high.sum() > 0
        cuts.append(int(wrong.argmin()) if sound else int(np.searchsorted(GRID, EDGES[k - 1])))
    return np.searchsorted(np.maximum.accumulate(cuts), np.arange(len(GRID)), side="right")


def fit_reading(
    docs: DataFrame, labels: DataFrame, min_words: int = 40, sent_words: int = 500_000, tolerance: float = 0.005, most_rounds: int = 20, doc_id: str = "doc_id", text: str = "text"
) -> Reading:
    """The reading model of documents with labels (doc_id, grade); of several grades of a document the median counts."""
    ship(docs.sparkSession)
    grades = labels.where(F.col("grade").isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.median("grade").alias("grade"))
    units = materialise(sentence_units(docs, min_words, doc_id, text).join(grades, "doc_id", "left"), "units")
    return fit_scale(units, sent_words, tolerance, most_rounds)


def rated(model: Reading, doc_id: str = "doc_id") -> DataFrame:
    """The levels of the model's documents (see reading_levels)."""
    sent = model.units.sparkSession.sparkContext.broadcast(model.scale)
    has_rest = "rest" in model.units.columns

    bands = model.bands

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = sent.value
        for batch in batches:
            words, sizes, lengths, doc = unpacked(batch)
            votes, level = np.zeros((len(batch), len(BANDS))), np.zeros(len(batch))
            if len(words):
                p, _ = s.levels(s.place(words), sizes, rest_of(batch, len(sizes)) if has_rest else None, np.log(s.usual))
                level = np.bincount(doc, weights=(p @ GRID) * lengths, minlength=len(batch))
                for k in range(len(BANDS)):
                    votes[:, k] = np.bincount(doc, weights=p[:, bands == k].sum(axis=1) * lengths, minlength=len(batch))
            total = votes.sum(axis=1)
            usual = np.bincount(bands, weights=s.usual, minlength=len(BANDS))
            shares = np.where(total[:, None] > 0, votes / np.maximum(total, 1e-9)[:, None], usual)
            level = np.where(total > 0, level / np.maximum(total, 1e-9), s.usual @ GRID)
            out = {"doc_id": batch["doc_id"], "band": [BANDS[i] for i in shares.argmax(axis=1)], "level": level}
            yield pd.DataFrame(out | {name: shares[:, k] for k, name in enumerate(BANDS)})

    kind = dict(model.units.dtypes)["doc_id"]
    rows = model.units.mapInPandas(rate, f"doc_id {kind}, band string, level double, " + ", ".join(f"{b} double" for b in BANDS))
    return rows.withColumnRenamed("doc_id", doc_id).dropDuplicates([doc_id])


def reading_levels(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """(doc_id, band, level, early, middle, upper, expert): the reading level of every document of at least min_words words (options: see fit_reading).

    A Rasch-style model: every sentence has a latent level on the scale of
    school grades, every word a difficulty on the same scale, and the chance that
    the word occurs in the sentence is the logistic function of the word's ease
    less its discrimination times the squared distance between level and
    difficulty (Andrich's unfolding form of the Rasch model, as easy words are
    rare in hard texts too). Levels and difficulties are estimated in turn over
    all documents and all words, anchored by the median grades of labels, which
    also say where on the scale the bands meet. A document's shares are the parts of its words in sentences of each band, band
    is the largest share and level the mean level of its sentences by words.

    Null texts and null grades are left out; documents with no known words get
    the most usual band; without labels all bands stay alike; repeated rows give
    one row; extra columns are ignored; words of one 32-bit hash count as one.
    """
    return rated(fit_reading(docs, labels, doc_id=doc_id, **options), doc_id)


def word_difficulties(docs: DataFrame, model: Reading, text: str = "text") -> DataFrame:
    """(word, n_sentences, difficulty, discrimination): where on the scale of grades every word of a model is most at home.

    Words without a peak on the scale have the end to which they tend; words that
    say nothing have the middle. Numbers have no difficulty.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("long")
    def code(words: pd.Series) -> pd.Series:
        import xxhash

        return words.map(lambda w: xxhash.xxh32_intdigest(w) | 1)

    said = docs.select(F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))).alias("text")).where("text <> '' and not text rlike '^[0-9]+$'").distinct()
    peak = F.when(F.col("c2") < -1e-6, -F.col("c1") / (2 * F.col("c2"))).otherwise(F.signum("c1") * 2)
    grade = F.least(F.greatest(9 + 5 * peak, F.lit(float(GRID[0]))), F.lit(float(GRID[-1])))
    return said.withColumn("word", code("text")).join(model.words, "word").select(F.col("text").alias("word"), F.col("n").cast("long").alias("n_sentences"), grade.alias("difficulty"), (-F.col("c2")).alias("discrimination"))
