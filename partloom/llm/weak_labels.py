"""Quality classifier: a weak-label model and a hashed linear scorer.

Heuristic labellers vote on each document, for two questions: is it junk, and is it toxic. Several labellers look at the same
trait in different ways, so they overlap. Expectation-maximisation over the counts of vote patterns of all documents estimates how often
each labeller is right; there are as many patterns as combinations of votes, whatever the number of documents. The
posterior of a document's pattern is its label, and a linear scorer on hashed features learns these labels. It has the last word.

The toxic words and word beginnings that three of the labellers look for come from at most ``LABELLED`` rows of the labels table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from partloom.llm.carry import carried, restored
from partloom.llm.words import flat_words, hashes, owners, raw_texts, slices, starts, sums
from partloom.session import work_path

#: Labelled rows that the lexicon is made from, documents that the scorer is fitted on, and terms of the lexicon: bounds of what is sampled.
LABELLED = 20_000
FITTED = 20_000
TERMS = 2_000
SLOTS = 1 << 18
BEGINNINGS = (4, 5, 6)
TRAITS = ("marked", "shouted", "stuttered", "barred", "symbols", "exclaimed", "runs", "bars")
EDGES = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)
#: (trait, vote against from here on): pairs of labellers for four kinds of junk.
JUNK = (("marked", 0.2), ("symbols", 0.05), ("shouted", 0.5), ("exclaimed", 0.3), ("stuttered", 0.3), ("runs", 0.25), ("barred", 0.08), ("bars", 0.012))
_SIGNS = b".,;:!?\"'()[]{}*#$%&|<>-_"


def _terms(vocabulary: Iterable[bytes]) -> list[tuple[str, ...]]:
    """A word in lower case without signs around it, then its beginnings, each with a prefix that tells its kind."""
    out = []
    for word in vocabulary:
        bare = word.strip(_SIGNS).decode("utf-8", "replace").lower()
        out.append(("w:" + bare, *(f"{n}:{bare[:n]}" for n in BEGINNINGS if len(bare) >= n)) if bare else ())
    return out


def traits(texts: list[bytes], codes: np.ndarray, counts: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """One row per text, one column per name in ``TRAITS``: shares between 0 and 1."""
    n, owner = np.maximum(counts, 1), owners(counts)
    marked, shouted, exclaimed, bar = (np.zeros(len(vocabulary), bool) for _ in range(4))
    for i, word in enumerate(vocabulary):
        tail = word[-3:]
        marked[i] = len(tail) == 3 and tail[0] == tail[1] == tail[2] and tail[:1] in b"*#$%&"
        exclaimed[i] = tail[-2:] == b"!!"
        bar[i] = word == b"|"
        text = word.decode("utf-8", "replace")
        shouted[i] = len(text) > 1 and text.isupper()
    same = np.zeros(len(codes), bool)
    if len(codes) > 1:
        same[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    # The third and later words of a run of the same word. Repeated lines are no matter of this operator.
    third = same.copy()
    third[1:] &= same[:-1]
    size = np.array([max(1, len(t)) for t in texts])
    symbols = np.array([len(t) - len(t.translate(None, b"#*$%&<>")) for t in texts]) / size
    bars = np.array([t.count(b"|") for t in texts]) / size
    share_of = lambda flag: sums(flag, counts) / n
    share = lambda flag: share_of(flag[codes])
    return np.stack([share(marked), share(shouted), share_of(same), share(bar), symbols, share(exclaimed), share_of(third), bars], 1)


def _lexicon_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slice: a term, and in how many toxic and other texts it is."""
    for batch in slices(batches):
        codes, counts, vocabulary = flat_words(raw_texts(batch.column("text")))
        toxic = np.array(batch.column("toxic").to_pylist(), bool)
        pairs = pd.unique(owners(counts) * (len(vocabulary) + 1) + codes)
        owner, word = pairs // (len(vocabulary) + 1), pairs % (len(vocabulary) + 1)
        terms = _terms(vocabulary)
        length = np.fromiter(map(len, terms), np.int64, len(terms))
        flat, names = pd.factorize(np.array([t for x in terms for t in x], object))
        at = starts(length)
        reach = length[word]
        begin = np.repeat(at[word], reach) + np.arange(int(reach.sum())) - np.repeat(np.cumsum(reach) - reach, reach)
        once = pd.unique(np.repeat(owner, reach) * (len(names) + 1) + flat[begin])
        owner, term = once // (len(names) + 1), once % (len(names) + 1)
        bad = np.bincount(term[toxic[owner]], minlength=len(names))
        yield pa.RecordBatch.from_pydict(
            {"term": pa.array(names, pa.string()), "bad": pa.array(bad), "good": pa.array(np.bincount(term, minlength=len(names)) - bad)}
        )


def toxic_lexicon(docs: DataFrame, labels: DataFrame) -> list[str]:
    """At most ``TERMS`` words and beginnings that are found in labelled toxic texts and hardly in others, the most frequent first."""
    known = labels.dropna(subset=["doc_id", "toxic"]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    # The sample is bounded by LABELLED rows of two numbers.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", (F.col("toxic") == 1).alias("toxic"))
    counted = rows.mapInArrow(_lexicon_counts, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    n = sample.agg(F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0)), F.count("*")).first()
    least = max(4, n[0] // 100)
    telling = counted.filter((F.col("bad") >= least) & (F.col("bad") >= 19 * F.col("good"))).orderBy(F.desc("bad"), "term").limit(TERMS)
    return telling.select("term").toArrow()["term"].to_pylist()


class Votes:
    """The labellers: eight on junk, four on toxicity."""

    names = tuple(f"junk_{t}" for t, _ in JUNK), ("toxic_word", "toxic_short", "toxic_long", "toxic_many")

    def __init__(self, lexicon: list[str]):
        self.kinds = {t: (0 if t[0] == "w" else 1 if t[0] == "4" else 2) for t in lexicon}

    def __call__(self, share: np.ndarray, codes, counts, terms) -> tuple[np.ndarray, np.ndarray]:
        """Votes on junk and on toxicity, 1 against and 0 for, a row per text."""
        junk = np.stack([share[:, TRAITS.index(t)] >= edge for t, edge in JUNK], 1)
        hit = np.zeros((len(terms), 3), bool)
        for i, own in enumerate(terms):
            for t in own:
                k = self.kinds.get(t)
                if k is not None:
                    hit[i, k] = True
        found = np.stack([sums(hit[:, k][codes], counts) for k in range(3)], 1) if len(terms) else np.zeros((len(counts), 3), np.int64)
        toxic = np.concatenate([found > 0, (found.sum(1) > 2)[:, None]], 1)
        return junk.astype(np.int64), toxic.astype(np.int64)


def fit_labellers(patterns: np.ndarray, count: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, dict]:
    """Expectation-maximisation over vote patterns (rows of 0 and 1) and how many documents have each.

    Returns the posterior of each pattern, and the estimates: the prior, and each labeller's rates of votes against bad and good documents.
    """
    weight = count / max(1, count.sum())
    bad, good, prior = np.full(patterns.shape[1], 0.5), np.full(patterns.shape[1], 0.02), 0.1
    posterior = np.zeros(len(patterns))
    for _ in range(rounds):
        against = np.log(prior) + patterns @ np.log(bad) + (1 - patterns) @ np.log(1 - bad)
        for_ = np.log(1 - prior) + patterns @ np.log(good) + (1 - patterns) @ np.log(1 - good)
        posterior = 1 / (1 + np.exp(np.clip(for_ - against, -50, 50)))
        mass = weight * posterior
        prior = float(np.clip(mass.sum(), 1e-4, 0.5))
        bad = np.clip((mass @ patterns + 1e-4) / (mass.sum() + 4e-4), 1e-3, 1 - 1e-3)
        good = np.clip(((weight - mass) @ patterns + 1e-6) / ((weight - mass).sum() + 4e-4), 1e-5, 0.3)
    accuracy = prior * bad + (1 - prior) * (1 - good)
    return posterior, {"prior": prior, "bad": bad, "good": good, "accuracy": accuracy}


def _slots(share: np.ndarray, codes, counts, vocabulary, terms) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every hashed feature, each once: words, beginnings, and each trait's step."""
    length = np.fromiter(map(len, terms), np.int64, len(terms))
    flat = (hashes(t.encode() for x in terms for t in x) % np.uint64(SLOTS)).astype(np.int64)
    at = starts(length)
    pairs = pd.unique(owners(counts) * (len(vocabulary) + 1) + codes) if len(codes) else np.zeros(0, np.int64)
    owner, word = pairs // (len(vocabulary) + 1), pairs % (len(vocabulary) + 1)
    reach = length[word]
    begin = np.repeat(at[word], reach) + np.arange(int(reach.sum())) - np.repeat(np.cumsum(reach) - reach, reach)
    step = np.searchsorted(EDGES, share, side="right")
    named = hashes(f"trait:{t}:{k}".encode() for t in TRAITS for k in range(len(EDGES) + 1)) % np.uint64(SLOTS)
    stepped = named.astype(np.int64).reshape(len(TRAITS), -1)[np.arange(len(TRAITS))[None, :], step]
    owner = np.r_[np.repeat(owner, reach), np.repeat(np.arange(len(counts)), len(TRAITS))]
    once = pd.unique(owner * SLOTS + np.r_[flat[begin], stepped.ravel()])
    return once // SLOTS, once % SLOTS


def _patterns(batches: Iterable[pa.RecordBatch], lexicon: list[str]) -> Iterator[pa.RecordBatch]:
    vote = Votes(lexicon)
    for batch in slices(batches):
        texts = raw_texts(batch.column("text"))
        codes, counts, vocabulary = flat_words(texts)
        junk, toxic = vote(traits(texts, codes, counts, vocabulary), codes, counts, _terms(vocabulary))
        code = junk @ (1 << np.arange(junk.shape[1])) + (toxic @ (1 << np.arange(toxic.shape[1])) << junk.shape[1])
        values, n = np.unique(code, return_counts=True)
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(values), "n": pa.array(n.astype(np.int64))})


def _bits(codes: np.ndarray, n: int) -> np.ndarray:
    return (codes[:, None] >> np.arange(n)) & 1


class LabelModel:
    """The posterior of junk and of toxicity for each pattern of votes."""

    def __init__(self, lexicon: list[str], patterns: np.ndarray, count: np.ndarray):
        self.lexicon, self.n_junk, self.n_toxic = lexicon, len(Votes.names[0]), len(Votes.names[1])
        self.estimates, self._posterior = {}, []
        for name, part, n in (("junk", patterns & ((1 << self.n_junk) - 1), self.n_junk), ("toxic", patterns >> self.n_junk, self.n_toxic)):
            values, back = np.unique(part, return_inverse=True)
            posterior, self.estimates[name] = fit_labellers(_bits(values, n), np.bincount(back, weights=count, minlength=len(values)))
            self._posterior.append(dict(zip(values.tolist(), posterior.tolist())))

    def posterior(self, junk: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = junk @ (1 << np.arange(self.n_junk)), toxic @ (1 << np.arange(self.n_toxic))
        return np.array([self._posterior[0].get(int(x), 0.0) for x in a]), np.array([self._posterior[1].get(int(x), 0.0) for x in b])


def label_model(docs: DataFrame, labels: DataFrame) -> LabelModel:
    """Estimates over the votes on all documents."""
    lexicon = toxic_lexicon(docs, labels)
    counted = docs.select("text").mapInArrow(lambda b: _patterns(b, lexicon), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    # At most as many rows as there are combinations of twelve votes.
    table = counted.orderBy("pattern").toArrow()
    return LabelModel(lexicon, table["pattern"].to_numpy().astype(np.int64), table["n"].to_numpy().astype(np.float64))


def _examples(batches: Iterable[pa.RecordBatch], model: LabelModel) -> Iterator[pa.RecordBatch]:
    vote = Votes(model.lexicon)
    for batch in slices(batches):
        texts = raw_texts(batch.column("text"))
        codes, counts, vocabulary = flat_words(texts)
        terms, share = _terms(vocabulary), traits(texts, codes, counts, vocabulary)
        junk, toxic = model.posterior(*vote(share, codes, counts, terms))
        owner, slot = _slots(share, codes, counts, vocabulary, terms)
        order = np.lexsort((slot, owner))
        at = np.searchsorted(owner[order], np.arange(len(counts) + 1))
        features = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(slot[order].astype(np.int32)))
        yield pa.RecordBatch.from_pydict({"slots": features, "junk": pa.array(junk), "toxic": pa.array(toxic)})


def fit_scorer(slots: np.ndarray, length: np.ndarray, target: np.ndarray, epochs: int = 8, size: int = 256) -> tuple[np.ndarray, float]:
    """Logistic regression on features that are there or not, for soft labels. Features whose share among bad and good examples
    differs by less than four standard errors are left at 0, so the length of a text adds no noise."""
    owner = owners(length)
    n, bad = len(length), target.sum()
    seen, seen_bad = np.bincount(slots, minlength=SLOTS), np.bincount(slots, weights=target[owner], minlength=SLOTS)
    weights, offset = np.zeros(SLOTS), 0.0
    if not 0 < bad < n:
        return weights, -5.0
    p, q = seen_bad / bad, (seen - seen_bad) / (n - bad)
    mean = seen / n
    error = np.sqrt(np.maximum(mean * (1 - mean), 1e-9) * (1 / bad + 1 / (n - bad)))
    telling = (seen >= 5) & (np.abs(p - q) > 4 * error)
    keep = telling[slots]
    slots, owner = slots[keep], owner[keep]
    at = np.searchsorted(owner, np.arange(n + 1))
    offset = float(np.log(bad / (n - bad)))
    squares, offset_square = np.full(SLOTS, 1e-6), 1e-6
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, size):
            rows = order[i : i + size]
            own = np.concatenate([slots[at[r] : at[r + 1]] for r in rows])
            count = at[rows + 1] - at[rows]
            z = offset + sums(weights[own], count)
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[rows]
            gradient = np.bincount(own, weights=np.repeat(error, count), minlength=SLOTS) / len(rows) + 1e-5 * weights
            squares += gradient**2
            weights -= 0.3 * gradient / np.sqrt(squares) * (gradient != 0)
            offset_square += error.mean() ** 2
            offset -= 0.3 * error.mean() / np.sqrt(offset_square)
    return weights, offset


def _fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    slots = np.concatenate([b["slots"].flatten().to_numpy() for b in held]).astype(np.int64) if held else np.zeros(0, np.int64)
    length = np.concatenate([b["slots"].value_lengths().to_numpy() for b in held]).astype(np.int64) if held else np.zeros(0, np.int64)
    for name in ("junk", "toxic"):
        target = np.concatenate([b[name].to_numpy() for b in held]) if held else np.zeros(0)
        weights, offset = fit_scorer(slots, length, target)
        used = np.flatnonzero(weights)
        slot, value = np.r_[-1, used], np.r_[offset, weights[used]]
        yield pa.RecordBatch.from_pydict({"head": pa.array([name] * len(slot)), "slot": pa.array(slot), "weight": pa.array(value)})


class Scorer:
    def __init__(self, weights: np.ndarray, offset: np.ndarray):
        self.weights, self.offset = weights, offset

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """The chance of junk and of toxicity of each text."""
        codes, counts, vocabulary = flat_words(texts)
        owner, slot = _slots(traits(texts, codes, counts, vocabulary), codes, counts, vocabulary, _terms(vocabulary))
        z = np.stack([o + np.bincount(owner, weights=w[slot], minlength=len(texts)) for w, o in zip(self.weights, self.offset)], 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    """The label model over all documents, then the scorer on at most ``FITTED`` of them, chosen by a hash of their id."""
    spark = docs.sparkSession
    model = label_model(docs, labels)
    ids = docs.select("doc_id").dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(FITTED)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text").mapInArrow(
        lambda b: _examples(b, model), "slots array<int>, junk double, toxic double"
    )
    path = work_path(spark, "scorer")
    rows.repartition(1).mapInArrow(_fit, "head string, slot long, weight double").write.parquet(path)
    table = spark.read.parquet(path).toArrow()
    weights, offset = np.zeros((2, SLOTS)), np.zeros(2)
    head, slot, value = np.array(table["head"].to_pylist()), table["slot"].to_numpy(), table["weight"].to_numpy()
    for k, name in enumerate(("junk", "toxic")):
        own = head == name
        used = own & (slot >= 0)
        weights[k, slot[used]] = value[used]
        offset[k] = value[own & (slot < 0)].sum()
    return Scorer(weights, offset)


def _scored(batches: Iterable[pa.RecordBatch], scorer: Scorer, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        p = scorer(raw_texts(batch.column("text")))
        columns = {c: batch.column(c) for c in names}
        yield pa.RecordBatch.from_pydict(columns | {"p_junk": pa.array(p[:, 0]), "p_toxic": pa.array(p[:, 1]), "kept": pa.array((p < 0.5).all(1))})


_VERDICT = "p_junk double, p_toxic double, kept boolean"


def _judged(chosen: DataFrame, out: list[str], scorer: Scorer) -> DataFrame:
    schema = StructType([f for f in chosen.schema.fields if f.name in out] + StructType.fromDDL(_VERDICT).fields)
    return chosen.mapInArrow(lambda b: _scored(b, scorer, out), schema)


def classify(docs: DataFrame, labels: DataFrame, keep_columns: bool = False) -> DataFrame:
    """doc_id (or, with ``keep_columns``, all columns of ``docs``), p_junk, p_toxic and kept: whether both are under a half.

    Every whole text is judged; a null or empty text is judged by its traits alone, all 0. Repeated rows give repeated rows, an empty table an empty one.
    Columns of ``docs`` named p_junk, p_toxic or kept are replaced. Without labelled toxic rows nothing is called toxic.
    """
    scorer = train(docs, labels)
    if not keep_columns:
        return _judged(docs.select("doc_id", "text"), ["doc_id"], scorer)
    chosen = carried(docs)
    return restored(_judged(chosen, chosen.columns, scorer), docs, more=StructType.fromDDL(_VERDICT).names)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that ``classify`` keeps, with all their columns as they were, whatever their names and types."""
    chosen = carried(docs)
    return restored(_judged(chosen, chosen.columns, train(docs, labels)).filter("kept"), docs)
