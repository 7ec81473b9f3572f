"""Toxicity by weak supervision.

1. Voters: a fixed lexicon of insults; patterns of attack, shouting and dismissal; and words and word beginnings that the labelled
   rows of the learning fold show far more often in toxic texts. A voter votes for toxic where it is at least one word in RATE and
   abstains elsewhere; one voter speaks against where no other speaks at all.
2. A generative label model over the votes of all rows outside the held-out fold, labelled or not: EM estimates each voter's rates
   in both classes and the class balance; the known labels are one more voter whose accuracy is estimated with the others. Voters that
   agree beyond what the class explains (residual correlations) share one vote: a voter's log-likelihood is divided by one plus
   its positive correlations. Rows of equal votes are counted together, and every sum is Spark's; the driver sees a number for each
   voter and pair of voters. Unlabelled rows weigh together as much as the labelled ones at most.
3. A linear (logistic) classifier on the voters' counts and densities, trained on the model's posterior labels. It alone scores.

Words are learnt from at most MAX_LABELLED labelled rows, the classifier from these and about MAX_UNLABELLED others, chosen by their ids'
hashes. A learnt voter must bear
VOTER_SHARE of all evidence (its count times its lift, over the words of toxic rows), so there are at most some hundreds.

Defined cases: a null or empty text gets the score of a text without any vote; labels other than 0 and 1, held-out rows and null
ids teach nothing; of rows that share an id the least text teaches, and an id with both labels is toxic; without any toxic or any
other label the fixed voters alone vote and the score is their density's; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.llm import common

MAX_LABELLED, MAX_UNLABELLED, VOTER_SHARE = 20_000, 10_000, 0.001
#: What an unlabelled row counts in training the classifier, beside a labelled one.
UNLABELLED = 0.02
#: Words that a worker remembers, and characters of one at most.
HELD_WORDS, HELD_LENGTH = 200_000, 40
SHORTEST, LONGEST = 4, 8  # of word beginnings
#: The labels' accuracy at first; it is then estimated, and only kept apart from a coin's toss and from certainty.
ACCURACY = (0.8, 0.5, 0.9998)
ROUNDS, CORRELATED_AT = 12, (3, 7)
CORRELATED = 0.4  # least residual correlation of voters that share a vote
#: Inputs of the classifier besides the voters; words of a text that one vote needs.
EXTRA, RATE = 6, 250
# A small lexicon of insults.
LEXICON = (
    "clown", "disgusting", "dumb", "filth", "fool", "garbage", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "shut", "stupid", "trash", "ugly", "vermin", "worthless",
    "dummkopf", "abschaum", "crétin", "imbécile", "estúpido", "basura",
)
#: name, pattern over the lower-cased text or (True) the text as it is.
PATTERNS = (
    ("attack", r"\b(?:you|u|your|du|tu|vous|eres)\b[^.!?\n]{0,24}\b(?:" + "|".join(LEXICON) + r")", False),
    ("dismissal", r"\b(?:shut up|get lost|go away|go to hell|nobody (?:likes|wants) you|hate you|halt die klappe|ferme-la|cállate)\b", False),
    ("shouting", r"[!?]{2,}", False),
    ("capitals", r"\b[A-Z]{4,}\W+[A-Z]{4,}\b", True),
)
_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = tuple((f"~{name}", re.compile(p), as_is) for name, p, as_is in PATTERNS)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def signs_of(word: str) -> list[str]:
    """What of a word may vote: the whole (=) and its beginnings (^)."""
    if len(word) < SHORTEST:
        return []
    return ["=" + word, *("^" + word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1))]


@dataclass
class Voters:
    """Signs in order of their numbers, with their lifts (log ratio of their rates among words of toxic and other texts)."""

    signs: list[str]
    lifts: list[float]
    seen: dict[str, tuple[tuple[int, ...], float]] = field(default_factory=dict, repr=False)
    number: dict[str, int] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"signs": self.signs, "lifts": self.lifts, "seen": {}, "number": {}}

    def _of(self, word: str) -> tuple[tuple[int, ...], float] | tuple[()]:
        own = tuple(self.number[s] for s in signs_of(word) if s in self.number)
        return (own, max(self.lifts[i] for i in own)) if own else ()

    def counts(self, text: str) -> tuple[Counter, int, float, int]:
        """How often each voter occurs; how many words have a vote, and their lifts' sum; the number of words. Words are remembered, up to a bound."""
        if not self.number:
            self.number.update((s, i) for i, s in enumerate(self.signs))
        lower, found = text.lower(), Counter()
        words = _WORD.findall(lower)
        votes = list(map(self.seen.get, words))
        if None in votes:
            common.only_cache("toxicity", self.seen.clear)
            if len(self.seen) > HELD_WORDS:
                self.seen.clear()
            for i, v in enumerate(votes):
                if v is None:
                    votes[i] = self._of(words[i])
                    if len(words[i]) <= HELD_LENGTH:
                        self.seen[words[i]] = votes[i]
        voting, lift = 0, 0.0
        for v in filter(None, votes):
            found.update(v[0])
            voting += 1
            lift += v[1]
        for name, pattern, as_is in _PATTERNS:
            n = len(pattern.findall(text if as_is else lower))
            if n:
                found[self.number[name]] = n
        return found, voting, lift, len(words)

    def vector(self, text: str) -> np.ndarray:
        """The classifier's inputs: for each voter log(1 + its count in 200 words), then shares of voting words, their weight, distinct voters and length."""
        return self.dense(*self.counts(text))

    def dense(self, found: dict[int, int], voting: int, lift: float, n: int) -> np.ndarray:
        x = np.zeros(len(self.signs) + EXTRA)
        for j, c in found.items():
            x[j] = np.log1p(200 * c / max(n, 50))
        share = voting / max(n, 20)
        x[-EXTRA:] = [20 * min(0.1, share), 4 * share**0.5, 5 * min(0.4, lift / max(n, 20)), np.log1p(len(found)) / 2, np.log1p(voting), np.log1p(n) / 4]
        return x


def induce(rows: DataFrame) -> Voters:
    """Signs that words of toxic rows (text, y) bear far more often than words of others, with the fixed lexicon. Counts are added up by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in common.portions(batch):
                docs, pos, neg = Counter(), Counter(), Counter()
                for text, label in zip(common.texts(some), some.column("y").to_pylist()):
                    own = Counter()
                    for word, n in Counter(words_of(text)).items():
                        own[""] += n  # all words
                        for s in signs_of(word):
                            own[s] += n
                    (pos if label else neg).update(own)
                    if label:
                        docs.update(own.keys())
                signs = list(pos.keys() | neg.keys())
                yield pa.RecordBatch.from_arrays([pa.array(signs, pa.string()), *(pa.array([c[s] for s in signs], pa.int64()) for c in (docs, pos, neg))], names=["sign", "docs", "pos", "neg"])

    summed = common.table(rows.mapInArrow(count, "sign string, docs long, pos long, neg long").groupBy("sign").agg(*(F.sum(c).alias(c) for c in ("docs", "pos", "neg"))), "toxicity-signs")
    total = summed.where("sign = ''").first()
    fixed = {**{f"={w}": 3.0 for w in LEXICON}, **{name: 1.0 for name, _, _ in _PATTERNS}}
    if total is not None and total["pos"] and total["neg"]:
        lift = F.log((F.col("pos") + 0.5) / total["pos"]) - F.log((F.col("neg") + 0.5) / total["neg"])
        strong = summed.where("sign <> ''").where((F.col("docs") >= max(4, 0.002 * total["docs"])) & (lift >= np.log(6.0)))
        # a word has six signs at most, so fewer than 6 * lift / VOTER_SHARE can bear this share
        strong = strong.select("sign", lift.alias("lift"), "pos").where(F.col("pos") * F.col("lift") >= VOTER_SHARE * total["pos"]).orderBy("sign").collect()
        fixed |= {r["sign"]: r["lift"] for r in strong}
    common.drop(summed)
    return Voters(list(fixed), list(fixed.values()))


@dataclass
class LabelModel:
    """Rates of the voters (the last one: silence) in both classes, their shares of a vote, the class balance and the labels' accuracy."""

    rate1: np.ndarray
    rate0: np.ndarray
    share: np.ndarray
    balance: float
    accuracy: float

    def posterior(self, votes: list[np.ndarray], gold: np.ndarray) -> np.ndarray:
        """Probability of toxic for each row of voter numbers; gold is 1, 0 or -1 for unknown. An absent voter abstains."""
        weight = self.share * (np.log(self.rate1) - np.log(self.rate0))
        logit = np.log(self.balance / (1 - self.balance)) + np.array([weight[v].sum() for v in votes])
        logit += np.where(gold < 0, 0.0, np.where(gold == 1, 1, -1) * np.log(self.accuracy / (1 - self.accuracy)))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


_SUMS = "at long, value double"


def _sums(rows: DataFrame, width: int, value: Callable[[list[np.ndarray], np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over rows (votes, y, weight) of an array that value makes of each batch; added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            votes = [np.array(v, np.int64) for v in batch.column("votes").to_pylist()]
            total += value(votes, batch.column("y").to_numpy(), batch.column("weight").to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "value"])

    out = np.zeros(width)
    for r in rows.select("votes", "y", "weight").mapInArrow(run, _SUMS).groupBy("at").agg(F.sum("value").alias("value")).collect():  # width rows at most
        out[r["at"]] = r["value"]
    return out


def label_model(rows: DataFrame, n_voters: int) -> LabelModel:
    """The label model of rows: votes (voter numbers; n_voters alone where none speaks), y (0, 1 or -1) and weight."""
    n = n_voters + 1

    def flat(votes: list[np.ndarray], w: np.ndarray) -> np.ndarray:
        return np.bincount(np.concatenate([np.zeros(0, np.int64), *votes]), np.repeat(w, [len(v) for v in votes]), n)

    def pairs(votes: list[np.ndarray], y: np.ndarray, w: np.ndarray) -> np.ndarray:
        v = np.zeros((len(votes), n))
        for i, own in enumerate(votes):
            v[i, own] = 1
        return ((v * w[:, None]).T @ v).ravel()

    both = _sums(rows, n * n, pairs).reshape(n, n)
    first, low, high = ACCURACY
    model = LabelModel(np.full(n, 0.3), np.full(n, 0.02), np.zeros(n), 0.5, first)
    start = np.zeros(n)
    start[n_voters] = 1  # before the first round a row is judged by its label, else by whether any voter speaks

    def guess(votes: list[np.ndarray], y: np.ndarray) -> np.ndarray:
        return np.where(y >= 0, np.where(y == 1, first, 1 - first), [0.02 if start[v].any() else 0.3 for v in votes])

    for k in range(ROUNDS):
        now = (lambda v, y: guess(v, y)) if k == 0 else model.posterior

        def of(votes: list[np.ndarray], y: np.ndarray, w: np.ndarray, now=now) -> np.ndarray:
            q = now(votes, y)
            known, right = w * (y >= 0), np.where(y == 1, q, 1 - q)
            return np.concatenate([flat(votes, w * q), flat(votes, w * (1 - q)), [(w * q).sum(), (w * (1 - q)).sum(), (w * q * q).sum(), (w * q * (1 - q)).sum(), (w * (1 - q) ** 2).sum(), known.sum(), (known * right).sum()]])

        got = _sums(rows, 2 * n + 7, of)
        with1, with0 = got[:n], got[n : 2 * n]
        pos, neg, qq, qp, pp, known, right = got[2 * n :]
        rate1, rate0 = (with1 + 0.3) / (pos + 1.6), (with0 + 0.3) / (neg + 1.6)
        share = model.share if k else np.ones(n)
        if k in CORRELATED_AT:  # covariance that the classes leave unexplained
            mixed = np.outer(with1, rate1) + np.outer(with0, rate0)
            cov = both - mixed - mixed.T + qq * np.outer(rate1, rate1) + qp * (np.outer(rate1, rate0) + np.outer(rate0, rate1)) + pp * np.outer(rate0, rate0)
            dev = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            rho = cov / np.outer(dev, dev) - np.eye(n)
            share = 1 / (1 + np.where(rho >= CORRELATED, rho, 0).sum(1))
        accuracy = min(high, max(low, right / known)) if known else first
        model = LabelModel(rate1, rate0, share, (pos + 1) / (pos + neg + 2), accuracy)
    return model


def logistic(x: np.ndarray, q: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights (last: intercept) of a logistic regression on soft labels of rows that count by weight, by Newton steps."""
    x = np.insert(x, x.shape[1], 1.0, 1)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (q - p)) - penalty * w)
        w = w + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return w


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        return self.of(np.array([self.voters.vector(t) for t in texts]).reshape(len(texts), -1))

    def of(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -60, 60)))


_COUNTS = "doc_id long, found array<struct<j:int,c:int>>, votes array<int>, voting long, lift double, n long"


def votes_of(docs: DataFrame, voters: Voters) -> DataFrame:
    """A row for each document: its voters with their counts, the numbers of those that vote (the number of all where none does), and the sums that the classifier needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.portions(whole):
                rows = []
                for text in common.texts(batch):
                    found, voting, lift, n = voters.counts(text)
                    least = max(n, 50) / RATE
                    own = sorted(found.items())
                    rows.append(([{"j": j, "c": c} for j, c in own], [j for j, c in own if c >= least] or [len(voters.signs)], voting, lift, n))
                made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.list_(pa.struct([("j", pa.int32()), ("c", pa.int32())])), pa.list_(pa.int32()), pa.int64(), pa.float64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "found", "votes", "voting", "lift", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, _COUNTS)


def _vectors(batch: pa.RecordBatch, voters: Voters) -> np.ndarray:
    """The classifier's inputs of rows of votes_of()."""
    rows = zip(*(batch.column(c).to_pylist() for c in ("found", "voting", "lift", "n")))
    return np.array([voters.dense({x["j"]: x["c"] for x in found}, voting, lift, n) for found, voting, lift, n in rows]).reshape(batch.num_rows, -1)


def fit_votes(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The classifier of labels.toxic and the votes of all documents, as a table in the shared folder."""
    docs, labels = common.columns(docs, doc_id="long", text="string"), common.columns(labels, doc_id="long", toxic="int")
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~common.held_out(F.col("doc_id")))
    taught = known.groupBy("doc_id").agg(F.max("toxic").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    taught = F.broadcast(common.table(taught, "toxicity-ids"))  # at most MAX_LABELLED ids
    sample = common.table(docs.join(taught, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")), "toxicity-sample")
    voters = induce(sample)
    votes = common.table(votes_of(docs, voters), "toxicity-votes")
    width = len(voters.signs) + EXTRA
    here = {r["y"] for r in sample.select("y").distinct().collect()}
    if here != {0, 1}:
        return Model(voters, np.concatenate([np.zeros(width - EXTRA), [4.0, 0, 0, 0, 0, 0, -2.0]])), votes
    counted = votes.where(F.col("doc_id").isNotNull() & ~common.held_out(F.col("doc_id"))).join(taught, "doc_id", "left").groupBy("votes", F.coalesce("y", F.lit(-1)).alias("y")).agg(F.count("*").alias("n"))
    counted = common.table(counted, "toxicity-patterns")
    sizes = {r["known"]: r["n"] for r in counted.groupBy((F.col("y") >= 0).alias("known")).agg(F.sum("n").alias("n")).collect()}
    trust = min(0.25, sizes.get(True, 0) / max(1, sizes.get(False, 0)))
    weighed = counted.select("votes", "y", (F.col("n") * F.when(F.col("y") >= 0, 1.0).otherwise(trust)).alias("weight"))
    believed = label_model(weighed, len(voters.signs))

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch, voters).astype(np.float32)
            y = batch.column("y").to_numpy()
            q = believed.posterior([np.array(v, np.int64) for v in batch.column("votes").to_pylist()], y)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array(q), pa.array(y >= 0)], names=["x", "q", "known"])

    # labelled rows, and unlabelled ones chosen by hash: the classifier learns from what the label model believes of both
    chance = F.pmod(F.xxhash64("doc_id", F.lit("unlabelled")), F.lit(1_000_000))
    open_ = votes.where(F.col("doc_id").isNotNull() & ~common.held_out(F.col("doc_id")) & (chance < 1_000_000 * MAX_UNLABELLED / max(1, sizes.get(False, 0)))).join(taught, "doc_id", "left_anti")
    own = votes_of(sample, voters).join(taught, "doc_id").unionByName(open_.withColumn("y", F.lit(-1)))
    got = own.mapInArrow(inputs, "x binary, q double, known boolean").toArrow()  # about MAX_LABELLED and MAX_UNLABELLED rows at most
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, width).astype(float)
    q, weight = got.column("q").to_numpy(), np.where(got.column("known").to_numpy(zero_copy_only=False), 1.0, UNLABELLED)
    common.drop(sample)
    common.drop(counted)
    return Model(voters, logistic(x, q, weight)), votes


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The classifier of labels.toxic, from the rows that may be learnt from."""
    model, votes = fit_votes(docs, labels)
    common.drop(votes)
    return model


def score_votes(votes: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of rows of votes_of(): the texts aren't read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2_000):
                batch = whole.slice(lo, 2_000)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.of(_vectors(batch, model.voters)))], names=["doc_id", "score"])

    return votes.mapInArrow(run, "doc_id long, score double")


def score(text: Column, model: Model) -> Column:
    """The probability that a text is toxic."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score([t or "" for t in texts]) if len(texts) else np.zeros(0))

    return run(F.coalesce(text, F.lit("")))
