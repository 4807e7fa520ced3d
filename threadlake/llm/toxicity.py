"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks, trained on labelled sentences.

The kernel of two words counts the character subsequences of length three that they share, spanning at most five letters, each gap
weighted by ``DECAY``, over the norms of both. Only letters and digits make a word: signs within it, and blanks within a run of single
letters, are left out before any subsequence is taken, so that ``i.d.i.o.t``, ``i d i o t`` and ``idiot`` are one word; an inserted
letter is a gap, which the kernel bears. Values are raised to the power ``DEGREE``, which tells a word from others that only begin like it.

Kernel values to landmark words, whitened (Nyström), feed a linear SVM on squared hinge loss. Its examples are sentences of labelled
documents, each standing for its worst word: all of a clean document's are clean, and of a toxic one's at least one is toxic. So training goes in rounds:
in each, toxic documents put forward the sentences that the last round's model finds worst, as they are and with letters inserted, and
clean ones their worst, which are kept for all later rounds. A document's score is its worst sentence's, calibrated (Platt) on labelled documents.

Words are scored once per distinct word and task. The model has a fixed size and is broadcast.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.session import Scratch

DECAY = 0.5
PATTERNS = [(1, 2, 1.0), (1, 3, DECAY), (2, 3, DECAY), (1, 4, DECAY**2), (2, 4, DECAY**2), (3, 4, DECAY**2)]
SYMBOLS, START = 64, 63
DEGREE = 3
NEAR = 0.4  # kernel to a toxic landmark, before it is raised, that a word can reach at least; else it is not scored
PIECE = 32  # letters of a longer word that are scored together; pieces overlap by half, and the worst counts
SENTENCE = 32  # words of a sentence at most; a longer one goes on as another
SPACED = 3  # single letters in a row that make a word at least
LANDMARKS = 256
ROUNDS = 4
REANCHOR = 2  # rounds whose sentences give the next landmarks
CLEAN = 3  # sentences that a clean document puts forward in a round at most
TOXIC, LEVEL = 4, 0.95  # the same of a toxic one, and the share of clean ones that all but its first are worse than
INSERTED = 4  # variants of a toxic sentence with a letter inserted
COST, BALANCE = 10.0, 1.0  # of an error, and of all toxic sentences' errors to all clean ones'
FALSE_ALARMS = 0.002
SPREAD = 32  # tasks that the sample is dealt to
MAX_LABELLED = 12_000  # labelled rows that the classifier is fitted on at most
BLOCK_CHARS = 1_000_000
MEMO_WORDS = 400_000


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Symbol of each code point below 65536: 1 to 26 letters, 27 digits, 30 to 62 letters that are not ASCII, 0 all that is left out."""
    out = np.zeros(65536, np.uint8)
    for cp in range(65536):
        c = chr(cp)
        if "a" <= c <= "z":
            out[cp] = cp - 96
        elif c.isdigit() and cp < 128:
            out[cp] = 27
        elif cp >= 128 and c.isalnum():
            out[cp] = 30 + (cp * 40503 >> 4) % 33
    return out


def letters(word: str) -> np.ndarray:
    """The symbols of a lower-cased word, without what is neither letter nor digit."""
    cp = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4")
    sym = _symbols()[np.minimum(cp, 65535)]
    return sym[sym > 0]


def spell(words: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """What ``letters`` gives of each word, as bytes, with its size, and each word's last code point; all words at once. No word is empty or has a line feed."""
    cp = np.frombuffer("\n".join([*words, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.flatnonzero(cp == 10)
    sym = _symbols()[np.minimum(cp, 65535)]
    kept = sym > 0
    size = np.add.reduceat(kept, np.r_[0, ends[:-1] + 1], dtype=np.int64)  # a line feed's symbol is 0, so that no range is empty
    all_symbols, stops = sym[kept].tobytes(), np.cumsum(size).tolist()
    return [all_symbols[a:b] for a, b in zip([0, *stops], stops, strict=False)], size, cp[ends - 1]


def features(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code, value) of all words' subsequences, by owner; each word's values have the norm 1. A word of one letter has none.

    A sign for the word's start is put before its letters, so that two of them with it are a subsequence as well.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    owner = np.repeat(np.arange(len(words)), sizes)
    s = np.full(int(sizes.sum()), START, np.int64)
    first = np.cumsum(sizes) - sizes
    inside = np.ones(len(s), bool)
    inside[first] = False
    s[inside] = np.concatenate(words) if words else s[inside]
    keys, weights = [], []
    for i, j, weight in PATTERNS:
        n = len(s) - j
        if n > 0:
            at = np.flatnonzero(owner[:n] == owner[j:])
            keys.append(((owner[at] * SYMBOLS + s[at]) * SYMBOLS + s[at + i]) * SYMBOLS + s[at + j])
            weights.append(np.full(len(at), weight))
    if not keys or not sum(map(len, keys)):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    key, value = key[cut], np.add.reduceat(weight, cut)
    owner, code = key // SYMBOLS**3, key % SYMBOLS**3
    norm = np.sqrt(np.bincount(owner, value * value, len(words)))
    return owner, code, value / norm[owner]


class Kernel:
    """Normalised kernel values of words to landmarks, to the power of ``DEGREE``."""

    def __init__(self, toxic: list[np.ndarray], clean: list[np.ndarray]):
        landmarks = [*toxic, *clean]
        owner, code, value = features(landmarks)
        codes = np.unique(code)
        self.row = np.full(SYMBOLS**3, -1, np.int32)  # of a subsequence among those that landmarks have
        self.row[codes] = np.arange(len(codes))
        self.phi = np.zeros((len(codes), len(landmarks)), np.float32)
        self.phi[self.row[code], owner] = value
        self.most = self.phi[:, : len(toxic)].max(axis=1, initial=0)  # of each subsequence in a toxic landmark

    def near(self, words: list[np.ndarray]) -> np.ndarray:
        """Whether a word can have a kernel of ``NEAR`` or more, before it is raised, to a toxic landmark, by an upper bound."""
        owner, code, value = features(words)
        i = self.row[code]
        hit = i >= 0
        return np.bincount(owner[hit], value[hit] * self.most[i[hit]], len(words)) >= NEAR

    def values(self, words: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(words), self.phi.shape[1]), np.float32)
        for at in range(0, len(words), 512):
            owner, code, value = features(words[at : at + 512])
            i = self.row[code]
            hit = i >= 0
            x = np.zeros((min(512, len(words) - at), len(self.phi)), np.float32)
            x[owner[hit], i[hit]] = value[hit]
            out[at : at + 512] = x @ self.phi
        return out**DEGREE

    def whitening(self) -> np.ndarray:
        """What turns kernel values into Nyström coordinates, in which products are kernel values again."""
        values, vectors = np.linalg.eigh((self.phi.T @ self.phi).astype(float) ** DEGREE)
        keep = values > 1e-6 * values.max()
        return vectors[:, keep] / np.sqrt(values[keep])


def svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss, by Newton steps that are halved until the loss falls. ``y`` is -1 or 1."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w, reg = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    reg[-1, -1] = 1e-3
    loss = lambda w: w @ reg @ w + (cost * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    for _ in range(steps):
        on = y * (x @ w) < 1
        a = x[on] * cost[on, None]
        step, size = np.linalg.solve(reg + a.T @ x[on], a.T @ y[on]) - w, 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def platt(score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of a logistic curve through scores and 0/1 labels, with Platt's smoothed targets."""
    weight = np.ones(len(score)) if weight is None else weight
    n1, n0 = weight[y == 1].sum(), weight[y == 0].sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    loss = lambda a, b: (weight * (np.logaddexp(0, a * score + b) - t * (a * score + b))).sum()
    a, b = 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -35, 35)))
        d, v = weight * (p - t), weight * p * (1 - p)
        h = np.array([[(v * score * score).sum(), (v * score).sum()], [(v * score).sum(), v.sum()]]) + 1e-9 * np.eye(2)
        step, size = np.linalg.solve(h, np.array([(d * score).sum(), d.sum()])), 1.0
        while size > 1e-8 and loss(a - size * step[0], b - size * step[1]) > loss(a, b):
            size /= 2  # classes that don't overlap make whole steps run away
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(size * step).max() < 1e-7:
            break
    return float(a), float(b)


class Sentences:
    """The sentences of a block of texts as ranges of words."""

    def __init__(self, texts: list[str]):
        tokens: list[str] = []
        ends: list[int] = []  # of lines
        docs: list[int] = []  # first word of each text
        for text in texts:
            docs.append(len(tokens))
            for line in text.lower().split("\n"):
                tokens += line.split()
                ends.append(len(tokens))
        self.words, self.docs = tokens, np.array(docs, np.int64)
        brk = np.zeros(len(tokens) + 1, bool)
        brk[[0, *ends, *docs]] = True
        self.brk = brk[:-1]

    def runs(self, single: np.ndarray) -> list[tuple[int, int]]:
        """Where runs of at least ``SPACED`` single letters start and end, each within one text."""
        if not single.any():
            return []
        edge = np.diff(np.r_[False, single, False].astype(np.int8))
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - first >= SPACED
        out = []
        for a, b in zip(first[long].tolist(), end[long].tolist(), strict=True):
            inner = self.docs[np.searchsorted(self.docs, a, "right") : np.searchsorted(self.docs, b, "left")].tolist()
            out += [(x, y) for x, y in zip([a, *inner], [*inner, b], strict=True) if y - x >= SPACED]
        return out

    def starts(self, ends: np.ndarray) -> np.ndarray:
        """First word of each sentence, where ``ends`` tells the words that end one; none is longer than ``SENTENCE``."""
        brk = self.brk.copy()
        brk[1:] |= ends[:-1]
        at = np.flatnonzero(brk)
        place = np.arange(len(brk)) - np.repeat(at, np.diff(np.r_[at, len(brk)]))
        return np.flatnonzero(place % SENTENCE == 0)


class Model:
    """A weight per landmark, the bias and the calibration. Without landmarks all texts score the same."""

    def __init__(self, kernel: Kernel | None = None, beta: np.ndarray | None = None, bias: float = 0.0, slope: float = 0.0, offset: float = 0.0):
        self.kernel, self.beta, self.bias, self.slope, self.offset = kernel, beta, bias, slope, offset
        self._forget()

    def _forget(self) -> None:
        self._at: defaultdict[str, int] = defaultdict(count().__next__)  # a word that isn't there gets the next number
        self._known: dict[bytes, float] = {}
        self._score, self._flag = np.zeros(0, np.float32), np.zeros(0, np.uint8)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def word_scores(self, words: list[np.ndarray]) -> np.ndarray:
        """The decision value of each word, as symbols; a long one's is that of its worst piece, that of a word not near any toxic landmark the bias."""
        pieces, owner = [], []
        for i, s in enumerate(words):
            for at in range(0, len(s) - PIECE // 2, PIECE // 2) if len(s) > PIECE else (0,):
                pieces.append(s[at : at + PIECE])
                owner.append(i)
        out = np.full(len(words), -np.inf)
        if self.kernel is not None:
            at = np.concatenate([np.flatnonzero(self.kernel.near(pieces[a : a + 4096])) + a for a in range(0, len(pieces), 4096)] or [np.empty(0, np.int64)])
            np.maximum.at(out, np.array(owner, np.int64)[at], self.kernel.values([pieces[i] for i in at]) @ self.beta)
        return np.where(np.isfinite(out), out, 0.0) + self.bias

    def _number(self, tokens: list[str]) -> tuple[np.ndarray, list[str]]:
        """Each word's number, and the words that had none before."""
        known = len(self._at)
        at = np.fromiter(map(self._at.__getitem__, tokens), np.int64, len(tokens))
        return at, list(islice(self._at, known, None))

    def look_up(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Score and flags (1: a single letter, 2: ends a sentence) of each word, computed once per distinct word."""
        at, new = self._number(tokens)
        if len(self._at) > MEMO_WORDS and len(new) < len(self._at):
            self._forget()
            at, new = self._number(tokens)
        if new:
            keys, size, last = spell(new)
            flag = (size == 1) + 2 * np.isin(last, [ord(c) for c in ".!?"])
            fresh = [k for k in dict.fromkeys(keys) if k not in self._known]
            self._known.update(zip(fresh, self.word_scores([np.frombuffer(k, np.uint8) for k in fresh]).tolist(), strict=True))
            self._score = np.r_[self._score, np.fromiter(map(self._known.__getitem__, keys), np.float32, len(keys))]
            self._flag = np.r_[self._flag, flag.astype(np.uint8)]
        return self._score[at], self._flag[at]

    def sentences(self, texts: list[str]) -> tuple[Sentences, np.ndarray, np.ndarray]:
        """The texts' words, each word's score, and each sentence's first word."""
        s = Sentences(texts)
        if not s.words:
            return s, np.empty(0), np.empty(0, np.int64)
        score, flag = self.look_up(s.words)
        single = (flag & 1) > 0
        for a, b in s.runs(single):  # one word, in the place of the first letter
            s.words[a] = "".join(s.words[a:b])
            s.words[a + 1 : b] = [""] * (b - a - 1)
            score[a], score[a + 1 : b] = self.word_scores([letters(s.words[a])])[0], -np.inf
        return s, score, s.starts(((flag & 2) > 0) & ~single)

    def decisions(self, texts: list[str]) -> np.ndarray:
        """The score of each text's worst sentence, which is that of its worst word; a text without words has the bias."""
        s, score, starts = self.sentences(texts)
        out = np.full(len(texts), self.bias)
        if len(starts):
            np.maximum.at(out, np.searchsorted(s.docs, starts, "right") - 1, np.maximum.reduceat(score, starts))
        return out

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.decisions(texts) + self.offset, -35, 35)))


def blocks(texts: list[str], limit: int = BLOCK_CHARS):
    """Slices of whole texts, of about ``limit`` characters at most unless one text is longer."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if texts:
        yield at, len(texts)


def _mapper(shared, method: str):
    def run(batches):
        for batch in batches:
            names = [batch.schema.names[0], "score"]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            parts = [getattr(shared.value, method)(texts[a:b]) for a, b in blocks(texts)]
            out = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names)

    return run


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = MAX_LABELLED) -> DataFrame:
    """(id, text, y) of at most ``limit`` labelled documents outside the held-out fifth, drawn by hash of the id. Of several labels of an id the greatest counts; null labels and ids count for nothing."""
    train = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) != 0
    some = labels.where(train & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    some = some.orderBy(F.xxhash64("id"), "id").limit(limit)
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(some), "id")


_SIGNS = re.compile(r"[\W_]+")


def _distinct_words(batches):
    """(w, y, group) of each text's distinct words of 3 to ``PIECE`` letters; texts that share their least word hash, such as copies, are one group."""
    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = sorted({w for w in (_SIGNS.sub("", x) for x in set(text.lower().split())) if 2 < len(w) <= PIECE})
            if words:
                group = min(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words) >> 1
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array([y] * len(words), pa.int32()), pa.array([group] * len(words), pa.int64())], ["w", "y", "group"])


class Learner:
    """Landmarks and the model so far; finds the sentences that documents put forward."""

    def __init__(self, toxic: list[str], common: list[str]):
        self.anchor([letters(w) for w in toxic], [letters(w) for w in common])
        z = self.kernel.values([letters(w) for w in [*toxic, *common]]) @ self.whiten
        self.learn(z[: len(toxic)], z[len(toxic) :])

    def anchor(self, toxic: list[np.ndarray], clean: list[np.ndarray]) -> None:
        self.kernel = Kernel(toxic, clean)
        self.whiten = self.kernel.whitening()

    def coordinates(self, words: list[np.ndarray]) -> np.ndarray:
        return self.kernel.values(words) @ self.whiten

    def put_forward(self, texts: list[str], labels: list[int], seed: str) -> list[tuple[int, bytes]]:
        """(y, word) of each text's worst sentences, each sentence standing for its worst word: of a toxic text the worst one and all others that the
        model finds toxic, as they are and with letters inserted; of a clean one the ``CLEAN`` worst."""
        s, score, starts = self.model.sentences(texts)
        out: list[tuple[int, bytes]] = []
        if not len(starts):
            return out
        ends = np.r_[starts[1:], len(s.words)]
        worst = np.maximum.reduceat(score, starts)
        owner = np.searchsorted(s.docs, starts, "right") - 1
        cut = np.searchsorted(owner, np.arange(len(texts) + 1))
        for i, y in enumerate(labels):
            a, b = int(cut[i]), int(cut[i + 1])
            sure = max(1, min(TOXIC, int((worst[a:b] >= self.level).sum()))) if y else CLEAN
            for k in (a + np.argsort(-worst[a:b], kind="stable")[:sure]).tolist():
                word = letters(s.words[starts[k] + int(np.argmax(score[starts[k] : ends[k]]))])
                at = 0
                if len(word) > PIECE:
                    cuts = range(0, len(word) - PIECE // 2, PIECE // 2)
                    at = cuts[int(np.argmax(self.model.word_scores([word[c : c + PIECE] for c in cuts])))]
                word = word[at : at + PIECE]
                out.append((y, word.tobytes()))
                if y and len(word) > 2:
                    rng = random.Random(seed.encode() + word.tobytes())  # not by place: rows come in any order
                    out += [(y, np.insert(word, rng.randrange(1, len(word)), rng.randrange(1, 27)).tobytes()) for _ in range(INSERTED)]
        return out

    def learn(self, toxic: np.ndarray, clean: np.ndarray, toxic_cost: np.ndarray | None = None, clean_cost: np.ndarray | None = None) -> None:
        """A round's SVM. A clean example without any kernel value stands for all words that aren't near a toxic landmark; it weighs as much as the others together."""
        a = np.ones(len(toxic)) if toxic_cost is None else toxic_cost
        b = np.ones(len(clean)) if clean_cost is None else clean_cost
        b = np.r_[b, b.sum()]
        z = np.vstack([toxic, clean, np.zeros((1, toxic.shape[1]))])
        y = np.r_[np.ones(len(toxic)), -np.ones(len(clean) + 1)]
        w, bias = svm(z, y, np.r_[a / a.sum() * b.sum() * BALANCE, b] * COST)
        self.model = Model(self.kernel, self.whiten @ w, bias)
        self.level = max(0.0, float(np.quantile(clean @ w, LEVEL)) + bias)


    def calibrate(self, score: np.ndarray, y: np.ndarray, bad: Counter[bytes]) -> None:
        """Platt's curve through the scores of labelled documents and of single toxic sentences, inserted letters and all, which weigh as much as the toxic
        documents: else it would ask for as much as documents with many insults have. At most ``FALSE_ALARMS`` of the clean documents may reach 0.5."""
        alone = self.model.word_scores([np.frombuffer(w, np.uint8) for w in bad])
        weight = np.array(list(bad.values()), float) * (y.sum() / max(1, sum(bad.values())))
        slope, offset = platt(np.r_[score, alone], np.r_[y, np.ones(len(alone))], np.r_[np.ones(len(score)), weight])
        most = float(np.quantile(score[y == 0], 1 - FALSE_ALARMS, method="higher"))
        self.model.slope, self.model.offset = slope, min(offset, -slope * most - 0.05)


def _worst(shared, seed: str):
    def run(batches):
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in blocks(texts):
                out = shared.value.put_forward(texts[a:b], labels[a:b], seed)
                yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in out], pa.int32()), pa.array([w for _, w in out], pa.binary())], ["y", "word"])

    return run


def _constant(share: float) -> Model:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Model(offset=float(np.log(share / (1 - share))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = MAX_LABELLED, landmarks: int = LANDMARKS) -> Model:
    """Fit on a bounded sample of labelled documents (``limit``), whole texts.

    The first landmarks are, one half, the words that are commonest in toxic documents among those that clean ones hardly have (counted over documents of
    different least word hash, so that copies count little), the other half the commonest of all others; they only span the space for the first round. The
    landmarks of the next rounds are those sentences that most documents put forward. What comes to the driver is a few sentences' worst words per document,
    counted, so bounded by ``limit``. Null and empty texts put none forward. Without both labels, or without any such word, all texts score the
    share of toxic labels.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    # written once: else each use scans all documents
    rows = training_rows(docs, labels, id_col, text_col, label_col, limit).select("text", F.when(F.col("y") > 0, 1).otherwise(0).alias("y"))
    rows = scratch.table(rows.repartition(SPREAD), "sample").repartition(SPREAD)
    sizes = {r["y"]: r["c"] for r in rows.groupBy("y").agg(F.count("*").alias("c")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return _constant(n1 / max(1, n0 + n1))
    counts = rows.mapInArrow(_distinct_words, "w string, y int, group long").distinct().groupBy("w").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    counts = scratch.table(counts, "words")
    odds = (F.col("p") / n1) / ((F.col("n") + 0.2) / n0)
    half = landmarks // 2
    toxic = [r["w"] for r in counts.where(F.col("p") >= (2 if n1 >= 10 else 1)).where(odds > 5).orderBy(F.desc("p"), "n", "w").limit(half).collect()]
    common = [r["w"] for r in counts.where("n > 0").where(odds < 2).orderBy(F.desc("n"), "w").limit(half).collect()]
    if not toxic or not common:
        return _constant(n1 / (n0 + n1))
    learner = Learner(toxic, common)
    clean: Counter[bytes] = Counter()
    symbols = lambda words: [np.frombuffer(w, np.uint8) for w in words]
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast(learner)
        found = rows.mapInArrow(_worst(shared, str(r)), "y int, word binary").groupBy("y", "word").agg(F.count("*").alias("n")).collect()
        shared.unpersist()
        found = sorted((x["y"], bytes(x["word"]), x["n"]) for x in found)
        now = Counter({w: n for y, w, n in found if not y})
        clean.update(now)
        bad = Counter({w: n for y, w, n in found if y and n > clean[w]})  # what clean documents put forward as often is not what makes the others toxic
        if not bad or not clean:
            break
        if r < REANCHOR:
            learner.anchor(symbols(w for w, _ in bad.most_common(half)), symbols(w for w, _ in now.most_common(half)))
        learner.learn(learner.coordinates(symbols(bad)), learner.coordinates(symbols(clean)), np.array(list(bad.values()), float), np.sqrt(np.array(list(clean.values()), float)))
    model = learner.model
    shared = spark.sparkContext.broadcast(model)
    scored = rows.select("y", "text").mapInArrow(_mapper(shared, "decisions"), "y int, score double").collect()  # bounded by ``limit``
    learner.calibrate(np.array([r["score"] for r in scored]), np.array([r["y"] for r in scored]), bad)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row, in 0 to 1. Null and empty texts score as texts without words; a text of any length is read whole. Repeated rows and null ids are scored like any others."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_mapper(shared, "probabilities"), f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, all columns and other rows as they were; scored in place, without a join.

    A null or empty text scores as one without words. Each row goes by its own text, so that repeated rows go or stay together, and rows of
    one id with different texts may not; null ids are like any others. A score of exactly ``threshold`` goes. Extra columns of any name stay. An
    empty table gives an empty result; without labels of both kinds all rows score the share of toxic labels.
    """
    model = fit(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            parts = [shared.value.probabilities(texts[a:b]) for a, b in blocks(texts)]
            keep = np.concatenate(parts) < threshold if parts else np.empty(0, bool)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
