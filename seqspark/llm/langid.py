"""Language identification by unigram pieces, summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary.
A word's probability is the sum over all ways to cut it into pieces, by the
forward algorithm; a text's is the product over its words (pieces never cross
words, so nothing is lost by going word by word). The probabilities are
learned by expectation-maximisation over the distinct words of the training
documents; a letter that is no piece is spelled by its byte pieces.

Words are maximal runs of letters of the lower-cased text. The parameters are
languages x pieces, however large the corpus is; words and their counts stay in
Spark.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
training rows with a null language or text are left out; without any training
row all predictions are ``und``; extra columns are ignored; equal scores go to
the language first in alphabetical order.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.shared import Numbered, fold, mix64, table, written

WORD = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 800_000
COUNTER_WORDS = 200_000
BATCH = 4096
#: Sums of products above this have lost nothing to underflow; the few words below it are done again with logarithms.
SAFE = 1e-250
_PIECES: dict[str, Pieces] = {}
_SCORER: dict = {}
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary, and the lattice of a word's pieces.

    Pieces are looked up by a 64-bit hash of their characters, in a table of
    numpy arrays with linear probing, for all words of one length at once.
    Rows: 0 stands for no piece, piece i is row i + 1, and letters that are no
    piece follow, as they are met.
    """

    SLOTS = 18

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.id = {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.size = sp.vocab_size()
        self.longest = max(map(len, self.id))
        self.keys, self.rows = np.zeros(1 << self.SLOTS, np.uint64), np.zeros(1 << self.SLOTS, np.int32)
        by_length: dict[int, list[str]] = {}
        for piece in self.id:
            by_length.setdefault(len(piece), []).append(piece)
        for n, some in by_length.items():
            for piece, key in zip(some, self._prefixes(some, n)[n].tolist()):
                at = self._slot(np.uint64(key)).item()
                while self.keys[at]:
                    at = (at + 1) % len(self.keys)
                self.keys[at], self.rows[at] = key, self.id[piece] + 1

    def _slot(self, key):
        with np.errstate(over="ignore"):
            return ((key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    @staticmethod
    def _prefixes(words: list[str], n: int) -> np.ndarray:
        """[j, word]: a hash of the first j characters."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n).T
        codes = mix64(chars.astype(np.uint64) + _STEP)
        out = np.zeros((n + 1, len(words)), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(n):
                out[j + 1] = out[j] * _STEP + codes[j]
        return out

    def _find(self, key: np.ndarray) -> np.ndarray:
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.rows[slot], 0)
        left = np.flatnonzero((there != key) & (there != 0))
        while len(left):
            slot[left] = (slot[left] + 1) % len(self.keys)
            there = self.keys[slot[left]]
            out[left] = np.where(there == key[left], self.rows[slot[left]], 0)
            left = left[(there != key[left]) & (there != 0)]
        return out

    def lattice(self, words: list[str], n: int, spelled: dict[str, int]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """For words of n characters: [begin][length - 1] -> (words that have such a piece, its rows). ``spelled`` has the rows of letters that are no piece, and gets new ones."""
        p, out, power = self._prefixes(words, n), [[] for _ in range(n)], np.uint64(1)
        for x in range(1, min(n, self.longest) + 1):
            with np.errstate(over="ignore"):
                power = power * _STEP
                rows = self._find((p[x:] - p[:-x] * power).ravel()).reshape(n - x + 1, len(words))
            if x == 1:
                for i, b in zip(*np.nonzero(rows == 0)):
                    rows[i, b] = spelled.setdefault(words[b][i], self.size + 1 + len(spelled))
            for i in range(n - x + 1):
                at = np.flatnonzero(rows[i])
                out[i].append((at, rows[i, at]))
        return out


class Probabilities:
    """Log-probabilities by row (rows x languages), and the probabilities themselves; row 0 is impossible."""

    def __init__(self, vocab: Pieces, logp: np.ndarray):
        self.vocab, self.done = vocab, 0
        self.spelled: dict[str, int] = {}  # letters that are no piece -> row
        self.log = np.vstack([np.full(len(logp), -np.inf), logp.T])
        self.plain = np.exp(self.log)

    def lattice(self, words: list[str], n: int) -> list:
        """The words' lattice; afterwards there are rows for all its letters that are spelled by bytes."""
        out = self.vocab.lattice(words, n, self.spelled)
        new = list(self.spelled)[self.done :]
        if new:
            need = self.vocab.size + 1 + len(self.spelled)
            if need > len(self.log):
                more = np.full((need, self.log.shape[1]), -np.inf)  # as many again, so that copies stay few
                self.log, self.plain = np.vstack([self.log, more]), np.vstack([self.plain, np.exp(more)])
            for c in new:
                at = self.spelled[c]
                self.log[at] = self.log[[self.vocab.byte[b] + 1 for b in c.encode("utf-8", "surrogatepass")]].sum(0)
                self.plain[at] = np.exp(self.log[at])
            self.done = len(self.spelled)
        return out


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def _by_length(words: list[str]):
    """Indexes of words of one length each, in batches whose lattices stay small."""
    sizes = np.array([len(w) for w in words])
    order = np.argsort(sizes, kind="stable")
    heads = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for at in np.split(order, heads[1:]):
        n = int(sizes[at[0]]) if len(at) else 0
        step = max(1, min(BATCH, 4_000_000 // (max(n, 1) * 16)))
        for i in range(0, len(at), step):
            yield n, at[i : i + step]


def forward(lattice: list, p: np.ndarray, words: int) -> np.ndarray:
    """alpha[j, word, language]: the sum over all segmentations of the first j characters; p: probabilities by row."""
    alpha = np.zeros((len(lattice) + 1, words, p.shape[1]))
    alpha[0] = 1.0
    for i, found in enumerate(lattice):
        for x, (at, rows) in enumerate(found, 1):
            if len(at):
                alpha[i + x, at] += p[rows] * alpha[i, at]
    return alpha


def backward(lattice: list, p: np.ndarray, words: int) -> np.ndarray:
    """beta[i, word, language]: the sum over all segmentations from character i on."""
    beta = np.zeros((len(lattice) + 1, words, p.shape[1]))
    beta[-1] = 1.0
    for i in range(len(lattice) - 1, -1, -1):
        for x, (at, rows) in enumerate(lattice[i], 1):
            if len(at):
                beta[i, at] += p[rows] * beta[i + x, at]
    return beta


def forward_log(lattice: list, logp: np.ndarray, words: int) -> np.ndarray:
    """The logarithm of ``forward``, from log-probabilities, however small they are."""
    alpha = np.full((len(lattice) + 1, words, logp.shape[1]), -np.inf)
    alpha[0] = 0.0
    for i, found in enumerate(lattice):
        for x, (at, rows) in enumerate(found, 1):
            if len(at):
                alpha[i + x, at] = np.logaddexp(alpha[i + x, at], logp[rows] + alpha[i, at])
    return alpha


def backward_log(lattice: list, logp: np.ndarray, words: int) -> np.ndarray:
    beta = np.full((len(lattice) + 1, words, logp.shape[1]), -np.inf)
    beta[-1] = 0.0
    for i in range(len(lattice) - 1, -1, -1):
        for x, (at, rows) in enumerate(lattice[i], 1):
            if len(at):
                beta[i, at] = np.logaddexp(beta[i, at], logp[rows] + beta[i + x, at])
    return beta


def word_log_probabilities(words: list[str], table_: Probabilities) -> np.ndarray:
    """words x languages."""
    out = np.zeros((len(words), table_.log.shape[1]))
    marked = ["▁" + w for w in words]
    for n, at in _by_length(marked):
        some = [marked[i] for i in at]
        lattice = table_.lattice(some, n)
        total = forward(lattice, table_.plain, len(at))[n]
        with np.errstate(divide="ignore"):
            out[at] = np.log(total)
        small = np.flatnonzero(~(total > SAFE).all(1))
        if len(small):
            again = table_.lattice([some[i] for i in small], n)
            out[at[small]] = forward_log(again, table_.log, len(small))[n]
    return out


def expected_counts(words: list[str], n_words: np.ndarray, table_: Probabilities, lang: int) -> np.ndarray:
    """Expected uses of every piece in the words of one language, over all segmentations."""
    vocab = table_.vocab
    got = np.zeros(len(table_.log))
    marked = ["▁" + w for w in words]

    def add(lattice, alpha, beta, p, total, n, combine):
        nonlocal got
        if len(got) < len(table_.log):
            got = np.append(got, np.zeros(len(table_.log) - len(got)))
        for i, found in enumerate(lattice):
            for x, (at, rows) in enumerate(found, 1):
                if len(at):
                    np.add.at(got, rows, combine(p[rows, 0], alpha[i, at, 0], beta[i + x, at, 0], total[at]) * n[at])

    for n, at in _by_length(marked):
        some, weight = [marked[i] for i in at], n_words[at]
        lattice = table_.lattice(some, n)
        p, logp = table_.plain[:, lang : lang + 1], table_.log[:, lang : lang + 1]
        alpha = forward(lattice, p, len(at))
        total = alpha[n, :, 0]
        small = np.flatnonzero(~(total > SAFE))
        beta = backward(lattice, p, len(at))
        add(lattice, alpha, beta, p, np.where(total > SAFE, total, np.inf), weight, lambda a, b, c, t: a * b * c / t)
        if len(small):
            again = table_.lattice([some[i] for i in small], n)
            alpha, beta = forward_log(again, logp, len(small)), backward_log(again, logp, len(small))
            add(again, alpha, beta, logp, alpha[n, :, 0], weight[small], lambda a, b, c, t: np.exp(a + b + c - t))
    out = got[1 : vocab.size + 1].copy()
    for c, row in table_.spelled.items():
        if row < len(got) and got[row]:
            np.add.at(out, [vocab.byte[b] for b in c.encode("utf-8", "surrogatepass")], got[row])
    return out


def words_of(token: str) -> list[str]:
    """The words in a run of anything but white space."""
    return WORD.findall(token)


def train(docs: DataFrame, vocabulary: str, text_col: str = "text", lang_col: str = "lang", rounds: int = 3, smoothing: float = 0.5) -> dict:
    """Languages, their log shares of documents, and log-probabilities (languages x pieces)."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")

    def counted(batches):
        def emit(docs_of=()):
            found: Counter = Counter({(k, ""): docs_of[k] for k in docs_of})
            for lang, c in by_lang.items():
                for token, n in c.items():
                    if token.isalpha():
                        found[lang, token] += n
                    else:
                        for w in words_of(token):
                            found[lang, w] += n
            keys = list(found)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())], names=["lang", "word", "n"])

        by_lang: dict[str, Counter] = {}
        docs_of: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                by_lang.setdefault(lang, Counter()).update(text.as_py().lower().split())
                docs_of[lang] += 1
            if sum(map(len, by_lang.values())) > COUNTER_WORDS:
                yield emit()
                by_lang = {}
        yield emit(docs_of)

    summed = rows.mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = written(summed, "langid-words")
    per = words.where("word = ''").orderBy("lang").collect()  # a row per language
    langs = [r["lang"] for r in per]
    size = pieces(vocabulary).size
    logp = np.full((len(langs), size), -np.log(size))
    for _ in range(rounds if langs else 0):
        sums = words.where("word <> ''").mapInArrow(_expectation(vocabulary, langs, logp), "lang int, piece int, e double").groupBy("lang", "piece").agg(F.sum("e").alias("e"))
        counts = np.full((len(langs), size), smoothing)
        for batch in sums.toArrow().to_batches():  # at most languages x pieces
            np.add.at(counts, (batch.column(0).to_numpy(), batch.column(1).to_numpy()), batch.column(2).to_numpy())
        logp = np.log(counts) - np.log(counts.sum(1, keepdims=True))
    n = np.array([r["n"] for r in per], float)
    return {"key": uuid.uuid4().hex, "langs": langs, "prior": np.log(n / n.sum()) if langs else n, "logp": logp}


def _expectation(vocabulary: str, langs: list[str], logp: np.ndarray):
    def run(batches):
        vocab = pieces(vocabulary)
        table_ = Probabilities(vocab, logp)
        out = np.zeros((len(langs), vocab.size))
        for batch in batches:
            lang = np.array([langs.index(x) for x in batch.column(0).to_pylist()])
            words, n = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for k in np.unique(lang).tolist():
                at = np.flatnonzero(lang == k)
                out[k] += expected_counts([words[i] for i in at], n[at].astype(float), table_, k)
        i, j = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(out[i, j])], names=["lang", "piece", "e"])

    return run


class Scorer:
    """Keeps the log-probabilities of the runs of letters and marks it has met, as rows of a matrix.

    No word reaches across white space, so a run's row is the sum of its words'; it is 0 for runs without a letter.
    """

    def __init__(self, model: dict, vocabulary: str):
        self.model = model
        self.table = Probabilities(pieces(vocabulary), model["logp"])
        self.at, self.rows = Numbered(), np.zeros((1 << 16, len(model["langs"])))

    def _learn(self) -> None:
        new, self.at.new = self.at.new, []
        words: dict[str, int] = {}
        of_token = []
        for token in new:
            found = [token] if token.isalpha() else [w for w in words_of(token) if any(map(str.isalpha, w))]
            of_token.append([words.setdefault(w, len(words)) for w in found])
        values = word_log_probabilities(list(words), self.table)
        while len(self.at) > len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        first = len(self.at) - len(new)
        counts = np.array([len(x) for x in of_token])
        token = np.repeat(np.arange(first, first + len(new)), counts)
        self.rows[first : len(self.at)] = 0.0
        np.add.at(self.rows, token, values[np.fromiter(chain.from_iterable(of_token), np.int64, len(token))])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        langs = self.model["langs"]
        if not langs:
            return [("und", 0.0)] * len(texts)
        if len(self.at) > CACHE_WORDS:
            self.at = Numbered()
        split = [x.lower().split() if x else [] for x in texts]
        sizes = np.array([len(x) for x in split], np.int64)
        rows = np.fromiter(map(self.at.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        if self.at.new:
            self._learn()
        total = np.zeros((len(texts), len(langs)))
        ends = np.cumsum(sizes)
        for i, a, b in zip(range(len(texts)), (ends - sizes).tolist(), ends.tolist()):
            total[i] = self.rows[rows[a:b]].sum(0)
        lettered = total.any(1)
        total += self.model["prior"]
        best = total.argmax(1)
        top = total[np.arange(len(texts)), best]
        score = 1.0 / np.exp(total - top[:, None]).sum(1)
        return [(langs[k], s) if on else ("und", 0.0) for k, s, on in zip(best.tolist(), score.tolist(), lettered.tolist())]


def scorer_of(model: dict, vocabulary: str) -> Scorer:
    """The worker's scorer of a model; it keeps what it has met from task to task."""
    if _SCORER.get("key") != model["key"]:
        _SCORER.update(key=model["key"], scorer=Scorer(model, vocabulary))
    return _SCORER["scorer"]


def predict(docs: DataFrame, model: dict, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred and score (the probability of that language among the learned ones)."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        scorer = scorer_of(model, vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 2500):
                part = batch.slice(at, 2500)
                found = scorer.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, vocabulary = table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    model = train(docs.where(fold("doc_id", 4) != 2), vocabulary)
    return predict(docs, model, vocabulary).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
