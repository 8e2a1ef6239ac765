"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces; every language has its own
probabilities of them. A word's probability in a language is the sum over all
its segmentations into pieces, computed by a forward pass; a text's is the
product over its words. Probabilities are learnt by expectation maximisation
over the same lattice (forward and backward passes). A worker scores each
distinct word once.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quarry.llm import kernels as K
from quarry.llm.common import cut, few, learnable

VOCABULARY = "piece_bpe_32k.model"
#: Training: documents a language, parts of them a language, characters a part, rounds of EM.
SAMPLE_DOCS, SAMPLE_PARTS, PART_CHARS, ROUNDS = 400, 20_000, 2048, 3
#: Rows of a table of languages or of chosen ids that may be sent to all executors.
BROADCAST = 500_000
#: Parts of a language whose words are counted at once.
COUNTED = 500
#: Letters of a word scored in probabilities; longer runs are scored in logarithms, which don't underflow.
WORD = 24
#: Probability of a letter that no piece covers, and count added to every piece.
UNKNOWN, SMOOTH = 1e-7, 0.02
#: Words a worker remembers.
REMEMBERED = 300_000
UNDETERMINED = "und"

#: Letters and the marks that combine with them.
_LETTERS = np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])
#: Letters alone: a text without any has no language.
_ALONE = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])
_MARK = 0x2581
_ODD = np.uint64(K._BASE)


def _code_value(code: np.ndarray) -> np.ndarray:
    return K.mix64(code.astype(np.uint64) + np.uint64(77))


class Lattice:
    """Piece numbers of all substrings of many words at once."""

    def __init__(self, path: str | None = None):
        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        lowered = sorted({p.lower() for p in pieces if all(c == "▁" or _LETTERS[ord(c)] for c in p)})
        hashes = np.array([self._hash(p) for p in lowered], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.number = order + 1  # 0: no piece
        self.size = len(lowered) + 2  # the last: a letter on its own that is no piece
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[self.hashes >> np.uint64(42)] = True
        self.longest = max((len(p) for p in lowered), default=1)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for v in _code_value(np.array([ord(c) for c in piece], dtype=np.uint32)).tolist():
            h = (h * int(_ODD) + v) % (1 << 64)
        return int(K.mix64(np.array([h], dtype=np.uint64))[0])

    def numbers(self, words: np.ndarray):
        """Yields (begin, end, piece number of each word) for words as a matrix of codes [n, letters]."""
        value = _code_value(words)
        n, length = words.shape
        for i in range(length):
            h = np.zeros(n, dtype=np.uint64)
            for j in range(i, min(length, i + self.longest)):
                h = h * _ODD + value[:, j]
                mixed = K.mix64(h)
                number = np.zeros(n, dtype=np.int64)
                likely = np.flatnonzero(self.maybe[mixed >> np.uint64(42)])
                if len(likely):
                    at = np.searchsorted(self.hashes, mixed[likely])
                    at[at == len(self.hashes)] = 0
                    same = self.hashes[at] == mixed[likely]
                    number[likely[same]] = self.number[at[same]]
                if j == i:
                    number[number == 0] = self.size - 1
                yield i, j + 1, number


def _forward(lattice: Lattice, words: np.ndarray, table: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """Probability of every prefix, [letters + 1, n, languages], and with ``keep`` the lattice's edges that exist."""
    n, length = words.shape
    alpha = np.zeros((length + 1, n, table.shape[1]))
    alpha[0] = 1
    edges = []
    for i, j, number in lattice.numbers(words):
        some = np.flatnonzero(number)
        if len(some):
            if keep:
                edges.append((i, j, some, number[some]))
            alpha[j, some] += alpha[i, some] * table[number[some]]
    return alpha, edges


def _log_forward(lattice: Lattice, words: np.ndarray, length: np.ndarray, log_table: np.ndarray) -> np.ndarray:
    """Log probability of words of any ``length``, padded to one matrix: [n, languages]. Only as many prefixes as the longest piece are held."""
    n, width = words.shape
    held = lattice.longest + 1
    alpha = np.full((held, n, log_table.shape[1]), -np.inf)
    alpha[0] = 0
    out = np.zeros(alpha.shape[1:])
    last = 0
    for i, j, number in lattice.numbers(words):
        if i != last:
            alpha[last % held] = -np.inf
            out[length == i] = alpha[i % held, length == i]
            last = i
        some = np.flatnonzero(number)
        if len(some):
            alpha[j % held, some] = np.logaddexp(alpha[j % held, some], alpha[i % held, some] + log_table[number[some]])
    out[length == width] = alpha[width % held, length == width]
    return out


def _log_expected(lattice: Lattice, words: np.ndarray, length: np.ndarray, log_p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts of weighted words of any ``length`` under one language."""
    n, width = words.shape
    alpha, beta = np.full((width + 1, n), -np.inf), np.full((width + 1, n), -np.inf)
    alpha[0] = 0
    edges = []
    for i, j, number in lattice.numbers(words):
        some = np.flatnonzero((number > 0) & (j <= length))
        if len(some):
            edges.append((i, j, some, number[some]))
            alpha[j, some] = np.logaddexp(alpha[j, some], alpha[i, some] + log_p[number[some]])
    beta[length, np.arange(n)] = 0
    whole = alpha[length, np.arange(n)]
    expected = np.zeros(lattice.size)
    for i, j, some, number in sorted(edges, key=lambda e: -e[0]):
        share = log_p[number] + beta[j, some]
        beta[i, some] = np.logaddexp(beta[i, some], share)
        expected += np.bincount(number, weights=weight[some] * np.exp(alpha[i, some] + share - whole[some]), minlength=lattice.size)
    return expected


def _padded(rows: list[np.ndarray]):
    """Yields (positions in ``rows``, matrix, lengths) of code rows of similar length."""
    size = np.array([len(r) for r in rows])
    order = np.argsort(size, kind="stable")
    begin = 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and size[order[end]] <= 1.25 * size[order[begin]] and (end - begin) * size[order[end]] < 100_000:
            end += 1
        at = order[begin:end]
        matrix = np.zeros((len(at), size[at].max()), dtype=np.uint32)
        for k, r in enumerate(at.tolist()):
            matrix[k, : size[r]] = rows[r]
        yield at, matrix, size[at]
        begin = end


class Words:
    """Letter runs of texts, lower-cased."""

    def __init__(self, texts: list[str]):
        lowered = [t.lower() for t in texts]
        joined = "\n".join(lowered) + "\n"
        self.code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _LETTERS[self.code]
        edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        if len(letter) and letter[0]:
            edge = np.concatenate(([0], edge))
        begin, end = edge[0::2], edge[1::2]
        self.begin, self.end = begin, end
        lines = np.cumsum([len(t) + 1 for t in lowered])
        self.bounds = np.concatenate(([0], np.searchsorted(begin, lines)))
        power, inverse = K._power(len(self.code) + 1)
        total = np.zeros(len(self.code) + 1, dtype=np.uint64)
        np.cumsum(_code_value(self.code) * power[: len(self.code)], out=total[1:])
        self.hashes = K.mix64((total[end] - total[begin]) * inverse[begin] + (end - begin + 64).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def groups(self, which: np.ndarray):
        """The words numbered ``which`` of up to WORD letters as code matrices: (positions in ``which``, matrix), equal lengths together; a word's start is marked."""
        length = (self.end - self.begin)[which]
        for size in np.unique(length[length <= WORD]).tolist():
            at = np.flatnonzero(length == size)
            matrix = np.full((len(at), size + 1), _MARK, dtype=np.uint32)
            matrix[:, 1:] = self.code[self.begin[which[at]][:, None] + np.arange(size)]
            for a in range(0, len(at), 8000):
                yield at[a : a + 8000], matrix[a : a + 8000]

    def runs(self, which: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Positions in ``which`` of longer words, and their codes with a marked start."""
        at = np.flatnonzero((self.end - self.begin)[which] > WORD)
        return at, [np.concatenate(([np.uint32(_MARK)], self.code[self.begin[w] : self.end[w]])) for w in which[at].tolist()]


class LanguageModel:
    """Languages, and piece probabilities [pieces, languages]."""

    def __init__(self, languages: list[str], table: np.ndarray, path: str | None = None):
        self.languages, self.table, self.path = languages, table, path

    def column(self, text: str | Column) -> Column:
        """Struct of language and score (the language's posterior probability, all languages alike beforehand)."""
        model = self

        @arrow_udf("struct<lang:string,score:double>")
        def run(values: pa.Array) -> pa.Array:
            lang, score = _scorer(model).predict(["" if t is None else t for t in values.to_pylist()])
            K.trim()
            return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang", "score"])

        return run(text)


class _Scorer:
    def __init__(self, model: LanguageModel):
        self.model, self.lattice = model, Lattice(model.path)
        self.log_table = np.log(np.maximum(model.table, 1e-300))
        self._forget()

    def _forget(self) -> None:
        self.hash, self.value = np.zeros(0, dtype=np.uint64), np.zeros((0, len(self.model.languages)))

    def _learn(self, words: Words, which: np.ndarray, hashes: np.ndarray) -> None:
        value = np.zeros((len(which), len(self.model.languages)))
        for at, matrix in words.groups(which):
            alpha, _ = _forward(self.lattice, matrix, self.model.table)
            value[at] = np.log(np.maximum(alpha[-1], 1e-300))
        long, rows = words.runs(which)
        for at, matrix, length in _padded(rows):
            value[long[at]] = _log_forward(self.lattice, matrix, length, self.log_table)
        place = np.searchsorted(self.hash, hashes)
        self.hash, self.value = np.insert(self.hash, place, hashes), np.insert(self.value, place, value, axis=0)

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability per text and language; words per text."""
        words = Words(texts)
        k = len(self.model.languages)
        counts = np.diff(words.bounds)
        if not len(words.hashes) or not k:
            return np.zeros((len(texts), k)), counts
        distinct, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.hash) > REMEMBERED:
            self._forget()
        at = np.minimum(np.searchsorted(self.hash, distinct), max(len(self.hash) - 1, 0))
        new = self.hash[at] != distinct if len(self.hash) else np.ones(len(distinct), dtype=bool)
        if new.any():
            self._learn(words, first[new], distinct[new])
            at = np.searchsorted(self.hash, distinct)
        each = self.value[at][which]
        text = np.repeat(np.arange(len(texts)), counts)
        return np.stack([np.bincount(text, weights=each[:, l], minlength=len(texts)) for l in range(k)], axis=1), counts

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        lang, score = [], []
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end]) <= 500_000):
                size += len(texts[end])
                end += 1
            total, counts = self.totals(texts[begin:end])
            if total.shape[1]:
                p = np.exp(total - total.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = total.argmax(axis=1)
            for i in range(end - begin):
                known = counts[i] > 0 and total.shape[1] > 0 and lettered(texts[begin + i])
                lang.append(self.model.languages[best[i]] if known else UNDETERMINED)
                score.append(float(p[i, best[i]]) if known else 0.0)
            begin = end
        return lang, score


def lettered(text: str) -> bool:
    """Whether a text has a letter; combining marks are none."""
    return bool(_ALONE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].any())


_scorers: dict[int, _Scorer] = {}


def _scorer(model: LanguageModel) -> _Scorer:
    """This process's scorer of a model; one is kept."""
    key = hash((tuple(model.languages), model.table.tobytes()))
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = _Scorer(model)
    return _scorers[key]


def _counted(parts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Distinct words of all parts as (counts, code matrix), equal lengths together, and longer ones as (counts, code matrix, lengths)."""
    total: dict[int, int] = {}
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    long: dict[int, np.ndarray] = {}
    for a in range(0, len(parts), COUNTED):
        words = Words(parts[a : a + COUNTED])
        distinct, first, count = np.unique(words.hashes, return_index=True, return_counts=True)
        new = np.array([h not in total for h in distinct.tolist()], dtype=bool)
        for h, n in zip(distinct.tolist(), count.tolist(), strict=True):
            total[h] = total.get(h, 0) + n
        for at, matrix in words.groups(first[new]):
            found.setdefault(matrix.shape[1], []).append((distinct[new][at], matrix))
        at, rows = words.runs(first[new])
        long.update(zip(distinct[new][at].tolist(), rows, strict=True))
    out = []
    for own in found.values():
        hashes, matrix = np.concatenate([h for h, _ in own]), np.concatenate([m for _, m in own])
        weight = np.array([total[h] for h in hashes.tolist()], dtype=float)
        out += [(weight[a : a + 8000], matrix[a : a + 8000]) for a in range(0, len(weight), 8000)]
    count = np.array([total[h] for h in long], dtype=float)
    return out, [(count[at], matrix, length) for at, matrix, length in _padded(list(long.values()))]


def train_languages(docs: DataFrame, path: str | None = None, per_language: int = SAMPLE_DOCS) -> LanguageModel:
    """Learns all values of ``lang`` outside the held-out fold from at most ``per_language`` documents each.

    Of a language's documents at most SAMPLE_PARTS parts of PART_CHARS
    characters are used, chosen by hash; one language is with the driver at a
    time. Repeated rows count once. Ties of languages go to the smaller name.
    The model is dense, a row a piece and a column a language: 0.24 MB each, so
    a dirty ``lang`` of 4,000 values takes 1 GB of the driver and of each
    worker; clean the column before it has more.
    """
    known = docs.where(learnable(F.col("doc_id"))).where("lang is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    # Ids far from the sample by hash are left out before they are dealt by language; the count is within a few hundredths.
    counts = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids"))
    hashed = known.withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(5))).join(F.broadcast(counts) if few(counts, BROADCAST) else counts, "lang")
    near = hashed.where(F.pmod("h", F.lit(1 << 30)) / (1 << 30) * F.col("ids") <= 4 * per_language + 100)
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h", "doc_id")
    some = near.select("lang", "doc_id", "h").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).drop("h", "r")
    texts = docs.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).join(F.broadcast(some) if few(some, BROADCAST) else some, ["doc_id", "lang"])
    parts = texts.where("text <> ''").select("lang", "doc_id", "text", F.explode(F.sequence(F.lit(0), ((F.length("text") - 1) / PART_CHARS).cast("int"))).alias("k"))
    parts = parts.select("lang", F.expr(f"substring(text, k * {PART_CHARS} + 1, {PART_CHARS})").alias("part"), F.xxhash64("doc_id", "k").alias("h")).distinct()
    first = Window.partitionBy("lang").orderBy("h", "part")
    chosen = cut(parts.withColumn("r", F.row_number().over(first)).where(F.col("r") <= SAMPLE_PARTS).select("lang", "part", "r"), "languages")
    languages = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())
    lattice = Lattice(path)
    table = np.zeros((lattice.size, len(languages)))
    for l, lang in enumerate(languages):
        groups, runs = _counted([r["part"] for r in chosen.where(F.col("lang") == lang).orderBy("r").select("part").collect()])
        p = np.full((lattice.size, 1), 1.0 / lattice.size)
        for _ in range(ROUNDS):
            expected = np.full(lattice.size, SMOOTH)
            for weight, matrix in groups:
                alpha, edges = _forward(lattice, matrix, p, keep=True)
                beta = np.zeros(alpha.shape[:2])
                beta[-1] = 1
                whole = np.maximum(alpha[-1, :, 0], 1e-300)
                for i, j, which, number in sorted(edges, key=lambda e: -e[0]):
                    share = p[number, 0] * beta[j, which]
                    beta[i, which] += share
                    expected += np.bincount(number, weights=weight[which] * alpha[i, which, 0] * share / whole[which], minlength=lattice.size)
            log_p = np.log(np.maximum(p[:, 0], 1e-300))
            for weight, matrix, length in runs:
                expected += _log_expected(lattice, matrix, length, log_p, weight)
            expected[0] = 0
            expected[-1] = 0
            p = (expected / expected.sum())[:, None]
            p[-1] = UNKNOWN
        table[:, l] = p[:, 0]
    return LanguageModel(languages, table, path)
