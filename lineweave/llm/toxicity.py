"""Abusive, hateful or sexual content: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Fit (driver, bounded): at most ``TRAIN_DOCS`` labelled documents, chosen by a hash of their id; everything else covers all
documents. Abuse is a sentence or two in a long text, so the classifier works on sentences and is fitted by multiple-instance
rounds: at first every sentence of a marked document counts as abusive unless its wording also stands in unmarked ones; later
only those that the last round's classifier agrees with. A document's score is its worst sentence's.

Score (one scan, nothing shuffled): each batch is one array of letters; hashes of all n-grams, weights and sums per sentence
are numpy operations, so Python handles no n-gram by itself.

Defined results: null and empty texts score -inf (never found); marks that are null or tie are ignored; without marks of both
kinds nothing is found. Repeated documents each keep their own row.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import share_of

TRAIN_DOCS = 4000
#: Of the sentences of unmarked texts, so many by a hash, and so many that look worst so far, are fitted on.
TRAIN_PLAIN, TRAIN_HARD = 3000, 2000
#: The share of unmarked texts' sentences that look less abusive than any that counts as abusive (the rest: wrong marks).
PLAIN_SHARE = 0.996
BITS = 18
GRAMS = (3, 4, 5)
ROUNDS = 2
FOLDS = 2
#: Of thresholds about as good on unseen texts the lowest is taken: wrong marks weigh on precision more than on recall.
NEAR_BEST = 0.997
#: Texts' worth of evidence for no difference in each n-gram's ratio; how strongly weights are drawn to 1.
PRIOR, DRAW = 8.0, 1e-6

# Signs that stand for letters in disguised words.
_LEET = {"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"}
_SPACED = re.compile(r"\b[a-z]([ .\-_*])[a-z](?:\1[a-z])+\b")
_RUN = re.compile(r"([a-z])\1{2,}")
_LEETED = re.compile(r"(?<![\w@$./-])(?:[@$!013457]{0,2}[a-z]+[@$!013457]|[@$013457]+[a-z])[a-z@$!013457]*(?![\w@/]|[.-]\w)")
_DIGITS = re.compile(r"\d+")
_END = re.compile(r"[.!?…]['\"”»)]?\s+|\n+|\d\s+(?=[A-ZÄÖÜ¡¿])")
_ACCENTS = dict(zip("äöüáéíóúñàèìòùâêîôûçß", "aouaeiounaeiouaeioucs"))
_ACCENTED = re.compile("[" + "".join(_ACCENTS) + "]")


def prepare(texts: list[str]) -> str:
    """All texts in one spelling, in one string: \\x01 ends a text, \\x00 a sentence, blanks stand around each.

    Lower case, no accents, spelled-out and drawn-out words joined, signs for letters undone, digits as 0.
    """
    s = "\x01".join([t.replace("\x00", " ").replace("\x01", " ") for t in texts])
    s = _END.sub("\x00", s).lower().replace("\t", " ")
    while "  " in s:
        s = s.replace("  ", " ")
    if not s.isascii():
        s = _ACCENTED.sub(lambda m: _ACCENTS[m[0]], unicodedata.normalize("NFKC", s))
    s = _SPACED.sub(lambda m: m[0].replace(m[1], ""), s)
    s = _RUN.sub(r"\1", s)
    s = _LEETED.sub(_unleet, s)
    s = _DIGITS.sub("0", s)
    return " " + s.replace("\x00", " \x00 ").replace("\x01", " \x01 ") + " \x01"


def _unleet(m: re.Match) -> str:
    w = m[0]
    n = sum(c.isalpha() for c in w)
    # A word with few signs among its letters; ids, versions and hashes have more.
    return "".join(_LEET.get(c, c) for c in w) if n >= 3 and len(w) - n <= 2 and not w[-1].isdigit() or "$" in w or "@" in w else w


def normals(text: str) -> list[str]:
    """The sentences of one text as ``prepare`` spells them."""
    return [x for x in prepare([text])[:-1].split("\x00") if not x.isspace()]


def featurize(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n-grams, sentence after sentence; their number per sentence)."""
    parts = [_featurize(sentences[a : a + 4000]) for a in range(0, len(sentences), 4000)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _featurize(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = "\x00".join(sentences) + "\x00"
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter((len(s) for s in sentences), np.int64, len(sentences))
    owner = np.repeat(np.arange(len(sentences), dtype=np.int32), sizes + 1)
    hashes, owners = [], []
    h = np.zeros(len(codes), np.uint32)
    last = codes == 0
    ok = np.ones(len(codes), bool)
    with np.errstate(over="ignore"):
        for n in range(1, max(GRAMS) + 1):
            m = len(codes) - n + 1
            if m <= 0:
                break
            h = (h[:m] ^ (h[:m] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[n - 1 :] * np.uint32(0x9E3779B1)
            ok = ok[:m] & ~last[n - 1 :]
            if n in GRAMS:
                hashes.append(((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS))[ok])
                owners.append(owner[:m][ok])
    h, o = np.concatenate(hashes), np.concatenate(owners)
    return h[np.argsort(o, kind="stable")], np.bincount(o, minlength=len(sentences))


def weigh(prepared: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score of each sentence, number of each sentence's text): the sum of its n-grams' weights over the root of their number."""
    codes = np.frombuffer(prepared.encode("utf-32-le"), np.uint32)
    stop = codes < 2
    ends = np.flatnonzero(stop)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - starts
    total = np.zeros(len(codes), np.float32)
    h = np.zeros(len(codes), np.uint32)
    ok = ~stop
    count = np.zeros(len(ends), np.int64)
    with np.errstate(over="ignore"):
        for n in range(1, max(GRAMS) + 1):
            m = len(codes) - n + 1
            if m <= 0:
                break
            h = (h[:m] ^ (h[:m] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[n - 1 :] * np.uint32(0x9E3779B1)
            ok = ok[:m] & ~stop[n - 1 :]
            if n in GRAMS:
                got = table[(h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)]
                got *= ok
                total[:m] += got
                count += np.maximum(sizes - n + 1, 0)
    score = np.add.reduceat(total, starts) / np.sqrt(np.maximum(count, 1))
    text = np.cumsum(codes[ends] == 1) - (codes[ends] == 1)
    return score, text


@dataclass
class Model:
    table: np.ndarray  # weight times log-count ratio of each hashed n-gram
    bias: float
    threshold: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The worst sentence's score of each text; -inf for null and blank ones."""
        out = np.full(len(texts), -np.inf)
        some = [i for i, t in enumerate(texts) if t and not t.isspace()]
        for a in range(0, len(some), 500):
            part = some[a : a + 500]
            each, text = weigh(prepare([texts[i] for i in part]), self.table)
            best = np.full(len(part), -np.inf)
            np.maximum.at(best, text, each)
            out[part] = best + self.bias
        return out


def _ratios(h: np.ndarray, doc: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """The log-count ratio of each n-gram: how much more often it stands in marked texts, drawn to 0 where it is rare.

    ``doc``: the text of each n-gram, ascending; texts are counted some at a time.
    """
    size = 1 << BITS
    m, u = np.zeros(size), np.zeros(size)
    cuts = np.searchsorted(doc, np.arange(0, len(marked) + 200, 200))
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            pair = np.unique(doc[a:b].astype(np.int64) * size + h[a:b])
            gram, of = pair & (size - 1), pair >> BITS
            m += np.bincount(gram, marked[of], size)
            u += np.bincount(gram, ~marked[of], size)
    p = float(marked.mean())
    return (np.log((m + PRIOR * p) / (u + PRIOR * (1 - p))) - np.log(p / (1 - p))).astype(np.float32)


def _fit_sentences(h: np.ndarray, n: np.ndarray, y: np.ndarray, use: np.ndarray, ratio: np.ndarray, steps: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression on n-gram counts scaled by the log-count ratios; its weights start at 1 (naive Bayes) and are drawn there."""
    keep = np.repeat(use, n)
    h, n, y = h[keep], n[use], y[use]
    grams, h = np.unique(h, return_inverse=True)
    size = len(grams)
    owner = np.repeat(np.arange(len(n)), n)
    x = (ratio[grams][h] / np.sqrt(np.maximum(n, 1))[owner]).astype(np.float32)
    starts = np.cumsum(n) - n
    w, b = np.ones(size, np.float32), -float(np.median(np.add.reduceat(x, starts)))
    balance = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1))
    g2w, g2b, rate = np.full(size, 1e-10), 1e-8, 0.1
    for _ in range(steps):
        s = np.add.reduceat(x * w[h], starts) + b
        g = ((1 / (1 + np.exp(-np.clip(s, -30, 30))) - (y > 0)) * balance).astype(np.float32)
        gw = np.bincount(h, x * g[owner], size) + DRAW * (w - 1)
        g2w += gw * gw
        w -= (rate * gw / np.sqrt(g2w)).astype(np.float32)
        gb = float(g.sum())
        g2b += gb * gb
        b -= rate * gb / np.sqrt(g2b)
    table = np.zeros(1 << BITS, np.float32)
    table[grams] = w * ratio[grams]
    return table, float(b)


def fit(texts: list[str], marks: list[int]) -> Model:
    """A model from marked texts; the threshold is the one that does best on texts the scoring model had not seen."""
    y_doc = np.array(marks) > 0
    parts = [list(dict.fromkeys(normals(t))) for t in texts]
    flat = [s for p in parts for s in p]
    if len(set(marks)) < 2 or not flat:
        return Model(np.zeros(1 << BITS, np.float32), -1.0, 0.0)
    doc = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    marked = y_doc[doc]
    h, n = featurize(flat)
    starts = np.cumsum(n) - n
    root = np.sqrt(np.maximum(n, 1))
    draw = np.array([zlib.crc32(s.encode()) for s in flat])
    fold = np.arange(len(y_doc)) % FOLDS

    def model(inside: np.ndarray) -> tuple[np.ndarray, float]:
        """From the texts in ``inside`` only."""
        mine = inside[doc]
        ids = np.cumsum(inside) - 1
        each = np.repeat(mine, n)
        ratio = _ratios(h[each], np.repeat(ids[doc[mine]].astype(np.int32), n[mine]), y_doc[inside])
        del each
        s = np.add.reduceat(ratio[h], starts) / root
        plain = np.flatnonzero(mine & ~marked)
        some = plain[np.argsort(draw[plain], kind="stable")[:TRAIN_PLAIN]]
        table, b = ratio, 0.0
        for k in range(ROUNDS):
            # Abusive is what in marked texts looks worse than nearly everything in unmarked ones.
            cut = np.quantile(s[plain], PLAIN_SHARE) if len(plain) else 0.0
            y = mine & marked & (s > cut)
            if not y.any():
                y = mine & marked
            worst = plain[np.argsort(-s[plain], kind="stable")[:TRAIN_HARD]]
            use = y.copy()
            use[some] = use[worst] = True
            table, b = _fit_sentences(h, n, y.astype(int), use, ratio)
            s = np.add.reduceat(table[h], starts) / root + b
        return table, b

    held = np.full(len(y_doc), -np.inf)
    for f in range(FOLDS):
        table, b = model(fold != f)
        s = np.add.reduceat(table[h], starts) / root + b
        mine = fold[doc] == f
        np.maximum.at(held, doc[mine], s[mine])
    table, b = model(np.ones(len(y_doc), bool))
    order = np.argsort(-held, kind="stable")
    hit = np.cumsum(y_doc[order])
    f1 = 2 * hit / (np.arange(1, len(order) + 1) + y_doc.sum())
    k = int(np.flatnonzero(f1 >= f1.max() * NEAR_BEST)[-1])
    low = held[order[k + 1]] if k + 1 < len(order) and np.isfinite(held[order[k + 1]]) else held[order[k]] - 1
    return Model(table, b, float((held[order[k]] + low) / 2))


def labelled(documents: DataFrame, doc_labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """(text, toxic): documents with a clear majority of marks, at most ``most`` of them, chosen by a hash of the id.

    Ids are chosen first; only the texts of the chosen ones leave their tasks.
    """
    marks = doc_labels.filter("toxic is not null").groupBy("doc_id").agg(F.avg("toxic").alias("m")).filter("m <> 0.5")
    chosen = share_of(marks, ["doc_id"], 2 * most).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", (F.col("m") > 0.5).cast("int").alias("toxic"))


def train(documents: DataFrame, doc_labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    rows = labelled(documents, doc_labels, most).collect()  # at most ``most`` rows
    return fit([r.text for r in rows], [r.toxic for r in rows])


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, source, score, toxic) of every document; the threshold is taken off the score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                s = m.scores(part.column(2).to_pylist()) - m.threshold
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array(s > 0, pa.bool_())], ["doc_id", "source", "score", "toxic"])

    return documents.select("doc_id", "source", "text").mapInArrow(run, f"doc_id {kinds['doc_id']}, source {kinds['source']}, score double, toxic boolean")


def find_toxic(documents: DataFrame, doc_labels: DataFrame) -> DataFrame:
    return score_documents(documents, train(documents, doc_labels)).filter("toxic").select("doc_id")


def rates_per_source(documents: DataFrame, doc_labels: DataFrame) -> DataFrame:
    """(source, docs, toxic_docs, rate)."""
    scored = score_documents(documents, train(documents, doc_labels))
    return scored.groupBy("source").agg(F.count("*").alias("docs"), F.count_if("toxic").alias("toxic_docs")).withColumn("rate", F.col("toxic_docs") / F.col("docs"))
